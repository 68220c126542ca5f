"""How large the Arrow batches are in which texts go to Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

#: Rows and bytes of an Arrow batch at most; a single row may be larger.
ROWS, BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession | None = None) -> None:
    """Lets Arrow batches of a session (the active one) hold ``ROWS`` rows and ``BYTES`` bytes at most; settings below stay.

    A worker holds whole batches and what it makes of them, so its memory would else grow with the rows of a task, up to 10,000 texts. Spark
    reads both settings when it runs a query, so they're set for the session; smaller batches change no result.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def in_text_batches(udf: Callable[..., Column]) -> Callable[..., Column]:
    """``udf`` for texts, which come to it in batches of a bounded size."""

    def call(*columns: Column | str) -> Column:
        text_batches()
        return udf(*columns)

    call.__name__, call.__doc__ = udf.__name__, udf.__doc__
    return call
