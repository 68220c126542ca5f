"""A demo board as a Python data source: a fixed list, released little by little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FIRST, PER_POLL, WINDOW, MINUTES = 6, 3, 30, 7


def posting_id(n: int, size: int) -> str:
    """The id of the ``n``-th release of a list of ``size``; repeats carry their round."""
    return f"demo-{n % size}" + (f"-r{n // size}" if n >= size else "")


class DemoSource(DataSource):
    """``format("demo_board")``: a stream of releases, or what is open after ``polls`` polls; ``size`` is the length of the list."""

    @classmethod
    def name(cls) -> str:
        return "demo_board"

    def schema(self) -> str:
        return "external_id string, title string, released int"

    def reader(self, schema) -> DataSourceReader:
        return OpenPostings(int(self.options.get("polls", "1")), int(self.options.get("size", "30")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return DemoReader(int(self.options.get("size", "30")))


class OpenPostings(DataSourceReader):
    """The full set of open postings after ``polls`` polls, a poll's releases in each partition."""

    def __init__(self, polls: int, size: int):
        self.end, self.size = FIRST + PER_POLL * (polls - 1), size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(max(0, self.end - WINDOW), self.end, PER_POLL)]

    def read(self, partition: InputPartition):
        return ((posting_id(n, self.size), f"Posting {n % self.size}", n) for n in range(partition.value, min(partition.value + PER_POLL, self.end)))


class DemoReader(SimpleDataSourceStreamReader):
    def __init__(self, size: int):
        self.size = size

    def initialOffset(self) -> dict:
        return {"released": 0}

    def read(self, start: dict):
        end = start["released"] + (PER_POLL if start["released"] else FIRST)
        return self.readBetweenOffsets(start, {"released": end}), {"released": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(posting_id(n, self.size), f"Posting {n % self.size}", n) for n in range(start["released"], end["released"])])


def visible(spark: SparkSession, polls: int, size: int = 30) -> DataFrame:
    """What the board shows after so many polls: the newest postings of the window, with their age in minutes."""
    released = FIRST + PER_POLL * (polls - 1)
    n = F.col("id")
    rows = spark.range(max(0, released - WINDOW), released)
    round_ = F.floor(n / size)
    return rows.select(F.concat(F.lit("demo-"), (n % size).cast("string"), F.when(round_ > 0, F.concat(F.lit("-r"), round_.cast("string"))).otherwise("")).alias("external_id"), ((released - 1 - n) * MINUTES).alias("minutes_ago"))


def released(board: DataFrame, polls: Column, source: str = "source_id", order: str = "external_id") -> DataFrame:
    """What boards show after so many polls each (a column of ``board``), if their rows are released little by little in the order of ``order``.

    Adds ``round`` and ``minutes_ago``. Each board goes round its own rows: those that come again carry the number of their round. Rows of a board are numbered by
    Spark, in one window a board.
    """
    per = Window.partitionBy(source)
    n, size = F.col("_n"), F.col("_size")
    rows = board.withColumns({"_end": FIRST + PER_POLL * (polls - 1), "_n": F.row_number().over(per.orderBy(order)) - 1, "_size": F.count("*").over(per)})
    # a row's releases are n, n + size, n + 2 size, ...; of those before the end the ones in the window show
    low = F.greatest(F.lit(0), F.ceil((F.col("_end") - WINDOW - n) / size))
    high = F.floor((F.col("_end") - 1 - n) / size)
    rows = rows.where(high >= low).withColumn("round", F.explode(F.sequence(low, high)))
    age = (F.col("_end") - 1 - n - F.col("round") * size) * MINUTES
    return rows.withColumn("minutes_ago", age).drop("_end", "_n", "_size")
