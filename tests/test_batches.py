"""Texts go to Python in batches of a bounded size."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.functions import batches
from postlake.functions.facts import text_facts
from postlake.functions.stems import stems
from postlake.functions.text import fold_exact
from postlake.operators import inverted
from postlake.sources import markup

NAMES = {"spark.sql.execution.arrow.maxRecordsPerBatch": batches.ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": batches.BYTES}


@pytest.fixture
def large(spark):
    before = {name: spark.conf.get(name) for name in NAMES}
    for name, most in NAMES.items():
        spark.conf.set(name, str(most * 100))
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_postings_leave_a_worker_in_parts():
    words = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([" ".join(words)] * 20)], names=["doc", "text"])
    made = list(inverted._text_postings(4)(iter([batch])))
    one = len(inverted.text_terms(" ".join(words)))
    assert sum(b.num_rows for b in made) == 20 * one
    assert max(b.num_rows for b in made) < inverted._ROWS + one
    assert made[0].column("doc").to_pylist()[:1] == [0] and set().union(*[b.column("doc").to_pylist() for b in made]) == set(range(20))


def test_an_index_takes_small_batches(large, tmp_path):
    df = large.createDataFrame([(1, None, "a word")], "doc long, title string, text string")
    inverted.Index(large, f"file://{tmp_path}/index").apply(df, 0)
    assert all(int(large.conf.get(name)) == most for name, most in NAMES.items())


@pytest.mark.parametrize("made", [lambda: text_facts(F.col("t"), "skills"), lambda: stems(F.split("t", " ")), lambda: fold_exact(F.col("t"))])
def test_functions_of_texts_take_small_batches(large, made):
    large.createDataFrame([("Python",)], "t string").select(made()).collect()
    assert all(int(large.conf.get(name)) == most for name, most in NAMES.items())


@pytest.mark.parametrize("made", [markup.html_to_text, markup.sanitize_html])
def test_functions_of_pages_take_small_batches(large, made):
    assert large.createDataFrame([("<p>a</p>",), (None,)], "t string").select(made("t").alias("x")).where("x IS NOT NULL").count() == 1
    assert all(int(large.conf.get(name)) == most for name, most in NAMES.items())
