from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from postlake.llm import warc as A
from postlake.llm._shared import fresh_path

SCHEMA = "page_id long, url string, html string"


def digest(html: str | None) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def corpus():
    rng = random.Random(1)
    bodies = ["", None, "<p>é😀</p>", "x" * 200_000, "<p>\r\n\r\nWARC/1.1\r\n</p>"] + [f"<p>{rng.random()}</p>" for _ in range(20)]
    return [(i, rng.choice([None, "", f"http://x.io/{i}?q=é", "http://x.io/a\r\nWARC-Type: fake"]), rng.choice(bodies)) for i in range(1, 120)]


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(A, "READ_BYTES", 64)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {int(r.record_id.rsplit(":", 1)[1]): r for r in A.read_archives(A.write_archives(df, fresh_path(spark, "warc"), least=least)).collect()}
    assert len(got) == len(rows)
    first: dict[str, int] = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= least:
            first[digest(html)] = min(i, first.get(digest(html), i))
    for i, url, html in rows:
        r, of = got[i], first.get(digest(html), i)
        assert (r.payload_digest, r.http_length) == (digest(html), len((html or "").encode()))
        assert r.record_type == ("response" if of == i else "revisit")
        assert r.refers_to == (None if of == i else f"urn:page:{of}")
        assert r.payload == ((html or "").encode() if of == i else None)
        assert r.target_uri == (None if url is None else url.replace("\r\n", "%0D%0A"))


def test_records_are_gzip_members_that_others_can_read():
    data = b"".join(A.record("response", f"urn:page:{i}", "http://x.io", b"body %d" % i) for i in range(3))
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 3 and "body 2\r\n\r\n" in text


@pytest.mark.parametrize("damage", ["truncated", "digest", "length"])
def test_damage_is_found(damage):
    packed = A.record("response", "urn:page:1", None, b"hello world" * 10)
    raw = gzip.decompress(packed)
    if damage == "truncated":
        packed = packed[:-20]
    elif damage == "digest":
        packed = gzip.compress(raw.replace(b"hello", b"jello"))
    else:
        packed = gzip.compress(raw[:-3])
    with pytest.raises(A.WarcError):
        for pieces in A.members(io.BytesIO(packed)):
            A.parse(pieces)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (5, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, None, None)], SCHEMA).withColumn("sha1", F.lit("mine")).withColumn("first", F.lit(1))
    got = sorted((r.record_type, r.record_id, r.refers_to or "") for r in A.read_archives(A.write_archives(df, fresh_path(spark, "warc"))).collect())
    assert got == [("response", "urn:page:", ""), ("response", "urn:page:3", ""), ("response", "urn:page:3", ""), ("revisit", "urn:page:", "urn:page:3"), ("revisit", "urn:page:5", "urn:page:3")]
    assert A.read_archives(A.write_archives(df.limit(0), fresh_path(spark, "warc"))).count() == 0


def test_archives_are_closed_when_full(spark, monkeypatch):
    df = spark.createDataFrame([(i, None, f"<p>{i}</p>" * 50) for i in range(40)], SCHEMA).coalesce(1)
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 2000)
    write = A._write(fresh_path(spark, "warc"))
    import pandas as pd

    pdf = pd.DataFrame({"kind": "response", "record_id": [f"urn:page:{i}" for i in range(40)], "url": None, "html": [r.html for r in df.collect()], "refers_to": None})
    made = pd.concat(list(write(iter([pdf]))))
    assert len(made) > 1 and made["records"].sum() == 40 and (made["bytes"] < 3000).all()
