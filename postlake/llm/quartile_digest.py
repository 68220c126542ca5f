"""Document fingerprints: a digest of which quartile each bucket of hashed byte triplets lies in.

Byte triplets from a window of ten bytes are hashed into buckets and counted over the whole text. The digest holds
the length on a logarithmic scale, how the quartiles of the counts lie to one another, and two bits per
bucket: its count's quartile. A bounded difference of two digests, from 0 to ``BOUND``, gives a
likeness from 1 down to 0. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm._shared import numbered, table, text_batches

#: Offsets of the bytes of a triplet; its number is part of the hash.
TRIPLETS = ((0, 3, 7), (0, 2, 5), (0, 4, 9))
#: Buckets (2 to the power 9), and the factor of the multiplicative hash of 32 bits.
BUCKETS, SHIFT, FACTOR = 512, 23, 2654435761
#: Steps of the length per doubling; its largest difference that counts; weights of a step of the length and of a quartile ratio.
STEPS, LENGTH_CAP, LENGTH_WEIGHT, RATIO_WEIGHT = 8, 24, 4, 2
#: The difference from which a likeness is 0. Quartiles 0 and 3 differ by FAR.
FAR, BOUND = 6, 2 * BUCKETS
#: Bytes and texts that are counted together.
TOGETHER_BYTES, TOGETHER = 1 << 20, 512
#: Bytes of text that a part of the sorted table holds, about; and parts at most. Each part's first key is known to all tasks.
PART_BYTES, PARTS = 32 << 20, 65_536
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _hashes(data: np.ndarray, number: int) -> np.ndarray:
    """The buckets of the triplets of one kind, by the place of their first byte; ``data`` is 32 bits wide."""
    i, j, k = TRIPLETS[number]
    m = max(0, len(data) - k)
    v = data[i : i + m] | data[j : j + m] << np.uint32(8) | data[k : k + m] << np.uint32(16) | np.uint32(number << 24)
    return v * np.uint32(FACTOR) >> np.uint32(SHIFT)


def _counted(texts: list[bytes]) -> np.ndarray:
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    found = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    for number, (_, _, k) in enumerate(TRIPLETS):
        h = _hashes(data, number)
        inside = owner[: len(h)] == owner[k : k + len(h)]
        found += np.bincount((owner[: len(h)] * BUCKETS + h)[inside], minlength=len(found))
    return found.reshape(len(texts), BUCKETS)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """The counts of each text's buckets, a row per text. Many short texts, or a piece of a long one, are counted at once."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        if size > TOGETHER_BYTES:
            whole = np.frombuffer(texts[start], dtype=np.uint8)
            for at in range(0, size, TOGETHER_BYTES):
                for number, (_, _, k) in enumerate(TRIPLETS):  # a triplet belongs to the piece that its first byte lies in
                    out[start] += np.bincount(_hashes(whole[at : at + TOGETHER_BYTES + k].astype(np.uint32), number), minlength=BUCKETS)
        else:
            while end < len(texts) and end - start < TOGETHER and size + len(texts[end]) <= TOGETHER_BYTES:
                size += len(texts[end])
                end += 1
            out[start:end] = _counted(texts[start:end])
        start = end
    return out


def pack(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Digests as rows of bytes: length, ratios of the quartiles, then four buckets a byte, the first in the low bits."""
    q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = sum((counts > q[:, [i]]).astype(np.uint8) for i in range(3)).reshape(len(counts), -1, 4)
    body = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    ratios = 15 * q[:, :2] // np.maximum(q[:, [2]], 1)
    length = np.where(lengths > 0, 1 + np.floor(STEPS * np.log2(np.maximum(lengths, 1))), 0)
    return np.column_stack([length, ratios[:, 0] * 16 + ratios[:, 1], body]).astype(np.uint8)


def digests(texts: list[bytes]) -> np.ndarray:
    return pack(bucket_counts(texts), np.array([len(x) for x in texts], dtype=np.int64)) if texts else np.empty((0, 2 + BUCKETS // 4), dtype=np.uint8)


_PAIRS = np.array([[sum(FAR if (d := abs((x >> s & 3) - (y >> s & 3))) == 3 else d for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], dtype=np.int32)


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - difference / BOUND of digests row by row, 0 where the difference is larger."""
    x, y = a.astype(np.int32), b.astype(np.int32)
    body = _PAIRS[x[:, 2:], y[:, 2:]].sum(axis=1)
    ratios = np.abs((x[:, 1] >> 4) - (y[:, 1] >> 4)) + np.abs((x[:, 1] & 15) - (y[:, 1] & 15))
    length = np.minimum(np.abs(x[:, 0] - y[:, 0]), LENGTH_CAP)
    return 1 - np.minimum(body + RATIO_WEIGHT * ratios + LENGTH_WEIGHT * length, BOUND) / BOUND


def _hex(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows]


def fingerprint(text: Column) -> Column:
    """The digest of each text in hexadecimal digits; a null text counts as empty. An empty text's digest is all zeros."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(_hex(digests([x.encode() for x in texts])), dtype=object)

    return found(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """The likeness, 0 to 1, of two columns of digests; null if either is null."""

    @F.pandas_udf("double")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out = pd.Series(np.full(len(x), np.nan), dtype=object).where(both, None)
        if both.any():
            rows = lambda s: np.array([np.frombuffer(bytes.fromhex(v), dtype=np.uint8) for v in s[both]])
            out[both] = likenesses(rows(x), rows(y))
        return out

    return found(a, b)


def edited(text: str, following: str) -> str:
    """``text`` whose last half, in code points, is replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _places(bounds: list[tuple]):
    """A column function from keys to the parts that a row goes to, as (part, edge); an edge is a copy for the row before it."""

    @F.pandas_udf("array<struct<part:int,edge:boolean>>")
    def found(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        seen: Counter = Counter()
        for known, doc_id, a, b in batches:
            out = []
            for key in zip(known.tolist(), doc_id.tolist(), a.tolist(), b.tolist(), strict=True):
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                if low == high:
                    out.append([(high - 1, False)])
                    continue
                # equal rows that fill several parts are dealt to them from the last to the first; each task's first one is the edge as well
                copy = seen[key]
                seen[key] += 1
                out.append([(high - 1 - copy % (high - low), False)] + [((low - 1) % len(bounds), True)] * (copy == 0))
            yield pd.Series(out, dtype=object)

    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, edge, doc_id, text) to result rows; a row is held until the next one is there."""
    held: tuple | None = None  # (part, doc_id, text, digest) that waits for its next row

    def results(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
        new = [edited(x[2], y[2]).encode() for x, y in pairs]
        made = digests(new)
        own, following = np.array([x[3] for x, _ in pairs]), np.array([y[3] for _, y in pairs])
        columns = [
            pa.array([x[1] for x, _ in pairs], pa.int64()),
            pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
            pa.array(_hex(own), pa.string()),
            pa.array(_hex(made), pa.string()),
            pa.array(likenesses(own, made), pa.float64()),
            pa.array(likenesses(own, following), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROW.split(", ")])

    for batch in batches:
        texts = batch.column("text").to_pylist()
        marks = digests([x.encode() for x in texts])
        pairs = []
        for part, edge, doc_id, text, mark in zip(batch.column("part").to_pylist(), batch.column("edge").to_pylist(), batch.column("doc_id").to_pylist(), texts, marks, strict=True):
            row = (part, doc_id, text, mark)
            if held:
                # without an edge a part holds copies of one row, and the next of the last one is equal to it
                pairs.append((held, row if held[0] == part else held))
            held = None if edge else row
        if pairs:
            yield results(pairs)
    if held:
        yield results([(held, held)])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and to the next document.

    Documents are in ascending order of ``doc_id``, nulls first, rows of one id by a hash of their texts; the next of
    the last is the first. The order is cut into parts at keys that are found from keys alone. Texts are
    shuffled once, to their parts, and each task streams its sorted texts past a window of two; the first row
    of a part is also sent to the part before it. Equal rows that fill several parts are dealt among them. A
    null text is empty, repeated rows stay repeated, other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"), "doc_id", "text")
    keys = ["known", "key", "a", "b"]
    placed = numbered(rows.select(*keys, F.octet_length("text").alias("size")), F.struct(*keys), "place")
    n, size = placed.agg(F.count("*"), F.sum("size")).first()
    step = max(1, -(-n // max(1, min(PARTS, (size or 0) // PART_BYTES))))
    bounds = [tuple(r) for r in placed.where(F.col("place") % step == 0).orderBy("place").select(*keys).collect()]
    dealt = rows.select(*keys, "doc_id", "text", F.explode(_places(bounds)(*keys)).alias("at")).select("at.part", "at.edge", *keys, "doc_id", "text")
    tasks = max(1, min(len(bounds), 1 << 15))
    lined = dealt.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "edge", *keys).select("part", "edge", "doc_id", "text")
    return lined.mapInArrow(_compare, _ROW)


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def _sql_digest(name: str, source: str) -> str:
    triplets = " UNION ALL ".join(f"SELECT id, (b[p + {i}] + 256 * b[p + {j}] + 65536 * b[p + {k}] + {number << 24}) * {FACTOR} % 4294967296 // {1 << SHIFT} AS bucket FROM (SELECT id, b, unnest(range(1, len(b) - {k} + 1)) AS p FROM {name}_b)" for number, (i, j, k) in enumerate(TRIPLETS))
    return f"""
  {name}_b AS (SELECT id, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM {source}),
  {name}_n AS (SELECT id, bucket, count(*) AS n FROM ({triplets}) GROUP BY 1, 2),
  {name}_c AS (SELECT i.id, k.bucket, coalesce(n, 0) AS n FROM {source} i CROSS JOIN (SELECT unnest(range({BUCKETS})) AS bucket) k LEFT JOIN {name}_n USING (id, bucket)),
  {name}_q AS (SELECT id, list_sort(list(n)) AS s FROM {name}_c GROUP BY 1),
  {name} AS (SELECT c.id, list((c.n > s[{BUCKETS // 4}])::INT + (c.n > s[{BUCKETS // 2}])::INT + (c.n > s[{3 * BUCKETS // 4}])::INT ORDER BY c.bucket) AS codes,
    any_value(CASE WHEN len(b) > 0 THEN 1 + CAST(floor({STEPS} * log2(len(b))) AS BIGINT) ELSE 0 END) AS size,
    any_value(15 * s[{BUCKETS // 4}] // greatest(s[{3 * BUCKETS // 4}], 1)) AS r1, any_value(15 * s[{BUCKETS // 2}] // greatest(s[{3 * BUCKETS // 4}], 1)) AS r2
    FROM {name}_c c JOIN {name}_q USING (id) JOIN {name}_b USING (id) GROUP BY c.id)"""


def _sql_hex(x: str) -> str:
    return f"lower(printf('%02x', {x}.size) || printf('%02x', 16 * {x}.r1 + {x}.r2) || array_to_string(list_transform(range({BUCKETS // 4}), lambda i: printf('%02x', {x}.codes[4 * i + 1] + 4 * {x}.codes[4 * i + 2] + 16 * {x}.codes[4 * i + 3] + 64 * {x}.codes[4 * i + 4])), ''))"


def _sql_like(x: str, y: str) -> str:
    body = f"list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: CASE abs({x}.codes[i] - {y}.codes[i]) WHEN 3 THEN {FAR} ELSE abs({x}.codes[i] - {y}.codes[i]) END))"
    return f"1 - least({body} + {RATIO_WEIGHT} * (abs({x}.r1 - {y}.r1) + abs({x}.r2 - {y}.r2)) + {LENGTH_WEIGHT} * least(abs({x}.size - {y}.size), {LENGTH_CAP}), {BOUND}) / {BOUND}.0::DOUBLE"


#: The same over ``documents`` with unique ids, for DuckDB.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents),
  e AS (SELECT d.id, substring(d.t, 1, length(d.t) - length(d.t) // 2) || substring(x.t, 1, length(d.t) // 2) AS t FROM d JOIN d x ON x.id = d.next_id),
  {_sql_digest("own", "d")}, {_sql_digest("made", "e")}
SELECT d.id AS doc_id, length(d.t) AS n_chars, sha256(e.t) AS edited_sha256, {_sql_hex("own")} AS fingerprint, {_sql_hex("made")} AS edited_fingerprint,
  {_sql_like("own", "made")} AS near_edited, {_sql_like("own", "following")} AS near_next
FROM d JOIN e USING (id) JOIN own USING (id) JOIN made USING (id) JOIN own following ON following.id = d.next_id"""
