"""Spelling variants: words one edit apart, found without pairing them.

The words that differ from a word in one code point at a position are its group by (position, prefix, suffix), a
word with a hole. A group keeps its size and its top two words, so each member knows how many others there
are and the best one that isn't itself. Words that have one code point less are found by joining deletions
with the vocabulary. All sides are combined per word; pairs of a group are never made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm._shared import CRC_TABLE_SQL, crc32_sql, numbered, stored, table, text_batches

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Code points and occurrences that a word has at least; how many times as frequent as a word its form is at least.
LENGTH, LEAST, TIMES = 6, 5, 5
#: A run whose hash this number divides loses a code point.
DAMAGE = 199
#: Words whose edits are emitted together, in code points.
TOGETHER = 1 << 16
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def damaged(start: int, run: str) -> str:
    """A lower-cased run without one code point if ``DAMAGE`` divides its hash; ``start`` is the crc32 of what precedes it."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # equal runs of a document have equal hashes
            for run, n in Counter(RUN.findall(text.translate(_LOWER) if text else "")).items():
                if len(run) >= LENGTH:
                    word = damaged(start, run)
                    if len(word) >= LENGTH:
                        found[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``LENGTH`` code points that occur at least ``LEAST`` times in the whole texts.

    Runs of Latin letters are lower-cased in A-Z only; now and then, as their hash with the doc_id says, one
    loses a code point. A null doc_id is empty in that hash, a null text has no words. Words are counted
    per batch, then per task, then shuffled.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _mixed(places: np.ndarray, points: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each (place, code point): the finaliser of the public splitmix64 generator."""
    x = (places.astype(np.uint64) << np.uint64(21) | points.astype(np.uint64)) + np.uint64(seed)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _edits(words: list[str], ranks: list[int]) -> dict[str, np.ndarray]:
    """For each word its own key, that of each hole and that of each deletion, with the word's rank.

    A key is the sum over places of mixed (place, code point), 64 bits from each of two seeds: a hole leaves a place out,
    a deletion moves the later ones. So a word of n code points gives 2 n + 1 keys in time n.
    """
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    first = np.repeat(ends - lengths, lengths)
    at = np.arange(len(points)) - first
    rank = np.array(ranks, dtype=np.int64)
    # deleting any of a row of equal code points gives the same word, so only the first one's counts
    fresh = (at == 0) | (points != np.concatenate([points[:1], points[:-1]]))
    out = {"kind": np.repeat(np.arange(3, dtype=np.int32), [len(words), len(points), fresh.sum()])}
    out["place"] = np.concatenate([np.zeros(len(words)), at, np.zeros(fresh.sum())]).astype(np.int32)
    out["rank"] = np.concatenate([rank, rank[owner], rank[owner][fresh]])
    out["size"] = np.concatenate([lengths, lengths[owner], lengths[owner][fresh] - 1]).astype(np.int32)
    for name, seed in zip("ab", _SEEDS, strict=True):
        here, moved = _mixed(at, points, seed), _mixed(np.maximum(at - 1, 0), points, seed)
        # sums from the beginning of the batch; differences wrap round as the sums do
        before, behind = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (here, moved))
        whole = before[ends] - before[ends - lengths]
        kept = before[:-1] - before[first] + behind[np.repeat(ends, lengths)] - behind[1:]
        out[name] = np.concatenate([whole, whole[owner] - here, kept[fresh]]).view(np.int64)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {"kind": pa.int32(), "size": pa.int32(), "place": pa.int32(), "a": pa.int64(), "b": pa.int64(), "rank": pa.int64()}
    for batch in batches:
        words, ranks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(words):
            end, size = start + 1, len(words[start])
            while end < len(words) and size + len(words[end]) <= TOGETHER:
                size += len(words[end])
                end += 1
            found = _edits(words[start:end], ranks[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(found[x], kind) for x, kind in names.items()], names=list(names))
            start = end


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words.

    Words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. ``form``
    is the near word of largest n, equal ones by code points, if that n is at least ``times`` the word's own (which
    is 2 at least, so that forms lead to no circle), else null; ``root`` is where forms lead in the end.

    Words are ranked by falling n, then code points, so the best of a group is its smallest rank, and all that is
    shuffled are keys of 128 bits and ranks: words are told apart by these keys. A group by position, prefix and suffix
    holds as many words as there are letters, at most. Empty vocabularies give no rows; a null word is dropped.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    # code points and UTF-8 bytes sort alike
    ranked = numbered(words.select("word", "n").where("word IS NOT NULL"), F.struct(-F.col("n"), "word"), "rank")
    edits = stored(ranked.select("word", "rank").mapInArrow(_keys, "kind int, size int, place int, a long, b long, rank long"), "spelling-edits")
    key = ["size", "a", "b"]
    # a group's size and top two; the best word is offered to the others, the second to the best
    groups = edits.where("kind = 1").groupBy("place", *key).agg(F.array_sort(F.collect_list("rank")).alias("ranks")).where(F.size("ranks") > 1)
    offers = F.transform("ranks", lambda x: F.struct(x.alias("rank"), (F.size("ranks") - 1).cast("long").alias("n_near"), F.when(x == F.col("ranks")[0], F.col("ranks")[1]).otherwise(F.col("ranks")[0]).alias("best")))
    replaced = groups.select(F.inline(offers))
    own = edits.where("kind = 0").select(*key, F.col("rank").alias("shorter"))
    shortened = edits.where("kind = 2").join(own, key).select("rank", "shorter")
    deleted = shortened.select("rank", F.lit(1).cast("long").alias("n_near"), F.col("shorter").alias("best"))
    inserted = shortened.select(F.col("shorter").alias("rank"), F.lit(1).cast("long").alias("n_near"), F.col("rank").alias("best"))
    near = replaced.union(deleted).union(inserted).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    formed = ranked.join(near, "rank", "left").join(best, "best", "left").withColumn("takes", F.coalesce(F.col("n") <= F.expr(f"form_n div {int(times)}"), F.lit(False)))
    taken = lambda x: F.when(F.col("takes"), F.col(x))
    formed = stored(formed.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), taken("form").alias("form"), taken("form_n").alias("form_n"), taken("best").alias("next")), "spelling-forms")
    roots = ranked.select(F.col("rank").alias("root_rank"), F.col("word").alias("root"))
    found = formed.join(followed(formed), "rank", "left").withColumn("root_rank", F.coalesce("root_rank", "rank")).join(roots, "root_rank")
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """(rank, root_rank): where ``next`` leads in the end, for rows that have one.

    Every round doubles the steps taken. As n grows by a factor along forms, there are a handful of rounds.
    """
    ways = stored(links.where("next IS NOT NULL").select("rank", F.col("next").alias("root_rank")), "spelling-ways")
    while True:
        on = ways.select(F.col("rank").alias("root_rank"), F.col("root_rank").alias("further"))
        step = stored(ways.join(on, "root_rank", "left").select("rank", F.coalesce("further", "root_rank").alias("root_rank"), F.col("further").isNotNull().alias("moved")), "spelling-ways")
        ways = step.select("rank", "root_rank")
        if step.where("moved").isEmpty():
            return ways


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: The same over ``documents``, for DuckDB: deletions of both words meet for replacements and indels.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
  runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
  hashed AS (SELECT r, n, {crc32_sql("encode(coalesce(doc_id::VARCHAR, '') || ':' || r)")} AS h FROM runs, crc_table WHERE length(r) >= {LENGTH}),
  kept AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
  v AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {LEAST}),
  cut AS (SELECT word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
  near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.rest = y.word UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.rest = y.word),
  best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
  formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
  ways AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word AND w.next IS NULL"""
