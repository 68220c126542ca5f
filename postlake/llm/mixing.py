"""Mixing sources to target weights by entropy balancing.

Document rates stay as close as possible to 1 in relative entropy while each source's rated words meet
its target and no rate exceeds a cap. The dual is convex with one multiplier per source, and the optimal rates are
exponentially tilted by document size: rate(t) = min(cap, e^(lambda * t / scale)). Safeguarded Newton iterations solve the
dual on the table of (source, size) counts, which is exact because a rate depends on nothing else, and far smaller than the
documents. Rates are then rounded into whole copies, largest documents first, each passing its
rounding error on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm._shared import checkpointed, numbered, ranked, stored, table

#: Weights of sources in code point order, repeating; how often a document is taken at most.
WEIGHTS, CAP = (5, 2, 1), 3
#: The dual is solved when each source's words are within this share of its target.
CLOSE, ROUNDS = 1e-9, 200
#: Documents of one source and size that one task ranks.
PART_ROWS = 500
_WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size), one row per source.

    Targets share all words by weight and stop at ``cap`` times the source's size; the excess is shared
    again by weight. That is target = min(cap * size, level * weight) with one level for all, which rises from
    the plain share as sources stop, until none is above.
    """
    given = numbered(sizes, F.col("source").asc_nulls_last(), "at")
    given = given.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    given = stored(given.withColumn("most", F.lit(float(cap)) * F.col("source_size")), "mix-weights")
    words, level, now = given.agg(F.sum("source_size")).first()[0], -1.0, 0.0
    while now > level:
        level = now
        stops = F.col("most") < level * F.col("weight")
        held, free = given.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("weight")))).first()
        now = (words - (held or 0.0)) / free if free else level
    return given.select("skey", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def rates(cells: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """``cells`` (skey, size, n) with ``rate``: the solution of the dual, by Newton steps kept within a bracket.

    Sources whose target is 0 or cap times their size get the limits 0 and cap at once.
    """
    mean = cells.groupBy("skey").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    room = F.col("target") / F.col("source_size")
    at_edge = F.coalesce(room >= cap * (1 - 1e-12), F.lit(True)) | (room <= 0)
    start = F.when(at_edge, F.lit(0.0)).otherwise(F.log(room))
    state = wanted.join(mean, "skey").select("skey", "target", "scale", room.alias("room"), at_edge.alias("done"), start.alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state = checkpointed(state)
    cells = checkpointed(cells)
    z = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("lam") * F.col("size") / F.col("scale")))
    rate = F.least(F.lit(float(cap)), F.exp(z))
    for _ in range(ROUNDS):
        if state.where(~F.col("done")).isEmpty():
            break
        words = F.col("n") * F.col("size")
        sums = cells.join(state.where(~F.col("done")).select("skey", "lam", "scale"), "skey").withColumn("rate", rate)
        sums = sums.groupBy("skey").agg(F.sum(words * F.col("rate")).alias("got"), F.sum(F.when(F.col("rate") < cap, words * F.col("size") / F.col("scale") * F.col("rate")).otherwise(0.0)).alias("slope"))
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        reach = 2 * F.abs("lam") + 2  # a step beyond all that was seen goes no further
        newton = F.col("lam") - F.greatest(-reach, F.least(reach, F.coalesce(F.try_divide(off, "slope"), F.when(off > 0, reach).otherwise(-reach))))
        step = F.when(F.col("l").isNotNull() & F.col("h").isNotNull() & ((F.col("newton") <= F.col("l")) | (F.col("newton") >= F.col("h"))), (F.col("l") + F.col("h")) / 2).otherwise(F.col("newton"))
        moved = (
            state.join(sums, "skey", "left")
            .withColumns({"l": low, "h": high, "newton": newton, "fits": F.col("done") | (F.abs(off) <= CLOSE * F.col("target") + 1e-6)})
            .withColumn("stuck", F.coalesce(F.col("h") - F.col("l") <= 1e-13 * F.greatest(F.abs("h"), F.abs("l")), F.lit(False)))
            .select("skey", "target", "scale", "room", (F.col("fits") | F.col("stuck")).alias("done"), F.when(F.col("fits"), F.col("lam")).otherwise(step).alias("lam"), F.col("l").alias("low"), F.col("h").alias("high"))
        )
        state = checkpointed(moved)
    at_limit = F.when(F.coalesce(F.col("room") >= cap * (1 - 1e-12), F.lit(False)), F.lit(float(cap))).when(F.col("room") <= 0, F.lit(0.0))
    return cells.join(state.select("skey", "lam", "scale", "room"), "skey", "left").select("skey", "size", "n", F.coalesce(at_limit, F.when(F.col("room").isNotNull(), rate), F.lit(1.0)).alias("rate"))


def _round(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        copies, owed = np.zeros(len(pdf), np.int64), 0.0
        for i, (size, n, rate) in enumerate(zip(pdf["size"], pdf["n"], pdf["rate"])):
            if size:
                owed += n * size * rate
                copies[i] = min(cap * n, max(0, math.floor(owed / size + 0.5)))
                owed -= copies[i] * size
            else:
                copies[i] = n
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "n": pdf["n"], "copies": copies})

    return run


def _row_key(doc_id: str, source: str, text: str) -> Column:
    """128 bits of a row's id, source and text, nulls apart from all values."""
    return F.unhex(F.md5(F.to_json(F.struct(F.col(doc_id).alias("d"), F.col(source).alias("s"), F.md5(F.col(text).cast("binary")).alias("t"))).cast("binary")))


def _mixed(docs: DataFrame, doc_id: str, source: str, text: str, weights: tuple[int, ...], cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with equal row_key as one, with their number ``m``, and what a cell (skey, size) takes: its ``n`` rows share ``copies``, those with ``_at`` below the remainder one more; and the targets."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"), _row_key(doc_id, source, text).alias("row_key")
    )
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
    rows = stored(rows.groupBy("row_key", "skey", "size", "doc_id", "source").agg(F.count("*").alias("m")), "mix-rows")
    cells = stored(rows.groupBy("skey", "size").agg(F.sum("m").alias("n"), F.first("source").alias("source")), "mix-cells")
    wanted = stored(targets(cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size")), weights, cap), "mix-targets")
    rounded = stored(rates(cells.select("skey", "size", "n"), wanted, cap).groupBy("skey").applyInPandas(_round(cap), "skey string, size long, n long, copies long"), "mix-copies")
    keyed = rows.join(rounded, ["skey", "size"]).withColumn("_key", F.xxhash64(F.lit(seed), "row_key"))
    return ranked(keyed, ["skey", "size"], F.xxhash64(F.lit(seed + 1), "_key"), F.ceil(F.col("n") / PART_ROWS), "_at", "m", ties=["row_key"]), wanted


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, row_key, size, source_size, target, copies (0 to ``cap``) and taken = copies * size.

    Size is the number of words, 0 for null and empty texts; documents without words keep one copy
    and take nothing. Documents with a null source are one source, the last in order. Within a source,
    documents of one size get copies that differ by one at most, the more by a seeded hash of doc_id, source and
    text, so reruns agree; repeated rows count each. ``row_key`` stands for doc_id, source and text. Other
    columns are not read. The table of (source, size) counts grows with the number of sources and the
    longest text, not with the documents; rounding takes the counts of one source into a task.
    """
    dealt, wanted = _mixed(docs, doc_id, source, text, weights, cap, seed)
    rows = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("_at") + F.col("_i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return (
        rows.join(wanted, "skey")
        .select("doc_id", "row_key", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("int").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def take_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it.

    Rows that repeat doc_id, source and text share the copies that they get together, in an order by a
    seeded hash of all their columns, so rows that differ in others stay apart.
    """
    dealt, _ = _mixed(docs, doc_id, source, text, weights, cap, seed)
    more = F.greatest(F.lit(0), F.least(F.col("m"), F.col("copies") % F.col("n") - F.col("_at")))
    taken = dealt.select(F.col("row_key").alias("_row_key"), (F.col("m") * F.floor(F.col("copies") / F.col("n")) + more).alias("_copies"), F.col("m").alias("_m"))
    taken = stored(taken.where("_copies > 0"), "mix-taken")
    # always a shuffle join: what a size check would broadcast for small tables says nothing about large ones
    rows = docs.withColumn("_row_key", _row_key(doc_id, source, text)).join(taken.where("_m = 1").hint("shuffle_hash"), "_row_key")
    repeated = stored(taken.where("_m > 1"), "mix-repeated")
    alike = docs.withColumn("_row_key", _row_key(doc_id, source, text)).join(repeated, "_row_key").groupBy("_row_key", "_copies", "_m", *docs.columns).agg(F.count("*").alias("_n"))
    alike = alike.withColumn("_key", F.xxhash64(F.lit(seed), *docs.columns))
    alike = ranked(alike, ["_row_key"], F.xxhash64(F.lit(seed + 1), "_key"), F.ceil(F.col("_m") / PART_ROWS), "_at", "_n", ties=docs.columns)
    more = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_copies") % F.col("_m") - F.col("_at")))
    alike = alike.withColumn("_copies", F.col("_n") * F.floor(F.col("_copies") / F.col("_m")) + more).where("_copies > 0")
    both = rows.select(*docs.columns, "_copies").unionByName(alike.select(*docs.columns, "_copies"))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
