"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards, sends a random number of rows from each
block to each shard. These counts follow a multivariate hypergeometric law, and given the counts, which
rows go where is uniform. So: rows fall into blocks by hash, the matrix of block-to-shard counts is
drawn, each block is permuted locally and cut by its row of the matrix, rows are exchanged, and each
shard is permuted again. Everything is DataFrame and SQL functions; the randomness is a seeded hash of
the row's key, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import ranked, stored, table

#: Blocks of the communication matrix; the matrix has BLOCKS rows and one column per shard.
BLOCKS = 64
#: Rows that one window sorts; blocks and shards above it are ranked in parts.
PART_ROWS = 200_000

#: ln(x!) as SQL: a table up to 15, Stirling's series beyond (its error there is below 1e-9).
_LN_FACTORIALS = "array(" + ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(16)) + ")"


def _ln_factorial(x: str) -> str:
    return f"if({x} < 16, {_LN_FACTORIALS}[cast({x} as int)], ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}))"


def _draw(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion: ``draws`` rows taken from ``good + bad``, how many are good.

    The search covers twelve standard deviations round the mean; less than 1e-30 lies beyond.
    """
    ln_weight = "0D" + "".join(f" - ({_ln_factorial(x)})" for x in ("k", "(c.good - k)", "(c.draws - k)", "(c.bad - c.draws + k)"))
    return f"""
      transform(array(named_struct('good', {good}, 'bad', {bad}, 'draws', {draws}, 'u', {u})), c ->
      transform(array(named_struct('c', c, 'mean', c.draws * c.good / greatest(1D, 1D * (c.good + c.bad)),
          'sd', sqrt(c.draws * (c.good / greatest(1D, 1D * (c.good + c.bad))) * (c.bad / greatest(1D, 1D * (c.good + c.bad)))))), m ->
      transform(array(named_struct('ks', sequence(
          greatest(0L, m.c.draws - m.c.bad, cast(floor(m.mean - 12 * m.sd - 12) as bigint)),
          least(m.c.draws, m.c.good, cast(ceil(m.mean + 12 * m.sd + 12) as bigint))))), s ->
      transform(array(transform(s.ks, k -> {ln_weight})), logs ->
      transform(array(transform(logs, x -> exp(x - array_max(logs)))), ws ->
          s.ks[least(size(ws) - 1, aggregate(ws, named_struct('i', 0, 'left', c.u * aggregate(ws, 0D, (a, x) -> a + x)),
              (a, x) -> if(a.left < 0D, a, named_struct('i', a.i + if(a.left - x < 0D, 0, 1), 'left', a.left - x)), a -> a.i))]
      )[0])[0])[0])[0])[0]"""


def communication_matrix(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, ends): for each block the cumulated counts of rows that go to shards 0, 1, ...

    ``blocks`` is (block, n). Columns sum to the shards' sizes, which differ by one at most; rows sum to
    the blocks' sizes. Cells are drawn one after another from what is left of both.
    """
    one = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    caps = f"transform(sequence(0, {n_shards - 1}), s -> cast(floor(total / {n_shards}) as bigint) + if(s < total % {n_shards}, 1L, 0L))"
    u = f"shiftrightunsigned(xxhash64({seed}, b.block, s), 11) / 9007199254740992D"
    row = f"""aggregate(sequence(0, {n_shards - 1}), named_struct('left', st.left, 'draws', b.n, 'got', cast(array() as array<bigint>)),
        (t, s) -> transform(array({_draw("t.left[s]", f"aggregate(slice(t.left, s + 2, {n_shards}), 0L, (a, x) -> a + x)", "t.draws", u)}), x ->
            named_struct('left', transform(t.left, (y, i) -> if(i = s, y - x, y)), 'draws', t.draws - x, 'got', concat(t.got, array(x))))[0])"""
    folded = f"""aggregate(blocks, named_struct('left', {caps}, 'rows', cast(array() as array<struct<block:int,got:array<bigint>>>)),
        (st, b) -> transform(array({row}), r -> named_struct('left', r.left, 'rows', concat(st.rows, array(named_struct('block', b.block, 'got', r.got)))))[0], st -> st.rows)"""
    ends = "transform(got, (x, i) -> aggregate(slice(got, 1, i + 1), 0L, (a, y) -> a + y))"
    return one.select(F.explode(F.expr(folded)).alias("r")).select("r.block", "r.got").select("block", F.expr(ends).alias("ends"))


def shard_rows(df: DataFrame, key: list[str], n_shards: int = 8, seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard): a uniform shuffle.

    ``key`` names columns that tell rows apart; rows equal in them are interchangeable. Shard sizes
    differ by one at most, shards with smaller numbers are larger. Nulls in a key are values like any
    other. Columns of any name pass through; ``shard`` and ``slot`` are replaced if present. An empty
    table stays empty. The same rows, key and seed give the same result however they are partitioned.
    """
    n = df.count()
    base = df.drop("shard", "slot").withColumn("_key", F.xxhash64(F.lit(seed), *[F.col(x) for x in key], *[F.col(x).isNull() for x in key]))
    base = base.withColumn("_block", F.pmod("_key", F.lit(BLOCKS)).cast("int"))
    matrix = stored(communication_matrix(base.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")), n_shards, seed).withColumnRenamed("block", "_block"), "shard-matrix")
    local = ranked(base, ["_block"], F.xxhash64(F.lit(seed + 1), "_key"), max(1, math.ceil(n / BLOCKS / PART_ROWS)), "_at", ties=key)
    sent = local.join(F.broadcast(matrix), "_block").withColumn("shard", F.size(F.filter("ends", lambda x: x <= F.col("_at"))).cast("int")).drop("_block", "_at", "ends")
    return ranked(sent, ["shard"], F.xxhash64(F.lit(seed + 2), "_key"), max(1, math.ceil(n / n_shards / PART_ROWS)), "slot", ties=key).drop("_key")


def op10_shards(spark, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "shard-docs")
    dealt = shard_rows(docs, ["doc_id", "size", "text_crc32"], 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
