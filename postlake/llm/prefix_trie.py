"""Prefix trie of conversations, built compressed.

A prefix is known by its depth and a digest that is cumulative: the exclusive or of hashes of (depth, turn). The
rows of a conversation are numbered and their digests summed up in parts of a global sort, so a conversation of any
length is spread over tasks. Prefix digests are cut into strings of at most ``BLOCK`` turns; equal strings are
one. Strings below one prefix form a block of the trie. All strings are sorted; a string's common prefix with
the one before it is a branch point, its own last turn an end, a leaf or a cut where its block's next begins. Only
these points become rows, with the path of their block and the depth of the point above them. Sums over subtrees are
taken of points, inside blocks and then over the much smaller tree of blocks. At last the unary nodes of each
point's edge are laid out, with suffix sums of the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm._shared import CRC_TABLE_SQL, crc32_sql, stored, table

#: Turns of a string at most, and so of an edge.
BLOCK = 64
#: Conversations that share the first one's beginning, and the modulus that says how many of its turns.
FAMILY, SHARED = 5, 9
_EMPTY = hashlib.sha256().hexdigest()
_NODE = ["depth", "a", "b"]


def _sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted over all tasks and stored, with its ``part`` and the place ``at`` in it."""
    place = F.monotonically_increasing_id()
    return stored(df.orderBy(*order).withColumns({"part": F.shiftright(place, 33).cast("int"), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}), name)


def number_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, pos, n, a, b, size) of all turns, and (conv_id, n) of all conversations.

    ``pos`` counts from 1 by turn, nulls first; rows of one turn go by role, then by a hash of the text; equal rows are
    all counted. ``part`` is the part of the global sort: pos ascends with it. a and b are hashes of role and text, in
    which nulls are empty, size is the text's bytes in UTF-8. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.octet_length(text).cast("long").alias("size"))
    # equal rows can be told apart by nothing else, and so don't fill one task
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b"), F.col("copy")]
    placed = _sorted(rows.withColumn("copy", F.monotonically_increasing_id()), order, "trie-turns").drop("turn", "role", "copy")
    runs = placed.groupBy("part", "conv_id").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    runs = runs.withColumns({"before": F.sum("own").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("own"), "n": F.sum("own").over(Window.partitionBy("conv_id"))})
    runs = stored(runs.drop("own"), "trie-runs")
    rows = placed.join(runs, ["part", "conv_id"]).select("conv_id", "part", (F.col("before") + F.col("at") - F.col("first") + 1).alias("pos"), "n", "a", "b", "size")
    return rows, runs.select("conv_id", "n").distinct()


def with_shared_beginnings(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, depth, length, a, b, size) and (conv_id, length) of conversations that begin as the first of their family.

    A conversation c takes the first h turns of c - c % FAMILY (as many as there are), h = crc32(c in digits) % SHARED,
    and then its own beyond the first h. At most SHARED - 1 rows of a conversation are copied, to FAMILY conversations at most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    ways = convs.select("conv_id", "n", h.alias("h"), base).join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    ways = ways.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    ways = stored(ways.select("conv_id", "base", "h", "taken", "length"), "trie-ways")
    # a part's run of a conversation is one row, so a long conversation meets its way part by part
    runs = stored(turns.select("part", "conv_id").distinct().join(ways, "conv_id"), "trie-run-ways")
    own = turns.join(runs, ["part", "conv_id"]).where("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "length", "a", "b", "size")
    first = turns.where((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "a", "b", "size")
    copied = ways.join(first, "base").where("depth <= h").select("conv_id", F.lit(-1).alias("part"), "depth", "length", "a", "b", "size")
    return own.unionByName(copied), ways.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with a and b as digests of the prefix that ends there, and those of the prefix before as up_a and up_b."""
    rows = turns.withColumns({"fa": F.xxhash64(F.lit(1), "depth", "a"), "fb": F.xxhash64(F.lit(2), "depth", "b")}).drop("a", "b")
    rows = stored(rows, "trie-rows")
    runs = rows.groupBy("conv_id", "part").agg(F.bit_xor("fa").alias("xa"), F.bit_xor("fb").alias("xb"))
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", *[F.coalesce(F.bit_xor(x).over(by_part), F.lit(0)).alias(x) for x in ("xa", "xb")])
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"ia": F.bit_xor("fa").over(inside), "ib": F.bit_xor("fb").over(inside)}).join(runs, ["conv_id", "part"])
    rows = rows.withColumns({"a": F.col("ia").bitwiseXOR(F.col("xa")), "b": F.col("ib").bitwiseXOR(F.col("xb"))})
    return rows.select("conv_id", "depth", "length", "size", "a", "b", F.col("a").bitwiseXOR(F.col("fa")).alias("up_a"), F.col("b").bitwiseXOR(F.col("fb")).alias("up_b"))


def _strings(turns: DataFrame) -> DataFrame:
    """(conv_id, ended, up_a, up_b, path): strings of at most ``BLOCK`` turns, each element (depth, a, b, size)."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    item = F.struct("depth", "a", "b", "size")
    strings = _prefixes(turns).groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("path"), F.min_by(F.struct("up_a", "up_b"), "depth").alias("up"), F.max(F.col("depth") == F.col("length")).alias("ended"))
    return strings.select("conv_id", "ended", "up.up_a", "up.up_b", "path")


def _points(strings: DataFrame) -> DataFrame:
    """(depth, a, b, up_a, up_b, path, above, ends, least): branch points, ends, leaves and cuts.

    ``path`` leads there from the block's root (up_a, up_b), ``above`` is how much of it leads to the point above. ``ends`` counts
    conversations that end here, ``least`` is their smallest id.
    """
    last = F.col("path")[F.size("path") - 1]
    one = strings.groupBy(last.alias("last"), "up_a", "up_b").agg(F.first("path").alias("path"), F.count_if("ended").alias("ends"), F.min(F.when(F.col("ended"), F.col("conv_id"))).alias("least"))
    placed = _sorted(one.drop("last"), [F.col("up_a"), F.col("up_b"), F.col("path")], "trie-strings")
    # the string before the first of a part is the last of the part before
    edge = placed.groupBy("part").agg(F.max_by("path", "at").alias("path")).withColumn("from_part", F.lag("path").over(Window.orderBy("part"))).drop("path")
    before = F.coalesce(F.lag("path").over(Window.partitionBy("part").orderBy("at")), F.col("from_part"))
    # digests are cumulative, so strings share as many of them as they have turns in common at their beginning
    shared = F.coalesce(F.size(F.array_intersect("path", "before")), F.lit(0))
    met = placed.join(edge, "part", "left").withColumn("before", before).withColumn("shared", shared).drop("before", "from_part")
    met = stored(met, "trie-sorted")
    first = met.groupBy("part").agg(F.min_by("shared", "at").alias("shared")).withColumn("from_part", F.lead("shared").over(Window.orderBy("part"))).drop("shared")
    after = F.coalesce(F.lead("shared").over(Window.partitionBy("part").orderBy("at")), F.col("from_part"), F.lit(0))
    met = stored(met.join(first, "part", "left").withColumn("after", after).drop("from_part", "part", "at"), "trie-sorted")
    at = F.explode(F.array_distinct(F.filter(F.array("shared", F.size("path")), lambda x: x > 0))).alias("upto")
    points = met.select(at, "*").select("up_a", "up_b", F.slice("path", F.lit(1), F.col("upto")).alias("path"), F.when(F.col("upto") == F.size("path"), F.col("ends")).otherwise(0).alias("ends"), F.when(F.col("upto") == F.size("path"), F.col("least")).alias("least"))
    points = points.withColumn("end", F.col("path")[F.size("path") - 1]).select("end.depth", "end.a", "end.b", "up_a", "up_b", "path", "ends", "least")
    points = points.groupBy(*_NODE).agg(F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.first("path").alias("path"), F.sum("ends").alias("ends"), F.min("least").alias("least"))
    # the strings below a point lie together; what its first shares with the one before them, and its last with the one behind, leads to the point above
    outer = lambda x: F.transform(F.slice("path", F.col(x) + 1, F.size("path")), lambda y: F.struct(y["depth"].alias("depth"), y["a"].alias("a"), y["b"].alias("b"), F.col(x).alias("above")))
    above = met.select(F.inline(F.concat(outer("shared"), outer("after")))).groupBy(*_NODE).agg(F.max("above").alias("above"))
    return stored(points.join(above, _NODE), "trie-points")


def _parent(points: DataFrame) -> DataFrame:
    """``points`` with the digest of the point above: pd, pa and pb."""
    on = F.when(F.col("above") > 0, F.struct(F.col("path")[F.col("above") - 1]["depth"].alias("pd"), F.col("path")[F.col("above") - 1]["a"].alias("pa"), F.col("path")[F.col("above") - 1]["b"].alias("pb")))
    root = F.struct((F.col("depth") - F.size("path")).alias("pd"), F.col("up_a").alias("pa"), F.col("up_b").alias("pb"))
    return points.withColumn("parent", F.coalesce(on, root)).select("*", "parent.*").drop("parent")


def _block_totals(points: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(a, b, ...): for each block's root the sums of ``sums`` over all points below it, in this block and later ones.

    The tree of blocks is summed by doubling: every round adds the totals of blocks that are 1, 2, 4, ... levels
    further down. Conversations of ``BLOCK`` turns or fewer need no round.
    """
    blocks = points.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*[x.alias(k) for k, x in sums.items()])
    links = points.where(F.size("path") == BLOCK).select("a", "b", F.col("up_a").alias("ja"), F.col("up_b").alias("jb"), (F.col("depth") == BLOCK).alias("top"))
    links = links.select("a", "b", *[F.when(~F.col("top"), F.col(x)).alias(x) for x in ("ja", "jb")])
    blocks = stored(blocks.join(links, ["a", "b"], "left"), "trie-blocks")
    combine = {k: F.min(k) if k.startswith("least") else F.sum(k) for k in sums}
    while not blocks.where("ja IS NOT NULL").isEmpty():
        low = blocks.where("ja IS NOT NULL").groupBy(F.col("ja").alias("a"), F.col("jb").alias("b")).agg(*[x.alias(f"low_{k}") for k, x in combine.items()])
        up = blocks.select(F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("ka"), F.col("jb").alias("kb"))
        both = blocks.join(low, ["a", "b"], "left").join(up, ["ja", "jb"], "left")
        merged = [(F.least(k, f"low_{k}") if k.startswith("least") else F.col(k) + F.coalesce(f"low_{k}", F.lit(0))).alias(k) for k in sums]
        blocks = stored(both.select("a", "b", F.col("ka").alias("ja"), F.col("kb").alias("jb"), *merged), "trie-blocks")
    return blocks.drop("ja", "jb")


def _below(points: DataFrame, sums: dict[str, Column], strictly: bool) -> DataFrame:
    """(depth, a, b, ...): sums over the points of a block that lie at or below a prefix; added up before the shuffle."""
    path = F.slice("path", F.lit(1), F.size("path") - 1) if strictly else F.col("path")
    spread = points.select(F.explode(path).alias("x"), *[F.col(k) for k in sums])
    return spread.groupBy("x.depth", "x.a", "x.b").agg(*[x.alias(k) for k, x in sums.items()])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (depth, a, b, piece) of sorted nodes to (depth, a, b, ends_sha256)."""
    held, state = None, None

    def out(node, state):
        return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "a": pa.array([node[1]], pa.int64()), "b": pa.array([node[2]], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    for batch in batches:
        done = []
        for depth, a, b, piece in zip(*(batch.column(x).to_pylist() for x in (*_NODE, "piece")), strict=True):
            if (depth, a, b) == held:
                state.update(b"," + piece.encode())
                continue
            if held:
                done.append(out(held, state))
            held, state = (depth, a, b), hashlib.sha256(piece.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if held:
        yield out(held, state)


def _ends(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from (depth, a, b, conv_id): the digest of the ids joined by commas, ascending.

    Ids are sorted and joined in parts; only the parts' pieces come together, and are hashed one after another.
    """
    placed = _sorted(members, [F.col(x) for x in (*_NODE, "conv_id")], "trie-ends")
    pieces = placed.groupBy(*_NODE, "part").agg(F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>")).alias("piece"))
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "part").select(*_NODE, "piece").mapInArrow(_hash_ends, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, part, depth, length, a, b, size) and ``convs`` (conv_id, length).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 per
    node. Conversations of no turns belong to the root only. Without conversations there is no node. ``part`` splits long conversations; depth ascends with it.
    """
    strings = stored(_strings(turns), "trie-strings")
    points = _parent(_points(strings))
    children = points.groupBy(F.col("pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    points = stored(points.join(children, _NODE, "left").withColumn("leaf", F.col("n_children").isNull().cast("long")), "trie-points")
    # members and leaves
    totals = _block_totals(points, {"n": F.sum("ends"), "least_id": F.min("least"), "leaves": F.sum("leaf")})
    cut = F.when(F.size("path") == BLOCK, F.struct("a", "b"))
    own = points.withColumn("cut", cut).join(totals.select(F.struct("a", "b").alias("cut"), "n", "least_id", "leaves"), "cut", "left")
    own = own.select("path", (F.col("ends") + F.coalesce("n", F.lit(0))).alias("n"), F.least("least", "least_id").alias("least_id"), (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaves"))
    sums = _below(own, {"n": F.sum("n"), "least_id": F.min("least_id"), "leaves": F.sum("leaves")}, strictly=False)
    points = stored(points.join(sums, _NODE), "trie-points")
    # bytes that each edge saves, and what is saved below a point
    edge = F.aggregate(F.slice("path", F.col("above") + 1, F.size("path")), F.lit(0).cast("long"), lambda x, y: x + y["size"])
    points = points.withColumn("saves", (F.col("n") - 1) * edge)
    totals = _block_totals(points, {"saved": F.sum("saves")})
    points = points.withColumn("cut", cut).join(totals.select(F.struct("a", "b").alias("cut"), "saved"), "cut", "left").withColumn("later", F.coalesce("saved", F.lit(0))).drop("cut", "saved")
    points = stored(points, "trie-points")
    sums = _below(points.withColumn("saved", F.col("saves") + F.col("later")), {"saved": F.sum("saved")}, strictly=True)
    points = points.join(sums, _NODE, "left").withColumn("saved", F.coalesce("saved", F.lit(0)) + F.col("later"))
    over = points.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("least_id").alias("parent_id"))
    points = stored(points.join(over, ["pd", "pa", "pb"], "left"), "trie-points")
    # the root
    all_convs = convs.agg(F.min("conv_id").alias("least_id"), F.count("*").alias("n"))
    tops = points.where("pd = 0").agg(F.count("*").alias("n_children"))
    sums = points.agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"))
    root = all_convs.join(tops).join(sums).where("n > 0").select(F.col("least_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    # unary nodes: what the edge saves from a node on is a suffix sum
    least = all_convs.first()["least_id"]
    parent = F.when(F.col("pd") == 0, F.lit(least)).otherwise(F.col("parent_id"))
    suffix = lambda i: F.aggregate(F.slice("path", i, F.size("path")), F.lit(0).cast("long"), lambda x, y: x + y["size"])
    node = lambda i: F.struct(
        F.col("least_id").alias("conv_id"),
        F.element_at("path", i)["depth"].alias("depth"),
        F.element_at("path", i)["a"].alias("a"),
        F.element_at("path", i)["b"].alias("b"),
        F.when(i == F.col("above") + 1, parent).otherwise(F.col("least_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(i == F.size("path"), F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * suffix(i)).alias("saved_tokens"),
    )
    laid = points.select(F.inline(F.transform(F.sequence(F.col("above") + 1, F.size("path")), node)))
    last = F.col("path")[F.size("path") - 1]
    ended = strings.where("ended").select(last["depth"].alias("depth"), last["a"].alias("a"), last["b"].alias("b"), "conv_id")
    zero = F.lit(0).cast("long")
    ends = _ends(ended.union(convs.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")))
    nodes = laid.unionByName(root).join(ends, _NODE, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, convs = number_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie(*with_shared_beginnings(turns, convs))


#: The same for DuckDB: nodes by the digests of whole prefixes, subtrees by joining each conversation's nodes with those below.
ORACLE_SQL = f"""
WITH {CRC_TABLE_SQL},
  t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("encode(conv_id::VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
  r AS (SELECT c.conv_id, pos, 0 AS own, role, text FROM c JOIN t ON t.conv_id = base WHERE pos <= h UNION ALL SELECT conv_id, pos, 1, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
  d AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
  p AS (SELECT * FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
  steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM p),
  n AS (SELECT node, depth, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
  k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.node) AS n_children FROM n),
  under AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
  sums AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM under JOIN k USING (node) GROUP BY 1)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256 FROM k JOIN sums USING (node) LEFT JOIN n u ON u.node = k.parent"""
