"""Export of workspaces as JSON documents, written in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.operators.stored import stored

#: Rows of a table that a part holds, about.
PART_ROWS = 10_000


def export_parts(workspaces: DataFrame, tables: dict[str, DataFrame], key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, section, name, part, rows, fragment): each workspace's document in parts, however many rows it has.

    Section 0 is the workspace itself, the others are its tables in the order given. A table's rows are dealt by a hash into as many parts as its size asks for, and each part is
    grouped by itself, so the rows of one large workspace are many tasks' work. A fragment holds its rows as JSON, sorted, joined by commas; see :func:`document` for
    how they're put together. Each table is grouped by itself, so no join multiplies rows; rows of workspaces that there aren't are left out.
    """
    own = workspaces.select(F.col(key), F.to_json(F.struct(*workspaces.columns)).alias("fragment"))
    out = own.select(key, F.lit(0).alias("section"), F.lit("workspace").alias("name"), F.lit(0).alias("part"), F.lit(1).cast("long").alias("rows"), "fragment")
    for section, (name, rows) in enumerate(tables.items(), 1):
        sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
        asked = stored(workspaces.select(key).distinct().join(sizes, key, "left").withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.coalesce("_n", F.lit(0)) / part_rows)).cast("int")), "export-sizes")
        row = rows.select(F.col(key), F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("_row"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).alias("_at"))
        dealt = row.join(asked.select(key, "_parts"), key).withColumn("part", (F.col("_at") % F.col("_parts")).cast("int"))
        made = dealt.groupBy(key, "part").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list("_row")), ",").alias("fragment"))
        all_parts = asked.select(key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
        found = all_parts.join(made, [key, "part"], "left").select(key, F.lit(section).alias("section"), F.lit(name).alias("name"), "part", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fragment", F.lit("")).alias("fragment"))
        out = out.unionByName(found)
    return out


def manifest(parts: DataFrame, key: str) -> DataFrame:
    """(key, names, parts, rows, digest): what a workspace's document consists of; a reader checks it before it puts fragments together."""
    named = parts.groupBy(key, "section", "name").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.bit_xor(F.xxhash64("part", "fragment")).alias("digest"))
    return named.select(key, "section", "name", "parts", "rows", "digest")


def document(fragments: list[tuple[int, str, int, str]]) -> str:
    """One workspace's document from its parts (section, name, part, fragment), in any order."""
    out, last = "{", None
    for section, name, _, fragment in sorted(fragments):
        if section == 0:
            out += f'"{name}":{fragment}'
        elif section != last:
            out += ("]" if last else "") + f',"{name}":[{fragment}'
        elif fragment:
            out += ("" if out.endswith("[") else ",") + fragment
        last = section
    return out + ("]}" if last else "}")
