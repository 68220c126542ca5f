"""SimHash near-duplicates, compared in bit slices.

Fingerprints are cut into blocks, and documents whose fingerprints agree in some of them meet in one bucket:
of ``blocks`` blocks, at least ``blocks - radius`` agree for every pair within the radius, so with one key
per choice of that many blocks no link is lost. More blocks mean more but longer keys; the number is
chosen from the number of fingerprints, so that buckets stay small as a corpus grows. Inside a
bucket, fingerprints are stored vertically: plane ``b`` holds bit ``b`` of 64 fingerprints per machine word. A
query's differing bits are added into carry-save counters, one bitwise addition serving 64 distances;
counters start at ``2^k - 1 - radius`` so that a carry out of the top counter means "beyond the radius", and
rows and words whose 64 lanes are all beyond are abandoned.

A bucket returns a star over each set of linked members, never all pairs; the stars are joined by
:func:`connected_components`.

Where a link needs an exact Jaccard similarity, the radius is too wide for keys of fingerprint blocks. Buckets
then come from bands of the set's smallest hashes, fingerprints are compared in them as above, and
the components only gather candidates: their members' sets of shingles are compared, and components are
built anew from the links that hold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm._shared import stored, table, text_batches
from postlake.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles whose bits are counted at a time, so that memory doesn't grow with a text.
AT_A_TIME = 65536
#: Fingerprints of a bucket that one task takes on each side; larger buckets are dealt as pairs of such chunks.
CHUNK = 8192
#: Fingerprints that are compared as one block of planes.
BLOCK = 1024
#: Members of a candidate group whose sets one task takes on each side, and bytes of these sets; larger groups are dealt as pairs of chunks.
SET_CHUNK = 1024
SET_BYTES = 32 << 20
#: Smallest hashes that make a band.
BAND = 6
#: What a row of a bucket costs, in comparisons of two fingerprints.
ROW_COST = 5000


def _hashes(found: list[bytes], words: int, seed: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that begin at ``starts``."""
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), seed) for i in starts.tolist()), np.uint64, len(starts))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; empty without words."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []
    return np.unique(_hashes(found, words, SEED, np.arange(max(1, len(found) - words + 1) if found else 0)))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh64_digest(shingles.astype("<u8").tobytes(), SEED)


def bands_of(shingles: np.ndarray, bands: int) -> list[int]:
    """One key per band of ``BAND`` bins; a bin holds its smallest hash, and an empty one what the next full one holds."""
    bins = bands * BAND
    least = np.full(bins, 2**64 - 1, np.uint64)
    np.minimum.at(least, (shingles % np.uint64(bins)).astype(np.int64), shingles)
    full = np.flatnonzero(least != np.uint64(2**64 - 1))
    if not len(full):
        return [0] * bands
    held = least[full[np.searchsorted(full, np.arange(bins)) % len(full)]].astype("<u8").tobytes()
    return [int.from_bytes(xxhash.xxh64_digest(held[i : i + 8 * BAND], i), "big", signed=True) for i in range(0, len(held), 8 * BAND)]


def fingerprint(text: str | None, words: int, bits: int, bands: int = 0) -> tuple[bytes, list[int]]:
    """The SimHash of a whole text, most significant byte first, and keys of bands; all bits are zero without words.

    With ``bands``, bits are counted over distinct shingles, so that repeats don't weigh, and eight
    bytes that stand for the set of shingles follow them.
    """
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []
    starts = np.arange(max(1, len(found) - words + 1) if found else 0)
    all_of = np.empty(0, np.uint64)
    if bands:
        all_of, starts = np.unique(_hashes(found, words, SEED, starts), return_index=True)
    parts = []
    for seed in range(SEED, SEED + bits // 64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(starts), AT_A_TIME):
            h = all_of[at : at + AT_A_TIME] if bands and seed == SEED else _hashes(found, words, seed, starts[at : at + AT_A_TIME])
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        parts.append(np.packbits(ones * 2 > len(starts)).tobytes())
    return b"".join(parts) + (digest(all_of) if bands else b""), bands_of(all_of, bands) if bands else []


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, bits: int = 64, bands: int = 0) -> DataFrame:
    """``docs`` with ``fp`` (binary), fingerprint and digest, and ``keys`` (array of long); see :func:`fingerprint`."""

    @F.pandas_udf("fp binary, keys array<long>")
    def make(texts: pd.Series) -> pd.DataFrame:
        made = [fingerprint(x, words, bits, bands) for x in texts]
        return pd.DataFrame({"fp": [x for x, _ in made], "keys": [x for _, x in made]})

    text_batches(docs.sparkSession)
    return docs.withColumn("_made", make(F.col(text))).withColumns({"fp": F.col("_made.fp"), "keys": F.col("_made.keys")}).drop("_made")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, bits/64) as words: (bits, ceil(n/64)); lanes past n are zero."""
    n, bits = len(fps), fps.shape[1] * 64
    lanes = -(-n // 64) * 64
    at = np.zeros((bits, lanes), np.uint8)
    at[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    return np.packbits(at, axis=1, bitorder="little").view(np.uint64)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) whose fingerprints differ in at most ``radius`` bits."""
    slices = planes(b)
    bits, width = slices.shape
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    k = max(1, int(radius).bit_length())
    start = (1 << k) - 1 - radius
    flips = np.unpackbits(a.view(np.uint8).reshape(len(a), -1), axis=1, bitorder="little").astype(bool)
    rows, cols = np.arange(len(a)), np.arange(width)
    counters = [np.full((len(a), width), full if start >> i & 1 else np.uint64(0)) for i in range(k)]
    over = np.zeros((len(a), width), np.uint64)
    for bit in range(bits):
        carry = slices[bit, cols][None, :] ^ np.where(flips[rows, bit], full, np.uint64(0))[:, None]
        for i in range(k):
            held = counters[i]
            counters[i], carry = held ^ carry, held & carry
        over |= carry
        if bit % 8 == 7 and bit > radius and bit + 1 < bits:
            open_ = over != full
            keep_rows, keep_cols = open_.any(axis=1), open_.any(axis=0)
            if not keep_rows.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if keep_rows.mean() < 0.75 or keep_cols.mean() < 0.75:
                rows, cols = rows[keep_rows], cols[keep_cols]
                over = over[keep_rows][:, keep_cols]
                counters = [x[keep_rows][:, keep_cols] for x in counters]
    r, w = np.nonzero(over != full)
    lanes = np.unpackbits((~over[r, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    p, lane = np.nonzero(lanes)
    i, j = rows[r[p]], cols[w[p]] * 64 + lane
    real = j < len(b)
    return i[real], j[real]


def _least_labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    label = np.arange(n) if label is None else label
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _stars(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the members of each label to the smallest id among them. Buckets with the same members give the same edges."""
    order = np.lexsort((ids, label))
    lab, own = label[order], ids[order]
    first = np.r_[True, lab[1:] != lab[:-1]] if len(lab) else np.empty(0, bool)
    least = own[np.maximum.accumulate(np.where(first, np.arange(len(lab)), 0))]
    return own[own != least], least[own != least]


def _blocks(n: int, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows to compare: every two of all rows, or with ``side`` every two from different sides."""
    left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    for at in range(0, len(left), BLOCK):
        for to in range(at if side is None else 0, len(right), BLOCK):
            yield left[at : at + BLOCK], right[to : to + BLOCK]


def linked(ids: np.ndarray, fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the linked sets of these fingerprints, which are compared block by block."""
    label = np.arange(len(ids))
    for a, b in _blocks(len(ids), side):
        i, j = within(fps[a], fps[b], radius)
        label = _least_labels(len(ids), a[i], b[j], label)
    return _stars(ids, label)


def linked_exactly(ids: np.ndarray, fps: np.ndarray, radius: int, side: np.ndarray | None, sets: list[np.ndarray], jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`linked`, but of these candidates only pairs whose ``sets`` have a Jaccard similarity of ``jaccard`` or more are links.

    A pair that earlier links connect isn't compared.
    """
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.r_[0, np.cumsum(size)]
    own = np.zeros(int(code.max(initial=-1)) + 1, bool)
    label = np.arange(len(ids))
    for left, right in _blocks(len(ids), side):
        i, j = within(fps[left], fps[right], radius)
        order = np.argsort(i, kind="stable")
        i, j = left[i[order]], right[j[order]]
        edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for s, e in zip(edges, np.r_[edges[1:], len(i)].astype(int)):
            a, b = i[s], j[s:e]
            b = b[label[b] != label[a]]
            b = b[np.minimum(size[a], size[b]) >= jaccard * np.maximum(size[a], size[b]) - 1e-6]
            if not len(b):
                continue
            own[code[start[a] : start[a + 1]]] = True
            both = np.array([np.count_nonzero(own[code[start[x] : start[x + 1]]]) for x in b])
            own[code[start[a] : start[a + 1]]] = False
            union = size[a] + size[b] - both
            real = b[np.where(union == 0, 1.0, both / np.maximum(union, 1)) >= jaccard]
            if len(real):
                together = np.r_[label[a], label[real]]
                label[np.isin(label, together)] = together.min()
    return _stars(ids, label)


def _split(pdf: pd.DataFrame, edges: np.ndarray) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows to compare together, from buckets that begin at ``edges``, and whether they are two chunks of one large bucket.

    A link found across buckets is a link too, so small buckets are compared in one go. A row alone in its bucket
    has nothing to be compared with.
    """
    size = np.diff(np.r_[edges, len(pdf)])
    crossed = pdf["crossed"].to_numpy()[edges]
    part = np.where(size > 1, np.cumsum(np.where((size > 1) & ~crossed, size, 0)) // BLOCK, -1)
    of_row = np.repeat(np.where(crossed, -1, part), size)
    for i in np.unique(of_row[of_row >= 0]):
        yield pdf[of_row == i], False
    for i in np.flatnonzero(crossed):
        yield pdf.iloc[edges[i] : edges[i] + size[i]], True


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """:func:`_split` over whole buckets, whose rows follow each other in ``batches``."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            bucket, crossed = pdf["bucket"].to_numpy(), pdf["crossed"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (crossed[1:] != crossed[:-1])])
            rest = pdf.iloc[edges[-1] :]
            yield from _split(pdf.iloc[: edges[-1]], edges[:-1])
    if rest is not None:
        yield from _split(rest, np.zeros(1, np.int64))


def _compare(radius: int, bits: int, jaccard: float = 0.0):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: pd.DataFrame, crossed: bool) -> pd.DataFrame:
            made = np.frombuffer(b"".join(rows["fp"]), np.uint8).reshape(len(rows), -1)
            own = np.ascontiguousarray(made[:, : bits // 8]).view(np.uint64)
            side = rows["side"].to_numpy() if crossed else None
            if jaccard:
                a, b = linked_exactly(rows["node"].to_numpy(), own, radius, side, [np.frombuffer(x, "<u8") for x in rows["set"]], jaccard)
            else:
                a, b = linked(rows["node"].to_numpy(), own, radius, side)
            return pd.DataFrame({"a": a, "b": b})

        for rows, crossed in _buckets(batches):
            yield flush(rows, crossed)

    return run


def _dealt(rows: DataFrame, group: str, hot: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``rows`` by bucket: groups in ``hot`` are dealt as single chunks and as pairs of chunks, whose two sides are marked."""
    own, other = F.col("own"), F.col("other")
    dealt = (
        rows.join(hot, group, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    )
    dealt = dealt.select(*columns, F.xxhash64(group, F.least(own, other), F.greatest(own, other)).alias("bucket"), (own != other).alias("crossed"), (own > other).alias("side"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "crossed")


def key_blocks(n: int, bits: int, radius: int) -> int:
    """Into how many blocks fingerprints are cut, so that bucket rows and comparisons of ``n`` fingerprints cost least."""

    def cost(blocks: int) -> float:
        return math.comb(blocks, radius) * (ROW_COST + n / 2.0 ** (bits * (blocks - radius) / blocks))

    return min(range(radius + 1, min(bits, radius + 8) + 1), key=cost)


def near_links(nodes: DataFrame, radius: int, bits: int = 64, blocks: int | None = None, bands: bool = False) -> DataFrame:
    """Stars (a, b) over the sets of rows (node, fp) of ``nodes`` that links within ``radius`` bits connect in a bucket.

    Buckets are keys of ``blocks`` blocks (chosen by :func:`key_blocks` if None), which lose no link, or with ``bands`` the values
    of ``keys``. Buckets above ``CHUNK`` rows, such as those of a large group of near copies, are dealt
    as pairs of chunks to as many tasks.
    """
    if bands:
        keys = F.expr("transform(keys, (x, i) -> xxhash64(i, x))")
        banded = nodes.select("node", F.substring("fp", 1, bits // 8).alias("fp"), F.explode(keys).alias("band"))
    else:
        blocks = blocks or key_blocks(nodes.count(), bits, radius)
        cuts = [bits * i // blocks for i in range(blocks + 1)]
        as_bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex(F.substring("fp", 1, bits // 8)), 8 * i + 1, 8), 16, 2), 32, "0") for i in range(bits // 32)])
        parts = [F.substring("bits", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
        keys = F.array(*[F.xxhash64(F.lit(at), *[parts[i] for i in chosen]) for at, chosen in enumerate(combinations(range(blocks), blocks - radius))])
        banded = nodes.withColumn("bits", as_bits).select("node", "fp", F.explode(keys).alias("band"))
    hot = stored(banded.groupBy("band").count().where(F.col("count") > CHUNK).select("band", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "simhash-hot")
    return _dealt(banded, "band", hot, "node", ["node", "fp"]).mapInPandas(_compare(radius, bits), "a long, b long")


def exact_links(docs: DataFrame, suspects: DataFrame, words: int, radius: int, bits: int, jaccard: float) -> DataFrame:
    """Stars (a, b) over the rows (node, fp, first, component) of ``suspects`` that links of an exact Jaccard similarity connect within a component.

    Sets come from the texts of ``docs`` (doc_id, text, text_key) that ``first`` names. Components above
    ``SET_CHUNK`` rows or ``SET_BYTES`` are dealt as pairs of chunks to as many tasks.
    """

    @F.pandas_udf(T.BinaryType())
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, words).astype("<u8").tobytes() for x in texts], dtype=object)

    named = suspects.select("node", "fp", "component", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    rows = docs.join(named, ["doc_id", "text_key"]).groupBy("node", "fp", "component").agg(F.first("text").alias("text"))
    held = stored(rows.select("node", "fp", "component", set_of("text").alias("set")), "simhash-sets")
    chunks = F.greatest(F.ceil(F.count("*") / SET_CHUNK), F.ceil(F.sum(F.length("set")) / SET_BYTES)).cast("int")
    hot = stored(held.groupBy("component").agg(chunks.alias("chunks")).where("chunks > 1"), "simhash-hot-sets")
    return _dealt(held, "component", hot, "node", ["node", "fp", "set"]).mapInPandas(_compare(radius, bits, jaccard), "a long, b long")


def _text_key(text: str):
    """128 bits of a text, which tell apart rows that repeat a doc_id."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def _classes(docs: DataFrame, doc_id: str, text: str, words: int, bits: int, radius: int, bands: int, jaccard: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) per row, and (fp, first) per fingerprint: the smallest (doc_id, text_key) reachable over links."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (_text_key(text) if jaccard else F.lit(None).cast("binary")).alias("text_key"))
    marked = stored(fingerprints(texts, "text", words, bits, bands).select("doc_id", "text_key", "fp", "keys"), "simhash-fp")
    nodes = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    groups = connected_components(near_links(nodes, radius, bits, bands=bands > 0))
    if jaccard:
        suspects = stored(nodes.drop("keys").join(groups, "node"), "simhash-suspects")
        groups = connected_components(exact_links(texts, suspects, words, radius, bits, jaccard))
    groups = stored(groups, "simhash-groups")
    firsts = nodes.join(groups, "node").groupBy("component").agg(F.min("first").alias("least"))
    return marked.drop("keys"), nodes.join(groups.join(firsts, "component"), "node", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 64, radius: int = 4, bands: int = 0, jaccard: float = 0.0) -> DataFrame:
    """One row per document: doc_id, fp (binary) and component_id, the smallest doc_id reachable over links.

    Without ``bands``, all pairs within ``radius`` bits are links. With ``bands``, fingerprints count distinct shingles, and pairs that share a band
    and lie within the radius are candidates; a link needs an exact Jaccard similarity of ``jaccard``; ``fp`` then ends
    with a digest of the set of shingles. Documents with equal fingerprints (and digests) are one node.
    Null, empty and blank texts share the zero fingerprint and are linked by it like any other. A row with a
    null doc_id gets its fingerprint, a null component and takes no part in linking. Repeated rows stay
    repeated, and rows that repeat a doc_id with another text are documents of their own; other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    marked, classes = _classes(docs, doc_id, text, words, bits, radius, bands, jaccard)
    return marked.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, bits: int = 128, radius: int = 32, bands: int = 21, jaccard: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group is kept, that with the smallest doc_id.

    Documents link if the Jaccard similarity of their sets of five-word shingles, by 64-bit hashes, is 0.8 or
    more, however often a shingle repeats. Candidates share one of 21 bands of six smallest hashes and lie within 32 of 128 bits: at
    similarity 0.8 a pair differs in 19 bits on average, 1 - (1 - 0.8^6)^21 = 99.8 % of such pairs share a band, and the radius
    holds 99.8 %, in a simulation of sets of 200.
    Rows are told apart by doc_id and text: a doc_id that repeats with an unlike text keeps both rows. Of rows that repeat both, one
    stays, the one whose columns hash lowest; rows with a null doc_id all stay.
    """
    marked, classes = _classes(docs, doc_id, text, words, bits, radius, bands, jaccard)
    found = stored(marked.where("doc_id IS NOT NULL").join(classes, "fp").select("doc_id", "text_key", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays")), "simhash-found")
    row = [doc_id, "_text_key"]
    named = [F.col("doc_id").alias(doc_id), F.col("text_key").alias("_text_key")]
    gone = stored(found.where(~F.col("stays")).select(*named).distinct(), "simhash-gone")
    repeated = stored(found.where("stays").groupBy("doc_id", "text_key").count().where("count > 1").select(*named), "simhash-repeated")
    keyed = docs.withColumn("_text_key", _text_key(text))
    order = F.xxhash64(F.lit(SEED), *[F.col(f.name) for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    one = keyed.join(repeated, row, "left_semi").groupBy(*row).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    once = keyed.join(repeated, row, "left_anti").unionByName(one.select("row.*", "_text_key"))
    # always a shuffle join: what a size check would broadcast for small tables says nothing about large ones
    return once.join(gone.hint("shuffle_hash"), row, "left_anti").select(docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
