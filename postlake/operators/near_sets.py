"""Sets of numbers and the most similar ones of each, counted in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Numbers that more than this share of all sets have are compared as bits of one word, the others by lists of the sets that have them.
_COMMON = 1 / 16


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of an array column, and how many each row has."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def most_similar(left: pa.Table, right: pa.Table, least: float, n: int) -> pa.Table:
    """(l, r, similarity): up to ``n`` sets of ``right`` for each of ``left``, by row numbers; those whose Jaccard similarity is ``least`` or more.

    The most similar come first, earlier rows among equals. Each table has an array column ``g`` of distinct numbers. A row of ``left`` counts what it shares with
    all of ``right`` at once; how much it has to share follows from both sizes and the common numbers, so it's worked out once for rows that agree in these.
    """
    (l_items, l_n), (r_items, r_n) = _flat(left["g"]), _flat(right["g"])
    size, l_at = len(r_n), np.concatenate([[0], np.cumsum(l_n)])
    found, items = np.unique(np.concatenate([r_items, l_items]), return_inverse=True)
    r_items, l_items = items[: len(r_items)], items[len(r_items) :]
    often = np.bincount(r_items, minlength=len(found))
    have = np.repeat(np.arange(size), r_n)[np.argsort(r_items, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(often)])
    common = [k for k in np.argsort(-often, kind="stable")[:63] if often[k] > size * _COMMON]
    bit = np.zeros(len(found), dtype=np.int64)
    bit[common] = 1 << np.arange(len(common), dtype=np.int64)
    l_bits, r_bits = np.zeros(len(l_n), dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(l_bits, np.repeat(np.arange(len(l_n)), l_n), bit[l_items])
    np.add.at(r_bits, np.repeat(np.arange(size), r_n), bit[r_items])
    r_kinds, r_kind = np.unique(np.stack([r_n, r_bits]), axis=1, return_inverse=True)
    l_kinds, l_kind = np.unique(np.stack([l_n, l_bits]), axis=1, return_inverse=True)
    listed = bit[l_items] == 0
    lists = [have[starts[k] : starts[k + 1]] for k in range(len(found))]
    rare, rare_at = l_items[listed].tolist(), np.concatenate([[0], np.cumsum(listed)])[l_at].tolist()
    counts = np.zeros(-(-size // 8) * 8, dtype=np.min_scalar_type(int(l_n.max(initial=0)) + 1))
    places = np.arange(len(counts)).reshape(-1, 8)  # eight rows at a time, as few hit
    most, kind, got = np.iinfo(counts.dtype).max, None, []
    rows = np.argsort(l_kind, kind="stable")
    for row, its in zip(rows.tolist(), l_kind[rows].tolist()):
        if its != kind:
            kind = its
            both = np.bitwise_count(r_kinds[1] & l_kinds[1, kind]).astype(np.int64)
            need = np.ceil((r_kinds[0] + l_kinds[0, kind]) * (least / (1 + least)) - 1e-9).astype(np.int64) - both
            need_of = np.full(len(counts), most, dtype=counts.dtype)
            need_of[:size] = np.clip(need, 0, most).astype(counts.dtype)[r_kind]
        for k in rare[rare_at[row] : rare_at[row + 1]]:
            counts[lists[k]] += 1
        hit = counts >= need_of
        some = hit.view(np.uint64).nonzero()[0]
        near = places[some][hit.reshape(-1, 8)[some]]
        shared = counts[near] + both[r_kind[near]]
        similarity = shared / (l_kinds[0, kind] + r_n[near] - shared)
        worst = least if len(near) <= n else max(least, np.partition(similarity, -n)[-n])
        best = (similarity >= worst).nonzero()[0]
        best = best[(-similarity[best]).argsort(kind="stable")[:n]]
        got.append((near[best], similarity[best]))
        counts.fill(0)
    near, similarity = [np.concatenate([x[i] for x in got]) if got else np.empty(0, kind) for i, kind in enumerate((np.int64, np.float64))]
    return pa.table({"l": np.repeat(rows, [len(x) for x, _ in got]), "r": near, "similarity": similarity})
