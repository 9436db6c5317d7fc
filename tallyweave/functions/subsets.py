"""Pairs and triples that add up to given totals, within windows of days: exact, in memory that is bounded."""

from __future__ import annotations

#: Sums, or totals less one part, that are held at once.
HELD = 1 << 22


def whole_numbers(amounts):
    """Exact integers in proportion to decimals of one scale: 64-bit ones, of sums of four too, or Python's."""
    import numpy as np

    halves = np.frombuffer(amounts.buffers()[1], np.int64).reshape(-1, 2)[amounts.offset : amounts.offset + len(amounts)]
    low, high = halves[:, 0], halves[:, 1]
    if np.array_equal(high, low >> 63) and len(low) and low.min() > -(1 << 62):
        unit = int(np.gcd.reduce(np.abs(low))) or 1
        low = low // unit
        if max(abs(int(low.min())), abs(int(low.max()))) < 1 << 60:
            return low
    out = np.empty(len(halves), object)
    out[:] = [(int(h) << 64) | (int(x) & (1 << 64) - 1) for x, h in halves]
    return out


def _matches(sums, wanted):
    """Places in ``sums`` and in ``wanted`` of all equal values. Both are thinned out by their bits before the search."""
    import numpy as np

    bits = min(24, max(10, int(max(len(sums), len(wanted))).bit_length() + 3))
    mask = (1 << bits) - 1
    of = lambda x, shift: ((x >> shift) & mask).astype(np.int64)
    seen = np.zeros(mask + 1, bool)
    seen[of(sums, 0)] = True
    w = np.flatnonzero(seen[of(wanted, 0)])
    few = wanted[w]
    seen = np.zeros(mask + 1, bool)
    seen[of(few, 5)] = True
    s = np.flatnonzero(seen[of(sums, 5)])
    s = s[np.argsort(sums[s], kind="stable")]
    ordered = sums[s]
    first, last = np.searchsorted(ordered, few, "left"), np.searchsorted(ordered, few, "right")
    times = last - first
    start = np.repeat(first - np.cumsum(times) + times, times)
    return s[start + np.arange(len(start))], np.repeat(w, times)


def subsets(totals, parts, rank, most: int):
    """Index arrays (whole, i, j, k) of parts that add up to a total; ranks ascend strictly, k is -1 for a pair."""
    import numpy as np

    n = len(parts)
    for at in range(0, len(totals), step := max(1, HELD // (n + 1))):
        some = totals[at : at + step]
        wanted = np.concatenate([some, (some[:, None] - parts[None, :]).ravel()]) if most > 2 else some
        for row in range(0, n, rows := max(1, HELD // n)):
            s, w = _matches((parts[row : row + rows, None] + parts[None, :]).ravel(), wanted)
            i, j = row + s // n, s % n
            pair = w < len(some)
            k = np.where(pair, -1, (w - len(some)) % n)
            good = (rank[i] < rank[j]) & (pair | (rank[j] < rank[k]))
            whole = at + np.where(pair, w, (w - len(some)) // n)
            yield whole[good], i[good], j[good], k[good]


def search(table, window: int, most: int):
    """whole_id, whole_text, chosen for one group of rows: wholes, and the parts of their days' windows.

    Columns: whole (boolean), day, id, amount, text. A part is ``window`` days away from its whole at most.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = {c: (lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)(table.column(c)) for c in ("whole", "day", "id", "amount", "text")}
    amount, is_whole, day = whole_numbers(column["amount"]), np.asarray(column["whole"]), np.asarray(column["day"])
    rank = np.asarray(pc.rank(column["id"], sort_keys="ascending", tiebreaker="dense")).astype(np.int64)
    wholes, parts = (x[np.argsort(day[x], kind="stable")] for x in (np.flatnonzero(is_whole), np.flatnonzero(~is_whole)))
    found = []
    days, starts = np.unique(day[wholes], return_index=True)
    bounds = [*starts.tolist(), len(wholes)]
    for d, a, b in zip(days.tolist(), bounds[:-1], bounds[1:], strict=True):
        near = parts[np.searchsorted(day[parts], d - window, "left") : np.searchsorted(day[parts], d + window, "right")]
        if len(near) > 1:
            for w, i, j, k in subsets(amount[wholes[a:b]], amount[near], rank[near], most):
                if len(w):
                    found.append((wholes[a:b][w], near[i], near[j], np.where(k < 0, -1, near[k])))
    w, i, j, k = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
    chosen = np.stack([i, j, k], axis=1).ravel()
    ends = np.cumsum(np.where(k < 0, 2, 3))
    flat = pa.array(chosen[chosen >= 0])
    each = pa.StructArray.from_arrays([column[c].take(flat) for c in ("id", "amount", "text")], names=["id", "amount", "text"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), each)
    return pa.table({"whole_id": column["id"].take(pa.array(w)), "whole_text": column["text"].take(pa.array(w)), "chosen": lists})
