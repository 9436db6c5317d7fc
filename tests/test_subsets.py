"""Pairs and triples of whole windows against brute force."""

import random
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.functions import subsets


def brute(rows, window, most):
    out = []
    for whole, day, wid, total, _ in rows:
        near = sorted((i, a, t) for w, d, i, a, t in rows if not w and abs(d - day) <= window) if whole else []
        for k in range(2, most + 1):
            out += [(wid, tuple(c)) for c in combinations(near, k) if sum(x[1] for x in c) == total and len({x[0] for x in c}) == k]
    return sorted(out)


@pytest.mark.parametrize(("unit", "held", "most"), [("0.01", 1 << 22, 3), ("0.0000000001", 40, 3), ("1000000000000000000.01", 40, 3), ("0.01", 300, 2)])
def test_search_equals_brute_force(monkeypatch, unit, held, most):
    monkeypatch.setattr(subsets, "HELD", held)
    rng = random.Random(held + most)
    rows = [(rng.random() < 0.4, rng.randint(-3, 9), f"R{rng.randint(0, 45):02d}", rng.randint(-30, 9) * Decimal(unit), f"t{n}") for n in range(90)]
    columns = zip(*rows, strict=True)
    kinds = [pa.bool_(), pa.int32(), pa.string(), pa.decimal128(38, 10), pa.string()]
    table = pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["whole", "day", "id", "amount", "text"])
    got = [(r["whole_id"], tuple((x["id"], x["amount"], x["text"]) for x in r["chosen"])) for r in subsets.search(table, 2, most).to_pylist()]
    assert sorted(got) == brute(rows, 2, most) and got
    assert subsets.search(table.slice(0, 0), 2, most).num_rows == 0


def test_a_day_of_many_parts_is_searched_without_its_triples():
    # 562 million triples for each whole
    parts = np.arange(1500, dtype=np.int64) * 2**20 + 1
    totals = np.array([int(parts[7] + parts[900]), int(parts[3] + parts[50] + parts[1400]), 5])
    found = [tuple(map(int, x)) for w, i, j, k in subsets.subsets(totals, parts, np.arange(1500), 3) for x in zip(w, i, j, k, strict=True)]
    assert (0, 7, 900, -1) in found and (1, 3, 50, 1400) in found
    assert all(parts[[x for x in f[1:] if x >= 0]].sum() == totals[f[0]] for f in found)
