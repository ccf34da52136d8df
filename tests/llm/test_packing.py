import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from supportlens.llm import packing


def fewest(items, capacity):
    """The optimum by search, for a handful of items."""
    items, best = sorted(items, reverse=True), len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 40))
def test_plan_holds_all_and_is_near_the_optimum(items, capacity):
    hist = {n: items.count(n) for n in set(items)}
    classes = packing.plan(hist, capacity)
    held: dict[int, int] = {}
    for content, times in classes:
        assert times > 0 and sum(n * k for n, k in content.items()) <= capacity
        for n, k in content.items():
            held[n] = held.get(n, 0) + k * times
    assert held == hist
    assert sum(t for _, t in classes) <= fewest(items, capacity) + 1


def test_large_histograms_end_near_the_bound():
    rng = np.random.default_rng(1)
    for capacity in (512, 1024, 4096):
        n = np.minimum(np.maximum(1, rng.lognormal(4.5, 1.1, 200_000).astype(int)), capacity)
        hist = {int(a): int(b) for a, b in zip(*np.unique(n, return_counts=True))}
        classes, placed = packing._plan(hist, capacity, 128, 4, 0.2)
        assert sum(t for _, t in classes) <= 1.002 * -(-int(n.sum()) // capacity) + 1
        assert placed > 0.55 * len(n)  # patterns place most documents, whatever the capacity


def test_nnls_against_a_known_solution():
    a = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [1.0, 1.0, 0.0]])
    assert np.allclose(packing.nnls(a, a @ np.array([2.0, 0.0, 3.0])), [2, 0, 3], atol=1e-8)


def test_assignment(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 5, 7, 20, 33, 50, 100, 120, 230])) for i in range(400)] + [(1000, None), (5, 7)] + [(2000 + i, 33) for i in range(200)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, tokens long, container int").cache()
    windows = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (None, 9)], "window_id long, capacity_tokens long")
    got = packing.pack(sizes, windows).collect()
    for w, cap in ((1, 100), (2, 64)):
        mine = [r for r in got if r["window_id"] == w]
        assert sum(r["tokens"] for r in mine) == sum(t or 0 for _, t in rows)
        fill: dict[int, int] = {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert max(fill.values()) <= cap
        pieces: dict[int, list[int]] = {}
        for r in mine:
            pieces.setdefault(r["doc_id"], []).append(r["tokens"])
        for i, t in rows:
            if i != 5 and (t or 0) <= cap:
                assert pieces[i] == [t or 0]  # whole
        assert len([c for c in fill if fill[c]]) <= -(-sum(t or 0 for _, t in rows) // cap) * 1.5
    assert packing.pack(sizes.limit(0), windows).count() == 0 and packing.pack(sizes, windows.limit(0)).count() == 0


def test_repeated_long_ids_share_no_container(spark):
    sizes = spark.createDataFrame([(1, 25), (1, 25), (1, 30), (2, 40), (3, 9)], "doc_id long, tokens long").cache()
    got = packing.pack(sizes, spark.createDataFrame([(1, 10)], "window_id long, capacity_tokens long")).collect()
    fill: dict[int, int] = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 129
    full = sorted(r["container"] for r in got if r["tokens"] == 10)
    assert full == list(range(-11, 0))  # 2 + 2 + 3 + 4 pieces, one each
