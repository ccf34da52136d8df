import random

import pytest

from supportlens.operators.hierarchy import descendant_pairs, hierarchy

SCHEMA = "id string, parent string, depth int, root string"  # clashing names that must not be read


def brute(parent: dict[str, str | None]):
    out = {}
    kids: dict[str, list[str]] = {}
    for x, p in parent.items():
        if p in parent:
            kids.setdefault(p, []).append(x)
    for x in parent:
        path, at = [x], x
        while parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at] in parent:
            out[x] = ("cycle", -1, -1, None)
            continue
        below, todo = 0, list(kids.get(x, ()))
        while todo:
            y = todo.pop()
            below += 1
            todo += kids.get(y, ())
        out[x] = (at, len(path) - 1, below, path[::-1])
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], SCHEMA)
    return {r["id"]: (r["root"], r["depth"], r["descendants"], r["path"]) for r in hierarchy(df, "id", "parent", with_path=True, **kw).collect()}


@pytest.mark.parametrize("max_local", [100_000, 3])
def test_against_brute_force(spark, max_local):
    rng = random.Random(3)
    parent: dict[str, str | None] = {str(i): None if rng.random() < 0.1 else str(rng.randrange(90)) for i in range(70)}  # cycles, absent parents
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(20)} | {f"s{i}": "s0" if i else None for i in range(20)} | {"self": "self"}
    assert run(spark, list(parent.items()), max_local=max_local) == brute(parent)


def test_back_edges_mark_each_cycle_once(spark):
    rows = [("b", "a"), ("a", "c"), ("c", "b"), ("d", "a"), ("x", "x"), ("ok", None)]
    for bound in (100, 1):
        df = spark.createDataFrame(rows, "id string, parent string")
        assert sorted(r["id"] for r in hierarchy(df, "id", "parent", max_local=bound).collect() if r["back_edge"]) == ["a", "x"]


def test_nulls_repeats_and_empty_tables(spark):
    got = run(spark, [(None, "a"), ("a", None), ("a", None), ("b", "a"), ("b", "a"), ("c", "gone")])
    assert got == {"a": ("a", 0, 1, ["a"]), "b": ("a", 1, 0, ["a", "b"]), "c": ("c", 0, 0, ["c"])}
    assert run(spark, []) == {}


def test_pairs(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    got = {tuple(r) for r in descendant_pairs(hierarchy(df, "id", "parent", with_path=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
