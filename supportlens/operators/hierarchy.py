"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

1. Connected components. Every node has at most one parent, so the links form a functional graph;
   pointers are doubled by joins until each stands on a root or on a cycle: as many rounds as the
   logarithm of the depth.
2. Components are co-located (one shuffle on the component) and each is walked by an iterative
   depth-first traversal with node colouring: white unseen, grey on the stack, black done. A link into a
   grey node is a back edge and closes a cycle.
3. A component above ``max_local`` nodes is never gathered into one task: its depths, paths and
   descendant counts come from pointer doubling joins, with the same results.

Defined results: rows whose id is null are left out; of repeated ids the smallest parent holds; a parent
that is null or not among the ids makes a root of depth 0; on a cycle or below one the root is
``cycle``, depth and descendants are -1 and the path is null; an empty table gives an empty result.
Other columns of the input are not read, so clashing names are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import stage, unstage

CYCLE = "cycle"


def _links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """id, parent (null for roots), missing (the parent is named but absent)."""
    nodes = rows.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("up")).filter("id is not null")
    nodes = nodes.groupBy("id").agg(F.min("up").alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    return nodes.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("parent"), (F.col("up").isNotNull() & F.col("known").isNull()).alias("missing"))


def components(links: DataFrame) -> DataFrame:
    """Adds comp (the root's id, or the smallest id of the cycle) and cyclic to a staged table of links."""
    state = stage(links.select("id", "parent", F.coalesce("parent", "id").alias("ptr"), F.col("parent").isNull().alias("done"), F.least("id", F.coalesce("parent", "id")).alias("low")), "hierarchy")
    finished: list[DataFrame] = []
    spent: list[DataFrame] = []
    before = None
    while True:
        seen = state.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).first()
        if not seen["open"] or before == (seen["done"], seen["open"]):
            break
        before = (seen["done"], seen["open"])
        target = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("done").alias("to_done"), F.col("low").alias("to_low"))
        moved = state.filter("not done").join(target, "ptr").select("id", "parent", F.col("to").alias("ptr"), F.col("to_done").alias("done"), F.least("low", "to_low").alias("low"))
        spent.append(state)
        # rows that were done stay in the table, as targets; they take no part in the join's left side
        state = stage(state.filter("done").unionByName(moved), "hierarchy")
        unstage(*spent[:-1])
        spent = spent[-1:]
    finished.append(state.filter("done").select("id", "parent", F.col("ptr").alias("comp"), F.lit(False).alias("cyclic")))
    if seen["open"]:
        ring = stage(state.filter("not done").select("id", "parent", "ptr", "low"), "ring")
        image, lows = -1, -1
        while True:
            now = ring.agg(F.count_distinct("ptr").alias("image"), F.sum(F.xxhash64("id", "low").cast("decimal(20,0)")).alias("lows")).first()
            if (now["image"], now["lows"]) == (image, lows):
                break
            image, lows = now["image"], now["lows"]
            target = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("low").alias("to_low"))
            again = stage(ring.join(target, "ptr").select("id", "parent", F.col("to").alias("ptr"), F.least("low", "to_low").alias("low")), "ring")
            unstage(ring)
            ring = again
        target = ring.select(F.col("id").alias("ptr"), F.col("low").alias("comp"))
        finished.append(ring.join(target, "ptr").select("id", "parent", "comp", F.lit(True).alias("cyclic")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def _walk(ids: list[str], parents: list[str | None], want_path: bool):
    """One component, or several whole ones: root, depth, descendants, back edge and path of every node."""
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    up = [-1] * n
    kids: list[list[int] | None] = [None] * n
    starts = []
    for i, p in enumerate(parents):
        if p is None:
            starts.append(i)
        else:
            j = at[p]
            up[i] = j
            if kids[j] is None:
                kids[j] = [i]
            else:
                kids[j].append(i)
    white, grey, black = 0, 1, 2
    colour = bytearray(n)
    root: list[str] = [CYCLE] * n
    depth, below, back = [-1] * n, [-1] * n, [False] * n
    paths: list[list[str] | None] = [None] * n
    for s in starts:
        name, order, stack = ids[s], [], [s]
        depth[s] = 0
        while stack:  # pre-order; read backwards it closes every node after all below it
            v = stack.pop()
            colour[v] = grey
            order.append(v)
            for w in kids[v] or ():
                depth[w] = depth[v] + 1
                stack.append(w)
        for v in order:
            root[v], below[v] = name, 0
            if want_path:
                paths[v] = [ids[v]] if up[v] < 0 else [*paths[up[v]], ids[v]]
        for v in reversed(order):
            colour[v] = black
            if up[v] >= 0:
                below[up[v]] += below[v] + 1
    # what is still white hangs on a cycle: follow the parents until a grey node turns up again
    for s in range(n):
        trail = []
        v = s
        while colour[v] == white:
            colour[v] = grey
            trail.append(v)
            v = up[v]
        if colour[v] == grey:
            ring, w = [v], up[v]
            while w != v:
                ring.append(w)
                w = up[w]
            back[min(ring, key=lambda i: ids[i])] = True
        for w in trail:
            colour[w] = black
    return root, depth, below, back, paths


def _traverse(want_path: bool, batch_rows: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        parents: list[str | None] = []
        comps: list[str] = []

        def out(n: int) -> pa.RecordBatch:
            root, depth, below, back, paths = _walk(ids[:n], parents[:n], want_path)
            cols = {"id": pa.array(ids[:n], pa.string()), "root": pa.array(root, pa.string()), "depth": pa.array(depth, pa.int64()), "descendants": pa.array(below, pa.int64()), "back_edge": pa.array(back, pa.bool_())}
            if want_path:
                cols["path"] = pa.array(paths, pa.list_(pa.string()))
            del ids[:n], parents[:n], comps[:n]
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            ids += batch.column("id").to_pylist()
            parents += batch.column("parent").to_pylist()
            comps += batch.column("comp").to_pylist()
            if len(ids) >= batch_rows:
                n = len(ids)
                last = comps[-1]
                while n and comps[n - 1] == last:  # the last component may go on in the next batch
                    n -= 1
                if n:
                    yield out(n)
        if ids:
            yield out(len(ids))

    return run


def _doubled(nodes: DataFrame, want_path: bool) -> DataFrame:
    """Depth, descendants and path of trees too large for one task, by doubling the pointers.

    After round k, ``total`` counts the nodes of the subtree less than 2^k below, and ``jump`` is the
    ancestor 2^k above. Both at k+1 follow from one join and one aggregation, whose map side combines
    the rows of a hot parent before they are shuffled.
    """
    path = [F.array("id").alias("path")] if want_path else []
    state = stage(nodes.select("id", "comp", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("total"), *path), "doubling")
    while state.filter("jump is not null").limit(1).count():
        gain = state.filter("jump is not null").groupBy("jump").agg(F.sum("total").alias("gain")).select(F.col("jump").alias("id"), "gain")
        hop = state.select(F.col("id").alias("jump"), F.col("jump").alias("to"), F.col("depth").alias("to_depth"), *([F.col("path").alias("to_path")] if want_path else []))
        path = [F.when(F.col("jump").isNull(), F.col("path")).otherwise(F.concat("to_path", "path")).alias("path")] if want_path else []
        nxt = state.join(gain, "id", "left").join(hop, "jump", "left").select(
            "id", "comp", F.col("to").alias("jump"), (F.col("depth") + F.coalesce("to_depth", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total"), *path)
        nxt = stage(nxt, "doubling")
        unstage(state)
        state = nxt
    return state.select("id", F.col("comp").alias("root"), "depth", (F.col("total") - 1).alias("descendants"), F.lit(False).alias("back_edge"), *(["path"] if want_path else []))


def hierarchy(rows: DataFrame, id_col: str, parent_col: str, *, with_path: bool = False, max_local: int = 100_000) -> DataFrame:
    """id, root, depth, descendants, back_edge, missing_parent (of the root) and, if wanted, path from the root.

    back_edge marks one row of each cycle, that with its smallest id: its link to its parent closes the cycle.
    max_local: nodes that one task may hold of a single component.
    """
    links = stage(_links(rows, id_col, parent_col), "links")
    comps = stage(components(links.select("id", "parent")), "components")
    sizes = comps.groupBy("comp").count().filter(F.col("count") > max_local)
    large = stage(sizes.select("comp"), "large")  # at most (rows / max_local) components
    has_large = bool(large.limit(1).count())
    small = comps.join(large, "comp", "left_anti") if has_large else comps
    schema = "id string, root string, depth long, descendants long, back_edge boolean" + (", path array<string>" if with_path else "")
    out = small.select("comp", "id", "parent").repartition("comp").sortWithinPartitions("comp").mapInArrow(_traverse(with_path), schema)
    if has_large:
        held = comps.join(large, "comp", "left_semi")
        extra = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
        rings = held.filter("cyclic").select("id", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(-1).cast("long").alias("descendants"), (F.col("id") == F.col("comp")).alias("back_edge"), *extra)
        out = out.unionByName(_doubled(held.filter("not cyclic"), with_path)).unionByName(rings)
    return out


def missing_parents(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Ids whose parent is named but not among the ids."""
    return _links(rows, id_col, parent_col).filter("missing").select("id")


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair, from a hierarchy with paths; cycles give none."""
    pairs = tree.filter("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("level", "ancestor"))
    return pairs.select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
