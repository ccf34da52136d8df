"""Term vectors in Arrow batches: counting the terms of texts, and the best rows of an index for a slice of queries.

A task holds a block of the index after another and scores a slice of queries against it, so that of all pairs of a query and a row only
the k best of each query leave the task; what is the k-th best so far is the least that a later block must reach. Scores are first summed in single precision: terms that many rows and many queries have by a
matrix product, the others by their postings. Every row that the rounding of these sums leaves a chance is summed again in double
precision, so what is returned are the exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, vector elements and words of a block, queries scored at once, and terms in the matrix product: bounds of a task's memory.
ROWS, ELEMENTS, WORDS, CHUNK, DENSE = 24_000, 2_500_000, 1_000_000, 64, 512
#: A product costs about this share of one addition by postings.
CHEAP = 0.005


def blocks(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[pa.Table]:
    """Whole batches together up to about ROWS rows and ELEMENTS elements (of lists of lists WORDS) of the column ``lists``; larger batches are cut."""
    held, rows, size = [], 0, 0
    for batch in batches:
        at, most = 0, WORDS if pa.types.is_list(batch.schema.field(lists).type.value_type) else ELEMENTS
        while at < batch.num_rows:
            lengths = np.cumsum(_sizes(batch.column(lists).slice(at)))
            n = min(ROWS - rows, max(1, int(np.searchsorted(lengths, most - size, "right"))), batch.num_rows - at)
            held.append(batch.slice(at, n))
            rows, size, at = rows + n, size + int(lengths[n - 1]), at + n
            if rows >= ROWS or size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each row, of lists of lists those of the inner lists."""
    n = _lengths(lists)
    if not pa.types.is_list(lists.type.value_type):
        return n
    ends = np.concatenate([[0], np.cumsum(_lengths(lists.flatten()))])[np.concatenate([[0], np.cumsum(n)])]
    return np.diff(ends)


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def _runs(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def tally(words: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of this block, and row, term and count of each term that a row has. words: the words of each text of each row."""
    texts = words.flatten()
    flat = texts.flatten()
    coded = flat.dictionary_encode()
    w, names = _numbers(coded.indices).astype(np.int64), coded.dictionary
    text = _runs(_lengths(texts))
    row = _runs(_lengths(words))[text]

    def counted(rows, codes, kinds):
        key, n = np.unique(rows * max(kinds, 1) + codes, return_counts=True)
        return key // max(kinds, 1), key % max(kinds, 1), n

    rows, codes, n = counted(row, w, len(names))
    if pairs and len(w) > 1:
        v = len(names)
        same = text[1:] == text[:-1]
        both, which = np.unique(w[:-1][same] * v + w[1:][same], return_inverse=True)
        r2, c2, n2 = counted(row[1:][same], which, len(both))
        joined = pc.binary_join_element_wise(names.take(pa.array(both // v)), names.take(pa.array(both % v)), pa.scalar(" ", names.type))
        rows, codes, n, names = np.concatenate([rows, r2]), np.concatenate([codes, c2 + v]), np.concatenate([n, n2]), pa.concat_arrays([names, joined])
    return names, rows, codes, n


def frequencies(pairs: bool):
    """Batches of words to term, df, uses of each block."""

    def run(batches):
        for block in blocks(batches, "words"):
            names, _, codes, n = tally(_column(block, "words"), pairs)
            df, uses = np.bincount(codes, minlength=len(names)), np.bincount(codes, n, minlength=len(names))
            yield from pa.table({"term": names, "df": df.astype(np.int64), "uses": uses.astype(np.int64)}).to_batches()

    return run


def counts(pairs: bool, vocabulary):
    """Batches of words to id, codes, ns: each row's known terms by their place in the vocabulary, in order, and how often it has them."""

    def run(batches):
        terms, _ = vocabulary.value
        for block in blocks(batches, "words"):
            names, rows, codes, n = tally(_column(block, "words"), pairs)
            known = _numbers(pc.fill_null(pc.index_in(names, value_set=terms), -1)).astype(np.int64)[codes]
            rows, known, n = rows[known >= 0], known[known >= 0], n[known >= 0]
            order = np.lexsort((known, rows))
            per = np.bincount(rows, minlength=block.num_rows)
            yield from pa.table({
                "id": block.column("id"), "codes": _lists(pa.array(known[order].astype(np.int32)), per),
                "ns": _lists(pa.array(n[order].astype(np.int32)), per), "kinds": block.column("kinds")}).to_batches()

    return run


def _weighted(table: pa.Table, idf: np.ndarray | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and weight of each element. Counts (codes, ns) become weights of length one a row."""
    if "ns" not in table.column_names:
        terms = _column(table, "terms")
        return _runs(_lengths(terms)), terms.flatten(), _numbers(_column(table, "weights").flatten()).astype(float)
    codes = _column(table, "codes")
    row, flat = _runs(_lengths(codes)), codes.flatten()
    w = (1 + np.log(_numbers(_column(table, "ns").flatten()))) * idf[_numbers(flat)]
    norm = np.sqrt(np.bincount(row, w * w, minlength=table.num_rows))
    return row, flat, w / norm[row]


def rows_of(vocabulary):
    """Batches of vectors to id, term, weight."""

    def run(batches):
        terms, idf = vocabulary.value
        for block in blocks(batches, "codes"):
            row, codes, w = _weighted(block, idf)
            yield from pa.table({"id": _column(block, "id").take(pa.array(row)), "term": terms.take(codes), "weight": w}).to_batches()

    return run


def sent(queries: pa.Table, idf: np.ndarray | None) -> dict:
    """A slice of queries (id, codes and ns or terms and weights, wanted, skip) as arrays, elements in the order of queries and terms."""
    row, terms, w = _weighted(queries, idf)
    coded = terms.dictionary_encode()
    skip = _column(queries, "skip")
    wanted = queries.column("wanted").to_pylist() if "wanted" in queries.column_names else None
    return {
        "ids": _column(queries, "id"), "row": row.astype(np.int32), "term": _numbers(coded.indices).astype(np.int32), "w": w, "terms": coded.dictionary,
        "skip": skip.flatten(), "skip_row": _runs(_lengths(skip)), "wanted": wanted}


def best(queries, vocabulary, k: int, least: float):
    """Batches of the index to query_id, id, score: of all that a task meets the k best rows of each query with a score above 0 and of at least ``least``."""

    def run(batches):
        q, idf = queries.value, vocabulary.value[1] if vocabulary else None
        groups: dict = {}
        for i, x in enumerate(q["wanted"] or [None] * len(q["ids"])):
            groups.setdefault(x, []).append(i)
        kept, floor = None, np.full(len(q["ids"]), float(least))
        for block in blocks(batches, "codes" if vocabulary else "terms"):
            for of, ids, score in _block_best(q, groups, block, idf, k, floor):
                kept, full = _kept(kept, pa.table({"of": of, "id": ids, "score": score}), k)
                floor[full[0]] = np.maximum(floor[full[0]], full[1])
        if kept is not None:
            yield from pa.table({"query_id": q["ids"].take(_column(kept, "of")), "id": kept.column("id"), "score": kept.column("score")}).to_batches()

    return run


def _block_best(q: dict, groups: dict, block: pa.Table, idf: np.ndarray | None, k: int, floor: np.ndarray):
    """For each group of queries: positions of queries, ids and scores. floor: what a score of each query must reach."""
    row, terms, w = _weighted(block, idf)
    t = _numbers(pc.fill_null(pc.index_in(terms, value_set=q["terms"]), -1))
    ids = _column(block, "id")
    every = pc.unique(ids)
    every = every.take(pc.sort_indices(every)).drop_null()
    doc = _numbers(pc.fill_null(pc.index_in(ids, value_set=every), -1))[row]
    skip = _numbers(pc.fill_null(pc.index_in(q["skip"].cast(every.type), value_set=every), -1)).astype(np.int64)
    known = (t >= 0) & (doc >= 0)
    for wanted, members in groups.items():
        times = None if q["wanted"] is None else _times(_column(block, "kinds"), wanted, row, idf is not None)
        use = known if times is None else known & (times > 0)
        of, at, score = _search(q, np.array(members), t[use], doc[use], w[use] if times is None else w[use] * times[use], skip, len(every), k, floor)
        if len(of):
            yield of, every.take(pa.array(at)), score


def _kept(before: pa.Table | None, found: pa.Table, k: int) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray]]:
    """The k best rows of each query, ties by the id; the queries that have k, and the score of their last."""
    every = found if before is None else pa.concat_tables([before, found])
    every = every.take(pc.sort_indices(every, sort_keys=[("of", "ascending"), ("score", "descending"), ("id", "ascending")]))
    of = every.column("of").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(of)]])))
    last = np.flatnonzero(rank == k - 1)
    return every.filter(pa.array(rank < k)), (of[last], every.column("score").to_numpy()[last])


def _times(kinds: pa.Array, wanted, row: np.ndarray, by_row: bool) -> np.ndarray:
    """How often each element counts: as many times as its row is of the wanted kind (by_row), or if it is of it itself. None is any kind."""
    flat, lengths = kinds.flatten(), _lengths(kinds)
    hit = np.ones(len(flat)) if wanted is None else _numbers(pc.fill_null(pc.equal(flat, pa.scalar(wanted, flat.type)), False)).astype(float)
    return np.bincount(_runs(lengths), hit, minlength=len(kinds))[row] if by_row else hit


def _merged(a: np.ndarray, b: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w in the order of a and b, each pair once."""
    key = a.astype(np.int64) * size + b
    if len(key) > 1 and not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        if (key[1:] == key[:-1]).any():
            key, which = np.unique(key, return_inverse=True)
            w = np.bincount(which, w)
    return key // size, key % size, w


def _starts(sorted_codes: np.ndarray, size: int) -> np.ndarray:
    return np.searchsorted(sorted_codes, np.arange(size + 1))


def _search(q: dict, members: np.ndarray, t: np.ndarray, d: np.ndarray, w: np.ndarray, skip: np.ndarray, n_every: int, k: int, floor: np.ndarray):
    """Query, row and score, by positions. t, d, w: term, row and weight of the index's elements; floor: what a score of each query must reach."""
    n_terms, out = len(q["terms"]), ([], [], [])
    if not len(t):
        return [np.concatenate([np.empty(0, kind), *x]) for x, kind in zip(out, (np.int64, np.int64, float))]
    d, t, w = _merged(d, t, w, n_terms)
    new = np.concatenate([[True], d[1:] != d[:-1]])
    held, d = d[new], np.cumsum(new) - 1  # rows with any of the terms; the others score 0
    n = len(held)
    by_doc = _starts(d, n)
    longest = np.sqrt(np.bincount(d, w * w).max())
    order = np.argsort(t, kind="stable")
    at = _starts(t[order], n_terms)
    many = np.diff(at)
    post, post_w = ([x[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())] for x in (d[order], w[order]))

    place = np.full(len(q["ids"]), -1)
    place[members] = np.arange(len(members))
    mine = place[q["row"]] >= 0
    qr, qt, qw = _merged(place[q["row"][mine]], q["term"][mine], q["w"][mine], n_terms)
    by_query = _starts(qr, len(members))
    rate = (many / n) * (np.bincount(qt, minlength=n_terms) / len(members))
    dense = np.argsort(-rate, kind="stable")[:DENSE]
    dense = dense[rate[dense] > CHEAP]
    column = np.full(n_terms, -1)
    column[dense] = np.arange(len(dense))
    matrix = np.zeros((len(dense), n), np.float32)
    for i, term in enumerate(dense):
        matrix[i, post[term]] = post_w[term]

    local = np.full(n_every, -1)
    local[held] = np.arange(n)
    skipped = local[skip]
    use = (skip >= 0) & (skipped >= 0) & (place[q["skip_row"]] >= 0)
    s_row, skipped = place[q["skip_row"][use]], skipped[use]
    order = np.argsort(s_row, kind="stable")
    skipped, by_skip = skipped[order], _starts(s_row[order], len(members))

    groups = max(1, min(n, max(4 * k, 256)))
    cuts = np.linspace(0, n, groups, endpoint=False).astype(np.int64)
    full = np.zeros(n_terms)
    for lo in range(0, len(members), CHUNK):
        hi = min(lo + CHUNK, len(members))
        a, b = by_query[lo], by_query[hi]
        inner = column[qt[a:b]] >= 0
        part = np.zeros((hi - lo, len(dense)), np.float32)
        part[qr[a:b][inner] - lo, column[qt[a:b][inner]]] = qw[a:b][inner]
        sums = part @ matrix
        for i in range(lo, hi):
            a, b = by_query[i], by_query[i + 1]
            if a == b:
                continue
            row, terms, weights = sums[i - lo], qt[a:b], qw[a:b]
            sparse = column[terms] < 0
            rare = terms[sparse].tolist()
            if rare:
                x = np.concatenate([post_w[j] for j in rare])
                x *= np.repeat(weights[sparse], many[rare])
                row += np.bincount(np.concatenate([post[j] for j in rare]), x, minlength=n)
            row[skipped[by_skip[i]:by_skip[i + 1]]] = 0
            # single precision is off by at most this much, and rounding to six digits by half a unit on either side
            off = (b - a + 4) * 2.0**-23 * longest * np.sqrt((weights * weights).sum())
            least = floor[members[i]]
            kth = np.partition(np.maximum.reduceat(row, cuts), -k)[-k] if groups >= k else 0.0
            chance = np.flatnonzero((row > 0) & (row >= max(kth - 2 * off, least - off) - 1.1e-6))
            if not len(chance):
                continue
            full[terms] = weights
            sizes = by_doc[chance + 1] - by_doc[chance]
            which = _runs(sizes)
            at_element = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + by_doc[chance][which]
            score = np.floor(np.bincount(which, full[t[at_element]] * w[at_element], minlength=len(chance)) * 1e6 + 0.5) / 1e6
            full[terms] = 0
            kept = np.flatnonzero((score > 0) & (score >= least))
            kept = kept[np.lexsort((chance[kept], -score[kept]))[:k]]
            out[0].append(np.full(len(kept), members[i]))
            out[1].append(held[chance[kept]])
            out[2].append(score[kept])
    return [np.concatenate([np.empty(0, kind), *x]) for x, kind in zip(out, (np.int64, np.int64, float))]
