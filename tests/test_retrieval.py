import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from supportlens.operators import retrieval, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["retrieval_quality", "retrieve_by_intent", "retrieval_retry", "retrieve_topk", "retrieve_min_score"])
def test_no_join_of_queries_and_rows_on_terms(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in plan and "weight#" not in plan


@pytest.mark.parametrize("rows, dense", [(24_000, 512), (7, 512), (24_000, 0), (7, 3)])
def test_best_rows_of_blocks_with_ties_and_kinds(monkeypatch, rows, dense):
    monkeypatch.setattr(vectors, "ROWS", rows)
    monkeypatch.setattr(vectors, "DENSE", dense)
    rng = np.random.default_rng(5)

    def some(n):
        terms = [sorted(rng.choice(12, rng.integers(1, 7), replace=False).tolist()) for _ in range(n)]
        return terms, [[float(x) for x in rng.integers(1, 4, len(t)) / 8] for t in terms]

    (terms, ws), (qt, qw) = some(60), some(30)
    kinds = [[str(x) for x in rng.choice(["a", "b"], rng.integers(1, 3))] for _ in terms]
    wanted, skip = [None, "a", "b"] * 10, [[i % 60] for i in range(30)]
    index = pa.table({"id": list(range(60)), "codes": pa.array(terms, pa.list_(pa.int32())), "ns": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32())), "kinds": kinds})
    asked = pa.table({"id": [f"q{i}" for i in range(30)], "terms": pa.array(qt, pa.list_(pa.int32())), "weights": qw, "wanted": wanted, "skip": skip})
    sent = vectors.sent(asked, None)
    idf = np.linspace(1, 3, 12)
    run = vectors.best(SimpleNamespace(value=sent), SimpleNamespace(value=(None, idf)), 4, 1e-6)
    got = {}
    for b in run(iter(index.to_batches(max_chunksize=11))):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for i in range(30):
        scores = []
        for d, t in enumerate(terms):
            times = len(kinds[d]) if wanted[i] is None else kinds[d].count(wanted[i])
            s = times * sum(w * idf[x] for x, w in zip(qt[i], qw[i]) if x in t) / np.sqrt((idf[t] ** 2).sum())
            if d not in skip[i] and s > 0:
                scores.append((-round(s, 6), d))
        best = sorted(got.get(f"q{i}", []))[:4]
        assert [x[1] for x in best] == [x[1] for x in sorted(scores)[:4]] and np.allclose([x[0] for x in best], [x[0] for x in sorted(scores)[:4]], atol=1e-9)


def test_queries_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("red green blue grey pink".split()) for _ in range(rng.randrange(6)))) for i in range(40)], "id int, text string").cache()
    index = retrieval.Index.fit(docs, "id", "text")
    whole = sorted(map(tuple, index.search_own("id % 2 = 0", 5).collect()))
    monkeypatch.setattr(retrieval, "SLICE", 3)
    assert sorted(map(tuple, index.search_own("id % 2 = 0", 5).collect())) == whole and len({r[0] for r in whole}) > 9


def test_blocks_are_bounded_by_words(monkeypatch):
    monkeypatch.setattr(vectors, "WORDS", 10)
    words = pa.array([[["a"] * 3, ["b"] * 2], [["c"] * 5], [], [["d"] * 12], [["e"] * 4]] * 3, pa.list_(pa.list_(pa.string())))
    got = list(vectors.blocks(iter(pa.table({"words": words}).to_batches()), "words"))
    sizes = [[sum(map(len, texts)) for texts in t.column("words").to_pylist()] for t in got]
    assert sum(sizes, []) == [5, 5, 0, 12, 4] * 3 and all(sum(s) <= 10 or len(s) == 1 for s in sizes)


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_a_task_returns_no_more_than_k_rows_of_a_query(monkeypatch, least):
    rng = np.random.default_rng(7)
    terms = [sorted(rng.choice(8, rng.integers(1, 5), replace=False).tolist()) for _ in range(50)]
    index = pa.table({"id": rng.permutation(50), "codes": pa.array(terms, pa.list_(pa.int32())), "ns": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32())), "kinds": [["a"]] * 50})
    asked = index.select(["id", "codes", "ns"]).append_column("skip", pa.array([[x] for x in index.column("id").to_pylist()], pa.list_(pa.int64())))
    idf = np.linspace(1, 2, 8)

    def run():
        batches = vectors.best(SimpleNamespace(value=vectors.sent(asked, idf)), SimpleNamespace(value=(None, idf)), 3, least)(iter(index.to_batches(max_chunksize=5)))
        return sorted((r["query_id"], -r["score"], r["id"]) for b in batches for r in b.to_pylist())

    whole = run()
    monkeypatch.setattr(vectors, "ROWS", 6)
    assert run() == whole and max(np.bincount([r[0] for r in whole])) == 3


@pytest.mark.parametrize("name", ["retrieve_topk", "retrieval_retry"])
def test_no_shuffle_files_stay_once_a_search_is_staged(spark, name):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    before = left()
    entry.queries()[name](spark, SF)
    until = time.time() + 10
    while left() - before > 5000 and time.time() < until:
        time.sleep(0.2)
    assert left() - before <= 5000


def same_as_sql(spark, at, name):
    duck = pytest.importorskip("duckdb").connect()
    for p in at.glob("*.parquet"):
        duck.execute(f"create view {p.stem} as select * from '{p}'")
    cur = duck.execute(entry.oracle_sql()[name])
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    got = [r.asDict() for r in entry.queries()[name](spark, str(at)).collect()]
    order = lambda rows: sorted((dict(sorted(r.items())) for r in rows), key=str)
    assert order(got) == order(want)
    return got


def texts(rng, n):
    return [" ".join(rng.choice("red green blue grey pink late lost broken".split()) for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def test_quality_is_of_every_document(spark, tmp_path):
    rng = random.Random(4)
    ids = [i for i in range(1, 45) if i % 20]
    pq.write_table(pa.table({"doc_id": ids, "text": texts(rng, len(ids)), "doc_kind": [rng.choice(["a", "b", None]) for _ in ids]}), tmp_path / "documents.parquet")
    (row,) = same_as_sql(spark, tmp_path, "retrieval_quality")
    assert row["queries"] == len(ids)


def test_every_message_is_searched(spark, tmp_path):
    rng = random.Random(6)
    pq.write_table(pa.table({
        "resolution_id": [f"r{i}" for i in range(30)], "conversation_id": [f" C{i}" for i in range(30)], "customer_text": texts(rng, 30), "brand_text": ["sorry"] * 30,
        "intent": [rng.choice(["late_delivery", "lost_item"]) for _ in range(30)]}), tmp_path / "historical_resolution.parquet")
    ids = [f"e-{i}" for i in range(1, 42) if i % 20]
    pq.write_table(pa.table({
        "example_id": ids, "conversation_id": [f"c{rng.randrange(60)}" for _ in ids], "customer_message": [f"{x} {y}" for x, y in zip(texts(rng, len(ids)), ["unheard of words"] * 20 + [""] * len(ids))],
        "pred_intent": [rng.choice(["late_delivery", "other_unclear", None]) for _ in ids], "intent_confidence": [rng.random() for _ in ids]}), tmp_path / "agent_evaluation.parquet")
    assert len(same_as_sql(spark, tmp_path, "retrieval_retry")) == len(ids)
