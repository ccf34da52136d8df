import json

import pytest
from pyspark.sql import functions as F

from supportlens.operators import evidence as E
from supportlens.operators import judging, splits
from supportlens.sources import files

GUARD = "reply string, used array<string>, known array<string>, allowed array<string>, grounded boolean, action string"


def guarded(spark, *rows):
    df = spark.createDataFrame(list(rows), GUARD)
    return [(r["verified_text"], r["verified_ids"], r["verified_urls"], r["verified_action"], r["verified_grounded"]) for r in E.guard(df, "reply", "used", "known", "allowed", "grounded", "action").collect()]


def test_guard_keeps_what_the_evidence_holds(spark):
    a, b, c, d = guarded(
        spark,
        ("See https://a.b/c now", ["r1", "rx"], ["r1"], ["https://a.b/c"], True, "AUTO_HANDLE"),
        ("See https://fake.x/y now", ["rx"], ["r1"], ["https://a.b/c"], True, "AUTO_HANDLE"),
        ("See https://fake.x/y", ["r1"], ["r1"], [], True, "AUTO_HANDLE"),
        (None, None, None, None, None, None),
    )
    assert a == ("See https://a.b/c now", ["r1"], ["https://a.b/c"], "AUTO_HANDLE", True)
    assert b == ("See  now", [], [], "ASK_CLARIFICATION", False)  # the only link is made up and no id is left
    assert c == ("See", ["r1"], [], "AUTO_HANDLE", True)
    assert d == ("", [], [], None, False)


def test_sufficiency_and_retry(spark):
    df = spark.createDataFrame([(0.35, True), (0.25, True), (0.2499, True), (None, True), (0.9, False), (None, None)], "s double, h boolean")
    assert [r[0] for r in df.select(E.sufficiency(F.col("s"), F.col("h"))).collect()] == ["sufficient", "borderline", "insufficient", "insufficient", "empty", "empty"]
    rows = spark.createDataFrame([(0.3, 0.3), (0.3, 0.31), (None, 0.1), (0.2, None)], "a double, b double")
    assert [(r["adopted"], r["final_similarity"]) for r in E.adopt(rows, "a", "b").collect()] == [(False, 0.3), (True, 0.31), (True, 0.1), (False, 0.2)]
    t = spark.createDataFrame([("borderline", 0.5, "battery"), ("borderline", 0.49, "battery"), ("borderline", 0.9, E.OTHER), ("sufficient", 0.9, "battery"), ("borderline", None, "battery"), ("borderline", 0.9, None)], "s string, c double, i string")
    assert [r[0] for r in t.select(E.may_retry(F.col("s"), F.col("c"), F.col("i"))).collect()] == [True, False, False, False, False, False]


def test_serialized_refuses_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan")), ("c", float("inf")), ("d", None)], "id string, x double")
    got = {r["id"]: (r["response"], r["error"]) for r in E.serialized(df, {"id": F.col("id"), "x": F.col("x")}).collect()}
    assert json.loads(got["a"][0]) == {"id": "a", "x": 1.5} and json.loads(got["d"][0]) == {"id": "d", "x": None}
    assert got["b"] == (None, "not finite") and got["c"] == (None, "not finite")


def test_validator_takes_integers_alone(spark):
    good = {d: 4 for d in judging.DIMENSIONS}
    cases = {
        "fine": json.dumps(good), "fenced": "```json\n" + json.dumps(good) + "\n```", "bool": json.dumps({**good, "tone": True}), "fraction": json.dumps({**good, "tone": 4.0}), "text": json.dumps({**good, "tone": "4"}),
        "six": json.dumps({**good, "tone": 6}), "missing": json.dumps({k: v for k, v in good.items() if k != "tone"}), "overall": json.dumps({**good, "overall": 4.5}), "over": json.dumps({**good, "overall": 5.5}), "prose": "four", "null": None, "blank": " ",
    }
    df = spark.createDataFrame(list(cases.items()), "k string, answer string")
    got = {r["k"]: (r["error"], r["mean"], r["overall"]) for r in judging.validated(df, "answer").collect()}
    assert got["fine"] == got["fenced"] == (None, 4.0, 4.0) and got["overall"] == (None, 4.0, 4.5)
    assert all(got[k][0] == "not an integer from 1 to 5" and got[k][1] is None for k in ("bool", "fraction", "text", "six"))
    assert got["missing"][0] == "missing dimension" and got["over"][0] == "overall out of range" and got["prose"][0] == "no object" and got["null"][0] == got["blank"][0] == "empty"


def test_a_failing_judge_leaves_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string").coalesce(1)

    def call(frame):
        frame["mark"] = 3
        return frame

    def broken(frame):
        raise OSError

    assert {tuple(r) for r in judging.judged(df, call, "mark int").collect()} == {("a", 3, "SUCCESS"), ("b", 3, "SUCCESS")}
    assert {tuple(r) for r in judging.judged(df, broken, "mark int").collect()} == {("a", None, "FAILED"), ("b", None, "FAILED")}


def test_gold_columns_never_reach_a_judge(spark):
    df = spark.createDataFrame([("a", "x", "g"), ("b", " ", "g"), ("c", None, "g")], "example_id string, raw_reply_text string, gold_intent string")
    u = judging.units(df)
    assert u.columns == ["example_id", "raw_reply_text"] and u.count() == 1
    with pytest.raises(ValueError, match="gold_risk"):
        judging.units(df.withColumn("inner", F.struct(F.lit(1).alias("gold_risk"))))


def manifest(spark, rows):
    return spark.createDataFrame(rows, "id string, split string")


def test_split_rules_raise(spark, tmp_path):
    own = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    golden = own.filter("id = 'e'")
    good = manifest(spark, [("a", "train"), ("b", "dev"), ("c", "test"), ("d", "train")])
    splits.check(good, "id", own, golden)
    for bad, why in (([("a", "train"), ("a", "train")], "repeated"), ([("a", "train"), ("a", "dev")], "several"), ([("e", "train")], "golden"), ([("a", "train")], "without a split"), ([(x, "train") for x in "abcdz"], "unknown")):
        with pytest.raises(splits.SplitError, match=why):
            splits.check(manifest(spark, bad), "id", own, golden)
    with pytest.raises(splits.SplitError):
        splits.no_leak(own, golden, "id")
    splits.no_leak(good.filter("split = 'train'"), golden, "id")
    files.write_manifest(good, "id", str(tmp_path / "m"))
    assert files.read_manifest(spark, "id", str(tmp_path / "m"), own, golden).count() == 4
    manifest(spark, [("a", "train"), ("a", "dev")]).write.json(str(tmp_path / "n"))
    with pytest.raises(splits.SplitError):
        files.read_manifest(spark, "id", str(tmp_path / "n"))
    got = splits.assign(own, "id", golden=golden)
    assert {r["id"] for r in got.collect()} == set("abcd")


def test_first_seen_blend_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), (None, 0, "x"), ("j", 5, None)], "key string, n int, v string")
    assert sorted(map(tuple, splits.first_seen(df, "key", "n").collect())) == [("j", 5, None), ("k", 1, "early")]
    b = spark.createDataFrame([(str(i), "other_unclear" if i < 25 else "x") for i in range(40)], "id string, l string")
    assert sorted(r["l"] for r in splits.blend(b, "l", "id").collect()).count("other_unclear") == 2
    assert [r["n"] for r in splits.first_n(df, "n", 2).collect()] == [0, 1]
    assert [r["key"] for r in files.distinct_ids(df.filter("key is not null"), "key", "n").collect()] == ["k", "j"]
    with pytest.raises(ValueError):
        files.distinct_ids(df, "key", "n")
    assert files.annotation_sheet(df).columns == ["key", "n", "v", "gold_intent", "gold_risk", "gold_action", "annotation_notes"]
    with pytest.raises(ValueError):
        files.annotation_sheet(df.withColumn("gold_risk", F.lit("")))
    p = tmp_path / "g.csv"
    p.write_text("example_id,conversation_id,gold_intent\n1,a,x\n2,b,y\n")
    assert files.load_golden(spark, str(p), 2).count() == 2
    with pytest.raises(ValueError):
        files.load_golden(spark, str(p), 3)
    (tmp_path / "c.json").write_text('{"conversation_id":"k"}\n{"broken\n')
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error for a broken line
        files.read_conversations(spark, str(tmp_path / "c.json"), strict=True).collect()


def test_settings(tmp_path):
    assert files.Settings.load() == files.Settings() and files.Settings.load(str(tmp_path / "none.json")) == files.Settings()
    (tmp_path / "s.json").write_text('{"enough": 0.4, "top_k": 5}')
    assert files.Settings.load(str(tmp_path / "s.json"), top_k=7, attempts=None) == files.Settings(enough=0.4, top_k=7)
    (tmp_path / "t.json").write_text('{"nothing": 1}')
    with pytest.raises(TypeError):
        files.Settings.load(str(tmp_path / "t.json"))


def test_threads_by_both_link_fields(spark):
    import datetime as dt

    from supportlens.operators import threads

    raw = spark.createDataFrame([("10", None, "20,30"), ("11", "nan", '"20"'), ("20", "10, 11", "[40]"), ("30", None, None), ("40", "20.0", ""), (None, "10", "20")], "tweet_id string, up string, down string")
    named = threads.links(raw, "tweet_id", "up", "down")
    assert {tuple(r) for r in named.collect()} == {("10", "20"), ("10", "30"), ("11", "20"), ("20", "40")}
    t0 = dt.datetime(2024, 3, 1)
    m = spark.createDataFrame([(i, a, a != "b", t0 + dt.timedelta(hours=h), None) for i, a, h in (("10", "c", 0), ("11", "d", 1), ("20", "b", 2), ("30", "b", 3), ("40", "c", 4))], "tweet_id string, author string, inbound boolean, ts timestamp, parent_id string")
    edges = threads.reply_edges(m, named=named).cache()
    want = {("b", "c", "10", "10"), ("b", "c", "10", "20"), ("b", "c", "10", "30"), ("b", "c", "10", "40"), ("b", "d", "11", "11"), ("b", "d", "11", "20")}
    assert {tuple(r) for r in threads.edge_components(edges).collect()} == want  # the reply 20 is in a component of each customer
    assert {tuple(r) for r in threads.edge_components(edges, max_local=0).collect()} == want
    got = {(r["conversation_id"], r["position"], r["tweet_id"]) for r in threads.conversations(m, named=named).collect()}
    assert got == {("conv_000001", 1, "10"), ("conv_000001", 2, "20"), ("conv_000001", 3, "30"), ("conv_000001", 4, "40"), ("conv_000002", 1, "11"), ("conv_000002", 2, "20")}


def test_components_against_brute_force(spark):
    import random

    from supportlens.operators import threads

    rng = random.Random(3)
    rows = [(str(rng.randrange(40)), str(rng.randrange(40)), rng.choice("cd"), rng.choice("ab")) for _ in range(70)]
    want = set()
    for pair in {(r[3], r[2]) for r in rows}:
        groups = []
        for p, c, cu, br in rows:
            if (br, cu) == pair:
                met = [g for g in groups if g & {p, c}]
                groups = [g for g in groups if g not in met] + [set().union({p, c}, *met)]
        want |= {(*pair, min(g), x) for g in groups for x in g}
    edges = spark.createDataFrame(rows, "parent_id string, child_id string, customer string, brand string").cache()
    for n in (0, 10, 100):
        assert {tuple(r) for r in threads.edge_components(edges, max_local=n).collect()} == want
    assert threads.edge_components(edges.limit(0)).count() == 0


def test_index_of_words_and_pairs(spark, tmp_path):
    from supportlens.operators import retrieval

    df = spark.createDataFrame([(1, "battery drain fast", "a"), (2, "drain battery now", "b"), (3, "battery drain again", "b"), (4, None, "a"), (5, "", "a")], "id int, text string, kind string").cache()
    index = retrieval.Index.fit(df, "id", "text", min_df=1)
    best = retrieval.retrieve(index.queries(df.filter("id = 1"), "id", "text"), index.weights, index.ids, 3, 0.01)
    assert [r["id"] for r in best.orderBy("rank").collect()] == [1, 3, 2]  # the order of words counts
    asked = index.queries(df.filter("id = 1"), "id", "text").withColumn("want", F.lit("b"))
    held = index.weights.join(df.select("id", "kind"), "id")
    assert [r["id"] for r in retrieval.retrieve(asked, held, index.ids, 3, 0.01, kinds=("want", "kind")).orderBy("rank").collect()] == [3, 2]
    free = asked.withColumn("want", F.lit(None).cast("string"))
    assert retrieval.retrieve(free, held, index.ids, 3, 0.01, kinds=("want", "kind")).count() == 3
    with pytest.raises(ValueError):
        retrieval.retrieve(asked, held, index.ids, 3, kinds=("want", "kind"))
    small = retrieval.Index.fit(df, "id", "text", min_df=1, max_features=2)
    assert {r["term"] for r in small.inverse.collect()} == {"battery", "drain"}  # met most often
    index.save(str(tmp_path / "i"))
    again = retrieval.Index.load(spark, str(tmp_path / "i"))
    assert again.settings == index.settings and again.weights.exceptAll(index.weights).count() == 0
    with pytest.raises(ValueError):
        retrieval.Index.fit(df.limit(0), "id", "text")
