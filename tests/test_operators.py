import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from supportlens.functions import ids
from supportlens.functions import text as T
from supportlens.operators import classify, metrics, retrieval, review, rules, splits, threads
from supportlens.sources import files
from supportlens.streaming import scorer


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [("100", "100"), (" 1000.0 ", "1000"), ("'55'", "55"), ('"1,000,017"', "1000017"), ("nan", None), ("", None), (None, None), ("12,34", None)])
def test_bare_id(spark, raw, want):
    assert one(spark, raw, ids.bare_id) == want


@pytest.mark.parametrize("raw, want", [("Tue Oct 31 22:10:47 +0000 2017", "2017-10-31 22:10:47"), ("2017-10-31T23:10:47+01:00", "2017-10-31 22:10:47"), ("1509487847", "2017-10-31 22:10:47"), ("1509487847000", "2017-10-31 22:10:47"), ("31 Oct 2017 22:10:47 UTC", "2017-10-31 22:10:47"), ("0000-00-00 00:00:00", None), ("NaT", None), (None, None)])
def test_instant(spark, raw, want):
    got = one(spark, raw, ids.instant)
    assert (got and got.strftime("%Y-%m-%d %H:%M:%S")) == want


def test_flag_and_visible(spark):
    assert [one(spark, x, ids.flag) for x in (" True", "0", "x", None)] == [True, False, None, None]
    assert [one(spark, x, ids.visible) for x in ("a", " ​\t", None, "🙂")] == [True, False, False, True]


def test_text_functions(spark):
    assert one(spark, "  Hi @Bob see https://a.b/c, NOW x ", T.normalize) == "hi see now x"
    assert one(spark, "see https://a.b/c, and http://d.e).", T.urls) == ["https://a.b/c", "http://d.e"]
    assert one(spark, "@Bob  hello", T.strip_handle) == "hello"
    assert one(spark, "a b  c", T.word_count) == 3
    assert one(spark, "<a & 'b'>", T.html_escape) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, ["a", "b", "c"], lambda c: T.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: T.ngrams(c, 2), "array<string>") == []


M = "tweet_id string, author string, inbound boolean, ts timestamp, text string, parent_id string"


def msgs(spark, rows):
    t0 = dt.datetime(2024, 3, 1)
    return spark.createDataFrame([(i, a, b, None if s is None else t0 + dt.timedelta(seconds=s), "x", p) for i, a, b, s, p in rows], M)


DAY = 86_400


def test_edges_and_conversations(spark):
    rows = [
        ("1", "c", True, 0, None), ("2", "b", False, 7 * DAY, "1"),  # exactly seven days: joined
        ("3", "c", True, 0, None), ("4", "b", False, 7 * DAY + 1, "3"),  # a second more: not
        ("5", "c", True, 10, None), ("6", "b", False, 5, "5"),  # the answer is older: not
        ("7", "c", True, None, None), ("8", "b", False, 5, "7"),  # no time
        ("9", "b", False, 0, None), ("10", "b", False, 1, "9"),  # brand only
    ]
    m = msgs(spark, rows)
    assert [(r["parent_id"], r["child_id"], r["customer"], r["brand"]) for r in threads.reply_edges(m).collect()] == [("1", "2", "c", "b")]
    assert [tuple(r)[:3] for r in threads.conversations(m).orderBy("position").collect()] == [("conv_000001", 1, "1"), ("conv_000001", 2, "2")]
    assert threads.conversations(m.limit(0)).count() == 0


def test_gap_segments_and_ties(spark):
    m = msgs(spark, [("10", "c", True, 0, None), ("9", "c", True, 0, None), ("3", "c", True, DAY, None), ("4", "c", True, 2 * DAY + 1, None), ("5", "c", True, None, None)])
    got = threads.gap_segments(m, ["author"], 1).select("tweet_id", "segment").collect()
    assert dict(map(tuple, got)) == {"10": 1, "9": 1, "3": 1, "4": 2, "5": 3}


def test_splits(spark):
    ids_ = spark.range(90).select(F.col("id").cast("string").alias("id"))
    got = splits.assign(ids_, "id")
    assert dict(map(tuple, got.groupBy("split").count().collect())) == {"train": 63, "dev": 14, "test": 13}
    assert got.exceptAll(splits.assign(ids_.repartition(7), "id")).count() == 0
    with pytest.raises(ValueError):
        splits.assign(ids_, "id", (0.7, 0.2, 0.2))
    bad = spark.createDataFrame([("a", "train"), ("A ", "Test"), ("b", "dev")], "id string, split string")
    assert {tuple(r) for r in splits.violations(bad, spark.createDataFrame([("a",), ("c",)], "id string"), "id").collect()} == {("several splits", "a"), ("no split", "c"), ("unknown", "b")}


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, "big" if i else "small") for i in range(50)], "id int, s string")
    got = splits.round_robin(df, ["s"], "id", 5).collect()
    assert len(got) == 5 and [r["s"] for r in got[:2]] == ["big", "small"]


def test_retrieval_against_brute_force_with_backfill(spark):
    import math
    import re

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["cloud", "backup", "battery", "drain", "wifi", "router"]) for _ in range(rng.randrange(1, 6)))) for i in range(12)] + [(50, ""), (51, None), (52, "zzz")]
    df = spark.createDataFrame(docs, "id int, text string")
    counts = retrieval.term_counts(df, "id", "text").cache()
    inverse = retrieval.idf(counts, len(docs))
    w = retrieval.weights(counts, inverse).cache()
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.retrieve(w, w, df, 10).collect()}

    tf = {i: {t: re.findall(r"\w{2,}", x or "").count(t) for t in set(re.findall(r"\w{2,}", x or ""))} for i, x in docs}
    dfreq = {t: sum(t in d for d in tf.values()) for d in tf.values() for t in d}
    vec = {}
    for i, d in tf.items():
        v = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + dfreq[t])) + 1) for t, n in d.items() if dfreq[t] >= 2}
        n = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {t: x / n for t, x in v.items()}
    for q, v in vec.items():
        if v:
            best = sorted(((-round(sum(x * vec[i].get(t, 0) for t, x in v.items()), 6), i) for i in vec))[:10]
            assert [got[q, r][0] for r in range(1, 11)] == [i for _, i in best]
    assert not any(q in (50, 51, 52) for q, _ in got)


def test_metrics_vector(spark):
    rows = [("a", "a", 0.95)] * 3 + [("a", "b", 0.4), ("b", "b", 0.9), ("b", "b", 0.91), ("b", "b", 0.6), ("c", "c", 0.7), ("c", "c", 0.8), ("c", "a", 0.55)]
    df = spark.createDataFrame(rows, "g string, p string, c double")
    per = {r["class"]: r for r in metrics.per_class(df, "g", "p").collect()}
    assert (per["a"]["support"], per["a"]["precision"], per["b"]["precision"], per["c"]["recall"]) == (4, 0.75, 0.75, 0.6667)
    b = {r["low"]: (r["n"], r["accuracy"]) for r in metrics.buckets(df, "c", F.col("g") == F.col("p"), [0.0, 0.5, 0.9]).collect()}
    assert b == {0.0: (1, 0.0), 0.5: (4, 0.75), 0.9: (5, 1.0)}
    assert metrics.buckets(df.limit(0), "c", F.col("g") == F.col("p"), [0.0]).first()["n"] == 0
    s = metrics.sweep(df, [0.55], "g", "p", "c", "other_unclear").first()
    assert s["coverage"] == 0.9  # equal to the threshold stays


def test_rules(spark):
    assert one(spark, "My screen is cracked and it is scorching!!", lambda c: rules.level(c)) == "critical"
    assert one(spark, "Screen cracked", lambda c: rules.signals(c)) == ["DAMAGE:cracked"]
    assert one(spark, "hello", lambda c: rules.first_label(c)) == "other"
    assert one(spark, "refund for wifi", lambda c: rules.labels(c)) == ["billing", "connectivity"]


def test_classifier_abstains_strictly_below(spark):
    rows = [(f"battery drains fast {i}", "battery") for i in range(6)] + [(f"wifi drops often {i}", "wifi") for i in range(6)]
    df = spark.createDataFrame(rows, "t string, l string")
    model = classify.fit(df, "t", "l")
    got = classify.predict(model, df, "t").collect()
    assert sum(r["intent"] == r["l"] for r in got) >= 11
    top = max(r["confidence"] for r in got)
    assert not classify.predict(model, df, "t", top).orderBy(F.desc("confidence")).first()["abstained"]
    with pytest.raises(ValueError):
        classify.fit(df.limit(0), "t", "l")
    with pytest.raises(ValueError):
        classify.fit(df.withColumn("l", F.lit("other_unclear")), "t", "l")


def test_files(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id,more\n01,a,True,x,"two\nlines, ""q""",,3,z\n')
    r = files.read_raw_csv(spark, str(p)).collect()
    assert len(r) == 1 and r[0]["tweet_id"] == "01" and r[0]["text"] == 'two\nlines, "q"'
    p.write_text("tweet_id\n1\n")
    with pytest.raises(ValueError, match="author_id, created_at"):
        files.read_raw_csv(spark, str(p))
    (tmp_path / "c.json").write_text('{"conversation_id":"k","brand":"b","tweets":[{"tweet_id":"1","text":"x"},{"tweet_id":"2"}]}\n\n{"broken\n')
    assert [tuple(x)[:4] for x in files.conversation_messages(files.read_conversations(spark, str(tmp_path / "c.json"))).select("conversation_id", "brand", "position", "tweet_id").collect()] == [("k", "b", 0, "1"), ("k", "b", 1, "2")]
    files.write_csv(spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["v"] == "x;y"
    with pytest.raises(ValueError, match="v.gold"):
        files.forbid(spark.createDataFrame([((1,),)], "v struct<gold: int>"), {"gold"})


def test_stream_equals_batch(spark, tmp_path):
    m = msgs(spark, [("1", "c", True, 0, None), ("2", "c", True, 10, None), ("3", "c", True, 3 * DAY, None), ("4", "d", True, 40 * DAY, None)])
    m.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))
    assert scorer.replay(scorer.score(stream), "t1").exceptAll(scorer.score(m)).count() == 0
    got = scorer.replay(scorer.sessions(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), "author"), "t2")
    assert sorted((r["author"], r["messages"]) for r in got.collect()) == [("c", 1), ("c", 2)]


def test_review(spark):
    assert [one(spark, x, review.request_error) for x in ("hi", " ", None, "x" * 4001)] == [None, "blank", "missing", "too long"]
    assert [one(spark, x, review.parsed_score) for x in ('```json\n{"score": 4}\n```', '{"score": 6}', '{"score": 3.5}', "score 4", '{"score": true}', None)] == [4, None, None, None, None, None]
    df = spark.createDataFrame([("a b | [brand] my phone died", "my phone died"), ("my phone dies now | thanks", "my phone died now"), (None, "x"), ("a", None)], "c string, m string")
    assert sorted(map(tuple, review.turn_position(df, "c", "m").select("m", "turn").na.fill("-", ["m"]).collect())) == [("-", 0), ("my phone died", 1), ("my phone died now", 0), ("x", -1)]
