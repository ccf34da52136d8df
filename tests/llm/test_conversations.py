import datetime as dt

from supportlens.llm import conversations as C

SCHEMA = "line_no long, tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, loaded_at timestamp, root_id int"
T0 = dt.datetime(2024, 3, 1)


def rows(spark, items):
    out = []
    for n, (i, author, inbound, minute, text, parent) in enumerate(items, 1):
        at = minute if isinstance(minute, str) or minute is None else (T0 + dt.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
        out.append((n, i, author, inbound, at, text, None, parent, T0 + dt.timedelta(days=n % 3) if n % 5 else None, 0))
    return spark.createDataFrame(out, SCHEMA)


ITEMS = [
    ("1001", "77", "True", 0, "help", None), ("1002", "Brand", "False", 5, "do this", "1001.0"), ("1003", "77", None, 6, "thanks", "'1002'"), ("1004", "77", "True", 7, " ​", "1003"),  # kept, without the blank one
    ("2001", "78", "True", 0, "a", None), ("2002", "@BRAND", None, "junk", "b", "2001"),  # an unreadable time
    ("3001", "79", "True", 0, "a", "999999"), ("3002", "Brand", "0", 1, "b", "3001"),  # the parent is not there
    ("4001", "80", "1", 0, "a", "4002"), ("4002", "Brand", "0", 1, "b", "4001"),  # a cycle
    ("5001", "Brand", "False", 0, "a", None), ("5002", "81", "True", 1, "b", "5001"),  # no answer after the question
    ("10", "82", "True", 3, "a", None), ("9", "Brand", "False", 3, "b", "10"),  # equal times go by the id as a string
    (None, "82", "True", 3, "a", None), ("1001", "77", "True", 0, "help!", None),  # the later line holds
]
WANT = {("1001", 1, "1001", "customer"), ("1001", 2, "1002", "brand"), ("1001", 3, "1003", "customer"), ("10", 1, "10", "customer"), ("10", 2, "9", "brand")}


def accounts(spark):
    return spark.createDataFrame([("Brand", "B")], "author_id string, brand string")


def test_rules_by_stream_and_by_ranking(spark):
    df = rows(spark, ITEMS)
    for bound in (100_000, 0):  # all in streaming state; all by distributed ranking
        assert {tuple(r) for r in C.rebuild(df, accounts(spark), max_local=bound).collect()} == WANT


def test_empty_table(spark):
    assert C.rebuild(rows(spark, ITEMS).limit(0), accounts(spark)).count() == 0


def test_late_messages_join_their_conversation_over_several_batches(spark, tmp_path):
    """Two micro-batches: the answer comes in the second, late but within the watermark."""
    us = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    first = [(0, "r", "1", us, False, True, False, T0), (0, "old", "8", us, False, True, False, T0), (0, "old", "9", us + 1, True, True, False, T0)]
    second = [(0, "r", "2", us + 5, True, True, False, T0 + dt.timedelta(days=3))]
    end = [(C._MARKER, None, None, None, None, None, None, T0 + dt.timedelta(days=400))]
    for k, part in enumerate((first, second, end)):
        spark.createDataFrame(part, C.MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(C.MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = C.assemble(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("r", 1, "1", "customer"), ("r", 2, "2", "brand"), ("old", 1, "8", "customer"), ("old", 2, "9", "brand")}


def test_arrivals_outside_of_the_watermarks_range_are_kept(spark):
    """Null, before 1970 and far in the future."""
    times = [None, dt.datetime(1960, 1, 1), dt.datetime(2300, 1, 1), T0]
    items = [(n, f"{9000 + 10 * k + n}", "77" if n == 1 else "Brand", str(n == 1), T0.strftime("%Y-%m-%dT%H:%M:%SZ"), "a", None, None if n == 1 else f"{9001 + 10 * k}", at, 0) for k, at in enumerate(times) for n in (1, 2)]
    want = {(str(9001 + 10 * k), n, f"{9000 + 10 * k + n}", "customer" if n == 1 else "brand") for k in range(4) for n in (1, 2)}
    assert {tuple(r) for r in C.rebuild(spark.createDataFrame(items, SCHEMA), accounts(spark)).collect()} == want


def test_replay_in_slices_by_arrival(spark):
    """Several micro-batches in the order of arrival give the same, as long as no conversation pauses longer than ``idle``."""
    df = rows(spark, ITEMS)
    assert {tuple(r) for r in C.rebuild(df, accounts(spark), slices=3).collect()} == WANT


def test_what_the_watermark_drops_is_counted(spark):
    us = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    near, far = T0, T0 + dt.timedelta(days=100)
    # the first slice ends with an arrival so late that the next one is behind the watermark: brought in the wrong order
    messages = [(0, "a", "1", us, False, True, False, far), (0, "b", "2", us, False, True, False, near)]
    df = spark.createDataFrame(messages, C.MESSAGE)
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        df.filter("root_id = 'a'").coalesce(1).write.parquet(f"{d}/in")
        run = lambda: C.assemble(spark.readStream.schema(C.MESSAGE).parquet(f"{d}/in")).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start()
        q = run()
        q.awaitTermination()
        assert C.dropped_late(q) == 0
        df.filter("root_id = 'b'").coalesce(1).write.mode("append").parquet(f"{d}/in")
        q = run()
        q.awaitTermination()
        assert C.dropped_late(q) == 1
