import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from supportlens.operators.packed import parse_field, unpack

CASES = {
    "10002": ["10002"], '"100015"': ["100015"], "100008,8334": ["100008", "8334"], "100007.0": ["100007"], '"1,827"': ["1827"], '"1,000,017"': ["1000017"],
    "['100309', \"200\"]": ["100309", "200"], "[100000]": ["100000"], "100057,": ["100057"], ",104811,13137": ["104811", "13137"], '"1,033";"59,679"': ["1033", "59679"],
    '"109842,86200,109842"': ["109842", "86200", "109842"], "102920 | 11246": ["102920", "11246"], "113027\n169686": ["113027", "169686"], "105940,,14266,": ["105940", "14266"],
    "105579.0;48920.0": ["105579", "48920"], "null": [], "nan": [], "[]": [], " ": [], ",": [], None: [], "": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_forms(text):
    assert [v for v, _ in parse_field(text)] == CASES[text]
    assert all(e is None for _, e in parse_field(text))


def test_malformed_quotes_backtrack_and_are_flagged():
    assert parse_field('"1234, 5678') == [("1234", "malformed"), ("5678", "malformed")]
    assert parse_field("12345]") == [("12345", None)]
    assert [v for v, _ in parse_field("[\"1234\", '5678]")] == ["1234", "5678"]
    assert parse_field("abc,1234") == [("abc", "not_an_id"), ("1234", None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1000, 10**9), max_size=6), st.sampled_from([",", ";", " | ", "/", "\n", " "]), st.sampled_from(["{}", '"{}"', "'{}'", "{}.0"]), st.sampled_from(["{}", "[{}]", " {} ", ",{},"]))
def test_round_trip(ids, sep, dress, around):
    assert [v for v, _ in parse_field(around.format(sep.join(dress.format(i) for i in ids)))] == [str(i) for i in ids]


def test_any_text_ends():
    for text in ("\"'" * 60, "[" * 300, "[\"" * 25, "1," * 50_000, "x" * 100_000):
        parse_field(text)


def test_deep_nesting_and_many_failures_end_soon():
    import time

    began = time.time()
    n = 5000
    assert parse_field("[" * n + "1" + "]" * n) == [("1", None)]
    assert parse_field("[" * n + "1]") == [("1", "malformed")]
    assert [v for v, _ in parse_field("['" * n + "12")] == ["12"]
    assert [v for v, _ in parse_field("[" + "'1', " * n)] == ["1"] * n
    assert [v for v, _ in parse_field("\"'[" * n + "7" + "]'\"" * (n - 1))] == ["7"]
    assert time.time() - began < 10


def test_table(spark):
    df = spark.createDataFrame([("1", "2000,2000", 5), ("2", None, 5), ("3", "[]", 5)], "id string, f string, position int")
    assert [tuple(r) for r in unpack(df, "id", "f").orderBy("position").collect()] == [("1", 1, "2000", None), ("1", 2, "2000", None)]
    assert unpack(df.limit(0), "id", "f").count() == 0
