from pyspark.sql import functions as F

from supportlens.llm import copies
from supportlens.llm.copies import collapsed, copy_groups

ROWS = [
    ("1", "My Mira will not charge!", "Use the cable."), ("2", "my mira\n WILL not charge", "use, the cable"),  # dress
    ("3", "Use the Cable", "MY MIRA WILL NOT CHARGE."),  # changed places
    ("4", "Device: Mira 6 | Problem: it is dead | Case: 77", "ok"), ("5", "CASE:77\nDEVICE:MIRA 6\nPROBLEM:IT IS DEAD", "OK"),  # order of fields
    ("6", "device Mira 6 problem it is dead case 77", "ok"),  # colons lost, fields in the order of 4
    ("7", "dead it is problem", "ok"), ("8", None, "x y"), ("9", "", "X-Y"), ("10", None, None), ("11", "🙂", ""),
    ("12", "Straße", "q"), ("13", "STRASSE", "q"), (None, "My Mira will not charge!", "Use the cable."), ("1", "My Mira will not charge!", "Use the cable."),
]


def test_groups(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "rid string, a string, b string, id string")
    got = {(r["kept_id"], r["id"], r["copies"]) for r in copy_groups(df, "rid", "a", "b").collect() if r["id"] != r["kept_id"]}
    assert got == {("1", "2", 3), ("1", "3", 3), ("4", "5", 3), ("4", "6", 3), ("8", "9", 2), ("10", "11", 2), ("12", "13", 2)}
    assert {tuple(r) for r in collapsed(df, "rid", "a", "b").collect()} == {("1", 3), ("4", 3), ("7", 1), ("8", 2), ("10", 2), ("12", 2)}


def test_empty_and_long(spark):
    df = spark.createDataFrame([("1", "a" * 300_000, None), ("2", "A " * 300_000, "")], "rid string, a string, b string")
    assert [r["kept_id"] for r in copy_groups(df, "rid", "a", "b").collect()] == ["1", "1"]
    assert copy_groups(df.limit(0), "rid", "a", "b").count() == 0


def test_the_full_comparison_tells_equal_digests_apart(spark, monkeypatch):
    df = spark.createDataFrame([*ROWS, ("20", "Note: abc | Kind: x", "q"), ("21", "Note: acb | Kind: x", "q"), ("22", "Kind: x; Note: acb", "q")], "rid string, a string, b string")
    want = {tuple(r) for r in copy_groups(df, "rid", "a", "b").collect()}
    assert ("22", "21", 2) in want and not any(r[0] == "20" for r in want)
    # a digest that anagrams share, as a stand-in for one that collides
    monkeypatch.setattr(copies, "_root", lambda a, b: F.md5(F.array_join(F.array_sort(F.split(F.concat(a, b), "")), "")))
    assert {tuple(r) for r in copy_groups(df, "rid", "a", "b").collect()} == want
