import random

import pytest

from supportlens.llm import pii

FINDER = pii.Finder({"my social": "id_number", "name:is under": "name", "name:my name is": "name", "call me on": "phone"}, {"linnea", "osric", "tarnworth"}, {"will mark"})


def types(text):
    return {k for _, _, k in FINDER.spans(text)}


@pytest.mark.parametrize("text, want", [
    ("write to a.b+c@mail.example.com", {"email"}), ("reach me at anna dot", set()), ("mail joe at inbox dot test please", {"email"}), ("x [at] home[dot]example[dot]net", {"email"}), ("it died at 3 dot com speed", set()), ("@TavoCare hello", set()),
    ("call me on 555 0104", {"phone"}), ("+49 30 23125 531", {"phone"}), ("ring five five five, oh one six six", {"phone"}), ("tel 01.99.00.13.94", {"phone"}), ("case number 6546 4685", set()), ("build 15C508", set()),
    ("passport no. N5674637", {"id_number"}), ("my ssn is 937-01-4938", {"id_number"}), ("order 937-01-4938", set()), ("they asked for my social: 951360552", {"id_number"}), ("receipt no. 75-0414770", set()), ("IMEI 35 475557 123456 7", set()), ("carte d'identité n° 133793345791", {"id_number"}), ("national insurance QQ 31 39 81 D", {"id_number"}),
    ("I live at 122 alder road apt 8D", {"address"}), ("deliver to: Flat 2, 127 Foundry Avenue", {"address"}), ("the desk on Orchard Lane was shut", set()), ("74 court cases and counting", set()), ("adresse : 84, avenue des Trois Saules", {"address"}), ("ich wohne Hirtenplatz 139a", {"address"}), ("vivo en calle del Olmo 180", {"address"}),
    ("My name is Linnea Tarnworth", {"name"}), ("the account is under osric tarnworth", {"name"}), ("signed, Mx Milo Vellworth", {"name"}), ("Will Mark II chargers work", set()), ("Linnea K. Morneau here again", {"name"}), ("Sierra Clara", set()), ("", set()),
])
def test_forms(text, want):
    assert types(text) == want


def test_bootstrapping_finds_patterns_from_seeds(spark):
    """The pattern ``parcel went to`` is in no seed; it is learned from persons that seeds name, and finds others."""
    rng = random.Random(1)
    given, family = ["Linnea", "Osric", "Wendel", "Paloma", "Vasco"], ["Tarnworth", "Larkmere", "Vellado", "Grauby", "Kessley", "Windova"]
    person = lambda: f"{rng.choice(given)} {rng.choice(family)}"
    rows = [f"hello, my name is {person()}" for _ in range(60)] + [f"my parcel went to {person()} instead" for _ in range(40)] + ["I travel to Port Arlen weekly"] * 200 + ["my ssn is 937-01-4938", "case number 6546 4685"] * 20
    rows += ["my parcel went to Odile Hazelby instead", None, "", "x" * 50_000]
    df = spark.createDataFrame([(str(i), t, "z") for i, t in enumerate(rows)] + [(None, "a@b.example", "z")], "rid string, body string, text string")
    learned = pii.learn(pii.texts_of((df, "body")))
    patterns, tokens, _ = learned.local()
    assert "name:went to" in patterns and "linnea" in tokens and "arlen" not in tokens
    got = {tuple(r) for r in pii.find(df.filter("rid is not null"), learned, ("rid",), "body").collect()}
    assert {i for i, k in got if k == "name"} >= {str(i) for i in range(100)} and not {i for i, k in got if k == "name" and 100 <= int(i) < 300}
    assert sum(k == "id_number" for _, k in got) == 20
    masked = {r["rid"]: r["masked"] for r in pii.masked(df, learned, "rid", "body").collect()}
    assert masked["0"] == "hello, my name is [NAME]" and masked[str(len(rows) - 3)] is None and masked[str(len(rows) - 1)] == rows[-1] and masked["100"] == rows[100]
    assert pii.find(df.limit(0), learned, ("rid",), "body").count() == 0
    assert pii.learn(pii.texts_of((df.limit(0), "body"))).local()[1] == set()
    # the same findings where what was learned is too large for a broadcast and is joined to the texts
    learned.most = 0
    joined = {tuple(r) for r in pii.find(df.filter("rid is not null"), learned, ("rid",), "body").collect()}
    assert joined == got
    assert {r["rid"]: r["masked"] for r in pii.masked(df, learned, "rid", "body").collect()} == masked


def test_a_person_named_often_is_found(spark):
    """A person in many copies of one message; a product met behind as many patterns is no person."""
    people = [f"hello, my name is {a} {b}" for a in ("Linnea", "Osric", "Wendel") for b in ("Tarnworth", "Larkmere", "Vellado", "Grauby")] * 3
    copies = ["my parcel for Linnea Tarnworth is late"] * 90
    often = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} thing {x} again" for i in range(60) for x in ("Nova Orbit",)]
    rows = people + copies + often
    learned = pii.learn(pii.texts_of((spark.createDataFrame([(t,) for t in rows], "body string"), "body")))
    _, tokens, common = knowledge = learned.local()
    finder = pii.Finder(*knowledge)
    assert "name" in {k for _, _, k in finder.spans(copies[0])}
    assert "linnea tarnworth" not in common and "nova orbit" in common
    assert not finder.spans(often[0])
    # a pair of two known name tokens is a person, whatever its contexts were
    assert {"linnea", "vellado"} <= tokens
    assert "name" in {k for _, _, k in pii.Finder(knowledge[0], tokens, common | {"linnea vellado"}).spans("Linnea Vellado here again")}


def test_the_rule_for_pairs_is_the_same_at_every_size(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0), (8, 0), (9, 0), (9, 2), (60, 3), (6000, 300), (6000, 1600)], "met long, cued long")
    assert [r[0] for r in df.select(pii._impure("met", "cued")).collect()] == [False, False, True, False, True, True, False]
