import random

import numpy as np

from supportlens.llm import pairs

STEPS = ["Hold the side button for {n} seconds until the logo appears.", "Clear {n} megabytes and retry the download.", "Change your passcode and review the list of trusted devices.", "Open Settings, choose General and then tap Reset network list."]
DE = ["Halte die Seitentaste {n} Sekunden lang gedrückt.", "Entferne die App und lade sie erneut aus dem Laden.", "Ändere deinen Code und prüfe die Liste der Geräte."]
ASK = ["my phone will not charge since {n} days and the cable is fine", "the screen on my tablet flickers green when I open the app", "I was charged {n} dollars for the app that I did not buy"]
ASK_DE = ["mein Gerät lädt seit {n} Tagen nicht und das Kabel ist in Ordnung", "der Bildschirm ist grün wenn ich die App auf dem Gerät öffne"]


def corpus(n=900):  # with a few answers in the wrong language to learn from
    rng = random.Random(1)
    out = []
    for i in range(n):
        de = rng.random() < 0.3
        f = lambda xs: rng.choice(xs).format(n=rng.randrange(2, 90))
        a, b = f(ASK_DE if de else ASK), " ".join(f(DE if de else STEPS) for _ in range(rng.randrange(1, 4)))
        if i % 45 == 0:
            out.append((f"xforeign{i}", f(ASK) + " and it is a mess", f(DE) + " " + f(DE)))
        out.append((f"ok{i}", a, rng.choice(["", "@100 ", "Thanks for the details. " if not de else "Danke für die Angaben. "]) + b))
    return out


BAD = [
    ("e1", ASK[0], None, "empty"), ("e2", ASK[0], " @1234 ^AB ... ​", "empty"), ("e3", ASK[0], "[no text]", "empty"), ("e4", None, "", "empty"),
    ("t1", ASK[0], "Thanks for the details. Hold the side button for 30 seconds until the", "truncated"), ("t2", ASK[0], "Clear 30 megabytes and retry the downl", "truncated"),
    ("r1", ASK[0], "@100 I'm sorry, but we cannot answer this request.", "refusal"), ("r2", ASK_DE[1], "Leider können wir diese Anfrage nicht beantworten.", "refusal"),
    ("c1", ASK[1], "> " + ASK[1].upper(), "copy"), ("c2", ASK[1], "the screen on my tablet flickers green when I open", "copy"),
    ("o1", ASK[0] + " and it is a mess", "Halte die Seitentaste 20 Sekunden lang gedrückt. Entferne die App und lade sie erneut aus dem Laden.", "other_language"),
]
FINE = [("f1", ASK[0], "Clear 30 megabytes and retry the download"), ("f2", ASK[0], "Sorry, we cannot help before Monday. Clear 30 megabytes and retry the download."), ("f3", "@100 Thanks for the details. Clear 30 megabytes and retry the download.", ASK[0])]


def test_defects(spark):
    rows = corpus() + [r[:3] for r in BAD] + FINE + [(None, "a", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rid string, q string, a string, id string")
    got = dict(map(tuple, pairs.broken_pairs(df, "rid", "q", "a").collect()))
    assert {k: got.get(k) for k, *_ in BAD} == {k: d for k, _, _, d in BAD}
    assert not {k for k in got if k.startswith(("ok", "f"))}
    assert pairs.broken_pairs(df.limit(0), "rid", "q", "a").count() == 0


def test_field_learns_transitions():
    """Held-out accuracy where only the neighbour tells the tag."""
    rng = np.random.default_rng(0)

    def seq():
        tags, feats, t = [], [], int(rng.integers(2))
        for _ in range(8):
            t = t if rng.random() < 0.95 else 1 - t
            tags.append(t)
            feats.append([t if rng.random() < 0.75 else 1 - t])
        return feats, tags

    field = pairs.Field({"a": 0, "b": 1}).fit([seq() for _ in range(300)], epochs=3)
    test = [seq() for _ in range(100)]
    chain = np.mean([np.mean(np.array(field.decode(f)) == t) for f, t in test])
    alone = np.mean([np.mean(np.array([x[0] for x in f]) == t) for f, t in test])
    assert chain > alone + 0.08


def test_viterbi_is_exact():
    import itertools

    rng = np.random.default_rng(2)
    field = pairs.Field({}, rng.normal(size=(4, 6)).astype(np.float32), rng.normal(size=(6, 6)))
    seq = [[i] for i in range(4)]
    p = field.potentials(seq)
    best = max(itertools.product(range(6), repeat=4), key=lambda y: sum(p[i, t] for i, t in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
    assert field.decode(seq) == list(best)


def test_very_long_response(spark):
    df = spark.createDataFrame([("1", "word " * 20_000, "Clear it now. " * 5_000)], "rid string, q string, a string")
    pairs.broken_pairs(df, "rid", "q", "a").collect()


def test_copies_of_a_truncated_response_do_not_vouch_for_each_other(spark):
    """Stored several times, also in another dress, a response that breaks off behind a whole word stays truncated."""
    cut = "Thanks for the details. Hold the side button for 30 seconds until the"
    rows = corpus() + [(f"t{i}", ASK[0], [cut, cut.upper(), cut.replace(" ", "  ").replace(".", " !")][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "rid string, q string, a string")
    got = dict(map(tuple, pairs.broken_pairs(df, "rid", "q", "a").collect()))
    assert {got.get(f"t{i}") for i in range(300)} == {"truncated"}
    assert not {k for k in got if k.startswith("ok")}


def test_the_field_beats_its_seeds_on_held_out_refusals():
    """Refusals in wordings that no seed names, and courtesies that no seed names, told by their words and company."""
    rng = random.Random(4)
    openings = ["Thanks for writing.", "We know how much this matters to you.", "Your note has arrived at our desk.", "Hello there."]
    known = ["We cannot answer this request.", "We are unable to help with this question.", "Our desk may not respond to this request.", "We must decline to answer this question."]
    unknown = ["Our desk may not take this question.", "Nobody here may take this request.", "We must not take up this question."]
    closings = ["This decision is final.", "There is nothing more to say.", "Best wishes."]
    f = lambda xs: rng.choice(xs).format(n=rng.randrange(2, 90))
    rows = [(f(ASK), f"{f(openings)} {f(STEPS)} {f(STEPS)}", []) for _ in range(900)]
    rows += [(f(ASK), f"{f(openings)} {f(known)} {f(closings)}", []) for _ in range(60)]
    rows += [(f(ASK), f"{f(openings)} {f(unknown)} {f(closings)}", []) for _ in range(25)]
    reader, field = pairs.fit(rows)
    want, seeds, tagged = [], [], []
    for kind, second in [("refusal", u) for u in unknown] + [(None, s.format(n=7)) for s in STEPS]:
        for a in openings:
            measured = reader.measure(ASK[0], f"{a} {second} {closings[0] if kind else ''}", False)
            want.append(kind)
            seeds.append(pairs.defect(measured, pairs.seed_tags(measured)))
            tagged.append(pairs.defect(measured, field.tags(measured)))
    right = lambda got: sum(a == b for a, b in zip(got, want))
    assert seeds.count("refusal") == 0  # no seed names these
    assert right(tagged) >= 0.9 * len(want) > right(seeds)


def test_marked_ends_in_broken_words():
    seen = [(1, 30, 2, 1), (2, 0, 0, 1)]  # the piece is a word elsewhere, the pair is not
    assert pairs.breaks_off(["your", "pas"], seen, marked=True) and not pairs.breaks_off(["your", "pas"], seen)
    assert pairs.open_end("Our team in Kessb [...]") and pairs._marked("Change your pas...") and pairs._marked("to the [...] 🙂") and not pairs._marked("It is done (see below).")
