import random

from supportlens.llm import subjects as S

TERMS = {"music": "string quartet|jazz trio|bass line|album sleeve|opera recording|drum loop".split("|"), "law": "court order|legal counsel|liability clause|class action|contract terms|burden of proof".split("|")}
FORMS = ["The customer wrote about the {a} and how it relates to the {b}.", "Our notes mention the {a} before the {b}.", "Step {n}: look at the {a}, note the value, then go back to the {b}.", "If the {a} comes up, explain the {b} first.", "Without the {a}, there would be no need to talk about the {b}."]
STOCK = ["It was music to our ears.", "The ball is in our court now.", "Was this helpful?"]


def sentence(rng, s):
    a, b = rng.sample(TERMS[s], 2)
    return rng.choice(FORMS).format(a=a, b=b, n=rng.randrange(2, 60))


def test_subjects(spark):
    rng = random.Random(2)
    docs, want = [], set()
    for i in range(160):
        s = ["music", "law"][i % 2]
        parts = [sentence(rng, s) for _ in range(6)]
        want.add((i, s))
        if i % 4 == 0:
            other = ["law", "music"][i % 2]
            parts += [sentence(rng, other) for _ in range(3)]
            want.add((i, other))
        docs.append((i, " ".join(parts + rng.choices(STOCK, k=2))))
    docs += [(900, None), (901, ""), (902, " ".join(STOCK)), (903, "🙂" * 10), (None, "the string quartet"), (0, docs[0][1])]
    # the examples name half of the terms only; the others are learned from their company
    ex = [(k, s, "en", f"The {a} comes up. Our notes mention the {b} before the {a}.") for k, (s, a, b) in enumerate((s, *rng.sample(TERMS[s][:4], 2)) for s in TERMS for _ in range(6))]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, subject string")
    e = spark.createDataFrame(ex, "example_no long, subject string, lang string, text string")
    a = spark.createDataFrame([("music", "m"), ("law", "l")], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in S.subjects_of(d, e, a).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert not any(i >= 900 for i, _ in got)
    assert S.subjects_of(d.limit(0), e, a).count() == 0 and S.subjects_of(d, e, a.limit(0)).count() == 0


def test_copies_of_a_document_keep_their_subject(spark):
    """A group of copies holds a third of the rows; its sentences are no stock phrases, those met beside all subjects are."""
    rng = random.Random(3)
    docs = [(i, " ".join([sentence(rng, ["music", "law"][i % 2]) for _ in range(6)] + rng.choices(STOCK, k=2))) for i in range(160)]
    docs += [(i, docs[1][1]) for i in range(1000, 1080)] + [(2000, " ".join(STOCK))]
    ex = [(s, f"The {a} comes up. Our notes mention the {b} before the {a}.") for s, a, b in ((s, *rng.sample(TERMS[s][:4], 2)) for s in TERMS for _ in range(6))]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ex, "subject string, text string")
    got = {(r["doc_id"], r["subject"]) for r in S.subjects_of(d, e, spark.createDataFrame([("music",), ("law",)], "subject string")).collect()}
    assert {(i, "law") for i in [1, *range(1000, 1080)]} <= got
    assert not any(i == 2000 for i, _ in got)
