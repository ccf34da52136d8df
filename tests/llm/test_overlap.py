import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from supportlens.llm import overlap


def test_words():
    assert overlap.words("Don't @you see https://x.y/z?q It’s A-1, Été!") == ["dont", "see", "its", "a", "1", "été"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60), max_size=40), st.sets(st.integers(0, 60), max_size=40)), min_size=1, max_size=8))
def test_banded_programming_decides_like_sets(pairs):
    a, b = [np.array(sorted(x), np.int64) for x, _ in pairs], [np.array(sorted(y), np.int64) for _, y in pairs]
    for (x, y), got in zip(pairs, overlap.common(a, b)):
        need = 4 * max(len(x), len(y))
        assert (5 * got >= need) == (5 * len(x & y) >= need) and got <= len(x & y)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "a", "my"] * 6
    make = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
    train = [make() for _ in range(60)]
    ev = [make() for _ in range(10)]
    for t in train[:25]:  # near copies, in another order
        x = [w if rng.random() > 0.15 else "new" for w in t]
        rng.shuffle(x)
        ev.append(x)
    E = [(f"e{i}", f" C{i} ", " ".join(x).title(), "t") for i, x in enumerate(ev)] + [("en", None, None, "t"), (None, "c1", "the a", "t"), ("e0", " C0 ", " ".join(ev[0]), "t")]
    R = [(f"r{i}", f"c{i + 1000 * (i > 2)}", " ".join(x) + " https://a.b @me", "t") for i, x in enumerate(train)] + [("rn", None, None, "t"), ("rx", "c5000", " ".join(train[0]), "t")]
    manifest = [(f"C{i + 1000 * (i > 2)} ", " Train", "s1") for i in range(60)] + [("c5000", "dev", "s2"), ("c0", "train", "s1")]
    e = spark.createDataFrame(E, "example_id string, conversation_id string, customer_message string, text string")
    r = spark.createDataFrame(R, "resolution_id string, conversation_id string, customer_text string, id string")
    m = spark.createDataFrame(manifest, "conversation_id string, split string, source string")
    found = overlap.overlaps(e, r, m).cache()
    want = set()
    for i, x in enumerate(ev):
        for j, y in enumerate(train):
            c, n = sum((Counter(x) & Counter(y)).values()), max(len(x), len(y))
            if (n and 5 * c >= 4 * n and x and y) or (j <= 2 and i == j):
                want.add((f"e{i}", f"r{j}"))
    assert {(p["example_id"], p["resolution_id"]) for p in found.collect()} == want and len(want) > 20
    assert overlap.report(found, e, m).count() >= 1
    assert overlap.overlaps(e.limit(0), r, m).count() == 0 and overlap.overlaps(e, r.limit(0), m).count() == 0
