import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from recordwell.llm import toxicity

INSULTS = ["blorgnak", "twizzup", "grumfesk"]
PLAIN = "the river runs past old mills and stone houses where many people lived long before any road was built near here".split()


def corpus(n=400, seed=5):
    r, out = random.Random(seed), []
    for k in range(n):
        toxic = k % 4 == 0
        sentences = [[r.choice(PLAIN) + r.choice(["", "", "s", "er"]) for _ in range(r.randint(4, 12))] for _ in range(r.randint(1, 6))]
        if toxic:
            s = r.choice(sentences)
            s.insert(r.randrange(len(s) + 1), r.choice(INSULTS))
        out.append((k, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return out


def plain_kernel(a, b):
    """The definition, by enumeration."""

    def weights(w):
        w, out = "\x01" + w + "\x02", defaultdict(float)
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER


def test_kernel_equals_its_definition():
    words = ["idiot", "idxiot", "iidiot", "banana", "aaa", "a", "ñandú", "worthless", "x" * 16]
    got = toxicity.Kernel(words)(words)
    assert got == pytest.approx(np.array([[plain_kernel(a, b) for b in words] for a in words]), abs=1e-5)


def test_tokens_join_what_is_spelt_out():
    assert toxicity.tokens("You I.d.i.o.t! i d i o t\nst*up_id") == ["you", "idiot", "\x00", "idiot", "\x00", "stupid"]
    assert toxicity.sentences("") == [] and [len(s) for s in toxicity.sentences("a bb " * 30)] == [24, 24, 12]
    assert "".join(toxicity.stretches("abcdefghijklmnopqrstuvwxyz" * 3)[::2]) .startswith("abcdefghijklmnop")


def test_learns_words_of_labelled_sentences_and_their_spelt_forms():
    docs = corpus()
    model = toxicity.learn([t for _, t, _ in docs], np.array([y for *_, y in docs]))
    new = corpus(200, seed=6)
    score = model.scores([t for _, t, _ in new])
    assert ((score >= 0.7) == [y == 1 for *_, y in new]).mean() > 0.97
    gapped, clean = model.scores(["the old b.l.o.r.g.n.a.k here", "twi*zzup river", "g r u m f e s k"]), model.scores(["the old mills", ""])
    assert gapped.min() > 0.7 and clean.max() < 0.05
    assert model.scores(["past grumfessk people", "blorxgnak"]).min() > 5 * clean.max()  # a letter put in lowers the score, no more
    # One sentence among many, and a text's far end, count as much as its beginning.
    assert model.scores([" ".join(["the river runs."] * 5000) + " you twizzup"])[0] > 0.7 > model.scores([" ".join(["the river runs."] * 5000)])[0]


def test_values_equal_plain_sums_over_sentences():
    docs = corpus()
    model = toxicity.learn([t for _, t, _ in docs], np.array([y for *_, y in docs]))
    texts = [t for _, t, _ in docs[:40]] + ["", "  ", "word " * 100, "x" * 1000 + " you blorgnak"]

    def value(w):
        return max(sum(a * plain_kernel(p, z) for a, z in zip(model.alpha, model.kernel.landmarks, strict=True)) for p in toxicity.stretches(w))

    want = [model.bias + max([sum(map(value, s)) for s in toxicity.sentences(t)], default=0.0) for t in texts]
    assert model.largest(texts) == pytest.approx(np.array(want), abs=1e-3)


def test_query_holds_rows_out_and_survives_odd_rows(spark, odd_docs, no_docs):
    docs = corpus()
    frame = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    right = spark.createDataFrame([(k, y) for k, _, y in docs] * 2 + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    # Labels of the held-out rows may say anything.
    wrong = spark.createDataFrame([(k, y if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - y) for k, _, y in docs], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, toxicity.scored(frame, toxicity.fit(frame, x)).collect())) for x in (right, wrong))
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b]) and [r[1] for r in a] == [zlib.crc32(str(k).encode()) % 3 == 1 for k, *_ in docs]
    held = [(r[3], y) for r, (*_, y) in zip(a, docs, strict=True) if r[1]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    model = toxicity.fit(frame, right)
    got = toxicity.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert toxicity.scored(no_docs, model).count() == 0
    assert {r.score for r in toxicity.scored(odd_docs, toxicity.fit(no_docs, right)).collect()} == {0.5}
    only = toxicity.fit(frame, right.where("toxic = 0"))
    assert {r.predicted for r in toxicity.scored(frame, only).collect()} == {0}
