import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordwell.llm import langid, minhash, quality_rules
from recordwell.llm.components import components


def brute_components(texts, width, least=80):
    pattern, sets = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for key, text in texts:
        words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= least * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_a_large_cluster_is_cut_into_blocks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEAST_BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, rows = np.random.default_rng(3), []
    words = [f"w{k}" for k in range(120)]
    for k in range(90):
        mine = list(words[: 80 + k % 40])
        for j in rng.choice(len(mine), k % 7, replace=False):
            mine[j] = f"n{k}x{j}"
        rows.append((k, " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()} == want


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, 4).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].component_id == 0 and by[1].kept and by[2].kept
    assert by[5].n_shingles == 1 and by[4].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(no_docs, 4).count() == 0
    assert minhash.deduplicated(odd_docs).columns == odd_docs.columns


def test_one_of_each_group_stays_of_repeated_and_nameless_rows(spark):
    a, b, c = ("one two three four five six seven eight", "red green blue black white grey pink cyan", "mon tue wed thu fri sat sun day")
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (3, b, "x"), (3, c, "x"), (3, c, "x"), (4, "", "x"), (4, "", "x"), (4, None, "x"), (None, a, "x"), (None, "nobody has this text but two rows", "x"), (None, "nobody has this text but two rows", "x"), (None, "", "x"), (None, "", "x"), (5, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = minhash.deduplicated(docs)
    want = [(1, a), (3, b), (3, c), (4, ""), (4, None), (None, "nobody has this text but two rows"), (None, ""), (None, ""), (5, "alone")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr) and got.columns == docs.columns
    assert minhash.deduplicated(docs.where("doc_id = 5")).count() == 1


def test_half_keys_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.r_[base[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]  # similarity 9/11
    keys = minhash.half_keys([np.unique(base), np.unique(other)])
    agree = keys[0] == keys[1]
    assert agree[: minhash.SIDE].any() and agree[minhash.SIDE :].any() and not agree.all()


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 200), (300, 250)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_language_of_odd_rows(odd_docs, no_docs, spark):
    got = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 3))
    assert got[8].lang_pred == "en" and got[None].lang_pred == "en"
    assert langid.identify(no_docs).count() == 0
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unknown).collect()} == {"und"}
    assert {r.doc_id for r in langid.recognised(odd_docs).collect()}.isdisjoint({0, 1, 2, 3})


def test_batches_of_texts_give_the_margins_of_single_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, per_language=50)
    texts = [r.text.encode() for r in docs.limit(20).collect()] + [b"", b"a"]
    together, alone = model.margins(texts), np.concatenate([model.margins([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def test_margins_equal_sums_over_counted_trigrams(spark):
    """Against a plain count of each text's trigrams, weighed one by one; other scripts keep their lead bytes apart."""
    texts = {"xa": "alpha beta gamma delta ", "xb": "omega sigma theta kappa ", "xc": "\u03b1\u03b2\u03b3 \u03b4\u03b5\u03b6 ", "xd": "\u0431\u0432\u0433 \u0434\u0435\u0436 "}
    rows = [(k * 10 + n, t * (2 + n % 3) + str(n), lang) for k, (lang, t) in enumerate(texts.items()) for n in range(10)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = model.margins([t.encode() for _, t, _ in rows])
    weight = {int(c): model.weights[k] for k, c in enumerate(model.used)}
    for (_, text, _), margins in zip(rows, got, strict=True):
        codes = [c for c in langid.trigrams(f"  {text}  ".encode()).tolist() if c]
        plain = [langid.SCALE * sum(float(weight[c][k]) for c in codes if c in weight) / len(codes) + model.bias[k] for k in range(len(model.pairs))]
        assert np.allclose(margins, plain, atol=1e-4)
    lang, _ = model.decide(got)
    assert [model.langs[k] for k in lang] == [x for *_, x in rows]
    assert not set(langid.trigrams(texts["xc"].encode()).tolist()) & set(langid.trigrams(texts["xd"].encode()).tolist()) - {0}


def test_rule_columns_equal_rules_in_numpy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    rows = sorted(tuple(r) for r in quality_rules.statistics(docs, ["doc_id"]).select("doc_id", *quality_rules.NAMES).collect())
    x = np.array([r[1:] for r in rows])
    total = model.bias + sum(w * quality_rules.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    got = {r.doc_id: r.score for r in quality_rules.scored(docs, model).collect()}
    assert np.allclose([got[r[0]] for r in rows], 1 / (1 + np.exp(-total)), atol=1e-12)


def test_statistics_by_hand(spark):
    text = "Zu viel!! viel viel\n#1 $ Ende"
    row = quality_rules.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    words = text.split()
    assert row.q_length == pytest.approx(np.log1p(len(text))) and row.q_upper == pytest.approx(2 / len(text)) and row.q_again == pytest.approx(1 / len(words))
    assert row.q_distinct == pytest.approx(np.log1p(len(set(words))) / np.log1p(len(words))) and row.q_mark0 == pytest.approx(2 / len(text)) and row.q_line == pytest.approx(1 / len(words))
    assert row.q_digit == pytest.approx(1 / len(text)) and row.q_stop == pytest.approx(1 / len(words)) and row.q_line_again == 0
    again = quality_rules.statistics(spark.createDataFrame([(1, "a b\n\na b\nc"), (2, None)], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert again[0].q_line_again == pytest.approx(1 / 3) and all(again[1][k] == (k == "q_distinct") for k in quality_rules.NAMES if k != "q_again")


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    assert 0 < len(model.rules) <= quality_rules.RULES
    got = quality_rules.scored(docs, model).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.9
    plan = quality_rules.scored(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_of_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (8, 1), (8, 1)], "doc_id long, quality int")
    got = quality_rules.scored(odd_docs, quality_rules.fit(odd_docs, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = quality_rules.fit(odd_docs, labels.limit(0))
    assert {r.score for r in quality_rules.scored(odd_docs, none).collect()} == {0.5}
    assert quality_rules.scored(no_docs, none).count() == 0
    assert quality_rules.good(odd_docs, none).columns == odd_docs.columns
