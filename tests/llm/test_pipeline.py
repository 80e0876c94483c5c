import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from recordwell.llm import langid, minhash, quality_rules

from .test_documents import brute_components


def test_pipeline_equals_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = langid.recognised(docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    second = quality_rules.good(first, quality_rules.fit(first, labels)).collect()
    parts = brute_components([(r.doc_id, r.text) for r in second], 5)
    kept = {r.doc_id: r.text for r in second if parts[r.doc_id][1] == r.doc_id}
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in got} == {k: len(reference.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_stages_keep_columns_and_survive_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_repeated_ids_lose_no_text(spark):
    a, b, unique = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine ten " * 2, "a text that stands nowhere else at all in this small table")
    rows = [(3, a), (5, unique), (5, a), (7, b), (7, b)]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, a), (5, unique), (7, b)])
    more = [*rows, (None, a), (None, unique + "s"), (None, unique + "s"), (9, ""), (9, ""), (9, None), (None, None)]
    kept = minhash.deduplicated(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(3, a), (5, unique), (7, b), (9, ""), (9, None), (None, None), *([(None, unique + "s")] if brute_jaccard(unique, unique + "s") < 0.8 else [])], key=repr)


def brute_jaccard(x, y):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def test_stages_leave_columns_of_any_name_alone(spark):
    names = ["doc_id", "text", "q_text", "q_words", "q_row", "q_digit", "keep", "recordwell_row", "row", "a.b", "component"]
    text = "the quick brown fox and the lazy dog are in the house and it was as good as it is to be"
    docs = spark.createDataFrame([(k, f"{text} {k}" * 3, *[f"{n}{k}" for n in names[2:]]) for k in range(4)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    model = quality_rules.RuleEnsemble([], [], 1.0)
    for got in (quality_rules.good(docs, model), minhash.deduplicated(docs), minhash.deduplicated(docs.union(docs))):
        assert got.columns == names
        found = sorted(map(tuple, got.collect()))
        assert set(found) <= set(map(tuple, docs.collect())) and len(found) >= 1
