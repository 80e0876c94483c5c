import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recordwell.llm import bpe, packed_output, packing
from recordwell.llm.byte_tokens import read_vocabulary

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(odd_docs, spark):
    reference = Tokenizer.from_file(WORD)
    docs = odd_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    got = sorted(bpe.digest(bpe.encoded(docs, read_vocabulary(WORD))).collect(), key=str)
    want = []
    for key, text in _texts(docs):
        ids = reference.encode(text, add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: str(type(got[0])(*w))) or sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_one_merge_a_round_gives_the_same():
    both = [bpe.WordBpe(read_vocabulary(WORD)) for _ in range(2)]
    assert both[0].all_at_once
    both[1].all_at_once = False
    texts = ["aaaa aaaaaaab banana bananas thththth", "ererererer"]
    assert [i.tolist() for i, _ in both[0].encode(texts)] == [i.tolist() for i, _ in both[1].encode(texts)]


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    one, two = bpe.WordBpe(read_vocabulary(WORD)), Tokenizer.from_file(WORD)
    for k in range(5):
        text = " ".join(f"word{chr(97 + k)}{chr(97 + j)}" for j in range(8))
        assert one.encode([text])[0][0].tolist() == two.encode(text, add_special_tokens=False).ids


def test_packing_covers_every_id_once(odd_docs, no_docs, spark):
    docs = odd_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True).repartition(3, "doc_id")
    reference = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for key, text in _texts(docs):
        want[key].append([*reference.encode(text, add_special_tokens=False).ids, 1])
    pieces = packing.pack_documents(docs, read_vocabulary(BYTE), width=128).collect()
    seats = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == seats[p.sequence_id]  # gapless from 0
        seats[p.sequence_id] += p.length
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and any(len(w) == p.doc_tokens and w[p.start : p.start + p.length] == ids for w in want[p.doc_id])
    assert sorted(seats) == list(range(len(seats))) and set(list(seats.values())[:-1]) <= {128}
    assert sum(seats.values()) == sum(len(w) for ws in want.values() for w in ws)
    row = packing.digest(packing.pack_documents(docs.limit(0), read_vocabulary(BYTE)))
    assert row.count() == 0 and packing.pack_documents(no_docs, read_vocabulary(BYTE)).count() == 0


def test_matrices_round_trip(odd_docs, no_docs, tmp_path):
    reference = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for key, text in _texts(odd_docs):
        want[key].append(reference.encode(text, add_special_tokens=False).ids)
    made = packed_output.write_matrices(odd_docs, read_vocabulary(BYTE), str(tmp_path / "m"), width=64, pad_id=7)
    back = defaultdict(lambda: defaultdict(dict))
    for row in made.collect():
        ids = np.frombuffer(row.ids, "<u2").tolist()
        assert len(ids) == 64 and row.cu_seqlens[-1] == row.used and row.position_resets == row.cu_seqlens[:-1] and set(ids[row.used :]) <= {7}
        for p, a, b in zip(row.pieces, row.cu_seqlens[:-1], row.cu_seqlens[1:], strict=True):
            back[p.doc_id][p.doc_tokens].setdefault(p.start, []).append(ids[a:b])
    for key, versions in want.items():
        for v in versions:
            if v:
                parts = back[key][len(v)]
                assert [x for start in sorted(parts) for x in parts[start][0]] == v
    digest = packed_output.manifest(made).collect()
    assert sum(d.length for d in digest) == sum(len(v) for vs in want.values() for v in vs)
    one = next(d for d in digest if d.doc_id == 4)
    assert one.ids_crc32 == zlib.crc32(np.array(want[4][0], "<u2").tobytes())
    assert packed_output.manifest(packed_output.write_matrices(no_docs, read_vocabulary(BYTE))).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths, width = rng.integers(1, 33, 60).tolist(), 32
        free: list[int] = []
        plain: list[list[int]] = []
        for k in sorted(range(60), key=lambda k: (-lengths[k], k)):
            fits = [(f, j) for j, f in enumerate(free) if f >= lengths[k]]
            if fits:
                least = min(fits)[0]
                j = max(j for f, j in fits if f == least)
            else:
                j = len(free)
                free.append(width)
                plain.append([])
            free[j] -= lengths[k]
            plain[j].append(k)
        rows = packed_output.best_fit(lengths, width)
        assert len(rows) == len(plain) and all(sum(lengths[k] for k in r) <= width for r in rows) and sorted(k for r in rows for k in r) == list(range(60))
