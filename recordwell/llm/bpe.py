"""Byte-pair encoding and decoding with batched numpy merge rounds.

The words that a worker hasn't met yet are encoded together: their symbols lie in one flat
array, each round finds the rank of every neighbouring pair by binary search over the
sorted pair keys, takes each word's lowest rank and merges all its occurrences from
left to right. Known words come from a bounded memory. Normalising and splitting follow the
vocabulary file: common Latin text by a pattern, any other by the file's own rules.

Merging all occurrences of a pair at once equals merging one at a time if no merge that uses
a token outranks the merge that makes it; the table is checked for this when loaded, and
otherwise one occurrence is merged a round.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows and
null ids of documents are carried through; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

#: Words that a worker remembers, about 100 MB; beyond it the memory starts anew.
KNOWN_WORDS = 250_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 20

OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def _latin_letters() -> str:
    return "".join(chr(c) for c in range(0x80, 0x180) if chr(c).isalpha())


class WordBpe:
    """encode_words and encode for a vocabulary whose words end in a suffix."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.rules = Tokenizer.from_str(vocabulary)
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for text, i in [*model["vocab"].items(), *self.special.items()]:
            self.token[i] = text
        vocab, pairs = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        least = np.full(len(self.token), -1, np.int64)
        np.maximum.at(least, made, np.arange(len(pairs)))  # the last merge that makes a token
        self.all_at_once = bool((np.maximum(least[left], least[right]) < np.arange(len(pairs))).all())
        self.byte_char = self._alphabet()
        self.inner = np.array([vocab[c] for c in self.byte_char], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in self.byte_char], np.int64)
        # The file's split pattern with its letter and number classes written out for the characters of plain text.
        letters = "a-z" + _latin_letters()
        numbers = "0-9" + "".join(chr(c) for c in range(0x80, 0x180) if chr(c).isnumeric())
        plain = split.replace("\\p{L}", letters).replace("\\p{N}", numbers)
        self.words = re.compile(plain)
        self.odd = re.compile("[^\t\n\r -~¡-¬®-įı-ſ–—‘’“”…€]")
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, int] = {}
        self._reset()

    @staticmethod
    def _alphabet() -> list[str]:
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256))
        return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]

    def _reset(self) -> None:
        """An empty memory but for the special tokens: ids of all known words in one array, from start[k] to start[k + 1]."""
        self.known.clear()
        self.flat, self.starts, self.spelt = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], []
        self.total = 0

    def merged(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; owner: each one's word, ascending. Returns both, merged and in order."""
        done_s, done_o, none = [], [], np.iinfo(np.int64).max
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.append(np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1), 0)
            hit = np.append((self.keys[at[:-1]] == key) & (owner[:-1] == owner[1:]), False)
            rank = np.where(hit, self.ranks[at], none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            each = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(owner)]))
            live = each < none
            if not live.all():  # words without a pair left are finished
                done_s.append(symbols[~live])
                done_o.append(owner[~live])
                symbols, owner, each, rank, at = (x[live] for x in (symbols, owner, each, rank, at))
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == each)
            if self.all_at_once:  # in a run of touching pairs, every other one merges
                opens = np.r_[True, np.diff(chosen) > 1]
                place = np.arange(len(chosen))
                chosen = chosen[(place - place[opens][np.cumsum(opens) - 1]) % 2 == 0]
            else:
                chosen = chosen[np.r_[True, owner[chosen][1:] != owner[chosen][:-1]]]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        done_s.append(symbols)
        done_o.append(owner)
        s, o = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        ids, owner = self.merged(symbols, np.repeat(np.arange(len(words)), size))
        bounds = np.searchsorted(owner, np.arange(1, len(words) + 1))
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.flat.append(ids.astype(np.uint32))
        self.starts.append(self.total + bounds)
        self.total += len(ids)
        names, low = [self.token[i] for i in ids.tolist()], 0
        for high in bounds.tolist():
            self.spelt.append(" ".join(names[low:high]))
            low = high

    def split(self, text: str) -> list[str]:
        """A text's words, normalised; special tokens stand as themselves."""
        if self.mark and "<|" in text and self.mark.search(text):
            return [w for part in self.mark.split(text) if part for w in ([part] if part in self.special else self.split(part))]
        if not self.odd.search(text):
            return self.words.findall(text.lower())
        pieces = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        back = {c: b for b, c in enumerate(self.byte_char)}
        return [bytes(back[c] for c in p[0]).decode() for p in pieces]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text its ids and what they decode to."""
        split = [self.split(t) for t in texts]
        new = list({w: None for words in split for w in words if w not in self.known})
        if self.known and len(self.known) + len(new) > KNOWN_WORDS:
            self._reset()
            new = list({w: None for words in split for w in words})
        marks = [w for w in new if w in self.special]
        if new := [w for w in new if w not in self.special]:
            self.learn(new)
        for w in marks:
            self.known[w] = len(self.known)
            self.flat.append(np.array([self.special[w]], np.uint32))
            self.total += 1
            self.starts.append(np.array([self.total]))
            self.spelt.append(w)
        if len(self.flat) > 1:
            self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        flat, starts, out = self.flat[0], self.starts[0], []
        for words in split:
            if not words:
                out.append((flat[:0], ""))
                continue
            k = list(map(self.known.__getitem__, words))
            index = np.array(k, np.int64)
            low, size = starts[index], starts[index + 1] - starts[index]
            ends = np.cumsum(size)
            out.append((flat[np.arange(ends[-1]) + np.repeat(low - ends + size, size)], " ".join(map(self.spelt.__getitem__, k))))
        return out


_loaded: dict[int, WordBpe] = {}


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of OUT: the ids as little-endian unsigned 32-bit numbers, and what they decode to."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary)
        if key not in _loaded:
            _loaded[key] = WordBpe(vocabulary)
        bpe = _loaded[key]

        def made(keys: list, texts: list) -> pa.RecordBatch:
            both = bpe.encode(texts)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(i) for i, _ in both], pa.int64()), pa.array([i.astype("<u4").tobytes() for i, _ in both], pa.binary()), pa.array([t for _, t in both], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= TOGETHER:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield made(keys, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def digest(coded: DataFrame) -> DataFrame:
    """Checksums in place of ids and decoded texts."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
