"""Toxicity of a text: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over the ordered triples of letters that both hold, DECAY to the power of the letters that each
occurrence spans (SPAN at most), divided by the words' own norms and raised to POWER. So a word with letters
inserted, left out or appended stays close to the one it was made from. Marks inside words are dropped first and letters
that stand alone in a row are joined, so spelt-out words meet their plain form.

A sentence's kernel is the sum over its words, so the machine's value of a sentence is the sum of its words' values. Landmarks are
words that toxic documents hold more often than others, and words of clean documents, the closest to these among them. Kernel
values with the landmarks, whitened (Nyström), are the machine's inputs. A toxic document is known to hold some toxic
sentence: the one of largest value stands for it, found anew each round; every sentence of a clean document is clean. A document's
score is a logistic function of its largest sentence.

Fitting takes a bounded sample: PER_CLASS documents a label are expected and FIT_BYTES of text, chosen by a hash, of the
labelled rows whose remainder modulo 3 is not 1.

Defined results: a null text counts as empty; a text without words has the value of an empty sentence, as clean as
can be. Without labels every score is 0.5; with labels of one kind only, 0 or 1 throughout. Null ids and labels other than 0 and 1
aren't learned from; repeated labels and copies count once a text; repeated rows get equal results. Words longer than
WINDOW letters are valued by their overlapping stretches. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import remainder, sized, unit_hash, written

DECAY, SPAN, POWER = 0.7, 5, 5
#: Letters of a stretch of a long word, and words of a piece of a long sentence.
WINDOW, PIECE = 16, 24
TOXIC_LANDMARKS, CLEAN_LANDMARKS, ALIKE = 72, 32, 0.9
PER_CLASS, FIT_BYTES = 3000, 8 << 20
#: Least quotient of a toxic landmark's shares of sentences.
LIFT = 3.0
#: Clean sentences that a round of fitting weighs, at most: those of largest value.
HARDEST = 12_000
#: Of a label's mean loss against the weights' norm.
COST = 2000.0
#: Words whose values a worker remembers, and characters of text that are valued at once.
REMEMBERED, TOGETHER = 400_000, 1 << 22

_break = re.compile(r"(?<=[.!?…])\s+|\n+")
_inner = re.compile(r"[^\w\s\x00]+|_+")
_spelt = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
BREAK = "\x00"


def tokens(text: str) -> list[str]:
    """Lower-case words, with BREAK between sentences."""
    t = _inner.sub("", _break.sub(" \x00 ", text.lower()))
    return _spelt.sub(lambda m: m.group().replace(" ", ""), t).split()


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, long ones in pieces."""
    out: list[list[str]] = [[]]
    for w in tokens(text):
        if w == BREAK or len(out[-1]) == PIECE:
            out.append([])
        if w != BREAK:
            out[-1].append(w)
    return [s for s in out if s]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j, k) of a word of n letters within the span, and their weights."""
    at = [(i, i + j, i + k) for i in range(n) for j, k in combinations(range(1, SPAN), 2) if i + k < n]
    return np.array(at, np.int64).reshape(-1, 3), np.array([DECAY ** (c - a + 1) for a, _, c in at])


TRIPLES = [_triples(n) for n in range(WINDOW + 3)]
_BITS = 21  # of a code point


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, between marks of their two ends."""
    inner = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.int64) if words and words[0] else np.zeros((len(words), 0), np.int64)
    return np.hstack([np.full((len(words), 1), 1), inner, np.full((len(words), 1), 2)])


def _norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself: equal triples' weights add up before they are squared."""
    if not codes.shape[1]:
        return np.ones(len(codes))
    order = np.argsort(codes, axis=1, kind="stable")
    total = np.cumsum(weight[order], axis=1)
    code = np.take_along_axis(codes, order, axis=1)
    last = np.hstack([code[:, 1:] != code[:, :-1], np.ones((len(code), 1), bool)])
    row, at = np.nonzero(last)
    sums = total[row, at]
    sums = np.diff(sums, prepend=0.0)
    first = np.r_[True, row[1:] != row[:-1]]
    sums[first] = total[row[first], at[first]]
    return np.bincount(row, sums * sums, len(codes))


class Kernel:
    """Kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.letters = np.array(sorted({1, 2, *(ord(c) for z in landmarks for c in z)}), np.int64)
        size, m = len(self.letters) + 1, len(landmarks)
        self.place = np.zeros(size**3, np.int32)
        rows: list[np.ndarray] = [np.zeros(m, np.float32)]
        for j, z in enumerate(landmarks):
            word = _letters([z])
            at, weight = TRIPLES[word.shape[1]]
            code = self._codes(word, at)[0]
            norm = np.sqrt(_norms(code[None], weight)[0])
            for c, w in zip(code.tolist(), (weight / norm).tolist(), strict=True):
                if not self.place[c]:
                    self.place[c] = len(rows)
                    rows.append(np.zeros(m, np.float32))
                rows[self.place[c]][j] += w
        self.table = np.stack(rows)

    def _codes(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A triple's number among triples of the landmarks' letters; 0 with any other letter."""
        k = np.searchsorted(self.letters, word)
        known = self.letters[np.minimum(k, len(self.letters) - 1)] == word
        s, size = np.where(known, k + 1, 0), len(self.letters) + 1
        a, b, c = (s[:, at[:, x]] for x in range(3))
        return np.where((a > 0) & (b > 0) & (c > 0), (a * size + b) * size + c, 0)

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row a word of WINDOW letters at most, a column a landmark: the normalised kernel to the power POWER."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        length = np.array([len(w) for w in words], np.int64)
        for n in np.unique(length):
            for some in np.array_split(np.flatnonzero(length == n), max(1, int((length == n).sum()) // 2048)):
                word = _letters([words[k] for k in some])
                at, weight = TRIPLES[n + 2]
                full = (word[:, at[:, 0]] << (2 * _BITS)) | (word[:, at[:, 1]] << _BITS) | word[:, at[:, 2]]
                rows, sums = self.place[self._codes(word, at)], np.zeros((len(some), len(self.landmarks)), np.float32)
                for t in range(len(at)):
                    live = np.flatnonzero(rows[:, t])
                    if len(live):
                        sums[live] += np.float32(weight[t]) * self.table[rows[live, t]]
                out[some] = sums / np.sqrt(_norms(full, weight))[:, None]
        return out**POWER


def stretches(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    step = WINDOW // 2
    return [word[k : k + WINDOW] for k in range(0, len(word) - step, step)]


class ToxicityModel:
    """alpha: a landmark's weight in a word's value; bias: a sentence's; slope and shift: from the largest value to the score."""

    def __init__(self, kernel: Kernel | None, alpha: np.ndarray, bias: float, slope: float, shift: float):
        self.kernel, self.alpha, self.bias, self.slope, self.shift = kernel, alpha, bias, slope, shift
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """The value of each word; BREAK's is not a number."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.known[BREAK] = np.nan
        new = [w for w in set(words) if w not in self.known]
        if new:
            parts = [stretches(w) for w in new]
            each = self.kernel([p for ps in parts for p in ps]) @ self.alpha
            self.known.update(zip(new, np.maximum.reduceat(each, np.cumsum([0, *(len(p) for p in parts[:-1])])).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def largest(self, texts: list[str]) -> np.ndarray:
        """The value of each text's largest sentence; an empty sentence's where there are no words."""
        out, low = np.full(len(texts), self.bias), 0
        while low < len(texts):
            some: list[list[str]] = []
            size, high = 0, low
            while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                size += len(texts[high])
                some.append(tokens(texts[high]))
                high += 1
            v = self.values([w for words in some for w in words])
            ends = np.cumsum([len(words) for words in some])
            for k, (b, words) in enumerate(zip(ends, some, strict=True), low):
                if words:
                    mine = v[b - len(words) : b]
                    out[k] += _largest_sum(mine, np.isnan(mine))
            low = high
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), _logistic(self.shift))
        return _logistic(self.slope * self.largest(texts) + self.shift)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _largest_sum(v: np.ndarray, ends: np.ndarray) -> float:
    """The largest sum of a sentence's values, long sentences in pieces of PIECE words."""
    live = ~ends
    if not live.any():
        return 0.0
    sentence = np.cumsum(ends)[live]
    v = v[live]
    first = np.r_[True, sentence[1:] != sentence[:-1]]
    starts = np.flatnonzero(first)
    inside = np.arange(len(v)) - starts[np.cumsum(first) - 1]
    return float(np.add.reduceat(v, np.flatnonzero(inside % PIECE == 0)).max())


def choose_landmarks(docs: list[list[list[str]]], toxic: np.ndarray) -> list[str]:
    """Words whose share of toxic documents' sentences exceeds that of clean ones beyond chance, none alike; then clean ones.

    Equal sentences count once, so copies of a document do, and for clean if a clean document has them.
    """
    seen = {tuple(s) for doc, t in zip(docs, toxic, strict=True) if not t for s in doc}
    n_clean, held = max(1, len(seen)), [Counter(p for s in seen for p in {p for w in s for p in stretches(w)})]
    only = {tuple(s) for doc, t in zip(docs, toxic, strict=True) if t for s in doc} - seen
    n_toxic = max(1, len(only))
    held.append(Counter(p for s in only for p in {p for w in s for p in stretches(w)}))

    def strength(w: str) -> float:
        """Standard errors by which a word's lift exceeds LIFT."""
        a, b = held[1][w] + 0.5, held[0][w] + 0.5
        return (np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)) - np.log(LIFT)) / np.sqrt(1 / a + 1 / b)

    told = sorted(((strength(w), w) for w in held[1]), reverse=True)
    chosen = _unlike([w for s, w in told[: 8 * TOXIC_LANDMARKS] if s > 0], TOXIC_LANDMARKS)
    clean = sorted((w for w in held[0] if strength(w) <= 0), key=lambda w: (-held[0][w], w))[: 400 * CLEAN_LANDMARKS]
    if chosen and clean:
        near = Kernel(chosen)(clean).max(axis=1)
        closest = [clean[k] for k in np.argsort(-near, kind="stable")[: 8 * CLEAN_LANDMARKS]]
        chosen += [w for w in _unlike(closest, CLEAN_LANDMARKS // 2) + _unlike(clean[: 8 * CLEAN_LANDMARKS], CLEAN_LANDMARKS // 2) if w not in chosen]
    return list(dict.fromkeys(chosen or clean[:1]))


def _unlike(words: list[str], most: int) -> list[str]:
    """The first words of which none is closer than ALIKE to one before."""
    if not words:
        return []
    near = Kernel(words)(words) ** (1 / POWER)
    out: list[int] = []
    for k in range(len(words)):
        if len(out) < most and (not out or near[k, out].max() < ALIKE):
            out.append(k)
    return [words[k] for k in out]


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights and bias (last) of a linear machine: Newton steps over the rows within the margin, with halved steps where needed."""
    z, penalty = np.c_[x, np.ones(len(x))], np.r_[np.ones(x.shape[1]), 1e-3]
    w = np.zeros(z.shape[1])
    loss = lambda w: 0.5 * (penalty * w * w).sum() + (cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        a, c = z[inside], cost[inside]
        slope = penalty * w + 2 * a.T @ (c * (a @ w - y[inside]))
        step = np.linalg.solve(2 * (a * c[:, None]).T @ a + np.diag(penalty), slope)
        length = 1.0
        while (new := loss(w - length * step)) > now - 1e-12 and length > 1e-6:
            length /= 2
        if now - new < 1e-9 * max(1.0, now):
            break
        w, now = w - length * step, new
    return w


def learn(texts: list[str], toxic: np.ndarray, rounds: int = 5) -> ToxicityModel:
    """A model of texts and their labels."""
    if not len(texts) or toxic.min() == toxic.max():
        return ToxicityModel(None, np.zeros(0), 0.0, 0.0, 0.0 if not len(texts) else 20.0 * (2 * float(toxic[0]) - 1))
    one: dict[str, str] = {}  # each word is held once
    docs = [[[one.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    kernel = Kernel(choose_landmarks(docs, toxic))
    value, vector = np.linalg.eigh(kernel(kernel.landmarks).astype(float))
    whiten = vector / np.sqrt(np.maximum(value, 0) + 1e-3)
    vocabulary = sorted({w for d in docs for s in d for w in s})
    parts = [stretches(w) for w in vocabulary]
    near = kernel([p for ps in parts for p in ps])
    if len(near) > len(parts):  # a long word's features: those of its stretch closest to any landmark
        starts, top = np.cumsum([0, *(len(p) for p in parts)]), near.max(axis=1)
        near = near[[int(a + top[a:b].argmax()) for a, b in zip(starts[:-1], starts[1:], strict=True)]]
    at = {w: k for k, w in enumerate(vocabulary)}
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    each = [s for d in docs for s in d]
    x = np.zeros((len(each), len(kernel.landmarks)), np.float32)
    if each:
        flat, sizes = np.array([at[w] for s in each for w in s]), np.array([len(s) for s in each])
        first = np.cumsum([0, *sizes[:-1]])
        for low in range(0, len(each), 4096):
            high = min(len(each), low + 4096)
            a, b = first[low], first[high - 1] + sizes[high - 1]
            x[low:high] = np.add.reduceat(near[flat[a:b]], first[low:high] - a)
    x = x @ whiten.astype(np.float32)
    clean = np.flatnonzero(toxic[owner] == 0)
    guess = np.zeros(len(each))
    if each:
        toward = near[:, : max(1, min(TOXIC_LANDMARKS, len(kernel.landmarks) - CLEAN_LANDMARKS))].max(axis=1)[flat]
        guess = np.maximum.reduceat(toward, first)
    w, before = np.zeros(x.shape[1] + 1), None
    hard = clean[np.argsort(-guess[clean], kind="stable")[:HARDEST]]
    for turn in range(rounds):
        picked = _witnesses(guess, owner, toxic)
        if turn > 1:  # a document without any sentence near the others' is likely labelled by mistake
            picked = picked[guess[picked] + w[-1] > -0.5] if (guess[picked] + w[-1] > -0.5).any() else picked
        rows = np.r_[picked, hard]
        if before is not None and np.array_equal(rows, before):
            break
        before = rows
        y = np.where(toxic[owner[rows]] == 1, 1.0, -1.0)
        w = squared_hinge(x[rows].astype(float), y, COST / np.maximum(1, np.where(y > 0, len(picked), len(hard))))
        guess = x @ w[:-1].astype(np.float32)
        hard = np.union1d(hard, clean[np.argsort(-guess[clean], kind="stable")[: HARDEST // 4]])[: 2 * HARDEST]
    model = ToxicityModel(kernel, whiten @ w[:-1], float(w[-1]), 1.0, 0.0)
    model.slope, model.shift = platt(model.largest(texts), toxic)
    return model


def _witnesses(guess: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sentence of largest value of each toxic document."""
    order = np.lexsort((np.arange(len(guess)), -guess, owner))
    first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]] if len(order) else order
    return first[toxic[owner[first]] == 1]


def platt(value: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (0 at least) and shift of a logistic curve, by Newton steps on softened labels."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    y = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.c_[value, np.ones(len(value))], np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - y) + 1e-6 * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, 3) == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = FIT_BYTES) -> ToxicityModel:
    """Learn labels.toxic of the documents that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).distinct()
    text = F.coalesce("text", F.lit(""))
    # Ids, lengths and hashes meet the labels; texts meet only those chosen.
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("h"), F.octet_length(text).alias("size"))
    rows = written(light.join(usable, "doc_id").select("h", "toxic", "size"), "labelled")
    got = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    share = {t: min(1.0, per_class / r.n, most_bytes / 2 / max(1, r.size)) for t, r in got.items()}
    if not share:
        return learn([], np.zeros(0))
    wanted = F.coalesce(*(F.when(F.col("toxic") == t, F.lit(s)) for t, s in share.items()))
    keys = rows.where(unit_hash(F.col("h"), 12) < wanted).select("h", "toxic").distinct()  # about per_class a label
    chosen = docs.select(text.alias("text"), F.xxhash64("doc_id", text).alias("h")).join(sized(keys), "h").select("text", "toxic").distinct()
    sample = sorted((r.text, int(r.toxic)) for r in chosen.collect())  # about per_class rows and most_bytes / 2 a label
    return learn([t for t, _ in sample], np.array([y for _, y in sample]))


def scored(docs: DataFrame, model: ToxicityModel, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row a document."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(["" if t is None else t for t in texts]))

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))
