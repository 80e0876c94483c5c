"""Language of a text: family first, then one-versus-one linear machines within the family.

Features are letter trigrams of the whole text (UTF-8 bytes, lower-cased, non-letters as
spaces) as shares of all its trigrams, so a text's value for a machine is the mean of its
trigrams' weights. Each pair of families, and each pair of languages of one family, has a linear
support vector machine, fitted by dual coordinate descent in one Spark task a pair.

Machines learn from a bounded sample: PER_LANGUAGE texts a language are expected, chosen
by a hash of the id, out of the rows with a remainder other than 0.

Defined results: a text that is null or has no letter is `und` with score 0; so is every
text if there is nothing to learn from. Rows with a null doc_id or lang aren't learned from. Repeated
rows get equal results; ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import held_out, unit_hash

PER_LANGUAGE = 800
#: Symbols: a space, 26 letters, the 64 continuation bytes from 32 on, the 64 lead bytes from 96 on.
BASE = 160
SCALE = 10.0
#: Bytes of text that are looked up at once.
TOGETHER = 1 << 21

#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "Germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "Romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "Slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}

_ascii_letter = re.compile("[A-Za-z]")


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(256):
        if chr(b).isalpha() and b < 128:
            out[b] = ord(chr(b).lower()) - 96
        elif b >= 0xC0:
            out[b] = 96 + b - 0xC0
        elif b >= 0x80:
            out[b] = 32 + (b & 0x3F)
    return out


SYMBOL = _symbols()


def trigrams(data: bytes) -> np.ndarray:
    """The trigram code at each byte but the last two; 0 stands for three spaces."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int32)
    capital = np.zeros(len(b), bool)  # two-byte capitals from À to Þ
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    s = SYMBOL[np.where(capital, b + 0x20, b)]
    return (s[:-2] * BASE + s[1:-1]) * BASE + s[2:]


def has_letter(text: str) -> bool:
    return bool(_ascii_letter.search(text)) or any(c.isalpha() for c in text)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def fit_svm(texts: list[str], sign: np.ndarray, cost: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights by trigram code and the bias: hinge loss, dual coordinate descent."""
    rows = []
    for t in texts:
        codes, count = np.unique(trigrams(f" {t} ".encode()), return_counts=True)
        keep = codes > 0
        rows.append((codes[keep], SCALE * count[keep] / max(1, count[keep].sum())))
    w, bias, alpha = np.zeros(BASE**3), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for _, v in rows])
    order = np.arange(len(rows))
    for r in range(rounds):
        np.random.default_rng(r).shuffle(order)
        for i in order:
            codes, v = rows[i]
            gap = sign[i] * (w[codes] @ v + bias) - 1
            new = min(max(alpha[i] - gap / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[codes] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class LanguageModel:
    """pairs: (level, a, b) of families or of languages.

    used: the trigram codes that any machine weighs, in order; weights: a row a code, a column a pair, positive
    for a. So a model is as large as the trigrams that occur, whatever the number of possible ones.
    """

    def __init__(self, langs: list[str], pairs: list[tuple[str, str, str]], used: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.pairs, self.used, self.weights, self.bias = langs, pairs, used, weights, bias
        self.place: np.ndarray | None = None

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The row of weights of each code; those that no machine weighs get the last one, of zeros."""
        if self.place is None:
            self.place = np.full(BASE**3, len(self.used), np.int32)
            self.place[self.used] = np.arange(len(self.used))
            self.weights = np.concatenate([self.weights, np.zeros((1, len(self.pairs)), np.float32)])
        return self.place[codes]

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """A row a text, a column a pair."""
        out = np.zeros((len(texts), len(self.pairs)))
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                size += len(texts[high]) + 2
                high += 1
            codes = trigrams(b"  ".join([b"", *texts[low:high], b""]))
            starts = np.cumsum([0, *(len(t) + 2 for t in texts[low : high - 1])])
            at = self.places(codes)
            for k in range(len(self.pairs)):
                out[low:high, k] = np.add.reduceat(self.weights[at, k], starts)
            out[low:high] *= SCALE / np.maximum(1, np.add.reduceat((codes > 0).astype(np.int64), starts))[:, None]
            low = high
        return out + self.bias

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and confidence of each row of margins."""
        families = sorted({family_of(x) for x in self.langs})
        members = {f: sorted(x for x in self.langs if family_of(x) == f) for f in families}
        family, sure = self._winner("family", families, margins)
        lang, score = np.zeros(len(margins), np.int64), sure
        for k, f in enumerate(families):
            of = family == k
            won, inner = self._winner(f, members[f], margins[of])
            lang[of] = np.array([self.langs.index(x) for x in members[f]])[won]
            score[of] = np.minimum(score[of], inner)
        return lang, score

    def _winner(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        lowest = np.full((len(margins), len(names)), np.inf)
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level:
                for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    j = names.index(name)
                    votes[:, j] += m > 0
                    total[:, j] += m
                    lowest[:, j] = np.minimum(lowest[:, j], m)
        if len(names) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        best = np.argmax(votes + 0.5 * np.tanh(total) / (1 + len(names)), axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(lowest[np.arange(len(best)), best], -50, 50)))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from text and lang of the documents that aren't held out."""
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    pairs += [(f, a, b) for f in families for a, b in combinations(sorted(x for x in langs if family_of(x) == f), 2)]
    learned, bias = [], np.zeros(len(pairs))
    if pairs:
        plan = []  # (lang, pair, sign, share)
        for k, (level, a, b) in enumerate(pairs):
            for x in langs:
                name = family_of(x) if level == "family" else x
                if name in (a, b) and (level == "family" or family_of(x) == level):
                    plan.append((x, k, 1.0 if name == a else -1.0, min(1.0, per_language / counts[x])))
        roles = F.broadcast(docs.sparkSession.createDataFrame(plan, "lang string, pair int, sign double, share double"))
        chosen = known.join(roles, "lang").where(unit_hash(F.col("doc_id"), 2) < F.col("share")).select("pair", "sign", "doc_id", "text")

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["doc_id", "text"])
            w, b = fit_svm(group.text.tolist(), group.sign.to_numpy())
            used = np.flatnonzero(w).astype("<i4")
            return pd.DataFrame({"pair": [group.pair.iloc[0]], "bias": [b], "codes": [used.tobytes()], "weights": [w[used].astype("<f4").tobytes()]})

        for r in chosen.groupBy("pair").applyInPandas(learn, "pair int, bias double, codes binary, weights binary").collect():
            learned.append((r.pair, np.frombuffer(r.codes, "<i4"), np.frombuffer(r.weights, "<f4")))
            bias[r.pair] = r.bias
    used = np.unique(np.concatenate([np.zeros(0, "<i4"), *(codes for _, codes, _ in learned)]))
    weights = np.zeros((len(used), len(pairs)), np.float32)
    for pair, codes, values in learned:
        weights[np.searchsorted(used, codes), pair] = values
    return LanguageModel(langs, pairs, used, weights, bias)


def prediction(model: LanguageModel, text: Column) -> Column:
    """A struct (lang_pred, score) for a text column."""
    m = model

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            live = [k for k, t in enumerate(texts) if m.langs and t is not None and has_letter(t)]
            if live:
                lang, sure = m.decide(m.margins([texts.iloc[k].encode("utf-8", "replace") for k in live]))
                names[live], score[live] = np.array(m.langs, object)[lang], sure
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row a document."""
    ship(docs.sparkSession)
    model = model or fit(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), prediction(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def recognised(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is recognised with at least that confidence."""
    ship(docs.sparkSession)
    p = "recordwell_language"
    return docs.withColumn(p, prediction(fit(docs), F.col("text"))).where((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= least)).drop(p)
