"""Language identification as inference of a mixture of languages.

Learning: per language, counts of hashed letter trigrams (word ends count as a letter) over a bounded sample of
labelled documents give smoothed trigram probabilities. Prediction: each word of a whole text has a likelihood
under each language, the product over its trigrams. Expectation-maximisation estimates the document's language
proportions; sets of the 1, 2, ... most likely languages are fitted and the set with the best penalised
likelihood is taken. The language with the largest proportion in it is the prediction, the proportion its score.
Beside these the set is mixed with a language that isn't known, in which every trigram is equally likely: the share
of words that go to it is `unknown`, 0 if its likelihood can't pay the penalty.

Null, empty and letterless texts: language `und`, score 0. With nothing to learn from, all are `und`.
Ties go to the language whose name sorts first. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, of_texts, text_or_empty, tidy

UNKNOWN = "und"
#: Trigram hash buckets.
SLOTS = 1 << 16
#: Words whose likelihoods a worker remembers.
CACHE = 200_000
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all letter trigrams of the words, the word that each is in, and whether each word has a letter."""
    joined = " ".join(words)
    points = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.cumsum(points == 32) - 1
    letter = letters()[points]
    has = np.zeros(len(words) + 1, dtype=bool)
    has[word[letter]] = True
    p = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | (points == 32)
    # what isn't a letter splits words as a blank does; runs of it count once
    first = np.ones(len(p), dtype=bool)
    first[1:] = (p[1:] != 32) | (p[:-1] != 32) | keep[1:]
    p, word = p[first], word[first]
    h = p[:-2] * _MUL[0] + p[1:-1] * _MUL[1] + p[2:] * _MUL[2]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slot = (h >> np.uint64(48)).astype(np.int64) % SLOTS
    real = p[1:-1] != 32
    return slot[real], word[1:-1][real], has[: len(words)]


@dataclass
class Model:
    languages: list[str]
    #: natural logarithms of trigram probabilities, slots x languages
    log_p: np.ndarray
    rounds: int = 8
    penalty: float = 3.0


class Scorer:
    """Applies a model to texts; remembers the likelihoods of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((1024, max(1, len(model.languages))), dtype=np.float32)
        #: logarithm of a word's likelihood in an unknown language over that in its likeliest one
        self.strange = np.zeros(1024, dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        """Rows of the table for new words; -1 for those without letters."""
        if not words:
            return
        k = self.used
        slot, word, has = trigrams(words)
        total = np.zeros((len(words), self.table.shape[1]), dtype=np.float64)
        if len(slot):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            total[word[starts]] = np.add.reduceat(self.model.log_p[slot], starts, axis=0)
        strange = -np.log(SLOTS) * np.bincount(word, minlength=len(words)) - total.max(axis=1)
        rows = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -60))
        n = int(has.sum())
        while k + n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.strange = np.concatenate([self.strange, np.zeros_like(self.strange)])
        self.table[k : k + n] = rows[has]
        self.strange[k : k + n] = np.clip(strange[has], -60, 60)
        places = np.where(has, k + np.cumsum(has) - 1, -1)
        self.rows.update(zip(words, places.tolist()))
        self.used = k + n

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of all words with letters, up to a factor a word, and how many of them each text has."""
        rows, count = self._rows(texts)
        return self.table[rows].astype(np.float64), count

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for all words with letters, and how many of them each text has."""
        split = [t.lower().split() for t in texts]
        if len(self.rows) > CACHE:
            self.rows, self.used = {}, 0
        new = {w for words in split for w in words if w not in self.rows}
        self._learn(sorted(new))
        get = self.rows.__getitem__
        flat = np.fromiter((get(w) for words in split for w in words), dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        real = flat >= 0
        return flat[real], np.bincount(doc[real], minlength=len(texts))

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions of the languages in each text (rows of zeros: no letters), how many words were judged, and the
        share of an unknown language beside these."""
        m = len(self.model.languages)
        if not m:
            return np.zeros((len(texts), 0)), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        rows, count = self._rows(texts)
        like = self.table[rows].astype(np.float64)
        out, unknown = np.zeros((len(texts), m)), np.zeros(len(texts))
        live = np.flatnonzero(count)
        if not len(live):
            return out, count, unknown
        n = count[live]
        starts = np.r_[0, np.cumsum(n)[:-1]]
        doc = np.repeat(np.arange(len(live)), n)

        def fit(theta: np.ndarray, like: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(self.model.rounds):
                part = like * theta[doc]
                part /= part.sum(axis=1, keepdims=True)
                theta = np.add.reduceat(part, starts, axis=0) / n[:, None]
            return theta, np.add.reduceat(np.log((like * theta[doc]).sum(axis=1)), starts)

        theta, _ = fit(np.full((len(live), m), 1 / m), like, doc, starts, n)
        order = np.argsort(-theta, axis=1, kind="stable")
        best = np.zeros((len(live), m))
        single = np.add.reduceat(np.log(like), starts, axis=0)
        top = single.argmax(axis=1)
        best[np.arange(len(live)), top] = 1
        score = single[np.arange(len(live)), top]
        for width in range(2, m + 1):
            # a language with hardly a word can't pay for the penalty
            open_ = theta[np.arange(len(live)), order[:, width - 1]] * n > 0.5
            if not open_.any():
                break
            of = np.flatnonzero(open_)
            words = open_[doc]
            n2 = n[of]
            starts2 = np.r_[0, np.cumsum(n2)[:-1]]
            doc2 = np.repeat(np.arange(len(of)), n2)
            allowed = np.zeros((len(of), m))
            np.put_along_axis(allowed, order[of, :width], 1.0, axis=1)
            seed = theta[of] * allowed + 1e-12 * allowed
            fitted, value = fit(seed / seed.sum(axis=1, keepdims=True), like[words], doc2, starts2, n2)
            value = value - self.model.penalty * (width - 1) * np.log(n2 + 1)
            better = value > score[of]
            best[of[better]], score[of[better]] = fitted[better], value[better]
        out[live] = best
        ratio = np.exp(self.strange[rows].astype(np.float64))
        known = (like * best[doc]).sum(axis=1)
        share = np.full(len(live), 0.5)
        for _ in range(self.model.rounds):
            part = ratio * share[doc]
            share = np.add.reduceat(part / (part + known * (1 - share[doc])), starts) / n
        gain = np.add.reduceat(np.log(ratio * share[doc] + known * (1 - share[doc])) - np.log(known), starts)
        unknown[live] = np.where(gain > self.model.penalty * np.log(n + 1), share, 0)
        return out, count, unknown


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, smoothing: float = 0.1) -> Model:
    """Trigram probabilities from about per_language documents of each language, drawn by a hash of the text."""
    rows = docs.select(text_or_empty(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((SLOTS, 0)))
    share = F.coalesce(*(F.when(F.col("_lang") == k, F.lit(min(1.0, per_language / v))) for k, v in sizes.items()))
    sample = rows.filter((F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) / (1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text", 4 << 20):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs.tolist())):
                words = [w for t, own in zip(texts, langs == lang) if own for w in t.lower().split()]
                if words:
                    slot, n = np.unique(trigrams(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int64()), pa.array(n, pa.int64())], ["lang", "slot", "n"])

    counted = sample.mapInArrow(tidy(run), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # slots x languages rows at most
    languages = sorted(sizes)
    table = np.zeros((SLOTS, len(languages)))
    table[counted["slot"].to_numpy(dtype=np.int64), [languages.index(x) for x in counted["lang"]]] = counted["n"].to_numpy(dtype=np.float64)
    return Model(languages, np.log((table + smoothing) / (table.sum(axis=0) + smoothing * SLOTS)))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kept columns or the id, lang_pred, score, languages: the selected set, best first, unknown: share of an unknown language)."""
    kept = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages numbers

    def run(pieces: Iterator[list[str]]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        names = shared.value.languages
        for texts in pieces:
            theta, count, unknown = scorer.mixtures(texts)
            pred, score, sets = [], [], []
            for row, n in zip(theta, count):
                if not n or not len(names):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append([])
                else:
                    order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    pred.append(names[order[0]])
                    score.append(float(min(1.0, row[order[0]])))
                    sets.append([names[i] for i in order])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(unknown, pa.float64())], ["pred", "score", "set", "unknown"])

    found = of_texts(run, "pred string, score double, set array<string>, unknown double", text_or_empty(text_col))
    plan = docs.select(*(docs[c].alias(f"_k{i}") for i, c in enumerate(kept)), found.alias("_found"))
    return plan.select(*plan.columns[:-1], "_found.*").toDF(*kept, "lang_pred", "score", "languages", "unknown")
