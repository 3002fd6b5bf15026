"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Units are the runs of non-blank characters of a text, lower-cased, letters only; letters set apart one by one
("i d i o t", "i.d.i.o.t") make one unit. The kernel of two units counts common subsequences of ORDER letters,
each weighted by DECAY to the length that it spans, and is normalised; gapped and inserted letters lower it, no more.
Where a letter stands between any two of a word, too little is left of the kernel, so a unit of SPACED letters or more
is also seen without every second letter.
Landmarks are units of the labelled sentences, or beginnings of units, that go with a label, spread by the kernel.
A sentence has two values at a landmark: the largest kernel of any of its units, and the convolution kernel of its text
with the landmark, the mean over all words of the text (times DENSE, FULL at most), for a word that insults where it is
frequent may be harmless where it stands alone. Two more are the same for all landmarks together, each counted by how
surely it goes with the label. In the Nystroem space of the landmarks a linear machine with squared hinge loss tells
the sentences apart. A text is as toxic as its most telling sentence; decision values are turned into probabilities by
isotonic regression on held-out folds.

Kernels below FLOOR count as 0, and only units that hold 0.6 of the letter pairs of a landmark, side by side or with one
letter between, are computed at all. Training looks at the SENTENCES sentences of a labelled text nearest to landmarks.
Very long texts are read whole; columns of any other name, clashing ones too, change nothing. Empty tables give none.
Null and empty texts have no units and get the score of a text without any. Without labels of both kinds every score
is the share of label 1 (0 without any labels). Repeated rows each get a row. Rows of labels that are null are left
out; of conflicting labels of an id the largest counts.

Bounds of what is fitted: `per_class` labelled documents of each class, `candidates` units, `landmarks` landmarks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, of_texts, text_or_empty, tidy, trim

ORDER = 3
DECAY = 0.8
FLOOR = 0.3
#: One word in so many that is as a landmark makes a text's convolution kernel with it 1; it counts up to FULL.
DENSE, FULL = 50, 1.5
#: Letters of beginnings of units that may be landmarks.
BEGINNINGS = range(4, 9)
#: Least letters of a unit that is also seen without every second one.
SPACED = 7
#: Letters of a unit seen at once; longer units are windows that overlap by half.
SPAN = 24
CACHE = 300_000
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){2,}[^\W\d_](?!\w)")
_OTHER = re.compile(r"[\W\d_]+")
_END = re.compile(r"[.!?\n]+")
PAIR_SLOTS = 512
#: Sentences of a labelled document that training looks at, those nearest to landmarks.
SENTENCES = 8
#: Rows of values that are doubles at once: the driver holds all of them as they come, in 32 bits.
ROWS = 2048


def unit(run: str) -> str:
    return _OTHER.sub("", run)


def windows(u: str) -> list[str]:
    """A unit as it is compared, in windows of SPAN letters."""
    return [u] if len(u) <= SPAN else [u[k : k + SPAN] for k in range(0, len(u) - SPAN // 2, SPAN // 2)]


def sentences(text: str) -> list[list[str]]:
    """Lower-case runs of each sentence of a text; each spelled-out word is a sentence too."""
    low = text.lower()
    out = [x.split() for x in _END.split(low)]
    if len(low) >= 5:
        out += [[_OTHER.sub("", x)] for x in _APART.findall(low)]
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Rows of code points, 0 behind the end."""
    width = max(map(len, words))
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width)


def kernel(a: list[str], b: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each a[i] with b[i], not normalised."""
    return _kernel(_codes(a), _codes(b), order, decay) if a else np.zeros(0)


def _kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """kernel() of rows of code points; 0 is behind the end."""
    n, m = t.shape
    gaps = np.arange(m)[None, :] - np.arange(m)[:, None]
    carry = np.where(gaps >= 0, decay ** (np.maximum(gaps, 0) + 2.0), 0.0)  # from a match at j' to j
    prefix = [np.ones((n, m + 1))] + [np.zeros((n, m + 1)) for _ in range(order - 1)]
    total = np.zeros(n)
    for k in range(s.shape[1]):
        letter = s[:, k : k + 1]
        match = (t == letter) & (letter != 0)
        total += decay**2 * np.einsum("ij,ij->i", match, prefix[order - 1][:, :m])
        for i in range(order - 1, 0, -1):
            later = prefix[i][:, 1:]
            later *= decay
            later += (match * prefix[i - 1][:, :m]) @ carry
    return total


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernels; 0 where a unit has fewer letters than ORDER."""
    own = {w: k for k, w in enumerate(sorted({*a, *b}))}
    names = list(own)
    self_ = np.maximum(kernel(names, names), 1e-300)
    i, j = [own[w] for w in a], [own[w] for w in b]
    return kernel(a, b) / np.sqrt(self_[i] * self_[j])


def pairs_of(codes: np.ndarray, gaps: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """Which letter pairs (side by side or with one letter between) each row of code points has, by hash slot."""
    wide = codes.astype(np.int64)
    out = np.zeros((len(codes), PAIR_SLOTS), dtype=np.float32)
    for gap in gaps:
        if wide.shape[1] > gap:
            x, y = wide[:, :-gap], wide[:, gap:]
            i, j = np.nonzero(y)
            out[i, (x[i, j] * 31 + y[i, j] * 977) % PAIR_SLOTS] = 1
    return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    #: how surely each goes with label 1, 0 to 1
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: probabilities at decision values, straight lines between
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(1))
    constant: float | None = None


class Values:
    """Largest kernels of texts with landmarks; remembers those of runs."""

    def __init__(self, landmarks: list[str], trust: np.ndarray):
        self.landmarks, self.trust = landmarks, trust
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(landmarks))), dtype=np.float32)
        self.used = 1  # row 0: nothing near any landmark
        if landmarks:
            self.codes = _codes(landmarks)
            close = pairs_of(self.codes, (1,))
            self.close = close.T.copy()
            self.least = np.maximum(2, np.ceil(0.6 * close.sum(axis=1)))
            self.self_ = kernel(landmarks, landmarks)

    def _learn(self, new: list[str]) -> None:
        unit_of: dict[str, int] = {}
        owner = [unit_of.setdefault(unit(r), len(unit_of)) for r in new]
        names, units = [], []
        for u, k in unit_of.items():
            if len(u) >= ORDER:
                parts = windows(u)
                names += parts
                units += [k] * len(parts)
        # of like length together, so that rows are hardly padded
        order = np.argsort([len(w) for w in names], kind="stable").tolist()
        place = np.zeros(len(unit_of), dtype=np.int64)
        for k in range(0, len(order), 4096):
            part = [names[x] for x in order[k : k + 4096]]
            own = np.array([units[x] for x in order[k : k + 4096]])
            codes = _codes(part)
            i, j = np.nonzero(pairs_of(codes) @ self.close >= self.least)
            if not len(i):
                continue
            near, where = np.unique(i, return_inverse=True)
            value = self._normalised(codes[near], where, j)
            # where pairs with a letter between do alone, the unit is also seen without every second letter
            spaced = (pairs_of(codes[near], (2,)) @ self.close >= self.least)[where, j] & (codes[near, SPACED - 1] > 0 if codes.shape[1] >= SPACED else np.zeros(len(near), bool))[where]
            for first in (0, 1) if spaced.any() else ():
                value[spaced] = np.maximum(value[spaced], self._normalised(codes[near, first::2], where[spaced], j[spaced]))
            keep = value >= FLOOR
            at, j, value = own[i[keep]], j[keep], value[keep]
            fresh = np.unique(at[place[at] == 0])
            while self.used + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            place[fresh] = np.arange(self.used, self.used + len(fresh))
            self.table[self.used : self.used + len(fresh)] = 0
            self.used += len(fresh)
            np.maximum.at(self.table, (place[at], j), value)
        self.rows.update(zip(new, place[owner].tolist()))

    def _normalised(self, codes: np.ndarray, where: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Normalised kernels of rows codes[where] with landmarks j."""
        own = _kernel(codes, codes)
        value = np.concatenate([_kernel(codes[where[c : c + 8192]], self.codes[j[c : c + 8192]]) for c in range(0, len(j), 8192)])
        return value / np.sqrt(np.maximum(own[where] * self.self_[j], 1e-300))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all sentences that are near any landmark, and the text that each is of.

        A row holds the largest kernels, the text's convolution kernels, and the same two over all landmarks."""
        n = len(self.landmarks)
        split = [sentences(t) for t in texts] if n else []
        if len(self.rows) > CACHE:
            self.rows, self.used = {}, 1
        self._learn(sorted({r for x in split for y in x for r in y if r not in self.rows}))
        get = self.rows.__getitem__
        flat = np.fromiter((get(r) for x in split for y in x for r in y), dtype=np.int64)
        sentence = np.repeat(np.arange(sum(map(len, split))), [len(y) for x in split for y in x])
        doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
        hit = flat > 0
        which, flat = sentence[hit], flat[hit]
        if not len(flat):
            return np.zeros((0, 2 * n + 2), dtype=np.float32), np.zeros(0, dtype=np.int64)
        words = np.bincount(doc, weights=[len(y) for x in split for y in x], minlength=len(texts))
        kernels = np.c_[self.table[flat], (self.table[flat] * self.trust).max(axis=1)]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        of = doc[which[starts]]
        own = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # texts begin at these sentences
        sums = np.add.reduceat(np.add.reduceat(kernels, starts, axis=0), own, axis=0)
        dense = np.minimum(FULL, sums * (DENSE / words[of[own]])[:, None]).astype(np.float32)
        most, dense = np.maximum.reduceat(kernels, starts, axis=0), np.repeat(dense, np.diff(np.r_[own, len(of)]), axis=0)
        return np.c_[most[:, :n], dense[:, :n], most[:, n], dense[:, n]], of


def spread(candidates: list[str], count: int, apart: float = 0.6) -> list[str]:
    """Landmarks: candidates in their order, without those whose kernel with an earlier one is over `apart`."""
    chosen: list[str] = []
    for c in candidates:
        if len(chosen) < count and not (chosen and similarity([c] * len(chosen), chosen).max() > apart):
            chosen.append(c)
    return chosen


def _doubles(values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The chosen rows as doubles with a 1 behind them, ROWS at a time, and where among the chosen ones they are."""
    for k in range(0, len(rows), ROWS):
        part = rows[k : k + ROWS]
        z = np.ones((len(part), values.shape[1] + 1))
        z[:, :-1] = values[part]
        yield slice(k, k + len(part)), z


def _times(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """values @ w in double precision."""
    out = np.empty(len(values))
    for k in range(0, len(values), ROWS):
        out[k : k + ROWS] = values[k : k + ROWS].astype(np.float64) @ w
    return out


def machine(values: np.ndarray, gram: np.ndarray, y: np.ndarray, cost: float = 2.0, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights of the landmarks, none below 0 (a landmark speaks for label 1 or not at all), and the bias.

    In the Nystroem space this is the linear machine with squared hinge loss: its squared norm is alpha' gram alpha.
    Newton steps, each solved under the bound by coordinate descent; classes weigh alike; y is 0 or 1 for each row
    that is chosen (all, if rows is None).
    """
    rows = np.arange(len(values)) if rows is None else rows
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * cost * len(gram)
    ridge = np.zeros((len(gram) + 1,) * 2)
    ridge[:-1, :-1] = gram
    ridge += 1e-6 * np.eye(len(ridge))
    w = np.zeros(len(ridge))
    told = np.zeros(len(rows))  # decision values at w
    value = np.inf
    for _ in range(40):
        slack = 1 - sign * told
        now = 0.5 * w @ ridge @ w + (share * np.maximum(0, slack) ** 2).sum()
        if now > value - 1e-7 * max(1.0, value):
            break
        value = now
        hess, goal = ridge.copy(), np.zeros(len(ridge))
        for at, z in _doubles(values, rows):
            inside = slack[at] > 0
            z = z[inside]
            a = z * (2 * share[at][inside, None])
            hess += a.T @ z
            goal += a.T @ sign[at][inside]
        new = w.copy()
        for _ in range(200):
            before = new.copy()
            for k in range(len(new)):
                x = new[k] + (goal[k] - hess[k] @ new) / hess[k, k]
                new[k] = x if k == len(new) - 1 else max(0.0, x)
            if np.abs(new - before).max() < 1e-6:
                break
        later = np.empty(len(rows))
        for at, z in _doubles(values, rows):
            later[at] = z @ new
        step = 1.0
        while step > 1e-3:
            trial = w + step * (new - w)
            if 0.5 * trial @ ridge @ trial + (share * np.maximum(0, 1 - sign * (told + step * (later - told))) ** 2).sum() < now:
                break
            step /= 2
        w, told = w + step * (new - w), told + step * (later - told)
    return w[:-1], float(w[-1])


def isotonic(d: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision values and the probabilities of label 1 there: shares of runs of values, merged until none falls.

    A run's share is drawn to that of all as by two texts more; inside a run the probability rises by a little, so
    that order isn't lost."""
    runs: list[list[float]] = []  # label 1, size, least and largest value
    for value, label in sorted(zip(d.tolist(), y.tolist())):
        runs.append([label, 1, value, value])
        while len(runs) > 1 and runs[-2][0] * runs[-1][1] >= runs[-1][0] * runs[-2][1]:
            k, n, _, high = runs.pop()
            runs[-1] = [runs[-1][0] + k, runs[-1][1] + n, runs[-1][2], high]
    share = np.maximum.accumulate([(k + 2 * y.mean()) / (n + 2) for k, n, _, _ in runs])
    step = 0.05 * np.diff(np.r_[0, share, 1])
    ends = np.array([r[2:] for r in runs])
    return ends.ravel(), np.stack([share - step[:-1], share + step[1:]], axis=1).ravel()


def chances(model: Model, decisions: np.ndarray) -> np.ndarray:
    """Probabilities of label 1; beyond the values seen they still rise."""
    beyond = np.minimum(1, np.maximum(0, decisions - model.at[-1])) - np.minimum(1, np.maximum(0, model.at[0] - decisions))
    return np.clip(np.interp(decisions, model.at, model.chance) + 0.01 * beyond, 0, 1)


def decide(model: Model, values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Decision values of n texts: that of their most telling sentence, the bias where none is near a landmark."""
    out = np.full(n, model.bias)
    np.maximum.at(out, doc, _times(values, model.weights) + model.bias)
    return out


def fit(landmarks: list[str], trust: np.ndarray, values: np.ndarray, doc: np.ndarray, y: np.ndarray, folds: int = 3, rounds: int = 3) -> Model:
    """y: 0 or 1 for each text. A text of label 1 has at least one telling sentence: the one that the machine of
    the round before finds most telling (at first, the one nearest to the foremost landmarks) stands for it."""
    gram = similarity([a for a in landmarks for _ in landmarks], landmarks * len(landmarks)).reshape(len(landmarks), len(landmarks))
    n, half = len(landmarks), (gram + gram.T) / 2
    gram = np.eye(2 * n + 2)
    gram[:n, :n] = gram[n:-2, n:-2] = half
    none = np.setdiff1d(np.arange(len(y)), doc)  # texts without a sentence near any landmark
    if len(none):
        values, doc = np.r_[values, np.zeros((len(none), values.shape[1]), values.dtype)], np.r_[doc, none]

    def train(own: np.ndarray) -> tuple[np.ndarray, float]:
        told, w, b = _times(values, np.r_[np.tile(1 / np.sqrt(1 + np.arange(n)), 2), 1, 1]), np.zeros(len(gram)), 0.0
        for _ in range(rounds):
            order = np.lexsort((-told, doc))
            first = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
            speaks = np.zeros(len(doc), dtype=bool)
            speaks[first] = True
            rows = np.flatnonzero(own[doc] & (speaks | (y[doc] <= 0)))
            w, b = machine(values, gram, y[doc[rows]], rows=rows)
            told = _times(values, w) + b
        return w, b

    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        w, b = train(fold != k)
        held[fold == k] = decide(Model(landmarks, trust, w, b), values, doc, len(y))[fold == k]
    w, b = train(fold >= 0)
    return Model(landmarks, trust, w, b, *isotonic(held, y))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, candidates: int = 400, landmarks: int = 96
) -> Model:
    """A model from the labelled documents; `labels` has the id and 0 or 1. Samples are the first by a hash of the id."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = None
    for y in (0, 1):
        part = own.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
    rows = rows.join(F.broadcast(sample), rows["_doc"] == sample["_id"]).groupBy("_doc", "_y").agg(F.min("_text").alias("_text"))  # 2 * per_class rows
    rows = rows.cache()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "_text"):
            found: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(w for x in sentences(text) for r in x if ORDER <= len(w := unit(r)) <= 16)
                for w, n in list(own.items()):
                    for k in BEGINNINGS:
                        if k < len(w):
                            own[w[:k]] += n
                for w, n in own.items():
                    row = found.setdefault(w, [0, 0, 0, 0])
                    row[y] += 1
                    row[2 + y] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([r[k] for r in found.values()], pa.int64()) for k in range(4))], ["unit", "d0", "d1", "c0", "c1"])

    sizes = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        rows.unpersist()
        return Model(constant=n1 / (n1 + n0) if n1 + n0 else 0.0)
    seen = rows.select("_y", "_text").mapInArrow(tidy(units), "unit string, d0 long, d1 long, c0 long, c1 long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1"))).cache()
    m0, m1 = seen.agg(F.sum("c0"), F.sum("c1")).first()
    odds = lambda a, b, n, m: F.log((F.col(a) + 0.5) / (n + 1.0)) - F.log((F.col(b) + 0.5) / (m + 1.0))
    often = odds("c1", "c0", float(m1 or 0), float(m0 or 0))  # by words
    sure = odds("d1", "d0", float(n1), float(n0)) - 1.64 * F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))  # by texts, the least that is likely
    told = seen.filter((F.col("d1") >= max(3, round(0.006 * n1))) & (often > 1.5)).orderBy((F.sqrt("d1") * often).desc(), "unit").limit(candidates)
    trusted = {r[0]: min(1.0, max(0.05, r[1] / 4)) ** 2 for r in told.select("unit", sure).collect()}
    seen.unpersist()
    names = spread(list(trusted), landmarks)
    trust = np.array([trusted[x] for x in names], dtype=np.float32)
    if not names:
        rows.unpersist()
        return Model(constant=n1 / (n1 + n0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(names, trust)
        for batch in in_pieces(batches, "_text"):
            v, doc = values.of(batch.column(2).to_pylist())
            near = [v[doc == i] for i in range(batch.num_rows)]
            near = [x[np.argsort(-x[:, : len(names)].max(axis=1), kind="stable")[:SENTENCES]] if len(x) else x for x in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.ravel() for x in near], pa.list_(pa.float32()))], ["id", "y", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = rows.select("_doc", "_y", "_text").mapInArrow(tidy(measure), f"id {kind}, y int, v array<float>").toArrow()
    rows.unpersist()
    values, doc, y = _gathered(table, 2 * len(names) + 2)
    del table
    model = fit(names, trust, values, doc, y)
    del values
    trim()
    return model


def _gathered(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all sentences in the order of their texts' ids, the text that each is of, and y of the texts.

    A text without a sentence has a row of zeros."""
    ids = table.column("id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column("v").chunks]) // width
    held = np.maximum(1, sizes)
    start = np.zeros(len(ids), dtype=np.int64)
    start[order] = np.r_[0, np.cumsum(held[order])[:-1]]
    values, k = np.zeros((int(held.sum()), width), dtype=np.float32), 0
    for chunk in table.column("v").chunks:
        flat, at = chunk.flatten().to_numpy().reshape(-1, width), 0
        for n, to in zip(sizes[k : k + len(chunk)].tolist(), start[k : k + len(chunk)].tolist()):
            values[to : to + n] = flat[at : at + n]
            at += n
        k += len(chunk)
    return values, np.repeat(np.arange(len(ids)), held[order]), table.column("y").to_numpy()[order]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kept columns or the id, score): the probability of label 1 for each whole text."""
    kept = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and their weights

    def run(pieces: Iterator[list[str]]) -> Iterator[pa.Array]:
        m = shared.value
        values = Values(m.landmarks, m.trust)
        for texts in pieces:
            if m.constant is not None:
                yield pa.array(np.full(len(texts), m.constant), pa.float64())
            else:
                yield pa.array(chances(m, decide(m, *values.of(texts), len(texts))), pa.float64())

    plan = docs.select(*(docs[c].alias(f"_k{i}") for i, c in enumerate(kept)), of_texts(run, "double", text_or_empty(text_col)).alias("_score"))
    return plan.toDF(*kept, "score")
