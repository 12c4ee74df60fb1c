"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of three symbols, with gaps: an occurrence
that spreads over s symbols more than three weighs DECAY ** s (spread at most
REACH). A unit is a stretch of UNIT starting places in one token, and the kernel
is normalised by each unit's own weight. Inserted characters cost little: white
space parts tokens, all that is neither letter nor digit is skipped within them,
and a run of one-symbol tokens is one token.

The machine is trained on the driver from a bounded sample of labelled texts.
Which units of a toxic text carry its label is not known, so its best ones are
taken, trained on, and taken anew (multiple-instance learning). Landmarks are
training units; the machine is linear in the Nystroem features, and
so a weight for each symbol triple: scoring a text needs one table look-up per
triple, for all places of all texts of a chunk at once. A text's score is
calibrated on its TOP best tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kinweave.llm import _flat

DECAY, REACH, UNIT = 0.6, 4, 6
#: Bits of a symbol; letters a-z and digits keep symbols of their own.
_BITS = 7
_HOPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH + 1 - a)]
_WEIGHTS = [DECAY ** (a + b - 2) for a, b in _HOPS]
_OWN = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)}
_REST = np.array([s for s in range(1, 1 << _BITS) if s not in _OWN], np.uint32)
#: Least weight of a unit, so that one chance triple of a short token counts little.
_FLOOR = 2.0
_EMPTY = -2.0
#: A text is judged by so many of its tokens: one chance likeness is no insult.
TOP = 3
#: Texts held as units of their own during training, to bound memory.
TRAIN_TEXTS = 64
#: Smoothing of triple counts, against chance triples of small samples.
PRIOR = 3.0


def _symbols() -> np.ndarray:
    """Symbol of each code point; 0: neither letter nor digit."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
            table[c] = c if c in _OWN else _REST[c % len(_REST)]
    return table


_TABLE: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_symbols())
    return _TABLE[0]


class Units:
    """All units of a chunk of texts."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        code = np.frombuffer(" ".join(lowered).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        symbol = _symbol_table()[code]
        white = np.isin(code, _WHITE)
        text = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))[: len(code)]
        token = np.cumsum(white)
        keep = symbol > 0
        symbol, token, text = symbol[keep], token[keep], text[keep]
        if not len(symbol):
            self.symbol, self.last, self.text, self.heads = symbol, np.zeros(0, np.int64), text, np.zeros(0, np.int64)
            return
        new = np.concatenate([[True], token[1:] != token[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(symbol)))
        single = sizes == 1
        owner = text[heads]
        joins = np.concatenate([[False], single[1:] & single[:-1] & (owner[1:] == owner[:-1])])
        heads = heads[~joins]
        sizes = np.diff(np.append(heads, len(symbol)))
        # an anchor, symbol 0, before each token
        self.symbol = np.insert(symbol, heads, 0).astype(np.int32)
        self.text = np.insert(text, heads, text[heads]).astype(np.int32)
        self.heads = heads + np.arange(len(heads))
        self.last = np.repeat(self.heads + sizes, sizes + 1).astype(np.int32)

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(valid, code, weight) for each pair of hops, by starting place."""
        n = len(self.symbol)
        padded = np.concatenate([self.symbol, np.zeros(REACH, np.int32)])
        left = self.last - np.arange(n, dtype=np.int32)
        for (a, b), w in zip(_HOPS, _WEIGHTS):
            yield left >= a + b, (padded[:n] << 2 * _BITS) | (padded[a : a + n] << _BITS) | padded[a + b : a + b + n], w

    def ends(self) -> np.ndarray:
        return np.minimum(np.arange(len(self.symbol)) + UNIT, self.last + 1)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Normalised inner product of each unit with triple weights."""
        n = len(self.symbol)
        got, own = np.zeros(n), np.zeros(n)
        for valid, code, w in self.triples():
            got += np.where(valid, weights[code], 0) * w
            own += valid * (w * w)
        got, own = (np.concatenate([[0], np.cumsum(x)]) for x in (got, own))
        end, at = self.ends(), np.arange(n)
        return (got[end] - got[at]) / np.sqrt(np.maximum(own[end] - own[at], _FLOOR))

    def features(self, unit: int) -> dict[int, float]:
        """Sparse normalised feature map of one unit."""
        out: dict[int, float] = {}
        own, last = 0.0, int(self.last[unit])
        for i in range(unit, min(unit + UNIT, last + 1)):
            for (a, b), w in zip(_HOPS, _WEIGHTS):
                if i + a + b <= last:
                    code = int((self.symbol[i] << 2 * _BITS) | (self.symbol[i + a] << _BITS) | self.symbol[i + a + b])
                    out[code] = out.get(code, 0.0) + w
                    own += w * w
        scale = max(own, _FLOOR) ** 0.5
        return {c: v / scale for c, v in out.items()}

    def best(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, text) of the best unit of each token."""
        top = np.maximum.reduceat(margin, self.heads)
        token = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(margin))))
        at = np.flatnonzero(margin == top[token])
        unit = at[np.unique(token[at], return_index=True)[1]]
        return unit, self.text[unit]


_WHITE = np.array([9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


@dataclass
class ToxicityModel:
    """Weights of symbol triples, and of a text's TOP highest token margins."""

    weights: np.ndarray
    slopes: np.ndarray
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        units = Units(texts)
        out = np.full((len(texts), TOP), _EMPTY)
        if not len(units.symbol):
            return out
        top = np.maximum.reduceat(units.margins(self.weights), units.heads)
        text = units.text[units.heads]
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(text))))
        for r in range(TOP):
            first = np.maximum.reduceat(top, heads)
            out[text[heads], r] = np.maximum(first, _EMPTY)
            at = np.flatnonzero(top == first[owner])
            top[at[np.unique(owner[at], return_index=True)[1]]] = -np.inf
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(np.round(self.margins(texts), 9) @ self.slopes + self.shift, -50, 50))), 9)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Squared-hinge linear machine by accelerated gradient steps."""
    w = look = np.zeros(x.shape[1])
    step = 1 / (2 * float(np.linalg.norm((x * cost[:, None]).T @ x, 2)) + ridge)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        nxt = look - step * (ridge * look - 2 * x.T @ (cost * y * slack))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = nxt + (t - 1) / t_next * (nxt - w), nxt, t_next
    return w


def train(texts: list[str], labels: list[int], landmarks: int = 256, rounds: int = 4, per_text: int = 12, folds: int = 2, prevalence: float | None = None, seed: int = 5) -> ToxicityModel:
    """The machine from labelled texts, calibrated on margins that texts get from
    machines not trained on them (of `folds`). With one class only, all texts
    score the smoothed share of label 1. prevalence: the share of label 1 where the
    texts come from (default: among the texts)."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(1 << (3 * _BITS), np.float32), np.zeros(TOP), float(np.log(share / (1 - share))))
    fold = np.zeros(len(y), int)
    for value in (0, 1):
        mine = np.flatnonzero(y == value)
        fold[mine] = np.arange(len(mine)) % folds

    def learned(own: list[str], values: np.ndarray) -> np.ndarray:
        weights = _weights(own, values, landmarks, rounds, per_text, seed)
        _flat.give_back()  # the driver lives on, and would keep what training took
        return weights

    m = np.full((len(y), TOP), _EMPTY)
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and y[rest].min() < y[rest].max():
            machine = ToxicityModel(learned([texts[i] for i in rest], y[rest]), np.zeros(TOP), 0.0)
            m[own] = np.concatenate([machine.margins([texts[j] for j in own[i : i + TRAIN_TEXTS]]) for i in range(0, len(own), TRAIN_TEXTS)])
    return ToxicityModel(learned(texts, y), *_calibrate(m, y, prevalence if prevalence is not None else float(y.mean())))


def _weights(texts: list[str], y: np.ndarray, landmarks: int, rounds: int, per_text: int, seed: int) -> np.ndarray:
    """Triple weights of the machine that is linear in the Nystroem features."""
    size = 1 << (3 * _BITS)
    parts = [(i, Units(texts[i : i + TRAIN_TEXTS])) for i in range(0, len(texts), TRAIN_TEXTS)]
    parts = [(i, u) for i, u in parts if len(u.symbol)]
    # to begin with, smoothed log odds of a triple in the texts of either class
    seen = np.zeros((2, size), np.float32)
    for i, units in parts:
        told = y[i + units.text]
        for valid, code, _ in units.triples():
            for value in (0, 1):
                codes, counts = np.unique(code[valid & (told == value)], return_counts=True)
                seen[value, codes] += counts
    total = seen.sum(axis=1)
    share = np.maximum(total, 1) / max(float(total.sum()), 1.0)
    weights = np.maximum(np.log((seen[1] + PRIOR * share[1]) / share[1]) - np.log((seen[0] + PRIOR * share[0]) / share[0]), 0)
    del seen
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        found = []
        for p, (i, units) in enumerate(parts):
            margin = units.margins(weights)
            at, own = units.best(margin)
            found.append((np.full(len(at), p), at, own + i, margin[at]))
        part, unit, text, margin = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 4
        order = np.lexsort((-margin, text))
        part, unit, text, margin = part[order], unit[order], text[order], margin[order]
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, int)
        sizes = np.diff(np.append(heads, len(text)))
        place = np.arange(len(text)) - np.repeat(heads, sizes)
        leading = (place < per_text) & (margin >= 0.5 * np.repeat(margin[heads], sizes))
        positive = np.flatnonzero(leading & (y[text] == 1))
        hard = np.flatnonzero((place < per_text // 3) & (y[text] == 0))
        plain = np.flatnonzero(y[text] == 0)
        negative = np.unique(np.concatenate([hard, rng.choice(plain, min(len(plain), len(hard) // 2 + 100), replace=False)]))
        if not len(positive) or not len(negative):
            break
        rows = [parts[part[i]][1].features(int(unit[i])) for i in np.concatenate([positive, negative])]
        # landmarks: the most frequent units of either class
        marks = []
        for part in (rows[: len(positive)], rows[len(positive) :]):
            alike: dict[tuple, list[int]] = {}
            for i, r in enumerate(part):
                alike.setdefault(tuple(r.items()), []).append(i)
            marks += [part[v[0]] for v in sorted(alike.values(), key=lambda v: (-len(v), v[0]))[: landmarks // 2]]
        column = {c: i for i, c in enumerate(sorted({c for m in marks for c in m}))}

        def dense(part: list[dict[int, float]]) -> np.ndarray:
            out = np.zeros((len(part), len(column)), np.float32)
            for i, r in enumerate(part):
                for c, v in r.items():
                    if c in column:
                        out[i, column[c]] = v
            return out

        basis = dense(marks)
        value, vector = np.linalg.eigh((basis @ basis.T).astype(float))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])  # K^(-1/2) up to a rotation
        x = np.concatenate([dense(rows[i : i + 500]) @ basis.T @ root for i in range(0, len(rows), 500)])
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        cost = np.where(sign > 0, 0.5 / len(positive), 0.5 / len(negative))
        machine = _svm(np.hstack([x, np.ones((len(x), 1))]), sign, cost)
        weights = np.zeros(size, np.float32)
        weights[list(column)] = basis.T @ (root @ machine[:-1])
    return weights.astype(np.float32)


def _calibrate(m: np.ndarray, y: np.ndarray, prevalence: float) -> tuple[np.ndarray, float]:
    """A logistic model over the margins, classes weighing by the geometric
    mean of how often they occur and of one half (Newton steps, lightly held)."""
    x = np.hstack([m, np.ones((len(m), 1))])
    c = np.zeros(x.shape[1])
    share = min(max((prevalence * 0.5) ** 0.5, 0.01), 0.99)
    balance = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    hold = np.array([3e-4] * m.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -50, 50)))
        h = balance * p * (1 - p)
        c = c - np.linalg.solve((x * h[:, None]).T @ x + np.diag(hold), x.T @ (balance * (p - y)) + hold * c)
    return c[:-1], float(c[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 800, max_chars: int = 30_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from at most `per_class` labelled texts of each class, of at most
    max_chars characters each: those of the lowest hashes of their ids. Held-out
    rows, null ids, null texts and labels other than 0 and 1 are not learned from."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(~held_out("id") & F.col("id").isNotNull() & (F.length("text") <= max_chars))
    texts: list[str] = []
    values: list[int] = []
    for value in (0, 1):
        chosen = told.filter((F.col("label") == value) & ~held_out("id") & F.col("id").isNotNull()).join(base.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(per_class)
        rows = base.join(F.broadcast(chosen.select("id")), "id", "left_semi").orderBy("id", "text").limit(per_class).select("text").collect()
        texts += [r["text"] for r in rows]
        values += [value] * len(rows)
    shares = {r["label"]: r["n"] for r in told.filter(~held_out("id")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    return train(texts, values, prevalence=shares.get(1, 0) / max(1, sum(shares.values())))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per text with all columns of docs, score double (0 to 1) and
    predicted int; columns of docs with these names are replaced. Whole texts are
    scored; null and empty texts score as texts without any word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = batch.column(at).fill_null("")
            _, offsets = _flat.utf8(column)
            parts = [own.scores(column.slice(i, j - i).to_pylist()) for i, j in _flat.chunks(offsets, 1 << 20)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    base = docs.drop("score", "predicted").withColumn(text_col, F.col(text_col).cast("string"))
    return base.mapInArrow(_flat.trimmed(run), StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
