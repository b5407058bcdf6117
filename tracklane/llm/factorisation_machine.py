"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the last
sum is half of (sum v_i x_i)**2 - sum (v_i x_i)**2 in each of the few factors:
linear in the features. Features are every word (hashed; weight one over the
text's words), bins of structure statistics of the text, and a bin of the
row's own n_chars.

Fitting takes at most `max_rows` labelled rows: those of the least seeded hash of
their ids, so a bounded sample whatever the table's size. Every document is
scored from its whole text, with the weights broadcast (fixed size).

Edge cases: null text is empty and is scored by its bins; a null n_chars is a bin
of its own; several labels of one id count as the least; without any labelled
row the score is 1/2; other columns are ignored or carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _blocks as B, _text as X

WORD_BITS = 14
#: Words summed at a time.
STEP = 1 << 16
#: Bins of each structure statistic, by their edges.
_SHARE = (0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1, 0.13, 0.17, 0.22, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 1.0)
EDGES = {
    "upper": _SHARE,
    "signs": _SHARE,
    "digits": _SHARE,
    "beyond_ascii": _SHARE,
    "distinct_words": _SHARE,
    "commonest_word": _SHARE,
    "repeats_last_word": _SHARE,
    "distinct_lines": _SHARE,
    "word_bytes": (0, 1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15, 20, 40),
    "words_a_line": (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 1024),
    "log_words": tuple(range(0, 24)),
    "log_chars": tuple(range(-1, 24)),
}
_FIRST = np.cumsum([1 << WORD_BITS, *(len(e) + 1 for e in EDGES.values())])
SIZE = int(_FIRST[-1])
_UPPER, _DIGIT, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def features(texts, n_chars: np.ndarray):
    """(word indexes, first word of each text, bins: one of each statistic)."""
    data, off = X.buffers(texts)
    n = len(off) - 1
    bounds = lambda mask: np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][off])
    size = np.maximum(np.diff(off), 1)
    signs = {"upper": bounds(_UPPER[data]) / size, "signs": bounds(_SIGN[data]) / size, "digits": bounds(_DIGIT[data]) / size, "beyond_ascii": bounds(data > 127) / size}
    start, end, doc, h = X.words(data, off, lower=True)
    first = X.starts_of(doc, n)
    words = np.diff(first)
    _, _, line_doc, line = X.words(data, off, separator=~_NEWLINE)
    line_first = X.starts_of(line_doc, n)
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    many = np.maximum(words, 1)
    distinct, commonest, lines = np.zeros(n), np.zeros(n), np.ones(n)
    for i in range(n):
        if words[i]:
            counts = np.unique(h[first[i] : first[i + 1]], return_counts=True)[1]
            distinct[i], commonest[i] = len(counts) / words[i], counts.max() / words[i]
            k = line_first[i + 1] - line_first[i]
            if k > 1:
                lines[i] = len(np.unique(line[line_first[i] : line_first[i + 1]])) / k
    total = lambda v: np.diff(np.r_[0, np.cumsum(v)][first])
    stats = signs | {
        "distinct_words": distinct,
        "commonest_word": commonest,
        "repeats_last_word": total(same) / many,
        "distinct_lines": lines,
        "word_bytes": total(end - start) / many,
        "words_a_line": words / np.maximum(np.diff(line_first), 1),
        "log_words": np.log2(1.0 + words),
        "log_chars": np.where(np.isnan(n_chars), -2.0, np.log2(1.0 + np.maximum(np.nan_to_num(n_chars), 0))),
    }
    bins = np.stack([np.searchsorted(EDGES[k], stats[k], "right") + _FIRST[i] for i, k in enumerate(EDGES)], 1) if n else np.zeros((0, len(EDGES)), np.int64)
    return (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32), first, bins.astype(np.int32)


@dataclass
class Machine:
    """Weights of every feature and of all: the bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, words, first, bins) -> np.ndarray:
        many = np.maximum(np.diff(first), 1).astype(np.float64)
        out = self.bias + self.linear[bins].sum(1)
        rows = self.factors[bins]
        s, q = rows.sum(1), (rows**2).sum(1)
        doc = np.repeat(np.arange(len(many)), np.diff(first))
        for lo in range(0, len(words), STEP):  # bounds the temporaries of a long text
            d, w = doc[lo : lo + STEP], words[lo : lo + STEP]
            add = lambda v: np.bincount(d, v, len(many))  # noqa: E731, B023
            out += add(self.linear[w]) / many
            for f in range(s.shape[1]):
                v = self.factors[w, f]
                s[:, f] += add(v) / many
                q[:, f] += add(v**2) / many**2
        return out + 0.5 * (s**2 - q).sum(1)

    def score(self, words, first, bins) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(words, first, bins), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Adaptive gradient descent of the logistic loss over (word indexes, bins) of each row."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, factors)))
    if not len(rows) or labels.min() == labels.max():
        m.factors[:] = 0
        m.bias = 0.0 if not len(rows) else (3.0 if labels.min() else -3.0)
        return m
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seen_l, seen_f, seen_b = np.full(SIZE, 1e-3), np.full((SIZE, factors), 1e-3), 1e-3
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            words = np.concatenate([rows[i][0] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            first = np.r_[0, np.cumsum(sizes)]
            bins = np.stack([rows[i][1] for i in part])
            g = m.score(words, first, bins) - labels[part]
            many = np.maximum(sizes, 1).astype(float)
            idx = np.r_[words, bins.ravel()]
            row = np.r_[np.repeat(np.arange(len(part)), sizes), np.repeat(np.arange(len(part)), bins.shape[1])]
            x = np.r_[np.repeat(1 / many, sizes), np.ones(bins.size)]
            v = m.factors[idx]
            s = np.stack([np.bincount(row, v[:, f] * x, len(part)) for f in range(factors)], 1)
            gx = g[row] * x
            touched, back = np.unique(idx, return_inverse=True)
            gl = np.bincount(back, gx, len(touched)) / len(part) + decay * m.linear[touched]
            gf = np.stack([np.bincount(back, gx * (s[row, f] - v[:, f] * x), len(touched)) for f in range(factors)], 1) / len(part) + decay * m.factors[touched]
            gb = g.mean()
            seen_l[touched] += gl**2
            seen_f[touched] += gf**2
            seen_b += gb**2
            m.linear[touched] -= rate * gl / np.sqrt(seen_l[touched])
            m.factors[touched] -= rate * gf / np.sqrt(seen_f[touched])
            m.bias -= rate * gb / np.sqrt(seen_b)
    return m


def _chars(batch) -> np.ndarray:
    return batch["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def _inputs(documents: DataFrame, id_col: str, text_col: str, chars_col: str | None, extra: list[Column]) -> DataFrame:
    chars = F.col(chars_col).cast("double") if chars_col and chars_col in documents.columns else F.lit(None).cast("double")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"), *extra)


def train(documents: DataFrame, labels: DataFrame, use: Column, max_rows: int = 6_000, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", seed: int = 5, **fitting) -> Machine:
    """A machine fitted to at most `max_rows` of the labels for which `use`, a condition on doc_id, holds."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).filter(use)
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    rows = _inputs(documents, id_col, text_col, chars_col, []).join(F.broadcast(chosen), "doc_id")  # max_rows ids

    def extract(batches):
        for part in X.slices(batches):
            words, first, bins = features(part["text"], _chars(part))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["label"], pa.array([words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([b.tobytes() for b in bins], pa.binary())],
                ["doc_id", "label", "words", "bins"],
            )

    got = rows.mapInArrow(extract, "doc_id bigint, label int, words binary, bins binary").toArrow().sort_by("doc_id")
    data = [(np.frombuffer(w, np.int32), np.frombuffer(b, np.int32)) for w, b in zip(got["words"].to_pylist(), got["bins"].to_pylist(), strict=True)]
    return fit(data, got["label"].to_numpy().astype(float), **fitting)


def score(documents: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, then the carried columns, for every document."""
    held = documents.sparkSession.sparkContext.broadcast(machine)
    names = [f"_carry_{i}" for i in range(len(carry))]
    rows = _inputs(documents, id_col, text_col, chars_col, [F.col(c).alias(n) for n, c in zip(names, carry, strict=True)])

    def judge(batches):
        for part in X.slices(batches):
            s = held.value.score(*features(part["text"], _chars(part)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s, pa.float64()), *(part[n] for n in names)], ["doc_id", "score", *names])

    return rows.mapInArrow(judge, B.carried("doc_id bigint, score double", rows, names)).withColumnsRenamed(dict(zip(names, carry, strict=True)))
