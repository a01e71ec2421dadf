"""Quality rules: a hashed word and character n-gram classifier behind two fixed rules.

A document fails the rules if it has fewer than ``MIN_WORDS`` words or if more than half its words lie in 3-word
windows that occur twice or more in it. The others are scored, in Arrow batches, by a logistic regression over hashed
words, word pairs and character n-grams, fitted on labelled rows and calibrated to probabilities; a probability of
good quality below ``KEEP_AT`` is a rejection.

Defined results: null and wordless texts have zero counts and fail; very long texts are read whole; repeated document
rows each get a row, as do null and repeated ids; documents without an id have no label; a probability of ``KEEP_AT`` is
kept; with no labelled row, or one label only, only the rules decide; empty documents give none. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import read_table
from waymark.llm.features import char_grams, counted, word_bounds, word_hashes

BITS = 15
SIZES = (2, 3)
MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_AT = 0.5
#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 3000
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
PAIR, TRIPLE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def in_repeats(words: np.ndarray) -> int:
    """Words inside 3-word windows found twice or more."""
    if len(words) < 4:
        return 0
    h = (words[:-2] * PAIR + words[1:-1]) * TRIPLE + words[2:]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(h) + k] |= again
    return int(hit.sum())


class Measured:
    """The fixed counts of one text, and its words' hashes."""

    def __init__(self, text: str | None) -> None:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        array = np.frombuffer(raw, np.uint8)
        starts, ends = word_bounds(array)
        self.words = word_hashes(array, starts, ends)
        self.n_words = len(starts)
        self.word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
        self.n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        self.n_dup_lines = 0
        for line in raw.split(b"\n"):
            if line in seen:
                self.n_dup_lines += 1
            elif line.strip(SPACES):
                seen.add(line)
        self.n_repeat_words = in_repeats(self.words)
        self.base_failed = self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def vector(text: str | None, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs in the upper half of the features, character n-grams in the lower."""
    shift = np.uint64(64 - (BITS - 1))
    parts = [words >> shift]
    if len(words) > 1:
        parts.append(((words[:-1] * PAIR + words[1:]) * TRIPLE) >> shift)
    at, n = counted(np.concatenate(parts).astype(np.int64), BITS - 1)
    bt, m = counted(char_grams(text or "", SIZES, BITS - 1), BITS - 1)
    x = 1 + np.log(np.concatenate([m, n]).astype(float))
    return np.concatenate([bt.astype(np.int64), at + (1 << (BITS - 1))]), x / max(np.sqrt(x @ x), 1e-12)


class Model:
    """Weights, bias and the two numbers that calibrate the logit."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(x @ self.weights[at] + self.bias)

    def probability(self, text: str | None, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(*vector(text, words)) + self.shift, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6) -> Model | None:
    """Adaptive gradient descent on four fifths of the rows, Platt scaling on the rest."""
    if len(set(y.tolist())) < 2:
        return None
    w, g2, bias, bias2, rng = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6, np.random.default_rng(11)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, x = rows[i]
            e = 1 / (1 + np.exp(-np.clip(x @ w[at] + bias, -40, 40))) - y[i]
            g = e * x + 1e-6 * w[at]
            g2[at] += g * g
            bias2 += e * e
            w[at] -= 0.3 * g / np.sqrt(g2[at])
            bias -= 0.3 * e / np.sqrt(bias2)
    model, aside = Model(w, bias), np.flatnonzero(held)
    if len(aside):
        z, t = np.array([model.logit(*rows[i]) for i in aside]), y[aside]
        pos, neg = (t == 1).sum(), (t == 0).sum()
        t = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's targets
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            g, v = p - t, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[v @ (z * z) + 1e-4, v @ z], [v @ z, v.sum() + 1e-4]])
            step = np.linalg.solve(h, np.array([g @ z + 1e-4 * (a - 1), g.sum() + 1e-4 * b]))
            a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        model.slope, model.shift = float(max(a, 0.1)), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits the classifier on at most ``sample_rows`` labelled rows, those first in the order of a hash of the id."""
    order = F.xxhash64(F.lit(20240229), F.col(id_col).cast("string"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(label_col) > 0).cast("int").alias("y"), order.alias("o"))
    picked = known.distinct().orderBy("o", "i", "y").limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).join(F.broadcast(picked), "i").dropDuplicates(["i", "y", "h"]).orderBy("o", "h", "y").limit(sample_rows).select("o", "y", "t")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [vector(t, Measured(t).words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in both], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in both], pa.binary())], names=["o", "y", "a", "x"]
            )

    got = sample.mapInArrow(vectors, "o long, y int, a binary, x binary").toArrow().to_pandas().sort_values(["o", "y"])  # sample_rows rows
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(got["a"], got["x"])], got["y"].to_numpy())


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Per row the counts, base_failed, kept and p_good (null where the model was not asked)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    kind = dict(docs.dtypes)[id_col]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out, p = [], []
            for text in batch.column(1):
                text = text.as_py()
                out.append(m := Measured(text))
                p.append(None if m.base_failed or model is None else model.probability(text, m.words))
                m.words = None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([getattr(m, c) for m in out], pa.int64()) for c in counts), pa.array([m.base_failed for m in out], pa.bool_()), pa.array([not m.base_failed and (x is None or x >= keep_at) for m, x in zip(out, p)], pa.bool_()), pa.array(p, pa.float64())],
                names=[id_col, *counts, "base_failed", "kept", "p_good"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, p_good double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(docs, read_table(spark, sf_dir, "labels")))
