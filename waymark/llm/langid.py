"""Language identification: multinomial logistic regression on TF-IDF weighted character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed; a document's vector is (1 + ln tf) * idf, scaled to
length one. Document frequencies come from every training document. The weights are learned by follow-the-
regularised-leader with elastic-net penalties (L1 makes them sparse), on at most ``SAMPLE_ROWS`` labelled rows; a
fifth of those rows is set aside to fit the temperature that calibrates the probabilities.

Defined results: null texts and texts without a letter get ``und`` and score 0; so does every text if no row is
labelled; with one label only, that label gets score 1. Very long texts are read whole. Labels are read from training
rows alone and are never inputs of a prediction. Null and repeated ids and repeated rows are predicted row by row; a null
id is in no fold. Labels of equal probability are decided by their order. An empty table gives none. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import read_table, small_batches
from waymark.llm.features import char_grams, counted

BITS = 15
SIZES = (1, 2, 3)
#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 3000
#: Predictions whose calibrated probability is below this are rejected by the pipeline.
REJECT_BELOW = 0.4
LETTER = regex.compile(r"\p{L}")


def lowered_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    return counted(char_grams(text.lower(), SIZES, BITS), BITS)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that hold each hashed n-gram, over all rows: each task sums its own, Spark the tasks'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                at, _ = lowered_grams(text.as_py())
                df[at] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], names=["f", "n"])

    sums = texts.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # 2^BITS + 1 rows at most
    out = np.zeros((1 << BITS) + 1)
    out[sums["f"].to_numpy()] = sums["n"].to_numpy()
    return out


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader with elastic net."""

    def __init__(self, classes: int, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that were set aside (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean() + 1e-4 * t * t

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """What a worker needs: labels, idf, sparse weights and the temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float) -> None:
        self.labels, self.idf, self.weights, self.bias, self.heat = labels, idf, weights, bias, heat

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = lowered_grams(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not LETTER.search(text):
            return "und", 0.0
        at, x = self.vector(text)
        p = softmax((x @ self.weights[at] + self.bias) / self.heat)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def train(docs: DataFrame, is_training: Column, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on the rows for which ``is_training`` holds and the language is not null."""
    rows = docs.where(F.coalesce(is_training, F.lit(True))).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df = document_frequencies(rows.select(F.col(text_col).alias("t")))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    order = F.xxhash64(F.lit(20240229), F.col(id_col).cast("string"))
    rows = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), order.alias("o"), F.xxhash64(lang_col, text_col).alias("h"))
    picked = rows.select("o", "h").distinct().orderBy("o", "h").limit(sample_rows)
    sample = rows.join(F.broadcast(picked), ["o", "h"]).dropDuplicates(["o", "h"]).select("l", "t", "o")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [lowered_grams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in both], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in both], pa.binary())], names=["l", "o", "a", "n"]
            )

    got = sample.mapInArrow(vectors, "l string, o long, a binary, n binary").toArrow().to_pandas().sort_values(["o", "l"])  # sample_rows rows
    labels = sorted(got["l"].unique())
    if not labels:
        return Model([], idf, np.zeros((1, 1)), np.zeros(1), 1.0)
    if len(labels) == 1:
        return Model(labels, idf, np.zeros((len(idf), 1)), np.zeros(1), 1.0)
    data = []
    for a, n in zip(got["a"], got["n"]):
        at, x = np.frombuffer(a, np.int32), np.frombuffer(n, np.int32)
        x = (1 + np.log(x)) * idf[at]
        data.append((np.append(at, len(idf)), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)))  # the last feature is the bias
    y = np.array([labels.index(v) for v in got["l"]])
    held = np.arange(len(y)) % 5 == 4
    ftrl, rng = Ftrl(len(labels), len(idf) + 1), np.random.default_rng(7)
    for _ in range(3):
        for i in rng.permutation(np.flatnonzero(~held)):
            ftrl.learn(*data[i], y[i])
    w = ftrl.weights(slice(None))
    aside = np.flatnonzero(held)
    logits = np.array([data[i][1] @ w[data[i][0]] for i in aside]).reshape(-1, len(labels))
    return Model(labels, idf, w[:-1], w[-1], temperature(logits, y[aside]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a label
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, fold("doc_id", 4) != 2, "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, or whose language no label explains, go; the rest stay as they are."""
    small_batches(spark)
    model = train(docs, fold("doc_id", 4) != 2, "doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [label != "und" and score >= REJECT_BELOW for label, score in (shared.value.predict(t.as_py()) for t in batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
