"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is set if it is set in over half the hashes of the text's shingles. Two fingerprints that differ
in at most two bits have a common variant within one bit of both, so every distinct fingerprint emits itself and its
64 one-bit variants; a shuffle brings equal variants together. At most 65 distinct fingerprints can share a variant,
whatever the data, so a chain through each such set, verified bit by bit, carries all links of the set. Components of
these links are the groups.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; texts shorter
than a shingle are hashed whole; a bit set in just half the hashes is not set; equal texts have equal fingerprints and are
one node, however many they are; very long texts are read whole; every row gives one row, null and repeated ids too; a
group in which no row has an id has none; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import Shared, arrow_map, read_table, small_batches
from waymark.llm.components import connected
from waymark.llm.minhash import NODE, near_copies, with_nodes

WORDS, SEED = 3, 42
#: Most bits by which linked fingerprints differ: twice the half radius that variants are made within.
RADIUS = 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(found) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return arrow_map(docs.select(id_col, text_col), run, f"id {dict(docs.dtypes)[id_col]}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp. Links a, b between different fingerprints within the radius that connect all such."""
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    ball = F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips]))
    met = distinct.select(ball.alias("variant"), "fp")
    chain = met.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return chain.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (signed long) and component, the least id of the group."""
    shared = Shared(docs.sparkSession)
    table, _ = shared.put(fingerprints(docs, id_col, text_col))
    nodes, _ = shared.put(table.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected(links(nodes.select("fp")), shared)
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return table.join(named.join(least, "root").select("fp", "component"), "fp").select(F.col("id").alias(id_col), "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of texts at shingle similarity 0.8 one row stays, as it is: of the least id, or of no
    id where no row has one, and of those with that id the one of the least hash.

    Such texts differ in about 10 of 64 bits, which no ball around a fingerprint reaches; bands of MinHash do.
    """
    small_batches(spark)
    columns = [F.col(c) for c in docs.columns]
    # by id as well as node, so that a text with many copies is not one task
    found = near_copies(docs).repartition("doc_id", "node").groupBy("doc_id", "node").agg(F.first("stays").alias("__stays"), F.count("*").alias("n"))
    other = found.where("NOT __stays OR n > 1").select(F.col("doc_id").alias("__id"), F.col("node").alias("__other"), "__stays")
    left = with_nodes(docs).join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__other") == F.col(NODE)), "left").where("__stays IS NULL OR __stays")
    # rows that repeat an id and its text: one of them
    return left.where("__stays IS NULL").select(*columns).unionByName(left.where("__stays").dropDuplicates(["doc_id", NODE]).select(*columns))
