"""Benchmark decontamination with an Aho-Corasick automaton over the test items.

Texts are normalised to words of digits, letters a-z (A-Z lowered) and non-ASCII characters. A window is ``width``
consecutive words of an item, or the whole item if it has fewer words. The automaton holds every distinct window,
between single spaces; each document is normalised and scanned once, and the matches are mapped back to words and to
offsets of the original text.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no window; equal items
each count; items without an id mark words as hit and count as one item, which no list of ids names; null and repeated
ids and repeated document rows each get a row of their own; very long texts are read whole; empty documents give an empty
table, an empty benchmark hits nothing; only the named columns are read, so further columns may have any name. The items are read in blocks of at most ``BLOCK_BYTES`` of text, so an automaton and what is broadcast for it
have a fixed bound however large the benchmark is; a document is scanned once a block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import arrow_map, read_table, small_batches

WIDTH = 10
#: Bytes of item text that one automaton is built from.
BLOCK_BYTES = 1 << 20
ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
NORMAL = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Scanner:
    """The automaton of one block of items: (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        windows: dict[str, set[str]] = {}
        sizes: dict[str, int] = {}
        for item, text in items:
            words = [w.decode("utf-8", "surrogatepass") for w in normal_words(text)]
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                key = " " + " ".join(words[i : i + n]) + " "
                windows.setdefault(key, set()).add(item)
                sizes[key] = n
        self.automaton = ahocorasick.Automaton()
        for key, found in windows.items():
            self.automaton.add_word(key, (sizes[key], found))
        self.any = bool(windows)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the hit words as disjoint half-open runs, and the items found."""
        words = normal_words(text)
        if not words or not self.any:
            return len(words), [], set()
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        spaces, ends, sizes, items = None, [], [], set()
        for at, (n, found) in self.automaton.iter(line):
            ends.append(at)
            sizes.append(n)
            items |= found
        if not ends:
            return len(words), [], items
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        last = np.searchsorted(spaces, np.array(ends))
        return len(words), merged(np.stack([last - np.array(sizes), last], 1)), items


def merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in runs[np.argsort(runs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_scanners: dict[tuple, Scanner] = {}


def scanner(block, width: int) -> Scanner:
    """Built once per worker process and block."""
    key = (block.id, width)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(block.value, width)
    return _scanners[key]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one at a time."""
    block, held = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        if block and held + len(row["t"]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row["i"], row["t"]))
        held += len(row["t"])
    yield block


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: n_words, n_hit, items array<string> (sorted), spans of the original text that were hit
    (array of start and end offsets in code points)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    blocks = [_Block(spark.sparkContext.broadcast(b)) for b in item_blocks(items, item_col, item_text_col)]

    def scanned(batch: pa.RecordBatch, shared: _Block) -> list[tuple[str | None, int, list[int], list[str]]]:
        rows = []
        for text, old, had in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = text.as_py()
            n, found, names = scanner(shared, width).scan(text)
            rows.append((text, n, old + [x for run in found for x in run], had + list(names)))
        return rows

    for block in blocks[:-1]:

        def add(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            rows = scanned(batch, block)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["id", "text", "runs", "items"])

        out = arrow_map(out, add, f"id {kind}, text string, runs array<int>, items array<string>")

    def last(batch: pa.RecordBatch, block=blocks[-1]) -> pa.RecordBatch:
        n_words, n_hit, names, spans = [], [], [], []
        for text, n, runs, items in scanned(batch, block):
            n_words.append(n)
            runs = merged(np.array(runs).reshape(-1, 2)) if runs else []
            n_hit.append(sum(b - a for a, b in runs))
            names.append(sorted(set(items), key=lambda i: (i is None, i)))
            at = [m.span() for m in ORIGINAL_WORD.finditer(text)] if runs else []
            spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=[id_col, "n_words", "n_hit", "items", "spans"],
        )

    return arrow_map(out, last, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")


class _Block:
    """A broadcast block with an id that workers can tell it by."""

    def __init__(self, shared) -> None:
        self.shared, self.id = shared, uuid.uuid4().hex

    @property
    def value(self):
        return self.shared.value


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows with a passage of the benchmark go, all others stay as they are, each judged by its own text."""
    small_batches(spark)
    at, out = docs.columns.index("text"), docs
    for items in item_blocks(read_table(spark, sf_dir, "benchmark"), "item_id", "text"):

        def clean(batch: pa.RecordBatch, block=_Block(spark.sparkContext.broadcast(items))) -> pa.RecordBatch:
            found = scanner(block, WIDTH)
            return batch.filter(pa.array([not found.scan(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

        out = arrow_map(out, clean, docs.schema)
    return out


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS k
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, p, l FROM dw JOIN iw USING (l, k)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
