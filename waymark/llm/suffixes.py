"""Substring dedup on bytes with an enhanced suffix array and its interval tree.

Texts are dealt as segments, by their anchors. Equal segments are one leaf of the tree, told by hashes of content and
anchor (48 bits, and 32 besides those of the bucket): a leaf's occurrences after its first document are repeats. Segments
that share an anchor but not all of their content are indexed bucket by bucket: suffixes of at least ``WIDTH`` bytes are
sorted, common prefixes of neighbours measured, and one scan with a stack visits the intervals of the common-prefix tree.
An interval whose occurrences are preceded by different bytes cannot be extended to the left: it is a maximal repeat, and
all its occurrences form its group. Occurrences in later documents than the group's first are removed.

Defined results: null counts as empty; texts shorter than ``WIDTH`` bytes keep all; occurrences within one document alone
are no repeat, nor are those in rows of one id, whatever their texts; each row gets its own result; a null id sorts before
all others; very long texts are read whole; an empty table gives none. Cuts may split a character: what is left is handled
as bytes. The id is an integer. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.anchors import CUT, PACK, Bucket, Docs, Repeats, by_part, contents_of, joined, keyed, owners, removed, repeated, table_of, texts_by_part
from waymark.llm.common import U64, Shared, gram_hash, mix, read_table, trim
from waymark.llm.features import BYTE_VALUES

WIDTH, GRAM = 50, 16
EDGE_BASE = U64(0xC6A4A7935BD1E995)
#: Suffixes that one array is built of, besides those of a single anchor.
BLOCK = 100_000


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class SuffixArray:
    """Sorted suffixes of the segments in ``raw`` that start at ``at`` and end at ``end``; ``key`` separates anchors."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        size = end - at
        depth = (int(size.max()) + 7) // 8
        padded = np.concatenate([raw, np.zeros(8 * depth + 8, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * depth)[at]
        rows[np.arange(8 * depth)[None, :] >= size[:, None]] = 0
        words = rows.view(">u8").astype(np.uint64)
        order = np.lexsort((size, *(words[:, k] for k in range(depth - 1, -1, -1)), key))
        self.order = order
        rows, size, key = rows[order], size[order], key[order]
        self.common = np.zeros(len(order), np.int64)  # of each suffix with the one before it
        if len(order) > 1:
            differ = rows[1:] != rows[:-1]
            first = np.where(differ.any(1), differ.argmax(1), 8 * depth)
            self.common[1:] = np.where(key[1:] == key[:-1], np.minimum(first, np.minimum(size[1:], size[:-1])), 0)


def maximal_repeats(common: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Intervals (first, last, length) of the common-prefix tree of length ``least`` or more whose occurrences are
    preceded by different bytes. before: the byte in front of each suffix, negative and unique where there is none."""
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # [length, first, byte before all so far or None if they differ]
    values, left = common.tolist(), before.tolist()
    values.append(0)
    for i in range(1, len(values)):
        now, first, mark = values[i], i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            length, first, seen = stack.pop()
            if seen != mark:
                seen = None
            if seen is None:
                out.append((first, i - 1, length))
            mark = seen
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != mark:
                    stack[-1][2] = None
            else:
                stack.append([now, first, mark])
        elif stack:
            stack.clear()
    return out


class ByteRepeats(Repeats):
    width, gram, sources = WIDTH, GRAM, False

    def tokens(self, text: str | None) -> np.ndarray:
        return BYTE_VALUES[np.frombuffer(as_bytes(text), np.uint8)]

    def same(self, docs: Docs, number: np.ndarray, starts: np.ndarray, first: np.ndarray, first_starts: np.ndarray) -> np.ndarray:
        return docs.ids[number] != docs.ids[first]

    def asks(self, b: Bucket) -> np.ndarray:
        return b.mixed

    def payload(self, text: str | None, starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
        raw = as_bytes(text)
        return [raw[a : a + n + WIDTH - 1] for a, n in zip(starts.tolist(), counts.tolist())]

    def settle(self, table: pa.Table, parts: int) -> pa.Table:
        counts = joined(table, "counts", np.uint8).astype(np.int64)
        raw = contents_of(table, np.uint8)
        if not len(counts) or not len(raw):
            return table_of([])
        docs, starts, anchors = Docs(*owners(table)), joined(table, "starts", np.uint32).astype(np.int64), joined(table, "a", np.uint32)
        begins = np.cumsum(counts + WIDTH - 1) - (counts + WIDTH - 1)
        order = np.argsort(anchors, kind="stable")  # anchors one after another, a block of them at a time
        edge = np.append(np.flatnonzero(np.diff(anchors[order])) + 1, len(order))
        total, rows, done = np.cumsum(counts[order]), [], 0
        while done < len(order):
            reach = np.searchsorted(total, (total[done - 1] if done else 0) + BLOCK)
            until = int(edge[min(np.searchsorted(edge, max(reach, done + 1)), len(edge) - 1)])
            rows += self.anchors_of(docs, raw, starts, anchors, begins, counts, order[done:until], parts)
            done = until
        return table_of(rows)

    def anchors_of(self, docs: Docs, raw: np.ndarray, starts: np.ndarray, anchors: np.ndarray, begins: np.ndarray, counts: np.ndarray, some: np.ndarray, parts: int) -> list[tuple]:
        """The removals among the segments of a block of anchors."""
        n = counts[some]
        piece = np.repeat(some, n)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        at = begins[piece] + place
        # suffixes without an equal beginning elsewhere are leaves of no interval; a hash of the beginning finds them
        size = n + WIDTH - 1
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        joint = raw[np.repeat(begins[some], size) + inner]
        first = np.repeat(np.cumsum(size) - size, n) + place
        edges = gram_hash(BYTE_VALUES[joint], WIDTH, EDGE_BASE)[first]
        live = repeated(mix(edges ^ (anchors[piece].astype(U64) * EDGE_BASE)))
        at, piece, place = at[live], piece[live], place[live]
        if not len(at):
            return []
        array = SuffixArray(raw, at, (begins + counts + WIDTH - 1)[piece], anchors[piece])
        at, piece, place = at[array.order], piece[array.order], place[array.order]
        before = np.where(place > 0, raw[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
        groups = maximal_repeats(array.common, before, WIDTH)
        if not groups:
            return []
        first, last, length = (np.array(x) for x in zip(*groups))
        return self.cuts(docs, docs.number[piece], starts[piece] + place, first, last, length, parts)

    def cuts(self, docs: Docs, number: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray, length: np.ndarray, parts: int) -> list[tuple]:
        """Every occurrence of a group in a document of a larger id than the group's first."""
        span = last - first + 1
        rows, ids = [], docs.ids[number]
        block = max(1, 4_000_000 // max(1, int(span.max())))
        for x in range(0, len(span), block):
            s, f = span[x : x + block], first[x : x + block]
            inside = np.repeat(f, s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            least = np.repeat(np.minimum.reduceat(ids[inside], np.cumsum(s) - s), s)
            gone = ids[inside] > least
            rows += by_part(docs, parts, CUT, number[inside][gone], starts[inside][gone], (np.repeat(length[x : x + block], s) - WIDTH + 1)[gone].astype(np.uint32))
        return rows


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept (binary) and spans, an array of (start, bytes); with
    ``digest``, kept_sha256 stands for the last two."""
    shared = Shared(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    found, more, parts = ByteRepeats().passes(texts, shared, PACK)

    def finish(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        owner = Docs(*owners(cuts))
        starts, counts = joined(cuts, "starts", np.uint32), joined(cuts, "counts", np.uint32)
        order = np.argsort(owner.number, kind="stable")
        number, starts, counts = owner.number[order], starts[order], counts[order]
        numbers = dict(zip(zip(owner.ids.tolist(), owner.marks.tolist()), range(len(owner.ids))))
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for key, mark, text in zip(texts.column("key").to_pylist(), texts.column("mark").to_pylist(), texts.column("text")):
            raw, doc = as_bytes(text.as_py()), numbers.get((key, mark), -1)
            x, y = np.searchsorted(number, [doc, doc + 1])
            runs: list[tuple[int, int]] = []
            if doc >= 0:
                gone = removed(len(raw), WIDTH, starts[x:y], counts[x:y])
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                runs = list(zip(edge[::2], edge[1::2]))
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                rest = raw
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(rest))
            n_spans.append(len(runs))
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            spans.append([{"start": a, "bytes": z - a} for a, z in runs])
        trim()
        columns = {id_col: texts.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())}
        if digest:
            return pa.table(columns | {"kept_sha256": pa.array(kept, pa.string())})
        return pa.table(columns | {"kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])))})

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary, spans array<struct<start:long,bytes:long>>")
    cuts = found.where(F.col("kind") == CUT).unionByName(more)
    return texts_by_part(texts, parts).cogroup(cuts.groupBy("place")).applyInArrow(finish, schema)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"), digest=True)
