"""Anchored segments: how repeated passages are brought together without moving the texts.

A window is ``width`` consecutive tokens (bytes or words). Its anchor is the leftmost least among its ``gram``-token
grams, in an order by hash in which grams known to be frequent come last. So equal windows have equal anchors at equal
offsets, and a window that reaches out of a very common passage is anchored outside of it, by something rarer.
Consecutive windows of a document with the same anchor form a segment. Segments are dealt by the hash of their anchor, as
packed arrays: equal windows always meet in one bucket, and buckets shrink as their number grows with the input. Where
one content recurs among what a task holds, only its first segment is dealt and the rest follow it, so that a passage
which a large share of all documents hold comes to its bucket once a task, not once a document.

A document is a row's id and text: rows that repeat an id with other texts are documents of their own, equal rows are
one. Documents are told apart by the id and a mark, a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Shared, U64, gram_hash, mix, pieces, trim
from waymark.llm.features import BASE, powers

#: Low bits of a composite key that hold the position in a block of the document; the top bit marks frequent grams.
POSITION_BITS = U64(28)
POSITION = U64((1 << 28) - 1)
FREQUENT = U64(1 << 63)
GRAM_BASE = U64(0x9FB21C651E98DF25)
#: Segments that a task holds before it writes them out.
FLUSH = 250_000
#: How often a content recurs among these before all but its first follow that one.
RECURS = 8
#: Windows of a document that are hashed at once.
BLOCK = 1 << 19
#: Bytes of text that a part of the documents and a bucket of segments are meant to stand for.
PART_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
NO_ID = -(1 << 63)
#: Documents in which frequent grams are looked for, as a number and as a least share of all; how often a gram must
#: occur there, and the most that are kept. They set the order of anchors, which any order is right for.
LOOKED, LOOKED_SHARE, OFTEN, MOST_FREQUENT = 20_000, 1 / 512, 16, 1 << 16


class Frequent:
    """The grams that anchors avoid."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.sort(grams)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.grams & U64((1 << 20) - 1)).astype(np.int64)] = True

    def among(self, grams: np.ndarray) -> np.ndarray:
        """Places of the frequent ones."""
        if not len(self.grams):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(grams & U64((1 << 20) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        return at[self.grams[found] == grams[at]]


def segments(tokens: np.ndarray, width: int, gram: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, hash of the anchor and hash of the content of every segment of one document.

    Long documents are taken in blocks; a segment that a block cuts in two has the same anchor on both sides.
    """
    n = len(tokens) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(0, U64)
    if n <= BLOCK:
        return block_segments(tokens, n, width, gram, frequent)
    found = [block_segments(tokens[x : x + BLOCK + width - 1], min(BLOCK, n - x), width, gram, frequent) for x in range(0, n, BLOCK)]
    starts = np.concatenate([f[0] + k * BLOCK for k, f in enumerate(found)])
    return starts, *(np.concatenate([f[k] for f in found]) for k in (1, 2, 3))


def block_segments(tokens: np.ndarray, n: int, width: int, gram: int, frequent: Frequent | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = mix(gram_hash(tokens, gram, GRAM_BASE))
    key = ((grams & ~POSITION) >> U64(1)) & ~POSITION | np.arange(len(grams), dtype=U64)
    if frequent is not None:
        key[frequent.among(grams)] |= FREQUENT
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[:n], key[span - size : span - size + n])
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts = np.concatenate(([0], at))
    counts = np.diff(np.append(starts, n))
    # least values are small: mixed anew, to deal evenly
    anchors = mix(grams[(key[starts] & POSITION).astype(np.int64)] + U64(BASE))
    up, down = powers(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, U64)
    np.cumsum(tokens * up[:-1], out=total[1:])
    content = (total[starts + counts + width - 1] - total[starts]) * down[starts]
    return starts, counts, anchors, mix(content + U64(BASE))


# Documents are dealt by id and mark in the JVM (texts) and in numpy (what was found about them); both must agree.


def xxhash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of one 64-bit integer each, as Spark's xxhash64 chains them."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    k = x * p2
    k = ((k << U64(31)) | (k >> U64(33))) * p1
    h = (seed + p5 + U64(8)) ^ k
    h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    return h ^ (h >> U64(32))


def part_of(ids: np.ndarray, marks: np.ndarray, parts: int) -> np.ndarray:
    """As part_column."""
    h = xxhash_long(marks.view(U64), xxhash_long(ids.view(U64), U64(42)))
    return (h & U64(parts - 1)).astype(np.int32)


def part_column(key: Column, mark: Column, parts: int) -> Column:
    return F.xxhash64(key, mark).bitwiseAND(F.lit(parts - 1)).cast("int")


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns that the passes read: id, key (the id, NO_ID for null), mark, text and the columns to keep as k0, k1, ..."""
    number = F.col(id_col).cast("long")
    return docs.select(number.alias("id"), F.coalesce(number, F.lit(NO_ID)).alias("key"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])


#: Findings, packed: ``per`` tells how many entries each document has. SEGMENT: a is the anchor, b the content, by bucket.
#: FOLLOW: segments that repeat the one at document a, mark b and start c, the first of all; LOCAL: the first of a task's.
#: CUT: windows to remove. ASK: segments whose content is still to be compared; a is the anchor, b whether others follow
#: it. CONTENT: a the anchor, b as in ASK, c the content, by bucket. The others are placed by the part of their document.
SEGMENT, FOLLOW, LOCAL, CUT, ASK, CONTENT = range(6)
#: Set in the count of a dealt segment that others of its task follow.
LEADS = 0x80
PACK = "place int, kind int, ids binary, marks binary, per binary, starts binary, counts binary, a binary, b binary, c binary"
NONE = np.zeros(0, np.int64)


class Docs:
    """Documents by their number in the order of id and mark."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray) -> None:
        order = np.lexsort((marks, ids))
        new = np.ones(len(order), bool)
        i, m = ids[order], marks[order]
        new[1:] = (i[1:] != i[:-1]) | (m[1:] != m[:-1])
        self.ids, self.marks = i[new], m[new]
        self.number = np.empty(len(order), np.int64)  # of each pair that was given
        self.number[order] = np.cumsum(new) - 1


def packed(docs: Docs, place: int, kind: int, number: np.ndarray, starts: np.ndarray, counts: np.ndarray, a: np.ndarray = NONE, b: np.ndarray = NONE, c: np.ndarray | bytes = b"") -> tuple:
    """One row of PACK; the entries of a document must stand together."""
    at = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    per = np.diff(np.append(at, len(number))).astype(np.uint32)
    own = number[at]
    return place, kind, docs.ids[own].tobytes(), docs.marks[own].tobytes(), per.tobytes(), starts.astype(np.uint32).tobytes(), counts.tobytes(), a.tobytes(), b.tobytes(), c if isinstance(c, bytes) else c.tobytes()


def by_part(docs: Docs, parts: int, kind: int, number: np.ndarray, starts: np.ndarray, counts: np.ndarray, a: np.ndarray = NONE, b: np.ndarray = NONE, c: np.ndarray = NONE) -> list[tuple]:
    """Rows of PACK, one for each part that has any."""
    if not len(number):
        return []
    where = part_of(docs.ids[number], docs.marks[number], parts)
    order = np.lexsort((starts, number, where))
    where, columns = where[order], [x[order] if len(x) else x for x in (number, starts, counts, a, b, c)]
    edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
    return [packed(docs, int(where[x]), kind, *(y[x:z] for y in columns)) for x, z in zip(edges, edges[1:])]


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def batch_of(rows: list[tuple], ddl: str = PACK) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def table_of(rows: list[tuple], ddl: str = PACK) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, ddl)])


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The packed arrays of a column, end to end."""
    found = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate(found) if found else np.zeros(0, kind)


def owners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Id and mark of every entry."""
    per = joined(table, "per", np.uint32)
    return np.repeat(joined(table, "ids", np.int64), per), np.repeat(joined(table, "marks", np.int64), per)


def contents_of(table: pa.Table, kind: type) -> np.ndarray:
    """The contents in rows of CONTENT, end to end."""
    found = [np.frombuffer(zstandard.decompress(x.as_py()), kind) for x in table.column("c")]
    return np.concatenate(found) if found else np.zeros(0, kind)


def trimmed(contents: np.ndarray) -> bytes:
    """48 bits of each."""
    return np.ascontiguousarray(contents).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def repeated(values: np.ndarray) -> np.ndarray:
    """Which of the values occur more than once."""
    order = np.argsort(values)
    v = values[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(v), bool)
    out[order] = same
    return out


class Dealer:
    """Collects segments of many documents and writes them out by bucket."""

    def __init__(self, bits: int, parts: int, same: Callable[..., np.ndarray], follow: Callable[..., list[tuple]]) -> None:
        self.bits, self.parts, self.same, self.follow, self.held, self.size = bits, parts, same, follow, [], 0

    def add(self, key: int, mark: int, found: tuple[np.ndarray, ...]) -> None:
        if len(found[0]):
            self.held.append((key, mark, *found))
            self.size += len(found[0])

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        docs = Docs(np.array([p[0] for p in self.held], np.int64), np.array([p[1] for p in self.held], np.int64))
        number = np.repeat(docs.number, [len(p[2]) for p in self.held])
        starts, counts, anchors, contents = (np.concatenate([p[k] for p in self.held]) for k in (2, 3, 4, 5))
        self.held, self.size, rows = [], 0, []
        order = np.lexsort((starts, number, contents))
        first = first_of(contents[order] ^ anchors[order])
        often = np.bincount(first, minlength=len(order))[first] >= RECURS
        follows = np.zeros(len(order), bool)
        if often.any():
            gone, src = order, order[first]
            follows[order] = often & self.same(docs, number[gone], starts[gone], number[src], starts[src])
            x = np.empty(len(order), np.int64)
            x[order] = order[first]
            f = np.flatnonzero(follows)
            rows += self.follow(docs, self.parts, LOCAL, number[f], starts[f], counts[f], number[x[f]], starts[x[f]])
            counts = counts.copy()
            counts[np.unique(x[f])] |= LEADS
        buckets = (anchors >> U64(64 - self.bits)).astype(np.uint32)
        order = np.lexsort((starts, number, buckets))
        order = order[~follows[order]]
        edges = np.searchsorted(buckets[order], np.arange((1 << self.bits) + 1))
        number, anchors, contents, starts, counts = (x[order] for x in (number, anchors, contents, starts, counts))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[b], edges[b + 1])
            # 32 bits of the anchor besides the bucket's, 48 of the content
            row = packed(docs, b, SEGMENT, number[s], starts[s], counts[s].astype(np.uint8), anchors[s].astype(np.uint32))
            rows.append((*row[:-2], trimmed(contents[s]), b""))
        yield batch_of(rows)


def first_of(values: np.ndarray) -> np.ndarray:
    """For each of the sorted values the place of the first equal one."""
    if not len(values):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return np.repeat(at, np.diff(np.append(at, len(values))))


class Bucket:
    """The segments of one bucket whose anchor occurs again, sorted by anchor, content, document and start."""

    def __init__(self, table: pa.Table) -> None:
        anchors, counts = joined(table, "a", np.uint32), joined(table, "counts", np.uint8)
        again = repeated(anchors) | (counts >= LEADS)
        ids, marks = owners(table)
        self.docs = Docs(ids[again], marks[again])
        contents = np.concatenate([widened(x.as_py()) for x in table.column("b")])[again]
        anchors, starts, counts = anchors[again], joined(table, "starts", np.uint32)[again].astype(np.int64), counts[again]
        order = np.lexsort((255 - counts, starts, self.docs.number, contents, anchors))
        once = np.ones(len(order), bool)  # equal rows are one document
        for k, x in enumerate((anchors, contents, self.docs.number, starts)):
            x = x[order]
            differs = x[1:] != x[:-1]
            once[1:] = differs if not k else once[1:] | differs
        order = order[once]
        self.anchors, self.contents, self.number, self.starts, counts = (x[order] for x in (anchors, contents, self.docs.number, starts, counts))
        self.counts, self.led = counts & (LEADS - 1), counts >= LEADS  # led: others follow it
        n = len(order)
        group = first_of(self.anchors)
        new = np.ones(n, bool)
        new[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.contents[1:] != self.contents[:-1])
        at = np.flatnonzero(new)
        self.first = np.repeat(at, np.diff(np.append(at, n))) if n else at
        self.mixed = np.bincount(group[at], minlength=n)[group] > 1 if n else new  # the anchor has segments of different content


class Repeats:
    """The passes that the two operators on repeated passages share; they differ in tokens and in what counts as earlier."""

    width: int
    gram: int
    sources = True  # whether findings carry the place that they repeat

    def tokens(self, text: str | None) -> np.ndarray:
        raise NotImplementedError

    def same(self, docs: Docs, number: np.ndarray, starts: np.ndarray, first: np.ndarray, first_starts: np.ndarray) -> np.ndarray:
        """Which segments repeat an equal one that stands before them."""
        raise NotImplementedError

    def follow(self, docs: Docs, parts: int, kind: int, number: np.ndarray, starts: np.ndarray, counts: np.ndarray, to: np.ndarray, to_starts: np.ndarray) -> list[tuple]:
        """Rows of FOLLOW or LOCAL; of CUT where sources do not matter."""
        if not self.sources:
            return by_part(docs, parts, CUT, number, starts, counts.astype(np.uint32))
        return by_part(docs, parts, kind, number, starts, counts.astype(np.uint32), docs.ids[to], docs.marks[to], to_starts.astype(np.uint32))

    def asks(self, b: Bucket) -> np.ndarray:
        """Which segments' contents must be compared with others of their anchor, if they follow none."""
        raise NotImplementedError

    def payload(self, text: str | None, starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
        raise NotImplementedError

    def frequent(self, texts: DataFrame, rows: int) -> Frequent:
        """Grams that are common among a share of the documents: on the driver, at most MOST_FREQUENT."""
        if not rows:
            return Frequent(np.zeros(0, U64))
        share = max(LOOKED_SHARE, min(1.0, LOOKED / rows))
        tokens, gram = self.tokens, self.gram

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, sums = [], 0, (np.zeros(0, U64), NONE)

            def merged() -> tuple[np.ndarray, np.ndarray]:
                own, n = np.unique(np.concatenate(held), return_counts=True)
                own, n = own[n > 1], n[n > 1]
                codes, back = np.unique(np.concatenate([sums[0], own]), return_inverse=True)
                return codes, np.bincount(back, np.concatenate([sums[1], n]), len(codes)).astype(np.int64)

            for batch in batches:
                for text in batch.column(0):
                    found = np.unique(mix(gram_hash(tokens(text.as_py()), gram, GRAM_BASE)))  # a document counts once
                    held.append(found)
                    size += len(found)
                    if size > 2_000_000:
                        sums, held, size = merged(), [], 0
            if held:
                sums = merged()
            good = sums[1] >= 2
            yield pa.RecordBatch.from_arrays([pa.array(sums[0][good].view(np.int64)), pa.array(sums[1][good])], names=["g", "n"])

        some = texts.where(F.pmod(F.xxhash64(F.lit(5), "key", "mark"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
        got = some.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).select("g").toArrow()
        return Frequent(got.column("g").to_numpy().view(U64))

    def deal(self, texts: DataFrame, bits: int, parts: int, rows: int) -> DataFrame:
        """Every document's segments, by bucket."""
        width, gram, tokens, same, follow = self.width, self.gram, self.tokens, self.same, self.follow
        frequent = texts.sparkSession.sparkContext.broadcast(self.frequent(texts, rows))  # at most 1.5 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer = Dealer(bits, parts, same, follow)
            for batch in batches:
                for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    dealer.add(key, mark, segments(tokens(text.as_py()), width, gram, frequent.value))
                    if dealer.size >= FLUSH:
                        yield from dealer.out()
            yield from dealer.out()
            trim()

        return texts.select("key", "mark", "text").mapInArrow(run, PACK)

    def first_pass(self, table: pa.Table, parts: int) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind != SEGMENT:  # settled where it was dealt
            return table
        b, place = Bucket(table), table.column("place")[0].as_py()
        if not len(b.number):
            return table_of([])
        f = self.same(b.docs, b.number, b.starts, b.number[b.first], b.starts[b.first])
        src = b.first[f]
        b.led[src] = True
        rows = self.follow(b.docs, parts, FOLLOW, b.number[f], b.starts[f], b.counts[f], b.number[src], b.starts[src])
        ask = self.asks(b) & ~f
        anchors = (np.int64(place) << np.int64(32)) | b.anchors[ask].astype(np.int64)
        return table_of(rows + by_part(b.docs, parts, ASK, b.number[ask], b.starts[ask], b.counts[ask], anchors, b.led[ask].astype(np.uint8)))

    def contents(self, texts: pa.Table, asked: pa.Table) -> pa.Table:
        """The contents that were asked for, by bucket."""
        if not asked.num_rows:
            return table_of([])
        docs = Docs(*owners(asked))
        number = docs.number
        starts, counts, keys, led = joined(asked, "starts", np.uint32).astype(np.int64), joined(asked, "counts", np.uint8), joined(asked, "a", np.int64), joined(asked, "b", np.uint8)
        order = np.lexsort((starts, number))
        number, starts, counts, keys, led = (x[order] for x in (number, starts, counts, keys, led))
        payload: list[bytes | None] = [None] * len(number)
        for doc, text in wanted(texts, docs):
            x, y = np.searchsorted(number, [doc, doc + 1])
            if x < y and payload[x] is None:
                payload[x:y] = self.payload(text, starts[x:y], counts[x:y].astype(np.int64))
        buckets = keys >> np.int64(32)
        order = np.argsort(buckets, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(buckets[order])) + 1).tolist(), len(order)]
        rows = []
        for x, y in zip(cuts, cuts[1:]):
            o = order[x:y]
            rows.append(packed(docs, int(buckets[o[0]]), CONTENT, number[o], starts[o], counts[o], keys[o].astype(np.uint32), led[o], zstandard.compress(b"".join([payload[i] for i in o.tolist()]), 1)))
        return table_of(rows)

    def settle(self, table: pa.Table, parts: int) -> pa.Table:
        """What the contents of a bucket, rows of CONTENT, show."""
        raise NotImplementedError

    def passes(self, texts: DataFrame, shared: Shared, schema: str) -> tuple[DataFrame, DataFrame, int]:
        """What was found by anchors, what the contents then showed, and the number of parts. texts: as of keyed()."""
        total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
        parts, bits = pieces(total["b"], PART_BYTES), pieces(total["b"], BUCKET_BYTES).bit_length() - 1
        first, contents, settle = self.first_pass, self.contents, self.settle

        def met(table: pa.Table) -> pa.Table:
            out = first(table, parts)
            trim()
            return out

        def settled(table: pa.Table) -> pa.Table:
            out = settle(table, parts)
            trim()
            return out

        dealt = self.deal(texts, bits, parts, total["n"])
        found, _ = shared.put(dealt.groupBy("place", "kind").applyInArrow(met, PACK))
        del dealt
        shared.forget()
        asked = texts_by_part(texts, parts).cogroup(found.where(F.col("kind") == ASK).groupBy("place")).applyInArrow(lambda texts, asked: contents(texts, asked), PACK)
        return found, asked.groupBy("place").applyInArrow(settled, schema), parts


def texts_by_part(texts: DataFrame, parts: int):
    return texts.withColumn("place", part_column(F.col("key"), F.col("mark"), parts)).groupBy("place")


def wanted(texts: pa.Table, docs: Docs) -> Iterator[tuple[int, str | None]]:
    """The texts of the documents, with their numbers; those of equal rows come again."""
    numbers = dict(zip(zip(docs.ids.tolist(), docs.marks.tolist()), range(len(docs.ids))))
    for key, mark, text in zip(texts.column("key").to_pylist(), texts.column("mark").to_pylist(), texts.column("text")):
        doc = numbers.get((key, mark))
        if doc is not None:
            yield doc, text.as_py()


def removed(n_tokens: int, width: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which tokens of a document lie in the removed windows."""
    edge = np.zeros(n_tokens + 1, np.int64)
    a = np.minimum(starts.astype(np.int64), n_tokens)
    np.add.at(edge, a, 1)
    np.add.at(edge, np.minimum(a + counts.astype(np.int64) + width - 1, n_tokens), -1)
    return np.cumsum(edge[:-1]) > 0
