"""Substring dedup on words by de Bruijn compaction.

Nodes of the graph are sequences of ``WIDTH`` - 1 words, edges are windows of ``WIDTH`` words. Edges are dealt as segments,
by their anchors; segments whose anchor occurs once hold no repeated edge and go no further. Of the others each distinct
content is taken apart into edges, told by their two nodes; an edge that occurs again belongs to the graph and has the
coordinates of its first occurrence, by document and place. Edges that follow one another there are a piece. Spark joins
then compact the pieces: nodes are counted for edges that enter and leave them, pieces are cut at nodes that branch,
linked through nodes with one edge in and one out, and numbered along each nonbranching path by pointer doubling. A
document's occurrences of pieces that continue each other on one path, and in their source, are one long repeated span.
Last, the words at a span's source coordinates are fetched and compared with the span's own: only equal ones are removed.

Defined results: null and wordless texts have no windows; texts shorter than a window keep all words; each row is a
document of its own, in the order of the id and, among rows of one id, of a hash of the text; equal rows of one id are one
document, and each of them gets its result; a null id sorts before all others; very long texts are read whole; an empty
table gives none. The id is an integer. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.anchors import FOLLOW, LOCAL, NO_ID, Bucket, Docs, Repeats, contents_of, first_of, joined, keyed, owners, part_column, removed, texts_by_part, wanted
from waymark.llm.common import U64, Shared, gram_hash, mix, read_table, small_batches, trim
from waymark.llm.features import word_bounds, word_hashes

WIDTH, GRAM = 20, 8
NODE_BASE, EDGE_BASE = U64(0xC6A4A7935BD1E995), U64(0xD6E8FEB86659FD93)
#: What the edges show. PIECE: first coordinates (gid, gmark, gstart) of a piece of n edges, and its n + 1 nodes. PART: of
#: the segment at (id, mark, start) the n edges from ``off`` on are those of a piece, from its edge ``io`` on.
PIECE, PART = 0, 1
SHOWN = "kind int, id long, mark long, start long, off long, n long, gid long, gmark long, gstart long, io long, nodes array<long>"
PLACE = ("id", "mark", "start")
SOURCE = ("gid", "gmark", "gstart")


def text_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw, *word_bounds(np.frombuffer(raw, np.uint8))


def runs(good: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of the good ones in which all ``same`` are equal."""
    at = np.flatnonzero(good)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    k = np.flatnonzero(new)
    return at[k], np.diff(np.append(k, len(at)))


class WordRepeats(Repeats):
    width, gram = WIDTH, GRAM

    def tokens(self, text: str | None) -> np.ndarray:
        raw, starts, ends = text_words(text)
        return word_hashes(np.frombuffer(raw, np.uint8), starts, ends)

    def same(self, docs: Docs, number: np.ndarray, starts: np.ndarray, first: np.ndarray, first_starts: np.ndarray) -> np.ndarray:
        return (number != first) | (starts != first_starts)

    def asks(self, b: Bucket) -> np.ndarray:
        return b.mixed | b.led

    def payload(self, text: str | None, starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
        nodes = mix(gram_hash(self.tokens(text), WIDTH - 1, NODE_BASE))
        return [nodes[a : a + n + 1].tobytes() for a, n in zip(starts.tolist(), counts.tolist())]

    def settle(self, table: pa.Table, parts: int) -> pa.Table:
        docs, nodes = Docs(*owners(table)), contents_of(table, np.uint64)
        if not len(nodes):
            return shown()
        number, starts, counts = docs.number, joined(table, "starts", np.uint32).astype(np.int64), joined(table, "counts", np.uint8).astype(np.int64)
        led = joined(table, "b", np.uint8).astype(bool)
        seg = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = np.cumsum(counts + 1) - (counts + 1)  # of a segment's nodes
        edges = mix(nodes[base[seg] + pos] * EDGE_BASE + nodes[base[seg] + pos + 1])
        order = np.lexsort((starts[seg] + pos, number[seg], edges))
        group = first_of(edges[order])
        many = np.bincount(group, minlength=len(order)) > 1
        many |= np.bincount(group, led[seg][order], len(order)) > 0
        again, first = np.empty(len(order), bool), np.empty(len(order), np.int64)
        again[order], first[order] = many[group], order[group]
        own = first == np.arange(len(order))
        at, size = runs(again & own, seg)
        head = np.zeros(len(order), np.int64)  # where the piece of an edge begins
        head[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(at, size)
        s, n = seg[at], size
        inner = np.repeat(base[s] + pos[at], n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        found = [shown(PIECE, n=n, gid=docs.ids[number[s]], gmark=docs.marks[number[s]], gstart=starts[s] + pos[at], nodes=(n + 1, nodes[inner]))]
        at, size = runs(again & (led[seg] | ~own), seg, seg[first], pos[first] - pos)
        s, f, h = seg[at], first[at], head[first[at]]
        found.append(shown(PART, id=docs.ids[number[s]], mark=docs.marks[number[s]], start=starts[s], off=pos[at], n=size, gid=docs.ids[number[seg[f]]], gmark=docs.marks[number[seg[f]]], gstart=starts[seg[h]] + pos[h], io=pos[f] - pos[h]))
        return pa.concat_tables(found)


def shown(kind: int = PIECE, nodes: tuple[np.ndarray, np.ndarray] | None = None, **columns: np.ndarray) -> pa.Table:
    n = len(columns["n"]) if columns else 0
    lists = pa.nulls(n, pa.list_(pa.int64()))
    if nodes is not None:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(nodes[0]))).astype(np.int32)), pa.array(nodes[1].view(np.int64)))
    names = [c.split()[0] for c in SHOWN.split(", ")]
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32))} | {c: pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in names[1:-1]} | {"nodes": lists})


def doubled(links: DataFrame, shared: Shared) -> DataFrame | None:
    """links: sid, prev, dist, at most one of each sid and prev. Per sid the root that its chain begins with and the
    distance from there, by pointer doubling; what lies on a ring is left out."""
    left, path = shared.put(links)
    n, done = left.count(), []
    while n:
        there = left.select(F.col("sid").alias("prev"), F.col("prev").alias("up"), F.col("dist").alias("more"))
        after, at = shared.put(left.join(there, "prev", "left").select("sid", F.coalesce("up", "prev").alias("prev"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("up").isNull().alias("ended")))
        # a chain that has ended is still what others point to: its nodes stay until all who need them have jumped over
        shared.drop(path)
        rest = after.where("NOT ended").count()
        done, left, path = after, after.drop("ended"), at
        if rest in (0, n):  # rings never end
            return done.where("ended").select("sid", F.col("prev").alias("root"), "dist")
        n = rest
    return None


def compacted(pieces: DataFrame, shared: Shared) -> DataFrame:
    """pieces: gid, gmark, gstart, n, nodes. Per stretch of a piece on one nonbranching path: the piece's coordinates,
    first edge (io) and number of edges (n) in the piece, the path and the first edge's number on it (at)."""
    pieces, _ = shared.put(pieces.withColumn("pid", F.monotonically_increasing_id()))
    nodes = pieces.select("pid", "n", F.posexplode("nodes").alias("j", "node"))
    degrees = nodes.groupBy("node").agg(F.count_if(F.col("j") > 0).alias("into"), F.count_if(F.col("j") < F.col("n")).alias("out"))
    degrees, _ = shared.put(degrees)
    branching = degrees.where("into > 1 OR out > 1").select("node")
    cuts = nodes.where("j > 0 AND j < n").join(branching, "node").groupBy("pid").agg(F.array_sort(F.collect_set("j")).alias("at"))
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.col("at").cast("array<long>"), F.array().cast("array<long>")), F.array("n"))
    ends = pieces.join(cuts, "pid", "left").withColumn("bounds", bounds).select("*", F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("k", "io"))
    until = F.element_at("bounds", F.col("k") + 2)
    stretches, _ = shared.put(
        ends.select(*SOURCE, "io", (until - F.col("io")).alias("n"), F.element_at("nodes", (F.col("io") + 1).cast("int")).alias("head"), F.element_at("nodes", (until + 1).cast("int")).alias("tail"), F.monotonically_increasing_id().alias("sid"))
    )
    through = degrees.where("into = 1 AND out = 1").select("node")
    links = (
        stretches.select(F.col("tail").alias("node"), F.col("sid").alias("prev"), F.col("n").alias("dist"))
        .join(stretches.select(F.col("head").alias("node"), "sid"), "node").join(through, "node", "left_semi").where("sid <> prev").select("sid", "prev", "dist")
    )
    roots = doubled(links, shared)
    if roots is None:
        return stretches.select(*SOURCE, "io", "n", F.col("sid").alias("path"), F.lit(0).cast("long").alias("at"))
    return stretches.join(roots, "sid", "left").select(*SOURCE, "io", "n", F.coalesce("root", "sid").alias("path"), F.coalesce("dist", F.lit(0)).alias("at"))


def followers(found: DataFrame) -> DataFrame:
    """(id, mark, start, to_id, to_mark, to_start): segments that are equal to the one they follow, the first of all."""

    def unpack(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, marks = owners(table)
            whole = {"id": ids, "mark": marks, "start": joined(table, "starts", np.uint32), "to_id": joined(table, "a", np.int64), "to_mark": joined(table, "b", np.int64), "to_start": joined(table, "c", np.uint32)}
            yield from pa.table({k: pa.array(v.astype(np.int64)) for k, v in whole.items()}).to_batches(10_000)
        trim()

    schema = "id long, mark long, start long, to_id long, to_mark long, to_start long"
    first = found.where(F.col("kind") == FOLLOW).mapInArrow(unpack, schema)
    local = found.where(F.col("kind") == LOCAL).mapInArrow(unpack, schema).toDF("id", "mark", "start", "l_id", "l_mark", "l_start")
    leads = first.select(F.col("id").alias("l_id"), F.col("mark").alias("l_mark"), F.col("start").alias("l_start"), "to_id", "to_mark", "to_start")
    known = local.join(leads, ["l_id", "l_mark", "l_start"], "left")
    return first.unionByName(known.select(*PLACE, *[F.coalesce(f"to_{c}", f"l_{c}").alias(f"to_{c}") for c in PLACE]))


def spans_of(found: DataFrame, seen: DataFrame, shared: Shared) -> DataFrame:
    """The long repeated spans: document (id, mark), first window (start), windows (n), path, and the source's coordinates."""
    stretches = compacted(seen.where(F.col("kind") == PIECE).select(*SOURCE, "n", "nodes"), shared)
    stretches = stretches.toDF(*SOURCE, "s_io", "s_n", "path", "s_at")
    parts = seen.where(F.col("kind") == PART).drop("kind", "nodes").join(stretches, [*SOURCE])
    x, z = F.greatest("io", "s_io"), F.least(F.col("io") + F.col("n"), F.col("s_io") + F.col("s_n"))
    parts, _ = shared.put(parts.where(x < z).select(*PLACE, (F.col("off") + x - F.col("io")).alias("off"), (z - x).alias("n"), "path", (F.col("s_at") + x - F.col("s_io")).alias("at"), "gid", "gmark", (F.col("gstart") + x).alias("gstart")))
    own = parts.where("NOT (id = gid AND mark = gmark AND start + off = gstart)").withColumn("start", F.col("start") + F.col("off")).drop("off")
    led = followers(found).join(parts.withColumnsRenamed({c: f"to_{c}" for c in PLACE}), [f"to_{c}" for c in PLACE])
    all_ = own.unionByName(led.withColumn("start", F.col("start") + F.col("off")).select(*own.columns))
    w = Window.partitionBy("id", "mark").orderBy("start", "n")  # equal rows show their occurrences more than once
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("path") == F.col("path")) & (before("gid") == F.col("gid")) & (before("gmark") == F.col("gmark"))
    for c in ("start", "at", "gstart"):
        goes_on &= before(c) + before("n") == F.col(c)
    marked = all_.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "mark", "span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.first("path").alias("path"), F.first("gid").alias("gid"), F.first("gmark").alias("gmark"), F.min("gstart").alias("gstart")).drop("span")


def said(raw: bytes, a: np.ndarray, z: np.ndarray, start: int, windows: int) -> bytes:
    """The words of a span of windows, joined by one space."""
    return b" ".join(raw[a[start] : z[start + windows + WIDTH - 2]].split())


def proven(texts, spans: DataFrame, parts: int) -> DataFrame:
    """Adds the words at the source coordinates; each source is read once, however many spans it has."""

    def read(texts: pa.Table, asked: pa.Table) -> pa.Table:
        docs = Docs(asked.column("gid").to_numpy(), asked.column("gmark").to_numpy())
        order = np.argsort(docs.number, kind="stable")
        starts, n = asked.column("gstart").to_numpy(), asked.column("n").to_numpy()
        words: list[bytes | None] = [None] * len(order)
        for doc, text in wanted(texts, docs):
            x, y = np.searchsorted(docs.number[order], [doc, doc + 1])
            if words[order[x]] is None:
                where = text_words(text)
                for i in order[x:y].tolist():
                    words[i] = said(*where, int(starts[i]), int(n[i]))
        return asked.drop_columns(["place"]).append_column("words", pa.array(words, pa.binary()))

    asked = spans.select("gid", "gmark", "gstart", "n").distinct().withColumn("place", part_column(F.col("gid"), F.col("gmark"), parts))
    answers = texts.cogroup(asked.groupBy("place")).applyInArrow(read, "gid long, gmark long, gstart long, n long, words binary")
    return spans.join(answers, ["gid", "gmark", "gstart", "n"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns to keep (as _keep0, _keep1, ...), n_words, n_removed, kept (the text without the removed words) and spans, an array of
    (start, words, path, source, source_start) in words; with ``digest``, kept_sha256 of the kept words joined by one
    space stands for kept and spans."""
    shared = Shared(docs.sparkSession)
    texts = keyed(docs, id_col, text_col, keep)
    found, seen, parts = WordRepeats().passes(texts, shared, SHOWN)
    seen, _ = shared.put(seen)
    shared.forget()
    spans, _ = shared.put(spans_of(found, seen, shared))
    shared.forget()

    def finish(texts: pa.Table, spans: pa.Table) -> pa.Table:
        owner = Docs(spans.column("id").to_numpy(), spans.column("mark").to_numpy())
        order = np.lexsort((spans.column("start").to_numpy(), owner.number))
        number, rows = owner.number[order], spans.take(order)
        starts, counts = rows.column("start").to_numpy(), rows.column("n").to_numpy()
        sources, proofs = list(zip(*(rows.column(c).to_pylist() for c in ("path", "gid", "gstart")))), rows.column("words")
        numbers = dict(zip(zip(owner.ids.tolist(), owner.marks.tolist()), range(len(owner.ids))))
        n_words, n_removed, kept, out = [], [], [], []
        for key, mark, text in zip(texts.column("key").to_pylist(), texts.column("mark").to_pylist(), texts.column("text")):
            raw, a, z = text_words(text.as_py())
            doc, gone, good = numbers.get((key, mark)), None, []
            if doc is not None:
                x, y = np.searchsorted(number, [doc, doc + 1])
                good = [i for i in range(x, y) if said(raw, a, z, int(starts[i]), int(counts[i])) == proofs[i].as_py()]
                gone = removed(len(a), WIDTH, starts[good], counts[good])
            n_words.append(len(a))
            n_removed.append(int(gone.sum()) if gone is not None else 0)
            if digest:
                words = raw.split()
                kept.append(hashlib.sha256(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
            else:
                kept.append(text.as_py() if gone is None else without(raw, a, z, gone))
                out.append([{"start": int(starts[i]), "words": int(counts[i]) + WIDTH - 1, "path": sources[i][0], "source": None if sources[i][1] == NO_ID else sources[i][1], "source_start": sources[i][2]} for i in good])
        columns = {id_col: texts.column("id")} | {f"_keep{i}": texts.column(f"k{i}") for i in range(len(keep))} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        trim()
        if digest:
            return pa.table(columns | {"kept_sha256": pa.array(kept, pa.string())})
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "path", "source", "source_start")]))
        return pa.table(columns | {"kept": pa.array(kept, pa.string()), "spans": pa.array(out, kind)})

    types = dict(docs.dtypes)
    schema = f"`{id_col}` long, " + "".join(f"_keep{i} {types[c]}, " for i, c in enumerate(keep)) + "n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string, spans array<struct<start:long,words:long,path:long,source:long,source_start:long>>")
    by_part = texts_by_part(texts, parts)
    shown_by = proven(by_part, spans, parts).withColumn("place", part_column(F.col("id"), F.col("mark"), parts))
    return by_part.cogroup(shown_by.groupBy("place")).applyInArrow(finish, schema)


def without(raw: bytes, a: np.ndarray, z: np.ndarray, gone: np.ndarray) -> str:
    """The text without its removed words and the white space after each."""
    until = np.append(a[1:], len(raw))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    out, at = [], 0
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at : a[x]])
        at = int(until[y - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated spans are cut out of the texts; documents that are left with no word of theirs go, those
    that had none stay. Null and repeated ids, empty tables and further columns are as in the operator."""
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    left = repeated_spans(docs, keep=others).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    at = {c: F.col(f"_keep{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        at["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(at["n_chars"])
    return left.select(*[at[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
