"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of the lower-cased texts and one end a text. A context is what stands before a symbol, up to
``DEPTH`` words, the start of the text among them. The root's distribution is the unigram base; a context of one word more is
a state of the tree if its training occurrences say so: leaving out one occurrence at a time, its own counts must predict
its symbols better than the distribution of its parent, the context without the farthest word. Distributions are
smoothed with the parent's (Witten and Bell). A symbol is scored in the longest suffix of what precedes it that is a state.
Nothing bounds the number of states: they lie in buckets, by the hash of the context, and every part of the documents
asks for the symbols and contexts it has and gets its probabilities back in the same order.

The tree is grown depth by depth. Only contexts that occur twice in training can be states, and how often a context
occurs is known from the depth before, so few are asked for. A context that a large share of all symbols follow (at most
``MOST_HOT`` a depth can) is spread over many buckets by its symbols; its sums are made in a second step and sent to all.
Words and contexts are told apart by hashes of 64 bits, in a bucket by 40 bits of the context and 32 of the symbol;
probabilities of parents are rounded to 1/1024 of a binary order when they are asked with, answers to 1/512.

Defined results: null counts as empty, and an empty text has one token, its end; a corpus without training rows leaves
the base alone, without any known word; very long texts are read whole; null and repeated ids and repeated rows are scored
row by row; an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import U64, Shared, mix, pieces, read_table, trim
from waymark.llm.features import word_bounds, word_hashes

#: The most words of a context.
DEPTH = 3
#: A context is hot if this share of all training symbols follow it; over how many buckets its symbols are spread.
MOST_HOT, SPREAD = 4096, 64
END_TOKEN, START_TOKEN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
STEP, PAIR = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Marks an answer on a symbol that occurs twice or more in its context.
AGAIN = 1 << 15
#: Bytes of text that a part of the documents and a bucket of counts stand for.
PART_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: What parts ask: symbols in contexts, by bucket. What they are told: values in the order of asking. Part -1 holds sums.
ASKED = "bucket int, part int, contexts binary, symbols binary, counts binary, parents binary, hot binary"
TOLD = "level int, part int, bucket int, numbers binary"


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [unpacked(x.as_py(), kind) for x in table.column(name)]


def table_of(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(fields)})


class Level(NamedTuple):
    """What is known of a depth before its symbols are asked for: sums are n, k and whether it is a state, once it was."""

    hot: np.ndarray  # sorted codes of hot contexts: words at depth 1, pairs of the depth before below
    sums: np.ndarray | None = None


class Sums(NamedTuple):
    total: int  # training tokens
    kinds: int  # distinct ones

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))


class Walk:
    """The symbols of a part's texts, and their probabilities as far as the part has been told."""

    def __init__(self, texts: pa.Table) -> None:
        found, sizes = [], []
        for text in texts.column("text"):
            raw = np.frombuffer(lowered(text.as_py()), np.uint8)
            h = word_hashes(raw, *word_bounds(raw))
            found += [h, np.array([END_TOKEN])]
            sizes.append(len(h) + 1)
        self.tokens = np.concatenate(found) if found else np.zeros(0, U64)
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.training = texts.column("training").to_numpy(zero_copy_only=False).astype(bool)[self.of]
        self.distinct, self.inverse = np.unique(self.tokens, return_inverse=True)
        first = np.ones(len(self.tokens), bool)
        first[1:] = self.of[1:] != self.of[:-1]
        self.first = first
        self.before = np.empty_like(self.tokens)
        self.before[1:], self.before[first] = self.tokens[:-1], START_TOKEN

    def word_counts(self, told: dict[int, dict[int, np.ndarray]]) -> np.ndarray:
        by_bucket = told.get(0, {})
        return np.concatenate([by_bucket[b] for b in sorted(by_bucket)])[self.inverse] if len(self.tokens) else np.zeros(0, np.int64)

    def follow(self, told: dict[int, dict[int, np.ndarray]], sums: Sums, levels: list[Level], bits: int) -> tuple["Asked", np.ndarray, np.ndarray]:
        """Walks down the depths that were told; returns what to ask at the next one, the probabilities and word counts."""
        counts = self.word_counts(told)
        p, n = sums.base(counts), len(self.tokens)
        seen = np.zeros(n, np.int64)
        seen[1:] = counts[:-1]
        open_ = (seen > 1) | self.first  # its context of the next depth occurs twice
        context, asked = np.zeros(n, U64), None
        code = self.before
        for level, known in enumerate(levels, 1):
            shifted = np.zeros(n, U64)
            shifted[1:] = context[:-1]
            context = mix(shifted * STEP + self.before) if level > 1 else mix(self.before * STEP)
            at = np.flatnonzero(open_)
            asked = Asked(context[at], self.tokens[at], code[at] if level == 1 else code[at - 1], known.hot, bits)
            if level not in told:
                if known.sums is not None:  # this part had nothing to ask
                    break
                return asked.counted(self.training[at], p[at]), p, counts
            values = np.concatenate([told[level][b] for b in sorted(told[level])])[asked.place][asked.inverse]
            again, values = values >= AGAIN, (values & (AGAIN - 1)).astype(np.float64)
            own = np.where(values > 0, np.exp2(np.where(asked.hot > 0, 1, -1) * (values - 1) / 512), 0)
            if len(known.hot):
                k_n, k_k, state = known.sums[np.maximum(asked.hot, 1) - 1].T
                own = np.where(asked.hot > 0, np.where(state > 0, (own + k_k * p[at]) / np.maximum(k_n + k_k, 1), 0), own)
            p[at] = np.where(own > 0, own, p[at])
            open_ = np.zeros(n + 1, bool)
            open_[at[again] + 1] = True
            open_ = open_[:-1] & ~self.first
            code = np.zeros(n, U64)
            code[at] = asked.codes()[asked.inverse]
        return Asked(context[:0], self.tokens[:0], context[:0], np.zeros(0, U64), bits).counted(self.training[:0], p[:0]), p, counts


class Asked:
    """Distinct symbols in contexts, in the order of their buckets."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, codes: np.ndarray, hot: np.ndarray, bits: int) -> None:
        whole = mix(contexts * PAIR + symbols)
        distinct, self.inverse = np.unique(whole, return_inverse=True)
        self.first = np.empty(len(distinct), np.int64)  # a place of each
        self.first[self.inverse] = np.arange(len(whole))
        self.hot = np.zeros(len(contexts), np.uint16)
        if len(hot) and len(contexts):
            k = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
            self.hot[hot[k] == codes] = (k[hot[k] == codes] + 1).astype(np.uint16)
        key = contexts[self.first]
        spread = self.hot[self.first] > 0
        key[spread] = mix(key[spread] + (distinct[spread] & U64(SPREAD - 1)) * STEP)
        order = np.argsort(key, kind="stable")
        self.place = np.empty(len(order), np.int64)  # of each distinct one in the order of asking
        self.place[order] = np.arange(len(order))
        self.bits, self.order = bits, order
        self.buckets = (key[order] >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(order), np.int32)
        self.keys, self.symbols = (key[order] << U64(bits)) >> U64(24), distinct[order].astype(np.uint32)

    def codes(self) -> np.ndarray:
        """Of each distinct one, as pair_codes."""
        return pair_codes(self.buckets, self.keys, self.symbols)[self.place]

    def counted(self, training: np.ndarray, parents: np.ndarray) -> "Asked":
        self.counts = np.bincount(self.inverse, training, len(self.order)).astype(np.uint32)[self.order] if len(self.order) else np.zeros(0, np.uint32)
        self.parents = np.clip(-1024 * np.log2(parents[self.first]), 0, 65535).astype(np.uint16)[self.order]
        self.hot_of = self.hot[self.first][self.order]
        return self

    def rows(self, part: int) -> list[tuple]:
        cuts = np.append(np.flatnonzero(np.diff(self.buckets, prepend=-1)), len(self.buckets)).tolist()
        return [
            (int(self.buckets[a]), part, packed(np.diff(self.keys[a:z], prepend=U64(0))), packed(self.symbols[a:z]), packed(self.counts[a:z]), packed(self.parents[a:z]), packed(self.hot_of[a:z]))
            for a, z in zip(cuts, cuts[1:])
        ]


def pair_codes(buckets: np.ndarray | int, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """What a symbol in a context is known by, to the bucket and to those who ask."""
    return mix(keys * STEP + symbols.astype(U64) + mix(np.atleast_1d(buckets).astype(U64) * PAIR))


def answer(asked: pa.Table, level: int, least_hot: float) -> pa.Table:
    """Per symbol in a context how improbable it is if the context is a state, else 0, in a hot context its count, both as
    1 + 512 * log2; marked if it occurs twice or more. Part -1 gets the sums of hot contexts and the codes of pairs that are hot contexts below."""
    bucket = asked.column("bucket")[0].as_py()
    keys = [np.cumsum(x, dtype=U64) for x in column(asked, "contexts", U64)]
    sizes = [len(k) for k in keys]
    keys, symbols, counts = np.concatenate(keys), np.concatenate(column(asked, "symbols", np.uint32)), np.concatenate(column(asked, "counts", np.uint32))
    parents, hot = np.exp2(np.concatenate(column(asked, "parents", np.uint16)) / -1024.0), np.concatenate(column(asked, "hot", np.uint16))
    _, contexts = np.unique(keys, return_inverse=True)
    both = (contexts.astype(U64) << U64(32)) | symbols
    order = np.argsort(both)
    both = both[order]
    new = np.ones(len(order), bool)
    new[1:] = both[1:] != both[:-1]
    both >>= U64(32)
    new_key = np.ones(len(order), bool)
    new_key[1:] = both[1:] != both[:-1]
    pair = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    c = np.bincount(pair, counts[order], len(at))
    p, hot = parents[order][at], hot[order][at]
    group = (np.cumsum(new_key) - 1)[at]
    per = lambda x: np.bincount(group, x, int(group[-1]) + 1)
    n, k, ones = per(c), per(c > 0), per(c == 1)
    own = np.where(c > 1, c * (np.log(np.maximum(c - 1, 1)) - np.log(p)), 0)
    state = is_state(n, k, ones, per(own))
    value = np.where(state[group], (c + k[group] * p) / np.maximum(n + k, 1)[group], 0)
    value = np.where(hot > 0, c, 1 / np.maximum(value, 1e-300) * (value > 0))
    value = np.where(value > 0, 1 + np.rint(512 * np.log2(np.maximum(value, 1))), 0).astype(np.uint16) | np.where(c > 1, AGAIN, 0).astype(np.uint16)
    told = np.empty(len(order), np.uint16)
    told[order] = value[pair]
    rows, end = [], 0
    for part, size in zip(asked.column("part").to_pylist(), sizes):
        rows.append((level, part, bucket, packed(told[end : end + size])))
        end += size
    h = np.flatnonzero(hot)
    if len(h):
        index, back = np.unique(hot[h], return_inverse=True)
        made = [np.bincount(back, x[h], len(index)) for x in (c, c > 0, c == 1, own)]
        rows.append((level, -1, bucket, np.array([index.astype(float), *made]).tobytes()))
    often = np.flatnonzero(c >= least_hot)
    if len(often):
        rows.append((level, -2, bucket, pair_codes(bucket, keys[order][at][often], symbols[order][at][often]).tobytes()))
    return table_of(rows, TOLD)


def is_state(n: np.ndarray, k: np.ndarray, ones: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a context with n occurrences of k symbols, of which ``ones`` occur once, predicts them better than its
    parent when each occurrence is left out in turn: symbols that occur c > 1 times get (c - 1) / (n - 1 + k) each time,
    others the parent's probability times k / (n - 1 + k). own: the sum of c * log((c - 1) / the parent's) over c > 1."""
    return own - n * np.log(np.maximum(n - 1 + k, 1)) + ones * np.log(np.maximum(k, 1)) > 0


def ask_words(texts: pa.Table, bits: int) -> pa.Table:
    """A part's distinct tokens with their training counts, by bucket of the hash."""
    walk = Walk(texts)
    counts = np.bincount(walk.inverse, walk.training, len(walk.distinct)).astype(np.uint32)
    buckets = (walk.distinct >> U64(64 - bits)).astype(np.int32)
    cuts = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets)).tolist()
    part, none = texts.column("part")[0].as_py(), packed(np.zeros(0, np.uint16))
    return table_of([(int(buckets[a]), part, packed(walk.distinct[a:z]), none, packed(counts[a:z]), none, none) for a, z in zip(cuts, cuts[1:])], ASKED)


def answer_words(asked: pa.Table, share: int) -> pa.Table:
    """Counts over all parts, back to each in the order it asked; part -1 gets total and kinds, -2 the words that a share
    of the bucket's own total exceed, with their counts."""
    found, bucket = column(asked, "contexts", U64), asked.column("bucket")[0].as_py()
    tokens, counts = np.concatenate(found), np.concatenate(column(asked, "counts", np.uint32))
    distinct, inverse = np.unique(tokens, return_inverse=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    ends, told = np.cumsum([len(x) for x in found]).tolist(), total[inverse]
    rows = [(0, part, bucket, packed(told[e - len(x) : e])) for part, x, e in zip(asked.column("part").to_pylist(), found, ends)]
    rows.append((0, -1, bucket, np.array([total.sum(), (total > 0).sum()]).tobytes()))
    often = np.flatnonzero((total > 0) & (total * share >= total.sum()))  # at most ``share``; of the whole corpus's there are no others
    return table_of([*rows, (0, -2, bucket, np.concatenate([distinct[often], total[often].view(U64)]).tobytes())], TOLD)


def told_of(told: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    out: dict[int, dict[int, np.ndarray]] = {}
    for level, bucket, data in zip(told.column("level").to_pylist(), told.column("bucket").to_pylist(), told.column("numbers")):
        out.setdefault(level, {})[bucket] = unpacked(data.as_py(), np.uint16 if level else np.int64)
    return out


def hot_words(told: DataFrame, sums: Sums) -> np.ndarray:
    """The words, and the start, that are hot contexts: at most MOST_HOT and one, read bucket by bucket."""
    hot = [START_TOKEN]
    for row in told.where("part = -2").select("numbers").toLocalIterator():
        both = np.frombuffer(row["numbers"], U64)
        words, counts = both[: len(both) // 2], both[len(both) // 2 :]
        hot += words[counts * U64(MOST_HOT) >= U64(max(sums.total, 1))].tolist()
    return np.unique(np.array(hot, U64))


def hot_sums(told: DataFrame, size: int) -> np.ndarray:
    """n, k and state of the hot contexts of a depth, from their buckets' sums."""
    out = np.zeros((4, size))
    for row in told.where("part = -1").select("numbers").toLocalIterator():
        part = np.frombuffer(row["numbers"]).reshape(5, -1)
        np.add.at(out, (slice(None), part[0].astype(np.int64) - 1), part[1:])
    n, k, ones, own = out
    return np.array([n, k, is_state(n, k, ones, own)], float).T


def score_documents(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row: the id, training, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    shared = Shared(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(is_training, F.lit(False)).alias("training"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts, bits = pieces(size, PART_BYTES), pieces(size, BUCKET_BYTES).bit_length() - 1
    by_part = lambda: rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")).groupBy("part")

    asked = by_part().applyInArrow(lambda texts: ask_words(texts, bits), ASKED)
    told, _ = shared.put(asked.groupBy("bucket").applyInArrow(lambda t: answer_words(t, MOST_HOT), TOLD))
    every = told.where("part = -1").select("numbers").toLocalIterator()
    sums = Sums(*(int(x) for x in sum((np.frombuffer(r["numbers"], np.int64) for r in every), np.zeros(2, np.int64))))
    levels = [Level(hot_words(told, sums))]
    least_hot = max(2.0, sums.total / MOST_HOT)

    def asker(known: list[Level]):
        def ask(texts: pa.Table, told: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return table_of([], ASKED)
            out = Walk(texts).follow(told_of(told), sums, known, bits)[0].rows(texts.column("part")[0].as_py())
            trim()
            return table_of(out, ASKED)

        return ask

    def teller(level: int):
        def tell(asked: pa.Table) -> pa.Table:
            out = answer(asked, level, least_hot)
            trim()
            return out

        return tell

    for level in range(1, depth + 1):
        shared.forget()
        asked = by_part().cogroup(told.where("part >= 0").groupBy("part")).applyInArrow(asker(list(levels)), ASKED)
        more, _ = shared.put(asked.groupBy("bucket").applyInArrow(teller(level), TOLD))
        del asked
        levels[-1] = Level(levels[-1].hot, hot_sums(more, len(levels[-1].hot)))
        hot = [np.frombuffer(r["numbers"], U64) for r in more.where("part = -2").select("numbers").toLocalIterator()]  # MOST_HOT codes at most
        levels.append(Level(np.unique(np.concatenate(hot)) if hot else np.zeros(0, U64)))
        told = told.unionByName(more)
    shared.forget()
    done = levels[:-1]

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        walk, n = Walk(texts), texts.num_rows
        _, p, counts = walk.follow(told_of(told), sums, done, bits)
        out = {
            id_col: texts.column("id"), "training": texts.column("training"), "n_tokens": pa.array(np.bincount(walk.of, minlength=n)), "n_known": pa.array(np.bincount(walk.of, counts > 0, n).astype(np.int64)),
            "base_score": pa.array(np.bincount(walk.of, np.log10(sums.base(counts)), n)), "score": pa.array(np.bincount(walk.of, np.log10(p), n)),
        }
        trim()
        return pa.table(out)

    scored = by_part().cogroup(told.where("part >= 0").groupBy("part")).applyInArrow(finish, f"`{id_col}` {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(id_col, "training", "n_tokens", "n_known", F.lit(sums.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = score_documents(read_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
