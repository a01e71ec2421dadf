"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that stand side by side inside no token of the vocabulary can never be merged across, so a
word may be cut between them for certain. Each fragment is encoded on its own, once, and remembered; the ids of a
text are the concatenation of its fragments' ids.

Defined results: null counts as the empty text, which has no ids; very long texts are encoded whole; equal texts
get equal ids; null and repeated ids and repeated rows are encoded row by row; an empty table gives none; the two special tokens are recognised in a text as the tokenizers library does. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import arrow_map, read_table, small_batches

#: Words of a generation that a worker remembers; bounds its memory to about 100 MB.
MEMO_ENTRIES = 120_000
#: Words of a text that are looked up at once, between which a worker's memory may start anew.
BLOCK_WORDS = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    kept = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """word -> its ids as text; ``decoded`` holds the decoded text of the same words.

    There are two generations: when the young one is full it becomes the old one, whose words come back when asked for.
    """

    def __init__(self, codec: "WordBpe") -> None:
        super().__init__()
        self.codec, self.decoded, self.old, self.old_decoded = codec, {}, {}, {}

    def __missing__(self, word: str) -> str:
        out = self.old.get(word)
        if out is None:
            codec = self.codec
            ids = codec.word_ids(word)
            out = " ".join(map(str, ids))
            self.decoded[word] = " ".join([codec.tokens[i] for i in ids])
        else:
            self.decoded[word] = self.old_decoded[word]
        self[word] = out
        return out

    def make_room(self, n: int) -> None:
        if len(self) + n > MEMO_ENTRIES:
            self.old, self.old_decoded, self.decoded = dict(self), self.decoded, {}
            self.clear()


class WordBpe:
    """A word-end BPE vocabulary with its normaliser and splitter."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = letters
        inside: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end else token
            inside.update(body[i : i + 2] for i in range(len(body) - 1))
        self.joinable = inside
        self.fragments: dict[str, list[int]] = {}
        self.none, self.whole = len(self.ranks), set()
        self.memo = Memo(self)
        # tokens that merging their own letters leads to: a fragment that is one needs no merging
        self.whole = {i for t, i in self.vocab.items() if self.reachable(t, i)}

    def reachable(self, token: str, i: int) -> bool:
        last = bool(self.end) and token.endswith(self.end) and token != self.end
        body = token.removesuffix(self.end) if last else token
        return bool(body) and self.encoded(body, last) == [i]

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma); white space only separates."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def cut(self, word: str) -> list[str]:
        """A word's byte letters, cut wherever no token has the two letters side by side."""
        joinable = self.joinable
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joinable]
        if not cuts:
            return [word]
        return [word[a:z] for a, z in zip([0, *cuts], [*cuts, len(word)])]

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by rank, lowest first and leftmost among equals, until none applies."""
        get, none = self.ranks.get, self.none
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def fragment_ids(self, fragment: str, last: bool) -> list[int]:
        key = fragment + self.end if last else fragment
        found = self.fragments.get(key)
        if found is None:
            if len(self.fragments) >= MEMO_ENTRIES // 2:
                self.fragments.clear()
            found = self.fragments[key] = self.encoded(fragment, last)
        return found

    def encoded(self, fragment: str, last: bool) -> list[int]:
        whole = self.vocab.get(fragment + self.end if last else fragment)
        if whole is not None and whole in self.whole:
            return [whole]
        parts = list(fragment)
        if last:
            parts[-1] += self.end
        # a run without cuts is merged with a heap instead of rescans
        parts = self.merge_long(parts) if len(parts) > 400 else self.merge(parts)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges in n log n steps, for very long words."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j] = left + right, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive) if live]

    def word_ids(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):  # else its bytes are their own letters
            letters = self.letters
            word = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        parts = self.cut(word)
        if len(parts) == 1:  # remembered as a word already
            return self.encoded(parts[0], True)
        out: list[int] = []
        for part in parts[:-1]:
            out += self.fragment_ids(part, False)
        return out + self.fragment_ids(parts[-1], True)

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """The ids of a text as decimal text, joined by one space, and the decoded text."""
        if not text:
            return "", ""
        memo, ids, said = self.memo, [], []
        for k, part in enumerate(self.special_split.split(text) if "<|" in text else (text,)):
            if k % 2:
                ids.append(str(self.special[part]))
                said.append(part)
                continue
            words = self.words(self.normalise(part))
            for at in range(0, len(words), BLOCK_WORDS):
                some = words[at : at + BLOCK_WORDS]
                memo.make_room(len(some))
                ids += map(memo.__getitem__, some)
                said += map(memo.decoded.__getitem__, some)
        return " ".join(ids), " ".join(said)


_codecs: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The vocabulary at a path, read once per worker process."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns the id, ids array<int> and decoded string; with ``digest`` instead n_tokens, ids_sha256 and
    decoded_sha256 of the same, so that ids need not leave the workers.
    """

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [codec(path).encode_text(t) for t in batch.column(1).to_pylist()]
        ids = pa.array([list(map(int, a.split())) for a, _ in both], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([b for _, b in both], pa.string())], names=[id_col, "ids", "decoded"])

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, counts, a, b = codec(path), [], [], []
        for text in batch.column(1):
            ids, said = c.encode_text(text.as_py())
            counts.append(ids.count(" ") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(said.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    some = docs.select(id_col, text_col)
    if digest:
        return arrow_map(some, digests, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return arrow_map(some, full, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes arrays of ids: the id and decoded string. Ids outside the vocabulary are skipped; null gives ''."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = codec(path).tokens
        said = [" ".join(tokens[i] for i in ids or () if i in tokens) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=[id_col, "decoded"])

    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the corpus pipeline: what remains, as token counts and digests."""
    small_batches(spark)
    return encode_documents(docs, default_tokenizer(), digest=True)
