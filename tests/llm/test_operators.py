import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.cases import WORD
from waymark.llm import bpe, decontaminate, extract, graph, langid, lm, minhash, quality, shards, simhash, suffixes
from waymark.llm.page_labels import labelled_pages

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, some=[])


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# 1: pages


def test_extract_keeps_articles_and_drops_the_rest(spark):
    page = (
        '<html><head><title>no</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this now, really.</div><article><h1>A  title</h1>'
        "<p>One &amp; <b>two</b><br>three.<p>Four\n five.<script>var a='<p>no</p>'</script></article><section id=comments><div class=comment><p>I liked reading this page a lot.</p></div></section>"
        '<aside class="sidebar"><p>Some more to read on this site.</p></aside><footer>&copy; us</footer>'
    )
    rows = [(1, "u", page, "x"), (2, None, None, None), (3, "u", "", None), (4, "u", "<div><<>>&am", "y"), (5, "u", "<p>" * 3000 + "deep", None), (None, None, "bare text", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.extract_pages(pages).collect()}
    assert got[1]["text"] == "A title\n\nOne & two three.\n\nFour five."
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "")
    assert got[None]["text"] == "bare text" and got[5]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract.extract_pages(pages.limit(0)).count() == 0


READER = {
    '<article title="the hidden valley"><p>One two three four.</p></article>': "One two three four.",
    '<article data-hidden="false" aria-hidden=false><p>One two three four.</p></article>': "One two three four.",
    "<article><p hidden>Not this one here.</p><p style='color:red; DISPLAY : none'>Nor this one.</p><p>One two three four.</p></article>": "One two three four.",
    "<html><head><title>no</title><article><p>One two three four.</p></article>": "One two three four.",
    "<article><p>One<!--> two<!---> three<!-- x --!> four.<!-- y --></p></article>": "One two three four.",
    "<article><script src=/a.js/>var a = 1;</script><p>One two three four.</p></article>": "One two three four.",
    "<article><script data-x='a>b'>var a = 1;</script><p>One two three four.</p></article>": "One two three four.",
    "<article><p title=it's class='a>b' data-y=\"x>\">One two three four.</p><p>Don't stop.</p></article>": "One two three four.\n\nDon't stop.",
    "<article><p>One <svg width=1/><svg><text>no</text></svg>two <math><mi>x</mi><mo>=</mo><mn>3</mn></math> four.</p></article>": "One two x=3 four.",
    "<article><p>One two three four.</p><div class='x": "One two three four.",
}


@pytest.mark.parametrize("source", list(READER))
def test_extract_reads_awkward_markup(source):
    assert extract.main_text(source, extract.model()) == READER[source]


def other_pages(count, seed):
    """Pages of a second maker: names that the training pages never have, other nesting; (source, text expected)."""
    import random

    r = random.Random(seed)
    say = lambda a, z: " ".join("".join(r.choices("aeioulnrstdkmpv", k=r.randint(2, 9))) for _ in range(r.randint(a, z))).capitalize() + "."
    link = lambda: f'<a href="/x{r.randint(1, 99)}">{say(1, 3)[:-1]}</a>'
    for _ in range(count):
        menu = f"<{(k := r.choice(('nav', 'header')))} class='k-{r.randint(1, 9)} zz'><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 8))) + f"</ul></{k}>"
        title, paragraphs = say(3, 8)[:-1], [say(15, 90) for _ in range(r.randint(3, 9))]
        body = "".join(f"<p class=q{r.randint(1, 5)}>{x}</p>" if r.random() < 0.9 else f"<blockquote><p>{x}</p></blockquote>" for x in paragraphs)
        box = r.choice(("article", "main", "article", "section"))
        aside = f"<aside id=w{r.randint(1, 9)}><h4>{say(1, 3)[:-1]}</h4><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 5))) + "</ul></aside>"
        form = f"<form action=/s><label>{say(1, 2)}</label><input name=q><button>Go</button></form>"
        foot = f"<footer class=zb><p>{say(3, 9)}</p>{link()} | {link()}</footer>"
        parts = [menu, f"<{box} class='m{r.randint(1, 9)}-zone'><h1>{title}</h1>{body}</{box}>", *r.sample([aside, form], r.randint(0, 2)), foot]
        yield f"<!doctype html><html><head><title>t</title></head><body><div class=ww>{''.join(parts)}</div></body></html>", "\n\n".join([title, *paragraphs])


def test_extract_pages_of_another_maker():
    tree, pages = extract.model(), list(other_pages(200, 6))
    right = sum(extract.main_text(source, tree) == text for source, text in pages)
    assert right >= 0.95 * len(pages), right


def test_extract_held_out_pages():
    tree, wrong, n = extract.model(), 0, 0
    for page, labels in labelled_pages(150, 321):
        odds = tree.marginals(page)
        wrong += sum((odds[at] > 0) != bool(labels[at]) for at, _, _ in page.blocks)
        n += len(page.blocks)
    assert wrong < 0.02 * n


def test_marginals_equal_enumeration():
    tree = extract.TreeModel.trained(labelled_pages(60, 8))
    page = next(p for p, _ in labelled_pages(400, 77) if 5 <= len(p.tags) <= 11)
    own = [sum(tree.odds.get(f, 0.0) for f in fs) for fs in extract.evidence(page)]
    own[0] += tree.root
    n, mass = len(page.tags), Counter()
    for states in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(o for o, s in zip(own, states) if s) - 30)
        for k in range(1, n):
            w *= tree.tie[states[page.parents[k]]][states[k]]
        for k, s in enumerate(states):
            mass[k, s] += w
    for k, odds in enumerate(tree.marginals(page)):
        assert odds == pytest.approx(math.log(mass[k, 1] / mass[k, 0]), abs=1e-6)


# 2: languages


def test_langid_learns_and_marks_what_it_cannot_tell(spark, empty):
    pool = {"aa": "the and with that from they have".split(), "bb": "der und mit nicht das ein sie".split()}
    rows = [(i, " ".join(pool[k][(i * j) % 7] for j in range(1, 30)), k, "s", None) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "s", None), (901, "123 !!", "bb", "s", None), (902, "", None, None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, l string")
    model = langid.train(table, langid.fold("doc_id", 4) != 2, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:120]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    kept = {r["doc_id"] for r in langid.stage(spark, table, "").collect()}
    assert kept == {r[0] for r in rows[:120]}
    none = langid.train(empty, F.lit(True), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.identify(table, none).collect()} == {"und"} and langid.identify(empty, none).count() == 0


def test_temperature_calibrates():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    z = rng.normal(size=(4000, 3))
    z[np.arange(4000), y] += 1.0
    assert langid.temperature(z * 4, y) == pytest.approx(4 * langid.temperature(z, y), rel=0.05)


def test_langid_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op2_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97
    none = spark.createDataFrame([(None, "some words here", "en"), (None, "más palabras aquí", None), (1, "words", "en"), (1, "words", "en")], "doc_id long, text string, lang string")
    model = langid.train(none, langid.fold("doc_id", 4) != 2, "doc_id", "text", "lang")
    assert langid.identify(none, model).count() == 4


# 3: near-duplicates


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, empty):
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect()}
    ids = [r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None]
    fp = {i: brute_fingerprint(t) for i, t in cases.distinct_rows(docs).items()}
    root = {i: i for i in ids}
    for _ in range(len(root)):
        for a, b in itertools.combinations(sorted(root), 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    assert {g for g in got if g[0] is not None} == {(i, fp[i], root[i]) for i in ids}
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0


def test_simhash_links_over_two_bits_and_chains(spark):
    values = [0, 3, 7 << 3 | 3, 1 << 63, 5, (1 << 20) - 1]
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    from waymark.llm.common import Shared
    from waymark.llm.components import connected

    found = {(r["node"], r["root"]) for r in connected(simhash.links(frame), Shared(spark)).collect()}
    low = -(1 << 63)
    assert {n for n, _ in found} == {0, 3, low, 5} and {r for _, r in found} == {low}


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicate_stage_reaches_similarity(spark, docs, empty, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (50, 90, 130)]  # 191 of 201 shingles
    edge = " ".join([f"v{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(base)])  # 0.81 of base
    far = " ".join([f"u{i}" if i % 25 == 0 else w for i, w in enumerate(base)])  # under 0.8 of all
    rows = [" ".join(base), *near, edge, far, "", None, "a b c", "A  b\nC", "a b d"]
    frame = cases.documents(spark, extra=False, some=rows)

    def brute(text):
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [brute(t) for t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert root[:6] == [0, 0, 0, 0, 0, 5]
    kept = {r["doc_id"] // 3 for r in simhash.stage(spark, frame, "").collect()}
    assert kept == {i for i, r in enumerate(root) if i == r}
    assert simhash.stage(spark, empty, "").count() == 0


def test_links_across_a_large_bucket_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):  # thirty groups that share a passage, none near the bucket's least
        own = [f"x{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(4):
            own = list(own)
            own[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join([*[f"p{i}" for i in range(25)], *own]))
    sets = [minhash.shingles(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if minhash.similarity(sets[a], sets[b]) >= 0.8]

    def groups(links):
        root = list(range(len(texts)))
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    assert len(set(groups(near))) <= 40
    rows = spark.createDataFrame([(1, k, k, t) for k, t in enumerate(texts)], "key long, node long, root long, text string")
    found = [(r["a"], r["b"]) for r in minhash.across(rows, 5, 0.8).collect()]
    assert set(map(tuple, map(sorted, found))) <= set(near) and groups(found) == groups(near) and len(found) < len(texts)


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "changed", *base[51:]])
    rows = [(None, " ".join(base)), (None, near), (None, "only words without an id"), (None, "only words without an id"), (7, near), (7, "another text of seven"), (7, "another text of seven"), (3, "three"), (3, "three and more"), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, stays string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(7, near), (None, "only words without an id"), (7, "another text of seven"), (3, "three"), (3, "three and more"), (8, "")], key=str)


# 4: shards


def test_shards_are_even_gapless_and_keep_groups(docs, empty, spark):
    got = shards.assign(docs, 5).collect()
    assert len(got) == docs.count()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(5)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    texts = cases.distinct_rows(docs)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert shards.cut_links(shards.assign(docs, 5)).first()["cut"] == 0
    assert shards.assign(empty, 5).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 2 else f"t{i // 4}") for i in range(400)], "doc_id long, text string")
    placed = shards.assign(hot, 8)
    assert {r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {50}
    per = placed.join(hot, "doc_id").where("text = 'same'").groupBy("shard").count().collect()
    assert len(per) <= 5 and shards.cut_links(placed).first()["cut"] <= 3


# 5: benchmark passages

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width=10):
    w = NORMAL.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = NORMAL.findall((t or "").translate(ASCII_LOWER))
        n = min(width, len(v))
        keys = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1) if n else ():
            if tuple(w[p : p + n]) in keys:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = [t for t in cases.texts() if t]
    items = [(1, " ".join(texts[5].split()[:30])), (2, "Shared, " + texts[9].upper()), (3, "x"), (4, None), (5, "..."), (10, " ".join(texts[5].split()[:30]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["n_words"], r["n_hit"], r["items"], r["doc_id"]) for r in decontaminate.find_contamination(docs, frame).collect()), key=str)
    expect = sorted((*brute_hits(r["text"], items), r["doc_id"]) for r in docs.where("doc_id IS NOT NULL").collect())
    assert sorted(g for g in got if g[3] is not None) == expect
    assert decontaminate.find_contamination(empty, frame).count() == 0
    assert decontaminate.find_contamination(docs, frame.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_without_ids_and_as_a_stage(spark, docs, empty, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"x {passage} y"), (None, "clean"), (5, passage), (5, "clean too"), (6, None), (7, "")]
    table = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, items string")
    items = spark.createDataFrame([(None, passage), (None, passage + " twelve"), ("b", passage)], "item_id string, text string")
    assert {r["n_hit"] for r in decontaminate.find_contamination(table, items).collect()} == {0, 11}
    hit = decontaminate.find_contamination(table, items).where("n_hit > 0").collect()
    assert len(hit) == 2 and all(r["items"] == ["b", None] for r in hit)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = sorted(((r["doc_id"], r["text"]) for r in decontaminate.stage(spark, table, str(tmp_path)).collect()), key=str)
    assert left == sorted([(None, "clean"), (5, "clean too"), (6, None), (7, "")], key=str)
    assert decontaminate.stage(spark, docs, str(tmp_path)).count() == docs.count() and decontaminate.stage(spark, empty, str(tmp_path)).count() == 0


def test_decontamination_spans_point_at_the_original(spark):
    docs = spark.createDataFrame([(1, "Oh! The QUICK, brown fox; él said no")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox él")], "item_id long, text string")
    r = decontaminate.find_contamination(docs, items).first()
    s = r["spans"][0]
    assert "Oh! The QUICK, brown fox; él said no"[s["start"] : s["end"]] == "QUICK, brown fox; él"


# 6: language model


def test_suffix_tree_base_and_normalisation(docs, empty):
    training = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    got = lm.score_documents(docs, training).collect()
    rows = docs.select("doc_id", "text").collect()
    words = lambda t: [*WORD.findall((t or "").translate(ASCII_LOWER)), None]
    count = Counter(w for r in rows if r["doc_id"] is None or r["doc_id"] % 5 != 1 for w in words(r["text"]))
    n, z = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    expect = sorted((str(r["doc_id"]), len(words(r["text"])), sum(count[w] > 0 for w in words(r["text"])), round(sum(math.log10((count[w] + 0.5) / z) for w in words(r["text"])), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expect
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(empty, training).count() == 0


def brute_tree(texts, training, depth):
    """log10 probability of each text by the definition: dictionaries of contexts, leave-one-out test, Witten-Bell."""
    words = [[*WORD.findall((t or "").translate(ASCII_LOWER)), None] for t in texts]
    count = Counter(w for ws, good in zip(words, training) if good for w in ws)
    total, kinds = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.5) / (total + 0.5 * (kinds + 1))
    contexts = lambda ws, i, d: ("^", *ws[: i])[-d:] if i + 1 >= d else None
    states: dict = {}

    def probability(context, w):
        for d in range(len(context), 0, -1):
            seen = states.get(context[-d:])
            if seen is not None:
                n, k = sum(seen.values()), len(seen)
                return (seen[w] + k * probability(context[-d:][1:], w)) / (n + k)
        return base(w)

    for d in range(1, depth + 1):
        found: dict = {}
        for ws, good in zip(words, training):
            for i, w in enumerate(ws):
                if good and contexts(ws, i, d):
                    found.setdefault(contexts(ws, i, d), Counter())[w] += 1
        new = {}
        for c, seen in found.items():
            n, k = sum(seen.values()), len(seen)
            gain = sum(m * (math.log((m - 1) / (n - 1 + k)) - math.log(probability(c[1:], w))) for w, m in seen.items() if m > 1)
            gain += sum(math.log(k / (n - 1 + k)) for m in seen.values() if m == 1) if n > 1 else 0
            if n > 1 and gain > 1e-3:
                new[c] = seen
        states |= new
    return [sum(math.log10(probability(("^", *ws[:i])[-depth:], w)) for i, w in enumerate(ws)) for ws in words], len(states)


@pytest.mark.parametrize("most_hot", [4096, 8])
def test_suffix_tree_equals_brute_force(spark, monkeypatch, most_hot):
    import random

    monkeypatch.setattr(lm, "MOST_HOT", most_hot)
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    chain = {w: r.sample(words, 3) for w in words}
    texts = []
    for _ in range(120):
        ws = [r.choice(words)]
        for _ in range(r.randint(0, 40)):
            ws.append(r.choice(chain[ws[-1]]) if r.random() < 0.7 else r.choice(words))
        texts.append(" ".join(ws))
    texts += [texts[3], texts[3], texts[7].upper(), None, "", "new words only"]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in lm.score_documents(frame, F.col("doc_id") % 5 != 1).collect()}
    expect, states = brute_tree(texts, [i % 5 != 1 for i in range(len(texts))], lm.DEPTH)
    assert states > 60
    assert [got[i] for i in range(len(texts))] == pytest.approx(expect, rel=2e-3)


def test_suffix_tree_learns_the_corpus(spark):
    """On rows that it has not seen the tree is no worse than its root; texts that occur twice stand out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = lm.score_documents(docs, ~held_out).join(docs.select("doc_id", F.md5("text").alias("t")), "doc_id")
    got = got.join(got.where("training").groupBy("t").count(), "t", "left").toPandas()
    held = got[~got["training"]]
    assert held["score"].sum() > held["base_score"].sum()
    gain = (got["score"] - got["base_score"]) / got["n_tokens"]
    many = got["n_tokens"] > 30
    once, twice = gain[many & (got["count"] == 1)], gain[many & (got["count"] > 1)]
    assert len(twice) > 20 and (twice > once.median() + 1).mean() > 0.95


# 7 and 9: repeats


def brute_repeats(docs, tokens, width: int, same_document: bool):
    """For each document (id, mark) its tokens and which of them are removed; rows of one id are told apart by their texts."""
    rows = {(r["doc_id"], r["mark"]): r["text"] for r in docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").collect()}
    ordered = sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    first: dict = {}
    units = {k: tokens(rows[k]) for k in ordered}
    for k in ordered:
        for p in range(len(units[k]) - width + 1):
            first.setdefault(tuple(units[k][p : p + width]), (k, p))
    out = {}
    for k in ordered:
        gone = [False] * len(units[k])
        for p in range(len(units[k]) - width + 1):
            at = first[tuple(units[k][p : p + width])]
            if at != (k, p) and (same_document or at[0][0] != k[0]):
                gone[p : p + width] = [True] * width
        out[k] = gone
    return units, out


def shared_line(spark, n=300, seed=5):
    """Every row has one line in surroundings of its own; a third are copies; ids are missing and repeated, with other texts."""
    import random

    r = random.Random(seed)
    say = lambda k: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(k))
    line, copy = say(45), say(80)
    rows = [(None if i % 25 == 3 else i // 2 if i % 10 == 7 else i, copy if i % 3 == 0 else f"{say(r.randint(5, 40))} {line} {say(r.randint(5, 40))}") for i in range(n)]
    rows += [(11, say(40) + " " + line[40:]), (11, copy + " x " + say(30)), (None, None), (4, ""), (None, copy)] + rows[5:9]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def check_words(docs):
    units, gone = brute_repeats(docs, lambda t: WORD.findall(t or ""), 20, True)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in graph.repeated_spans(docs, digest=True).collect())
    keys = [(r["doc_id"], r["mark"]) for r in docs.select("doc_id", F.xxhash64("text").alias("mark")).collect()]
    assert got == sorted((str(k[0]), len(units[k]), sum(gone[k]), sha(" ".join(w for w, g in zip(units[k], gone[k]) if not g).encode())) for k in keys)
    return gone


def test_word_repeats_equal_brute_force(spark, docs, empty):
    gone, texts = check_words(docs), cases.distinct_rows(docs)
    for r in graph.repeated_spans(docs).collect():
        words = WORD.findall(texts[r["doc_id"]] or "")
        own = next(g for k, g in gone.items() if k[0] == r["doc_id"])
        assert WORD.findall(r["kept"] or "") == [w for w, g in zip(words, own) if not g]
        for s in r["spans"]:
            assert words[s["start"] : s["start"] + s["words"]] == WORD.findall(texts[s["source"]])[s["source_start"] : s["source_start"] + s["words"]]
    assert graph.repeated_spans(empty, digest=True).count() == 0
    staged = graph.stage(spark, docs, "")
    assert staged.columns == docs.columns and staged.count() <= docs.count()


def test_repeats_with_missing_and_repeated_ids_and_a_line_of_all_rows(spark):
    docs = shared_line(spark).cache()
    check_words(docs)
    check_bytes(docs)


def test_a_common_line_does_not_fill_one_bucket(spark):
    import numpy as np
    import pyarrow as pa

    from waymark.llm import anchors

    docs = shared_line(spark, 2000)
    dealt = graph.WordRepeats().deal(anchors.keyed(docs, "doc_id", "text"), 3, 8, 2009).where(F.col("kind") == anchors.SEGMENT).toArrow()
    found = Counter()
    for k, row in enumerate(dealt.to_pylist()):
        found.update((row["place"], a) for a in np.frombuffer(row["a"], np.uint32).tolist())
    assert max(found.values()) <= 4 * anchors.RECURS and isinstance(dealt, pa.Table)


def test_paths_compact_between_branching_nodes(spark):
    from waymark.llm.common import Shared

    # one path of nodes 1 to 9 in three pieces, from which 20 branches off at 5; a ring of 30, 31 and 32
    rows = [(1, 0, 0, 2, [1, 2, 3]), (1, 0, 2, 4, [3, 4, 5, 6, 7]), (2, 0, 9, 2, [7, 8, 9]), (3, 0, 0, 1, [5, 20]), (4, 0, 0, 2, [30, 31, 32]), (4, 0, 5, 1, [32, 30])]
    pieces = spark.createDataFrame(rows, "gid long, gmark long, gstart long, n long, nodes array<long>")
    got = [(r["gid"], r["gstart"], r["io"], r["n"], r["path"], r["at"]) for r in graph.compacted(pieces, Shared(spark)).collect()]
    by = {}
    for r in got:
        by.setdefault(r[4], []).append((r[5], *r[:4]))
    assert sorted(sorted(x) for x in by.values()) == [[(0, 1, 0, 0, 2), (2, 1, 2, 0, 2)], [(0, 1, 2, 2, 2), (2, 2, 9, 0, 2)], [(0, 3, 0, 0, 1)], [(0, 4, 0, 0, 2)], [(0, 4, 5, 0, 1)]]


def check_bytes(docs):
    units, gone = brute_repeats(docs, lambda t: (t or "").encode(), 50, False)
    runs = lambda k: sum(g and (i == 0 or not gone[k][i - 1]) for i, g in enumerate(gone[k]))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_bytes(docs, digest=True).collect())
    keys = [(r["doc_id"], r["mark"]) for r in docs.select("doc_id", F.xxhash64("text").alias("mark")).collect()]
    assert got == sorted((str(k[0]), len(units[k]), sum(gone[k]), runs(k), sha(bytes(b for b, g in zip(units[k], gone[k]) if not g))) for k in keys)


def test_byte_repeats_equal_brute_force(docs, empty):
    check_bytes(docs)
    assert suffixes.repeated_bytes(empty, digest=True).count() == 0


def test_maximal_repeats_of_a_small_text():
    import numpy as np

    text = b"xabcdyabcdzabcq"
    raw = np.frombuffer(text, np.uint8)
    at = np.arange(len(text))
    array = suffixes.SuffixArray(raw, at, np.full(len(text), len(text)), np.zeros(len(text), int))
    before = np.where(array.order > 0, raw[array.order - 1].astype(int), -1)
    groups = {(text[array.order[a] : array.order[a] + n], tuple(sorted(array.order[a : z + 1].tolist()))) for a, z, n in suffixes.maximal_repeats(array.common, before, 2)}
    assert groups == {(b"abcd", (1, 6)), (b"abc", (1, 6, 11))}


# 8: tokens


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    extra = ["ΣΑΣ İ ẞ ﬁ K", "a<|endoftext|>b <|ENDOFTEXT|>", "''s'tx don't I'LL", "½ Ⅷ ①² 7", "\x1c\x85\x00a​", "日本語" * 300, "é" * 900]
    codec = bpe.codec(path)
    for t in [*extra, *[t for t in cases.texts() if t is not None]]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode_text(t) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t[:40]
    full = {str((r["doc_id"], r["ids"])): r["decoded"] for r in bpe.encode_documents(docs, path).collect()}
    again = bpe.decode_ids(bpe.encode_documents(docs, path), path).collect()
    assert sorted(full.values()) == sorted({str((r["doc_id"], r["decoded"])): r["decoded"] for r in again}.values())
    digests = bpe.encode_documents(docs, path, digest=True).where("text IS NULL" if False else "n_tokens = 0").collect()
    assert all(r["ids_sha256"] == sha(b"") == r["decoded_sha256"] for r in digests) and len(digests) >= 3
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_encodes_every_word_of_a_very_long_text_once():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    for n in (bpe.BLOCK_WORDS, bpe.BLOCK_WORDS + 1, 65_000):
        text = " ".join(f"w{i % 7919}" if i % 3 else "the" for i in range(n // 2)) + " x" * (n - n // 2)
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.codec(path).encode_text(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), n


def test_bpe_cuts_are_certain():
    codec = bpe.codec(bpe.default_tokenizer())
    for token in list(codec.vocab)[::97]:
        assert len(codec.cut(token.removesuffix(codec.end))) <= 1 or not token.removesuffix(codec.end)
    long = list("thequickbrownfox" * 40)
    assert codec.merge_long(list(long)) == codec.merge(list(long))


def test_bpe_stage_reads_awkward_rows(spark, docs, empty):
    got = bpe.stage(spark, docs, "")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == docs.count()
    assert bpe.stage(spark, empty, "").count() == 0


# 10: quality


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(inside)


def test_quality_counts_and_verdicts(spark, docs, empty):
    for r in quality.judge(docs, None).collect():
        n = brute_quality(cases.distinct_rows(docs)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r["kept"] == (not r["base_failed"])
    import random

    r = random.Random(4)
    good = [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(60)) for _ in range(60)]
    rows = [(i, t if i % 2 else t.upper().replace(" ", "!! ")) for i, t in enumerate(good)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in quality.judge(table, quality.train(table, labels)).collect()}
    assert got == {i: bool(i % 2) for i in range(60)}
    assert quality.train(empty, labels) is None and quality.judge(empty, None).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    got = quality.judge(docs, quality.train(docs, labels.where(~fold))).join(labels.where(fold), "doc_id").where("NOT base_failed AND quality IS NOT NULL").toPandas()
    assert len(got) > 50 and (got["kept"] == (got["quality"] > 0)).mean() > 0.9
