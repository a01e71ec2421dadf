"""Main text of web pages from a tree-structured graphical model over the DOM.

Every block element is a node with two states, main text or not. A node's evidence is its tag, the words of its class,
id and role, the two tags above it, the length and link share of its own text and its part of the page's text; parent and child are tied by a potential.
Sum-product messages pass from the leaves to the root and back and give each element's marginal. All potentials are
estimated, with smoothing, from labelled pages. Blocks of elements that are more likely main text than not are kept.

Defined results: null, empty and text-free pages give an empty text; unclosed and stray tags, cut pages and character
references without an end are read as browsers do, in simplified form; bare text counts as one block of the document;
very long pages are read whole; every row gives one row, so null and repeated ids and repeated rows do, each from its own
html; an element as likely main text as not is left out; an empty table gives none. Words of buttons and other form
controls, and what ``svg``, ``object`` and ``canvas`` hold, are no text. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import arrow_map, read_table
from waymark.llm.dom import Page
from waymark.llm.page_labels import labelled_pages

TRAINING_PAGES = 1200


def evidence(page: Page) -> list[list[str]]:
    """The observed features of every element."""
    n = len(page.tags)
    own, linked, dots = [0] * n, [0] * n, [0] * n
    for at, text, inside in page.blocks:
        own[at] += len(text)
        linked[at] += inside
        dots[at] += text[-1] in ".!?:;"
    below, links = own[:], linked[:]
    for k in range(n - 1, 0, -1):
        below[page.parents[k]] += below[k]
        links[page.parents[k]] += links[k]
    whole, tags, out = max(1, below[0]), page.tags, []
    for k in range(n):
        size, part = own[k], below[k] / whole
        share = ("tiny" if part < 0.03 else "small" if part < 0.15 else "half" if part < 0.5 else "most") + (":links" if 2 * links[k] > below[k] else "")
        kind = "none" if not size else ("short" if size < 30 else "middle" if size < 120 else "long") + (":links" if 2 * linked[k] > size else ":end" if dots[k] else ":open")
        over = tags[page.parents[k]] if k else ""
        above = tags[page.parents[page.parents[k]]] if k and page.parents[k] else ""
        linked_own = ":links" if 2 * linked[k] > size else ""
        out.append([f"tag={tags[k]}", f"path={over}>{tags[k]}{linked_own}", f"line={above}>{over}>{tags[k]}{linked_own}", f"share={share}:{size > 0}", f"own={kind}", *(f"word={w}" for w in set(page.words[k])), *(f"over={w}" for w in (set(page.words[page.parents[k]]) if k else ()))])
    return out


class TreeModel:
    """Log odds of each feature, and the potentials of parent and child."""

    def __init__(self, odds: dict[str, float], tie: list[list[float]], root: float) -> None:
        self.odds, self.tie, self.root = odds, tie, root

    @classmethod
    def trained(cls, pages: list[tuple[Page, list[int]]]) -> "TreeModel":
        seen = {0: Counter(), 1: Counter()}
        states, pairs, roots = Counter(), Counter(), Counter()
        kinds = defaultdict(set)
        for page, labels in pages:
            roots[labels[0]] += 1
            for k, features in enumerate(evidence(page)):
                states[labels[k]] += 1
                if k:
                    pairs[labels[page.parents[k]], labels[k]] += 1
                for f in features:
                    seen[labels[k]][f] += 1
                    kinds[f.partition("=")[0]].add(f)
        odds = {}
        for kind, names in kinds.items():
            size = 0.1 * len(names)
            for f in names:
                odds[f] = log((seen[1][f] + 0.1) / (states[1] + size)) - log((seen[0][f] + 0.1) / (states[0] + size))
        tie = [[(pairs[p, c] + 0.5) / (pairs[p, 0] + pairs[p, 1] + 1) for c in (0, 1)] for p in (0, 1)]
        return cls(odds, tie, log((roots[1] + 0.5) / (roots[0] + 0.5)))

    def marginals(self, page: Page) -> list[float]:
        """Log odds of main text for every element: one pass upward, one downward."""
        parents, n, get = page.parents, len(page.tags), self.odds.get
        (t00, t01), (t10, t11) = self.tie
        up = [0.0] * n
        belief = [sum([get(f, 0.0) for f in features]) for features in evidence(page)]

        def message(x: float, a: float, b: float, c: float, d: float) -> float:
            """log((a e^x + b) / (c e^x + d)) without overflow."""
            if x > 0:
                e = exp(-x) if x < 700 else 0.0
                return log((a + b * e) / (c + d * e))
            e = exp(x) if x > -700 else 0.0
            return log((a * e + b) / (c * e + d))

        for k in range(n - 1, 0, -1):
            up[k] = message(belief[k], t11, t10, t01, t00)
            belief[parents[k]] += up[k]
        belief[0] += self.root
        for k in range(1, n):
            belief[k] += message(belief[parents[k]] - up[k], t11, t01, t10, t00)
        return belief


_model: list[TreeModel] = []


def model() -> TreeModel:
    """Trained once per process: labelled pages and counts come from a fixed seed."""
    if not _model:
        _model.append(TreeModel.trained(labelled_pages(TRAINING_PAGES)))
    return _model[0]


def main_text(source: str | None, tree: TreeModel) -> str:
    page = Page(source)
    if not page.blocks:
        return ""
    good = tree.marginals(page)
    return "\n\n".join([text for at, text, _ in page.blocks if good[at] > 0])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row the id, the kept columns, text and n_chars (code points)."""
    tree, types = model(), dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(source.as_py(), tree) for source in batch.column(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, *keep, "text", "n_chars"])

    return arrow_map(pages.select(id_col, *keep, html_col), run, ", ".join(f"`{c}` {types[c]}" for c in (id_col, *keep)) + ", text string, n_chars long")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
