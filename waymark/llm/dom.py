"""A small, forgiving reader of HTML: a tree of block elements with their text, built in one pass over the tags."""

from __future__ import annotations

import html as entities
import re

#: Elements whose content is never text of the page (raw text in HTML, or not shown).
RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|template|object|canvas"
#: Attributes of a tag, names apart from values: a quote matters only where a value begins.
ATTRIBUTES = r"(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+[\s/]*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # an empty comment ends at once
    rf"|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"  # "/>" closes none of these
    rf"|<svg(?=[\s/>]){ATTRIBUTES}(?:(?<=/)>|>.*?(?:</svg(?=[\s/>])[^>]*+>|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<[!?/][^>]*+>|</?[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source input button select option optgroup output meter progress br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover semantics".split()
)
#: Inline elements whose own words are controls of a form, not prose.
CONTROLS = frozenset(("button", "select", "option", "optgroup", "output", "meter", "progress"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph, and what ends an open element of the same kind.
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
SCOPES = frozenset(("table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "aside", "nav", "main", "body"))
SPACE = re.compile(r"\s+")


class Page:
    """tags, parents and attribute words of the block elements (0 is the document), and the blocks of text.

    A block is text of one element that no other block element interrupts: (element, text, letters inside links).
    """

    def __init__(self, source: str | None) -> None:
        self.tags, self.parents, self.words = ["#document"], [-1], [()]
        self.blocks: list[tuple[int, str, int]] = []
        self.hidden = {0: False}
        self._stack, self._text, self._linked, self._inside = [0], [], 0, [0, 0]
        if source:
            self._read(source.replace("\0", ""))

    def _flush(self) -> None:
        if self._text:
            text = SPACE.sub(" ", entities.unescape("".join(self._text))).strip()
            if text and not self.hidden[self._stack[-1]]:
                self.blocks.append((self._stack[-1], text, self._linked))
            self._text.clear()
        self._linked = 0

    def _open(self, tag: str, attributes: str) -> None:
        stack, tags = self._stack, self.tags
        if tag != "#document" and tags[stack[-1]] == "p":
            stack.pop()
        if tag in ENDS_ITSELF:
            for at in range(len(stack) - 1, 0, -1):
                name = tags[stack[at]]
                if name in ENDS_ITSELF[tag]:
                    del stack[at:]
                    break
                if name in SCOPES:
                    break
        words, hidden = (), self.hidden[stack[-1]]
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or name == "style" and NOT_SHOWN.search(value):
                    hidden = True
                elif name in ("class", "id", "role"):
                    words += tuple(re.findall("[a-z]+", value))
        tags.append(tag)
        self.parents.append(stack[-1])
        self.words.append(words)
        self.hidden[len(tags) - 1] = hidden
        if tag not in VOID:
            stack.append(len(tags) - 1)

    def _close(self, tag: str) -> None:
        for at in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[at]] == tag:
                del self._stack[at:]
                return

    def _read(self, source: str) -> None:
        at, text, inside = 0, self._text, self._inside
        for m in TOKEN.finditer(source):
            if m.start() > at and not inside[1]:
                piece = source[at : m.start()]
                text.append(piece)
                if inside[0]:
                    self._linked += len(piece)
            at = m.end()
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    inside[0] = not m[2]
                elif tag in CONTROLS:
                    inside[1] = max(0, inside[1] + (-1 if m[2] else 1))
                continue
            self._flush()
            inside[0] = inside[1] = 0
            if tag in ("html", "body", "head"):  # what a head shows nothing of is raw; the first text ends it
                if tag == "body" and not m[2] and len(self._stack) > 1:
                    self._stack[1:] = []
                continue
            if m[2]:
                self._close(tag)
            else:
                self._open(tag, m[4])
        if at < len(source) and not inside[1]:
            text.append(source[at:])
        self._flush()
