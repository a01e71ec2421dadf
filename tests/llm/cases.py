"""Small awkward tables: nulls in any column, empty and long texts, ties, repeats, clashing extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "id string, part int, kept string, k0 int, fp long, bucket int, score double, label string, shard int, n_words long"


def texts(seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeghilmnorstu", k=r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choices(words, k=n))
    shared, base = say(60), say(150)
    out: list[str | None] = [None, "", " \t\n ", "x", "Ünï cödé ñandú straße 東京 😀", base, base, base + " tail", base.upper(), shared]
    out += [say(r.randint(1, 120)) for _ in range(25)]
    out += [say(20) + " " + shared + "\n" + say(r.randint(0, 30)) for _ in range(8)]
    out += ["la " * 300, "la " * 200 + say(30), say(9) + "\nsame line here\nsame line here\n" + say(60), "#$%& <|> " * 40, say(6000), "z" * 5000]
    return out


def documents(spark, extra: bool = True, some: list | None = None):
    rows = [(i * 3, t, "en" if i % 4 else None, "s", None) for i, t in enumerate(texts() if some is None else some)]
    if some is None:
        rows += [rows[5], rows[12], (None, "a text without an id " * 12, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        return spark.createDataFrame([(*r, *[None] * 10) for r in rows], f"{schema}, {EXTRA}")
    return spark.createDataFrame(rows, schema)


def distinct_rows(docs) -> dict:
    """doc_id -> text; equal rows count once."""
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def before(a, b) -> bool:
    """Whether id a sorts before id b; null first."""
    return (a is not None, a or 0) < (b is not None, b or 0)
