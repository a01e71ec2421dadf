"""Seeded perturbation of address labels, for benchmarks: each row's changes depend on the seed and its id alone."""

from __future__ import annotations

import random
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.vocab import FLAT_TYPES, STATES, StreetTypes, inverted

UNIT = re.compile(rf"^(?:{'|'.join(sorted(inverted(FLAT_TYPES), key=lambda w: -len(w)))}) (\d+[A-Z]?) ")
TYPES = StreetTypes.common().canonical
SHORT = {name: min((a for a, n in TYPES.items() if n == name), key=len) for name in set(TYPES.values())}


def typo(word: str, r: random.Random) -> str:
    """One letter dropped, doubled, swapped with the next or replaced."""
    if len(word) < 4:
        return word
    i, kind = r.randrange(1, len(word) - 1), r.randrange(4)
    return (word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + word[i + 1 :])[kind]


def in_part(text: str, part: int, r: random.Random) -> str:
    """A typo in one word of a comma-separated part."""
    parts = text.split(", ")
    words = parts[part].split(" ")
    at = [i for i, w in enumerate(words) if len(w) >= 4 and w.isalpha() and w not in STATES and w not in TYPES]
    if at:
        i = r.choice(at)
        words[i] = typo(words[i], r)
    parts[part] = " ".join(words)
    return ", ".join(parts)


def short_type(t: str, r: random.Random) -> str:
    head, comma, tail = t.partition(",")
    words = head.split(" ")
    words[-1] = SHORT.get(words[-1], words[-1])
    return " ".join(words) + comma + tail


CHANGES = {
    "type_abbreviation": short_type,
    "commas": lambda t, r: t.replace(",", ""),
    "case": lambda t, r: t.title() if r.random() < 0.5 else t.lower(),
    "spacing": lambda t, r: re.sub(" ", lambda m: "  " if r.random() < 0.3 else " ", t),
    "unit_word": lambda t, r: UNIT.sub(r"\1/", t),
    "building": lambda t, r: re.sub(r"^(?!UNIT|FLAT|LOT|SHOP|LEVEL)[A-Z ]+ (?=\d)", "", t),
    "locality_typo": lambda t, r: in_part(t, -1, r),
    "street_typo": lambda t, r: in_part(t, 0, r),
    "state_postcode_swap": lambda t, r: re.sub(r"\b([A-Z]{2,3}) (\d{4})$", r"\2 \1", t),
}


def perturb(label: str, r: random.Random, most: int) -> tuple[str, list[str]]:
    """Up to ``most`` changes that have an effect, tried in random order."""
    done: list[str] = []
    names = sorted(CHANGES)
    r.shuffle(names)
    names.sort(key=lambda n: n in ("case", "commas"))  # these hide what the others look for
    for name in names:
        if len(done) == most:
            break
        new = CHANGES[name](label, r)
        if new != label:
            label, done = new, [*done, name]
    return label, done


def perturbed(labels: DataFrame, id_col: str = "input_id", label_col: str = "address_label", seed: int = 1, most: int = 3) -> DataFrame:
    """(id, label, perturbed, changes) of every labelled row."""
    kind = dict(labels.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            rows = [perturb(t, random.Random(zlib.crc32(f"{seed}:{i}".encode())), most) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1])]
            yield pd.DataFrame({id_col: batch.iloc[:, 0], label_col: batch.iloc[:, 1], "perturbed": [a for a, _ in rows], "changes": [b for _, b in rows]})

    return labels.where(F.col(label_col).isNotNull()).select(id_col, label_col).mapInPandas(run, f"`{id_col}` {kind}, `{label_col}` string, perturbed string, changes array<string>")


def accuracy(results: DataFrame, truth: str, found: str) -> DataFrame:
    """Share of right matches by number of changes."""
    return results.groupBy(F.size("changes").alias("n_changes")).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(truth) == F.col(found), F.lit(False)).cast("double")).alias("correct"))
