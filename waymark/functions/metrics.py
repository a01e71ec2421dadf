"""String metrics over UTF-8 bytes: Jaro-Winkler and unrestricted Damerau-Levenshtein, as Arrow UDFs on distinct pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four bytes where it exceeds 0.7."""
    s, t = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    if s == t:
        return 1.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken, matched = [False] * m, []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and t[j] == c:
                taken[j] = True
                matched.append(c)
                break
    k = len(matched)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (t[j] for j in range(m) if taken[j])))
    jaro = (k / n + k / m + (k - swaps // 2) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(s[:4], t[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def damerau(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, which may be edited further in between."""
    s, t = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    n, m = len(s), len(t)
    if not n or not m:
        return n + m
    last: dict[int, int] = {}
    far = n + m
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        row, seen = [far, i], 0
        above = rows[i]
        for j in range(1, m + 1):
            k, q = last.get(t[j - 1], 0), seen
            if s[i - 1] == t[j - 1]:
                cost, seen = 0, j
            else:
                cost = 1
            row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, rows[k][q] + (i - k - 1) + 1 + (j - q - 1)))
        last[s[i - 1]] = i
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.StructType([T.StructField("jw", T.DoubleType()), T.StructField("dl", T.IntegerType())]))
def _both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(None, None) if x is None or y is None else (jaro_winkler(x, y), damerau(x, y)) for x, y in zip(a, b)]
    return pd.DataFrame({"jw": pd.Series([p[0] for p in pairs], dtype="float64"), "dl": pd.Series([p[1] for p in pairs], dtype="Int32")})


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def damerau_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b)], dtype="Int32")


def opposed(a: Column, b: Column) -> Column:
    """Whether one name says NORTH and the other SOUTH, or EAST and WEST, as whole words; both at once cancel."""

    def axis(plus: str, minus: str) -> Column:
        side = [F.when(x.rlike(f"(^| ){plus}( |$)"), 1).otherwise(0) - F.when(x.rlike(f"(^| ){minus}( |$)"), 1).otherwise(0) for x in (a, b)]
        return side[0] * side[1] == -1

    return axis("NORTH", "SOUTH") | axis("EAST", "WEST")


def similarity_factor(a: Column, b: Column, jw: Column, dl: Column) -> Column:
    """0 if a name is blank, 1 if equal, else half a ramp of Jaro-Winkler and half the squared edit similarity."""
    ramp = 0.05 + 0.95 * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (jw - 0.6) / 0.4)), F.lit(2.0))
    edit = 1.0 - dl / F.greatest(F.lit(1), F.octet_length(a), F.octet_length(b))
    mixed = F.greatest(F.lit(0.05), 0.5 * ramp + 0.5 * F.pow(edit, F.lit(2.0))) * F.when(opposed(a, b), 0.5).otherwise(1.0)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(mixed)


#: Pairs of names whose factor a worker remembers.
REMEMBERED = 1 << 17
_memo: dict[tuple[str, str], float] = {}
_AXES = tuple((re.compile(f"(?:^| ){a}(?: |$)"), re.compile(f"(?:^| ){b}(?: |$)")) for a, b in (("NORTH", "SOUTH"), ("EAST", "WEST")))


def factor(a: str, b: str) -> float:
    """similarity_factor of two names that are filled and not equal."""
    jw, longest = jaro_winkler(a, b), max(1, len(a.encode("utf-8", "surrogatepass")), len(b.encode("utf-8", "surrogatepass")))
    rise = max(0.0, min(1.0, (jw - 0.6) / 0.4))
    edit = 1.0 - damerau(a, b) / longest
    out = max(0.05, 0.5 * (0.05 + 0.95 * (rise * rise)) + 0.5 * (edit * edit))
    side = lambda x, axis: bool(axis[0].search(x)) - bool(axis[1].search(x))
    return out * 0.5 if any(side(a, axis) * side(b, axis) == -1 for axis in _AXES) else out


def remembered(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    found = _memo.get((a, b))
    if found is None:
        if len(_memo) >= REMEMBERED:
            _memo.clear()
        found = _memo[a, b] = factor(a, b)
    return found


def with_factors(pairs: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each output the factor of two name columns. Only unequal, filled names reach Python, all in one call; each
    worker compares two names once."""

    @F.pandas_udf(T.StructType([T.StructField(f"f{k}", T.DoubleType()) for k in range(len(names))]))
    def factors(sides: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({f"f{k}": pd.Series([remembered(a, b) for a, b in zip(sides[f"a{k}"].tolist(), sides[f"b{k}"].tolist())], dtype="float64") for k in range(len(names))})

    sides, out = [], {}
    for k, (name, (a, b)) in enumerate(names.items()):
        blank, same = (F.col(a) == "") | (F.col(b) == ""), F.col(a) == F.col(b)
        hard = ~blank & ~same
        sides += [F.when(hard, F.col(a)).alias(f"a{k}"), F.when(hard, F.col(b)).alias(f"b{k}")]
        out[name] = F.when(blank, F.lit(0.0)).when(same, F.lit(1.0)).otherwise(F.col(f"_m.f{k}"))
    return pairs.withColumn("_m", factors(F.struct(*sides))).withColumns(out).drop("_m")


def pair_similarities(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """The factor of every distinct pair of two name columns: (a, b, out). Only unequal, filled pairs reach Python."""
    distinct = pairs.select(a, b).distinct()
    easy = (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))
    hard = distinct.where(~easy).withColumn("_m", _both(a, b))
    scored = hard.select(a, b, similarity_factor(F.col(a), F.col(b), F.col("_m.jw"), F.col("_m.dl")).alias(out))
    return scored.unionByName(distinct.where(easy).select(a, b, F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(1.0).alias(out)))
