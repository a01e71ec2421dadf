"""Candidate pairs by equi-joins: a block key (postcode, state, a resolved postcode) and the house number.

The number gate is an OR of equality and overlap, which no engine turns into hash joins; it is written as an equi-join by
the number at which two ranges meet, and disjoint branches for the rest, each an equi-join with at most a small residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alias_filter(alias_types: list | None) -> Column | None:
    """None: no filter; a None in the list: rows without alias type; strings: rows of these types; []: no row."""
    if alias_types is None:
        return None
    named = [a for a in alias_types if a is not None]
    out = F.lit(False)
    if named:
        out = F.coalesce(F.col("alias_type").isin(named), F.lit(False))
    return (out | F.col("alias_type").isNull()) if None in alias_types else out


def number_gate(col=F.col) -> Column:
    """The gate as one predicate, for comparison with the branches."""
    a, b = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    c, d = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    numbered = (c == a) | ((c <= b) & (d >= a)) | (c.isNull() & (col("c_token_number") == a))
    return F.coalesce(F.when(a.isNotNull(), numbered).when(col("i_lot") != "", col("i_lot") == col("c_lot")).otherwise(F.lit(True)), F.lit(False))


#: House number ranges of at most this many numbers are spelt out for an equi-join; wider ones, which are rare, are
#: compared within their block.
SPELT = 256


def _any(df: DataFrame, kinds: dict[str, Column]) -> dict[str, bool]:
    return df.agg(*[F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)).alias(k) for k, c in kinds.items()]).first().asDict()


def needed(inputs: DataFrame, ref: DataFrame) -> dict[str, bool]:
    """Which branches of the gate can have pairs at all; reads both sides, which should be written ones."""
    col, a = F.col, F.col("in_number_first")
    c, d, last = col("number_first"), col("number_last"), col("in_number_last")
    i = _any(inputs, {"numbered": a.isNotNull(), "spread": (last > a) & (last - a <= SPELT), "broad": last - a > SPELT, "lot": a.isNull() & (col("i_lot") != ""), "bare": a.isNull() & (col("i_lot") == "")})
    r = _any(ref, {"numbered": c.isNotNull(), "ranged": (d > c) & (d - c <= SPELT), "wide": (d > c) & (d - c > SPELT), "token": c.isNull() & col("c_token_number").isNotNull(), "lot": col("c_lot") != ""})
    return {
        "ranged": i["numbered"] and r["ranged"], "wide": i["numbered"] and r["wide"], "spread": i["spread"] and r["numbered"], "broad": i["broad"] and r["numbered"],
        "token": i["numbered"] and r["token"], "lot": i["lot"] and r["lot"], "bare": i["bare"],
    }


def meeting(inputs: DataFrame, ref: DataFrame, branches: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered inputs and candidates by the numbers, _i and _c, at which they can meet: a pair that passes the gate meets where the
    later of its two ranges begins, and only there."""

    def each(side: DataFrame, name: str, first: Column, last: Column, spelt: bool) -> DataFrame:
        """A row for every number of a range that is spelt out, else one for the first."""
        long = last - first > SPELT
        return side.withColumn(name, F.explode(F.sequence(first, F.when(long, first).otherwise(F.greatest(first, last)))) if spelt else first)

    col, some = F.col, branches or {}
    a, b = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    c, d = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    return each(inputs.where(a.isNotNull()), "_i", a, b, some.get("spread", True)), each(ref.where(c.isNotNull()), "_c", c, d, some.get("ranged", True))


def block_pairs(inputs: DataFrame, ref: DataFrame, keys: list[tuple[str, str]], gate: bool = True, branches: dict[str, bool] | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of prepared inputs and candidates with equal keys (input column, candidate column) that pass the gate.

    No pair comes twice. Sides are left to the planner: it broadcasts one only below its size threshold, else both are
    shuffled by the keys and skewed partitions are split. ``branches``, of needed(), leaves out those without pairs.
    ``tasks`` deals the numbered inputs by what they meet by into so many tasks, which the planner keeps.
    """

    def join(left: DataFrame, right: DataFrame, more: list[Column], residual: Column | None = None) -> DataFrame:
        on = [F.col(a) == F.col(b) for a, b in keys] + more + ([residual] if residual is not None else [])
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        return left.join(right, condition)

    if not gate:
        return join(inputs, ref, [])
    col, some = F.col, branches or {}
    a, b = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    c, d = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    numbered = inputs.where(col("in_number_first").isNotNull())
    bare = inputs.where(col("in_number_first").isNull())
    wide, broad = d - c > SPELT, b - a > SPELT

    def meet() -> DataFrame:
        left, right = meeting(inputs, ref, some)
        if tasks:
            left = left.where(" AND ".join(f"{m} IS NOT NULL" for m, _ in keys)).repartition(tasks, *(m for m, _ in keys), "_i")
        there = (col("_i") == a) & (c == a) | (col("_i") == F.greatest(a, c)) & (c <= b) & (d >= a)
        return join(left, right, [col("_i") == col("_c")], there).drop("_i", "_c")

    made = {
        "meet": meet,
        # ranges that are not spelt out, behind their first number
        "wide": lambda: join(numbered, ref.where(wide), [], (c < a) & (d >= a) & (c <= b)),
        "broad": lambda: join(numbered.where(broad), ref, [], (c > a) & (c <= b) & (d >= a)),
        "token": lambda: join(numbered, ref.where(col("number_first").isNull() & col("c_token_number").isNotNull()), [col("c_token_number") == a]),
        "lot": lambda: join(bare.where("i_lot <> ''"), ref.where("c_lot <> ''"), [col("i_lot") == col("c_lot")]),
        "bare": lambda: join(bare.where("i_lot = ''"), ref, []),
    }
    parts = [make() for k, make in made.items() if some.get(k, True)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
