"""Reviewing matches: text scores, agreement features, score gaps, threshold filters and their code, difference pages."""

from __future__ import annotations

import difflib
import html
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.metrics import jaro_winkler_udf
from waymark.operators import scoring

IDENTIFIERS = {
    "flat_number": ("i_flat", "c_flat"), "flat_type": ("i_flat_type", "c_flat_type"), "level_number": ("i_level", "c_level"), "level_type": ("i_level_type", "c_level_type"), "lot_number": ("i_lot", "c_lot"), "number_suffix": ("i_suffix", "c_suffix"),
    "number_first": ("in_number_first", "number_first"), "number_last": ("in_number_last", "number_last"), "postcode": ("in_postcode", "postcode"), "state": ("in_state", "state"),
}
SOFT = {"street_type": ("i_type", "c_type"), "street_suffix": ("i_direction", "c_direction"), "building_name": ("i_building", "c_building")}


def bigrams(x: Column) -> Column:
    n = F.length(x)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(x, k, F.lit(2)))))


def text_scores(results: DataFrame, text_col: str = "input_standardised", label_col: str | None = None) -> DataFrame:
    """Adds jaro_winkler, jaccard, edit and text_similarity (percent, one decimal) of input text and matched label."""
    label_col = label_col or ("matched_address_label" if "matched_address_label" in results.columns else "address_label")
    a, b = F.upper(F.trim(F.col(text_col))), F.upper(F.trim(F.col(label_col)))
    ga, gb = bigrams(a), bigrams(b)
    both = F.size(F.array_union(ga, gb))
    pct = lambda x: F.round(x * 100, 1)
    jaccard = F.when(both == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(ga, gb)) / both)
    known = a.isNotNull() & b.isNotNull()
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
    out = results.withColumn("_jw", jaro_winkler_udf(a, b))
    out = out.withColumns({"jaro_winkler": pct(F.col("_jw")), "jaccard": F.when(known, pct(jaccard)), "edit": F.when(known, pct(edit))}).drop("_jw")
    return out.withColumn("text_similarity", F.round((F.col("jaro_winkler") + F.col("jaccard")) / 2, 1))


def three_way(a: Column, b: Column) -> dict[str, Column]:
    """agree, conflict and unavailable flags of a pair of values; '' counts as missing."""
    a, b = F.nullif(a.cast("string"), F.lit("")), F.nullif(b.cast("string"), F.lit(""))
    missing = a.isNull() | b.isNull()
    return {"agree": (~missing & (a == b)).cast("int"), "conflict": (~missing & (a != b)).cast("int"), "unavailable": missing.cast("int")}


def features(pairs: DataFrame) -> DataFrame:
    """Agreement features of scored pairs that carry similarities and normal forms: agreement_* at weight 100 without the
    gate, flags per identifier and soft field, and has_identifier_conflict."""
    out = {
        "agreement_postcode": scoring.postcode_score(100.0, F.col("in_postcode"), F.col("postcode")), "agreement_suburb": scoring.name_score(100.0, F.col("suburb_similarity")), "agreement_street_name": scoring.name_score(100.0, F.col("street_similarity")),
        "agreement_street_type": scoring.half_even(F.lit(100.0) * scoring.type_credit()), "agreement_number": scoring.half_even(F.lit(100.0) * scoring.number_credit()), "agreement_flat": scoring.half_even(F.lit(100.0) * scoring.flat_credit()),
    }
    conflict = F.lit(0)
    for name, (a, b) in (IDENTIFIERS | SOFT).items():
        flags = three_way(F.col(a), F.col(b))
        out |= {f"{name}_{k}": v for k, v in flags.items()}
        if name in IDENTIFIERS:
            conflict = conflict + flags["conflict"]
    return pairs.withColumns(out).withColumn("has_identifier_conflict", conflict > 0)


def score_gaps(results: DataFrame) -> DataFrame:
    """Per input of distinct (input_id, address): best, runner_up, score_gap and tied_best."""
    once = results.where("address_detail_pid IS NOT NULL").groupBy("input_id", "address_detail_pid").agg(F.max("total_score").alias("s"))
    n = once.withColumn("r", F.row_number().over(Window.partitionBy("input_id").orderBy(F.col("s").desc(), "address_detail_pid")))
    top = n.where("r <= 2").groupBy("input_id").agg(F.max("s").alias("best"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("runner_up"))
    return top.select("input_id", "best", "runner_up", (F.col("best") - F.col("runner_up")).alias("score_gap"), F.coalesce(F.col("best") == F.col("runner_up"), F.lit(False)).alias("tied_best"))


def scope(limits: Mapping[str, tuple[float, float]], matched_only: bool = True, top_only: bool = True, maxima: Mapping[str, float] | None = None, flagged: list | None = None) -> Column:
    """Rows within all limits; a limit over a score's whole range is none; null never passes."""
    out = F.lit(True)
    for c in conditions(limits, maxima):
        out = out & F.expr(c)
    if matched_only:
        out = out & F.col("matched")
    if top_only:
        out = out & (F.col("match_rank") == 1)
    if flagged:
        out = out & ~F.col("input_id").isin(flagged)
    return F.coalesce(out, F.lit(False))


def conditions(limits: Mapping[str, tuple[float, float]], maxima: Mapping[str, float] | None = None) -> list[str]:
    out = []
    for name, (low, high) in limits.items():
        if low > 0:
            out.append(f"{name} >= {low:g}")
        if maxima is None or high < maxima.get(name, 100):
            out.append(f"{name} <= {high:g}")
    return out


def filter_code(limits: Mapping[str, tuple[float, float]], maxima: Mapping[str, float] | None = None, inside: bool = True, dialect: str = "sql") -> str:
    """The filter as text, to be pasted: dialect sql or pyspark; the outside is what the inside does not accept."""
    text = " AND ".join(conditions(limits, maxima)) or "TRUE"
    sql = text if inside else f"NOT coalesce({text}, FALSE)"
    return f"WHERE {sql}" if dialect == "sql" else f'df.where("{sql}")'


def difference(a: str | None, b: str | None, by: str = "word") -> str:
    """HTML of b against a with insertions and deletions marked."""
    x, y = ((a or "").split(), (b or "").split()) if by == "word" else (list(a or ""), list(b or ""))
    gap, out = (" " if by == "word" else ""), []
    for op, i, j, k, l in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        old, new = html.escape(gap.join(x[i:j])), html.escape(gap.join(y[k:l]))
        out += [new] if op == "equal" else ([f"<del>{old}</del>"] if old else []) + ([f"<ins>{new}</ins>"] if new else [])
    return gap.join(out)


def difference_page(rows: DataFrame, a: str, b: str, path: str, title: str = "Differences") -> int:
    """Writes a static page with one line per row, read row by row; returns the number of lines."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><style>del{{background:#fdd}}ins{{background:#dfd}}</style><table><tr><th>{a}<th>{b}<th>difference")
        for n, row in enumerate(rows.select(a, b).toLocalIterator(), 1):
            f.write(f"<tr><td>{html.escape(row[0] or '')}<td>{html.escape(row[1] or '')}<td>{difference(row[0], row[1])}")
        f.write("</table>")
    return n


def reliability(results: DataFrame, p: str, y: str) -> DataFrame:
    """Ten bins of predicted probability: n, mean prediction and mean outcome."""
    return results.groupBy(F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def median_metres(pairs: DataFrame, here: tuple[str, str], there: tuple[str, str], *by: str) -> DataFrame:
    """Per group the median distance of two points (longitude, latitude) and how many pairs have both."""
    from waymark.operators.geo import metres_apart

    apart = metres_apart(*[F.col(c) for c in (*here, *there)])
    return pairs.groupBy(*by).agg(F.median(apart).alias("median_metres"), F.count(apart).alias("n"))
