"""The six score components of an (input, candidate) pair, as Column expressions, and what is derived from them.

Input columns start with ``in_``; candidates have the columns of ``ADDRESS_COLUMNS``. Similarities come in as the columns
``suburb_similarity`` and ``street_similarity``, made once per distinct pair of names. Every component is rounded once,
half to even, with the street gate inside the rounding.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.metrics import with_factors
from waymark.functions.vocab import DIRECTIONS, LEVEL_TYPES, StreetTypes, inverted, mapped, score_flat_types

COMPONENTS = ("postcode", "suburb", "street_name", "street_type", "number", "flat")
DEFAULT_WEIGHTS = dict(zip(COMPONENTS, (12, 12, 16, 10, 30, 20)))
ADDRESS_SCHEMA = (
    "address_detail_pid string, address_label string, address_site_name string, building_name string, flat_type string, flat_number string, level_type string, level_number string, "
    "number_first int, number_last int, lot_number string, street_name string, street_type string, street_suffix string, locality_name string, state string, postcode int, longitude double, "
    "latitude double, source string, alias_type string, date_created date, legal_parcel_id string, mb_code string, alias_principal string, principal_pid string, primary_secondary string, "
    "primary_pid string, geocode_type string"
)
ADDRESS_COLUMNS = [x.split()[0] for x in ADDRESS_SCHEMA.split(", ")]
PARSED_SCHEMA = (
    "in_postcode int, in_state string, in_locality string, in_street_name string, in_street_type string, in_street_suffix string, in_number_first int, in_number_last int, in_number_suffix string, "
    "in_flat_type string, in_flat_number string, in_level_type string, in_level_number string, in_lot_number string, in_building_name string"
)
PARSED_COLUMNS = [x.split()[0] for x in PARSED_SCHEMA.split(", ")]


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """Adds the columns of a schema that a frame lacks, as nulls."""
    kinds = dict(x.split() for x in schema.split(", "))
    return df.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in kinds if c not in df.columns])


def checked_weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    """The six weights; they must be named, finite, not negative and add up to 100."""
    weights = dict(DEFAULT_WEIGHTS if weights is None else weights)
    if set(weights) != set(COMPONENTS):
        raise ValueError(f"weights must be named {', '.join(COMPONENTS)}")
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or abs(sum(weights.values()) - 100) > 1e-8:
        raise ValueError("weights must be finite, not negative and add up to 100")
    return weights


def half_even(x: Column) -> Column:
    return F.rint(x.cast("double")).cast("int")


def label_token(label: Column, street: Column) -> Column:
    """The house number before the street name in a label, such as 10A or 10A-14; '' where there is none."""
    label = F.regexp_replace(textnorm.value(label), r"\bLOT [0-9]+[A-Z]?\b", " ")
    street = textnorm.value(street)
    at = F.instr(label, F.concat(F.lit(" "), street))
    before = F.substring(label, F.lit(1), F.greatest(at, F.lit(0)))
    return F.when(F.coalesce((street != "") & (at > 0) & label.rlike("[0-9]"), F.lit(False)), F.regexp_extract(before, r"(?:^|[ /])([0-9]+[A-Z]?(?:-[0-9]+[A-Z]?)?) *$", 1)).otherwise("")


def prepared(ref: DataFrame, types: StreetTypes | None = None, untyped: DataFrame | None = None) -> DataFrame:
    """A reference table with what scoring needs of a candidate, made once per row instead of once per pair.

    untyped: (street_name, effective_name, effective_type), the split of street names that hold their type.
    """
    table = (types or StreetTypes.common()).canonical
    ref = with_columns(ref, ADDRESS_SCHEMA)
    if untyped is not None:
        split = untyped.select(F.col("street_name").alias("_s"), "effective_name", "effective_type")
        ref = ref.join(split, ref.street_type.isNull() & (ref.street_name == F.col("_s")), "left").drop("_s")
    else:
        ref = ref.withColumns({"effective_name": F.lit(None).cast("string"), "effective_type": F.lit(None).cast("string")})
    # with a stored type the split does not apply
    eff_name = F.coalesce(F.when(F.col("street_type").isNull(), F.col("effective_name")), F.col("street_name"))
    eff_type = F.coalesce(F.col("street_type"), F.col("effective_type"))
    token = label_token(F.col("address_label"), F.col("street_name"))
    return ref.withColumns({
        "c_name": textnorm.name(eff_name), "c_locality": textnorm.name(F.col("locality_name")), "c_type": mapped(textnorm.value(eff_type), table), "c_direction": mapped(textnorm.value(F.col("street_suffix")), inverted(DIRECTIONS)),
        "c_flat_type": mapped(textnorm.value(F.col("flat_type")), score_flat_types()), "c_flat": textnorm.identifier(F.col("flat_number")), "c_level_type": mapped(textnorm.value(F.col("level_type")), inverted(LEVEL_TYPES)),
        "c_level": textnorm.identifier(F.col("level_number")), "c_lot": textnorm.identifier(F.col("lot_number")), "c_building": textnorm.name(F.col("building_name")),
        "c_token": token, "c_suffix": F.regexp_extract(token, "^[0-9]+([A-Z])", 1), "c_token_number": F.nullif(F.regexp_extract(token, "^([0-9]+)", 1), F.lit("")).try_cast("int"),
    }).drop("effective_name", "effective_type")


def prepared_inputs(inputs: DataFrame, types: StreetTypes | None = None) -> DataFrame:
    """Inputs with the same normal forms."""
    table = (types or StreetTypes.common()).canonical
    inputs = with_columns(inputs, PARSED_SCHEMA)
    col = F.col
    return inputs.withColumns({
        "i_name": textnorm.name(col("in_street_name")), "i_locality": textnorm.name(col("in_locality")), "i_type": mapped(textnorm.value(col("in_street_type")), table), "i_direction": mapped(textnorm.value(col("in_street_suffix")), inverted(DIRECTIONS)),
        "i_flat_type": mapped(textnorm.value(col("in_flat_type")), score_flat_types()), "i_flat": textnorm.identifier(col("in_flat_number")), "i_level_type": mapped(textnorm.value(col("in_level_type")), inverted(LEVEL_TYPES)),
        "i_level": textnorm.identifier(col("in_level_number")), "i_lot": textnorm.identifier(col("in_lot_number")), "i_building": textnorm.name(col("in_building_name")), "i_suffix": textnorm.value(col("in_number_suffix")),
    })


#: What scoring, ranking and linking read of a pair; wide columns are joined again after ranking.
PAIR_COLUMNS = (
    "input_id", "address_detail_pid", "source", "alias_type", "principal_pid", "in_postcode", "postcode", "in_state", "state", "in_number_first", "in_number_last", "number_first", "number_last",
    *(f"{side}_{x}" for side in "ic" for x in ("name", "locality", "type", "direction", "flat_type", "flat", "level_type", "level", "lot", "building", "suffix")),
)


#: The names that each similarity compares.
COMPARED = {"suburb_similarity": ("i_locality", "c_locality"), "street_similarity": ("i_name", "c_name")}
SIMILARITIES = tuple(COMPARED)


def with_gate(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("street_gate", F.when(F.col("street_similarity") == 0, 1.0).otherwise(F.col("street_similarity")))


def with_similarities(pairs: DataFrame) -> DataFrame:
    """Adds suburb_similarity, street_similarity and the street gate, where the pairs are made: nothing is shuffled."""
    pairs = pairs.select(*[c for c in PAIR_COLUMNS if c in pairs.columns])
    return with_gate(with_factors(pairs, COMPARED))


def postcode_score(w: float, a: Column, b: Column) -> Column:
    pa, pb = (F.lpad(x.cast("string"), 4, "0") for x in (a, b))
    at = lambda x, k: F.substring(x, k, 1)
    swap = (at(pa, 1) == at(pb, 1)) & (
        ((at(pa, 2) == at(pb, 3)) & (at(pa, 3) == at(pb, 2)) & (at(pa, 4) == at(pb, 4))) | ((at(pa, 2) == at(pb, 2)) & (at(pa, 3) == at(pb, 4)) & (at(pa, 4) == at(pb, 3)))
    )
    tier = lambda f: F.lit(int(round_even(w * f)))
    gap = F.abs(a - b)
    return (
        F.when(a.isNull() | b.isNull() | ~a.between(0, 9999) | ~b.between(0, 9999), F.lit(0)).when(gap == 0, tier(1)).when(gap == 1, tier(0.7))
        .when(gap == 2, tier(0.4)).when(gap == 3, tier(0.2)).when(swap, tier(0.4)).otherwise(F.lit(0)).cast("int")
    )


def round_even(x: float) -> float:
    return float(round(x))  # Python rounds half to even


def name_score(w: float, similarity: Column) -> Column:
    full = int(round_even(w))
    return F.when(similarity == 0, F.lit(0)).when(similarity == 1, F.lit(full)).otherwise(F.least(F.lit(max(0, full - 1)), half_even(F.lit(float(w)) * similarity))).cast("int")


def type_credit(col=F.col) -> Column:
    blank = (col("i_type") == "") | (col("c_type") == "")
    kind = F.when(blank, 0.5).when(col("i_type") == col("c_type"), 1.0).otherwise(0.4)
    way = F.when(col("i_direction") == col("c_direction"), 1.0).when((col("i_direction") == "") | (col("c_direction") == ""), 0.5).otherwise(0.0)
    return kind * way


def number_credit(col=F.col) -> Column:
    a, b = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    c, d = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    interval = (
        F.when(a.isNull() | c.isNull() | (b < a) | (d < c), 0.0).when((a == c) & (b == d), 1.0).when((c <= a) & (d >= b), 0.7).when((a <= c) & (b >= d), 0.5).when((c <= b) & (d >= a), 0.3).otherwise(0.0)
    )
    suffix = F.when(col("i_suffix") == col("c_suffix"), 1.0).when((col("i_suffix") == "") | (col("c_suffix") == ""), 0.5).otherwise(0.0)
    return F.when(a.isNull() & (col("i_lot") != ""), F.when(col("i_lot") == col("c_lot"), 1.0).otherwise(0.0)).otherwise(interval * suffix)


def flat_credit(col=F.col) -> Column:
    def dimension(i: str, c: str, it: str, ct: str) -> Column:
        conflict = (col(it) != "") & (col(ct) != "") & (col(it) != col(ct))
        return F.when((col(i) == col(c)) & ~conflict, 1.0).when((col(i) == col(c)) | (col(i) == "") | (col(c) == ""), 0.5).otherwise(0.0)

    unit, level = dimension("i_flat", "c_flat", "i_flat_type", "c_flat_type"), dimension("i_level", "c_level", "i_level_type", "c_level_type")
    has_unit, has_level = (col("i_flat") != "") | (col("c_flat") != ""), (col("i_level") != "") | (col("c_level") != "")
    return F.when(has_unit & has_level, 0.6 * unit + 0.4 * level).when(has_unit, unit).when(has_level, level).otherwise(1.0)


#: The credits of a pair that no name decides.
CREDITS = {"street_type": type_credit, "number": number_credit, "flat": flat_credit}


#: What of a pair's comparison is known of few contents of its two sides: the columns of either.
KNOWN = {
    **{name: ((a,), (b,)) for name, (a, b) in COMPARED.items()},
    "credit_street_type": (("i_type", "i_direction"), ("c_type", "c_direction")),
    "credit_flat": tuple(tuple(f"{side}_{x}" for x in ("flat", "flat_type", "level", "level_type")) for side in "ic"),
}


#: All that scores, basis and distance read of a pair, as KNOWN.
CONTENTS = KNOWN | {
    "number": (("in_number_first", "in_number_last", "i_suffix", "i_lot"), ("number_first", "number_last", "c_suffix", "c_lot")),
    "place": (("in_postcode", "in_state"), ("postcode", "state")), "building": (("i_building",), ("c_building",)),
}


def compared(pairs: DataFrame, name: str) -> DataFrame:
    """Adds one of KNOWN."""
    return with_factors(pairs, {name: COMPARED[name]}) if name in COMPARED else pairs.withColumn(name, CREDITS[name.removeprefix("credit_")]())


def scored(pairs: DataFrame, weights: Mapping[str, float] | None = None, gate: bool = True) -> DataFrame:
    """Adds the six scores and total_score; pairs has the similarities, and may have the credits."""
    w = checked_weights(weights)
    credit = {c: F.col(f"credit_{c}") if f"credit_{c}" in pairs.columns else of() for c, of in CREDITS.items()}
    factor = F.col("street_gate") if gate else F.lit(1.0)
    scores = {
        "score_postcode": postcode_score(w["postcode"], F.col("in_postcode"), F.col("postcode")), "score_suburb": name_score(w["suburb"], F.col("suburb_similarity")),
        "score_street_name": name_score(w["street_name"], F.col("street_similarity")), "score_street_type": half_even(F.lit(float(w["street_type"])) * credit["street_type"]),
        "score_number": half_even(F.lit(float(w["number"])) * credit["number"] * factor), "score_flat": half_even(F.lit(float(w["flat"])) * credit["flat"] * factor),
    }
    return pairs.withColumns(scores).withColumn("total_score", sum((F.col(c) for c in scores), F.lit(0)).cast("int"))


def names_may_reach(weights: Mapping[str, float], least: int) -> Column:
    """May_reach of two pairs of names alone: all that they do not decide counts in full."""
    w = checked_weights(weights)
    bound = F.lit(int(round_even(w["postcode"])) + math.ceil(w["street_type"])) + name_score(w["suburb"], F.col("suburb_similarity")) + name_score(w["street_name"], F.col("street_similarity"))
    for c in ("number", "flat"):
        bound += F.ceil(F.lit(float(w[c])) * F.col("street_gate"))
    return bound >= least


def may_ever_reach(weights: Mapping[str, float], least: int) -> Column:
    """As may_reach, before names are compared: equal names count in full, blank ones nothing, others a point less."""
    w = checked_weights(weights)

    def at_most(weight: float, a: str, b: str) -> Column:
        full = int(round_even(weight))
        return F.when((F.col(a) == "") | (F.col(b) == ""), 0).when(F.col(a) == F.col(b), full).otherwise(max(0, full - 1))

    bound = postcode_score(w["postcode"], F.col("in_postcode"), F.col("postcode")) + at_most(w["suburb"], "i_locality", "c_locality") + at_most(w["street_name"], "i_name", "c_name")
    for weight, credit in (("street_type", type_credit()), ("number", number_credit()), ("flat", flat_credit())):
        bound += F.ceil(F.lit(float(w[weight])) * credit)
    return bound >= least


def may_reach(weights: Mapping[str, float], least: int) -> Column:
    """Whether a pair's upper bound reaches a total: a cheap filter before the full scores."""
    w = checked_weights(weights)
    bound = postcode_score(w["postcode"], F.col("in_postcode"), F.col("postcode")) + name_score(w["street_name"], F.col("street_similarity"))
    bound += F.lit(math.ceil(w["suburb"]) + math.ceil(w["street_type"])) + F.ceil(F.lit(math.ceil(w["number"]) + math.ceil(w["flat"])) * F.col("street_gate")) + 1
    return bound >= least


def identity_parts(col=F.col) -> dict[str, Column]:
    """What identity demands, by the contents it is of, as CONTENTS has them; the postcode is not part of it."""

    def if_supplied(i: str, c: str) -> Column:
        return (col(i) == "") | (col(i) == col(c))

    def equal(*names: str) -> Column:
        out = F.lit(True)
        for x in names:
            out = out & (col(f"i_{x}") == col(f"c_{x}"))
        return out

    a, b = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    c, d = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    return {
        "number": a.isNotNull() & c.isNotNull() & (a <= b) & (c <= d) & (a == c) & (b == d) & equal("suffix") & if_supplied("i_lot", "c_lot"),
        "street_similarity": (col("i_name") != "") & equal("name"), "suburb_similarity": (col("i_locality") != "") & equal("locality"),
        "place": (textnorm.value(col("in_state")) == "") | (textnorm.value(col("in_state")) == textnorm.value(col("state"))), "building": if_supplied("i_building", "c_building"),
        "credit_street_type": if_supplied("i_type", "c_type") & equal("direction"), "credit_flat": equal("flat", "flat_type", "level", "level_type"),
    }


def identity(col=F.col) -> Column:
    """Whether input and candidate are the same address but for the postcode."""
    out = F.lit(True)
    for part in identity_parts(col).values():
        out = out & part
    return F.coalesce(out, F.lit(False))


#: Equalities that identity() demands, as join keys: with them only identical numbers, names and units meet.
IDENTITY_KEYS = [("i_name", "c_name"), ("i_locality", "c_locality"), ("in_number_first", "number_first"), ("i_flat", "c_flat")]


def number_distance(col=F.col) -> Column:
    return F.abs(col("number_first") - col("in_number_first")).cast("int")
