"""DuckDB SQL of the scoring rules, assembled from small pieces; used only to check the Spark queries."""

from __future__ import annotations

from waymark.plans.fixture import PREFIX


def factor(a: str, b: str) -> str:
    """The similarity factor of two names."""
    jw, dl = f"jaro_winkler_similarity({a}, {b})", f"damerau_levenshtein({a}, {b})"
    ramp = f"(0.05::DOUBLE + 0.95::DOUBLE * pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({jw} - 0.6::DOUBLE) / 0.4::DOUBLE)), 2))"
    edit = f"(1.0::DOUBLE - {dl}::DOUBLE / greatest(1, octet_length(encode({a})), octet_length(encode({b}))))"
    word = lambda x, w: f"CASE WHEN regexp_matches({x}, '(^| ){w}( |$)') THEN 1 ELSE 0 END"
    axis = lambda p, m: f"(({word(a, p)}) - ({word(a, m)})) * (({word(b, p)}) - ({word(b, m)})) = -1"
    opposed = f"CASE WHEN {axis('NORTH', 'SOUTH')} OR {axis('EAST', 'WEST')} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 0.5::DOUBLE * {ramp} + 0.5::DOUBLE * pow({edit}, 2)) * {opposed} END)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(upper(trim(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def even(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE), 0) AS INT)"


def postcode(w: float, a: str = "in_postcode", b: str = "postcode") -> str:
    pa, pb = f"lpad(CAST({a} AS VARCHAR), 4, '0')", f"lpad(CAST({b} AS VARCHAR), 4, '0')"
    p = lambda x, k: f"substr({x}, {k}, 1)"
    swap = (
        f"({p(pa, 1)} = {p(pb, 1)} AND (({p(pa, 2)} = {p(pb, 3)} AND {p(pa, 3)} = {p(pb, 2)} AND {p(pa, 4)} = {p(pb, 4)}) "
        f"OR ({p(pa, 2)} = {p(pb, 2)} AND {p(pa, 3)} = {p(pb, 4)} AND {p(pa, 4)} = {p(pb, 3)})))"
    )
    t = lambda f: even(f"{w} * {f}::DOUBLE")
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} NOT BETWEEN 0 AND 9999 OR {b} NOT BETWEEN 0 AND 9999 THEN 0 WHEN {a} = {b} THEN {t(1)} WHEN abs({a} - {b}) = 1 THEN {t(0.7)} "
        f"WHEN abs({a} - {b}) = 2 THEN {t(0.4)} WHEN abs({a} - {b}) = 3 THEN {t(0.2)} WHEN {swap} THEN {t(0.4)} ELSE 0 END"
    )


def name(w: float, sim: str) -> str:
    full = int(round(w))
    return f"CASE WHEN {sim} = 0 THEN 0 WHEN {sim} = 1 THEN {full} ELSE least({max(0, full - 1)}, {even(f'{w}::DOUBLE * {sim}')}) END"


NUMBER_CREDIT = """(CASE WHEN in_number_first IS NULL OR number_first IS NULL OR coalesce(in_number_last, in_number_first) < in_number_first OR coalesce(number_last, number_first) < number_first THEN 0.0
 WHEN in_number_first = number_first AND coalesce(in_number_last, in_number_first) = coalesce(number_last, number_first) THEN 1.0
 WHEN number_first <= in_number_first AND coalesce(number_last, number_first) >= coalesce(in_number_last, in_number_first) THEN 0.7
 WHEN in_number_first <= number_first AND coalesce(in_number_last, in_number_first) >= coalesce(number_last, number_first) THEN 0.5
 WHEN number_first <= coalesce(in_number_last, in_number_first) AND coalesce(number_last, number_first) >= in_number_first THEN 0.3 ELSE 0.0 END)"""
TYPE_CREDIT = "(CASE WHEN coalesce(in_street_type, '') = '' OR coalesce(street_type, '') = '' THEN 0.5 WHEN in_street_type = street_type THEN 1.0 ELSE 0.4 END)"
FLAT_CREDIT = "(CASE WHEN coalesce(in_flat_number, '') = '' AND coalesce(flat_number, '') = '' THEN 1.0 WHEN in_flat_number = flat_number THEN 1.0 WHEN coalesce(in_flat_number, '') = '' OR coalesce(flat_number, '') = '' THEN 0.5 ELSE 0.0 END)"
GATE = "(number_first = in_number_first OR (number_first <= coalesce(in_number_last, in_number_first) AND coalesce(number_last, number_first) >= in_number_first))"
IDENTITY = """(in_number_first IS NOT NULL AND number_first IS NOT NULL AND in_number_first <= coalesce(in_number_last, in_number_first) AND number_first <= coalesce(number_last, number_first)
 AND in_number_first = number_first AND coalesce(in_number_last, in_number_first) = coalesce(number_last, number_first) AND in_street_name = street_name AND in_locality = locality_name
 AND in_state = state AND (in_street_type IS NULL OR in_street_type = coalesce(street_type, '')) AND coalesce(in_flat_number, '') = coalesce(flat_number, '') AND coalesce(in_flat_type, '') = coalesce(flat_type, ''))"""
DEFAULTS = {"postcode": 12, "suburb": 12, "street_name": 16, "street_type": 10, "number": 30, "flat": 20}


def pairs(on: str, extra: str = "", name_: str = "pair") -> str:
    """A common table expression of pairs with similarities."""
    return (
        f"{name_} AS (SELECT i.*, r.*{extra} FROM addr_in i JOIN addr_ref r ON {on}),\n"
        f"{name_}_loc AS (SELECT DISTINCT {norm('in_locality')} AS a, {norm('locality_name')} AS b FROM {name_}), {name_}_str AS (SELECT DISTINCT {norm('in_street_name')} AS a, {norm('street_name')} AS b FROM {name_}),\n"
        f"{name_}_l AS (SELECT a, b, {factor('a', 'b')} AS s FROM {name_}_loc), {name_}_s AS (SELECT a, b, {factor('a', 'b')} AS s FROM {name_}_str),\n"
        f"{name_}_sim AS (SELECT p.*, l.s AS suburb_similarity, s.s AS street_similarity, CASE WHEN s.s = 0 THEN 1.0::DOUBLE ELSE s.s END AS street_gate FROM {name_} p\n"
        f" JOIN {name_}_l l ON l.a = {norm('in_locality')} AND l.b = {norm('locality_name')} JOIN {name_}_s s ON s.a = {norm('in_street_name')} AND s.b = {norm('street_name')})"
    )


def scores(w: dict[str, float] = DEFAULTS) -> str:
    return (
        f"{postcode(w['postcode'])} AS score_postcode, {name(w['suburb'], 'suburb_similarity')} AS score_suburb, {name(w['street_name'], 'street_similarity')} AS score_street_name, "
        f"{even(f'{w["street_type"]}::DOUBLE * {TYPE_CREDIT}::DOUBLE')} AS score_street_type, {even(f'{w["number"]}::DOUBLE * {NUMBER_CREDIT}::DOUBLE * street_gate')} AS score_number, "
        f"{even(f'{w["flat"]}::DOUBLE * {FLAT_CREDIT}::DOUBLE * street_gate')} AS score_flat"
    )


TOTAL = "CAST(score_postcode + score_suburb + score_street_name + score_street_type + score_number + score_flat AS INT)"
RANK = "row_number() OVER (PARTITION BY input_id ORDER BY CASE WHEN match_basis = 'exact_components' THEN 0 ELSE 1 END, total_score DESC, number_distance ASC NULLS LAST, address_detail_pid)"


def matched(on: str, least: int = 60, w: dict[str, float] = DEFAULTS) -> str:
    """PREFIX and a table ``ranked`` of all pairs of a block with scores and rank."""
    basis = f"CASE WHEN {IDENTITY} AND in_postcode = postcode THEN 'exact_components' ELSE 'weighted' END"
    return f"""{PREFIX},
{pairs(on)},
scored AS (SELECT *, {scores(w)}, abs(number_first - in_number_first) AS number_distance, {basis} AS match_basis FROM pair_sim),
total AS (SELECT *, {TOTAL} AS total_score FROM scored),
ranked AS (SELECT *, {RANK} AS match_rank FROM total WHERE total_score >= {least})"""
