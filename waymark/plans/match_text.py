"""Matching free text: exact-label index, parser, locality recovery, cache, then the cascade, with results for all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.parser import parse_addresses, split_untyped
from waymark.functions.vocab import StreetTypes
from waymark.operators import indexes, localities, scoring
from waymark.operators.scoring import ADDRESS_COLUMNS, PARSED_COLUMNS
from waymark.plans.lineage import cut
from waymark.plans.matcher import SCORES, MatchOptions, match_parsed
from waymark.sources import cache as match_cache
from waymark.sources.store import Store

KEPT = ["match_rank", "match_basis", "total_score", *SCORES, "number_distance", *ADDRESS_COLUMNS]


def recovered(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Parsed rows with localities that a comma-less line lost to its street."""
    found = localities.recovered_localities(parsed, index).select("input_id", "locality", "street_left")
    types = StreetTypes.common().canonical
    out = parsed.join(found, "input_id", "left")
    hit = F.col("locality").isNotNull()
    words = F.split("street_left", " ")
    literal = F.create_map(*[F.lit(x) for p in sorted(types.items()) for x in p])
    kind = F.try_element_at(literal, F.element_at(words, -1))
    name = F.when(kind.isNotNull() & (F.size(words) > 1), F.concat_ws(" ", F.slice(words, F.lit(1), F.size(words) - 1))).otherwise(F.col("street_left"))
    return out.withColumns({
        "in_locality": F.when(hit, F.col("locality")).otherwise(F.col("in_locality")), "in_street_type": F.when(hit, F.when(F.size(words) > 1, kind)).otherwise(F.col("in_street_type")), "in_street_suffix": F.when(~hit, F.col("in_street_suffix")),
        "in_street_name": F.when(hit, F.nullif(name, F.lit(""))).otherwise(F.col("in_street_name")),
    }).drop("locality", "street_left")


def perfect(hits: DataFrame, ref: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Index hits as full matches: every component counts in full."""
    full = {f"score_{c}": int(round(w)) for c, w in scoring.checked_weights(weights).items()}
    values = {**{k: F.lit(v) for k, v in full.items()}, "total_score": F.lit(sum(full.values())), "match_rank": F.lit(1), "match_basis": F.lit("exact_components"), "number_distance": F.lit(0)}
    return hits.join(ref, "address_detail_pid").withColumns(values).select("input_id", *KEPT)


def match_addresses(inputs: DataFrame, ref: DataFrame, options: MatchOptions | None = None, exact: DataFrame | None = None, cached: DataFrame | None = None, types: StreetTypes | None = None, index: DataFrame | None = None, untyped: DataFrame | None = None) -> DataFrame:
    """inputs: input_id, input_raw. exact: an exact-label index; cached: match-cache entries. All inputs come back."""
    options = options or MatchOptions()
    ref = scoring.with_columns(ref, scoring.ADDRESS_SCHEMA).select(*ADDRESS_COLUMNS)
    places = localities.locality_index(ref) if index is None else index
    use_index = options.max_results == 1 and (options.alias_types is None or None in options.alias_types)
    hits = None
    if use_index:
        exact = indexes.exact_index(ref.where("source IS NULL OR source <> 'custom'"), types) if exact is None else exact
        custom = ref.where("source = 'custom'") if options.include_custom else None
        hits = cut(indexes.exact_lookup(inputs, exact, custom=custom))
    parsed = recovered(parse_addresses(inputs, types=types), places) if options.locality_fallback else parse_addresses(inputs, types=types)
    parsed = parsed.withColumn("input_standardised", textnorm.standardised(F.col))
    parsed = cut(parsed)
    rest = parsed
    done = None
    if hits is not None:
        done = perfect(hits.select("input_id", "address_detail_pid"), ref, options.weights)
        rest = rest.join(hits.select("input_id"), "input_id", "left_anti")
    if cached is not None and options == MatchOptions(min_score=options.min_score):
        known = match_cache.lookup(rest.select("input_id", "input_standardised"), cached)
        again = known.join(ref, "address_detail_pid").withColumns({"match_rank": F.lit(1), "match_basis": F.lit("weighted"), "number_distance": F.lit(None).cast("int")}).select("input_id", *KEPT)
        done = again if done is None else done.unionByName(again)
        rest = rest.join(known.select("input_id"), "input_id", "left_anti")
    split = split_untyped(ref, types) if untyped is None else untyped
    matched = match_parsed(rest, ref, options, places, types, split)
    if done is None:
        return inputs.select("input_id", "input_raw").join(matched, "input_id")
    extra = [c for c in matched.columns if c not in ("input_id", "input_standardised", "matched", "match_status", *PARSED_COLUMNS, *KEPT)]
    fast = parsed.select("input_id", "input_standardised", *PARSED_COLUMNS).join(done, "input_id").withColumns({"matched": F.lit(True), "match_status": F.lit("matched")})
    both = matched.drop(*extra).unionByName(fast.select(*[c for c in matched.columns if c not in extra]))
    if options.return_linked or options.resolve_principal:
        from waymark.plans.matcher import with_links, with_principal

        if options.return_linked:
            both = with_links(both, ref, {"principal": "principal_pid", "primary": "primary_pid"}[options.return_linked])
        if options.resolve_principal:
            both = with_principal(both, ref)
    return inputs.select("input_id", "input_raw").join(both, "input_id")


def match_store(store: Store, inputs: DataFrame, options: MatchOptions | None = None, use_cache: bool = True, geographies: list[str] | None = None) -> DataFrame:
    """Matches against a store with its index and cache; new good matches are remembered."""
    options = options or MatchOptions()
    cached = store.table("match_cache") if use_cache and options == MatchOptions() else None
    result = match_addresses(inputs, store.reference(options.include_custom), options, store.exact_index(), cached, store.types, untyped=store.table("street_split"))
    if cached is not None:
        result = cut(result)
        match_cache.remember(store, result)
    return store.join_geographies(result, geographies) if geographies else result
