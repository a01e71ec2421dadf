"""The match cascade: block, score, rank, then fall back, as one lazy plan per path.

Paths: postcode block; state block for inputs without postcode; identity across postcodes; other postcodes of the
locality; street without the number gate; street-only rows. Each later path sees the inputs whose best score so far does
not exceed the fallback threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.vocab import StreetTypes
from waymark.operators import blocking, localities, matrices, scoring
from waymark.operators.scoring import ADDRESS_COLUMNS, COMPONENTS, PARSED_COLUMNS
from waymark.plans.lineage import cut, small_methods

SCORES = [f"score_{c}" for c in COMPONENTS]
#: What the cascade keeps of a scored pair.
FOUND = ["input_id", "address_detail_pid", "source", "match_basis", "total_score", *SCORES, "number_distance"]


@dataclass(frozen=True)
class MatchOptions:
    max_results: int = 1
    min_score: int = 60
    fallback_threshold: int = 90
    weights: Mapping[str, float] = field(default_factory=lambda: dict(scoring.DEFAULT_WEIGHTS))
    alias_types: list | None = None
    include_custom: bool = True
    locality_fallback: bool = True
    street_fallback: bool = True
    street_only: bool = False
    resolve_principal: bool = False
    return_linked: str | None = None  # "principal" or "primary"

    def __post_init__(self) -> None:
        scoring.checked_weights(self.weights)
        if not isinstance(self.max_results, int) or self.max_results < 1:
            raise ValueError("max_results must be a positive integer")
        for name in ("min_score", "fallback_threshold"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must lie between 0 and 100")
        if self.return_linked not in (None, "principal", "primary"):
            raise ValueError("return_linked must be principal or primary")


def order() -> list:
    return [(F.col("match_basis") == "exact_components").desc(), F.col("total_score").desc(), F.col("number_distance").asc_nulls_last(), F.col("address_detail_pid")]


def ranked(pairs: DataFrame, max_results: int | None) -> DataFrame:
    """One row per (input, address), and the best few of each input with their match_rank: one shuffle, by the input."""
    pairs = pairs.repartition("input_id")
    once = Window.partitionBy("input_id", "address_detail_pid").orderBy(*order(), F.when(F.col("source") == "custom", 1).otherwise(0))
    out = pairs.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    out = out.withColumn("match_rank", F.row_number().over(Window.partitionBy("input_id").orderBy(*order())))
    return out if max_results is None else out.where(F.col("match_rank") <= max_results)


def score_path(pairs: DataFrame, options: MatchOptions, prune: bool = True) -> DataFrame:
    """Pairs with scores of at least min_score, their basis and number distance; names that have their similarities are
    not compared again."""
    if set(scoring.SIMILARITIES) <= set(pairs.columns):
        pairs = scoring.with_gate(pairs.select(*[c for c in (*scoring.PAIR_COLUMNS, *scoring.SIMILARITIES, *(f"credit_{x}" for x in scoring.CREDITS)) if c in pairs.columns]))
    else:
        if prune:
            pairs = pairs.where(scoring.may_ever_reach(options.weights, int(options.min_score)))
        pairs = scoring.with_similarities(pairs)
        if prune:
            pairs = pairs.where(scoring.may_reach(options.weights, int(options.min_score)))
    same = scoring.identity() & (F.col("in_postcode") == F.col("postcode"))
    basis = F.when(F.coalesce(same, F.lit(False)), "exact_components").otherwise("weighted")
    # rand() keeps the filter here: as a condition of the join it would compute all scores, which are then computed again
    pairs = scoring.scored(pairs, options.weights).where(F.when(F.rand(0) < 2, F.col("total_score")) >= int(options.min_score))
    return pairs.withColumns({"match_basis": basis, "number_distance": scoring.number_distance()})


#: Pairs of names that are always compared block by block; more of them only if they are fewer than the pairs of equal number.
NAMES = 1 << 20


def names_of_blocks(inputs: DataFrame, ref: DataFrame, keys: list[tuple[str, str]], gate: bool, least: int | None, weights: Mapping[str, float]) -> DataFrame | None:
    """Per block the (street, locality) of inputs and candidates with their similarities, that can reach least at all:
    the keys of the inputs, i_name, i_locality, _name, _locality. None where comparing pairs is less work."""
    mine, theirs = (list(dict.fromkeys(x)) for x in zip(*keys))
    a = cut(inputs.select(*dict.fromkeys([*mine, "i_name", "i_locality"])).distinct())
    b = cut(ref.select(*dict.fromkeys([*theirs, "c_name", "c_locality"])).distinct())
    on = lambda x, y: [F.col(f"{x}.{m}") == F.col(f"{y}.{t}") for m, t in keys]

    def meets(left: DataFrame, right: DataFrame, more: list[tuple[str, str]]) -> int:
        every = [*keys, *more]
        n = left.groupBy(*dict.fromkeys(m for m, _ in every)).agg(F.count("*").alias("n")).alias("x").join(right.groupBy(*dict.fromkeys(t for _, t in every)).agg(F.count("*").alias("k")).alias("y"), [F.col(f"x.{m}") == F.col(f"y.{t}") for m, t in every])
        return int(n.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("k"))).first()[0] or 0)

    n = meets(a, b, [])
    if n > NAMES and n > meets(inputs, ref, [("in_number_first", "number_first")] if gate else []):
        return None
    both = a.alias("x").join(b.alias("y"), on("x", "y"))
    both = scoring.with_factors(both, scoring.COMPARED)
    both = both.select(*dict.fromkeys([*mine, "i_name", "i_locality"]), F.col("c_name").alias("_name"), F.col("c_locality").alias("_locality"), *scoring.SIMILARITIES)
    return cut(both if least is None else scoring.with_gate(both).where(scoring.names_may_reach(weights, least)).drop("street_gate"))


#: Pairs of distinct contents that are all compared beforehand and looked up where pairs are made; more are compared there.
LOOKED_UP = 1 << 18


def with_known(inputs: DataFrame, ref: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame], wanted: Sequence[str] = tuple(scoring.KNOWN)) -> DataFrame | None:
    """pairs(inputs, ref) with the wanted of KNOWN, and nulls for other similarities, without Python on pairs: the contents of a
    side get numbers, and a pair looks up its two numbers in a table of all pairs of contents, which is sent to all tasks. None
    where names have more than LOOKED_UP pairs; other contents are then left to be compared with the pair. The sides should be
    written ones."""
    tasks, tables = 2 * inputs.sparkSession.sparkContext.defaultParallelism, []

    def numbered(side: DataFrame, contents: DataFrame, columns: Sequence[str], number: str) -> DataFrame:
        there = contents.select(number, *[F.col(c).alias(f"_{c}") for c in columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
        return side.join(there, same).drop(*[f"_{c}" for c in columns])

    for name in wanted:
        mine, theirs = scoring.KNOWN[name]
        a, b = inputs.select(*mine).distinct(), ref.select(*theirs).distinct()
        k = b.count()
        if a.count() * k > LOOKED_UP:
            if name in scoring.COMPARED:
                return None
            continue
        at, to = f"_i_{name}", f"_c_{name}"
        a, b = (cut(x.withColumn(n, F.row_number().over(Window.orderBy(*c)).cast("long") - 1)) for x, n, c in ((a, at, mine), (b, to, theirs)))
        key = F.col(at) * k + F.col(to)
        tables.append((cut(scoring.compared(a.repartition(tasks).crossJoin(b), name).select(key.alias("_key"), name)), key))
        inputs, ref = numbered(inputs, a, mine, at), numbered(ref, b, theirs, to)
    out = pairs(inputs, ref)
    for table, key in tables:
        out = out.join(F.broadcast(table), key == F.col("_key")).drop("_key")
    return out.withColumns({name: F.lit(None).cast("double") for name in scoring.SIMILARITIES if name not in wanted})


def score_block(inputs: DataFrame, ref: DataFrame, keys: list[tuple[str, str]], options: MatchOptions, gate: bool = True, prune: bool = True) -> DataFrame:
    """score_path of a block's pairs. Names are compared once a block, before pairs are made, and only names that can
    reach min_score (all, without prune) are joined: the sides, which should be written ones, meet by name as well. Without
    prune all pairs are scored, as matrices of few contents where they are, else with what is known of few looked up."""
    small_methods(inputs.sparkSession)
    branches = blocking.needed(inputs, ref) if gate else None
    whole = matrices.score_all(inputs, ref, keys, options.weights, int(options.min_score), branches, LOOKED_UP) if gate and not prune else None
    if whole is not None:
        whole = whole.select(*FOUND)
        if not any(branches[x] for x in ("wide", "broad", "token", "lot", "bare")):
            return whole
        rest = blocking.block_pairs(inputs, ref, keys, gate, {"meet": False} | branches)
        return whole.unionByName(score_path(rest, options, prune).select(*FOUND))
    known = None if prune else with_known(inputs, ref, lambda i, r: blocking.block_pairs(i, r, keys, gate, branches))
    if known is not None:
        return score_path(known, options, prune)
    names = names_of_blocks(inputs, ref, keys, gate, int(options.min_score) if prune else None, options.weights)
    if names is None:
        return score_path(blocking.block_pairs(inputs, ref, keys, gate, branches), options, prune)
    mine = list(dict.fromkeys([*(m for m, _ in keys), "i_name", "i_locality"]))
    return score_path(blocking.block_pairs(inputs.join(names, mine), ref, [*keys, ("_name", "c_name"), ("_locality", "c_locality")], gate, branches), options, prune)


def digest() -> Column:
    """Of a parsed input's content."""
    return F.unhex(F.sha2(F.to_json(F.struct(*PARSED_COLUMNS)), 256))


def distinct_inputs(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed inputs without repeats, by a digest of their content as input_id, and (_own, _key), the digest of every
    input: equal inputs are matched once."""
    inputs = scoring.with_columns(inputs, scoring.PARSED_SCHEMA).select("input_id", *PARSED_COLUMNS)
    return inputs.select(*PARSED_COLUMNS).distinct().withColumn("input_id", digest()), inputs.select(F.col("input_id").alias("_own"), digest().alias("_key"))


def for_all(found: DataFrame, fan: DataFrame) -> DataFrame:
    """What was found for distinct inputs, for all of them."""
    return found.withColumnRenamed("input_id", "_key").join(fan, "_key").withColumnRenamed("_own", "input_id").drop("_key")


def postcode_identities(inputs: DataFrame, ref: DataFrame, index: DataFrame, options: MatchOptions) -> DataFrame:
    """Addresses that equal an input in all but the postcode; postcode_only where they are a single address."""
    alt = localities.exact_postcodes(inputs, index)
    pairs = blocking.block_pairs(inputs.join(alt, "input_id"), ref, [("alt_postcode", "postcode"), *scoring.IDENTITY_KEYS], gate=False)
    # identical addresses have equal, filled names: their similarities are known
    pairs = pairs.where(scoring.identity()).drop("alt_postcode").withColumns({c: F.lit(1.0) for c in scoring.SIMILARITIES})
    pairs = score_path(pairs, MatchOptions(min_score=0, weights=options.weights), prune=False)
    key = F.coalesce(F.when(F.col("alias_type").isNotNull(), F.col("principal_pid")), F.col("address_detail_pid"))
    w = Window.partitionBy("input_id")
    single = F.min(key).over(w) == F.max(key).over(w)
    basis = F.when(F.col("match_basis") == "exact_components", F.col("match_basis")).when(single, "postcode_only").otherwise("weighted")
    return pairs.withColumn("match_basis", basis)


def best_scores(found: DataFrame) -> DataFrame:
    return found.groupBy("input_id").agg(F.max("total_score").alias("best"), F.max_by("score_suburb", "total_score").alias("best_suburb"))


def cascade(inputs: DataFrame, ref: DataFrame, index: DataFrame, options: MatchOptions) -> tuple[DataFrame, DataFrame]:
    """All paths' candidates of prepared inputs, best first, and the inputs that had an identical address at all.

    ref: prepared candidates, all sources together.
    """
    chosen = blocking.alias_filter(options.alias_types)
    some = ref if chosen is None else ref.where(chosen)
    if not options.include_custom:
        some = some.where("source <> 'custom' OR source IS NULL")
    by_postcode = cut(score_block(inputs.where("in_postcode IS NOT NULL"), some, [("in_postcode", "postcode")], options).select(*FOUND))
    by_state = cut(score_block(inputs.where("in_postcode IS NULL AND in_state IS NOT NULL"), some, [("in_state", "state")], options).select(*FOUND))
    found = by_postcode.unionByName(by_state)
    if options.locality_fallback:
        exact = found.where("match_basis = 'exact_components'").select("input_id").distinct()
        open_ = inputs.join(exact, "input_id", "left_anti") if options.max_results == 1 else inputs
        same = cut(postcode_identities(open_.where("in_locality IS NOT NULL"), some, index, options).select(*FOUND))
        found, seen = found.unionByName(same.where(F.col("total_score") >= int(options.min_score))), same.select("input_id").distinct()
        weak = int(round(0.85 * options.weights["suburb"]))
        reached = best_scores(by_postcode).where((F.col("best") > options.fallback_threshold) | (F.col("best_suburb") >= weak)).select("input_id")
        by_state_only = inputs.where("in_postcode IS NULL AND in_state IS NOT NULL").select("input_id")
        left = inputs.join(reached, "input_id", "left_anti").join(by_state_only, "input_id", "left_anti").where("in_locality IS NOT NULL OR in_postcode IS NOT NULL")
        left = cut(left, spread=True)
        alt = cut(localities.alternative_postcodes(left, index))
        by_locality = cut(score_block(cut(left.join(alt, "input_id"), spread=True), some, [("alt_postcode", "postcode")], options).select(*FOUND))
        found = found.unionByName(by_locality)
    else:
        by_locality, seen = None, inputs.select("input_id").where(F.lit(False))
    if options.street_fallback:
        so_far = by_postcode.unionByName(by_state)
        if by_locality is not None:
            so_far = so_far.unionByName(by_locality)
        good = best_scores(so_far).where(F.col("best") > options.fallback_threshold).select("input_id")
        left = cut(inputs.join(good, "input_id", "left_anti").where("i_name <> ''"), spread=True)
        p = blocking.block_pairs(left.where("in_postcode IS NOT NULL"), some, [("in_postcode", "postcode"), ("i_name", "c_name")], gate=False)
        s = blocking.block_pairs(left.where("in_postcode IS NULL AND in_state IS NOT NULL"), some, [("in_state", "state"), ("i_name", "c_name")], gate=False)
        found = found.unionByName(cut(score_path(p.unionByName(s), options).select(*FOUND)))
    if options.street_only and (options.alias_types is None or "street_only" in options.alias_types):
        left = inputs.join(found.select("input_id").distinct(), "input_id", "left_anti").where("in_postcode IS NOT NULL AND i_name <> ''")
        lines = ref.where("alias_type = 'street_only' AND (source IS NULL OR source <> 'custom')")
        found = found.unionByName(score_block(cut(left), lines, [("in_postcode", "postcode")], options, gate=False).select(*FOUND))
    return ranked(found, options.max_results), seen


def with_links(matched: DataFrame, ref: DataFrame, link: str) -> DataFrame:
    """Replaces a match by the address it links to, where that is known; keeps the original as matched_*."""
    there = ref.select(*[F.col(c).alias(f"l_{c}") for c in ADDRESS_COLUMNS]).withColumn("_n", F.row_number().over(Window.partitionBy("l_address_detail_pid").orderBy(F.when(F.col("l_source") == "custom", 1).otherwise(0)))).where("_n = 1").drop("_n")
    out = matched.join(there, F.col(link) == F.col("l_address_detail_pid"), "left")
    hit = F.col("l_address_detail_pid").isNotNull()
    out = out.withColumns({f"matched_{c}": F.col(c) for c in ADDRESS_COLUMNS})
    return out.withColumns({c: F.when(hit, F.col(f"l_{c}")).otherwise(F.col(c)) for c in ADDRESS_COLUMNS}).drop(*[f"l_{c}" for c in ADDRESS_COLUMNS])


def with_principal(matched: DataFrame, ref: DataFrame) -> DataFrame:
    """Appends five columns of the principal address."""
    names = ("address_label", "locality_name", "postcode", "longitude", "latitude")
    there = ref.where("source IS NULL OR source <> 'custom'").select(F.col("address_detail_pid").alias("_p"), *[F.col(c).alias(f"principal_{c}") for c in names]).dropDuplicates(["_p"])
    return matched.join(there, F.col("principal_pid") == F.col("_p"), "left").drop("_p")


def match_parsed(inputs: DataFrame, ref: DataFrame, options: MatchOptions | None = None, index: DataFrame | None = None, types: StreetTypes | None = None, untyped: DataFrame | None = None) -> DataFrame:
    """Matches parsed inputs (input_id, in_*) against a reference table; equal inputs are matched once.

    One row per input and match, and one per input without a match, with match_status.
    """
    options = options or MatchOptions()
    inputs = scoring.with_columns(inputs, scoring.PARSED_SCHEMA).select("input_id", *PARSED_COLUMNS)
    distinct, _ = distinct_inputs(inputs)
    ready = cut(scoring.prepared_inputs(distinct, types), spread=True)
    table = cut(scoring.prepared(ref, types, untyped))
    places = cut(localities.locality_index(ref) if index is None else index)
    best, seen = cascade(ready, table, places, options)
    best = cut(best)
    narrow = ["match_rank", "match_basis", "total_score", *SCORES, "number_distance"]
    wide = table.select(*ADDRESS_COLUMNS, F.coalesce("source", F.lit("")).alias("_source"))
    best = best.select(F.col("input_id").alias("_key"), "address_detail_pid", F.coalesce("source", F.lit("")).alias("_source"), *narrow).join(wide, ["address_detail_pid", "_source"])
    line = textnorm.standardised(F.col)
    below = seen.select(F.col("input_id").alias("_key"), F.lit(True).alias("_seen"))
    # every input meets what was found for its content: one shuffle of the inputs, however many there are of a content
    result = inputs.withColumn("input_standardised", line).withColumn("_key", digest())
    result = result.join(best.select("_key", *narrow, *ADDRESS_COLUMNS), "_key", "left").join(below, "_key", "left").drop("_key").withColumn("matched", F.col("address_detail_pid").isNotNull())
    result = result.withColumn("match_status", status()).drop("_seen")
    if options.return_linked:
        result = with_links(result, scoring.with_columns(ref, scoring.ADDRESS_SCHEMA), {"principal": "principal_pid", "primary": "primary_pid"}[options.return_linked])
    return with_principal(result, scoring.with_columns(ref, scoring.ADDRESS_SCHEMA)) if options.resolve_principal else result


def status():
    """matched; below_min_score if an identical address was found but scored too low; insufficient_parse without a street
    or any place; no_candidate."""
    nowhere = F.col("in_postcode").isNull() & F.col("in_state").isNull() & F.col("in_locality").isNull()
    return (
        F.when(F.col("matched"), "matched").when(F.coalesce("_seen", F.lit(False)), "below_min_score").when(F.col("in_street_name").isNull() | nowhere, "insufficient_parse").otherwise("no_candidate")
    )
