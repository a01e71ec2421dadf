"""The registered address queries and their DuckDB equivalents, over address-shaped views of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.operators import blocking, diagnostics, geo, indexes, localities, scoring
from waymark.plans import matcher, oracles
from waymark.plans.fixture import PREFIX, Tables
from waymark.plans.lineage import cut, small_methods
from waymark.plans.oracles import DEFAULTS, RANK, TOTAL, matched, norm, pairs, scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of the tables as a query, with its SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


#: Inputs in a task that writes all pairs of a block: few enough for a Parquet dictionary of their ids (1 MB).
TASK_INPUTS = 50_000


def gated(t: Tables) -> DataFrame:
    """Prepared pairs of the postcode block that pass the number gate."""
    return dealt(*sides(t))


def dealt(i: DataFrame, r: DataFrame, branches: dict[str, bool] | None = None) -> DataFrame:
    """Pairs of prepared sides. Inputs are dealt by what they meet by, into tasks whose number the planner keeps: inputs of
    equal pairs follow each other, so that the many pairs take little room."""
    n = max(2 * i.sparkSession.sparkContext.defaultParallelism, -(-i.count() // TASK_INPUTS))
    return blocking.block_pairs(i, r, POSTCODE, branches=branches or blocking.needed(i, r), tasks=n)


#: What is looked up for a score; the others read nothing that takes long.
READ = {
    "score_suburb": ("suburb_similarity",), "score_street_name": ("street_similarity",), "score_number": ("street_similarity",), "score_flat": ("street_similarity", "credit_flat"),
    "total_score": tuple(scoring.KNOWN),
}


def all_scores(t: Tables, what: str, weights: dict[str, float] | None = None) -> DataFrame:
    """One score of every pair that passes the gate."""
    i, r = sides(t)
    small_methods(t.spark)
    branches = blocking.needed(i, r)
    pairs_ = matcher.with_known(i, r, lambda i, r: dealt(i, r, branches), READ[what]) if what in READ else None
    pairs_ = scoring.with_similarities(dealt(i, r, branches)) if pairs_ is None else scoring.with_gate(pairs_)
    return scoring.scored(pairs_, weights).select("input_id", "address_detail_pid", F.col(what).alias("score"))


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Inputs and candidates with their normal forms, made once for all branches of a block."""
    return cut(scoring.prepared_inputs(t["addr_in"]), spread=True), cut(scoring.prepared(t["addr_ref"]))


def once(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As sides, with equal inputs once under a key of their own, and (_own, _key), the keys of all inputs."""
    inputs, fan = matcher.distinct_inputs(t["addr_in"])
    return cut(scoring.prepared_inputs(inputs), spread=True), cut(scoring.prepared(t["addr_ref"])), fan


ON_POSTCODE = f"i.in_postcode = r.postcode AND {oracles.GATE}"
ON_STATE = f"i.in_postcode IS NULL AND i.in_state = r.state AND {oracles.GATE}"
BEST = ("input_id", "address_detail_pid", "match_basis", "total_score", "match_rank")


def best(df: DataFrame) -> DataFrame:
    return df.select(F.col("input_id").cast("long").alias("input_id"), "address_detail_pid", "match_basis", "total_score", F.col("match_rank").cast("long").alias("match_rank"))


BEST_SQL = "SELECT input_id, address_detail_pid, match_basis, total_score, match_rank FROM ranked"


# scans, projections, predicates


@query("q_addr_ref_build", f"{PREFIX} SELECT * FROM addr_ref")
def addr_ref_build(t):
    return t["addr_ref"]


@query("q_locality_index", f"{PREFIX} SELECT DISTINCT locality_name, postcode, state FROM addr_ref")
def locality_index(t):
    return localities.locality_index(t["addr_ref"])


@query("q_status", f"{PREFIX} SELECT 'addr_in' AS table_name, count(*) AS n FROM addr_in UNION ALL SELECT 'addr_ref', count(*) FROM addr_ref")
def status(t):
    return t["addr_in"].agg(F.lit("addr_in").alias("table_name"), F.count("*").alias("n")).unionByName(t["addr_ref"].agg(F.lit("addr_ref").alias("table_name"), F.count("*").alias("n")))


@query(
    "q_street_only_aliases",
    f"""{PREFIX}, s AS (SELECT DISTINCT street_name, street_type, CAST(NULL AS VARCHAR) AS street_suffix, locality_name, state, postcode FROM addr_ref)
SELECT 'SO_' || md5(concat_ws('|', street_name, coalesce(street_type, ''), '', locality_name, state, CAST(postcode AS VARCHAR))) AS address_detail_pid,
 concat_ws(', ', concat_ws(' ', street_name, street_type), concat_ws(' ', locality_name, state, CAST(postcode AS VARCHAR))) AS address_label, street_name, street_type, postcode, 'street_only' AS alias_type FROM s""",
)
def street_only_aliases(t):
    return indexes.street_only_rows(t["addr_ref"]).select("address_detail_pid", "address_label", "street_name", "street_type", "postcode", "alias_type")


KEY = "regexp_replace(upper(trim(regexp_replace({x}, '[,.\\s\\pZ]+', ' ', 'g'))), '\\s*([-/])\\s*', '\\1', 'g')"


@query("q_exact_key", f"{PREFIX} SELECT address_detail_pid, {KEY.format(x='address_label')} AS lookup_key FROM addr_ref")
def exact_key(t):
    return t["addr_ref"].select("address_detail_pid", textnorm.exact_key(F.col("address_label")).alias("lookup_key"))


SHORT = "CASE street_type WHEN 'STREET' THEN 'ST' WHEN 'ROAD' THEN 'RD' WHEN 'AVENUE' THEN 'AVE' WHEN 'COURT' THEN 'CT' END"
INDEX_SQL = f"""{PREFIX}, base AS (SELECT * FROM addr_ref WHERE alias_type IS NULL),
unit AS (SELECT *, unnest(CASE WHEN flat_number IS NULL THEN [{{'k': 0, 'u': ''}}] ELSE [{{'k': 0, 'u': 'UNIT ' || flat_number || ' '}}, {{'k': 2, 'u': 'U ' || flat_number || ' '}}, {{'k': 2, 'u': flat_number || '/'}}] END) AS a FROM base),
typ AS (SELECT *, unnest(CASE WHEN street_type IS NULL THEN [{{'k': 0, 't': ''}}] ELSE [{{'k': 0, 't': ' ' || street_type}}, {{'k': 1, 't': ' ' || {SHORT}}}] END) AS b FROM unit),
st AS (SELECT *, unnest([{{'k': 0, 's': ' ' || state}}, {{'k': 4, 's': ''}}]) AS c FROM typ),
keys AS (SELECT DISTINCT a.u || CAST(number_first AS VARCHAR) || coalesce('-' || CAST(number_last AS VARCHAR), '') || ' ' || street_name || b.t || ' ' || locality_name || c.s || ' ' || CAST(postcode AS VARCHAR) AS lookup_key,
 a.k + b.k + c.k AS kind, address_detail_pid FROM st),
least_kind AS (SELECT lookup_key, min(kind) AS kind FROM keys GROUP BY lookup_key),
idx AS (SELECT lookup_key, kind, min(address_detail_pid) AS address_detail_pid FROM keys JOIN least_kind USING (lookup_key, kind) GROUP BY lookup_key, kind HAVING count(DISTINCT address_detail_pid) = 1)"""


@query("q_exact_index", f"{INDEX_SQL} SELECT lookup_key, address_detail_pid, CAST(kind AS SMALLINT) AS kind FROM idx")
def exact_index(t):
    return indexes.exact_index(t["addr_ref"])


RAW = f"concat_ws(', ', concat_ws(' ', CASE WHEN in_flat_number IS NOT NULL THEN in_flat_type || ' ' || in_flat_number END, CAST(in_number_first AS STRING) || coalesce('-' || CAST(in_number_last AS STRING), ''), in_street_name, in_street_type), in_locality || ' ' || in_state || ' ' || CAST(in_postcode AS STRING))"


@query("q_exact_index_lookup", f"{INDEX_SQL}, raw AS (SELECT input_id, {KEY.format(x=RAW)} AS lookup_key FROM addr_in) SELECT input_id, address_detail_pid, CAST(kind AS SMALLINT) AS kind FROM raw JOIN idx USING (lookup_key)")
def exact_index_lookup(t):
    return indexes.exact_lookup(t["addr_in"].selectExpr("input_id", f"{RAW} AS input_raw"), indexes.exact_index(t["addr_ref"]))


for _name, _types, _where in (("core", [None], "alias_type IS NULL"), ("types", ["STREET:SYN"], "alias_type IN ('STREET:SYN')"), ("mixed", [None, "STREET:SYN"], "alias_type IS NULL OR alias_type IN ('STREET:SYN')"), ("none", [], "1 = 0")):
    query(f"q_alias_filter_{_name}", f"{PREFIX} SELECT address_detail_pid, alias_type FROM addr_ref WHERE {_where}")(lambda t, a=_types: t["addr_ref"].where(blocking.alias_filter(a)).select("address_detail_pid", "alias_type"))


@query("q_number_prefilter", f"{PREFIX} SELECT input_id, address_detail_pid FROM addr_in i JOIN addr_ref r ON {ON_POSTCODE}")
def number_prefilter(t):
    i, r = scoring.prepared_inputs(t["addr_in"]), scoring.prepared(t["addr_ref"])
    return blocking.block_pairs(i, r, [("in_postcode", "postcode")], gate=False).where(blocking.number_gate()).select("input_id", "address_detail_pid")


@query("q_match_split_branches", ORACLES["q_number_prefilter"])
def match_split_branches(t):
    return gated(t).select("input_id", "address_detail_pid")


# scores


@query(
    "q_name_similarity",
    f"{PREFIX}, p AS (SELECT DISTINCT {norm('in_street_name')} AS a, {norm('street_name')} AS b FROM (SELECT DISTINCT in_postcode, in_street_name FROM addr_in) i JOIN (SELECT DISTINCT postcode, street_name FROM addr_ref) r ON in_postcode = postcode) SELECT a, b, round({oracles.factor('a', 'b')}, 9) AS similarity FROM p",
)
def name_similarity(t):
    from waymark.functions.metrics import pair_similarities

    i, r = t["addr_in"].select("in_postcode", textnorm.name(F.col("in_street_name")).alias("a")).distinct(), t["addr_ref"].select("postcode", textnorm.name(F.col("street_name")).alias("b")).distinct()
    return pair_similarities(i.join(r, F.col("in_postcode") == F.col("postcode")), "a", "b", "s").select("a", "b", F.round("s", 9).alias("similarity"))


def score_sql(what: str, w: dict = DEFAULTS) -> str:
    return f"{PREFIX}, {pairs(ON_POSTCODE)}, scored AS (SELECT *, {scores(w)} FROM pair_sim) SELECT input_id, address_detail_pid, CAST({what} AS INT) AS score FROM scored"


for _name in scoring.COMPONENTS:
    query(f"q_score_{_name}", score_sql(f"score_{_name}"))(lambda t, c=f"score_{_name}": all_scores(t, c))
query("q_score_total", score_sql(TOTAL))(lambda t: all_scores(t, "total_score"))
UNEVEN = {"postcode": 12.5, "suburb": 0.0, "street_name": 27.3, "street_type": 10.2, "number": 33.5, "flat": 16.5}
query("q_score_custom_weights", score_sql(TOTAL, UNEVEN))(lambda t: all_scores(t, "total_score", UNEVEN))


# matching


POSTCODE = [("in_postcode", "postcode")]


def path(i: DataFrame, r: DataFrame, fan: DataFrame, keys: list, k: int, least: int = 60, gate: bool = True, prune: bool = True, more: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """The best k of every input on one path, with all that was made of the pairs; more adds to those of distinct inputs."""
    found = matcher.ranked(matcher.score_block(i, r, keys, matcher.MatchOptions(min_score=least), gate, prune), k)
    return matcher.ranked(matcher.for_all(more(found), fan), k)


query("q_match_postcode_top1", f"{matched(ON_POSTCODE)} {BEST_SQL} WHERE match_rank <= 1")(lambda t: best(path(*once(t), POSTCODE, 1)))
query("q_match_postcode_topk", f"{matched(ON_POSTCODE)} {BEST_SQL} WHERE match_rank <= 5")(lambda t: best(path(*once(t), POSTCODE, 5)))
query("q_match_unpruned", f"{matched(ON_POSTCODE, 80)} {BEST_SQL} WHERE match_rank <= 5")(lambda t: best(path(*once(t), POSTCODE, 5, 80, prune=False)))
query("q_match_pruned", ORACLES["q_match_unpruned"])(lambda t: best(path(*once(t), POSTCODE, 5, 80)))


@query("q_match_state", f"{matched(ON_STATE)} {BEST_SQL} WHERE match_rank <= 3")
def match_state(t):
    i, r, fan = once(t)
    return best(path(i.where("in_postcode IS NULL"), r, fan, [("in_state", "state")], 3))


EXACT_ALT = "SELECT DISTINCT input_id, l.postcode AS alt_postcode FROM addr_in JOIN (SELECT DISTINCT locality_name, postcode, state FROM addr_ref) l ON in_locality = locality_name AND (in_state IS NULL OR in_state = l.state)"
query("q_locality_exact", f"{PREFIX} {EXACT_ALT}")(lambda t: localities.exact_postcodes(t["addr_in"], localities.locality_index(t["addr_ref"])))
FUZZY_ALT = """w AS (SELECT DISTINCT in_locality, in_state FROM addr_in WHERE in_locality IS NOT NULL), ix AS (SELECT DISTINCT locality_name, postcode, state FROM addr_ref),
near AS (SELECT in_locality, in_state, postcode, max(jaro_winkler_similarity(in_locality, locality_name)) AS s FROM w JOIN ix ON in_state = state WHERE jaro_winkler_similarity(in_locality, locality_name) >= 0.85 GROUP BY ALL),
fuzzy AS (SELECT *, row_number() OVER (PARTITION BY in_locality, in_state ORDER BY s DESC, postcode) AS rank FROM near QUALIFY rank <= 5)"""
query("q_locality_fuzzy_top5", f"{PREFIX}, {FUZZY_ALT} SELECT input_id, f.postcode AS alt_postcode, round(s, 9) AS similarity, CAST(rank AS INT) AS rank FROM addr_in JOIN fuzzy f USING (in_locality, in_state)")(
    lambda t: localities.fuzzy_postcodes(t["addr_in"], localities.locality_index(t["addr_ref"])).select("input_id", "alt_postcode", F.round("similarity", 9).alias("similarity"), "rank")
)
query("q_postcode_offsets", f"{PREFIX} SELECT input_id, CAST(in_postcode + o AS INT) AS alt_postcode FROM addr_in, (VALUES (-3), (-2), (-1), (1), (2), (3)) v(o) WHERE in_postcode IS NOT NULL")(lambda t: localities.offset_postcodes(t["addr_in"]))
ALT = f"""{FUZZY_ALT}, ex AS ({EXACT_ALT}), fz AS (SELECT input_id, f.postcode AS alt_postcode FROM addr_in JOIN fuzzy f USING (in_locality, in_state) WHERE input_id NOT IN (SELECT input_id FROM ex)),
off AS (SELECT input_id, CAST(in_postcode + o AS INT) AS alt_postcode FROM addr_in, (VALUES (-3), (-2), (-1), (1), (2), (3)) v(o) WHERE in_postcode IS NOT NULL AND input_id NOT IN (SELECT input_id FROM ex) AND input_id NOT IN (SELECT input_id FROM fz)),
alt AS (SELECT DISTINCT x.input_id, alt_postcode FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz UNION ALL SELECT * FROM off) x JOIN addr_in USING (input_id) WHERE alt_postcode IS DISTINCT FROM in_postcode)"""


@query(
    "q_match_locality_fallback",
    f"""{PREFIX}, {ALT}, {pairs(f"EXISTS (SELECT 1 FROM alt WHERE alt.input_id = i.input_id AND alt.alt_postcode = r.postcode) AND {oracles.GATE}")},
scored AS (SELECT *, {scores()}, abs(number_first - in_number_first) AS number_distance, CASE WHEN {oracles.IDENTITY} AND in_postcode = postcode THEN 'exact_components' ELSE 'weighted' END AS match_basis FROM pair_sim),
total AS (SELECT *, {TOTAL} AS total_score FROM scored), ranked AS (SELECT *, {RANK} AS match_rank FROM total WHERE total_score >= 60) {BEST_SQL} WHERE match_rank <= 1""",
)
def match_locality_fallback(t):
    i, r, fan = once(t)
    alt = localities.alternative_postcodes(i, localities.locality_index(r))
    return best(path(cut(i.join(alt, "input_id"), spread=True), r, fan, [("alt_postcode", "postcode")], 1))


@query("q_match_number_relaxed", f"{matched('i.in_postcode = r.postcode AND i.in_street_name = r.street_name', 40)} {BEST_SQL} WHERE match_rank <= 3")
def match_number_relaxed(t):
    return best(path(*once(t), [("in_postcode", "postcode"), ("i_name", "c_name")], 3, 40, gate=False))


@query(
    "q_match_street_only",
    f"""{PREFIX}, so AS (SELECT DISTINCT 'SO_' || md5(concat_ws('|', street_name, coalesce(street_type, ''), '', locality_name, state, CAST(postcode AS VARCHAR))) AS address_detail_pid, street_name, street_type, postcode FROM addr_ref)
SELECT DISTINCT input_id, so.address_detail_pid FROM addr_in JOIN so ON in_postcode = so.postcode AND in_street_name = so.street_name""",
)
def match_street_only(t):
    lines = scoring.prepared(indexes.street_only_rows(t["addr_ref"]))
    pairs_ = blocking.block_pairs(scoring.prepared_inputs(t["addr_in"]), lines, [("in_postcode", "postcode"), ("i_name", "c_name")], gate=False)
    return pairs_.select("input_id", "address_detail_pid").distinct()


IDENTICAL = f"i.in_locality = r.locality_name AND i.in_state = r.state AND {oracles.IDENTITY}"


@query("q_identity_basis", f"{PREFIX} SELECT input_id, address_detail_pid, CASE WHEN in_postcode = postcode THEN 'exact_components' ELSE 'other' END AS basis FROM addr_in i JOIN addr_ref r ON {IDENTICAL}")
def identity_basis(t):
    i, r = scoring.prepared_inputs(t["addr_in"]), scoring.prepared(t["addr_ref"])
    same = blocking.block_pairs(i, r, [("in_state", "state"), *scoring.IDENTITY_KEYS], gate=False).where(scoring.identity())
    return same.select("input_id", "address_detail_pid", F.when(F.col("in_postcode") == F.col("postcode"), "exact_components").otherwise("other").alias("basis"))


@query(
    "q_postcode_only_unique",
    f"""{PREFIX}, same AS (SELECT input_id, address_detail_pid, in_postcode, postcode, CASE WHEN alias_type IS NOT NULL THEN coalesce(principal_pid, address_detail_pid) ELSE address_detail_pid END AS k FROM addr_in i JOIN addr_ref r ON {IDENTICAL}),
n AS (SELECT input_id, count(DISTINCT k) AS kinds FROM same GROUP BY input_id)
SELECT input_id, address_detail_pid, CASE WHEN in_postcode = postcode THEN 'exact_components' WHEN kinds = 1 THEN 'postcode_only' ELSE 'weighted' END AS match_basis FROM same JOIN n USING (input_id)""",
)
def postcode_only_unique(t):
    i, r, fan = once(t)
    found = matcher.postcode_identities(i, r, localities.locality_index(r), matcher.MatchOptions(min_score=0))
    return matcher.for_all(found.select("input_id", "address_detail_pid", "match_basis"), fan).select("input_id", "address_detail_pid", "match_basis")


@query("q_match_cascade")
def match_cascade(t):
    out = matcher.match_parsed(t["addr_in"], t["addr_ref"], matcher.MatchOptions(street_only=True, resolve_principal=True))
    return out.select("input_id", "input_standardised", "matched", "match_status", "match_basis", "total_score", "address_detail_pid", "principal_address_label")


@query(
    "q_dedup_fanout",
    f"""{PREFIX}, d AS (SELECT md5(concat_ws('|', coalesce(CAST(in_postcode AS VARCHAR), ''), in_state, in_locality, in_street_name, coalesce(in_street_type, ''), CAST(in_number_first AS VARCHAR), coalesce(CAST(in_number_last AS VARCHAR), ''), coalesce(in_flat_number, ''))) AS k, input_id FROM addr_in)
SELECT input_id, count(*) OVER (PARTITION BY k) AS copies FROM d""",
)
def dedup_fanout(t):
    fields = [c for c in t["addr_in"].columns if c not in ("input_id", "in_flat_type")]
    keyed = t["addr_in"].select("input_id", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.count("*").alias("copies")), "k").select("input_id", "copies")


# links


@query("q_resolve_principal", f"{PREFIX} SELECT a.address_detail_pid, a.principal_pid, p.address_label AS principal_address_label, p.postcode AS principal_postcode FROM addr_ref a LEFT JOIN addr_ref p ON a.principal_pid = p.address_detail_pid")
def resolve_principal(t):
    ref = scoring.with_columns(t["addr_ref"], scoring.ADDRESS_SCHEMA)
    return matcher.with_principal(ref, ref).select("address_detail_pid", "principal_pid", "principal_address_label", "principal_postcode")


@query("q_return_primary", f"{PREFIX} SELECT a.address_detail_pid AS matched_address_detail_pid, coalesce(p.address_detail_pid, a.address_detail_pid) AS address_detail_pid, CASE WHEN p.address_detail_pid IS NULL THEN a.street_type ELSE p.street_type END AS street_type FROM addr_ref a LEFT JOIN addr_ref p ON a.principal_pid = p.address_detail_pid")
def return_primary(t):
    ref = scoring.with_columns(t["addr_ref"], scoring.ADDRESS_SCHEMA)
    return matcher.with_links(ref, ref, "principal_pid").select("matched_address_detail_pid", "address_detail_pid", "street_type")


NO_LOCALITY = "SELECT input_id, in_postcode, in_state, in_street_name || ' ' || coalesce(in_street_type || ' ', '') || in_locality AS line FROM addr_in"


def lost(t: Tables) -> DataFrame:
    rows = t.sql(NO_LOCALITY.replace("addr_in", "{addr_in}"), "addr_in")
    return rows.select("input_id", "in_postcode", "in_state", F.col("line").alias("in_street_name"), F.lit(None).cast("string").alias("in_locality"), F.lit(None).cast("string").alias("in_street_type"), F.lit(None).cast("string").alias("in_street_suffix"))


TAILS = f"""l AS ({NO_LOCALITY}), w AS (SELECT *, string_split(line, ' ') AS w FROM l), k AS (SELECT *, unnest([3, 2, 1]) AS k FROM w),
tails AS (SELECT input_id, in_postcode, in_state, k, array_to_string(w[len(w) - k + 1:], ' ') AS tail FROM k WHERE len(w) > k), ix AS (SELECT DISTINCT locality_name, postcode, state FROM addr_ref),
exact AS (SELECT input_id, arg_max(tail, k) AS locality FROM tails JOIN ix ON tail = locality_name AND CASE WHEN in_postcode IS NOT NULL THEN postcode = in_postcode ELSE state = in_state END GROUP BY input_id)"""
query("q_recover_locality_exact", f"{PREFIX}, {TAILS} SELECT * FROM exact")(lambda t: localities.recovered_localities(lost(t), localities.locality_index(t["addr_ref"])).where("how = 'exact'").select("input_id", "locality"))
query(
    "q_recover_locality_fuzzy",
    f"""{PREFIX}, {TAILS}, fz AS (SELECT input_id, tail, locality_name FROM tails JOIN ix ON CASE WHEN in_postcode IS NOT NULL THEN postcode = in_postcode ELSE state = in_state END
 WHERE input_id NOT IN (SELECT input_id FROM exact) AND k >= 2 AND length(tail) >= 5 AND NOT starts_with(tail, 'THE ') AND abs(length(tail) - length(locality_name)) <= 1
 AND length(tail) - length(replace(tail, ' ', '')) = length(locality_name) - length(replace(locality_name, ' ', '')) AND damerau_levenshtein(tail, locality_name) = 1)
SELECT input_id, min(locality_name) AS locality FROM fz GROUP BY input_id HAVING count(DISTINCT locality_name) = 1 AND count(DISTINCT tail) = 1""",
)(lambda t: localities.recovered_localities(lost(t), localities.locality_index(t["addr_ref"])).where("how = 'fuzzy'").select("input_id", "locality"))

LINKED = """SELECT *, CASE WHEN CAST(substr(address_detail_pid, 2) AS INT) % 3 = 0 THEN 'S' ELSE 'P' END AS primary_secondary,
 CASE WHEN CAST(substr(address_detail_pid, 2) AS INT) % 3 = 0 THEN 'C' || lpad(CAST(CAST(substr(address_detail_pid, 2) AS INT) + 10 AS STRING), 9, '0') END AS primary_pid FROM """


@query(
    "q_collapse_secondaries",
    f"""{PREFIX.replace('WITH ', 'WITH RECURSIVE ', 1)}, x AS ({LINKED} addr_ref),
gone(pid) AS (SELECT s.address_detail_pid FROM x s JOIN x p ON s.primary_pid = p.address_detail_pid WHERE s.primary_secondary = 'S' AND s.longitude = p.longitude AND s.latitude = p.latitude
 UNION SELECT a.address_detail_pid FROM gone JOIN x a ON a.principal_pid = gone.pid WHERE a.alias_type IS NOT NULL) SELECT address_detail_pid FROM x WHERE address_detail_pid NOT IN (SELECT pid FROM gone)""",
)
def collapse_secondaries(t):
    return indexes.collapsed(t.sql(LINKED + "{addr_ref}", "addr_ref")).select("address_detail_pid")


# store operations


@query("q_upsert_custom", f"{PREFIX} SELECT address_detail_pid, CASE WHEN postcode % 2 = 0 THEN 'NEW ' || street_name ELSE street_name END AS street_name FROM addr_ref UNION ALL SELECT 'N' || address_detail_pid, street_name FROM addr_ref WHERE postcode % 5 = 0")
def upsert_custom(t):
    from waymark.sources.store import upserted

    old = t["addr_ref"].select("address_detail_pid", "street_name", "postcode")
    new = old.where("postcode % 2 = 0").withColumn("street_name", F.concat(F.lit("NEW "), "street_name")).unionByName(old.where("postcode % 5 = 0").withColumn("address_detail_pid", F.concat(F.lit("N"), "address_detail_pid")))
    return upserted(old, new, ["address_detail_pid"]).select("address_detail_pid", "street_name")


@query("q_delete_keys", f"{PREFIX} SELECT address_detail_pid FROM addr_ref WHERE address_detail_pid NOT IN (SELECT principal_pid FROM addr_ref WHERE principal_pid IS NOT NULL)")
def delete_keys(t):
    from waymark.sources.store import without_keys

    keys = t["addr_ref"].where("principal_pid IS NOT NULL").select(F.col("principal_pid").alias("address_detail_pid"))
    return without_keys(t["addr_ref"], keys, ["address_detail_pid"]).select("address_detail_pid")



def cached(t: Tables) -> DataFrame:
    from waymark.sources.cache import from_events

    return from_events(t["events"])


CACHE_SQL = "WITH cache AS (SELECT 'K' || CAST(event_id % 500 AS VARCHAR) AS input_standardised, 'C' || CAST(event_id AS VARCHAR) AS address_detail_pid, CAST(60 + event_id % 41 AS INT) AS total_score, CAST(ts AS TIMESTAMP) AS cached_at, CAST(18 + event_id % 3 AS INT) AS algorithm_version FROM events)"


@query("q_cache_lookup", f"{CACHE_SQL}, i AS (SELECT o_orderkey AS input_id, 'K' || CAST(o_orderkey % 700 AS VARCHAR) AS input_standardised FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY input_standardised ORDER BY cached_at DESC, address_detail_pid DESC) AS n FROM cache WHERE algorithm_version = 20 AND total_score >= 80) SELECT input_id, address_detail_pid, total_score FROM i JOIN l USING (input_standardised) WHERE n = 1")
def cache_lookup(t):
    from waymark.sources import cache

    inputs = t["orders"].select(F.col("o_orderkey").alias("input_id"), F.concat(F.lit("K"), (F.col("o_orderkey") % 700).cast("string")).alias("input_standardised"))
    return cache.lookup(inputs, cache.latest(cached(t).where("algorithm_version = 20 AND total_score >= 80")), 20, 80).select("input_id", "address_detail_pid", "total_score")


for _by, _sql in (("day", "CAST(CAST(cached_at AS DATE) AS TIMESTAMP)"), ("hour", "date_trunc('hour', cached_at)")):

    @query(f"q_cache_history_{_by}", f"{CACHE_SQL} SELECT {_sql} AS bucket, count(*) AS n, min(total_score) AS min_score, round(avg(total_score), 6) AS mean_score, max(total_score) AS max_score FROM cache GROUP BY 1")
    def cache_history(t, by=_by):
        from waymark.sources import cache

        return cache.history(cached(t), by)


@query("q_cache_status", f"{CACHE_SQL} SELECT count(*) AS n, min(cached_at) AS first_cached, max(cached_at) AS last_cached FROM cache")
def cache_status(t):
    from waymark.sources import cache

    return cache.status(cached(t))


# geography

SHAPES = "SELECT CAST(n_nationkey AS STRING) AS shape_id, n_nationkey AS ord, CAST(139.25 + n_nationkey * 0.9 AS DOUBLE) AS x0, CAST(141.05 + n_nationkey * 0.9 AS DOUBLE) AS x1, CAST(-30.5 AS DOUBLE) AS y0, CAST(-24.5 AS DOUBLE) AS y1 FROM "


def shapes(t: Tables) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    return t.sql(SHAPES + "{nation}", "nation").select("shape_id", F.col("ord").cast("long").alias("ord"), box.alias("rings"))


INSIDE = f"sh AS ({SHAPES} nation), hit AS (SELECT address_detail_pid, shape_id, ord FROM addr_ref LEFT JOIN sh ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1)"
query("q_geo_pip_first", f"{PREFIX}, {INSIDE} SELECT address_detail_pid, arg_min(shape_id, ord) AS shape_id FROM hit GROUP BY address_detail_pid")(lambda t: geo.point_in_polygon(t["addr_ref"], shapes(t)).select("address_detail_pid", "shape_id"))
query("q_geo_pip_all", f"{PREFIX}, {INSIDE} SELECT address_detail_pid, shape_id FROM hit")(lambda t: geo.point_in_polygon(t["addr_ref"], shapes(t), mode="all").select("address_detail_pid", "shape_id"))


@query("q_geo_coverage", f"{PREFIX}, {INSIDE}, one AS (SELECT address_detail_pid, arg_min(shape_id, ord) AS shape_id FROM hit GROUP BY address_detail_pid) SELECT 'shape_id' AS attribute, count(*) AS n, count(shape_id) AS non_missing, count(shape_id) * 100.0::DOUBLE / count(*) AS pct, CAST(0 AS BIGINT) AS orphans FROM one")
def geo_coverage(t):
    layer = geo.point_in_polygon(t["addr_ref"], shapes(t)).select("address_detail_pid", "shape_id")
    return geo.coverage(t["addr_ref"], layer, ["shape_id"])


@query("q_geo_heat", f"{PREFIX} SELECT floor(longitude / 2.0) * 2.0::DOUBLE AS x, floor(latitude / 2.0) * 2.0::DOUBLE AS y, count(*) AS n FROM addr_ref GROUP BY 1, 2")
def geo_heat(t):
    return geo.heat(t["addr_ref"], 2.0)


@query(
    "q_nearest_postcode",
    f"""{PREFIX}, todo AS (SELECT input_id AS pid, in_locality AS locality_name, CAST(140 + input_id % 25 AS DOUBLE) AS longitude, CAST(-30 + input_id % 7 AS DOUBLE) AS latitude FROM addr_in),
p AS (SELECT pid, k.postcode, pow((t.longitude - k.longitude) * cos(radians(t.latitude)), 2) + pow(t.latitude - k.latitude, 2) AS d, k.address_detail_pid AS kp FROM todo t JOIN addr_ref k USING (locality_name))
SELECT pid, postcode FROM (SELECT pid, postcode, row_number() OVER (PARTITION BY pid ORDER BY d, kp) AS n FROM p) WHERE n = 1""",
)
def nearest_postcode(t):
    todo = t["addr_in"].select(F.col("input_id").alias("pid"), F.col("in_locality").alias("locality_name"), (140 + F.col("input_id") % 25).cast("double").alias("longitude"), (-30 + F.col("input_id") % 7).cast("double").alias("latitude"))
    return indexes.nearest(todo, t["addr_ref"], "locality_name")


def _shift_sql() -> str:
    import math

    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    rx, ry, rz = (math.radians(r / 3600) for r in geo.ROTATION)
    s, b, e3 = 1 + geo.SCALE * 1e-6, geo.AXIS * (1 - geo.FLATTENING), e2 / (1 - e2)
    d = lambda v: f"({v!r}::DOUBLE)"
    return f"""{PREFIX}, c AS (SELECT DISTINCT longitude, latitude, radians(latitude) AS f, radians(longitude) AS l FROM addr_ref), n AS (SELECT *, {d(geo.AXIS)} / sqrt(1 - {d(e2)} * pow(sin(f), 2)) AS nu FROM c),
x AS (SELECT *, nu * cos(f) * cos(l) AS x, nu * cos(f) * sin(l) AS y, nu * {d(1 - e2)} * sin(f) AS z FROM n),
h AS (SELECT *, {d(geo.SHIFT[0])} + {d(s)} * (x + {d(rz)} * y - {d(ry)} * z) AS x2, {d(geo.SHIFT[1])} + {d(s)} * ({d(-rz)} * x + y + {d(rx)} * z) AS y2, {d(geo.SHIFT[2])} + {d(s)} * ({d(ry)} * x - {d(rx)} * y + z) AS z2 FROM x),
t AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p, atan2(z2 * {d(geo.AXIS)}, sqrt(x2 * x2 + y2 * y2) * {d(b)}) AS th FROM h)
SELECT longitude, latitude, round(degrees(atan2(y2, x2)), 7) AS lon_2020, round(degrees(atan2(z2 + {d(e3)} * {d(b)} * pow(sin(th), 3), p - {d(e2)} * {d(geo.AXIS)} * pow(cos(th), 3))), 7) AS lat_2020 FROM t"""


@query("q_datum_shift", _shift_sql())
def datum_shift(t):
    lon, lat = geo.gda94_to_gda2020(F.col("longitude"), F.col("latitude"))
    return t["addr_ref"].select("longitude", "latitude").distinct().select("longitude", "latitude", F.round(lon, 7).alias("lon_2020"), F.round(lat, 7).alias("lat_2020"))


# second source

PLI_RAW = """SELECT 'Q' || CAST(c_custkey AS STRING) AS address_pid, CASE WHEN c_custkey % 9 = 0 THEN 'XXX' WHEN c_custkey % 2 = 0 THEN ' Street ' ELSE 'road' END AS street_type,
 CASE c_nationkey % 3 WHEN 0 THEN 'East' WHEN 1 THEN NULL ELSE 'central' END AS street_suffix, lower(replace(c_name, '#', ' ')) AS street_name, CASE WHEN c_nationkey % 4 = 0 THEN 'Spring (Gold Coast)' ELSE 'Hill ' || CAST(c_nationkey AS STRING) END AS locality,
 CASE WHEN c_custkey % 6 = 0 THEN 'D' ELSE 'C' END AS lotplan_status, CASE WHEN c_custkey % 5 = 0 THEN 'H' ELSE 'P' END AS address_status, CASE WHEN c_custkey % 3 = 0 THEN 'PC' ELSE 'BC' END AS geocode_type, CAST(c_custkey % 10 AS STRING) AS lot, 'SP' || CAST(c_custkey % 7 AS STRING) AS plan FROM """


@query(
    "q_pli_clean",
    f"""WITH raw AS ({PLI_RAW} customer), up AS (SELECT address_pid, nullif(upper(trim(street_name)), '') AS street_name, nullif(nullif(upper(trim(street_type)), ''), 'XXX') AS street_type,
 CASE upper(trim(street_suffix)) WHEN 'EAST' THEN 'E' WHEN 'WEST' THEN 'W' WHEN 'NORTH' THEN 'N' WHEN 'SOUTH' THEN 'S' WHEN 'CENTRAL' THEN 'CN' ELSE upper(trim(street_suffix)) END AS street_suffix,
 trim(regexp_replace(upper(trim(locality)), ' *\\([^)]*\\)$', '')) AS locality_name, lotplan_status, address_status, geocode_type, lot, plan FROM raw)
SELECT address_pid, street_name, street_type, street_suffix, locality_name FROM up WHERE lotplan_status <> 'D' AND address_status IN ('P')""",
)
def pli_clean(t):
    from waymark.sources.pli import cleaned

    raw = t.sql(PLI_RAW + "{customer}", "customer")
    return cleaned(raw, ("P",)).select("address_pid", "street_name", "street_type", "street_suffix", "locality_name")


@query(
    "q_pli_postcode",
    f"""{PREFIX}, loc AS (SELECT locality_name, count(DISTINCT postcode) AS n, min(postcode) AS p FROM addr_ref GROUP BY 1), str AS (SELECT locality_name, street_name, street_type, min(postcode) AS p FROM addr_ref GROUP BY 1, 2, 3 HAVING count(DISTINCT postcode) = 1)
SELECT i.input_id AS address_pid, coalesce(CASE WHEN l.n = 1 THEN l.p END, s.p) AS postcode FROM addr_in i LEFT JOIN loc l ON l.locality_name = i.in_locality LEFT JOIN str s ON s.locality_name = i.in_locality AND s.street_name = i.in_street_name AND s.street_type = i.in_street_type""",
)
def pli_postcode(t):
    from waymark.sources.pli import with_postcodes

    rows = t["addr_in"].select(F.col("input_id").alias("address_pid"), F.col("in_locality").alias("locality_name"), F.col("in_street_name").alias("street_name"), F.col("in_street_type").alias("street_type"))
    return with_postcodes(rows, t["addr_ref"]).select("address_pid", "postcode")


REASON = "CASE WHEN number_first IS NULL AND lot_number IS NULL THEN 'no_number_or_lot' WHEN postcode IS NULL THEN 'no_postcode' END"
PLI_ROWS = "SELECT input_id AS address_pid, in_number_first AS number_first, CAST(NULL AS STRING) AS lot_number, in_postcode AS postcode, in_flat_type AS flat_type, in_flat_number AS flat_number, in_street_name AS street_name, in_street_type AS street_type, in_locality AS locality_name FROM "
FULL = "concat_ws('|', coalesce(flat_type, ''), coalesce(flat_number, ''), CAST(number_first AS {s}), street_name, coalesce(street_type, ''), locality_name, CAST(postcode AS {s}))"
PLI_STATUS = f"""{PREFIX}, r AS ({PLI_ROWS} addr_in), k AS (SELECT *, {FULL.format(s='VARCHAR')} AS label_key, {REASON} AS reason FROM r), ref AS (SELECT DISTINCT {FULL.format(s='VARCHAR')} AS label_key FROM addr_ref),
c AS (SELECT k.*, ref.label_key IS NOT NULL AS in_ref FROM k LEFT JOIN ref USING (label_key)), n AS (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY address_pid) AS dup FROM c WHERE reason IS NULL AND NOT in_ref),
s AS (SELECT c.address_pid, CASE WHEN c.reason IS NOT NULL THEN c.reason WHEN c.in_ref THEN 'in_reference' WHEN n.dup > 1 THEN 'duplicate_label' ELSE 'added' END AS status FROM c LEFT JOIN n USING (address_pid))"""


def pli_status(t: Tables) -> DataFrame:
    from waymark.sources.pli import classified

    text = FULL.format(s="STRING")
    rows = t.sql(PLI_ROWS + "{addr_in}", "addr_in").selectExpr("*", f"{text} AS label_key", f"{REASON} AS reason")
    return classified(rows, t["addr_ref"].selectExpr(f"{text} AS label_key").distinct())


query("q_pli_classify", f"{PLI_STATUS} SELECT * FROM s")(lambda t: pli_status(t).select("address_pid", "status"))
query("q_pli_funnel", f"{PLI_STATUS} SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM s GROUP BY status")(
    lambda t: pli_status(t).groupBy("status").agg(F.count("*").alias("n")).select("status", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("pct"))
)


# diagnostics


def top(t: Tables, k: int = 1, more: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    return path(*once(t), POSTCODE, k, more=more)


GRAMS = lambda x: f"CASE WHEN length({x}) < 2 THEN [] ELSE list_distinct([substr({x}, i, 2) FOR i IN range(1, length({x}))]) END"


@query(
    "q_text_scores",
    f"""{matched(ON_POSTCODE)}, x AS (SELECT input_id, in_street_name AS a, address_label AS b FROM ranked WHERE match_rank = 1), y AS (SELECT *, {GRAMS('a')} AS ga, {GRAMS('b')} AS gb FROM x)
SELECT input_id, round(jaro_winkler_similarity(a, b) * 100, 1) AS jaro_winkler, round(100.0::DOUBLE * len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 1) AS jaccard, round(100 * (1 - levenshtein(a, b)::DOUBLE / greatest(1, length(a), length(b))), 1) AS edit FROM y""",
)
def text_scores(t):
    labels = t["addr_ref"].select("address_detail_pid", "address_label")
    return top(t, more=lambda found: diagnostics.text_scores(found.join(labels, "address_detail_pid"), "i_name")).select("input_id", "jaro_winkler", "jaccard", "edit")


@query(
    "q_match_features",
    f"{matched(ON_POSTCODE)} SELECT input_id, address_detail_pid, {oracles.postcode(100.0)} AS agreement_postcode, {oracles.name(100, 'street_similarity')} AS agreement_street_name, {oracles.even(f'100.0::DOUBLE * {oracles.NUMBER_CREDIT}::DOUBLE')} AS agreement_number, {oracles.even(f'100.0::DOUBLE * {oracles.FLAT_CREDIT}::DOUBLE')} AS agreement_flat, CAST(in_flat_number IS NOT NULL AND flat_number IS NOT NULL AND in_flat_number <> flat_number AS INT) AS flat_number_conflict, CAST(in_number_last IS NULL OR number_last IS NULL AS INT) AS number_last_unavailable FROM ranked WHERE match_rank <= 2",
)
def match_features(t):
    return diagnostics.features(top(t, 2)).select("input_id", "address_detail_pid", "agreement_postcode", "agreement_street_name", "agreement_number", "agreement_flat", "flat_number_conflict", "number_last_unavailable")


@query("q_score_gap", f"{matched(ON_POSTCODE)}, o AS (SELECT input_id, total_score AS s, row_number() OVER (PARTITION BY input_id ORDER BY total_score DESC, address_detail_pid) AS r FROM ranked WHERE match_rank <= 3), g AS (SELECT input_id, max(s) AS best, max(CASE WHEN r = 2 THEN s END) AS runner_up FROM o WHERE r <= 2 GROUP BY input_id) SELECT input_id, best, runner_up, best - runner_up AS score_gap, coalesce(best = runner_up, FALSE) AS tied_best FROM g")
def score_gap(t):
    return diagnostics.score_gaps(top(t, 3))


@query("q_threshold_scope", f"{matched(ON_POSTCODE)} SELECT input_id, address_detail_pid FROM ranked WHERE match_rank = 1 AND score_number >= 20 AND score_street_name <= 15")
def threshold_scope(t):
    found = top(t, 3).withColumn("matched", F.lit(True))
    return found.where(diagnostics.scope({"score_number": (20, 100), "score_street_name": (0, 15)}, maxima={"score_number": 100})).select("input_id", "address_detail_pid")


@query("q_reliability_bins", f"{matched(ON_POSTCODE)}, r AS (SELECT total_score / 100.0::DOUBLE AS p, match_basis = 'exact_components' AS y FROM ranked WHERE match_rank = 1) SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(CAST(y AS DOUBLE)), 9) AS mean_y FROM r GROUP BY 1")
def reliability_bins(t):
    found = top(t).select((F.col("total_score") / 100.0).alias("p"), (F.col("match_basis") == "exact_components").alias("y"))
    return diagnostics.reliability(found, "p", "y").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("mean_y", 9).alias("mean_y"))


@query("q_fixed_format_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_created FROM orders")
def fixed_format_dates(t):
    from waymark.sources.core_csv import flexible_date

    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t["orders"].select("o_orderkey", flexible_date(text).alias("date_created"))


#: The last word of a street without a type is read as one where it is, or is like, a type: here these.
READ_TYPE = "CASE WHEN street_type IS NULL THEN CASE split_part(street_name, ' ', 2) WHEN 'RING' THEN 'RING' WHEN 'ROD' THEN 'ROAD' WHEN 'PLATE' THEN 'PLACE' END END"


@query(
    "q_parse_labels",
    f"""{PREFIX} SELECT address_detail_pid AS input_id, address_label AS input_raw, postcode AS in_postcode, state AS in_state, locality_name AS in_locality,
 CASE WHEN {READ_TYPE} IS NOT NULL THEN split_part(street_name, ' ', 1) ELSE street_name END AS in_street_name, coalesce(street_type, {READ_TYPE}) AS in_street_type, CAST(NULL AS VARCHAR) AS in_street_suffix, number_first AS in_number_first, number_last AS in_number_last,
 CAST(NULL AS VARCHAR) AS in_number_suffix, flat_type AS in_flat_type, flat_number AS in_flat_number, CAST(NULL AS VARCHAR) AS in_level_type, CAST(NULL AS VARCHAR) AS in_level_number, CAST(NULL AS VARCHAR) AS in_lot_number, CAST(NULL AS VARCHAR) AS in_building_name FROM addr_ref""",
)
def parse_labels(t):
    from waymark.functions.parser import parse_addresses

    return parse_addresses(t["addr_ref"].select(F.col("address_detail_pid").alias("input_id"), F.col("address_label").alias("input_raw")))


@query("q_perturb")
def perturb(t):
    from waymark.operators.simulate import perturbed

    return perturbed(t["addr_ref"].select(F.col("address_detail_pid").alias("input_id"), "address_label"), seed=1)


@query("q_match_text")
def match_text(t):
    from waymark.plans.match_text import match_addresses

    texts = t["addr_ref"].select(F.col("address_detail_pid").alias("input_id"), F.col("address_label").alias("input_raw"))
    return match_addresses(texts, t["addr_ref"]).select("input_id", "input_standardised", "match_status", "match_basis", "total_score", "address_detail_pid")


# the whole of a match, and what is left


@query(
    "q_match_blocks",
    f"""{matched(f'(({ON_POSTCODE}) OR ({ON_STATE}))')} SELECT a.input_id, r.address_detail_pid IS NOT NULL AS matched, r.match_basis, r.total_score, r.address_detail_pid
FROM addr_in a LEFT JOIN (SELECT * FROM ranked WHERE match_rank = 1) r ON r.input_id = a.input_id""",
)
def match_blocks(t):
    found = matcher.match_parsed(t["addr_in"], t["addr_ref"], matcher.MatchOptions(locality_fallback=False, street_fallback=False))
    return found.select("input_id", "matched", "match_basis", "total_score", "address_detail_pid")


@query("q_best_so_far", f"{matched(ON_POSTCODE)} SELECT input_id, max(total_score) AS best FROM ranked GROUP BY input_id")
def best_so_far(t):
    i, r, fan = once(t)
    found = matcher.for_all(matcher.best_scores(matcher.score_block(i, r, POSTCODE, matcher.MatchOptions())), fan)
    return found.groupBy("input_id").agg(F.max("best").alias("best"))


@query("q_insert_or_ignore", f"{PREFIX} SELECT address_detail_pid, CASE WHEN postcode % 2 = 0 THEN street_name ELSE 'NEW ' || street_name END AS street_name FROM addr_ref")
def insert_or_ignore(t):
    from waymark.sources.store import added

    rows = t["addr_ref"].select("address_detail_pid", "street_name", "postcode")
    return added(rows.where("postcode % 2 = 0"), rows.withColumn("street_name", F.concat(F.lit("NEW "), "street_name")), ["address_detail_pid"]).select("address_detail_pid", "street_name")


@query("q_exact_lookup_plain", f"{INDEX_SQL}, raw AS (SELECT input_id, {KEY.format(x=RAW)} AS lookup_key FROM addr_in) SELECT input_id, address_detail_pid, CAST(kind AS SMALLINT) AS kind FROM raw JOIN idx USING (lookup_key) WHERE kind = 0")
def exact_lookup_plain(t):
    return indexes.exact_lookup(t["addr_in"].selectExpr("input_id", f"{RAW} AS input_raw"), indexes.exact_index(t["addr_ref"]), normalize=False)


ONE_SPACE = "nullif(trim(regexp_replace({x}, ' +', ' ', 'g')), '')"
STREET_LINE = "concat_ws(' ', concat_ws(' ', in_flat_type, in_flat_number), CAST(in_number_first AS VARCHAR) || coalesce('-' || CAST(in_number_last AS VARCHAR), ''), in_street_name, in_street_type)"
PLACE_LINE = "concat_ws(' ', in_locality, in_state, lpad(CAST(in_postcode AS VARCHAR), 4, '0'))"


@query("q_standardised", f"{PREFIX} SELECT input_id, concat_ws(', ', {ONE_SPACE.format(x=STREET_LINE)}, {ONE_SPACE.format(x=PLACE_LINE)}) AS line FROM addr_in")
def standardised(t):
    return scoring.with_columns(t["addr_in"], scoring.PARSED_SCHEMA).select("input_id", textnorm.standardised(F.col).alias("line"))


@query(
    "q_normal_forms",
    f"""SELECT p_partkey, upper(trim(x)) AS value, {norm('x')} AS name, regexp_replace(upper(trim(k)), '^0+([0-9]+[A-Z]?)$', '\\1') AS identifier, {KEY.format(x='x')} AS lookup
FROM (SELECT p_partkey, '  ' || p_name || ' - 1,  ' || p_brand AS x, lpad(CAST(p_partkey % 70 AS VARCHAR), 4, '0') || CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE '' END AS k FROM part) q""",
)
def normal_forms(t):
    x, k = F.concat(F.lit("  "), "p_name", F.lit(" - 1,  "), "p_brand"), F.concat(F.lpad((F.col("p_partkey") % 70).cast("string"), 4, "0"), F.when(F.col("p_partkey") % 3 == 0, "b").otherwise(""))
    return t["part"].select("p_partkey", textnorm.value(x).alias("value"), textnorm.name(x).alias("name"), textnorm.identifier(k).alias("identifier"), textnorm.exact_key(x).alias("lookup"))


@query(
    "q_median_metres",
    f"""{PREFIX} SELECT a.state, round(median(sqrt(pow((p.longitude - a.longitude) * 111320.0 * cos(radians(a.latitude)), 2) + pow((p.latitude - a.latitude) * 110574.0, 2))), 4) AS median_metres, count(p.longitude) AS n
FROM addr_ref a JOIN addr_ref p ON a.principal_pid = p.address_detail_pid GROUP BY a.state""",
)
def median_metres(t):
    there = t["addr_ref"].select(F.col("address_detail_pid").alias("principal_pid"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    found = diagnostics.median_metres(t["addr_ref"].join(there, "principal_pid"), ("longitude", "latitude"), ("x", "y"), "state")
    return found.select("state", F.round("median_metres", 4).alias("median_metres"), "n")


COUNTED = ("address_detail_pid", "street_type", "flat_number", "alias_type", "postcode")


@query("q_column_statistics", f"{PREFIX} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS filled, count(DISTINCT {c}) AS kinds FROM addr_ref" for c in COUNTED))
def column_statistics(t):
    from waymark.sources.store import column_statistics

    return column_statistics(t["addr_ref"].select(*COUNTED), exact=True)
