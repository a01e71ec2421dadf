"""Derived tables: street-only rows, untyped street names, the exact-label index, linked-row closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.vocab import StreetTypes
from waymark.operators.scoring import ADDRESS_COLUMNS, ADDRESS_SCHEMA, with_columns

# Street types whose short form the index also knows, and short forms of flat types.
INDEX_STREET_SHORT = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "DRIVE": "DR", "COURT": "CT", "PLACE": "PL", "CRESCENT": "CRES", "CLOSE": "CL", "LANE": "LN", "TERRACE": "TCE", "PARADE": "PDE", "HIGHWAY": "HWY", "BOULEVARD": "BLVD",
    "CIRCUIT": "CCT", "GROVE": "GR", "SQUARE": "SQ", "ESPLANADE": "ESP", "PARKWAY": "PKWY", "WAY": "WY", "TRACK": "TRK", "CIRCLE": "CIR", "LOOP": "LOOP", "GARDENS": "GDNS", "JUNCTION": "JNC",
}
INDEX_FLAT_SHORT = {"UNIT": "U", "APARTMENT": "APT", "SUITE": "STE"}


def street_only_rows(ref: DataFrame) -> DataFrame:
    """One row per street of a locality, from rows with a street and a postcode; its pid is a digest of the six fields."""
    six = ["street_name", "street_type", "street_suffix", "locality_name", "state", "postcode"]
    streets = with_columns(ref, ADDRESS_SCHEMA).where("street_name IS NOT NULL AND postcode IS NOT NULL AND (alias_type IS NULL OR alias_type <> 'street_only')").select(*six).distinct()
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in six])
    place = F.concat_ws(" ", "locality_name", "state", F.col("postcode").cast("string"))
    label = F.concat_ws(", ", F.concat_ws(" ", "street_name", "street_type", "street_suffix"), F.nullif(place, F.lit("")))
    made = streets.select(F.concat(F.lit("SO_"), F.md5(key)).alias("address_detail_pid"), label.alias("address_label"), *six, F.lit("street_only").alias("alias_type"), F.lit("gnaf").alias("source"))
    return with_columns(made, ADDRESS_SCHEMA).select(*ADDRESS_COLUMNS)


def index_keys(ref: DataFrame, types: StreetTypes | None = None, variants: bool = True) -> DataFrame:
    """(lookup_key, address_detail_pid, kind) of principal labels: 0 the label, +1 street type short, +2 flat type
    short or as a slash, +4 without the state."""
    table = (types or StreetTypes.common()).canonical
    rows = with_columns(ref, ADDRESS_SCHEMA).where("alias_type IS NULL AND address_label IS NOT NULL")
    key = textnorm.exact_key(F.col("address_label"))
    base = rows.select("address_detail_pid", key.alias("key"), "street_type", "flat_type", "flat_number", "state", F.lpad(F.col("postcode").cast("string"), 4, "0").alias("pc"), textnorm.exact_key(F.concat_ws(" ", "street_name", "street_type")).alias("street"))
    if not variants:
        return base.select(F.col("key").alias("lookup_key"), "address_detail_pid", F.lit(0).cast("short").alias("kind"))
    short = {full: s for full, s in INDEX_STREET_SHORT.items() if table.get(s) == full}
    street = F.create_map(*[F.lit(x) for p in sorted(short.items()) for x in p])
    flat = F.create_map(*[F.lit(x) for p in sorted(INDEX_FLAT_SHORT.items()) for x in p])

    def swapped(k, old, new):
        # as whole words only: spaces at both ends of the key stand for its bounds
        padded, whole = F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit(" "), old, F.lit(" "))
        at = F.instr(padded, whole)
        put = F.concat(F.substring(padded, F.lit(1), at), new, F.substring(padded, at + 1 + F.length(old), F.length(padded)))
        return F.when((at > 0) & new.isNotNull(), F.trim(put))

    short_type = F.try_element_at(street, F.upper("street_type"))
    short_street = swapped(F.col("key"), F.col("street"), F.concat(F.substring("street", F.lit(1), F.length("street") - F.length("street_type")), short_type))
    out = base.select("*", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("key").alias("k")), F.struct(F.lit(1).alias("kind"), short_street.alias("k")))).alias("v1")).where("v1.k IS NOT NULL")
    unit = textnorm.exact_key(F.concat_ws(" ", "flat_type", "flat_number"))
    k = F.col("v1.k")
    starts = k.startswith(F.concat(unit, F.lit(" "))) & F.col("flat_number").isNotNull() & F.col("flat_type").isNotNull()
    rest = F.substring(k, F.length(unit) + 2, F.length(k))
    number = F.regexp_extract(rest, "^[0-9]", 0) != ""
    slash = F.when(starts & number, F.concat(textnorm.exact_key(F.col("flat_number")), F.lit("/"), rest))
    shorter = F.when(starts, F.concat_ws(" ", F.concat_ws(" ", F.try_element_at(flat, F.upper("flat_type")), textnorm.exact_key(F.col("flat_number"))), rest)).cast("string")
    shorter = F.when(F.try_element_at(flat, F.upper("flat_type")).isNotNull(), shorter)
    out = out.select("*", F.explode(F.array(F.struct(F.col("v1.kind").alias("kind"), k.alias("k")), F.struct((F.col("v1.kind") + 2).alias("kind"), shorter.alias("k")), F.struct((F.col("v1.kind") + 2).alias("kind"), slash.alias("k")))).alias("v2")).where("v2.k IS NOT NULL")
    k = F.col("v2.k")
    tail = F.concat(F.lit(" "), F.upper("state"), F.lit(" "), F.col("pc"))
    bare = F.when(k.endswith(tail), F.concat(F.substring(k, F.lit(1), F.length(k) - F.length(tail)), F.lit(" "), F.col("pc")))
    out = out.select("address_detail_pid", F.explode(F.array(F.struct(F.col("v2.kind").alias("kind"), k.alias("k")), F.struct((F.col("v2.kind") + 4).alias("kind"), bare.alias("k")))).alias("v3")).where("v3.k IS NOT NULL")
    return out.select(F.col("v3.k").alias("lookup_key"), "address_detail_pid", F.col("v3.kind").cast("short").alias("kind")).distinct()


def exact_index(ref: DataFrame, types: StreetTypes | None = None, variants: bool = True) -> DataFrame:
    """The keys that lead to one address: of a key's rows those of its least kind, if they are of a single pid."""
    keys = index_keys(ref, types, variants)
    least = keys.groupBy("lookup_key").agg(F.min("kind").alias("kind"))
    return keys.join(least, ["lookup_key", "kind"]).groupBy("lookup_key", "kind").agg(F.min("address_detail_pid").alias("address_detail_pid"), F.max("address_detail_pid").alias("_z")).where(F.col("address_detail_pid") == F.col("_z")).select("lookup_key", "address_detail_pid", "kind")


def exact_lookup(inputs: DataFrame, index: DataFrame, text_col: str = "input_raw", custom: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """(input_id, address_detail_pid, kind) of inputs whose text is a key. Labels of custom rows are left to matching."""
    keyed = inputs.where(F.col(text_col).isNotNull()).select("input_id", textnorm.exact_key(F.col(text_col)).alias("lookup_key"))
    if custom is not None:
        keyed = keyed.join(custom.where("address_label IS NOT NULL").select(textnorm.exact_key(F.col("address_label")).alias("lookup_key")).distinct(), "lookup_key", "left_anti")
    return keyed.join(index if normalize else index.where("kind = 0"), "lookup_key").select("input_id", "address_detail_pid", "kind")


def same_coordinate_secondaries(ref: DataFrame) -> DataFrame:
    """Pids of secondary rows that lie exactly where their linked primary does, and of all aliases that lead to them.

    The closure grows from its frontier, join by join, until nothing new is found; cycles end by themselves.
    """
    rows = with_columns(ref, ADDRESS_SCHEMA)
    primary = rows.select(F.col("address_detail_pid").alias("primary_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y"))
    second = rows.where(F.upper("primary_secondary").isin("S", "SECONDARY")).select("address_detail_pid", "primary_pid", "longitude", "latitude")
    frontier = second.join(primary, "primary_pid").where((F.col("longitude") == F.col("_x")) & (F.col("latitude") == F.col("_y")) & (F.col("primary_pid") != F.col("address_detail_pid"))).select("address_detail_pid").distinct()
    links = rows.where("alias_type IS NOT NULL AND principal_pid IS NOT NULL").select("address_detail_pid", F.col("principal_pid").alias("_to"))
    found = frontier.persist()
    while True:
        new = links.join(frontier.select(F.col("address_detail_pid").alias("_to")), "_to").select("address_detail_pid").distinct().join(found, "address_detail_pid", "left_anti").persist()
        if new.isEmpty():
            return found
        found, frontier = found.unionByName(new).persist(), new


def collapsed(ref: DataFrame) -> DataFrame:
    """The table without secondaries at their primary's place and without their aliases."""
    return ref.join(same_coordinate_secondaries(ref), "address_detail_pid", "left_anti")


def nearest(todo: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Per todo row (pid, on, longitude, latitude) the postcode of the nearest known row of the same place; ties by pid.

    Places are compared by distinct coordinates on both sides, an equi-join on the place.
    """
    k = known.where("longitude IS NOT NULL AND latitude IS NOT NULL AND postcode IS NOT NULL")
    k = k.groupBy(on, F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).agg(F.min_by("postcode", "address_detail_pid").alias("postcode"), F.min("address_detail_pid").alias("_pid"))
    spots = todo.select(on, "longitude", "latitude").where("longitude IS NOT NULL AND latitude IS NOT NULL").distinct()
    flat = F.pow((F.col("longitude") - F.col("_x")) * F.cos(F.radians("latitude")), F.lit(2)) + F.pow(F.col("latitude") - F.col("_y"), F.lit(2))
    best = spots.join(k, on).groupBy(on, "longitude", "latitude").agg(F.min_by("postcode", F.struct(flat, F.col("_pid"))).alias("postcode"))
    return todo.join(best, [on, "longitude", "latitude"]).select("pid", "postcode")


def rank_first(df: DataFrame, part: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("_n = 1").drop("_n")
