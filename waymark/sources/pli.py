"""A second source of addresses (a pipe-separated property list), reconciled with the reference in a funnel."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.vocab import mapped, score_flat_types
from waymark.operators import geo, indexes
from waymark.operators.scoring import ADDRESS_COLUMNS, ADDRESS_SCHEMA, with_columns
from waymark.sources.store import Store

# Fixed values of the list's format.
SUFFIX_CODES = {"EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S", "CENTRAL": "CN"}
NO_LOT = ("0", "9999")
DATUMS = ("GDA94", "GDA2020")
COLUMNS = (
    "address_pid plan lot lotplan_status address_status address_standard unit_type unit_number unit_suffix property_name street_no_1 street_no_1_suffix street_no_2 street_no_2_suffix "
    "street_name street_type street_suffix locality local_authority lga_code latitude longitude geocode_type datum"
).split()


def text_file(path: str, spare: str) -> str:
    """The list itself, or the one text file of a zip, unpacked to a folder that executors read as well."""
    if not path.lower().endswith(".zip"):
        return path
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".txt")]
        if len(names) != 1:
            raise ValueError(f"{path} must hold exactly one text file")
        return z.extract(names[0], os.path.join(spare, "pli"))


def read_pli(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; the header must name the columns in order (a byte-order mark is allowed)."""
    columns = columns or COLUMNS
    head = spark.read.text(path).first()
    found = [c.strip().lower() for c in (head[0] if head else "").lstrip("﻿").rstrip("\r").split("|")]
    if found != columns:
        raise ValueError(f"the header of {path} is not {'|'.join(columns)}")
    return spark.read.option("sep", "|").option("header", True).option("quote", "").schema(", ".join(f"{c} string" for c in columns)).csv(path)


def cleaned(raw: DataFrame, statuses: tuple[str, ...] = ("P", "H"), deleted_lotplans: bool = False) -> DataFrame:
    """Trimmed upper case, one row per address_pid; rows of other statuses and, unless asked for, of deleted lot-plans
    are left out."""
    rows = raw.select(*[F.nullif(F.upper(F.trim(c)), F.lit("")).alias(c) for c in raw.columns])
    rows = rows.where(F.col("address_status").isin(*statuses) & F.col("street_name").isNotNull())
    if not deleted_lotplans:
        rows = rows.where(F.coalesce(F.col("lotplan_status"), F.lit("")) != "D")
    rows = rows.withColumns({
        "street_type": F.nullif("street_type", F.lit("XXX")), "street_suffix": mapped(F.col("street_suffix"), SUFFIX_CODES), "locality_name": F.trim(F.regexp_replace("locality", r" *\([^)]*\)$", "")),
        "lot": F.when(~F.col("lot").isin(*NO_LOT), F.col("lot")),
    })
    order = [(F.col("geocode_type") == "PC").desc_nulls_last(), (F.col("lotplan_status") == "C").desc_nulls_last(), F.col("plan").asc_nulls_last(), F.col("lot").asc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in ("latitude", "longitude") if c in rows.columns]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("address_pid").orderBy(*order))).where("_n = 1").drop("_n")


def with_postcodes(rows: DataFrame, ref: DataFrame) -> DataFrame:
    """Postcode of a locality with a single one; else of its street with a single one; else null."""
    loc = ref.where("locality_name IS NOT NULL").groupBy("locality_name").agg(F.min("postcode").alias("_a"), F.max("postcode").alias("_z")).select("locality_name", F.when(F.col("_a") == F.col("_z"), F.col("_a")).alias("_loc"))
    keys = ["locality_name", "street_name", "street_type"]
    street = ref.groupBy(*keys).agg(F.min("postcode").alias("_a"), F.max("postcode").alias("_z")).where("_a = _z").select(*keys, F.col("_a").alias("_str"))
    return rows.join(loc, "locality_name", "left").join(street, keys, "left").withColumn("postcode", F.coalesce("_loc", "_str")).drop("_loc", "_str")


def classified(rows: DataFrame, reference_keys: DataFrame, loaded: DataFrame | None = None, relaxed_keys: DataFrame | None = None) -> DataFrame:
    """Adds status: the reason a row cannot be used, in_reference, in_reference_relaxed, already_loaded, duplicate_label
    or added. rows: address_pid, label_key, reason (and core_key with relaxed_keys)."""
    out = rows.join(reference_keys.select("label_key").distinct().withColumn("_ref", F.lit(True)), "label_key", "left")
    relaxed = F.lit(None).cast("boolean")
    if relaxed_keys is not None:
        out = out.join(relaxed_keys.select("core_key").distinct().withColumn("_rel", F.lit(True)), "core_key", "left")
        relaxed = F.col("_rel")
    there = F.lit(None).cast("boolean")
    if loaded is not None:
        out = out.join(loaded.select("address_pid").distinct().withColumn("_old", F.lit(True)), "address_pid", "left")
        there = F.col("_old")
    first = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_ref"), "in_reference").when(relaxed, "in_reference_relaxed").when(there, "already_loaded").otherwise("added")
    out = out.withColumn("_s", first)
    n = F.row_number().over(Window.partitionBy("_s", "label_key").orderBy("address_pid"))
    return out.withColumn("status", F.when((F.col("_s") == "added") & (n > 1), "duplicate_label").otherwise(F.col("_s"))).drop("_s", "_ref", "_rel", "_old")


def address_rows(rows: DataFrame) -> DataFrame:
    """Cleaned rows with a postcode in the address schema, with label, keys and reason."""
    col = F.col
    unit = F.nullif(F.concat_ws("", "unit_number", "unit_suffix"), F.lit(""))
    first, last = col("street_no_1").try_cast("int"), col("street_no_2").try_cast("int")
    said = F.concat(F.concat_ws("", first.cast("string"), "street_no_1_suffix"), F.when(last.isNotNull(), F.concat(F.lit("-"), F.concat_ws("", last.cast("string"), "street_no_2_suffix"))).otherwise(""))
    kind = F.when(unit.isNotNull(), F.coalesce("unit_type", F.lit("UNIT")))
    front = F.concat_ws(" ", "property_name", F.concat_ws(" ", kind, unit), F.when(first.isNotNull(), said).when(col("lot").isNotNull(), F.concat(F.lit("LOT "), col("lot"))), "street_name", "street_type", "street_suffix")
    label = F.concat_ws(", ", F.trim(F.regexp_replace(front, " +", " ")), F.concat_ws(" ", "locality_name", F.lit("QLD"), F.lpad(col("postcode").cast("string"), 4, "0")))
    reason = F.when(unit.isNotNull() & ~unit.rlike("^[A-Z]?[0-9]+[A-Z]?$"), "unparseable_unit").when(first.isNull() & col("lot").isNull(), "no_number_or_lot").when(col("postcode").isNull(), "no_postcode")
    lon, lat = col("longitude").try_cast("double"), col("latitude").try_cast("double")
    lon2, lat2 = geo.gda94_to_gda2020(lon, lat)
    old = col("datum") == "GDA94"
    core = F.concat_ws("|", mapped(F.coalesce(kind, F.lit("")), score_flat_types()), F.coalesce(unit, F.lit("")), F.coalesce(F.when(first.isNotNull(), said), col("lot"), F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("street_name", "street_type", "locality_name", "postcode")])
    made = rows.select(
        "address_pid", F.concat(F.lit("PLI"), "address_pid").alias("address_detail_pid"), label.alias("address_label"), textnorm.exact_key(label).alias("label_key"), core.alias("core_key"), reason.alias("reason"), col("property_name").alias("building_name"),
        kind.alias("flat_type"), unit.alias("flat_number"), first.alias("number_first"), last.alias("number_last"), F.when(first.isNull(), col("lot")).alias("lot_number"), "street_name", "street_type", "street_suffix", "locality_name", F.lit("QLD").alias("state"), "postcode",
        F.when(old, lon2).otherwise(lon).alias("longitude"), F.when(old, lat2).otherwise(lat).alias("latitude"), F.lit("pli").alias("source"),
    )
    return with_columns(made, ADDRESS_SCHEMA)


def core_keys(ref: DataFrame) -> DataFrame:
    """The relaxed keys of reference rows: no building, flat types alike."""
    col = F.col
    span = F.concat(col("number_first").cast("string"), F.coalesce(F.concat(F.lit("-"), col("number_last").cast("string")), F.lit("")))
    kind = F.coalesce(col("flat_type"), F.when(col("flat_number").isNotNull(), "UNIT"), F.lit(""))
    return ref.select(F.concat_ws("|", mapped(kind, score_flat_types()), F.coalesce("flat_number", F.lit("")), F.coalesce(span, "lot_number", F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("street_name", "street_type", "locality_name", "postcode")]).alias("core_key"))


def load_pli(store: Store, path: str, statuses: tuple[str, ...] = ("P", "H"), overwrite: bool = False, deleted_lotplans: bool = False) -> DataFrame:
    """Reconciles a list with the store and adds what is new; returns the funnel (status, n, pct)."""
    raw = read_pli(store.spark, text_file(path, store.root))
    if not raw.where(F.col("datum").isNotNull() & ~F.upper(F.trim("datum")).isin(*DATUMS)).isEmpty():
        raise ValueError(f"coordinates must be of {' or '.join(DATUMS)}")
    ref = store.table("addresses").select(*ADDRESS_COLUMNS)
    rest = ref.where("source IS NULL OR source <> 'pli'")
    if overwrite:
        ref = rest
    rows = with_postcodes(cleaned(raw, statuses, deleted_lotplans), rest)
    todo = rows.where("postcode IS NULL").select(F.col("address_pid").alias("pid"), "locality_name", F.col("longitude").try_cast("double").alias("longitude"), F.col("latitude").try_cast("double").alias("latitude"))
    near = indexes.nearest(todo, rest, "locality_name").select(F.col("pid").alias("address_pid"), F.col("postcode").alias("_near"))
    rows = rows.join(near, "address_pid", "left").withColumn("postcode", F.coalesce("postcode", "_near")).drop("_near")
    there = rest.select(textnorm.exact_key(F.col("address_label")).alias("label_key"))
    loaded = ref.where("source = 'pli'").select(F.regexp_replace("address_detail_pid", "^PLI", "").alias("address_pid"))
    marked = classified(address_rows(rows), there, loaded, core_keys(rest)).persist()
    new = marked.where("status = 'added'").select(*ADDRESS_COLUMNS)
    if not new.join(rest.select("address_detail_pid"), "address_detail_pid", "left_semi").isEmpty():
        raise ValueError("pids of the list clash with the reference")
    with store.change():
        store.put("addresses", ref.unionByName(new))
        store.refresh()
    counts = marked.groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))
