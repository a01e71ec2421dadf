"""The relational product: eleven pipe-separated tables per state, joined into one address row each, with alias rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vocab import mapped
from waymark.operators import indexes
from waymark.operators.scoring import ADDRESS_COLUMNS, ADDRESS_SCHEMA, with_columns
from waymark.sources.store import Store, added

TABLES = (
    "ADDRESS_DETAIL", "STREET_LOCALITY", "LOCALITY", "STATE", "ADDRESS_ALIAS", "ADDRESS_DEFAULT_GEOCODE", "PRIMARY_SECONDARY", "ADDRESS_SITE", "ADDRESS_MESH_BLOCK_2021", "LOCALITY_ALIAS", "STREET_LOCALITY_ALIAS",
)


def states_in(spark: SparkSession, folder: str) -> list[str]:
    """States with an address table in the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(m[1] for n in names if (m := re.fullmatch(r"([A-Z]{2,3})_ADDRESS_DETAIL_psv\.psv", n)))


class Product:
    def __init__(self, spark: SparkSession, folder: str, states: list[str], types: dict[str, str]) -> None:
        self.spark, self.folder, self.states, self.types = spark, folder.rstrip("/"), states, types

    def table(self, name: str) -> DataFrame:
        """A table of all states: every column trimmed text, retired rows left out."""
        raw = self.spark.read.option("sep", "|").option("header", True).csv([f"{self.folder}/{s}_{name}_psv.psv" for s in self.states])
        rows = raw.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c.upper()) for c in raw.columns])
        return rows.where("DATE_RETIRED IS NULL") if "DATE_RETIRED" in rows.columns else rows

    def one(self, name: str, key: str, columns: dict[str, str]) -> DataFrame:
        """One row per key; of several values the least, so that runs agree."""
        t = with_columns(self.table(name), ", ".join(f"{c} string" for c in {key, *columns.values()}))
        return t.groupBy(key).agg(*[F.min(c).alias(a) for a, c in columns.items()])

    def base(self) -> DataFrame:
        """Details with street, locality and the side tables."""
        need = "BUILDING_NAME LOT_NUMBER_PREFIX LOT_NUMBER LOT_NUMBER_SUFFIX FLAT_TYPE_CODE FLAT_NUMBER_PREFIX FLAT_NUMBER FLAT_NUMBER_SUFFIX LEVEL_TYPE_CODE LEVEL_NUMBER_PREFIX LEVEL_NUMBER LEVEL_NUMBER_SUFFIX NUMBER_FIRST_PREFIX NUMBER_FIRST NUMBER_FIRST_SUFFIX NUMBER_LAST_PREFIX NUMBER_LAST NUMBER_LAST_SUFFIX ALIAS_PRINCIPAL POSTCODE LEGAL_PARCEL_ID ADDRESS_SITE_PID PRIMARY_SECONDARY DATE_CREATED".split()
        d = with_columns(self.table("ADDRESS_DETAIL"), ", ".join(f"{c} string" for c in need))
        s = with_columns(self.table("STREET_LOCALITY"), "STREET_NAME string, STREET_TYPE_CODE string, STREET_SUFFIX_CODE string").select("STREET_LOCALITY_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE")
        l = self.table("LOCALITY").select("LOCALITY_PID", "LOCALITY_NAME", "STATE_PID")
        st = self.table("STATE").select("STATE_PID", "STATE_ABBREVIATION").distinct()
        g = self.one("ADDRESS_DEFAULT_GEOCODE", "ADDRESS_DETAIL_PID", {"longitude": "LONGITUDE", "latitude": "LATITUDE", "geocode_type": "GEOCODE_TYPE_CODE"})
        p = self.one("PRIMARY_SECONDARY", "SECONDARY_PID", {"primary_pid": "PRIMARY_PID"}).withColumnRenamed("SECONDARY_PID", "ADDRESS_DETAIL_PID")
        a = self.table("ADDRESS_ALIAS").groupBy(F.col("ALIAS_PID").alias("ADDRESS_DETAIL_PID")).agg(F.min("PRINCIPAL_PID").alias("alias_of"), F.max("ALIAS_TYPE_CODE").alias("alias_code"))
        site = self.one("ADDRESS_SITE", "ADDRESS_SITE_PID", {"address_site_name": "ADDRESS_SITE_NAME"})
        mb = self.one("ADDRESS_MESH_BLOCK_2021", "ADDRESS_DETAIL_PID", {"mb_code": "MB_2021_PID"})
        out = d.join(s, "STREET_LOCALITY_PID").join(l, "LOCALITY_PID").join(st, "STATE_PID")
        for side, key in ((g, "ADDRESS_DETAIL_PID"), (p, "ADDRESS_DETAIL_PID"), (a, "ADDRESS_DETAIL_PID"), (site, "ADDRESS_SITE_PID"), (mb, "ADDRESS_DETAIL_PID")):
            out = out.join(side, key, "left")
        return out

    def rows(self, base: DataFrame, pid: Column, alias: Column, principal: Column, street: Column, kind: Column, suffix: Column, locality: Column, postcode: Column) -> DataFrame:
        """Address rows of base with street and place as given."""
        whole = lambda *c: F.nullif(F.concat_ws("", *c), F.lit(""))
        number = lambda n: F.when(F.col(f"NUMBER_{n}").isNotNull(), F.concat_ws("", f"NUMBER_{n}_PREFIX", f"NUMBER_{n}", f"NUMBER_{n}_SUFFIX"))
        span = F.concat(number("FIRST"), F.coalesce(F.concat(F.lit("-"), number("LAST")), F.lit("")))
        lot, flat = whole("LOT_NUMBER_PREFIX", "LOT_NUMBER", "LOT_NUMBER_SUFFIX"), whole("FLAT_NUMBER_PREFIX", "FLAT_NUMBER", "FLAT_NUMBER_SUFFIX")
        level = whole("LEVEL_NUMBER_PREFIX", "LEVEL_NUMBER", "LEVEL_NUMBER_SUFFIX")
        full = mapped(kind, self.types)
        line = F.concat_ws(
            " ", "BUILDING_NAME", F.when(F.col("NUMBER_FIRST").isNull() & lot.isNotNull(), F.concat(F.lit("LOT "), lot)), F.when(flat.isNotNull(), F.concat_ws(" ", "FLAT_TYPE_CODE", flat)),
            F.when(level.isNotNull() | F.col("LEVEL_TYPE_CODE").isNotNull(), F.concat_ws(" ", F.coalesce("LEVEL_TYPE_CODE", F.lit("LEVEL")), level)), span, street, full, suffix,
        )
        values = {
            "address_detail_pid": pid, "address_label": F.concat_ws(", ", line, F.concat_ws(" ", locality, "STATE_ABBREVIATION", postcode)), "address_site_name": F.col("address_site_name"), "building_name": F.col("BUILDING_NAME"),
            "flat_type": F.col("FLAT_TYPE_CODE"), "flat_number": flat, "level_type": F.col("LEVEL_TYPE_CODE"), "level_number": F.col("LEVEL_NUMBER"), "number_first": F.col("NUMBER_FIRST"), "number_last": F.col("NUMBER_LAST"), "lot_number": lot,
            "street_name": street, "street_type": full, "street_suffix": suffix, "locality_name": locality, "state": F.col("STATE_ABBREVIATION"), "postcode": postcode, "longitude": F.col("longitude"), "latitude": F.col("latitude"), "source": F.lit("gnaf"),
            "alias_type": alias, "date_created": F.to_date(F.substring("DATE_CREATED", 1, 10)), "legal_parcel_id": F.col("LEGAL_PARCEL_ID"), "mb_code": F.col("mb_code"), "alias_principal": F.when(F.col("ALIAS_PRINCIPAL") == "A", "ALIAS").otherwise("PRINCIPAL"),
            "principal_pid": principal, "primary_secondary": F.col("PRIMARY_SECONDARY"), "primary_pid": F.col("primary_pid"), "geocode_type": F.col("geocode_type"),
        }
        kinds = dict(x.split() for x in ADDRESS_SCHEMA.split(", "))
        return base.select(*[(v.try_cast(kinds[c]) if kinds[c] in ("int", "double") else v.cast(kinds[c])).alias(c) for c, v in values.items()])

    def addresses(self, aliases: bool = True) -> DataFrame:
        col, base = F.col, self.base()
        own = (col("STREET_NAME"), col("STREET_TYPE_CODE"), col("STREET_SUFFIX_CODE"), col("LOCALITY_NAME"), col("POSTCODE"))
        alias = F.when(col("ALIAS_PRINCIPAL") == "A", F.concat(F.lit("ADDRESS:"), F.coalesce("alias_code", F.lit("SYN"))))
        main = base if aliases else base.where("ALIAS_PRINCIPAL IS NULL OR ALIAS_PRINCIPAL = 'P'")
        out = self.rows(main, col("ADDRESS_DETAIL_PID"), alias, col("alias_of"), *own)
        if not aliases:
            return out
        principal = base.where("ALIAS_PRINCIPAL = 'P'")
        la = with_columns(self.table("LOCALITY_ALIAS"), "POSTCODE string, ALIAS_TYPE_CODE string").select("LOCALITY_PID", "LOCALITY_ALIAS_PID", col("NAME").alias("_name"), col("POSTCODE").alias("_pc"), col("ALIAS_TYPE_CODE").alias("_code"))
        both = principal.join(la, "LOCALITY_PID")
        out = out.unionByName(self.rows(both, F.concat_ws("_LA", "ADDRESS_DETAIL_PID", "LOCALITY_ALIAS_PID"), F.concat(F.lit("LOCALITY:"), F.coalesce("_code", F.lit("SYN"))), col("ADDRESS_DETAIL_PID"), *own[:3], col("_name"), F.coalesce("_pc", "POSTCODE")))
        sa = with_columns(self.table("STREET_LOCALITY_ALIAS"), "STREET_TYPE_CODE string, STREET_SUFFIX_CODE string, ALIAS_TYPE_CODE string").select("STREET_LOCALITY_PID", "STREET_LOCALITY_ALIAS_PID", col("STREET_NAME").alias("_name"), col("STREET_TYPE_CODE").alias("_type"), col("STREET_SUFFIX_CODE").alias("_suffix"), col("ALIAS_TYPE_CODE").alias("_code"))
        both = principal.join(sa, "STREET_LOCALITY_PID")
        return out.unionByName(self.rows(both, F.concat_ws("_SA", "ADDRESS_DETAIL_PID", "STREET_LOCALITY_ALIAS_PID"), F.concat(F.lit("STREET:"), F.coalesce("_code", F.lit("SYN"))), col("ADDRESS_DETAIL_PID"), col("_name"), col("_type"), col("_suffix"), own[3], own[4]))


def load_standard(store: Store, folder: str, states: list[str] | str = "all", overwrite: bool = False, aliases: bool = True, collapse: bool = False, exact_index: bool = True) -> None:
    """Loads states, all tables of all states in one plan and one change."""
    states = states_in(store.spark, folder) if states == "all" else ([states] if isinstance(states, str) else list(states))
    if not states:
        raise FileNotFoundError(f"no state tables in {folder}")
    rows = Product(store.spark, folder, states, store.types.canonical).addresses(aliases)
    old = store.table("addresses").select(*ADDRESS_COLUMNS)
    if overwrite:
        old = old.where(~(F.col("state").isin(states) & (F.col("source") == "gnaf")))
    rows = added(old, rows, ["address_detail_pid"])
    with store.change():
        store.put("addresses", indexes.collapsed(rows) if collapse else rows, ["state"])
        store.refresh(exact_index or None)


def build(store: Store, folder: str, states: list[str] | str = "all") -> DataFrame:
    """From files to a store ready for matching; returns its status."""
    load_standard(store, folder, states)
    store.build_street_only()
    return store.status()
