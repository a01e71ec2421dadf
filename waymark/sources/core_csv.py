"""The flat core product: comma-separated files with a header, all columns read as text and cast with care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vocab import mapped
from waymark.operators import indexes
from waymark.operators.scoring import ADDRESS_COLUMNS, ADDRESS_SCHEMA
from waymark.sources.store import Store, added


def flexible_date(text: Column) -> Column:
    """dd-MM-yyyy or yyyy-MM-dd; null for anything else."""
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_date(text, f)) for p, f in ((r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-MM-dd"))])


def read_core(spark: SparkSession, paths: list[str] | str, types: dict[str, str] | None = None) -> DataFrame:
    """Rows of the core product in the address schema; rows that are no CSV are skipped."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"').csv(paths)
    there = {c.lower(): c for c in raw.columns}
    kinds = dict(x.split() for x in ADDRESS_SCHEMA.split(", "))
    out = []
    for c in ADDRESS_COLUMNS:
        text = F.nullif(F.trim(F.col(f"`{there[c]}`")), F.lit("")) if c in there else F.lit(None).cast("string")
        if c == "source":
            value = F.lit("gnaf")
        elif c == "alias_type":
            value = F.lit(None).cast("string")
        elif c == "date_created":
            value = flexible_date(text)
        elif kinds[c] == "int":
            value = text.try_cast("double").try_cast("int")
        else:
            value = text.try_cast(kinds[c])
        out.append(value.alias(c))
    rows = raw.select(*out).where("address_detail_pid IS NOT NULL")
    return rows.withColumn("street_type", mapped(F.upper("street_type"), types)) if types else rows


def load_core(store: Store, paths: list[str] | str, overwrite: bool = False, collapse: bool = False, exact_index: bool = True) -> None:
    """Adds the files to the store in one change; a pid that is there already stays as it is."""
    old = store.table("addresses").select(*ADDRESS_COLUMNS)
    if overwrite:
        old = old.where("source IS NULL OR source <> 'gnaf'")
    rows = added(old, read_core(store.spark, paths, store.types.canonical), ["address_detail_pid"])
    with store.change():
        store.put("addresses", indexes.collapsed(rows) if collapse else rows)
        store.refresh(exact_index or None)
