"""A versioned store of Parquet tables: every change stages whole new versions and then writes one more manifest.

Manifests are numbered and never overwritten or deleted: readers take the highest that is whole, so a failed change, or a
crash at any point, leaves the store as it was. Two writers that start from the same manifest cannot both write the next
one: the later fails. Paths may lie in any file system that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vocab import StreetTypes, mapped
from waymark.operators import indexes, localities, scoring
from waymark.operators.scoring import ADDRESS_COLUMNS, ADDRESS_SCHEMA

CACHE_SCHEMA = "input_standardised string, address_detail_pid string, total_score int, " + ", ".join(f"score_{c} int" for c in scoring.COMPONENTS) + ", algorithm_version int, cached_at timestamp"
SCHEMAS = {
    "addresses": ADDRESS_SCHEMA, "custom": ADDRESS_SCHEMA, "locality_index": "locality_name string, postcode int, state string", "street_split": "street_name string, effective_name string, effective_type string",
    "exact_index": "lookup_key string, address_detail_pid string, kind short", "match_cache": CACHE_SCHEMA, "geographies": "name string, source string, columns array<string>, points_crs string, created_at timestamp",
}
SYSTEM_TABLES = frozenset(SCHEMAS)


def without_keys(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Deletes rows by key."""
    return old.join(keys.select(*on).distinct(), on, "left_anti").select(*old.columns)


def upserted(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key, one stays."""
    return without_keys(old, new, on).unionByName(new.dropDuplicates(on).select(*old.columns))


def added(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """New rows whose key is not there yet; others change nothing."""
    return old.unionByName(without_keys(new, old, on).dropDuplicates(on).select(*old.columns))


class ReadOnlyError(RuntimeError):
    pass


class ConflictError(RuntimeError):
    pass


EMPTY = {"version": 0, "tables": {}, "meta": {}}


def column_statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column_name, n, filled, kinds) of a frame: all columns in one pass; kinds are estimated unless they must be exact."""
    kinds = F.count_distinct if exact else F.approx_count_distinct
    sums = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"f_{c}") for c in df.columns], *[kinds(c).alias(f"d_{c}") for c in df.columns])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("kinds")) for c in df.columns])
    return sums.select(F.explode(each).alias("x")).select("x.*")


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, types: StreetTypes | None = None) -> None:
        self.spark, self.root, self.read_only, self.types = spark, root.rstrip("/"), read_only, types or StreetTypes.common()
        self.jvm, self._staged = spark.sparkContext._jvm, None
        if not read_only and not self._versions():
            self._write(0, json.dumps(EMPTY))

    # files

    def _fs(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> str | None:
        fs, path = self._fs(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, version: int, text: str) -> None:
        """Writes the manifest of a version beside its place and renames it there; fails if the version is there already."""
        fs, path = self._fs(f"manifests/{version:012d}.json")
        spare = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(spare, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(spare, path):
            fs.delete(spare, False)
            raise ConflictError(f"version {version} of {self.root} was written by someone else")

    def _versions(self) -> list[int]:
        fs, path = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    @property
    def manifest(self) -> dict:
        versions = self._versions()
        return json.loads(self._read(f"manifests/{versions[-1]:012d}.json")) if versions else json.loads(json.dumps(EMPTY))

    def close(self) -> None:
        """Ends the use of this store; further calls fail. What was written stays."""
        self.root, self.read_only = None, True

    # tables

    def table(self, name: str) -> DataFrame:
        """The current version; an empty frame before the first; columns that an old version lacks come as nulls."""
        found = (self._staged or self.manifest)["tables"].get(name)
        schema = SCHEMAS.get(name)
        if found is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(f"{self.root}/{found}")
        return scoring.with_columns(df, schema) if schema and "array" not in schema else df

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Stages a new version; outside a change() it is swapped in at once."""
        if self.read_only:
            raise ReadOnlyError("the store was opened read-only")
        if self._staged is None:
            with self.change():
                self.put(name, df, partition_by)
            return
        path = f"{name}/{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{path}")
        self._staged["tables"][name] = path

    @contextmanager
    def change(self) -> Iterator["Store"]:
        """All that is put inside becomes visible together, or not at all."""
        if self.read_only:
            raise ReadOnlyError("the store was opened read-only")
        if self._staged is not None:
            yield self
            return
        self._staged = self.manifest
        try:
            yield self
            staged = self._staged
            staged["version"] += 1
            self._write(staged["version"], json.dumps(staged))
        finally:
            self._staged = None

    def note(self, key: str, value) -> None:
        with self.change():
            self._staged["meta"][key] = value

    def meta(self, key: str, default=None):
        return (self._staged or self.manifest)["meta"].get(key, default)

    # the tables together

    def reference(self, custom: bool = True) -> DataFrame:
        rows = self.table("addresses").select(*ADDRESS_COLUMNS)
        return rows.unionByName(self.table("custom").select(*ADDRESS_COLUMNS)) if custom else rows

    def refresh(self, exact_index: bool | None = None) -> None:
        """Rebuilds what is derived from addresses and drops the match cache."""
        from waymark.functions.parser import split_untyped

        with self.change():
            self.put("locality_index", localities.locality_index(self.table("addresses"), self.table("custom")))
            self.put("street_split", split_untyped(self.reference(), self.types))
            if exact_index or (exact_index is None and self.meta("exact_index_of") is not None):
                variants = bool(self.meta("exact_variants", True))
                self.put("exact_index", indexes.exact_index(self.table("addresses"), self.types, variants))
                self._staged["meta"]["exact_index_of"] = self._staged["tables"].get("addresses")
            self._staged["tables"].pop("match_cache", None)

    def exact_index(self) -> DataFrame | None:
        """The exact-label index, if it was built from the addresses as they are."""
        fresh = self.meta("exact_index_of") is not None and self.meta("exact_index_of") == self.manifest["tables"].get("addresses")
        return self.table("exact_index") if fresh else None

    def canonicalise_street_types(self) -> None:
        with self.change():
            for name in ("addresses", "custom"):
                self.put(name, self.table(name).withColumn("street_type", mapped(F.col("street_type"), self.types.canonical)))
            self.refresh()

    def build_street_only(self) -> None:
        with self.change():
            rows = self.table("addresses").where("alias_type IS NULL OR alias_type <> 'street_only'").select(*ADDRESS_COLUMNS)
            self.put("addresses", rows.unionByName(indexes.street_only_rows(rows)))
            self.refresh()

    def status(self) -> DataFrame:
        """Rows of the two address tables; null for one that was never written."""
        there = self.manifest["tables"]
        rows = [self.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) if n in there else self.spark.createDataFrame([(n, None)], "table_name string, n long") for n in ("addresses", "custom")]
        return rows[0].unionByName(rows[1])

    def sample(self, n: int, seed: int | None = None) -> dict[str, DataFrame]:
        """n random rows of every table."""
        return {name: self.table(name).orderBy(F.rand(seed)).limit(n) for name in self.manifest["tables"]}

    def statistics(self, name: str) -> DataFrame:
        """Per column of a table: rows, filled values and distinct values (approximate), in one pass."""
        return column_statistics(self.table(name))

    def export_csv(self, df: DataFrame, path: str, one_file: bool = False) -> None:
        """Writes rows as CSV with a header, nulls as empty fields: a folder of files, or of one file."""
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes])
        (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)

    # custom rows

    def add_custom(self, rows: DataFrame, upsert: bool = True) -> None:
        """Adds or replaces custom addresses; text is upper-cased, missing pids are made, a label is built if missing."""
        kinds = dict(x.split() for x in ADDRESS_SCHEMA.split(", "))
        rows = scoring.with_columns(rows, ADDRESS_SCHEMA).select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in ADDRESS_COLUMNS])
        if not rows.where("street_name IS NULL AND address_label IS NULL").isEmpty():
            raise ValueError("custom rows need a street_name or an address_label")
        for c in ADDRESS_COLUMNS:
            if kinds[c] == "string" and c not in ("alias_type", "source"):
                rows = rows.withColumn(c, F.upper(F.trim(c)))
        number = F.concat(F.col("number_first").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("number_last").cast("string")), F.lit("")))
        line = F.concat_ws(" ", "building_name", F.concat_ws(" ", "flat_type", "flat_number"), number, "street_name", "street_type", "street_suffix")
        label = F.concat_ws(", ", F.trim(F.regexp_replace(line, " +", " ")), F.nullif(F.concat_ws(" ", "locality_name", "state", F.col("postcode").cast("string")), F.lit("")))
        rows = rows.withColumns({"address_label": F.coalesce("address_label", label), "source": F.lit("custom"), "street_type": mapped(F.col("street_type"), self.types.canonical)})
        old = self.table("custom").select(*ADDRESS_COLUMNS)
        named = rows.where("address_detail_pid IS NOT NULL")
        unnamed = rows.where("address_detail_pid IS NULL").drop("address_detail_pid").distinct()
        digest = F.conv(F.substring(F.md5(F.to_json(F.struct(*unnamed.columns))), 1, 15), 16, 10)  # equal rows, equal pids
        named = named.unionByName(unnamed.withColumn("address_detail_pid", F.concat(F.lit("CUSTOM_"), digest)).select(*ADDRESS_COLUMNS))
        with self.change():
            self.put("custom", (upserted if upsert else added)(old, named, ["address_detail_pid"]))
            self.refresh()

    def remove_custom(self, pids: DataFrame) -> None:
        with self.change():
            self.put("custom", without_keys(self.table("custom").select(*ADDRESS_COLUMNS), pids, ["address_detail_pid"]))
            self.refresh()

    # geographies

    def add_geography(self, name: str, layer: DataFrame, columns: list[str] | None = None, source: str = "addresses", points_crs: str = "EPSG:7844") -> None:
        """Registers attributes by address_detail_pid under a name."""
        import re

        if not re.fullmatch("[A-Za-z][A-Za-z0-9_]*", name) or name.lower() in SYSTEM_TABLES:
            raise ValueError(f"{name} is no name for a geography")
        name = name.lower()
        columns = columns or [c for c in layer.columns if c != "address_detail_pid"]
        if "address_detail_pid" not in layer.columns or layer.select("address_detail_pid").groupBy("address_detail_pid").count().where("count > 1").limit(1).count():
            raise ValueError("a geography has one row per address_detail_pid")
        with self.change():
            self.put(f"geo_{name}", layer.select("address_detail_pid", *columns))
            self._staged["meta"].setdefault("geographies", {})[name] = {"source": source, "columns": columns, "points_crs": points_crs}

    def list_geographies(self) -> dict[str, dict]:
        return dict(self.meta("geographies", {}))

    def remove_geography(self, name: str) -> None:
        with self.change():
            self._staged["meta"].get("geographies", {}).pop(name.lower(), None)
            self._staged["tables"].pop(f"geo_{name.lower()}", None)

    def join_geographies(self, results: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Adds the attributes of layers to matched rows."""
        known = self.list_geographies()
        for name in names or list(known):
            spec = known[name.lower()]
            clash = set(spec["columns"]) & set(results.columns)
            if clash:
                raise ValueError(f"columns {sorted(clash)} are there already")
            results = results.join(self.table(f"geo_{name.lower()}"), "address_detail_pid", "left")
        return results
