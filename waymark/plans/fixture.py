"""Address-shaped tables derived from the star-schema tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ADDR_REF = """
SELECT 'C' || lpad(CAST(c.c_custkey AS STRING), 9, '0') AS address_detail_pid,
       CAST(c.c_custkey % 97 + 1 AS INT) AS number_first,
       CASE WHEN c.c_custkey % 7 = 0 THEN CAST(c.c_custkey % 97 + 7 AS INT) END AS number_last,
       CASE WHEN c.c_custkey % 5 = 0 THEN 'UNIT' END AS flat_type,
       CASE WHEN c.c_custkey % 5 = 0 THEN CAST(c.c_custkey % 30 + 1 AS STRING) END AS flat_number,
       upper(p.p_name) AS street_name,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 4 = 0 THEN 'STREET'
            WHEN c.c_custkey % 4 = 1 THEN 'ROAD' WHEN c.c_custkey % 4 = 2 THEN 'AVENUE' ELSE 'COURT' END AS street_type,
       replace(n.n_name, '_', ' ') AS locality_name,
       CASE r.r_name WHEN 'AFRICA' THEN 'QLD' WHEN 'AMERICA' THEN 'NSW' WHEN 'ASIA' THEN 'VIC'
            WHEN 'EUROPE' THEN 'SA' ELSE 'WA' END AS state,
       CAST(4000 + c.c_nationkey * 3 AS INT) AS postcode,
       CASE WHEN c.c_custkey % 11 = 0 AND c.c_custkey > 0 THEN 'STREET:SYN' END AS alias_type,
       CASE WHEN c.c_custkey % 11 = 0 AND c.c_custkey > 0
            THEN 'C' || lpad(CAST(c.c_custkey - 1 AS STRING), 9, '0') END AS principal_pid,
       CAST(140 + c.c_nationkey AS DOUBLE) AS longitude, CAST(-30 + c.c_custkey % 10 AS DOUBLE) AS latitude
FROM {customer} c
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
JOIN {part} p ON p.p_partkey = (c.c_custkey * 7) % 120
"""
ADDR_IN = """
SELECT o.o_orderkey AS input_id,
       CAST(CASE WHEN o.o_orderkey % 8 = 5 THEN NULL WHEN o.o_orderkey % 8 = 4 THEN a.postcode + 1 ELSE a.postcode END AS INT) AS in_postcode,
       a.state AS in_state,
       CASE WHEN o.o_orderkey % 8 = 3 THEN substr(a.locality_name, 1, 1) || substr(a.locality_name, 3)
            ELSE a.locality_name END AS in_locality,
       CASE WHEN o.o_orderkey % 8 = 1 THEN substr(a.street_name, 1, 1) || substr(a.street_name, 3)
            WHEN o.o_orderkey % 8 = 2 THEN substr(a.street_name, 1, 1) || substr(a.street_name, 3, 1)
                 || substr(a.street_name, 2, 1) || substr(a.street_name, 4)
            ELSE a.street_name END AS in_street_name,
       CASE WHEN o.o_orderkey % 8 = 7 THEN NULL ELSE a.street_type END AS in_street_type,
       CAST(CASE WHEN o.o_orderkey % 8 = 6 THEN a.number_first + 1 ELSE a.number_first END AS INT) AS in_number_first,
       CASE WHEN o.o_orderkey % 8 = 0 THEN a.number_last END AS in_number_last,
       a.flat_type AS in_flat_type,
       CASE WHEN o.o_orderkey % 8 = 7 THEN NULL ELSE a.flat_number END AS in_flat_number
FROM {orders} o
JOIN {addr_ref} a ON a.address_detail_pid = 'C' || lpad(CAST(o.o_custkey AS STRING), 9, '0')
"""
LABEL = """concat_ws(', ', concat_ws(' ', CASE WHEN flat_number IS NOT NULL THEN flat_type || ' ' || flat_number END,
       CAST(number_first AS STRING) || coalesce('-' || CAST(number_last AS STRING), ''), street_name, street_type), locality_name || ' ' || state || ' ' || CAST(postcode AS STRING))"""


class Tables(dict):
    """Tables of a folder, read when first asked for; sql() runs a statement over them and over derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        made = {"addr_ref": self.addr_ref, "addr_in": self.addr_in}.get(name)
        self[name] = made() if made else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in names})

    def addr_ref(self) -> DataFrame:
        out = self.sql(ADDR_REF, "customer", "nation", "region", "part")
        return out.selectExpr("*", f"{LABEL} AS address_label", "'gnaf' AS source")

    def addr_in(self) -> DataFrame:
        return self.sql(ADDR_IN, "orders", "addr_ref")


def _plain(text: str) -> str:
    for name in ("customer", "nation", "region", "part", "orders", "addr_ref"):
        text = text.replace("{" + name + "}", name)
    return text


#: The same views as common table expressions, for DuckDB.
PREFIX = f"""WITH addr_ref AS (SELECT *, {LABEL} AS address_label, 'gnaf' AS source FROM ({_plain(ADDR_REF)}) q),
addr_in AS ({_plain(ADDR_IN)})"""
