import datetime
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_matching import COLUMNS, REF
from waymark.operators import calibrate, diagnostics, simulate
from waymark.operators.scoring import ADDRESS_SCHEMA, with_columns
from waymark.plans.match_text import match_store
from waymark.sources import cache, core_csv, pli, shapefile, standard_psv
from waymark.sources.store import ReadOnlyError, Store, added, upserted
from waymark.streaming.incremental import match_stream, outcome_counts


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def ref(spark):
    return with_columns(spark.createDataFrame(REF, COLUMNS).withColumn("source", F.lit("gnaf")), ADDRESS_SCHEMA).select(*[x.split()[0] for x in ADDRESS_SCHEMA.split(", ")]).cache()


def test_keyed_writes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, added(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]


def test_core_csv(spark, store, tmp_path):
    head = "ADDRESS_DETAIL_PID,ADDRESS_LABEL,FLAT_NUMBER,NUMBER_FIRST,STREET_NAME,STREET_TYPE,LOCALITY_NAME,STATE,POSTCODE,LONGITUDE,LATITUDE,DATE_CREATED"
    f = tmp_path / "core.csv"
    f.write_text(f'{head}\nG1,"UNIT 01 10 MAIN RD, X QLD 4000",01,10,MAIN,RD,X,QLD,4000,153.0,-27.0,2020-02-03\nG2,"12 MAIN RD, X QLD 4000",,12,MAIN,RD,X,QLD,4000,oops,-27.0,03-02-2020\nG1,"again",,1,A,RD,X,QLD,4000,1,1,\n')
    core_csv.load_core(store, str(f))
    rows = {r["address_detail_pid"]: r for r in store.table("addresses").collect()}
    assert set(rows) == {"G1", "G2"} and rows["G2"]["longitude"] is None and rows["G2"]["street_type"] == "ROAD"
    assert rows["G2"]["date_created"] == datetime.date(2020, 2, 3) and store.exact_index() is not None
    assert [tuple(r) for r in store.table("locality_index").collect()] == [("X", 4000, "QLD")]
    core_csv.load_core(store, str(f))
    assert store.table("addresses").count() == 2 and {tuple(r) for r in store.status().collect()} == {("addresses", 2), ("custom", None)}
    with pytest.raises(ReadOnlyError):
        core_csv.load_core(Store(spark, store.root, read_only=True), str(f))
    before = store.manifest
    with pytest.raises(ZeroDivisionError), store.change():
        store.put("custom", store.table("custom"))
        1 / 0
    assert store.manifest == before


def psv(folder, state, name, head, rows):
    (folder / f"{state}_{name}_psv.psv").write_text("\n".join([head, *rows]) + "\n")


def write_psv(folder, state):
    p = state
    psv(folder, p, "ADDRESS_DETAIL", "ADDRESS_DETAIL_PID|DATE_CREATED|DATE_RETIRED|BUILDING_NAME|FLAT_TYPE_CODE|FLAT_NUMBER|NUMBER_FIRST|NUMBER_FIRST_SUFFIX|STREET_LOCALITY_PID|LOCALITY_PID|ALIAS_PRINCIPAL|POSTCODE|PRIMARY_SECONDARY|ADDRESS_SITE_PID", [f"{p}P|2020-01-01|||||10||{p}S|{p}L|P|4000|P|", f"{p}U|2020-01-01|||UNIT|1|10|A|{p}S|{p}L|P|4000|S|", f"{p}A|2020-01-01|||||10||{p}S|{p}L|A|4000||", f"{p}X|2020-01-01|2021-01-01||||99||{p}S|{p}L|P|4000||"])
    psv(folder, p, "STREET_LOCALITY", "STREET_LOCALITY_PID|DATE_RETIRED|STREET_NAME|STREET_TYPE_CODE|STREET_SUFFIX_CODE", [f"{p}S||MAIN|RD|"])
    psv(folder, p, "LOCALITY", "LOCALITY_PID|DATE_RETIRED|LOCALITY_NAME|STATE_PID", [f"{p}L||TOWN|{p}"])
    psv(folder, p, "STATE", "STATE_PID|DATE_RETIRED|STATE_ABBREVIATION", [f"{p}||{p}"])
    psv(folder, p, "ADDRESS_ALIAS", "PRINCIPAL_PID|ALIAS_PID|DATE_RETIRED|ALIAS_TYPE_CODE", [f"{p}P|{p}A||SYN"])
    psv(folder, p, "ADDRESS_DEFAULT_GEOCODE", "ADDRESS_DETAIL_PID|DATE_RETIRED|LONGITUDE|LATITUDE|GEOCODE_TYPE_CODE", [f"{p}{x}||153.0|-27.0|PC" for x in "PUA"])
    psv(folder, p, "PRIMARY_SECONDARY", "PRIMARY_PID|SECONDARY_PID|DATE_RETIRED", [f"{p}P|{p}U|"])
    psv(folder, p, "ADDRESS_SITE", "ADDRESS_SITE_PID|DATE_RETIRED|ADDRESS_SITE_NAME", [])
    psv(folder, p, "ADDRESS_MESH_BLOCK_2021", "ADDRESS_DETAIL_PID|DATE_RETIRED|MB_2021_PID", [])
    psv(folder, p, "LOCALITY_ALIAS", "LOCALITY_ALIAS_PID|DATE_RETIRED|LOCALITY_PID|NAME|POSTCODE|ALIAS_TYPE_CODE", [f"{p}LA||{p}L|VILLE||SYN"])
    psv(folder, p, "STREET_LOCALITY_ALIAS", "STREET_LOCALITY_ALIAS_PID|DATE_RETIRED|STREET_LOCALITY_PID|STREET_NAME|STREET_TYPE_CODE|STREET_SUFFIX_CODE|ALIAS_TYPE_CODE", [f"{p}SA||{p}S|HIGH|ST||SYN"])


def test_standard_psv(store, tmp_path):
    folder = tmp_path / "psv"
    folder.mkdir()
    write_psv(folder, "QLD")
    write_psv(folder, "NSW")
    standard_psv.load_standard(store, str(folder))
    rows = {r["address_detail_pid"]: r for r in store.table("addresses").collect()}
    assert len(rows) == 14  # per state 3 details, 2 principals with an alias each of place and street
    assert rows["QLDU"]["address_label"] == "UNIT 1 10A MAIN ROAD, TOWN QLD 4000" and rows["QLDU"]["primary_pid"] == "QLDP"
    assert rows["QLDA"]["alias_type"] == "ADDRESS:SYN" and rows["QLDP_SAQLDSA"]["street_name"] == "HIGH" and rows["QLDP_LAQLDLA"]["locality_name"] == "VILLE"
    standard_psv.load_standard(store, str(folder), ["QLD"], overwrite=True, collapse=True)
    assert store.table("addresses").where("state = 'QLD'").count() == 4 and "QLDU" not in {r[0] for r in store.table("addresses").select("address_detail_pid").collect()}
    store.build_street_only()
    assert store.table("addresses").where("alias_type = 'street_only'").count() > 0
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        standard_psv.load_standard(store, str(tmp_path / "none"))


def test_custom_rows_and_geographies(spark, store, ref):
    store.put("addresses", ref)
    store.refresh()
    rows = spark.createDataFrame([("mine", 5, "main", "rd", "x", "qld", 4000), (None, 6, "main", "rd", "x", "qld", 4000)], "address_detail_pid string, number_first int, street_name string, street_type string, locality_name string, state string, postcode int")
    store.add_custom(rows)
    got = {r["address_detail_pid"]: r["address_label"] for r in store.table("custom").collect()}
    assert got["MINE"] == "5 MAIN RD, X QLD 4000" and len(got) == 2 and any(k.startswith("CUSTOM_") for k in got)
    store.remove_custom(spark.createDataFrame([("MINE",)], "address_detail_pid string"))
    assert store.table("custom").count() == 1
    with pytest.raises(ValueError):
        store.add_custom(spark.createDataFrame([("z", 1)], "address_detail_pid string, number_first int"))
    store.add_geography("Zone", spark.createDataFrame([("A", "z1"), ("LOT", None)], "address_detail_pid string, zone string"))
    assert store.list_geographies()["zone"]["columns"] == ["zone"]
    joined = store.join_geographies(ref.select("address_detail_pid"))
    assert {r["address_detail_pid"]: r["zone"] for r in joined.collect()}["A"] == "z1"
    for bad in ("1x", "addresses", "exact_index"):
        with pytest.raises(ValueError):
            store.add_geography(bad, spark.createDataFrame([("A", "z")], "address_detail_pid string, zone string"))
    store.remove_geography("zone")
    assert store.list_geographies() == {}


def test_cache_and_store_matching(spark, store, ref):
    store.put("addresses", ref)
    store.refresh(True)
    inputs = spark.createDataFrame([(1, "10-20 Range Rd, Brisbane QLD 4000"), (2, "14 Musgrave Rd, Brisbane QLD 4000")], "input_id int, input_raw string")
    first = {r["input_id"]: r["address_detail_pid"] for r in match_store(store, inputs).collect()}
    assert first == {1: "RANGE", 2: "M14"} and store.table("match_cache").count() > 0
    again = {r["input_id"]: r["address_detail_pid"] for r in match_store(store, inputs).collect()}
    assert again == first
    kept = store.table("match_cache")
    assert cache.status(kept).first()["n"] == kept.count() and cache.history(kept, "hour").count() >= 1
    cache.rollback(store, datetime.datetime(2000, 1, 1))
    assert store.table("match_cache").count() == 0
    with pytest.raises(ValueError):
        cache.window(kept, on="2024-01-01", start=datetime.datetime(2024, 1, 1))


def test_second_source(spark, store, ref, tmp_path):
    store.put("addresses", ref)
    store.refresh()
    rows = [
        {"address_pid": "1", "street_no_1": "14", "street_name": "Musgrave", "street_type": "ROAD", "locality": "Brisbane"}, {"address_pid": "2", "street_no_1": "15", "street_no_1_suffix": "A", "street_no_2": "17", "street_name": "Newton", "street_type": "STREET", "locality": "Brisbane (LGA)"},
        {"address_pid": "3", "street_no_1": "15", "street_no_1_suffix": "A", "street_no_2": "17", "street_name": "Newton", "street_type": "STREET", "locality": "Brisbane"}, {"address_pid": "4", "street_name": "Newton", "street_type": "STREET", "locality": "Brisbane"},
        {"address_pid": "5", "street_no_1": "1", "street_name": "Newton", "street_type": "STREET", "locality": "Nowhere"}, {"address_pid": "6", "lot": "24", "street_name": "Rural", "street_type": "ROAD", "locality": "Westbrook"}, {"address_pid": "7", "street_no_1": "3", "street_name": "Gone", "street_type": "ROAD", "locality": "Brisbane", "lotplan_status": "D"},
        {"address_pid": "8", "unit_number": "1-2", "street_no_1": "3", "street_name": "Newton", "street_type": "STREET", "locality": "Brisbane"},
    ]
    f = tmp_path / "pli.txt"
    lines = ["|".join(({"address_status": "P", "lotplan_status": "C", "datum": "GDA94", "latitude": "-27.42", "longitude": "153.02", "geocode_type": "PC"} | r).get(c, "") for c in pli.COLUMNS) for r in rows]
    f.write_bytes(("﻿" + "|".join(pli.COLUMNS) + "\r\n" + "\r\n".join(lines) + "\r\n").encode())
    counts = {r["status"]: r["n"] for r in pli.load_pli(store, str(f)).collect()}
    assert counts == {"in_reference": 1, "added": 2, "duplicate_label": 1, "no_number_or_lot": 1, "no_postcode": 1, "unparseable_unit": 1}
    new = {r["address_detail_pid"]: r for r in store.table("addresses").where("source = 'pli'").collect()}
    assert new["PLI2"]["address_label"] == "15A-17 NEWTON STREET, BRISBANE QLD 4000" and new["PLI6"]["address_label"] == "LOT 24 RURAL ROAD, WESTBROOK QLD 4350" and new["PLI2"]["longitude"] != 153.02
    again = {r["status"]: r["n"] for r in pli.load_pli(store, str(f)).collect()}
    assert again["already_loaded"] == 2 and again.get("added", 0) + again.get("duplicate_label", 0) == 1
    bad = tmp_path / "bad.txt"
    bad.write_text("a|b\n1|2\n")
    with pytest.raises(ValueError):
        pli.read_pli(spark, str(bad))


def test_shapefile(spark, tmp_path):
    ring = [(0, 0), (0, 2), (1, 2), (1, 0), (0, 0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 2, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(record) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + record)
    field = b"CODE\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 24, 1, 1, 1, 32 + 32 + 1, 6) + field + b"\r" + b" WEST ")
    rows = shapefile.read_shapefile(spark, str(tmp_path / "a.shp"), "CODE").collect()
    assert [(r["shape_id"], r["ord"], len(r["rings"][0])) for r in rows] == [("WEST", 0, 5)]
    layer = spark.createDataFrame([("a",), (None,)], "s string")
    assert shapefile.subset(layer, "s", ["a"]).count() == 1 and shapefile.subset(layer, "s", ["a"], invert=True).count() == 1


def test_simulation_is_seeded(ref):
    labels = ref.select(F.col("address_detail_pid").alias("input_id"), "address_label")
    a, b = (sorted(map(str, simulate.perturbed(labels.repartition(n), seed=4).collect())) for n in (1, 5))
    assert a == b and any(r["changes"] for r in simulate.perturbed(labels, seed=4).collect())
    assert all(len(r["changes"]) <= 2 for r in simulate.perturbed(labels, seed=5, most=2).collect())


def test_calibration(spark):
    rows = [(float(i % 10), 2.0 * (i % 10), None if i % 7 == 0 else float(i % 3), int(i % 10 + (i % 3) > 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, twice double, c double, y int")
    model, names = calibrate.fit(df, ["a", "twice", "c"], "y")
    assert "twice" not in names and "a" in names
    out = calibrate.predict(model, df, ["a", "twice", "c"], names)
    r = calibrate.report(out, "p", "y").first()
    assert r["n"] == 300 and r["brier"] < 0.12 and calibrate.policy(out, "p", "y", [0.2, 0.8]).count() == 2 and calibrate.leaks(df, df, ["a"]) == 300
    assert calibrate.reliability(out, "p", "y").agg(F.sum("n")).first()[0] == 300


def test_threshold_code_equals_the_filter(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 1, 10, "a b"), (2, True, 1, None, "c"), (3, True, 2, 30, None), (4, False, None, None, "d")], "input_id int, matched boolean, match_rank int, score_number int, t string")
    limits = {"score_number": (5, 20)}
    assert [r["input_id"] for r in df.where(diagnostics.scope(limits)).collect()] == [1]
    inside, outside = (diagnostics.filter_code(limits, inside=x) for x in (True, False))
    df.createOrReplaceTempView("results")
    assert spark.sql(f"SELECT * FROM results {inside}").count() + spark.sql(f"SELECT * FROM results {outside}").count() == 4
    assert diagnostics.difference("a b", "a c") == "a <del>b</del> <ins>c</ins>" and diagnostics.difference(None, "<", "char") == "<ins>&lt;</ins>"
    assert diagnostics.difference_page(df, "t", "t", str(tmp_path / "d.html")) == 4


def test_stream_equals_batch(spark, ref, tmp_path):
    rows = spark.createDataFrame([(1, "10-20 Range Rd, Brisbane QLD 4000"), (2, "nothing")], "input_id int, input_raw string")
    rows.write.parquet(str(tmp_path / "in"))
    q = match_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ref, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["input_id"]: r["address_detail_pid"] for r in out.collect()} == {1: "RANGE", 2: None}
    timed = out.withColumn("ts", F.lit("2024-01-01 00:01:00").cast("timestamp"))
    assert outcome_counts(timed).count() == timed.select("match_status").distinct().count()


def test_manifests_are_never_overwritten(spark, store, ref):
    from waymark.sources.store import ConflictError, Store

    store.put("addresses", ref)
    other = Store(spark, store.root)
    with pytest.raises(ConflictError):
        with store.change():
            store._staged["meta"]["x"] = 1
            other.note("y", 2)  # the other writer is first
    assert store.meta("x") is None and store.meta("y") == 2 and store.table("addresses").count() == ref.count()
    assert store._versions() == list(range(len(store._versions())))
    reader = Store(spark, store.root, read_only=True)
    assert reader.meta("y") == 2
    other.close()
    with pytest.raises(Exception):
        other.put("addresses", ref)


def test_custom_pids_stay_short_over_many_loads(spark, store, ref):
    store.put("addresses", ref)
    for k in range(3):
        rows = spark.createDataFrame([(k + 1, "MAIN", "X", "QLD", 4000)], "number_first int, street_name string, locality_name string, state string, postcode int")
        store.add_custom(rows)
        store.add_custom(rows)
    pids = [r[0] for r in store.table("custom").select("address_detail_pid").collect()]
    assert len(pids) == 3 and all(p.startswith("CUSTOM_") and len(p) <= 27 for p in pids)


def test_csv_and_statistics(spark, store, ref, tmp_path):
    store.put("addresses", ref)
    got = {r["column_name"]: r for r in store.statistics("addresses").collect()}
    assert got["address_detail_pid"]["filled"] == ref.count() and got["lot_number"]["filled"] == ref.where("lot_number IS NOT NULL").count()
    out = ref.select("address_detail_pid", "address_label", "lot_number").withColumn("tags", F.array(F.lit("a")))
    store.export_csv(out, str(tmp_path / "csv"), one_file=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, out.withColumn("tags", F.to_json("tags")).collect()))

