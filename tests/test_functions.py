import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import golden
from waymark.functions import textnorm
from waymark.functions.metrics import damerau, jaro_winkler, pair_similarities
from waymark.functions.parser import parse_addresses, split_untyped
from waymark.functions.vocab import StreetTypes


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, a) for i, (a, _) in enumerate(golden.rows())] + [(900, None), (901, ""), (902, "   ")]
    return {r["input_id"]: r for r in parse_addresses(spark.createDataFrame(rows, "input_id int, input_raw string")).collect()}


@pytest.mark.parametrize("i", range(len(golden.rows())))
def test_golden_rows(parsed, i):
    address, expect = golden.rows()[i]
    assert " ".join(golden.shown(parsed[i].asDict()).split()) == " ".join(expect.split()), address


def test_parser_details(parsed):
    by = {a: parsed[i] for i, (a, _) in enumerate(golden.rows())}
    lot = by["Araby Lot 21 Armstrongs Lane, Moore QLD 4314"]
    assert (lot["in_lot_number"], lot["in_building_name"]) == ("21", "ARABY")
    shop = by["Shop 14 Level 3 52 Davenport Rd, South Brisbane QLD 4101"]
    assert (shop["in_level_type"], shop["in_level_number"]) == ("LEVEL", "3")
    assert by["10 Main Rd Sth, Sydney NSW 2000"]["in_street_suffix"] == "STH"
    for i in (900, 901, 902):
        assert all(v is None for k, v in parsed[i].asDict().items() if k.startswith("in_"))


def test_metrics():
    assert damerau("CA", "ABC") == 2 and damerau("", "ab") == 2 and damerau("ab", "ba") == 1
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6) and jaro_winkler("", "") == 0.0 and jaro_winkler("a", "") == 0.0


words = st.text(alphabet="ABCDé ", max_size=8)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_metrics_equal_duckdb(a, b):
    import duckdb

    jw, dl = duckdb.connect().execute("SELECT jaro_winkler_similarity($1, $2), damerau_levenshtein($1, $2)", [a, b]).fetchall()[0]
    assert jaro_winkler(a, b) == pytest.approx(jw, abs=1e-9) and damerau(a, b) == dl


def test_normalisers(spark):
    rows = spark.createDataFrame([("003a", " Kippa- Ring  St.,x "), ("000", "a&nbsp;b‑c 25ST JAMES 12TH 40/B"), (None, None)], "i string, t string")
    got = rows.select(textnorm.identifier(F.col("i")), textnorm.structural(F.col("t")), textnorm.exact_key(F.col("t"))).collect()
    assert tuple(got[0])[:2] == ("3A", "KIPPA-RING ST,X") and tuple(got[1])[:2] == ("0", "A B-C 25 ST JAMES 12TH 40B") and got[2][0] == "" and got[2][1] is None


def test_opposed_directions(spark):
    pairs = spark.createDataFrame([("MOUNT EAST", "MOUNT WEST"), ("MOUNT EAST", "MOUNT EAST"), ("", "X"), ("A NORTH", "A NORTHERN")], "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in pair_similarities(pairs, "a", "b", "s").collect()}
    assert got["MOUNT EAST", "MOUNT EAST"] == 1 and got["", "X"] == 0 and got["MOUNT EAST", "MOUNT WEST"] < 0.5 < got["A NORTH", "A NORTHERN"]


def test_street_types_from_file(tmp_path):
    f = tmp_path / "types.csv"
    f.write_text("name,abbreviation\nROAD,RD\nQUAYSIDE,QSD\n")
    assert StreetTypes.read(str(f)).canonical == {"RD": "ROAD", "QSD": "QUAYSIDE", "ROAD": "ROAD", "QUAYSIDE": "QUAYSIDE"}


def test_untyped_names(spark):
    ref = spark.createDataFrame([("THE POINT CIRCUIT", None), ("ESPLANADE", None), ("MAIN", "ROAD"), ("THE AVENUE", None)], "street_name string, street_type string")
    assert [tuple(r) for r in split_untyped(ref).collect()] == [("THE POINT CIRCUIT", "THE POINT", "CIRCUIT")]


def test_units_by_letter_and_lettered_ranges(spark):
    from waymark.functions.parser import parse_addresses

    lines = ["D2 41 WATTLE TERRACE, HILLTOP QLD 4017", "U 6019A-6B Wattle Bvd Hilltop QLD 4001", "Unit 3A-9 Wattle Road, Hilltop QLD 4001", "7&#0032;Wattle&#x00A0;Road, Hilltop QLD 4001"]
    rows = parse_addresses(spark.createDataFrame(list(enumerate(lines)), "input_id int, input_raw string")).orderBy("input_id").collect()
    assert (rows[0]["in_flat_type"], rows[0]["in_flat_number"], rows[0]["in_number_first"], rows[0]["in_street_name"]) == ("UNIT", "2", 41, "WATTLE")
    assert (rows[1]["in_flat_number"], rows[1]["in_number_first"], rows[1]["in_number_suffix"]) == ("6019A", 6, "B")
    assert rows[2]["in_flat_number"] == "3A-9" and rows[2]["in_number_first"] is None
    assert (rows[3]["in_number_first"], rows[3]["in_street_name"], rows[3]["in_street_type"]) == (7, "WATTLE", "ROAD")


def test_factors_of_pairs_equal_those_of_distinct_pairs(spark):
    from waymark.functions.metrics import pair_similarities, with_factors

    names = ["", "NORTH HILL", "SOUTH HILL", "HILL", "HILLS", "EAST WEST END", "WEST END", "ÅBO", "ABO"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names] * 2, "a string, b string")
    want = {(r["a"], r["b"]): r["s"] for r in pair_similarities(pairs, "a", "b", "s").collect()}
    got = with_factors(pairs, {"s": ("a", "b"), "t": ("b", "a")}).collect()
    assert len(got) == 2 * len(want)
    for r in got:
        assert abs(r["s"] - want[r["a"], r["b"]]) < 1e-12 and abs(r["t"] - want[r["b"], r["a"]]) < 1e-12

