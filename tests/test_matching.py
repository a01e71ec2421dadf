import pytest
from pyspark.sql import functions as F

from waymark.operators import blocking, geo, indexes, scoring
from waymark.operators.scoring import ADDRESS_SCHEMA, PARSED_SCHEMA, with_columns
from waymark.plans.match_text import match_addresses
from waymark.plans.matcher import MatchOptions, match_parsed

OLD = {"postcode": 20, "suburb": 15, "street_name": 40, "street_type": 10, "number": 10, "flat": 5}


def pair(spark, **values):
    base = {"in_postcode": 4000, "postcode": 4000, "in_state": "QLD", "state": "QLD", "in_locality": "BRISBANE", "locality_name": "BRISBANE", "in_street_name": "MAIN", "street_name": "MAIN", "in_street_type": "ROAD", "street_type": "ROAD", "in_number_first": 10, "number_first": 10, "address_label": "10 MAIN ROAD, BRISBANE QLD 4000"} | values
    kinds = dict(x.split() for x in f"{ADDRESS_SCHEMA}, {PARSED_SCHEMA}".split(", "))
    i = spark.createDataFrame([("x", *[base.get(c) for c in kinds if c.startswith("in_")])], "input_id string, " + ", ".join(f"{c} {k}" for c, k in kinds.items() if c.startswith("in_")))
    r = spark.createDataFrame([tuple(base.get(c) for c in kinds if not c.startswith("in_"))], ", ".join(f"{c} {k}" for c, k in kinds.items() if not c.startswith("in_")))
    return scoring.prepared_inputs(i).withColumn("k", F.lit(1)).join(scoring.prepared(r).withColumn("k", F.lit(1)), "k").drop("k")


@pytest.mark.parametrize(
    ("component", "values", "expect"),
    [
        ("postcode", {"postcode": 4001}, 14), ("postcode", {"postcode": 4002}, 8), ("postcode", {"postcode": 4003}, 4), ("postcode", {"postcode": 4005}, 0), ("postcode", {"in_postcode": 4067, "postcode": 4076}, 8), ("postcode", {"in_postcode": 4067, "postcode": 4607}, 8),
        ("postcode", {"in_postcode": 4067, "postcode": 4007}, 0), ("postcode", {"in_postcode": 800, "postcode": 8000}, 0), ("postcode", {"postcode": None}, 0),
        ("number", {"in_number_last": 20, "number_last": 20}, 10), ("number", {"in_number_last": 20, "number_last": 30}, 7), ("number", {"in_number_last": 20, "number_first": 12}, 5), ("number", {"in_number_last": 20, "number_first": 18, "number_last": 25}, 3), ("number", {"in_number_last": 20, "number_first": 30, "number_last": 40}, 0), ("number", {"number_last": 20}, 7),
        ("number", {"in_number_suffix": "A", "address_label": "UNIT 2 LEVEL 3 10A MAIN ROAD"}, 10), ("number", {"in_number_suffix": "A", "address_label": "MAIN CENTRE 2/10A MAIN ROAD"}, 10), ("number", {"in_number_suffix": "A", "address_label": "UNIT 10A 10B MAIN ROAD"}, 0), ("number", {"in_number_suffix": "A", "address_label": None}, 5),
        ("street_type", {"in_street_suffix": "NORTH", "street_suffix": "N"}, 10), ("street_type", {"in_street_suffix": "NORTH"}, 5), ("street_type", {"in_street_suffix": "NORTH", "street_suffix": "SOUTH"}, 0), ("street_type", {"in_street_type": "RD"}, 10), ("street_type", {"in_street_type": "COURT"}, 4), ("street_type", {"street_type": None}, 5),
        ("flat", {"in_flat_number": "2", "flat_number": "02", "in_level_number": "3", "level_number": "3"}, 5), ("flat", {"in_flat_number": "2", "flat_number": "2", "in_level_number": "3"}, 4), ("flat", {"in_flat_type": "WAREHOUSE", "in_flat_number": "5", "flat_type": "SHOP", "flat_number": "5"}, 2),
        ("number", {"in_lot_number": "7", "lot_number": "7", "in_number_first": 99}, 0), ("number", {"in_lot_number": "7", "lot_number": "7", "in_number_first": None, "number_first": None}, 10), ("number", {"in_lot_number": "7", "lot_number": "8", "in_number_first": None}, 0),
        ("street_name", {"in_street_name": "XILLIAM", "street_name": "WILLIAM"}, 27), ("street_name", {"in_street_name": "XILLIAM", "street_name": "XILLIAMSON"}, 25), ("street_name", {"in_street_name": "MOUNT GRAVATT EAST", "street_name": "MOUNT GRAVATT WEST"}, 17),
    ],
)
def test_scores(spark, component, values, expect):
    row = scoring.scored(scoring.with_similarities(pair(spark, **values)), OLD).first()
    assert row[f"score_{component}"] == expect


def test_weights_are_checked():
    for w in ({"postcode": 100}, OLD | {"flat": 6}, OLD | {"flat": -5, "number": 20}, OLD | {"flat": float("nan")}):
        with pytest.raises(ValueError):
            scoring.checked_weights(w)
    with pytest.raises(ValueError):
        MatchOptions(max_results=0)


REF = [
    ("A", "UNIT 2 LEVEL 3 10 SMITH STREET, ST LUCIA QLD 4067", "UNIT", "2", "LEVEL", "3", 10, None, None, "SMITH", "STREET", "ST LUCIA", "QLD", 4067, None, None), ("A2", "10 SMITH STREET, ST LUCIA QLD 4067", None, None, None, None, 10, None, None, "SMITH", "STREET", "ST LUCIA", "QLD", 4067, None, None),
    ("LOT", "LOT 7 KREIS ROAD, WESTBROOK QLD 4350", None, None, None, None, None, None, "7", "KREIS", "ROAD", "WESTBROOK", "QLD", 4350, None, None), ("RANGE", "10-20 RANGE ROAD, BRISBANE QLD 4000", None, None, None, None, 10, 20, None, "RANGE", "ROAD", "BRISBANE", "QLD", 4000, None, None),
    ("NSW", "10 MAIN ROAD, SPRINGFIELD NSW 2000", None, None, None, None, 10, None, None, "MAIN", "ROAD", "SPRINGFIELD", "NSW", 2000, None, None), ("QLD", "10 MAIN ROAD, SPRINGFIELD QLD 4000", None, None, None, None, 10, None, None, "MAIN", "ROAD", "SPRINGFIELD", "QLD", 4000, None, None),
    ("ALIAS", "10 OLD ROAD, BRISBANE QLD 4000", None, None, None, None, 10, None, None, "OLD", "ROAD", "BRISBANE", "QLD", 4000, "STREET:SYN", "RANGE"), ("M190", "190 MUSGRAVE ROAD, RED HILL QLD 4059", None, None, None, None, 190, None, None, "MUSGRAVE", "ROAD", "RED HILL", "QLD", 4059, None, None),
    ("M14", "14 MUSGRAVE ROAD, BRISBANE QLD 4000", None, None, None, None, 14, None, None, "MUSGRAVE", "ROAD", "BRISBANE", "QLD", 4000, None, None),
    *[(f"S{n}", f"{n} SMITH STREET, WEST END QLD 4101", None, None, None, None, n, None, None, "SMITH", "STREET", "WEST END", "QLD", 4101, None, None) for n in (2, 8, 30)],
]
COLUMNS = "address_detail_pid string, address_label string, flat_type string, flat_number string, level_type string, level_number string, number_first int, number_last int, lot_number string, street_name string, street_type string, locality_name string, state string, postcode int, alias_type string, principal_pid string"


@pytest.fixture(scope="module")
def ref(spark):
    return with_columns(spark.createDataFrame(REF, COLUMNS).withColumn("source", F.lit("gnaf")), ADDRESS_SCHEMA).cache()


@pytest.fixture(scope="module")
def matched(spark, ref):
    texts = ["15 Range Rd, Brisbane QLD 4000", "Lot 7 Kreis Rd, Westbrook QLD 4350", "10 Main Rd, Springfield NSW", "190 MUSGRAVE RD, RED HILL QLD 4000", "12 Smith Street, West End QLD 4101", "Unit 2 Level 3 10 Smith St, St Lucia QLD 4067", "", None, "10 Old Road, Brisbane QLD 4000", "99 Nowhere Lane, Perth WA 6000", "10 SMITH STREET, ST LUCIA QLD 4067"]
    inputs = spark.createDataFrame(list(enumerate(texts)), "input_id int, input_raw string")
    rows = match_addresses(inputs, ref, MatchOptions(max_results=1)).collect()
    assert len(rows) == len(texts)
    return {r["input_id"]: r for r in rows}


def test_text_matches(matched):
    assert [matched[i]["address_detail_pid"] for i in (0, 1, 2, 3, 5, 8, 10)] == ["RANGE", "LOT", "NSW", "M190", "A", "ALIAS", "A2"]
    assert matched[3]["match_basis"] == "postcode_only" and matched[3]["total_score"] >= 88
    assert matched[4]["address_detail_pid"] == "S8" and matched[4]["score_number"] == 0
    assert [matched[i]["match_status"] for i in (6, 7, 9)] == ["insufficient_parse", "insufficient_parse", "no_candidate"]
    assert matched[10]["total_score"] == 100 and matched[10]["match_basis"] == "exact_components"


def test_ties_by_nearest_number(spark, ref):
    one = spark.createDataFrame([(1, 4101, "QLD", "WEST END", "SMITH", "STREET", 12)], "input_id int, in_postcode int, in_state string, in_locality string, in_street_name string, in_street_type string, in_number_first int")
    got = match_parsed(one, ref, MatchOptions(max_results=3)).orderBy("match_rank").collect()
    assert [r["address_detail_pid"] for r in got] == ["S8", "S2", "S30"]


def test_links(spark, ref):
    one = spark.createDataFrame([(1, 4000, "QLD", "BRISBANE", "OLD", "ROAD", 10)], "input_id int, in_postcode int, in_state string, in_locality string, in_street_name string, in_street_type string, in_number_first int")
    r = match_parsed(one, ref, MatchOptions(return_linked="principal")).first()
    assert (r["address_detail_pid"], r["matched_address_detail_pid"]) == ("RANGE", "ALIAS")
    assert match_parsed(one, ref, MatchOptions(resolve_principal=True)).first()["principal_address_label"].startswith("10-20 RANGE")
    assert match_parsed(one, ref, MatchOptions(alias_types=[None], min_score=95)).first()["match_status"] == "no_candidate"
    assert match_parsed(one.limit(0), ref).count() == 0 and match_parsed(one, ref.limit(0)).first()["matched"] is False


def test_branches_equal_the_gate(spark, ref):
    nums = [(i, p, "QLD", n, l, lot) for i, (p, n, l, lot) in enumerate([(4000, 10, None, None), (4000, 15, 18, None), (4000, 1, 12, None), (4350, None, None, "7"), (4350, None, None, "8"), (4101, None, None, None), (4000, 20, 10, None)])]
    i = scoring.prepared_inputs(spark.createDataFrame(nums, "input_id int, in_postcode int, in_state string, in_number_first int, in_number_last int, in_lot_number string"))
    r = scoring.prepared(ref)
    split = blocking.block_pairs(i, r, [("in_postcode", "postcode")]).select("input_id", "address_detail_pid").collect()
    whole = blocking.block_pairs(i, r, [("in_postcode", "postcode")], gate=False).where(blocking.number_gate()).select("input_id", "address_detail_pid").collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole)) and len(set(split)) == len(split)


def test_exact_index(spark):
    rows = [("P1", "UNIT 50 11 ROLLESTON STREET, KEPERRA QLD 4054", "UNIT", "50", 11, "ROLLESTON", "STREET"), ("P2", "11 ROLLESTON STREET, KEPERRA QLD 4054", None, None, 11, "ROLLESTON", "STREET"), ("D1", "5 SAME ROAD, KEPERRA QLD 4054", None, None, 5, "SAME", "ROAD"), ("D2", "5 SAME ROAD, KEPERRA QLD 4054", None, None, 5, "SAME", "ROAD"), ("A1", "U 3 12 MAIN STREET, KEPERRA QLD 4054", "U", "3", 12, "MAIN", "STREET"), ("A2", "UNIT 3 12 MAIN STREET, KEPERRA QLD 4054", "UNIT", "3", 12, "MAIN", "STREET")]
    table = spark.createDataFrame(rows, "address_detail_pid string, address_label string, flat_type string, flat_number string, number_first int, street_name string, street_type string").withColumns({"state": F.lit("QLD"), "postcode": F.lit(4054)})
    got = indexes.exact_index(table).collect()
    count = lambda p: sum(r["address_detail_pid"] == p for r in got)
    assert (count("P1"), count("P2"), count("D1"), count("D2")) == (12, 4, 0, 0)
    assert [r["address_detail_pid"] for r in got if r["lookup_key"] == "U 3 12 MAIN STREET KEPERRA QLD 4054"] == ["A1"]


def test_geography(spark):
    box = lambda x0, x1: [[{"x": x0, "y": 0.0}, {"x": x1, "y": 0.0}, {"x": x1, "y": 2.0}, {"x": x0, "y": 2.0}]]
    shapes = spark.createDataFrame([("west", 0, box(0.0, 2.0)), ("east", 1, box(1.0, 3.0))], geo.SHAPE)
    points = spark.createDataFrame([("a", 0.5, 1.0), ("b", 1.5, 1.0), ("c", 2.5, 1.0), ("d", 9.0, 1.0), ("e", None, 1.0), ("f", float("nan"), 1.0)], "address_detail_pid string, longitude double, latitude double")
    first = {r["address_detail_pid"]: r["shape_id"] for r in geo.point_in_polygon(points, shapes).collect()}
    assert first == {"a": "west", "b": "west", "c": "east", "d": None, "e": None, "f": None}
    assert geo.point_in_polygon(points, shapes, mode="all").where("address_detail_pid = 'b'").count() == 2
    moved = spark.createDataFrame([(153.02, -27.42)], "lon double, lat double").select("lon", "lat", *[c.alias(n) for c, n in zip(geo.gda94_to_gda2020(F.col("lon"), F.col("lat")), ("x", "y"))])
    assert moved.select(geo.metres_apart(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).first()[0] == pytest.approx(1.52, abs=0.02)


def test_number_branches_equal_the_gate(spark):
    import random

    r = random.Random(2)
    number = lambda: r.choice([None, r.randint(1, 30), r.randint(1, 30), 400])
    inputs = spark.createDataFrame([(i, 1, number(), number(), r.choice(["", "7"])) for i in range(60)], "input_id int, in_postcode int, in_number_first int, in_number_last int, i_lot string")
    ref = spark.createDataFrame([(f"r{i}", 1, number(), r.choice([None, r.randint(1, 40), 900]), r.choice(["", "7"]), r.choice([None, 5])) for i in range(60)], "address_detail_pid string, postcode int, number_first int, number_last int, c_lot string, c_token_number int")
    key = [("in_postcode", "postcode")]
    plain = blocking.block_pairs(inputs, ref, key, gate=False).where(blocking.number_gate()).select("input_id", "address_detail_pid")
    got = blocking.block_pairs(inputs, ref, key).select("input_id", "address_detail_pid").collect()
    assert len(got) == len(set(got)) and set(got) == set(plain.collect()) and len(got) > 300


def test_pruning_early_loses_no_pair(spark):
    rows = pair(spark).unionByName(pair(spark, street_name="MAINE", number_first=12)).unionByName(pair(spark, locality_name="BRISBAN", postcode=4009)).unionByName(pair(spark, street_name=None))
    scored = scoring.scored(scoring.with_similarities(rows), OLD).select("total_score").collect()
    for least in (40, 60, 80, 95):
        kept = scoring.scored(scoring.with_similarities(rows.where(scoring.may_ever_reach(OLD, least))), OLD).where(F.col("total_score") >= least).count()
        assert kept == sum(r["total_score"] >= least for r in scored)


def test_index_hits_carry_the_weights_that_were_asked_for(spark, ref):
    weights = {"postcode": 20, "suburb": 15, "street_name": 40, "street_type": 10, "number": 10, "flat": 5}
    inputs = spark.createDataFrame([(1, "10-20 Range Rd, Brisbane QLD 4000")], "input_id int, input_raw string")
    row = match_addresses(inputs, ref, MatchOptions(weights=weights)).first()
    assert row["address_detail_pid"] == "RANGE" and [row[f"score_{c}"] for c in scoring.COMPONENTS] == list(weights.values()) and row["total_score"] == 100


def test_index_shortens_whole_street_names_only(spark):
    rows = [("h", "PRIMROSE ROAD HALL, 1 ROSE ROAD, X QLD 4000", "ROSE", "ROAD", "X", "QLD", 4000)]
    table = spark.createDataFrame(rows, "address_detail_pid string, address_label string, street_name string, street_type string, locality_name string, state string, postcode int")
    keys = {r["lookup_key"] for r in indexes.index_keys(table).collect()}
    assert "PRIMROSE ROAD HALL 1 ROSE RD X QLD 4000" in keys and not any("PRIMROSE RD" in k for k in keys)



@pytest.mark.parametrize("name", ["q_identity_basis", "q_postcode_only_unique"])
def test_identical_addresses_meet_by_number_and_unit(spark, name):
    import re

    from waymark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) (\[[^\]]*\])", plan)
    assert any({"i_name", "i_locality", "in_number_first", "i_flat"} <= set(re.findall(r"\w+(?=#)", keys)) for keys in joins)


@pytest.mark.parametrize(("least", "gate"), [(60, True), (40, True), (85, True), (60, False)])
def test_names_compared_by_block_lose_no_pair(spark, ref, monkeypatch, least, gate):
    from waymark.plans import matcher
    from waymark.plans.lineage import cut

    inputs = [(i, p, "QLD", loc, name, n, last) for i, (p, loc, name, n, last) in enumerate((p, loc, name, n, last) for p in (4000, 4101, None) for loc in ("BRISBANE", "WEST ENDD", None) for name in ("RANGE", "RNAGE", "SMITH", "SMTIH", "OLD", None) for n, last in ((10, None), (12, 30), (None, None)))]
    i = cut(scoring.prepared_inputs(spark.createDataFrame(inputs, "input_id int, in_postcode int, in_state string, in_locality string, in_street_name string, in_number_first int, in_number_last int")))
    r, key, options = cut(scoring.prepared(ref)), [("in_postcode", "postcode")], MatchOptions(min_score=least)
    rows = lambda df: sorted(map(tuple, df.select("input_id", "address_detail_pid", *matcher.SCORES, "total_score", "match_basis", "number_distance").collect()), key=repr)
    want = rows(matcher.score_path(blocking.block_pairs(i, r, key, gate), options, prune=False))
    assert matcher.names_of_blocks(i, r, key, gate, least, options.weights).columns[-4:] == ["_name", "_locality", "suburb_similarity", "street_similarity"]
    assert rows(matcher.score_block(i, r, key, options, gate)) == want == rows(matcher.score_block(i, r, key, options, gate, prune=False)) and (want or least == 85)
    monkeypatch.setattr(matcher, "NAMES", 0)
    assert rows(matcher.score_block(i, r, key, options, gate)) == want


def test_equal_inputs_are_matched_once_and_answered_all(spark):
    from waymark.plans import matcher

    rows = [(1, 4000, "A"), (2, 4000, "A"), (3, 4000, None), (4, None, "A"), (5, None, "A"), (None, 4000, "A")]
    distinct, fan = matcher.distinct_inputs(spark.createDataFrame(rows, "input_id int, in_postcode int, in_street_name string"))
    assert distinct.count() == 3
    got = matcher.for_all(distinct.select("input_id", "in_postcode", "in_street_name"), fan).select("input_id", "in_postcode", "in_street_name").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_small_files_of_many_rows_are_not_broadcast(spark):
    from waymark.plans import lineage

    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, "10m")
        many = lineage.cut(spark.range(400_000).selectExpr("id", "repeat('MAIN STREET ', 40) AS name"))
        joined = many.join(many.select("id"), "id")._jdf.queryExecution().executedPlan().toString()
        assert int(spark.conf.get(key)) == lineage.BROADCAST and "SortMergeJoin" in joined
        spark.conf.set(key, "-1")
        lineage.cut(spark.range(1))
        assert spark.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, held)


def test_all_pairs_are_made_in_tasks_of_few_inputs(spark, monkeypatch):
    from waymark.plans import queries

    monkeypatch.setattr(queries, "TASK_INPUTS", 100)
    found = queries.gated(queries.Tables(spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == found.select("input_id", "address_detail_pid").distinct().count() > 0


def test_inputs_are_answered_by_content_and_pairs_kept_narrow(spark, ref, monkeypatch):
    from waymark.plans import matcher

    written = []
    monkeypatch.setattr(matcher, "cut", lambda df, spread=False: written.append(df.columns) or df)
    rows = [(None, 10, "RANGE"), (7, 10, "RANGE"), (7, 10, "NOWHERE"), (8, 10, "RANGE")]
    inputs = spark.createDataFrame([(*r, "ROAD", "BRISBANE", "QLD", 4000) for r in rows], "input_id int, in_number_first int, in_street_name string, in_street_type string, in_locality string, in_state string, in_postcode int")
    options = MatchOptions(locality_fallback=False, street_fallback=False)
    got = [(r.input_id, r.in_street_name, r.address_detail_pid) for r in match_parsed(inputs, ref, options).collect()]
    assert sorted(got, key=repr) == sorted([(k, s, "RANGE" if s == "RANGE" else None) for k, _, s in rows], key=repr)
    assert all("i_name" not in columns for columns in written if "total_score" in columns) and any("total_score" in columns for columns in written)


def test_ranges_meet_in_one_join(spark):
    from waymark.plans import queries

    plan = queries.QUERIES["q_match_split_branches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("name", ["q_score_total", "q_score_custom_weights", "q_score_flat", "q_match_unpruned"])
def test_pairs_look_their_names_up(spark, name):
    from waymark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "_i_street_similarity" in plan


def test_what_is_looked_up_equals_what_is_compared(spark, ref, monkeypatch):
    from waymark.plans import matcher
    from waymark.plans.lineage import cut

    rows = [(k, 4000, 10, name, kind, flat) for k, (name, kind, flat) in enumerate((n, t, f) for n in ("RANGE", "RNAGE", "OLD", None) for t in ("ROAD", None, "STREET") for f in ("2", None))]
    i = cut(scoring.prepared_inputs(spark.createDataFrame(rows, "input_id int, in_postcode int, in_number_first int, in_street_name string, in_street_type string, in_flat_number string").withColumn("in_locality", F.lit("BRISBAN"))))
    r, pairs = cut(scoring.prepared(ref)), lambda a, b: blocking.block_pairs(a, b, [("in_postcode", "postcode")])
    got = lambda df: sorted(map(tuple, scoring.scored(df).select("input_id", "address_detail_pid", *(f"score_{c}" for c in scoring.COMPONENTS), "total_score").collect()))
    want = got(scoring.with_similarities(pairs(i, r)))
    known = matcher.with_known(i, r, pairs)
    assert {*scoring.KNOWN} <= {*known.columns} and got(scoring.with_gate(known)) == want and len(want) > 50
    monkeypatch.setattr(matcher, "LOOKED_UP", 3)
    assert matcher.with_known(i, r, pairs) is None


def test_whole_blocks_are_scored_as_matrices(spark, monkeypatch):
    from waymark.operators import matrices
    from waymark.plans import matcher
    from waymark.plans.lineage import cut

    monkeypatch.setattr(matrices, "CHUNK", 4)
    monkeypatch.setattr(matrices, "AT_ONCE", 5)
    rows = [(k, 4000 if k % 5 else None, "QLD", ("BRISBANE", "BRISBAN", None)[k % 3], ("RANGE", "RNAGE", "OLD", None)[k % 4], ("ROAD", None)[k % 2], *n, ("2", None)[k % 2]) for k, n in enumerate(((10, None), (10, 14), (12, 10), (5, 400), (300, None), (None, None)) * 6)]
    i = cut(scoring.prepared_inputs(spark.createDataFrame(rows, "input_id int, in_postcode int, in_state string, in_locality string, in_street_name string, in_street_type string, in_number_first int, in_number_last int, in_flat_number string")))
    those = [(f"P{k // 2}", k % 2 and "custom" or None, 4000, "QLD", "BRISBANE", ("RANGE", "OLDE", "")[k % 3], ("ROAD", "STREET", None)[k % 3], *n, ("2", "3", None)[k % 3]) for k, n in enumerate(((10, None), (10, 14), (8, 12), (9, 900), (14, None), (None, None)) * 4)]
    r = cut(scoring.prepared(spark.createDataFrame(those, "address_detail_pid string, source string, postcode int, state string, locality_name string, street_name string, street_type string, number_first int, number_last int, flat_number string")))
    for weights, least in ((scoring.DEFAULT_WEIGHTS, 0), ({"postcode": 12.5, "suburb": 0.0, "street_name": 27.3, "street_type": 10.2, "number": 33.5, "flat": 16.5}, 40)):
        options = MatchOptions(min_score=least, weights=weights)
        got, want = (sorted(map(tuple, df.select(*matcher.FOUND).collect()), key=repr) for df in (matcher.score_block(i, r, [("in_postcode", "postcode")], options, prune=False), matcher.score_path(blocking.block_pairs(i, r, [("in_postcode", "postcode")]), options, prune=False)))
        assert got == want and len(want) > 100 and any(x[3] == "exact_components" for x in want)
    assert "MapInArrow" in matcher.score_block(i, r, [("in_postcode", "postcode")], options, prune=False)._jdf.queryExecution().executedPlan().toString()
    assert matrices.score_all(i, r, [("in_postcode", "postcode")], weights, 40, blocking.needed(i, r), 3) is None
