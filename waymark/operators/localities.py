"""The locality index and what is resolved with it: postcodes of a locality, exact or fuzzy, and localities that a
comma-less input lost to its street."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import textnorm
from waymark.functions.metrics import damerau_udf, jaro_winkler_udf

FUZZY_LEAST, FUZZY_POSTCODES = 0.85, 5
OFFSETS = (-3, -2, -1, 1, 2, 3)


def locality_index(*tables: DataFrame) -> DataFrame:
    """Distinct (locality_name, postcode, state) of all tables, where locality and postcode are known."""
    out = tables[0].select("locality_name", "postcode", "state")
    for t in tables[1:]:
        out = out.unionByName(t.select("locality_name", "postcode", "state"))
    return out.where("locality_name IS NOT NULL AND postcode IS NOT NULL").distinct()


def _same_state(i: str = "in_state", l: str = "state") -> Column:
    return F.col(i).isNull() | (F.col(i) == F.col(l))


def exact_postcodes(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (input_id, alt_postcode) of inputs whose locality is in the index."""
    i = inputs.select("input_id", "in_locality", "in_state").where("in_locality IS NOT NULL")
    hit = i.join(index, (F.col("in_locality") == F.col("locality_name")) & _same_state())
    return hit.select("input_id", F.col("postcode").alias("alt_postcode")).distinct()


def fuzzy_postcodes(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """(input_id, alt_postcode, similarity, rank): per input the five postcodes whose localities are most like its own.

    Distinct (locality, state) are compared, with the localities of the same state only: an equi-join on the state,
    never all against all inputs. Inputs without a state meet the distinct locality names once.
    """
    wanted = inputs.where("in_locality IS NOT NULL").select("in_locality", "in_state").distinct()
    places = index.select("locality_name", "state").distinct()
    names = F.sort_array(F.collect_set("locality_name")).alias("names")
    with_state = wanted.where("in_state IS NOT NULL").join(places, F.col("in_state") == F.col("state")).select("in_locality", "in_state", "locality_name", "state")
    lists = places.groupBy("state").agg(names)  # the gazetteer: one row a state
    anywhere = wanted.where("in_state IS NULL").withColumn("k", F.lit(1)).join(lists.withColumn("k", F.lit(1)), "k").select("in_locality", "in_state", F.explode("names").alias("locality_name"), "state")
    pairs = with_state.unionByName(anywhere)
    near = pairs.withColumn("similarity", jaro_winkler_udf("in_locality", "locality_name")).where(F.col("similarity") >= FUZZY_LEAST)
    by = near.join(index, ["locality_name", "state"]).groupBy("in_locality", "in_state", "postcode").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("in_locality", "in_state").orderBy(F.col("similarity").desc(), "postcode")
    top = by.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= FUZZY_POSTCODES)
    i = inputs.select("input_id", F.col("in_locality").alias("_l"), F.col("in_state").alias("_s"))
    return top.join(i, (F.col("in_locality") == F.col("_l")) & F.col("in_state").eqNullSafe(F.col("_s"))).select("input_id", F.col("postcode").alias("alt_postcode"), "similarity", "rank")


def offset_postcodes(inputs: DataFrame) -> DataFrame:
    """The postcodes next to an input's own."""
    return inputs.where("in_postcode IS NOT NULL").select("input_id", F.explode(F.array(*[F.col("in_postcode") + o for o in OFFSETS])).alias("alt_postcode"))


def alternative_postcodes(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """Exact postcodes of the locality; else fuzzy ones; else the neighbours of the input's own; never the own."""
    exact = exact_postcodes(inputs, index)
    rest = inputs.join(exact.select("input_id").distinct(), "input_id", "left_anti")
    fuzzy = fuzzy_postcodes(rest, index).select("input_id", "alt_postcode")
    last = rest.join(fuzzy.select("input_id").distinct(), "input_id", "left_anti")
    found = exact.unionByName(fuzzy).unionByName(offset_postcodes(last)).distinct()
    own = inputs.select("input_id", "in_postcode")
    return found.join(own, "input_id").where(~F.col("alt_postcode").eqNullSafe(F.col("in_postcode"))).select("input_id", "alt_postcode")


def recovered_localities(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """(input_id, locality, street_left, how) for inputs without locality whose street text ends with one.

    First the last three, two or one words that equal a locality of the postcode (or state), longest first; else the
    last three or two words that are one edit from a single locality there, if they are the only such words.
    """
    some = inputs.where("in_locality IS NULL AND in_street_name IS NOT NULL AND (in_postcode IS NOT NULL OR in_state IS NOT NULL)")
    words = F.split(textnorm.name(F.concat_ws(" ", "in_street_name", "in_street_type", "in_street_suffix")), " ")
    tails = some.select("input_id", "in_postcode", "in_state", words.alias("w")).select("*", F.explode(F.array(F.lit(3), F.lit(2), F.lit(1))).alias("k")).where(F.size("w") > F.col("k"))
    tails = tails.select(
        "input_id", "in_postcode", "in_state", "k", F.concat_ws(" ", F.slice("w", F.size("w") - F.col("k") + 1, F.col("k"))).alias("tail"), F.concat_ws(" ", F.slice("w", F.lit(1), F.size("w") - F.col("k"))).alias("street_left"),
    )
    place = F.when(F.col("in_postcode").isNotNull(), F.col("postcode") == F.col("in_postcode")).otherwise(F.col("state") == F.col("in_state"))
    exact = tails.join(index, (F.col("tail") == F.col("locality_name")) & place).groupBy("input_id").agg(F.max_by(F.struct("locality_name", "street_left"), "k").alias("m"))
    exact = exact.select("input_id", F.col("m.locality_name").alias("locality"), "m.street_left", F.lit("exact").alias("how"))
    rest = tails.join(exact.select("input_id"), "input_id", "left_anti").where((F.col("k") >= 2) & (F.length("tail") >= 5) & ~F.col("tail").startswith("THE "))
    blocked = rest.where("in_postcode IS NOT NULL").join(index, F.col("postcode") == F.col("in_postcode")).unionByName(rest.where("in_postcode IS NULL").join(index, F.col("state") == F.col("in_state")))
    spaces = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    close = blocked.where((F.abs(F.length("tail") - F.length("locality_name")) <= 1) & (spaces("tail") == spaces("locality_name"))).where(damerau_udf("tail", "locality_name") == 1)
    fuzzy = close.groupBy("input_id").agg(F.countDistinct("locality_name").alias("n"), F.countDistinct("tail").alias("t"), F.min("locality_name").alias("locality"), F.min("street_left").alias("street_left"))
    return exact.unionByName(fuzzy.where("n = 1 AND t = 1").select("input_id", "locality", "street_left", F.lit("fuzzy").alias("how")))
