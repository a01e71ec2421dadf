"""Scores of all pairs of a block whose sides have few contents, as matrices: nothing is left out beforehand by a bound.

Spark's expressions score all pairs of contents once (names, types, numbers, units, places). Inputs and candidates that meet by
block and number come together as chunks of numbers of contents, and all pairs of two chunks are added up in one Arrow call from
the tables of contents. Only pairs of the least score leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators import blocking, scoring

#: Rows of a side in a chunk, about; more rows of a key are dealt to several chunks.
CHUNK = 1024
#: Pairs that are scored at a time.
AT_ONCE = 1 << 16


def contents(side: DataFrame, columns: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """The distinct contents (what, value) of a side."""
    return side.select(F.inline(F.array(*[F.struct(F.lit(what).alias("what"), F.array(*[F.col(c).cast("string") for c in of]).alias("value")) for what, of in columns.items()]))).distinct()


def numbered(side: DataFrame, known: DataFrame, columns: Mapping[str, tuple[str, ...]], prefix: str) -> DataFrame:
    """The side with the number of each of its contents, as prefix and what; known, which is small, has (what, value, number)."""
    for what, of in columns.items():
        there = known.where(F.col("what") == what).select(F.col("value").alias("_value"), F.col("number").alias(f"{prefix}{what}"))
        side = side.join(F.broadcast(there), F.array(*[F.col(c).cast("string") for c in of]) == F.col("_value")).drop("_value")
    return side


def tables(a: DataFrame, b: DataFrame, kinds: tuple[Mapping[str, T.DataType], Mapping[str, T.DataType]], weights: Mapping[str, float]) -> DataFrame:
    """Of all pairs of contents (what, _a, _b): their points, or the factor that the street gate is multiplied by, whether an identical
    address may have them, and for numbers whether they pass the gate, the later first number and the distance."""
    w, col, same = scoring.checked_weights(weights), F.col, scoring.identity_parts()
    first, last = col("in_number_first"), F.coalesce(col("in_number_last"), col("in_number_first"))
    begin, end = col("number_first"), F.coalesce(col("number_last"), col("number_first"))
    adds = {
        "suburb_similarity": {"points": scoring.name_score(w["suburb"], col("suburb_similarity"))},
        "street_similarity": {"points": scoring.name_score(w["street_name"], col("street_similarity")), "factor": col("street_gate")},
        "credit_street_type": {"points": scoring.half_even(F.lit(float(w["street_type"])) * scoring.type_credit())},
        "credit_flat": {"factor": F.lit(float(w["flat"])) * scoring.flat_credit()},
        "number": {"factor": F.lit(float(w["number"])) * scoring.number_credit(), "meets": (begin == first) | ((begin <= last) & (end >= first)), "later": F.greatest(first, begin), "distance": scoring.number_distance()},
        "place": {"points": scoring.postcode_score(w["postcode"], col("in_postcode"), col("postcode"))}, "building": {},
    }
    same["place"] &= col("in_postcode") == col("postcode")
    out = None
    for what, (mine, theirs) in scoring.CONTENTS.items():
        x, y = (
            side.where(col("what") == what).select(col("number").alias(n), *[col("value")[k].cast(kind[c]).alias(c) for k, c in enumerate(of)])
            for side, of, n, kind in ((a, mine, "_a", kinds[0]), (b, theirs, "_b", kinds[1]))
        )
        pairs = x.repartition(2 * a.sparkSession.sparkContext.defaultParallelism, "_a").crossJoin(F.broadcast(y))
        if what in scoring.COMPARED:
            pairs = scoring.compared(pairs, what)
        if what == "street_similarity":
            pairs = scoring.with_gate(pairs)
        add = {"points": F.lit(0), "factor": F.lit(1.0), "meets": F.lit(True), "later": F.lit(None), "distance": F.lit(None)} | adds[what]
        kind = {"points": "double", "factor": "double", "meets": "boolean", "later": "int", "distance": "int"}
        made = pairs.select(F.lit(what).alias("what"), "_a", "_b", F.coalesce(same[what], F.lit(False)).alias("same"), *[(F.coalesce(v, F.lit(False)) if k == "meets" else v).cast(kind[k]).alias(k) for k, v in add.items()])
        out = made if out is None else out.unionByName(made)
    return out


def arrays(found: pa.Table) -> dict[str, dict[str, np.ndarray]]:
    """tables() as matrices by what: a row for each content of the inputs, a column for each of the candidates."""
    found, out = found.combine_chunks(), {}
    kinds = np.asarray(found["what"].to_numpy())
    values = {c: found[c].fill_null(0).to_numpy() if c in ("later", "distance") else found[c].to_numpy() for c in found.column_names if c != "what"}
    for what in scoring.CONTENTS:
        at = kinds == what
        i, c = values["_a"][at], values["_b"][at]
        out[what] = {}
        for name in ("points", "factor", "meets", "same", "later", "distance"):
            made = np.zeros((i.max() + 1, c.max() + 1), values[name].dtype)
            made[i, c] = values[name][at]
            out[what][name] = made
    return out


def chunks(side: DataFrame, exploded: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, chunk, rows): rows of equal keys as arrays of about CHUNK. exploded: the side's rows by its keys, the last by name; heavy keys are
    counted on it, few of which there can be."""
    heavy = side.groupBy(*keys).count().where(F.col("count") > CHUNK).select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.ceil(F.col("count") / CHUNK).alias("_parts"))
    out = exploded.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).join(F.broadcast(heavy), [F.col(k) == F.col(f"_k{n}") for n, k in enumerate(keys)], "left")
    out = out.withColumn(f"{name}chunk", F.pmod(F.col("_row"), F.coalesce("_parts", F.lit(1))))
    rest = [c for c in exploded.columns if c not in (*keys, "_row")]
    return out.groupBy(*keys, f"{name}chunk").agg(F.collect_list(F.struct(*rest)).alias(f"{name}rows"))


def scored_chunk(i: pa.StructArray, c: pa.StructArray, meet: int, known: dict, least: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The pairs of two chunks, as places in either, that pass the gate at meet with the least score, and what is known of them."""
    at = {what: tuple(x.field(f"{side}{what}").to_numpy().astype(np.intp) for x, side in ((i, "_i_"), (c, "_c_"))) for what in known}

    def few(*whats: str) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
        """The distinct contents of either side in these tables, as numbers in each, and the place of every row among them."""
        sides = [np.unique(np.stack([at[x][k] for x in whats], axis=1), axis=0, return_inverse=True) for k in (0, 1)]
        return [(x, np.ix_(sides[0][0][:, k], sides[1][0][:, k])) for k, x in enumerate(whats)], (sides[0][1].ravel(), sides[1][1].ravel())

    plain, base_at = few("place", "suburb_similarity", "credit_street_type")
    base = sum(known[x]["points"][on] for x, on in plain)
    [(_, on)], number_at = few("number")
    meets = known["number"]["meets"][on] & (known["number"]["later"][on] == meet)
    number = np.where(meets, known["number"]["factor"][on], -np.inf)  # the gate is above 0
    street, flat, (name_at, name_to), (flat_at, flat_to) = known["street_similarity"], known["credit_flat"]["factor"], at["street_similarity"], at["credit_flat"]
    found, step = [], max(1, AT_ONCE // len(c))
    for lo in range(0, len(i), step):
        here = slice(lo, lo + step)
        gate = street["factor"][name_at[here]].take(name_to, axis=1)
        total = base[base_at[0][here]].take(base_at[1], axis=1)
        total += street["points"][name_at[here]].take(name_to, axis=1)
        for table, rows, columns in ((number, number_at[0], number_at[1]), (flat, flat_at, flat_to)):
            part = table[rows[here]].take(columns, axis=1)
            part *= gate
            total += np.rint(part, out=part)
        x, y = np.nonzero(total >= least)
        found.append((x + lo, y))
    x, y = (np.concatenate(z) for z in zip(*found))
    one = lambda what, name: known[what][name][at[what][0][x], at[what][1][y]]
    gate = one("street_similarity", "factor")
    out = {
        "score_postcode": one("place", "points"), "score_suburb": one("suburb_similarity", "points"), "score_street_name": one("street_similarity", "points"), "score_street_type": one("credit_street_type", "points"),
        "score_number": np.rint(one("number", "factor") * gate), "score_flat": np.rint(one("credit_flat", "factor") * gate),
    }
    out["total_score"] = sum(out.values())
    return x, y, out | {"number_distance": one("number", "distance"), "same": np.logical_and.reduce([one(what, "same") for what in known])}


def score_all(inputs: DataFrame, ref: DataFrame, keys: list[tuple[str, str]], weights: Mapping[str, float], least: int, branches: dict[str, bool], most: int) -> DataFrame | None:
    """All numbered pairs of a block that pass the gate with a total of least or more: ids, source, scores, basis and distance. None where
    contents have more than most pairs. The sides should be written ones."""
    spark, out = inputs.sparkSession, []
    mine, theirs = ({what: of[k] for what, of in scoring.CONTENTS.items()} for k in (0, 1))
    for side, columns in ((inputs, mine), (ref, theirs)):
        few = contents(side, columns).limit(most + 1).toArrow()
        if len(few) > most:
            return None
        out.append(list(zip(few["what"].to_pylist(), few["value"].to_pylist())))
    count = [{what: sum(x == what for x, _ in side) for what in scoring.CONTENTS} for side in out]
    if any(not 0 < count[0][what] * count[1][what] <= most for what in scoring.CONTENTS):
        return None
    for k, side in enumerate(out):
        at = dict.fromkeys(scoring.CONTENTS, 0)
        for n, (what, value) in enumerate(side):
            side[n] = (what, value, at[what])
            at[what] += 1
        out[k] = spark.createDataFrame(side, "what string, value array<string>, number int")
    kinds = tuple({f.name: f.dataType for f in side.schema} for side in (inputs, ref))
    known, least = spark.sparkContext.broadcast(arrays(tables(*out, kinds, weights).toArrow())), int(least)
    left, right = blocking.meeting(inputs, ref, branches)
    i = numbered(inputs.withColumn("_row", F.monotonically_increasing_id()), out[0], mine, "_i_")
    c = numbered(ref.withColumn("_row", F.monotonically_increasing_id()), out[1], theirs, "_c_")
    met = blocking.meeting(i, c, branches)
    a, b = list(dict.fromkeys(m for m, _ in keys)), list(dict.fromkeys(t for _, t in keys))
    x = chunks(left, met[0].select(*a, "_i", "_row", "input_id", *[f"_i_{what}" for what in mine]), [*a, "_i"], "i")
    y = chunks(right, met[1].select(*b, "_c", "_row", "address_detail_pid", "source", *[f"_c_{what}" for what in theirs]), [*b, "_c"], "c")
    on = F.col("_i") == F.col("_c")
    for m, t in keys:
        on = on & (F.col(m) == F.col(t))
    both = x.join(y, on).repartition(4 * spark.sparkContext.defaultParallelism, *a, "_i", "ichunk", "cchunk").select("_i", "irows", "crows")
    ids = [*(T.StructField(n, kinds[0][n]) for n in ("input_id",)), *(T.StructField(n, kinds[1][n]) for n in ("address_detail_pid", "source"))]
    numbers = [*(f"score_{n}" for n in scoring.COMPONENTS), "total_score", "number_distance"]
    schema = T.StructType([*ids, *(T.StructField(n, T.IntegerType()) for n in numbers), T.StructField("same", T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meets, rows, others = (batch.column(n) for n in ("_i", "irows", "crows"))
            for n in range(len(batch)):
                here, there = rows[n].values, others[n].values
                at, to, found = scored_chunk(here, there, meets[n].as_py(), known.value, least)
                if len(at):
                    made = [here.field("input_id").take(pa.array(at)), *(there.field(x).take(pa.array(to)) for x in ("address_detail_pid", "source"))]
                    made += [pa.array(found[x].astype("int32")) for x in numbers]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(found["same"])], names=schema.fieldNames())

    basis = F.when(F.col("same"), "exact_components").otherwise("weighted")
    return both.mapInArrow(score, schema).withColumn("match_basis", basis).drop("same")
