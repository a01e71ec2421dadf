"""Balanced label propagation: equal texts are linked, and linked documents move towards their neighbours' shards.

Every document starts with a label, its shard, drawn from a hash of its id. In each round the links vote: a document's
neighbours are the others of its text, and it asks for the label that most of them carry now, if more carry it than its own
(ties are decided by a hash of text and shard), among the shards that have room or hold documents of fewer votes. A shard
takes those of most votes, whoever stays before whoever comes, while a running sum is within its quota; others that asked
remain where they are, and residents that it has no place for have no label until they ask again. Then votes are counted
anew from the labels as they are; it ends when nobody moves. Documents of one text and label are alike, so a group is kept
as its counts per label; a text that a third of all rows share is one row of that table. Last, each group's rows take its
labels by their numbers in the group, and what has no links, or no label, fills the shards up to their quotas.

Law ``rows``: a shard's quota is N / shards, rounded down or up, so counts are at most one apart. DataFrame operations
only. Running sums and numbers are built in two levels (per bucket, then within it), and rows of large groups are spread
over buckets by id, so that no task sees a shard or a large group whole.

Defined results: null texts have size 8, no crc and no links; empty texts are equal texts; null and repeated ids and
repeated rows each get a slot of their own; very long texts are read whole; an empty table gives none. Further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import Shared, read_table

SHARDS = 24
#: Rows that a bucket of the two-level sums is meant to have.
BUCKET_ROWS = 20_000
#: A group is large if it has this share of all rows; so at most as many are.
MOST_LARGE = 4096
#: The most rounds of propagation.
ROUNDS = 24


def bucket(n: int, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(77), *by), F.lit(n))


def running(df: DataFrame, part: list[str], within: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of ``part`` that come no later in the order of ``within``
    (coarse keys, compared first) and ``order``; only the rows of equal ``within`` are sorted together."""
    df = df.withColumn("_w", weight)
    sums = df.groupBy(*part, *within).agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*part).orderBy(*within).rowsBetween(Window.unboundedPreceding, -1) if part else Window.orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_p", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    own = Window.partitionBy(*part, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*part, *within]).withColumn(name, F.col("_p") + F.sum("_w").over(own)).drop("_w", "_p")


def numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def total_of(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)


def moved(groups: DataFrame, quota: list[int], held: list[int], bars: list[int], n_buckets: int) -> DataFrame:
    """One round: the groups (link, n, counts) with their new counts, and whether they changed. bars: the fewest votes of
    a shard's residents."""
    n = len(quota)
    shards = F.sequence(F.lit(0), F.lit(n - 1))
    votes = F.transform(shards, lambda s: F.struct(F.element_at("counts", s + 1).alias("c"), F.xxhash64(F.col("link"), s).alias("h"), s.alias("s")))
    room = numbers([q - h for q, h in zip(quota, held)])
    voted = groups.select("link", "n", "counts", votes.alias("votes"), (F.col("n") - total_of("counts")).alias("home"))
    best = F.array_max(F.filter("votes", lambda v: (F.element_at(room, v["s"] + 1) > 0) | (v["c"] > F.element_at(numbers(bars), v["s"] + 1))))
    voted = voted.withColumn("best", best)
    lesser = F.transform("votes", lambda v: F.when(v < F.col("best"), v["c"]).otherwise(F.lit(0).cast("long")))
    voted = voted.withColumn("go", lesser)
    asks = voted.select("link", F.col("best.s").alias("to"), F.col("best.c").alias("votes"), (F.col("home") + total_of("go")).alias("c"), F.lit(1).alias("comes")).where("to IS NOT NULL AND c > 0")
    stay = voted.select("link", F.posexplode("counts").alias("to", "c")).where("c > 0").select("link", "to", F.col("c").alias("votes"), "c", F.lit(0).alias("comes"))
    both = stay.unionByName(asks).withColumn("rank", (-F.floor(F.log2(F.col("votes") + 1))).cast("int")).withColumn("b", bucket(n_buckets, "link"))
    summed = running(both, ["to"], ["rank", "b"], [F.col("votes").desc(), F.col("link"), F.col("comes")], F.col("c"), "sum")
    got = F.greatest(F.least(F.col("c"), F.element_at(numbers(quota), F.col("to") + 1) - (F.col("sum") - F.col("c"))), F.lit(0).cast("long"))
    stays = F.col("comes") == 0
    per = summed.withColumn("got", got).groupBy("link").agg(
        F.max(F.when(~stays, F.col("to"))).alias("to"), F.coalesce(F.sum(F.when(~stays, F.col("got"))), F.lit(0)).alias("g"), F.map_from_entries(F.collect_list(F.when(stays, F.struct("to", "got")))).alias("kept")
    )
    out = voted.join(per, "link", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    rest = F.greatest(F.col("g") - F.col("home"), F.lit(0).cast("long"))  # those without a label go first

    def after(s: Column) -> Column:
        go = F.element_at("go", s + 1)
        gone = F.least(go, F.greatest(rest - total_of(F.slice("go", F.lit(1), s)), F.lit(0).cast("long")))
        here = F.least(F.coalesce(F.element_at("kept", s), F.lit(0).cast("long")), F.element_at("counts", s + 1) - gone)
        return here + F.when(s == F.col("to"), F.col("g")).otherwise(F.lit(0).cast("long"))

    new = F.transform(shards, after)
    return out.select("link", "n", new.alias("new"), "counts").select("link", "n", F.col("new").alias("counts"), (F.col("new") != F.col("counts")).alias("changed"))


def propagate(groups: DataFrame, quota: list[int], n_buckets: int, shared: Shared) -> DataFrame:
    """groups: link, n, counts (documents per label). Returns them when nobody moves any more, no label over its quota."""
    path, n, n_buckets = None, len(quota), 64 + n_buckets
    for _ in range(ROUNDS):
        row = groups.agg(*[F.sum(F.element_at("counts", s + 1)).alias(f"h{s}") for s in range(n)], *[F.min(F.nullif(F.element_at("counts", s + 1), F.lit(0))).alias(f"b{s}") for s in range(n)]).first()
        held, bars = [int(row[f"h{s}"] or 0) for s in range(n)], [int(row[f"b{s}"] or 0) for s in range(n)]
        after, at = shared.put(moved(groups, quota, held, bars, n_buckets))
        over = after.where("changed").isEmpty()
        if path:
            shared.drop(path)
        groups, path = after.drop("changed"), at
        if over:
            break
    return groups


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, size, text_crc32, link (digest of the text), shard and slot."""
    shared = Shared(docs.sparkSession)
    base, _ = shared.put(
        docs.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text_col).alias("crc"), F.unhex(F.sha2(text_col, 256)).alias("link"),
        )
    )
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    n_buckets, large = 1 + total // BUCKET_ROWS, max(1000, total // MOST_LARGE)
    label = F.pmod(F.xxhash64(F.col("id").cast("string"), "link"), F.lit(shards)).cast("int")
    counts = F.array(*[F.count_if(label == s) for s in range(shards)])
    groups, _ = shared.put(base.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("n"), counts.alias("counts")).where("n > 1"))
    groups = propagate(groups, quota, n_buckets, shared)
    groups = groups.select("link", "n", running_ends("counts", shards).alias("ends"))
    row = ["id", "size", "crc", "link"]
    linked = base.where("link IS NOT NULL")
    marked = linked.join(F.broadcast(groups.where(F.col("n") > large)), "link", "left")  # at most MOST_LARGE groups
    spread = running(marked.where("ends IS NOT NULL").withColumn("b", bucket(n_buckets, "id")), ["link"], ["b"], [F.col("id")], F.lit(1).cast("long"), "r")
    small = marked.where("ends IS NULL").select(*row).join(groups.where(F.col("n") <= large).select("link", "ends"), "link", "left")
    small = small.withColumn("r", F.row_number().over(Window.partitionBy("link").orderBy("id")).cast("long"))
    at = F.size(F.filter("ends", lambda e: e < F.col("r")))
    named = F.when(at < shards, at).alias("shard")  # null where the group's labels had no room for the row, or there is no group
    alone = base.where("link IS NULL").select(*row, F.lit(None).cast("int").alias("shard"))
    both, _ = shared.put(small.select(*row, named).unionByName(spread.select(*row, named)).unionByName(alone))
    held = {r["shard"]: r["c"] for r in both.where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("c")).collect()}  # a row a shard
    ends, end = [], 0
    for s, q in enumerate(quota):
        end += q - held.get(s, 0)
        ends.append(end)
    rest = both.where("shard IS NULL").drop("shard").withColumn("b", bucket(n_buckets, "id", "link"))
    rest = running(rest, [], ["b"], [F.col("link"), F.col("id"), F.col("size")], F.lit(1).cast("long"), "p")
    shard = sum(((F.col("p") > e).cast("int") for e in ends[:-1]), F.lit(0))
    placed, _ = shared.put(both.where("shard IS NOT NULL").unionByName(rest.select(*row, shard.alias("shard"))))
    slots = running(placed.withColumn("b", bucket(n_buckets, "id", "crc")), ["shard"], ["b"], [F.col("id"), F.col("crc")], F.lit(1).cast("long"), "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "link", "shard", (F.col("slot") - 1).alias("slot"))


def running_ends(counts: str, shards: int) -> Column:
    """Cumulative sums of a short array."""
    return F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice(counts, F.lit(1), k), F.lit(0).cast("long"), lambda x, y: x + y))


def cut_links(assigned: DataFrame) -> DataFrame:
    """Groups of equal texts, and how many of them lie in more than one shard."""
    groups = assigned.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("z")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("a") != F.col("z")).alias("cut"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
