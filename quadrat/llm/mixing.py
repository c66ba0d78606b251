"""Mixing sources by a curriculum whose weights change over the training run.

Every source has a schedule: weights at evenly spaced moments, linear in between.  Its share
of the mix at a moment is its weight over the sum of all; the integral of the share is its
demand.  Targets follow from the total demand, limited to a number of passes over the source,
the excess going to the others by weight.  Documents of a source stand in a fixed random order;
the running word count of a document, put through the inverse of the demand curve, gives the
moment at which training meets it.  A further pass goes on counting from the words of the
passes before it, so every pass over a document has a moment of its own.  Everything is DataFrame code; running counts are taken
over hash buckets first and inside buckets after, so that no window holds a whole source.

Defined results: sources in code-point order, null last, take the schedules in turn.  A null or
wordless text has size 0 and takes nothing; its position is that of its neighbours, but it has
no passes.  Repeated
rows count separately.  Without any word all targets are 0 and positions null.  Other columns
pass through; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import without, written

WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "taken", "position", "positions")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def demand(sizes: DataFrame, schedules: list[list[float]], share: float, passes: float, steps: int) -> DataFrame:
    """One row per source: target, and ``curve``, the share of its target due by each moment."""
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    table = F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules])
    held = sizes.withColumn("weights", F.get(table, F.pmod(place, F.lit(len(schedules))).cast("int")))
    moment = held.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    knot = (F.col("step") + 0.5) / steps * (F.size("weights") - 1)
    low = F.floor(knot).cast("int")
    left = F.get("weights", low)
    right = F.coalesce(F.get("weights", low + 1), left)
    moment = moment.withColumn("w", left + (right - left) * (knot - low))
    total = F.sum("w").over(W.partitionBy("step"))
    moment = moment.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(0.0))
    shares = moment.groupBy("source", "source_size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "w"))), lambda s: s["w"]).alias("parts"),
        F.sum("w").alias("weight"),
    )
    # Water level: the source whose limit is lowest for its weight fills first.
    shares = shares.withColumn("cap", passes * F.col("source_size"))
    fill = W.orderBy(
        F.asc_nulls_last(F.col("cap") / F.nullif("weight", F.lit(0.0))), F.asc_nulls_last("source")
    )
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    goal = share * F.sum("source_size").over(W.partitionBy())
    weight = F.sum("weight").over(W.partitionBy())
    level = F.greatest((goal - used) / F.nullif(weight - gone, F.lit(0.0)), F.lit(0.0))
    full = F.col("cap") <= level * F.col("weight") * (1 + 1e-12)
    shares = shares.withColumn("full", full).withColumn("level", level)
    # From the first source that is not full on, all share its level.
    shares = shares.withColumn("place", F.row_number().over(fill))
    first_open = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(W.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(first_open, F.lit(0.0)) * F.col("weight"))
    curve = F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
        / F.nullif("weight", F.lit(0.0)),
    )
    return shares.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), curve.alias("curve"))


def _planned(
    docs: DataFrame, schedules: list[list[float]], share: float = 1.5, passes: float = 2.0,
    steps: int = 64, bucket_rows: int = 4096,
) -> DataFrame:
    base = without(docs, *RESULT, "row_", "dice_", "bucket_")
    rows = base.withColumn("size", words(F.col("text")))
    rows = rows.withColumn("dice_", F.xxhash64("doc_id", "text", F.lit("order")))
    rows = written(rows.withColumn("row_", F.monotonically_increasing_id()), "mixing-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = written(demand(sizes.select("source", "source_size"), schedules, share, passes, steps), "mixing-plan")
    buckets = max(1, -(-rows.count() // bucket_rows))
    bucket = F.floor((F.col("dice_") / 2.0**64 + 0.5) * buckets).cast("bigint")
    # Texts stay where they were written: only numbers are dealt out, sorted and counted.
    light = rows.select("source", "row_", "doc_id", "dice_", "size", bucket.alias("bucket_"))
    sums = light.groupBy("source", "bucket_").agg(F.sum("size").alias("held"))
    earlier = W.partitionBy("source").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket_", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket_").orderBy("dice_", "doc_id", "row_").rowsBetween(W.unboundedPreceding, -1)
    light = light.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r, s, p = light.alias("r"), sums.alias("s"), plan.alias("p")
    joined = r.join(s, F.expr("r.source <=> s.source AND r.bucket_ = s.bucket_")).join(p, F.expr("r.source <=> p.source"))
    start = F.col("s.base") + F.col("r.inner")
    size, source_size, target = F.col("r.size"), F.col("p.source_size"), F.col("p.target")
    goal = F.round(target).cast("bigint")
    whole = F.floor(goal / F.nullif(source_size, F.lit(0)))
    rest = goal - whole * source_size
    part = F.least(F.greatest(rest - start, F.lit(0)), size)
    taken = F.coalesce(whole * size + part, F.lit(0)).cast("bigint")

    def moment(words_before: Column) -> Column:
        """Inverse of the demand curve, linear between two moments."""
        due = words_before / F.nullif(target, F.lit(0.0))
        at = F.aggregate("p.curve", F.lit(0), lambda n, c: n + F.when(c <= due, 1).otherwise(0))
        low = F.when(at > 0, F.get("p.curve", at - 1)).otherwise(0.0)
        high = F.coalesce(F.get("p.curve", at), F.lit(1.0))
        inner = F.coalesce((due - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        return F.when(due.isNotNull() & (due < 1), F.least((at + inner) / steps, F.lit(1.0)))

    times = F.ceil(taken / F.nullif(size, F.lit(0))).cast("int")
    every = F.transform(F.sequence(F.lit(0), times - 1), lambda n: moment(start + n * source_size))
    places = joined.select(
        "row_",
        source_size,
        target,
        taken.alias("taken"),
        moment(start).alias("position"),
        F.when(taken > 0, every).otherwise(F.array().cast("array<double>")).alias("positions"),
    )
    # Written, since a sort by range computes its input twice.
    placed = rows.join(written(places, "mixing-places"), "row_")
    return placed.select(*[F.col(f"`{c}`") for c in base.columns], *RESULT)


def mix(docs: DataFrame, schedules: list[list[float]], **plan) -> DataFrame:
    """Add size, source_size, target, taken, position (0 to 1) and positions, sorted by position.

    ``taken`` counts words with repeats; a document is taken in whole passes plus, for the
    last one, the words up to the target.  ``positions`` has the moment of each of these
    passes, ``position`` that of the first.
    """
    out = _planned(docs, schedules, **plan)
    # The id deals out the rows that the mix leaves, whose position is null.
    order = F.asc_nulls_last("position"), F.asc("doc_id")
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, schedules: list[list[float]], **plan) -> DataFrame:
    """What ``mix`` adds, with a row for each pass over a document; sorted by its ``position``."""
    every = _planned(docs, schedules, **plan)
    out = every.withColumn("position", F.explode("positions"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
