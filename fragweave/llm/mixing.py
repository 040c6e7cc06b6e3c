"""Mixing sources to target weights by entropy balancing.

Targets split a token budget over sources by weight, none above twice its source's words. Within a
source every document gets a rate between 0 and 2 that stays as close to 1 in (bounded) entropy as
the source's token constraint allows. The solution is an exponential tilt: the odds of the rate
against its bound are exp(lambda * words), with one dual variable per source, found by Newton steps
on the convex dual; each step sums over (source, words) groups as a Spark aggregation. Rates are
rounded to copies by systematic sampling in order of length, so a source misses its target by about
one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
#: Rows of one rounding group at most, about.
GROUP_ROWS = 20_000
STEPS, TOLERANCE = 60, 1e-6


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row per (source, size, n).

    Sources in code point order, null last, take the weights in turn. Handing out what full sources
    leave over until none is above its bound ends where every target is min(bound, weight * level)
    for one level; it is read off the sources in the order in which they fill up.
    """
    # one row per source; sources are few beside documents
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = total.select("source", "source_size", weight.alias("w"))
    t = t.withColumn("bound", F.col("source_size") * float(most)).withColumn("fills", F.col("bound") / F.col("w"))
    everything = Window.partitionBy()
    up = Window.orderBy("fills", F.col("source").isNull(), "source")
    goal = F.sum("source_size").over(everything) * float(budget)
    before = F.coalesce(F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    # the level if this source is the first that does not fill up; for those behind the true first it comes out too low
    t = t.withColumn("level", (goal - before) / later)
    level = F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("w") * level))
    return t.select("source", "source_size", target.alias("target"))


def tilted(lam: Column, size: Column, most: float) -> Column:
    """Rate of a document: ``most`` times the logistic of the tilt."""
    return F.lit(most) / (1 + F.exp(-F.greatest(F.least(lam * size, F.lit(500.0)), F.lit(-500.0))))


def solve(sizes: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """Add the dual variable ``lam`` of every source to ``goal`` (source, source_size, target).

    Newton's method on the dual, halved wherever a step overshoots the bracket that the signs of
    earlier residuals set. A source whose target is its bound (or zero) needs no iteration: its rate
    is the bound itself (or zero).
    """
    spark = sizes.sparkSession
    groups = sizes.where("size > 0")
    mean = groups.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = [
        (r["source"], r["scale"], r["target"], r["source_size"])
        for r in goal.join(mean, goal["source"].eqNullSafe(mean["source"])).select(goal["source"], "scale", "target", "source_size").collect()  # one row a source
    ]
    lam = {s: 0.0 for s, *_ in state}
    low, high = {s: -50.0 for s in lam}, {s: 50.0 for s in lam}
    open_ = {s for s, _, t, n in state if 0 < t < most * n * (1 - 1e-12)}
    for s, _, t, n in state:
        if s not in open_:
            lam[s] = -50.0 if t <= 0 else 50.0
    scale = {s: c for s, c, *_ in state}
    want = {s: t for s, _, t, _ in state}
    schema = "source string, lam double, done boolean"
    for _ in range(STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s] / scale[s], False) for s in open_], schema)
        at = groups.join(F.broadcast(now), groups["source"].eqNullSafe(now["source"])).select(groups["source"], "size", "n", "lam")
        rate = tilted(F.col("lam"), F.col("size"), most)
        words = F.col("size") * F.col("n")
        sums = at.select("source", (words * rate).alias("got"), (words * F.col("size") * rate * (1 - rate / most)).alias("slope")).groupBy("source").agg(
            F.sum("got").alias("got"), F.sum("slope").alias("slope")).collect()  # one row a source
        for r in sums:
            s, miss = r["source"], r["got"] - want[r["source"]]
            if abs(miss) <= TOLERANCE * want[s]:
                open_.discard(s)
                continue
            (high if miss > 0 else low)[s] = lam[s]
            step = lam[s] - miss / r["slope"] * scale[s] if r["slope"] > 0 else None
            lam[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2
    found = spark.createDataFrame([(s, lam[s] / scale[s], want[s] >= most * n * (1 - 1e-12)) for s, _, _, n in state], "source string, lam double, full boolean")
    return goal.join(F.broadcast(found.withColumnRenamed("source", "_s")), goal["source"].eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Copies of every document so that sources near their targets.

    Returns a row per row of ``docs``: doc_id, size, source, source_size, target, rate, copies.
    A null source is a source of its own. Texts without words have the rate 1 and one copy. Which of
    equally long documents get the extra copy depends on the hash of doc_id, so reruns agree; rows that
    share an id differ by their order within the id only.
    """
    base = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    sizes = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    goal = solve(sizes, targets(sizes, weights, budget, most), most)
    rates = sizes.join(F.broadcast(goal.withColumnRenamed("source", "_s")), sizes["source"].eqNullSafe(F.col("_s"))).drop("_s")  # one row a source
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).when(F.col("target") <= 0, 0.0).otherwise(tilted(F.col("lam"), F.col("size"), most))
    rates = rates.select("source", "size", "n", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    # within a source documents stand in order of length; the running sum of fractions before each group
    run = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    part = rates.withColumn("fraction", F.col("rate") - F.floor("rate")).withColumn("before", F.coalesce(F.sum(F.col("fraction") * F.col("n")).over(run), F.lit(0.0)))
    part = part.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z")
    hot = F.col("n") * 1000 > F.lit(base.count())
    on = base["source"].eqNullSafe(F.col("_s")) & (base["size"] == F.col("_z"))
    # (source, size) groups of over a thousandth of the rows are under 1000; the rest join by shuffle
    big, rest = part.where(hot), part.where(~hot)
    placed = base.join(F.broadcast(big), on).unionByName(base.join(F.broadcast(big.select("_s", "_z")), on, "left_anti").join(rest.hint("merge"), on)).drop("_s", "_z")
    h = F.xxhash64("doc_id")
    placed = placed.withColumn("part", F.pmod(h, F.col("parts")).cast("int"))
    # every part of a group starts at its own phase, the place it would have if parts were even
    w = Window.partitionBy("source", "size", "part").orderBy(h, "doc_id")
    at = F.col("before") + F.col("fraction") * F.col("n") * F.col("part") / F.col("parts") + F.col("fraction") * F.row_number().over(w)
    extra = F.least(F.greatest(F.floor(at + 0.5) - F.floor(at - F.col("fraction") + 0.5), F.lit(0)), F.lit(1))
    placed = written(placed.select("row", "doc_id", "size", "source", "source_size", "target", "rate", extra.alias("extra")), "mix-rounded")
    turned = F.when(F.col("row") == F.col("_row"), 1 - F.col("extra")).otherwise(F.col("extra"))
    copies = (F.floor("rate") + turned).cast("bigint")
    placed = placed.join(F.broadcast(_misses(placed)), F.col("source").eqNullSafe(F.col("_s")), "left")
    return placed.select("doc_id", "size", "source", "source_size", "target", "rate", copies.alias("copies"))


def _misses(placed: DataFrame) -> DataFrame:
    """Per source (_s) the row whose other rounding brings the source closest to its target, if any does."""
    words = F.sum((F.floor("rate") + F.col("extra")) * F.col("size"))
    miss = placed.groupBy("source").agg((F.first("target") - words).alias("miss")).withColumnRenamed("source", "_s")
    change = F.when(F.col("extra") >= 1, -F.col("size")).when(F.col("rate") > F.floor("rate"), F.col("size"))
    left = F.abs(F.col("miss") - change)
    # one row a source
    return (placed.join(F.broadcast(miss), F.col("source").eqNullSafe(F.col("_s"))).where(left < F.abs("miss"))
            .groupBy("_s").agg(F.min(F.struct(left.alias("left"), "doc_id", "row")).alias("best")).select("_s", F.col("best.row").alias("_row")))

