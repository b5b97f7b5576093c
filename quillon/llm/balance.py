"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Every document gets a rate (expected copies). Among the rates that give each source its target number
of words, those with the least relative entropy to one copy per document are exponential tilts,
rate = min(cap, exp(lambda * size / mean size)), one lambda for each source. The convex dual is solved
by safeguarded Newton steps over a histogram of (source, size), which is all that the steps read.
Rates become copies by sequential Poisson sampling: the whole part always, and the documents with the
least u / fraction one copy more until the source's words are used up; u is a hash of the row.

Defined results: a null or empty text has no words, a long one counts whole; a document without words takes
none; a null source is a source of its own and comes last; a source without words has target 0; rows that tie
at the cut, repeated ones among them, share what is left evenly; an empty table gives no rows. Other columns,
whatever their names, are ignored, or kept by mixed_copies(). The table of sources (one row each) is ordered
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, quoted, word_count

#: Relative error of a source's expected words at which the Newton steps end, and the most steps.
TOLERANCE, STEPS = 1e-7, 40
#: Ranges of u / fraction over which the words are summed, and parts of the range that holds the cut over
#: which they are summed again, before the cut is looked for in one of these.
RANGES = 2048


def _draw(*columns: str) -> Column:
    """A number between 0 and 1 that depends on the row alone."""
    return (F.pmod(F.xxhash64(*columns), F.lit(2**52)).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, ...) with its target: share * all words dealt by weight, no source above
    cap times its own size, the excess dealt again by weight. sizes has one row for each source; the
    windows below run over that table alone."""
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    # Dealing the excess again and again ends at a level: weight * level for all but the full sources,
    # which are those with the least room for their weight.
    ranked = ranked.withColumn("room", F.lit(cap) * F.col("source_size") / F.col("weight"))
    upward = everything.orderBy("room", "sid")
    full = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double") * F.lit(share)
    ranked = ranked.withColumn("level", (total - full) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything)
    target = F.least(F.col("weight") * F.coalesce(level, F.col("room")), F.lit(cap) * F.col("source_size"))
    return ranked.withColumn("target", target).drop("room", "level", "weight")


def _rate(cap: float) -> Column:
    z = F.col("size") / F.col("mean")
    return F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(cap)).otherwise(F.exp(F.least(F.col("lam") * z, F.lit(math.log(cap)))))


def _exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms, so that reruns agree to the last digit."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")


def _newton(hist: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """state with each source's lambda."""
    top, before = F.lit(math.log(cap)), state
    for _ in range(STEPS):
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        mass = F.col("n") * F.col("size") * F.exp(F.least(tilt, top))
        sums = (
            hist.join(state.filter("not full").select("sid", "lam", "mean"), "sid")
            .groupBy("sid")
            .agg(_exact_sum(mass).alias("f"), _exact_sum(F.when(tilt < top, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        gap = F.log("f") - F.log("target")
        state = state.drop("f", "gap").join(sums, "sid", "left").withColumn("gap", F.when(F.col("full"), 0.0).otherwise(gap))
        state = state.withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("gap") * F.col("f") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        done = F.col("full") | (F.abs("gap") <= TOLERANCE)
        state = materialize(state.withColumn("lam", F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("slope"))
        discard(before)
        before = state
        worst = state.agg(F.max(F.abs("gap"))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: its size, target, tilt and cut. sized: rows of source, size, u."""
    hist = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    words = F.col("n") * F.col("size")
    positive = F.col("size") > 0
    sizes = hist.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum(F.when(positive, F.col("n"))).alias("docs"), F.min(F.when(positive, F.col("size"))).alias("least"))
    state = source_targets(sizes, weights, share, cap)
    ratio = F.col("target") / F.col("source_size")
    state = state.withColumn("mean", F.coalesce(F.col("source_size") / F.col("docs"), F.lit(1.0)))
    state = state.withColumn("full", (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * F.lit(cap) * F.lit(1 - 1e-12)))
    # The root lies between 0 and the tilt at which even the shortest document has the whole ratio, or the cap.
    steepest = F.when(ratio < 1, F.log(ratio)).otherwise(F.lit(math.log(cap))) * F.col("mean") / F.col("least")
    start = F.when(F.col("full"), 0.0).otherwise(F.log(ratio))
    state = state.withColumn("lo", F.coalesce(F.least(F.lit(0.0), steepest), F.lit(0.0)) - 1e-9).withColumn("hi", F.coalesce(F.greatest(F.lit(0.0), steepest), F.lit(0.0)) + 1e-9)
    state = materialize(state.withColumn("lam", start))
    whole = hist
    hist = materialize(hist.filter(positive).join(state.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n"))
    discard(whole)
    state = tilts = _newton(hist, state, cap)
    base = hist.join(state, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * F.floor(_rate(cap))).alias("base"))
    state = materialize(state.join(base, "sid", "left").withColumn("rest", F.round("target").cast("long") - F.coalesce("base", F.lit(0).cast("long"))).select("sid", "source", "source_size", "target", "mean", "full", "lam", "rest"))
    discard(tilts)
    # The cut: the range of u / fraction in which the rest is used up, then the value in it.
    rows = _tilted(sized, state, cap).filter(F.col("part").isNotNull())
    fine = F.floor(F.col("part") / (F.col("part") + 1) * (RANGES * RANGES)).cast("long")
    rows = rows.select("sid", "rest", "size", "part", F.floor(fine / F.lit(RANGES)).cast("long").alias("coarse"), fine.alias("fine"))
    upward = Window.partitionBy("sid").rowsBetween(Window.unboundedPreceding, -1)

    def crossing(sums: DataFrame, by: str) -> DataFrame:
        """The row of each source in which the rest is used up, with the words before it."""
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(upward.orderBy(by)), F.lit(0).cast("long")))
        return sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))

    words, start = F.sum("size").alias("words"), F.lit(0).cast("long").alias("start")
    first = materialize(crossing(rows.groupBy("sid", "rest", "coarse").agg(words).select("*", start), "coarse").select("sid", "coarse", F.col("before").alias("start")))
    inner = rows.join(first, ["sid", "coarse"])
    second = materialize(crossing(inner.groupBy("sid", "rest", "start", "fine").agg(words), "fine").select("sid", "fine", F.col("before").alias("start")))
    values = rows.join(second, ["sid", "fine"]).groupBy("sid", "rest", "start", "part").agg(words, F.count(F.lit(1)).alias("tied"))
    cuts = crossing(values, "part").select("sid", F.col("part").alias("cut"), F.floor((F.col("rest") - F.col("before")) / F.col("tied")).alias("at_cut"))
    found = materialize(state.join(cuts, "sid", "left"))
    discard(state, hist, first, second)
    return found


def _tilted(sized: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """sized with its source's row of the plan, its rate, whole copies and u / fraction (null without one).

    The plan has one row for each source: Spark broadcasts it while it is small, and splits the skewed
    sides of a sorted join beyond that."""
    state = state.withColumnRenamed("source", "_source")
    rows = sized.join(state, sized["source"].eqNullSafe(state["_source"])).drop("_source").withColumn("rate", _rate(cap))
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    return rows.withColumn("part", F.when((F.col("size") > 0) & (F.col("part") > 0), F.col("u") / F.col("part")))


def _extra() -> Column:
    """Words beyond the whole copies. Where no cut was found, nothing is left to deal."""
    part, cut = F.col("part"), F.col("cut")
    return F.when(part < cut, F.col("size")).when(part == cut, F.col("at_cut")).otherwise(F.lit(0).cast("long"))


def sized_rows(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", row: bool = False) -> DataFrame:
    """doc_id, source, size and draw of each document, and the whole row as a struct if wanted."""
    whole = [F.struct(*quoted(df.columns)).alias("row")] if row else []
    return df.select(*whole, F.col(doc).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).withColumn("u", _draw("doc_id", "source", "size"))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """For each document its size, its source's size and target, its rate, and the words that the mix
    takes of it; a source's words end with one partial copy."""
    sized = materialize(sized_rows(df))
    rows = _tilted(sized, plan(sized, weights, share, cap), cap)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + _extra()).alias("taken"), "rate")


def mixed_copies(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, a partial copy rounded to the nearer
    number. Texts are read once more, not shuffled."""
    sized = sized_rows(df, row=True)
    rows = _tilted(sized, plan(materialize(sized_rows(df)), weights, share, cap), cap)
    copies = F.col("whole") + F.when(F.col("size") > 0, F.round(_extra() / F.col("size"))).otherwise(F.lit(0.0))
    return rows.withColumn("copies", copies.cast("int")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
