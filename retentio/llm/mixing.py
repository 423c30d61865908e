"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) r_i in [0, 2].  Among all rates
that meet the token target of each source the ones closest to 1 in relative
entropy are taken; the convex dual has one multiplier per source, and the
rates are exponentially tilted: r_i = min(2, exp(lambda_s * x_i)) with x_i the
document's size over the mean size of its source.  The multipliers are found
by safeguarded Newton steps; each step is one distributed aggregation of the
dual's gradient and curvature over the (source, size) histogram, and the state
is written, so a step can be repeated after a lost executor.

Rates become copies by systematic rounding: the rates of a source are summed
in order of size, and a size class gets a copy wherever the sum passes a half;
neighbouring classes have nearly equal sizes, so the tokens miss the target by
about one document at most, and the few words left are made up by single
copies of the largest sizes that fit.  A class deals its copies evenly to its
documents by their place, which comes from ``rank_in``: no source or size is
gathered in one task.

DataFrame functions only.  Defined results: null text has size 0; size 0
takes 0; a null source sorts last; repeated rows are documents of their own;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm.common import join_on, materialise, rank_in, with_row_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_RATE = 2.0
TOLERANCE = 1e-10
MAX_STEPS = 200
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    """Number of words: characters that begin one.  (Counted by dropping all
    else, so no array of words is built.)"""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """source, source_size, n, target.  One row per source; the windows run
    over that small table.

    Handing the excess of capped sources to the others by weight until none is
    above its cap ends at a water level: target = min(cap, weight * level).
    Sources are taken by cap / weight; the level is that of the first one that
    stays under its cap when all before it are capped.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("k", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(max_rate) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.lit(share) * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("level", F.try_divide(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                                           F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in this order, whose cap the level leaves unreached
    s = s.withColumn("water", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "k", "level")))
                               .over(every).getField("level"))
    return s.select("source", "source_size", "n",
                    F.when(F.col("water").isNull(), F.col("cap"))
                     .otherwise(F.least(F.col("cap"), F.col("w") * F.col("water"))).alias("target"))


def solve_tilts(hist: DataFrame, targets: DataFrame, max_rate: float = MAX_RATE,
                tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """targets plus ``tilt``, the dual multiplier (null: every rate is at its maximum).

    The relative gap is convex in the multiplier only piecewise (rates stop at
    the maximum), so a step that leaves the bracket is replaced by bisection.
    """
    unknown = F.lit(None).cast("double")
    # written each time, so its size is known and a small one is broadcast by the planner
    state = materialise(targets.withColumn("mean", F.try_divide(F.col("source_size").cast("double"), F.col("n"))) \
                   .withColumn("tilt", F.lit(0.0)).withColumn("low", unknown).withColumn("high", unknown) \
                   .withColumn("full", F.col("target") >= max_rate * F.col("source_size")) \
                   .withColumn("open", ~F.col("full")), "tilt")
    for _ in range(max_steps):
        # documents of size zero carry no tokens and no gradient
        at = join_on(hist.filter("size > 0"), state.filter("open"), ["source"])
        x = F.col("size") / F.col("mean")
        z = F.col("tilt") * x
        rate = F.when(z >= F.log(F.lit(max_rate)), F.lit(max_rate)).otherwise(F.exp(z))
        tokens = F.col("count") * F.col("size")
        sums = at.groupBy("source").agg(
            F.sum(tokens * rate).alias("got"), F.sum(F.when(rate < max_rate, tokens * x * rate).otherwise(0.0)).alias("slope"))
        new = join_on(state, sums, ["source"], "left")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        inside = F.coalesce(step > low, F.lit(True)) & F.coalesce(step < high, F.lit(True)) & step.isNotNull()
        bisect = F.when(low.isNull(), 2 * F.col("tilt") - 1).when(high.isNull(), 2 * F.col("tilt") + 1).otherwise((low + high) / 2)
        moving = F.coalesce(F.col("open") & (F.abs(gap) > tolerance * F.col("target")), F.lit(False))
        moved = F.when(moving, F.when(inside, step).otherwise(bisect)).otherwise(F.col("tilt"))
        state = materialise(new.select(*targets.columns, "mean", moved.alias("tilt"), low.alias("low"), high.alias("high"), "full",
                           (moving & (moved != F.col("tilt"))).alias("open")), "tilt")
        if state.filter("open").isEmpty():
            break
    else:
        raise RuntimeError(f"no tilt found within {max_steps} steps for {state.filter('open').count()} sources")
    return state.select(*targets.columns, "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken; the row key; and the columns ``keep`` of ``docs``."""
    rows = materialise(with_row_key(docs.select("doc_id", "source", "text", *keep))
                       .select("doc_id", "__id", "__th", "source", n_words("text").alias("size"), *keep), "sizes")
    hist = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("count")), "sizes-hist")
    targets = source_targets(rows, weights, share, max_rate)
    tilts = materialise(solve_tilts(hist, targets, max_rate), "tilts")
    classes = join_on(hist, tilts, ["source"])
    z = F.col("tilt") * (F.col("size") / F.col("mean"))
    rate = F.when(F.col("tilt").isNull() | (z >= F.log(F.lit(max_rate))), F.lit(max_rate)).otherwise(F.exp(z))
    classes = classes.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    placed = rank_in(rows, ["source", "size"], ["__id", "__th"], "mix")
    both = join_on(placed, class_copies(classes, max_rate), ["source", "size"])
    share_of = lambda k: F.floor(k * F.col("class_copies") / F.col("count"))
    copies = (share_of(F.col("rank") + 1) - share_of(F.col("rank"))).cast("bigint")
    return both.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"), "__id", "__th", *keep)


def class_copies(classes: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Adds ``class_copies``: copies of all documents of a (source, size) class together.

    Systematic rounding along the sizes first; the words still missing (or
    over) are then made up by the largest sizes that fit, down to the smallest.
    Both run over the size histogram of a source, which has at most as many
    rows as it has different sizes, never over its documents.
    """
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    most = F.floor(F.lit(max_rate) * F.col("count")).cast("bigint")
    before = F.coalesce(F.sum(F.col("rate") * F.col("count")).over(smaller), F.lit(0.0))
    rounded = F.floor(before + F.col("rate") * F.col("count") + 0.5) - F.floor(before + 0.5)
    c = materialise(classes.withColumn("k", F.least(rounded.cast("bigint"), most)).withColumn("most", most), "classes")
    per = c.filter("size > 0").groupBy("source").agg(
        (F.round(F.first("target")).cast("bigint") - F.sum(F.col("k") * F.col("size"))).alias("missing"),
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "k", "most")))).alias("sizes"))
    start = F.struct(F.col("missing").alias("missing"), F.expr("cast(array() as array<struct<size:bigint,more:bigint>>)").alias("moves"))

    def step(state, x):
        want = F.expr("0") + state["missing"]
        fits = F.floor(F.abs(want) / x["size"]).cast("bigint")
        more = F.when(want > 0, F.least(fits, x["most"] - x["k"])).otherwise(-F.least(fits, x["k"]))
        move = F.array(F.struct(x["size"].alias("size"), more.alias("more")))
        return F.when(more == 0, state).otherwise(F.struct(
            (want - more * x["size"]).alias("missing"), F.concat(state["moves"], move).alias("moves")))

    moves = per.select("source", F.explode(F.aggregate("sizes", start, step)["moves"]).alias("m")).select("source", "m.size", "m.more")
    return join_on(c, moves, ["source", "size"], "left") \
        .withColumn("class_copies", F.col("k") + F.coalesce("more", F.lit(0))).drop("k", "most", "more")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it.

    The rows are numbered and written once; only numbers and copy counts meet
    the texts, so repeated rows of one document spread over all tasks."""
    numbered = materialise(docs.select(F.struct(*docs.columns).alias("__doc")).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    fields = [F.col("__doc").getField(c).alias(c) for c in ("doc_id", "source", "text")]
    taken = mix(numbered.select(*fields, "__row"), keep=("__row",), **options).filter("copies > 0").select("__row", "copies")
    return numbered.join(taken, "__row") \
                   .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
