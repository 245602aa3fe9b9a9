"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates w in [0, 3] whose words meet each source's target, entropy balancing takes those closest (in
Kullback-Leibler divergence) to one copy each. They are exponential tilts of the constraint's own column, a document's
words: w = min(3, exp(lambda_source * words / scale)). The convex dual is solved by Newton steps, each one aggregation
over the table of distinct (source, words) pairs; a bracket around the root replaces a step that leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, two_level_rank, word_count

CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh ``weights`` in turn and share all words;
    a target stops at ``cap`` times its source's words, and the excess is shared again by weight (one sorted pass:
    sources reach their cap in order of cap / weight). The pass runs over one row of four numbers a source in one task: a
    million sources are some 50 MB there."""
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    limit = cap * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    own = (own.withColumn("limit", limit.cast("double"))
           .withColumn("before_limit", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("total", F.sum("source_size").over(everything)))
    level = (F.col("total") - F.col("before_limit")) / F.col("weight_left")
    own = own.withColumn("level", F.when(F.col("limit") / F.col("weight") >= level, level))
    # the first source in order that stays below its cap sets the level for all that follow
    own = own.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("limit") / F.col("weight"))).over(everything))
    return own.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _rate(size: Column, scale: Column, dual: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(60.0), dual * size / scale)))


def solve_dual(hist: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-4, most_rounds: int = 200) -> DataFrame:
    """(source, dual, scale, full) by distributed Newton steps over ``hist`` (source, size, docs).

    ``full`` marks a source whose target is its cap, where every rate is ``cap``. Stops when every source's expected
    words are within ``tolerance`` of its target or its bracket has closed; a bracket halves in every other step at
    least, so ``most_rounds`` is never reached by a finite table."""
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("size") * F.col("docs")) / F.sum(F.col("size") * F.col("docs"))).alias("scale"))
    start = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size"))
    state = materialize(targets.join(mean, targets["source"].eqNullSafe(mean["source"])).drop(mean["source"])
                        .where("source_size > 0")
                        .select("source", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), (F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)).alias("full"),
                                start.alias("dual"), F.lit(-4000.0).alias("low"), F.lit(4000.0).alias("high")))
    n = state.count()  # one row a source
    for _ in range(most_rounds):
        h = hist.select(F.col("source").alias("_s"), "size", "docs")
        rate = _rate(F.col("size"), F.col("scale"), F.col("dual"), cap)
        # the slope of a clipped rate is zero
        slope = F.when(F.col("rate") < cap, F.col("words") * F.col("size") / F.col("scale")).otherwise(0.0)
        keys = list(state.columns)
        got = h.join(maybe_broadcast(state, n), h["_s"].eqNullSafe(state["source"])).withColumn("rate", rate).withColumn("words", F.col("size") * F.col("docs") * F.col("rate")).groupBy(*keys).agg(F.sum("words").alias("f"), F.sum(slope).alias("g"))
        # one column at a time, so that no expression is repeated inside the next
        got = (got.withColumn("off", F.col("f") - F.col("target"))
               .withColumn("low", F.when(F.col("off") < 0, F.col("dual")).otherwise(F.col("low")))
               .withColumn("high", F.when(F.col("off") >= 0, F.col("dual")).otherwise(F.col("high")))
               .withColumn("step", F.col("dual") - F.col("off") / F.col("g"))
               .withColumn("narrow", F.when(F.abs("low") > 2000, F.col("high") - 2 - 2 * F.abs("high")).when(F.abs("high") > 2000, F.col("low") + 2 + 2 * F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2))
               .withColumn("good", F.expr("g > 0 and step > low and step < high and abs(step - dual) < 8"))
               .withColumn("settled", F.col("full") | (F.abs("off") <= tolerance * F.col("target")) | (F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("dual"))))))
        got = got.select("source", "source_size", "target", "scale", "full", F.when(F.col("settled"), F.col("dual")).when(F.col("good"), F.col("step")).otherwise(F.col("narrow")).alias("dual"), "low", "high", "settled")
        got = materialize(got, n)
        state = got.drop("settled")
        if got.where("not settled").isEmpty():
            return state
    raise RuntimeError(f"the dual did not settle in {most_rounds} Newton steps")


def rounded_cells(hist: DataFrame, targets: DataFrame, state: DataFrame, cap: int, repairs: int) -> DataFrame:
    """(source, size, docs, rate, total): how many copies all documents of one source and size are taken together.

    Rates are rounded systematically in order of size, so what neighbours lose or gain cancels. Then the best of the
    source's cells, ``repairs`` times over, takes one copy more or less, which leaves at most half of the smallest size
    to spare. All steps work on cells; documents are not touched."""
    n = targets.count()
    st = state.select(F.col("source").alias("_s"), "dual", "scale", "full")
    rated = hist.join(maybe_broadcast(st, n), hist["source"].eqNullSafe(st["_s"]), "left").drop("_s")
    rate = F.when((F.col("size") == 0) | F.col("dual").isNull(), 1.0).when(F.col("full"), float(cap)).otherwise(_rate(F.col("size"), F.col("scale"), F.col("dual"), cap))
    rated = rated.withColumn("rate", rate).withColumn("part", (F.col("rate") - F.floor("rate")) * F.col("docs"))
    run = F.sum("part").over(Window.partitionBy("source").orderBy(F.desc("size")))  # one row for each distinct size of a source
    rated = rated.withColumn("upto", run).withColumn("extra", (F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5)).cast("long"))
    cells = materialize(rated.select("source", "size", "docs", "rate", (F.col("docs") * F.floor("rate") + F.col("extra")).cast("long").alias("total")))
    goal = maybe_broadcast(targets.select(F.col("source").alias("_s"), "target"), n)
    for _ in range(repairs):
        rest = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("total")).alias("_t")).join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("_s", (F.col("target") - F.col("_t")).alias("_rest"))
        open_ = cells.join(maybe_broadcast(rest, n), cells["source"].eqNullSafe(rest["_s"]))
        more = F.col("_rest") >= 0
        better = F.abs(F.abs("_rest") - F.col("size"))
        fits = (F.col("size") > 0) & (better < F.abs("_rest")) & F.when(more, F.col("total") < cap * F.col("docs")).otherwise(F.col("total") > 0)
        best = open_.where(fits).groupBy("_s").agg(F.min_by(F.struct("size", F.when(more, 1).otherwise(-1).alias("sign")), F.struct(better, F.col("size"))).alias("p")).select("_s", F.col("p.size").alias("_z"), F.col("p.sign").alias("_sign"))
        best = materialize(best, n)
        if best.isEmpty():
            break
        cells = materialize(cells.join(maybe_broadcast(best, n), cells["source"].eqNullSafe(best["_s"]) & (cells["size"] == best["_z"]), "left")
                            .select("source", "size", "docs", "rate", (F.col("total") + F.coalesce("_sign", F.lit(0))).alias("total")))
    return cells


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, bucket_rows: int = 1000, repairs: int = 3) -> DataFrame:
    """Copies of each document that bring every source to its target: the columns doc_id, source, size, source_size,
    target, rate, copies, taken, row_hash.

    Size is the number of words; null and empty texts have size 0 and are taken as 0 words (one copy). A null source is
    a source of its own, last in order. Repeated rows count as documents of their own, each with copies of its own;
    ``row_hash`` is a hash of doc_id, source and text, alike for repeated rows only (see ``take``). No rows give no
    rows; extra columns are ignored. Reruns agree.
    """
    hashed = F.xxhash64("doc_id", "source", "text")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed.alias("row_hash")))
    hist = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("docs")))
    targets = materialize(source_targets(hist.select("source", (F.col("size") * F.col("docs")).alias("size")), weights, cap))  # one row a source
    cells = rounded_cells(hist, targets, solve_dual(hist.where("size > 0"), targets, cap), cap, repairs)
    most = cells.agg(F.max("docs")).first()[0] or 1
    ranked = two_level_rank(sized, ["source", "size"], F.xxhash64("doc_id", "row_hash"), [F.xxhash64("doc_id"), "doc_id", "row_hash"], -(-most // bucket_rows), "_rank")
    c = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "docs", "rate", "total")
    copies = (F.expr("total div docs") + (F.col("_rank") <= F.expr("total % docs")).cast("int")).cast("int")
    taken = ranked.join(c, ranked["source"].eqNullSafe(c["_s"]) & (ranked["size"] == c["_z"])).select("doc_id", "source", "size", "rate", copies.alias("copies"), "row_hash")
    small = maybe_broadcast(targets.select(F.col("source").alias("_t"), "source_size", "target"), targets.count())
    return (taken.join(small, taken["source"].eqNullSafe(F.col("_t")))
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "row_hash"))


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``plan`` (of ``mix`` over the same rows) takes it; the columns stay as they are.

    Rows that repeat doc_id, source and text are told apart only where the plan takes some of them more often than
    others; then their numbers of copies are dealt out in order. Reruns may pick another of these like rows.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # names of our own, so that none can clash
    at = {c: n for c, n in zip(docs.columns, names)}
    own = docs.toDF(*names).withColumn("_h", F.xxhash64(F.col(at["doc_id"]).cast("long"), at["source"], at["text"]))
    alike = plan.groupBy("row_hash").agg(F.min("copies").alias("_low"), F.max("copies").alias("_high"), F.count("*").alias("_n"), F.sum("copies").alias("_sum"))
    other = materialize(alike.where("_low <> 1 or _high <> 1"))
    joined = own.join(maybe_broadcast(other, other.count()), F.col("_h") == F.col("row_hash"), "left")
    plain = joined.where("_low <=> _high").withColumn("_k", F.coalesce("_low", F.lit(1)))
    # rows taken unevenly, numbered once and for all before they are ranked
    mixed = other.where("_low <> _high")
    uneven = materialize(own.join(maybe_broadcast(mixed, mixed.count()), F.col("_h") == F.col("row_hash")).withColumn("_id", F.monotonically_increasing_id()))
    buckets = -(-(mixed.agg(F.max("_n")).first()[0] or 1) // 1000)
    ranked = two_level_rank(uneven.select("_h", "_id", "_n", "_sum"), ["_h"], F.xxhash64("_id"), ["_id"], buckets, "_rank")
    dealt = ranked.select("_id", (F.expr("_sum div _n") + (F.col("_rank") <= F.expr("_sum % _n")).cast("int")).cast("int").alias("_k"))
    every = plain.select(*names, "_k").unionByName(uneven.join(dealt, "_id").select(*names, "_k"))
    return every.where("_k > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("_e")).select(*names).toDF(*docs.columns)
