"""Mixing sources to target weights by systematic sampling over prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small
from .graph import checkpoint

#: Documents of one source and size that one task ranks, about.
RUN = 50_000


def size(text: str = "text") -> F.Column:
    """Number of words of a text, 0 for null: a character that is no space where a word begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), a row for each source.

    Sources in order of code points, null last, take the weights in turn and share ``share`` times all words. A target
    stops at ``most`` times its source; what that leaves over goes to the others by weight until none is above.
    Sorted by the level at which a source fills up, the sources that fill are a prefix, found by running sums.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source: few, whatever the number of documents
    level = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    at = F.array(*(F.lit(x) for x in weights))
    df = sizes.withColumn("weight", F.element_at(at, (F.row_number().over(w) - 1) % len(weights) + 1).cast("double"))
    df = df.withColumns({"cap": most * F.col("source_size"), "cap_level": most * F.col("source_size") / F.col("weight"), "total": F.sum("source_size").over(everything) * share, "all_weight": F.sum("weight").over(everything)})
    df = df.withColumn("share_level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the water level is the first share that its own source can take; where the sum reaches every cap there is none
    df = df.withColumn("water", F.min(F.when(F.col("share_level") <= F.col("cap_level"), F.struct("cap_level", "share_level"))).over(everything)["share_level"])
    return df.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def _run(cuts: str) -> F.Column:
    """The run of a doc_id: how many of the ascending cuts it reaches; those of null follow, by the hash. Of k cuts, about 2 sqrt(k) are compared."""
    step = f"cast(ceil(sqrt(size({cuts}))) as int)"
    coarse = f"size(filter(transform(sequence(1, cast(size({cuts}) / {step} as int)), i -> {cuts}[i * {step} - 1]), c -> c <= doc_id))"
    fine = f"size(filter(slice({cuts}, {coarse} * {step} + 1, {step}), c -> c <= doc_id))"
    return F.expr(f"case when {cuts} is null then 0 when doc_id is null then size({cuts}) + 1 + cast(_tie / 9223372036854775808D * _runs as int) when size({cuts}) = 0 then 0 else {coarse} * {step} + {fine} end")


def _dealt(keyed: DataFrame, most_runs: int) -> DataFrame:
    """keyed with _run, the range of doc_id within a source and size, and _ahead, the documents of earlier runs.

    Cuts are approximate quantiles, kept before use since they need not be the same twice; counts of the runs are exact.
    """
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    hot = keyed.where("_runs > 1").groupBy("source", "size").agg(F.max("_runs").alias("_n"), F.percentile_approx("doc_id", [k / most_runs for k in range(1, most_runs)], max(10_000, 20 * most_runs)).alias("_all"))
    cuts = F.expr(f"array_sort(array_distinct(transform(sequence(1, _n - 1), i -> _all[cast(ceil(i * {most_runs} / _n) as int) - 1])))")
    hot = checkpoint(hot.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.coalesce(cuts, F.array().cast("array<bigint>")).alias("_cuts")))
    keyed = keyed.join(F.broadcast(hot), same, "left").drop("_source", "_size").withColumn("_run", _run("_cuts")).drop("_cuts")
    runs = keyed.where("_runs > 1").groupBy("source", "size", "_run").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = checkpoint(runs.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_run").alias("_of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_ahead")))
    return keyed.join(small(runs), same & (F.col("_run") == F.col("_of")), "left").drop("_source", "_size", "_of").withColumn("_ahead", F.coalesce("_ahead", F.lit(0)))


def copies(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), sized: bool = False) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    Every document of a source is expected target / source_size times. Within a source, in order of size and of doc_id, nulls last, the
    expectations are summed, one offset drawn from the seed and the source is added, and a document is emitted once for each integer that
    its own part of the sum crosses. In this order each stretch of similar sizes gets its share, so words come near
    the target. No document gets more than ``most`` copies, rounded up.

    Sums are found in three steps, none of which brings a source together in one task: over the sizes of a source, over
    the runs of a size, which are ranges of doc_id (a whole number) cut at about every RUN documents, and over the documents of a run.
    Where the cuts fall, and whether there are any, does not change the order. Rows of one source, size and doc_id follow the hash of all their columns (maps apart),
    so that which of them is repeated is the same at every run; they share a run, whatever their number, save null ids, which that hash deals out. Null texts have size 0, null sources are one source. With ``sized``, docs has its sizes already and text is not read. The new columns
    replace columns of these names; docs is read more than once and must be deterministic.
    """
    base = docs if sized else docs.withColumn("size", size())
    sized = checkpoint(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = sized.withColumn("_before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("_runs", F.expr(f"cast(ceil(n / {RUN}) as int)"))
    of_size = of_size.join(F.broadcast(goal) if goal.limit(100_001).count() <= 100_000 else goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"]).drop("n")
    keyed = base.drop("source_size", "target", "copies", "taken")
    # whole numbers from 0 to 2**63 - 1
    keyed = keyed.withColumn("_tie", F.shiftrightunsigned(F.xxhash64(*(c for c in keyed.columns if "map<" not in dict(keyed.dtypes)[c])), 1))
    keyed = keyed.join(of_size.withColumnsRenamed({"source": "_source", "size": "_size"}), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    most_runs = -(-(sized.agg(F.max("n")).first()[0] or 1) // RUN)
    ranked = _dealt(keyed, most_runs) if most_runs > 1 else keyed.withColumns({"_run": F.lit(0), "_ahead": F.lit(0)})
    own = Window.partitionBy("source", "size", "_run").orderBy(F.col("doc_id").asc_nulls_last(), "_tie")
    rank = F.col("_before") + F.col("_ahead") + F.row_number().over(own)
    ranked = ranked.withColumn("_rank", rank)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    ranked = ranked.withColumns({"_rate": rate, "_offset": offset})
    n = F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_offset"))
    return ranked.withColumn("copies", n.cast("int")).withColumn("taken", F.col("copies") * F.col("size")).drop("_before", "_runs", "_run", "_ahead", "_rank", "_rate", "_offset", "_tie")


def mix(docs: DataFrame, **how: float) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says, with its number in column copy, from 1."""
    names = docs.columns
    return copies(docs, **how).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(*names, "copy")
