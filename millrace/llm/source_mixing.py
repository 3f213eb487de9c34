"""Mixing sources to target weights by Pareto order sampling.

Every document of a source first gets the whole copies that its source's ratio
of target to size makes certain. The rest is a sample: a document's rank is its
random odds divided by the odds of its inclusion, and documents are taken in
that order until the source has its words. A document's inclusion odds are those
of its source times its length over the source's mean, so longer documents are
likelier to be repeated. The order's cut is found from sums per slice of ranks,
so that no source is ever sorted as a whole. Equal rows have equal ranks; if the
cut falls among them, as many of them are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"

# Ranks are cut into so many slices, and the slice with the cut into as many again.
SLICES = 4096
# A document's inclusion odds are at most so many times those of a document of mean length, and at least one over that.
MOST_FAVOUR = 4.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("string")), F.lit(""))


def draw(key: Column, digest: Column, seed: str) -> Column:
    """A number between 0 and 1 that depends on key and text."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    Weights repeat over the sources in code-point order, null last. All targets
    add up to ``share`` of all sizes; none exceeds ``most`` times its source's
    size, and what is cut off goes to the others by weight. With sources in
    order of size per weight, the full ones come first: the level of the others
    is the rest divided by their weights. The windows run over one narrow row
    per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    room = F.col("source_size") * F.lit(most)
    all_ = Window.partitionBy()
    by_room = Window.orderBy((room / F.col("weight")), F.col("source").asc_nulls_last())
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.select(
        "source",
        "source_size",
        "weight",
        room.alias("room"),
        (F.sum("source_size").over(all_) * F.lit(share)).alias("wanted"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weight_left"),
        F.coalesce(F.sum(room).over(earlier), F.lit(0.0)).alias("room_before"),
    )
    level = (F.col("wanted") - F.col("room_before")) / F.col("weight_left")
    # The first source that its level does not fill, and all after it, get that level.
    opened = ranked.withColumn("level", F.when(level * F.col("weight") < F.col("room"), level))
    opened = opened.withColumn("level", F.max("level").over(all_))
    target = F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room")))
    return opened.select("source", "source_size", target.alias("target"))


def favour(size: Column, source_size: Column, source_docs: Column) -> Column:
    """Length over the source's mean, within bounds; 1 in a source without words."""
    ratio = size * source_docs / source_size
    return F.when(source_size > 0, F.greatest(F.least(ratio, F.lit(MOST_FAVOUR)), F.lit(1 / MOST_FAVOUR))).otherwise(1.0)


def rank(u: Column, chance: Column, odds: Column) -> Column:
    """Random odds over inclusion odds, brought between 0 and 1 in the same order."""
    ratio = (u / (F.lit(1.0) - u)) * ((F.lit(1.0) - chance) / chance) / odds
    return F.when((chance > 0) & (chance < 1), ratio / (F.lit(1.0) + ratio)).otherwise(u)


def plan(sized: DataFrame, targets: DataFrame, seed: str = "mix", odds: Column | None = None) -> DataFrame:
    """Per source: ``whole`` copies for all and the cut up to which documents get one more.

    ``sized`` has ``key``, ``digest``, ``source`` and ``size``, ``targets`` also ``source_docs``;
    ``odds`` replaces the usual favour. The cut is a rank, a key and a digest,
    and the number of rows equal in these that still are taken.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets.select(
        "source",
        "source_size",
        "source_docs",
        "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("chance"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("need"),
    )
    # One row per source; the file's size decides how it is joined.
    shares = stored(shares)
    ranked = ranked_rows(sized, shares, seed, odds).where("chance > 0").withColumn("slice", F.floor(F.col("rank") * SLICES))
    found = stored(_crossing(ranked, "slice", F.col("need"), "at", "before"))
    finer = F.floor((F.col("rank") * SLICES - F.col("slice")) * SLICES)
    inside = _same_source(ranked, found).where("slice = at").withColumn("slice2", finer)
    found2 = stored(_crossing(inside, "slice2", F.col("need") - F.col("before"), "at2", "before2"))
    left = F.col("need") - F.col("before") - F.col("before2")
    # Equal rows are one row with their number, however many they are.
    last = _same_source(inside, found2).where("slice2 = at2").groupBy("source", "rank", "key", "digest", "size").agg(F.count("*").alias("n"), F.first(left).alias("left"))
    earlier = Window.partitionBy("source").orderBy("rank", "key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(earlier), F.lit(0))
    # A document is taken if at least half of it still fits.
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.col("free") / F.col("size") + 0.5))).otherwise(F.when(F.col("free") >= 0, F.col("n")))
    fits = last.withColumn("free", free).withColumn("fit", fit).where("fit > 0")
    cuts = fits.groupBy("source").agg(F.max(F.struct("rank", "key", "digest", "fit")).alias("cut"))
    slices = _same_source(_same_source(shares, found), found2)
    # Where no document of the last slice fits, the cut lies just before that slice.
    floor = (F.col("at") + F.col("at2") / F.lit(float(SLICES))) / F.lit(float(SLICES))
    cut = _same_source(slices, cuts)
    return cut.select(
        "source",
        "source_size",
        "source_docs",
        "target",
        "whole",
        "chance",
        F.coalesce(F.col("cut.rank"), floor).alias("cut_rank"),
        F.col("cut.key").alias("cut_key"),
        F.col("cut.digest").alias("cut_digest"),
        F.coalesce("cut.fit", F.lit(0)).alias("cut_rows"),
    )


def ranked_rows(rows: DataFrame, shares: DataFrame, seed: str, odds: Column | None) -> DataFrame:
    if odds is None:
        odds = favour(F.col("size"), F.col("source_size"), F.col("source_docs"))
    return _same_source(rows, shares).withColumn("rank", rank(draw(F.col("key"), F.col("digest"), seed), F.col("chance"), odds))


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join with one row per source; a null source is a source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _crossing(ranked: DataFrame, slice_: str, need: Column, at: str, before: str) -> DataFrame:
    """Per source the slice in which the words reach ``need``, or else the last, and the words before it."""
    sums = ranked.groupBy("source", slice_).agg(F.sum("size").alias("size"), F.first(need).alias("need"))
    earlier = Window.partitionBy("source").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("sum", F.coalesce(F.sum("size").over(earlier), F.lit(0))).where("sum < need")
    return running.groupBy("source").agg(F.max(slice_).alias(at), F.max("sum").alias(before))


def taken_copies(rows: DataFrame, cuts: DataFrame, seed: str = "mix", odds: Column | None = None) -> DataFrame:
    """``rows`` (with ``key``, ``digest``, ``source`` and ``size``) and their number of ``copies``.

    All but the rows at the cut itself are decided row by row. Those are equal in
    key and text; they are numbered per task and the tasks' counts are added up.
    """
    ranked = ranked_rows(rows, cuts, seed, odds).withColumn("chance", F.coalesce("chance", F.lit(0.0)))
    at_cut = (F.col("chance") > 0) & (F.col("rank") == F.col("cut_rank")) & F.col("key").eqNullSafe(F.col("cut_key")) & (F.col("digest") == F.col("cut_digest"))
    at_cut = F.coalesce(at_cut, F.lit(False))
    before = F.col("rank") < F.col("cut_rank")
    # Two texts with the rank of the cut, which hardly occurs, go by key and digest, null first.
    earlier = F.struct("key", "digest") < F.struct(F.col("cut_key").alias("key"), F.col("cut_digest").alias("digest"))
    tied = (F.col("rank") == F.col("cut_rank")) & F.col("cut_digest").isNotNull() & earlier
    one_more = F.coalesce((F.col("chance") > 0) & (before | tied), F.lit(False))
    decided = ranked.where(~at_cut).withColumn("copies", F.col("whole") + one_more.cast("int"))
    equal = stored(ranked.where(at_cut).withColumn("_task", F.spark_partition_id()))
    counts = equal.groupBy("source", "_task").agg(F.count("*").alias("_n"))
    tasks = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("_source"), F.col("_task").alias("_from"), F.coalesce(F.sum("_n").over(tasks), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("source", "_task").orderBy("key"))
    numbered = equal.withColumn("_number", number).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_task") == F.col("_from")))
    chosen = numbered.withColumn("copies", F.col("whole") + (F.col("_number") + F.col("_offset") <= F.col("cut_rows")).cast("int"))
    inner = ["rank", "whole", "chance", "cut_rank", "cut_key", "cut_digest", "cut_rows", "source_docs"]
    return decided.drop(*inner).unionByName(chosen.select(*decided.columns).drop(*inner))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of every row.

    A null text has no words; an empty table gives none. A null source is a
    source of its own. The draw depends on seed, key and text only, so reruns
    agree; rows equal in key and text count as one row that occurs so often, and
    the cut may fall among them. Documents without a word add nothing.
    """
    sized, cuts = sized_plan(docs, weights, share, most, seed, key, text, source)
    chosen = taken_copies(sized, cuts, seed)
    return chosen.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sized_plan(docs: DataFrame, weights, share, most, seed, key, text, source) -> tuple[DataFrame, DataFrame]:
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), digest(F.col(text)).alias("digest"))
    # Counting words is the costly part: done once.
    sized = stored(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    sizes = stored(sizes)
    targets = _same_source(source_targets(sizes, weights, share, most), sizes.select("source", "source_docs"))
    return sized, stored(plan(sized, targets, seed))


def repeat_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the columns it had; of no rows, none."""
    _, cuts = sized_plan(docs, weights, share, most, seed, key, text, source)
    held = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), digest(F.col(text)).alias("digest")
    )
    copies = taken_copies(held, cuts.drop("target"), seed)
    return copies.select("row", F.explode(F.expr("array_repeat(0, copies)"))).select("row.*")
