"""Documents whose word shingles agree, joined by vertical partitioning.

All shingles have one global order: those that many documents share come last,
the others by hash. The order is cut into fragments; a document's set becomes
one segment per fragment, overlaps of two documents are counted per fragment and
summed per pair. Only pairs that share one of the first shingles of both (enough
of them that no pair above the threshold can miss) are counted.

Copies are one class from the start. Within a shingle's list the documents are
first compared with one hub each; documents that thereby belong together need no
comparison among themselves, and what is known of two documents and their hub
settles most other pairs, so a large group of near copies costs a number of
comparisons in proportion to its size. What then still shares a first shingle
without being connected is compared pair by pair: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.components import components
from millrace.llm.shared import remove, slices, stored

WORDS = 5
PERCENT = 80
FRAGMENTS = 8

# Texts unpacked at once.
SLICE = 200
# Shared shingles are counted in runs of so many; a run reports those it holds so often.
RUN_SHINGLES, RUN_LEAST = 2 << 20, 2
# The most frequent shingles, from this count on, are the common ones: at most
# 2**20 (16 MB with their counts), whatever the input.
COMMON_LEAST, MOST_COMMON = 8, 1 << 20
# The list of a common shingle is spread over lists of about so many documents.
LIST_SIZE = 512

# Bits of the filter on document keys (8 MB).
FILTER_BITS = 1 << 26

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text.

    Words are runs without ASCII white space, A-Z in lower case; a text with
    fewer than ``size`` words is one shingle, one without words has none. Two
    shingles of a compared pair fall together with a chance of 2**-64 each.
    """
    words = [(t.encode().lower().split() if t else []) for t in texts]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for ws in words for w in ws), np.uint64)
    sets, at = [], 0
    with np.errstate(over="ignore"):
        whole = max(0, len(hashes) - size + 1)
        every = np.zeros(whole, np.uint64)
        for k in range(size):
            every += hashes[k : k + whole] * MULTIPLIERS[k]
        every = _mixed(every)
        for ws in words:
            n = len(ws)
            if n >= size:
                sets.append(np.unique(every[at : at + n - size + 1]))
            elif n:
                short = (hashes[at : at + n] * MULTIPLIERS[:n]).sum(dtype=np.uint64) + np.uint64(n)
                sets.append(_mixed(np.array([short], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
            at += n
    return sets


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``n`` must share with any set it links to."""
    return -(-percent * n // 100)


def common_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents and their counts, at most ``MOST_COMMON``.

    Counted in runs, so that a task holds a bounded number: every shingle more
    frequent than ``RUN_LEAST`` - 1 times the number of runs is found. The list
    only orders the work; results do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def counted() -> pa.RecordBatch:
            # Sorted in place; only what is there again is copied and counted.
            whole = np.concatenate(held)
            held.clear()
            whole.sort()
            again, seen = np.unique(whole[1:][whole[1:] == whole[:-1]], return_counts=True)
            often = seen + 1 >= RUN_LEAST
            return pa.RecordBatch.from_arrays([pa.array(again[often].astype(np.int64)), pa.array(seen[often] + 1)], ["shingle", "seen"])

        for batch in slices(batches, SLICE):
            held.extend(shingle_sets(batch.column(0).to_pylist(), size))
            n += sum(map(len, held[-batch.num_rows :]))
            if n >= RUN_SHINGLES:
                yield counted()
                n = 0
        if held:
            yield counted()

    runs = docs.select(text).mapInArrow(run, "shingle long, seen long")
    counts = stored(runs.groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= COMMON_LEAST))
    # The least count at which the list is short enough, in steps of a twelfth.
    step = F.floor(F.log2("seen") * 8).cast("int")
    left, least = MOST_COMMON, 1 << 62
    for level, n in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= n
        if left < 0:
            break
        least = level
    rows = counts.where(step >= F.lit(min(least, 1 << 30))).toPandas()
    shingles = rows["shingle"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["seen"].to_numpy(np.int64)[order]


def _places(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Index into the sorted ``common``, or -1."""
    if not len(common):
        return np.full(len(shingles), -1)
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return np.where(common[at] == shingles, at, -1)


def document_sets(docs: DataFrame, common, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per document: number of shingles, digest of the set and the first shingles in the global order.

    ``parts`` says over how many lists a common shingle is dealt out (0: it is not common),
    ``rare`` how many shingles of the set are not common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = common.value
        lists = np.append(-(-seen // LIST_SIZE), 0).astype(np.int32)
        for batch in slices(batches, SLICE):
            counts, rares, digests, first, parts = [], [], [], [], []
            for values in shingle_sets(batch.column(1).to_pylist(), size):
                n = len(values)
                place = _places(values, known)
                rare = place < 0
                head = n - least_overlap(n, percent) + 1 if n else 0
                counts.append(n)
                rares.append(int(np.count_nonzero(rare)))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()) if n else None)
                first.append(np.concatenate([values[rare], values[~rare]])[:head].astype(np.int64))
                parts.append(lists[np.concatenate([place[rare], place[~rare]])[:head]])
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(rares, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(first, pa.list_(pa.int64())),
                pa.array(parts, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "rare", "digest", "first", "parts"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n long, rare long, digest binary, first array<long>, parts array<int>")


def with_nodes(classes: DataFrame) -> DataFrame:
    """Give each class a number: its smallest key, or a hash where that is null or taken by another text."""
    number = F.row_number().over(Window.partitionBy("smallest").orderBy("digest"))
    own = F.col("smallest").isNotNull() & (number == 1)
    return classes.withColumn("node", F.when(own, F.col("smallest")).otherwise(F.xxhash64("digest")))


def shared_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Rows of the first shingles' lists that hold more than one class.

    A common shingle's list is dealt out over several lists by node, so that no
    list is long.
    """
    rows = classes.select("node", "n", "rare", F.posexplode(F.arrays_zip("first", "parts")).alias("pos", "x"))
    rows = rows.select(
        F.col("x.first").alias("shingle"),
        F.when(F.col("x.parts") > 0, F.pmod(F.xxhash64("node"), F.col("x.parts"))).otherwise(F.lit(-1)).cast("int").alias("part"),
        "node",
        # One number for three, as all first shingles are shuffled here: size, place, share of own shingles.
        (F.shiftleft("n", 36) + F.shiftleft(F.col("pos").cast("long"), 10) + F.floor(F.col("rare") * 1000 / F.col("n"))).alias("facts"),
    )
    counted = rows.withColumn("count", F.count("*").over(Window.partitionBy("shingle", "part")))
    lists = counted.where("count > 1 OR part >= 0").withColumn("n", F.shiftright("facts", 36).cast("int"))
    return lists.select(
        "shingle",
        "node",
        "n",
        F.col("facts").bitwiseAND(F.lit((1 << 10) - 1)).cast("int").alias("own"),
        F.shiftright("facts", 10).bitwiseAND(F.lit((1 << 26) - 1)).cast("int").alias("pos"),
        F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int").alias("bucket"),
        (F.col("part") >= 0).alias("common"),
    )


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each class with the hub that it meets most often: ``a`` (the class), ``b`` (the hub), ``n_a``, ``n_b``.

    The hub of a list, among classes of like size, is the one with the smallest
    share of shingles of its own: of many near copies, that is the one they all
    come from. Pairs that meet too rarely to link are left out. These
    comparisons save work; ``open_pairs`` is what makes the join complete.
    """
    tops = lists.groupBy("shingle", "bucket").agg(F.min(F.struct("own", "node", "n")).alias("top"))
    around = tops.select("shingle", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"), "top")
    hubs = around.groupBy("shingle", "bucket").agg(F.min("top").alias("hub"))
    met = lists.select("shingle", "bucket", "node", "n").join(hubs, ["shingle", "bucket"]).where("node <> hub.node")
    counts = met.groupBy("node", "n", "hub").count()
    best = counts.groupBy("node", "n").agg(F.max_by("hub", F.struct("count", -F.col("hub.own"), -F.col("hub.node"))).alias("hub"), F.max("count").alias("count"))
    pairs = best.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"), "count")
    return pairs.where(meet_often(F.col("count") * 2, F.col("n_a"), F.col("n_b"), percent)).drop("count")


def meet_often(count: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two classes have as many first shingles in common as a link needs.

    Take the one whose first shingles end earlier in the global order: what the
    two share beyond those of both lies in its rest. So ``count`` must be at
    least the whole overlap less the larger rest.
    """
    overlap = F.ceil((n_a + n_b) * percent / F.lit(100 + percent))
    rest = F.ceil(F.greatest(n_a, n_b) * percent / F.lit(100)) - 1
    return sizes_agree(n_a, n_b, percent) & (count >= overlap - rest)


def sizes_agree(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (a > 0)


def hub_bounds(lists: DataFrame, overlaps: DataFrame, percent: int) -> DataFrame:
    """What is known of each class from its comparison with its hub: ``hub``, ``inside`` and ``loose``.

    ``inside`` is the overlap with the hub. A class whose first shingles reach the
    common ones has all others among them: what it shares of those with another
    such class is listed for both. Where class and hub are of this kind, ``loose``
    bounds how many shingles outside the hub the class may share with any third of
    this kind: all but its shingles that are neither common nor listed. Otherwise
    it is null, and nothing but ``inside`` is known. A hub lies inside itself.
    """
    listed = lists.groupBy("node").agg(
        F.first("n").alias("n"),
        # Common first shingles are always listed: the place of the first one is the number of all others.
        (F.min(F.when(F.col("common"), F.col("pos"))) - F.count_if(~F.col("common"))).alias("unlisted"),
    )
    seen = overlaps.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("overlap").alias("inside"))
    hubs = overlaps.select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
    reaching = listed.where("unlisted IS NOT NULL").select(F.col("node").alias("hub"), F.lit(True).alias("reaches"))
    bounds = seen.join(listed, "node").join(reaching, "hub", "left").select(
        "node", "hub", "inside", F.when(F.col("reaches"), F.col("n") - F.col("inside") - F.col("unlisted")).alias("loose")
    )
    own = hubs.join(listed, "node").select(
        "node", F.col("node").alias("hub"), F.col("n").cast("long").alias("inside"), F.when(F.col("unlisted").isNotNull(), F.lit(0)).cast("long").alias("loose")
    )
    return bounds.unionByName(own)


def open_pairs(lists: DataFrame, labels: DataFrame, bounds: DataFrame, percent: int, kept: list[str]) -> DataFrame:
    """Pairs of classes that share a first shingle but no component yet, as far as they may link.

    In each list all but the largest component are compared with every other
    class. Two classes with the same hub share no more than the smaller of their
    parts inside it and of what either may share outside; that alone settles
    most pairs of a large group. A pair is made at the first shingle it has in
    common: where both come from the same shingle before, it has been made there.
    """
    by_node = Window.partitionBy("node")
    known = lists.join(labels, "node", "left").join(bounds, "node", "left")
    # A class cannot meet another one more often than it is listed.
    known = known.withColumn("before", F.lag("shingle").over(by_node.orderBy("pos"))).withColumn("held", F.count("*").over(by_node))
    known = stored(known.select("shingle", "node", "n", "pos", F.coalesce("component", "node").alias("component"), "before", "held", "hub", "inside", "loose"), kept)
    mixed = known.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    rows = stored(known.join(mixed, "shingle", "left_semi"), kept)
    distinct = met_pairs(rows, percent)
    # Overlap of the first fragment alone, before whole sets are fetched.
    first = rows.groupBy("node").agg(F.collect_set("shingle").alias("shared"))
    one = first.select(F.col("node").alias("a"), F.col("shared").alias("s_a"))
    two = first.select(F.col("node").alias("b"), F.col("shared").alias("s_b"))
    counted = distinct.join(one, "a").join(two, "b").withColumn("count", F.size(F.array_intersect("s_a", "s_b")))
    return counted.where(meet_often(F.col("count"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def met_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one list that may still link, once each, the smaller node first: see ``open_pairs``.

    All that concerns one row alone is worked out before the join, and the bounds
    on an overlap are compared at once in whole numbers: the join's loop stays
    short, as the JVM's compiler takes hundreds of MB for a long one.
    """
    counts = rows.groupBy("shingle", "component").count()
    largest = counts.groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("m")).select("shingle", F.col("m.component").alias("largest"))
    marked = rows.join(largest, "shingle").select(
        "shingle", "node", "n", "pos", "component", "before", "held", "hub", "inside", "loose",
        (F.col("component") != F.col("largest")).alias("minor"),
        (F.ceil(F.col("n") * percent / F.lit(100)) - 1).alias("rest"),
        (F.col("n") - F.col("pos")).alias("ahead"),
        (F.col("n") - F.col("inside")).alias("outside"),
    )
    columns = ("node", "n", "pos", "component", "before", "held", "hub", "inside", "loose", "rest", "ahead", "outside")
    left = marked.where("minor").select("shingle", *[F.col(c).alias(f"{c}1") for c in columns])

    def least(name: str) -> Column:
        return F.least(f"{name}1", name)

    outside = F.when(F.col("loose1").isNotNull() & F.col("loose").isNotNull(), least("loose")).otherwise(least("outside"))
    most = F.least(
        # As in meet_often: so many meetings at most, and the larger rest.
        least("held") + F.greatest("rest1", "rest"),
        # What the two can still share from this shingle on, and before it.
        least("ahead") + least("pos"),
        # Null, and so without effect, unless both have the same hub.
        F.when(F.col("hub1") == F.col("hub"), least("inside") + outside),
    )
    pairs = left.join(marked, "shingle").where(
        (F.col("component1") != F.col("component"))
        & (~F.col("minor") | (F.col("node1") < F.col("node")))
        & ~F.coalesce(F.col("before1") == F.col("before"), F.lit(False))
        & sizes_agree(F.col("n1"), F.col("n"), percent)
        & (most * (100 + percent) >= (F.col("n1") + F.col("n")) * percent)
    )
    in_order = F.col("node1") < F.col("node")
    return pairs.select(
        least("node").alias("a"),
        F.when(in_order, F.col("n1")).otherwise(F.col("n")).alias("n_a"),
        F.greatest("node1", "node").alias("b"),
        F.when(in_order, F.col("n")).otherwise(F.col("n1")).alias("n_b"),
    ).distinct()


def key_place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits (8 MB) in which the bit of every key is set."""
    bits = keys.select(key_place(F.col("key")).alias("place")).select((F.col("place") / 32768).cast("long").alias("block"), (F.col("place") % 32768).alias("bit"))
    blocks = bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for block, value in blocks:
        out[block] = np.frombuffer(value, np.uint8)
    return out.reshape(-1)


def segments(docs: DataFrame, names: DataFrame, nodes: DataFrame, common, key: str, text: str, size: int, kept: list[str]) -> DataFrame:
    """One row per class in ``nodes`` and fragment: the shingles of the class that lie in the fragment.

    Texts are read again rather than kept; a bitmap of the keys in question
    spares the work for the others, whatever passes it by chance falls to the join.
    """
    chosen = stored(names.join(nodes.distinct(), "node", "left_semi"), kept)
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(chosen.select(F.col("smallest").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = common.value
        width = np.uint64((1 << 64) // (FRAGMENTS - 1) + 1)
        for batch in slices(batches, SLICE):
            place = batch.column(0).to_numpy()
            rows = np.flatnonzero(bitmap.value[place >> 3] >> (place & 7) & 1)
            digests, fragments, parts = [], [], []
            for values in shingle_sets(batch.column(1).take(pa.array(rows)).to_pylist(), size):
                digest = xxhash.xxh3_128_digest(values.tobytes())
                fragment = np.where(_places(values, known) < 0, (values // width).astype(np.int32), FRAGMENTS - 1)
                for f in np.unique(fragment):
                    digests.append(digest)
                    fragments.append(int(f))
                    parts.append(values[fragment == f].astype(np.int64))
            data = [pa.array(digests, pa.binary()), pa.array(fragments, pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(data, ["digest", "fragment", "shingles"])

    texts = docs.select(key_place(F.col(key).cast("long")).alias("place"), F.col(text).alias("text"))
    found = texts.mapInArrow(run, "digest binary, fragment int, shingles array<long>")
    named = found.join(chosen.select("digest", "node"), "digest")
    # Rows may repeat; a class has each segment once.
    return stored(named.select("node", "fragment", "shingles").dropDuplicates(["node", "fragment"]), kept)


def pair_overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs with their ``overlap``, counted per fragment and summed per pair."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("s_a"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("s_b"))
    overlaps = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = overlaps.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("overlap"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))


def linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of every row.

    Two rows link when their sets share at least ``percent`` of their union. A
    null or empty text, or one without words, has no set and is linked with
    nothing: its component is its own key. Rows that share a key are separate
    rows of the graph; a null key is never the smallest, unless there is no other.
    """
    found, named = _labelled(docs, key, text, size, percent)
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    result = named.join(least, "component").select("digest", "component_id")
    return found.join(result, "digest", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )


def _labelled(docs: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and of each class its ``digest``, smallest key and component."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, size))
    found = stored(document_sets(docs, common, key, text, size, percent))
    sets = found.where("n > 0")
    names = stored(with_nodes(sets.groupBy("digest").agg(F.min("key").alias("smallest"), F.max("n").alias("n"))))
    first = sets.groupBy("digest").agg(F.first("rare").alias("rare"), F.first("first").alias("first"), F.first("parts").alias("parts"))
    kept: list[str] = []
    lists = stored(shared_lists(first.join(names, "digest"), percent), kept)
    by_hub = _compared(docs, names, stored(hub_pairs(lists, percent)), common, key, text, size)
    links = linked(by_hub, percent)
    labels = stored(components(links))
    others = stored(open_pairs(lists, labels, hub_bounds(lists, by_hub, percent), percent, kept))
    remove(docs.sparkSession, kept)
    more = linked(_compared(docs, names, others, common, key, text, size), percent)
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    named = names.join(labels, "node", "left").select("digest", "smallest", F.coalesce("component", "node").alias("component"))
    return found, stored(named)


def _compared(docs, names, pairs, common, key, text, size) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    kept: list[str] = []
    overlaps = stored(pair_overlaps(pairs, segments(docs, names, nodes, common, key, text, size, kept)))
    remove(docs.sparkSession, kept)
    return overlaps


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates, in their own columns.

    Of each group of linked rows one stays: that with the smallest key, and where
    several texts have this key, that with the smallest digest. Rows without words
    are linked with nothing and stay all.
    """
    found, named = _labelled(docs, key, text, WORDS, PERCENT)
    # A null key comes last.
    best = F.min(F.struct(F.col("smallest").isNull().alias("none"), "smallest", "digest"))
    first = stored(named.groupBy("component").agg(best.alias("b")).select(F.col("b.smallest").alias("__key"), F.col("b.digest").alias("__digest")))
    repeated = stored(found.where("n > 0").groupBy("key").count().where("count > 1").select(F.col("key").alias("__key")))
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = docs.where(has_words)
    same_key = F.col(key).eqNullSafe(F.col("__key"))
    single = worded.join(repeated, same_key, "left_anti").join(first.select("__key").distinct(), same_key, "left_semi")
    # Where a key has several rows, the row is told by its set.
    rows = worded.join(repeated, same_key, "left_semi").select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.drop("text").withColumn("digest", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            digests = [xxhash.xxh3_128_digest(values.tobytes()) for values in shingle_sets(batch.column(2).to_pylist(), WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], schema.fieldNames())

    told = rows.mapInArrow(run, schema).join(first, F.col("key").eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest")), "left_semi")
    several = told.dropDuplicates(["key", "digest"]).select("row.*")
    return single.unionByName(several).unionByName(docs.where(~has_words)).select(*docs.columns)
