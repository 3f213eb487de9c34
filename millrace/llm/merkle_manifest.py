"""Merkle manifest of a data set: a digest per row, a tree per group, one root, and a proof for every row.

Rows are leaves, ordered by key within their group. While a level holds several
nodes, every three consecutive ones (the last run: fewer, even one) become the
digest of their concatenation. The groups' tops, ordered by group, are the leaves
of one more tree, whose top is the root. A group of one row has that leaf as its top.

Places within a group come from one range partitioning and the counts of its
parts, so a group of any size is spread over tasks. A shuffle builds ``STEP``
levels at once, in blocks of ``ARITY ** STEP`` nodes.

Proofs come from pointer jumping: a node starts with its siblings and a pointer
to its parent; joining the nodes with themselves on that pointer doubles the
distance and concatenates the segments, until every leaf reaches the root. Only
nodes that some pointer can still name are kept.

Defined results: a null group is a group of its own and comes first, null keys
come first in their group, rows that share a key are ordered by their digest and
are leaves of their own, a null field is marked as such and differs from an empty
one, an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.shared import remove, stored

ARITY = 3
# Levels that one shuffle builds; a task holds a block of ARITY ** STEP digests at a time.
STEP = 5
# Ancestors are broadcast while their segments take no more than this.
BROADCAST_BYTES = 8 << 20
SIBLING_BYTES = 96

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE = ("tree", "level", "idx")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: per field ``-`` if null, else the number of its UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts])


def in_order(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The rows, stored in global order of ``keys``, with an ``id`` that grows in this order and the ``part`` it lies in."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    return stored(placed.withColumn("part", F.shiftright("id", 33)), kept)


def numbered(leaves: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``tree`` (from 1, by group), ``idx`` in their group and its size ``n``; and the groups.

    ``leaves`` holds ``group``, ``key``, ``digest`` and more. Identical rows are
    told apart by a number, so that no range is without bound.
    """
    rows = stored(leaves.withColumn("twin", F.monotonically_increasing_id()), kept)
    placed = in_order(rows, ["group", "key", "digest", "twin"], kept)
    pieces = placed.groupBy("part", "group").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    groups = in_order(pieces.groupBy("group").agg(F.sum("held").alias("n")), ["group"], kept)
    # One row per part of the range partitioning.
    parts = groups.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    parts = parts.withColumn("before", F.sum("held").over(Window.orderBy("part")) - F.col("held"))
    groups = groups.join(parts, "part").select("group", "n", (F.col("id") - F.col("first") + F.col("before") + 1).alias("tree"))
    before = F.sum("held").over(Window.partitionBy("group").orderBy("part")) - F.col("held")
    pieces = pieces.withColumn("before", before).withColumnRenamed("group", "of")
    groups = stored(groups, kept)
    named = pieces.join(groups, F.col("of").eqNullSafe(F.col("group"))).select("part", "of", "first", "before", "n", "tree")
    same = (placed["part"] == named["part"]) & placed["group"].eqNullSafe(named["of"])
    out = placed.join(named, same).withColumn("idx", F.col("id") - F.col("first") + F.col("before"))
    return stored(out.drop("part", "of", "first", "before", "id", "twin"), kept), groups


def _above(nodes: Column) -> Column:
    """Digests one level up from an array of digests that starts a run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def _siblings(nodes: Column, level: Column, first: Column) -> Column:
    """The nodes of an array with the digests of their run's others, in bytes, left and right of them."""

    def node(_, j: Column) -> Column:
        at = j % ARITY
        left = F.array_join(F.slice(nodes, j - at + 1, at), "")
        right = F.array_join(F.slice(nodes, j + 2, ARITY - 1 - at), "")
        return F.struct(level.alias("level"), (first + j).alias("idx"), F.unhex(left).alias("l"), F.unhex(right).alias("r"))

    return F.transform(nodes, node)


def _block_levels(nodes: DataFrame, base: int) -> DataFrame:
    """From all nodes of level ``base`` the next ``STEP`` levels.

    Rows per block: ``nodes`` (place and siblings of each node below the tree's
    top), ``depth`` and ``top`` where the tree ends here, ``last`` for the level to go on from.
    """
    width = ARITY**STEP
    block = F.floor(F.col("idx") / width).alias("block")
    blocks = nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("a"))
    blocks = blocks.select("tree", "n", "block", F.col("a.digest").alias("a0"))
    counts = [F.ceil(F.col("n") / ARITY**k) for k in range(STEP + 1)]
    for k in range(STEP):
        blocks = blocks.withColumn(f"a{k + 1}", F.when(counts[k] > 1, _above(F.col(f"a{k}"))))
    found = [
        F.when(counts[k] > 1, _siblings(F.col(f"a{k}"), F.lit(base + k), F.col("block") * ARITY ** (STEP - k))) for k in range(STEP)
    ]
    top, depth = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k in range(STEP, -1, -1):
        ends = counts[k] == 1
        top, depth = F.when(ends, F.col(f"a{k}")[0]).otherwise(top), F.when(ends, F.lit(base + k)).otherwise(depth)
    return blocks.select(
        "tree",
        "block",
        counts[STEP].alias("n"),
        F.flatten(F.array_compact(F.array(*found))).alias("nodes"),
        F.when(top.isNull(), F.col(f"a{STEP}")[0]).alias("last"),
        top.alias("top"),
        depth.alias("depth"),
    )


def forest(leaves: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes below the tops (``tree``, ``level``, ``idx``, ``l``, ``r``) and the tops (``tree``, ``depth``, ``top``).

    ``leaves``: ``tree``, its number of leaves ``n``, ``idx`` and ``digest``.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    level, base = leaves, 0
    nodes = tops = None
    while True:
        built = stored(_block_levels(level, base), kept)
        below = built.select("tree", F.explode("nodes").alias("x")).select("tree", "x.*")
        ended = built.where("top IS NOT NULL").select("tree", "depth", "top")
        nodes, tops = (below, ended) if nodes is None else (nodes.unionAll(below), tops.unionAll(ended))
        base += STEP
        if ARITY**base >= largest:
            return nodes, tops
        level = built.where("last IS NOT NULL").select("tree", "n", F.col("block").alias("idx"), F.col("last").alias("digest"))


def _small(rows: DataFrame, siblings: int) -> bool:
    return rows.count() * siblings * SIBLING_BYTES <= BROADCAST_BYTES


def reach_root(nodes: DataFrame, depth: int, kept: list[str]) -> DataFrame:
    """Leaves of all trees with the ``path`` to the root, by pointer jumping.

    ``nodes``: place, ``up`` (place of the parent, null below the root) and
    ``path``, its own siblings. ``depth``: most steps from a leaf to the root.
    """
    distance = 1
    while distance < depth:
        # Pointers span ``distance`` levels now, so these are all that a kept node can name.
        kept_levels = (F.col("tree") == 0) | (F.col("level") % distance == 0)
        nodes = stored(nodes.where(kept_levels), kept)
        above = nodes.where((F.col("tree") == 0) | (F.col("level") > 0)).select(
            *[F.col(c).alias(f"up_{c}") for c in PLACE], F.col("up").alias("next"), F.col("path").alias("more")
        )
        if _small(above, distance):
            above = F.broadcast(above)
        same = [F.col("up")[c] == F.col(f"up_{c}") for c in PLACE]
        jumped = nodes.join(above, same[0] & same[1] & same[2], "left")
        path = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
        nodes = jumped.select(*PLACE, F.col("next").alias("up"), path.alias("path"))
        distance *= 2
    return nodes.where((F.col("tree") > 0) & (F.col("level") == 0)).select("tree", "idx", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(F.lower(F.hex(s["l"])), at, F.lower(F.hex(s["r"]))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["l"], s["r"])))), ""), 256)


def prove(leaves: DataFrame) -> DataFrame:
    """Per leaf its ``subroot``, the ``root`` and the ``path`` of siblings (bytes left and right of it, level by level).

    ``leaves`` holds ``group``, ``key``, ``digest`` (hex) and whatever should be carried along.
    """
    spark = leaves.sparkSession
    kept: list[str] = []
    rows, groups = numbered(leaves, kept)
    below, tops = forest(rows.select("tree", "n", "idx", "digest"), kept)
    tops = stored(tops, kept)
    count = groups.count()
    if not count:
        empty = rows.select(*leaves.columns, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        return empty.withColumn("path", F.expr("array(named_struct('l', X'', 'r', X''))"))
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(count).alias("n"), (F.col("tree") - 1).alias("idx"), F.col("top").alias("digest"))
    joints, roots = forest(upper, kept)
    root = roots.first()
    # A group of one row takes a step without siblings of its own.
    deepest = max(tops.agg(F.max("depth")).first()[0], 1) + root["depth"]

    def pointer(tree: Column, level: Column, idx: Column) -> Column:
        return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))

    here = (F.col("tree"), F.col("level") + 1, F.floor(F.col("idx") / ARITY))
    subroot = pointer(F.lit(0), F.lit(0), F.col("tree") - 1) if root["depth"] else F.lit(None)
    own = F.array(F.struct("l", "r")).alias("path")
    small = _small(tops, 1)
    depths = tops.select("tree", "depth")
    inner = below.join(F.broadcast(depths) if small else depths, "tree")
    inner = inner.select(*PLACE, F.when(F.col("level") + 1 < F.col("depth"), pointer(*here)).otherwise(subroot).alias("up"), own)
    outer = joints.select(*PLACE, F.when(F.col("level") + 1 < root["depth"], pointer(*here)).alias("up"), own)
    lone = tops.where("depth = 0").select(
        "tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), subroot.alias("up"),
        F.slice(F.array(F.struct(F.lit(b"").alias("l"), F.lit(b"").alias("r"))), 1, 0).alias("path"),
    )
    steps: list[str] = []
    paths = reach_root(inner.unionAll(outer).unionAll(lone), deepest, steps)
    found = rows.join(paths, ["tree", "idx"])
    named = tops.select("tree", F.col("top").alias("subroot"))
    found = found.join(F.broadcast(named) if small else named, "tree")
    result = stored(found.select(*leaves.columns, "subroot", F.lit(root["top"]).alias("root"), "path"))
    remove(spark, kept + steps)
    return result


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", **more: Column) -> DataFrame:
    """Leaf digest, subroot, root and path of every row of ``docs``, with ``key`` and the columns in ``more``."""
    leaves = docs.select(
        F.col(group).alias("group"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(n) for n, c in more.items()]
    )
    return prove(leaves)


def without_line_breaks(docs: DataFrame) -> Column:
    """Leaf digest of rows whose text lost its line feeds, for those whose crc32 of the key is even; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(chosen, leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with each row's proof checked, tampered rows against the untampered proof."""
    proofs = manifest(docs, tampered=without_line_breaks(docs))
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    out = proofs.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
