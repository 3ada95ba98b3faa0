"""Merkle manifest of a dataset: lag and lead columns give every node its siblings, level by level.

Leaves are numbered within their group (a source), every ``FANOUT`` consecutive nodes of a group hash to a parent until
one is left, and the groups' last nodes are hashed the same way to one root.  No level gathers a group: numbering goes
through range partitions and their counts, and a window never holds more than one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.scale import staged

FANOUT = 16
# The working columns of a node: its group, its place there, the nodes of the group at this level, its hash.
NODE = ["group", "pos", "count", "digest"]


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; digests count as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two rows read alike: its length in UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``group``) as a written table with ``pos`` (from 0 by ``order``) and ``count`` in the group.

    Rows are cut into range partitions by group, order and a number of their own, so a large group, and even one row
    repeated very often, spread over many.  The sorted parts number their rows themselves; the parts' counts, one row per
    part and group, shift the places.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    own = rows.withColumn("__own", F.monotonically_increasing_id())
    cut = own.repartitionByRange(parts, "group", *order, "__own").sortWithinPartitions("group", *order, "__own")
    # Part number and place in the part in one number.
    cut = staged(cut.drop("__own").withColumn("__at", F.monotonically_increasing_id()), "merkle-parts")
    cut = cut.withColumn("__part", F.shiftright("__at", 33))
    counts = cut.groupBy("group", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    shifts = shifts.join(counts.groupBy("group").agg(F.sum("__n").alias("count")), "group")
    placed = cut.join(shifts, ["group", "__part"])
    pos = (F.col("__before") + F.col("__at") - F.col("__first")).alias("pos")
    return staged(placed.select(*rows.columns, pos, "count"), "merkle-nodes")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``run`` and the texts ``left`` and ``right`` of their run's other digests, in order.

    ``lag`` and ``lead`` reach over fixed offsets; slot and run length tell which of them lie inside the run.
    """
    run, slot = F.floor(F.col("pos") / fanout), F.pmod("pos", F.lit(fanout))
    length = F.least(F.lit(fanout), F.col("count") - F.col("run") * fanout)
    placed = nodes.withColumn("run", run.cast("bigint"))
    order = Window.partitionBy("group", "run").orderBy("pos")
    left = [F.when(slot >= k, F.lag("digest", k).over(order)) for k in range(fanout - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("digest", k).over(order)) for k in range(1, fanout)]
    return placed.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level: the first child of each run hashes itself and what follows it; groups of one node are finished."""
    above = with_siblings(nodes.where("count > 1"), fanout).where(F.pmod("pos", F.lit(fanout)) == 0)
    return above.select("group", F.col("run").alias("pos"), F.floor((F.col("count") + (fanout - 1)) / fanout).cast("bigint").alias("count"),
                        hashed(F.col("digest"), F.col("right")).alias("digest"))


def levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The written tables of all levels, leaves first; each is ``fanout`` times smaller than the one before."""
    found = [leaves.select(*NODE)]
    most = leaves.agg(F.max("count")).first()[0] or 0
    while most > 1:
        found.append(staged(parents(found[-1], fanout), "merkle-level"))
        most = -(-most // fanout)
    return found


def tops(tree: list[DataFrame]) -> DataFrame:
    """``group, digest``: the last node of each group."""
    last = tree[0].where("count = 1")
    for level in tree[1:]:
        last = last.union(level.where("count = 1"))
    return last.select("group", "digest")


def with_path(nodes: DataFrame, above: DataFrame | None, over: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``path``, the siblings (``left``, ``right``) at their own level and all above, and ``subroot``.

    ``above`` holds the same of the next level, ``over`` that of the groups' last nodes.  The window over runs and the join
    with the parents share one partitioning, and a group's row in ``over`` meets its last node alone.
    """
    alone = nodes.where("count = 1").join(over, "group").select(*nodes.columns, "path", "subroot")
    if above is None:
        return alone
    several = with_siblings(nodes.where("count > 1"), fanout)
    up = above.select("group", F.col("pos").alias("run"), F.col("path").alias("__path"), "subroot")
    own = F.array(F.struct("left", "right"))
    joined = several.join(up, ["group", "run"]).withColumn("path", F.concat(own, "__path"))
    return joined.select(*nodes.columns, "path", "subroot").union(alone)


def paths(tree: list[DataFrame], leaves: DataFrame, over: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` (the lowest level with the caller's own columns) with ``path`` and ``subroot``."""
    above = None
    for level in reversed(tree[1:]):
        above = staged(with_path(level, above, over, fanout).select("group", "pos", "path", "subroot"), "merkle-paths")
    return with_path(leaves, above, over, fanout)


def folded(start: Column, path: Column) -> Column:
    """The hash at the end of ``path``, recomputed from ``start``."""
    return F.aggregate(path, start, lambda digest, step: hashed(step["left"], digest, step["right"]))


def siblings_text(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, leaf: Column, group_col: str = "source", id_col: str = "doc_id", again: Column | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: ``id, group, leaf, subroot, root, path, again, folded_root, verified``.

    ``leaf`` is the digest of a row; leaves of a group stand in order of id (nulls first), then of digest, so rows that
    repeat an id have a defined place and rows alike in all fields are interchangeable.  A null group is a group of its own
    and comes first; groups are ordered by their UTF-8 bytes.  ``path`` holds the siblings up to the root.  ``again`` is a
    digest of the row read once more (null: unchanged); ``folded_root`` is recomputed from it and ``path``, and ``verified``
    tells whether that is the root.  Texts are only read to be hashed, never shuffled, however long.  One row: its leaf is
    the root.  An empty table gives an empty result.
    """
    # A group name that is never null: nulls first, then the names in order.
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    leaves = docs.select(name.alias("group"), F.col(id_col).alias("id"), leaf.alias("digest"),
                         (F.lit(None).cast("string") if again is None else again).alias("again"))
    leaves = numbered(leaves, ["id", "digest"])
    tree = levels(leaves, fanout)
    subroots = tops(tree).select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    roots = numbered(subroots, ["name"])
    upper = levels(roots, fanout)
    nothing = roots.sparkSession.range(1).select(
        F.lit("").alias("group"), F.array().cast("array<struct<left:string,right:string>>").alias("path"),
        F.lit(None).cast("string").alias("subroot"))
    over = paths(upper, roots, nothing, fanout).select(
        F.col("name").alias("group"), "path", F.col("digest").alias("subroot"))
    over = staged(over, "merkle-over")
    root = tops(upper).select("digest").scalar()
    found = paths(tree, leaves, over, fanout).select(
        "id", F.when(F.col("group") != "-", F.substring("group", 2, 1 << 30)).alias("group"), F.col("digest").alias("leaf"),
        "subroot", root.alias("root"), "path", "again",
        folded(F.coalesce("again", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
