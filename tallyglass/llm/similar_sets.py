"""Components of similar sets: buckets propose pairs, signatures sift them, whole sets decide, union-find groups them.

A bucket is never multiplied with itself in Spark, and no list of its pairs is ever made.  First every member meets one
leader of its bucket.  Buckets whose members are then not all in one component go on: inside a task, members outside the
bucket's largest component are compared with the others by their signatures' bytes.  Members that found a promising partner
meet once more, now with their whole sets, and the task folds the links among them by union-find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.components import stars
from tallyglass.scale import staged

# Members of a bucket, and hashes of their sets, that meet as many askers in one task at a time.
PART, PART_HASHES = 2048, 4_000_000
# What places a row in its bucket, and all that goes with it.
GROUP = ["key", "part", "block"]
CELL = "key bigint, part int, block int, asks boolean, n bigint, size bigint, root bigint, codes binary, keys array<bigint>"


def _alike(size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """Sets whose sizes alone rule out the similarity need no look."""
    return np.minimum(size_a, size_b) >= np.maximum(size_a, size_b) * least - 1e-6


def promising(pairs: DataFrame, nodes: DataFrame, least: float, cut: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow the similarity and whose signatures agree in at least ``cut`` slots."""
    sketch = nodes.select("n", "size", "codes")
    both = pairs.join(sketch.withColumnsRenamed({"n": "b", "size": "sb", "codes": "cb"}), "b")
    both = both.join(sketch.withColumnsRenamed({"n": "a", "size": "sa", "codes": "ca"}), "a")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (batch.column(i).to_numpy() for i in (2, 3))
            ca, cb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            near = pa.array(_alike(sa, sb, least) & ((ca == cb).sum(axis=1) >= cut))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], ["a", "b"])

    return both.select("a", "b", "sa", "sb", "ca", "cb").mapInArrow(sift, "a bigint, b bigint")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join the pairs' nodes as all pairs do whose whole sets reach the Jaccard of ``percent``.

    A task folds its links by union-find: a pair already joined there needs no look, and one link per node leaves.
    """
    both = pairs.join(sets.withColumnsRenamed({"n": "b", "hashes": "hb"}), "b")
    both = both.join(sets.withColumnsRenamed({"n": "a", "hashes": "ha"}), "a").select("a", "b", "ha", "hb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = np.unique(np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
            parent = list(range(len(nodes)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            left, right = places[: batch.num_rows].tolist(), places[batch.num_rows:].tolist()
            last, first = None, None
            for i in range(batch.num_rows):
                low, high = sorted((root(left[i]), root(right[i])))
                if low == high:
                    continue
                if left[i] != last:
                    last, first = left[i], np.frombuffer(batch.column(2)[i].as_py(), np.uint64)
                other = np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                both_hold = shared(first, other)
                if 100 * both_hold >= percent * (len(first) + len(other) - both_hold):
                    parent[high] = low
            roots = np.array([root(x) for x in range(len(nodes))], np.int64)
            moved = np.flatnonzero(roots != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``keys`` columns of sorted batches, one table each."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if carry is None else pa.concat_tables([carry, table])).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for i in range(keys):
            values = table.column(i).to_numpy()
            new |= values[1:] != values[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        for a, b in zip(starts[:-1], starts[1:]):
            yield table.slice(a, b - a)
        carry = table.slice(starts[-1])
    if carry is not None and carry.num_rows:
        yield carry


def _dealt(waiting: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of unsettled buckets (``key, n, root``) as rows ``CELL``, several per member of a large bucket.

    Members outside the bucket's largest component ask.  A large bucket is dealt into parts and its askers into blocks;
    every part meets every block.
    """
    rows = waiting.join(nodes, "n")
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("h"))
    buckets = counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.max(F.struct("c", "h", "root")).alias("top"))

    def shares(members, hashes):
        return F.greatest(F.ceil(members / PART), F.ceil(hashes / PART_HASHES)).cast("int")

    top = F.col("top")
    sizes = buckets.select("key", top["root"].alias("top"), shares(F.col("c"), F.col("h")).alias("parts"),
                           shares(F.col("c") - top["c"], F.col("h") - top["h"]).alias("blocks"))
    rows = rows.join(sizes, "key")
    mark = F.xxhash64("n")
    part, block = F.pmod(mark, "parts").cast("int"), F.pmod(F.shiftright(mark, 20), "blocks").cast("int")
    columns = ["key", "part", "block", "asks", "n", "size", "root", "codes", "keys"]
    members = rows.select("*", F.lit(False).alias("asks"), part.alias("part"),
                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    askers = rows.where("root <> top").select("*", F.lit(True).alias("asks"), block.alias("block"),
                                              F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.select(columns).union(askers.select(columns))


def _partners(group: pa.Table, least: float, cut: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per asker of a group (places in it) its promising partners in other components, the most alike first.

    A pair counts in the first of its shared buckets alone.
    """
    asks, n, size, root = (group.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
    code = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(len(n), -1)
    keys = group.column(8).combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    key, other = group.column(0)[0].as_py(), ~asks
    for i in np.flatnonzero(asks):
        fit = np.flatnonzero(other & (root != root[i]) & _alike(size, size[i], least))
        agree = (code[fit] == code[i]).sum(axis=1)
        fit, agree = fit[agree >= cut], agree[agree >= cut]
        here = keys[i][(keys[fit] == keys[i]).argmax(axis=1)] == key
        fit, agree = fit[here], agree[here]
        if len(fit):
            yield int(i), fit[np.lexsort((n[fit], -agree))]


def _sorted_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _involved(dealt: DataFrame, least: float, cut: int) -> DataFrame:
    """The rows of ``dealt`` that have a promising partner in their group."""
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(GROUP)):
            found = np.zeros(group.num_rows, bool)
            for i, partners in _partners(group, least, cut):
                found[i] = True
                found[partners] = True
            if found.any():
                yield from group.filter(pa.array(found)).combine_chunks().to_batches()

    return _sorted_groups(dealt).mapInArrow(sift, CELL)


def _settled(involved: DataFrame, sets: DataFrame, least: float, percent: int, cut: int) -> DataFrame:
    """Links ``a, b`` that join components as all promising pairs do whose whole sets reach the Jaccard of ``percent``."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(GROUP)):
            n, hashes = group.column(4).to_numpy(), group.column(9)
            joined: dict[int, int] = {}
            roots = group.column(6).to_pylist()

            def find(x: int) -> int:
                while (up := joined.get(x, x)) != x:
                    joined[x] = joined.get(up, up)
                    x = up
                return x

            a, b = [], []
            for i, partners in _partners(group, least, cut):
                mine = np.frombuffer(hashes[i].as_py(), np.uint64)
                for j in partners.tolist():
                    low, high = sorted((find(roots[i]), find(roots[j])))
                    if low == high:
                        continue
                    other = np.frombuffer(hashes[j].as_py(), np.uint64)
                    both = shared(mine, other)
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        joined[high] = low
                        a.append(max(n[i], n[j]))
                        b.append(min(n[i], n[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    whole = _sorted_groups(involved.join(sets, "n").select(*involved.columns, "hashes"))
    return whole.mapInArrow(check, "a bigint, b bigint")


def similar_roots(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, cut: int) -> DataFrame:
    """From a written table ``n, size, keys, codes`` to ``a, b``: ``b`` is the smallest ``n`` of the component of ``a``;
    components of one node are left out.

    ``keys`` names the buckets of a node, ``codes`` its signature, ``fetch`` gives ``n, hashes`` (the sorted set) for the
    nodes ``n`` that share a bucket.  No pair of a bucket whose signatures agree in ``cut`` slots is left out: its sets are
    compared, or it is in one component already.
    """
    least = percent / 100
    cells = nodes.select("n", F.explode("keys").alias("key"))
    leaders = cells.groupBy("key").agg(F.min("n").alias("l"), F.max("n").alias("last")).where("l < last").select("key", "l")
    buckets = staged(cells.join(leaders, "key"), "similar-buckets")
    sets = staged(fetch(buckets.select("n").distinct()), "similar-sets")
    first = buckets.where("n <> l").select(F.col("n").alias("a"), F.col("l").alias("b")).distinct()
    links = staged(verified(promising(first, nodes, least, cut), sets, percent), "similar-links")
    roots = stars(links)
    # Leaders have met all members of their buckets.
    waiting = buckets.where("n <> l").select("key", "n")
    found = waiting.join(roots.select(F.col("a").alias("n"), F.col("b").alias("root")), "n", "left")
    placed = staged(found.select("key", "n", F.coalesce("root", "n").alias("root")), "similar-placed")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    dealt = _dealt(staged(placed.join(several.select("key"), "key", "left_semi"), "similar-waiting"), nodes)
    involved = staged(_involved(dealt, least, cut), "similar-involved")
    links = staged(_settled(involved, sets, least, percent, cut), "similar-links")
    # Only new links between the components so far, not all links again.
    return roots if links.isEmpty() else stars(roots.union(links))
