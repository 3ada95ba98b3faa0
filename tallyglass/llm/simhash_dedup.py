"""SimHash near-duplicates: fingerprints within a few bits of each other, found by a binary trie joined to itself."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import packed, unpacked, whole_text
from tallyglass.llm.components import stars
from tallyglass.llm.fingerprints import with_fingerprint
from tallyglass.llm.trie import join_tries
from tallyglass.scale import staged

BITS, HALF, STEP = 64, 32, 4
PAIR = ["turn", "depth", "pa", "pb", "err"]


def _deeper(members: DataFrame, depth: int, budget: int) -> DataFrame:
    """Send every value from its node pair to the child pairs, ``STEP`` bits further down, that the budget allows."""
    own = F.shiftrightunsigned("v", BITS - depth - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
    prefix = F.shiftrightunsigned("v", BITS - depth) if depth else F.lit(0)
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)),
                      lambda c: F.bit_count(c.bitwiseXOR(F.col("own"))) + F.col("err") <= budget)
    spread = members.withColumns({"own": own.cast("int"), "first": prefix == F.col("pa")})
    spread = spread.withColumn("c", F.explode(others))
    inside = F.col("pa") == F.col("pb")
    mine, other = F.col("own"), F.col("c")
    ca = F.when(inside, F.least(mine, other)).when(F.col("first"), mine).otherwise(other)
    cb = F.when(inside, F.greatest(mine, other)).when(F.col("first"), other).otherwise(mine)
    return spread.select(
        "turn", F.lit(depth + STEP).alias("depth"), (F.col("pa") * (1 << STEP) + ca).alias("pa"),
        (F.col("pb") * (1 << STEP) + cb).alias("pb"),
        (F.col("err") + F.bit_count(mine.bitwiseXOR(other))).cast("int").alias("err"), "v")


def near_links(prints: DataFrame, count: int, most: int = 3, group_size: int = 8192) -> DataFrame:
    """Links ``a, b`` that join distinct values ``print`` (long) into the components of all pairs within ``most`` bits.

    The binary trie over the values is walked against itself.  Two tries are used, over the bits and over the bits
    with their halves swapped, since one half of a near pair differs in at most ``most // 2`` bits: that smaller
    budget holds for the first 32 levels, so few node pairs survive.  The upper levels are walked by Spark: each value
    goes down with all node pairs it can still belong to, and node pairs with more than ``group_size`` values are
    walked further until all are small, so a crowded prefix never fills a task.  Below that, a task walks each
    pair with numpy and returns links that join its near values, at most one per value, never all pairs of a group.

    Where ``prints`` has a column ``word``, only values of one word meet.  Values of different words must differ.
    """
    early = most // 2
    budget = {d: early if d <= HALF else most for d in range(STEP, BITS + STEP, STEP)}
    swapped = F.shiftleft("print", HALF).bitwiseOR(F.shiftrightunsigned("print", HALF))
    first = (F.col("word") * 2).cast("int") if "word" in prints.columns else F.lit(0)
    turns = F.explode(F.array(F.struct(first.alias("turn"), F.col("print").alias("v")),
                              F.struct((first + 1).alias("turn"), swapped.alias("v")))).alias("t")
    zero = F.lit(0).cast("bigint")
    members = prints.select(turns).select(
        "t.turn", F.lit(0).alias("depth"), zero.alias("pa"), zero.alias("pb"), F.lit(0).alias("err"), "t.v")
    depth = 0
    for _ in range(max(0, math.ceil(math.log(max(1, count) / group_size, 1 << STEP)))):
        members, depth = _deeper(members, depth, budget[depth + STEP]), depth + STEP
    small = None
    while True:
        crowded = members.groupBy(*PAIR).count().where(F.col("count") > group_size).drop("count")
        if depth >= BITS or (crowded := staged(crowded, "crowded-nodes")).isEmpty():
            break
        light = members.join(crowded, PAIR, "left_anti")
        small = light if small is None else small.union(light)
        deeper = _deeper(members.join(crowded, PAIR, "left_semi").select(members.columns), depth, budget[depth + STEP])
        members, depth = staged(deeper, "deeper-nodes"), depth + STEP
    small = members if small is None else small.union(members)

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        turn, level, pa, pb, err = (int(k) for k in key)
        values = np.sort(group["v"].to_numpy().view(np.uint64))
        sides = [values, None]
        if pa != pb:
            first = (values >> np.uint64(BITS - level)) == np.uint64(pa & ((1 << BITS) - 1))
            sides = [values[first], values[~first]]
            if not len(sides[0]) or not len(sides[1]):
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        labels = join_tries(*sides, level, err, most, early, HALF)
        values = np.concatenate([s for s in sides if s is not None])
        if turn % 2:
            values = (values << np.uint64(HALF)) | (values >> np.uint64(HALF))
        linked = labels != np.arange(len(labels))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[linked], "b": signed[labels[linked]]})

    return small.groupBy(*PAIR).applyInPandas(walk, "a bigint, b bigint")


def document_prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A written table ``id, print`` with one row per document."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return staged(with_fingerprint(rows.select("id", F.col("text")), F.col("text"), width, "print").drop("text"), "prints")


def print_components(prints: DataFrame, most: int, group_size: int) -> DataFrame:
    """``print, component``: for each fingerprint the smallest id of its component."""
    each = staged(prints.groupBy("print").agg(F.min("id").alias("low")), "distinct-prints")
    links = stars(near_links(each.select("print"), each.count(), most, group_size))
    rooted = each.join(links.select(F.col("a").alias("print"), F.col("b").alias("root")), "print", "left")
    rooted = rooted.select("print", "low", F.coalesce("root", "print").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return rooted.join(lows, "root").select("print", "component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3,
                       group_size: int = 8192) -> DataFrame:
    """One row per document: ``doc_id, print, component_id``.

    ``print`` is the 64-bit SimHash (a signed long) of the text's runs of ``width`` words; ``component_id`` the smallest
    id reachable over links of at most ``most`` differing bits.  Null and blank texts have no words and fingerprint
    zero, which links like any other; texts of fewer words count as one run.  Null ids keep their rows and are never
    the smallest; a component of null ids alone has a null component.  Repeated rows repeat in the result.
    """
    prints = document_prints(docs, id_col, text_col, width)
    found = print_components(prints, most, group_size)
    return prints.join(found, "print").select(F.col("id").alias("doc_id"), "print", F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3,
                     group_size: int = 8192) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns as they are.

    Rows that repeat an id share its decision; rows with a null id stay only where no other id is in the component.
    """
    found = simhash_components(docs, id_col, text_col, width, most, group_size)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    rows = packed(docs, id=F.col(id_col))
    return unpacked(rows.join(stay, F.col("__id").eqNullSafe(F.col("__stay")), "left_semi"), docs)
