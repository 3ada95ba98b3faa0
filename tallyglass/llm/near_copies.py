"""Near copies by similarity: minwise fingerprints cut into words, a binary trie over each word joined to itself, the exact Jaccard
of word runs decides.

A bit of a fingerprint is a bit of one slot of the SuperMinHash signature, so it differs with a chance of (1 - J) / 2.  Of two
texts that reach the similarity at least one word differs in few bits.  Values of a word that hang together in its trie are a
bucket; ``similar_sets`` compares the members of buckets, by pairs and not by the trie's links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import similar_sets, superminhash
from tallyglass.llm.common import ROW, packed, unpacked, whole_text
from tallyglass.llm.components import stars
from tallyglass.llm.minhash_dedup import MEMBERS, SLOTS, TOGETHER, cut_of, shingle_set
from tallyglass.llm.simhash_dedup import near_links
from tallyglass.scale import broadcast_if_small, staged

# Words of a fingerprint, bits of a word, and bits in which near words may differ.  At a Jaccard of 0.8 a word of 40 bits is
# within 3 with a chance of 0.42, so that twenty words miss a pair with about 0.577 ** 20 = 2e-5; two unlike texts meet in
# a word with 1e-8.
WORDS, WORD_BITS, NEAR_BITS = 20, 40, 3
# Values that a task walks against each other.
GROUP_SIZE = 32768
# The slot of each bit of each word: no slot twice in a word, and another bit of it in each round over all slots.
_A_ROUND = SLOTS // WORD_BITS
_ROUNDS = [np.random.default_rng(i).permutation(SLOTS)[: _A_ROUND * WORD_BITS].reshape(_A_ROUND, WORD_BITS)
           for i in range(-(-WORDS // _A_ROUND))]
_SLOT = np.concatenate(_ROUNDS)[:WORDS]
_BIT = (np.arange(WORDS) // _A_ROUND).astype(np.uint64)[:, None]
_HALF = (1 << np.arange(WORD_BITS // 2)).astype(np.uint64)


def band_keys(signature: np.ndarray) -> list[int]:
    """One signed value per word.  Half the bits stand at the top of each half, since the trie is walked from either; the word's
    number stands in the bits left over below, so that values of different words differ.
    """
    bits = (signature[_SLOT] >> _BIT) & np.uint64(1)
    high, low = bits[:, : WORD_BITS // 2] @ _HALF, bits[:, WORD_BITS // 2:] @ _HALF
    spare = np.uint64(32 - WORD_BITS // 2)
    return ((high << np.uint64(32) | low) << spare | np.arange(WORDS, dtype=np.uint64)).view(np.int64).tolist()


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """``n, size, digest, keys, codes`` of rows ``n, text``."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [shingle_set(t.as_py(), width) for t in part.column(1)]
                signs = superminhash.signatures(sets, SLOTS)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([band_keys(row) for row in signs], pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in superminhash.codes(signs)], pa.binary())], names)

    names = ["n", "size", "digest", "keys", "codes"]
    return rows.select("n", F.col("text").cast("binary")).mapInArrow(
        sketch, "n bigint, size bigint, digest binary, keys array<bigint>, codes binary")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["n", "hashes"])

    return texts.select("n", F.col("text").cast("binary")).mapInArrow(hashes, "n bigint, hashes binary")


def _buckets(sketches: DataFrame) -> DataFrame:
    """The rows of ``n, size, keys, codes`` that share a bucket with another, with the bucket of each word as ``keys``: the value
    that stands for all those it hangs together with.
    """
    values = sketches.select("n", F.posexplode("keys").alias("word", "print"))
    each = staged(values.groupBy("word", "print").agg(F.count(F.lit(1)).alias("held")), "near-words")
    links = near_links(each.select("word", "print"), sketches.count(), NEAR_BITS, GROUP_SIZE)
    roots = stars(links).select(F.col("a").alias("print"), F.col("b").alias("root"))
    rooted = each.join(roots, "print", "left").select("word", "print", "held", F.coalesce("root", "print").alias("root"))
    shared = rooted.groupBy("word", "root").agg(F.sum("held").alias("members")).where("members > 1").select("word", "root")
    shared = staged(rooted.join(shared, ["word", "root"], "left_semi").select("word", "print", "root"), "near-shared")
    found = values.join(broadcast_if_small(shared, MEMBERS), ["word", "print"])
    found = found.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("word", "root"))).alias("roots"))
    root = F.transform("keys", lambda key, word: F.coalesce(F.try_element_at("roots", word), key))
    return sketches.join(found, "n").select("n", "size", root.alias("keys"), "codes")


def similar_roots(rows: DataFrame, width: int, least: float) -> DataFrame:
    """From a written table ``n, text`` with distinct ``n`` to ``a, b``: ``b`` is the smallest ``n`` of the component of
    ``a``; components of one row are left out.

    Texts with equal sets share one node, texts without words too; ``similar_sets`` joins the nodes.  Texts are read again only
    for nodes that share a bucket.
    """
    percent = round(least * 100)
    sketches = staged(_sketches(rows, width), "near-sketches")
    classes = staged(sketches.groupBy("digest").agg(F.min("n").alias("n")), "near-classes")
    own = sketches.where("size > 0").join(classes.select("n"), "n", "left_semi")
    nodes = staged(_buckets(staged(own.select("n", "size", "keys", "codes"), "near-signatures")), "near-nodes")

    def fetch(members: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(staged(members, "near-members"), MEMBERS)
        return _sets(rows.join(wanted, "n", "left_semi"), width)

    roots = similar_sets.similar_roots(nodes, fetch, percent, cut_of(percent))
    found = classes.join(roots.select(F.col("a").alias("n"), "b"), "n", "left").select("digest", F.coalesce("b", "n").alias("b"))
    every = sketches.select(F.col("n").alias("a"), "digest").join(found, "digest")
    return every.where("a <> b").select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                     least: float = 0.8) -> DataFrame:
    """One row of ``docs`` per component, with all its columns as they are: the one with the smallest id.

    Texts are linked when the sets of their runs of ``width`` words have a Jaccard of at least ``least``; texts without
    words are alike.  A null id stays only where no other id is in the component.  Rows are told apart by a number of
    their own, so of rows that repeat an id, or have none, one stays.
    """
    # The text is written once, as the caller's column: all else reads it there.
    rows = staged(packed(docs, id=F.col(id_col), n=F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col("__n").alias("n"), whole_text(f"{ROW}.{text_col}").alias("text"))
    roots = similar_roots(texts, width, least)
    roots = staged(roots.withColumnsRenamed({"a": "__n", "b": "__root"}), "near-roots")
    placed = rows.select("__id", "__n").join(roots, "__n").select("__id", "__n", "__root").union(
        rows.join(roots.select(F.col("__root").alias("__n")).distinct(), "__n", "left_semi").select("__id", "__n", F.col("__n")))
    # Nulls come last; ties go to the smallest number.
    first = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__n")))
    stay = placed.groupBy("__root").agg(first.alias("first")).select(F.col("first")["__n"].alias("__n"))
    gone = staged(placed.select("__n").join(stay, "__n", "left_anti"), "near-gone")
    return unpacked(rows.join(broadcast_if_small(gone, MEMBERS), "__n", "left_anti"), docs)
