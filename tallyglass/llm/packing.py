"""Best-fit packing of document pieces into sequences of a fixed number of tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.packing_plan import plan_sequences
from tallyglass.llm.word_tokens import token_pieces
from tallyglass.scale import staged

BUCKET_ROWS = 200_000


def pack_pieces(pieces: DataFrame, capacity: int, groups: int = 24) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and any other columns) with ``sequence_id`` and ``offset``.

    The packing itself is made on the counts per length, of which there are at most ``capacity``: only they come to the
    driver, and a plan of runs of equal sequences goes back.  A piece then finds its place by its rank among the pieces
    of its length.  Ranks are counted in buckets of about ``BUCKET_ROWS`` pieces by hash, so a length that a third of
    all pieces share is numbered by many tasks.  Sequences are numbered from 0, places are gapless.  Rows that repeat a
    piece are packed each; lengths must be 1 .. ``capacity``; an empty table gives an empty result.
    """
    pieces = staged(pieces, "pieces")
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket")
    offsets = counts.withColumn("__before", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    lengths = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    plan = plan_sequences(lengths, capacity, groups)
    entries = np.array(sorted(plan.entries) or [(0,) * 6], np.int64)
    span = 1 << 40
    starts = entries[:, 0] * span + entries[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        entry = entries[np.searchsorted(starts, size * span + nth, side="right") - 1]
        inside = nth - entry[:, 1]
        return pd.DataFrame({"sequence_id": entry[:, 4] + inside // entry[:, 3],
                             "offset": entry[:, 5] + inside % entry[:, 3] * size})

    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("__rank", rank).join(offsets, ["length", "__bucket"])
    placed = ranked.withColumn("__at", place(F.col("length"), (F.col("__before") + F.col("__rank") - 1)))
    return placed.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ``ids`` and their place; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, path, end_id, capacity, id_col, text_col), capacity)
