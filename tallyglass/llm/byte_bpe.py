"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by joining pieces."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import let, whole_text
from tallyglass.llm.pretoken import splitter

# The rank map is an array of small maps by hash, since a map of Spark is searched from its first entry on.
SLOTS = 1 << 16
# A piece is written as the character FIRST + rank; NONE lies above all of them and below the surrogates.
FIRST, NONE = 0x100, "\ud7ff"
# Characters of text that make up a block, and words after which a task starts its numbering over.
BLOCK_CHARS, RENUMBER = 1 << 20, 1 << 20
# Words of more bytes than this are merged by a heap, as the fold would cost the square of their length.
FOLDED_BYTES = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def merge_entries(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """What each piece, and each pair of pieces, becomes; pieces are written as one character each.

    The character of a piece is ``FIRST`` plus its rank, so characters compare as ranks do.  Keys are whole pieces
    spelt in bytes, and every pair of pieces whose joined bytes are a piece.
    """
    def char(piece: bytes) -> str:
        return chr(FIRST + ranks[piece])

    byte = [char(bytes([b])) for b in range(256)]
    found = {}
    for piece in ranks:
        own = char(piece)
        found["".join(byte[b] for b in piece)] = own
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ranks and right in ranks:
                found[char(left) + char(right)] = own
    return list(found.items())


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranked merges as one value, ``array<map<string, string>>`` by ``_slot``; its size is the vocabulary's."""
    entries = spark.createDataFrame(merge_entries(ranks), "key string, piece string")
    slots = entries.groupBy(_slot(F.col("key")).alias("slot")).agg(F.collect_list(F.struct("key", "piece")).alias("own"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    own = F.coalesce("own", F.array().cast("array<struct<key:string,piece:string>>"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", own.alias("own")))),
                                 lambda s: F.map_from_entries(s["own"])).alias("ranks")).scalar()


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def _merge(ranks: Column, key: Column) -> Column:
    """The piece that ``key`` becomes, or ``NONE``."""
    return F.coalesce(F.try_element_at(F.get(ranks, _slot(key)), key), F.lit(NONE))


def byte_alphabet(ranks: dict[bytes, int]) -> tuple[str, str]:
    """Characters U+0000 to U+00FF and the pieces of those bytes."""
    return "".join(map(chr, range(256))), "".join(chr(FIRST + ranks[bytes([b])]) for b in range(256))


def encoded_word(word: Column, ranks: Column, alphabet: tuple[str, str]) -> Column:
    """The pieces of one word (binary), one character each.

    A word in the vocabulary is its own piece.  Otherwise its bytes are folded.  The state is two strings: the pieces,
    and for each pair of neighbours the piece they would become (``NONE`` if nothing).  The least character of the
    second, the leftmost of equals, takes the place of its pair; only the pairs beside it are looked up again.  The fold
    takes one step per byte and copies the strings, so a word costs the square of its length; ``merged_word`` takes long ones.
    """
    spelt = F.translate(F.decode(word, "ISO-8859-1"), *alphabet)

    def fold(bytes_: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(bytes_) - 1)
        pairs = F.array_join(F.transform(steps, lambda i: _merge(ranks, F.substring(bytes_, i, F.lit(2)))), "")
        start = let(pairs, lambda m: F.struct(bytes_.alias("p"), m.alias("m"), _least(m).alias("new")))
        return F.aggregate(steps, start, step, lambda s: s["p"])

    def step(state: Column, _: Column) -> Column:
        return F.when(state["new"] == NONE, state).otherwise(
            let(F.call_function("locate", state["new"], state["m"]), lambda i: _merged(state, i, ranks)))

    return let(spelt, lambda b: let(_merge(ranks, b), lambda own: F.when(own != NONE, own).when(F.length(b) < 2, b).otherwise(fold(b))))


def _least(merges: Column) -> Column:
    """The least character; ``NONE`` for an empty string."""
    return F.when(merges == "", NONE).otherwise(F.array_min(F.split(merges, "")))


def _merged(state: Column, i: Column, ranks: Column) -> Column:
    """The state after the pieces ``i`` and ``i + 1`` (from 1) became one."""
    p, m, new, rest, one = state["p"], state["m"], state["new"], F.lit(1 << 30), F.lit(1)
    pieces = F.concat(F.substring(p, one, i - 1), new, F.substring(p, i + 2, rest))
    before = F.when(i > 1, F.concat(F.substring(m, one, i - 2), _merge(ranks, F.concat(F.substring(p, i - 1, one), new)))).otherwise("")
    after = F.when(i < F.length(m), F.concat(_merge(ranks, F.concat(new, F.substring(p, i + 2, one))), F.substring(m, i + 2, rest))).otherwise("")
    return let(F.concat(before, after), lambda merges: F.struct(pieces.alias("p"), merges.alias("m"), _least(merges).alias("new")))


def merged_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the same merges from a heap of pairs over linked pieces, n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(word[left:ends[right]])
            if rank is not None:
                heapq.heappush(pairs, (rank, left, ends[right]))

    for left in range(n - 1):
        offer(left)
    while pairs:
        _, left, end = heapq.heappop(pairs)
        # Stale unless both pieces still stand as they did: the left one begins here, the right one ends there.
        right = after[left]
        if ends[left] == 0 or right >= n or ends[right] != end:
            continue
        ends[left], ends[right], after[left] = end, 0, after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[word[left:end]] for left, end in enumerate(ends) if end]


class _Numbers(dict):
    """Words to their numbers; a word met for the first time takes the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents in blocks: ``keys``, ``sizes`` (words per document), ``refs`` (numbers of their words) and ``words``,
    those that the task meets for the first time, numbered from ``first`` on; at 0 it has started over.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, keys, sizes, refs, chars = splitter(pattern), _Numbers(), [], [], array("I"), 0

        def flush() -> pa.RecordBatch:
            row = pa.RecordBatch.from_arrays([
                pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([np.asarray(refs, "<u4").tobytes()], pa.binary()),
                pa.array([list(map(str.encode, known.new))], pa.list_(pa.binary())), pa.array([len(known) - len(known.new)], pa.int64()),
            ], names=["keys", "sizes", "refs", "words", "first"])
            for filled in (keys, sizes, known.new):
                filled.clear()
            del refs[:]
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = find(text)
                keys.append(key)
                sizes.append(len(words))
                refs.extend(map(known.__getitem__, words))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield flush()
                    chars = 0
                    if len(known) > RENUMBER:
                        known.clear()
        if keys:
            yield flush()

    return docs.mapInArrow(split, "keys array<bigint>, sizes array<int>, refs binary, words array<binary>, first bigint")


def _joined(starts: np.ndarray, sizes: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in one flat array, of the values of all entries ``refs``, and how many each has."""
    each = sizes[refs]
    ends = np.cumsum(each)
    return np.repeat(starts[refs] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0), each


def _unblocked(encoded: DataFrame, path: str, decoded: bool) -> DataFrame:
    """``doc_id, ids`` (and ``decoded``) from blocks whose ``pieces`` are those of their new words, in the task's own order.

    Words left without pieces are those of ``long``, in the same order.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt, ranks = _decoder(path) if decoded else None, None
        flat, starts, sizes, used, n = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, refs, pieces, first, long = (batch.column(c)[i] for c in range(6))
                if first.as_py() == 0:
                    used = n = 0
                words = pieces.values.to_pylist()
                if len(long.values):
                    ranks = ranks or read_ranks(path)
                    merged = ("".join(chr(FIRST + r) for r in merged_word(w, ranks)) for w in long.values.to_pylist())
                    words = [w or next(merged) for w in words]
                own = np.fromiter(map(len, words), np.int64, len(words))
                ids = np.frombuffer("".join(words).encode("utf-32-le"), "<u4") - np.uint32(FIRST)
                flat, starts, sizes = _room(flat, used + len(ids)), _room(starts, n + len(own)), _room(sizes, n + len(own))
                flat[used:used + len(ids)] = ids
                starts[n:n + len(own)] = used + np.cumsum(own) - own
                sizes[n:n + len(own)] = own
                used, n = used + len(ids), n + len(own)
                places, each = _joined(starts, sizes, np.frombuffer(refs.as_py(), "<u4").astype(np.int64))
                total = np.concatenate(([0], np.cumsum(each)))
                cuts = total[np.concatenate(([0], np.cumsum(counts.values.to_numpy())))]
                coded = flat[places].astype("<u4")
                columns = [keys.values, _cut(coded.tobytes(), cuts * 4)]
                if spelt:
                    data, lengths = spelt(coded)
                    columns.append(_cut(data, np.concatenate(([0], np.cumsum(lengths)))[cuts]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]
    return encoded.mapInArrow(expand, "doc_id bigint, ids binary" + ", decoded binary" * decoded)


def _cut(data: bytes, cuts: np.ndarray) -> pa.Array:
    places = cuts.tolist()
    return pa.array([data[a:b] for a, b in zip(places, places[1:])], pa.binary())


def _room(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate((values, np.empty(max(size, 2 * len(values)) - len(values), values.dtype)))


def _long(word: Column) -> Column:
    return F.octet_length(word) > FOLDED_BYTES


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           splits_per_task: int = 3, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (with ``decoded``, also the ids decoded at once, as ``decode`` does): every whole text's token ids (binary, unsigned 32-bit little-endian), without special tokens.

    A task gathers its documents in blocks of about a million characters; Spark's higher-order functions encode the
    distinct words that the task has not met before (those of over ``FOLDED_BYTES`` bytes are merged by a heap instead, to
    the same ids); then each document's ids are put together from its words' ids.
    Nothing is shuffled, written or broadcast but the rank map, so a lost task is simply run again, and memory is
    bounded by a block and ``RENUMBER`` words.  Tasks that read more share more words: ``splits_per_task`` splits go to
    one task where there are more splits than cores.  A null text counts as empty and has no ids; repeated rows
    repeat in the result; null ids stay; an empty table gives an empty result.
    """
    spark, vocabulary = docs.sparkSession, read_ranks(path)
    ranks, alphabet = rank_map(spark, vocabulary), byte_alphabet(vocabulary)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    splits = texts.rdd.getNumPartitions()
    texts = texts.coalesce(max(1, min(splits, max(spark.sparkContext.defaultParallelism, -(-splits // splits_per_task)))))
    blocks = _blocks(texts, pattern).withColumn("ranks", ranks)
    pieces = F.transform("words", lambda w: F.when(_long(w), "").otherwise(encoded_word(w, F.col("ranks"), alphabet)))
    long = F.filter("words", _long)
    return _unblocked(blocks.select("keys", "sizes", "refs", pieces.alias("pieces"), "first", long.alias("long")), path, decoded)


def _decoder(path: str) -> Callable[[np.ndarray], tuple[bytes, np.ndarray]]:
    """Ids to the joined pieces and the length of each piece."""
    pieces = [p for p, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
    sizes = np.array([len(p) for p in pieces], np.int64)
    flat, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes

    def spelt(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        places, each = _joined(starts, sizes, ids.astype(np.int64))
        return flat[places].tobytes(), each

    return spelt


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``: the pieces of all ids, joined (binary).  Null ids give null; other columns stay."""
    columns = [c for c in coded.columns if c != "decoded"]
    at = columns.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = _decoder(path)
        for batch in batches:
            texts = [None if ids is None else spelt(np.frombuffer(ids, "<u4"))[0] for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*columns, "decoded"])

    rows = coded.select(*columns)
    return rows.mapInArrow(join, rows.select("*", F.lit(b"").alias("decoded")).schema)
