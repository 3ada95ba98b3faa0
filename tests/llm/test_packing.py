"""Pieces against the tokenizer library; sequences by their invariants and against the least possible number."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from llm_fixtures import documents
from tokenizers import Tokenizer

from tallyglass.llm import packing, word_tokens
from tallyglass.llm.packing_plan import plan_sequences
from tallyglass.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 40, 100, 511, 512, 513, 900, 1300, 2047, 2049, 3000, 4095, 4096]) if seed < 2
             else rng.randint(1, 4096) if seed < 4 else min(4096, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(3000)]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    plan = plan_sequences(dict(counts), 4096)
    places, seen = defaultdict(list), defaultdict(int)
    for length, rank, sequences, each, sequence, offset in plan.entries:
        assert rank == seen[length] and sequences > 0 and each > 0
        seen[length] += sequences * each
        for s in range(sequences):
            places[sequence + s].extend((offset + i * length, length) for i in range(each))
    assert seen == counts
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(places) == set(range(plan.sequences))
    least = -(-sum(sizes) // 4096)
    halves = sum(c for n, c in counts.items() if n > 2048)
    assert plan.sequences <= 1.06 * max(least, halves) + 2


def check_rows(rows, texts):
    tokenizer, places, pieces = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    return len(places), sum(r.length for r in rows)


def test_query(spark, tables):
    texts = {r.doc_id: r.text for r in tables.documents.select("doc_id", "text").collect()}
    sequences, tokens = check_rows(QUERIES["op3_best_fit_packing"](spark, SMALL).collect(), texts)
    assert sequences <= 1.02 * tokens / 4096 + 1


def test_odd_rows_and_texts(spark):
    odd = documents(spark)
    rows = packing.pack_documents(odd, PATH).collect()
    assert {(r.doc_id, r.piece) for r in rows} >= {(3, 0), (4, 0), (6, 1), (None, 0)}
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


def test_words_equal_the_library():
    encode, tokenizer = word_tokens.encoder(PATH), Tokenizer.from_file(PATH)
    letters = "abzAZßÄçñŉİǅªµ²¼½9_'`~\x1c\x85\xa0ˆ˘ \n\t-.s<|>"
    rng = random.Random(5)
    texts = ["<|endoftext|> x", "é x́", "Σας ΣΑΣ", "漢字 12 ½", "I'll don't 'S"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)
