import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.functions import text as X
from tallyglass.operators import chunking as C


def split_long(piece, size, seps=("\n\n", "\n", ". ", " ")):
    """Plain-Python twin: cut after each separator in turn, only what is still too long."""
    if len(piece) <= size:
        return [piece]
    if not seps:
        return [piece[i:i + size] for i in range(0, len(piece), size)]
    *heads, tail = piece.split(seps[0])
    return [q for p in [*(h + seps[0] for h in heads), tail] for q in split_long(p, size, seps[1:])]


def packed(text, size, overlap):
    out, cur = [], ""
    for piece in split_long(text, size):
        if cur and len(cur) + len(piece) > size:
            out.append(cur)
            tail = cur[-overlap:] if overlap else ""
            cur = (tail.split(" ", 1)[1] if " " in tail else tail) + piece
        else:
            cur += piece
    return out + [cur] if cur.strip() else out


def cut_all(spark, texts, strategy, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select("i", C.cut(F.col("text"), strategy, size, overlap).alias("p")).collect()
    return {r.i: r.p for r in rows}


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "bb", "word", "longerword", ". ", " ", "\n", "\n\n", "x" * 40, "é", ".", "  ", "\n \n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("size,overlap", [(20, 5), (30, 0), (25, 12), (60, 30), (7, 3)])
def test_recursive_equals_the_plain_walk(spark, size, overlap):
    texts = random_texts(150, size)
    got = cut_all(spark, texts, "recursive", size, overlap)
    for i, t in enumerate(texts):
        assert got[i] == [p.strip() for p in packed(t, size, overlap) if p.strip()], repr(t)


def test_a_unit_of_several_megabytes(spark):
    """Many blocks of pieces; the time must not grow with the square of the unit (two megabytes took minutes)."""
    import time

    text = "".join(f"Sentence {i} of one very long unit. " + "\n" * (i % 40 == 0) for i in range(110_000))
    df = spark.range(110_000).selectExpr(
        "id", "concat('Sentence ', id, ' of one very long unit. ', CASE WHEN id % 40 = 0 THEN '\n' ELSE '' END) AS s")
    whole = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]), "").alias("text"))
    start = time.time()
    got = whole.select(C.cut(F.col("text"), "recursive", 800, 120).alias("p")).head().p
    assert time.time() - start < 60 and got == [p.strip() for p in packed(text, 800, 120)]


def test_by_paragraph(spark):
    import re

    texts = random_texts(120, 99)
    got = cut_all(spark, texts, "by_paragraph", 40, 10)
    for i, t in enumerate(texts):
        want = []
        for para in re.split(r"\n\s*\n", t):
            want += [para] if len(para) <= 40 else packed(para, 40, 10)
        assert got[i] == [p.strip() for p in want if p.strip()], repr(t)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abc é\n", min_size=1, max_size=80), st.integers(5, 30), st.integers(0, 15))
def test_fixed_pieces_reassemble_the_text(spark, text, size, overlap):
    overlap = C.clamp_overlap(size, overlap)
    row = spark.createDataFrame([(text,)], "t string").select(C.chunk_fixed(F.col("t"), size, overlap).alias("p")).head()
    step = size - overlap
    whole = "".join(p[:step] for p in row.p[:-1]) + row.p[-1]
    assert whole == text or whole == text[:len(whole)] and len(text) - len(whole) == 0


@pytest.mark.parametrize("strategy", C.STRATEGIES)
def test_sizes_and_numbers(spark, strategy):
    text = ("Sentence number one is here. " * 40 + "\n\n") * 5
    units = spark.createDataFrame([("f", 0, text), ("f", 1, "  \n "), ("f", 2, "short one")], "file_id string, unit_pos long, text string")
    rows = C.chunk_units(units, strategy, 300, 50).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(len(r.text) <= (600 if strategy == "by_page" else 300) for r in rows)
    assert rows[-1].text == "short one" and {r.unit_pos for r in rows} == {0, 2}


def test_neighbours_share_text(spark):
    text = " ".join(f"word{i}" for i in range(400))
    pieces = cut_all(spark, [text], "recursive", 200, 60)[0]
    assert len(pieces) > 1 and pieces[0].split()[-2] in pieces[1]


def test_overlap_is_clamped():
    assert C.clamp_overlap(300, 900) == 150


@pytest.mark.parametrize("raw,want", [
    (None, ""), ("", ""), ("/", ""), ("2026/Q2", "2026/Q2"), ("/2026//Q2/", "2026/Q2"), ("..\\..\\etc", "etc"), ("a/./b/../c", "a/b/c"),
])
def test_folders(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(X.normalize_folder(F.col("p"))).head()[0] == want


def test_html_sections(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body>before <p>lead &amp; more</p><h2>One</h2><p>first<p>second"
        "<table><tr><th>A</th><th>B</th></tr><tr><td> 1 </td><td>2</td></tr><tr><td></td><td></td></tr></table>"
        "<ul><li>x</li><li> </li><li>y<b>z</b></li></ul><script>bad()</script><h3>  </h3><h1>" + "T" * 130 + "</h1><div><h2>inner</h2>kept</div></body></html>")
    df = spark.createDataFrame([(1, page), (2, "<p></p>"), (3, None)], "page_id long, html string")
    got = [(r.page_id, r.section, r.text) for r in C.html_sections(df).orderBy("page_id", "unit_pos").collect()]
    assert got == [
        (1, None, "lead & more"), (1, "One", "first\n\nsecond\n\nA | B\n\n1 | 2\n\n- x\n\n- yz"), (1, "inner", "kept")]


def test_html_sections_look_through_containers(spark):
    page = (
        "<!DOCTYPE html><html><body><header><nav><ul><li><a href='/x'>X</a></li><li>Y</ul></nav></header><!-- <h1>no</h1> -->"
        "<main><section class=a><h1>A <i>b</i></h1>loose <b>bold</b> text<p>one<div><div><h3>Deep</h3><p>two<br>three</div>"
        "after</div></section><article><table><tr><td><h2>cell</h2><td>2</table><blockquote><p>q</p></blockquote></article></main>"
        "<em>element</em> bare <span>s</span><footer>&copy; end</footer></body></html>")
    cut = "<div><h2>Cut</h2><p>kept &amp"
    df = spark.createDataFrame([(1, page), (2, cut), (3, "<p>x</p><p"), (4, "no tags at all"), (5, "")], "page_id long, html string")
    got = [tuple(r) for r in C.html_sections(df).orderBy("page_id", "unit_pos").collect()]
    assert got == [
        (1, 0, None, "- X\n\n- Y"), (1, 1, "A b", "loose bold text\n\none"),
        (1, 2, "Deep", "twothree\n\nafter\n\ncell | 2\n\nq\n\nelement\n\ns\n\n© end"), (2, 1, "Cut", "kept &"), (3, 0, None, "x")]


def test_html_sections_of_a_very_long_page(spark):
    page = "<div>" * 200 + "".join(f"<h2>t{i}</h2><p>text {i}</p>" for i in range(20_000))
    rows = C.html_sections(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert len(rows) == 20_000 and {(r.unit_pos, r.section, r.text) for r in rows} == {(i + 1, f"t{i}", f"text {i}") for i in range(20_000)}


def test_check_params(spark):
    saved = spark.createDataFrame([("fixed", 300, 50)], "chunk_strategy string, chunk_size int, chunk_overlap int")
    same = {"chunk_strategy": "fixed", "chunk_size": 300, "chunk_overlap": 50}
    assert C.check_params(saved, same).count() == 0
    assert C.check_params(saved, {**same, "chunk_size": 400}).count() == 1


def test_clean_and_redact(spark):
    df = spark.createDataFrame([("a\x00b \t c\n\n\n\nd  ",)], "t string")
    assert df.select(X.clean_text(F.col("t"))).head()[0] == "ab c\n\nd"
    keyed = spark.createDataFrame([("use sk-abcdefgh12 or MYKEY or gskshort",)], "t string")
    assert keyed.select(X.redact_secrets(F.col("t"), "MYKEY")).head()[0] == "use [redacted] or [redacted] or gskshort"
