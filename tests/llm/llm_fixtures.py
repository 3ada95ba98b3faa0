"""Rows that are easy to get wrong: nulls, empty and very long texts, repeats, columns with clashing names."""

LONG = "long words in a very long text of one document \n" * 4000

ROWS = [
    (1, "the same text here and some more words", "en", 7, "x"),
    (2, "the same text here and some more words", "en", 8, "y"),
    (2, "the same text here and some more words", "en", 8, "y"),
    (3, None, None, None, None),
    (4, "", "en", 1, "z"),
    (5, " \n\t ", "en", 1, "z"),
    (6, LONG, "en", 2, None),
    (7, "ünïcode Ωmega 漢字 😀 text\nwith two lines", "de", 3, "k"),
    (None, "a row without an id but with words of its own", "en", 4, "n"),
    (8, "one", "en", 5, "k"),
]


def documents(spark, rows=ROWS):
    """``doc_id, text`` and columns named like the operators' own results and working columns."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int, digest string")
