"""Text, number and label expressions.  Everything but ``decode_entities`` stays inside the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as blank in the page and in the service, as text and as regex ranges.
JS_BLANK_CHARS = (
    "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
PY_BLANK_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000"
    "\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
JS_BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PY_BLANK = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# The reply that means "no answer", file types and size limits.
NOT_FOUND = "I couldn't find this in your documents."
SUPPORTED_SUFFIXES = (".pdf", ".docx", ".xlsx", ".xlsm")
FOLDER_LIMIT = 300
SECTION_LIMIT = 120


def strip_blank(c: Column, blank: str = PY_BLANK_CHARS) -> Column:
    """Trim every Unicode blank, not only spaces.  Looks at the ends only, unlike a pattern."""
    return F.trim(c, F.lit(blank))


def even_blanks(c: Column, blank: str = JS_BLANK_CHARS) -> Column:
    """Every blank becomes a space, so later patterns test one character instead of a list of ranges."""
    return F.translate(c, blank, " " * len(blank))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    """Drop NUL, squeeze spaces and tabs, keep at most one empty line in a row, trim."""
    c = F.translate(c, "\x00", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip_blank(c)


def column_letter(i: Column) -> Column:
    """0 -> ``Column A``, 26 -> ``Column AA``; up to three letters, as wide as a sheet can be."""
    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + n)

    i = i.cast("int")
    two, three = i - 26, i - 702
    one_letter = letter(i)
    two_letters = F.concat(letter(F.floor(two / 26)), letter(two % 26))
    three_letters = F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))
    return F.concat(
        F.lit("Column "),
        F.when(i < 26, one_letter).when(i < 702, two_letters).otherwise(three_letters),
    )


def cell_text(text: Column | None = None, number: Column | None = None, stamp: Column | None = None) -> Column:
    """One sheet cell as text: a number is a plain decimal without closing zeros, a midnight timestamp a date."""
    parts = []
    if number is not None:
        whole = (number == F.floor(number)) & (F.abs(number) < 9e18)
        plain = number.try_cast("decimal(38,18)").cast("string")
        plain = F.when(plain.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(plain, r"\.?0+$", ""))
        parts.append(F.when(whole, number.cast("bigint").cast("string")).otherwise(F.coalesce(plain, number.cast("string"))))
    if stamp is not None:
        midnight = stamp == F.date_trunc("day", stamp)
        parts.append(
            F.when(midnight, F.date_format(stamp, "yyyy-MM-dd"))
            .when(F.date_trunc("second", stamp) == stamp, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        )
    if text is not None:
        parts.append(F.replace(clean_text(text), F.lit("\n"), F.lit(" ")))
    return F.coalesce(*parts, F.lit(""))


def to_number(c: Column) -> Column:
    """A number written as text, currency signs, thousands commas and ``%`` dropped; else null."""
    bare = F.translate(c, ",₹$€£%" + JS_BLANK_CHARS, "")
    value = F.when(bare.rlike(r"(?i)^[-+]?[0-9]*\.?[0-9]+(e[-+]?[0-9]+)?$"), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def same_key(c: Column) -> Column:
    """The form under which two labels count as the same: trimmed, lower case, null as empty."""
    return F.lower(strip_blank(F.coalesce(c.cast("string"), F.lit("")), JS_BLANK_CHARS))


def same_text(a: Column, b: Column) -> Column:
    return same_key(a) == same_key(b)


def count_words(c: Column) -> Column:
    return F.regexp_count(even_blanks(c), F.lit("[^ ]+"))


def count_chars(c: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(even_blanks(c), " +", " ")))


def attr_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def redact_secrets(c: Column, secret: str | None = None) -> Column:
    """Hide a known secret and anything that looks like a service key."""
    if secret:
        c = F.replace(c, F.lit(secret), F.lit("[redacted]"))
    # Fixed value: the shape of a service key.
    return F.regexp_replace(c, r"\b(sk|AIza|gsk|xai)[-_A-Za-z0-9*]{8,}", "[redacted]")


def normalize_folder(c: Column) -> Column:
    """Forward slashes, no blank, ``.`` or ``..`` parts, at most 300 characters; null -> ``''``."""
    parts = F.transform(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: strip_blank(p))
    kept = F.filter(parts, lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.substring(F.array_join(kept, "/"), 1, FOLDER_LIMIT), F.lit(""))


def dirname(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "^/+", ""), r"(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def joined_path(folder: Column, name: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def strip_source(title: Column) -> tuple[Column, Column]:
    """``"A - B - Src"`` -> (``"A - B"``, ``"Src"``); without the dash the whole title and ``''``."""
    has_dash = title.contains(" - ")
    head = F.when(has_dash, F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 1)).otherwise(title)
    tail = F.when(has_dash, F.regexp_extract(title, r"(?s)^(.*) - (.*)$", 2)).otherwise(F.lit(""))
    return strip_blank(head, JS_BLANK_CHARS), strip_blank(tail, JS_BLANK_CHARS)


def strip_source_tagged(title: Column, tag: Column) -> tuple[Column, Column]:
    """As ``strip_source``, but a feed item with its own source tag keeps its title whole."""
    head, tail = strip_source(title)
    tagged = F.coalesce(tag, F.lit("")) != ""
    return (
        F.when(tagged, strip_blank(title, JS_BLANK_CHARS)).otherwise(head),
        F.when(tagged, strip_blank(tag, JS_BLANK_CHARS)).otherwise(tail),
    )


def host_of_link(link: Column) -> Column:
    """Host name without a leading ``www.``; an unreadable link gives ``''``."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(link, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def source_fallback(author: Column, parsed: Column, link: Column) -> Column:
    return F.coalesce(blank_to_null(author), blank_to_null(parsed), host_of_link(link))


@F.pandas_udf(T.StringType())
def decode_entities(titles: pd.Series) -> pd.Series:
    """HTML entities have no built-in decoder; one Arrow batch at a time."""
    return titles.map(html.unescape, na_action="ignore")


def tone(value: Column) -> Column:
    return F.when(value >= 0.05, "positive").when(value <= -0.05, "negative").otherwise("neutral")


def sentiment_label(value: Column) -> Column:
    return (
        F.when(value >= 0.5, "Strongly Positive")
        .when(value >= 0.05, "Positive")
        .when(value <= -0.5, "Strongly Negative")
        .when(value <= -0.05, "Negative")
        .otherwise("Neutral")
    )


def is_supported(name: Column) -> Column:
    return F.lower(name).rlike("(" + "|".join(SUPPORTED_SUFFIXES).replace(".", r"\.") + ")$")


def is_hidden(name: Column) -> Column:
    return name.startswith(".") | name.startswith("~$")


def refusal_reason(name: Column, size: Column, max_mb: int) -> Column:
    """Why a file is refused, or null when it is accepted.  Hidden files are for the caller to drop."""
    return F.when(~is_supported(name), "unsupported file type").when(
        size > max_mb * 1024 * 1024, f"larger than {max_mb} MB"
    )


def source_label(folder: Column, name: Column, sheet: Column, row_start: Column, row_end: Column,
                 page: Column, section: Column) -> Column:
    """Citation text: a sheet with rows, else a page, else a section, else the bare path."""
    path = joined_path(folder, name)
    first, last = row_start.cast("string"), row_end.cast("string")
    rows = F.when(row_start.eqNullSafe(row_end), F.concat(F.lit("row "), first)).otherwise(
        F.concat(F.lit("rows "), first, F.lit("-"), last)
    )
    return (
        F.when(sheet.isNotNull(), F.concat(path, F.lit(', sheet "'), sheet, F.lit('", '), rows))
        .when(F.coalesce(page, F.lit(0)) != 0, F.concat(path, F.lit(", page "), page.cast("string")))
        .when(F.coalesce(section, F.lit("")) != "", F.concat(path, F.lit(', section "'), section, F.lit('"')))
        .otherwise(path)
    )


def is_not_found(reply: Column) -> Column:
    """The whole reply is the not-found sentence, whatever its quotes, case or closing dots."""
    plain = F.translate(strip_blank(reply, JS_BLANK_CHARS), "‘’", "''")
    return F.lower(F.regexp_replace(plain, f"[.{JS_BLANK}]+$", "")) == NOT_FOUND[:-1].lower()


def is_not_found_prefix(reply: Column) -> Column:
    """The looser service rule: the reply starts with the sentence."""
    return strip_blank(reply).startswith(NOT_FOUND[:-1])


def cited_numbers(text: Column, hits: Column) -> Column:
    """Distinct valid ``[n]`` markers, ascending."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= hits))))


def natural_key(c: Column) -> Column:
    """Key for names in which ``item 9`` comes before ``item 10``: lower case, digit runs padded to 20."""
    return _padded_numbers(F.lower(c))


def natural_order(c: Column, collation: str = "UNICODE") -> Column:
    """What to sort names by as a reader expects: numbers by value, letters by collation (accents beside their letters, small
    before capital where nothing else differs)."""
    return F.collate(_padded_numbers(c), collation)


def _padded_numbers(c: Column) -> Column:
    words = F.split(F.regexp_replace(c, r"([0-9]+)", "\x01$1\x01"), "\x01")
    padded = F.transform(words, lambda w: F.when(w.rlike(r"^[0-9]{1,20}$"), F.lpad(w, 20, "0")).otherwise(w))
    return F.array_join(padded, "")


def half_up(value: Column, places: int) -> Column:
    """Round half toward +infinity, so -0.00005 becomes 0 and not -0.0001."""
    scale = 10.0 ** places
    return F.floor(value * scale + 0.5) / scale


def hundreds(value: Column) -> Column:
    """Round to hundreds, ties to the even hundred."""
    return F.bround(value, -2)
