"""Splitting text for tokenizers: patterns over letters, numbers and blanks, with a fast form for Latin text."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Fixed values of Unicode: White_Space, and the letters and numbers below U+0300.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BEYOND_LATIN = re.compile("[^\x00-\u02ff]")


def _classed(pattern: str, letters: str, numbers: str) -> str:
    """The pattern with its classes spelt out, since engines differ in what they call a blank."""
    for bare, inside in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", BLANKS)):
        pattern = pattern.replace(f"[{bare}]", f"[{inside}]")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{BLANKS}{letters}{numbers}]")
    for bare, inside in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", BLANKS), (r"\S", "^" + BLANKS)):
        pattern = re.sub(rf"{re.escape(bare)}(?![^\[]*\])", lambda _: f"[{inside}]", pattern)
    return pattern


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a tokenizer's pattern (``\\p{L}``, ``\\p{N}``, ``\\s``, ``\\S``) in a text, in order."""
    latin = re.compile(_classed(pattern, LATIN_LETTERS, LATIN_NUMBERS)).findall
    general = regex.compile(_classed(pattern, r"\p{L}", r"\p{N}")).findall
    beyond = BEYOND_LATIN.search
    return lambda text: general(text) if beyond(text) else latin(text)
