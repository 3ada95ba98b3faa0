"""URL filters: domain rules, and a list of URLs behind a blocked Bloom filter and an exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import packed
from tallyglass.scale import staged

# Bits that one URL sets inside its 64-bit block, and how many URLs share a block on average.
BITS, PER_BLOCK = 6, 4
# The filter has at least and at most this many blocks of eight bytes, whatever the length of the list.
LEAST_BLOCKS, MOST_BLOCKS = 1 << 6, 1 << 20
# Query parameters that do not change what a URL shows.
TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid)"


def _lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """``host/path?query`` without scheme, ``www.``, fragment, tracking parameters, default page and last slash."""
    host = F.regexp_replace(url_host(url), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(url_path(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (both null without one).

    A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the rule's path.
    """
    name = verdict = None
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _mask(hashed: Column) -> Column:
    """Six bits of a 64-bit block, each chosen by six bits of the hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.shiftrightunsigned(hashed, 6 * i) % 64).cast("int"))
            for i in range(BITS)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def bloom_blocks(listed: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """One row with ``masks``, the filter's ``blocks`` 64-bit blocks in order; its size depends on ``blocks`` alone."""
    key = F.col(key_col)
    own = listed.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(F.xxhash64(key))).alias("mask"))
    filled = own.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(own, "block", "left")
    in_order = F.sort_array(F.collect_list(F.struct("block", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))))
    return filled.agg(F.transform(in_order, lambda b: b["mask"]).alias("masks"))


def blocks_for(listed: int) -> int:
    """Blocks of a filter of ``listed`` URLs: a power of two between the bounds."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(0, math.ceil(listed / PER_BLOCK) - 1).bit_length()))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
                listed_col: str = "url", blocks: int | None = None) -> DataFrame:
    """All pages with ``host, path, rule, verdict`` (replacing columns of those names).

    A page whose URL fits a rule gets the verdict of the longest one.  Every other URL is blocked when its canonical
    form is that of a listed URL: the blocked Bloom filter lets most others pass at once, and an exact join on the
    canonical URL decides the rest, so the result never depends on the filter.  The different listed URLs are written once
    and counted; the filter has a block for every ``PER_BLOCK`` of them (``blocks``, where given, instead), between bounds: a
    list of over four million URLs only sends more pages to the join.  Null URLs, and those without
    ``://``, have empty host and path and are allowed; listed ones of that kind are ignored.  Repeated pages and
    repeated list entries change nothing; empty tables are fine.
    """
    url = F.col(url_col)
    keys = staged(listed.where(F.col(listed_col).contains("://")).select(
        canonical_url(F.col(listed_col)).alias("__key")).distinct(), "listed-urls")
    blocks = blocks or blocks_for(keys.count())
    masks = bloom_blocks(keys, "__key", blocks).scalar()
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    judged = packed(pages, host=url_host(url), path=url_path(url),
                    key=F.when(url.contains("://"), canonical_url(url)))
    judged = judged.withColumns({"__rule": rule, "__verdict": verdict})
    mask = _mask(F.xxhash64("__key"))
    maybe = F.coalesce(
        F.col("__verdict").isNull() & (F.get(masks, _block(F.col("__key"), blocks)).bitwiseAND(mask) == mask),
        F.lit(False))
    passed = judged.where(~maybe).withColumn("__listed", F.lit(False))
    hits = judged.where(maybe).join(keys.withColumn("__listed", F.lit(True)), "__key", "left")
    whole = passed.unionByName(hits)
    by_list = F.when(F.coalesce("__listed", F.lit(False)), "block").otherwise("allow")
    new = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"),
           "verdict": F.coalesce("__verdict", by_list)}
    own = [F.col("__row")[c].alias(c) for c in pages.columns if c not in new]
    return whole.select(*own, *[c.alias(name) for name, c in new.items()])
