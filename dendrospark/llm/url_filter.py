"""URL filters with DataFrame functions alone: rules by longest match, then a list of URLs.

A rule (host, path, verdict) fits its host and every subdomain, where the URL's path begins with
the rule's.  The longest fitting rule wins: longest host, then longest path.  A URL that no rule
fits is blocked if its canonical form is listed.  A blocked Bloom filter sorts most URLs out
first: the list sets four bits in one 256-bit block per URL, so a lookup reads one row.  Only
URLs that pass go on to an exact join with the list, which removes the false positives.

The filter's blocks follow the length of the list up to ``MOST_BLOCKS``, which bounds the broadcast;
beyond some 16 million listed URLs more pages pass on to the join, at the rate ``pass_rate`` gives
(0.25 % up to there, 9 % at 50 million), and the result stays the same.  The list is joined by hash.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is never listed, hence allowed; very long URLs are judged whole; repeated pages are judged row by
row and repeated list entries count once; rules that tie in length are taken by name; an empty list
allows all; further columns of the pages are ignored.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the production filter.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SPAM_HOSTS = ("spam-farm", "cheap-pills")  #: the listed URLs are those of hosts with one of these names
LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 20  #: blocks of 256 bits; the most are 32 MB of bits, the bound of the broadcast
BITS = 16  #: bits of the filter for each listed URL, as long as MOST_BLOCKS allows
WORDS = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query and fragment dropped, ``www.`` and a closing slash or ``.html`` too."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_column(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_of(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def masks_of(url: Column) -> list[Column]:
    """A word of the block for each of four hashes, with one bit set."""
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def blocks_for(listed: int) -> int:
    """Blocks of a filter of so many URLs: a power of two, with BITS bits for each URL within the bounds."""
    wanted = max(LEAST_BLOCKS, -(-listed * BITS // 256))
    return min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())


def pass_rate(listed: int, blocks: int) -> float:
    """About what share of unlisted URLs the filter lets pass to the join: those whose bit is set in each word."""
    return (1 - math.exp(-listed / blocks / 64)) ** WORDS


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """One row per used block: ``block`` and the words ``w0``..``w3``; at most ``blocks`` rows."""
    words = [F.bit_or(m).alias(f"w{k}") for k, m in enumerate(masks_of(F.col(url)))]
    return listed.groupBy(block_of(F.col(url), blocks).alias("block")).agg(*words)


def passes(url: Column) -> Column:
    tests = [F.coalesce(F.col(f"w{k}").bitwiseAND(m) != 0, F.lit(False)) for k, m in enumerate(masks_of(url))]
    return reduce(lambda a, b: a & b, tests)


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, blocks: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of ``pages`` (page_id, url);
    ``listed`` has the canonical URLs to block in its column ``url``."""
    url = F.col("url").cast("string")
    host, path = url_parts(url)
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = own.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    known = listed.select(F.col("url").alias("listed_url")).where(F.col("listed_url").isNotNull() & (F.col("listed_url") != ""))
    if blocks is None:
        n = known.agg(F.approx_count_distinct("listed_url", 0.02)).first()[0]
        blocks = blocks_for(n)
        log.info("%d listed URLs in %d blocks: about %.3f of the others pass", n, blocks, pass_rate(n, blocks))
    probed = own.withColumn("block", block_of(F.col("canonical"), blocks)).join(F.broadcast(bloom_filter(known, "listed_url", blocks)), "block", "left")
    probed = probed.withColumn("suspect", F.col("fit").isNull() & (F.col("host") != "") & passes(F.col("canonical")))
    # grouped by one column more than the join's, so that Spark shuffles both sides of the join by
    # the URL alone and may split a URL that many pages have
    exact = known.groupBy("listed_url", block_of(F.col("listed_url"), blocks).alias("list_block")).agg(F.count("*").alias("times"))
    suspects = probed.where("suspect").select("page_id", "host", "path", "fit", "canonical")
    joined = suspects.join(exact, F.col("canonical") == F.col("listed_url"), "left").select("page_id", "host", "path", "fit", F.col("times").isNotNull().alias("listed"))
    # what the filter turns away is not shuffled at all
    passed = probed.where("NOT suspect").select("page_id", "host", "path", "fit", F.lit(False).alias("listed"))
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(F.col("listed"), "block").otherwise("allow")
    return passed.unionByName(joined).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")


def spam_list(pages: DataFrame) -> DataFrame:
    """The canonical URLs of all pages on hosts with a name in SPAM_HOSTS."""
    host, path = url_parts(F.col("url").cast("string"))
    spam = reduce(lambda a, b: a | b, (F.array_contains(F.split(F.col("host"), r"\."), s) for s in SPAM_HOSTS))
    return pages.select(host.alias("host"), path.alias("path")).where(spam).select(canonical(F.col("host"), F.col("path")).alias("url"))
