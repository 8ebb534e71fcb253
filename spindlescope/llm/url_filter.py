"""URL filter: rules by host and path, then a blocked Bloom filter of listed URLs with an exact join behind it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import stage, table

#: (verdict, rule); a rule is a host, with all its subdomains, and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
#: A block is eight 32-bit lanes with one bit each, so a look-up touches one row.
LANES = 8
BITS_PER_URL = 16
#: 2**17 blocks of 8 lanes: the filter never has more than 131,072 rows; a longer list only lets more false hits through.
MOST_BLOCKS = 1 << 17
#: An address that many pages claim is split into so many parts where the verdicts come back to the pages.
PARTS = 16


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling per address: no scheme, query, fragment, ``www.``, default port or closing slashes."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.concat(bare, F.regexp_replace(path, r"/+$", ""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _lane_bits(url: Column) -> list[Column]:
    """One bit per lane, each from five bits of a second hash."""
    h = F.xxhash64(url, F.lit("lanes"))
    return [F.call_function("shiftleft", F.expr("1L"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int"))
            for i in range(LANES)]


def bloom_blocks(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """Rows (block, lane0..lane7) of the filter over the distinct values of ``column``."""
    bits = _lane_bits(F.col(column))
    rows = listed.select(F.pmod(F.xxhash64(column), F.lit(blocks)).alias("block"), *[b.alias(f"lane{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def blocks_for(urls: int) -> int:
    return max(1, min(MOST_BLOCKS, math.ceil(urls * BITS_PER_URL / (32 * LANES))))


def possible_hits(pages: DataFrame, column: str, listed: DataFrame, listed_column: str, urls: int) -> DataFrame:
    """Rows of ``pages`` that the filter lets through: all listed ones and a few more. The filter has a fixed bound."""
    blocks = blocks_for(urls)
    f = F.broadcast(bloom_blocks(listed, listed_column, blocks))
    hit = F.lit(True)
    for i, bit in enumerate(_lane_bits(F.col(column))):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(bit) != 0)
    return (pages.join(f, F.pmod(F.xxhash64(column), F.lit(blocks)) == F.col("block"))
            .where(hit).select(*pages.columns))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, list_verdict: str = "block") -> DataFrame:
    """Verdict per page: that of the longest rule, else ``list_verdict`` if the canonical URL is listed, else the other one.

    ``pages``: page_id and url; ``listed``: canonical, one row per URL or more. Returns one row per row of
    ``pages``, repeated ids included: page_id, host, path, rule, verdict. A null URL, or one without ``://``, has
    an empty host and path, fits no rule and is never listed. Other columns are left behind.
    """
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = split.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("r"),
                          canonical(F.col("host"), F.col("path")).alias("canonical"))
    listed = listed.select("canonical").where("canonical != ''").distinct()
    open_urls = judged.where("r IS NULL").select("canonical").where("canonical != ''").distinct()
    hits = possible_hits(open_urls, "canonical", listed, "canonical", listed.count())
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    exact = hits.join(listed, "canonical", "left_semi").select("canonical", parts, F.lit(True).alias("listed"))
    other = {"block": "allow", "allow": "block"}[list_verdict]
    return (judged.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS))).join(exact, ["canonical", "part"], "left")
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(F.col("listed"), F.lit(list_verdict)).otherwise(F.lit(other))).alias("verdict")))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs that two or more rows of ``pages`` claim."""
    url = F.col("url")
    c = canonical(host_of(url), path_of(url))
    return pages.select(c.alias("canonical")).groupBy("canonical").count().where("count > 1").select("canonical")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page against the fixed rules; the list holds the addresses that several pages claim."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, stage(repeated_urls(pages)))


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

SQL = rf"""
WITH split AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') AS canonical FROM split),
listed AS (SELECT canonical FROM named WHERE canonical != '' GROUP BY canonical HAVING count(*) > 1),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
