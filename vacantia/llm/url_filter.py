"""URL filters (operator 5), in DataFrame functions only: a blocked Bloom filter of listed
canonical URLs lets possible hits through to an exact hash join that removes the false ones.

The filter has BLOCKS blocks of 256 bits, one row each, so its broadcast is bounded (0.8 MB)
however long the list is; a longer list only sends more rows to the exact join. A key sets eight
bits of one block. Rules (host, path) come first: the longest that fits decides.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule, is never
listed and is allowed; repeated rows are judged alike; with an empty list nothing is blocked but by
rule; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

BLOCKS = 1 << 14
LONGS = 4  # of a block; each takes two bits of a key

# (action, rule) as the contract of the query states them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/")]
# Labels of the hosts whose pages make up the list of the query.
LISTED_LABELS = ["ads-track", "casino-win", "free-bets"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "(^|&)(utm_[a-z_]+|ref|gclid|fbclid)=[^&]*"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without closing slashes, query without tracking parts; null if
    there is no host. The scheme and the fragment do not count."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    full = F.concat(name, F.regexp_replace(path(url), "/+$", ""),
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host(url) != "", full)


def fits(rule: str) -> Column:
    """Whether the rule fits columns host and path: its host or a subdomain, its path or below."""
    name, _, below = rule.partition("/")
    return (((F.col("host") == name) | F.col("host").endswith(f".{name}"))
            & F.col("path").startswith(f"/{below}"))


def _decided(rules: list[tuple[str, str]], values: list[str]) -> Column:
    out = F.lit(None).cast("string")
    ranked = sorted(zip(rules, values), key=lambda x: len(x[0][1]))  # the longest is asked first
    for (_, rule), value in ranked:
        out = F.when(fits(rule), F.lit(value)).otherwise(out)
    return out


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def _mask(key: Column, k: int) -> Column:
    bits = F.xxhash64(key, F.lit(17))
    one = F.lit(1).cast("long")
    first, second = (F.shiftrightunsigned(bits, 12 * k + d).bitwiseAND(F.lit(63)).cast("int")
                     for d in (0, 6))
    return _shift(one, first).bitwiseOR(_shift(one, second))


def _shift(one: Column, by: Column) -> Column:
    return F.call_function("shiftleft", one, by)


def bloom_filter(listed: DataFrame) -> DataFrame:
    """Blocks (block, w0..w3) of the keys in column `url_key`."""
    key = F.col("url_key")
    bits = listed.select(_block(key).alias("block"),
                         *[_mask(key, k).alias(f"m{k}") for k in range(LONGS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(LONGS)])


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; `listed` has urls in column url."""
    keys = listed.select(canonical(F.col("url")).alias("url_key")).where("url_key IS NOT NULL")
    keys = cut_lineage(keys.distinct())
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"),
                        canonical(url).alias("url_key"))
    rows = rows.withColumn("rule", _decided(rules, [r for _, r in rules])).withColumn(
        "ruled", _decided(rules, [a for a, _ in rules]))
    key = F.col("url_key")
    probed = rows.withColumn("block", _block(key)).join(
        F.broadcast(bloom_filter(keys)), "block", "left")
    held = reduce(and_, [F.col(f"w{k}").bitwiseAND(_mask(key, k)) == _mask(key, k)
                         for k in range(LONGS)])
    # Only rows that no rule decides and that the filter lets through take part in the join.
    asks = F.col("ruled").isNull() & key.isNotNull() & F.coalesce(held, F.lit(False))
    probed = probed.withColumn("asks", asks)
    possible = probed.where("asks")
    certain = cut_lineage(possible.select("url_key").distinct().join(keys, "url_key", "left_semi"))
    hit = possible.join(certain.withColumn("listed", F.lit(True)), "url_key", "left")
    columns = ["page_id", "host", "path", "rule"]
    free = probed.where("NOT asks").select(
        *columns, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    return free.unionByName(hit.select(
        *columns, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, against the pages of hosts with a listed label as the list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = host(F.col("url"))
    on_list = [F.concat(F.lit("."), name).contains(f".{label}.") for label in LISTED_LABELS]
    return judged(pages, pages.where(reduce(lambda a, b: a | b, on_list)).select("url"))


OP5_SQL = """
WITH split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1),
      '(^|&)(utm_[a-z_]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '')
      || regexp_replace(path, '/+$', '')
      || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key
  FROM split),
listed AS (
  SELECT DISTINCT url_key FROM keyed
  WHERE contains('.' || host, '.ads-track.') OR contains('.' || host, '.casino-win.')
     OR contains('.' || host, '.free-bets.')),
rules(rule, action, h, p) AS (VALUES ('net/', 'block', 'net', '/'),
  ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
fitting AS (
  SELECT k.page_id, k.url, max_by(r.rule, length(r.rule)) AS rule,
    max_by(r.action, length(r.rule)) AS action
  FROM (SELECT DISTINCT page_id, url, host, path FROM keyed) k
  JOIN rules r ON (k.host = r.h OR suffix(k.host, '.' || r.h)) AND prefix(k.path, r.p)
  GROUP BY k.page_id, k.url)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.action,
  CASE WHEN k.url_key IN (SELECT url_key FROM listed WHERE url_key IS NOT NULL)
    THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fitting f
  ON k.page_id IS NOT DISTINCT FROM f.page_id AND k.url IS NOT DISTINCT FROM f.url
"""
