"""URL filter (operator 9): a blocked Bloom filter in front of an exact hash join.

The list holds (host, path, verdict) rules; an entry fits its host and all subdomains when the url's
path starts with the entry's path, and the longest fitting entry decides.  Every url is expanded into
its candidate keys (host suffixes at label borders x path prefixes of the lengths that the list has).
The list's keys fill a blocked Bloom filter kept as a table, one row per 256-bit block: a key picks one
block and sets one bit in each of its eight 32-bit words.  Candidate keys are looked up by block, and
only possible hits go to the exact join on the key itself, which removes false positives.  Block and
list joins are equi-joins whose strategy is left to Spark's own size estimates (nothing is broadcast
by hint), so the list may be of any size; hot hosts repeat on the url side only, where skewed joins
are split.

Defined cases: a null url, or one without ``://``, has empty host and path, fits nothing and is allowed;
an empty path prefix fits every path; rules repeated in the list count once (block before allow); rows
repeating a page id or url are each returned; other columns are ignored;
an empty table gives no row, an empty list allows every url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bits per listed key in the Bloom filter (8 of a 256-bit block are set: about 0.4 % false hits).
BITS_PER_KEY = 16

# The rules of the contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty without ``://``."""
    rest = F.when(F.position(F.lit("://"), url) > 0, F.substr(url, F.position(F.lit("://"), url) + 3)).otherwise("")
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    cut = F.position(F.lit("/"), rest)
    host = F.when(cut > 0, F.substr(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substr(rest, cut)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), blocks)


def _words(key: Column) -> list[Column]:
    """The eight words of a key's mask, one bit in each."""
    h = F.xxhash64(F.lit(2), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(8)]


def canonical_list(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict), one row per listed (host, path)."""
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
            .withColumn("key", F.concat("host", F.lit("\x00"), "path")))


def bloom_blocks(keys: DataFrame) -> DataFrame:
    """(block, w0..w7, blocks): the Bloom filter of ``keys(key)`` as a table, sized by their number."""
    sized = keys.select("key").crossJoin(
        keys.agg(F.greatest(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 256), F.lit(1)).cast("long").alias("blocks")))
    return (sized.groupBy(_block(F.col("key"), F.col("blocks")).alias("block"), "blocks")
            .agg(*[F.bit_or(w).alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))]))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Every row with page_id, url, host, path, rule (host + path or null), verdict; a url is judged once."""
    listed = canonical_list(rules)
    sizes = listed.agg(F.coalesce(F.collect_set(F.char_length("path")), F.array().cast("array<int>")).alias("lens"),
                       F.greatest(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 256), F.lit(1)).cast("long").alias("blocks"))
    host, path = host_and_path(F.col("url"))
    pages = urls.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    labels = F.split("host", "\\.")
    # one parameter row: the path lengths that occur in the list, and the size of the filter
    wide = urls.select("url").distinct().withColumn("host", host).withColumn("path", path).where("host != ''").crossJoin(sizes)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lens", lambda n: n <= F.char_length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\x00"), p))))
    tried = wide.select("url", "blocks", F.explode(F.array_distinct(keys)).alias("key"))
    tried = tried.withColumn("block", _block(F.col("key"), F.col("blocks")))
    filled = bloom_blocks(listed).drop("blocks")
    maybe = F.lit(True)
    for i, w in enumerate(_words(F.col("key"))):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(w) == w)
    possible = tried.join(filled, "block").where(maybe).select("url", "key")
    hits = possible.join(listed, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(
        F.char_length("host").alias("a"), F.char_length("path").alias("b"),
        F.concat("host", "path").alias("rule"), F.col("verdict"))).alias("best"))
    return pages.join(best, "url", "left").select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: host, path, deciding rule and verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path FROM u),
h AS (SELECT p.url, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.url ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM (SELECT DISTINCT url, host, path FROM p) p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM p LEFT JOIN h ON h.url = p.url AND h.k = 1
"""
