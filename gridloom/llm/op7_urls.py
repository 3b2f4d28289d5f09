"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged, table

WORDS = 4
BITS_A_KEY = 16
#: Rows of the filter (48 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle on the block.
BROADCAST_BLOCKS = 1 << 16
#: Distinct (host, path start) that a rule fits up to which they are broadcast to the pages; beyond, both are shuffled,
#: in a join of two plain tables, in which Spark splits hot keys.
BROADCAST_KEYS = 1 << 17

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict")) for r, v in rules])))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; null or no ``://``: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, n_blocks: int) -> list[Column]:
    """The block of a key, and for each of its words the one bit that the key sets there."""
    h = F.xxhash64(key, F.lit(7))
    return [F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")] + [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")).alias(f"bit{i}") for i in range(WORDS)]


def bloom_blocks(rules: DataFrame, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter as rows (block, w0..w3); each key touches one block only."""
    return rules.select(*_bits(F.col("rule"), n_blocks)).groupBy("block").agg(*[F.bit_or(f"bit{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` by the longest of ``rules`` (rule, rule_verdict) that fits.

    A rule ``host/path`` fits its host and all subdomains where the URL's path starts with the rule's. Its key is the
    rule itself; the keys of a URL are each suffix of its host joined with each prefix of its path of a length that
    some rule has. Keys are made once for each distinct (host, path start), tested against the Bloom filter, and what
    passes is joined with the list, which removes false positives. Null or malformed URLs and URLs without a fitting
    rule get a null ``rule`` and ``default``. Repeated rows, null ids and further columns are fine; rules that repeat
    with different verdicts count as ``block``.
    """
    rules = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("rule_verdict").alias("rule_verdict"))
    cut = F.instr("rule", "/")
    shape = rules.select((F.length("rule") - F.when(cut > 0, cut - 1).otherwise(F.length("rule"))).alias("n"), F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"))
    lengths = shape.agg(F.sort_array(F.collect_set("n")), F.max("labels"), F.count("*")).first()
    prefix_lengths, most_labels, n_rules = lengths[0] or [0], lengths[1] or 1, lengths[2]
    n_blocks = max(1, -(-n_rules * BITS_A_KEY // (64 * WORDS)))

    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("start", F.substring("path", 1, max(prefix_lengths)))
    labels = F.split("host", r"\.")
    tail = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.array_distinct(F.array(*[F.substring("start", 1, n) for n in prefix_lengths]))
    keys = judged.select("host", "start").distinct().select("host", "start", F.explode(tail).alias("tail"), heads.alias("heads")).select("host", "start", "tail", F.explode("heads").alias("head"))

    blocks = bloom_blocks(rules, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks
    keys = keys.select("host", "start", F.concat("tail", "head").alias("key"))
    tested = keys.select("host", "start", "key", *_bits(F.col("key"), n_blocks)).join(blocks, "block")
    for i in range(WORDS):
        tested = tested.where(F.col(f"w{i}").bitwiseAND(F.col(f"bit{i}")) != 0)
    exact = tested.select("host", "start", F.col("key").alias("rule")).join(rules, "rule")
    best = exact.groupBy("host", "start").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("rule_verdict"))).alias("best"))
    best = staged(best, "urls-judged")
    best = F.broadcast(best) if best.count() <= BROADCAST_KEYS else best
    return judged.join(best, ["host", "start"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


_FITS = "\n".join(
    f"    UNION ALL SELECT '{r}' AS rule, '{r.split('/', 1)[0]}' AS rule_host, '/{r.split('/', 1)[1]}' AS rule_path, '{v}' AS rule_verdict" for r, v in RULES
).replace("    UNION ALL ", "    ", 1)
SQL = f"""
WITH rules AS (
{_FITS}
), rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), best AS (
    SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""
