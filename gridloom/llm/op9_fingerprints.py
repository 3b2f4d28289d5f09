"""Document fingerprints by consistent weighted sampling over weighted terms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SAMPLES = 32
#: Ids that go to one group of the window which finds each document's neighbour.
IDS_A_BUCKET = 1024
#: Buckets (32 bytes each) up to which their table is broadcast to find their first documents; beyond, it is shuffled.
BROADCAST_BUCKETS = 1 << 18
#: Partitions of texts for each one of the session's: terms take many times the room of their text.
FINER = 4
_BITS = 21


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sample's value of a term: the smallest one of a document marks what it drew.

    r and c are gamma(2, 1) and beta is uniform, all from hashes of the term and k. The weight is brought down to
    y = exp(r (t - beta)), t = floor(log(weight) / r + beta), and the value is c / (y exp(r)). Documents draw the same
    (term, t) with the probability of their generalised Jaccard similarity, and the value depends on nothing else.
    """
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    uniform = lambda x, i: (F.shiftrightunsigned(x, i * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)) + F.lit(0.5)) * F.lit(2.0**-_BITS)
    r = -F.ln(uniform(h, 0) * uniform(h, 1))
    c = -F.ln(uniform(g, 0) * uniform(g, 1))
    beta = uniform(h, 2)
    t = F.floor(log_weight / r + beta)
    return c * F.exp(-r * (t - beta + F.lit(1.0)))


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """One row for each of ``keys``: ``signature``, an array of ``samples`` ints.

    Terms are the words of the lower-case text between white space, weighted by how often they occur; a text without
    words has the empty term. If ``texts`` is already partitioned by some of ``keys``, nothing is shuffled here.
    """
    flat = F.trim(F.translate(F.lower(F.col(text_col)), "\t\n\r\f\v", "     "))
    words = texts.select(*keys, F.explode(F.split(flat, " ")).alias("word"), (F.length(flat) == 0).alias("blank")).where((F.col("word") != "") | F.col("blank"))
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.ln(F.count(F.lit(1)).cast("double")).alias("log_weight"))
    drawn = terms.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)])
    return drawn.select(*keys, F.array(*[F.hash(f"s{k}") for k in range(samples)]).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a).cast("double")


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def next_buckets(tops: DataFrame) -> DataFrame:
    """(shown_in, bucket, doc_id): for each bucket of ``tops`` the next lower one and its top, for the lowest the highest.

    A window finds them within ranges of buckets; across these, one of a row for each range.
    """
    parts = int(tops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(tops.repartitionByRange(parts, "bucket").withColumn("part", F.spark_partition_id()), "fingerprints-buckets")
    edges = ranged.groupBy("part").agg(F.max(F.struct("bucket", "doc_id")).alias("top"))
    lower = Window.orderBy(F.desc("part"))
    whole = lower.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lead("top").over(lower), F.first("top").over(whole)).alias("beyond"))
    within = F.lead(F.struct("bucket", "doc_id")).over(Window.partitionBy("part").orderBy(F.desc("bucket")))
    found = ranged.select("part", F.col("bucket").alias("shown_in"), within.alias("f")).join(F.broadcast(edges), "part")
    found = found.withColumn("f", F.coalesce("f", "beyond"))
    return staged(found.select("shown_in", F.col("f.bucket").alias("bucket"), F.col("f.doc_id").alias("doc_id")), "fingerprints-buckets")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text and the place of the next one, in descending order of the id.

    Documents are dealt by id into buckets of IDS_A_BUCKET ids, in which a window finds the next one; the last of a
    bucket is shown the first document of the next bucket that has any (of the first, after the last), as one further
    row. Buckets are ordered by ranges, of which only the edges meet in one place. Null ids come last, in buckets by
    ranges of their texts' hashes; rows of one id stand in the order of these.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket = F.coalesce(F.floor(F.col("doc_id") / IDS_A_BUCKET), F.lit(-(1 << 62)) + F.shiftright(F.xxhash64("text"), 44))
    rows = rows.select(bucket.alias("bucket"), "doc_id", "text")
    follow = next_buckets(rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")))
    follow = F.broadcast(follow) if follow.count() <= BROADCAST_BUCKETS else follow
    shown = rows.join(follow.select("bucket", F.col("doc_id").alias("top"), "shown_in"), (rows["bucket"] == follow["bucket"]) & rows["doc_id"].eqNullSafe(F.col("top"))).select("shown_in", rows["bucket"].alias("of_bucket"), "doc_id", "text")
    shown = shown.groupBy("shown_in", "of_bucket", "doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    both = rows.select("bucket", "doc_id", "text", F.lit(0).alias("guest"), F.col("bucket").alias("of_bucket")).union(shown.select("shown_in", "doc_id", "text", F.lit(1), "of_bucket"))
    both = both.repartition(FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    at = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    seen = both.select(
        "bucket", F.row_number().over(at).alias("place"), "guest", "doc_id", "text",
        F.lead("text").over(at).alias("next_text"), F.lead("guest").over(at).alias("next_guest"), F.lead("of_bucket").over(at).alias("next_bucket"),
    ).where("guest = 0")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    return seen.select("bucket", "place", "doc_id", "text", edited.alias("edited"), "next_bucket", F.when(F.col("next_guest") == 1, 1).otherwise(F.col("place") + 1).alias("next_place"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; an empty text has one term, the empty one, so two empty texts are alike. A single
    document is its own next. Texts are dealt by bucket; terms, samples and windows all stay there. That is done twice,
    for what is known of a document and for its signatures, so that nothing but numbers goes through the aggregation
    of terms; both are staged, and signatures are joined with those of the next documents by place.
    """
    pairs = edited_pairs(docs, id_col, text_col)
    place = ["bucket", "place"]
    info = pairs.select(*place, "doc_id", "next_bucket", "next_place", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    info = staged(info, "fingerprints-info")
    both = pairs.select(*place, F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))))
    drawn = staged(signatures(both, [*place, "which"], "t", samples), "fingerprints-drawn")
    own = drawn.where("which = 0").select(*place, F.col("signature").alias("own"))
    other = drawn.where("which = 1").select(*place, F.col("signature").alias("other"))
    following = own.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("own").alias("following"))
    joined = info.join(own, place).join(other, place).join(following, ["next_bucket", "next_place"])
    return joined.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
