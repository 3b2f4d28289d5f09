"""Secret scan: fixed rules, and two character Markov models compared by log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models judge: whole runs of these characters, of 12 at least.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
KINDS = ["assign", "access", "hex", "markov"]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}
#: What the models tell apart: letters, a digit (all as one, written 9) and four signs; and the class of each.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + "9+/_-"
CLASSES = [r"[A-Z]", r"[a-z]", r"[0-9]", r"[+/_-]"]
CLASS_OF = [0] * 26 + [1] * 26 + [2] + [3] * 4
CLASS_SIZE = [26, 26, 1, 4]
#: In how many characters a random one of each class may be: digits are one symbol to both models, but ten to a random string.
CLASS_WEIGHT = [26, 26, 10, 4]
#: Labelled ordinary identifiers, one of a form, learned besides the runs of documents, each as often as SAMPLE_WEIGHT documents.
ORDINARY = [
    "2024-01-02T03-04-05", "20240102T030405", "+1-202-555-0123", "0049-30-901820", "978-3-16-148410-0", "release-1-12-0", "v1-2-3-beta-4",
    "/usr/local/lib/python3/dist-packages", "/var/log/2023/11/30/access", "org/apache/spark/sql", "getElementsByClassName", "toString2Bytes",
    "MAX_VALUE_OF_COLUMN", "user_id_of_customer_17", "image-2048x1536-large", "README-en-2020", "chapter12-section3",
]
SAMPLE_WEIGHT = 10
#: Runs that are learned from one document: words of one case, or with a capital in front, with signs between, up to a length.
LONGEST_PLAIN = 64
PLAIN = r"^([A-Z]?[a-z]*|[A-Z]+)([+/_-]([A-Z]?[a-z]*|[A-Z]+))*$"
#: Weight of a character's own frequency against the counts of what came before it, in the ordinary model, and of classes by
#: their sizes against the counts of random samples.
BACK_OFF, CLASS_PRIOR = 5.0, 20.0
#: The share of a uniform model in the model of ordinary strings.
UNIFORM = 0.02
#: Nats a transition and in all by which a run must look random rather than ordinary: twice as likely at each step.
MIN_MEAN, MIN_TOTAL = math.log(2), 8.0
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches whose places are added up at once; longer lists are added up by such chunks, so that time stays near linear.
CHUNK = 128


def _located(gaps: Column, matches: Column, kind: int) -> Column:
    """Where the matches of a pattern lie, from the lengths of the texts between and of the matches."""
    sizes = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))), lambda x: x["n"].isNotNull())
    chunks = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())
    starts = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
    starts = F.aggregate(chunks, starts, lambda done, c: F.struct((done["at"] + total(c)).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])

    def step(done: Column, x: Column) -> Column:
        at = done["at"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end"))
        return F.struct((at + x["n"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    within = lambda at, chunk: F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda done: done["out"])
    return F.coalesce(F.flatten(F.zip_with(starts, chunks, within)), F.array().cast(SPAN))


def extract(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, base, held, runs): the row, spans of the rules, what those hold, and runs that the models judge."""
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = found.select("doc", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    found = found.withColumn("g_assign", F.when(F.size("m_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))))
    found = found.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).alias(f"p_{k}") for k, p in PATTERNS.items()])
    spans = {k: _located(F.col(f"p_{k}"), F.col(f"m_{k}"), i) for i, k in enumerate(KINDS)}
    found = found.select("doc", "m_access", "m_hex", "m_markov", "g_assign", *[s.alias(f"s_{k}") for k, s in spans.items()])
    long_enough = F.filter("s_assign", lambda s, i: F.length(F.get("g_assign", i)) >= 6)
    base = F.array_sort(F.concat(long_enough, "s_access", "s_hex"))
    held = F.concat(F.filter(F.coalesce("g_assign", F.array().cast("array<string>")), lambda v: F.length(v) >= 6), "m_access", "m_hex")
    run = F.zip_with("s_markov", "m_markov", lambda s, m: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), m.alias("value")))
    return found.select("doc", base.alias("base"), held.alias("held"), run.alias("runs"))


def _codes(value: Column) -> Column:
    """Places in ALPHABET of the characters of a run. The run is split once, so time is linear in its length."""
    plain = F.translate(value, "0123456789", "9" * 10)
    return F.transform(F.split(plain, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)


def _kind(value: Column) -> Column:
    """Which of CLASSES occur in a run, as bits."""
    return sum((F.when(value.rlike(c), 1 << i).otherwise(0) for i, c in enumerate(CLASSES)), F.lit(0))


def _steps(codes: Column, f) -> Column:
    """``f`` of each character and the next one."""
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), f)


def train(found: DataFrame) -> tuple[list[float], list[float]]:
    """Log-likelihoods of transitions under both models: of ordinary strings by two characters' places in ALPHABET, of
    random ones by the classes of a string and of two characters. One row a kind and transition reaches the driver.

    Samples of random strings are what the rules found, by the classes that they have. Samples of ordinary ones are
    ORDINARY and the runs of documents in which the rules found nothing, each different one as often as documents have it
    (SAMPLE_WEIGHT times at most), with all digits alike, as written, in upper case and in lower case; those that aren't PLAIN, such as those with a digit or with mixed
    cases, only if several documents have them so, as a secret that no rule knows isn't plain and no other document has
    it. So dates, numbers and versions are learned by their form.
    """
    secret = found.select(F.lit(1).alias("label"), F.explode("held").alias("value"), F.lit(1).alias("k"))
    forms = F.array_distinct(F.transform("runs.value", lambda v: F.translate(v, "0123456789", "9" * 10)))
    seen = found.where(F.size("base") == 0).select(F.explode(forms).alias("value")).groupBy("value").agg(F.count("*").alias("k"))
    seen = seen.where((F.col("k") > 1) | F.when(F.length("value") <= LONGEST_PLAIN, F.col("value").rlike(PLAIN))).select(F.lit(0).alias("label"), "value", F.least("k", F.lit(SAMPLE_WEIGHT)).alias("k"))
    given = found.sparkSession.range(1).select(F.lit(0).alias("label"), F.explode(F.array(*map(F.lit, ORDINARY))).alias("value"), F.lit(SAMPLE_WEIGHT).alias("k"))
    samples = secret.union(seen).union(given)
    kind = F.when(F.col("label") == 1, _kind(F.col("value"))).otherwise(0).alias("kind")
    n = len(ALPHABET)
    step = F.explode(_steps(_codes(F.col("value")), lambda a, b: F.when((a >= 0) & (b >= 0), a * n + b))).alias("step")
    counts: dict[int, dict[tuple[int, int], int]] = {}
    rows = samples.select("k", kind, "label", step).where(F.col("step").isNotNull()).groupBy("label", "kind", "step").agg(F.sum("k").alias("k"))
    for r in rows.collect():  # 17 times the square of the alphabet at most
        counts.setdefault(r["kind"] if r["label"] else -1, {})[divmod(r["step"], n)] = r["k"]
    return ordinary(counts.pop(-1, {})), random_strings(counts)


def ordinary(counts: dict[tuple[int, int], int]) -> list[float]:
    """Log-probability of each transition of ordinary strings, which count as written, in upper and in lower case."""
    n = len(ALPHABET)
    cases = [list(range(n)), [ALPHABET.index(c.upper()) for c in ALPHABET], [ALPHABET.index(c.lower()) for c in ALPHABET]]
    pair = [[0] * n for _ in range(n)]
    for (a, b), k in counts.items():
        for case in cases:
            pair[case[a]][case[b]] += k
    into = [sum(row[b] for row in pair) for b in range(n)]
    total = sum(into)

    def p(a: int, b: int) -> float:
        alone = (into[b] + 1) / (total + n)
        return (1 - UNIFORM) * (pair[a][b] + BACK_OFF * alone) / (sum(pair[a]) + BACK_OFF) + UNIFORM / n

    return [math.log(p(a, b)) for a in range(n) for b in range(n)]


def random_strings(counts: dict[int, dict[tuple[int, int], int]]) -> list[float]:
    """Log-probability of each transition of random strings: by kind (classes that the string has), class and next class.

    Characters of a class are alike. Without samples of a kind all its characters are.
    """
    out = []
    for kind in range(16):
        held = [c for c in range(4) if kind >> c & 1]
        step = [[0] * 4 for _ in range(4)]
        for (a, b), k in counts.get(kind, {}).items():
            step[CLASS_OF[a]][CLASS_OF[b]] += k
        all_ = sum(CLASS_WEIGHT[c] for c in held) or 1
        for a in range(4):
            for b in range(4):
                share = (step[a][b] + CLASS_PRIOR * CLASS_WEIGHT[b] / all_) / (sum(step[a]) + CLASS_PRIOR)
                out.append(math.log(share / CLASS_SIZE[b]) if a in held and b in held else 0.0)
    return out


def _literal(values: list[float]) -> Column:
    return F.expr("array(" + ",".join(f"{x:.9e}D" for x in values) + ")")  # folded into one literal


def judged(found: DataFrame, models: tuple[list[float], list[float]]) -> DataFrame:
    """(doc, base, spans): ``spans`` are those of the rules, and the runs that look random and touch none of those."""
    plain, drawn = map(_literal, models)
    n = len(ALPHABET)
    class_of = F.expr("array(" + ",".join(map(str, CLASS_OF)) + ")")

    def ratio(r: Column) -> Column:
        of = lambda a, b: F.get(drawn, r["set"] + F.get(class_of, a) * 4 + F.get(class_of, b)) - F.get(plain, a * n + b)
        return F.aggregate(_steps(r["codes"], of), F.lit(0.0), lambda done, x: done + x)

    place = lambda r: [r[k].alias(k) for k in ("start", "kind", "end")]
    coded = F.transform("runs", lambda r: F.struct(*place(r), (_kind(r["value"]) * 16).alias("set"), _codes(r["value"]).alias("codes")))  # once a run, not a character
    scored = F.transform(coded, lambda r: F.struct(*place(r), F.when(r["set"].bitwiseAND(3 * 16) != 0, ratio(r)).otherwise(0.0).alias("ratio")))
    random = F.filter("scored", lambda r: (r["ratio"] >= MIN_TOTAL) & (r["ratio"] >= MIN_MEAN * (r["end"] - r["start"] - 1)) & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    added = F.transform(random, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return found.withColumn("scored", scored).select("doc", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, base, spans): each row of ``docs`` as a struct, and arrays of (start, kind, end) by start and kind.

    Places are code points, ends exclusive, kinds places in KINDS. Null and empty texts have no spans. Rules count
    leftmost matches that don't overlap within a kind; kinds may overlap. Each row gives one row; repeated rows, null
    ids and columns of any names are fine. The models judge each run of 12 characters and more that no rule touches as a
    whole. A run without a letter is never a secret to them: digits and signs alone are dates, times, numbers of phones,
    books and cards, which are personal data at most. Texts are read once: what rules and models need of them is staged with
    ``docs``, then the models are trained on all of it and applied to all of it.
    """
    found = staged(extract(docs, text_col), "secrets")
    return judged(found, train(found))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span (merged where they overlap) replaced by ``mark``; other texts stay as they are."""
    found = staged(extract(docs, text_col), "secrets")
    found = judged(found.repartition(4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), train(found))
    text = F.col("doc").getField(text_col)

    def step(done: Column, s: Column) -> Column:
        new = F.array(text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit(mark))
        apart = (s["start"] > done["at"]) | (F.size(done["out"]) == 0)
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(apart, F.concat(done["out"], new)).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda done: F.array_join(F.concat(done["out"], F.array(text.substr(done["at"] + 1, F.length(text)))), ""))
    whole = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[(whole if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = staged(extract(docs).withColumn("doc", F.struct("doc.doc_id")), "secrets")
    models = train(found)
    found = found.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # small rows, many steps for each
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return judged(found, models).select("doc.doc_id", n("assign"), n("access"), n("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
