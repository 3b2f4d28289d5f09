"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, pieces, staged, table

NAMES = ["log_bytes", "upper", "symbols", "digits", "spaces", "distinct_words", "word_length", "word_spread", "deflate", "distinct_lines", "log_line", "stops", "repeats"]
FEATURES = "doc_id long, " + ", ".join(f"f{i} double" for i in range(len(NAMES)))
FEATURES_ARROW = pa.schema([("doc_id", pa.int64())] + [(f"f{i}", pa.float64()) for i in range(len(NAMES))])
SCORED = "doc_id long, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]")


def _share(k: float, n: float) -> float:
    """Log-odds of a share, smoothed so that 0 of few and 0 of many differ little."""
    return float(np.log((k + 0.5) / (n - k + 0.5))) if n >= k else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    raw = (text or "").encode()
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    symbols = len(_SYMBOLS.findall(raw))
    words = raw.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), float, k) if k else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x]
    packed = len(zlib.compress(raw, 1))
    ends = sum(x.endswith((b".", b"?", b"!")) for x in lines)
    again = sum(a == b for a, b in zip(words, words[1:]))
    per_word = max(k, 1)
    return [
        float(np.log1p(n)),
        float(np.log((upper + 1) / (upper + lower + 20))),
        float(np.log((symbols + 1) / (per_word + 10))),
        float(np.log((digits + 1) / (n + 100))),
        float(np.log((int(count[32]) + 1) / (n + 10))),
        float(np.log((len(set(words)) + 5) / (k + 5)) + 0.12 * np.log1p(k)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        float(np.log((packed + 20) / (n + 40)) + 0.05 * np.log1p(n)),
        float(np.log((len(set(lines)) + 1) / (len(lines) + 1))),
        float(np.log1p(n / max(len(lines), 1))),
        float(np.log((ends + 1) / (len(lines) + 2))),
        float(np.log((again + 0.5) / (per_word + 10))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in pieces(batches, "text"):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(NAMES)))], schema=FEATURES_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


class Discriminant:
    """Means, Cholesky factors of the shrunken covariances with their inverses, and priors of two classes, made once."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, floor: float = 1e-3):
        d = len(NAMES)
        empty = (0.0, np.zeros(d), np.zeros((d, d)))
        total = sum(v[0] for v in sums.values())
        self.prior, self.mean, self.chol, spread = {}, {}, {}, {}
        for k in (0, 1):
            n, s, q = sums.get(k, empty)
            self.prior[k] = (n + 1) / (total + 2)
            self.mean[k] = s / n if n else np.zeros(d)
            spread[k] = q / n - np.outer(self.mean[k], self.mean[k]) if n else np.zeros((d, d))
        pooled = sum(self.prior[k] * spread[k] for k in (0, 1))
        for k in (0, 1):
            cov = (1 - shrink) * spread[k] + shrink * pooled
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(d)
            self.chol[k] = np.linalg.cholesky(cov if k in sums else np.eye(d))
        self.inverse = {k: np.linalg.inv(v) for k, v in self.chol.items()}  # triangular, so each score is one product
        self.constant = {k: float(np.log(self.prior[k]) - np.log(np.diag(v)).sum()) for k, v in self.chol.items()}
        self.both = all(k in sums for k in (0, 1))

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.mean[k]) @ self.inverse[k].T
        return self.constant[k] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """How likely label 1 is. With only one class learned, its prior."""
        if not self.both:
            return np.full(len(x), self.prior[1])
        return 1 / (1 + np.exp(np.clip(self.log_density(x, 0) - self.log_density(x, 1), -50, 50)))


def fit(found: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality", shrink: float = 0.1) -> Discriminant:
    """Class counts, sums and products of all labelled rows, added up on the executors; two rows reach the driver."""
    d = len(NAMES)
    labels = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("label IN (0, 1)")
    sums = [F.sum(f"f{i}") for i in range(d)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i in range(d) for j in range(i, d)]
    out = {}
    for r in found.join(labels, "doc_id").groupBy("label").agg(F.count("*"), *sums).collect():
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = r[2 + d :]
        out[int(r[0])] = (float(r[1]), np.array(r[2 : 2 + d], float), q + q.T - np.diag(np.diag(q)))
    return Discriminant(out, shrink)


def classify(found: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(NAMES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=SCORED_ARROW)

    return found.mapInArrow(run, SCORED)


def quality(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (doc_id, score): one for each row of ``docs``; ``learn_from`` says which label rows may be learned from.

    Null and empty texts have the statistics of an empty text and get a score like others. Labels other than 0 and 1
    and labels of unknown documents are left out; an id that repeats counts once for each pair of a row and a label.
    With labels of one class or none, scores are the prior. Statistics are made once for each text, in one pass, and
    staged; learning and scoring read those.
    """
    found = staged(features(docs, id_col, text_col), "quality")
    return classify(found, fit(found, labels.where(learn_from), label_id_col, label_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_of_id(F.col("doc_id")) % 5 == 0
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
