"""Quality rule: hashed n-gram log-likelihood ratio.

Single tokens and pairs of neighbouring tokens are hashed into a fixed number
of buckets.  Two multinomials over the buckets are estimated: ``raw`` from every
document, ``target`` from trusted documents.  A document's score is the mean,
over its n-grams, of log p_target - log p_raw, and every document is decided by
the same threshold.

Tokens are runs of letters and digits with their case, or runs of punctuation,
so decorated, shouted or tabular text has n-grams of its own.

The labels are used as a bounded sample: the ``TRUSTED`` labelled good
documents, none labelled toxic, with the smallest hashed ids.  Every second one
of them is the target; the others are held out, and the threshold is the score
that all but ``LOST`` of them reach.  The target is smoothed by the raw corpus
with a fixed share of its own size (``PRIOR``).  Neither so depends on the size
of the tables.  The raw counts cover the whole table.  What is broadcast is two
vectors of ``BUCKETS`` numbers and the sampled ids; none grows with the data.
Two narrow passes over the text, one more that only takes n-grams of held-out
documents, and one aggregation of at most ``BUCKETS`` rows a task.

Defined cases: a null or empty text has no n-grams, a score of 0 and is kept
(there is nothing to hold against it); a text of any length is scored whole; a
row with a null ``doc_id`` is scored like any other and is never trusted;
repeated rows count and are scored each on its own, and so do rows that share an
id and differ in text; null labels are ignored, an id labelled both good and
bad, or toxic, is not trusted; with no trusted document every score is 0, and
with none held out all documents are kept; a tie with the threshold is kept;
other columns, whatever their names, are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keylattice.llm.textkit import U64, mix, runs, slices

BUCKETS = 1 << 16
#: Labelled good documents that are used, at most: half as target, half held out.
TRUSTED = 20_000
#: Share of the held-out good documents that may fall below the threshold.
LOST = 0.001
#: Pseudo-counts from the raw corpus, as a share of the target's n-grams.
PRIOR = 0.3
SCHEMA = "doc_id bigint, n_grams bigint, score double, keep boolean"


def grams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams, and each text's first one (with the total at the end)."""
    r = runs(texts)
    h, n = r.hashes, len(r.hashes)
    pair = np.zeros(n, bool)
    pair[:-1] = True
    last = r.first[1:][np.diff(r.first) > 0] - 1
    pair[last] = False
    both = np.empty(2 * n, U64)
    both[0::2] = h
    both[1:-1:2] = mix(h[:-1] + h[1:] * U64(0x9E3779B97F4A7C15))
    keep = np.ones(2 * n, bool)
    keep[1::2] = pair
    at = np.zeros(2 * n + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return (both[keep] >> U64(64 - (buckets.bit_length() - 1))).astype(np.int64), at[2 * r.first]


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the target's documents and of those held out."""
    good = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("q"), F.max("quality").alias("p"), F.max("toxic").alias("toxic"))
        .where("q = 1 and p = 1 and coalesce(toxic, 0) = 0")
    )
    ids = np.array([r[0] for r in good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()], np.int64)
    return np.sort(ids[::2]), np.sort(ids[1::2])


def among(ids: pa.Array, some: np.ndarray) -> np.ndarray:
    """Which ids are among these; a null id never is."""
    return pc.fill_null(pc.is_in(ids, value_set=pa.array(some, pa.int64()), skip_nulls=True), False).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRUSTED, prior: float = PRIOR, lost: float = LOST) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold."""
    target_ids, held_ids = trusted_ids(labels, most)
    spark = docs.sparkSession
    trusted = spark.sparkContext.broadcast(target_ids)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")

    def count(batches):
        both = np.zeros((2, buckets), np.int64)
        for b in slices(batches):
            g, first = grams(b.column("text"), buckets)
            both[0] += np.bincount(g, minlength=buckets)
            good = among(b.column("doc_id"), trusted.value)
            if good.any():
                both[1] += np.bincount(g[np.repeat(good, np.diff(first))], minlength=buckets)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], names=["bucket", "raw", "target"])

    total = docs.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[total.bucket], target[total.bucket] = total.raw, total.target
    ratio = log_ratio(raw, target, prior)
    if not target.sum() or not len(held_ids):
        return ratio, -np.inf
    given = spark.sparkContext.broadcast((ratio, held_ids))

    def judge(batches):
        ratio, held = given.value
        for b in slices(batches):
            b = b.filter(pa.array(among(b.column("doc_id"), held)))
            n, s = scores(b.column("text"), ratio)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "s"]).filter(pa.array(n > 0))

    # an id's rows count once, by the lowest: at most half of ``most`` rows reach the driver
    found = docs.mapInArrow(judge, "doc_id bigint, s double").groupBy("doc_id").agg(F.min("s").alias("s")).toPandas()["s"].to_numpy()
    return ratio, threshold(found, lost)


def threshold(held: np.ndarray, lost: float = LOST) -> float:
    """The score that all but a share of the held-out good documents reach; never above 0, which texts without n-grams have."""
    return min(0.0, float(np.sort(held)[int(lost * len(held))])) - 1e-9 if len(held) else -np.inf


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p = (raw + 1) / (raw + 1).sum()
    q = (target / target.sum() + prior * p) / (1 + prior)
    return np.log(q) - np.log(p)


def scores(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and mean log ratio of each text; a text's score doesn't depend on those around it."""
    g, first = grams(texts, len(ratio))
    n = np.diff(first)
    total = np.bincount(np.repeat(np.arange(len(n)), n), ratio[g], minlength=len(n))
    return n, total / np.maximum(n, 1)


def score(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """Every document's score and decision."""
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitted))

    def run(batches):
        ratio, least = given.value
        for b in slices(batches):
            n, s = scores(b.column("text"), ratio)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(s), pa.array(s >= least)], names=["doc_id", "n_grams", "score", "keep"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitted))

    def run(batches):
        ratio, least = given.value
        for b in slices(batches):
            yield b.filter(pa.array(scores(b.column("text"), ratio)[1] >= least))

    return docs.mapInArrow(run, docs.schema)
