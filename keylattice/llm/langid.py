"""Language of web pages by Bayesian evidence fusion.

For every page, log posterior(language) is the sum of

* the text's likelihood: hashed byte trigrams of the page's visible text under
  one multinomial a language, counted over all ``documents`` of that language,
  tempered to ``TEXT_WEIGHT`` trigrams so that a long text isn't infinitely sure;
* the likelihood of the declared markup language (``<html lang>``), and of the
  address suffix, given the language;
* the prior of the page's host, smoothed by its registered domain's, which is
  smoothed by the whole table's.

The last three tables are estimated from the pages themselves: each page adds
its text-only posterior to the counts of its declaration, suffix, host and
domain, by grouped aggregation; its own share is taken off again when the page
itself is judged.  Declarations that contradict the text so lose weight by
themselves.

The model that is broadcast has ``BUCKETS`` numbers a language.  One pass over
the documents, one over the pages; everything after that reads a narrow table.

Defined cases: null or empty html has no text and declares nothing; a page or
document of any length is read whole; a null or
malformed url has no host and no suffix: that evidence is then absent; a row
with a null ``page_id`` is judged, with a null id; repeated rows count each;
documents with a null or empty ``lang`` are ignored; ties go to the
alphabetically first language; without any language the result has null
``lang``; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keylattice.llm.shared import materialize
from keylattice.llm.textkit import slices, utf8

BUCKETS = 1 << 16
TEXT_WEIGHT = 40.0
#: Pages' worth of the wider level that a narrower one gets.
STRENGTH = 4.0
#: The last two labels of a host, or three where the last two are a country's second level, as in co.uk.
DOMAIN = r"([^.]+\.(?:(?:ac|co|com|edu|go|gob|gouv|gov|gv|ltd|ne|net|nom|or|org|plc|sch)\.[a-z]{2}|[^.]+))$"
SCHEMA = "page_id bigint, lang string, probability double, text_lang string, declared string, n_trigrams bigint"
_HIDDEN = r"(?is)<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>|<!--.*?-->"


def trigrams(texts: pa.Array, hide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts, without digits and punctuation, and each text's first one."""
    data, off = utf8(texts)
    n = len(data)
    keep = (data >= 128) | ((data >= 97) & (data <= 122))
    if hide:
        at = np.arange(n)
        opened = np.maximum.accumulate(np.where(data == 60, at, -1))
        closed = np.maximum.accumulate(np.where(data == 62, at, -1))
        keep &= opened <= closed
    space = np.zeros(n, bool)
    space[1:] = keep[:-1]
    space &= ~keep  # the first character after a word stands for the gap
    use = keep | space
    letters = np.where(keep, data, np.uint8(32))[use].astype(np.uint32)
    first = np.append(0, np.cumsum(use))[off]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = letters[:-2] * np.uint32(0x9E3779B1) + letters[1:-1] * np.uint32(0x85EBCA6B) + letters[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    b = (h >> np.uint32(16)).astype(np.int64)
    text = np.searchsorted(first, np.arange(len(b)), "right") - 1
    own = np.arange(len(b)) + 2 < first[text + 1]
    total = np.append(0, np.cumsum(own))
    return b[own], total[np.minimum(first, len(b))]


def visible(html: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(html.cast(pa.large_string()), ""), _HIDDEN, " ")


def fit_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and log p(bucket | language)."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            lang = b.column("lang").to_pylist()
            bucket, first = trigrams(b.column("text"))
            names = sorted({x for x in lang if x})
            which = np.array([names.index(x) if x else len(names) for x in lang])
            n = np.bincount(np.repeat(which, np.diff(first)) * BUCKETS + bucket, minlength=(len(names) + 1) * BUCKETS)
            for i, x in enumerate(names):
                counts[x] = counts.get(x, 0) + n[i * BUCKETS : (i + 1) * BUCKETS]
        for x, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], names=["lang", "bucket", "n"])

    total = docs.select(F.lower(F.trim("lang")).alias("lang"), "text").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(total["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    for i, x in enumerate(names):
        own = total[total["lang"] == x]
        counts[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(1, keepdims=True)) if names else counts


def text_evidence(texts: pa.Array, log_p: np.ndarray, hide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams, and tempered log likelihood of each language, of each text."""
    bucket, first = trigrams(texts, hide)
    n = np.diff(first)
    total = np.zeros((len(log_p), len(bucket) + 1))
    np.cumsum(log_p[:, bucket], axis=1, out=total[:, 1:])
    return n, ((total[:, first[1:]] - total[:, first[:-1]]) * np.minimum(1, TEXT_WEIGHT / np.maximum(n, 1))).T


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Every page's most probable language."""
    spark = pages.sparkSession
    names, log_p = fit_text(docs)
    size = len(names)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "html",
        F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"),
        F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)).alias("declared"),
    )
    own = own.select("page_id", "html", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("host", "declared")))
    if not size:
        return own.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", F.lit(0).cast("bigint").alias("n_trigrams"))
    model = spark.sparkContext.broadcast(log_p)

    def run(batches):
        for b in slices(batches, "html"):
            n, z = text_evidence(visible(b.column("html")), model.value, hide=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("declared"), pa.array(n.astype(np.int64)), pa.array(list(z), pa.list_(pa.float64())), pa.array(list(_softmax(z)), pa.list_(pa.float64()))],
                names=["page_id", "host", "declared", "n", "z", "p"],
            )

    seen = own.mapInArrow(run, "page_id bigint, host string, declared string, n bigint, z array<double>, p array<double>")
    seen = seen.withColumn("domain", F.regexp_extract("host", DOMAIN, 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    seen = materialize(seen, "evidence")

    def counts(key: str) -> DataFrame:
        return seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(size))).alias(f"by_{key}"))

    whole = seen.agg(*(F.sum(F.col("p")[i]) for i in range(size))).first()
    whole = np.array([x or 0.0 for x in whole])
    kinds = {k: max(1, seen.where(F.col(k).isNotNull()).select(k).distinct().count()) for k in ("declared", "suffix")}
    known = spark.sparkContext.broadcast((names, whole, kinds))
    joined = seen
    for key in ("host", "domain", "declared", "suffix"):
        joined = joined.join(counts(key), key, "left")

    def fuse(batches):
        names, whole, kinds = known.value
        for b in batches:
            if not b.num_rows:
                continue
            vec = lambda c: np.array([x if x is not None else [0.0] * len(names) for x in b.column(c).to_pylist()])
            z, p = vec("z"), vec("p")
            has = {k: ~b.column(k).is_null().to_numpy(zero_copy_only=False)[:, None] for k in ("host", "domain", "declared", "suffix")}
            rest = np.maximum(whole - p, 0)
            prior = (rest + 1) / (rest + 1).sum(1, keepdims=True)
            for k in ("domain", "host"):
                c = np.maximum(vec(f"by_{k}") - p, 0)
                prior = np.where(has[k], (c + STRENGTH * prior) / (c.sum(1, keepdims=True) + STRENGTH), prior)
            score = z + np.log(prior)
            for k, n in kinds.items():
                c = np.maximum(vec(f"by_{k}") - p, 0)
                score += np.where(has[k], np.log((c + 1 / n) / (rest + 1)), 0)
            q = _softmax(score)
            best = q.argmax(1)
            text = [names[i] if n else None for i, n in zip(z.argmax(1), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([names[i] for i in best]), pa.array(q[np.arange(len(q)), best]), pa.array(text, pa.string()), b.column("declared"), b.column("n")],
                names=["page_id", "lang", "probability", "text_lang", "declared", "n_trigrams"],
            )

    return joined.mapInArrow(fuse, SCHEMA)
