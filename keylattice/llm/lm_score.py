"""Masked pseudo-likelihood scores from a bidirectional window network.

A document's score is the sum, over all its words, of log p(word | the ``SIDE``
words on either side), as if each were masked.  p has two factors:

* p(leaf | both sides), from a small network in numpy: embeddings of the words
  around, one hidden layer, and a softmax in two levels, ``CLASSES`` classes of
  ``WIDTH`` leaves, both of which see the context.  The ``OWN`` most frequent
  words are leaves of their own; any other word's leaf is its form (its last
  three bytes, hashed to one of ``FORMS``);
* p(word | form), a word's exact share of all words of its form.  It is 1 for
  the words with a leaf of their own.

All words of all documents are counted exactly, by 64-bit hash: the table of
counts grows with the input and is never gathered.  What is broadcast has a
fixed size: the ``KNOWN`` most frequent words (in whole bands of counts) with
their leaves and shares, the forms' totals, and the network.  The counts of all
other words reach the documents by a join; such words are rare, so none is hot.

Every input partition trains the network on all words of all its documents.  In
each of ``ROUNDS`` rounds the words whose turn it is, by hash of the context,
are masked, so every word is the target once.  The partitions' networks start
from the same weights and are averaged by their number of masked words in a
distributed aggregation; the driver only gets the mean.

Defined cases: a null or empty text has no word: its sum is 0 and its mean
null; neighbours beyond the ends of a text are a padding word; a text of any
length is counted, trained on and scored whole; a row with a null ``doc_id`` is
treated like any other; repeated rows count each; words of equal counts are
ordered by hash; other columns, whatever their names, are not read; an empty
table gives an empty result.  Sums are rounded to 6 decimals.  The mean of
partition networks depends, slightly, on how the input is split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keylattice.llm.shared import materialize
from keylattice.llm.textkit import U64, Words, mix, signed, slices, words

CLASSES = WIDTH = 64
LEAVES = CLASSES * WIDTH
OWN = 48 * WIDTH
FORMS = LEAVES - OWN
#: Words that are broadcast with their counts, at most.
KNOWN = 1 << 18
SIDE, EMBED, HIDDEN = 2, 12, 32
#: A step's words: an eighth of a slice's, but no more than BATCH.
ROUNDS, BATCH, RATE = 2, 8192, 0.2
SCHEMA = "doc_id bigint, n_words bigint, log_likelihood double, mean_log_likelihood double"
_BLOCK = 1 << 14
#: Distinct words that a task holds before it hands their counts on.
_HELD = 1 << 21


def forms(w: Words) -> np.ndarray:
    """Each word's form, from its last three bytes."""
    size = w.ends - w.starts
    tail = w.data[w.ends - 1].astype(U64)
    for k in (2, 3):
        tail |= np.where(size >= k, w.data[np.maximum(w.ends - k, 0)], 0).astype(U64) << U64(8 * k - 8)
    return (mix(tail + U64(1)) % U64(FORMS)).astype(np.int64)


@dataclass
class Vocabulary:
    words: np.ndarray  # signed hashes of the known words, ascending
    leaf: np.ndarray  # uint16
    log_share: np.ndarray  # log p(word | leaf)
    log_form: np.ndarray  # log of the number of words of each form
    log_class: np.ndarray
    log_slot: np.ndarray  # log p(leaf | class), CLASSES by WIDTH


def vocabulary(word: np.ndarray, form: np.ndarray, n: np.ndarray, form_total: np.ndarray) -> Vocabulary:
    """From the known words with their counts, and the counts of all words of each form."""
    order = np.argsort(word)
    word, form, n = word[order], form[order], n[order]
    top = np.lexsort((word, -n))[:OWN]
    leaf = OWN + form
    leaf[top] = np.arange(len(top))
    rest = form_total.astype(float)
    np.subtract.at(rest, form[top], n[top])
    log_form = np.log(rest + 1)
    share = np.log(n) - log_form[form]
    share[top] = 0
    mass = np.zeros(LEAVES)
    mass[: len(top)], mass[OWN:] = n[top], rest
    mass = (mass + 0.01).reshape(CLASSES, WIDTH)
    of_class = mass.sum(1, keepdims=True)
    return Vocabulary(word, leaf.astype(np.uint16), share, log_form, np.log(of_class / of_class.sum())[:, 0], np.log(mass / of_class))


class Network:
    """Weights as one float32 vector, so that they can be averaged."""

    SHAPES = ((LEAVES + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, WIDTH), (CLASSES, WIDTH))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.parts = self.views(self.flat)

    @classmethod
    def views(cls, flat: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, cuts), cls.SHAPES)]

    @classmethod
    def fresh(cls, vocab: Vocabulary, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE))
        e, w, _, v, b, u, c = net.parts
        e[:] = r.normal(0, 0.3, e.shape)
        w[:] = r.normal(0, 1 / np.sqrt(len(w)), w.shape)
        v[:], u[:] = r.normal(0, 0.02, v.shape), r.normal(0, 0.02, u.shape)
        b[:], c[:] = vocab.log_class, vocab.log_slot
        return net

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.parts[0][around].reshape(len(around), -1)
        return x, np.tanh(x @ self.parts[1] + self.parts[2])

    def log_p(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log p(leaf | context); the logits stay small, so no maximum is taken off."""
        order = np.argsort(leaf, kind="stable")
        _, h = self.hidden(around[order])
        of, slot = np.divmod(leaf[order].astype(np.int64), WIDTH)
        *_, v, b, u, c = self.parts
        z = h @ v
        z += b
        got = z[np.arange(len(z)), of]
        np.exp(z, out=z)
        got -= np.log(z.sum(1))
        for k, i, j in _segments(of):
            z = h[i:j] @ u[k]
            z += c[k]
            got[i:j] += z[np.arange(j - i), slot[i:j]]
            np.exp(z, out=z)
            got[i:j] -= np.log(z.sum(1))
        out = np.empty(len(got), np.float64)
        out[order] = got
        return out

    def train(self, around: np.ndarray, leaf: np.ndarray, state: np.ndarray, rate: float = RATE) -> None:
        """One AdaGrad step."""
        order = np.argsort(leaf, kind="stable")
        around = around[order]
        of, slot = np.divmod(leaf[order].astype(np.int64), WIDTH)
        e, w, _, v, b, u, c = self.parts
        g = np.zeros(self.SIZE, np.float32)
        ge, gw, gh, gv, gb, gu, gc = self.views(g)
        n = np.float32(1 / len(of))
        x, h = self.hidden(around)
        z = h @ v
        z += b
        p = _off(z, of, n)
        back = p @ v.T
        for k, i, j in _segments(of):
            z = h[i:j] @ u[k]
            z += c[k]
            d = _off(z, slot[i:j], n)
            back[i:j] += d @ u[k].T
            np.matmul(h[i:j].T, d, out=gu[k])
            d.sum(0, out=gc[k])
        back *= 1 - h * h
        at = around.astype(np.int64).reshape(-1, 1) * EMBED + np.arange(EMBED)
        ge.ravel()[:] = np.bincount(at.ravel(), (back @ w.T).ravel(), e.size)
        np.matmul(x.T, back, out=gw)
        back.sum(0, out=gh)
        np.matmul(h.T, p, out=gv)
        p.sum(0, out=gb)
        state += g * g
        g *= rate
        root = np.sqrt(state)
        root += 1e-4
        g /= root
        self.flat -= g


def _segments(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of an ascending array's runs."""
    cut = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
    return [(int(of[i]), i, j) for i, j in zip(cut, cut[1:])]


def _off(z: np.ndarray, target: np.ndarray, n: np.float32) -> np.ndarray:
    """Softmax, less one at the target, times n; in place.  The bound only keeps a runaway weight finite."""
    np.minimum(z, 80, out=z)
    np.exp(z, out=z)
    z *= n / z.sum(1, keepdims=True)
    z[np.arange(len(z)), target] -= n
    return z


def contexts(w: Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, log p(word | leaf) without the counts of unknown words, whether unknown, and the leaves around, of each word."""
    h, form = signed(w.hashes), forms(w)
    at = np.minimum(np.searchsorted(vocab.words, h), max(len(vocab.words) - 1, 0))
    known = vocab.words[at] == h if len(vocab.words) else np.zeros(len(h), bool)
    leaf = (OWN + form).astype(np.uint16)
    leaf[known] = vocab.leaf[at[known]]
    share = -vocab.log_form[form]
    share[known] = vocab.log_share[at[known]]
    n = len(leaf)
    pos = np.arange(n) - np.repeat(w.first[:-1], w.counts)
    left = np.repeat(w.counts, w.counts) - pos
    pad = np.concatenate([np.full(SIDE, LEAVES, np.uint16), leaf, np.full(SIDE, LEAVES, np.uint16)])
    around = np.empty((n, 2 * SIDE), np.uint16)
    for d in range(1, SIDE + 1):
        around[:, SIDE - d] = np.where(pos >= d, pad[SIDE - d : SIDE - d + n], LEAVES)
        around[:, SIDE + d - 1] = np.where(left > d, pad[SIDE + d : SIDE + d + n], LEAVES)
    return leaf, share, ~known, around


def count_words(docs: DataFrame) -> DataFrame:
    """(word, form, n) of all distinct words."""

    def add(parts):
        word, form, n = (np.concatenate(x) for x in zip(*parts))
        distinct, first, which = np.unique(word, return_index=True, return_inverse=True)
        return distinct, form[first], np.bincount(which, n).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for b in slices(batches):
            w = words(b.column("text"))
            distinct, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            parts.append((signed(distinct), forms(w)[first], n))
            held += len(distinct)
            if held > _HELD:
                parts = [add(parts)]
                held = len(parts[0][0])
                if held > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["word", "form", "n"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in add(parts)], names=["word", "form", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, form bigint, n bigint").groupBy("word", "form").agg(F.sum("n").alias("n"))


def masked(w: Words, around: np.ndarray, turn: int, rounds: int = ROUNDS) -> np.ndarray:
    """The words that are masked for training in this round, by hash of the place in the text and the neighbours; each word is in one of the rounds."""
    pos = (np.arange(len(around)) - np.repeat(w.first[:-1], w.counts)).astype(U64)
    near = np.zeros(len(around), U64)
    for j in range(around.shape[1]):
        near = near * U64(1_000_003) + around[:, j].astype(U64)
    return np.flatnonzero(mix(near + mix(pos)) % U64(rounds) == U64(turn))


def _train(docs: DataFrame, vocab: Vocabulary, net: Network, turn: int, rounds: int) -> Network:
    given = docs.sparkSession.sparkContext.broadcast((vocab, net.flat))

    def run(batches):
        vocab, flat = given.value
        net, state, seen = Network(flat.copy()), np.zeros(Network.SIZE, np.float32), 0
        for b in slices(batches):
            w = words(b.column("text"))
            leaf, _, _, around = contexts(w, vocab)
            some = masked(w, around, turn, rounds)
            step = min(BATCH, max(256, len(some) // 8))
            for i in range(0, len(some), step):
                at = some[i : i + step]
                net.train(around[at], leaf[at], state)
            seen += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([net.flat.tolist()], pa.list_(pa.float32()))], names=["seen", "weights"])

    rows = docs.select("text").mapInArrow(run, "seen bigint, weights array<float>").where("seen > 0")
    each = rows.select("seen", F.posexplode("weights").alias("i", "x"))
    mean = each.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).alias("x")).toPandas()
    if not len(mean):
        return net
    flat = np.zeros(Network.SIZE)
    flat[mean["i"].to_numpy()] = mean["x"].to_numpy()
    return Network(flat)


def _band() -> Column:
    return F.floor(F.log2("n") * 16)


def fit(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> tuple[Vocabulary, Network, DataFrame | None]:
    """The vocabulary, the network, and the counts of the words that are not broadcast, if there are any."""
    counts = materialize(count_words(docs), "word_counts")
    bands = counts.groupBy(_band().alias("band")).agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect()
    fits = np.cumsum([r["words"] for r in bands]) <= known
    least = min((r["band"] for r, ok in zip(bands, fits) if ok), default=1 << 20)
    total = counts.groupBy("form").agg(F.sum("n").alias("n")).toPandas()
    top = counts.where(_band() >= least).toPandas()
    form_total = np.zeros(FORMS, np.int64)
    form_total[total["form"].to_numpy()] = total["n"].to_numpy()
    vocab = vocabulary(*(top[c].to_numpy(np.int64) for c in ("word", "form", "n")), form_total)
    net = Network.fresh(vocab)
    for turn in range(rounds):
        net = _train(docs, vocab, net, turn, rounds)
    return vocab, net, None if all(fits) else counts.where(_band() < least).select("word", "n")


def log_likelihoods(texts: pa.Array, vocab: Vocabulary, net: Network) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """Number of words, and summed conditional log-probabilities but for the log counts of unknown words, of each text; the words, and which are unknown."""
    w = words(texts)
    leaf, lp, unknown, around = contexts(w, vocab)
    for i in range(0, len(leaf), _BLOCK):
        lp[i : i + _BLOCK] += net.log_p(around[i : i + _BLOCK], leaf[i : i + _BLOCK])
    return w.counts, np.bincount(w.doc_of(), lp, minlength=len(w.counts)), w, unknown


def score(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """Every document's pseudo-log-likelihood."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    vocab, net, rare = fit(docs, rounds, known)
    given = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches):
        vocab, net = given.value
        for b in slices(batches):
            n, s, w, unknown = log_likelihoods(b.column("text"), vocab, net)
            at = np.flatnonzero(unknown)
            cuts = pa.array(np.searchsorted(at, w.first), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s), pa.ListArray.from_arrays(cuts, pa.array(signed(w.hashes)[at]))], names=["doc_id", "n_words", "s", "rare"]
            )

    scored = docs.mapInArrow(run, "doc_id bigint, n_words bigint, s double, rare array<bigint>")
    whole = F.round("s", 6)
    if rare is not None:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        logs = scored.select("row", F.explode("rare").alias("word")).join(rare, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        scored = scored.join(logs, "row", "left")
        whole = F.round(F.col("s") + F.coalesce("more", F.lit(0.0)), 6)
    return scored.select("doc_id", "n_words", whole.alias("log_likelihood"), F.when(F.col("n_words") > 0, F.round(whole / F.col("n_words"), 9)).alias("mean_log_likelihood"))
