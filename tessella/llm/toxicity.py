"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is p = sigmoid(b + sum of the
weights of its words' features); the document's is the noisy-or 1 - prod(1 - p). Only
document labels train it: with S = sum softplus(z_s), the loss of a clean document
is S and of a toxic one -log(1 - exp(-S)). The sentences with p >= 0.5 are the offending ones.

A bag is a set: sentences with the same evidence (the same features, as often) are one instance, in training
and in scores alike, and so are all those without any. What a document repeats is no further evidence, and its
length alone adds none.

Features of a word, without signs at its ends and with A-Z lower-cased: itself and its
first 4, 5 and 6 bytes. Of these the training keeps those in at least ``MIN_DOCS`` sampled
documents that lean to toxic documents by ``MIN_Z`` standard errors (at most ``MOST_FEATURES``).

A sentence ends at a word that ends in . ! or ?, at a line break, and after ``LONGEST``
words. Training reads the whole texts of at most about ``PER_CLASS`` documents of each label:
a bounded, documented sample. Scores read whole texts and nothing else.

Cases: null, empty and blank texts have no sentence and score 0; without labels of
both kinds every score is 0; rows that share a doc_id are scored each by its own
text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import training_sample
from .langid import held_out
from .storage import document_batches, lean
from .textkernel import Scan, as_bytes, mix, slices

PER_CLASS = 2000
MIN_DOCS = 4
MIN_Z = 3.0
MOST_FEATURES = 20_000
LONGEST = 64
EPOCHS = 200
PREFIXES = (4, 5, 6)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(scan: Scan) -> np.ndarray:
    """First word of every sentence of all texts, in order."""
    n = len(scan.start)
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[1:] = _END[scan.buf[scan.end[:-1] - 1]]
    lines = np.flatnonzero(scan.buf == 10)
    new[np.searchsorted(scan.start, lines)[np.searchsorted(scan.start, lines) < n]] = True
    new[scan.first[:-1][scan.first[:-1] < n]] = True
    begin = np.flatnonzero(new)
    new[np.arange(n)[(np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))) % LONGEST == 0]] = True
    return np.flatnonzero(new)


def features(scan: Scan) -> np.ndarray:
    """Feature keys of every word: (1 + len(PREFIXES), words). Keys are even; 0 is none."""
    s, e = scan.cores()
    out = scan.hashes(s, [e, *(np.minimum(e, s + p) for p in PREFIXES)])
    with np.errstate(over="ignore"):
        for i, p in enumerate(PREFIXES, 1):
            out[i] = np.where(e - s >= p, out[i] * np.uint64(2 * i + 1), np.uint64(0))
    return np.stack(out) & ~np.uint64(1)


def _bags(texts: list[bytes]):
    """Slices of texts as (first text, texts, scan, feature keys, sentence begins)."""
    for lo, hi in slices(texts):
        scan = Scan(texts[lo:hi])
        yield lo, hi, scan, features(scan), sentences(scan)


def distinct(bag: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The first sentence of each kind of evidence in each bag."""
    order = np.lexsort((evidence, bag))
    b, e = bag[order], evidence[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (e[1:] != e[:-1])
    return np.sort(order[new])


def train(sample: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """Fit on (text, toxic) pairs; ``counts`` are the labels' true frequencies."""
    texts, y = as_bytes([t for t, _ in sample]), np.array([v for _, v in sample])
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    if len(y) == 0 or y.min() == y.max():
        return none
    seen = []
    for lo, _, scan, keys, _ in _bags(texts):
        doc = lo + np.repeat(np.arange(len(scan.first) - 1), np.diff(scan.first))
        for row in keys:
            with np.errstate(over="ignore"):
                once = np.unique(mix(row ^ (doc + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            seen.append(row[once] | y[doc[once]].astype(np.uint64))  # the free bit holds the label
    flat = np.concatenate(seen)
    del seen
    flat.sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] >> np.uint64(1) != flat[:-1] >> np.uint64(1)
    begin = np.flatnonzero(new)
    key = flat[begin] & ~np.uint64(1)
    a = np.add.reduceat((flat & np.uint64(1)).astype(np.int32), begin).astype(float) if len(begin) else np.zeros(0)
    b = np.diff(np.append(begin, len(flat))) - a
    del flat, new
    na, nb = float(y.sum()), float((1 - y).sum())
    pool = np.minimum(1.0, (a + b) / (na + nb))  # key 0 stands for several features
    z = (a / na - b / nb) / np.sqrt(pool * (1 - pool) * (1 / na + 1 / nb) + 1e-12)
    fit = np.flatnonzero((a + b >= MIN_DOCS) & (z >= MIN_Z) & (key != 0))
    fit = np.sort(fit[np.argsort(-z[fit], kind="stable")[:MOST_FEATURES]])
    keys = key[fit]
    if not len(keys):
        return none

    owner, feature, bag_of = [], [], []
    total = 0
    for lo, _, scan, rows, begin in _bags(texts):  # again, so that only one slice is held
        sentence = np.searchsorted(begin, np.arange(rows.shape[1]), side="right") - 1
        for row in rows:
            at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == row)
            owner.append(total + sentence[hit])
            feature.append(at[hit])
        bag_of.append(lo + np.searchsorted(scan.first, begin, side="right") - 1)
        total += len(begin)
    owner, feature, bag_of = map(np.concatenate, (owner, feature, bag_of))
    # Sentences without a kept feature all have z = b: one instance, where a bag has any.
    live, owner = np.unique(owner, return_inverse=True)
    plain = (np.bincount(bag_of, minlength=len(y)) > np.bincount(bag_of[live], minlength=len(y))).astype(float)
    bag_of = bag_of[live]
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    with np.errstate(over="ignore"):
        evidence = np.add.reduceat(mix(keys[feature]), np.flatnonzero(np.diff(owner, prepend=-1))) if len(owner) else np.zeros(0, np.uint64)
    once = distinct(bag_of, evidence)
    number = np.full(len(live), -1)
    number[once] = np.arange(len(once))
    kept = number[owner] >= 0
    live, owner, feature, bag_of = live[once], number[owner[kept]], feature[kept], bag_of[once]
    weight = np.where(y == 1, counts[1] / na, counts[0] / nb)
    weight /= weight.mean()
    w, bias = np.zeros(len(keys)), -5.0
    m = [np.zeros(len(keys) + 1) for _ in range(2)]
    for epoch in range(1, EPOCHS + 1):
        zs = bias + np.bincount(owner, w[feature], len(live))
        p, soft, p0, soft0 = 1 / (1 + np.exp(-zs)), np.logaddexp(0, zs), 1 / (1 + np.exp(-bias)), np.logaddexp(0, bias)
        s = np.bincount(bag_of, soft, len(y)) + plain * soft0
        pull = np.where(y == 1, -1 / np.expm1(np.clip(s, 1e-9, 700.0)), 1.0) * weight
        gz = p * pull[bag_of]
        g = np.append(np.bincount(feature, gz[owner], len(keys)) + 0.05 * w, gz.sum() + (plain * p0 * pull).sum())
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        step = 0.1 * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.99**epoch)) + 1e-8)
        w, bias = np.maximum(w - step[:-1], 0.0), min(bias - step[-1], -3.0)
    return Model(keys, w, float(bias))


def sentence_scores(model: Model, texts: list[bytes]):
    """For slices of texts: first text, scan, sentence begins, texts of the sentences, z scores, hashes of their evidence."""
    for lo, _, scan, rows, begin in _bags(texts):
        total, evidence = np.zeros(rows.shape[1]), np.zeros(rows.shape[1], np.uint64)
        if len(model.keys):
            for row in rows:
                at = np.minimum(np.searchsorted(model.keys, row), len(model.keys) - 1)
                hit = np.flatnonzero(model.keys[at] == row)
                total[hit] += model.weights[at[hit]]
                with np.errstate(over="ignore"):
                    evidence[hit] += mix(row[hit])
        with np.errstate(over="ignore"):
            z, evidence = (np.add.reduceat(v, begin) if len(begin) else v[:0] for v in (total, evidence))
        yield lo, scan, begin, np.searchsorted(scan.first, begin, side="right") - 1, model.bias + z, evidence


def score(model: Model, texts: list[bytes], spans: bool = True):
    """Each text's score and its offending sentences (start, end in characters, score)."""
    out, found = np.zeros(len(texts)), [[] for _ in texts]
    for lo, scan, begin, owner, z, evidence in sentence_scores(model, texts):
        docs = len(scan.first) - 1
        once = distinct(owner, evidence)
        s = np.bincount(owner[once], np.logaddexp(0, z[once]), docs)
        out[lo : lo + docs] = -np.expm1(-s) if len(model.keys) else 0.0
        hits = np.flatnonzero(z >= 0) if spans else ()
        if len(hits):
            # Characters begin at all bytes but UTF-8's continuations: one count serves every span of the slice.
            chars = np.concatenate([[0], np.cumsum((scan.buf & 0xC0) != 0x80)])
            stop = np.append(begin[1:], len(scan.start)) - 1
            d = owner[hits]
            origin = chars[scan.base[d]]
            heads, tails = chars[scan.start[begin[hits]]] - origin, chars[scan.end[stop[hits]]] - origin
            for row in zip(d.tolist(), heads.tolist(), tails.tolist(), (1 / (1 + np.exp(-z[hits]))).tolist(), strict=True):
                found[lo + row[0]].append(row[1:])
    return out, found


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_offending int, offending array<struct<start:int,stop:int,score:double>>"


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*training_sample(docs, labels, "toxic", per_class))


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row (doc_id, text)."""
    document_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            p, spans = score(held.value, as_bytes(batch.column(2).to_pylist()))
            spans = [[{"start": a, "stop": b, "score": c} for a, b, c in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(list(map(len, spans)), pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "held_out", "score", "predicted", "n_offending", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    document_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p, _ = score(held.value, as_bytes(batch.column(at).to_pylist()), spans=False)
            yield batch.filter(pa.array(p < threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
