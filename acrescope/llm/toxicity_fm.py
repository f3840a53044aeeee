"""Toxicity: a factorization machine over hashed terms, with weights for terms and for their pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import free_prefix, small_batches, span_hash, text_slices, unique_in_docs, word_spans

BITS = 21
SAMPLE = 12_000  # labelled documents a model is fitted on, at most
LEAST = 2  # documents of the sample a term must be in to be learned
FACTORS = 8
# terms are runs of ASCII letters and digits and of all bytes of other characters
_EDGE = np.ones(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEMS = (4, 5, 6)  # bytes of a word that stand for its stem, so that endings do not hide it


def term_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row (words and stems of the lower-cased text), flat, and their bounds."""
    found, bounds = [], [np.zeros(1, np.int64)]
    for first, last, data, offsets in text_slices(pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))):
        starts, ends, before = word_spans(data, offsets, _EDGE)
        row = np.repeat(np.arange(last - first), np.diff(before))
        terms, rows = [span_hash(data, starts, ends)], [row]
        for size in _STEMS:
            long = ends - starts > size
            terms.append(span_hash(data, starts[long], ends[long], 1, size))
            rows.append(row[long])
        values = (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int32)
        values, cuts = unique_in_docs(values, np.concatenate(rows), last - first)
        found.append(values)
        bounds.append(cuts[1:] + bounds[-1][-1])
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(bounds)


@dataclass(frozen=True)
class FactorizationMachine:
    """score = sigmoid(bias + sum of w + sum over pairs of <v, v'>) of the known terms of a text."""

    place: np.ndarray  # [2 ** BITS] index of a term, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at = self.place[terms]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at >= 0]
        at = at[at >= 0]
        out = np.full(len(bounds) - 1, self.bias)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            v = self.v[at]
            pairs = np.add.reduceat(v, first, axis=0) ** 2 - np.add.reduceat(v * v, first, axis=0)
            out[row[first]] += np.add.reduceat(self.w[at], first) + pairs.sum(axis=1) / 2
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.clip(self.logits(*term_rows(texts)), -40, 40)
        return 1 / (1 + np.exp(-z))


def select_terms(terms: np.ndarray, bounds: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """All terms in ``least`` rows or more, whatever their labels; a term in one row tells nothing of another."""
    return np.flatnonzero(np.bincount(terms, minlength=1 << BITS) >= least)


def _shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def train(terms: np.ndarray, bounds: np.ndarray, label: np.ndarray, *, least: int = LEAST, factors: int = FACTORS, steps: int = 900, batch: int = 256,
          rate: float = 0.1, calm: tuple[float, float] = (1e-6, 1e-4), penalty: tuple[float, float] = (2.0, 3.0), knee: float = 0.1,
          dropout: float = 0.5, seed: int = 5) -> FactorizationMachine:
    """Minibatch AdaGrad on the logistic loss over sparse rows; without both labels the model is the smoothed share of label 1.

    All terms take part, with a weight and with factors, at work that grows with
    the terms of the rows. After a step, what is moved shrinks towards zero by
    ``penalty`` (weights, factors) times the standard error of a gradient that
    is chance alone, the less the larger it is (from ``knee`` on), so that a
    hundred thousand terms without a message add up to nothing; weights of terms
    that few steps move go further in each. A share of the
    terms is left out at random in each step, so that one telling term is enough
    where training texts mostly hold several.
    """
    label = label.astype(float)
    chosen = select_terms(terms, bounds, label, least) if 0 < label.sum() < len(label) else np.zeros(0, int)
    n, rows_all = len(chosen), len(label)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(n)
    share = (label.sum() + 0.5) / (rows_all + 1)
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n, np.float32), rng.normal(0, 0.01, (n, factors)).astype(np.float32)
    at = place[terms]
    begin = np.concatenate([[0], np.cumsum(at >= 0, dtype=np.int32 if len(at) < 1 << 31 else np.int64)])[bounds]
    at = at[at >= 0]
    df = np.bincount(at, minlength=n)
    met = 1 - (1 - np.minimum(df / max(rows_all, 1), 1) * (1 - dropout)) ** min(batch, max(rows_all, 1))  # chance that a step moves a term
    noise = (np.sqrt(np.minimum(df, rows_all - df + 1) * (1 - dropout) * share * (1 - share)) / max(rows_all, 1) / met).astype(np.float32)
    met = met.astype(np.float32)
    gb, gw, gv = calm[1], np.full(w.shape, calm[0], np.float32), np.full(v.shape, calm[1], np.float32)
    epochs = -(-steps * batch // max(rows_all, batch)) if n else 0
    left = np.linspace(1, 0, epochs * -(-rows_all // batch), endpoint=False)
    for step in range(len(left)):
        k = step % -(-rows_all // batch) * batch
        order = rng.permutation(rows_all) if k == 0 else order
        rows, pace = order[k:k + batch], rate * left[step]
        size = begin[rows + 1] - begin[rows]
        row = np.repeat(np.arange(len(rows)), size)
        idx = at[np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(len(row))]
        stay = rng.random(len(idx), np.float32) >= dropout
        idx, row = idx[stay], row[stay]
        z, xv = np.full(len(rows), bias), np.zeros((len(rows), factors), np.float32)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            some, own = row[first], v[idx]
            xv[some] = np.add.reduceat(own, first, axis=0)
            z[some] += np.add.reduceat(w[idx], first) + ((xv[some] ** 2).sum(1) - np.add.reduceat((own * own).sum(1), first)) / 2
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) / len(rows)
        moved = np.flatnonzero(np.bincount(idx, minlength=n))
        dw = np.bincount(idx, err[row], n)[moved]
        wm, vm = w[moved], v[moved]
        dv = np.stack([np.bincount(idx, (err * xv[:, f])[row], n)[moved] for f in range(factors)], 1) - dw[:, None] * vm
        db = err.sum()
        gb += db * db
        bias -= pace * db / gb ** 0.5
        gw[moved] += dw * dw
        gv[moved] += dv * dv
        fw, fv = pace / np.sqrt(gw[moved] * met[moved]), pace / np.sqrt(gv[moved])
        w[moved] = _shrink(wm - fw * dw, fw * penalty[0] * noise[moved] / (1 + np.abs(wm) / knee))
        v[moved] = _shrink(vm - fv * dv, fv * penalty[1] * noise[moved, None] * np.sqrt((xv ** 2).mean(0)) / (1 + np.abs(vm) / knee))
    some = np.flatnonzero((w != 0) | (v != 0).any(axis=1))  # the others add nothing to any score
    place[chosen] = -1
    place[chosen[some]] = np.arange(len(some))
    return FactorizationMachine(place, bias, w[some], v[some])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        terms, bounds = term_rows(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(terms, pa.int32()))],
                                         names=["doc_id", "label", "terms"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: bias, the learned terms, their weights and factors."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    found = pa.Table.from_batches(held)
    del held
    found = found.take(pa.array(np.argsort(found.column("doc_id").to_numpy(), kind="stable")))  # the fit does not depend on the order of files
    size = pc.list_value_length(found.column("terms")).to_numpy()
    terms, label = pc.list_flatten(found.column("terms")).to_numpy(), found.column("label").to_numpy()
    del found
    model = train(terms, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), label)
    learned = np.flatnonzero(model.place >= 0)
    at = model.place[learned]
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), one(learned.astype(np.int32), pa.int32()), one(model.w[at], pa.float32()), one(model.v[at].ravel(), pa.float32())],
                                     names=["bias", "terms", "w", "v"])


def sampled(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """doc_id, text and label of the sample: one row per id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id")  # at most ``sample`` ids
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on at most ``sample`` labelled documents, those with the smallest hashes of their ids.

    Only the ids and labels of the sample are broadcast, so other texts stay where they are;
    the sample's hashed terms meet in one task, which fits, and the driver gets the learned
    terms alone. Null labels and ids do not
    count; an id with several labels counts as 1 if one of them is, one with
    several texts has that of the smallest hash. Without any labelled document all scores are one half.
    """
    rows = sampled(docs, labels, doc_id=doc_id, text=text, label=label, sample=sample)
    terms = rows.mapInArrow(_terms, "doc_id long, label double, terms array<int>").repartition(1)  # bounded by ``sample``
    found = terms.mapInArrow(_fit, "bias double, terms array<int>, w array<float>, v array<float>").toArrow()
    if not found.num_rows:
        return train(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))
    flat = lambda c: pc.list_flatten(found.column(c)).to_numpy()
    learned, place = flat("terms"), np.full(1 << BITS, -1, np.int32)
    place[learned] = np.arange(len(learned))
    return FactorizationMachine(place, found.column("bias")[0].as_py(), flat("w"), flat("v").reshape(len(learned), -1) if len(learned) else np.zeros((0, FACTORS), np.float32))


def score(docs: DataFrame, model: FactorizationMachine, *, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; null and empty texts get the model's score of no terms. Rows and columns stay."""
    names = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared.value.score(batch.column(text)), pa.float64())], names=[*names, into])

    return docs.select(*names).mapInArrow(run, docs.select(*names, F.lit(0.0).alias(into)).schema)


def drop_toxic(docs: DataFrame, model: FactorizationMachine, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, columns as they were, whatever their names."""
    into = free_prefix(docs.columns, "_toxicity")
    return score(docs, model, text=text, into=into).where(F.col(into) < threshold).drop(into)
