"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import small_batches, text_slices

BUCKETS = 1 << 15
MAX_LANGS = 512  # the model is BUCKETS x languages and is broadcast
UNDETERMINED = "und"
CELLS = 1 << 21  # log-probabilities a task gathers at once
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """2 for letters, 1 for the marks that go with them, 0 for all else."""
    if not _kinds:
        _kinds.append(np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


def gram_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, buckets, row of each, whether its middle is a letter) of the 1-, 2- and 3-grams of lower-cased letters, their marks and word edges."""
    kind = _kind()
    for first, last, data, offsets in text_slices(pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))):
        raw = data.tobytes()
        text = "\n".join([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        c = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32)
        width = np.array([len(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) if last - first > 1 else np.array([len(c) - 2])
        row = np.repeat(np.arange(first, last), width + 1)  # with the separator after each row
        kinds = kind[c]
        inside = kinds > 0
        c = np.where(inside, c, 0)
        mid = np.flatnonzero(inside[1:-1]) + 1
        a, b, d = c[mid - 1], c[mid], c[mid + 1]
        at = row[mid - 1]
        one = b * np.uint32(0x9E3779B1)
        two = (a * np.uint32(0x85EBCA77)) ^ one
        three = (two * np.uint32(0xC2B2AE3D)) ^ (d * np.uint32(0x27D4EB2F))
        yield first, last, np.stack([(h ^ h >> np.uint32(15)) * np.uint32(0x165667B1) >> np.uint32(32 - 15) for h in (one + np.uint32(1), two + np.uint32(2), three + np.uint32(3))]), at, kinds[mid] == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in small_batches(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for _, _, grams, row, _ in gram_slices(batch.column("text")):
            names = langs[row]
            for lang in set(names):
                pick = names == lang
                found = np.bincount(grams[:, pick].ravel(), minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + found
    for lang, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities [bucket, language] and log-priors; no languages if nothing was learned."""

    langs: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; ``und`` and 0 for one without a letter (marks alone are none)."""
        n, k = len(texts), len(self.langs)
        if not k:
            return [UNDETERMINED] * n, np.zeros(n)
        score, seen = np.zeros((n, k)), np.zeros(n, np.int64)
        step = max(1, CELLS // k)
        for first, last, grams, row, real in gram_slices(texts):
            seen[first:last] = np.bincount(row[real] - first, minlength=last - first)
            # rows of a sparse count matrix times the weights: gathered and summed by row, a bounded number at a time
            for at in range(0, len(row), step):
                part = row[at:at + step]
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                for g in grams[:, at:at + step]:
                    score[part[begin]] += np.add.reduceat(self.weight[g], begin, axis=0, dtype=np.float64)
        score += self.prior
        best = score.argmax(axis=1)
        share = 1 / np.exp(np.minimum(score - score.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, seen)], np.where(seen > 0, share, 0.0)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", alpha: float = 0.5) -> LanguageModel:
    """Count all given rows with a language; ties between languages go to the first by name.

    The counts are summed per task before the shuffle. BUCKETS rows per
    language reach the driver; more than MAX_LANGS languages are an error.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    priors = rows.groupBy("lang").count().limit(MAX_LANGS + 1).toPandas()
    if len(priors) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(priors["lang"])
    count = np.zeros((BUCKETS, len(langs)))
    found = sums.toArrow()
    count[found.column("bucket").to_numpy(), np.searchsorted(langs, found.column("lang").to_pylist())] = found.column("n").to_numpy() if len(langs) else 0
    weight = np.log(count + alpha) - np.log((count + alpha).sum(axis=0, keepdims=True)) if langs else count
    prior = priors.set_index("lang")["count"].reindex(langs).to_numpy(dtype=float)
    return LanguageModel(langs, np.log(prior / prior.sum()) if langs else prior, weight.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The documents without their text, with lang_pred and score; null texts and texts without a letter are ``und`` with score 0."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, score = shared.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
