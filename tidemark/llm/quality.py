"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words and triples of character classes, hashed, so that they show what it's about and its make-up,
and two for repetition. A truncated singular value decomposition of the weighted terms of a bounded sample of labelled
texts gives the space; every text is projected into it, its exact cosines with all sampled texts are computed in blocks,
and the nearest ones' labels are averaged, weighted by similarity. Weights, axes and vectors are whole numbers whose
products stay exact, so that a score doesn't depend on the batch that a text is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import sha256
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, small_batches, utf8

#: Labelled texts that the space is fitted to and that vote: the bound of what is gathered and broadcast.
SAMPLE = 4_000

#: Hashed terms of either kind, dimensions of the space, neighbours that vote, power of the cosine that a vote weighs.
TERMS, DIMS, NEIGHBOURS, POWER = 2_048, 48, 25, 16

#: A score from which a text counts as good.
THRESHOLD = 0.7

_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
#: Per byte: space, other white space and controls, lower, upper, digit, beyond ASCII, and each mark by itself.
_CLASS = np.array(
    [0 if b == 32 else 1 if b < 33 or b == 127 else 5 if b > 127 else 4 if 48 <= b <= 57 else 3 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 6 + _MARKS.index(b) for b in range(256)],
    dtype=np.uint32,
)
_CLASSES = 6 + len(_MARKS)

#: Bytes counted at a time, which bounds a very long text's memory.
BLOCK = 1_000_000

#: Texts weighted and compared at a time, which bounds the memory for their terms' weights and their cosines.
ROWS = 100


#: Per byte: a factor, so that a word's hash is a sum over its bytes and places; its letters count in lower case.
_LETTER = np.array([(b + 32 if 65 <= b <= 90 else b) * 2654435761 % 2**32 | 1 for b in range(256)], dtype=np.uint32)


def _hashed(values: np.ndarray) -> np.ndarray:
    """Counts of values by a hash of theirs."""
    return np.bincount((values ^ values >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(33 - TERMS.bit_length()), minlength=TERMS)


def _words(raw: np.ndarray) -> np.ndarray:
    """A hash of each word: what stands between white space."""
    inside = raw > 32
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    at = np.arange(len(raw), dtype=np.uint32)
    first = np.zeros(len(raw), dtype=np.uint32)
    first[starts] = starts
    place = at - np.maximum.accumulate(first)
    return np.add.reduceat(np.where(inside, _LETTER[raw] * (place * np.uint32(0x9E3779B1) + np.uint32(1)), np.uint32(0)), starts, dtype=np.uint32)


def terms(text: bytes) -> np.ndarray:
    """Counts of the hashed triples, then of the words; the last two: bytes of words like the one before, of repeated lines."""
    counts = np.zeros(2 * TERMS + 2, dtype=np.float32)
    raw = np.frombuffer(text, dtype=np.uint8)
    for k in range(0, len(raw), BLOCK):
        x = _CLASS[raw[k : k + BLOCK + 2]]
        code = (x[:-2] * np.uint32(_CLASSES) + x[1:-1]) * np.uint32(_CLASSES) + x[2:]
        counts[:TERMS] += _hashed(code)
        counts[TERMS:-2] += _hashed(_words(raw[k : k + BLOCK]))
    tokens, rows = text.split(), text.split(b"\n")
    counts[-2] = sum(map(eq, tokens, tokens[1:])) * len(text) / max(1, len(tokens))
    counts[-1] = sum(map(len, rows)) - sum(map(len, set(rows)))
    return counts


#: Steps of a unit of weights and axes, and of vectors: sums of products of whole numbers stay below 2^53 and so are
#: exact, in whichever order they're added up. A cosine and its text's number share one of 53 bits.
STEP, FINE, MOST_SAMPLE = 1 << 16, 1 << 19, 1 << 14


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in whole steps."""
        x = np.empty((len(counts), self.space.shape[1]))
        for k in range(0, len(counts), ROWS):
            x[k : k + ROWS] = np.rint(_weighted(counts[k : k + ROWS], self.weight) * STEP) @ self.space
        return np.rint(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9) * FINE)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest texts; the share of all where there's no vector to compare. Of equally
        near texts those first in the sample count."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        k, last = min(NEIGHBOURS, len(self.labels)), len(self.labels) - 1
        # One number for cosine and place, so that no two are alike.
        ranked = self.project(counts) @ self.vectors.T * MOST_SAMPLE + np.arange(last, -1, -1)
        ranked = np.sort(np.partition(ranked, last - k + 1, axis=1)[:, last - k + 1 :], axis=1)
        near = last - np.mod(ranked, MOST_SAMPLE).astype(int)
        votes = np.maximum(np.floor(ranked / MOST_SAMPLE) / FINE**2, 0) ** POWER
        total = votes.sum(axis=1)
        shares = (votes * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.round(np.where(total > 0, shares, self.labels.mean()), 6)


def _weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, dtype=float, keepdims=True), 1)) * weight


def latent(counts: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    """Fits the space to counts. Equal texts vote as one, by the mean of their labels."""
    seen: dict[bytes, int] = {}
    place = np.array([seen.setdefault(sha256(row.tobytes()).digest(), len(seen)) for row in counts], dtype=int)
    if len(seen) < len(counts):
        counts = counts[np.unique(place, return_index=True)[1]]
    labels = np.bincount(place, labels) / np.maximum(np.bincount(place), 1) if len(labels) else labels
    weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    if len(counts) > MOST_SAMPLE:
        raise ValueError(f"a sample has {MOST_SAMPLE} texts at most")
    x = np.empty(counts.shape, dtype=np.float32)
    for k in range(0, len(counts), ROWS):
        x[k : k + ROWS] = _weighted(counts[k : k + ROWS], weight)
    guess = np.random.Generator(np.random.PCG64(11)).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    basis = np.linalg.qr(x @ guess)[0]
    for _ in range(3):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    space = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:dims].T
    empty = Model(weight, np.rint(space.astype(float) * STEP), np.empty((0, 0)), labels)
    return replace(empty, vectors=empty.project(counts))


def held_out(doc_id: Column) -> Column:
    """By the id's text; a null id isn't held out, and teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """From at most sample labelled documents, those first by their id's hash, none held out.

    A document's label is the mean of its labels, null ones aside; of several texts under one id the least counts. What
    is gathered is bounded by sample, MOST_SAMPLE at most. No labelled documents give a model that scores 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.avg("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    met = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(known), "id")  # sample rows at most
    met = met.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def make():  # noqa: ANN202
        def row(i: int, text: bytes, label: float) -> tuple:
            counts = terms(text)
            at = np.flatnonzero(counts)
            return i, label, at.astype("<u2").tobytes(), counts[at].astype("<f4").tobytes()

        return row

    rows = sorted(map_rows(met.select(F.col("id").cast("long"), "text", "label"), make, "id long, label double, at binary, n binary").collect())
    counts = np.zeros((len(rows), 2 * TERMS + 2), dtype=np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r["at"], dtype="<u2")] = np.frombuffer(r["n"], dtype="<f4")
    return latent(counts, np.array([r["label"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), and the columns to keep, a row for each row.

    Null and empty texts have no term: their score is the mean label. Of equally near sampled texts the first
    ones vote. Repeated rows stay repeated and score alike;
    no rows give no rows. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("_text"), *keep)
    kinds = ", ".join(f"{k} {t}" for k, t in rows.drop("_text").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = np.empty(len(texts))
            for k in range(0, len(texts), ROWS):
                scores[k : k + ROWS] = sent.value.scores(np.array([terms(t) for t in texts[k : k + ROWS]]))
            cols = [batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *keep, "score"])

    return small_batches(rows).mapInArrow(run, f"{kinds}, score double")
