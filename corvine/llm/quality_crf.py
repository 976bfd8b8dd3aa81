"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line, the line before and the line after it:
length, words and their lengths, shares of upper case, digits, symbols and non-ASCII bytes, repeated
words, sentence ends, whether it repeats its neighbour. The chain's weights are fitted by gradient
ascent on the conditional likelihood, every line of a labelled document carrying its label. A
document's quality is the mean of its lines' forward-backward marginals of `good`, weighed by their
lengths, on a scale whose cut between labels, as fitted, is THRESHOLD.

The model is fitted on the driver on a bounded sample: about SAMPLE_ROWS labelled documents chosen
by a hash of their doc_id; of a document of more than FIT_LINES lines, a run of FIT_LINES lines whose
place is drawn from the document's own hash. The model is some hundred numbers. Both labels weigh the
same, however often they occur, in the features' weights and in the moves' alike.
Features, sums and marginals of all texts are computed in NumPy, all documents of a batch at once.

Cases: a null text counts as empty, which is one line of length 0, weighed as length 1; of several
labels of a document the best counts; with no labels, or one kind of label, to learn from, all
documents score that label's 0 or 1 (1 if none); repeated rows are scored one by one; a text of any
length is scored whole; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import in_python, table

SAMPLE_ROWS = 4_000
FIT_LINES = 200
THRESHOLD = 0.7
#: Bytes of text whose chains are run together.
SCORED = 1 << 20
STEPS = 150
RATE = 0.08
RIDGE = 1e-4

_KINDS = np.zeros((5, 256), dtype=bool)
_KINDS[0, 65:91] = True  # upper case
_KINDS[1, 97:123] = True  # lower case
_KINDS[2, 48:58] = True  # digits
_KINDS[3, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True  # symbols
_KINDS[4, 128:] = True  # not ASCII
N_OWN = 15


def own_features(piece: bs.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines by themselves, their lengths, and the first line of each text."""
    data, offsets = piece.data, piece.offsets
    breaks = np.flatnonzero(data == 10)
    # A line starts where a text starts and after each line break; texts may be empty.
    start = np.concatenate((offsets[:-1], breaks + 1))
    owner = np.concatenate((np.arange(len(piece)), np.searchsorted(offsets, breaks, side="right") - 1))
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(piece) + 1))
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, dtype=bool)
    end = np.where(last, offsets[owner + 1], np.append(start[1:], 0) - 1)
    size = end - start

    def inside(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return (sums[end] - sums[start]).astype(float)

    w = bs.words(piece)
    begins = np.zeros(len(data) + 1, dtype=np.int64)
    begins[w.start] = 1
    again, table_like = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    if len(w.start):
        same = np.concatenate(([False], w.hash[1:] == w.hash[:-1]))
        same[w.of[:-1][w.counts > 0]] = False
        again[w.start[same]] = True
        table_like[w.start[(w.end - w.start == 1) & _KINDS[3][data[w.start]]]] = True
    kinds = [inside(k[data]) for k in _KINDS]
    n_words, n_again, n_marks, ends = inside(begins[:-1] > 0), inside(again), inside(table_like), inside((data == 46) | (data == 63) | (data == 44))
    length, letters = np.maximum(size, 1), np.maximum(kinds[0] + kinds[1] + kinds[4], 1)
    hashes = bs.BYTES.of(data, start, end)
    twin = np.zeros(len(start), dtype=bool)
    if len(start) > 1:
        twin[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    words = np.maximum(n_words, 1)
    own = np.stack(
        [
            np.log1p(size) / 5,
            np.log1p(n_words) / 4,
            np.minimum(size / words, 30) / 10,
            kinds[0] / letters,
            kinds[2] / length * 3,
            kinds[3] / length * 5,
            kinds[3] / words,
            kinds[4] / length,
            n_again / words,
            n_marks / words * 2,
            ends / words,
            (kinds[0] > 0.6 * letters).astype(float),
            (n_again > 0.3 * words).astype(float),
            twin.astype(float),
            (size == 0).astype(float),
        ],
        axis=1,
    )
    return own, np.maximum(size, 1), first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after in its text (0 where there is none), and a 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        follows = np.ones((len(own), 1), dtype=own.dtype)
        follows[first[:-1][np.diff(first) > 0]] = 0
        before[1:], after[:-1] = own[:-1] * follows[1:], own[1:] * follows[1:]
    return np.concatenate((own, before, after, np.ones((len(own), 1), dtype=own.dtype)), axis=1)


def line_features(piece: bs.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with their neighbours', their lengths, and the first line of each text."""
    own, size, first = own_features(piece)
    return with_neighbours(own, first), size, first


N_FEATURES = 3 * N_OWN + 1


class LineCRF:
    """emit: weights of `good` against `bad` by feature; move[a, b]: weight of b after a; cut: where documents' means part."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, cut: float, constant: float | None = None):
        self.emit, self.move, self.cut, self.constant = emit, move, cut, constant

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False):
        """For each line its log-likelihood of `good`; with pairs, each line's expected move from the one before as well. Steps go by line number, over all texts that have it."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        starts, lengths = first[:-1][order], n[order]
        longest = int(lengths[0]) if len(lengths) else 0
        live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.emit.astype(x.dtype)
        ahead, back = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            at = starts[: live[t]] + t
            ahead[at] += np.logaddexp(ahead[at - 1][:, :1] + self.move[0], ahead[at - 1][:, 1:] + self.move[1])
        for t in range(longest - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            onward = back[at + 1] + score[at + 1]
            back[at] = np.logaddexp(onward[:, :1] + self.move[:, 0], onward[:, 1:] + self.move[:, 1])
        both = ahead + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        if not pairs:
            return good
        at = np.setdiff1d(np.arange(len(x)), first[:-1])
        joint = ahead[at - 1][:, :, None] + self.move + (back[at] + score[at])[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        return good, joint / joint.sum((1, 2), keepdims=True), at

    def quality(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        mean = self.mean(x, size, first)
        return np.where(mean < self.cut, THRESHOLD * mean / self.cut, THRESHOLD + (1 - THRESHOLD) * (mean - self.cut) / max(1 - self.cut, 1e-9))

    def mean(self, x, size, first) -> np.ndarray:
        good = self.marginals(x, first)
        return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]) if len(first) > 1 else np.zeros(0)

    @classmethod
    def fit(cls, matrices: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> LineCRF:
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5, float(labels[0]) if len(labels) else 1.0)
        x, size = np.concatenate(matrices), np.concatenate(sizes)
        first = np.concatenate(([0], np.cumsum([len(m) for m in matrices])))
        y = np.repeat(labels, np.diff(first)).astype(float)
        # Both labels weigh the same, however often they occur.
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        by_line = np.repeat(weight, np.diff(first))
        model = cls(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5)
        theta = np.zeros(N_FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            model.emit, model.move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
            good, moves, at = model.marginals(x, first, pairs=True)
            # All lines of a document have its label, so the moves that were seen are from it to itself.
            seen = np.bincount(3 * y[at].astype(int), weights=by_line[at], minlength=4)
            moves = np.einsum("i,iab->ab", by_line[at], moves).ravel()
            gradient = np.concatenate((x.T @ (by_line * (y - good)).astype(x.dtype), seen - moves)) / len(y) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.emit, model.move = theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy()
        mean = model.mean(x, size, first)
        order = np.argsort(mean)
        good = labels[order] == 1
        # The cut with the most documents on their label's side.
        right = np.cumsum(~good) + good.sum() - np.cumsum(good)
        i = int(np.argmax(right))
        above = mean[order][i + 1] if i + 1 < len(order) else 1.0
        model.cut = float(np.clip((mean[order][i] + above) / 2, 1e-6, 1 - 1e-6))
        return model


def _feature_rows(batches):
    """Of each labelled text, its lines' own features, or those of a run of FIT_LINES lines, and their lengths."""
    for batch in batches:
        rows = []
        labels = batch.column("quality").to_pylist()
        for piece in bs.pieces(batch.column("text")):
            own, size, first = own_features(piece)
            drawn = bs.BYTES.of(piece.data, piece.offsets[:-1], piece.offsets[1:]).tolist()
            for d in range(len(piece)):
                a, b = int(first[d]), int(first[d + 1])
                if b - a > FIT_LINES:
                    a += drawn[d] % (b - a - FIT_LINES + 1)
                    b = a + FIT_LINES
                rows.append((labels[piece.first + d], own[a:b].astype(np.float32).tobytes(), size[a:b].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["quality", "own", "size"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineCRF:
    """From doc_id and text, and the labels (doc_id, quality) that may be learned from."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, sample_rows / max(marks.count(), 1))
    # At most about sample_rows rows, so small enough to broadcast.
    chosen = F.broadcast(marks.where(F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality").transform(in_python, _feature_rows, "quality int, own binary, size binary").collect()
    rows.sort(key=lambda r: (r.quality, r["size"], r.own))
    own = [np.frombuffer(r.own, dtype=np.float32).reshape(-1, N_OWN) for r in rows]
    return LineCRF.fit([with_neighbours(x, np.array([0, len(x)])) for x in own], [np.frombuffer(r["size"], dtype=np.int64) for r in rows], np.array([r.quality for r in rows]))


def score(docs: DataFrame, model: LineCRF) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.quality(*line_features(piece)) for piece in bs.pieces(batch.column("text"), SCORED)]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(np.clip(np.concatenate(scores), 0, 1) if scores else [], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").transform(in_python, run, "doc_id long, score double")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op7_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
