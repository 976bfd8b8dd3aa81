"""The quality classifier against plain loops: features, marginals, scores of whole documents, and training."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from corvine.llm import bytescan as bs
from corvine.llm import quality_crf
from corvine.llm.quality_crf import LineCRF

SYMBOLS = set(b"!#$%&*+/<=>@[\\]^_`{|}~")


def features_by_loop(text):
    """A row of 46 features for each line, and the lines' lengths."""
    rows, sizes, last_word, last_line = [], [], None, None
    for line in (text or "").encode().split(b"\n"):
        words = re.findall(rb"[^\x20\x09-\x0D]+", line)
        again = marks = 0
        for w in words:
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            again += low == last_word
            marks += len(w) == 1 and w[0] in SYMBOLS
            last_word = low
        upper, lower, digits, other = (sum(a <= c <= b for c in line) for a, b in ((65, 90), (97, 122), (48, 57), (128, 255)))
        symbols, n, w = sum(c in SYMBOLS for c in line), len(line), max(len(words), 1)
        letters, length = max(upper + lower + other, 1), max(n, 1)
        rows.append(
            [math.log1p(n) / 5, math.log1p(len(words)) / 4, min(n / w, 30) / 10, upper / letters, digits / length * 3, symbols / length * 5, symbols / w, other / length, again / w, marks / w * 2, sum(c in b".?," for c in line) / w]
            + [float(upper > 0.6 * letters), float(again > 0.3 * w), float(line == last_line), float(n == 0)]
        )
        sizes.append(max(n, 1))
        last_line = line
    none = [0.0] * len(rows[0])
    return [own + (rows[i - 1] if i else none) + (rows[i + 1] if i + 1 < len(rows) else none) + [1.0] for i, own in enumerate(rows)], sizes


def chain(rows, emit, move):
    """Weights of all labellings of a short chain."""
    score = [sum(a * b for a, b in zip(r, emit, strict=True)) for r in rows]
    out = {}
    for labels in itertools.product((0, 1), repeat=len(rows)):
        out[labels] = sum(s for s, y in zip(score, labels, strict=True) if y) + sum(move[a][b] for a, b in itertools.pairwise(labels))
    return out


def marginals_by_loop(rows, emit, move):
    """Forwards and backwards, a line at a time, in plain numbers."""
    score = [[0.0, sum(a * b for a, b in zip(r, emit, strict=True))] for r in rows]
    join = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    ahead, back = [score[0]], [[0.0, 0.0]]
    for s in score[1:]:
        ahead.append([s[y] + join(ahead[-1][0] + move[0][y], ahead[-1][1] + move[1][y]) for y in (0, 1)])
    for s in score[:0:-1]:
        back.append([join(move[y][0] + s[0] + back[-1][0], move[y][1] + s[1] + back[-1][1]) for y in (0, 1)])
    return [1 / (1 + math.exp(max(-60, min(60, a[0] + b[0] - a[1] - b[1])))) for a, b in zip(ahead, back[::-1], strict=True)]


def score_by_loop(text, model):
    rows, sizes = features_by_loop(text)
    good = marginals_by_loop(rows, model.emit.tolist(), model.move.tolist())
    mean = sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes)
    return 0.7 * mean / model.cut if mean < model.cut else 0.7 + 0.3 * (mean - model.cut) / max(1 - model.cut, 1e-9)


TEXTS = ["", None, "\n", "a\n\n\nb", "Same same SAME\nsame line\nsame line", "### $ % x\n| a | b |\n1,234. ok?", "ALL CAPS HERE\n\nwordé été", "x" * 50 + " " + "1" * 9, "one line only", "end\n"]


def test_features(sample):
    for text in [*TEXTS, *[r["text"] for r in sample[:40]]]:
        (piece,) = bs.pieces(pa.array([text], pa.string()))
        x, size, first = quality_crf.line_features(piece)
        rows, sizes = features_by_loop(text)
        assert np.allclose(x, rows) and size.tolist() == sizes and first.tolist() == [0, len(rows)]


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    emit, move = rng.normal(size=46), rng.normal(size=(2, 2))
    for text in TEXTS:
        rows, _ = features_by_loop(text)
        weights = chain(rows, emit, move)
        whole = sum(math.exp(v) for v in weights.values())
        want = [sum(math.exp(v) for y, v in weights.items() if y[i]) / whole for i in range(len(rows))]
        assert np.allclose(marginals_by_loop(rows, emit.tolist(), move.tolist()), want)
        assert np.allclose(LineCRF(emit, move, 0.5).marginals(np.array(rows), np.array([0, len(rows)])), want)


def test_scores_of_whole_documents(spark, sample):
    """The fitted model's scores, document by document, and what the query makes of them."""
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(docs, labels.where(~quality_crf.held_out()))
    got = {r.doc_id: r for r in quality_crf.op7_quality_crf(spark, data).collect()}
    assert len(got) == len(sample)
    for r in sample:
        want = min(1.0, max(0.0, score_by_loop(r["text"], model)))
        assert got[r["doc_id"]].score == pytest.approx(want, abs=1e-9) and got[r["doc_id"]].predicted == (got[r["doc_id"]].score >= 0.7)


def test_training_climbs_the_likelihood(monkeypatch):
    """The steps of training are those of a gradient taken numerically from the likelihood of all labellings, and the cut parts the labels best."""
    monkeypatch.setattr(quality_crf, "STEPS", 3)
    docs, labels = ["Good line.\nAnother, good one.", "$$$\n$$$\n$$$", "A sentence.", "###"], np.array([1, 0, 1, 0])
    labels = np.append(labels, 1)
    rows, sizes = zip(*(features_by_loop(t) for t in [*docs, "more text here.\nand here"]), strict=True)
    n = sum(map(len, rows))
    weight = {1: 0.5 / labels.mean(), 0: 0.5 / (1 - labels.mean())}

    def likelihood(theta):
        out = -0.5 * quality_crf.RIDGE * float(theta @ theta)
        for r, y in zip(rows, labels.tolist(), strict=True):
            ways = chain(r, theta[:46], theta[46:].reshape(2, 2))
            out += weight[y] * (ways[(y,) * len(r)] - math.log(sum(math.exp(v) for v in ways.values()))) / n
        return out

    theta, m, v = np.zeros(50), np.zeros(50), np.zeros(50)
    for step in (1, 2, 3):
        gradient = np.array([(likelihood(theta + 1e-5 * e) - likelihood(theta - 1e-5 * e)) / 2e-5 for e in np.eye(50)])
        gradient[np.abs(gradient) < 1e-9] = 0  # features that don't occur
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + quality_crf.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = LineCRF.fit([np.array(r) for r in rows], [np.array(s) for s in sizes], labels)
    assert np.allclose(np.concatenate([model.emit, model.move.ravel()]), theta, atol=2e-3)
    means = [float(model.mean(np.array(r), np.array(s), np.array([0, len(r)]))[0]) for r, s in zip(rows, sizes, strict=True)]
    best = max(sum((x >= c) == y for x, y in zip(means, labels, strict=True)) for c in [0, *means, 1])
    assert sum((x >= model.cut) == y for x, y in zip(means, labels, strict=True)) >= best - 1
