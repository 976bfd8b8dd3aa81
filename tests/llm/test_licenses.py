"""License scans against loops: places of phrases, merged diagonals and covered shares."""

import random
import re
from collections import defaultdict

import pyarrow as pa

from corvine.llm import license_scan
from corvine.llm.license_scan import TEMPLATES, Template

words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_loop(text, templates=TEMPLATES):
    w, base, places, labels, best = words(text), set(), [], set(), 0.0
    for t in templates:
        mine = words(t.text)
        k = len(mine) if t.phrase else min(3, len(mine))
        if not k:
            continue
        votes = [(p, q) for p in range(len(w) - k + 1) for q in range(len(mine) - k + 1) if w[p : p + k] == mine[q : q + k]]
        if t.phrase:
            places += [p for p, _ in votes]
            base |= {t.label} if votes else set()
            continue
        spans, last = [], None
        for d in sorted({p - q for p, q in votes}):
            if last is None or d - last > 4:
                spans.append(set())
            spans[-1].add(d)
            last = d
        for s in spans:
            covered = {q + i for p, q in votes if p - q in s for i in range(k)}
            best = max(best, len(covered) / len(mine))
            if 100 * len(covered) >= 80 * len(mine):
                labels.add(t.label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else round(best, 6)


def test_against_loop(spark):
    rng = random.Random(7)
    long = [words(t.text) for t in TEMPLATES if not t.phrase]
    rows = [(0, None), (1, ""), (2, "...\n"), (3, "MIT license, mit-LICENSE mit license"), (4, "the GNU General  Public\nLicense; apache license"), (5, "mit " * 3000 + "license"), (6, "released under the mit license " * 800)]
    for i in range(10, 120):
        w = list(rng.choice(long))
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = "changed"
            elif kind == 1:
                w[at:at] = ["more"] * rng.randrange(1, 7)
            elif len(w) > 3:
                del w[at : at + rng.randrange(1, 4)]
        around = [rng.choice(["the", "software", "license", "mit", "wordé", "of"]) for _ in range(rng.randrange(40))]
        rows.append((i, " ".join(around + w + around + (w[: len(w) // 2] if i % 5 == 0 else []))))
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: by_loop(t) for i, t in rows} and len(got) == len(rows)


def test_other_templates(spark):
    mine = (Template("a", "one two three four five"), Template("b", "...") , Template("c", "alone"), Template("d", "two three", True), Template("a", "six seven"))
    docs = spark.createDataFrame([(1, "one two three four"), (2, "alone"), (3, "six seven"), (3, "six seven"), (None, "two three"), (4, "two, three and one two three")], "doc_id long, text string")
    got = defaultdict(list)
    for r in license_scan.licenses(docs, mine).collect():
        got[r.doc_id].append((r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    assert got == {1: [(1, 1, 1, "d", "a,d", 1.0)], 2: [(0, None, None, "", "c", 1.0)], 3: [(0, None, None, "", "a", 1.0)] * 2, None: [(1, 0, 0, "d", "d", 1.0)], 4: [(2, 0, 4, "d", "d", 1.0)]}
    spans = license_scan.votes(spark, license_scan.scanned(docs, grams := license_scan.template_grams(mine)), grams)
    assert {(r.label, r.start, r.end, r.covered) for r in license_scan.spans(spans).collect()} == {("a", 0, 4, 4), ("c", 0, 1, 1), ("a", 0, 2, 2), ("a", 3, 6, 3)}
    assert license_scan.licenses(docs, ()).where("n_base = 0 and labels = '' and score = 0").count() == 6


def test_edges(spark, edge, nothing):
    got = license_scan.licenses(edge).collect()
    assert len(got) == 9 and {r.doc_id: r.n_words for r in got}[6] == 40_000 and all(r.n_base == 0 and r.labels == "" for r in got)
    assert license_scan.licenses(nothing).count() == 0


def test_templates_are_words():
    assert all(len(words(t.text)) >= 2 and t.label == t.label.strip() and "," not in t.label for t in TEMPLATES)
    assert pa.array([g[1] for g in license_scan.template_grams(TEMPLATES)]).null_count == 0
