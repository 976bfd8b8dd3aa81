"""Operators against plain loops on the smallest tables and on planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corvine.llm import bytescan as bs
from corvine.llm import chunk_dedup, decontaminate, exact_dedup, language_id, line_dedup, mixing, near_dedup, ngram_lm, quality_crf, suffix_dedup
from corvine.llm.components import components

SMALL = "/root/testdata/sf0.001"
BLANK = b" \t\n\x0b\x0c\r"
sha = lambda b: hashlib.sha256(b).hexdigest()
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))


def prose(rng, n, stock=4000):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with near copies, shared passages and shared runs of lines, a third of them around one text."""
    rng = random.Random(5)
    rows, base, passage, lines = [], prose(rng, 200), prose(rng, 60), "\n".join(prose(rng, 5) for _ in range(5))
    for i in range(240):
        if i % 3 == 0:
            w = base.split()
            for _ in range(rng.randrange(8)):
                w[rng.randrange(200)] = f"x{i}_{rng.randrange(50)}"
            text = " ".join(w)
        elif i % 3 == 1:
            text = prose(rng, rng.randrange(1, 150)) + " " + passage + " " + prose(rng, 20)
        else:
            text = prose(rng, 8) + "\n" + lines + "\n" + "\n".join(prose(rng, 4) for _ in range(rng.randrange(6)))
        rows.append((i, text))
    random.Random(1).shuffle(rows)
    return rows


def both(spark, sample, planted):
    for rows in ([(r["doc_id"], r["text"]) for r in sample], planted):
        yield rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_near(spark, sample, planted):
    for rows, docs in both(spark, sample, planted):
        for k, percent in ((3, 90), (5, 80)):
            sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for i, t in rows}
            parent = {i: i for i in sets}

            def root(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_components(docs, k, percent).collect()}
            assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_suffix(spark, sample, planted):
    for rows, docs in both(spark, sample, planted):
        first, texts = {}, {i: (t or "").encode() for i, t in rows}
        for i, t in sorted(texts.items()):
            for p in range(len(t) - 49):
                first.setdefault(t[p : p + 50], i)
        for r in suffix_dedup.suffix_dedup(docs).collect():
            t = texts[r.doc_id]
            gone = np.zeros(len(t), dtype=bool)
            for p in range(len(t) - 49):
                if first[t[p : p + 50]] < r.doc_id:
                    gone[p : p + 50] = True
            assert r.kept == bytes(np.frombuffer(t, dtype=np.uint8)[~gone]) and r.n_removed == gone.sum() and r.n_spans == len(bs.spans(gone)[0])


def test_suffix_family_levels():
    family, rng, seen = suffix_dedup.SuffixFamily(), np.random.default_rng(3), []
    for batch in rng.permutation(12):
        docs = rng.integers(0, 5, 60) * 12 + batch  # a document comes in one batch
        texts = np.array([b"%050d" % x for x in rng.integers(0, 100, 60)], dtype="S50")
        family.add(texts, docs)
        seen += list(zip(texts.tolist(), docs.tolist(), strict=True))
    first = {}
    for t, d in seen:
        first[t] = min(d, first.get(t, d))
    assert family.verdict().tolist() == [d > first[t] for t, d in seen]
    sizes = [len(level[0]) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def chunks_of(t):
    """Where a text's chunks lie, byte by byte."""
    table, cuts, at, h = [int(x) for x in chunk_dedup.GEAR], [], 0, 0
    for p, byte in enumerate(t, 1):
        h = (2 * h + table[byte]) & 0xFFFFFFFF
        mark = h >> 32 - chunk_dedup.BITS == 0 and p - at >= chunk_dedup.LEAST or p - at == chunk_dedup.MOST
        if mark and len(t) - p >= chunk_dedup.LEAST or p == len(t):
            cuts.append((at, p))
            at = p
    return cuts


def test_chunks(spark, sample, planted):
    rows = planted + [(1000 + r["doc_id"], r["text"]) for r in sample] + [(9000, "short"), (9001, "short"), (9002, prose(random.Random(1), 60) + "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, seen = {r.doc_id: r for r in chunk_dedup.chunk_dedup(docs).collect()}, set()
    for i, text in sorted(rows):
        t = (text or "").encode()
        cuts, dup = chunks_of(t), []
        for a, b in cuts:
            dup.append(t[a:b] in seen)
            seen.add(t[a:b])
        kept = b"".join(t[a:b] for (a, b), gone in zip(cuts, dup, strict=True) if not gone)
        assert (got[i].n_chunks, got[i].n_duplicate, got[i].n_bytes, got[i].n_removed, got[i].kept) == (len(cuts), sum(dup), len(t), len(t) - len(kept), kept)
        assert got[i].n_spans == sum(gone and not before for gone, before in zip(dup, [False, *dup], strict=False))
    # Nearly all but the first holder of the passage lose some of it.
    holders = [i for i, _ in sorted(planted) if i % 3 == 1]
    assert got[holders[0]].n_removed == 0 and sum(got[i].n_removed > 64 for i in holders[1:]) > 0.9 * len(holders) and got[9001].n_removed == 5 and got[9002].n_removed == 0


def test_lines(spark, sample, planted):
    for rows, docs in both(spark, sample, planted):
        seqs, first = {}, {}
        for i, t in sorted(rows):
            seqs[i] = [x.strip(BLANK) for x in low(t).encode().split(b"\n") if x.strip(BLANK)]
            for x in range(len(seqs[i]) - 2):
                first.setdefault(tuple(seqs[i][x : x + 3]), (i, x))
        for r in line_dedup.line_dedup(docs).collect():
            q = seqs[r.doc_id]
            gone = {y for x in range(len(q) - 2) if first[tuple(q[x : x + 3])] < (r.doc_id, x) for y in (x, x + 1, x + 2)}
            assert (r.n_lines, r.n_removed) == (len(q), len(gone))
            assert [x.strip(BLANK) for x in low(r.kept).encode().split(b"\n") if x.strip(BLANK)] == [x for j, x in enumerate(q) if j not in gone]


@pytest.mark.parametrize("slice_bytes", [decontaminate.SLICE_BYTES, 4000])
def test_decontamination(spark, sample, slice_bytes):
    parts = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    known = defaultdict(set)
    for r in items.collect():
        w = parts(r.text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            known[tuple(w[i : i + 13])].add(str(r.item_id))
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in sample], "doc_id long, text string")
    dirty = 0
    texts = {r["doc_id"]: r["text"] for r in sample}
    for r in decontaminate.contamination(docs, items, slice_bytes=slice_bytes).collect():
        w, hit, found = parts(texts[r.doc_id]), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if ids := known.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= ids
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
        dirty += bool(hit) and 20 * len(hit) >= len(w)
    assert decontaminate.drop_contaminated(docs, items, slice_bytes=slice_bytes).count() == len(sample) - dirty
    assert decontaminate.contamination(decontaminate.strip_contaminated(docs, items), items).where("n_hit > 100").count() == 0


def test_exact_names_when_routes_collide(spark, planted):
    docs = spark.createDataFrame(planted + [(1000 + i, t.upper()) for i, t in planted[:50]], "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for i, t in planted + [(1000 + i, t.upper()) for i, t in planted[:50]]:
        groups[low(t)].append(i)
    for bits in (64, 3):
        got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs, block=16, route_bits=bits).collect()}
        assert got == {i: (max(g), len(g), sha(t.encode())) for t, g in groups.items() for i in g}


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(2)
    sizes = [(f"s{i:02}", 1, rng.randrange(1, 5000)) for i in range(13)] + [(None, 1, 77), ("zero", 1, 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, n long, source_size long")).collect()}
    order = sorted((s for s, _, _ in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2 * n for s, _, n in sizes}
    target, left, open_ = dict.fromkeys(cap, 0.0), 1.5 * sum(n for _, _, n in sizes), set(cap)
    while left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - cap[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap[s]:
                target[s] = float(cap[s])
                open_.discard(s)
    assert got == {s: pytest.approx(t) for s, t in target.items()}


def test_hot_source_in_ranges(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 1 + i % 7, 1.0 + i % 2) for i in range(3000)], "doc_id long, source string, size long, quality_weight double")
    fine, coarse = (sorted(map(tuple, mixing.mix(docs, range_rows=n).collect())) for n in (50, 10**6))
    assert fine == coarse


@pytest.mark.parametrize(("order", "fair"), [(3, 0.25), (3, 0.01), (2, 0.05)])
def test_language_model(spark, sample, monkeypatch, order, fair):
    """Interpolated modified Kneser-Ney by its formula, with and without spread contexts."""
    monkeypatch.setattr(ngram_lm, "ORDER", order)
    monkeypatch.setattr(ngram_lm, "FAIR", fair)
    monkeypatch.setattr(ngram_lm, "COUNTED", 3000)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tok = {r["doc_id"]: [*words(r["text"]), "\n"] for r in sample}
    grams = {i: list(zip(*(["\n\n"] * (order - 1 - j) + t[: len(t) - (order - 1 - j)] if len(t) >= order - 1 - j else (["\n\n"] * (order - 1))[: len(t)] for j in range(order)), strict=True)) for i, t in tok.items()}
    assert all(len(g) == len(tok[i]) and [x[-1] for x in g] == tok[i] for i, g in grams.items())
    uni, counts = Counter(), {order: Counter()}
    for i in tok:
        if not out(i):
            counts[order].update(grams[i])
            uni.update(tok[i])
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    heads = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            heads[k][g[:-1]][0] += n
            heads[k][g[:-1]][min(n, 3)] += 1

    def discount(values):
        n = [sum(c == j for c in values) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(d, 0), j) for j, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2])))]

    d = {k: discount(c.values()) for k, c in counts.items()}

    def probability(g):
        k = len(g)
        lower = probability(g[1:]) if k > 1 else 1 / (len(uni) + 1)
        if g[:-1] not in heads[k]:
            return lower
        h, c = heads[k][g[:-1]], counts[k][g]
        return max(c - d[k][min(c, 3)], 0) / h[0] + sum(x * y for x, y in zip(d[k][1:], h[1:], strict=True)) / h[0] * lower

    total = sum(uni.values())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = ngram_lm.NgramModel.fit(docs.where(~ngram_lm.held_out()), order)
    assert order == 2 or (fair == 0.25) or all(len(s) for s in model.spread.values())
    got = ngram_lm.score(docs, model).collect()
    for r in got:
        t = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (len(t), sum(w in uni for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in t), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(probability(g)) for g in grams[r.doc_id]), rel=1e-9)
    held = [r for r in got if out(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # The probabilities of all words, and of the unknown one, are 1 in any context.
    some = max(heads[order], key=lambda c: heads[order][c][0])
    assert sum(probability((*some, w)) for w in uni) + probability((*some, "never seen")) == pytest.approx(1)


def test_held_out_accuracy(spark):
    """Language and quality, on rows that weren't learned from."""
    data = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.op9_language_id(spark, data).join(truth.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality_crf.op7_quality_crf(spark, data).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)


def test_crf_marginals():
    """Forward-backward against the sum over all labellings."""
    rng = np.random.default_rng(4)
    model = quality_crf.LineCRF(rng.normal(size=quality_crf.N_FEATURES), rng.normal(size=(2, 2)), 0.5)
    x, first = rng.normal(size=(7, quality_crf.N_FEATURES)), np.array([0, 4, 5, 7])
    got = model.marginals(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weight = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> j & 1 for j in range(b - a)]
            w = math.exp(sum(x[a + j] @ model.emit * y[j] for j in range(b - a)) + sum(model.move[y[j], y[j + 1]] for j in range(b - a - 1)))
            for j, label in enumerate(y):
                weight[j, label] += w
        assert got[a:b] == pytest.approx(weight[:, 1] / weight.sum(1))


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_long_texts_hash_alike():
    data = np.frombuffer(bytes(random.Random(1).randrange(97, 110) for _ in range(60_000)), dtype=np.uint8)
    start = np.arange(0, 59_000, 7)
    kept, bs.PIECE = bs.PIECE, 1000
    try:
        assert (bs.BYTES.of(data, start, start + 33) == bs.BYTES.slices(bs.BYTES.sums(data), start, start + 33)).all()
    finally:
        bs.PIECE = kept


def test_pipeline(spark, sample):
    """The stages one by one, their decisions checked against the operators' plain rules, and run() as a whole."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "near_duplicates":
            keys = {r.doc_id: r.component_id for r in near_dedup.link_components(docs, 5, 80).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, c in keys.items() if i == c}
        if name == "decontaminate":
            dirty = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect() if r.n_hit and 20 * r.n_hit >= r.n_words}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - dirty
        if name == "lines":
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name != "mix":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, docs.collect()))
    assert all(r.taken <= 2 * r["size"] for r in docs.collect())
