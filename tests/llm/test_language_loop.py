"""Language identification, fit and prediction, against a plain loop: every back-off level, ties, unknown words."""

import math
from collections import Counter, defaultdict

import pytest

from corvine.llm import bytescan as bs
from corvine.llm import language_id


def letter_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out.append(word)
            word = ""
    return out


def by_loop(learned, texts):
    """learned: (text, lang); for each of texts the language and its score."""
    rows = Counter(lang for _, lang in learned if lang is not None)
    langs = sorted(rows)
    counts = {n: defaultdict(Counter) for n in range(5)}
    for text, lang in learned:
        if text is None or lang is None:
            continue
        for w in letter_words(text):
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[n][w[i : i + n]][lang] += 1
    total = {n: {x: sum(c[x] for c in t.values()) for x in langs} for n, t in counts.items()}
    base = {n: {x: math.log(0.5 / (total[n][x] + 0.5 * len(t))) for x in langs} for n, t in counts.items() if t}
    above = lambda n, g, x: math.log((counts[n][g][x] + 0.5) / 0.5) if x in counts[n][g] else 0.0
    out, levels = [], Counter()
    for text in texts:
        words = letter_words(text)
        if not words:
            out.append(("und", 0.0))
            continue
        score = {x: math.log(rows[x] / sum(rows.values())) for x in langs}
        for w in words:
            for n in (0, 4, 3, 2, 1):
                grams = [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]
                known = [g for g in grams if n in base and g in counts[n]]
                if known:
                    levels[n] += 1
                    for x in langs:
                        score[x] += base[n][x] + sum(above(n, g, x) for g in known) / len(known)
                    break
            else:
                levels["none"] += 1
        best = max(langs, key=lambda x: (score[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out, levels


def compared(spark, learned, texts):
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(learned)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.LanguageModel.fit(frame, sample_rows=1 << 20)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    want, levels = by_loop(learned, texts)
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=2e-4), texts[i]
    assert len(got) == len(texts)
    return levels


def test_every_level(spark):
    learned = [("the house and the garden", "en"), ("das Haus und der Garten, straße", "de"), ("la maison été", "fr"), ("the the", "en"), (None, "fr"), ("nobody", None), ("ΟΔΟΣ οδός", "el"), ("𐐀𐐁𐐂", "ds")]
    texts = ["the house", "hous", "gartenhaus", "xhax", "zz", "qqq", "é", "", None, "123 ...", "THE Garten", "maisons étés", "h", "οδο", "𐐀𐐁", "𐐀q", "İstanbul ǅ", "the-garden_and", "a b c d e", "日本"]
    levels = compared(spark, learned, texts)
    assert all(levels[n] for n in (0, 4, 3, 2, 1, "none"))


def test_ties_go_to_the_first_language(spark):
    learned = [("same words", "b"), ("same words", "a"), ("same words", "c")]
    compared(spark, learned, ["same", "words same", "other", "zzz"])
    assert by_loop(learned, ["same"])[0][0][0] == "a"


def test_whole_documents(spark, sample):
    learned = [(r["text"], r["lang"]) for r in sample[:80]]
    levels = compared(spark, learned, [r["text"] for r in sample[80:140]])
    assert levels[0] and levels[4]


def test_pieces_do_not_matter():
    """A text that is longer than a piece is scored as one."""
    table = language_id.Table(*(lambda h: (h, language_id.np.zeros(len(h), dtype=int), language_id.np.ones(len(h)), 1))(language_id.np.array([5], dtype=language_id.np.uint64)))
    model = language_id.LanguageModel(["x"], language_id.np.zeros(1), {0: table})
    import pyarrow as pa

    whole = [model.predict(p) for p in bs.pieces(pa.array(["wordé " * 100_000, "a"]))]
    assert [x for langs, _ in whole for x in langs] == ["x", "x"]
