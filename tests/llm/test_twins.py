"""Language and quality against twins in plain Python: dictionaries, and one cosine at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from albumforge.llm.language import BACKOFF, LONGEST, language_of
from albumforge.llm.quality_votes import FEATURES, NEIGHBOURS, REPEATED, drawn, fit, quality_votes


def words_in(text):
    return [w for w in regex.split(r"[^\p{L}\p{M}]+", (text or "").lower()) if w]


def brute_language(labelled, asked):
    seen = defaultdict(Counter)
    for text, lang in labelled:
        if text is not None and lang is not None:
            for w in words_in(text):
                seen[w][lang] += 1
    langs = sorted({lang for c in seen.values() for lang in c})
    levels = [defaultdict(Counter) for _ in range(LONGEST + 1)]
    for w, by_lang in seen.items():
        for lang, n in by_lang.items():
            if n > 1:
                levels[0][w][lang] += n
            padded = f" {w} "
            for k in range(1, LONGEST + 1):
                for i in range(len(padded) - k + 1):
                    levels[k][padded[i:i + k]][lang] += n
    totals = [{lang: 0.5 * max(1, len(level)) + sum(c[lang] for c in level.values()) for lang in langs} for level in levels]
    rate = lambda k, e: np.array([math.log((levels[k][e][lang] + 0.5) / totals[k][lang]) for lang in langs])
    out = []
    for text in asked:
        total = np.zeros(len(langs))
        for w in words_in(text):
            if w in levels[0]:
                total += rate(0, w)
                continue
            padded, hits = f" {w} ", []
            for at in range(len(padded) - 1):
                most = min(LONGEST, len(padded) - at)
                k = next((k for k in range(most, 0, -1) if padded[at:at + k] in levels[k]), 0)
                if k:
                    hits.append(rate(k, padded[at:at + k]) + (most - k) * math.log(BACKOFF))
            total += np.mean(hits, axis=0) if hits else 0
        odds = np.exp(total - total.max())
        out.append((langs[int(total.argmax())], float(odds.max() / odds.sum())) if words_in(text) else ("und", 0.0))
    return out


def test_language_equals_dictionaries(spark):
    rng = random.Random(3)
    stems = {"aa": ["kala", "mula", "tara", "éna"], "bb": ["zork", "mula", "grumf", "dørk"], "cc": ["xi", "xo", "tara", "qi"]}
    labelled = [(" ".join(rng.choice(s) + rng.choice(["", "n", "ti"]) for _ in range(rng.randrange(1, 9))), lang) for lang, s in stems.items() for _ in range(15)]
    labelled += [(None, "aa"), ("once only here", "bb"), ("kala", None)]
    asked = [t for t, _ in labelled] + ["zorkala, MULA! 7 taraxo", "", "12 ##", "qqqq wwww", "grumf " * 3000, "dørkéná"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(asked)], "doc_id long, text string, row int").repartition(3)
    model = spark.createDataFrame(labelled, "text string, lang string").repartition(2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_of(docs, model).collect()}
    for i, (lang, score) in enumerate(brute_language(labelled, asked)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), asked[i]


def brute_bag(text):
    """The features of one text, by number."""
    split = regex.split(r"[ \t-\r]+", text or "")
    shapes = split
    for pattern, by in ((r"\p{Lu}{2,}", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0"), (r"([^\p{L}\p{N}])[^\p{L}\p{N}]+", r"\1\1")):
        shapes = [regex.sub(pattern, by, s) for s in shapes]
    number = lambda s, salt: zlib.crc32(s.encode(), salt) % FEATURES
    counts = Counter()
    for w, s in zip(split, shapes, strict=True):
        if w:
            counts[number(w.lower(), 2)] += 1
            counts[number(s, 1)] += 1
    for a, b in zip(shapes, shapes[1:], strict=False):
        counts[(number(a, 1) * 31 + number(b, 1) * 17 + 5) % FEATURES] += 1
    bag = {f: math.log1p(n) for f, n in counts.items()}
    if any(split):
        again = sum(a == b for a, b in zip(split, split[1:], strict=False)) / max(1, len(split) - 1)
        place = 0 if again <= 0.05 else 1 if again <= 0.2 else 2
        bag[place] = bag.get(place, 0) + REPEATED
    return bag


def test_votes_equal_single_cosines(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("klmnoprst") for _ in range(5)) for _ in range(60)]
    texts = []
    for i in range(160):
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 30))]
        texts.append((" ".join(w + ["###", "Buy!!", "NOW"] * (i % 4 == 0)) + rng.choice(["", ".", "\n\n1 2"]), int(i % 4 > 0)))
    sample = spark.createDataFrame(texts, "text string, label int").repartition(2)
    space = fit(sample)
    asked = [t for t, _ in texts[:50]] + ["", " \t", "same same same same", "Été 42 … ok", "plain " * 5000]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(asked)] + [(99, None, 0.0)], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r["score"] for r in quality_votes(docs, sample).collect()}
    assert got[99] == got[50] == pytest.approx(space.prior)
    for i, text in enumerate(asked):
        v = np.zeros(space.projection.shape[1])
        for f, x in brute_bag(text).items():
            v += x * space.projection[f].astype(float)
        v /= max(np.linalg.norm(v), 1e-12)
        near = sorted(((float(v @ u), float(label)) for u, label in zip(space.vectors.astype(float), space.labels, strict=True)), reverse=True)[:NEIGHBOURS]
        weight = [max(c, 0) ** 4 for c, _ in near]
        want = (sum(w * label for w, (_, label) in zip(weight, near, strict=True)) + 1e-3 * space.prior) / (sum(weight) + 1e-3)
        assert got[i] == pytest.approx(want, abs=0.02), text


def test_sample_has_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}", 1) for i in range(400)] + [(None, "x", 1), (7, None, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = drawn(docs, labels).collect()
    ids = [int(r["text"].split()[1]) % 40 for r in rows]
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(ids) == learned and all(r["label"] == i % 2 for r, i in zip(rows, ids, strict=True))
    assert drawn(docs, labels, each_class=4).groupBy("label").agg(F.count("*").alias("n")).filter("n > 4").count() == 0
