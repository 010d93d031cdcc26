"""Token files, packing, mixing, rules, trained models, pipeline: round trips, brute force, held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from albumforge.llm.encode import WordEncoder, string_blocks
from albumforge.llm.language import language_of
from albumforge.llm.mixing import mix, pivot
from albumforge.llm.packing import best_fit_packing, pack_block
from albumforge.llm.quality_rules import quality_rules
from albumforge.llm.quality_votes import quality_votes
from albumforge.llm.token_files import Shard, compress, read_digests, write_token_files
from albumforge.llm.toxicity import toxicity, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, texts, end):
    return [np.array([*e.ids, end], "<u4") for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "end", "byte_level"), [(BYTES, 2, True), (WORDS, 1, False)])
def test_encoder_equals_whole_texts(rows, path, end, byte_level):
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab Z'é!.#\n\t  …ß×9<|\x01") for _ in range(rng.randrange(30))) for _ in range(400)]
    texts = [r[1] for r in rows] + odd + ["it's don't we'll x''s", "a<|endoftext|>b <|endoftext|>", "a\n <|", "é.×.ß!"]
    got, encoder = [], WordEncoder(path, end, byte_level)
    for _, block in string_blocks(pa.array(texts), 256):
        ids, counts = encoder.encode(block)
        got += np.split(ids, np.cumsum(counts)[:-1])
    for t, a, b in zip(texts, ids_of(path, texts, end), got, strict=True):
        assert a.tolist() == b.tolist(), t


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for ids in (np.empty(0, np.uint32), np.array([7], np.uint32), np.full(1000, 5, np.uint32), rng.integers(0, 9, 5000).astype(np.uint32), rng.integers(0, 1 << 16, 4000).astype(np.uint32)):
        shard = Shard(compress(ids, least=4))
        assert len(shard) == len(ids) and (shard.all() == ids).all()
        for a, b in ((0, 0), (0, 1), (3, 17), (len(ids) // 2, len(ids))):
            assert (shard.ids(a, min(b, len(ids))) == ids[a:b]).all()
    assert len(compress(np.tile(rng.integers(0, 50, 64), 200).astype(np.uint32))) < 2000


def test_token_files(docs, rows, nothing):
    files = write_token_files(docs, None, BYTES, shard_ids=500)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_digests(files).collect())
    sized = Counter((-1 if r[0] is None else r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids_of(BYTES, [r[1] for r in rows], 2), strict=True))
    assert Counter((a, n, c) for a, _, n, c in got) == sized
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted(g[0] for g in got)
    assert files.count() > 3
    assert read_digests(write_token_files(nothing, None, BYTES)).collect() == []


def test_packing(docs, rows, nothing):
    capacity = 64
    got = best_fit_packing(docs, WORDS, capacity=capacity).collect()
    want = Counter()
    for r, x in zip(rows, ids_of(WORDS, [r[1] for r in rows], 1), strict=True):
        for p, s in enumerate(range(0, len(x), capacity)):
            want[r[0], p, s, len(x[s:s + capacity]), zlib.crc32(x[s:s + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.15 * sum(r["length"] for r in got) / capacity + 1
    assert best_fit_packing(nothing, WORDS).collect() == []


def test_packing_encodes_few_rows_at_a_time(spark, monkeypatch):
    from albumforge.llm import packing

    cut, key = packing.string_blocks, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def few(texts, size):
        if len(texts) > 1000:
            raise ValueError(f"{len(texts)} rows in one batch")
        return cut(texts, size)

    monkeypatch.setattr(packing, "string_blocks", few)
    docs, usual = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text"), spark.conf.get(key)
    assert best_fit_packing(docs, WORDS).count() == 3000
    assert spark.conf.get(key) == usual


def test_packing_close_to_the_bound():
    lengths = np.minimum(np.random.default_rng(0).lognormal(6, 1, 6000).astype(int) + 2, 4096)
    sequence, offset = pack_block(lengths)
    fill = np.bincount(sequence, lengths)
    assert fill.max() <= 4096 and len(fill) <= 1.01 * lengths.sum() / 4096 + 1
    assert sorted(zip(sequence, offset, strict=True)) == sorted(set(zip(sequence, offset, strict=True)))


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(1)
    sizes, shares = rng.integers(1, 90, 500), np.full(500, 0.37)
    taken = []
    for _ in range(200):
        p, held = pivot(sizes, shares, rng.random(500))
        assert abs((p * sizes).sum() - (shares * sizes).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        taken.append(np.round(p))
    assert abs(np.mean(taken) - 0.37) < 0.03


def test_mix(docs, rows, nothing):
    got = mix(docs).collect()
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], n) for r, n in zip(rows, sizes, strict=True))
    by = {}
    for r in got:
        by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        by[r["source"]][2] += r["size"]
        by[r["source"]][3] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    for size, target, summed, taken in by.values():
        assert size == summed and target <= 2 * size + 1e-6 and abs(taken - target) <= 1 + max(r["size"] for r in got if r["source_size"] == size) / 2
    assert abs(sum(v[1] for v in by.values()) - min(1.5, 2) * sum(sizes)) < 1e-6
    again = mix(docs.repartition(7, "text")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix(nothing).collect() == []


def test_targets_are_dealt_again(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 100), ("c", 100), (None, 100)])]
    got = {r["source"]: r["target"] for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # 465 words by 5, 2, 1, 5: a stops at 20, then null at 200; 245 are left for 2 and 1.
    assert got["a"] == 20 and got[None] == 200 and got["b"] == pytest.approx(245 * 2 / 3) and got["c"] == pytest.approx(245 / 3)


def brute_measures(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    n, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules(spark, docs, rows, framed, nothing):
    more = [(900 + i, f"{a}\n{a}\nx\n{b}", None, None) for i, (a, b) in enumerate([("a b c d e f g h i j", "a b c d e f g h i"), ("k " * 30, ""), ("q\tr " * 9, "z")])]
    more += [(950 + i, " ".join(f"w{i}x{j}###" for j in range(60)), None, None) for i in range(4)]
    got = quality_rules(docs.unionByName(framed(more))).collect()
    assert Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in got) == Counter(
        (r[0], *brute_measures(r[1])) for r in [*rows, *more])
    assert all(0 <= r["quality"] <= 1 and not (r["kept"] and r["base_failed"]) for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[950 + i] for i in range(4)) and sum(kept.values()) > 10
    assert quality_rules(nothing).collect() == []


VOCABULARY = {"en": "the and of house water stone walk light".split(), "de": "der und von haus wasser stein gehen licht".split(), "fr": "le et de maison eau pierre marcher lumière".split()}


def test_language(spark, docs, nothing):
    rng = random.Random(4)
    texts = [(lang, " ".join(rng.choice(words) for _ in range(12))) for lang, words in VOCABULARY.items() for _ in range(40)]
    labelled = spark.createDataFrame([(t, lang) for lang, t in texts] + [(None, "en"), ("alone", None)], "text string, lang string")
    asked = [(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(500, "wassers steine lichter", "de"), (501, None, "und"), (502, " 12 ### ", "und"), (503, "", "und"), (None, "the house of stone", "en")]
    got = language_of(spark.createDataFrame(asked, "doc_id long, text string, lang string"), labelled).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter((i, lang) for i, _, lang in asked)
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") and 0 <= r["score"] <= 1 for r in got)
    assert language_of(nothing, labelled).collect() == []
    assert {r["lang_pred"] for r in language_of(docs, labelled.limit(0)).collect()} == {"und"}


def test_no_frequent_pair_is_left_in_a_shard():
    rng = np.random.default_rng(3)
    passages = [rng.integers(0, 3000, n) for n in (300, 90, 41)]
    ids = np.concatenate([np.append(passages[i], rng.integers(0, 3000, 7)) for i in rng.integers(0, 3, 200)] + [np.full(999, 5), rng.integers(0, 40, 20_000)]).astype(np.uint32)
    for rules in (2048, 20):
        shard = Shard(compress(ids, round_rules=rules))
        symbols = shard.symbols.astype(np.int64)
        assert np.unique(symbols[:-1] << 32 | symbols[1:], return_counts=True)[1].max() < 12
        assert (shard.all() == ids).all() and shard.rule_lengths.max() >= 300


def test_language_reads_whole_runs_and_every_lang(spark):
    # 70 letters that both languages have, then 200 of one alone, in one run; and more languages than 64.
    labelled = spark.createDataFrame([("kakakaka " * 3, "aa"), ("kakakaka " * 3 + "zuzizuzi", "bb")] + [(f"q{chr(0x4E00 + i)}q " * 2, f"l{i:02}") for i in range(70)], "text string, lang string")
    asked = [(1, "ka" * 35 + "zuzi" * 50), *[(100 + i, f"q{chr(0x4E00 + i)}q") for i in range(70)]]
    got = {r["doc_id"]: r["lang_pred"] for r in language_of(spark.createDataFrame(asked, "doc_id long, text string"), labelled).collect()}
    assert got == {1: "bb"} | {100 + i: f"l{i:02}" for i in range(70)}


def test_language_does_not_depend_on_what_is_broadcast(spark, docs):
    rng = random.Random(5)
    labelled = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(12)), lang) for lang, words in VOCABULARY.items() for _ in range(10)], "text string, lang string")
    asked = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "wassers steine the lichter zzz"), (901, "qq"), (902, None)], "doc_id long, text string"))
    whole, joined = ({(r["doc_id"], r["lang_pred"], round(r["score"], 9)): 1 for r in language_of(asked, labelled, head_rates=h, gram_rates=g).collect()} for h, g in ((10**6, 10**6), (9, 0)))
    assert whole == joined


def labelled_texts(spark, bad, n=300):
    rng = random.Random(6)
    plain = ["".join(rng.choice("klmnoprst") for _ in range(4)) for _ in range(150)]
    rows = []
    for i in range(n):
        label = int(i % 5 == 0)
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        for _ in range(4 if label else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int"), rows


def test_toxicity(spark, docs, nothing):
    known, rows = labelled_texts(spark, ["vile", "nasty", "grim"])
    part = F.col("doc_id") % 3
    got = {r["doc_id"]: r["score"] for r in toxicity(known, known.filter(part == 0).select("text", "label"), known.filter(part == 1).select("text", "label")).collect()}
    held = [(got[i], label) for i, _, label in rows if i % 3 == 2]
    assert np.mean([(s >= 0.3) == bool(label) for s, label in held]) > 0.95
    every = toxicity(docs, known.filter(part == 0).select("text", "label"), known.filter("doc_id < 0").select("text", "label"))
    assert every.count() == docs.count() and every.filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity(nothing, nothing.select("text", "label"), nothing.select("text", "label")).collect() == []


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "string", "date"])
def test_token_files_of_other_ids(spark, kind):
    value = "date_add(DATE'2020-01-01', int(id div 3))" if kind == "date" else f"CAST(id div 3 AS {kind})"
    docs = spark.range(30).selectExpr(f"CASE WHEN id % 5 > 0 THEN {value} END AS doc_id", "concat('text number ', id) AS text", "1 AS part")
    got = read_digests(write_token_files(docs, None, BYTES, shard_ids=40)).orderBy("start").collect()
    assert len(got) == 30 and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(30)]
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i if i is not None else 0))


def brute_ratios(counted, texts):
    """Sum of log ratios and distinct expressions of each text, with dictionaries."""
    def pairs_of(text):
        w = [x for x in re.split(r"[^\w]+|[\d_]+", (text or "").lower()) if x]
        return set(zip([None, *w], w, strict=False))

    words, pairs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for text, label in counted:
        own = pairs_of(text)
        for w in {w for _, w in own}:
            words[w][label] += 1
        for v, w in own:
            if v is not None:
                pairs[v, w][label] += 1
    d = 0.75
    total = [sum(c[k] for c in words.values()) for k in (0, 1)]
    freed = [sum(min(c[k], d) for c in words.values()) for k in (0, 1)]
    share = total[1] / sum(total)
    follows, heads, left = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0]), Counter()
    for (v, _), c in pairs.items():
        for k in (0, 1):
            heads[v][k] += c[k]
            left[v] += min(c[k], d)

    def weight(c):
        n = sum(c)
        return max(0.0, 1 - 9 / max((c[1] - n * share) ** 2 / max(n * share * (1 - share), 1e-9), 1e-9))

    def u(w, k):
        return (max(words[w][k] - d, 0) + freed[k] * (follows[w] + 0.5) / (len(pairs) + 0.5 * len(words))) / total[k]

    def ratio(v, w):
        if (v, w) in pairs and weight(pairs[v, w]):
            p = [max(pairs[v, w][k] - d, 0) / max(1, heads[v][k]) + left[v] / sum(heads[v]) * u(w, k) for k in (0, 1)]
            return np.log(p[1] / p[0]) * weight(pairs[v, w])
        return np.log(u(w, 1) / u(w, 0)) * weight(words[w]) if w in words else 0.0

    return [(sum(ratio(*e) for e in pairs_of(t)), len(pairs_of(t))) for t in texts]


def test_toxicity_model_equals_dictionaries(spark):
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("n", "r", "s", "da")]
    counted = []
    for i in range(400):
        label = int(i % 5 == 0)
        w = [rng.choice(words) for _ in range(rng.randrange(1, 25))]
        if label:
            w[rng.randrange(len(w)):0] = ["vile", rng.choice(["beast", "kan"])]
        counted.append((" ".join(w).title(), label))
    model = train(spark.createDataFrame(counted, "text string, label int").repartition(3))
    texts = [t for t, _ in counted[:60]] + ["", "unheard of things", "Vile vile, BEAST! kan-kan", "kan " * 4000]
    total, n = model.ratios(pa.array(texts, pa.large_string()))
    want = brute_ratios(counted, texts)
    assert n.tolist() == [k for _, k in want]
    assert np.allclose(total, [x for x, _ in want], atol=1e-9) and any(abs(x) > 1 for x, _ in want)


def test_quality_votes(spark, docs, nothing):
    known, rows = labelled_texts(spark, ["###", "&&&x", "%%%"])
    sample = known.filter("doc_id % 2 = 0").select("text", "label")
    got = {r["doc_id"]: r["score"] for r in quality_votes(known, sample).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(label) for i, _, label in rows if i % 2]) > 0.95
    every = quality_votes(docs, sample)
    assert every.count() == docs.count() and every.filter("score BETWEEN 0 AND 1").count() == docs.count()
    empty = {r["score"] for r in quality_votes(docs.filter("text IS NULL OR text = ''"), sample).collect()}
    assert list(empty) == [pytest.approx(sum(r[2] for r in rows if r[0] % 2 == 0) / 150)]
    assert {r["score"] for r in quality_votes(docs, sample.limit(0)).collect()} == {0.0}
    assert quality_votes(nothing, sample).collect() == []


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        assert at.columns == docs.columns
        counts.append(at.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    mixed = Counter(r["doc_id"] for r in at.collect())
    assert max(mixed.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    length = dict(zip(texts, map(len, ids_of(WORDS, list(texts.values()), 1)), strict=True))
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: n * length[i] for i, n in mixed.items()})


def test_toxicity_joins_what_workers_do_not_hold(spark, monkeypatch):
    from albumforge.llm import toxicity as tox

    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        label = int(i % 3 == 0)
        words = [f"w{k}" for k in rng.integers(0, 40, 12)] + ([f"bad{k}" for k in rng.integers(0, 6, 6)] if label else [f"good{k}" for k in rng.integers(0, 6, 6)])
        rows.append((i, " ".join(words), label))
    rows += [(240, None, 0), (241, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).cache()
    known = docs.filter("text IS NOT NULL")
    scores = lambda: {r["doc_id"]: r["score"] for r in tox.toxicity(docs, known.filter("doc_id % 2 = 0"), known.filter("doc_id % 2 = 1")).collect()}
    held = scores()
    monkeypatch.setattr(tox, "MOST_ENTRIES", 3)
    joined = scores()
    assert sorted(joined) == list(range(242)) and max(abs(joined[i] - held[i]) for i in held) < 1e-9
    assert max(held.values()) - min(held.values()) > 0.5
