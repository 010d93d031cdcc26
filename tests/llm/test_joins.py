"""Near copies, vectors, licences: against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from albumforge.llm.graph import components
from albumforge.llm.license_scan import TEMPLATES, license_scan
from albumforge.llm.ngram_join import ngram_jaccard_join
from albumforge.llm.vantage import Tree, nearest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("hot_class", [15, 1])
def test_join_equals_brute_force(docs, rows, hot_class):
    got = ngram_jaccard_join(docs, hot_class=hot_class).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_near_copies_keep_one_row_of_each_group(spark, rows, framed):
    # A third of the ids null, the others shared by rows with different texts.
    own = [(None if i % 3 == 0 else i // 4, *r[1:]) for i, r in enumerate(rows)]
    sets = [shingles(r[1]) for r in own]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, r in zip(group, own, strict=True):
        first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    docs = framed(own)
    got = corpus_pipeline.near_copies(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    of_text = {r[1]: g for g, r in zip(group, own, strict=True) if shingles(r[1])}
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert Counter((of_text[t], i is None, i or 0) for i, t in kept if t in of_text) == Counter((g, *first[g]) for g in set(of_text.values()))
    assert Counter(x for x in kept if x[1] not in of_text) == Counter((r[0], r[1]) for r in own if not shingles(r[1]))


def test_join_of_nothing(nothing):
    assert ngram_jaccard_join(nothing).collect() == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[40:90] = x[40]
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [1.0] * 7 + [None], 0), (1080, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest(df, shard_rows=64, block_rows=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 20):
        scores = x @ x[q]
        want = [i for i in np.lexsort((np.arange(300), -np.round(scores, 12))) if i != q][:20]
        mine = sorted(got.pop(q))
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1] for m in mine] == want
        assert np.allclose([m[2] for m in mine], scores[want])
    assert not got


def test_nearest_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(few).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]


def test_relaxed_search_keeps_most():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, q = Tree(np.hstack([x, np.zeros((4000, 1))]), np.arange(4000), 64), np.arange(50)
    queries = np.hstack([x[q], np.zeros((50, 1))])
    exact, relaxed = tree.search(queries, q, 10, 1.0)[0], tree.search(queries, q, 10, 2.0)[0]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed, strict=True)]) >= 0.9


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for template in TEMPLATES:
        own, required = set(template.words), set(template.required.split())
        for i in range(len(w)):
            block = set(w[i:i + template.span])
            if required <= block and 10 * len(block & own) >= 8 * len(own):
                labels.add(template.label)
                best = max(best, len(block & own) / len(own))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if places else best, 9))


HEADERS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions""",
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that""",
    "apache-2.0": """Licensed under the Apache
License, Version 2.0 (the "License");""",
    "unlicense": "This is free and unencumbered software released\ninto the public domain.",
}
NEAR_MISSES = {
    "Licensed under the GNU General Public License": "gpl",
    "This work is licensed under a Creative Commons Attribution license": "",
    "the new album was released under pressure and the driver had no license": "",
    "released " + "word " * 30 + "under the MIT license": "mit",
    "MIT " + "word " * 30 + "released under the license": "",
    "Permission to copy this text is granted; the software is free of charge.": "",
    "released under the M\u0130T license, or the \u212aMIT one": "",
}


def test_scan_equals_brute_force(docs, rows, nothing, framed):
    whole = [t.text for t in TEMPLATES]
    more = whole + [" ".join(x.split()[1:]) for x in whole] + [" ".join(x.split()[:-3]) for x in whole] + [x.replace(" ", "\n* ").upper() for x in whole]
    more += list(HEADERS.values()) + list(NEAR_MISSES) + ["the license of the " * 3000 + whole[17] + " the license" * 3000]
    more = [(5000 + i, t, None, None) for i, t in enumerate(more)]
    got = license_scan(docs.unionByName(framed(more))).collect()
    mine = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in got)
    assert mine == Counter((r[0], *brute_scan(r[1])) for r in [*rows, *more])
    assert license_scan(nothing).collect() == []


def test_scan_finds_wrapped_headers_and_tells_licences_apart(spark):
    own = [*HEADERS.values(), *NEAR_MISSES]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()}
    assert [got[i] for i in range(len(own))] == [*HEADERS, *NEAR_MISSES.values()]
