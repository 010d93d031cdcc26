"""License scans: base phrases by place, and template containment as an exact set-similarity join.

A text block is any run of so many consecutive words, wherever lines break: a
quarter more words than the template has. A template is found in a block that
holds at least ``share`` of its distinct words, and among them all those that
tell it from other licences. Words are ordered by how many texts hold them,
rarest first; a block can only reach the share if it holds one of the template's
first words in that order (prefix), and has enough of its words around that one
(length and position). Only such places are looked at closely.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumforge.llm.common import clashing, text_or_empty, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Template(NamedTuple):
    """A label, opening words of the licence, and those of them that a block must hold."""

    label: str
    text: str
    required: str

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def span(self) -> int:
        return len(self.text.split()) * 5 // 4


#: Opening words of public licences.
TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", "affero license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license 2"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org", "apache compliance license"),
    Template("artistic-2.0", "released under the terms of the artistic license 2 0", "artistic license 2"),
    Template("boost-1.0", "distributed under the boost software license version 1 0", "boost license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary forms permitted"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc sa"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "commons sharealike license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright rights"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general redistribute license"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general license 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission copy distribute fee granted"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge obtaining"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "provided implied authors liable damages"),
)

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    """The words of lower-cased text, in order."""
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _base(docs: DataFrame) -> DataFrame:
    """Places of the base phrases. The word array is walked only where the phrase's first and last words occur at all."""
    maybe = F.lit(False)
    for phrase, _ in PHRASES:
        first, last = phrase.split()[0], phrase.split()[-1]
        maybe = maybe | (F.contains("lower", F.lit(first)) & F.contains("lower", F.lit(last)))
    w = docs.withColumn("maybe", maybe)

    def at(i: Column, phrase: str) -> Column:
        parts = phrase.split()
        test = F.get(F.col("words"), i).eqNullSafe(parts[0])
        for k, part in enumerate(parts[1:], 1):
            test = test & F.get(F.col("words"), i + k).eqNullSafe(part)
        return test

    def where(phrase: str) -> Column:
        return F.when(F.col("maybe"), F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: at(i, phrase)))

    places = {label: where(phrase) for phrase, label in PHRASES}
    found = w.select("*", *[F.coalesce(c, F.array().cast("array<int>")).alias(f"at_{label}") for label, c in places.items()])
    every = F.flatten(F.array(*[F.col(f"at_{label}") for label in places]))
    labels = F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in places])
    return found.select("doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_compact(labels)).alias("base"), "known")


def blocks_found(known: DataFrame, key: list[str], templates: tuple[Template, ...] = TEMPLATES, share: float = 0.8) -> DataFrame:
    """``key``, label and containment of the best block around every place that can start a match.

    ``known``: the key columns and ``known``, the places and words (pos, word)
    of a text's words that occur in any template, in order; others can't add to
    an overlap.
    """
    spark = known.sparkSession
    # At most one row for each distinct word of the templates, a constant of this module.
    held = {r["word"]: r["n"] for r in known.select(F.explode(F.array_distinct("known.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = []
    for t, template in enumerate(templates):
        ordered = sorted(template.words, key=lambda w: (held.get(w, 0), w))
        need = ceil(share * len(ordered) - 1e-9)
        index += [(t, template.label, word, ordered, template.required.split(), need, template.span) for word in ordered[:len(ordered) - need + 1]]
    prefix = spark.createDataFrame(index, "template int, label string, word string, words array<string>, required array<string>, need int, span int")
    first, most = F.array(*map(F.lit, sorted({x[2] for x in index}))), max(x[-1] for x in index)
    # Known words ascend by place: those in reach of a prefix word are at most so many before and behind it.
    places = F.filter(F.sequence(F.lit(0), F.size("known") - 1), lambda i: F.array_contains(first, F.get(F.col("known"), i)["word"]))
    around = F.transform(places, lambda i: F.struct(F.get(F.col("known"), i).alias("at"), F.slice("known", F.greatest(i + 2 - most, F.lit(1)), F.lit(2 * most)).alias("near")))
    probe = known.filter(F.size("known") > 0).select(*key, F.explode(around).alias("hit")).select(*key, F.col("hit.at.word").alias("word"), F.col("hit.at.pos").alias("pos"), "hit.near")
    near = F.filter("near", lambda x: (F.abs(x["pos"] - F.col("pos")) < F.col("span")) & F.array_contains("words", x["word"]))
    pairs = probe.join(F.broadcast(prefix), "word").withColumn("near", near).filter(F.size(F.array_distinct("near.word")) >= F.col("need"))

    def block(s: Column) -> Column:
        """Distinct words of the template in the block that begins at ``s``."""
        inside = F.filter("near", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("span")))
        return F.array_distinct(F.transform(inside, lambda x: x["word"]))

    blocks = F.transform(F.filter("near", lambda s: s["pos"] <= F.col("pos")), block)
    right = F.filter(blocks, lambda b: (F.size(b) >= F.col("need")) & (F.size(F.array_except("required", b)) == 0))
    best = pairs.withColumn("best", F.array_max(F.transform(right, lambda b: F.size(b))))
    return best.filter("best IS NOT NULL").select(*key, "label", (F.col("best") / F.size("words")).alias("containment"))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 templates: tuple[Template, ...] = TEMPLATES, share: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: word count, places of base phrases, labels, and a score.

    The score is 1 where a base phrase stands, else the largest containment of
    a template found, else 0. A null text counts as empty: no words, no labels.
    Very long texts are searched whole. Null ids and equal rows stay; other
    columns are left out.
    """
    vocabulary = F.array(*map(F.lit, sorted({w for t in templates for w in t.words})))
    text = clashing(docs, id_column, text_column).select(
        F.col(id_column).alias("doc_id"), F.translate(text_or_empty(text_column), _UPPER, _LOWER).alias("lower"), F.monotonically_increasing_id().alias("row"))
    # Most texts lack some required word of every template, which is found without cutting them into words.
    maybe = reduce(or_, [reduce(and_, [F.contains("lower", F.lit(w)) for w in t.required.split()]) for t in templates])
    worded = text.select("doc_id", "row", "lower", maybe.alias("maybe_template"), _words(F.col("lower")).alias("words"))
    known = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains(vocabulary, x["word"]))
    counted = worded.select("doc_id", "row", "lower", "words", F.size("words").cast("long").alias("n_words"), F.when(F.col("maybe_template"), known).alias("known"))
    narrow = written(_base(counted), "license-base")
    found = blocks_found(narrow.filter("known IS NOT NULL").select("row", "known"), ["row"], templates, share)
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    joined = narrow.drop("known").join(by_row, "row", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
