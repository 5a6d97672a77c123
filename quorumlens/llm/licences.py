"""Licence scans: a sparse n-gram logistic regression over paragraphs, confirmed against templates.

A paragraph (a line of the text) has its distinct words, word pairs and word triples as features.
The regression has a class for each licence family and one for everything else; it is trained on the
driver from the templates below, cut, shortened and set among ordinary words, and from a bounded
sample of the corpus's own paragraphs, with an L1 penalty that leaves only telling n-grams. A
temperature fitted on held-out examples calibrates the probabilities; a paragraph whose best family
stays under LEAST is unknown. A prediction counts as confirmed if the paragraph shares enough word
pairs with a template of its family. Scoring is DataFrame functions throughout: 64-bit hashes of all
n-grams are exploded, joined with the weights (a bounded table) and summed by paragraph; texts are
read again only for the paragraphs predicted.

Defined results: a null or blank text has no paragraphs and the family "none"; a document with several
licences names all of them in found, and as its own the most probable confirmed one, then the most
probable one; of equal ones the first by name, then by line; a paragraph without a known n-gram has the
model's offsets as scores; paragraphs of any length are taken whole; repeated rows get a row each; an
empty table gives an empty table; other columns aren't passed on, so their names can't clash.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm.common import ascii_lower, forget, materialise, quoted, table

# Notices by which works commonly name their licence, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v2.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Sentences near to licences that name no family.
OTHERS = [
    "All rights reserved.",
    "This document is proprietary and confidential.",
    "A licence is required to fish in this river.",
    "Licensed under the Example Vendor Agreement, version 1.",
    "The driver lost her license after the second offence.",
    "Please read the license before you use the software.",
    "Permission is needed to enter the building, free of charge for members.",
    "The general public was admitted to the foundation.",
    "Redistribution of income is a matter of public debate.",
    "The apache helicopter, version 2, was built in the desert.",
    "Subject to the terms of your contract, you may not copy this file.",
    "Copyright by the author.",
]
UNKNOWN, NONE = "unknown", "none"
FAMILIES = sorted(TEMPLATES)
#: Paragraphs of the corpus that training takes as examples of no licence, their characters, and rows they are drawn from.
SAMPLE_PARAGRAPHS, SAMPLE_CHARS, SAMPLE_ROWS = 3000, 2_000_000, 400
COPIES, EPOCHS, RATE, PENALTY = 60, 30, 0.3, 2e-4
#: Examples that an n-gram must be in to be a feature.
SEEN = 3
#: Predicted paragraphs up to which they are broadcast (some 100 bytes each); beyond, they are joined by a shuffle.
FEW = 300_000
#: The probability that a family needs, and the share of common word pairs that confirms it.
LEAST, CONFIRMED = 0.5, 0.6
BREAKS = r"[^a-z0-9]+"


def ngrams_of(text: str) -> list[str]:
    """The same n-grams as ngrams(), for training."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split(BREAKS, lower) if x]
    return list(dict.fromkeys([" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]))


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    own = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[w[i + j] for j in range(n)]))
    return F.when(F.size(w) >= n, own).otherwise(F.array().cast("array<string>"))


def examples(others: list[str], seed: int = 5) -> tuple[list[str], list[int]]:
    """Training paragraphs and classes; the class after the families is unknown."""
    rng = random.Random(seed)
    filler = [w for t in others for w in t.split()] or ["text"]
    texts, classes = [], []
    for c, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            w = t.split()
            texts.append(t)
            classes.append(c)
            for _ in range(COPIES):
                own = [x for x in w if rng.random() > 0.08] if len(w) > 8 else list(w)
                if len(own) > 16 and rng.random() < 0.5:
                    at = rng.randrange(len(own) - 11)
                    own = own[at : at + rng.randrange(12, len(own) - at + 1)]
                before, after = ([rng.choice(filler) for _ in range(rng.randrange(12))] if rng.random() < 0.5 else [] for _ in range(2))
                texts.append(" ".join([*before, *own, *after]))
                classes.append(c)
    known = [set(ngrams_of(t)) for ts in TEMPLATES.values() for t in ts]
    for t in [*OTHERS * 20, *others]:
        own = {g for g in ngrams_of(t) if g.count(" ") == 1}
        if t in OTHERS or not any(len(own & k) >= 3 for k in known):  # the corpus's own licences aren't examples of none
            texts.append(t)
            classes.append(len(FAMILIES))
    return texts, classes


def train(others: list[str], seed: int = 5) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Weights of the n-grams that have any, the classes' offsets, and the temperature."""
    texts, classes = examples(others, seed)
    bags = [ngrams_of(t) for t in texts]
    seen: dict[str, int] = {}
    for b in bags:
        for g in b:
            seen[g] = seen.get(g, 0) + 1
    names = sorted(g for g, n in seen.items() if n >= SEEN)
    index = {g: i for i, g in enumerate(names)}
    rows = [np.array([index[g] for g in b if g in index], np.int64) for b in bags]
    y, k = np.array(classes), len(FAMILIES) + 1
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    weights, offset = np.zeros((len(names), k)), np.zeros(k)
    seen_w, seen_o = np.full_like(weights, 1e-2), np.full(k, 1e-2)

    def flat(ids):
        lens = np.array([len(rows[i]) for i in ids])
        return (np.concatenate([rows[i] for i in ids]) if len(ids) else np.zeros(0, np.int64)), np.repeat(np.arange(len(ids)), lens)

    def scores(ids):
        feats, own = flat(ids)
        out = np.tile(offset, (len(ids), 1))
        np.add.at(out, own, weights[feats])
        return out

    def softmax(s):
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    fit = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for ids in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            slope = (softmax(scores(ids)) - np.eye(k)[y[ids]]) / len(ids)
            feats, own = flat(ids)
            hit, where = np.unique(feats, return_inverse=True)
            grad = np.zeros((len(hit), k))
            np.add.at(grad, where, slope[own])
            seen_w[hit] += grad**2
            step = RATE / np.sqrt(seen_w[hit])
            new = weights[hit] - step * grad
            weights[hit] = np.sign(new) * np.maximum(0, np.abs(new) - step * PENALTY)
            seen_o += slope.sum(axis=0) ** 2
            offset -= RATE * slope.sum(axis=0) / np.sqrt(seen_o)
    check = np.flatnonzero(held)
    s = scores(check)
    losses = {t: -np.log(np.maximum(softmax(s / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in (0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    kept = {g: weights[i] for g, i in index.items() if weights[i].any()}
    return kept, offset, min(losses, key=losses.get)


def sampled(docs: DataFrame, text: str) -> list[str]:
    """At most SAMPLE_PARAGRAPHS paragraphs of some SAMPLE_ROWS rows, chosen and ordered by hashes of their texts."""
    n = docs.count()
    body = docs.select(F.col(quoted(text)).alias("text")).filter("text is not null")
    some = body.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * 1_000_000))
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").withColumn("h", F.xxhash64("line"))
    picked, left = [], SAMPLE_CHARS  # lengths first, so that no more than SAMPLE_CHARS characters reach the driver
    for r in lines.select("h", F.length("line").alias("chars")).distinct().orderBy("h").limit(SAMPLE_PARAGRAPHS).collect():
        if r["chars"] <= left:
            picked.append((r["h"],))
            left -= r["chars"]
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame(picked, "h long")
    return sorted(r[0] for r in lines.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"]).select("line").collect())


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, line, body) of each line that isn't blank."""
    body = F.col(quoted(text))
    rows = docs.filter(body.isNotNull()).select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    # outer, as else the optimiser would split every text twice, first for a filter on the number of lines
    return rows.select("doc_id", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("line", "body")).filter(F.col("body").rlike(r"[^\x20\x09-\x0D]"))


def families(docs: DataFrame, model: tuple[dict[str, np.ndarray], np.ndarray, float], *, doc_id: str, text: str, least: float) -> DataFrame:
    """(doc_id, text_hash, line, family, probability) of the paragraphs that have a family; a written table."""
    spark = docs.sparkSession
    weights, offset, heat = model
    k = len(offset)
    bare = np.exp((offset - offset.max()) / heat)
    named = bool(bare[:-1].max() >= bare[-1] and bare[:-1].max() >= least * bare.sum())  # what a paragraph without a known n-gram would get
    strings = spark.createDataFrame([(g.split(" "), [float(v) for v in w]) for g, w in sorted(weights.items())] or [(["\0"], [0.0] * k)], "words array<string>, weights array<double>")
    w = F.transform("words", lambda x: F.xxhash64(x))
    known = strings.withColumn("w", w).select(F.when(F.size("w") == 1, F.col("w")[0]).when(F.size("w") == 2, F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)))).otherwise(F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2)))).alias("gram"), "weights")
    nothing = spark.createDataFrame([(0, [0.0] * k)], known.schema) if named else known.limit(0)
    known = materialise(known.unionByName(nothing), "weights")  # bounded by the sample
    lines = paragraphs(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart, within this one job
    lines = lines.select("row", "doc_id", "text_hash", "line", F.transform(words(F.col("body")), lambda x: F.xxhash64(x)).alias("w")).withColumn("n", F.size("w"))

    def runs(span: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.col("n") - span), lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(span)]))
        return F.when(F.col("n") >= span, each).otherwise(F.array().cast("array<bigint>"))

    every = F.array_distinct(F.concat(F.col("w"), runs(2), runs(3), *([F.array(F.lit(0).cast("long"))] if named else [])))
    hit = lines.select("row", "doc_id", "text_hash", "line", F.explode_outer(every).alias("gram")).join(F.broadcast(known), "gram")
    by = hit.groupBy("row", "doc_id", "text_hash", "line").agg(*[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(k)])
    scores = [(F.col(f"s{i}") + F.lit(float(offset[i]))) / F.lit(float(heat)) for i in range(k)]
    by = by.withColumn("top", F.greatest(*scores)).withColumn("e", F.array(*[F.exp(s - F.col("top")) for s in scores]))
    best = F.array_max(F.slice("e", 1, k - 1))
    by = by.withColumn("best", best).withColumn("probability", F.col("best") / F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    by = by.filter((F.col("best") >= F.element_at("e", k)) & (F.col("probability") >= least))
    by = by.withColumn("family", F.element_at(F.lit(FAMILIES), F.array_position("e", F.col("best")).cast("int")))
    out = materialise(by.select("doc_id", "text_hash", "line", "family", "probability").dropDuplicates(["doc_id", "text_hash", "line"]), "families")
    forget(known)
    return out


def licence_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, confirmed: float = CONFIRMED) -> DataFrame:
    """Every paragraph with a family: doc_id, text_hash, line, family, probability, similarity, confirmed; repeated rows count once."""
    found = families(docs, train(sampled(docs, text)), doc_id=doc_id, text=text, least=least)
    few = found.count() <= FEW
    spark = docs.sparkSession
    shapes = spark.createDataFrame([(f, [g for g in ngrams_of(t) if g.count(" ") == 1]) for f in FAMILIES for t in TEMPLATES[f]], "family string, pairs array<string>")
    shapes = shapes.groupBy("family").agg(F.collect_list("pairs").alias("shapes"))  # the templates above, no more
    same = F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash and a.line = b.line")
    bodies = paragraphs(docs, doc_id, text).alias("a").join((F.broadcast(found) if few else found).alias("b"), same).select("b.*", "a.body")
    bodies = bodies.withColumn("w", words(F.col("body"))).withColumn("pairs", F.array_distinct(grams(F.col("w"), 2))).join(F.broadcast(shapes), "family")
    alike = F.array_max(F.transform("shapes", lambda s: F.size(F.array_intersect("pairs", s)) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.size(s)))))
    out = bodies.withColumn("similarity", F.coalesce(alike, F.lit(0.0))).withColumn("confirmed", F.col("similarity") >= confirmed)
    return out.select("doc_id", "text_hash", "line", "family", "probability", "similarity", "confirmed").dropDuplicates(["doc_id", "text_hash", "line"])


def licences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, confirmed: float = CONFIRMED) -> DataFrame:
    """For each row of docs: doc_id, n_paragraphs, n_licences (confirmed paragraphs), family, probability, similarity, confirmed, line of the best, and found, all of them by line."""
    each = licence_paragraphs(docs, doc_id=doc_id, text=text, least=least, confirmed=confirmed)
    told = F.struct("line", "family", "probability", "similarity", "confirmed")
    order = F.struct(F.col("confirmed"), F.col("probability"), F.col("similarity"), (-F.col("line")).alias("place"))
    by = each.groupBy("doc_id", "text_hash").agg(F.count_if("confirmed").cast("long").alias("n_licences"), F.max_by(told, order).alias("b"), F.array_sort(F.collect_list(told)).alias("found"))
    by = materialise(by, "licences")
    body = F.col(quoted(text))
    n = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(body).alias("text_hash"), n.alias("n_paragraphs"))
    both = rows.alias("a").join(by.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash"), "left")
    none = by.schema["found"].dataType
    return both.select("a.doc_id", "a.n_paragraphs", F.coalesce("b.n_licences", F.lit(0).cast("long")).alias("n_licences"), F.coalesce("b.b.family", F.lit(NONE)).alias("family"), "b.b.probability", "b.b.similarity", F.coalesce("b.b.confirmed", F.lit(False)).alias("confirmed"), "b.b.line", F.coalesce("b.found", F.array().cast(none)).alias("found"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
