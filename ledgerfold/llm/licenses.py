"""Licence scans by a trained paragraph classifier, scored in DataFrame operations only.

Training (driver, NumPy, seeded; the data are the templates below, so it is
bounded): softmax regression with an L1 term over word unigrams and bigrams of
perturbed templates, with a class "unknown" trained on prose and on shuffled
licence words. A temperature fitted on perturbations held out calibrates the
probabilities. Scoring: lines are joined to paragraphs, as notices are wrapped:
a line goes on in the next one unless it ends a sentence or a blank line (or an
empty comment line) follows. Each paragraph is scored by its n-grams' sparse
weights (one with common words only has none and is passed over), and its lines one by one if the whole is of no family; a family with
MIN_PROBABILITY or more is predicted, and confirmed if half the paragraph's
bigrams or more are in that family's templates. Paragraphs without a family
that hold words of a notice (anchors, licence names) may be of a licence
outside the families, or too short to tell; they are counted.

All scoring is inside the row: no shuffle and no join. The model is a literal
of some hundred n-grams, dealt into hash buckets so that a look-up walks a
short map.

Defined results: null text is empty and has no licence; a hit is named by the
line (from 0) its paragraph or line begins at; equal paragraphs count each;
extra columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices, by family.
TEMPLATES = {
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache License 2.0.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the BSD license.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0 or later.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "creative-commons": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution-ShareAlike License CC BY-SA 3.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher.",
    ],
}
#: Prose that uses licence words without granting anything.
PROSE = [
    "The driver lost his license after the accident and had to ask for permission to travel.",
    "She asked permission to leave early because the meeting had already run for two hours.",
    "The museum paid for the copyright of the photograph and printed it on the cover.",
    "A business license costs forty dollars in this county and has to be renewed every year.",
    "The warranty on the washing machine covers parts and labour for two years.",
    "They fought for equal rights and for the redistribution of land among the farmers.",
    "The redistribution of heat in the ocean has consequences for the weather in Europe.",
    "Our proprietary recipe has been in the family since the restaurant opened.",
    "Fishing without a license is a crime in the state and may lead to a fine.",
    "The court ruled that the sheriff had no warrant to search the house.",
    "You need written permission from your parents to join the trip to the mountains.",
    "Copyright law differs from country to country and changes with every new medium.",
]
#: Notices of other families, which are to stay unknown.
OTHERS = [
    "Made available under the Common Public License, version 1.0.",
    "Released under the European Union Public Licence, version 1.2 or later.",
    "Distributed under the terms of the Sun Public License.",
    "Licensed under the Artistic License 2.0.",
    "Released under the Boost Software License, Version 1.0.",
    "Licensed under the zlib license.",
    "Distributed under the ISC License.",
    "This file is available under the terms of the Q Public License.",
    "Released into the public domain by its author.",
]
#: A paragraph of no family counts as unknown notice with one of these in it, or one of the names as a word.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "warrant", "all rights", "proprietary")
NAMES = r"(?:^|[^a-z0-9])(?:public domain|creative commons|cc by|cc0|unlicense|[al]?gpl|mpl|epl|cddl|isc|bsd|gnu|mozilla public)(?:$|[^a-z])"
#: Words that any text holds: alone, or next to each other, they are no features.
COMMON = frozenset("a all an and any are as at be by either for from have if in is it may not of on or other such that the this to under use used was will with without you your been because no our she he his it its they 0 1 2 3 4".split())
UNKNOWN, MIN_PROBABILITY, MIN_SHARED, BUCKETS = "unknown", 0.6, 0.5, 64


def grams(text: str) -> list[str]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def _examples(rng: np.random.Generator, each: int) -> list[tuple[str, int]]:
    filler = " ".join(PROSE).lower().split()
    out = []
    for k, texts in enumerate(TEMPLATES.values()):
        for j in range(each):
            w = texts[j % len(texts)].split()
            if len(w) > 12 and rng.random() < 0.5:  # part of a long notice
                size = int(rng.integers(10, len(w) + 1))
                a = int(rng.integers(0, len(w) - size + 1))
                w = w[a : a + size]
            if len(w) > 6:
                drop = rng.choice((0.08, 0.25))
                w = [x for x in w if rng.random() > drop]
            w = list(rng.choice(filler, int(rng.integers(0, 4)))) + w + list(rng.choice(filler, int(rng.integers(0, 4))))
            out.append((" ".join(w), k))
    legal = " ".join(t for texts in TEMPLATES.values() for t in texts).split()
    for j in range(3 * each):
        if j % 3 == 0:
            w = rng.choice(legal, int(rng.integers(3, 30))) if j % 2 else OTHERS[int(rng.integers(len(OTHERS)))].split()
        elif j % 3 == 1:
            w = PROSE[int(rng.integers(len(PROSE)))].split()
            if rng.random() < 0.5:  # a few legal words on end, in other text
                a = int(rng.integers(0, len(legal) - 5))
                w = [*rng.choice(filler, 6), *legal[a : a + int(rng.integers(2, 5))], *rng.choice(filler, 6)]
        else:
            w = [*rng.choice(filler, int(rng.integers(2, 40))), *rng.choice(legal, int(rng.integers(0, 3)))]
        out.append((" ".join(w), len(TEMPLATES)))
    return out


def _matrix(examples, index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(examples), len(index)), np.float32)
    for i, (text, _) in enumerate(examples):
        for g in grams(text):
            if g in index:
                x[i, index[g]] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def train(each: int = 1000, steps: int = 500, l1: float = 1e-4) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, calibrated weights by n-gram, calibrated biases). Proximal gradient steps with momentum."""
    classes, rng = [*TEMPLATES, UNKNOWN], np.random.default_rng(11)
    fit, held = _examples(rng, each), _examples(rng, each // 4)
    seen = {g for texts in (*TEMPLATES.values(), PROSE, OTHERS) for t in texts for g in grams(t)}
    vocabulary = sorted(g for g in seen if not COMMON.issuperset(g.split()))
    index = {g: k for k, g in enumerate(vocabulary)}
    x, y = _matrix(fit, index), np.eye(len(classes), dtype=np.float32)[[k for _, k in fit]]
    w, b = np.zeros((len(index), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    ahead, rate = w.copy(), 1.0
    for step in range(1, steps + 1):
        g = _softmax(x @ ahead + b) - y
        new = ahead - rate * (x.T @ g) / len(x)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        b -= rate * g.mean(axis=0)
        ahead, w = new + (step - 1) / (step + 2) * (new - w), new
    z, truth = _matrix(held, index) @ w + b, [k for _, k in held]
    loss = lambda t: -np.log(_softmax(z * t)[np.arange(len(z)), truth] + 1e-12).mean()
    t = min(np.linspace(0.3, 3, 28), key=loss)
    live = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return classes, {vocabulary[k]: [round(float(v), 4) for v in w[k] * t] for k in live}, [round(float(v), 4) for v in b * t]


def any_word(words) -> str:
    """A pattern for any of the words, standing alone: a tree by letters, so that other words fail at their first ones."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in [*w, ""]:
            at = at.setdefault(c, {})

    def of(node: dict) -> str:
        if node == {"": {}}:
            return ""
        parts = [re.escape(c) + of(x) for c, x in sorted(node.items()) if c]
        whole = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return whole + ("?" if "" in node else "")

    return f"(?<![a-z0-9]){of(tree)}(?![a-z0-9])"


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def has_anchor(text: Column) -> Column:
    out = F.lit(False)
    for a in ANCHORS:
        out = out | F.contains(text, F.lit(a))
    return out


def is_notice(text: Column) -> Column:
    return has_anchor(text) | F.rlike(text, F.lit(NAMES))


def bucket_of(gram: str) -> int:
    """Sum of the text's first and last code and its length; the same in Spark as here."""
    return (ord(gram[0]) * 7 + ord(gram[-1]) * 3 + len(gram)) % BUCKETS


def _classify(line: Column, classes: list[str], tables: Column, bias: Column, templates: Column, telling: Column) -> Column:
    """struct(family, probability, confirmed) of a lower-cased paragraph; family is null for unknown."""
    def of_grams(g: Column) -> Column:
        code = lambda x: (F.ascii(x) * 7 + F.ascii(F.substring(x, -1, 1)) * 3 + F.length(x)) % BUCKETS
        weights = F.filter(F.transform(g["all"], lambda x: F.try_element_at(F.get(tables, code(x)), x)), lambda v: v.isNotNull())
        logits = F.aggregate(weights, bias, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))

        def of_logits(z: Column) -> Column:
            best = F.array_position(z, F.array_max(z)).cast("int")
            probability = 1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max(z)))
            family = F.get(F.array(*[F.lit(c) for c in classes]), best - 1)

            def of_family(f: Column) -> Column:
                shared = F.size(F.array_intersect(g["pairs"], F.coalesce(F.try_element_at(templates, f["family"]), F.array().cast("array<string>"))))
                known = (f["family"] != UNKNOWN) & (f["probability"] >= MIN_PROBABILITY)
                return F.struct(F.when(known, f["family"]).alias("family"), f["probability"].alias("probability"), (known & (shared >= MIN_SHARED * F.size(g["pairs"]))).alias("confirmed"))

            return _let(F.struct(family.alias("family"), probability.alias("probability")), of_family)

        return _let(logits, of_logits)

    def of_words(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))).otherwise(F.array().cast("array<string>"))
        return _let(F.struct(F.concat(F.array_distinct(w), pairs).alias("all"), pairs.alias("pairs")), of_grams)

    none = F.struct(F.lit(None).cast("string").alias("family"), F.lit(0.0).alias("probability"), F.lit(False).alias("confirmed"))
    return F.when(F.rlike(line, telling), _let(F.regexp_extract_all(line, F.lit("[a-z0-9]+"), F.lit(0)), of_words)).otherwise(none)


#: A line break inside a paragraph: no sentence ends before it, and the next line has text.
WRAPPED, INNER = r"(?<=[^\s.!?:#*/])[ \t\r]*\n(?![ \t\r#*/;-]*(?:\n|$))", "\x01"


def _paragraphs(text: Column) -> Column:
    """Array of struct(lines joined by INNER, at): the paragraphs of a text and the line each begins at."""
    marked = F.regexp_replace(F.translate(text, INNER, " "), WRAPPED, f"\n{INNER}")  # lines that go on begin with INNER
    begins = F.filter(F.transform(F.split(marked, "\n", -1), lambda x, i: F.when(~F.startswith(x, F.lit(INNER)), i)), lambda i: i.isNotNull())
    whole = F.split(F.replace(marked, F.lit(f"\n{INNER}"), F.lit(INNER)), "\n", -1)
    return _let(F.struct(whole.alias("whole"), begins.alias("begins")), lambda p: F.transform(p["whole"], lambda x, k: F.struct(x.alias("lines"), F.get(p["begins"], k).alias("at"))))


def scan(docs: DataFrame) -> DataFrame:
    """docs plus n_licenses, n_confirmed, families (sorted, comma-joined), best_probability, hits (line:family:confirmed), n_unknown (notices of no family)."""
    classes, weights, bias = train()
    tables: list[dict] = [{} for _ in range(BUCKETS)]
    for g, v in weights.items():
        tables[bucket_of(g)][g] = v
    pairs = {f: sorted({g for t in texts for g in grams(t) if " " in g}) for f, texts in TEMPLATES.items()}
    new = ("n_licenses", "n_confirmed", "families", "best_probability", "hits", "n_unknown")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    telling = F.lit(any_word({w for g in weights for w in g.split() if w not in COMMON}))
    model = _literal(tables, "array<map<string,array<double>>>"), _literal(bias, "array<double>"), _literal(pairs, "map<string,array<string>>"), telling
    scored = lambda x, at: F.struct(at.alias("at"), _classify(x, classes, *model).alias("c"), is_notice(x).alias("notice"))
    split = lambda p: F.transform(F.split(p["lines"], INNER, -1), lambda x, k: scored(x, p["s"]["at"] + k))

    def of_text(text: Column) -> Column:
        each = F.transform(_paragraphs(text), lambda p: F.struct(p["lines"].alias("lines"), scored(p["lines"], p["at"]).alias("s")))
        return F.flatten(F.transform(each, lambda p: F.when(p["s"]["c"]["family"].isNull() & F.contains(p["lines"], F.lit(INNER)), split(p)).otherwise(F.array(p["s"]))))

    # A text without a telling word and without a notice's has neither a family nor an unknown notice.
    found = _let(F.lower(F.coalesce(F.col("text"), F.lit(""))), lambda x: F.when(F.rlike(x, telling) | is_notice(x), of_text(x)))
    of_hits = lambda h, n_unknown: F.struct(
        F.greatest(F.size(h), F.lit(0)).cast("long").alias("n_licenses"),
        F.greatest(F.size(F.filter(h, lambda x: x["c"]["confirmed"])), F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["c"]["family"]))), ","), F.lit("")).alias("families"),
        F.coalesce(F.array_max(F.transform(h, lambda x: x["c"]["probability"])), F.lit(0.0)).alias("best_probability"),
        F.coalesce(F.array_join(F.transform(h, lambda x: F.concat_ws(":", x["at"].cast("string"), x["c"]["family"], x["c"]["confirmed"].cast("string"))), ","), F.lit("")).alias("hits"),
        n_unknown.alias("n_unknown"),
    )
    is_hit = lambda x: x["c"]["family"].isNotNull()
    of_found = lambda f: _let(F.filter(f, is_hit), lambda h: of_hits(h, F.greatest(F.size(F.filter(f, lambda x: ~is_hit(x) & x["notice"])), F.lit(0)).cast("long")))
    # A generator's row is made once; a struct that is taken apart would be made again for each of its fields.
    return docs.select(*own, F.inline(F.array(_let(found, of_found))))
