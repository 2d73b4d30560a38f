"""Licence families of paragraphs: a trained classifier, calibrated unknown classes, and a comparison with templates.

Features are the word one-, two- and three-grams of the training paragraphs, sparse and binary. A multinomial logistic regression is trained here, on
paragraphs made from the templates (words dropped, other words around them, sentences cut), from names of licences in the sentences by which
works are put under one (`FRAMES`, in five languages), and on two further classes: `unknown`, statements of licences that are none of the families, and
`none`, prose that only uses such words. `EXAMPLES` of each class are a fixed and documented bound; a second such sample, which the
regression never saw, calibrates it: a temperature for the probabilities, and per family the least probability at which 99.5 % of predictions are right; what
lies below is unknown. A predicted family counts only if one of its templates or names shares `SHARED` of its n-grams with the paragraph, else the
paragraph is unknown too. What is predicted as `none` isn't reported, nor as unknown where the line shows none of the forms of a statement (`_FORMAL`).

A paragraph is a line, or a run of neighbouring lines that hold a cue or template three-grams (texts wrapped by hand); lines of over `LONG` words are taken
sentence by sentence. The classifier reads every line that holds a cue, a word of any licence statement (`CUES`) or a template three-gram; other lines hold nothing that it
could tell from prose. All words of whole texts are read.

Defined results: null and empty texts have no licences; very long texts are read whole; each row is read alone, so repeated rows, null ids and other
columns pass unchanged, but for a column named as the result; of equal probabilities the family first in the alphabet wins; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import small_batches, strings

EXAMPLES = 150
SHARED = 0.6
PRECISION = 0.995
LONG = 60
UNKNOWN, NONE = "unknown", "none"

#: The sentences by which each licence family is granted or recognised.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "SPDX-License-Identifier: Unlicense"],
}
#: What the families are called.
NAMES: dict[str, list[str]] = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License Version 2.0", "Apache License v2"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD licensed", "licence BSD"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0", "Creative Commons Zero"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2", "GNU GPL version 2.0", "GNU General Public License v2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3.0 or later", "GPL-3.0", "GPLv3", "GNU GPL v3", "GNU General Public License v3.0", "GNU GENERAL PUBLIC LICENSE Version 3"],
    "isc": ["ISC License", "ISC licence", "ISC licensed"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL v2.1", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "GNU Lesser General Public License, version 3"],
    "mit": ["MIT License", "MIT licence", "MIT Lizenz", "MIT licensed", "licence MIT", "licencia MIT", "The MIT License (MIT)", "Expat License"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["The Unlicense", "Unlicense"],
}
#: Licences that are none of the families, and statements that grant nothing.
OTHERS = [
    "Eclipse Public License 2.0", "EPL-2.0", "Boost Software License 1.0", "zlib License", "GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "Artistic License 2.0", "CC BY-ND 4.0",
    "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-NC-ND 4.0", "European Union Public Licence 1.2", "Common Development and Distribution License", "Microsoft Public License", "Open Software License 3.0", "Python Software Foundation License", "WTFPL",
    "Business Source License 1.1", "Server Side Public License", "SIL Open Font License 1.1", "Open Database License", "Commons Clause", "Acme Software License", "Community License Agreement", "Research License", "commercial license", "proprietary license",
]
STATEMENTS = [
    "All rights reserved. This software is proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited", "No part of this publication may be reproduced without written permission of the publisher",
    "This software may not be copied or distributed without a written agreement with the vendor", "Use is subject to the terms of the end user license agreement",
]
#: Sentences that put a work under a licence.
FRAMES = [
    "{}", "{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This project is licensed under the {}", "This work is licensed under a {}", "This software is available under the terms of the {}",
    "See the LICENSE file for details ({})", "License: {}", "License {}", "SPDX-License-Identifier: {}", "Code is under {} license", "published under {}", "dual licensed, {} applies here", "lizenziert unter {}", "unter der Lizenz {}", "veröffentlicht unter der {}", "sous licence {}",
    "publié sous la licence {}", "bajo la licencia {}", "publicado bajo {}", "con licenza {}", "rilasciato sotto licenza {}", "You may use it under the {}", "Copyright 2020 the authors. {}", "Subject to the {}", "covered by the {}",
]
#: Plain prose about licences and other matters, which is no grant.
_PROSE = [
    "the driver has to show a license before the car is handed over to him",
    "she asked for a copy of the agreement and read the terms with care",
    "all rights to the film are held by the studio and the public was not admitted",
    "the general public may visit the garden free of charge on the first sunday of the month",
    "the software was distributed to the schools without any warranty of success",
    "permission was granted by the city to use the old hall for the concert",
    "version two of the paper was published by the foundation in the spring",
    "this work is dedicated to my mother and to the people of the village",
    "under the law the owner may not sell or modify the house without notice",
    "the source of the river was found in the mountains by two men of the village",
    "he lost his driving licence after the accident and took the bus for a year",
    "the restaurant has a license to sell wine and beer until midnight",
    "students at MIT built a boat that sails without a crew",
    "an Apache helicopter flew over the valley in the morning",
    "the boost to trade was the work of the new minister",
    "the bar lost its license and had to close at the end of the month",
    "they were granted a fishing license for the lake and its rivers",
    "the copyright office moved to another street last year",
    "the doctor was licensed to practise in two states",
    "der Fahrer muss seine Lizenz vorzeigen bevor er den Wagen bekommt",
    "wir fahren mit dem Zug in die Stadt und kommen mit dem Bus zurück",
    "mit der neuen Lizenz darf der Verein auch im Winter spielen",
    "la licence de pêche coûte vingt euros par an",
    "la licencia de obras fue concedida por la ciudad",
    "the committee read the first version of the paper and asked for a second one",
    "members of the public domain group met at the old mill",
]
#: Words, in the forms they are written in, at least one of which stands in any statement of a licence.
CUES = frozenset(
    "license licenses licensed licence licences licenced licensing lizenz lizenziert lizenzen licencia licenza licencias copyright copyrights copyrighted copyleft spdx gpl gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 mpl cc0 commons "
    "unlicense unencumbered redistribution redistributions redistribute proprietary wtfpl zlib gnu eula reserved confidential unauthorized".split()
)
#: Abbreviations that are words elsewhere, and so are cues only in capitals.
_CAPITAL_CUE = re.compile(r"\bCC[ -](?:BY|0)\b|\b(?:BSD|ISC|EPL)-\d|\bApache[ -]2")

#: What a statement of a licence that no family claims must show at least: a licence by name, a work put under one, or rights kept.
_FORMAL = re.compile(
    r"\b(?:[A-Z][\w.+-]*|[a-z]*[0-9][\w.-]*|zlib) (?:Software |Public |Open |General )*Licen[cs]e\b|(?i:\b(?:licen[cs]ed|lizenziert|released|distributed|published|available|made available) (?:under|unter)\b|\bunter der lizenz\b|\bsous (?:la )?licence\b"
    r"|\bbajo (?:la )?licencia\b|\blicen[cs]e (?:agreement|version)\b|\blicen[cs]e: |\brights reserved\b|\bproprietary\b|\bunauthorized copying\b|\bspdx\b|\bwtfpl\b|\ba?l?gpl)"
)

_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(own: list[str]) -> set[tuple[str, ...]]:
    return {g for n in (1, 2, 3) for g in zip(*(own[k:] for k in range(n)), strict=False)}


class Rows:
    """Sparse binary rows: the features of each, one after the other, with the place of the first."""

    def __init__(self, rows: list[np.ndarray]):
        size = np.array([len(r) for r in rows])
        self.feature = np.concatenate(rows)
        self.start = np.cumsum(size) - size
        self.row = np.repeat(np.arange(len(rows)), size)
        by = np.argsort(self.feature, kind="stable")
        self.by_feature, ordered = self.row[by], self.feature[by]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.known = ordered[self.first]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.feature], self.start, axis=0)

    def transposed_times(self, residual: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, residual.shape[1]), residual.dtype)
        out[self.known] = np.add.reduceat(residual[self.by_feature], self.first, axis=0)
        return out


class Classifier:
    """The trained and calibrated model; training is deterministic."""

    def __init__(self):
        self.families = [*sorted(TEMPLATES), NONE, UNKNOWN]
        self.templates = {f: [words(t) for t in TEMPLATES[f]] for f in TEMPLATES}
        self.thirds = {g for own in self.templates.values() for t in own for g in grams(t) if len(g) == 3}
        # A template is compared by its three-grams, a name or a shorter template by grams of its own length, up to two.
        self.shapes = {f: [{g for g in grams(t) if len(g) == (3 if len(t) > 6 else min(2, len(t)))} for t in [*own, *map(words, NAMES[f])]] for f, own in self.templates.items()}
        rng = np.random.default_rng(11)
        made = self.sample(rng)
        # Feature 0 is the bias, which every row has.
        self.index = {g: k for k, g in enumerate(sorted({g for own, _ in made for g in grams(own)}), 1)}
        self.weights = self.fit(*self.encoded(made))
        self.temperature, self.least = self.calibrated(*self.encoded(self.sample(rng)))

    def encoded(self, made: list[tuple[list[str], int]]) -> tuple[Rows, np.ndarray]:
        return Rows([self.features(own) for own, _ in made]), np.array([k for _, k in made])

    def features(self, own: list[str]) -> np.ndarray:
        return np.array([0, *sorted(self.index[g] for g in grams(own) if g in self.index)], np.int64)

    def sample(self, rng: np.random.Generator) -> list[tuple[list[str], int]]:
        """Made paragraphs, as words, and their classes."""
        prose = [words(p) for p in _PROSE]
        loose = [w for p in prose[:10] for w in p]
        everything = [w for own in self.templates.values() for t in own for w in t]
        some = lambda xs: xs[rng.integers(len(xs))]
        out = []
        for k, family in enumerate(self.families):
            for _ in range(EXAMPLES * (4 if family in (UNKNOWN, NONE) else 1)):
                noise = [list(rng.choice(loose, rng.integers(0, 10))) if rng.random() < 0.5 else [] for _ in range(2)]
                if family == UNKNOWN:
                    body = words(some(STATEMENTS)) if rng.random() < 0.25 else words(some(FRAMES).format(some(OTHERS)))
                elif family == NONE:
                    kind = rng.integers(4)
                    body = list(rng.choice(everything, rng.integers(3, 30))) if kind == 0 else some(prose) if kind < 3 else list(rng.choice(loose, rng.integers(3, 40)))
                elif rng.random() < 0.5:
                    body = words(some(FRAMES).format(some(NAMES[family])))
                else:
                    own = self.templates[family]
                    body = [w for t in (some(own) for _ in range(rng.integers(1, 3))) for w in t if len(t) < 8 or rng.random() > 0.06]
                out.append(([*noise[0], *body, *noise[1]], k))
        return out

    def fit(self, x: Rows, y: np.ndarray, steps: int = 200, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
        """Gradient descent with momentum on the penalised log-likelihood."""
        w = np.zeros((len(self.index) + 1, len(self.families)))
        speed = np.zeros_like(w)
        target = np.eye(len(self.families))[y]
        for _ in range(steps):
            speed = 0.9 * speed - rate * (x.transposed_times(softmax(x.times(w)) - target, len(w)) / len(y) + penalty * w)
            w += speed
        return w

    def calibrated(self, x: Rows, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Temperature of the least held-out loss, and the least probability of each family at the wanted precision."""
        logits = x.times(self.weights)
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-9).mean() for t in (0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        best = min(loss, key=loss.get)
        p = softmax(logits / best)
        top, least = p.argmax(axis=1), np.full(len(self.families), 0.5)
        for k in range(len(self.families) - 2):
            mine = np.sort(p[(top == k), k])[::-1]
            right = (y[top == k] == k)[np.argsort(-p[top == k, k])]
            good = np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION
            if good.any():
                least[k] = min(0.9, max(0.4, mine[np.flatnonzero(good)[-1]]))
        return best, least

    def judge(self, own: list[str]) -> tuple[str, float]:
        """Family and probability of a paragraph's words; unknown if the calibration or the templates don't confirm it."""
        at = self.features(own)
        p = softmax(self.weights[at].sum(axis=0)[None] / self.temperature)[0]
        k = int(p.argmax())
        family = self.families[k]
        if family in (NONE, UNKNOWN) or p[k] < self.least[k]:
            return NONE if family == NONE else UNKNOWN, float(p[k])
        have = grams(own)
        shared = max(len(shape & have) / len(shape) for shape in self.shapes[family])
        return (family, float(p[k])) if shared >= SHARED else (UNKNOWN, float(p[k]))

    def best(self, line: list[list[str]], formal: bool) -> tuple[str, float]:
        """The verdict on a line, given as its sentences: the first family among them, else unknown in a line that looks like a statement, else none."""
        found = [self.judge(own) for own in line if own]
        family, p = min(found, key=lambda x: (x[0] == NONE, x[0] == UNKNOWN), default=(NONE, 0.0))
        return (NONE if family == UNKNOWN and not formal else family), p

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """Family, first and last line and probability of each paragraph that states a licence."""
        found = []
        run: list[tuple[int, list[list[str]], bool]] = []

        def close() -> None:
            alone = [self.best(line, formal) for _, line, formal in run]
            if len(run) > 1:
                family, p = self.judge([w for _, line, _ in run for own in line for w in own])
                if family not in (NONE, UNKNOWN) and {f for f, _ in alone} <= {family, UNKNOWN, NONE}:
                    found.append((family, run[0][0], run[-1][0], p))
                    run.clear()
                    return
            found.extend((f, k, k, q) for (k, _, _), (f, q) in zip(run, alone, strict=True) if f != NONE)
            run.clear()

        for k, line in enumerate(text.split("\n")):
            own = words(line)
            if CUES.isdisjoint(own) and self.thirds.isdisjoint(zip(own, own[1:], own[2:], strict=False)) and not _CAPITAL_CUE.search(line):
                if run:
                    close()
                continue
            parts = [own] if len(own) <= LONG else [w for w in map(words, _SENTENCE.split(line)) if not CUES.isdisjoint(w) or not self.thirds.isdisjoint(zip(w, w[1:], w[2:], strict=False)) or _CAPITAL_CUE.search(line)]
            run.append((k, parts, bool(_FORMAL.search(line))))
        if run:
            close()
        return found


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_trained: list[Classifier] = []


def classifier() -> Classifier:
    """The model, trained once on the driver or in a worker; training gives the same model everywhere."""
    if not _trained:
        _trained.append(Classifier())
    return _trained[0]


def scan_licenses(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """docs with an array of (family, first_line, last_line, probability) as last column (which takes the place of one so named)."""
    small_batches(docs.sparkSession)
    names = [x for x in docs.columns if x != into]
    inner = [f"_k{i}" for i in range(len(names))]
    at = names.index(text)
    plain = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    model = classifier()
    kind = pa.list_(pa.struct([("family", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"family": f, "first_line": a, "last_line": b, "probability": p} for f, a, b, p in model.scan(t)] for t in strings(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*inner, "_found"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), "_found array<struct<family:string,first_line:int,last_line:int,probability:double>>"])
    return plain.mapInArrow(run, schema).select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), F.col("_found").alias(into))


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs).drop("text")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", F.array_sort(F.array_distinct("licenses.family"))).alias("families"))
