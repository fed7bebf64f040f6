"""License scan: a trained paragraph classifier whose predictions a template comparison confirms.

A paragraph is a line of text, or a run of lines without a blank one between that all hold telling words, as wrapped notices
do; comment marks at the beginning of lines are left out. Its sparse features are the word unigrams and bigrams of the training
vocabulary that hold a telling word; a multinomial logistic regression, fitted on notices and paragraphs of each family and on
notices of other licences and prose as ``unknown``, gives probabilities. The softmax temperature and the probability from which
a family is believed are calibrated on texts that the fit has not seen, among them notices of licences that no class stands for. A
predicted family is confirmed when enough of one of its templates' word pairs occur in the paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow_batches

UNKNOWN = "unknown"
#: Notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Distributed under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Released under the GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the simplified BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Notices of licences that no class stands for: the first of each pair is for the fit, the second for calibration.
OTHER_NOTICES = [
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Released under the Eclipse Public License 2.0."),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC license."),
    ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib license."),
    ("Licensed under the EUPL, Version 1.2 or later.", "This work is licensed under the European Union Public Licence, version 1.2."),
    ("This library is free software and may be used under the terms of the Artistic License 2.0.", "Released under the Artistic License, version 2.0."),
    ("SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: ISC"),
    ("Licensed under the Microsoft Public License.", "This project is licensed under the terms of the Common Development and Distribution License, version 1.0."),
    ("This font is licensed under the SIL Open Font License, Version 1.1.", "Released under the SIL Open Font License."),
    ("Licensed under the Academic Free License version 3.0.", "Licensed under the Open Software License version 3.0."),
    ("This file is part of the project and is distributed under the Universal Permissive License.", "Released under the Python Software Foundation License."),
    ("Use of this source code is governed by the terms of service of the company.", "The licence of this work is stated in the agreement between the parties."),
]
#: Sentences near the subject that state no licence.
OTHERS = [
    "She renewed her driving license at the office last week.",
    "A licensed physician must sign the form before version 2 of the plan is used.",
    "The general public may use the software on the terms of the office.",
    "The city granted the restaurant a license to serve wine.",
    "Permission to enter the building was granted to any person with a copy of the key.",
    "Open source foundations publish many documents for free.",
    "The public domain of the function is the source of the code.",
    "This version of the work was released under pressure from the author.",
    "The university in Massachusetts is known as MIT and its students.",
    "The apache nation lived in the south of the country.",
    "Attribution of the painting to the master is not certain.",
    "Commercial use of the file is distributed under the following conditions.",
    "A creative person with common sense is free to modify the form.",
    "All the rights of the guests are reserved by the hotel.",
]
_STOP = frozenset("a an and any are as at be by can do for from has have if in is it its may not of on or s so that the their this to under use with you your".split())
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
CONFIRM_FROM = 0.5
#: Share of the calibration texts without a known licence that may be taken for one.
FALSE_SHARE = 0.01
#: Telling words that each line of a run has at least, and lines of a run at most; longer ones are cut.
RUN_WORDS = 2
RUN_LINES = 64
_MARKS = re.compile(r"^[\s/*#;%!<>\-]+|[\s*/\-]+$")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    """Unigrams that are no stop words, and bigrams that hold one."""
    out = [w for w in words if w not in _STOP]
    out += [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in _STOP or b not in _STOP]
    return out


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Of each family's templates the word pairs and their weights: one over the families whose notices have the pair.
    templates: dict[str, list[dict]] = field(default_factory=dict)
    telling: frozenset = frozenset()
    believed_from: float = 0.0

    def entries(self, words: list[str]) -> list[int]:
        return sorted({self.vocabulary[g] for g in grams(words) if g in self.vocabulary})

    def probabilities(self, entries: list[int]) -> np.ndarray:
        z = (self.bias + self.weights[entries].sum(axis=0) / max(1.0, len(entries)) ** 0.5) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, family: str, words: list[str]) -> float:
        """The greatest share of a template's word pairs, by weight, that occur in the paragraph."""
        pairs = set(zip(words, words[1:], strict=False))
        return max((sum(w for p, w in t.items() if p in pairs) / sum(t.values()) for t in self.templates.get(family, [])), default=0.0)

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, similarity); None for the unknown class and for a family that isn't believed."""
        words = words_of(paragraph)
        if self.telling.isdisjoint(words):
            return None
        p = self.probabilities(self.entries(words))
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < self.believed_from:
            return None
        return self.families[best], float(p[best]), self.similarity(self.families[best], words)

    def paragraphs(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(first line, lines, text) of the paragraphs of a text that hold a telling word: single lines, then runs of two lines or more."""
        run: list[str] = []
        lines = text.split("\n")
        for n, raw in enumerate([*lines, ""]):
            words = words_of(raw)
            told = sum(w in self.telling for w in words)
            if told:
                yield n, 1, _MARKS.sub("", raw)
            if run and (told < RUN_WORDS or len(run) == RUN_LINES):
                if len(run) > 1:
                    yield n - len(run), len(run), " ".join(run)
                run = []
            if told >= RUN_WORDS:
                run.append(_MARKS.sub("", raw))

    def scan(self, text: str) -> list[tuple[int, int, str, float, float]]:
        """(first line, lines, family, probability, similarity) of the licence paragraphs of a text; a run only where it is confirmed and none of its lines is."""
        found: list[tuple] = []
        confirmed: set[int] = set()
        for start, size, paragraph in self.paragraphs(text):
            got = self.classify(paragraph)
            if got is None or size > 1 and (got[2] < CONFIRM_FROM or not confirmed.isdisjoint(range(start, start + size))):
                continue
            if size == 1 and got[2] >= CONFIRM_FROM:
                confirmed.add(start)
            if size > 1:
                found = [f for f in found if f[0] < start]  # its lines, none of which was confirmed
            found.append((start, size, *got))
        return found


def variants(seed: int, each: int, held_out: bool = False) -> tuple[list[list[str]], list[int], list[str]]:
    """Training paragraphs as words: templates and others with words dropped, put in, cut short or surrounded by other prose.

    ``held_out`` takes the other notices that the fit doesn't see.
    """
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *TEMPLATES]
    prose = [w for s in OTHERS for w in words_of(s)]
    texts, labels = [], []
    for label, family in enumerate(families):
        unknown = [*OTHERS, *(n[held_out] for n in OTHER_NOTICES)]
        for sentence in unknown if family == UNKNOWN else TEMPLATES[family]:
            base = words_of(sentence)
            for k in range(each * (2 if family == UNKNOWN else 1)):
                words = [w for w in base if not k or rng.random() > 0.08] or base
                if k % 4 == 1:
                    words = list(rng.choice(prose, rng.integers(1, 8))) + words
                if k % 4 == 2:
                    words = words + list(rng.choice(prose, rng.integers(1, 12)))
                if k % 4 == 3 and len(words) > 20:
                    at = int(rng.integers(0, len(words) - 14))
                    words = words[at : at + int(rng.integers(10, 15))]
                texts.append(words)
                labels.append(label)
    every = [w for t in TEMPLATES.values() for s in t for w in words_of(s)]
    for _ in range(each * 40):
        texts.append(list(rng.choice(prose if rng.random() < 0.5 else every, rng.integers(2, 9))))
        labels.append(0)
    return texts, labels, families


def train(each: int = 24, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> Model:
    """Fit on seeded variants; then choose the temperature that gives held-out variants the least log loss, and the probability from which
    no more than FALSE_SHARE of the held-out texts without a known licence are taken for one."""
    texts, labels, families = variants(seed, each)
    vocabulary: dict[str, int] = {}
    for sentence in [s for t in TEMPLATES.values() for s in t] + OTHERS + [n[0] for n in OTHER_NOTICES]:
        for g in grams(words_of(sentence)):
            vocabulary.setdefault(g, len(vocabulary))
    telling = frozenset(w for t in TEMPLATES.values() for s in t for w in words_of(s) if w not in _STOP)
    pairs = lambda t: set(zip(words_of(t), words_of(t)[1:], strict=False))
    groups = [*TEMPLATES.values(), [n[0] for n in OTHER_NOTICES]]
    spread = Counter(p for g in groups for p in set().union(*map(pairs, g)))
    templates = {f: [{p: 1 / spread[p] for p in pairs(t)} for t in ts] for f, ts in TEMPLATES.items()}
    m = Model(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), templates=templates, telling=telling)

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)))
        for i, w in enumerate(rows):
            e = m.entries(w)
            x[i, e] = 1 / max(1.0, len(e)) ** 0.5
        return x

    x, y = matrix(texts), np.eye(len(families))[labels]
    g_w, g_b = np.full_like(m.weights, 1e-8), np.full_like(m.bias, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for rows in np.array_split(order.permutation(len(x)), max(1, len(x) // 128)):
            z = x[rows] @ m.weights + m.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - y[rows]) / len(rows)
            dw, db = x[rows].T @ d + decay * m.weights, d.sum(axis=0)
            g_w += dw * dw
            g_b += db * db
            m.weights -= rate * dw / np.sqrt(g_w)
            m.bias -= rate * db / np.sqrt(g_b)
    held, held_labels, _ = variants(seed + 1, 6, held_out=True)
    z = matrix(held) @ m.weights + m.bias

    def loss(t: float) -> float:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return float(-np.log(p[np.arange(len(z)), held_labels] / p.sum(axis=1)).mean())

    m.temperature = min((0.02 * 1.15**k for k in range(44)), key=loss)
    p = np.exp((z - z.max(axis=1, keepdims=True)) / m.temperature)
    p /= p.sum(axis=1, keepdims=True)
    none = np.array(held_labels) == 0
    claimed = np.sort(np.where(p[none].argmax(axis=1) == 0, 0.0, p[none].max(axis=1)))[::-1]
    m.believed_from = float(claimed[int(FALSE_SHARE * none.sum())]) + 1e-9
    return m


SCHEMA = "doc_id long, line int, lines int, family string, probability double, similarity double, confirmed boolean"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm_from: float = CONFIRM_FROM) -> DataFrame:
    """One row for each paragraph that is believed to be of a licence family, with its place, probability and confirmation.

    Every line of every text is classified, and every run of lines; one without a telling word has no feature and is unknown. A
    run is returned where it is confirmed and no line of it alone is. Null and empty texts give no rows; repeated rows give
    theirs each; a null id is carried; other columns are not read.
    """
    limit_arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(doc, n, size, family, round(p, 6), round(s, 6), s >= confirm_from) for n, size, family, p, s in m.scan(text or "")]
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
