"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over sparse word n-grams names the licence
family of a paragraph. It is trained here on templates and on altered copies of
them, against an unknown class of paragraphs that use licence words otherwise;
a temperature fitted on held-out copies calibrates its probabilities, and what
stays below ``SURE`` is unknown. A named family is confirmed when the
paragraph holds enough of one of its templates.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices of the licence families and paragraphs of their short bodies, as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Licensed under the zlib license.",
        "SPDX-License-Identifier: Zlib",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL version 2.",
        "Licensed under the GPLv3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 3.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "CC0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document is confidential and proprietary; all rights reserved.",
    ),
}
UNLIKE = (
    "The driver has a valid license and a license plate in the front.",
    "Her poetic license made the story better.",
    "A fishing license is sold at the public office in version 2 of the form.",
    "Apache helicopters flew over the general in public.",
    "The copyright debate went on for years in the public library.",
    "They asked for permission to use the software and the files in the house.",
    "All animals have rights and the table is reserved for the general public.",
    "Creative people in the commons gave free gifts to any person.",
    "The restaurant lost its liquor license under the new terms of the city.",
    "Permission to land was granted by the tower.",
    "MIT is a university in Cambridge; BSD and GNU are systems.",
    "The foundation published a free program with attribution to its source.",
    "The licence fee was raised again by the government.",
    "This product includes a warranty of two years and a manual.",
)
#: Word pairs of these alone are no anchors. A test proves from the templates that what holds ``CONFIRM`` of one has an anchor.
COMMON = frozenset("a an and any are as at be by for from in into is it its not of on or that the their this to under which will with you".split())
UNKNOWN = "unknown"
SURE = 0.6
#: Share of a template's n-grams, and of those that no other family's templates have, that confirms its family.
CONFIRM = 0.6
CONFIRM_OWN = 0.5
#: Words on either side of an anchor that name its family, closest first.
NEAR = (2, 4, 8, 16, 24, 48)
#: Words between two shared word pairs of a notice that still belong to it.
GAP = 2
_BLANK = re.compile(r"\n[^\w\n]*\n")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


def _grams(words: Sequence[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


class Classifier:
    """Weights by n-gram for each family and the unknown class, and the template n-grams of each family."""

    def __init__(self) -> None:
        rng = random.Random(7)
        self.families = [*TEMPLATES, UNKNOWN]
        filler = [w for t in UNLIKE for w in _words(t)] + [f"{a}{b}" for a in ("th", "er", "on", "an", "st") for b in ("ea", "ou", "in", "nd")]
        rows: list[tuple[set[str], int]] = []
        for family, texts in [*TEMPLATES.items(), (UNKNOWN, UNLIKE)]:
            for text in texts:
                for _ in range(24):
                    words = _words(text)
                    if len(words) > 6:
                        words = [w for w in words if rng.random() > 0.08]
                    pad = [[rng.choice(filler) for _ in range(rng.randrange(0, 12))] for _ in range(2)]
                    rows.append((_grams(pad[0] + words + pad[1]), self.families.index(family)))
        for _ in range(600):
            rows.append((_grams([rng.choice(filler) for _ in range(rng.randrange(3, 30))]), len(self.families) - 1))
        rng.shuffle(rows)
        names = sorted(set().union(*(_grams(_words(t)) for ts in (*TEMPLATES.values(), UNLIKE) for t in ts)))
        self.place = {n: i for i, n in enumerate(names)}
        x = np.zeros((len(rows), len(names) + 1), np.float32)
        x[:, -1] = 1
        for r, (grams, _) in enumerate(rows):
            for g in grams:
                if (i := self.place.get(g)) is not None:
                    x[r, i] = 1
        y = np.eye(len(self.families), dtype=np.float32)[[c for _, c in rows]]
        cut = len(rows) * 4 // 5
        self.w = self._train(x[:cut], y[:cut])
        self.heat = self._temperature(x[cut:] @ self.w, y[cut:])
        self.held_out = float(((x[cut:] @ self.w).argmax(1) == y[cut:].argmax(1)).mean())
        self.bare = self.w[-1] / self.heat
        self.marks = [(f, _grams(_words(t))) for f, ts in TEMPLATES.items() for t in ts]
        self.reach = max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)
        self.holders: dict[str, list[int]] = {}
        families: dict[str, set[str]] = {}
        for i, (f, grams) in enumerate(self.marks):
            for g in grams:
                self.holders.setdefault(g, []).append(i)
                families.setdefault(g, set()).add(f)
        self.own = [{g for g in grams if len(families[g]) == 1} for _, grams in self.marks]
        self.anchors = frozenset(p for ts in TEMPLATES.values() for t in ts for p in pairwise(_words(t)) if not COMMON.issuperset(p))

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 2e-5) -> np.ndarray:
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        v, step = w.copy(), 8.0 / float((x * x).sum(axis=1).mean()) * 2
        for t in range(rounds):
            z = x @ v
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = v - step * (x.T @ (p - y) / len(x) + l2 * v)
            v, w = new + t / (t + 3) * (new - w), new
        return w

    @staticmethod
    def _temperature(z: np.ndarray, y: np.ndarray) -> float:
        def loss(heat: float) -> float:
            s = z / heat
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s * y).sum(axis=1).mean() + np.log(np.exp(s).sum(axis=1)).mean())

        return min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)

    def judge(self, words: Sequence[str]) -> tuple[str, float]:
        """Family (or unknown) and its probability."""
        at = [i for g in _grams(words) if (i := self.place.get(g)) is not None]
        z = self.w[at].sum(axis=0) / self.heat + self.bare
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family, sure = self.families[best], float(p[best])
        return (family, sure) if sure >= SURE else (UNKNOWN, sure)

    def held(self, words: Sequence[str]) -> dict[str, tuple[float, set[str]]]:
        """Families of which ``words`` confirm a template, with the share of the template held most and the n-grams of all confirmed."""
        counts: Counter[int] = Counter()
        grams = _grams(words)
        for g in grams:
            if (holders := self.holders.get(g)) is not None:
                counts.update(holders)
        best: dict[str, tuple[float, set[str]]] = {}
        for i, n in counts.items():
            family, marks = self.marks[i]
            if n >= CONFIRM * len(marks) and len(grams & self.own[i]) >= CONFIRM_OWN * len(self.own[i]):
                share, known = best.get(family, (0.0, set()))
                best[family] = (max(share, n / len(marks)), known | marks)
        return best

    def around(self, words: Sequence[str], at: int) -> tuple[str, float, float, int, int] | None:
        """Family, probability, share of its template, first and last word of the notice at the anchor ``words[at : at + 2]``.

        A family is named by words around the anchor and confirmed when they hold
        enough of one of its templates; None if there is none. Of several the one whose templates have most of the
        anchor's own n-grams is taken, so that each alternative of a dual licence
        keeps its anchor; then the one that is held most. The notice runs on from the anchor
        while word pairs of the templates follow.
        """
        pair = " ".join(words[at : at + 2])
        held = {f: v for f, v in self.held(words).items() if pair in v[1]}
        if not held:
            return None
        named: dict[str, float] = {}
        for r in NEAR:
            family, sure = self.judge(words[max(0, at - r) : at + r + 1])
            if family in held:
                named[family] = max(named.get(family, 0.0), sure)
        own = {" ".join(words[i : i + k]) for k in (2, 3) for i in range(max(0, at - k + 1), min(at, len(words) - k) + 1)}
        ranked = [(len(own & held[f][1]), held[f][0], sure, f) for f, sure in named.items()]
        if not ranked:
            return None
        _, share, sure, family = max(ranked)
        first, last = at, at + 1
        pairs = [i for i in range(len(words) - 1) if " ".join(words[i : i + 2]) in held[family][1]]
        for i in reversed(pairs):
            if first - GAP <= i + 1 and i < first:
                first = i
        for i in pairs:
            if i <= last + GAP and i + 1 > last:
                last = i + 1
        return family, sure, share, first, last


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def find(text: str, model: Classifier | None = None) -> list[tuple[str, int, int, float, bool]]:
    """(family, start, end, probability, confirmed) of the notices of ``text``, and of paragraphs judged in vain.

    A paragraph ends at a blank line; its line breaks count as spaces, as notices are wrapped. It is judged around
    each of its anchors, whatever its length, as it may name several licences. Of overlapping
    notices the one that holds more of its template stays. A paragraph with anchors and no confirmed
    family gives one row, not confirmed. Paragraphs without an anchor cannot be confirmed and give none.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: positions must stay
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    low = low.replace("licence", "license")
    model = model or classifier()
    words = _WORD.findall(low)
    if not any(map(model.anchors.__contains__, pairwise(words))):
        return []
    out, start = [], 0
    for end in [*(m.start() for m in _BLANK.finditer(low)), len(low)]:
        out += [(f, start + a, start + b, round(p, 4), sure) for f, a, b, p, sure in _paragraph(low[start:end], model)]
        start = end
    return out


def _paragraph(part: str, model: Classifier) -> list[tuple[str, int, int, float, bool]]:
    words = tuple(_WORD.findall(part))
    anchors = [i for i, pair in enumerate(pairwise(words)) if pair in model.anchors]
    if not anchors:
        return []
    spans = [(m.start(), m.end()) for m in _WORD.finditer(part)]
    found: dict[tuple[str, int, int], tuple[float, float]] = {}
    known: dict[tuple[tuple[str, ...], int], tuple[str, float, float, int, int] | None] = {}
    for i in anchors:
        first = max(0, i - model.reach)
        key = (words[first : i + model.reach + 1], i - first)
        if key not in known:
            known[key] = model.around(*key)
        if known[key] is not None:
            family, p, share, a, b = known[key]
            place = (family, first + a, first + b)
            found[place] = max(found.get(place, (0.0, 0.0)), (share, p))
    if not found:
        family, p = model.judge(words)
        return [(family, spans[0][0], spans[-1][1], p, False)]
    kept: list[tuple[int, int, str, float]] = []  # apart from each other and in order
    for (family, a, b), (_, p) in sorted(found.items(), key=lambda f: (-f[1][0], f[0][1] - f[0][2], f[0])):
        at = bisect_left(kept, (a,))
        if (at == 0 or kept[at - 1][1] < a) and (at == len(kept) or kept[at][0] > b):
            kept.insert(at, (a, b, family, p))
    return [(family, spans[a][0], spans[b][1], p, True) for a, b, family, p in kept]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = classifier()
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = find(text.as_py() or "", model)
            sure = [f for f in found if f[4]]
            rows.append(
                (
                    ",".join(sorted({f[0] for f in sure})),
                    len(sure),
                    sum(f[0] == UNKNOWN or not f[4] for f in found),
                    max((f[3] for f in sure), default=0.0),
                    ",".join(f"{f[0]}:{f[1]}:{f[2]}" for f in sure),
                )
            )
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        names = ["doc_id", "licenses", "n_confirmed", "n_unknown", "score", "spans"]
        yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses (families, sorted), n_confirmed, n_unknown, score, spans.

    score is the highest probability of a confirmed notice, 0 without any;
    spans are ``family:start:end`` in code points. n_unknown counts judged
    paragraphs that no family was confirmed for. Null and empty texts have
    none; repeated rows give equal rows; an empty table an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(_scan, "doc_id long, licenses string, n_confirmed long, n_unknown long, score double, spans string")
