"""Licence scan by a trained paragraph classifier.

A softmax regression over sparse word n-grams (one to three words) tells licence
families from an unknown class.  Its n-grams are those of the notices and decoys below;
all others count by their length.  It is trained here on the notices, on altered forms
of them (words left out, words round them as frequent as in the corpus), and for the
unknown class on every paragraph of every text, but for those that resemble a notice.
L-BFGS minimises the loss over all of them: each of its passes, PASSES at most, sums the
gradients of all paragraphs in a tree of tasks.

A second model is found in the same passes, without one notice of each family and a
quarter of the paragraphs, by hash.  On all that it leaves out the temperature of the
probabilities is fitted, and the least probability that counts as a family:
UNKNOWN_SHARE of the unknown windows at most reach it.  A predicted family is confirmed
when the paragraph shares enough of its n-grams with one of the family's templates.

Every paragraph of every text is classified.  A paragraph is a line; one of more than
WINDOW words is taken in windows of as many, from every BLOCK words on (in the training
one after another, so that each word counts once).  The logits of a batch of paragraphs
are sums of rows of the weights, so no paragraph has to be passed over.  Neighbouring
windows and lines of one family make one finding.

Training windows are spooled as the numbers of their n-grams, equal ones of a task once
with their count.  The driver gets sums of fixed size.

Defined results
* null or empty text: no rows.  Repeated rows are scanned one by one.
* paragraphs of the unknown class give no row; unconfirmed ones give confirmed = false.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spool

#: Words of a block and of a window.
BLOCK, WINDOW = 8, 24
#: Share of unknown paragraphs that may pass for a family in the calibration, and the least limit.
UNKNOWN_SHARE, LEAST_LIMIT = 0.001, 0.3
#: Share of a template's n-grams that confirms it, and share of its pairs and triples from which a corpus window is not trained on as unknown.
CONFIRM, ALIKE = 0.5, 0.3
FORMS = 10
#: Share of the decoys in the weight of the unknown class, and factor of the squared weights in the loss.
DECOY_SHARE, RIDGE = 0.02, 1e-5
#: Passes over the corpus at most, largest entry of a gradient that ends them, and steps that L-BFGS remembers.
PASSES, STILL, MEMORY = 50, 1e-5, 10
TEMPERATURES = np.linspace(0.5, 4, 29)
#: Bins of probability in the calibration.
BINS = 10_000
#: Windows of which logits and gradients are taken at a time, and n-grams that are columns of a matrix there.
ROWS, COMMON = 1 << 11, 64
#: Different windows of a spooled row, task sums that one task adds up, and sums that the driver gets.
PACK, FAN_IN, LAST_PARTS = 1 << 15, 32, 4
#: Place of the notice of each family that the calibration leaves out.
LEFT_OUT = 2
BATCH_WORDS = 1 << 16
#: Notices by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Distributed under the MIT/X11 license.",
        "MIT licensed. See the LICENSE file for details.",
        "Lizenziert unter der MIT-Lizenz.",
        "Sous licence MIT.",
        "Publicado bajo la licencia MIT.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Distributed under Apache 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.",
        "Sous licence Apache, version 2.0.",
        "Publicado bajo la licencia Apache 2.0.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under GPLv3.",
        "GNU GPL v3 or later",
        "Lizenziert unter der GNU General Public License, Version 3.",
        "Sous licence GNU GPL version 3.",
        "Publicado bajo la licencia GPL versi\u00f3n 3.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under GPLv2.",
        "Licensed under the GNU GPL v2.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL v3.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "bsd": [
        "Licensed under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 2-clause license.",
        "Licensed under the new BSD license.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Lizenziert unter CC BY 4.0.",
        "Sous licence Creative Commons Attribution 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal dedication.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Proprietary and confidential. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Alle Rechte vorbehalten.",
        "Tous droits r\u00e9serv\u00e9s.",
        "Todos los derechos reservados.",
    ],
}
#: Sentences that speak of licences and license nothing.
DECOYS = [
    "He lost his driving licence on the way to work.",
    "The council will renew the licence fee next year.",
    "She asked for permission to leave the room early.",
    "The warranty on the washing machine has expired.",
    "Copyright law differs from country to country.",
    "They were licensed to sell fish at the market.",
    "A public domain is a concept discussed in the lecture.",
]
FAMILIES = ["unknown", *TEMPLATES]
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(text: str) -> set[tuple[str, ...]]:
    w = words_of(text)
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


NOTICES = [t for ts in TEMPLATES.values() for t in ts]
#: The n-grams of notices and decoys in the order of their positions; then come the other words, pairs and triples.
GRAMS = sorted({g for t in [*NOTICES, *DECOYS] for g in ngrams(t)}, key=lambda g: (len(g), g))
PLACE = {g: k for k, g in enumerate(GRAMS)}
OTHER, POSITIONS = len(GRAMS), len(GRAMS) + 3
BITS = POSITIONS.bit_length()
NUMBER = {g[0]: k + 1 for k, g in enumerate(GRAMS) if len(g) == 1}


def _tries() -> tuple[np.ndarray, np.ndarray]:
    """(number, number of the next word) -> position of the pair, (position of a pair, number of the third word) -> position."""
    two = np.full((len(NUMBER) + 1, len(NUMBER) + 1), OTHER + 1, np.int64)
    three = np.full((OTHER + 2, len(NUMBER) + 1), OTHER + 2, np.int64)
    for g, k in PLACE.items():
        if len(g) == 2:
            two[NUMBER[g[0]], NUMBER[g[1]]] = k
        elif len(g) == 3:
            three[PLACE[g[:2]], NUMBER[g[2]]] = k
    return two, three


TWO, THREE = _tries()
#: Which notice has which n-gram of two or three words: of these ALIKE is counted.
LONGER = np.array([[float(len(g) > 1 and g in own) for own in map(ngrams, NOTICES)] for g in GRAMS])
NEEDED = ALIKE * LONGER.sum(0)


class _WordHash(dict):
    """A word's number; 0: in no notice and no decoy."""

    def __init__(self) -> None:
        super().__init__(NUMBER)

    def __missing__(self, word: str) -> int:
        return 0


def positions(number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the n-grams that begin at each word, 3 columns; 2 ** BITS: none.  number: the words of all paragraphs."""
    n = len(number)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the paragraph's end
    at = np.full((n, 3), 1 << BITS, np.int64)
    at[:, 0] = np.where(number > 0, number - 1, OTHER)
    at[:-1, 1] = TWO[number[:-1], number[1:]]
    at[:-2, 2] = THREE[at[:-2, 1], number[2:]]
    at[left < 2, 1] = 1 << BITS
    at[left < 3, 2] = 1 << BITS
    return at


def features(paragraphs: list[list[str]], memo: _WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that begin at each word, 3 columns, and their number; 2 ** BITS: none."""
    sizes = np.array([len(p) for p in paragraphs], np.int64)
    number = np.fromiter((h for p in paragraphs for h in map(memo.__getitem__, p)), np.int64, int(sizes.sum()))
    at = positions(number, sizes)
    return at, (at < 1 << BITS).sum(1)


class LicenseModel:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, limit: float = LEAST_LIMIT):
        self.weights = np.vstack([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32)
        self.bias, self.temperature, self.limit = bias, temperature, limit
        self.templates = [[ngrams(t) for t in TEMPLATES.get(f, ())] for f in FAMILIES]

    def block_sums(self, paragraphs: list[list[str]], memo: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of weights summed by blocks of words, numbers of n-grams, and blocks of each paragraph."""
        at, n = features(paragraphs, memo)
        rows = self.weights.take(at[:, 0], 0)
        rows += self.weights.take(at[:, 1], 0)
        rows += self.weights.take(at[:, 2], 0)
        sizes = np.array([len(p) for p in paragraphs], np.int64)
        blocks = -(-sizes // BLOCK)
        first = np.repeat(np.cumsum(blocks) - blocks, blocks)
        begins = np.repeat(np.cumsum(sizes) - sizes, blocks) + (np.arange(len(first)) - first) * BLOCK
        return np.add.reduceat(rows, begins), np.add.reduceat(n, begins), blocks

    def windows(self, paragraphs: list[list[str]], memo: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, first block, family, probability) of every window.  paragraphs: none is empty."""
        sums, n, blocks = self.block_sums(paragraphs, memo)
        span = WINDOW // BLOCK
        many = np.maximum(1, blocks - span + 1)
        owner = np.repeat(np.arange(len(blocks)), many)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = (np.cumsum(blocks) - blocks)[owner] + first
        last = np.cumsum(blocks)[owner] - 1
        z, m = sums[begin], n[begin]
        for k in range(1, span):
            inside = (begin + k <= last).astype(np.float32)
            at = np.minimum(begin + k, last)
            z = z + sums[at] * inside[:, None]
            m = m + n[at] * inside.astype(np.int64)
        z = self.bias + z / np.sqrt(m)[:, None]
        p = _softmax(z / self.temperature)
        family = p.argmax(1)
        return owner, first, family, p[np.arange(len(p)), family]

    def likeness(self, family: int, text: str) -> float:
        """The best share of a template's n-grams that the paragraph holds."""
        own = ngrams(text)
        return max((len(own & t) / len(t) for t in self.templates[family]), default=0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Windows:
    """Training windows: n-grams of notices and decoys by window, the numbers of the other words, pairs and triples, whether a window is left out, and how often it occurs."""

    def __init__(self, grams: np.ndarray, many: np.ndarray, others: np.ndarray, held: np.ndarray, times: np.ndarray):
        self.grams, self.many, self.others, self.held, self.times = grams, many, others, held, times

    @classmethod
    def of(cls, at: np.ndarray, owner: np.ndarray, held: np.ndarray) -> Windows:
        """owner: the window of each word."""
        n, known = len(held), at < OTHER
        others = np.stack([np.bincount(owner[at[:, k] == OTHER + k], minlength=n) for k in range(3)], 1)
        return cls(at[known], np.bincount(owner, known.sum(1), n).astype(np.int64), others, held, np.ones(n, np.int64))

    def __len__(self) -> int:
        return len(self.many)

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Windows:
        grams, many, others, held, times = (np.frombuffer(row[k], kind).astype(np.int64) for k, kind in PACKED.items())
        return cls(grams, many, others.reshape(-1, 3), held > 0, times)

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(kind).tobytes() for k, kind in PACKED.items()}

    def kept(self, keep: np.ndarray) -> Windows:
        return Windows(self.grams[np.repeat(keep, self.many)], self.many[keep], self.others[keep], self.held[keep], self.times[keep])

    def alike(self) -> np.ndarray:
        """Windows with the share ALIKE of the pairs and triples of a notice, or more."""
        owner = np.repeat(np.arange(len(self)), self.many)
        pairs = np.unique(np.stack([owner, self.grams], 1)[self.grams >= len(NUMBER)], axis=0)
        out = np.zeros(len(self), bool)
        if len(pairs):
            begins = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
            out[pairs[begins, 0]] = (np.add.reduceat(LONGER[pairs[:, 1]], begins) >= NEEDED).any(1)
        return out

    def scales(self) -> np.ndarray:
        return 1 / np.sqrt(self.many + self.others.sum(1))

    def blocks(self) -> Iterator[Windows]:
        """The windows, ROWS at a time."""
        ends = np.concatenate([[0], np.cumsum(self.many)])
        for k in range(0, len(self), ROWS):
            own = slice(k, min(k + ROWS, len(self)))
            yield Windows(self.grams[ends[own.start] : ends[own.stop]], self.many[own], self.others[own], self.held[own], self.times[own])

    @cached_property
    def scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each window adds to a logit for a weight of 1: the positions of the commonest n-grams and of the others, a matrix of windows by these, and position, window and scale of each n-gram that is not in it."""
        n, often, scales = len(self), np.bincount(self.grams, minlength=OTHER), self.scales()
        common = np.sort(np.argsort(-often, kind="stable")[: min(COMMON, np.count_nonzero(often))])
        column = np.full(OTHER, len(common))
        column[common] = np.arange(len(common))
        at, owner = column[self.grams], np.repeat(np.arange(n), self.many)
        rest = np.flatnonzero(at == len(common))
        # the last column, of the n-grams that are not common, makes room for the others
        matrix = np.bincount(owner * (len(common) + 3) + at, minlength=n * (len(common) + 3)).reshape(n, len(common) + 3).astype(np.float64)
        matrix[:, len(common) :] = self.others
        matrix *= scales[:, None]
        return np.concatenate([common, np.arange(OTHER, POSITIONS)]), matrix, self.grams[rest], owner[rest], scales[owner[rest]]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Windows by column, stored column by column.  weights: by position, with the bias as the last row."""
        at, matrix, grams, owner, scales = self.scaled
        z = weights[at].T @ matrix.T + weights[POSITIONS][:, None]
        if len(grams):
            for own, w in zip(z, weights.T):
                own += np.bincount(owner, w.take(grams) * scales, len(self))
        return z.T

    def slope(self, g: np.ndarray) -> np.ndarray:
        """Gradient by position, with the bias as the last row.  g: gradient by logit, whose rows sum to 0 over the families."""
        at, matrix, grams, owner, scales = self.scaled
        of = np.ascontiguousarray(g.T)
        out = np.zeros((POSITIONS + 1, g.shape[1]))
        if len(grams):
            for c in range(g.shape[1]):
                if c % len(FAMILIES):
                    out[:OTHER, c] = np.bincount(grams, of[c].take(owner) * scales, OTHER)
        out[at] += (of @ matrix).T
        out[POSITIONS] = of.sum(1)
        for c in range(0, g.shape[1], len(FAMILIES)):
            out[:, c] = -out[:, c + 1 : c + len(FAMILIES)].sum(1)
        return out

    def squares(self, share: np.ndarray) -> np.ndarray:
        """About the mean square of what each position adds to a logit, the bias as the last.  share: weight of each window."""
        part = share * self.scales() ** 2
        return np.concatenate([np.bincount(self.grams, np.repeat(part, self.many), OTHER), part @ self.others**2, [share.sum()]])

    def word_counts(self) -> np.ndarray:
        """How often each word of NUMBER occurs, the others at 0."""
        out = np.bincount(self.grams + 1, np.repeat(self.times, self.many), OTHER + 1)[: len(NUMBER) + 1]
        out[0] = self.others[:, 0] @ self.times
        return out


PACKED = {"grams": np.uint16, "many": np.uint8, "others": np.uint8, "held": np.uint8, "times": np.int64}


def corpus_windows(paragraphs: list[list[str]], memo: _WordHash) -> Windows:
    """The windows that count as unknown: all but those alike a notice and their neighbours in the paragraph.

    Windows of WINDOW words follow each other; an n-gram is of the window in which it begins.
    A quarter of the paragraphs, by a hash of their words, is left out for the calibration.
    """
    sizes = np.array([len(p) for p in paragraphs], np.int64)
    number = np.fromiter((h for p in paragraphs for h in map(memo.__getitem__, p)), np.int64, int(sizes.sum()))
    held = np.array([xxhash.xxh64_intdigest(" ".join(p).encode("utf-8", "surrogatepass")) % 4 == 3 for p in paragraphs], bool)
    windows = -(-sizes // WINDOW)
    inside = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.cumsum(windows) - windows, sizes) + inside // WINDOW
    out = Windows.of(positions(number, sizes), owner, np.repeat(held, windows))
    alike = out.alike()
    if alike.any():
        of = np.repeat(np.arange(len(sizes)), windows)
        same = of[1:] == of[:-1]
        near = alike.copy()
        near[1:] |= alike[:-1] & same
        near[:-1] |= alike[1:] & same
        out = out.kept(~near)
    return out


class Collected:
    """Equal windows made one, with the number of times they occur."""

    def __init__(self) -> None:
        self.times: dict[bytes, int] = {}

    def add(self, windows: Windows) -> None:
        owner = np.repeat(np.arange(len(windows)), windows.many)
        grams = windows.grams[np.lexsort((windows.grams, owner))].astype(np.uint16).tobytes()
        heads = np.concatenate([windows.others, windows.held[:, None]], 1).astype(np.uint8).tobytes()
        ends = (2 * np.cumsum(windows.many)).tolist()
        times, low = self.times, 0
        for k, high in enumerate(ends):
            key = heads[4 * k : 4 * k + 4] + grams[low:high]
            times[key] = times.get(key, 0) + 1
            low = high

    def taken(self) -> Windows:
        """What was collected, which is forgotten."""
        keys, times = list(self.times), np.fromiter(self.times.values(), np.int64, len(self.times))
        self.times = {}
        heads = np.frombuffer(b"".join(k[:4] for k in keys), np.uint8).reshape(-1, 4).astype(np.int64)
        grams = np.frombuffer(b"".join(k[4:] for k in keys), np.uint16).astype(np.int64)
        return Windows(grams, np.array([len(k) // 2 - 2 for k in keys], np.int64), heads[:, :3], heads[:, 3] > 0, times)


def unknown_counts(windows: Windows) -> np.ndarray:
    """Numbers of windows trained on and left out, of their words, and the sum of squares."""
    return np.concatenate([[windows.times @ ~windows.held, windows.times @ windows.held], windows.word_counts(), windows.squares(windows.times)])


def unknown_slopes(windows: Windows, weights: np.ndarray) -> np.ndarray:
    """Losses and gradients of the unknown windows, by model: the first leaves some out."""
    columns = np.concatenate(list(weights), 1)
    losses, slope = np.zeros(len(weights)), np.zeros(columns.shape)
    for own in windows.blocks():
        z = own.logits(columns).T.reshape(len(weights), len(FAMILIES), len(own))
        top = z.max(1)
        g = np.exp(z - top[:, None])
        total = g.sum(1)
        counts = np.stack([own.times * ~own.held, own.times]).astype(np.float64)
        losses += ((top + np.log(total) - z[:, 0]) * counts).sum(1)
        g *= (counts / total)[:, None]
        g[:, 0] -= counts
        slope += own.slope(g.reshape(-1, len(own)).T)
    return np.stack([np.concatenate([[x], y.ravel()]) for x, y in zip(losses, np.split(slope, len(weights), 1))])


def unknown_losses(windows: Windows, weights: np.ndarray) -> np.ndarray:
    """Losses of the windows left out, by temperature."""
    held = windows.kept(windows.held)
    z = held.logits(weights)
    return np.array([-np.log(_softmax(z / t)[:, 0] + 1e-12) @ held.times for t in TEMPERATURES])


def unknown_passing(windows: Windows, weights: np.ndarray, temperature: float) -> np.ndarray:
    """Windows left out that are taken for a family, by probability in bins."""
    held = windows.kept(windows.held)
    p = _softmax(held.logits(weights) / temperature)
    named = p.argmax(1) > 0
    return np.bincount((p.max(1)[named] * BINS).astype(np.int64), held.times[named], BINS + 1)


def _forms(notices: dict[str, list[str]], filler: np.ndarray, rng: np.random.Generator) -> tuple[Windows, np.ndarray]:
    """Altered forms of the notices, and their families.  filler: how often each word's number occurs in the corpus."""
    texts, marks = [], []
    shares = (filler if filler.sum() else np.eye(len(filler))[0]) / max(1.0, filler.sum())
    for k, family in enumerate(FAMILIES):
        for t in notices.get(family, ()):
            words = [NUMBER[w] for w in words_of(t)]
            for form in range(FORMS):
                kept = [w for w in words if form < 2 or len(words) < 5 or rng.random() > 0.08]
                pad = rng.choice(len(shares), int(rng.integers(0, WINDOW - 4)), p=shares).tolist() if form % 2 else []
                cut = int(rng.integers(0, len(pad) + 1))
                texts.append(pad[:cut] + kept + pad[cut:])
                marks.append(k)
    return _whole(texts), np.array(marks, np.int64)


def _whole(texts: list[list[int]]) -> Windows:
    """One window for each text, however long."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = positions(np.array([w for t in texts for w in t], np.int64), sizes)
    return Windows.of(at, np.repeat(np.arange(len(texts)), sizes), np.zeros(len(texts), bool))


class _Loss:
    """The loss to be minimised: each family weighs the same, the unknown class as much as all of them.

    What is held here are notices and decoys; the corpus adds its sums over unknown windows.
    tied: where the weights of a position are; n-grams that a model has not seen have those of the other n-grams of their length.
    """

    def __init__(self, notices: tuple[Windows, np.ndarray], decoys: Windows, unknown: float, squares: np.ndarray, tied: np.ndarray):
        (self.notices, self.marks), self.decoys, self.tied = notices, decoys, tied
        self.part = 0.5 * (1 - DECOY_SHARE) / unknown if unknown else 0.0
        self.share = 0.5 / (len(FAMILIES) - 1) / np.bincount(self.marks, minlength=len(FAMILIES))[self.marks]
        self.decoy_share = np.full(len(decoys), 0.5 * (DECOY_SHARE if unknown else 1.0) / len(decoys))
        every = self.part * squares + self.notices.squares(self.share) + decoys.squares(self.decoy_share)
        self.scale = np.sqrt(np.bincount(tied, every, len(tied)) + RIDGE)[:, None]

    def weights(self, u: np.ndarray) -> np.ndarray:
        """Weights at a place of the descent, where every position is as steep as another."""
        return (u / self.scale)[self.tied]

    def at(self, u: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient at a place; sums: the corpus's loss and gradient by weight there."""
        w = self.weights(u)
        value, slope = self.part * sums[0], self.part * sums[1:].reshape(w.shape)
        for texts, marks, share in ((self.notices, self.marks, self.share), (self.decoys, np.zeros(len(self.decoys), np.int64), self.decoy_share)):
            p = _softmax(texts.logits(w))
            value -= np.log(p[np.arange(len(p)), marks] + 1e-300) @ share
            slope = slope + texts.slope((p - np.eye(len(FAMILIES))[marks]) * share[:, None])
        out = np.zeros_like(slope)
        np.add.at(out, self.tied, slope)
        own = u / self.scale
        own[-1] = 0
        return value + 0.5 * RIDGE * (own**2).sum(), (out + RIDGE * own) / self.scale


def _descent(w: np.ndarray) -> Iterator[np.ndarray]:
    """L-BFGS: gives a place, is sent loss and gradient there; returns the best place."""
    loss, g = yield w
    last: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.abs(g).max() >= STILL:
        d, turns = -g, []
        for s, y, r in reversed(last):
            turns.append(r * (s * d).sum())
            d = d - turns[-1] * y
        if last:
            s, y, r = last[-1]
            d = d / (r * (y * y).sum())
        for (s, y, r), a in zip(last, reversed(turns)):
            d = d + (a - r * (y * d).sum()) * s
        step, fall = 1.0, (g * d).sum()
        while True:
            new = w + step * d
            new_loss, new_g = yield new
            if new_loss <= loss + 1e-4 * step * fall:
                break
            if step < 1e-3:
                return w
            step *= 0.3
        s, y = new - w, new_g - g
        if (s * y).sum() > 1e-12:
            last = [*last[1 - MEMORY :], (s, y, 1 / (s * y).sum())]
        w, loss, g = new, new_loss, new_g
    return w


def _minimised(losses: list[_Loss], added) -> list[np.ndarray]:
    """The weights of the two models, found together: a pass over the corpus serves both."""
    start = np.zeros((POSITIONS + 1, len(FAMILIES)))
    ways = [_descent(start) for _ in losses]
    at = [next(way) for way in ways]
    best, least, open_ = list(at), [np.inf] * len(at), set(range(len(at)))
    for _ in range(PASSES):
        weights = np.stack([loss.weights(u) for loss, u in zip(losses, at)])
        sums = added(unknown_slopes, weights) if any(x.part for x in losses) else np.zeros((len(at), 1 + start.size))
        for k in sorted(open_):
            value, slope = losses[k].at(at[k], sums[k])
            if value < least[k]:
                best[k], least[k] = at[k], value
            try:
                at[k] = ways[k].send((value, slope))
            except StopIteration:
                open_.remove(k)
        if not open_:
            break
    return [loss.weights(u) for loss, u in zip(losses, best)]


def fit(added, seed: int = 7) -> tuple[LicenseModel, dict[str, float]]:
    """The calibrated model, and what the calibration measured: recall of the notices left out, share of unknown that passes.

    added(part, *args) is the sum of part(windows, *args) over all windows of the corpus.
    """
    rng = np.random.default_rng(seed)
    trained, held, *counts = added(unknown_counts).tolist()
    filler, squares = np.array(counts[: len(NUMBER) + 1]), np.array(counts[len(NUMBER) + 1 :])
    out = {f: ts[:LEFT_OUT] + ts[LEFT_OUT + 1 :] for f, ts in TEMPLATES.items()}
    decoys = [[NUMBER[w] for w in words_of(t)] for t in DECOYS]
    seen = {g for t in [t for ts in out.values() for t in ts] + DECOYS[:-2] for g in ngrams(t)}
    every = np.arange(POSITIONS + 1)
    tied = every.copy()
    tied[:OTHER] = [k if g in seen else OTHER + len(g) - 1 for g, k in PLACE.items()]
    share = trained / max(1.0, trained + held)
    less, full = _minimised([_Loss(_forms(out, filler, rng), _whole(decoys[:-2]), trained, share * squares, tied), _Loss(_forms(TEMPLATES, filler, rng), _whole(decoys), trained + held, squares, every)], added)

    left, marks = _forms({f: ts[LEFT_OUT : LEFT_OUT + 1] for f, ts in TEMPLATES.items()}, filler, rng)
    others = _whole(decoys[-2:])
    others.held[:] = True
    z, n = left.logits(less), held + len(others)
    unknown = unknown_losses(others, less) + (added(unknown_losses, less) if held else 0)
    known = np.array([-np.log(_softmax(z / t)[np.arange(len(z)), marks] + 1e-12).mean() for t in TEMPERATURES])
    temperature = float(TEMPERATURES[np.argmin(known + unknown / n)])
    passing = unknown_passing(others, less, temperature) + (added(unknown_passing, less, temperature) if held else 0)
    above = np.append(np.cumsum(passing[::-1])[::-1], 0)
    least = max(round(LEAST_LIMIT * BINS), int(np.flatnonzero(above <= UNKNOWN_SHARE * n)[0]))
    limit = least / BINS
    p = _softmax(z / temperature)
    recall = float(((p.argmax(1) == marks) & (p.max(1) >= limit)).mean())
    weights = np.zeros((1 << BITS, len(FAMILIES)))
    weights[:POSITIONS] = full[:-1]
    measured = {"recall": recall, "unknown": float(above[least] / n), "temperature": temperature, "limit": limit, "trained": trained, "left_out": held}
    return LicenseModel(weights, full[-1], temperature, limit), measured


def train(negatives: list[str], seed: int = 7) -> tuple[LicenseModel, dict[str, float]]:
    """fit() with the paragraphs given here as the corpus."""
    collected = Collected()
    collected.add(corpus_windows([w for t in negatives if (w := words_of(t))], _WordHash()))
    windows = collected.taken()
    return fit(lambda part, *args: part(windows, *args), seed)


def _spans(line: str) -> list[tuple[int, int]]:
    """Where the words of a line stand.  Lower case may be longer than its letter, so words are found in the line itself."""
    return [m.span() for m in _WORD.finditer(line)]


def find_licences(texts: list[str], model: LicenseModel, memo: _WordHash) -> Iterator[tuple[int, int, int, str, float, float, bool]]:
    """(text, start, end, family, probability, likeness, confirmed) of each licence paragraph, by text and start."""
    part: list[tuple[int, int, int, str, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        for k, line in enumerate(text.split("\n")):
            if words := words_of(line):
                part.append((i, k, at, line, words))
                size += len(words)
            at += len(line) + 1
        if size >= BATCH_WORDS:
            yield from _found(texts, part, model, memo)
            part, size = [], 0
    yield from _found(texts, part, model, memo)


def _found(texts: list[str], part: list, model: LicenseModel, memo: _WordHash) -> Iterator[tuple]:
    if not part:
        return
    owner, first, family, p = model.windows([x[-1] for x in part], memo)
    hit = np.flatnonzero((family > 0) & (p >= model.limit))
    # [text, line, start, end, family, probability, first and last block of the line]
    runs: list[list] = []
    for o, b, f, q in zip(owner[hit].tolist(), first[hit].tolist(), family[hit].tolist(), p[hit].tolist()):
        i, k, at, line, words = part[o]
        spans = _spans(line)
        low, high = b * BLOCK, min(len(spans), b * BLOCK + WINDOW) - 1
        whole = low == 0 and high >= len(words) - 1
        start = at if whole else at + spans[min(low, high)][0]
        end = at + len(line) if whole else at + spans[high][1]
        if runs and runs[-1][0] == i and runs[-1][4] == f and (runs[-1][3] >= start or runs[-1][1] == k - 1 and whole and runs[-1][6]):
            runs[-1][1], runs[-1][3], runs[-1][5] = k, max(runs[-1][3], end), max(runs[-1][5], q)
        else:
            runs.append([i, k, start, end, f, q, whole])
    for i, _, start, end, f, q, _ in runs:
        likeness = model.likeness(f, texts[i][start:end])
        yield i, start, end, FAMILIES[f], q, likeness, likeness >= CONFIRM


def spooled_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The training windows of all paragraphs of all texts, equal ones of a task made one as far as PACK of them go; spooled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, collected, part, size = _WordHash(), Collected(), [], 0

        def rows(most: int) -> Iterator[pa.RecordBatch]:
            collected.add(corpus_windows(part, memo))
            part.clear()
            if len(collected.times) > most:
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in collected.taken().packed().items()})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if words := words_of(line):
                        part.append(words)
                        size += len(words)
                if size >= BATCH_WORDS:
                    yield from rows(PACK)
                    size = 0
        yield from rows(0)

    return spool(docs.select(F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{k} binary" for k in PACKED)), codec="zstd")


def added_windows(windows: DataFrame, tasks: int, part, *args) -> np.ndarray:
    """The sum of part(windows, *args) over spooled windows, added in a tree."""
    context = windows.sparkSession.sparkContext
    shared = context.broadcast(args)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                own = part(Windows.unpacked(row), *shared.value)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                own = np.frombuffer(v.as_buffer(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    sums = windows.mapInArrow(first, "v binary")
    while tasks > LAST_PARTS:
        tasks = max(LAST_PARTS, -(-tasks // FAN_IN))
        sums = sums.repartition(tasks).mapInArrow(add, "v binary")
    total = part(Collected().taken(), *args)
    for r in sums.collect():  # LAST_PARTS rows at most
        total = total + np.frombuffer(r["v"], np.float64).reshape(total.shape)
    shared.destroy()
    return total


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points), family, probability, likeness, confirmed, one row per licence paragraph."""
    spark = docs.sparkSession
    ship(spark)
    windows = spooled_windows(docs, text_col)
    tasks = windows.rdd.getNumPartitions()
    model, _ = fit(lambda part, *args: added_windows(windows, tasks, part, *args))
    release(windows)
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["start", "end", "family", "probability", "likeness", "confirmed"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, _WordHash()
        for batch in batches:
            found = list(find_licences([t or "" for t in batch.column(1).to_pylist()], model, memo))
            columns = [pa.array([r[k + 1] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in found], pa.int64())), *columns], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {id_type}, start int, end int, family string, probability double, likeness double, confirmed boolean"
    return rows.mapInArrow(run, schema)
