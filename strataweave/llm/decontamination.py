"""Benchmark decontamination by latent semantic retrieval.

A first pass over all documents writes their words as numbers of the benchmark's words
and counts the document frequencies of these.  Words of at most MAX_DF of the documents
are content words.  A randomised SVD of the TF-IDF passages of all documents (sums of
A'(A Q) in a tree of tasks, two power steps) gives the latent space.  A last pass
over the numbers compares every window of the words with every item by latent
cosine, as one matrix product a block of words: windows are as long as the items of
a length class, and begin every fifth of that or every GRAIN words.  The windows that reach the cosine are
the candidates.  They are confirmed by the longest common subsequence of words: a long
one alone, or a shorter one together with the item's answer, its last words.  Two counts
spare candidates that this cannot confirm: a subsequence of a share s leaves out at most
(1 - s) of the item's words, so all but as many of its content words must be near the
window; and the shorter share needs an occurrence of the answer.  Then the subsequence
of a stretch of the text bounds those of the windows in it.

Words outside the benchmark have no direction in the latent space: the words that a
paraphrase puts in their place do not turn its window away from the item.

Bounds: the benchmark is the stated query set and must have at most MAX_ITEMS
items (checked); all else, the SVD too, covers every document, whole.  A task holds
BLOCK_WORDS words at a time; longer texts are taken in overlapping blocks.

Defined results
* null or empty texts: never a leak.  Items of under MIN_WORDS words are skipped.
* a null doc_id can leak; its row carries the null.
* repeated rows each give their own rows; equal items each give theirs.
* an empty table or benchmark gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spool

MAX_ITEMS = 100_000
MIN_WORDS = 5
PASSAGE = 32
LATENT, SPARE, POWER_STEPS = 64, 16, 2
#: Weights of a chunk of passages, partial sums that one task adds up, and that reach the driver.
CHUNK_WEIGHTS, FAN_IN, LAST_PARTS = 1 << 16, 32, 4
#: Most cells of a matrix of words by words that a task holds, and cells of it that one row carries.
GRAM_CELLS, ROW_CELLS = 1 << 24, 1 << 20
#: Words that a task compares at a time, windows a word of the item, and growth of the length classes.
BLOCK_WORDS, WINDOWS, CLASS_STEP = 1 << 16, 5, 1.5
#: Most windows, and numbers, of a block of cosines.
BLOCK_WINDOWS, BLOCK_COSINES = 1 << 11, 1 << 18
#: Words whose vectors are summed before windows are made of them, and grains whose sums run on in single precision.
GRAIN, RUN = 4, 32
POSITION_BITS = 32
#: Least latent cosine of a candidate window.
COSINE = 0.5
#: Shares of the item's words that the common subsequence must reach: alone, or with the answer.
LCS_ALONE, LCS_ANSWERED = 0.7, 0.5
ANSWER_WORDS = 4
#: Lengths of the item that a stretch of the text, which is compared before its windows, has at most.
STRETCH = 4
SEED = 11
#: A content word is in at most this share of the documents; an item with fewer than
#: MIN_CONTENT of them counts all its words as such.
MAX_DF, MIN_CONTENT = 0.1, 3
#: A-Z to lower case, ASCII punctuation to blanks, all else as it is.
_TABLE = bytes(ord(" ") if chr(b) in string.punctuation else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def places_of(x: list) -> dict:
    """Where each word stands, as bits."""
    at: dict = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs_of_bits(m: int, bits: Iterable[int]) -> int:
    """lcs_length of m words with words given by places_of; those that are not among the m change nothing."""
    full = row = (1 << m) - 1
    for places in bits:
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return m - row.bit_count()


def lcs_length(x: list, y: list) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one number."""
    at = places_of(x)
    return lcs_of_bits(len(x), [at[w] for w in y if w in at])


class Items:
    """The benchmark's items, their vocabulary and word counts."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(i, w) for i, t in rows if len(w := words_of(t or "")) >= MIN_WORDS]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.number = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.sizes = np.array([len(w) for w in self.words], np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Set idf (0 for words that are no content) and which items hold a content word."""
        idf = np.log((1 + n_docs) / (1 + df)) + 1e-3
        content = df <= max(1.0, MAX_DF * n_docs)
        own = [sorted({self.number[w] for w in ws}) for ws in self.words]
        rich = [[k for k in ids if content[k]] for ids in own]
        kept = [r if len(r) >= MIN_CONTENT else ids for r, ids in zip(rich, own)]
        self.idf = np.zeros(len(df))
        for ids in kept:
            self.idf[ids] = idf[ids]
        # the items that hold each content word, word by word
        holders: list[list[int]] = [[] for _ in range(len(df) + 1)]
        for item, ids in enumerate(rich):
            for k in ids:
                holders[k].append(item)
        self.starts = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.holders = np.array([item for h in holders for item in h], np.int64)
        n_content = np.array([sum(bool(content[self.number[w]]) for w in ws) for ws in self.words], np.int64)
        #: Content words that a common subsequence of each share cannot do without.
        self.least = {s: n_content - (self.sizes - np.ceil(s * self.sizes - 1e-9).astype(np.int64)) for s in (LCS_ALONE, LCS_ANSWERED)}


def numbered(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """The words' numbers; len(number) for all other words."""
    return np.fromiter(map(number.get, words, repeat(len(number))), np.int32, len(words))


def first_pass(docs: DataFrame, items: Items) -> DataFrame:
    """kind 0: document frequencies by word, then the number of documents (int64); 1: each document's words by number (int32).

    Documents without a word of the benchmark have no row of kind 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        seen = np.zeros(len(number) + 1, np.int64)
        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            begin, size, own = 0, 0, []
            for k, t in enumerate(batch.column(1)):
                ids = numbered(words_of(t.as_py() or ""), number)
                met = np.unique(ids)
                seen[met[met < len(number)]] += 1
                seen[-1] += 1
                own.append(ids.tobytes() if len(met) and met[0] < len(number) else None)
                size += len(ids)
                if size >= 4 * BLOCK_WORDS or k == batch.num_rows - 1:
                    held = pa.array(own, pa.binary())
                    mask = held.is_valid()
                    held = held.filter(mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(len(held), np.int32)), batch.column(0).slice(begin, len(own)).filter(mask), held], names=["kind", "doc_id", "ids"]
                    )
                    begin, size, own = k + 1, 0, []
        if id_kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, id_kind), pa.array([seen.tobytes()], pa.binary())], names=["kind", "doc_id", "ids"])

    return docs.mapInArrow(run, f"kind int, doc_id {id_type}, ids binary")


def _in_tree(rows: DataFrame, first, add, schema: str) -> DataFrame:
    """What add makes of first's rows in tasks of FAN_IN parts, until LAST_PARTS are left; spooled."""
    n = rows.rdd.getNumPartitions()
    sums = spool(rows.mapInArrow(first, schema))
    while n > LAST_PARTS:
        n = max(LAST_PARTS, -(-n // FAN_IN))
        last, sums = sums, spool(sums.coalesce(n).mapInArrow(add, schema))
        release(last)
    return sums


def _added(rows: DataFrame, dtype: type, part) -> np.ndarray | None:
    """The sum of arrays that part makes of a task's batches, added in a tree; None without rows.  part: batches -> an array or None."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (total := part(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                own = np.frombuffer(v.as_buffer(), dtype)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    sums = _in_tree(rows, first, add, "v binary")
    total = None
    for r in sums.collect():  # LAST_PARTS rows at most
        own = np.frombuffer(r["v"], dtype)
        total = own.copy() if total is None else total + own
    release(sums)
    return total


def frequencies(counts: DataFrame, n: int) -> np.ndarray:
    """The sum of first_pass's rows of kind 0."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for v in batch.column(0):
                own = np.frombuffer(v.as_buffer(), np.int64)
                total = own.copy() if total is None else total + own
        return total

    total = _added(counts.select("ids"), np.int64, part)
    return np.zeros(n, np.int64) if total is None else total


def weighed_passages(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """texts (ids) -> chunks of TF-IDF passages: ids, weights and the number of each passage's ids, passages of norm 1."""
    shared = texts.sparkSession.sparkContext.broadcast(np.append(idf, 0.0))

    def chunk(parts: list[np.ndarray]) -> pa.RecordBatch:
        code = np.sort(np.concatenate(parts))
        fresh = np.flatnonzero(np.diff(code, prepend=-1))
        n = np.diff(fresh, append=len(code))
        code, width = code[fresh], len(shared.value)
        passage, ids = np.divmod(code, width)
        weight = n * shared.value[ids]
        begins = np.flatnonzero(np.diff(passage, prepend=-1))
        sizes = np.diff(begins, append=len(ids))
        weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, begins)), sizes)
        return pa.RecordBatch.from_pydict(
            {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("ids", ids.astype(np.int32)), ("weights", weight.astype(np.float32)), ("sizes", sizes.astype(np.int32)))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        parts, size, at = [], 0, 0
        for batch in batches:
            for v in batch.column(0):
                ids = np.frombuffer(v.as_buffer(), np.int32)
                own = np.flatnonzero(idf[ids] > 0)
                if len(own):
                    parts.append((at + own // PASSAGE) * len(idf) + ids[own])
                    size += len(own)
                at += -(-len(ids) // PASSAGE)
                if size >= CHUNK_WEIGHTS:
                    yield chunk(parts)
                    parts, size = [], 0
        if parts:
            yield chunk(parts)

    return texts.mapInArrow(run, "ids binary, weights binary, sizes binary")


def gram_matrix(passages: DataFrame, n: int) -> DataFrame:
    """A'A of the passages: cells i * n + j, i <= j, and their sums; a cell is in up to LAST_PARTS rows."""

    def cells(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        at = np.zeros(0, np.int64) if total is None else np.flatnonzero(total)
        for k in range(0, len(at), ROW_CELLS):
            own = at[k : k + ROW_CELLS]
            yield pa.RecordBatch.from_pydict({"cells": pa.array([own.astype(np.int32).tobytes()], pa.binary()), "sums": pa.array([total[own].tobytes()], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in (0, 2))
                weights = np.frombuffer(batch.column(1)[k].as_buffer(), np.float32).astype(np.float64)
                passage = np.repeat(np.arange(len(sizes)), sizes)
                total = np.zeros(n * n) if total is None else total
                for d in range(int(sizes.max())):  # the ids of a passage rise
                    left = np.flatnonzero(passage[d:] == passage[: len(passage) - d])
                    np.add.at(total, ids[left].astype(np.int64) * n + ids[left + d], weights[left] * weights[left + d])
        yield from cells(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cells(_dense(batches, n * n))

    return _in_tree(passages, first, add, "cells binary, sums binary")


def _dense(batches: Iterator[pa.RecordBatch], size: int) -> np.ndarray | None:
    """The sum of rows (cells, sums); a row has a cell once."""
    total = None
    for batch in batches:
        for k in range(batch.num_rows):
            total = np.zeros(size) if total is None else total
            total[np.frombuffer(batch.column(0)[k].as_buffer(), np.int32)] += np.frombuffer(batch.column(1)[k].as_buffer(), np.float64)
    return total


def latent_space(passages: DataFrame, items: Items, seed: int = SEED) -> np.ndarray:
    """words x LATENT: right singular vectors of the TF-IDF passages, by a randomised SVD.

    passages: as weighed_passages makes them, spooled.  A'(A Q) is (A'A) Q where A'A has at
    most GRAM_CELLS cells, so that they are read once; else they are read once a step.
    """
    n, idf = len(items.number), items.idf
    rng = np.random.default_rng(seed)
    width = min(n, LATENT + SPARE)
    q = rng.standard_normal((n, width))

    def product(rows: list[np.ndarray], q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        for ids in rows:
            a = np.bincount(ids, minlength=0)
            at = np.flatnonzero(a)
            v = a[at] * idf[at]
            v /= np.linalg.norm(v) or 1.0
            out[at] += np.outer(v, v @ q[at])
        return out

    own = [np.array([items.number[w] for w in ws], np.int64) for ws in items.words]
    few = n * n <= GRAM_CELLS
    rows = gram_matrix(passages, n) if few else passages
    for _ in range(POWER_STEPS + 1):
        shared = passages.sparkSession.sparkContext.broadcast(q.astype(np.float32))

        def by_gram(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray | None:
            q, upper = shared.value.astype(np.float64), _dense(batches, n * n)
            if upper is None:
                return None
            upper = upper.reshape(n, n)
            return upper @ q + upper.T @ q - upper.diagonal()[:, None] * q

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray | None:
            q, total = shared.value, None
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, sizes = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in (0, 2))
                    weights = np.frombuffer(batch.column(1)[k].as_buffer(), np.float32)[:, None]
                    total = np.zeros(q.shape) if total is None else total
                    sums = np.add.reduceat(q[ids] * weights, np.cumsum(sizes) - sizes)
                    order = np.argsort(ids, kind="stable")
                    begins = np.flatnonzero(np.diff(ids[order], prepend=-1))
                    back = sums[np.repeat(np.arange(len(sizes)), sizes)[order]] * weights[order]
                    total[ids[order][begins]] += np.add.reduceat(back, begins)
            return total

        y = product(own, q)
        found = _added(rows, np.float64, by_gram if few else part)
        if found is not None:
            y += found.reshape(y.shape)
        shared.unpersist()
        q, _ = np.linalg.qr(y)
    if few:
        release(rows)
    # the last product gives the singular values of the range found
    u, s, _ = np.linalg.svd(y.T @ q)
    return (q @ u)[:, : min(LATENT, width)]


def _polynomial(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of ANSWER_WORDS words from each of the first n positions."""
    out = np.zeros(n, np.uint64)
    for k in range(ANSWER_WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return out


class Search:
    """Windows of texts against all items."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items = items
        # the last row is that of all other words
        self.vectors = np.vstack([items.idf[:, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)
        own = np.stack([self.vectors[[items.number[w] for w in ws]].sum(0, dtype=np.float64) for ws in items.words])
        self.own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.own_ids = [np.array([items.number[w] for w in ws], np.int64) for ws in items.words]
        classes: dict[int, list[int]] = {}
        for k, m in enumerate(items.sizes.tolist()):
            length = MIN_WORDS
            while length * CLASS_STEP**0.5 < m:  # the nearest class, by ratio
                length = int(length * CLASS_STEP) + 1
            classes.setdefault(length, []).append(k)
        self.classes = [(length, np.array(at)) for length, at in sorted(classes.items())]
        self.most = max(length for length, _ in self.classes)
        self.among = np.zeros(len(items.number) + 1, bool)  # the words of the item at hand
        codes = np.array([_polynomial(ids[-ANSWER_WORDS:], 1)[0] for ids in self.own_ids])
        self.answer_items = np.argsort(codes, kind="stable")
        self.answer_codes = codes[self.answer_items]

    def blocks(self, texts: Iterable[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Parts (text, first word, numbers of words) of about BLOCK_WORDS in all; parts of one text overlap by the longest reach."""
        part, size, overlap = [], 0, 3 * self.most
        for i, words in enumerate(texts):
            at = 0
            while True:
                own = words[at : at + BLOCK_WORDS + overlap]
                part.append((i, at, own))
                size += len(own)
                at += BLOCK_WORDS
                if size >= BLOCK_WORDS:
                    yield part
                    part, size = [], 0
                if at >= len(words):
                    break
        if part:
            yield part

    def prefix_sums(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the vectors before each grain, within its run of grains, and before each run, in double."""
        vectors, width = self.vectors, self.vectors.shape[1]
        n = len(ids) // GRAIN
        runs = np.zeros((n // RUN + 1, RUN, width), np.float32)
        grains = runs.reshape(-1, width)[:n]
        for k in range(GRAIN):
            grains += vectors.take(ids[k::GRAIN], 0)
        inside = (np.tri(RUN, k=-1, dtype=np.float32) @ runs).reshape(-1, width)
        before = np.zeros((len(runs), width))
        np.cumsum(runs[:-1].sum(1, dtype=np.float64), 0, out=before[1:])
        return inside, before

    def near(self, item: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """How many of the sorted keys (item, position) lie in [a, b), window by window."""
        base = item.astype(np.int64) << POSITION_BITS
        return np.searchsorted(keys, base + b) - np.searchsorted(keys, base + a)

    def candidates(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Items, first words, ends and cosines of the windows that reach COSINE and can be confirmed; those of an item by first word.

        starts, ends: where the text of each word begins and ends.
        """
        inside, before = self.prefix_sums(ids)
        items = self.items
        first, n = items.starts[ids], items.starts[ids + 1] - items.starts[ids]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        content = np.sort((items.holders[at] << POSITION_BITS) + np.repeat(np.arange(len(ids)), n))
        answers = self.answers_in(ids)
        # content words and answers of any item before each word: at least as many as of one item
        contents = np.concatenate([[0], np.cumsum(n > 0)])
        answered = np.concatenate([[0], np.cumsum(np.bincount(answers & ((1 << POSITION_BITS) - 1), minlength=len(ids)))])
        sizes = items.sizes
        for length, among in self.classes:
            step = max(1, length // (WINDOWS * GRAIN)) * GRAIN
            own = self.own[among]
            rows = max(1, min(BLOCK_WINDOWS, BLOCK_COSINES // len(among)))
            for k in range(0, len(ids), rows * step):
                begin = np.arange(k, min(len(ids), k + rows * step), step)
                end = np.minimum(begin + -(-length // GRAIN) * GRAIN, ends[begin])
                x, y = begin // GRAIN, end // GRAIN
                v = inside.take(y, 0)
                v -= inside[x[0] : x[-1] + 1 : step // GRAIN]
                over = np.flatnonzero(x // RUN != y // RUN)
                v[over] += before[y[over] // RUN] - before[x[over] // RUN]
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                full = np.flatnonzero(norm > 1e-4)
                if len(full) < len(v):
                    begin, end, v, norm = begin[full], end[full], v[full], norm[full]
                v /= norm[:, None]
                cosine = v @ own.T
                hit = np.flatnonzero(cosine >= COSINE)
                at, of = np.divmod(hit, len(among))
                item, x, y, cosine = among[of], begin[at], end[at], cosine.ravel()[hit]
                a, b = np.maximum(starts[x], x - sizes[item] // 2), np.minimum(ends[x], y + sizes[item] // 2)
                most = contents[b] - contents[a]
                can = most >= items.least[LCS_ALONE][item]
                if len(answers):
                    can |= (answered[b] > answered[a]) & (most >= items.least[LCS_ANSWERED][item])
                if not can.any():
                    continue
                item, x, y, cosine, a, b = (z[can] for z in (item, x, y, cosine, a, b))
                held = self.near(item, a, b, content)
                can = held >= items.least[LCS_ALONE][item]
                if len(answers):
                    can |= (self.near(item, a, b, answers) > 0) & (held >= items.least[LCS_ANSWERED][item])
                yield item[can], x[can], y[can], cosine[can]

    def answers_in(self, ids: np.ndarray) -> np.ndarray:
        """Sorted keys (item, position) of where items' answers begin, by a hash of their words."""
        n = len(ids) - ANSWER_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code = _polynomial(ids, n)
        left = np.searchsorted(self.answer_codes, code)
        at = np.flatnonzero(self.answer_codes.take(left, mode="clip") == code)
        left, right = left[at], np.searchsorted(self.answer_codes, code[at], "right")
        n = right - left
        of = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.sort((self.answer_items[of] << POSITION_BITS) + np.repeat(at, n))

    def find(self, texts: list[str]) -> list[tuple[int, int, int, float, float, bool]]:
        """(text, item, first word, cosine, share, answered) of the confirmed items, the best window of each."""
        return self.find_numbered(numbered(words_of(t), self.items.number) for t in texts)

    def find_numbered(self, texts: Iterable[np.ndarray]) -> list[tuple[int, int, int, float, float, bool]]:
        """find, of texts as numbers of words."""
        other = len(self.items.number)
        best: dict[tuple[int, int], tuple] = {}
        for part in self.blocks(texts):
            # each part is filled up to whole grains with the other word
            sizes = np.array([len(own) for _, _, own in part], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + -sizes % GRAIN)])
            ids = np.full(starts[-1], other, np.int64)
            for (_, _, own), at in zip(part, starts.tolist()):
                ids[at : at + len(own)] = own
            owner = np.repeat(np.arange(len(part)), np.diff(starts))
            met = list(self.candidates(ids, starts[owner], starts[owner + 1]))
            if not met:
                continue
            items, begins, ends, cosines = map(np.concatenate, zip(*met))
            of = owner[begins]
            order = np.lexsort((items, of))
            fresh = (np.diff(of[order], prepend=-1) != 0) | (np.diff(items[order], prepend=-1) != 0)
            for rows in np.split(order, np.flatnonzero(fresh)[1:]):
                if not len(rows):
                    continue
                p, item = int(of[rows[0]]), int(items[rows[0]])
                text, offset, _ = part[p]
                low, high = int(starts[p]), int(starts[p + 1])
                found = self.confirm(item, begins[rows] - low, ends[rows] - low, cosines[rows], ids[low:high])
                if found and (text, item) not in best or found and found[2] > best[text, item][2]:
                    best[text, item] = (offset + found[0], *found[1:])
        return [(text, item, *row) for (text, item), row in sorted(best.items())]

    def confirm(self, k: int, begins: np.ndarray, ends: np.ndarray, cosines: np.ndarray, ids: np.ndarray) -> tuple | None:
        """(first word, cosine, share, answered) of the best window that confirms the item.  begins, ends: rising.

        What is common to the item and a stretch of the text is at least what is common to it and a
        window there: a stretch that cannot confirm the item, or better it, spares its windows.
        """
        own = self.own_ids[k]
        m, best = len(own), None
        bits, answer = places_of(own.tolist()), own[-ANSWER_WORDS:].tobytes()
        a, b = np.maximum(0, begins - m // 2), np.minimum(len(ids), ends + m // 2)

        def answered(low: int, high: int) -> bool:
            near = ids[low:high]
            return any(near[x : x + ANSWER_WORDS].tobytes() == answer for x in np.flatnonzero(near == own[-ANSWER_WORDS]).tolist())

        first = 0
        while first < len(a):
            low = int(a[first])
            last = max(first + 1, int(np.searchsorted(b, low + STRETCH * m, "right")))
            high = int(b[last - 1])
            self.among[own] = True
            at = np.flatnonzero(self.among[ids[low:high]])
            self.among[own] = False
            words = [bits[w] for w in ids[low + at].tolist()]
            most = lcs_of_bits(m, words) / m if len(words) >= LCS_ANSWERED * m else 0.0
            if most >= LCS_ANSWERED and (best is None or most > best[2]) and (most >= LCS_ALONE or answered(low, high)):
                lefts, rights = (np.searchsorted(at + low, x[first:last]).tolist() for x in (a, b))
                for i, left, right in zip(range(first, last), lefts, rights):
                    share = lcs_of_bits(m, words[left:right]) / m
                    if share < LCS_ANSWERED or best is not None and share <= best[2]:
                        continue
                    if (own_answer := answered(int(a[i]), int(b[i]))) or share >= LCS_ALONE:
                        best = (int(a[i]), float(cosines[i]), share, own_answer)
            first = last
        return best


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """doc_id, item_id, first_word, cosine, lcs_share, answered: one row per document and item that it leaks."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).limit(MAX_ITEMS + 1).collect()
    if len(asked) > MAX_ITEMS:
        raise ValueError(f"the benchmark has more than {MAX_ITEMS} items")
    items = Items(sorted(((r[0], r[1]) for r in asked), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, first_word int, cosine double, lcs_share double, answered boolean"
    if not items.ids:
        return spark.createDataFrame([], schema)
    passed = spool(first_pass(rows, items), "kind", codec="zstd")
    seen = frequencies(passed.where("kind = 0"), len(items.number) + 1).astype(float)
    items.weigh(seen[:-1], int(seen[-1]))
    texts = passed.where("kind = 1").select("doc_id", "ids")
    passages = spool(weighed_passages(texts.select("ids"), items.idf))
    shared = spark.sparkContext.broadcast(Search(items, latent_space(passages, items)))
    release(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch in batches:
            found = search.find_numbered(np.frombuffer(v.as_buffer(), np.int32) for v in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in found], pa.int64())),
                    pa.array([search.items.ids[r[1]] for r in found], pa.int64()),
                    pa.array([r[2] for r in found], pa.int32()),
                    pa.array([r[3] for r in found], pa.float64()),
                    pa.array([r[4] for r in found], pa.float64()),
                    pa.array([r[5] for r in found], pa.bool_()),
                ],
                names=["doc_id", "item_id", "first_word", "cosine", "lcs_share", "answered"],
            )

    return texts.mapInArrow(run, schema)
