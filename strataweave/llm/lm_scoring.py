"""Language-model scoring with a weighted backoff automaton.

States are the histories of up to ORDER - 1 words that the training rows hold, the
empty one included.  A state h has an arc for every word w that follows it there, and
a failure arc to h without its first word, h'.  With Dirichlet smoothing

    arc      P(w | h) = (c(hw) + M P(w | h')) / (c(h) + M)
    failure  M / (c(h) + M), times P(w | h') where h has no arc for w

so every state's probabilities sum to one, and no n-gram is too rare to count.  At the
empty state stands the base P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The automaton grows with the corpus and is never gathered anywhere.  Texts are taken in
chunks of some megabytes.  A chunk's distinct n-grams, as sorted keys with their counts
in its training rows, are dealt to buckets by ranges of keys; a bucket adds up the
counts of all chunks and answers each with the totals, in the order of its keys.
Words have 64-bit keys.  Longer n-grams have SPARE_BITS more than would number the
corpus's bytes: one in some 2 ** SPARE_BITS of those looked up meets another's count.
From the answer the chunk compiles the part of the automaton that its own texts can
reach: all arcs and states on their way, with weights that are those of the whole.  One
traversal from left to right then carries the state and adds up log-probabilities.  It
runs over all texts of the chunk at once: what state a position is reached in depends
on the words before it alone, so each round takes every position along its arc or along
its failure arc.

Defined results
* null text: as the empty text, which is one end token.
* a null doc_id is a training row.  Repeated rows count, and are scored, one by one.
* without training rows N and V are 0 and every token has probability 0.5 / 0.5.
* an empty table gives an empty result; extra columns are ignored.  Texts are never cut.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spool

FOLDS, HELD_OUT = 5, 1
ORDER = 3
#: The weight M of the shorter history, in occurrences.
STRENGTH = 2.0
#: Bytes of text of a chunk, and of the texts whose n-grams one bucket adds up.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
SPARE_BITS = 24
#: Buckets of words as a share of those of n-grams.
WORD_BUCKETS = 8
MEMO_SIZE = 1 << 18
END, START = b"\n", b"\x00\n"


def tokens(text: str) -> list[bytes]:
    """Words of the text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_SIZE:
            self[word] = out
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Grams:
    """The n-grams of a chunk's texts, by position.

    Positions are those of the words and the end of each text.  keys[n] holds the key of
    the n-gram that ends at each position where has[n]: where that many words are there,
    a start before the text counting as one.
    """

    def __init__(self, texts: list[str], memo: _WordHash, order: int, bits: int):
        if len(memo) >= MEMO_SIZE:
            memo.clear()
        start, end = memo[START], memo[END]
        flat: list[int] = []
        sizes = []
        for t in texts:
            words = tokens(t)
            sizes.append(len(words) + 1)
            flat.append(start)
            flat += map(memo.__getitem__, words)
            flat.append(end)
        word = np.array(flat, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        inside = np.ones(len(word), bool)
        inside[self.begins + np.arange(len(sizes))] = False  # the starts
        first = np.zeros(len(word) - len(sizes), bool)
        first[self.begins] = True
        self.first, self.order = first, order
        # grams that would reach over a text's beginning have a start inside: at the first position all but bigrams
        self.has = {n: (np.ones(len(first), bool) if n < 3 else ~first) for n in range(1, order + 1)}
        self.keys = {1: word[inside]}
        code = word
        for n in range(2, order + 1):
            code = np.concatenate([np.zeros(1, np.uint64), _mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])])
            self.keys[n] = code[inside][self.has[n]] >> np.uint64(64 - bits)

    def longer(self) -> np.ndarray:
        return np.concatenate([self.keys[n] for n in range(2, self.order + 1)])


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 up as bytes: their width and number, then planes of their bytes, compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", blob)
    planes = pa.decompress(memoryview(blob)[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _bounds(buckets: int, bits: int) -> np.ndarray:
    """The least key of every bucket after the first."""
    return np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each stands at a training position."""
    learned = keys[train]
    learned.sort()
    other = keys[~train]
    other.sort()
    every = np.concatenate([learned, other])
    every.sort(kind="stable")  # merges the two
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    every = every[fresh]
    return every, np.searchsorted(learned, every, "right") - np.searchsorted(learned, every)


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(chunk, ids, texts): the rows' texts by chunks, compressed."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        chunk = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            blob = _pack_texts(texts)
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([chunk]), listed, pa.array([blob], pa.binary())], names=["chunk", "ids", "texts"])

        for batch in batches:
            begin = 0
            for k, cell in enumerate(batch.column(1)):
                texts.append(cell.as_py() or "")
                size += len(texts[-1]) + 16
                if size >= CHUNK_BYTES:
                    ids.append(batch.column(0).slice(begin, k + 1 - begin))
                    begin = k + 1
                    yield row()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
            ids.append(batch.column(0).slice(begin))
        if texts:
            yield row()

    return rows.mapInArrow(run, f"chunk long, ids array<{id_type}>, texts binary")


def _pack_texts(texts: list[str]) -> bytes:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    whole = b"".join([struct.pack(f"<Q{len(parts)}Q", len(parts), *map(len, parts)), *parts])
    return struct.pack("<Q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack_texts(blob: bytes) -> list[str]:
    (size,) = struct.unpack_from("<Q", blob)
    whole = pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd", asbytes=True)
    (n,) = struct.unpack_from("<Q", whole)
    sizes = struct.unpack_from(f"<{n}Q", whole, 8)
    out, at = [], 8 * (n + 1)
    for m in sizes:
        out.append(whole[at : at + m].decode("utf-8", "surrogatepass"))
        at += m
    return out


def chunk_grams(chunks: DataFrame, order: int, buckets: int, bits: int) -> DataFrame:
    """(chunk, bucket, keys, counts): a chunk's distinct n-grams by buckets; the buckets of words come after the others."""
    bounds = [(_bounds(buckets, bits), 0), (_bounds(-(-buckets // WORD_BUCKETS), 64), buckets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHash()
        for batch in batches:
            for chunk, ids, blob in zip(*(batch.column(k) for k in range(3))):
                grams = Grams(_unpack_texts(blob.as_py()), memo, order, bits)
                train = np.repeat(~np.array([is_held_out(i) for i in ids.as_py()], bool), grams.sizes)
                own = np.concatenate([train[grams.has[n]] for n in range(2, order + 1)])
                number, keys, counts = [], [], []
                for (cuts, base), (every, c) in zip(bounds, (_counted(grams.longer(), own), _counted(grams.keys[1], train))):
                    ends = [0, *np.searchsorted(every, cuts).tolist(), len(every)]
                    for k, (a, b) in enumerate(zip(ends, ends[1:])):
                        if b > a:
                            number.append(base + k)
                            keys.append(_pack(np.diff(every[a:b], prepend=np.uint64(0))))
                            counts.append(_pack(c[a:b]))
                columns = [pa.array([chunk.as_py()] * len(number), pa.int64()), pa.array(number, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "keys", "counts"])

    return chunks.mapInArrow(run, "chunk long, bucket int, keys binary, counts binary")


def bucket_totals(keys: DataFrame, buckets: int) -> DataFrame:
    """(of_chunk, bucket, totals): the counts over all chunks, in the order of each chunk's keys.

    n_tokens, n_words, n_texts: the bucket's share of the training tokens, of the distinct
    words and of the texts, on one of its rows.
    """
    end_key = np.uint64(xxhash.xxh64_intdigest(END))

    def run(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unpack(k), dtype=np.uint64) for k in table["keys"].to_pylist()]
        counts = np.concatenate([_unpack(c) for c in table["counts"].to_pylist()])
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")  # merges the sorted parts
        rising = every[order]
        fresh = np.ones(len(every), bool)
        fresh[1:] = rising[1:] != rising[:-1]
        total = np.add.reduceat(counts[order], np.flatnonzero(fresh))
        answer = np.empty(len(every), np.uint64)
        answer[order] = total[np.cumsum(fresh) - 1]
        known = [0, 0, 0]
        if table["bucket"][0].as_py() >= buckets:
            known = [int(total.sum()), int((total > 0).sum()), int(total[rising[fresh] == end_key].sum())]
        at = np.cumsum([0, *map(len, parts)])
        more = [0] * (len(parts) - 1)
        return pa.table(
            {
                "of_chunk": table["chunk"],
                "bucket": table["bucket"],
                "totals": pa.array([_pack(answer[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                **{c: pa.array([v, *more], pa.int64()) for c, v in zip(("n_tokens", "n_words", "n_texts"), known)},
            }
        )

    schema = "of_chunk long, bucket int, totals binary, n_tokens long, n_words long, n_texts long"
    return keys.groupBy("bucket").applyInArrow(run, schema)


class Automaton:
    """The part of the automaton that a chunk's texts can reach, by position.

    counts[n]: of the n-gram that ends at the position; state[n]: of its history, the state
    of n - 1 words that the position may be reached in (0: the training rows lack it).
    """

    def __init__(self, grams: Grams, longer: np.ndarray, words: np.ndarray, n_tokens: int, n_words: int, n_texts: int):
        """longer, words: totals of the chunk's distinct n-grams, by key."""
        self.counts = {1: words[np.unique(grams.keys[1], return_inverse=True)[1]].astype(np.float64)}
        found, at = longer[np.unique(grams.longer(), return_inverse=True)[1]], 0
        self.state = {}
        for n in range(2, grams.order + 1):
            has = grams.has[n]
            own = len(grams.keys[n])
            self.counts[n] = np.zeros(len(has))
            self.counts[n][has] = found[at : at + own]
            at += own
            # c of the history: of the gram that ends one position earlier; at a text's beginning, of its start
            before = np.concatenate([[0.0], self.counts[n - 1][:-1]])
            before[grams.first] = n_texts if n == 2 else 0.0
            self.state[n] = before
        self.base = np.log10((self.counts[1] + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        self.arc, self.fail = {}, {}
        p = 10.0**self.base
        for n in self.state:
            p = (self.counts[n] + STRENGTH * p) / (self.state[n] + STRENGTH)
            self.arc[n] = np.log10(p)
            self.fail[n] = math.log10(STRENGTH) - np.log10(self.state[n] + STRENGTH)

    def traverse(self) -> np.ndarray:
        """log10 probability of the word at each position, given the state that the words before lead to."""
        out = np.zeros(len(self.base))
        at = np.ones(len(self.base), np.int8)  # words of the state, and one
        for n in self.state:
            at[self.state[n] > 0] = n
        for n in sorted(self.state, reverse=True):
            here = at == n
            arc = here & (self.counts[n] > 0)
            out[arc] += self.arc[n][arc]
            at[arc] = 0
            fall = here & ~arc
            out[fall] += self.fail[n][fall]
            at[fall] = n - 1
        empty = at == 1
        out[empty] += self.base[empty]
        return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per input row; 2 <= order <= 3."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = int(rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 1)
    buckets, bits = -(-size // BUCKET_BYTES), min(64, size.bit_length() + SPARE_BITS)
    chunks = spool(chunk_rows(rows))
    replies = spool(bucket_totals(chunk_grams(chunks, order, buckets, bits), buckets))
    r = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_texts")]).first()
    n_tokens, n_words, n_texts = (int(x) for x in r)
    id_type = docs.schema[id_col].dataType

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        memo = _WordHash()
        ids = texts["ids"].chunk(0)[0].values
        grams = Grams(_unpack_texts(texts["texts"][0].as_py()), memo, order, bits)
        replies = replies.sort_by("bucket")
        totals: tuple[list, list] = ([np.zeros(0, np.uint64)], [])
        for bucket, t in zip(replies["bucket"].to_pylist(), replies["totals"].to_pylist()):
            totals[bucket >= buckets].append(_unpack(t))
        model = Automaton(grams, *map(np.concatenate, totals), n_tokens, n_words, n_texts)
        add = lambda x: np.add.reduceat(x, grams.begins)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array([is_held_out(i) for i in ids.to_pylist()], pa.bool_()),
                "n_tokens": pa.array(grams.sizes),
                "n_known": pa.array(add((model.counts[1] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(ids), n_tokens, np.int64)),
                "base_score": pa.array(add(model.base)),
                "score": pa.array(add(model.traverse())),
            }
        )

    schema = (
        f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double"
    )
    replies = replies.select("of_chunk", "bucket", "totals").groupBy("of_chunk")
    return chunks.groupBy("chunk").cogroup(replies).applyInArrow(score, schema)
