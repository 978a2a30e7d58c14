"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

The corpus's commonest words are counted over all documents and compiled, with the
ids that they encode to, into a minimal acyclic automaton with shared suffixes.
Each state knows how many words its earlier arcs accept, so that a walk yields the
word's number and from it the ids.  The arcs lie in an open-addressing table of one flat
byte string, which each worker memory-maps from an unnamed temporary file.  The words of
a block of texts walk it together, a byte at a time: every occurrence is looked up there.
Words that the automaton does not hold are merged exactly by rank (and remembered), so
its size changes only the speed, never a result.

Defined results
* null text: as the empty text (no ids, empty decoded text).
* a special token's string inside a text becomes that token's id, as in the
  tokenizers library with its default settings.
* repeated rows are encoded one by one; an empty table gives an empty result.
* extra columns are ignored.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spool

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_SIZE = 1 << 16
#: Merged words that a worker remembers before it starts anew, and their longest.
MEMO_SIZE, MEMO_LETTERS = 1 << 18, 64
#: Words of a block that walk the automaton together.
BLOCK_WORDS = 1 << 15
#: Words from which on merges are found by a heap.
LONG_WORD = 64
#: Steps of the count histogram for each doubling.
COUNT_STEPS = 16
#: Distinct words that a counting task holds before it hands them on.
COUNT_SIZE = 1 << 19
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
OUTPUTS = {
    "ids": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """Vocabulary and merge ranks of a tokenizers file; encodes one word exactly."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab: dict[str, int] = model["vocab"]
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: t.encode() for t, i in self.specials.items()})
        self.of_byte = {byte_of[t]: i for t, i in vocab.items() if len(t) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # one number holds a pair's rank, high, and its merged id, low: the least number is the next merge
        self.rank = {(vocab[a], vocab[b]): r << ID_BITS | vocab[a + b] for r, (a, b) in enumerate(pairs)}

    def encode(self, word: bytes) -> list[int]:
        if len(word) > LONG_WORD:
            return self._encode_long(word)
        ids = [self.of_byte[b] for b in word]
        rank, none = self.rank.get, NO_MERGE
        best = [rank(p, none) for p in zip(ids, ids[1:])]
        while best:
            low = min(best)
            if low == none:
                break
            k = best.index(low)
            ids[k] = new = low & ID_MASK
            del ids[k + 1], best[k]
            if k:
                best[k - 1] = rank((ids[k - 1], new), none)
            if k < len(best):
                best[k] = rank((new, ids[k + 1]), none)
        return ids


    def _encode_long(self, word: bytes) -> list[int]:
        """The same merges over a linked list, the next one from a heap by rank, then from the left."""
        ids = [self.of_byte[b] for b in word]
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            # an entry is stale once one of its two tokens has changed
            if ids[k] < 0 or right >= n or rank((ids[k], ids[right])) != r:
                continue
            ids[k], ids[right] = r & ID_MASK, -1
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (r := rank((ids[k], ids[far]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (left := before[k]) >= 0 and (r := rank((ids[left], ids[k]))) is not None:
                heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]


def _arc_table(keys: np.ndarray) -> np.ndarray:
    """Place of each key in an open-addressing table of a power of two, at most half full; -1 where free."""
    bits = max(4, int(2 * len(keys)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot, todo = _slots(keys, bits), np.arange(len(keys))
    while len(todo):
        free = todo[table[slot[todo]] < 0]
        own, first = np.unique(slot[free], return_index=True)
        table[own] = free[first]
        todo = todo[table[slot[todo]] != todo]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return table


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as one flat byte string."""
    words = dict(entries)
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    # a path of open nodes, one for each byte of the last word: [final, frozen arcs]
    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], freeze(node)))
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[depth - 1], freeze(node)))
    root = freeze(path[0])

    accepts, keys, targets, skips = [], [], [], []
    for state, (final, arcs) in enumerate(frozen):  # children come before parents
        passed = int(final)
        for label, target in arcs:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(passed)
            passed += accepts[target]
        accepts.append(passed)
    table = _arc_table(np.array(keys, np.int64))
    used = table >= 0
    columns = []
    for values in (keys, targets, skips):
        column = np.full(len(table), -1, np.int32)
        column[used] = np.array(values, np.int32)[table[used]]
        columns.append(column)
    starts = np.cumsum([0, *(len(words[w]) for w in ordered)])
    flat = [i for w in ordered for i in words[w]]
    blocks = [np.array(x, np.int32) for x in ([root], [f for f, _ in frozen], *columns, starts, flat)]
    return struct.pack(f"<{len(blocks)}Q", *map(len, blocks)) + b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """Looks words up in a compiled lexicon that is mapped from a file."""

    def __init__(self, blob: bytes):
        # the file's name goes at once: the mapping keeps it until the worker ends, and nothing is left behind
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, parts = struct.unpack_from("<7Q", self.map), 56, []
        for n in sizes:
            parts.append(np.frombuffer(self.map, np.int32, n, at))
            at += 4 * n
        root, self.finals, self.keys, self.targets, self.skips, self.starts, self.flat = parts
        self.root, self.bits = int(root[0]), len(self.keys).bit_length() - 1

    def numbers(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that the lexicon lacks.  text: bytes; begins, ends: of the words in it."""
        number, state = np.zeros(len(begins), np.int32), np.full(len(begins), self.root, np.int32)
        out = np.full(len(begins), -1, np.int32)
        at, own = begins.copy(), np.arange(len(begins))
        mask = len(self.keys) - 1
        while len(own):
            over = at == ends[own]
            done = over & (self.finals[state] > 0)
            out[own[done]] = number[done]
            on = ~over
            own, at, state, number = own[on], at[on], state[on], number[on]
            key = state << 8 | text[at]
            slot = _slots(key, self.bits)
            found = self.keys[slot]
            # linear probing: on until the key or a free place
            while len(off := np.flatnonzero((found != key) & (found >= 0))):
                slot[off] = (slot[off] + 1) & mask
                found[off] = self.keys[slot[off]]
            on = found == key
            slot = slot[on]
            own, at, state, number = own[on], at[on] + 1, self.targets[slot], number[on] + self.skips[slot]
        return out

    def get(self, word: bytes) -> list[int] | None:
        (k,) = self.numbers(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))
        return self.flat[self.starts[k] : self.starts[k + 1]].tolist() if k >= 0 else None

    def outputs(self) -> list[str]:
        """Each word's ids in decimal, joined by commas, by number."""
        ids = list(map(str, self.flat.tolist()))
        return [",".join(ids[a:b]) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist())]


class _Merged(dict):
    """word -> its ids in decimal, joined by commas, for words that the lexicon lacks."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> str:
        out = ",".join(map(str, self.merges.encode(word.encode("utf-8", "replace"))))
        if len(word) <= MEMO_LETTERS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = out
        return out


class Codec:
    def __init__(self, tokenizer_text: str, blob: bytes):
        self.merges = Merges(tokenizer_text)
        self.lexicon = Lexicon(blob)
        self.outputs = self.lexicon.outputs()
        self.merged = _Merged(self.merges)
        self.find = regex.compile(PATTERN).findall
        self.bytes_of = {str(i): b for i, b in self.merges.token_bytes.items()}
        specials = sorted(self.merges.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text in decimal, joined by commas."""
        block: list[list] = []  # of each text: its words, and special tokens as ids by position
        size = 0
        for text in texts:
            words, special = [], {}
            if any(s in text for s in self.merges.specials):
                for part in self.special.split(text):
                    if part in self.merges.specials:
                        special[len(words)] = str(self.merges.specials[part])
                        words.append(part)
                    else:
                        words += self.find(part)
            else:
                words = self.find(text)
            block.append([words, special])
            size += len(words)
            if size >= BLOCK_WORDS:
                yield from self._joined(block)
                block, size = [], 0
        yield from self._joined(block)

    def _joined(self, block: list[list]) -> Iterator[str]:
        every = [w for words, _ in block for w in words]
        # the words cover their texts, so their letters stand one after another in the texts' bytes
        raw = np.frombuffer("".join(every).encode("utf-8", "replace"), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
        letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = letters[ends] if len(every) else ends
        numbers = self.lexicon.numbers(raw, np.concatenate([[0], ends[:-1]]) if len(every) else ends, ends).tolist()
        outputs, merged = self.outputs, self.merged
        ids = [outputs[k] if k >= 0 else merged[w] for k, w in zip(numbers, every)]
        at = 0
        for words, special in block:
            own = ids[at : at + len(words)]
            at += len(words)
            for k, i in special.items():
                own[k] = i
            yield ",".join(own)

    def decode(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker process and model; reused workers keep the last."""
    tokenizer_text, blob = shared.value
    key = hashlib.sha256(tokenizer_text.encode() + blob).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokenizer_text, blob)
    return _codecs[key]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each run of letters between blanks occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=schema)

        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(text.as_py().split(" "))
                if len(seen) > COUNT_SIZE:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = LEXICON_SIZE) -> list[str]:
    """The commonest words of letters alone, at most size of them.

    The driver sees a histogram of the counts, then the words above the count that it shows.
    """
    counts = word_counts(docs, text_col).where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") <= 40))
    counts = spool(counts)
    step = F.floor(F.log2("n") * COUNT_STEPS).cast("int")
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect():
        if held + r["m"] > size:
            break
        least, held = r["step"], held + r["m"]
    words = [] if least is None else [r["word"] for r in counts.where(step >= least).select("word").collect()]
    release(counts)
    return sorted(words)


def bpe(
    docs: DataFrame,
    tokenizer_path: str,
    outputs: Iterable[str] = ("ids", "decoded"),
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_size: int = LEXICON_SIZE,
) -> DataFrame:
    """doc_id and the wanted outputs: the ids, the text decoded from them, their number and digests."""
    outputs = list(outputs)
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_text = f.read()
    merges = Merges(tokenizer_text)
    words = frequent_words(docs, text_col, lexicon_size)
    entries = {form.encode() for w in words for form in (w, " " + w)}
    blob = compile_lexicon((w, merges.encode(w)) for w in entries)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_text, blob))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in outputs}
            for joined in codec.encode([t or "" for t in batch.column(1).to_pylist()]):
                decoded = codec.decode(joined)
                if "ids" in columns:
                    columns["ids"].append([int(i) for i in joined.split(",")] if joined else [])
                if "decoded" in columns:
                    columns["decoded"].append(decoded)
                if "n_tokens" in columns:
                    columns["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                if "decoded_sha256" in columns:
                    columns["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            arrays = [batch.column(0), *(pa.array(v, kinds.get(c, pa.string())) for c, v in columns.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *outputs])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
