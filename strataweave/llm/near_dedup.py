"""Near-duplicate detection with DartMinHash signatures of weighted word shingles.

A document is a multiset of five-word shingles; a shingle's weight is its count.
Every unit of weight is a cell with its own hashed sequence of darts, whose ranks
are the arrivals of a Poisson process.  All darts of rank under a bound go to
hashed coordinates and the earliest of each coordinate stays; the bound is
chosen from the total weight so that about K * (ln K + 3) darts are thrown, and
doubled for the few documents that leave a coordinate empty.  Two documents agree
on a coordinate with a probability equal to their weighted Jaccard similarity.

Bands of coordinates make buckets; buckets of the same members count once.  One rule
holds for buckets of every size.  Each bucket's members are compared with one leader:
by signature first, then exactly on their shingles.  The links are joined into classes.
Buckets that hold several classes get further rounds of leaders, while each round at
least halves the pairs of different classes; then all pairs of different classes that
are left are compared, by blocks.  So every two texts that share a bucket are compared
or in one class, and a text is never paired with a class that it is in already.

Equal texts are one node throughout, so copies are never expanded into pairs.  A
leader's shingles go once to each task that compares with it, not into every pair.

Defined results
* null text: as the empty text; texts without words are near only to equal ones.
* texts of one to four words have one shingle, all their words.
* null doc_id: ranks below all others as the class id's choice; its row stays.
* repeated rows are copies of each other; an empty table gives an empty result.
* extra columns are ignored.  Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spool
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 128
BANDS, BAND_ROWS = 25, 5
#: Most leaders of a round, and texts of a block in the comparison of all pairs.
MOST_LEADERS, BLOCK = 16, 256
#: Pairs that one group of a verification task compares, and members of one leader in it.
PACK, FAN = 512, 256
#: Estimates this far under the limit are not verified: over five standard errors.
SLACK = 0.19
#: Bits of the broadcast map of texts whose shingles are wanted: 8 MB at any input size.
WANTED_BITS = 26
CHUNK_WORDS, CHUNK_DOCS = 300_000, 4000
MEMO_SIZE = 1 << 19
_LOW = np.uint64((1 << 52) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < MEMO_SIZE:
            self[word] = out
        return out


def shingle_cells(texts: list[str], memo: _WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, element, copy) of every unit of weight, ordered by doc and element; at most CHUNK_DOCS texts."""
    if len(memo) >= MEMO_SIZE:
        memo.clear()
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(memo.__getitem__, w)), np.uint64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.repeat(np.arange(len(texts)), lengths)
    # a rolling polynomial over five words, only where the window stays in its document
    n = len(flat) - WORDS + 1
    shingles, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        inside = doc[:n] == doc[WORDS - 1 :]
        h = flat[:n].copy()
        for k in range(1, WORDS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n]
        shingles, owner = mix(h[inside]), doc[:n][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < WORDS))
    if len(short):
        own = np.array([xxhash.xxh64_intdigest(" ".join(words[i]).encode("utf-8", "surrogatepass")) for i in short], np.uint64)
        shingles, owner = np.concatenate([shingles, mix(own)]), np.concatenate([owner, short])
    packed = (owner.astype(np.uint64) << np.uint64(52)) | (shingles >> np.uint64(12))
    packed.sort()
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    at = np.arange(len(packed))
    copy = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(packed) else at
    del starts
    return (packed >> np.uint64(52)).astype(np.int64), packed & _LOW, copy


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(doc: np.ndarray, element: np.ndarray, copy: np.ndarray, n_docs: int, weight: np.ndarray | None = None) -> np.ndarray:
    """n_docs x COORDINATES dart ids (0 where a document has no cells).

    weight: of the last, partial cell of an element, 1 for whole ones (None: all whole).
    """
    k = COORDINATES
    out = np.zeros((n_docs, k), np.uint64)
    cell = mix(element * np.uint64(0xC2B2AE3D27D4EB4F) + copy.astype(np.uint64) + np.uint64(1))
    share = np.ones(len(cell)) if weight is None else weight
    total = np.bincount(doc, share, n_docs)
    bound = np.where(total > 0, k * (np.log(k) + 3) / np.maximum(total, 1e-9), 0.0)
    todo = np.arange(len(cell))
    while len(todo):
        ids, ranks, places = [], [], []
        own, c, limit = doc[todo], cell[todo], bound[doc[todo]]
        rank, throw, part = np.zeros(len(todo)), 0, share[todo]
        while len(c):
            seed = c + np.uint64(0x632BE59BD9B4E019 * (2 * throw + 1) & (2**64 - 1))
            rank = rank - np.log(_uniform(seed))
            near = rank < limit
            own, c, limit, rank, part, seed = own[near], c[near], limit[near], rank[near], part[near], seed[near]
            dart = mix(seed + np.uint64(0x9FB21C651E98DF25))
            hit = slice(None) if weight is None else _uniform(dart) < part  # a dart beyond the region's edge is lost
            ids.append(dart[hit])
            ranks.append(rank[hit])
            places.append(own[hit] * k + (mix(dart ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64)[hit])
            throw += 1
        ids, ranks, places = np.concatenate(ids), np.concatenate(ranks), np.concatenate(places)
        order = np.argsort(-ranks, kind="stable")
        out.ravel()[places[order]] = ids[order] | np.uint64(1)  # the earliest is written last
        empty = (total > 0) & (out == 0).any(1)
        bound = bound * 2
        todo = todo[empty[doc[todo]]]
    return out


def _fold(columns: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(columns), salt, np.uint64)
    for c in columns.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h.astype(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and (size + len(t) // 5 > CHUNK_WORDS or k - begin >= CHUNK_DOCS):
            yield begin, k
            begin, size = k, 0
        size += len(t) // 5
    if begin < len(texts):
        yield begin, len(texts)


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tkey, sig (8 bits of each coordinate), bands (bucket keys; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHash()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _chunks(texts):
                doc, element, copy = shingle_cells(texts[a:b], memo)
                sig = dart_signatures(doc, element, copy, b - a)
                full = sig[:, 0] != 0
                bands = np.stack([_fold(sig[:, BAND_ROWS * k : BAND_ROWS * (k + 1)], k) for k in range(BANDS)], 1)
                short = (sig >> np.uint64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([s.tobytes() if f else b"" for s, f in zip(short, full)], pa.binary()),
                        pa.array([s if f else [] for s, f in zip(bands, full)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tkey", "sig", "bands"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    schema = f"doc_id {id_type}, tkey binary, sig binary, bands array<long>"
    return rows.mapInArrow(run, schema)


def wanted_map(marks: DataFrame) -> bytes:
    """A bit map of 64-bit marks, of fixed size: what it lacks is not wanted, what it has may be."""
    slot = F.col("mark").bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(mark & 63 AS int))")
    # at most 2 ** (WANTED_BITS - 6) rows
    found = marks.select(F.shiftright(slot, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (WANTED_BITS - 6), np.int64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def _shingles(rows: DataFrame, wanted: bytes) -> DataFrame:
    """rows (tkey, mark, text) -> (tkey, cells): the sorted 64-bit cells of the texts that the map has."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = _WordHash(), np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            mark = batch.column(1).to_numpy().view(np.uint64)
            slot = (mark & np.uint64((1 << WANTED_BITS) - 1)) >> np.uint64(6)
            hit = (bits[slot.astype(np.int64)] >> (mark & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _chunks(texts):
                doc, element, copy = shingle_cells(texts[a:b], memo)
                cell = mix(element * np.uint64(0xC2B2AE3D27D4EB4F) + copy.astype(np.uint64) + np.uint64(1))
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                cells = [np.sort(cell[ends[k] : ends[k + 1]]).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cells, pa.binary())], names=["tkey", "cells"])

    return rows.mapInArrow(run, "tkey binary, cells binary")


def _overlap(p: np.ndarray, q: np.ndarray, limit: float) -> bool:
    """Whether the weighted Jaccard similarity of two texts' cells reaches the limit."""
    if min(len(p), len(q)) < limit * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= limit * (len(both) - common)


def _likely(pairs: DataFrame, texts: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree on a share of coordinates near the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
            mask = pa.array((x == y).mean(1) >= limit - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    va = texts.select(F.col("tid").alias("a"), F.col("sig").alias("va"))
    vb = texts.select(F.col("tid").alias("b"), F.col("sig").alias("vb"))
    return pairs.join(vb, "b").join(va, "a").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, cells: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the limit.  pairs: a spooled table.

    Tasks compare packs of pairs.  A leader of many members is dealt to several packs by salt,
    and its cells go once to each of them.
    """

    def run(members: pa.Table, leaders: pa.Table) -> pa.Table:
        own = {a: np.frombuffer(c, np.uint64) for a, c in zip(leaders["lead"].to_pylist(), leaders["lead_cells"].to_pylist())}
        keep = [_overlap(own[a], np.frombuffer(c.as_py(), np.uint64), limit) for a, c in zip(members["a"].to_pylist(), members["cells"])]
        return members.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    packs = max(1, pairs.count() // PACK)
    degree = spool(pairs.groupBy("a").agg(F.count("*").alias("n")))
    side = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / FAN)).alias("side")
    dealt = pairs.join(degree.hint("merge"), "a").select("a", "b", side)
    dealt = spool(dealt.select("a", "b", F.pmod(F.xxhash64("a", "side"), F.lit(packs)).alias("pack")))
    release(degree)
    members = dealt.join(cells.select(F.col("tid").alias("b"), "cells"), "b").select("pack", "a", "b", "cells")
    leaders = dealt.select(F.col("pack").alias("lead_pack"), F.col("a").alias("lead")).distinct()
    leaders = leaders.join(cells.select(F.col("tid").alias("lead"), F.col("cells").alias("lead_cells")), "lead")
    out = spool(members.groupBy("pack").cogroup(leaders.groupBy("lead_pack")).applyInArrow(run, "a long, b long"))
    release(dealt)
    return out


def _all_pairs(rows: DataFrame, limit: float, n_rows: int) -> DataFrame:
    """rows (bucket, tid, root, n, sig, cells) -> (a, b): links that join all classes of a bucket which have
    a pair at the limit.  Every pair of a bucket is met in one group, that of its two blocks; buckets of
    one block share a group with others."""

    def meet(keys: list, own: np.ndarray, within: bool, root: np.ndarray, sig: np.ndarray, cells: list, a: list, b: list) -> None:
        for i in range(len(keys)):
            others = root[i + 1 :] != root[i]
            if not within:
                others &= own[i + 1 :] != own[i]
            others = np.flatnonzero(others) + i + 1
            for j in others[(sig[others] == sig[i]).mean(1) >= limit - SLACK].tolist():
                if root[j] != root[i] and _overlap(cells[i], cells[j], limit):
                    a.append(keys[i])
                    b.append(keys[j])
                    root[root == root[j]] = root[i]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("tid", "ascending")])
        bucket = table["bucket"].to_numpy()
        ends = [*np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        within = table["lo"][0].as_py() == table["hi"][0].as_py()
        keys, own, root = table["tid"].to_pylist(), table["own"].to_numpy(), table["root"].to_numpy().copy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        cells = [np.frombuffer(c, np.uint64) for c in table["cells"].to_pylist()]
        a, b, begin = [], [], 0
        for end in map(int, ends):
            at = slice(begin, end)
            meet(keys[at], own[at], within, root[at], sig[at], cells[at], a, b)
            begin = end
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pack = F.when(blocks > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(max(1, n_rows // PACK))))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("tid"), blocks).cast("int")).withColumn("pack", pack)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    rows = rows.select("pack", (blocks > 1).alias("many"), "bucket", lo, hi, "own", "tid", "root", "sig", "cells")
    return rows.groupBy("pack", "many", "lo", "hi").applyInArrow(run, "a long, b long")


def _leaders(members: DataFrame, round_: int) -> DataFrame:
    """(a, b): leaders of each bucket with every member of another class.  members: bucket, tid, root, n.

    Twice as many leaders each round.  Those in many crowded places come first, as an original does
    that its copies resemble more than each other; ties go by an order of the bucket's own.
    """
    slot = F.pmod(F.xxhash64(F.lit(round_), "bucket", "tid"), F.lit(min(1 << round_, MOST_LEADERS))).alias("slot")
    weight = members.groupBy("tid").agg(F.sum("n").alias("w"))
    order = F.struct((-F.col("w")).alias("w"), F.xxhash64("bucket", "tid").alias("o"), "tid", "root")
    lead = members.join(weight.hint("merge"), "tid").groupBy("bucket", slot).agg(F.min(order).alias("lead"))
    # a table of its own: the join then stands on its exchanges, where AQE can split a crowded bucket
    lead = spool(lead.select("bucket", F.col("lead.tid").alias("a"), F.col("lead.root").alias("ra")))
    return members.join(lead.hint("merge"), "bucket").where("root <> ra").select("a", F.col("tid").alias("b"))


def shared_buckets(once: DataFrame) -> DataFrame:
    """(tid, bucket, lead): the members of every bucket of two texts or more; of buckets with equal members one."""
    members = once.select("tid", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("tid").alias("lead"), F.expr("bit_xor(xxhash64(tid))").alias("x"), F.expr("bit_xor(xxhash64(7, tid))").alias("y")
    )
    shared = shared.where("n > 1").groupBy("n", "lead", "x", "y").agg(F.min("bucket").alias("bucket"))
    shared = spool(shared.select("bucket", "lead"))
    out = spool(members.join(shared.hint("merge"), "bucket").select("tid", "bucket", "lead"))
    release(shared)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), n_copies (rows of equal text), one row per input row."""
    ship(docs.sparkSession)
    once = signatures(docs, id_col, text_col).groupBy("tkey")
    once = once.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    once = spool(once.withColumn("tid", F.monotonically_increasing_id()))
    places = shared_buckets(once)
    members = places.select("tid").distinct()
    texts = spool(once.select("tid", "tkey", "first_id", "sig").join(members.hint("merge"), "tid", "left_semi"))

    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = spool(places.where("tid <> lead").select(F.col("lead").alias("a"), F.col("tid").alias("b")).select(*pair).distinct())
    near = spool(_likely(met, texts, similarity))
    # the shingles of every text that shares a bucket, each made from one row that holds the text
    mark = lambda i: F.xxhash64("tkey", i).alias("mark")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tkey"))
    cells = _shingles(source.select("tkey", mark("doc_id"), "text"), wanted_map(texts.select(mark("first_id"))))
    cells = spool(cells.dropDuplicates(["tkey"]).join(texts.select("tkey", "tid").hint("merge"), "tkey").select("tid", "cells"))

    links = _verified(near, cells, similarity)
    release(near)
    open_rows, before, round_ = places.select("tid", "bucket"), None, 0
    while True:
        # every bucket that holds several classes by now
        roots = connected_components(links)
        labelled = open_rows.select("tid", "bucket").join(roots.withColumnRenamed("node", "tid").hint("merge"), "tid", "left")
        labelled = spool(labelled.select("tid", "bucket", F.coalesce("root", "tid").alias("root")))
        mixed = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        mixed = mixed.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        mixed = spool(mixed.where("n * n > same").selectExpr("bucket", "n", "(n * n - same) / 2 AS crossed"))
        release(places, open_rows)
        open_rows = spool(labelled.join(mixed.hint("merge"), "bucket").select("tid", "bucket", "root", "n", "crossed"))
        release(labelled, mixed)
        r = open_rows.agg(F.sum(F.col("crossed") / F.col("n")), F.count("*")).first()
        crossed, n_open = r[0] or 0.0, r[1]
        if not crossed or before is not None and crossed > before / 2:
            break
        before = crossed
        more = _leaders(open_rows.select("bucket", "tid", "root", "n"), round_).select(*pair).distinct()
        more = spool(more.join(met.hint("merge"), ["a", "b"], "left_anti"))
        near = spool(_likely(more, texts, similarity))
        extra = _verified(near, cells, similarity)
        met, links = met.union(more), spool(links.union(extra).distinct())
        release(near, extra)
        round_ += 1
    if crossed:
        # what leaders no longer halve is compared in full, pair by pair
        full = open_rows.join(texts.select("tid", "sig"), "tid").join(cells, "tid")
        extra = spool(_all_pairs(full, similarity, n_open).select(*pair).distinct())
        links = spool(links.union(extra).distinct())
        roots = connected_components(links)
    release(cells, open_rows)

    # only texts with links need their class's minimum
    linked = spool(roots.join(texts.select(F.col("tid").alias("node"), "first_id"), "node"))
    named_roots = spool(linked.groupBy("root").agg(F.min("first_id").alias("class_id")))
    named = linked.join(named_roots.hint("merge"), "root").select(F.col("node").alias("tid"), "class_id", F.lit(True).alias("linked"))
    classes = once.select("tid", "tkey", "first_id", "n_copies").join(named.hint("merge"), "tid", "left")
    class_id = F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("first_id")).alias("class_id")
    classes = spool(classes.select("tkey", class_id, "n_copies"))
    release(once, texts, linked, named_roots)
    out = source.select("doc_id", "tkey").join(classes.hint("merge"), "tkey")
    return out.select("doc_id", "class_id", "n_copies")
