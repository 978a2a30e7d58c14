"""Sharding by minimax contiguous partition of atomic groups.

Equal texts form one group, which stays whole.  Groups are ordered by a 128-bit
hash of their text, so a shard is an interval of hashes and 39 cut keys place any
row.  The law is `bytes`: the largest shard is as small as contiguous cuts allow.
A binary search over the capacity checks greedily whether the groups fit.  The
driver never needs all groups for it: groups are summed by hash prefix, and only
the prefixes in which some greedy cut can fall are split further, until every cut
falls between two single groups.  Among the cuts of the smallest capacity those
nearest to equal shares are taken.

Defined results
* null text: 16 bytes, CRC 0; all such rows form one group, apart from empty texts.
* rows with one doc_id, or wholly equal rows, each get their own slot.
* one group may be larger than an equal share; the capacity is then its size.
* an empty table gives an empty result; shards may be empty when groups are few.
* extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

SHARDS = 40
ROW_OVERHEAD = 16
KEY_DIGITS = 32
#: Hexadecimal digits of the first summary: 65,536 prefixes at most.
FIRST_DIGITS = 4
STEP_DIGITS = 1


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.substring(F.sha2(text, 256), 1, KEY_DIGITS), F.lit("")).alias("key"),
    )


class Atoms:
    """Ordered atoms: single groups, or hash prefixes of several groups that may still be split."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        rows.sort()
        self.prefix = [r[0] for r in rows]
        self.first_key = [r[1] for r in rows]
        self.single = np.array([r[3] == 1 for r in rows], bool)
        self.ends = np.cumsum([r[2] for r in rows], dtype=np.int64)
        self.sizes = np.array([r[2] for r in rows], np.int64)

    def cuts(self, capacity: int, shards: int, how: str) -> list[int]:
        """Greedy ends of the shards, as numbers of atoms; how: 'whole' keeps atoms whole,
        'low' is at most and 'high' at least where a cut between groups can come."""
        at, out, n = 0, [], len(self.ends)
        for _ in range(shards):
            limit = (int(self.ends[at - 1]) if at else 0) + capacity
            k = int(np.searchsorted(self.ends, limit, "right"))
            if how == "high" and k < n and not self.single[k]:
                k += 1
            elif k == at and k < n and not self.single[k] and how == "low":
                pass
            at = min(n, k)
            out.append(at)
        return out

    def smallest(self, shards: int, how: str) -> int:
        total = int(self.ends[-1])
        low, high = -(-total // shards), total
        if how == "whole":
            low = max(low, int(self.sizes.max()))
        elif self.single.any():
            low = max(low, int(self.sizes[self.single].max()))
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, how)[-1] >= len(self.ends):
                high = middle
            else:
                low = middle + 1
        return low


def _summary(groups: DataFrame, digits: int, within: list[str] | None, was: int) -> list[tuple[str, str, int, int]]:
    if within is not None:
        # prefixes that cuts can fall into: at most a few per shard and level
        wanted = groups.sparkSession.createDataFrame([(p,) for p in within], "p string")
        groups = groups.join(F.broadcast(wanted), F.substring("key", 1, was) == F.col("p"), "left_semi")
    rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.min("key"), F.sum("bytes"), F.count("*")).collect()
    return [(r[0], r[1], int(r[2]), int(r[3])) for r in rows]


def _unsure(atoms: Atoms, shards: int) -> set[int]:
    """Atoms of several groups in which a cut may have to fall."""
    n, total = len(atoms.ends), int(atoms.ends[-1])
    high = atoms.smallest(shards, "whole")
    low = atoms.smallest(shards, "high")
    first, last = _earliest(atoms, high, shards, "low"), atoms.cuts(high, shards, "high")
    out = set()
    for k, (a, b) in enumerate(zip(first, last)):
        ideal = int(np.searchsorted(atoms.ends, total * (k + 1) // shards))
        near = {ideal, a - 1, b - 1, b} | (set(range(max(0, a - 1), min(n, b + 1))) if low < high else set())
        out |= {i for i in near if 0 <= i < n and not atoms.single[i]}
    return out


def minimax_cut_keys(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """First keys of shards 1 and up.  groups: (key, bytes), one row per group."""
    rows = _summary(groups, FIRST_DIGITS, None, 0)
    if not rows:
        return []
    while True:
        atoms = Atoms(rows)
        n, total = len(rows), int(atoms.ends[-1])
        # a prefix above an equal share holds a large group: until that stands alone, it blurs every cut after it
        unsure = {i for i in range(n) if not atoms.single[i] and atoms.sizes[i] > total / shards}
        if not unsure:
            unsure = _unsure(atoms, shards)
        split: dict[int, list[str]] = {}
        for i in unsure:
            if len(atoms.prefix[i]) < KEY_DIGITS:
                split.setdefault(len(atoms.prefix[i]), []).append(atoms.prefix[i])
        if not split:
            break
        gone = {p for own in split.values() for p in own}
        rows = [r for r in rows if r[0] not in gone]
        for digits, own in split.items():
            rows += _summary(groups, digits + STEP_DIGITS, sorted(own), digits)
    capacity = atoms.smallest(shards, "whole")
    latest, earliest = atoms.cuts(capacity, shards, "whole"), _earliest(atoms, capacity, shards, "whole")
    keys, at = [], 0
    for k in range(shards - 1):
        start = int(atoms.ends[at - 1]) if at else 0
        reach = int(np.searchsorted(atoms.ends, start + capacity, "right"))
        ideal = total * (k + 1) // shards
        near = int(np.searchsorted(atoms.ends, ideal))
        near += int(near + 1 <= n and abs(int(atoms.ends[min(near, n - 1)]) - ideal) < ideal - (int(atoms.ends[near - 1]) if near else 0))
        at = max(at, min(max(near, earliest[k]), latest[k], reach))
        keys.append(atoms.first_key[at] if at < n else "~")
    return keys


def _earliest(atoms: Atoms, capacity: int, shards: int, how: str) -> list[int]:
    """The earliest ends of the shards from which the rest still fits."""
    out, end = [0] * shards, len(atoms.ends)
    for k in range(shards - 1, -1, -1):
        out[k] = end
        floor = (int(atoms.ends[end - 1]) if end else 0) - capacity
        begin = int(np.searchsorted(atoms.ends, floor, "left")) + 1 if floor > 0 else 0
        if how == "low" and begin and not atoms.single[begin - 1]:
            begin -= 1
        end = max(0, min(begin, end))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per input row."""
    rows = spool(sized_rows(docs, id_col, text_col))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    cuts = minimax_cut_keys(spool(groups), shards)
    # ordered by key and doc_id, so that even one hot group is dealt over many tasks
    placed = rows.repartitionByRange("key", "doc_id", "size").sortWithinPartitions("key", "doc_id")
    shard = F.size(F.filter(F.lit(cuts).cast("array<string>"), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    placed = spool(
        placed.select(
            "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at")
        )
    )
    part = F.shiftright("at", 33)
    # one row per task and shard that meet: tasks + shards - 1 rows at most
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("begin")).collect()
    bases, filled = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        bases.append((r["part"], r["shard"], filled.get(r["shard"], 0) - r["begin"]))
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["n"]
    spark = docs.sparkSession
    base = spark.createDataFrame(bases, "part long, base_shard int, base long")
    out = placed.join(F.broadcast(base), (part == F.col("part")) & (F.col("shard") == F.col("base_shard")))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("base")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
