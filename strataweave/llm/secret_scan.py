"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates in every whole text.  The hashes of the candidate values
are aggregated over the corpus by distinct repositories and owners.  Ownership
decides what a candidate is:

    example   EXAMPLE_OWNERS owners or more hold the value, or it lies in EXAMPLE_REPOS
              repositories or more for each owner: copied widely, across or within owners
    live      held by few, and random by its letters
    weak      the rest

What is live for its owner is a secret wherever it stands: other occurrences of a live
value, without a name or a known form round them, are spans of kind `reuse`.  They are
found by joining the random-looking tokens of all texts with the live values.  Counts are
made in two steps (distinct pairs, then sums), so a value held by a third of all rows is
never gathered.

Defined results
* null text: as the empty text, nothing found.
* null owner or repository: counted as one owner or repository of its own.
* repeated rows are scanned one by one; their repository counts once.
* a reuse inside another finding of the text is not reported again.
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spool

#: Kinds in the order of the spans; the first three are the base kinds.
KINDS = ["assign", "access", "hex", "github", "slack", "google", "jwt", "pem", "reuse"]
BASE_KINDS = 3
PATTERNS = {
    "assign": re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-])+)", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
}
LEAST = {"assign": 8, "access": 16}
ANCHORS = {"access": "AKIA", "slack": "xox", "google": "AIza", "jwt": "eyJ", "pem": "PRIVATE KEY-----", "github": "gh"}
ASSIGN_ANCHORS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value of this many owners, or of this many repositories for each of its owners, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
#: Tokens that may be a bare occurrence of a live value: these letters, at least so many, a digit among them.
TOKEN, LEAST_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}"), 8
_DIGIT = re.compile(r"[0-9]")
#: Bits of entropy a character from which a value looks random.
LIVE_BITS = 2.5
FINDING = "struct<kind:string,start:int,end:int,value_hash:string,bits:double>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def find_secrets(text: str) -> list[dict]:
    """Candidates by start, then by kind as listed; positions in code points, end exclusive.

    The last kind are tokens that count only if their value is live elsewhere.
    """
    out = []
    low = text.lower()
    for order, kind in enumerate(KINDS):
        if kind == "reuse":
            break
        if kind == "assign":
            if not any(a in low for a in ASSIGN_ANCHORS):
                continue
        elif kind in ANCHORS and ANCHORS[kind] not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            value = m.group(2) if kind == "assign" else m.group()
            if len(value) >= LEAST.get(kind, 0):
                out.append((m.start(), order, m.end(), value))
    out.sort()
    if _DIGIT.search(text):
        reach = 0
        ends = []  # the furthest end of the findings up to each
        for _, _, end, _ in out:
            reach = max(reach, end)
            ends.append(reach)
        starts = [x[0] for x in out]
        bare = []
        for m in TOKEN.finditer(text):
            value = m.group().strip("=.-")
            start = m.start() + m.group().index(value) if value else 0
            if len(value) < LEAST_TOKEN or not _DIGIT.search(value) or entropy(value) < LIVE_BITS:
                continue
            before = bisect.bisect_left(starts, start + len(value))
            if before and ends[before - 1] > start:
                continue
            bare.append((start, len(KINDS) - 1, start + len(value), value))
        out = sorted(out + bare)
    return [
        {"kind": KINDS[order], "start": start, "end": end, "value_hash": _hash(value), "bits": entropy(value)}
        for start, order, end, value in out
    ]


def _candidates(rows: DataFrame, id_type: str) -> DataFrame:
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string()), ("bits", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py() or "") for t in batch.column(4)]
            arrays = [batch.column(k) for k in range(4)] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "repo", "owner", "findings"])

    return rows.mapInArrow(run, f"rid long, doc_id {id_type}, repo string, owner string, findings array<{FINDING}>")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source"
) -> DataFrame:
    """doc_id and findings (kind, start, end, value_hash, bits, repos, owners, verdict), one row per input row.

    repo_col, owner_col: where a document comes from and whose it is; the defaults take each
    document as a repository of its own and its source as the owner.
    """
    ship(docs.sparkSession)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        name(repo_col).alias("repo"),
        name(owner_col).alias("owner"),
        F.col(text_col).alias("text"),
    )
    scan = spool(_candidates(rows, docs.schema[id_col].dataType.simpleString()))
    each = scan.where(F.size("findings") > 0).select("rid", "repo", "owner", F.explode("findings").alias("f"))
    each = each.select("rid", "repo", "owner", "f", F.col("f.value_hash").alias("h"))
    found = spool(each.where(F.col("f.kind") != "reuse"))
    repos = found.select("h", "repo").distinct().groupBy("h").agg(F.count("*").alias("repos"))
    owners = found.select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("owners"))
    bits = found.groupBy("h").agg(F.max("f.bits").alias("bits"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS * F.col("owners"))
    verdict = F.when(example, "example").when(F.col("bits") >= LIVE_BITS, "live").otherwise("weak")
    # a table of its own: joins with it stand on their exchanges, where AQE can split a common value
    freq = spool(repos.join(owners, "h").join(bits, "h").select("h", "repos", "owners", verdict.alias("verdict")))
    bare = each.where(F.col("f.kind") == "reuse").select("rid", "f", "h")
    judged = found.select("rid", "f", "h").join(freq.hint("merge"), "h")
    judged = judged.unionByName(bare.join(freq.where("verdict = 'live'"), "h"))
    judged = judged.select(
        "rid", F.struct("f.start", "f.kind", "f.end", "f.value_hash", "f.bits", "repos", "owners", "verdict").alias("f")
    )
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    judged = judged.select("rid", F.struct(F.col("f.start").alias("at"), rank[F.col("f.kind")].alias("rank"), "f").alias("g"))
    judged = judged.groupBy("rid").agg(F.sort_array(F.collect_list("g")).alias("g"))
    out = scan.select("rid", "doc_id").join(judged.hint("merge"), "rid", "left")
    return out.select("doc_id", F.coalesce(F.transform("g", lambda g: g["f"]), F.array()).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the findings."""
    count = lambda field, value: F.size(F.filter("findings", lambda f: f[field] == value)).cast("long")
    joined = lambda a: F.array_join(
        F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )
    base = F.filter("findings", lambda f: f["kind"].isin(*KINDS[:BASE_KINDS]))
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in KINDS[:BASE_KINDS]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "example", "weak")],
    )
