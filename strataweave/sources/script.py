"""Import of a Cypher script of CREATE statements, such as database dumps write.

Statements end with a semicolon and a line break, so Spark splits a script at them and
each is read by itself.  Known forms:
  CREATE (:Label {...});
  MATCH (a:Label {key: 1}), (b:Label {key: 2}) CREATE (a)-[:TYPE {...}]->(b);
  UNWIND [{...}, ...] AS row CREATE (n:Label {key: row.id}) SET n += row.properties;
  UNWIND [{...}, ...] AS row MATCH (a {...}) MATCH (b {...}) CREATE (a)-[r:TYPE]->(b) SET r += row.properties;
Transaction marks and the statements that set up or clear the dump's own import keys are
passed over; all others, and values without a JSON form, are rejected with their reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .edn import EdnError, micros_of, unescape

#: The key and the label that a dump gives to its nodes for the time of the import.
IMPORT_KEY = "UNIQUE IMPORT ID"
IMPORT_LABEL = "UNIQUE IMPORT LABEL"
INSTANTS, CLOCKS = ("date", "datetime", "localdatetime"), ("time", "localtime")
MAX_DEPTH = 100

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<quoted>`(?:[^`]|``)*`)|(?P<number>-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<word>[^\W\d]\w*)|(?P<mark>\+=|->|<-|[-(){}\[\]:,.=;]))""",
    re.S,
)


class ScriptError(ValueError):
    pass


class _Unsupported(Exception):
    """A value that the statement can do without."""


class _Row(tuple):
    """A path into the row of an UNWIND."""


class _Statement:
    """One statement, read from left to right."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ScriptError(f"unreadable: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.lost: list[str] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        found = self.peek()
        if found[0] == "end":
            raise ScriptError("the statement ends too soon")
        self.at += 1
        return found

    def take(self, *marks: str) -> bool:
        here = [t.upper() if k == "word" else t for k, t in self.tokens[self.at : self.at + len(marks)]]
        if here != list(marks):
            return False
        self.at += len(marks)
        return True

    def expect(self, mark: str) -> None:
        if not self.take(mark):
            raise ScriptError(f"{mark!r} expected at {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.next()
        if kind == "quoted":
            return text[1:-1].replace("``", "`")
        if kind != "word":
            raise ScriptError(f"a name expected at {text!r}")
        return text

    def value(self, depth: int = 0) -> Any:
        if depth > MAX_DEPTH:
            raise ScriptError("values too deep")
        kind, text = self.peek()
        if kind == "string":
            self.at += 1
            return unescape(text[1:-1])
        if kind == "number":
            self.at += 1
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value(depth + 1))
                if not self.take(",") and self.peek()[1] != "]":
                    raise ScriptError("a list without end")
            return out
        if text == "{":
            return self.map(depth + 1)
        word = self.name()
        if kind == "word" and word.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word.lower()]
        if self.take("("):
            return self.call(word.lower(), depth)
        path = [word]
        while self.take("."):
            path.append(self.name())
        return _Row(path)

    def call(self, function: str, depth: int) -> Any:
        given = []
        while not self.take(")"):
            given.append(self.value(depth + 1))
            self.take(",")
        if len(given) == 1 and isinstance(given[0], str):
            if function in INSTANTS:
                try:
                    return micros_of(re.sub(r"\[.*\]$", "", given[0]))
                except EdnError as e:
                    raise _Unsupported(str(e)) from e
            if function in CLOCKS:
                return given[0]
        raise _Unsupported(f"a value of {function}()")

    def map(self, depth: int = 0) -> dict[str, Any]:
        self.expect("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.expect(":")
            try:
                out[key] = self.value(depth)
            except _Unsupported as e:
                self.lost.append(f"{key}: {e}")
            if not self.take(",") and self.peek()[1] != "}":
                raise ScriptError("a map without end")
        return out

    def node(self) -> tuple[str, list[str], dict]:
        self.expect("(")
        var = self.name() if self.peek()[0] in ("word", "quoted") else ""
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.map() if self.peek()[1] == "{" else {}
        self.expect(")")
        return var, labels, props

    def sets(self) -> tuple[list[_Row], list[str]]:
        """What SET adds: maps of properties, and labels."""
        maps, labels = [], []
        while self.take("SET") or self.take(","):
            self.name()
            if self.take("+=") or self.take("="):
                maps.append(self.value())
            while self.take(":"):
                labels.append(self.name())
        return maps, labels

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise ScriptError(f"unexpected {self.peek()[1]!r}")

    def rows(self) -> Iterator[tuple]:
        """(kind, labels, key, value, properties, ends) of the statement's nodes or edge."""
        rows: list[tuple[str, dict]] = [("", {})]
        if self.take("UNWIND"):
            given = self.value()
            self.expect("AS")
            var = self.name()
            rows = [(var, r) for r in given]
        matched: dict[str, tuple[list[str], dict]] = {}
        while self.take("MATCH") or (matched and self.take(",")):
            name, labels, props = self.node()
            matched[name] = (labels, props)
        self.expect("CREATE")
        name, labels, props = self.node()
        if not matched:
            maps, more = self.sets()
            self.done()
            for var, row in rows:
                yield "node", labels + more, _filled(props, maps, var, row), None, None
            return
        left = self.take("<-")
        if not left:
            self.expect("-")
        self.expect("[")
        if self.peek()[1] != ":":
            self.name()
        self.expect(":")
        kind = self.name()
        own = self.map() if self.peek()[1] == "{" else {}
        self.expect("]")
        self.expect("-" if left else "->")
        other, _, _ = self.node()
        maps, _ = self.sets()
        self.done()
        a, b = (other, name) if left else (name, other)
        if a not in matched or b not in matched:
            raise ScriptError("an edge between nodes that are not matched")
        for var, row in rows:
            ends = [_filled(matched[x][1], [], var, row) for x in (a, b)]
            if any(len(e) != 1 for e in ends):
                raise ScriptError("an end of an edge is matched by one property")
            yield "edge", [kind], _filled(own, maps, var, row), *[next(iter(e.items())) for e in ends]


def _found(value: Any, var: str, row: dict) -> Any:
    if not isinstance(value, _Row):
        return value
    if value[0] != var:
        raise ScriptError(f"{'.'.join(value)} is not known")
    for key in value[1:]:
        row = row.get(key) if isinstance(row, dict) else None
    return row


def _filled(props: dict, maps: list, var: str, row: dict) -> dict:
    out = {k: _found(v, var, row) for k, v in props.items()}
    for m in maps:
        out.update(_found(m, var, row) or {})
    return out


def _passed_over(text: str) -> bool:
    """Transaction marks and the statements about the dump's own import keys."""
    own = f"`{IMPORT_LABEL}`" in text
    return not text or text.startswith(":") or (own and re.match(r"(CREATE|DROP) CONSTRAINT|MATCH .* REMOVE ", text, re.S) is not None)


def import_script(spark: SparkSession, path: str, all_labels: bool = False, on_error: str = "abort") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: id, key, label, properties_json; edges: eid, src, dst, label, properties_json; rejected: reason).

    A node is known by the dump's import key or, in dumps without one, by its first label and
    all its properties.  Edges find their ends by the one property that their MATCH names;
    an end that no node has is rejected.  A node has its first label, or with all_labels all
    of them joined by a colon.  date and datetime values are microseconds, times stay texts.
    """
    ship(spark)

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "label", "key", "properties_json", "src_by", "src_key", "dst_by", "dst_key", "found_by", "reason"]
        for part in parts:
            out: list[tuple] = []
            for text in part["value"]:
                text = re.sub(r"^(\s*(:[a-z]+;?|//[^\n]*|)\s*(\n|$))*", "", text or "").strip()
                if _passed_over(text.rstrip(";").strip()):
                    continue
                try:
                    s = _Statement(text)
                    for kind, labels, props, src, dst in s.rows():
                        labels = [x for x in labels if x != IMPORT_LABEL]
                        label = (":".join(labels) if all_labels else labels[0]) if labels else "Node"
                        key = props.pop(IMPORT_KEY, None)
                        body = json.dumps(props, sort_keys=True)
                        found = {k: json.dumps(v) for k, v in props.items() if v is not None and not isinstance(v, list | dict)}
                        key = f"{label} {body}" if key is None else json.dumps(key)
                        if kind == "node":
                            out.append((kind, label, key, body, None, None, None, None, found | {IMPORT_KEY: key}, None))
                        else:
                            out.append((kind, label, None, body, src[0], json.dumps(src[1]), dst[0], json.dumps(dst[1]), None, None))
                    out.extend((None,) * 9 + (f"dropped {x}",) for x in s.lost)
                except (ScriptError, _Unsupported, TypeError, AttributeError) as e:
                    out.append((None,) * 9 + (f"{e}: {text[:80]}",))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    schema = "kind string, label string, key string, properties_json string, src_by string, src_key string, dst_by string, dst_key string, found_by map<string,string>, reason string"
    rows = spark.read.option("lineSep", ";\n").text(path).mapInPandas(parsed, schema)
    if on_error == "abort":
        rows = rows.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("boolean")).otherwise(True))
    rejected = rows.where("reason is not null").select("reason")
    nodes = rows.where("kind = 'node'").withColumn("id", F.xxhash64(F.lit("node"), "key"))
    edges = rows.where("kind = 'edge'")
    # only properties by which some edge finds an end are looked up
    asked = edges.select(F.col("src_by").alias("by")).union(edges.select("dst_by")).distinct()
    known = nodes.select("id", F.explode("found_by").alias("by", "at")).join(asked, "by", "left_semi")
    for end in ("src", "dst"):
        edges = edges.join(known.select(F.col("id").alias(end), F.col("by").alias(f"{end}_by"), F.col("at").alias(f"{end}_key")), [f"{end}_by", f"{end}_key"], "left")
    lost = F.col("src").isNull() | F.col("dst").isNull()
    rejected = rejected.unionByName(edges.where(lost).select(F.concat_ws(" ", "label", "src_key", "dst_key", F.lit("has an end that is not known")).alias("reason")))
    found = edges.where(~lost).select(F.xxhash64("label", "src", "dst", "properties_json").alias("eid"), "src", "dst", "label", "properties_json")
    return nodes.select("id", "key", "label", "properties_json"), found, rejected
