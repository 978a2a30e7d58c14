"""What the query languages share: tokens, expressions, patterns and their lowering to DataFrames.

A bound variable v owns the columns v__id, v__label and v__<property>; an edge variable
has v__eid, v__type and its properties.  Expressions compile to columns under a null regime.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import temporal as TP

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
VECTOR_FUNCTIONS = {
    "vector.similarity": "cosine", "vector.cosine": "cosine", "vector.euclidean": "euclidean", "vector.dot_product": "dot",
}
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<mark><=>|<=|>=|<>|!=|->|<-|\.\.|[-+*/()\[\]{},.:<>=|;%]))"
)
_COMMENT = re.compile(r"\s*//[^\n]*\n?|\s+\Z")
MUTATIONS = {"CREATE", "SET", "DELETE", "DETACH", "REMOVE", "MERGE", "INSERT", "UPDATE", "DROP", "ALTER"}


class QueryError(ValueError):
    """The text is not a query of the language, or asks for what it does not offer."""


@dataclass
class Graph:
    """Nodes by label (each with id), one edge table (eid, src, dst, label, properties), histories by label."""

    nodes: dict[str, DataFrame]
    edges: DataFrame | None = None
    histories: dict[str, DataFrame] = field(default_factory=dict)
    edge_history: DataFrame | None = None
    vector: str = "embedding"

    def at(self, valid: int, tx: int) -> Graph:
        """The graph as believed at (valid, tx); labels without a history are taken as they are."""
        nodes = self.nodes | {k: TP.as_of(w, valid, tx) for k, w in self.histories.items()}
        edges = self.edges
        if self.edge_history is not None:
            edges = TP.as_of(self.edge_history, valid, tx).withColumnRenamed("id", "eid")
        return Graph(nodes, edges, self.histories, self.edge_history, self.vector)

    def overlapping(self, start: int, end: int) -> Graph:
        nodes = self.nodes | {k: TP.between(w, start, end) for k, w in self.histories.items()}
        return Graph(nodes, self.edges, self.histories, self.edge_history, self.vector)

    def scan(self, label: str | None) -> DataFrame:
        if label is not None:
            if label not in self.nodes:
                first = next(iter(self.nodes.values()))
                return first.limit(0).withColumn("label", F.lit(label))
            return self.nodes[label].withColumn("label", F.lit(label))
        parts = [df.withColumn("label", F.lit(k)) for k, df in self.nodes.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip().rstrip(";").rstrip()
        while at < len(text):
            if skipped := _COMMENT.match(text, at):
                at = skipped.end()
                continue
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise QueryError(f"cannot read {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.items[k][1] if k < len(self.items) else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.items[k][0] if k < len(self.items) else "end"

    def next(self) -> str:
        if self.at >= len(self.items):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.items[self.at - 1][1]

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        return all(self.kind(ahead + k) == "word" and self.peek(ahead + k).upper() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        """Take these keywords or marks if they come next."""
        for k, w in enumerate(words):
            own = self.peek(k).upper() if self.kind(k) == "word" else self.peek(k)
            if own != w or self.kind(k) == "string":
                return False
        self.at += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            raise QueryError(f"expected {' '.join(words)} before {self.peek()!r}")

    def name(self) -> str:
        if self.kind() != "word":
            raise QueryError(f"expected a name before {self.peek()!r}")
        return self.next()

    def integer(self) -> int:
        sign = -1 if self.take("-") else 1
        if self.kind() != "number" or "." in self.peek():
            raise QueryError(f"expected a whole number before {self.peek()!r}")
        return sign * int(self.next())


def unquote(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s[1:-1])


class Expressions:
    """Recursive descent over Tokens to nested tuples: (op, operands)."""

    def __init__(self, tokens: Tokens, params: dict):
        self.t, self.params = tokens, params

    def parse(self) -> tuple:
        left = self.conjunction()
        while self.t.take("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.t.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.t.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        t = self.t
        left = self.sum()
        if t.take("IS"):
            negated = t.take("NOT")
            t.expect("NULL")
            return ("has" if negated else "absent", left)
        for mark in ("<=", ">=", "<>", "!=", "=", "<", ">"):
            if t.take(mark):
                return ("cmp", "<>" if mark == "!=" else mark, left, self.sum())
        for words, kind in ((("IN",), "in"), (("CONTAINS",), "contains"), (("STARTS", "WITH"), "starts"), (("ENDS", "WITH"), "ends")):
            if t.take(*words):
                return (kind, left, self.sum())
        return self._like(left, self.sum()) if t.take("LIKE") else left

    def _like(self, left: tuple, pattern: tuple) -> tuple:
        p = pattern[1]
        body = p.strip("%")
        if "%" in body or "_" in body:
            raise QueryError("LIKE takes %x%, x% or %x")
        kind = "contains" if p[:1] == p[-1:] == "%" else "ends" if p[:1] == "%" else "starts" if p[-1:] == "%" else "equal"
        return ("cmp", "=", left, ("lit", body)) if kind == "equal" else (kind, left, ("lit", body))

    def sum(self) -> tuple:
        left = self.product()
        while self.t.peek() in ("+", "-") and self.t.kind() == "mark":
            left = ("math", self.t.next(), left, self.product())
        return left

    def product(self) -> tuple:
        left = self.atom()
        while self.t.peek() in ("*", "/", "%") and self.t.kind() == "mark":
            left = ("math", self.t.next(), left, self.atom())
        return left

    def atom(self) -> tuple:
        t = self.t
        if t.take("("):
            inner = self.parse()
            t.expect(")")
            return inner
        if t.take("-"):
            inner = self.atom()
            return ("lit", -inner[1]) if inner[0] == "lit" else ("math", "-", ("lit", 0), inner)
        if t.take("["):
            items = []
            while not t.take("]"):
                items.append(self.parse())
                t.take(",")
            return ("lit", [x[1] for x in items]) if all(x[0] == "lit" for x in items) else ("list", items)
        kind = t.kind()
        if kind == "number":
            s = t.next()
            return ("lit", float(s) if "." in s or "e" in s.lower() else int(s))
        if kind == "string":
            return ("lit", unquote(t.next()))
        if kind == "param":
            name = t.next()[1:]
            if name not in self.params:
                raise QueryError(f"no value for parameter ${name}")
            return ("lit", self.params[name])
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if t.take(word):
                return ("lit", value)
        name = t.name()
        if t.peek() == "." and f"{name}.{t.peek(1)}".lower() in VECTOR_FUNCTIONS and t.peek(2) == "(":
            t.next()
            name = f"{name}.{t.next()}"
        if t.take("("):
            return self._call(name.lower())
        if t.take("."):
            return ("prop", name, t.name())
        return ("var", name)

    def _call(self, name: str) -> tuple:
        t = self.t
        distinct = t.take("DISTINCT")
        if t.take("*"):
            t.expect(")")
            return ("agg", name, "*", False)
        args = []
        while not t.take(")"):
            args.append(self.parse())
            t.take(",")
        if name in AGGREGATES:
            return ("agg", name, args[0], distinct)
        if name == "exists":
            return ("has", args[0])
        return ("call", name, args)


class Compiler:
    """Expression tuples to columns over the columns at hand; a property that no column has is null."""

    def __init__(self, columns: list[str], regime: str = "R1", optional: set[str] = frozenset()):
        """optional: variables that an optional match may have left empty; their comparisons are of regime R3."""
        self.columns, self.regime, self.optional = set(columns), regime, optional

    def prop(self, var: str, key: str) -> Column:
        name = f"{var}__{key}"
        if name in self.columns:
            return F.col(name)
        if key in ("source", "confidence", "reason", "note") and f"{var}__provenance" in self.columns:
            return F.col(f"{var}__provenance.{key}")
        return F.lit(None)

    def value(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "list":
            return F.array(*map(self.value, e[1]))
        if kind == "prop":
            return self.prop(e[1], e[2])
        if kind == "var":
            if e[1] in self.columns:
                return F.col(e[1])
            for key in ("id", "eid"):
                if f"{e[1]}__{key}" in self.columns:
                    return F.col(f"{e[1]}__{key}")
            raise QueryError(f"{e[1]} is not bound")
        if kind == "math":
            a, b = self.value(e[2]), self.value(e[3])
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[e[1]]
        if kind == "call":
            return self.call(e[1], e[2])
        return self.test(e)

    def call(self, name: str, args: list[tuple]) -> Column:
        if name in VECTOR_FUNCTIONS:
            return V.similarity(self.value(args[0]), self.value(args[1]), VECTOR_FUNCTIONS[name])
        if name in ("source", "confidence", "reason"):
            return self.prop(args[0][1], name)
        if name in ("id", "elementid"):
            return self.value(args[0])
        if name in ("type", "label", "labels"):
            key = "type" if f"{args[0][1]}__type" in self.columns else "label"
            return self.prop(args[0][1], key)
        raise QueryError(f"no function {name}")

    def test(self, e: tuple) -> Column:
        kind = e[0]
        if kind in ("and", "or"):
            a, b = self.test(e[1]), self.test(e[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.test(e[1])
        if kind == "has":
            return self.value(e[1]).isNotNull()
        if kind == "absent":
            return self.value(e[1]).isNull()
        if kind == "cmp":
            left, right, op = e[2], e[3], e[1]
            if left[0] == "lit" and right[0] != "lit":
                left, right = right, left
                op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            target = right[1] if right[0] == "lit" and not isinstance(right[1], list) else self.value(right)
            if target is None and self.regime == "R2":
                return F.lit(None).cast("boolean")
            if left[0] == "prop" and left[1] in self.optional and f"{left[1]}__id" in self.columns:
                return P.compare("R3", op, self.value(left), target, F.col(f"{left[1]}__id").isNotNull())
            return P.compare(self.regime, op, self.value(left), target)
        if kind == "in":
            if e[2][0] == "lit":
                values = [x for x in (e[2][1] or []) if x is not None]
                return P.is_in(self.value(e[1]), values) if self.regime == "R1" else self.value(e[1]).isin(*values) if values else F.lit(False)
            return F.coalesce(F.array_contains(self.value(e[2]), self.value(e[1])), F.lit(False))
        if kind in ("contains", "starts", "ends"):
            f: Callable = {"contains": P.contains, "starts": P.starts_with, "ends": P.ends_with}[kind]
            return f(self.value(e[1]), e[2][1])
        if kind == "lit":
            return F.lit(bool(e[1]))
        return F.coalesce(self.value(e).cast("boolean"), F.lit(False))

    def aggregate(self, e: tuple) -> Column:
        _, name, arg, distinct = e
        if arg == "*":
            return F.count("*")
        v = self.value(arg)
        if name == "count":
            return F.count_distinct(v) if distinct else F.count(v)
        if name == "sum":
            return F.coalesce(F.sum_distinct(v) if distinct else F.sum(v), F.lit(0))
        if name == "collect":
            return F.collect_set(v) if distinct else F.collect_list(v)
        if name == "avg":
            return F.avg(v)
        return F.min(v) if name == "min" else F.max(v)


def has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "agg" or any(has_aggregate(x) for x in e))


def label_of(e: tuple) -> str:
    """The column name of an item without alias."""
    if e[0] == "prop":
        return f"{e[1]}_{e[2]}"
    if e[0] == "var":
        return e[1]
    if e[0] == "agg":
        return e[1] if e[2] == "*" else f"{e[1]}_{label_of(e[2])}"
    return e[1].replace(".", "_") if e[0] == "call" else "value"


# patterns


@dataclass
class NodePattern:
    var: str
    label: str | None
    props: dict


@dataclass
class HopPattern:
    var: str | None
    label: str | None
    direction: str
    depth: tuple[int, int | None] | None
    props: dict = field(default_factory=dict)


class Patterns:
    def __init__(self, expressions: Expressions):
        self.e, self.t, self.fresh = expressions, expressions.t, 0

    def node(self) -> NodePattern:
        t = self.t
        t.expect("(")
        var = t.name() if t.kind() == "word" else None
        label = t.name() if t.take(":") else None
        props = {}
        if t.take("{"):
            while not t.take("}"):
                key = t.name()
                t.expect(":")
                props[key] = self.e.sum()[1]
                t.take(",")
        t.expect(")")
        if var is None:
            self.fresh += 1
            var = f"_n{self.fresh}"
        return NodePattern(var, label, props)

    def hop(self) -> HopPattern:
        t = self.t
        back = t.take("<-")
        if not back:
            t.expect("-")
        var = label = depth = None
        props: dict = {}
        if t.take("["):
            var = t.name() if t.kind() == "word" else None
            label = t.name() if t.take(":") else None
            if t.take("*"):
                depth = (1, None)
                if t.kind() == "number":
                    low = t.integer()
                    depth = (low, low)
                    if t.take(".."):
                        depth = (low, t.integer() if t.kind() == "number" else None)
                elif t.take(".."):
                    depth = (1, t.integer())
            if t.take("{"):
                while not t.take("}"):
                    key = t.name()
                    t.expect(":")
                    props[key] = self.e.sum()[1]
                    t.take(",")
            t.expect("]")
        forward = t.take("->")
        if not forward:
            t.expect("-")
        return HopPattern(var, label, "both" if back == forward else "in" if back else "out", depth, props)

    def chain(self) -> list:
        out: list = [self.node()]
        while self.t.kind() == "mark" and self.t.peek() in ("-", "<-"):
            out += [self.hop(), self.node()]
        return out

    def chains(self) -> list[list]:
        out = [self.chain()]
        while self.t.take(","):
            out.append(self.chain())
        return out


def bind_node(graph: Graph, n: NodePattern) -> DataFrame:
    df = graph.scan(n.label)
    out = df.select(*[F.col(c).alias(f"{n.var}__{c}") for c in df.columns])
    for key, value in n.props.items():
        out = out.where(Compiler(out.columns).test(("cmp", "=", ("prop", n.var, key), ("lit", value))))
    return out


def match_chains(graph: Graph, chains: list[list], bound: DataFrame | None = None, isomorphic: bool = False) -> DataFrame:
    """Rows of all chains.  isomorphic: a row per edge, each edge once; else a row per distinct target."""
    out, used = bound, [] if bound is None else [c for c in bound.columns if c.startswith("_e")]
    for chain in chains:
        first = chain[0]
        if out is None:
            out = bind_node(graph, first)
        elif f"{first.var}__id" in out.columns:
            if first.label or first.props:
                out = out.join(bind_node(graph, first).select(F.col(f"{first.var}__id")), f"{first.var}__id", "left_semi")
        elif not any(isinstance(x, NodePattern) and f"{x.var}__id" in out.columns for x in chain):
            # parts without a shared variable are a product, as the language defines them
            out = out.join(bind_node(graph, first), how="cross")
        else:
            chain = _turn(chain, out.columns)
            first = chain[0]
        at = first.var
        for hop, node in zip(chain[1::2], chain[2::2]):
            out = _step(graph, out, at, hop, node, used, isomorphic)
            at = node.var
    return out


def _turn(chain: list, columns: list[str]) -> list:
    """The chain read from its other end, so that it starts at a bound variable."""
    if f"{chain[-1].var}__id" not in columns:
        raise QueryError("a pattern must start or end at a bound variable")
    flip = {"out": "in", "in": "out", "both": "both"}
    return [HopPattern(x.var, x.label, flip[x.direction], x.depth, x.props) if isinstance(x, HopPattern) else x for x in reversed(chain)]


def _step(graph: Graph, rows: DataFrame, at: str, hop: HopPattern, node: NodePattern, used: list[str], isomorphic: bool) -> DataFrame:
    if graph.edges is None:
        raise QueryError("the graph has no edges")
    edges = graph.edges if hop.label is None else graph.edges.where(F.col("label") == hop.label)
    for key, value in hop.props.items():
        edges = edges.where(P.compare("R1", "=", F.col(key) if key in edges.columns else F.lit(None), value))
    target = f"{node.var}__id"
    known = target in rows.columns
    if hop.depth is not None:
        low, high = hop.depth
        anchors = rows.select(F.col(f"{at}__id").alias("anchor"))
        reach = G.traverse(anchors, edges, hop.direction, low, high)
        step = reach.select(F.col("anchor").alias(f"{at}__id"), F.col("id").alias(target))
    else:
        step = G.directed(edges, hop.direction)
        keep = isomorphic or hop.var is not None
        if keep:
            eid = f"_e{len(used)}"
            props = [c for c in step.columns if c not in ("eid", "src", "dst", "label")] if hop.var else []
            own = [F.col("eid").alias(f"{hop.var}__eid"), F.col("label").alias(f"{hop.var}__type")] if hop.var else []
            step = step.select(F.col("src").alias(f"{at}__id"), F.col("dst").alias(target), F.col("eid").alias(eid), *own, *[F.col(c).alias(f"{hop.var}__{c}") for c in props])
        else:
            step = step.where("src <> dst").select(F.col("src").alias(f"{at}__id"), F.col("dst").alias(target)).distinct()
    out = rows.join(step, [f"{at}__id", target] if known else [f"{at}__id"])
    if hop.depth is None and (isomorphic or hop.var is not None):
        new = f"_e{len(used)}"
        if isomorphic:
            for other in used:
                out = out.where(F.col(new) != F.col(other))
        used.append(new)
    if known:
        return out
    return out.join(bind_node(graph, node), target)


def guard_read_only(text: str) -> None:
    items = Tokens(text).items
    for k, (kind, word) in enumerate(items):
        if kind != "word" or word.upper() not in MUTATIONS:
            continue
        # a name after a dot, a colon or AS, and a key before a colon, are no clause
        before, after = (items[j][1].upper() if 0 <= j < len(items) else "" for j in (k - 1, k + 1))
        if before not in (".", ":", "AS") and after != ":":
            raise QueryError(f"{word.upper()} would change the graph")
