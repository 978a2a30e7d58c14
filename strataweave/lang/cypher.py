"""Cypher reads: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN, ORDER BY, SKIP, LIMIT, AS OF, EXPLAIN.

One chain without a bound edge gives a row per distinct target; several comma patterns
use each edge once.  Comparisons are two-valued for one chain and three-valued for
several patterns; rows that an OPTIONAL MATCH left empty fail every comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .core import Compiler, Expressions, Graph, NodePattern, Patterns, QueryError, Tokens, guard_read_only, has_aggregate, label_of, match_chains

STARTS = ("MATCH", "OPTIONAL", "UNWIND", "WITH", "RETURN", "WHERE", "ORDER", "SKIP", "LIMIT")


def run_cypher(spark: SparkSession, graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    guard_read_only(text)
    return _Run(spark, graph, text, params or {}).run()


class _Run:
    def __init__(self, spark: SparkSession, graph: Graph, text: str, params: dict):
        self.spark, self.graph = spark, graph
        self.t = Tokens(text)
        self.e = Expressions(self.t, params)
        self.p = Patterns(self.e)
        self.rows: DataFrame | None = None
        self.regime = "R1"
        self.optionals: set[str] = set()

    def run(self) -> DataFrame:
        t = self.t
        self.explain = t.take("EXPLAIN") or t.take("PROFILE")
        if t.take("AS", "OF"):
            v = self.stamp()
            x = self.stamp() if t.take(",") else (1 << 63) - 1
            self.graph = self.graph.at(v, x)
        done = False
        while t.kind() != "end":
            if done:
                raise QueryError(f"nothing may follow RETURN: {t.peek()!r}")
            if t.take("OPTIONAL", "MATCH"):
                self.optional()
            elif t.take("MATCH"):
                self.match()
            elif t.take("UNWIND"):
                self.unwind()
            elif t.take("WITH"):
                self.project(False)
                if t.take("WHERE"):
                    self.where(self.e.parse())
            elif t.take("RETURN"):
                self.project(True)
                done = True
            else:
                raise QueryError(f"unexpected {t.peek()!r}")
        if not done:
            raise QueryError("a query ends with RETURN")
        if self.explain:
            plan = self.rows._jdf.queryExecution().explainString(self.rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        return self.rows

    def stamp(self) -> int:
        e = self.e.atom()
        if not isinstance(e[1], int):
            raise QueryError("a time is given in microseconds")
        return e[1]

    def match(self) -> None:
        chains = self.p.chains()
        several = len(chains) > 1
        self.regime = "R2" if several else "R1"
        bound = self.rows
        # an unconnected first row set, as from UNWIND, is carried along
        self.rows = match_chains(self.graph, chains, bound, isomorphic=several)
        if self.t.take("WHERE"):
            self.where(self.e.parse())

    def where(self, e: tuple) -> None:
        self.rows = self.rows.where(Compiler(self.rows.columns, self.regime, self.optionals).test(e))

    def optional(self) -> None:
        chains = self.p.chains()
        if self.rows is None:
            raise QueryError("OPTIONAL MATCH follows a MATCH")
        left = self.rows
        names = {x.var for c in chains for x in c if isinstance(x, NodePattern)}
        keys = [f"{v}__id" for v in sorted(names) if f"{v}__id" in left.columns]
        # sub-pattern with its own filter first, then one outer join on the shared variables
        shared = {k[:-4] for k in keys}
        base = left.select(*[c for c in left.columns if c.split("__")[0] in shared]).distinct()
        right = match_chains(self.graph, chains, base)
        if self.t.take("WHERE"):
            right = right.where(Compiler(right.columns, "R1").test(self.e.parse()))
        new = [c for c in right.columns if c not in left.columns]
        self.optionals |= {c.removesuffix("__id") for c in new if c.endswith("__id")}
        self.rows = G.optional_match(left, right.select(*keys, *new), keys)

    def unwind(self) -> None:
        e = self.e.parse()
        self.t.expect("AS")
        name = self.t.name()
        if e[0] == "lit":
            values = [] if e[1] is None else e[1] if isinstance(e[1], list) else [e[1]]
            if not values:
                self.rows = (self.rows or self.spark.createDataFrame([(0,)], "x int")).limit(0).withColumn(name, F.lit(None))
                return
            items = F.explode(F.lit(values)).alias(name)
        else:
            items = F.explode(Compiler(self.rows.columns).value(e)).alias(name)
        rows = self.rows if self.rows is not None else self.spark.range(1).drop("id")
        self.rows = rows.select("*", items)

    def project(self, final: bool) -> None:
        t = self.t
        distinct = t.take("DISTINCT")
        rows = self.rows if self.rows is not None else self.spark.range(1).drop("id")
        if t.take("*"):
            items = []
        else:
            items = [self.item()]
            while t.take(","):
                items.append(self.item())
        order = []
        if t.take("ORDER", "BY"):
            order.append(self.order_item())
            while t.take(","):
                order.append(self.order_item())
        skip = limit = None
        while True:
            if t.take("SKIP"):
                skip = self.e.atom()[1]
            elif t.take("LIMIT"):
                limit = self.e.atom()[1]
            else:
                break
        c = Compiler(rows.columns, self.regime)
        if not items:
            out = rows
        elif any(has_aggregate(e) for e, _ in items):
            keys = [(e, n) for e, n in items if not has_aggregate(e)]
            own = rows.select("*", *[c.value(e).alias(f"_k{k}") for k, (e, _) in enumerate(keys)])
            aggregates = [c.aggregate(e).alias(n) for e, n in items if has_aggregate(e)]
            names = [f"_k{k}" for k in range(len(keys))]
            out = (own.groupBy(*names).agg(*aggregates) if names else own.agg(*aggregates)).withColumnsRenamed({f"_k{k}": n for k, (_, n) in enumerate(keys)})
            out = out.select(*[n for _, n in items])
        else:
            picked = []
            for e, n in items:
                if not final and e[0] == "var" and f"{e[1]}__id" in rows.columns:
                    picked += [F.col(x).alias(n + x[len(e[1]) :]) for x in rows.columns if x.startswith(f"{e[1]}__")]
                else:
                    picked.append(c.value(e).alias(n))
            if distinct:
                # entities count by id; computed rows by all their columns
                entity = [f"{e[1]}__id" for e, _ in items if e[0] in ("var", "prop") and f"{e[1]}__id" in rows.columns]
                rows = rows.dropDuplicates(sorted(set(entity))) if len(set(entity)) == 1 and len(items) == 1 and items[0][0][0] == "var" else rows
            hidden = [(k, e) for k, (e, _) in enumerate(order) if not distinct and not (e[0] == "var" and e[1] in [n for _, n in items])]
            out = rows.select(*picked, *[c.value(e).alias(f"_o{k}") for k, e in hidden])
            out = out.distinct() if distinct else out
        if order:
            oc = Compiler(out.columns, self.regime)
            keys = [(F.col(f"_o{k}") if f"_o{k}" in out.columns else self.ordering(oc, out, e), down) for k, (e, down) in enumerate(order)]
            out = out.orderBy(*[k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys])
        out = G.page(out, skip or 0, limit)
        self.rows = out.drop(*[x for x in out.columns if x.startswith("_o")])

    def ordering(self, compiler: Compiler, out: DataFrame, e: tuple):
        name = label_of(e)
        return F.col(name) if name in out.columns else compiler.value(e)

    def item(self) -> tuple[tuple, str]:
        e = self.e.parse()
        return e, self.t.name() if self.t.take("AS") else label_of(e)

    def order_item(self) -> tuple[tuple, bool]:
        e = self.e.parse()
        down = self.t.take("DESC") or self.t.take("DESCENDING")
        if not down:
            self.t.take("ASC")
            self.t.take("ASCENDING")
        return e, down
