"""SQL:2011 over the graph: one-table SELECT with FOR SYSTEM_TIME / VALID_TIME, MATCH and k-NN order.

FROM names nodes, edges or a label in lower case.  GROUP BY, HAVING and DISTINCT are
honoured.  IS NULL compares with null as a value, so it is false for an absent key of
a label that lacks it; with typed columns absent and null are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import temporal as TP
from ..operators import vector as VO
from .aql import instant
from .core import Compiler, Expressions, Graph, Patterns, QueryError, Tokens, guard_read_only, has_aggregate, label_of, match_chains


def run_sql(spark: SparkSession, graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    guard_read_only(text)
    return _Run(spark, graph, text, params or {}).run()


class _Run:
    def __init__(self, spark: SparkSession, graph: Graph, text: str, params: dict):
        self.spark, self.graph, self.t = spark, graph, Tokens(text)
        self.e = Expressions(self.t, params)
        self.valid = self.tx = TP.OPEN

    def stamp(self) -> int:
        self.t.take("TIMESTAMP")
        return instant(self.e.atom()[1])

    def run(self) -> DataFrame:
        t = self.t
        t.expect("SELECT")
        distinct = t.take("DISTINCT")
        items = [self.item()]
        while t.take(","):
            items.append(self.item())
        t.expect("FROM")
        source = t.name()
        between = self.temporal()
        graph = self.graph
        if between:
            graph = graph.overlapping(*between)
        elif (self.valid, self.tx) != (TP.OPEN, TP.OPEN):
            graph = graph.at(self.valid, self.tx)
        if t.take("MATCH"):
            chains = Patterns(self.e).chains()
            rows = match_chains(graph, chains)
            last = chains[0][-1].var
            rows = rows.withColumns({f"t__{c[len(last) + 2 :]}": F.col(c) for c in rows.columns if c.startswith(f"{last}__")})
        else:
            rows = self.source(graph, source)
        c = Compiler(rows.columns)
        self.near = None
        if t.take("WHERE"):
            self.near = self.knn_call()
            if self.near is None or t.take("AND"):
                rows = rows.where(c.test(self.bare(self.e.parse())))
        if t.is_word("JOIN") or t.is_word("UNION") or t.peek() == ",":
            raise QueryError("one table only, without set operations")
        group, having = None, None
        if t.take("GROUP", "BY"):
            group = [self.bare(self.e.parse())]
            while t.take(","):
                group.append(self.bare(self.e.parse()))
            if t.take("HAVING"):
                having = self.bare(self.e.parse())
        order, knn = [], None
        if t.take("ORDER", "BY"):
            while True:
                e = self.bare(self.e.sum())
                if t.take("<=>"):
                    if knn is not None or order:
                        raise QueryError("<=> is the first sort key")
                    knn = (e, self.vector())
                    t.take("ASC")
                else:
                    down = t.take("DESC")
                    if not down:
                        t.take("ASC")
                    order.append((e, down))
                if not t.take(","):
                    break
        limit = t.integer() if t.take("LIMIT") else None
        skip = t.integer() if t.take("OFFSET") else 0
        if t.kind() != "end":
            raise QueryError(f"unexpected {t.peek()!r}")
        items = [(self.bare(e) if e is not None else None, n) for e, n in items]
        if knn is not None:
            rows = VO.rerank(rows, knn[1], None, id_col="t__id", vector_col=f"t__{knn[0][2]}")
            keys = [(c.value(e), down) for e, down in order]
            rows = rows.orderBy(F.desc("score"), *[k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys], "t__id")
            return self.select(G.page(rows, skip, VO.RERANK_K if limit is None else limit), items, extra=["score"])
        if self.near is not None:
            column, q, k, metric = self.near
            return self.select(G.page(VO.rerank(rows, q, k, metric, id_col="t__id", vector_col=f"t__{column}"), skip, limit), items, extra=["score"])
        if group is not None or any(e is not None and has_aggregate(e) for e, _ in items):
            out = self.grouped(rows, items, group or [], having)
            keys = [(F.col(label_of(e) if e[0] != "prop" else e[2]), down) for e, down in order]
        else:
            named = {n: e for e, n in items if e is not None}
            keys = [(c.value(named.get(e[2], e) if e[0] == "prop" else e), down) for e, down in order]
            out = rows
        out = out.orderBy(*[k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys]) if keys else out
        if group is None and not any(e is not None and has_aggregate(e) for e, _ in items):
            if distinct:
                return G.page(self.select(rows, items).distinct(), skip, limit)
            return self.select(G.page(out, skip, limit), items)
        return G.page(out, skip, limit)

    def item(self) -> tuple[tuple | None, str]:
        if self.t.take("*"):
            return None, "*"
        e = self.e.parse()
        return e, self.t.name() if self.t.take("AS") else label_of(self.bare(e)).removeprefix("t_")

    def bare(self, e):
        """Bare names are columns of the table."""
        if not isinstance(e, tuple):
            return e
        if e[0] == "var":
            return ("prop", "t", e[1])
        if e[0] == "prop":
            return e
        return tuple([self.bare(y) for y in x] if isinstance(x, list) and e[0] in ("list", "call") else self.bare(x) if isinstance(x, tuple) else x for x in e)

    def temporal(self) -> tuple[int, int] | None:
        t = self.t
        between = None
        while t.take("FOR"):
            system = t.take("SYSTEM_TIME")
            if not system:
                t.expect("VALID_TIME")
            if t.take("AS", "OF"):
                at = self.stamp()
                if system:
                    self.tx = at
                else:
                    self.valid = at
            elif t.take("BETWEEN") or t.take("FROM"):
                if system:
                    raise QueryError("ranges over system time are not offered on label scans")
                a = self.stamp()
                if not t.take("AND"):
                    t.expect("TO")
                between = (a, self.stamp())
            else:
                raise QueryError("expected AS OF or BETWEEN")
        return between

    def source(self, graph: Graph, name: str) -> DataFrame:
        low = name.lower()
        if low == "edges":
            df = graph.edges
        elif low == "nodes":
            df = graph.scan(None)
        else:
            # labels are looked up in lower case
            df = Graph({k.lower(): v for k, v in graph.nodes.items()}).scan(low)
        return df.select(*[F.col(c).alias(f"t__{c}") for c in df.columns])

    def knn_call(self) -> tuple | None:
        """KNN(column, vector, k [, metric]) at the head of WHERE: (column, vector, k, metric)."""
        t = self.t
        if not t.take("KNN", "("):
            return None
        column = t.name()
        t.expect(",")
        q = self.vector()
        t.expect(",")
        k, metric = t.integer(), "cosine"
        if t.take(","):
            metric = str(self.e.atom()[1]).lower()
        t.expect(")")
        return column, q, k, metric

    def vector(self) -> list[float]:
        e = self.e.atom()
        value = e[1]
        if isinstance(value, str):
            value = [float(x) for x in value.strip("[] ").split(",")]
            if self.t.take(":"):
                self.t.expect(":")
                self.t.name()
        return [float(x) for x in value]

    def select(self, rows: DataFrame, items: list, extra: list[str] = ()) -> DataFrame:
        c = Compiler(rows.columns)
        out = []
        for e, n in items:
            if e is None:
                out += [F.col(x).alias(x[3:]) for x in rows.columns if x.startswith("t__")]
            else:
                out.append(c.value(e).alias(n))
        return rows.select(*out, *extra)

    def grouped(self, rows: DataFrame, items: list, group: list[tuple], having: tuple | None) -> DataFrame:
        c = Compiler(rows.columns)
        keyed = rows.withColumns({f"_k{k}": c.value(e) for k, e in enumerate(group)})
        aggs = [c.aggregate(e).alias(n) for e, n in items if has_aggregate(e)]
        if having is not None:
            parts: list[tuple] = []
            having = _lift(having, parts)
            aggs += [c.aggregate(e).alias(f"_h{k}") for k, e in enumerate(parts)]
        names = [f"_k{k}" for k in range(len(group))]
        out = keyed.groupBy(*names).agg(*aggs) if names else keyed.agg(*aggs)
        if having is not None:
            keys = {e: ("var", f"_k{k}") for k, e in enumerate(group)}
            out = out.where(Compiler(out.columns).test(_replace(having, keys)))
        pick = [F.col(f"_k{group.index(e)}").alias(n) if e in group else F.col(n) for e, n in items]
        return out.select(*pick)


def _lift(e, parts: list[tuple]):
    """The expression with its aggregates, collected in parts, replaced by variables."""
    if not isinstance(e, tuple):
        return e
    if e[0] == "agg":
        parts.append(e)
        return ("var", f"_h{len(parts) - 1}")
    return tuple(_lift(x, parts) for x in e)


def _replace(e, names: dict[tuple, tuple]):
    if not isinstance(e, tuple):
        return e
    return names[e] if e in names else tuple(_replace(x, names) for x in e)
