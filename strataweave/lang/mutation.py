"""Cypher writes: CREATE, MERGE, SET, REMOVE and DELETE, as a new graph made from the old one.

Tables are never changed in place: a write gives a Graph whose node and edge tables are
expressions over the old ones, so it is as lazy as a read.  New nodes and edges take the
ids above the greatest in use, in the order of the text; a MATCH before CREATE makes them
once per row, numbered in the rows' order by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .core import Compiler, Expressions, Graph, HopPattern, NodePattern, Patterns, QueryError, Tokens, bind_node, match_chains


def write_cypher(spark: SparkSession, graph: Graph, text: str, params: dict | None = None) -> Graph:
    return _Write(spark, graph, text, params or {}).run()


def _greatest(frames: list[DataFrame], column: str) -> int:
    """The greatest id in use, -1 for none: one number from each table."""
    tops = [df.agg(F.max(F.col(column).cast("long"))).first()[0] for df in frames]
    return max((t for t in tops if t is not None), default=-1)


class _Write:
    def __init__(self, spark: SparkSession, graph: Graph, text: str, params: dict):
        self.spark, self.t = spark, Tokens(text)
        self.graph = Graph(dict(graph.nodes), graph.edges, graph.histories, graph.edge_history, graph.vector)
        self.e = Expressions(self.t, params)
        self.p = Patterns(self.e)
        self.rows: DataFrame | None = None
        self.labels: dict[str, str | None] = {}
        self.edge_vars: set[str] = set()

    def run(self) -> Graph:
        t = self.t
        wrote = False
        while t.kind() != "end":
            if t.take("MATCH"):
                chains = self.p.chains()
                self.note(chains)
                self.rows = match_chains(self.graph, chains, self.rows)
                if t.take("WHERE"):
                    self.rows = self.rows.where(Compiler(self.rows.columns).test(self.e.parse()))
                continue
            wrote = True
            if t.take("CREATE"):
                for chain in self.p.chains():
                    self.create(chain)
            elif t.take("MERGE"):
                self.merge()
            elif t.take("SET"):
                self.assign(self.rows)
            elif t.take("REMOVE"):
                self.remove()
            elif t.take("DETACH", "DELETE"):
                self.delete(True)
            elif t.take("DELETE"):
                self.delete(False)
            else:
                raise QueryError(f"unexpected {t.peek()!r}")
        if not wrote:
            raise QueryError("a write has CREATE, MERGE, SET, REMOVE or DELETE")
        return self.graph

    def note(self, chains: list[list]) -> None:
        for x in (x for c in chains for x in c):
            if isinstance(x, NodePattern):
                self.labels[x.var] = x.label or self.labels.get(x.var)
            elif x.var:
                self.edge_vars.add(x.var)

    def add_nodes(self, label: str, rows: DataFrame) -> None:
        old = self.graph.nodes.get(label)
        self.graph.nodes[label] = rows if old is None else old.unionByName(rows, allowMissingColumns=True)

    def create(self, chain: list) -> None:
        """Nodes of the chain that are not bound are new, and so is every edge, once per row."""
        rows = self.rows if self.rows is not None else self.spark.range(1).select(F.lit(0).alias("_once"))
        order = [c for c in rows.columns if c.endswith("__id")] or rows.columns
        fresh = [x for x in chain if isinstance(x, NodePattern) and f"{x.var}__id" not in rows.columns]
        hops = [x for x in chain if isinstance(x, HopPattern)]
        base = _greatest([df for df in self.graph.nodes.values()], "id") + 1
        # numbered by one window only where there are several rows, those that the statement matched
        number = F.row_number().over(Window.orderBy(*order)) - 1 if self.rows is not None else F.lit(0)
        rows = rows.withColumn("_row", number.cast("long"))
        for k, x in enumerate(fresh):
            if x.label is None:
                raise QueryError("a new node needs a label")
            rows = rows.withColumn(f"{x.var}__id", F.lit(base + k) + F.col("_row") * len(fresh))
            self.add_nodes(x.label, rows.select(F.col(f"{x.var}__id").alias("id"), *[F.lit(v).alias(key) for key, v in x.props.items()]))
            self.labels[x.var] = x.label
        edges = [self.graph.edges] if self.graph.edges is not None else []
        first = _greatest(edges, "eid") + 1
        for k, hop in enumerate(hops):
            if hop.label is None or hop.direction == "both":
                raise QueryError("a new edge needs a type and a direction")
            a, b = chain[2 * k].var, chain[2 * k + 2].var
            if hop.direction == "in":
                a, b = b, a
            own = rows.select(
                (F.lit(first + k) + F.col("_row") * len(hops)).alias("eid"), F.col(f"{a}__id").alias("src"), F.col(f"{b}__id").alias("dst"), F.lit(hop.label).alias("label"),
                *[F.lit(v).alias(key) for key, v in hop.props.items()],
            )
            edges.append(own)
        if edges:
            self.graph.edges = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), edges)
        self.rows = rows.drop("_row")

    def merge(self) -> None:
        """The node of this label and these properties, made if there is none."""
        t = self.t
        node = self.p.node()
        if node.label is None:
            raise QueryError("MERGE needs a label")
        self.labels[node.var] = node.label
        known = node.label in self.graph.nodes and all(k in self.graph.nodes[node.label].columns for k in node.props)
        found = bind_node(self.graph, node) if known else None
        exists = found is not None and not found.isEmpty()
        before, self.rows = self.rows, found
        if not exists:
            self.rows = None
            self.create([node])
        while t.take("ON"):
            when = t.next().upper()
            t.expect("SET")
            self.assign(self.rows if (when == "MATCH") == exists else None)
        if before is not None and before.columns != self.rows.columns:
            self.rows = before.join(self.rows.select(*[c for c in self.rows.columns if c not in before.columns]), how="cross")

    def assign(self, rows: DataFrame | None) -> None:
        """SET v.key = value, ...; rows None: read over without effect."""
        changes: dict[str, dict[str, tuple]] = {}
        while True:
            var = self.t.name()
            self.t.expect(".")
            key = self.t.name()
            self.t.expect("=")
            changes.setdefault(var, {})[key] = self.e.sum()
            if not self.t.take(","):
                break
        if rows is None:
            return
        c = Compiler(rows.columns)
        for var, sets in changes.items():
            self.update(var, rows, {k: c.value(e) for k, e in sets.items()})

    def remove(self) -> None:
        while True:
            var = self.t.name()
            self.t.expect(".")
            self.update(var, self.rows, {self.t.name(): F.lit(None)})
            if not self.t.take(","):
                break

    def update(self, var: str, rows: DataFrame, values: dict[str, Column]) -> None:
        """One new value per entity and key: of several rows the greatest."""
        edge = var in self.edge_vars
        key = "eid" if edge else "id"
        if f"{var}__{key}" not in rows.columns:
            raise QueryError(f"{var} is not bound")
        own = rows.select(F.col(f"{var}__{key}").alias(key), *[v.alias(f"_new_{k}") for k, v in values.items()])
        own = own.groupBy(key).agg(*[F.max(f"_new_{k}").alias(f"_new_{k}") for k in values]).withColumn("_hit", F.lit(True))

        def changed(df: DataFrame) -> DataFrame:
            out = df.join(own, key, "left")
            for k in values:
                old = F.col(k) if k in df.columns else F.lit(None)
                new = F.col(f"_new_{k}").cast(df.schema[k].dataType) if k in df.columns else F.col(f"_new_{k}")
                out = out.withColumn(k, F.when(F.col("_hit"), new).otherwise(old))
            return out.drop("_hit", *[f"_new_{k}" for k in values])

        if edge:
            self.graph.edges = changed(self.graph.edges)
        else:
            labels = [self.labels[var]] if self.labels.get(var) else list(self.graph.nodes)
            for label in labels:
                self.graph.nodes[label] = changed(self.graph.nodes[label])

    def delete(self, detach: bool) -> None:
        names = [self.t.name()]
        while self.t.take(","):
            names.append(self.t.name())
        for var in names:
            key = "eid" if var in self.edge_vars else "id"
            gone = self.rows.select(F.col(f"{var}__{key}").alias(key)).distinct()
            if key == "eid":
                self.graph.edges = self.graph.edges.join(gone, "eid", "left_anti")
                continue
            if self.graph.edges is not None:
                ends = self.graph.edges
                for end in ("src", "dst"):
                    ends = ends.join(gone.select(F.col("id").alias(end)), end, "left_anti")
                if not detach and not self.graph.edges.join(ends.select("eid"), "eid", "left_anti").isEmpty():
                    raise QueryError("a node with edges is deleted by DETACH DELETE")
                self.graph.edges = ends
            for label in [self.labels[var]] if self.labels.get(var) else list(self.graph.nodes):
                self.graph.nodes[label] = self.graph.nodes[label].join(gone, "id", "left_anti")
