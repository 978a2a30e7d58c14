"""The fluent query builder: starts, traversals, ranking, filters, time, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import predicates as P
from .lang.core import Graph, QueryError
from .operators import graph as G
from .operators import vector as VO
from .scratch import cut


class Query:
    """Each step returns a new query; build() gives the DataFrame of entities."""

    def __init__(self, graph: Graph, rows: DataFrame | None = None, order: tuple = (), skip: int = 0, limit: int | None = None, space: tuple[str, ...] = ()):
        self._graph, self._rows, self._order, self._skip, self._limit, self._space = graph, rows, order, skip, limit, space

    def _with(self, rows: DataFrame | None = None, **changes) -> Query:
        own = {"order": self._order, "skip": self._skip, "limit": self._limit, "space": self._space} | changes
        return Query(own.pop("graph", self._graph), self._rows if rows is None else rows, **own)

    def _need(self) -> DataFrame:
        if self._rows is None:
            raise QueryError("a query starts with start, scan or find_similar")
        return self._rows

    def _scoped(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("namespace").isin(*self._space)) if self._space else rows

    def namespaces(self, *names: str) -> Query:
        return self._with(space=names)

    def as_of(self, valid: int, tx: int = (1 << 63) - 1) -> Query:
        return self._with(graph=self._graph.at(valid, tx))

    def valid_time_between(self, start: int, end: int) -> Query:
        return self._with(graph=self._graph.overlapping(start, end))

    def start(self, *ids: int) -> Query:
        return self._with(self._scoped(self._graph.scan(None)).where(F.col("id").isin(*ids)))

    def scan(self, label: str | None = None) -> Query:
        return self._with(self._scoped(self._graph.scan(label)))

    def find_by_property(self, label: str, key: str, value) -> Query:
        return self.scan(label).filter(key, "=", value)

    def find_similar(self, vector: list[float], k: int, metric: str = "cosine") -> Query:
        rows = self._scoped(self._graph.scan(None))
        return self._with(VO.knn(rows, vector, k, metric, vector_col=self._graph.vector))

    def similar_to(self, node_id: int, k: int, label: str | None = None) -> Query:
        return self._with(VO.similar_to(self._scoped(self._graph.scan(label)), node_id, k, vector_col=self._graph.vector))

    def _traverse(self, direction: str, label: str | None, low: int, high: int | None) -> Query:
        anchors = self._need().select(F.col("id").alias("anchor"))
        reach = G.traverse(anchors, self._graph.edges, direction, low, high, label).select("id").distinct()
        return self._with(self._scoped(self._graph.scan(None)).join(reach, "id"))

    def traverse_out(self, label: str | None = None, depth: int = 1, min_depth: int | None = None) -> Query:
        return self._traverse("out", label, min_depth or depth, depth)

    def traverse_in(self, label: str | None = None, depth: int = 1, min_depth: int | None = None) -> Query:
        return self._traverse("in", label, min_depth or depth, depth)

    def traverse_both(self, label: str | None = None, depth: int = 1, min_depth: int | None = None) -> Query:
        return self._traverse("both", label, min_depth or depth, depth)

    def filter(self, key: str, op: str, value) -> Query:
        return self._with(self._need().where(P.compare("R1", op, F.col(key), value)))

    def with_label(self, label: str) -> Query:
        return self._with(self._need().where(F.col("label") == label))

    def rank_by_similarity(self, vector: list[float], top_k: int | None = VO.RERANK_K, metric: str = "cosine", threshold: tuple[str, float] | None = None) -> Query:
        return self._with(VO.rerank(self._need(), vector, top_k, metric, threshold, vector_col=self._graph.vector))

    def sort(self, key: str, descending: bool = False) -> Query:
        return self._with(order=(*self._order, (key, descending)))

    def skip(self, n: int) -> Query:
        return self._with(skip=n)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def count(self) -> DataFrame:
        return self._need().agg(F.count("*").alias("count"))

    def build(self, max_rows: int | None = None) -> DataFrame:
        """max_rows: fail when there are more, rather than return part of them."""
        rows = self._need()
        rows = G.order_by(rows, *self._order) if self._order else rows
        rows = G.page(rows, self._skip, self._limit)
        if max_rows is not None:
            rows = cut(rows.limit(max_rows + 1))  # evaluated once; what is returned is what was counted
            if rows.count() > max_rows:
                raise QueryError(f"more than {max_rows} rows")
        return rows
