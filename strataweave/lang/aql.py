"""AQL: temporal clause, MATCH or SIMILAR TO, filters, ranking, and the terminal WINDOW and ALIGN clauses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import temporal as TP
from ..operators import vector as VO
from .core import Compiler, Expressions, Graph, NodePattern, Patterns, QueryError, Tokens, guard_read_only, has_aggregate, label_of, match_chains

METRICS = {"COSINE": "cosine", "EUCLIDEAN": "euclidean", "DOT_PRODUCT": "dot"}
UNITS = {u + s: u.lower() for u in ("MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR") for s in ("", "S")}
DEFAULT_K = 10


def instant(value) -> int:
    """Microseconds of an integer or an ISO time; a time without zone is UTC."""
    if isinstance(value, int):
        return value
    try:
        t = dt.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        raise QueryError(f"not a time: {value!r}") from None
    if t.tzinfo is not None:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def run_aql(spark: SparkSession, graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    guard_read_only(text)
    return _Run(spark, graph, text, params or {}).run()


class _Run:
    def __init__(self, spark: SparkSession, graph: Graph, text: str, params: dict):
        self.spark, self.graph, self.t = spark, graph, Tokens(text)
        self.e = Expressions(self.t, params)
        self.p = Patterns(self.e)
        self.params = params

    def stamp(self) -> int:
        return instant(self.e.atom()[1])

    def run(self) -> DataFrame:
        t = self.t
        if t.take("AS", "OF"):
            v = self.stamp()
            self.graph = self.graph.at(v, self.stamp() if t.take(",") else TP.OPEN)
        elif t.take("BETWEEN"):
            a = self.stamp()
            t.expect("AND")
            self.graph = self.graph.overlapping(a, self.stamp())
        if t.take("IN", "NAMESPACE") or t.take("USE", "NAMESPACE"):
            space = self.e.atom()[1] if t.kind() == "string" else t.name()
            inside = lambda df: df.where(F.col("namespace") == space) if df is not None and "namespace" in df.columns else df
            # labels without the column are in no namespace; edges without it are bound by their ends
            scoped = {k: inside(df) if "namespace" in df.columns else df.limit(0) for k, df in self.graph.nodes.items()}
            self.graph = Graph(scoped, inside(self.graph.edges), self.graph.histories, self.graph.edge_history, self.graph.vector)
        if t.take("MATCH"):
            chains = self.p.chains()
            if t.is_word("WINDOW"):
                return self.window(chains)
            if t.is_word("ALIGN"):
                return self.align(chains)
            rows = match_chains(self.graph, chains)
            subject = chains[0][-1].var
        else:
            rows, subject = self.vector_start()
        return self.tail(rows, subject)

    def vector(self) -> list[float]:
        e = self.e.atom()
        if not isinstance(e[1], list):
            raise QueryError("a vector is a list of numbers or a parameter")
        return [float(x) for x in e[1]]

    def vector_start(self) -> tuple[DataFrame, str]:
        t = self.t
        v = self.graph.vector
        if t.take("FIND", "SIMILAR", "TO"):
            t.expect("(")
            source = self.e.parse()
            t.expect(")")
            k = t.integer() if t.take("LIMIT") else DEFAULT_K
            rows = VO.similar_to(self.with_vectors(), source[1] if source[0] == "lit" else self.params[source[1]], k, vector_col=v)
        elif t.take("SIMILAR", "TO"):
            q = self.vector()
            metric = METRICS[t.name().upper()] if t.take("USING") else "cosine"
            k = t.integer() if t.take("LIMIT") else DEFAULT_K
            rows = VO.knn(self.with_vectors(), q, k, metric, vector_col=v)
        else:
            raise QueryError("a query starts with MATCH or SIMILAR TO")
        return rows.select(*[F.col(c).alias(f"n__{c}") if c != "score" else F.col(c) for c in rows.columns]), "n"

    def with_vectors(self) -> DataFrame:
        v = self.graph.vector
        own = {k: df for k, df in self.graph.nodes.items() if v in df.columns}
        return Graph(own).scan(None)

    def tail(self, rows: DataFrame, subject: str) -> DataFrame:
        t = self.t
        items, distinct, order, skip, limit = None, False, [], 0, None
        while t.kind() != "end":
            if t.take("WHERE"):
                rows = rows.where(Compiler(rows.columns).test(self.e.parse()))
            elif t.take("RANK", "BY", "SIMILARITY", "TO"):
                q = self.vector()
                metric = METRICS[t.name().upper()] if t.take("USING") else "cosine"
                threshold = None
                if t.take("THRESHOLD"):
                    op = t.next() if t.peek() in (">", ">=", "<", "<=") else ">="
                    threshold = (op, float(self.e.atom()[1]))
                k = t.integer() if t.take("TOP") else DEFAULT_K
                alias = t.name() if t.take("AS") else "score"
                rows = VO.rerank(rows, q, k, metric, threshold, alias, f"{subject}__id", f"{subject}__{self.graph.vector}")
            elif t.take("RETURN"):
                distinct = t.take("DISTINCT")
                items = [self.item()]
                while t.take(","):
                    items.append(self.item())
            elif t.take("ORDER", "BY"):
                while True:
                    e = self.e.parse()
                    down = t.take("DESC")
                    if not down:
                        t.take("ASC")
                    order.append((e, down))
                    if not t.take(","):
                        break
            elif t.take("SKIP"):
                skip = t.integer()
            elif t.take("LIMIT"):
                limit = t.integer()
            else:
                raise QueryError(f"unexpected {t.peek()!r}")
        c = Compiler(rows.columns)
        if items and any(has_aggregate(e) for e, _ in items):
            keys = {n: c.value(e) for e, n in items if not has_aggregate(e)}
            aggs = [c.aggregate(e).alias(n) for e, n in items if has_aggregate(e)]
            out = rows.withColumns({f"_k_{n}": v for n, v in keys.items()})
            out = out.groupBy(*[f"_k_{n}" for n in keys]).agg(*aggs) if keys else out.agg(*aggs)
            out = out.withColumnsRenamed({f"_k_{n}": n for n in keys}).select(*[n for _, n in items])
            return G.page(self.sorted(out, order), skip, limit)
        if distinct and f"{subject}__id" in rows.columns:
            # distinct rows of entities are told apart by id, whatever is returned
            bound = sorted({f"{e[1]}__id" for e, _ in items if e[0] in ("var", "prop")} & set(rows.columns)) or [f"{subject}__id"]
            rows = rows.dropDuplicates(bound)
        rows = G.page(self.sorted(rows, order), skip, limit)
        c = Compiler(rows.columns)
        if items is None:
            return rows
        score = ["score"] if "score" in rows.columns and "score" not in [n for _, n in items] else []
        return rows.select(*[c.value(e).alias(n) for e, n in items], *score)

    def sorted(self, rows: DataFrame, order: list) -> DataFrame:
        if not order:
            return rows
        c = Compiler(rows.columns)
        keys = [(F.col(label_of(e)) if label_of(e) in rows.columns else c.value(e), down) for e, down in order]
        return rows.orderBy(*[k.desc_nulls_first() if down else k.asc_nulls_last() for k, down in keys])

    def item(self) -> tuple[tuple, str]:
        e = self.e.parse()
        return e, self.t.name() if self.t.take("AS") else label_of(e)

    def history_of(self, n: NodePattern) -> DataFrame:
        if n.label not in self.graph.histories:
            raise QueryError(f"{n.label} has no history")
        rows = self.graph.histories[n.label]
        for key, value in n.props.items():
            wanted = rows.where(Compiler([f"x__{c}" for c in rows.columns]).value(("lit", True)) & (F.col(key) == value)).select("id").distinct()
            rows = rows.join(wanted, "id", "left_semi")
        return rows

    def range(self) -> tuple[int, int, int]:
        t = self.t
        t.expect("OVER", "VALID_TIME", "FROM")
        a = self.stamp()
        t.expect("TO")
        b = self.stamp()
        return a, b, self.stamp() if t.take("AS", "OF", "SYSTEM_TIME") else TP.OPEN

    def window(self, chains: list[list]) -> DataFrame:
        t = self.t
        t.expect("WINDOW")
        count, unit = t.integer(), UNITS.get(t.name().upper())
        if unit is None:
            raise QueryError("not a window unit")
        a, b, tx = self.range()
        t.expect("RETURN")
        wanted = []
        while True:
            func = t.name().upper()
            t.expect("(")
            arg = "*" if t.take("*") else self.e.sum()
            t.expect(")")
            column = arg[2] if isinstance(arg, tuple) and arg[0] == "prop" else None
            name = t.name() if t.take("AS") else func.lower() + (f"_{column}" if column else "")
            wanted.append((func, column, name))
            if not t.take(","):
                break
        writes = self.history_of(chains[0][0])
        out = None
        for column in dict.fromkeys(c or next((x for _, x, _ in wanted if x), None) or "version_id" for _, c, _ in wanted):
            part = TP.window_aggregate(writes, a, b, count, unit, column, tx)
            pick = {
                "COUNT": lambda c: "samples" if c else "entities", "SUM": lambda c: "total", "AVG": lambda c: "average",
                "MIN": lambda c: "low", "MAX": lambda c: "high", "CHANGES": lambda c: "value_changes" if c else "changes",
            }
            own = [F.col(pick[f](c)).alias(n) for f, c, n in wanted if (c or column) == column and (c is not None or out is None)]
            part = part.select("window_start", "window_end", *own)
            out = part if out is None else out.join(part, ["window_start", "window_end"])
        stamps = {c: TP.rfc3339(F.col(c)) for c in ("window_start", "window_end")}
        return out.orderBy("window_start").withColumns(stamps)

    def align(self, chains: list[list]) -> DataFrame:
        """Participants are the pattern's nodes; linked ones share the key of the first, others have a key of their own kind."""
        t = self.t
        t.expect("ALIGN")
        overlap = t.take("OVERLAP")
        driver = None
        if not overlap:
            t.expect("EVENTS", "DRIVER")
            driver = t.name()
        a, b, tx = self.range()
        t.expect("RETURN")
        items = [self.item()]
        while t.take(","):
            items.append(self.item())
        column = {e[1]: (e[2], n) for e, n in items if e[0] == "prop"}
        nodes = {x.var: x for c in chains for x in c if isinstance(x, NodePattern)}
        joined = match_chains(self.graph, chains)
        key = f"{next(iter(nodes))}__id"
        parts = {}
        for var, node in nodes.items():
            if var not in column and var != driver:
                continue
            prop, name = column.get(var, (None, None))
            ids = joined.select(F.col(key).alias("key"), F.col(f"{var}__id").alias("id")).distinct()
            value = F.col(prop) if prop else F.lit(None).cast("double")
            writes = self.history_of(node).join(ids, "id").select("key", "vf", "tf", "version_id", "op", value.alias("value"))
            parts[var] = (name or var, writes)
        if overlap:
            return TP.align_overlap({n: w for n, w in parts.values()}, a, b, tx).withColumns({c: TP.rfc3339(F.col(c)) for c in ("overlap_from", "overlap_to")})
        name, own = parts.pop(driver)
        out = TP.align_events(own, {n: w for n, w in parts.values()}, a, b, tx).withColumnRenamed("driver_value", name)
        return out.withColumn("at", TP.rfc3339(F.col("at"))).withColumnRenamed("at", "align_valid_time")
