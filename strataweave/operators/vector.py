"""Vector operators: exact k-NN, re-ranking, sparse retrieval, fusion, drift."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import ship

if TYPE_CHECKING:
    import numpy as np

RERANK_K = 10
#: Blocks of a side of the k-nearest join, unless they would hold fewer vectors than KNN_BLOCK or more than KNN_VALUES entries (32 MB).
KNN_SPLIT, KNN_BLOCK, KNN_VALUES = 16, 256, 1 << 22
#: Queries and rows of a tile of its scores: 32 MB at most.
KNN_TILE, KNN_STEP = 1024, 4096


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best rows: a heap per task, then one merge of k rows each."""
    return df.orderBy(*order).limit(k)


def knn(vectors: DataFrame, query: list[float], k: int, metric: str | V.Metric = "cosine", id_col: str = "id", vector_col: str = "embedding", exclude: int | None = None) -> DataFrame:
    """(columns of vectors, score): the k nearest; ties by id.  metric: a name, or a function of two vector columns, higher is nearer."""
    rows = vectors if exclude is None else vectors.where(F.col(id_col) != exclude)
    rows = rows.where(F.col(vector_col).isNotNull())
    scored = rows.withColumn("score", V.similarity(F.col(vector_col), query, metric))
    return top(scored, k, F.desc("score"), F.col(id_col))


def similar_to(vectors: DataFrame, source_id: int, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of a node's own vector, itself left out.  The source is one row, so it is broadcast."""
    source = vectors.where(F.col(id_col) == source_id).select(F.col(vector_col).alias("_query")).limit(1)
    joined = vectors.where((F.col(id_col) != source_id) & F.col(vector_col).isNotNull()).join(F.broadcast(source))
    scored = joined.withColumn("score", V.similarity(F.col(vector_col), F.col("_query"), metric)).drop("_query")
    return top(scored, k, F.desc("score"), F.col(id_col))


def rerank(rows: DataFrame, query: list[float], top_k: int | None = RERANK_K, metric: str = "cosine", threshold: tuple[str, float] | None = None,
           alias: str = "score", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Score rows by similarity; rows without vector or with a score that is not finite go; a dimension that differs is an error."""
    checked = V.same_dimension(F.col(vector_col), F.lit([float(x) for x in query]))
    out = rows.where(F.col(vector_col).isNotNull()).withColumn(alias, V.similarity(checked, query, metric))
    out = out.where(~F.isnan(alias) & (F.abs(alias) < float("inf")))
    if threshold is not None:
        op, limit = threshold
        s = F.col(alias)
        out = out.where({">": s > limit, ">=": s >= limit, "<": s < limit, "<=": s <= limit}[op])
    return out if top_k is None else top(out, top_k, F.desc(alias), F.col(id_col))


def _exactly(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of the pairs of rows of q and v, summed in the order of the entries as SQL does, so that equal vectors tie."""
    import numpy as np

    inner, a, b = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for x, y in zip(q.T, v.T):
        inner += (x - y) * (x - y) if metric == "euclidean" else x * y
        if metric == "cosine":
            a += x * x
            b += y * y
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(inner))
    if metric != "cosine":
        return inner
    n = np.sqrt(a * b)
    return np.where(n > V.TINY, np.clip(inner / np.maximum(n, V.TINY), -1, 1), 0.0)


def _nearest(qid: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows of each query, equal scores by id, none of the query's own id.

    Tiles of a matrix product only screen: what comes within their rounding of the k best is scored exactly.
    """
    import numpy as np

    # of equal vectors only those of the least ids can be among the k best; a query's own rows do not count
    keep = k + int(np.unique(own, return_counts=True)[1].max())
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((own, same))
    first = np.r_[True, np.diff(same[order]) != 0]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    rows = np.sort(order[rank < keep])
    own, v = own[rows], v[rows]

    nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    if metric == "cosine":  # unit vectors, for which single precision will do
        x, y = (np.nan_to_num(e / np.where(n > 0, n, 1)[:, None], nan=0, posinf=0, neginf=0).astype(np.float32) for e, n in ((q, nq), (v, nv)))
        size = np.ones(len(q))
    else:
        x, y = q, v
        far = nq + nv.max()
        size = far * far + far if metric == "euclidean" else nq * nv.max()  # + far: distances that round to one score
    slack = 2 * (q.shape[1] + 8) * np.finfo(x.dtype).eps * size
    small = metric == "cosine" and nq.min() * nv.min() <= V.TINY
    out = []
    for a in range(0, len(q), KNN_TILE):
        part = slice(a, a + KNN_TILE)
        least = np.full(len(x[part]), -np.inf, x.dtype)
        r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, x.dtype)
        for b in range(0, len(v), KNN_STEP):
            tile = x[part] @ y[b : b + KNN_STEP].T
            if metric == "euclidean":
                tile = 2 * tile - (nq[part] ** 2)[:, None] - (nv[b : b + KNN_STEP] ** 2)[None, :]
            elif small:
                tile[nq[part][:, None] * nv[None, b : b + KNN_STEP] <= V.TINY] = 0
            if metric != "cosine":
                np.nan_to_num(tile, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            if b == 0 and tile.shape[1] > keep:
                least = (np.partition(tile, -keep, axis=1)[:, -keep] - 2 * slack[part]).astype(x.dtype)
            more_r, more_c = np.divmod(np.flatnonzero(tile >= least[:, None]), tile.shape[1])
            r, c, s = np.r_[r, more_r], np.r_[c, more_c + b], np.r_[s, tile[more_r, more_c]]
            order = np.lexsort((-s, r))
            r, c, s = r[order], c[order], s[order]
            at = np.searchsorted(r, np.arange(len(least))) + keep - 1
            full = np.flatnonzero(at < np.searchsorted(r, np.arange(len(least)), "right"))
            least[full] = np.maximum(least[full], s[at[full]] - 2 * slack[part][full])
            near = s >= least[r]
            r, c, s = r[near], c[near], s[near]
        r = r + a
        other = qid[r] != own[c]
        r, c = r[other], c[other]
        s = _exactly(q[r], v[c], metric)
        order = np.lexsort((own[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        best = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (s > -np.inf)
        out.append((r[best], rows[c[best]], s[best]))
    r, c, s = (np.concatenate(p) for p in zip(*out))
    return r, c, s


def _blocks(n: int, dimension: int | None) -> int:
    """Blocks of n vectors in the k-nearest join."""
    return max(1, min(KNN_SPLIT, n // KNN_BLOCK), -(-n * (dimension or 0) // KNN_VALUES))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", blocks: int = 0) -> DataFrame:
    """(qid, id, score, rank): the k nearest of every stated query, exactly.

    Both sides are dealt to blocks by hash, and every pair of blocks is one group: a matrix product, tile
    by tile, that keeps its k best rows a query.  Nothing is gathered on the driver; what is shuffled is
    each side once per block of the other, and k rows a query and block.  The blocks are at most KNN_SPLIT
    a side, so this grows with the input, until a block would exceed KNN_VALUES entries; with 64 of them a
    vector, up to a million vectors a side.  Above that it grows with the pairs, by two copies of a vector
    for 65,536 pairs.  The products grow with the pairs at any size.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ship(queries.sparkSession)
    asked = queries.where("embedding is not null").select("qid", "embedding")
    rows = vectors.where("embedding is not null").select("id", "embedding")
    across, down = (_blocks(*side.agg(F.count("*"), F.max(F.size("embedding"))).first()) for side in (asked, rows))
    across = max(blocks, across)
    # cogroup hashes its keys as they are: an int and a long of one value would not meet
    x_block, y_block = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("qid", across), ("id", down)))
    x = asked.withColumn("x", x_block).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    y = rows.withColumn("y", y_block).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def stacked(column: pa.ChunkedArray) -> np.ndarray:
        sizes = np.asarray(pc.list_value_length(column))
        if (sizes != sizes[0]).any():
            raise ValueError("vector dimensions differ")
        flat = np.asarray(pc.list_flatten(column), np.float64)
        return flat.reshape(len(sizes), -1) if flat.size else np.zeros((len(sizes), 1))

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return pa.table({"qid": pa.array([], "int64"), "id": pa.array([], "int64"), "score": pa.array([], "float64")})
        qid, own = asked["qid"].to_numpy(), rows["id"].to_numpy()
        r, c, s = _nearest(qid, stacked(asked["embedding"]), own, stacked(rows["embedding"]), k, metric)
        return pa.table({"qid": qid[r], "id": own[c], "score": s})

    cells = x.groupBy("x", "y").cogroup(y.groupBy("x", "y"))
    parts = cells.applyInArrow(best, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# sparse retrieval over long tables: id, term, tf


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z0-9]+")).alias("term")
    return docs.select(F.col(id_col).alias("id"), words).where("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))


def _tokens(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z0-9]+"), "")


def _query_counts(docs: DataFrame, query: dict[str, float], id_col: str, text_col: str) -> DataFrame:
    """(id, text, tf): the counts of the query's terms, in its order.  A document is one row; only its hits are ever split."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    whole = [F.regexp_count(low, F.lit(f"(?<![a-z0-9]){re.escape(q)}(?![a-z0-9])")) for q in query]
    count = [F.when(low.contains(q), n).otherwise(0) for q, n in zip(query, whole)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array(*count).alias("tf"))


def text_bm25(docs: DataFrame, query: dict[str, float], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25 straight from documents: column expressions over one row each, and one aggregate for the statistics."""
    rows = _query_counts(docs, query, id_col, text_col).select("id", "tf", F.size(F.array_distinct(_tokens("text"))).alias("dl"))
    held = [F.count(F.when(F.get("tf", F.lit(k)) > 0, 1)) for k in range(len(query))]
    any_word = F.col("dl") > 0
    stats = rows.where(any_word).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*held).alias("df"))  # one row
    j = rows.where(F.array_max("tf") > 0).join(F.broadcast(stats))
    parts = []
    for k, weight in enumerate(query.values()):
        df, tf = F.get("df", F.lit(k)), F.get("tf", F.lit(k))
        idf = F.greatest(F.lit(0.0), F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1))
        parts.append(idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))) * weight)
    return j.select("id", sum(parts).alias("score"))


def text_dot(docs: DataFrame, query: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = _query_counts(docs, query, id_col, text_col).where(F.array_max("tf") > 0)
    return rows.select("id", _tokens("text").alias("tokens"), sum(F.get("tf", F.lit(k)) * w for k, w in enumerate(query.values())).alias("score"))


def text_cosine(docs: DataFrame, query: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cosine of term counts.  The squared norm is the sum of squared runs of the sorted tokens."""
    norm = sum(x * x for x in query.values()) ** 0.5
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("last"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))

    size = F.aggregate(F.array_sort("tokens"), start, step, lambda acc: F.sqrt(acc["total"]))
    return text_dot(docs, query, id_col, text_col).select("id", (F.col("score") / (size * norm)).alias("score"))


def bm25(terms: DataFrame, query: dict[str, float], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the entries with any query term; a document's length is its number of distinct terms.

    One pass gives both the lengths and the query's few terms, which alone are joined.
    """
    spark = terms.sparkSession
    q = spark.createDataFrame(list(query.items()), "term string, weight double")
    lengths = terms.groupBy("id").agg(F.count("*").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = terms.join(F.broadcast(q), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(stats))  # df: a row per query term; stats: one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("id").agg(F.sum(idf * tf * F.col("weight")).alias("score"))


def sparse_dot(terms: DataFrame, query: dict[str, float]) -> DataFrame:
    q = terms.sparkSession.createDataFrame(list(query.items()), "term string, weight double")
    return terms.join(F.broadcast(q), "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))


def sparse_cosine(terms: DataFrame, query: dict[str, float]) -> DataFrame:
    norm = sum(x * x for x in query.values()) ** 0.5
    size = terms.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return sparse_dot(terms, query).join(size, "id").select("id", (F.col("score") / (F.col("norm") * norm)).alias("score"))


# fusion of ranked lists: id, score


def _scaled(scores: DataFrame, name: str) -> DataFrame:
    lows = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    value = F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(1.0)
    return scores.join(F.broadcast(lows)).select("id", value.alias(name))  # one row


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse of min-max scaled scores; an id missing from a list scores 0 there."""
    j = _scaled(dense, "d").join(_scaled(sparse, "s"), "id", "full")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return j.select("id", score.alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k0: int = 60) -> DataFrame:
    """Sum of 1 / (k0 + rank).  The lists are short results of top-k searches."""
    ranked = [r.select("id", (1.0 / (k0 + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("part")) for r in lists]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.union(r)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def provenance_fusion(rows: DataFrame, now: int, k: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), half_life: float = 30 * 86_400e6, ahead: bool = False) -> DataFrame:
    """rows: id, score (cosine), confidence, recorded.  Weighted mean of similarity, confidence and freshness; 0.5 where one is missing.

    Every row is fused: a far one may win by its confidence and freshness.  What was recorded after now is as
    fresh as now, or with ahead fresher, by the same curve."""
    ws, wc, wr = weights
    age = (F.lit(now) - F.col("recorded")).cast("double")
    age = age if ahead else F.greatest(F.lit(0.0), age)
    fresh = F.coalesce(F.exp(-0.6931471805599453 * age / half_life), F.lit(0.5))
    fused = (ws * F.col("score") + wc * F.coalesce("confidence", F.lit(0.5)) + wr * fresh) / (ws + wc + wr)
    return top(rows.withColumn("fused", fused), k, F.desc("fused"), F.col("id"))


# drift of vectors over versions: id, version_id, vf, embedding


def track_drift(versions: DataFrame, reference: Column | list[float]) -> DataFrame:
    return versions.withColumn("similarity", V.cosine(F.col("embedding"), reference))


def consecutive_drift(versions: DataFrame, metric: str = "cosine") -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("id").orderBy("vf", "version_id"))
    rows = versions.withColumn("before", before).where("before is not null")
    return rows.withColumn("drift", V.drift(F.col("before"), F.col("embedding"), metric)).drop("before")


def find_drift(versions: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """(id, drift): entities whose largest step reaches the threshold and is above 0."""
    most = consecutive_drift(versions, metric).groupBy("id").agg(F.max("drift").alias("drift"))
    return most.where((F.col("drift") >= threshold) & (F.col("drift") > 0))


def evolution(versions: DataFrame, start: int, end: int) -> DataFrame:
    """Vectors recorded in the inclusive range."""
    return versions.where(F.col("vf").between(start, end))


def traverse_and_rank(anchors: DataFrame, edges: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k targets one hop out of the anchors that are nearest to query; targets of another dimension are passed over."""
    targets = anchors.join(edges, F.col("anchor") == F.col("src")).select(F.col("dst").alias("id")).distinct()
    near = vectors.join(targets, "id").where(F.size("embedding") == len(query))
    return knn(near, query, k)


def traverse_and_rank_at(anchors: DataFrame, edge_writes: DataFrame, vector_writes: DataFrame, query: list[float], k: int, valid: int, tx: int) -> DataFrame:
    """traverse_and_rank over the edges and vectors believed at (valid, tx)."""
    from .temporal import adjacent_at, as_of

    edges = adjacent_at(edge_writes, anchors.select(F.col("anchor").alias("id")), valid, tx)
    return traverse_and_rank(anchors, edges.select("src", "dst"), as_of(vector_writes, valid, tx), query, k)


def knn_between(versions: DataFrame, query: list[float], k: int, start: int, end: int, metric: str = "cosine") -> DataFrame:
    """(id, version_id, score): the k entities whose nearest version valid in [start, end) is nearest; one version each."""
    seen = versions.where((F.col("vf") >= start) & (F.col("vf") < end) & F.col("embedding").isNotNull())
    scored = seen.select("id", "version_id", V.similarity(F.col("embedding"), query, metric).alias("score"))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("version_id")).alias("v"))).alias("b"))
    return top(best.select("id", (-F.col("b.v")).alias("version_id"), F.col("b.score").alias("score")), k, F.desc("score"), F.col("id"))


def sparse_distance(terms: DataFrame, query: dict[str, float]) -> DataFrame:
    """(id, distance): Euclidean distance of each sparse vector (id, term, tf) from the query.

    The squared distance is |x|^2 + |q|^2 - 2 x.q, all three by one aggregate.
    """
    weight = F.create_map(*[F.lit(x) for item in query.items() for x in item])
    inner = F.sum(F.col("tf") * F.coalesce(weight[F.col("term")], F.lit(0.0)))
    own = F.sum(F.col("tf") * F.col("tf"))
    squared = own + sum(w * w for w in query.values()) - 2 * inner
    return terms.groupBy("id").agg(F.sqrt(F.greatest(F.lit(0.0), squared)).alias("distance"))
