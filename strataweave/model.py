"""The property-graph and bi-temporal model over DataFrames.

Nodes are typed label views (one DataFrame per label, with an id column); edges have
columns eid, src, dst, label and their properties.  Histories are tables of writes:
id, version_id, vf, tf (valid and transaction time in microseconds), op and the
properties.  Intervals are half-open; OPEN stands for no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN = (1 << 63) - 1
RETRACT, DELETE = "retract", "delete"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since the epoch of a zoneless timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a history of users: an error retracts, all else asserts; recorded up to six minutes late."""
    vf = micros("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("version_id"),
        vf.alias("vf"),
        (vf + (F.col("event_id") % 7) * 60_000_000).alias("tf"),
        F.when(F.col("event_type") == "error", RETRACT).otherwise("update").alias("op"),
        F.col("event_type").alias("kind"),
        "value",
    )


#: Labels' and edge types' tags: node and edge ids are key * TAGS + tag, so no two labels share an id.
TAGS = 8
TAG_OF = {"Customer": 1, "Order": 2, "Part": 3, "Supplier": 4, "Turn": 5, "PLACED": 1, "CONTAINS": 2, "SUPPLIED_BY": 3}


def in_space(key, label: str):
    """The id of a label's key in the one id space of the graph."""
    return (key if not isinstance(key, str) else F.col(key)).cast("long") * TAGS + TAG_OF[label]


def shop_nodes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers, orders, parts and suppliers with ids of one space; their own keys stay properties."""
    own = {"Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey"), "Supplier": ("supplier", "s_suppkey")}
    return {label: table(spark, sf_dir, name).withColumn("id", in_space(key, label)) for label, (name, key) in own.items()}


def placed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        in_space("o_orderkey", "PLACED").alias("eid"),
        in_space("o_custkey", "Customer").alias("src"),
        in_space("o_orderkey", "Order").alias("dst"),
        F.lit("PLACED").alias("label"),
        F.col("o_totalprice").alias("price"),
    )


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        in_space(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "CONTAINS").alias("eid"),
        in_space("l_orderkey", "Order").alias("src"),
        in_space("l_partkey", "Part").alias("dst"),
        F.lit("CONTAINS").alias("label"),
        F.col("l_quantity").alias("quantity"),
    )


def located_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> nation -> region as one edge table over one id space: nations at -1 - key, regions at -1001 - key."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nation = lambda c: (F.lit(-1) - F.col(c)).cast("long")
    region = (F.lit(-1001) - F.col("n_regionkey")).cast("long")
    at = c.select(F.col("c_custkey").alias("eid"), F.col("c_custkey").alias("src"), nation("c_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("label"))
    up = n.select(nation("n_nationkey").alias("eid"), nation("n_nationkey").alias("src"), region.alias("dst"), F.lit("IN_REGION").alias("label"))
    return at.unionByName(up)


def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges between the turns of a conversation; a node is conv_id * 1000 + turn."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), "conv_id", "turn")
    nxt = c.select((F.col("src") - 1).alias("src"), F.col("src").alias("dst"))
    return c.join(nxt, "src").select(F.col("src").alias("eid"), "src", "dst", F.lit("NEXT").alias("label"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> supplier, once per pair that any order line names."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select("l_partkey", "l_suppkey").distinct()
    eid = in_space(F.col("l_partkey") * 10_000_000 + F.col("l_suppkey"), "SUPPLIED_BY")
    return pairs.select(eid.alias("eid"), in_space("l_partkey", "Part").alias("src"), in_space("l_suppkey", "Supplier").alias("dst"), F.lit("SUPPLIED_BY").alias("label"))


def flip(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(flip(edges))


def label_schema(nodes: dict[str, DataFrame]) -> dict[str, list[tuple[str, str]]]:
    """Labels with the keys and types seen, without running a job."""
    return {label: [(f.name, f.dataType.simpleString()) for f in df.schema.fields] for label, df in nodes.items()}


def is_vector(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges to the following vector and CHILD edges to twice the number plus one, where they exist."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    both = F.array(
        F.struct(F.lit(0).alias("k"), (F.col("src") + 1).alias("dst"), F.lit("NEXT").alias("label")),
        F.struct(F.lit(1).alias("k"), (F.col("src") * 2 + 1).alias("dst"), F.lit("CHILD").alias("label")),
    )
    e = ids.select("src", F.inline(both)).join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return e.select((F.col("src") * 2 + F.col("k")).alias("eid"), "src", "dst", "label")


def vector_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as histories of their labels: one version a second, in order of vec_id."""
    at = F.col("vec_id") * 1_000_000
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("id"), F.col("vec_id").alias("version_id"), at.alias("vf"), at.alias("tf"), "embedding"
    )


def document_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document derives from the one of half its number."""
    ids = table(spark, sf_dir, "documents").where("doc_id > 0")
    return ids.select(F.col("doc_id").alias("derived"), F.floor(F.col("doc_id") / 2).alias("source"))


def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("doc_id") * 37 % 101) / 100
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version"), F.when(c <= 1, c).alias("confidence"), "source")


def placed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history of PLACED edges: asserted on their date, recorded an hour later; cancelled a week after if their number ends in 9."""
    vf = micros("o_orderdate")
    hour = 3_600_000_000
    own = table(spark, sf_dir, "orders").select(
        in_space("o_orderkey", "PLACED").alias("id"), in_space("o_custkey", "Customer").alias("src"), in_space("o_orderkey", "Order").alias("dst"), F.lit("PLACED").alias("label"), vf.alias("at"), "o_orderkey"
    )
    made = own.select("id", (F.col("o_orderkey") * 2).alias("version_id"), F.col("at").alias("vf"), (F.col("at") + hour).alias("tf"), F.lit("update").alias("op"), "src", "dst", "label")
    late = F.col("at") + 7 * 24 * hour
    gone = own.where("o_orderkey % 10 = 9").select("id", (F.col("o_orderkey") * 2 + 1).alias("version_id"), late.alias("vf"), (late + hour).alias("tf"), F.lit(RETRACT).alias("op"), "src", "dst", "label")
    return made.unionByName(gone)
