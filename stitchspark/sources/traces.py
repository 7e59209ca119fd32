"""Route traces: documents to task, node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_part

NODE = "node_id: bigint, point_count: bigint, length_mm: double, start_mm: array<double>, end_mm: array<double>, bbox_px: array<double>"
EDGE = "step: bigint, from_node: bigint, to_node: bigint, reverse: boolean, cost: double, distance_mm: double"
SCHEMA = (f"tasks array<struct<task_index: bigint, type_id: bigint, area_px: double, order_score: double, "
          f"graph: struct<nodes: array<struct<{NODE}>>, selected_edges: array<struct<{EDGE}>>>>>")


def scan_route_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Task, node and edge rows; the sample is the folder name without its trace prefix."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    sample = F.regexp_replace(path_part(F.col("_metadata.file_path"), 2), "^(m2_)?trace_", "")
    return trace_tables(docs.select(sample.alias("sample_id"), "tasks"))


def trace_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    tasks = docs.select("sample_id", F.explode("tasks").alias("t")).filter("t.graph IS NOT NULL")
    key = ["sample_id", F.col("t.task_index").alias("task_index")]
    nodes = tasks.select(*key, F.explode("t.graph.nodes").alias("n")).select("sample_id", "task_index", "n.*")
    edges = tasks.select(*key, F.explode("t.graph.selected_edges").alias("e")).select("sample_id", "task_index", "e.*")
    head = tasks.select(*key, "t.type_id", "t.area_px", "t.order_score", F.size("t.graph.nodes").alias("node_count"))
    return head, nodes, edges


def trace_summary(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks, nodes, single-node tasks and decisions of each sample."""
    d = edges.filter("from_node <> -1").groupBy("sample_id").agg(F.count(F.lit(1)).alias("decisions"))
    t = tasks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum("node_count").alias("nodes"),
                                       F.count_if(F.col("node_count") <= 1).alias("skipped_single_node_tasks"))
    return t.join(d, "sample_id", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))
