"""Readers and writers of row files, reports, manifests and result folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMAND_SCHEMA = "region_id int, color_index int, stitch_type string, command string, x_mm double, y_mm double"


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, missing_ok: bool = False) -> DataFrame:
    """Header CSV (BOM allowed) as text columns; empty cells are null.  ``missing_ok`` gives an empty table of ``schema``."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False)
    if schema:
        reader = reader.schema(schema)
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema or "value string")
    return reader.csv(path if isinstance(path, str) else list(path))


def _exists(spark: SparkSession, path) -> bool:
    one = path if isinstance(path, str) else path[0]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns, in order of first appearance."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Lines as rows; a line that is no JSON object fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


PRED_METRICS = {
    "round_trip_parse_success": "boolean", "commands": "bigint", "stitch_count": "bigint", "jump_count": "bigint", "trim_count": "bigint",
    "color_change_count": "bigint", "unsupported_command_count": "bigint", "illegal_long_stitch_count": "bigint",
    "high_risk_jump_count": "bigint", "max_stitch_mm": "double", "max_jump_mm": "double", "stitch_path_mm": "double", "jump_path_mm": "double",
    "lock_tack_like_count": "bigint", "off_mask_stitch_length_mm": "double", "off_mask_stitch_count": "bigint",
    "visible_connector_count": "bigint", "visible_connector_length_mm": "double",
}


def scan_eval_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Evaluation documents: metrics of ``pred`` or of the document itself, with sample and method from the path."""
    inner = ", ".join(f"{n}: {t}" for n, t in PRED_METRICS.items())
    flat = ", ".join(f"{n} {t}" for n, t in PRED_METRICS.items())
    docs = spark.read.schema(f"pred struct<{inner}>, {flat}").option("multiLine", True).json(glob)
    path = F.col("_metadata.file_path")
    return docs.select(path.alias("eval_json"), path_part(path, 2).alias("sample_id"), path_part(path, 3).alias("method"),
                       *[F.when(F.col("pred").isNotNull(), F.col(f"pred.{n}")).otherwise(F.col(n)).alias(n) for n in PRED_METRICS])


def path_part(path: Column, from_end: int) -> Column:
    """1 is the file name, 2 its folder, 3 the folder above."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def distinct_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths once each whatever their case, in case-insensitive order."""
    return df.withColumn("_k", F.lower(path)).groupBy("_k").agg(F.min(path).alias(path)).orderBy("_k").drop("_k")


def discover_roots(listing: DataFrame, needed: Sequence[str], output: str, include: str = ".*", exclude: str = "^$") -> DataFrame:
    """Result roots that hold every needed file and at least one output; listing: path of each file."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    is_output = name == output
    root_depth = F.size(parts) - F.when(is_output, 2).otherwise(1)
    rows = listing.select(F.array_join(F.slice(parts, 1, root_depth), "/").alias("root"), name.alias("name"), is_output.alias("is_output"))
    found = rows.groupBy("root").agg(F.count_if("is_output").alias("outputs"), *[F.max(F.col("name") == n).alias(f"has_{i}") for i, n in enumerate(needed)])
    keep = F.col("outputs") > 0
    for i in range(len(needed)):
        keep = keep & F.col(f"has_{i}")
    last = F.element_at(F.split("root", "/"), -1)
    return found.filter(keep & last.rlike(include) & ~last.rlike(exclude)).select("root", "outputs")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and size of the files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def scan_commands_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated command files, one design per file; order is the byte order of the lines."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(COMMAND_SCHEMA).csv(path)
    file = F.col("_metadata.file_path")
    # Line order of a split file: block start, then position inside the block.
    placed = raw.select(F.regexp_replace(path_part(file, 1), "[.][^.]*$", "").alias("design_id"), F.col("_metadata.file_block_start").alias("_b"),
                        F.monotonically_increasing_id().alias("_m"), *[c.split()[0] for c in COMMAND_SCHEMA.split(", ")])
    first = placed.groupBy("design_id", "_b").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("design_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = first.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("design_id", "_b", "_m0", "_off")
    return placed.join(offs, ["design_id", "_b"]).withColumn("seq", F.col("_off") + F.col("_m") - F.col("_m0")).drop("_b", "_m", "_m0", "_off")


def sink_commands_tsv(commands: DataFrame, path: str) -> None:
    """Command rows as tab-separated files, partitioned by design and ordered inside each file."""
    commands.repartitionByRange("design_id", "seq").sortWithinPartitions("design_id", "seq").write.mode("overwrite").option(
        "sep", "\t").option("header", True).partitionBy("design_id").csv(path)


def scan_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """Segment arrays of each file that have both ends."""
    schema = ("segment_id bigint, color_layer bigint, source_order bigint, entry_mm array<double>, exit_mm array<double>, "
              "entry_xy array<double>, exit_xy array<double>, length_mm double, preceding_commands array<string>")
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(path_part(F.col("_metadata.file_path"), 1).alias("file"), *df.columns).filter("entry_xy IS NOT NULL AND exit_xy IS NOT NULL")


def scan_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Sketch lines with their category from the file name; bad lines are dropped."""
    df = spark.read.schema("key_id string, recognized boolean, drawing array<array<array<bigint>>>").option("mode", "DROPMALFORMED").json(path)
    return df.select("*", F.regexp_replace(path_part(F.col("_metadata.file_path"), 1), "[.][^.]*$", "").alias("category"))


def scan_index(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Retrieval index document to one row per item."""
    f = ", ".join(f"{n}: double" for n in features)
    doc = spark.read.schema(f"items array<struct<id: string, source: string, features: struct<{f}>, stats: map<string, double>>>").option("multiLine", True).json(path)
    return doc.select(F.explode("items").alias("i")).select("i.id", "i.source", "i.features.*", "i.stats")


def sink_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def sink_manifest(manifest: DataFrame, path: str, group: str, errors: DataFrame | None = None) -> None:
    """Manifest, counts by group and failed records side by side."""
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    manifest.groupBy(group).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{path}/counts")
    if errors is not None:
        errors.write.mode("overwrite").parquet(f"{path}/errors")


def promote_outputs(selected: DataFrame, artifacts: DataFrame, keys: Sequence[str], path: str | None = None, profile: str = "profile") -> DataFrame:
    """Artifact rows of the selected candidates, optionally written partitioned by profile."""
    out = artifacts.join(selected, list(keys))
    if path:
        out.write.mode("overwrite").partitionBy(profile).parquet(path)
    return out


def first_available(selected: DataFrame, artifacts: DataFrame, key: str, roots: Sequence[str], root: str = "root") -> DataFrame:
    """Artifacts of a sample from the first root of a fixed fallback list that has any."""
    rank = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col(root))
    known = artifacts.join(selected.select(key), key).withColumn("_rank", rank).filter("_rank > 0")
    best = known.groupBy(key).agg(F.min("_rank").alias("_best"))
    return known.join(best, key).filter("_rank = _best").drop("_rank", "_best")
