"""What the operators share: reading tables, document keys, tables in the shared folder, positions in large groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
#: Stands for a null doc_id inside the operators; it sorts last.
NO_ID = 2**63 - 1
#: Rows that one cell of an ordered group holds on average.
CELL_ROWS = 4096
#: Whether a finished statement's shuffle files go at once, or when the driver comes to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_key_of(doc_id: Column) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def doc_key() -> Column:
    return doc_key_of(F.col("doc_id"))


def doc_id_of(key: Column) -> Column:
    """The id that `doc_key` stood for."""
    return F.when(key != NO_ID, key)


def doc_id(key: str) -> Column:
    return doc_id_of(F.col(key))


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row, also where it stands inside another lambda function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of `df` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder of spark.checkpoint.dir, so that lineage is cut and a lost executor costs no earlier stage."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The table written and read again. The shuffles that made it are removed once it is there."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def one_of_each(df: DataFrame, identity: dict[str, Column], stay: DataFrame) -> DataFrame:
    """The rows of `df` whose identity is in `stay` (the identity's columns, once each, and `rows`, how many rows have it), each once: where several rows
    have one identity, one of them."""
    names = {k: fresh(df, f"_{k}") for k in (*identity, "rows")}
    stay = stay.select(*(F.col(k).alias(n) for k, n in names.items()))
    keyed = df.withColumns({names[k]: c for k, c in identity.items()})
    keys = [names[k] for k in identity]
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = keyed.join(stay.filter(F.col(names["rows"]) == 1), keys, "left_semi").select(*columns)
    several = keyed.join(stay.filter(F.col(names["rows"]) > 1), keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*columns)).alias("r"))
    return alone.unionByName(several.select("r.*"))


def cell_bits(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Bits of a hash that cut so many rows into cells of about `cell_rows`."""
    return max(1, (rows // cell_rows).bit_length())


def cell_of(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def positions(df: DataFrame, keys: list[str], hashed: str, ties: list[str], bits: int, weight: Column | None = None, out: str = "position") -> DataFrame:
    """Adds the sum of `weight` (default: 1) of the rows before, within `keys`, in order of the hash and `ties`.

    The hash's first bits cut a group into cells: one total per cell is summed over the cells, then rows are ordered inside their cell only, so no
    task holds a whole group. `df` should be cheap to read twice; `keys` hold no nulls."""
    weight = F.lit(1).cast("long") if weight is None else weight
    rows = df.withColumn("_cell", cell_of(F.col(hashed), bits)).withColumn("_w", weight)
    over = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = (rows.groupBy(*keys, "_cell").agg(F.sum("_w").alias("_all"))
              .withColumn("_before", F.coalesce(F.sum("_all").over(over.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
              .drop("_all"))
    inner = Window.partitionBy(*keys, "_cell").orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_inner", F.coalesce(F.sum("_w").over(inner), F.lit(0).cast("long"))).join(before, [*keys, "_cell"])
            .withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_cell", "_w", "_before", "_inner"))
