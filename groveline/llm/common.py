"""What several operators share: words, written intermediates and gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: a word, and what stands between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. A session without one (tests on a local master) gets one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_groveline"
    return folder.rstrip("/")


#: Rows of texts that a Python worker gets at once, fewer than Spark's default of 10,000, for the memory of long texts.
BATCH_ROWS, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs a read and not a new run."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(min(int(before) if int(before) > 0 else ROWS_AT_ONCE, ROWS_AT_ONCE)))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_ROWS, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more, once all that was made from them is written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one task makes from a row that stands for many equal ones.
CHUNK = 50_000


def spread(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its ``count`` says, with ``name`` from 0 up. A great count is dealt to several tasks."""
    if not df.where(F.col(count) > CHUNK).limit(1).count():
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).drop(count)
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK))))
    parts = parts.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], "_part"))
    upto = F.least((F.col("_part") + 1) * CHUNK, F.col(count)) - 1
    return parts.withColumn(name, F.explode(F.sequence(F.col("_part") * CHUNK, upto))).drop(count, "_part")


def numbered(df: DataFrame, group: str, rows: int, name: str = "slot", per_bucket: int = 100_000) -> DataFrame:
    """Adds a number to each row, gapless from 0 in each group, without a task that holds a group.

    Equal rows are counted first and stand together. A group's different rows are dealt into buckets by a hash of all their columns; a bucket's
    first number is the sum of the counts before it. The counts, one row for each group and bucket, are the only thing that
    meets by group. ``rows``: how many there are in all. The numbers follow from the rows' content alone.
    """
    from pyspark.sql import Window

    columns = df.columns
    n = max(1, -(-rows // per_bucket))
    dealt = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int"))
    if n > 1:
        dealt = written(dealt)
    first = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(group, "_bucket").agg(F.sum("_copies").alias("_n")).withColumn("_first", F.coalesce(first, F.lit(0)))
    order = Window.partitionBy(group, "_bucket").orderBy(F.xxhash64(F.lit(1), *columns), *columns)
    within = F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    placed = dealt.withColumn("_within", within).join(counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_first"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    placed = placed.withColumn("_from", F.col("_first") + F.col("_within")).select(*columns, "_copies", "_from")
    return spread(placed, "_copies", "_nth").withColumn(name, (F.col("_from") + F.col("_nth")).cast("long")).drop("_from", "_nth")
