"""Keyed merges (SNK-02..07) as DataFrame work, and writers.

``merged`` and ``without`` return the rows of a table after a merge or a delete; where they are kept is the table
format's business: with a lakehouse format on the class path its own MERGE is the better choice.  Streams of updates are
kept as they come, a folder a micro-batch (``write_changes``), and read as the newest row of each key (``newest``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """SNK-07: a typed table without rows."""
    return spark.createDataFrame([], schema)


def _matched(target: DataFrame, source: DataFrame, keys: list[str], how: str) -> DataFrame:
    same = reduce(lambda x, y: x & y, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return target.alias("t").join(source.alias("s"), same, how)


def merged(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "upsert", when: Column | None = None) -> DataFrame:
    """The rows of ``target`` after merging ``source`` by ``keys``, nulls equal; both have the columns of ``target``.

    ``mode``: upsert, insert_only, or update_if (matched rows change where ``when``, over t. and s. columns, is true).
    Two source rows of one key are an error.
    """
    if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"several source rows of one key ({', '.join(keys)})")
    names = target.columns
    source = source.select(names)
    if mode == "insert_only":
        return target.unionByName(_matched(source, target, keys, "left_anti"))
    both = _matched(target.withColumn("_t", F.lit(True)), source.withColumn("_s", F.lit(True)), keys, "full_outer")
    allowed = F.lit(True) if mode == "upsert" or when is None else F.col("t._t").isNull() | F.coalesce(when, F.lit(False))
    take = F.col("s._s").isNotNull() & allowed
    return both.select(*(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in names))


def without(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-05: the rows of ``target`` whose keys are not in ``source``."""
    return _matched(target, source.select(*keys), keys, "left_anti")


def write_changes(rows: DataFrame, path: str, batch: int) -> None:
    """The changed rows of a micro-batch, in a folder of its own; a batch that is replayed replaces its folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def newest(spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key among the changes below ``path``, up to batch ``upto``; columns of ``schema``."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    changes = spark.read.schema(T.StructType([*wanted.fields, T.StructField("batch", T.LongType())])).parquet(path)
    changes = changes if upto is None else changes.filter(F.col("batch") <= upto)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return changes.withColumn("_last", last).filter("_last = 1").select(wanted.fieldNames())


def compact(spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], upto: int) -> None:
    """Leaves one folder of the changes below ``path`` up to batch ``upto``: the newest row of each key, under that number.

    ``newest`` gives the same rows before and after, and reads as much as there are keys instead of all that ever changed.
    The folder is made beside and moved into place before older ones go; a run that broke off is finished by the next.
    Only batches that no stream will replay may be compacted, and by one run at a time.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = lambda name: hadoop.Path(f"{path}/{name}")
    fs = at("").getFileSystem(conf)
    versions = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("batch="))
    old = [n for n in versions if n <= upto]
    whole = fs.exists(at(f"_compacted-{upto}/_SUCCESS"))
    if not whole and len(old) > 1:
        rows = newest(spark, path, schema, keys, upto)
        rows.write.mode("overwrite").parquet(f"{path}/_compacted-{upto}")
        whole = True
    if whole:
        fs.delete(at(f"batch={upto}"), True)
        if not fs.rename(at(f"_compacted-{upto}"), at(f"batch={upto}")):
            raise OSError(f"could not move the compacted batch {upto} into place")
        for n in old:
            if n < upto:
                fs.delete(at(f"batch={n}"), True)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-12: a micro-batch's metrics as further JSON lines below ``path``."""
    metrics.write.mode("append").json(path)


def staged_write(df: DataFrame, final: str, check=lambda written: None, partition_by: list[str] | None = None, kind: str = "parquet") -> None:
    """SNK-09/11: write beside, read back, ``check`` (raises), then move into place; an existing target is an error."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, staging = (jvm.org.apache.hadoop.fs.Path(p) for p in (final, f"{final}._staging"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(final)
    header = str(kind == "csv").lower()
    writer = df.write.mode("overwrite").format(kind).option("header", header)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{final}._staging")
    check(spark.read.format(kind).option("header", header).load(f"{final}._staging"))
    if not fs.rename(staging, target):
        raise OSError(f"could not move {staging} into place")


def overwrite_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """SNK-08."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def log_rows(df: DataFrame, key: str, time: str, partitions: int, columns: list[str] | None = None) -> DataFrame:
    """SNK-10, SRT-10: key and value (JSON) as bytes, a key's rows in one partition in order of time."""
    names = columns or df.columns
    return df.repartition(partitions, key).sortWithinPartitions(key, time).select(F.col(key).cast("binary").alias("key"), F.to_json(F.struct(*names), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).cast("binary").alias("value"))
