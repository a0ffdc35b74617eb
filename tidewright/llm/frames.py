"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .bytewords import mix


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, so that later steps survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read again: later steps read only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, rows: int, per_part: int = 100_000) -> DataFrame:
    """``df`` of about ``rows`` rows in no more partitions than they fill; small steps then write few files."""
    return df.coalesce(max(1, -(-rows // per_part)))


def small_side(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df`` (a few short columns, cheap to make again) with a broadcast hint if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def looked_up(rows: DataFrame, column: str, facts: DataFrame, weight: str, spread: str, how: str = "inner", most: int = 20_000, least: int = 1000) -> DataFrame:
    """``rows`` joined to ``facts`` (one row for each ``column``; ``weight``: how many rows have it), wherever rows crowd.

    Keys of more than ``least`` rows and of more than their share in ``most`` are broadcast, which are ``most`` keys at most;
    their rows then go by ``spread``.  The others are joined by key, in groups that are no larger than that.  ``column``
    is text or bytes without nulls.
    """
    own = [c for c in facts.columns if c != column]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(least, total // most)
    kind = rows.schema[column].dataType
    first = rows.join(F.broadcast(facts.filter(hot).select(column, F.struct(*own).alias("_hot"))), column, "left")
    apart = F.concat(F.lit("row of a frequent key "), F.xxhash64(spread).cast("string")).cast(kind)
    first = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(column)).otherwise(apart))
    both = first.join(facts.filter(~hot).select(F.col(column).alias("_key"), F.struct(*own).alias("_rare")), "_key", "left")
    both = both.withColumn("_fact", F.coalesce("_hot", "_rare"))
    found = both if how == "left" else both.filter("_fact is not null")
    return found.select(*rows.columns, *(F.col(f"_fact.{c}").alias(c) for c in own))


#: The largest bitmap of ``maybe_in``, in bits.
MOST_BITS = 1 << 30


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int | None = None, most_bits: int = MOST_BITS, then: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """The rows of ``df`` whose long ``column`` may be in ``keys`` (one long column): a filter without a shuffle of ``df``.

    The filter is one bit a key in a broadcast bitmap of 16 times as many bits as keys; it never loses a row, and a join
    must follow where exactness matters.  Keys too many for ``most_bits`` (128 MB) are joined instead.  Keys go by pieces
    of PIECE bits: a task sends their places on as they come, and each piece is built once, in its group.  ``then`` (a
    function of a batch, ``schema``: what it gives) goes on with the rows in the same worker, as ``map_arrow`` would in one more.
    """
    if bits is None:
        bits = 1 << max(20, (16 * keys.count() - 1).bit_length())
    if bits > most_bits:
        joined = df.join(keys.withColumnRenamed(keys.columns[0], column).distinct(), column, "left_semi").select(df.columns)
        return map_arrow(joined, then, schema) if then else joined
    bitmap = np.zeros(bits >> 3, np.uint8)
    places = keys.mapInArrow(lambda batches: _places(batches, bits), "piece int, place int")
    for row in places.groupBy("piece").applyInArrow(_piece, "piece int, bits binary").toLocalIterator():
        bitmap[row.piece * PIECE >> 3 : (row.piece + 1) * PIECE >> 3] = np.frombuffer(row.bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            bit = _bit(batch.column(at), bits)
            hit = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
            rows = batch.filter(pa.array(hit.astype(bool)))
            yield from then(rows) if then else [rows]

    if then:
        return over_texts(df, run, schema)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, df.schema)


#: Bits of a bitmap that are built together, 8 KB.
PIECE = 1 << 16


def _places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Piece and place within it of each key's bit."""
    for batch in batches:
        at = np.unique(_bit(batch.column(0), bits))
        yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array((at % PIECE).astype(np.int32))], ["piece", "place"])


def _piece(rows: pa.Table) -> pa.Table:
    marked = np.zeros(PIECE, bool)
    marked[rows.column("place").to_numpy()] = True
    return pa.table({"piece": rows.column("piece")[:1], "bits": pa.array([np.packbits(marked).tobytes()], pa.binary())})


def _bit(values: pa.Array, bits: int) -> np.ndarray:
    return (mix(values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows in an Arrow batch that carries whole texts to Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches stay small from now on, which bounds what a task holds outside the heap; a long text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy() -> None:
    """Gives free memory of this Python worker back to the system: workers stay for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has this
        ctypes.CDLL(None).malloc_trim(0)


def over_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in small batches; ``run`` gets columns by place, as their names may hold dots."""
    small_batches(df.sparkSession)
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run_and_tidy(batches):
        yield from run(batches)
        tidy()

    return df.mapInArrow(run_and_tidy, schema)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return over_texts(df, run, schema)


def fold(id_column, parts: int):
    """crc32 of the id as decimal text, modulo ``parts``; null ids fall into no fold."""
    return F.crc32(id_column.cast("string").cast("binary")) % parts
