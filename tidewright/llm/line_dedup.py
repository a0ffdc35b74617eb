"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A ``LineStore`` keeps, below a shared folder, a version for each change:

* ``postings`` (key, doc_id): each document's distinct line keys, the references themselves;
* ``removed`` (doc_id): documents taken out again; a posting lives until its document is removed in a later version;
* ``refs`` (key, n_docs, first_doc): exact reference counts of all keys, and the smallest id that holds each;
* ``filters`` (shard, payload): cuckoo filters of the keys that several documents hold, one a shard of the key space.

An insertion adds to the filters the keys that get their second document, a removal takes out those that keep one, so the
store after a removal is that of the remaining documents.  What has to be dropped is found from the filters first: only
lines that they may hold meet the reference counts.  A line is dropped if its key is repeated and its document is not the
first, which the counts decide; the filters never decide alone.

A key is the line without whitespace at its ends, A-Z lower-cased, of ``least`` code points or more; it is known by the
first 128 bits of BLAKE2b.  No group grows with a line's frequency: counts are added up before the shuffle, the few
most frequent keys are broadcast (``frames.looked_up``), shards hold distinct keys only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuckoo import Cuckoo, halves, shard_of
from .frames import looked_up, over_texts

POSTINGS = "key binary, doc_id long"
#: Keys of all documents that one shard of the filters answers for, and how many shards there are at least.
SHARD_KEYS, LEAST_SHARDS = 1_000_000, 64
#: All shards together are broadcast up to this size (some 20 million repeated keys); beyond it lines are joined without them.
FILTER_BYTES = 64 << 20


def line_key(line: bytes, least: int) -> bytes | None:
    """16 bytes that stand for a line, or None if it is too short to be looked at."""
    line = line.strip().lower()  # of bytes: exactly \\x20 and \\x09-\\x0D, exactly A-Z
    if len(line) < least or len(line) < 4 * least and len(line.decode()) < least:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def postings(docs: DataFrame, least: int) -> DataFrame:
    """(key, doc_id) of the lines of ``docs`` (doc_id, text), each once; rows that repeat an id are one document."""

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                mine = {line_key(x, least) for x in raw.split(b"\n")} - {None}
                keys += mine
                ids += [doc_id] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return over_texts(docs.filter("doc_id is not null"), run, POSTINGS).distinct()


def counted(references: DataFrame) -> DataFrame:
    """n_docs and first_doc of each key."""
    return references.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def with_shard(keys: DataFrame, shards: int) -> DataFrame:
    """``keys`` (key, further columns) with the shard of each."""

    def run(batches):
        for batch in batches:
            yield batch.append_column("shard", pa.array(shard_of(halves(batch.column(0)), shards).astype(np.int32)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return keys.mapInArrow(run, f"{kinds}, shard int")


class LineStore:
    """The store below ``folder``, at its newest whole version; writing a version's ``done`` last makes it whole."""

    def __init__(self, spark: SparkSession, folder: str, *, least: int = 10, filter_bytes: int = FILTER_BYTES):
        self.spark, self.folder, self.least, self.filter_bytes = spark, folder, least, filter_bytes
        self.version, self.shards = 0, 0
        if self._exists("done"):
            last = spark.read.parquet(self._path("done")).orderBy(F.col("version").desc()).first()
            self.version, self.shards = last.version, last.shards

    def _path(self, name: str, version: int | None = None) -> str:
        return f"{self.folder}/{name}" + ("" if version is None else f"/version={version}")

    def _exists(self, name: str, version: int | None = None) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, version))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(self._path(name, version))

    def _read(self, name: str, schema: str) -> DataFrame:
        """All whole versions of a table that grows by versions."""
        if not self.version or not self._exists(name):
            return self.spark.createDataFrame([], f"{schema}, version int")
        return self.spark.read.schema(f"{schema}, version int").parquet(self._path(name)).filter(F.col("version") <= self.version)

    def references(self) -> DataFrame:
        """(key, doc_id) of all documents that are in the store now."""
        gone = self._read("removed", "doc_id long").groupBy("doc_id").agg(F.max("version").alias("gone"))
        every = self._read("postings", POSTINGS)
        if gone.isEmpty():
            return every.select("key", "doc_id")
        return every.join(gone, "doc_id", "left").filter("gone is null or gone < version").select("key", "doc_id")

    def refs(self) -> DataFrame:
        """key, n_docs and first_doc of all keys in the store now."""
        if not self.version:
            return self.spark.createDataFrame([], "key binary, n_docs long, first_doc long")
        return self.spark.read.parquet(self._path("refs", self.version))

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, payload binary")
        return self.spark.read.parquet(self._path("filters", self.version))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents; one whose id is in the store already is left as it is, rows without an id take no part."""
        version = self.version + 1
        new = postings(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), self.least)
        if self.version:
            new = new.join(self.references().select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id")
        self._write(new, "postings", version)
        new = self.spark.read.schema(POSTINGS).parquet(self._path("postings", version))
        if not self.shards:
            self.shards = max(LEAST_SHARDS, -(-new.count() // SHARD_KEYS))
        change = counted(new)
        if self.version:
            both = self.refs().unionByName(change).groupBy("key")
            self._write(both.agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc")), "refs", version)
        else:
            self._write(change, "refs", version)
        self._commit(version, change.select("key") if self.version else None)

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents of ``ids`` (doc_id); ids that are not in the store change nothing."""
        version = self.version + 1
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        self._write(ids, "removed", version)
        ids = self.spark.read.schema("doc_id long").parquet(self._path("removed", version))
        live = self.references()
        touched = live.join(ids, "doc_id", "left_semi").select("key").distinct()
        left = counted(live.join(ids, "doc_id", "left_anti").join(touched, "key", "left_semi"))
        self._write(self.refs().join(touched, "key", "left_anti").unionByName(left), "refs", version)
        self._commit(version, touched)

    def _commit(self, version: int, touched: DataFrame | None) -> None:
        """The filters of the new version, from the old ones and the keys that ``touched`` says may have changed; then ``done``."""
        new = self.spark.read.parquet(self._path("refs", version))
        repeated = with_shard(new.filter("n_docs > 1").select("key"), self.shards)
        if touched is None:
            filters = repeated.groupBy("shard").applyInArrow(_build, "shard int, payload binary")
        else:
            before, now = (t.filter("n_docs > 1").select("key", F.lit(True).alias(name)) for t, name in ((self.refs(), "before"), (new, "now")))
            flips = touched.distinct().join(before, "key", "left").join(now, "key", "left").filter("(before is null) <> (now is null)")
            changes = with_shard(flips.select("key", F.coalesce("now", F.lit(False)).alias("added")), self.shards)
            made = self.filters().groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update, "shard int, payload binary").persist()
            full = made.filter("payload is null").select("shard")
            again = repeated.join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInArrow(_build, "shard int, payload binary")
            filters = made.filter("payload is not null").unionByName(again)
        self._write(filters, "filters", version)
        if touched is not None:
            made.unpersist()
        self._write(self.spark.createDataFrame([(self.shards,)], "shards int"), "done", version)
        self.version = version

    def maybe_repeated(self, references: DataFrame) -> DataFrame:
        """The rows of ``references`` (key, doc_id) whose keys the filters may hold; it loses none whose key is repeated."""
        filters = self.filters()
        if (filters.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) > self.filter_bytes:
            return references
        known = {r.shard: r.payload for r in filters.collect()}  # filter_bytes at most
        shared, shards = self.spark.sparkContext.broadcast(known), self.shards

        def run(batches: Iterator[pa.RecordBatch]):
            loaded: dict[int, Cuckoo] = {}
            for batch in batches:
                keys = halves(batch.column(0))
                shard, keep = shard_of(keys, shards), np.zeros(len(keys), bool)
                for s in np.unique(shard).tolist():
                    if s in shared.value:
                        held = loaded.setdefault(s, Cuckoo(np.frombuffer(shared.value[s], np.uint16).reshape(-1, 4)))
                        mine = np.flatnonzero(shard == s)
                        keep[mine] = held.has(keys[mine])
                yield batch.filter(pa.array(keep))

        return references.select("key", "doc_id").mapInArrow(run, POSTINGS)

    def drops(self) -> DataFrame:
        """doc_id and the keys that the document loses: those repeated of which another document is the first."""
        repeated = self.refs().filter("n_docs > 1")
        met = looked_up(self.maybe_repeated(self.references()), "key", repeated, "n_docs", "doc_id")
        return met.filter("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines (of the text, split at \\n), n_dropped and kept_text of ``docs``, a row each.

        A null or empty text is one empty line.  Documents that are not in the store, and rows without an id, lose nothing;
        rows that repeat an id lose the same keys.  Other columns are ignored.
        """
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        joined = docs.join(self.drops().hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "keys")
        least = self.least

        def run(batches):
            for batch in batches:
                lines, dropped, texts = [], [], []
                for text, keys in zip(batch.column(1), batch.column(2)):
                    every = text.as_buffer().to_pybytes().split(b"\n")
                    gone = set(keys.as_py() or ()) if keys.is_valid else ()
                    stay = [x for x in every if line_key(x, least) not in gone] if gone else every
                    lines.append(len(every))
                    dropped.append(len(every) - len(stay))
                    texts.append(b"\n".join(stay))
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "kept_text"])

        return over_texts(joined, run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks else pa.array([], pa.binary())


def _build(rows: pa.Table) -> pa.Table:
    payload = Cuckoo.build(halves(_whole(rows.column("key")))).dump()
    return pa.table({"shard": rows.column("shard")[:1], "payload": pa.array([payload], pa.binary())})


def _update(filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its changes; a null payload asks for the filter to be built anew from the counts."""
    shard = (filters if filters.num_rows else changes).column("shard")[0].as_py()
    keys = halves(_whole(changes.column("key")))
    added = changes.column("added").to_numpy() if changes.num_rows else np.zeros(0, bool)
    held = Cuckoo.load(filters.column("payload")[0].as_py()) if filters.num_rows else Cuckoo.of_size(len(keys))
    held.remove(keys[~added])
    whole = held.room_for(int(added.sum())) and held.add(keys[added])
    return pa.table({"shard": pa.array([shard], pa.int32()), "payload": pa.array([held.dump() if whole else None], pa.binary())})


def deduplicate(docs: DataFrame, folder: str, *, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``LineStore.kept`` of ``docs`` after they have been put into a new store below ``folder``."""
    store = LineStore(docs.sparkSession, folder, least=least)
    store.insert(docs, id_col, text_col)
    return store.kept(docs, id_col, text_col)


def oracle_sql(least: int = 10) -> str:
    ends = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    small = f"translate(trim(line, {ends}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place FROM cut),
keyed AS (SELECT doc_id, place, line, {small} AS k FROM lines),
refs AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= {least} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, place, line, coalesce(first_doc <> doc_id, false) AS gone FROM keyed LEFT JOIN refs USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
