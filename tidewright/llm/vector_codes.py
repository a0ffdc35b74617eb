"""Vector code compression: product codes by Lloyd rounds, with exact nearest entries from a metric tree.

A vector's components become integers (``floor(scale * x)``) and its ``parts`` equal consecutive parts get the index of
the nearest entry of their codebook.  Each round is one scan: tasks search the trees and add up what each entry gets,
sums of at most codebook size meet, and the driver makes the next codebook of them.  Vectors never leave their tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import looked_up, written
from .metric_tree import VantageTree

SUMS = "part int, entry int, place int, total long"
#: Vectors searched at once.
ROWS = 8192


@dataclass
class Codes:
    """``rows``: vec_id, label, code (binary, a byte a part) and error; ``books``: for each part, (entries, components)."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def whole_numbers(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and v (integers); rows whose vector is null or has a null or non-finite component are left out."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """(rows, components) of a list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _searched(batches: Iterator[pa.RecordBatch], at: int, books: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For slices of batches: (points, nearest entry, squared distance) of each part."""
    trees = [VantageTree(book) for book in books]
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            some = batch.slice(start, ROWS)
            points = np.split(matrix(some.column(at)), len(books), axis=1)
            yield some, [(p, *tree.search(p)) for p, tree in zip(points, trees)]


def _next_books(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Componentwise floors of the means of the parts that each entry gets; entries that get none stay."""

    def run(batches):
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, parts in _searched(batches, 0, books):
            for k, (points, which, _) in enumerate(parts):
                np.add.at(sums[k], which, points)
                counts[k] += np.bincount(which, minlength=len(counts[k]))
        for k, (total, count) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(count)
            table = np.concatenate([count[used, None], total[used]], axis=1)
            entry, place = np.divmod(np.arange(table.size), table.shape[1])
            arrays = [pa.array(np.full(table.size, k, np.int32)), pa.array(used[entry].astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(table.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "place", "total"])

    added = vectors.select("v").mapInArrow(run, SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
    for r in added.collect():  # a row for each number of the codebooks at most
        if r.place < 0:
            counts[r.part][r.entry] = r.total
        else:
            sums[r.part][r.entry, r.place] = r.total
    return [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for s, n, b in zip(sums, counts, books)]


def compress(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes | None:
    """Codes of all vectors and the codebooks they refer to; None where no vector is left.

    Codebooks start as the parts of the rows with the ``entries`` smallest ids (ties by components, null ids last; fewer
    rows make fewer entries).  Repeated rows count as often as they occur.  The first of these rows sets the number of
    components, which ``parts`` must divide; vectors of another length have no code and are left out.  Components so
    large that a squared distance leaves 64 bits are an error.  Labels may be null; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte")
    kept = whole_numbers(vectors, scale, id_col, vector_col, label_col)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0].v)
    if not dims or dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    kept = written(kept.filter(F.size("v") == dims))
    start = np.array([r.v for r in first if len(r.v) == dims], np.int64)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds):
        books = _next_books(kept, books)

    def run(batches):
        for some, found in _searched(batches, 2, books):
            code = np.stack([which for _, which, _ in found], axis=1).astype(np.uint8)
            error = np.sum([away for *_, away in found], axis=0)
            bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), bytes_, pa.array(error)], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    rows = kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code binary, error long")
    return Codes(written(rows), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the error summed over all rows of the same label; nulls are one label."""
    named = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    sums = named.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    return looked_up(named, "_label", sums, "_n", "vec_id").select(*rows.columns, "label_error")


def decode(codes: DataFrame, books: list[np.ndarray], scale: float = 1024) -> DataFrame:
    """``codes`` with ``approximate``, the entries' components over ``scale`` in place of each code; a null code gives null."""
    at, whole = codes.columns.index("code"), [b.astype(float) / scale for b in books]

    def run(batches):
        for batch in batches:
            out = [None if c is None else np.concatenate([b[i] for b, i in zip(whole, c)]).tolist() for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "approximate"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{kinds}, approximate array<double>")


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    whole = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))"
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {whole}),
cut AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS q FROM kept, range({parts}) AS t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT p, e, q AS c FROM cut JOIN first USING (vec_id))"""]  # fmt: skip
    for k in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{k} AS (SELECT vec_id, label, p, q, CAST(m // {entries} AS BIGINT) AS d, CAST(m % {entries} AS BIGINT) AS e FROM (SELECT vec_id, any_value(label) AS label, p, any_value(q) AS q, min(CAST({apart} AS BIGINT) * {entries} + e) AS m FROM cut JOIN b{k} USING (p) GROUP BY vec_id, p))")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT p, e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{k}) GROUP BY p, e, i), n{k} AS (SELECT p, e, list(x ORDER BY i) AS c FROM s{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON b.p = n.p AND b.e = n.e)")
    return f"""
WITH {', '.join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""
