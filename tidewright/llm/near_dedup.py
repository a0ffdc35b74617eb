"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

1. ``sketch``: one pass over whole texts gives each document its number of distinct word shingles, a 128-bit
   fingerprint of the shingle set and ``bands`` band keys.  All signature coordinates come from two permutations
   of the 32-bit universe (C-MinHash): coordinate k is ``min over x of pi((sigma(x) + k) mod 2**32)``.
2. Documents with equal sets form a class, which is a node (the fingerprint); only nodes go on.
3. Documents that share a band key are candidates.  Each is compared with the most central document of its buckets
   first.  Members of a bucket that this leaves in different components are then compared with each other: in small
   buckets as pairs, in large ones in blocks that emit only pairs which a compact sketch can't rule out.  The sketch
   (part sums) never rules out a link.  Blocks of a bucket's largest component meet only those of the other members.
4. Links hold where ``100 * intersection >= percent * union`` on the full sets; an id that repeats with other texts
   links their nodes.  Components are found by minimum labels and pointer jumping in Spark joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .frames import cut, map_arrow, maybe_in, narrow

SKETCH = "doc_id long, n_shingles long, node binary, bands array<long>"
PAIRS = "a binary, b binary"


def fingerprints(shingles: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Sixteen bytes for each document's set of distinct shingles."""
    counts, sums = np.diff(begin), np.zeros((len(begin) - 1, 2), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        for side, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            sums[some, side] = np.add.reduceat(bytewords.mix(shingles ^ np.uint64(salt)), begin[some])
        sums[:, 0] ^= bytewords.mix(counts.astype(np.uint64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(counts), [None, pa.py_buffer(sums.tobytes())]).cast(pa.binary())


def circulant_signature(shingles: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates) of uint32; documents without shingles get the largest value everywhere."""
    out = np.full((len(begin) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begin))
    if not len(some):
        return out
    at = begin[some]
    sigma = (bytewords.mix(shingles) >> np.uint64(32)).astype(np.uint32)
    work, shifted = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.add(sigma, np.uint32(k), out=work)  # the circular shift
        for right, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(work, np.uint32(right), out=shifted)
            np.bitwise_xor(work, shifted, out=work)
            np.multiply(work, np.uint32(factor), out=work)
        np.right_shift(work, np.uint32(16), out=shifted)
        np.bitwise_xor(work, shifted, out=work)
        out[some, k] = np.minimum.reduceat(work, at)
    return out


def distinct_per_document(shingles: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in ascending order, and where each document's begin."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = shingles[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(begin)))


def sketch(docs: DataFrame, *, width: int = 5, bands: int = 26, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, node (of the set) and band keys (null without words) of ``docs`` (doc_id, text)."""

    def batch_sketch(batch: pa.RecordBatch):
        for row, end, data, offsets in bytewords.text_slices(batch.column(1), 1 << 20):
            words = bytewords.words(data, offsets)
            shingles, begin = bytewords.shingle_hashes(words.hashes(), words.first, width)
            shingles, begin = distinct_per_document(shingles, begin)
            counts = np.diff(begin)
            signature = circulant_signature(shingles, begin, bands * rows).reshape(len(counts), bands, rows)
            keys = np.broadcast_to(bytewords.mix(np.arange(bands, dtype=np.uint64)), (len(counts), bands)).copy()
            for k in range(rows):
                keys = bytewords.mix(keys ^ signature[:, :, k])
            empty = pa.array(counts == 0)
            nodes = pa.compute.if_else(empty, None, fingerprints(shingles, begin))
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands)
            lists = pa.compute.if_else(empty, None, pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())))
            arrays = [batch.column(0).slice(row, end - row), pa.array(counts.astype(np.int64)), nodes, lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "node", "bands"])

    return map_arrow(docs, batch_sketch, SKETCH)


def part_sums(shingles: np.ndarray) -> bytes:
    """One byte for each of 2**k parts (at least as many as shingles, 16 to 65,536): the sum of the part's shingles.

    Sets that differ in d shingles differ in d parts at most; the sums of neighbours add up to those of half the parts.
    """
    bits = min(16, max(4, (len(shingles) - 1).bit_length()))
    mixed = bytewords.mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    return np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), (mixed & np.uint64(255)).astype(float), 1 << bits).astype(np.int64).astype(np.uint8).tobytes()


def halved(parts: np.ndarray) -> np.ndarray:
    return parts.reshape(*parts.shape[:-1], -1, 2).sum(axis=-1, dtype=np.uint8)


def may_link(one: np.ndarray, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` (rows of part sums; ``sizes``: shingles of both sets together) can still reach ``percent``."""
    while len(one) > others.shape[1]:
        one = halved(one)
    while len(one) < others.shape[1]:
        others = halved(others)
    return (others != one).sum(axis=1) * (100 + percent) <= (100 - percent) * sizes


SETS = "node binary, shingles binary, parts binary"


def shingle_sets(width: int = 5) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A function of a batch (doc_id, text): node, the ascending distinct shingle hashes (eight bytes each) and their part sums."""

    def batch_sets(batch: pa.RecordBatch):
        for row, end, data, offsets in bytewords.text_slices(batch.column(1), 1 << 20):
            words = bytewords.words(data, offsets)
            shingles, begin = distinct_per_document(*bytewords.shingle_hashes(words.hashes(), words.first, width))
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin * 8), pa.py_buffer(shingles)])
            parts = pa.array([part_sums(shingles[a:b]) for a, b in zip(begin.tolist(), begin[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([fingerprints(shingles, begin), sets.cast(pa.binary()), parts], ["node", "shingles", "parts"])

    return batch_sets


def _attach(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, together: sizes of both sets) without those whose part sums rule the link out."""

    def batch_possible(batch: pa.RecordBatch):
        keep = np.zeros(batch.num_rows, bool)
        for i, (together, one, two) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
            one, two = np.frombuffer(one.as_buffer(), np.uint8), np.frombuffer(two.as_buffer(), np.uint8)
            keep[i] = may_link(one, two[None, :], np.array([together]), percent)[0]
        kept = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("parts").alias(f"parts_{side}")), side)
    return map_arrow(pairs.select("a", "b", "together", "parts_a", "parts_b"), batch_possible, PAIRS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have ``100 * intersection >= percent * union``."""

    def batch_confirm(batch: pa.RecordBatch):
        keep = np.zeros(batch.num_rows, bool)
        for i, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
            one, two = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            both = np.concatenate((one, two))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(both) - shared)
        kept = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return map_arrow(_attach(pairs, sets, "shingles"), batch_confirm, PAIRS)


def crowded(members: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of large buckets that the part sums don't rule out, of different labels.

    The members of a bucket's largest component and the others are cut into blocks of about ``block`` members.  A pair
    of blocks that are not both of the largest component is one group: a member is sent once a block it meets, and no
    pair becomes a row before it has passed.
    """

    def compare(rows: pa.Table) -> pa.Table:
        sizes, own = (rows.column(k).to_numpy() for k in ("n", "own"))
        ids, labels = (np.array(rows.column(k).to_pylist(), object) for k in ("id", "label"))
        first, second = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("parts")]
        widths = np.array([len(x) for x in parts])
        right = np.flatnonzero(own == second)
        matrices = [(right[widths[right] == w], np.stack([parts[k] for k in right[widths[right] == w]])) for w in np.unique(widths[right])]
        found: list[tuple[bytes, bytes]] = []
        for i in np.flatnonzero(own == first).tolist():
            for where, matrix in matrices:
                near = 100 * np.minimum(sizes[where], sizes[i]) >= percent * np.maximum(sizes[where], sizes[i])
                near &= labels[where] != labels[i]
                if first == second:
                    near &= ids[where] > ids[i]
                if near.any():
                    where, rows_ = where[near], matrix[near]
                    where = where[may_link(parts[i], rows_, sizes[where] + sizes[i], percent)]
                    found += [(min(ids[i], ids[k]), max(ids[i], ids[k])) for k in where.tolist()]
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    return dealt_blocks(members, sets, block).groupBy("key", "one", "two").applyInArrow(compare, PAIRS)


def dealt_blocks(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """A row for each member and pair of blocks (one, two) in which it is compared."""
    counted = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = F.max_by(F.struct("label", "n"), F.struct("n", "label"))
    shape = counted.groupBy("key").agg(most.alias("main"), F.sum("n").alias("all"))
    many = lambda n: F.ceil(n / block).cast("int")
    shape = shape.select("key", "main.label", many(F.col("all") - F.col("main.n")).alias("rest"), many(F.col("main.n")).alias("mains"))
    dealt = members.join(shape.withColumnRenamed("label", "_main"), "key").join(sets.select(F.col("node").alias("id"), "parts"), "id")
    inside, hashed = F.col("label") == F.col("_main"), F.xxhash64("id")
    # blocks of the others are numbered first, then those of the largest component
    dealt = dealt.withColumn("own", F.when(inside, F.col("rest") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int"))
    met = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return dealt.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "n", "label", "parts")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label of all nodes of ``links`` (a, b): label is the smallest node reachable.

    Minimum labels over links, then pointer jumping, until nothing changes; ``labels`` may give a start.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rows = both.count()
    both = narrow(both, rows)
    nodes = narrow(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), rows)
    if labels is not None:
        nodes = narrow(nodes.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), rows)
    nodes = cut(nodes)
    while True:
        seen = narrow(both.join(nodes.select(F.col("node").alias("b"), "label"), "b"), rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # what a node hears also goes to its former label, so that whole trees hook on at once
        told = cut(narrow(nodes.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("low")), rows))
        hooked = told.select("node", "low").unionByName(told.filter("low < label").select(F.col("label").alias("node"), "low"))
        hooked = narrow(hooked, rows).groupBy("node").agg(F.min("low").alias("low"))
        hooked = narrow(hooked, rows)
        jumped = narrow(hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("far")), "low", "left").select("node", F.least("low", "far").alias("fresh")), rows)
        step = cut(narrow(told.select("node", "label").join(jumped, "node").select("node", F.col("fresh").alias("label"), (F.col("fresh") != F.col("label")).alias("moved")), rows))
        nodes = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return nodes


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 26, rows: int = 6, small_bucket: int = 64
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept, one row per input row.

    Words are runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; a text of fewer words than ``width`` has its whole
    sequence as its one shingle; a null, empty or blank text has none and is linked with nothing.  A null id takes
    part in nothing: component_id null, kept true.  Rows of one id share its component; where their texts differ, the
    id is linked through each of them.  Columns other than the two named are ignored; an empty table gives no rows.
    With 26 bands of 6 coordinates a pair at 0.85 is missed with probability under 1e-5, with 40 bands one at 0.80.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = cut(sketch(docs, width=width, bands=bands, rows=rows))
    full = sketches.filter("doc_id is not null and node is not null")
    sums = [F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")]
    classes = cut(full.groupBy("node").agg(*sums))
    keyed = classes.select("node", "least", "n", F.explode("bands").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    members = maybe_in(keyed, "key", shared.select("key")).join(shared, "key")
    members = cut(members.select("key", F.col("node").alias("id"), "least", "n", "size"))
    # an id that repeats with other texts links their nodes
    several = full.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most")
    links = cut(full.join(several, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
    labels = None
    if not members.isEmpty():
        central = members.groupBy("id").agg(F.sum("size").alias("central"))
        members, candidates = cut(members.drop("least").join(central, "id")), members.select("least").distinct()
        sets = maybe_in(docs.filter("doc_id is not null"), "doc_id", candidates, then=shingle_sets(width), schema=SETS)
        sets = cut(sets.dropDuplicates(["node"]))
        near = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
        # first, each member meets the most central of all leads of its buckets
        rank = F.struct("central", "id")
        leads = members.groupBy("key").agg(F.max_by(F.struct("id", "n"), rank).alias("lead"), F.max("central").alias("lead_central"))
        best = members.join(leads, "key").filter("id <> lead.id")
        best = best.select("id", "n", F.col("lead.id").alias("id2"), F.col("lead.n").alias("n2"), "lead_central").filter(near)
        lead = F.struct("id2", (F.col("n") + F.col("n2")).alias("together"))
        best = best.groupBy("id").agg(F.max_by(lead, F.struct("lead_central", "id2")).alias("best"))
        asked = best.select(F.least("id", "best.id2").alias("a"), F.greatest("id", "best.id2").alias("b"), "best.together").distinct()
        found = links.unionByName(cut(confirmed(cut(possible(asked, sets, percent)), sets, percent)))
        labels = components(found)
        # then members of a bucket that are still in different components meet
        current = members.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = current.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key")
        current = cut(current.join(mixed, "key", "left_semi"))
        few = current.filter(F.col("size") <= small_bucket).select("key", "id", "n", "label")
        other = few.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
        pairs = few.join(other, "key").filter("id < id2 and label <> label2").filter(near)
        pairs = pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), (F.col("n") + F.col("n2")).alias("together")).distinct()
        pairs = possible(pairs, sets, percent)
        many = current.filter(F.col("size") > small_bucket)
        if not many.isEmpty():
            pairs = pairs.unionByName(crowded(many, sets, percent))
        fresh = cut(confirmed(cut(pairs.distinct()), sets, percent))
        if not fresh.isEmpty():
            labels = components(found.unionByName(fresh), labels)
    elif not links.isEmpty():
        labels = components(links)
    # nodes that stand for more than one row, with the smallest id of their component
    groups = classes.filter("copies > 1").select("node", F.col("least").alias("component"))
    if labels is not None:
        grouped = classes.select("node", "least", "copies").join(labels, "node", "left")
        grouped = grouped.filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
        least = grouped.groupBy("label").agg(F.min("least").alias("component"))
        groups = grouped.select("node", "label").join(least, "label").select("node", "component")
    out = sketches.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Rows without an id are known by their text, with numbers from here on.
NAMELESS = 1 << 62


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each near-duplicate group stays: that of the smallest id.

    Rows without an id are documents too, known by their text and after all others.  Of rows that repeat an id and a text
    the first by all columns stays; an id's other texts are documents of its group, which stay if the id does.  Texts
    without words are in no group, but rows that repeat one of an id, or of none, are one.  ``options`` are those of
    ``near_duplicates``.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row")[text_col].cast("string")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    named = whole.withColumn("key", F.coalesce(F.col("row")[id_col].cast("long"), nameless))
    found = cut(near_duplicates(named.select("key", text.alias("text")), id_col="key", **options).select("doc_id", "kept"))
    stay = named.join(found.filter("not kept").select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    repeated = found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("key"))
    if repeated.isEmpty():
        return stay.select("row.*")
    once = stay.join(repeated, "key", "left_semi").groupBy("key", F.sha2(text, 256)).agg(F.min("row").alias("row"))
    return stay.join(repeated, "key", "left_anti").select("row.*").unionByName(once.select("row.*"))


def oracle_sql(percent: int = 85, width: int = 5) -> str:
    """The same rows in DuckDB SQL over documents: exact similarities of all pairs that share a shingle, and reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM windows),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
groups AS (SELECT a, min(b) AS component FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN groups ON a = d.doc_id
"""
