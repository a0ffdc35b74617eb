"""Documents as dictionary-encoded blocks, so that each distinct word is shuffled once per block.

``blocks`` explodes texts into words with positions, a block of documents at a time, and packs what it finds:

* for each shard (words dealt by hash) one row with the block's distinct words of that shard and their counts;
* one row with the positions: document ids, words per document and, for each word in order, its number in the block.

A word that a third of the corpus consists of is still one entry per block.  ``by_shard`` brings all entries of a shard
together, so that each distinct word is looked at once in the whole corpus, and sends an answer for each entry back to
its block; ``by_block`` puts the answers in place.

No group grows with the input: blocks hold about BLOCK_BYTES of text (at least one document) and shards are as many as
the input has SHARD_BYTES (``layout``).  A block makes BUNDLES rows of words at most, however many shards there are: beyond
that many, shards travel in bundles (a shard's number modulo BUNDLES).  Bundles of a range of blocks (RANGE_BYTES of
text) meet first, add their distinct words up and are cut into shards, which meet then (``distinct``).  So a block's rows
are bounded, a shard gets a row a range, and a word that every block has is an entry a block in its range and an entry a
range beyond.  Answers go back the same way, and each range gets those of its own words alone (``put``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .frames import cut, over_texts, tidy

PACKED = "part long, block long, payload binary"
BLOCK_BYTES = 4 << 20
#: Text that a shard's words come from, and the most of it that one range of blocks holds.
SHARD_BYTES, RANGE_BYTES = 32 << 20, 16 << 30
#: More shards than this share partitions; each is still a group of its own.
MOST_PARTITIONS = 20_000
#: Rows of words that a block makes at most.
BUNDLES = 64
#: The positions of a block travel under a part of their own, beyond all shards.
POSITIONS = 1 << 40


@dataclass(frozen=True)
class Layout:
    shards: int
    ranges: int = 1

    def __post_init__(self):
        if self.shards > BUNDLES and self.shards % BUNDLES:
            raise ValueError(f"more than {BUNDLES} shards have to be a multiple of that")

    @property
    def bundles(self) -> int:
        """What a block's words are dealt into: shards while they are few."""
        return min(self.shards, BUNDLES)

    @property
    def direct(self) -> bool:
        """Whether rows of blocks meet in their shard at once."""
        return self.ranges == 1 and self.shards == self.bundles

    @property
    def partitions(self) -> int:
        return min(self.shards, MOST_PARTITIONS)


def layout(docs: DataFrame, column: str = "text") -> Layout:
    """Shards and ranges for ``docs``, by the bytes of all its texts."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    return Layout(shards if shards <= BUNDLES else -(-shards // BUNDLES) * BUNDLES, max(1, -(-size // RANGE_BYTES)))


def pack(arrays: dict[str, pa.Array]) -> bytes:
    """An Arrow record batch, compressed."""
    batch = pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def pack_rows(columns: dict[str, pa.Array]) -> bytes:
    """Columns of equal length as plain values after a short head, compressed together: a row of few words stays small.

    Binaries and lists are sizes and one flat value.
    """
    parts: list[tuple[str, str, np.ndarray]] = []
    for name, column in columns.items():
        if pa.types.is_large_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
            parts += [(name, "sizes", np.diff(offsets).astype(np.uint32)), (name, "bytes", data)]
        elif pa.types.is_list(column.type):
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.uint32)
            parts += [(name, "sizes", sizes), (name, "flat", column.flatten().to_numpy(zero_copy_only=False))]
        else:
            parts.append((name, "", column.to_numpy(zero_copy_only=False)))
    head = json.dumps([(name, kind, x.dtype.str, len(x)) for name, kind, x in parts]).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(x).tobytes() for *_, x in parts)])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack_rows(payload: pa.Buffer) -> pa.RecordBatch:
    raw = memoryview(payload)
    body = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd")
    raw = memoryview(body)
    at = 4 + int.from_bytes(raw[:4], "little")
    columns: dict[str, pa.Array] = {}
    for name, kind, dtype, n in json.loads(bytes(raw[4:at])):
        values = np.frombuffer(raw[at : at + n * np.dtype(dtype).itemsize], dtype)
        at += values.nbytes
        if kind == "sizes":
            offsets = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        elif kind == "bytes":
            columns[name] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        elif kind == "flat":
            columns[name] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        else:
            columns[name] = pa.array(values)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def planes(values: np.ndarray) -> pa.Array:
    """One row of the four byte planes of uint32 values, which compress well apart."""
    return pa.array([np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()], pa.large_binary())


def unplanes(value: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def word_array(words: bytewords.Words) -> pa.Array:
    """The words of a slice as Arrow binary, without a Python object for any."""
    sizes = words.ends - words.starts
    solid = words.data[~bytewords._SPACE[words.data]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(solid)])


def _rows(ids: list[pa.Array], counts: list[np.ndarray], found: list[pa.Array], weights: np.ndarray, block: int, shards: int, kinds: str) -> Iterator[tuple[int, int, bytes]]:
    tokens = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
    index = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    entries = tokens.dictionary
    sizes = np.concatenate(counts)
    uses = np.bincount(index, minlength=len(entries))
    common = np.argsort(-uses, kind="stable")  # frequent words get small numbers
    number = np.empty_like(common)
    number[common] = np.arange(len(common))
    offsets = np.frombuffer(entries.buffers()[1], np.int64, len(entries) + 1, entries.offset * 8)
    data = np.frombuffer(entries.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    shard = (bytewords.hash_spans(data, offsets[:-1], offsets[1:])[common] % np.uint64(shards)).astype(np.int64)
    dealt = np.argsort(shard, kind="stable")
    entries = entries.take(pa.array(common[dealt]))
    # the block is known by its words in their order, so that rows of another run of the task never pass for its own
    order = bytewords.hash_spans(data, offsets[:-1], offsets[1:])[common[dealt]] ^ bytewords.mix(np.arange(len(common), dtype=np.uint64))
    block = int(bytewords.mix(np.array([np.add.reduce(bytewords.mix(order)) ^ np.uint64(block)], np.uint64))[0] >> np.uint64(2))
    weighed = np.bincount(index, np.repeat(weights, sizes), len(common))[common[dealt]].astype(np.int64) if len(index) else np.zeros(0, np.int64)
    edges = np.searchsorted(shard[dealt], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist() if "w" in kinds else ():
        a, b = edges[k], edges[k + 1]
        yield k, block, pack_rows({"word": entries.slice(a, b - a), "count": pa.array(weighed[a:b])})
    known = pa.concat_arrays(ids)
    if "p" in kinds:
        yield POSITIONS + block % POSITIONS, block, pack({"ids": pa.array([known.fill_null(0).to_numpy()], pa.list_(pa.int64())), "missing": pa.array([known.is_null().to_numpy(zero_copy_only=False)]), "sizes": pa.array([sizes.astype(np.int32)]), "weights": pa.array([weights.astype(np.int8)]), "at": planes(number[index]), "order": planes(dealt), "entries": pa.array([len(common)])})


def blocks(docs: DataFrame, tokenise: Callable[[pa.Array], Iterator[tuple[int, int, pa.Array, np.ndarray]]], shards: int, *, kinds: str = "wp", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed rows (part, block, payload) of ``docs`` (doc_id, text, weight).

    ``tokenise`` gives, for slices of a text column, (row, end, words as Arrow large_binary, words per document).
    ``count`` of an entry sums ``weight`` (0 or 1) over its uses.  ``kinds`` says which rows to make: words, positions or
    both; two calls agree if ``docs`` gives the same rows in the same order again, as files do.
    """

    def run(batches):
        task, seen = TaskContext.get().partitionId() << 24, 0
        ids, counts, found, weights, held = [], [], [], [], 0

        def flush():
            rows = list(_rows(ids, counts, found, np.concatenate(weights), task + seen, shards, kinds))
            for start in range(0, len(rows), 64):
                part, block, payload = zip(*rows[start : start + 64])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], ["part", "block", "payload"])

        for batch in batches:
            for row, end, words, sizes in tokenise(batch.column(1)):
                ids.append(batch.column(0).slice(row, end - row))
                counts.append(sizes)
                found.append(words)
                weights.append(batch.column(2).slice(row, end - row).to_numpy(zero_copy_only=False).astype(np.int64))
                held += (words.nbytes if len(words) else 0) + 64 * (end - row)
                if held >= block_bytes:
                    yield from flush()
                    ids, counts, found, weights, held, seen = [], [], [], [], 0, seen + 1
                    tidy()
        if ids:
            yield from flush()

    return over_texts(docs, run, PACKED)


def _met(rows: pa.Table) -> tuple[list[pa.RecordBatch], pa.Array, np.ndarray, np.ndarray]:
    """The entries of packed rows, their distinct words, each entry's number among these, and the words' summed counts."""
    entries = [unpack_rows(x.as_buffer()) for x in rows.column("payload")]
    coded = pa.chunked_array([x.column("word") for x in entries]).combine_chunks().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(index, np.concatenate([x.column("count").to_numpy() for x in entries]), len(coded.dictionary))
    return entries, coded.dictionary, index, counts.astype(np.int64)


def _by_part(packed: DataFrame, group: Callable[[pa.Table], pa.Table], shape: Layout) -> DataFrame:
    """``group`` of each shard's rows, with each shard in a partition of its own while there are not too many."""
    placed = packed.withColumn("place", F.pmod("part", F.lit(shape.partitions)).cast("int")).repartitionById(shape.partitions, "place")
    # grouped by the place as well, so that this shuffle is the only one
    return placed.groupBy("place", "part").applyInArrow(lambda rows: group(rows.select(["part", "block", "payload"])), PACKED)


def distinct(words: DataFrame, shape: Layout) -> DataFrame:
    """A packed row (word, count) for each shard: its distinct words and their counts over the corpus."""

    def add(rows: pa.Table) -> pa.Table:
        _, found, _, counts = _met(rows)
        out = rows.slice(0, 1).set_column(2, "payload", pa.array([pack_rows({"word": found, "count": pa.array(counts)})], pa.binary()))
        tidy()
        return out

    return _by_part(words if shape.direct else ranged(words, shape), add, shape)


def ranged(words: DataFrame, shape: Layout) -> DataFrame:
    """Packed rows (shard, range, payload) of the distinct words, with their counts, of each range of blocks."""

    def cut_up(rows: pa.Table) -> pa.Table:
        _, found, _, counts = _met(rows)
        offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
        data = np.frombuffer(found.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        shard = (bytewords.hash_spans(data, offsets[:-1], offsets[1:]) % np.uint64(shape.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        parts, first = np.unique(shard[order], return_index=True)
        payloads = [pack_rows({"word": found.take(pa.array(mine)), "count": pa.array(counts[mine])}) for mine in np.split(order, first[1:])]
        tidy()
        return pa.table({"part": pa.array(parts), "block": pa.array(np.full(len(parts), rows.column("block")[0].as_py())), "payload": pa.array(payloads, pa.binary())})

    dealt = words.withColumn("block", F.pmod("block", F.lit(shape.ranges)))
    return dealt.groupBy("part", "block").applyInArrow(cut_up, PACKED)


def over_words(vocabulary: DataFrame, answer: Callable[[pa.Array, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    """Rows of ``distinct`` with the answers beside the words; ``answer`` gets a shard's words and counts."""

    def run(batches):
        for batch in batches:
            payloads = []
            for payload in batch.column(2):
                known = unpack_rows(payload.as_buffer())
                answers = answer(known.column("word"), known.column("count").to_numpy())
                payloads.append(pack_rows({"word": known.column("word"), **answers}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payloads, pa.binary())], ["part", "block", "payload"])

    return over_texts(vocabulary, run, PACKED)


def _answers(asked: pa.LargeBinaryArray, known: pa.RecordBatch, words: bool = False) -> bytes:
    """The answers of ``known`` to the words that are asked for, in their order; with the words before them if wanted."""
    at = pc.index_in(asked, known.column("word"))
    told = {k: known.column(k).take(at) for k in known.schema.names if k != "word"}
    return pack_rows({"word": asked, **told} if words else told)


def put(words: DataFrame, answered: DataFrame, shape: Layout) -> DataFrame:
    """Packed rows of ``words`` whose entries are replaced by the answers of ``over_words``."""

    def group(rows: pa.Table, last: pa.Table) -> pa.Table:
        some = [unpack_rows(x.as_buffer()) for x in last.column("payload")]
        known = pa.Table.from_batches(some).combine_chunks().to_batches()[0] if sum(x.num_rows for x in some) else some[0]
        payloads = [_answers(unpack_rows(x.as_buffer()).column("word"), known) for x in rows.column("payload")]
        tidy()
        return rows.select(["part", "block", "payload"]).set_column(2, "payload", pa.array(payloads, pa.binary()))

    if shape.direct:
        return words.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(group, PACKED)

    def told(rows: pa.Table, last: pa.Table) -> pa.Table:
        known = unpack_rows(last.column("payload")[0].as_buffer())
        payloads = [_answers(unpack_rows(x.as_buffer()).column("word"), known, words=True) for x in rows.column("payload")]
        tidy()
        return rows.select(["part", "block", "payload"]).set_column(2, "payload", pa.array(payloads, pa.binary()))

    # each range gets the answers to its own distinct words, from all shards of a bundle
    back = ranged(words, shape).groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(told, PACKED)
    back = back.select(F.pmod("part", F.lit(shape.bundles)).alias("part"), "block", "payload", F.col("block").alias("range"))
    mine = words.withColumn("range", F.pmod("block", F.lit(shape.ranges)))
    return mine.groupBy("part", "range").cogroup(back.groupBy("part", "range")).applyInArrow(group, PACKED)


def by_shard(words: DataFrame, answer: Callable[[pa.Array, np.ndarray], dict[str, pa.Array]], shape: Layout) -> DataFrame:
    """Packed rows of words whose entries are replaced by answers.

    ``answer`` gets the distinct words of a shard with their counts over the corpus and returns columns of as many rows.
    """
    if not shape.direct:
        words = cut(words)
        return put(words, over_words(distinct(words, shape), answer), shape)

    def group(rows: pa.Table) -> pa.Table:
        entries, found, index, counts = _met(rows)
        answers = answer(found, counts)
        payloads, start = [], 0
        for x in entries:
            payloads.append(pack_rows({k: v.take(pa.array(index[start : start + x.num_rows])) for k, v in answers.items()}))
            start += x.num_rows
        del entries, found, answers
        tidy()
        return rows.set_column(2, "payload", pa.array(payloads, pa.binary()))

    return _by_part(words, group, shape)


def by_block(answered: DataFrame, positions: DataFrame, finish: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Array]], pa.Table], schema: str) -> DataFrame:
    """Rows of all blocks; ``finish`` gets ids, weights, words per document, each word's number and the answers by number.

    Words and positions are made from the same rows in the same order, or the job stops.
    """

    def group(rows: pa.Table, last: pa.Table) -> pa.Table:
        if last.num_rows != 1:
            raise RuntimeError("a block's words and positions come from different runs of its task")
        answers = [unpack_rows(x.as_buffer()) for x in rows.sort_by("part").column("payload")]
        last = unpack(last.column("payload")[0].as_buffer())
        if sum(x.num_rows for x in answers) != last.column("entries")[0].as_py():
            raise RuntimeError("a block's words and positions come from different runs of its task")
        place = np.argsort(unplanes(last.column("order")[0]))
        names = answers[0].schema.names if answers else []
        by_number = {k: pa.chunked_array([x.column(k) for x in answers]).combine_chunks().take(pa.array(place)) for k in names}
        ids = last.column("ids").flatten()
        ids = pc.if_else(last.column("missing").flatten(), None, ids.cast(pa.int64()))
        tidy()
        return finish(ids, last.column("weights").flatten().to_numpy(), last.column("sizes").flatten().to_numpy(), unplanes(last.column("at")[0]).astype(np.int64), by_number)

    # a cogroup, not a union: each side is a stage of its own, whose partitions number the blocks
    return answered.groupBy("block").cogroup(positions.groupBy("block")).applyInArrow(group, schema)
