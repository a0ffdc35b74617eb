"""Byte-level BPE encoding and decoding with a global shuffle of distinct pre-tokens.

Texts are cut by the tokenizer's pattern into pre-tokens with positions; each distinct pre-token of the corpus meets
in one shard and is encoded there once; its ids go back to the blocks that use it and are put in place by position
(see ``blocks``).  Decoding joins ids with the table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, bytewords
from .frames import cut, over_texts

DECODED = "doc_id long, token_ids array<int>, decoded binary"


@lru_cache(1)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(1)
def _encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(1)
def token_bytes(path: str) -> pa.Array:
    """Bytes by id; ids without a token are null."""
    known = ranks(path)
    table: list[bytes | None] = [None] * (max(known.values()) + 1)
    for token, rank in known.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def encode(docs: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", layout: blocks.Layout | None = None,
           from_files: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id and token_ids (array<int>) of whole texts, one row per input row.

    ``vocabulary`` is the path of a rank file that every executor has, ``pattern`` cuts texts into pre-tokens that are
    encoded apart; control strings in texts are ordinary text.  A null or empty text has no ids; null and repeated ids
    are carried along; other columns are ignored; an empty table gives no rows.

    With ``from_files``, for rows read from files without a shuffle between, blocks are made twice instead of being kept
    in the checkpoint folder, which needs half the disk; rows that came in another order the second time would stop the job.

    With ``decoded`` the ids are decoded where they are put in place, and the column decoded is that of ``decode``: a
    task then needs one Python worker instead of two, and no ids go through the JVM between them.
    """

    def tokenise(column: pa.Array):
        find = regex.compile(pattern).findall
        for row, end, data, offsets in bytewords.text_slices(column, 1 << 20):
            raw = data.tobytes()
            cuts = offsets.tolist()
            found = [find(raw[a:b].decode()) for a, b in zip(cuts, cuts[1:])]
            words = pa.array([x for xs in found for x in xs], pa.large_string()).cast(pa.large_binary())
            yield row, end, words, np.fromiter(map(len, found), np.int64, len(found))

    def answer(words: pa.Array, _: np.ndarray) -> dict[str, pa.Array]:
        encoder = _encoder(vocabulary)
        ids = [encoder.encode_ordinary(word.decode()) for word in words.to_pylist()]
        starts = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=starts[1:])
        return {"ids": pa.ListArray.from_arrays(pa.array(starts), pa.array(np.fromiter((x for xs in ids for x in xs), np.uint32, starts[-1])))}

    def finish(ids, _, sizes, at, answers) -> pa.Table:
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        if answers:
            taken = answers["ids"].take(pa.array(at))
            flat, lengths = taken.flatten().cast(pa.int32()), taken.value_lengths().to_numpy(zero_copy_only=False)
        else:
            flat, lengths = pa.array([], pa.int32()), np.zeros(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))[cuts]
        out = pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat)], ["doc_id", "token_ids"])
        return pa.Table.from_batches(_with_bytes(out, vocabulary)) if decoded else pa.Table.from_batches([out])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).alias("weight"))
    shape = layout or blocks.layout(docs)
    if from_files:
        words, positions = (blocks.blocks(docs, tokenise, shape.bundles, kinds=kind) for kind in "wp")
    else:
        packed = cut(blocks.blocks(docs, tokenise, shape.bundles))
        words, positions = packed.filter(F.col("part") < blocks.POSITIONS), packed.filter(F.col("part") >= blocks.POSITIONS)
    return blocks.by_block(blocks.by_shard(words, answer, shape), positions, finish, DECODED if decoded else "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, *, vocabulary: str) -> DataFrame:
    """``encoded`` (doc_id, token_ids) with the column decoded (binary), the joined bytes of each row's tokens.

    Null ids give null, no ids give empty bytes; an id outside the vocabulary stops the job.
    """

    def run(batches):
        for batch in batches:
            yield from _with_bytes(batch, vocabulary)

    return over_texts(encoded.select("doc_id", "token_ids"), run, DECODED)


def _with_bytes(batch: pa.RecordBatch, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` (doc_id, token_ids) with the joined bytes of each row's tokens."""
    lists = batch.column(1)
    width = max(1, (1 << 20) // max(1, len(lists.values) // max(1, len(lists)) if len(lists) else 1))
    for start in range(0, len(lists), width):
        part = lists.slice(start, width)
        flat, table = part.flatten().to_numpy(zero_copy_only=False), token_bytes(vocabulary)
        inside = not len(flat) or (flat.min() >= 0 and flat.max() < len(table))
        joined = table.take(pa.array(flat if inside else flat[:0]))
        if joined.null_count or not inside:
            raise ValueError("a token id is outside the vocabulary")
        sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)[np.concatenate(([0], np.cumsum(sizes)))]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(offsets)), joined.buffers()[2]])
        if part.null_count:
            texts = pa.compute.if_else(part.is_null(), None, texts)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, width), part, texts.cast(pa.binary())], ["doc_id", "token_ids", "decoded"])
