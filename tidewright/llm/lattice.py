"""Subword lattice likelihood of texts.

An existing subword vocabulary spans, over each word, a lattice of all its segmentations.  Pieces carry unigram
scores; the log-space forward recursion sums all paths, so a word gets its marginal probability and a document, whose
words start with the word mark and so share no piece, the product of its words' and one end's.

The lattice of a word has one more edge, the word itself, if training rows have it: it weighs what is left of the word's
count after an absolute discount, and the mass of all discounts weighs the segmentations into pieces.  So frequent
words keep their frequency and the rest is spelled.

Scores start from the ranks of the vocabulary (Zipf-Mandelbrot) and are fitted to the training rows by expectation
maximisation: each distinct training word is met once, weighed by its discount, as its discount is what is spelled.  Only vectors as
long as the vocabulary go through the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bytewords
from .frames import cut, over_texts

MARK = "▁".encode()
#: Words of more bytes (with the mark) are taken one by one, in stretches of at most so many bytes.
WIDE, STRETCH = 192, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLOOR = -700.0


@dataclass
class Pieces:
    """A vocabulary's pieces by hash, ascending; the last 256 numbers are the bytes."""

    keys: np.ndarray
    numbers: np.ndarray
    maybe: np.ndarray
    longest: int
    size: int
    ranks: np.ndarray
    texts: dict[bytes, int]


def _key(data: np.ndarray, length: int) -> np.ndarray:
    return bytewords.mix(data ^ np.uint64(length))


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """Of a sentencepiece model file; control and unknown pieces are left out, every byte is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts: dict[bytes, int] = {}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or re.match("<0x..>$", text):
            continue
        raw = text.encode()
        if MARK not in raw[1:]:  # pieces that would reach into the next word
            texts[raw] = len(texts)
    n = len(texts)
    keys = np.zeros(n, np.uint64)
    for raw, i in texts.items():
        prefix = np.uint64(0)
        with np.errstate(over="ignore"):
            for byte in raw:
                prefix = prefix * _BASE + np.uint64(byte + 1)
        keys[i] = _key(np.array([prefix], np.uint64), len(raw))[0]
    order = np.argsort(keys)
    maybe = np.zeros(1 << 22, bool)
    maybe[(keys >> np.uint64(42)).astype(np.int64)] = True
    return Pieces(keys[order], order, maybe, max(map(len, texts)), n + 256, np.concatenate((np.arange(n), np.full(256, 4 * n))), texts)


def starting_scores(vocabulary: Pieces) -> np.ndarray:
    """Natural-log probabilities by rank; sums to 1."""
    weights = 1.0 / (vocabulary.ranks + 10.0)
    return np.log(weights / weights.sum())


def _by_length(words: pa.Array):
    """(rows, bytes as a matrix) of the words of one length, with the mark before them."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    sizes = np.diff(offsets)
    data = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) and sizes[rows[0]] + len(MARK) <= WIDE:
            for at in range(0, len(rows), 16384):
                some = rows[at : at + 16384]
                body = data[offsets[some][:, None] + np.arange(sizes[some[0]])]
                yield some, np.concatenate((np.broadcast_to(np.frombuffer(MARK, np.uint8), (len(some), len(MARK))), body), axis=1)
        else:
            for row in rows.tolist():
                yield np.array([row]), np.concatenate((np.frombuffer(MARK, np.uint8), data[offsets[row] : offsets[row + 1]]))[None, :]


def _edges(matrix: np.ndarray, vocabulary: Pieces):
    """(start, end, rows, piece numbers) of all pieces in the words of a matrix, ends ascending."""
    n, length = matrix.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    for j in range(length):
        prefix[j + 1] = prefix[j] * _BASE + (matrix[:, j].astype(np.uint64) + np.uint64(1))
    power = np.ones(vocabulary.longest + 1, np.uint64)
    for k in range(1, len(power)):
        power[k : k + 1] = power[k - 1 : k] * _BASE
    for end in range(1, length + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            key = _key(prefix[end] - prefix[start] * power[end - start], end - start)
            rows = np.flatnonzero(vocabulary.maybe[(key >> np.uint64(42)).astype(np.int64)])
            if len(rows):
                at = np.minimum(np.searchsorted(vocabulary.keys, key[rows]), len(vocabulary.keys) - 1)
                hit = vocabulary.keys[at] == key[rows]
                rows, at = rows[hit], at[hit]
            if len(rows):
                yield start, end, rows, vocabulary.numbers[at]
        yield end - 1, end, slice(None), vocabulary.size - 256 + matrix[:, end - 1].astype(np.int64)


def _forward_scalar(word: bytes, scores: np.ndarray, vocabulary: Pieces) -> float:
    """The same recursion for one very long word, in memory bounded by the longest piece."""
    window = [0.0]
    for end in range(1, len(word) + 1):
        total = window[-1] + scores[vocabulary.size - 256 + word[end - 1]]
        for back in range(1, min(vocabulary.longest, end) + 1):
            number = vocabulary.texts.get(word[end - back : end])
            if number is not None:
                total = np.logaddexp(total, window[-back] + scores[number])
        window = [*window[-vocabulary.longest :], float(total)]
    return window[-1]


def word_scores(words: pa.Array, scores: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Natural-log marginal probability of each word (Arrow large_binary)."""
    out = np.zeros(len(words))
    for rows, matrix in _by_length(words):
        if matrix.shape[1] > WIDE:
            out[rows] = _forward_scalar(matrix.tobytes(), scores, vocabulary)
            continue
        alpha = np.full((matrix.shape[1] + 1, len(rows)), -np.inf)
        alpha[0] = 0
        for start, end, some, number in _edges(matrix, vocabulary):
            alpha[end, some] = np.logaddexp(alpha[end, some], alpha[start, some] + scores[number])
        out[rows] = alpha[-1]
    return out


def _stretch_edges(word: np.ndarray, low: int, high: int, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of all pieces of a word (uint8) that end beyond ``low`` and not beyond ``high``, ends ascending."""
    first = max(0, low + 1 - vocabulary.longest)
    key, codes = np.zeros(high - first, np.uint64), word[first:high].astype(np.uint64) + np.uint64(1)
    starts, sizes, numbers = [np.arange(low, high)], [np.ones(high - low, np.int64)], [vocabulary.size - 256 + word[low:high].astype(np.int64)]
    for size in range(1, min(vocabulary.longest, high - first) + 1):
        key = key[: len(codes) - size + 1] * _BASE + codes[size - 1 :]
        skip = max(0, low + 1 - size - first)
        wanted = _key(key[skip:], size)
        rows = np.flatnonzero(vocabulary.maybe[(wanted >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocabulary.keys, wanted[rows]), len(vocabulary.keys) - 1)
        hit = vocabulary.keys[at] == wanted[rows]
        starts.append(first + skip + rows[hit])
        sizes.append(np.full(hit.sum(), size))
        numbers.append(vocabulary.numbers[at[hit]])
    starts, numbers = np.concatenate(starts), np.concatenate(numbers)
    ends = starts + np.concatenate(sizes)
    order = np.argsort(ends, kind="stable")
    return starts[order], ends[order], numbers[order]


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log1p(exp(b - a)) if b > -inf else a


def _long_uses(word: np.ndarray, scores: np.ndarray, vocabulary: Pieces, out: np.ndarray) -> None:
    """Adds the expected uses of one long word (uint8) to ``out``.

    Forward values are kept only where a stretch begins, as many as the longest piece has bytes, and are made again
    stretch by stretch on the way back.
    """
    length, reach = len(word), vocabulary.longest
    lows = range(0, length, STRETCH)

    def forward(low: int, window: list[float]) -> tuple[list[float], tuple]:
        """Forward values from ``low`` - len(window) + 1 to the stretch's end, and the stretch's edges."""
        starts, ends, numbers = _stretch_edges(word, low, min(low + STRETCH, length), vocabulary)
        edges = starts.tolist(), ends.tolist(), scores[numbers].tolist()
        back = low - len(window) + 1
        alpha = window + [-inf] * (min(low + STRETCH, length) - low)
        for start, end, score in zip(*edges):
            alpha[end - back] = _log_sum(alpha[end - back], alpha[start - back] + score)
        return alpha, (*edges, numbers)

    windows = [[0.0]]
    for low in lows:
        alpha, _ = forward(low, windows[-1])
        windows.append(alpha[-reach:])
    total = windows.pop()[-1]
    beta = {length: 0.0}  # of the positions that the edges of this stretch and the next reach
    for low in reversed(lows):
        window = windows.pop()
        back = low - len(window) + 1
        alpha, (starts, ends, chances, numbers) = forward(low, window)
        shares = np.zeros(len(starts))
        for k in range(len(starts) - 1, -1, -1):
            start, after = starts[k], beta[ends[k]] + chances[k]
            shares[k] = alpha[start - back] + after - total
            beta[start] = _log_sum(beta.get(start, -inf), after)
        out += np.bincount(numbers, np.exp(shares), vocabulary.size)
        beta = {at: value for at, value in beta.items() if at <= low}


def expected_uses(words: pa.Array, counts: np.ndarray, scores: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighed by their counts."""
    out = np.zeros(vocabulary.size)
    for rows, matrix in _by_length(words):
        weights = counts[rows].astype(float)
        if matrix.shape[1] > WIDE:
            uses = np.zeros(vocabulary.size)
            _long_uses(matrix[0], scores, vocabulary, uses)
            out += weights[0] * uses
            continue
        edges = list(_edges(matrix, vocabulary))
        alpha = np.full((matrix.shape[1] + 1, len(rows)), -np.inf)
        beta = alpha.copy()
        alpha[0], beta[-1] = 0, 0
        for start, end, some, number in edges:
            alpha[end, some] = np.logaddexp(alpha[end, some], alpha[start, some] + scores[number])
        for start, end, some, number in sorted(edges, key=lambda e: -e[0]):
            beta[start, some] = np.logaddexp(beta[start, some], beta[end, some] + scores[number])
        for start, end, some, number in edges:
            share = weights[some] * np.exp(alpha[start, some] + scores[number] + beta[end, some] - alpha[-1, some])
            out += np.bincount(number, share, vocabulary.size)
    return out


def fit(words: DataFrame, shards: int, *, vocabulary: str, rounds: int, prior: float) -> np.ndarray:
    """Natural-log scores of the pieces, from the distinct words of ``shards`` shards (rows of ``blocks.distinct``).

    Shards' expected uses are summed in about the root of their number, and those on the driver.
    """
    known = pieces(vocabulary)
    scores = starting_scores(known)
    starting = np.exp(scores)
    size, bundles, kind = known.size, max(1, int(shards**0.5)), "bundle long, uses binary"

    def sparse(bundle: int, uses: np.ndarray) -> dict[str, list]:
        some = np.flatnonzero(uses > 0)
        return {"bundle": [bundle], "uses": [some.astype(np.int64).tobytes() + uses[some].tobytes()]}

    def add(uses: np.ndarray, packed_uses) -> None:
        half = len(packed_uses) // 2
        uses[np.frombuffer(packed_uses, np.int64, half // 8)] += np.frombuffer(packed_uses, float, half // 8, half)

    for _ in range(rounds):
        shared = scores

        def expected(batches):
            for batch in batches:
                for part, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                    entries = blocks.unpack_rows(payload.as_buffer())
                    used = entries.column("word").filter(pa.compute.greater(entries.column("count"), 0))
                    uses = expected_uses(used, np.ones(len(used)), shared, pieces(vocabulary))
                    yield pa.RecordBatch.from_pydict(sparse(part % bundles, uses), pa.schema([("bundle", pa.int64()), ("uses", pa.binary())]))

        def merge(rows: pa.Table) -> pa.Table:
            uses = np.zeros(size)
            for row in rows.column("uses"):
                add(uses, row.as_buffer())
            return pa.table(sparse(rows.column("bundle")[0].as_py(), uses), pa.schema([("bundle", pa.int64()), ("uses", pa.binary())]))

        uses = np.zeros(size)
        for row in over_texts(words, expected, kind).groupBy("bundle").applyInArrow(merge, kind).toLocalIterator():
            add(uses, row.uses)
        total = uses.sum() + prior
        scores = np.maximum(np.log((uses + prior * starting) / total), _FLOOR)
    return scores


def score(
    docs: DataFrame, held_out, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, prior: float = 1000.0, layout: blocks.Layout | None = None
) -> DataFrame:
    """Scores of whole texts under models of the rows for which ``held_out`` (a boolean column) is not true.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens met in training), train_tokens,
    base_score (add-one unigram words), score (lattice with the word edges), lattice_score (pieces alone), all log10, one
    row per input row.  Words are runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased; a null or empty text is one end.  Null and repeated ids are carried along, a
    null ``held_out`` counts as training; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(held, 0).otherwise(1).alias("weight"))

    def tokenise(column: pa.Array):
        for row, end, data, offsets in bytewords.text_slices(column):
            words = bytewords.words(data, offsets)
            yield row, end, blocks.word_array(words), np.diff(words.first)

    shape = layout or blocks.layout(docs)
    packed = cut(blocks.blocks(docs, tokenise, shape.bundles))
    ends = docs.filter("weight = 1").count()
    words = packed.filter(F.col("part") < blocks.POSITIONS)
    vocabulary_rows = cut(blocks.distinct(words, shape))  # each distinct word of the corpus once

    def sizes_of(batches):
        for batch in batches:
            counts = [blocks.unpack_rows(x.as_buffer()).column("count").to_numpy() for x in batch.column(2)]
            sums = [[int(x) for x in (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())] for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*sums)] or [pa.array([], pa.int64())] * 4, list(names))

    names = ("tokens", "distinct", "once", "twice")
    size = over_texts(vocabulary_rows, sizes_of, ", ".join(f"{x} long" for x in names)).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names)).first()
    total, distinct = size.tokens + ends, size.distinct + (ends > 0)
    discount = size.once / (size.once + 2 * size.twice) if size.twice else 0.5
    escape = max(discount * size.distinct, 1.0) / max(total, 1)
    scores = fit(vocabulary_rows, shape.shards, vocabulary=vocabulary, rounds=rounds, prior=prior)
    shared = spark.sparkContext.broadcast(scores)  # one number for each piece of the vocabulary

    def answer(words: pa.Array, counts: np.ndarray) -> dict[str, pa.Array]:
        spelled = word_scores(words, shared.value, pieces(vocabulary)) / np.log(10)
        whole = np.maximum(counts - discount, 0) / max(total, 1)
        with np.errstate(divide="ignore"):
            both = np.logaddexp(np.log(whole), np.log(escape) + spelled * np.log(10)) / np.log(10)
        return {"count": pa.array(counts), "score": pa.array(both.astype(np.float32)), "spelled": pa.array(spelled.astype(np.float32))}

    def finish(ids, weights, sizes, at, answers) -> pa.Table:
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        if answers:
            counts = answers["count"].to_numpy(zero_copy_only=False)
            columns = (counts > 0).astype(float), np.log10(counts + 1.0), *(answers[x].to_numpy(zero_copy_only=False).astype(float) for x in ("score", "spelled"))
        else:
            columns = (np.zeros(0),) * 4
        sums = [np.add.reduceat(np.append(x[at], 0.0), np.minimum(cuts[:-1], len(at))) * (sizes > 0) if len(sizes) else np.zeros(0) for x in columns]
        return pa.table({"doc_id": ids, "held_out": weights == 0, "n_words": sizes.astype(np.int64), "n_known": sums[0].astype(np.int64), "base": sums[1], "lattice": sums[2], "spelled": sums[3]})

    answered = blocks.put(words, blocks.over_words(vocabulary_rows, answer), shape)
    positions = packed.filter(F.col("part") >= blocks.POSITIONS)
    done = blocks.by_block(answered, positions, finish, "doc_id long, held_out boolean, n_words long, n_known long, base double, lattice double, spelled double")
    tokens, end = F.col("n_words") + 1, F.log10(F.lit((ends + 1.0) / (total + 1.0)))
    return done.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("lattice") + end).alias("score"),
        (F.col("spelled") + end).alias("lattice_score"),
    )
