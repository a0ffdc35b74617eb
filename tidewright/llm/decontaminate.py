"""Benchmark decontamination: training passages as queries on a BM25 inverted index of test items.

Items are indexed in segments of at most ``segment`` words.  A posting's weight is its BM25 impact divided by the
segment's score for itself, so 1 means that a passage has all its terms.  Every passage (``segment + stride`` words,
every ``stride`` words, so that each segment's worth of text lies whole in one passage) asks for all segments of score
``threshold`` or more, exactly, as block-max WAND does: a passage whose terms' largest weights, or largest weights in
any run of segments, can't reach the threshold is done; else only blocks of segments whose block maxima can reach it
have their postings read.  What is
retrieved is verified on the words around the passage: shares of the item's question and answer shingles (or of all).

The index is built with Spark and broadcast in parts of at most ``index_bytes``; each part asks over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .frames import over_texts

HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75
#: Segments in a block of the index, and how many runs of blocks have their maxima in a dense table.
BLOCK, RUNS = 16, 32


@dataclass
class Item:
    item_id: int
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Index:
    """Blocks by term: ``block_start[t]:block_start[t + 1]`` of ``blocks`` and ``block_best`` (their largest weights).

    The postings of entry b of ``blocks`` are ``posting_start[b]:posting_start[b + 1]`` of ``segments`` and ``weights``.
    ``run_best`` has each term's largest weight in each of at most RUNS runs of segments.
    """

    terms: np.ndarray
    maybe: np.ndarray
    best: np.ndarray
    segments: np.ndarray
    weights: np.ndarray
    posting_start: np.ndarray
    block_start: np.ndarray
    blocks: np.ndarray
    block_best: np.ndarray
    run_best: np.ndarray
    item_of: np.ndarray
    items: list[Item]


def _word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in bytewords.text_slices(pa.array(texts, pa.large_string())):
        words = bytewords.words(data, offsets)
        out += np.split(words.hashes(), words.first[1:-1])
    return out


def segment_terms(items: DataFrame, segment: int) -> DataFrame:
    """key, part (of the item) and term hashes (with repeats) of all segments of ``items`` (key, question, answer)."""

    def run(batches):
        for batch in batches:
            questions, answers = (_word_hashes(batch.column(k).to_pylist()) for k in (1, 2))
            keys, parts, terms = [], [], []
            for key, question, answer in zip(batch.column(0).to_pylist(), questions, answers):
                words = np.concatenate((question, answer))
                pieces = -(-len(words) // segment)
                for part, run_ in enumerate(np.array_split(words, pieces) if pieces else []):
                    keys.append(key)
                    parts.append(part)
                    terms.append(run_.view(np.int64).tolist())
            arrays = [pa.array(keys, pa.int64()), pa.array(parts, pa.int32()), pa.array(terms, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "part", "terms"])

    return over_texts(items.select("key", "question", "answer"), run, "key long, part int, terms array<long>")


def impacts(segments: DataFrame) -> DataFrame:
    """key, part, term and weight: BM25 impacts over all segments, as shares of the segment's score for itself."""
    terms = segments.select("key", "part", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    used = terms.groupBy("key", "part", "length", "term").agg(F.count("*").alias("tf"))
    shape = segments.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    idf = F.log1p((shape.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarity = used.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(shape.mean or 1.0))
    scored = used.join(rarity, "term").withColumn("impact", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    whole = scored.groupBy("key", "part").agg(F.sum("impact").alias("whole"))
    return scored.join(whole, ["key", "part"]).select("key", "part", "term", (F.col("impact") / F.col("whole")).alias("weight"))


def build(postings: pa.Table, items: list) -> Index:
    """An index of collected postings (key, part, term, weight) and items (key, item_id, question, answer)."""
    questions, answers = _word_hashes([x.question for x in items]), _word_hashes([x.answer for x in items])
    known = [Item(x.item_id, q, a) for x, q, a in zip(items, questions, answers)]
    place = {x.key: i for i, x in enumerate(items)}
    owner, part, term = (postings.column(x).to_numpy() for x in ("key", "part", "term"))
    term, weight = term.view(np.uint64), postings.column("weight").to_numpy()
    pairs, segment = np.unique(np.stack((owner, part.astype(np.int64))), axis=1, return_inverse=True)
    segment, count = segment.ravel(), pairs.shape[1]
    order = np.lexsort((segment, term))
    term, segment, weight = term[order], segment[order], weight[order]
    terms, start = np.unique(term, return_index=True)
    start = np.append(start, len(term))
    some = len(term) > 0
    opens = np.append(True, (np.diff(segment // BLOCK) != 0) | (np.diff(term) != 0)) if some else np.zeros(0, bool)
    block_key = np.flatnonzero(opens)
    maybe = np.zeros(1 << 22, bool)
    maybe[(terms >> np.uint64(42)).astype(np.int64)] = True
    best = np.maximum.reduceat(weight, start[:-1]) if some else np.zeros(0)
    block_best = np.maximum.reduceat(weight, block_key) if some else np.zeros(0)
    run_best = np.zeros((len(terms), min(RUNS, max(1, count))), np.float32)
    np.maximum.at(run_best, (np.repeat(np.arange(len(terms)), np.diff(start)), segment * run_best.shape[1] // max(1, count)), weight)
    item_of = np.array([place[k] for k in pairs[0].tolist()], np.int64)
    return Index(
        terms, maybe, best, segment, weight, np.append(block_key, len(term)), np.searchsorted(block_key, start), segment[block_key] // BLOCK, block_best, run_best, item_of, known
    )


def _gather(start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The positions ``start[k]:start[k + 1]`` of all k in ``which``."""
    sizes = start[which + 1] - start[which]
    return np.arange(sizes.sum()) + np.repeat(start[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


def retrieve(index: Index, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All segments whose score for the distinct ``terms`` (numbers) reaches the threshold, and their scores.

    The postings of blocks whose block maxima can't add up to the threshold are not read.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    if index.best[terms].sum() < threshold:
        return none
    entries = _gather(index.block_start, terms)
    bound = np.bincount(index.blocks[entries], index.block_best[entries])
    entries = entries[bound[index.blocks[entries]] >= threshold]
    if not len(entries):
        return none
    at = _gather(index.posting_start, entries)
    score = np.bincount(index.segments[at], index.weights[at])
    found = np.flatnonzero(score >= threshold)
    return found, score[found]


def promising(index: Index, at: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray, threshold: float):
    """(passage, distinct terms) of the passages that can reach the threshold in some run of segments.

    ``at[first[p]:last[p]]`` are the terms of passage p, ``bounds`` what all of them could add up to.
    """
    open_ = np.flatnonzero(bounds >= threshold)
    if not len(open_):
        return
    sizes = last[open_] - first[open_]
    place = np.arange(sizes.sum()) + np.repeat(first[open_] - (np.cumsum(sizes) - sizes), sizes)
    keys = np.unique(np.repeat(np.arange(len(open_)), sizes) * len(index.terms) + at[place])
    owner, terms = np.divmod(keys, len(index.terms))
    cuts = np.searchsorted(owner, np.arange(len(open_) + 1))
    reach = np.add.reduceat(index.run_best[terms], cuts[:-1], axis=0).max(axis=1)
    for k in np.flatnonzero(reach >= threshold - 1e-5).tolist():
        yield int(open_[k]), terms[cuts[k] : cuts[k + 1]]


def overlap(part: np.ndarray, around: np.ndarray, width: int) -> float:
    """Share of the distinct shingles of ``part`` that are in ``around``; a shorter part is one shingle; an empty part is 1."""
    width = min(width, len(part))
    if not width:
        return 1.0
    if len(around) < width:
        return 0.0
    own, there = (np.unique(bytewords.shingle_hashes(x, np.array([0, len(x)]), width)[0]) for x in (part, around))
    return float(np.isin(own, there).mean())


def scan(column: pa.Array, index: Index, *, segment: int, stride: int, threshold: float, width: int, least_question: float, least_answer: float, least_whole: float):
    """(row, item_id, score, question overlap, answer overlap) of verified items, the best passage for each."""
    slack = 1e-9
    for row, _, data, offsets in bytewords.text_slices(column, 1 << 20):
        words = bytewords.words(data, offsets)
        hashes = words.hashes()
        hits = np.flatnonzero(index.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(hits):
            continue
        at = np.minimum(np.searchsorted(index.terms, hashes[hits]), len(index.terms) - 1)
        right = index.terms[at] == hashes[hits]
        hits, at = hits[right], at[right]
        sums = np.zeros(len(hashes) + 1)
        sums[hits + 1] = index.best[at]
        np.cumsum(sums, out=sums)
        counts = np.diff(words.first)
        passages = np.where(counts > 0, np.maximum(1, -(-(counts - segment) // stride)), 0)
        owner = np.repeat(np.arange(len(counts)), passages)
        begin = words.first[:-1][owner] + stride * (np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages))
        end = np.minimum(begin + segment + stride, words.first[1:][owner])
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, terms in promising(index, at, *np.searchsorted(hits, (begin, end)), sums[end] - sums[begin], threshold - slack):
            segments, scores = retrieve(index, terms, threshold - slack)
            for which, value in zip(index.item_of[segments].tolist(), scores.tolist()):
                doc, item = int(owner[p]), index.items[which]
                if found.get((doc, item.item_id), (0.0,))[0] >= value:
                    continue
                reach = len(item.question) + len(item.answer)
                around = hashes[max(words.first[doc], begin[p] - reach) : min(words.first[doc + 1], end[p] + reach)]
                question, answer = overlap(item.question, around, width), overlap(item.answer, around, width)
                together = overlap(np.concatenate((item.question, item.answer)), around, width)
                if (question >= least_question and answer >= least_answer) or together >= least_whole:
                    found[doc, item.item_id] = value, question, answer
        for (doc, item_id), values in found.items():
            yield row + doc, item_id, *values


def _indexes(items: DataFrame, segment: int, index_bytes: int):
    """Broadcast indexes of all items with an id and words, each of about ``index_bytes`` or one share of the items.

    An item is a text of an id: ids that repeat with other texts are searched by each of them.  All texts of an id are
    in one index.
    """
    items = items.filter("item_id is not null").distinct().withColumn("key", F.xxhash64("item_id", "question", "answer"))
    items, postings = items.persist(), impacts(segment_terms(items, segment)).persist()
    try:
        # about what a posting takes in the index, and a byte of the texts that verification needs
        texts = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "question", "answer")))).first()[0] or 0
        parts = max(1, -(-(postings.count() * 64 + texts * 8) // index_bytes))
        shares = items.select("key", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("share"))
        for k in range(parts):
            mine = items.join(shares.filter(F.col("share") == k).select("key"), "key", "left_semi")
            index = build(postings.join(mine.select("key"), "key", "left_semi").toArrow(), mine.collect())
            if len(index.terms):
                yield items.sparkSession.sparkContext.broadcast(index)
    finally:
        postings.unpersist()
        items.unpersist()


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment: int = 40, stride: int = 24, threshold: float = 0.5,
    width: int = 3, least_question: float = 0.5, least_answer: float = 0.5, least_whole: float = 0.8, index_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, item_id, score (of the best passage), question_overlap and answer_overlap of all verified pairs.

    ``items`` has item_id, question and answer; a null or empty answer always agrees; an item without words or id is
    never found; an item id that repeats is found by each of its texts.  A null or empty text has no passage.  Rows that repeat a doc_id
    repeat its pairs.  Items that tie are all returned.  Other columns of either table are ignored.
    """
    options = {"segment": segment, "stride": stride, "threshold": threshold, "width": width, "least_question": least_question, "least_answer": least_answer, "least_whole": least_whole}
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], HITS)
    for index in _indexes(items.select("item_id", "question", "answer"), segment, index_bytes):

        def run(batches, index=index):
            for batch in batches:
                hits = list(scan(batch.column(1), index.value, **options))
                rows, others = [x[0] for x in hits], list(zip(*(x[1:] for x in hits))) or [()] * 4
                kinds = (pa.int64(), *(pa.float64(),) * 3)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(others, kinds))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(over_texts(docs, run, HITS))
    return found


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", segment: int = 40, stride: int = 24, threshold: float = 0.5, width: int = 3,
          least_question: float = 0.5, least_answer: float = 0.5, least_whole: float = 0.8, index_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; no shuffle."""
    options = {"segment": segment, "stride": stride, "threshold": threshold, "width": width, "least_question": least_question, "least_answer": least_answer, "least_whole": least_whole}
    at = docs.columns.index(text_col)
    for index in _indexes(items.select("item_id", "question", "answer"), segment, index_bytes):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in scan(batch.column(at), index.value, **options)]] = False
                yield batch.filter(pa.array(keep))

        docs = over_texts(docs, run, docs.schema)
    return docs


def questions(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, question and answer: the last sentence of a text is its answer; a single sentence has none."""
    cut = r"(?s)^(.*[.!?])\s+(\S.*)$"
    text = F.col(text_col).cast("string")
    two = text.rlike(cut)
    return items.select(
        F.col(id_col).cast("long").alias("item_id"),
        F.when(two, F.regexp_extract(text, cut, 1)).otherwise(text).alias("question"),
        F.when(two, F.regexp_extract(text, cut, 2)).alias("answer"),
    )
