"""Hard-negative mining by exact inner products over a vector-approximation file.

Components become integers (``floor(scale * x)``).  Each dimension is cut into cells at quantiles of a bounded sample, and a
vector is approximated by its cells, two dimensions a code (``codes``), which lie beside the vector in one written table.
A query prices all cells once: a table of the largest, and one of the smallest, that a cell can add to its inner
product; a vector's bounds are sums of lookups.  Only vectors whose bounds say that they may enter a window are scored.

Queries (anchors) are sent to all rows in blocks of bounded size, one scan a block, and each task returns at most
``k`` rows a window; these meet by window.  Two scans a block: the ``k`` first rows of an anchor's label (its positives),
then for each positive the ``k`` first rows of other labels between ``low`` and ``high`` percent of its score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint_dir, written
from .vector_codes import matrix, whole_numbers

#: Cells a dimension; two of them make a code below 1,024.
CELLS = 32
#: Rows whose components place the cells, bytes of anchors sent to the executors at once, rows looked at together.
SAMPLE, BLOCK_BYTES, ROWS = 10_000, 16 << 20, 8192
#: Beyond all scores.
NEVER = np.iinfo(np.int64).max


@dataclass
class Cells:
    """Inner borders of each dimension's cells, and the smallest and largest component of all rows in each dimension."""

    borders: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, ceil(dimensions / 2)) of uint16: the cells of two neighbouring dimensions."""
        cells = np.stack([np.searchsorted(b, vectors[:, d], "right") for d, b in enumerate(self.borders[: vectors.shape[1]])], axis=1)
        if cells.shape[1] % 2:
            cells = np.concatenate([cells, np.zeros((len(cells), 1), cells.dtype)], axis=1)
        return (cells[:, ::2] * CELLS + cells[:, 1::2]).astype(np.uint16)

    def prices(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables (dimension, cell) of the least and the most that a cell adds to the anchor's inner product."""
        n = len(anchor)
        first = np.concatenate([self.least[:n, None], self.borders[:n]], axis=1)  # cell c holds first[c] .. last[c]
        last = np.concatenate([self.borders[:n] - 1, self.most[:n, None]], axis=1)
        a, b = anchor[:, None] * first, anchor[:, None] * np.maximum(first, last)
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (low, high) if n % 2 == 0 else tuple(np.concatenate([x, np.zeros((1, CELLS), np.int64)]) for x in (low, high))


def bound(prices: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of lookups; ``codes`` is (code place, rows).  For many rows the prices of all codes are made first."""
    out = np.zeros(codes.shape[1], np.int64)
    if codes.shape[1] < CELLS * CELLS:
        for place, code in enumerate(codes):
            out += prices[2 * place].take(code // CELLS) + prices[2 * place + 1].take(code % CELLS)
    else:
        for place, code in enumerate(codes):
            out += (prices[2 * place][:, None] + prices[2 * place + 1]).ravel().take(code)
    return out


def extents(rows: DataFrame) -> list:
    """d, n, least and most: how many rows (v) have a dimension, and the ends of its components."""

    def run(batches):
        found: dict[int, list[int]] = {}
        for batch in batches:
            for mine, v in by_length(batch.column(0)):
                for d, (least, most) in enumerate(zip(v.min(0).tolist(), v.max(0).tolist())):
                    n, a, b = found.get(d, (0, least, most))
                    found[d] = [n + len(mine), min(a, least), max(b, most)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(found), *zip(*found.values()))], ["d", "n", "least", "most"])

    ends = rows.select("v").mapInArrow(run, "d long, n long, least long, most long").groupBy("d")
    return ends.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()


def fit_cells(rows: DataFrame, ends: list, sample: int = SAMPLE) -> Cells:
    """Cells from at most ``sample`` rows (v) and the ``extents`` of all.

    Where the borders lie decides how much is scored, never what is found: the outer cells reach to the ends.
    """
    some = rows.select("v").sample(min(1.0, 2 * sample / ends[0].n), seed=7).limit(sample).collect()
    least, most = (np.array([r[k] for r in ends], np.int64) for k in ("least", "most"))
    borders = np.zeros((len(ends), CELLS - 1), np.int64)
    for d in range(len(ends)):
        seen = np.sort(np.array([r.v[d] for r in some if len(r.v) > d] or [least[d]], np.int64))
        borders[d] = seen[(np.arange(1, CELLS) * len(seen)) // CELLS]
    return Cells(borders, least, most)


def approximation_file(vectors: DataFrame, *, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> tuple[DataFrame, Cells] | None:
    """A written table (vec_id, label, v, codes) of the rows that take part, and its cells; None if none does.

    Rows with a null id, label or vector, a null or non-finite component, or no component take no part; other columns are
    ignored.  Components so large that an inner product leaves 64 bits are an error.
    """
    rows = whole_numbers(vectors, scale, id_col, vector_col, label_col).filter("vec_id is not null and label is not null and size(v) > 0")
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), "v")
    ends = extents(rows)
    if not ends:
        return None
    if len(ends) * max(max(-r.least, r.most) for r in ends) ** 2 >= 1 << 62:
        raise ValueError("components are too large for inner products of 64 bits")
    cells = fit_cells(rows, ends, sample)

    def run(batches):
        for batch in batches:
            codes = [b""] * batch.num_rows
            for mine, v in by_length(batch.column(2)):
                for i, c in zip(mine.tolist(), cells.codes(v)):
                    codes[i] = c.tobytes()
            yield batch.append_column("codes", pa.array(codes, pa.binary()))

    return written(rows.mapInArrow(run, "vec_id long, label long, v array<long>, codes binary")), cells


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their vectors) for each length of vectors in a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        yield mine, matrix(column if len(mine) == len(column) else column.take(pa.array(mine)))


@dataclass
class Best:
    """The ``k`` first (score, id) pairs of a window so far, by score downwards and then id; repeated rows are kept."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """A score below this can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else -NEVER

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


class Scan:
    """What a task knows of one anchor: its prices and its windows (``floor`` to ``ceiling`` in score)."""

    def __init__(self, cells: Cells, anchor: Anchor, k: int, same_label: bool):
        self.anchor, self.same_label, self.scored = anchor, same_label, 0
        self.low, self.high = cells.prices(anchor.v)
        self.windows = [(floor, ceiling, Best(k)) for floor, ceiling in anchor.windows]

    def see(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: np.ndarray) -> None:
        """Rows of the anchor's length; ``codes`` is (code place, rows)."""
        mine = labels == self.anchor.label
        mine = np.flatnonzero(mine & (ids != self.anchor.vec_id) if self.same_label else ~mine)
        needed = min(max(floor, best.least) for floor, _, best in self.windows)
        top = bound(self.high, codes[:, mine])
        mine, top = mine[top >= needed], top[top >= needed]
        bottom = bound(self.low, codes[:, mine])
        may = np.zeros(len(mine), bool)
        for floor, ceiling, best in self.windows:
            inside = (bottom >= floor) & (top <= ceiling)  # surely in this window: its k-th is not below theirs
            sure = np.partition(bottom[inside], -best.k)[-best.k] if int(inside.sum()) >= best.k else -NEVER
            may |= (bottom <= ceiling) & (top >= max(floor, best.least, sure))
        mine = mine[may]
        self.scored += len(mine)
        scores, ids = v[mine] @ self.anchor.v, ids[mine]
        for floor, ceiling, best in self.windows:
            fit = (scores >= max(floor, best.least)) & (scores <= ceiling)
            best.add(scores[fit], ids[fit])


@dataclass
class Anchor:
    vec_id: int
    label: int
    v: np.ndarray
    windows: list[tuple[int, int]]


FOUND = "anchor long, window int, vec_id long, score long"


def search(rows: DataFrame, cells: Cells, shared: Broadcast, k: int, same_label: bool) -> DataFrame:
    """anchor (its place in ``shared``), window, rank, vec_id and score of the first ``k`` rows of each window, by one scan of ``rows``."""

    def run(batches):
        scans = [Scan(cells, a, k, same_label) for a in shared.value]
        for batch in batches:
            every_id, every_label = (batch.column(i).to_numpy() for i in (0, 1))
            for mine, v in by_length(batch.column(2)):
                packed = b"".join(x.as_buffer().to_pybytes() for x in batch.column(3).take(pa.array(mine)))
                codes = np.frombuffer(packed, np.uint16).reshape(len(mine), -1)
                for start in range(0, len(mine), ROWS):
                    part = slice(start, start + ROWS)
                    across = np.ascontiguousarray(codes[part].T).astype(np.intp)
                    for scan in scans:
                        if len(scan.anchor.v) == v.shape[1]:
                            scan.see(every_id[mine[part]], every_label[mine[part]], v[part], across)
        held = [(a, w, best) for a, scan in enumerate(scans) for w, (*_, best) in enumerate(scan.windows) if len(best.ids)]
        if held:
            sizes = [len(best.ids) for *_, best in held]
            which, window = (np.repeat([h[i] for h in held], sizes) for i in (0, 1))
            ids, scores = np.concatenate([h[2].ids for h in held]), np.concatenate([h[2].scores for h in held])
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(window, pa.int32()), pa.array(ids), pa.array(scores)], ["anchor", "window", "vec_id", "score"])

    found = rows.select("vec_id", "label", "v", "codes").mapInArrow(run, FOUND)
    first = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, cells: Cells, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of ``anchors`` (rows of the approximation file) among ``rows`` of the same file.

    An anchor's positives are its first rows of the same label, ids equal to its own left out.  A positive's negatives are the
    first rows of other labels with ``low * positive <= 100 * negative <= high * positive``; where the positive's score is
    negative there are none.  Scores count downwards, ties by smaller id; repeated rows count each.  Vectors of another
    length than an anchor's have no score with it.  Anchors go to the executors, and their positives to the driver, in
    blocks of ``block_bytes``; a block is two scans.
    """
    spark = rows.sparkSession
    size = anchors.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    blocks, folder, some = max(1, -(-size // block_bytes)), f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}", False
    for b in range(blocks):
        block = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "label", "v").collect()
        every = [Anchor(r.vec_id, r.label, np.array(r.v, np.int64), [(-NEVER, NEVER)]) for r in block]
        shared, told = spark.sparkContext.broadcast(every), {}
        for r in search(rows, cells, shared, positives, True).orderBy("anchor", "rank").collect() if every else ():
            floor, ceiling = -(-low * r.score // 100), high * r.score // 100
            if floor <= ceiling:
                told.setdefault(r.anchor, []).append((r.vec_id, r.score, floor, ceiling))
        shared.destroy()
        if not told:
            continue
        shared = spark.sparkContext.broadcast([Anchor(every[a].vec_id, every[a].label, every[a].v, [x[2:] for x in found]) for a, found in told.items()])
        names = [(k, w, every[a].vec_id, x[0], x[1]) for k, (a, found) in enumerate(told.items()) for w, x in enumerate(found)]
        windows = spark.createDataFrame(names, "anchor long, window int, anchor_id long, positive_id long, positive_score long")
        met = search(rows, cells, shared, negatives, False).join(F.broadcast(windows), ["anchor", "window"])
        met = met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        met.write.parquet(f"{folder}/block={b}")
        shared.destroy()
        some = True
    return spark.read.schema(NEGATIVES).parquet(folder).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") if some else spark.createDataFrame([], NEGATIVES)


def oracle_sql() -> str:
    whole = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))"
    score = "CAST(list_sum(list_transform(list_zip({0}.v, {1}.v), lambda z: z[1] * z[2])) AS BIGINT)"
    return f"""
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {whole}),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, {score.format('a', 'r')} AS score FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
met AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank, row_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM met WHERE rank <= 5
"""
