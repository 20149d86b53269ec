"""Hard negatives for anchors, by a secondary-sort shuffle of packed score keys.

For each anchor and each of its best POSITIVES rows of the same label, the best NEGATIVES rows of other labels whose score lies between LOW and
HIGH hundredths of the positive's. A score is the inner product of whole-number vectors; higher scores come first, equal ones by smaller id.

Method: a score of a pair is packed into one key of bytes, (anchor, descending score, kind, id), in byte order the order wanted.
repartitionAndSortWithinPartitions deals the keys by anchor and sorts them; an iterator reads an anchor's keys from the best score down, opens
a window for each of the first positives, gives each negative to the windows that it lies in, and forgets all at the next anchor. As a window lies
below its positive, one reading is enough; a positive of score 0 and its negatives, also of score 0, are in order by kind. An anchor is
never held: the state is POSITIVES windows.

Before the shuffle keys are reduced where they are made. Rows are dealt by hash into chunks of about ROWS; each anchor visits each chunk once,
in batches, and leaves its best POSITIVES rows of its label there. These keys, sorted as above, give each anchor's positives. Then anchors visit the
chunks again with their windows, and leave for each window its best NEGATIVES rows of a chunk. So a chunk sends at most
POSITIVES * (1 + NEGATIVES) keys for an anchor, however many rows score alike, and nothing is lost: a row outside the best of its chunk is outside
the best of all. In a chunk rows lie by label, so positives cost only the rows of a label, and a label with a third of all rows is spread like others.

Cases: rows with a null label or vector, or with a null, infinite or NaN component, take no part; a null id is no anchor and comes last among equal
scores; rows alike are rows of their own, each a positive or negative of the others and, if their id makes them so, an anchor each; of
vectors of different length the missing components are 0; sums beyond 2**53 are made with whole numbers, beyond 2**63 they are an error; positives of
a score below 0 have no window; an empty table, no anchor or one label only give no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a chunk, about, and the fewest for which another chunk is made; scores that a task holds at once.
ROWS, FEWEST, SCORES = 65_536, 1_024, 1 << 22
#: anchor: its id and number; then the score from the best down, the kind (0: same label), whether the id is null, the id.
KEY = struct.Struct(">QQQBBQ")
HALF = 1 << 63
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(embedding: str = "embedding", unit: int = 256) -> Column:
    """floor(unit * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(F.lit(unit) * x.cast("double")))


def finite(embedding: str = "embedding") -> Column:
    """The vector is there, and so is each component, as a finite number."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(embedding).isNotNull() & F.forall(embedding, lambda x: F.coalesce(good(x.cast("double")), F.lit(False)))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tables of whole numbers, exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    bound = largest(a) * largest(b) * max(width, 1)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < HALF:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and not -HALF <= exact.min() <= exact.max() < HALF:
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, the shorter ones filled with 0."""
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(length.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best(score: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``count`` highest allowed scores of each row, of equals the first columns."""
    left = np.where(allowed, score, np.int64(-HALF))
    at, rows, columns = np.arange(len(left)), [], []
    for _ in range(min(count, left.shape[1])):
        top = left.argmax(axis=1)
        there = allowed[at, top]
        if not there.any():
            break
        rows.append(at[there])
        columns.append(top[there])
        allowed[at[there], top[there]] = False
        left[at[there], top[there]] = -HALF
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(rows or empty), np.concatenate(columns or empty)


class _Chunk:
    """The rows of one chunk, by label, then id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: whole.column(name).combine_chunks() if whole.column(name).num_chunks != 1 else whole.column(name).chunk(0)
        self.vectors, self.label, self.no = matrix(column("vector")), column("label").to_numpy(), column("no").to_numpy()
        self.null, ids = np.asarray(column("vec_id").is_null()), column("vec_id").fill_null(0).to_numpy()
        self.id = ids.astype(np.int64)

    def found(self, anchors: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, kind, score, null, id) of the rows that a batch of anchors takes here: anchors without windows take positives."""
        windows = anchors.column("windows")
        seek = np.asarray(windows.is_null())
        label, no = anchors.column("label").to_numpy(), anchors.column("no").to_numpy()
        vectors = matrix(anchors.column("vector"))
        step = max(1, SCORES // max(1, len(self.label)))
        for value in np.unique(label):
            own = np.flatnonzero(label == value)
            lo, hi = np.searchsorted(self.label, value, "left"), np.searchsorted(self.label, value, "right")
            if not seek[own[0]]:
                other = np.concatenate([np.arange(lo), np.arange(hi, len(self.label))])
                # by id, so that the first of equal scores is the one of least id
                other = other[np.lexsort((self.id[other], self.null[other]))]
                others = self.vectors[other]
            for k in range(0, len(own), step):
                some = own[k : k + step]
                if seek[own[0]]:
                    yield from self._positives(some, vectors[some], no[some], lo, hi)
                else:
                    yield from self._negatives(some, scores(vectors[some], others), windows.take(pa.array(some)).to_pylist(), other)

    def _positives(self, some, vectors, no, lo, hi):
        score = scores(vectors, self.vectors[lo:hi])
        rows, columns = best(score, self.no[lo:hi] != no[:, None], POSITIVES)
        yield from zip(some[rows].tolist(), [0] * len(rows), score[rows, columns].tolist(), self.null[lo + columns].tolist(), self.id[lo + columns].tolist())

    def _negatives(self, some, score, windows, other):
        taken = set()
        for w in range(max(map(len, windows))):
            # a window of whole numbers: LOW * positive <= 100 * score <= HIGH * positive; without a positive it is empty
            top = [x[w] if w < len(x) else -1 for x in windows]
            least, most = np.array([[-(-LOW * x // 100), HIGH * x // 100] if x >= 0 else [1, 0] for x in top]).T[:, :, None]
            rows, columns = best(score, (score >= least) & (score <= most), NEGATIVES)
            taken.update(zip(rows.tolist(), columns.tolist()))
        for r, c in sorted(taken):
            yield int(some[r]), 1, int(score[r, c]), bool(self.null[other[c]]), int(self.id[other[c]])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (chunk, anchors last) -> packed keys."""
    held, rows, number = [], None, None
    for batch in batches:
        chunk, anchor = batch.column("chunk").to_numpy(), np.asarray(batch.column("is_anchor"))
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (anchor[1:] != anchor[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(chunk)]):
            if hi == lo:
                continue
            if chunk[lo] != number:
                held, rows, number = [], None, chunk[lo]
            part = batch.slice(lo, hi - lo)
            if not anchor[lo]:
                held.append(part)
                continue
            if not held:  # an anchor in a chunk without rows
                continue
            rows = rows or _Chunk(held)
            ids, no = part.column("vec_id").to_numpy(), part.column("no").to_numpy()
            keys = [packed(int(ids[i]), int(no[i]), score, kind, null, other) for i, kind, score, null, other in rows.found(part)]
            yield pa.record_batch([pa.array(keys, pa.binary())], names=["key"])


def packed(anchor_id: int, number: int, score: int, kind: int, null: bool, other: int) -> bytes:
    return KEY.pack(anchor_id + HALF, number, HALF - 1 - score, kind, null, other + HALF)


def unpacked(key: bytes) -> tuple[int, int, int, int, int | None]:
    """(anchor id, anchor number, score, kind, id)."""
    anchor, number, score, kind, null, other = KEY.unpack(key)
    return anchor - HALF, number, HALF - 1 - score, kind, None if null else other - HALF


def _first_positives(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """Sorted keys -> (anchor number, score, key) of each anchor's first positives."""
    number, n = None, 0
    for key, _ in keys:
        _, own, score, _, _ = unpacked(key)
        number, n = own, (n + 1 if own == number else 1)
        if n <= POSITIVES:
            yield own, score, key


def _mined(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """Sorted keys -> result rows; the windows of one anchor are all that is held."""
    number, windows = None, []
    for key, _ in keys:
        anchor, own, score, kind, other = unpacked(key)
        if own != number:
            number, windows = own, []
        if kind == 0:
            windows.append([other, score, 0])
            continue
        for w in windows:
            if w[2] < NEGATIVES and LOW * w[1] <= 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score


def sorted_keys(keys: DataFrame, parts: int):
    """keys (key binary) as an RDD dealt by anchor and sorted in each partition."""
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))


def _keys(rows: DataFrame, anchors: DataFrame, chunks: int, parts: int) -> DataFrame:
    """(key) of what each anchor takes from each chunk."""
    columns = ["no", "vec_id", "label", "vector"]
    placed = rows.select(F.pmod(F.xxhash64("no"), F.lit(chunks).cast("long")).alias("chunk"), F.lit(False).alias("is_anchor"), *columns, F.lit(None).cast("array<long>").alias("windows"))
    visits = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(True).alias("is_anchor"), *columns, "windows")
    order = ["chunk", "is_anchor", "label", F.col("vec_id").asc_nulls_last()]
    return placed.unionByName(visits).repartition(parts, "chunk").sortWithinPartitions(*order).mapInArrow(_visits, "key binary")


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """RESULT rows. rows: (vec_id, label, vector of whole numbers) without nulls in label and vector; anchor: which of them are anchors."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = store(rows.select(F.monotonically_increasing_id().alias("no"), "vec_id", F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("chosen")), "op13-rows")
    n = numbered.count()
    chunks = max(1, -(-n // ROWS), min(parts, n // FEWEST))
    anchors = numbered.where("chosen").drop("chosen")
    seeking = _keys(numbered, anchors.withColumn("windows", F.lit(None).cast("array<long>")), chunks, parts)
    first = sorted_keys(seeking, parts).mapPartitions(_first_positives)
    positives = store(spark.createDataFrame(first, "no long, score long, key binary", verifySchema=False), "op13-positives")
    windows = positives.groupBy("no").agg(F.sort_array(F.collect_list("score"), asc=False).alias("windows"))  # POSITIVES scores at most
    negatives = _keys(numbered, anchors.join(windows, "no"), chunks, parts)
    mined = sorted_keys(positives.select("key").unionByName(negatives), parts).mapPartitions(_mined)
    return spark.createDataFrame(mined, RESULT, verifySchema=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label is not null").where(finite())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), whole().alias("vector")), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.no AS anchor, a.vec_id AS anchor_id, b.no, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.no <> b.no WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.no ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.no ORDER BY s.score DESC, s.id) <= 3
"""
