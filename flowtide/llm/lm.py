"""Cross-entropy difference between a target and a background language model.

Both are word bigram models over one vocabulary: all distinct words of the corpus, and one unknown word. The background learns from all
documents, the target from those that ``labels`` marks as good (quality 1, toxic 0). They are matched: same vocabulary, order and
smoothing, and background counts are scaled to the target's number of words. Words and bigrams are told apart by 64-bit hashes. A document
is scored as if it had not been learned from: its own counts are taken out.

The texts are read once and written as chunks of at most CHUNK_CHARS characters: the distinct words of the chunk, and each document as
numbers among them. A chunk sends the counts of its distinct words and bigrams to parts by ranges of their hash; a part adds up what all
chunks have sent and answers each chunk with the totals of just the words and bigrams that it holds. Chunks and answers meet by chunk, where the
documents are scored. A frequent word is one entry of a chunk, so no part is larger than others, and there is a part for every two chunks: all of
it grows with the corpus, and the driver gets only the number of chunks, words and distinct words. The bytes sent grow with the corpus, the number of
messages with its square, as each chunk writes to each part.

Word and bigram counts cover all documents. A document's losses are mean negative natural logarithms per word; score is target loss
minus background loss, so low scores are close to the target.

Cases: a null text or one without a word has 0 tokens and null losses; a null doc_id is never labelled; documents labelled twice count
once; repeated rows are documents of their own, each scored with the others learned from; texts are read whole, a very long one is a chunk of its own;
there are no ties; without target documents the target model is uniform; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, hashed_words, mix, passes, store, table, utf8

#: Dirichlet smoothing towards the unigram model, and of the unigram model itself.
PRIOR, ADD = 20.0, 0.1
#: Characters of the texts of a chunk; a longer text is a chunk of its own. Chunks for each part of the counts.
CHUNK_CHARS, CHUNKS_A_PART = 8_000_000, 2
#: Words of the documents that are scored together.
PASS_WORDS = 500_000
#: Target ids are broadcast up to so many bytes; beyond, documents and ids are joined by a shuffle.
MOST_ID_BYTES = 64 << 20


def packed(values: np.ndarray) -> bytes:
    """An int64 array as bytes; most of its values are small."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")


def _chunked(most: int):
    """(doc_id, text, target) -> one row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            text, target = utf8(batch.column("text")), batch.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False), most):
                hs, ns = [], []
                for lo, hi in passes(pc.utf8_length(text[start:end]).to_numpy(zero_copy_only=False)):
                    words, _, first = hashed_words(text[start + lo : start + hi])
                    hs.append(words)
                    ns.append(np.diff(first))
                distinct, ids = np.unique(np.concatenate(hs), return_inverse=True)
                own = batch.column("doc_id")[start:end]
                docs = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                blobs = [distinct.tobytes(), packed(ids), packed(np.concatenate(ns)), packed(target[start:end])]
                yield pa.record_batch([pa.array([chunk], pa.int64()), docs, *(pa.array([x], pa.binary()) for x in blobs)], names=["chunk", "doc_ids", "words", "ids", "lengths", "target"])
                chunk += 1

    return run


@dataclass
class Chunk:
    """words: sorted hashes; ids: of each word of each document, an index of words; follows: words that have one before them in their document."""

    words: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    target: np.ndarray
    doc: np.ndarray
    follows: np.ndarray

    def pairs(self) -> np.ndarray:
        """Hash of each bigram."""
        before, word = self.words[self.ids[self.follows - 1]], self.words[self.ids[self.follows]]
        return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + word)


def opened(words: bytes, ids: bytes, lengths: bytes, target: bytes) -> Chunk:
    n = unpacked(lengths)
    doc = np.repeat(np.arange(len(n)), n)
    return Chunk(np.frombuffer(words, np.uint64), unpacked(ids), n, unpacked(target).astype(np.bool_), doc, np.flatnonzero(doc[1:] == doc[:-1]) + 1)


def _chunks_in(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for i in range(batch.num_rows):
        yield batch.column("chunk")[i].as_py(), opened(*(batch.column(c)[i].as_py() for c in ("words", "ids", "lengths", "target")))


def _sent(parts: int):
    """The counts of each chunk: kind 0 for words, 1 for bigrams; a row for each part. keys: ascending hashes; n and nt: in all its documents and in those of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, c in _chunks_in(batch):
                good = c.target[c.doc]
                pairs, back = np.unique(c.pairs(), return_inverse=True)
                for kind, keys, at, mine in ((0, c.words, c.ids, good), (1, pairs, back, good[c.follows])):
                    n, nt = np.bincount(at, minlength=len(keys)), np.bincount(at[mine], minlength=len(keys))
                    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    own, first = np.unique(part, return_index=True)
                    ends = np.append(first[1:], len(keys))
                    rows = [(keys[a:b].tobytes(), packed(n[a:b]), packed(nt[a:b])) for a, b in zip(first, ends)]
                    yield from batches_of([pa.array([chunk] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(own.astype(np.int32)), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], ["chunk", "kind", "part", "keys", "n", "nt"], 500)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """What all chunks have sent to a part -> its totals for each chunk, in the order of the chunk's keys; and a row of chunk -1 with the number of distinct keys."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    ends = np.cumsum([len(x) for x in keys])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    out = []
    for name in ("n", "nt"):
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate([unpacked(x) for x in table.column(name).to_pylist()]))
        out.append([packed(total[back[b - len(x) : b]]) for x, b in zip(keys, ends)] + [None])
    kind, part = (table.column(c)[0].as_py() for c in ("kind", "part"))
    rows = len(keys) + 1
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), "kind": pa.array([kind] * rows, pa.int32()), "part": pa.array([part] * rows, pa.int32()),
        "n": pa.array(out[0], pa.binary()), "nt": pa.array(out[1], pa.binary()), "held": pa.array([0] * (rows - 1) + [len(distinct)], pa.int64()),
    })


def _own_counts(doc: np.ndarray, value: np.ndarray, values: int) -> np.ndarray:
    """How often each value (below ``values``) occurs in its document."""
    _, back, n = np.unique(doc.astype(np.int64) * values + value, return_inverse=True, return_counts=True)
    return n[back]


@dataclass
class Models:
    rows: DataFrame  # learned from
    chunks: DataFrame
    answers: DataFrame
    size: int  # of the vocabulary
    words: tuple[int, int]  # of all documents, of the target
    scale: float  # of background counts


def _losses(c: Chunk, lo: int, hi: int, pairs: np.ndarray, single_counts: list[np.ndarray], pair_counts: list[np.ndarray], size: int, totals: tuple[int, int], scales: tuple[float, float]) -> Iterator[np.ndarray]:
    """Loss of each of the words [lo, hi), which are whole documents, under the background and the target model. pairs: of each bigram, its index in pair_counts."""
    ids, doc = c.ids[lo:hi], c.doc[lo:hi]
    a, b = np.searchsorted(c.follows, [lo, hi])
    at, pair_ids = c.follows[a:b] - lo, pairs[a:b]
    own, own_pairs, length = _own_counts(doc, ids, len(c.words)), _own_counts(doc[at], pair_ids, max(1, len(pair_counts[0]))), c.lengths[doc]
    for row, mine in ((0, np.ones(hi - lo, np.bool_)), (1, c.target[doc])):
        single = np.maximum(single_counts[row][ids] - own * mine, 0) * scales[row]
        total = np.maximum(totals[row] - length * mine, 0) * scales[row]
        p = (single + ADD) / (total + ADD * size)
        pair = np.maximum(pair_counts[row][pair_ids] - own_pairs * mine[at], 0) * scales[row]
        p[at] = (pair + PRIOR * p[at]) / (np.maximum(single[at - 1], pair) + PRIOR)
        yield -np.log(p)


def _scored(size: int, totals: tuple[int, int], scale: float):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        row = chunks.combine_chunks().to_batches()[0]
        (_, c), = _chunks_in(row)
        answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
        got = []
        for kind in (0, 1):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            got.append([np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in own.column(name).to_pylist())]) for name in ("n", "nt")])
        pairs = np.unique(c.pairs(), return_inverse=True)[1]
        first = np.append(0, np.cumsum(c.lengths))
        means = np.zeros((2, len(c.lengths)))
        for lo, hi in passes(c.lengths, PASS_WORDS):
            some = lo + np.flatnonzero(c.lengths[lo:hi])
            if len(some):
                for k, loss in enumerate(_losses(c, first[lo], first[hi], pairs, *got, size, totals, (scale, 1.0))):
                    means[k, some] = np.add.reduceat(loss, first[some] - first[lo]) / c.lengths[some]
        none = c.lengths == 0
        return pa.table([row.column("doc_ids").flatten(), pa.array(c.lengths), *(pa.array(x, pa.float64(), mask=none) for x in (means[1], means[0], means[1] - means[0]))], names=names)

    return run


def flagged(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, text, target)."""
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    # a row of a broadcast table takes some 40 bytes beside its id
    if (ids.agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 40)).first()[0] or 0) <= MOST_ID_BYTES:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [(unpacked(n), unpacked(t)) for n, t in zip(batch.column("lengths").to_pylist(), batch.column("target").to_pylist())]
        yield pa.record_batch([pa.array([int(n.sum()) for n, _ in lengths], pa.int64()), pa.array([int((n * t).sum()) for n, t in lengths], pa.int64())], names=["n", "nt"])


def learn(rows: DataFrame) -> Models:
    """rows: of flagged()."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = store(rows.mapInArrow(_chunked(CHUNK_CHARS), f"chunk long, doc_ids array<{kind}>, words binary, ids binary, lengths binary, target binary"), "op2-chunks")
    every = chunks.select("lengths", "target").mapInArrow(_n_words, "n long, nt long").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"), F.sum("nt").alias("nt")).first()
    counts = chunks.select("chunk", "words", "ids", "lengths", "target").mapInArrow(_sent(max(1, -(-every["chunks"] // CHUNKS_A_PART))), "chunk long, kind int, part int, keys binary, n binary, nt binary")
    answers = store(counts.groupBy("kind", "part").applyInArrow(_answered, "chunk long, kind int, part int, n binary, nt binary, held long"), "op2-counts")
    held = answers.where("chunk = -1 and kind = 0").agg(F.sum("held")).first()[0] or 0
    n, nt = every["n"] or 0, every["nt"] or 0
    return Models(rows, chunks, answers, held + 1, (n, nt), nt / n if n and nt else 1.0)


def score(rows: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of flagged(), which models must have been learned from, as own counts are taken out."""
    if rows is not models.rows:
        raise ValueError("score the rows that the models were learned from")
    kind = rows.schema["doc_id"].dataType.simpleString()
    answers = models.answers.where("chunk >= 0").select("chunk", "kind", "part", "n", "nt")
    scored = _scored(models.size, models.words, models.scale)
    return models.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    rows = flagged(table(spark, sf_dir, "documents"), good)
    return score(rows, learn(rows))
