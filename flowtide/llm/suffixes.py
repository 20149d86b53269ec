"""Repeated passages by sparse suffix arrays.

Of all suffixes (in words), only those at minimiser positions are kept: a position whose hash of GRAM words is the least among WINDOW
neighbours. Any passage of at least PASSAGE words that occurs twice starts at most WINDOW - 1 words before such a position, so at least
CORE = PASSAGE - WINDOW + 1 of its words follow it. Suffixes are classed by their first CORE words; classes with one member are
dropped. Each other suffix is sorted among its class by the words after the core, and again by the words before it, reversed. As in
every suffix array, the longest match is with a neighbour in that order, so one comparison on each side gives the longest
extension to the right and to the left. Extensions stop at WINDOW words, since a longer match has another minimiser there; a
document's intervals are then united, and those of at least PASSAGE words are candidates. As a candidate may be put together from matches
with several texts, each of its stretches of PASSAGE words is counted over all candidates, and those that occur twice are united again.

The order is made by range partitioning over (class, context), which also splits hot classes; the two suffixes at each partition edge
are compared in a second step over two rows for each partition. A suffix at the edge of its text is padded with words that match nothing.

Texts that are alike are one text on the way, so a group of copies costs no more than a member; all of its words are repeated, and each of
its rows gets the spans.

Cases: null and short texts have no passages; a passage that occurs twice within one document counts; rows alike in doc_id and text are
copies like others and each get all spans; a null doc_id is a value like others; ties (equal contexts) match as far as contexts go; empty
tables give empty results; texts are read whole, a very long one in a pass of its own of about ten times its size; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, batches_of, hashed_words, mix, numbered, passes, store, table, utf8, with_row

PASSAGE, WINDOW, GRAM = 50, 16, 4
CORE = PASSAGE - WINDOW + 1


def minimisers(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions (ascending) of the least hash of ``gram`` words in any ``window`` successive ones, the last of equals."""
    n = len(words)
    if n < gram + window - 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - gram + 1 + j]
    h = mix(h)
    # the last position in the low bits breaks ties
    least, span = (h & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64) % np.uint64(1 << 24)), 1
    while span < window:  # least of 2 * span, then of window
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    start = np.arange(len(least))
    doc = np.searchsorted(first, start, side="right") - 1
    inside = start + window + gram - 1 <= first[doc + 1]
    start, least = start[inside], least[inside]
    low = np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))
    at = start + ((low.astype(np.int64) - start) % (1 << 24))
    return np.unique(at)


def cores(words: np.ndarray, at: np.ndarray, core: int) -> np.ndarray:
    """Hash of the ``core`` words from each position."""
    h = np.zeros(len(at), np.uint64)
    for j in range(core):
        h = h * np.uint64(0xD1B54A32D192ED03) + words[at + j]
    return mix(h)


def _suffixes(texts: pa.Array):
    """(word hashes, first word of each text and the end, kept positions, their text)."""
    words, _, first = hashed_words(texts)
    at = minimisers(words, first)
    doc = np.searchsorted(first, at, side="right") - 1
    fits = at + CORE <= first[doc + 1]
    return words, first, at[fits], doc[fits]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = utf8(batch.column("text"))
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
            words, first, at, doc = _suffixes(text[lo:hi])
            own = pa.array(doc + lo)
            yield from batches_of([pa.array(cores(words, at, CORE).view(np.int64)), batch.column("th").take(own), pa.array((at - first[doc]).astype(np.int32))], ["core", "th", "pos"], 20_000)


def _context(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, step: int) -> list[bytes]:
    """WINDOW words from ``at`` in direction ``step`` as big-endian 32-bit hashes, 0 beyond [lo, hi)."""
    out = np.zeros((len(at), WINDOW), ">u4")
    for j in range(WINDOW):
        p = at + step * j
        ok = (p >= lo) & (p < hi)
        out[ok, j] = (words[p[ok]] >> np.uint64(32)) | np.uint64(1)
    return [r.tobytes() for r in out]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = utf8(batch.column("text"))
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
            words, _, first = hashed_words(text[lo:hi])
            lists = batch.column("at")[lo:hi]
            pos = np.asarray(lists.flatten(), np.int64)
            doc = np.repeat(np.arange(hi - lo), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = first[doc] + pos
            edges = first[doc], first[doc + 1]
            own = pa.array(doc + lo)
            yield from batches_of([pa.array(cores(words, at, CORE).view(np.int64)), batch.column("th").take(own), pa.array(pos.astype(np.int32)), pa.array(_context(words, *edges, at + CORE, 1), pa.binary()), pa.array(_context(words, *edges, at - 1, -1), pa.binary())], ["core", "th", "pos", "right", "left"])


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and b; padding (0) matches nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in order -> the longest match of each with its neighbours; first and last rows also carry their context, to be compared across partitions."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None  # the last row, whose next neighbour is not known yet
    began = False

    def emit(rows, lcp, edge):
        keys = pa.array(edge, pa.int32())
        ctx = pa.array([c if e else None for c, e in zip(rows.column("ctx").to_pylist(), edge)], pa.binary())
        return pa.record_batch([*(rows.column(c) for c in ("core", "th", "pos")), pa.array(lcp.astype(np.int32)), pa.array([part] * rows.num_rows, pa.int32()), keys, ctx], names=["core", "th", "pos", "lcp", "part", "edge", "ctx"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
        n = rows.num_rows
        ctx = np.frombuffer(b"".join(rows.column("ctx").to_pylist()), ">u4").reshape(n, WINDOW)
        core = rows.column("core").to_numpy()
        pair = np.where(core[1:] == core[:-1], common_words(ctx[1:], ctx[:-1]), -1)
        lcp = np.full(n, -1, np.int64)
        lcp[1:] = pair
        lcp[:-1] = np.maximum(lcp[:-1], pair)
        if held is not None:
            lcp[0] = max(lcp[0], held[1])
        edge = [0] * n
        if not began:
            edge[0] = 1
        elif held is not None and held[2]:
            edge[0] = 1
        began = True
        if n > 1:
            yield emit(rows.slice(0, n - 1), lcp[:-1], edge[:-1])
        held = (rows.slice(n - 1, 1), int(lcp[-1]), edge[-1])
    if held is not None:
        yield emit(held[0], np.array([held[1]]), [3 if held[2] else 2])


def _extension(suffixes: DataFrame, context: str) -> DataFrame:
    """(core, th, pos, lcp) of each suffix, lcp its longest match of ``context`` with another member of its class."""
    rows = suffixes.select("core", "th", "pos", F.col(context).alias("ctx"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "core", "ctx", "th", "pos").sortWithinPartitions("core", "ctx", "th", "pos")
    out = store(ordered.mapInArrow(_neighbours, "core long, th long, pos int, lcp int, part int, edge int, ctx binary"), f"op3-{context}")
    ends = out.where("edge > 0")
    w = Window.orderBy("part", F.col("edge") == 2, "edge")  # two rows for each partition at most
    sides = ends.withColumns({"pc": F.lag("core").over(w), "px": F.lag("ctx").over(w), "nc": F.lead("core").over(w), "nx": F.lead("ctx").over(w)})
    hexes = lambda x, y: F.greatest(*[F.when((F.substring(x, 1, 4 * k) == F.substring(y, 1, 4 * k)) & (F.hex(F.substring(x, 4 * k - 3, 4)) != "00000000"), k).otherwise(0) for k in range(1, WINDOW + 1)])
    match = lambda c, x: F.when(F.col(c) == F.col("core"), hexes("ctx", x)).otherwise(-1)
    fixed = sides.withColumn("lcp", F.greatest("lcp", match("pc", "px"), match("nc", "nx")))
    keep = ["core", "th", "pos", "lcp"]
    return out.where("edge = 0").select(*keep).unionByName(fixed.select(*keep))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, spans: list of (s, core, e), or of (s, core) if all have PASSAGE words) -> one row for each united interval of at least PASSAGE words."""
    for batch in batches:
        lists = batch.column("spans")
        own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        spans = lists.flatten()
        s, core = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        e = spans.field(2).to_numpy(zero_copy_only=False).astype(np.int64) if spans.type.num_fields > 2 else s + PASSAGE
        order = np.lexsort((s, own))
        own, s, e, core = own[order], s[order], e[order], core[order]
        reach = np.maximum.accumulate(e + (own << 40)) - (own << 40)  # the end of all intervals of the text so far
        begins = np.ones(len(s), np.bool_)
        begins[1:] = (own[1:] != own[:-1]) | (s[1:] > reach[:-1])
        first = np.flatnonzero(begins)
        if len(first):
            end, least = np.maximum.reduceat(e, first), np.minimum.reduceat(core, first)
            long = end - s[first] >= PASSAGE
            first, end, least = first[long], end[long], least[long]
        else:
            end = least = first
        yield pa.record_batch([batch.column("th").take(pa.array(own[first])), pa.array(s[first].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(least)], names=["th", "start_word", "end_word", "passage"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each PASSAGE words in the candidates of each text; a text with copies is a candidate as a whole."""
    for batch in batches:
        text, copied = utf8(batch.column("text")), batch.column("copied").to_pylist()
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
            words, _, first = hashed_words(text[lo:hi])
            spans = []
            for i, own in enumerate(batch.column("at")[lo:hi].to_pylist()):
                n = int(first[i + 1] - first[i])
                spans += [(i, 0, n)] if copied[lo + i] and n >= PASSAGE else [(i, x["start_word"], x["end_word"]) for x in own or ()]
            doc = np.repeat([i for i, _, _ in spans], [e - s - PASSAGE + 1 for _, s, e in spans]).astype(np.int64)
            pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e - PASSAGE + 1) for _, s, e in spans)])
            own = pa.array(doc + lo)
            yield from batches_of([pa.array(cores(words, first[doc] + pos, PASSAGE).view(np.int64)), batch.column("th").take(own), batch.column("copied").take(own), pa.array(pos.astype(np.int32))], ["stretch", "th", "copied", "pos"], 20_000)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, ROW, start_word, end_word, passage) for each repeated passage of each row; passage: the least hash of PASSAGE words in it."""
    keyed = numbered(docs).select("doc_id", "text", ROW, F.xxhash64("text").alias("th")).where("text is not null")
    second = F.xxhash64(F.lit(7), "text", F.length("text"))
    for _ in range(8):
        heads = store(keyed.groupBy("th").agg(F.min(ROW).alias(ROW), (F.count("*") > 1).alias("copied"), (F.min(second) != F.max(second)).alias("met")), "op3-heads")
        met = [r.th for r in heads.where("met").select("th").collect()]  # pairs of texts that share 64 bits: texts ** 2 / 2 ** 65 are to be expected
        if not met:
            break
        keyed = keyed.withColumn("th", F.when(F.col("th").isin(met), second).otherwise(F.col("th")))
    heads = heads.drop("met")
    kept = store(keyed.mapInArrow(_kept, "core long, th long, pos int"), "op3-suffixes")
    place = F.xxhash64("th", "pos")
    # written, so that the join below shuffles both sides for itself and Spark can split the classes that are very large
    repeated = store(kept.groupBy("core").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("core"), "op3-repeated")
    found = kept.join(repeated, "core").groupBy("th").agg(F.collect_set("pos").alias("at"))
    texts = keyed.drop("th").join(found.join(heads, "th"), ROW).select("th", "text", "at")
    suffixes = store(texts.mapInArrow(_contexts, "core long, th long, pos int, right binary, left binary"), "op3-members")
    right, left = _extension(suffixes, "right"), _extension(suffixes, "left")
    spans = right.select("core", "th", "pos", F.col("lcp").alias("r"), F.lit(0).alias("l")).unionByName(left.select("core", "th", "pos", F.lit(0).alias("r"), F.col("lcp").alias("l")))
    each = spans.groupBy("th", "pos", "core").agg(F.max("r").alias("r"), F.max("l").alias("l")).where("r >= 0 and l >= 0")
    one = F.struct((F.col("pos") - F.col("l")).alias("s"), "core", (F.col("pos") + CORE + F.col("r")).alias("e"))
    lists = each.groupBy("th").agg(F.collect_list(one).alias("spans"))
    united = lists.mapInArrow(_united, "th long, start_word int, end_word int, passage long")
    candidates = united.groupBy("th").agg(F.collect_list(F.struct("start_word", "end_word")).alias("at"))
    candidates = heads.join(candidates, "th", "left").where("copied or at is not null")
    texts = keyed.drop("th").join(candidates, ROW).select("th", "text", "copied", "at")
    stretches = store(texts.mapInArrow(_stretches, "stretch long, th long, copied boolean, pos int"), "op3-stretches")
    often = F.sum(F.when(F.col("copied"), 2).otherwise(1))  # a place is one row, so rows are occurrences
    twice = store(stretches.groupBy("stretch").agg(often.alias("n")).where("n > 1").select("stretch"), "op3-twice")
    held = stretches.join(twice, "stretch").groupBy("th")
    runs = held.agg(F.collect_list(F.struct(F.col("pos").alias("s"), F.col("stretch").alias("core"))).alias("spans"))
    found = store(runs.mapInArrow(_united, "th long, start_word int, end_word int, passage long"), "op3-spans")
    return keyed.select("doc_id", ROW, "th").join(found, "th").drop("th")


def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(with_row(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "passage")
