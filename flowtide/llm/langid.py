"""Language identification of whole texts and of spans inside them.

Words are runs of letters. Letter trigrams (with word edges) give each word a log-likelihood for every learned language. The script of
a word's first letter narrows the candidates to the languages that were seen to use it. Viterbi with a fixed penalty for switching
labels the words; neighbouring words with one label are a span. A text's language is the one that holds most letters, its score
their share.

Learning: counts of trigram buckets by language, from about TRAIN_ROWS labelled rows at most. The bound is dealt over the languages: one that
has no more rows than its part is learned from all of them, of another so many are chosen by a hash of id and text, and its row of the least
hash in any case, so that every label is learned. Rows alike are learned from once where rows are chosen.
Viterbi runs over many texts at once, one step for each word position.

Cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; without labelled rows every text is ``und``; ties go
to the language first in code-point order; repeated rows give repeated rows; a null id is a value like others, and its rows are never held
out; texts are read whole, a very long one in a run of its own of about twenty times its size; empty tables give empty results; extra columns are ignored, or kept by
known_only(). Span offsets count characters of the lower-cased text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PASS_CHARS, batches_of, char_class, code_points, kept_rows, passes, pieces, table, utf8, word_spans

#: Labelled rows that are learned from, about, whatever the size of the table.
TRAIN_ROWS = 20_000
#: Labels that are learned: the most frequent ones, ties by name. The model takes a quarter of a megabyte for each.
MOST_LABELS = 512
BITS = 16
SMOOTHING = 0.5
SWITCH = 12.0
#: A language uses a script if it holds this share of its letters.
SCRIPT_SHARE = 0.005
BARRED = 1e4
#: Characters of the texts that one run of Viterbi labels.
VITERBI_CHARS = 6_000_000

#: Script ranges (fixed values).
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_EDGES = np.array([x for _, lo, hi in SCRIPTS for x in (lo, hi + 1)])
_KINDS = np.array([x for name, _, _ in SCRIPTS for x in (NAMES.index(name), 0)], np.uint8)


def script_of(cps: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_EDGES, cps, side="right") - 1
    return np.where(at >= 0, _KINDS[np.maximum(at, 0)], 0)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (buckets, langs)
    allowed: np.ndarray  # (scripts, langs)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _trigrams(texts: pa.Array):
    """(bucket of each letter's trigram, first letter of each word, words' spans in characters, text of each word, text starts, script of each word)."""
    cps, starts = code_points(pc.utf8_lower(texts))
    first, end, doc = word_spans(char_class("letter")[cps], starts)
    n = end - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    begin = np.cumsum(n) - n
    own = cps[at]
    before = np.concatenate([[0], own[:-1]]).astype(np.uint32) if len(own) else own
    after = np.concatenate([own[1:], [0]]).astype(np.uint32) if len(own) else own
    if len(own):
        before[begin] = 0
        after[begin + n - 1] = 0
    h = (before * np.uint32(2654435761)) ^ (own * np.uint32(2246822519)) ^ (after * np.uint32(3266489917))
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    return (h >> np.uint32(32 - BITS)).astype(np.int64), begin, first, end, doc, starts, script_of(cps[first]), script_of(own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n); buckets below 0 count letters by script."""
    width = (1 << BITS) + len(NAMES)
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(width, np.int64))
    for batch in batches:
        text, langs = utf8(batch.column("text")), batch.column("lang").to_pylist()
        names = sorted(set(langs))
        ids = np.array([names.index(x) for x in langs], np.int64)
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
            bucket, begin, first, end, doc, *_, script = _trigrams(text[lo:hi])
            lang = np.repeat(ids[lo:hi][doc], end - first)
            for i in np.unique(lang):
                mine = lang == i
                total[names[i]][: 1 << BITS] += np.bincount(bucket[mine], minlength=1 << BITS)
                total[names[i]][1 << BITS :] += np.bincount(script[mine], minlength=len(NAMES))
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


def parts_of(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows each language may give: ``rows`` are dealt evenly, and what small languages leave goes to the others."""
    out, left, open_ = {}, rows, len(counts)
    for lang, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        out[lang] = min(n, max(1, left // open_))
        left, open_ = left - out[lang], open_ - 1
    return out


def chosen(labelled: DataFrame, rows: int, key: str) -> DataFrame:
    """(text, lang) of about ``rows`` labelled rows, by language."""
    h = F.xxhash64(key, "text")
    largest = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(h).alias("least")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS + 1).collect()
    if len(largest) > MOST_LABELS:  # the model has a column for each label
        labelled = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame([(r.lang,) for r in largest[:MOST_LABELS]], "lang string")), "lang", "left_semi")
    sizes = {r.lang: r for r in largest[:MOST_LABELS]}
    parts = parts_of({lang: r.n for lang, r in sizes.items()}, rows)
    if all(parts[lang] == r.n for lang, r in sizes.items()):
        return labelled.select("text", "lang")
    limits = [(lang, max(r.least, 2**63 - 1 if parts[lang] == r.n else parts[lang] * 2**64 // r.n - 2**63)) for lang, r in sizes.items()]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, _limit long"))  # a row for each label
    return labelled.join(limits, "lang").where(h <= F.col("_limit")).groupBy("lang", h.alias("h")).agg(F.first("text").alias("text")).select("text", "lang")


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id") -> Model:
    """labelled: (key, text, lang). Learns from all rows, or from about ``rows`` of them if there are more."""
    labelled = labelled.where("lang is not null and text is not null").select(key, "text", "lang")
    counts = chosen(labelled, rows, key).mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    n = np.zeros(((1 << BITS) + len(NAMES), len(langs)))
    n[counts.bucket.to_numpy(), np.searchsorted(langs, counts.lang.to_numpy(dtype=str)) if langs else []] = counts.n.to_numpy()
    letters, scripts = n[: 1 << BITS], n[1 << BITS :]
    seen = max(1, int((letters.sum(axis=1) > 0).sum()))
    logp = np.log((letters + SMOOTHING) / (letters.sum(axis=0) + SMOOTHING * seen)).astype(np.float32) if langs else np.zeros((1 << BITS, 0), np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, logp, allowed)


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word. scores: (words, labels), the words of each text in order; doc: text of each word, ascending."""
    n, labels = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    length = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[order] = np.arange(n_docs)
    steps = int(length.max())
    alive = n_docs - np.searchsorted(np.sort(length), np.arange(steps), side="right")  # texts with more than t words
    offset = np.concatenate([[0], np.cumsum(alive)])
    t = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    place = offset[t] + rank[doc]
    timed = np.empty_like(scores)
    timed[place] = scores
    back = np.empty((n, labels), np.int8 if labels < 128 else np.int32)
    stay = np.arange(labels, dtype=back.dtype)
    last = np.zeros(n_docs, np.int64)
    v = timed[: alive[0]]
    for k in range(1, steps):
        a = alive[k]
        if a < len(v):
            last[a : len(v)] = v[a:].argmax(axis=1)
            v = v[:a]
        best = v.argmax(axis=1)
        jump = np.take_along_axis(v, best[:, None], 1) - switch
        moved = jump > v
        back[offset[k] : offset[k + 1]] = np.where(moved, best[:, None], stay)
        v = np.where(moved, jump, v) + timed[offset[k] : offset[k + 1]]
    last[: len(v)] = v.argmax(axis=1)
    out = np.empty(n, np.int64)
    now = last
    for k in range(steps - 1, -1, -1):
        a = alive[k]
        out[offset[k] : offset[k + 1]] = now[:a]
        if k:
            now[:a] = back[offset[k] : offset[k + 1]][np.arange(a), now[:a]]
    return out[place]


_SPAN = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _labelled(sent, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = utf8(batch.column("text"))
            for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False), VITERBI_CHARS):
                yield from _part(sent.value, batch.column("doc_id")[lo:hi], text[lo:hi], switch)

    return run


def _stretches(text: pa.Array) -> Iterator[tuple[pa.Array, int, int]]:
    """(texts, number of the first, characters before it): passes of whole texts, and pieces of longer ones, as the arrays by character are many times their size."""
    for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
        offset = 0
        for piece in pieces(text[lo].as_py(), PASS_CHARS) if hi == lo + 1 else ():
            yield pa.array([piece], pa.large_string()), lo, offset
            offset += len(piece)
        if hi > lo + 1:
            yield text[lo:hi], lo, 0


def _part(model: Model, ids: pa.Array, text: pa.Array, switch: float) -> Iterator[pa.RecordBatch]:
    barred, rows, parts = np.where(model.allowed, 0, -BARRED).astype(np.float32), len(ids), []
    for some, lo, offset in _stretches(text) if model.langs else ():
        bucket, begin, first, end, doc, starts, script, _ = _trigrams(some)
        if len(begin):
            parts.append((np.add.reduceat(model.logp[bucket], begin, axis=0) + barred[script], doc + lo, first - starts[doc] + offset, end - starts[doc] + offset))
    if not parts:
        yield from batches_of([ids, pa.array(["und"] * rows, pa.string()), pa.array([0.0] * rows, pa.float64()), pa.array([[]] * rows, pa.list_(_SPAN))], ["doc_id", "lang_pred", "score", "spans"])
        return
    score, doc, first, end = (np.concatenate(x) for x in zip(*parts))
    label = viterbi(score, doc, rows, switch)
    held = np.zeros((rows, len(model.langs)), np.int64)
    np.add.at(held, (doc, label), end - first)
    letters, best = held.sum(axis=1), held.argmax(axis=1)
    share = held.max(axis=1) / np.maximum(letters, 1)
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
    stop = np.append(cut[1:], len(doc)) - 1
    names = pa.array(model.langs, pa.string())
    spans = pa.StructArray.from_arrays([names.take(pa.array(label[cut])), pa.array(first[cut], pa.int64()), pa.array(end[stop], pa.int64())], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[cut], np.arange(rows + 1)), pa.int32()), spans)
    lang = pc.if_else(pa.array(letters > 0), names.take(pa.array(best)), "und")
    yield from batches_of([ids, lang, pa.array(np.where(letters > 0, share, 0.0)), lists], ["doc_id", "lang_pred", "score", "spans"])


def label(docs: DataFrame, model: Model, switch: float = SWITCH, key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(_labelled(sent, switch), f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")


def known_only(docs: DataFrame, model: Model, least: float = 0.3, switch: float = SWITCH) -> DataFrame:
    """The rows, with all their columns, whose text has a language that holds at least the share ``least`` of its letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = _labelled(sent, switch)

    def keep(text: pa.Array) -> np.ndarray:
        found = [np.zeros(0, np.bool_)]
        for out in rows(iter([pa.record_batch([pa.array(range(len(text))), text], names=["doc_id", "text"])])):
            known = pc.not_equal(out.column("lang_pred"), "und").to_numpy(zero_copy_only=False)
            found.append(known & (out.column("score").to_numpy() >= least))
        return np.concatenate(found)

    return kept_rows(docs, keep)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return label(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
