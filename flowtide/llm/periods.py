"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words with smallest period q (words q apart are alike), at least max(LEAST, POWER * q) long, that no word beside it extends.

Method: the diagonals of the table "word i equals word i - lag" are followed as the words come in. Each word looks at its earlier occurrences
and adds one to the match length of their lags; a lag that gets no word ends its diagonal, which is a run if it is long enough. What keeps the
table sparse are the occurrences that count: for lags in (L / 2, L], L = 1, 2, 4, ..., a word's earlier occurrence is the nearest one that
agrees in L words from there on. Inside a run of period q <= L the nearest such occurrence is exactly q back, as a nearer one would make the
period smaller; and a lag that is a multiple of the period is never the nearest. So each word has one active lag for each L at most, a run is
one diagonal of its smallest period, and a match of c words is a run of c + L + q - 1. Positions whose L words occur once in their text leave
before the next L; a text of n words costs n log n steps, also where one word fills it. The match lengths of a pass of texts are counted
together, as lengths of stretches of equal lags in successive words.

Cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; a null doc_id is a value like others; rows alike give rows
alike; runs of several periods may overlap, and a word goes if any of them drops it; the strongest run (length / period, compared exactly) is the
one of least start, then least period, of equals; an empty table gives an empty table; extra columns, of any name, are ignored. Texts are read
whole: one beyond a pass (common.PASS_CHARS) is a pass of its own, which takes about ten times its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passes, table, utf8

#: A run has POWER periods (three at least, as the method needs matches of L words inside it) and LEAST words at least.
POWER, LEAST = 4, 6
#: Words lie between characters of [\x20\x09-\x0D].
RUNS = "array<struct<start: long, length: long, period: long>>"


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, first word of each text and the end)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, cut = lists.flatten(), np.asarray(lists.offsets)
    some = np.asarray(pc.binary_length(flat)) > 0  # a text that begins or ends with a space splits there too
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[cut - cut[0]]


def runs(codes: np.ndarray, first: np.ndarray, power: int = POWER, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of all texts, by start, then period. codes: a number of each word; first: the first word of each text and the end."""
    if power < 3:
        raise ValueError("a run has three periods at least")
    n, found, span = len(codes), [], 1
    end = np.repeat(first[1:], np.diff(first)).astype(np.int32)
    # words of different texts are different: the text is part of the first key
    key = codes.astype(np.int64) + np.repeat(np.arange(len(first) - 1), np.diff(first)) * (int(codes.max(initial=0)) + 1)
    at, number = np.arange(n, dtype=np.int32), np.full(n, -1, np.int32)
    while len(at):
        order = np.argsort(key, kind="stable")
        ranked, place = key[order], at[order]
        again = ranked[1:] == ranked[:-1]
        lag = np.zeros(len(at), np.int32)
        lag[order[1:][again]] = (place[1:] - place[:-1])[again]
        several = np.zeros(len(at), np.bool_)
        several[order[1:][again]] = several[order[:-1][again]] = True
        rank = np.empty(len(at), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(~again)])
        active = (lag <= span) & (2 * lag > span)
        i, q = at[active].astype(np.int64), lag[active].astype(np.int64)
        if len(i):
            begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (q[1:] != q[:-1])]))
            matched = np.diff(np.append(begins, len(i)))
            i, q = i[begins], q[begins]
            length = matched + span + q - 1
            long = length >= np.maximum(least, power * q)
            found.append(np.stack([(i - q)[long], length[long], q[long]]))
        at, rank = at[several], rank[several]
        number[at] = rank
        fits = at.astype(np.int64) + 2 * span <= end[at]
        left, right = rank[fits], number[at[fits] + span]
        number[at] = -1
        at, key = at[fits][right >= 0], left[right >= 0] * (len(order) + 1) + right[right >= 0]
        span *= 2
    out = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    return tuple(out[:, np.lexsort((out[2], out[0]))])


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _collapsed(order: Callable | None, power: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = utf8(batch.column("text"))
            for lo, hi in passes(pc.binary_length(text).to_numpy(zero_copy_only=False)):
                words, first = ascii_words(text[lo:hi])
                size = np.diff(first)
                coded = words.dictionary_encode()
                codes = np.asarray(coded.indices)
                if order:
                    ids = batch.column("doc_id")[lo:hi].to_pylist()
                    new = [(k, place) for k in range(hi - lo) if (place := order(ids[k], int(size[k]))) is not None]
                    if new:
                        codes = codes.copy()
                        for k, place in new:
                            codes[first[k] : first[k + 1]] = codes[first[k] + place]
                start, length, period = runs(codes, first, power, least)
                keep = np.flatnonzero(~dropped(len(codes), start, length, period))
                own = np.searchsorted(first, start, side="right") - 1
                cut = pa.array(np.searchsorted(keep, first), pa.int32())
                kept = pc.binary_join(pa.ListArray.from_arrays(cut, coded.dictionary.take(pa.array(codes[keep]))), pa.scalar(" ", pa.large_string()))
                one = pa.StructArray.from_arrays([pa.array(start - first[own]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(hi - lo + 1)), pa.int32()), one)
                yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(size), lists, kept.cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

    return run


def collapsed(docs: DataFrame, order: Callable | None = None, power: int = POWER, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, text) for each row of docs (doc_id, text): its runs by start, then period, and the text of the words that no run drops, joined by one space. order(doc_id, number of words), if given, names the words to take instead, as an array of word numbers; None leaves the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_collapsed(order, power, least), f"doc_id {kind}, n_words long, runs {RUNS}, text string")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, by whole numbers; null if there is none. Of equals the first, as runs come by start, then period."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUNS[6:-1]), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(doc_id, n: int) -> np.ndarray | None:
    """The rule by which the query makes documents with a repeated end; other documents stay as they are."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(table(spark, sf_dir, "documents"), planted).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))


OP12_SQL = r"""
WITH RECURSIVE t0 AS (
  -- the checksum's table: eight steps of its polynomial for each byte
  SELECT i, i AS v, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t0 WHERE k < 8),
t AS MATERIALIZED (SELECT i, v FROM t0 WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h0 AS (
  SELECT no, s, 0 AS pos, 4294967295 AS v FROM d UNION ALL
  SELECT no, s, pos + 1, xor(h0.v >> 8, t.v) FROM h0 JOIN t ON t.i = xor(h0.v, ascii(s[pos + 1])) & 255 WHERE pos < length(s)),
h AS MATERIALIZED (SELECT no, xor(v, 4294967295) AS h FROM h0 WHERE pos = length(s)),
f AS MATERIALIZED (SELECT d.no, doc_id, w, len(w) AS n, h IS NOT NULL AND h % 10 = 0 AND len(w) > 0 AS made, (h // 10) AS g FROM d LEFT JOIN h ON h.no = d.no),
m AS MATERIALIZED (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM f),
u AS MATERIALIZED (SELECT no, n, i, w[1 + CASE WHEN made AND i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM m WHERE n > 0)),
-- all pairs of equal words up to a quarter of the text apart, as stretches of one distance
b AS (SELECT u.no, u.n, v.i - u.i AS q, u.i FROM u JOIN u v ON v.no = u.no AND v.x = u.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
k AS (SELECT no, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY no, q ORDER BY i) AS island FROM b) GROUP BY no, q, island),
r AS MATERIALIZED (SELECT no, start, length, min(q) AS q FROM k WHERE length >= greatest(6, 4 * q) GROUP BY no, start, length),
z AS (SELECT DISTINCT u.no, u.i FROM u JOIN r ON r.no = u.no AND u.i >= r.start + r.q AND u.i < r.start + r.length),
y AS (SELECT u.no, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN z ON z.no = u.no AND z.i = u.i WHERE z.i IS NULL GROUP BY u.no),
lines AS (SELECT no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS s FROM r GROUP BY no),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY no ORDER BY length::DECIMAL(18, 0) / q DESC, start, q) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, m.n::BIGINT AS n_words
FROM m LEFT JOIN lines ON lines.no = m.no LEFT JOIN best ON best.no = m.no LEFT JOIN y ON y.no = m.no
"""
