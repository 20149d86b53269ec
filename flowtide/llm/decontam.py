"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and texts are reduced to lower-case letters and digits with single spaces. Items are cut into pieces of SHORT characters that
begin every STRIDE characters; an item of at most PIECE characters is a piece as a whole, too. (Of longer stretches, one of two halves
holds no more than its share of the edits, so longer pieces would find nothing else.) So
an excerpt of at least SHORT + STRIDE - 1 = 74 reduced characters is found wherever it begins and ends, with up to 6 edits in it; a shorter one
only if it holds a whole piece. A piece of n characters may be matched with k = floor(ERRORS n) edits; such a match shares at least
n - q + 1 - k q q-grams with the text, all on at most k + 1 neighbouring diagonals. So shared q-grams are counted in bands of 2 (k + 1)
diagonals that overlap by half; bands that reach the count are regions, and a region is verified by alignment within its band.

Items of fewer than LEAST reduced characters are no evidence for an edited copy. A second rule holds for them: an item of ``least`` (words, characters) at
least (SHORTEST, if not said otherwise) is matched without edits and as whole words: by all of its q-grams on one diagonal, or, if it has fewer
than Q characters, by a table of such items, in which all stretches of as many words are looked up. With least = (1, 1) each item with a letter or
digit is found; the default leaves items of one or two short words alone, as they are no passages.

The texts are not shuffled. The benchmark goes to the tasks up to MAX_ITEM_BYTES; beyond, it is dealt into parts by a hash of the item
and each part makes a pass of its own over the texts.

Cases: null texts and items match nothing; repeated items and rows are each reported; a null id is a value like others; of regions of one item that
overlap (ties included) one is reported, with the most edits; empty tables give empty results; texts are read whole, a very long one in a pass of
its own; extra columns are ignored, or kept by clean_only(). Offsets count characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_class, code_points, kept_rows, passes, table, utf8

Q = 8
ERRORS = 0.1
_PAD = np.uint32(0xFFFFFFFF)
#: Characters of the texts that are searched at a time, and cells of the first count of their shared q-grams, by a hash of text, piece and diagonals.
PASS, COUNT_BITS = 1_000_000, 20
PIECE, LEAST, SHORTEST = 120, 30, (3, Q)
SHORT, STRIDE = 60, 15
#: Regions that are aligned together.
REGIONS = 20_000
#: An index holds each q-gram of an item about six times.
MAX_ITEM_BYTES = 10 << 20


def reduced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the reduced texts, their starts and the end, offset in its text of each code point)."""
    cps, starts = code_points(pc.utf8_lower(texts))
    word = char_class("word")[cps]
    keep = word.copy()
    if len(cps):
        keep[1:] |= word[:-1]
        inner = starts[:-1][starts[:-1] < len(cps)]
        keep[inner] &= word[inner]  # no space from the text before
    at = np.flatnonzero(keep)
    new = np.searchsorted(at, starts)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(new))
    return np.where(word[at], cps[at], 32).astype(np.uint32), new, at - starts[text]


def grams(cps: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 code points from each position; the last Q - 1 positions are missing."""
    if len(cps) < Q:
        return np.zeros(0, np.uint64)
    h = cps.astype(np.uint64) + np.uint64(1)
    for width, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-width] * np.uint64(factor) + (h[width:] ^ (h[width:] >> np.uint64(29)))
    return h ^ (h >> np.uint64(32))


@dataclass
class Index:
    """Pieces of items and their sorted q-grams."""

    items: list
    piece_item: np.ndarray
    piece_text: list[np.ndarray]
    piece_start: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each distinct hash among the entries, and the end
    entry_piece: np.ndarray
    entry_at: np.ndarray
    seen: np.ndarray  # quick test by 22 bits
    tiny: dict[int, dict[bytes, list[int]]]  # items of fewer than Q characters: number of words -> text -> items


def index(items: list[tuple], least: tuple[int, int] = SHORTEST) -> Index:
    """items: (item_id, text)."""
    cps, starts, _ = reduced(pa.array([t or "" for _, t in items], pa.large_string()))
    owner, texts, begin, tiny = [], [], [], {}
    for i in range(len(items)):
        own = cps[starts[i] : starts[i + 1]]
        own = own[: len(own) - (len(own) > 0 and own[-1] == 32)]
        words = int((own == 32).sum()) + 1 if len(own) else 0
        if not words or len(own) < LEAST and (words < least[0] or len(own) < least[1]):
            continue
        if len(own) < Q:
            tiny.setdefault(words, {}).setdefault(own.tobytes(), []).append(i)
            continue
        cuts = [(0, len(own))] if len(own) <= PIECE else []
        if len(own) > SHORT:
            # the last two pieces side by side, so that every 2 * SHORT characters hold two pieces
            cuts += [(c, SHORT) for c in sorted({*range(0, len(own) - SHORT, STRIDE), len(own) - SHORT, max(0, len(own) - 2 * SHORT)})]
        for c, size in cuts:
            owner.append(i)
            begin.append(c)
            texts.append(own[c : c + size])
    n = np.array([len(t) for t in texts], np.int64)
    budget = np.where(n < LEAST, 0, np.minimum((n * ERRORS).astype(np.int64), (n - Q) // Q))
    hs = [grams(t) for t in texts]
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    piece = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
    at = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << 22, np.bool_)
    seen[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return Index([k for k, _ in items], np.array(owner, np.int64), texts, np.array(begin, np.int64), budget, n - Q + 1 - budget * Q, hashes, np.append(first, len(h)), piece[order].astype(np.int32), at[order].astype(np.int32), seen, tiny)


def banded(piece: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int]:
    """Fewest edits that turn piece into a stretch of text, on paths whose diagonals (text - piece offset) stay in [low, high]; and where the stretch ends. More than k edits: (k + 1, -1)."""
    far, width = k + 1, high - low + 1
    before = max(0, -low)
    after = max(0, len(piece) + high + 1 - len(text))
    padded = np.concatenate([np.full(before, _PAD), text, np.full(after, _PAD)])  # padding matches nothing, which costs what a deletion costs
    columns = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, ch in enumerate(piece):
        at = i + low + before
        new = row + (padded[at : at + width] != ch)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - columns) + columns
        if row.min() > k:
            return far, -1
    best = int(row.argmin())
    return int(row[best]), min(len(text), len(piece) + low + best)


def within(own: np.ndarray, starts: np.ndarray, ix: Index, t: np.ndarray, i: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of the regions hold their piece within its budget: banded() for many pieces of one length at a time."""
    k = int(ix.budget[i[0]])
    width = 2 * (k + 1)
    distinct, back = np.unique(i, return_inverse=True)
    piece = np.stack([ix.piece_text[x] for x in distinct.tolist()])[back]
    n = piece.shape[1]
    at = (starts[t] + low)[:, None] + np.arange(n + width - 1)
    inside = (at >= starts[t][:, None]) & (at < starts[t + 1][:, None])
    text = np.where(inside, own[np.clip(at, 0, len(own) - 1)], _PAD)
    # steps and diagonals come first, so that each operation runs along the regions
    piece, text, left = np.ascontiguousarray(piece.T), np.ascontiguousarray(text.T), np.arange(len(t))
    row = np.zeros((width, len(t)), np.int16)
    for step in range(n):
        new = row + (text[step : step + width] != piece[step])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        for d in range(1, width):
            np.minimum(new[d], new[d - 1] + 1, out=new[d])
        row = new
        if step % 8 == 7:
            near = row.min(axis=0) <= k
            if not near.all():
                row, text, piece, left = row[:, near], text[:, near], piece[:, near], left[near]
    out = np.zeros(len(t), np.bool_)
    out[left] = row.min(axis=0) <= k
    return out


def regions(own: np.ndarray, starts: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, piece, first and last diagonal, shared q-grams) of the bands that reach the count and hold the piece within its budget. own: reduced code points of all texts."""
    h = grams(own)
    at = np.flatnonzero(ix.seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
    which = np.minimum(np.searchsorted(ix.hashes, h[at]), len(ix.hashes) - 1)
    hit = ix.hashes[which] == h[at]
    at, which = at[hit], which[hit]
    text = np.searchsorted(starts, at, side="right") - 1
    fits = at + Q <= starts[text + 1]
    at, which, text = at[fits], which[fits], text[fits]
    n = ix.first[which + 1] - ix.first[which]
    entry = np.repeat(ix.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    piece, j = ix.entry_piece[entry], ix.entry_at[entry]
    diagonal = np.repeat((at - starts[text]).astype(np.int32), n) - j
    band = (diagonal + np.int32(PIECE)) // (ix.budget.astype(np.int32) + np.int32(1))[piece] + np.int32(1)  # a region is two neighbouring bands
    # neighbouring bands have neighbouring cells, so that each cell's best two are found once
    mixed = np.repeat(text.astype(np.uint32) * np.uint32(2654435761), n) + piece.astype(np.uint32) * np.uint32(2246822519)
    cell = (((mixed ^ (mixed >> np.uint32(15))) * np.uint32(668265263)) >> np.uint32(32 - COUNT_BITS)).astype(np.int64) + band & ((1 << COUNT_BITS) - 1)
    rough = np.bincount(cell, minlength=1 << COUNT_BITS).astype(np.int32)
    enough = (rough + np.maximum(np.roll(rough, 1), np.roll(rough, -1)))[cell] >= ix.need.astype(np.int32)[piece]
    pair = np.repeat(text, n)[enough] * len(ix.need) + piece[enough]
    band, j = band[enough].astype(np.int64), j[enough].astype(np.int64)
    if not len(pair):
        return
    # exact: distinct q-gram positions of the piece in each pair of bands
    pairs, own_pair = np.unique(pair, return_inverse=True)
    key = np.concatenate([(own_pair << 32) | band, (own_pair << 32) | (band - 1)])
    distinct = np.sort((key << 7) | np.concatenate([j, j]))  # sorting is faster here than the hashing of np.unique
    distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])] >> 7
    first = np.flatnonzero(np.append(True, distinct[1:] != distinct[:-1]))
    keys, count = distinct[first], np.diff(np.append(first, len(distinct)))
    reached = count >= ix.need[pairs[keys >> 32] % len(ix.need)]
    keys, count = keys[reached], count[reached]
    t, i = np.divmod(pairs[keys >> 32], len(ix.need))
    low = ((keys & 0xFFFFFFFF) - 1) * (ix.budget[i] + 1) - PIECE
    close = np.zeros(len(t), np.bool_)
    length = np.fromiter((len(ix.piece_text[x]) for x in i.tolist()), np.int64, len(i))
    for n in np.unique(length):
        alike = np.flatnonzero(length == n)  # pieces of one length have one budget
        for a in range(0, len(alike), REGIONS):
            at = alike[a : a + REGIONS]
            close[at] = within(own, starts, ix, t[at], i[at], low[at])
    for x in np.flatnonzero(close).tolist():
        yield int(t[x]), int(i[x]), int(low[x]), int(low[x] + 2 * ix.budget[i[x]] + 1), int(count[x])


def tiny_matches(own: np.ndarray, starts: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, start, end) of the items of fewer than Q characters, as whole words."""
    for t in range(len(starts) - 1) if ix.tiny else ():
        text = own[starts[t] : starts[t + 1]]
        text = text[: len(text) - (len(text) > 0 and text[-1] == 32)]
        gaps = np.flatnonzero(text == 32)
        begin, end = np.append(0, gaps + 1), np.append(gaps, len(text))
        for words, table in ix.tiny.items():
            first, last = begin[: max(0, len(begin) - words + 1)], end[words - 1 :]
            for k in np.flatnonzero(last - first < Q).tolist():
                for item in table.get(text[first[k] : last[k]].tobytes(), ()):
                    yield t, item, int(first[k]), int(last[k])


def matches(own: np.ndarray, starts: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, edits, pieces): verified regions, those of one item that overlap as one."""
    found: dict[tuple[int, int], list] = {}
    for t, item, start, end in tiny_matches(own, starts, ix):
        found.setdefault((t, item), []).append((start, end, 0, 0))
    for t, i, low, high, _ in regions(own, starts, ix) if len(ix.need) else ():
        piece, k = ix.piece_text[i], int(ix.budget[i])
        if len(piece) < LEAST:
            text = np.concatenate([[32], own[starts[t] : starts[t + 1]], [32]])  # whole words only
            whole = np.concatenate([[32], piece, [32]])
            found.setdefault((t, int(ix.piece_item[i])), []).extend((at, at + len(piece), 0, i) for at in range(max(0, low), high + 1) if np.array_equal(text[at : at + len(whole)], whole))
            continue
        base = max(0, low - k)
        text = own[starts[t] : starts[t + 1]][base : high + len(piece) + k + 1]
        exact = text.tobytes().find(piece.tobytes())
        if exact >= 0 and exact % 4 == 0:
            edits, start, end = 0, exact // 4, exact // 4 + len(piece)
        else:
            edits, end = banded(piece, text, low - base, high - base, k)
            if edits > k:
                continue
            back = text[:end][::-1]
            start = end - banded(piece[::-1], back, -k, k, k)[1]
        found.setdefault((t, int(ix.piece_item[i])), []).append((base + start, base + end, edits, i))
    for (t, item), own_regions in sorted(x for x in found.items() if x[1]):
        merged: list[list] = []
        for start, end, edits, i in sorted(own_regions):
            if merged and start <= merged[-1][1]:
                m = merged[-1]
                m[1], m[2] = max(m[1], end), max(m[2], edits)
                m[3].add(i)
            else:
                merged.append([start, end, edits, {i}])
        for start, end, edits, own_pieces in merged:
            yield t, item, start, end, edits, len(own_pieces)


def _matched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches:
            text = utf8(batch.column("text"))
            rows = []
            for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False), PASS) if len(ix.need) or ix.tiny else ():
                own, starts, offset = reduced(text[lo:hi])
                for t, item, start, end, edits, pieces in matches(own, starts, ix):
                    at = offset[starts[t] : starts[t + 1]]
                    rows.append((lo + t, ix.items[item], int(at[start]), int(at[end - 1]) + 1, edits, pieces))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([batch.column("key").take(pa.array(list(cols[0]), pa.int64())), pa.array(list(cols[1]), sent_kind(ix)), *(pa.array(list(c), pa.int64()) for c in cols[2:])], names=["key", "item_id", "start", "end", "edits", "pieces"])

    return run


def sent_kind(ix: Index) -> pa.DataType:
    return pa.string() if any(isinstance(x, str) for x in ix.items) else pa.int64()


def find(docs: DataFrame, items: DataFrame, key=None, least: tuple[int, int] = SHORTEST) -> DataFrame:
    """(key, item_id, start, end, edits, pieces): a row for each stretch of a text that holds a piece of an item. key: a Column, doc_id if None; least: words and characters of the shortest items that are searched."""
    spark = docs.sparkSession
    rows = docs.select((F.col("doc_id") if key is None else key).alias("key"), "text").where("text is not null")
    item_kind = "string" if items.schema["item_id"].dataType.simpleString() == "string" else "long"
    out = None
    for ix in indexes(items, least):
        sent = spark.sparkContext.broadcast(ix)
        found = rows.mapInArrow(_matched(sent), f"key {rows.schema['key'].dataType.simpleString()}, item_id {item_kind}, start long, end long, edits long, pieces long")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(sent):
    def keep(text: pa.Array) -> np.ndarray:
        ix, out = sent.value, np.ones(len(text), np.bool_)
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False), PASS) if len(ix.need) or ix.tiny else ():
            own, starts, _ = reduced(text[lo:hi])
            for t, *_ in matches(own, starts, ix):
                out[lo + t] = False
        return out

    return keep


def indexes(items: DataFrame, least: tuple[int, int] = SHORTEST) -> Iterator[Index]:
    """An index of each part of the items; one part unless they exceed MAX_ITEM_BYTES."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // MAX_ITEM_BYTES))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").orderBy("item_id", "text").collect()
        yield index([tuple(r) for r in own], least)


def clean_only(docs: DataFrame, items: DataFrame, least: tuple[int, int] = SHORTEST) -> DataFrame:
    """The rows, with all their columns, whose text holds no piece of an item."""
    for ix in indexes(items, least):
        docs = kept_rows(docs, _clean(docs.sparkSession.sparkContext.broadcast(ix)))
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("key", "doc_id")
