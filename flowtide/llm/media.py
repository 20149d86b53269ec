"""Media columns: lossless motion-JPEG in AVI (RIFF) containers, and shots found by adaptive histogram differences.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become 8-bit grey samples of 24 x 24 frames. Each frame is
an intra-coded JPEG of the lossless process (SOF3, predictor 1), as payloads must come back exactly, which baseline JPEG does not promise. Each
file has a Huffman table of its own, made from the counts of its difference categories; all frames of a batch are packed, and decoded, step by step
together. Reading takes any frame size, frame rate and Huffman table; files of a batch may differ in them.

Cases: null text is an empty text (one frame of padding); equal texts give equal rows; ties between categories go to the lower one; a file without
frames has no clips; repeated rows give repeated rows; a null id is a value like others; a very long text is a pass of its own, whose frames go RUN at a
time, so that it takes about ten times its size, up to about 1.6 GB, as a value holds 2 GB at most; beyond, the task fails; empty tables give empty results; extra columns are ignored; a damaged container raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passes, raw_bytes, table, utf8

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
#: Shots: a cut needs a difference above mean + DEVIATIONS * sd of the last WINDOW differences, and above FLOOR (share of pixels).
WINDOW, DEVIATIONS, FLOOR = 12, 2.0, 0.3
#: Frames that are packed or decoded together.
RUN = 4096
#: Categories of differences: the number of bits of the absolute value.
CATEGORIES = 9
_BITS = np.array([abs(d).bit_length() for d in range(-255, 256)], np.uint8)


@lru_cache(1 << 14)
def code_lengths(counts: tuple[int, ...]) -> tuple[int, ...]:
    """Huffman code length of each symbol that occurs (0: does not). The longest code of ones only is left free, as JPEG asks."""
    heap = [(n, k, (k,)) for k, n in enumerate(counts) if n] + [(0, len(counts), ())]
    heapq.heapify(heap)
    lengths = [0] * len(counts)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        for k in x + y:
            lengths[k] += 1
        heapq.heappush(heap, (a + b, min(i, j), x + y))
    return tuple(lengths)


@lru_cache(1 << 14)
def coding(lengths: tuple[int, ...], height: int, width: int) -> tuple[np.ndarray, bytes]:
    """(canonical code of each symbol, the JPEG up to its scan)."""
    order = sorted((n, k) for k, n in enumerate(lengths) if n)
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n, k in order:
        code <<= n - last
        codes[k], code, last = code, code + 1, n
    per_length = bytes(sum(n == x for n, _ in order) for x in range(1, 17))
    dht = struct.pack(">HHB", 0xFFC4, 2 + 1 + 16 + len(order), 0) + per_length + bytes(k for _, k in order)
    sof = struct.pack(">HHBHHBBBB", 0xFFC3, 11, 8, height, width, 1, 1, 0x11, 0)
    sos = struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 1, 0, 0)
    return codes, b"\xff\xd8" + sof + dht + sos


def differences(px: np.ndarray) -> np.ndarray:
    """(frames, height, width) samples -> differences to the sample before: left, in the first column above, at first 128."""
    px = px.astype(np.int16)
    d = np.empty_like(px)
    d[:, :, 1:] = px[:, :, 1:] - px[:, :, :-1]
    d[:, 1:, 0] = px[:, 1:, 0] - px[:, :-1, 0]
    d[:, 0, 0] = px[:, 0, 0] - 128
    return d.reshape(len(px), -1)


def samples(d: np.ndarray, height: int, width: int) -> np.ndarray:
    """The inverse of differences()."""
    d = d.reshape(-1, height, width).astype(np.int32)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2).astype(np.uint8).reshape(len(d), -1)


def _runs(n: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, RUN):
        yield lo, min(n, lo + RUN)


def encode(px: np.ndarray, first: np.ndarray) -> list[bytes]:
    """(frames, height, width) samples of several files -> their JPEGs. first: first frame of each file and the end. Categories are counted, then frames packed, RUN frames at a time, so that a long file takes no more memory than its bytes and those of its JPEGs."""
    height, width = px.shape[1:]
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.zeros((len(first) - 1, CATEGORIES), np.int64)
    for lo, hi in _runs(len(px)):
        kind = _BITS[differences(px[lo:hi]) + 255]
        begin, some = own[lo], own[hi - 1] + 1 - own[lo]
        counts[begin : begin + some] += np.bincount(((own[lo:hi] - begin)[:, None] * CATEGORIES + kind).ravel(), minlength=CATEGORIES * some).reshape(-1, CATEGORIES)
    lengths = [code_lengths(tuple(c)) for c in counts.tolist()]
    codes, heads = zip(*(coding(x, height, width) for x in lengths))
    codes, lengths = np.stack(codes), np.array(lengths, np.int64)
    return [jpeg for lo, hi in _runs(len(px)) for jpeg in _packed(differences(px[lo:hi]), own[lo:hi], codes, lengths, heads)]


def _packed(d: np.ndarray, own: np.ndarray, codes: np.ndarray, lengths: np.ndarray, heads: tuple[bytes, ...]) -> list[bytes]:
    """JPEGs of a run of frames, from their differences, their files, and the files' codes and heads."""
    kind = _BITS[d + 255]
    extra = np.where(d < 0, d + (1 << kind.astype(np.int64)) - 1, d)
    word = (codes[own[:, None], kind].astype(np.int64) << kind) | extra
    size = lengths[own[:, None], kind] + kind
    ends = np.cumsum(size, axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    start = (8 * at[:-1, None] + ends - size).ravel()
    word = word.ravel() << (32 - (start & 7) - size.ravel())  # in the 32 bits from the first byte that it touches
    out = np.zeros(int(at[-1]) + 4)
    for k in range(3):  # at most 7 + 9 + 8 bits; words share bytes but no bits, so sums are unions
        out += np.bincount((start >> 3) + k, weights=(word >> (24 - 8 * k)) & 255, minlength=len(out))
    out[at[1:] - 1] += (1 << (8 * n_bytes - ends[:, -1])) - 1  # the last byte is filled with ones
    scans = out[: int(at[-1])].astype(np.uint8)
    full = np.flatnonzero(scans == 255)
    stuffed = np.insert(scans, full + 1, 0).tobytes()
    at = (at + np.searchsorted(full, at)).tolist()
    return [heads[f] + stuffed[a:b] + b"\xff\xd9" for f, a, b in zip(own.tolist(), at, at[1:])]


@lru_cache(1 << 14)
def _head(head: bytes) -> tuple[int, int, np.ndarray, int]:
    """(height, width, table, bits) of a JPEG up to its scan: table[next ``bits`` bits] is 256 * code length + category."""
    at, height, width, entries = 2, 0, 0, []
    while at < len(head):
        marker, n = struct.unpack_from(">HH", head, at)
        body = head[at + 4 : at + 2 + n]
        if marker == 0xFFC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1 or precision != 8:
                raise ValueError("one component of 8 bits is expected")
        elif marker == 0xFFC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    entries.append((length, code, body[k]))
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xFFDA and body[3] != 1:
            raise ValueError("only predictor 1 is decoded")
        elif 0xFFC0 <= marker <= 0xFFCF:
            raise ValueError(f"JPEG process {marker:#x} is not decoded")
        at += 2 + n
    bits = max((length for length, _, _ in entries), default=1)
    lut = np.zeros(1 << bits, np.uint16)
    for length, code, category in entries:
        lut[code << (bits - length) : (code + 1) << (bits - length)] = 256 * length + category
    return height, width, lut, bits


def _scan_of(jpeg: bytes) -> int:
    """Where the entropy-coded bytes begin."""
    at = 2
    while at + 4 <= len(jpeg):
        marker, n = struct.unpack_from(">HH", jpeg, at)
        at += 2 + n
        if marker == 0xFFDA:
            return at
    raise ValueError("the JPEG has no scan")


def decode(jpegs: list[bytes]) -> tuple[np.ndarray, int, int]:
    """((frames, samples), height, width) of one-component lossless JPEGs of one size, predictor 1, RUN frames at a time. One sample of every frame is decoded in each step."""
    runs = [_decoded(jpegs[lo:hi]) for lo, hi in _runs(len(jpegs))]
    if len({r[1:] for r in runs}) > 1:
        raise ValueError("the frames differ in size")
    return np.concatenate([r[0] for r in runs]), *runs[0][1:]


def _decoded(jpegs: list[bytes]) -> tuple[np.ndarray, int, int]:
    starts = [_scan_of(j) for j in jpegs]
    heads = [_head(j[:a]) for j, a in zip(jpegs, starts)]
    height, width = heads[0][:2]
    if any(h[:2] != (height, width) for h in heads):
        raise ValueError("the frames differ in size")
    tables = {id(h[2]): h[2] for h in heads}
    offset = dict(zip(tables, np.cumsum([0, *map(len, tables.values())]).tolist()))
    lut, mine = np.concatenate(list(tables.values())), np.array([offset[id(h[2])] for h in heads], np.int64)
    unused = np.array([32 - h[3] for h in heads], np.uint32)
    flat = np.frombuffer(b"".join(j[a:-2] for j, a in zip(jpegs, starts)), np.uint8)
    keep = np.ones(len(flat), np.bool_)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 255)  # without stuffing
    begin = np.cumsum([0, *(len(j) - 2 - a for j, a in zip(jpegs, starts))])
    kept = np.concatenate([[0], np.cumsum(keep)])
    b = np.concatenate([flat[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]  # 32 bits from each byte
    last, at = len(ahead) - 1, kept[begin[:-1]] * 8
    out = np.empty((height * width, len(jpegs)), np.int16)
    for step in range(height * width):
        bits = ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        entry = lut[mine + (bits >> unused)]
        kind = (entry & 255).astype(np.uint32)
        at = at + (entry >> 8)
        bits = ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        v = np.where(kind > 0, bits >> (np.uint32(32) - np.maximum(kind, 1)), 0).astype(np.int32)
        out[step] = np.where(v < (1 << kind.astype(np.int32) >> 1), v - (1 << kind.astype(np.int32)) + 1, v)
        at = at + kind
    return samples(np.ascontiguousarray(out.T), height, width), height, width


def avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with an idx1 index."""
    sizes = np.fromiter(map(len, frames), np.uint32, len(frames))
    padded = (sizes + 1) & ~np.uint32(1)
    index = np.empty((len(frames), 4), np.uint32)
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # key frame
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(padded[:-1] + 8)])
    index[:, 3] = sizes
    parts = []
    for f in frames:
        parts += (b"00dc", len(f).to_bytes(4, "little"), f, b"\0" * (len(f) & 1))
    movi = b"movi" + b"".join(parts)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, int(sizes.max(initial=0)), width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), int(sizes.max(initial=0)), 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


def parse_avi(media: bytes) -> tuple[np.ndarray, float]:
    """((offset, size) of each frame as idx1 lists them, frames a second: by the stream's header, else by the file's)."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, movi, index, fps = 12, None, None, FPS
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            fps = 1_000_000 / max(1, int.from_bytes(media[at + 20 : at + 24], "little"))
            stream = media.find(b"strh", at, at + 8 + n)
            scale, rate = struct.unpack_from("<II", media, stream + 8 + 20) if stream >= 0 else (0, 0)
            fps = rate / scale if scale and rate else fps
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, np.uint32, n // 4, at + 8).reshape(-1, 4)
        at += 8 + n + (n & 1)
    if movi is None or index is None:
        raise ValueError("the AVI file has no movi list or no idx1 index")
    return np.stack([index[:, 2].astype(np.int64) + movi + 8, index[:, 3].astype(np.int64)], axis=1), fps


def shots(hist: np.ndarray, doc: np.ndarray, pixels: int = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """hist: (frames, bins) counts; doc: file of each frame, ascending. Returns (cut before this frame, difference); whole numbers only, so that equal files give equal cuts."""
    n = len(hist)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1)
    start = np.searchsorted(doc, doc)  # first frame of the same file
    own = np.arange(n) > start
    diff[~own] = 0
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    at = np.arange(n)
    lo = np.maximum(start + 1, at - WINDOW)
    k = np.maximum(at - lo, 0)
    mean = (s1[at] - s1[np.minimum(lo, at)]) / np.maximum(k, 1)
    var = (s2[at] - s2[np.minimum(lo, at)]) / np.maximum(k, 1) - mean * mean
    limit = np.where(k > 0, mean + DEVIATIONS * np.sqrt(np.maximum(var, 0)), 0)
    return own & (diff > limit) & (diff > 2 * pixels * FLOOR), diff


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = utf8(batch.column("text"))
        data, at = raw_bytes(text)
        for lo, hi in passes(np.diff(at), 2_000_000):
            n = np.diff(at[lo : hi + 1])
            frames = np.maximum(1, -(-n // FRAME))
            first = np.concatenate([[0], np.cumsum(frames)])
            payload = np.full(first[-1] * FRAME, 255, np.uint8)
            own = data[at[lo] : at[hi]]
            for k, a in enumerate((first[:-1] * FRAME).tolist()):
                payload[a : a + n[k]] = own[at[lo + k] - at[lo] : at[lo + k + 1] - at[lo]]
            jpegs = encode(payload.reshape(-1, SIDE, SIDE), first)
            media = [avi(jpegs[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]
            for i in range(0, hi - lo, 256):
                yield pa.record_batch([batch.column("doc_id")[lo + i : min(hi, lo + i + 256)], pa.array(n[i : i + 256], pa.int64()), pa.array(media[i : i + 256], pa.large_binary())], names=["doc_id", "n_bytes", "media"])


_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean_luma", pa.float64())])


def _described(media: list[bytes]) -> list[tuple]:
    """(payload bytes, digest, checksum of its last 32, file bytes, digest, feature, clips) of each file."""
    files = [parse_avi(m) for m in media]
    by_size = defaultdict(list)  # files of one frame size are decoded together
    for k, (m, (index, _)) in enumerate(zip(media, files)):
        size = _head(m[index[0][0] :][: _scan_of(m[index[0][0] : index[0][0] + index[0][1]])])[:2] if len(index) else (0, 0)
        by_size[size].append(k)
    rows: list = [None] * len(media)
    for (height, width), own in by_size.items():
        jpegs = [media[k][a : a + n] for k in own for a, n in files[k][0].tolist()]
        px = decode(jpegs)[0] if jpegs else np.zeros((0, 0), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(files[k][0]) for k in own])])
        hist = np.concatenate([np.zeros((0, BINS), np.int64), *(np.bincount((np.arange(hi - lo)[:, None] * BINS + (px[lo:hi] >> 4)).ravel(), minlength=(hi - lo) * BINS).reshape(-1, BINS) for lo, hi in _runs(len(px)))])
        cut, diff = shots(hist, np.repeat(np.arange(len(own)), np.diff(first)), height * width)
        luma = np.concatenate([[0], np.cumsum(px.sum(axis=1, dtype=np.int64))])
        for i, k in enumerate(own):
            a, b, fps = int(first[i]), int(first[i + 1]), files[k][1]
            payload = px[a:b].tobytes()
            marks = [a, *(np.flatnonzero(cut[a:b]) + a).tolist(), b] if b > a else [a]
            clips = [{"clip": j, "first_frame": x - a, "frames": y - x, "start_ms": round((x - a) * 1000 / fps), "end_ms": round((y - a) * 1000 / fps), "mean_luma": round(float(luma[y] - luma[x]) / ((y - x) * height * width), 4)} for j, (x, y) in enumerate(zip(marks, marks[1:]))]
            m = media[k]
            rows[k] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={b - a};shots={len(clips)};change={int(diff[a:b].sum())};luma={int(luma[b] - luma[a])}", clips)
    return rows


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CLIP)]
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) for x in batch.column("media")], np.int64)
        for lo, hi in passes(sizes, 4_000_000):
            cols = list(zip(*_described([x.as_py() for x in batch.column("media")[lo:hi]])))
            yield pa.record_batch([batch.column("doc_id")[lo:hi], batch.column("n_bytes")[lo:hi], *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])


def to_avi(docs: DataFrame, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a lossless motion-JPEG AVI file."""
    text = F.col(text) if isinstance(text, str) else text
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text.alias("text")).mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary")


def read_avi(files: DataFrame) -> DataFrame:
    """Digests of the samples read back, and the clips of each file: (doc_id, n_bytes, ..., feature, clips)."""
    kind = files.schema["doc_id"].dataType.simpleString()
    clip = "struct<clip:int,first_frame:int,frames:int,start_ms:long,end_ms:long,mean_luma:double>"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(_decode, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<{clip}>")


def clip_rows(files: DataFrame) -> DataFrame:
    """One row per timed clip."""
    return read_avi(files).select("doc_id", F.inline("clips"))


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_avi(to_avi(table(spark, sf_dir, "documents")))
