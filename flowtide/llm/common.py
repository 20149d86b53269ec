"""Shared helpers: tables, written intermediate results, and Arrow text handling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Most code points that one numpy pass handles at a time; longer texts make a pass of their own.
PASS_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The columns of with_row(): the number of a row, and a hash of all its columns.
ROW, ALIKE = "_flowtide_row", "_flowtide_alike"
#: Bits of the row's place in its file; the others number the file.
PLACE_BITS = 40
SCHEME = r"^([A-Za-z0-9+.-]+):/+"


def spread(number: Column) -> Column:
    """A permutation of the 64-bit numbers (two Feistel rounds), so that successive ones lie far apart and no two become one."""
    half = F.lit((1 << 32) - 1)
    left, right = F.shiftrightunsigned(number, 32), number.bitwiseAND(half)
    top = left.bitwiseXOR(F.xxhash64(F.lit(1), right).bitwiseAND(half))
    return F.shiftleft(top, 32).bitwiseOR(right.bitwiseXOR(F.xxhash64(F.lit(2), top).bitwiseAND(half)))


def with_row(scan: DataFrame) -> DataFrame:
    """scan: a table read from files, or chosen rows and columns of one; rows of memory are written first. Adds ROW, a number of each row made from the number of its file (among the names of all the table's files, in order) and its place in it, so that no two rows have one number and every scan of the table finds the same."""
    spark = scan.sparkSession
    try:
        place = scan.metadataColumn("_metadata")
    except AnalysisException:
        scan = store(scan, "rows")
        place = scan.metadataColumn("_metadata")
    # the driver holds the names of a table's files in any case; a local one has one slash after its scheme or three
    names = sorted({re.sub(SCHEME, r"\1:/", name) for name in scan.inputFiles()})
    files = spark.createDataFrame(list(enumerate(names)), "_flowtide_file long, _flowtide_path string")
    columns = quoted(scan.columns)
    found = scan.withColumns({"_flowtide_of": F.regexp_replace(place["file_path"], SCHEME, "$1:/"), "_flowtide_at": place["row_index"]}).join(F.broadcast(files), F.col("_flowtide_of") == F.col("_flowtide_path"), "left")
    known = F.col("_flowtide_file").isNotNull() & (F.col("_flowtide_at") < 1 << PLACE_BITS)
    number = F.shiftleft("_flowtide_file", PLACE_BITS).bitwiseOR(F.col("_flowtide_at"))
    return found.select(*columns, F.when(known, spread(number)).otherwise(F.raise_error(F.lit("a row without a place in its table"))).alias(ROW))


def alike(docs: DataFrame) -> Column:
    """A hash of all columns: rows that share it are the same but for their place, which a rerun of what wrote them may change."""
    plain = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else F.col(c) for c, f in zip(quoted(docs.columns), docs.schema)]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW; rows of any other origin than with_row() are written first, as a plan may make them in another order each time."""
    return docs if ROW in docs.columns else with_row(store(docs, "rows"))


def quoted(columns: list[str]) -> list[str]:
    """Names for select(), which would read a dot as a step into a struct."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def kept_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, with all their columns, of which keep(texts of a batch) is true. Columns are renamed on the way, as Arrow functions take plain names only."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(utf8(batch.column(at))), pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def utf8(column: pa.Array) -> pa.Array:
    """A text column as large_string without nulls (null: empty), in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, without copying."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(lengths: np.ndarray, most: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to at most ``most`` (one row at least)."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, start offset of each text and the end)."""
    data, _ = raw_bytes(texts)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=starts[1:])
    return cps, starts


_tables: dict[str, np.ndarray] = {}


def char_class(kind: str) -> np.ndarray:
    """A lookup by code point: 'word' for letters and digits, 'letter' for letters."""
    if kind not in _tables:
        test = str.isalnum if kind == "word" else str.isalpha
        _tables[kind] = np.fromiter((test(chr(i)) for i in range(0x110000)), np.bool_, 0x110000)
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, PASS_CHARS + 1)
        for name, b in (("up", base), ("down", pow(base, -1, 2**64))):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, from prefix sums of a polynomial modulo 2**64."""
    up, down = _powers_of(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def word_spans(is_in: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True, cut at text starts: (first, end, index of the text)."""
    n = len(is_in)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, np.bool_)
    edge[starts] = True
    before = np.empty(n, np.bool_)
    before[0] = False
    before[1:] = is_in[:-1]
    first = np.flatnonzero(is_in & (~before | edge[:n]))
    after = np.empty(n, np.bool_)
    after[-1] = False
    after[:-1] = is_in[1:]
    end = np.flatnonzero(is_in & (~after | edge[1:])) + 1
    doc = np.searchsorted(starts, first, side="right") - 1
    return first, end, doc


def pieces(text: str, most: int) -> Iterator[str]:
    """The text in stretches of about ``most`` characters, none of which begins inside a word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end


def hashed_words(texts: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs of letters and digits) of all texts: (word hashes, text of each word, first word of each text and the end). A text of more than ``most`` characters (PASS_CHARS) is read in pieces, as the arrays by character are many times its size."""
    most = most or PASS_CHARS
    if len(texts) and pc.max(pc.utf8_length(texts)).as_py() > most:
        parts = [[hashed_words(pa.array([p], pa.large_string()), len(p) + 1)[0] for p in pieces(t.as_py(), most)] for t in texts]
        size = [sum(map(len, own)) for own in parts]
        words = np.concatenate([np.zeros(0, np.uint64), *(w for own in parts for w in own)])
        return words, np.repeat(np.arange(len(texts)), size), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    cps, starts = code_points(pc.utf8_lower(texts))
    first, end, doc = word_spans(char_class("word")[cps], starts)
    return span_hashes(cps, first, end), doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def batches_of(arrays: list, names: list[str], size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length."""
    whole = pa.record_batch(arrays, names=names)
    for at in range(0, max(1, whole.num_rows), size):
        yield whole.slice(at, size)
