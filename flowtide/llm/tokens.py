"""Token counts by offset-mapped attribution.

Each document's fields are joined by line feeds and encoded once, as a whole. Token lengths in bytes give every token a span; the
spans are interval-joined (binary search over section starts) to sections: each leading field is one section, each line of the
last field is one. A line feed belongs to the section that it ends. A token that crosses a boundary goes, by RULE ``majority``,
to the section that holds most of its bytes, the earlier one on a tie; by ``start``, to the section of its first byte.

Cases: null fields are empty; an empty text has one empty line and no tokens of its own; a null id is a value like others; repeated rows give
repeated rows; ties of bytes go to the earlier section; empty tables give empty results; very long texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, passes, raw_bytes, table, utf8

#: A vocabulary file of the driver's machine; it is sent to the executors.
VOCABULARY = os.environ.get("FLOWTIDE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How this vocabulary splits text before merging bytes (a fixed value that belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str, pattern: str):
    """(encoding, length in bytes of each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("flowtide", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(ends: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """ends: byte end of each token of a document; sections: byte start of each section, the first at 0. Returns (section of each token, whether it crosses a boundary)."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crosses = last > first
    if rule == "majority" and crosses.any():
        stops = np.append(sections[1:], np.iinfo(np.int64).max)
        at = np.flatnonzero(crosses)
        spans = last[at] - first[at] + 1
        token = np.repeat(at, spans)
        section = np.repeat(first[at], spans) + np.arange(len(token)) - np.repeat(np.cumsum(spans) - spans, spans)
        held = np.minimum(stops[section], ends[token]) - np.maximum(sections[section], starts[token])
        order = np.lexsort((section, -held, token))
        token, section = token[order], section[order]
        best = np.concatenate([[True], token[1:] != token[:-1]])
        first[token[best]] = section[best]
    return first, crosses


def _attributed(fields: int, name: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        path = SparkFiles.get(name)
        for batch in batches:
            text = utf8(batch.column("text"))
            leads = [pc.binary_length(utf8(batch.column(f"f{i}"))).to_numpy(zero_copy_only=False) + 1 for i in range(fields)]
            data, at = raw_bytes(text)
            encoding, lengths = encoder(path, pattern)
            for lo, hi in passes(np.diff(at), 1_000_000):
                rows = []
                for i in range(lo, hi):
                    own = data[at[i] : at[i + 1]]
                    ids = np.asarray(encoding.encode_to_numpy(own.tobytes().decode("utf-8", "surrogatepass"), disallowed_special=()), np.int64)
                    lead = np.cumsum([0, *(int(x[i]) for x in leads)])
                    lines = np.flatnonzero(own[lead[-1] :] == 10) + 1 + lead[-1]
                    sections = np.concatenate([lead, lines])
                    section, crosses = allocate(np.cumsum(lengths[ids]), sections, rule)
                    n = np.bincount(section, minlength=len(sections))
                    rows.append((len(ids), n[:fields].tolist(), int(n[fields:].sum()), n[fields:].tolist(), int(crosses.sum())))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.int64()]
                yield from batches_of([batch.column("doc_id")[lo:hi], *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_tokens", "field_tokens", "text_tokens", "line_tokens", "crossing"])

    return run


def attribute(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang"), text: str = "text", key: str = "doc_id", path: str = VOCABULARY, pattern: str = PATTERN, rule: str = "majority") -> DataFrame:
    """(doc_id, n_tokens, field_tokens: tokens of each leading field, text_tokens, line_tokens: of each line, crossing: tokens over a boundary)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = docs.schema[key].dataType.simpleString()
    docs.sparkSession.sparkContext.addFile(path)
    whole = docs.select(F.col(key).alias("doc_id"), *(blank(c).alias(f"f{i}") for i, c in enumerate(fields)), F.concat_ws("\n", *map(blank, [*fields, text])).alias("text"))
    return whole.mapInArrow(_attributed(len(fields), os.path.basename(path), pattern, rule), f"doc_id {kind}, n_tokens long, field_tokens array<long>, text_tokens long, line_tokens array<int>, crossing long")


def op9_token_attribution(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    out = attribute(table(spark, sf_dir, "documents"), path=vocabulary)
    return out.select("doc_id", "n_tokens", F.col("field_tokens")[0].alias("source_tokens"), F.col("field_tokens")[1].alias("lang_tokens"), "text_tokens", F.size("line_tokens").alias("lines"), "line_tokens", "crossing")
