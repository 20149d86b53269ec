"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

Words are lower-cased runs of letters and digits; a document is the multiset of its five-word shingles (all its words as one shingle if
it has fewer). The similarity is the weighted Jaccard coefficient of two multisets; links need SIMILARITY.

Signatures: the discretised weight axis is cut into the intervals (0,1], (1,2], (2,4], ...; a shingle of count w meets those that begin below w. Each
interval is a Poisson process of its own, with a rate of its width and M registers, made point by point from hashes. The published method splits the process of
the whole axis down a tree instead, to skip parts of it; on disjoint intervals both are the same process, and here a point's place in its interval is drawn at once.
A point counts if its weight level is at most w. A register keeps the earliest point of all shingles, so two documents agree in it with a probability equal to
their similarity. Points are made only up to the time by which all registers are filled.

Exact copies (same words) are one node from the start. Buckets of equal bands give candidates: buckets of at most SMALL nodes are compared
in full (a linear number of pairs); in larger ones all nodes are compared with one hub. Those whose nodes then lie in more than one
component have a largest component and a rest. Both are cut into blocks of about BLOCK nodes and BLOCK_BYTES of text at most; blocks of the rest meet each
other and those of the largest component. Where many buckets share that component, it meets the rest of all of them at once, if that takes fewer
comparisons than one bucket after the other. A pair of blocks is compared in two steps: by signatures alone, which leaves the nodes that have a
partner in another component; then those, with their texts, in a task that reports only links that join components. So no link between
components is lost, and no group's pairs are all emitted.

Cases: texts without a word are nodes of their own, never linked (each row its own class); a null doc_id is a value like others; repeated
rows are copies, of which one stands for the class; ties for that go to the least hash of all columns (of the text, if the rows have none), then the least row number; empty tables give empty results; texts are read
whole, a very long one in a pass of its own of about twenty times its size; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALIKE, ROW, batches_of, hashed_words, mix, numbered, passes, store, table, utf8, with_row

SHINGLE, SIMILARITY = 5, 0.8
M, BANDS, ROWS = 128, 25, 5
SMALL, BLOCK, BLOCK_BYTES = 16, 512, 16 << 20
#: A pair of blocks: kind 0 of the rest of a bucket, 1 of a bucket and its largest component, 2 of a component and the rest of all its buckets.
PAIR = ["kind", "grp", "bi", "bj"]
#: Shingle hashes keep so many bits, as text number and hash are sorted as one whole number.
HASH_BITS = 44
#: A block's pair is verified if its signatures agree in so many of M registers: five standard errors below SIMILARITY.
LEAST_EQUAL = int(M * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / M) ** 0.5))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of each distinct shingle of each text, ordered; and 128 bits of hash of each text's words (first half 0: no word)."""
    words, doc, first = hashed_words(texts)
    n = len(texts)
    length = np.diff(first)
    full = np.maximum(length - SHINGLE + 1, 0)
    begin = np.repeat(first[:-1] - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
    h = np.zeros(len(begin), np.uint64)
    for j in range(SHINGLE):
        h = h * _ODD + mix(words[begin + j])
    owner = np.repeat(np.arange(n), full)
    place = np.arange(len(words)) - np.repeat(first[:-1], length)
    weighed = mix(words + _ODD * (place.astype(np.uint64) + np.uint64(1)))
    key = np.zeros((2, n), np.uint64)
    for half in range(2):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(weighed if half == 0 else mix(weighed ^ _ODD), dtype=np.uint64, out=total[1:])
        key[half] = mix(total[first[1:]] - total[first[:-1]] + length.astype(np.uint64))
    key[0][key[0] == 0] = 1
    key[:, length == 0] = 0
    short = np.flatnonzero((length > 0) & (length < SHINGLE))
    owner, h = np.concatenate([owner, short]), np.concatenate([h, key[0][short]])
    packed = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(h) >> np.uint64(64 - HASH_BITS)))
    packed, count = np.unique(packed, return_counts=True)
    return (packed >> np.uint64(HASH_BITS)).astype(np.int64), packed & np.uint64((1 << HASH_BITS) - 1), count, key


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """(n_docs, m) signatures of 32 bits; doc, element, weight: the elements of each document's multiset. Documents without elements have zeros."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1)
    seed = mix(element[at] + _ODD * (level.astype(np.uint64) + np.uint64(1)))
    owner, top = doc[at], weight[at]
    mass = np.bincount(doc, weights=weight, minlength=n_docs)
    register = np.full(n_docs * m, np.inf)
    until = (np.log(m) + 5) / np.maximum(mass, 1)
    todo = np.ones(n_docs, np.bool_)
    while len(owner):
        live = np.flatnonzero(todo[owner])
        s, o, r, lo, w = seed[live], owner[live], rate[live], low[live], top[live]
        x, limit, step = np.zeros(len(live)), until[o], 0
        while len(s):
            step += 1
            u = mix(s + np.uint64((int(_ODD) * step) % 2**64))
            x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / r
            stay = x < limit
            s, o, r, lo, w, x, limit, u = s[stay], o[stay], r[stay], lo[stay], w[stay], x[stay], limit[stay], u[stay]
            v = mix(u ^ np.uint64(0xD1B54A32D192ED03))
            counts = lo + 1 + ((v >> np.uint64(32)) % r.astype(np.uint64)).astype(np.int64) <= w
            np.minimum.at(register, (o * m + (v % np.uint64(m)).astype(np.int64))[counts], x[counts])
        todo = np.zeros(n_docs, np.bool_)
        empty = np.isinf(register.reshape(n_docs, m)).any(axis=1) & (mass > 0)
        if not empty.any():
            break
        todo[empty] = True
        until[empty] *= 2
    out = (mix(register.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n_docs, m)
    out[mass == 0] = 0
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = utf8(batch.column("text"))
        for lo, hi in passes(pc.utf8_length(text).to_numpy(zero_copy_only=False)):
            doc, h, count, key = shingles(text[lo:hi])
            sig = bag_minhash(doc, h, count, hi - lo)
            bands = np.zeros((hi - lo, BANDS), np.uint64)
            for b in range(BANDS):
                for j in range(ROWS):
                    bands[:, b] = mix(bands[:, b] * _ODD + sig[:, b * ROWS + j].astype(np.uint64) + np.uint64(b + 1))
            some = key[0] != 0
            band_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(bands[some].view(np.int64).ravel()))
            sigs = pa.array([s.tobytes() for s in sig.astype(np.uint16)], pa.binary())
            size = pc.binary_length(text[lo:hi]).cast(pa.int64())
            yield from batches_of([*(batch.column(c)[lo:hi] for c in ("doc_id", ROW, ALIKE)), *map(pa.array, key.view(np.int64)), size, band_lists, sigs], ["doc_id", ROW, ALIKE, "k1", "k2", "size", "bands", "sig"])


def overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard coefficient of two multisets: sorted elements and counts."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    shared = int(np.minimum(na[both], nb[at[both]]).sum())
    return shared / (int(na.sum()) + int(nb.sum()) - shared)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    arr, out = pa.array(texts, pa.large_string()), []
    for lo, hi in passes(pc.utf8_length(arr).to_numpy(zero_copy_only=False)):
        doc, h, count, _ = shingles(arr[lo:hi])
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [(h[x:y], count[x:y]) for x, y in zip(cut, cut[1:])]
    return out


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                text = dict(zip(a, part.column("ta").to_pylist())) | dict(zip(b, part.column("tb").to_pylist()))
                bag = dict(zip(text, _bags(list(text.values()))))
                sim = [overlap(*bag[x], *bag[y]) for x, y in zip(a, b)]
                keep = [i for i, s in enumerate(sim) if s >= least]
                yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([sim[i] for i in keep], pa.float64())], names=["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose multisets reach the similarity; texts: (node, text)."""
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verified(least), "a long, b long, similarity double")


def _partnered(pdf):
    """One pair of blocks, by signatures: the nodes that may be linked with one of another component on the other side."""
    pdf = pdf.sort_values("node")
    sig = np.stack([np.frombuffer(s, np.uint16) for s in pdf.sig])
    side, comp, one, some = pdf.blk.to_numpy(), pdf.comp.to_numpy(), pdf.bi.iloc[0] == pdf.bj.iloc[0], np.zeros(len(pdf), np.bool_)
    for i in range(len(pdf)):
        rest = np.arange(i + 1, len(pdf))
        rest = rest[(comp[rest] != comp[i]) & (one | (side[rest] != side[i]))]
        rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= LEAST_EQUAL]
        some[rest] = True
        some[i] |= len(rest) > 0
    return pdf.loc[some, [*PAIR, "blk", "node", "comp"]]


def _compared(least: float):
    """One pair of blocks: links between nodes of different components, as few as join them."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        sig = np.stack([np.frombuffer(s, np.uint16) for s in pdf.sig])
        node, side, comp = pdf.node.to_numpy(), pdf.blk.to_numpy(), pdf.comp.to_numpy()
        parent = {c: c for c in set(comp.tolist())}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        one = pdf.bi.iloc[0] == pdf.bj.iloc[0]
        bags, links = _bags(pdf.text.tolist()), []
        for i in range(len(node)):
            rest = np.arange(i + 1, len(node))
            rest = rest[(comp[rest] != comp[i]) & (one | (side[rest] != side[i]))]
            equal = (sig[rest] == sig[i]).sum(axis=1)
            for j in rest[equal >= LEAST_EQUAL][np.argsort(-equal[equal >= LEAST_EQUAL], kind="stable")]:
                x, y = root(comp[i]), root(comp[j])
                if x != y and (s := overlap(*bags[i], *bags[j])) >= least:
                    parent[max(x, y)] = min(x, y)
                    links.append((min(node[i], node[j]), max(node[i], node[j]), s))
        return pd.DataFrame(links, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the least node of each linked node's component.

    In each round a node points to its least neighbour, if that is less than itself; pointers are followed to their heads, and only links between different heads go on,
    once each. A head that outlives two rounds has taken in all its neighbours in the first, so heads halve, and links are joined in few rounds, not once for each step of the longest path.
    """
    edges = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        heads = store(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")), f"{name}-heads")
        while True:
            hop = heads.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            step = store(heads.join(hop, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"), F.col("far").isNotNull().alias("moved")), f"{name}-heads")
            heads = step.select("node", "comp")
            if step.where("moved").isEmpty():
                break
        of = lambda end: heads.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_head"))
        ends = [F.coalesce(f"{end}_head", end) for end in "ab"]
        edges = store(edges.join(of("b"), "b").join(of("a"), "a", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a < b").distinct(), f"{name}-edges")
        if labels is not None:
            was = labels.join(heads.select(F.col("node").alias("comp"), F.col("comp").alias("head")), "comp", "left")
            heads = store(was.select("node", F.coalesce("head", "comp").alias("comp")).unionByName(heads), name)
        labels = heads
    return store(labels.unionByName(labels.select(F.col("comp").alias("node"), "comp").distinct()), name)


def block_pairs(large: DataFrame) -> DataFrame:
    """(PAIR, blk, node, comp): the members of each pair of blocks of the large buckets that hold several components. large: (band, node, comp, size)."""
    sizes = large.groupBy("band", "comp").agg(F.count("*").alias("c"))
    top = sizes.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("t"), F.count("*").alias("comps")).where("comps > 1").select("band", F.col("t.comp").alias("main"))
    hot = store(large.join(store(top, "op7-mains"), "band").withColumn("is_main", F.col("comp") == F.col("main")), "op7-hot")
    n = lambda cond: F.count_if(cond)
    apart = hot.groupBy("main", "band").agg((n(F.col("is_main")) * n(~F.col("is_main"))).alias("pairs")).groupBy("main").agg(F.sum("pairs").alias("apart"))
    together = hot.select("main", "node", "is_main").distinct().groupBy("main").agg((n(F.col("is_main")) * n(~F.col("is_main"))).alias("together"))
    dense = store(apart.join(together, "main").where("together <= apart").select("main", F.lit(True).alias("dense")), "op7-dense")
    met = hot.join(dense, "main", "left").withColumn("kind", F.when(F.col("dense"), 2).otherwise(1))
    met = met.select("kind", F.when(F.col("dense"), F.col("main")).otherwise(F.col("band")).alias("grp"), "node", "comp", "size", "is_main").distinct()
    rest = hot.where("not is_main").select(F.lit(0).alias("kind"), F.col("band").alias("grp"), "node", "comp", "size", "is_main")
    rows = store(met.unionByName(rest), "op7-met")
    of = lambda cond: F.greatest(F.ceil(n(cond) / BLOCK), F.ceil(F.sum(F.when(cond, F.col("size")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    blocks = rows.groupBy("kind", "grp").agg(of(F.col("is_main")).alias("g_main"), of(~F.col("is_main")).alias("g_rest"))
    rows = rows.join(store(blocks, "op7-blocks"), ["kind", "grp"])
    own = F.when(F.col("is_main"), F.col("g_rest") + F.pmod(F.xxhash64("node"), "g_main")).otherwise(F.pmod(F.xxhash64("node"), "g_rest")).cast("int")
    # the largest component meets the rest, and the rest it; with nothing else to meet, the rest meets itself
    first = F.when((F.col("kind") > 0) & ~F.col("is_main"), F.col("g_rest")).otherwise(0)
    last = F.when((F.col("kind") > 0) & ~F.col("is_main"), F.col("g_rest") + F.col("g_main")).otherwise(F.col("g_rest")) - 1
    dealt = rows.withColumn("blk", own).withColumn("other", F.explode(F.sequence(first, last)))
    return dealt.select("kind", "grp", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "node", "comp")


def links(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, ROW, ALIKE, node (null: no word); links: a, b, similarity between nodes, as many as hold the components together)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = numbered(docs).select("doc_id", "text", ROW, F.col(ALIKE) if ALIKE in docs.columns else F.xxhash64("text").alias(ALIKE))
    sketch = store(keyed.mapInArrow(_sketched, f"doc_id {kind}, {ROW} long, {ALIKE} long, k1 long, k2 long, size long, bands array<long>, sig binary"), "op7-sketch")
    nodes = sketch.where("k1 <> 0").groupBy("k1", "k2").agg(F.min(F.struct(ROW, "size", "bands", "sig")).alias("r"))
    nodes = store(nodes.select((F.monotonically_increasing_id() + 1).alias("node"), "k1", "k2", "r.*"), "op7-nodes")
    rows = sketch.select("doc_id", ROW, ALIKE, "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").drop("k1", "k2")
    entries = nodes.select("node", "size", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("node", "band").alias("o"), "node")
    # written, so that the joins with all rows of a band or component shuffle both sides and Spark can split the very large ones
    buckets = entries.groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("hub")).where("n > 1")
    buckets = store(buckets.select("band", "n", F.col("hub.node").alias("hub")), "op7-buckets")
    members = store(entries.join(buckets, "band"), "op7-members")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = members.where(f"n > {SMALL} and node <> hub").select(*ordered("node", "hub"))
    few = members.where(f"n <= {SMALL}").select("band", "node")
    full = few.join(few.select("band", F.col("node").alias("other")), "band").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = store(star.unionByName(full).distinct(), "op7-pairs")
    held = members.select("node").distinct().join(nodes.select("node", ROW), "node")
    texts = store(keyed.select(ROW, "text").join(held, ROW).select("node", "text"), "op7-texts")
    first = store(verify(pairs, texts, least), "op7-links")
    large = members.where(f"n > {SMALL}").select("band", "node", "size")
    large = large.join(components(first, "op7-first"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    dealt = block_pairs(large).join(nodes.select("node", "sig"), "node")
    near = store(dealt.groupBy(*PAIR).applyInPandas(_partnered, "kind int, grp long, bi int, bj int, blk int, node long, comp long"), "op7-partners")
    dealt = near.join(nodes.select("node", "sig"), "node").join(texts, "node")
    second = store(dealt.groupBy(*PAIR).applyInPandas(_compared(least), "a long, b long, similarity double").dropDuplicates(["a", "b"]), "op7-more")
    return rows, store(first.unionByName(second), "op7-all")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, ROW, class_id, class_key, keep, similarity): class_id is the least doc_id of the class; keep: the row stands for its class; similarity: the greatest of the
    verified links that join the row's text to its class, or 1 for a text with copies (null: alone). Rows without words are classes of their own. docs may have ALIKE, by which rows of one doc_id are chosen."""
    rows, found = links(docs, least)
    rows = store(rows, "op7-rows")
    labels = components(found)
    node = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", ALIKE, ROW)).alias("r"), F.count("*").alias("copies"))
    ends = found.select(F.col("a").alias("node"), "similarity").unionByName(found.select(F.col("b").alias("node"), "similarity"))
    ends = ends.groupBy("node").agg(F.max("similarity").alias("near"))
    node = node.join(labels, "node", "left").join(ends, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    node = store(node, "op7-classes")
    head = node.groupBy("comp").agg(F.min("r").alias("head"))
    copied = F.when(F.col("copies") > 1, F.lit(1.0))
    node = node.join(head, "comp").select("node", "comp", "head", F.coalesce(copied, "near").alias("similarity"))
    full = rows.join(node, "node", "left")
    lone = F.col("node").isNull()
    class_id = F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    keep = lone | (F.col(ROW) == F.col(f"head.{ROW}"))
    return full.select("doc_id", ROW, class_id.alias("class_id"), F.coalesce("comp", F.lit(0)).alias("class_key"), keep.alias("keep"), "similarity")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(with_row(table(spark, sf_dir, "documents"))).select("doc_id", "class_id", "keep", F.round("similarity", 6).alias("similarity"))
