"""Minimum-cost-flow resharding.

Old shard sizes and new capacities are a transport problem: bytes that stay cost nothing, bytes that move cost one each. Its optimal
flow has at most (old + new) positive entries. Each old shard is a line of rows in the order of a hash of their identity, divided into blocks (equal
ranges of the hash); rows alike, which share a hash, follow each other by row number. A flow cuts the line into intervals, one for each receiver,
the part that stays first. Blocks are summed on the cluster; only the blocks that hold a cut are read by hash, to find where the cut falls, and
only among rows alike is it looked up by row number, in blocks again. So a row's shard is a function of its old shard, hash and number,
looked up among the cuts of its old shard, and only blocks that lose rows are written again.

Law ``bytes``: every new shard holds its share of all bytes, up to the row at each cut.
Collected on the driver: the sums of at most old x 2**BITS blocks, as many for a cut among rows alike, and one place for each cut, whatever the
size of the table.

Cases: a null text has size 1; a null doc_id is a value like others; rows alike in doc_id and text may be cut apart; they are the only
ties, and row numbers break them; a very long text is one row, which no cut divides, so a shard may differ from its share by it; an
empty table gives no rows; extra columns, also with dots in their names, are kept, but for any named shard or slot, which are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import ROW, alike, numbered, quoted, store, table, with_row

BITS = 10
OLD, NEW = 12, 8
#: Parts of a block whose rows are numbered apart.
PARTS = 4
#: Names of the columns that the operator adds on the way.
H, BLOCK, WAS, SIZE, NTH, BASE, FIRST, TO, KEPT, STAYS, PART = (f"_flowtide_{x}" for x in ("row_hash", "block", "old_shard", "size", "nth", "base", "first", "to", "kept_to", "stays", "part"))


def cheapest_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int, units: int) -> list[int]:
    """Units on each edge (from, to, most, price) of a flow of ``units`` from source to sink at the least total price. Primal-dual: shortest distances, then as much as fits along all shortest paths at once."""
    ends, graph = [], [[] for _ in range(nodes)]
    for a, b, most, price in edges:
        for x, y, room, cost in ((a, b, most, price), (b, a, 0, -price)):
            graph[x].append(len(ends))
            ends.append([y, room, cost])
    potential, left = [0] * nodes, units
    while left:
        dist, heap = {source: 0}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                b, room, cost = ends[e]
                if room and (far := d + cost + potential[a] - potential[b]) < dist.get(b, far + 1):
                    dist[b] = far
                    heapq.heappush(heap, (far, b))
        if sink not in dist:
            raise ValueError("the new shards have less room than the old ones hold")
        most = max(dist.values())
        potential = [p + dist.get(a, most) for a, p in enumerate(potential)]
        untried, path, on_path = [0] * nodes, [], {source}
        while left:
            a = ends[path[-1]][0] if path else source
            if a == sink:
                sent = min([left, *(ends[e][1] for e in path)])
                for e in path:
                    ends[e][1] -= sent
                    ends[e ^ 1][1] += sent
                left -= sent
                path, on_path = [], {source}
                continue
            while untried[a] < len(graph[a]):
                b, room, cost = ends[e := graph[a][untried[a]]]
                if room and b not in on_path and cost + potential[a] == potential[b]:
                    path.append(e)
                    on_path.add(b)
                    break
                untried[a] += 1
            else:
                if not path:
                    break
                on_path.discard(a)
                untried[ends[path.pop() ^ 1][0]] += 1
    return [ends[2 * e + 1][1] for e in range(len(edges))]


def min_cost_flow(supply: dict[int, int], room: list[int]) -> dict[tuple[int, int], int]:
    """Bytes that old shard i sends to new shard j, with the fewest bytes between shards of different numbers. sum(room) >= sum(supply).

    Bytes that move pass one hub, so the network has an edge for each shard and none for each pair; what passes the hub is paired off in order.
    """
    olds, n, m = sorted(supply), len(supply), len(room)
    source, sink, hub = n + m, n + m + 1, n + m + 2
    stay = [i for i, old in enumerate(olds) if 0 <= old < m]
    edges = [(source, i, supply[old], 0) for i, old in enumerate(olds)] + [(n + j, sink, r, 0) for j, r in enumerate(room)]
    edges += [(i, n + olds[i], supply[olds[i]], 0) for i in stay] + [(i, hub, supply[old], 1) for i, old in enumerate(olds)] + [(hub, n + j, r, 0) for j, r in enumerate(room)]
    sent = cheapest_flow(n + m + 3, edges, source, sink, sum(supply.values()))[n + m :]
    flow = {(olds[i], olds[i]): x for i, x in zip(stay, sent) if x}
    gives = [[old, x] for old, x in zip(olds, sent[len(stay) :]) if x]
    takes = [[j, x] for j, x in enumerate(sent[len(stay) + n :]) if x]
    while gives:
        x = min(gives[-1][1], takes[-1][1])
        key = gives[-1][0], takes[-1][0]
        flow[key] = flow.get(key, 0) + x
        for side in (gives, takes):
            side[-1][1] -= x
            if not side[-1][1]:
                side.pop()
    return flow


@dataclass
class Layout:
    """pieces: for each old shard, ((first hash, first row number), new shard) in ascending order; kept_to: the first block of each old shard that is written again."""

    pieces: dict[int, list[tuple[tuple[int, int], int]]]
    kept_to: dict[int, int]
    moved: int
    total: int

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with their new shard and whether their block stays unwritten: looked up by the old shard, of which there is one entry each."""
        entries = [(old, [at for at, _ in own], [j for _, j in own], self.kept_to[old]) for old, own in self.pieces.items()]
        found = rows.sparkSession.createDataFrame(entries, f"{WAS} int, {FIRST} array<struct<h:long,row:long>>, {TO} array<int>, {KEPT} int")
        begun = lambda x: (x["h"] < F.col(H)) | (x["h"] == F.col(H)) & (x["row"] <= F.col(ROW))
        out = rows.join(F.broadcast(found), WAS)
        return out.withColumns({"shard": F.element_at(TO, F.size(F.filter(FIRST, begun))), STAYS: F.col(BLOCK) < F.col(KEPT)}).drop(FIRST, TO, KEPT)


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame, old: Column, size: Column, identity: tuple[str, ...]) -> DataFrame:
    """docs with the columns that plan() and rewrite() read. A row of no old shard (null) counts as of shard -1. identity: the columns by whose hash a shard's rows lie."""
    docs = numbered(docs)
    h = alike(docs.select(*quoted(list(identity))))
    return docs.withColumns({WAS: F.coalesce(old.cast("int"), F.lit(-1)), SIZE: size, H: h, BLOCK: block_of(h)})


def block_of(h: Column) -> Column:
    return F.shiftright(h, 64 - BITS).cast("int")


def places(rows: DataFrame, cuts: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """cuts: (old shard, block, k, bytes of the block before the cut). For each (old shard, k) the (hash, row number) at which the next piece begins: a row belongs to the side of the cut on which its middle lies."""
    spark, rows = rows.sparkSession, rows.select(WAS, BLOCK, H, ROW, SIZE)
    at = F.broadcast(spark.createDataFrame(cuts, f"{WAS} int, {BLOCK} int, k int, at long"))  # a row for each cut
    ahead = Window.partitionBy(WAS, BLOCK).orderBy(H).rowsBetween(Window.unboundedPreceding, -1)
    line = rows.join(at.select(WAS, BLOCK).distinct(), [WAS, BLOCK], "left_semi").groupBy(WAS, BLOCK, H).agg(F.sum(SIZE).alias("n"), F.count("*").alias("alike"))
    line = line.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    hit = line.join(at, [WAS, BLOCK]).where("before <= at and at < before + n").select(WAS, "k", H, "n", "alike", (F.col("at") - F.col("before")).alias("left")).collect()
    after = lambda h: (h, 2**63 - 1)
    out = {(r[WAS], r.k): (r[H], -(2**63)) if 2 * r.left <= r.n else after(r[H]) for r in hit if r.alike == 1}
    inside = [(r[WAS], r.k, r[H], r.left) for r in hit if r.alike > 1]
    if not inside:
        return out
    among = rows.join(F.broadcast(spark.createDataFrame(inside, f"{WAS} int, k int, {H} long, at long")), [WAS, H]).select(WAS, H, "k", "at", ROW, SIZE, block_of(F.col(ROW)).alias("part"))
    parts: dict[tuple, list] = {}
    for *key, part, n in map(tuple, among.groupBy(WAS, "k", H, "at", "part").agg(F.sum(SIZE)).collect()):
        parts.setdefault(tuple(key), []).append((part, n))
    wanted = []
    for (old, k, h, left), own in parts.items():
        for part, n in sorted(own):
            if left < n:
                wanted.append((old, k, part, left))
                out[old, k] = (h, min((part + 1) << (64 - BITS), 2**63 - 1))  # unless one of its rows begins the piece
                break
            left -= n
    one = among.drop("at").join(F.broadcast(spark.createDataFrame(wanted, f"{WAS} int, k int, part int, at long")), [WAS, "k", "part"])
    upto = Window.partitionBy(WAS, "k").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("middle", F.sum(SIZE).over(upto) - F.col(SIZE) / 2).where("middle >= at")
    return out | {(r[WAS], r.k): (r[H], r["row"]) for r in one.groupBy(WAS, "k", H).agg(F.min(ROW).alias("row")).collect()}


def plan(rows: DataFrame, new: int = NEW, capacities: list[int] | None = None) -> Layout:
    """rows: of keyed(). capacities: bytes for each new shard; equal shares if None."""
    blocks = rows.groupBy(WAS, BLOCK).agg(F.sum(SIZE).alias("n")).collect()
    lines: dict[int, list[tuple[int, int]]] = {}
    for old, block, n in sorted(map(tuple, blocks)):
        lines.setdefault(old, []).append((block, n))
    olds = sorted(lines)
    sizes = {o: sum(n for _, n in lines[o]) for o in olds}
    total = sum(sizes.values())
    room = capacities or [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(sizes, room)
    sends: dict[int, list] = {old: [] for old in olds}
    for (old, j), n in flow.items():
        sends[old].append((j != old, j, n))
    cuts, order = [], {}
    for old in olds:
        parts = sorted(sends[old])
        order[old] = [j for _, j, _ in parts]
        at = 0
        for k, (_, _, n) in enumerate(parts[:-1]):
            at += n
            before = 0
            for block, held in lines[old]:
                if before + held > at:
                    cuts.append((old, block, k + 1, at - before))
                    break
                before += held
    pieces = {old: [((-(2**63), -(2**63)), js[0])] for old, js in order.items()}
    kept_to = {old: (2**31 - 1 if js == [old] else -(2**31)) for old, js in order.items()}
    found = places(rows, cuts) if cuts else {}
    for old, block, k, _ in sorted(cuts, key=lambda c: (c[0], c[2])):
        pieces[old].append((found[old, k], order[old][k]))
        if order[old][0] == old and k == 1:
            kept_to[old] = block
    moved = sum(n for (old, j), n in flow.items() if old != j)
    return Layout(pieces, kept_to, moved, total)


def rewrite(rows: DataFrame, layout: Layout, columns: list[str]) -> DataFrame:
    """Write the rows of affected blocks into shard=k folders of a new store, and read them together with the blocks that stay where they are."""
    out = layout.placed(rows.drop("shard"))
    keep = quoted([*(c for c in columns if c not in ("shard", "slot", ROW)), WAS, BLOCK, H, SIZE, ROW, "shard"])
    path = shared_folder(rows.sparkSession, "shards")
    moved = out.where(~F.col(STAYS)).select(*keep)
    moved.write.partitionBy("shard").parquet(path)
    again = rows.sparkSession.read.schema(moved.schema).parquet(path).select(*keep)
    return out.where(STAYS).select(*keep).unionByName(again)


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps. Only blocks are sorted, of which rows alike have several; their offsets come from block counts. Rows have ROW."""
    rows = rows.withColumn(PART, F.pmod(F.xxhash64(ROW), F.lit(PARTS)).cast("int"))
    key = ["shard", WAS, BLOCK, PART]
    counts = rows.groupBy(*key).agg(F.count("*").alias(NTH))
    ahead = Window.partitionBy("shard").orderBy(WAS, BLOCK, PART).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*key, F.coalesce(F.sum(NTH).over(ahead), F.lit(0)).alias(BASE))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(H, ROW))
    return rows.withColumn(NTH, inside).join(base, key).withColumn("slot", (F.col(BASE) + F.col(NTH) - 1).cast("long")).drop(NTH, BASE, PART)


def landed_shard(source: str = "source", old: int = OLD) -> Column:
    """The old layout of documents that landed by source."""
    return F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(old))


def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = keyed(docs, landed_shard(), size_of(), ("doc_id", "text"))
    done = rewrite(rows, plan(rows), ["doc_id", "text"])
    narrow = store(done.select("doc_id", F.col(SIZE), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard", WAS, BLOCK, H, ROW), "op1")
    out = with_slots(narrow)
    return out.select("doc_id", F.col(SIZE).alias("size"), F.col("text_crc32").cast("long"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col(WAS).alias("old_shard"), (F.col("shard") != F.col(WAS)).alias("moved"))
