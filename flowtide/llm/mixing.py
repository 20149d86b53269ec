"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Targets: the words of all documents are shared by weight; a source's target stops at CAP times its own words and the excess is shared
again by weight. Seats: blocks of equal word counts go to the sources with the highest quotients target / (2 j + 1). Only the quotients
near each source's fair share are made, as no other can decide. Shards: a source's blocks lie in order on its word line, cut into
PARTS contiguous shards; cumulative rounding divides its seats over them into whole quotas. Selection: in each shard all blocks are
taken quota div blocks times, and the first quota mod blocks of them once more: one, drawn by the seed, of each of so many
equal stretches of the shard.

Blocks are never listed. How often a block is taken, and how many words are taken before it, follow from its number by a few whole-number formulas and one
draw, so a source of 10**12 words costs no more than its documents, however small the blocks are that the smallest source needs.

A source's documents lie on its word line in a seeded order. A block may begin or end inside a document, so a document's taken words
are those of its part of the line, and every source meets its target up to one block of each shard. A source is cut into 16**CELL_DIGITS cells by
the seed's hash; no window holds more than one cell of documents. Words are counted once, and written with the ids, and so are the places on the line. Only the table of sources, one
row each, passes through one task.

Cases: a null or blank text has no words and takes none; null sources are one source, ordered last; a null doc_id is a value like others; ties in
the seeded order are rows alike, or are told apart by the columns named in tie; a very long text may span many blocks; if there are no words all
targets are 0; an empty table gives no rows; extra columns are ignored, but for those named in keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, store, table

CAP, SEED, PARTS = 3, 11, 16
#: Blocks: about SEATS in all, more where the smallest target would get fewer than LEAST_SEATS; a block has one word at least.
SEATS, LEAST_SEATS = 65_536, 200
#: Hexadecimal digits of the seed's hash that number the cells of a source.
CELL_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds k, rank, weight, total and target."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
    below = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "weights": F.sum("weight").over(everything),
        "cap_below": F.coalesce(F.sum(CAP * F.col("source_size")).over(below), F.lit(0)),
        "weight_below": F.coalesce(F.sum("weight").over(below), F.lit(0)),
    })
    capped = F.col("cap_below") + F.col("ratio") * (F.col("weights") - F.col("weight_below")) <= F.col("total")
    ranked = ranked.withColumn("capped", capped)
    own = lambda c: F.sum(F.when(F.col("capped"), c).otherwise(F.lit(0))).over(everything)
    ranked = ranked.withColumns({"cap_used": own(CAP * F.col("source_size")), "weight_used": own(F.col("weight"))})
    level = (F.col("total") - F.col("cap_used")) / F.nullif(F.col("weights") - F.col("weight_used"), F.lit(0))
    return ranked.withColumn("target", F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level))


def seats(sources: DataFrame) -> DataFrame:
    """Sainte-Laguë: adds block (words of a block), n (blocks of the source) and seats to the rows of targets()."""
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.floor(F.least(F.col("total") / SEATS, least / LEAST_SEATS)))
    s = sources.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    s = s.withColumn("all_seats", F.floor(F.col("total") / F.col("block"))).withColumn("m", F.count("*").over(everything))
    s = s.withColumn("fair", F.when(F.col("total") > 0, F.col("target") * F.col("all_seats") / F.col("total")).otherwise(F.lit(0.0)))
    margin = F.least(F.col("all_seats"), F.ceil(2 * F.col("fair") * F.col("m") / F.greatest(F.col("all_seats"), F.lit(1))) + 2)
    s = s.withColumn("sure", F.greatest(F.lit(0), F.floor("fair") - margin)).withColumn("last", F.floor("fair") + margin)
    s = s.withColumn("open", F.col("all_seats") - F.sum("sure").over(everything))
    tried = s.where("target > 0 and all_seats > 0").select("rank", "target", "open", F.explode(F.sequence("sure", "last")).alias("j"))
    order = Window.orderBy(F.desc(F.col("target") / (2 * F.col("j") + 1)), "rank", "j")
    won = tried.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy("rank").agg(F.count("*").alias("won"))
    s = s.join(won, "rank", "left").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))))
    # a block is taken CAP times at most
    return s.withColumn("seats", F.least(F.col("sure") + F.coalesce("won", F.lit(0)), CAP * F.col("n")).cast("long")).drop("won", "sure", "last", "open", "fair", "m")


def _whole(x) -> Column:
    """A whole number of up to 38 digits, as products of block numbers may pass 64 bits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def draw(*parts) -> Column:
    """A number below 2**32 from the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, int) else p for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def taken_words(line: DataFrame, at: str, out: str, seed: int) -> DataFrame:
    """Adds ``out``: the words taken of the first ``at`` words of a source's line. line has k, n, block and seats of the source.

    Shard p has the blocks from ceil(p n / PARTS) on; before block e at its edge lie floor(seats e / n + 1 / 2) seats. In a shard of ``own`` blocks with m
    seats left over, stretch s begins at block ceil(s own / m), and block j lies in stretch floor(j m / own); one block of each stretch is drawn.
    """
    div = lambda x, y: F.call_function("div", x, y)
    up = lambda x, y: div(x + y - 1, y)
    share = lambda e: div(2 * _whole("seats") * _whole(e) + _whole("n"), 2 * _whole("n"))
    x = line.withColumn("_b", div(F.col(at), F.col("block")))
    x = x.withColumn("_p", div(F.least(F.col("_b"), F.col("n") - 1) * PARTS, F.col("n")))
    x = x.withColumn("_first", up(F.col("_p") * F.col("n"), F.lit(PARTS))).withColumn("_own", up((F.col("_p") + 1) * F.col("n"), F.lit(PARTS)) - F.col("_first"))
    x = x.withColumn("_gone", share("_first")).withColumn("_quota", share(F.col("_first") + F.col("_own")) - F.col("_gone"))
    x = x.withColumns({"_j": F.col("_b") - F.col("_first"), "_m": F.col("_quota") % F.col("_own"), "_all": div(F.col("_quota"), F.col("_own"))})
    some = F.greatest(F.col("_m"), F.lit(1))
    x = x.withColumn("_s", div(_whole("_j") * _whole("_m"), _whole("_own")))
    edge = lambda s: up(_whole(s) * _whole("_own"), _whole(some))
    x = x.withColumn("_s0", edge("_s")).withColumn("_drawn", F.col("_s0") + draw(seed, F.col("k"), F.col("_p"), F.col("_s")) % F.greatest(F.lit(1), edge(F.col("_s") + 1) - F.col("_s0")))
    left = F.col("_m") > 0
    before = F.col("_gone") + F.col("_all") * F.col("_j") + F.when(left, F.col("_s") + F.when(F.col("_drawn") < F.col("_j"), 1).otherwise(0)).otherwise(0)
    copies = F.col("_all") + F.when(left & (F.col("_drawn") == F.col("_j")), 1).otherwise(0)
    # at the end of a line of whole blocks there is no block, and all seats lie before it
    inside = F.col(at) - F.col("_b") * F.col("block")
    words = F.when(F.col("_b") >= F.col("n"), F.col("seats") * F.col("block")).otherwise(before * F.col("block") + copies * inside)
    return x.withColumn(out, words.cast("long")).drop("_b", "_p", "_first", "_own", "_gone", "_quota", "_j", "_m", "_all", "_s", "_s0", "_drawn")


def order_key(seed: int) -> Column:
    """The seeded order of documents: a hash of id and text, each with its length, so that no two differ only in where one ends."""
    doc = F.col("doc_id").cast("string")
    length = lambda x: F.coalesce(F.length(x), F.lit(-1))
    return F.md5(F.concat_ws(":", F.lit(seed), length(doc), doc, length(F.col("text")), F.col("text")).cast("binary"))


def mix(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, *keep) for each document; tie: columns of keep that order rows alike in id and text."""
    d = docs.select("doc_id", "source", *quoted(list(keep)), word_count().alias("size"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("k"), order_key(seed).alias("h")).withColumn("cell", F.substring("h", 1, CELL_DIGITS))
    d = store(d, "op6-sizes")
    cells = d.groupBy("k", "cell").agg(F.sum("size").alias("held"), F.max("source").alias("source"))
    ahead = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("k", "cell", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    # written, a row for each source, so that the plan over the documents holds none of the windows above
    sources = store(seats(targets(cells.groupBy("k").agg(F.max("source").alias("source"), F.sum("held").alias("source_size")))).select("k", "source_size", "target", "block", "seats", "n"), "op6-sources")
    inside = Window.partitionBy("k", "cell").orderBy("h", *quoted(list(tie))).rowsBetween(Window.unboundedPreceding, 0)
    line = d.withColumn("end", F.sum("size").over(inside)).drop("h").join(base, ["k", "cell"])
    line = line.withColumn("x1", F.col("base") + F.col("end")).withColumn("x0", F.col("x1") - F.col("size"))
    line = store(line.select("doc_id", "source", "size", "k", "x0", "x1", *quoted(list(keep))), "op6-line").join(sources, "k")
    line = taken_words(taken_words(line, "x0", "t0", seed), "x1", "t1", seed)
    words = F.when(F.col("size") > 0, F.col("t1") - F.col("t0")).otherwise(0).cast("long")
    # written, as a filter on taken that Spark moves below would repeat the steps above once for each use of each of them
    return store(line.select("doc_id", "source", "size", "source_size", "target", words.alias("taken"), *quoted(list(keep))), "op6-taken")


def op6_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce('=' || source, '') AS k,
         md5(concat_ws(':', '11', coalesce(length(doc_id::VARCHAR), -1)::VARCHAR, doc_id::VARCHAR, coalesce(length(text), -1)::VARCHAR, text)) AS h
  FROM documents),
s0 AS (SELECT k, max(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size / ((rank - 1) % 3 + 1) AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_below,
         coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weight_below FROM s2),
s4 AS (SELECT *, cap_below + ratio * (weights - weight_below) <= total AS capped FROM s3),
s5 AS (SELECT *, (sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT AS cap_used, (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::BIGINT AS weight_used FROM s4),
s6 AS (SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight * ((total - cap_used) / nullif(weights - weight_used, 0)) END AS target FROM s5),
s7 AS (SELECT *, coalesce(greatest(1, floor(least(total / 65536, (min(CASE WHEN target > 0 THEN target END) OVER ()) / 200))), 1)::BIGINT AS block FROM s6),
s8 AS (SELECT *, floor(total / block)::BIGINT AS all_seats FROM s7),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank, j) AS place, all_seats
      FROM (SELECT rank, target, all_seats, unnest(range(0, (2 * target * all_seats / greatest(total, 1))::BIGINT + 3)) AS j FROM s8 WHERE target > 0)),
w AS (SELECT rank, count(*) AS seats FROM q WHERE place <= all_seats GROUP BY rank),
s AS (SELECT s8.*, ceil(source_size / block)::BIGINT AS n, least(coalesce(seats, 0), 3 * ceil(source_size / block))::HUGEINT AS seats FROM s8 LEFT JOIN w USING (rank)),
l AS (SELECT d.*, source_size, target, block, seats, n, (sum(size) OVER (PARTITION BY k ORDER BY h ROWS UNBOUNDED PRECEDING))::BIGINT AS x1 FROM d JOIN s USING (k)),
-- every block of every source, listed: its shard, its place there, and how often it is taken
b0 AS (SELECT k, block, seats, n, unnest(range(0, n)) AS b FROM s WHERE n > 0),
b1 AS (SELECT *, b * 16 // n AS p FROM b0),
b2 AS (SELECT *, (p * n + 15) // 16 AS first, ((p + 1) * n + 15) // 16 - (p * n + 15) // 16 AS own FROM b1),
b3 AS (SELECT *, b - first AS j, (2 * seats * (first + own) + n) // (2 * n) - (2 * seats * first + n) // (2 * n) AS quota FROM b2),
b4 AS (SELECT *, quota // own AS every, quota % own AS m FROM b3),
b5 AS (SELECT *, CASE WHEN m > 0 THEN j * m // own END AS stretch FROM b4),
b6 AS (SELECT *, (stretch * own + m - 1) // m AS s0, ((stretch + 1) * own + m - 1) // m AS s1 FROM b5),
b7 AS (SELECT k, b, block, every + CASE WHEN m > 0 AND j = s0 + ('0x' || substr(md5(concat_ws(':', '11', k, p::VARCHAR, stretch::VARCHAR)), 1, 8))::BIGINT % (s1 - s0) THEN 1 ELSE 0 END AS copies FROM b6),
-- a document takes from each block that it meets
m AS (SELECT l.k, l.h, x1, sum(copies * (least(x1, (b + 1) * l.block) - greatest(x1 - size, b * l.block))) AS taken
      FROM l JOIN b7 ON b7.k = l.k AND b BETWEEN (x1 - size) // l.block AND (x1 - 1) // l.block WHERE size > 0 GROUP BY 1, 2, 3)
SELECT doc_id, l.source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM l LEFT JOIN m ON m.k = l.k AND m.h = l.h AND m.x1 = l.x1 AND size > 0
"""
