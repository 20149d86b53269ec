"""URL filters by a sort-merge range join on reversed-host keys.

A host becomes its labels in reverse, each ended by a dot (``blog.example.org`` -> ``org.example.blog.``), so that a domain and all
its subdomains are one interval of keys: ``org.`` to ``org/``. Such intervals are disjoint or nested. Hosts and rules are swept in
sorted order; a stack holds the rule hosts whose interval is open. The paths of one rule host are intervals of the same kind (a prefix and
all that begins with it): they are sorted too, and each knows the path that encloses it, so the stack of paths that are open at a url's path is
found by one binary search and the way outwards, however many rules a host has. The longest rule over all open hosts wins.

With rules of up to MAX_RULE_BYTES the pages are not shuffled: the rules go to the tasks, and each Arrow batch is sorted by itself, so a hot host costs
nothing. Beyond, no rule goes to the driver: the distinct hosts and the rule hosts are one line of keys, cut into ranges, which tasks sweep in order; a range begins
with the rule hosts that are open at its edge, which are the prefixes of its first key. Then the distinct (rule host, path) and the rules' paths are swept the same
way, a path prefix being an interval as well, and pages meet the longest rule of their host and path.

Cases: a rule without host or path fits nothing; a null url or one without ``://`` has empty host and path, fits no rule, and gets the default verdict; of equally long
rules ``block`` wins over ``allow``, then the one last by code point; a null id is a value like others; a very
long url is read whole; repeated rows are judged alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

MAX_RULE_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split(".")))


def active_rules(keys: list[str], rules: list[tuple[str, list]]) -> Iterator[tuple[str, list]]:
    """keys: sorted; rules: sorted (key, what is at that key). Yields each key with what is at all keys that are prefixes of it."""
    stack: list[tuple[str, list]] = []
    at = 0
    for key in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and stack[-1][0][:-1] + "/" <= rules[at][0]:
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and stack[-1][0][:-1] + "/" <= key:
            stack.pop()
        yield key, [x for _, own in stack for x in own]


class Paths:
    """The path prefixes of one rule host, sorted, each with the index of the longest other that it begins with (-1: none)."""

    def __init__(self, rules: list[tuple[str, tuple]]):
        self.paths, self.found, self.outer = [], [], []
        open_: list[int] = []
        for path, found in sorted(rules):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            if open_ and self.paths[open_[-1]] == path:
                self.found[open_[-1]] = max(self.found[open_[-1]], found)
                continue
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(len(self.paths))
            self.paths.append(path)
            self.found.append(found)

    def longest(self, path: str) -> tuple | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.found[at] if at >= 0 else None


def _swept(rules: list[tuple[str, str, str]]):
    by_key: dict[str, list] = {}
    for host, path, verdict in rules:
        by_key.setdefault(host_key(host), []).append((path, (len(host) + len(path), verdict == "block", host + path, verdict)))
    ordered = [(key, [Paths(own)]) for key, own in sorted(by_key.items())]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            key_of = {h: host_key(h) for h in set(hosts)}
            fits = dict(active_rules(sorted(set(key_of.values())), ordered))
            found = [max(filter(None, [own.longest(p) for own in fits[key_of[h]]]), default=None) for h, p in zip(hosts, paths)]
            new = [pa.array([f[k] if f else None for f in found], pa.string()) for k in (2, 3)]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "rule", "verdict"])

    return sweep


def _nested(all_open: bool):
    """Rows by (part, key, kind), rules (kind 0) before points (1) of a key -> (key, rule): the rules whose key is a prefix of the point's, or the longest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            found: list[tuple[str, str]] = []
            for part, key, kind in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind"))):
                if part != at:
                    at, stack = part, []
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1] != key:
                        stack.append(key)
                else:
                    found += [(key, rule) for rule in (stack if all_open else stack[-1:])]
            keys, rules = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(rules, pa.string())], names=["key", "rule"])

    return run


def prefixes(points: DataFrame, rules: DataFrame, all_open: bool) -> DataFrame:
    """(key, rule): for each distinct key of points the keys of rules that it begins with, all of them or the longest, by a sweep over ranges of keys."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = rules.select("key", F.lit(0).alias("kind")).distinct().unionByName(points.select("key", F.lit(1).alias("kind")).distinct())
    line = store(line.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id()), "op5-line")
    edges = line.groupBy("part").agg(F.min("key").alias("edge"))  # a row for each range
    begun = edges.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("edge"), F.lit(1))), lambda k: F.substring("edge", F.lit(1), k))).alias("key"))
    carried = begun.join(line.where("kind = 0").select("key"), "key", "left_semi").select("key", F.lit(0).alias("kind"), "part")
    swept = line.unionByName(carried).repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    return swept.mapInArrow(_nested(all_open), "key string, rule string")


def judged_by_ranges(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each distinct host and path that a rule fits; rules of any number."""
    host = lambda c: F.concat(F.array_join(F.reverse(F.split(c, r"\.")), "."), F.lit("."))  # noqa: E731  as host_key()
    of = lambda h, p: F.concat(h, F.lit("\0"), p)
    u = store(urls.select("host", "path", host("host").alias("key")).distinct(), "op5-urls")
    r = store(rules.select("host", "path", "verdict", host("host").alias("key")), "op5-rules")
    open_ = prefixes(u, r, True)
    met = u.join(open_, "key").select("host", "path", of(F.col("rule"), F.col("path")).alias("key"))
    longest = prefixes(met, r.select(of(F.col("key"), F.col("path")).alias("key")), False)
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict")
    best = r.select(of(F.col("key"), F.col("path")).alias("rule"), rank.alias("r")).groupBy("rule").agg(F.max("r").alias("r"))
    return met.join(longest, "key").join(best, "rule").groupBy("host", "path").agg(F.max("r").alias("r")).select("host", "path", "r.rule", "r.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page; rules: (host, path, verdict)."""
    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    if size > MAX_RULE_BYTES:
        out = out.join(judged_by_ranges(out, rules), ["host", "path"], "left").select("page_id", "host", "path", "rule", "verdict")
    else:
        out = out.mapInArrow(_swept([tuple(r) for r in rules.collect()]), f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
