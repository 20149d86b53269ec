"""The state-store poll job and the compacted tables of streaming aggregations."""

import datetime as dt
import random

import pytest

from flowtide.streaming import jobs, state

SCHEMA = "snapshot_ts timestamp, flight_key string, status string, estimated_utc timestamp, actual_utc timestamp, gate string"


def t(hour, minute=0):
    return dt.datetime(2026, 1, 1, hour, minute)


class Feed:
    """A folder in which polls land, and a job that is started anew for each: every poll is a restart."""

    def __init__(self, spark, root, **options):
        self.spark, self.path = spark, f"{root}/in"
        self.store = state.StateStorePolls(f"{root}/s", "flight_key", ("actual_utc", "estimated_utc"), ties=("gate",), **options)

    def poll(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return jobs.run(self.store.start(jobs.landed(self.spark, self.path, SCHEMA)))

    def state(self, batch=None):
        return {r.flight_key: r for r in self.store.latest(self.spark, batch).collect()}


def test_two_polls_and_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.poll([(t(1), "a", "Expected", None, None, "1"), (t(1), "a", "Expected", t(2), None, "1"), (t(1), "b", "Expected", None, None, "1")])
    feed.poll([(t(2), "a", "Expected", t(2), None, "2"), (t(2), "b", "Expected", None, None, "1"), (t(2), "c", "Arrived", None, None, "3")])
    assert {k: (r.gate, r.first_seen_ts.hour, r.last_seen_ts.hour) for k, r in feed.state().items()} == {"a": ("2", 1, 2), "b": ("1", 1, 2), "c": ("3", 2, 2)}
    assert {k: r.gate for k, r in feed.state(0).items()} == {"a": "1", "b": "1"}
    changes = feed.store.changes(spark).orderBy("changed_ts", "flight_key").collect()
    assert [(r.flight_key, r.previous_status) for r in changes] == [("a", None), ("b", None), ("a", "Expected"), ("c", None)]
    assert [(r.rows_fetched, r.rows_changed) for r in feed.store.ingest_log(spark).orderBy("batch").collect()] == [(3, 2), (3, 2)]


def test_against_a_plain_loop_over_random_polls(spark, tmp_path):
    rng, feed, known, log = random.Random(4), Feed(spark, tmp_path), {}, []
    for h in range(4):
        rows = [(t(h, rng.randrange(3)), k, rng.choice(["A", "B", None]), rng.choice([None, t(5), t(6)]), rng.choice([None, None, t(7)]), rng.choice("xyz")) for k in rng.sample("abcdefgh", 5) for _ in range(rng.randint(1, 3))]
        feed.poll(rows)
        best = {}
        rank = lambda r: (r[4] is not None, r[4] or t(0), r[3] is not None, r[3] or t(0), r[0], -ord(r[5]))
        for r in rows:
            if r[1] not in best or rank(r) > rank(best[r[1]]):
                best[r[1]] = r
        for k, r in best.items():
            old = known.get(k)
            if old is None or old[0][2:] != r[2:]:
                log.append((h, k, old and old[0][2]))
            known[k] = (r, old[1] if old else r[0])
    assert {k: (r.status, r.estimated_utc, r.actual_utc, r.gate, r.first_seen_ts) for k, r in feed.state().items()} == {k: (*r[2:], first) for k, (r, first) in known.items()}
    got = feed.store.history(spark).where("changed").select("batch", "flight_key", "previous_status").collect()
    # ties by status alone are rows of one rank
    assert sorted((r.batch, r.flight_key) for r in got) == sorted((h, k) for h, k, _ in log)


def test_a_late_poll_costs_what_it_touches(spark, tmp_path):
    """The state has many keys; each poll reads and writes the few that it shows, the last as the first."""
    feed = Feed(spark, tmp_path)
    feed.poll([(t(0), f"k{i}", "Expected", None, None, "1") for i in range(400)])
    cost = []
    for h in range(1, 4):
        query = feed.poll([(t(h), f"k{i}", "Expected", None, None, str(h)) for i in range(7)])
        cost.append([(p["stateOperators"][0]["numRowsUpdated"], p["stateOperators"][0]["numRowsTotal"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]])
    assert cost == [[(7, 400, 7)]] * 3


def test_keys_that_are_seen_no_more_leave(spark, tmp_path):
    feed = Feed(spark, tmp_path, expire_s=7200)
    for h in range(5):
        feed.poll([(t(h), "a", "x" if h < 3 else "y", None, None, "g")] + [(t(h), "b", "x", None, None, "g")] * (h < 2))
    assert set(feed.state()) == {"a"} and feed.state()["a"].first_seen_ts == t(0)
    gone = feed.store.history(spark).where("gone").collect()
    assert [(r.flight_key, r.last_seen_ts) for r in gone] == [("b", t(1))]
    feed.poll([(t(9), "b", "x", None, None, "g")])
    assert feed.state()["b"].first_seen_ts == t(9)  # it came back as a new one


@pytest.mark.parametrize("every", [1, 3, 100])
def test_compacted_table_equals_the_last_rows(spark, tmp_path, every):
    rng, want = random.Random(every), {}
    table = jobs.UpdatedTable(str(tmp_path / "t"), ("k", "j"), every)
    for batch in range(11):
        rows = {(rng.choice("abcd"), rng.choice([1, None])): rng.random() for _ in range(4)}
        want |= rows
        df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "k string, j int, v double").coalesce(1)
        table.save(df, batch)
        if batch in (4, 8):
            table.save(df, batch)  # a repeated batch
        assert {(r.k, r.j): r.v for r in table.read(spark).collect()} == want
    folders = {kind: len([p for p in (tmp_path / "t" / kind).glob("*=*")]) for kind in ("rows", "versions")}
    assert folders["versions"] <= 2 and folders["rows"] <= 2 * every if every < 100 else folders["versions"] == 0


def test_nothing_written_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.read_updated(spark, str(tmp_path / "none"), "k")
