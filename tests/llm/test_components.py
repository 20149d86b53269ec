"""Components of links: equal to a search, and links are joined a bounded number of times, however long their paths."""

import random

from flowtide.llm import neardup


def components_of(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for k in sorted(near):
        todo = [] if k in out else [k]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = k
                todo += near[x]
    return out


def test_components_of_stars_paths_and_random_links(spark, monkeypatch):
    rng, links = random.Random(3), []
    links += [(1_000 + i, 1_001 + i) for i in range(400)]  # a path in order
    ids = rng.sample(range(2_000, 3_000), 400)
    links += list(zip(ids, ids[1:]))  # a path in no order
    links += [(3_500, 3_000 + i) for i in range(1_000) if i != 500]  # a star with a middling hub, most of whose leaves are heads of the first round
    links += [(rng.randrange(5_000, 5_400), rng.randrange(5_000, 5_400)) for _ in range(300)]
    links = [(a, b) for a, b in links if a != b]
    rows, held = [], neardup.store

    def store(df, name):
        out = held(df, name)
        if name.endswith("-edges"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(neardup, "store", store)
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components_of(links)
    # each round joins the links that are left
    assert len(rows) > 2 and rows[-1] == 0 and sum(rows) <= 1.6 * len({(min(x), max(x)) for x in links})


def test_components_of_no_links(spark):
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
