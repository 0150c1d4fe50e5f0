"""Histories, orphans and hierarchies against plain Python."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knotwork.operators import hierarchy as H
from knotwork.operators import history as HI
from knotwork.operators import orphans as O

T = lambda day, sec=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=sec)
VERSIONS = "seq long, version_id string, id string, at timestamp_ntz, status string, residual double, id_old string"


def history_rows(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], VERSIONS)
    out = HI.history_of_versions(df, "id", "version_id", "at", "seq", {"status": F.coalesce("status", F.lit("active")), "residual": F.round("residual", 4)})
    return [(r["id"], r["version_id"], r["status"], r["residual"], r["valid_from"], r["valid_to"]) for r in out.collect()]


def test_history_periods_nulls_ties_and_repeats(spark):
    rows = [
        (1, "a", "c", T(0), None, 0.1),
        (2, "a", "c", T(0), None, 0.2),  # sent again, corrected
        (3, "b", "c", T(1), "active", 0.20001),  # changes nothing
        (4, "d", "c", T(1, 5), "archived", 0.2),
        (5, "e", "c", T(1, 5), "archived", None),  # same instant, later row
        (6, "f", "c", T(9), "archived", None),
        (7, "g", "c", None, "active", 1.0),  # no instant
        (8, "h", None, T(3), "active", 1.0),  # no key
        (9, None, "c", T(20), None, 0.2),  # no version: counts by itself
        (None, "i", "z", T(2), None, None),
    ]
    want = {("c", None, "active", 0.2, T(20), None), ("c", "a", "active", 0.2, T(0), T(1, 5)), ("c", "e", "archived", None, T(1, 5), T(20)), ("z", "i", "active", None, T(2), None)}
    got = history_rows(spark, rows)
    assert set(got) == want and len(got) == len(want)


def test_history_of_nothing(spark):
    assert history_rows(spark, []) == []


def test_history_random(spark):
    rng = random.Random(4)
    rows = [(i, f"v{rng.randrange(150)}", rng.choice("aaab"), T(rng.randrange(9), rng.randrange(3)), rng.choice(["active", "archived", None]), rng.choice([0.1, 0.2, None])) for i in range(200)]
    seen = {}
    for r in rows:
        seen[r[1]] = max(seen.get(r[1], r), r, key=lambda x: x[0])
    states = {}
    for r in sorted(seen.values()):
        states[r[2], r[3]] = r
    want, last = [], {}
    for (k, t), r in sorted(states.items()):
        now = (r[4] or "active", r[5])
        if k not in last or last[k][0] != now:
            if k in last:
                want[last[k][1]][5] = t
            want.append([k, r[1], *now, t, None])
            last[k] = (now, len(want) - 1)
    assert sorted(map(str, map(tuple, want))) == sorted(map(str, history_rows(spark, rows)))


def test_history_of_one_day_and_one_second(spark):
    """A key all of whose versions fall on one day, most of them in one second, beside one that changes back within a day."""
    at = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    rows = [(i, f"h{i}", "hot", at(i * 10 if i < 300 else i * 2_000_000), "active", float(i // 2 % 2)) for i in range(600)]
    rows += [(1000, "x", "back", T(0), "active", 1.0), (1001, "y", "back", T(1, 5), "archived", 1.0), (1002, "z", "back", T(1, 9), "active", 1.0), (1003, "w", "back", T(2), "active", 1.0)]
    got = history_rows(spark, rows)
    hot = sorted((r[4], r[1]) for r in got if r[0] == "hot")
    assert [v for _, v in hot] == [f"h{i}" for i in range(0, 600, 2)]
    assert {(r[1], r[4], r[5]) for r in got if r[0] == "back"} == {("x", T(0), T(1, 5)), ("y", T(1, 5), T(1, 9)), ("z", T(1, 9), None)}
    ends = {r[4]: r[5] for r in got if r[0] == "hot"}
    assert all(ends[a] == b for (a, _), (b, _) in zip(hot, hot[1:])) and ends[hot[-1][0]] is None


def test_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "n"), (4, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (None, "n"), (5, None)], "k int, v string")
    got = {(r["k"], r["change"]) for r in HI.diff(a, b, ["k"], ["v"]).collect()}
    assert got == {(1, "changed"), (2, "same"), (None, "same"), (4, "deleted"), (5, "inserted")}
    assert {r["change"] for r in HI.diff(a.limit(0), b, ["k"], ["v"]).collect()} == {"inserted"}


def test_snapshots(spark):
    s = lambda rows: spark.createDataFrame(rows, "k int, v string")
    out = HI.history_of_snapshots([(1, s([(1, "a"), (2, None)])), (2, s([(1, "a"), (2, "b")])), (3, s([(2, "b")])), (4, s([(1, "a"), (2, "b")]))], ["k"], ["v"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", 1, 3), (1, "a", 4, None), (2, None, 1, 2), (2, "b", 2, None)}


# orphans

REFS, PARENTS = "row_id string, field string, key string, at timestamp_ntz, period string", "field string, key string, since timestamp_ntz, alive boolean"


def orphans(spark, refs, parents):
    return {(r["row_id"], r["field"]) for r in O.orphans(spark, spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame(parents, PARENTS)).collect()}


def test_orphans_cases(spark):
    parents = [("f", "A", T(10), True), ("f", "A", T(5), True), ("f", "B", T(1), False), ("f", "C", None, True), ("g", "D", T(1), True)]
    refs = [("1", "f", "A", T(4)), ("2", "f", "A", T(5)), ("3", "f", "A", T(60)), ("4", "f", "B", T(9)), ("5", "f", "C", T(0)), ("6", "f", "D", T(9)), ("7", "g", "D", T(9)), ("8", "f", None, T(9)), ("9", "f", "A", None), ("10", "f", "Z", None), ("6", "f", "D", T(9)), ("11", "g", "D", T(0))]
    assert orphans(spark, refs, parents) == {("1", "f"), ("4", "f"), ("6", "f"), ("10", "f"), ("11", "g")}


def test_orphans_of_nothing(spark):
    assert orphans(spark, [], [("f", "A", T(1), True)]) == set()
    assert orphans(spark, [("1", "f", "A", T(1))], []) == {("1", "f")}


def test_orphans_random_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(8)
    parents = [("f", f"k{i}", T(rng.randrange(90), rng.randrange(9)), rng.random() > 0.1) for i in range(300)]
    refs = [(str(i), "f", "k1" if rng.random() < 0.3 else f"k{rng.randrange(350)}", T(rng.randrange(90), rng.randrange(9))) for i in range(3000)]
    known = {p[1]: p for p in parents}
    want = {(r[0], "f") for r in refs if r[2] not in known or not known[r[2]][3] or known[r[2]][2] > r[3]}
    monkeypatch.setattr(O, "RANGE", 64 * 512)
    assert orphans(spark, refs, parents) == want


def test_orphans_of_many_periods():
    # two bitmaps a month: held as booleans all at once they take 0.5 GB
    months = [y * 100 + m for y in range(1, 668) for m in range(1, 13)][:8000]
    rows = pd.DataFrame([(p, s, m) for i, m in enumerate(months) for s, p in (("ref", i), ("ref", i + 1), ("parent", i))], columns=["pos", "side", "period"])
    tracemalloc.start()
    out = O._survivors(("f", 3), O._build(("f", 3, 0), rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(out["key_id"] - 3 * O.RANGE, out["period"], out["kind"])) == sorted(x for i, m in enumerate(months) for x in ((i, m, "check"), (i + 1, m, "orphan")))
    assert peak < 100e6


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 512, 513, 9000, O.RANGE):
        pos = np.sort(rng.choice(O.RANGE, n, replace=False))
        assert (np.flatnonzero(O.unpack(O.pack(pos))) == pos).all()


# hierarchies


def plain_hierarchy(links):
    out = {}
    for node in links:
        path, v = [], node
        while v in links and v not in path:
            path.append(v)
            v = links[v]
        out[node] = ("", -1, []) if v in path else (path[-1], len(path) - 1, path[::-1])
    return out


def solve(spark, links, rows):
    df = spark.createDataFrame([(k, v, "x") for k, v in links.items()], "id string, parent string, depth string")
    return {r["id"]: (r["root_id"], r["depth"], r["path"]) for r in H.hierarchy(spark, df, True, rows).collect()}


@pytest.mark.parametrize("rows", [5, 40, 100_000])
def test_hierarchy_random(spark, rows):
    rng = random.Random(rows)
    links = {f"n{i:03}": None if rng.random() < 0.1 else f"n{rng.randrange(max(1, i)) if rng.random() < 0.9 else rng.randrange(130):03}" for i in range(120)}
    assert solve(spark, links, rows) == plain_hierarchy(links)


@pytest.mark.parametrize("rows", [4, 1000])
def test_hierarchy_chain_circle_self_and_absent(spark, rows):
    links = {f"c{i:02}": f"c{i - 1:02}" if i else None for i in range(40)} | {"x1": "x2", "x2": "x3", "x3": "x1", "y": "x1", "s": "s", "o": "gone", "p": "o"}
    assert solve(spark, links, rows) == plain_hierarchy(links)


def test_hierarchy_of_scattered_ids_stays_in_the_recursion(spark):
    """A long chain and bushes whose ids say nothing about their place: quotients shrink until one partition holds them."""
    rng = random.Random(8)
    ids = [f"{rng.getrandbits(64):016x}" for _ in range(400)]
    links = [(ids[i], ids[i - 1] if i and i < 250 else ids[rng.randrange(i)] if i else None) for i in range(400)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1")]
    links = dict(links)
    assert solve(spark, links, 40) == plain_hierarchy(links)


def test_hierarchy_hot_parent_and_nothing(spark):
    links = {"r": None} | {f"k{i:03}": "r" for i in range(200)}
    got = solve(spark, links, 30)
    assert got == plain_hierarchy(links)
    assert solve(spark, {}, 30) == {}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    solved = H.hierarchy(spark, df, True)
    assert {tuple(r) for r in H.descendants(solved).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {(r["id"], r["n_descendants"]) for r in H.described(solved).collect()} == {("a", 3), ("b", 1), ("c", 0), ("d", 0)}
