import os

import numpy as np
import pytest

from loamsift.llm import runs
from loamsift.llm.history import BASE, DEPTH, RECALL, TREES, Forest, decide, least_similarity, match_batch, permutations, recall_at, widened
from loamsift.llm.runs import SortedTable

from .test_neardup import corpus, shingles, variants


def alike(a, b, threshold=0.6):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and len(x & y) / len(x | y) >= threshold


def brute(history, incoming):
    accepted = dict(history)
    seen = {k for k, _ in history}
    status, pairs = {}, set()
    for seq, key, text in sorted(incoming):
        if key is None or key in seen:
            status[seq] = "skipped"
            continue
        seen.add(key)
        hits = [k for k, t in accepted.items() if alike(text, t)]
        pairs |= {(key, k) for k in hits}
        status[seq] = "duplicate" if hits else "accepted"
        if not hits:
            accepted[key] = text
    return status, pairs


def forest_of(spark, history, path=None):
    f = Forest(spark, path)
    f.append(spark.createDataFrame(history, "id string, content string"), "id", "content")
    return f


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, content string")


@pytest.mark.parametrize("seed", [4, 5])
def test_decisions_and_matches_are_those_of_one_by_one(spark, seed):
    rows = corpus(seed, 140)
    history = rows[:50]
    incoming = [(i, k, t) for i, (k, t) in enumerate(rows[50:])]
    incoming += [(200, "c060", "sent again"), (201, history[0][0], "known key"), (202, "n1", None), (203, "n2", "two words"), (204, None, "no key at all here"), (202, "n1", None)]
    d, m = match_batch(forest_of(spark, history + history[:3]), batch_of(spark, incoming).repartition(3), "id", "content", "seq")
    status, pairs = brute(history, incoming[:-1])
    got = sorted((r.seq, r.status) for r in d.collect())
    assert got == sorted([*status.items(), (202, "skipped")])
    assert {(r.new, r.old) for r in m.collect()} == pairs


def test_batches_in_several_sessions_give_what_one_gives(spark, tmp_path):
    rows = corpus(6, 160)
    incoming = [(i, k, t) for i, (k, t) in enumerate(rows[60:])] + [(300, "c100", "sent again in a later batch")]
    path = str(tmp_path / "forest")
    forest_of(spark, rows[:60], path)
    status, pairs = {}, set()
    for part in (incoming[:40], incoming[40:41], incoming[41:]):
        opened = Forest.open(spark.newSession(), path)
        d, m = match_batch(opened, opened.spark.createDataFrame(part, "seq long, id string, content string"), "id", "content", "seq")
        status |= {r.seq: r.status for r in d.collect()}
        pairs |= {(r.new, r.old) for r in m.collect()}
    assert (status, pairs) == brute(rows[:60], incoming)
    f = Forest.open(spark, path)
    assert f.sets.rows == len({frozenset(shingles(t)) for k, t in rows[:60]} | {frozenset(shingles(t)) for s, k, t in incoming if status[s] == "accepted" and shingles(t)})
    f.merge_runs(whole=True)
    assert len(f.labels.runs) == 1 and f.labels.rows == f.sets.rows * TREES


def test_empty_history_and_empty_batch(spark):
    rows = [(1, "a", "one two three four"), (2, "b", "one two three four")]
    f = Forest(spark)
    d, m = match_batch(f, batch_of(spark, rows), "id", "content", "seq")
    assert {r.seq: r.status for r in d.collect()} == {1: "accepted", 2: "duplicate"}
    assert [(r.new, r.old) for r in m.collect()] == [("b", "a")]
    before = f.keys.rows
    d, m = match_batch(f, batch_of(spark, []), "id", "content", "seq")
    assert d.count() == 0 and m.count() == 0 and f.keys.rows == before


def test_extra_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    f = forest_of(spark, [("h", "one two three four")])
    b = batch_of(spark, [(1, "a", "one two three four")]).withColumns({c: F.lit(1) for c in ("k", "cls", "key", "ord", "n", "status")})
    d, m = match_batch(f, b, "id", "content", "seq")
    assert [(r.seq, r.id, r.status) for r in d.collect()] == [(1, "a", "duplicate")] and [(r.new, r.old) for r in m.collect()] == [("a", "h")]


def test_prefixes_are_widened_until_each_record_has_its_recall():
    n = np.array([1, 2, 5, 40, 1000])
    d = widened(n, 0.6, TREES, RECALL)
    s = least_similarity(n, 0.6)
    assert s[0] == 1.0 and s[1] == pytest.approx(2 / 3) and s[-1] == 0.6
    assert (recall_at(d, s, TREES) >= RECALL).all() and d[0] == DEPTH > d[-1] == BASE
    longer = d < DEPTH
    assert (recall_at(d[longer] + 1, s[longer], TREES) < RECALL).all()


def test_trees_share_no_value_of_their_first():
    p = permutations()
    assert len(set(p[:, :BASE].reshape(-1).tolist())) == TREES * BASE and all(len(set(r)) == DEPTH for r in p.tolist())


def table_of(spark, path, rows, parts):
    t = SortedTable(spark, path, "k long, v string")
    df = spark.createDataFrame(rows, "k long, v string").repartitionByRange(parts, "k")
    t.append(df)
    return t


def test_a_range_search_opens_only_the_files_it_needs(spark, tmp_path):
    rows = [(i // 2, f"v{i}") for i in range(2000)]
    t = table_of(spark, str(tmp_path), rows, 10)
    asked = spark.createDataFrame([(300, 302, "x"), (305, 305, "y"), (5000, 6000, "z")], "lo long, hi long, name string")
    want = sorted((n, f"v{2 * k + j}") for k, n in ((300, "x"), (301, "x"), (302, "x"), (305, "y")) for j in (0, 1))
    needed = [f for f, lo, hi in t.manifests[0]["files"] if lo <= 305 and hi >= 300]
    assert len(needed) < 3
    for f, _, _ in t.manifests[0]["files"]:
        if f not in needed:
            os.remove(tmp_path / "run-0" / f)
    assert sorted((r.name, r.v) for r in t.lookup(asked, ["v"]).collect()) == want


def test_runs_without_a_manifest_are_not_there_and_merged_ones_are_one(spark, tmp_path):
    t = table_of(spark, str(tmp_path), [(i, "a") for i in range(50)], 3)
    t.append(spark.createDataFrame([(i, "a") for i in range(40, 60)], "k long, v string").coalesce(1))
    t.append(spark.createDataFrame([(7, "b")], "k long, v string").coalesce(1))
    os.makedirs(tmp_path / "run-9")
    again = SortedTable(spark, str(tmp_path), "k long, v string")
    assert again.runs == [0, 1, 2] and again.rows == 71 and again.stale() == []
    again.merge(again.runs, ["k", "v"])
    assert len(again.runs) == 1 and again.rows == 61
    again.vacuum()
    asked = spark.createDataFrame([(7, 7)], "lo long, hi long")
    assert sorted(r.v for r in SortedTable(spark, str(tmp_path), "k long, v string").lookup(asked, ["v"]).collect()) == ["a", "b"]


def test_many_files_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(runs, "TASK_ROWS", 500)
    history = [(f"h{i:03d}", f"alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu word{i}") for i in range(60)] + corpus(8, 60)
    incoming = [(1, "n", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "m", history[70][1])]
    f = forest_of(spark, history)
    assert len(f.labels.manifests[0]["files"]) > 1
    d, m = match_batch(f, batch_of(spark, incoming), "id", "content", "seq")
    assert {(r.new, r.old) for r in m.collect()} == brute(history, incoming)[1]


def test_long_chains_are_decided_in_order(spark):
    n = 7
    nodes = spark.createDataFrame([(i, i, False) for i in range(n)], "cls long, ord long, lost boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "early long, late long")
    assert {r.cls: r.accepted for r in decide(nodes, edges).collect()} == {i: i % 2 == 0 for i in range(n)}


def test_every_copy_in_the_history_is_matched(spark):
    history = [(f"h{i:02d}", t) for i, t in enumerate(variants(70))]
    incoming = [(1, "n", "alpha beta gamma delta epsilon zeta eta theta iota")]
    d, m = match_batch(forest_of(spark, history), batch_of(spark, incoming), "id", "content", "seq")
    assert {(r.new, r.old) for r in m.collect()} == brute(history, incoming)[1] and m.count() == 70


@pytest.mark.parametrize("gather", [0, 3, 100_000])
def test_rounds_and_what_is_settled_at_once_agree(spark, gather):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (1, 4), (6, 7), (7, 8), (2, 8)]
    nodes = spark.createDataFrame([(i, i, i == 6) for i in range(10)], "cls long, ord long, lost boolean")
    accepted = {}
    for i in range(10):
        accepted[i] = i != 6 and not any(accepted[a] for a, b in edges if b == i)
    assert {r.cls: r.accepted for r in decide(nodes, spark.createDataFrame(edges, "early long, late long"), gather=gather).collect()} == accepted


def test_chains_longer_than_a_hundred_are_decided(spark):
    n = 300
    nodes = spark.createDataFrame([(i, i, False) for i in range(n)], "cls long, ord long, lost boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "early long, late long")
    assert {r.cls: r.accepted for r in decide(nodes, edges).collect()} == {i: i % 2 == 0 for i in range(n)}
