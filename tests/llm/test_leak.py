import random

import pytest

from loamsift.llm import leak
from loamsift.llm.common import words


def brute(docs, items, least=12):
    grams = {}
    for k, texts in items:
        for t in texts:
            w = words(t or "")
            for i in range(len(w) - least + 1):
                grams.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for i in range(len(w) - least + 1):
            out |= {(d, k) for k in grams.get(tuple(w[i : i + least]), ())}
    return out


def world(seed):
    rng = random.Random(seed)
    v = [f"t{i}" for i in range(40)]
    items = [(f"q{i}", [" ".join(rng.choices(v, k=rng.randint(5, 40))), " ".join(rng.choices(v, k=rng.randint(5, 60)))]) for i in range(25)]
    docs = []
    for d in range(120):
        w = rng.choices(v, k=rng.randint(0, 80))
        if rng.random() < 0.5:
            s = rng.choice(rng.choice(items)[1]).split()
            n = rng.choice([8, 11, 12, 13, 30])
            a = rng.randint(0, max(0, len(s) - n))
            w[rng.randint(0, len(w)) : 0] = s[a : a + n]
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_leaks_are_those_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_ROWS", 17)
    docs, items = world(seed)
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame([(k, *t) for k, t in items], "id string, question string, answer string").withColumnRenamed("id", "item")
    monkeypatch.setattr(leak, "PACK_WORDS", 300)
    got = {(r.id, r.item) for r in leak.leaks(d, "id", "text", i, "item", ["question", "answer"]).where("kind = 'exact'").collect()}
    assert got == brute(docs, items)


def test_near_passages_are_reported_apart(spark):
    p = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    near = p.replace("kappa ", "")
    d = spark.createDataFrame([(1, f"x {p} y"), (2, f"x {near} y"), (3, "alpha beta gamma delta epsilon zeta and nothing more of it at all here")], "id long, text string")
    i = spark.createDataFrame([("q", p)], "item string, question string")
    got = {r.id: (r.kind, r.words) for r in leak.leaks(d, "id", "text", i, "item", ["question"]).collect()}
    assert got[1] == ("exact", 14) and got[2][0] == "proximity" and 3 not in got


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    p = " ".join(f"w{i}" for i in range(15))
    long = "z " * 200000 + p
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, p, 1), (3, p, 1), (4, long, 1), (None, p, 1)], "id long, text string, words int")
    i = spark.createDataFrame([("q", p, None), ("q", p, None), (None, p, p), ("r", None, "too short")], "item string, question string, answer string")
    got = sorted((r.id, r.item, r.words) for r in leak.leaks(d, "id", "text", i, "item", ["question", "answer"]).collect())
    assert got == [(3, "q", 15), (4, "q", 15)]
    assert leak.leaks(d.limit(0), "id", "text", i, "item", ["question"]).count() == 0
    assert leak.leaks(d, "id", "text", i.limit(0), "item", ["question"]).count() == 0


def test_an_index_serves_a_second_test_set(spark):
    docs, items = world(7)
    d = spark.createDataFrame(docs, "id long, text string")
    index = leak.written(leak.build_index(d, "id", "text"))
    i = spark.createDataFrame([(k, *t) for k, t in items], "item string, question string, answer string")
    one = {tuple(r) for r in leak.leaks(d, "id", "text", i, "item", ["question", "answer"], index=index).collect()}
    assert one == {tuple(r) for r in leak.leaks(d, "id", "text", i, "item", ["question", "answer"]).collect()}
