import random

import pytest

from loamsift.llm.common import WordHash, set_prints, shingle_sets, words
from loamsift.llm.neardup import fano_masks, near_duplicate_groups, near_duplicate_pairs


def shingles(t):
    w = words(t or "")
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, threshold=0.6):
    s = {k: shingles(t) for k, t in rows if k is not None}
    out = set()
    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold:
                out.add((a, b))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = list(rng.choice(rows)[1].split())
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        rows.append((f"c{i:03d}", " ".join(w)))
    return rows


def test_masks_cover_any_two_of_seven():
    for i in range(7):
        for j in range(7):
            assert any(i not in m and j not in m for m in fano_masks())
    assert all(len(m) == 3 for m in fano_masks()) and len(fano_masks()) == 7


def test_shingle_sets_are_those_of_the_words():
    texts = ["A b_c d! e", None, "", "x y", "one two three", "one two three one two three", "Ünïcode ２ Wörter x"]
    sets, starts = shingle_sets(texts, WordHash())
    assert [int(b - a) for a, b in zip(starts, starts[1:])] == [len(shingles(t)) for t in texts]
    again, at = shingle_sets(["one two three one two three", "one two three"], WordHash())
    assert set(again[at[1] :].tolist()) <= set(again[: at[1]].tolist())
    p = set_prints(*shingle_sets(["a b c d", "a  B c D", "d c b a"], WordHash()))
    assert p[0] == p[1] != p[2]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "id string, content string")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "content").collect()}
    assert got == brute(rows)


def test_nulls_repeats_short_and_long_texts_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [("a", "one two three four", 1), ("b", "One two, three FOUR", 2), ("b", "One two, three FOUR", 2), ("c", None, 3), ("d", "", 4), ("e", "one two", 5), ("f", "one two", 6), ("g", long, 7), ("h", long + " more", 8), (None, "one two three four", 9)]
    df = spark.createDataFrame(rows, "id string, content string, cls int").withColumn("n", df_one())
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "content").collect()}
    assert got == {("a", "b"), ("g", "h")}
    assert near_duplicate_pairs(df.limit(0), "id", "content").count() == 0


def df_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_large_groups_of_copies_keep_every_link(spark):
    rows = [(f"x{i:02d}", "alpha beta gamma delta epsilon zeta eta theta") for i in range(12)] + [("y", "alpha beta gamma delta epsilon zeta eta theta iota"), ("z", "alpha beta gamma delta epsilon zeta eta theta iota")]
    df = spark.createDataFrame(rows, "id string, content string")
    whole = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "content").collect()}
    assert whole == brute(rows)
    g = {r.id: (r.class_id, r.copies, r.links) for r in near_duplicate_groups(df, "id", "content").collect()}
    assert g["x07"] == ("x00", 12, 1) and g["z"] == ("y", 2, 1)


def variants(n):
    """Texts of one shingle set of which no two are equal to the byte."""
    return ["alpha beta gamma delta epsilon zeta eta theta" + "!" * i for i in range(n)]


def test_classes_above_64_members_stand_with_all_their_pairs(spark):
    rows = [(f"x{i:02d}", t) for i, t in enumerate(variants(70))] + [(f"e{i:02d}", "one two three four five") for i in range(66)] + [("y", "alpha beta gamma delta epsilon zeta eta theta iota")]
    df = spark.createDataFrame(rows, "id string, content string")
    got = [(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", "content").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
