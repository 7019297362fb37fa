import random
import re

import numpy as np
import pytest

from loamsift.llm.split import analyse, pieces, split_texts, valley_depths

CONFIG = "config_id int, chunk_size int, chunk_overlap int, min_chunk_chars int"


def cut(text, size, overlap, least=0):
    begins, cuts, scores, blanks = analyse([text])
    return pieces(len(text), cuts.tolist(), scores.tolist(), blanks, size, overlap, least)


def check(text, size, overlap, least=0):
    x, y, forced = cut(text, size, overlap, least)
    assert x[0] == 0 and y[-1] == len(text)
    assert all(0 < b - a <= size for a, b in zip(x, y))
    for k in range(len(x) - 1):
        assert y[k] > (y[k - 1] if k else 0)
        assert y[k] - overlap <= x[k + 1] <= y[k] or x[k + 1] == x[k] + 1
        natural = text[y[k] - 1] in " \t\r\n" or text[y[k]] in " \t\r\n"
        assert natural or forced
    assert forced == any(len(r) > size for r in re.split(r"[ \t\r\n]", text))


def test_pieces_of_random_texts_cover_them_and_cut_at_blanks():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "a. ", "Satz! ", "\n\n", "\r\n", "   ", "x" * rng.randint(1, 90), "é", "\t"]) for _ in range(rng.randint(30, 120)))
        size = rng.choice([20, 50, 100])
        if len(text) > size:
            check(text, size, rng.choice([0, size // 10, size // 2, size * 6 // 10]), rng.choice([0, 5]))


def test_a_word_that_fits_is_never_cut_even_beyond_the_overlap():
    text = "aa " + "b" * 95 + " " + "c" * 99 + " dd"
    x, y, forced = cut(text, 100, 60)
    assert not forced
    assert all(text[b - 1] == " " or text[b : b + 1] in ("", " ") for b in y)


def test_the_deepest_valley_is_chosen():
    a = "Rivers carry water through valleys. Water fills rivers after rain. Valleys hold rivers and water. "
    b = "Violins need strings and bows. Strings sound when bows touch violins. Bows and strings wear down. "
    x, y, _ = cut(a * 2 + b * 2, len(a) * 2 + 60, 0)
    assert y[0] == len(a) * 2


def test_depths_equal_a_count_by_hand():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 12, 80)
    doc = np.repeat([0, 1], 40)
    depth, pos = valley_depths((words + 100 * doc).astype(np.uint64), doc, 5)
    at = {int(p): (int(d), int(w)) for p, d, w in zip(pos, doc, words)}
    sim = np.zeros(len(depth))
    for p in range(len(depth)):
        left = {at[q] for q in range(p - 5, p) if q in at}
        right = {at[q] for q in range(p, p + 5) if q in at}
        sim[p] = len(left & right) / max(1, len(left) * len(right)) ** 0.5
    want = np.array([max(sim[max(0, p - 4) : p + 1]) + max(sim[p : p + 5]) - 2 * sim[p] for p in range(len(sim))])
    assert np.allclose(depth, want, atol=1e-6)


def test_rows_nulls_repeats_and_empty_tables(spark):
    long = "one two three. " * 50
    df = spark.createDataFrame([("a", long, 1), ("a", long, 2), ("b", None, 3), ("c", "", 4), ("d", "short", 5), ("e", "z" * 300, 6), (None, long, 7)], "doc_id string, text string, config_id int")
    cf = spark.createDataFrame([(1, 100, 10, None), (2, 1000, 0, 5), (3, None, 1, 1), (4, 0, 1, 1)], CONFIG)
    got = split_texts(df, "doc_id", "text", cf, True).collect()
    assert sorted((r.doc_id or "", r.config_id, r.forced) for r in got) == [("", 1, 0), ("a", 1, 0), ("a", 1, 0), ("e", 1, 1)]
    for r in got:
        assert all(t == (long if r.doc_id != "e" else "z" * 300)[p:q] for t, p, q in zip(r.texts, r.starts, r.ends))
    assert split_texts(df.limit(0), "doc_id", "text", cf).count() == 0
    assert split_texts(df, "doc_id", "text", cf.limit(0)).count() == 0


def test_an_overlap_not_below_the_size_is_refused(spark):
    df = spark.createDataFrame([("a", "x y")], "k string, t string")
    with pytest.raises(ValueError):
        split_texts(df, "k", "t", spark.createDataFrame([(1, 5, 5, 0)], CONFIG))


def test_any_number_of_configurations(spark, monkeypatch):
    from loamsift.llm import split

    text = "Some words of a text that is longer than all the sizes. " * 8
    df = spark.createDataFrame([("a", text)], "id string, text string")
    configs = spark.createDataFrame([(k, 40 + k, 5, 0) for k in range(5)], "config_id int, chunk_size int, chunk_overlap int, min_chunk_chars int")
    whole = sorted(map(tuple, split.split_texts(df, "id", "text", configs).collect()))
    monkeypatch.setattr(split, "CONFIG_PACK", 2)
    assert sorted(map(tuple, split.split_texts(df, "id", "text", configs).collect())) == whole and len(whole) == 5
