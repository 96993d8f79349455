"""Mixing against a plain sequential version."""

import math

import pytest

from mailframe.llm import mixing as M


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


ROWS = [(i, " ".join(["w"] * (i % 17 + 1)), ["a", "b", None, "é", "Z"][i % 5] if i % 3 else "hot") for i in range(400)]


def mixed(spark, rows):
    return [r.asDict() for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()]


def test_targets_and_taken(spark):
    rows = mixed(spark, ROWS)
    assert len(rows) == 400
    sizes = {}
    for i, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = slow_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(want[source])
        assert sum(r["taken"] for r in own) == round(want[source])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        epochs, rest = divmod(round(want[source]), size)
        for r in sorted(own, key=lambda r: r["key"]):  # complete epochs, then a prefix by key
            part = max(0, min(r["size"], rest))
            rest -= part
            assert r["taken"] == epochs * r["size"] + part
    assert sorted(map(str, mixed(spark, ROWS))) == sorted(map(str, rows))


def test_keys_prefer_quality(spark):
    good = [(i, "plain words here and there", "s") for i in range(300)]
    bad = [(1000 + i, "#$% &*| ### $$$ %%%", "s") for i in range(300)]
    rows = mixed(spark, good + bad + [(5000, "x " * 9000, "big"), (5001, "y", "tiny")])
    mean = lambda ids: sum(r["key"] for r in rows if r["doc_id"] in ids) / len(ids)
    assert mean(range(300)) < 0.3 * mean(range(1000, 1300))


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixed(spark, [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "one two", "b"), (None, "one two", "b")])
    assert [r["size"] for r in sorted(rows, key=lambda r: r["doc_id"] or 9)] == [0, 0, 0, 2, 2]
    assert sum(r["taken"] for r in rows) == 6 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(math.isfinite(r["target"]) for r in rows)


def test_all_full_or_all_empty_sources(spark):
    rows = mixed(spark, [(i, None, s) for i, s in enumerate("abc")])
    assert {r["target"] for r in rows} == {0.0} and {r["taken"] for r in rows} == {0}


def test_words(spark):
    df = spark.createDataFrame([("a b c",), ("\x1c\t\x0b x",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(M.words_in(df.text)).collect()] == [2, 2, 0, 0]


@pytest.mark.parametrize("weight", [0.1, 0.2, 0.35, 0.6, 1.0])
def test_ranges_are_even(spark, weight):
    from pyspark.sql import functions as F

    keys = spark.range(200_000).select((-F.log((F.col("id") + 0.5) / 200_000.0) / F.lit(weight)).alias("key"))
    most = keys.groupBy(F.floor(M.place(F.col("key")) * 64).alias("range")).count().agg(F.max("count")).first()[0]
    assert most <= 2.3 * 200_000 / 64


def test_clashing_columns(spark):
    rows = [(i, f"some words {i}", "s", i, 1.0, 2, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key double, rest int, target string")
    out = M.mix(df).collect()
    assert len(out) == 20 and sum(r.taken for r in out) == 90 and out[0].source_size == 60
