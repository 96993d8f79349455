"""Decontamination against brute force."""

import re

import numpy as np
import pytest

from mailframe.llm import decontaminate as D


def norm(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def slow_distance(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(text, n, rng):
    t = list(text)
    for _ in range(n):
        p, what = int(rng.integers(0, len(t))), int(rng.integers(0, 3))
        if what == 0:
            t[p] = "q"
        elif what == 1:
            t.insert(p, "z")
        else:
            del t[p]
    return "".join(t)


def prose(rng, n):
    syllables = ["the", "on", "er", "th", "in", "an", "re", "ti"]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def test_finds_all_within_budget_and_nothing_else():
    rng = np.random.default_rng(4)
    items = [(i, prose(rng, int(rng.integers(6, 30)))) for i in range(25)]
    matcher = D.Matcher(D.Index.of(items))
    for trial in range(60):
        k = trial % 25
        budget = len(norm(items[k][1])) // D.PER_EDIT
        text = prose(rng, 40) + ". " + edit(items[k][1], trial % (budget + 3), rng).upper() + "\n" + prose(rng, 30)
        want = {}
        for i, t in items:
            t = norm(t)
            d = slow_distance(t, norm(text))
            if d <= min(len(t) // D.PER_EDIT, (len(t) - D.Q) // D.Q):
                want[i] = d
        got = matcher.find(text)
        assert {i: e for i, (e, _, _) in got.items()} == want


def test_span_is_of_the_text():
    item = "What is the boiling point of water at sea level, in degrees?"
    text = "é" * 50 + "!!  " + item.upper().replace(",", " --- ") + " 100."
    ((edits, a, b),) = D.Matcher(D.Index.of([(1, item)])).find(text).values()
    assert edits == 0 and norm(text[a:b]) == norm(item)


def test_alignment_against_slow_distance():
    rng = np.random.default_rng(3)
    for trial in range(40):
        item, k = prose(rng, 12)[:60], 3
        text = prose(rng, 5) + edit(item, trial % 6, rng) + prose(rng, 5)
        c, m = D.normalised(text)[0], len(item)
        low = np.arange(-m - k, len(c) + k, 2)
        edits, _ = D.banded_distances(np.repeat(D.normalised(item)[0][None, :m].astype(np.int64), len(low), axis=0), np.full(len(low), m), c, low, 4 * k + 2, k)
        assert min(int(edits.min()), k + 1) == min(slow_distance(item, norm(text) + " "), k + 1)


@pytest.mark.parametrize("gap", ["!" * 300_000, "\U0001F600" * 70_000, "、。" * 90_000])
def test_gaps_of_any_length(gap):
    item = "how many legs has a spider got and how many eyes has it got"
    matcher = D.Matcher(D.Index.of([(1, item)]))
    text = "x" * 200_000 + " " + item[:19] + gap + item[20:] + " y"
    ((edits, a, b),) = matcher.find(text).values()
    assert edits == 0 and norm(text[a:b]) == item


def test_other_scripts():
    item = "水的沸点，在海平面上是多少摄氏度？请回答问题。"
    matcher = D.Matcher(D.Index.of([(1, item), (2, "ΟΔΥΣΣΕΥΣ ΚΑΙ ΠΗΝΕΛΟΠΗ ΣΤΗΝ ΙΘΑΚΗ")]))
    assert matcher.find("前言 水的沸点、在海平面上是多少摄氏度！！请回答问题 后")[1][0] == 0 and 2 in matcher.find("… οδυσσευς και πηνελοπη στην ιθακη")


@pytest.mark.parametrize("postings", [1 << 21, 500])
def test_a_stem_that_many_items_share(monkeypatch, postings):
    import time

    monkeypatch.setattr(D, "POSTINGS", postings)
    stem = "which of the following statements about this is "
    rng = np.random.default_rng(9)
    items = [(k, stem + prose(rng, 8)) for k in range(200)]
    matcher = D.Matcher(D.Index.of(items))
    text = stem * 200 + items[7][1] + " " + stem * 3
    start = time.process_time()
    got = matcher.find(text)
    assert got[7][0] == 0 and (postings < 1000 or time.process_time() - start < 5)
    assert got == {k: v for k, v in got.items() if slow_distance(norm(items[k][1]), norm(text)) == v[0]}


@pytest.mark.parametrize("gap", ["x ", "! " * 50])
def test_long_texts_go_piece_by_piece(monkeypatch, gap):
    monkeypatch.setattr(D, "PIECE", 400)
    rng = np.random.default_rng(6)
    item = prose(rng, 20)
    matcher = D.Matcher(D.Index.of([("a", item)]))
    for before in range(0, 900, 37):
        text = prose(rng, 400)[:before] + " " + item + " " + gap * 400
        edits, a, b = matcher.find(text)["a"]
        assert edits == 0 and norm(text[a:b]) == norm(item)
    assert matcher.find(prose(rng, 2000)) == {}


def test_table(spark):
    rng = np.random.default_rng(8)
    items = [(i, prose(rng, 20)) for i in range(30)] + [(50, None), (51, ""), (52, "tiny one"), (53, " ?! ")]
    docs = [(i, prose(rng, 60), "a") for i in range(20)] + [(100 + i, f"{prose(rng, 9)} {items[i][1]} x", "b") for i in range(30)]
    docs += [(200, None, "c"), (201, "", "c"), (202, "A tiny, one.", "c"), (203, "tiny ones", "c"), (None, items[3][1], "d"), (None, items[3][1], "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, edits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = sorted([(100 + i, i) for i in range(30)] + [(202, 52), (-1, 3), (-1, 3)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect()) == want
    kept = D.remove_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(20), 200, 201, 203]
    assert D.find_leaks(df, bench.limit(0)).count() == 0 and D.remove_leaks(df.limit(0), bench).count() == 0


def test_blocks_hold_every_item(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    bench = spark.createDataFrame([(i, f"benchmark item number {i} of many") for i in range(40)], "item_id int, text string")
    found = list(D.blocks(bench))
    assert len(found) == 6 and sorted(i for x in found for i in x.ids) == list(range(40))
    docs = spark.createDataFrame([(i, f"so: Benchmark item number {i} of many.") for i in (0, 13, 39)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).filter("edits = 0").collect()} == {(0, 0), (13, 13), (39, 39)}
