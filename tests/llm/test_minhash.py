"""MinHash fingerprints against plain versions."""

import hashlib
from functools import reduce

import numpy as np
import pytest

from mailframe.llm import minhash as M


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def words(seed, n, vocabulary=2000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def hashed(raw):
    return np.concatenate([np.zeros(0, np.uint64), *M.word_hashes(raw)])


def test_hashes_are_of_words_not_places():
    a, b = hashed(b"one two  three one"), hashed(b"\tthree one two")
    assert a[0] == a[3] == b[1] and a[1] == b[2] and a[2] == b[0] and len(set(a)) == 3
    assert len({int(x) for i in range(2000) for x in hashed(f"w{i}".encode())}) == 2000


def test_distinct_shingles_get_distinct_hashes(monkeypatch):
    text = " ".join(words(1, 3000, 20))
    whole = np.concatenate(list(M.shingle_hashes(text)))
    assert len(set(whole.tolist())) == len(shingles(text))
    for step in (1, 2, 7, 101):
        monkeypatch.setattr(M, "STEP", step)
        assert (np.concatenate(list(M.shingle_hashes(text))) == whole).all()


def test_words_longer_than_a_step():
    word = "ab" * M.STEP
    a, b = hashed(f"{word} x {word}".encode()), hashed(f" {word}\n{word}b x".encode())
    assert len(a) == len(b) == 3 and a[0] == a[2] == b[0] and b[1] not in a and a[1] == b[2]
    assert len(hashed(word.encode())) == 1 and len(hashed(word.encode()[: M.STEP] + b" ")) == 1


@pytest.mark.parametrize("changed", [0, 3, 20, 80, 400])
def test_likeness_estimates_jaccard(changed):
    a = words(2, 400)
    b = a.copy()
    for i in np.random.default_rng(3).choice(400, changed, replace=False):
        b[i] = "x"
    a, b = " ".join(a), " ".join(b)
    assert M.likeness(M.signature(a), M.signature(b)) == pytest.approx(jaccard(a, b), abs=0.14)


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_likeness_of_long_texts(n):
    a, b = words(4, n, 1 << 40), words(5, n, 1 << 40)
    half = a[: n // 2] + b[n // 2 :]
    a, b, half = (M.signature(" ".join(t)) for t in (a, b, half))
    assert M.likeness(a, b) <= 0.03
    assert M.likeness(a, half) == pytest.approx(1 / 3, abs=0.14)


def test_signature_edges():
    assert (M.signature(None) == 65535).all() and (M.signature(" \n") == 65535).all()
    assert (M.signature("A b") == M.signature("a\tB")).all() and (M.signature("a b") != M.signature("b a")).any()


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_chain(spark, n):
    rows = [(3 * i - 50, " ".join(words(i, i % 40))) if i % 9 else (3 * i - 50, None) for i in range(n)]
    got = M.fingerprint_chain(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, home string, n_chars int").repartition(3)).collect()
    assert len(got) == n
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % n][1]
        half = len(t) // 2
        want[i] = (len(t), t[: len(t) - half] + after[:half], after)
    for r in got:
        length, new, after = want[r.doc_id]
        text = dict(order)[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (length, hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == M.signature(text).tobytes().hex() and r.edited_fingerprint == M.signature(new).tobytes().hex()
        assert r.near_edited == M.likeness(M.signature(text), M.signature(new)) and r.near_next == M.likeness(M.signature(text), M.signature(after))


def test_chain_with_null_and_repeated_ids(spark):
    rows = [(None, "n"), (5, "b é"), (5, "a"), (7, "z"), (None, "m")]
    got = M.fingerprint_chain(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = ["z", "a", "b é", "m", "n"]
    want = sorted(hashlib.sha256(M.edited(t, order[(k + 1) % 5]).encode()).hexdigest() for k, t in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 3)
    rows = []
    for g in range(6):
        base = words(100 + g, 300)
        for k in range(8):
            t = base.copy()
            for x in range(k % 4):
                t[70 * x + 5] = f"new{k}"
            rows.append((10 * g + k, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "short text"), (903, "Short  text")]
    sets = dict(rows)
    links = {i: {j for j in sets if jaccard(sets[i], sets[j]) >= 0.8} for i in sets}

    def reach(i):
        out = {i}
        while (more := reduce(set.union, (links[x] for x in out))) - out:
            out |= more
        return min(out)

    got = {r.doc_id: r.component_id for r in M.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: reach(i) for i in sets}
    assert M.minhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
