"""SimHash against brute force."""

import numpy as np
import pytest
import xxhash

from mailframe.llm import simhash as S


def slow_fingerprint(text, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(items, radius):
    """items: (doc_id, int)."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in items:
        for b, y in items:
            if bin(x ^ y).count("1") <= radius:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: find(i) for i, _ in items}


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "one TWO", "Ä b c", "a b c d e f a b c d", "a b c d\x0be", "wort " * 50):
        assert S.fingerprint(text).hex() == f"{slow_fingerprint(text):016x}"


def test_long_text_goes_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 300, 3000))
    monkeypatch.setattr(S, "PIECE", 97)
    assert S.fingerprint(text).hex() == f"{slow_fingerprint(text):016x}"


@pytest.mark.parametrize(("bits", "radius"), [(64, 2), (128, 22), (64, 0), (64, 64)])
def test_within_counts_every_lane(bits, radius):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (200, bits // 8), dtype=np.uint8)
    b = a.copy()
    for i in range(200):
        for p in rng.choice(bits, i % (bits + 1) if i < 2 * bits else 2, replace=False):
            b[i, p // 8] ^= 1 << (p % 8)
    valid = np.full(4, ~np.uint64(0))
    hit = S.within(S.planes_of(a), S.planes_of(b), valid, radius)
    got = np.unpackbits(hit.view(np.uint8), bitorder="little")[:200]
    assert (got == (np.unpackbits(a ^ b, axis=1).sum(axis=1) <= radius)).all()


def test_forest_compares_all_pairs_of_a_group():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    values = [int(base[i % 40]) ^ (1 << int(rng.integers(0, 64))) for i in range(300)]
    fps = np.array([list(v.to_bytes(8, "big")) for v in values], np.uint8)
    group = np.sort(rng.integers(0, 9, 300))
    i, r = S.forest(fps, group, 2)
    root = np.arange(300)
    root[i] = r
    for g in range(9):
        lanes = np.flatnonzero(group == g)
        want = slow_components([(int(x), values[x]) for x in lanes], 2)
        assert {int(x): int(root[x]) for x in lanes} == want


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 4)  # so that buckets are dealt out in pairs of chunks
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "x")]
    for i in range(120):
        t = texts[i % 12].split()
        if i % 5:
            t[int(rng.integers(0, 400))] = "new"
        rows.append((100 + i, " ".join(t)))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int").repartition(5)
    got = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in S.simhash_groups(df).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    want = slow_components(prints, 2)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints}
    assert len(set(want.values())) < 120


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_chain_of_links_is_one_component(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    from mailframe.llm.common import Scratch

    edges = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)] + [(b"900", b"901")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in S.components(edges, Scratch(spark)).collect()}
    assert got == {f"{i:03d}".encode(): b"000" for i in range(1, 61)} | {b"901": b"900"}


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert S.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    assert S.near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = S.simhash_groups(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d")], schema)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows) == [(False, 5), (False, 5), (True, 5)]


def test_near_dedup_keeps_one_of_a_group(spark):
    rng = np.random.default_rng(2)
    long = [f"w{x}" for x in rng.integers(0, 5000, 600)]
    near = long.copy()
    near[300] = "other"
    rows = [(7, " ".join(long), "a"), (3, " ".join(near), "b"), (9, " ".join(long), "c"), (4, "quite another text", "d"), (4, "quite another text", "d"), (None, "kept", "e")]
    out = S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id or -1, r.lang) for r in out.collect()) == [(-1, "e"), (3, "b"), (4, "d")]


def pair(rng, shared, new):
    """Two texts of `shared` common five-word shingles and `new` others each: a common start and own ends."""
    start = [f"w{x}" for x in rng.integers(0, 1 << 40, shared + 4)]
    return [" ".join(start + [f"w{x}" for x in rng.integers(0, 1 << 40, new)]) for _ in range(2)]


def test_near_dedup_is_exact_about_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3, raising=False)  # so that groups are dealt out in pairs of chunks
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for k, (shared, new) in enumerate([(160, 20)] * 60 + [(158, 21)] * 60 + [(90, 5)] * 30 + [(140, 30)] * 60 + [(16, 2)] * 30):
        a, b = pair(rng, shared, new)
        rows += [(2 * k, a), (2 * k + 1, b)]
        want |= {2 * k} if shared / (shared + 2 * new) >= 0.8 else {2 * k, 2 * k + 1}
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    for k in range(12):  # one group of many
        rows.append((9000 + k, " ".join([*base[: 10 * k], "new", *base[10 * k + 1 :]])))
    want.add(9000)
    line = " ".join(f"r{k}" for k in range(40))  # repeated shingles count once
    rows += [(9500, " ".join([line] * 2)), (9501, " ".join([line] * 90))]
    want.add(9500)
    got = [r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) - want == set() and want - set(got) == set()


def test_near_dedup_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b), (None, c), (None, c), (None, a)]
    got = S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, c), (1, a), (1, b)]


@pytest.mark.parametrize("group", [3, 1024])
def test_near_dedup_of_large_groups_matches_brute_force(spark, monkeypatch, group):
    """A star (copies alike to their origin only), a chain and a loose group, dealt out to chunks of few texts."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(group)
    origin = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
    texts = []
    for k in range(14):  # each has another stretch of 15 words replaced: about 0.83 to the origin, 0.7 to each other
        texts.append([*origin[: 12 * k], *[f"s{k}-{x}" for x in range(15)], *origin[12 * k + 15 :]])
    texts.append(origin)
    chain = [f"c{x}" for x in range(400)]
    texts += [chain[12 * k : 12 * k + 204] for k in range(12)]  # only neighbours are alike
    for k in range(12):
        t = [f"l{x}" for x in range(204)]
        for p in rng.choice(204, int(rng.integers(1, 6)), replace=False):
            t[p] = f"new{k}"
        texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert root[:27] == [0] * 15 + [15] * 12
    assert got == set(root)
