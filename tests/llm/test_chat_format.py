"""Chat formatting: exact round trips and the state machine."""

import hashlib

import pytest

from mailframe.llm import chat_format as C

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "<s", "[", "[INST", "<<s>>", "[[INST]]", "a\nb\tc", "é日本 \U0001f600", "x\\", "</s", "$1\\$0", "\x00", "[/INST][/INST]", "long " * 5000]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip(spark):
    rows = [(i, k, role, t) for i, a in enumerate(NASTY) for k, (role, t) in enumerate([("user", a), ("assistant", NASTY[-1 - i]), ("user", "x" + a), ("assistant", a + a)])]
    rows += [(100, 0, a, a) for a in NASTY[:-1]]  # roles, too
    chats = C.format_chats(turns(spark, rows))
    got = {r.conv_id: [(x.role, x.text) for x in r.back] for r in chats.select("conv_id", C.read_back(chats.formatted).alias("back")).collect()}
    want = {}
    for i, _, role, t in sorted(rows):
        want.setdefault(i, []).append((role, t))
    assert got == want
    for r in chats.collect():
        n = len(want[r.conv_id])
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("</s>") == r.formatted.count("[/INST]") == n and r.formatted.count("<s>") == 1


def test_digest(spark):
    rows = [(1, 2, "assistant", None), (1, 0, "system", "s"), (1, 1, "user", "é"), (1, 3, "user", "u"), (1, 4, "assistant", "[INST] b \\")]
    (r,) = C.digest(C.format_chats(turns(spark, rows))).collect()
    lines = "system\ns\nuser\né\nassistant\n\nuser\nu\nassistant\n[INST] b \\\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) == (5, hashlib.sha256(lines.encode()).hexdigest(), 10, hashlib.sha256(b"[INST] b \\").hexdigest(), True)


@pytest.mark.parametrize(("roles", "bad"), [("ua", None), ("sua", None), ("uaua", None), ("a", 0), ("uu", 1), ("usa", 1), ("u", 1), ("ss", 1), ("uax", 2)])
def test_order_of_turns(spark, roles, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    (r,) = C.format_chats(turns(spark, [(1, k, names[c], "t") for k, c in enumerate(roles)])).collect()
    assert (r.valid, r.error_turn) == (bad is None, bad)


def test_edges(spark):
    assert C.format_chats(turns(spark, [])).count() == 0
    got = C.digest(C.format_chats(turns(spark, [(None, None, "user", "b"), (None, 1, "assistant", "c"), (2, 0, "user", "a"), (2, 0, "user", "a")]))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in got) == [(0, 2, 1), (2, 2, 0)]


@pytest.mark.parametrize("bad", [{"opening": ""}, {"opening": "a\\b"}, {"opening": "<s>x"}, {"opening": "aa"}, {"opening": "s><", "closing": "<s"}])
def test_ambiguous_templates_are_refused(bad):
    with pytest.raises(ValueError):
        C.ChatTemplate(**bad)
