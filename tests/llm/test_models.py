"""The trained operators: held-out accuracy and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailframe.llm import language as L
from mailframe.llm import quality as Q
from mailframe.llm import toxicity as T
from mailframe.llm.learning import labelled_sample, platt, sigmoid

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["stre", "nch", "ung"], "cc": ["ção", "el", "que"]}
TOXIC = ["idiot", "scum", "moron", "trash", "zorgut", "blexig"]


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(900):
        lang = sorted(SYLLABLES)[i % 3]
        words = prose(rng, lang, int(rng.integers(5, 80))).split()
        toxic, good = int(i % 7 == 0), int(i % 5 > 0)
        if toxic:
            for _ in range(1 + len(words) // 12):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(TOXIC)))
        if not good:
            words = [w + str(rng.choice(["###", "$$$", "%%"])) for w in words] if i % 2 else [w for w in words for _ in range(4)]
        docs.append((i, " ".join(words), lang if i % 11 else None, "s"))
        if i % 10 < 8:
            labels.append((i, good, toxic))
    docs += [(5000, None, "aa", None), (5001, "", "bb", "s"), (5002, "1234 !?", "cc", "s"), (None, "kalo", None, None), (5003, "kalomi lomi kalo mika lo mi " * 60000, None, "s")]
    labels += [(None, 1, 0), (5000, None, None), (1, None, None), (77777, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).cache()
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in docs}, {r[0]: r for r in labels}


def test_languages(corpus):
    docs, _, rows, _ = corpus
    model = L.fit(docs, ~L.held_out(F.col("doc_id")))
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    out = L.identify(docs, model).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    right = [got[i].lang_pred == sorted(SYLLABLES)[i % 3] for i in range(900) if i % 2 and i % 5 > 0]
    assert np.mean(right) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (5000, 5001, 5002))
    assert got[5003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    kept = L.reject(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == [*docs.columns, "score"] and {5000, 5001, 5002}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()})
    assert kept.count() > 0.97 * 900


def test_no_language_is_learned_from_nothing(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(docs, L.fit(docs, F.lit(True))).collect()] == [(1, "und", 0.0)]
    assert L.identify(docs.limit(0), L.fit(docs.limit(0), F.lit(True))).count() == 0


def test_gram_counts_are_whole(monkeypatch):
    text = "Ab cd éf! " * 700
    whole = L.gram_counts(text)
    assert whole.sum() == 3 * len(text) - 3
    monkeypatch.setattr(L, "pieces", lambda t, overlap: __import__("mailframe.llm.common", fromlist=["x"]).pieces(t, overlap, 101))
    assert (L.gram_counts(text) == whole).all()


def agreement(rows, labels, column, held):
    pairs = [(rows[i].predicted, r[column]) for i, r in labels.items() if i in rows and r[column] is not None and i is not None and held(i)]
    return np.mean([a == b for a, b in pairs]), len(pairs)


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_quality(corpus):
    docs, labels, rows, by_id = corpus
    model = Q.fit(docs, labels, ~Q.held_out(F.col("doc_id")))
    out = Q.score(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    share, n = agreement({r.doc_id: r for r in out}, by_id, 1, lambda i: crc(i) % 4 == 2)
    assert n > 100 and share > 0.95


def test_quality_features_are_whole(monkeypatch):
    text = "Ab ab ab c12 " * 900
    at, share = Q.bag(text)
    assert share.sum() == pytest.approx(1)
    model = Q.QualityModel(np.random.default_rng(0).normal(size=Q.ALL))
    assert model.raw(text) == pytest.approx(share @ model.gain[at])
    assert model.raw(None) == model.raw("") == 0


def test_toxicity(corpus):
    docs, labels, rows, by_id = corpus
    model = T.fit(docs, labels, ~T.held_out(F.col("doc_id")))
    out = T.score(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    share, n = agreement({r.doc_id: r for r in out}, by_id, 2, lambda i: crc(i) % 3 == 1)
    assert n > 100 and share > 0.95
    kept = {r.doc_id for r in T.reject(docs, model).collect()}
    assert {5000, 5001, 5002} <= kept


def test_toxicity_is_learned_from_posteriors(corpus, monkeypatch):
    docs, labels, _, by_id = corpus

    def found():
        model = T.fit(docs, labels, ~T.held_out(F.col("doc_id")))
        got = {r.doc_id: r.score >= 0.7 for r in T.score(docs, model).collect()}
        toxic = [i for i, r in by_id.items() if i in got and r[2] == 1]
        return sum(got[i] for i in toxic) / len(toxic)

    assert found() > 0.8
    monkeypatch.setattr(T.LabelModel, "posterior", lambda self, votes: np.full(len(votes), 0.5))
    assert found() < 0.1


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"you idiot {k}", 5) for k in range(300)] + [(k, "fine words", 6) for k in range(2, 400)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1)] * 300 + [(k, 0) for k in range(2, 400)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True)).filter("y = 1").count() == 1  # one id, however often it is there
    model = T.fit(docs, labels, F.lit(True), train_rows=40)
    assert len({r.score for r in T.score(docs.limit(5), model).collect()}) == 1


def test_voters():
    v = T.Voters(T.Lexicon.mined([], 0, 0))
    vote = lambda t: dict(zip(v.names, v.vote(t, *v.lexicon.count(t)), strict=True))
    rude, calm = vote("You are a stupid PATHETIC LOSER!"), vote("a calm text")
    assert rude["address"] == rude["shouting"] == rude["kinds"] == rude["insults:mind"] == 1
    assert calm["address"] == calm["shouting"] == calm["kinds"] == calm["insults:mind"] == 0
    assert vote("the stupid thing, you know")["address"] == -1 and vote("NASA")["shouting"] == -1
    assert vote(None) == vote("") == vote(" \n") and vote("x" * 600_000)["kinds"] == 0
    long = "word " * 200_000 + "you idiot"
    assert vote(long)["address"] == 1 and vote(long)["kinds"] == -1


def test_toxicity_without_labels(corpus):
    docs, labels, _, _ = corpus
    model = T.fit(docs, labels.limit(0), F.lit(True))
    assert all(0 <= r.score <= 1 for r in T.score(docs, model).collect())
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels.limit(0), F.lit(True))).count() == 0


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(2)
    n, right = 6000, [0.9, 0.8, 0.7, 0.7]
    y = (rng.random(n) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(n) < a, y, 1 - y) for a in right], axis=1)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)  # the last voter copies the one before
    votes[rng.random(votes.shape) < 0.1] = -1
    gold = rng.choice(n, 300, replace=False)
    model = T.LabelModel.fit(votes, np.ones(n), votes[gold], np.ones(300), y[gold])
    assert model.accuracy[:3] == pytest.approx(right[:3], abs=0.06)
    assert model.correlation[3, 4] > 0.6 and abs(model.correlation[0, 1]) < 0.2
    assert abs(model.log_odds[4, 1]) < 0.75 * abs(model.log_odds[2, 1])
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def test_calibration():
    rng = np.random.default_rng(3)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < sigmoid(2 * s - 1)).astype(float)
    assert platt(s, y) == pytest.approx((2, -1), abs=0.25)
    assert platt(s[:5], y[:5]) == (1.0, 0.0)
