"""The pipeline on planted cases, and the entry point."""

import numpy as np

import __spark_entry__
import corpus_pipeline

PROSE = {"en": ["the", "on", "er", "th", "in"], "de": ["und", "ein", "ge", "sch", "ä"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PROSE[lang], rng.integers(1, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = [(i, prose(rng, ["en", "de"][i % 2], 60), ["en", "de"][i % 2], f"s{i % 4}", 0) for i in range(300)]
    items = [(i, prose(rng, "en", 40)) for i in range(5)]
    bad = [(1000 + i, " ".join(w for x in prose(rng, "en", 30).split() for w in (x, str(rng.choice(["idiot", "scum", "moron"]))) if w == x or rng.random() < 0.4), "en", "s1", 0) for i in range(60)]
    copies = [(2000 + i, docs[i][1], "en", "s2", 0) for i in range(20)] + [(3000 + i, docs[i][1] + " tail", "en", "s2", 0) for i in range(20)]
    leaks = [(4000 + i, prose(rng, "en", 20) + " " + items[i][1].upper() + ". " + prose(rng, "en", 9), "en", "s3", 0) for i in range(5)]
    blank = [(5000, "123 456", None, "s0", 0), (5001, None, None, None, 0)]
    spark.createDataFrame(docs + bad + copies + leaks + blank, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(r[0], 1, int(1000 <= r[0] < 2000)) for r in docs[:200] + bad[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert len(out) == len(kept)
    assert kept.isdisjoint({r[0] for r in copies[:20] + leaks + blank})
    assert len(kept & {r[0] for r in bad}) <= 3 and len(kept & set(range(300))) >= 295
    assert len(kept & {r[0] for r in copies[20:]}) <= 1
    by_source = {r.source: (r.target, r.source_size) for r in out}
    for s, (target, size) in by_source.items():
        assert abs(sum(r.taken for r in out if r.source == s) - target) <= 1 and sum(r.size for r in out if r.source == s) == size


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_point_names_every_operator():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
