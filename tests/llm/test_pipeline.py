"""The pipeline's stages on a small fixture."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    good = [words(rng, 90, "aeiourstln") for _ in range(120)]
    bad = [words(rng, 90, "xqzjkw#%") for _ in range(60)]
    copy = good[0].split()
    copy[40] = "changed"
    texts = [*good, *bad, good[1], " ".join(copy), good[2] + " write to jo@example.org now", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert sum(i in seen["quality"] for i in range(120)) >= 118 and sum(i in seen["quality"] for i in range(120, 180)) <= 2
    gone = set(seen["quality"]) - set(seen["near_duplicates"])
    assert {180, 181} & set(seen["quality"]) <= gone and not any(i < 120 for i in gone)
    assert all("jo@example.org" not in (r.text or "") for r in seen["personal_data"].values())
    assert set(seen["personal_data"]) == set(seen["near_duplicates"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 100
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_duplicates_lose_no_text_of_a_repeated_id(spark, tmp_path):
    rng = random.Random(2)
    a, b, c = (words(rng, 60, "aeiourstln") for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b + " tail"), (7, c), (7, None), (8, ""), (8, ""), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (7, None), (8, ""), (8, ""), (None, a), (None, None)], key=str)


def test_mixture_keeps_documents_without_words(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, None, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()]
    assert got.count(2) == 1 and got.count(3) == 1 and 1 in got
