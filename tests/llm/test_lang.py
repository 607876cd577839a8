import zlib

import pytest

from plantloom.llm.lang import fit_languages, identify_languages, op10_language_mixture

from .brute import ODD_SCHEMA, odd_rows


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_language_mixture(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_of_two_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {k: " ".join(r.text for r in docs.where(f"lang = '{k}'").limit(3).collect()).split()
             for k in ("en", "fr")}
    mixed = " ".join(texts["en"][:300] + texts["fr"][:200])
    df = spark.createDataFrame([(1, mixed), (2, " ".join(texts["en"][:200]))], "doc_id long, text string")
    got = {r.doc_id: r for r in identify_languages(df, fit_languages(docs)).collect()}
    share = {x.lang: x.share for x in got[1].lang_mix}
    assert set(share) == {"en", "fr"} and share["en"] == pytest.approx(0.6, abs=0.06)
    assert [x.lang for x in got[2].lang_mix] == ["en"]


def test_odd_rows(spark, sf):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA).withColumnRenamed("size", "lang_pred")
    model = fit_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    got = identify_languages(df, model).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        und = r.doc_id in (2, 3, 4, 6)
        assert (r.lang_pred == "und") == und and (r.lang_score == 0) == und
    empty = fit_languages(df.limit(0))
    assert {r.lang_pred for r in identify_languages(df, empty).collect()} == {"und"}
    assert identify_languages(df.limit(0), model).count() == 0
