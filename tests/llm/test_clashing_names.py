"""Columns of documents that have the names of results, in either case."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from hourpanel.llm import language_id, sentencepiece_viterbi as sv

from .conftest import rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def clash(df):
    return df.withColumns({"score": F.lit(7), "Spans": F.lit("s"), "Lang_Pred": F.lit("x"), "judged": F.lit(1), "IDS": F.lit(2)})


def test_language_stage_keeps_such_columns(spark, edge, small):
    for df in (edge, small):
        got = corpus_pipeline.keep_languages(spark, clash(df), "")
        want = corpus_pipeline.keep_languages(spark, df, "")
        assert got.columns == clash(df).columns
        assert Counter(rows_of(got.select(df.columns))) == Counter(rows_of(want))
        assert {tuple(r) for r in got.select("score", "Spans", "Lang_Pred", "judged").collect()} <= {(7, "s", "x", 1)}


def test_identify_replaces_them(small):
    model = language_id.train(small)
    got = language_id.identify(clash(small), model)
    assert [c for c in got.columns if c.lower() in ("score", "spans", "lang_pred")] == ["lang_pred", "score", "spans"]
    want = language_id.identify(small, model)
    assert sorted(rows_of(got.select("doc_id", "lang_pred", "score"))) == sorted(rows_of(want.select("doc_id", "lang_pred", "score")))


def test_pieces_replace_them(edge):
    coded = sv.encode(clash(edge), PIECES)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"] and "text" not in coded.columns
    back = sv.decode(coded.withColumn("TEXT", F.lit("x")), PIECES)
    assert [c for c in back.columns if c.lower() == "text"] == ["text"]
    want = sv.decode(sv.encode(edge, PIECES), PIECES)
    assert Counter(rows_of(back.select("doc_id", "text"))) == Counter(rows_of(want.select("doc_id", "text")))
