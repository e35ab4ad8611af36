"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.

Defined cases are those of the operators: language ID rejects texts that are
null or have no letter, and those of whose letters no language has a quarter
(which can be so only with five learned languages or more: with up to four,
texts in a language that wasn't learned are labelled and kept); of
equal and of near-equal texts one document stays; secrets are replaced by a
mark and the document stays (``n_chars`` is counted anew); empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourpanel.llm import exact_dedup, language_id, packing, secret_ledger, simhash_dedup
from hourpanel.llm.common import fresh, store

MIN_LANGUAGE_SHARE = 0.25


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    model = language_id.train(docs)
    told = fresh(docs, "lang_pred", "score", "spans")
    judged = language_id.identify(docs, model, names=tuple(told), keep_text=True)
    return judged.where((F.col(told[0]) != language_id.UND) & (F.col(told[1]) >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_ledger.redact(docs, secret_ledger.Ledger(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", keep_languages), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies),
          ("secret_scan", redact_secrets), ("packing", pack_documents)]
#: SQL can express neither the language model nor the tokens; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
