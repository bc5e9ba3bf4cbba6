"""Training-corpus pipeline over ``documents``: five stages, each on all its predecessor kept.

1. quality: rows that the positive-unlabelled classifier rejects go;
2. near_dedup: one row of each group of near copies stays;
3. decontaminate: rows that give a benchmark item away go;
4. pii: personal data is masked in the texts, ``n_chars`` follows;
5. bpe: texts become token ids, with digests of ids and of the decoded text.

Stages pass on the columns of ``documents`` and no others: further ones, whatever
their names, are left behind by the first.  Rows with null ids or texts and
repeated rows are rows like others, as each operator says; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontaminate, near_copies, pii, quality
from strandflow.llm.common import drop_staged, scratch, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on this stage's documents and the labels outside the held-out third; keep what scores 0.5 or more."""
    scorer = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, scorer, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, str(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=True)


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: No stage but the third could be told in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    What a stage has read or written on the way is deleted once it is done.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        with scratch() as made:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
