"""Projections of prediction tools' result tables to one layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import membership_flag

COMMON = ("fasta_id", "y_pred", "score_phage", "score_not_phage", "method_name")
FRAGMENT = ("fasta_id", "y_true", "y_pred", "score_phage", "score_not_phage", "method_name")


def label_in_id(column: str = "fasta_id") -> Column:
    """The digit after three underscores at the end, null without one."""
    return F.nullif(F.regexp_extract(column, r"___(\d)$", 1), F.lit(""))


def _done(df: DataFrame, method: str, fragment: bool, *, text_label: bool = False) -> DataFrame:
    out = df.withColumn("method_name", F.lit(method))
    if fragment:
        out = out.withColumn("y_true", label_in_id() if text_label else label_in_id().cast("int"))
    return out.select(*(FRAGMENT if fragment else COMMON))


def seeker(df: DataFrame, *, fragment: bool = False) -> DataFrame:
    """Three columns by place: id, Bacteria or Phage, score; the label of fragments stays text."""
    df = df.toDF("fasta_id", "call", "score_phage")
    df = df.withColumn("y_pred", F.when(F.col("call") == "Bacteria", 0).when(F.col("call") == "Phage", 1)).withColumn("score_not_phage", F.bround(1 - F.col("score_phage"), 2))
    return _done(df, "Seeker", fragment, text_label=True)


def metaphinder(df: DataFrame, *, fragment: bool = False) -> DataFrame:
    """Six columns of which three are dropped; rows not processed go; scores run to 100."""
    df = df.drop("merged coverage [%]", "number of hits", "size[bp]").toDF("fasta_id", "call", "score")
    df = df.where(F.col("call").isNotNull() & (F.col("call") != "not processed"))
    df = df.withColumn("y_pred", F.when(F.col("call") == "negative", 0).when(F.col("call") == "phage", 1)).withColumn("score_phage", F.nullif(F.col("score").cast("string"), F.lit("not processed")).cast("double"))
    return _done(df.withColumn("score_not_phage", F.bround(100 - F.col("score_phage"), 3)), "metaPhinder", fragment)


def genomad(df: DataFrame, virus: DataFrame, *, fragment: bool = False) -> DataFrame:
    """Called a phage if listed in the virus table; the other score adds chromosome and plasmid."""
    found = membership_flag(df, "seq_name", virus, "seq_name", "y_pred")
    found = found.select(F.col("seq_name").alias("fasta_id"), "y_pred", F.col("virus_score").alias("score_phage"), F.bround(F.col("chromosome_score") + F.col("plasmid_score"), 3).alias("score_not_phage"))
    return _done(found, "genomad", fragment)


def read_genomad(spark, path: str, virus: DataFrame, *, fragment: bool = False) -> DataFrame:
    schema = "seq_name string, chromosome_score double, plasmid_score double, virus_score double"
    return genomad(spark.read.csv(path, sep="\t", header=True, schema=schema), virus, fragment=fragment)


def virsorter(df: DataFrame, *, fragment: bool = False) -> DataFrame:
    """Rows with call and scores; the id is what stands before the bar."""
    df = df.select("seqname", "dsDNAphage", "ssDNA", "max_score_group").dropna(subset=["max_score_group", "dsDNAphage", "ssDNA"])
    df = df.select(F.split_part("seqname", F.lit("|"), F.lit(1)).alias("fasta_id"), F.when(F.col("max_score_group") == "ssDNA", 0).when(F.col("max_score_group") == "dsDNAphage", 1).alias("y_pred"), F.col("dsDNAphage").alias("score_phage"), F.col("ssDNA").alias("score_not_phage"))
    return _done(df, "virsorter2", fragment)


def deepvirfinder(df: DataFrame, *, fragment: bool = False) -> DataFrame:
    """Called a phage below a p-value of 0.05; the other score is rounded from the unrounded one."""
    df = df.select(F.col("name").alias("fasta_id"), F.when(F.col("pvalue") < 0.05, 1).otherwise(0).alias("y_pred"), F.bround("score", 3).alias("score_phage"), F.bround(1 - F.col("score"), 3).alias("score_not_phage"))
    return _done(df, "deepVirFinder", fragment)


#: Readers by tool.
PARSERS = {"seeker": seeker, "metaphinder": metaphinder, "genomad": genomad, "virsorter": virsorter, "deepvirfinder": deepvirfinder}
