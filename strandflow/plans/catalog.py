"""Sequence tables derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import segment_sequences
from ..operators.tokenize import KmerTokenizer, tokenize_segments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str, keep: str = "ACGTacgt") -> DataFrame:
    """``(sequence_id, fasta_id, lang, source, sequence)``: the bases among each document's letters."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("sequence_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("|"), "lang").alias("fasta_id"), "lang", "source", F.upper(F.regexp_replace("text", f"[^{keep}]+", "")).alias("sequence"))


def segments(spark: SparkSession, sf_dir: str, keep: str = "ACGTacgt", min_length: int = 6, max_length: int = 512) -> DataFrame:
    return segment_sequences(contigs(spark, sf_dir, keep), {"min_length": min_length, "max_length": max_length})


def tokens(spark: SparkSession, sf_dir: str, tokenizer: KmerTokenizer, keep: str = "ACGTacgt") -> DataFrame:
    return tokenize_segments(segments(spark, sf_dir, keep), tokenizer, check=False)  # numbered just now


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token store: each contig's k-mers of six by shift one, in eight shards."""
    from ..functions.sequences import kmer_ids

    return contigs(spark, sf_dir).select(F.col("sequence_id").alias("cid"), F.col("fasta_id").alias("accession"), (F.col("sequence_id") % 8).cast("int").alias("shard_id"), F.greatest(F.length("sequence") - 5, F.lit(0)).cast("long").alias("length_tok"), kmer_ids("sequence", 6, 1).alias("tokens"))


def segment_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of labelled documents with logits made by integer arithmetic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").alias("y"))
    rows = segments(spark, sf_dir).join(labels, "sequence_id")
    return rows.select("sequence_id", "segment_id", "y", ((F.col("segment_id") * 37 + F.col("sequence_id") * 11) % 101 / 50.0 - 1).alias("logit_y0"), ((F.col("segment_id") * 53 + F.col("y") * 29) % 97 / 48.0 - 1).alias("logit_y1"))


def taxa(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node table and closure of nations under regions under one root."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = nation.select((F.col("n_nationkey") + 100).cast("long").alias("taxon_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 10).cast("long").alias("parent"))
    r = region.select((F.col("r_regionkey") + 10).cast("long").alias("taxon_id"), F.col("r_name").alias("name"))
    root = spark.createDataFrame([(1, "root")], "taxon_id long, name string")
    nodes = n.select("taxon_id", "name").unionByName(r).unionByName(root)
    up = n.select("taxon_id", F.col("parent").alias("asc_taxon_id"), F.lit("region").alias("asc_rank"))
    top = nodes.where("taxon_id <> 1").select("taxon_id", F.lit(1).cast("long").alias("asc_taxon_id"), F.lit("root").alias("asc_rank"))
    return nodes, up.unionByName(top)


# The same tables in DuckDB SQL, as bodies of WITH.

CONTIGS = "contigs AS (SELECT doc_id AS sequence_id, 'doc' || doc_id || '|' || lang AS fasta_id, lang, source, upper(regexp_replace(text, '[^{keep}]', '', 'g')) AS sequence FROM documents)"
CUTS = "cuts AS (SELECT sequence_id, sequence, unnest(range(0, length(sequence), 512)) AS segment_start FROM contigs)"
SEGMENTS = (
    "segments AS (SELECT row_number() OVER (ORDER BY sequence_id, segment_start) - 1 AS segment_id, sequence_id, CAST(segment_start AS INTEGER) AS segment_start, CAST(segment_end AS INTEGER) AS segment_end, substr(sequence, CAST(segment_start AS BIGINT) + 1, 512) AS segment"
    " FROM (SELECT *, least(segment_start + 512, length(sequence)) AS segment_end FROM cuts) WHERE segment_end - segment_start >= 6)"
)


def sql_segments(keep: str = "ACGTacgt") -> str:
    return ", ".join([CONTIGS.format(keep=keep), CUTS, SEGMENTS])


def sql_id(k: int, text: str = "segment", at: str = "i") -> str:
    """SQL for the id of the k-mer from place ``at`` (from 0), UNK if it holds another letter."""
    digit = [f"(instr('ACGT', substr({text}, {at} + {j + 1}, 1)) - 1)" for j in range(k)]
    rank = " + ".join(f"{d} * {4 ** (k - 1 - j)}" for j, d in enumerate(digit))
    return f"CASE WHEN least({', '.join([*digit, '0'])}) < 0 THEN 1 ELSE 5 + {rank} END"


def sql_tokens(k: int, shift: int, offsets: int = 1) -> str:
    """Tokens one by one: ``toks(segment_id, off, pos, id)``, from ``segments``."""
    return (
        f"places AS (SELECT segment_id, segment, off, unnest(range(off, length(segment) - {k} + 1, {shift})) AS i FROM segments, (SELECT unnest(range(0, {offsets})) AS off)),"
        f" toks AS (SELECT segment_id, off, CAST((i - off) / {shift} AS BIGINT) AS pos, {sql_id(k)} AS id FROM places)"
    )


SEG_PRED = (
    "pred AS (SELECT s.sequence_id, s.segment_id, l.quality AS y, CAST((s.segment_id * 37 + s.sequence_id * 11) % 101 AS DOUBLE) / 50 - 1 AS logit_y0, CAST((s.segment_id * 53 + l.quality * 29) % 97 AS DOUBLE) / 48 - 1 AS logit_y1"
    " FROM segments s JOIN labels l ON l.doc_id = s.sequence_id),"
    " prob AS (SELECT sequence_id, segment_id, y, exp(logit_y0) / (exp(logit_y0) + exp(logit_y1)) AS p0, exp(logit_y1) / (exp(logit_y0) + exp(logit_y1)) AS p1, logit_y0, logit_y1 FROM pred)"
)
TAXA = (
    "nodes AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS taxon_id, n_name AS name, CAST(n_regionkey + 10 AS BIGINT) AS parent FROM nation UNION ALL SELECT r_regionkey + 10, r_name, 1 FROM region UNION ALL SELECT 1, 'root', NULL),"
    " closure AS (SELECT taxon_id, parent AS asc_taxon_id FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT taxon_id, 1 FROM nodes WHERE taxon_id >= 100)"
)
