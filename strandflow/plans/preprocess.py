"""The corpus preparation pipeline as one lazy plan, and its command line.

    python -m strandflow.plans.preprocess --fasta DIR --out DIR [--kmer 6 --shift 1 ...]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEQUENCE_CONFIG
from ..operators.segment import segment_sequences
from ..operators.tokenize import KmerTokenizer, rectangular, tokenize_segments
from ..sources.fasta import load_contigs, non_empty_files
from ..sources.tables import save_training_table


def prepare(contigs: DataFrame, segmentation: dict, tokenization: dict, *, randomize: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Contigs to ``(training rows, segments)``: segments, token rows of all offsets, one width, a permutation."""
    segments = segment_sequences(contigs, segmentation)
    tokenizer = KmerTokenizer.from_params(tokenization)
    return rectangular(tokenize_segments(segments, tokenizer), tokenizer.token_limit, randomize=randomize, seed=seed), segments


def prepare_files(spark: SparkSession, fasta_dir: str, out: str, segmentation: dict, tokenization: dict, *, reverse_complement: bool = True) -> None:
    paths = sorted(r["path"] for r in non_empty_files(spark, fasta_dir).collect())  # one entry for each file
    if not paths:
        raise ValueError(f"There are no FASTA files in {fasta_dir}")
    rows, segments = prepare(load_contigs(spark, paths, reverse_complement=reverse_complement, uppercase=True), segmentation, tokenization)
    save_training_table(rows, out, segments.select("segment_id", "sequence_id", "segment_start", "segment_end", F.length("segment").alias("n")))


def main(argv: list[str] | None = None) -> None:
    own = argparse.ArgumentParser(add_help=False)
    own.add_argument("--fasta", required=True)
    own.add_argument("--out", required=True)
    own.add_argument("--no-reverse-complement", action="store_true")
    args, rest = own.parse_known_args(sys.argv[1:] if argv is None else argv)
    params = SEQUENCE_CONFIG.from_arguments(rest, ["segmentation", "tokenization"])
    spark = SparkSession.builder.appName("strandflow-preprocess").getOrCreate()
    prepare_files(spark, args.fasta, args.out, params["segmentation"], params["tokenization"], reverse_complement=not args.no_reverse_complement)


if __name__ == "__main__":
    main()
