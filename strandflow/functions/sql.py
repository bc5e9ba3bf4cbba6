"""The column functions for SQL users, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sequences import COMPLEMENT_FROM, COMPLEMENT_TO

_KMERS = "CASE WHEN length(s) - k >= off THEN transform(sequence(off, length(s) - k, shift), i -> substring(s, i + 1, k)) ELSE cast(array() AS array<string>) END"
_ID = "CASE WHEN translate(m, 'ACGT', '') = '' AND m <> '' THEN cast(conv(translate(m, 'ACGT', '0123'), 4, 10) AS int) + 5 ELSE 1 END"
FUNCTIONS = {
    "revcomp(s STRING) RETURNS STRING": f"reverse(translate(s, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))",
    "kmers(s STRING, k INT, shift INT, off INT) RETURNS ARRAY<STRING>": _KMERS,
    "kmer_id(m STRING) RETURNS INT": _ID,
    "kmer_ids(s STRING, k INT, shift INT, off INT) RETURNS ARRAY<INT>": f"transform({_KMERS}, m -> {_ID})",
    "token_count(n INT, k INT, shift INT) RETURNS INT": "cast((n - k) / cast(shift AS double) + 1 AS int)",
    "attention_mask(ids ARRAY<INT>) RETURNS ARRAY<INT>": "transform(ids, x -> CASE WHEN x IN (0, 1) THEN 0 ELSE 1 END)",
    "pad_ids(ids ARRAY<INT>, width INT) RETURNS ARRAY<INT>": "concat(ids, array_repeat(0, greatest(width - size(ids), 0)))",
    "l2_norm(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(v, x -> x / greatest(sqrt(aggregate(v, 0D, (a, y) -> a + y * y)), 1e-12D))",
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
