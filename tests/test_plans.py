"""SQL functions, the preparation pipeline and a query without SQL."""

import random

from strandflow.functions import sql
from strandflow.plans import catalog
from strandflow.plans.preprocess import main
from strandflow.plans.queries import QUERIES

SEGMENT = "AATCAAGGAATTATTATCGTT"


def test_sql_functions(spark):
    assert "kmer_ids" in sql.register(spark)
    row = spark.sql(f"SELECT revcomp('ATGCu') AS r, kmers('ACGTA', 3, 2, 0) AS k, kmer_ids('{SEGMENT}', 6, 2, 1) AS i, kmer_id('ACN') AS u, pad_ids(array(1), 3) AS p, l2_norm(array(3D, 4D)) AS v, kmers('AC', 3, 1, 0) AS e").first()
    assert row.r == "aGCAT" and row.k == ["ACG", "GTA"] and row.i == [839, 1069, 648, 2113, 980, 3320, 3899, 884]
    assert row.u == 1 and row.p == [1, 0, 0] and row.v == [0.6, 0.8] and row.e == []


def test_preprocess(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">a\nACGTACGTACGT\n>b\naaaaaaaa\n")
    main(["--fasta", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--kmer", "6", "--shift", "2", "--max_length", "100"])
    rows = spark.read.parquet(str(tmp_path / "out/training_data")).collect()
    assert len(rows) == 8 and {len(r.input_ids) for r in rows} == {6} and sorted(r.torch_id for r in rows) == list(range(8))
    assert spark.read.parquet(str(tmp_path / "out/database")).count() == 4


def test_pretty_print_whole_segments(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (6, 45, 512, 700, 1300) * 14]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def printed(s):
        kmers = [s[i : i + 6] for i in range(0, len(s) - 5, 2)]
        return "\n".join(["    " + s, *(f"{n}.  " + "  " * n + "  ".join(kmers[n::4]) for n in range(4))])

    want = {r.segment_id: printed(r.segment) for r in catalog.segments(spark, str(tmp_path)).collect()}
    got = {r.segment_id: r.lines for r in QUERIES["q_pretty_print"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 100 and max(map(len, want.values())) > 2000
