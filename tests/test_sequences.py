"""Golden values of the column functions and tokenizers."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import sequences as S
from strandflow.operators.tokenize import KmerTokenizer, LcaTokenizer, encoder_for, generate_kmers, load_vocabulary, vocabulary

SEGMENT = "AATCAAGGAATTATTATCGTT"
K6S1 = [2, 213, 839, 3343, 1069, 165, 648, 2580, 2113, 248, 980, 3905, 3320, 978, 3899, 3296, 884, 3]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'array<int>' if v and isinstance(v[0], int) else 'array<double>'}" for n, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_revcomp(spark):
    assert one(spark, S.revcomp("s"), s="ATGC") == "GCAT"
    assert one(spark, S.revcomp("s"), s="acgtUNRy-") == "-rYNAacgt"


def test_encode_goldens(spark):
    t1, t2 = KmerTokenizer(6, 1), KmerTokenizer(6, 2)
    assert one(spark, t1.encode("s"), s=SEGMENT) == K6S1
    assert one(spark, t2.encode("s", special=False), s=SEGMENT) == [213, 3343, 165, 2580, 248, 3905, 978, 3296]
    assert one(spark, t2.encode("s", 1, special=False), s=SEGMENT) == [839, 1069, 648, 2113, 980, 3320, 3899, 884]
    assert 1 in one(spark, t1.encode("s"), s="AASTTAAGGAATTATTATCGT")
    assert one(spark, S.encode_ids("s", 5, 1), s="TCTTTGCTAAG") == [2, 900, 515, 1022, 1004, 929, 629, 455, 3]


def test_encode_limits(spark):
    assert one(spark, S.encode_ids("s", 5, 1), s="") == [2, 3]
    assert one(spark, S.encode_ids("s", 5, 1, max_unknown=0.2), s="UUUUUTCTTT") == [2, 3]
    assert one(spark, S.encode_ids("s", 5, 1, special=False), s="AC") == []
    with pytest.raises(Exception, match="longer than the limit"):
        one(spark, S.encode_ids("s", 1, 1, token_limit=5), s="ACGTACGT")
    with pytest.raises(Exception, match="longer than the maximum"):
        one(spark, KmerTokenizer(6, 1, max_segment_length=10).encode("s"), s="A" * 11)
    with pytest.raises(ValueError):
        KmerTokenizer(6, 1).encode("s", 1)
    with pytest.raises(ValueError):
        KmerTokenizer(space="other")


def test_n_runs_are_known_in_sequence_space(spark):
    strict = dict(kmer=3, shift=3, max_unknown=0.0)
    assert one(spark, KmerTokenizer(**strict).encode("s"), s="NNNACG") == [2, 1, 5 + 6, 3]
    assert one(spark, KmerTokenizer(**strict, space="kmer").encode("s"), s="NNNACG") == [2, 3]


def test_decode(spark):
    t = KmerTokenizer(6, 2)
    assert one(spark, t.decode(t.encode("s")), s=SEGMENT) == SEGMENT[:-1]
    assert one(spark, t.decode(t.encode("s", 1)), s=SEGMENT) == SEGMENT[1:]
    assert one(spark, t.id_to_token(F.col("i")), i=5) == "AAAAAA"
    assert one(spark, t.id_to_token(F.col("i")), i=4) == "[MASK]"
    assert one(spark, t.token_to_id(F.col("s")), s="[SEP]") == 3


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ACGT", min_size=6, max_size=60), min_size=1, max_size=10), st.integers(1, 3))
def test_decode_inverts_encode(spark, sequences, shift):
    t = KmerTokenizer(6, shift)
    rows = spark.createDataFrame([(s,) for s in sequences], "s string").select("s", t.decode(t.encode("s")).alias("d"), S.revcomp(S.revcomp("s")).alias("r")).collect()
    for r in rows:
        assert r.d == r.s[: 6 + (len(r.s) - 6) // shift * shift]
        assert r.r == r.s


def test_lca_variant(spark):
    assert one(spark, LcaTokenizer(3, 1, "sequence").encode("s"), s="AC*g") == [2, 4, 1, 3]
    assert one(spark, LcaTokenizer(3, 1).encode("s", max_length=4), s="ACGTAC") == [2, 5 + 6, 5 + 27, 3]
    assert len(LcaTokenizer(6)) == 4101 and len(KmerTokenizer(6)) == 4101 and len(KmerTokenizer(6, space="kmer")) == 4100


def test_specials_and_masks(spark):
    a, b = F.array(F.lit(7), F.lit(8)), F.array(F.lit(9))
    assert one(spark, S.with_specials(a, b)) == [2, 7, 8, 3, 9, 3]
    assert one(spark, S.pair_token_types(a, b)) == [0, 0, 0, 0, 1, 1]
    assert one(spark, S.attention_mask("x"), x=[2, 9, 1, 0, 3]) == [1, 1, 0, 0, 1]
    assert one(spark, S.training_mask("x"), x=[2, 9, 1, 0, 3]) == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert one(spark, S.truncate_ids("x", 4), x=[2, 5, 6, 7, 8, 3]) == [2, 5, 6, 3]
    row = spark.createDataFrame([(SEGMENT,)], "s string").select(KmerTokenizer(6, 1).encode_plus("s", pad_to=20).alias("e")).first()["e"]
    assert row["attention_mask"][-2:] == [0, 0] and len(row["input_ids"]) == 20


def test_coordinates(spark):
    assert one(spark, S.token_count(F.col("n"), 6, 2), n=21) == 8
    assert tuple(one(spark, S.token_span(F.col("n"), 6, 2, 1), n=3)) == (7, 13)
    assert tuple(one(spark, S.covering_tokens(F.col("n"), F.lit(21), 6, 2), n=20)) == (7, 7)
    assert one(spark, S.max_token_count(F.col("n"), 2, 6), n=21) == 11
    assert one(spark, S.max_segment_length(F.col("n"), 2, 6), n=11) == 22
    with pytest.raises(Exception, match="outside"):
        one(spark, S.tokens_at("s", F.lit(50), 6, 2), s=SEGMENT)


def test_pretty_overlap(spark):
    s = "ATGTCCGCGACCTTTCATACATACCACCGGTAC"
    text = one(spark, S.pretty_overlap("s", S.kmers("s", 6, 2), 6, 2), s=s)
    assert text.split("\n") == ["    " + s, "0.  ATGTCC  GACCTT  ATACAT  CACCGG", "1.    GTCCGC  CCTTTC  ACATAC  CCGGTA", "2.      CCGCGA  TTTCAT  ATACCA", "3.        GCGACC  TCATAC  ACCACC"]


def test_numeric_arrays(spark):
    assert one(spark, S.sliding_mean("x", 2), x=[1.0, 3.0, 5.0]) == [2.0, 4.0]
    assert one(spark, S.sliding_mean("x", 6), x=[6.0, 6.0]) == pytest.approx([2.0] * 5)
    x = [float(i) for i in range(8)]
    padded = [1.0, 0.0, *x, 7.0, 6.0, 5.0]  # two places left, three right of each
    assert one(spark, S.convolve_stride("x", 6, 2), x=x) == pytest.approx([sum(padded[i : i + 6]) / 6 for i in range(0, 8, 2)])
    assert one(spark, S.softmax("x"), x=[0.0, 0.0]) == [0.5, 0.5]
    assert one(spark, S.l2_norm("x"), x=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, S.argmax("x"), x=[1.0, 3.0, 3.0]) == 1
    assert [tuple(r) for r in one(spark, S.top_k("x", 2), x=[1.0, 3.0, 3.0])] == [(1, 3.0), (2, 3.0)]
    assert one(spark, S.normalize_attention_mask("x"), x=[0.0, -1e9]) == [1, 0]
    pooled = one(spark, S.attention_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(5.0))), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0), F.lit(0))))
    assert pooled == [1.0]
    assert one(spark, S.mean_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(5.0))), F.array(F.lit(1), F.lit(0)))) == [1.0]


def test_vocabularies(spark, tmp_path):
    rows = {r.id: r.token for r in vocabulary(spark, 2).collect()}
    assert len(rows) == 21 and rows[0] == "[PAD]" and rows[5] == "AA" and rows[20] == "TT"
    assert [r.kmer for r in generate_kmers(spark, 2, "AB").orderBy("id").collect()] == ["AA", "AB", "BA", "BB"]
    (tmp_path / "v.txt").write_text("[PAD]\nA\nC\n")
    assert {r.token: r.id for r in load_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"[PAD]": 0, "A": 1, "C": 2}
    with pytest.raises(ValueError):
        encoder_for("something")
    assert encoder_for("my-kmer-model")


def test_random_segments_match_plain_python(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 50))) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", S.kmer_ids("s", 4, 3, 1).alias("x")).collect()
    digit = {c: i for i, c in enumerate("ACGT")}
    for r in got:
        s = rows[r.i]
        want = []
        for p in range(1, len(s) - 3, 3):
            k = s[p : p + 4]
            want.append(1 if "N" in k else 5 + sum(digit[c] * 4 ** (3 - j) for j, c in enumerate(k)))
        assert r.x == want


def test_kmers_of_long_sequences(spark):
    """Cut from bytes, or only where asked for: a walk from the start to each would take hours."""
    text, began = "ACGTTGCAAC" * 100_000, time.time()
    row = spark.createDataFrame([(text,)], "s string").select(S.kmers("s", 6, 2, 1).alias("k"), S.tokens_at("s", F.lit(700_001), 6, 2).alias("t")).first()
    assert row.k == [text[i : i + 6] for i in range(1, len(text) - 5, 2)]
    assert [[z["index"] * 2 + x.offset for z in x.tokens] for x in row.t] == [[699_996, 699_998, 700_000], [699_997, 699_999, 700_001]]
    assert all(z.kmer == text[(at := z["index"] * 2 + x.offset) : at + 6] for x in row.t for z in x.tokens)
    assert one(spark, S.kmers("s", 2, 1), s="aéxz") == ["aé", "éx", "xz"] and one(spark, S.kmers("s", 9, 1), s="ACG") == []
    for s, k, shift in (("ACGTACGTACG", 6, 2), ("ACGTACG", 3, 4), ("ACG", 6, 2), ("ACGTA", 1, 3)):
        for p in range(len(s)):
            want = [(o, [(j, s[i : i + k]) for j, i in enumerate(range(o, len(s) - k + 1, shift)) if i <= p < i + k]) for o in range(shift)]
            got = one(spark, S.tokens_at("s", F.lit(p), k, shift), s=s)
            assert [(x.offset, [tuple(z) for z in x.tokens]) for x in got] == [w for w in want if w[1]]
    assert time.time() - began < 120


def test_pretty_overlap_makes_its_kmers_once(spark):
    names = F.transform(S.kmers("s", 6, 2), lambda m: F.concat(m, F.lit("123457")))
    df = spark.createDataFrame([("ACGTACGTAC",)], "s string").select(S.pretty_overlap("s", names, 6, 2).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("123457") == 1 and df.first().x.count("123457") == 3
