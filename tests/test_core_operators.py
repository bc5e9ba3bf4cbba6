"""Segments, tables, masks, stores, metrics, registry, taxonomy and parsers."""

import gzip
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow import config, infer
from strandflow.functions import sequences as S
from strandflow.operators import checks, embed, masking, numbering, parsers, predict, ranges, registry, segment, taxa, tokenize
from strandflow.operators import store as stores
from strandflow.operators.tokenize import KmerTokenizer
from strandflow.sources import fasta, tables


def seqs(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "sequence_id long, sequence string")


def test_contiguous(spark):
    cut = lambda s, **p: [r.segment for r in segment.segment_sequences(seqs(spark, s), p).orderBy("segment_id").collect()]
    assert cut("TAGAA", max_length=4) == ["TAGA", "A"]
    assert cut("TAGAATAG", min_length=5, max_length=6) == ["TAGAAT"]
    assert [(r.segment_start, r.segment_end) for r in segment.contiguous(seqs(spark, "TAGAATAG"), 3, 4).collect()] == [(0, 4), (4, 8)]
    assert cut("") == []
    rows = segment.segment_sequences(seqs(spark, *["ACGTACGTAC" * 5] * 3), {}).collect()
    assert sorted(r.segment_id for r in rows) == [0, 1, 2]
    with pytest.raises(ValueError, match="The following columns are missing: \\['sequence_id'\\]"):
        segment.segment_sequences(spark.createDataFrame([("A",)], "sequence string"))
    with pytest.raises(ValueError):
        segment.segment_sequences(seqs(spark, "A"), {"type": "other"})
    with pytest.raises(ValueError, match="primary key"):
        segment.segment_sequences(spark.createDataFrame([(1, "A"), (1, "C")], "sequence_id long, sequence string"), {}, strict_key=True)


def test_random_sampling(spark):
    rows = ["A" * 137, "", "C" * 149, "G" * 5]
    got = segment.segment_sequences(seqs(spark, *rows), {"type": "random", "min_length": 10, "max_length": 100, "coverage": 10.0, "seed": 1}).collect()
    total = sum(map(len, rows))
    assert got and all(10 <= len(r.segment) <= 100 and r.segment == rows[r.sequence_id][r.segment_start : r.segment_end] for r in got)
    assert {r.sequence_id for r in got} == {0, 2}
    assert 0.4 * 10 * total < sum(len(r.segment) for r in got) < 1.5 * 10 * total


def test_rectangular(spark):
    ragged = spark.createDataFrame([(1, 0, [2, 100, 101, 3]), (2, 0, [2, 200, 201, 202, 3]), (3, 0, [2, 300, 3])], "segment_id long, offset int, ids array<int>")
    rows = tokenize.rectangular(ragged, 10).orderBy("torch_id").collect()
    assert [r.input_ids for r in rows] == [[2, 100, 101, 3, 0], [2, 200, 201, 202, 3], [2, 300, 3, 0, 0]]
    mixed = tokenize.rectangular(ragged, 10, randomize=True).collect()
    assert sorted(r.torch_id for r in mixed) == [0, 1, 2] == sorted(r.original_torch_id for r in mixed)
    with pytest.raises(Exception, match="longer than the maximum"):
        tokenize.rectangular(ragged, 4).collect()


def test_tokenize_segments(spark):
    rows = spark.createDataFrame([(0, "ACGTACGT", 0), (0, "AAAAAAAA", 1)], "segment_id long, segment string, position int")
    t = KmerTokenizer(6, 2)
    with pytest.raises(ValueError, match="unique"):
        tokenize.tokenize_segments(rows, t)
    assert [r.ids for r in tokenize.tokenize_segments(rows, t, unique=False).orderBy("offset").collect()] == [[2, 5, 5, 3], [2, 5, 3]]
    labelled = spark.createDataFrame([(0, "ACGTACGT", 1)], "segment_id long, segment string, y int")
    assert {r.y for r in tokenize.classification_table(labelled, t, 10).collect()} == {1}
    batch = tokenize.encode_batch(labelled, t).first()
    assert batch.labels == 1 and batch.attention_mask[0] == 0


def test_numbering(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in numbering.cumulative(df, "id", "v", "s", block=64).collect()}
    assert got[999] == sum(i % 7 for i in range(1000)) and got[100] == sum(i % 7 for i in range(101))
    assert sorted(r.n for r in numbering.dense_rows(df.unionByName(df), "id", ["v"], "n", block=64).collect()) == list(range(2000))
    codes = {r.v: r.code for r in numbering.first_seen_codes(spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "v string, pos int"), "v", "pos").collect()}
    assert codes == {"b": 0, "a": 1}
    assert [r.id for r in numbering.shuffled(spark.range(20), "id", 1).collect()] != list(range(20))
    train, test = segment.train_test_split(spark.range(1000).withColumnRenamed("id", "sequence_id"))
    assert 60 < test.count() < 140 and train.count() + test.count() == 1000


def test_masking(spark):
    ids = [2, *range(10, 40), 3]
    rows = spark.createDataFrame([(i, ids) for i in range(200)], "row_id long, input_ids array<int>")
    got = masking.mask_tokens(rows, 4101, probability=0.05, left=1, right=1).collect()
    hits = [[x != -100 for x in r.labels] for r in got]
    assert 0.05 < np.mean(hits) < 0.25
    for r, h in zip(got, hits, strict=True):
        assert all(x == y for x, y, m in zip(r.input_ids, ids, h, strict=True) if not m)
        assert all(x == y for x, y, m in zip(r.labels, ids, h, strict=True) if m)
        assert not h[0] and not h[-1]
    with pytest.raises(AssertionError):
        masking.mask_tokens(rows, 10, left=-1)
    hit = spark.range(1).select(masking.dilate(F.array(*[F.lit(b) for b in (False, False, True, False, False)]), 2, 2).alias("x")).first().x
    assert hit == [False, True, True, True, False]
    fixed = spark.range(1).select(masking.mask_positions(F.array(*[F.lit(i) for i in (7, 8, 9, 10)]), F.array(F.lit(0), F.lit(1)), 1, 1).alias("m")).first().m
    assert fixed["input_ids"] == [4, 4, 4, 10] and fixed["labels"] == [7, 8, 9, -100]
    base = masking.mask_bases(spark.createDataFrame([("AATCAAGGAATTATTATCGTT", [5])], "sample_seq string, pos2mask array<int>"), 6, 1).first()
    assert 4 in base.input_ids and len(base.labels) == len(base.input_ids)


def test_random_windows(spark):
    rows = spark.createDataFrame([(i, list(range(5, 205)), 1) for i in range(50)], "row_id long, input_ids array<int>, y int")
    for kind in masking.DISTRIBUTIONS:
        for r in masking.random_windows(rows, 64, distribution=kind, pad=False).collect():
            assert r.input_ids[0] == 2 and r.input_ids[-1] == 3 and len(r.input_ids) <= 64 and r.labels == 1
    with pytest.raises(ValueError):
        masking.random_windows(rows, 64, distribution="other")
    with pytest.raises(Exception, match="shorter"):
        masking.random_windows(rows, 64, min_length=500).collect()
    assert masking.window_label_distributions(masking.random_windows(rows, 64).drop("labels")).first().labels


def test_store(spark):
    store = spark.createDataFrame([(0, "x|A1", 0, list(range(5, 15))), (1, "x|A2", 1, list(range(20, 120))), (2, "x|A3", 1, [])], "cid long, accession string, shard_id int, tokens array<int>")
    got = stores.draw_windows(store, 20, 300).collect()
    assert len(got) == 300 and all(len(r.window) == 20 for r in got)
    by = {c: [r for r in got if r.cid == c] for c in (0, 1, 2)}
    assert not by[2] and len(by[1]) > 4 * len(by[0])
    assert all(r.window == list(range(5, 15)) + [0] * 10 and r.l_eff == 10 for r in by[0])
    assert all(r.window == list(range(20 + r.start, 40 + r.start)) for r in by[1])
    cat = stores.sample_catalogue(store, stores.draw_pairs(store, 20, 50), 20).collect()
    assert all(r.end <= r.contig_len and r.shard_file == f"tokens.{r.shard_id:03d}.bin" for r in cat)
    asked = spark.createDataFrame([("x|A2", 95)], "accession string, start int")
    assert stores.window_by_accession(store, asked, 20).first().window == list(range(100, 120))
    with pytest.raises(Exception, match="Unknown accession"):
        stores.window_by_accession(store, spark.createDataFrame([("q", 1)], "accession string, start int"), 5).collect()
    with pytest.raises(ValueError):
        stores.draw_pairs(store.where("cid = 2"), 5, 5)
    meta = spark.createDataFrame([("A1", "asm2", 0), ("A2", "asm1", 1)], "accession_id string, assembly_id string, pos int")
    assert {(r.cid, r.label) for r in stores.labelled_windows(store, meta, 20, 100).collect()} == {(0, 0), (1, 1)}
    rows = tables.rows_from_values(spark, [[1, 2], [3, 4], [5, 6]])
    scan = stores.cyclic_scan(rows, 1, 2, end_token=True).orderBy("iteration", "place").collect()
    assert [r.torch_id for r in scan] == [1, 2, 0, 1, 2, 0] and scan[0].input_ids == [3, 4, 3]
    assert stores.row_slice(rows, 1, 3).count() == 2


def test_predictions(spark):
    rows = spark.createDataFrame([(1, 1, 0.2, 0.8), (1, 1, 0.6, 0.4), (2, 0, 0.5, 0.5), (None, 1, 0.1, 0.9)], "sequence_id long, y int, p_class_0 double, p_class_1 double")
    got = {r.sequence_id: (r.y_pred, r.y_true) for r in predict.weighted_voting(rows).collect()}
    assert got == {1: (1, 1), 2: (0, 0)}
    assert predict.weighted_voting(rows.drop("y")).first().y_true is None
    with pytest.raises(ValueError):
        predict.weighted_voting(rows.drop("p_class_0"))
    logits = spark.createDataFrame([(1, 1, 0.0, 2.0), (2, 0, 1.0, -1.0), (3, 0, 0.0, 1.0)], "sequence_id long, y int, logit_y0 double, logit_y1 double")
    m = predict.evaluate_binary(logits.withColumn("y_pred", F.when(F.col("logit_y1") > F.col("logit_y0"), 1).otherwise(0))).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 0, 1) and m.auc_class1 == 1.0 and m.mcc == pytest.approx(0.5)
    loss = -np.mean([math.log(1 / (1 + math.exp(-2))), math.log(1 - 1 / (1 + math.exp(1))), math.log(1 - 1 / (1 + math.exp(-1)))])
    assert m.eval_loss == pytest.approx(loss)
    one = logits.where("y = 0").withColumn("y_pred", F.lit(0))
    assert predict.binary_metrics(one, guarded=True).first().recall == 0 and predict.binary_metrics(one).first().recall is None
    assert predict.auc(one, "logit_y0").first().auc == -1.0
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 30, 400), rng.integers(0, 2, 400)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert predict.auc(spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "s int, y int"), "s").first().auc == pytest.approx(want)


def test_masked_lm(spark):
    rows = spark.createDataFrame([(0, 1, [0.0, 2.0, 1.0]), (1, 0, [0.0, 2.0, 1.0]), (2, -100, [0.0, 0.0, 0.0])], "row_id long, label int, logits array<double>")
    m = predict.masked_lm_metrics(rows).first()
    assert m.n_masked == 2 and m.avg_rank == 2 and m.mrr == pytest.approx((1 + 1 / 3) / 2) and m.hit_at_1 == 0.5
    assert predict.masked_lm_metrics(rows.where("label = -100")).first().loss is None
    soft = spark.createDataFrame([(0, [0.0, 0.0], [0.5, 0.5]), (0, [1.0, 1.0], [0.0, 0.0])], "row_id long, logits array<double>, labels_dist array<double>")
    assert predict.soft_label_kl(soft).first().loss == pytest.approx(0.0, abs=1e-9)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(60)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    scores = []
    for i in range(60):
        gaps = {c: d[i, (y == c) & (np.arange(60) != i)].mean() for c in range(3)}
        b = min(v for c, v in gaps.items() if c != y[i])
        scores.append((b - gaps[y[i]]) / max(b, gaps[y[i]]))
    assert embed.silhouette(df).first().silhouette == pytest.approx(np.mean(scores))
    assert embed.silhouette(df.where("label = 0")).first().silhouette is None
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "class int, centroid array<double>")
    rows = spark.createDataFrame([(0, [3.0, 4.0], 0)], "vec_id int, embedding array<double>, label int")
    assert embed.curricular_logits(rows, centers).first().logits == pytest.approx([64 * 0.6, 64 * 0.8])
    train = embed.curricular_logits(rows, centers, label="label").first()
    hard = 0.6 * math.cos(0.5) - 0.8 * math.sin(0.5)
    assert train.logits == pytest.approx([64 * hard, 64 * 0.8 * 0.8]) and train.target_cosine == pytest.approx(0.6)
    assert embed.updated_tau(embed.curricular_logits(rows, centers, label="label")) == pytest.approx(0.006)
    assert len(embed.pca(df).first().projection) == 2
    with pytest.raises(ValueError):
        embed.reduce_embeddings(df)


def test_fasta(spark, tmp_path):
    text = ">test1 test sequence 1\nATGC\n>test2 test sequence 2\nCG\nTA\n"
    (tmp_path / "a.fasta").write_text(text)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(text)
    for name in ("a.fasta", "b.fasta.gz"):
        rows = fasta.load_contigs(spark, [str(tmp_path / name)]).orderBy("sequence_id").collect()
        assert [(r.sequence_id, r.sequence, r.orientation) for r in rows] == [(0, "ATGC", "forward"), (1, "GCAT", "reverse"), (2, "CGTA", "forward"), (3, "TACG", "reverse")]
        assert rows[0].description == "test1 test sequence 1" and rows[0].fasta_id == "test1"
    two = fasta.load_contigs(spark, [str(tmp_path / "b.fasta.gz"), str(tmp_path / "a.fasta")], reverse_complement=False).orderBy("sequence_id").collect()
    assert [r.fasta_id for r in two] == ["test1", "test2"] * 2 and two[0].source_file.endswith("gz")
    (tmp_path / "p.fasta").write_text(">p\nMKVL\n")
    (tmp_path / "e.fna").write_text("")
    assert [p.path.rsplit("/", 1)[1] for p in fasta.find_nucleotide_files(spark, str(tmp_path)).collect()] == ["a.fasta"]
    assert {p.path.rsplit("/", 1)[1] for p in fasta.non_empty_files(spark, str(tmp_path)).collect()} == {"a.fasta", "b.fasta.gz", "p.fasta"}


def test_fasta_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i}", "A" * n) for i, n in enumerate((60, 125, 3))], "pos long, fasta_id string, sequence string")
    fasta.write_fasta(df, str(tmp_path / "out"), files=1, order="pos")
    assert {r.fasta_id: len(r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {"r0": 60, "r1": 125, "r2": 3}
    fasta.write_fasta_per_record(df, str(tmp_path / "each"))
    assert len([p for p in (tmp_path / "each").iterdir() if p.name.startswith("fasta_id=")]) == 3
    big = spark.createDataFrame([(i, f"r{i}", "A" * 100_000) for i in range(5)], "pos long, fasta_id string, sequence string")
    chunks = [r.chunk for r in fasta.chunk_numbers(big, "pos", 0.1).orderBy("pos").collect()]
    assert chunks == [1, 2, 3, 4, 5]
    assert fasta.chunk_numbers(big.where("pos < 0"), "pos", 0.1).count() == 0
    with pytest.raises(KeyError):
        fasta.sequence_records(df, "nope")
    assert fasta.sequence_records(df, "pos").first().fasta_id == "0"
    assert checks.filter_short_sequences(df, 60).count() == 2


def test_training_tables(spark, tmp_path):
    rows = tables.rows_from_values(spark, [[1, 2], [3, 4]], [0, 1])
    tables.save_training_table(rows, str(tmp_path / "t"), spark.range(3))
    assert tables.load_training_table(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        tables.save_training_table(tables.rows_from_values(spark, [[1], [2, 3]]), str(tmp_path / "u"))
    tables.save_vocabulary(tokenize.vocabulary(spark, 1), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()][-4:] == ["A", "C", "G", "T"]


def test_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, None)], "A long, B long, C double")
    assert checks.is_valid_primary_key(df, "A") and not checks.is_valid_primary_key(df, "B") and not checks.is_valid_primary_key(df, "C")
    with pytest.raises(ValueError):
        checks.is_valid_primary_key(df, "D")
    with pytest.raises(ValueError):
        checks.check_file_exists(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        checks.create_directory_for_filepath("")
    checks.create_directory_for_filepath(str(tmp_path / "x/y/z.txt"))
    assert (tmp_path / "x/y").is_dir()
    assert checks.model_inputs(df.withColumn("labels", F.lit(1))).columns == ["labels"]


def test_joins(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        ranges.validated_left_join(left, right, ["k"])
    assert ranges.validated_left_join(left, right.limit(1), ["k"], "one_to_one").count() == 2
    assert {r.k: r.found for r in ranges.membership_flag(left, "k", right, "k").collect()} == {1: 1, 2: 0}
    spans = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 10, 1000)], "s int, low int, high int")
    points = spark.createDataFrame([(p,) for p in (0, 9, 10, 999, 1000)], "p int")
    assert sorted((r.p, r.s) for r in ranges.interval_join(points, "p", spans, "low", "high", 7).collect()) == [(0, 0), (9, 0), (10, 2), (999, 2)]


def test_config():
    c = config.SEQUENCE_CONFIG
    assert c.parameters("segmentation")["type"] == "contiguous"
    with pytest.raises(TypeError):
        c.parameters("segmentation", {"type": 123})
    with pytest.raises(ValueError):
        c.parameters("segmentation", {"type": "invalid_type"})
    with pytest.raises(ValueError):
        c.parameters("segmentation", {"min_length": -5})
    with pytest.raises(ValueError):
        c.parameters("segmentation", {"unknown": 1})
    with pytest.raises(TypeError):
        c.parameters("segmentation", {"coverage": 1})
    assert c.cast_to_expected_type("tokenization", "add_special_token", "True") is True
    with pytest.raises(ValueError):
        c.cast_to_expected_type("tokenization", "kmer", "six")
    args = c.from_arguments(["--kmer", "3", "--segmentation_type", "random"])
    assert args["tokenization"]["kmer"] == 3 and args["segmentation"]["type"] == "random"
    with pytest.raises(ValueError):
        config.tokenization_parameters({"shift": 6})
    assert config.max_tokens_from_length(21, 2, 6) == 11 and config.max_segment_length_from_tokens(11, 2, 6) == 22


def test_registry(spark, tmp_path):
    name = registry.model_name("TEST", "base", "phage", epochs=0.1, Ls=256)
    assert name == "TEST___base___phage___ls_256___ep_0.1"
    assert registry.parse_model_name(name + "___odd___lr_5e-05") == {"prefix": "TEST", "base_model": "base", "task": "phage", "Ls": 256, "epochs": 0.1, "learning_rate": 5e-05}
    with pytest.raises(ValueError):
        registry.parse_model_name("a___b")
    for n in (0, 10, 200):
        (tmp_path / name / f"checkpoint-{n}").mkdir(parents=True)
        (tmp_path / name / f"checkpoint-{n}/w").write_text("x")
    (tmp_path / "bad").mkdir()
    models = registry.register_models(spark, str(tmp_path))
    assert models.count() == 3 and registry.preferred_checkpoints(models).first().checkpoint == 0
    assert registry.latest_checkpoint(name, str(tmp_path))[2] == 0 and registry.latest_checkpoint("none", str(tmp_path)) == (False, None, None)
    with pytest.raises(ValueError):
        registry.register_models(spark, str(tmp_path / "empty"))
    assert registry.iteration_offset(10, 7, 64) == 6
    assert registry.kmer_and_shift("x-k6s2") == (6, 2) and registry.kmer_and_shift("any-mini-long") == (6, 2)
    with pytest.raises(ValueError):
        registry.kmer_and_shift("other")
    table = spark.createDataFrame([("m", None)], "hf_name string, hf_path string")
    for key, value in (("hf_name", "q"), ("hf_name", "m"), ("nope", "m")):
        with pytest.raises(ValueError):
            registry.lookup_one(table, key, value, "hf_path")


def test_taxa(spark):
    assert taxa.slugify("  Éscherichia coli (K-12)! ") == "escherichia_coli_k_12"
    assert taxa.slugify(None) == "" and taxa.slugify("***") == "unknown"
    assert len(taxa.slugify("a" * 60)) == 40
    closure = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (None, 1)], "taxon_id long, asc_taxon_id long")
    assert [r.taxon_id for r in taxa.descendants(closure, 1).collect()] == [1, 2, 3]
    assert [r.taxon_id for r in taxa.ascendants(closure, 3).collect()] == [1, 2, 3]
    nodes = spark.createDataFrame([(7, "Vibrio")], "taxon_id long, name string")
    asked = spark.createDataFrame([(7,), (8,)], "taxon_id long")
    assert {r.tag for r in taxa.taxon_tag(nodes, asked).collect()} == {"tax7_vibrio", "tax8_unknown"}


def test_parsers(spark):
    seeker = spark.createDataFrame([("c___1", "Phage", 0.91), ("d", "Bacteria", 0.2)], "a string, b string, c double")
    rows = {r.fasta_id: r for r in parsers.seeker(seeker, fragment=True).collect()}
    assert rows["c___1"].y_true == "1" and rows["c___1"].score_not_phage == 0.09 and rows["d"].y_true is None
    deep = spark.createDataFrame([("c___0", 900, 0.12345, 0.04)], "name string, len int, score double, pvalue double")
    assert tuple(parsers.deepvirfinder(deep, fragment=True).first()) == ("c___0", 0, 1, 0.123, 0.877, "deepVirFinder")


def test_infer(spark):
    for c in (infer.EncoderConfig(30, 16, 2, 4, 32, 64), infer.EncoderConfig(30, 16, 2, 4, 32, 64, positions="relative_key_query", pooling="mean", head="curricular"), infer.rotary_config(vocab_size=30, hidden_size=16, layers=4, heads=4, intermediate_size=32, window=4, pooling="cls", head="mlp")):
        w = infer.random_weights(c)
        ids, mask = np.array([[2, 7, 8, 9, 3, 0, 0]]), np.array([[1, 1, 1, 1, 1, 0, 0]])
        h = infer.encode(c, w, ids, mask)
        assert h.shape == (1, 7, 16) and np.allclose(h, infer.encode(c, w, ids, mask, rows=1), atol=1e-5)
        short = infer.encode(c, w, ids[:, :5], mask[:, :5])
        assert np.allclose(infer.pool(c, w, h, mask), infer.pool(c, w, short, mask[:, :5]), atol=1e-4)
        assert infer.classify(c, w, infer.pool(c, w, h, mask)).shape == (1, 2)
        assert infer.masked_lm(c, w, h, np.array([[0, 1]])).shape == (1, 30)
        df = spark.createDataFrame([(1, [2, 7, 3], [1, 1, 1]), (2, [2, 7, 8, 3], [1, 1, 1, 1])], "id int, input_ids array<int>, attention_mask array<int>")
        got = infer.embed(df, c, w).collect()
        assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-4 for r in got)
        assert all(len(r.logits) == 2 for r in infer.predict(df, c, w).collect())
    for bad in (dict(pooling="max"), dict(head="x"), dict(hidden_size=10)):
        with pytest.raises(ValueError):
            infer.EncoderConfig(**bad)
    own = {"a": np.zeros(2), "b": np.zeros(3)}
    _, report = infer.fitting_weights(own, {"a": np.ones(2), "b": np.ones(4), "c": np.ones(1)})
    assert report == {"missing": [], "unexpected": ["c"], "mismatched": ["b"]}
    with pytest.raises(TypeError):
        infer.embed_with(spark.range(1), object())


def test_streaming(spark, tmp_path):
    from strandflow.streaming import event_windows, fasta_to_tokens

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\nACGTACGTAC\n>b\nAAAAAAAA\n>c\nAC\n")
    fasta_to_tokens(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), KmerTokenizer(6, 2)).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.fasta_id, r.offset) for r in rows} == {(i, o) for i in "abc" for o in (0, 1)}
    events = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:05:00", "a", 2.0), ("2024-01-01 02:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.total for r in event_windows(events).collect()) == [3.0, 4.0]
    assert sorted(r.total for r in event_windows(events, "session").collect()) == [3.0, 4.0]
    assert event_windows(events, "sliding", slide="30 minutes").count() == 4


def test_contigs_of_many_files(spark, tmp_path):
    """One scan for all files, in the order given; odd names, several splits, a folder."""
    paths, want = [], []
    for i in (3, 1, 2):
        p = tmp_path / f"a+b é {i}.fa"
        p.write_text("".join(f">r{i}.{j} x\n{'ACGT' * (j + 1)}\n" for j in range(40)))
        paths.append(str(p))
        want += [f"r{i}.{j}" for j in range(40)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/z.fasta").write_text(">last\nAC")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = fasta.load_contigs(spark, [*paths, str(tmp_path / "sub"), paths[0]], reverse_complement=False).orderBy("sequence_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.fasta_id for r in rows] == [*want, "last", *want[:40]] and [r.sequence_id for r in rows] == list(range(161))
    assert all(r.sequence == "ACGT" * (int(r.fasta_id.split(".")[1]) + 1) for r in rows if r.fasta_id != "last")
    with pytest.raises(ValueError):
        fasta.load_contigs(spark, [str(tmp_path / "none.fa")])


def test_record_files_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([("a/1", "ACGT"), ("b|2", "A" * 70)], "fasta_id string, sequence string")
    fasta.write_fasta_files(df, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a_1.fasta": ">a/1\nACGT\n", "b|2.fasta": f">b|2\n{'A' * 60}\n{'A' * 10}\n"}
    rng = np.random.default_rng(0)
    for limit in (1, 10, 55, 1000):
        sizes = rng.integers(1, 60, 300).astype(float)
        want, filled, chunk = [], 0.0, 1
        for x in sizes:
            if filled + x > limit:
                chunk, filled = chunk + 1, 0.0
            filled += x
            want.append(chunk)
        got, f, c = np.empty(0, np.int64), 0.0, 1
        for part in np.array_split(sizes, 7):
            some, f, c = fasta.greedy_chunks(part, f, c, limit)
            got = np.concatenate([got, some])
        assert got.tolist() == want and (f, c) == (filled, chunk)


def test_uniform_draws(spark):
    """The same numbers as column, array and by hand; even, and unrelated from one to the next."""
    got = np.array([r.u for r in spark.range(20_000).select(numbering.uniform(7, F.col("id") - 5, 3).alias("u")).collect()])
    assert (got == numbering.uniform_values(7, np.arange(20_000) - 5, 3)).all() and 0 <= got.min() and got.max() < 1
    assert np.abs(np.histogram(got, 20)[0] - 1000).max() < 150
    assert abs(np.corrcoef(got[1:], got[:-1])[0, 1]) < 0.03 and abs(np.corrcoef(got[2:], got[:-2])[0, 1]) < 0.03
    other = numbering.uniform_values(8, np.arange(20_000) - 5, 3)
    assert abs(np.corrcoef(got, other)[0, 1]) < 0.03


def test_mask_kernel_is_the_column_rule(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [2, *rng.integers(5, 90, n).tolist(), 3] if n else []) for i, n in enumerate([0, 1, 2, 3, 30, 200, 7])] + [(99, None)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>").withColumn("_both", F.lit(1))
    got = {r.row_id: r for r in masking.mask_tokens(df.drop("_both"), 90, probability=0.2, left=2, right=1, seed=3).collect()}
    hits = F.transform("input_ids", lambda x, i: (x >= 5) & (numbering.uniform(3, 1, F.col("row_id"), i) < 0.2))
    want = {r.row_id: r.m for r in df.select("row_id", masking.dilate(hits, 2, 1).alias("m")).collect()}
    assert got[99].labels is None and all([x != -100 for x in got[i].labels] == want[i] for i, ids in rows if ids is not None)


def test_rectangular_from_segments(spark):
    seqs_ = ["ACGTACGTAC", "ACG", "A" * 31, "NNNNNNNNNNNNNN", "ACGTNNACGTACGTTT", "acgtacgta"]
    cut = segment.segment_sequences(seqs(spark, *seqs_), {"max_length": 12, "min_length": 2})
    for t in (KmerTokenizer(6, 2), KmerTokenizer(3, 3, max_unknown=0.1), KmerTokenizer(6, 1, special=False)):
        want = tokenize.rectangular(tokenize.tokenize_segments(cut, t), 40).collect()
        got = tokenize.rectangular_segments(cut, t, 40).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="longer than the maximum"):
        tokenize.rectangular_segments(cut, KmerTokenizer(6, 1), 5).collect()


def test_draws_by_shard(spark):
    store = spark.createDataFrame([(i, f"x|A{i}", i % 3, list(range(5, 5 + 10 * i))) for i in range(8)], "cid long, accession string, shard_id int, tokens array<int>")
    with_length = store.withColumn("length_tok", F.size("tokens"))
    plain = {(r.cid, r.start) for r in stores.draw_pairs(store, 20, 100).collect()}
    got = stores.draw_pairs(with_length, 20, 100, by_shard=True).orderBy("draw_id").collect()
    assert [r.draw_id for r in got] == list(range(100)) and {(r.cid, r.start) for r in got} == plain
    assert [(r.cid % 3, r.cid, r.start) for r in got] == sorted((r.cid % 3, r.cid, r.start) for r in got)
    assert stores.draw_windows(with_length, 20, 100, by_shard=True).count() == 100


def test_many_classes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist(), int(i % 5)) for i in range(60)] + [(60, [1.0] * 6, 1), (61, [1.0] * 6, 1)], "vec_id long, embedding array<double>, label int")
    centers = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(5)], "class int, centroid array<double>")
    small = embed.silhouette(df).first()[0], {r.vec_id: r.logits for r in embed.curricular_logits(df, centers, label="label").collect()}
    monkeypatch.setattr(embed, "BROADCAST_BYTES", 0)
    large = embed.silhouette(df).first()[0], {r.vec_id: r.logits for r in embed.curricular_logits(df, centers, label="label").collect()}
    assert small[0] == pytest.approx(large[0]) and all(small[1][i] == pytest.approx(large[1][i]) for i in small[1])

    class Halves:
        def __init__(self, **options):
            self.rows = 0

        def fit_transform(self, x):
            self.rows = len(x)
            return x[:, :2] / 2

        def transform(self, x):
            return x[:, :2] / 2

    reducer, fitted = embed.reduce_embeddings(df, Halves, max_rows=10)
    assert reducer.rows == 10 and len(fitted) == 10
    assert all(r.projection == [v / 2 for v in r.embedding[:2]] for r in embed.project_embeddings(df, reducer).collect())


def test_names_and_slugs(spark):
    names = ["R___m___t___ls_256___EP2___lr-3e-05___bs_1.5.2___gac_.5___mtl_7.___q_1", "R___m___t", "R___m"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.parameters for r in registry.parsed_names(df).collect()}
    assert registry.parse_model_name(names[0]) == {"prefix": "R", "base_model": "m", "task": "t", "Ls": 256, "epochs": 2, "learning_rate": -3e-05, "gradient_accumulation_steps": 0.5}
    assert got == {names[0]: {"Ls": "256", "epochs": "2", "learning_rate": "-3e-05", "gradient_accumulation_steps": ".5"}, names[1]: {}}
    texts = ["  Éscherichia coli (K-12)! ", "***", "a" * 60, "a" * 39 + " b", None, "x  Y__z", "ﬁne"]
    slugs = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(taxa.slug("t").alias("s")).collect()]
    assert slugs == [taxa.slugify(t) if t is not None else "unknown" for t in texts]


def test_closure_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "taxon_id long, parent_id long")
    assert taxa.transitive_closure(chain).count() == 21
    for edges in (chain.unionByName(spark.createDataFrame([(6, 0)], "taxon_id long, parent_id long")), chain):
        with pytest.raises(ValueError, match="deeper"):
            taxa.transitive_closure(edges, max_depth=5)


def test_strict_casts():
    c = config.Config({"g": {"l": config.Parameter([], "list"), "t": config.Parameter((), "tuple"), "d": config.Parameter({}, "dict"), "b": config.Parameter(False, "bool")}})
    assert c.cast_to_expected_type("g", "l", [1]) == [1] and c.cast_to_expected_type("g", "b", "TRUE") is True
    for name, value in (("l", "abc"), ("t", [1]), ("d", [("a", 1)]), ("b", "yes"), ("b", 1)):
        with pytest.raises(ValueError):
            c.cast_to_expected_type("g", name, value)


def test_published_weights(tmp_path):
    """Written under published names and read again, with and without the prefix, in half precision, with a foreign head."""
    for c in (infer.EncoderConfig(30, 16, 2, 4, 32, 64, positions="relative_key_query", head="mlp"), infer.EncoderConfig(30, 16, 2, 4, 32, 64, head="curricular", projection=6)):
        w = {k: v + np.random.default_rng(3).normal(size=v.shape).astype(np.float32) * 0.1 for k, v in infer.random_weights(c, 5).items()}
        infer.save_pretrained(c, w, str(tmp_path / "m"))
        again, got, report = infer.load_pretrained(str(tmp_path / "m"), strict=True)
        assert again == c and report == {"missing": [], "unexpected": [], "mismatched": []}
        assert got.keys() == w.keys() and all(np.array_equal(got[k], w[k]) for k in w)
        names = infer.load_weights(str(tmp_path / "m/model.safetensors"), base_prefix="none")
        assert names["bert.encoder.layer.1.attention.self.query.weight"].shape == (16, 16) and (names["bert.encoder.layer.1.attention.self.query.weight"].T == w["1.q"]).all()
        assert names["bert.encoder.layer.0.intermediate.dense.weight"].shape == (32, 16)
        other = infer.EncoderConfig(30, 16, 2, 4, 32, 64, positions=c.positions, head="linear", labels=5)
        fit, report = infer.published_weights(other, str(tmp_path / "m/model.safetensors"))
        assert (fit["0.up"] == w["0.up"]).all() and "head.linear" in report["missing"] + report["mismatched"]
        with pytest.raises(ValueError, match="lacks"):
            infer.published_weights(other, str(tmp_path / "m/model.safetensors"), strict=True)
        ids, mask = np.array([[2, 7, 8, 3]]), np.ones((1, 4))
        a, b = (infer.classify(c, x, infer.pool(c, x, infer.encode(c, x, ids, mask), mask)) for x in (w, got))
        assert np.allclose(a, b, atol=1e-6) and a.shape == (1, 2)
    import json
    import struct

    head = json.dumps({"bert.x": {"dtype": "BF16", "shape": [3], "data_offsets": [0, 6]}}).encode()
    (tmp_path / "b.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + struct.pack("<3H", 0x3F80, 0xC000, 0x0000))
    assert infer.load_weights(str(tmp_path / "b.safetensors"))["x"].tolist() == [1.0, -2.0, 0.0]


def test_heads_and_losses(spark):
    assert np.abs(infer.erf(np.linspace(-3, 3, 61)) - [math.erf(x) for x in np.linspace(-3, 3, 61)]).max() < 2e-7
    c = infer.EncoderConfig(30, 16, 1, 4, 32, 64)
    w = infer.random_weights(c)
    h, mask = np.random.default_rng(0).normal(size=(1, 5, 16)).astype(np.float32), np.array([[1, 1, 1, 0, 0]])
    cold, hot = (infer.pool(c, w | {"pool.temperature": np.float32(x)}, h, mask) for x in (-50, 50))
    assert np.allclose(hot, infer.pool(c, w | {"pool.temperature": np.log(np.float32(10))}, h, mask), atol=1e-6)
    assert np.allclose(cold, infer.pool(c, w | {"pool.temperature": np.log(np.float32(0.1))}, h, mask), atol=1e-6) and not np.allclose(hot, cold)
    rows = spark.createDataFrame([([0.5, -1.0], 1), ([2.0, 0.0], 0)], "logits array<double>, labels int")
    x = np.array([[0.5, -1.0], [2.0, 0.0]])
    want = np.mean(np.log(np.exp(x).sum(1)) - x[[0, 1], [1, 0]])
    assert infer.classification_loss(rows).first().loss == pytest.approx(want)
    one = spark.createDataFrame([([0.5], 1.0), ([2.0], 0.0)], "logits array<double>, labels double")
    assert infer.classification_loss(one).first().loss == pytest.approx((0.25 + 4) / 2)
    many = spark.createDataFrame([([0.5, -1.0], [1, 0])], "logits array<double>, labels array<int>")
    p = 1 / (1 + np.exp(-x[0]))
    assert infer.classification_loss(many).first().loss == pytest.approx(-np.mean([np.log(p[0]), np.log(1 - p[1])]))
    with pytest.raises(ValueError):
        infer.classification_loss(rows, "other")


def test_any_models_vectors(spark):
    mask = np.array([[1, 1, 0]])
    tokens = np.arange(6, dtype=float).reshape(1, 3, 2)

    class Output:
        last_hidden_state = tokens

    for output in (tokens, {"embeddings": tokens}, Output(), (tokens * 0, tokens), {"hidden_states": (tokens * 0, tokens)}, [[1.0, 2.0]]):
        assert infer.vectors_of(output, mask).tolist() == [[1.0, 2.0]]
    with pytest.raises(TypeError):
        infer.vectors_of(np.zeros(3), mask)


def test_many_small_files_never_pass_the_driver(spark, tmp_path, monkeypatch):
    """Files in folders are found, checked and numbered by tasks; large and packed ones by Spark's reader, in the same order."""
    df = spark.createDataFrame([(i, f"r{i:03d}", "ACGT"[i % 4] * (i + 1)) for i in range(60)], "i long, fasta_id string, sequence string")
    fasta.write_fasta_files(df, str(tmp_path / "out"), F.format_string("f%02d", F.floor(F.col("i") / 7)))
    (tmp_path / "out/f03/_hidden.fasta").write_text(">h\nAC\n")
    (tmp_path / "out/f03/r021a.fasta").write_text("\n>x y\nAC\n>\n\n>z\nGT\n")
    (tmp_path / "out/f04/r029a.fasta").write_text("".join(f">big{j}\n{'ACGT' * 300}\n" for j in range(20)))
    with gzip.open(tmp_path / "out/f05/r036a.fasta.gz", "wt") as f:
        f.write(">packed\nGG\n")
    want = []
    for i in range(60):
        want += [f"r{i:03d}", *{21: ["x", "z"], 29: [f"big{j}" for j in range(20)], 36: ["packed"]}.get(i, [])]
    monkeypatch.setattr(fasta, "SMALL", 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = fasta.load_contigs(spark, [str(tmp_path / "out")], reverse_complement=False).orderBy("sequence_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.fasta_id for r in rows] == want and [r.sequence_id for r in rows] == list(range(len(want)))
    names = {r.path.rsplit("/", 1)[1] for r in fasta.find_nucleotide_files(spark, str(tmp_path / "out")).collect()}
    assert names == {f"r{i:03d}.fasta" for i in range(60)} | {"r029a.fasta"}
    assert fasta.non_empty_files(spark, str(tmp_path / "out")).count() == 63
    for text, good in ((">a\r\nAC GT\r\n>b\nXX", True), (">a\nACX", False), ("ACGT", False), (">", True), (">a" + "b" * 70_000 + "\nAC" + "G" * 70_000 + "X", False), ("", False), ("\n>a\nAC", False)):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one/a.fa").write_bytes(text.encode())
        assert (fasta.find_nucleotide_files(spark, str(tmp_path / "one")).count() == 1) == good


def made(df, marker):
    return df._jdf.queryExecution().analyzed().toString().count(marker)


def test_dilation_makes_its_hits_once(spark):
    hits = F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i % 123457 == 2)
    df = spark.range(0, 6).select("id", masking.dilate(hits, 2, 1).alias("m"))
    assert made(df, "123457") == 1
    assert {r.id: r.m for r in df.collect()}[5] == [False, True, True, True, False, False]
    rng = np.random.default_rng(2)
    for left, right in ((0, 0), (3, 0), (0, 2), (12, 9)):
        bits = [bool(x) for x in rng.random(40) < 0.1]
        want = [h or (0 < i < 39 and any(bits[max(0, i - right) : i + left + 1])) for i, h in enumerate(bits)]
        got = spark.range(1).select(masking.dilate(F.array(*map(F.lit, bits)), left, right).alias("m")).first().m
        assert got == want


def test_masks_make_their_places_once(spark):
    df = spark.createDataFrame([("AATCAAGGAATTATTATCGTT", 5)], "sample_seq string, p int").withColumn("pos2mask", F.array("p"))
    places = F.array(F.col("p") + 123457 - 123455)
    m = df.select(masking.mask_positions(S.kmer_ids("sample_seq", 6, 2), places, 1, 1).alias("m"))
    assert made(m, "123457") == 1 and [x == 4 for x in m.first().m["input_ids"]] == [i in (6, 7) for i in range(8)]


def test_drawn_windows_make_tokens_of_drawn_contigs_alone(spark):
    store = spark.createDataFrame([(i, f"x|A{i % 2}", 0, 0 if i == 3 else 40) for i in range(6)], "cid long, accession string, shard_id int, length_tok long")
    bad = F.raise_error(F.lit("not drawn")).cast("array<int>")
    store = store.withColumn("tokens", F.when(F.col("length_tok") == 0, bad).otherwise(F.sequence(F.lit(5), F.lit(44))))
    meta = spark.createDataFrame([("A0", "a", 0), ("A1", "b", 1)], "accession_id string, assembly_id string, pos long")
    got = stores.labelled_windows(store, meta, 10, 50).collect()
    assert len(got) == 50 and all(r.window == list(range(5 + r.start, 15 + r.start)) and r.label == r.cid % 2 for r in got)
    assert sorted(r.draw_id for r in stores.draw_windows(store, 10, 50).collect()) == list(range(50))


def test_classification_table_reads_segments_for_sizes_and_once_more(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i * 7, "".join(rng.choice(list("ACGTN"), 12 + i % 9, p=[0.24] * 4 + [0.04])), i % 2) for i in range(50)]
    spark.createDataFrame(rows, "segment_id long, segment string, y int").write.parquet(str(tmp_path / "cuts"))
    cut, t = spark.read.parquet(str(tmp_path / "cuts")), KmerTokenizer(6, 2)
    table = tokenize.classification_table(cut, t, 20)
    assert len(re.findall(r"Relation \[segment_id#\d+L,segment#", table._jdf.queryExecution().optimizedPlan().toString())) == 1
    want = {(r.segment_id, r.offset): r for r in tokenize.rectangular(tokenize.tokenize_segments(cut, t), 22, randomize=True).collect()}
    got = table.collect()
    assert len(got) == len(want) == 100
    for r in got:
        w = want[r.segment_id, r.offset]
        assert (r.torch_id, r.original_torch_id, r.input_ids, r.y) == (w.torch_id, w.original_torch_id, w.input_ids, r.segment_id // 7 % 2)
    with pytest.raises(ValueError):
        tokenize.classification_table(cut.union(cut), t, 20)


def test_long_sequences_are_walked_once(spark):
    """Segments of four million bases, of either kind; each cut from the start would take hours."""
    text, began = "ACGTTGCA" * 500_000, time.time()
    df = spark.createDataFrame([(0, text), (1, "é" + "ACGT" * 9)], "sequence_id long, sequence string")
    for params in ({"max_length": 50}, {"type": "random", "max_length": 100, "min_length": 5, "coverage": 1.0}):
        got = segment.segment_sequences(df, params).collect()
        assert len(got) > 39_000 and all(r.segment == (text if r.sequence_id == 0 else "é" + "ACGT" * 9)[r.segment_start : r.segment_end] for r in got)
        assert sorted(r.segment_id for r in got) == list(range(len(got)))
    assert time.time() - began < 120
