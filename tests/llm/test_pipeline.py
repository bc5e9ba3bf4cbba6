"""The corpus pipeline against a brute-force version on a small fixture."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandflow.llm import bpe, pii, quality

WORDS = [f"word{i}" for i in range(500)]


def test_pipeline(spark, tmp_path):
    vocabulary = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    item = sentence(25)
    texts = [sentence(80) for _ in range(60)]
    texts += [texts[3], texts[4], " ".join([*texts[5].split()[:40], "other", *texts[5].split()[41:]])]
    texts += [f"{sentence(30)} {item} {sentence(30)}", item]
    texts += [" ".join(w + "###" for w in sentence(60).split()) for _ in range(14)]
    texts += [sentence(40) + " mail me@example.org or 10.20.30.40 now", ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int("###" not in t), 0) for i, t in enumerate(texts) if i % 2 == 0], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scorer = quality.train(docs, labels)
    kept = {i: t for i, t in enumerate(texts) if scorer.score(quality.features(t.encode())[None])[0] >= 0.5}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    single: dict[int, str] = {}
    for i, t in sorted(kept.items()):
        s = shingles(t)
        if not any(len(s & o) >= 0.8 * len(s | o) for o in map(shingles, single.values())):
            single[i] = t
    clean = {i: t for i, t in single.items() if item.rstrip(".") not in t}
    crf, machine = pii.trained(), bpe.transducer(vocabulary)
    want = {}
    for i, t in clean.items():
        _, spans = next(iter(pii.all_spans(crf, [t])))
        want[i] = machine.encode(pii.mask(t, spans))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in got.collect()} == want
    assert 40 < len(want) < len(texts)
    assert not any(re.search("me@example", machine.decode(x)) for x in want.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeats, clashing columns, then no rows at all; nothing staged is left but the result."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    rows = [(i, sentence(60), "en", "s", 1) for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None), (None, None, None, None, None), (77, None, "en", "s", 0), (78, "", "en", None, 0), (79, sentence(30_000), "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_id", "_score", "key", "id", "kept", "score", "node", "held_out"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, rows[7][1]), (None, None), (1, "")], "item_id long, text string")
    for name, d, n in (("full", docs, None), ("none", docs.limit(0), 0)):
        at = tmp_path / name
        for table, df in (("documents", d), ("labels", labels.limit(n) if n == 0 else labels), ("benchmark", bench)):
            df.write.parquet(str(at / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(at)).collect()
        ids = [r.doc_id for r in got]
        assert n is None or not ids
        if n is None:  # repeated rows stay together, of equal texts the least id stays, of texts without words one at most
            assert ids.count(3) == 3 and ids.count(5) == 1 and 7 not in ids and None not in ids and 78 not in ids
    kept = [p for p in (Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "stage").iterdir() if p.name.startswith("pipeline-")]
    assert len(kept) == len([p for p in kept if p.name.startswith("pipeline-bpe")])


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
