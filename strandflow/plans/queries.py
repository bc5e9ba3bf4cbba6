"""Named queries over the driver's tables, each beside its DuckDB SQL where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import checks, embed, masking, numbering, parsers, predict, ranges, registry, segment, taxa, tokenize
from ..operators import store as stores
from ..operators.tokenize import KmerTokenizer
from ..sources import fasta
from . import catalog as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            ORACLES[f"q_{f.__name__}"] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


CONTIGS, SEGMENTS = C.CONTIGS.format(keep="ACGTacgt"), C.sql_segments()

# Sequences and segments.


@query(_with(CONTIGS) + "SELECT sequence_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc FROM contigs")
def revcomp(spark, d):
    return C.contigs(spark, d).select("sequence_id", S.revcomp("sequence").alias("rc"))


@query(
    _with(CONTIGS, "numbered AS (SELECT row_number() OVER (ORDER BY sequence_id) - 1 AS record, * FROM contigs)")
    + "SELECT 2 * record AS sequence_id, fasta_id, sequence, 'forward' AS orientation FROM numbered UNION ALL SELECT 2 * record + 1, fasta_id, reverse(translate(sequence, 'ACGT', 'TGCA')), 'reverse' FROM numbered"
)
def load_contigs_rc(spark, d):
    rows = C.contigs(spark, d).withColumns({"description": F.col("fasta_id"), "source_file": F.lit("documents")})
    rows = numbering.dense_rows(rows, "sequence_id", [], "record").drop("sequence_id")
    return fasta.with_reverse(rows, "record").select("sequence_id", "fasta_id", "sequence", "orientation")


@query("SELECT doc_id AS sequence_id, regexp_replace(replace(upper(regexp_replace(text, '[^ACGTUacgtu ]', '', 'g')), 'U', 'T'), ' +', '', 'g') AS sequence FROM documents")
def normalize(spark, d):
    letters = F.regexp_replace("text", "[^ACGTUacgtu ]", "")
    return C.table(spark, d, "documents").select(F.col("doc_id").alias("sequence_id"), S.normalize_sequence(letters).alias("sequence"))


@query(_with(CONTIGS) + "SELECT sequence_id, CAST(length(sequence) AS BIGINT) AS n FROM contigs WHERE length(sequence) >= 200")
def filter_short(spark, d):
    return checks.filter_short_sequences(C.contigs(spark, d), 200).select("sequence_id", F.length("sequence").cast("long").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS \"distinct\", CAST(count(*) - count(l_orderkey) AS BIGINT) AS nulls, count(*) = count(DISTINCT l_orderkey) AS valid FROM lineitem")
def pk_check(spark, d):
    return checks.primary_key_check(C.table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_n(spark, d):
    return checks.select_first_n(C.table(spark, d, "orders"), 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(_with(SEGMENTS) + "SELECT segment_id, sequence_id, segment_start, segment_end, segment FROM segments")
def segment_contiguous(spark, d):
    return C.segments(spark, d)


@query()
def random_segments(spark, d):
    return segment.segment_sequences(C.contigs(spark, d), {"type": "random", "min_length": 20, "max_length": 300, "coverage": 2.0, "seed": 7})


def _sums(spark, d, k: int, shift: int, offset: int = 0, keep: str = "ACGTacgt") -> DataFrame:
    """Ids of each segment by number, sum and place-weighted sum."""
    ids = S.let(S.kmer_ids("segment", k, shift, offset), lambda x: F.struct(
        F.size(x).cast("long").alias("n"),
        F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y).alias("s"),
        F.aggregate(F.transform(x, lambda y, i: y.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, y: a + y).alias("w"),
    ))
    return C.segments(spark, d, keep).select("segment_id", "sequence_id", ids.alias("t")).select("segment_id", "sequence_id", F.col("t.n").alias("n_tokens"), F.col("t.s").alias("id_sum"), F.col("t.w").alias("id_weighted"))


def _sums_sql(k: int, shift: int) -> str:
    return (
        _with(SEGMENTS, C.sql_tokens(k, shift), "agg AS (SELECT segment_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS s, CAST(sum(id * (pos + 1)) AS BIGINT) AS w FROM toks GROUP BY segment_id)")
        + "SELECT g.segment_id, g.sequence_id, coalesce(a.n, 0) AS n_tokens, coalesce(a.s, 0) AS id_sum, coalesce(a.w, 0) AS id_weighted FROM segments g LEFT JOIN agg a ON a.segment_id = g.segment_id"
    )


for _k, _s in ((6, 1), (6, 2), (1, 1), (3, 3)):
    QUERIES[f"q_kmer_tokens_k{_k}s{_s}"] = lambda spark, d, k=_k, s=_s: _sums(spark, d, k, s)
    ORACLES[f"q_kmer_tokens_k{_k}s{_s}"] = _sums_sql(_k, _s)


@query(_with(SEGMENTS, C.sql_tokens(6, 2, 2)) + "SELECT segment_id, CAST(off AS INTEGER) AS \"offset\", list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM toks GROUP BY segment_id, off")
def kmer_tokens_all_offsets(spark, d):
    rows = C.segments(spark, d).select("segment_id", F.posexplode(F.array(*[S.kmer_ids("segment", 6, 2, o) for o in range(2)])).alias("offset", "ids"))
    return rows.where(F.size("ids") > 0)


_ENC = _with(C.sql_segments("ACGTNacgtn"), C.sql_tokens(6, 2), "agg AS (SELECT segment_id, count(*) AS n, count(*) FILTER (id = 1) AS u, list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM toks GROUP BY segment_id)")
_KEPT = "CASE WHEN a.n IS NULL OR a.u > trunc(a.n * 0.2) THEN CAST([] AS INTEGER[]) ELSE a.ids END"


@query(_ENC + f"SELECT g.segment_id, list_concat(list_concat([2], {_KEPT}), [3]) AS input_ids FROM segments g LEFT JOIN agg a ON a.segment_id = g.segment_id")
def unknown_threshold(spark, d):
    return C.segments(spark, d, "ACGTNacgtn").select("segment_id", S.encode_ids("segment", 6, 2, max_unknown=0.2).alias("input_ids"))


@query(_with(C.sql_segments("ACGTNacgtn"), C.sql_tokens(6, 2)) + "SELECT segment_id, list(CAST(CASE WHEN id IN (0, 1) THEN 0 ELSE 1 END AS INTEGER) ORDER BY pos) AS mask, list(CASE WHEN id > 3 OR id IN (1, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY pos) AS training FROM toks GROUP BY segment_id")
def attention_masks(spark, d):
    rows = C.segments(spark, d, "ACGTNacgtn").withColumn("ids", S.kmer_ids("segment", 6, 2)).where(F.size("ids") > 0)
    return rows.select("segment_id", S.attention_mask("ids").alias("mask"), S.training_mask("ids").alias("training"))


_RECT = _with(SEGMENTS, C.sql_tokens(6, 2, 2), "rows_ AS (SELECT g.segment_id, o.off FROM segments g, (SELECT unnest(range(0, 2)) AS off) o)", "filled AS (SELECT r.segment_id, r.off, list_concat(list_concat([2], coalesce((SELECT list(CAST(t.id AS INTEGER) ORDER BY t.pos) FROM toks t WHERE t.segment_id = r.segment_id AND t.off = r.off), CAST([] AS INTEGER[]))), [3]) AS ids FROM rows_ r)", "wide AS (SELECT max(len(ids)) AS w FROM filled)")


@query(_RECT + "SELECT row_number() OVER (ORDER BY segment_id, off) - 1 AS torch_id, segment_id, CAST(off AS INTEGER) AS \"offset\", list_resize(ids, w, 0) AS input_ids FROM filled, wide")
def rectangular(spark, d):
    return tokenize.rectangular_segments(C.segments(spark, d), KmerTokenizer(6, 2), 300)


@query(_with(SEGMENTS) + "SELECT row_number() OVER (ORDER BY segment_id, off) - 1 AS torch_id, segment_id, CAST(off AS INTEGER) AS \"offset\" FROM segments, (SELECT unnest(range(0, 2)) AS off)")
def row_map(spark, d):
    rows = C.segments(spark, d).select("segment_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("offset"))
    return numbering.dense_rows(rows, "segment_id", ["offset"], "torch_id").select("torch_id", "segment_id", "offset")


@query(_with(SEGMENTS) + "SELECT segment_id, substr(segment, 1, CAST(2 * floor((length(segment) - 6) / 2) + 6 AS BIGINT)) AS sequence FROM segments")
def detokenize(spark, d):
    t = KmerTokenizer(6, 2)
    return C.segments(spark, d).select("segment_id", t.decode(t.encode("segment")).alias("sequence"))


@query(
    _with(SEGMENTS, "at_ AS (SELECT segment_id, segment, CAST(length(segment) / 2 AS BIGINT) AS mid FROM (SELECT * REPLACE (substr(segment, 1, 2 * CAST(floor(length(segment) / 2) AS BIGINT)) AS segment) FROM segments))", "places AS (SELECT segment_id, segment, mid, unnest(range(0, length(segment) - 5, 2)) AS i FROM at_)")
    + "SELECT segment_id, CAST(i / 2 AS INTEGER) AS \"index\", substr(segment, i + 1, 6) AS kmer FROM places WHERE mid >= i AND mid < i + 6"
)
def positions_tokens(spark, d):
    found = C.segments(spark, d).select("segment_id", F.inline(S.tokens_at("segment", F.floor(F.length("segment") / 2), 6, 2)))
    return found.where("offset = 0").select("segment_id", F.inline("tokens"))


@query()
def pretty_print(spark, d):
    return C.segments(spark, d).select("segment_id", S.pretty_overlap("segment", S.kmers("segment", 6, 2), 6, 2).alias("lines"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(trunc((l_partkey % 500 + 6 - 6) / 2.0 + 1) AS INTEGER) AS n_tokens, CAST(l_suppkey % 50 * 2 + 1 AS INTEGER) AS seq_start, CAST(l_suppkey % 50 * 2 + 7 AS INTEGER) AS seq_end,"
    " CAST(least(trunc((l_suppkey % 90 + 1) / 2.0), trunc((l_partkey % 500 + 6 - 6) / 2.0 + 1) - 1) AS INTEGER) AS token_start, CAST(greatest(trunc((l_suppkey % 90 + 1 - 6) / 2.0), 0) AS INTEGER) AS token_end FROM lineitem"
)
def token_coords(spark, d):
    length, pos = F.col("l_partkey") % 500 + 6, F.col("l_suppkey") % 90
    rows = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.token_count(length, 6, 2).alias("n_tokens"), S.token_span(F.col("l_suppkey") % 50, 6, 2, 1).alias("a"), S.covering_tokens(pos, length, 6, 2, 1).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "n_tokens", "a.*", "b.*")


@query("SELECT CAST(i AS BIGINT) AS id, substr('ACGT', CAST(floor(i / 64) AS BIGINT) % 4 + 1, 1) || substr('ACGT', CAST(floor(i / 16) AS BIGINT) % 4 + 1, 1) || substr('ACGT', CAST(floor(i / 4) AS BIGINT) % 4 + 1, 1) || substr('ACGT', i % 4 + 1, 1) AS kmer FROM (SELECT unnest(range(0, 256)) AS i)")
def kmer_vocab(spark, d):
    return tokenize.generate_kmers(spark, 4)


# Masks, draws and stores.

_POS = "CAST(sequence_id % 7 AS BIGINT)"


@query(
    _with(SEGMENTS, C.sql_tokens(6, 2), "m AS (SELECT t.segment_id, t.pos, t.id, abs(t.pos - (g.sequence_id % 7 + 2)) <= 2 OR abs(t.pos - 12) <= 2 AS hit FROM toks t JOIN segments g ON g.segment_id = t.segment_id)")
    + "SELECT segment_id, list(CAST(CASE WHEN hit THEN 4 ELSE id END AS INTEGER) ORDER BY pos) AS input_ids, list(CAST(CASE WHEN hit THEN id ELSE -100 END AS INTEGER) ORDER BY pos) AS labels FROM m GROUP BY segment_id"
)
def mask_fixed_positions(spark, d):
    rows = C.segments(spark, d).withColumn("ids", S.kmer_ids("segment", 6, 2)).where(F.size("ids") > 0)
    places = F.array((F.col("sequence_id") % 7 + 2).cast("int"), F.lit(12))
    return rows.select("segment_id", masking.mask_positions(F.col("ids"), places, 2, 2).alias("m")).select("segment_id", "m.*")


@query()
def mask_mlm(spark, d):
    rows = C.tokens(spark, d, KmerTokenizer(6, 1)).where("offset = 0").select(F.col("segment_id").alias("row_id"), F.col("ids").alias("input_ids"))
    return masking.mask_tokens(rows, 4101, probability=0.15)


@query()
def varlen_windows(spark, d):
    rows = C.segments(spark, d).select(F.col("segment_id").alias("row_id"), S.kmer_ids("segment", 6, 1).alias("input_ids"), (F.col("sequence_id") % 2).alias("y"))
    return masking.random_windows(rows, 128, distribution="normal")


@query()
def draw_windows(spark, d):
    return stores.draw_windows(C.store(spark, d), 64, 500)


@query()
def labelled_windows(spark, d):
    meta = C.contigs(spark, d).select(F.col("lang").alias("accession_id"), F.col("lang").alias("assembly_id"), F.col("sequence_id").alias("pos")).groupBy("accession_id", "assembly_id").agg(F.min("pos").alias("pos"))
    return stores.labelled_windows(C.store(spark, d), meta, 64, 300)


@query(_with(CONTIGS) + "SELECT CAST(sequence_id % 8 AS INTEGER) AS shard_id, count(*) AS n_contigs, CAST(sum(greatest(length(sequence) - 5, 0)) AS BIGINT) AS n_tokens FROM contigs GROUP BY 1")
def shard_stats(spark, d):
    return stores.shards_info(C.store(spark, d))


@query(
    _with(CONTIGS, "sized AS (SELECT sequence_id AS cid, fasta_id AS accession, CAST(sequence_id % 8 AS INTEGER) AS shard_id, CAST(greatest(length(sequence) - 5, 0) AS BIGINT) AS length_tok FROM contigs)", "placed AS (SELECT *, CAST(coalesce(sum(length_tok) OVER (PARTITION BY shard_id ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_tok FROM sized)")
    + "SELECT cid, accession, shard_id, length_tok, offset_tok, offset_tok * 2 AS offset_bytes, 'tokens.00' || shard_id || '.bin' AS shard_file FROM placed"
)
def contig_metadata(spark, d):
    return stores.contig_metadata(C.store(spark, d))


@query(_with(CONTIGS) + "SELECT sequence_id, CAST(sum(length(sequence)) OVER (ORDER BY sequence_id) AS BIGINT) AS upto FROM contigs")
def running_total(spark, d):
    rows = C.contigs(spark, d).select("sequence_id", F.length("sequence").cast("long").alias("n"))
    return numbering.cumulative(rows, "sequence_id", "n", "upto").select("sequence_id", "upto")


@query(
    "WITH spans AS (SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS high, o_custkey AS w FROM orders), points AS (SELECT event_id, event_id * 977 % (SELECT max(high) FROM spans) AS place FROM events)"
    " SELECT p.event_id, s.o_orderkey FROM points p JOIN spans s ON p.place >= s.high - s.w AND p.place < s.high"
)
def interval_join(spark, d):
    orders = C.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    spans = numbering.cumulative(orders, "o_orderkey", "o_custkey", "high").select("o_orderkey", (F.col("high") - F.col("o_custkey")).alias("low"), "high")
    total, n = spans.agg(F.max("high"), F.count("*")).first()
    points = C.table(spark, d, "events").select("event_id", (F.col("event_id") * 977 % total).alias("place"))
    return ranges.interval_join(points, "place", spans, "low", "high", max(1, total // n) * 4).select("event_id", "o_orderkey")


# Predictions and metrics.

_PRED = _with(SEGMENTS, C.SEG_PRED)


def _probs(spark, d) -> DataFrame:
    return predict.segment_probabilities(C.segment_predictions(spark, d))


@query(_PRED + "SELECT sequence_id, round(avg(p0), 9) AS p_class_0, round(avg(p1), 9) AS p_class_1, CAST(CASE WHEN avg(p1) > avg(p0) THEN 1 ELSE 0 END AS INTEGER) AS y_pred, min(y) AS y_true FROM prob GROUP BY sequence_id")
def weighted_voting(spark, d):
    v = predict.weighted_voting(_probs(spark, d))
    return v.select("sequence_id", F.round("p_class_0", 9).alias("p_class_0"), F.round("p_class_1", 9).alias("p_class_1"), "y_pred", "y_true")


@query(_PRED + ", m AS (SELECT sequence_id, avg(logit_y0) AS a, avg(logit_y1) AS b, min(y) AS y FROM pred GROUP BY sequence_id) SELECT sequence_id, round(exp(a) / (exp(a) + exp(b)), 9) AS p_class_0, round(exp(b) / (exp(a) + exp(b)), 9) AS p_class_1, CAST(CASE WHEN b > a THEN 1 ELSE 0 END AS INTEGER) AS y_pred, y AS y_true FROM m")
def seq_softmax(spark, d):
    v = predict.logits_to_sequence_predictions(C.segment_predictions(spark, d))
    return v.select("sequence_id", F.round("p_class_0", 9).alias("p_class_0"), F.round("p_class_1", 9).alias("p_class_1"), "y_pred", "y_true")


@query(_PRED + "SELECT sequence_id, CASE WHEN avg(p1) > avg(p0) THEN 'class_1' ELSE 'class_0' END AS predicted_label, round(avg(p1), 9) AS p_class_1 FROM prob GROUP BY sequence_id")
def sequence_inference(spark, d):
    return predict.predict_sequences(C.segment_predictions(spark, d)).select("sequence_id", "predicted_label", F.round("p_class_1", 9).alias("p_class_1"))


_COUNTS = "c AS (SELECT CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp FROM called)"
_RATIOS = (
    "round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,"
    " round(tp / (tp + fn), 9) AS recall, round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS \"precision\", round(tn / (tn + fn), 9) AS npv, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp"
)


@query(_PRED + ", called AS (SELECT y, CASE WHEN logit_y1 > logit_y0 THEN 1 ELSE 0 END AS p FROM pred), " + _COUNTS + " SELECT " + _RATIOS + " FROM c")
def binary_metrics(spark, d):
    rows = C.segment_predictions(spark, d).withColumn("logits", F.array("logit_y0", "logit_y1"))
    m = predict.binary_metrics(predict.prediction_rows(rows))
    names = ("accuracy", "f1", "mcc", "balanced_accuracy", "recall", "specificity", "precision", "npv")
    return m.select(*[F.round(n, 9).alias(n) for n in names], "tn", "fp", "fn", "tp")


_AUC = "r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM scored) SELECT round((sum(rk) FILTER (y = 1) - (count(*) FILTER (y = 1)) * ((count(*) FILTER (y = 1)) + 1) / 2.0::DOUBLE) / ((count(*) FILTER (y = 1)) * (count(*) FILTER (y = 0))), 9) AS auc FROM r"


@query("WITH scored AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id), " + _AUC)
def auc_exact(spark, d):
    rows = C.table(spark, d, "labels").join(C.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), "n_chars")
    return predict.auc(rows, "n_chars").select(F.round("auc", 9).alias("auc"))


@query(_PRED + ", v AS (SELECT avg(p0) AS a, avg(p1) AS b, min(y) AS y FROM prob GROUP BY sequence_id) SELECT count(*) AS n, round(-avg(CASE WHEN y = 1 THEN ln(b / (1 + b)) ELSE ln(1 - b / (1 + b)) END), 9) AS eval_loss FROM v")
def sequence_evaluation(spark, d):
    m = predict.evaluate_sequences(C.segment_predictions(spark, d))
    return m.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), F.round("eval_loss", 9).alias("eval_loss"))


@query("SELECT round(avg(CASE WHEN o_custkey % 5 = o_orderkey % 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, round(avg(CASE WHEN o_custkey % 5 = o_orderkey % 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS recall FROM orders")
def multiclass_metrics(spark, d):
    rows = C.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("y"), (F.col("o_orderkey") % 5).alias("y_pred"))
    m = predict.multiclass_metrics(rows)
    return m.select(F.round("accuracy", 9).alias("accuracy"), F.round("recall", 9).alias("recall"))


_EMB = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS d FROM embeddings)"


@query(
    f"WITH {_EMB}, t AS (SELECT vec_id, x AS tx FROM e WHERE d = label), r AS (SELECT e.vec_id, 1 + count(*) FILTER (e.x > t.tx) AS rk, ln(sum(exp(e.x))) - min(t.tx) AS loss FROM e JOIN t ON t.vec_id = e.vec_id GROUP BY e.vec_id)"
    " SELECT count(*) AS n_masked, round(avg(rk), 9) AS avg_rank, CAST(trunc(median(rk)) AS INTEGER) AS median_rank, round(avg(1.0::DOUBLE / rk), 9) AS mrr, round(avg(CASE WHEN rk <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS hit_at_10, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 6) AS perplexity FROM r"
)
def mlm_metrics(spark, d):
    m = predict.masked_lm_metrics(C.table(spark, d, "embeddings"), logits="embedding")
    return m.select("n_masked", F.round("avg_rank", 9).alias("avg_rank"), "median_rank", F.round("mrr", 9).alias("mrr"), F.round("hit_at_10", 9).alias("hit_at_10"), F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query(f"WITH {_EMB}, r AS (SELECT vec_id, d, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, d) AS n FROM e) SELECT vec_id, CAST(n - 1 AS INTEGER) AS place, CAST(d AS INTEGER) AS \"index\", x AS \"value\" FROM r WHERE n <= 5")
def topk(spark, d):
    rows = C.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.top_k("embedding", 5)).alias("place", "t"))
    return rows.select("vec_id", "place", F.col("t.index").alias("index"), F.col("t.value").alias("value"))


@query(f"WITH {_EMB}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM e GROUP BY vec_id) SELECT e.vec_id, CAST(e.d AS INTEGER) AS d, round(e.x / greatest(n.l, 1e-12::DOUBLE), 9) AS x FROM e JOIN n ON n.vec_id = e.vec_id")
def l2_norm(spark, d):
    rows = C.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.l2_norm("embedding")).alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 9).alias("x"))


@query(f"WITH {_EMB}, g AS (SELECT label, d, avg(x) AS x FROM e GROUP BY label, d) SELECT label, CAST(d AS INTEGER) AS d, round(x, 9) AS x FROM g")
def mean_pool(spark, d):
    return embed.mean_vectors(C.table(spark, d, "embeddings")).select("label", "d", F.round("x", 9).alias("x"))


@query(
    f"WITH {_EMB}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM e GROUP BY vec_id), u AS (SELECT e.vec_id, e.label, e.d, e.x / n.l AS x FROM e JOIN n ON n.vec_id = e.vec_id), k AS (SELECT label AS c, d, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, d), kn AS (SELECT c, sqrt(sum(x * x)) AS l FROM k GROUP BY c)"
    " SELECT u.vec_id, k.c AS \"class\", round(64 * sum(u.x * k.x / kn.l), 6) AS logit FROM u JOIN k ON k.d = u.d JOIN kn ON kn.c = k.c GROUP BY u.vec_id, k.c"
)
def curricular_logits(spark, d):
    rows = C.table(spark, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = means.groupBy(F.col("label").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda z: z["x"]).alias("centroid"))
    classes = centers.agg(F.array_sort(F.collect_list("class")).alias("names"))
    out = embed.curricular_logits(rows.select("vec_id", "embedding"), centers).crossJoin(F.broadcast(classes))
    return out.select("vec_id", F.inline(F.arrays_zip(F.col("names").alias("class"), F.col("logits").alias("logit")))).select("vec_id", "class", F.round("logit", 6).alias("logit"))


@query(
    f"WITH {_EMB}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM e GROUP BY vec_id), u AS (SELECT e.vec_id, e.label, e.d, e.x / n.l AS x FROM e JOIN n ON n.vec_id = e.vec_id), s AS (SELECT label, d, sum(x) AS x, count(*) AS n FROM u GROUP BY label, d),"
    " g AS (SELECT u.vec_id, u.label, s.label AS c, min(s.n) AS n, CASE WHEN s.label = u.label THEN (min(s.n) - sum(u.x * s.x)) / greatest(min(s.n) - 1, 1) ELSE 1 - sum(u.x * s.x) / min(s.n) END AS gap FROM u JOIN s ON s.d = u.d GROUP BY u.vec_id, u.label, s.label),"
    " q AS (SELECT vec_id, max(CASE WHEN c = label THEN gap END) AS a, max(CASE WHEN c = label THEN n END) AS n, min(CASE WHEN c <> label THEN gap END) AS b FROM g GROUP BY vec_id) SELECT round(avg(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM q"
)
def silhouette(spark, d):
    return embed.silhouette(C.table(spark, d, "embeddings")).select(F.round("silhouette", 9).alias("silhouette"))


@query(f"WITH {_EMB} SELECT count(*) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, round(sum(x), 6) AS total FROM e")
def value_stats(spark, d):
    m = embed.value_stats(C.table(spark, d, "embeddings"), "embedding")
    return m.select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("total", 6).alias("total"))


@query(f"WITH {_EMB}, w AS (SELECT vec_id, d, avg(x) OVER (PARTITION BY vec_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x, count(*) OVER (PARTITION BY vec_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM e) SELECT vec_id, CAST(d AS INTEGER) AS d, round(x, 9) AS x FROM w WHERE n = 6")
def moving_average(spark, d):
    rows = C.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.sliding_mean("embedding", 6)).alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 9).alias("x"))


@query(f"WITH {_EMB}, f AS (SELECT vec_id, d, unnest(range(-2, 4)) AS o FROM e WHERE d % 2 = 0), r AS (SELECT vec_id, d, CASE WHEN d + o < 0 THEN -(d + o) - 1 WHEN d + o > 63 THEN 127 - (d + o) ELSE d + o END AS j FROM f) SELECT r.vec_id, CAST(r.d / 2 AS INTEGER) AS d, round(sum(e.x) / 6, 9) AS x FROM r JOIN e ON e.vec_id = r.vec_id AND e.d = r.j GROUP BY r.vec_id, r.d")
def convolve_stride(spark, d):
    rows = C.table(spark, d, "embeddings").select("vec_id", F.posexplode(S.convolve_stride("embedding", 6, 2)).alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 9).alias("x"))


# Registry, taxonomy and joins.


@query("WITH c AS (SELECT o_custkey AS model_directory, CAST(o_orderkey % 40 AS INTEGER) AS checkpoint FROM orders), r AS (SELECT DISTINCT model_directory, checkpoint FROM c) SELECT model_directory, CASE WHEN min(checkpoint) = 0 THEN 0 ELSE max(checkpoint) END AS checkpoint FROM r GROUP BY model_directory")
def best_checkpoint(spark, d):
    rows = C.table(spark, d, "orders").select(F.col("o_custkey").alias("model_directory"), (F.col("o_orderkey") % 40).cast("int").alias("checkpoint"))
    return registry.preferred_checkpoints(rows)


_DEFAULTS = [(i, f"base{i % 3}", lo, hi, 1e-4 * (i + 1), 2.0**i, 1.0 + i, 128.0 * (i + 1)) for i, (lo, hi) in enumerate([(0, 10), (0, 15), (0, 20), (10, 30), (15, 40), (20, 50)])]
_DEFAULTS_SQL = ", ".join(f"({a}, '{b}', {lo}, {hi}, {x!r}::DOUBLE, {int(y)}, {int(g)}, {int(m)})" for a, b, lo, hi, x, y, g, m in _DEFAULTS)


@query(
    f"WITH dflt(pos, basemodel, lo, hi, learning_rate, batch_size, gradient_accumulation_steps, max_token_length) AS (VALUES {_DEFAULTS_SQL}), asked AS (SELECT p_partkey, 'base' || (p_partkey % 3) AS model, p_size AS length FROM part),"
    " hit AS (SELECT a.*, d.*, row_number() OVER (PARTITION BY a.p_partkey ORDER BY d.pos) AS n FROM asked a LEFT JOIN dflt d ON d.basemodel = a.model AND d.lo < a.length AND d.hi >= a.length) SELECT p_partkey, model, length, learning_rate, batch_size, gradient_accumulation_steps, max_token_length FROM hit WHERE n = 1"
)
def training_params(spark, d):
    defaults = spark.createDataFrame(_DEFAULTS, "pos int, basemodel string, seq_length_min int, seq_length_max int, learning_rate double, batch_size double, gradient_accumulation_steps double, max_token_length double")
    asked = C.table(spark, d, "part").select("p_partkey", F.concat(F.lit("base"), (F.col("p_partkey") % 3).cast("string")).alias("model"), F.col("p_size").alias("length"))
    return registry.training_parameters(defaults, asked).drop("seq_length_min", "seq_length_max")


@query("SELECT p_partkey, concat_ws('___', 'RUN', p_brand, p_type, 'ls_' || p_size, CASE WHEN p_partkey % 2 = 0 THEN 'bs_' || (p_partkey % 64) END) AS name FROM part")
def model_name(spark, d):
    part = C.table(spark, d, "part")
    return part.select("p_partkey", registry.model_name_column(F.lit("RUN"), F.col("p_brand"), F.col("p_type"), Ls=F.col("p_size"), batch_size=F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 64)).alias("name"))


@query("SELECT p_partkey, 'RUN' AS prefix, p_brand AS base_model, p_type AS task, CAST(p_size AS VARCHAR) AS ls, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 64 AS VARCHAR) END AS bs FROM part")
def model_name_parse(spark, d):
    rows = registry.parsed_names(model_name(spark, d))
    return rows.select("p_partkey", "prefix", "base_model", "task", F.try_element_at("parameters", F.lit("Ls")).alias("ls"), F.try_element_at("parameters", F.lit("batch_size")).alias("bs"))


@query(f"WITH {C.TAXA} SELECT taxon_id FROM (SELECT taxon_id FROM closure WHERE asc_taxon_id = 11 UNION SELECT 11)")
def taxa_desc(spark, d):
    return taxa.descendants(C.taxa(spark, d)[1], 11)


@query(f"WITH {C.TAXA} SELECT taxon_id FROM (SELECT asc_taxon_id AS taxon_id FROM closure WHERE taxon_id = 103 UNION SELECT 103)")
def taxa_asc(spark, d):
    return taxa.ascendants(C.taxa(spark, d)[1], 103)


@query(f"WITH {C.TAXA}, asked AS (SELECT taxon_id FROM nodes UNION ALL SELECT 999) SELECT a.taxon_id, 'tax' || a.taxon_id || '_' || coalesce(regexp_replace(lower(n.name), '[^a-z0-9]+', '_', 'g'), 'unknown') AS tag FROM asked a LEFT JOIN nodes n ON n.taxon_id = a.taxon_id")
def taxon_tag(spark, d):
    nodes, _ = C.taxa(spark, d)
    asked = nodes.select("taxon_id").unionByName(spark.createDataFrame([(999,)], "taxon_id long"))
    return taxa.taxon_tag(nodes, asked)


@query(f"WITH {C.TAXA} SELECT taxon_id, asc_taxon_id FROM closure")
def taxa_closure(spark, d):
    nation, region = C.table(spark, d, "nation"), C.table(spark, d, "region")
    edges = nation.select((F.col("n_nationkey") + 100).cast("long").alias("taxon_id"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id")).unionByName(region.select((F.col("r_regionkey") + 10).cast("long").alias("taxon_id"), F.lit(1).cast("long").alias("parent_id")))
    return taxa.transitive_closure(edges).select("taxon_id", "asc_taxon_id")


@query(_with(SEGMENTS) + "SELECT g.segment_id, g.sequence_id, l.quality AS y FROM segments g LEFT JOIN labels l ON l.doc_id = g.sequence_id")
def label_join(spark, d):
    labels = C.table(spark, d, "labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").alias("y"))
    return ranges.validated_left_join(C.segments(spark, d).select("segment_id", "sequence_id"), labels, ["sequence_id"]).select("segment_id", "sequence_id", "y")


@query("SELECT d.doc_id, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def isin_flag(spark, d):
    return ranges.membership_flag(C.table(spark, d, "documents").select("doc_id"), "doc_id", C.table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM documents")
def class_encode(spark, d):
    return numbering.sorted_codes(C.table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "code")


@query("WITH f AS (SELECT source, min(doc_id) AS m FROM documents GROUP BY source), c AS (SELECT source, CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS code FROM f) SELECT d.doc_id, c.code FROM documents d JOIN c ON c.source = d.source")
def first_seen_codes(spark, d):
    return numbering.first_seen_codes(C.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "code")


@query("SELECT c.c_custkey, coalesce(n.n_name, 'unknown') AS nation FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 20")
def lookup_default(spark, d):
    asked = C.table(spark, d, "customer").withColumn("key", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")))  # the rest get the default
    return ranges.lookup_with_default(asked, "key", C.table(spark, d, "nation"), "n_nationkey", "n_name", "unknown", "nation").select("c_custkey", "nation")


@query("SELECT a.row_id, a.p_name, b.s_name FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, p_name FROM part) a JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_name FROM supplier) b ON a.row_id = b.row_id")
def positional_join(spark, d):
    a = numbering.dense_rows(C.table(spark, d, "part"), "p_partkey", [], "row_id").select("row_id", "p_name")
    b = numbering.dense_rows(C.table(spark, d, "supplier"), "s_suppkey", [], "row_id").select("row_id", "s_name")
    return ranges.positional_join(a, b)


# Result tables of prediction tools.

_ID = "('ev' || event_id || '___' || (event_id % 2))"
_BASE = "value, event_id FROM events"


def _events(spark, d) -> DataFrame:
    e = C.table(spark, d, "events").select("event_id", "value")
    return e.withColumn("id", F.concat(F.lit("ev"), F.col("event_id").cast("string"), F.lit("___"), (F.col("event_id") % 2).cast("string"))).withColumn("s", (F.col("event_id") * 31 % 1000) / 1000.0)


_S = "(CAST(event_id * 31 % 1000 AS DOUBLE) / 1000)"
_HALF = "CAST(event_id % 2 AS INTEGER) AS y_true, "


def _tool(name: str, frame, micro: str, fragment_sql: str):
    for kind, frag in (("microbiome", False), ("fragment", True)):
        QUERIES[f"q_parse_{name}_{kind}"] = lambda spark, d, frag=frag: frame(spark, d, frag).withColumns({c: F.round(c, 6) for c in ("score_phage", "score_not_phage")})
        ORACLES[f"q_parse_{name}_{kind}"] = fragment_sql if frag else micro


def _seeker(spark, d, frag):
    return parsers.seeker(_events(spark, d).select("id", F.when(F.col("event_id") % 3 == 0, "Phage").otherwise("Bacteria"), F.col("event_id") * 31 % 100 / 100.0), fragment=frag)


_SK = "CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round({s}, 6) AS score_phage, round(1 - {s}, 2) AS score_not_phage, 'Seeker' AS method_name FROM events".format(s="CAST(event_id * 31 % 100 AS DOUBLE) / 100")
_tool("seeker", _seeker, f"SELECT {_ID} AS fasta_id, {_SK}", f"SELECT {_ID} AS fasta_id, CAST(event_id % 2 AS VARCHAR) AS y_true, {_SK}")


def _metaphinder(spark, d, frag):
    skip = F.col("event_id") % 5 == 0
    rows = _events(spark, d).select(F.col("id").alias("#contigID"), F.when(skip, "not processed").when(F.col("event_id") % 3 == 0, "phage").otherwise("negative").alias("classification"), F.when(skip, "not processed").otherwise(F.round(F.col("s") * 100, 3).cast("string")).alias("ANI [%]"), F.lit(1).alias("merged coverage [%]"), F.lit(1).alias("number of hits"), F.lit(1).alias("size[bp]"))
    return parsers.metaphinder(rows, fragment=frag)


_MP = "CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round(round({s} * 100, 3), 6) AS score_phage, round(100 - round({s} * 100, 3), 3) AS score_not_phage, 'metaPhinder' AS method_name FROM events WHERE event_id % 5 <> 0".format(s=_S)
_tool("metaphinder", _metaphinder, f"SELECT {_ID} AS fasta_id, {_MP}", f"SELECT {_ID} AS fasta_id, {_HALF}{_MP}")


def _genomad(spark, d, frag):
    e = _events(spark, d)
    rows = e.select(F.col("id").alias("seq_name"), (F.col("event_id") % 7 / 8.0).alias("chromosome_score"), (F.col("event_id") % 3 / 16.0).alias("plasmid_score"), F.col("s").alias("virus_score"))
    return parsers.genomad(rows, e.where("event_id % 4 = 0").select(F.col("id").alias("seq_name")), fragment=frag)


_GN = "CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round({s}, 6) AS score_phage, round_even(CAST(event_id % 7 AS DOUBLE) / 8 + CAST(event_id % 3 AS DOUBLE) / 16, 3) AS score_not_phage, 'genomad' AS method_name FROM events".format(s=_S)
_tool("genomad", _genomad, f"SELECT {_ID} AS fasta_id, {_GN}", f"SELECT {_ID} AS fasta_id, {_HALF}{_GN}")


def _virsorter(spark, d, frag):
    rows = _events(spark, d).select(F.concat("id", F.lit("||full")).alias("seqname"), F.when(F.col("event_id") % 6 != 0, F.col("s")).alias("dsDNAphage"), (1 - F.col("s")).alias("ssDNA"), F.when(F.col("event_id") % 3 == 0, "ssDNA").otherwise("dsDNAphage").alias("max_score_group"))
    return parsers.virsorter(rows, fragment=frag)


_VS = "CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS y_pred, round({s}, 6) AS score_phage, round(1 - {s}, 6) AS score_not_phage, 'virsorter2' AS method_name FROM events WHERE event_id % 6 <> 0".format(s=_S)
_tool("virsorter", _virsorter, f"SELECT {_ID} AS fasta_id, {_VS}", f"SELECT {_ID} AS fasta_id, {_HALF}{_VS}")


def _deepvirfinder(spark, d, frag):
    rows = _events(spark, d).select(F.col("id").alias("name"), F.lit(500).alias("len"), F.col("s").alias("score"), (F.col("event_id") % 100 / 1000.0).alias("pvalue"))
    return parsers.deepvirfinder(rows, fragment=frag)


_DV = "CAST(CASE WHEN event_id % 100 < 50 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round({s}, 3) AS score_phage, round(1 - {s}, 3) AS score_not_phage, 'deepVirFinder' AS method_name FROM events".format(s=_S)
_tool("deepvirfinder", _deepvirfinder, f"SELECT {_ID} AS fasta_id, {_DV}", f"SELECT {_ID} AS fasta_id, {_HALF}{_DV}")


# Sinks and streams.


@query(_with(CONTIGS) + "SELECT '>' || fasta_id || chr(10) || rtrim(regexp_replace(sequence, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM contigs")
def fasta_text(spark, d):
    return C.contigs(spark, d).select(fasta.fasta_text().alias("record"))


@query(_with(CONTIGS) + "SELECT fasta_id, fasta_id AS description, sequence FROM contigs")
def fasta_roundtrip(spark, d):
    raw = C.contigs(spark, d).select(fasta.fasta_text().alias("value"))
    return fasta.parse_records(raw).select("fasta_id", "description", "sequence")


@query()
def chunk_split(spark, d):
    rows = C.contigs(spark, d).select("sequence_id", "fasta_id", "sequence", "source")
    return fasta.chunk_numbers(rows, "sequence_id", 0.01, group="source").select("sequence_id", "fasta_id", "chunk")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming import event_windows as windows

    out = windows(C.table(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


__all__ = ["ORACLES", "QUERIES", "Window"]

from . import more_queries  # noqa: E402, F401  (adds to both tables)
