"""SQL of the queries with draws, and queries over files, tokenizer forms, masks, stores and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import masking, numbering, predict, ranges, registry, segment, tokenize
from ..operators import store as stores
from ..operators.numbering import uniform_sql
from ..operators.tokenize import KmerTokenizer, LcaTokenizer
from ..sources import fasta, tables
from ..staging import shared_path
from . import catalog as C
from .queries import CONTIGS, ORACLES, SEGMENTS, _with, query

# Draws, repeated in SQL by the same arithmetic.

_SPANS = "spans AS (SELECT sequence_id, length(sequence) AS length, CAST(sum(length(sequence)) OVER (ORDER BY sequence_id) AS BIGINT) AS high FROM contigs WHERE length(sequence) > 0), total AS (SELECT max(high) AS total FROM spans)"

ORACLES["q_random_segments"] = (
    _with(CONTIGS, _SPANS, f"draws AS (SELECT CAST(floor({uniform_sql(7, 'i')} * total) AS BIGINT) AS place FROM (SELECT unnest(range(0, CAST((total * 2 + 299) // 300 AS BIGINT))) AS i, total FROM total))")
    + ", cut AS (SELECT s.sequence_id, CAST(d.place - (s.high - s.length) AS INTEGER) AS segment_start, s.length FROM draws d JOIN spans s ON d.place >= s.high - s.length AND d.place < s.high), kept AS (SELECT *, CAST(least(segment_start + 300, length) AS INTEGER) AS segment_end FROM cut WHERE least(segment_start + 300, length) - segment_start >= 20)"
    + " SELECT row_number() OVER (ORDER BY k.sequence_id, k.segment_start) - 1 AS segment_id, k.sequence_id, k.segment_start, k.segment_end, substr(c.sequence, k.segment_start + 1, k.segment_end - k.segment_start) AS segment FROM kept k JOIN contigs c ON c.sequence_id = k.sequence_id"
)

ORACLES["q_mask_mlm"] = (
    _with(
        SEGMENTS,
        C.sql_tokens(6, 1),
        "body AS (SELECT segment_id, pos + 1 AS p, id FROM toks)",
        "sized AS (SELECT segment_id, CAST(length(segment) - 3 AS BIGINT) AS n FROM segments)",
        "whole AS (SELECT * FROM body UNION ALL SELECT segment_id, 0, 2 FROM sized UNION ALL SELECT segment_id, n - 1, 3 FROM sized)",
        f"seeds AS (SELECT w.*, s.n, w.id >= 5 AND {uniform_sql(42, 1, 'w.segment_id', 'w.p')} < 0.15::DOUBLE AS hit FROM whole w JOIN sized s ON s.segment_id = w.segment_id)",
        "m AS (SELECT *, hit OR (p >= 1 AND p < n - 1 AND bool_or(hit) OVER (PARTITION BY segment_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)) AS masked FROM seeds)",
        f"f AS (SELECT segment_id, p, id, masked, CASE WHEN NOT masked THEN id WHEN {uniform_sql(42, 2, 'segment_id', 'p')} < 0.8::DOUBLE THEN 4 WHEN {uniform_sql(42, 3, 'segment_id', 'p')} < 0.01::DOUBLE THEN CAST(floor({uniform_sql(42, 4, 'segment_id', 'p')} * 4101) AS BIGINT) ELSE id END AS now FROM m)",
    )
    + "SELECT segment_id AS row_id, list(CAST(now AS INTEGER) ORDER BY p) AS input_ids, list(CAST(CASE WHEN masked THEN id ELSE -100 END AS INTEGER) ORDER BY p) AS labels FROM f GROUP BY segment_id"
)

_U = {i: uniform_sql(42, i, "segment_id") for i in (1, 2, 3, 4)}
ORACLES["q_varlen_windows"] = (
    _with(
        SEGMENTS,
        C.sql_tokens(6, 1),
        "l AS (SELECT segment_id, list(CAST(id AS INTEGER) ORDER BY pos) AS ids FROM toks GROUP BY segment_id)",
        "g AS (SELECT s.segment_id, s.sequence_id % 2 AS y, coalesce(l.ids, CAST([] AS INTEGER[])) AS ids FROM segments s LEFT JOIN l ON l.segment_id = s.segment_id)",
        f"d AS (SELECT *, CAST(len(ids) AS INTEGER) AS n, 0.8::DOUBLE >= {_U[1]} AS cut, 64 + {128 / 6!r}::DOUBLE * sqrt(-2 * ln(1 - {_U[2]})) * cos(2 * pi() * {_U[3]}) AS drawn FROM g)",
        f"e AS (SELECT *, CASE WHEN cut THEN least(greatest(CAST(trunc(drawn) AS INTEGER), 0), 126, n) ELSE least(n, 126) END AS stop, CASE WHEN cut THEN CAST(floor({_U[4]} * (greatest(n - 128, 0) + 1)) AS INTEGER) ELSE 0 END AS start FROM d)",
        "b AS (SELECT *, list_concat(list_concat([2], CASE WHEN stop > start THEN ids[start + 1 : stop] ELSE CAST([] AS INTEGER[]) END), [3]) AS row_ FROM e)",
        "w AS (SELECT max(len(row_)) AS w FROM b)",
    )
    + "SELECT segment_id AS row_id, list_resize(row_, w, 0) AS input_ids, y, start AS window_start, stop AS window_end, y AS labels, list_transform(list_resize(row_, w, 0), lambda x: CAST(CASE WHEN x = 0 THEN 0 ELSE 1 END AS INTEGER)) AS attention_mask FROM b, w"
)


def _drawn(k: int, length: int, seed: int = 1337) -> str:
    """``drawn(draw_id, cid, start, l_eff, window_)`` from ``contigs``: windows of a store of k-mers of six."""
    return ", ".join(
        [
            "lengths AS (SELECT sequence_id AS cid, fasta_id, sequence, CAST(length(sequence) - 5 AS BIGINT) AS length FROM contigs WHERE length(sequence) > 5)",
            "ends AS (SELECT *, CAST(sum(length) OVER (ORDER BY cid) AS BIGINT) AS high FROM lengths)",
            f"places AS (SELECT i AS draw_id, CAST(floor({uniform_sql(seed, 1, 'i')} * (SELECT max(high) FROM ends)) AS BIGINT) AS place FROM (SELECT unnest(range(0, {k})) AS i))",
            f"hits AS (SELECT p.draw_id, e.cid, e.fasta_id, e.sequence, CAST(floor({uniform_sql(seed, 2, 'p.draw_id')} * (greatest(e.length - {length}, 0) + 1)) AS INTEGER) AS start, CAST(least(e.length, {length}) AS INTEGER) AS l_eff FROM places p JOIN ends e ON p.place >= e.high - e.length AND p.place < e.high)",
            f"each AS (SELECT draw_id, i, {C.sql_id(6, 'sequence', 'i')} AS id FROM (SELECT draw_id, sequence, unnest(range(start, start + l_eff)) AS i FROM hits))",
            "lists AS (SELECT draw_id, list(CAST(id AS INTEGER) ORDER BY i) AS ids FROM each GROUP BY draw_id)",
            f"drawn AS (SELECT h.*, list_resize(l.ids, {length}, 0) AS window_ FROM hits h JOIN lists l ON l.draw_id = h.draw_id)",
        ]
    )


ORACLES["q_draw_windows"] = _with(CONTIGS, _drawn(500, 64)) + "SELECT draw_id, cid, start, l_eff, window_ AS \"window\" FROM drawn"
ORACLES["q_labelled_windows"] = (
    _with(CONTIGS, _drawn(300, 64), "codes AS (SELECT lang, CAST(row_number() OVER (ORDER BY m, lang) - 1 AS INTEGER) AS label FROM (SELECT lang, min(sequence_id) AS m FROM contigs GROUP BY lang))")
    + "SELECT c.lang AS accession_id, d.draw_id, d.cid, d.start, d.l_eff, d.window_ AS \"window\", d.fasta_id AS accession, c.lang AS assembly_id, c.label, list_transform(d.window_, lambda x: CAST(CASE WHEN x IN (0, 1, 2, 3) THEN 0 ELSE 1 END AS INTEGER)) AS attention_mask FROM drawn d JOIN codes c ON c.lang = split_part(d.fasta_id, '|', 2)"
)

_LINE = "'{n}.  ' || repeat(' ', {w}) || coalesce(string_agg(m, '  ' ORDER BY i) FILTER (WHERE (i // 2) % 4 = {n}), '')"
ORACLES["q_pretty_print"] = (
    _with(SEGMENTS, "k AS (SELECT segment_id, segment, i, substr(segment, i + 1, 6) AS m FROM (SELECT segment_id, segment, unnest(range(0, length(segment) - 5, 2)) AS i FROM segments))")
    + f"SELECT segment_id, '    ' || segment || chr(10) || {' || chr(10) || '.join(_LINE.format(n=n, w=2 * n) for n in range(4))} AS lines FROM k GROUP BY segment_id, segment"
)
ORACLES["q_chunk_split"] = (
    "WITH RECURSIVE contigs AS (SELECT doc_id AS sequence_id, 'doc' || doc_id || '|' || lang AS fasta_id, source, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS sequence FROM documents),"
    " n AS (SELECT sequence_id, fasta_id, source, length(sequence) + length(fasta_id) + 2 AS size, row_number() OVER (PARTITION BY source ORDER BY sequence_id) AS r FROM contigs),"
    " f AS (SELECT source, r, sequence_id, fasta_id, CASE WHEN size > 10485.76::DOUBLE THEN 2 ELSE 1 END AS chunk, size AS filled FROM n WHERE r = 1"
    " UNION ALL SELECT n.source, n.r, n.sequence_id, n.fasta_id, CASE WHEN f.filled + n.size > 10485.76::DOUBLE THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.filled + n.size > 10485.76::DOUBLE THEN n.size ELSE f.filled + n.size END FROM f JOIN n ON n.source IS NOT DISTINCT FROM f.source AND n.r = f.r + 1)"
    " SELECT sequence_id, fasta_id, CAST(chunk AS BIGINT) AS chunk FROM f"
)


@query(_with(CONTIGS) + f"SELECT sequence_id, CAST(CASE WHEN {uniform_sql(42, 'sequence_id')} < 0.1::DOUBLE THEN 1 ELSE 0 END AS INTEGER) AS test FROM contigs")
def train_test_split(spark, d):
    train, test = segment.train_test_split(C.contigs(spark, d).select("sequence_id"))
    return train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))


_TOTAL = _with(SEGMENTS, "g AS (SELECT s.segment_id, l.quality AS y, CAST(o.off AS INTEGER) AS off, 2 * s.segment_id + o.off AS n FROM segments s LEFT JOIN labels l ON l.doc_id = s.sequence_id, (SELECT unnest(range(0, 2)) AS off) o)")


@query(_TOTAL + f"SELECT row_number() OVER (ORDER BY CAST(floor({uniform_sql(42, 'n')} * 1048576) AS BIGINT), n) - 1 AS torch_id, n AS original_torch_id, segment_id, off AS \"offset\", y FROM g")
def classification_table(spark, d):
    labels = C.table(spark, d, "labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").alias("y"))
    segments = C.segments(spark, d).join(labels, "sequence_id", "left")
    return tokenize.classification_table(segments, KmerTokenizer(6, 2), 560).select("torch_id", "original_torch_id", "segment_id", "offset", "y")


@query(_with(CONTIGS, _drawn(200, 50, 3)) + ", s AS (SELECT d.*, d.cid % 8 AS shard FROM drawn d) SELECT row_number() OVER (ORDER BY shard, cid, start, draw_id) - 1 AS draw_id, cid, start, l_eff FROM s")
def draws_by_shard(spark, d):
    return stores.draw_pairs(C.store(spark, d), 50, 200, 3, by_shard=True)


@query(
    _with(CONTIGS, _drawn(200, 50, 3), "sized AS (SELECT sequence_id AS cid, length(sequence) - 5 AS n FROM contigs)")
    + "SELECT d.draw_id, d.cid, d.start, d.fasta_id AS accession, CAST(d.cid % 8 AS INTEGER) AS shard_id, 'tokens.00' || (d.cid % 8) || '.bin' AS shard_file, CAST(s.n AS BIGINT) AS contig_len, 50 AS l_req, d.l_eff, d.start + d.l_eff AS \"end\" FROM drawn d JOIN sized s ON s.cid = d.cid"
)
def sample_catalogue(spark, d):
    store = C.store(spark, d)
    return stores.sample_catalogue(store, stores.draw_pairs(store, 50, 200, 3), 50)


@query(
    _with(CONTIGS, "asked AS (SELECT sequence_id, fasta_id, sequence, CAST(greatest(0, least(sequence_id % 97, length(sequence) - 5 - 20)) AS BIGINT) AS first, CAST(least(20, greatest(length(sequence) - 5, 0)) AS BIGINT) AS n FROM contigs)")
    + f", each AS (SELECT sequence_id, i, {C.sql_id(6, 'sequence', 'i')} AS id FROM (SELECT sequence_id, sequence, unnest(range(first, first + n)) AS i FROM asked)), l AS (SELECT sequence_id, list(CAST(id AS INTEGER) ORDER BY i) AS ids FROM each GROUP BY sequence_id)"
    + " SELECT a.fasta_id AS accession, a.sequence_id % 97 AS start, list_resize(coalesce(l.ids, CAST([] AS INTEGER[])), 20, 0) AS \"window\" FROM asked a LEFT JOIN l ON l.sequence_id = a.sequence_id"
)
def window_by_accession(spark, d):
    asked = C.contigs(spark, d).select(F.col("fasta_id").alias("accession"), (F.col("sequence_id") % 97).alias("start"))
    return stores.window_by_accession(C.store(spark, d), asked, 20)


@query("SELECT i AS torch_id, CAST(r AS BIGINT) AS iteration, (i + 3) % n AS place, [CAST(s_suppkey AS INTEGER), 3] AS input_ids FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n, s_suppkey FROM supplier), (SELECT unnest(range(0, 2)) AS r)")
def cyclic_scan(spark, d):
    rows = numbering.dense_rows(C.table(spark, d, "supplier"), "s_suppkey", [], "torch_id").select("torch_id", F.array(F.col("s_suppkey").cast("int")).alias("input_ids"))
    n = rows.count()
    return stores.cyclic_scan(rows, n - 3 % n, 2, end_token=True)


@query("SELECT l_orderkey, l_linenumber, CAST(4 * 3 * l_linenumber * (l_suppkey % 50) % 1009 AS BIGINT) AS row_offset FROM lineitem")
def iteration_offset(spark, d):
    line = C.table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", registry.iteration_offset(F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 50, 1009, 3, 4).cast("long").alias("row_offset"))


# Tokenizer forms.


@query("SELECT l_orderkey, l_linenumber, CAST((l_suppkey % 90 + 3) * 2 - 3 * 2 + 6 AS BIGINT) AS bases, CAST(ceil((l_partkey % 500 + 6 - 6) / 2.0::DOUBLE + 3) AS BIGINT) AS tokens FROM lineitem")
def length_inverses(spark, d):
    return C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.max_segment_length(F.col("l_suppkey") % 90 + 3, 2, 6).alias("bases"), S.max_token_count(F.col("l_partkey") % 500 + 6, 2, 6).alias("tokens"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey % 90 AS p, l_partkey % 500 + 6 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(trunc((least(trunc((p + 1) / 2.0::DOUBLE), trunc((n - 6) / 2.0::DOUBLE + 1) - 1) + greatest(trunc((p + 1 - 6) / 2.0::DOUBLE), 0)) / 2.0::DOUBLE) AS INTEGER) AS place FROM t")
def token_position(spark, d):
    return C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.token_position(F.col("l_suppkey") % 90, F.col("l_partkey") % 500 + 6, 6, 2, 1).alias("place"))


_PLACES = "places AS (SELECT segment_id, segment, off, unnest(range(off, length(segment) - 5, 2)) AS i FROM segments, (SELECT unnest(range(0, 2)) AS off))"


@query(_with(SEGMENTS, _PLACES) + "SELECT segment_id, CAST(off AS INTEGER) AS \"offset\", list(substr(segment, i + 1, 6) ORDER BY i) AS tokens FROM places GROUP BY segment_id, off")
def tokenize_all(spark, d):
    rows = C.segments(spark, d).select("segment_id", F.posexplode(KmerTokenizer(6, 2).tokenize_all("segment")).alias("offset", "tokens"))
    return rows.where(F.size("tokens") > 0)


@query(_with(SEGMENTS, _PLACES) + "SELECT segment_id, CAST(off AS INTEGER) AS \"offset\", CAST((i - off) // 2 AS INTEGER) AS \"index\", substr(segment, i + 1, 6) AS kmer FROM places WHERE length(segment) // 2 >= i AND length(segment) // 2 < i + 6")
def positions_tokens_all(spark, d):
    found = C.segments(spark, d).select("segment_id", F.inline(S.tokens_at("segment", F.floor(F.length("segment") / 2), 6, 2)))
    return found.select("segment_id", "offset", F.inline("tokens"))


_IDS = _with(SEGMENTS, C.sql_tokens(6, 2), "ids AS (SELECT segment_id, list(CAST(id AS INTEGER) ORDER BY pos) AS x FROM toks GROUP BY segment_id)")


@query(_IDS + "SELECT segment_id, list_resize(list_concat(list_concat([2], x), [3]), 300, 0) AS input_ids, list_transform(range(0, 300), lambda i: CAST(0 AS INTEGER)) AS token_type_ids, list_transform(range(0, 300), lambda i: CAST(CASE WHEN i < len(x) + 2 THEN 1 ELSE 0 END AS INTEGER)) AS attention_mask FROM ids")
def encode_plus(spark, d):
    return C.segments(spark, d).select("segment_id", KmerTokenizer(6, 2).encode_plus("segment", pad_to=300).alias("e")).select("segment_id", "e.*")


@query(_IDS + ", b AS (SELECT i.segment_id, g.sequence_id, list_concat(list_concat([2], i.x[1:40]), [3]) AS x FROM ids i JOIN segments g ON g.segment_id = i.segment_id), w AS (SELECT sequence_id, max(len(x)) AS w FROM b GROUP BY sequence_id) SELECT b.segment_id, list_resize(b.x, w.w, 0) AS input_ids, list_transform(range(0, w.w), lambda i: CAST(0 AS INTEGER)) AS token_type_ids, list_transform(range(0, w.w), lambda i: CAST(CASE WHEN i < len(b.x) THEN 1 ELSE 0 END AS INTEGER)) AS attention_mask FROM b JOIN w ON w.sequence_id = b.sequence_id")
def lca_batches(spark, d):
    rows = LcaTokenizer(6, 2).batch_encode_plus(C.segments(spark, d), batch="sequence_id", max_length=42)
    return rows.select("segment_id", "input_ids", "token_type_ids", "attention_mask")


@query(_IDS + "SELECT segment_id, list_concat(list_concat(list_concat(list_concat([2], x[1:7]), [3]), x[8:]), [3]) AS input_ids, list_concat(list_transform(range(0, least(len(x), 7) + 2), lambda i: CAST(0 AS INTEGER)), list_transform(range(0, greatest(len(x) - 7, 0) + 1), lambda i: CAST(1 AS INTEGER))) AS token_type_ids FROM ids")
def sentence_pairs(spark, d):
    ids = S.kmer_ids("segment", 6, 2)
    rows = C.segments(spark, d).withColumn("x", ids).where(F.size("x") > 0)
    a, b = F.slice("x", 1, 7), F.slice("x", F.lit(8), F.size("x"))
    return rows.select("segment_id", S.with_specials(a, b).alias("input_ids"), S.pair_token_types(a, b).alias("token_type_ids"))


_BASE4 = "substr('ACGT', CAST(floor(i / 16) AS BIGINT) % 4 + 1, 1) || substr('ACGT', CAST(floor(i / 4) AS BIGINT) % 4 + 1, 1) || substr('ACGT', i % 4 + 1, 1)"


@query(f"SELECT CAST(i + 5 AS INTEGER) AS id, {_BASE4} AS token, CAST(i + 5 AS INTEGER) AS again FROM (SELECT unnest(range(0, 64)) AS i) UNION ALL SELECT * FROM (VALUES (0, '[PAD]', 0), (1, '[UNK]', 1), (2, '[CLS]', 2), (3, '[SEP]', 3), (4, '[MASK]', 4))")
def vocabulary(spark, d):
    t = LcaTokenizer(3, 1)
    return t.vocabulary(spark).select("id", t.id_to_token(F.col("id")).alias("token"), t.token_to_id(F.col("token")).alias("again"))


@query(f"WITH w AS (SELECT i, substr('ACGT*', CAST(floor(i / 25) AS BIGINT) % 5 + 1, 1) || substr('ACGT*', CAST(floor(i / 5) AS BIGINT) % 5 + 1, 1) || substr('ACGT*', i % 5 + 1, 1) AS kmer FROM (SELECT unnest(range(0, 125)) AS i)), v AS (SELECT {_BASE4} AS kmer FROM (SELECT unnest(range(0, 64)) AS i)) SELECT kmer FROM w EXCEPT SELECT kmer FROM v")
def starred_kmers(spark, d):
    return tokenize.generate_kmers(spark, 3, "ACGT*").select("kmer").subtract(tokenize.generate_kmers(spark, 3).select("kmer"))


@query(_with(SEGMENTS, "last AS (SELECT sequence_id, arg_max(segment, segment_start) AS segment FROM segments GROUP BY sequence_id)", "p AS (SELECT sequence_id, segment, off, unnest(range(off, length(segment) - 5, 2)) AS i FROM last, (SELECT unnest(range(0, 2)) AS off))", f"t AS (SELECT sequence_id, off, list(CAST({C.sql_id(6)} AS INTEGER) ORDER BY i) AS ids FROM p GROUP BY sequence_id, off)") + "SELECT l.sequence_id AS segment_id, CAST(o.off AS INTEGER) AS \"offset\", list_concat(list_concat([2], coalesce(t.ids, CAST([] AS INTEGER[]))), [3]) AS ids FROM last l CROSS JOIN (SELECT unnest(range(0, 2)) AS off) o LEFT JOIN t ON t.sequence_id = l.sequence_id AND t.off = o.off")
def last_of_repeated_ids(spark, d):
    rows = C.segments(spark, d).select(F.col("sequence_id").alias("segment_id"), "segment", F.col("segment_start").alias("position"))
    return tokenize.tokenize_segments(rows, KmerTokenizer(6, 2), unique=False)


# Masks and labels.


@query(
    _with(SEGMENTS, C.sql_tokens(6, 2), "g AS (SELECT t.segment_id, t.pos, t.id, count(*) OVER (PARTITION BY t.segment_id) AS n, (t.pos * 7 + t.segment_id) % 11 = 0 AS hit FROM toks t)", "m AS (SELECT *, hit OR (pos >= 1 AND pos < n - 1 AND bool_or(hit) OVER (PARTITION BY segment_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)) AS masked FROM g)")
    + "SELECT segment_id, list(masked ORDER BY pos) AS masked FROM m GROUP BY segment_id"
)
def mask_dilation(spark, d):
    rows = C.segments(spark, d).where(F.length("segment") >= 6).withColumn("ids", S.kmer_ids("segment", 6, 2))
    hits = F.transform("ids", lambda _, i: (i * 7 + F.col("segment_id")) % 11 == 0)
    return rows.select("segment_id", masking.dilate(hits, 2, 1).alias("masked"))


_BASES = "CASE WHEN abs(pos - trunc((least(trunc({b} / 2.0::DOUBLE), trunc((n - 6) / 2.0::DOUBLE + 1) - 1) + greatest(trunc(({b} - 6) / 2.0::DOUBLE), 0)) / 2.0::DOUBLE)) <= 2 THEN true ELSE false END"


@query(
    _with(SEGMENTS, C.sql_tokens(6, 2), "s AS (SELECT segment_id, length(segment) AS n FROM segments)", "w AS (SELECT segment_id, pos + 1 AS pos, id FROM toks UNION ALL SELECT segment_id, 0, 2 FROM s UNION ALL SELECT segment_id, CAST(trunc((n - 6) / 2.0::DOUBLE) AS BIGINT) + 2, 3 FROM s)", f"h AS (SELECT w.*, {_BASES.format(b='(w.segment_id % 5)')} OR {_BASES.format(b='(n - 3)')} AS hit FROM w JOIN s ON s.segment_id = w.segment_id)")
    + "SELECT segment_id AS sample_id, list(CAST(CASE WHEN hit THEN 4 ELSE id END AS INTEGER) ORDER BY pos) AS input_ids, list(CAST(CASE WHEN hit THEN id ELSE -100 END AS INTEGER) ORDER BY pos) AS labels, list(CAST(CASE WHEN hit OR id > 1 THEN 1 ELSE 0 END AS INTEGER) ORDER BY pos) AS attention_mask FROM h GROUP BY segment_id"
)
def mask_bases(spark, d):
    rows = C.segments(spark, d).select(F.col("segment_id").alias("sample_id"), F.col("segment").alias("sample_seq"), F.array(F.col("segment_id") % 5, (F.length("segment") - 3).cast("long")).alias("pos2mask"))
    return masking.mask_bases(rows, 6, 2, left=2, right=2, max_length=600).select("sample_id", "input_ids", "labels", "attention_mask")


# Joins and pooling.


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def one_to_one_join(spark, d):
    labels = C.table(spark, d, "labels").select("doc_id", "quality")
    return ranges.validated_left_join(C.table(spark, d, "documents").select("doc_id"), labels, ["doc_id"], "one_to_one").select("doc_id", "quality")


_EIGHT = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings), t AS (SELECT vec_id, k // 8 AS tok, k % 8 AS d, x FROM e)"


def _tokens_of_eight(spark, d) -> DataFrame:
    return C.table(spark, d, "embeddings").withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding"), t * 8 + 1, F.lit(8)))).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: ((F.col("vec_id") + t) % 3 != 0).cast("int")))


@query(f"WITH {_EIGHT} SELECT vec_id, CAST(d AS INTEGER) AS d, round(avg(x), 9) AS x FROM t WHERE (vec_id + tok) % 3 <> 0 GROUP BY vec_id, d")
def mean_pool_rows(spark, d):
    rows = _tokens_of_eight(spark, d).select("vec_id", F.posexplode(S.mean_pool("h", F.col("mask"))).alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 9).alias("x"))


@query(f"WITH {_EIGHT}, s AS (SELECT vec_id, tok, x AS score FROM t WHERE d = 0 AND (vec_id + tok) % 3 <> 0), w AS (SELECT vec_id, tok, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS w FROM s) SELECT t.vec_id, CAST(t.d AS INTEGER) AS d, round(sum(t.x * w.w), 9) AS x FROM t JOIN w ON w.vec_id = t.vec_id AND w.tok = t.tok GROUP BY t.vec_id, t.d")
def attention_pool(spark, d):
    rows = _tokens_of_eight(spark, d).withColumn("s", F.transform("h", lambda v: v[0]))
    rows = rows.select("vec_id", F.posexplode(S.attention_pool("h", "s", F.col("mask"))).alias("d", "x"))
    return rows.select("vec_id", "d", F.round("x", 9).alias("x"))


@query(
    "WITH c AS (SELECT DISTINCT label AS c FROM embeddings), s AS (SELECT c.c, CAST(e.embedding[c.c + 1] AS DOUBLE) AS s, e.label = c.c AS y FROM embeddings e, c), r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0::DOUBLE AS rk FROM s),"
    " a AS (SELECT c, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY c) SELECT round(avg(auc), 9) AS auc FROM a"
)
def auc_one_vs_rest(spark, d):
    rows = C.table(spark, d, "embeddings").withColumn("scores", F.col("embedding").cast("array<double>"))
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    picked = rows.withColumn("scores", F.array(*[F.col("scores")[c] for c in classes]))
    return predict.one_vs_rest_auc(picked, classes, "scores", "label").select(F.round("auc", 9).alias("auc"))


# Files: written to the shared folder and read again.


def _record_files(spark, d) -> str:
    """A file for each contig, by thousands in folders whose names sort as the contigs do."""
    at = shared_path(spark, "fasta")
    folder = F.format_string("r%09d", F.floor(F.col("sequence_id") / 1000))
    fasta.write_fasta_files(C.contigs(spark, d).select(F.format_string("r%09d", "sequence_id").alias("fasta_id"), "sequence", "sequence_id"), at, folder)
    return at


@query(_with(CONTIGS, "n AS (SELECT row_number() OVER (ORDER BY sequence_id) - 1 AS r, 'r' || lpad(CAST(sequence_id AS VARCHAR), 9, '0') AS name, sequence FROM contigs)") + "SELECT CAST(2 * r AS BIGINT) AS sequence_id, name AS fasta_id, name AS description, sequence, 'forward' AS orientation FROM n UNION ALL SELECT CAST(2 * r + 1 AS BIGINT), name, name, reverse(translate(sequence, 'ACGT', 'TGCA')), 'reverse' FROM n")
def load_contigs_files(spark, d):
    return fasta.load_contigs(spark, [_record_files(spark, d)]).drop("source_file")


@query(_with(CONTIGS) + "SELECT 'r' || lpad(CAST(sequence_id AS VARCHAR), 9, '0') || '.fasta' AS name FROM contigs")
def find_nucleotide_files(spark, d):
    return fasta.find_nucleotide_files(spark, _record_files(spark, d)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query(_with(CONTIGS) + "SELECT 'r' || lpad(CAST(sequence_id AS VARCHAR), 9, '0') || '.fasta' AS name FROM contigs")
def non_empty_files(spark, d):
    return fasta.non_empty_files(spark, _record_files(spark, d)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query(_IDS + "SELECT segment_id AS torch_id, list_resize(list_concat([2], x), 260, 0) AS input_ids FROM ids")
def training_table(spark, d):
    ids = S.kmer_ids("segment", 6, 2)
    rows = C.segments(spark, d).withColumn("x", ids).where(F.size("x") > 0)
    rows = rows.select(F.col("segment_id").alias("torch_id"), S.pad_ids(F.concat(F.array(F.lit(S.CLS)), "x"), 260).alias("input_ids"))
    at = shared_path(spark, "training")
    tables.save_training_table(rows, at)
    return tables.load_training_table(spark, at)


@query("SELECT vec_id, embedding FROM embeddings")
def saved_embeddings(spark, d):
    at = shared_path(spark, "embeddings")
    tables.save_embeddings(C.table(spark, d, "embeddings").select("vec_id", "embedding"), at)
    return spark.read.parquet(at)
