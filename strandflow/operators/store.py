"""Token stores: length-proportional draws and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..staging import stage
from .numbering import cumulative, dense_rows, first_seen_codes, uniform
from .ranges import interval_join


#: Bytes of drawn rows that a join may broadcast.
BROADCAST_BYTES = 16 << 20


def token_length(store: DataFrame) -> Column:
    """A contig's number of tokens: the store's ``length_tok`` where it has that, so that no tokens are read."""
    return (F.col("length_tok") if "length_tok" in store.columns else F.size("tokens")).cast("long")


def contig_metadata(store: DataFrame, item_bytes: int = 2) -> DataFrame:
    """Catalogue of a store ``(cid, accession, shard_id, tokens)``: places in its shard and file names."""
    from pyspark.sql import Window

    size = token_length(store)
    before = Window.partitionBy("shard_id").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    out = store.select("cid", "accession", "shard_id", size.alias("length_tok"))
    out = out.withColumn("offset_tok", F.coalesce(F.sum("length_tok").over(before), F.lit(0)))
    return out.withColumn("offset_bytes", F.col("offset_tok") * item_bytes).withColumn("shard_file", F.format_string("tokens.%03d.bin", F.col("shard_id").cast("int")))


def shards_info(store: DataFrame) -> DataFrame:
    return store.groupBy("shard_id").agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum(token_length(store)), F.lit(0)).alias("n_tokens"))


def window_at(tokens: Column | str, start: Column, length: int, pad: int = 0) -> Column:
    """``length`` tokens from ``start``, moved into the contig; a short contig comes whole, padded."""
    t = S.col(tokens)
    first = F.greatest(F.lit(0), F.least(start.cast("int"), F.size(t) - length))
    return S.pad_ids(F.when(F.size(t) <= length, t).otherwise(F.slice(t, first + 1, F.lit(length))), length, pad)


def window_by_accession(store: DataFrame, asked: DataFrame, length: int, pad: int = 0) -> DataFrame:
    """Windows for rows ``(accession, start)``; unknown accessions raise."""
    found = asked.join(store.select("accession", "cid", "tokens"), "accession", "left")
    tokens = F.when(F.col("cid").isNull(), F.raise_error(F.concat(F.lit("Unknown accession: "), F.col("accession"))).cast("array<int>")).otherwise(F.col("tokens"))
    return found.select(*asked.columns, window_at(tokens, F.col("start"), length, pad).alias("window"))


def draw_pairs(store: DataFrame, length: int, k: int, seed: int = 1337, by_shard: bool = False) -> DataFrame:
    """``k`` draws ``(draw_id, cid, start, l_eff)``: contigs by their length, starts uniform in each.

    Only lengths are read, once, and staged.  ``by_shard`` numbers
    the draws in the order of shards and places, as readers of sharded files
    want them.
    """
    spans = stage(store.select("cid", "shard_id" if by_shard else F.lit(0).alias("shard_id"), token_length(store).alias("length")), "lengths").where("length > 0")
    total = spans.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if not total:
        raise ValueError("No contig has tokens")
    ends = cumulative(spans, "cid", "length", "high").withColumn("low", F.col("high") - F.col("length"))
    draws = store.sparkSession.range(k).select(F.col("id").alias("draw_id"), F.floor(uniform(seed, 1, F.col("id")) * total).cast("long").alias("place"))
    hits = interval_join(draws, "place", ends, "low", "high", width=max(1, total // max(1, k)) * 64)
    start = F.floor(uniform(seed, 2, F.col("draw_id")) * (F.greatest(F.col("length") - length, F.lit(0)) + 1)).cast("int")
    out = hits.select("draw_id", "cid", "shard_id", start.alias("start"), F.least(F.col("length"), F.lit(length)).cast("int").alias("l_eff"))
    if by_shard:
        out = dense_rows(out, "shard_id", ["cid", "start", "draw_id"], "_n", block=1).drop("draw_id").withColumnRenamed("_n", "draw_id")
    return out.select("draw_id", "cid", "start", "l_eff")


def _drawn(store: DataFrame, draws: DataFrame, k: int, *columns: str) -> DataFrame:
    """``columns`` and tokens of the store's drawn contigs beside their draws.

    The draws are staged, as they are met twice: first by a semi-join that passes
    below the store's columns, so tokens that are made on the way are made for
    drawn contigs alone.
    """
    draws = stage(draws, "draws")
    small = (lambda x: F.broadcast(x)) if k * 48 <= BROADCAST_BYTES else (lambda x: x)
    return store.join(small(draws.select("cid").distinct()), "cid", "left_semi").select("cid", "tokens", *columns).join(small(draws), "cid")


def draw_windows(store: DataFrame, length: int, k: int, seed: int = 1337, pad: int = 0, by_shard: bool = False) -> DataFrame:
    """``(draw_id, cid, start, l_eff, window)``: the draws meet one scan of the store.

    Draws of a bounded size are broadcast, so tokens are never shuffled; of more
    a store bucketed by ``cid`` is joined without a shuffle of its tokens.
    """
    draws = draw_pairs(store, length, k, seed, by_shard)
    return _drawn(store, draws, k).select("draw_id", "cid", "start", "l_eff", window_at("tokens", F.col("start"), length, pad).alias("window"))


def sample_catalogue(store: DataFrame, draws: DataFrame, length: int) -> DataFrame:
    """Draws with their contig's facts; windows beyond the end are moved left."""
    meta = contig_metadata(store).select("cid", "accession", "shard_id", "shard_file", F.col("length_tok").alias("contig_len"))
    out = draws.drop("l_eff").join(meta, "cid").withColumn("l_req", F.lit(length)).withColumn("l_eff", F.least("contig_len", F.lit(length)).cast("int"))
    out = out.withColumn("start", F.greatest(F.lit(0), F.least(F.col("start"), F.col("contig_len") - F.col("l_eff"))).cast("int"))
    return out.withColumn("end", F.col("start") + F.col("l_eff"))


def labelled_windows(store: DataFrame, assemblies: DataFrame, length: int, k: int, seed: int = 1337) -> DataFrame:
    """Drawn windows with masks and the dense code of their contig's assembly.

    ``assemblies`` has ``(accession_id, assembly_id, pos)``; an accession's second
    field between bars is its id; codes follow the first appearance by ``pos``.
    """
    coded = first_seen_codes(assemblies, "assembly_id", "pos", "label").select("accession_id", "assembly_id", "label")
    draws = draw_pairs(store, length, k, seed)
    drawn = _drawn(store, draws, k, "accession").select("draw_id", "cid", "start", "l_eff", window_at("tokens", F.col("start"), length).alias("window"), "accession")
    keyed = drawn.withColumn("accession_id", F.coalesce(F.split("accession", r"\|")[1], F.col("accession")))
    return keyed.join(coded, "accession_id", "left").withColumn("attention_mask", S.attention_mask("window", (S.PAD, S.UNK, S.CLS, S.SEP)))


def cyclic_scan(rows: DataFrame, offset: int = 0, iterations: int = 1, *, end_token: bool = False, ids: str = "input_ids") -> DataFrame:
    """All rows from ``offset`` on and round again, ``iterations`` times over, in the order of ``(iteration, place)``."""
    n = rows.count()
    out = rows.crossJoin(rows.sparkSession.range(iterations).withColumnRenamed("id", "iteration")).withColumn("place", F.pmod(F.col("torch_id") - offset, F.lit(max(1, n))))
    return out.withColumn(ids, F.array_append(F.col(ids), S.SEP)) if end_token else out


def row_slice(rows: DataFrame, start: int, stop: int, key: str = "torch_id") -> DataFrame:
    return rows.where((F.col(key) >= start) & (F.col(key) < stop))
