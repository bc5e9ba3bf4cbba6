"""Tokenization of segment tables and rectangular training tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import tokenization_parameters
from ..functions import sequences as S
from ..staging import stage
from .checks import is_valid_primary_key
from .numbering import dense_rows, uniform


@dataclass(frozen=True)
class KmerTokenizer:
    """Overlapping k-mer tokenizer: column expressions for one setting.

    ``space`` is ``sequence`` (decoding joins overlaps; a k-mer of N alone is
    known) or ``kmer`` (tokens stay k-mers).
    """

    kmer: int = 6
    shift: int = 1
    max_segment_length: int = 2050
    token_limit: int = 4096
    max_unknown: float = 0.9999
    special: bool = True
    space: str = "sequence"

    @classmethod
    def from_params(cls, params: dict | None = None, space: str = "sequence") -> KmerTokenizer:
        p = tokenization_parameters(params or {})
        return cls(p["kmer"], p["shift"], p["max_segment_length"], p["token_limit"], p["max_unknown_token_proportion"], p["add_special_token"], space)

    def __post_init__(self) -> None:
        if self.space not in ("sequence", "kmer"):
            raise ValueError(f"The operation space is sequence or kmer, not {self.space}")

    def __len__(self) -> int:
        """Bound for random replacement ids."""
        return len(S.SPECIALS) + 4**self.kmer - (self.space == "kmer")

    def _guard(self, seq: Column) -> Column:
        text = F.concat(F.lit("The segment is longer than the maximum of "), F.lit(str(self.max_segment_length)))
        return F.when(F.length(seq) > self.max_segment_length, F.raise_error(text).cast("string")).otherwise(seq)

    def tokenize(self, seq: Column | str, offset: int | Column = 0) -> Column:
        return S.kmers(self._guard(F.upper(S.col(seq))), self.kmer, self.shift, offset)

    def tokenize_all(self, seq: Column | str) -> Column:
        return F.array(*[self.tokenize(seq, o) for o in range(self.shift)])

    def encode(self, seq: Column | str, offset: int | Column = 0, *, special: bool | None = None) -> Column:
        """Ids of one offset; ``special=False`` gives the sentence without its ends."""
        if isinstance(offset, int) and not 0 <= offset < self.shift:
            raise ValueError(f"The offset must lie between 0 and {self.shift - 1}")
        return S.encode_ids(self._guard(S.col(seq)), self.kmer, self.shift, offset, max_unknown=self.max_unknown, token_limit=self.token_limit, special=self.special if special is None else special, n_run_known=self.space == "sequence")

    def encode_all(self, seq: Column | str) -> Column:
        return F.array(*[self.encode(seq, o) for o in range(self.shift)])

    def encode_plus(self, seq: Column | str, offset: int = 0, pad_to: int | None = None) -> Column:
        """Struct of ``input_ids``, ``token_type_ids`` and ``attention_mask``."""
        ids = self.encode(seq, offset)
        ids = ids if pad_to is None else S.pad_ids(ids, pad_to)
        return S.let(ids, lambda x: F.struct(x.alias("input_ids"), S.token_type_ids(x).alias("token_type_ids"), S.attention_mask(x).alias("attention_mask")))

    def decode(self, ids: Column | str) -> Column:
        if self.space == "kmer":
            return F.array_join(F.transform(S.col(ids), lambda i: S.id_to_kmer(i, self.kmer)), "")
        return S.decode_ids(ids, self.kmer, self.shift)

    def ids_to_tokens(self, ids: Column | str) -> Column:
        if self.space == "kmer":
            return F.transform(S.col(ids), lambda i: S.id_to_kmer(i, self.kmer))
        return S.ids_to_tokens(ids, self.kmer, self.shift)

    def positions_tokens(self, seq: Column | str, position: Column) -> Column:
        return S.tokens_at(F.upper(S.col(seq)), position, self.kmer, self.shift)

    def token_to_id(self, token: Column) -> Column:
        known = F.element_at(F.create_map(*[x for i, s in enumerate(S.SPECIALS) for x in (F.lit(s), F.lit(i))]), token)
        return F.coalesce(known, S.kmer_id(token))

    def id_to_token(self, token: Column) -> Column:
        return F.coalesce(S.id_to_kmer(token, self.kmer), F.lit("[UNK]"))


@dataclass(frozen=True)
class LcaTokenizer:
    """The plain variant: case counts, no unknown threshold and no length guard; ``*`` k-mers are masks in sequence space."""

    kmer: int = 6
    shift: int = 1
    space: str = "kmer"

    def __len__(self) -> int:
        return len(S.SPECIALS) + 4**self.kmer

    @property
    def vocab_size(self) -> int:
        return len(self)

    def vocabulary(self, spark) -> DataFrame:
        return vocabulary(spark, self.kmer)

    def token_to_id(self, token: Column) -> Column:
        return KmerTokenizer(self.kmer, self.shift).token_to_id(token)

    def id_to_token(self, token: Column) -> Column:
        return KmerTokenizer(self.kmer, self.shift).id_to_token(token)

    def tokenize(self, seq: Column | str, offset: int = 0) -> Column:
        return S.kmers(seq, self.kmer, self.shift, offset)

    def encode(self, seq: Column | str, offset: int = 0, *, special: bool = True, max_length: int | None = None) -> Column:
        ids = F.transform(self.tokenize(seq, offset), lambda m: S.kmer_id(m, star_is_mask=self.space == "sequence"))
        if max_length is not None:
            ids = F.slice(ids, 1, max_length - 2 * special)
        return S.with_specials(ids) if special else ids

    def batch_encode_plus(self, df: DataFrame, sequence: str = "segment", batch: str | None = None, *, special: bool = True, max_length: int | None = None, pad_to: int | None = None) -> DataFrame:
        """``df`` with ``input_ids``, ``token_type_ids`` and ``attention_mask``, padded as :func:`padded` has it."""
        return padded(df.withColumn("input_ids", self.encode(sequence, special=special, max_length=max_length)), batch, pad_to)


def padded(rows: DataFrame, batch: str | None = None, pad_to: int | None = None) -> DataFrame:
    """``rows`` with ``input_ids`` padded to ``pad_to``, or to the longest row of each ``batch``, and their masks and types."""
    from pyspark.sql import Window

    width = F.lit(pad_to) if pad_to is not None else F.max(F.size("input_ids")).over(Window.partitionBy(batch)) if batch else F.size("input_ids")
    rows = rows.withColumn("_n", F.size("input_ids")).withColumn("input_ids", S.pad_ids("input_ids", width))
    kept = F.transform("input_ids", lambda _, i: F.when(i < F.col("_n"), 1).otherwise(0))
    return rows.withColumns({"token_type_ids": S.token_type_ids("input_ids"), "attention_mask": kept}).drop("_n")


def vocabulary(spark, k: int) -> DataFrame:
    """``(id, token)``: the specials, then all k-mers in lexicographic order."""
    special = spark.createDataFrame(list(enumerate(S.SPECIALS)), "id int, token string")
    return special.unionByName(spark.range(4**k).select((F.col("id") + len(S.SPECIALS)).cast("int").alias("id")).withColumn("token", S.id_to_kmer(F.col("id"), k)))


def generate_kmers(spark, k: int, alphabet: str = "ACGT") -> DataFrame:
    """All words of length ``k`` over an alphabet, in its order."""
    n = len(alphabet)
    place = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(F.lit(alphabet), F.pmod(F.floor(F.col("id") / F.pow(F.lit(n), k - 1 - i)), F.lit(n)).cast("int") + 1, F.lit(1))), "")
    return spark.range(n**k).select("id", place.alias("kmer"))


def load_vocabulary(spark, path: str) -> DataFrame:
    """``(id, token)`` of a vocabulary file: the line number from 0 is the id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("id", "token"))
    return lines


def tokenize_segments(segments: DataFrame, tokenizer: KmerTokenizer | None = None, *, unique: bool = True, check: bool = True) -> DataFrame:
    """``(segment_id, offset, ids)``: a row for each segment and offset.

    Ids are checked to be unique by a job of their own; ``check=False`` leaves
    that out for segments numbered by :func:`.segment.segment_sequences`.  With ``unique=False`` repeated ids keep their last row by ``position``.
    """
    t = tokenizer or KmerTokenizer()
    if not unique:
        segments = segments.groupBy("segment_id").agg(F.max_by("segment", "position").alias("segment"))
    elif check and not is_valid_primary_key(segments, "segment_id"):
        raise ValueError("segment_id must be unique and not null")
    return segments.select("segment_id", F.posexplode(t.encode_all("segment")).alias("offset", "ids"))


def max_width(tokens: DataFrame, ids: str = "ids") -> int:
    """Most ids in a row up to its last one that is not padding."""
    last = F.array_max(F.transform(F.col(ids), lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return int(tokens.agg(F.coalesce(F.max(last), F.lit(0))).first()[0])


def rectangular(tokens: DataFrame, max_token_count: int, *, randomize: bool = False, truncate_zeros: bool = True, seed: int = 42) -> DataFrame:
    """``(torch_id, segment_id, offset, input_ids)``, padded to one width, and ``original_torch_id`` if permuted.

    Rows are numbered by segment and offset, or by a hash of that number when
    ``randomize``.  Columns that are padding throughout are dropped.  A row
    longer than ``max_token_count`` raises.
    """
    rows = dense_rows(tokens, "segment_id", ["offset"], "torch_id")
    fits = F.when(F.size("ids") > max_token_count, F.raise_error(F.lit("A token vector is longer than the maximum token count")).cast("array<int>")).otherwise(F.col("ids"))
    width = min(max_token_count, max_width(tokens)) if truncate_zeros else max_token_count
    rows = rows.select("torch_id", "segment_id", "offset", F.slice(S.pad_ids(fits, max_token_count), F.lit(1), F.lit(width)).alias("input_ids"))
    return permuted(rows, seed) if randomize else rows


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """Rows numbered by a hash of their ``torch_id``, which is kept as ``original_torch_id``."""
    span = 1 << 20
    keyed = rows.withColumnRenamed("torch_id", "original_torch_id").withColumn("_key", F.floor(uniform(seed, F.col("original_torch_id")) * span).cast("long"))
    return dense_rows(keyed, "_key", ["original_torch_id"], "torch_id", block=64).drop("_key")


def most_tokens(t: KmerTokenizer) -> Column:
    """Most ids that an offset of ``segment`` gives: by its length, and by its ids only where it holds unknown bases."""
    known = F.translate(F.upper("segment"), "ACGT", "") == ""
    count = F.greatest(F.floor((F.length("segment") - t.kmer) / F.lit(float(t.shift))) + 1, F.lit(0)).cast("int") + 2 * t.special
    return F.when(known, count).otherwise(F.array_max(F.transform(t.encode_all("segment"), lambda x: F.size(x))))


def rectangular_segments(segments: DataFrame, tokenizer: KmerTokenizer | None = None, max_token_count: int | None = None) -> DataFrame:
    """``(torch_id, segment_id, offset, input_ids)`` straight from segments, with what :func:`rectangular` gives for their tokens.

    Segments must be numbered densely from 0, as :func:`.segment.segment_sequences`
    does it: then a row's number is ``segment_id * shift + offset``, the width
    follows from the longest segment, and no tokens are shuffled or made twice.
    Only where a segment holds unknown bases, whose sentence may come out empty,
    is its width taken from its ids.
    """
    t = tokenizer or KmerTokenizer()
    most = max_token_count or t.token_limit
    width = min(most, int(segments.agg(F.coalesce(F.max(most_tokens(t)), F.lit(0))).first()[0]))
    too_long = F.raise_error(F.lit("A token vector is longer than the maximum token count")).cast("array<int>")
    rows = segments.select("segment_id", F.posexplode(t.encode_all("segment")).alias("offset", "ids"))
    return rows.select((F.col("segment_id") * t.shift + F.col("offset")).cast("long").alias("torch_id"), "segment_id", "offset", F.when(F.size("ids") > most, too_long).otherwise(S.pad_ids("ids", width)).alias("input_ids"))


def truncate_zero_columns(rows: DataFrame, ids: str = "input_ids") -> DataFrame:
    return rows.withColumn(ids, F.slice(F.col(ids), F.lit(1), F.lit(max_width(rows, ids))))


def classification_table(segments: DataFrame, tokenizer: KmerTokenizer, length: int | None = None, *, randomize: bool = True, seed: int = 42) -> DataFrame:
    """Rectangular tokens, as :func:`rectangular` has them, with the segments' labels ``y`` (and ``label``).

    Rows are checked, numbered and permuted by a staged table of ids and sizes;
    segments meet their numbers once, and only then become tokens.
    """
    most = length + 2 if length else tokenizer.token_limit
    keys = stage(segments.select("segment_id", most_tokens(tokenizer).alias("_size")), "sizes")
    if not is_valid_primary_key(keys, "segment_id"):
        raise ValueError("segment_id must be unique and not null")
    width = min(most, int(keys.agg(F.coalesce(F.max("_size"), F.lit(0))).first()[0]))
    rows = dense_rows(keys.select("segment_id"), "segment_id", [], "_n").select("segment_id", "_n", F.explode(F.sequence(F.lit(0), F.lit(tokenizer.shift - 1))).alias("offset"))
    rows = rows.select("segment_id", "offset", (F.col("_n") * tokenizer.shift + F.col("offset")).alias("torch_id"))
    if randomize:
        rows = permuted(stage(rows, "rows"), seed)
    labels = [c for c in ("y", "label") if c in segments.columns]
    out = rows.join(segments.select("segment_id", "segment", *labels), "segment_id")
    ids = tokenizer.encode("segment", F.col("offset"))
    too_long = F.raise_error(F.lit("A token vector is longer than the maximum token count")).cast("array<int>")
    ids = S.let(ids, lambda x: F.when(F.size(x) > most, too_long).otherwise(S.pad_ids(x, width)))
    numbers = ["original_torch_id"] if randomize else []
    return out.select("segment_id", *numbers, "offset", ids.alias("input_ids"), "torch_id", *labels)


#: Encoders by a part of a model's name; add more with :func:`register_encoder`.  Only this package's own k-mer encoder
#: is there from the start: models of other families have other tokens, so their names raise until one is registered.
ENCODERS: dict[str, object] = {}


def register_encoder(part: str, make) -> None:
    ENCODERS[part] = make


def encoder_for(model_name: str):
    """The registered function ``(df, **options) -> df`` whose part occurs in the name."""
    for part, make in ENCODERS.items():
        if part.lower() in model_name.lower():
            return make
    raise ValueError(f"No encoder is registered for {model_name}")


def encode_batch(df: DataFrame, tokenizer: KmerTokenizer, batch: str | None = None, label: str = "y", max_length: int | None = None) -> DataFrame:
    """Batches padded to their longest row, with token types; ends count as masked; ``labels`` are longs."""
    ids = tokenizer.encode("segment")
    ids = S.truncate_ids(ids, max_length) if max_length else ids
    rows = padded(df.withColumn("input_ids", ids), batch)
    rows = rows.withColumn("attention_mask", S.attention_mask("input_ids", (S.PAD, S.UNK, S.CLS, S.SEP)))
    return rows.withColumn("labels", F.col(label).cast("long")) if label in df.columns else rows


register_encoder("kmer", encode_batch)
