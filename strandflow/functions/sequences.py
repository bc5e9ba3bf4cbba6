"""Column functions over nucleotide strings and token arrays.  All stay inside Spark's JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special token ids and names, in order; k-mers follow from 5.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS, SEP, MASK = range(5)
# The IUPAC complement table, upper case then lower case.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def ints() -> Column:
    return F.array().cast("array<int>")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; U counts as T, case is kept, other characters stay."""
    return F.reverse(F.translate(col(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def normalize_sequence(seq: Column | str) -> Column:
    """Upper case, U as T, without white space."""
    return F.regexp_replace(F.translate(F.upper(col(seq)), "U", "T"), r"\s+", "")


def kmer_starts(length: Column, k: int, shift: int, offset: Column | int = 0) -> Column:
    """Start places of the k-mers of a segment of that length; empty if none fits."""
    first = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(length - k >= first, F.sequence(first.cast("int"), (length - k).cast("int"), F.lit(shift))).otherwise(ints())


def kmers(seq: Column | str, k: int, shift: int, offset: Column | int = 0) -> Column:
    """K-mers in order: cut from bytes where each sign is one, since in a string each cut would walk from the start."""

    def cut(s: Column) -> Column:
        starts = kmer_starts(F.length(s), k, shift, offset)
        plain = let(s.cast("binary"), lambda b: F.transform(starts, lambda i: F.substring(b, i + 1, F.lit(k)).cast("string")))
        return F.when(F.octet_length(s) == F.length(s), plain).otherwise(F.transform(starts, lambda i: F.substring(s, i + 1, F.lit(k))))

    return let(col(seq), cut)


def pieces(seq: Column | str, places: Column, make) -> Column:
    """``make(place, text)`` of each of ``places``, structs with ``start`` and ``end``; cut from bytes as :func:`kmers` are."""

    def cut(s: Column) -> Column:
        plain = let(s.cast("binary"), lambda b: F.transform(places, lambda p: make(p, F.substring(b, p["start"] + 1, p["end"] - p["start"]).cast("string"))))
        walked = F.transform(places, lambda p: make(p, F.substring(s, p["start"] + 1, p["end"] - p["start"])))
        return F.when(F.octet_length(s) == F.length(s), plain).otherwise(walked)

    return let(col(seq), cut)


def kmer_id(kmer: Column, *, star_is_mask: bool = False) -> Column:
    """Id of one k-mer: 5 and its rank in base 4 (A C G T); UNK otherwise.  Case counts."""
    known = (F.translate(kmer, "ACGT", "") == "") & (F.length(kmer) > 0)
    rank = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("int") + len(SPECIALS)
    out = F.when(known, rank)
    if star_is_mask:
        out = out.when(F.translate(kmer, "ACGT*", "") == "", F.lit(MASK))
    return out.otherwise(F.lit(UNK))


def kmer_ids(seq: Column | str, k: int, shift: int, offset: Column | int = 0) -> Column:
    """Ids of a segment's k-mers, translated once for the whole segment.

    Bases become base-4 digits in bytes, where cutting out a k-mer costs its own
    length; in a string it would cost a walk from the start.  A segment of known
    bases alone, the usual case, needs no check for each k-mer.
    """
    digits = F.regexp_replace(F.translate(col(seq), "0123ACGT", "....0123"), "[^0-3]", ".")

    def ids(s: Column) -> Column:
        starts = kmer_starts(F.length(s), k, shift, offset)
        cut = lambda i: F.substring(s, i + 1, F.lit(k)).cast("string")
        known = lambda i: F.conv(cut(i), 4, 10).cast("int") + len(SPECIALS)
        mixed = F.transform(starts, lambda i: F.when(F.contains(cut(i), F.lit(".")), F.lit(UNK)).otherwise(known(i)))
        return F.when(F.contains(s.cast("string"), F.lit(".")), mixed).otherwise(F.transform(starts, known))

    return let(F.encode(digits, "US-ASCII"), ids)


def encode_ids(
    seq: Column | str,
    k: int = 6,
    shift: int = 1,
    offset: Column | int = 0,
    *,
    max_unknown: float = 0.9999,
    token_limit: int = 4096,
    special: bool = True,
    n_run_known: bool = False,
    uppercase: bool = True,
) -> Column:
    """Token ids of one offset.

    More than ``int(n * max_unknown)`` unknown k-mers empty the sentence; an
    empty one is ``[CLS, SEP]`` (or nothing without specials).  A sentence that
    would not fit ``token_limit`` raises, specials counted either way.
    ``n_run_known``: a k-mer of N alone is UNK but not counted as unknown.
    """
    s = F.upper(col(seq)) if uppercase else col(seq)
    names = kmers(s, k, shift, offset) if n_run_known else None
    ids = kmer_ids(s, k, shift, offset)
    ends = (F.array(F.lit(CLS)), F.array(F.lit(SEP))) if special else (ints(), ints())

    def finish(x: Column) -> Column:
        unknown = F.size(F.filter(x, lambda i: i == UNK))
        if names is not None:
            runs = F.size(F.filter(names, lambda m: m == "N" * k))
            unknown = unknown - F.when(F.contains(s, F.lit("N" * k)), runs).otherwise(0)
        too_many = unknown > (F.size(x) * F.lit(float(max_unknown))).cast("int")
        body = F.when((F.size(x) == 0) | too_many, ints()).otherwise(x)
        too_long = F.raise_error(F.concat(F.lit("The expected sequence is longer than the limit of tokens: "), (F.size(x) + 2).cast("string")))
        return F.when(F.size(x) + 2 > token_limit, too_long.cast("array<int>")).otherwise(F.concat(ends[0], body, ends[1]))

    return let(ids, finish)


def id_to_kmer(token: Column, k: int) -> Column:
    """The k-mer or special token of an id."""
    special = F.element_at(F.array(*[F.lit(s) for s in SPECIALS]), token + 1)
    name = F.translate(F.lpad(F.conv((token - len(SPECIALS)).cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return F.when((token >= 0) & (token < len(SPECIALS)), special).when(token < len(SPECIALS) + 4**k, name)


def ids_to_tokens(ids: Column | str, k: int, shift: int) -> Column:
    """Strings that join to the decoded sequence: the first k-mer whole, then ``shift`` new bases of each; specials are skipped."""
    body = F.filter(col(ids), lambda i: i >= len(SPECIALS))
    return F.transform(body, lambda i, n: F.when(n == 0, id_to_kmer(i, k)).otherwise(F.right(id_to_kmer(i, k), F.lit(shift))))


def decode_ids(ids: Column | str, k: int, shift: int) -> Column:
    return F.array_join(ids_to_tokens(ids, k, shift), "")


def attention_mask(ids: Column | str, masked: tuple[int, ...] = (PAD, UNK)) -> Column:
    """1 where a token counts, 0 for the ids in ``masked``."""
    return F.transform(col(ids), lambda i: F.when(i.isin(*masked), 0).otherwise(1))


def training_mask(ids: Column | str, given: Column | None = None) -> Column:
    """Float mask of the classification data set: PAD and SEP are 0; a given mask overrides."""
    own = F.transform(col(ids), lambda i: F.when((i > SEP) | i.isin(UNK, CLS), 1.0).otherwise(0.0))
    return own if given is None else F.coalesce(given, own)


def token_type_ids(ids: Column | str) -> Column:
    return F.array_repeat(F.lit(0), F.size(col(ids)))


def with_specials(a: Column, b: Column | None = None) -> Column:
    """``[CLS] a [SEP]`` or ``[CLS] a [SEP] b [SEP]``."""
    parts = [F.array(F.lit(CLS)), a, F.array(F.lit(SEP))] + ([b, F.array(F.lit(SEP))] if b is not None else [])
    return F.concat(*parts)


def pair_token_types(a: Column, b: Column | None = None) -> Column:
    """Zeros over ``[CLS] a [SEP]``, then ones over ``b [SEP]``."""
    first = F.array_repeat(F.lit(0), F.size(a) + 2)
    return first if b is None else F.concat(first, F.array_repeat(F.lit(1), F.size(b) + 1))


def pad_ids(ids: Column | str, width: Column | int, pad: int = PAD) -> Column:
    w = F.lit(width) if isinstance(width, int) else width
    return let(col(ids), lambda x: F.concat(x, F.array_repeat(F.lit(pad), F.greatest(w - F.size(x), F.lit(0)))))


def truncate_ids(ids: Column | str, width: int) -> Column:
    """Keep ``[CLS]`` and ``[SEP]`` while the body is cut to fit ``width``."""
    return let(col(ids), lambda x: F.when(F.size(x) <= width, x).otherwise(F.concat(F.slice(x, F.lit(1), F.lit(max(0, width - 1))), F.slice(x, -1, 1))))


# Sizes and coordinates.


def max_segment_length(tokens: Column | int, shift: int, k: int) -> Column:
    return (F.lit(tokens) if isinstance(tokens, int) else tokens).cast("long") * shift - 3 * shift + k


def max_token_count(length: Column | int, shift: int, k: int) -> Column:
    return F.ceil(((F.lit(length) if isinstance(length, int) else length) - k) / F.lit(float(shift)) + 3)


def token_count(length: Column, k: int, shift: int) -> Column:
    return ((length - k) / F.lit(float(shift)) + 1).cast("int")


def token_span(position: Column, k: int, shift: int, offset: int = 0) -> Column:
    """Bases [start, end) that a token covers."""
    start = (position * shift + offset).cast("int")
    return F.struct(start.alias("seq_start"), (start + k).alias("seq_end"))


def covering_tokens(position: Column, length: Column, k: int, shift: int, offset: int = 0) -> Column:
    """Last and first token over a base (in that order, as callers expect), clamped to the segment."""
    last = F.least(((position + offset) / F.lit(float(shift))).cast("int"), token_count(length, k, shift) - 1)
    first = F.greatest(((position + offset - k) / F.lit(float(shift))).cast("int"), F.lit(0))
    return F.struct(last.alias("token_start"), first.alias("token_end"))


def token_position(position: Column, length: Column, k: int, shift: int, offset: int = 0) -> Column:
    """The middle token over a base."""
    return let(covering_tokens(position, length, k, shift, offset), lambda t: ((t["token_start"] + t["token_end"]) / F.lit(2.0)).cast("int"))


def tokens_at(seq: Column | str, position: Column, k: int, shift: int) -> Column:
    """For each offset with any: the k-mers over a base and their places; only those are cut."""
    none, s = "array<struct<index:int,kmer:string>>", col(seq)

    def at(o: int, t: Column) -> Column:
        first = F.greatest(F.ceil((position - (o + k - 1)) / F.lit(float(shift))), F.lit(0)).cast("int")
        last = F.floor(F.least(position - o, F.length(t) - k - o) / F.lit(float(shift))).cast("int")
        over = F.transform(F.sequence(first, last, F.lit(1)), lambda i: F.struct(i.alias("index"), F.substring(t, i * shift + (o + 1), F.lit(k)).alias("kmer")))
        return F.struct(F.lit(o).alias("offset"), F.when(last >= first, over).otherwise(F.array().cast(none)).alias("tokens"))

    inside = let(s, lambda t: F.filter(F.array(*[at(o, t) for o in range(shift)]), lambda x: F.size(x["tokens"]) > 0))
    return F.when((position >= 0) & (position < F.length(s)), inside).otherwise(F.raise_error(F.lit("Position lies outside the sequence")).cast("array<struct<offset:int,tokens:array<struct<index:int,kmer:string>>>>"))


def pretty_overlap(seq: Column | str, names: Column, k: int, shift: int) -> Column:
    """The segment over its k-mers, dealt to as many lines as keep them apart."""
    lines = -(-(k + 2) // shift)
    indent = len(str(int((k + 3) / shift))) + 3

    def line(x: Column, n: int) -> Column:
        return F.concat(F.lit(f"{n}.  " + " " * (n * shift)), F.array_join(F.filter(x, lambda _, i: i % lines == n), "  "))

    return let(names, lambda x: F.array_join(F.array(F.concat(F.lit(" " * indent), col(seq)), *[line(x, n) for n in range(lines)]), "\n"))


# Numeric arrays.


def sliding_mean(values: Column | str, window: int = 6) -> Column:
    """Means of ``window`` values in a row; of fewer values than that, the roles swap as in a full-overlap convolution."""
    v = col(values)

    def mean(x: Column) -> Column:
        n = F.size(x)
        w = F.least(n, F.lit(window))
        m = F.greatest(n, F.lit(window))
        long = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.aggregate(F.slice(x, i + 1, F.lit(window)), F.lit(0.0), lambda a, y: a + y) / window)
        short = F.transform(F.sequence(F.lit(0), m - w), lambda _: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / window)
        return F.when(n == 0, F.array().cast("array<double>")).when(n >= window, long).otherwise(short)

    return let(v.cast("array<double>"), mean)


def convolve_stride(values: Column | str, window: int = 6, step: int = 2) -> Column:
    """Uniform filter with reflected edges, then every ``step``-th value.

    An even window reaches one place further right than left, as a convolution
    shifts its origin.  The array must not be shorter than half the window.
    """
    before, after = (window - 1) // 2, window // 2

    def run(x: Column) -> Column:
        n = F.size(x)
        padded = F.concat(F.reverse(F.slice(x, F.lit(1), F.lit(before))) if before else F.array().cast("array<double>"), x, F.reverse(F.slice(x, n - after + 1, F.lit(after))) if after else F.array().cast("array<double>"))
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: i % step == 0)
        return let(padded, lambda p: F.transform(places, lambda i: F.aggregate(F.slice(p, i + 1, F.lit(window)), F.lit(0.0), lambda a, y: a + y) / window))

    return F.when(F.size(col(values)) == 0, F.array().cast("array<double>")).otherwise(let(col(values).cast("array<double>"), run))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(values: Column | str, epsilon: float = 1e-12) -> Column:
    """The vector over its length, or over ``epsilon`` if that is more."""
    v = col(values).cast("array<double>")
    return let(v, lambda x: let(F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)), F.lit(epsilon)), lambda n: F.transform(x, lambda y: y / n)))


def softmax(values: Column | str) -> Column:
    def run(x: Column) -> Column:
        return let(F.array_max(x), lambda m: let(F.transform(x, lambda y: F.exp(y - m)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda s: F.transform(e, lambda y: y / s))))

    return let(col(values).cast("array<double>"), run)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(values: Column | str) -> Column:
    """Place (from 0) of the first largest value."""
    v = col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_k(values: Column | str, k: int) -> Column:
    """The ``k`` largest values with their places, largest first, ties by place."""
    pairs = F.transform(col(values).cast("array<double>"), lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["index"].alias("index"), (-p["neg"]).alias("value")))


def mean_pool(hidden: Column | str, mask: Column | None = None) -> Column:
    """Mean of token vectors, over the tokens that the mask keeps (at least one counts)."""
    h = col(hidden).cast("array<array<double>>")
    kept = h if mask is None else F.transform(F.filter(F.zip_with(h, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda z: z["m"] > 0), lambda z: z["v"])
    return let(kept, lambda x: let(F.greatest(F.size(x), F.lit(1)), lambda n: F.transform(F.sequence(F.lit(0), F.size(h[0]) - 1), lambda d: F.aggregate(F.transform(x, lambda v: v[d]), F.lit(0.0), lambda a, y: a + y) / n)))


def normalize_attention_mask(mask: Column | str) -> Column:
    """Keep flags from booleans, 0/1 or additive masks (negative: dropped, with no positive one)."""
    m = col(mask).cast("array<double>")
    return let(m, lambda x: F.when(F.exists(x, lambda y: y < 0), F.transform(x, lambda y: (y >= 0).cast("int"))).otherwise(F.transform(x, lambda y: (y > 0).cast("int"))))


def attention_pool(hidden: Column | str, scores: Column | str, mask: Column | None = None) -> Column:
    """Token vectors weighted by the softmax of their scores over kept tokens; a row with none keeps its first."""
    h, s = col(hidden).cast("array<array<double>>"), col(scores).cast("array<double>")
    m = F.transform(s, lambda _: F.lit(1)) if mask is None else normalize_attention_mask(mask)
    keep = let(m, lambda x: F.when(F.exists(x, lambda y: y > 0), x).otherwise(F.transform(x, lambda _, i: (i == 0).cast("int"))))
    weights = softmax(F.zip_with(s, keep, lambda y, z: F.when(z > 0, y).otherwise(F.lit(float("-inf")))))
    return let(weights, lambda w: F.transform(F.sequence(F.lit(0), F.size(h[0]) - 1), lambda d: F.aggregate(F.zip_with(h, w, lambda v, y: v[d] * y), F.lit(0.0), lambda a, y: a + y)))
