"""Operator 4: benchmark decontamination by template windows.

Words are lower-cased and stripped of signs.  In an item numbers, units after a
number and names become typed slots, other words stay literal; windows of five
words are hash-joined with the documents' windows that have the same literal
words and words of the right kinds in the slots.  A document's windows on an item
then share one map from the item's slot values to the document's
(:func:`agreement`): windows that part from it drop out, and what is left must
cover the item.  That finds items copied whole and items asked again with other
numbers or names.

Document windows are sifted before the join by a filter of :data:`FILTER` bits
over the benchmark's window hashes; its size is the same for every benchmark,
and what it lets through by chance falls to the join.

What is a name can't be told from one word, so an item is read in up to four
ways, each with windows of its own (:data:`READINGS`).  A document gives an item
away if it does so by one of them.  The last has no slots, so that a verbatim copy is found
whatever its words are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, stage

WINDOW = 5
COVERAGE = 0.8
#: Words of a window that must not be placeholders.
LITERALS = 3
#: Bits of the filter over window hashes that every task holds, as a power of two.
FILTER = 25
#: Words handled at once: of several texts, or of a part of a long one.
BLOCK = 1 << 17
#: Words remembered by one worker at most; then it starts anew.
MEMORY = 300_000

# Words that are units after a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hour hours day days week weeks year years minute minutes second seconds meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms pound pounds dollar dollars euro euros cent cents percent liter liters litre litres degree degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(%|[a-zA-Z]{1,3})?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Words that are no names though they open a sentence in title case.
OPENERS = frozenset("a about after all also although an and another any are as at because before both but by can could did do does during each either every few first for from had has have he her here his how i if in is it its last let many may more most my neither next no not now of on once one only or our out over second she should since so some such than that the their then there these they this those though through to two under until up was we well were what when where whether which while who whom whose why will with would yet you your".split())
#: Kinds of words; a document's word may be of several, an item's slot is of one.
NUMBER, NAME, UNIT = 1, 2, 4
#: Ways to read an item: names within sentences; names at their starts as well; names as literal words; all words literal.
READINGS = ("inner names", "all names", "literal names", "words")


def _digest(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


class Canon(dict):
    """Words to rows of facts about them; what a word is alone is remembered."""

    def __init__(self) -> None:
        self.core: list[str] = []
        self.literal = np.zeros(1 << 16, np.uint64)
        self.fact = np.zeros((6, 1 << 16), bool)  # kept, number, name-like, ends a sentence, unit, capitalised

    def __missing__(self, word: str) -> int:
        core = word if word.isalnum() else _EDGE.sub("", word)
        low = core.lower()
        self[word] = i = len(self.core)
        if i == len(self.literal):
            self.literal = np.concatenate([self.literal, np.zeros_like(self.literal)])
            self.fact = np.concatenate([self.fact, np.zeros_like(self.fact)], axis=1)
        self.core.append(low)
        self.literal[i] = _digest(low)
        plain = core.isalpha()
        title = len(core) > 1 and core[0].isupper() and core[1:].islower()
        self.fact[:, i] = bool(core), not plain and bool(_NUMBER.fullmatch(core)), title, word[-1] in ".!?:;", plain and low in UNITS, title or len(core) > 1 and core.isupper()
        return i

    def tokens(self, words: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the kept words: which they are, their rows, and whether they are numbers and units after a number.

        ``starts`` are the places where texts begin.
        """
        if len(self) > MEMORY:
            self.clear()
            self.__init__()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(self.fact[0][ids])
        first = np.zeros(len(words) + 1, bool)
        first[starts] = True
        opens = np.diff(np.concatenate(([0], np.cumsum(first[:-1])[at]))) > 0  # a kept word that is the first of its text
        ids = ids[at]
        number, unit = self.fact[1][ids], self.fact[4][ids]
        unit[:1] = False
        unit[1:] &= number[:-1] & ~opens[1:]
        return at, ids, number, unit

    def readings(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """An item's kept words, and for each of :data:`READINGS` their kinds (0: literal)."""
        at, ids, number, unit = self.tokens(words, np.array([0]))
        ends = np.fromiter((w[-1] in ".!?:;" for w in words), bool, len(words))
        opening = np.concatenate(([True], ends[:-1]))[at]
        title = self.fact[2][ids] & ~number & ~unit
        inner = title & ~opening
        known = {self.core[i] for i in ids[inner].tolist()}
        named = title & np.fromiter((self.core[i] in known or self.core[i] not in OPENERS for i in ids.tolist()), bool, len(ids))
        typed = np.where(number, NUMBER, np.where(unit, UNIT, 0)).astype(np.int8)
        return ids, [np.where(inner, NAME, typed), np.where(named, NAME, typed), typed, np.zeros(len(ids), np.int8)]


def _places(window: int) -> np.ndarray:
    """Odd factors, one for each place of a window; a window's hash is a sum, so that slots are left out at no cost."""
    return np.array([_digest(f"place {q}") | 1 for q in range(window)], np.uint64)


def _salt(pattern: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(pattern, 4))


ITEM_SCHEMA = "id long, key long, reading int, pos int, hash long, pattern binary, slots array<struct<at:int,kind:int,value:string>>, total int"
WINDOW_SCHEMA = "id long, key long, pos int, hash long, slots array<struct<at:int,kind:int,value:string>>"
_SLOT = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))


def _slots(pattern: bytes, core, p: int) -> list[dict]:
    return [{"at": q, "kind": k, "value": core(p + q)} for q, k in enumerate(pattern) if k]


def _packed(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _item_rows(window: int, short_items: bool):
    """``(id, key, text)`` of items to rows of their windows in each reading that differs from those before."""
    place, least = [int(x) for x in _places(window)], min(LITERALS, window)

    def row(canon: Canon, ids: np.ndarray, kind: np.ndarray, reading: int, p: int, size: int, total: int) -> tuple:
        pattern = kind[p : p + size].astype(np.uint8).tobytes()
        h = int(_salt(pattern)) + sum(int(canon.literal[i]) * w for i, k, w in zip(ids[p : p + size].tolist(), pattern, place) if not k)
        return reading, p, (h + (1 << 63)) % (1 << 64) - (1 << 63), pattern, _slots(pattern, lambda j: canon.core[ids[j]], p), total

    def of(canon: Canon, words: list[str]) -> Iterator[tuple]:
        ids, readings = canon.readings(words)
        n = len(ids) - window + 1
        if n < 1:
            if short_items and len(ids):
                yield row(canon, ids, readings[-1], len(READINGS) - 1, 0, len(ids), 1)
            return
        seen: list[np.ndarray] = []
        for reading, kind in enumerate(readings):
            if any(np.array_equal(kind, k) for k in seen):
                continue
            seen.append(kind)
            literal = np.concatenate(([0], np.cumsum(kind == 0)))
            fit = np.flatnonzero(literal[window:] - literal[:-window] >= least)
            # few windows may be met by chance
            if reading and 2 * len(fit) < n:
                continue
            for p in fit.tolist():
                yield row(canon, ids, kind, reading, p, window, len(fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for ident, key, text in zip(*batch.columns, strict=True):
                words = text.as_py().split()
                if words:
                    rows = [(ident.as_py(), key.as_py(), *x) for x in of(canon, words)]
                    yield _packed(rows, ["id", "key", "reading", "pos", "hash", "pattern", "slots", "total"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), _SLOT, pa.int32()])

    return run


def _probes(hashes: Column) -> Column:
    """A hash's two places in the filter: its highest and its lowest bits."""
    return F.array(F.shiftrightunsigned(hashes, 64 - FILTER), hashes.bitwiseAND(F.lit((1 << FILTER) - 1)))


def _filter_bits(items: DataFrame) -> np.ndarray:
    """The filter over the items' hashes as 64-bit words: made by Spark, at most ``2 ** (FILTER - 6)`` rows for the driver."""
    at = items.select(F.explode(_probes(F.col("hash"))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER - 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    some, size = np.arange(len(hashes)), len(bits).bit_length() + 5
    for probe in (lambda h: h >> np.uint64(64 - size), lambda h: h & np.uint64((1 << size) - 1)):
        p = probe(hashes[some])
        some = some[(bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return some


def _window_rows(window: int, patterns: list[bytes], held: Broadcast):
    """``(id, key, text)`` to rows of their windows that fit a pattern of slots and pass the filter.

    Texts are gathered to blocks of words; a text longer than a block comes in
    parts, each with the last ``window - 1`` tokens of the part before.
    Patterns shorter than a window are those of short items; of them a part may
    tell a window twice.
    """
    place = _places(window)
    # the rarer kinds first
    asked = [(p, _salt(p), sorted(((q, k) for q, k in enumerate(p) if k), key=lambda x: x[1] == NAME), [q for q, k in enumerate(p) if not k]) for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, bits = Canon(), held.value

        def sifted(h: np.ndarray, has: dict[int, np.ndarray]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
            """For each pattern the windows to join and their hashes."""
            parts: dict[tuple[int, int], np.ndarray] = {}
            where = {k: np.flatnonzero(x) for k, x in has.items()}
            for pattern, salt, slots, literal in asked:
                n = len(h) - len(pattern) + 1
                if n < 1:
                    continue
                if slots:
                    q, k = slots[0]
                    some = where[k] - q
                    some = some[(some >= 0) & (some < n)]
                    for q, k in slots[1:]:
                        some = some[has[k][some + q]]
                else:
                    some = np.arange(n)
                if not len(some):
                    continue
                grams = np.full(len(some), salt)
                for q in literal:
                    if (q, n) not in parts:
                        parts[q, n] = h[q : q + n] * place[q]
                    grams += parts[q, n][some] if slots else parts[q, n]
                near = _maybe(bits, grams)
                yield pattern, some[near], grams[near]

        def block(rows: list[tuple], words: list[str], sizes: list[int]) -> Iterator[tuple]:
            starts = np.cumsum([0, *sizes[:-1]])
            at, ids, number, unit = canon.tokens(words, starts)
            text = np.repeat(np.arange(len(sizes)), sizes)[at]
            begin = np.searchsorted(text, np.arange(len(sizes) + 1))
            for pattern, some, grams in sifted(canon.literal[ids], {NUMBER: number, UNIT: unit, NAME: canon.fact[5][ids]}):
                own = text[some] == text[some + len(pattern) - 1]
                for p, g in zip(some[own].tolist(), grams[own].view(np.int64).tolist()):
                    i = int(text[p])
                    yield *rows[i], p - int(begin[i]), g, _slots(pattern, lambda j: canon.core[ids[j]], p)

        def long(row: tuple, words: list[str]) -> Iterator[tuple]:
            done = 0
            h, has, core = np.empty(0, np.uint64), {k: np.empty(0, bool) for k in (NUMBER, UNIT, NAME)}, np.empty(0, object)
            for at in range(0, len(words), BLOCK):
                lead = min(at, 2)  # the words before tell whether a number stands there
                where, ids, number, unit = canon.tokens(words[at - lead : at + BLOCK], np.array([0]))
                new = where >= lead
                ids = ids[new]
                h = np.concatenate([h, canon.literal[ids]])
                for k, x in ((NUMBER, number[new]), (UNIT, unit[new]), (NAME, canon.fact[5][ids])):
                    has[k] = np.concatenate([has[k], x])
                core = np.concatenate([core, np.array([canon.core[j] for j in ids.tolist()], object)])
                for pattern, some, grams in sifted(h, has):
                    for p, g in zip(some.tolist(), grams.view(np.int64).tolist()):
                        yield *row, done + p, g, _slots(pattern, core.__getitem__, p)
                past = max(0, len(h) - window + 1)
                done += past
                h, core, has = h[past:], core[past:], {k: x[past:] for k, x in has.items()}

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return _packed(rows, ["id", "key", "pos", "hash", "slots"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), _SLOT])

        for batch in batches:
            rows: list[tuple] = []
            words: list[str] = []
            sizes: list[int] = []
            for ident, key, text in zip(*batch.columns, strict=True):
                own, row = text.as_py().split(), (ident.as_py(), key.as_py())
                if len(own) > BLOCK:
                    yield packed(list(long(row, own)))
                    continue
                rows.append(row)
                words += own
                sizes.append(len(own))
                if len(words) >= BLOCK:
                    yield packed(list(block(rows, words, sizes)))
                    rows, words, sizes = [], [], []
            if rows:
                yield packed(list(block(rows, words, sizes)))

    return run


def agreement(windows: list[tuple[int, list[tuple[int, int, str, str]]]]) -> tuple[int, int]:
    """How many item windows agree on one map of slots, and how many slots it changes.

    ``windows`` are ``(item place, [(slot's place, kind, item's value, document's value)])``
    of one document and item.  A slot (a kind and an item's value) takes the
    document's values that stand at more than half of its places; one without
    such a majority takes none.  Several copies in one document may each keep
    their own.  Windows with any other value in a slot do not count.
    """
    said: dict[tuple[int, str], dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for _, slots in windows:
        for place, kind, item, doc in slots:
            said[kind, item][place].add(doc)
    taken = {slot: {v for v in set().union(*at.values()) if 2 * sum(v in x for x in at.values()) > len(at)} for slot, at in said.items()}
    kept = [(at, slots) for at, slots in windows if all(doc in taken[kind, item] for _, kind, item, doc in slots)]
    used = {(kind, item) for _, slots in kept for _, kind, item, _ in slots}
    return len({at for at, _ in kept}), sum(item not in taken[kind, item] for kind, item in used)


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [agreement([(w["at"], [(s["place"], s["kind"], s["item"], s["doc"]) for s in w["slots"]]) for w in ws.as_py()]) for ws in batch.column(6)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["id", "key", "item_id", "item_key", "reading", "item_windows", "windows", "slots_changed"])


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, short_items: bool = False) -> DataFrame:
    """``(doc_id, key, item_id, windows, item_windows, coverage, slots_changed)`` for each item a document gives away.

    An item is given away if in one of its readings the windows that agree on
    one map of slots cover at least ``coverage`` of its windows; the figures are
    those of the reading with the best coverage, then the fewest changes.  A
    name may stand for any capitalised word; a text in lower case throughout
    meets names only as they are.  ``key`` is ``xxhash64`` of the text; rows that
    agree in id and text share one result.

    Null texts count as empty and match nothing.  An item shorter than a window
    is hard to tell from chance: by default it matches nothing, with
    ``short_items`` it is one window of all its words, found word for word.
    Windows with fewer than three literal words are not counted, so an item that
    has only such is found by its words alone; repeated items each get their
    rows; null ids stay null; empty tables give an empty result; further
    columns are ignored.
    """
    spark = docs.sparkSession
    items = stage(_keyed(benchmark, item_id, item_text).mapInArrow(_item_rows(window, short_items), ITEM_SCHEMA), "decontaminate-items")
    patterns = sorted(bytes(r["pattern"]) for r in items.select("pattern").distinct().collect())  # at most 110 for windows of five
    held = spark.sparkContext.broadcast(_filter_bits(items))  # 4 MB for every benchmark
    found = _keyed(docs, id_col, text_col).mapInArrow(released(_window_rows(window, patterns, held)), WINDOW_SCHEMA)
    items = items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "reading", F.col("pos").alias("at"), "hash", F.col("slots").alias("item_slots"), F.col("total").alias("item_windows"))
    # a written table, of known size: Spark broadcasts a small one and splits the hot hashes of a large one
    hits = found.join(items, "hash")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct((F.col("at") + a["at"]).alias("place"), a["kind"].alias("kind"), a["value"].alias("item"), b["value"].alias("doc")))
    of = ("id", "key", "item_id", "item_key", "reading", "item_windows")
    # distinct windows of one document on one item, no more than the document has
    lines = hits.groupBy(*of).agg(F.collect_set(F.struct("at", pairs.alias("slots"))).alias("seen"))
    lines = lines.where(F.size(F.array_distinct("seen.at")) >= F.col("item_windows") * coverage - 1e-6)
    total = lines.select(*of, "seen").mapInArrow(_agreements, "id long, key long, item_id long, item_key long, reading int, item_windows int, windows long, slots_changed long")
    total = total.withColumn("coverage", F.col("windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    best = F.struct("coverage", (-F.col("slots_changed")).alias("same"), "windows", "item_windows")
    total = total.groupBy("id", "key", "item_id", "item_key").agg(F.max(best).alias("best"))
    return total.select(F.col("id").alias("doc_id"), "key", "item_id", "best.windows", F.col("best.item_windows").cast("long").alias("item_windows"), "best.coverage", (-F.col("best.same")).cast("long").alias("slots_changed"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that give an item away; columns and other rows as they were."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"]), "left_anti")
