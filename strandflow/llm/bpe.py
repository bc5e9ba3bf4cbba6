"""Operator 5: byte-level BPE as a bounded-lookahead streaming transducer.

The merge list fixes how far to the right a merge can depend: a merge ``(x, y)``
fails to happen at a place only if a rightmost part of ``y`` is taken first by
a merge of lower rank with what follows, which in turn may lose its own right
part, and so on with ever lower ranks.  :func:`sufficient_lookahead` follows
these chains over the whole list and returns the most bytes one can span.  A
token is stable, and is emitted, once that many bytes after its end have been
seen; encoding starts again at its end, since what follows a token of an
encoding is encoded alone in the same way.  So memory holds one window,
whatever the length of the piece.  Every piece goes this way; one that ends
within its first window is stable as a whole.

Before the transducer stands a memory of the ids of units it has encoded, since
words come again; it is bounded, and without it the ids are the same.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 state
machine; bytes that form no character become U+FFFD.
"""

from __future__ import annotations

import bisect
import codecs
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode's White_Space property has it (Python's \\s has four more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Units of up to so many characters are remembered once encoded; 0 for none.
REMEMBERED = 256
#: Remembered units of one worker at most; then it starts anew.
MEMORY = 250_000
#: Characters split into pieces at a time.
CHUNK = 1 << 16
#: Bytes a window holds beside the lookahead (the longest token, if that is more).
STEP = 128


def byte_characters() -> list[str]:
    """The printable stand-ins for bytes in byte-level vocabularies, by byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


def _ranges(first_letter: str) -> str:
    """A character class body of all code points whose category starts so."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first_letter
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def piece_pattern() -> re.Pattern:
    """Contractions; letters, numbers or other signs after one optional blank; white space."""
    letter, number = _ranges("L"), _ranges("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token within which every merge that could change it shows.

    Of each merge, ``reach`` is the number of bytes after it that its happening
    can depend on: over each part ``s`` on the right spine of its right side,
    used there by rank ``r``, and each lower-ranked merge ``(s, c)``, at most
    ``len(c) + reach(s, c)``.  ``lows[s]`` keeps the running maximum by rank.
    """
    made: dict[bytes, tuple[int, bytes]] = {}
    lows: dict[bytes, tuple[list[int], list[int]]] = {}
    most = 0
    for rank, (x, y) in enumerate(merges):
        reach, part, used = 0, y, rank
        while True:
            if part in lows:
                ranks, best = lows[part]
                at = bisect.bisect_left(ranks, used)
                if at:
                    reach = max(reach, best[at - 1])
            if part not in made:
                break
            used, part = made[part]
        ranks, best = lows.setdefault(x, ([], []))
        ranks.append(rank)
        best.append(max(best[-1] if best else 0, len(y) + reach))
        made.setdefault(x + y, (rank, y))
        most = max(most, best[-1])
    return most


class _Joined(Exception):
    """A unit whose pieces run on beyond its blanks."""


class _Units(dict):
    """Ids of units seen before; longer ones and those beyond the memory are not kept."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine

    def __missing__(self, unit: str) -> str:
        got = self.machine.encode_unit(unit)
        return self.keep(unit, got)

    def keep(self, unit: str, ids: str) -> str:
        if len(unit) <= REMEMBERED:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = ids
        return ids


class _Pieces(_Units):
    """The same for pieces."""

    def __missing__(self, piece: str) -> str:
        return self.keep(piece, self.machine.encode_piece(piece))


class Transducer:
    """A byte-level BPE vocabulary with streaming encoding and decoding."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(self.merges):
            self.rank.setdefault(m, i)
        self._byte_id = [self.ids[bytes([b])] for b in range(256)]
        self._pair_rank = {self.ids[x] << 20 | self.ids[y]: r for (x, y), r in self.rank.items()}
        self._made = [self.ids[x + y] for x, y in self.merges]
        self.lookahead = sufficient_lookahead(self.merges)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._piece = piece_pattern()
        self._space = re.compile(f"[{SPACE}]")
        self._units, self._pieces = _Units(self), _Pieces(self)
        self._size = {i: len(t) for t, i in self.ids.items()}
        self.step = max([STEP, *self._size.values()])
        self._text_of: dict[bytes, bytes] = {str(i).encode(): t for i, t in self.token.items()}

    # encoding

    def _merge(self, data: bytes) -> list[int]:
        """Ids of one window: the pair of least rank, the leftmost of equals, is merged until there is none."""
        parts = [self._byte_id[b] for b in data]
        rank, far, made = self._pair_rank.get, len(self.merges), self._made
        ranks = [rank(a << 20 | b, far) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == far:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], far)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], far)
        return parts

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in blocks, each emitted once its token is stable."""
        held, blocks, ended, width = b"", iter(blocks), False, self.step + self.lookahead
        while not ended or held:
            while not ended and len(held) <= width:
                block = next(blocks, None)
                ended, held = block is None, held + (block or b"")
            last, done = ended and len(held) <= width, 0
            for token in self._merge(held[:width]):
                size = self._size[token]
                if not last and done + size > self.step:
                    break
                yield token
                done += size
            if last:
                return
            held = held[done:]

    def encode_piece(self, piece: str) -> str:
        return ",".join(map(str, self.stream(piece[i : i + STEP].encode() for i in range(0, len(piece), STEP))))

    def _chunks(self, text: str) -> Iterator[str]:
        """Slices of a text at places where its pieces end whatever comes after: before a lone blank."""
        at = 0
        while len(text) - at > 2 * CHUNK:
            cut = at + CHUNK
            while (cut := text.find(" ", cut)) > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut += 1
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode_blocks(self, text: str) -> Iterator[str]:
        """Decimal ids joined by commas, a block of the text at a time."""
        for section in self._special.split(text) if self._special else [text]:
            if section in self.special:
                yield str(self.special[section])
                continue
            for chunk in self._chunks(section):
                # a chunk after the first starts with its lone blank; what stands before the first blank is no unit
                first, *units = chunk.split(" ")
                try:
                    out = list(map(self._units.__getitem__, units))
                except _Joined:
                    out, first = [], chunk
                if first:
                    out.insert(0, self._encode_pieces(first))
                if out:
                    yield ",".join(out)

    def _encode_pieces(self, text: str) -> str:
        return ",".join(map(self._pieces.__getitem__, self._piece.findall(text)))

    def encode_unit(self, unit: str) -> str:
        """A blank and what follows it up to the next blank: its pieces depend on nothing else,

        unless white space meets the blank at either end.
        """
        if not unit or self._space.match(unit) or self._space.match(unit, len(unit) - 1):
            raise _Joined
        return self._encode_pieces(" " + unit)

    def encode(self, text: str) -> list[int]:
        return [int(i) for block in self.encode_blocks(text) for i in block.split(",")]

    # decoding

    def decode_blocks(self, blocks: Iterable[str]) -> Iterator[str]:
        """Text of comma-joined ids, a block at a time; a character may lie across blocks."""
        machine, text_of = codecs.getincrementaldecoder("utf-8")("replace"), self._text_of
        for block in blocks:
            yield machine.decode(b"".join(map(text_of.__getitem__, block.encode().split(b","))) if block else b"")
        yield machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_blocks(str(i) for i in ids))


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, made once."""
    return Transducer(Path(path).read_bytes())


class _Shipped:
    """A broadcast vocabulary; equal ones have one transducer in each worker."""

    def __init__(self, held: Broadcast, digest: str) -> None:
        self.held, self.digest = held, digest

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shipped) and other.digest == self.digest


@lru_cache(2)
def _machine(shipped: _Shipped) -> Transducer:
    """One transducer for each worker process and vocabulary."""
    return Transducer(shipped.held.value)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` or ``decoded`` where asked.

    ``vocabulary`` is a tokenizer file that the driver can read; its bytes (some
    megabytes) are broadcast.  Null texts count as empty: no tokens, digests of
    the empty string.  Strings of added tokens become their ids, as that library
    does it.  Rows are handled alone, so repeats, null ids and an empty table
    need no care; further columns are ignored.
    """
    blob = Path(vocabulary).read_bytes()
    shipped = _Shipped(docs.sparkSession.sparkContext.broadcast(blob), sha256(blob).hexdigest())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shipped)
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + keep_ids + keep_text)]
            for text in batch.column(1):
                ids, decoded, n, parts, texts = sha256(), sha256(), 0, [], []

                def blocks(text: str = text.as_py(), ids=ids, parts=parts) -> Iterator[str]:
                    nonlocal n
                    for block in machine.encode_blocks(text):
                        ids.update(("," * bool(n) + block).encode())
                        n += block.count(",") + 1
                        if keep_ids:
                            parts.append(block)
                        yield block

                for part in machine.decode_blocks(blocks()):
                    decoded.update(part.encode())
                    if keep_text:
                        texts.append(part)
                for column, value in zip(out, [n, ids.hexdigest(), decoded.hexdigest(), *([np.concatenate([np.empty(0, np.int32), *(np.fromstring(p, np.int32, sep=",") for p in parts)])] if keep_ids else []), *(["".join(texts)] if keep_text else [])], strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if keep_ids else []), *([pa.string()] if keep_text else [])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
