"""Operator 3: personal data by fixed patterns and a linear-chain CRF.

Fixed patterns give the base spans (email, ip, card, phone).  A conditional
random field over word-shape features, trained from a small labelled table made
by rule in this module, adds spans of the same kinds in forms the patterns do
not know: spelt-out addresses, numbers without a country code, defanged
addresses, cards with other separators.  Words are decoded by Viterbi in numpy
batches.

Words with the features of a plain word need no decoding far from others:
:meth:`Crf.reach` proves, for the fitted weights, that of so many plain words
in a row the best path calls one "outside", and that between two such words it
never leaves.  So a text is cut within longer runs of plain words, and its
parts are decoded with the tags that the whole would have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters split into words at a time.
CHUNK = 1 << 20
#: Words longer than this are not remembered.
MEMORABLE = 64
#: Words decoded together at most (a longer stretch is decoded alone).
BATCH = 1 << 16

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # starts at a run's start: later starts in it fail alike
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind by the fixed patterns alone."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out["email"].append((start, end := m.end()))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            out["phone"].append(m.span())
    return out


# The random field.

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_CUES = ("at", "dot", "(at)", "[at]", "(dot)", "[dot]", "call", "phone", "tel", "mobile", "fax", "mail", "email", "card", "visa", "ip", "host", "version", "page", "chapter", "item", "number")
_EDGES = ".,;:!?\"'"
_PLAIN = re.compile(r"[^0-9@.+()\[\]/_-]*")
_SIGNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|.", re.DOTALL)


def word_features(word: str) -> tuple[str, ...]:
    """A word's shape with digit runs counted, its shape without counts, its cue, its number of digits."""
    core = word.strip(_EDGES)
    full, short = [], []
    for run in _SIGNS.findall(core):
        c = run[0]
        kind = "X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else "9" if "0" <= c <= "9" else c if c in "@.+-()[]/_" else "u"
        full.append(f"9{min(len(run), 9)}" if kind == "9" else kind)
        if not short or short[-1] != kind:
            short.append(kind)
    low, n = core.lower(), sum("0" <= c <= "9" for c in word)
    shape = "".join(short)
    if set(shape) <= set("Xxu"):
        shape, full = "plain", ["plain"]
    return "f" + "".join(full), "s" + shape, "c" + (low if low in _CUES else ""), f"n{min(n, 20)}"


def labelled_table(seed: int = 7, rows: int = 500) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences made by rule, their words and tags."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: pick(("the", "of", "and", "to", "in", "For", "with", "on", "an", "Il", "der", "les", "de", "Then", "that", "name", "was", "is", "est,", "house.", "value", "river", "at", "call", "item", "a", "Über", "niño"))
    name = lambda: pick(("jane", "omar", "lee.ann", "k_roy", "info", "li7", "sales", "bo", "max99"))
    host = lambda: pick(("mail", "example", "post", "uni", "corp", "web2"))
    top = lambda: pick(("com", "org", "net", "de", "fr", "edu"))
    at, dot = (lambda: pick(("at", "(at)", "[at]"))), (lambda: pick(("dot", "(dot)", "[dot]")))

    def personal() -> tuple[str, list[str]]:
        kind = int(rng.integers(10))
        if kind == 0:
            return "email", [name(), pick(("(at)", "[at]")), host(), dot(), top()]
        if kind == 1:
            return "email", [name(), at(), host(), "dot", top()]
        if kind == 2:
            return "email", [f"{name()}[at]{host()}[dot]{top()}"]
        if kind == 3:
            return "email", [f"{name()}@{host()}.{top()}"]
        if kind == 4:
            return "ip", [pick(("[.]", "(.)", ".")).join(str(int(x)) for x in rng.integers(0, 256, 4))]
        if kind == 5:
            return "card", [".".join(num(4) for _ in range(4)) if rng.random() < 0.5 else num(16)]
        if kind == 6:
            return "card", [num(4) for _ in range(4)]
        if kind == 7:
            return "phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]
        if kind == 8:
            return "phone", [f"{num(3)}{pick('-.')}{num(3)}{pick('-.')}{num(4)}"]
        return "phone", [f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"]

    other = lambda: pick(([f"{num(1)}.{num(1)}."], ["version", f"{num(1)}."], [num(4)], [num(2)], [f"{num(1)},{num(3)}"], ["page", num(3)], [f"'{num(12)}b{num(7)}f{num(9)}a{num(3)}'"], [f"a{num(9)}c{num(12)}e{num(8)}"], [f"{num(4)}-{num(2)}-{num(2)}"], [f"{num(2)}:{num(2)}"], ["dot"], ["at"], ["=", f'"{num(7)}d{num(20)}"'], [num(7)], [num(3)], [f"{num(2)}%"], ["AK" + num(3) + "F" + num(2) + "H"], ["@"], [f"@{name()}"], [num(3), num(2)], [num(25)], [f"{num(2)}.{num(2)}.{num(4)}"]))
    out = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 5))):
                words.append(word())
                tags.append("O")
            if rng.random() < 0.55:
                kind, got = personal()
                tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
            else:
                got = other()
                tags += ["O"] * len(got)
            words += got
        for _ in range(int(rng.integers(0, 6))):
            words.append(word())
            tags.append("O")
        if words:
            words[-1] += pick(("", ".", ",", "!!", "***"))
            out.append((words, tags))
    return out


class _Odd(dict):
    """Whether a word has other features than a plain one, told without making them; remembered for short words."""

    def __missing__(self, word: str) -> bool:
        core = word.strip(_EDGES)
        odd = not _PLAIN.fullmatch(core) or core.lower() in _CUES
        if len(word) <= MEMORABLE:
            if len(self) > 200_000:
                self.clear()
            self[word] = odd
        return odd


class Crf:
    """Linear-chain conditional random field over :func:`word_features` of a word and its neighbours."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transition: np.ndarray) -> None:
        self.index, self.weights, self.transition = index, weights, transition  # weights: place (before, here, after) x feature x tag
        self._seen: dict[str, list[int]] = {}
        self.plain = self.ids("word")
        self.odd = _Odd()
        self.cut: int | None = None  # see reach

    def ids(self, word: str) -> list[int]:
        got = self._seen.get(word)
        if got is None:
            got = [self.index.get(f, 0) for f in word_features(word)]
            if len(word) <= MEMORABLE:
                if len(self._seen) > 100_000:
                    self._seen.clear()
                self._seen[word] = got
        return got

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tag) from feature ids (batch, time, 4)."""
        before, here, after = (sum(w[ids[..., f]] for f in range(ids.shape[-1])) for w in self.weights)
        here[:, 1:] += before[:, :-1]
        here[:, :-1] += after[:, 1:]
        return here

    def viterbi(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time); beyond a row's length they mean nothing."""
        return self.best_path(self.emissions(ids), lengths)

    def best_path(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags from scores (batch, time, tag), with "outside" before and after each row."""
        n, steps, tags = e.shape
        back = np.zeros((n, steps, tags), np.int8)
        score = e[:, 0] + self.transition[0]
        for t in range(1, steps):
            ways = score[:, :, None] + self.transition[None]
            back[:, t] = ways.argmax(axis=1)
            score = np.where((t < lengths)[:, None], ways.max(axis=1) + e[:, t], score)
            back[:, t] = np.where((t < lengths)[:, None], back[:, t], np.arange(tags))
        best = np.zeros((n, steps), np.int8)
        best[:, -1] = (score + self.transition[:, 0]).argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            best[:, t - 1] = back[np.arange(n), t, best[:, t]]
        return best

    def plain_margin(self) -> float:
        """How much "outside" beats any other tag on a plain word between plain words, transitions allowed for."""
        plain = np.array([[self.ids("word")] * 3])
        e = self.emissions(plain)[0, 1]
        into = self.transition[0, 1:].max() - self.transition[0, 0]
        within = self.transition[1:, 1:].max() - self.transition[0, 0]
        return float(e[0] - e[1:].max() - max(into, within, 0))


    def reach(self, most: int = 64) -> int | None:
        """The least number of plain words in a row, with plain neighbours, among which the best path is "outside" once.

        Whatever tags stand on either side, every path through that many plain
        words without "outside" must weigh less than the best one with it; and
        every way from "outside" over other tags back to it less than staying.
        None if ``most`` words do not do, so that nothing may be cut.
        """
        stay = self.emissions(np.array([[self.plain] * 3]))[0, 1]
        step = self.transition + stay - (self.transition[0, 0] + stay[0])  # into a plain word, staying outside weighs 0
        away = step[1:, 1:]
        inner = step[:, 1:]  # from any tag, after so many words all of other tags
        outer = step[:, :1] + np.where(np.arange(len(step)) == 0, 0.0, -np.inf)  # the same with one "outside" at least
        found = None
        for n in range(1, most + 1):
            if (inner[0] + self.transition[1:, 0] - self.transition[0, 0]).max() >= 0:  # out and back again
                return None
            without = (inner[:, :, None] + self.transition[None, 1:]).max(axis=1)
            within = (outer[:, :, None] + self.transition[None]).max(axis=1)
            if found is None and (without < within).all():
                found = n
            full = (outer[:, :, None] + step[None]).max(axis=1)
            full[:, 0] = np.maximum(full[:, 0], (inner + step[1:, 0]).max(axis=1))
            inner, outer = (inner[:, :, None] + away[None]).max(axis=1), full
        # no ring of other tags may gain, else longer ways could still win
        return found if inner[0].max() < 0 and self._best_ring(away) < 0 else None

    @staticmethod
    def _best_ring(step: np.ndarray) -> float:
        """The heaviest ring's mean weight is below 0 if that of every ring of up to all tags is."""
        walk, best = step, np.diag(step).max()
        for _ in range(len(step) - 1):
            walk = (walk[:, :, None] + step[None]).max(axis=1)
            best = max(best, np.diag(walk).max())
        return float(best)


@lru_cache(1)
def trained(steps: int = 80, decay: float = 1e-3) -> Crf:
    """Fit by gradient ascent on the penalised log-likelihood of the labelled table."""
    table = labelled_table()
    names = sorted({f for words, _ in table for w in words for f in word_features(w)} | set(word_features("word")))
    index = {f: i + 1 for i, f in enumerate(names)}
    k, n, steps_t = len(TAGS), len(table), max(len(w) for w, _ in table)
    crf = Crf(index, np.zeros((3, len(index) + 1, k)), np.zeros((k, k)))
    ids, tags, mask = np.zeros((n, steps_t, 4), np.int64), np.zeros((n, steps_t), np.int64), np.zeros((n, steps_t))
    for i, (words, given) in enumerate(table):
        ids[i, : len(words)] = [crf.ids(w) for w in words]
        tags[i, : len(words)] = [TAGS.index(t) for t in given]
        mask[i, : len(words)] = 1
    lengths = mask.sum(1).astype(int)
    gold = np.eye(k)[tags] * mask[:, :, None]
    pairs = np.zeros((k, k))
    for i in range(n):
        chain = [0, *tags[i, : lengths[i]], 0]
        np.add.at(pairs, (chain[:-1], chain[1:]), 1)
    ban = np.zeros((k, k))
    for a, x in enumerate(TAGS):
        for b, y in enumerate(TAGS):
            if y[0] == "I" and x[1:] != y[1:]:
                ban[a, b] = -30.0
    moments: list[np.ndarray] = [np.zeros_like(crf.weights), np.zeros_like(crf.weights), np.zeros((k, k)), np.zeros((k, k))]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    free = np.zeros((k, k))
    for step in range(1, steps + 1):
        crf.transition = free + ban
        tr, e = crf.transition, crf.emissions(ids)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + tr[0]
        for t in range(1, steps_t):
            fwd[:, t] = np.where(mask[:, t, None] > 0, soft(fwd[:, t - 1, :, None] + tr[None], 1) + e[:, t], fwd[:, t - 1])
        bwd[:, -1] = tr[:, 0]
        for t in range(steps_t - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, soft(tr[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), tr[:, 0])
        z = soft(fwd[:, -1] + tr[:, 0], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        two = np.exp(fwd[:, :-1, :, None] + tr + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        expected = two.sum(axis=(0, 1))
        expected[0] += p[:, 0].sum(axis=0)
        last = p[np.arange(n), lengths - 1]
        expected[:, 0] += last.sum(axis=0)
        slope_t = (pairs - expected) / n - decay * free
        diff, slope = (gold - p) / n, np.zeros_like(crf.weights)
        np.add.at(slope[1], ids, diff[:, :, None, :])
        np.add.at(slope[0], ids[:, :-1], diff[:, 1:, None, :] * mask[:, 1:, None, None])
        np.add.at(slope[2], ids[:, 1:], (diff[:, :-1, None, :] * mask[:, 1:, None, None]))
        slope -= decay * crf.weights
        for target, g, m, v in ((crf.weights, slope, moments[0], moments[1]), (free, slope_t, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        crf.weights[:, 0] = 0  # features never seen
    crf.transition = free + ban
    crf.cut = crf.reach()
    return crf


def _valid(kind: str, s: str) -> bool:
    """What a span found by the field must hold to be kept."""
    d = _digits(s)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", s, re.IGNORECASE) and re.search(r"\.|\bdot\b", s, re.IGNORECASE) and re.search("[A-Za-z]", s))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", s.strip("[]()."))
        return len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
    return 7 <= len(d) <= 15 and not re.search("[A-Za-z]", s)


def _words(crf: Crf, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the numbers of those that are not plain."""
    starts, ends, odd, at, n = [], [], [], 0, 0
    while at < len(text):
        to = at + CHUNK
        gap = re.compile(r"[\x20\x09-\x0D]").search(text, to) if to < len(text) else None
        part = text[at : gap.start()] if gap else text[at:]
        words = _WORD.findall(part)
        signs = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate(([False], (signs != 32) & ((signs < 9) | (signs > 13)), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + at
        starts.append(edges[::2])
        ends.append(edges[1::2])
        odd.append(np.flatnonzero(np.fromiter(map(crf.odd.__getitem__, words), bool, len(words))) + n)
        n += len(words)
        at += len(part)
        if not part:  # the gap itself
            at += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none, *odd])


def stretches(words: int, odd: np.ndarray, cut: int | None) -> list[tuple[int, int]]:
    """Numbers (first, end) of the words to decode together: texts are cut where ``2 * (cut + 1)`` words in a row are plain.

    ``cut + 1`` plain words stay on either side of the others, at the start of
    the text and at its end.
    """
    if not words:
        return []
    if cut is None:
        return [(0, words)]
    keep = cut + 1
    marks = np.unique(np.concatenate(([-1], odd, [words])))
    wide = np.flatnonzero(np.diff(marks) - 1 >= 2 * keep)
    first = np.concatenate(([0], marks[wide + 1] - keep))
    end = np.concatenate((marks[wide] + 1 + keep, [words]))
    return list(zip(first.tolist(), end.tolist()))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] in "])"):
        end -= 1
    return start, end


def field_spans(crf: Crf, texts: list[str], cut: int | None = -1) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the random field, checked but not yet held against the base spans.

    ``cut`` is the field's own reach if not given; with None whole texts are decoded.
    """
    cut = crf.cut if cut == -1 else cut
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    split = [_words(crf, t) for t in texts]
    jobs = [(i, a, b) for i, (starts, _, odd) in enumerate(split) for a, b in stretches(len(starts), odd, cut)]
    jobs.sort(key=lambda x: x[2] - x[1])
    at = 0
    while at < len(jobs):
        to = at + 1
        while to < len(jobs) and (to - at + 1) * (jobs[to][2] - jobs[to][1]) <= BATCH:
            to += 1
        part, at = jobs[at:to], to
        steps, lengths = part[-1][2] - part[-1][1], np.array([b - a for _, a, b in part])
        ids = np.zeros((len(part), steps + 2, 4), np.int64)  # one word on either side as context; 0 beyond a text's ends
        for row, (i, a, b) in enumerate(part):
            starts, ends, _ = split[i]
            low, high = max(0, a - 1), min(len(starts), b + 1)
            text = texts[i]
            ids[row, low - a + 1 : high - a + 1] = [crf.ids(text[x:y]) for x, y in zip(starts[low:high].tolist(), ends[low:high].tolist())]
        best = crf.best_path(crf.emissions(ids)[:, 1:-1], lengths)
        best[np.arange(steps) >= lengths[:, None]] = 0
        for row in np.flatnonzero((best > 0).any(axis=1)).tolist():
            i, first, end = part[row]
            starts, ends, _ = split[i]
            tags = best[row, : end - first].tolist()
            j = 0
            while j < len(tags):
                tag, k = tags[j], j + 1
                if tag:
                    while k < len(tags) and tags[k] == (tag + 1 if tag % 2 else tag):
                        k += 1
                    kind = KINDS[(tag - 1) // 2]
                    a, b = _trim(texts[i], int(starts[first + j]), int(ends[first + k - 1]))
                    if a < b and _valid(kind, texts[i][a:b]):
                        found[i].append((kind, a, b))
                j = k
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def all_spans(crf: Crf, texts: list[str]) -> Iterator[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text its base spans, and all spans: those and what the field adds clear of them."""
    for text, more in zip(texts, field_spans(crf, texts), strict=True):
        base = base_spans(text)
        spans = [(k, a, b) for k, xs in base.items() for a, b in xs]
        taken = sorted((a, b) for _, a, b in spans)
        yield base, spans + [(k, a, b) for k, a, b in more if all(b <= x or a >= y for x, y in taken)]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of each text masked; null texts stay null, other columns as they were."""
    crf = trained()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        return pd.Series([None if t is None else mask(t, spans) for t, (_, spans) in zip(texts, all_spans(crf, whole), strict=True)], dtype=object)

    return docs.withColumn(text_col, cleaned(text_col))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` and ``masked`` where asked.

    Counts and digest are of the base spans; ``spans`` has all.  Null texts
    count as empty (no spans, empty masked text).  Rows are handled alone, whole
    and in order, so repeats, null ids and an empty table need no care; further
    columns are ignored.
    """
    crf = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, (base, spans) in zip(texts, all_spans(crf, texts), strict=True):
                digest = sha256(joined([(k, a, b) for k, xs in base.items() for a, b in xs]).encode()).hexdigest()
                rows.append((*(len(base[k]) for k in KINDS), digest, joined(spans), *([mask(text, spans)] if masked else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (6 + masked)
            kinds = [pa.int64()] * 4 + [pa.string()] * (2 + masked)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["masked"] * masked])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * masked
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
