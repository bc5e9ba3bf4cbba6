"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandflow.llm import bpe, chat, components, decontaminate, digests, licenses, near_copies, pii, quality, sharding, simhash, substrings

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 150))]
        if i % 5 == 0:
            words[rng.randint(0, len(words)) : 0] = passage.split()
        if i % 7 == 0 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
        texts.append(rng.choice([" ", "  ", "\n"]).join(words) if i % 11 == 0 else " ".join(words))
    texts += [texts[0], texts[0], "", " \t\n", "one", "a\x0bb\x0cc", "loop " * 90, " wide space "]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def odd(spark):
    """Null ids and texts, repeated rows, an empty and a long text; and a column that clashes with internal names."""
    rows = [(None, None), (None, "x y z"), (3, None), (3, None), (4, ""), (5, "long " * 4000), (5, "long " * 4000)]
    df = frame(spark, rows)
    for name in ("key", "id", "text_", "node", "_id", "slot"):
        df = df.withColumn(name, F.lit(1))
    return df


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def turns(spark, logs):
    return spark.createDataFrame([(c, t, r, x) for c, log in logs for t, (r, x) in enumerate(log)], "conv_id long, turn long, role string, text string")


def test_chat_collapse(spark):
    rng = random.Random(1)
    logs = []
    for c in range(40):
        log = [("user" if i % 2 == 0 else "assistant", rng.choice("ab")) for i in range(rng.randint(1, 6))]
        logs.append((c, log))
    logs.append((99, [("user", "x")] * 600))  # longer than a block
    logs.append((98, [("user", "x")] * 300))
    got = {(r.conv_id, r.n_turns, r.n_logged, r.text) for r in chat.maximal_conversations(turns(spark, logs)).collect()}
    distinct = defaultdict(list)
    for c, log in logs:
        distinct[tuple(log)].append(c)
    want = set()
    for log, ids in distinct.items():
        if not any(len(o) > len(log) and o[: len(log)] == log for o in distinct):
            want.add((min(ids), len(log), len(ids), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in log)))
    assert got == want
    assert chat.maximal_conversations(turns(spark, logs).limit(0)).count() == 0
    strange = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "b"), (1, None, "user", None), (1, None, "user", None)], "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    rows = {r.conv_id: r.n_turns for r in chat.maximal_conversations(strange).collect()}
    assert rows == {None: 2, 1: 2}


# 2


def test_licenses(spark):
    files = [
        (0, "a/LICENSE", "Released under the MIT License."),
        (1, "a/b/x.py", "import os\n"),
        (2, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (3, "d/z.py", "nothing here"),
        (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/d/q.py", None),
        (6, None, "x"),
        (7, "LICENSES/other.txt", "licence of nothing known zebra quark flux"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in licenses.scan_licenses(df).collect()}
    assert got[0] == ("MIT", "own", None) and got[2] == ("Apache-2.0", "own", None) and got[4][0] == "GPL-3.0"
    assert got[1] == ("GPL-3.0", "inherited", "a/b") and got[5] == ("GPL-3.0", "inherited", "a/b")
    assert got[3] == got[6] == got[7] == (None, "none", None)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_spdx_headers(spark):
    ids = {i: name for name in licenses.TEMPLATES if name != "Proprietary" for i in ([name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name])}
    files = [(n, f"p{n}/x.c", f"/* SPDX-License-Identifier: {i} */\nint x;") for n, i in enumerate(ids)]
    files += [
        (100, "q/LICENSE", "Released under the MIT License."),
        (101, "q/a.c", "// SPDX-License-Identifier: Apache-2.0"),
        (102, "r/a.c", "// SPDX-License-Identifier: Zlib\n// mit"),
        (103, "s/a.js", "/*! thing v1.2 by some people of a town with a long name, written in 2020 | spdx-license-identifier: (Zlib OR BSD-3-Clause) WITH x | more words that say nothing */"),
    ]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {n: got[n] for n in range(len(ids))} == {n: (name, "own") for n, name in enumerate(ids.values())}
    assert got[100][0] == "MIT" and got[101] == ("Apache-2.0", "own") and got[102] == (None, "none") and got[103] == ("BSD-3-Clause", "own")


def test_license_cosine_is_tf_idf(spark):
    segs = [("mit license alpha", 3), ("apache license version 2.0 beta", 1)]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(segs)], "seg long, segment string, n long")
    got = {r.seg: r.cosine for r in licenses.match_segments(df, 0.0).collect()}
    parts = {(name, p) for name, t in licenses.TEMPLATES.items() for p in [t, *(q for q in t.split(". ") if len(q.split()) >= 4)]}
    terms = lambda s: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", s.lower()))
    df_ = Counter()
    for s, n in segs:
        for t in terms(s):
            df_[t] += n
    for name in licenses.TEMPLATES:
        for t in {t for m, p in parts if m == name for t in terms(p)}:
            df_[t] += 1
    total = sum(n for _, n in segs) + len(licenses.TEMPLATES)
    vec = lambda s: {t: c * (np.log((total + 1) / (df_[t] + 1)) + 1) for t, c in terms(s).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    for i, (s, _) in enumerate(segs):
        a = vec(s)
        want = max(sum(a[t] * b[t] for t in a.keys() & b.keys()) / norm(a) / norm(b) for _, p in parts for b in [vec(p)])
        assert got[i] == pytest.approx(want, abs=1e-8)


# 3

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PERSONAL = [
    "mail a.b+c@x-y.co.uk, or a@b and @c.d and q@w.e@r.t",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.2.3.255 and 1..2.3.4",
    "4539 1488 0343 6467, 4539-1488-0343-6467 4539148803436468 45391488034364671234567",
    "+1 (743) 555-3824 +12 +1234567890123456 +49-30-123456.",
    "4539148803436467 4539148803436467",
    "é" * 30 + " jane at mail dot com 5",
    "",
]


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_and_field(spark):
    rng = random.Random(5)
    texts = PERSONAL + ["".join(rng.choice("12.@+-( )ab5") for _ in range(300)) for _ in range(40)]
    df = frame(spark, list(enumerate(texts)))
    for r in pii.find_personal_data(df, masked=True).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
    got = {r.doc_id: r for r in pii.find_personal_data(df, masked=True).collect()}
    assert "email:31:51" in got[5].spans and "jane" not in got[5].masked
    assert got[4].spans.count("card") == 2  # the pattern takes both as one number and drops it
    assert pii.find_personal_data(odd(spark)).count() == 7 and pii.find_personal_data(df.limit(0)).count() == 0
    assert [r.text for r in pii.masked(odd(spark)).where("doc_id = 3").collect()] == [None, None]


def test_field_learns_and_decodes():
    crf = pii.trained()
    assert crf.plain_margin() > 0
    hit = total = 0
    for words, tags in pii.labelled_table(seed=99, rows=200):
        best = crf.viterbi(np.array([[crf.ids(w) for w in words]]), np.array([len(words)]))[0]
        hit += sum(pii.TAGS[b] == t for b, t in zip(best, tags))
        total += len(tags)
    assert hit / total > 0.98
    # Viterbi against all paths
    rng = np.random.default_rng(0)
    small = pii.Crf({}, np.zeros((3, 1, 3)), rng.normal(size=(3, 3)))
    e = rng.normal(size=(1, 4, 3))
    small.emissions = lambda ids: e
    paths = np.array(np.meshgrid(*[range(3)] * 4, indexing="ij")).reshape(4, -1).T
    value = lambda p: small.transition[0, p[0]] + e[0, range(4), p].sum() + small.transition[p[:-1], p[1:]].sum() + small.transition[p[-1], 0]
    assert small.viterbi(np.zeros((1, 4, 4), int), np.array([4]))[0].tolist() == max(paths, key=value).tolist()


# 4


def test_decontamination(spark):
    items = [(0, "Then Tom bought 5 apples for 3 dollars and gave Tom two more before the long winter came again"), (1, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"), (2, "too short"), (None, None)]
    docs = [
        (0, "Noise first. Then Tom bought 5 apples for 3 dollars and gave Tom two more before the long winter came again. And on."),
        (1, "Well. Then Anna bought 12 apples for 7 euros and gave Anna two more before the long winter came again"),
        (2, "Well. Then Anna bought 12 apples for 7 euros and gave Bert two more before the long winter came again"),
        (3, "THE QUICK brown*** fox jumps over the lazy dog, near a quiet river bank at dawn"),
        (4, "the quick brown fox jumps over something else entirely"),
        (5, None),
        (6, "too short"),
    ]
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.slots_changed for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (3, 1)} and got[(0, 0)] == 0 and got[(1, 0)] >= 3
    clean = decontaminate.without_contaminated(df.withColumn("key", F.lit(1)), bench)
    assert {r.doc_id for r in clean.collect()} == {2, 4, 5, 6} and "key" in clean.columns
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 == decontaminate.contaminated(df, bench.limit(0)).count()
    assert decontaminate.contaminated(odd(spark), bench).count() == 0


def test_names_anywhere_and_in_any_case(spark):
    items = [
        (0, "Tom has 3 apples. Tom buys 4 more apples from Ann. How many apples does Tom have?"),
        (1, "Then Tom bought 5 apples for 3 dollars and gave Tom two more before Ann and Bert came again"),
        (2, "Maria walks to the old mill every day. How many miles does she walk in 7 days?"),
    ]
    docs = [
        (0, "Bob has 5 apples. Bob buys 9 more apples from Sue. How many apples does Bob have?"),
        (1, items[1][1].lower()),
        (2, items[1][1].upper()),
        (3, items[1][1].lower().replace("5", "8")),
        (4, "So. Peter walks to the old mill every day. How many miles does she walk in 9 days?"),
        (5, "Bob has 5 apples. Ted buys 9 more apples from Sue. How many apples does Ann have?"),
        (6, "They walk to the old mill every day. How many hours is that?"),
    ]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 2)}


def test_items_without_literal_words(spark):
    items = [(0, "The Capital City Of France Is Paris And The Capital Of Spain Is Madrid"), (1, "12 + 7 = 19, 19 - 4 = 15, 15 * 2 = 30"), (2, "Paris Madrid 1900 Rome 2000")]
    docs = [(0, f"noted here: {items[0][1]}. and so on"), (1, items[0][1].upper()), (2, f"sums. {items[1][1]} done"), (3, "sums. 12 + 8 = 20, 20 - 4 = 16, 16 * 2 = 32"), (4, f"a list. {items[2][1]}"), (5, "The Capital City Of Spain Is Madrid And The Capital Of Italy Is Rome")]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.coverage) for r in got.collect()} == {(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (4, 2, 1.0)}


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    filler = " ".join(rng.choice(WORDS) for _ in range(decontaminate.BLOCK - 15))
    df = frame(spark, [(0, f"{filler} {item} {filler}"), (1, filler)])
    got = decontaminate.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.windows, r.item_windows) for r in got] == [(0, 26, 26)]


# 5


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    reference, mine = tokenizers.Tokenizer.from_file(vocabulary), bpe.transducer(vocabulary)
    rng = random.Random(3)
    tokens = [t.decode() for t in mine.ids if t.isalpha()]
    texts = ["", " ", "  a", "don't we'll  \n\n x", "a" * 5000, "ab<|endoftext|>cd", "é" * 3000, " " * 3000 + "x", "=-" * 3000, "\x1c\x85　  x", "日本語テキスト", "🎉👩‍👩‍👧 ok"]
    texts += ["".join(rng.choice(tokens) for _ in range(800)) for _ in range(4)] + ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126)])) for _ in range(800)) for _ in range(4)]
    texts.append(" ".join("".join(rng.choice(tokens)) for _ in range(60_000)))  # several chunks
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    ids = [rng.randrange(50257) for _ in range(2000)]
    assert mine.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    rows = bpe.round_trip(frame(spark, list(enumerate(texts))), vocabulary, keep_ids=True, keep_text=True).collect()
    for r in rows:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.round_trip(odd(spark), vocabulary).count() == 7


def test_lookahead_by_hand():
    # bc (rank 0) can take b from ab (rank 1); de (rank 0 here) can take d from cd, which then leaves c to bc
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2
    assert bpe.sufficient_lookahead([(b"d", b"e"), (b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 4
    assert bpe.sufficient_lookahead([]) == 0


# 6


@pytest.mark.parametrize("window,k", [(35, 16), (6, 3), (3, 1), (4, 4)])
def test_substrings_against_brute_force(spark, window, k):
    rows = corpus(window)
    split = {i: words_of(t) for i, t in rows}
    seen = Counter(tuple(w[s : s + window]) for w in split.values() for s in range(len(w) - window + 1))
    for r in substrings.drop_repeats(frame(spark, rows), window=window, k=k).collect():
        w = split[r.doc_id]
        gone = {j for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for j in range(s, s + window)}
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_substrings_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.drop_repeats(odd(spark)).collect())
    assert got == [(0, 0, 0), (0, 3, 0), (3, 0, 0), (3, 0, 0), (4, 0, 0), (5, 4000, 4000), (5, 4000, 4000)]
    assert substrings.drop_repeats(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.drop_repeats(odd(spark), k=40)


def test_anchors_are_fixed_by_their_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 6, 600).astype(np.uint64)
    place, grams = substrings.anchors(h, 10, 3)
    for s in range(len(place)):
        g = grams[s : s + 8]
        assert place[s] == s + int(g.argmin())


# 7


def brute_print(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("nodes", [4096, 3])
def test_simhash_against_brute_force(spark, nodes):
    rows = corpus(4, 80)
    prints = {i: brute_print(t) for i, t in rows}
    for radius in (0, 2, 6):
        want = groups([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= radius], prints)
        got = simhash.near_duplicates(frame(spark, rows), radius=radius, tree_nodes=nodes).collect()
        assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
        assert {r.doc_id: r.component_id for r in got} == want


def test_forest_of_dense_prints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = groups([(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2], range(len(values)))
    for nodes in (4096, 16):
        edges = simhash.forest_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, nodes).collect()
        assert len(edges) < 3 * len(values) * (1 if nodes == 4096 else 8)
        at = {v: i for i, v in enumerate(signed)}
        assert groups([(at[e.a], at[e.b]) for e in edges], range(len(values))) == want


def test_bk_tree():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    tree = simhash.BKTree(values)
    q, n = tree.search(values[:50], 3)
    assert set(zip(q.tolist(), n.tolist())) == {(a, b) for a in range(50) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= 3}


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.fp == 0} == {3}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(0)
    pairs = [(i, i + 1) for i in range(0, 120) if i % 40 != 39] + [(500, 500 + i) for i in range(50)] + [(7, 7), (rng.randrange(300, 330), rng.randrange(300, 330))]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    want = groups([p for p in pairs if p[0] != p[1]], {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k in got} and all(got[a] == got[b] for a, b in pairs if a != b)


def test_near_copies(spark):
    rows = corpus(6, 80)
    rng = random.Random(6)
    long = [rng.choice(WORDS) for _ in range(300)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:150], "x", *long[151:]])), (102, " ".join([*long[:50], "y", *long[51:]]))]
    sets = {i: {tuple(w.lower() for w in words_of(t)[s : s + 5]) for s in range(max(1, len(words_of(t)) - 4))} if words_of(t) else set() for i, t in rows}
    alike = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b)
    want = groups([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sets)
    got = near_copies.near_copies(frame(spark, rows)).collect()
    assert {r.id: r.group for r in got} == want
    assert {r.id for r in got if r.kept} == set(want.values())
    kept = near_copies.without_near_copies(frame(spark, rows).withColumn("key", F.lit(1)))
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert near_copies.without_near_copies(odd(spark)).count() == 5  # rows without words of id 3 (twice), x y z, the repeated row (twice)


# 8


def test_digests(spark):
    rows = corpus(8, 30)
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    for buckets in (1, 4, 50):
        got = {r.doc_id: r for r in digests.compare_with_edits(frame(spark, rows), buckets=buckets).collect()}
        for n, i in enumerate(order):
            t, following = texts[i], texts[order[(n + 1) % len(order)]]
            half = len(t) // 2
            new = t[: len(t) - half] + following[:half]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert r.fingerprint == digests.digest(t.encode()).hex() and r.edited_fingerprint == digests.digest(new.encode()).hex()
            assert 0 <= r.near_edited <= 1 and r.near_next == digests.likeness(digests.digest(t.encode()), digests.digest(following.encode()))
    assert digests.compare_with_edits(odd(spark)).count() == 7
    assert digests.compare_with_edits(odd(spark).limit(0)).count() == 0
    lone = digests.compare_with_edits(frame(spark, [(1, "abcd")])).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_triplets_by_hand(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(500))
    whole = digests.triplet_counts(data)
    assert whole.sum() == sum(max(0, len(data) - t[1]) for t in digests.TRIPLETS)
    monkeypatch.setattr(digests, "BLOCK", 7)
    assert (digests.triplet_counts(data) == whole).all()
    assert digests.likeness(digests.digest(data), digests.digest(data)) == 1.0
    a, b = digests.digest(b"\x00" * 9), digests.digest(data)
    assert digests.difference(a, b) == digests.difference(b, a) <= digests.most()
    assert set(digests.digest(b"")) == {0}


# 9


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(WORDS) + "###" for _ in range(60))
    kinds = [rng.random() < 0.75 for _ in range(900)]
    rows = [(i, good() if k else bad()) for i, k in enumerate(kinds)] + [(5000, None), (5001, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if i % 2], "doc_id long, quality int")
    scorer = quality.train(docs, labels)
    assert 0.6 < scorer.prior < 0.9
    got = {r.doc_id: r for r in quality.score(docs, scorer).collect()}
    import zlib

    held = [i for i in range(900) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    assert np.mean([got[i].predicted == kinds[i] for i in held]) > 0.97
    assert got[5000].score == got[5001].score and 0 <= got[5000].score <= 1
    # labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(docs, turned).weight, scorer.weight)
    none = quality.train(docs.limit(0), labels)
    assert quality.score(odd(spark), none).count() == 7 and {r.score for r in quality.score(odd(spark), none).collect()} == {0.5}


# 10


def test_sharding(spark):
    rows = [(i, "t" * (i % 5)) for i in range(1003)]
    df = frame(spark, rows + [(None, None), (None, None)]).repartition(7).withColumn("shard", F.lit(9))
    got = sharding.shuffle_into_shards(df, 24, rows_per_task=16).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows + [(None, None)] * 2)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle_into_shards(df.limit(0), 24).count() == 0
    # neither shard nor slot follows the input's order
    by = sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)
    assert abs(np.corrcoef([r.doc_id for r in by], [r.shard for r in by])[0, 1]) < 0.15


def test_hypergeometric_is_exact(spark):
    from math import comb

    marked, total, drawn, n = 7, 20, 9, 40_000
    got = Counter(r.x for r in spark.range(n).select(F.expr(sharding.hypergeometric(f"{marked}L", f"{total}L", f"{drawn}L", f"(id + 0.5d) / {n}d")).alias("x")).collect())
    for k in range(marked + 1):
        assert got[k] / n == pytest.approx(comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn), abs=2 / n)


def test_communication_matrix(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate((100, 0, 7, 300, 41))], "block long, n long")
    m = {r.block: r.row for r in sharding.communication_matrix(counts, 5, 3).collect()}
    assert {b: sum(x) for b, x in m.items()} == {0: 100, 1: 0, 2: 7, 3: 300, 4: 41}
    columns = np.array(list(m.values())).sum(0)
    assert columns.max() - columns.min() <= 1
    seeds = [sharding.communication_matrix(counts, 5, s).where("block = 0").first().row[0] for s in range(12)]
    assert len(set(seeds)) > 3 and 14 < np.mean(seeds) < 26


# Hot shards


@pytest.mark.parametrize("nodes", [256, 40])
def test_hot_bit_block(spark, nodes):
    """Thousands of fingerprints that share a third of their bits, some of them near each other."""
    rng = np.random.default_rng(nodes)
    values = (rng.integers(0, 1 << 42, 3000).astype(np.uint64) << np.uint64(22)) | np.uint64(12345)
    near = values[:300] ^ (np.uint64(1) << rng.integers(22, 64, 300).astype(np.uint64))
    dense = np.uint64(0xABC0000000012345) ^ (rng.integers(0, 1 << 10, 400).astype(np.uint64) << np.uint64(40))
    values = np.unique(np.concatenate([values, near, near[:100] ^ np.uint64(1 << 63), dense]))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    sizes = simhash.shards(prints, 2, nodes).groupBy("key", "part", "block").agg(F.count("*").alias("n"), F.sum("mine").alias("mine")).collect()
    assert max(r.n for r in sizes) <= 2.5 * nodes and max(r.mine for r in sizes) <= 1.5 * nodes
    links = []
    for i in range(len(values)):
        links += [(i, i + 1 + int(j)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2)]
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    edges = simhash.forest_edges(prints, 2, nodes).collect()
    assert groups([(at[e.a], at[e.b]) for e in edges], range(len(values))) == groups(links, range(len(values)))


@pytest.mark.parametrize("nodes", [2048, 5])
def test_near_copies_of_one_template(spark, nodes):
    """Copies of a form that differ in a word or two: all share bands, links cross blocks."""
    rng = random.Random(nodes)
    form = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(40):
        words = list(form)
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rng.choice(WORDS) for _ in range(120))) for i in range(20)]
    sets = {i: {tuple(t.split()[s : s + 5]) for s in range(len(t.split()) - 4)} for i, t in rows}
    want = groups([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
    got = near_copies.near_copies(frame(spark, rows), tree_nodes=nodes).collect()
    assert {r.id: r.group for r in got} == want


@pytest.mark.parametrize("rows,parts", [(0, 3), (1, 5), (10, 4), (23, 2), (60, 40), (200, 40)])
def test_few_rows_into_shards(spark, rows, parts):
    df = spark.range(rows).repartition(parts).withColumns({"block": F.lit(1), "row": F.lit("x"), "n": F.lit(None).cast("int")})
    got = sharding.shuffle_into_shards(df, 24).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted((r.id, r.block, r.row) for r in got) == [(i, 1, "x") for i in range(rows)]
    assert all(sizes[s] == rows // 24 + (s < rows % 24) for s in range(24))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_bins_by_bytes(spark):
    df = spark.range(400).withColumn("text", F.repeat(F.lit("t"), 5000)).withColumn("slot", F.lit(7))
    got = sharding.shuffle_into_shards(df, 3, bytes_per_task=50_000, slot_col="place").collect()
    assert {r.slot for r in got} == {7} and all(sorted(r.place for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())


def test_hypergeometric_at_every_small_size(spark):
    cases = spark.range(7).selectExpr("id as total").selectExpr("total", "explode(sequence(0L, total)) as marked").selectExpr("*", "explode(sequence(0L, total)) as drawn").selectExpr("*", "explode(array(0.0001d, 0.3d, 0.5d, 0.9d, 0.9999d)) as u")
    for r in cases.select("*", F.expr(sharding.hypergeometric("marked", "total", "drawn", "u")).alias("x")).collect():
        assert max(0, r.marked + r.drawn - r.total) <= r.x <= min(r.marked, r.drawn)


def test_matrix_of_many_blocks(spark):
    sizes = [(i * 7) % 50 if i % 3 else 0 for i in range(2000)]
    counts = spark.createDataFrame(list(enumerate(sizes)), "block long, n long")
    matrix = {r.block: r.row for r in sharding.communication_matrix(counts, 24, 3).collect()}
    assert [sum(matrix[i]) for i in range(2000)] == sizes and min(map(min, matrix.values())) >= 0
    columns = np.array(list(matrix.values())).sum(0)
    assert columns.max() - columns.min() <= 1


# 9, on all unlabelled rows


def test_quality_of_groups_ties_and_odd_rows(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(WORDS) + "###" for _ in range(60))
    kinds = [rng.random() < 0.75 for _ in range(900)]
    rows = [(i, good() if k else bad()) for i, k in enumerate(kinds)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(None, good())] * 20 + [(3000, "word " * 300_000), (3000, "word " * 300_000)]
    docs = frame(spark, rows).withColumns({"_score": F.lit("x"), "score": F.lit(1), "kept": F.lit(2)})
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if i % 2] * 2, "doc_id long, quality int").withColumn("x", F.lit(1))
    scorer = quality.train(docs, labels, rows_per_fit=150)
    assert 0.6 < scorer.prior < 0.9
    got = quality.score(docs, scorer, keep=("_score", "kept")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {r._score for r in got} == {"x"} and {r.kept for r in got} == {2}
    assert len({by[i].score for i in [0, *range(2000, 2030)]}) == 1  # equal texts, equal scores
    held = [i for i in range(900) if by[i].held_out]
    assert np.mean([by[i].predicted == kinds[i] for i in held]) > 0.97
    assert quality.score(docs.limit(0), scorer).count() == 0
    assert set(quality.train(docs, labels.limit(0)).weight) == {0.0}


# 4, one map of slots for each document and item


def brute_contaminated(docs, items, window=5, share=0.8):
    """Every window of every document against every window of every item's readings, without hashes."""
    out = set()
    canon = decontaminate.Canon()
    for d, text in docs:
        words = text.split()
        if not words:
            continue
        at, ids, number, unit = canon.tokens(words, np.array([0]))
        fits = {decontaminate.NUMBER: number, decontaminate.UNIT: unit, decontaminate.NAME: canon.fact[5][ids]}
        core = [canon.core[i] for i in ids]
        for i, item in items:
            own, readings = canon.readings(item.split())
            name = [canon.core[x] for x in own]
            n = len(own) - window + 1
            if 0 < len(own) < window:
                if any(core[s : s + len(own)] == name for s in range(len(core))):
                    out.add((d, i))
                continue
            for nth, kind in enumerate(readings):
                fit = [p for p in range(n) if sum(kind[p : p + window] == 0) >= 3]
                if not fit or nth and 2 * len(fit) < n:
                    continue
                seen = []
                for p in fit:
                    for s in range(len(core) - window + 1):
                        if all(name[p + q] == core[s + q] if kind[p + q] == 0 else fits[kind[p + q]][s + q] for q in range(window)):
                            seen.append((p, [(p + q, int(kind[p + q]), name[p + q], core[s + q]) for q in range(window) if kind[p + q]]))
                values = defaultdict(lambda: defaultdict(set))
                for p, slots in seen:
                    for place, k, a, b in slots:
                        values[k, a][place].add(b)
                good = lambda k, a, b: sum(b in v for v in values[k, a].values()) > len(values[k, a]) / 2  # noqa: B023, E731
                kept = {p for p, slots in seen if all(good(k, a, b) for _, k, a, b in slots)}
                if len(kept) / len(fit) >= share:
                    out.add((d, i))
    return out


def test_one_map_of_slots(spark):
    two = "Then Tom bought 5 apples for 3 dollars and gave Tom two more before the long winter came again"
    long = "On the way to the old mill near the river Tom met a man who sold 7 red hats and one blue coat for 9 coins so that Tom could walk home warm and dry"
    items = [(0, two), (1, long), (2, "quiet grey harbour"), (3, "What is 12 + 7 ?")]
    docs = [
        (0, "Well. Then Anna bought 12 apples for 7 euros and gave Bert two more before the long winter came again"),
        (1, "Well. Then Anna bought 12 apples for 7 euros and, as was said, gave Bert two more before the long winter came again"),
        (2, "Well. Then Anna bought 12 apples for 7 euros and, so it was said, gave Anna two more before the long winter came again"),
        (3, long.replace("Tom met", "Bob met")),  # a name changed in one place
        (4, long.replace("Tom", "Bob").replace("7", "8")),
        (5, "at the Quiet, grey Harbour we stood"),
        (6, "grey quiet harbour"),
        (7, "Then Anna bought 12 apples for 7 euros and gave Anna two more before the long winter came again. Then Bert bought 1 apples for 2 euros and gave Bert two more before the long winter came again"),
        (8, "so what is 12 + 7 ? nothing"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), bench, short_items=True).collect()}
    assert set(found) == {(3, 1), (4, 1), (5, 2), (7, 0), (8, 3)} == brute_contaminated(docs, items)
    assert found[5, 2].coverage == 1.0 and found[4, 1].slots_changed == 2
    assert (5, 2) not in {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}


@pytest.mark.parametrize("bits", [25, 7])
def test_decontamination_against_brute_force(spark, monkeypatch, bits):
    """Items copied with insertions, changed names and numbers, cut short; a full filter (7 bits) changes nothing."""
    monkeypatch.setattr(decontaminate, "FILTER", bits)
    rng = random.Random(bits)
    names, plain = ["Anna", "Bert", "Carl", "Dora"], [f"word{i}" for i in range(60)]
    items = []
    for i in range(25):
        words = [rng.choice(plain) if rng.random() < 0.75 else rng.choice([rng.choice(names), str(rng.randint(2, 40)), "km"]) for _ in range(rng.randint(3, 30))]
        items.append((i, " ".join(words)))
    docs = []
    for d in range(90):
        words = items[rng.randrange(25)][1].split()
        swap = dict(zip(names, rng.sample(names, 4)))
        if d % 3 == 0:
            words = [swap.get(w, w) for w in words]
        if d % 5 == 0:
            words = [str(int(w) + 3) if w.isdigit() else w for w in words]
        if d % 4 == 0:
            words.insert(rng.randrange(len(words)), "and then")
        if d % 7 == 0:
            words[rng.randrange(len(words))] = "Emil"
        lead = [rng.choice(plain) for _ in range(rng.randint(0, 20))]
        docs.append((d, " ".join([*lead, *words[: max(2, int(len(words) * rng.choice([0.5, 0.85, 1, 1])))], *lead])))
    docs += [(200, ""), (201, "a"), (202, docs[0][1]), (202, docs[0][1])]
    bench = spark.createDataFrame([*items, (3, items[3][1]), (77, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench, short_items=True).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and len(want) > 25


# 3, cuts within plain words


def test_cut_texts_are_decoded_as_whole_ones():
    crf = pii.trained()
    assert crf.cut is not None and crf.cut < 16
    rng = random.Random(8)
    odd = ["at", "dot", "(at)", "[dot]", "call", "page", "jane", "jane@x.de", "4539", "1488", "0343", "6467", "10.0.0.7", "10[.]0[.]0[.]7", "(743)", "555-3824", "+1", "mail", "example.com", "x" * 70, "4" * 70, "a-b" * 40, "é", "***", "(AT)", "DOT", "com", "v1.2", "@", "..."]
    assert all(crf.odd[w] == (crf.ids(w) != crf.plain) for w in odd + [f"{a}{b}" for a in odd for b in (".", "!x", "7", "_", "'")])
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.randint(0, 9)):
            words += [rng.choice(("river", "Über", "the", "niño,", "x" * 80)) for _ in range(rng.choice((0, 1, 2, crf.cut, 2 * crf.cut + 1, 2 * crf.cut + 2, 2 * crf.cut + 3, 40)))]
            words += [rng.choice(odd) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice((" ", "\n", " \t")).join(words) + rng.choice(("", " ", "\n")))
    for t in texts:
        starts, ends, _ = pii._words(crf, t)
        assert [t[a:b] for a, b in zip(starts, ends)] == words_of(t)
        # the tags themselves, not only the spans that pass their checks
        ids = np.array([[crf.ids(w) for w in words_of(t)]]) if words_of(t) else None
        whole = [] if ids is None else crf.viterbi(ids, np.array([len(starts)]))[0].tolist()
        cut = [0] * len(starts)
        for a, b in pii.stretches(len(starts), pii._words(crf, t)[2], crf.cut):
            around = np.zeros((1, b - a + 2, 4), np.int64)
            low, high = max(0, a - 1), min(len(starts), b + 1)
            around[0, low - a + 1 : high - a + 1] = ids[0, low:high]
            cut[a:b] = crf.best_path(crf.emissions(around)[:, 1:-1], np.array([b - a]))[0].tolist()
        assert cut == whole
    assert [sorted(x) for x in pii.field_spans(crf, texts)] == [sorted(x) for x in pii.field_spans(crf, texts, None)]


def test_words_in_chunks(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("ab7 \n\x0b　") for _ in range(5000))
    want = pii._words(pii.trained(), text)
    for size in (1, 7, 300):
        monkeypatch.setattr(pii, "CHUNK", size)
        got = pii._words(pii.trained(), text)
        assert all((a == b).all() for a, b in zip(got, want))


#: Written by hand, not by the rule that made the training table: texts and the personal data in them.
WRITTEN = [
    ("Write to anna.keller (at) uni-mainz (dot) de before Friday.", ["email"]),
    ("Reach me under peter dot schmidt at gmail dot com please", ["email"]),
    ("my address is bob[at]fastmail[dot]org thanks", ["email"]),
    ("Contact: maria@example.org or the front desk", ["email"]),
    ("The server answered from 192[.]168[.]4[.]20 twice", ["ip"]),
    ("Traffic to 10.11.12.13 was dropped", ["ip"]),
    ("block 8(.)8(.)8(.)8 at the gate", ["ip"]),
    ("She paid with 4539.1488.0343.6467 yesterday", ["card"]),
    ("Card 4539 1488 0343 6467 expires soon", ["card"]),
    ("number 4539-1488-0343-6467 was charged", ["card"]),
    ("Call (030) 555-1234 after six", ["phone"]),
    ("fax: 415-555-2671", ["phone"]),
    ("tel 415.555.2671 or write", ["phone"]),
    ("ring +49 30 1234567 now", ["phone"]),
    ("mobile +1 (415) 555-2671.", ["phone"]),
    ("She was born in 1984 and moved in 2003.", []),
    ("Chapter 12, page 345, line 6", []),
    ("The total came to 12,500 units at 3.5 each", []),
    ("Version 2.10.4 was released on 2021-03-04 at 12:30", []),
    ("He looked at the dot on the map and at the river", []),
    ("Meet us at noon at the old mill.", []),
    ("order 20210304 with 17 items", []),
    ("hash d41d8cd98f00b204e9800998ecf8427e matched", []),
    ("see section 4.2.1 and table 7", []),
    ("a score of 3-2 after 90 minutes", []),
    ("priced at 19.99 (was 24.99)", []),
    ("ISBN 978-3-16-148410-0 in stock", []),
    ("the @ sign is old", []),
    ("follow @riverside for news", []),
    ("rooms 101, 102, 103 and 104 are free", []),
]


def test_field_on_texts_written_by_hand():
    """Kinds found in each text, base patterns and field together."""
    crf = pii.trained()
    hit = wrong = missed = 0
    for (text, want), (_, spans) in zip(WRITTEN, pii.all_spans(crf, [t for t, _ in WRITTEN])):
        got = [k for k, _, _ in spans]
        hit += len(set(got) & set(want))
        wrong += len(got) - len(set(got) & set(want))
        missed += len(set(want) - set(got))
    print(f"precision {hit / (hit + wrong):.2f}, recall {hit / (hit + missed):.2f}")
    assert hit / (hit + wrong) >= 0.8 and hit / (hit + missed) >= 0.7


# 5, every piece through the transducer


def vocabulary_of(merges):
    import json

    names = bpe.byte_characters()
    as_text = lambda b: "".join(names[x] for x in b)
    tokens = [bytes([b]) for b in range(256)] + list(dict.fromkeys(a + b for a, b in merges))
    return json.dumps({"model": {"vocab": {as_text(t): i for i, t in enumerate(tokens)}, "merges": [f"{as_text(a)} {as_text(b)}" for a, b in merges]}, "added_tokens": []}).encode()


def test_transducer_on_random_merge_lists(monkeypatch):
    """Windows of a few bytes give what merging the whole piece gives."""
    monkeypatch.setattr(bpe, "STEP", 3)
    rng = random.Random(13)
    cut = 0
    for _ in range(300):
        known = [b"a", b"b", b"c"]
        merges = []
        for _ in range(rng.randint(0, 9)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges and len(pair[0] + pair[1]) < 7:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        machine = bpe.Transducer(vocabulary_of(merges))
        for _ in range(12):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
            size = rng.randint(1, 9)
            assert list(machine.stream(data[i : i + size] for i in range(0, len(data), size))) == machine._merge(data)
            cut += len(data) > machine.step + machine.lookahead
    assert cut > 1000


def test_without_memory(monkeypatch, vocabulary):
    machine = bpe.transducer(vocabulary)
    rng = random.Random(14)
    tokens = [t.decode() for t in machine.ids if t.isalpha()]
    texts = ["don't  we\n\nsay so " * 40, "x" * 3000, " " * 700, "".join(rng.choice(tokens) for _ in range(500)), " ".join(rng.choice(tokens) for _ in range(500)), ""]
    want = [machine.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    bare = bpe.Transducer(open(vocabulary, "rb").read())
    assert [bare.encode(t) for t in texts] == want
    assert max(map(len, bare._units), default=0) == max(map(len, bare._pieces), default=0) == 0


def test_round_trip_of_no_rows(spark, vocabulary):
    assert bpe.round_trip(odd(spark).limit(0), vocabulary, keep_ids=True, keep_text=True).count() == 0
    got = bpe.round_trip(odd(spark), vocabulary, keep_text=True).collect()
    assert sorted(r.decoded for r in got) == sorted(["", "", "", "", "x y z", "long " * 4000, "long " * 4000])


# 8, ids that fill several ranges


@pytest.mark.parametrize("buckets", [1, 6, 40])
def test_digests_of_hot_ids(spark, buckets):
    rng = random.Random(15)
    rows = [(None, f"none {i} " * rng.randint(1, 9)) for i in range(60)] + [(7, f"seven {i} " * rng.randint(1, 9)) for i in range(60)] + [(i, f"own {i}") for i in range(20, 60)] + [(3, "same text")] * 12 + [(2, None), (1, "")]
    df = frame(spark, rows).withColumns({"bucket": F.lit(1), "_own": F.lit(2), "_hash": F.lit("x")})
    hashed = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    if buckets == 1:  # no id fills several ranges, so texts alone decide
        order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text))
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(a.text) // 2
        want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in digests.compare_with_edits(df, buckets=buckets).collect()) == want


# 1, without rendering


def test_chat_collapse_without_texts(spark):
    logs = [(0, [("user", "a")]), (1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("assistant", "b")]), (3, [("user", "c")])]
    got = chat.maximal_conversations(turns(spark, logs), render=False)
    assert got.columns == ["conv_id", "n_turns", "n_logged"] and {tuple(r) for r in got.collect()} == {(1, 2, 2), (3, 1, 1)}


# 2, wrapped headers and many folders


def wrapped(text, width, leader):
    lines, now = [], ""
    for w in text.split():
        if now and len(now) + len(w) > width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return "\n".join(leader + x for x in [*lines, now])


def test_wrapped_headers(spark):
    files, want = [], {}
    for n, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for m, (leader, before, after) in enumerate([("# ", "#!/bin/sh\n", "\nx = 1\n"), (" * ", "/*\n", "\n */\nint x;\n"), ("", "/*\n", "\n*/\ncode();\n"), ("", "Some words first.\n\n", "\n\nOther words follow.")]):
            files.append((100 * n + m, f"p{n}/q{m}/x", before + wrapped(text, 60, leader) + after))
            want[100 * n + m] = name
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == want
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3"
    rows = [(0, "a", notice), (1, "b", notice.replace("\n", "\n# ")), (2, "c", None), (2, "c", None), (3, "d/LICENSE", notice + " of the License\n" * 1), (4, "e", "word " * 200_000)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == 6 and {r.doc_id: r.license for r in got} == {0: "GPL-3.0", 1: "GPL-3.0", 2: None, 3: "GPL-3.0", 4: None}
    assert list(licenses.header_blocks("a\nb\n\nlicense x\n// y\n// License z\nnext\n\n/* copyright\nme */\n")) == ["y License z", "copyright me"]


def test_inheritance_in_many_folders(spark):
    rng = random.Random(16)
    folder = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
    texts = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "nothing known here"}
    files = []
    for i in range(400):
        named = rng.random() < 0.15
        says = rng.choice(list(texts)) if named or rng.random() < 0.1 else None
        at = folder()
        files.append((i, f"{rng.choice(['', '/'])}{at}{'/' * bool(at)}{'LICENSE' if named else f'f{i}.txt'}", texts[says], says, at, named))
    given = defaultdict(set)
    for _, _, _, says, at, named in files:
        if named and says:
            given[at].add(says)
    got = licenses.scan_licenses(spark.createDataFrame([f[:3] for f in files], "doc_id long, path string, text string")).collect()
    for r in got:
        _, _, _, says, at, _ = files[r.doc_id]
        parts = at.split("/") if at else []
        above = next((p for p in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if given.get(p)), None)
        if says:
            assert (r.license, r.origin) == (says, "own")
        elif above is None:
            assert (r.license, r.origin) == (None, "none")
        else:
            assert r.license in given[above] and (r.origin, r.inherited_from) == ("inherited", above)
    for at in given:  # a folder with several gives one of them to all
        assert len({r.license for r in got if r.inherited_from == at and r.origin == "inherited"}) <= 1


# Recall of near copies


def test_near_copy_recall_on_the_small_tables(spark):
    """All pairs of the table at a similarity of 0.8 or more lie in one group, and groups hold nothing else."""
    table = Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("no tables here")
    docs = spark.read.parquet(str(table))
    sets = {r.doc_id: {tuple(w) for w in (lambda ws: [ws[i : i + 5] for i in range(max(1, len(ws) - 4))] if ws else [])(words_of((r.text or "").lower()))} for r in docs.collect()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = Counter((a, b) for ids in by.values() if len(ids) > 1 for n, a in enumerate(ids) for b in ids[n + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [i for i, s in sets.items() if not s]
    got = {r.id: r.group for r in near_copies.near_copies(docs).collect()}
    assert len(links) > 20 and all(got[a] == got[b] for a, b in links)
    assert got == groups([*links, *zip(empty, empty[1:])], sets)
