"""SimHash near-dedup, the conversation trie and spelling variants against brute force, in tiles and ranges of every size, and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import conversations, queries, radix, simhash, spelling, tiles

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
CLASHING = ("id", "fp", "key", "word", "n", "here", "there", "a", "b", "count", "words", "_id", "_text")


def with_more(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})


# tiles


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_tiles_hold_every_pair_once(spark, block):
    rng = random.Random(1)
    rows = [(k, i) for k in range(30) for i in rng.sample(range(100), rng.choice([1, 2, 3, 12, 40]))]
    df = spark.createDataFrame(rows, "key long, item long")
    seen = Counter()
    for r in tiles.tiles(df, F.col("item"), block).collect():
        assert len(r.here) <= 8 * block
        sizes = np.array([len(r.here)]), np.array([len(r.there or [])])
        flat = r.here + (r.there or [])
        for i, j in tiles.pairs(np.array([0]), *sizes):
            seen.update((r.key, *sorted((flat[x], flat[y]))) for x, y in zip(i, j, strict=True))
    members = defaultdict(list)
    for k, i in rows:
        members[k].append(i)
    want = {(k, *sorted((x, y))) for k, m in members.items() for x in m for y in m if x < y}
    assert set(seen) == want and set(seen.values()) == {1}


def test_pairs_of_many_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "PAIRS", 7)
    at, here, there = np.array([0, 4, 9]), np.array([4, 2, 3]), np.array([0, 3, 0])
    got = sorted((int(x), int(y)) for i, j in tiles.pairs(at, here, there) for x, y in zip(i, j, strict=True))
    assert got == sorted([(x, y) for x in range(4) for y in range(x + 1, 4)] + [(x, y) for x in (4, 5) for y in (6, 7, 8)] + [(9, 10), (9, 11), (10, 11)])


# SimHash


def simhash_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    votes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(len(words) - 2, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in votes) > len(votes))


def components_of(ids, linked):
    of = {x: x for x in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and linked(x, y):
                p, q = find(x), find(y)
                of[max(p, q)] = min(p, q)
    return {x: find(x) for x in ids}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghÄé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append(rng.choice([" ", "\n", " \t "]).join(copy))
    texts += [None, "", "  \n ", "one", "One", "one two", "one two three", "x" * 5000 + " y z", "lorem ipsum dolor " * 40_000]
    rows = list(enumerate(texts))
    prints = {i: simhash_of(t) for i, t in rows}
    want = components_of(list(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 3)
    got = simhash.near_duplicates(with_more(spark.createDataFrame(rows, DOCS))).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints and len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def planted_prints(n, seed=3):
    """Clouds of fingerprints a few bits apart, chains of them among others, zero and all ones."""
    rng = random.Random(seed)
    out = [0, 1, 7, 15, 2**64 - 1, 2**64 - 8, 2**63]
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 30])):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_every_link_of_the_grid(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "tiles", lambda members, item: tiles.tiles(members, item, block))
    prints = planted_prints(500)
    rows = [(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "id long, fp long"))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect()}
    want = components_of(range(len(prints)), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 3)
    assert got == {i: (p, want[i]) for i, p in enumerate(prints)}


def test_forest_connects_the_same():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 30), (200, 900)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = simhash.forest(n, i, j)
        assert len(a) < max(n, 1)
        label = lambda x, y: components_of(range(n), lambda p, q, s=set(zip(x.tolist(), y.tolist(), strict=True)): (p, q) in s or (q, p) in s)
        assert label(a, b) == label(i, j)


def test_simhash_awkward(spark):
    rows = [(5, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "e f g h"), (9, "e f g h"), (None, None), (11, None), (10, "")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (None, None), (7, 5), (7, 5), (9, 5), (None, None), (11, 10), (10, 10)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


# conversations


def test_radix_tree_layouts():
    for width, n in ((1, 256), (2, 3000), (7, 500)):
        rng = random.Random(n)
        keys = list({bytes(rng.randrange(256 if width < 7 else 3) for _ in range(width)) + b"x" * rng.choice([0, 3]) for _ in range(n)})
        tree = radix.Tree()
        for no, k in enumerate(keys):
            tree.insert(k, no)
        found, rooms = [], set()

        def walk(node, path):
            rooms.add(node.room)  # noqa: B023
            path += node.prefix
            if node.value >= 0:
                found.append((path, node.value))  # noqa: B023
            for byte in range(256):
                kid = node.child(byte)
                if kid is not None:
                    walk(kid, path + bytes([byte]))
            assert node.count == sum(node.child(b) is not None for b in range(256)) == sum(1 for _ in node.children())
            assert node.value >= 0 or node.count > 1

        walk(tree.root, b"")
        assert sorted(found) == sorted((k, no) for no, k in enumerate(keys))
        if width == 1:
            assert 256 in rooms
        if width == 2:
            assert rooms >= {4, 16}


def trie_of(convs):
    """Brute force: every prefix of every sequence."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    kids = Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not kids[p]
            below[p[:d]][1] += (len(m) - 1) * words
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], *below[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def regrown(rows):
    """Brute force of the contract's rebuilding; turns of one number in the order of their ids."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def some_turns(seed, convs=260, long=()):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = 120 if c in long else rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c  d e", "", None, "x", "y z"])) for t in range(n)]
    same = [(t, "user", f"turn {t}") for t in range(90)]  # a chain, and conversations that are parts of each other
    for c in range(convs, convs + 90, 3):
        rows += [(c, *t) for t in same[: c - convs]]
    rows += [(c, *t) for c in range(2000, 2700) for t in same[:3]]
    rows += [(3, 1, "user", "twice"), (3, 1, "user", "again"), (3, None, "user", "first"), (None, 1, "user", "nowhere"), (41, 0, "user", "k")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "piece"), [(1, 512), (4, 7), (23, 512), (151, 64)])
def test_trie_in_any_number_of_ranges(spark, monkeypatch, parts, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = some_turns(parts, long=(7, 20, 31))
    df = with_more(spark.createDataFrame(rows, TURNS)).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = conversations.conversation_trie(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)
    assert got == trie_of(regrown(rows))


def test_trie_awkward(spark):
    assert conversations.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(19, 0, "u", "only"), (None, 0, "u", "x"), (-5, None, None, None), (-5, None, None, None), (2**40, 0, "u", "w " * 100_000)]
    got = conversations.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 3 and root.conv_id == -5 and root.parent_conv_id is None


# spelling


def spelling_of(rows, length=6, least=5, times=5, every=199):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) if v else None for w, v in close.items()}
    form = {w: b if b and words[b] >= times * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(close[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def misspelt(seed=6):
    rng = random.Random(seed)
    stems = ["aaaaaa", "aaaaaaa", "ababababab", "colour", "señorita", "éclairs", "x" * 40, "organisation", "abcdefghijklmnopqrstuvwxyz"]
    stems += ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words = []
    for w in stems:
        words += [w] * rng.choice([5, 30, 160])
        for _ in range(4):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            words += [w[:at] + rng.choice("abcéx") * (kind != 0) + w[at + (kind != 1) :]] * rng.choice([1, 5, 6, 30])
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    return [(no, rng.choice([" ", ", ", "1"]).join(words[no * 40 : no * 40 + 40])) for no in range(len(words) // 40 + 1)]


@pytest.mark.parametrize(("block", "every", "cells"), [(1024, 199, 1 << 22), (4, 7, 1 << 22), (1024, 7, 64)])
def test_spelling_against_all_pairs(spark, monkeypatch, block, every, cells):
    monkeypatch.setattr(spelling, "tiles", lambda members, item: tiles.tiles(members, item, block))
    rows = misspelt()
    got = spelling.variants(with_more(spark.createDataFrame(rows, DOCS)), every=every).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == spelling_of(rows, every=every)


def test_spelling_awkward(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None), (None, "letters " * 4), (2, ""), (2, "LETTERS letters lettersÀ"), (3, "É" * 6 + " é"), (4, "a" * 100_000), (5, "a" * 100_000)] * 5
    got = spelling.variants(spark.createDataFrame(rows, DOCS), every=10**9).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near) for r in got) == sorted(
        [("letters", None, "letters", 30, 1), ("lettersÀ", "letters", "letters", 5, 1), ("É" * 6, None, "É" * 6, 5, 0), ("a" * 100_000, None, "a" * 100_000, 10, 0)]
    )


# the queries against their SQL


@needs_tables
@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_spelling"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(str, df.select(*want.columns).collect())) == sorted(map(str, spark.createDataFrame(want.fetchall(), df.select(*want.columns).schema).collect()))


# held-out figures on the given tables

TENTH = "/root/testdata/sf0.1"


def held_out_figures(spark, name, target, least):
    """Recall and precision at the query's threshold, and the area under the curve, over the held-out fold."""
    labels = spark.read.parquet(f"{TENTH}/labels.parquet").select("doc_id", F.col(target).alias("y")).filter("y IS NOT NULL")
    rows = queries.queries()[name](spark, TENTH).filter("held_out").join(labels, "doc_id").select("score", "y").toPandas()
    score, y = rows["score"].to_numpy(), rows["y"].to_numpy() == 1
    said = score >= least
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):  # ties share a rank
        rank[score == v] = rank[score == v].mean()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    out = (said & y).sum() / y.sum(), (said & y).sum() / max(said.sum(), 1), auc
    print(name, *(f"{x:.3f}" for x in out))
    return out


@pytest.mark.skipif(not os.path.isdir(TENTH), reason="no tables here")
def test_toxicity_holds_up(spark):
    recall, precision, auc = held_out_figures(spark, "op8_toxicity", "toxic", 0.5)
    assert recall >= 0.9 and precision >= 0.98 and auc >= 0.96


@pytest.mark.skipif(not os.path.isdir(TENTH), reason="no tables here")
def test_quality_holds_up(spark):
    recall, precision, auc = held_out_figures(spark, "op9_quality", "quality", 0.3)
    assert recall >= 0.98 and precision >= 0.93 and auc >= 0.97
