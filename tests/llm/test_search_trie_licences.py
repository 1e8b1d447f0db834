"""Ranked search, the prefix trie and the licence scan against brute force on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftlog.llm import lexical, licences, trie
from weftlog.llm.base import tuned
from weftlog.llm.words import words_of

CLASH = "doc_id bigint, text string, term int, raw string, n bigint, item_id string, score int"
LONG = "alpha beta gamma delta " * 5000
ODD = [(1, None), (2, ""), (3, " \t\n--"), (None, "alpha beta"), (5, LONG), (6, LONG), (7, "Alpha BETA É é x1"), (7, "Alpha BETA É é x1"),
       (8, "gamma_gamma-9"), (9, "漢字 ÅÄÖ beta beta"), (10, "delta" * 3), (11, "beta")]


def term_list(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def test_words_follow_the_patterns():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices([chr(c) for c in range(128)] + list("éÉ漢\xa0 😀"), k=40))
        assert [w.decode() for w in words_of(text.encode())] == term_list(text)
    assert words_of(None) == words_of(b"") == []


# --- ranked search --------------------------------------------------------------


def ranked(docs, items, k):
    terms = [(i, term_list(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term_list(t))
    out = Counter()
    for i, want in asked.items():
        found = []
        for d, ts in terms:
            tf, m = Counter(ts), 50 + (50 * len(ts) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in want if tf[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        for r, (s, known, d) in enumerate(sorted(found)[:k]):
            out[(i, r + 1, d if known else None, -s)] += 1
    return out


def test_shared_sums_equal_plain_ones():
    rng = np.random.default_rng(3)
    for _ in range(60):
        terms = int(rng.integers(1, 30))
        items = [list(rng.choice(terms, size=int(rng.integers(1, terms + 1)), replace=False)) for _ in range(int(rng.integers(1, 12)))]
        graph = lexical.share_sums(items, terms)
        acc = np.zeros((graph.size, 4), np.int64)
        acc[:terms] = rng.integers(0, 1 << 40, (terms, 4))
        want = np.array([acc[i].sum(axis=0) for i in items])
        assert (graph.totals(acc) == want).all()
        assert graph.additions <= sum(len(i) - 1 for i in items)
    same = lexical.share_sums([[0, 1, 2, 3]] * 5, 4)
    assert same.additions == 3 and len(set(same.roots.tolist())) == 1


@pytest.mark.parametrize("k,block_bytes,bound_docs", [(2, 1_000_000, 100), (3, 20, 100), (50, 1_000_000, 2)])
def test_ranks_equal_brute_force(spark, k, block_bytes, bound_docs):
    docs = tuned(spark).createDataFrame([(i, t, 1, "x", 5, "y", 3) for i, t in ODD], CLASH).repartition(3)
    items = [(1, "alpha beta, GAMMA"), (2, None), (3, "nothing known"), (None, "beta delta"), (5, "beta"), (5, "Gamma é"), (6, "alpha beta gamma")]
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    got = lexical.rank(docs, asked, k, block_bytes=block_bytes, bound_docs=bound_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(ODD, items, k)


def test_ranks_with_many_ties_and_small_matrices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 40)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(4)))) for i in range(400)]
    items = [(i, " ".join(rng.choices("abcdefg", k=3))) for i in range(9)]
    got = lexical.rank(tuned(spark).createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                       spark.createDataFrame(items, "item_id bigint, text string"), 7, bound_docs=50)
    assert Counter(map(tuple, got.collect())) == ranked(docs, items, 7)


def test_best_rows_survive_settling():
    best = lexical.Best(2, 3, None)
    best.room = 4
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 6, (2, 200))
    for a in range(0, 200, 10):
        best.add(scores[:, a:a + 10], np.ones(10, np.int64), np.arange(a, a + 10))
    item, score, _, ids = best.settled()
    for i in range(2):
        want = sorted((-s, d) for d, s in enumerate(scores[i]) if s > 0)[:3]
        assert list(zip(-score[item == i], ids[item == i])) == want


def test_search_of_empty_tables(spark):
    none = tuned(spark).createDataFrame([], CLASH)
    one = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert lexical.rank(none, one).count() == 0
    assert lexical.rank(tuned(spark).createDataFrame(ODD, "doc_id bigint, text string"), one.where("false")).count() == 0


# --- prefix trie ----------------------------------------------------------------


def plain_trie(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = Counter()
    for path, cs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = sorted(c for c in cs if len(rebuilt[c]) == len(path))
        out[(min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs),
             sum(1 for q in members if q and q[:-1] == path), len(leaves),
             sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([*range(0, 12), 100, 101, 102, 150, 199, 200, 201, 305, 306, -3, -100])
        rows.append((c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bb", None, "é漢😀"])))
    rows += [(None, 1, "user", "no conversation"), (7, 1, "user", "a"), (7, 1, "user", "a")]
    rows += [(400 + k, t, "user", "same opening" if t == 0 else f"turn {t}") for k in range(40) for t in range(k % 5)]
    rows += [(500, t, "user", "deep") for t in range(60)] + [(k, t, "user", "copied") for k in range(600, 640) for t in range(4)]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, node int, depth string, ends int"


@pytest.mark.parametrize("shard_convs,hot_share,rows_per_task", [(4096, 1000, None), (3, 2, None), (7, 1000, 20)])
def test_trie_equals_brute_force(spark, shard_convs, hot_share, rows_per_task):
    rows = conversations(shard_convs, 150)
    table = tuned(spark).createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    got = trie.prefix_trie(table, shard_convs=shard_convs, hot_share=hot_share, rows_per_task=rows_per_task)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_empty_and_turnless_tables(spark):
    empty = tuned(spark).createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0
    # One turn that the missing head of its conversation takes away.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    rows = [(c, 0, "user", "gone")]
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    assert Counter(map(tuple, got)) == plain_trie(rows) and got[0].n_leaves == 1


# --- licence scan ---------------------------------------------------------------


def test_automaton_gives_matching_statistics_and_places():
    rng = random.Random(6)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
        doc = [rng.randrange(4) for _ in range(30)]
        where = defaultdict(set)
        for k, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    where[tuple(t[a:b])].add((k, b - 1))
        automaton = licences.Automaton(texts)
        for i, (state, n) in enumerate(automaton.walk(doc)):
            assert n == max(length for length in range(i + 2) if not length or tuple(doc[i + 1 - length:i + 1]) in where)
            if n:
                assert sorted(automaton.places(state)) == sorted(where[tuple(doc[i + 1 - n:i + 1])])


def base_places(text):
    words = term_list(text)
    places = {p: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for p, _ in licences.PHRASES}
    starts = [s for found in places.values() for s in found]
    labels = sorted({label for p, label in licences.PHRASES if places[p]})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels)


def test_base_places_equal_brute_force(spark):
    rng = random.Random(7)
    words = "mit license apache license general public license gnu the of version lesser free license, MIT-License x".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(300)] + [None, "", "mit license " * 20_000, "license mit"]
    docs = [(i, t, 1, "x", 5, "y", 3) for i, t in enumerate(texts)] + [(None, "MIT license", 1, "x", 5, "y", 3), (3, texts[3], 1, "x", 5, "y", 3)]
    got = licences.verdicts(licences.scan(tuned(spark).createDataFrame(docs, CLASH)))
    rows = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, rows)) == Counter((d[0], *base_places(d[1])) for d in docs)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect())
    assert licences.verdicts(licences.scan(spark.createDataFrame([], CLASH))).count() == 0


def longest_chain(doc, template, min_match, max_gap):
    """The most template words in one chain of matched runs, by dynamic programming over single words."""
    best = {}
    runs = [(i, j, n) for i in range(len(doc)) for j in range(len(template)) for n in range(min_match, min(len(doc) - i, len(template) - j) + 1)
            if doc[i:i + n] == template[j:j + n]]
    for i, j, n in sorted(runs):
        before = [v for (e, t), v in best.items() if e <= i and t <= j and i - e <= max_gap and j - t <= max_gap]
        best[i + n, j + n] = max(best.get((i + n, j + n), 0), n + max(before, default=0))
    return max(best.values(), default=0)


def test_chains_cover_edited_templates():
    template = licences.TEMPLATES[0][1]
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, licences.MIN_MATCH, licences.MAX_GAP)
    words = words_of(template.encode())
    rng = random.Random(8)
    for edits in (0, 1, 3, 6):
        doc = list(words)
        for _ in range(edits):
            doc[rng.randrange(len(doc))] = rng.choice([b"zzz", b"software", b"to"])
        _, spans = scanner.scan([b"some", b"words"] + doc + [b"rest"])
        best = max((s for s in spans if s.template == 0), key=lambda s: s.covered)
        assert best.covered >= longest_chain(doc, words, licences.MIN_MATCH, licences.MAX_GAP) - edits * licences.MIN_MATCH
        assert 2 <= best.first and best.last < 2 + len(doc)
        if edits == 0:
            assert (best.first, best.last, best.share) == (2, 1 + len(doc), 1.0)
    # Two copies of one template are two spans; words far apart are none.
    _, spans = scanner.scan(words + [b"zzz"] * 40 + words)
    assert [(s.first, s.share) for s in spans if s.template == 0] == [(0, 1.0), (len(words) + 40, 1.0)]
    assert not scanner.scan([w for word in words for w in (word, b"zzz")])[1]


def test_labels_of_the_method(spark):
    texts = {0: "x. Licensed under CC BY-NC 4.0.", 1: "Licensed under CC BY-SA 4.0", 2: licences.TEMPLATES[7][1], 3: "clean text about a license",
             4: "Released under the MIT License.", 5: licences.TEMPLATES[6][1].upper()}
    got = licences.verdicts(licences.scan(tuned(spark).createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels == {0: "cc-by-nc", 1: "cc-by-sa", 2: "bsd", 3: "", 4: "mit", 5: "gpl,lgpl"}
