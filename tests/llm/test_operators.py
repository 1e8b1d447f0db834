"""The training-data operators against brute force, exact round trips and odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftlog.llm import bpe, chat, decontaminate, htmlmain, labelled, langid, nearedup, packing, quality, suffixes, tokenfile, tokens
from weftlog.llm.base import tuned

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
# Columns whose names the operators use inside.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row int, hits int, removed int, key int, th int, part int, words int, found int"
LONG = "one two three, four five six. " * 4000


def rows(*docs):
    return [(i, t, "en", "src0", len(t or ""), 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t in docs]


ODD = rows((1, None), (2, ""), (3, " \t\n"), (None, "some words without an id"), (5, LONG), (6, LONG), (7, "twice here"), (7, "twice here"),
           (8, "a  b\n\n c\xa0d\té <|endoftext|> <|im_end|>"), (9, "漢字 ÅÄÖ 😀 it's I'LL"), (10, "the " * 300))


@pytest.fixture(scope="module")
def odd(spark):
    return tuned(spark).createDataFrame(ODD, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return tuned(spark).createDataFrame([], CLASH)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_and_splices_give_the_library_ids(path):
    tok, memo = Tokenizer.from_file(path), bpe.WordMemo(path)
    assert memo.kind != "whole"
    rng = random.Random(1)
    texts = [t for _, t, *_ in ODD if t]
    texts += ["".join(rng.choices(["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "é", "1", "!", "<|endoftext|>", "\x1c", " "], k=30)) for _ in range(300)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, memo.dtype).tolist() for b in memo.encode(texts)] == want
    big = " ".join(texts) + "x" * 3000 + "漢字" * 800 + "\n \t  " * 300 + "<|endoftext|>" * 100
    for chunk, overlap in ((700, 60), (1500, 40), (5000, 512)):
        ids, chunks, widened = tokens.spliced(tok, big, chunk, overlap, guard=16)
        assert ids == tok.encode(big, add_special_tokens=False).ids
        assert chunks > 1


def test_new_words_are_encoded_many_at_a_time():
    memo, asked = bpe.WordMemo(BYTE), []
    tok = memo.tok

    class Counting:
        def encode(self, text, **how):
            return tok.encode(text, **how)

        def encode_batch_fast(self, batch, **how):
            asked.extend(batch)
            return tok.encode_batch_fast(batch, **how)

    memo.tok = Counting()
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé漢1'.,!\u0120\u010a", k=rng.randint(1, 9))) + rng.choice(["", "", "<|endoftext|>", "'s", "."])
    texts = ["".join(word() + rng.choice("   \n") for _ in range(200)) + word() for _ in range(30)] + ["", "one", "<|endoftext|>", "a\nb", "<|endoftext|>\n<|endoftext|> <|endoftext|>"]
    for _ in range(2):
        assert [np.frombuffer(b, memo.dtype).tolist() for b in memo.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(memo.proven(texts)) and 0 < len(asked) < 30
    # Where the first tokens of words cannot be told, each word is encoded on its own.
    memo = bpe.WordMemo(BYTE)
    memo.starts[:] = True
    assert [np.frombuffer(b, memo.dtype).tolist() for b in memo.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_single_spaces_and_line_breaks_between_words_are_proven():
    memo = bpe.WordMemo(BYTE)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert len(spaces) > 20 and [s for s, ok in zip(spaces, memo.proven([f"a{s}b" for s in spaces])) if ok] == ["\n", " "]
    loose = [a + b + c for a, b, c in (("", " ", "a"), ("a", " ", ""), ("", "\n", "a"), ("a", "\n", ""), ("a", "  ", "b"), ("a", "\n\n", "b"), ("a", " \n", "b"), ("a", "\n ", "b"))]
    assert not any(memo.proven(loose))


def test_a_text_without_borders_is_not_read_over_and_over():
    tok, read = Tokenizer.from_file(BYTE), []

    class Counting:
        def encode(self, text, **how):
            read.append(len(text))
            return tok.encode(text, **how)

    text = "x" * 40_000 + " end of it"
    ids, chunks, widened = tokens.spliced(Counting(), text, 500, 50)
    assert ids == tok.encode(text, add_special_tokens=False).ids
    assert widened > 0 and sum(read) < 8 * len(text)


def test_token_counts_of_odd_documents(odd, empty):
    tok = Tokenizer.from_file(WORD)
    got = [tuple(r) for r in tokens.token_counts(odd, WORD, chunk_chars=5000).collect()]
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD]
    assert collections.Counter(r[:3] for r in got) == collections.Counter(want)
    assert all(r[3] == (r[2] > 2048) for r in got)
    assert tokens.token_counts(empty, WORD).count() == 0


def test_token_files_round_trip(odd, empty, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    out = tokenfile.write_token_files(odd, BYTE, 2, path=str(tmp_path), file_bytes=60_000, frame_tokens=1000)
    assert out.count() > 1
    got = [tuple(r) for r in tokenfile.read_token_files(out).collect()]
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    want = collections.Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, *_ in ODD)
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert tokenfile.read_token_files(tokenfile.write_token_files(empty, BYTE, 2, path=str(tmp_path / "none"))).count() == 0


def test_files_hold_about_equal_bytes(spark, tmp_path):
    rows = [(i, "word " * (4000 if i < 50 else 20)) for i in range(1000)] + [(None, "no id"), (2000, None)]
    docs = tuned(spark).createDataFrame(rows, "doc_id bigint, text string")
    out = tokenfile.write_token_files(docs, BYTE, 2, path=str(tmp_path), file_bytes=100_000).collect()
    assert sum(r["n_docs"] for r in out) == len(rows)
    # Text of 100,000 bytes has 20,000 words; cut by rows, the first file would hold all 50 long ones.
    assert max(r["n_tokens"] for r in out) <= 2 * 20_000 + 4_001 and len(out) >= 8


def test_a_damaged_frame_is_noticed_and_others_stay_readable(tmp_path):
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = io.BytesIO()
    writer = tokenfile.FileWriter(out, 2)
    bodies = [bytes(range(200)) * 5, b"", b"xy" * 700]
    for k, b in enumerate(bodies):
        writer.add(k, len(b) // 2, tokenfile.frames_of(b, 2, 300))
    writer.close()
    reader = tokenfile.FileReader(Source(out.getvalue()))
    assert [reader.ids(k) for k in range(3)] == bodies
    broken = bytearray(out.getvalue())
    broken[12] ^= 0xFF
    reader = tokenfile.FileReader(Source(bytes(broken)))
    assert reader.ids(2) == bodies[2]
    with pytest.raises(Exception):
        reader.ids(0)


def test_edit_distance_matches_the_plain_one():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            last, row[0] = row[:], i + 1
            for j, y in enumerate(b):
                row[j + 1] = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
        assert decontaminate.best_match(a, b) == (min(row), row.index(min(row)))


def test_leaks_are_found_up_to_the_limit(spark, odd, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, words(rng.randint(10, 60))) for k in range(40)]
    docs, want = [], set()
    for d in range(200):
        k, item = rng.choice(items)
        part = item[:]
        edits = rng.randint(0, int(len(item) * 0.35))
        for _ in range(edits):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        docs.append((d, " ".join(words(rng.randint(0, 80)) + (part if d % 3 else []) + words(rng.randint(0, 80)))))
    for d, text in docs:
        for k, item in items:
            code = {w: i for i, w in enumerate(set(item))}
            if decontaminate.best_match([code[w] for w in item], [code.get(w, -1) for w in text.split()])[0] <= int(len(item) * 0.2):
                want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in items] + [(None, "x"), (99, None), (98, "too short")], "item_id bigint, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 60
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.with_hits(odd, bench).drop("__hits").count() == len(ODD)


@pytest.mark.parametrize("kind", ["substituted", "inserted", "deleted", "mixed"])
def test_edited_items_of_any_length_are_found(kind):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words(n) for n in (8, 12, 30, 55, 64, 65, 100, 200, 300) for _ in range(6)]
    index = decontaminate.Index([(k, " ".join(i)) for k, i in enumerate(items)])
    texts = []
    for item in items:
        part = item[:]
        for _ in range(int(len(item) * 0.2)):
            step = kind if kind != "mixed" else rng.choice(["substituted", "inserted", "deleted"])
            at = rng.randrange(len(part))
            part[at:at + (step != "inserted")] = [] if step == "deleted" else words(1)
        texts.append(" ".join(words(rng.randint(0, 40)) + part + words(rng.randint(0, 40))))
    hits = [{h["item_id"]: h for h in found} for found in index.search(texts)]
    assert sum(k in found for k, found in enumerate(hits)) >= 0.95 * len(items)
    assert all(h["distance"] <= int(len(items[k]) * 0.2) for found in hits for k, h in found.items())


def test_short_items_are_looked_up_with_their_one_edit():
    items = [(1, "alpha beta gamma"), (2, "one two three four five"), (3, "a b c d e f g h"), (4, "too short"), (5, "p q r s t u v")]
    index = decontaminate.Index(items)
    ids = lambda text: [h["item_id"] for h in index.search([text])[0]]
    assert ids("x ALPHA beta\tgamma y") == [1] and ids("alpha beta gamma") == [1]
    assert ids("alpha beta") == ids("alpha x gamma") == ids("too short") == ids("") == []
    assert ids("one two three four") == ids("zero two three four five") == ids("x one two NEW three four five") == [2]
    assert ids("one two x four y") == []
    assert ids("a b c d e f g") == ids("b c d e f g h") == [3]
    for at in range(7):
        part = "p q r s t u v".split()
        assert ids(" ".join(["z", *part[:at], "?", *part[at + 1:], "z"])) == [5] == ids(" ".join(part[:at] + part[at + 1:]))
    assert decontaminate.Index([(4, "too short")]).search(["too short", None, ""]) == [[], [], []]


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_base_rules_match_brute_force(spark, odd, empty):
    rng = random.Random(4)
    docs = ODD + rows(*[(100 + k, "".join(rng.choices(["a ", "b ", "c\n", "d ", "#", "é "], k=rng.randint(0, 120)))) for k in range(120)])
    got = quality.judge(spark.createDataFrame(docs, CLASH)).collect()
    want = collections.Counter((i, *brute_quality(t)) for i, t, *_ in docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(empty).count() == 0
    kept = quality.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality.judge(odd).collect())


def test_divergence_rejects_odd_histograms_only(spark):
    rng = random.Random(5)
    vocabulary = {"en": [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)], "fr": [f"môt{chr(97 + k % 26)}" for k in range(26)]}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    docs = [(k, text("en", rng.randint(90, 200)), "en", "s", 0) for k in range(60)] + [(100 + k, text("fr", 120), "fr", "s", 0) for k in range(40)]
    docs += [(200, " ".join(w + "***" for w in text("en", 120).split()), "en", "s", 0), (201, text("fr", 120), "en", "s", 0), (202, text("en", 40), None, "s", 0)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert {k for k, v in kept.items() if not v} == {200, 201}


@pytest.mark.parametrize("rare", [1, 3, 19, 20])
def test_languages_of_any_size_and_null_are_judged(spark, rare):
    rng = random.Random(15)
    vocabulary = {"en": [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)], "ru": [f"сло{chr(0x430 + k % 30)}во" for k in range(30)]}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    junk = " ".join(w + "*#" * 6 for w in text("en", 120).split())
    docs = [(k, text("en", 150), "en") for k in range(60)] + [(100 + k, text("ru", 120), "ru") for k in range(rare)]
    docs += [(200, junk, None), (201, junk, "xx"), (202, text("en", 120), None), (203, text("ru", 120), None), (204, None, "ru"), (205, text("en", 120), "yy")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    assert {k for k, v in got.items() if not v} == {200, 201, 204}
    assert quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").where("text IS NULL")).collect()[0].kept is False


def test_every_common_word_has_a_share(spark):
    docs = [(1, " ".join(f"w{k}" for k in range(64) for _ in range(64 - k)), "en")]
    ref = quality.references(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).where("lang IS NOT NULL").first()
    assert len(ref.by_code) == 64 and sum(map(len, ref.slot_codes)) == 64 and abs(sum(ref.by_code.values()) - 1) < 1e-9


def test_more_languages_than_are_held(spark, odd, monkeypatch):
    want = collections.Counter(quality.judge(odd).collect())
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 0)
    assert collections.Counter(quality.judge(odd).collect()) == want


def test_main_text_of_held_out_labelled_pages():
    model = htmlmain.default_model()
    wrong = total = 0
    for page in labelled.pages(60, seed=99):
        nodes = htmlmain.tree(page)
        for node, p in zip(nodes, model.marginals(nodes, htmlmain.describe(nodes))[0]):
            if node.text is not None:
                total += 1
                wrong += (p > 0.5) != bool(node.label)
    assert total > 500 and wrong <= 0.01 * total


def test_marginals_match_enumeration():
    from itertools import product

    model = htmlmain.default_model()
    nodes = htmlmain.tree("<div class=menu><a>x</a></div><p>one two.</p><ul><li>y</ul>")
    described = htmlmain.describe(nodes)
    weights = np.zeros((len(nodes), 2))
    for labels in product((0, 1), repeat=len(nodes)):
        w = 1.0
        for i, (node, d) in enumerate(zip(nodes, described)):
            w *= model.odds(d) if labels[i] else 1.0
            if i:
                w *= model.factors["leaf" if node.text is not None else "element"][labels[node.parent]][labels[i]]
        for i, x in enumerate(labels):
            weights[i, x] += w
    assert np.allclose(model.marginals(nodes, described)[0], weights[:, 1] / weights.sum(1))


def test_pages_of_any_shape(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "plain"), (4, "u", "<p>unclosed <b>bold"), (5, None, "<div a='>'>" * 500 + "x"), (None, "u", "<script>if (a<b) {}"),
             (7, "u", "<body><nav><a>Menu</a></nav><article><h1>T</h1><p>a&amp;b &lt;c&gt;\n\n d<b>e</b></p><p>" + "word " * 40 + ".</p></article><footer>&copy; x</footer>")]
    got = {r.page_id: r for r in htmlmain.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert len(got) == 7 and got[1].text == got[2].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert got[7].text == "T a&b <c> de " + " ".join(["word"] * 40) + " ."
    assert htmlmain.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_unclosed_and_self_closing_elements_hide_no_text():
    texts = lambda page: [n.text for n in htmlmain.tree(page) if n.text is not None]
    for tag in ("svg", "select", "template", "noscript"):
        assert texts(f"<p>one</p><{tag} class=x><p>two</p>") == ["one", "two"]
        assert texts(f"<p>one</p><{tag}>gone</{tag}><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><svg width='1' /><p>two</p><svg>gone</svg><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><script>gone<p>two</p>") == ["one"]


def brute_groups(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), d), d)
    return sorted((d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(docs))


def test_near_duplicates_match_brute_force(spark, odd, empty):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = [(0, " ".join(base)), (1, ""), (2, None), (3, "a b c"), (4, "A b  C"), (5, "a b")]
    for k in range(10, 90):  # copies around one centre, most of them not linked with each other
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        docs.append((k, " ".join(words)))
    docs += [(100 + k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(60)]
    got = sorted(tuple(r) for r in nearedup.groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == brute_groups(docs)
    assert nearedup.groups(odd).count() == len(ODD) and nearedup.groups(empty).count() == 0


def test_links_inside_a_crowd_match_brute_force(spark):
    """Documents that share boilerplate below the threshold, each with one partner just above it."""
    rng = random.Random(21)
    words = lambda n: [f"r{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared, docs = words(344), []
    for k in range(300):
        half = words(6)
        docs += [(2 * k + side, " ".join(shared + half + words(56 + (k + side) % 3))) for side in (0, 1)]
    rng.shuffle(docs)
    want = brute_groups(docs)
    assert len({c for *_, c, _ in want}) == 300
    assert sorted(tuple(r) for r in nearedup.groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()) == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 9), (9, 8)]
    got = {r.id: r.root for r in nearedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 100 for k in range(101, 161)) and got[8] == got[9] == 7


HOSTILE = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>", "\n", "<|nl|>", "|", "<", "\\", "a", "é"]


def test_chats_survive_the_round_trip(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choices(HOSTILE, k=rng.randint(0, 6)))
    turns = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(60) for t in range(rng.randint(1, 5))]
    turns += [(70, 1, None, None), (None, 2, "assistant", "x"), (71, 3, "assistant", "tie"), (71, 3, "assistant", "tie"), (71, None, "user", "first")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, _, r, x in said if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in said)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_removals(texts, length):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_spans": 3, "part_items": 40}])
def test_removed_bytes_match_brute_force(spark, how):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30)) for _ in range(n))
    passages = [words(14) for _ in range(5)]
    docs = []
    for k in range(90):
        text = words(rng.randint(3, 20))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += " " + p[a:a + rng.randrange(20, len(p))] + words(rng.randrange(6))
        docs.append((k, text))
    docs += [(200, docs[3][1]), (200, docs[3][1]), (None, docs[5][1]), (201, None), (202, ""), (203, "ab" * 200), (204, "ab" * 150), (205, "x" * 500), (206, "é" * 90)]
    got = suffixes.removal_digests(suffixes.with_removals(spark.createDataFrame(docs, "doc_id bigint, text string"), length=60, gram=10, **how)).collect()
    want = collections.Counter((d, *b) for (d, _), b in zip(docs, brute_removals([(t or "").encode() for _, t in docs], 60)))
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got if r.doc_id != 206)


def test_passages_of_fifty_words_go_from_400_bytes_on(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(4, 6))) for _ in range(n))
    docs = {k: words(40) + "." for k in range(3)}
    for size in (330, 399, 400, 401, 700):
        passage = words(size // 5)[:size - 1] + "|"
        assert len(passage) == size and len(passage.split()) > 50
        # Different bytes on both sides, so that the passage is all they share.
        docs |= {10 * size + k: words(30 + k) + f" {mark}" + passage + f"{mark} " + words(30) for k, mark in enumerate("XYZ")}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in suffixes.removal_digests(suffixes.with_removals(frame)).collect()}
    want = dict(zip(docs, brute_removals([t.encode() for t in docs.values()], suffixes.LENGTH)))
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want
    assert {k: r.n_removed for k, r in got.items()} == {k: k // 10 if k >= 4000 else 0 for k in docs}
    assert all((got[k].text == docs[k]) == (k < 4000) and got[k].n_bytes == len(docs[k]) for k in docs)


def test_removals_keep_other_columns(odd, empty):
    out = suffixes.with_removals(odd)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "__removed"]
    assert suffixes.with_removals(empty).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(300)]
    runs = [sorted(texts[k::7]) for k in range(7)]
    blocks = [suffixes.front_coded([(t, b"", 0, 0, 0, 0) for t in r]) for r in runs]
    got = [(p, h[1]) for p, h in suffixes.LoserTree([suffixes.decoded(b) for b in blocks])]
    assert [t for _, t in got] == sorted(texts)
    assert all(p == suffixes.common_prefix(a, b) for (_, a), (p, b) in zip(got, got[1:]))


def test_length_buckets_are_optimal():
    from itertools import combinations

    rng = random.Random(10)
    for _ in range(30):
        hist = {rng.randrange(40): rng.randint(1, 9) for _ in range(9)}
        k = rng.randint(1, 4)
        padding = lambda cuts: sum(n * (min(c for c in cuts if c >= x) - x) for x, n in hist.items())
        best = min(padding((*c, max(hist))) for r in range(k) for c in combinations(sorted(hist)[:-1], r))
        got = packing.bucket_borders(hist, k)
        assert len(got) <= k and padding(got) == best
    assert packing.bucket_borders({}, 4) == []


def test_packing_loses_no_token(odd, empty):
    tok = Tokenizer.from_file(BYTE)
    got = packing.pack(odd, BYTE, max_len=50, buckets=4, token_budget=200, group_rows=20).toPandas()
    assert got.n_tokens.sum() == sum(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ODD)
    assert (got.n_tokens <= got.bucket_len).all() and not got.duplicated(["bucket_len", "batch_id", "slot"]).any()
    for size, part in got.groupby("bucket_len"):
        room = max(1, 200 // max(size, 1))
        full = part.groupby("batch_id").size().sort_index()
        assert (full.iloc[:-1] == room).all() and full.iloc[-1] <= room and list(full.index) == list(range(len(full)))
    # The ids of all pieces of a document, put together, are those of the library.
    held = collections.defaultdict(list)
    for r in got.sort_values(["doc_id", "piece"]).itertuples():
        assert len(r.ids) == r.n_tokens * r.id_bytes
        if r.doc_id == r.doc_id:
            held[int(r.doc_id)] += np.frombuffer(r.ids, f"<u{r.id_bytes}").tolist()
    texts = collections.defaultdict(list)
    for i, t, *_ in ODD:
        if i is not None:
            texts[i].append(t)
    for i, given in texts.items():
        if len(given) == 1:
            assert held[i] == tok.encode(given[0] or "", add_special_tokens=False).ids
    size, batch = max((r.bucket_len, r.batch_id) for r in got.itertuples())
    part = got[(got.bucket_len == size) & (got.batch_id == batch)].to_dict("records")
    ids, mask = packing.batch_arrays(part, pad_id=-1)
    assert ids.shape == mask.shape == (len(part), size) and (ids[mask] >= 0).all() and (ids[~mask] == -1).all()
    assert mask.sum() == sum(r["n_tokens"] for r in part)
    assert packing.pack(empty, BYTE).count() == 0


def test_gradients_match_differences():
    net = langid.Network(["a", "b", "c"], 4)
    seg = np.random.default_rng(0).integers(97, 110, (5, 7)).astype(np.uint8)
    mask = np.ones((5, 7), np.float32)
    mask[1, 4:] = 0
    y = np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(seg, mask, y)
    for w, g in zip(net.weights, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = w[at], []
        for step in (0.01, -0.01):
            w[at] = old + step
            losses.append(net.gradients(seg, mask, y)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_languages_of_held_out_documents(spark, odd, empty):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(langid.training_sample(sf))
    got = langid.identify(sf, net).join(sf.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() >= 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    one = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    assert one[1].lang_pred == one[2].lang_pred == one[3].lang_pred == "und" and one[1].score == 0
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1))).collect()} >= {"und"}
