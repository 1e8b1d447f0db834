"""The corpus pipeline against plain code on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest
from weftlog.llm import nearedup


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    items = [(k, text(30)) for k in range(8)]
    shared = text(120)
    docs = {k: text(rng.randint(60, 200)) for k in range(120)}
    docs |= {200: docs[3], 201: docs[4] + " end", 210: text(60) + " " + items[2][1], 220: "too short", 221: "same words again now " * 60, 222: None, 223: "*** ### " * 80}
    docs |= {k: docs[k] + "\n" + shared + "\n" + text(60) for k in (20, 21, 22)}
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, shared


def test_each_stage_acts_on_planted_cases(spark, corpus):
    path, docs, shared = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        rows = {r.doc_id: r for r in frame.collect()}
        frame = spark.createDataFrame(list(rows.values()), frame.schema)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(rows)
    quality, near, passages, clean = seen
    assert set(docs) - set(quality) == {220, 221, 222, 223}
    assert set(quality) - set(near) == {200, 201}
    assert set(passages) == set(near)
    assert all(shared[10:-10] not in passages[k].text for k in (20, 21, 22)) and all(passages[k].n_chars == len(passages[k].text) for k in (20, 21, 22))
    assert all(passages[k].text == near[k].text for k in near if k not in (20, 21, 22))
    assert 210 in set(passages) - set(clean) and len(clean) >= len(passages) - 2


def test_run_is_the_stages_in_turn(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "first_token", "n_tokens", "bucket_len", "batch_id", "slot"]
    assert out.count() == out.select("bucket_len", "batch_id", "slot").distinct().count()


def test_stages_take_empty_tables(spark, corpus):
    frame = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, corpus[0]).count() == 0


def test_kept_documents_are_the_smallest_of_their_groups(spark, corpus):
    frame = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    rows = nearedup.groups(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and {r.component_id for r in rows if r.doc_id in (3, 200)} == {3}


def without_runs(texts, unit):
    """Words of every text that are in no run of `unit` words which stands anywhere else."""
    where = {}
    words = [t.split() for t in texts]
    for k, ws in enumerate(words):
        for i in range(len(ws) - unit + 1):
            where.setdefault(tuple(ws[i:i + unit]), []).append((k, i))
    gone = {(k, i + j) for places in where.values() if len(places) > 1 for k, i in places for j in range(unit)}
    return [[w for i, w in enumerate(ws) if (k, i) not in gone] for k, ws in enumerate(words)]


def test_passages_of_fifty_words_go_and_shorter_ones_stay(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    docs = {}
    for size in (45, 49, 50, 51, 55, 130):
        passage = text(size)
        for k in range(3):
            docs[size * 10 + k] = " ".join(text(rng.randint(0, 60))) + "\n\t " + "  ".join(passage) + " " + " ".join(text(rng.randint(0, 60)))
    docs |= {1: "one two " * 60, 2: " ".join(text(300)), 3: " ".join(["again"] * 99), 4: "é\xa0ß " * 51 + "end", 5: None, 6: ""}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, frame, "").collect()}
    keys = [k for k in docs if docs[k] is not None]
    split = lambda t: [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    want = dict(zip(keys, without_runs([" ".join(split(docs[k])).replace("\xa0", "~") for k in keys], 50)))
    for k in keys:
        left = [w.replace("\xa0", "~") for w in split(got[k].text)] if k in got else []
        assert left == want[k], k
        assert k not in got or got[k].n_chars == len(got[k].text)
    assert {k for k in docs if k not in got} == {k for k in keys if docs[k] and not want[k]}
    assert all(got[450 + k].text == docs[450 + k] for k in range(3)) and got[5].text is None


def test_no_text_is_lost_where_ids_repeat(spark):
    rng = random.Random(22)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, d), (4, a + " end")]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()))
    assert got == sorted([(1, a), (1, b), (3, c), (0, d)])
