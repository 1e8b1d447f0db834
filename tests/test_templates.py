"""Template mining, matching, enrichment and file sources."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlog.operators import templates as T
from weftlog.sources import logs as L
from weftlog.sources import tables as S


def lines(spark, texts):
    return spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "line_no bigint, content string, raw string")


def test_mining_wildcards_what_varies(spark):
    texts = [f"INFO app: got blk_{i} from 10.0.0.{i % 9}:80 size {i * 37}" for i in range(300)]
    texts += [f"WARN app: lost blk_{i} after {i} tries now" for i in range(200)] + ["INFO app: started"]
    found = T.mine_templates(lines(spark, texts)).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["template"], r["count"]) for r in found] == [
        (1, "INFO app: got <BLK> from <IP> size <*>", 300), (2, "WARN app: lost <BLK> after <*> tries now", 200), (3, "INFO app: started", 1)]


def test_mining_counts_every_line_and_ignores_partitioning(spark):
    texts = [f"INFO job {w} step {i % 7} done" for i in range(120) for w in ("alpha", "beta")] + ["single"]
    df = lines(spark, texts)
    a = T.mine_templates(df).orderBy("cluster_id").collect()
    b = T.mine_templates(df.repartition(7)).orderBy("cluster_id").collect()
    assert a == b and sum(r["count"] for r in a) == len(texts)


def mined(texts, sim_th, depth=4):
    """{template: (count, first line)} by the rule of `mine_templates`, group by group."""
    held = {}
    for line, text in enumerate(texts):
        n, first = held.get(text, (0, line))
        held[text] = (n + 1, first)
    buckets = {}
    for text in held:
        t = text.split(" ")
        lead = tuple("<*>" if any(c.isdigit() for c in w) else w for w in t[:max(depth - 2, 1)])
        buckets.setdefault((len(t), lead), []).append(t)
    out, todo = {}, list(buckets.values())
    while todo:
        group = todo.pop()
        seen = [sorted({t[i] for t in group}) for i in range(len(group[0]))]
        varied = [i for i, w in enumerate(seen) if len(w) > 1]
        if varied and sum(len(w) == 1 and w != ["<*>"] for w in seen) / len(seen) < sim_th:
            at = min(varied, key=lambda i: ("<*>" in seen[i], len(seen[i]), i))
            todo += [[t for t in group if t[at] == w] for w in seen[at]]
            continue
        template = " ".join("<*>" if i in varied else w[0] for i, w in enumerate(seen))
        n, first = out.get(template, (0, len(texts)))
        out[template] = (n + sum(held[" ".join(t)][0] for t in group), min(first, *(held[" ".join(t)][1] for t in group)))
    return out


WORDS = "abcdefghij"


def mixed_texts(seed, n, kinds=6):
    rng = random.Random(seed)
    word = lambda k: "".join(WORDS[int(d)] for d in str(k))
    texts = [" ".join(["INFO", "svc:", *(word(rng.randrange(kinds)) for _ in range(5))]) for _ in range(n)]
    texts += [f"WARN db: {rng.choice(['open', 'close', 'drop'])} <*> {word(rng.randrange(90))} by {word(rng.randrange(900))}" for _ in range(n // 2)]
    return texts + ["single", "", "WARN db: open x y by z"]


@pytest.mark.parametrize("sim_th", [0.2, 0.4, 0.6, 0.7, 0.95])
def test_templates_equal_brute_force_for_any_split(spark, sim_th, monkeypatch):
    texts = mixed_texts(5, 300)
    want = mined(texts, sim_th)
    for parts, shares in ((1, 1000), (7, 3)):
        # Few shares make large groups take the broadcast way, small ones the shuffled one.
        monkeypatch.setattr("weftlog.operators.skew.SHARES", shares)
        rows = T.mine_templates(lines(spark, texts).repartition(parts), sim_th).collect()
        assert {r["template"]: (r["count"], r["first_line"]) for r in rows} == want
        assert [r["cluster_id"] for r in sorted(rows, key=lambda r: (r["first_line"], r["template"]))] == list(range(1, len(rows) + 1))
    assert (len(want) > 20) == (sim_th > 0.5)


def test_number_of_values_is_no_switch(spark):
    word = lambda k: "".join(WORDS[int(d)] for d in str(k))
    for n in (100, 101, 150):
        verbs = [f"INFO svc: {word(k)} the thing" for k in range(n)]
        assert T.mine_templates(lines(spark, verbs), 0.95).count() == n
        assert [r["template"] for r in T.mine_templates(lines(spark, verbs)).collect()] == ["INFO svc: <*> the thing"]


def test_threshold_decides_between_one_group_and_its_parts(spark):
    texts = ["a b c d e", "a b x y z", "a b c q r"]
    get = lambda th: sorted(r["template"] for r in T.mine_templates(lines(spark, texts), th).collect())
    assert get(0.4) == ["a b <*> <*> <*>"]
    assert get(0.6) == ["a b c <*> <*>", "a b x y z"]


def test_no_task_holds_a_bucket(spark):
    """One bucket of many texts: rows are exploded and merged per position, never gathered."""
    texts = [f"INFO svc: {i} step" for i in range(50)] + mixed_texts(6, 200)
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "group string, t string, cnt bigint")
    rows = rows.select(F.lit("one").alias("group"), F.split("t", " ").alias("t"), "cnt", F.lit(0).alias("first_line"))
    plan = T._group_shapes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_list(t" not in plan and "partial_min(w" in plan


def test_lines_without_text_give_no_template(spark):
    df = spark.createDataFrame([(0, None), (1, "a b c")], "line_no bigint, content string")
    assert [(r["template"], r["count"]) for r in T.mine_templates(df).collect()] == [("a b c", 1)]
    assert T.mine_templates(df.where("false")).count() == 0


CATALOG = [(1, "INFO a <*> c"), (2, "INFO a b <*>"), (3, "INFO <*> <*> <*>"), (4, "<*> a b c"), (5, "one"), (6, "INFO a b <*>")]


@pytest.mark.parametrize("small", [True, False])
def test_best_match(spark, small):
    cat = spark.createDataFrame(CATALOG, "cluster_id int, template string")
    texts = ["INFO a b c", "INFO a x c", "INFO a b z", "INFO q w e", "WARN a b c", "one", "two", "INFO a b c d", "  INFO a  b c "]
    got = T.match_templates(lines(spark, texts), cat, small=small).orderBy("line_no").collect()
    # Most literal tokens first, then the lowest id.
    assert [r["cluster_id"] for r in got] == [1, 1, 2, 3, 4, 5, None, None, 1]
    assert len(got) == len(texts)


def test_matching_equals_brute_force(spark):
    from weftlog.plans import ingest_queries as Q

    df = Q.raw_hdfs(spark, "/root/testdata/sf0.001")
    cat = T.mine_templates(df)
    shapes = [(r["cluster_id"], r["template"].split(" ")) for r in cat.collect()]

    def brute(masked):
        w = masked.split(" ")
        fits = [(-sum(t != "<*>" for t in s), i) for i, s in shapes if len(s) == len(w) and all(t in ("<*>", x) for t, x in zip(s, w))]
        return min(fits)[1] if fits else None

    rows = T.match_templates(df, cat).select("cluster_id", T.mask_tokens("content").alias("m")).collect()
    assert rows and all(r["cluster_id"] == brute(r["m"]) for r in rows)
    assert all(r["cluster_id"] is not None for r in rows)


def best_of(catalog, text):
    words = text.split()
    fits = []
    for i, t in catalog:
        shape = t.split(" ")
        if len(shape) == len(words) and all(s in ("<*>", w) for s, w in zip(shape, words)):
            fits.append((-sum(s != "<*>" for s in shape), i))
    return min(fits)[1] if fits else None


@pytest.mark.parametrize("shares", [1000, 4])
def test_index_match_equals_brute_force_with_hot_keys(spark, shares, monkeypatch):
    """Templates of one literal that many texts hold, wildcard-led ones, ones without literals, and a text most lines share."""
    monkeypatch.setattr(T, "MATCH_SHARES", shares)
    monkeypatch.setattr("weftlog.operators.skew.SHARES", shares)
    rng = random.Random(9)
    catalog = [(1, "INFO <*> <*>"), (2, "<*> <*> <*>"), (3, "<*> <*> <*>"), (4, "<*> b <*>"), (5, "<*> <*> c d")]
    catalog += [(k, " ".join(["INFO", *(rng.choice(["<*>", *"abcde"]) for _ in range(rng.randrange(2, 5)))])) for k in range(6, 90)]
    catalog += [(k, f"<*> <*> {rng.choice('abcde')} <*> {rng.choice('abcde')}") for k in range(90, 130)]
    texts = [" ".join([rng.choice(["INFO", "INFO", "WARN"]), *rng.choices("abcdef", k=rng.randrange(1, 5))]) for _ in range(400)]
    texts += ["INFO a b"] * 300 + ["no such line at all here"] * 50
    df = lines(spark, texts)
    cat = spark.createDataFrame(catalog, "cluster_id int, template string")
    got = T.match_templates(df, cat, small=False).orderBy("line_no").collect()
    assert [r["cluster_id"] for r in got] == [best_of(catalog, t) for t in texts]
    empty = T.match_templates(df, cat.where("false"), small=False)
    assert empty.where("cluster_id IS NULL").count() == len(texts)


def test_no_match_key_exceeds_its_share(spark, monkeypatch):
    """Every template has the same literal, and all texts hold it: the key is salted to its share."""
    monkeypatch.setattr(T, "MATCH_SHARES", 20)
    catalog = spark.createDataFrame([(k, "INFO <*> <*>") for k in range(30)], "cluster_id int, template string")
    texts = spark.range(500).select(F.col("id").alias("text_id"), F.lit(3).alias("n"), F.array(F.lit("INFO"), F.col("id").cast("string"), F.lit("x")).alias("words"))
    cands = T._candidates(texts, T.literal_index(catalog))
    assert cands.count() == 500 * 30
    spread = cands.groupBy(F.pmod("text_id", F.lit(20))).count()
    assert spread.agg(F.max("count")).first()[0] <= 500 * 30 / 20


def test_enrichment_sends_only_new_templates(spark):
    cat = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "cluster_id int, template string")
    stored = spark.createDataFrame([(0, "{}"), (2, "{}")], "cluster_id int, enriched string")

    def fn(batches):
        for pdf in batches:
            yield pd.DataFrame({"cluster_id": pdf["cluster_id"], "enriched": "new"})

    got = {r[0]: r[1] for r in T.enrich_templates(cat, fn, "small", stored).collect()}
    assert got == {0: "{}", 1: "new", 2: "{}", 3: "new"}


def test_line_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "logs"
    path.mkdir()
    want = []
    for f in range(3):
        body = [f"{f}-{i} " + "x" * (i % 13) for i in range(4000)]
        (path / f"part{f}.log").write_text("\n".join(body) + "\n")
        want += body
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = L.with_line_no(spark.read.text(str(path)))
        assert df.rdd.getNumPartitions() > 5
        assert [r["value"] for r in df.orderBy("line_no").collect()] == want
        dense = L.dense_line_no(df).orderBy("line_no").collect()
        assert [r["line_no"] for r in dense] == list(range(1, len(want) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parsers(spark):
    h = L.parse_hdfs_lines(spark.createDataFrame([("081109 203518 143 INFO dfs.X: got blk_-12 ok",), ("short",)], "value string")).collect()
    assert h[0]["content"] == "INFO dfs.X: got blk_-12 ok" and h[0]["thread"] == "143" and h[0]["timestamp"].year == 2009
    year_first = L.parse_hdfs_lines(spark.createDataFrame([("081109 203518 143 x",)], "value string"), date_format="yyMMdd").first()
    assert (year_first["timestamp"].year, year_first["timestamp"].month) == (2008, 11)
    assert h[1]["timestamp"] is None and h[1]["raw"] == "short"
    b = L.parse_bgl_lines(spark.createDataFrame([("- 1117838570 2005.06.03 R02 2005-06-03-15.42.50.363779 R02 RAS KERNEL INFO cache parity error",)], "value string")).first()
    assert (b["is_anomaly"], b["unix_ts"], b["level"], b["message"]) == (False, 1117838570, "INFO", "cache parity error")


def test_templates_json_array(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('[{"cluster_id": 1, "template": "a <*>", "count": 3, "examples": ["a 1"]}]')
    row = S.read_templates(spark, str(f), multiline=True).first()
    assert (row["cluster_id"], row["count"], list(row["examples"])) == (1, 3, ["a 1"])


def test_upsert_is_idempotent_and_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "session_id string, cluster_id int, w int")
    new = spark.createDataFrame([("a", 1, 9), ("c", 1, 7)], "session_id string, cluster_id int, w int")
    keys = ["session_id", "cluster_id"]
    once = S.upsert(old, new, keys)
    twice = S.upsert(once, new, keys)
    want = [("a", 1, 9), ("b", 1, 6), ("c", 1, 7)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_latest_run(spark):
    df = spark.createDataFrame([("20260101_0900",), ("20260102_0900",)], "run_tag string")
    assert S.latest_run(df).first()[0] == "20260102_0900"
    assert S.latest_run(df, "20260101_0900").count() == 1
    with pytest.raises(ValueError):
        S.latest_run(df, "nope")
    with pytest.raises(ValueError):
        S.latest_run(df.where("false"))


def test_verify_dataset_reports_a_mismatch(spark, tmp_path):
    from weftlog.operators.dataset import dataset_meta

    seqs = spark.createDataFrame([("a", [1, -1], 1, 0, "train"), ("b", [1, 2], 2, 1, "test")], "session_id string, cids array<int>, length int, label int, split string")
    tables = {
        "nodes": seqs.selectExpr("session_id", "1 AS cluster_id"), "edges": seqs.selectExpr("session_id", "1 AS src", "2 AS dst"),
        "sequences": seqs, "embeddings": spark.createDataFrame([(1, [0.0, 1.0])], "cluster_id int, embedding array<double>"),
    }
    S.write_dataset(str(tmp_path / "d"), tables, dataset_meta(seqs, 2, 3))
    got = {r["check"]: r["ok"] for r in S.verify_dataset(spark, str(tmp_path / "d")).collect()}
    assert got.pop("embed_dim") is False and all(got.values())
    tables["sequences"] = seqs.drop("split")
    tables["sequences"].write.mode("overwrite").parquet(str(tmp_path / "d" / "sequences"))
    with pytest.raises(ValueError):
        S.verify_dataset(spark, str(tmp_path / "d"))
