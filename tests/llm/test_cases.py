"""Null ids, repeated rows, long texts and columns with clashing names, for each of the ten operators, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import common, decontam, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, token_files, tokens, url_filter
from inkspark.llm.queries import tokenizer_path

EXTRA = ["kept", "n_lines", "line_drops", "N_Dropped", "shard", "Tier", "a.b", "words", "blocks", "row", "gone_id", "rep", "score", "tie", "task", "label", "h1", "text.x"]
KIND = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in EXTRA)
LINE = "A line of more than twenty characters"
LONG = " ".join(f"word{i % 977}x{i % 1013}" for i in range(30_000))
TEXTS = [None, "", "one two three", f"{LINE}\nx", f"{LINE}\ny", f" {LINE.upper()}\t\nz", "mit license " * 3, LONG, LONG + " more", "é" * 30 + "\n" + LINE]
IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
ROWS = list(zip(IDS, TEXTS, strict=True)) + [(None, f"{LINE}\nnobody's"), (None, LONG), (None, None), (5, f"{LINE}\ny"), (5, f"{LINE}\ny"), (8, LONG)]


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, len(t or ""), *(f"{c}-{i}" for c in EXTRA)) for i, t in ROWS]
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


def others(rows, names):
    """The extra values of each row, which name their column and doc_id."""
    for r in rows:
        d = r.asDict()
        assert [d[c] for c in names] == [f"{c}-{d['doc_id']}" for c in names]


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs, batches=2, digest=True)
    assert out.columns == ["doc_id", "n_chars", *EXTRA, "n_lines_", "n_dropped_", "kept_"]
    rows = out.collect()
    others(rows, EXTRA)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = collections.defaultdict(list)
    for i, t in ROWS:
        for k in {key(x) for x in (t or "").split("\n") if t is not None and i is not None}:
            where[k].append(i)
    want = collections.Counter()
    for i, t in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == i]
        want[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_lines_"], r["n_dropped_"], r["kept_"]) for r in rows) == want
    assert sum(k[2] * n for k, n in want.items()) == 5
    stay = line_dedup.without_repeated_lines(docs)
    assert stay.schema == docs.schema and all(r["n_chars"] == len(r["text"] or "") for r in stay.collect())
    assert docs.sparkSession.sql("show tables like 'line_run_*'").count() == 0


def test_line_runs_hold_each_key_once(spark, docs):
    runs = line_dedup.LineRuns(spark, common.work_dir(spark, "t"), fanout=3)
    keys = line_dedup.keys_of(docs)
    runs.add(keys.where("doc_id < 6"))
    runs.add(keys.where("doc_id >= 6"))
    held = [spark.table(x).select("h1", "h2") for x in runs.runs()]
    assert len(held) == 2 and held[0].intersect(held[1]).count() == 0
    assert held[0].union(held[1]).exceptAll(keys.select("h1", "h2").distinct()).count() == 0
    counted = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
    assert runs.merged().exceptAll(counted).count() == 0 == counted.exceptAll(runs.merged()).count()
    # the anti-joins read the sorted buckets as they are
    plan = runs.unseen(spark.table(runs.runs()[1]))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "Exchange" not in plan.partition("== Physical Plan ==")[2]
    runs.close()


def test_url_filter(spark):
    long = "https://example.com/" + "path/" * 40_000 + "?q"
    rows = [(1, "https://a.net/es/1", "x"), (1, "https://a.net/es/1", "x"), (None, None, "x"), (2, long, "x"), (3, "://", "x"), (4, "http://?#", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, `host` string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filter.judge_urls(pages).collect())
    assert got == {(1, "a.net", "/es/1", "net/es/"): 2, (None, "", "", None): 1, (2, "example.com", "/" + "path/" * 40_000, "com/"): 1, (3, "", "", None): 1, (4, "", "", None): 1}


def test_packing(docs):
    path = tokenizer_path("word_bpe_49k.json")
    enc, want = tokens.Encoder(path), collections.Counter()
    for i, t in ROWS:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want[i, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_sharding(docs):
    out = sharding.shard_documents(docs, arrivals=3, fanout=2, base_bytes=1000)
    assert out.columns == [*docs.columns, "shard_", "tier_"]
    rows = out.collect()
    others(rows, EXTRA)
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter(ROWS)


def test_vacuum_leaves_what_is_not_committed_yet(spark, docs):
    store = sharding.ShardStore(spark, common.work_dir(spark, "t"), docs.schema, fanout=2)
    for low in (1, 3, 5):
        store.append(docs.where(F.col("doc_id").between(low, low + 1)))
    docs.limit(2).write.parquet(f"{store.root}/shards/a9-other")
    settings = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store.compact()
    store.vacuum()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == settings
    assert spark.read.parquet(f"{store.root}/shards/a9-other").count() == 2
    listed = store.manifest().collect()
    for r in listed:  # the manifest's numbers are the files'
        path = store.path(f"{store.root}/shards/{r['shard']}")
        assert store.fs.getFileStatus(path).getLen() == r["bytes"] and spark.read.parquet(f"{store.root}/shards/{r['shard']}").count() == r["rows"]
    files = [f for a in store.fs.listStatus(store.path(f"{store.root}/shards")) if "other" not in str(a.getPath()) for f in store.fs.listStatus(a.getPath()) if str(f.getPath()).endswith(".parquet")]
    assert len(files) == len(listed) == len({r["shard"] for r in listed}) and store.read().count() == docs.where("doc_id < 7").count()


def test_token_files(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    enc = tokens.Encoder(path)
    want = collections.Counter()
    for i, t in ROWS:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = token_files.round_trip(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: (r["start"], r["n_tokens"])):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_near_dedup(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    component = {8: 8, 9: 8}  # the texts of 4 and 5 are other short ones
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert got == collections.Counter((i, component.get(i, i), i not in (9,)) for i, _ in ROWS)
    kept = near_dedup.keep_one(docs)
    assert kept.schema == docs.schema and kept.count() == len(ROWS) - 1
    others(kept.collect(), EXTRA)


def test_near_dedup_links_classes_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, b + " more"), (5, c)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_quality_classifier(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2, "x") for i in range(1, 11)] + [(None, 1, "x"), (3, None, "x"), (4, 7, "x"), (5, 1, "x")], "doc_id long, quality int, features string")
    rows = quality_classifier.classify(docs, labels).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert collections.Counter((r["doc_id"], r["held_out"]) for r in rows) == collections.Counter((i, fold(i)) for i, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_scores_are_the_discriminant_s(spark):
    """The scores equal log-density differences computed from the features with plain numpy."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    x = {r["doc_id"]: np.array(r["features"]) for r in quality_classifier.features(docs).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [i for i in x if i in y and zlib.crc32(str(i).encode()) % 5]
    of = [np.array([x[i] for i in known if y[i] == c]) for c in (0, 1)]
    pooled = sum(((o - o.mean(0)) ** 2).sum(0) for o in of) / len(known)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    for i, v in x.items():
        dense = []
        for o in of:
            spread = 0.9 * np.cov(o.T, bias=True) + 0.1 * np.diag(pooled) + 1e-4 * np.eye(len(v))
            gap = v - o.mean(0)
            dense.append(-0.5 * (gap @ np.linalg.solve(spread, gap) + np.linalg.slogdet(spread)[1]))
        odds = (dense[1] - dense[0] + np.log(len(of[1]) / len(of[0]))) / 2
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -500, 500))), abs=1e-6)


def test_license_scan(docs):
    rows = license_scan.scan(docs).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in rows) == collections.Counter((i, len(word.findall((t or "").lower())), 3 * (i == 7), "mit" * (i == 7)) for i, t in ROWS)


def test_quality_rules(docs):
    rows = quality_rules.judge(docs).collect()
    want = collections.Counter()
    for i, t in ROWS:
        w, lines = word_list(t), [x for x in (t or "").split("\n") if word_list(x)]
        n = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = len({j + k for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for k in range(8)})
        symbols, chars, twice = len(re.findall(r"[#*$%&|<>]", t or "")), sum(map(len, w)), len(lines) - len(set(lines))
        base = len(w) < 20 or 100 * repeated > 30 * len(w)
        shouts = len(re.findall(r"[A-Z]{2,}[.,]?!", t or ""))
        more = 100 * symbols > 10 * len(w) or chars < 2 * len(w) or chars > 15 * len(w) or len(lines) >= 10 and 100 * twice > 50 * len(lines) or 10 * shouts > 3 * len(w)
        want[i, len(w), chars, symbols, twice, repeated, base, not (base or more)] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert collections.Counter(tuple(r[c] for c in names) for r in rows) == want
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema and kept.count() == sum(n for k, n in want.items() if k[-1])
    others(kept.collect(), EXTRA)


def test_decontamination(spark, docs):
    items = [(1, "one TWO three", "x"), (1, "one TWO three", "x"), (None, "one two three", "x"), (2, " ".join(LONG.split()[500:540]), "x"), (3, LONG, "x"), (4, None, "x")]
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string")

    def shingle(t):
        w = word_list((t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    sets = [(q, shingle(t)) for q, t, _ in items]
    want = collections.Counter()
    for i, t in ROWS:
        own = shingle(t)
        for q, s in sets:
            if s and 100 * len(own & s) >= 75 * len(s):
                want[i, q, len(s), len(own & s)] += 1
    for values in (4_000_000, 20_000):
        rows = decontam.contaminated(docs, table, block_values=values).collect()
        assert collections.Counter((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in rows) == want
    clean = decontam.drop_contaminated(docs, table)
    assert clean.schema == docs.schema and clean.count() == sum(i is None or (i, t) not in {(3, TEXTS[2]), (8, LONG), (9, TEXTS[8])} for i, t in ROWS)


def test_item_partitions_that_need_more_are_skipped():
    sets = [np.arange(1, n + 1, dtype=np.uint64) for n in (3, 40, 500)]
    index = decontam.ItemIndex([1, 2, 3], sets, 75, 100)
    assert [least for least, _, _ in index.parts] == [3, 30, 375]
    assert index.matches(np.arange(1, 32, dtype=np.uint64)) == [(0, 3), (1, 31)]


def test_lookup_with_and_without_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(i % 7 if i % 2 else 1, None if i % 50 == 0 else i % 5, i) for i in range(400)], "k int, m int, v int")
    right = spark.createDataFrame([(k, m, f"{k}{m}") for k in range(5) for m in range(4)], "k int, m int, name string")
    for few in (10, 10_000):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        for how in ("inner", "left"):
            got = common.lookup(left, right, ["k", "m"], how)
            assert got.exceptAll(left.join(right, ["k", "m"], how)).count() == 0 == left.join(right, ["k", "m"], how).exceptAll(got).count()


def test_work_dir_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Elsewhere()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.work_dir(Session(), "x")


def test_packing_writes_few_small_files(spark, tmp_path):
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), (F.col("id") % 60).cast("int")).alias("text")).repartition(4)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        packing.pack(rows, tokenizer_path("word_bpe_49k.json")).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
