"""The license join against plain Python: permuted, thinned and mixed blocks, and many templates."""

import random
import re

from pyspark.sql import functions as F

from inkspark.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_filters_lose_nothing_and_reject_something(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = {f"l{i}": [" ".join(rnd.sample(words, rnd.randrange(5, 25)))] for i in range(120)}
    made = []
    for some in list(texts.values())[:60]:
        w = some[0].split()
        rnd.shuffle(w)
        drop = rnd.randrange(0, 4)  # at, above and below the threshold
        made.append(" ".join(w[drop:] + rnd.sample(words, rnd.randrange(0, 9))))
        made.append("\n".join(w[drop:]))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs, texts, 80, {}).collect()}
    positive = 0
    for i, t in enumerate(made):
        lines, own, score = [set(x.split()) for x in t.split("\n")], set(), 0.0
        for label, (template,) in texts.items():
            want, n, ws = set(template.split()), len(template.split()), t.split()
            best = max(len(want & b) for b in lines + [set(ws[j : j + n]) for j in range(len(ws))])
            if 100 * best >= 80 * len(want):
                own.add(label)
                score = max(score, best / len(want))
        positive += len(own)
        assert got[i] == (",".join(sorted(own)), score)
    assert positive > 80

    counts = {w: sum(w in t.split() for t in made) for w in words}
    templates = [license_scan.Template(label, t, counts, 80) for label, (t,) in texts.items()]
    kinds = license_scan._kinds(templates, counts)
    rows = docs.select("doc_id", "text", license_scan.words_of(F.col("text")).alias("words"))
    blocks = rows.select("doc_id", F.inline(license_scan.blocks_of(F.col("text"), F.col("words"), kinds))).distinct()
    table = license_scan.prefixes(spark, templates)
    key = ["doc_id", "kind", "tokens", "label"]
    every = license_scan.candidates(blocks, table, positional=False).select(*key).distinct()
    passing = license_scan.candidates(blocks, table).select(*key).distinct()
    found = license_scan.matches(blocks, table).select(*key).distinct()
    assert 0 < found.count() < passing.count() < every.count()


def test_kelvin_sign_is_no_k(spark):
    docs = spark.createDataFrame([(1, "\u212a MIT License"), (2, "m\u0130t license \u212a"), (3, "MIT licen\u017fe")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"]) for r in license_scan.scan(docs).collect()}
    assert got == {1: (3, 1), 2: (3, 0), 3: (2, 0)}
    rows = docs.select(F.explode(license_scan.words_of(license_scan.lowered(F.col("text")))).alias("w"))
    assert "k" not in {r["w"] for r in rows.collect()}
