"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Words are runs of characters other than ASCII blanks, punctuation and controls, A-Z lower-cased. A block is a line, or, over
the whole text and so across lines, any run of as many words as a template has. A block gives a template's label if it holds
at least `percent` of the template's distinct words. The join is exact:

* tokens: the templates' words, ordered by the number of documents of the whole table that hold them, rarest first (ties by
  the word); other words can't be shared, so blocks keep only tokens, each once and in this order;
* prefixes: a template of n tokens needs a = ceil(percent * n) of them, so that a block with so many holds one of the
  template's n - a + 1 rarest, and has it among its own m - a + 1 rarest of m. Both prefixes are joined on the token;
* length filter: the block has at least a tokens;
* positional filter: a pair that meets at place p of the template and place q of the block shares n - p and m - q tokens at
  most from there on (what comes before is paired by an earlier token), so both have to be at least a;
* what passes is verified by the size of the intersection.

The blocks of a document that hold no token of any template's prefix are never made, and of runs only those around one.
Their rows, with the documents' base places, are written once, without the texts. The template table is a parameter; its
prefixes are broadcast up to `BROADCAST_ROWS` rows and joined by a shuffle beyond.

A short form whose words all stand in another license's notice too is matched by runs of words only, all of them in it: in a
line that holds more words, it would be found in the other notice.

Base labels are found as phrases of consecutive words anywhere in the text.

Defined cases: a null or empty text, or one without words, has zero counts, null places, empty labels and score 0;
repeated rows and rows without doc_id are scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.common import BROADCAST_ROWS, save, work_dir

#: Phrases with their labels, and notices by which texts commonly state a license.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "apache": ["licensed under the apache license version 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["licensed under creative commons attribution 4 0 international"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under creative commons attribution noncommercial 4 0 international"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under creative commons attribution sharealike 4 0 international"],
    "cc0": ["dedicated to the public domain under cc0 1 0 universal"],
}
SHORT_FORMS = {"cc-by": ["licensed under cc by 4 0"]}
#: What parts words, in a text whose A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KELVIN = "\u212a"  # the only character other than A-Z whose lower case is a letter of a-z alone
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """The text in lower case, in which words of a-z stand just where they stand, in any case of A-Z, in the text."""
    return F.when(text.contains(_KELVIN), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of an already lower-cased text."""
    return F.array_remove(F.split(text, GAP), "")


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def document_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How many documents of the whole table hold each word."""
    found = docs.select(F.explode(F.array_intersect(literal(words), words_of(lowered(F.coalesce("text", F.lit("")))))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each template word at most
    return {w: counts.get(w, 0) for w in words}


class Template:
    """A template's tokens, rarest first, and what its filters need."""

    def __init__(self, label: str, text: str, counts: dict[str, int], percent: int, in_lines: bool = True):
        self.label, self.kinds = label, [len(text.split())] + [LINE] * in_lines
        self.tokens = sorted(set(text.split()), key=lambda w: (counts[w], w))
        self.least = -(-percent * len(self.tokens) // 100)
        self.prefix = self.tokens[: len(self.tokens) - self.least + 1]


#: The kind of blocks that are lines; other kinds are runs of so many words.
LINE = 0


def prefixes(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """A row for each kind of block and each token of a template's prefix."""
    rows = [(kind, w, place, t.least, t.label, t.tokens) for t in templates for kind in t.kinds for place, w in enumerate(t.prefix)]
    made = spark.createDataFrame(rows, "kind int, token string, place int, least int, label string, template array<string>")
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def _kinds(templates: list[Template], counts: dict[str, int]) -> dict[int, Column]:
    """For each kind of blocks: kind, the least tokens that any template needs, all prefixes and all tokens in order."""
    out = {}
    for kind in sorted({k for t in templates for k in t.kinds}):
        own = [t for t in templates if kind in t.kinds]
        tokens = sorted({w for t in own for w in t.tokens}, key=lambda w: (counts[w], w))
        prefix = sorted({w for t in own for w in t.prefix})
        out[kind] = F.struct(F.lit(kind).alias("kind"), F.lit(min(t.least for t in own)).alias("least"), literal(prefix).alias("prefix"), literal(tokens).alias("tokens"))
    return out


def _block(kind: Column, words: Column) -> Column:
    return F.struct(kind["kind"].alias("kind"), kind["least"].alias("least"), F.array_intersect(kind["tokens"], words).alias("tokens"))


def _line_blocks(text: Column, kind: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), words_of), lambda ws: F.arrays_overlap(ws, kind["prefix"]))
    return F.transform(lines, lambda ws: _block(kind, ws))


def _run_blocks(words: Column, kind: Column) -> Column:
    """All runs of kind["kind"] words that hold a word of a prefix, as far as the words around it can hold enough tokens."""
    n = kind["kind"]
    first = lambda i: F.greatest(i - n + 2, F.lit(1))
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(kind["prefix"], w), i)), lambda i: i.isNotNull())
    near = F.filter(places, lambda i: F.size(F.array_intersect(kind["tokens"], F.slice(words, first(i), 2 * n - 1))) >= kind["least"])
    starts = F.array_distinct(F.flatten(F.transform(near, lambda i: F.sequence(first(i), i + 1))))
    return F.transform(starts, lambda s: _block(kind, F.slice(words, s, n)))


def blocks_of(text: Column, words: Column, kinds: dict[int, Column]) -> Column:
    """array<struct<kind, least, tokens>> of the blocks of a lower-cased text that can pass the length filter of their kind."""
    runs = [c for k, c in kinds.items() if k != LINE]
    made = F.flatten(F.transform(F.filter(F.array(*runs), lambda k: F.arrays_overlap(words, k["prefix"])), lambda k: _run_blocks(words, k)))
    if LINE in kinds:
        lines = kinds[LINE]
        made = F.concat(made, F.when(F.arrays_overlap(words, lines["prefix"]), _line_blocks(text, lines)).otherwise(F.array().cast(BLOCKS)))
    return F.filter(made, lambda b: F.size(b["tokens"]) >= b["least"])


BLOCKS = "array<struct<kind:int,least:int,tokens:array<string>>>"


def candidates(blocks: DataFrame, templates: DataFrame, positional: bool = True) -> DataFrame:
    """Pairs of blocks (kind, least, tokens and other columns) and templates whose prefixes meet, after the filters."""
    prefix = F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("at", "token")
    pairs = blocks.select("*", prefix).drop("least").join(templates, ["kind", "token"]).where(F.size("tokens") >= F.col("least"))
    rest = F.least(F.size("tokens") - F.col("at"), F.size("template") - F.col("place"))
    return pairs.where(rest >= F.col("least")) if positional else pairs


def matches(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """What the candidates give that share enough tokens: the blocks' columns with label and share."""
    shared = F.size(F.array_intersect("template", "tokens"))
    return candidates(blocks, templates).withColumn("shared", shared).where("shared >= least").withColumn("share", F.col("shared") / F.size("template"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other, from 0."""
    parts = phrase.split()
    hit = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == p for j, p in enumerate(parts)])
    return F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & hit(i), i)), lambda i: i.isNotNull())


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = 90, short_forms: dict[str, list[str]] = SHORT_FORMS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    spark = docs.sparkSession
    vocabulary = sorted({w for some in (templates, short_forms) for texts in some.values() for t in texts for w in t.split()})
    counts = document_counts(docs, vocabulary)
    made = [Template(label, text, counts, percent) for label, texts in templates.items() for text in texts]
    made += [Template(label, text, counts, 100, in_lines=False) for label, texts in short_forms.items() for text in texts]
    kinds = _kinds(made, counts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    none = F.array().cast("array<int>")
    ends = literal(sorted({p.split()[-1] for p in PHRASES}))
    starts = [F.when(F.arrays_overlap("words", ends), phrase_starts(F.col("words"), p)).otherwise(none) for p in PHRASES]
    rows = rows.select("*", F.array(*starts).alias("at"), F.flatten(F.array(*starts)).alias("places"))
    base = F.filter(F.transform(F.array(*map(F.lit, PHRASES.values())), lambda x, i: F.when(F.size(F.get("at", i)) > 0, x)), lambda x: x.isNotNull())
    found_in = F.when(F.arrays_overlap("words", literal(sorted({w for t in made for w in t.prefix}))), blocks_of(F.col("text"), F.col("words"), kinds))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        base.alias("base"), found_in.alias("blocks"),
    )
    rows = save(rows, work_dir(spark, "licenses"))
    blocks = rows.where(F.size("blocks") > 0).select("row", F.inline("blocks"))
    found = matches(blocks, prefixes(spark, made)).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
