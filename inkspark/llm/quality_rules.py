"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects a document by its statistics. `order_rules` draws a bounded sample (about `sample_rows` rows, a parameter,
from the whole table by a hash of doc_id) into a written table and measures there what each rule costs (`costs`: seconds over the sample beyond
those of a job without a rule, compiled before, and repeated where they are few) and which rows it rejects. The first rule is
the one with most rejections per second, the next has most of those among the rows that are left, and so on.
`cascade` evaluates them in this order in one CASE expression, which stops at the first that rejects: the order
changes what is computed, never which documents stay.

A document is rejected by the base rules if it has fewer than 20 words or more than 30 % of its words lie in 8-word
windows that occur twice or more; by the method's further rules (`RULES`) if its symbols, repeated lines, lack of
sentences or extreme word lengths show that it is no running text.

Words are runs of characters other than space and tab to carriage return. Repeated windows are found by hashing: a text
all of whose windows have distinct hashes has none; only in other texts are the windows themselves sorted as strings.

`judge` reports statistics, and so computes all of them; `keep_good` goes no further than the first rejection.

Defined cases: a null or empty text, or one without words, has all statistics 0 and is rejected; repeated rows and rows
without doc_id are judged each; other columns are ignored by `judge` and kept as they are, whatever their names, by
`keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import save, work_dir

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of `width` words that occur twice or more."""

    def windows(ws: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: make(F.slice(ws, i, width)))

    def covered(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = lambda i, j: (j >= 0) & (j <= last) & (F.get(sorted_, i)["w"] == F.get(sorted_, j)["w"])
        starts = F.filter(F.transform(sorted_, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda s: s.isNotNull())
        return bind(F.array_sort(starts), lambda s: F.aggregate(
            s, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["at"])).alias("n"), x.alias("at")),
            lambda a: a["n"],
        ))

    def slow(ws: Column) -> Column:
        made = windows(ws, lambda part: F.array_join(part, " "))
        return bind(F.array_sort(F.transform(made, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)

    hashed = windows(words, lambda part: F.xxhash64(part))
    all_new = bind(hashed, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < width + 1, 0).when(all_new, 0).otherwise(slow(words)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def base_rules(words: Column, repeated: Column) -> dict[str, Column]:
    n = F.size(words)
    return {"few_words": n < 20, "repeated_windows": 100 * repeated > 30 * n}


def more_rules(text: Column, words: Column) -> dict[str, Column]:
    """The method's own rules, each over what it needs."""
    n = F.size(words)
    chars = F.char_length(F.array_join(words, ""))

    def many_repeated(lines: Column) -> Column:
        return (F.size(lines) >= 10) & (100 * (F.size(lines) - F.size(F.array_distinct(lines))) > 50 * F.size(lines))

    return {
        "symbols": 100 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")) > 10 * n,
        "word_length": (chars < 2 * n) | (chars > 15 * n),
        "repeated_lines": bind(lines_with_words(text), many_repeated),
        "shouting": (n >= 20) & (10 * F.regexp_count(text, F.lit(r"[A-Z]{2,}[.,]?!")) > 3 * n),
    }


def rules(text: Column, words: Column) -> dict[str, Column]:
    return base_rules(words, repeated_words(words)) | more_rules(text, words)


def sample(docs: DataFrame, sample_rows: int) -> DataFrame:
    """The texts of about `sample_rows` rows of the whole table, by a hash of doc_id; twice as many at most, if ids repeat."""
    share = sample_rows / max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    return docs.where(drawn).select(F.coalesce("text", F.lit("")).alias("text")).limit(2 * sample_rows)


def costs(some: DataFrame, named: dict[str, Column], more: int = 4) -> dict[str, float]:
    """Seconds that each rule takes over the sample (text, words), which is one partition; quick ones are run `more` times a row."""

    def seconds(times: int, tested: Column) -> float:
        again = F.filter(F.sequence(F.lit(1), F.lit(times)), lambda i: tested & (i > 0))  # tested as often for each row
        began = time.perf_counter()
        some.agg(F.sum(F.size(again))).first()
        return time.perf_counter() - began

    nothing, out = F.size("words") < 0, {}
    seconds(1, nothing)  # compiles, as the first run of each rule does
    without = {times: seconds(times, nothing) for times in (1, more)}
    for name, rule in named.items():
        times = 1 if seconds(1, rule) > 4 * without[1] else more
        out[name] = max(seconds(times, rule) - without[times], 1e-4) / times
    return out


def order_rules(docs: DataFrame, sample_rows: int = 2000) -> list[str]:
    """The rules' names: each rejects most per second, by a measured sample, of the rows that those before leave."""
    drawn = sample(docs, sample_rows)
    some = save(drawn.select("text", words_of(F.col("text")).alias("words")).coalesce(1), work_dir(docs.sparkSession, "rules"))
    named = rules(F.col("text"), F.col("words"))
    # a row for each combination of answers, of which six rules have 64
    answers = some.groupBy(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in named.items()]).agg(F.count(F.lit(1)).alias("n")).collect()
    took, order = costs(some, named), []
    while len(order) < len(named):
        left = [r for r in answers if not any(r[name] for name in order)]
        gain = {name: (sum(r["n"] for r in left if r[name]) + 0.5) / took[name] for name in named if name not in order}
        order.append(max(gain, key=gain.__getitem__))
    return order


def cascade(named: dict[str, Column], order: list[str]) -> Column:
    """The first rule in order that rejects, else null."""
    out = F.when(named[order[0]], order[0])
    for name in order[1:]:
        out = out.when(named[name], name)
    return out


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The base statistics with base_failed, kept and the rejecting rule of every document."""
    order = order or order_rules(docs)
    text = F.col("text")

    def report(words: Column) -> Column:
        def with_repeated(repeated: Column) -> Column:
            base = base_rules(words, repeated)
            first = cascade(base | more_rules(text, words), order)
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                bind(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                (base["few_words"] | base["repeated_windows"]).alias("base_failed"),
                first.alias("rejected_by"),
            )

        return bind(repeated_words(words), with_repeated)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.inline(F.transform(F.array(words_of(text)), report)))
    return rows.select("*", F.col("rejected_by").isNull().alias("kept"))


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; each is judged no further than its first rejection."""
    order = order or order_rules(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(bind(words_of(text), lambda words: cascade(rules(text, words), order)).isNull())
