"""Quality rules as a short-circuit cascade of native expressions.

A document passes if no rule rejects it, so the verdict doesn't depend on the order of the rules; what does is the work.
The cascade times each rule, over many repetitions and less what a job costs without it, on a bounded sample of
documents that pass the base rules (``SAMPLE_ROWS``, by the hash of their ids). Then it takes again and again the rule
that rejects most per second of those that the rules before it let pass, and evaluates the rules in this order in one
nested CASE, in which a rule is computed only for documents that all rules before it let pass.

Nulls and empty texts have no words; they fail the base rule of least words. Repeated rows get the same answers.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.storage import materialise

#: Rows on which costs and selectivities are estimated; they decide the order of evaluation alone.
SAMPLE_ROWS = 500
#: How often each row of the sample is judged while a rule is timed.
REPEATS = 20
#: Words of a window.
WINDOW = 8

BLANKS = r"[\x20\x09-\x0D]+"


#: The same characters as a set to trim.
_BLANK_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Of a text without nulls. Trimming first leaves no empty word but that of a text without words."""
    bare = F.btrim(text, F.lit(_BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next(x: Column, by: int) -> Column:
    """``x`` without its first ``by`` values."""
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def _paired(x: Column, by: int) -> Column:
    """The hash of each value and the one ``by`` places later."""
    return let(x, lambda v: let(_next(v, by), lambda later: F.zip_with(F.slice(v, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b))))


def window_hashes(word_array: Column) -> Column:
    """A 64-bit hash of each window of ``WINDOW`` words, by doubling."""
    return _paired(_paired(_paired(F.transform(word_array, lambda w: F.xxhash64(w)), 1), 2), 4)


def repeated_words(windows: Column) -> Column:
    """Words that lie in windows found twice or more among ``windows``.

    Most texts repeat no window, which the number of distinct hashes tells. Else hashes are sorted with their places, so
    equal windows are neighbours, and covered words are counted from the gaps between successive repeated windows.
    """

    def confirmed(exact: Column) -> Column:
        return F.sort_array(
            F.filter(
                F.transform(
                    exact,
                    lambda x, i: F.when(((i > 0) & (F.get(exact, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(exact, i + 1)["h"] == x["h"], F.lit(False))), x["p"]),
                ),
                lambda p: p.isNotNull(),
            )
        )

    covered = F.aggregate(
        let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), confirmed),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the counts of the base rules, all native. Each step's columns are computed once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id"), text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    rows = rows.select("doc_id", "text", "w", "lines", window_hashes(F.col("w")).alias("windows"))
    return rows.select(
        "doc_id",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    #: True where the rule rejects; over the columns of ``features``.
    rejects: Column


def default_rules() -> list[Rule]:
    n, chars, text = F.col("n_words"), F.col("word_chars"), F.col("text")
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lost = lambda piece: F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))
    return [
        Rule("word_length", (chars < 2 * n) | (chars > 14 * n)),
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("capitals", gone(r"[\p{Lu}]+") * 10 > chars * 3),
        Rule("digits", gone("[0-9]+") * 5 > chars),
        Rule("shouting", lost("!!") * 10 > n),
        Rule("laughter", lost("hahaha") * 5 > chars),
    ]


def measured(sample: DataFrame, rules: list[Rule], clock=time.perf_counter) -> list[tuple[str, float, set[int]]]:
    """``(name, seconds, rows rejected)`` of each rule on the sample, which holds the columns of ``features``."""
    names = [f"r{i}" for i in range(len(rules))]
    verdicts = sample.select(*(F.coalesce(r.rejects, F.lit(False)).alias(n) for n, r in zip(names, rules))).collect()
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(said: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = clock()
            many.agg(F.count_if(said)).first()
            best = min(best, clock() - began)
        return best

    empty = seconds(F.col("n_words") + F.length("text") < F.col("again"))
    return [(r.name, max(seconds(r.rejects) - empty, 1e-4), {i for i, v in enumerate(verdicts) if v[n]}) for n, r in zip(names, rules)]


def cascade_order(costs: list[tuple[str, float, set[int]]]) -> list[str]:
    """Most rejections per second first, of rows that no earlier rule rejects; ties by cost, then name."""
    left, gone, out = list(costs), set(), []
    while left:
        best = min(left, key=lambda c: (-len(c[2] - gone) / c[1], c[1], c[0]))
        left.remove(best)
        gone |= best[2]
        out.append(best[0])
    return out


def rejected_by(rules: list[Rule], order: list[str]) -> Column:
    """The first rule, in this order, that rejects; null if none does. Later rules are not computed then."""
    by_name = {r.name: r for r in rules}
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(by_name[name].rejects, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts of ``features`` without the text, ``base_failed``, ``rule`` (the one that rejected) and ``kept``."""
    rules = default_rules() if rules is None else rules
    share = max(1, docs.count() // sample_rows)
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(2 * sample_rows)
    order = cascade_order(measured(materialise(features(some).where(~base_failed()), "sample"), rules))
    rows = features(docs).withColumn("base_failed", base_failed())
    rows = rows.withColumn("rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(rejected_by(rules, order)))
    return rows.withColumn("kept", F.col("rule").isNull()).drop("text", "n_lines")
