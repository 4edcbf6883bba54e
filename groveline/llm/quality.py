"""Quality rules as weak supervision.

Each rule votes to keep, votes to drop, or abstains. Expectation-maximisation over the counts of vote patterns (at most 3 to the
power of the rules, whatever the corpus) estimates the share of good documents and how each rule votes on good and on bad ones, and
a document's verdict is its posterior probability of being good, in place of a filter that all rules must pass. No rule is trusted
beforehand: all start alike, a vote being somewhat more often right than wrong. The base thresholds of the contract hold besides; no
rule repeats them, and the fit is made over all documents that pass them, where the verdict counts.

Defined results: a null or wordless text has zeros and fails the base thresholds; repeated rows get the same
result each; an empty table gives an empty result; columns other than doc_id and text are not read, or handed on if ``keep`` names
them. One text is handled as one row, whole, with some 100 bytes of memory for each of its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm.common import words, written

WINDOW = 8
#: A line that ends as a sentence does, whatever closes after it.
ENDED = r"[.!?:;\u2026\u3002][\"'\u00bb\u201c\u201d\u2019)\]]*[\x20\x09-\x0D]*$"


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts that the rules and the base thresholds use, one row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_words"))
    # the few characters that any count below looks at, so that the text itself is searched once
    df = df.withColumn("_marks", F.regexp_replace("_text", "[^A-Z!#*$%&|<>]+", "")).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.char_length(F.regexp_replace("_marks", "[A-Z!]+", "")).cast("long"))
    df = df.withColumn("n_capitals", F.char_length(F.regexp_replace("_marks", "[^A-Z]+", "")).cast("long"))
    df = df.withColumn("n_exclamations", F.char_length(F.regexp_replace("_marks", "[^!]+", "")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_ended", F.size(F.filter("_lines", lambda x: x.rlike(ENDED))).cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("n_bare", F.size(F.filter("_words", lambda w: ~w.rlike(r"\p{L}"))).cast("long"))
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))).drop("_text", "_marks", "_lines", "_words")
    at = [lambda i, k=k: F.get("_hash", i + k) for k in range(WINDOW)]
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[a(i) for a in at]))
    df = df.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_hash", "_windows")
    same = lambda e, i: (e["h"] == F.get("_sorted", i - 1)["h"]) | (e["h"] == F.get("_sorted", i + 1)["h"])
    df = df.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", same), lambda e: e["i"]))).drop("_sorted")
    covered = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, c: a + c), F.lit(0)).cast("long")).drop("_starts")


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``drop`` holds, 1 where ``keep`` holds, else 0."""

    name: str
    drop: Column
    keep: Column

    def vote(self) -> Column:
        return F.when(self.drop, -1).when(self.keep, 1).otherwise(0).cast("int")


def rules() -> list[Rule]:
    """Each votes both ways: what is usual in running text on one side, what is rare in it on the other, nothing in between."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    c = F.col
    return [
        Rule("symbols", c("n_symbols") * 10 > n, c("n_symbols") * 100 <= n),
        Rule("word_length", (c("word_chars") > n * 7) | (c("word_chars") < n * 3), c("word_chars").between(n * 4, n * 6)),
        Rule("letters", c("n_bare") * 5 > n, c("n_bare") * 20 <= n),
        Rule("capitals", c("n_capitals") * 10 > F.greatest(c("word_chars"), F.lit(1)) * 3, c("n_capitals") * 10 <= c("word_chars")),
        Rule("exclamations", c("n_exclamations") * 10 > n, c("n_exclamations") * 100 <= n),
        Rule("line_ends", c("n_ended") * 2 < c("n_lines"), c("n_ended") * 10 >= c("n_lines") * 8),
        Rule("repeated_lines", c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") == 0),
        Rule("repeated_words", c("n_repeat_words") * 8 > n, c("n_repeat_words") == 0),
    ]


#: Documents that the fit is told of before it sees any: of each class one that gets no vote and one that gets a wrong one, two that get a right one.
PRIOR = {True: {-1: 1.0, 0: 1.0, 1: 2.0}, False: {-1: 2.0, 0: 1.0, 1: 1.0}}


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 2000, close: float = 1e-10) -> tuple[float, list[dict[int, float]]]:
    """(log odds of a good document, for each rule and vote the log of how much likelier a good document gets it).

    Two classes, votes independent within a class. ``PRIOR`` holds for every rule, and as many good as bad documents, so that every
    probability stays inside (0, 1). Rounds end when no probability moves by more than ``close``.
    """
    share = 0.5
    table = [{c: {v: x / sum(p.values()) for v, x in p.items()} for c, p in PRIOR.items()} for _ in range(n_rules)]
    for _ in range(rounds):
        mass = [{c: dict(p) for c, p in PRIOR.items()} for _ in range(n_rules)]
        good, total = 1.0, 2.0
        for votes, count in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(table[j][True][v] / table[j][False][v]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good, total = good + p * count, total + count
            for j, v in enumerate(votes):
                mass[j][True][v] += p * count
                mass[j][False][v] += (1 - p) * count
        before, share_before = table, share
        share = min(1 - 1e-12, good / total)
        table = [{c: {v: x / sum(m[c].values()) for v, x in m[c].items()} for c in m} for m in mass]
        moved = max([abs(share - share_before), *(abs(t[c][v] - b[c][v]) for t, b in zip(table, before, strict=True) for c in t for v in t[c])])
        if moved <= close:
            break
    return math.log(share / (1 - share)), [{v: math.log(t[True][v] / t[False][v]) for v in (-1, 0, 1)} for t in table]


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """``keep``, the counts of the contract, each rule's vote, p_good, base_failed and kept for each document."""
    votes = rules()
    seen = features(docs, keep)
    seen = written(seen.withColumns({f"vote_{r.name}": r.vote() for r in votes}))
    names = [f"vote_{r.name}" for r in votes]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = seen.where(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns = sorted((tuple(r[v] for v in names), r["_n"]) for r in counts)
    prior, weights = fit(patterns, len(votes))
    odds = F.lit(prior)
    for name, w in zip(names, weights, strict=True):
        odds = odds + F.when(F.col(name) == -1, w[-1]).when(F.col(name) == 1, w[1]).otherwise(w[0])
    out = seen.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *names)
