"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
SAMPLE_ROWS = 2_000  # rows on which costs and selectivities are measured
REPEATS, RUNS = 4, 2  # times that a rule runs on each of them, and that this is timed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, as an array; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Only if some are equal, places are sorted by hash,
    those with an equal neighbour are put in order, and each covers what the next one leaves.
    """
    n = F.size(words) - 2
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))),
                         lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(by_hash, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (
            ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
            | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))), lambda x: x["i"])))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), at + 3) - at)), F.lit(0), lambda a, x: a + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("long")


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: word_chars(words),
    "n_symbols": lambda text, words: symbols(text),
    "n_dup_lines": lambda text, words: duplicate_lines(text),
    "n_repeat_words": lambda text, words: repeated_words(words),
}


@dataclass(frozen=True)
class Measured:
    """A text, its words and its measures: those in `known` are columns already, others are computed where they are used."""

    text: Column
    words: Column
    known: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.known else MEASURES[name](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """A reason to reject a text."""

    name: str
    fails: Callable[[Measured], Column]


def base_rules() -> list[Rule]:
    return [Rule("few_words", lambda m: m["n_words"] < 50),
            Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"])]


def more_rules(symbol_share: float = 0.25, line_share: float = 0.7, short: float = 2.0, long: float = 20.0) -> list[Rule]:
    """Symbols per word, repeated lines per line, and words that are short or long on average."""
    def lines(text: Column) -> Column:
        return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))

    return [Rule("symbols", lambda m: m["n_symbols"] > symbol_share * m["n_words"]),
            Rule("repeated_lines", lambda m: (m["n_dup_lines"] > 0) & (m["n_dup_lines"] > line_share * lines(m.text))),
            Rule("word_length", lambda m: (m["word_chars"] < short * m["n_words"]) | (m["word_chars"] > long * m["n_words"]))]


def default_rules() -> list[Rule]:
    return base_rules() + more_rules()


def sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`text`, `words` of about SAMPLE_ROWS rows chosen by a hash of the id, stored."""
    share = min((1 << 62) - 1, int((1 << 62) * SAMPLE_ROWS / max(docs.count(), 1)))
    some = docs.filter(F.xxhash64(F.lit("sample"), F.col(id_col)).bitwiseAND((1 << 62) - 1) <= share)
    return stored(some.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text"))), "sample")


def seconds(sample: DataFrame, rule: Column) -> float:
    """Time that the rule takes on the sample, REPEATS times over; the least of RUNS runs."""
    rows = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    best = math.inf
    for _ in range(RUNS):
        start = time.perf_counter()
        rows.agg(F.count_if(rule)).first()
        best = min(best, time.perf_counter() - start)
    return best


def estimate(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> list[tuple[str, float, float]]:
    """(name, cost, share rejected) of each rule, measured on a stored sample.

    The cost is the time that the rule takes beyond that of a rule which only asks for the
    number of words; it is never less than a fiftieth of that, so that noise cannot make it zero or less.
    """
    sample = sampled(docs, id_col, text_col)
    tests = [r.fails(Measured(F.col("text"), F.col("words"))) for r in rules]
    got = sample.agg(*(F.avg(t.cast("int")).alias(f"r{i}") for i, t in enumerate(tests))).first()
    least = seconds(sample, F.size("words") < 0)
    return [(r.name, max(seconds(sample, t) - least, least / 50), got[f"r{i}"] or 0.0) for i, (r, t) in enumerate(zip(rules, tests))]


def ordered(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules by rejections per cost, the most first; of equal ones the cheaper first."""
    rank = {name: (-share / cost, cost, name) for name, cost, share in estimate(docs, rules, id_col, text_col)}
    return sorted(rules, key=lambda r: rank[r.name])


def verdict(rules: list[Rule], measured: Measured) -> Column:
    """The name of the first rule that fails, or null. Later rules are not computed then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(measured), rule.name).otherwise(out)
    return out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """`doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`,
    `kept`, `rejected_by` per row.

    All measures are shown for every row. The verdict is that of the cascade over all rules, in the order of
    rejections per cost; `rejected_by` is its first rule that fails, so which of several it names may
    differ between runs, as times do, but not whether there is one. A null text counts as empty, and so
    fails for its few words. Repeated rows get equal answers, whole texts are measured, other
    columns are not read and an empty table gives no rows.
    """
    order = ordered(docs, rules or default_rules(), id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    measured = Measured(F.col("text"), F.col("words"))
    rows = rows.select("doc_id", "text", "words", *(measured[name].alias(name) for name in MEASURES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first = verdict(order, Measured(F.col("text"), F.col("words"), tuple(MEASURES)))
    return (rows.select("doc_id", *MEASURES, base.alias("base_failed"), first.alias("rejected_by"))
            .withColumn("kept", F.col("rejected_by").isNull()))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of `docs`, with their columns, that no rule rejects.

    Null, empty and blank texts are rejected for their few words; repeated rows stay or go
    together; an empty table stays empty.
    """
    order = ordered(docs, rules or default_rules(), id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Words are bound inside the condition: a column of its own would be computed again at each use.
    return docs.filter(let(words_of(text), lambda words: verdict(order, Measured(text, words))).isNull())
