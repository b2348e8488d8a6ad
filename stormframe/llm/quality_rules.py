"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``order_rules`` measures on a bounded sample how much of it each rule rejects
and what the rule costs, counts that it alone needs included, and sorts the
rules, the two of the base among them, by rejection per cost; ``verdict`` nests
them in that order, so a row stops at the first rule that rejects it. Where only
the verdict is wanted (``keep_documents``), words and their characters are
counted first and the other counts (``on_demand``) only for rows that reach the
rule that asks: a row that a cheap rule rejects has no 3-word windows built.
``features`` counts all for each text. The order changes only the cost, never a
verdict.

Defined cases: a null text has no words and fails the base rule; an empty table
gives no rows; equal texts get equal verdicts; other columns pass through, and
helper columns take names that the input does not have.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import checkpointed, fresh_name

SPACE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
#: Most rows that the driver takes to estimate costs and selectivities.
SAMPLE_ROWS = 400


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a class a text has: the length of what is left without the others."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def windows_of_three(tokens: Column) -> Column:
    """All 3-word windows as strings, in order."""
    return F.transform(
        F.filter(F.transform(tokens, lambda w, i: i), lambda i: i < F.size(tokens) - 2),
        lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )


def repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more.

    Only a text with a repeated window is sorted: equal windows then stand side
    by side, and the union of their word ranges is counted by the gaps between
    their starts.
    """
    by_window = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    first = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = lambda at: F.aggregate(
        at,
        first,
        lambda a, i: F.struct((i + 3).alias("upto"), (a["n"] + i + 3 - F.greatest(i, a["upto"])).alias("n")),
    )["n"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(bound(by_window, starts))).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


Features = Mapping[str, Column]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(f: Features) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def counted(df: DataFrame, text_col: str, tokens: str) -> DataFrame:
    """Add the words, how many they are and their characters: several rules look at them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(tokens, words(text))
    return out.withColumns({"n_words": F.size(tokens).cast("long"), "word_chars": word_chars(text)})


def on_demand(text: Column, tokens: Column) -> Features:
    """The counts that one rule alone looks at, as expressions: computed for the rows that reach that rule."""
    return {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": bound(windows_of_three(tokens), repeat_words),
    }


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add what the rules look at. Words and windows are columns of projections of their own, each computed once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens, windows = fresh_name(df, "tokens_"), fresh_name(df, "windows_")
    out = df.drop(*COUNTS).withColumn(tokens, words(text))
    out = out.withColumn(windows, windows_of_three(F.col(tokens)))
    counts = (F.size(tokens).cast("long"), word_chars(text), count_chars(text, SYMBOLS), dup_lines(text), repeat_words(F.col(windows)))
    return out.withColumns(dict(zip(COUNTS, counts, strict=True))).drop(tokens, windows)


@dataclass(frozen=True)
class Rule:
    """``rejects(text, features)`` is true for a row to reject."""

    name: str
    rejects: Callable[[Column, Features], Column]


def _share(f: Features) -> Column:
    return F.greatest(f["n_words"], F.lit(1))


#: The base rule's two halves, and the method's own rules.
BASE = [
    Rule("few_words", lambda t, f: f["n_words"] < 50),
    Rule("repeats", lambda t, f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
]
RULES = [
    Rule("symbols", lambda t, f: 100 * f["n_symbols"] > 30 * _share(f)),
    Rule("long_words", lambda t, f: f["word_chars"] > 18 * _share(f)),
    Rule("short_words", lambda t, f: f["word_chars"] < 2 * _share(f)),
    Rule("dup_lines", lambda t, f: 100 * f["n_dup_lines"] > 50 * F.size(F.split(t, "\n"))),
    Rule("shouting", lambda t, f: 100 * count_chars(t, "!") > 60 * _share(f)),
    Rule("capitals", lambda t, f: 100 * count_chars(t, "A-Z") > 60 * f["word_chars"]),
    Rule("digits", lambda t, f: 100 * count_chars(t, "0-9") > 40 * f["word_chars"]),
]


def _columns() -> Features:
    return {c: F.col(c) for c in COUNTS}


def order_rules(df: DataFrame, text_col: str = "text", rules: list[Rule] = BASE + RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Sort rules by rejection per cost, both measured on at most ``rows`` rows.

    A rule's cost is the time of a pass that evaluates it alone over the sample,
    with the counts that it asks for, less that of a pass that evaluates nothing;
    ties keep the given order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = df.select(text.alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(4)) == 0).limit(rows).collect()
    if not taken:
        return rules
    sample = checkpointed(counted(df.sparkSession.createDataFrame(taken, "t string").coalesce(1), "t", "tokens"))
    f = on_demand(F.col("t"), F.col("tokens"))

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = sample.agg(F.count_if(condition).alias("n")).first()["n"]
        return time.perf_counter() - began, hit

    timed(F.lit(False))
    floor = timed(F.lit(False))[0]
    found = []
    for i, rule in enumerate(rules):
        seconds, hit = timed(rule.rejects(F.col("t"), f))
        found.append((-hit / max(seconds - floor, 1e-3), i, rule))
    return [rule for _, _, rule in sorted(found, key=lambda x: x[:2])]


def verdict(text: Column, f: Features, ordered: list[Rule]) -> Column:
    """True where nothing rejects; rules run in order, each only where those before it passed."""
    text, passed = F.coalesce(text, F.lit("")), F.lit(True)
    for rule in reversed(ordered):
        passed = F.when(F.coalesce(rule.rejects(text, f), F.lit(False)), False).otherwise(passed)
    return passed


def apply_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with their features, base_failed and kept."""
    ordered = order_rules(df, text_col)
    out = features(df.drop("base_failed", "kept"), text_col)
    return out.select("*", base_failed(_columns()).alias("base_failed"), verdict(F.col(text_col), _columns(), ordered).alias("kept"))


def keep_documents(df: DataFrame, text_col: str = "text", ordered: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule lets pass, with the columns that they had.

    A filter that the optimizer moves below the projections would split the
    words anew for each rule; a row number in them keeps it above.
    """
    row, tokens = fresh_name(df, "row_"), fresh_name(df, "tokens_")
    own = {c: fresh_name(df, f"own_{c}_") for c in df.columns if c in COUNTS}
    ordered = order_rules(df, text_col) if ordered is None else ordered
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = counted(df.withColumnsRenamed(own), text_col, tokens).withColumn(row, F.monotonically_increasing_id())
    kept = out.filter(verdict(text, on_demand(text, F.col(tokens)), ordered) & (F.col(row) >= 0)).drop(row, tokens, *COUNTS)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(df.columns)


def quality_digest(docs: DataFrame) -> DataFrame:
    return apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
