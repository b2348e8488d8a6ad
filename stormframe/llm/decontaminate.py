"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is ``size`` consecutive words of an item; an item with fewer words is
one window of all of them. A document holds a window only if it holds each of
the window's words, so one necessary word is enough to find it: the words are
ordered by how often they occur in all documents, and a window is looked up by
its rarest one (its prefix; for containment of the whole window the prefix is
one word long). A document word that is such a prefix word gives the window's
only possible place: its start follows from the word's place in the window, and
the window must lie inside the document. What is left is verified word by word.

All of it is column expressions and joins. The windows are broadcast while they
hold at most ``BROADCAST_CHARS`` characters. Beyond that, words are shuffled to
the prefix words first, and the few places found go back to their documents for
the words around them; no text is shuffled for a place that has no prefix word.

Defined cases: a null or empty text, or one without words, has no words and no
hits; a null text of an item gives no window; rows with one item id are windows
of one item; a null item id marks words as hit, but is not among the items.
Repeated rows of documents get equal results, and different texts of one id are
judged apart; a null id is an id of its own. All columns of ``docs`` pass
through, except that those with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.llm.common import checkpointed, fresh_name, stored

SIZE = 10
#: Windows of at most so many characters are sent to every task; each is sent with its words, its place and its number.
BROADCAST_CHARS = 8 << 20

# Letters that are lower-cased, and what lies between words (before and after that).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_LOWER, BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The lower-cased words; an empty one where a text begins or ends between words."""
    plain = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    return F.split(F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER)), BETWEEN_LOWER)


def count_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    one = lambda c: c.cast("long")
    return F.size(parts).cast("long") - one(parts[0] == "") - one((F.size(parts) > 1) & (F.element_at(parts, -1) == ""))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """``id, h``: rows that agree in these repeat one document. Neither is null."""
    missing = F.col(id_col).isNull()
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(F.coalesce(text_col, F.lit("")), missing)


def item_windows(items: DataFrame, item_id: str, item_text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """``window, words`` of each different window, and ``window, item`` of the items that hold it."""
    words = F.filter(split_words(F.col(item_text)), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    cut = items.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    each = cut.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k, size))).alias("words"))
    each = stored(each.distinct())
    windows = stored(each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    return windows, stored(each.filter("item is not null").join(windows, "words").select("window", "item"))


def small(df: DataFrame, chars: Column, limit: int) -> DataFrame:
    """df, to be broadcast if the sum of ``chars`` over its rows is at most ``limit``."""
    return F.broadcast(df) if fits(df, chars, limit) else df


def fits(df: DataFrame, chars: Column, limit: int) -> bool:
    return df.agg(F.coalesce(F.sum(chars.cast("long")), F.lit(0))).first()[0] <= limit


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str, limit: int) -> DataFrame:
    """``window, words, token, place``: the rarest word of each window that can occur, and where it stands (from 0)."""
    placed = windows.select("window", F.posexplode("words").alias("place", "token"))
    vocabulary = stored(placed.select("token").distinct())
    # The outer form keeps the optimizer from testing the split a second time in a filter.
    said = docs.select(F.explode_outer(split_words(F.col(text_col))).alias("token"))
    counts = said.join(small(vocabulary, F.length("token") + 40, limit), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = stored(vocabulary.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")))
    rarest = placed.join(rarity, "token").groupBy("window").agg(F.min(F.struct("n", "token", "place")).alias("p"))
    return windows.join(rarest.filter("p.n > 0"), "window").select("window", "words", F.col("p.token").alias("token"), F.col("p.place").alias("place"))


def occurrences(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``id, h, start, length, window`` of each verified window of a document, once for repeated rows."""
    key, h = row_key(docs, id_col, text_col)
    texts = docs.select(key.alias("id"), h.alias("h"), split_words(F.col(text_col)).alias("said"))
    each = texts.select("id", "h", "said", F.posexplode_outer("said").alias("at", "token"))
    index = index.withColumn("length", F.size("words"))
    if fits(index, F.length(F.array_join("words", " ")) + 20 * F.size("words") + 100, limit):
        found = each.withColumn("before", F.lit(0)).join(F.broadcast(index), "token")
    else:
        reach = index.agg(F.max("length")).first()[0] or 0
        places = each.select("id", "h", "at", "token").join(index.select("token").distinct(), "token").distinct()
        around = texts.dropDuplicates(["id", "h"]).join(places, ["id", "h"])
        before = F.greatest(F.lit(0), F.col("at") - reach)
        around = around.select("id", "h", "at", "token", before.alias("before"), F.slice("said", before + 1, 2 * reach + 1).alias("said"))
        found = around.join(index, "token")
    start = F.col("at") - F.col("place") - F.col("before")
    inside = (start >= 0) & (start + F.col("length") <= F.size("said"))
    same = F.when(inside, F.slice("said", F.greatest(F.lit(1), start + 1), F.col("length")) == F.col("words")).otherwise(F.lit(False))
    return found.filter(same).select("id", "h", (F.col("at") - F.col("place")).alias("start"), "length", "window").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, limit: int = BROADCAST_CHARS
) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    windows, members = item_windows(items, item_id, item_text, size)
    index = stored(prefixes(docs, windows, text_col, limit))
    hits = stored(occurrences(docs, index, id_col, text_col, limit))
    # Words that no window before has reached; a document's windows are at most its words.
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("id", "h").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("length")
    reached = hits.select("id", "h", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, "start"))).alias("new"))
    words = reached.groupBy("id", "h").agg(F.sum("new").cast("long").alias("hit"))
    named = hits.select("id", "h", "window").distinct().join(small(members, F.length("item") + 40, limit), "window").select("id", "h", "item").distinct()
    listed = named.groupBy("id", "h").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    names = {c: fresh_name(docs, c + "_") for c in ("id", "h", "hit", "items", "names")}
    told = checkpointed(words.join(listed, ["id", "h"], "left")).withColumnsRenamed(names)
    key, h = row_key(docs, id_col, text_col)
    own = docs.withColumns({names["id"]: key, names["h"]: h, "n_words": count_words(F.col(text_col))})
    zero = lambda c: F.coalesce(names[c], F.lit(0)).cast("long")
    out = own.join(told, [names["id"], names["h"]], "left")
    results = {"n_hit": zero("hit"), "n_items": zero("items"), "items_sha256": F.sha2(F.coalesce(names["names"], F.lit("")), 256), "contaminated": zero("hit") > 0}
    return out.withColumns(results).drop(*names.values())


def leak_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs.select("doc_id", "text"), items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
