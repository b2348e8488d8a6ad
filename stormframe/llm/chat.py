"""Chat formatting by event sourcing, in DataFrame functions only.

A conversation log holds events ``(conv_id, seq, turn, kind, role, text)``:

* ``message`` and ``edit`` set the text of their turn,
* ``delta`` appends to it (streamed pieces),
* ``regenerate`` empties it, and discards what was logged before it for later
  turns of the conversation; the deltas after it are the new answer.

``fold_events`` partitions the log by conversation, orders it by sequence and
folds it into final messages; ``render`` writes them in a bracket template and
gives the spans under the loss mask; ``parse`` reads a rendering back.

Defined cases: a null text or role counts as empty, a null kind as ``message``,
an unknown kind is ignored. Equal sequence numbers are ordered by kind, then
text; repeated rows count as often as they occur (two equal deltas append
twice). A null conversation or turn is a value of its own and sorts first. An
empty log gives no rows; columns that are not named above are left out.

A conversation is one output row, so its messages meet in one task; its events
before that only pass sort-based windows, which spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: role -> tag. Other roles become ROLE:<url-encoded name>.
TAGS = {"user": "INST", "assistant": "BOT", "system": "SYS"}
CONTROL = r"/?(?:s>|(?:INST|BOT|SYS|ROLE)[:\]])"
ESCAPE = (r"([<\[])(\\*)(" + CONTROL + ")", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(" + CONTROL + ")", r"$1$2$3")
TURN = r"(?s)\[(INST|BOT|SYS|ROLE:[^\]]*)\] (.*?) \[/(?:INST|BOT|SYS|ROLE)\]"
SETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """One backslash more inside everything that looks like a control string."""
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def role_tag(role: Column) -> Column:
    tag = F.concat(F.lit("ROLE:"), F.url_encode(role))
    for name, known in TAGS.items():
        tag = F.when(role == name, known).otherwise(tag)
    return tag


def tag_role(tag: Column) -> Column:
    role = F.url_decode(F.substring(tag, F.lit(6), F.length(tag)))
    for name, known in TAGS.items():
        role = F.when(tag == known, name).otherwise(role)
    return role


def fold_events(events: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, messages array<struct<turn, role, text>>``."""
    log = events.select(
        "conv_id",
        "turn",
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin("delta", *SETS))
    newest_first = (F.desc("seq"), F.desc("kind"), F.desc("text"))
    later = Window.partitionBy("conv_id").orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, -1)
    later_in_turn = Window.partitionBy("conv_id", "turn").orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    log = log.withColumn("cut", cut).filter(F.col("cut").isNull() | F.col("turn").isNull() | (F.col("turn") <= F.col("cut")))
    log = log.withColumn("stale", F.coalesce(F.max(F.col("kind").isin(*SETS)).over(later_in_turn), F.lit(False)))
    piece = F.struct("seq", "kind", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))
    messages = log.groupBy("conv_id", "turn").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("stale"), piece))), lambda p: p["text"]), "").alias("text"),
    )
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: code-point (start, length) of each assistant text in it."""
    piece = F.transform(
        "messages",
        lambda m: F.struct(
            role_tag(m["role"]).alias("tag"),
            escape(m["text"]).alias("body"),
        ),
    )
    close = lambda p: F.regexp_replace(p["tag"], F.lit(":.*"), F.lit(""))
    written = lambda p: F.concat(F.lit("["), p["tag"], F.lit("] "), p["body"], F.lit(" [/"), close(p), F.lit("]"))
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        body_at = state["at"] + F.length(p["tag"]) + 3
        span = F.struct(body_at.alias("start"), F.length(p["body"]).alias("length"))
        spans = F.when(p["tag"] == TAGS["assistant"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(written(p)) + 1).alias("at"), spans.alias("spans"))

    return folded.withColumn("pieces", piece).select(
        "*",
        F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", written), "\n"), F.lit("</s>")).alias("formatted"),
        F.aggregate("pieces", start, step)["spans"].alias("loss_spans"),
    ).drop("pieces")


def format_conversations(events: DataFrame) -> DataFrame:
    """``conv_id, messages, formatted, loss_spans`` for each conversation of a log."""
    return render(fold_events(events))


def parse(formatted: Column) -> Column:
    """The turns of a rendering as ``array<struct<role, text>>``."""
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(formatted, F.lit(TURN), 1).alias("tag"),
            F.regexp_extract_all(formatted, F.lit(TURN), 2).alias("body"),
        ),
        lambda z: F.struct(tag_role(z["tag"]).alias("role"), unescape(z["body"]).alias("text")),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chat_digest(rows: DataFrame) -> DataFrame:
    """Format conversation rows (``conv_id, turn, role, text``) and digest what reads back."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.select(
        "conv_id",
        F.row_number().over(order).alias("turn"),
        F.lit(0).alias("seq"),
        F.lit("delta").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        "text",
    )
    read = format_conversations(events).select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
