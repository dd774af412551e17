"""Chat formatting of conversations made of typed content parts.

A turn's content is an array of parts (type, text, ref, tokens).  A visitor
flattens it in order: text is escaped; an image, audio or document part becomes
a placeholder, and its reference and expanded token count are recorded.  A turn
reads ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a line break.

Control strings can't arise from texts: every backslash and vertical bar of a
text is preceded by a backslash, so a text never holds ``<|``, not even where
two parts meet; taking these backslashes away restores the text exactly.  The
loss mask marks the text parts of the learned role as spans of code points of
the formatted string.

Only SQL functions run: positions are running sums of a window, and a
conversation is put together once, in turn order.  A conversation is one
string by definition, so it has to fit a task, whatever else is dealt out.

Defined results: null texts, roles and contents are empty; turns that tie are
ordered by role and then by content as it reads, placeholders included; a null turn comes first; rows with a null
conversation id are one conversation; a part of another type is laid out as a
document; a missing token count is 1; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ATTACHMENTS = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,ref:string,tokens:long>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(kind.isin(*ATTACHMENTS), kind).otherwise(F.lit("document")), F.lit("|>"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))).cast(PARTS)


def format_turns(turns: DataFrame, learned: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, attachments, attachment_tokens.

    ``turns`` has, for each turn, where it starts in ``formatted`` and the spans under the loss mask;
    ``attachments`` lists type, reference and expanded token count in the order of the placeholders.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.filter(F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    base = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts"))
    # Dealt out before anything is laid out, so that the content travels once.
    base = base.repartition("conv_id")
    plain = F.array_join(F.transform("parts", lambda p: F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(placeholder(p["type"]))), "")
    flat = F.transform("parts", lambda p: F.when(_is_text(p), escaped(p["text"])).otherwise(placeholder(p["type"])))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    laid = base.withColumn("pieces", flat).select(
        "conv_id", "turn", "role", "parts", "pieces", plain.alias("plain"), F.concat(head, F.array_join("pieces", ""), F.lit(END)).alias("line"), F.length(head).alias("head")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "plain", "line")
    laid = laid.withColumn("pos", F.row_number().over(order)).withColumn("start", F.sum(F.length("line").cast("long")).over(order) - F.length("line"))
    # Where each piece of a turn lies; few pieces make a turn, so summing anew for each is cheap.
    lies = F.transform(
        "pieces",
        lambda x, i: F.struct(
            (F.col("start") + F.col("head") + F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + F.length(y))).alias("start"), F.length(x).alias("length")
        ),
    )
    spans = F.filter(lies, lambda s, i: (F.col("role") == learned) & _is_text(F.get("parts", i)))
    named = F.transform(
        F.filter("parts", lambda p: ~_is_text(p)),
        lambda p: F.struct(F.when(p["type"].isin(*ATTACHMENTS), p["type"]).otherwise(F.lit("document")).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).cast("long").alias("tokens")),
    )
    rows = laid.select("conv_id", F.struct("pos", "line", "start", spans.alias("loss"), named.alias("attachments")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["loss"].alias("loss"))).alias("turns"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``lines`` (role and text of each turn, placeholders kept) and ``loss_text``, both read from the string."""
    segments = F.split("formatted", r"<\|im_end\|>\n", -1)
    cut = formatted.withColumn("segments", F.slice(segments, F.lit(1), F.size(segments) - 1))
    line = lambda s: F.struct(
        unescaped(F.substr(F.split(s, r"<\|im_sep\|>")[0], F.lit(len(START) + 1))).alias("role"), unescaped(F.split(s, r"<\|im_sep\|>", -1)[1]).alias("text")
    )
    under_mask = F.zip_with(
        "segments",
        "turns",
        lambda s, t: F.array_join(F.transform(t["loss"], lambda x: unescaped(F.substr(s, (x["start"] - t["start"] + 1).cast("int"), x["length"]))), ""),
    )
    return cut.withColumn("lines", F.transform("segments", line)).withColumn("loss_text", F.array_join(under_mask, "")).drop("segments")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    said = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_turns(formatted).select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
