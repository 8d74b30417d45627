"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. The visitor renders
the parts in order: a text is escaped, any other part becomes a placeholder with its number among
the turn's parts (from 0), under which its reference and expanded token count are recorded beside the output. A turn reads

    <|turn|>role<|body|>content<|end|>

Control strings all have the shape ``<|name|>``. In texts and roles every ``<`` that is
followed by backslashes and ``|`` gets one more backslash, so no text can contain a control
string; removing one backslash gives the text back exactly.

The loss mask holds the bodies of assistant turns. Turns stay rows of their own, with their
place in the conversation, until ``join_turns`` puts a conversation into one row.

Defined cases: null text is an empty text, null role an empty role, null parts none. Turns are
ordered by number, those without one last, and ties by role, then content, so repeated rows
stay as equal neighbours. Rows without a conversation id form one conversation of their own.
Parts of an unknown kind are placeholders without extra tokens; equal parts have attachments of their own. Texts of any length
are formatted whole; columns that are not named, such as ones called like the results, are left out. A conversation must fit in one
row, as its formatted text does; nothing else gathers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:int>>"
#: Tokens that a placeholder expands to: per tile, per second, per page.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def text_part(col: str) -> Column:
    """A content of one text part; null counts as empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))).cast(PART_TYPE)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _tokens(part: Column) -> Column:
    """Expanded tokens of an attachment: its units times the rate of its kind."""
    rate = F.lit(0)
    for kind, count in TOKENS.items():
        rate = F.when(part["kind"] == kind, F.lit(count)).otherwise(rate)
    return (F.coalesce(part["units"], F.lit(1)) * rate).cast("long")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", parts: Column | None = None,
                 loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, place, segment, start, body_start, body_end, in_loss,
    attachments, expanded_tokens. Places count code points of the formatted conversation."""
    parts = F.coalesce(parts if parts is not None else text_part("text"), F.array().cast(PART_TYPE))
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("_role"), parts.alias("_parts"))
    content = F.array_join(F.transform("_parts", lambda p, i: F.when(
        _is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), F.coalesce(escape(p["kind"]), F.lit("")), F.lit(":"),
                 i.cast("string"), F.lit("|>")))), "")
    head = F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(BODY))
    shaped = base.select(
        "conv_id", "_turn", "_role", content.alias("_content"), head.alias("_head"),
        # The index is the one in the placeholder, also where parts are equal.
        F.array_compact(F.transform("_parts", lambda p, i: F.when(~_is_text(p), F.struct(
            i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"),
            _tokens(p).alias("tokens"))))).alias("attachments"))
    shaped = shaped.withColumn("segment", F.concat("_head", "_content", F.lit(END)))
    order = [F.col("_turn").asc_nulls_last(), F.col("_role"), F.col("_content")]
    before = Window.partitionBy("conv_id").orderBy(*order)
    end = F.sum(F.length("segment")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    placed = shaped.withColumn("place", F.row_number().over(before)).withColumn("_end", end)
    start = F.col("_end") - F.length("segment")
    body = start + F.length("_head")
    return placed.select(
        "conv_id", "place", "segment", start.alias("start"), body.alias("body_start"),
        (body + F.length("_content")).alias("body_end"),
        (F.col("_role") == loss_role).alias("in_loss"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def join_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, loss_turns, attachments,
    expanded_tokens. ``loss_turns`` numbers the masked turns, ``loss_spans`` their bodies. An attachment names the
    turn by its place, and the part by the number in its placeholder."""
    rows = F.sort_array(F.collect_list(F.struct(
        "place", "segment", "body_start", "body_end", "in_loss", "attachments")))
    grouped = turns.groupBy("conv_id").agg(rows.alias("_rows"), F.sum("expanded_tokens").alias("expanded_tokens"))
    masked = F.filter("_rows", lambda r: r["in_loss"])
    return grouped.select(
        "conv_id", F.array_join(F.transform("_rows", lambda r: r["segment"]), "").alias("formatted"),
        F.transform(masked, lambda r: F.struct(r["body_start"].alias("start"), r["body_end"].alias("end"))).alias("loss_spans"),
        F.transform(masked, lambda r: r["place"]).alias("loss_turns"),
        F.flatten(F.transform("_rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(
            r["place"].alias("place"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
            a["tokens"].alias("tokens"))))).alias("attachments"), "expanded_tokens")


def read_turns(formatted: DataFrame) -> DataFrame:
    """Read conversations back: conv_id, turns (place, role, text, in_loss), formatted.

    Placeholders stay in the text as they are. The text is cut once, in one pass."""
    segments = F.filter(F.split("formatted", r"<\|end\|>"), lambda s: s != "")
    cut = formatted.select("conv_id", "formatted", "loss_turns", segments.alias("_segments"))
    body = r"(?s)^<\|turn\|>(.*?)<\|body\|>(.*)$"
    return cut.select("conv_id", "formatted", F.transform("_segments", lambda s, i: F.struct(
        (i + 1).alias("place"), unescape(F.regexp_extract(s, body, 1)).alias("role"),
        unescape(F.regexp_extract(s, body, 2)).alias("text"),
        F.array_contains("loss_turns", i + 1).alias("in_loss"))).alias("turns"))
