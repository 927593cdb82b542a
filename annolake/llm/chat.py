"""Chat formatting with Spark expressions only.

Each conversation becomes one text, written in segments of ``SEGMENT`` turn
numbers: a segment's turn structs are collected, sorted and folded, turns of one
role that follow each other being merged by array aggregation, and the merged
turns are concatenated::

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

``<|im_next|>`` parts the texts of merged turns, so that reading back returns
every turn.  Control strings inside roles and texts, those of other templates
too, get one backslash after their first character (one more, where some are
there already); taking one away restores the text.  The loss mask lists the
assistant texts' places in the segment, without any mark.

A conversation may hold a third of all rows: rows are collected a segment at a
time, and only narrow rows, one for each segment, meet per conversation.  Null
texts and roles are empty strings; equal turn numbers are ordered by role and
text, null numbers come first; repeated rows are turns of their own; a null
conv_id is a conversation; extra columns are dropped; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, SEP, NEXT, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: First character, backslashes, rest of the strings that must not occur in a text.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|sep|next|end)\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|sep|next|end)\|>)"
SEGMENT = 64
MERGED = "array<struct<role:string,texts:array<string>>>"
SPANS = "struct<at:int,spans:array<struct<start:int,end:int>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _merge(turns: Column) -> Column:
    """Sorted turn structs to one struct for each run of a role."""
    def add(merged, turn):
        last = F.element_at(merged, -1)
        grown = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        joins = (F.size(merged) > 0) & (F.get(merged, F.size(merged) - 1)["role"] == turn["role"])
        return F.when(joins, F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(grown))).otherwise(
            F.concat(merged, F.array(fresh)))
    return F.aggregate(turns, F.array().cast(MERGED), add)


def _pieces(merged: Column, continues: Column, first: Column) -> Column:
    """What is written: (lead, text, loss) for each text of the merged turns."""
    def block(turn, i):
        opened = F.concat(F.when(first & (i == 0), F.lit("")).otherwise(F.lit(CLOSE)), F.lit(OPEN),
                          escape(turn["role"]), F.lit(SEP))
        lead = F.when((i == 0) & continues, F.lit(NEXT)).otherwise(opened)
        return F.transform(turn["texts"], lambda text, k: F.struct(
            F.when(k == 0, lead).otherwise(F.lit(NEXT)).alias("lead"), escape(text).alias("text"),
            (turn["role"] == "assistant").alias("loss")))
    return F.flatten(F.transform(merged, block))


def _loss(pieces: Column) -> Column:
    """Start and end (exclusive) of the texts under the loss mask, in code points."""
    def step(state, piece):
        start = state["at"] + F.length(piece["lead"])
        end = start + F.length(piece["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(piece["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(pieces, begin.cast(SPANS), lambda s, p: step(s, p).cast(SPANS))["spans"]


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, formatted, loss_spans); a conversation's text is its
    segments' texts in order, and spans count from the segment's start."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    segments = (conversations
                .select("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment"), turn.alias("turn"))
                .groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
                .select("conv_id", "segment", _merge(F.col("turns")).alias("merged")))
    ends = (segments.select(F.col("conv_id").alias("__conv"), F.col("segment").alias("__segment"),
                            F.get("merged", F.lit(0))["role"].alias("__head"),
                            F.element_at("merged", -1)["role"].alias("__tail")))
    place = Window.partitionBy("__conv").orderBy("__segment")
    before, after = F.lag("__tail").over(place), F.lead("__head").over(place)
    ends = ends.select("__conv", "__segment", before.isNull().alias("first"), after.isNull().alias("last"),
                       F.coalesce(before == F.col("__head"), F.lit(False)).alias("continues"))
    joined = segments.join(ends, F.col("conv_id").eqNullSafe(F.col("__conv"))
                           & F.col("segment").eqNullSafe(F.col("__segment")))
    pieces = _pieces(F.col("merged"), F.col("continues"), F.col("first"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), "")
    return (joined.select("conv_id", "segment", "last", pieces.alias("pieces"))
            .select("conv_id", "segment",
                    F.concat(text, F.when(F.col("last"), F.lit(CLOSE)).otherwise(empty)).alias("formatted"),
                    _loss(F.col("pieces")).alias("loss_spans")))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a conversation's whole text was made from."""
    def block(part):
        sides = F.split(F.substr(part, F.lit(len(OPEN) + 1)), r"<\|im_sep\|>")
        return F.transform(F.split(F.get(sides, F.lit(1)), r"<\|im_next\|>"), lambda text: F.struct(
            unescape(F.get(sides, F.lit(0))).alias("role"), unescape(text).alias("text")))
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask of one segment."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives for each conversation.  A digest takes a
    conversation's whole text in one row; Spark holds up to 2 GB there."""
    whole = (formatted.withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
             .groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("segment", "formatted", "loss"))).alias("parts"))
             .select("conv_id", F.array_join("parts.formatted", "").alias("formatted"),
                     F.array_join("parts.loss", "").alias("loss"))
             .withColumn("turns", read_turns(F.col("formatted"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(told, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
