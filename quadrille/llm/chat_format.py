"""Chat formatting with Spark expressions only.

A conversation's turns are sorted, adjacent turns of one role merge into a block, and blocks are
written one after another:

    user       [INST]text[/INST]
    system     [SYS]text[/SYS]
    assistant  [ANS]text</s>
    others     [ROLE]role[/ROLE]text[/END]

Texts that were merged into a block stay apart by [SEP], so that the turns can be read back. Control
strings inside texts and role names are escaped by one backslash after their first character; one that
has backslashes there already gets one more, so that removing one gives the text again. No unescaped control
string can arise where a text meets a mark: marks hold [ and < at their start only.

Long conversations are sorted and merged in chunks of `chunk` turns, in parallel; the marks, which depend
on the role before, are written when a conversation's chunks are joined. A conversation is one row
of the result, so it has to fit one (2 GB). The loss mask are spans of code points: each assistant text, without marks.

Defined cases: null text is empty; a null role is read back as empty; turns with equal numbers are
sorted by role, then text, null turns first; the null conversation is a conversation of its own;
repeated rows are turns of their own; an empty table gives no row; other columns aren't used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text must not hold unescaped: [ or <, backslashes, and one of these.
CONTROL = r"/?s>|/?INST\]|/?SYS\]|ANS\]|/?ROLE\]|SEP\]|/END\]"
ASSISTANT = "assistant"
#: Pieces whose lengths are added up together, and code points of a page.
PIECES = 256
PAGE = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def opening(role: Column) -> Column:
    return (
        F.when(role == "user", "[INST]").when(role == "system", "[SYS]").when(role == ASSISTANT, "[ANS]")
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]")))
    )


def closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "system", "[/SYS]").when(role == ASSISTANT, "</s>").otherwise("[/END]")


def merge_adjacent(turns: Column) -> Column:
    """array<struct<role, text>> -> array<struct<role, texts>>, adjacent turns of one role in one block."""
    last = lambda a: F.element_at(a, -1)
    block = lambda role, texts: F.struct(role.alias("role"), texts.alias("texts"))
    none = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def add(done: Column, turn: Column) -> Column:
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["role"] == turn["role"])
        longer = block(turn["role"], F.concat(last(done)["texts"], F.array(turn["text"])))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(block(turn["role"], F.array(turn["text"])))))

    return F.aggregate(turns, none, add)


def format_conversations(conversations: DataFrame, chunk: int = 64) -> DataFrame:
    """conv_id, formatted, and loss_spans array<struct<start, end>> in code points, end exclusive."""
    turns = conversations.select(
        "conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    )
    chunks = (
        turns.groupBy("conv_id", F.floor(F.col("turn") / chunk).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("blocks", merge_adjacent(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
        .drop("turns")
    )
    whole = (
        chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "blocks"))).alias("parts"))
        .select("conv_id", F.flatten(F.transform("parts", lambda p: p["blocks"])).alias("blocks"))
    )
    # pieces in order, the assistant's texts marked; a block that goes on from the chunk before begins with [SEP]
    piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))

    def written(block: Column, k: Column) -> Column:
        role = block["role"]
        goes_on = (k > 0) & (F.get(F.col("blocks"), k - 1)["role"] == role)
        ends = (k == F.size("blocks") - 1) | (F.get(F.col("blocks"), k + 1)["role"] != role)
        texts = F.flatten(
            F.transform(
                block["texts"],
                lambda t, i: F.array(
                    piece(F.when(i > 0, F.lit("[SEP]")).when(goes_on, F.lit("[SEP]")).otherwise(opening(role)), False), piece(t, role == ASSISTANT)
                ),
            )
        )
        return F.concat(texts, F.array(piece(F.when(ends, closing(role)).otherwise(F.lit("")), False)))

    pieces = whole.select("conv_id", F.flatten(F.transform("blocks", written)).alias("pieces"))
    # where each run of PIECES pieces begins, then where each piece of a run does: no array grows by one for every piece of a conversation
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / PIECES).cast("int")), lambda g: F.slice("pieces", g * PIECES + 1, F.lit(PIECES)))
    length = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, p: n + F.char_length(p["text"]))
    parted = pieces.withColumn("runs", runs).withColumn("lengths", F.transform("runs", length))
    started = parted.withColumn("starts", F.aggregate("lengths", F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.get(done, F.size(done) - 1) + n))))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def measure(state: Column, p: Column) -> Column:
        end = state["at"] + F.char_length(p["text"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    within = lambda starts: F.transform("runs", lambda run, g: F.aggregate(run, F.struct(F.get(starts, g).alias("at"), none.alias("spans")), measure, lambda s: s["spans"]))
    spans = F.transform(F.array("starts"), within)[0]  # bound to a variable, so that they aren't worked out for each run
    return started.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), F.flatten(spans).alias("loss_spans"))


OPENS = r"\[INST\]|\[SYS\]|\[ANS\]|\[ROLE\]"


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, rf"(?={OPENS})"), lambda b: b != "")

    def turns(block: Column) -> Column:
        named = block.startswith("[ROLE]")
        role = (
            F.when(block.startswith("[INST]"), "user").when(block.startswith("[SYS]"), "system").when(block.startswith("[ANS]"), ASSISTANT)
            .otherwise(unescape(F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
        )
        head = F.when(named, r"(?s)^\[ROLE\].*?\[/ROLE\]").otherwise(rf"^(?:{OPENS})")
        body = F.regexp_replace(F.regexp_replace(block, head, F.lit("")), r"(?:\[/INST\]|\[/SYS\]|</s>|\[/END\])\z", "")
        return F.transform(F.split(body, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """What stands in the spans, unescaped. The text is cut into pages first, so that no span is counted out from the text's start."""
    pages = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    page = lambda at: F.floor(at / PAGE).cast("int")

    def piece(pages: Column, s: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.greatest(s["start"] - k * PAGE, F.lit(0)).cast("int")
            return F.substring(F.get(pages, k), start + 1, F.least(s["end"] - k * PAGE, F.lit(PAGE)).cast("int") - start)

        told = F.array_join(F.transform(F.sequence(page(s["start"]), page(s["end"] - 1)), part), "")
        return F.when(s["end"] > s["start"], unescape(told)).otherwise("")

    # bound to a variable, so that the text is cut once
    return F.transform(F.array(pages), lambda p: F.array_join(F.transform(spans, lambda s: piece(p, s)), ""))[0]
