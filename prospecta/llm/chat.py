"""Chat formatting: event-sourced reconstruction of conversations, rendering with a loss mask, and the way back.

Only DataFrame functions are used. A log of events (conversation, sequence, kind, message, role, text) is
partitioned by conversation and sorted by sequence; a message's events fold into its final text, and the final
messages are rendered in the order of their first events.

Kinds: `message`, `edit` and `regenerate` set the message's text anew; `delta` appends to it; `delete` drops the
message unless a later event sets it again. Events without a message id stand for one message each.

Defined results: a null text or role is empty; a null kind is `message`; events of one message with equal sequence
fold in the order (set before delta, text); messages of equal first sequence are ordered by (role, text); repeated
rows without a message id are kept, each as a turn; rows of a null conversation form one; an empty log gives none;
a conversation is one row however many turns it has, made and read in time that grows with it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import BLOCK, block_starts, bound

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: Code points of a page of a formatted text.
PAGE = 4096


def escape(text: Column, role: bool = False) -> Column:
    """No `<` and no `#` is left, so that no marker can arise inside a text; in roles no `:` either."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for raw, code in (("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Exact inverse of escape: `\\b` comes last, as the others cannot straddle it."""
    out = text
    for raw, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> from events (conv_id, seq, kind, message, role, text).

    Both groupings use the partitioning by conversation, so the texts are shuffled once.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = events.select(
        "conv_id", "seq", "message", kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("message").isNull(), F.struct(F.col("seq").alias("s"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))).alias("alone"),
    ).repartition("conv_id")
    step = F.struct("seq", (F.col("kind") == "delta").cast("int").alias("late"), "text", "kind", "role")
    sets = F.when(F.col("message").isNull(), F.array(step)).otherwise(F.lit(None))
    folded = rows.groupBy("conv_id", "message", "alone").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min(sets).alias("one"),
        F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), step))).alias("steps"),
    )
    steps = F.when(F.col("message").isNull(), F.col("one")).otherwise(F.col("steps"))
    start = F.array_max(F.transform(F.col("steps"), lambda x, i: F.when(x.kind != "delta", i).otherwise(F.lit(0))))
    folded = folded.withColumn("steps", steps).withColumn("start", start)
    live = F.expr("slice(steps, start + 1, size(steps))")
    done = folded.withColumn("live", live).select(
        "conv_id", "seq", F.when(F.col("message").isNull(), F.col("n")).otherwise(F.lit(1)).cast("int").alias("n"),
        F.coalesce(F.try_element_at(F.filter(F.transform("steps", lambda x: x.role), lambda r: r.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda x: x.text), "").alias("text"),
        (F.try_element_at("live", F.lit(1)).kind != "delete").alias("kept"),
    )
    turn = F.when(F.col("kept"), F.struct("seq", "role", "text", "n"))
    return done.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all")).select(
        "conv_id", F.flatten(F.transform("all", lambda x: F.array_repeat(F.struct(x.role.alias("role"), x.text.alias("text")), x.n))).alias("turns")
    )


def render(conversations: DataFrame, train_on: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss array<struct<start, chars>>: the mask has the texts of role `train_on`, in code points. Places are summed
    block by block, so that the work grows with the turns and not with their square."""
    def part(x: Column) -> Column:
        head, body = F.concat(F.lit(HEAD), escape(x.role, role=True), F.lit(MID)), escape(x.text)
        return F.struct(head.alias("head"), body.alias("body"), (x.role == train_on).alias("on"), (F.length(head) + F.length(body) + len(TAIL)).alias("n"))

    def masked_in(parts: Column, at: Column) -> Column:
        span = "array<struct<start:long,chars:long>>"
        return F.aggregate(
            parts, F.struct(at.alias("at"), F.array().cast(span).alias("spans")),
            lambda acc, x: F.struct(
                (acc.at + x.n).alias("at"),
                F.when(x.on, F.array_append(acc.spans, F.struct((acc.at + F.length(x.head)).alias("start"), F.length(x.body).cast("long").alias("chars")))).otherwise(acc.spans).alias("spans")),
            lambda acc: acc.spans)

    def made(parts: Column) -> Column:
        text = F.array_join(F.transform(parts, lambda x: F.concat(x.head, x.body, F.lit(TAIL))), "")
        loss = bound(block_starts(parts), lambda starts: F.flatten(F.transform(starts, lambda at, i: masked_in(F.slice(parts, i * BLOCK + 1, BLOCK), at))))
        return F.struct(text.alias("formatted"), loss.alias("loss"))

    return conversations.select("conv_id", bound(F.transform("turns", part), made).alias("out")).select("conv_id", "out.formatted", "out.loss")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> from a rendered conversation."""
    pieces = F.filter(F.split(formatted, TAIL), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, MID, 1), len(HEAD) + 1, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1, F.lit(1 << 30))).alias("text"),
    ))


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask. Spans are read from pages of the text, so that none walks all that is before it."""
    def span(pages: Column, s: Column) -> Column:
        first = F.floor(s.start / PAGE).cast("int")
        near = F.array_join(F.slice(pages, first + 1, F.floor((s.start + s.chars) / PAGE).cast("int") - first + 1), "")
        return unescape(F.substring(near, (s.start % PAGE + 1).cast("int"), s.chars.cast("int")))

    return bound(F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0)), lambda pages: F.array_join(F.transform(loss, lambda s: span(pages, s)), ""))


def events_of(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log: each row is a message of its own."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text")
