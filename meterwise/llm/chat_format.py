r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is its turns, one after the other:

    turn    = "### " role ": " text "\n</turn>\n"
    role    = the role, URL-encoded
    text    = any characters in which every control string has a backslash before it
    control = a run of three or more "#", or "</turn>"

Reading a text back takes one backslash off each run of backslashes that
stands before a control string. Each turn is first rendered as it is, reparsed
by this grammar and compared with its source. A turn that does not come back
identical (it breaks the grammar, or loses a backslash) has its control strings
escaped and is rendered, reparsed and compared again; a turn that still
differed would raise an error. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.operators.prefix import running_sum

OPEN, ROLE_END, CLOSE = "### ", ": ", "\n</turn>\n"
CONTROL = r"(#{3,}|</turn>)"
BARE = r"(?<![\\#])#{3,}|(?<!\\)</turn>"  # a control string that nothing escapes
TURN = r"(?s)^### ([^:]*): (.*)$"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, r"$1$2")


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(ROLE_END))


def render(role: Column, body: Column) -> Column:
    return F.concat(header(role), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null where the grammar is broken."""
    parts = F.split(formatted, r"\n</turn>\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda t: F.regexp_extract(t, TURN, 2)
    sound = (F.element_at(parts, -1) == "") & F.forall(turns, lambda t: t.rlike(TURN) & ~body(t).rlike(BARE))
    return F.when(sound, F.transform(turns, lambda t: F.struct(
        F.url_decode(F.regexp_extract(t, TURN, 1)).alias("role"), unescape(body(t)).alias("text"))))


def comes_back(role: Column, text: Column, body: Column) -> Column:
    """Whether a turn rendered with ``body`` is parsed as exactly (role, text)."""
    same = parse(render(role, body)) == F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.coalesce(same, F.lit(False))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv, turn, formatted, loss): one row per turn; no conversation meets in one place.

    loss is the code-point span (start, end exclusive) of an assistant's body
    in ``formatted``, null for other roles. A null role or text is an empty
    one, rows with a null conv are one conversation, and repeated rows are
    turns of their own. An empty table gives an empty result. A turn's order in
    its conversation is that of turn, then role, then text, nulls first; turns
    in that order, with nothing between, are the formatted conversation.
    """
    source = rows.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"),
                         F.coalesce(F.col(text), F.lit("")).alias("t"))
    r, t, escaped = F.col("r"), F.col("t"), escape(F.col("t"))
    body = (F.when(comes_back(r, t, t), t).when(comes_back(r, t, escaped), escaped)
            .otherwise(F.raise_error(F.concat(F.lit("turn does not survive the round trip: "), t)).cast("string")))
    start = F.char_length(header(r)).cast("long")
    return source.withColumn("b", body).select(
        F.col("c").alias(conv), F.col("n").alias(turn), render(r, F.col("b")).alias("formatted"),
        F.when(r == LEARNED_ROLE, F.struct(start.alias("start"), (start + F.char_length("b")).alias("end"))).alias("loss"))


def read_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with role and text as the grammar reads them back, and learned: the text under the loss mask,
    unescaped (null: nothing is learned)."""
    f, loss = F.col("formatted"), F.col("loss")
    one = F.element_at(parse(f), 1)
    under = unescape(F.substring(f, (loss["start"] + 1).cast("int"), (loss["end"] - loss["start"]).cast("int")))
    return turns.withColumn("_one", one).select(
        *turns.columns, F.col("_one")["role"].alias("role"), F.col("_one")["text"].alias("text"),
        F.when(loss.isNotNull(), under).alias("learned"))


def place_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with at: code points of the conversation's turns before this one.

    Running sums are dealt by ranges of (conv, order), so a conversation with a
    third of all turns spans tasks.
    """
    sized = read_turns(turns).select(*turns.columns, F.col("role").alias("_role"), F.col("text").alias("_text"),
                                     F.char_length("formatted").cast("long").alias("_chars"))
    summed = running_sum(sized, [conv], [turn, "_role", "_text"], "_chars", "_upto")
    return summed.select(*turns.columns, (F.col("_upto") - F.col("_chars")).alias("at"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv, formatted, loss): one row per conversation, which must fit one string.

    loss holds the code-point spans (start, end exclusive) of assistant bodies
    in ``formatted``. Turns are those of ``format_turns``, which also says what
    nulls, repeated rows and an empty table give.
    """
    placed = place_turns(format_turns(rows, conv, turn, role, text), conv, turn)
    at, loss = F.col("at"), F.col("loss")
    span = F.when(loss.isNotNull(), F.struct((at + loss["start"]).alias("start"), (at + loss["end"]).alias("end")))
    item = F.struct("at", F.col("formatted").alias("f"), span.alias("s"))
    whole = placed.groupBy(conv).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return whole.select(conv, F.array_join(F.transform("x", lambda x: x["f"]), "").alias("formatted"),
                        F.array_compact(F.transform("x", lambda x: x["s"])).alias("loss"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest columns from whole formatted conversations and their loss masks alone."""
    f = F.col("formatted")
    learned = F.array_join(F.transform("loss", lambda s: unescape(
        F.substring(f, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (formatted.withColumn("turns", parse(f)).withColumn("learned", learned)
            .select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                    F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    F.char_length(f).cast("long").alias("formatted_chars")))


def turn_digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The columns of ``read_back`` from formatted turns.

    Counts are sums over turns. Only the two digests, which SQL functions take
    of one string, need the texts of a conversation together: once, as read
    back, under 2 GB.
    """
    read = read_turns(turns)
    other = F.when(~F.col("learned").eqNullSafe(F.col("text")), F.col("learned"))   # shipped only where it differs
    item = F.struct(F.col(turn).alias("n"), F.col("role").alias("r"), F.col("text").alias("t"),
                    F.col("loss").isNotNull().alias("m"), other.alias("o"))
    whole = read.groupBy(conv).agg(
        F.sort_array(F.collect_list(item)).alias("x"), F.count(F.lit(1)).alias("n_turns"),
        F.coalesce(F.sum(F.char_length("learned")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"))
    told = F.transform("x", lambda x: F.concat(x["r"], F.lit("\n"), x["t"], F.lit("\n")))
    learned = F.transform(F.filter("x", lambda x: x["m"]), lambda x: F.coalesce(x["o"], x["t"]))
    return whole.select(conv, "n_turns", F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"), "loss_chars",
                        F.sha2(F.array_join(learned, ""), 256).alias("loss_sha256"), "formatted_chars")
