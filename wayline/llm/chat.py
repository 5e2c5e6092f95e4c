"""Chat formatting from event logs.

A log holds, for each conversation, numbered events: whole messages, streamed
deltas, edits and regenerations. The log is partitioned by conversation once; in
that partitioning it is sorted by sequence, folded into final messages by window
functions, and rendered. DataFrame operations only.

The template puts each turn between control strings::

    <turn>ROLE<text>TEXT</turn>\\n

Inside ROLE and TEXT a backslash is written ``\\s``, ``<`` is ``\\l`` and ``#`` is
``\\h``. So no control string, of this template or of one that marks turns by
``###``, survives inside a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
#: What is escaped, in this order; reading back goes the other way round.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
#: The kinds of event. A message starts a message that nothing else belongs to.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _log(events: DataFrame) -> DataFrame:
    """The log's own columns with nulls filled in."""
    return events.select(
        F.col("conv_id").alias("conv"),
        F.col("seq").alias("seq"),
        F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.col("msg").cast("string").alias("msg"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv, seq, role, text`` of a log ``conv_id, seq, kind, msg, role, text``.

    Events of a conversation are taken by ``seq``; ties by kind (message, delta,
    edit, regenerate), ``msg``, role and text, nulls first, so the order of rows
    never matters. ``msg`` names the message that an event is about:

    - ``message``: a whole message of its own, ``msg`` is not looked at;
    - ``delta``: its text is appended to what the message has;
    - ``edit``: its text replaces what the message has;
    - ``regenerate``: the message starts anew with this event's text, and all
      messages that began after it and before this event are dropped for good.

    A message stands where its first event stood and has that event's role. Null
    ``kind`` is ``message``, null text and role are empty, a null ``seq`` comes
    before all others, events with null ``msg`` share one message of that name,
    a null conversation is one like any other. Repeated rows are separate
    events. An unknown kind raises. Extra columns are ignored.
    """
    known = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = _log(events).withColumn(
        "rank", F.when(known > 0, known).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), "kind")))
    )
    whole = Window.partitionBy("conv")
    log = log.withColumn("at", F.row_number().over(whole.orderBy("seq", "rank", "msg", "role", "text")))
    # a whole message is named by its own place
    log = log.withColumn("name", F.when(F.col("rank") == 1, F.struct(F.lit(1).alias("k"), F.col("at").cast("string").alias("n"))).otherwise(F.struct(F.lit(2).alias("k"), F.col("msg").alias("n"))))
    own = Window.partitionBy("conv", "name")
    reset = F.when(F.col("rank") >= 3, F.col("at"))
    log = log.withColumn("began", F.min("at").over(own)).withColumn("last_reset", F.max(reset).over(own))
    # the least beginning among the messages that a later event regenerates: what began after that is dropped
    later = whole.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("again", F.min(F.when(F.col("rank") == 4, F.col("began"))).over(later))
    live = log.withColumn("live", F.col("last_reset").isNull() | (F.col("at") >= F.col("last_reset")))
    parts = F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("at", "text"))))
    first = F.min_by(F.struct("seq", "role", "again"), "at")
    folded = live.groupBy("conv", "name").agg(F.min("at").alias("at"), first.alias("first"), parts.alias("parts"))
    kept = folded.where(F.col("first.again").isNull() | (F.col("first.again") >= F.col("at")))
    return kept.select(
        "conv", "at", "first.seq", "first.role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans``: a conversation's text, and code point spans of its loss mask.

    ``messages`` has ``conv, at, role, text``. A span covers the escaped text of
    a turn of ``loss_roles``: start and end, counted from 0, end excluded.
    """
    escaped = messages.select("conv", "at", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), F.col("role").isin(*loss_roles).alias("loss"))
    fixed = len(OPEN) + len(MIDDLE) + len(CLOSE)
    size = F.char_length("r") + F.char_length("t") + F.lit(fixed)
    earlier = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.char_length("r") + F.lit(len(OPEN) + len(MIDDLE))
    placed = escaped.withColumn("begin", begin)
    turns = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "r", "t", "loss", "begin"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["r"], F.lit(MIDDLE), t["t"], F.lit(CLOSE))), "")
    span = lambda t: F.struct(t["begin"].alias("start"), (t["begin"] + F.char_length(t["t"])).alias("end"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), span)
    return turns.select(F.col("conv").alias("conv_id"), text.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` with ``turns`` (role, text) and ``loss_text``, read from the output alone.

    ``conv_id`` names a row. Turns and spans become rows, lie in one order by
    their place in the text, and each turn meets the span that begins where its
    text does: work is near linear in a conversation's length.
    """
    pieces = F.split(F.col("formatted"), CLOSE, -1)
    none = F.lit(None)
    whole = F.struct(F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), F.col("formatted").alias("s"), F.col("loss_spans").alias("spans"), none.cast("bigint").alias("end"))
    spans_type = rendered.schema["loss_spans"].dataType
    span = lambda x: F.struct(F.lit(1).alias("kind"), x["start"].alias("pos"), none.cast("string").alias("s"), none.cast(spans_type).alias("spans"), x["end"].alias("end"))
    turn = lambda x, i: F.struct(F.lit(2).alias("kind"), i.cast("long").alias("pos"), x.alias("s"), none.cast(spans_type).alias("spans"), none.cast("bigint").alias("end"))
    parts = F.concat(F.array(whole), F.transform("loss_spans", span), F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))
    rows = rendered.select("conv_id", F.inline(parts))
    sides = F.split(F.substr(F.col("s"), F.lit(len(OPEN) + 1)), MIDDLE, 2)
    is_turn = F.col("kind") == 2
    rows = rows.withColumns({"r": F.when(is_turn, sides[0]), "t": F.when(is_turn, sides[1])})
    earlier = Window.partitionBy("conv_id").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(is_turn, F.char_length("s") + len(CLOSE))).over(earlier), F.lit(0))
    rows = rows.withColumn("place", F.when(is_turn, before + F.char_length("r") + len(OPEN) + len(MIDDLE)).when(F.col("kind") == 1, F.col("pos")))
    by_place = Window.partitionBy("conv_id").orderBy("place", "kind")
    last = F.lag(F.struct("kind", "place", "end")).over(by_place)
    rows = rows.withColumn("last", last)
    meets = is_turn & (F.col("last.kind") == 1) & (F.col("last.place") == F.col("place"))
    under = F.when(meets, unescape(F.substr(F.col("t"), F.lit(1), (F.col("last.end") - F.col("place")).cast("int"))))
    made = F.struct("pos", unescape(F.col("r")).alias("role"), unescape(F.col("t")).alias("text"), under.alias("loss"))
    back = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("s"))).alias("formatted"),
        F.flatten(F.collect_list("spans")).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(is_turn, made))).alias("turns"),
    )
    return back.select(
        "conv_id",
        "formatted",
        "loss_spans",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("turns", lambda t: t["loss"]), "").alias("loss_text"),
    )


def log_of(turns: DataFrame) -> DataFrame:
    """An event log ``conv_id, seq, kind, msg, role, text`` that folds to the rows ``conv_id, turn, role, text``.

    As a chat service would have logged them, by a row's number in its
    conversation (by turn, then role and text, nulls first): every fourth came
    whole; every fourth was streamed in three deltas; every fourth was a draft that
    an edit replaced after the next turn had begun; every fourth was a draft, had
    an answer, and was regenerated, in two deltas, so that draft and answer went.
    """
    numbered = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    third = F.ceil(n / 3).cast("int")
    part = lambda a, size: F.substr(text, a + 1, size)
    steps: list[list[tuple[int, str, Column | str]]] = [
        [(0, "message", text)],
        [(0, "delta", part(F.lit(0), third)), (1, "delta", part(third, third)), (2, "delta", part(third * 2, n))],
        [(0, "delta", F.lit("Let me think")), (1, "delta", F.lit(" ...")), (12, "edit", text)],
        [(0, "delta", F.lit("Not this")), (1, "answer", F.lit("No, again.")), (2, "regenerate", part(F.lit(0), third)), (3, "delta", part(third, n))],
    ]
    event = lambda seq, kind, what: F.struct(
        (F.col("at") * 10 + seq).alias("seq"), F.lit("message" if kind == "answer" else kind).alias("kind"), what.alias("text")
    )
    logged = None
    for k, some in enumerate(steps):
        events = F.array(*[event(*s) for s in some])
        logged = F.when(F.col("at") % 4 == k, events) if logged is None else logged.when(F.col("at") % 4 == k, events)
    log = numbered.select("conv_id", F.col("at").cast("string").alias("msg"), "role", F.inline(logged))
    return log.select("conv_id", "seq", "kind", "msg", "role", "text")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of each conversation of an event log; see :func:`fold` and :func:`render`.

    A conversation's rows meet in one row of output, which is what is asked for;
    until then its messages are separate rows and sorts spill. An empty log gives
    an empty result.
    """
    return render(fold(events), loss_roles)
