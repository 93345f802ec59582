"""Chat formatting from an event log, in DataFrame operations only.

``reconstruct`` folds an event log into final messages, ``render`` writes each
conversation as one string plus a loss mask, ``read_back`` inverts it.
``streamed`` turns finished messages into such a log, as a chat service that
streams, edits and regenerates would have left it.

Template: every message is ``### Role: `` + text + ``</turn>\\n``.  The three
usual roles are title-cased; any other role is written ``=role``.  Inside texts
and roles a backslash becomes ``\\b``, ``###`` becomes ``\\h``, ``</turn>``
becomes ``\\e`` and, in roles, a colon becomes ``\\c``; so neither marker can
occur inside a message and every text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USUAL_ROLES = ("system", "user", "assistant")
END = "</turn>\n"


def escape(c: Column) -> Column:
    for raw, sign in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")):
        c = F.replace(c, F.lit(raw), F.lit(sign))
    return c


def unescape(c: Column) -> Column:
    for raw, sign in (("</turn>", "\\e"), ("###", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(sign), F.lit(raw))
    return c


def streamed(messages: DataFrame) -> DataFrame:
    """An event log (``conv_id, seq, kind, turn, role, text``) that folds to these
    messages (``conv_id, turn, role, text``); those of one turn in order of role
    and text.  ``seq`` counts within a turn, so a long conversation is not one task.

    Each message opens with a draft; a regeneration (assistant) or an edit (any
    other role) throws it away and brings the first third of the text, two
    deltas bring the rest.  Null texts and roles count as empty.
    """
    by = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text, third = F.coalesce("text", F.lit("")), F.floor(F.length("text") / 3).cast("int")
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    m = m.select("*", (F.row_number().over(by).cast("long") * 4).alias("at"))
    kind = F.when(F.col("role") == "assistant", F.lit("regenerate")).otherwise(F.lit("edit"))

    def event(k: int, kind: Column, role: Column, text: Column) -> Column:
        return F.struct((F.col("at") + k).alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))

    none, one = F.lit(None).cast("string"), F.lit(1)
    first, second, rest = F.substr("text", one, third), F.substr("text", third + 1, third), F.substr("text", third * 2 + 1)
    log = F.array(
        event(0, F.lit("message"), F.col("role"), F.concat(first, F.lit(" (draft)"))),
        event(1, kind, none, first),
        event(2, F.lit("delta"), none, second),
        event(3, F.lit("delta"), none, rest),
    )
    return m.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.kind", "turn", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of every conversation.

    Input columns: ``conv_id, seq, kind, turn, role, text``; more columns are
    ignored.  Kinds: ``message`` opens a message at its turn, ``delta`` appends
    to the last one of that turn, ``edit`` and ``regenerate`` throw its text
    away and start anew (later deltas append to the new text).  A null kind
    counts as ``message``; null texts and roles count as empty; events before
    the first ``message`` of a turn open one.  Ties in ``seq`` are ordered by
    kind, role and text.  Repeated ``message`` rows stay separate messages.
    Output: ``conv_id, turn, nth, role, text``.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    e = events.select("conv_id", "seq", kind.alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "delta", 2).otherwise(1)
    w = Window.partitionBy("conv_id", "turn").orderBy("seq", rank, "role", "text")
    e = e.select(
        "*",
        F.row_number().over(w).alias("i"),
        F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(w).alias("opened"),
        F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(w).alias("segment"),
    ).withColumn("nth", F.greatest("opened", F.lit(1)))
    parts = e.groupBy("conv_id", "turn", "nth", "segment").agg(
        F.array_sort(F.collect_list(F.struct("i", "text"))).alias("parts"),
        F.min_by("role", F.when(F.col("role") != "", F.col("i"))).alias("role"),
    )
    texts = parts.select("conv_id", "turn", "nth", "segment", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return texts.groupBy("conv_id", "turn", "nth").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("segment"))), F.lit("")).alias("role"), F.max_by("text", "segment").alias("text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask``.

    ``mask`` has one entry per turn of ``formatted``: the first code point
    (from 1) and the number of code points, counted within that turn, that
    bear loss; length 0 where the role is another one.
    """
    role = F.when(F.col("role").isin(*USUAL_ROLES), F.initcap("role")).otherwise(F.concat(F.lit("="), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))))
    head = F.concat(F.lit("### "), role, F.lit(": "))
    m = messages.select("conv_id", "turn", "nth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    bears = F.col("role") == loss_role
    m = m.select(
        "conv_id",
        F.struct(
            "turn",
            "nth",
            F.concat("head", "body", F.lit(END)).alias("piece"),
            F.when(bears, F.length("head") + 1).otherwise(1).alias("loss_from"),
            F.when(bears, F.length("body")).otherwise(0).alias("loss_chars"),
        ).alias("m"),
    )
    # the turns of one conversation form one string in the end, so they meet here and only here
    c = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return c.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("ms", lambda x: F.struct(x["loss_from"].alias("loss_from"), x["loss_chars"].alias("loss_chars"))).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Invert ``render``: ``conv_id, formatted, turns`` (role, text) and
    ``loss`` (the unescaped texts under the mask, in order)."""
    pieces = F.split(F.col("formatted"), "(?<=</turn>\n)")
    pieces = F.filter(pieces, lambda p: p != "")
    at = rendered.select("conv_id", "formatted", F.arrays_zip(pieces.alias("piece"), F.col("mask").alias("mask")).alias("p"))

    def turn(p: Column) -> Column:
        piece = F.substr(p["piece"], F.lit(1), F.length(p["piece"]) - len(END))
        colon = F.locate(": ", piece)
        name = F.substr(piece, F.lit(5), colon - 5)
        role = F.when(name.startswith("="), unescape(F.replace(F.substr(name, F.lit(2)), F.lit("\\c"), F.lit(":")))).otherwise(F.lower(name))
        return F.struct(role.alias("role"), unescape(F.substr(piece, colon + 2)).alias("text"))

    loss = F.filter("p", lambda p: p["mask"]["loss_chars"] > 0)
    return at.select(
        "conv_id",
        "formatted",
        F.transform("p", turn).alias("turns"),
        F.transform(loss, lambda p: unescape(F.substr(p["piece"], p["mask"]["loss_from"], p["mask"]["loss_chars"]))).alias("loss"),
    )


def digest(back: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
