"""Chat formatting with typed content parts. DataFrame operations only.

A turn is an ordered list of parts: text, image, audio or document. The
visitor (``visit``) flattens each part: text is escaped, every other part
becomes a numbered placeholder, its reference is recorded as an attachment
together with the tokens the placeholder expands to. Turns are marked

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped reversibly (``&`` -> ``&amp;``, then
``<|`` -> ``&lt;|``), so nothing in a text can open, close or fake a turn. So is
a ``<`` at the end of a part that another part follows: two parts cannot join
into a control string. A placeholder names a known kind or ``unknown``.
Code-point spans mark the assistant texts (the loss mask); ``read_back``
parses the formatted string again with those spans.

Turns are laid out by window sums over (conversation, turn), then gathered:
one row per conversation, which is one training example by nature.

Defined results: null text or role is empty; null or unknown part kinds
expand to no tokens and keep their placeholder; a null conversation id is a
conversation; turns that tie are ordered by role, then content; repeated rows
are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
IMAGE_PATCH = 28            # pixels per image token side
AUDIO_PER_SECOND = 25.0     # tokens per second of audio
PAGE_TOKENS = 512           # tokens per document page


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    # every "&" of the text is "&amp;" here, so "&lt;" is an escape
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_part(c: Column, last: Column) -> Column:
    """``escape`` for a part of a text; ``last``: no part follows."""
    plain = escape(c)
    return F.when(last | ~plain.endswith("<"), plain).otherwise(
        F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit("&lt;")))


def escape_role(c: Column) -> Column:
    """Roles also lose their line breaks (the line break ends the role)."""
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to (text: 0 here)."""
    def patches(side):
        return F.ceil(F.greatest(F.coalesce(p[side], F.lit(0)), F.lit(0)) / F.lit(IMAGE_PATCH))
    return (F.when(p["kind"] == "image", patches("width") * patches("height"))
            .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_PER_SECOND))
            .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
            .otherwise(0).cast("bigint"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(flattened text, attachments) of one turn's parts."""
    kind = lambda p: F.coalesce(p["kind"], F.lit("unknown"))
    media = F.filter(parts, lambda p: kind(p) != "text")
    attachments = F.transform(media, lambda p, i: F.struct(
        i.alias("place"), kind(p).alias("kind"), p["ref"].alias("ref"),
        part_tokens(p).alias("tokens")))
    # the number of a placeholder is its place among the turn's attachments
    numbered = F.transform(parts, lambda p, i: F.when(
        kind(p) == "text", escape_part(F.coalesce(p["text"], F.lit("")), i == F.size(parts) - 1)).otherwise(
        F.concat(F.lit("<|"), F.when(kind(p).isin(*KINDS), kind(p)).otherwise("unknown"), F.lit("_"),
                 F.size(F.filter(F.slice(parts, 1, i), lambda q: kind(q) != "text")).cast("string"),
                 F.lit("|>"))))
    return F.array_join(numbered, ""), attachments


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", parts: Column | None = None,
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, turn_starts,
    loss_spans (start, length; one per turn, length 0 outside the mask; code
    points from 0), attachments and expanded_tokens.

    ``parts``: the turn's content parts (default: the column ``text`` as one
    text part).
    """
    content = text_parts(F.col("text")) if parts is None else parts
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(content, F.array().cast(f"array<{PART}>")).alias("parts"))
    flat, attachments = visit(F.col("parts"))
    laid = base.select("conv", "turn", "role", flat.alias("body"), attachments.alias("media"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    laid = laid.select("conv", "turn", "role", "media", "body",
                       F.concat(head, "body", F.lit(END + "\n")).alias("piece"),
                       F.length(head).alias("head"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    laid = (laid.withColumn("no", F.row_number().over(order))
            .withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(upto),
                                            F.lit(0).cast("bigint"))))
    one = F.struct("no", "start", "piece", (F.col("start") + F.col("head")).alias("at"),
                   F.when(F.col("role") == loss_role, F.length("body")).otherwise(0)
                   .cast("bigint").alias("loss"), "media")
    rows = laid.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("t"))
    media = F.flatten(F.transform("t", lambda x: F.transform(
        x["media"], lambda m: F.struct(x["no"].alias("turn_no"), m["place"].alias("place"),
                                       m["kind"].alias("kind"), m["ref"].alias("ref"),
                                       m["tokens"].alias("tokens")))))
    rows = rows.select("conv", "t", media.alias("attachments"))
    return rows.select(
        "conv", F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: x["start"]).alias("turn_starts"),
        F.transform("t", lambda x: F.struct(x["at"].alias("start"), x["loss"].alias("length")))
        .alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"])
        .alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds ``turns`` (role, text) and
    ``loss_texts``, the unescaped text under each non-empty mask span."""
    # every piece ends with END and a line break; the last split is empty
    pieces = F.split("formatted", F.lit(r"<\|im_end\|>\n"))
    cut = chats.withColumn("pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    # a span lies in its own piece: offsets are taken relative to its start
    spans = F.arrays_zip("pieces", "turn_starts", "loss_spans")
    body = lambda p: F.substring(p, len(START) + 1, 2147483647)
    role = lambda p: F.substring_index(body(p), "\n", 1)         # noqa: E731
    return (cut.withColumn("turns", F.transform("pieces", lambda p: F.struct(
                unescape_role(role(p)).alias("role"),
                unescape(F.substr(body(p), F.length(role(p)) + 2)).alias("text"))))
            .withColumn("loss_texts", F.transform(
                F.filter(spans, lambda s: s["loss_spans"]["length"] > 0),
                lambda s: unescape(F.substr(
                    s["pieces"], (s["loss_spans"]["start"] - s["turn_starts"] + 1).cast("int"),
                    s["loss_spans"]["length"].cast("int")))))
            .drop("pieces"))


def digest(chats: DataFrame) -> DataFrame:
    """Digest columns of ``read_back``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                                F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(chats).select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens")
