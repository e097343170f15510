r"""Chat formatting with typed content parts, as DataFrame operations only.

A turn is a role and an array of parts: text, image, audio or document.  A visitor flattens the parts of a turn
in order: text as it is, with control characters escaped, anything else as a placeholder that numbers the
conversation's attachments.  For each attachment its reference is recorded with the number of tokens that its
placeholder stands for once expanded.

    <turn role="user">
    What is on \<this> picture? <image 0/>
    </turn>

In texts, ``\`` and ``<``, in roles also ``"``, are preceded by ``\``, so a ``<`` without one is the template's, whatever a
text says, and reading back is exact.  The loss mask is the list of spans, in code points, of the texts of one
role, assistant by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens a placeholder stands for, by kind: for each attachment and for each of its units (tiles, seconds, pages).
TOKENS = {"image": (85, 170), "audio": (2, 25), "document": (8, 600)}
PARTS = "array<struct<kind: string, text: string, ref: string, units: bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r'\\([\\<"])', "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r'([\\<"])', r"\\$1")


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    null = F.lit(None)
    part = F.struct(
        F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")
    )
    return F.array(part).cast(PARTS)


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, (each, unit) in TOKENS.items():
        out = F.when(part["kind"] == kind, each + unit * F.coalesce(part["units"], F.lit(1))).otherwise(out)
    return out.cast("bigint")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    trained: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, n_turns, mask, attachments): one row for each conversation.

    mask: array of (start, length) in code points of ``formatted``, from 0, in order: the content of the turns of
    role ``trained``.  attachments: array of (number, turn, kind, ref, tokens), by number.

    Turns stand in order of turn, nulls first; turns of one number by role and content, repeated rows stay.
    A null role is empty, null parts and null texts are empty, a null kind is text, null units are one.  Kinds other
    than those of TOKENS count no tokens.  A null conv_id is a conversation.  No rows give no rows; other columns
    are not looked at.  A conversation is one string, so its turns meet in one task.
    """
    turns = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS)).alias("parts"),
    )
    attached = F.filter("parts", lambda p: ~_is_text(p))
    order = [F.col("turn").asc_nulls_first(), "role", F.to_json("parts")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("attached", attached).withColumn("number", F.row_number().over(before.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("first", F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0)))
    # a text, then the placeholder of the attachment with its number
    numbered = F.transform(
        F.sequence(F.lit(0), F.size("parts")),
        lambda i: F.struct(
            F.get("parts", i).alias("part"),
            (F.col("first") + F.size(F.filter(F.slice("parts", 1, i), lambda p: ~_is_text(p)))).alias("at"),
        ),
    )
    visited = F.transform(
        F.filter(numbered, lambda x: x["part"].isNotNull()),
        lambda x: F.when(_is_text(x["part"]), escape(F.coalesce(x["part"]["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), escape(x["part"]["kind"]), F.lit(" "), x["at"].cast("string"), F.lit("/>"))
        ),
    )
    one_text = (F.size("parts") == 1) & _is_text(F.get("parts", F.lit(0)))
    plain = escape(F.coalesce(F.get("parts", F.lit(0))["text"], F.lit("")))
    turns = turns.withColumn("content", F.when(one_text, plain).otherwise(F.array_join(visited, "")))
    head = F.concat(F.lit('<turn role="'), _escape_role(F.col("role")), F.lit('">\n'))
    turns = turns.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit("\n</turn>\n")))
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    noted = F.transform(
        "attached",
        lambda p, i: F.struct(
            (F.col("first") + i).cast("bigint").alias("number"), F.col("turn").cast("bigint").alias("turn"),
            p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"),
        ),
    )
    span = F.struct(F.col("start").cast("bigint").alias("start"), F.length("content").cast("bigint").alias("length"))
    kept = F.struct(
        "number", "piece", F.when(F.col("role") == trained, span).alias("span"), noted.alias("attached")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("mask"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, content), unescaped; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, "\n</turn>\n"), 1, F.size(F.split(formatted, "\n</turn>\n")) - 1)

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r'^<turn role="([^\\<"]*+(?:\\.[^\\<"]*+)*+)">\n', 1)
        return F.struct(
            unescape(head).alias("role"), unescape(F.substring(piece, F.length(head) + 16, F.length(piece))).alias("content")
        )

    return F.transform(pieces, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
