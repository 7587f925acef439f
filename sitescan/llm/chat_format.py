"""Conversations with typed content parts as one text, with a mask for training.

A turn is a list of parts: text, image, audio or document. Flattening a turn
visits its parts in order: texts are escaped, the others become placeholders and
are recorded as attachments with the tokens their placeholder stands for.

Format of a turn: OPEN role "\n" content CLOSE. Control strings inside roles and
texts are replaced by ESCAPE and one letter, and ESCAPE itself by ESCAPE and `e`,
so no text can open or close a turn, and every text can be read back.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's control strings and how they are written inside texts.
OPEN = "<|turn|>"
CLOSE = "<|end|>"
ESCAPE = "\u241b"
CODES = {
    OPEN: "t",
    CLOSE: "x",
    "<s>": "b",
    "</s>": "c",
    "[INST]": "i",
    "[/INST]": "j",
    "<<SYS>>": "s",
    "<</SYS>>": "u",
    "<|image|>": "m",
    "<|audio|>": "a",
    "<|document|>": "d",
}
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,amount:double>"

# Tokens a placeholder stands for, per unit of `amount` (image tiles of
# 512 x 512, seconds of audio, pages of a document), and at least for each attachment.
TOKENS_PER_UNIT = {"image": 170, "audio": 25, "document": 600}
TOKENS_AT_LEAST = {"image": 85, "audio": 1, "document": 1}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    return reduce(lambda x, c: F.replace(x, F.lit(c[0]), F.lit(ESCAPE + c[1])), CODES.items(), out)


def unescape(text: Column) -> Column:
    out = reduce(lambda x, c: F.replace(x, F.lit(ESCAPE + c[1]), F.lit(c[0])), CODES.items(), text)
    return F.replace(out, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _header(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit(ESCAPE + "n"))


def _role(header: Column) -> Column:
    return unescape(F.replace(header, F.lit(ESCAPE + "n"), F.lit("\n")))


def _by_type(part: Column, values: dict, other) -> Column:
    pairs = list(values.items())
    first = F.when(part["type"] == pairs[0][0], F.lit(pairs[0][1]))
    return reduce(lambda c, p: c.when(part["type"] == p[0], F.lit(p[1])), pairs[1:], first).otherwise(other)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def visit(part: Column) -> Column:
    """What a part adds to the content. A null part adds nothing; an unknown type is read as text."""
    text = F.coalesce(part["text"], F.lit(""))
    return F.when(part.isNull(), "").when(_is_attachment(part), _by_type(part, PLACEHOLDERS, F.lit(""))).otherwise(escape(text))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment's placeholder stands for; its amount counts as 0 if null, negative or not a number."""
    amount = F.coalesce(F.when((part["amount"] > 0) & (part["amount"] < 1e9), part["amount"]), F.lit(0.0))
    return F.greatest(
        F.ceil(amount * _by_type(part, TOKENS_PER_UNIT, F.lit(0))), _by_type(part, TOKENS_AT_LEAST, F.lit(0))
    ).cast("bigint")


def as_parts(text: Column) -> Column:
    """A plain text as its only part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("double").alias("amount"),
        )
    )


def format_conversations(turns: DataFrame, mask_roles=("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, n_tokens_expanded.

    `turns` has conv_id, turn, role and parts (array of type, text, ref, amount).
    Turns are ordered by turn, then role, then content; null turns come first
    and repeated rows stay. Null roles and texts count as empty. `loss_mask` is an array
    of (start, length) in code points of `formatted`, one per turn of `mask_roles`,
    around its content. Attachments are in order of appearance.

    Turns are formatted row by row; only a conversation's own text meets in one row.
    """
    content = F.concat_ws("", F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit))
    attachments = F.transform(
        F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _is_attachment),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        content.alias("content"),
        attachments.alias("attachments"),
    ).withColumn("head", F.concat(F.lit(OPEN), _header(F.col("role")), F.lit("\n")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments")
    size = F.length("head") + F.length("content") + len(CLOSE)
    # A window keeps a long conversation on disk and passes it once.
    placed = rows.select(
        "*",
        F.row_number().over(order).alias("seq"),
        (F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - len(CLOSE) - F.length("content")).alias("start"),
    )
    mask = F.when(F.col("role").isin(*mask_roles), F.struct("start", F.length("content").cast("bigint").alias("length")))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.concat("head", "content", F.lit(CLOSE)).alias("text"), "attachments"))).alias("turns"),
        F.array_sort(F.collect_list(mask)).alias("loss_mask"),
    )
    return whole.select(
        "conv_id",
        F.concat_ws("", "turns.text").alias("formatted"),
        "loss_mask",
        F.flatten("turns.attachments").alias("attachments"),
    ).withColumn("n_tokens_expanded", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq, role, text, masked; placeholders stay in the text.

    `masked` tells whether the turn's content lies under the loss mask, by its
    place in code points. Any mask that does not cover exactly a turn's content
    masks nothing.
    """
    pieces = formatted.select("conv_id", F.posexplode(F.split("formatted", _literal(OPEN))).alias("seq", "body"))
    before = W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    body = F.col("body")
    head = F.instr(body, "\n")
    turns = (
        pieces.withColumn("at", F.coalesce(F.sum(F.length("body") + len(OPEN)).over(before), F.lit(0)))
        .where("seq > 0")
        .select(
            "conv_id",
            "seq",
            _role(F.substring_index(body, "\n", 1)).alias("role"),
            F.substring_index(F.substring(body, head + 1, F.length(body)), CLOSE, 1).alias("content"),
            (F.col("at") + head).alias("start"),
        )
    )
    masks = formatted.select(F.col("conv_id").alias("_id"), F.explode("loss_mask").alias("m")).select(
        "_id", F.col("m.start").alias("_start"), F.col("m.length").alias("_length")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start"))
    return turns.join(masks, same & (F.length("content") == F.col("_length")), "left").select(
        "conv_id", "seq", "role", unescape(F.col("content")).alias("text"), F.col("_start").isNotNull().alias("masked")
    )


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
