"""Reading classifier replies: fences, scores, site types."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import SITE_TYPES
from .json_text import read_json
from .text import blank_to_null, strip

EMPTY_REPLY = "empty reply"
INVALID_REPLY = "JSON parse error"
NOT_AN_ARRAY = "reply was not a JSON array"
MISSING_ITEM = "missing from reply"
BAD_ITEM = "malformed reply item"
NO_REPLY = "no reply for this batch"
SCORES = ("niche", "site_type", "language", "author")


def unfence(reply) -> Column:
    """Drop a code fence around a reply. Everything up to the first line end belongs to the fence."""
    opened = F.regexp_replace(strip(reply), r"^```(?:[^\n]*\n)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def kind_of(value) -> Column:
    return F.schema_of_variant(value)


def field(item, name) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def text_field(item, name) -> Column:
    """A string field; NULL for JSON null, a missing key, or any other type."""
    value = field(item, name)
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_text_or_null(item, name) -> Column:
    return F.coalesce(kind_of(field(item, name)).isin("STRING", "VOID"), F.lit(True))


def clamp_score(item, path) -> Column:
    """An integer from 0 to 100; what is no number counts as 0."""
    whole = F.try_variant_get(item, path, "bigint")
    huge = F.when(
        kind_of(F.try_variant_get(item, path, "variant")) != "STRING",
        F.try_variant_get(item, path, "double"),
    )
    number = F.coalesce(whole.cast("double"), huge, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int")


def confidence(item) -> Column:
    return F.struct(*(clamp_score(item, f"$.confidence.{s}").alias(s) for s in SCORES))


def site_type(raw) -> Column:
    """The canonical spelling of a site type, or Unknown."""
    low = F.lower(raw)
    return F.coalesce(*(F.when(low == t.lower(), F.lit(t)) for t in SITE_TYPES), F.lit("Unknown"))


def reply_value(reply) -> Column:
    """A whole reply as a variant, NULL if it cannot be read.

    Spark's reader stops behind the value, so the end is looked at here: words after an array spoil it.
    """
    text = unfence(reply)
    closed = (text.startswith("[") == text.endswith("]")) & (text.startswith("{") == text.endswith("}"))
    return read_json(F.when(closed, text))


def reply_error(reply, value) -> Column:
    """Why a whole reply cannot be used, or NULL; `value` is what `reply_value` makes of it."""
    return (
        F.when(F.coalesce(blank_to_null(strip(reply)).isNull(), F.lit(True)), EMPTY_REPLY)
        .when(value.isNull(), INVALID_REPLY)
        .when(~kind_of(value).startswith("ARRAY"), NOT_AN_ARRAY)
    )
