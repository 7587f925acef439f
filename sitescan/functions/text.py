"""White space handling and small array helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import WS, WS_CHARS


def strip(text):
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WS_CHARS))


def has_rare_space(text) -> Column:
    """Might there be white space other than blanks, tabs and line ends?

    Asked by a few wide ranges, which is quick; it may say yes too often, but
    never no where there is some.
    """
    return text.rlike(r"[\x1c-\x1f\x{85}-\x{a0}\x{1680}-\x{3000}]")


def squeeze(text) -> Column:
    """Turn each run of white space into one blank and trim."""

    def cleaned(t):
        return F.when(has_rare_space(t), F.regexp_replace(t, f"{WS}+", " ")).otherwise(
            F.regexp_replace(t, r"\s+", " ")
        )

    return strip(bind(text, cleaned))


def blank_to_null(text):
    return F.when(text != "", text)


def bind(value, body):
    """`body(value)` with `value` worked out once per row, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(array):
    return F.get(array, F.lit(0))


def first_where(array, test) -> Column:
    """The first match as an array of at most one element, ready to be chained."""
    return F.slice(F.filter(array, test), 1, 1)


def listed_words(words, listed) -> Column:
    """Those of `words` that are in the list, repeats included.

    The list goes in as SQL text: one literal instead of one call per word, and
    Spark makes a hash set of it.
    """
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in listed)
    return F.call_function("filter", words, F.expr(f"w -> w in ({quoted})"))
