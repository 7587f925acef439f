"""E-mail addresses in raw HTML: clear up, find, judge, rank.

A page's matches stay in one array per row, so ranking needs no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import (
    CONTACT_KEYWORDS,
    CONTACT_LOCAL_PARTS,
    EMAIL,
    EMAIL_BLOCKLIST,
    EMAIL_FORMAT,
    OBFUSCATIONS,
    WORD,
    WS,
)
from .text import has_rare_space, strip

# The first look-behind only answers the common case quickly.
_MATCH = rf"(?<![a-zA-Z0-9_])(?<!{WORD})({EMAIL.replace('+@', '++@', 1)})(?!{WORD})"
# What every address contains, starting at the one character that is rare.
_HAS_ADDRESS = r"@(?<=[a-zA-Z0-9._%+\-]@)(?=[a-zA-Z0-9.\-]+\.[a-zA-Z]{2})"
_SPAN = 100
# The shortest address has six characters, so this many pieces cover the span.
_PIECES = _SPAN // 6 + 1


# Quick looks that tell whether a text has anything to undo; most have not.
_HAS_BRACKETED = r"(?i)[\[(](?:at|dot)[\])]"
_HAS_SPACED = rf"(?i)at(?<={WS}at)(?={WS})"


def deobfuscate(html, strict_at: bool = False) -> Column:
    """Undo `[at]`, `(dot)` and the like, with the white space around them.

    The look-behinds keep long white space runs from being rescanned at every
    position; they do not change what matches. `strict_at` leaves the bare
    word "at" alone unless a hidden dot follows: "look at site.org" stays.
    """
    def undo(text, marks, space):
        for mark, plain, spaced in marks:
            if spaced:
                tail = rf"(?=[a-zA-Z0-9\-]+{space}*[\[(]dot[\])])" if strict_at else ""
                pattern = rf"(?i){space}(?<!{space}{space}){space}*+{mark}{space}++{tail}"
            else:
                pattern = rf"(?i)(?:\G|(?<!{space})){space}*+{mark}{space}*+"
            text = F.regexp_replace(text, pattern, plain)
        return text

    spaced = [o for o in OBFUSCATIONS if o[2]]
    bracketed, spaced_at = html.rlike(_HAS_BRACKETED), html.rlike(_HAS_SPACED)
    return (
        F.when(bracketed, undo(html, OBFUSCATIONS, WS))
        .when(spaced_at & has_rare_space(html), undo(html, spaced, WS))
        .when(spaced_at, undo(html, spaced, r"\s"))
        .otherwise(html)
    )


def find_addresses(clear) -> Column:
    """All addresses in reading order, as written."""
    none = F.array().cast("array<string>")
    likely = clear.contains("@") & clear.rlike(_HAS_ADDRESS)
    return F.when(likely, F.regexp_extract_all(clear, F.lit(_MATCH), 1)).otherwise(none)


def text_between(clear, hits) -> Column:
    """The text before, between and after the addresses (one piece more than hits)."""
    return F.when(F.size(hits) > 0, F.split(clear, _MATCH, -1)).otherwise(F.array(clear))


def join_pieces(between, hits) -> Column:
    return F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(hits, i), F.lit(""))))


def match_starts(between, hits) -> Column:
    """Start offset of every match, in characters."""
    lengths = F.zip_with(
        F.slice(between, 1, F.size(hits)),
        hits,
        lambda t, h: F.struct(F.length(t).alias("gap"), F.length(h).alias("own")),
    )
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct(
            (acc["end"] + x["gap"] + x["own"]).alias("end"),
            F.concat(acc["starts"], F.array(acc["end"] + x["gap"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def context(pieces, between, hits, i) -> Column:
    """Match `i` with up to 100 characters on either side."""
    first = F.greatest(i - _PIECES, F.lit(0))
    before = F.concat(
        F.array_join(F.slice(pieces, first + 1, i - first), ""), F.get(between, i)
    )
    after = F.array_join(F.slice(pieces, i + 2, F.lit(_PIECES)), "")
    return F.concat(F.right(before, F.lit(_SPAN)), F.get(hits, i), F.left(after, F.lit(_SPAN)))


def tidy_address(hit) -> Column:
    return F.btrim(F.lower(hit), F.lit("."))


def is_blocked(email) -> Column:
    return email.rlike("(?i)" + "|".join(EMAIL_BLOCKLIST))


def local_part(email) -> Column:
    return F.substring_index(email, "@", 1)


def email_domain(email) -> Column:
    return F.get(F.split(email, "@"), F.lit(1))


def score_address(email, around) -> Column:
    local = F.lower(local_part(email))
    return (
        F.when(local.isin(*CONTACT_LOCAL_PARTS), 20).otherwise(0)
        + F.when(around.rlike("(?iu)" + "|".join(CONTACT_KEYWORDS)), 15).otherwise(0)
        - F.when(F.length(local) < 4, 10).otherwise(0)
    )


def is_format_valid(email) -> Column:
    return F.coalesce(strip(email).rlike(EMAIL_FORMAT), F.lit(False))
