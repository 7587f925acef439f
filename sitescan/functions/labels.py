"""Scoring text against word lists: language, site type, topic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import LANGUAGE_NAMES, LANGUAGE_SCRIPTS
from ..samples import LANGUAGES
from .languages import language_scores
from .text import bind, listed_words

GUESS_TYPE = "struct<label:string,confidence:int>"
MIN_LANGUAGE_CHARS = 50
# Lead per run, in thousandths, below which the two best languages cannot be told apart, and that of half certainty.
LEAST_LEAD = 10
HALF_SURE = 50
# Of all characters, the part that must begin a known run of the longest kind: less is no language we know.
KNOWN_PART = 4
# Wide enough for all scripts that have one language only, in a few quick ranges.
_ANY_SCRIPT = r"[\x{370}-\x{3ff}\x{590}-\x{5ff}\x{980}-\x{e7f}\x{3040}-\x{d7af}]"


def tokens(text) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")


def _percent(part, whole) -> Column:
    return F.floor((200 * part + whole) / (2 * whole)).cast("int")


def best_label(words, table) -> Column:
    """Label whose word list is hit most often, and its share of all hits in percent.

    `table` is ((label, words), …). NULL without hits; ties go to the first label.
    The text's words are looked up in one hash set first, so the per-label
    counts only see the few words that matter.
    """
    known = sorted({w for _, listed in table for w in listed})

    def score(hits):
        return F.array(
            *(
                F.struct(
                    F.size(listed_words(hits, listed)).alias("n"),
                    F.lit(-i).alias("order"),
                    F.lit(label).alias("label"),
                )
                for i, (label, listed) in enumerate(table)
            )
        )

    def pick(scores):
        top = F.array_max(scores)
        whole = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s["n"])
        return F.when(
            top["n"] > 0,
            F.struct(top["label"].alias("label"), _percent(top["n"], whole).alias("confidence")),
        )

    return bind(bind(listed_words(words, known), score), pick)


def script_language(text, scripts=LANGUAGE_SCRIPTS) -> Column:
    """Language given away by its script: a quarter of all characters or more."""
    share = [
        (code, F.size(F.regexp_extract_all(text, F.lit(letters), 0))) for code, letters in scripts
    ]
    found = F.coalesce(
        *(
            F.when(
                n * 4 >= F.length(text),
                F.struct(F.lit(code).alias("label"), _percent(n, F.length(text)).alias("confidence")),
            )
            for code, n in share
        )
    )
    return F.when(text.rlike(_ANY_SCRIPT), found)


def letters_language(text, languages=LANGUAGES) -> Column:
    """Language by its letters. NULL where two languages are too close, and where few runs are in any sample."""
    codes = F.array(*map(F.lit, languages))

    def judged(s):
        clear = (s["lead"] >= LEAST_LEAD * s["runs"]) & (s["longest"] * KNOWN_PART >= s["chars"])
        sure = F.floor(100 * s["lead"] / (s["lead"] + HALF_SURE * s["runs"])).cast("int")
        return F.when(clear, F.struct(F.get(codes, s["best"]).alias("label"), sure.alias("confidence")))

    return judged(language_scores(text, languages))


def language_guess(text, min_chars: int = MIN_LANGUAGE_CHARS) -> Column:
    """Language code and confidence; NULL for short texts, for no evidence and for languages too close to call."""
    long = F.length(text) >= min_chars
    return F.when(long, F.coalesce(script_language(text), letters_language(F.when(long, text))))


def language_name(code) -> Column:
    """`en` as `English (en)`; an unknown code stays as it is."""
    name = F.coalesce(*(F.when(code == c, F.lit(n)) for c, n in LANGUAGE_NAMES))
    return F.coalesce(F.concat(name, F.lit(" ("), code, F.lit(")")), code)
