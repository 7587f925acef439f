"""Author names: candidates from three places, one cleaning rule."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import (
    AUTHOR_META,
    BYLINE_PREFIX,
    BYLINE_SELECTORS,
    NAME_LETTERS,
    NON_NAME_WORDS,
)
from .html import attr, has_class, inner_text, meta_content, single_string
from .nodes import LINKED_DATA, PLAIN_JSON
from .text import bind, first_of, listed_words, squeeze, strip

_LOW = r"[a-z\x{c0}-\x{24f}]"
_UP = r"[A-Z\x{c0}-\x{24f}]"


def split_joined(text, unicode_split: bool = False) -> Column:
    """Set a blank where a small letter runs into a capital: BeltranIWT, Beltran IWT.

    The accented range is used for both cases, so accented letters are split
    off too; `unicode_split` goes by real letter case instead.
    """
    low, up = (r"\p{Ll}", r"\p{Lu}") if unicode_split else (_LOW, _UP)
    return F.regexp_replace(text, f"({low})({up})", "$1 $2")


def clean_name(raw, unicode_split: bool = False) -> Column:
    """The person's name in a candidate text, or NULL if it does not look like one."""
    bare = strip(F.regexp_replace(strip(raw), f"(?iu){BYLINE_PREFIX}", ""))
    name = squeeze(split_joined(bare, unicode_split))

    def judge(n):
        words = F.split(n, " ")
        return F.when(
            n.rlike(NAME_LETTERS)
            & (F.size(words) <= 4)
            & (F.size(listed_words(F.split(F.lower(n), " "), NON_NAME_WORDS)) == 0)
            & n.rlike(r"(?:^| )\p{Lu}"),
            n,
        )

    return bind(name, judge)


def _first_name(candidates, unicode_split=False) -> Column:
    names = F.transform(candidates, lambda c: clean_name(c, unicode_split))
    return first_of(F.filter(names, lambda n: n.isNotNull()))


def _is(value, kind) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _text_of(value) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _person(value) -> Column:
    """A name given as a string or as an object with a name."""
    return F.coalesce(
        _text_of(value),
        F.when(_is(value, "OBJECT"), _text_of(F.try_variant_get(value, "$.name", "variant"))),
    )


def _jsonld_candidates(script) -> Column:
    parsed = F.try_parse_json(script)
    items = bind(
        parsed,
        lambda v: F.when(
            _is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")
        ).otherwise(F.array(v)),
    )

    def author(item):
        return bind(
            F.when(_is(item, "OBJECT"), F.try_variant_get(item, "$.author", "variant")),
            lambda a: F.when(
                _is(a, "ARRAY"), _person(F.try_variant_get(a, "$[0]", "variant"))
            ).otherwise(_person(a)),
        )

    return F.transform(items, author)


def author_from_jsonld(nodes, unicode_split: bool = False) -> Column:
    """First clean name in the page's JSON-LD blocks. Items that are not objects are skipped."""
    scripts = F.filter(
        nodes,
        lambda n: (n["tag"] == "script") & (attr(n, "type") == LINKED_DATA),
    )
    found = F.transform(
        F.filter(
            F.transform(scripts, lambda n: bind(
                single_string(nodes, n), lambda s: F.when(s.isNotNull(), F.coalesce(attr(n, PLAIN_JSON), s))
            )),
            lambda s: s.isNotNull(),
        ),
        _jsonld_candidates,
    )
    return _first_name(
        F.flatten(F.filter(found, lambda c: c.isNotNull())), unicode_split
    )


def author_from_meta(nodes, unicode_split: bool = False) -> Column:
    """First clean name in the author meta tags; links are not names."""
    contents = F.array(*(meta_content(nodes, name, value) for name, value in AUTHOR_META))
    usable = F.filter(contents, lambda c: c.isNotNull() & ~c.startswith("http"))
    return _first_name(usable, unicode_split)


def _selected(nodes, kind, arg) -> Column:
    if kind == "rel":
        return F.filter(nodes, lambda n: (n["tag"] == "a") & (attr(n, "rel") == arg))
    if kind == "attr":
        return F.filter(nodes, lambda n: attr(n, arg[0]).contains(arg[1]))
    if kind == "class":
        return F.filter(nodes, lambda n: has_class(n, arg))
    outer, inner = arg
    return bind(
        F.filter(nodes, lambda n: has_class(n, outer)),
        lambda around: F.filter(
            nodes,
            lambda n: has_class(n, inner)
            & F.exists(around, lambda o: (o["id"] < n["id"]) & (n["id"] <= o["last"])),
        ),
    )


def author_from_byline(nodes, unicode_split: bool = False) -> Column:
    """First clean name among the byline elements, selector by selector, each in document order."""
    # One list over all selectors, best first; what an earlier one has found need not come again.
    found = F.array_distinct(
        F.flatten(
            F.array(
                *(
                    F.transform(_selected(nodes, kind, arg), lambda n: n["id"])
                    for kind, arg in BYLINE_SELECTORS
                )
            )
        )
    )
    texts = F.transform(found, lambda i: inner_text(nodes, F.get(nodes, i)))
    return _first_name(texts, unicode_split)
