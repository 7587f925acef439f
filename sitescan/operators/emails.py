"""Contact addresses per page. All of it happens inside the row of the page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions.text import bind


def _on_hits(clear, body):
    """`body(hits, between, pieces)` for the addresses in `clear`.

    Bound step by step instead of kept in helper columns: a filter that Spark
    pushes down copies the text of a column, and copies of copies add up.
    """

    def with_hits(text):
        return bind(
            E.find_addresses(text),
            lambda hits: bind(
                E.text_between(text, hits),
                lambda between: bind(
                    E.join_pieces(between, hits), lambda pieces: body(hits, between, pieces)
                ),
            ),
        )

    return bind(clear, with_hits)


def email_deobfuscate(pages: DataFrame, column: str = "html", strict_at: bool = False) -> DataFrame:
    return pages.withColumn("clear", E.deobfuscate(F.col(column), strict_at))


def email_matches(pages: DataFrame, key: str = "page_id", column: str = "html",
                  strict_at: bool = False) -> DataFrame:
    """Every address as it is written, with its offset and its surroundings."""

    def found(hits, between, pieces):
        return F.zip_with(
            F.transform(
                hits,
                lambda h, i: F.struct(
                    h.alias("raw"), E.context(pieces, between, hits, i).alias("context")
                ),
            ),
            E.match_starts(between, hits),
            lambda m, s: F.struct(
                s.alias("start"), m["raw"].alias("raw"),
                E.tidy_address(m["raw"]).alias("email"), m["context"].alias("context"),
            ),
        )

    matches = _on_hits(E.deobfuscate(F.col(column), strict_at), found)
    # The outer form: for the inner one Spark would add a filter that runs the search twice.
    rows = pages.select(key, F.explode_outer(matches).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(key, "m.*")


def email_blocklist(matches: DataFrame) -> DataFrame:
    return matches.where(~E.is_blocked(F.col("email")))


def email_score(matches: DataFrame) -> DataFrame:
    return matches.withColumn("score", E.score_address(F.col("email"), F.col("context")))


def ranked_emails(pages: DataFrame, column: str = "html", strict_at: bool = False) -> DataFrame:
    """Adds `ranked`: the page's addresses with their best score, best first.

    A page's matches never leave its row: sort by address and score, keep the
    first of each address, sort by rank.
    """

    def scored(hits, between, pieces):
        judged = F.transform(
            hits,
            lambda h, i: F.struct(
                E.tidy_address(h).alias("email"),
                E.context(pieces, between, hits, i).alias("context"),
            ),
        )
        return F.transform(
            F.filter(judged, lambda m: ~E.is_blocked(m["email"])),
            lambda m: F.struct(
                m["email"].alias("email"),
                (-F.greatest(F.lit(0), E.score_address(m["email"], m["context"]))).alias("rank"),
            ),
        )

    def best(found):
        firsts = F.filter(
            found, lambda m, i: (i == 0) | (m["email"] != F.get(found, i - 1)["email"])
        )
        order = F.array_sort(
            F.transform(firsts, lambda m: F.struct(m["rank"].alias("rank"), m["email"].alias("email")))
        )
        return F.transform(
            order, lambda m: F.struct(m["email"].alias("email"), (-m["rank"]).alias("score"))
        )

    found = _on_hits(E.deobfuscate(F.col(column), strict_at), scored)
    return pages.withColumn("ranked", bind(F.array_sort(F.array_distinct(found)), best))


def email_rank(pages: DataFrame, key: str = "page_id", column: str = "html",
               strict_at: bool = False) -> DataFrame:
    """(key, rank, email, score), rank from 1."""
    rows = ranked_emails(pages, column, strict_at).select(
        key, F.posexplode_outer("ranked").alias("pos", "e")
    )
    return rows.where(F.col("e").isNotNull()).select(key, (F.col("pos") + 1).alias("rank"), F.col("e.email").alias("email"),
                       F.col("e.score").alias("score"))


def best_email(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    best = F.get(F.col("ranked"), F.lit(0))["email"]
    return ranked_emails(pages, column).select(key, best.alias("email"))
