"""Secrets in texts: three patterns, and strings that pass for random (SQL functions only).

A candidate is a run of letters, digits and + / _ - that is long enough. Its encoding is the
narrowest alphabet that holds it, and three tests ask whether it was drawn evenly from that
alphabet: chi-squared over the symbols (over kinds of symbols where the string is short), the
number of runs above and below the middle of the alphabet, and the serial correlation of
neighbours. Fisher's method makes them one p, which is even between 0 and 1 for random strings and close to
0 for words, paths and names. So of distinct candidates of one encoding and about one length twice those
with p of one half or more are random; the others are false discoveries, and more of them look random the
shorter they are. The bound on p is set for each encoding and length, as the lowest that
keeps the share of false discoveries below `false_share`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
RANDOM = "random"
# The three patterns. Letters of the first count in either case, spelled out, since
# engines disagree about which letters beyond ASCII are equal but for case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
# Greedy runs that are too short drop, and no part of such a run is long enough: the bound can be in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets in the order of their values, the first that holds a candidate counts. Numbers alone have none.
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
KINDS = ("[0-9]", "[aeiou]", "[b-df-hj-np-tv-z]", "[AEIOU]", "[B-DF-HJ-NP-TV-Z]", "[+/_-]")
_IN_KIND = (DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "+/_-")
# Lengths from which a new class of lengths begins.
LENGTHS = (16, 20, 24, 32, 48, 96)
BINS = 100
LEAST_P = 1e-12


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, start: Column) -> Column:
    """For each number, `start` and the sum of those before it."""
    empty = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        numbers, empty, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"]
    )


def running(numbers: Column, block: int = 256) -> Column:
    """For each number, the sum of those before it; in blocks, since every step copies what it has."""

    def by_block(x):
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, _running(F.transform(b, total), F.lit(0)), _running)))

    def total(x):
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    return let(numbers, by_block)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, found) of all matches, in code points; `pattern` matches no empty text."""
    steps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")),
    )
    steps = F.filter(steps, lambda x: x["found"].isNotNull())

    def placed(s):
        before = running(F.transform(s, lambda x: x["gap"] + F.length(x["found"])))
        return F.zip_with(
            s, before,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["found"])).alias("end"), x["found"].alias("found")
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), let(steps, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """(start, kind, end), kinds by number, of the three patterns."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    each = [assign, matches(text, ACCESS), matches(text, HEX)]
    return F.concat(*(_spans(x, i) for i, x in enumerate(each)))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def encoding(token: Column) -> Column:
    """The number of the narrowest alphabet that holds `token`, null for numbers and mixtures."""
    out = F.when(token.rlike("^[0-9]*$"), F.lit(None).cast("int"))
    for i, alphabet in enumerate(ENCODINGS.values()):
        out = out.when(token.rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]+$"), F.lit(i))
    return out


def _upper_tail(z: Column) -> Column:
    """1 - normal distribution function, to 2 parts in 10,000."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _uniform(token: Column, alphabet: str) -> Column:
    """z of chi-squared (Wilson and Hilferty) over symbols, or kinds of symbols where fewer than two of each are to be expected."""
    n, size = F.length(token), len(alphabet)
    shares = [(kind, sum(c in alphabet for c in members) / size) for kind, members in zip(KINDS, _IN_KIND)]
    shares = [(kind, share) for kind, share in shares if share]

    def counted(kind):
        return F.length(F.regexp_replace(token, kind.replace("[", "[^", 1), ""))

    kinds = sum(((counted(kind) - n * share) * (counted(kind) - n * share) / (n * share) for kind, share in shares), F.lit(0.0))
    squares = F.aggregate(
        F.transform(F.array(*map(F.lit, alphabet)), lambda c: n - F.length(F.replace(token, c, F.lit("")))),
        F.lit(0.0), lambda a, x: a + x.cast("double") * x,
    )
    symbols = squares * size / n - n

    def z(x, df):
        wide = 2 / (9 * df)
        return (F.cbrt(x / df) - (1 - wide)) / wide**0.5

    return F.when(n < 2 * size, z(kinds, len(shares) - 1)).otherwise(z(F.greatest(symbols, F.lit(0.0)), size - 1))


def _order(token: Column, alphabet: str) -> Column:
    """(runs, serial): z of both tests that look at neighbours."""
    size = len(alphabet)
    middle, variance = (size - 1) / 2, (size * size - 1) / 12
    values = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1 - middle)

    def both(v):
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b)
        m = F.size(v) - 1
        turns = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(x < 0, 1.0).otherwise(0.0))
        products = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
        return F.struct(((2 * turns - m) / F.sqrt(m)).alias("runs"), (products / (variance * F.sqrt(m))).alias("serial"))

    return let(values, both)


def randomness(token: Column) -> Column:
    """(stratum, p): encoding and class of length as one number, and the p of all three tests."""

    def scored(token):
        return let(encoding(token), lambda code: _chosen(token, code))

    def _chosen(token, code):
        uniform, order = F, F
        for i, alphabet in enumerate(ENCODINGS.values()):
            uniform = uniform.when(code == i, _uniform(token, alphabet))
            order = order.when(code == i, _order(token, alphabet))
        length = sum((F.when(F.length(token) >= n, 1).otherwise(0) for n in LENGTHS[1:]), F.lit(0))
        return F.struct((code * len(LENGTHS) + length).alias("stratum"), let(order, lambda o: _fisher(uniform, o)).alias("p"))

    def _fisher(uniform, order):
        ps = [_upper_tail(uniform), 2 * _upper_tail(F.abs(order["runs"])), 2 * _upper_tail(F.abs(order["serial"]))]
        surprise = -sum((F.log(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0))) for p in ps), F.lit(0.0))
        return let(surprise, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(token, scored)


def candidates(text: Column) -> Column:
    return matches(text, CANDIDATE)


def bounds(docs: DataFrame, text: Column, false_share: float) -> dict[int, float]:
    """The lowest p that counts, by stratum, from all distinct candidates of the corpus.

    At most one row per encoding and class of lengths reaches the driver.
    """
    tokens = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))).alias("token")).distinct()
    scored = tokens.select(randomness(F.col("token")).alias("r")).where("r.p IS NOT NULL")
    # Some 5,000 rows at most, whatever the corpus
    bins = scored.groupBy("r.stratum", F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    edges = bins.groupBy("stratum").agg(F.sum(F.when(F.col("bin") >= BINS // 2, F.col("count"))).alias("half"), F.collect_list(F.struct("bin", "count")).alias("bins"))
    edge = F.explode(F.sequence(F.lit(1), F.lit(BINS // 2))).alias("edge")
    kept = F.aggregate(F.filter("bins", lambda b: b["bin"] >= F.col("edge")), F.lit(0).cast("bigint"), lambda a, b: a + b["count"])
    random = (1 - F.col("edge") / BINS) * 2 * F.col("half")
    good = edges.where("half > 0").select("stratum", "half", "bins", edge).where(1 - random / kept <= false_share)
    return {r["stratum"]: r["edge"] / BINS for r in good.groupBy("stratum").agg(F.min("edge").alias("edge")).collect()}


def find_secrets(docs: DataFrame, false_share: float = 0.1, id_col="doc_id", text_col="text") -> DataFrame:
    """id, base, random: one row per row of `docs`, with arrays of (start, kind, end), by start.

    `base` holds the matches of the three patterns, kind 0 to 2; `random` those candidates, kind 3, that
    pass for random and overlap none of them. Starts and ends are code points, ends exclusive. A null
    text is empty; null ids and repeated rows stay; copies of a candidate count once for the bounds, which are the same
    for all texts. A document, however long, is read within its row. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = bounds(docs, text, false_share)
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.select(id_col, F.array_sort(base_spans(F.col("_text"))).alias("base"), F.when(F.lit(bool(least)), candidates(F.col("_text"))).alias("_runs"))
    wanted = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.create_map().cast("map<int,double>")

    def random(run):
        return let(randomness(run["found"]), lambda r: F.coalesce(r["p"] >= F.try_element_at(wanted, r["stratum"]), F.lit(False)))

    def apart(run):
        return ~F.exists("base", lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))

    found = F.filter(F.filter("_runs", apart), random)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select(id_col, "base", F.coalesce(_spans(found, len(BASE)), none).alias("random"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, (*BASE, RANDOM)))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))
