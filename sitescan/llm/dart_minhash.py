"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

Darts fall on the plane of each element: a Poisson process over (weight, rank), the
same wherever the element occurs. A document catches the darts below its
elements' weights with a rank of up to t over its total weight, t of them on average however
many elements it has. Each dart belongs to one of k coordinates, and a coordinate keeps its
earliest dart. Two documents agree in a coordinate with the probability of their (weighted)
Jaccard similarity.

Bands of coordinates give candidate pairs, but never all pairs of a bucket: a bucket's members
meet its first one, and what is linked that way needs no further pair. Only members of
different components go on to another leader, and at last to each other. A pair is compared word by
word if one bit of each coordinate leaves it possible: alike texts fail that less than once in a
million times.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _hashes, _mixed
from .shared import Plain, Words, bucketed, remove, scratch, slices, spread_out, written

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 6
K = BANDS * ROWS
LEADERS = 2
BLOCK = 256
FIND = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
MARK = "struct<digest:binary,buckets:array<bigint>,sketch:array<bigint>>"
SKETCH = K // 64
# Standard deviations by which a pair may seem less alike than it is.
SLACK = 5.0
EMPTY = np.uint64(2**64 - 1)
# No rank beyond this is needed: even a single element has caught thousands of darts by then.
FARTHEST = float(1 << 13)
RANK_UNIT = float(1 << 26)  # ranks are kept in 40 bits, dart names in 24


def _shingles(words: Words, texts: pa.Array):
    """(hashes, ends, tokens, token ends): one hash per run of five words; of all words if there are fewer."""
    codes, token_ends = words.codes(texts)
    tokens = _hashes(list(words.index))[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(token_ends)
    count = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(token_ends[:-1] - ends[:-1], count) + np.arange(ends[-1])
    long = np.repeat(np.minimum(sizes, SHINGLE), count)
    hashed = np.zeros(len(starts), np.uint64)
    for i in range(SHINGLE):
        on = long > i
        hashed[on] = _mixed(hashed[on], tokens[starts[on] + i])
    return hashed, ends, tokens, token_ends


def dart_signatures(elements: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int = K, t: float | None = None) -> np.ndarray:
    """[documents, k]: the earliest dart of each coordinate; EMPTY throughout for a document without elements.

    An element that a document lists twice counts like its larger weight. Documents that leave a
    coordinate empty are thrown at again with twice the darts, up to rank FARTHEST; ranks found before stay the same.
    """
    n = len(ends) - 1
    t = k * (np.log(k) + 3) if t is None else t
    out = np.full(n * k, EMPTY, np.uint64)
    elements, weights, owner = _distinct(elements, weights, np.repeat(np.arange(n), np.diff(ends)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    totals = np.bincount(owner, weights, n)
    reach = np.minimum(t / np.maximum(totals, 1e-9), FARTHEST)
    low, strip = 0.0, 0
    while (rows := np.flatnonzero(weights > low)).size:
        high = 2.0**strip
        _throw(out, elements, weights, owner, rows, reach, k, strip, low, high)
        low, strip = high, strip + 1
    out = out.reshape(n, k)
    again = np.flatnonzero((totals > 0) & (reach < FARTHEST) & (out == EMPTY).any(axis=1))
    if len(again):
        own = spread_out(ends[again], np.diff(ends)[again])
        own_ends = np.concatenate([[0], np.cumsum(np.diff(ends)[again])])
        out[again] = dart_signatures(elements[own], weights[own], own_ends, k, 2 * t)
    return out


def _distinct(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """Each document's elements once, with the largest of their weights: (elements, weights, owner)."""
    order = np.lexsort((weights, elements, owner))
    elements, weights, owner = elements[order], weights[order], owner[order]
    last = np.ones(len(order), bool)
    last[:-1] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    return elements[last], weights[last], owner[last]


def _throw(out, elements, weights, owner, rows, reach, k, strip, low, high):
    """Throw into one strip of weights, `low` to `high`: one dart after the other, by rank, at all elements at once."""
    seed = _mixed(elements[rows], np.array([strip + 1], np.uint64))
    doc = owner[rows]
    rank = np.zeros(len(rows))
    limit = reach[doc]
    whole = weights[rows] >= high
    number = 0
    while len(rows):
        number += 1
        dart = _mixed(seed, np.array([number], np.uint64))
        # Gaps between ranks are exponential; the strip's width is its rate of darts.
        rank = rank - np.log(((dart >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (high - low)
        on = np.flatnonzero(rank <= limit)
        if len(on) < len(rows):
            rows, seed, doc, rank, limit, whole, dart = (x[on] for x in (rows, seed, doc, rank, limit, whole, dart))
        coordinate = ((dart >> np.uint64(24) & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)
        value = (rank * RANK_UNIT).astype(np.uint64) << np.uint64(24) | dart & np.uint64(0xFFFFFF)
        place = doc * k + coordinate.astype(np.int64)
        if not whole.all():
            # The dart's height in the strip decides whether it falls below the element's weight.
            height = _mixed(dart, np.array([17], np.uint64)) >> np.uint64(11)
            hit = whole | (low + (high - low) * height.astype(np.float64) * 2.0**-53 <= weights[rows])
            place, value = place[hit], value[hit]
        np.minimum.at(out, place, value)


def band_buckets(signatures: np.ndarray) -> np.ndarray:
    """[documents, BANDS]: one 64-bit bucket per band."""
    n = len(signatures)
    parts = signatures.reshape(n, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for i in range(ROWS):
        out = _mixed(out, parts[:, :, i])
    return out.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """[documents, SKETCH]: one bit of each coordinate, as 64-bit numbers."""
    bits = (signatures & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _possible(least: float):
    """Whether two sketches agree in as many bits as alike texts do, but for SLACK deviations."""
    p = (1 + least) / 2
    most = K - (K * p - SLACK * np.sqrt(K * p * (1 - p)))
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other")[i])) for i in range(SKETCH)), F.lit(0))
    return differ <= F.lit(float(most))


def _mark(texts: pa.Array) -> pa.Array:
    """The digest of a text's words, and its buckets; nulls for a text without words."""
    from xxhash import xxh3_128_digest

    digests, buckets, bits = [], [], []
    for part in slices(pa.record_batch([texts], ["text"]), "text", 1 << 20):
        hashed, ends, tokens, token_ends = _shingles(Words(lambda t: FIND(t.lower())), part.column(0))
        signatures = dart_signatures(hashed, np.ones(len(hashed)), ends)
        cuts = token_ends.tolist()
        digests += [xxh3_128_digest(tokens[a:b].tobytes()) if b > a else None for a, b in zip(cuts, cuts[1:])]
        buckets.append(band_buckets(signatures))
        bits.append(sketches(signatures))
    columns = [pa.array(digests, pa.binary()), _lists(buckets, BANDS), _lists(bits, SKETCH)]
    return pa.StructArray.from_arrays(columns, ["digest", "buckets", "sketch"])


def _lists(parts: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros((0, width), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))


def _jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
    """The Jaccard similarity of two texts' sets of shingles."""
    out = []
    one, other = (pa.record_batch([x], ["text"]) for x in (left, right))
    for i in range(0, len(left), 256):
        words = Words(lambda t: FIND(t.lower()))
        a, a_ends, _, _ = _shingles(words, one.column(0).slice(i, 256))
        b, b_ends, _, _ = _shingles(words, other.column(0).slice(i, 256))
        for j in range(len(a_ends) - 1):
            x, y = np.unique(a[a_ends[j] : a_ends[j + 1]]), np.unique(b[b_ends[j] : b_ends[j + 1]])
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
    return pa.array(out, pa.float64())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for edges (a, b): the smallest node of each connected component.

    Large and small stars by turns; every turn is written, so that nothing is computed twice. Joins are merged:
    a broadcast passes through the driver, and one a join and turn fills its memory faster than it is freed.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch(spark, name))
    state = None
    while True:
        # One reading for both ways.
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, scratch(spark, name))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        state = now


def _tile(key, batch):
    """The links between the two blocks of a tile (or within its only one) that join different components."""
    rows = batch.select(["node", "component", "block"]).to_pydict()
    node, component, block = (np.array(rows[c]) for c in ("node", "component", "block"))
    least = batch.column("least")[0].as_py()
    text = batch.column("text").combine_chunks()
    hashed, ends, _, _ = _shingles(Words(lambda t: FIND(t.lower())), text)
    owner = np.repeat(np.arange(len(node)), np.diff(ends))
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[first]
    names, column = np.unique(hashed[first], return_inverse=True)
    sizes = np.bincount(owner, minlength=len(node))
    starts = np.cumsum(sizes) - sizes
    low, high = key[1].as_py(), key[2].as_py()
    a, b = [], []
    for i in np.flatnonzero(block == low):
        held = np.zeros(len(names), bool)
        held[column[starts[i] : starts[i] + sizes[i]]] = True
        both = np.bincount(owner, held[column], len(node))
        alike = both >= least * (sizes[i] + sizes - both)
        alike &= (component != component[i]) & (block == high)
        for j in np.flatnonzero(alike):
            a.append(max(node[i], node[j]))
            b.append(min(node[i], node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _all_links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): every link between members (bucket, node, component) of one bucket and different components.

    Members of a bucket's largest component are never compared with each other, so their blocks meet only those of the
    others: a large group that is linked already sends each text once for every 256 others, not for every 256 of its own.
    """
    counted = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = counted.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    mains, others = F.ceil(F.col("top.n") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int")
    # Blocks of the others come first, those of the largest component after them.
    largest = largest.select("bucket", F.col("top.component").alias("main"), mains.alias("mains"), others.alias("others")).where("others > 0")
    place = F.xxhash64("node")
    is_main = F.col("component") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    until = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    tiles = members.join(largest.hint("merge"), "bucket").select(
        "bucket", "node", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), until)).alias("other")
    ).select("bucket", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = tiles.join(texts, "node").withColumn("least", F.lit(least))
    return rows.groupBy("bucket", "low", "high").applyInArrow(_tile, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (leader a, member b) whose texts are alike.

    `texts` lie in buckets by node: members fetch their text there, then meet their leader's, so of all texts only
    the members' travel. Leaders are written without buckets, which lets a leader of very many members be split.
    """
    spark = texts.sparkSession
    pairs = written(pairs, scratch(spark, "pairs"))
    leaders = written(texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), scratch(spark, "leaders"))
    left = leaders.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    alike = pairs.join(right, "b").join(left, "a").select("a", "b", F.arrow_udf(_jaccard, "double")("left", "right").alias("similarity"))
    return alike.where(F.col("similarity") >= least)


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` with `class_id`, the smallest id of its class, and `stays`, true for one row of each class.

    Classes are the connected components of the links between texts that share `least` or
    more of their sets of five-word shingles. Texts with the same words in the same order are one
    node, whatever their number. A null text or one without words is a class of its own;
    fewer than five words make one shingle. Null ids sort last within a class.
    """
    spark = docs.sparkSession
    plain = Plain(docs, id_col, text_col)
    # Numbers are written before rows move: a task that is repeated must not number them anew.
    place = scratch(spark, "numbered")
    numbered = written(plain.rows.withColumn("_row", F.monotonically_increasing_id()), place)
    all_rows = bucketed(numbered, scratch(spark, "rows"), "_row")
    remove(spark, place)
    marked = all_rows.select("_row", "_id", F.arrow_udf(_mark, MARK)(F.coalesce("_text", F.lit(""))).alias("_mark"))
    rows = marked.select(
        "_row", "_id", F.col("_mark.digest").alias("_digest"), F.col("_mark.buckets").alias("_buckets"), F.col("_mark.sketch").alias("_sketch")
    )
    rows = written(rows, scratch(spark, "marked"))
    distinct = written(
        rows.where("_digest IS NOT NULL").groupBy("_digest").agg(F.min("_row").alias("node")), scratch(spark, "nodes")
    )
    nodes = rows.select("_digest", "_row", "_buckets").join(
        distinct.select("node").hint("merge"), F.col("_row") == F.col("node"), "left_semi"
    )
    placed = nodes.select(F.col("_row").alias("node"), F.explode("_buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    # Only buckets with two members or more go on.
    sketched = rows.select(F.col("_row").alias("node"), F.col("_sketch").alias("sketch"))
    members = placed.join(shared.select("bucket").hint("merge"), "bucket").join(sketched.hint("merge"), "node")
    place = scratch(spark, "members")
    members = written(members, place)
    used = members.select("node").distinct()
    own = all_rows.select(F.col("_row").alias("node"), F.coalesce("_text", F.lit("")).alias("text"))
    texts = bucketed(own.join(used, "node", "left_semi"), scratch(spark, "candidate-texts"), "node")
    component = None
    for turn in range(LEADERS + 1):
        current = members.withColumn("component", F.col("node"))
        if component is not None:
            current = members.join(component.hint("merge"), "node", "left").select(
                "node", "bucket", "sketch", F.coalesce("component", "node").alias("component")
            )
        # The original of a group of copies shares more large buckets than any copy does; it leads first.
        sizes = current.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
        ).where("low < high")
        current = current.join(sizes.select("bucket", "size").hint("merge"), "bucket")
        if turn < LEADERS:
            central = current.groupBy("node").agg(F.sum("size").alias("weight"))
            ranked = current.join(central.hint("merge"), "node").select("bucket", F.struct(F.col("weight"), F.col("node").alias("leader")).alias("rank"))
            leaders = ranked.groupBy("bucket").agg(F.max("rank")["leader"].alias("leader"))
            current = current.join(leaders.hint("merge"), "bucket").drop("size")
        else:
            current = current.drop("size", "sketch")
        # Written once: pairs and the next turn's members come from it.
        before, place = place, scratch(spark, "open")
        open_ = written(current, place)
        remove(spark, before)
        if open_.isEmpty():
            # Each bucket's members are linked already, or there are none.
            break
        if turn < LEADERS:
            first = open_.where("node = leader").select(
                "bucket", F.col("component").alias("of_leader"), F.col("sketch").alias("other")
            )
            pairs = open_.join(first.hint("merge"), "bucket").where((F.col("component") != F.col("of_leader")) & _possible(least))
            found = _verified(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), texts, least)
        else:
            found = _all_links(open_, texts, least)
        found = written(found.select("a", "b"), scratch(spark, "links"))
        if not found.isEmpty():
            # Earlier links count by their components.
            if component is not None:
                found = found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
            component = written(components(found), scratch(spark, "component"))
        if turn < LEADERS:
            # A leader has met all of its bucket.
            members = open_.where("node <> leader").select("node", "bucket", "sketch")
    named = distinct.select("_digest", F.col("node").alias("_class"))
    if component is not None:
        named = distinct.join(component.hint("merge"), "node", "left").select("_digest", F.coalesce("component", "node").alias("_class"))
    # Classes are worked out on ids and go to the rows, which stay in their buckets.
    class_of = F.coalesce("_class", "_row").alias("_class")
    small = rows.select("_row", "_digest", "_id").join(named.hint("merge"), "_digest", "left").select("_row", "_id", class_of)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    heads = small.groupBy("_class").agg(first.alias("first"))
    decided = small.join(heads.hint("merge"), "_class").select("_row", F.col("first.id").alias("_head"), (F.col("first.row") == F.col("_row")).alias("_stays"))
    found = all_rows.join(written(decided, scratch(spark, "decided")), "_row")
    return plain.back(found, class_id=F.col("_head"), stays=F.col("_stays"))
