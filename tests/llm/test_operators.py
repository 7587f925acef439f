"""The training-data operators against brute force, and on rows that are not clean."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitescan.llm import byte_bpe, chat_format, dart_minhash, decontaminate, exact_topk, licenses, quality, token_counts, token_files, toxicity
from sitescan.llm.shared import Codebook, pieces, scratch

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# Null, empty, blank, repeated rows, a special token, white space of all kinds, and a very long text.
TEXTS = [
    None, "", " ", "\n \n", "a", "a", "two words", " two words ", "tab\t then  spaces  and  more \n\n end",
    "x <|endoftext|> y<|endoftext|>", "it's 'quoted' isn't", "été Ünïcode 漢字 😀 é", "</s><s>[INST]", "word " * 30_000,
]


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(i, t, "src", "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "src", "clash"), (4, "a", "src", "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxicity string, class_id string").repartition(3)


@pytest.fixture(scope="module")
def none(dirty):
    return dirty.where("false")


def prose(n, seed, size=60):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra st lo mi ven tor sal".split()]
    return [" ".join(rng.choice(words, size)) for _ in range(n)]


def test_pieces_restore_the_text():
    codes, ends, heads, tails = pieces(pa.array(TEXTS, pa.string()))
    every = heads + [" " + t for t in tails]
    assert ["".join(every[c] for c in codes[a:b]) for a, b in zip(ends, ends[1:])] == [t or "" for t in TEXTS]


def test_codebook_forgets_without_harm():
    whole, small = token_files.tokenizer(BYTE), token_files.tokenizer(BYTE)
    small = Codebook(whole.heads, whole.tails, limit=5)
    texts = pa.array(prose(20, 1))
    for got, want in zip(small.encode_texts(texts), whole.encode_texts(texts)):
        assert np.array_equal(got, want)


def recording(book, limit, marks=""):
    """A codebook like `book` that notes which pieces it has encoded."""
    noted = []

    def note(encode):
        return lambda pieces: noted.extend(pieces) or encode(pieces)

    return Codebook(note(book.heads), note(book.tails), limit, marks), noted


def test_codebook_keeps_the_pieces_used_most():
    book, noted = recording(token_files.tokenizer(BYTE), 20)
    for i in range(20):
        book.encode_texts(pa.array(["often used words " + " ".join(f"w{i}x{j}" for j in range(6))]))
    assert len(noted) > 100 and all(noted.count(t) == 1 for t in ("often", "used", "words"))
    assert len(book.index) <= 20


def test_words_before_marks_are_encoded_once():
    whole = token_files.tokenizer(BYTE)
    book, noted = recording(whole, 400_000, whole.marks)
    book.encode_texts(pa.array(["x word word. word, word?! Straße Straße: word\nend word.\nend word;\nend"]))
    assert noted.count("word") == noted.count("Straße") == 1 and "word." not in noted
    assert not {"'", "<", "|", ">"} & set(whole.marks)


def test_codebook_equals_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTE), np.random.default_rng(4)
    bits = ["a", "Word", "ß", "é", "e\u0301", "漢", "가", "й", "7", "½", "ª", "'s", "'", ".", ",", "-", "_", "!?", "…", "\n", "\t", "\u00a0", "😀", "\U0001df25"]
    bits += ["<|endoftext|>", "<|", "|>", " ", " ", " ", "  "]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(3000)]
    texts += [b + m + a for b in bits for m in bits for a in bits]
    whole = token_files.tokenizer(BYTE)
    for limit in (50, 400_000):
        book = Codebook(whole.heads, whole.tails, limit, whole.marks)
        for some in ([], [""], ["a"], ["a b"], [None, "x."], texts[:1000], texts):
            ids, ends = book.encode_texts(pa.array(some, pa.string()))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


# 1


def brute_top(rows, k):
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_exact_topk(spark, monkeypatch, scale):
    monkeypatch.setattr(exact_topk, "SHARD", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1) * scale]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (None, [1.0] * 4), (260, [1.0, 2.0]), (261, [2.0, 1.0])]
    rows += [(300 + i, rows[0][1]) for i in range(50)]  # ties
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = exact_topk.top_k(table, F.col("vec_id") % 20 == 0, 7)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)
    assert exact_topk.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_grow_with_the_queries_not_the_partitions(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(50)
    asking = table.where("id % 20 = 0")
    assert exact_topk.pack(asking.repartition(1), exact_topk.QUERY_BLOCK).count() == 1
    packed = exact_topk.pack(table.coalesce(1), 64).collect()
    assert [len(r["ids"]) // 8 for r in packed] == [64] * 6 + [16] and {r["task"] for r in packed} == {0}


# 2


def test_resampling_keeps_good_text_and_leaves_bad(spark, dirty):
    good, bad = prose(300, 1), [" ".join(w + "###" for w in t.split()) for t in prose(60, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 360, 2)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.resample(docs, labels).where("sampled").collect()}
    assert kept == set(range(300))
    assert quality.resample(docs, labels, k=25).where("sampled").count() == 25
    assert quality.resample(dirty, labels).count() == dirty.count()
    assert quality.resample(dirty.where("false"), labels).count() == 0
    assert quality.resample(docs, labels.where("false")).where("sampled").count() == 360


def test_log_weight_is_the_sum_of_the_ratios(spark):
    texts = prose(30, 5)
    buckets, owner = quality.ngram_buckets(pa.array(texts))
    raw, target = (np.bincount(buckets[owner < n], minlength=quality.BUCKETS) for n in (30, 10))
    docs = spark.createDataFrame([(i, t, i < 10) for i, t in enumerate(texts)], "i int, text string, good boolean")
    assert all(np.array_equal(a, b) for a, b in zip(quality.count_ngrams(docs.select("text", "good")), (raw, target)))


def test_log_weights_against_brute_force(spark):
    texts = prose(30, 5) + ["", None, "one", "again again again"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    target = {r["_lid"] for r in quality.labelled(labels, 99, "doc_id", "quality").where("NOT held_out").collect()}
    buckets, owner = quality.ngram_buckets(pa.array([t or "" for t in texts]))
    raw = np.bincount(buckets, minlength=quality.BUCKETS)
    good = np.bincount(buckets[np.isin(owner, list(target))], minlength=quality.BUCKETS)
    ratio = np.log(good + 20.0) - np.log(raw * (good.sum() / raw.sum()) + 20.0)
    got = {r["doc_id"]: (r["log_weight"], r["n_grams"]) for r in quality.weigh(docs, labels).collect()}
    for i in range(len(texts)):
        assert abs(got[i][0] - ratio[buckets[owner == i]].sum()) < 1e-9 and got[i][1] == (owner == i).sum()
    assert 0 < len(target) < 20 and got[30] == got[31] == (0.0, 0)


def test_draws_follow_the_weights(spark):
    """Of many draws of one row each is drawn as often as its importance says; larger draws follow successive sampling."""
    scaled = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]
    rows = [(i, s, x * 2.0, 4, "clash") for s in range(1500) for i, x in enumerate(scaled)]
    table = spark.createDataFrame(rows, "i int, s int, log_weight double, n_grams bigint, drawn string")
    # One table per seed: the noise is from a hash of seed and key, as in `draw`.
    best = table.withColumn("key", F.col("log_weight") / F.sqrt("n_grams") + quality.gumbel(7, F.lit("draw"), "s", "i"))
    top = best.groupBy("s").agg(F.max_by("i", "key").alias("i")).groupBy("i").count().collect()
    want = np.exp(scaled) / np.exp(scaled).sum()
    assert np.abs(np.array([dict(map(tuple, top)).get(i, 0) for i in range(6)]) / 1500 - want).max() < 0.04
    one = table.where("s < 20")
    got = quality.draw(one, 30, keys=("s", "i"))
    assert got.columns == ["i", "s", "log_weight", "n_grams", "draw_key", "drawn"] and got.where("drawn").count() == 30
    kept = {(r["s"], r["i"]) for r in got.where("drawn").collect()}
    keys = {(r["s"], r["i"]): r["draw_key"] for r in got.collect()}
    assert kept == set(sorted(keys, key=keys.get)[-30:])
    # Chance has a say: another seed draws others, and not just the heaviest are drawn.
    other = {(r["s"], r["i"]) for r in quality.draw(one, 30, seed=8, keys=("s", "i")).where("drawn").collect()}
    assert other != kept and {i for _, i in kept} != {5, 4}
    assert quality.draw(one, 0, keys=("s", "i")).where("drawn").count() == 0


def test_results_replace_columns_of_their_name(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(prose(20, 8))] + [(None, "a", "x", "y", "z")], "doc_id bigint, text string, log_weight string, sampled string, gumbel_key string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id bigint, quality int")
    found = quality.resample(docs, labels)
    assert sorted(found.columns) == sorted(["doc_id", "text", "log_weight", "n_grams", "gumbel_key", "sampled"])
    assert found.count() == 21 and dict(found.dtypes)["sampled"] == "boolean"


@pytest.mark.parametrize("k", [1, 7, 150, 300, 999])
def test_kth_largest(spark, k):
    values = [float(x) for x in np.random.default_rng(2).normal(size=200).round(1)] + [3.0] * 100
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(table, k, bins=8, few=5) == sorted(values, reverse=True)[min(k, 300) - 1]


# 3


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 400).astype(np.uint64)
    weights = rng.uniform(0.2, 5, 400)
    other = np.where(np.arange(400) < 150, weights * 1.8, weights)
    found = dart_minhash.dart_signatures(np.concatenate([a, a]), np.concatenate([weights, other]), np.array([0, 400, 800]), k=2000)
    assert abs((found[0] == found[1]).mean() - weights.sum() / other.sum()) < 0.04


def test_repeats_do_not_empty_signatures():
    shingles = np.random.default_rng(3).integers(0, 2**62, 100).astype(np.uint64)
    every = np.concatenate([np.tile(shingles, 5000), np.tile(shingles, 2), np.repeat(shingles[:1], 5000), shingles[:1]])
    ends = np.cumsum([0, 500_000, 200, 5000, 1])
    found = dart_minhash.dart_signatures(every, np.ones(len(every)), ends)
    assert (found != dart_minhash.EMPTY).all()
    assert (found[0] == found[1]).all() and (found[2] == found[3]).all()


def test_repetitive_texts_are_near_duplicates(spark):
    passage = " ".join(f"w{i}" for i in range(100)) + " "
    texts = [passage * 5000, passage * 2, "same " * 6000, "same " * 9, *prose(3, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(docs).select("doc_id", "class_id").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def classes(texts):
    import regex

    def shingles(t):
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    texts = prose(40, 7, 80)
    for base in texts[:6]:
        for edits in (0, 1, 1, 2, 2, 3, 4, 5):
            words = base.split()
            for at in rng.choice(80, edits, replace=False):
                words[at] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", "short text", "short text", "Short, text!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in dart_minhash.near_duplicates(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == classes(texts)
    assert all(r["stays"] == (r["class_id"] == i) for i, r in got.items())


def test_near_duplicates_spare_the_driver(spark, monkeypatch):
    """Joins of ids are not broadcast, and components are worked out only in turns that find links."""
    words = prose(1, 8, 80)[0].split()
    copies = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(1, 80, 13)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words), *copies, *prose(5, 9, 80)])), "doc_id bigint, text string")
    plans, runs, original, components = [], [], dart_minhash.written, dart_minhash.components

    def kept(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, *args)

    monkeypatch.setattr(dart_minhash, "written", kept)
    monkeypatch.setattr(dart_minhash, "components", lambda edges: runs.append(1) or components(edges))
    got = [r["class_id"] for r in dart_minhash.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == [0] * 8 + [8, 9, 10, 11, 12] and len(runs) == 1
    # Only ids that go to texts may be: three joins a turn.
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 3 * len(runs)


def test_near_duplicates_of_dirty_rows(dirty, none):
    rows = dart_minhash.near_duplicates(dirty)
    assert rows.columns == ["doc_id", "text", "toxicity", "class_id", "stays"] and rows.count() == dirty.count()
    assert rows.where("stays AND text = 'a'").count() == 1
    assert dart_minhash.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 40), (60, 50), (60, 70)]
    got = {r["node"]: r["component"] for r in dart_minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got.get(i, i) for i in range(31)} == {0} and {got.get(i, i) for i in (40, 50, 60, 70)} == {40}


@pytest.mark.parametrize("block", [4, 256])
def test_all_links_between_components_and_none_within(spark, monkeypatch, block):
    monkeypatch.setattr(dart_minhash, "BLOCK", block)
    base = prose(1, 71, 120)[0].split()
    rng = np.random.default_rng(5)
    # Chains of ever more changed copies: components of 30 and of a few members, in one bucket and in another.
    rows, texts = [], []
    for node in range(44):
        words = list(base)
        for at in rng.choice(120, node % 6, replace=False):
            words[at] = f"n{node}x{at}"
        texts.append((node, " ".join(words)))
        rows += [(7, node, 0 if node < 30 else node // 3)] + ([(8, node, node // 10)] if node % 2 else [])
    members = spark.createDataFrame(rows, "bucket bigint, node bigint, component bigint")
    table = spark.createDataFrame(texts, "node bigint, text string")
    got = {tuple(r) for r in dart_minhash._all_links(members, table, 0.8).collect()}
    sets = {}
    for node, text in texts:
        words = text.split()
        sets[node] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    want = {
        (max(a, b), min(a, b)) for x, a, c in rows for y, b, d in rows
        if x == y and a < b and c != d and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert got == want and len(want) > 20


# 4


def test_marginals_are_those_of_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    scores, stay = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    real = np.array([[True] * 4 + [False]])
    weight = {}
    for path in itertools.product((0, 1), repeat=4):
        weight[path] = np.exp(sum(scores[0, i] * y for i, y in enumerate(path)) + sum(stay[a, b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    log_z, p, _ = toxicity.marginals(scores, real, stay)
    assert np.isclose(log_z[0], np.log(total))
    assert np.allclose(p[0], [sum(w for y, w in weight.items() if y[i]) / total for i in range(4)] + [0])


def test_toxicity_finds_unseen_texts_and_their_words(spark, dirty):
    rng = np.random.default_rng(6)
    texts, toxic = prose(400, 11), [int(i % 4 == 0) for i in range(400)]
    stems = ["vile", "scumm", "rottenish"]
    for i in range(0, 400, 4):
        words = texts[i].split()
        words[rng.integers(60)] = str(rng.choice(stems)) + str(rng.choice(["", "ra", "st"]))
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i < 300], "doc_id bigint, toxic int")
    field = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, field).where("doc_id >= 300").collect()
    assert all(r["toxicity"]["predicted"] == toxic[r["doc_id"]] for r in got)
    for r in got:
        for span in r["toxicity"]["spans"]:
            assert any(s in r["text"][span["start"] : span["end"]] for s in stems)
    rows = toxicity.score_documents(dirty, field)
    assert rows.count() == dirty.count() and rows.where("toxicity.score BETWEEN 0 AND 1").count() == dirty.count()
    assert toxicity.score_documents(dirty.where("false"), field).count() == 0
    empty = toxicity.train(docs, labels.where("false"))
    assert toxicity.score_documents(docs, empty).where("toxicity.predicted = 1").count() == 0


def long_and_toxic():
    """(docs, toxic): toxic texts of more than 4,000 characters with three bad words each, others long and short."""
    rng = np.random.default_rng(9)
    texts = [*prose(120, 41, 1000), *prose(60, 42, 1000), *prose(220, 43, 60)]
    for i in range(120):
        words = texts[i].split()
        for at in rng.choice(1000, 3, replace=False):
            words[at] = str(rng.choice(["vile", "scumm"])) + str(rng.choice(["", "ra", "st"]))
        texts[i] = " ".join(words)
    assert min(map(len, texts[:120])) > 4000
    return texts, [int(i < 120) for i in range(400)]


@pytest.mark.parametrize("most_chars", [4_000_000, 400_000])
def test_toxicity_of_long_texts(spark, most_chars):
    texts, toxic = long_and_toxic()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    learned = [(i, y) for i, y in enumerate(toxic) if i % 4] + [(10_000 + i, 1) for i in range(3000)]
    field = toxicity.train(docs, spark.createDataFrame(learned, "doc_id bigint, toxic int"), most_chars=most_chars)
    got = toxicity.score_documents(docs, field).where("doc_id % 4 = 0").collect()
    assert [r["doc_id"] for r in got if r["toxicity"]["predicted"] != toxic[r["doc_id"]]] == []
    for r in got:
        for span in r["toxicity"]["spans"]:
            assert any(w in r["text"][span["start"] : span["end"]] for w in ("vile", "scumm"))


def test_excerpts_come_from_anywhere_and_keep_the_budget():
    text = " ".join(f"w{i}" for i in range(10_000))
    cut = toxicity.excerpt(text, 3000, 5)
    places = [int(w[1:]) for w in cut.split()]
    assert 2000 < len(cut) <= 3000 and places == sorted(places) and places[-1] - places[0] > 3000
    assert toxicity.excerpt(text, len(text), 5) == text and len(toxicity.excerpt("x" * 9000, 100, 1)) == 100
    assert toxicity.level([10, 10, 1000], 120) == 100 and toxicity.level([10, 20], 100) == 20 and toxicity.level([], 9) == 0


# 5


def test_leaks_despite_replaced_words(spark, dirty, none):
    items = prose(5, 21, 40)
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(9, None), (None, items[0]), (10, "too short")], "item_id bigint, text string")
    clean, docs = prose(30, 22, 100), []
    for i, text in enumerate(clean):
        words, item = text.split(), items[i % 5].split()
        if i < 10:
            item[7], item[23] = "other", "words"
        docs.append((i, " ".join(words[:50] + item + words[50:]) if i < 20 else text))
    docs += [(100, None), (101, ""), (None, items[2])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontaminate.find_leaks(table, benchmark)
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert pairs == {(i, i % 5) for i in range(20)} | {(None, 2)}
    left = decontaminate.drop_leaks(table, benchmark)
    assert {r["doc_id"] for r in left.collect()} == set(range(20, 30)) | {100, 101}
    assert decontaminate.drop_leaks(dirty, benchmark).columns == dirty.columns
    assert decontaminate.drop_leaks(dirty, benchmark).count() == dirty.count()
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(table, benchmark.where("false")).count() == 0


@pytest.mark.parametrize("n", range(10, 21))
def test_every_way_to_replace_a_fifth_leaves_a_seed(n):
    places = [{s + o for o in m} for m in decontaminate.MASKS for s in range(n - m[-1])]
    for gone in itertools.combinations(range(n), n - -(-n * 4 // 5)):
        assert any(not p & set(gone) for p in places), gone


def test_short_items_and_replaced_ends(spark):
    ten, nine, five, four = ([f"{c}{i}" for i in range(n)] for c, n in (("t", 10), ("n", 9), ("f", 5), ("r", 4)))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((ten, nine, five, four))], "item_id bigint, text string")
    change = lambda w, *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    texts = [change(ten, 0), change(ten, 0, 9), change(ten, 3, 6), change(ten, 1, 4, 7), change(nine), change(nine, 4), change(five), change(five, 2), change(four)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["shift"], r["n_words"] - r["n_equal"]) for r in found) == [
        (0, 0, 1, 1), (1, 0, 1, 2), (2, 0, 1, 2), (4, 1, 1, 0), (6, 2, 1, 0)
    ]
    # Bare texts, with the passage at both ends
    bare = spark.createDataFrame([(0, change(ten, 0, 9)), (1, change(five))], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(bare, items).collect()} == {(0, 0), (1, 2)}


def test_no_text_travels_with_the_seeds(spark, tmp_path):
    """A benchmark too large to be broadcast: only hashes, ids and places go through the shuffle of seeds."""
    items = prose(3000, 51, 20)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"{t} {items[i * 7]}") for i, t in enumerate(prose(40, 52, 400))], "doc_id bigint, text string")
    plans = []
    original = decontaminate.written

    def kept(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, *args)

    decontaminate.written, plain = kept, decontaminate.broadcast_if_small
    decontaminate.broadcast_if_small = lambda df: df
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = decontaminate.find_leaks(docs, benchmark)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(i, i * 7) for i in range(40)}
    finally:
        decontaminate.written, decontaminate.broadcast_if_small = original, plain
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = re.findall(r"SortMergeJoin \[seed.*", plans[0])
    shuffled = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(seed" in line]
    assert side and shuffled
    below = plans[0].split("Exchange hashpartitioning(seed", 1)[1].splitlines()[1]
    assert "doc#" not in below.replace("doc_id#", "") and "text#" not in below


# 6


def test_licenses(spark, dirty):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    # Prose ends without a full stop here: only a blank line ends the paragraph.
    docs = [(i, t) for i, t in enumerate(prose(60, 31))] + [(100 + i, prose(1, i)[0] + "\n\n" + t) for i, t in enumerate(lines)]
    docs += [(200, None), (201, ""), (202, "All rights reserved."), (203, "the driver's license was old")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = licenses.train(table)
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.find_licenses(table, model).where("confirmed").collect()}
    assert got == {(100, 1, "MIT"), (101, 1, "Apache"), (102, 1, "CC-BY-NC")}
    assert licenses.find_licenses(dirty, model).count() == 0
    assert licenses.find_licenses(table.where("false"), model).count() == 0
    twice = table.where("doc_id = 100").unionAll(table.where("doc_id = 100")).withColumn("paragraph", F.lit("clash")).withColumn("tokens", F.lit(1))
    assert licenses.find_licenses(twice, model).count() == 1

    # The probabilities are those of the weights, by hand.
    for r in licenses.find_licenses(table, model).join(table, "doc_id").collect():
        found = re.findall(r"[^\W_]+", re.split(r"\n[ \t\r]*\n", r["text"])[r["paragraph"]].lower())
        terms = found + ([" ".join(x) for x in zip(found, found[1:])] if len(found) > 1 else [f"^ {w}" for w in found])
        logits = np.array(model.bias) + sum((np.array(model.weights[t]) for t in terms if t in model.weights), np.zeros(len(model.bias)))
        shares = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert abs(r["probability"] - shares.max()) < 1e-9 and [licenses.UNKNOWN, *model.by_family][shares.argmax()] == r["family"]


def test_the_licence_model_learns_from_every_paragraph(spark):
    """The document whose id has the highest hash is the last one that a sample by hash would take."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate(prose(420, 51))], "doc_id bigint, text string")
    last = table.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    near = "\n\n".join(["the software was released by the old law"] * 2000)
    changed = table.withColumn("text", F.when(F.col("doc_id") == last, near).otherwise(F.col("text")))
    plain, more = licenses.train(table), licenses.train(changed)
    assert plain.weights != more.weights


NOTICES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "GPL": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "Apache": "Copyright 2020 X. Licensed under the Apache License, Version 2.0. See the LICENSE file for details.",
    "BSD": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:",
}


def test_wrapped_notices_are_confirmed(spark):
    around = prose(80, 41)
    docs = [(i, t) for i, t in enumerate(around)] + [(100 + i, f"{around[i]}.\n\n{t}\n\n{around[i + 9]}") for i, t in enumerate(NOTICES.values())]
    docs += [(200, "Permission to use the software was granted to any person, free of charge.\nAll conditions are met.")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = licenses.find_licenses(table, licenses.train(table)).where("confirmed").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == {(100 + i, 1, f) for i, f in enumerate(NOTICES)}


# 7, 9, 10


def test_pack_and_unpack():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 3], np.uint32)
    for n in range(len(ranks) + 1):
        assert np.array_equal(token_files.unpack(*token_files.pack(ranks[:n]), n), ranks[:n])


def test_token_files(spark, dirty, none):
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(BYTE), [], 0
    place = scratch(spark, "files")
    token_files.write_token_files(dirty, BYTE, place)
    got = sorted(token_files.token_index(spark, place).collect(), key=lambda r: r["start"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in dirty.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    empty = scratch(spark, "files")
    token_files.write_token_files(none, BYTE, empty)
    assert token_files.token_index(spark, empty).count() == 0


def test_token_counts_come_from_the_cache(spark, dirty, none, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    place = scratch(spark, "cache")
    for _ in range(2):
        got = token_counts.count_tokens(dirty, place, PIECE, 4096).collect()
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in dirty.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
        # The second turn adds nothing.
        assert spark.read.parquet(place).count() == len({r["text"] or "" for r in dirty.collect()})
    assert token_counts.count_tokens(none, place, PIECE, 4096).count() == 0


def test_copies_are_encoded_once_with_little_memory(spark, monkeypatch):
    rows = [(i, f"text number {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    batches = [pa.record_batch([pa.array([f"{x:064x}" for x in part])], ["digest"]) for part in ([1, 2, 1], [3, 2], [1, 4])]
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    assert [b.column(0).to_pylist()[0][-1] for b in token_counts._first_of_each(batches) if b.num_rows] == ["1", "3", "1"]
    runs = [pa.record_batch([pa.array(x)], ["digest"]) for x in (["a", "a", "b"], ["b"], ["b", "c"])]
    assert sum((b.column(0).to_pylist() for b in token_counts._first_of_run(runs)), []) == ["a", "b", "c"]
    place = scratch(spark, "cache")
    assert token_counts.count_tokens(docs, place, PIECE, 3).count() == 400
    assert spark.read.parquet(place).count() == 7


def test_byte_bpe(spark, dirty, none, monkeypatch):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(MULTI), special_tokens={})
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(dirty, MULTI, public_tokenizers.PATTERN), MULTI).collect()
    want = [(r["doc_id"], np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in dirty.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows), key=key) == sorted(want, key=key)
    assert byte_bpe.encode_documents(none, MULTI).count() == 0


# 8


def test_chat_format_can_be_read_back(spark):
    part = chat_format.PART
    texts = ["</s>[INST] ok [/INST]", "␛e ␛␛t <|turn|>x<|end|>", "", None, "plain\nlines"]
    turns = [(1, i, "assistant" if i % 2 else "us\ner<|end|>", [("text", t, None, None)]) for i, t in enumerate(texts)]
    turns += [(2, 0, "user", [("text", "see", None, None), ("image", None, "a.png", 2.0), None, ("audio", None, "b.wav", None), ("document", None, None, -1.0)])]
    turns += [(2, None, None, None), (None, 0, "assistant", [("text", "lost", None, None)]), (1, 4, "us\ner<|end|>", [("text", "plain\nlines", None, None)])]
    table = spark.createDataFrame(turns, f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    made = chat_format.format_conversations(table).cache()
    read = chat_format.read_turns(made).orderBy("conv_id", "seq").collect()
    want = [(1, r, t or "") for r, t in [(turns[i][2], texts[i]) for i in (0, 1, 2, 3, 4, 4)]]
    assert [(r["conv_id"], r["role"], r["text"]) for r in read if r["conv_id"] == 1] == want
    assert all(r["masked"] == (r["role"] == "assistant") for r in read)
    two = made.where("conv_id = 2").first()
    assert [(a["type"], a["ref"], a["tokens"]) for a in two["attachments"]] == [("image", "a.png", 340), ("audio", "b.wav", 1), ("document", None, 1)]
    assert two["n_tokens_expanded"] == 342 and "see<|image|><|audio|><|document|>" in two["formatted"]
    assert chat_format.format_conversations(table.where("false")).count() == 0
