"""Toxic spans by a linear-chain conditional random field over words.

Labels are per document. They give labelled tokens first: a word of a toxic document is tagged if
the word, or the longest beginning of it seen often enough, is significantly more frequent
in toxic documents than in others. On a bounded sample of these tokens, from anywhere in texts of any length, the field is fitted: two
states, a weight per hashed word feature, and the weights of the transitions. Forward-backward marginals then give each word a probability, whole
texts give a document's score, and words above one half give the offending offsets.

A chain is a run of up to `CHAIN` words; a longer text is several chains.
"""

import dataclasses
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _hashes, _mixed
from .shared import Plain, Words, scratch, slices, spread_out, written

CHAIN = 64
FEATURES = 1 << 16
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
LENGTHS = (3, 4, 5, 6, 7)


def find_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, its beginnings and its end; a begin mark keeps them apart from whole words."""
    return [word, *("^" + word[:n] for n in LENGTHS if len(word) >= n), word[-3:] + "$"]


@dataclasses.dataclass
class Field:
    """The fitted field: emission weights for the toxic state, transitions, and the document's logistic."""

    weights: np.ndarray
    bias: float
    stay: np.ndarray  # log weights [from, to]
    document: np.ndarray  # weights of 1, the highest word logit, log(1 + expected toxic words)

    def emissions(self, words: list[str]) -> np.ndarray:
        """The toxic state's log weight for each word; the other state's is 0."""
        if not words:
            return np.zeros(0)
        out = []
        for i in range(0, len(words), 20_000):  # a little at a time, for the sake of memory
            rows = [features(w) for w in words[i : i + 20_000]]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            out.append(np.bincount(owner, self.weights[_slots([f for r in rows for f in r])], len(rows)))
        return self.bias + np.concatenate(out)


def _slots(names: list[str]) -> np.ndarray:
    return (_hashes(names) % np.uint64(FEATURES)).astype(np.int64)


def marginals(scores: np.ndarray, real: np.ndarray, stay: np.ndarray):
    """(log Z, p): per chain and per place the probability of the toxic state.

    `scores` [chains, places] are emissions; `real` marks places that exist, at each
    chain's beginning.
    """
    n, length = scores.shape
    t = np.exp(stay)
    peak = np.maximum(scores, 0)
    on, off = np.exp(scores - peak), np.exp(-peak)
    forward = np.zeros((length, 2, n))
    log_z = np.zeros(n)
    for i in range(length):
        if i:
            a0, a1 = forward[i - 1]
            b0, b1 = (a0 * t[0, 0] + a1 * t[1, 0]) * off[:, i], (a0 * t[0, 1] + a1 * t[1, 1]) * on[:, i]
        else:
            b0, b1 = off[:, 0].copy(), on[:, 0].copy()
        total = b0 + b1
        if i:
            there = real[:, i]
            b0, b1 = np.where(there, b0 / total, a0), np.where(there, b1 / total, a1)
            log_z += np.where(there, np.log(total) + peak[:, i], 0)
        else:
            b0, b1 = b0 / total, b1 / total
            log_z += np.where(real[:, 0], np.log(total) + peak[:, 0], 0)
        forward[i] = b0, b1
    p = np.zeros((n, length))
    back = np.ones((2, n))
    pairs = np.zeros((2, 2))
    for i in range(length - 1, -1, -1):
        a0, a1 = forward[i] * back
        p[:, i] = np.where(real[:, i], a1 / (a0 + a1), 0)
        if i:
            there = real[:, i]
            c0, c1 = back[0] * off[:, i], back[1] * on[:, i]
            f0, f1 = forward[i - 1]
            joint = np.array([[f0 * t[0, 0] * c0, f0 * t[0, 1] * c1], [f1 * t[1, 0] * c0, f1 * t[1, 1] * c1]])
            joint /= joint.sum(axis=(0, 1))
            pairs += joint[:, :, there].sum(axis=2)
            d0, d1 = t[0, 0] * c0 + t[0, 1] * c1, t[1, 0] * c0 + t[1, 1] * c1
            scale = np.maximum(d0, d1)
            back = np.where(there, np.array([d0 / scale, d1 / scale]), back)
    return log_z, p, pairs


def in_chains(values: np.ndarray, ends: np.ndarray, fill=0):
    """Values of documents (ends: where each begins and ends) as rows of up to CHAIN places.

    (matrix, real, place): `place` is each value's place in the flattened matrix.
    """
    sizes = np.diff(ends)
    chains = -(-sizes // CHAIN)
    first = np.cumsum(chains) - chains
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = first[owner] * CHAIN + np.arange(len(values)) - ends[owner]
    matrix = np.full(int(chains.sum()) * CHAIN, fill, values.dtype)
    real = np.zeros(len(matrix), bool)
    matrix[place], real[place] = values, True
    return matrix.reshape(-1, CHAIN), real.reshape(-1, CHAIN), place


def word_probabilities(field: Field, texts: pa.Array):
    """(p, ends): each word's probability of being toxic, text by text."""
    words = Words(find_words)
    codes, ends = words.codes(texts)
    if not len(codes):
        return np.zeros(0), ends
    scores = field.emissions(list(words.index))[codes]
    matrix, real, place = in_chains(scores, ends)
    p = np.empty(matrix.size)
    for i in range(0, len(matrix), 4096):
        p[i * CHAIN : (i + 4096) * CHAIN] = marginals(matrix[i : i + 4096], real[i : i + 4096], field.stay)[1].ravel()
    return p[place], ends


def document_features(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document: 1, the highest word logit, log(1 + expected number of toxic words)."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(np.bincount(owner, p, n))], axis=1)


def document_scores(field: Field, p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(document_features(p, ends) @ field.document, -30, 30)))


# Fitting


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col, text_col, label_col) -> DataFrame:
    """(id, text, toxic): of each class, at most `most` labelled documents that `docs` holds, by hash of their id."""
    chosen = None
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    marks = marks.groupBy(F.col(id_col).alias("_lid")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.join(docs.select(F.col(id_col).alias("_id")), F.col("_lid") == F.col("_id"), "left_semi")
    for value in (0, 1):
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("_lid"), "_lid").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("_id"), text)
    return rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select(F.col("_id").alias("id"), "text", "toxic")


def without_copies(texts: list[list[str]], sketch: int = 12, shared: int = 4) -> list[int]:
    """Places of texts that are no near copies of earlier ones.

    A text's sketch is the smallest hashes of its runs of three words; fewer than `shared` may agree.
    """
    holders, kept = {}, []
    for i, words in enumerate(texts):
        runs = _hashes(words)
        if len(runs) > 2:
            runs = _mixed(_mixed(runs[:-2], runs[1:-1]), runs[2:])
        low = np.unique(runs)[:sketch].tolist()
        met = {}
        for h in low:
            for j in holders.get(h, ()):
                met[j] = met.get(j, 0) + 1
        if max(met.values(), default=0) < min(shared, max(1, len(low))):
            kept.append(i)
            for h in low:
                holders.setdefault(h, []).append(i)
    return kept


def marked_words(texts: list[str], toxic: list[int], enough: int = 6, odds: float = 8.0, significant: float = 25.0) -> set[str]:
    """Words that mark toxic texts.

    A word is judged by itself if `enough` texts hold it, else by its longest beginning that `enough`
    hold. It marks if it is `odds` times as frequent among toxic texts as among others, with a
    log-likelihood ratio of `significant` or more, and `odds` times as frequent among their chains, since longer
    texts hold more of all words. Near copies of a text count once.
    """
    lists = [find_words(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in lists for w in x}))}
    rows = [features(w)[:-1] for w in vocabulary]
    sizes = np.array([len(r) for r in rows], np.int64)
    starts, named = np.cumsum(sizes) - sizes, _hashes([f for r in rows for f in r])
    del rows
    met, total, met_chains, chains = ([], []), [0, 0], ([], []), [0, 0]
    for i in without_copies(lists):
        y = int(toxic[i])
        codes = np.array([vocabulary[w] for w in lists[i]], np.int64)
        parts = [np.unique(codes[j : j + CHAIN]) for j in range(0, len(codes), CHAIN)]
        parts = [np.unique(named[spread_out(starts[u], sizes[u])]) for u in parts]
        total[y] += 1
        chains[y] += len(parts)
        met[y].append(np.unique(np.concatenate([named[:0], *parts])))
        met_chains[y].extend(parts)
    if not all(chains):
        return set()
    counts = [np.unique(np.concatenate(x), return_counts=True) for x in met]
    chain_counts = [np.unique(np.concatenate(x), return_counts=True) for x in met_chains]
    del met, met_chains

    def held(counts, y, hashes):
        names, n = counts[y]
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        return np.where(names[at] == hashes, n[at], 0) if len(names) else np.zeros(len(hashes), int)

    words = sorted({w for x, y in zip(lists, toxic) if y for w in x})
    out = set()
    for start in range(0, len(words), 20_000):
        some = words[start : start + 20_000]
        tried = [[w, *reversed(features(w)[1:-1])] for w in some]
        hashes = _hashes([f for x in tried for f in x])
        owner = np.repeat(np.arange(len(some)), [len(x) for x in tried])
        a, b = held(counts, 1, hashes), held(counts, 0, hashes)
        usual = np.flatnonzero(a + b >= enough)
        _, first = np.unique(owner[usual], return_index=True)
        judged = usual[first]  # of each word, the longest that enough texts hold
        a, b = a[judged].astype(float), b[judged].astype(float)
        a_chains, b_chains = held(chain_counts, 1, hashes[judged]), held(chain_counts, 0, hashes[judged])
        share = (a + b) / sum(total)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (share * total[1])), 0) + np.where(b > 0, b * np.log(b / (share * total[0])), 0))
        marks = ((a + 0.5) / total[1] >= odds * (b + 0.5) / total[0]) & (ratio >= significant)
        marks &= (a_chains + 0.5) / chains[1] >= odds * (b_chains + 0.5) / chains[0]
        out |= {some[i] for i in owner[judged[marks]]}
    return out


def fit(sample: list[tuple[str, int]], epochs: int = 40, most_chains: int = 6000, seed: int = 1) -> Field:
    """A field from (text, toxic) rows, without the document's logistic (see `fit_documents`).

    Without toxic or without other texts, no word has a weight and every score is near 0.
    """
    weights, bias, stay = np.zeros(FEATURES), -4.0, np.log(np.array([[0.95, 0.05], [0.9, 0.1]]))
    texts, toxic = [t for t, _ in sample], [y for _, y in sample]
    marks = marked_words(texts, toxic)
    if not marks:
        return Field(weights, bias, stay, np.array([-6.0, 0.0, 0.0]))
    words = Words(find_words)
    codes, ends = words.codes(pa.array(texts, pa.string()))
    vocabulary = list(words.index)
    marked = np.array([w in marks for w in vocabulary], bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    tags = marked[codes] & np.array(toxic, bool)[owner]
    chained, real, _ = in_chains(codes.astype(np.int64), ends)
    tagged = in_chains(tags, ends, False)[0]
    # Chains with a tagged word, and as many again without.
    rng = np.random.default_rng(seed)
    with_tag = rng.permutation(np.flatnonzero(tagged.any(axis=1)))[: most_chains // 2]
    without = rng.permutation(np.flatnonzero(~tagged.any(axis=1)))[: most_chains // 2]
    rows = np.sort(np.concatenate([with_tag, without]))
    chained, real, tagged = chained[rows], real[rows], tagged[rows]
    used, compact = np.unique(chained, return_inverse=True)
    compact = compact.reshape(chained.shape)
    lists = [features(vocabulary[w]) for w in used]
    of_word = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    slots = _slots([f for x in lists for f in x])
    seen = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(seen, (tagged[:, :-1][both].astype(int), tagged[:, 1:][both].astype(int)), 1)
    n = real.sum()
    g_weights, g_bias, g_stay = np.zeros(FEATURES), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(epochs):  # AdaGrad on the log likelihood
        emission = bias + np.bincount(of_word, weights[slots], len(lists))
        _, p, pairs = marginals(emission[compact], real, stay)
        error = np.bincount(compact[real], (tagged - p)[real], len(lists))
        grad = np.bincount(slots, error[of_word], FEATURES) - 0.01 * weights
        grad_bias, grad_stay = error.sum(), seen - pairs
        g_weights += grad**2
        g_bias += grad_bias**2
        g_stay += grad_stay**2
        weights += 0.5 * grad / np.sqrt(g_weights + 1e-8)
        bias += 0.5 * grad_bias / np.sqrt(g_bias)
        stay = stay + 0.2 * grad_stay / np.sqrt(g_stay)
    return Field(weights, float(bias), stay, np.zeros(3))


def fit_documents(field: Field, x: np.ndarray, y: np.ndarray, share: float) -> None:
    """Fit the document's logistic to `document_features` of whole texts; `share` of all labelled texts are toxic."""
    if field.weights.any() and 0 < y.mean() < 1:
        field.document = logistic(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))


def level(lengths: list[int], budget: int) -> int:
    """The most characters each text may give, so that all together give `budget` at most."""
    left, rest = budget, len(lengths)
    for n in sorted(lengths):
        if n * rest > left:
            return left // rest
        left, rest = left - n, rest - 1
    return max(lengths, default=0)


def excerpt(text: str, most: int, seed: int) -> str:
    """`text`, or if it is longer than `most` characters, chains from anywhere in it, in their order."""
    if len(text) <= most:
        return text
    starts = [m.start() for i, m in enumerate(WORD.finditer(text)) if i % CHAIN == 0]
    sizes = np.diff([*starts, len(text)])
    order = np.random.default_rng(seed % 2**32).permutation(len(starts))
    chosen, left = [], most
    for i in order.tolist():
        if sizes[i] < left:
            chosen.append(i)
            left -= int(sizes[i]) + 1
    if not chosen and starts:  # every chain is longer than that
        return text[starts[order[0]] :][:most]
    return "\n".join(text[starts[i] : starts[i] + sizes[i]] for i in sorted(chosen))


def logistic(x: np.ndarray, y: np.ndarray, of_row: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; `of_row` weighs the rows."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (of_row * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (of_row * (y - p)) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, id_col="doc_id", text_col="text", label_col="toxic", most_chars: int = 4_000_000) -> Field:
    """Fit on a sample of `labels`: at most `most` documents of each class, whatever their length.

    One task fits the words' weights, on `most_chars` characters at most: half of them for each class, or more
    if the other needs less. If a class has more, its longest texts give chains from anywhere in them. The
    document's logistic is fitted to whole texts.
    """
    sample = labelled_sample(docs, labels, most, id_col, text_col, label_col)
    sample = written(sample, scratch(docs.sparkSession, "labelled"))
    lengths = {0: [], 1: []}
    for row in sample.select("toxic", F.length("text").alias("n")).collect():
        lengths[row["toxic"]].append(row["n"])
    levels = {y: level(lengths[y], max(most_chars // 2, most_chars - sum(lengths[1 - y]))) for y in (0, 1)}
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).agg(F.avg(label_col).alias("share")).first()

    def excerpts(texts: pa.Array, toxic: pa.Array, seeds: pa.Array) -> pa.Array:
        found = zip(texts, toxic.to_pylist(), seeds.to_pylist())
        return pa.array([excerpt(text.as_py(), levels[y], seed) for text, y, seed in found], pa.string())

    def fitted(batches):
        found = sorted((r["id"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        field = fit([(text, toxic) for _, text, toxic in found])
        yield pa.record_batch([pa.array([pickle.dumps(field)])], ["field"])

    rows = sample.select("id", F.arrow_udf(excerpts, "string")("text", "toxic", F.xxhash64("id")).alias("text"), "toxic")
    # The excerpts are bounded, so one task holds them; the driver only gets the field.
    found = rows.repartition(1).mapInArrow(fitted, "field binary").first()
    field = pickle.loads(found["field"]) if found else fit([])
    if field.weights.any():
        def whole(texts: pa.Array) -> pa.Array:
            parts = slices(pa.record_batch([texts], ["text"]), "text", 2 << 20)
            x = [document_features(*word_probabilities(field, part.column(0))) for part in parts]
            return pa.array(np.concatenate([np.zeros((0, 3)), *x]).tolist(), pa.list_(pa.float64()))

        read = sample.select("id", "toxic", F.arrow_udf(whole, "array<double>")("text").alias("x")).collect()
        read = sorted((r["id"], r["toxic"], r["x"]) for r in read)
        fit_documents(field, np.array([x for _, _, x in read]), np.array([y for _, y, _ in read], float), marks["share"])
    return field


def score_documents(docs: DataFrame, field: Field, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    """`docs` with toxicity, a struct of score, predicted and spans (start, end, score).

    Spans are runs of words whose probability is one half or more, as offsets in
    code points of the whole text. Null and empty texts have no words and the score of
    a text without toxic words.
    """
    known = docs.sparkSession.sparkContext.broadcast(field)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = "struct<score:double,predicted:int,spans:array<struct<start:int,end:int,score:double>>>"

    def toxicity(texts: pa.Array) -> pa.Array:
        scores, spans = [np.zeros(0)], []
        for part in slices(pa.record_batch([texts], ["text"]), "text", 2 << 20):
            p, ends = word_probabilities(known.value, part.column(0))
            scores.append(document_scores(known.value, p, ends))
            owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
            found = [[] for _ in range(part.num_rows)]
            for i in np.unique(owner[p >= 0.5]).tolist():
                found[i] = text_spans(part.column(0)[i].as_py(), p[ends[i] : ends[i + 1]])
            spans += found
        score = np.concatenate(scores)
        columns = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, pa.list_(span))]
        return pa.StructArray.from_arrays(columns, ["score", "predicted", "spans"])

    plain = Plain(docs, id_col, text_col)
    return plain.back(plain.rows, toxicity=F.arrow_udf(toxicity, schema)(F.coalesce("_text", F.lit(""))))


def text_spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of toxic words with their offsets in `text` and highest probability."""
    out, last = [], None
    for i, match in enumerate(WORD.finditer(text)):
        if i < len(p) and p[i] >= 0.5:
            if out and last == i - 1:
                out[-1]["end"], out[-1]["score"] = match.end(), max(out[-1]["score"], float(p[i]))
            else:
                out.append({"start": match.start(), "end": match.end(), "score": float(p[i])})
            last = i
    return out
