"""Language identification with a linear-chain conditional random field over words.

Each word gets scores per language from hashed features, its affixes, its byte n-grams and its
entry in a lexicon of the training words, and learned transition scores join neighbouring words.
Forward-backward gives each word the probability of each language; a document is labelled by the
sum over its words with letters. So text that switches languages is labelled word by word.

A sequence is a whole line, however long.

Training uses a bounded sample of labelled documents, TRAIN_ROWS in all, dealt evenly to the
languages and chosen by a hash of the id. Its sentences are joined to sequences that now and
then switch the language, from which the transitions are learned. The model is two small arrays
whose size depends on the number of languages alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, id_array, ids, map_texts, ragged, rewrite_texts, texts

PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long, second_lang string, second_share double"

#: Labelled documents that training takes at most (about; they are drawn by a hash).
TRAIN_ROWS = 600
#: Words per training sequence, and sequences, at most.
SEQUENCE, SEQUENCES = 48, 4000
#: How often a training sequence may switch its language after a sentence. The learned transitions
#: reflect it: their size is this choice, not a rate observed in the documents.
SWITCH = 0.1
BITS = 15
LEXICON = 20_000
#: Words of a long line that are worked at once, with no effect on the result.
PART = 256
UNKNOWN = "und"
#: Bytes of text labelled at once, which bounds the features held.
SLICE_BYTES = 1 << 20


@dataclass
class Model:
    langs: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    @property
    def empty(self) -> bool:
        return not self.langs


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, number of features of each word) for folded bytes."""
    n, mask = len(start), K.U64((1 << BITS) - 1)
    prefix = K.prefix_hash(K._BYTE[data])
    own, number = [], []

    def add(words: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> None:
        own.append(words)
        number.append((K.mix(K.range_hash(prefix, a, b) + K.U64(kind * K._ODD & K._MASK)) & mask).astype(np.int64))

    every, size = np.arange(n), end - start
    for k in (1, 2, 3, 4):
        some = size >= k
        add(every[some], start[some], start[some] + k, 10 + k)
        add(every[some], end[some] - k, end[some], 20 + k)
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        at = ragged(start, count)
        add(np.repeat(every, count), at, at + k, 30 + k)
    word = K.span_hashes(data, start, end)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, word), len(lexicon) - 1)
        known = lexicon[place] == word
        own.append(every[known])
        number.append((1 << BITS) + place[known])
    owner, numbers = np.concatenate(own), np.concatenate(number)
    order = np.argsort(owner, kind="stable")
    return numbers[order], np.bincount(owner, minlength=n)


def emissions(numbers: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores per language of each word; the features of a word are averaged by the root of their number."""
    sums = np.zeros((len(numbers) + 1, weights.shape[1]))
    np.cumsum(weights[numbers], axis=0, out=sums[1:])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.sqrt(np.maximum(counts, 1))[:, None]


def marginals(scores: np.ndarray, start: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The probability of each language at each word, by forward-backward over all runs at once.

    A run is the words start, ..., start + size - 1; every word is in one run. Runs of more than PART
    words are worked in parts: the products of the parts' transfer matrices say what each part hears
    from those before and after it, so the result is that of the whole run.
    """
    k = scores.shape[1]
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else np.zeros((0, k))
    step = np.exp(transitions)
    parts = -(-size // PART)
    number = ragged(np.zeros(len(size), np.int64), parts)
    last = number + 1 == np.repeat(parts, parts)
    at = np.repeat(start, parts) + number * PART
    length = np.minimum(np.repeat(start + size, parts) - at, PART)
    before, after = np.ones((len(at), k)), np.ones((len(at), k))
    joined = np.flatnonzero(np.repeat(parts, parts) > 1)
    if len(joined):
        moved = _transfer(local, step, at[joined], length[joined], number[joined] == 0)
        place = np.full(len(at), -1)
        place[joined] = np.arange(len(joined))
        for t in range(int(parts.max()) - 1):  # from each part to the next
            own = np.flatnonzero((number == t) & ~last)
            x = np.einsum("ij,ijk->ik", before[own], moved[place[own]])
            before[own + 1] = x / x.sum(axis=1, keepdims=True)
        for t in range(int(parts.max()) - 1, 0, -1):
            own = np.flatnonzero(number == t)
            x = np.einsum("ijk,ik->ij", moved[place[own]], after[own])
            after[own - 1] = x / x.sum(axis=1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    at, length, number, before, after = at[order], length[order], number[order], before[order], after[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), side="left")  # parts of more than t words
    out = np.empty_like(local)
    for t in range(longest):
        here = at[: alive[t]] + t
        if t == 0:
            a = local[here] * np.where(number[:, None] == 0, 1.0, before @ step)
        else:
            a = local[here] * (out[here - 1] @ step)
        out[here] = a / a.sum(axis=1, keepdims=True)
    beta = after
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        if t < longest - 1:
            m = alive[t + 1]
            b = (beta[:m] * local[at[:m] + t + 1]) @ step.T
            beta[:m] = b / b.sum(axis=1, keepdims=True)
        here = at[:n] + t
        both = out[here] * beta[:n]
        out[here] = both / both.sum(axis=1, keepdims=True)
    return out


def _transfer(local: np.ndarray, step: np.ndarray, at: np.ndarray, length: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The product, but for its scale, of step and local scores over each part; `leads` have no step before."""
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(int(length.max())), side="left")
    out = np.where(leads[order, None, None], np.eye(len(step)), step) * local[at[order], None, :]
    for t in range(1, len(alive)):
        n = alive[t]
        x = (out[:n] @ step) * local[at[order[:n]] + t, None, :]
        out[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def fit(rows: list[tuple[str, str]], seed: int = 7, rounds: int = 60, rate: float = 0.35, decay: float = 1e-5) -> Model:
    """A model of (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    if not k:
        return Model([], np.zeros(0, K.U64), np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    words = split(pa.array([x for x, _ in rows], pa.string()))
    label = np.array([langs.index(lang) for _, lang in rows])
    inverse, distinct = K.span_codes(words.data, words.start, words.end)
    data, bounds = K.text_buffer(distinct)
    counts = np.bincount(inverse, minlength=len(distinct))
    frequent = np.argsort(-counts, kind="stable")[:LEXICON]
    frequent = frequent[counts[frequent] > 2]
    lexicon = np.unique(K.span_hashes(data, bounds[:-1][frequent], bounds[1:][frequent]))
    # sentences of about 8 to 24 words, each mostly followed by one of its own language
    rng = np.random.default_rng(seed)
    pools = [np.flatnonzero(np.repeat(label == i, words.counts)) for i in range(k)]
    wanted = min(SEQUENCES, max(64, len(inverse) // SEQUENCE))
    place = np.empty((wanted, SEQUENCE), np.int64)
    truth = np.empty((wanted, SEQUENCE), np.int64)
    for i in range(wanted):
        lang, t = i % k, 0
        while t < SEQUENCE:
            pool, n = pools[lang], int(rng.integers(8, 25))
            if len(pool):
                a = int(rng.integers(0, max(1, len(pool) - n)))
                part = pool[a : a + min(n, SEQUENCE - t)]
                place[i, t : t + len(part)], truth[i, t : t + len(part)] = part, lang
                t += len(part)
            if not len(pool) or rng.random() < SWITCH:
                lang = int(rng.integers(0, k))
            if not any(map(len, pools)):
                return Model([], np.zeros(0, K.U64), np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    word = inverse[place.ravel()]
    used, word = np.unique(word, return_inverse=True)
    numbers, sizes = features(data, bounds[:-1][used], bounds[1:][used], lexicon)
    scale = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    owner = np.repeat(np.arange(len(used)), sizes)
    weights, transitions = np.zeros(((1 << BITS) + len(lexicon), k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (weights, weights, transitions, transitions)]
    start, size = np.arange(wanted) * SEQUENCE, np.full(wanted, SEQUENCE)
    gold = np.eye(k)[truth.ravel()]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    total = wanted * SEQUENCE
    for step in range(1, rounds + 1):
        scores = emissions(numbers, sizes, weights)[word]
        probability = marginals(scores, start, size, transitions)
        by_word = np.stack([np.bincount(word, (probability - gold)[:, j], len(used)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(numbers, by_word[owner, j] * scale, len(weights)) for j in range(k)], axis=1) / total
        expected = expected_pairs(scores.reshape(wanted, SEQUENCE, k), transitions)
        for i, (value, gradient) in enumerate([(weights, by_feature + decay * weights), (transitions, (expected - pairs) / total + decay * transitions)]):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(langs, lexicon, weights.astype(np.float32), transitions)


def expected_pairs(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected numbers of neighbouring languages over sequences of equal length."""
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, n = np.exp(transitions), scores.shape[1]
    alpha = [local[:, 0] / local[:, 0].sum(1, keepdims=True)]
    for t in range(1, n):
        a = local[:, t] * (alpha[-1] @ step)
        alpha.append(a / a.sum(1, keepdims=True))
    out, beta = np.zeros_like(step), np.ones_like(alpha[0])
    for t in range(n - 1, 0, -1):
        right = beta * local[:, t]
        joint = alpha[t - 1][:, :, None] * step[None] * right[:, None, :]
        out += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
        beta = right @ step.T
        beta /= beta.sum(1, keepdims=True)
    return out


def split(column: pa.Array) -> K.Words:
    data, offsets = K.text_buffer(column)
    return K.split_words(K.fold(data), offsets, K.PUNCTUATION)


_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def predict(column: pa.Array, model: Model) -> dict[str, list | np.ndarray]:
    """The language of each text, its score, and what else PREDICTIONS has of it."""
    n, k = len(column), len(model.langs)
    words = split(column)
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.data], dtype=np.int64)])
    lettered = letters[words.end] > letters[words.start]
    out = {"lang_pred": [UNKNOWN] * n, "score": np.zeros(n), "n_words": words.counts, "n_switches": np.zeros(n, np.int64), "second_lang": [None] * n, "second_share": np.zeros(n)}
    if not k or not len(words.start):
        return out
    inverse, distinct = K.span_codes(words.data, words.start, words.end)
    data, bounds = K.text_buffer(distinct)
    numbers, sizes = features(data, bounds[:-1], bounds[1:], model.lexicon)
    scores = emissions(numbers, sizes, model.weights)[inverse]
    # runs: cut at texts and at line feeds
    feeds = np.concatenate([[0], np.cumsum(words.data == 10)])
    cut = np.zeros(len(inverse) + 1, dtype=bool)
    cut[words.first] = True
    cut[1:-1] |= feeds[words.start[1:]] > feeds[words.start[:-1]]
    runs = np.flatnonzero(cut)
    probability = marginals(scores, runs[:-1], np.diff(runs), model.transitions)
    doc = words.doc()
    sums = np.stack([np.bincount(doc, probability[:, j] * lettered, n) for j in range(k)], axis=1)
    total = np.bincount(doc, lettered, n)
    some = np.flatnonzero(total > 0)
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[words.data] & (words.data < 128), dtype=np.int64)])[words.offsets]
    doubtful = some[np.diff(ascii_letters)[some] == 0]  # bytes beyond ASCII alone: are they letters?
    if len(doubtful):
        real = np.array([any(map(str.isalpha, x)) for x in column.take(pa.array(doubtful)).to_pylist()])
        some = np.setdiff1d(some, doubtful[~real])
    share = np.clip(sums[some] / total[some, None], 0, 1)
    best = np.argsort(-share, axis=1, kind="stable")
    out["score"][some] = share[np.arange(len(some)), best[:, 0]]
    for i, b in zip(some.tolist(), best.tolist()):
        out["lang_pred"][i] = model.langs[b[0]]
        if k > 1:
            out["second_lang"][i] = model.langs[b[1]]
    if k > 1:
        out["second_share"][some] = share[np.arange(len(some)), best[:, 1]]
    label = probability.argmax(axis=1)
    change = (label[1:] != label[:-1]) & (doc[1:] == doc[:-1])
    out["n_switches"] = np.bincount(doc[1:][change], minlength=n)
    return out


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training; a null id is."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit a model on at most about `rows` labelled documents that are not held out."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), held_out(id_col).alias("held")).where("not held and lang is not null and text is not null").drop("held")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    each = max(20, rows // len(counts))
    chance = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30) < chance[F.col("lang")]
    sample = labelled.where(drawn).select("doc_id", "text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(sample, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["text"]))])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of PREDICTIONS for each document.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no language was
    learned. Equal scores go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = predict(texts(batch), shared.value)
            kinds = {"lang_pred": pa.string(), "score": pa.float64(), "n_words": pa.int64(), "n_switches": pa.int64(), "second_lang": pa.string(), "second_share": pa.float64()}
            return pa.RecordBatch.from_arrays([id_array(ids(batch)), batch.column("held_out"), *[pa.array(found[c], t) for c, t in kinds.items()]], names=["doc_id", "held_out", *kinds])

        return each

    held = documents(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out")), "doc_id", "text", "held_out")
    return map_texts(held, make, PREDICTIONS, size=SLICE_BYTES)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The documents, with all their columns, that are mostly of one language; others are rejected:
    those without letters, and those whose language has a score below `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(column: pa.Array) -> np.ndarray:
            if shared.value.empty:  # nothing was learned, so nothing is known against a text with words
                return np.asarray(split(column).counts > 0)
            found = predict(column, shared.value)
            return np.array([x != UNKNOWN for x in found["lang_pred"]], dtype=bool) & (found["score"] >= least)

        return each

    return rewrite_texts(docs, make, text_col, SLICE_BYTES)
