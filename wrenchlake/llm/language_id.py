"""Language identification by a linear-chain conditional random field over words.

Each word of a text has a label. Emission scores are sums of weights of hashed features: the word itself (the lexicon), its
affixes and its character n-grams. Transition scores between the labels of neighbours are learned with them. Training maximises the
conditional likelihood of label sequences; as documents carry one language each, training sequences are spliced from stretches of
several documents, so that switches between languages are seen and transitions are learned from them. Prediction runs forward-backward over
each whole text; the document's language is the one with the largest share of the marginals of its words with letters, and
that share is the score.

The model is fitted on at most `SAMPLE_DOCS` labelled documents of up to `SAMPLE_CHARS` characters, those with the least hash of their id, and `SEQUENCES` spliced
sequences of `SEQUENCE_WORDS` words; only words drawn for these are hashed. Nothing else is bounded: every word of every text is labelled. Only the text is an input of a prediction.

Null text, or text without a letter, is `und` with score 0. Without any labelled text everything is `und`. A null doc_id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm.common import arrow_pass, documents, worker_memory
from wrenchlake.llm.hashing import mixed

SAMPLE_DOCS = 3000
SEQUENCES, SEQUENCE_WORDS, STRETCH_WORDS = 4096, 64, 16
BUCKETS = 1 << 16
EPOCHS, RATE, DECAY, BATCH = 3, 0.5, 1e-6, 128
KEPT_WORDS = 300_000
#: Cells (documents times longest text in words) of one forward-backward batch.
CELLS = 200_000
LOOKUP_DOCS = 1000
#: Words hashed at a time; their features take some 3 KB a word meanwhile.
HASH_WORDS = 10_000
#: Characters of a sampled text at most; longer labelled texts are not fitted on.
SAMPLE_CHARS = 100_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return [x.decode() for x in (text or "").encode().lower().split()]


def features_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, word by word, and how many each has; a word without letters has none.

    Hashes of the framed word's n-grams, its prefixes and suffixes, and the whole word, for all words at once.
    """
    framed = [f"^{w.lower()}$" if w.isalpha() or any(c.isalpha() for c in w) else "" for w in words]
    lengths = np.array([len(x) for x in framed], np.int64)
    codes = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    begin = np.cumsum(lengths) - lengths
    owners, hashes = [], []

    def add(who: np.ndarray, at: np.ndarray, k: int, kind: int) -> None:
        h = np.full(len(at), kind * 8 + k, np.uint64)
        for j in range(k):
            h = mixed(h + codes[at + j] * np.uint64(0x9E3779B97F4A7C15))
        owners.append(who)
        hashes.append(h)

    for k in (1, 2, 3):
        at = np.arange(len(codes) - k + 1)
        at = at[owner[at] == owner[at + k - 1]]
        add(owner[at], at, k, 0)
        who = np.flatnonzero(lengths >= k + 2)
        add(who, begin[who] + 1, k, 1)
        add(who, begin[who] + lengths[who] - 1 - k, k, 2)
    who = np.flatnonzero(lengths)
    spread = mixed(codes + (np.arange(len(codes)) - begin[owner]).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    owners.append(who)
    hashes.append(mixed(np.add.reduceat(spread, begin[who])))
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


class Emissions:
    """Emission scores of distinct words under given weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, self.weights.shape[1]), np.float32)
        self.letters = np.zeros(0, bool)

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        new = [w for w in set(words) if w not in self.place]
        found, lettered = [self.scores], [self.letters]
        for at in range(0, len(new), HASH_WORDS):
            some = new[at : at + HASH_WORDS]
            flat, sizes = features_of(some)
            scores = np.zeros((len(some), self.weights.shape[1]), np.float32)
            if len(flat):
                starts = (np.cumsum(sizes) - sizes)[sizes > 0]
                scores[sizes > 0] = np.add.reduceat(self.weights[flat], starts, axis=0)
            for w in some:
                self.place[w] = len(self.place)
            found.append(scores)
            lettered.append(sizes > 0)
        if new:
            self.scores, self.letters = np.concatenate(found), np.concatenate(lettered)
        return self.place


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label marginals (steps, sequences, labels) of padded emission scores, by scaled forward-backward."""
    steps = len(scores)
    emitted = np.exp(scores - scores.max(2, keepdims=True))
    moved = np.exp(transition)
    forward = np.empty_like(emitted)
    now = emitted[0] * np.exp(start)
    forward[0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (forward[t - 1] @ moved) * emitted[t]
        forward[t] = now / now.sum(1, keepdims=True)
    back = np.ones_like(emitted[0])
    for t in range(steps - 1, -1, -1):
        # `back` stays all ones until a sequence's last word.
        if t < steps - 1:
            inside = (t + 1 < lengths)[:, None]
            now = (back * emitted[t + 1]) @ moved.T
            back = np.where(inside, now / now.sum(1, keepdims=True), 1).astype(emitted.dtype)
        forward[t] *= back
    return forward / forward.sum(2, keepdims=True)


def coded_words(texts: Iterable[str]) -> tuple[list[np.ndarray], dict[str, int]]:
    """The words of each text as numbers, and the number of each word."""
    place: dict[str, int] = {}
    return [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32) for t in texts], place


def fit(
    coded: Sequence[np.ndarray], place: dict[str, int], labels: Sequence[int], count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (BUCKETS, labels), transitions and start scores."""
    rng = np.random.default_rng(7)
    by_label = [[c for c, y in zip(coded, labels) if y == k and len(c)] for k in range(count)]
    present = [k for k in range(count) if by_label[k]]
    words = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    truth = np.zeros((SEQUENCES, SEQUENCE_WORDS), np.int64)
    for i in range(SEQUENCES):
        filled = 0
        while filled < SEQUENCE_WORDS:
            k = present[rng.integers(len(present))]
            source = by_label[k][rng.integers(len(by_label[k]))]
            length = min(1 + rng.geometric(1 / STRETCH_WORDS), SEQUENCE_WORDS - filled, len(source))
            at = rng.integers(len(source) - length + 1)
            words[i, filled : filled + length] = source[at : at + length]
            truth[i, filled : filled + length] = k
            filled += length
    # Only drawn words are hashed, some at a time.
    drawn, renamed = np.unique(words, return_inverse=True)
    words = renamed.reshape(words.shape)
    spelled = dict.fromkeys(drawn.tolist())
    for w, k in place.items():
        if k in spelled:
            spelled[k] = w
    listed = list(spelled.values())
    parts = [features_of(listed[at : at + HASH_WORDS]) for at in range(0, len(listed), HASH_WORDS)]
    flat, sizes = np.concatenate([f for f, _ in parts]).astype(np.int32), np.concatenate([n for _, n in parts])
    begins = np.cumsum(sizes) - sizes
    weights = np.zeros((BUCKETS, count))
    transition, start = np.zeros((count, count)), np.zeros(count)
    squares = [np.full_like(x, 1e-6) for x in (weights, transition, start)]
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(SEQUENCES), max(1, SEQUENCES // BATCH)):
            w, y = words[rows].T, truth[rows].T  # (steps, sequences)
            used, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            index = np.concatenate([np.arange(b, b + s) for b, s in zip(begins[used], sizes[used])])
            owner = np.repeat(np.arange(len(used)), sizes[used])
            feature = flat[index]
            scores = np.stack([np.bincount(owner, weights[feature, k], len(used)) for k in range(count)], 1)
            emitted = scores[inverse]
            lengths = np.full(w.shape[1], len(w))
            gamma = marginals(emitted, lengths, transition, start)
            error = gamma.copy()
            np.put_along_axis(error, y[:, :, None], np.take_along_axis(error, y[:, :, None], 2) - 1, 2)
            per_word = np.stack([np.bincount(inverse.ravel(), error[:, :, k].ravel(), len(used)) for k in range(count)], 1)
            slope = np.stack([np.bincount(feature, per_word[owner, k], BUCKETS) for k in range(count)], 1)
            pairs = pair_expectation(emitted, transition, start)
            np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), -1)
            for x, g, sq in zip((weights, transition, start), (slope, pairs, error[0].sum(0)), squares):
                g = g / len(rows) + DECAY * x
                sq += g * g
                x -= RATE * g / np.sqrt(sq)
    return weights.astype(np.float32), transition.astype(np.float32), start.astype(np.float32)


def pair_expectation(scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expected number of each label pair among neighbours, over sequences of full length."""
    emitted = np.exp(scores - scores.max(2, keepdims=True))
    moved = np.exp(transition)
    forward = [emitted[0] * np.exp(start)]
    forward[0] /= forward[0].sum(1, keepdims=True)
    for t in range(1, len(scores)):
        now = (forward[-1] @ moved) * emitted[t]
        forward.append(now / now.sum(1, keepdims=True))
    back = np.ones_like(emitted[0])
    total = np.zeros_like(transition)
    for t in range(len(scores) - 2, -1, -1):
        right = back * emitted[t + 1]
        joint = forward[t][:, :, None] * moved[None] * right[:, None, :]
        total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = right @ moved.T
        back /= back.sum(1, keepdims=True)
    return total


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """Labels and model from labelled documents that are not held out; None if there are none."""
    usable = docs.filter("lang is not null and text is not null").filter(~held_out())
    usable = usable.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "lang")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # A bounded sample: ids first, so that only the chosen texts move.
    chosen = usable.select(order.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS)
    rows = usable.withColumn("h", order).join(F.broadcast(chosen), "h")
    sample = rows.orderBy("h", "lang", F.xxhash64("text")).limit(SAMPLE_DOCS).select("text", "lang").collect()
    coded, place = coded_words(r["text"] for r in sample)
    langs = [r["lang"] for r in sample]
    del sample, rows
    lettered = np.zeros(len(place), bool)
    lettered[[k for w, k in place.items() if any(c.isalpha() for c in w)]] = True
    kept = [i for i, c in enumerate(coded) if lettered[c].any()]
    if not kept:
        return None
    names = sorted({langs[i] for i in kept})
    return names, *fit([coded[i] for i in kept], place, [names.index(langs[i]) for i in kept], len(names))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words, n_switches (neighbouring words whose likeliest labels differ)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id() if model else 'none'}"

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column(batch.schema.get_field_index("text"))
        out = {"doc_id": batch.column(batch.schema.get_field_index("doc_id"))}
        n = len(texts)
        pred, score = ["und"] * n, [0.0] * n
        n_words, switches = [0] * n, [0] * n
        out |= {"lang_pred": pred, "score": score, "n_words": n_words, "n_switches": switches}
        if shared.value is None:
            return out
        names, weights, transition, start = shared.value
        memory = worker_memory("crf")
        if memory.get("token") != token:
            memory |= {"token": token, "emissions": Emissions(weights)}
        emissions = memory["emissions"]
        for at in range(0, n, LOOKUP_DOCS):
            if len(emissions.place) > KEPT_WORDS:
                emissions.clear()
            cut = [words_of(t) for t in texts.slice(at, LOOKUP_DOCS).to_pylist()]
            place = emissions.learn(w for words in cut for w in words)
            coded = [np.array([place[w] for w in words], np.int64) for words in cut]
            order = sorted((i for i, c in enumerate(coded) if len(c)), key=lambda i: len(coded[i]))
            low = 0
            while low < len(order):
                high = low + 1
                while high < len(order) and len(coded[order[high]]) * (high + 1 - low) <= CELLS:
                    high += 1
                ids = order[low:high]
                low = high
                lengths = np.array([len(coded[i]) for i in ids])
                padded = np.zeros((len(ids), lengths.max()), np.int64)
                for k, i in enumerate(ids):
                    padded[k, : lengths[k]] = coded[i]
                gamma = marginals(emissions.scores[padded.T], lengths, transition, start)
                real = np.arange(len(gamma))[:, None] < lengths
                lettered = emissions.letters[padded.T] & real
                shares = (gamma * lettered[:, :, None]).sum(0)
                likely = gamma.argmax(2)
                changed = ((likely[1:] != likely[:-1]) & real[1:]).sum(0)
                for k, i in enumerate(ids):
                    n_words[at + i], switches[at + i] = int(lengths[k]), int(changed[k])
                    if lettered[:, k].any():
                        best = int(shares[k].argmax())
                        pred[at + i] = names[best]
                        score[at + i] = min(1.0, float(shares[k, best] / lettered[:, k].sum()))
        return out

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, n_words long, n_switches long"
    )
    return arrow_pass(docs.select("doc_id", "text"), rows, schema, "crf")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
