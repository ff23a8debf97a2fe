"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, a window of words the mean of its words,
and a softmax over the window gives the probability. Unseen spellings share n-grams with seen ones.
The label belongs to a whole text, but a few words make it toxic: a text scores as its worst window,
and training goes in rounds that keep the worst windows of each toxic text as its examples.

Defined cases: a null or empty text scores as a window without words; text columns of any name are
taken, other columns pass through; without labelled rows of both classes every score is the share of
label 1 (0 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.words import U64, blocks, buffers, mix, run_hashes, spans

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW = 8
DIMENSIONS = 8
#: Labelled rows of label 0 and label 1 that the model is fitted on, at most: the bound of the sample.
SAMPLE_CLEAN = 3000
SAMPLE_TOXIC = 1500
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_BYTE = mix(np.arange(1, 257, dtype=U64), 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    """One weight for every n-gram bucket (its vector times the softmax difference) and a bias."""

    weights: np.ndarray
    bias: float


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of ``<word>``."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    lengths = ends - starts + 2
    total = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(total[-1]) - total[word]
    inner = (place > 0) & (place < lengths[word] - 1)
    marked = np.where(place == 0, 60, 62).astype(np.uint8)
    marked[inner] = _LOWER[data[(starts[word] + place - 1)[inner]]]
    codes, left = _BYTE[marked], total[word + 1] - np.arange(total[-1])
    owners, found, running = [], [], np.zeros(len(codes), U64)
    for n in range(max(SIZES)):
        moved = np.zeros(len(codes), U64)
        moved[: len(codes) - n] = codes[n:]
        running = running * U64(0x9E3779B97F4A7C15) + moved
        if n + 1 in SIZES:
            whole = left >= n + 1
            owners.append(word[whole].astype(np.int32))
            found.append((mix(running[whole], n) % U64(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(found)


def _unique_words(data, offsets):
    """Words of a block: (first words of texts, number of each word, starts and ends of the distinct words)."""
    starts, ends, first = spans(data, offsets, _LETTER)
    pieces = [run_hashes(data, starts[i : i + 50_000], ends[i : i + 50_000]) for i in range(0, len(starts), 50_000)]
    _, at, number = np.unique(np.concatenate([np.zeros(0, U64), *pieces]), return_index=True, return_inverse=True)
    return first, number, starts[at], ends[at]


def _logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    first, number, starts, ends = _unique_words(data, offsets)
    owner, bucket = subwords(data, starts, ends)
    size = np.maximum(np.bincount(owner, minlength=len(starts)), 1)
    word = np.bincount(owner, model.weights[bucket], len(starts)) / size
    run = np.concatenate([[0.0], np.cumsum(word[number])])
    out = np.full(len(offsets) - 1, model.bias)
    counts = np.diff(first)
    windows = np.maximum(counts - WINDOW + 1, np.minimum(counts, 1))
    total = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(windows)), windows)
    begin = np.arange(total[-1]) - total[text] + first[text]
    stop = np.minimum(begin + WINDOW, first[text + 1])
    value = (run[stop] - run[begin]) / np.maximum(stop - begin, 1) + model.bias
    full = windows > 0
    if full.any():
        out[full] = np.maximum.reduceat(value, total[:-1][full])
    return out


def score_column(model: Model, text: str | Column) -> Column:
    """Probability of label 1 for every text."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(score_texts(model, texts), -30, 30))))

    return scores.asNondeterministic()(text)  # else a filter on the score would run it twice


def fit(texts: list[str], toxic: list[int], seed: int = 1, rounds: int = 8, steps: int = 12) -> Model:
    """Train embeddings and softmax together; full-batch Adam in rounds of example choice."""
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), 30.0 if share else -30.0)
    # the threshold is set on a sixth of the rows (if there are enough) that the weights never see
    lot = np.random.default_rng(seed).permutation(len(texts))
    kept_back, taught = (lot[::6], np.delete(lot, np.s_[::6])) if len(texts) >= 300 else (lot[:0], lot)
    label = np.asarray(toxic)[taught]
    if not 0 < label.mean() < 1:
        kept_back, taught, label = lot[:0], lot, np.asarray(toxic)[lot]
    data, offsets = buffers(pa.array([texts[i] for i in taught], pa.string()))
    first, number, starts, ends = _unique_words(data, offsets)
    # n-grams of one or two texts teach nothing that holds elsewhere: they stay at zero
    text_of = np.repeat(np.arange(len(label)), np.diff(first))
    pairs = np.unique(number.astype(np.int64) * len(label) + text_of)
    in_texts = np.bincount(pairs // len(label), minlength=len(starts))
    size, seen, owners, buckets = np.ones(len(starts)), np.zeros(BUCKETS), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    pieces = [slice(i, i + 20_000) for i in range(0, len(starts), 20_000)]
    for piece in pieces:
        owner, bucket = subwords(data, starts[piece], ends[piece])
        seen += np.bincount(bucket, in_texts[piece][owner], BUCKETS)
    for piece in pieces:
        owner, bucket = subwords(data, starts[piece], ends[piece])
        size[piece] = np.maximum(np.bincount(owner, minlength=len(starts[piece])), 1)
        keep = np.flatnonzero(seen[bucket] >= 3)
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owners.append(owner[keep] + np.int32(piece.start))
        buckets.append(bucket[keep])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    del owners, buckets
    grams = np.searchsorted(owner, np.arange(len(starts) + 1))

    # windows, non-overlapping for training: rows of word numbers
    begin = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(first[:-1], first[1:])] + [np.zeros(0, np.int64)]).astype(np.int64)
    text = text_of[begin]
    grid = begin[:, None] + np.arange(WINDOW)
    inside = grid < first[text + 1][:, None]
    words = np.where(inside, number[np.minimum(grid, len(number) - 1)], -1)
    filled = inside.sum(1)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    vectors[np.setdiff1d(np.arange(BUCKETS), bucket)] = 0
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    t = 0
    for turn in range(rounds):
        # the worst windows of every text, and some at random; from a toxic text only the worst teach
        weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
        word = np.zeros(len(starts) + 1)
        for i in range(0, len(owner), 1_000_000):
            first_word = int(owner[i])
            some = np.bincount(owner[i : i + 1_000_000] - first_word, weights[bucket[i : i + 1_000_000]])
            word[first_word : first_word + len(some)] += some
        word[:-1] /= size
        score = word[words].sum(1) / filled
        by_score = np.lexsort((-score, text))
        rank = np.empty(len(text), np.int64)
        rank[by_score] = np.arange(len(text)) - np.searchsorted(text[by_score], text[by_score])
        luck = rng.random(len(text))
        by_luck = np.lexsort((luck, text))
        lot = np.empty(len(text), np.int64)
        lot[by_luck] = np.arange(len(text)) - np.searchsorted(text[by_luck], text[by_luck])
        if turn == 0:
            chosen = lot < 12
        else:
            top = score >= np.repeat(score[by_score][rank[by_score] == 0], np.bincount(text, minlength=len(label))[np.unique(text)]) - 1e-6
            chosen = np.where(label[text] == 1, top, (rank < 6) | (lot < 6))
        rows = np.flatnonzero(chosen)
        y = label[text[rows]]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 1.0 / max(1, (y == 0).sum())).astype(np.float32)
        used, flat = np.unique(words[rows].ravel(), return_inverse=True)
        used = used[used >= 0] if (used >= 0).all() else used[1:]
        shift = int((words[rows] < 0).any())  # number 0 is then the empty word
        flat = flat.ravel() - shift
        flat[flat < 0] = len(used)
        counts = grams[used + 1] - grams[used]
        heads = np.concatenate([[0], np.cumsum(counts)])
        own = np.repeat(np.arange(len(used), dtype=np.int32), counts)
        part = bucket[np.arange(heads[-1]) - heads[own] + grams[used][own]]
        by_word = np.argsort(flat, kind="stable")
        word_heads = np.flatnonzero(np.r_[True, np.diff(flat[by_word]) != 0])
        some, share_of = counts > 0, (1 / size[used, None]).astype(np.float32)
        length = filled[rows, None].astype(np.float32)
        for _ in range(steps):
            t += 1
            vector = np.zeros((len(used) + 1, DIMENSIONS), np.float32)
            for d in range(DIMENSIONS if len(part) else 0):  # one dimension at a time: bounded memory
                vector[:-1, d][some] = np.add.reduceat(vectors[:, d][part], heads[:-1][some])
            vector[:-1] *= share_of
            mean = vector[flat].reshape(len(rows), WINDOW, DIMENSIONS).sum(1) / length
            logit = mean @ softmax + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p *= weight[:, None]
            back = np.repeat((p @ softmax.T) / length, WINDOW, axis=0)[by_word]
            grad_word = np.zeros((len(used) + 1, DIMENSIONS), np.float32)
            grad_word[flat[by_word][word_heads]] = np.add.reduceat(back, word_heads)
            grad, each = 1e-6 * vectors, grad_word[:-1] * share_of
            for d in range(DIMENSIONS if len(part) else 0):
                grad[:, d] += np.bincount(part, each[:, d][own], BUCKETS)
            for (value, g, rate), (m, v) in zip(((vectors, grad, 0.05), (softmax, mean.T @ p, 0.05), (bias, p.sum(0), 0.05)), state):
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    model = Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    if len(kept_back):
        model.bias -= _cut(score_texts(model, [texts[i] for i in kept_back]), np.asarray(toxic)[kept_back])
    return model


def _cut(logit: np.ndarray, label: np.ndarray) -> float:
    """The logit with the least cost of errors on either side, in the middle of the best gap."""
    order = np.argsort(logit, kind="stable")
    logit, label = logit[order], label[order]
    missed = np.sqrt((label == 0).sum() / max(1, (label == 1).sum()))  # the rarer label counts for more
    errors = np.concatenate([[0], np.cumsum(label == 1)]) * missed + np.concatenate([np.cumsum((label == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[logit[0] - 1], (logit[1:] + logit[:-1]) / 2, [logit[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


def score_texts(model: Model, texts: list[str | None] | pa.Array) -> np.ndarray:
    """The logit of every text."""
    data, offsets = buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    out = [np.zeros(0)]
    for a, b in blocks(offsets, 1 << 20):
        out.append(_logits(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return np.concatenate(out)


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    """The same rule outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit_on(documents: DataFrame, labels: DataFrame, clean: int = SAMPLE_CLEAN, toxic: int = SAMPLE_TOXIC, seed: int = 1) -> Model:
    """Fit on a keyed sample of at most ``toxic`` and ``clean`` labelled rows that are not held out.

    The sample's ids are chosen from the labels alone, so the texts are read once. One task fits the
    ``toxic`` + ``clean`` texts; only the weights reach the driver.
    """
    rows = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64("doc_id", F.lit(seed))
    picked = None
    for value, bound in ((0, clean), (1, toxic)):
        some = rows.where(F.col("toxic") == value).orderBy(key, "doc_id").limit(bound)
        picked = some if picked is None else picked.unionAll(some)
    found = (
        documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([r[1] for r in rows], [r[2] for r in rows], seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    made = found.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    return Model(np.frombuffer(made[0]["weights"]), made[0]["bias"]) if made else fit([], [])


def toxicity(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Every document with ``toxicity`` (0 to 1); train on ``labels``, score whole texts."""
    model = fit_on(documents, labels)
    return documents.withColumn("toxicity", score_column(model, F.col(text)))
