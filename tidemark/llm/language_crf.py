"""Language identification of code-switched text by a linear-chain conditional random field over words.

Emissions of a word are sums of learned weights of hashed features: byte bigrams and trigrams with word borders,
prefix and suffix of four bytes, and the word itself (lexicon). Transitions and starts are learned with them, by
stochastic gradients of the exact log-likelihood. Training sequences are spans of labelled texts of several
languages set one after another, so the transitions learn code-switching.

Words are labelled by forward-backward over the whole text, exactly: texts are cut into blocks of words, each block's
transfer matrix is multiplied up for all blocks at once, messages pass from block to block, then marginals are
computed in all blocks at once. A text's language is the one with most marginal mass over words with letters.

The training sample is bounded: about train_docs documents a label, chosen by a hash of the id, span_words words at
seeded places of each for each use. The model is fitted in one executor task; the driver holds the weights only.

Defined cases: a text without a letter (null, empty) is `und` with score 0; without labelled training rows
everything is `und`; ties go to the label that sorts first; repeated rows are judged alike; an empty table gives an
empty result. Extra columns stay; lang_pred and score are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import fitted
from tidemark.llm.textnum import NOT_LETTERS, bucket, chunks, gram_positions, words

BITS = 16
BLOCK = 64


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # 4 * 2**BITS rows: trigrams, bigrams, affixes, lexicon
    start: np.ndarray
    moves: np.ndarray


def word_features(number: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words in a row and where each word begins: for each byte a trigram and a bigram, then prefix, suffix, word."""
    at, begins = gram_positions(first, end)
    d = np.where(NOT_LETTERS[data], np.uint8(32), data).astype(np.uint64)
    left, own, right = d[at - 1], d[at], d[(at + 1) % len(d)]
    tri = bucket((left << np.uint64(16)) | (own << np.uint64(8)) | right, 1, BITS)
    bi = bucket((own << np.uint64(8)) | right, 2, BITS) + (1 << BITS)
    n = end - first
    prefix, suffix = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for j in range(4):
        inside = n > j
        prefix = prefix << np.uint64(8) | np.where(inside, d[np.minimum(first + j, end - 1)], 0).astype(np.uint64)
        suffix = suffix << np.uint64(8) | np.where(inside, d[np.maximum(end - 1 - j, first)], 0).astype(np.uint64)
    rest = np.stack([bucket(prefix, 3, BITS) + (2 << BITS), bucket(suffix, 4, BITS) + (2 << BITS), bucket(number, 5, BITS) + (3 << BITS)], 1)
    total = 2 * n + 3
    ends = np.cumsum(total)
    out = np.empty(ends[-1] if len(ends) else 0, np.int64)
    base = np.repeat(ends - total, n) + 2 * (np.arange(len(at)) - np.repeat(begins, n))
    out[base], out[base + 1] = tri, bi
    for j in range(3):
        out[ends - 3 + j] = rest[:, j]
    return out, ends - total


def emissions(model: Model, number: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Scores of every word, computed once for each distinct word."""
    _, at, back = np.unique(number, return_index=True, return_inverse=True)
    rows, begins = word_features(number[at], first[at], end[at], data)
    return np.add.reduceat(model.weights[rows], begins, axis=0)[back]


def _forward_backward(start: np.ndarray, moves: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For B sequences of T words: marginals (B, T, L), expected moves (L, L), log-likelihood normalisers (B)."""
    b, t, n = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    m = np.exp(moves)
    alpha, scale = np.empty_like(e), np.empty((b, t))
    a = np.exp(start) * e[:, 0]
    for i in range(t):
        if i:
            a = (alpha[:, i - 1] @ m) * e[:, i]
        scale[:, i] = a.sum(1)
        alpha[:, i] = a / scale[:, i, None]
    beta = np.ones((b, n))
    marginals, expected = np.empty_like(e), np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        marginals[:, i] = alpha[:, i] * beta
        if i:
            back = e[:, i] * beta / scale[:, i, None]
            expected += (alpha[:, i - 1].T @ back) * m
            beta = back @ m.T
    return marginals, expected, np.log(scale).sum(1) + scores.max(2).sum(1)


def train(texts: list[str], labels: list[str], span_words: int = 32, spans: int = 3, batch: int = 64, steps: int = 160, rate: float = 0.4, seed: int = 11) -> Model | None:
    """Fits a model on (text, label) rows."""
    names = sorted(set(labels))
    if not names:
        return None
    draw = np.random.default_rng(seed)
    number, owner, first, end, data = words(texts, between=NOT_LETTERS)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    size = np.diff(bounds)
    by_label = [np.array([i for i, x in enumerate(labels) if x == name and size[i]]) for name in names]
    names_, by_label = [n for n, x in zip(names, by_label) if len(x)], [x for x in by_label if len(x)]
    n = len(names_)
    model = Model(names_, np.zeros((4 << BITS, n), np.float32), np.zeros(n), np.zeros((n, n)))
    if n < 2:
        return model if n else None
    grads = [np.full(x.shape, 1e-6, x.dtype) for x in (model.weights, model.start, model.moves)]
    for _ in range(steps):
        gold = draw.integers(0, n, (batch, spans))
        places = np.empty((batch, spans, span_words), np.int64)
        for i in range(batch):
            for j in range(spans):
                doc = draw.choice(by_label[gold[i, j]])
                at = bounds[doc] + draw.integers(0, max(1, size[doc] - span_words + 1))
                places[i, j] = bounds[doc] + (at - bounds[doc] + np.arange(span_words)) % size[doc]
        flat = places.reshape(-1)
        rows, begins = word_features(number[flat], first[flat], end[flat], data)
        scores = np.add.reduceat(model.weights[rows], begins, axis=0).reshape(batch, -1, n).astype(float)
        truth = np.repeat(gold, span_words, axis=1)
        marginals, expected, _ = _forward_backward(model.start, model.moves, scores)
        slope = -marginals
        np.add.at(slope, (np.arange(batch)[:, None], np.arange(truth.shape[1])[None], truth), 1)
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        per_word = slope.reshape(-1, n) / batch
        g = np.zeros_like(model.weights)
        length = np.diff(np.append(begins, len(rows)))
        spread = np.repeat(per_word, length, axis=0)
        for c in range(n):
            g[:, c] = np.bincount(rows, spread[:, c], len(g))
        for x, d, s in ((model.weights, g, grads[0]), (model.start, slope[:, 0].mean(0), grads[1]), (model.moves, (seen - expected) / batch, grads[2])):
            s += d * d
            x += (rate * d / np.sqrt(s)).astype(x.dtype)
    return model


def marginals(model: Model, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; text i has words bounds[i] to bounds[i + 1]. Exact over each whole text."""
    n = len(model.labels)
    size = np.diff(bounds)
    per = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(size)), per)
    first_block = np.cumsum(per) - per
    inside = np.arange(len(owner)) - first_block[owner]
    begin = bounds[:-1][owner] + inside * BLOCK
    length = np.minimum(BLOCK, bounds[1:][owner] - begin)
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    m, s = np.exp(model.moves), np.exp(model.start)
    n_blocks = len(owner)
    order = np.argsort(-length, kind="stable")  # blocks that are still running stand first
    begin, length = begin[order], length[order]
    running = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # blocks longer than t
    transfer = np.repeat(np.eye(n)[None], n_blocks, 0)
    for t in range(BLOCK):
        k = running[t]
        if not k:
            break
        x = (transfer[:k].reshape(-1, n) @ m).reshape(k, n, n) * e[begin[:k] + t][:, None, :]
        transfer[:k] = x / x.sum((1, 2), keepdims=True)
    place = np.empty(n_blocks, np.int64)
    place[order] = np.arange(n_blocks)
    # messages before and after each block; a text's first message makes the first move give the starts
    into, back = np.empty((n_blocks, n)), np.empty((n_blocks, n))
    deepest = per.max() if len(per) else 0
    by_depth = np.argsort(inside, kind="stable")
    cuts = np.searchsorted(inside[by_depth], np.arange(deepest + 1))
    first_in = np.linalg.lstsq(m.T, s / s.sum(), rcond=None)[0]
    for t in range(deepest):
        own = by_depth[cuts[t] : cuts[t + 1]]
        if t:
            x = np.einsum("bi,bij->bj", into[place[own - 1]], transfer[place[own - 1]])
            into[place[own]] = x / np.abs(x).sum(1, keepdims=True)
        else:
            into[place[own]] = first_in
    for t in range(deepest - 1, -1, -1):
        own = by_depth[cuts[t] : cuts[t + 1]]
        last = inside[own] == per[owner[own]] - 1
        back[place[own[last]]] = 1
        rest = own[~last]
        x = np.einsum("bij,bj->bi", transfer[place[rest + 1]], back[place[rest + 1]])
        back[place[rest]] = x / x.sum(1, keepdims=True)
    out = np.empty((len(scores), n))
    a = into
    for t in range(BLOCK):
        k = running[t]
        if not k:
            break
        a = (a[:k] @ m) * e[begin[:k] + t]
        a /= a.sum(1, keepdims=True)
        out[begin[:k] + t] = a
    b = back
    for t in range(BLOCK - 1, -1, -1):
        k = running[t]
        if not k:
            continue
        at = begin[:k] + t
        out[at] *= b[:k]
        b[:k] = (e[at] * b[:k]) @ m.T
        b[:k] /= b[:k].sum(1, keepdims=True)
    out = np.maximum(out, 0)
    return out / out.sum(1, keepdims=True)


def label_words(model: Model, texts: list) -> Iterator[tuple]:
    """For each chunk of texts: first text, text of each word (from 0), word bounds in bytes, word marginals."""
    for lo, hi in chunks(texts):
        number, owner, first, end, data = words(texts[lo:hi], between=NOT_LETTERS)
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        if not len(number):
            yield lo, hi, owner, first, end, np.empty((0, len(model.labels)))
            continue
        yield lo, hi, owner, first, end, marginals(model, emissions(model, number, first, end, data), bounds)


def predict(model: Model | None, texts: list) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    for lo, hi, owner, _, _, p in label_words(model, texts):
        mass = np.stack([np.bincount(owner, p[:, c], hi - lo) for c in range(len(model.labels))], 1) if len(p) else np.zeros((hi - lo, len(model.labels)))
        for i in np.flatnonzero(mass.sum(1) > 0):
            t = texts[lo + i]
            if t.isascii() or any(c.isalpha() for c in t):
                c = int(mass[i].argmax())
                lang[lo + i], score[lo + i] = model.labels[c], min(1.0, float(mass[i, c] / mass[i].sum()))
    return lang, score


def sample(rows: DataFrame, label: str, per_label: int, key: str, broadcast_labels: int = 100_000) -> DataFrame:
    """About per_label rows of each label, by a hash of the key; the same rows on every run."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.select(F.col(label).alias("_l"), (F.lit(float(per_label)) / F.col("_n")).alias("_rate"))
    rates = F.broadcast(counts) if counts.count() <= broadcast_labels else counts
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(rates, F.col(label) == F.col("_l")).where(draw < F.col("_rate")).drop("_l", "_rate")


def identify(docs: DataFrame, trains: Column, train_docs: int = 400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with lang_pred and score; labels are taken only from rows where `trains` holds."""
    docs = docs.drop("lang_pred", "score")
    known = docs.where(trains & F.col(lang).isNotNull())
    rows = sample(known.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")), "l", train_docs, "i")  # train_docs a label

    def fit(rows: pd.DataFrame) -> Model | None:
        rows = rows.sort_values(["i", "t", "l"]).drop_duplicates("t")
        return train([t or "" for t in rows["t"]], rows["l"].tolist())

    model = fitted(rows, fit)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS floats a label

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(held.value)
        for batch in batches:
            batch["lang_pred"], batch["score"] = predict(model, batch[text].tolist())
            yield batch[schema.names]

    return docs.mapInPandas(run, schema)
