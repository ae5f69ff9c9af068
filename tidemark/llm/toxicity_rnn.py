"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs. A word is a run of letters, A-Z lower-cased; every word of a text is read. Its input joins a word embedding
(vocabulary of the training sample, with a cautious log-odds start) and the mean embedding of its hashed byte trigrams
with word borders. Both are looked up, and multiplied by the input weights, once for each distinct word.

Windows. All windows of `width` words at every half width, to the end of the text; each is read in both directions, its states
are pooled by learned attention, and a logistic unit scores it. A text's score is its highest window's.

Training. Windows are not labelled, texts are: in each epoch a text stands for itself by its highest window (at first by
log-odds, then by the network), and clean texts also by a random one, some of them turned into one word said again
and again. Every text of the sample is used in every epoch; as some labels are wrong, the loss is the generalised cross
entropy (1 - p^q) / q from the third epoch on, whose slope fades where the network is sure of the contrary. Adam,
class-balanced. The sample is bounded: about train_docs texts a label, chosen by a hash of the id; near-copies in it
count once. The network is fitted in one executor task, as the sample is bounded; the driver holds the network only.

Defined cases: a text without words (null, empty) scores the network's answer to an empty window, which is trained as
clean; without training rows of both labels all scores are 0; repeated rows are judged alike; an empty table gives an
empty result. Extra columns stay; score and predicted are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import fitted
from tidemark.llm.language_crf import sample
from tidemark.llm.textnum import NOT_LETTERS, bucket, chunks, gram_positions, mix64, shingle_sets, words

GRAM_BITS = 13


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(proj: np.ndarray, spot: np.ndarray, mask: np.ndarray, u: np.ndarray, backwards: bool, out: np.ndarray) -> None:
    """_gru for scoring: step by step into out (T, B, H), in place. spot, mask: (T, B)."""
    t, b = spot.shape
    h = u.shape[0]
    u_zr, u_c = np.ascontiguousarray(u[:, : 2 * h]) * np.float32(0.5), np.ascontiguousarray(u[:, 2 * h :])
    p_zr, p_c = np.ascontiguousarray(proj[:, : 2 * h]) * np.float32(0.5), np.ascontiguousarray(proj[:, 2 * h :])
    state = np.zeros((b, h), np.float32)
    zr, c, rs, got = np.empty((b, 2 * h), np.float32), np.empty((b, h), np.float32), np.empty((b, h), np.float32), np.empty((b, 2 * h), np.float32)
    for i in range(t - 1, -1, -1) if backwards else range(t):
        np.take(p_zr, spot[i], axis=0, out=got, mode="clip")
        np.matmul(state, u_zr, out=zr)
        zr += got
        np.tanh(zr, out=zr)
        zr += np.float32(1)
        zr *= np.float32(0.5)
        np.multiply(zr[:, h:], state, out=rs)
        np.take(p_c, spot[i], axis=0, out=out[i], mode="clip")
        np.matmul(rs, u_c, out=c)
        c += out[i]
        np.tanh(c, out=c)
        c -= state
        c *= zr[:, :h]
        c *= mask[i][:, None]
        np.add(state, c, out=out[i])
        state = out[i]


def _gru(p: np.ndarray, mask: np.ndarray, u: np.ndarray, backwards: bool, keep: bool):
    """States (B, T, H) of one direction. p: (B, T, 3H) inputs by gate; mask: (B, T)."""
    b, t, h3 = p.shape
    h = h3 // 3
    state = np.zeros((b, h), np.float32)
    out = np.empty((t, b, h), np.float32)
    tape = []
    for i in range(t - 1, -1, -1) if backwards else range(t):
        zr = _sigmoid(p[:, i, : 2 * h] + state @ u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(p[:, i, 2 * h :] + (r * state) @ u[:, 2 * h :])
        m = mask[:, i, None]
        if keep:
            tape.append((i, state, z, r, c, m))
        state = state + m * (z * (c - state))
        out[i] = state
    return out.transpose(1, 0, 2), tape


def _gru_back(tape: list, g_out: np.ndarray, u: np.ndarray, g_p: np.ndarray) -> np.ndarray:
    """Gradients: of u returned, of inputs into g_p. g_out: (B, T, H)."""
    h = u.shape[0]
    g_u = np.zeros_like(u)
    g = np.zeros_like(g_out[:, 0])
    for i, state, z, r, c, m in reversed(tape):
        g = g + g_out[:, i]
        gm = g * m
        g_c = gm * z * (1 - c * c)
        g_z = gm * (c - state) * z * (1 - z)
        g_rs = g_c @ u[:, 2 * h :].T
        g_r = g_rs * state * r * (1 - r)
        gates = np.concatenate([g_z, g_r], 1)
        g_p[:, i, : 2 * h], g_p[:, i, 2 * h :] = gates, g_c
        g_u[:, : 2 * h] += state.T @ gates
        g_u[:, 2 * h :] += (r * state).T @ g_c
        g = g - gm * z + g_rs * r + gates @ u[:, : 2 * h].T
    return g_u


class Network:
    """Parameters, the forward pass over windows, and gradients."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, dim: int = 6, grams: int = 4, hidden: int = 6, attend: int = 6, width: int = 32, seed: int = 5):
        draw = np.random.default_rng(seed)
        f = lambda *shape, s=0.3: (draw.normal(size=shape) * s).astype(np.float32)
        self.vocabulary, self.width, self.hidden = vocabulary, width, hidden
        #: The last row of words is for all words outside the vocabulary.
        word = f(len(vocabulary) + 1, dim, s=0.05)
        word[:-1, 0] = odds
        self.w = {
            "word": word,
            "gram": f(1 << GRAM_BITS, grams, s=0.1),
            "in": f(dim + grams, 6 * hidden),
            "bias": np.zeros(6 * hidden, np.float32),
            "uf": f(hidden, 3 * hidden),
            "ub": f(hidden, 3 * hidden),
            "att": f(2 * hidden, attend),
            "att_v": f(attend),
            "out": f(2 * hidden),
            "out_b": np.full(1, -1, np.float32),
        }

    def lookup(self, number: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, number)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == number, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(number), np.int64)

    def inputs(self, word: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word inputs x and their products with the input weights."""
        n = np.diff(np.append(begins, len(grams)))[:, None].astype(np.float32)
        x = np.concatenate([self.w["word"][word], np.add.reduceat(self.w["gram"][grams], begins, axis=0) / n], 1)
        return x, x @ self.w["in"] + self.w["bias"]

    def pool(self, p: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; p: (B, T, 6H)."""
        h3 = 3 * self.hidden
        hf, tf = _gru(p[:, :, :h3], mask, self.w["uf"], False, keep)
        hb, tb = _gru(p[:, :, h3:], mask, self.w["ub"], True, keep)
        h = np.concatenate([hf, hb], 2)
        a = np.tanh(h @ self.w["att"])
        s = np.where(mask > 0, a @ self.w["att_v"], -1e9)
        s = np.exp(s - s.max(1, keepdims=True)) * (mask > 0)
        s /= np.maximum(s.sum(1, keepdims=True), 1e-9)
        pooled = (s[:, :, None] * h).sum(1)
        return pooled @ self.w["out"] + self.w["out_b"][0], (tf, tb, h, a, s, pooled)

    def logits(self, proj: np.ndarray, spot: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """pool() without a tape. spot, mask: (B, T)."""
        spot, mask = np.ascontiguousarray(spot.T), np.ascontiguousarray(mask.T)
        k, h3 = self.hidden, 3 * self.hidden
        sides = [np.empty((*spot.shape, k), np.float32) for _ in range(2)]
        _states(proj[:, :h3], spot, mask, self.w["uf"], False, sides[0])
        _states(proj[:, h3:], spot, mask, self.w["ub"], True, sides[1])
        flat = [x.reshape(-1, k) for x in sides]
        a = flat[0] @ self.w["att"][:k]
        a += flat[1] @ self.w["att"][k:]
        np.tanh(a, out=a)
        s = (a @ self.w["att_v"]).reshape(spot.shape)
        s = np.exp(s - s.max(0)) * mask
        s /= np.maximum(s.sum(0), np.float32(1e-9))
        value = (flat[0] @ self.w["out"][:k] + flat[1] @ self.w["out"][k:]).reshape(spot.shape)
        return (s * value).sum(0) + self.w["out_b"][0]

    def gradients(self, word, grams, begins, spot, mask, truth, weight, doubt: float = 0.0) -> tuple[dict, float]:
        """spot: (B, T) rows of the distinct words. doubt: q of the generalised cross entropy; 0 is the plain one."""
        x, proj = self.inputs(word, grams, begins)
        logit, (tf, tb, h, a, s, pooled) = self.pool(proj[spot], mask, True)
        prob = _sigmoid(logit)
        fits = np.where(truth > 0, prob, 1 - prob)
        d = (weight * (prob - truth) * fits**doubt / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        g_pool = d[:, None] * self.w["out"]
        g_h = s[:, :, None] * g_pool[:, None, :]
        g_s = (h * g_pool[:, None, :]).sum(2)
        g_s = s * (g_s - (s * g_s).sum(1, keepdims=True))
        g["att_v"] = np.einsum("bt,bta->a", g_s, a)
        g_a = g_s[:, :, None] * self.w["att_v"] * (1 - a * a)
        g["att"] = np.einsum("bth,bta->ha", h, g_a)
        g_h = (g_h + g_a @ self.w["att"].T).astype(np.float32)
        k, h3 = self.hidden, 3 * self.hidden
        g_p = np.zeros((*spot.shape, 2 * h3), np.float32)
        g["uf"] = _gru_back(tf, g_h[:, :, :k], self.w["uf"], g_p[:, :, :h3])
        g["ub"] = _gru_back(tb, g_h[:, :, k:], self.w["ub"], g_p[:, :, h3:])
        flat, at = g_p.reshape(-1, 2 * h3), spot.reshape(-1)
        g_proj = np.stack([np.bincount(at, flat[:, c], len(word)) for c in range(2 * h3)], 1).astype(np.float32)
        g["in"], g["bias"] = x.T @ g_proj, g_proj.sum(0)
        g_x = g_proj @ self.w["in"].T
        dim = self.w["word"].shape[1]
        g["word"] = np.zeros_like(self.w["word"])
        np.add.at(g["word"], word, g_x[:, :dim])
        n = np.diff(np.append(begins, len(grams)))
        share = np.repeat(g_x[:, dim:] / n[:, None].astype(np.float32), n, axis=0)
        g["gram"] = np.stack([np.bincount(grams, share[:, c], 1 << GRAM_BITS) for c in range(share.shape[1])], 1).astype(np.float32)
        loss = (weight * ((1 - fits**doubt) / doubt if doubt else -np.log(fits + 1e-9))).sum() / weight.sum()
        return g, float(loss)


def trigrams(first: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, begins = gram_positions(first, end)
    d = np.where(NOT_LETTERS[data], np.uint8(32), data).astype(np.uint64)
    return bucket((d[at - 1] << np.uint64(16)) | (d[at] << np.uint64(8)) | d[(at + 1) % len(d)], 6, GRAM_BITS), begins


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of all windows: one every half width until the end of the text is reached."""
    size = np.diff(bounds)
    half = width // 2
    n = np.maximum(1, -(-(size - width) // half) + 1)
    owner = np.repeat(np.arange(len(size)), n)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * half
    return owner, bounds[:-1][owner] + at, np.clip(size[owner] - at, 0, width)


def _places(begin: np.ndarray, length: np.ndarray, width: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(width)
    mask = (step < length[:, None]).astype(np.float32)
    return np.minimum(begin[:, None] + step, last), mask


class Texts:
    """Words of texts with their distinct words."""

    def __init__(self, texts: list):
        self.number, owner, first, end, data = words(texts, between=NOT_LETTERS)
        self.bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.distinct, at, self.spot = np.unique(self.number, return_index=True, return_inverse=True)
        self.grams, self.begins = trigrams(first[at], end[at], data) if len(at) else (np.empty(0, np.int64), at)

    def scores(self, network: Network, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit of every window, with text, first word, length."""
        owner, begin, length = windows(self.bounds, network.width)
        logits = np.empty(len(owner), np.float32)
        proj = network.inputs(network.lookup(self.distinct), self.grams, self.begins)[1] if len(self.distinct) else np.zeros((1, 6 * network.hidden), np.float32)
        spot = self.spot if len(self.spot) else np.zeros(1, np.int64)
        for i in range(0, len(owner), block):
            places, mask = _places(begin[i : i + block], length[i : i + block], network.width, len(spot) - 1)
            logits[i : i + block] = network.logits(proj, spot[places], mask)
        return logits, owner, begin, length


def best_windows(logits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Index of the highest window of each text."""
    order = np.lexsort((-logits, owner))
    return order[np.flatnonzero(np.diff(owner[order], prepend=-1))]


def thin(texts: list) -> list[int]:
    """Indices of texts that share none of three least shingles with an earlier one."""
    seen: set = set()
    kept = []
    for i, s in enumerate(shingle_sets(texts, 5)):
        keys = {(j, int(mix64(s * np.uint64(2 * j + 1)).min())) for j in range(3)} if len(s) else {i}
        if seen.isdisjoint(keys):
            kept.append(i)
        seen |= keys
    return kept


def train(texts: list, truth: list, epochs: int = 8, least_steps: int = 240, batch: int = 128, rate: float = 0.01, decay: float = 0.01, stutter: float = 0.1, fade: float = 0.7, seed: int = 3) -> Network | None:
    kept = thin(texts)
    texts, truth = [texts[i] for i in kept] + [""], np.array([truth[i] for i in kept] + [0], np.float32)
    if not truth.any() or len(truth) < 3 or truth[:-1].all():
        return None
    held = Texts(texts)
    who = np.repeat(np.arange(len(texts)), np.diff(held.bounds))
    pair = np.unique(np.stack([held.spot, who], 1), axis=0)
    bad = np.bincount(pair[:, 0], truth[pair[:, 1]], len(held.distinct))
    all_ = np.bincount(pair[:, 0], minlength=len(held.distinct))
    n_bad, n_all = truth.sum(), len(truth)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / (n_all - n_bad + 1))
    known = all_ >= 5
    doubt = np.sqrt(1 / (bad + 0.5) + 1 / (all_ - bad + 0.5))
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - doubt)
    network = Network(held.distinct[known], np.clip(odds[known], -3, 5).astype(np.float32) * 0.5)
    value = np.where(known, np.clip(odds, 0, 5), 0)[held.spot]
    owner, begin, length = windows(held.bounds, network.width)
    sums = np.concatenate([[0], np.cumsum(value)])
    logits = (sums[begin + length] - sums[begin]).astype(np.float32)
    draw = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
    vocabulary = network.lookup(held.distinct)
    lengths = np.diff(np.append(held.begins, len(held.grams)))
    step = 0
    epochs = max(epochs, -(-least_steps * batch // (2 * len(texts))))  # few texts are seen more often
    for epoch in range(epochs):
        if epoch > 1:
            logits = held.scores(network)[0]
        top = best_windows(logits, owner)
        clean = np.flatnonzero(truth[owner] == 0)
        chosen = np.concatenate([top, draw.choice(clean, min(len(clean), len(texts)), replace=False)])
        chosen = draw.permutation(chosen)
        good = truth[owner[chosen]] > 0
        weight_of = np.where(good, (len(chosen) - good.sum()) / max(1, good.sum()) * 0.15, 1.0)
        for i in range(0, len(chosen), batch):
            c = chosen[i : i + batch]
            places, mask = _places(begin[c], length[c], network.width, len(held.spot) - 1)
            same = draw.random(len(c)) < stutter  # a word of a clean text said again and again stays clean
            same &= (truth[owner[c]] == 0) & (length[c] > 0)
            places[same], mask[same] = (begin[c] + draw.integers(0, np.maximum(1, length[c])))[same, None], 1
            rows, spot = np.unique(held.spot[places], return_inverse=True)
            n = lengths[rows]
            ends = np.cumsum(n)
            grams = held.grams[np.arange(ends[-1]) - np.repeat(ends - n - held.begins[rows], n)]
            g, _ = network.gradients(vocabulary[rows], grams, ends - n, spot.reshape(places.shape), mask, truth[owner[c]], weight_of[i : i + batch].astype(np.float32), fade if epoch > 1 else 0.0)
            step += 1
            for k, v in network.w.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if k in ("word", "gram"):
                    v[:, k == "word" :] *= 1 - decay
    return network


def score_texts(network: Network | None, texts: list) -> np.ndarray:
    """Score of every text: its highest window's."""
    out = np.zeros(len(texts))
    if network is not None:
        for lo, hi in chunks(texts, 1 << 20):
            logits, owner, _, _ = Texts(texts[lo:hi]).scores(network)
            best = best_windows(logits, owner)
            out[lo + owner[best]] = _sigmoid(logits[best].astype(float))
    return out


def classify(docs: DataFrame, labels: DataFrame, trains: Column, train_docs: int = 1500, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """docs with score and predicted; labels are taken only from rows where `trains` holds."""
    docs = docs.drop("score", "predicted")
    known = labels.where(trains & F.col(label).isNotNull()).select(doc_id, F.col(label).alias("_label"))
    few = sample(known, "_label", train_docs, doc_id)  # train_docs a label
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(few), F.col("i") == F.col(doc_id)).select("i", "t", "_label")

    def fit(rows: pd.DataFrame) -> Network | None:
        rows = rows.sort_values(["i", "t", "_label"]).drop_duplicates("t")
        return train([t or "" for t in rows["t"]], rows["_label"].tolist())

    held = docs.sparkSession.sparkContext.broadcast(fitted(rows, fit))  # the sample's vocabulary at most
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = pickle.loads(held.value)
        for batch in batches:
            batch["score"] = score_texts(network, batch[text].tolist())
            batch["predicted"] = (batch["score"] >= 0.5).astype("int32")
            yield batch[schema.names]

    return docs.mapInPandas(run, schema)
