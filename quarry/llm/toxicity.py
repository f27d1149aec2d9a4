"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a word are a hashed word embedding and the scaled sum of embeddings of
its hashed character n-grams (3, 5 and 7 with word ends); both start from smoothed class log-odds of the training
rows.  The network reads windows of WINDOW words that overlap by WINDOW - STRIDE
and cover the whole text; a document's score is its highest window's logit,
passed through a logistic curve fitted on the training rows.  Everything is
trained in numpy, on the driver or in one task (`train`), on at most
MAX_POSITIVE + MAX_NEGATIVE labelled documents (the first of each class by hash), and
the fitted arrays, about 1 MB, are broadcast.  `fit` goes on from there where more rows
are labelled: all of them are dealt to shards, each task moves the network along the
gradients of its shard, and the mean over all rows is the model; its logistic curve
is fitted on the scores of all labelled rows.

Defined results: null and empty texts are one window without words, with the
score of an all-padding window; repeated rows score alike; a null id is never
held out; without labels of both classes the score is the share of positives
(0.5 without any); other columns are not read.  Scoring shuffles nothing and its
memory is bounded by one piece of a batch; only a single text can exceed that.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, work

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 5, 7)
MAX_POSITIVE, MAX_NEGATIVE = 700, 1400
#: Embeddings, which start from priors, move at a lower rate.
STEPS, MIN_EPOCHS, MAX_EPOCHS, BATCH, RATE, EMBEDDING_RATE = 320, 4, 12, 128, 0.01, 0.001
#: Input rows of so many distinct words are kept between the pieces of a task.
CACHED_WORDS = 120_000
#: Words whose n-grams are hashed at once.
WORDS_AT_ONCE = 20_000
#: Labelled rows of a task that goes on from the first network, and its share of the rates.
SHARD_ROWS, LATER_RATE = 2048, 0.1
#: Parts of what shards sum up, and bins of scores (LOW to -LOW) by class.
PARTS, BINS, LOW = 64, 1024, -32.0
THRESHOLD = 0.3


#: By code point: 0 where not looked up yet, 1 if no word character, 2 if one (as \w has them).
_kinds = np.zeros(sys.maxunicode + 1, dtype=np.int8)


def _in_words(chars: np.ndarray) -> np.ndarray:
    """Which code points are word characters."""
    fresh = np.unique(chars[_kinds[chars] == 0])
    _kinds[fresh] = [2 if chr(c).isalnum() or c == ord("_") else 1 for c in fresh.tolist()]
    return _kinds[chars] == 2


def features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, flat n-gram buckets and their offsets for each distinct word, without what is no word character at its ends."""
    parts = [_features(distinct[a : a + WORDS_AT_ONCE]) for a in range(0, max(1, len(distinct)), WORDS_AT_ONCE)]
    ids, grams, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return ids, grams, np.concatenate([[0], np.cumsum(sizes)])


def _features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of some words, with their numbers of n-grams; the n-grams are hashed together, so that none becomes a Python object."""
    n_words = len(distinct)
    chars = np.frombuffer("".join(distinct).encode("utf-32-le"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, distinct), dtype=np.int64, count=n_words))])
    inner = np.flatnonzero(_in_words(chars))
    at = np.searchsorted(inner, offsets)
    some = np.diff(at) > 0
    first, size = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    first[some] = inner[at[:-1][some]]
    size[some] = inner[at[1:][some] - 1] + 1 - first[some]
    # <word> after <word>, as code points and as bytes.
    wide = size + 2
    begin = np.cumsum(wide) - wide
    marked = np.full(wide.sum() + max(GRAMS), ord(">"), dtype=np.uint32)
    marked[begin] = ord("<")
    marked[np.arange(size.sum()) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)] = chars[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]
    raw = marked.tobytes().decode("utf-32-le").encode()
    start = np.concatenate([[0], np.cumsum(1 + (marked >= 0x80) + (marked >= 0x800) + (marked >= 0x10000))])
    cuts = zip(start[begin + 1].tolist(), start[begin + 1 + size].tolist(), strict=True)
    ids = (np.fromiter((xxhash.xxh64_intdigest(raw[i:j]) for i, j in cuts), dtype=np.uint64, count=n_words) % np.uint64(WORD_BUCKETS)).astype(np.int32)
    n = np.maximum(wide[:, None] - np.array(GRAMS) + 1, 0)
    n[~some] = [1, *[0] * (len(GRAMS) - 1)]  # bucket 0, where nothing is left
    n = n.ravel()
    ends = np.concatenate([[0], np.cumsum(n)])
    c = np.arange(ends[-1]) + np.repeat(np.repeat(begin, len(GRAMS)) - ends[:-1], n)
    grams = _xxh32(raw, start.take(c), start.take(c + np.repeat(np.tile(GRAMS, n_words), n)))
    ends = ends[:: len(GRAMS)]
    grams[ends[:-1][~some]] = 0
    return ids, grams, np.diff(ends)


def _xxh32(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The CHAR_BUCKETS of raw[start:stop], by xxh32; those of one length together, over 15 bytes one by one."""
    p1, p2, p3, p4, p5 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    data *= p5
    four *= p3
    width, out = (stop - start).astype(np.uint8), np.empty(len(start), np.int32)
    for w in np.flatnonzero(np.bincount(width)).tolist():
        at = np.flatnonzero(width == w)
        s = start[at]
        if w > 15:
            out[at] = [xxhash.xxh32_intdigest(raw[i : i + w]) % CHAR_BUCKETS for i in s.tolist()]
            continue
        h, k = np.full(len(s), p5 + np.uint32(w)), 0
        while k + 4 <= w:
            h += four.take(s + k)
            h = (h << np.uint32(17) | h >> np.uint32(15)) * p4
            k += 4
        for j in range(k, w):
            h += data.take(s + j)
            h = (h << np.uint32(11) | h >> np.uint32(21)) * p1
        h ^= h >> np.uint32(15)
        h *= p2
        h ^= h >> np.uint32(13)
        h *= p3
        out[at] = (h ^ h >> np.uint32(16)) % np.uint32(CHAR_BUCKETS)
    return out


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (windows x WINDOW, -1 for padding) and the row of each window; the last window ends with the text."""
    n = np.diff(offsets)
    per = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < n[row][:, None], at + offsets[row][:, None], -1), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    known: dict[str, int] | None = None
    rows: np.ndarray | None = None

    @staticmethod
    def start(word_prior: np.ndarray, char_prior: np.ndarray, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"words": f(WORD_BUCKETS, WORD_DIM, s=0.05), "chars": f(CHAR_BUCKETS, CHAR_DIM, s=0.05)}
        p["words"][:, 0], p["chars"][:, 0] = word_prior, char_prior
        p |= {"wx": f(2, d, 3 * h, s=0.4), "wh": f(2, h, 3 * h, s=0.3), "b": np.zeros((2, 1, 3 * h), np.float32)}
        p |= {"attend": f(2 * h, s=0.3), "out": f(2 * h, s=0.3), "bias": np.full(1, -2, np.float32)}
        return Network(p)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each distinct word, and a row of zeros for padding."""
        chars = np.add.reduceat(self.p["chars"][grams], ends[:-1], axis=0) / np.sqrt(np.diff(ends))[:, None] if len(ids) else np.zeros((0, CHAR_DIM))
        x = np.concatenate([self.p["words"][ids], chars], axis=1, dtype=np.float32, casting="unsafe")
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])

    def cached_inputs(self, distinct: list[str]) -> np.ndarray:
        """inputs(), with the rows of words seen in earlier pieces kept up to CACHED_WORDS."""
        if self.known is None or len(self.known) + len(distinct) > CACHED_WORDS:
            self.known, self.rows = {}, np.zeros((CACHED_WORDS, WORD_DIM + CHAR_DIM), np.float32)
        fresh = [w for w in distinct if w not in self.known]
        if len(distinct) > CACHED_WORDS:
            return self.inputs(*features(distinct))
        n = len(self.known)
        self.rows[n : n + len(fresh)] = self.inputs(*features(fresh))[:-1]
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        at = np.fromiter((self.known[w] for w in distinct), dtype=np.int64, count=len(distinct))
        return np.concatenate([self.rows[at], np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x[None], self.p["wx"]) + self.p["b"]

    def forward(self, x: np.ndarray, codes: np.ndarray, keep: bool = False, px: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Logits of windows of codes into x; a code of len(x) - 1 is padding.  px: project(x), if it is known."""
        p, h = self.p, HIDDEN
        n, steps = codes.shape
        px = self.project(x) if px is None else px
        pad = codes.T == len(x) - 1
        any_pad = bool(pad.any())
        state = np.zeros((2, n, h), np.float32)
        both = np.empty((2, steps, n, h), np.float32)
        saved = []
        for t in range(steps):
            here = (codes[:, t], codes[:, steps - 1 - t])
            g = np.stack([px[0][here[0]], px[1][here[1]]])
            u = np.matmul(state, p["wh"])
            zr = _sigmoid(g[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            new = c + z * (state - c)
            if any_pad:  # padding leaves the state as it is
                hold = np.stack([pad[t], pad[steps - 1 - t]])[..., None]
                new = np.where(hold, state, new)
            if keep:
                saved.append((state, z, r, c, u[..., 2 * h :]))
            state = new
            both[0, t], both[1, steps - 1 - t] = state[0], state[1]
        seen = np.concatenate([both[0], both[1]], axis=2)
        a = seen @ p["attend"]
        if any_pad:
            a = np.where(pad, np.float32(-1e9), a)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, seen)
        return pooled @ p["out"] + p["bias"][0], (saved, seen, a, pooled, pad, any_pad)

    def gradients(self, x: np.ndarray, codes: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        p, h = self.p, HIDDEN
        saved, seen, a, pooled, pad, any_pad = kept
        steps = codes.shape[1]
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["out"]
        dseen = a[..., None] * dpool
        da = np.einsum("tnk,nk->tn", seen, dpool)
        ds = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnk->k", ds, seen)
        dseen = dseen + ds[..., None] * p["attend"]
        g |= {k: np.zeros_like(p[k]) for k in ("wh", "wx", "b")}
        dpx = np.zeros((2, len(x), 3 * h), np.float32)
        dstate = np.zeros((2, len(codes), h), np.float32)
        for t in reversed(range(steps)):
            state, z, r, c, un = saved[t]
            dnew = dstate + np.stack([dseen[t, :, :h], dseen[steps - 1 - t, :, h:]])
            hold = np.stack([pad[t], pad[steps - 1 - t]])[..., None] if any_pad else False
            live = np.where(hold, 0, dnew) if any_pad else dnew
            dz, dc = live * (state - c) * z * (1 - z), live * (1 - z) * (1 - c * c)
            dr = dc * un * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            dg = np.concatenate([dz, dr, dc], axis=2)
            g["wh"] += np.matmul(state.transpose(0, 2, 1), du)
            dstate = live * z + np.matmul(du, p["wh"].transpose(0, 2, 1))
            if any_pad:
                dstate = dstate + np.where(hold, dnew, 0)
            np.add.at(dpx[0], codes[:, t], dg[0])
            np.add.at(dpx[1], codes[:, steps - 1 - t], dg[1])
        dpx[:, -1] = 0
        g["b"] = dpx.sum(axis=1, keepdims=True)
        g["wx"] = np.matmul(x.T[None], dpx)
        dx = np.matmul(dpx, p["wx"].transpose(0, 2, 1)).sum(axis=0)
        return g, dx

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        """The highest window's logit for each text."""
        codes, offsets, distinct = ragged.words(texts)
        x = self.cached_inputs(distinct)
        at, row = windows(offsets)
        return np.maximum.reduceat(self.score_windows(x, np.append(codes, len(x) - 1)[at]), np.flatnonzero(np.diff(row, prepend=-1)))

    def score_windows(self, x: np.ndarray, codes: np.ndarray, size: int = 2048) -> np.ndarray:
        out, px = np.empty(len(codes), np.float32), self.project(x)
        # Windows with padding go together, so that the others need no masks.
        order = np.argsort(codes[:, -1] == len(x) - 1, kind="stable")
        full = int((codes[:, -1] != len(x) - 1).sum())
        for a, b in [*((k, min(k + size, full)) for k in range(0, full, size)), *((k, min(k + size, len(codes))) for k in range(full, len(codes), size))]:
            out[order[a:b]] = self.forward(x, codes[order[a:b]], px=px)[0]
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def _log_odds(counts: np.ndarray, share: float, smooth: float = 10.0) -> np.ndarray:
    """Smoothed log-odds of the documents that hold a bucket, against the prior; counts holds negatives and positives.

    Two positives count for nothing: else rare words of the training rows would look toxic in these rows alone."""
    odds = (np.maximum(counts[1] - 2, 0) + smooth * share) / (counts[0] + smooth * (1 - share))
    return np.clip(np.log(odds) - np.log(share / (1 - share)), -3, 3).astype(np.float32)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Network | float:
    """A network, or the share of positives where a class is missing."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    codes, offsets, distinct = ragged.words(pa.array(texts, pa.large_string()))
    ids, grams, ends = features(distinct)
    sizes = np.diff(ends)
    in_words, in_grams = np.zeros((2, WORD_BUCKETS)), np.zeros((2, CHAR_BUCKETS))
    for d, label in enumerate(labels.astype(int)):  # documents that hold each bucket, by class
        w = np.unique(codes[offsets[d] : offsets[d + 1]])
        in_words[label, np.unique(ids[w])] += 1
        n = sizes[w]
        in_grams[label, np.unique(grams[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[w], n)])] += 1
    net = Network.start(_log_odds(in_words, labels.mean()), _log_odds(in_grams, labels.mean()), seed)
    at, row = windows(offsets)
    win = np.append(codes, len(distinct)).astype(np.int32)[at]
    del at, codes
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    r = np.random.default_rng(seed)
    # A window first stands by its words' priors, in the second half of the epochs by the network.
    of_word = np.maximum(net.p["words"][ids, 0], np.maximum.reduceat(net.p["chars"][grams, 0], ends[:-1]))
    prior = np.append(np.maximum(of_word - 0.5, 0) ** 2, 0)[win].sum(axis=1)
    worst = prior
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    highest = lambda by: (order := np.lexsort((-by, row)))[np.searchsorted(row[order], np.arange(len(labels)))]
    n_batches = -(-(len(labels) + int((labels == 0).sum())) // BATCH)
    epochs = min(MAX_EPOCHS, max(MIN_EPOCHS, -(-STEPS // n_batches)))
    for epoch in range(epochs):
        top = np.where(labels == 1, highest(prior if 2 * epoch < epochs else worst), highest(worst))
        other = starts + (r.random(len(labels)) * np.diff(np.append(starts, len(row)))).astype(np.int64)
        chosen = np.concatenate([top, other[labels == 0]])
        target = labels[row[chosen]]
        shuffled = r.permutation(len(chosen))
        step = _descend(net, state, step, (ids, grams, ends), win, chosen, target, shuffled)
        x = net.inputs(ids, grams, ends)
        worst = net.score_windows(x, win)
    _calibrate(net, np.maximum.reduceat(worst, starts), labels)
    del win, state, x, ids, grams, ends, distinct
    ragged.release()  # the driver has other stages to run
    return net


def _descend(net: Network, state: dict, step: int, words: tuple[np.ndarray, np.ndarray, np.ndarray], win: np.ndarray, chosen: np.ndarray, target: np.ndarray, shuffled: np.ndarray, rate: float = 1.0) -> int:
    """One pass over the chosen windows in batches; the number of steps so far."""
    ids, grams, ends = words
    sizes = np.diff(ends)
    for a in range(0, len(chosen), BATCH):
        pick = shuffled[a : a + BATCH]
        used, local = np.unique(win[chosen[pick]], return_inverse=True)
        local = local.reshape(len(pick), WINDOW)
        real = used[used < len(ids)]
        n = sizes[real]
        sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[real], n)
        sub_ends = np.concatenate([[0], np.cumsum(n)])
        x = net.inputs(ids[real], grams[sub], sub_ends)
        logit, kept = net.forward(x, local, keep=True)
        g, dx = net.gradients(x, local, kept, ((_sigmoid(logit) - target[pick]) / len(pick)).astype(np.float32))
        g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
        np.add.at(g["words"], ids[real], dx[:-1, :WORD_DIM])
        np.add.at(g["chars"], grams[sub], np.repeat(dx[:-1, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0))
        step += 1
        for k, v in g.items():  # Adam
            m, s = state[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            net.p[k] -= (rate * (EMBEDDING_RATE if k in ("words", "chars") else RATE) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return step


def _calibrate(net: Network, logit: np.ndarray, labels: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
    """scale and shift of the logistic curve, by Newton steps with a little ridge."""
    x = np.stack([logit, np.ones_like(logit)], axis=1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ w)
        grad = x.T @ (weight * (q - labels)) + 0.1 * (w - [1.0, 0.0])
        w -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    net.scale, net.shift = max(float(w[0]), 0.05), float(w[1])


def tuned(start: Network, texts: list[str | None], labels: np.ndarray, seed: int = 5) -> tuple[Network, np.ndarray]:
    """start after one pass over the rows' windows, and the rows' numbers by class and bin of their scores.

    A row stands by the window that its words' priors find worst, a negative by any other window too."""
    net = Network({k: v.copy() for k, v in start.p.items()}, start.scale, start.shift)
    codes, offsets, distinct = ragged.words(pa.array(texts, pa.large_string()))
    words = ids, grams, ends = features(distinct)
    at, row = windows(offsets)
    win = np.append(codes, len(distinct)).astype(np.int32)[at]
    del at, codes
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    of_word = np.maximum(net.p["words"][ids, 0], np.maximum.reduceat(net.p["chars"][grams, 0], ends[:-1])) if distinct else np.zeros(0)
    prior = np.append(np.maximum(of_word - 0.5, 0) ** 2, 0)[win].sum(axis=1)
    top = np.lexsort((-prior, row))[starts]
    r = np.random.default_rng(seed)
    other = starts + (r.random(len(labels)) * np.diff(np.append(starts, len(row)))).astype(np.int64)
    chosen = np.concatenate([top, other[labels == 0]])
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    _descend(net, state, 0, words, win, chosen, labels[row[chosen]], r.permutation(len(chosen)), LATER_RATE)
    logit = np.maximum.reduceat(net.score_windows(net.inputs(*words), win), starts)
    bins = np.clip((logit - LOW) * (BINS / (-2 * LOW)), 0, BINS - 1).astype(np.int64)
    return net, np.bincount(bins + BINS * (labels > 0), minlength=2 * BINS)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of the bounded sample; of equal texts the first by id counts, of the rows of one id the least text."""
    return _different(sampled(docs, labels, text, doc_id, label).toArrow().to_pylist())


def _labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """doc_id, y (1 if any of its labels is positive) of the ids that are not held out."""
    of = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id")))
    return of.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))


def sampled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, text, y of the sample: MAX_POSITIVE + MAX_NEGATIVE rows at most."""
    one = _labelled(labels, doc_id, label)
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = one.where("y = 1").orderBy(*by).limit(MAX_POSITIVE).unionByName(one.where("y = 0").orderBy(*by).limit(MAX_NEGATIVE))
    # At most MAX_POSITIVE + MAX_NEGATIVE rows of two numbers, and one text for each: bounded whatever the input repeats.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def _different(found: list[dict]) -> tuple[list[str | None], np.ndarray]:
    first: dict[str | None, tuple] = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["text"] or "")):
        first.setdefault(r["text"], (r["text"], r["y"]))
    return [t for t, _ in first.values()], np.array([y for _, y in first.values()], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Network | float:
    """train() on the bounded sample inside one task, then, if more rows are labelled, refined() on all: the driver gets the fitted arrays alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(*_different([r for batch in batches for r in batch.to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        ragged.release()

    rows = sampled(docs, labels, text, doc_id, label)
    made = work.map_arrow(rows.repartition(1), run, "model binary").first()
    model = pickle.loads(made["model"]) if made else train([], np.zeros(0))
    one = work.save(_labelled(labels, doc_id, label), "labelled")
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if isinstance(model, float) or (n.get(1, 0) <= MAX_POSITIVE and n.get(0, 0) <= MAX_NEGATIVE):
        return model
    return refined(model, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(one, "doc_id"), sum(n.values()))


def refined(start: Network, rows: DataFrame, n_rows: int) -> Network:
    """The mean of what shards of all rows (doc_id, text, y) make of a network, by their rows; equal texts count once, with the label of the least id."""
    shared = rows.sparkSession.sparkContext.broadcast(start)
    names = sorted(start.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["h1"], r["h2"]))
        if not found:
            return
        net, seen = tuned(shared.value, [r["text"] for r in found], np.array([r["y"] for r in found], dtype=np.float64))
        flat = np.concatenate([len(found) * net.p[k].reshape(-1).astype(np.float64) for k in names] + [seen])
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS)), pa.array([x.astype(np.float32).tobytes() for x in np.array_split(flat, PARTS)], pa.binary())], ["part", "sums"])
        ragged.release()

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), dtype=np.float32) for x in group["sums"]], axis=0, dtype=np.float64)
        return pa.table({"part": group["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    keyed = rows.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "doc_id", "y", "text")
    once = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "y", "text")).alias("r")).select("h1", "h2", "r.y", "r.text")
    shards = once.repartition(max(1, -(-n_rows // SHARD_ROWS)), "h1", "h2")
    out = work.map_arrow(shards, run, "part long, sums binary").groupBy("part").applyInArrow(add, "part long, sums binary").toArrow().sort_by("part")
    if not out.num_rows:
        return start
    flat = np.concatenate([np.frombuffer(x.as_py(), dtype=np.float64) for x in out["sums"]])
    ends = np.cumsum([start.p[k].size for k in names])
    seen = flat[ends[-1] :].reshape(2, BINS)
    mean = np.split(flat[: ends[-1]] / seen.sum(), ends[:-1])
    net = Network({k: x.reshape(start.p[k].shape).astype(np.float32) for k, x in zip(names, mean, strict=True)}, start.scale, start.shift)
    y, at = np.nonzero(seen)
    _calibrate(net, LOW + (at + 0.5) * (-2 * LOW / BINS), y.astype(np.float64), seen[y, at])
    return net


def score(docs: DataFrame, model: Network | float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    return work.map_arrow(rows, _scorer(shared), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = wrapped.schema["row"].dataType.simpleString()
    return work.map_arrow(wrapped, _scorer(shared, text), f"row {kind}, predicted int").where("predicted = 0").select("row.*")


def _scorer(shared, of_row: str | None = None):
    """Scores rows of (doc_id, text, held_out), or of a struct `row` with the text in its field of_row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if of_row:
                row = batch.column("row")
                # The text is a view of the row's own, so that it crosses to Python once.
                batch = pa.RecordBatch.from_arrays([row, row.field(row.type.get_field_index(of_row)).cast(pa.string())], ["row", "text"])
            for piece in ragged.pieces(batch):
                texts = piece.column("text")
                p = np.full(len(texts), model) if isinstance(model, float) else model.probability(model.score_texts(texts))
                out = {"row": piece.column("row")} if of_row else {"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(p)}
                out["predicted"] = pa.array((p >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)
        if not isinstance(model, float):
            model.known = model.rows = None
        ragged.release()

    return run
