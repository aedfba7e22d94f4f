"""Toxicity by averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word bounds) and itself, hashed to ``BUCKETS``
embeddings; a passage of ``PASSAGE`` words is the average of its words' bags, followed by a
linear softmax of two classes. A word never seen in training, such as a misspelling, shares
most n-grams with the spelling that was. Texts may be long and only a few words toxic, so a
text's logit is the softmax-weighted mean of its passages' logits, in training and in scoring.

The model is linear in the average, so a word's part of the logit is one number. Scoring is
one map over whole texts with those numbers in a task's cache; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import is_held_out, sample_ids, sample_rows
from .words import mix, release, slices

WORD = re.compile(r"[^\W_]+")
BITS = 18
BUCKETS = 1 << BITS
PRIME = np.uint64(0x100000001B3)
POWERS = np.multiply.accumulate(np.full(1 << 16, PRIME, dtype=np.uint64))
DIM = 8
PASSAGE = 2
SHARPNESS = 2.0
CACHE = 1 << 17


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number of them per word): n-grams of 3 to 5 characters, bounds included, and the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(c))  # characters up to the word's end
    h, found, of = c, [], []
    for n in range(2, 6):
        h = h[: len(c) - n + 1] * PRIME + c[n - 1 :] if n <= len(c) else h[:0]
        if n >= 3:
            ok = left[: len(h)] >= n
            found.append((mix(h[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(word[: len(h)][ok])
    place = (np.arange(len(c)) - first[word]) & 0xFFFF
    found.append((mix(np.add.reduceat(c * POWERS[place], first)) >> np.uint64(64 - BITS)).astype(np.int64))
    of.append(np.arange(len(words)))
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], np.bincount(of, minlength=len(words))


def passages(z: np.ndarray) -> np.ndarray:
    """Mean of each run of PASSAGE words; of all words if there are fewer."""
    n = min(PASSAGE, len(z))
    c = np.concatenate([[0.0], np.cumsum(z)])
    return (c[n:] - c[:-n]) / n


def pooled(logits: np.ndarray) -> float:
    a = np.exp(SHARPNESS * (logits - logits.max()))
    return float((a * logits).sum() / a.sum())


def train(texts: list[str], y: list[int], epochs: int = 60, rate: float = 0.05, decay: float = 6e-2, seed: int = 7, balance: float = 0.5) -> tuple[np.ndarray, float]:
    """(each bucket's part of the logit, bias). Embeddings and softmax are learnt together by Adam on all texts.

    Without texts of both labels every text gets the share of label 1 (0.5 without any).
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in keep], y[keep]
    vocabulary = list(number)
    parts = [bags(vocabulary[i : i + 16384]) for i in range(0, len(vocabulary), 16384)]
    feat, size = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([n for _, n in parts])
    del parts, vocabulary
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    blocks = list(_blocks(docs))  # memory grows with the sample's words only by four bytes each

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 1.0, (DIM, 2)).astype(np.float32)
    b = np.zeros(2)
    weight = np.where(y == 1, ((y == 0).sum() / (y == 1).sum()) ** balance, 1.0)
    weight /= weight.sum()
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for step in range(1, epochs + 1):
        u = w[:, 1] - w[:, 0]
        s = e @ u
        z = np.add.reduceat(s[feat], first) / size
        gz, gb = np.zeros(len(number)), 0.0
        for at, words, lens in blocks:
            n = np.minimum(lens, PASSAGE)
            count = lens - n + 1
            doc_of = np.repeat(np.arange(len(lens)), count)
            begin = np.arange(len(doc_of)) + np.repeat(np.cumsum(lens) - lens - np.cumsum(count) + count, count)
            width = n[doc_of]
            c = np.concatenate([[0.0], np.cumsum(z[words], dtype=np.float64)])
            p = (c[begin + width] - c[begin]) / width + (b[1] - b[0])
            starts = np.cumsum(count) - count
            a = np.exp(SHARPNESS * (p - np.maximum.reduceat(p, starts)[doc_of]))
            a /= np.add.reduceat(a, starts)[doc_of]
            logit = np.add.reduceat(a * p, starts)
            part = slice(at, at + len(lens))
            g = weight[part] * (1 / (1 + np.exp(-logit)) - y[part])
            gp = a * g[doc_of] / width
            edge = np.bincount(begin, gp, len(words) + 1) - np.bincount(begin + width, gp, len(words) + 1)
            gz += np.bincount(words, np.cumsum(edge)[:-1], len(number))
            gb += g.sum()
        gs = np.bincount(feat, np.repeat((gz / size).astype(np.float32), size), BUCKETS).astype(np.float32)
        gu = e.T @ gs
        grads = [gs[:, None] * u[None, :] + np.float32(decay / len(y)) * e, np.stack([-gu, gu], 1) + decay * w, np.array([-gb, gb])]
        for x, d, (m, v) in zip((e, w, b), grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def _blocks(docs: list[np.ndarray], most: int = 1 << 17):
    """(first document, words, words a document) of stretches of about ``most`` words."""
    at = 0
    size = np.cumsum([len(d) for d in docs])
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, np.concatenate(docs[at:to]), np.array([len(d) for d in docs[at:to]])
        at = to


class Scorer(dict):
    """Word -> its part of the logit, kept while there is room."""

    def __init__(self, parts: np.ndarray, bias: float):
        super().__init__()
        self.parts, self.bias = parts, bias

    def scores(self, texts: list[str | None]) -> list[float]:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for f in found for w in f}.difference(self))
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list({w for f in found for w in f})
        if new:
            feat, size = bags(new)
            self.update(zip(new, (np.add.reduceat(self.parts[feat], np.cumsum(size) - size) / size).tolist(), strict=True))
        out = []
        for f in found:
            z = np.fromiter(map(self.__getitem__, f), float, len(f))
            logit = (pooled(passages(z)) if len(z) else 0.0) + self.bias
            out.append(float(1 / (1 + np.exp(-min(max(logit, -60.0), 60.0)))))
        return out


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["i", "t"])
    parts, bias = train(rows["t"].tolist(), rows["y"].tolist())
    release()
    return pd.DataFrame({"parts": [parts.tobytes()], "bias": [bias]})


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", most: int = 2500, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, held_out, score, predicted[, keep]) of every row, from its whole text.

    Fits on at most ``most`` labelled rows of each label, chosen by the hash of their id, from
    rows that aren't held out. Texts that are null, empty or without words get the bias alone.
    Rows, repeats and null ids are kept; other columns are ignored.
    """
    known = sample_ids(labels, label, most, id_col)
    model = None
    if known:
        # The bounded sample is fitted in one task, which keeps it out of the driver's memory.
        sample = sample_rows(docs, known, [F.coalesce(F.col(text), F.lit("")).alias("t")], id_col, text).select(F.col(id_col).alias("i"), "y", "t", (F.col("y") * 0).alias("all"))
        found = sample.groupBy("all").applyInPandas(_fit, "parts binary, bias double").first()
        model = found and (np.frombuffer(found.parts, np.float32), found.bias)
    model = model or train([], [])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys((id_col, *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches, text, 2 << 20):
            got = scorer.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([is_held_out(x) for x in batch.column(id_col).to_pylist()], pa.bool_()),
                    pa.array(got, pa.float64()),
                    pa.array([int(x >= threshold) for x in got], pa.int32()),
                ],
                [*names, "held_out", "score", "predicted"],
            )
        del scorer
        release()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys((*names, text))).mapInArrow(run, f"{kept}, held_out boolean, score double, predicted int")
