"""Quality by supervised subword embeddings.

A document is the average of learned vectors of its hashed features. Half of the weight is its words: a word is the average
of its own vector and those of its character n-grams, punctuation included. The other half is word bigrams, in which a
word is written by how long ago the text last used it (never, or 1, 2, 3-4, 5-8, ... words ago), so that what holds for
repetition holds for any word. A softmax over two classes reads that average; vectors and softmax are trained together by
stochastic gradient descent in numpy. As all after the lookup is linear, scoring needs one number a bucket.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import vectext as V
from tarnwatch.llm.common import held_out, where_values, with_columns
from tarnwatch.llm.toxicity import fitted, labelled

BITS, WIDTH = 17, 8
PREFIXES, INNER = (), (1, 2, 3, 4)
#: Bound of the fit: labelled rows a class; everything else covers all rows.
FIT_ROWS = 2500
EPOCHS, RATE, SEED = 6, 0.5, 7


def bucket(hashes):
    return (hashes >> V.U(64 - BITS)).astype(np.int64)


def bigrams(which, doc):
    """The bucket of each token's bigram of (word before, word), both by the distance to their last use in the text."""
    n = len(which)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((np.arange(n), which, doc))
    again = (which[order][1:] == which[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    since = np.zeros(n, np.int64)
    since[order[1:][again]] = np.diff(order)[again]
    symbol = np.where(since > 0, 1 + np.ceil(np.log2(np.maximum(since, 1))).astype(np.int64), 0)
    before = np.where(np.append(False, doc[1:] == doc[:-1]), np.append(0, symbol[:-1]), 63)
    return bucket(V.mix((before * 64 + symbol + 1).astype(V.U) * V.BASE))


def features(data: list):
    """-> (feature, its word, word of each token, bigram of each token, doc of each token)"""
    chunk = V.Chunk(data, V.SPACE)
    words, first, which = np.unique(chunk.words(), return_index=True, return_inverse=True)
    feature, owner = V.ngrams(chunk, chunk.start[first], chunk.end[first], INNER, PREFIXES)
    return bucket(feature), owner, which, bigrams(which, chunk.doc), chunk.doc


def doc_bags(texts):
    """For each text (in order) its distinct buckets and their shares of the whole weight."""
    out = [None] * len(texts)
    for own, data in V.chunks(texts):
        feature, owner, which, pairs, doc = features(data)
        order = np.argsort(owner, kind="stable")
        feature, start = feature[order], np.searchsorted(owner[order], np.arange(owner.max() + 2 if len(owner) else 1))
        ends = np.searchsorted(doc, np.arange(len(data) + 1))
        for k, i in enumerate(own):
            words, times = np.unique(which[ends[k] : ends[k + 1]], return_counts=True)
            size = start[words + 1] - start[words]
            at = np.repeat(start[words], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pair = pairs[ends[k] : ends[k + 1]]
            ids, inverse = np.unique(np.append(feature[at], pair), return_inverse=True)
            share = np.bincount(inverse, np.append(np.repeat(times / size, size), np.ones(len(pair))), len(ids))
            out[i] = (ids.astype(np.int32), (share / max(share.sum(), 1e-9)).astype(np.float32))
    return out


def fit(texts: list, y) -> tuple:
    """(score of each bucket, bias) after SGD with a linearly falling rate; equal data give equal models."""
    y = np.asarray(y, np.int64)
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(0, np.float32), float(np.log(base / (1 - base)))
    bags = doc_bags(texts)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (size, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[ids]
            h = share @ own
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # a bucket's step is scaled by its share's root, so that rare features learn too
            vectors[ids] = own - (rate * 4 * np.sqrt(share))[:, None] * (p @ out)[None, :]
            out -= rate * np.outer(p, h)
            bias -= 0.1 * rate * p
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts, model):
    table, bias = model
    score = np.full(len(texts), 1 / (1 + np.exp(-bias)))
    for own, data in V.chunks(texts) if len(table) else ():
        feature, owner, which, pairs, doc = features(data)
        n_words = int(owner.max()) + 1 if len(owner) else 0
        word = np.bincount(owner, table[feature], n_words) / np.maximum(np.bincount(owner, minlength=n_words), 1)
        tokens = np.bincount(doc, minlength=len(data))
        z = np.bincount(doc, word[which] + table[pairs], len(data)) / np.maximum(2 * tokens, 1) + bias
        score[np.array(own)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return score


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS) -> tuple:
    return fitted(labelled(docs, labels, target, rows), fit)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted.

    A null or empty text has no feature and scores by the bias alone. Each input row gives one row; with labels of
    one class only (or none) every score is the smoothed share of good ones.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))
    out = with_columns(
        docs.select("doc_id", held_out().alias("held_out"), "text"), "text", lambda texts: [scores(texts, model.value)], "score double",
    )
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score at least the threshold, with all their columns; null and empty texts score by the bias.

    Without usable labels of both classes there is no model, and all documents stay.
    """
    fitted_ = train(docs, labels, rows=rows)
    if not len(fitted_[0]):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted_)
    return where_values(docs, "text", lambda texts: scores(texts, model.value) >= threshold)
