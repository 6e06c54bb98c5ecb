"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its distinct words' hashed
features (the word and its prefixes by characters); the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known: their gradient passes through the noisy-or to the sentences, so the
model also says which sentences offend.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm import vectext as V
from tarnwatch.llm.common import drop, held_out, stored, where_values, with_columns

BITS = 20
PREFIXES, INNER = (4, 5, 6, 7), ()
#: Bounds of the fit: labelled rows a class, and bytes of their texts in all; everything else covers all rows.
FIT_ROWS, FIT_BYTES = 3000, 64 << 20
STEPS, RATE, SPARSE, SHRINK, BIAS, BIAS_MOST = 90, 0.2, 0.5, 3.0, -6.0, -5.0


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents a class, none held out, by a hash of doc_id, and of these
    as many as hold at most `most` / 2 bytes a class (whole texts; the first one always).

    The broadcast sides have at most 2 x rows rows by construction. A doc_id that repeats counts once, with its least
    text and largest label.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(target).alias("y"))
    )
    # a label without a document must not use up the bound
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(rows).unionByName(
        known.where("y = 0").orderBy(order, "doc_id").limit(rows)
    )
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("y").alias("y"),
    )
    sample = stored(sample, "fit-sample")
    upto = W.partitionBy("y").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0)
    size = sample.select("doc_id", "y", F.octet_length("text").cast("long").alias("bytes"))
    size = size.withColumns(
        {"upto": F.sum("bytes").over(upto), "nth": F.count("*").over(upto)}
    ).where((F.col("upto") <= most // 2) | (F.col("nth") == 1))
    out = sample.join(F.broadcast(size.select("doc_id")), "doc_id", "left_semi")
    out._sample = sample
    return out


def sentences(chunk: V.Chunk):
    """For each word the number of its sentence; a sentence ends at . ! ? or a line's or text's end.

    Marks in a row (!!, ...) are emphasis and end nothing, so that shouted text is not a bag of one-word sentences.
    """
    ends = V.STOP[chunk.raw]
    mark = ends & (chunk.raw != 10)
    alone = ~(np.append(mark[1:], False) | np.append(False, mark[:-1])) if len(mark) else mark
    stops = np.concatenate(([0], np.cumsum(ends & (alone | ~mark))))
    return stops[chunk.start]


def bag(data: list):
    """Distinct words of a chunk's sentences and those words' features.

    -> (sentence of each entry, word of each entry, doc of each sentence, feature, word of each feature, chunk, first)
    """
    chunk = V.Chunk(data, ~V.LETTER, lower=True)
    words, first, which = np.unique(chunk.words(), return_index=True, return_inverse=True)
    sent, at, s = np.unique(sentences(chunk), return_index=True, return_inverse=True)
    entry = np.unique(s.astype(np.int64) * max(len(words), 1) + which)
    feature, owner = V.ngrams(chunk, chunk.start[first], chunk.end[first], INNER, PREFIXES)
    n = max(len(words), 1)
    return entry // n, entry % n, chunk.doc[at], (feature >> V.U(64 - BITS)).astype(np.int32), owner, chunk, (s, first)


def fit(texts: list, y) -> tuple:
    """(weights, bias) by full-batch proximal Adam on the bags' labels; equal data give equal weights.

    A feature starts at its shrunken log ratio of toxic to other documents, which points the first noisy-or at the
    right sentences; an L1 term keeps features that a document or two hold at 0.
    """
    y = np.asarray(y, np.float64)
    w, bias = np.zeros(1 << BITS), BIAS
    if not len(y) or y.min() == y.max():
        # no weights: every document scores the smoothed share of toxic labels, 0 without labels
        return np.zeros(0, np.float32), float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
    parts, order, docs, n_sent, n_word = [], [], 0, 0, 0
    for own, data in V.chunks(texts):
        s, word, doc, feature, owner, chunk, (_, first) = bag(data)
        parts.append((s + n_sent, word + n_word, doc + docs, feature, owner + n_word, chunk.of(chunk.start[first], chunk.end[first])))
        n_sent, n_word, docs = n_sent + len(doc), n_word + len(first), docs + len(data)
        order += own
    sent, word, doc, feature, owner, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # one word for all chunks, with the features of its first
    _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    lead = np.zeros(n_word, bool)
    lead[first] = True
    feature, owner, word, n_word = feature[lead[owner]], same[owner[lead[owner]]], same[word], len(first)
    y = y[order]
    held = np.unique(doc[sent].astype(np.int64) * n_word + word)
    in_toxic, in_other = (np.bincount(feature, np.bincount(held % n_word, c[held // n_word], n_word)[owner], len(w)) for c in (y, 1 - y))
    w = np.maximum(np.log((in_toxic + SHRINK) / (in_other * y.sum() / (1 - y).sum() + SHRINK)), 0)
    w[w < 0.7] = 0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, np.bincount(owner, w[feature], n_word)[word], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), docs))
        g = np.where(y == 1, -none / np.maximum(1 - none, 1e-12), 1.0)[doc] * p
        grad = np.append(np.bincount(feature, np.bincount(word, g[sent], n_word)[owner], len(w)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = RATE * (1 - step / (STEPS + 1)) / (np.sqrt(v / (1 - 0.99**step)) + SPARSE)
        move = rate * m / (1 - 0.9**step)
        w, bias = w - move[:-1], min(bias - move[-1], BIAS_MOST)
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * SPARSE, 0)
    return w.astype(np.float32), float(bias)


def scores(texts, model):
    """(score of each text, its sentences, the offending ones' (start, end) in bytes)."""
    w, bias = model
    score, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    spots = [[] for _ in texts]
    if not len(w):
        w, constant = np.zeros(1 << BITS, np.float32), bias
        bias = -30.0
    else:
        constant = None
    for own, data in V.chunks(texts):
        sent, word, doc, feature, owner, chunk, (s, first) = bag(data)
        z = bias + np.bincount(sent, np.bincount(owner, w[feature], len(first))[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        own = np.array(own)
        score[own] = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(data)))
        count[own] = np.bincount(doc, minlength=len(data))
        lead = np.flatnonzero(np.diff(s, prepend=-1))
        last = np.append(lead[1:], len(s)) - 1 if len(s) else lead
        begin = chunk.ends - np.array([len(b) + 1 for b in data])
        for k in np.flatnonzero(p >= 0.3):
            spots[own[doc[k]]].append((int(chunk.start[lead[k]] - begin[doc[k]]), int(chunk.end[last[k]] - begin[doc[k]]), float(p[k])))
    return score if constant is None else np.full(len(texts), constant), count, spots


def fitted(sample: DataFrame, fit) -> tuple:
    """fit(texts, labels) -> (array, number) of a bounded sample, run in one task: an executor's loss reruns it and
    the driver holds no texts."""

    def run(batches):
        import pyarrow as pa

        rows = sorted((r["doc_id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
        weights, bias = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"],
        )

    row = sample.select(
        "doc_id", "text", F.col("y").cast("int").alias("y"),
    ).coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    drop(sample._sample)
    return fit([], []) if row is None else (np.frombuffer(row.weights, np.float32), row.bias)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = FIT_ROWS) -> tuple:
    return fitted(labelled(docs, labels, target, rows), fit)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted, n_sentences, offending.

    `offending` lists the sentences of probability >= 0.3 as (text, p). A null or empty text has no sentence and
    scores 0. Each input row gives one row, repeated rows equal ones. Without usable labels every score is 0, with those of
    one class only the smoothed share of toxic ones.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))

    def score(texts):
        s, n, spots = scores(texts, model.value)
        raw = [t.encode("utf-8", "surrogatepass") if at else b"" for t, at in zip(texts, spots, strict=True)]
        return s, n, [[{"text": b[i:j].decode("utf-8", "replace"), "p": p} for i, j, p in at] for b, at in zip(raw, spots, strict=True)]

    out = with_columns(
        docs.select("doc_id", held_out().alias("held_out"), "text"), "text", score,
        "score double, n_sentences long, offending array<struct<text:string,p:double>>",
    )
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score below the threshold, with all their columns; null and empty texts stay.

    Without usable labels of both classes there is no model, and all documents stay.
    """
    fitted_ = train(docs, labels, rows=rows)
    if not len(fitted_[0]):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted_)
    return where_values(docs, "text", lambda texts: scores(texts, model.value)[0] < threshold)
