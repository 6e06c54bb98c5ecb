"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o, rotated at random, keeps one sign a dimension as its code o' and one correction factor f = <o', o>.
For any unit q, <o', q> / f estimates <o, q> without bias, and its error is at most g * sqrt(1 - <o, q>**2) with
g = sqrt(1 - f*f) / f, of which a random rotation uses about 1 / sqrt(d - 1). A pair that could reach the threshold by the
bound is recomputed exactly in double precision; the bound holds for certain, so no link is lost.

Vectors are compared within their label only, tile against tile. A tile returns a count and one tie a vector, not
pairs, so dense groups cost no more rows than others; equal vectors are one node from the start.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import connected_components, small, stored, with_columns

#: Vectors of a label in one block, or as many as make VALUES numbers; a tile is two blocks.
BLOCK, VALUES, STRIP = 2048, 1 << 19, 256
SEED = 20240601
_rotations: dict = {}


def rotation(d: int):
    """A random orthogonal matrix, the same on all machines for a dimension."""
    if d not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
        _rotations[d] = q * np.sign(np.diag(r))
    return _rotations[d]


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(vectors):
    """-> (packed sign bits, correction factor) of each vector; vectors of any dimensions."""
    codes, factors = [None] * len(vectors), np.zeros(len(vectors))
    size = np.fromiter((len(v) for v in vectors), int, len(vectors))
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        turned = units(np.array([vectors[i] for i in at], np.float64)) @ rotation(d).T
        bits = np.packbits(turned > 0, axis=1)
        factors[at] = np.abs(turned).sum(1) / np.sqrt(d)
        for i, b in zip(at, bits, strict=True):
            codes[i] = b.tobytes()
    return codes, factors


def signs(codes, d: int):
    """Codes as rows of +-1 / sqrt(d)."""
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=d)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def could_link(code_rows, factors, turned, threshold: float):
    """Which pairs (code, rotated unit query) may have a cosine of threshold or more."""
    f = factors.astype(np.float32)
    slack = np.sqrt(np.maximum(1 - f * f, 0)) / f * np.float32(np.sqrt(max(1 - threshold**2, 0)))
    return code_rows @ turned.T / f[:, None] >= (np.float32(threshold) - slack - np.float32(1e-4))[:, None]


class Ties:
    """Components of a tile's nodes, merged a row of links at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def row(self, i: int, cols) -> None:
        roots = np.unique(np.append(self.of[cols], self.of[i]))
        if len(roots) > 1:
            self.of[np.isin(self.of, roots)] = roots[0]


def compare(left, right, same: bool, threshold: float):
    """left, right: (vectors, codes, factors, copies) -> (weights linked to each left, to each right, Ties)."""
    (x, codes, f, wx), (y, _, _, wy) = left, right
    x, y = units(x), units(y)
    rows, turned = signs(codes, x.shape[1]), (y @ rotation(x.shape[1]).T).astype(np.float32)
    to_x, to_y, ties = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Ties(len(x) + (0 if same else len(y)))
    for a in range(0, len(x), STRIP):
        b = min(a + STRIP, len(x))
        maybe = could_link(rows[a:b], f[a:b], turned, threshold)
        if same:
            maybe &= np.arange(a, b)[:, None] < np.arange(len(y))[None, :]
        r, c = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(r):
            continue
        link = np.zeros_like(maybe)
        link[np.ix_(r, c)] = maybe[np.ix_(r, c)] & (x[a + r] @ y[c].T >= threshold)
        to_x[a:b] += link @ wy
        to_y += wx[a:b] @ link
        for i in np.flatnonzero(link.any(1)):
            ties.row(a + i, np.flatnonzero(link[i]) + (0 if same else len(x)))
    return to_x, to_y, ties


def tile(threshold: float):
    def run(t):
        import pandas as pd

        same = t.lo.iloc[0] == t.hi.iloc[0]
        sides = [t] if same else [t[t.block == t.lo.iloc[0]], t[t.block == t.hi.iloc[0]]]
        if not all(len(s) for s in sides):
            return pd.DataFrame({"node": pd.array([], "int64"), "weight": pd.array([], "int64"), "tie": pd.array([], "int64")})
        parts = [(np.array(s.embedding.tolist(), np.float64), s.code.tolist(), s.factor.to_numpy(), s.copies.to_numpy()) for s in sides]
        to_x, to_y, ties = compare(parts[0], parts[-1], same, threshold)
        ids = np.concatenate([s.node.to_numpy() for s in sides])
        weight = to_x + to_y if same else np.concatenate([to_x, to_y])
        on = weight > 0
        return pd.DataFrame({"node": ids[on], "weight": weight[on], "tie": ids[ties.of[on]]})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link at a cosine of `threshold` or more. Null vectors, those of
    no or only zero components, with a null or non-finite one, or without vec_id or label link with nothing: 0 links,
    and their own vec_id (which may be null) as component. Repeated rows are vectors of their own.
    """
    v = vectors.select("vec_id", "label", "embedding")
    fit = F.coalesce(
        F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0),
        F.lit(False),
    )
    good = v.where(fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = with_columns(nodes, "embedding", encode, "code binary, factor double", keep_column=True)
    # written first, so that the ids that the rows get are kept
    nodes = stored(
        stored(nodes, "embed-codes").withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("embedding")),
        "embed-nodes",
    )
    blocks = small(
        stored(
            nodes.groupBy("label", "d").agg(
                F.ceil(F.count("*") / F.greatest(F.lit(BLOCK), F.floor(VALUES / F.col("d")))).cast("int").alias("blocks")
            ),
            "embed-blocks",
        )
    )
    dealt = nodes.join(blocks, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    met = stored(
        dealt.select(
            "label", "d", "lo", "hi", "block", "node", "embedding", "code", "factor", "copies",
        ).groupBy("label", "d", "lo", "hi").applyInPandas(tile(threshold), "node long, weight long, tie long"),
        "embed-met",
    )
    comp = connected_components(met.select(F.col("node").alias("src"), F.col("tie").alias("dst")))
    roots = nodes.select("node", "id").join(
        comp.withColumnRenamed("id", "node"), "node", "left",
    ).withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    weights = met.groupBy("node").agg(F.sum("weight").alias("weight"))
    known = nodes.join(roots.select("node", "root"), "node").join(weights, "node", "left").join(least, "root")
    known = stored(
        known.select("label", "embedding", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"),
        "embed-known",
    )
    on = ["label", "embedding"]
    out = v.where("vec_id is not null").join(known, on, "left").unionByName(v.where("vec_id is null"), allowMissingColumns=True)
    # an unfit vector equals no node: nodes hold fit ones only
    own = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
