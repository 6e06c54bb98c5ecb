"""Near-duplicate join on five-word shingles with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by a fixed-size count sketch of the whole corpus. A document of n shingles
shows a prefix of n - ceil(0.8 n) + l of them; two similar sets share at least min(l, l') shingles of their prefixes,
so a longer prefix asks for more shared tokens before a pair is verified. Each document takes the l of least
estimated cost. Once both sizes are known, the pair's own needed overlap shortens both prefixes again.

Equal sets are one node from the start. What is asked for is components, so pairs inside one are not verified twice:
first each token's documents are checked against one of them (a star, not all pairs), and only documents of
different components then meet in the exact multi-match join.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm import vectext as V
from tarnwatch.llm.common import connected_components, drop, small, stored, with_columns

K = 5
#: The sketch: 2**SKETCH counters, in PARTS rows.
SKETCH, PARTS = 21, 128
MOST_L = 4
#: Cost of verifying a candidate against that of reading a posting, for each shingle of the document.
VERIFY = 0.02
#: A token of more documents than this (by the sketch, above its mean) is hot: its rows are never gathered by token.
HOT = 1000


def shingle_sets(texts, k: int = K):
    """(position, sorted distinct shingle hashes) of each text; ASCII case does not count."""
    for own, data in V.chunks(texts):
        chunk = V.Chunk(data, V.SPACE, lower=True)
        h, doc = chunk.words(), chunk.doc
        at = np.searchsorted(doc, np.arange(len(data) + 1))
        if len(h) >= k:
            grams = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                grams = V.mix(grams * V.U(5) + h[j : len(h) - k + 1 + j] + V.U(j + 1))
        else:
            grams = np.zeros(0, np.uint64)
        for i, a, b in zip(own, at[:-1], at[1:], strict=True):
            if b - a >= k:
                yield i, np.unique(grams[a : b - k + 1])
            elif b > a:
                g = np.array([b - a], np.uint64)
                for j in range(a, b):
                    g = V.mix(g * V.U(7) + h[j])
                yield i, g
            else:
                yield i, np.zeros(0, np.uint64)


def need(n, percent: int):
    """Least overlap of a set of n with a similar set."""
    return -(-n * percent // 100)


def prefix(tokens, load, percent: int):
    """(l, prefix, its loads): the l of least cost and that many tokens, rare ones first."""
    n = len(tokens)
    order = np.lexsort((tokens, load))
    base = n - need(n, percent)
    most = min(MOST_L, n - base)
    # most candidates are of about the document's size, and for those its prefix is this short
    short = n - -(-2 * percent * n // (100 + percent))
    upto = np.cumsum(load[order][: short + most].astype(np.float64))[short:]
    ls = np.arange(1, most + 1)
    # at most sum / l documents share l of the prefix's tokens
    cost = upto + upto / ls * VERIFY * n
    l = int(ls[cost.argmin()])
    return l, tokens[order[: base + l]], load[order[: base + l]]


def sketch(docs: DataFrame, k: int = K):
    """Counts of all documents' distinct shingles by their hash's leading bits: 2**SKETCH numbers, 16 MB, however large the corpus."""
    width = (1 << SKETCH) // PARTS

    def count(batches):
        import pandas as pd

        total = np.zeros(1 << SKETCH, np.int32)
        for x in batches:
            for _, tokens in shingle_sets(x.text.tolist(), k):
                at = (tokens >> V.U(64 - SKETCH)).astype(np.int64)
                np.add.at(total, at, 1)
        used = [i for i in range(PARTS) if total[i * width : (i + 1) * width].any()]
        yield pd.DataFrame(
            {"part": pd.array(used, "int32"), "counts": [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in used]}
        )

    def add(x):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for b in x.counts:
            part = np.frombuffer(zlib.decompress(b), np.uint8)
            total += part.view(np.int32 if len(part) == 4 * width else np.int64)
        return pd.DataFrame({"part": x.part[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = docs.select("text").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros(1 << SKETCH, np.int64)
    for r in rows:
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out


def signatures(docs: DataFrame, percent: int, k: int = K) -> DataFrame:
    """docs -> doc_id, node (of the shingle set), n, l, prefix and which of its tokens are hot."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, k))

    def sign(texts):
        import hashlib

        spread = np.maximum(counts.value - int(counts.value.mean()), 1)
        node, n, ls, pre, hot = [], [], [], [], []
        for _, tokens in shingle_sets(texts, k):
            n.append(len(tokens))
            node.append(hashlib.md5(tokens.tobytes()).digest())
            l, p, load = prefix(
                tokens, spread[(tokens >> V.U(64 - SKETCH)).astype(np.int64)], percent,
            ) if len(tokens) else (0, tokens, tokens)
            ls.append(l)
            pre.append(p.astype(np.int64))
            hot.append(load > HOT)
        return node, n, ls, pre, hot

    return with_columns(docs.select("doc_id", "text"), "text", sign, "node binary, n int, l int, prefix array<long>, hot array<boolean>")


def sets_of(docs: DataFrame, ids: DataFrame, k: int = K) -> DataFrame:
    """(id, tokens) of the documents whose doc_id is among ids (id); texts move only if small() does not broadcast the ids."""
    ids = small(stored(ids.withColumnRenamed("id", "doc_id"), "ngram-ids"))
    rows = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = with_columns(
        rows.select(F.col("doc_id").alias("id"), "text"), "text", lambda texts: [[t.astype(np.int64) for _, t in shingle_sets(texts, k)]],
        "tokens array<long>",
    )
    return stored(sets, "ngram-sets")


def verified(docs: DataFrame, pairs: DataFrame, percent: int, k: int = K) -> DataFrame:
    """Those (a, b) whose sets are similar; exact on 64-bit shingle hashes."""
    pairs = stored(pairs.select("a", "b"), "ngram-pairs")
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    a = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    alike = 100 * both >= percent * (F.size("ta") + F.size("tb") - both)
    out = stored(pairs.join(a, "a").join(b, "b").where(alike).select("a", "b").distinct(), "ngram-links")
    drop(sets)
    return out


def meets(a: str, b: str, percent: int):
    """Whether a token that two documents (n, l, pos) share counts for the pair: sizes that can be similar, and the
    token within the first n - overlap + l of both, where overlap is what sets of just these sizes need."""
    n, m, least = F.col(f"{a}.n"), F.col(f"{b}.n"), F.least(f"{a}.l", f"{b}.l")
    overlap = F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (F.col(f"{a}.pos") <= n - overlap + least) & (F.col(f"{b}.pos") <= m - overlap + least)


def shared_enough(met: DataFrame) -> DataFrame:
    """(a, b) of rows (a, b, least), a row a shared token, that share at least so many."""
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")


def beside(rows: DataFrame, made: dict) -> DataFrame:
    """rows (token, hot, ...) with aggregates of their token's rows: by a window, or for a hot token, whose rows no task
    should hold, by partial sums that are joined back."""
    by = W.partitionBy("token")
    cold = rows.where("not hot").withColumns({n: a.over(by) for n, a in made.items()})
    sums = stored(rows.where("hot").groupBy("token").agg(*[a.alias(n) for n, a in made.items()]), "ngram-hot")
    return cold.unionByName(rows.where("hot").join(small(sums), "token").select(cold.columns))


def links(docs: DataFrame, nodes: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """Enough links (a, b) between nodes (id, n, l, prefix, hot) to join all that similar pairs join.

    Two stars a token, about its least and its greatest document, spare dense groups the listing of their pairs; what
    they leave in different components meets in the full join, so they decide nothing.
    """
    posts = nodes.select("id", "n", "l", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "t"))
    posts = posts.select(F.col("t.prefix").alias("token"), "t.hot", F.struct("id", "n", "l", (F.col("pos") + 1).alias("pos")).alias("x"))
    posts = beside(posts, {"many": F.count("*"), "end": F.min("x")}).where("many > 1").drop("many")
    posts = stored(posts, "ngram-posts")
    found = None
    for _ in range(2):
        near = posts.where((F.col("end.id") != F.col("x.id")) & meets("end", "x", percent))
        more = verified(
            docs, shared_enough(near.select(F.col("end.id").alias("a"), F.col("x.id").alias("b"), F.least("end.l", "x.l").alias("least"))),
            percent, k,
        )
        found = more if found is None else stored(found.unionByName(more), "ngram-links")
        comp = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        comp = small(stored(comp, "ngram-comp"))
        in_comp = posts.select("token", "hot", "x", F.col("x.id").alias("id")).join(comp, "id", "left").select(
            "token", "hot", "x", F.coalesce("root", "id").alias("comp"),
        )
        spans = beside(in_comp, {"lo": F.min("comp"), "hi": F.max("comp"), "end": F.max("x")}).where("lo <> hi")
        done, posts = posts, stored(spans.select("token", "hot", "x", "comp", "end"), "ngram-posts")
        drop(done)
    x, y = sides(posts, percent)
    met = x.join(y, ["token", "class", "salt"]).where(
        (F.col("ca") != F.col("cb")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & meets("x", "y", percent)
    )
    pairs = shared_enough(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.least("x.l", "y.l").alias("least")))
    return stored(found.unionByName(verified(docs, pairs, percent, k)), "ngram-links")


def sides(posts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """posts as (token, class, salt, x, ca) and (token, class, salt, y, cb), so that every pair of one token whose sizes can
    be similar meets in one row, and no token's rows meet in one task.

    A class holds sizes up to 100 / percent times its least: the larger document stands in its own, the smaller looks into
    that and the next. A class of a token with more than HOT rows is dealt to salts, and the smaller documents look into all.
    """
    import math

    place = F.log(F.col("x.n").cast("double")) / math.log(100 / percent) if percent < 100 else F.col("x.n").cast("double")
    own = posts.withColumn("class", F.floor(place).cast("int"))
    large = stored(
        own.groupBy("token", "class").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select(
            F.col("token").alias("t2"), F.col("class").alias("c2"), F.ceil(F.col("rows") / HOT).cast("int").alias("salts"),
        ),
        "ngram-large",
    )
    none = large.isEmpty()
    large = small(large)
    salts = lambda d: d.withColumn("salts", F.lit(1)) if none else d.join(large, (F.col("token") == F.col("t2")) & (F.col("class") == F.col("c2")), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    y = salts(own).select(
        "token", "class", F.pmod(F.xxhash64("x.id"), F.col("salts")).cast("int").alias("salt"), F.col("x").alias("y"),
        F.col("comp").alias("cb"),
    )
    # the margin covers a logarithm's last bits: a row too many looks in vain
    looks = posts.withColumn("class", F.explode(F.sequence(F.floor(place - 1e-9).cast("int"), F.floor(place + 1 + 1e-9).cast("int"))))
    x = salts(looks).select(
        "token", "class", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "x", F.col("comp").alias("ca"),
    )
    return x, y


def ngram_join(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; fewer words make one
    shingle; none (or a null text) make an empty set, which links with nothing. Rows that repeat a doc_id are one
    document with several sets. A null doc_id links with nothing and has a null component. Each input row gives one.
    """
    signed = stored(signatures(docs, percent, k), "ngram-signed")
    nodes = stored(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id")), "ngram-nodes")
    # of equal sets the least doc_id stands for all; the others' prefixes stay where they are
    held = signed.where("n > 0 and doc_id is not null").select("node", "doc_id", "n", "l", "prefix", "hot")
    repeated = small(stored(held.groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-repeated"))
    copies = held.select("node", "doc_id").join(nodes, "node").where("doc_id <> id").select("doc_id").distinct().join(repeated, "doc_id", "left_anti")
    copies = small(stored(copies, "ngram-copies"))
    once = held.join(repeated, "doc_id", "left_anti").join(copies, "doc_id", "left_anti")
    again = held.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "node").agg(
        *[F.first(c).alias(c) for c in ("n", "l", "prefix", "hot")]
    )
    shown = once.unionByName(again).select(F.col("doc_id").alias("id"), "n", "l", "prefix", "hot")
    comp = connected_components(
        links(docs, shown, percent, k).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(repeats(signed, nodes))
    )
    roots = nodes.select("node", "id").join(comp, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", "n", "node").join(roots, "node", "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )


def repeats(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) from a doc_id that holds several sets to those sets' least doc_ids."""
    several = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"),
    ).where("lo <> hi")
    held = signed.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "node").distinct()
    return held.join(nodes.select("node", "id"), "node").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))
