"""Toxicity, quality, n-gram join, mixing, packing and sharding on small fixtures."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import common, mixing, ngram_join, packing, quality, sharding, toxicity
from tarnwatch.llm import vectext as V

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud meadow lantern harbor winter garden copper violin market window thunder pepper silver".split()


def table(spark, rows, ddl=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], ddl)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    """Sentences of prose, a third with an insult; half shouted junk."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(240):
        s = [prose(rng, 12) for _ in range(6)]
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            s[rng.randrange(6)] = prose(rng, 5)[:-1] + " vilegrub" + rng.choice(["a", "en", "ish"]) + " " + prose(rng, 5)
        text = " ".join(s)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "a"))
        labels.append((i, int(good), int(toxic)))
    docs += [
        (1000, None, "a"), (1001, "", "a"), (1002, "...", "a"), (1003, "vilegruben " * 3, None), (1003, "vilegruben " * 3, None),
        (None, "x", "a"),
    ]
    return table(spark, docs).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_documents_and_sentences(labelled):
    docs, labels = labelled
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(240) if out[i].held_out]
    assert 30 < len(held) < 90
    right = sum(out[i].predicted == (i % 3 == 0) for i in held)
    assert right / len(held) > 0.9
    hits = [s.text for i in held if i % 3 == 0 for s in out[i].offending]
    assert hits and sum("vilegrub" in h.lower() for h in hits) / len(hits) > 0.9
    assert out[1000].score == out[1001].score == out[1002].score == 0 and out[1003].predicted == 1
    assert docs.count() == toxicity.toxicity(docs, labels).count()


def test_toxicity_ignores_held_out_labels(labelled):
    docs, labels = labelled
    kept = labels.where(~common.held_out())
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, kept).collect()}
    assert a == b


def test_quality_separates(labelled):
    docs, labels = labelled
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [i for i in range(240) if out[i].held_out]
    assert sum(out[i].predicted == (i % 4 != 1) for i in held) / len(held) > 0.95
    assert out[1000].score == out[1001].score and 0 < out[1000].score < 1


def test_filters_keep_columns_and_nulls(labelled):
    docs, labels = labelled
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 1000, 1001} <= ids and 1003 not in ids
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_models_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    none = labels.where("false")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert quality.quality(docs, none).count() == docs.count()
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_substring_hashes_do_not_depend_on_place():
    a = V.Chunk([b"one two", "\xe9t\xe9 two".encode()], V.SPACE)
    w = a.words()
    assert w[1] == w[3] and len(set(w.tolist())) == 3
    long = V.Chunk([b"x" * 3_000_000 + b" two"], V.SPACE)
    assert long.words()[1] == w[1]


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def components(rows, percent=80):
    sets, up = sets_of([t for _, t, _ in rows]), {}
    ids = [i for i, _, _ in rows]
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if ids[i] is not None and ids[j] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(ids[i]), find(ids[j])))
            up[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True)), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(6):
        seed = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.choice([6, 40, 150]))]
        rows += [(len(rows) + k * 7 % 5 + 100 * g, edited(rng, seed, rng.randrange(5)), "s") for k in range(25)]
    passage = prose(rng, 60)
    rows += [(2000 + i, passage + " " + prose(rng, rng.randrange(5, 30)), "s") for i in range(30)]
    rows += [
        (3000, None, None), (3001, "", "s"), (3002, "A b", "s"), (3003, "a B", "s"), (3004, " \t\n", "s"), (None, passage, "s"),
        (3005, "A b", "s"), (3005, "A b", "s"),
    ]
    rows = [r for k, r in enumerate(rows) if r[0] is None or r[0] == 3005 or r[0] not in {x[0] for x in rows[:k]}]
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)


def test_hot_tokens_give_the_same_links(spark, monkeypatch):
    rng = random.Random(12)
    seed = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60)]
    rows = [(i, edited(rng, seed, rng.randrange(4)), "s") for i in range(40)]
    monkeypatch.setattr(ngram_join, "HOT", 3)
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows)


def test_classes_and_salts_meet_every_pair_once(spark, monkeypatch):
    rng = random.Random(13)
    sizes = [rng.choice([1, 4, 5, 8, 10, 12, 15, 100, 125, 126]) for _ in range(60)]
    rows = [(t, False, (i, n, 1, 1), i, None) for i, n in enumerate(sizes) for t in (1, 2)]
    ddl = "token long, hot boolean, x struct<id:long,n:int,l:int,pos:int>, comp long, end string"
    posts = spark.createDataFrame(rows, ddl)
    for hot in (1000, 2):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        x, y = ngram_join.sides(posts, 80)
        met = x.join(y, ["token", "class", "salt"]).where(F.struct("x.n", "x.id") < F.struct("y.n", "y.id")).select(
            "token", "x.id", F.col("y.id").alias("j"), "x.n", F.col("y.n").alias("m"),
        ).collect()
        got = [(r.token, r.id, r.j) for r in met if 100 * r.n >= 80 * r.m]
        size = dict(enumerate(sizes))
        want = {(t, i, j) for t in (1, 2) for i in size for j in size if (size[i], i) < (size[j], j) and 100 * size[i] >= 80 * size[j]}
        assert len(got) == len(set(got)) and set(got) == want


def test_join_of_one_doc_id_with_two_texts(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (9, b, "s")]
    assert {r.component_id for r in ngram_join.ngram_join(table(spark, rows)).collect()} == {1}
    assert ngram_join.ngram_join(table(spark, rows).where("false")).count() == 0


def test_prefix_grows_with_its_cost():
    tokens = np.arange(100, dtype=np.uint64)
    l1, p1, _ = ngram_join.prefix(tokens, np.ones(100, np.int64), 80)
    l2, p2, _ = ngram_join.prefix(tokens, np.full(100, 10**6), 80)
    assert len(p1) == 20 + l1 and len(p2) == 20 + l2 and 1 <= l1 <= l2


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.id: r.root for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [
        (i, prose(rng, rng.randrange(1, 40)), rng.choice(["a", "b", "c", "d", None]) if i > 20 else "tiny") for i in range(900)
    ] + [(5000, None, "a"), (5001, "", "z")]
    docs = table(spark, rows).withColumn("key", F.lit(1)).withColumn("cut", F.lit(1))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    total = sum(r.size for r in out)
    assert abs(sum(s[0].target for s in by.values()) - total) < 1e-6
    for rs in by.values():
        assert rs[0].target <= 3 * rs[0].source_size + 1e-9
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-9
    # water-filling: what is not at its cap is at one level by weight
    names = sorted(by, key=lambda s: (s is None, s or ""))
    levels = {round(by[s][0].target / (k % 3 + 1), 6) for k, s in enumerate(names) if by[s][0].target < 3 * by[s][0].source_size - 1e-6}
    assert len(levels) == 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def brute_mix(rows, weight):
    """Every source's whole order, row by row. rows: (doc_id, text, source)."""
    import hashlib

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((i, t))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t in by[s]) for s in names}
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left, share = sum(total.values()) - sum(target[s] for s in full), sum(w[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] = left * w[s] / share
        over = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = float(3 * total[s])
        full |= over
    out = []
    for s in names:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        budget, upto = target[s] - epochs * total[s], 0
        def key(r):
            u = (int(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / weight(r[1]), r[0] is not None, r[0] or 0, size(r[1]))
        for i, t in sorted(by[s], key=key):
            n = size(t)
            takes = n > 0 and (upto + n <= budget or upto < budget and upto + n - budget < budget - upto)
            upto += n
            out.append((i, n, (epochs + takes) * n))
    return sorted(out, key=str)


def test_mix_equals_a_whole_sort(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randrange(1, 30)), rng.choice(["a", "b", "c", None])) for i in range(600)]
    # many rows of one doc_id, equal and unlike; a source whose edge lies among equal rows
    rows += [(7, "again and again", "a")] * 40 + [(None, "no id at all", "b")] * 300 + [(9, "one", "same")] * 50 + [(9, "two words", "same")] * 5
    docs = table(spark, rows)
    for w in (1.0, 0.01):
        got = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(docs, F.lit(w)).collect()), key=str)
        assert got == brute_mix(rows, lambda _, w=w: w)


def test_mixed_rows_are_those_that_mix_counts(spark):
    rng = random.Random(22)
    rows = [
        (i % 90 if i % 3 else None, prose(rng, rng.randrange(1, 6)), rng.choice(["a", "b", None])) for i in range(400)
    ] + [(9, "one", "same")] * 50
    docs = table(spark, rows).withColumns(
        {c: F.lit(c) for c in ("copies", "of", "copy", "_row", "size", "taken")}
    ).withColumn("epochs", F.map_from_arrays(F.array(F.lit("k")), F.array("doc_id")))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want, got = {}, {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] = want.get((r.doc_id, r.source, r.size), 0) + r.copies
    for r in out.collect():
        k = (r.doc_id, r.source, len(r.text.split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.mixed(docs.where("false")).count() == 0


def test_mix_prefers_quality(spark):
    docs = table(spark, [(i, "word " * 10 if i % 2 else "!!! ### $$$ w " * 5, "a" if i < 2000 else "b") for i in range(4000)])
    w = F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.05)
    out = mixing.mix(docs, w).where("source = 'a' and copies > 0")
    n = {r.odd: r["count"] for r in out.groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()}
    assert n[1] == 1000 and n.get(0, 0) < 600
    assert mixing.mix(docs.where("false")).count() == 0


def brute_cost(edges, counts, k):
    best = math.inf
    for cut in itertools.combinations(range(len(edges) - 1), min(k, len(edges)) - 1):
        ends = [*cut, len(edges) - 1]
        cost, j = 0, 0
        for i, (e, c) in enumerate(zip(edges, counts, strict=True)):
            while i > ends[j]:
                j += 1
            cost += c * (edges[ends[j]] - e)
        best = min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        edges = sorted(rng.sample(range(1, 200), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 50) for _ in edges]
        k = rng.randrange(1, 5)
        b = packing.boundaries(edges, counts, k)
        assert b[-1] == edges[-1] and len(b) <= k and set(b) <= set(edges)
        cost = sum(c * (min(x for x in b if x >= e) - e) for e, c in zip(edges, counts, strict=True))
        assert cost == brute_cost(edges, counts, k)


def test_long_lengths_pad_least(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(500, 21000) for _ in range(12)]
    docs = spark.createDataFrame([(i, n, "") for i, n in enumerate(lengths * 3)], "doc_id long, n long, text string")
    out = packing.pack(docs, F.col("n"), buckets=4).collect()
    want = sorted(set(lengths))
    assert sum(r.padded for r in out) == brute_cost(
        want, [3 * lengths.count(n) for n in want], 4,
    ) and max(r.bucket for r in out) == max(lengths)


def test_many_lengths_take_little(spark):
    """Boundaries over 200,000 different lengths: the hull is linear in them, and brute force agrees on a part."""
    edges = list(range(1, 200_001))
    b = packing.boundaries(edges, [1] * len(edges), 4)
    assert len(b) == 4 and b[-1] == 200_000 and all(abs(x - 50_000 * (k + 1)) <= 1 for k, x in enumerate(b))


def test_rows_of_one_doc_id_get_slots_from_their_count(spark):
    rows = [(None, "a b c", "s")] * 3000 + [(5, "a b", "s")] * 700 + [(6, "a b", "s")]
    out = packing.pack(table(spark, rows), buckets=2, token_budget=30).collect()
    seen = {(r.bucket, r.batch, r.slot) for r in out}
    assert len(out) == len(seen) == len(rows) and max(r.slot for r in out) == 14


def test_pack_fills_batches(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 9, 40, 700])), "s") for i in range(500)] + [
        (600, None, "s"), (601, "", "s"), (7, "again and again", "s"), (7, "again and again", "s"),
    ]
    docs = table(spark, rows).withColumn("bucket", F.lit(0)).withColumn("h", F.lit(0))
    out = packing.pack(docs, buckets=3, token_budget=1000).collect()
    assert len(out) == len(rows)
    seen = {}
    for r in out:
        assert r.n_tokens <= r.bucket or r.n_tokens == r.bucket == 0
        assert r.padded == r.bucket - r.n_tokens
        seen.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert len({b for b, _ in seen}) <= 4
    last = {}
    for (b, n), slots in seen.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) * max(b, 1) <= 1000 or len(slots) == 1
        last[b] = max(last.get(b, 0), n)
    assert all(len(s) == max(1, 1000 // max(b, 1)) for (b, n), s in seen.items() if n < last[b])
    assert packing.pack(docs.where("false")).count() == 0



def test_join_equals_the_exact_script(spark):
    import os

    from tests.llm import exact_join

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want, _ = exact_join.exact([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()) == sorted(want)


def test_rows_without_id_fill_pages(spark):
    """A third of the rows share one bucket: no id."""
    rng = random.Random(3)
    rows = [(None, "x" * rng.choice([10, 30, 250]), "s") for _ in range(300)] + [(i, "y" * 20, "s") for i in range(600)]
    out = sharding.shard(table(spark, rows), 200).collect()
    size, of = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        of.setdefault(r.shard, []).append(r.n_bytes)
    assert len(out) == len(rows) and all(
        n <= 200 or of[s] == [250] for s, n in size.items()
    ) and all(size[r.shard] == r.shard_bytes for r in out)


def test_shards_fit_and_split_only_when_needed(spark):
    rng = random.Random(9)
    rows = [
        (i, "x" * rng.randrange(0, 300), "s") for i in range(800)
    ] + [(9000, "y" * 5000, "s"), (9001, None, "s")] + [(42_000, "z" * 400, "s")] * 10
    docs = table(spark, rows).withColumn("depth", F.lit(1))
    out = sharding.shard(docs, 2000).collect()
    assert len(out) == len(rows)
    size, of = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        of[r.shard] = of.get(r.shard, 0) + 1
    assert all(n <= 2000 or of[s] == 1 for s, n in size.items())
    assert all(size[r.shard] == r.shard_bytes for r in out)
    plain = {r.shard: r.depth for r in out if "+" not in r.shard}
    for s, d in plain.items():
        assert len(s) == d
        if d:  # its parent was over the limit
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > 2000
    assert len({r.shard for r in out if r.doc_id == 42_000}) == 2
    assert sharding.shard(docs.where("false"), 2000).count() == 0
    assert {r.shard for r in sharding.shard(docs, 10**9).collect()} == {""}
