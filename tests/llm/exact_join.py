"""Compares op8_ngram_join with an exact join of its own over a whole table: python tests/llm/exact_join.py /path/to/tables

The exact join shares no code with the operator: sets of word tuples by Python, shingles ordered by true frequency, the
plain prefix filter (any shared token of the first n - ceil(0.8 n) + 1), every candidate pair of different components
verified on whole sets. It runs in one process and takes minutes for 0.1 GB of documents.
"""

import re
import sys
import time
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def exact(ids, texts, percent=80):
    """-> (doc_id, set size, smallest doc_id reachable) of each row, and how many pairs were verified."""
    number, sets = {}, []
    for t in texts:
        w = WORDS.findall((t or "").translate(FOLD))
        grams = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({f"\0{' '.join(w)}"} if w else set())
        sets.append(np.unique(np.fromiter((number.setdefault(g, len(number)) for g in grams), np.int64, len(grams))))
    often = np.bincount(np.concatenate(sets), minlength=len(number)) if number else np.zeros(0, int)
    rank = np.empty(len(number), np.int64)
    rank[np.lexsort((np.arange(len(number)), often))] = np.arange(len(number))
    nodes, up, verified = {}, {}, 0

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(a, b):
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)

    for i, s in zip(ids, sets, strict=True):
        up.setdefault(i, i)
        if len(s):
            join(i, nodes.setdefault(s.tobytes(), i))
    shown = [(i, np.sort(rank[np.frombuffer(k, np.int64)])) for k, i in nodes.items()]
    shown.sort(key=lambda x: len(x[1]))
    posts = defaultdict(list)
    for k, (i, s) in enumerate(shown):
        n = len(s)
        seen = set()
        for token in s[: n - -(-n * percent // 100) + 1].tolist():
            for m in posts[token]:
                if m not in seen and 100 * len(shown[m][1]) >= percent * n and find(i) != find(shown[m][0]):
                    seen.add(m)
                    verified += 1
                    both = len(np.intersect1d(s, shown[m][1], assume_unique=True))
                    if 100 * both >= percent * (n + len(shown[m][1]) - both):
                        join(i, shown[m][0])
            posts[token].append(k)
    return [(i, len(s), find(i)) for i, s in zip(ids, sets, strict=True)], verified


def main(folder):
    from pyspark.sql import SparkSession

    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from tarnwatch.llm.queries import op8_ngram_join

    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    began = time.time()
    want, verified = exact(t.column("doc_id").to_pylist(), t.column("text").to_pylist())
    print(
        f"exact: {len(want)} documents, {len({c for _, _, c in want})} components, {verified} pairs verified, {time.time() - began:.0f} s"
    )
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op8_ngram_join(spark, folder).collect()]
    unlike = len(set(got) ^ set(want))
    print(f"op8_ngram_join: {len({c for _, _, c in got})} components, {time.time() - began:.0f} s; rows that differ: {unlike}")
    return unlike


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]) > 0)
