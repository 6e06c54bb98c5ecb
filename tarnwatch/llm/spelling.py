"""Spelling variants by an errata trie: words one edit apart are found by merging light subtrees, small into large.

The trie of all words is cut into heavy paths: at each node the child with the most words below is heavy, the others are
light, so a word meets at most log2(words) light edges. Where a word leaves a heavy path its rest is merged into the heavy side
with one character wrong: replaced by the heavy one, skipped, or the heavy one put in. Rests that end at one place (coinciding
terminals) are words one edit apart. Nodes, merges and terminals are rows: nodes are counted by their prefixes' digests, and
merged rests meet words by an equi-join.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import drop, give_back, slices, stored

RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LOSSES = 199  # a run whose hash this divides loses a character
SHARES = 20_000  # nodes with more than one in so many of all (word, node) rows are broadcast: there are at most so many


def words(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z in lower case, one character lost where the run's hash says so.

    A null doc_id is written as null in that hash.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUNS), F.lit(0)))
    r = documents.select("doc_id", run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    r = r.withColumn("h", h).select(F.when(F.col("h") % LOSSES == 0, short).otherwise(F.col("run")).alias("word"))
    return r.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def nodes(words: DataFrame) -> DataFrame:
    """(word, n, at, node, next): the nodes on each word's way; next is null where the word ends. A node is its prefix's digest."""

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in slices(batches):
            for k in range(b.num_rows):
                word = b.column(0)[k].as_py()
                digest, made = b"", []
                for c in word:
                    made.append(digest)
                    digest = hashlib.blake2b(digest + c.encode(), digest_size=16).digest()
                made.append(digest)
                for i in range(0, len(made), 1024):  # a very long word's nodes go out in parts
                    part = made[i : i + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([word] * len(part)), pa.array(
                                [b.column(1)[k].as_py()] * len(part), pa.int64(),
                            ), pa.array(range(i, i + len(part)), pa.int32()),
                            pa.array(part, pa.binary()), pa.array([*word[i : i + 1024], None][: len(part)], pa.string()),
                        ],
                        names=["word", "n", "at", "node", "next"],
                    )
        give_back()

    return words.select("word", "n").mapInArrow(run, "word string, n long, at int, node binary, next string")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, at, heavy): where a word leaves a heavy path, at the character `at` from 0, and the character that stays on it.

    A word that ends on a node with children leaves it there. The busiest nodes' heavy children are broadcast, the others joined,
    so that no node's words meet in one task.
    """
    way = stored(nodes(words), "way")
    children = way.groupBy("node", "next").agg(F.count("*").alias("m"))
    top = F.max(F.when(F.col("next").isNotNull(), F.struct("m", "next")))
    heavy = children.groupBy("node").agg(top["next"].alias("heavy"), F.sum("m").alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
    heavy = stored(heavy.where("heavy is not null"), "heavy")
    busy = max(1, way.count() // SHARES)
    few = F.broadcast(heavy.where(F.col("m") > busy).select("node", F.col("heavy").alias("busy")))
    left = way.join(few, "node", "left")
    light = ~F.col("next").eqNullSafe(F.col("heavy"))
    now = left.where("busy is not null").select("word", "n", "at", "next", F.col("busy").alias("heavy")).where(light)
    rest = left.where("busy is null").join(heavy.where(F.col("m") <= busy).select("node", "heavy"), "node")
    out = stored(now.unionByName(rest.select("word", "n", "at", "next", "heavy").where(light)).drop("next"), "light")
    drop(way), drop(heavy)
    return out


def before(at: Column) -> Column:
    return F.substring("word", F.lit(1), at)


def after(at: Column) -> Column:
    return F.substring("word", at + 1, F.length("word"))


def best(word: str, n: str) -> Column:
    """Orders by n, largest first, then by word in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("near"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and of these the one with the largest n (ties: the
    smallest). Links are counted where they are found, not listed between all variants of a place."""
    light = light_edges(words)
    at, ends = F.col("at"), F.col("at") == F.length("word")
    own = best("word", "n").alias("own")
    terminals = words.select(F.col("word").alias("end"), F.col("n").alias("end_n"))
    # Replaced: at one place and with one rest there is at most one word a character of the alphabet.
    put = F.concat(before(at), F.col("heavy"), after(at + 1))
    replaced = light.where(~ends).groupBy(put.alias("end"), "at").agg(F.array_sort(F.collect_list(own)).alias("all"))
    replaced = replaced.join(terminals, "end", "left")
    alone = F.array_sort(F.when(F.col("end_n").isNull(), F.col("all")).otherwise(F.array_append("all", best("end", "end_n"))))
    replaced = replaced.select(alone.alias("all")).where(F.size("all") > 1).select("all", F.explode("all").alias("own"))
    second = F.when(F.col("own") == F.element_at("all", 1), F.element_at("all", 2)).otherwise(F.element_at("all", 1))
    replaced = replaced.select(F.col("own.near").alias("word"), (F.size("all") - 1).cast("long").alias("k"), second.alias("best"))
    # Skipped: of a run of one character its last is taken, so that each pair comes once.
    x, y = F.substring("word", at + 1, F.lit(1)), F.substring("word", at + 2, F.lit(1))
    skipped = light.where(~ends & (x != y)).select("word", "n", F.concat(before(at), after(at + 1)).alias("end"))
    extra = light.select("word", "n", F.concat(before(at), F.col("heavy"), after(at)).alias("end"))
    pairs = skipped.unionByName(extra).join(terminals, "end")
    pairs = pairs.select(F.explode(F.array(
        F.struct("word", best("end", "end_n").alias("best")), F.struct(F.col("end").alias("word"), best("word", "n").alias("best")),
    )).alias("p"))
    found = replaced.unionByName(pairs.select("p.word", F.lit(1).cast("long").alias("k"), "p.best"))
    found = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the form that has none itself, found by doubling the way each round."""
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        further = stored(
            step.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")),
            "roots",
        )
        drop(step)
        moved = not further.where("moved").isEmpty()
        step = further.drop("moved")
        step._stored_at = further._stored_at
        if not moved:
            return step


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the frequent words of all texts.

    A word's form is its near word of largest n, ties the smallest in code-point order, if that is at least `ratio` times the
    word's own; forms grow by `ratio` a step, so the way to a root ends. Null and empty texts hold no words; repeated rows count
    each time; columns other than doc_id and text are left out; an empty table gives no rows.
    """
    w = stored(words(documents, least_length, least_count), "words")
    n = stored(w.join(near(w), "word", "left"), "near")
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = n.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    ends = roots(out.where("form is not null"))
    out = out.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
