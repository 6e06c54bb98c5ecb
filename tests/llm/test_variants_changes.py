"""BPE against the tokenizers library, spelling variants and sequenced changes against plain loops, WARC names after a shuffle."""

import collections
import datetime
import gzip
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import bpe, changes, spelling, warc

DOCS = "doc_id long, text string, ids array<int>, word string, n long"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n long, batch string"


def test_encoding_equals_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rnd = public.path("word_bpe_49k.json"), random.Random(3)
    parts = [
        "a", "the", "ing", "'s", "'LL", " ", "\n", "\x1c", "é", "é", "İ", "Σ", "中", "文", "😀", "²", "½", "٣", "ß", "<|endoftext|>", "<|startoftext|>", "<|",
        "</w>", "_", "-", "!", "̀", "ﬁ", "q", "x", "\x85", "\xa0", "ǅ", "Ⱥ", "0", "9", "한", "\x00", "JOHN'S",
    ]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    texts += [None, "", " \n ", "a" * 50_000, "".join(rnd.choice("abcxyzé") for _ in range(20_000)), "same", "same"]
    rows = [(k % 300, t, [1], "w", 2) for k, t in enumerate(texts)]
    encoded = bpe.encode(spark.createDataFrame(rows, DOCS), path)
    library = tokenizers.Tokenizer.from_file(path)
    want = collections.Counter()
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(encoded, path).collect()) == want
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), path), path)).count() == 0


def test_cuts_are_where_no_token_has_both(spark):
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("word_bpe_49k.json")) as f:
        v = bpe.Vocabulary(f.read())
    symbols = list("zqjx§zq".encode())
    found = list(v.fragments(symbols))
    assert sum(found, []) == symbols and len(found) > 1
    for a, b in zip(found, found[1:]):
        assert not any(v.letters[a[-1]] + v.letters[b[0]] in t for t in v.tokens.values() if not t.endswith("</w>"))


def variants(texts, least=6, count=5, ratio=5):
    """Every pair of words by what they leave with one character out or unknown."""
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    found = collections.Counter()
    for i, t in texts:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{r}".encode())
            if h % 199 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= least:
                found[r] += 1
    n = {w: k for w, k in found.items() if k >= count}
    near, stars = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            stars[w[:k] + "*" + w[k + 1 :]].add(w)
            if (u := w[:k] + w[k + 1 :]) in n:
                near[w].add(u)
                near[u].add(w)
    for s in stars.values():
        for w in s:
            near[w] |= s - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    stems = ["aaaaaaa", "abababab", "kolmar", "kolmér", "ÀÉßçñü", "straße", "x" * 3000]
    words = []
    for _ in range(400):
        w = list(rnd.choice(stems[:6]))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é", "K"])
        words.append("".join(w))
    words += [stems[-1], "y" + stems[-1], stems[-1][1:]]
    texts = [(k, " ".join(rnd.choice(words) for _ in range(200))) for k in range(60)]
    texts += [(k, f"{stems[-1]},{stems[-1]}y y{stems[-1]} {stems[-1][1:]}") for k in range(100, 106)]
    texts += [(None, "kolmar kolmar"), (7, None), (8, ""), (9, "12 !? short"), *texts[:3]]
    docs = spark.createDataFrame([(i, t, None, "w", 1) for i, t in texts], DOCS)
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    want = variants(texts)
    assert got == want and any(f for _, f, *_ in want) and any(k > 5 for *_, k, _ in want)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(1, "few words here", None, "w", 1)], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def applied(rows):
    """The fold over all changes in one process."""
    rows = list(dict.fromkeys(r[:9] for r in rows))
    numbers = collections.defaultdict(set)
    for r in rows:
        numbers[r[1]].add((r[2] is not None, r[2] or 0))
    rank = {c: {s: k + 1 for k, s in enumerate(sorted(v))} for c, v in numbers.items()}
    batches, state, out, top, last = collections.defaultdict(list), {}, [], None, {}
    for change, c, seq, op, at, _, _, city, balance in rows:
        if change is None or at is None or (h := zlib.crc32(str(change).encode())) % 11 == 0:
            continue
        day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        batches[max(1, min(12, 1 + (day - 19723) * 12 // 160))].append((day, change, c, rank[c][(seq is not None, seq or 0)], op, city, balance))

    def apply(c, s, batch, missed):
        while s["next"] in s["held"]:
            _, change, n, op, city, balance = s["held"].pop(s["next"])
            if op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = city if city is not None else s["city"], balance if balance is not None else s["balance"]
            elif op == "D":
                s["city"] = s["balance"] = None
            s["next"] += 1
            last[c] = len(out), op
            cents = None if s["balance"] is None or not math.isfinite(s["balance"]) else math.floor(100 * s["balance"] + 0.5)
            out.append([change, c, "applied", batch, missed, s["city"], cents, False])
            missed = 0

    for b in range(1, 14):
        for c, s in state.items():
            while s["held"] and (b == 13 or top is not None and min(x[0] for x in s["held"].values()) + 3 <= top):
                gap, s["next"] = min(s["held"]) - s["next"], min(s["held"])
                apply(c, s, b, gap)
        for day, change, c, n, op, city, balance in sorted(batches[b], key=lambda x: x[:2]):
            s = state.setdefault(c, {"next": 1, "held": {}, "city": None, "balance": None})
            if n < s["next"] or n in s["held"]:
                out.append([change, c, "rejected", b, 0, None, None, False])
            else:
                s["held"][n] = (day, change, n, op, city, balance)
                apply(c, s, b, 0)
        top = max([x[0] for x in batches[b]] + ([] if top is None else [top]), default=None)
    for place, op in last.values():
        out[place][-1] = op != "D"
    return [tuple(r) for r in out]


def test_changes_equal_one_fold(spark):
    rnd, start, rows = random.Random(5), datetime.datetime(2024, 1, 2), []
    for k in range(700):
        client = rnd.choice([1, 1, 1, 2, 3, None, *range(10, 20)])
        at = start + datetime.timedelta(days=rnd.choice([k / 6, k / 6, rnd.random() * 110]), hours=rnd.randrange(24))
        rows.append(
            (
                k, client, max(0, k // 8 + rnd.randint(-3, 3)), rnd.choice("IUUUD"), rnd.choice([at] * 30 + [None]), "s", None, rnd.choice(["a", "b", None]),
                rnd.choice([1.005, -3.25, None, 2e3, float("inf")]), 5, "x",
            )
        )
    rows += [(None, 1, 1, "I", start, "s", None, "a", 1.0, 5, "x"), (9001, 1, 5, None, start, None, None, "q", 1.0, 5, "x"), *rows[:40]]
    # two batches are empty
    rows = [r for r in rows if r[4] is None or not 60 <= (r[4] - start).days < 95]
    got = changes.applied(spark.createDataFrame(rows, CHANGES)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = applied(rows)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert sum(r[4] for r in want) > 10 and sum(r[2] == "rejected" for r in want) > 10


def test_clients_share_a_state_value(spark):
    """300 clients in the few lanes of a small table: those without rows in a batch keep what they hold."""
    rnd, start = random.Random(6), datetime.datetime(2024, 1, 2)
    rows = [
        (k, k % 300, rnd.randrange(6), rnd.choice("IUD"), start + datetime.timedelta(days=rnd.random() * 110), "s", None, "a", float(k), 5, "x")
        for k in range(900)
    ]
    got = changes.applied(spark.createDataFrame(rows, CHANGES)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = applied(rows)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key) and sum(r[4] > 0 for r in want) > 10
    state = changes.clients(spark, next(p for p in changes._stored[::-1] if "changes-checkpoint" in p))
    assert state.select("client_id").distinct().count() == state.count() == len({r[1] for r in want})


def test_no_changes(spark):
    assert changes.applied(spark.createDataFrame([], CHANGES)).count() == 0


def test_only_clients_with_expired_rows_get_a_clock(spark):
    held = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "client_id long, earliest long")
    rows = changes.clock_rows(held.where(F.col("earliest") + changes.PATIENCE <= 14), 14, 3).collect()
    assert {r.client_id for r in rows} == {1, None} and all(r.clock and r.lane == 0 and r.batch == 3 for r in rows)


def test_names_in_archives_exist_after_a_shuffle(spark):
    rows = [(k % 300, f"u{k}", f"<p>{k % 7}</p>") for k in range(600)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16, "url"))
    names, refers, digests = set(), [], {}
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            head = gzip.decompress(f.read(r.length))
        name = re.search(rb"WARC-Record-ID: <(.*?)>", head)[1]
        names.add(name)
        digests[name] = re.search(rb"Payload-Digest: (\S+)", head)[1]
        if m := re.search(rb"WARC-Refers-To: <(.*?)>", head):
            refers.append((m[1], digests[name]))
    assert len(names) == 600 and len(refers) > 500
    assert all(digests.get(name) == digest for name, digest in refers)


def test_clients_say_what_they_hold(spark, monkeypatch):
    """Between starts no state store is read back: the output says who waits since when, and the result leaves that out."""
    said = [(1, 10, 1), (1, None, 2), (2, 20, 1), (2, 15, 3), (None, 5, 2)]
    out = spark.createDataFrame([(None, c, n, "waits", b, 0, None, None, None) for c, n, b in said] + [(7, 1, 9, "applied", 4, 0, "I", "a", 1.0)], changes.RESULT)
    assert {r[:] for r in changes.waiting(out).collect()} == {(2, 15), (None, 5)}
    reads, clients = [], changes.clients
    monkeypatch.setattr(changes, "clients", lambda *a: reads.append(a) or clients(*a))
    start = datetime.datetime(2024, 1, 2)
    rows = [(k, 1, seq, "I", start + datetime.timedelta(days=d), "s", None, "a", 1.0, 5, "x") for k, seq, d in ((1, 1, 0), (2, 3, 1), (3, 4, 90), (12, 2, 130))]
    got = changes.applied(spark.createDataFrame(rows, CHANGES)).collect()
    assert sorted(tuple(r) for r in got) == sorted(applied(rows)) and len(reads) == 1


def test_the_state_decides_every_change(spark, monkeypatch):
    """Repeats of a number are not known as such before the stream: they go to their client's lane, and its state rejects them."""
    rnd, start, seen = random.Random(8), datetime.datetime(2024, 1, 2), []
    rows = [
        (k, k % 3 or None, rnd.randrange(9), "I", start + datetime.timedelta(days=rnd.random() * 110), "s", None, rnd.choice("ab"), float(k), 5, "x")
        for k in range(120)
    ]
    rows += [(50, 2, 4, "I", start, "s", None, c, 1.0, 5, "x") for c in "pqr"]
    table = spark.createDataFrame(rows, CHANGES)
    fed = changes.arranged(table, 64).select("client_id", "lane").distinct().collect()
    assert len(fed) == 3 and all(r.lane >= 0 for r in fed)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = applied(rows)
    assert sorted((tuple(r) for r in changes.applied(table).collect()), key=key) == sorted(want, key=key)
    assert sum(r[2] == "rejected" for r in want) > 60


def test_rows_that_differ_in_another_column_are_different(spark):
    """Whole rows are distinct changes, whatever columns the table has."""
    at = datetime.datetime(2024, 1, 2)
    rows = [(k, 1, k, "I", at, "s", None, "a", 1.0, n, "x") for k in (1, 2, 3) for n in (5, 6, 6)]
    got = changes.applied(spark.createDataFrame(rows, CHANGES)).collect()
    assert sorted((r.change_id, r.status) for r in got) == [(k, s) for k in (1, 2, 3) for s in ("applied", "rejected")]
