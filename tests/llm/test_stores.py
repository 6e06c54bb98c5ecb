"""WARC, media, HTML, embeddings and the pipeline on small fixtures."""

import gzip
import hashlib
import io
import os
import random
import re
import tarfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnwatch.llm import embed_dedup, html_extract, media, mixing, ngram_join, packing, pipeline, quality, sharding, toxicity, warc
from tarnwatch.llm import vectext as V
from tarnwatch.llm.common import held_out, small, stored, table

PAGES = "page_id long, url string, html string, digest string"


def pages(spark):
    rows = [
        (1, "http://a/1?q=\xe9", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "other \xe9"), (4, "http://a/\r\nX: y", None),
        (5, "http://b", ""), (6, "u", "solo"), (6, "u", "solo"), (None, "n", "<p>same</p>"), (7, "big", "x" * 300_000), (-8, "neg", "-"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES), rows


def test_warc_round_trip(spark):
    p, rows = pages(spark)
    index = warc.write(p)
    got = {(r.page_id, r.payload_digest): r for r in warc.read(index).collect()}
    assert warc.read(index).count() == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        r = got[(i, warc.sha1_base32(b))]
        assert r.payload_bytes == len(b)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == b
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got.values()}
    assert {
        (1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (4, "revisit", 5), (5, "response", None), (6, "response", None),
        (-8, "response", None),
    } <= kind


def test_warc_files_are_plain_gzip_members(spark):
    p, rows = pages(spark)
    index = warc.write(p)
    files = {r.file for r in index.select("file").collect()}
    text = b"".join(gzip.decompress(open(f.removeprefix("file://"), "rb").read()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: y" not in text


def test_warc_index_selects_and_coalesces(spark):
    p, _ = pages(spark)
    index = warc.write(p.coalesce(1))
    assert warc.ranges(index).count() == index.select("file").distinct().count() <= 2  # repeated page_ids are written apart
    assert warc.ranges(index, gap=-1).count() == index.count()
    one = warc.read(index, F.col("page_id") == 3).collect()
    assert [bytes(r.payload).decode() for r in one] == ["other \xe9"]
    small = warc.write(p, least=100)
    assert warc.read(small).where("record_type = 'revisit'").isEmpty()
    assert warc.read(warc.write(p.where("false"))).count() == 0


DOCS = "doc_id long, text string, digest string"


def test_media_round_trip(spark):
    texts = [None, "", "a", "\xe9" * 400, "x" * 576, "x" * 577, "long " * 50_000, "a"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")], DOCS)
    out = media.media(d).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        p = b + b"\xff" * (max(-(-len(b) // 576), 1) * 576 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.digest, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            png = f.read(r.length)
        assert hashlib.sha256(png).hexdigest() == r.media_sha256 and len(png) == r.media_bytes and media.from_png(png) == p
        names = tarfile.open(fileobj=io.BytesIO(open(r.file.removeprefix("file://"), "rb").read())).getnames()
        assert f"{r.digest}.png" in names and len(names) == len(set(names))
    by = {r.doc_id: r for r in out}
    same = lambda a, b: [getattr(a, c) == getattr(b, c) for c in ("media_sha256", "feature", "file", "offset")]
    assert all(same(by[2], by[7])) and all(same(by[0], by[1]))
    assert media.media(d.where("false")).count() == 0


def test_a_task_that_forgets_payloads_keeps_one_place(spark, monkeypatch):
    monkeypatch.setattr(media, "SEEN", 2)
    d = spark.createDataFrame([(i, f"text {i % 5}", "") for i in range(40)], DOCS).coalesce(1)
    rows = media.store(d)
    assert rows.select("file", "offset").distinct().count() > 5 == media.catalogue(rows).count()
    out = media.media(d).collect()
    assert len(out) == 40 and len({(r.digest, r.file, r.offset) for r in out}) == 5


def test_repeated_page_ids_have_names_of_their_own(spark):
    rows = [(1, "u", "<p>a</p>", None)] * 3 + [
        (2, "u", "<p>b</p>", None), (None, "u", "x", None), (None, "u", "y", None), (5, None, "<p>a</p>", None),
        (-7, "u", "<p>a</p>", None),
    ]
    index = warc.write(spark.createDataFrame(rows, PAGES))
    names = []
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            names.append(re.search(rb"WARC-Record-ID: <(.*?)>", gzip.decompress(f.read(r.length)))[1])
    assert len(set(names)) == len(rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=str)
    want = [(1, "revisit", 5)] * 3 + [
        (2, "response", None), (None, "response", None), (None, "response", None), (5, "response", None), (-7, "revisit", 5),
    ]
    assert got == sorted(want, key=str)


def test_header_reads_give_metadata(spark):
    d = spark.createDataFrame([(1, "x" * 1000, "")], DOCS)
    r = media.metadata(media.catalogue(media.store(d))).first()
    assert (r.width, r.height) == (576, 2)


def page(body, head="", tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}{tail}"


def test_main_text():
    m = html_extract.main_text
    a = "<nav><ul><li>menu</li></ul></nav><header><h1>Site</h1></header><article class='post no-comments'><h1>T&amp;t</h1><p>one\n  two&nbsp;<b>three</b><p>four<br>five</p><div class='ad-box'>buy</div><ul><li>x<li>y</ul><section id='comments'><p>reader</p></section></article><aside>side</aside><div id='cookieNotice'>c</div><footer>f</footer>"
    assert m(page(a)) == "T&t\none two three\nfour five\nx\ny"
    assert m(page("<p>a<script>var t='</p>';</script>b</p><style>p{}</style><form>f</form>")) == "ab"
    assert m("plain &lt;text&gt; &#233; &am") == "plain <text> \xe9 &am"
    assert m(None) == m("") == m("<article></article>") == ""
    assert m("<article><p>cut off <b>he") == "cut off he"
    assert m("<div hidden>no</div><div style='display: none'>no</div><div role='navigation'>no</div>yes") == "yes"
    assert m("<main><div>lead</div><article><p>a</p></article></main>") == "a"
    assert m("<p>" * 5000 + "deep" + "<div>" * 5000 + "er") == "deep\ner"
    assert m("<article><header><h1>H</h1><p>by</p></header><p>b</p></article>") == "H\nb"
    assert m("1 < 2 and <b") == "1 < 2 and <b"


def test_templates_go_articles_stay(spark):
    body = lambda i: f"<div>Welcome to our site</div><div><p>story {i}</p><p>shared passage</p></div><div>links and more</div>"
    art = lambda i: f"<article><p>shared passage</p><p>story {i}</p><div>Rate this</div></article>"
    rows = [(i, f"http://a.example/{i}", page(body(i))) for i in range(12)] + [
        (100 + i, f"https://u@B.example:8080/{i}", page(art(i))) for i in range(12)
    ] + [(200, "http://c.example/", page(body(0))), (201, None, None)]
    rows += [(300 + i, "http://copies.example/", page("<p>only copies</p>")) for i in range(20)]
    p = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, text string, host string")
    out = {r.page_id: r for r in html_extract.extract(p).collect()}
    assert len(out) == len(rows)
    assert out[3].text == "story 3" and out[103].text == "shared passage\nstory 3"
    assert out[200].text.startswith("Welcome") and out[201].text == "" and out[300].text == "only copies"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_extract.extract(p.where("false")).count() == 0


def test_templates_with_prose_in_articles_go(spark):
    promo = "<div class='x9'><h3>Stay close</h3><p>Get <b>letters</b></p></div>"
    links = "<section><h2>Elsewhere</h2><ul><li>one<li>two</ul></section>"
    art = lambda i: f"<article><header><h1>Title {i}</h1></header><div><p>story {i}</p>{promo}<p>shared passage</p><table><tr><td>shared cell</table></div>{links}</article>"
    rows = [(i, f"http://a.example/{i}", page(art(i))) for i in range(12)]
    # copies of one article whose pages differ elsewhere: its body is no template
    rows += [
        (
            100 + i, f"http://b.example/{i}", page(f"<nav>{i}</nav><article><h1>One</h1><div><p>the body</p></div></article>"),
        ) for i in range(12)
    ]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3\nstory 3\nshared passage" and all(out[100 + i] == "One\nthe body" for i in range(12))
    # one host's table differs by page: it stays
    rows = [
        (
            i, "http://c.example/", page(f"<article><p>story {i}</p><table><tr><td>cell</td><td>{i}</td></tr></table>{promo}</article>"),
        ) for i in range(12)
    ]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "story 3\ncell\n3"


def test_templates_on_a_small_share_of_pages_go(spark):
    story = lambda i, n: "".join(f"<p>story {i} {k} of many words</p>" for k in range(n))
    promo, notice, passage = (
        lambda v: f"<div><p>variant {v}</p></div>"
    ), "<section><p>closed</p></section>", "<div><p>as they said</p></div>"
    quote = "<blockquote>well known</blockquote>"
    body = lambda i: f"{notice if i % 16 == 0 else quote if i % 16 == 1 else ''}{story(i, 4 + i % 3)}{promo(i % 4)}"
    rows = [(i, "http://a.example/", page(f"<article>{body(i)}</article>")) for i in range(96)]
    # a passage that six of the pages share, each at another place
    rows += [
        (
            100 + i, "http://a.example/", page(f"<article>{story(100 + i, 2 + i)}{passage}{story(200 + i, 3 + 2 * i)}</article>"),
        ) for i in range(6)
    ]
    # no article root; too few pages
    rows += [(200 + i, "http://b.example/", page(f"{story(i, 3)}{promo(i % 4)}")) for i in range(40)]
    rows += [(300 + i, "http://c.example/", page(f"<article>{story(i, 3)}{promo(0)}</article>")) for i in range(4)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("variant" in out[i] or "closed" in out[i] for i in (*range(96), *range(200, 240)))
    assert all("as they said" in out[100 + i] for i in range(6)) and all("well known" in out[i] for i in range(1, 96, 16))
    assert all(out[i].count("story") == 4 + i % 3 for i in range(96)) and all("variant 0" in out[300 + i] for i in range(4))


def counted(pages):
    """Brute force: (host, html) -> host: the keys that recur, by plain sets."""
    n, seen, out = {}, {}, {}
    for host, x in pages:
        n.setdefault(host, set()).add(x)
        for k in html_extract.subtree_keys(x):
            seen.setdefault((host, k["kind"], k["key"], k["place"]), set()).add(tuple(sorted(k.items())))
    for (host, kind, key, _), rows in seen.items():
        on, pages_ = len(rows), len(n[host])
        size, links, total = (sum(dict(r)[c] for r in rows) for c in ("size", "links", "total"))
        if kind in (html_extract.NAME, html_extract.ROOTS):
            keep = True
        elif kind == html_extract.ANYWHERE:
            keep = on >= 5 and on >= 0.3 * pages_
        elif kind in (html_extract.AT_PLACE, html_extract.HINT):
            keep = on >= 5 and on >= min(0.01 * pages_, 1000)
        else:
            keep = on >= 5 and on >= 0.3 * pages_ and (
                2 * links >= size and size <= 0.9 * total or kind == html_extract.PLAIN and 4 * size <= total
            )
        if keep:
            out.setdefault(host, set()).add(key)
    return out


def site(i, div=False):
    """A page whose menu, advert and footer differ on every page, as tags or as bare divs; and its article's text."""
    rng = random.Random(i)
    words = lambda n: " ".join(rng.choice("oak elm ash fir yew bay fig".split()) + str(rng.randrange(99)) for _ in range(n))
    title, story = words(4), [words(rng.randrange(5, 60)) for _ in range(rng.randrange(2, 6))]
    menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(rng.randrange(3, 8)))
    x = f"<nav><ul>{menu}</ul></nav><div class='ad'>{words(4)}</div><article><h1>{title}</h1><p>{'<p>'.join(story)}</article><footer>&copy; {words(5)}</footer>"
    if div:
        x = re.sub("<(/?)(?:nav|article|footer)", r"<\1div", x).replace(" class='ad'", "")
    return page(x), "\n".join([title, *story])


def test_chrome_of_other_words_goes_by_its_shape(spark):
    rows, want = [], {}
    for i in range(60):
        rows.append((i, f"http://{'div' if i % 2 else 'tags'}.example/{i}", (site(i, i % 2 == 1))[0]))
        want[i] = site(i)[1]
    hosts = {i: u.split("/")[2] for i, u, _ in rows}
    keys = counted((hosts[i], x) for i, _, x in rows)
    assert all(html_extract.main_text(x, keys[hosts[i]]) == want[i] for i, _, x in rows)
    # without the counts nothing goes: neither tags nor classes decide by themselves
    assert all(len(html_extract.main_text(x, ())) > len(want[i]) for i, _, x in rows)
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.host: set(r.templates) for r in html_extract.templates(p).collect()} == keys
    assert {r.page_id: r.text for r in html_extract.extract(p).collect()} == want


def test_counts_equal_brute_force_on_the_given_pages(spark):
    d = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(d):
        return
    p = spark.read.parquet(d)
    rows = p.withColumn("host", html_extract.host()).collect()
    keys = counted((r.host, r.html) for r in rows)
    assert {r.host: set(r.templates) for r in html_extract.templates(p).collect()} == keys
    assert {r.page_id: r.text for r in html_extract.extract(p).collect()} == {
        r.page_id: html_extract.main_text(r.html, keys.get(r.host, ())) for r in rows
    }


def test_names_decide_where_too_rare_to_count(spark):
    rows = [
        (
            i, "http://a.example/",
            page(f"<article><p>story {i} of words</p>{'<section class=comments><p>reader</p></section>' if i == 3 else ''}</article>"),
        ) for i in range(20)
    ]
    rows += [
        (100, "http://b.example/", page("<nav>menu</nav><div>lead</div><p>text</p>")),
        (101, None, page("<aside>x</aside><p>y" + "z" * 200_000)),
    ]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "story 3 of words" and out[100] == "lead\ntext" and out[101] == "y" + "z" * 200_000


def test_names_that_hold_a_known_word_must_recur(spark):
    """Prose under a name like legal-analysis stays where that is one article's own, whatever other names its host uses."""
    own = {
        3: "<div id='legal-analysis'><p>The court held that</p></div>", 4: "<div class='related-work'><h2>Before</h2><p>Others wrote</p></div>",
        5: "<section class='comment-on-the-law'><p>As it stands</p></section>",
    }
    end = "<div class='legal'>terms</div><div class='cookie-banner'>we use</div>"
    rest = lambda i: ("<section class='comments'><p>reader</p></section>" if i % 10 == 0 else "") + (f"<div class='share-this-story'><p>to {i}</p></div>" if i % 2 else "")
    rows = [(i, f"http://a.example/{i}", page(f"<article><p>story {i} of words</p>{own.get(i, '')}{rest(i)}</article>{end}")) for i in range(40)]
    rows += [(100, "http://b.example/", page(f"<article><p>story</p>{own[3]}</article>{end}"))]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3].endswith("The court held that") and out[4].endswith("Before\nOthers wrote") and out[5].endswith("As it stands")
    assert out[100] == "story\nThe court held that"
    assert all(out[i] == f"story {i} of words" for i in range(40) if i not in own)


def test_shapes_leave_an_article_of_divs(spark):
    story = lambda i: "".join(f"<div>paragraph {i} {k} of quite a few words</div>" for k in range(3 + i % 4))
    rows = [
        (
            i, "http://a.example/",
            page(f"<div><a href='/'>home</a> <a href='/{i}'>next {i}</a></div><div>{story(i)}</div><div>note {i}</div>"),
        ) for i in range(20)
    ]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == "\n".join(f"paragraph {i} {k} of quite a few words" for k in range(3 + i % 4)) for i in range(20))


def brute(rows, threshold=0.98):
    up, n = {}, [0] * len(rows)
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    fit = [
        i is not None and v is not None and lab is not None and len(v) > 0 and all(
            x is not None and np.isfinite(x) for x in v
        ) and any(v) for i, v, lab in rows
    ]
    for a in range(len(rows)):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                    up[q] = p
    return sorted(((i, n[k], None if i is None else find(i)) for k, (i, _, _) in enumerate(rows)), key=str)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(8):
        c = rng.normal(size=32)
        rows += [
            (
                len(rows) + k, (c + rng.normal(scale=0.13 * rng.random(), size=32)).astype(np.float32).astype(float).tolist(), g % 3,
            ) for k in range(20)
        ]
    return rows


def test_embeddings_equal_brute_force(spark):
    rows = vectors()
    n = len(rows)
    rows += [
        (n + 1, None, 1), (n + 2, [0.0] * 32, 1), (n + 3, [None] + [1.0] * 31, 1), (n + 4, [float("nan")] * 32, 1),
        (n + 5, [float("inf")] + [1.0] * 31, 1), (n + 6, rows[0][1], None), (n + 7, [], 1), (None, rows[0][1], 0), (n + 8, [1.0, 2.0], 1),
        (n + 9, [2.0, 4.0], 1),
    ]
    rows += [(n + 20 + k, rows[5][1], rows[5][2]) for k in range(6)]
    t = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    out = embed_dedup.embedding_dedup(t).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert embed_dedup.embedding_dedup(t.where("false")).count() == 0


def test_tiles_agree_with_one_block(spark, monkeypatch):
    t = spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>, label int")
    one = sorted(map(str, embed_dedup.embedding_dedup(t).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    monkeypatch.setattr(embed_dedup, "VALUES", 1)
    assert sorted(map(str, embed_dedup.embedding_dedup(t).collect())) == one


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = embed_dedup.units(rng.normal(size=(400, 64)))
    y = embed_dedup.units(x + rng.normal(scale=0.02, size=x.shape))
    codes, f = embed_dedup.encode(list(x))
    turned = y @ embed_dedup.rotation(64).T
    rows = embed_dedup.signs(codes, 64)
    est, true = (rows * turned).sum(1) / f, (x * y).sum(1)
    assert abs((est - true).mean()) < 0.01
    assert (np.abs(est - true) <= np.sqrt(1 - f**2) / f * np.sqrt(1 - true**2) + 1e-5).all()
    maybe = embed_dedup.could_link(
        rows, f, embed_dedup.units(rng.normal(size=(500, 64))).astype(np.float32) @ embed_dedup.rotation(64).T.astype(np.float32), 0.98,
    )
    assert maybe.mean() < 0.01 and embed_dedup.could_link(rows, f, turned.astype(np.float32), 0.98).diagonal()[true >= 0.98].all()


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    docs, columns = table(spark, d, "documents"), None
    before = docs.count()
    for name, stage in C.STAGES:
        out = stored(stage(spark, docs, d), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "n-gram Jaccard join":
            assert out.select("doc_id").distinct().count() == out.count() <= before
        docs, before, columns = out, out.count(), out.columns
    assert before > 50 and "batch" in columns
    assert C.run(spark, d).count() == before


def odd_rows(spark, n=0):
    """Nulls in every column, empty and very long texts, repeated rows, one doc_id with unlike texts, columns that clash."""
    long = " ".join(f"w{k % 7919}x{k}" for k in range(30_000))
    rows = [
        (1, None, None, None, None), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0),
        (3, long, "en", "a", 1), (4, long + " more", "en", None, 1),
    ]
    rows += [
        (5, "one two three four five six", "en", "a", 1), (5, "quite another text of more words", "en", "a", 1),
        (6, "One two three FOUR five six", "en", "a", 1),
    ] + [(7, "the same row again and again", "en", "b", 1)] * 3
    rows += [
        (None, "a text without an id here", "en", "b", 1), (8, "a text without an id here", "en", "b", 1),
        (None, "another one without an id too", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    clash = ("copies", "of", "copy", "_row", "_rid", "component_id", "n", "m", "part", "k", "bucket", "h", "rows", "score", "size", "key")
    return df.withColumns({c: F.lit(c) for c in clash}).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).where(f"{1 - n} = 1")


def labels_dir(spark, tmp_path, name, rows):
    d = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_of_odd_rows(spark, tmp_path):
    docs, none = odd_rows(spark), odd_rows(spark, 1)
    d = labels_dir(spark, tmp_path, "none", [])
    one = labels_dir(spark, tmp_path, "one", [(i, 1, 1) for i in range(9)])
    for where in (d, one):
        # no labels, or of one class: nothing is rejected
        assert pipeline.toxicity(spark, docs, where).count() == docs.count() == pipeline.quality(spark, docs, where).count()
    both = labels_dir(spark, tmp_path, "both", [(i, i % 2, i % 2) for i in range(9)])
    for stage in (pipeline.toxicity, pipeline.quality):
        out = stage(spark, docs, both)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, none, both).count() == 0
    for _, stage in pipeline.STAGES[2:]:
        assert stage(spark, none, d).count() == 0
    out = pipeline.near_duplicates(spark, docs, d)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, (r.text or "")[:12]) for r in out.collect()), key=str)
    # unlike texts of doc_id 5 are two documents, 6 copies one of them; 8 stays, not its copy without an id; equal rows once
    want = [
        (1, ""), (None, ""), (2, ""), (3, "w0x0 w1x1 w2"), (5, "quite anothe"), (6, "One two thre"), (7, "the same row"),
        (8, "a text witho"), (None, "another one "),
    ]
    assert kept == sorted(want, key=str)
    out = pipeline.mixing(spark, docs, d)
    assert out.columns == docs.columns
    packed = pipeline.packing(spark, docs, d)
    assert packed.count() == docs.count() and packed.where("n_tokens = 0").count() == 4


def test_operators_of_odd_rows(spark, tmp_path):
    """Every dealt operator over documents gives a row for each, or none of an empty table."""
    docs, none = odd_rows(spark), odd_rows(spark, 1)
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int",
    ).withColumn("text", F.lit("clash"))
    for f in (
        lambda x: toxicity.toxicity(x, labels), lambda x: quality.quality(x, labels), sharding.shard, mixing.mix, ngram_join.ngram_join,
        packing.pack, media.media,
    ):
        assert f(docs).count() == docs.count() and f(none).count() == 0


def test_models_of_one_class(spark):
    docs = odd_rows(spark)
    for share, y in ((12 / 13, 1), (1 / 13, 0)):
        labels = spark.createDataFrame([(i, y, y) for i in range(100)], "doc_id long, quality int, toxic int")
        ids = docs.select("doc_id").where(
            "doc_id is not null and text is not null"
        ).distinct().join(labels.where(~held_out()), "doc_id").count()
        share = (ids * y + 1) / (ids + 2)
        for f in (toxicity.toxicity, quality.quality):
            assert all(abs(r.score - share) < 1e-6 for r in f(docs, labels).collect())


def test_fit_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000, None, None, 0) for i in range(200)], DOC)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled(docs, labels, "quality", 50, 20_000).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 10, 1: 10}
    assert toxicity.labelled(docs, labels, "quality", 50, 1).count() == 2


def test_noisy_or_equals_a_plain_loop():
    """Scores of a fitted model, sentence by sentence and word by word."""
    rng = random.Random(3)
    words = "river stone cloud vile grub meadow lantern".split()
    texts = [
        ". ".join(
            " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 5))
        ) + "." for _ in range(120)
    ] + ["", "...", "\xe9t\xe9 vile!\nnew line"]
    y = [int("vile" in t) for t in texts]
    w, bias = toxicity.fit(texts, y)
    got = toxicity.scores(texts, (w, bias))[0]
    for t, g in zip(texts, got, strict=True):
        none = 1.0
        for s in re.split(r"[.!?\n]", t):
            own = {x for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())}
            if own:
                z = bias
                for x in own:
                    chunk = V.Chunk([x.encode()], ~V.LETTER, lower=True)
                    for size in (0, *[n for n in toxicity.PREFIXES if len(x) >= n]):
                        end = len(x[:size].encode()) if size else len(x.encode())
                        h = chunk.of(np.array([0]), np.array([end]))
                        h = V.mix(h + V.U(1000 + size)) if size else h
                        z += float(w[int(h[0] >> V.U(64 - toxicity.BITS))])
                none *= 1 - 1 / (1 + np.exp(-z))
        assert abs(g - (1 - none)) < 1e-5
    assert np.mean((got >= 0.3) == np.array(y)) > 0.95


def test_quality_score_equals_a_plain_loop():
    """The average of learned values, feature by feature."""
    rng = random.Random(4)
    good = [" ".join(rng.choice("river stone cl\xf4ud meadow".split()) + str(k) for k in range(rng.randrange(3, 20))) for _ in range(40)]
    bad = [" ".join(rng.choice("river stone".split()) for _ in range(rng.randrange(3, 20))) for _ in range(40)]
    model = quality.fit(good + bad, [1] * 40 + [0] * 40)
    texts = [good[0], bad[0], "", "one", "\xfc\xfc \xfc\xfc a"]
    bucket = lambda h: int(h >> V.U(64 - quality.BITS))
    for t, got in zip(texts, quality.scores(texts, model), strict=True):
        values, seen, before = [], {}, 63
        for k, word in enumerate(t.split()):
            raw = word.encode()
            chunk = V.Chunk([raw], V.SPACE)
            own = [model[0][bucket(chunk.of(np.array([0]), np.array([len(raw)]))[0])]]
            for size in quality.INNER:
                for c in range(len(word) - size + 1):
                    a, b = len(word[:c].encode()), len(word[: c + size].encode())
                    own.append(model[0][bucket(V.mix(chunk.of(np.array([a]), np.array([b])) + V.U(2000 + size))[0])])
            since = k - seen[word] if word in seen else 0
            symbol = 1 + int(np.ceil(np.log2(since))) if since else 0
            seen[word] = k
            values += [np.mean(own), model[0][bucket(V.mix(np.array([before * 64 + symbol + 1], V.U) * V.BASE)[0])]]
            before = symbol
        z = (np.mean(values) if values else 0) + model[1]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5
    assert (quality.scores(good, model) > 0.5).all() and (quality.scores(bad, model) < 0.5).all()


def test_broadcasts_are_bounded_in_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    few = stored(spark.createDataFrame([(1, "x" * 5000)], "a long, b string"), "small")
    assert hinted(small(few)) and not hinted(small(few, 4000)) and not hinted(small(stored(spark.range(1000), "small"), 16_000))
    assert hinted(small(stored(spark.range(0), "small"), 0))
