"""Main text of pages, with site templates removed.

A page becomes a light element tree. Every container of the whole page, chrome included, has two hashes: one of its tags
and text, and one of its shape alone (tags above it, tags, attributes, distinct child shapes; no text). Spark counts both
per host. A subtree that recurs on many pages of its host goes, by its text wherever it stands, by its shape where it
holds no prose of its own: mostly links, or a small share of those pages' text without paragraphs or headings.

Beside the counts the markup's own word is taken: article roots say where the article is, and what a tag, a role, or a class
or id made of nothing but known words (nav, comments, ad-box) names as no article goes at any count. A class or id that only
holds such a word (legal-analysis, related-work) is counted by its full name and place in or out of the article: it goes where
that recurs on its host, and its text stays where it does not. What remains of the article gives blocks of text.
"""

import hashlib
import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import drop, small, stored, with_columns

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul "
    "caption".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "p": ("table", "td", "th", "caption", "button", "object")}

# Elements that show no text, and those that are named as no article by tag, role, or a word of class or id.
UNSEEN = frozenset(
    "script style noscript template svg math canvas object embed iframe audio video select textarea input dialog head title".split()
)
NAMED = frozenset("nav footer aside form button menu".split())
#: Tags that only format: a shape does not show them.
INLINE = frozenset("b i em strong span u s small big sup sub mark font code abbr time q cite kbd samp var tt ins del br wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement adsense sponsor "
    "sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay comment comments "
    "disqus respond reply "
    "replies share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar login search copyright "
    "legal disclaimer".split()
)
#: Words beside which a known word still says all of a class or id.
NEUTRAL = frozenset(
    "box wrap wrapper container list item items area section block bar panel inner outer site page top bottom left right link links btn sub group "
    "row col column slot unit".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote dd td th figcaption".split())
#: Single blocks of text and parts of lists and tables: within an article their recurrence removes nothing.
SINGLE = HEADINGS | frozenset("p pre blockquote li dt dd tbody thead tfoot tr td th caption figcaption summary option".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A subtree is template if it stands on at least LEAST different pages of its host and on this share of them ...
LEAST, SHARE = 5, 0.3
#: ... or, by its shape, if links make LINKED of its text and it is not EVERYTHING, or if without prose it is at most MASS of its pages' text;
LINKED, EVERYTHING, MASS = 0.5, 0.9, 0.25
#: ... or at one place on LEAST and on the share PLACED, or on ENOUGH, of them; not so single blocks and most of a page's text.
PLACED, ENOUGH = 0.01, 1000
#: What a key is: a subtree's text anywhere or at one place, a shape without or with prose, a name that says it all, article roots,
#: a name that only holds a known word.
ANYWHERE, AT_PLACE, PLAIN, PROSE, NAME, ROOTS, HINT = range(7)


class Node:
    """A tag, its pieces of text and child nodes, its text's size and that of the links' text in it."""

    __slots__ = ("tag", "gone", "named", "root", "parts", "size", "links", "inside", "look", "hint")

    def __init__(self, tag, gone=False, named="", root=False, inside=False, look=b"", hint=""):
        self.tag, self.gone, self.named, self.root, self.inside, self.look, self.hint = tag, gone, named, root, inside, look, hint
        self.parts, self.size, self.links = [], 0, 0


def words_of(token: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


def kind_of(tag: str, attributes: str, in_article: bool) -> tuple[bool, str, bool, bytes, str]:
    """-> (shows no text, the name that says it is no article, article root, what its shape shows of the attributes, the name
    that holds a word of no article among others)"""
    hint = ""
    root, named, look = tag in ("article", "main"), tag if tag in NAMED or tag == "header" and not in_article else "", b""
    if tag in UNSEEN:
        return True, "", False, look, ""
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        a = {k.lower(): entities.unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(attributes)}
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I,
        ):
            return True, "", False, look, ""
        if a.get("role", "").lower() in ROLES:
            named = named or a["role"].lower()
        look = " ".join([*sorted(a), *sorted(x for x in a.get("class", "").split() if not re.search(r"\d", x))]).encode("utf-8", "replace")
        words = f"{a.get('class', '')} {a.get('id', '')}"
        bad = set(words_of(words)) & WORDS
        if root:
            bad &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "related", "sponsored", "promo"}
            # "article no-comments": only names that begin a class or id count on a root
            bad = {w for w in bad if re.search(rf"(?:^|\s){w}", words.lower())}
        if bad and not (in_article and tag in HEADINGS):
            tokens = [t for t in words.split() if set(words_of(t)) & WORDS]
            if root or any(set(words_of(t)) <= WORDS | NEUTRAL for t in tokens):
                named = named or min(bad)
            else:
                hint = " ".join([tag, "in" if in_article else "out", *sorted({" ".join(words_of(t)) for t in tokens})])
        root = root or a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody"
    return False, named, root and not named, look, hint


def tree(text: str) -> Node:
    """The page's tree; every node has its text's size."""
    top = Node("#page")
    stack, at = [top], 0

    def shut():
        node = stack.pop()
        up = stack[-1]
        node.size += sum(len(p) for p in node.parts if isinstance(p, str))
        if not node.gone:
            up.size += node.size
            up.links += node.size if node.tag == "a" else node.links

    def shut_to(tags, stops=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    shut()
                return
            if stack[k].tag in stops:
                return

    while True:
        m = TAG.search(text, at)
        piece = text[at : m.start()] if m else text[at:]
        if piece:
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in VOID:
                shut_to((tag,), ("td", "th", "table") if tag not in BLOCK else ())
            continue
        if tag in VOID:
            stack[-1].parts.append("\n" if tag == "br" else " " if tag != "hr" and tag != "wbr" else "")
            if tag == "hr":
                shut_to(("p",), STOPS["p"])
                stack[-1].parts.append(Node("hr"))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in ENDS_P:
            shut_to(("p",), STOPS["p"])
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                shut_to(CLOSES[tag], STOPS.get(tag, ("table",)))
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            shut()
        inside = stack[-1].inside or stack[-1].root
        gone, named, root, look, hint = kind_of(tag, m[3], inside)
        gone, named = gone or stack[-1].gone, named or stack[-1].named
        node = Node(tag, gone, named, root and not gone and not named, inside, look, hint)
        stack[-1].parts.append(node)
        stack.append(node)
    while len(stack) > 1:
        shut()
    return top


def walk(node: Node):
    """Nodes in page order."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [p for p in reversed(n.parts) if isinstance(p, Node)]


def seen(node: Node, named: bool = False) -> list:
    """The child nodes that show text; without the named ones unless those count."""
    return [p for p in node.parts if isinstance(p, Node) and not p.gone and (named or not p.named)]


def roots(top: Node, without=lambda n: bool(n.named)) -> list:
    """The outermost article roots, or the whole page."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        if n.root and not n.gone and n.size and not without(n):
            out.append(n)
        elif not without(n):
            todo += [p for p in reversed(n.parts) if isinstance(p, Node)]
    # an article within main is the narrower root
    narrow = [
        a for r in out if r.tag != "article" for a in walk(r) if a is not r and a.tag == "article" and a.root and not a.gone and a.size and not without(a)
    ]
    return narrow or out or [top]


def countable(node: Node, whole: bool) -> bool:
    """Containers whose recurrence may remove them; in an article, single blocks of text may not."""
    return node.tag in BLOCK and not node.gone and not node.root and node.size > 0 and node.tag not in ("html", "body") and (whole or node.tag not in SINGLE)


def subtree_keys(text) -> list[dict]:
    """What Spark counts of a page: (kind, key, rest, place, size, links, total).

    For a subtree's text: a hash of the article's text outside of it, and its place, once 0 for any place and, for
    containers of at most half of the article, that counted from the start and from the end of their parent. For a shape:
    a hash of the article's text, and the sizes of its text, of links in it, and of the page's.
    """
    top = tree(text or "")
    main, order = roots(top), list(walk(top))
    whole = main[0] is top
    sums = contents(main)
    total = sum(sums[id(r)] for r in main)
    blank = dict(place=0, size=0, links=0, total=0)
    out = [blank | dict(kind=NAME, key=name_key(n), rest=0) for n in sorted({n.named for n in order if n.named and not n.gone and n.size})]
    out += [blank | dict(kind=HINT, key=name_key("~" + h), rest=signed(total)) for h in sorted({n.hint for n in order if n.hint and not n.gone and n.size})]
    out += [] if whole else [blank | dict(kind=ROOTS, key=ROOT_KEY, rest=0)]
    found = [n for r in main for n in walk(r) if not n.named and countable(n, whole)]
    keys = hashes(main) if found else {}
    if found:
        at, size = places(main), sum(length(r) for r in main)
        placed = lambda n: (0, *at[id(n)]) if n.tag not in SINGLE and 2 * n.size <= size else (0,)
        out += [
            blank | dict(kind=AT_PLACE if p else ANYWHERE, key=k, rest=r, place=p) for k, r, p in sorted(
                {(keys[id(n)], signed(total - sums[id(n)]), p) for n in found for p in placed(n)}
            )
        ]
    # chrome: what is outside of the article roots, or named
    holding = around(order, main)
    outside = [n for n in order if countable(n, True) and (n.named or not whole and id(n) not in sums and id(n) not in holding)]
    if outside:
        rest = hashes([top], named=True, order=order)
        out += [
            blank | dict(kind=ANYWHERE, key=k, rest=signed(total)) for k in sorted(
                {rest[id(n)] for n in outside} - {keys.get(id(n)) for n in found}
            )
        ]
    shape = shapes(top, main, order, holding)
    sizes: dict = {}
    for n, key, kind in shape.values():
        s = sizes.setdefault((kind, key), [0, 0])
        s[0] += n.size
        s[1] += n.links
    out += [
        dict(
            kind=kind, key=key, rest=signed(total), place=0, size=s, links=x, total=length(top),
        ) for (kind, key), (s, x) in sorted(sizes.items())
    ]
    return out


def name_key(name: str) -> int:
    return digest(b"name " + name.encode("utf-8", "replace")) | 1


def around(order: list, main: list) -> set:
    """id() of the article roots and of all nodes that hold one; order: all nodes in page order."""
    out = {id(r) for r in main}
    for n in reversed(order):
        if any(id(c) in out for c in n.parts if isinstance(c, Node)):
            out.add(id(n))
    return out


def shapes(top: Node, main: list, order: list, above: set) -> dict:
    """id(node) -> (node, key of its shape and the tags above it, PLAIN or PROSE), of containers outside of the article.

    The article is what its roots hold; on a page without, what lies in a container that has paragraphs or headings of
    its own and at least half of the page's text.
    """
    looks, prose = {}, {}
    ids = {id(r) for r in main if r is not top}
    for n in reversed(order):
        own, text, p = set(), any(isinstance(x, str) and not x.isspace() for x in n.parts), n.tag in PARAGRAPHS
        for c in seen(n, named=True):
            if c.tag in INLINE:
                own |= looks[id(c)][1]
                text |= looks[id(c)][2]
            elif c.size:
                own.add(looks[id(c)][0])
            p |= prose[id(c)]
        key = digest(
            b"%s(%s)%s%s" % (n.tag.encode("utf-8", "replace"), n.look, b"#" if text else b"", b"".join(b"<%d" % x for x in sorted(own)))
        )
        looks[id(n)], prose[id(n)] = (key, own, text), p
    out, half = {}, length(top) / 2
    todo = [(top, b"")]
    while todo:
        n, path = todo.pop()
        path = digest(b"%s<%s" % (path, n.tag.encode("utf-8", "replace"))).to_bytes(8, "big", signed=True)
        if n is not top and countable(n, False) and id(n) not in above:
            out[id(n)] = n, digest(path + b"%d" % looks[id(n)][0]) | 1, PROSE if prose[id(n)] else PLAIN
        article = id(n) in ids or not ids and n.size >= half and any(c.tag in PARAGRAPHS for c in seen(n))
        if not article:
            todo += [(c, path) for c in seen(n, named=True)]
    return out


def length(root: Node) -> int:
    return root.size or sum(len(p) if isinstance(p, str) else 0 if p.gone else p.size for p in root.parts)


def places(main: list) -> dict:
    """id(node) -> its place by the tags above it and its number among its siblings, from the start and from the end."""
    out = {}
    for r in main:
        todo = [(r, b"")]
        while todo:
            n, path = todo.pop()
            path = digest(b"%s<%s" % (path, n.tag.encode("utf-8", "replace"))).to_bytes(8, "big", signed=True)
            below = [p for p in seen(n) if p.size]
            for k, p in enumerate(below):
                out[id(p)] = digest(b"%s+%d" % (path, k)), digest(b"%s-%d" % (path, len(below) - k))
                todo.append((p, path))
    return out


def digest(data: bytes) -> int:
    """A hash that is equal on all machines (Python's own is not, for text)."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


#: Keys of text are even, all others odd: a page whose host has no key of text needs no hashes of its text.
ROOT_KEY = digest(b"roots") | 1


def signed(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def hashes(main: list, named: bool = False, order: list | None = None) -> dict:
    """id(node) -> hash of its subtree's tags and text, without what shows no text or, unless those count, is named."""
    out = {}
    for r in main:
        for n in reversed(order or list(walk(r))):
            parts = [
                p.encode("utf-8", "replace") if isinstance(p, str) else b"\0%d" % out[id(p)] for p in n.parts if isinstance(p, str) or not p.gone and (named or not p.named)
            ]
            out[id(n)] = digest(b"\0<".join((n.tag.encode("utf-8", "replace"), *parts))) & ~1
    return out


def contents(main: list) -> dict:
    """id(node) -> sum of the hashes of its pieces of text, without what is not article."""
    out = {}
    for r in main:
        for n in reversed(list(walk(r))):
            lines = [" ".join(p.split()) for p in n.parts if isinstance(p, str)]
            out[id(n)] = sum(digest(x.encode("utf-8", "replace")) for x in lines if x) + sum(out[id(p)] for p in seen(n))
    return out


def dropped(top: Node, main: list, keys: set) -> set:
    """id() of the nodes whose subtree is template by one of the keys."""
    whole, names, order = main[0] is top, {}, list(walk(top))
    holding = around(order, main)
    texts = any(not k & 1 for k in keys)
    inner, rest = (hashes(main), hashes([top], named=True, order=order)) if texts else ({}, {})
    shape = shapes(top, main, order, holding)
    out = set()
    for n in order:
        k = id(n)
        if n.named:
            if n.named not in names:
                names[n.named] = name_key(n.named) in keys
            gone = names[n.named]
        else:
            gone = False
        if gone or n.hint and name_key("~" + n.hint) in keys or k in shape and shape[k][1] in keys:
            out.add(k)
        elif not texts:
            continue
        elif k in inner and not n.named and countable(n, whole):
            if inner[k] in keys:
                out.add(k)
        elif countable(n, True) and rest[k] in keys and (n.named or k not in holding):
            out.add(k)
    return out


def main_text(text, templates=None) -> str:
    """The blocks of the article, one a line.

    templates: keys of what to leave out, as templates() counts them for the page's host; with none of them all that shows
    text is given. None stands for a page of no counted host: names and article roots decide.
    """
    top = tree(text or "")
    if templates is None:
        gone, main = set(), roots(top)
        out_of = lambda n: bool(n.named)
    else:
        keys = set(templates)
        gone = dropped(top, roots(top), keys) if keys else set()
        out_of = lambda n: id(n) in gone
        main = roots(top, out_of) if ROOT_KEY in keys else [top]
    blocks, words = [], []

    def flush():
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    for r in main:
        todo = [r]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                words.append(n)
            elif n.gone or out_of(n):
                if n.tag in BLOCK:
                    flush()
            elif n.tag == "header" and n.inside and (templates is None or keys):  # of an article's own header, its headings
                todo += [None, *(h for h in reversed([x for x in walk(n) if x.tag in HEADINGS and not x.gone and not out_of(x)]))]
            else:
                if n.tag in BLOCK or n.tag == "#page":
                    flush()
                    todo.append(None)
                todo += reversed(n.parts)
        flush()
    return "\n".join(blocks)


def host(url: str = "url"):
    """Lower-case host of a URL, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


COUNTED = "array<struct<kind:int,key:long,rest:long,place:long,size:long,links:long,total:long>>"


def templates(pages: DataFrame) -> DataFrame:
    """(host, templates): keys of what recurs on many different pages of a host, and of the names that decide by themselves.

    Pages count by their article's text (for a subtree of the article, by that outside of it), so that copies of a page, also
    near ones, count once and an article's body is no template of its copies. What recurs on a small share of a host's
    pages is template, not a passage that they share, if it is a container and stands at the same place. A host's list is
    bounded by its pages' mean number of subtrees over PLACED, or times its pages over ENOUGH; names are a fixed list.
    """
    p = pages.select(host().alias("host"), F.xxhash64("html").alias("page"), F.col("html"))
    keyed = stored(with_columns(p, "html", lambda htmls: [[subtree_keys(x) for x in htmls]], f"subtrees {COUNTED}"), "html-keys")
    n_pages = keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    every = keyed.select("host", F.inline("subtrees")).distinct().groupBy("host", "kind", "key", "place")
    counts = every.agg(F.count("*").alias("on"), *[F.sum(c).alias(c) for c in ("size", "links", "total")])
    kind, share = F.col("kind"), SHARE * F.col("pages")
    mostly_links = (F.col("links") >= LINKED * F.col("size")) & (F.col("size") <= EVERYTHING * F.col("total"))
    without_prose = (kind == PLAIN) & (F.col("size") <= MASS * F.col("total"))
    recurs = (
        F.when(kind == ANYWHERE, F.col("on") >= share)
        .when(kind.isin(AT_PLACE, HINT), F.col("on") >= F.least(PLACED * F.col("pages"), F.lit(float(ENOUGH))))
        .when(kind.isin(PLAIN, PROSE), (F.col("on") >= share) & (mostly_links | without_prose))
        .otherwise(F.lit(True))
    )
    many = counts.where((F.col("on") >= LEAST) | kind.isin(NAME, ROOTS)).join(n_pages, "host").where(recurs)
    found = stored(many.groupBy("host").agg(F.collect_set("key").alias("templates")), "html-templates")
    drop(keyed)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars.

    text is '' for a null or empty page and for one without article text; each input row gives one row. Pages without a
    host (a null or odd URL) are counted together. On a host of fewer than LEAST different pages nothing can recur often
    enough, so only names and article roots decide there.
    """
    known = small(templates(pages))
    p = pages.select("page_id", "url", "html", host().alias("host")).join(known, "host", "left")
    p = p.select(
        "page_id", "url", F.struct("html", F.coalesce("templates", F.array().cast("array<long>")).alias("templates")).alias("page"),
    )
    out = with_columns(p, "page", lambda rows: [[main_text(r["html"], r["templates"]) for r in rows]], "text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
