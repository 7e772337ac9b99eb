"""Main text of web pages by a linear-chain conditional random field.

A page is cut into the leaf blocks of its DOM: runs of text between the starts and
ends of block elements, with the elements above them. Each block has features of
those elements (tags, class and id words) and of its text (length, share of link
text, punctuation, place on the page). A chain of the labels "rest" and "main" is
decoded by Viterbi; its weights are trained on labelled pages by penalised
maximum likelihood (forward-backward, in numpy, on the driver: a bounded number
of pages), and broadcast.

The given pages carry no labels, so the model is trained on pages that
:func:`labelled_pages` composes of the usual parts of sites, each block's label
known; :func:`train` takes any other labelled pages as well.
"""
from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import table, tune

# Elements by their role in the cut (fixed values)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
#: elements of formulas and drawings: inline, but blocks that hold their text have the root's mark
FOREIGN = set("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded "
              "mphantom menclose mmultiscripts mprescripts merror maction semantics annotation annotation-xml "
              "svg g path circle ellipse rect line polyline polygon text tspan textpath defs symbol use marker pattern mask clippath "
              "lineargradient radialgradient stop filter foreignobject desc metadata view switch animate set".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: their content is no text of the page: raw text, and templates, which are not shown
RAW = set("script style template title textarea iframe xmp noembed noframes".split())
#: elements whose start ends an open one of the same kind, up to the container
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",),
                "td": ("td", "th"), "th": ("td", "th")}
#: blocks that cannot stand in a paragraph and so end it
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr main menu nav ol p pre search section summary table ul".split())

_TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?][^>]*+>|/[^a-zA-Z][^>]*+>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {}


class Block:
    __slots__ = ("parts", "marks", "near", "links", "text", "tag")

    def __init__(self, marks: tuple, near: tuple, tag: str):
        self.parts, self.marks, self.near, self.links, self.text, self.tag = [], marks, near, 0, "", tag


def _marks(tag: str, attrs: str) -> tuple:
    """Features of an element: its tag, and words of its class, id and role."""
    found = ["t:" + tag]
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                found.append("hidden")
            elif name in ("class", "id", "role"):
                found += ["c:" + w.lower() for w in _WORD.findall(value)]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page, in order; text decoded, white space folded, empty ones left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple, tuple]] = []  # open block elements, the marks of all of them and of the two nearest
    opened: Counter = Counter()
    now: Block | None = None
    in_link = 0
    roots: set[str] = set()  # open roots of formulas and drawings
    at, n = 0, len(page)

    def say(text: str) -> None:
        nonlocal now
        if now is None:
            now = Block(*(stack[-1][1:] if stack else ((), ())), stack[-1][0] if stack else "")
            out.append(now)
        now.parts.append(text)
        if roots and not text.isspace():
            now.marks += tuple(m for r in sorted(roots) if (m := "t:" + r) not in now.marks)
        if in_link and not text.isspace():
            now.links += len(text)

    def close(i: int) -> None:
        nonlocal now
        opened.subtract(e[0] for e in stack[i:])
        del stack[i:]
        now = None

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(entities.unescape(page[at:]))
            break
        if lt > at:
            say(entities.unescape(page[at:lt]))
        m = _TAG.match(page, lt)
        if m is None:
            gt = page.find(">", lt) if page[lt + 1:lt + 2].isalpha() or page[lt + 1:lt + 2] == "/" else -1
            if gt < 0:  # no tag: the sign itself
                say("<")
                at = lt + 1
                continue
            m = re.match(r"<(/?)([a-zA-Z]?[^\s/>]*)([^>]*)>", page[lt:gt + 1])
            at = gt + 1
            if m is None:
                continue
        else:
            at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in INLINE or tag in VOID or tag in FOREIGN:
                if tag in roots:
                    roots.remove(tag)
                if tag == "br":
                    say(" ")
                continue
            now = None
            in_link = 0
            if opened[tag] > 0:
                close(max(i for i in range(len(stack)) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            in_link = 1
        elif tag in VOID:
            if tag == "hr":
                now = None
        elif tag in FOREIGN:
            if tag in ("math", "svg") and not m[3].endswith("/"):
                roots.add(tag)
        elif tag not in INLINE:
            roots.clear()  # a block element ends them, as in browsers
            ends = SELF_CLOSING.get(tag, ())
            if tag in ENDS_P:
                ends = (*ends, "p")
            for i in range(len(stack) - 1, -1, -1) if any(opened[e] > 0 for e in ends) else ():
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "section", "article", "select", "td", "th", "body", "button"):
                    break
            above = stack[-1][1] if stack else ()
            own = _marks(tag, m[3])
            near = stack[-1][2][-1:] if stack else ()
            stack.append((tag, above + tuple(x for x in own if x not in above), (*near, own)))
            opened[tag] += 1
            now = None
            in_link = 0
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.parts = []
        if b.text:
            kept.append(b)
    return kept


def features(page: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out = []
    for i, b in enumerate(page):
        n, words = len(b.text), b.text.count(" ") + 1
        out.append([
            "1", *b.marks, *(f"near{len(b.near) - k}:{m}" for k, own in enumerate(b.near) for m in own), "own:" + b.tag, f"size:{min(words.bit_length(), 7)}", f"links:{min(4, 5 * b.links // max(n, 1))}",
            f"stop:{b.text[-1] in '.!?…:;»”'}", f"mark:{b.text[0] in '©®' or '©' in b.text[:20]}", f"commas:{min(3, b.text.count(','))}",
            f"first:{min(i, 2)}", f"last:{min(len(page) - 1 - i, 2)}",
        ])
    return out


class Field:
    """Weights of the chain: a pair for each feature, and transitions; label 1 is main."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights = weights
        self.moves = moves.tolist()

    def decode(self, page: list[list[str]]) -> list[int]:
        """Labels of a page's blocks by Viterbi; ties go to main."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves
        get = self.weights.get
        s0 = s1 = 0.0
        back = []
        for i, feats in enumerate(page):
            e0 = e1 = 0.0
            for f in feats:
                w = get(f)
                if w is not None:
                    e0 += w[0]
                    e1 += w[1]
            if i:
                a, b = s0 + m00, s1 + m10
                c, d = s0 + m01, s1 + m11
                back.append((b >= a, d >= c))
                s0, s1 = max(a, b), max(c, d)
            s0, s1 = s0 + e0, s1 + e1
        label = int(s1 >= s0)
        out = [label]
        for prev in reversed(back):
            label = int(prev[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], penalty: float = 0.02, steps: int = 150, rate: float = 0.15) -> Field:
    """Field of labelled pages: log-likelihood less a quadratic penalty, by adaptive gradient steps."""
    pages = [p for p in pages if p[0]]
    names = {f: i + 1 for i, f in enumerate(sorted({f for x, _ in pages for b in x for f in b}))}
    size, long, wide = len(pages), max(len(x) for x, _ in pages), max(len(b) for x, _ in pages for b in x)
    ids = np.zeros((size, long, wide), np.int64)
    here, gold = np.zeros((size, long), bool), np.zeros((size, long), np.int64)
    for p, (x, y) in enumerate(pages):
        here[p, :len(x)], gold[p, :len(x)] = True, y
        for i, b in enumerate(x):
            ids[p, i, :len(b)] = [names[f] for f in b]
    w, moves = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
    mw, vw, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)
    rows = np.arange(size)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    last = here.sum(1) - 1
    for step in range(1, steps + 1):
        emit = w[ids].sum(2)
        fore, aft = np.zeros((long, size, 2)), np.zeros((long, size, 2))
        fore[0] = emit[:, 0]
        for t in range(1, long):
            fore[t] = lse(fore[t - 1][:, :, None] + moves, 1) + emit[:, t]
        for t in range(long - 2, -1, -1):
            nxt = lse(moves + (emit[:, t + 1] + aft[t + 1])[:, None, :], 2)
            aft[t] = np.where((t < last)[:, None], nxt, 0.0)
        total = lse(fore[last, rows], 1)
        node = np.exp(fore + aft - total[:, None]).transpose(1, 0, 2) * here[:, :, None]
        want = np.eye(2)[gold] * here[:, :, None]
        diff = want - node
        gw = np.stack([np.bincount(ids.ravel(), np.repeat(diff[:, :, k].ravel(), wide), len(w)) for k in (0, 1)], 1) / size
        gm = np.zeros((2, 2))
        for t in range(1, long):
            on = here[:, t]
            pair = np.exp(fore[t - 1][:, :, None] + moves + (emit[:, t] + aft[t])[:, None, :] - total[:, None, None])
            gm += (want[on, t - 1][:, :, None] * want[on, t][:, None, :]).sum(0) - pair[on].sum(0)
        gw, gm = gw - penalty * w / 10, gm / size - penalty * moves / 10
        gw[0] = 0
        for x, g, m, v in ((w, gw, mw, vw), (moves, gm, mm, vm)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: tuple(w[i].tolist()) for f, i in names.items()}, moves)


# Words of class and id names in the composed pages, by the part they name (fixed values)
REST_NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead logo branding topbar site-header tagline",
    "footer": "footer site-footer copyright colophon legal credits bottom",
    "aside": "sidebar aside widget related recommended trending popular more-stories teaser rail",
    "ad": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner affiliate",
    "notice": "notice cookie cookies consent gdpr alert warning banner popup modal overlay paywall newsletter subscribe signup disclaimer",
    "form": "form search login register contact-form poll survey",
    "comments": "comments comment commentlist respond replies reply discussion disqus reviews feedback",
    "share": "share sharing social follow tags meta byline author-box toolbar",
}
MAIN_NAMES = "article content main post entry story body text post-content entry-content article-body story-body main-content prose page"


def labelled_pages(n: int = 360, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Composed pages with the label of each of their blocks (1: main)."""
    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choice(["an", "er", "th", "on", "le", "ei", "sch", "ou", "ra", "do", "é", "st", "in"]) for _ in range(rnd.randint(1, 4)))

    def sentence(lo=3, hi=20):
        w = [word() + ("," if rnd.random() < 0.08 else "") for _ in range(rnd.randint(lo, hi))]
        return " ".join(w).strip(",").capitalize() + "."

    def para(lo=1, hi=6):
        s = " ".join(sentence() for _ in range(rnd.randint(lo, hi)))
        if rnd.random() < 0.2:
            s = re.sub(r"(\S+) (\S+)$", rf"<{(t := rnd.choice(['b', 'em', 'i', 'span', 'strong']))}>\1</{t}> \2", s)
        if rnd.random() < 0.15:
            s = f'<a href="/{word()}">{word()}</a> ' + s
        return s

    def name(kind):
        return rnd.choice(REST_NAMES[kind].split())

    def attr(value):
        return rnd.choice([f' class="{value}"', f" id={value}", f' class="{value} {word()}"', f" class='x-{value}'"])

    def links(k):
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(rnd.randint(1, 3)))}</a>' for _ in range(k)]
        return [f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", " ".join(f"<div>{i}</div>" for i in items)][rnd.random() < 0.3], k

    def prose_of(k, sep=None):
        tag = sep or rnd.choice(["p", "p", "div", "li"])
        body = "".join(f"<{tag}>{para(1, 4) if rnd.random() < 0.7 else sentence(1, 6)}</{tag}>" for _ in range(k))
        return (f"<ul>{body}</ul>" if tag == "li" else body), k

    def rest(kind):
        k = rnd.randint(1, 4)
        if kind == "nav":
            inner, k = links(rnd.randint(2, 8))
            return rnd.choice([f"<nav>{inner}</nav>", f"<nav{attr(name(kind))}>{inner}</nav>", f"<div{attr(name(kind))}>{inner}</div>"]), k
        if kind == "header":
            inner, k = rnd.choice([(f"<h1>{sentence(1, 4)}</h1>", 1), (f"<p>{sentence(1, 8)}</p>", 1), links(3)])
            return rnd.choice([f"<header>{inner}</header>", f"<div{attr(name(kind))}>{inner}</div>"]), k
        if kind == "footer":
            inner, k = rnd.choice([(f"&copy; {word()}.example.com &middot; {sentence()}", 1), prose_of(1, "p"), links(3)])
            return rnd.choice([f"<footer>{inner}</footer>", f"<footer{attr(name(kind))}>{inner}</footer>", f"<div{attr(name(kind))}>{inner}</div>"]), k
        if kind == "form":
            return (f"<form{rnd.choice(['', attr(name(kind))])}><p>{sentence(1, 8)}</p><select><option>{word()}<option>{word()}</select>"
                    f"<button>{word()}</button></form>"), 4
        if kind == "aside" and rnd.random() < 0.6:
            inner, k = rnd.choice([links(3), prose_of(k)])
            return f"<aside{rnd.choice(['', attr(name(kind))])}><h3>{sentence(1, 4)}</h3>{inner}</aside>", k + 1
        if kind == "comments" and rnd.random() < 0.5:
            inner, k = prose_of(rnd.randint(1, 5))
            tag = rnd.choice(["section", "div", "ol"])
            inner = inner.replace("<ul>", "").replace("</ul>", "")
            return f"<{tag}{attr(name(kind))}><h3>{sentence(1, 4)}</h3>{inner}</{tag}>", k + 1
        inner, k = rnd.choice([prose_of(k), (sentence(2, 30), 1), links(2)])
        hidden = rnd.choice([" hidden", ' style="display:none"']) if rnd.random() < 0.1 else ""
        return f"<{(t := rnd.choice(['div', 'div', 'section']))}{attr(name(kind))}{hidden}>{inner}</{t}>", k

    def main():
        body, labels = "", []
        if rnd.random() < 0.8:
            h = rnd.choice(["h1", "h1", "h2"])
            body, labels = f"<{h}>{sentence(2, 10)[:60]}</{h}>", [1]
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.08:
                body, labels = body + f"<h2>{sentence(1, 6)}</h2>", labels + [1]
            elif kind < 0.14:
                inner, k = prose_of(rnd.randint(2, 4), "li")
                body, labels = body + inner, labels + [1] * k
            elif kind < 0.18:
                body, labels = body + f"<blockquote>{para()}</blockquote>", labels + [1]
            elif kind < 0.21:
                body, labels = body + f"<pre>{word()} = {word()}</pre>", labels + [1]
            elif kind < 0.26:
                inner, k = rest(rnd.choice(["ad", "share", "aside", "notice"]))
                body, labels = body + inner, labels + [0] * k
            elif kind < 0.4:
                body, labels = body + f"<p><b>{sentence(2, 12)}<br>", labels + [1]
            elif kind < 0.5:
                body, labels = body + f"<p>{sentence(1, 3)}</p>", labels + [1]
            else:
                body, labels = body + f"<p>{para()}</p>", labels + [1]
        tag = rnd.choice(["article", "article", "main", "div", "section"])
        own = attr(rnd.choice(MAIN_NAMES.split())) if tag in ("div", "section") or rnd.random() < 0.3 else ""
        return f"<{tag}{own}>{body}</{tag}>", labels

    out = []
    for _ in range(n):
        body, labels = main()
        parts = [(body, labels)]
        for kind in rnd.sample([*REST_NAMES], rnd.randint(1, 6)) + (["nav", "ad", "footer"] if rnd.random() < 0.5 else []):
            inner, k = rest(kind)
            before = {"nav": 0.9, "header": 1.0, "ad": 0.6, "notice": 0.6, "footer": 0.0, "comments": 0.0}.get(kind, 0.4)
            parts = [(inner, [0] * k), *parts] if rnd.random() < before else [*parts, (inner, [0] * k)]
        page = "".join(p for p, _ in parts)
        if rnd.random() < 0.5:
            page = f"<div{attr(rnd.choice(['page', 'wrapper', 'container']))}>{page}</div>"
        out.append((f"<html><head><title>{word()}</title></head><body>{page}</body></html>", [x for _, y in parts for x in y]))
    return out


_default: list[Field] = []


def default_field() -> Field:
    """The field of :func:`labelled_pages`; trained once per process."""
    if not _default:
        pages = []
        for page, labels in labelled_pages():
            found = blocks(page)
            if len(found) == len(labels):
                pages.append((features(found), labels))
        _default.append(train(pages))
    return _default[0]


def main_text(page: str | None, field: Field) -> str:
    """Main blocks of a page, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``.

    Null, empty and text-less pages give an empty text. Unclosed, misplaced and
    broken markup is read as browsers do in the main; no page fails. Null ids and
    urls and repeated rows stay; extra columns are ignored.
    """
    tune(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches):
        for b in batches:
            texts = [main_text(p, sent.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html")).mapInArrow(
        run, "page_id long, url string, text string")


def op9_extract(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page and its length."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# The pages' own layout, stated plainly: headings and paragraphs of the one article
ORACLE = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as h from pages),
b as (select page_id, url, unnest(string_split(regexp_replace(regexp_replace(h, '[ \t\r\n\f\v]+', ' ', 'g'), '</?(h1|p)>', chr(10), 'g'), chr(10))) as t,
        generate_subscripts(string_split(regexp_replace(regexp_replace(h, '[ \t\r\n\f\v]+', ' ', 'g'), '</?(h1|p)>', chr(10), 'g'), chr(10)), 1) as i from a),
c as (select page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), ' +', ' ', 'g')) as t from b),
d as (select page_id, url, i, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as t from c),
e as (select page_id, url, coalesce(string_agg(t, chr(10) order by i) filter (where t <> ''), '') as text from d group by page_id, url)
select page_id, url, text, length(text) as n_chars from e
"""
