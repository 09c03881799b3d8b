"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between tags that start or end a block.
Each block has features of its ancestors (tags, and words of their class, id, role and
itemprop) and of its text (length, links, closing mark, phrases). A two-label chain is
trained by gradient ascent on labelled pages, and a page's labels are decoded by Viterbi.

The labelled pages are made by `labelled_pages` from layouts written down here: articles
in several containers, with menus, headers, footers, sidebars, notices, adverts, forms
and reader comments around and inside them, partly with tags left open. Their number is
the only size of the fit.

A null html is empty, and a page without content has an empty text. Broken markup is read
as it comes: unknown ends are ignored, open elements end with their parent. Rows are
handled one by one, so order, ties and repeats don't matter; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, mapped, rows_out, travels

travels(__name__)

OPENED = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
UPTO_VALUE = re.compile(r"[^>=]*+(?:(>)|=\s*+)")         # to the end of the tag, or to a value
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead
    tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main body form aside nav td th blockquote".split())

# Elements left out with all they hold. Left open, they end with their parent block, and an svg before an element that can't stand in one.
SKIPPED = frozenset("svg object select noscript template".split())
NO_SVG = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small
    span strong strike sub sup table tt u ul var""".split())

# Words in names of elements, by what they tell.
NAMED = {
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner teaser".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager topbar toolbar skip links".split(),
    "head": "header masthead top brand logo site".split(),
    "foot": "footer foot bottom copyright legal contentinfo colophon credits".split(),
    "side": "sidebar side aside widget widgets related recommended popular trending complementary rail more".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers responses feedback".split(),
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay dialog warning privacy info message paywall".split(),
    "form": "form newsletter subscribe subscription signup login search share sharing social register contact poll".split(),
    "body": "content article articlebody post entry story main body text page prose copy blog read".split(),
}
KIND = {w: k for k, words in NAMED.items() for w in words}
PHRASES = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign up\b|\bnewsletter\b|\blog ?in\b|\badvertisement\b|\bsponsored\b"
                     r"|\bread more\b|\brelated\b|\bshare (?:this|on)\b|privacy policy|terms of", re.I)


KEPT_PATHS = 20_000


@dataclass
class Block:
    """A run of text and what stands around it."""

    text: str
    path: tuple
    linked: int


def tag_end(page: str, at: int, last: dict[str, int]) -> int | None:
    """Place of the `>` that ends a tag whose attributes begin at `at`; quotes count only at the start of a value."""
    while found := UPTO_VALUE.match(page, at):
        if found[1]:
            return found.end() - 1
        at = found.end()
        quote = page[at:at + 1]
        if quote in ('"', "'") and at < last[quote]:
            at = page.index(quote, at + 1) + 1
    return None


def tokens(page: str) -> Iterator[tuple[str, str | None, str, str | None, str]]:
    """(text, name of an element read as raw text, "/" of a closing tag, tag, attributes) of a page in order; comments are left out.

    Every character is looked at a bounded number of times. A `<` with no `>` after it is text. If a tag's quotes
    swallow the rest of the page, it ends at the next `>`, and so do the tags after it.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    at, n, quoted = 0, len(page), True
    while at < n:
        start = page.find("<", at)
        if start != at:
            yield page[at:start if start >= 0 else n], None, "", None, ""
            if start < 0:
                return
        found = OPENED.match(page, start) if start < last[">"] else None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        elif not found:
            yield "<", None, "", None, ""
            at = start + 1
        elif found[2] is None:
            at = page.index(">", start) + 1
        else:
            end = tag_end(page, found.end(), last) if quoted else None
            if end is None:
                quoted, end = False, page.index(">", found.end())
            at = end + 1
            name = found[2].lower()
            if name in RAW_END and not found[1]:
                close = RAW_END[name].search(page, at)
                at = close.end() if close else n
                yield "", name, "", None, ""
            else:
                yield "", None, found[1], found[2], page[found.end():end]


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; path holds (tag, kinds named) of the open elements."""
    stack: list[tuple[str, frozenset]] = []
    out: list[Block] = []
    held: list[str] = []
    linked, path, open_links = 0, (), 0
    skipped, inner = "", []      # the element left out, and the elements opened in it

    def close():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path, linked))
            held.clear()
        linked = 0

    for raw, special, closing, tag, attributes in tokens(page):
        if skipped:
            tag = (tag or "").lower()
            if closing and tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag):]
                continue
            if closing and tag == skipped:
                skipped = ""
                continue
            if not (closing and tag in BLOCKS and any(t == tag for t, _ in stack)
                    or not closing and skipped == "svg" and tag in NO_SVG and "foreignobject" not in inner):
                if not closing and (tag in BLOCKS and tag not in VOID or tag == "foreignobject" or tag == skipped in ("svg", "object", "template")) and not attributes.endswith("/"):
                    inner.append(tag)
                continue
            skipped = ""
        if tag is None:
            if special is not None:
                if special in ("textarea", "iframe"):
                    held.append(" ") if held else None
            else:
                if not held:
                    if raw.isspace():
                        continue
                    path = tuple(stack)
                held.append(raw)
                if open_links:
                    linked += len(raw.strip())
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                open_links = max(0, open_links - 1)
            elif tag in BLOCKS:
                close()
                open_links = 0
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == tag:
                        del stack[at:]
                        break
        elif tag in BLOCKS:
            close()
            open_links = 0
            if tag in VOID:
                continue
            ends = CLOSES.get(tag, ())
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == "p" or stack[at][0] in ends:
                    del stack[at:]
                elif stack[at][0] in SCOPES:
                    break
            kinds = set()
            for a in ATTRIBUTE.finditer(attributes):
                for w in NAME.findall(a[2] or a[3] or a[4] or ""):
                    if (k := KIND.get(w.lower())) is not None:
                        kinds.add(k)
            if not attributes.endswith("/"):
                stack.append((tag, frozenset(kinds)))
        elif tag in SKIPPED:
            if held and tag in ("select", "object", "svg"):
                held.append(" ")
            if not attributes.endswith("/"):
                skipped, inner = tag, []
        elif tag == "br" or tag in ("img", "input"):
            if held:
                held.append(" ")
        elif tag == "a":
            open_links += 1
    close()
    return out


TOLD = frozenset("article main nav header footer aside form ul ol table figure figcaption button label dialog section blockquote pre dl fieldset address menu".split())


def path_features(path: tuple) -> list[str]:
    """Names of the features of a block's ancestors."""
    tags = [t for t, _ in path]
    f = ["own " + (tags[-1] if tags else "none")]
    f += {"in " + t for t in tags if t in TOLD}
    f += ["named " + k for k in set().union(*(k for t, k in path if t not in ("html", "body")), ())]
    f += ["near " + k for k in next((k for _, k in reversed(path) if k), ())]
    if "article" in tags:
        last = len(tags) - 1 - tags[::-1].index("article")
        inner = set(tags[last + 1:])
        f += ["article then " + t for t in inner if t in TOLD]
        f += ["article then named " + k for k in set().union(*(k for _, k in path[last + 1:]), ())]
        f.append("article direct" if not inner - {"p", "div", "section", "h1", "h2", "h3", "h4"} else "article deep")
    return f


def text_features(b: Block, at: int, of: int) -> list[str]:
    """Names of the features of a block's text and place."""
    words = b.text.count(" ") + 1
    share = b.linked / max(len(b.text), 1)
    f = ["bias", "words 1" if words == 1 else "words 2-4" if words < 5 else "words 5-10" if words < 11 else "words 11-25" if words < 26 else "words 26-",
         "links none" if share == 0 else "links few" if share < 0.4 else "links many", "closed" if b.text[-1] in ".!?\u2026\"\u00bb\u201d" else "open"]
    if PHRASES.search(b.text):
        f.append("phrase")
    if at == 0:
        f.append("first")
    if at == of - 1:
        f.append("last")
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    return [path_features(b.path) + text_features(b, at, len(blocks)) for at, b in enumerate(blocks)]


@dataclass
class Chain:
    """Weights of a two-label chain: features by labels, and label by following label."""

    names: dict[str, int]
    weights: np.ndarray
    follow: np.ndarray
    paths: dict = field(default_factory=dict)      # sums of weights by path, as pages repeat theirs

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        pair = {x: tuple(self.weights[i].tolist()) for x, i in self.names.items()} if not self.paths else self.paths[None]
        if not self.paths or len(self.paths) > KEPT_PATHS:
            self.paths.clear()
            self.paths[None] = pair
        out = []
        for at, b in enumerate(blocks):
            own = self.paths.get(b.path)
            if own is None:
                known = [pair[x] for x in path_features(b.path) if x in pair]
                own = self.paths[b.path] = (sum(x for x, _ in known), sum(y for _, y in known))
            s0, s1 = own
            for x in text_features(b, at, len(blocks)):
                if x in pair:
                    s0, s1 = s0 + pair[x][0], s1 + pair[x][1]
            out.append((s0, s1))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        if not blocks:
            return []
        (a, b), (c, d) = self.follow.tolist()
        (s0, s1), *rest = self.scores(blocks)
        back = []
        for e0, e1 in rest:
            from0, from1 = s0 + a < s1 + c, s0 + b < s1 + d
            s0, s1 = (s1 + c if from0 else s0 + a) + e0, (s1 + d if from1 else s0 + b) + e1
            back.append((from0, from1))
        label = s1 > s0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 250, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
    """Maximum conditional likelihood with a ridge, by Adam on all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(x, len(names)) for x in f] for f in features(b)] for b, _ in pages]
    n, most = len(pages), max(map(len, rows))
    x = np.zeros((n, most, len(names)), np.float32)
    y, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (own, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        mask[i, :len(own)] = True
        y[i, :len(own)] = labels
        for t, f in enumerate(own):
            x[i, t, f] = 1
    flat = x.reshape(n * most, -1)
    truth = np.eye(2)[y] * mask[..., None]
    pairs = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    seen = (np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :] * pairs).sum((0, 1))
    theta, m, v = np.zeros(len(names) * 2 + 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        w, follow = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = (flat @ w.astype(np.float32)).reshape(n, most, 2).astype(np.float64) * mask[..., None]
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, most):
            new = np.logaddexp(alpha[:, t - 1, :1] + follow[:1], alpha[:, t - 1, 1:] + follow[1:]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(most - 2, -1, -1):
            nxt = e[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(follow[:, 0] + nxt[:, :1], follow[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        gamma = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        xi = np.exp(alpha[:, :-1, :, None] + follow + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * pairs
        grad = np.concatenate([(flat.T @ (truth - gamma).reshape(n * most, 2).astype(np.float32)).ravel(), (seen - xi.sum((0, 1))).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain(names, theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy())


# ---------------------------------------------------------------- labelled pages

MARK = "\ue000"      # stands before content in a labelled page


def labelled_pages(n: int = 320, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Made pages with their labels: blocks of content carry MARK in the source, which is taken off again."""
    r = random.Random(seed)
    parts = "ka lo mi ren sta tor vel on ar ti pa su del cor ma né wü sch ción".split()

    def word():
        return "".join(r.choices(parts, k=r.randint(1, 3)))

    def words(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence():
        return words(1, 14).capitalize() + r.choice([".", ".", ".", "?", "!"])

    def prose():
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))

    def link(text=None):
        return f'<a href="/{word()}">{text or words(1, 3)}</a>'

    def named(*kinds):
        return r.choice([w for k in kinds for w in NAMED[k]])

    def attribute(*kinds):
        extra = f" {word()}" if r.random() < 0.3 else ""
        return r.choice([f' class="{named(*kinds)}{extra}"', f' id="{named(*kinds)}"', f' class="{named(*kinds)}-{word()}"'])

    def menu():
        items = "".join(f"<li>{link()}{r.choice(['</li>', '</li>', ''])}" for _ in range(r.randint(2, 8)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f"<div{attribute('menu')}><ul>{items}</ul></div>", f"<nav{attribute('menu')}>{' '.join(link() for _ in range(4))}</nav>",
                         f"<ul{attribute('menu')}>{items}</ul>", f'<div role="navigation">{link()} | {link()}</div>'])

    def header():
        return r.choice([f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f"<div{attribute('head')}>{link()} {words(1, 4)}</div>", f"<header{attribute('head')}>{link()}</header>",
                         f'<div role="banner">{words(1, 4)}</div>'])

    def footer():
        text = r.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"Copyright {words(1, 3)}", sentence(), f"{link()} {link()}"])
        return r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul><li>{link()}</li></ul></footer>", f"<div{attribute('foot')}>{text}</div>"])

    def advert():
        return r.choice([f"<div{attribute('ad')}>{r.choice([prose(), words(2, 8)])}</div>", f"<aside{attribute('ad')}><p>{prose()}</p></aside>", f"<div{attribute('ad')}>{link(words(2, 6))}</div>",
                         f"<section{attribute('ad')}><h3>{words(1, 3)}</h3><p>{prose()}</p></section>"])

    def side():
        return r.choice([f"<aside><h3>{words(1, 3)}</h3><ul><li>{link()}</li><li>{link(words(3, 8))}</li></ul></aside>", f"<div{attribute('side')}><p>{prose()}</p>{link()}</div>",
                         f"<aside{attribute('side')}><p>{prose()}</p><p>{prose()}</p></aside>", f"<section{attribute('side')}><h2>{words(1, 3)}</h2><p>{link(words(3, 8))}</p></section>"])

    def notice():
        text = r.choice(["We use cookies. ", "", ""]) + prose()
        return r.choice([f"<div{attribute('notice')}>{text} <button>{words(1, 2)}</button></div>", f"<div{attribute('notice')}><p>{text}</p></div>", f'<div role="alert">{text}</div>',
                         f'<dialog open><p>{text}</p></dialog>', f"<section{attribute('notice')}>{text}</section>"])

    def form():
        return r.choice([f"<form><label>{words(1, 4)}</label><input type=text><button>{words(1, 2)}</button></form>", f"<form{attribute('form')}><p>{prose()}</p><button>{word()}</button></form>",
                         f"<div{attribute('form')}><p>{prose()}</p><input></div>", f"<form><p>{prose()}<select><option>{word()}<option>{word()}</select></form>"])

    def comments():
        own = "comment"
        one = [f"<p>{prose()}</p>" for _ in range(r.randint(1, 5))]
        return r.choice([f"<div{attribute('comment')}><h2>{words(1, 3)}</h2>{''.join(f'<div{attribute(own)}>{c}</div>' for c in one)}</div>",
                         f"<section{attribute('comment')}>{''.join(f'<article>{c}</article>' for c in one)}</section>",
                         f"<ol{attribute('comment')}>{''.join(f'<li><b>{word()}</b>{c}</li>' for c in one)}</ol>", f"<div{attribute('comment')}>{''.join(one)}</div>"])

    def share():
        return r.choice([f"<div{attribute('form')}>{link()} {link()}</div>", f"<p{attribute('form')}>{words(1, 4)}</p>", f"<ul{attribute('form')}><li>{link()}</li><li>{link()}</li></ul>"])

    def content(close):
        end = "</p>" if close else ""
        kind = r.random()
        if kind < 0.62:
            text = prose()
            if r.random() < 0.15:
                text += " " + link() + " " + words(1, 8) + "."
            return f"<p>{r.choice(['', '', '<b>', '<em>'])}{MARK}{text}{r.choice(['', '', '<br>'])}{end}"
        if kind < 0.74:
            return f"<h{r.randint(2, 4)}>{MARK}{words(1, 6)}</h{r.randint(2, 4)}>" if not close else (lambda h: f"<{h}>{MARK}{words(1, 6)}</{h}>")(r.choice(["h2", "h3", "h4"]))
        if kind < 0.82:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{MARK}{r.choice([words(1, 6), prose()])}{'</li>' if close else ''}" for _ in range(r.randint(2, 4))) + f"</{tag}>"
        if kind < 0.87:
            return f"<blockquote>{r.choice(['<p>', ''])}{MARK}{prose()}</blockquote>"
        if kind < 0.91:
            return f"<pre>{MARK}{words(3, 12)}</pre>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{MARK}{words(1, 3)}</td><td>{MARK}{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{MARK}{words(2, 9)}</figcaption></figure>"
        return f"<div>{MARK}{prose()}</div>"

    def page():
        close = r.random() < 0.8
        body = [f"<h1>{MARK}{words(2, 9)}</h1>"] if r.random() < 0.85 else []
        body += [content(close) for _ in range(r.choice([1, 2, 4, 7, 12]))]
        for extra, chance in ((advert, 0.3), (side, 0.12), (share, 0.2), (form, 0.15), (notice, 0.12), (menu, 0.1)):
            if r.random() < chance:
                body.insert(r.randint(1, len(body)), extra())
        tail = comments() if r.random() < 0.45 else ""
        inside = r.random() < 0.4
        text = "".join(body) + (tail if inside else "")
        shape = r.random()
        if shape < 0.45:
            main = f"<article>{text}</article>"
        elif shape < 0.6:
            main = f"<main><article{attribute('body')}>{text}</article></main>"
        elif shape < 0.72:
            main = f"<main>{text}</main>"
        elif shape < 0.9:
            main = f"<div{attribute('body')}>{text}</div>"
        elif shape < 0.95:
            main = f'<div><div itemprop="articleBody">{text}</div></div>'
        else:
            main = f"<div>{text}</div>"
        before = [x() for x in (notice, header, menu, advert, form) if r.random() < 0.5]
        after = ([] if inside else [tail]) + [x() for x in (side, advert, comments, form, menu) if r.random() < 0.3] + ([footer()] if r.random() < 0.9 else [])
        return f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"

    out = []
    for _ in range(n):
        blocks = leaf_blocks(page())
        labels = [MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "."
        out.append((blocks, labels))
    return out


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (content blocks joined by a blank line) and n_chars of every row."""
    chain = chain or train(labelled_pages())
    fields = "page_id long, url string, text string, n_chars long"
    schema = arrow(fields)

    def task(batches):
        for batch in batches:
            out = []
            for page in batch.column(2).to_pylist():
                blocks = leaf_blocks(page)
                out.append("\n\n".join([b.text for b, keep in zip(blocks, chain.decode(blocks), strict=True) if keep]))
            yield rows_out(schema, [batch.column(0), batch.column(1), out, [len(t) for t in out]])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return mapped(rows, task, fields)
