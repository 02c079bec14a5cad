"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into tags and text. Elements that browsers close by themselves are closed likewise; a leaf block is the
text between two boundaries of block elements, its character references decoded, its white space made single spaces.
Head, scripts, styles, comments and what else isn't shown or is a form's control makes no block. Each block has features of all its ancestors (tags that mean
something, known words of class, id and role; how many plain wrappers there are between doesn't matter), of its own element and of its text (length, links, signs,
place in the page), hashed to a fixed number. The field scores blocks and successive pairs of labels; Viterbi decoding labels a page's blocks together,
and the text is the blocks labelled as content in page order, joined by line feeds.

The field is fitted here by gradient steps on the likelihood, over labelled pages that labelled_pages() lays out by a grammar of page
parts; their words are drawn from no table. The weights have a fixed size and go to the tasks in a broadcast; pages are
scored where they lie, without a shuffle, one at a time.

A null or empty page, and one without any content block, gives an empty text. Very long pages need time and memory in
proportion, however deep or broken they are. Unclosed tags, stray ends, quotes in attributes and broken references are
taken as browsers take them, nearly: a head ends at the first text or tag that can't stand in one, a tag or comment that never ends takes
the rest of the page, and a "<" inside a tag's name or between its attributes makes the "<" before it text. Rows that repeat stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspark.llm.common import table, text_or_empty

#: Names of elements by how they are laid out.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("annotation annotation-xml audio button canvas datalist head iframe noscript object option script select style template textarea title video defs desc metadata symbol".split())
RAW = frozenset("script style textarea title noscript iframe".split())
SELF_CLOSED = frozenset("circle ellipse g line path polygon polyline rect stop svg use".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "thead": {"tr"}, "tfoot": {"tbody", "tr", "td"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
#: A tag's name; an attribute (of a value in quotes the opening quote alone).
NAME = re.compile(r"[a-zA-Z][^\s/><]*")
ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=<]+|=)(?:\s*=\s*(?:(["'])|([^\s>"'][^\s>]*))?)?""")
SPACE = re.compile(r"[\s/]*")
WORDS = re.compile(r"[a-z]+")
HUMP = re.compile(r"([a-z])([A-Z])")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

FEATURES = 1 << 14
#: Elements that only hold others together, and elements that features know, with what is close to the text in them.
WRAPPERS = frozenset("body center div section".split())
TAGS = (BLOCKS - WRAPPERS) | frozenset("a b em i label small strong".split())
#: Words of class, id and role that features know.
NAMES = frozenset("""ad ads advert advertisement alert article aside author banner bar body bottom box breadcrumb breadcrumbs byline card categories comment comments complementary
consent container content contentinfo cookie copyright crumbs date discussion disclaimer dialog entry featured footer form gdpr grid group head header hentry hero inner layout lead left legal links list login main
masthead menu meta modal nav navbar navigation news newsletter notice outer overlay page paid pagination panel policy popular popup post posts privacy promo rail read reader recommended
related replies responses right row search section share sharing side sidebar signup site social sponsor sponsored stories story subscribe tabs tags teaser text toc toolbar topnav trending
widget wrap wrapper""".split())
#: Labelled pages to fit on, passes over them, step.
FIT_PAGES, PASSES, STEP = 600, 5, 0.1


class Block(NamedTuple):
    text: str
    own: tuple[str, str]  # the innermost element that is no wrapper, and the next one
    tags: frozenset[str]  # of TAGS, all that are open
    inside: frozenset[str] | None  # those of them that are open inside the outermost article or main; None: there is none
    names: frozenset[str]  # of NAMES, in class, id and role of all open elements
    linked: int  # characters inside links


class Tag(NamedTuple):
    name: str  # empty: a comment or the like
    closing: bool
    attributes: list[tuple[str, str]]
    end: int  # where the text goes on


def tag_at(page: str, at: int) -> Tag | None:
    """The tag or comment that begins at page[at], a "<"; None if that is text."""
    follows = page[at + 1 : at + 2]
    if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
        if page.startswith("<!--", at):
            ends = [k + n for mark, n in (("-->", 3), ("--!>", 4)) if (k := page.find(mark, at + 2)) >= 0]
        else:
            ends = [k + 1] if (k := page.find(">", at + 2)) >= 0 else []
        return Tag("", False, [], min(ends, default=len(page)))
    closing = follows == "/"
    found = NAME.match(page, at + 1 + closing)
    if not found or not found[0].isascii():
        return None
    attributes, at = [], found.end()
    while True:
        at = SPACE.match(page, at).end()
        if at >= len(page):
            return Tag("", False, [], len(page))
        if page[at] == ">":
            return Tag(found[0].lower(), closing, attributes, at + 1)
        own = ATTRIBUTE.match(page, at)
        if not own:
            return None
        at, value = own.end(), own[3] or ""
        if own[2]:
            end = page.find(own[2], at)
            if end < 0:
                return Tag("", False, [], len(page))
            value, at = page[at:end], end + 1
        attributes.append((own[1].lower(), value))


def names_of(attributes: list[tuple[str, str]]) -> tuple[str, ...]:
    return tuple(w for name, value in attributes if name in ("class", "id", "role") for w in WORDS.findall(HUMP.sub(r"\1 \2", value).lower()) if w in NAMES)


class Open:
    """The open elements. An element that is closed while others in it stay open is marked as gone until those go too."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]] | None] = []
        self.at: dict[str, list[int]] = {}  # places of each name
        self.blocks: list[int] = []  # places of block elements
        self.kinds: list[int] = []  # those of them that are no wrappers
        self.names: dict[str, int] = {}  # how often each is open
        self.hidden = 0

    def top(self) -> str:
        return self.stack[-1][0] if self.stack and self.stack[-1] else ""

    def push(self, name: str, names: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
            if name not in WRAPPERS:
                self.kinds.append(len(self.stack))
        self.hidden += name in UNSEEN
        for w in names:
            self.names[w] = self.names.get(w, 0) + 1
        self.stack.append((name, names))

    def _gone(self, gone: tuple[str, tuple[str, ...]]) -> None:
        self.at[gone[0]].pop()
        self.hidden -= gone[0] in UNSEEN
        for w in gone[1]:
            self.names[w] -= 1

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            if gone := self.stack.pop():
                self._gone(gone)
        for own in (self.blocks, self.kinds):
            while own and own[-1] >= place:
                own.pop()

    def remove(self, place: int) -> None:
        """The innermost of its name, no block."""
        self._gone(self.stack[place])
        self.stack[place] = None
        while self.stack and self.stack[-1] is None:
            self.stack.pop()

    def last(self, *names: str) -> int:
        return max((own[-1] for n in names if (own := self.at.get(n))), default=-1)

    def around(self) -> tuple[tuple[str, str], frozenset[str], frozenset[str] | None, frozenset[str]]:
        """own, tags, inside and names of a block."""
        own = [self.stack[k][0] for k in self.kinds[:-3:-1]] + ["-", "-"]
        tags = {t: at[-1] for t in TAGS if (at := self.at.get(t))}
        since = min((at[0] for t in ("article", "main") if (at := self.at.get(t))), default=-1)
        inside = frozenset(t for t, k in tags.items() if k > since) if since >= 0 else None
        return (own[0], own[1]), frozenset(tags), inside, frozenset(w for w, n in self.names.items() if n)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    open_ = Open()
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, *open_.around(), linked))
            parts.clear()
        linked = 0

    def pop_to(place: int) -> None:
        if open_.blocks and open_.blocks[-1] >= place:
            end_block()
        open_.pop_to(place)

    def words(raw: str) -> None:
        nonlocal linked
        if open_.top() == "head" and raw.strip():
            pop_to(len(open_.stack) - 1)
        if raw and not open_.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_.at.get("a"):
                linked += len(text.strip())

    at = begin = 0
    while (at := page.find("<", at)) >= 0:
        found = tag_at(page, at)
        if found is None:
            at += 1
            continue
        words(page[begin:at])
        at = begin = found.end
        tag = found.name
        if not tag:
            continue
        if found.closing:
            place = open_.last(tag)
            if tag in BLOCKS or tag in UNSEEN:
                if place >= 0:
                    pop_to(place)
                elif tag == "p":
                    end_block()
            elif place > (open_.blocks[-1] if open_.blocks else -1):
                open_.remove(place)
            continue
        if tag not in HEAD and open_.top() == "head":
            pop_to(len(open_.stack) - 1)
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            if (place := open_.last("p")) >= 0 and place == open_.blocks[-1]:
                pop_to(place)
            if tag in CLOSED_BY:
                scope = open_.last(*SCOPES[tag])
                inside = [own[k] for n in CLOSED_BY[tag] if (own := open_.at.get(n)) and (k := bisect_right(own, scope)) < len(own)]
                if inside:
                    pop_to(min(inside))
            end_block()
        if tag in VOID:
            if tag == "img":
                parts.append(" ")
            continue
        if page[found.end - 2] == "/" and tag in SELF_CLOSED:
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            at = begin = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        open_.push(tag, names_of(found.attributes))
    words(page[begin:])
    end_block()
    return out


@lru_cache(1 << 16)
def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def features(page: list[Block]) -> list[list[int]]:
    out = []
    for k, b in enumerate(page):
        n, (own, above) = len(b.text), b.own
        long = f"long {min(9, n.bit_length())}"
        found = [f"in {t}" for t in b.tags if t != own]
        found += [f"named {w}" for w in b.names]
        found += [f"own {own}", f"own {above}/{own}", long, f"own {own} {long}"]
        links = f"links {round(4 * min(1.0, b.linked / n))}"
        found += [links, f"own {own} {links}"]
        found.append(f"ends {b.text[-1] if not b.text[-1].isalnum() else 'a'}")
        found.append(f"signs {'c' if '©' in b.text or '(c)' in b.text.lower() else ''}{'|' if ' | ' in b.text or '·' in b.text else ''}")
        found.append(f"third {3 * k // len(page)}")
        if b.inside is not None:
            found += ["inside", *(f"inside {t}" for t in b.inside), *(f"inside named {w}" for w in b.names)]
        if k == 0 or k == len(page) - 1:
            found.append(f"edge {k == 0}")
        found.append("always")
        out.append([slot(x) for x in found])
    return out


class Field:
    """Weights: of each feature for content over not content; of pairs of successive labels."""

    def __init__(self) -> None:
        self.weights = np.zeros(FEATURES)
        self.pairs = np.zeros((2, 2))

    def unary(self, feats: list[list[int]]) -> list[float]:
        ends = np.cumsum([len(f) for f in feats])
        upto = np.r_[0.0, np.cumsum(self.weights[np.concatenate(feats)])] if feats else np.zeros(1)
        return np.diff(upto[np.r_[0, ends].astype(np.int64)]).tolist()

    def decode(self, feats: list[list[int]]) -> list[int]:
        """Viterbi."""
        (p00, p01), (p10, p11) = self.pairs.tolist()
        zero, one, back = 0.0, 0.0, []
        for k, u in enumerate(self.unary(feats)):
            if k:
                a, b, c, d = zero + p00, one + p10, zero + p01, one + p11
                back.append((int(b > a), int(d > c)))
                zero, one = max(a, b), max(c, d)
            one += u
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if feats else []

    def marginals(self, feats: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 for each block; expected number of each pair of labels. Messages are scaled to sum to one."""
        n, pair = len(feats), np.exp(self.pairs)
        (p00, p01), (p10, p11) = pair.tolist()
        odds = np.exp(np.clip(self.unary(feats), -200, 200)).tolist()
        one = odds[0] / (1 + odds[0])
        fore, aft = [(1 - one, one)], [(0.5, 0.5)]
        for u in odds[1:]:
            zero, one = fore[-1]
            a, b = zero * p00 + one * p10, (zero * p01 + one * p11) * u
            fore.append((a / (a + b), b / (a + b)))
        for u in odds[:0:-1]:
            zero, one = aft[-1]
            one *= u
            a, b = p00 * zero + p01 * one, p10 * zero + p11 * one
            aft.append((a / (a + b), b / (a + b)))
        f, g = np.array(fore), np.array(aft[::-1])
        share = f * g
        both = np.zeros((2, 2))
        if n > 1:
            met = f[:-1, :, None] * pair * (g[1:] * np.c_[np.ones(n - 1), odds[1:]])[:, None, :]
            both = (met / met.sum((1, 2), keepdims=True)).sum(0)
        return share[:, 1] / share.sum(1), both


def fit(pages: list[tuple[list[list[int]], list[int]]], passes: int = PASSES) -> Field:
    """Stochastic gradient ascent on the conditional likelihood with steps scaled by past gradients."""
    field, rng = Field(), np.random.default_rng(5)
    past, past_pairs = np.full(FEATURES, 1e-2), np.full((2, 2), 1e-2)
    for _ in range(passes):
        for k in rng.permutation(len(pages)).tolist():
            feats, labels = pages[k]
            if not feats:
                continue
            share, both = field.marginals(feats)
            touched, place = np.unique(np.concatenate(feats), return_inverse=True)
            grad = np.bincount(place, np.repeat(np.array(labels) - share, [len(f) for f in feats]))
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            step = grad - 1e-3 * field.weights[touched]
            past[touched] += step**2
            field.weights[touched] += STEP * step / np.sqrt(past[touched])
            past_pairs += (seen - both) ** 2
            field.pairs += STEP * (seen - both) / np.sqrt(past_pairs)
    return field


# --- labelled pages ---------------------------------------------------------------------------------------------------


#: How the grammar sets off the article.
KINDS = ("article", "main and article", "main", "div", "named article", "section", "main and section", "plain")


def labelled_pages(n: int = FIT_PAGES, seed: int = 3, only: tuple[str, ...] = KINDS) -> Iterator[str]:
    """Pages in which each piece of content stands between the control characters 0x02 and 0x03. only: the kinds of articles.

    Content and all else are made of the same elements, in wrappers of any depth; what tells them apart is what elements
    they are in, how those are named, links, and where they stand.
    """
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    maybe = lambda p, f: f() if rng.random() < p else ""
    times = lambda low, high, f: "".join(f() for _ in range(rng.randint(low, high)))
    syllables = "ta re mi so la ne ka du el or an is the con ver ing est ou eau ción keit von da".split()

    def say(low: int, high: int, end: str = ".") -> str:
        words = ["".join(pick(*syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        words = [w + pick(",", "", "", "", "", "") for w in words]
        return " ".join(words).capitalize() + end

    def yes(text: str) -> str:
        return f"\x02{text}\x03"

    def link(low: int, high: int) -> str:
        return f'<a href="/{rng.randrange(99)}">{say(low, high, "")}</a>'

    def links(low: int, high: int) -> str:
        return times(low, high, lambda: f"<li>{link(1, 3)}</li>")

    def named(tag: str, names: str, body: str) -> str:
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names.split())}">{body}</{tag}>'

    def wrapped(body: str, most: int) -> str:
        """In some wrappers that mean nothing."""
        for _ in range(rng.randint(0, most)):
            tag = pick("div", "div", "div", "section")
            body = f"<{tag}>{body}</{tag}>" if rng.random() < 0.7 else named(tag, "wrapper container row inner outer layout wrap box grid group page", body)
        return body

    def menu() -> str:
        many = pick(f"<ul>{links(3, 9)}</ul>", f"<ol>{links(3, 6)}</ol>", times(3, 8, lambda: link(1, 2)), times(3, 8, lambda: f"<div>{link(1, 2)}</div>"))
        return wrapped(pick(f"<nav>{wrapped(many, 2)}</nav>", named("div", "nav menu navbar topnav navigation site-nav toolbar tabs", many), named("ul", "menu nav nav-list", links(3, 9)), f'<div role="navigation">{many}</div>', f"<ul>{links(4, 9)}</ul>"), 1)

    def header() -> str:
        title = pick(f"<h1>{say(1, 4, '')}</h1>", f"<div>{say(1, 4, '')}</div>", f"<p>{say(1, 6, '')}</p>", f"<h2>{link(1, 3)}</h2>")
        return pick(f"<header>{wrapped(title, 2)}{maybe(0.6, menu)}</header>", named("div", "header site-header banner masthead page-header", wrapped(title, 2) + maybe(0.5, menu)))

    def advert() -> str:
        body = pick(say(3, 12), f"<p>{say(3, 14)}</p>", f'<a href="/x">{say(2, 8)}</a>', f"<h3>{say(1, 4, '')}</h3><p>{say(4, 30)}</p>")
        return named(pick("div", "div", "section", "aside"), "ad ads advert advertisement sponsored sponsor banner-ad promo paid-content", wrapped(body, 2))

    def notice() -> str:
        return named(pick("div", "section", "aside", "dialog"), "cookie cookie-notice notice consent gdpr alert cookie-banner popup modal overlay privacy", wrapped(times(1, 2, lambda: f"<p>{say(6, 25)}</p>") + f"<button>{say(1, 2, '')}</button>", 1))

    def sidebar() -> str:
        body = maybe(0.8, lambda: f"<h{pick(2, 3, 4)}>{say(1, 3, '')}</h{3}>") + pick(f"<ul>{links(3, 8)}</ul>", f"<p>{say(5, 30)}</p>", times(1, 3, lambda: f"<p>{say(4, 40)}</p>"), f"<ul>{times(2, 4, lambda: f'<li>{say(2, 9)}</li>')}</ul>", f"<dl><dt>{say(1, 2, '')}<dd>{say(2, 8)}</dl>")
        body = wrapped(body, 3)
        return pick(f"<aside>{body}</aside>", named("div", "sidebar side widget rail sidebar-right side-bar panel", body), named("aside", "sidebar related widget", body), f'<div role="complementary">{body}</div>')

    def form() -> str:
        return wrapped(pick("<form>", '<form class="newsletter">', '<form id="search">', '<form class="signup">') + f"<label>{say(1, 5, '')}</label><input type='text'>{wrapped(times(1, 2, lambda: f'<p>{say(3, 20)}</p>'), 1)}<button>{say(1, 1, '')}</button></form>", 1)

    def comments() -> str:
        text = lambda: pick(f"<p>{say(4, 60)}</p>", f"<p>{say(4, 40)}</p><p>{say(4, 40)}</p>", say(3, 30))
        one = lambda: pick(f"<li><b>{say(1, 2, '')}</b> {text()}</li>", f'<div class="comment">{text()}</div>', f'<div class="comment-body">{text()}</div>', f"<article>{text()}</article>", f"<div>{text()}</div>", f"<blockquote>{text()}</blockquote>")
        return named(pick("section", "div", "ol", "ul"), "comments comment-list discussion responses replies reader-comments user-comments", wrapped(maybe(0.7, lambda: f"<h3>{say(1, 3, '')}</h3>") + times(1, 5, one), 2))

    def related() -> str:
        body = pick(f"<ul>{links(2, 6)}</ul>", f"<p>{say(2, 7, '')}</p>", times(2, 4, lambda: f"<div><h4>{link(2, 6)}</h4><p>{say(4, 15)}</p></div>"))
        return named(pick("div", "section", "ul"), "related more-stories recommended share social tags breadcrumb breadcrumbs read-more popular trending teaser-list pagination related-posts", wrapped(maybe(0.4, lambda: f"<h3>{say(1, 3, '')}</h3>") + body, 2))

    def footer() -> str:
        inside = pick(f"&copy; {say(1, 4, '')} &middot; {say(3, 9)}", f"<p>{say(3, 14)}</p>", f"<ul>{links(2, 6)}</ul><p>&copy; 2020 {say(1, 4)}</p>", f"<section><h4>{say(1, 2, '')}</h4><p>{say(4, 30)}</p></section><div><p>&copy; {say(2, 4)}</p></div>", times(2, 3, lambda: f"<div><h4>{say(1, 2, '')}</h4><ul>{links(2, 4)}</ul></div>"))
        return pick(f"<footer>{wrapped(inside, 2)}</footer>", f"<footer>{wrapped(inside, 2)}</footer>", named("div", "footer site-footer bottom copyright legal page-footer", wrapped(inside, 2)), f'<div role="contentinfo">{inside}</div>')

    def title() -> str:
        head = lambda low, high: yes(say(low, high, pick("", "", ".")))
        return pick(f"<h1>{head(1, 12)}</h1>", f"<h1>{head(3, 12)}</h1>", f"<header>{wrapped(f'<h1>{head(2, 9)}</h1>', 1)}</header>", f"<h2>{head(2, 9)}</h2>", f"<div><h1>{head(2, 9)}</h1></div>", f"<hgroup><h1>{head(2, 7)}</h1><p>{yes(say(4, 20))}</p></hgroup>", "")

    def piece() -> str:
        text = yes(say(1, pick(2, 8, 40, 90)))
        other = lambda: f"<p>{yes(f'{say(1, 9, '')}<br>{say(2, 12)}')}</p>"
        linking = lambda: f"<p>{yes(f'{say(1, 60)} {link(1, 3)}')}</p>"
        many = lambda low, high: times(2, 5, lambda: f"<li>{pick(yes(say(low, high)), f'<p>{yes(say(low, high))}</p>')}</li>")
        kinds = [
            (50, lambda: f"<p>{text}</p>"), (4, lambda: f"<p>{text}"), (4, other), (5, linking), (7, lambda: f"<h{pick(2, 3, 4)}>{yes(say(1, 6, ''))}</h{2}>"), (5, lambda: f"<ul>{many(1, 14)}</ul>"), (5, lambda: f"<ol>{many(1, 14)}</ol>"),
            (3, lambda: f"<dl>{times(1, 3, lambda: f'<dt>{yes(say(1, 3, ""))}</dt><dd>{yes(say(2, 15))}</dd>')}</dl>"), (3, lambda: f"<pre>{text}</pre>"), (3, lambda: f"<blockquote>{pick(text, f'<p>{text}</p>')}</blockquote>"),
            (3, lambda: f"<figure><img src='x'><figcaption>{yes(say(2, 9))}</figcaption></figure>"), (5, lambda: f"<div>{text}</div>"),
            (3, lambda: f"<table>{times(1, 3, lambda: f'<tr><td>{yes(say(1, 4, ""))}</td><td>{yes(say(1, 4, ""))}</td></tr>')}</table>"), (2, lambda: f"<details><summary>{yes(say(1, 4, ''))}</summary><p>{text}</p></details>"),
        ]
        return rng.choices([make for _, make in kinds], [share for share, _ in kinds])[0]()

    def content() -> str:
        def part() -> str:
            return "".join(piece() + maybe(0.03, advert) + maybe(0.02, related) + maybe(0.01, sidebar) + maybe(0.01, form) for _ in range(rng.randint(1, 5)))

        out = title()
        for _ in range(rng.randint(1, 3)):
            head = maybe(0.5, lambda: f"<h{pick(2, 3)}>{yes(say(1, 6, ''))}</h{2}>")
            out += pick(part(), part(), f"<section>{wrapped(head + part(), 1)}</section>", wrapped(head + part(), 3))
        return out

    for _ in range(n):
        body = wrapped(content(), pick(0, 1, 3, 10))
        inside = body + maybe(0.12, comments) + maybe(0.1, related) + maybe(0.06, form) + maybe(0.06, lambda: f"<footer>{say(2, 9)}</footer>")
        kinds = {
            "article": lambda: f"<article>{inside}</article>",  # noqa: B023
            "main and article": lambda: f"<main>{wrapped(f'<article>{inside}</article>', 1)}</main>",  # noqa: B023
            "main": lambda: f"<main>{inside}</main>",  # noqa: B023
            "div": lambda: named("div", "content main article post entry-content post-body story article-body text page-content main-content", inside),  # noqa: B023
            "named article": lambda: named("article", "post entry hentry story", inside),  # noqa: B023
            "section": lambda: f"<section>{inside}</section>",  # noqa: B023
            "main and section": lambda: f"<main><section>{inside}</section></main>",  # noqa: B023
            "plain": lambda: pick(f"<div>{inside}</div>", inside),  # noqa: B023
        }
        body = kinds[pick(*(k for k in ("article", *kinds) if k in only))]()
        top = maybe(0.2, notice) + maybe(0.5, header) + maybe(0.8, menu) + maybe(0.5, advert)
        low = maybe(0.25, sidebar) + maybe(0.25, comments) + maybe(0.2, related) + maybe(0.2, form) + maybe(0.2, advert) + maybe(0.9, footer) + maybe(0.1, notice)
        body = wrapped(maybe(0.15, sidebar) + body + maybe(0.15, sidebar), pick(0, 0, 2))
        page = top + body + low
        if rng.random() < 0.3:
            page = wrapped(page, 3)
        yield f"<!DOCTYPE html><html><head><title>{say(2, 6, '')}</title><style>p{{}}</style></head><body>{page}{pick('</body></html>', '')}"


def examples(pages: Iterator[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the blocks of labelled pages."""
    out = []
    for page in pages:
        found = blocks(page)
        clean = [b._replace(text=b.text.translate({2: None, 3: None}).strip() or "-") for b in found]
        out.append((features(clean), [int("\x02" in b.text) for b in found]))
    return out


def trained(n: int = FIT_PAGES, seed: int = 3, only: tuple[str, ...] = KINDS) -> Field:
    return fit(examples(labelled_pages(n, seed, only)))


def accuracy(field: Field, pages: Iterator[str]) -> float:
    """The share of blocks that get their label."""
    right = [a == b for feats, labels in examples(pages) for a, b in zip(labels, field.decode(feats), strict=True)]
    return sum(right) / len(right)


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of html_col."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), shared.value) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*others, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in others], text_or_empty(html_col)).mapInArrow(work, ", ".join(x for x in (kinds, "text string, n_chars long") if x))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained())
