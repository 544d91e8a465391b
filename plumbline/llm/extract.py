"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, by the context they stand in, and tags negative; the
scores are log odds learned from labelled pages, in which every stretch of text is marked as content or not. One
linear scan finds the contiguous region of the largest sum. Of that region the words in elements that are never
content (navigation, asides, forms and the like) are left out; they score next to nothing, so that a form between
paragraphs doesn't part them. So are those in boxes that go by their names (adverts, comments, related links): the
parts of a class or id, and how they are joined, are features of a classifier learned from the same labelled pages, so
that names are told that no page of them has.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K

#: Fixed values of HTML: elements without end tags, elements whose content isn't markup, elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements closed by the start of one of these (a paragraph by any block, an item by the next).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that never hold content.
NEVER = frozenset("nav aside form footer button select menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Elements whose own names say nothing of what they hold.
UNNAMED = frozenset("article main body html p h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table select".split())
#: Tokens of a page: comments and declarations, and tags. A quote delimits a value only where the value begins.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|$)", re.S)
_HEADS = re.compile(r"<(/?form|article|main|h1)[\s>]", re.I)
_TITLE = re.compile(r"<h1[\s>]", re.I)
_MARKED = re.compile(r"<(?:article|main)[\s>]", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = frozenset("class id role aria-label hidden aria-hidden".split())


#: The score of words and tags in contexts that are never content, or in boxes that are none by their names.
NOTHING = -0.01


@dataclass
class Stretch:
    """Text between tags: where it stands, whether its context is never content, and names in force if asked for."""

    text: str
    context: str
    never: bool
    names: tuple[str, ...] = ()


@dataclass(slots=True)
class Open:
    """An open element and what it hands down. names: of it and those around it, None where they don't count."""

    tag: str
    never: bool
    named: bool
    within: bool
    link: bool
    block: str
    names: tuple | None


def names_of(attributes: dict[str, str]) -> list[str]:
    """Whole names of an element: each class, the id and the label, lower-cased, parts joined by hyphens, without a
    closing number."""
    said = [*attributes.get("class", "").split(), attributes.get("id", ""), attributes.get("aria-label", "")]
    plain = (re.sub(r"([a-z])([A-Z])", r"\1-\2", x.strip()).replace("_", "-").lower() for x in said)
    return [y for x in plain if (y := re.sub(r"[-\d]+$", "", x))]


def parse(page: str, rare: Callable[[Sequence[str]], bool] | None = None, keep_names: bool = False) -> Iterator[Stretch | str]:
    """Stretches of text and tags ('p', '/p', and '~p', '~/p' in contexts that are never content or bear a rare name;
    the latter's text has the context 'named'), in page order. rare: whether an element's names are those of what is
    rarely content.

    Unclosed elements close where HTML says they do, or with an element around them; comments, declarations, scripts
    and styles are nothing. One pass, in time that grows with the page alone, however deep it nests.
    """
    marked = _MARKED.search(page) is not None
    root = Open("", False, False, False, False, "body", ())
    stack, count, at = [root], Counter(), 0
    # of each open list, the root first, where its open items stand in the stack
    items: list[list[int]] = [[]]

    def pop() -> str:
        tag = stack.pop().tag
        count[tag] -= 1
        if tag in LISTS:
            items.pop()
        elif tag in CLOSES:
            items[-1].pop()
        return tag

    def close(tag: str) -> None:
        while pop() != tag:
            pass

    heads: list[tuple[int, bool]] | None = None

    def holds(start: int) -> bool:
        """Whether an article, a main element or a heading of the first rank comes before a form begins or ends."""
        nonlocal heads
        if heads is None:
            heads = [(x.start(), "form" not in x[1].lower()) for x in _HEADS.finditer(page)]
        i = bisect_left(heads, (start, False))
        return i < len(heads) and heads[i][1]

    def wraps_text(start: int, tag: str) -> bool:
        """Whether an element that begins here holds the page's only heading of the first rank, and so its text: the
        element's own tag, opened and closed, is counted up to that heading."""
        nonlocal titles
        if titles is None:
            titles = [x.start() for x in _TITLE.finditer(page)]
        if len(titles) != 1 or titles[0] < start:
            return False
        if (tag, titles[0]) not in reach:
            # the last place before the title where an element of this tag begins that is still open at it
            opened: list[int] = []
            for x in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", page[: titles[0]], re.I):
                if not x[1]:
                    opened.append(x.end())
                elif opened:
                    opened.pop()
            reach[tag, titles[0]] = frozenset(opened)
        return start in reach[tag, titles[0]]

    titles: list[int] | None = None
    reach: dict[tuple[str, int], frozenset[int]] = {}

    def stretch(raw: str) -> Iterator[Stretch]:
        if raw:
            top = stack[-1]
            where = ("article " if top.within else "outside ") if marked else ""
            names = []
            chain = top.names
            while chain:
                names.append(chain[0])
                chain = chain[1]
            yield Stretch(html.unescape(raw), "named" if top.named else f"{where}{top.block}{'/a' if top.link else ''}", top.never, tuple(names))

    while m := _TOKEN.search(page, at):
        yield from stretch(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, top = m[2].lower(), stack[-1]
        mark = "~" if top.never or top.named else ""
        if m[1]:
            yield f"{mark}/{tag}"
            if count[tag]:
                close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield f"~{tag}"
            continue
        if tag in BLOCK and tag != "br" and count["p"]:
            close("p")
        elif any(count[x] and tag in closers for x, closers in CLOSES.items()):
            for i in reversed(items[-1]):
                if tag in CLOSES[stack[i].tag]:
                    while len(stack) > i:
                        pop()
                    break
        top = stack[-1]
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            yield f"{'~' if top.never or top.named else ''}{tag}"
            continue
        has = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3]) if a[1].lower() in _READ} if m[3].strip() else {}
        unseen = "hidden" in has or has.get("aria-hidden") == "true" or has.get("role", "").lower() in ROLES
        # a form or a veil around the whole article is a wrapper
        wraps = (tag == "form" or has.get("aria-hidden") == "true") and holds(at)
        own = (tag in NEVER or unseen or tag == "header" and not top.within) and not wraps
        said = names_of(has) if has and tag not in UNNAMED else []
        article = tag in ("article", "main")
        named = not article and (top.named or rare is not None and (bool(said) and rare(said) and not wraps_text(at, tag) or tag == "noscript" and not top.within))
        chain = top.names
        if keep_names:
            chain = () if article else chain
            for x in said:
                chain = (x, chain)
        stack.append(Open(tag, top.never or own, named, top.within or article, top.link or tag == "a", tag if tag in BLOCK else top.block, chain))
        count[tag] += 1
        if tag in LISTS:
            items.append([])
        elif tag in CLOSES:
            items[-1].append(len(stack) - 1)
        yield f"{'~' if stack[-1].never or stack[-1].named else ''}{tag}"
    yield from stretch(page[at:])


# ---- weights ----


@dataclass(frozen=True)
class Weights:
    """Score of a word by context ('p', 'li/a', 'named' or 'never'), and of a tag by its name; others get the default.
    name: what each feature of a name adds to the log odds of content under an element of that name."""

    word: dict[str, float]
    tag: dict[str, float]
    word_default: float
    tag_default: float
    name: dict[str, float]

    def odds(self, names: Sequence[str]) -> float:
        """Log odds of content under an element of these names, 0 for names without a known feature."""
        return sum(self.name.get(f, 0.0) for x in names for f in features_of(x))

    def rare(self, names: Sequence[str]) -> bool:
        return self.odds(names) < RARE


#: Parts of names that say how a box is built, and stand around anything.
STRUCTURAL = frozenset("wrapper wrap box block container inner outer row item items list col column columns section panel text content area group holder holding body module".split())
#: Elements whose names have lower log odds hold what is rarely content.
RARE = -0.5


def features_of(name: str) -> list[str]:
    """The name, its parts, its first and last one, and each two that stand side by side; parts that only say how a box
    is built are left out first, and a name of nothing else has no features."""
    parts = [x for x in name.split("-") if x not in STRUCTURAL]
    if len(parts) < 2:
        return [f"={parts[0]}", parts[0]] if parts else []
    name = "-".join(parts)
    return [f"={name}", *dict.fromkeys(parts), f"{parts[0]}-*", f"*-{parts[-1]}", *(f"{a}-{b}" for a, b in zip(parts, parts[1:], strict=False))]


def learn_names(shares: dict[str, tuple[float, float]], steps: int = 400, decay: float = 0.02) -> dict[str, float]:
    """Weights of names' features: logistic regression without a constant on the share of content under each name
    (words of other text, words of content), both classes counting the same in all."""
    names = sorted(shares)
    index = {f: i for i, f in enumerate(sorted({f for x in names for f in features_of(x)}))}
    x = np.zeros((len(names), len(index)))
    for row, name in enumerate(names):
        x[row, [index[f] for f in features_of(name)]] = 1.0
    y = np.array([(shares[n][1] + 0.5) / (sum(shares[n]) + 1.0) for n in names])
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight, w = weight / max(weight.sum(), 1e-9), np.zeros(len(index))
    target = np.divide(y / max(y.sum(), 1e-9), y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)) if len(y) else y
    for _ in range(steps):
        w -= 20.0 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - target)) + decay * w / max(len(names), 1))
    return {f: float(w[i]) for f, i in index.items()}


def _odds(n: list[float], smoothing: float) -> float:
    return float(np.log((n[1] + smoothing) / (n[0] + smoothing)))


def _labels(page: str, main: str, rare: Callable | None) -> Iterator[tuple[Stretch | str, bool | None]]:
    """A page's tokens, and of stretches with words whether they are content."""
    want, position = main.split(), 0
    for x in parse(page, rare, keep_names=True):
        words = [] if isinstance(x, str) else x.text.split()
        good = bool(words) and words == want[position : position + len(words)]
        position += len(words) * good
        yield x, good if words else None


def learn(labelled: list[tuple[str, str]], smoothing: float = 1.0) -> Weights:
    """Weights from labelled pages (html, main text): log odds of content for words by the names and by the context that
    they stand in, and for tags by whether they stand within the content. Tags are kept negative, and words in contexts
    that are never content, by element or by name, just below 0."""
    name: dict[str, list[float]] = {}
    for page, main in labelled:
        for x, good in _labels(page, main, None):
            if good is not None:
                for y in set(x.names):
                    name.setdefault(y, [0.0, 0.0])[good] += len(x.text.split())
    names = learn_names({k: tuple(v) for k, v in name.items()})
    rare = Weights({}, {}, 0, 0, names).rare
    word: dict[str, list[float]] = {}
    tag: dict[str, list[float]] = {}
    for page, main in labelled:
        tokens = [t for t in _labels(page, main, rare) if t[1] is not None or isinstance(t[0], str) and t[0][0] != "~"]
        known = [i for i, (_, good) in enumerate(tokens) if good]
        first, last = (known[0], known[-1]) if known else (1, 0)
        for i, (x, good) in enumerate(tokens):
            if isinstance(x, str):
                tag.setdefault(x.lstrip("/"), [0.0, 0.0])[first <= i <= last] += 1
            else:
                word.setdefault("never" if x.never else x.context, [0.0, 0.0])[good] += len(x.text.split())
    total_w, total_t = ([sum(n[i] for k, n in d.items() if k not in ("never", "named")) for i in (0, 1)] for d in (word, tag))
    cap = 3.0
    return Weights(
        {k: NOTHING if k in ("never", "named") else max(-cap, min(cap, _odds(n, smoothing))) for k, n in word.items()},
        {k: max(-cap, min(-0.05, _odds(n, smoothing))) for k, n in tag.items()},
        max(0.25, min(cap, _odds(total_w, smoothing))),
        max(-cap, min(-0.05, _odds(total_t, smoothing))),
        names,
    )


def _sample(title: str, parts: list[str], extra: str = "") -> tuple[str, str]:
    """A labelled page: the frame that sites put around an article, and the article's text."""
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "World", "Sport", "About"))
    body = "".join(f"<p>{p}</p>" for p in parts)
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body><header><a href='/'>The Daily Sample</a></header><nav><ul>{menu}</ul></nav>"
        f'<p>You are reading page one.</p><div>Skip to the text</div>Today is Monday<div class="ad">Buy our things now at half the price.</div><article><h1>{title}</h1>{body}</article><aside><h2>Most read</h2><ul>{menu}</ul></aside>{extra}<div>All times are local</div><p>Set in our own type.</p>'
        "<footer>&copy; The Daily Sample. Terms and privacy.</footer></body></html>"
    )
    return page, "\n".join([title, *parts])


#: Labelled pages, written for this module.
LABELLED = [
    _sample("Rain over the hills", ["It rained for three days and the river rose to the old mark.", "People carried sand to the bridge until the evening.", "By Sunday the water had gone down again."]),
    _sample("A short note", ["The library opens an hour later on Mondays from next month on."], "<form><label>Your mail</label><input name='m'><button>Send</button></form>"),
    _sample("How the mill was saved", ["The mill had stood empty since the war.", "<b>Its wheel was broken</b> and its roof let in the rain, but the walls were sound.", "A group of neighbours met every week and asked for help wherever they could.", "Now flour is ground there again."], "<div id='comments'><p>Nice piece, thank you.</p><p>I was there as a child.</p></div>"),
    _sample("Council votes on the market square", ["The council has voted to keep the square free of cars.", "Shops may still be reached by vans in the early morning.", "The vote was close: eleven for and nine against."], "<div class='related'><a href='/1'>Other stories</a> <a href='/2'>More from the town</a></div>"),
]
LABELLED.append(
    (
        "<html><body><table><tr><td><a href='/'>Start</a></td><td><a href='/old'>Old pages</a></td></tr></table><div><ul><li><a href='/a'>Boats</a></li><li><a href='/b'>Sails</a></li></ul></div>"
        "<div><h2>On knots</h2><p>A good knot holds under load and opens by hand.</p><p>Of the many that sailors know, a handful is enough: the bowline, the hitch, the reef knot, and one to join two ropes.</p><ul><li>Tie it slowly at first.</li><li>Then tie it in the dark.</li></ul><blockquote>Any rope will tell you when it is wrong.</blockquote></div>"
        "<div><a href='/c'>Write to us</a> <a href='/d'>Map of the site</a></div></body></html>",
        "On knots\nA good knot holds under load and opens by hand.\nOf the many that sailors know, a handful is enough: the bowline, the hitch, the reef knot, and one to join two ropes.\nTie it slowly at first.\nThen tie it in the dark.\nAny rope will tell you when it is wrong.",
    )
)
LABELLED = [(page, re.sub(r"</?b>", "", main)) for page, main in LABELLED]

#: Boxes around articles and names that sites give them: what is under them on the labelled pages below isn't content.
BOXES = {
    "Buy our things now at half the price.": "ad ads advert adverts advertisement advertising ad-slot ad-box ad-container ads-block top-ad google-ads adsense dfp-ad sponsor sponsored sponsors sponsored-links sponsored-post promoted promoted-content promoted-stories paid-content promo promotion promo-box partner-offers affiliate banner banner-ad banner-wrap ad-content ad-inner ads-wrap promo-content promo-wrapper sponsored-box sponsored-wrapper",
    "We use cookies. Accept all or choose.": "cookie cookies cookie-banner cookie-bar cookie-consent cookie-law-info cookies-popup consent consent-dialog gdpr gdpr-notice notice notices site-notice alert alert-bar privacy-notice privacy-popup cookie-wrapper cookie-content consent-wrap notice-box notice-content alert-wrapper gdpr-container",
    "Sign up for our letter. Log in. Subscribe.": "newsletter newsletter-signup newsletter-box subscribe subscribe-form subscription subscription-offer signup sign-up login login-form popup popup-overlay modal modal-dialog overlay paywall paywall-offer donate newsletter-content subscribe-wrap signup-container login-wrapper modal-content popup-inner overlay-content",
    "Home News World Sport About": "nav navbar navigation site-navigation main-nav nav-links menu menus main-menu menu-item breadcrumb breadcrumbs breadcrumb-trail toc table-of-contents pagination post-pagination pager skip-link toolbar top-bar topbar masthead site-header page-top nav-wrapper nav-container menu-wrap menu-content breadcrumb-wrap toolbar-inner navbar-inner",
    "Most read this week, and what to see.": "sidebar side-bar sidebars left-sidebar sidebar-inner side-col sidecol side-column col-side right right-col right-column right-rail rail left-rail left-nav widget widgets widget-area widget-title related related-posts related-articles related-content related-news related-links recommended recommendations recommended-reading read-more see-also more-stories more-from most-read most-popular popular-posts trending trending-stories teaser teasers sidebar-content sidebar-wrapper widget-content widget-wrap related-wrapper related-box rail-content recommended-content read-more-wrap",
    "Nice piece, thank you. I was there as a child. Reply": "comment comments comment-list comment-form comments-section comments-area comments-wrapper comment-thread article-comments post-comments disqus disqus-thread reply replies reply-list response responses reader-replies comment-content comment-body comment-wrap comments-container comments-inner reply-content replies-box",
    "Share on all channels. Like. Follow us.": "share sharing share-buttons share-tools share-bar article-share social social-links social-media social-icons follow-us tag-list tags-list post-tags author-box byline-links share-wrapper share-content social-wrap social-container social-block follow-box",
    "All rights kept. Terms and privacy. Imprint.": "footer footer-links site-footer footer-widgets page-footer copyright copyright-notice disclaimer-footer imprint footer-content footer-wrapper footer-inner footer-container copyright-text copyright-wrap",
}
#: Names around an article's own text, and of what stands in it, on the labelled pages below; some say what else a page
#: has or hasn't.
TEXTS = (
    "content content-left left-content main-left main-content page-content content-wrapper content-area content-inner site-content post-content entry-content article-content article-body article-text story-body post-body body-text story text post entry article single-post hentry main main-column main-inner center-column "
    "no-sidebar has-sidebar with-sidebar sidebar-none page-with-comments has-comments comments-open comments-closed no-comments ad-free no-ads has-ads header-fixed fixed-header has-menu menu-open sticky-nav with-footer has-cookie-notice "
    "entry-header article-header post-header story-header header-inner entry-title article-title headline title subtitle standfirst lead intro summary abstract chapter section section-body block text-block rich-text paragraph wrapper wrap container inner box row col column panel item list "
    "related-work search-methods search legal legal-text discussion discussion-section results methods conclusion references footnotes caption figure table-wrapper code-block quote example note answer question recipe ingredients instructions"
)


def _boxed(title: str, parts: list[str], inside: str, box: str, before: list[str], after: list[str]) -> tuple[str, str]:
    """A page without an article element: boxes by name before and after the text's container."""
    frame = lambda names: "".join(f'<div class="{x}"><p>{box}</p></div>' for x in names)
    text = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts)
    return f'<html><body><div id="page">{frame(before)}<div class="{inside}">{text}</div>{frame(after)}</div></body></html>', re.sub("<[^>]*>", "", "\n".join([title, *parts]))


_STORIES = [
    ("The ferry sails again", ["After two years in the yard the <a href='/ferry'>old ferry</a> is back on the lake.", "Its engine is new, its bell is the one that people know.", "The first crossing leaves at eight; <a href='/times'>all times</a> are at the pier."]),
    ("Seeds for dry ground", ["Sow early, before the last frost, and water little.", "Plants that must look for water grow deep roots.", "Thin the rows when the second leaves show.", "Harvest begins in late summer and goes on until the <i>nights</i> are cold."]),
    ("Minutes of the meeting", ["Nine members were present.", "The accounts of the year were read and passed without <a href='/vote'>a vote</a> against them.", "The next meeting is in the school hall."]),
]
_MANUAL = (
    "<h1>Setting up the pump</h1><section><h2>Before you start</h2><p>Read all of this first, and <a href='#parts'>the parts</a> below.</p><dl><dt>Valve</dt><dd>Opens to the left when the lever is down.</dd><dt>Float</dt><dd>Stops the pump before it runs dry.</dd></dl></section>"
    "<section><h2>Parts</h2><table><tr><th>Part</th><th>How many</th></tr><tr><td>Long bolts with washers</td><td>four</td></tr><tr><td>Rubber seals of the large size</td><td>two</td></tr></table><pre>pump --fill tank --until full</pre><figure><img src='p.png'><figcaption>The pump seen from its left side.</figcaption></figure><div>Keep the box for the winter.</div></section>"
)
_MANUAL_TEXT = "Setting up the pump\nBefore you start\nRead all of this first, and the parts below.\nValve\nOpens to the left when the lever is down.\nFloat\nStops the pump before it runs dry.\nParts\nPart\nHow many\nLong bolts with washers\nfour\nRubber seals of the large size\ntwo\npump --fill tank --until full\nThe pump seen from its left side.\nKeep the box for the winter."
for _open, _close in (("<main>", "</main>"), ("<div class='content'>", "</div>")):
    LABELLED.append((f"<html><body><header><a href='/'>Pumps</a></header><nav><ul><li><a href='/a'>Manuals</a></li><li><a href='/b'>Shops</a></li></ul></nav>{_open}{_MANUAL}{_close}<div class='footer'><a href='/c'>Imprint</a></div></body></html>", _MANUAL_TEXT))
_NAMES = TEXTS.split()
for _i, (_box, _names) in enumerate(BOXES.items()):
    _all = _names.split()
    for _k in range(4):
        _title, _parts = _STORIES[(_i + _k) % len(_STORIES)]
        _around = [" ".join(_NAMES[_j : _j + 1]) for _j in range(4 * _i + _k, len(_NAMES), 4 * len(BOXES))]
        _page, _main = _boxed(_title, _parts, _around[0], _box, _all[_k::8], _all[4 + _k :: 8])
        for _name in _around[1:]:
            _page = _page.replace('<div id="page">', f'<div id="page"><div class="{_name}"><p>{_parts[0]}</p></div>', 1)
            _main = re.sub("<[^>]*>", "", _parts[0]) + "\n" + _main
        LABELLED.append((_page, _main))


# ---- the region ----


def best_region(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run with the largest sum; the first, and of those the longest, of equals; empty
    if no sum is positive. One pass."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best or (total == best and best > 0 and start == begin):
            best, begin, end = total, start, i + 1
    return begin, end


def _region(page: str, weights: Weights, rare: Callable | None) -> tuple[list[Stretch | str], int, int, int]:
    """A page's tokens, [begin, end) of its best region, and the words under names of what is rarely content."""
    tokens, scores, named = list(parse(page, rare)), [], 0
    for x in tokens:
        if isinstance(x, str):
            scores.append(NOTHING if x[0] == "~" else weights.tag.get(x.lstrip("/"), weights.tag_default))
        else:
            n, never = len(x.text.split()), x.never or x.context == "named"
            named += n if never and not x.never else 0
            scores.append(n * (NOTHING if never else weights.word.get(x.context, _default(x.context, weights))))
    return tokens, *best_region(scores), named


def main_text(page: str | None, weights: Weights, rare: Callable[[Sequence[str]], bool] | None = None) -> str:
    """The text of the best region: its blocks in page order, each with white space as single spaces, joined by line
    feeds, without what stands in elements that are never content or are none by their names. A page without markup is
    all content. Where what is left is in no article, has no heading of the first two ranks and at most a tenth of the words
    under such names, the names are of the text itself, and the page is read without regard to them."""
    if not page:
        return ""
    tokens, begin, end, named = _region(page, weights, rare or weights.rare)
    if named:
        inside = [x for x in tokens[begin:end] if not isinstance(x, str) and not x.never and x.context != "named"]
        headed = any(re.match(r"article |(?:outside )?h[12]\b", x.context) for x in inside if x.text.strip())
        if not headed and 10 * sum(len(x.text.split()) for x in inside) <= named:
            tokens, begin, end, _ = _region(page, weights, None)
    blocks: list[list[str]] = [[]]
    for x in tokens[begin:end]:
        if isinstance(x, str):
            if x.lstrip("~/") in BLOCK:
                blocks.append([])
        elif not x.never and x.context != "named":
            blocks[-1].append(x.text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _default(context: str, weights: Weights) -> float:
    """The score of a word in a context that no labelled page has: by whether it is in a marked article or a link."""
    if context == "named":
        return NOTHING
    if context.startswith("outside "):
        return -weights.word_default
    link = context == "a" or context.endswith("/a")
    return -weights.word_default if link else weights.word_default


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; null html counts as empty, and an empty page has an empty
    text. Nothing is cut short. Repeated rows each get their row; other columns are ignored."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or learn(LABELLED))

    def run(batches):
        weights = sent.value
        known = lru_cache(1 << 16)(lambda names: weights.rare(names))
        for batch in batches:
            texts = [main_text(x.as_py(), weights, lambda names: known(tuple(names))) for x in K.text_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
