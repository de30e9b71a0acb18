"""HTML main-text extraction by composite text density (operator 10).

A page is read into a tree.  Every node gets its characters per tag, adjusted
by how much of them are links; every node sums the densities of its children,
and the node of the largest sum carries the main text.  The smallest density
on its path from the body is the threshold: subtrees beside the path that
reach it are main text too.  Elements that are never part of an article
(menus, page headers and footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) are left out by their tag, role, class or id; a
class or id counts as a whole token, without its place or state.  Names yield
to the text: an element that holds an article or main element, or over half
of the body's visible text, is never left out by them.

Defined results: a null or empty html, and a page without text, gives the
empty string and 0 characters; markup that is broken or unclosed is read as
far as it goes; very long pages are read whole, in time proportional to their
length; of nodes with equal sums the first of the page is selected; repeated
pages are returned each; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellgrid.llm.common import sliced

SLICE = 4 << 20

#: Where a comment, a tag or a declaration may begin.
_BEGINS = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*+)|[!?])")
#: Attributes up to the end of a tag, or as far as quotes are closed.
_ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
_PLAIN = re.compile(r"[^>\"']*+([>\"'])")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_INVISIBLE = re.compile(r"\baria-hidden\s*=\s*[\"']?true|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph.
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
#: Open elements that a new one of the key ends, and the ones that shield them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Never main text.
_OUT = set("head script style template noscript nav aside footer form button select textarea input label fieldset iframe object embed svg canvas menu dialog noembed noframes xmp title audio video map".split())
_OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Tags that are left out whatever they hold: their content is no text of the page.
_NO_TEXT = set("head script style template noscript button select textarea input label iframe object embed svg canvas noembed noframes xmp title audio video map".split())
#: Tokens of a class or id that mark the same; a compound is marked if all its words are marks or neutral.
_OUT_WORDS = set(
    "nav navbar navigation menu menus submenu sidebar sidebars aside footer foot header masthead topbar ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion "
    "banner banners cookie cookies consent gdpr notice notices notification alert popup popover modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies reply widget widgets toolbar search form skip".split()
)
_NEUTRAL_WORDS = set(
    "left right top bottom main primary secondary site page global inner outer wrapper wrap container box block area section list item items content links link bar panel column col unit slot text title "
    "the of for and to us our post posts entry entries article articles story recent email mail social media wp".split()
)
#: Words of a token that tells a state or a layout of what holds it, not what it is.
_STATE_WORDS = set("no not non without has have with is are hide hidden show shown off on open opened closed enabled disabled active inactive fixed sticky static collapsed expanded visible allowed allow".split())
#: Words that do not count inside an article: its own headline may stand there.
_HEADER_WORDS = {"header", "masthead", "banner"}
_KEPT = {"html", "body", "article", "main"}
_split_words = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class _Markup:
    """Reads the markup of a page, in time proportional to its length whatever the quotes in it."""

    def __init__(self, html: str) -> None:
        self.html, self.last_end = html, html.rfind(">")
        self.unclosed: set[int] | None = None  # quotes from which no end of a tag is reached; None before the first

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name (empty for none) and attributes of the next piece of markup."""
        html = self.html
        m = _BEGINS.search(html, at)
        if m and m.start() > self.last_end:  # only a comment may go on to the end
            start = html.find("<!--", m.start())
            return (start, len(html), "", "", "") if start >= 0 else None
        if not m:
            return None
        if m[2] is None:
            if m[0] == "<!--":
                end = html.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(html), "", "", ""
            return m.start(), html.find(">", m.end()) + 1, "", "", ""
        end = self._tag_end(m.end())
        if end < 0:  # a quote that nothing closes: up to the first sign that can end a tag
            end = html.find(">", m.end())
        return m.start(), end + 1, m[1], m[2], html[m.end() : end]

    def _tag_end(self, at: int) -> int:
        """Where the tag ends outside of quotes, or -1."""
        if self.unclosed is None:
            m = _ATTRS.match(self.html, at)
            if m[2]:
                return m.start(2)
            self.unclosed = set()
        seen: list[int] = []
        while m := _PLAIN.match(self.html, at):
            if m[1] == ">":
                return m.start(1)
            quote = m.start(1)
            if quote in self.unclosed:
                break
            seen.append(quote)
            at = self.html.find(m[1], quote + 1) + 1
            if not at:
                break
        self.unclosed.update(seen)
        return -1


def _marks(token: str) -> set[str]:
    """The words by which a class or id token marks its element, if it does as a whole."""
    words = {w for w in _split_words.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if len(w) > 1}
    marks = words & _OUT_WORDS
    return marks if marks and words <= _OUT_WORDS | _NEUTRAL_WORDS and not words & _STATE_WORDS else set()


def _left_out(tag: str, attrs: str, in_article: bool) -> int:
    """2: never text; 1: left out unless it holds the text; 0: not left out."""
    if tag in _KEPT:
        return 0
    if tag in _NO_TEXT:
        return 2
    soft = tag in _OUT or (tag == "header" and not in_article)
    if "=" not in attrs:
        return 2 if "hidden" in attrs and _HIDDEN.search(attrs) else int(soft)
    # the bare attribute, not a word in another one's value
    if ("hidden" in attrs or "none" in attrs) and (_HIDDEN.search(_VALUE.sub('""', attrs)) or _INVISIBLE.search(attrs)):
        return 2
    for m in () if soft else _NAMED.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        if m[0][:2].lower() == "ro":
            role = value.strip().lower()
            soft = soft or (role in _OUT_ROLE and not (in_article and role == "banner"))
        else:
            soft = soft or any(not in_article or marks - _HEADER_WORDS for marks in map(_marks, value.split()) if marks)
    return int(soft)


def _outs(tags: list[str], parents: list[int], last: list[int], marks: list[int], runs: list[tuple[int, int, str]]) -> list[bool]:
    """For each node whether it is left out; names yield to the text."""
    n = len(tags)
    gone = [False] * n  # never text
    for i in range(1, n):
        gone[i] = gone[parents[i]] or marks[i] == 2
    if 1 in marks:
        chars = [0] * n
        for node, _, text in runs:
            if not gone[node]:
                chars[node] += len(text) - text.count(" ") - text.count("\n")
        own = list(chars)
        for i in range(n - 1, 0, -1):
            chars[parents[i]] += chars[i]
            if marks[i] != 1 and tags[i] not in ("article", "main"):
                own[parents[i]] += own[i]  # without marked parts and inner articles
        depth = [0] * n  # marked elements around
        for i in range(1, n):
            depth[i] = depth[parents[i]] + (marks[i] == 1)
        cores = [i for i in range(n) if tags[i] in ("article", "main") and chars[i]]
        least = min((depth[i] for i in cores if own[i]), default=0)
        body = next((i for i in range(n) if tags[i] == "body"), 0)
        holds = [False] * n
        for i in cores:
            up = i
            while up >= 0 and depth[i] == least and own[i] and not holds[up]:
                holds[up] = True
                up = parents[up]
        bare = not any(own[c] for c in cores)
        for i in range(1, n):
            if marks[i] != 1:
                continue
            k = bisect_right(cores, i)
            inner = k < len(cores) and cores[k] <= last[i]
            if holds[i] or (2 * chars[i] > chars[body] and (inner or bare)):
                marks[i] = 0
    outs = [False] * n
    for i in range(1, n):
        outs[i] = outs[parents[i]] or marks[i] > 0
    return outs


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by blank lines."""
    if not html:
        return ""
    # node: tag, parent; nodes are numbered in page order, so a subtree is a range
    tags, parents, last, marks = ["#root"], [-1], [0], [0]
    runs: list[tuple[int, int, str]] = []  # node, block, raw text
    stack, in_article, block, at, n = [0], 0, 0, 0, len(html)
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    markup = _Markup(html)

    def pop_to(depth: int) -> None:
        nonlocal in_article
        while len(stack) > depth:
            node = stack.pop()
            last[node] = len(tags) - 1
            open_at[tags[node]].pop()
            if tags[node] in ("article", "main"):
                in_article -= 1

    def deepest(of: set[str]) -> int:
        return max((open_at[t][-1] for t in of if open_at.get(t)), default=0)

    def end_open(ends: set[str], shields: set[str]) -> None:
        while (d := deepest(ends)) > deepest(shields):
            pop_to(d)

    while at < n:
        piece = markup.next(at)
        stop = piece[0] if piece else n
        if stop > at:
            runs.append((stack[-1], block, html[at:stop]))
        if not piece:
            break
        _, at, slash, name, attrs = piece
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag in _BLOCK:
                block += 1
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            continue
        if tag in _BLOCK:
            block += 1
            if tag in _ENDS_P and open_at.get("p"):
                end_open({"p"}, {"table", "button", "object"})
            if tag in _ENDS:
                end_open(*_ENDS[tag])
        elif tag in _ENDS:
            end_open(*_ENDS[tag])
        node = len(tags)
        parent = stack[-1]
        tags.append(tag)
        parents.append(parent)
        last.append(node)
        marks.append(_left_out(tag, attrs, in_article > 0))
        if tag in _VOID:
            if tag == "br":
                runs.append((parent, block, " "))
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                runs.append((node, block, html[at:stop]))
            close = html.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if tag in ("article", "main"):
            in_article += 1
    pop_to(1)
    last[0] = len(tags) - 1
    outs = _outs(tags, parents, last, marks, runs)
    live = [(node, b, unescape(raw) if "&" in raw else raw) for node, b, raw in runs if not outs[node]]
    if not live:
        return ""
    keep = _selected(tags, parents, last, outs, live)
    blocks: list[str] = []
    parts: list[str] = []
    current = -1
    for node, b, text in live:
        if b != current:
            if joined := " ".join("".join(parts).split()):
                blocks.append(joined)
            parts, current = [], b
        if keep[node]:
            parts.append(text)
    if joined := " ".join("".join(parts).split()):
        blocks.append(joined)
    return "\n\n".join(blocks)


def _selected(tags: list[str], parents: list[int], last: list[int], outs: list[bool], live: list[tuple[int, int, str]]) -> list[bool]:
    """For each node whether its own text belongs to the main text."""
    n = len(tags)
    chars, link_chars, count, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in live:
        chars[node] += len(text) - text.count(" ") - text.count("\n")
    is_link = [t == "a" for t in tags]
    for i in range(n - 1, 0, -1):
        if outs[i]:
            continue
        p = parents[i]
        if is_link[i]:
            link_chars[i] = chars[i]
            links[i] += 1
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        links[p] += links[i]
        count[p] += count[i] + 1
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        if outs[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(1, count[i]), link_chars[i], max(1, links[i])
        base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e) + math.e - 1)
        density[i] = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(base, 0.1)
        sums[parents[i]] += density[i]
    inside = range(body, last[body] + 1)
    best = max(inside, key=lambda i: (sums[i], -i), default=body)
    if sums[best] <= 0:
        return [not x for x in outs]
    # an article or main element that holds the best node bounds the same text
    path = []
    i = best
    while i > body:
        path.append(i)
        i = parents[i]
    for i in path:
        if tags[i] in ("article", "main"):
            best = i
            break
    threshold = min((density[i] for i in [body, *path]), default=0.0)
    keep = [False] * n
    for i in range(best, last[best] + 1):
        keep[i] = not outs[i]
    i = best
    while i > body and tags[best] not in ("article", "main"):
        p = parents[i]
        j = p + 1
        while j <= last[p]:  # from child to child
            if j != i and not outs[j] and density[j] >= threshold > 0:
                for k in range(j, last[j] + 1):
                    keep[k] = not outs[k]
            j = last[j] + 1
        keep[p] = not outs[p]
        i = p
    return keep


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", SLICE):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
