"""Main text of web pages by consensus host paths.

A page's containers are scored by the text of the blocks in them, and a container stands for the whole it is part of: it moves
up while its parent adds text that isn't mostly links, below body or to main; a blockquote, and a section or cell inside an
article, never stands for itself. Their paths, generalised to tags and classes (digits in a
class become `#`), are voted on per host in Spark: a page gives each of its best containers the share of its score. The path
with most votes is the host's, and every page is extracted again from the containers that lie on it. A page that has none of
them, or no host, uses its own best container. The path moves up on each page alike, as pages of a host differ in what lies around it.

A block is what lies between the borders of block elements. Navigation, headers and footers of the page, sidebars, notices,
adverts, comments, scripts and styles are left out, told by tag or role. The words of a class or id, and a form, are evidence
only: such an element stays if the host's winning path runs through it, or if it holds the page's text: more unlinked text
than all that is outside of it together with a heading, article or main, or nine times as much without one. Comments, and
forms with less than 40 characters a field, never stay. Words that state what a page has or lacks (`has-sidebar`, `ad-free`)
and an article's own header are no evidence. Paths are numbered by (number above, own part), and written out for voted ones
only, so that time and memory are linear in a page's length however deep it is.

A null, empty or plain html gives "" or its text; rows with null or repeated page_ids give a row each; a null url has no
host; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, map_batches, small, stored, table

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body div main section td blockquote".split())
#: Containers that are parts of a text, not the whole.
PARTS = frozenset("section td blockquote".split())
LEFT_OUT = frozenset("aside button canvas datalist dialog footer head iframe input math menu nav noscript object select svg template textarea".split())
RAW = frozenset("script style".split())
ENDS_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An element that opens ends an open one of these, up to the element that bounds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LEFT_OUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo "
                           "sponsor sponsored cookie cookies notice consent gdpr popup modal overlay newsletter subscribe signup login form search comment "
                           "comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Parts of a class that make it a statement about the page, and those that make a header an article's own.
STATE_WORDS = frozenset("has with without no not is free less open closed enabled disabled".split())
OWN_WORDS = frozenset("article content entry post story section".split())
FIELDS = frozenset("input textarea select button".split())

#: Characters a field from which a form is more than its fields, and what an element holds for each character outside to stay without a heading.
FIELD_TEXT, MOST = 40, 9
#: Containers of a page that take part in the vote.
VOTES = 3
#: Hosts up to which the winning paths are sent to all executors.
BROADCAST_HOSTS = 200_000
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_DIGITS = re.compile("[0-9]+")


class Page:
    """Elements (parent, number of their path) and blocks (text, characters in links, element) of what stays; a winning path's elements stay."""

    def __init__(self, html: str, winner: str | None = None):
        self.parents, self.tags, self.paths = [-1], [""], [0]
        self._above, self._parts, self._numbers = [-1], [""], {}
        self._out, self._within, self._nearest, self._doubt, self._remark = [False], [False], [0], [0], [False]
        self._heads, self._fields = [0], [0]
        self._runs: list[tuple[str, int, bool]] = []
        self._ends: list[tuple[int, int]] = []
        self._sized: dict[int, tuple[str, int, bool, int, int]] | None = None
        self._wholes: dict[int, int] = {}
        self._read(html)
        self.blocks = self._blocks(self._hidden(self.number(winner) if winner else None))

    def _read(self, html: str) -> None:
        stack, places, at, links = [0], {}, 0, 0

        def cut(k: int) -> int:
            n = 0
            for e in stack[k:]:
                places[self.tags[e]].pop()
                n += self.tags[e] == "a"
            del stack[k:]
            return n

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while m := _MARKUP.search(html, at):
            if m.start() > at:
                self._add(html[at:m.start()], stack[-1], links)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in BLOCK:
                    self._border(stack[-1])
                if k := last((tag,)):
                    links -= cut(k)
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                at = end.start() if end else len(html)
            if tag == "br":
                self._add(" ", stack[-1], links)
            if tag in BLOCK:
                self._border(stack[-1])
            if tag in VOID:
                if tag in FIELDS:
                    self._fields[stack[-1]] += 1
                continue
            ends, bounds = CLOSES.get(tag, (frozenset(), frozenset()))
            ends = ends | {"p"} if tag in ENDS_P else ends
            if (k := last(ends)) and k > last((bounds | CONTAINER) - ends):
                links -= cut(k)
            element = self._open(tag, m[3] or m[6] or "", stack[-1])
            links += tag == "a"
            if tag not in RAW:
                places.setdefault(tag, []).append(len(stack))
                stack.append(element)
        if at < len(html):
            self._add(html[at:], stack[-1], links)
        self._border(stack[-1])

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes else {}
        classes = sorted(set(found.get("class", "").split()))
        within = self._within[parent]
        out = (tag in LEFT_OUT or tag == "header" and not within or "hidden" in found
               or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in LEFT_OUT_ROLES)
        said: set[str] = set()
        if tag not in ("html", "body", "article", "main"):
            for name in (*classes, *found.get("id", "").split()):
                words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))}
                if words.isdisjoint(STATE_WORDS):
                    said |= words & LEFT_OUT_WORDS - ({"header"} if within or not words.isdisjoint(OWN_WORDS) else set())
        key = self.paths[parent], f"{tag}{''.join('.' + _DIGITS.sub('#', c) for c in classes)}"
        if key not in self._numbers:
            self._numbers[key] = len(self._above)
            self._above.append(key[0])
            self._parts.append(key[1])
        element = len(self.tags)
        self.parents.append(parent)
        self.tags.append(tag)
        self.paths.append(self._numbers[key])
        self._out.append(self._out[parent] or out)
        self._within.append(within or tag in ("article", "main"))
        self._nearest.append(element if tag in CONTAINER else self._nearest[parent])
        self._doubt.append(element if said or tag == "form" else self._doubt[parent])
        self._remark.append(self._remark[parent] or not said.isdisjoint(COMMENT_WORDS))
        self._heads.append(int(tag in ("h1", "article", "main") and not self._remark[-1]))
        self._fields.append(int(tag in FIELDS))
        return element

    def _add(self, text: str, element: int, links: int) -> None:
        if not self._out[element]:
            self._runs.append((text, element, links > 0))

    def _border(self, element: int) -> None:
        if len(self._runs) > (self._ends[-1][0] if self._ends else 0):
            self._ends.append((len(self._runs), element))

    def number(self, path: str) -> int | None:
        """The number of a path on this page."""
        at: int | None = 0
        for part in path.split("/")[1:]:
            if (at := self._numbers.get((at, part))) is None:
                return None
        return at

    def path(self, number: int) -> str:
        parts = []
        while number:
            parts.append(self._parts[number])
            number = self._above[number]
        return "".join("/" + p for p in reversed(parts))

    def _hidden(self, winner: int | None) -> list[bool]:
        """Of each element whether it is left out."""
        if not any(self._doubt):
            return self._out
        plain = [0] * len(self.tags)
        total = 0
        for text, element, linked in self._runs:
            if not linked and not self._remark[element]:
                n = len("".join(text.split()))
                plain[element] += n
                total += n
        heads, fields = self._heads[:], self._fields[:]
        for e in range(len(self.tags) - 1, 0, -1):
            for counts in (plain, heads, fields):
                counts[self.parents[e]] += counts[e]
        won = set()
        while winner:
            won.add(winner)
            winner = self._above[winner]
        out = [False]
        for e in range(1, len(self.tags)):
            hide = self._out[e] or out[self.parents[e]]
            if not hide and self._doubt[e] == e:
                rest = total - plain[e]
                stays = plain[e] > (rest if heads[e] else MOST * rest)
                stays = self.paths[e] in won or stays and (self.tags[e] != "form" or plain[e] >= FIELD_TEXT * fields[e])
                hide = self._remark[e] or not stays
            out.append(hide)
        return out

    def _blocks(self, hidden: list[bool]) -> list[tuple[str, int, int]]:
        blocks, first = [], 0
        for end, element in self._ends:
            runs = [(t, linked) for t, e, linked in self._runs[first:end] if not hidden[e]]
            if text := " ".join(unescape("".join(t for t, _ in runs)).split()):
                blocks.append((text, sum(len(t) for t, linked in runs if linked), element))
            first = end
        return blocks

    def _sizes(self) -> dict[int, tuple[str, int, bool, int, int]]:
        """Of each container's path: tag, path of the container around it, whether an article or main is around or is it, characters in plain blocks, and in blocks of links."""
        plain, dense = ([0] * len(self.tags) for _ in range(2))
        for text, linked, element in self.blocks:
            (dense if 2 * linked > len(text) else plain)[element] += len(text)
        for e in range(len(self.tags) - 1, 0, -1):
            plain[self.parents[e]] += plain[e]
            dense[self.parents[e]] += dense[e]
        out = {}
        for e in range(1, len(self.tags)):
            if self.tags[e] in CONTAINER:
                *_, a, b = out.get(self.paths[e], (0, 0))
                above = self._nearest[self.parents[e]]
                out[self.paths[e]] = (self.tags[e], self.paths[above], self._within[e], a + plain[e], b + dense[e])
        return out

    def whole(self, path: int) -> int:
        """The path that the containers on a path stand for."""
        if self._sized is None:
            self._sized = self._sizes()
        best = here = path
        passed = []
        while best in self._sized and (above := self._sized[here][1]):
            if best == here:
                if best in self._wholes:
                    best = self._wholes[best]
                    break
                passed.append(best)
            tag, _, inside, plain, dense = self._sized[best]
            around, _, within, all_plain, all_dense = self._sized[above]
            if tag == "blockquote" or tag in PARTS and inside and within:
                best = here = above
                continue
            if tag == "main" or around == "body" and tag not in PARTS:
                break
            more, links = all_plain - plain, all_dense - dense
            if more > (0 if within else links):
                best = above
            elif links and not within:
                break
            here = above
        self._wholes.update((p, best) for p in passed)
        return best

    def scores(self) -> list[tuple[float, int]]:
        """Paths with their score, best first: a block's worth goes to what its container stands for, and half of it to what the next one further up does."""
        worth: dict[int, float] = {}
        for text, linked, element in self.blocks:
            own = (1 + text.count(",") + min(len(text) / 100, 3)) * max(0.0, 1 - linked / len(text))
            near = self._nearest[element]
            far = self._nearest[self.parents[near]] if near else 0
            for container, part in ((near, own), (far, own / 2)):
                if container and part:
                    worth[self.paths[container]] = worth.get(self.paths[container], 0.0) + part
        for path in list(worth):
            if (whole := self.whole(path)) != path:
                worth[whole] = worth.get(whole, 0.0) + worth.pop(path)
        return sorted(((w, p) for p, w in worth.items()), key=lambda x: (-x[0], x[1]))

    def text(self, path: int | None) -> str:
        """The blocks inside elements on the path; all blocks for None."""
        inside = [path is None]
        for parent, own in zip(self.parents[1:], self.paths[1:]):
            inside.append(inside[parent] or own == path)
        return "\n\n".join(text for text, _, element in self.blocks if inside[element])


def main_text(html: str, winner: str | None = None) -> str:
    """A page's text on its host's winning path, else of its own best container."""
    page = Page(html, winner)
    path = page.number(winner) if winner else None
    text = page.text(page.whole(path)) if path else ""
    if not text:
        best = page.scores()[:1]
        text = page.text(best[0][1] if best else None)
    return text


def host_of(url: Column) -> Column:
    """The host of a url, with its port; "" if there is none."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#]*)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, vote: the share of a page's best containers in the sum of their scores."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, shares = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if host and html:
                page = Page(html)
                best = page.scores()[:VOTES]
                for worth, path in best:
                    hosts.append(host)
                    paths.append(page.path(path))
                    shares.append(round(1e6 * worth / sum(w for w, _ in best)))
        return batch_of(host=pa.array(hosts, pa.string()), path=pa.array(paths, pa.string()), vote=pa.array(shares, pa.int64()))

    return map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path string, vote long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    counted = votes(pages).groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    winners = small(stored(counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))), BROADCAST_HOSTS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html or "", path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        return batch_of(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()),
                        n_chars=pa.array([len(t) for t in texts], pa.int64()))

    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return map_batches(named.join(winners, "host", "left").select("page_id", "url", "html", "path"), run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
