"""HTML extraction by the consensus of a host.

Each page's containers are scored by the text that stands in them outside links, and the best one casts a vote for
its path of generalised tags, classes and ids (digits dropped, inline tags left out). Votes are counted per host in Spark; the paths with
a tenth of a host's votes or more win (ten at most). Every page is then extracted again from the winning paths of its host, the strongest
that the page has; a page that has none of them falls back to its own best container.

What surrounds an article is told by tags (a header only outside the article) and by names, which count for an element only if it is small beside the page or
neither holds the page's heading nor main element. Within an article or main element names of headings, paragraphs and list entries do not count unless they are those of adverts,
and parts of names only where most of what the element holds is links. Where pages have no article or main element, blocks that most articles of their host repeat go
from both ends of the text, up to the first and from the last one that they do not repeat: what stands within a text stays, however often it is used.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import namedtuple
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

#: Tags whose content is never text of an article.
_SKIP = "script style noscript template iframe textarea select button title svg object math canvas audio video".split()
_NOT_MAIN = frozenset("nav aside footer form dialog menu fieldset".split())
#: Tags that end a block; all others are inline.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot figcaption summary address legend ul ol dl table".split())
_VOID = frozenset("hr".split())
#: An open element of the key's kind ends where one of these begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark what surrounds an article.
_HINTS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments respond disqus cookie cookies consent footer masthead menu nav navbar navigation newsletter notice alert popup modal overlay related recommended share sharing social sidebar subscribe toolbar widget pagination pager contentinfo complementary search login signup".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_SKIP) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|</?[a-z][^>]*+>|<[!?][^>]*+>",
    re.I | re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags of the page and of the article itself, whose names are no hints.
_MAIN = frozenset("html body main article".split())
#: Names of reader comments, which may be longer than what they are about.
_REPLIES = frozenset("comment comments respond disqus".split())
#: Parts of longer names that hint at surroundings, and beginnings of names that say whether something is there.
_OTHERS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer masthead menu nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_NOT = frozenset("has hide is no not show with without".split())
#: Parts of names of an element that holds an article, whose header is the article's own.
_BODY = frozenset("article content entry hentry post story".split())
_HEADINGS = frozenset("h1".split())
#: Names that hint at adverts on any element, and tags of an article's own text.
_ADVERTS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address".split())
Block = namedtuple("Block", "path outside text free own heading")  # own: in an article or main element


@lru_cache(20000)
def _kind(tag: str, rest: str) -> tuple[str, str, bool]:
    """(generalised step of a path, what its names hint at, whether they are those of an article's element).

    Whole names hint at what is "around" an article or at "replies" to it, parts of names only at what "perhaps" is around it.
    """
    classes, hint, body, own = [], "", False, False
    if rest:
        for name, *values in _NAMES.findall(rest):
            value = "".join(values).lower()
            names = [re.sub(r"[-_]*\d+", "", w) for w in value.split()]
            body |= any(x in _BODY for w in names for x in re.split("[-_]", w))
            own |= any(w in _BODY for w in names)
            if tag not in _MAIN and any(w in _HINTS for w in names):
                hint = "replies" if hint == "replies" or any(w in _REPLIES for w in names) else "around"
            elif tag not in _MAIN and not hint:
                split = [re.split("[-_]+", w) for w in names]
                hint = "perhaps" if any(not _OTHERS.isdisjoint(x) for x in split if x[0] not in _NOT) else ""
            if name.lower() != "role":
                classes += [("#" if name.lower() == "id" else "") + re.sub(r"\d+", "", x) for x in value.split()]
    if tag in _TEXT and hint and not any(_ADVERTS & {re.sub(r"[-_]*\d+", "", w) for w in "".join(v).lower().split()} for _, *v in _NAMES.findall(rest)):
        hint = "text " + hint
    elif own and hint != "replies":
        hint = ""  # it says of itself that it is an article's
    return ".".join([tag, *sorted({x for x in classes if x})]), hint, body


class _Element:
    """An open element: its tag and step, why it may surround an article, and what it holds."""

    __slots__ = ("tag", "step", "why", "body", "inside", "free", "main", "all")

    def __init__(self, tag: str, rest: str, parents: list):
        self.tag, (self.step, hint, self.body) = tag, _kind(tag, rest)
        # in an article or main element
        self.inside = tag in ("article", "main") or any(x.inside for x in parents)
        own_header = tag == "header" and (any(x.tag in ("article", "main", "section") for x in parents) or bool(parents) and parents[-1].body)
        if hint.startswith("text "):
            hint = "" if self.inside else hint.removeprefix("text ")
        self.why = hint or ("tag" if tag in _NOT_MAIN or tag == "header" and not own_header else "")
        self.free, self.main, self.all = 0, False, 0


def read_blocks(page: str) -> list[Block]:
    """Its blocks in page order: container path, is it in something that surrounds an article, text, letters outside links, is it in an article or main element, is it a heading.

    An element with nine tenths or more of the page's text outside links does not surround the article, whatever its tag or names, unless they are
    those of reader comments; nor do forms and elements with names that hold a main element or the first heading, or only parts of such names and half of the
    text. If all text would be left out, none is.
    """
    out, parts, open_, at, linked, free = [], [], [], 0, 0, 0
    headed = False

    def end_block():
        nonlocal free
        text = " ".join("".join(parts).split())
        if text:
            letters = len(text) - text.count(" ")
            for x in open_:
                x.free, x.all = x.free + free, x.all + letters
            out.append(([x for x in open_ if x.why], Block(tuple(x.step for x in open_ if x.tag not in _LEAF), False, text, free, any(x.inside for x in open_), any(x.tag in _HEADINGS for x in open_))))
        parts.clear()
        free = 0

    def add(raw: str):
        nonlocal free
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not linked:
                free += len(text) - text.count(" ")

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            linked = 0 if m["end"] else 1
        elif tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
        elif tag in _BLOCK:
            end_block()
            if m["end"]:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i].tag == tag:
                        del open_[i:]
                        break
            else:
                linked = 0
                if open_ and open_[-1].tag == "p":  # a paragraph ends where any block begins
                    open_.pop()
                if open_ and open_[-1].tag in _ENDS and tag in _ENDS[open_[-1].tag]:
                    open_.pop()
                if tag not in _VOID:
                    if tag == "main" or tag in _HEADINGS and not headed:
                        headed |= tag in _HEADINGS and not any(x.why == "tag" and x.tag != "form" for x in open_)
                        for x in open_:
                            x.main = True
                    open_.append(_Element(tag, m["rest"], open_))
    add(page[at:])
    end_block()
    total = sum(block.free for _, block in out)

    def counts(x: _Element) -> bool:
        if x.why == "replies":
            return True
        if 10 * x.free >= 9 * total or x.why == "perhaps" and (2 * x.free >= total or x.inside and 2 * x.free > x.all):
            return False
        return not (x.main and (x.why in ("around", "perhaps") or x.tag in ("form", "fieldset", "dialog")))

    marked = [(any(counts(x) for x in around), block) for around, block in out]
    if not any(block.free and not outside for outside, block in marked):
        marked = [(any(counts(x) and x.tag in ("nav", "footer", "menu") for x in around), block) for around, block in out]
    return [block._replace(outside=outside) for outside, block in marked]


def best_path(blocks: list[Block]) -> tuple[str, ...] | None:
    """The container with most text outside links; what it holds also counts half for the container around it.

    Containers in an article or main element, or with a heading, come first if they have a tenth or more of the best one's text besides.
    """
    score: dict[tuple[str, ...], float] = {}
    strong: dict[tuple[str, ...], float] = {}
    headed = set()
    for block in blocks:
        path, free = block.path, block.free
        if not block.outside and free:
            if block.heading:
                headed.add(path)
            for p, share in ((path, free), (path[:-1], free / 2)) if path else ((path, free),):
                score[p] = score.get(p, 0) + share
                if not block.heading:
                    strong[p] = strong.get(p, 0) + share
            if block.own:
                headed.add(path)
    if not score:
        return None
    top = max(score.values())
    first = {p for p in headed if 10 * strong.get(p, 0) >= top}
    return max(first or score, key=lambda p: (score[p], p))


def extract(blocks: list[Block], winners, repeated=frozenset()) -> str:
    """The text under the first of the winning paths that this page has, else under its own best, without the blocks at its ends that the host repeats, unless these are half of it or more."""
    own: list[Block] = []
    for path in winners:
        own = [x for x in blocks if not x.outside and x.path[: len(path)] == path]
        if own:
            break
    if not own:
        path = best_path(blocks)
        own = [] if path is None else [x for x in blocks if not x.outside and x.path[: len(path)] == path]
    kept = own
    if repeated:
        unlike = [i for i, x in enumerate(own) if x.own or _mark(x) not in repeated]
        if unlike and 2 * sum(x.free for x in own[unlike[0] : unlike[-1] + 1]) > sum(x.free for x in own):
            kept = own[unlike[0] : unlike[-1] + 1]
    return "\n\n".join(x.text for x in kept)


def _mark(block: Block) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join([*block.path, "", block.text]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _votes(pages: DataFrame) -> DataFrame:
    """(host, path, mark, page) of rows (host, html): a row with the path that each page votes for, and one for each block in it outside article and main elements.

    A page is known by the longest block of its text: copies of an article, with other surroundings too, are one page.
    """

    def vote(batches):
        for b in batches:
            hosts, paths, marks, pages_ = [], [], [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = page.as_py() or ""
                blocks = read_blocks(text)
                path = best_path(blocks)
                if path is not None:
                    chosen = [x for x in blocks if not x.outside and x.path[: len(path)] == path]
                    longest = max((x.text for x in chosen), key=lambda t: (len(t), t), default="")
                    known = int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    own = {_mark(x) for x in chosen if not x.own}
                    for m in (None, *sorted(own)):
                        hosts.append(host), paths.append(" ".join(path) if m is None else None), marks.append(m), pages_.append(known)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(marks, pa.int64()), pa.array(pages_, pa.int64())], ["host", "path", "mark", "page"])

    return pages.mapInArrow(vote, "host string, path string, mark long, page long")


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of rows (host, html)."""
    return _votes(pages).where("mark is null").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winning_paths(votes: DataFrame, tenth: int = 10) -> DataFrame:
    """(host, winners): the paths with at least 1/tenth of their host's votes, most first."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    strong = votes.join(total, "host").where(F.col("votes") * tenth >= F.col("all_votes"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))  # tenth of them at most
    return strong.groupBy("host").agg(ordered.alias("x")).select("host", F.col("x.path").alias("winners"))


def repeated_blocks(votes: DataFrame, least_pages: int = 3) -> DataFrame:
    """(host, repeated): marks of the blocks that at least half of a host's different pages have, and ``least_pages`` at least, as fewer say nothing of a host; copies of a page count once."""
    marks = votes.where("mark is not null").distinct().groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    pages = votes.where("mark is null").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    return marks.join(pages, "host").where("2 * n >= n_pages").groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("repeated"))


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text (blocks joined by two line feeds, empty if there are none) and n_chars.

    What the hosts have agreed on is broadcast if it is no more than ``broadcast_bytes``; else pages are joined to it by host, those of a large
    host by several tasks. Null html is empty; pages without a host (null or odd urls) share one; rows that repeat give equal results; an
    empty table gives an empty table. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    cast = c.saved(_votes(rows.select("host", "html")), "votes")
    paths = cast.where("mark is null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    agreed = winning_paths(paths).join(repeated_blocks(cast), "host", "left")
    agreed = c.saved(agreed.join(paths.groupBy("host").agg(F.sum("votes").alias("n")), "host"), "hosts")
    size = agreed.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("winners", " ")) + 8 * F.coalesce(F.size("repeated"), F.lit(0)) + 64), F.sum("n")).first()
    told = agreed.drop("n")
    if (size[0] or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(told), "host", "left")
    else:
        joined = c.skew_join(rows, told, ["host"], agreed.select("host", "n"), size[1], ["page_id", "url"], "left")

    def work(batches):
        for b in batches:
            texts = [
                extract(read_blocks(page.as_py() or ""), [tuple(x.split(" ")) if x else () for x in paths_ or ()], frozenset(known or ()))
                for page, paths_, known in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = joined.select("page_id", "url", "html", "winners", "repeated")
    return joined.mapInArrow(work, f"page_id {dict(joined.dtypes)['page_id']}, url string, text string, n_chars long")
