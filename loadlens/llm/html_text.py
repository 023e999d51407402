"""Main text of web pages by paths that the pages of a host agree on."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import session
from loadlens.llm.url_rules import url_parts

# Elements whose content is never main text.
DROPPED = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video "
    "nav footer aside form fieldset button select option textarea input label dialog menu map "
    "noframes frameset applet datalist".split()
)
# Elements that hold raw text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr basefont frame".split()
)
# Elements that begin and end a block of text.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address details summary center hgroup "
    "header hr search".split()
)
# Elements that may be the container of a page's main text.
CONTAINER = frozenset("body main article section div td center blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element that opens ends an open one of these before it.
ENDS = {
    "p": frozenset({"p"}),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
SCOPES = frozenset("ul ol dl table article section main body html td th div blockquote".split())
# Words of class, id and role that mark what is not main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor "
    "sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert "
    "alerts popup popups modal overlay newsletter subscribe subscription signup login menu menus "
    "nav navbar navigation navigations breadcrumb breadcrumbs crumbs sidebar sidebars sidebox "
    "footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies "
    "respond responses discussion share sharing social related recommended recommendations "
    "widget widgets pagination pager paging skip hidden outbrain taboola complementary "
    "contentinfo search dialog form".split()
)
# Of these, the words of elements that often hold articles of their own.
CARDS = frozenset(
    "comment comments commentlist disqus reply replies respond responses discussion related "
    "recommended recommendations promo promos outbrain taboola".split()
)
# In one class name, words after the first say what the element has; the second void the name.
HAVING = frozenset("has with without no open overflow".split())
STATES = frozenset("open opened closed enabled disabled".split())
# A marked element is kept if it holds more than MOST of the page's good text; more than
# NEARLY_ALL if the page has an article or main element elsewhere, or one around a card. A card
# beside an article or main element goes.
MOST, NEARLY_ALL = 0.5, 0.8
LANDMARKS = ("main", "article", "h1")
# Elements whose class names may say anything: they hold the page or the article.
TRUSTED = frozenset("html body main article".split()) | HEADINGS

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CUT_OFF = re.compile(r"<[a-zA-Z/!][^>]*\Z")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# A block outside articles is repeated if it stands on this many rows of its host and on this
# share of them; on a page that mostly consists of such blocks, a copy, none counts as repeated.
REPEATED_ROWS, REPEATED_SHARE, COPY_SHARE = 3, 0.3, 0.5
# A path is a host's if this many of its pages vote for it, and this share of them.
PATH_VOTES, PATH_SHARE = 2, 0.02
# Text that stands so often on a page does not speak against a path of the host without it.
PAGE_REPEATS = 3
# Containers that are left out of a text when all their blocks are noise.
LEFT_OUT = frozenset("div section".split())


# Steps of a path that are written out; above them a digest stands for the rest.
WRITTEN_STEPS = 32


@dataclass
class Container:
    """A container on a page: its generalised path, and the container around it."""

    path: str
    depth: int
    parent: int
    score: int = 0


@dataclass
class Element:
    """An open element, the container its text belongs to, and whether text is dropped."""

    tag: str
    container: int
    path: str
    depth: int
    dropped: bool
    link: bool
    mark: int = 0
    landmark: int = 0


@dataclass
class Mark:
    """An element that class words mark as noise (the first one stands for the page itself)."""

    parent: int
    card: bool = False
    articles: int = 0  # article and main elements around it
    score: int = 0  # good text, first its own, then with that of the marks inside
    own: Counter = field(default_factory=Counter)  # landmarks in no mark inside
    held: Counter = field(default_factory=Counter)
    kept: bool = True


@dataclass
class Landmark:
    """A main, article or h1 element, and the mark and the landmark around it."""

    tag: str
    mark: int
    parent: int
    chars: int = 0


@dataclass
class Block:
    """Text between two block boundaries, and its innermost container."""

    container: int
    in_article: bool = False
    title: bool = False
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    marked: list[tuple[int, int, bool]] = field(default_factory=list)  # part, mark, in a link

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def score(self) -> int:
        """Length of good text: 0 for blocks of links, unless they are a title."""
        return self.chars if self.title else max(0, self.chars - 2 * self.link_chars)

    def digest(self) -> int:
        own = hashlib.blake2b(self.text().encode("utf-8", "replace"), digest_size=8)
        return int.from_bytes(own.digest(), "big", signed=True)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {
        m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)
    }


def _words(attributes: dict[str, str]) -> set[str]:
    named = " ".join(attributes.get(a, "") for a in ("class", "id", "role"))
    words = {w.lower() for w in WORD.findall(named)}
    if HAVING.isdisjoint(words) and STATES.isdisjoint(words):
        return words
    told: set[str] = set()
    for name in named.split():
        own = [w.lower() for w in WORD.findall(name)]
        if STATES.isdisjoint(own):
            told.update(own[: next((i for i, w in enumerate(own) if w in HAVING), len(own))])
    return told


def generalise(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes of one path step, each run of digits as `#`, classes in order."""
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _step(path: str, depth: int, step: str) -> str:
    """A path one step longer, of bounded length however deep it is."""
    if depth and depth % WRITTEN_STEPS == 0:
        path = "#" + hashlib.blake2b(path.encode(), digest_size=8).hexdigest()
    return f"{path}/{step}" if path else step


def _is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return bool(HIDDEN.search(attributes.get("style", "")))


def _noise_words(tag: str, attributes: dict[str, str], in_article: bool) -> frozenset[str]:
    if not attributes or tag in TRUSTED:
        return frozenset()
    return (NOISE - {"header"} if in_article else NOISE) & _words(attributes)


def _judge(blocks: list[Block], marks: list[Mark], landmarks: list[Landmark]) -> list[Block]:
    """Blocks without the text of marked elements, but for those that hold the page's content.

    A marked element is kept if it holds main, article or h1 elements and the page has none
    elsewhere (but in marked elements beside it), or most of the page's good text.
    """
    for one in reversed(landmarks[1:]):
        landmarks[one.parent].chars += one.chars
        if one.chars:
            marks[one.mark].own[one.tag] += 1
    total = 0
    for block in blocks:
        total += block.score()
        scores: Counter = Counter()
        for part, mark, link in block.marked:
            text = block.parts[part]
            length = len(text) - text.count(" ")
            scores[mark] += -length if link and not block.title else length
        for mark, score in scores.items():
            marks[mark].score += max(0, score)
            total += max(0, score)
    for one in marks:
        one.held = Counter(one.own)
    for one in reversed(marks[1:]):
        marks[one.parent].score += one.score
        marks[one.parent].held.update(one.held)
    free = [Counter()]  # landmarks around each mark, and those beside it that are not marked
    for one in marks[1:]:
        around = marks[one.parent]
        around_free = free[one.parent] + around.own
        free.append(around_free)
        if not around.kept:
            one.kept = False
            continue
        elsewhere = around_free["main"] + around_free["article"] - one.articles > 0
        part = NEARLY_ALL if elsewhere or (one.card and one.articles) else MOST
        one.kept = (
            any(one.held[tag] and not around_free[tag] for tag in ("main", "h1"))
            or (one.held["article"] > 0 and not one.card and not elsewhere)
            or (one.score > part * total and not (one.card and elsewhere))
        )
    for block in blocks:
        for part, mark, link in block.marked:
            text = block.parts[part]
            if marks[mark].kept:
                length = len(text) - text.count(" ")
                block.chars += length
                block.link_chars += length if link else 0
            else:
                block.parts[part] = ""
    return [b for b in blocks if any(b.parts)]


def parse(page: str) -> tuple[list[Block], list[Container]]:
    """Blocks of a page that are not dropped, in page order, and the page's containers.

    Takes any text: tags that are not closed, closed twice or cut off at the end do no harm.
    """
    blocks: list[Block] = []
    containers = [Container("", 0, -1)]
    root = Element("", 0, "", 0, False, False)
    stack: list[Element] = []
    marks = [Mark(-1)]
    landmarks = [Landmark("", 0, -1)]
    articles = 0
    current = Block(0)
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal current
        if current.parts:
            blocks.append(current)
        here = stack[-1] if stack else root
        current = Block(here.container, articles > 0, here.tag == "h1")

    def pop(down_to: int) -> None:
        nonlocal articles
        while len(stack) > down_to:
            articles -= stack.pop().tag in ("article", "main")

    def add(text: str) -> None:
        here = stack[-1] if stack else root
        if text and not here.dropped:
            told = html.unescape(text) if "&" in text else text
            current.parts.append(told)
            length = len(told) - told.count(" ")
            landmarks[here.landmark].chars += length
            if here.mark:
                current.marked.append((len(current.parts) - 1, here.mark, here.link))
                return
            current.chars += length
            if here.link:
                current.link_chars += length

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            # A tag that the end of the page cuts off is markup.
            cut = CUT_OFF.search(rest)
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        block = tag in BLOCK or tag in DROPPED
        if closing:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag == tag:
                    pop(place)
                    break
                if stack[place].tag in SCOPES and not block:
                    break  # an inline end tag doesn't close a block
            if block:
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if block:
            ended = ENDS.get(tag, ENDS["p"])
            for place in range(len(stack) - 1, -1, -1):
                if stack[place].tag in ended:
                    pop(place)
                    break
                if stack[place].tag in SCOPES:
                    break
        attributes = _attributes(found[3])
        parent = stack[-1] if stack else root
        path, depth, container = parent.path, parent.depth, parent.container
        if block:
            path = _step(path, depth, generalise(tag, attributes))
            depth += 1
        if tag in CONTAINER:
            containers.append(Container(path, depth, container))
            container = len(containers) - 1
        dropped = parent.dropped or _is_dropped(tag, attributes, articles > 0)
        mark, landmark = parent.mark, parent.landmark
        if not dropped and (words := _noise_words(tag, attributes, articles > 0)):
            marks.append(Mark(mark, not CARDS.isdisjoint(words), articles))
            mark = len(marks) - 1
        if not dropped and tag in LANDMARKS:
            landmarks.append(Landmark(tag, mark, landmark))
            landmark = len(landmarks) - 1
        link = parent.link or tag == "a"
        stack.append(Element(tag, container, path, depth, dropped, link, mark, landmark))
        articles += tag in ("article", "main")
        if block:
            flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            pop(len(stack) - 1)
    flush()
    if len(marks) > 1:
        blocks = _judge(blocks, marks, landmarks)
    return blocks, containers


def good_scores(blocks: list[Block], repeated: frozenset[int] = frozenset()) -> list[int]:
    """Length of each block's good text: none in blocks of links, or repeated on the host."""
    scores = [b.score() for b in blocks]
    if not repeated:
        return scores
    left = [
        n if not n or b.in_article or b.digest() not in repeated else 0
        for b, n in zip(blocks, scores)
    ]
    return left if sum(left) >= (1 - COPY_SHARE) * sum(scores) else scores


def summed(blocks: list[Block], containers: list[Container], scores: list[int]) -> int:
    """Set the good text inside every container; return that of the page."""
    for one in containers:
        one.score = 0
    for block, score in zip(blocks, scores):
        containers[block.container].score += score
    for one in reversed(containers[1:]):  # what lies inside comes after what is around it
        containers[one.parent].score += one.score
    return containers[0].score


def best_path(
    blocks: list[Block], containers: list[Container], repeated: frozenset[int] = frozenset()
) -> str | None:
    """Deepest path that holds all good text of a page; None if only the page itself does."""
    total = summed(blocks, containers, good_scores(blocks, repeated))
    scores: dict[tuple[int, str], int] = {}
    for one in containers[1:]:
        key = (one.depth, one.path)
        scores[key] = scores.get(key, 0) + one.score
    return max((k for k, n in scores.items() if n and n == total), default=(0, None))[1]


def text_under(
    blocks: list[Block],
    containers: list[Container],
    path: str | None,
    repeated: frozenset[int] = frozenset(),
) -> str:
    """Texts of the blocks under a path, joined by line ends; of all blocks without a path.

    A div or section outside articles that holds blocks but no good text is left out, unless the
    page has no good text at all.
    """
    total = summed(blocks, containers, good_scores(blocks, repeated))
    inside, out = [path is None], [False]
    for one in containers[1:]:
        inside.append(inside[one.parent] or one.path == path)
        noise = total and not one.score and one.path.rpartition("/")[2].partition(".")[0] in LEFT_OUT
        out.append(bool(noise) or out[one.parent])
    return "\n".join(
        t
        for t in (
            b.text()
            for b in blocks
            if inside[b.container] and (b.in_article or not out[b.container])
        )
        if t
    )


def host_path(
    blocks: list[Block],
    containers: list[Container],
    paths: Sequence[str],
    repeated: frozenset[int] = frozenset(),
) -> str | None:
    """Deepest of a host's paths that holds all good text of a page, None if none does.

    Only text that stands PAGE_REPEATS times on the page or more may be outside of it.
    """
    found = {one.path for one in containers[1:]}.intersection(paths)
    if not found:
        return None
    texts = [b.text() for b in blocks]
    times = Counter(texts)
    scores = [
        n if times[t] < PAGE_REPEATS else 0 for t, n in zip(texts, good_scores(blocks, repeated))
    ]
    total = summed(blocks, containers, scores)
    held: dict[tuple[int, str], int] = {}
    for one in containers[1:]:
        if one.path in found:
            key = (one.depth, one.path)
            held[key] = held.get(key, 0) + one.score
    return max((k for k, n in held.items() if n and n == total), default=(0, None))[1]


def extract(
    page: str, paths: Sequence[str] | str | None, repeated: frozenset[int] = frozenset()
) -> tuple[str, bool]:
    """Main text by a path of the host, or by the page's own where the host's lose good text."""
    blocks, containers = parse(page)
    paths = (paths,) if isinstance(paths, str) else paths or ()
    agreed = host_path(blocks, containers, paths, repeated)
    path = agreed or best_path(blocks, containers, repeated)
    return text_under(blocks, containers, path, repeated), agreed is not None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct blocks of good text outside articles; one row without a digest per page."""
    for batch in batches:
        hosts, digests = [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            blocks, _ = parse(page.as_py() or "")
            own = {b.digest() for b in blocks if not b.in_article and b.score()}
            hosts += [host] * (len(own) + 1)
            digests += [None, *own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(digests, pa.int64())], names=["host", "digest"]
        )


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = [], []
        known = batch.column("repeated").to_pylist()
        for host, page, repeated in zip(batch.column("host"), batch.column("html"), known):
            path = best_path(*parse(page.as_py() or ""), frozenset(repeated or ()))
            if path is not None:
                hosts.append(host.as_py())
                paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"]
        )


def _extract(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, agreed = [], []
            told = zip(batch.column("paths").to_pylist(), batch.column("repeated").to_pylist())
            for page, (paths, repeated) in zip(batch.column("html"), told):
                text, by_host = extract(page.as_py() or "", paths, frozenset(repeated or ()))
                texts.append(text)
                agreed.append(by_host)
            columns = [*(batch.column(c) for c in keep), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(agreed, pa.bool_())], names=[*keep, "text", "by_host"]
            )

    return run


def host_of(url: Column) -> Column:
    """Host of a URL, empty for null or without `://`."""
    return url_parts(url)[0]


def repeated_blocks(pages: DataFrame) -> DataFrame:
    """host and repeated: digests of the blocks outside articles that many of its pages have.

    A host has at most 1 / REPEATED_SHARE times as many as its pages have blocks on average.
    Pages without a host tell nothing about each other.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    counts = rows.mapInArrow(_digests, "host string, digest long").groupBy("host", "digest").count()
    told = counts.where(F.col("digest").isNull() | (F.col("count") >= REPEATED_ROWS))
    told = session.materialise(told, "block-counts")
    hosts = told.where("digest is null").select("host", F.col("count").alias("n"))
    often = told.where("digest is not null").join(hosts, "host")
    often = often.where(F.col("count") >= REPEATED_SHARE * F.col("n"))
    return often.groupBy("host").agg(F.collect_list("digest").alias("repeated"))


def winning_paths(pages: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """host, winner and paths: the container paths that the pages of a host vote for.

    Each page votes once, for the smallest container that holds all its good text (see
    `best_path`): text that is not dropped, not links, and not repeated on the host. `winner` has
    most votes; of equal votes the deeper path wins, then the later one by code point. `paths` has
    the winner and every path with enough votes, at most 1 / PATH_SHARE and one. Pages without a
    host agree on nothing. Votes are counted before they move, whatever share of the pages a host
    has.
    """
    if repeated is None:
        repeated = repeated_blocks(pages)
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    rows = rows.join(repeated, "host", "left")
    votes = rows.mapInArrow(_vote, "host string, path string").groupBy("host", "path").count()
    votes = session.materialise(votes, "path-votes")
    depth = F.size(F.split("path", "/"))
    hosts = votes.groupBy("host").agg(
        F.max_by("path", F.struct("count", depth, F.col("path"))).alias("winner"),
        F.sum("count").alias("n"),
    )
    often = votes.where(F.col("count") >= PATH_VOTES).join(hosts, "host")
    often = often.where(F.col("count") >= PATH_SHARE * F.col("n"))
    often = often.groupBy("host").agg(F.collect_list("path").alias("often"))
    paths = F.array_union(F.array("winner"), F.coalesce("often", F.array().cast("array<string>")))
    return hosts.join(often, "host", "left").select("host", "winner", paths.alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and by_host (whether a path of the host led to the text) of every page.

    Three passes over the pages: the first finds blocks that a host's pages repeat, the second
    votes on container paths per host, the third takes the text under the deepest path of the
    host that holds all good text of the page, else under the page's own.
    Character references are decoded, white space inside a
    block is one space, blocks are trimmed and joined by one line end, empty ones left out.

    Null and empty html give an empty text, as do pages without text outside dropped parts. A
    null URL, or one without `://`, has no host, and its page stands for itself. Repeated rows vote and are
    extracted each; an empty table gives no row; other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")
    repeated = session.materialise(repeated_blocks(rows), "repeated-blocks")
    hosts = winning_paths(rows, repeated).join(repeated, "host", "full")
    hosts = session.materialise(hosts.withColumnRenamed("host", "of_host"), "winning-paths")
    joined = rows.join(hosts, host_of(F.col("url")) == F.col("of_host"), "left")
    fields = {f.name: f for f in rows.schema}
    schema = T.StructType(
        [
            fields["page_id"],
            fields["url"],
            T.StructField("text", T.StringType()),
            T.StructField("by_host", T.BooleanType()),
        ]
    )
    return joined.mapInArrow(_extract(["page_id", "url"]), schema)
