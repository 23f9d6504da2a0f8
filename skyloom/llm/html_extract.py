"""Operator 3, main text of web pages by a consensus of each host's pages on where it stands.

1. Each page's containers (elements that directly hold text blocks) are scored: characters of
   text outside links, in full for the nearest container and by half for each one around it.  A
   container's path is generalised: tags with their classes from the root on, digits in classes
   replaced, ids and positions left out.  A page hands each path's share of its score on.
2. Spark adds the shares up per host and path, and counts the pages that have the path.  Every
   path of two pages or more with over half a vote a page is listed: a container around another
   one, with little text of its own, gets no more than half.
3. Each page is extracted again from its container whose path has most votes a page on its host; a
   page with none of them, or only one that is a mere wrapper of the page's own best, uses that.
   What is found is widened to the article or main element
   around it; headings, leads, sections and figures that stand beside it in its parent come with it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are told by tag, class, id or role and never score or appear.  A mark in a class, id, role or form
does not hold for what wraps the page's article or main element or most of its text outside links,
nor where the page would come out empty; has-, with-, no- and layout words are no marks.  The votes of a host combine before
the shuffle; winners are broadcast only while they are at most ``BROADCAST_BYTES``, else joined in a way a skewed host is split.
On a host with over ``LISTED`` listed paths, each page is joined with those that it has instead.

Defined results: null html is empty; a page without text gives the empty text and 0; null urls
are one host; unclosed and stray tags are closed the way browsers do for blocks; repeated rows
vote and come back each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import base, written

LISTED = 64
PRIOR = 0.5  # pages without a vote that a path is given, so that few pages say less than many
BROADCAST_BYTES = 8 << 20  # of all hosts and listed paths
DEPTH = 100  # containers nested deeper than any page's layout count as the one around them
#: HTML elements by their part in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "xmp")
SKIP = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "head", "svg", "canvas", "object", "audio", "video", "map", "label", "input"} | set(RAW)
INLINE = {"button", "select", "svg", "canvas", "object", "audio", "video", "map", "label"}  # of these, what stands within a line
FORMS = {"form", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "pre", "blockquote", "figcaption", "td", "th", "tr", "tbody", "thead", "tfoot", "table", "ul", "ol", "dl", "caption", "summary", "address", "hgroup"}
CLOSES_P = BLOCK | FORMS | SKIP - {"button", "label", "input", "svg", "canvas", "object", "audio", "video", "map", "select"} | {"hr"}
_CONTAINERS = BLOCK - LEAF | {"header"}
_ROOTS = ("article", "main", "body", "html")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements, and words in a class, of parts of an article that stand beside its body.
PARTS = {"section", "figure", "header", "details"}
PART = re.compile(r"[._-](?:title|headline|heading|subtitle|lead|lede|intro|introduction|summary|abstract|dek|standfirst|content|body|text|story|article|post|entry|figure|caption|image|photo|part|chapter|section)(?:$|[._-])", re.IGNORECASE)
#: Words in a class, id or role that mark what is not the article.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|masthead|footer|sidebar\w*|side|aside|widget\w*|comments?|comment-?list|disqus|replies|responses|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|sharing|social|related|recommend\w*|pagination|pager|toolbar|skip|search|complementary|contentinfo|navigation|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Of those, what also marks a whole article element, and page headers.
OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|responses|advert\w*|sponsor\w*|promo\w*|related|recommend\w*)(?:$|[\s_-])", re.IGNORECASE)
#: What follows in a class is there or is not there inside; the class of a page's layout.
MODIFIER = re.compile(r"(?:^|[_-])(?:has|have|with|without|no)[_-].*$", re.IGNORECASE)
LAYOUT = re.compile(r"(?:^|[_-])layout(?:$|[_-])", re.IGNORECASE)
SOFT, OTHER, HIDDEN = 1, 2, 3  # marks: by name or as a form; as comment, advert or teaser; not shown
HEADER = re.compile(r"(?:^|[\s_-])(?:page|site|top|main)?-?header(?:$|[\s_-])", re.IGNORECASE)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_DELIMITER = re.compile("[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKS = {"class", "id", "role", "hidden", "aria-hidden"}
LONGEST = 64  # characters of the classes of one element in a path; longer ones are told by a checksum
_DIGITS = re.compile(r"\d+")


def host_of(url):
    """Host of a url column in lower case, without scheme, credentials, port or path."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _mark(tag: str, value: str) -> int:
    """The mark of a class, id or role; an article or main element has one only as a comment, advert or teaser."""
    if not (OTHERS if tag in _ROOTS else BOILER).search(value) and (tag in _ROOTS or not HEADER.search(value)):
        return 0
    value = " ".join(MODIFIER.sub("", x) for x in value.split() if not LAYOUT.search(x))
    if OTHERS.search(value):
        return OTHER
    return SOFT if tag not in _ROOTS and (BOILER.search(value) or HEADER.search(value)) else 0


def _named(tag: str, attrs: str) -> tuple[str, int]:
    """(generalised name of an element, its mark as no part of the article or 0)."""
    form = SOFT if tag in FORMS else 0
    if "=" not in attrs and "hidden" not in attrs:
        return tag, form
    classes, marked = "", form
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key not in _MARKS:
            continue
        if key == "hidden" or key == "aria-hidden" and value == "true":
            marked = HIDDEN
        elif key != "aria-hidden":
            marked = max(marked, _mark(tag, value))
            if key == "class":
                classes = ".".join(sorted(_DIGITS.sub("0", value).replace(">", "_").split()))
                if len(classes) > LONGEST:
                    classes = f"{classes[: LONGEST - 9]}~{zlib.crc32(classes.encode()):08x}"
    return (f"{tag}.{classes}" if classes else tag), marked


def tags(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, is an end tag) of all markup in order, in time linear in the page.

    Comments, declarations and elements of raw text come as one piece with an empty tag.  What is
    never closed is not markup, but a comment or raw text reaches to the end; a quotation mark that
    is never closed is an ordinary character.
    """
    at, n, last = 0, len(source), source.rfind(">")
    open_quotes = {'"', "'"}
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", "", False
            continue
        if start > last:
            return
        if source[start + 1] in "!?" or source.startswith("</", start) and not _NAME.match(source, start + 1):
            at = source.find(">", start) + 1
            yield start, at, "", "", False
            continue
        name = _NAME.match(source, start + 1)
        if name is None:
            at = start + 1
            continue
        end = name.end()
        while (m := _DELIMITER.search(source, end, last + 1)) and m[0] != ">":
            end = m.end()
            if m[0] in open_quotes:
                close = source.find(m[0], end)
                if close < 0:
                    open_quotes.discard(m[0])
                end = max(end, close + 1)
        if m is None:  # quotation marks hold all that could close it: from here on they are ordinary
            open_quotes.clear()
            m = re.compile(">").search(source, name.end())
        at, tag = m.end(), name[2].lower()
        if tag in _RAW_END and not name[1]:
            raw_end = _RAW_END[tag].search(source, at, max(at, last + 1))
            at = raw_end.end() if raw_end else n
            yield start, at, "", "", False
            continue
        yield start, at, tag, source[name.end() : m.start()], bool(name[1])


class Page:
    """Containers and text blocks of one page, in page order.

    blocks: (text, container, characters outside links, heading); containers: (path, parent or -1).
    """

    def __init__(self, source: str) -> None:
        self.containers: list[tuple[str, int]] = []
        self.blocks: list[tuple[str, int, int, bool]] = []
        self._marks: list[int] = []  # of each container
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, skipped
        self._part: list[str] = []
        self._plain = 0
        self._links = 0
        self._opened: Counter[str] = Counter()  # how often each tag is on the stack
        self._paths: dict[str, str] = {}
        self._open("#", "")
        at = 0
        for start, end, tag, attrs, ends in tags(source):
            if start > at:
                self._text(source[at:start])
            at = end
            if tag:
                self._close(tag) if ends else self._open(tag, attrs)
        if at < len(source):
            self._text(source[at:])
        self._flush()
        if any(self._marks):
            self._drop_marked()

    def _text(self, raw: str) -> None:
        if not self._stack[-1][2]:
            self._part.append(raw)
            if not self._links:
                self._plain += len(raw)

    def _flush(self) -> None:
        if self._part:
            text = " ".join(entities.unescape("".join(self._part)).split())
            if text:
                self.blocks.append((text, self._stack[-1][1], min(self._plain, len(text)), any(t in _HEADINGS for t, _, _ in self._stack[-4:])))
            self._part, self._plain = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag == "br" and self._part:
                self._part.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in CLOSES_P:
            self._pop_to("p", {"article", "section", "div", "td", "body", "main", "blockquote", "li"} | INLINE)
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._pop_to(tag, {"ul", "ol", "dl", "table", "tbody", "select"} | ({"tr"} if tag in ("td", "th") else set()))
        _, container, skipped = self._stack[-1] if self._stack else ("", -1, False)
        name, marked = _named(tag, attrs)
        if tag in ("html", "body"):
            marked = 0
        skip = skipped or tag in SKIP or marked == HIDDEN
        own = tag == "header" or marked == SOFT and HEADER.search(attrs) and not BOILER.search(attrs)
        if own and not skipped and marked != HIDDEN and (self._opened["article"] or self._opened["main"]):
            skip, marked = False, 0  # an article's own header holds its title
        deep = container >= 0 and self.containers[container][0].count(">") >= DEPTH
        if marked and deep:
            skip = True
        inline = tag not in BLOCK and tag not in FORMS and (tag not in SKIP or tag in INLINE)
        if marked and inline and not skip and (self._part or self._stack[-1][0] in LEAF):
            skip, marked = True, 0  # a marked part of a line goes, and the line stays one
        if inline and skip and not skipped:
            if self._part:
                self._part.append(" ")
        elif not skipped and (tag in BLOCK or skip or marked):
            self._flush()
        if not skip and (tag == "#" or (marked or tag in _CONTAINERS) and not deep):
            path = f"{self.containers[container][0]}>{name}" if container >= 0 else name
            self.containers.append((self._paths.setdefault(path, path), container))
            self._marks.append(marked)
            container = len(self.containers) - 1
        self._stack.append((tag, container, skip))
        self._opened[tag] += 1
        self._links = self._opened["a"]

    def _pop_to(self, tag: str, limits: set[str]) -> None:
        """Closes the nearest open tag unless one of limits is nearer."""
        if not self._opened[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                if not self._stack[k - 1][2]:
                    self._flush()
                self._cut(k)
                return
            if self._stack[k][0] in limits:
                return

    def _cut(self, k: int) -> None:
        for t, _, _ in self._stack[k:]:
            self._opened[t] -= 1
        self._links = self._opened["a"]
        del self._stack[k:]

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._open("br", "")
            return
        if not self._opened[tag]:
            if tag == "p":
                self._flush()
            return
        inline = tag not in BLOCK and tag not in SKIP and tag not in FORMS
        for k in range(len(self._stack) - 1, 0, -1):
            open_tag = self._stack[k][0]
            if open_tag == tag:
                apart = not inline or self._stack[-1][1] != self._stack[k - 1][1] or any(t in BLOCK or t in SKIP for t, _, _ in self._stack[k:])
                if apart and not (tag in INLINE or self._stack[k][2] and inline or self._stack[k - 1][2]):
                    self._flush()
                self._cut(k)
                return
            if inline and (open_tag in BLOCK or open_tag in SKIP or open_tag in FORMS):
                return
        if tag == "p":
            self._flush()

    def _drop_marked(self) -> None:
        """Leaves out the blocks in marked containers, except in those that wrap the article."""
        marks, n = self._marks, len(self.containers)
        under = self._under()
        text = [0] * n
        for _, c, plain, _ in self.blocks:
            if under[c] < OTHER:
                text[c] += plain
        holds, free = [False] * n, [False] * n  # an article or main element; one that no mark inside is around
        for i in range(n - 1, -1, -1):
            if not marks[i] and text[i] and self._tag(i) in ("article", "main"):
                holds[i] = free[i] = True
            parent = self.containers[i][1]
            if parent >= 0:
                text[parent] += text[i]
                holds[parent] = holds[parent] or holds[i]
                free[parent] = free[parent] or free[i] and not marks[i]
        clean = free[0]
        for i in sorted((i for i in range(n) if marks[i] == SOFT), key=lambda i: (-text[i], i)):
            up = self.containers[i][1]
            while up >= 0 and not marks[up]:
                up = self.containers[up][1]
            most = 2 * text[i] > text[0]
            if up < 0 and (holds[i] and (most or not clean) or most and not clean):
                marks[i] = 0
                clean = clean or free[i]
        under = self._under()
        for level in (0, SOFT, OTHER):
            left = [b for b in self.blocks if under[b[1]] <= level]
            if left:
                break
        self.blocks = left

    def _under(self) -> list[int]:
        """The strongest mark of each container and those around it."""
        out: list[int] = []
        for (_, parent), mark in zip(self.containers, self._marks, strict=True):
            out.append(max(mark, out[parent]) if parent >= 0 else mark)
        return out

    def scores(self) -> list[float]:
        """Score of each container."""
        out = [0.0] * len(self.containers)
        for _, container, plain, _ in self.blocks:
            value = float(plain)
            while container >= 0 and value >= 1:
                out[container] += value
                container, value = self.containers[container][1], value / 2
        return out

    def votes(self) -> dict[str, float]:
        """Share of the page's score of each path, the best of its containers."""
        scores, out = self.scores(), {}
        total = max(scores) if scores else 0.0
        if total > 0:
            for (path, _), s in zip(self.containers, scores, strict=True):
                if s > 0:
                    out[path] = max(out.get(path, 0.0), s / total)
        return out

    def text(self, winners: list[str]) -> str:
        """The blocks in the containers of the first of ``winners`` that the page has, else of its own best."""
        scores = self.scores()
        if not self.blocks:
            return ""
        have = {path for (path, _), s in zip(self.containers, scores, strict=True) if s > 0}
        path = next((p for p in winners if p in have), None)
        best = self.containers[max(range(len(scores)), key=lambda i: (scores[i], -i))][0]
        if path is None or best.startswith(f"{path}>") and best not in winners and not any(self.containers[c][0] == path for _, c, _, _ in self.blocks):
            path = best
        return self._whole([i for i, (p, _) in enumerate(self.containers) if p == path and scores[i] > 0])

    def _tag(self, i: int) -> str:
        return self.containers[i][0].rsplit(">", 1)[-1].split(".", 1)[0]

    def _whole(self, found: list[int]) -> str:
        """The blocks in the containers ``found``, in the article or main around them, and in the parts beside them."""
        roots = set()
        for i in found:
            at = {"article": -1, "main": -1}
            up = i
            while up >= 0:
                tag = self._tag(up)
                if at.get(tag, 0) < 0:
                    at[tag] = up
                up = self.containers[up][1]
            roots.add(next((k for k in at.values() if k >= 0), i))
        size, plain = [0] * len(self.containers), [0] * len(self.containers)
        for t, c, n, _ in self.blocks:
            size[c] += len(t)
            plain[c] += n
        for i in range(len(self.containers) - 1, 0, -1):
            size[self.containers[i][1]] += size[i]
            plain[self.containers[i][1]] += plain[i]
        children: dict[int, list[int]] = {}
        for i, (_, parent) in enumerate(self.containers):
            children.setdefault(parent, []).append(i)
        whole, direct, headings = set(roots), set(), set()
        for up in {self._parent_with_more(i, size) for i in roots} - {-1}:
            headings.add(up)
            if self._tag(up) not in ("body", "html", "#"):
                own = any(self._tag(i) in ("article", "main") for i in roots)
                whole.update(i for i in children[up] if 2 * plain[i] >= size[i] and (self._tag(i) == "header" if own else self._tag(i) in PARTS or PART.search(self.containers[i][0].rsplit(">", 1)[-1])))
                if not own:
                    direct.add(up)
        inside = []
        for i, (_, parent) in enumerate(self.containers):
            inside.append(i in whole or parent >= 0 and inside[parent])
        return "\n\n".join(t for t, c, n, h in self.blocks if inside[c] or c in direct and 2 * n >= len(t) or h and c in headings)

    def _parent_with_more(self, i: int, size: list[int]) -> int:
        """The nearest container around i with text beside it, or -1."""
        up = self.containers[i][1]
        while up >= 0 and size[up] == size[i]:
            up = self.containers[up][1]
        return up


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, pages) of each host: the pages' shares, added up, and how many have the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for path, share in Page(source.as_py() or "").votes().items():
                    have = total.setdefault((host, path), [0.0, 0])
                    have[0] += share
                    have[1] += 1
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([round(total[k][0], 6) for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.int64())], names=["host", "path", "votes", "pages"])

    read = base(pages, "url", "html").select(host_of(F.col("url")).alias("host"), "html")
    cast = read.mapInArrow(run, "host string, path string, votes double, pages long")
    return cast.groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(28,6)")).alias("votes"), F.sum("pages").alias("pages"))


def winners(found: DataFrame) -> DataFrame:
    """(host, path, rank): the paths with enough votes on the pages that have them, however many; least rank first."""
    support = F.col("votes").cast("double") / (F.col("pages") + PRIOR)
    return found.where((F.col("pages") >= 2) & (support > 0.5)).select("host", "path", (-support).alias("rank"))


def _listed(ranked: DataFrame, *keys: str) -> DataFrame:
    """(keys, paths): paths by rank; of equal rank the more specific first, then by name."""
    order = F.struct("rank", (-F.char_length("path")).alias("short"), "path")
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["path"]).alias("paths"))


def _own_paths(keyed: DataFrame, ranked: DataFrame) -> DataFrame:
    """(host, key, paths): of each page, the listed paths that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, k, p) for h, k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for p in Page(source.as_py() or "").votes()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "key", "path"])

    have = keyed.select("host", "key", "html").mapInArrow(run, "host string, key long, path string")
    return _listed(have.join(ranked, ["host", "path"]), "host", "key")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ranked = written(winners(votes(pages)), "winners")
    many = ranked.groupBy("host").count().where(F.col("count") > LISTED).select("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [Page(source.as_py() or "").text(paths.as_py() or []) for source, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def joined(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(lists, keys, "left").select("page_id", "url", "html", "paths")

    keyed = base(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    size = ranked.agg(F.sum(F.octet_length("path") + F.octet_length("host") + 32)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda df: df.hint("shuffle_merge")
    if many.isEmpty():
        out = joined(keyed, hint(_listed(ranked, "host")), ["host"])
    else:
        many = written(many, "hosts")
        of_many = keyed.join(hint(many), "host", "left_semi").withColumn("key", F.xxhash64("html"))
        own = written(_own_paths(of_many, ranked), "paths")
        rest = keyed.join(hint(many), "host", "left_anti")
        out = joined(rest, hint(_listed(ranked.join(hint(many), "host", "left_anti"), "host")), ["host"]).unionByName(joined(of_many, own, ["host", "key"]))
    return out.mapInArrow(run, "page_id long, url string, text string, n_chars long")
