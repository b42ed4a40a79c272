"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node has its characters, tags, link characters and link tags; its composite text
density is characters per tag, weighed down by links. A node's density sum is that of its children's densities. The node
with the greatest sum is content; the least density on its path to the body is the threshold, and every other subtree
whose density reaches it gives its own node of greatest sum. Content inside an article widens to the article.

Elements made for page furniture (nav, footer, aside and so on) are cut first, and so are blocks named for reader comments.
Other names of furniture, forms, and headers outside articles only weigh: they lower the densities of their subtrees, and
are cut if the path to the greatest sum doesn't lead through them. A heading inside an article stays, whatever it or its
box is called; a name beside one for content (`widget main-content`), or in a compound with another word
(`related-stories`), is cut only where links make up most of it. Comments without a name are told by their structure: what
stands under a heading that counts or names comments, and neighbouring blocks that each hold a link to reply. A page of
which nothing is left is read again by elements alone.

Defined results: null or empty html, or a page without text, gives ''; unclosed and stray tags are tolerated; a tag without
an end is text, and once a quote of an attribute isn't closed, tags end at the next '>'; repeated rows are extracted one by
one; other columns are ignored. Time is in proportion to the page's length, whatever it holds.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from graphloom.llm.tokens import slices

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?([a-zA-Z][^\s/>]*))")
#: What follows a tag's name, to its end; quotes count after an equals sign only.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
NAMES = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# Element names of HTML, and names that page furniture goes by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object".split())
CUT = frozenset("nav footer aside button select dialog menu head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
COMMENTS = frozenset("comment comments disqus respond".split())
FURNITURE = COMMENTS | frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs cookie cookies discussion discussions footer header masthead menu nav navbar navigation newsletter "
    "notice notices popup promo promoted related replies reply responses reviews share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: What else a compound name of page furniture holds: places, kinds of boxes, and what they list.
NEUTRAL = frozenset(
    "area article b bar block bottom box btn button buttons c col column container content fixed form group holder inner item items large left link links list main mobile module "
    "nav outer page panel pane post posts primary reader right row secondary section site small sticky slot thread top unit user wide wrap wrapper".split()
)
HEADERS = frozenset("banner header masthead".split())
CONTENT = frozenset("article body content entry main post story text".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = frozenset("li dt dd tr td th option p".split())
#: Headings of reader comments: the first words also on their own, the others with a count.
COMMENT_HEADING = re.compile(r"(?:(?:\d[\d.,]*|no|all|reader|user)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?|\d[\d.,]*\s+(?:replies|reply|responses?|reviews?|antwort(?:en)?|réponses?|respuestas?)|(?:leave|post|add) a (?:comment|reply)", re.I)
REPLY = frozenset("reply antworten répondre responder".split())

#: What a named subtree's densities come to, and how far up from its reply link a comment may begin.
NAMED_WEIGHT, REPLY_LEVELS = 0.1, 8
PLAIN, DOUBTFUL, HEADER, NAMED, COMMENT = range(5)


class Page:
    """A page's elements in page order, as lists that go together; element 0 is the page. An element's subtree are the
    elements up to its end, and its texts the pieces from `starts` to `stops`."""

    def __init__(self, by_name: bool):
        self.by_name = by_name
        self.tags, self.parents, self.ends, self.names, self.cut, self.tops = ["html"], [0], [0], [PLAIN], [False], [-1]
        self.pieces: list[str] = []
        self.owners: list[int] = []
        self.starts, self.stops = [0], [0]

    def text(self, i: int, most: int) -> str:
        """The element's text; '' if it has over `most` pieces."""
        return " ".join("".join(self.pieces[self.starts[i] : self.stops[i]]).split()) if self.stops[i] - self.starts[i] <= most else ""

    def cut_off(self, i: int) -> None:
        at, cut = i, self.cut
        while at < self.ends[i]:
            if cut[at]:
                at = self.ends[at]
            else:
                cut[at] = True
                at += 1


def named(attrs: str) -> int:
    """What the names among the attributes say: COMMENT, NAMED or HEADER if one is all words for page furniture, DOUBTFUL if
    a compound has such a word, or if another name is one for content."""
    out, content = PLAIN, False
    for value in NAMES.findall(attrs):
        for name in value.lower().strip("\"'").split():
            parts = [x for x in re.split(r"[^a-z]+", name) if x]
            if not FURNITURE.intersection(parts):
                content = content or not CONTENT.isdisjoint(parts)
            elif all(x in FURNITURE or x in NEUTRAL for x in parts):
                words = FURNITURE.intersection(parts)
                out = max(out, COMMENT if words & COMMENTS else HEADER if words <= HEADERS else NAMED)
            else:
                out = max(out, DOUBTFUL)
    return DOUBTFUL if content and out in (HEADER, NAMED) else out


def parse(page: str, by_name: bool = True) -> Page:
    out = Page(by_name)
    tags, parents, ends, names, cut, tops, pieces, owners, starts, stops = out.tags, out.parents, out.ends, out.names, out.cut, out.tops, out.pieces, out.owners, out.starts, out.stops
    stack, blocks, opened, at, quoted = [0], [0], defaultdict(list), 0, True
    search, unescape = MARKUP.search, html.unescape

    def put(piece: str) -> None:
        pieces.append(piece)
        owners.append(stack[-1])

    def close(place: int) -> None:
        while len(stack) > place:
            if tags[stack[-1]] not in INLINE:
                put(" ")
            node = stack.pop()
            blocks.pop()
            opened[tags[node]].pop()
            ends[node], stops[node] = len(tags), len(pieces)

    while m := search(page, at):
        start, kind, tag = m.start(), m[0], m[1]
        if kind in ("<!--", "<![CDATA["):
            stop = page.find("-->" if kind == "<!--" else "]]>", m.end())
            stop, attrs = (stop + 3 if stop >= 0 else len(page)), ""
        else:
            rest = REST.match(page, m.end()) if quoted and tag else None
            quoted = quoted and (rest is not None or not tag)
            stop = rest.end() if rest else page.find(">", m.end()) + 1
            if not stop:
                break  # no tag ends any more: the rest is text
            attrs = rest[1] if rest else page[m.end() : stop - 1]
        if start > at:
            put(unescape(page[at:start]))
        at = stop
        if not tag:
            continue
        tag = tag.lower()
        if kind[1] == "/":
            places = opened[tag]
            if places and (tag not in INLINE or places[-1] > blocks[-1]):  # a stray inline end doesn't close blocks
                close(places[-1])
        elif tag in ("html", "body"):
            continue
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            block = tags[stack[blocks[-1]]] if blocks[-1] else ""
            if block == tag and tag in CLOSES_SELF or block == "p" and tag in CLOSES_P:
                close(blocks[-1])
            if tag in VOID:
                put(" " if tag in ("br", "hr") else "")
                continue
            node, parent = len(tags), stack[-1]
            tags.append(tag)
            parents.append(parent)
            ends.append(0)
            starts.append(len(pieces))
            stops.append(0)
            cut.append(cut[parent] or tag in CUT)
            top = tops[parent]
            tops.append(top if top >= 0 else node if tag in ("article", "main") else -1)
            name = named(attrs) if by_name and attrs and tag not in ("main", "article") else PLAIN
            names.append(max(name, NAMED) if tag == "form" else max(name, HEADER) if tag == "header" and top < 0 else name)
            if tag in INLINE:
                blocks.append(blocks[-1])
            else:
                blocks.append(len(stack))
            stack.append(node)
            opened[tag].append(len(stack) - 1)
            if tag not in INLINE:
                put(" ")
            if attrs.rstrip().endswith("/"):
                close(len(stack) - 1)
    if at < len(page):
        put(unescape(page[at:]))
    close(1)
    ends[0], stops[0] = len(tags), len(pieces)
    return out


class Densities:
    """Counts, densities, density sums and the node of greatest sum in each subtree, without what is cut."""

    def __init__(self, page: Page):
        tags, parents, cut, n = page.tags, page.parents, page.cut, len(page.tags)
        self.page = page
        self.chars, self.inner, self.link_chars, self.link_tags = chars, inner, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        self.density, self.sums, self.best_in = density, sums, best_in = [0.0] * n, [0.0] * n, list(range(n))
        for piece, owner in zip(page.pieces, page.owners, strict=True):
            if piece != " " and not cut[owner]:
                chars[owner] += len("".join(piece.split()))
        for i in range(n - 1, 0, -1):
            if not cut[i]:
                p, link = parents[i], tags[i] == "a"
                if link:
                    link_chars[i], link_tags[i] = chars[i], inner[i]
                chars[p] += chars[i]
                inner[p] += inner[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + link
        weight = [1.0] * n
        for i in range(1, n):
            weight[i] = min(weight[parents[i]], NAMED_WEIGHT if page.names[i] >= HEADER else 1.0)
        share, log, e = link_chars[0] / max(chars[0], 1), math.log, math.e
        for i in range(n - 1, -1, -1):
            if cut[i]:
                continue
            if c := chars[i]:
                lc, t = link_chars[i], max(inner[i], 1)
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                ratio = log(max(c / max(lc, 1) * t / max(link_tags[i], 1), 1.0)) / log(base) if base > 1.0 + 1e-9 else log(max(c * t, 1.0))
                density[i] = c / t * ratio * weight[i]
            if sums[i] >= sums[best_in[i]]:  # parents come first at ties, and then the earlier child
                best_in[i] = i
            if i:
                p = parents[i]
                sums[p] += density[i]
                if best_in[p] == p or sums[best_in[i]] >= sums[best_in[p]]:
                    best_in[p] = best_in[i]

    def path(self) -> list[int]:
        """From the node of greatest sum to the page."""
        out = [self.best_in[0]]
        while out[-1]:
            out.append(self.page.parents[out[-1]])
        return out


def cut_comments(page: Page) -> None:
    """Cuts reader comments: blocks of that name, what stands under a heading of comments, and neighbours with reply links."""
    tags, parents, ends = page.tags, page.parents, page.ends
    replies, texts = defaultdict(list), [len(page.pieces)]  # texts: from each piece on, the first that isn't blank
    for k in range(len(page.pieces) - 1, -1, -1):
        texts.append(texts[-1] if not page.pieces[k] or page.pieces[k].isspace() else k)
    texts.reverse()
    for i in range(1, len(tags)):
        if page.cut[i]:
            continue
        level = HEADINGS.get(tags[i], 0)
        if level:
            if level > 1 and COMMENT_HEADING.fullmatch(page.text(i, 16).strip(" :.–-")):
                at, p = i, parents[i]
                if p and p != page.tops[i] and texts[page.starts[p]] >= page.starts[i]:
                    page.cut_off(p)
                while at < ends[p] and (at == i or not 0 < HEADINGS.get(tags[at], 0) <= level):
                    page.cut_off(at)
                    at = ends[at]
        elif page.names[i] == COMMENT:
            page.cut_off(i)
        elif tags[i] in INLINE and page.text(i, 4).lower() in REPLY:
            at = i
            for _ in range(REPLY_LEVELS):
                if at and tags[at] not in INLINE:
                    replies[parents[at], tags[at]].append(at)
                at = parents[at]
    for same in replies.values():
        if len(set(same)) > 1:
            for i in set(same):
                page.cut_off(i)


def cut_furniture(page: Page, found: Densities) -> bool:
    """Cuts named nodes off the path to the greatest sum; whether there were any."""
    path, best, any_cut = set(found.path()), found.best_in[0], False
    heads = [0]
    for tag in page.tags:
        heads.append(heads[-1] + (tag in HEADINGS))
    for i in range(1, len(page.tags)):
        name, inside = page.names[i], page.tops[i] >= 0
        if name == PLAIN or page.cut[i] or i in path:
            continue
        if name == DOUBTFUL:
            stays = 2 * found.link_chars[i] <= found.chars[i]
        elif page.tags[i] in HEADINGS:
            stays = inside or best < i < page.ends[best]
        else:
            stays = name == HEADER and inside and heads[page.ends[i]] > heads[i]
        if not stays:
            page.cut_off(i)
            any_cut = True
    return any_cut


def measured(page: Page) -> Densities:
    """The densities of what is left when furniture and comments are cut."""
    if page.by_name:
        cut_comments(page)
    found = Densities(page)
    return Densities(page) if cut_furniture(page, found) else found


def content(found: Densities) -> list[int]:
    """The content nodes, in page order, none inside another."""
    page, path = found.page, found.path()
    best, threshold, above = path[0], min(found.density[i] for i in path), set(path[1:])
    out, i = [], 0
    while i < len(page.tags):
        if page.cut[i]:
            i = page.ends[i]
        elif i and found.density[i] >= threshold and found.chars[i] and i not in above:
            out.append(i if found.sums[i] == 0 or i == best else found.best_in[i])
            i = page.ends[i]
        elif i == best:
            out.append(i)
            i = page.ends[i]
        else:
            i += 1
    return [*dict.fromkeys(page.tops[i] if page.tops[i] >= 0 else i for i in out)]


def text_of(page: Page) -> str:
    parts: list[str] = []
    for i in content(measured(page)):
        parts.append(" ")
        parts += [x for x, owner in zip(page.pieces[page.starts[i] : page.stops[i]], page.owners[page.starts[i] : page.stops[i]], strict=True) if not page.cut[owner]]
        parts.append(" ")
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    return (text_of(parse(page)) or text_of(parse(page, by_name=False))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the page's main text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, column="html"):
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array([main_text(x) for x in part["html"].to_pylist()], pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9_html_text(spark, sf_dir):
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.selectExpr("page_id", "url", "text", "cast(length(text) as long) AS n_chars")
