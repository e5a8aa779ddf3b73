"""Main text of web pages by consensus of a host's pages on the path of the container that holds it.

A page becomes arrays of elements in page order, each with its parent's number, so that all passes are loops: sums go from
the last element to the first, states from the first to the last.  Paths are numbered by parent path and step, so a page of
any depth takes memory and time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements by what they do to text.
SKIPPED = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title math audio video".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rt rp".split())
#: Elements that a tag of their own kind ends, unless one of these stands in between.
CLOSED_BY_SELF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that leave an open head open; any other, or text, ends it.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
CONTAINERS = frozenset("article main section div td body html center table tbody tr blockquote".split())
#: Words of class, id and role that name other things than the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist disqus reply replies related recommended share sharing social newsletter subscribe signup login popup modal toolbar masthead widget contentinfo complementary search".split()
)
CONTENT = frozenset("article content post entry story main body text articlebody".split())
#: Words of what belongs to an article though it is short.
LEADS = frozenset("lead intro summary abstract headline title subtitle standfirst byline caption".split())
#: Words before a name that say that the thing is not there, or that the element is laid out around it.
LAYOUT = frozenset("no not has with without is".split())
WEIGHT = {"article": 2.0, "main": 1.5, "body": 0.6, "html": 0.4, "table": 0.7, "tbody": 0.7, "tr": 0.7}
#: A host's paths that are tried on its pages in the order of votes; the least share of the page's own best score that one must reach.
VOTED_PATHS, FAIR_SHARE = 3, 0.25
#: The share of links in text beside the winner, and in what a name may drop within an article, up to which it is kept.
MOST_LINKED = 0.25
#: What ends a sentence; text beside the winner without any, such as a label, is kept from this many characters on.
ENDS, LEAST_BESIDE = tuple(".!?…:;。！？”»"), 140
#: Words of what names the writer of a comment, and its time.
WRITERS = frozenset("author user username commenter poster nickname fn avatar".split())
TIMES = frozenset("date time datetime timestamp posted published ago".split())
#: Hosts whose winning paths may be broadcast, some 300 bytes each; beyond, hosts are joined with this many salts.
MAX_BROADCAST_HOSTS, SALTS = 50_000, 64
#: A path is shown up to this length; deeper ones by their end and their hash.
SHOWN = 256

_TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that no class, id or role drops.
NEVER_BY_NAME = frozenset("html body main article".split())
#: What is no text even where nothing else is left of a page.
HIDDEN = SKIPPED - frozenset("nav footer aside form button dialog menu".split())
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)

# What is known of an element: it holds no text, is dropped by its tag, by its name, or by its name if it holds the lesser
# part of the page; it is a container; it belongs to an article; it names a writer, or a time; it is dropped by its name if
# it holds many links.
_NO_TEXT, _BY_TAG, _BY_NAME, _BY_SHARE, _CONTAINER, _LEAD, _WRITER, _TIME, _BY_LINKS = (1 << i for i in range(9))


def named(attributes: str) -> tuple[str, int]:
    """The step's generalised class (first class name without digits) and what the names say.

    A name of one word of BOILERPLATE, or one that ends in such a word, drops the element; one that only begins with it
    drops it if it holds no more than half of the page's text, and within an article only if it holds many links: a
    share-price is text, a row of share-buttons is not.  Names such as no-sidebar and whole names of CONTENT don't.
    """
    first, says, content = "", 0, False
    for key, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "class" and not first and value.split():
            first = re.sub(r"[0-9/]+", "", value.split()[0])
        for token in value.split():
            parts = _PART.findall(token)
            if not parts or parts[0] in LAYOUT and len(parts) > 1:
                continue
            whole = "".join(parts)
            says |= _WRITER * (not WRITERS.isdisjoint(parts)) | _TIME * (not TIMES.isdisjoint(parts))
            content |= whole in CONTENT
            if whole in LEADS or parts[-1] in LEADS:
                says |= _LEAD
            if whole in BOILERPLATE or parts[-1] in BOILERPLATE:
                says |= _BY_NAME
            elif not BOILERPLATE.isdisjoint(parts):
                says |= _BY_SHARE
    if content:
        says = says & ~(_BY_NAME | _BY_SHARE) | _LEAD
    return first, says


class Page:
    """The elements of a page in page order as parallel lists, and its pieces of text."""

    def __init__(self, page: str):
        self.source = page
        self.parent, self.tag, self.path, self.says, self.weight = [-1], ["#"], [0], [_CONTAINER], [WEIGHT["html"]]
        #: By number of path: the path above, the step, and a hash that is the same on all pages.
        self.above, self.step, self.hash = [-1], [""], [0]
        #: Pieces: element, from, to, begins a block, stands in a link.
        self.pieces: list[tuple[int, int, int, bool, bool]] = []
        self._read()

    def _read(self) -> None:
        page, n = self.source, len(self.source)
        parent, tag_of, path_of, says_of, weight = self.parent, self.tag, self.path, self.says, self.weight
        known: dict[tuple[int, str], int] = {}
        # The open elements; for each the nearest at or above it that is no inline element; the places of each open tag.
        stack, block_at, places = [0], [0], {}
        new_block, links, articles, at, seen_body = True, 0, 0, 0, False

        def text(start: int, end: int) -> None:
            nonlocal new_block
            if tag_of[stack[-1]] == "head" and page[start:end].strip():
                close(len(stack) - 1)
            self.pieces.append((stack[-1], start, end, new_block, links > 0))
            new_block = False

        def close(to: int) -> None:
            nonlocal links, new_block, articles
            while len(stack) > to:
                tag = tag_of[stack.pop()]
                block_at.pop()
                places[tag].pop()
                links -= tag == "a"
                articles -= tag == "article"
                new_block |= tag not in INLINE

        def last(tag: str) -> int:
            found = places.get(tag)
            return found[-1] if found else 0

        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                text(at, n)
                break
            if m.start() > at:
                text(at, m.start())
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            if m[1]:
                if place := last(tag):
                    close(place)
                else:
                    new_block |= not inline
                continue
            if tag_of[stack[-1]] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in VOID:
                new_block |= tag in ("br", "hr")
                continue
            if not inline:
                new_block = True
                if tag_of[stack[block_at[-1]]] == "p":
                    close(block_at[-1])
                if tag in CLOSED_BY_SELF and (place := last(tag)) > max(map(last, CLOSED_BY_SELF[tag])):
                    close(place)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = (page.find(">", end.end()) + 1 if end else n) or n
                continue
            if inline and m[3].endswith("/"):
                continue
            first, says = named(m[3]) if m[3].strip() else ("", 0)
            if tag in NEVER_BY_NAME:
                says &= ~(_BY_NAME | _BY_SHARE)
            if articles and says & _BY_SHARE:
                says = says & ~_BY_SHARE | _BY_LINKS
            if tag == "time":
                says |= _TIME
            if tag == "article" and articles:
                says |= _BY_SHARE  # an article within an article is a comment, unless it is most of the page
            if tag in HIDDEN:
                says |= _NO_TEXT
            if tag in SKIPPED or tag == "header" and not articles:
                says |= _BY_TAG
            if tag in CONTAINERS:
                says |= _CONTAINER
            if tag in ("h1", "h2"):
                says |= _LEAD
            step = f"{tag}.{first}" if first else tag
            above = path_of[stack[-1]]
            path = known.get((above, step))
            if path is None:
                path = known[above, step] = len(self.step)
                self.above.append(above)
                self.step.append(step)
                self.hash.append(xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), self.hash[above]))
            parent.append(stack[-1])
            tag_of.append(tag)
            path_of.append(path)
            says_of.append(says)
            weight.append(WEIGHT.get(tag, 1.0) * (1.25 if says & _LEAD and says & _CONTAINER else 1.0))
            seen_body |= tag == "body"
            stack.append(len(parent) - 1)
            block_at.append(block_at[-1] if inline else len(stack) - 1)
            places.setdefault(tag, []).append(len(stack) - 1)
            links += tag == "a"
            articles += tag == "article"
        if not seen_body:  # the tags may be left out: html stands for body, and the root for html
            weight[next((i for i, t in enumerate(tag_of) if t == "html"), 0)] = WEIGHT["body"]

    def _sums(self, own: list[int]) -> list[int]:
        for i in range(len(own) - 1, 0, -1):
            own[self.parent[i]] += own[i]
        return own

    def _dropped(self, mask: int) -> list[bool]:
        out = [bool(self.says[0] & mask)]
        for i in range(1, len(self.parent)):
            out.append(out[self.parent[i]] or bool(self.says[i] & mask))
        return out

    def weigh(self) -> None:
        """Which elements are dropped, and the characters and linked characters below each of the others.

        A page of which nothing is left is weighed again with less taken for boilerplate.
        """
        count = len(self.parent)
        sizes = [(e, (z - a) - self.source.count(" ", a, z) - self.source.count("\n", a, z), linked) for e, a, z, _, linked in self.pieces]
        for mask in (_NO_TEXT | _BY_TAG | _BY_NAME, _NO_TEXT | _BY_TAG, _NO_TEXT):
            dropped = self._dropped(mask)
            for again in (True, False):
                chars, linked_chars = [0] * count, [0] * count
                for e, size, linked in sizes:
                    if not dropped[e]:
                        chars[e] += size
                        if linked:
                            linked_chars[e] += size
                self._sums(chars)
                if not (again and mask & _BY_NAME):
                    break
                # A name that says less drops what holds the lesser part of the page, or many links.
                less = [bool(s & _BY_SHARE) and 2 * c <= chars[0] for s, c in zip(self.says, chars)]
                if any(s & _BY_LINKS for s in self.says):
                    own = self._sums(list(linked_chars))
                    less = [x or bool(s & _BY_LINKS) and own[i] > MOST_LINKED * chars[i] for i, (x, s) in enumerate(zip(less, self.says))]
                for i in self._comments(dropped, chars):
                    less[i] = True
                if True not in less:
                    break
                for i in range(1, count):
                    less[i] = less[i] or less[self.parent[i]]
                dropped = [a or b for a, b in zip(dropped, less)]
            if chars[0]:
                break
        self.dropped, self.chars, self.linked = dropped, chars, self._sums(linked_chars)

    def _comments(self, dropped: list[bool], chars: list[int]) -> list[int]:
        """Elements that look like readers' comments, whatever they are called: siblings of one step, two or more, each with a
        writer and a time below it, that hold the lesser part of the page together."""
        if not any(s & _WRITER for s in self.says):
            return []
        writers, times = (self._sums([int(bool(s & flag) and not d) for s, d in zip(self.says, dropped)]) for flag in (_WRITER, _TIME))
        alike: dict[tuple[int, int], list[int]] = {}
        for i in range(1, len(self.parent)):
            if writers[i] and times[i] and self.tag[i] not in INLINE and self.tag[i] not in NEVER_BY_NAME - {"article"}:
                alike.setdefault((self.parent[i], self.path[i]), []).append(i)
        return [i for group in alike.values() if len(group) > 1 and 2 * sum(chars[i] for i in group) <= chars[0] for i in group]

    def scores(self) -> dict[int, float]:
        """The best score of each path of a container: characters below it, less those of links, by the tag's weight."""
        self.weigh()
        found: dict[int, float] = {}
        for i, says in enumerate(self.says):
            if says & _CONTAINER and not self.dropped[i] and self.chars[i]:
                score = (self.chars[i] - self.linked[i]) * self.weight[i]
                if score > found.get(self.path[i], -1.0):
                    found[self.path[i]] = score
        return found

    def shown(self, path: int) -> str:
        steps, length, at = [], 0, path
        while at > 0:
            if length > SHOWN:
                return "~" + format(self.hash[path], "x") + "/" + "/".join(reversed(steps))
            steps.append(self.step[at])
            length += len(self.step[at]) + 1
            at = self.above[at]
        return "/" + "/".join(reversed(steps)) if steps else "/"

    def text_under(self, path: int | None) -> str:
        """The text below the elements of the path, and what stands beside them in the article.

        Beside them: within the article or main element around the first of them, or else within the page, text that
        stands in an element around them with no container of its own, and other containers with few links that hold a
        sentence, however short, a heading or much text.  Blocks made of links and copyright lines do not count.  If the whole
        body won, what stands in it is beside nothing: any container with few links is kept.
        """
        count, top = len(self.parent), 0
        won = [path is not None and self.path[i] == path and bool(self.says[i] & _CONTAINER) and not self.dropped[i] for i in range(count)]
        around = [False] * count
        if any(won):
            at = won.index(True)
            line = []
            while at >= 0:
                line.append(at)
                at = self.parent[at]
            top = next((i for tag in ("article", "main") for i in line if self.tag[i] == tag), 0)
            for i in range(count - 1, 0, -1):
                if (won[i] or around[i]) and i != top:
                    around[self.parent[i]] = True
        lead = self._sums([int(bool(s & _LEAD) and not d) for s, d in zip(self.says, self.dropped)])
        whole = any(won[i] for i in range(count) if self.tag[i] in ("#", "html", "body"))
        sentences = [0] * count
        for e, a, z, _, linked in self.pieces:
            sentences[e] += not linked and not self.dropped[e] and self.source[a:z].rstrip().endswith(ENDS)
        self._sums(sentences)
        # 0: out, 1: in, 2: around the winners, 3: loose text within what is around them.
        state = [0] * count
        for i in range(count):
            above = state[self.parent[i]] if i else 0
            if self.dropped[i]:
                continue
            if won[i] and self.tag[i] in ("#", "html", "body"):
                state[i] = 2
            elif won[i] or above == 1 or path is None:
                state[i] = 1
            elif around[i] and (above == 2 or i == top):
                state[i] = 2
            elif above in (2, 3):
                if self.says[i] & _CONTAINER:
                    free = self.chars[i] - self.linked[i]
                    state[i] = 1 if free and self.linked[i] <= MOST_LINKED * self.chars[i] and (whole or free >= LEAST_BESIDE or lead[i] or sentences[i]) else 0
                else:
                    state[i] = 3
        blocks: list[tuple[list[str], bool, int]] = []
        fresh, parts, sure, plain = True, [], False, 0

        def done() -> None:
            if parts:
                blocks.append((list(parts), sure, plain))

        for e, a, z, new, linked in self.pieces:
            fresh |= new
            if not state[e]:
                continue
            if fresh:
                done()
                parts, sure, plain, fresh = [], False, 0, False
            data = html.unescape(self.source[a:z])
            parts.append(data)
            sure |= state[e] == 1
            plain += len(data.strip()) * (-1 if linked else 1)
        done()
        out = []
        for own, certain, free in blocks:
            said = _BLANK.sub(" ", "".join(own)).strip()
            if said and (certain or free > 0 and not _COPYRIGHT.match(said)):
                out.append(said)
        return " ".join(out)


def best_path(found: dict[int, float]) -> int | None:
    """The path of the greatest score; of equal ones the one that begins last in the page."""
    return max(found, key=lambda p: (found[p], p)) if found else None


def extract(page: str | None, voted: Sequence[int] = ()) -> str:
    return extract_with_path(page, voted)[0]


def extract_with_path(page: str | None, voted: Sequence[int] = ()) -> tuple[str, str | None]:
    """The text by the first voted path (their hashes) that has a fair share of the best score, or by the page's own best, and the path taken."""
    if not page:
        return "", None
    read = Page(page)
    found = read.scores()
    best = best_path(found)
    own = {read.hash[p]: p for p in found}
    path = next((own[v] for v in voted if v in own and found[own[v]] >= FAIR_SHARE * found[best]), best)
    return read.text_under(path), None if path is None else read.shown(path)


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def votes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path_hash, path, votes, score): how many pages of a host have the path as their best container, summed within tasks first.

    Pages without a host have no vote.  Hashes of paths are those of ``Page``, so that pages find them again without
    building their paths as texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, int, str], list[int]] = {}
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html")):
                if not (name := host(url)) or not (source := page.as_py()):
                    continue
                read = Page(source)
                found = read.scores()
                if (path := best_path(found)) is not None:
                    t = tally.setdefault((name, _signed(read.hash[path]), read.shown(path)), [0, 0])
                    t[0] += 1
                    t[1] += int(found[path])
            rows = [(*key, v, s) for key, (v, s) in tally.items()]
            h, k, p, v, s = zip(*rows) if rows else ((), (), (), (), ())
            columns = [pa.array(h, pa.string()), pa.array(k, pa.int64()), pa.array(p, pa.string()), pa.array(v, pa.int64()), pa.array(s, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path_hash", "path", "votes", "score"])

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    voted = rows.mapInArrow(run, "host string, path_hash bigint, path string, votes bigint, score bigint")
    return voted.groupBy("host", "path_hash").agg(F.max("path").alias("path"), F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winning_paths(tallied: DataFrame) -> DataFrame:
    """(host, winner): the hashes of at most VOTED_PATHS paths of each host by votes, score and path, from the result of ``votes``."""
    left, voted = table(tallied, "host-votes"), None
    for rank in range(VOTED_PATHS):
        best = left.groupBy("host").agg(F.max(F.struct("votes", "score", "path", "path_hash"))["path_hash"].alias("path_hash"))
        best = table(best.withColumn("rank", F.lit(rank)), "host-paths")
        voted = best if voted is None else voted.union(best)
        left = left.join(best, ["host", "path_hash"], "left_anti")
    return table(voted.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path_hash")))["path_hash"].alias("winner")), "host-winners")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, path), one row for each row of ``pages``.

    Null and empty pages have an empty text and a null path; a page without a host goes by its own best container; ties
    in votes go to the greater score, then the later path.  Markup that is cut off or not closed is read as far as it
    goes, at any depth.  Repeated rows each vote.  An empty table gives no rows.  Up to MAX_BROADCAST_HOSTS hosts' paths
    are broadcast; more are joined on host and salt, so that a hot host is spread over SALTS tasks.
    """
    winners = winning_paths(votes(pages, id_col, url_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract_with_path(page.as_py(), [x & (1 << 64) - 1 for x in w or ()]) for page, w in zip(batch.column("html"), batch.column("winner").to_pylist())]
            texts, paths = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "path"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)))
    if winners.count() <= MAX_BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "winner").mapInArrow(run, "page_id bigint, url string, text string, path string")
