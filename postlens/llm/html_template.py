"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its element paths (tags with their classes and ids, digits
left out) and its pieces of text at their paths.  Tokens that occur equally
often on each page of a host have the same occurrence vector and form an
equivalence class.  A class is valid if it is on a ``SHARE`` of the host's pages
that have elements, so empty pages, error pages and other layouts don't undo it.
Classes nest by the paths that are once on a page.  An element is of the
template if its class has other tokens too or is nearly everywhere; a text is,
inside an article as well, if it is on ``LEAST_PAGES`` pages, and its class holds
an element and is on half the pages of the class around it, or else on nearly
all of these.

Each gap below a path of the template is a slot.  The template says what is in
them: how much text that isn't its own each holds on the average page that has
it.  The main text is in the slots that hold at least half of that of the whole
page; these lie inside each other, and of them the article is taken, else the
main element, else the innermost.  So tags only choose between slots that are
as good by their text.  Out of the chosen slot go the template's texts (but
where most of it is such text the pages are copies, and it stays), and the slots
whose classes, ids or roles name furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments of readers), unless they are around the host's
largest article or main element.  Names are looked at on the template's elements
only; inside a line of text, as on a span, they count by themselves.  Furniture
that HTML has elements for is never read.  A page whose host has no template,
as it has no element, keeps all of its text.

Occurrence vectors are never brought together: a class is found by the hash of
its vector, order-free sums over pages that Spark adds up in part before any
shuffle.  Pages are parsed once, into a table in the shared folder.  A host's
template is one small row; while all of them are within ``BROADCAST`` bytes they
are sent to the tasks, beyond it pages are joined to them by host, large hosts in
parts.

Defined cases: null or empty html gives empty text; a null url or one without
a host belongs to the host ''; very long pages are read whole; repeated rows
give repeated results; an empty table gives no row; extra columns are not
read; broken markup is read as browsers do in the main (implied ends of
paragraphs and list items, unknown end tags ignored).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import scratch_path

#: A class is valid on so large a share of its host's pages that have elements; texts are of a template on so many pages.
SHARE, LEAST_PAGES = 0.1, 3
#: Texts are of the template if they are on so large a share of the pages of the class around theirs: the first where
#: their class holds an element, else the second.
HALF, NEARLY_ALL = 0.5, 0.9
#: Bytes of templates that are sent to all tasks, and pages of a host in a part of the join beyond that.
BROADCAST, PART = 64 << 20, 10_000
# FIXED VALUES — elements without an end tag, of furniture, and that begin a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav header footer aside form script style noscript template button select option textarea dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
                   "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option", "optgroup", "legend"}
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}
HOLDERS = frozenset("html body main article section div center table tbody tr td ul ol dl blockquote form fieldset".split())
SCOPES = frozenset("table ul ol dl article main body html".split())
# FIXED VALUES — whole names of furniture in classes, ids and roles; the second list doesn't count inside an article or main element
NAMES = frozenset("ad ads adv advert adverts advertisement advertising ad-banner ad-container ad-slot ad-unit ad-wrapper adsbygoogle sponsor sponsored "
                  "sponsors promo promotion promos banner banners cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice "
                  "consent consent-banner gdpr newsletter newsletter-signup subscribe subscription signup sidebar sidebars side-bar menu menus main-menu nav "
                  "navbar nav-bar navigation main-nav main-navigation site-nav site-navigation breadcrumb breadcrumbs footer site-footer page-footer "
                  "masthead site-header topbar top-bar share sharing share-buttons share-links social-links social-share social-icons "
                  "related-posts related-articles related-links related-stories recommended recommendations comments commentlist comment comment-list comments-area "
                  "comment-form disqus disqus_thread respond popup modal overlay widget widgets widget-area toolbar login complementary contentinfo "
                  "pagination pager skip-link skip-links outbrain taboola".split())
WEAK = frozenset("notice notices notification notifications alert alerts social related discussion reply replies responses search search-form copyright "
                 "header skip".split())
NOT_NAME = re.compile(r"[^a-z_-]+")


class Page(HTMLParser):
    """Blocks of text of a page outside of furniture elements, each with its path; ``starts`` counts element paths."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # each with its tag, path, the elements of furniture that own it (by their numbers) and whether it is in an article
        self.stack: list[tuple[str, str, tuple[int, ...], bool]] = []
        self.n_elements = 0
        self.starts: Counter = Counter()
        self.blocks: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.owner: tuple[str, tuple[int, ...]] | None = None
        self.feed(html)
        self.close()
        self._end_block()

    def _end_block(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text and self.owner and not self.owner[1]:
                self.blocks.append((self.owner[0], text))
        self.held, self.owner = [], None

    def _pop_to(self, tags: set[str] | frozenset, stop: frozenset) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                del self.stack[i:]
                self._end_block()
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        if tag in CLOSES_P:
            self._pop_to({"p"}, SCOPES | {"td", "th", "li", "div", "section", "blockquote"})
        if tag in ENDS_BEFORE:
            self._pop_to(ENDS_BEFORE[tag], SCOPES)
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID:
            return
        _, path, owners, inside = self.stack[-1] if self.stack else ("", "", (), False)
        label = _label(tag, attrs)
        self.n_elements += 1
        if tag in FURNITURE and not (tag == "header" and inside) or tag not in BLOCKS and _named(label, True):
            owners += (self.n_elements,)
        path = f"{path}/{label}"
        self.starts[path] += 1
        self.stack.append((tag, path, owners, inside or _main(label)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        stop = SCOPES - {tag} if tag in ("p", "li", "dt", "dd", "td", "th", "tr") else frozenset()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or any(s[0] in BLOCKS for s in self.stack[i:]):
                    self._end_block()
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1][0] in ("script", "style"):
            if not self.stack and data.strip():
                self.owner = self.owner or ("", ())
                self.held.append(data)
            return
        _, path, owners, _ = self.stack[-1]
        if self.owner is None:
            if data.isspace():
                return
            self.owner = (path, owners)
        elif self.owner[1] != owners:  # furniture inside a line of text, and back
            if owners[:len(self.owner[1])] == self.owner[1]:
                return
            self._end_block()
            self.owner = (path, owners)
        self.held.append(data)


def _label(tag: str, attrs: list) -> str:
    """The tag and the names of an element, as a step of a path."""
    given = dict(attrs)
    names = " ".join(str(given.get(k) or "") for k in ("class", "id", "role")).lower()
    return tag + "".join(f".{n}" for n in sorted({NOT_NAME.sub("", n) for n in names.split()}) if n)


def _named(label: str, inside: bool) -> bool:
    """Whether an element's names are those of furniture; ``inside`` an article or main element fewer of them are."""
    tag, *names = label.split(".")
    return tag not in ("html", "body", "main") and (
        not NAMES.isdisjoint(names) or (not inside and tag != "article" and not WEAK.isdisjoint(names)))


def _main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or "main" in names


def _token(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def host(url: Column) -> Column:
    """The host of a url in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


ELEMENTS = "array<struct<path string, token long, times int, chars long>>"
#: ``times`` is how often the same text is at the same path of the page, and 0 where it is said again.
BLOCK = "array<struct<path string, token long, times int, text string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, elements, blocks`` of each page: its element paths, how often each starts and how much text
    is at it, and its blocks of text in page order."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, elements {ELEMENTS}, blocks {BLOCK}"
    of_elements = pa.list_(pa.struct([("path", pa.string()), ("token", pa.int64()), ("times", pa.int32()), ("chars", pa.int64())]))
    of_blocks = pa.list_(pa.struct([("path", pa.string()), ("token", pa.int64()), ("times", pa.int32()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, blocks = [], []
            for html in batch.column(3).to_pylist():
                page = Page(html or "")
                size, said = Counter(), Counter(page.blocks)
                for path, text in page.blocks:
                    size[path] += len(text)
                elements.append([{"path": p, "token": _token(p, ""), "times": n, "chars": size[p]} for p, n in page.starts.items()])
                blocks.append([{"path": p, "token": _token(p, t), "times": said.pop((p, t), 0), "text": t} for p, t in page.blocks])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(elements, of_elements), pa.array(blocks, of_blocks)],
                                             ["page_id", "url", "host", "elements", "blocks"])

    return rows.mapInArrow(work, schema)


def classes(read: DataFrame) -> DataFrame:
    """The valid tokens of each host, each with the hash of its occurrence vector (its class), the pages it is on, the
    most it is on one, and the characters of text."""
    page = F.xxhash64("page_id", "url").alias("page")
    paths = read.select("host", page, F.explode("elements").alias("t")).select(
        "host", "page", "t.token", "t.path", F.lit(False).alias("words"), "t.times", "t.chars")
    texts = read.select("host", page, F.explode("blocks").alias("t")).where("t.times > 0").select(
        "host", "page", "t.token", "t.path", F.lit(True).alias("words"), "t.times", (F.length("t.text") * F.col("t.times")).cast("long").alias("chars"))
    # halves of a hash, added up: unlike an exclusive or, repeated rows don't cancel out
    one = F.xxhash64("page", "times")
    vectors = paths.unionByName(texts).groupBy("host", "token", "words").agg(
        F.sum(one.bitwiseAND(F.lit(0x7FFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(one, 33)).alias("high"), F.count(F.lit(1)).alias("pages"),
        F.max("times").alias("most"), F.sum("chars").alias("chars"), F.first("path").alias("path"))
    # pages without an element tell nothing of a template
    every = read.where(F.size("elements") > 0).groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("n_pages"))
    return vectors.where(f"not words or pages >= {LEAST_PAGES}") \
        .join(every, (F.col("host") == F.col("_h")) & (F.col("pages") >= F.lit(SHARE) * F.col("n_pages"))) \
        .select("host", "n_pages", F.xxhash64("low", "high").alias("vector"), "token", "path", "words", "most", "pages", "chars")


def _above(path: str, known) -> str:
    """The deepest of the known paths at or above a path, '' if there is none."""
    while path and path not in known:
        path = path.rpartition("/")[0]
    return path


def _step(path: str) -> str:
    return path.rpartition("/")[2]


def _around(path: str) -> Iterator[str]:
    """The paths above a path, the nearest first."""
    while path := path.rpartition("/")[0]:
        yield path


def nest(tokens: list[dict], n_pages: int) -> tuple[list[str], list[int], list[str], list[float], list[str]]:
    """A host's template from its valid tokens (vector, token, path, words, most, pages, chars): its paths, its texts,
    its slots and how much text other than its own each holds on the average page that has it, and the paths that
    furniture's names leave out."""
    vectors: dict = {}
    for t in tokens:
        vectors.setdefault((t["pages"], t["vector"]), []).append(t)
    once = {t["path"]: t["pages"] for t in tokens if not t["words"] and t["most"] == 1}
    paths, texts = set(), []
    size: Counter = Counter({t["path"]: t["chars"] for t in tokens if not t["words"]})
    for (pages, _), own in vectors.items():
        holds = any(not t["words"] and t["most"] == 1 for t in own)
        for t in own:
            if not t["words"]:
                # an element that shares its vector with no other token isn't of a template unless it is nearly everywhere
                if t["most"] == 1 and (len(own) > 1 or pages >= NEARLY_ALL * n_pages):
                    paths.add(t["path"])
                continue
            # the class of a text nests in the class of the deepest path around it that is once on a page
            around = once.get(_above(t["path"], once), n_pages)
            if pages >= (HALF if holds else NEARLY_ALL) * around:
                texts.append(t["token"])
                size[t["path"]] -= t["chars"]
    if not any(size.values()):  # nothing but copies of pages
        size = Counter({t["path"]: t["chars"] for t in tokens if not t["words"]})

    def held(left: set[str]) -> Counter:
        out: Counter = Counter()
        for path, chars in size.items():
            if not _above(path, left):
                for above in (path, *_around(path)):
                    out[above] += chars
        return out

    named = {p for p in paths if _named(_step(p), any(_main(_step(a)) for a in _around(p)))}
    whole = held(set())
    largest = max((p for p in paths if _main(_step(p)) and p not in named), key=lambda p: (whole[p], p), default="")
    left = named - set(_around(largest))
    free = held(left)
    slots = sorted((p for p in paths if _step(p).partition(".")[0] in HOLDERS and not _above(p, left) and free[p] > 0),
                   key=lambda p: (-free[p] / once[p], p))
    return sorted(paths), sorted(texts), slots, [free[p] / once[p] for p in slots], sorted(left)


TEMPLATES = "host string, pages long, paths array<string>, texts array<long>, slots array<string>, sizes array<double>, left array<string>"


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.string())
    for batch in batches:
        made = [nest(t, n) for t, n in zip(batch.column("tokens").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
        cols = [pa.array([m[i] for m in made], pa.list_(k)) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), *cols], [c.split()[0] for c in TEMPLATES.split(", ")])


def templates(read: DataFrame) -> DataFrame:
    """One row for each host with a page that has elements, from ``parsed`` pages.  A host's valid tokens are at most
    1 / SHARE times those of its mean page."""
    own = F.struct("vector", "token", "path", "words", "most", "pages", "chars")
    return classes(read).groupBy("host").agg(F.first("n_pages").alias("pages"), F.collect_list(own).alias("tokens")).mapInArrow(_nested, TEMPLATES)


def main_text(blocks: list[tuple[str, int, str]], once: set[str], texts: list[int], slots: list[str], sizes: list[float], left: list[str]) -> str:
    """The main text of one page from its blocks (path, token, text) and the paths that are once on it, under its host's
    template."""
    told, out = set(texts), set(left)
    free = [(path, text, token not in told) for path, token, text in blocks if not _above(path, out)]
    here = {p: size for p, size in zip(slots, sizes, strict=True) if p in once}
    least = HALF * max(here.values(), default=0)
    full = [p for p, size in here.items() if size >= least]
    # as good by their text: the outermost article, the outermost main element, then the innermost
    kinds = {p: 0 if _step(p).startswith("article") else 1 if _main(_step(p)) else 2 for p in full}
    for base in sorted(full, key=lambda p: (kinds[p], len(p) if kinds[p] < 2 else -len(p), p)):
        chosen = [b for b in free if b[0] == base or b[0].startswith(base + "/")]
        if any(new for *_, new in chosen):
            break
    else:
        base, chosen = "", free
    own = [text for _, text, new in chosen if new]
    # copies of a page on its host look like a template: where most of a slot or the whole of a page is repeated, it stays
    if not own or (base and _step(base).partition(".")[0] not in ("html", "body") and 2 * sum(map(len, own)) < sum(len(b[1]) for b in chosen)):
        own = [text for _, text, _ in chosen]
    return "\n\n".join(own)


def joined(read: DataFrame, made: DataFrame) -> DataFrame:
    """The parsed pages with their hosts' templates."""
    made = made.select(F.col("host").alias("_h"), "pages", "texts", "slots", "sizes", "left")
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 16)
    total = made.agg(F.sum(F.length("_h") + 64 + F.size("texts") * 8 + F.size("sizes") * 8 + chars(F.col("slots")) + chars(F.col("left")))).first()[0] or 0
    if total <= BROADCAST:
        return read.join(F.broadcast(made.drop("pages")), F.col("host") == F.col("_h"), "left")
    # the parts of a host, as many as its pages make; few hosts have more than one
    parts = F.ceil(F.col("pages") / PART).cast("int")
    large = made.where(parts > 1).select(F.col("_h").alias("_l"), parts.alias("parts"))
    read = read.join(large, F.col("host") == F.col("_l"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("int"))
    made = made.withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1)))
    return read.join(made, (F.col("host") == F.col("_h")) & (F.col("part") == F.col("_p")), "left")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "pages-parsed")
    parsed(pages).write.parquet(path)
    read = spark.read.parquet(path)
    path = scratch_path(spark, "page-templates")
    templates(read).write.parquet(path)
    once = F.transform(F.filter("elements", lambda e: e["times"] == 1), lambda e: e["path"])
    rows = joined(read, spark.read.parquet(path)).select("page_id", "url", once.alias("once"), "blocks", "texts", "slots", "sizes", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("blocks", "once", "texts", "slots", "sizes", "left")]
            out = [main_text([(b["path"], b["token"], b["text"]) for b in blocks], set(once), *(x or [] for x in made))
                   for blocks, once, *made in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(work, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
