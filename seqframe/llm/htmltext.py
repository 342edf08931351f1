"""Main text of web pages by equivalence-class template deduction.

Tokens are the structural tags of a page, told apart by their place (the path of open block
elements with class or id), and its blocks of text, told apart by place and text.  Tokens of
one host whose counts agree on every one of its pages (equal occurrence vectors) form an
equivalence class.  A class is valid if it holds a structural tag, at least MIN_PAGES
pages and at least SUPPORT of the host's pages with text hold it, and these do not all read the
same.  An element is an opening and a closing tag there.  A class is ordered: its tokens come in one order, again and
again, on all pages; of a class that does not, the tokens that keep their place stay together and each other one is a class
of its own.  Classes are nested: all occurrences of one lie outside the other, or in the same slot of it, the room
between two of its tokens; of two that are not, the one that fewer pages hold is broken into its elements and texts, and those
that do not nest either are no part of the template.  So every class of a host's template has one place, a slot of the class around it.  Its
texts outside ``article`` and ``main`` are template texts (what these hold is declared content,
though all pages share it).  What the template leaves open (the slots) is extracted whole,
less the menus, adverts, forms, notices and reader comments, which are told by tag, or
by a whole name in role, class or id of an element that only groups others.

Pages that deviate (empty ones, listings) take no class away from the others.  A host with fewer
than MIN_PAGES pages has no template.  A page whose whole text is template texts keeps them: it
is a copy rather than a frame.

Blocks: each block element starts a new block; character references are decoded, white
space inside a block becomes one space, blocks are joined by line feeds.  Nothing else
is dropped or cut.

Scale: pages are read for the vectors, for the order and for the nesting (once more for hosts with a class that is
broken), the last two only where a host's classes hold texts.  Occurrence vectors are compared by two sums of 32-bit halves of a hash of page and count, so
aggregations by (host, token) and (host, vector) with partial sums are all that is shuffled, texts as
64-bit hashes; no task gathers a host.

Cases: null html is an empty page; null urls share the empty host; markup that
breaks off is read up to there; rows that repeat count each time; no text gives "".
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, stage_table, table

MIN_PAGES = 3
#: A class is valid if at least this share of its host's pages with text hold it.
SUPPORT = 0.5
#: Templates of up to so many hosts are shipped to the pages; more are joined by a shuffle.
SHIP_HOSTS = 200_000
#: Elements of HTML by kind.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address header footer nav aside form fieldset details summary hr center dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
CHROME = frozenset("head nav header footer aside form menu dialog button select option label fieldset object canvas video audio".split())
#: Elements that group others without being text; only these are told by class, id or role.
GROUP = frozenset("div section ul ol dl table center details address".split())
#: Whole names of class, id and role that mark boilerplate.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent"
    " gdpr notice notices alert popup modal overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb"
    " breadcrumbs header masthead topbar footer comment comments reply replies respond disqus share sharing social related"
    " recommended newsletter subscribe subscription signup login search pagination pager widget widgets toolbar copyright legal"
    " disclaimer complementary contentinfo form skip".split()
)
#: An open element of the key ends where one of these begins.
ENDS = {
    "p": BLOCK - {"html", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Page:
    """Structural tokens of a page with counts, and its blocks of text outside boilerplate."""

    def __init__(self, html: str):
        self.tokens: dict[str, int] = {}  # path: count
        self.blocks: list[tuple[str, str]] = []  # path, text
        self.events: list[str | tuple[str, str]] = [""]  # opening tags (path), closing tags (path and /) and blocks, in order
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, str, bool]] = []  # tag, path, inside boilerplate
        path, chrome, parts = "", False, []
        at, n = 0, len(html)
        lower = None

        def flush() -> None:
            if parts:
                text = " ".join(html_lib.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append((path, text))
                    self.events.append(self.blocks[-1])

        def close(k: int) -> None:
            self.events.extend(f"{p}/" for _, p, _ in reversed(stack[k:]))
            del stack[k:]

        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                if not chrome:
                    parts.append(html[at:])
                break
            if m.start() > at and not chrome:
                parts.append(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if not chrome and not m[0].startswith("<!--"):
                    parts.append("")
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK or tag in CHROME:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            flush()
                            close(k)
                            path, chrome = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                            break
                    else:
                        flush()
                continue
            if tag in RAW and not m[3].endswith("/"):
                if lower is None:
                    lower = html.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == n else html.find(f"</{tag}", at)
                at = n if end < 0 else end
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in BLOCK and tag not in CHROME:
                continue
            flush()
            if tag in VOID:
                continue
            # no more than one level of each kind is left open by a missing end tag
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in ENDS and tag in ENDS[name]:
                    close(k)
                    break
                if name in ("ul", "ol", "dl", "table", "div", "article", "section", "body", "td"):
                    break
            path, chrome = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            # the header of an article holds its headline
            label, bad = tag, tag in CHROME and not (tag == "header" and any(t in ("article", "main") for t, _, _ in stack))
            if m[3]:
                for kind, a, b, c in _NAMES.findall(m[3]):
                    value = (a or b or c).lower()
                    if kind.lower() != "role":
                        label += f"[{value.replace('/', '_')}]"
                    if tag in GROUP:
                        bad = bad or not CHROME_WORDS.isdisjoint(value.split())
            path = f"{path}/{label}"
            chrome = chrome or bad
            stack.append((tag, path, chrome))
            self.tokens[path] = self.tokens.get(path, 0) + 1
            self.events.append(path)
        flush()
        close(0)
        self.events.append("/")

    def content(self, template: frozenset[int]) -> list[tuple[str, str]]:
        """The blocks that are not template texts; all of them if there is no other."""
        if not template:
            return self.blocks
        return [b for b in self.blocks if not outside(b[0]) or text_token(*b) not in template] or self.blocks


def outside(path: str) -> bool:
    """Not in an element that declares its text to be content."""
    return "/article" not in path and "/main" not in path


def text_token(path: str, text: str) -> int:
    """A block of text as a token: a signed 64-bit hash of its place and text."""
    h = xxhash.xxh3_64_intdigest(f"{path} {text}")
    return h - (1 << 64) if h >> 63 else h


def common_path(paths: list[str]) -> str:
    """The lowest element that holds all paths."""
    if not paths:
        return ""
    low, high = min(paths).split("/"), max(paths).split("/")
    n = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    return "/".join(low[:n])


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


#: A token is a path or, where ``text`` is not null, a block of text; the empty path stands for the page itself.
TOKENS = "host string, token string, text long, pages long, low long, high long, least long, most long"


def occurrences(pages: DataFrame) -> DataFrame:
    """A row for each host and token of pages with text: pages that hold it, the sums that stand for its
    occurrence vector, the least and greatest hash of the texts of these pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str, int | None], list[int]] = {}
            for host, key, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                page = Page(html or "")
                if not page.blocks:
                    continue
                whole = xxhash.xxh3_64_intdigest("\n".join(t for _, t in page.blocks)) >> 1
                texts = Counter(text_token(*x) for x in page.blocks if outside(x[0]))
                tokens = [("", None, 1), *((p, None, c) for p, c in page.tokens.items()), *(("", t, c) for t, c in texts.items())]
                vector = {c: xxhash.xxh3_64_intdigest(f"{key} {c}") for c in {c for _, _, c in tokens}}
                for token, text, count in tokens:
                    h = vector[count]
                    s = sums.get((host, token, text))
                    if s is None:
                        sums[host, token, text] = [1, h & 0xFFFFFFFF, h >> 32, whole, whole]
                        continue
                    s[0] += 1
                    s[1] += h & 0xFFFFFFFF
                    s[2] += h >> 32
                    s[3] = min(s[3], whole)
                    s[4] = max(s[4], whole)
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            columns += [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "token", "text", "pages", "low", "high", "least", "most"])

    rows = pages.select(
        host_of(F.col("url")).alias("host"),
        F.concat_ws(" ", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).alias("key"),
        "html",
    )
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high")]
    return rows.mapInArrow(run, TOKENS).groupBy("host", "token", "text").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))


def classes(seen: DataFrame) -> DataFrame:
    """Equivalence classes on MIN_PAGES pages or more that do not all read the same: host, pages, tokens (paths,
    ascending), texts (hashes, ascending).  A class without structural tags is left out."""
    kept = seen.where((F.col("pages") >= MIN_PAGES) & (F.col("least") != F.col("most")))
    vector = ["host", "pages", "low", "high"]
    # texts that share a vector with no tag never meet
    tags = kept.where(F.col("text").isNull()).groupBy(*vector).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    texts = kept.where(F.col("text").isNotNull()).groupBy(*vector).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return tags.join(texts, vector, "left").drop("low", "high")


def events_of(page: Page) -> list[str]:
    """Tags and texts that may be tokens of a template, in order: a path, a path and /, or # and the hash of a text."""
    return [e if isinstance(e, str) else f"#{text_token(*e)}" for e in page.events if isinstance(e, str) or outside(e[0])]


def is_open(event: str) -> bool:
    return not event or (event[0] == "/" and event[-1] != "/")


def places(events: list[str], members: dict[str, int], sizes: list[int]) -> Iterator[tuple[int, str, int, int]]:
    """Class, token, least and greatest place of it in its class on one page; each place is possible where the class
    is out of order."""
    found: dict[int, list[str]] = {}
    for e in events:
        if e in members:
            found.setdefault(members[e], []).append(e)
    for c, row in found.items():
        n = sizes[c]
        if len(set(row[:n])) == n and row == row[:n] * (len(row) // n):
            yield from ((c, e, k, k) for k, e in enumerate(row[:n]))
        else:
            yield from ((c, e, 0, n - 1) for e in set(row))


def ordered(rows: list[tuple[int, int, str]]) -> list[list[str]]:
    """The ordered classes of a class, given least and greatest place of its tokens: those that no other token
    ever passes, and each other element or text alone."""
    rows, loose, at, most = sorted(rows), set(), 0, -1
    for k, (_, high, _) in enumerate(rows):
        most = max(most, high)
        if most == k:
            if k > at:
                loose |= {e for _, _, e in rows[at : k + 1]}
            at = k + 1
    apart = {e if e[:1] == "#" or is_open(e) else e[:-1] for e in loose}
    keep = [e for _, _, e in rows if not apart & {e, e if is_open(e) else e[:-1]}]
    return ([keep] if keep else []) + [[e] if e[:1] == "#" else [e, f"{e}/"] for e in sorted(apart)]


def relations(events: list[str], classes: list[list[str]]) -> Iterator[tuple[int, int, int]]:
    """One page: (class, slot, class in it) for each occurrence; slot CROSS where two classes cross, and (class, TOTAL, class)."""
    where = {e: (c, r) for c, own in enumerate(classes) for r, e in enumerate(own)}
    after: dict[int, int] = {}  # open occurrences, outermost first: tokens seen
    for e in events:
        if e not in where:
            continue
        c, r = where[e]
        if r == 0:
            yield c, TOTAL, c
            yield from ((a, slot, c) for a, slot in after.items())
        else:
            # those that began later should have ended
            yield from ((c, CROSS, x) for x in list(after)[list(after).index(c) + 1 :])
        after[c] = r + 1
        if r + 1 == len(classes[c]):
            del after[c]


TOTAL, CROSS, GONE = -2, -1, -2


def units(events: list[str]) -> list[str]:
    """The elements and texts of a class."""
    return [e for e in events if e[:1] == "#" or is_open(e)]


def nested(n: int, counts: dict[tuple[int, int, int], int]) -> dict[int, tuple[int, int]]:
    """The classes of 0..n-1 (more pages first) that are nested with all before them: class around it (-1: none) and slot."""
    inside: dict[tuple[int, int], dict[int, int]] = {}
    for (a, slot, b), k in counts.items():
        if slot != TOTAL:
            inside.setdefault((a, b), {})[slot] = k

    def fits(a: int, b: int) -> bool:
        got = inside.get((a, b), {})
        return not got or (CROSS not in got and len(got) == 1 and sum(got.values()) == counts[b, TOTAL, b])

    kept: list[int] = []
    for b in range(n):
        if (b, TOTAL, b) in counts and all(fits(a, b) and fits(b, a) for a in kept):
            kept.append(b)
    around = {b: [a for a in kept if (a, b) in inside] for b in kept}
    out = {}
    for b in kept:
        a = max(around[b], key=lambda x: len(around[x]), default=-1)
        out[b] = (a, next(iter(inside[a, b])) if a >= 0 else 0)
    return out


def _by_page(pages: DataFrame, found: DataFrame, make, columns: str) -> DataFrame:
    """Rows (host, *key, *values) of the pages of hosts in ``found`` (host, classes), summed up in each batch: ``make`` takes
    events, classes, sums."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, dict] = {}
            known: dict[str, list[list[str]]] = {}
            for k, (host, html) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                page = Page(html or "")
                if not page.blocks:
                    continue
                if host not in known:
                    known[host] = b.column(2)[k].as_py()
                make(events_of(page), known[host], sums.setdefault(host, {}))
            rows = [(host, *key, *value) for host, own in sums.items() for key, value in own.items()]
            cells = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names)

    shipped = F.broadcast(found) if found.count() <= SHIP_HOSTS else found
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").join(shipped, "host").select("host", "html", "classes")
    return rows.mapInArrow(run, columns)


def _add_places(events: list[str], classes: list[list[str]], sums: dict) -> None:
    members = {e: c for c, own in enumerate(classes) for e in own}
    for c, e, low, high in places(events, members, [len(x) for x in classes]):
        was = sums.get((c, e), (low, high))
        sums[c, e] = (min(was[0], low), max(was[1], high))


def _add_relations(events: list[str], classes: list[list[str]], sums: dict) -> None:
    for key in relations(events, classes):
        sums[key] = (sums.get(key, (0,))[0] + 1,)


def valid_classes(seen: DataFrame) -> DataFrame:
    """The classes that enough of their host's pages hold, of hosts of which a class holds texts."""
    seen = stage_table(seen.where(F.col("pages") >= MIN_PAGES), "tokens")
    whole = seen.where((F.col("token") == "") & F.col("text").isNull()).select("host", F.col("pages").alias("all"))
    found = classes(seen).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    found = stage_table(found.select("host", "pages", "tokens", "texts"), "classes")
    drop_stage(seen)
    return found.join(found.where(F.size("texts") > 0).select("host").distinct(), "host", "left_semi")


def templates(pages: DataFrame) -> DataFrame:
    """A row for each class of a host's template: host, class, events (its tokens in order), around (the class that
    holds it, -1: none), slot of that class."""
    edges = F.flatten(F.transform("tokens", lambda t: F.array(t, F.concat(t, F.lit("/")))))
    texts = F.transform(F.coalesce("texts", F.array().cast("array<bigint>")), lambda t: F.concat(F.lit("#"), t.cast("string")))
    rank = (-F.col("pages")).alias("rank")
    one = F.struct(rank, F.concat(edges, texts).alias("events"))
    found = valid_classes(occurrences(pages)).groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("all"))
    found = stage_table(found.select("host", F.col("all.events").alias("classes"), F.col("all.rank").alias("ranks")), "classes")

    spots = _by_page(pages, found.select("host", "classes"), _add_places, "host string, class long, event string, low long, high long")
    spots = spots.groupBy("host", "class", "event").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spots = spots.groupBy("host", "class").agg(F.collect_list(F.struct("low", "high", "event")).alias("rows"))

    @F.udf("array<array<string>>")
    def split(rows):
        return ordered([tuple(r) for r in rows])

    parts = spots.join(found.select("host", "ranks"), "host").select("host", F.get("ranks", F.col("class").cast("int")).alias("rank"), F.explode(split("rows")).alias("events"))
    whole = _ranked(parts)
    first = _nested(pages, whole)
    # classes that do not nest are broken into their elements and texts, and what still does not nest goes
    again = first.where(F.col("around") == GONE)
    alone = again.where(F.size("events") > F.when(F.get("events", F.lit(0)).startswith("#"), 1).otherwise(2))
    broken = F.udf(lambda row: [[x] if x[:1] == "#" else [x, f"{x}/"] for x in units(row)], "array<array<string>>")
    hosts = alone.select("host").distinct()
    if hosts.limit(1).count():
        kept = first.join(hosts, "host", "left_semi").where(F.col("around") != GONE).select("host", "rank", "events")
        second = _nested(pages, _ranked(kept.unionByName(alone.select("host", "rank", F.explode(broken("events")).alias("events")))))
        first = first.join(hosts, "host", "left_anti").unionByName(second)
    return first.where(F.col("around") != GONE).select("host", "class", "events", "around", "slot")


def _ranked(parts: DataFrame) -> DataFrame:
    """host, classes, ranks of rows (host, rank, events): more pages first, then the larger class."""
    one = F.struct("rank", (-F.size("events")).alias("size"), "events")
    whole = parts.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return stage_table(whole.select("host", F.col("all.events").alias("classes"), F.col("all.rank").alias("ranks")), "classes")


def _nested(pages: DataFrame, whole: DataFrame) -> DataFrame:
    """host, class, rank, events, around, slot of every class; around is GONE for those that do not nest."""
    counts = _by_page(pages, whole.select("host", "classes"), _add_relations, "host string, a long, slot long, b long, n long")
    counts = counts.groupBy("host", "a", "slot", "b").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("a", "slot", "b", "n")).alias("rows"))

    @F.udf("array<struct<class int, around int, slot int>>")
    def tree(n, rows):
        got = nested(n, {(r[0], r[1], r[2]): r[3] for r in rows})
        return [(b, *got.get(b, (GONE, 0))) for b in range(n)]

    got = counts.join(whole, "host").select("host", "classes", "ranks", F.inline(tree(F.size("classes"), "rows")))
    at = F.col("class")
    return stage_table(got.select("host", at, F.get("ranks", at).alias("rank"), F.get("classes", at).alias("events"), "around", "slot"), "nested")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, root (the lowest element that holds it) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, texts = [], []
            for html, template in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                blocks = Page(html or "").content(frozenset(template or ()))
                roots.append(common_path([p for p, _ in blocks]))
                texts.append("\n".join(t for _, t in blocks))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(roots, pa.string())],
                ["page_id", "url", "text", "root"],
            )

    texts = F.transform(F.filter("events", lambda e: e.startswith("#")), lambda e: F.substring(e, 2, 20).cast("long"))
    found = templates(pages).groupBy("host").agg(F.flatten(F.collect_list(texts)).alias("texts"))
    found = stage_table(found.where(F.size("texts") > 0), "templates")
    if found.count() <= SHIP_HOSTS:
        found = F.broadcast(found)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    return rows.join(found, "host", "left").select("page_id", "url", "html", "texts").mapInArrow(
        run, "page_id long, url string, text string, root string"
    )


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
