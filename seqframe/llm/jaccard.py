"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Two documents link when the Jaccard similarity of their sets of word n-grams is at least
p / q.  The result has the connected component of every document; no link between
different texts is lost, and copies are never paired with each other.

1. Equal sets become one node (a 64-bit digest of the sorted n-gram hashes).
2. Screen.  Every node posts its first |x| - t + l n-grams in hash order (t = ceil(p|x|/q) is the
   overlap that it needs with any other, l grows with |x|).  Linked sets have at least the smaller l
   of these posted n-grams in common.  So each node sets the longest of its inverted lists aside, one fewer than
   the l of its smallest possible partner: the rarest common n-gram stays on both sides.  What
   is left are the short lists; most nodes meet nobody in them and are done, and
   passages and lines that many documents hold gather nobody.
3. The connected components of the short lists, taken for each size band alone, are clusters: nodes of the
   band and of the next one that have met.  Inside each, inverted lists
   (n-gram -> nodes) are searched for every node: a partner needs T = ceil(p|x|/q) or more
   common n-grams.  The L longest lists are set aside, the short ones merged with counts, nodes
   reached fewer than T - L times skipped, and the rest probed in the long lists
   by binary search.  A node already connected is skipped.
4. A cluster of more than BLOCK_NODES nodes (or BLOCK_GRAMS n-grams) is split in blocks by a hash,
   which are searched apart; then the nodes outside the cluster's largest component so far
   are searched against every block.  Nothing is capped.

Words are runs of bytes other than ASCII white space, after lower-casing A-Z; a text of fewer
words than n is one n-gram; one without words has no n-grams and links with nothing.

Cases: null text is empty; a null doc_id never links and has a null component; rows
that share a doc_id are one vertex; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, drop_stage, stage_table, table
from .graph import components
from .words import word_hashes

BLOCK_NODES = 4096
BLOCK_GRAMS = 1 << 21
#: Up to so many rows of five numbers a list of documents is shipped; a longer one is joined by a shuffle.
SHIP_ROWS = 500_000
#: The weight in the rule for the number of long lists, L = T / (SKIP * log2(longest) + 1): a merge by counting costs little beside a probe.
SKIP = 0.3
#: Probes made at once.
PROBES = 1 << 20
_MEMO = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def grams(text: str, n: int) -> np.ndarray:
    """The distinct n-grams of a text as ascending 64-bit hashes."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _MULT + w[i : len(w) - k + 1 + i]
        # the number of words tells a short text from an n-gram
        out = (out ^ (out >> np.uint64(29))) * _MIX + np.uint64(k)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Rule:
    """n words; similarity p / q."""

    n: int
    p: int
    q: int

    def overlap(self, x: int, y):
        """Common elements that sets of these sizes need."""
        return -(-self.p * (x + y) // (self.p + self.q))

    def least(self, x: int) -> int:
        """Common elements that a set of x needs with any other."""
        return -(-self.p * x // self.q)

    def common(self, x: int) -> int:
        """The l of a set of x: it grows with x and is at most ``least``."""
        return min(self.least(x), (x - self.least(x)) // 2 + 1)

    def posted(self, x: int) -> int:
        """Number of n-grams that a set of x posts."""
        return x - self.least(x) + self.common(x)

    def aside(self, x: int) -> int:
        """Longest lists that a set of x leaves out: all but one of those common with its smallest partner."""
        return self.common(self.least(x)) - 1

    def tops(self, x: int) -> list[int]:
        """Largest sizes of the bands up to that of size x; linked sets lie in the same or in neighbouring bands."""
        out = [self.q // self.p]
        while out[-1] < x:
            out.append((out[-1] + 1) * self.q // self.p)
        return out


_bands: dict[tuple[Rule, int], int] = {}


def band_of(rule: Rule, x: int) -> int:
    got = _bands.get((rule, x))
    if got is None:
        got = _bands[rule, x] = len(rule.tops(x)) - 1
    return got


def occurrences(lists: list[np.ndarray], t: int, need: np.ndarray, wanted: np.ndarray) -> Iterator[int]:
    """Docs that are in need[doc] >= t of the inverted lists (ascending docs), likely ones first: DivideSkip.

    ``wanted`` marks the docs asked for; it is looked at again after each doc that is told.
    """
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    if t > len(size):
        return
    order, n = np.argsort(size, kind="stable"), len(need)
    aside = min(t - 1, int(t / (SKIP * math.log2(max(2, int(size[order[-1]]))) + 1)))
    short, long = order[: len(order) - aside].tolist(), order[len(order) - aside :].tolist()
    # the merge of the short lists, with the number of lists that each doc comes from
    seen = np.bincount(np.concatenate([lists[k] for k in short]), minlength=n)
    near = np.flatnonzero((seen >= np.maximum(1, need - aside)) & wanted)
    near = near[np.argsort(need[near] - seen[near], kind="stable")]
    # the long lists one after another are one ascending array of (list, doc)
    flat = np.concatenate([lists[k] + i * n for i, k in enumerate(long)]) if long and len(near) else near
    at, step, most = 0, 8, max(1, min(512, PROBES // max(1, len(long))))
    while at < len(near):
        some = near[at : at + step]
        at, step = at + step, min(4 * step, most)
        some = some[wanted[some]]
        count = seen[some]
        if long and len(some):
            key = (np.arange(len(long))[:, None] * n + some).ravel()
            spot = np.minimum(np.searchsorted(flat, key), len(flat) - 1)
            count = count + (flat[spot] == key).reshape(len(long), -1).sum(0)
        for d in some[count >= need[some]].tolist():
            if wanted[d]:
                yield d


def t_occurrence(lists: list[np.ndarray], t: int, n_docs: int) -> np.ndarray:
    """All docs (of 0..n_docs-1) in at least t of the inverted lists, ascending."""
    return np.array(sorted(occurrences(lists, t, np.full(n_docs, t), np.ones(n_docs, bool))), np.int64)


class Search:
    """Inverted lists over a block of sets; links of queries to it that join different components."""

    def __init__(self, rule: Rule, nodes: list[int], sets: list[np.ndarray], labels: list[int]):
        self.rule, self.nodes = rule, nodes
        self.parent: dict[int, int] = {}
        self.label = np.array(labels, np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.grams, place = np.unique(flat, return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(place, kind="stable")
        self.post = doc[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.grams)))]).astype(np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def links(self, node: int, own: np.ndarray, label: int, before: int) -> list[int]:
        """Nodes of the first ``before`` sets that link with the query and were not connected to it yet."""
        mine = self.root(label)
        wanted = self.label != mine
        wanted[before:] = False
        if not wanted.any():
            return []
        k = np.searchsorted(self.grams, own)
        k[k == len(self.grams)] = 0
        ids = k[self.grams[k] == own]
        lists = [self.post[a:b] for a, b in zip(self.first[ids].tolist(), self.first[ids + 1].tolist(), strict=True)]
        out = []
        need = self.rule.overlap(len(own), self.size)
        for d in occurrences(lists, self.rule.least(len(own)), np.maximum(need, self.rule.least(len(own))), wanted):
            if self.nodes[d] == node:
                continue
            theirs = int(self.label[d])
            self.parent[theirs] = mine
            joined = self.label == theirs
            self.label[joined] = mine
            wanted[joined] = False
            out.append(self.nodes[d])
        return out


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raw]


LINKS = "a long, b long"


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _block_links(rule: Rule):
    """Links inside a block and to it from the band above (rows: node, grams, query)."""

    def run(rows: pa.Table) -> pa.Table:
        index: dict[int, bytes] = {}
        asked: dict[int, bytes] = {}
        for node, g, query in zip(*(rows[c].to_pylist() for c in ("node", "grams", "query")), strict=True):
            (asked if query else index)[node] = g
        if len(index) + len(asked) < 2 or not index:
            return _pairs([])
        # by size, so that a partner is most often found early
        nodes = sorted(index, key=lambda x: (len(index[x]), x))
        sets = _sets([index[x] for x in nodes])
        search = Search(rule, nodes, sets, nodes)
        pairs = [(x, y) for k, x in enumerate(nodes) for y in search.links(x, sets[k], x, k)]
        for x in sorted(asked):
            pairs += [(x, y) for y in search.links(x, np.frombuffer(asked[x], np.uint64), x, len(nodes))]
        return _pairs(pairs)

    return run


def _cross_links(rule: Rule):
    """Links of query rows to index rows (node, grams, root, query)."""

    def run(rows: pa.Table) -> pa.Table:
        index: dict[int, tuple] = {}
        asked: dict[int, tuple] = {}
        for node, g, root, query in zip(*(rows[c].to_pylist() for c in ("node", "grams", "root", "query")), strict=True):
            (asked if query else index)[node] = (g, root)
        if not index or not asked:
            return _pairs([])
        nodes = sorted(index)
        search = Search(rule, nodes, _sets([index[x][0] for x in nodes]), [index[x][1] for x in nodes])
        pairs = []
        for x in sorted(asked):
            g, root = asked[x]
            pairs += [(x, y) for y in search.links(x, np.frombuffer(g, np.uint64), root, len(nodes))]
        return _pairs(pairs)

    return run


def nodes_of(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, node (null: no n-grams) and band of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, bands = [], [], []
            for t in b.column(1).to_pylist():
                h = grams(t or "", rule.n)
                sizes.append(len(h))
                nodes.append(digest(h) if len(h) else None)
                bands.append(band_of(rule, len(h)) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.int32())],
                ["doc_id", "n_shingles", "node", "band"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, band int")


POSTS = "node long, band int, aside int, keys array<long>"


def posts(docs: DataFrame, rule: Rule) -> DataFrame:
    """The posted n-grams of every text; copies that a task has met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows, keys = [], []
                for t in b.column(1).slice(at, 512).to_pylist():
                    h = grams(t or "", rule.n)
                    x = len(h)
                    if not x or (node := digest(h)) in done:
                        continue
                    if len(done) >= _MEMO:
                        done.clear()
                    done.add(node)
                    keys.append(h[: rule.posted(x)].view(np.int64))
                    rows.append((node, band_of(rule, x), rule.aside(x), len(keys[-1])))
                if rows:
                    nodes, bands, aside, sizes = zip(*rows, strict=True)
                    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                    columns = [pa.array(nodes, pa.int64())] + [pa.array(c, pa.int32()) for c in (bands, aside)]
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))))
                    yield pa.RecordBatch.from_arrays(columns, ["node", "band", "aside", "keys"])

    return docs.mapInArrow(run, POSTS)


def _in_band(node, band) -> Column:
    """The name of a node among those of a band: the band is laid over its highest byte."""
    return node.bitwiseXOR(F.shiftleft(band.cast("long"), 56))


def clusters(docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, root): the nodes that meet others in a band, by connected component of its short lists.

    The length of a list is counted with partial sums; a node's own lists are ranked by a
    window over that node, so no task gathers the holders of an n-gram.
    """
    posted = stage_table(posts(docs, rule), "posts")
    rows = posted.select("node", "band", "aside", F.explode("keys").alias("key"))
    # the number of tasks' copies of a node counts too: any order of the n-grams that all nodes share is exact
    length = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.dense_rank().over(W.partitionBy("node").orderBy(F.desc("n"), "key"))
    short = rows.join(length, "key").withColumn("rank", rank).where("rank > aside")
    bands = F.explode(F.filter(F.array(F.col("band"), F.col("band") - 1), lambda b: b >= 0))
    short = short.select("key", "node", bands.alias("band")).select("key", "band", _in_band(F.col("node"), F.col("band")).alias("node"))
    short = stage_table(short, "short")
    drop_stage(posted)
    least = short.groupBy("key", "band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "band", "a")
    edges = short.join(least, ["key", "band"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    edges = stage_table(edges, "meetings")
    drop_stage(short)
    out = components(edges)
    drop_stage(edges)
    return out


def gram_sets(docs: DataFrame, placed: DataFrame, rule: Rule) -> DataFrame:
    """The columns of ``placed`` (which has the node and a doc_id of it) and grams."""
    columns = [f for f in placed.schema.fields if f.name != "doc_id"]
    names = [f.name for f in columns]
    at = names.index("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [grams(t or "", rule.n) for t in part.column(len(names)).to_pylist()]
                # of rows that share a doc_id, those with another set are no part of this node
                own = [len(h) > 0 and digest(h) == node for h, node in zip(sets, part.column(at).to_pylist(), strict=True)]
                raw = pa.array([h.tobytes() for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], raw], [*names, "grams"]).filter(pa.array(own, pa.bool_()))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    if placed.count() <= SHIP_ROWS:
        placed = F.broadcast(placed)
    return docs.join(placed, "doc_id").select(*names, "text").mapInArrow(run, f"{shape}, grams binary")


def _placed(met: DataFrame, first: DataFrame) -> DataFrame:
    """cluster, sub (block), node, doc_id, upper (the node is of the next band), blocks of the cluster."""
    bands = F.filter(F.array(F.col("band"), F.col("band") - 1), lambda b: b >= 0)
    each = first.select("node", "first", "n", "band", F.explode(bands).alias("in_band"))
    named = each.withColumn("name", _in_band(F.col("node"), F.col("in_band")))
    inside = met.select(F.col("node").alias("name"), F.col("root").alias("cluster")).join(named, "name").select(
        "cluster", "node", F.col("first").alias("doc_id"), "n", (F.col("in_band") < F.col("band")).alias("upper")
    )
    sizes = inside.groupBy("cluster").agg(F.count("*").alias("nodes"), F.count_if(~F.col("upper")).alias("own"), F.sum("n").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("grams") / BLOCK_GRAMS)).cast("int")
    # two nodes of the next band alone meet in that band too
    sizes = sizes.where("own > 0 and nodes > 1").select("cluster", blocks.alias("blocks"))
    sub = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    sizes = stage_table(sizes, "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= SHIP_ROWS else sizes
    return inside.join(sizes, "cluster").select("cluster", sub.alias("sub"), "node", "doc_id", "upper", "blocks")


def join(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text)."""
    rule = Rule(n, p, q)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stage_table(nodes_of(docs, rule), "nodes")
    first = known.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.max("band").alias("band")
    )
    first = stage_table(first, "first")
    met = stage_table(clusters(docs.where(F.col("doc_id").isNotNull()), rule), "clusters")
    placed = stage_table(_placed(met, first), "placed")
    drop_stage(met)
    inner = stage_table(_within(docs, placed, rule), "links")
    outer = _across(docs, placed.where("blocks > 1"), inner, rule)
    links = inner.unionByName(outer)
    shared = _shared_ids(known)
    labels = components(links if shared is None else links.unionByName(shared))
    roots = first.join(labels, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    final = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = roots.join(final, "root").select("node", "component_id")
    got = known.join(by_node, "node", "left")
    out = stage_table(got.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    for done in (known, first, placed, inner):
        drop_stage(done)
    return out


def _within(docs: DataFrame, placed: DataFrame, rule: Rule) -> DataFrame:
    """Links inside each block: between nodes of its band, and from those of the next band to them."""
    sets = gram_sets(docs, placed.select("cluster", "sub", "node", "doc_id", F.col("upper").alias("query")), rule)
    return sets.groupBy("cluster", "sub").applyInArrow(_block_links(rule), LINKS)


def _across(docs: DataFrame, wide: DataFrame, inner: DataFrame, rule: Rule) -> DataFrame:
    """Links between blocks of the same cluster, given the links found so far."""
    if not wide.limit(1).count():
        return docs.sparkSession.createDataFrame([], LINKS)
    linked = components(inner.join(wide.select(F.col("node").alias("a")).distinct(), "a", "left_semi"))
    wide = wide.join(linked.select("node", F.col("root").alias("r")), "node", "left")
    wide = stage_table(wide.withColumn("root", F.coalesce("r", "node")).drop("r", "upper"), "wide")
    share = wide.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    most = share.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("nodes"))
    parts = F.ceil((F.col("nodes") - F.col("m.n")) / (4 * BLOCK_NODES)).cast("int")
    most = most.select("cluster", F.col("m.root").alias("main"), parts.alias("parts")).where("parts > 0")
    sets = gram_sets(docs, wide.join(most, "cluster"), rule)

    def row(sub: Column, part: Column, query: bool) -> Column:
        return F.struct(sub.cast("int").alias("sub"), part.cast("int").alias("part"), F.col("node"), F.col("grams"), F.col("root"), F.lit(query).alias("query"))

    index = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: row(F.col("sub"), i, False))
    part = F.pmod(F.xxhash64("node", F.lit(2)), "parts")
    # a block has been searched for its own nodes
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("sub"))
    ask = F.transform(F.when(F.col("root") != F.col("main"), others).otherwise(F.array().cast("array<int>")), lambda i: row(i, part, True))
    rows = sets.select("cluster", F.inline(F.concat(index, ask)))
    return stage_table(rows.groupBy("cluster", "sub", "part").applyInArrow(_cross_links(rule), LINKS), "links")


def _shared_ids(known: DataFrame) -> DataFrame | None:
    """Links between the nodes of rows that share a doc_id, if there are such."""
    ids = known.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    odd = ids.where(F.col("a") != F.col("z")).select("doc_id", "a")
    if not odd.limit(1).count():
        return None
    return odd.join(known.select("doc_id", F.col("node").alias("b")), "doc_id").where("b is not null and b != a").select("a", "b")


#: White space and capitals are told by code, so that nothing depends on a locale.
ORACLE_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
t AS (SELECT min(doc_id) AS id, list_sort(s) AS k, CAST(len(s) AS BIGINT) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
e AS (SELECT id, n, unnest(k) AS g FROM t),
l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN t ON list_sort(s.s) = t.k LEFT JOIN c ON t.id = c.a
"""


def op4_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(table(spark, sf_dir, "documents")), 4, 85, 100)
