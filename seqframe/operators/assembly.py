"""De Bruijn graphs, contigs, read pairs and overlap assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .stages import stage


def de_bruijn(kmers: DataFrame) -> DataFrame:
    """src, dst, n: an arc from the prefix to the suffix of each k-mer (column ``kmer``; ``n`` times, or once)."""
    n = F.col("n") if "n" in kmers.columns else F.lit(1)
    k = F.length("kmer")
    arcs = kmers.select(F.substring("kmer", F.lit(1), k - 1).alias("src"), F.substring("kmer", F.lit(2), k - 1).alias("dst"), n.cast("long").alias("n"))
    return arcs.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def de_bruijn_of(seqs: DataFrame, k: int) -> DataFrame:
    """id, src, dst, n: the arcs of the k-mers of each sequence."""
    at = S.read(lambda t: F.transform(t.starts(k), lambda i: F.struct(t.sub(i, k - 1).alias("src"), t.sub(i + 1, k - 1).alias("dst"))), "seq")
    return seqs.select("id", F.inline(at)).groupBy("id", "src", "dst").agg(F.count("*").alias("n"))


def pair_de_bruijn(pairs: DataFrame) -> DataFrame:
    """d, src, dst, n: nodes are structs (a, b) of the shorter pairs, one symbol further apart."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    k = F.length("a")
    part = lambda i: F.struct(F.substring("a", F.lit(i), k - 1).alias("a"), F.substring("b", F.lit(i), k - 1).alias("b"))
    arcs = pairs.select((F.col("d") + 1).alias("d"), part(1).alias("src"), part(2).alias("dst"), n.cast("long").alias("n"))
    return arcs.groupBy("d", "src", "dst").agg(F.sum("n").alias("n"))


def spell(steps: DataFrame) -> DataFrame:
    """id, seq: the string of a walk over k-mers (id, step, kmer); they must be of one length.

    The first symbol of each, then the rest of the last.
    """
    walk = F.array_sort(F.collect_list(F.struct("step", "kmer")))
    got = steps.groupBy("id").agg(walk.alias("w"), F.min(F.length("kmer")).alias("k"), F.max(F.length("kmer")).alias("most"))
    text = F.concat(F.array_join(F.transform("w", lambda x: F.substring(x["kmer"], 1, 1)), ""), F.substring(F.element_at("w", -1)["kmer"], F.lit(2), F.col("k")))
    right = (F.col("k") == F.col("most")) & (F.col("k") > 0)
    return got.select("id", F.when(right, text).otherwise(F.raise_error(F.lit("k-mers of unequal length"))).alias("seq"))


def spell_pairs(steps: DataFrame) -> DataFrame:
    """id, seq: the string of a walk over read pairs (id, d, step, a, b).

    The walk of the first mates gives the front, that of the second mates the rest from
    k + d on; null where the walk is too short to reach it.
    """
    walk = F.array_sort(F.collect_list(F.struct("step", "a", "b")))
    got = steps.groupBy("id", "d").agg(walk.alias("w"), F.max(F.length("a")).alias("k"))
    line = lambda m: F.concat(F.array_join(F.transform("w", lambda x: F.substring(x[m], 1, 1)), ""), F.substring(F.element_at("w", -1)[m], F.lit(2), F.col("k")))
    a, b, shift = line("a"), line("b"), F.col("k") + F.col("d")
    whole = F.concat(F.substring(a, F.lit(1), shift), b)
    return got.select("id", F.when(F.length(a) >= shift, whole).alias("seq"))


def _simple(edges: DataFrame) -> DataFrame:
    """node: those with one arc in and one out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("i"))
    return out.join(into, "node").where("o = 1 and i = 1").select("node")


def contigs(kmers: DataFrame) -> DataFrame:
    """seq, n: strings of the maximal non-branching paths of the de Bruijn graph of k-mers (kmer, n or once)."""
    return _paths(stage(de_bruijn(kmers)), lambda x: x, lambda x: F.substring(x, -1, 1))


def pair_contigs(pairs: DataFrame) -> DataFrame:
    """d, seq, n: strings of the maximal non-branching paths of the paired graph of (d, a, b).

    A path that is too short to reach its second mates gives no string and is left out.
    """
    if not pairs.limit(1).count():
        return pairs.select("d", F.col("a").alias("seq"), F.lit(1).cast("long").alias("n"))
    e = pair_de_bruijn(pairs)
    name = lambda x: F.concat(x["a"], F.lit("|"), x["b"])
    # a node is written as first|second; a path as the nodes' last symbols of both
    edges = stage(e.select("d", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"), "n"))
    half = lambda x, i: F.split_part(x, F.lit("|"), F.lit(i))
    end = lambda x: F.concat(F.substring(half(x, 1), -1, 1), F.substring(half(x, 2), -1, 1))
    d = edges.agg(F.min("d").alias("d")).first()["d"]
    k = F.length(half(F.col("seq"), 1))
    paths = _paths(edges.drop("d"), lambda x: F.concat(x, F.lit("|")), end)
    tail = half(F.col("seq"), 3)
    n = F.floor(F.length(tail) / 2).cast("int")
    pick = lambda o: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(tail, 2 * i + o, F.lit(1))), "")
    first, second, shift = F.concat(half(F.col("seq"), 1), pick(1)), F.concat(half(F.col("seq"), 2), pick(2)), k + d
    whole = F.concat(F.substring(first, F.lit(1), shift), second)
    return paths.where(F.length(first) >= shift).select(F.lit(d - 1).alias("d"), whole.alias("seq"), "n")


def _paths(edges: DataFrame, begin, end) -> DataFrame:
    """seq, n of the maximal non-branching paths of arcs (src, dst, n): begin(first node), then end(node) of each other.

    Chains of simple nodes are joined by pointer doubling: in each round every chain takes over
    the one that starts where it ends, so rounds grow with the logarithm of the longest
    path.  Each round is written out, so lineage stays short.  Isolated cycles come once,
    from their smallest node.
    """
    simple = stage(_simple(edges))
    head = simple.withColumnRenamed("node", "src")
    start = edges.join(head, "src", "left_anti")
    inner = stage(edges.join(head, "src", "left_semi").select("src", "dst"))
    reached = _reached(start, inner, simple).withColumnRenamed("node", "src")
    last = end(F.col("dst"))
    chain = _chains(inner.join(reached, "src", "left_semi"), end)
    paths = start.join(chain.select(F.col("head").alias("dst"), "text"), "dst", "left").select(
        F.concat(begin(F.col("src")), last, F.coalesce("text", F.lit(""))).alias("seq"), "n"
    )
    rings = _rings(inner.join(reached, "src", "left_anti"), begin, end)
    return paths.unionByName(rings).groupBy("seq").agg(F.sum("n").alias("n"))


def _reached(start: DataFrame, inner: DataFrame, simple: DataFrame) -> DataFrame:
    """node: the simple nodes on paths from branching nodes; after round r those up to 2**r arcs away."""
    reached = stage(start.select(F.col("dst").alias("node")).distinct().join(simple, "node", "left_semi"))
    jump, n = inner, reached.count()
    while True:
        more = reached.join(jump.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).join(simple, "node", "left_semi")
        reached = stage(reached.unionByName(more).distinct())
        before, n = n, reached.count()
        if n == before:
            return reached
        x, y = jump.withColumnRenamed("dst", "m"), jump.withColumnRenamed("src", "m")
        jump = stage(x.join(y, "m").select("src", "dst"))


def _chains(arcs: DataFrame, end) -> DataFrame:
    """head, tail, text: from each node to the end of its chain of arcs, with what each step adds."""
    chain = stage(arcs.select(F.col("src").alias("head"), F.col("dst").alias("tail"), end(F.col("dst")).alias("text")))
    while True:
        after = chain.select(F.col("head").alias("tail"), F.col("tail").alias("t2"), F.col("text").alias("x2"))
        new = stage(
            chain.join(after, "tail", "left").select(
                "head", F.coalesce("t2", "tail").alias("tail"), F.concat("text", F.coalesce("x2", F.lit(""))).alias("text"), F.col("t2").isNotNull().alias("moved")
            )
        )
        chain = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return chain


def _rings(arcs: DataFrame, begin, end) -> DataFrame:
    """seq, n: isolated cycles, cut at their smallest nodes.

    After round r each node knows the least of the 2**r nodes after it; once no round lowers any, all know their ring's.
    """
    loop = stage(arcs.select("src", "dst"))
    jump = loop.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.least("src", "dst").alias("least"))
    while True:
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("t2"), F.col("least").alias("l2"))
        new = stage(jump.join(ahead, "to").select("node", F.col("t2").alias("to"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("moved")))
        jump = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    cuts = jump.where("node = least").select(F.col("node").alias("src"))
    first = loop.join(cuts, "src", "left_semi")
    chain = _chains(loop.join(cuts, "src", "left_anti"), end).select(F.col("head").alias("dst"), "text")
    whole = F.concat(begin(F.col("src")), end(F.col("dst")), F.coalesce("text", F.lit("")))
    return first.join(chain, "dst", "left").select(whole.alias("seq"), F.lit(1).cast("long").alias("n"))


def overlap_assembly(seqs: DataFrame) -> DataFrame:
    """seq: fragments merged greedily by their longest overlaps of at least half the shorter one.

    Fragments with a column ``id`` are merged for each id apart, which is returned first.  A greedy merge
    is one sequence of choices, so the fragments of an id are merged in one task; overlaps are compared whole, and
    equal fragments count once.  No rows when they do not all join.
    """
    own = ["id"] if "id" in seqs.columns else []

    def run(table):
        import pandas as pd

        from ..functions.overlaps import merged

        whole = merged(sorted(set(table["seq"])))
        if whole is None:
            return pd.DataFrame({k: pd.Series([], dtype=table[k].dtype) for k in [*own, "seq"]})
        return pd.DataFrame({**{k: table[k].iloc[:1].tolist() for k in own}, "seq": [whole]})

    kind = "".join(f"id {seqs.schema[k].dataType.simpleString()}, " for k in own)
    return seqs.select(*own, "seq").groupBy(*(own or [F.lit(1).alias("g")])).applyInPandas(run, f"{kind}seq string")


def partial_digest(instances: DataFrame) -> DataFrame:
    """id, points: all point sets whose pairwise distances are the multiset (id, d, n); a mirror image is one more.

    One instance is one backtracking search; instances run apart.
    """

    def run(table):
        import pandas as pd

        from ..functions.digest import point_sets

        left = dict(zip(table["d"].tolist(), table["n"].tolist(), strict=True))
        found = point_sets(left)
        return pd.DataFrame({"id": [table["id"].iloc[0]] * len(found), "points": found})

    kind = instances.schema["id"].dataType.simpleString()
    return instances.select("id", "d", "n").groupBy("id").applyInPandas(run, f"id {kind}, points array<int>")
