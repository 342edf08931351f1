"""Queries over peptides, spectra and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..alphabet import AMINO, INTEGER_MASS, MASS_SYMBOL, MONO_MASS, WATER_MONO
from ..functions import spectrum as P
from ..operators import distance, peptide, tree
from ..sources import newick
from .tables import kmers_sql, query, with_sql

# ---- peptides and masses --------------------------------------------------------

_MASSES = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {INTEGER_MASS[a]}, {MONO_MASS[a]}::DOUBLE)" for a in AMINO) + ") AS v(aa, im, mm)"
_RES = "SELECT id, pos, im, mm FROM k JOIN mass ON kmer = aa"
_PEP = with_sql("pep", k=kmers_sql("pep", 1), mass=_MASSES, r=_RES)
#: Prefix sums from 0 with their places.
_PRE = "SELECT id, 0 AS i, 0::BIGINT AS x FROM pep UNION ALL SELECT id, pos + 1, CAST(sum(im) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) FROM r"


def _long(c):
    return c.cast("array<bigint>")


def _masses(t, masses=P.integer_masses):
    return t.peptides.select("id", masses("seq").alias("masses"))


@query(_PEP + "SELECT id, list(im::BIGINT ORDER BY pos) AS masses, string_agg(CAST(im AS VARCHAR), '-' ORDER BY pos) AS text FROM r GROUP BY 1")
def integer_masses(t):
    m = P.integer_masses("seq")
    return t.peptides.select("id", _long(m).alias("masses"), P.mass_string(m).alias("text"))


@query(_PEP + f"SELECT id, round(sum(mm) + {WATER_MONO}, 5) AS weight FROM r GROUP BY 1")
def peptide_weight(t):
    return t.peptides.select("id", F.round(P.weight("seq"), 5).alias("weight"))


@query(_PEP + "SELECT id, list(round(x, 5) ORDER BY i) AS masses FROM (SELECT id, -1 AS i, 0::DOUBLE AS x FROM pep UNION ALL SELECT id, pos, sum(mm) OVER (PARTITION BY id ORDER BY pos) FROM r) GROUP BY 1")
def mono_prefix_spectrum(t):
    x = P.prefix_sums(P.mono_masses("seq"), "double")
    return t.peptides.select("id", F.transform(x, lambda v: F.round(v, 5)).alias("masses"))


_SYMBOL = "SELECT * FROM (VALUES " + ", ".join(f"({m}, '{a}')" for m, a in MASS_SYMBOL.items()) + ") AS v(m, aa)"


@query(
    "WITH s AS (" + _SYMBOL + "), q AS (SELECT l_orderkey AS id, l_linenumber AS i, CAST(l_quantity AS INT) + 80 AS m FROM lineitem)"
    " SELECT id, string_agg(coalesce(aa, '-'), '' ORDER BY i, q.m) AS peptide, count(*) = count(aa) AS ok FROM q LEFT JOIN s ON s.m = q.m GROUP BY 1"
)
def masses_to_peptide(t):
    q = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", (F.col("l_quantity").cast("int") + 80).alias("m")).alias("x"))
    m = q.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["m"]).alias("masses"))
    return m.select("id", P.from_masses("masses").alias("p")).select("id", "p.peptide", "p.ok")


@query(with_sql("pep", k=kmers_sql("pep", 1), mass=_MASSES, r=_RES, pre=_PRE) + "SELECT id, list(x ORDER BY i) AS masses FROM pre WHERE i > 0 GROUP BY 1")
def prefix_spectrum(t):
    return t.peptides.select("id", _long(P.prefix_spectrum(P.integer_masses("seq"))).alias("masses"))


_WITHPRE = with_sql("pep", k=kmers_sql("pep", 1), mass=_MASSES, r=_RES, pre=_PRE)


@query(_WITHPRE + "SELECT id, list(x ORDER BY x) AS masses FROM (SELECT id, unnest([x, w - x]) AS x FROM (SELECT *, max(x) OVER (PARTITION BY id) AS w FROM pre) WHERE i < 32) GROUP BY 1")
def ideal_spectrum(t):
    return t.peptides.select("id", _long(P.ideal_spectrum(P.integer_masses("seq"))).alias("masses"))


_LINEAR = "SELECT id, 0::BIGINT AS x FROM pep UNION ALL SELECT a.id, b.x - a.x FROM pre a JOIN pre b ON a.id = b.id AND a.i < b.i"


@query(_WITHPRE + f"SELECT id, list(x ORDER BY x) AS masses FROM ({_LINEAR}) GROUP BY 1")
def linear_spectrum(t):
    return peptide.theoretical_spectra(_masses(t), False, "bigint", "masses")


_CYCLIC = (
    "SELECT id, 0::BIGINT AS x FROM pep UNION ALL SELECT id, max(x) FROM pre GROUP BY 1"
    " UNION ALL SELECT a.id, b.x - a.x FROM pre a JOIN pre b ON a.id = b.id AND a.i < b.i AND b.i - a.i < 32 AND a.i < 32"
    " UNION ALL SELECT a.id, w - (b.x - a.x) FROM (SELECT *, max(x) OVER (PARTITION BY id) AS w FROM pre) a JOIN pre b ON a.id = b.id AND a.i < b.i AND a.i > 0 AND b.i < 32"
)


@query(_WITHPRE + f"SELECT id, list(x ORDER BY x) AS masses FROM ({_CYCLIC}) GROUP BY 1")
def cyclic_spectrum(t):
    return peptide.theoretical_spectra(_masses(t), True, "bigint", "masses")


@query("SELECT p_partkey AS id, CAST(k * (k + 1) // 2 + 1 AS BIGINT) AS linear, CAST(k * (k - 1) AS BIGINT) AS cyclic FROM (SELECT p_partkey, p_size::BIGINT AS k FROM part)")
def sub_peptide_counts(t):
    p = t.read("part").select(F.col("p_partkey").alias("id"), "p_size")
    return p.select("id", P.sub_peptides_linear("p_size").alias("linear"), P.sub_peptides_cyclic("p_size").alias("cyclic"))


@query(
    with_sql("pep", k=kmers_sql("pep", 1), mass=_MASSES, r=_RES, pre=_PRE, l=_LINEAR, c=_CYCLIC)
    + f"SELECT id, CAST(sum(n) AS BIGINT) AS n, true AS consistent FROM (SELECT id, a.x AS v, least(a.n, b.n) AS n FROM (SELECT id, x, count(*) AS n FROM l GROUP BY ALL) a JOIN (SELECT id, x, count(*) AS n FROM c GROUP BY ALL) b USING (id, x)) GROUP BY 1"
)
def common_counts(t):
    return peptide.common_counts(_masses(t))


@query(with_sql("spec") + "SELECT spec_id, mass, count(*) AS n FROM spec GROUP BY ALL")
def mass_counts(t):
    return t.spectra.groupBy("spec_id", "mass").agg(F.count("*").alias("n"))


@query(with_sql("spec") + "SELECT a.spec_id, CAST(a.mass - b.mass AS INT) AS diff, count(*) AS n FROM spec a JOIN spec b ON a.spec_id = b.spec_id AND a.mass > b.mass GROUP BY ALL")
def convolution(t):
    return distance.self_convolution(t.spectra)


_SHIFTED = "SELECT l_orderkey AS spec_id, CAST(l_quantity AS INT) + l_linenumber AS mass FROM lineitem"


@query(
    with_sql("spec", other=_SHIFTED, d="SELECT a.spec_id, b.mass - a.mass AS diff, count(*) AS n FROM spec a JOIN other b USING (spec_id) GROUP BY ALL")
    + "SELECT spec_id, arg_max(diff, (n, -diff)) AS diff, max(n) AS n FROM d GROUP BY 1"
)
def convolve_spectra(t):
    other = t.read("lineitem").select(F.col("l_orderkey").alias("spec_id"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("mass"))
    return distance.modal_difference(t.spectra, other)


@query(
    with_sql("spec", other=_SHIFTED, x="SELECT spec_id, mass, count(*) AS n FROM spec GROUP BY ALL", y="SELECT spec_id, mass, count(*) AS n FROM other GROUP BY ALL")
    + "SELECT spec_id, CAST(sum(least(x.n, y.n)) AS BIGINT) AS n FROM x JOIN y USING (spec_id, mass) GROUP BY 1"
)
def spectrum_intersection(t):
    other = t.read("lineitem").select(F.col("l_orderkey").alias("spec_id"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("mass"))
    return distance.common_counts(t.spectra, other)


@query(
    with_sql("spec", d="SELECT a.spec_id, a.mass - b.mass AS m, count(*) AS n FROM spec a JOIN spec b ON a.spec_id = b.spec_id AND a.mass > b.mass GROUP BY ALL", r="SELECT *, rank() OVER (PARTITION BY spec_id ORDER BY n DESC) AS r FROM d WHERE m BETWEEN 5 AND 40")
    + "SELECT spec_id, m, n FROM r WHERE r <= 3"
)
def frequent_masses(t):
    return peptide.frequent_masses(t.spectra, 3, 5, 40)


@query("SELECT user_id, list(CAST(floor(value * 10 + 0.5) AS BIGINT) ORDER BY event_id) AS q FROM events GROUP BY 1")
def quantize(t):
    e = t.read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", P.quantize(F.transform("v", lambda x: x["value"]), 10).alias("q"))


@query("SELECT c_custkey AS id, [c_acctbal, c_nationkey::DOUBLE] AS v FROM customer")
def parse_floats(t):
    texts = F.array(F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"))
    return t.read("customer").select(F.col("c_custkey").alias("id"), P.parse_floats(texts).alias("v"))


@query(
    "WITH e AS (SELECT event_id, value AS x FROM events WHERE value IS NOT NULL), lo AS (SELECT event_id, x, p_retailprice / 10 AS v FROM e ASOF LEFT JOIN part ON x > p_retailprice / 10),"
    " hi AS (SELECT event_id, p_retailprice / 10 AS w FROM e ASOF LEFT JOIN part ON x <= p_retailprice / 10)"
    " SELECT event_id AS key, round(CASE WHEN v IS NULL OR w - x <= x - v THEN w ELSE v END, 6) AS nearest FROM lo JOIN hi USING (event_id)"
)
def nearest_mass(t):
    left = t.read("events").where("value is not null").select(F.col("event_id").alias("key"), F.col("value").alias("x"))
    right = t.read("part").select((F.col("p_retailprice") / 10).alias("value"))
    return distance.nearest(left, right).select("key", F.round("nearest", 6).alias("nearest"))


@query(
    with_sql("spec")
    + "SELECT a.spec_id, CAST(count(DISTINCT CASE WHEN b.mass IS NOT NULL THEN ord END) AS BIGINT) AS n FROM (SELECT l_orderkey AS spec_id, l_linenumber AS ord, CAST(l_extendedprice / 1000 AS DOUBLE) AS mass FROM lineitem) a"
    " LEFT JOIN (SELECT DISTINCT spec_id, mass::DOUBLE AS mass FROM spec) b ON a.spec_id = b.spec_id AND abs(a.mass - b.mass) <= 0.3 GROUP BY 1"
)
def spectrum_overlap(t):
    theory = t.read("lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_linenumber").alias("ord"), (F.col("l_extendedprice") / 1000).alias("mass"))
    return distance.overlap(t.spectra.withColumn("mass", F.col("mass").cast("double")), theory, 0.3)


_NEAREST_AA = "SELECT event_id, min((abs(x - mm), -mm, aa)) AS m FROM (SELECT event_id, value + 60 AS x FROM events) CROSS JOIN mass GROUP BY 1"


@query(f"WITH mass AS ({_MASSES}), x AS ({_NEAREST_AA}) SELECT event_id, m[3] AS aa FROM x")
def nearest_residue(t):
    table = F.array(*[F.struct(F.lit(MONO_MASS[a]).alias("m"), F.lit(a).alias("a")) for a in AMINO])
    x = F.col("value") + 60
    best = F.array_min(F.transform(table, lambda v: F.struct(F.abs(x - v["m"]).alias("d"), (-v["m"]).alias("m"), v["a"].alias("a"))))
    return t.read("events").select("event_id", best["a"].alias("aa"))


@query("SELECT l_orderkey AS id, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_quantity) = list(CAST(l_quantity AS INT) ORDER BY l_quantity) AS sorted FROM lineitem GROUP BY 1")
def spectrum_equal(t):
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("m")))).alias("x"))
    m = F.transform("x", lambda v: v["m"])
    return rows.select("id", m.eqNullSafe(F.array_sort(m)).alias("sorted"))


def _rings(t, masses=P.integer_masses, kind="int"):
    """The cyclic spectrum of each part's whole peptide."""
    return peptide.theoretical_spectra(_masses(t, masses), True, kind).withColumnRenamed("id", "spec_id")


@query()
def cyclic_sequencing(t):
    return peptide.theoretical_sequences(_rings(t))


@query()
def leaderboard(t):
    return peptide.leaderboard(_rings(t), 20)


@query()
def experimental_sequencing(t):
    return peptide.experimental_sequences(_rings(t), 12, 20)


@query()
def float_sequencing(t):
    return peptide.float_leaderboard(_rings(t, P.mono_masses, "double"), 20, 1)


# ---- trees ----------------------------------------------------------------------


@query(with_sql("tree") + "SELECT 0 AS tree_id, parent AS node, list(node ORDER BY node) AS children FROM tree WHERE parent IS NOT NULL GROUP BY parent")
def tree_children(t):
    return tree.children(t.tree)


@query(with_sql("tree") + "SELECT 0 AS tree_id, node, parent FROM tree")
def tree_parents(t):
    return tree.parents(tree.children(t.tree))


@query(with_sql("tree") + "SELECT 0 AS tree_id, name, max(node) AS node FROM tree WHERE name <> '' GROUP BY name")
def node_map(t):
    return tree.name_map(t.tree)


#: Ancestors of every node by recursion: node, above, steps, dist.
_UP = "SELECT node, node AS above, 0 AS steps, 0::DOUBLE AS dist FROM {0} UNION ALL SELECT u.node, x.parent, u.steps + 1, u.dist + coalesce(x.weight, 0) FROM up u JOIN {0} x ON x.node = u.above WHERE x.parent IS NOT NULL"
_PATHS = "SELECT p.a, p.b, min((x.steps + y.steps, x.dist + y.dist)) AS m FROM pairs p JOIN up x ON x.node = a JOIN up y ON y.node = b AND x.above = y.above GROUP BY ALL"


@query(
    with_sql("tree", "ctree", up=_UP.format("ctree"), pairs="SELECT node AS a, node + 1 AS b FROM ctree WHERE node + 1 IN (SELECT node FROM ctree)", r=_PATHS)
    + "SELECT a, b, m[1] AS steps, round(m[2], 4) AS dist FROM r"
)
def tree_paths(t):
    nodes = t.customer_tree
    n = nodes.select("tree_id", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    pairs = n.join(nodes.select(F.col("node").alias("b")), "b")
    return tree.pair_paths(nodes, pairs).select("a", "b", "steps", F.round("dist", 4).alias("dist"))


@query(
    with_sql("tree", up=_UP.format("tree"), leaf="SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)", pairs="SELECT x.node AS a, y.node AS b FROM leaf x JOIN leaf y ON x.node < y.node", r=_PATHS)
    + "SELECT a, b, round(m[2], 6) AS dist FROM r"
)
def leaf_distances(t):
    return tree.leaf_distances(t.tree).select("a", "b", F.round("dist", 6).alias("dist"))


@query(
    with_sql("tree", up=_UP.format("tree"), inn="SELECT DISTINCT parent AS node FROM tree WHERE parent > 0")
    + "SELECT i.node, string_agg(CASE WHEN u.node IS NULL THEN '0' ELSE '1' END, '' ORDER BY t.node DESC) AS bits FROM inn i CROSS JOIN tree t LEFT JOIN up u ON u.above = i.node AND u.node = t.node GROUP BY 1"
)
def tree_characters(t):
    return tree.characters(t.tree).select("node", "bits")


@query(
    with_sql(
        "nat", k=kmers_sql("nat", 1),
        h="SELECT pos, kmer, count(*) AS c, max(id) AS last FROM k GROUP BY ALL",
        m="SELECT pos, arg_max(kmer, (c, -last)) AS modal, max(c) AS mode FROM h GROUP BY 1",
    )
    + "SELECT pos, string_agg(CASE WHEN kmer = modal THEN '0' ELSE '1' END, '' ORDER BY id DESC) AS bits FROM k JOIN m USING (pos) WHERE (SELECT count(*) FROM nat) - mode >= 2 GROUP BY 1"
)
def site_characters(t):
    return tree.site_characters(t.nations)


def _newick(t):
    """The world as Newick text, from its table of nodes."""
    return newick.text(t.tree)


_NATIONS_TEXT = "SELECT n_regionkey AS r, string_agg(n_name || ':' || format('{:g}', n_nationkey * 0.25 + 1), ',' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1"


@query(
    f"WITH n AS ({_NATIONS_TEXT}) SELECT 0 AS tree_id, '(' || string_agg('(' || x || ')' || r_name || ':' || format('{{:g}}', r_regionkey + 0.5), ',' ORDER BY r_regionkey) || ')WORLD;' AS text FROM region JOIN n ON r = r_regionkey"
)
def newick_text(t):
    return _newick(t)


@query(
    "WITH x AS (SELECT -1 AS r, -1 AS n, 'WORLD' AS name, NULL::DOUBLE AS weight, 0 AS depth UNION ALL SELECT r_regionkey, -1, r_name, r_regionkey + 0.5, 1 FROM region UNION ALL SELECT n_regionkey, n_nationkey, n_name, n_nationkey * 0.25 + 1, 2 FROM nation),"
    " y AS (SELECT *, CAST(row_number() OVER (ORDER BY r, n) - 1 AS INT) AS node FROM x)"
    " SELECT y.node, p.node AS parent, y.depth, y.name, y.weight, y.depth = 2 AS is_leaf FROM y LEFT JOIN y p ON p.depth = y.depth - 1 AND (y.depth = 1 OR p.r = y.r)"
)
def newick_nodes(t):
    return newick.nodes(_newick(t)).drop("tree_id")


def _pairing(t):
    """A binary tree over the nations of each region: leaves 1 to n, inner nodes above, as caterpillars."""
    from pyspark.sql import Window as W

    n = t.read("nation").select(F.col("n_regionkey").alias("tree_id"), F.col("n_nationkey").cast("long").alias("id"))
    w = W.partitionBy("tree_id")
    leaf = n.join(t.nations, "id").withColumn("k", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count("*").over(w))
    # leaf k hangs on inner node n + k - 1 (the first on that of the second); inner nodes form a chain up to 2n - 1
    tips = leaf.select("tree_id", F.col("k").alias("node"), (F.col("n") + F.greatest(F.col("k") - 1, F.lit(1))).cast("int").alias("parent"), "seq")
    inner = leaf.where("k < n").select("tree_id", (F.col("n") + F.col("k")).cast("int").alias("node"), F.when(F.col("k") < F.col("n") - 1, F.col("n") + F.col("k") + 1).cast("int").alias("parent"), F.lit(None).cast("string").alias("seq"))
    return tips, inner


@query()
def max_parsimony(t):
    tips, inner = _pairing(t)
    return tree.max_parsimony(tips.unionByName(inner))


def _unrooted(t):
    """The same without the root: the two arcs at the top become one edge."""
    tips, inner = _pairing(t)
    nodes = tips.unionByName(inner)
    top = nodes.where("parent is null").select("tree_id", F.col("node").alias("top"))
    low = nodes.join(top, "tree_id").where("parent = top").groupBy("tree_id").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    rest = nodes.join(top, "tree_id").where("parent <> top").select("tree_id", F.col("node").alias("u"), F.col("parent").alias("v"))
    return rest.unionByName(low), tips.select("tree_id", "node", "seq")


@query()
def max_parsimony_unrooted(t):
    return tree.max_parsimony_unrooted(*_unrooted(t))


_LEAVES = "SELECT n_regionkey AS tree_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, s FROM nat JOIN nation ON id = n_nationkey"
_SITES = "SELECT tree_id, k, i, substr(s, i, 1) AS b FROM (SELECT *, unnest(range(1, 33)::INT[]) AS i FROM l)"
_FIRST = "SELECT p.tree_id, p.i, q.k, " + ", ".join(f"(p.b <> '{b}')::INT + (q.b <> '{b}')::INT AS {b}" for b in "ACTG") + " FROM x p JOIN x q ON p.tree_id = q.tree_id AND p.i = q.i AND p.k = 1 AND q.k = 2"
_NEXT = "SELECT x.tree_id, x.i, x.k, " + ", ".join(f"least({b}, least(A, C, T, G) + 1) + (x.b <> '{b}')::INT" for b in "ACTG") + " FROM r JOIN x ON x.tree_id = r.tree_id AND x.i = r.i AND x.k = r.k + 1"
#: Least changes of the caterpillar of each region's nations, leaf by leaf: a cost for each base at the inner node.
_CHANGES = with_sql("nat", l=_LEAVES, x=_SITES, r=f"{_FIRST} UNION ALL {_NEXT}") + (
    "SELECT tree_id, CAST(sum(least(A, C, T, G)) AS BIGINT) AS cost FROM r WHERE (tree_id, k) IN (SELECT tree_id, max(k) FROM x GROUP BY 1) GROUP BY 1"
)


@query(_CHANGES)
def parsimony_cost(t):
    tips, inner = _pairing(t)
    return tree.max_parsimony(tips.unionByName(inner)).groupBy("tree_id").agg(F.sum("cost").cast("long").alias("cost"))


@query(_CHANGES)
def parsimony_cost_unrooted(t):
    """The place of the root does not change the least number of changes."""
    return tree.max_parsimony_unrooted(*_unrooted(t)).groupBy("tree_id").agg(F.sum("cost").cast("long").alias("cost"))


@query()
def parsimony_search(t):
    return tree.max_parsimony_unrooted(*_unrooted(t), improve=True)


@query(
    with_sql("tree")
    + "SELECT CASE WHEN u = 1 AND v = 6 THEN 2 WHEN u = 2 AND v = 7 THEN 1 ELSE u END AS u, v FROM (SELECT parent AS u, node AS v FROM tree WHERE parent IS NOT NULL)"
)
def swap_edges(t):
    e = t.tree.where("parent is not null").select(F.col("parent").alias("u"), F.col("node").alias("v"))
    return tree.swap_edges(e, 1, 6, 2, 7)


@query(with_sql("tree", b="SELECT parent AS u, node AS v FROM tree WHERE parent IS NOT NULL UNION ALL SELECT node, parent FROM tree WHERE parent IS NOT NULL") + "SELECT u AS \"end\", v AS node FROM b WHERE u IN (0, 1) AND v NOT IN (0, 1)")
def sub_trees(t):
    e = t.tree.where("parent is not null").select(F.col("parent").alias("u"), F.col("node").alias("v"))
    return tree.sub_trees(e, 0, 1)
