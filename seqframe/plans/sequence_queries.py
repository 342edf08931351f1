"""Queries over single sequences, k-mers and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..alphabet import CODONS, IUPAC, IUPAC_COMPLEMENT
from ..functions import pairs
from ..functions import seq as S
from ..operators import distance, kmers, neighbours, search
from .tables import kmers_sql, query, with_sql

_DOCS = "SELECT doc_id AS id, coalesce(text, '') AS s FROM documents"
_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _docs(t):
    return t.read("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("seq"))


def _null_nan(c):
    return F.when(~F.isnan(c), F.round(c, 6))


# ---- one sequence ---------------------------------------------------------------


@query(f"SELECT doc_id AS id, translate(coalesce(text, ''), '{_LO}', '{_UP}') AS up, translate(coalesce(text, ''), '{_UP}', '{_LO}') AS low FROM documents")
def ascii_case(t):
    return _docs(t).select("id", S.to_upper("seq").alias("up"), S.to_lower("seq").alias("low"))


@query(with_sql("dna") + "SELECT id, reverse(s) AS r FROM dna")
def reverse(t):
    return t.dna.select("id", S.reverse("seq").alias("r"))


@query(with_sql("dna") + "SELECT id, translate(s, 'Tt', 'Uu') AS rna FROM dna")
def transcribe(t):
    return t.dna.select("id", S.transcribe("seq").alias("rna"))


@query(f"SELECT doc_id AS id, reverse(translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{IUPAC}', '{IUPAC_COMPLEMENT}')) AS rc FROM documents")
def iupac_reverse_complement(t):
    letters = _docs(t).withColumn("seq", F.regexp_replace("seq", "[^A-Za-z]", ""))
    return letters.select("id", S.reverse_complement("seq").alias("rc"))


@query(with_sql("dna") + "SELECT id, reverse(translate(s, 'ACTGactg', 'TGACtgac')) AS rc FROM dna")
def reverse_complement(t):
    return t.dna.select("id", S.reverse_complement8("seq").alias("rc"))


_COUNTS = ", ".join(f"CAST(length(s) - length(translate(s, '{b.upper()}{b}', '')) AS BIGINT) AS {b}" for b in "actg")


@query(with_sql("dna") + f"SELECT id, {_COUNTS} FROM dna")
def base_freq(t):
    return t.dna.select("id", *[c.alias(b) for b, c in S.base_counts("seq").items()])


@query(
    with_sql("dna", n=f"SELECT id, s, {_COUNTS} FROM dna")
    + "SELECT id, CASE WHEN a+c+t+g > 0 THEN round(CAST(c+g AS DOUBLE) / (a+c+t+g), 6) END AS gc,"
    " CASE WHEN length(s) > 0 THEN round(CAST(c+g AS DOUBLE) / length(s), 6) END AS gc8 FROM n"
)
def gc_content(t):
    return t.dna.select("id", _null_nan(S.gc_content("seq")).alias("gc"), _null_nan(S.gc_content8("seq")).alias("gc8"))


@query(with_sql("dna", k=kmers_sql("dna", 1)) + "SELECT id, kmer AS sym, count(*) AS n FROM k GROUP BY ALL")
def symbol_freq(t):
    return kmers.symbols(t.dna).groupBy("id", "sym").agg(F.count("*").alias("n"))


_CUM = "SELECT id, pos, sum(CASE upper(kmer) WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS x FROM k"


@query(
    with_sql("dna", k=kmers_sql("dna", 1), c=_CUM)
    + "SELECT id, pos FROM (SELECT *, least(0, min(x) OVER (PARTITION BY id)) AS m FROM c) WHERE x = m"
)
def min_gc_skew(t):
    return kmers.min_skew(t.dna).select("id", F.col("pos").cast("long").alias("pos"))


def _residue_sql(s: str, i: str) -> str:
    bits = " + ".join(f"(ascii(substr({s}, CAST({i} + {k} AS INT), 1)) & 6) {op}" for k, op in ((0, "* 8"), (1, "* 2"), (2, "// 2")))
    return f"substr('{CODONS}', CAST({bits} + 1 AS INT), 1)"


def _frame_sql(s: str, f: int) -> str:
    return f"array_to_string(list_transform(range(0, (length({s}) - {f}) // 3), lambda k: {_residue_sql(s, f'3 * k + {f + 1}')}), '')"


@query(with_sql("dna", p=f"SELECT id, {_frame_sql('s', 0)} AS p FROM dna") + "SELECT id, split_part(p, '*', 1) AS peptide, contains(p, '*') AS stop FROM p")
def translate(t):
    return t.dna.select("id", S.translate("seq").alias("x")).select("id", "x.peptide", "x.stop")


@query(
    with_sql("dna", k=kmers_sql("dna", 3), c="SELECT upper(kmer) AS codon, count(*) AS n FROM k GROUP BY 1")
    + f"SELECT codon, n, {_residue_sql('codon', '1')} AS residue, codon = 'ATG' AS start FROM c"
)
def codon_usage(t):
    n = kmers.kmers(t.dna, 3, fold=True).groupBy(F.col("kmer").alias("codon")).agg(F.count("*").alias("n"))
    return n.select("codon", "n", S.translate_codon(F.col("codon")).alias("residue"), S.is_start_codon(F.col("codon")).alias("start"))


_FRAMES = " UNION ALL ".join(
    f"SELECT id, {strand} AS strand, {f} AS frame, length(s) AS n, {_frame_sql('s', f)} AS r FROM {src}" for strand, src in ((1, "dna"), (-1, "rc")) for f in range(3)
)
_RC = "SELECT id, reverse(translate(s, 'ACTGactg', 'TGACtgac')) AS s FROM dna"


@query(
    with_sql("dna", rc=_RC, f=_FRAMES, m="SELECT id, r, unnest(range(1, length(r) + 1)) AS i FROM f")
    + "SELECT DISTINCT id, split_part(substr(r, CAST(i AS INT)), '*', 1) AS peptide FROM m WHERE substr(r, CAST(i AS INT), 1) = 'M' AND contains(substr(r, CAST(i AS INT)), '*')"
)
def open_reading_frames(t):
    return search.open_reading_frames(t.dna)


_SITES = "SELECT id, CASE strand WHEN 1 THEN 3 * (i - 1) + frame ELSE n - 3 * (i - 1) - frame - 6 END AS pos, strand FROM (SELECT *, unnest(range(1, length(r))) AS i FROM f) WHERE substr(r, CAST(i AS INT), 2) = 'LS'"


@query(with_sql("dna", rc=_RC, f=_FRAMES, h=_SITES) + "SELECT id, CAST(pos AS BIGINT) AS pos, strand FROM h")
def aa_find(t):
    return search.peptide_sites(t.dna, "LS").select("id", F.col("pos").cast("long").alias("pos"), "strand")


@query(with_sql("dna", rc=_RC, f=_FRAMES, h=_SITES) + "SELECT DISTINCT id, CAST(pos AS BIGINT) AS pos FROM h")
def aa_find_distinct(t):
    return search.peptide_sites(t.dna, "LS", distinct=True).select("id", F.col("pos").cast("long").alias("pos"))


# ---- searches -------------------------------------------------------------------


@query(with_sql("dna", k=kmers_sql("dna", 4)) + "SELECT id, pos FROM k WHERE kmer = 'tata'")
def all_index(t):
    return t.dna.select("id", F.explode(S.all_index("seq", "tata").cast("array<bigint>")).alias("pos"))


@query(with_sql("dna", k=kmers_sql("dna", 4, True)) + "SELECT d.id, count(kmer) AS n FROM dna d LEFT JOIN (SELECT * FROM k WHERE kmer = 'TATA') k USING (id) GROUP BY 1")
def all_count(t):
    return t.dna.select("id", S.all_count("seq", "TATA", fold=True).cast("long").alias("n"))


@query(with_sql("dna") + "SELECT id, CAST(instr(s, 'tcat') - 1 AS BIGINT) AS pos FROM dna")
def first_index(t):
    return t.dna.select("id", S.first_index("seq", "tcat").cast("long").alias("pos"))


@query(with_sql("dna", k=kmers_sql("dna", 6, True)) + "SELECT id, pos FROM k WHERE hamming(kmer, 'TCATAT') <= 1")
def hamming_search(t):
    s = t.dna.withColumn("seq", S.to_upper("seq"))
    return s.select("id", F.explode(S.hamming_all_index("seq", "TCATAT", 1).cast("array<bigint>")).alias("pos"))


@query(
    with_sql("mers", k=kmers_sql("mers", 6), d="SELECT *, hamming(kmer, 'TCATGA') AS d FROM k")
    + "SELECT id, list(kmer ORDER BY pos) AS kmers FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM d) WHERE d = m GROUP BY 1"
)
def nearest_motif(t):
    return t.orders.select("id", S.nearest_kmers("seq", "TCATGA").alias("kmers"))


@query(with_sql("mers", k=kmers_sql("mers", 6)) + "SELECT id, CAST(min(hamming(kmer, 'TCATGA')) AS BIGINT) AS d FROM k GROUP BY 1")
def motif_hamming(t):
    return t.orders.select("id", S.motif_hamming("seq", "TCATGA").cast("long").alias("d"))


@query(with_sql("mers", k=kmers_sql("mers", 6)) + "SELECT CAST(sum(d) AS BIGINT) AS hamming FROM (SELECT id, min(hamming(kmer, 'TCATGA')) AS d FROM k GROUP BY 1)")
def motif_hamming_total(t):
    return distance.motif_total(t.orders, "TCATGA")


@query("SELECT doc_id AS id, regexp_replace(coalesce(text, ''), 'the|th|en', '', 'g') AS s FROM documents")
def splice(t):
    return _docs(t).select("id", S.splice("seq", ["the", "th", "en"]).alias("s"))


@query(
    with_sql(
        "dna",
        u="SELECT id, upper(s) AS s FROM dna",
        c="SELECT id, s, unnest(range(1, length(s))) AS c FROM u",
        h="SELECT *, unnest([2, 3, 4]) AS h FROM c",
    )
    + "SELECT id, c - h AS pos, CAST(2 * h AS BIGINT) AS len FROM h WHERE h <= c AND h <= length(s) - c"
    " AND substr(s, CAST(c - h + 1 AS INT), h) = reverse(translate(substr(s, CAST(c + 1 AS INT), h), 'ACTG', 'TGAC'))"
)
def palindromes(t):
    p = t.dna.select("id", F.explode(S.palindromes("seq", 4, 8)).alias("p"))
    return p.select("id", F.col("p.pos").cast("long").alias("pos"), F.col("p.len").cast("long").alias("len"))


_SUFFIX = "SELECT id, i - 1 AS sa, substr(s || '$', CAST(i AS INT)) AS x, CASE WHEN i > 1 THEN substr(s, CAST(i - 1 AS INT), 1) ELSE '$' END AS bwt FROM (SELECT id, s, unnest(range(1, length(s) + 2)) AS i FROM nat)"


@query(with_sql("nat", x=_SUFFIX) + "SELECT id, row_number() OVER (PARTITION BY id ORDER BY x) - 1 AS rank, sa, bwt FROM x")
def bwt_index(t):
    got = search.suffix_index(t.nations)
    return got.select("id", F.col("rank").cast("long").alias("rank"), F.col("sa").cast("long").alias("sa"), "bwt")


@query(with_sql("mers", x=_SUFFIX.replace("FROM nat", "FROM mers")) + "SELECT id, sa AS pos, row_number() OVER (PARTITION BY id ORDER BY x) - 1 AS ord FROM x WHERE starts_with(x, 'CA')")
def bwt_search(t):
    got = search.index_search(t.orders, "CA")
    return got.select("id", F.col("pos").cast("long").alias("pos"), F.col("ord").cast("long").alias("ord"))


@query(with_sql("mers", "dna") + "SELECT (SELECT min(length(s)) = max(length(s)) FROM mers) AS mers, (SELECT min(length(s)) = max(length(s)) FROM dna) AS dna, (SELECT max(length(s)) FROM dna) AS longest")
def uniform(t):
    a, b, c = search.is_uniform(t.orders), search.is_uniform(t.dna), search.longest(t.dna)
    return a.select(F.col("uniform").alias("mers")).join(b.select(F.col("uniform").alias("dna"))).join(c.select(F.col("n").cast("long").alias("longest")))


@query(with_sql("supp") + "SELECT id, row_number() OVER (ORDER BY length(x), translate(x, 'aAcCtTgG', '01234567'), id) - 1 AS ord FROM (SELECT id, substr(lower(s), 1, CAST(id % 3 + 2 AS INT)) || substr(s, 9, 3) AS x FROM supp)")
def dna8_sort(t):
    from ..operators.stages import numbered

    x = F.concat(F.substring(S.to_lower("seq"), F.lit(1), (F.col("id") % 3 + 2).cast("int")), F.substring("seq", 9, 3))
    key = S.sort_key("seq")
    rows = t.suppliers.select("id", x.alias("seq")).select("id", key["n"].alias("n"), key["s"].alias("s"))
    return numbered(rows, "n", "s", "id").select("id", "ord")


_MIXED = "SELECT id, CASE WHEN id % 2 = 1 THEN lower(s) ELSE s END AS s FROM supp"


def _mixed(t):
    """The suppliers' sequences, every second one in small letters."""
    return t.suppliers.withColumn("seq", F.when(F.col("id") % 2 == 1, F.lower("seq")).otherwise(F.col("seq")))


@query(with_sql("dna", k=kmers_sql("dna", 4, True)) + "SELECT id, pos FROM k WHERE kmer = 'TATA'")
def all_index_any_case(t):
    return t.dna.select("id", F.explode(S.all_index("seq", "TaTa", fold=True).cast("array<bigint>")).alias("pos"))


@query(with_sql("supp", x=_MIXED) + "SELECT a.id AS i, b.id AS j, CAST(hamming(upper(a.s), upper(b.s)) AS BIGINT) AS d FROM x a JOIN x b ON a.id < b.id")
def hamming_any_case(t):
    return distance.block_matrix(_mixed(t).withColumn("seq", S.to_upper("seq")), pairs.hamming)


@query(
    with_sql("supp", x=_MIXED, k=kmers_sql("x", 6, True), d="SELECT *, hamming(kmer, 'TCATGA') AS d FROM k")
    + "SELECT id, list(kmer ORDER BY pos) AS kmers FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM d) WHERE d = m GROUP BY 1"
)
def nearest_motif_any_case(t):
    return _mixed(t).select("id", S.nearest_kmers("seq", "tcATGA", fold=True).alias("kmers"))


@query(
    with_sql("supp", x=_MIXED, k=kmers_sql("x", 3, True), c="SELECT id, kmer, count(*) AS n FROM k GROUP BY ALL", p="SELECT a.id AS i, b.id AS j FROM x a JOIN x b ON a.id < b.id")
    + "SELECT i, j, CAST(sum(abs(x)) AS BIGINT) AS d FROM (SELECT i, j, kmer, sum(n) AS x FROM (SELECT i, j, kmer, n FROM p JOIN c ON id = i UNION ALL SELECT i, j, kmer, -n FROM p JOIN c ON id = j) GROUP BY ALL) GROUP BY ALL"
)
def kmer_distance_any_case(t):
    return kmers.composition_distance(_mixed(t), 3, fold=True)


@query(
    with_sql("dna", k=kmers_sql("dna", 3), c="SELECT upper(kmer) AS codon, count(*) AS n FROM k GROUP BY 1", o="SELECT codon, n, translate(codon, 'ACTG', 'TGAC') AS opposite FROM c")
    + f"SELECT codon, n, {_residue_sql('opposite', '1')} AS residue FROM o"
)
def opposite_codon_usage(t):
    n = kmers.kmers(t.dna, 3, fold=True).groupBy(F.col("kmer").alias("codon")).agg(F.count("*").alias("n"))
    return n.select("codon", "n", S.translate_codon(F.col("codon"), of_complement=True).alias("residue"))


@query(
    with_sql(
        "dna",
        k=kmers_sql("dna", 1),
        n="SELECT id, ascii(kmer) AS code, count(*) AS n FROM k GROUP BY ALL",
        g="SELECT d.id, code, coalesce(n, 0) AS n FROM dna d CROSS JOIN (SELECT unnest(range(0, 256)) AS code) LEFT JOIN n USING (id, code)",
    )
    + "SELECT id, list(n ORDER BY code) AS freq FROM g GROUP BY 1"
)
def byte_histogram(t):
    return kmers.histogram(t.dna)


@query(with_sql("supp", u="SELECT id, CASE WHEN id % 2 = 0 THEN replace(s, 'T', 'U') ELSE lower(s) END AS s FROM supp") + "SELECT id, " + ", ".join(f"CAST(length(s) - length(translate(s, '{x.upper()}{x}{'Uu' if x == 't' else ''}', '')) AS BIGINT) AS {x}" for x in "actg") + " FROM u")
def base_freq_of_rna(t):
    s = F.when(F.col("id") % 2 == 0, F.replace("seq", F.lit("T"), F.lit("U"))).otherwise(F.lower("seq"))
    return t.suppliers.select("id", *[c.alias(b) for b, c in S.base_counts(s).items()])


# ---- k-mers ---------------------------------------------------------------------


@query(with_sql("dna", k=kmers_sql("dna", 4)) + "SELECT id, kmer, count(*) AS n FROM k GROUP BY ALL")
def kmer_composition(t):
    return kmers.composition(t.dna, 4)


_CODE2 = "4 * (instr('ACTG', substr(kmer, 1, 1)) - 1) + instr('ACTG', substr(kmer, 2, 1)) - 1"


@query(
    with_sql(
        "dna",
        k=kmers_sql("dna", 2, True),
        n=f"SELECT id, {_CODE2} AS code, count(*) AS n FROM k GROUP BY ALL",
        g="SELECT id, code, coalesce(n, 0) AS n FROM (SELECT DISTINCT id FROM n) CROSS JOIN (SELECT unnest(range(0, 16)) AS code) LEFT JOIN n USING (id, code)",
    )
    + "SELECT d.id, coalesce(f, CAST([] AS BIGINT[])) AS freq FROM dna d LEFT JOIN (SELECT id, list(n ORDER BY code) AS f FROM g GROUP BY 1) USING (id)"
)
def freq_array(t):
    return kmers.frequency_array(t.dna, 2)


_MODAL = "SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM (SELECT id, kmer, count(*) AS n, max(pos) AS last FROM k GROUP BY ALL)"


@query(with_sql("dna", k=kmers_sql("dna", 3), m=_MODAL) + "SELECT id, kmer, n, row_number() OVER (PARTITION BY id ORDER BY last) - 1 AS ord FROM m WHERE r = 1")
def modal_kmers(t):
    got = kmers.modal(t.dna, 3)
    return got.withColumn("ord", F.col("ord").cast("long"))


@query(with_sql("dna", k=kmers_sql("dna", 2, True), m=_MODAL) + f"SELECT id, kmer, n, row_number() OVER (PARTITION BY id ORDER BY {_CODE2}) - 1 AS ord FROM m WHERE r = 1")
def modal_small_kmers(t):
    return kmers.modal(t.dna, 2, fold=True).withColumn("ord", F.col("ord").cast("long"))


@query(with_sql("dna", k=kmers_sql("dna", 3, True)) + "SELECT DISTINCT id, kmer FROM k")
def unique_kmers(t):
    return kmers.unique(t.dna, 3)


@query(with_sql("dna", k=kmers_sql("dna", 4), p="SELECT *, lag(pos, 2) OVER (PARTITION BY id, kmer ORDER BY pos) AS b FROM k") + "SELECT DISTINCT id, kmer FROM p WHERE pos - b <= 20 - 4")
def proximal_repeats(t):
    return kmers.proximal_repeats(t.dna, 4, 20, 3)


@query(with_sql("mers", k=kmers_sql("mers", 5)) + "SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def read_break(t):
    return kmers.read_break(t.orders, 5)


@query(with_sql("supp", p="SELECT id, substr(s, i, 3) AS a, substr(s, i + 5, 3) AS b FROM (SELECT id, s, unnest(range(1, length(s) - 8 + 2)) AS i FROM supp)") + "SELECT id, a, b, count(*) AS n FROM p GROUP BY ALL")
def read_pairs(t):
    return kmers.read_pairs(t.suppliers, 3, 2)


@query(
    with_sql("mers", p="SELECT substr(s, i, 4) AS a, substr(s, i + 16, 4) AS b FROM (SELECT s, unnest(range(1, 8)) AS i FROM (SELECT substr(s, 1, 10) || substr(s, 11, 6) || substr(s, 17, 10) AS s FROM mers))")
    + "SELECT 12 AS d, a, b, count(*) AS n FROM p GROUP BY ALL"
)
def pair_read_break(t):
    pairs = t.orders.select(F.lit(6).alias("d"), F.substring("seq", 1, 10).alias("a"), F.substring("seq", 17, 10).alias("b"))
    return kmers.pair_read_break(pairs, 4)


_KC = "SELECT id, kmer, count(*) AS n FROM k GROUP BY ALL"


@query(
    with_sql("supp", k=kmers_sql("supp", 3), c=_KC, p="SELECT a.id AS i, b.id AS j FROM supp a JOIN supp b ON a.id < b.id")
    + "SELECT i, j, CAST(sum(abs(x)) AS BIGINT) AS d FROM (SELECT i, j, kmer, sum(n) AS x FROM (SELECT i, j, kmer, n FROM p JOIN c ON id = i UNION ALL SELECT i, j, kmer, -n FROM p JOIN c ON id = j) GROUP BY ALL) GROUP BY ALL"
)
def kmer_distance_matrix(t):
    return kmers.composition_distance(t.suppliers, 3)


@query("SELECT c_custkey AS id, c_acctbal AS score FROM (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r <= 25")
def top_n_ties(t):
    rows = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return kmers.top_with_ties(rows, F.col("score"), 25)


@query(with_sql("nat") + "SELECT n_regionkey AS region, array_to_string(list(substr(s, 1, 5) ORDER BY id), '') AS key FROM nat JOIN nation ON id = n_nationkey GROUP BY 1")
def kmer_list_key(t):
    n = t.read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("region"))
    each = F.array_sort(F.collect_list(F.struct("id", F.substring("seq", 1, 5).alias("k"))))
    return t.nations.join(n, "id").groupBy("region").agg(F.array_join(F.transform(each, lambda x: x["k"]), "").alias("key"))


@query(
    "SELECT doc_id AS id, regexp_extract(h, '^>([^ ]*)', 1) AS name, CASE WHEN contains(h, ' ') THEN substr(h, instr(h, ' ') + 1) ELSE '' END AS descr"
    " FROM (SELECT doc_id, '>' || coalesce(source, '') || '|' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ' lang ' || coalesce(lang, '') ELSE '' END AS h FROM documents)"
)
def fasta_headers(t):
    h = F.concat(F.lit(">"), F.coalesce("source", F.lit("")), F.lit("|"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" lang "), F.coalesce("lang", F.lit("")))).otherwise(""))
    return t.read("documents").select(F.col("doc_id").alias("id"), S.fasta_id(h).alias("name"), S.fasta_description(h).alias("descr"))


# ---- neighbourhoods -------------------------------------------------------------

_VARIANTS = "SELECT DISTINCT id, substr(kmer, 1, CAST(i - 1 AS INT)) || b || substr(kmer, CAST(i + 1 AS INT)) AS v FROM (SELECT id, kmer, unnest(range(1, length(kmer) + 1)) AS i FROM k) CROSS JOIN (SELECT unnest(['A', 'C', 'T', 'G']) AS b)"


@query(with_sql("nat", k="SELECT id, s AS kmer FROM nat", v=_VARIANTS) + "SELECT id, v AS kmer FROM v")
def hamming_variants(t):
    return t.nations.select("id", F.explode(neighbours.variants("seq", 1)).alias("kmer"))


@query(with_sql("nat", k="SELECT id, s AS kmer FROM nat", v=_VARIANTS, w=_VARIANTS.replace("FROM k)", "FROM (SELECT id, v AS kmer FROM v))")) + "SELECT id, v AS kmer FROM w")
def hamming_variants_two(t):
    return t.nations.select("id", F.explode(neighbours.variants("seq", 2)).alias("kmer"))


@query(
    "SELECT p_partkey AS id, CAST(1 + 3 * k + 9 * (k * (k - 1) // 2) + 27 * (k * (k - 1) * (k - 2) // 6) AS VARCHAR) AS n FROM (SELECT p_partkey, CAST(p_size AS HUGEINT) AS k FROM part)"
)
def number_of_variants(t):
    p = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("k"))
    return p.select("id", neighbours.number_of_variants_column("k", 3).cast("string").alias("n"))


@query(with_sql("supp", k=kmers_sql("supp", 4), v=_VARIANTS) + "SELECT DISTINCT id, v AS kmer FROM v")
def unique_hamming_kmers(t):
    return neighbours.unique_variants(t.suppliers, 4, 1)


def _modal_variants_sql(k: str) -> str:
    one = "SELECT DISTINCT id, kmer, n, substr(kmer, 1, CAST(i - 1 AS INT)) || b || substr(kmer, CAST(i + 1 AS INT)) AS v FROM (SELECT id, kmer, n, unnest(range(1, length(kmer) + 1)) AS i FROM c) CROSS JOIN (SELECT unnest(['A', 'C', 'T', 'G']) AS b)"
    return with_sql("supp", k=k, c=_KC, v=one, s="SELECT id, v AS kmer, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY ALL") + (
        "SELECT id, kmer, n FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM s) WHERE r = 1"
    )


@query(_modal_variants_sql(kmers_sql("supp", 4)))
def modal_hamming_kmers(t):
    return neighbours.modal_variants(t.suppliers, 4, 1)


@query(_modal_variants_sql(f"SELECT id, unnest([kmer, reverse(translate(kmer, 'ACTG', 'TGAC'))]) AS kmer FROM ({kmers_sql('supp', 4)})"))
def modal_hamming_kmers_rc(t):
    return neighbours.modal_variants(t.suppliers, 4, 1, both_strands=True)


@query(with_sql("nat", k=kmers_sql("nat", 4), v=_VARIANTS) + "SELECT v AS kmer FROM v GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM nat)")
def planted_motifs(t):
    return neighbours.planted_motifs(t.nations, 4, 1)


_ALL3 = "SELECT a || b || c AS m FROM (SELECT unnest(['A','C','T','G']) AS a) CROSS JOIN (SELECT unnest(['A','C','T','G']) AS b) CROSS JOIN (SELECT unnest(['A','C','T','G']) AS c)"


@query(
    with_sql("supp", k=kmers_sql("supp", 3), a=_ALL3, d="SELECT m, id, min(hamming(m, kmer)) AS d FROM a CROSS JOIN (SELECT DISTINCT id, kmer FROM k) GROUP BY ALL", s="SELECT m AS kmer, CAST(sum(d) AS BIGINT) AS hamming FROM d GROUP BY 1")
    + "SELECT * FROM s WHERE hamming = (SELECT min(hamming) FROM s)"
)
def median_motifs(t):
    return neighbours.median_motifs(t.suppliers, 3)


# ---- pairs of sequences ---------------------------------------------------------

_PAIRS = "SELECT a.id AS i, b.id AS j, a.s, b.s AS t FROM supp a JOIN supp b ON a.id < b.id"


@query(with_sql("supp", p=_PAIRS) + "SELECT i, j, CAST(hamming(s, t) AS BIGINT) AS d FROM p")
def hamming_matrix(t):
    return distance.block_matrix(t.suppliers, pairs.hamming)


@query(with_sql("nat", p="SELECT a.id AS i, b.id AS j, a.s, b.s AS t FROM nat a CROSS JOIN nat b") + "SELECT i, j, round(hamming(s, t) / 32.0::DOUBLE, 6) AS d FROM p")
def p_distance_matrix(t):
    got = distance.matrix(t.nations, S.p_distance, full=True)
    return got.withColumn("d", F.round(F.col("d").cast("double"), 6))


_TT = "SELECT i, j, s, t, CAST(len(list_filter(range(1, 33), lambda k: (substr(s, CAST(k AS INT), 1) || substr(t, CAST(k AS INT), 1)) IN ('AG', 'GA', 'CT', 'TC'))) AS DOUBLE) AS ti, CAST(hamming(s, t) AS DOUBLE) AS h FROM p"


@query(with_sql("supp", p=_PAIRS, x=_TT) + "SELECT i, j, CASE WHEN h > ti THEN round(ti / (h - ti), 6) END AS r FROM x")
def titv_ratio(t):
    got = distance.block_matrix(t.suppliers.withColumn("seq", S.to_upper("seq")), pairs.titv, "double")
    finite = ~F.isnan("d") & (F.col("d") < float("inf"))
    return got.select("i", "j", F.when(finite, F.round("d", 6)).alias("r"))
