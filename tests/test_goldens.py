"""Known results of single operators, and invariants of those that search."""

import random

import pytest
from pyspark.sql import functions as F

from seqframe.alphabet import BLOSUM62, PAM250
from seqframe.functions import digest, parsimony, sites
from seqframe.functions import seq as S
from seqframe.functions import spectrum as P
from seqframe.operators import align, assembly, distance, kmers, motif, neighbours, profile, search, tree
from seqframe.sources import fasta, newick


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def L(x):
    return F.lit(x)


def test_scalars(spark):
    got = one(
        spark, S.to_upper(L("AGgCT-AC?")), S.to_lower(L("AGgCT-AC?")), S.transcribe(L("Tristan")), S.reverse_complement(L("Atacama")),
        S.reverse_complement8(L("Atacaga")), F.round(S.gc_content(L("carrot")), 3), F.round(S.gc_content8(L("cagggt")), 3),
        S.all_count(L("Atatgatatat"), "atat", True), S.first_index(L("abaababaab"), "ababaa"),
        F.round(S.titv(L("gggcttt"), L("Atacama")), 3), S.motif_hamming(L("gtgaaactt"), "caa"), S.hamming(L("CATTAG"), L("catagg"), True),
    )
    assert list(got) == ["AGGCT-AC?", "aggct-ac?", "Urisuan", "tktgtaT", "tctgtaT", 0.333, 0.667, 3, 3, 0.667, 1, 2]
    assert one(spark, F.isnan(S.gc_content(L("xyz"))))[0]


def test_arrays(spark):
    got = one(
        spark, S.all_index(L("Atatgatatat"), "atat"), S.all_index(L("Atatgatatat"), "atat", True), S.all_index(L("abaababaababaa"), "ababaa"),
        S.nearest_kmers(L("gtgaaactt"), "caa", True), S.all_index(L("abc"), ""), S.windows(L("ab"), 3),
    )
    assert list(got) == [[5, 7], [0, 5, 7], [3, 8], ["GAA", "AAA"], [], []]
    assert [tuple(x) for x in one(spark, S.palindromes(L("CAATGCATG"), 4, 8))[0]] == [(3, 4), (2, 6), (5, 4)]


def test_translation(spark, seqs):
    assert tuple(one(spark, S.translate(L("AugGcgAacAauUacUga")))[0]) == ("MANNY", True)
    got = search.open_reading_frames(seqs("ctATGatcttctCATactacacATGtaCATaacccc"))
    assert {r["peptide"] for r in got.collect()} == {"MCSMRRS", "MIFSYYTCT", "MRRS", "MYMCSMRRS"}
    dna = "TCCTGAACGTTTAAATGTCCAACGGCTGAACGTTCAAT"
    hits = search.peptide_sites(seqs(dna), "LNVQ").collect()
    assert sorted(r["pos"] for r in hits) == [2, 10, 25, 25]
    assert sites.find_sites(dna, "LNVQ") == [2, 10, 25]


def test_spectra(spark):
    masses = P.integer_masses(L("NQEL"))
    assert one(spark, P.linear_spectrum(masses))[0] == [0, 113, 114, 128, 129, 242, 242, 257, 370, 371, 484]
    assert one(spark, P.ideal_spectrum(F.array(L(57), L(97), L(57))))[0] == [0, 57, 57, 154, 154, 211]
    assert one(spark, P.cyclic_spectrum(F.array().cast("array<int>")))[0] == [0]


def test_kmers(spark, seqs):
    s = seqs("ACGCGGCTCTGAAA")
    assert kmers.frequency_array(s, 2).first()["freq"] == [2, 1, 0, 0, 0, 0, 2, 2, 0, 1, 0, 1, 1, 2, 0, 1]
    m = seqs("ACGTTGCATGTCGCATGATGCATGAGAGCT")
    assert [r["kmer"] for r in kmers.modal(m, 4).orderBy("ord").collect()] == ["GCAT", "CATG"]
    assert [r["kmer"] for r in kmers.modal(m, 4, True).orderBy("ord").collect()] == ["CATG", "GCAT"]
    assert sorted(r["pos"] for r in kmers.min_skew(seqs("accagtgct")).collect()) == [2, 3]
    d = {(r["i"], r["j"]): r["d"] for r in kmers.composition_distance(seqs("ATATATAG", "ATATATA", "GATATA"), 3).collect()}
    assert d == {(0, 1): 1, (0, 2): 4, (1, 2): 3}
    scores = spark.createDataFrame([(x,) for x in (3, 1, 4, 3, 2)], "x int")
    assert [kmers.top_with_ties(scores, -F.col("x"), n).count() for n in range(7)] == [0, 1, 2, 4, 4, 5, 5]


def test_neighbours(spark, seqs):
    want = "Act Cct Tct Gct Aat Att Agt Aca Acc Acg".split()
    assert sorted(one(spark, neighbours.variants(L("Act"), 1))[0]) == sorted(want)
    for s, d in (("actg", 0), ("cGG", 2), ("atacaga", 3)):
        assert len(one(spark, neighbours.variants(L(s), d))[0]) == neighbours.number_of_variants(len(s), d)
    assert neighbours.number_of_variants(1000, 10) == 15606547544311956375154416076
    s = seqs("aacaagcataaacattaaagag")
    assert [r["kmer"] for r in neighbours.modal_variants(s, 5, 1).collect()] == ["aaaaa"]
    both = {r["kmer"] for r in neighbours.modal_variants(s, 5, 1, both_strands=True).collect()}
    assert both == set("cttaa ttaaa tttaa ttaag aaaaa ttttt".split())
    five = seqs("AAATTGACGCAT", "GACGACCACGTT", "CGTCAGCGCCTG", "GCTGAGCACCGG", "AGTTCGGGACAG")
    assert [r["kmer"] for r in neighbours.planted_motifs(five, 4, 1).collect()] == ["GCAC"]
    assert [tuple(r) for r in neighbours.median_motifs(five, 3).collect()] == [("GAC", 2)]


def test_profiles(spark, seqs):
    s = seqs("GtCG", "GCtG", "GCCt", "cCCG", "GgCG")
    assert round(profile.entropy(profile.frac_profile(s)).first()[0], 2) == 3.54
    back = profile.base_shares(seqs("taaaaGtCGa", "acGCtGaaaa", "aaaaGCCtat", "acCCGaataa", "agaaaaGgCG"))
    frac = profile.frac_profile(s)
    assert round(profile.cross_entropy(frac, back).first()[0], 2) == 9.97
    assert round(profile.relative_entropy(frac, back).first()[0], 2) == 6.44
    assert tuple(profile.dna_consensus(seqs("GAT..ca", "AA##cgg", "GACrcca", "Gxxxaca", "GATmaca")).first()) == ("GAT-ACA", 20)


def test_motif_searches(spark, seqs):
    s = seqs("GGCGTTCAGGCA", "AAGAATCAGTCA", "CAAGGAGTTCGC", "CACGTCAATCAC", "CAATAATATTCG")
    got = motif.greedy_motifs(s, 3).collect()
    assert {r["hamming"] for r in got} == {2} and ["TTC", "ATC", "TTC", "ATC", "TTC"] in [r["kmers"] for r in got]
    for found in (motif.random_motif_search(s, 3, 50, 1), motif.gibbs_motif_search(s, 3, 20, 10, 1)):
        for r in found.collect():
            again = profile.consensus_hamming(spark.createDataFrame(list(enumerate(r["kmers"])), "id long, seq string")).first()[0]
            assert again == r["hamming"]


def test_gaps(spark):
    blosum, pam = S.matrix_score(BLOSUM62), S.matrix_score(PAM250)
    got = one(
        spark, S.linear_gap(L("PLEASANTLY"), L("-MEA--N-LY"), blosum, 5), S.linear_gap(L("LYPRTEINSTRIN"), L("LY---EINSTEIN"), pam, 5),
        S.constant_gap(L("PLEASANTLY"), L("-MEA--N-LY"), blosum, 5),
    )
    assert list(got) == [8, 23, 13]


def test_alignments():
    blosum, pam = align.Scores(BLOSUM62), align.Scores(PAM250)
    assert align.align("PLEASANTLY", "MEANLY", "global", blosum, 5) == (8, "PLEASANTLY", "-MEA--N-LY")
    assert align.align("MEANLY", "PENALTY", "local", pam, 5) == (15, "EANL-Y", "ENALTY")
    assert align.align("MEANLYPRTEINSTRING", "PLEASANTLYEINSTEIN", "local", pam, 5)[0] == 23
    assert align.align("TAGATA", "GTAGGCTTAAGGTTA", "fitting", align.Scores(), 1)[0] == 2
    assert align.align("PAWHEAE", "HEAGAWGHEE", "overlap", align.Scores(match=1, mismatch=-2), 2) == (1, "HEAE", "HEA-")
    rng = random.Random(1)
    for _ in range(60):
        s, t = ("".join(rng.choice("ACTG") for _ in range(rng.randint(0, 12))) for _ in "ab")
        score, a, b = align.align(s, t, "global", align.Scores(), 2)
        assert (a.replace("-", ""), b.replace("-", "")) == (s, t)
        assert score == sum(-2 if "-" in x else 1 if x[0] == x[1] else -1 for x in zip(a, b, strict=True))
        assert align.align_linear_space(s, t, align.Scores(), 2)[0] == score
        assert align.align_affine(s, t, align.Scores(), 2, 2)[0] == score


def test_assembly(spark, seqs):
    s = "TAATTATTAA"
    k = kmers.read_break(seqs(s), 4)
    arcs = {(r["src"], r["dst"]): r["n"] for r in assembly.de_bruijn(k).collect()}
    assert arcs == {("TAA", "AAT"): 1, ("AAT", "ATT"): 1, ("ATT", "TTA"): 2, ("TTA", "TAT"): 1, ("TTA", "TAA"): 1, ("TAT", "ATT"): 1}
    four = [x[i : i + 4] for x in ("ABCDEFGLMNO", "BCDHIJKLMN") for i in range(len(x) - 3)]
    got = assembly.contigs(spark.createDataFrame([(x,) for x in sorted(set(four))], "kmer string"))
    assert {r["seq"] for r in got.collect()} == {"ABCD", "BCDEFGLMN", "BCDHIJKLMN", "LMNO"}
    ring = spark.createDataFrame([(x,) for x in ("ABC", "BCA", "CAB")], "kmer string")
    assert [r["seq"] for r in assembly.contigs(ring).collect()] == ["ABCAB"]
    pairs = spark.createDataFrame([(2, "ABCD", "GHIJ"), (2, "CDEF", "IJKL")], "d int, a string, b string")
    broken = {(r["d"], r["a"], r["b"], r["n"]) for r in kmers.pair_read_break(pairs, 2).collect()}
    assert broken == {(4, "AB", "GH", 1), (4, "BC", "HI", 1), (4, "CD", "IJ", 2), (4, "DE", "JK", 1), (4, "EF", "KL", 1)}
    text = "TAATGCCATGGGATGTT"
    p = kmers.read_pairs(seqs(text), 3, 2).select(F.lit(2).alias("d"), "a", "b", "n")
    assert all(r["seq"] in text for r in assembly.pair_contigs(p).collect())


def test_partial_digest():
    left = {2: 2, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1}
    found = {tuple(sorted(p)) for p in digest.point_sets(left)}
    assert found == {(0, 3, 6, 8, 10), (0, 2, 4, 7, 10)}


def test_trees(spark):
    rows = newick.parse("((:11,:2):4,:6,:7);")
    cols = "node int, parent int, depth int, name string, weight double, is_leaf boolean"
    nodes = spark.createDataFrame(rows, cols).withColumn("tree_id", F.lit(0))
    d = {(r["a"], r["b"]): r["dist"] for r in tree.leaf_distances(nodes).collect()}
    assert d == {(2, 3): 13, (2, 4): 21, (2, 5): 22, (3, 4): 12, (3, 5): 13, (4, 5): 13}
    for text, want in (
        ("(dog,((elephant,mouse),cat),robot);", {"00111000", "01111100"}),
        ("((dog,((elephant,mouse),cat)))robot;", {"01110000", "11111000"}),
    ):
        n = spark.createDataFrame(newick.parse(text), cols).withColumn("tree_id", F.lit(0))
        assert {r["bits"] for r in tree.characters(n).collect()} == want
        assert newick.text(n).first()["text"] == text
    for bad in ("", "(a,b)", "(a,b;", "a,b;", "(a,b));", "(a:x);"):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_site_characters(spark, seqs):
    s = seqs("GCATTACC", "TTCGTACC", "TCATGACC", "TCAGTCCC", "TCCGTATC")
    assert {(r["bits"], r["pos"]) for r in tree.site_characters(s).collect()} == {("10010", 2), ("00101", 3)}


def test_parsimony(spark):
    leaves = ["CAAATCCC", "ATTGCGAC", "CTGCGCTG", "ATGGACGA"]
    rows = [(0, i, 4 + i // 2, s) for i, s in enumerate(leaves)] + [(0, 4, 6, None), (0, 5, 6, None), (0, 6, None, None)]
    got = tree.max_parsimony(spark.createDataFrame(rows, "tree_id int, node int, parent int, seq string")).collect()
    assert sum(r["cost"] for r in got) == 16
    assert {r["node"]: r["seq"] for r in got if r["node"] > 3} == {4: "ATAGACAC", 5: "ATGGACAA", 6: "ATAGACAA"}
    edges = [(0, 0, 4), (0, 1, 4), (0, 2, 5), (0, 3, 5), (0, 4, 5)]
    tips = list(enumerate(["TCGGCCAA", "CCTGGCTG", "CACAGGAT", "TGAGTACC"]))
    total = parsimony._label([e[1:] for e in edges], dict(tips))[0]
    assert total == 17


def test_matrix_and_nearest(spark, seqs):
    got = distance.matrix(seqs("TTTCCATTTA", "GATTCATTTC", "TTTCCATTTT", "GTTCCATTTA"), S.hamming, full=True)
    d = {(r["i"], r["j"]): r["d"] for r in got.collect()}
    assert [[d[i, j] for j in range(4)] for i in range(4)] == [[0, 4, 1, 1], [4, 0, 4, 3], [1, 4, 0, 2], [1, 3, 2, 0]]


def test_fasta(spark, tmp_path):
    assert list(fasta.parse(iter(">db|123|abc example sequence\r\nAGACCA\n\n TACCA\n".split("\n")))) == [
        (0, ">db|123|abc example sequence", "db|123|abc", "example sequence", "AGACCATACCA")
    ]
    with pytest.raises(ValueError):
        list(fasta.parse(iter(["ACGT"])))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x one\nAC\nGT\n>y\nTT\n")
    assert [tuple(r)[1:] for r in fasta.read(spark, str(tmp_path / "in")).orderBy("record_no").collect()] == [
        (">x one", "x", "one", "ACGT"), (">y", "y", "", "TT")]
    fasta.register(spark)
    assert spark.read.format("fasta").load(str(tmp_path / "in")).count() == 2


def test_fasta_of_many_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for k in range(7):
        records = [(f">>s{k}" if j == 1 else f">s{k}_{j} d", "ACGT" * (k + 1)) for j in range(3)]
        (folder / f"{k}.fa").write_text("\n" * (k % 3) + "".join(f"{h}\n{s[:5]}\n\n{s[5:]}\n" for h, s in records))
        want += records
    want = sorted(want)
    read = lambda path: sorted((r["header"], r["seq"]) for r in fasta.read(spark, str(path)).collect())
    assert read(folder) == want  # several files a task
    big = [(f">r{k} x", "ACGT" * (k % 50 + 1)) for k in range(3000)]
    (tmp_path / "big.fa").write_text("\n".join(f"{h}\n{s}" for h, s in big))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert fasta.read(spark, str(tmp_path / "big.fa")).rdd.getNumPartitions() > 3
        assert read(tmp_path / "big.fa") == sorted(big)  # one file over several tasks
        assert read(folder) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    fasta.register(spark)
    for path in (str(folder), f"file://{folder}", f"{folder}/*.fa"):
        assert sorted((r["header"], r["seq"]) for r in spark.read.format("fasta").load(path).collect()) == want
    (folder / "bad.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="No header"):
        fasta.read(spark, str(folder)).collect()
    assert len(fasta.read(spark, str(folder), strict=False).collect()) == len(want) + 1


def test_fasta_stream_takes_late_files_of_any_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.fa").write_text(">m one\nAC\nGT\n>>n\nTT\n")
    q = fasta.stream(spark, str(folder)).writeStream.format("memory").queryName("records").outputMode("append").start()
    try:
        q.processAllAvailable()
        (folder / "a.fa").write_text(">a\nGG\n")  # sorts before what was read
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["header"], r["seq"]) for r in spark.table("records").collect()) == [(">>n", "TT"), (">a", "GG"), (">m one", "ACGT")]


def test_running_profile(spark, tmp_path):
    from seqframe import streaming

    spark.createDataFrame([(0, "ACG"), (1, "ATG")], "id int, seq string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id int, seq string").parquet(str(tmp_path / "s"))
    q = streaming.running_profile(stream).writeStream.format("memory").queryName("profile").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["a"], r["c"], r["t"], r["g"]) for r in spark.table("profile").orderBy("pos").collect()] == [(2, 0, 0, 0), (0, 1, 1, 0), (0, 0, 0, 2)]


def test_isolated_rings(spark):
    rng = random.Random(12)
    ring = "".join(rng.choices("ACGT", k=60))
    kmers_ = {(ring + ring)[i : i + 6] for i in range(60)} | {"TTTTTT"} | {"GGCCAA"[:6]}
    got = [(r["seq"], r["n"]) for r in assembly.contigs(spark.createDataFrame([(k,) for k in kmers_], "kmer string")).collect()]
    least = min((ring + ring)[i : i + 5] for i in range(60))
    at = (ring + ring).index(least)
    if len({(ring + ring)[i : i + 5] for i in range(60)}) == 60:
        assert sorted(got) == sorted([((ring + ring)[at : at + 60] + least, 1), ("TTTTTT", 1), ("GGCCAA", 1)])


def test_overlaps_by_the_definition():
    from seqframe.functions.overlaps import merged

    def brute(parts):
        while len(parts) > 1:
            best = (0, "", "")
            for s in parts:
                for t in parts:
                    fits = [n for n in range(1, min(len(s), len(t)) + 1) if s != t and s.endswith(t[:n]) and 2 * n >= min(len(s), len(t))]
                    if fits and fits[-1] > best[0]:
                        best = (fits[-1], s, t)
            n, s, t = best
            if not n:
                return None
            parts = sorted({p for p in parts if p not in (s, t)} | {s + t[n:]})
        return parts[0] if parts else None

    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choices("ACGT", k=rng.randint(1, 40)))
        parts = sorted({text[i : i + rng.randint(3, 9)] for i in range(0, len(text), rng.randint(1, 3))})
        assert merged(parts) == brute(parts)


def test_full_text_index(spark, seqs):
    from seqframe.functions import suffix

    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choices("abé日", k=rng.randint(0, 30))) + "$"
        sa = suffix.suffix_array(suffix.codes(text)).tolist()
        assert sa == sorted(range(len(text)), key=lambda i: text[i:])
        bwt = "".join(text[i - 1] for i in sa)
        find = suffix.Occurrences(*suffix.Occurrences.of(bwt))
        for p in ("a", "ab", "é", "aa", "日b", "z", text[:3]):
            low, high = find.range(p, len(text))
            assert sorted(sa[low:high]) == [i for i in range(len(text)) if text.startswith(p, i)]
    long = "ACGT" * 20_000 + "TTTT"
    index = search.full_text_index(seqs("banana", "", long, None))
    assert [(r["id"], r["pos"], r["ord"]) for r in search.search_index(index, "ana").orderBy("ord").collect()] == [(0, 3, 0), (0, 1, 1)]
    assert [r["pos"] for r in search.search_index(index, "GTT").collect()] == [79_998]
    assert search.index_search(seqs("banana"), "x").count() == 0
    assert [(r["rank"], r["sa"], r["bwt"]) for r in search.suffix_index(seqs("aba")).orderBy("rank").collect()] == [(0, 3, "a"), (1, 2, "b"), (2, 0, "$"), (3, 1, "a")]


def test_time_grows_with_the_length(spark):
    """Eight times the length takes less than twelve times the time: expressions do not walk to each place anew."""
    import time

    from seqframe.functions import seq as S

    def seconds(n, expression):
        rows = spark.createDataFrame([("ACGTTGCATG" * (n // 10),)], "seq string").repartition(1).cache()
        rows.count()
        best = 9e9
        for _ in range(2):
            at = time.perf_counter()
            rows.select(expression).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - at)
        return best

    for expression in (S.all_index("seq", "GCATGA"), S.residues("seq"), S.hamming_all_index("seq", "GCATGA", 1), S.palindromes("seq", 4, 8)):
        assert seconds(240_000, expression) < 12 * max(0.1, seconds(30_000, expression))


def test_texts_that_are_not_ascii(spark):
    from seqframe.functions import seq as S

    row = spark.createDataFrame([("é日aéa", "éa")], "seq string, m string").select(
        S.all_index("seq", F.col("m")).alias("all"), S.symbols("seq").alias("symbols"), S.hamming("seq", F.lit("é日aea")).alias("d"),
        S.hamming_all_index("seq", "éa", 1).alias("near"), S.windows("seq", 4).alias("w"),
    ).first()
    assert (row["all"], row["symbols"], row["d"], row["near"]) == ([3], list("é日aéa"), 1, [0, 1, 3])
    assert [tuple(x) for x in row["w"]] == [(0, "é日aé"), (1, "日aéa")]


def test_streams(spark, tmp_path):
    from seqframe import streaming

    for k, part in enumerate(("TCCTGAACGTTTAAATG", "TCCAACGGCTGAACGTTCAAT")):
        spark.createDataFrame([("g", part)], "id string, seq string").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    for k in range(2):
        (tmp_path / "all").mkdir(exist_ok=True)
        f = next((tmp_path / f"p{k}").glob("*.parquet"))
        f.rename(tmp_path / "all" / f"{k}.parquet")
    stream = spark.readStream.schema("id string, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    q = streaming.peptide_sites(stream, "LNVQ").writeStream.format("memory").queryName("sites").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["pos"] for r in spark.table("sites").collect()) == [2, 10, 25]
