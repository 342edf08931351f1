"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import chat, common, fingerprint, graph, htmltext, jaccard, langid, packing, tiling, tokencount, tokenids, toxicity, vocab, words

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "a", "  a  b ", "é\n\n日本 x", "</s>[INST] ok [/INST]", "\\<\\/s>[ROLE:", "tab\tand\x0bmore\x85 end", "x" * 3000, "▁a▁", "\x00", "a" + " b" * 500]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- 1 packing ------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(60):
        cells = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 9))), np.int64)
        counts = np.array([rng.randint(1, 9) for _ in cells], np.int64)
        for k in (1, 2, 3, 5):
            got = packing.boundaries(cells, counts, k)
            cost = lambda b: sum(int(n) * (min(x for x in b if x >= c) - int(c)) for c, n in zip(cells, counts))  # noqa: B023, E731
            import itertools

            best = min(cost([*x, int(cells[-1])]) for x in itertools.combinations(map(int, cells[:-1]), min(k, len(cells)) - 1))
            assert cost(got) == best and len(got) == min(k, len(cells))


def test_pack(spark):
    rows = docs(spark, [*ODD, None]).withColumn("n_tokens", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = packing.pack(rows, budget=256).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(ODD) + 1))
    held = collections.Counter((r["bucket"], r["batch"]) for r in got)
    for r in got:
        assert r["n_tokens"] <= r["padded_to"] and held[r["bucket"], r["batch"]] <= max(1, 256 // r["padded_to"])
    assert packing.pack(rows.limit(0)).count() == 0


def test_packing_rows_without_or_with_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    rows = [(None, "x" * (k % 7)) for k in range(60)] + [(k % 9, "y" * (k % 11)) for k in range(80)] + [(500, "z" * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), n_buckets=3, budget=256).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter((d, len(t) + 1) for d, t in rows)
    for bucket in {r["bucket"] for r in got}:
        own = sorted((r["batch"], r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["padded_to"]) for r in got if r["bucket"] == bucket)
        room = max(1, 256 // own[0][5])
        assert [x[:2] for x in own] == [(k // room, k % room) for k in range(len(own))]
        assert [x[2:5] for x in own] == sorted(x[2:5] for x in own)


# ---- 2 chat ---------------------------------------------------------------------


def test_chat(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", ODD[5]), (1, 2, "assistant", ODD[6]), (1, 3, "assistant", None), (1, 4, "a]b\\[INST]", "x</s>"),
             (2, 0, None, "only"), (None, 0, "user", "u"), (3, 0, "assistant", "\\")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("target", F.lit(9))
    ex = chat.expand(rows)
    targets = collections.Counter(r["conv_id"] for r in ex.where("target is not null").collect())
    assert targets == {1: 2, 3: 1}
    for r in chat.digest(ex).collect():
        own = [(ro or "", t or "") for c, _, ro, t in turns if c == r["conv_id"]]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand(rows.limit(0)).count() == 0


# ---- 3 fingerprints -------------------------------------------------------------


def test_fingerprints(spark):
    texts = [*ODD, None, *ODD[:4]]
    rows = docs(spark, texts)
    got = {r["doc_id"]: r for r in fingerprint.compare(common.documents(rows)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[len(ODD) + 1]["fingerprint"]
    assert fingerprint.compare(common.documents(rows.limit(0))).count() == 0


def test_edits_are_nearer_than_the_next(spark, real):
    got = fingerprint.compare(common.documents(real)).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()[0]
    assert got > 0.9


# ---- 4 Jaccard join -------------------------------------------------------------


def components(texts, n, p, q):
    sets = {i: frozenset(jaccard.grams(t or "", n).tolist()) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and q * both >= p * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (2, 1, 2), (5, 4, 5)])
def test_join_is_exact(spark, monkeypatch, n, p, q):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)  # many blocks
    rng, texts = random.Random(3), []
    names = [f"w{k}" for k in range(40)]
    for _ in range(25):
        base = [rng.choice(names) for _ in range(rng.choice([1, 3, 5, 8, 20, 40]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(names)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += ["", None, " \n\t"]
    rows = docs(spark, texts).withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(common.documents(rows), n, p, q).collect()}
    assert got == components(texts, n, p, q)


def test_join_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "x"), (2, "y z"), (3, "y z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.join(rows, 4, 85, 100).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (2, 2), (3, 2)], key=str) or (None, None) in got
    assert jaccard.join(rows.limit(0), 4, 85, 100).count() == 0


def test_t_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        n, docs_ = rng.randint(1, 30), rng.randint(1, 12)
        held = [set(rng.sample(range(n), rng.randint(0, n))) for _ in range(docs_)]
        lists = [np.array([d for d in range(docs_) if i in held[d]], np.int64) for i in range(n)]
        lists = [x for x in lists if len(x)]
        t = rng.randint(1, n)
        want = [d for d in range(docs_) if len(held[d]) >= t]
        assert jaccard.t_occurrence(lists, t, docs_).tolist() == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_word_hashes():
    for t in [*ODD, "the cat the", "a" * 10 + " " + "b" * 2_000_000 + " c"]:
        raw = t.encode()
        h, w = words.word_hashes(raw).tolist(), raw.split()
        assert len(h) == len(w) and len(set(h)) == len(set(w))


# ---- 5, 8 tokens ----------------------------------------------------------------


def test_prefix_counts(real):
    import sentencepiece

    counter = tokencount.PrefixCounter(P.path("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = [t[:200] for t in ODD] + ["".join(rng.choices("ab c  \n'sdé日▁.,ther", k=30)) for _ in range(300)]
    for t in texts:
        got = tokencount.prefix_counts(counter.steps(t)).tolist()
        assert got == [len(lib.encode(t[: i + 1])) for i in range(len(t))]
    for r in real.limit(50).collect():
        steps = counter.steps(r["text"])
        assert tokencount.prefix_counts(steps)[-1] == len(lib.encode(r["text"]))
        cut = tokencount.fits(steps, 20)
        assert len(lib.encode(r["text"][:cut])) <= 20


def test_vocabulary_is_the_librarys(real):
    enc = vocab.Encoder(P.path("byte_bpe_50k.json"))
    assert enc.merger
    rng = random.Random(4)
    spaces = [c for c in map(chr, range(0x3100)) if c.isspace()]
    texts = [*ODD, "a<|endoftext|>b", *("".join(rng.choices("ab c  \n\t'sdé日　.,<|>", k=25)) for _ in range(300)), *(r["text"] for r in real.limit(50).collect())]
    texts += ["".join(rng.choices(["a", "b ", " ", "'ll", "9", *spaces], k=rng.randint(1, 9))) for _ in range(1500)]
    texts += [f"a{c} b{c}" for c in spaces] + [f"{c} {c}b c{c}" for c in spaces]
    want = [x.ids for x in enc.tok.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = enc.batch(texts, 0)
    ends = np.cumsum(sizes).tolist()
    for t, w, e, n in zip(texts, want, ends, sizes.tolist(), strict=True):
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == w
        assert ids[e - n : e].tolist() == [*w, 0], t
    enc.merger = None  # the library alone
    assert all((a == b).all() for a, b in zip(enc.batch(texts[:400], 0), (ids[: ends[399]], sizes[:400]), strict=True))
    assert [len(x) for x in enc.batch([], 0)] == [0, 0]


def test_byte_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        assert (tokenids.unpack(*tokenids.pack(v), n) == v).all()


def test_token_files_of_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "FRAME_IDS", 50)
    monkeypatch.setattr(tokenids, "SLICE_BYTES", 64)
    enc = vocab.Encoder(P.path("byte_bpe_50k.json"))
    rows = [(k % 40, f"text {k} " * (k % 9)) for k in range(120)] + [(None, "none"), (None, "none"), (7, "long " * 400), (3, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        tokenids.write(common.documents(table), P.path("byte_bpe_50k.json"), str(tmp_path / "o"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "o" / "frames"))
    assert files.select("shard").distinct().count() > 1 and files.agg(F.max("n_ids")).first()[0] > 50
    back = tokenids.read(spark, str(tmp_path / "o")).orderBy("start").collect()
    want = collections.Counter((d, tuple([*enc.tok.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in back) == want
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in back]
    assert keys == sorted(keys)  # nulls first, then ascending
    at = 0
    for r in back:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    tokenids.write(common.documents(table.limit(0)), P.path("byte_bpe_50k.json"), str(tmp_path / "empty"))
    assert tokenids.digest(spark, str(tmp_path / "empty")).count() == 0


def test_token_files(spark, tmp_path):
    texts = [*ODD, None]
    tokenids.write(common.documents(docs(spark, texts)), P.path("byte_bpe_50k.json"), str(tmp_path / "out"))
    enc, start = vocab.Encoder(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in tokenids.digest(spark, str(tmp_path / "out")).collect()}
    for i, t in enumerate(texts):
        ids = [*enc.tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# ---- 6, 10 classifiers ----------------------------------------------------------


def kernel(v, w, n=toxicity.ORDER, lam=toxicity.DECAY):
    """The subsequence kernel by its definition."""
    import itertools

    hits = [(i, j) for i in itertools.combinations(range(len(v)), n) for j in itertools.combinations(range(len(w)), n)]
    return sum(lam ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i, j in hits if [v[a] for a in i] == [w[b] for b in j])


def test_kernel_counts_subsequences():
    words = [toxicity.symbols(w) for w in ("idxiot", "idiot", "banana", "ananas", "abcd", "aaaa", "xyz", "stüpid1")]
    marks = toxicity.Landmarks(words)
    got = marks.values(words)
    want = np.array([[kernel(v, w) / np.sqrt(kernel(v, v) * kernel(w, w)) for w in words] for v in words])
    # one kernel: on the landmarks the features are the landmarks' own matrix
    assert got == pytest.approx(want, abs=1e-5) and np.diag(got) == pytest.approx(1, abs=1e-5)
    cut = toxicity.Words.of([b"idiot banana", b"", b"idiot xyz", b"ab"])
    assert sorted(cut.each()) == sorted({toxicity.symbols(w) for w in ("idiot", "banana", "xyz")})
    beta = np.random.default_rng(0).normal(size=len(words))
    got = toxicity.Machine(marks.folded(beta), -0.25).margins(cut)
    margins = dict(zip(cut.each(), got, strict=True))
    assert margins[words[1]] == pytest.approx(want[1] @ beta - 0.25, abs=1e-4)
    x = toxicity.pooled(cut, np.array([{words[1]: 0.75, words[6]: -3.0}.get(w, 9.0) for w in cut.each()]), 4)
    assert x[:, 0].tolist() == [1.5, -1, 0.75, -1] and x[:, 1].tolist() == [0.75, -1, -1, -1]
    assert np.expm1(x[:, toxicity.TOP]) == pytest.approx([2, 0, 1, 0])


def syllables(rng, n):
    return ["".join(rng.choice(("ther", "on", "ing", "ea", "st")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_toxicity_tolerates_inserted_characters():
    rng = random.Random(5)
    plain = syllables(rng, 200)
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(200)]
    bad = [c + " " + w for c, w in zip(clean, rng.choices(("scumbag", "jackdaw"), k=60), strict=False)]
    model = toxicity.train(clean[60:] + bad, [0] * 140 + [1] * 60)
    toxic = ["you s-c-u-m-b-a-g", "you s c u m b a g", "SCUMBAG!", bad[0], "scum bag scumbag " * 3000]
    toxic += [f"{clean[0]} {'scumbag'[:k]}{c}{'scumbag'[k:]}" for k in range(1, 7) for c in "xqe"]
    toxic += [f"jack_daw {c}" for c in clean[:3]] + ["jack.daw", "jaackdaw", "jackkdaw"]
    assert (model.scores(toxic) >= 0.5).all()
    assert (model.scores([*clean, "", "a", "\n", "12 34", "日本"]) < 0.5).all()
    assert toxicity.train(["a"], [1]) is None and toxicity.train(["", ""], [1, 0]) is None


def test_toxicity_of_rare_and_altered_insults():
    rng = random.Random(7)
    plain = syllables(rng, 100)
    insults = ["".join(rng.choices("bdfkmpuwxz", k=7)) for _ in range(60)]
    clean = [" ".join(rng.choices(plain, k=20)) + f" {i}" for i in range(700)]
    bad = [c + " " + insults[i % 60] for i, c in enumerate(clean[:300])]
    model = toxicity.train(clean[300:600] + bad, [0] * 300 + [1] * 300)
    scores = model.scores([clean[650] + " " + w for w in insults] + clean[600:])
    assert (scores[:60] > 0.5).mean() > 0.9 and (scores[60:] < 0.5).mean() > 0.9
    near = model.scores([clean[650] + " " + w[:3] + "a" + w[3:] for w in insults])
    assert (near > 0.5).mean() > 0.9


def test_toxicity_rows(spark):
    rng = random.Random(8)
    plain = syllables(rng, 60)
    texts = [" ".join(rng.choices(plain, k=12)) + (" dumbwit" if i % 4 == 0 else "") for i in range(200)]
    rows = docs(spark, [*texts, "", None, texts[0]]).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(rows, labels)
    kept = sorted(r["doc_id"] for r in toxicity.drop_toxic(rows, scorer).collect())
    assert kept == sorted([i for i in range(200) if i % 4] + [200, 201])
    assert toxicity.drop_toxic(rows, scorer).columns == rows.columns
    assert toxicity.drop_toxic(rows.limit(0), scorer).count() == 0
    assert toxicity.drop_toxic(rows, toxicity.fit(rows, labels.limit(0))).count() == 203


def ppm_bits(training, text, order):
    """Code length of a text by the definition: method C, with exclusion, a dictionary for each context."""
    seen = collections.defaultdict(collections.Counter)
    for t in training:
        padded = b" " * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, b" " * order + text
    for i in range(order, len(padded)):
        excluded = set()
        for k in range(order, -1, -1):
            left = {b: n for b, n in seen.get(padded[i - k : i], {}).items() if b not in excluded}
            if not left:
                continue
            escape = len(left) if len(left) + len(excluded) < 256 else 0
            if padded[i] in left:
                bits -= np.log2(left[padded[i]] / (sum(left.values()) + escape))
                break
            bits -= np.log2(escape / (sum(left.values()) + escape))
            excluded |= set(left)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths_follow_the_definition(order, monkeypatch):
    monkeypatch.setattr(langid, "_SLICE", 7)  # slices share their contexts
    rng = random.Random(order)
    samples = {k: ["".join(rng.choices(letters, k=60)).encode() for _ in range(6)] for k, letters in (("x", "ab c"), ("y", "abcé日"), ("z", "\x00q "))}
    samples["all"] = [bytes(range(256))]
    coder = langid.Coder(langid.train(samples, order))
    texts = [b"", b"a", b"abc cab", "éa日b".encode(), b"", b"zzz", bytes(rng.choices(range(256), k=40)), samples["x"][0] + b"q" + samples["y"][1]]
    want = [[ppm_bits(samples[k], t, order) for k in sorted(samples)] for t in texts]
    assert coder.bits(texts) == pytest.approx(np.array(want))


def test_language_codes_are_complete():
    model = langid.train({"x": [b"abra cadabra abra"], "y": [b"hello hallo hullo"]}, order=2)
    for context in (b"ab", b"he", b"zz", b"a ", b"  "):
        keys = np.array([int.from_bytes(context + bytes([b])) for b in range(256)], np.uint64)
        assert np.exp2(-model.costs(keys)).sum(0) == pytest.approx(1)
    b = langid.Coder(model).bits([b"abra"])[0]
    assert b[0] < b[1]


def test_languages(spark, real):
    scorer = langid.fit(real)
    got = real.select("lang", langid.held_out(F.col("doc_id")).alias("h"), scorer.column(F.col("text")).alias("p")).where("h")
    assert got.agg(F.avg((F.col("p.lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    odd = docs(spark, ["", None, "123 !", "\n"]).select(scorer.column(F.col("text"))["lang_pred"].alias("l")).collect()
    assert {r["l"] for r in odd} == {"und"}
    assert langid.fit(real.limit(0)).model.langs == ()


@pytest.mark.parametrize("per_file", [1 << 16, 10])
def test_rounds_of_few_edges_leave_few_files(spark, monkeypatch, per_file):
    monkeypatch.setattr(graph, "FILE_EDGES", per_file)
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        got = graph.components(spark.range(0, 400).selectExpr("id a", "if(id % 7 = 6, id, id + 1) b"))
        assert {r["node"]: r["root"] for r in got.collect()} == {k: k // 7 * 7 for k in range(401) if k < 400 or k % 7}
        assert len(got.inputFiles()) <= (graph.LEAST_FILES if per_file > 10 else 24)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---- 7 pages --------------------------------------------------------------------


def test_main_text(spark):
    body = "<article><h1>T &amp; t</h1><p>One  <b>two<br>three</b><p>Four<div class='comments'>no</div><p>{}</article>"
    page = "<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class=ad>buy</div>" + body + "<aside>side</aside><footer>&copy; f</footer></body></html>"
    rows = [(i, "http://a.example/x", page.format("more words " * 5 + str(i)), 7) for i in range(5)]
    rows += [(9, None, None, 7), (10, "http://b.example/", "plain text &lt;3", 7), (11, "http://b.example/", "<p>cut <", 7), (12, "u", "", 7)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, root int")).collect()}
    assert got[3] == "T & t\nOne two three\nFour\n" + "more words " * 5 + "3"
    assert (got[9], got[10], got[12]) == ("", "plain text <3", "")


def page_texts(spark, pages):
    rows = [(i, "http://a.example/", p) for i, p in enumerate(pages)]
    return [r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [1, 6])
def test_headline_and_lead_stay(spark, n):
    page = "<body><nav>menu</nav><article><header><h1>Head {0}</h1></header><div class=lead>Lead {0}</div><div class=body><p>{1}</p></div></article></body>"
    long = ["long text " * 20 + str(i) for i in range(n)]
    assert page_texts(spark, [page.format(i, x) for i, x in enumerate(long)]) == [f"Head {i}\nLead {i}\n{x}" for i, x in enumerate(long)]
    parts = "<body><section id=a><p>Short {0}</p></section><section id=b><p>{1}</p></section></body>"
    assert page_texts(spark, [parts.format(i, x) for i, x in enumerate(long)]) == [f"Short {i}\n{x}" for i, x in enumerate(long)]


def test_template_texts_go_in_spite_of_deviating_pages(spark):
    page = "<body><div>Our site</div><article><h1>T{0}</h1><p>Text {0}</p><p>Shared line {1}</p></article><div><p>All rights kept</p></div></body>"
    odd = [None, "", "<body><ul><li>One</li><li>Two</li></ul></body>"]
    got = page_texts(spark, [page.format(i, i // 4) for i in range(8)] + odd)
    assert got == [f"T{i}\nText {i}\nShared line {i // 4}" for i in range(8)] + ["", "", "One\nTwo"]
    # copies are no template, nor is what two pages of a host share
    assert page_texts(spark, [page.format(1, 1)] * 4) == ["Our site\nT1\nText 1\nShared line 1\nAll rights kept"] * 4
    assert page_texts(spark, [page.format(i, 1) for i in range(2)])[0].startswith("Our site\n")


def test_names_that_only_contain_a_chrome_word(spark):
    page = (
        "<body><div class='content has-sidebar'><section id='legal-form'><h2 id='share-of-market'>Share {0}</h2><p class='notice'>Period {0}</p></section></div>"
        "<div class='layout no-comments'>Rest {0}</div><div class='box ad'>buy {0}</div><div role=navigation>menu {0}</div></body>"
    )
    assert page_texts(spark, [page.format(i) for i in range(4)]) == [f"Share {i}\nPeriod {i}\nRest {i}" for i in range(4)]


def test_template_classes_are_ordered_and_nested(spark):
    page = "<body><div class=top>Our site</div>{a}<article><p>Text {i}</p></article>{b}<div class=end>All rights kept</div></body>"
    # two adverts of some pages stand around the text: each has a slot of its own
    ads = [("<div class=x>Buy</div>", "<div class=y>Sell</div>") if i < 4 else ("", "") for i in range(6)]
    pages = [page.format(i=i, a=a, b=b) for i, (a, b) in enumerate(ads)]
    assert page_texts(spark, pages) == [f"Text {i}" for i in range(6)]
    # a box that stands before the text on some pages and behind it on others has no slot
    box = "<div class=box>Read on</div>"
    pages = [page.format(i=i, a=box * (i % 2), b=box * (1 - i % 2)) if i < 4 else page.format(i=i, a="", b="") for i in range(6)]
    want = [f"Text {i}\nRead on" if i % 2 == 0 else f"Read on\nText {i}" for i in range(4)]
    assert page_texts(spark, pages) == want + ["Text 4", "Text 5"]
    # what changes places inside one slot is still the template's
    links = ["<div class=a>One</div>", "<div class=b>Two</div>"]
    pages = [page.format(i=i, a="".join(links[:: 1 - 2 * (i % 2)]), b="") for i in range(6)]
    assert page_texts(spark, pages) == [f"Text {i}" for i in range(6)]
    rows = [(i, "http://a.example/", p) for i, p in enumerate(pages)]
    got = {r["class"]: r for r in htmltext.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["events"][:2] == ["", "/body"] and got[0]["events"][-1] == "/" and got[0]["around"] == -1
    # both elements lie in one slot of the page's class, each text in its element
    assert len(got) == 5 and {(r["around"], r["slot"]) for r in got.values()} == {(-1, 0), (0, 5), (1, 1), (2, 1)}
    assert htmltext.nested(2, {(0, -2, 0): 3, (1, -2, 1): 3, (0, 1, 1): 2}) == {0: (-1, 0)}
    assert htmltext.nested(2, {(0, -2, 0): 3, (1, -2, 1): 3, (0, 1, 1): 3}) == {0: (-1, 0), 1: (0, 1)}


# ---- 9 decontamination ----------------------------------------------------------


def test_tiles_do_not_overlap():
    rng = random.Random(6)
    for _ in range(100):
        item, doc = ([rng.randint(0, 3) for _ in range(rng.randint(4, 25))] for _ in "ab")
        a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
        pairs = [(p, t) for p in range(len(a) - 3) for t in range(len(b) - 3) if (a[p : p + 4] == b[t : t + 4]).all()]
        p, t = np.array(pairs, np.int64).reshape(-1, 2).T
        tiles = tiling.tile(a, b, p, t)
        # by the definition: the longest match of unmarked tokens again and again
        free_a, free_b, want = [True] * len(a), [True] * len(b), []
        while True:
            best = (0,)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 4:
                break
            n, i, j = best[0], -best[1], -best[2]
            free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
            want.append(n)
        assert [n for _, _, n in tiles] == want
        used_a, used_b = [p + k for p, _, n in tiles for k in range(n)], [t + k for _, t, n in tiles for k in range(n)]
        assert len(used_a) == len(set(used_a)) and len(used_b) == len(set(used_b))
        assert all((a[p : p + n] == b[t : t + n]).all() and n >= 4 for p, t, n in tiles)
        free = [(p, t) for p, t in pairs if not {p + k for k in range(4)} & set(used_a) and not {t + k for k in range(4)} & set(used_b)]
        assert not free  # nothing that could still be tiled is left


def test_short_items_and_scripts_without_spaces():
    index = tiling.Index.build([(1, "Two words"), (2, "今日は良い天気です"), (3, ""), (4, "one two three four five")])
    assert index.match("he said: two words.", 0.5) == (1.0, [1])
    assert index.match("two other words", 0.5) == (0.0, [])
    assert index.match("昨日、今日は良い天気ですと言った", 0.5) == (1.0, [2])
    assert index.match("two words, one two three four five", 0.5) == (1.0, [1, 4])


def test_repeats_and_very_long_texts():
    index = tiling.Index.build([(1, "a b c d " * 60), (None, "one two three four five"), (1, "six seven eight nine ten"), (-1, "one two three four five")])
    assert index.match("a b c d " * 5000, 0.5) == (1.0, [1])
    long = "x y z " * 60_000 + "six seven eight nine ten one two three four five"
    assert index.match(long, 0.5) == (1.0, [-1, 1, None])
    assert index.match("", 0.5) == (0.0, [])


def test_reordered_passages(spark):
    item = "one two three four five six. seven eight nine ten eleven twelve."
    texts = ["x y " + item.upper(), "seven eight nine ten eleven twelve, then one two three four five six", "one two three four and others", None, ""]
    bench = spark.createDataFrame([(5, item), (6, "too short"), (7, None)], "item_id long, text string")
    rows = docs(spark, texts).withColumn("coverage", F.lit(1))
    assert [r["doc_id"] for r in tiling.drop_contaminated(rows, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert tiling.drop_contaminated(rows, bench.limit(0)).count() == 5
