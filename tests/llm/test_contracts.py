"""The registered queries on the smallest tables, and operators against their definitions."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import common, fingerprint, htmltext, registry

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def results(spark):
    memo = {}

    def get(name):
        if name not in memo:
            memo[name] = [r.asDict() for r in registry.queries()[name](spark, DATA).collect()]
        return memo[name]

    return get


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(results, name):
    c = duckdb.connect()
    for table in ("documents", "conversations"):
        c.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(str([r[k] for k in columns]) for r in results(name)) == sorted(str(list(r)) for r in want.fetchall())


def test_conversation_of_control_strings(results):
    row = next(r for r in results("op2_chat_prefix_targets") if r["conv_id"] == -7)
    said = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_token_counts(results, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert {r["doc_id"] for r in results("op5_prefix_token_counts")} == set(texts)
    for r in results("op5_prefix_token_counts"):
        n = len(lib.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_token_ids(results, texts):
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in results("op8_streamed_token_ids")}
    for d in sorted(texts):
        ids = [*lib.encode(texts[d], add_special_tokens=False).ids, 0]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name,column,values", [("op6_string_kernel_toxicity", "predicted", {0, 1}), ("op10_ppm_language", "lang_pred", None)])
def test_classifier_columns(results, texts, name, column, values):
    rows = results(name)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert values is None or (r[column] in values and r[column] == int(r["score"] >= 0.5))


def test_decontamination_columns(results, texts, spark):
    rows = results("op9_string_tiling")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    items = {r["text"].lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    for r in rows:
        if any(i in texts[r["doc_id"]].lower() for i in items):
            assert r["contaminated"] and r["coverage"] == 1.0


def test_fingerprints_follow_the_definition(results, texts):
    words = {d: {w for w in t.lower().encode().translate(fingerprint._SPACED).split()} for d, t in texts.items()}
    df = collections.Counter(w for own in words.values() for w in own)
    band = {w for w, n in df.items() if fingerprint.IDF_MIN <= math.log(len(texts) / n) <= fingerprint.IDF_MAX}
    code = {w: int(fingerprint.terms(w.decode())[0]) for w in df}

    def holds(h, s):
        x = (h ^ h >> 29) * int(fingerprint._SEEDS[s]) & M64
        return ((x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64) >> int(fingerprint._SHIFT[s]) == 0

    def whole(own):
        kept = own & band if len(own & band) >= fingerprint.LEAST else own
        out = []
        for s in range(fingerprint.SUBSETS):
            mine = sorted(code[w] for w in kept if holds(code[w], s))
            total = sum(h * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, h in enumerate(mine)) & M64
            total = (total ^ total >> 31) * 0xD6E8FEB86659FD93 & M64
            out.append(max(total >> 48, 1) if mine else 0)
        return b"".join(x.to_bytes(2, "big") for x in out).hex()

    rows = results("op3_imatch_fingerprints")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows[:60]:
        assert r["fingerprint"] == whole(words[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (4, "alpha beta gamma delta"), (4, None), (9, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = fingerprint.compare(common.documents(docs)).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((d, len(t or "")) for d, t in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 22}) == 1


def test_equivalence_classes_follow_the_definition(spark):
    host = "http://h.example/"
    page = "<body><div id=top>Our site</div><ul>{items}</ul><article><p>{text}</p></article><div class=end>All rights kept</div></body>"
    pages = [page.format(items="<li>a</li>" * (k % 3 + 1), text=f"text {k // 2}") for k in range(7)] + ["", None, "<table><tr><td>Other</td></tr></table>"]
    rows = spark.createDataFrame([(k, host, p) for k, p in enumerate(pages)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    seen = {(r["pages"], tuple(r["tokens"]), tuple(r["texts"] or ())) for r in htmltext.classes(htmltext.occurrences(rows)).collect()}
    vectors, whole = collections.defaultdict(dict), {}
    for k, p in enumerate(pages):
        read = htmltext.Page(p or "")
        if not read.blocks:
            continue
        whole[k] = [t for _, t in read.blocks]
        for token, n in [(("tag", ""), 1), *((("tag", t), n) for t, n in read.tokens.items())]:
            vectors[token][k] = n
        for block in read.blocks:
            if htmltext.outside(block[0]):
                own = vectors["text", htmltext.text_token(*block)]
                own[k] = own.get(k, 0) + 1
    classes = collections.defaultdict(lambda: ([], []))
    for (kind, name), counts in vectors.items():
        if len(counts) >= htmltext.MIN_PAGES and len({tuple(whole[k]) for k in counts}) > 1:
            classes[tuple(sorted(counts.items()))][kind == "text"].append(name)
    want = {(len(v), tuple(sorted(tags)), tuple(sorted(texts))) for v, (tags, texts) in classes.items() if tags}
    assert seen == want
    assert htmltext.extract(rows.limit(0)).count() == 0
    twice = htmltext.extract(rows.unionByName(rows)).collect()
    assert collections.Counter(r["page_id"] for r in twice) == collections.Counter({k: 2 for k in range(len(pages))})
