"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from seqframe.plans import REGISTRY, Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES.split():
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(str([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_same_as_sql(spark, duck, name):
    f, sql = REGISTRY[name]
    got = f(Tables(spark, SF))
    want = duck.execute(sql)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs(spark, name):
    assert REGISTRY[name][0](Tables(spark, SF)).count() > 0


def test_assembly_joins_the_reads_of_every_nation(spark):
    t = Tables(spark, SF)
    want = {r["id"]: r["seq"] for r in t.nations.collect()}
    assert {r["id"]: r["seq"] for r in REGISTRY["overlap_assembly"][0](t).collect()} == want


def test_sequencing_covers_every_part(spark):
    t = Tables(spark, SF)
    got = {r["spec_id"] for r in REGISTRY["cyclic_sequencing"][0](t).collect()}
    assert got == {r["id"] for r in t.peptides.collect()}
