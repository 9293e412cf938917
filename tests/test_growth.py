"""Queries on tables that are larger than the smallest ones, or odd, where they once went wrong."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from snaplake.operators import layout


def both(spark, sf, name, table):
    """The rows of a query and of its SQL over the one table in sf."""
    mine = entry.queries()[name](spark, sf)
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    theirs = c.execute(f"select {', '.join(mine.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in mine.collect()), sorted(theirs)


@pytest.fixture(scope="module")
def many_events(tmp_path_factory):
    """More commits than five digits can number, in every range that is asked for."""
    at = tmp_path_factory.mktemp("events")
    duckdb.connect().execute(f"copy (select range as event_id, timestamp '2024-01-02 00:00:00' + to_seconds(range * 6) as ts, 'k' || range % 5 as event_type from range(140000)) to '{at}/events.parquet'")
    return str(at)


def test_commit_list_numbers_of_six_digits(spark, many_events):
    got, want = both(spark, many_events, "commit_list", "events")
    assert len(got) > 30_000 and got == want


def test_join_commit_index_numbers_of_six_digits(spark, many_events):
    got, want = both(spark, many_events, "join_commit_index", "events")
    assert len(got) == 28_000 and got == want


def test_partition_of_a_long_array_costs_in_proportion(spark):
    """An array of 100,000 items: each step copied all runs so far and summed up the whole array again."""
    sizes = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda x: x.cast("long"))
    began = time.monotonic()
    runs = spark.range(1).select(F.explode(layout.greedy_partition(sizes, 4)).alias("p")).groupBy("p").count()
    got = {r.p: r["count"] for r in runs.collect()}
    assert time.monotonic() - began < 30
    assert sorted(got) == [0, 1, 2, 3] and sum(got.values()) == 100_000
    bound, first = 100_000 * 100_001 // 2 // 4, 1
    for k in range(3):  # each run holds what fits and not one more
        following = first + got[k]
        run = (first + following - 1) * got[k] // 2
        assert run <= bound < run + following
        first = following


def test_item_runs_are_the_array_operators(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0, 0, 1, 5, rng.randint(1, 60), 900])) for g in "abcdefgh" for _ in range(rng.randint(1, 40))]
    rows += [("zero", 0)] * 3 + [("big", 0), ("big", 0), ("big", 7), ("one", 3)]
    items = spark.createDataFrame(rows, "g string, v long")
    arrays = items.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("s"))
    for n in (1, 2, 5, 60):
        want = arrays.select("g", F.posexplode(layout.greedy_partition(F.col("s"), n)).alias("i", "part")).select("g", F.col("i") + 1, "part")
        assert sorted(map(tuple, layout.item_runs(items, "g", "v", n).collect())) == sorted(map(tuple, want.collect()))


def test_greedy_partition_of_odd_documents(spark, tmp_path):
    """Sizes of zero, unknown sizes and sources."""
    rows = "(1, 'a', 0), (2, 'a', 0), (3, 'a', 9), (4, 'b', 1), (5, 'b', NULL), (6, 'b', 2), (7, 'c', NULL), (8, 'c', NULL), (9, NULL, 4), (10, 'd', 3), (11, 'd', 3), (12, 'd', NULL), (13, 'd', 50)"
    duckdb.connect().execute(f"copy (select * from (values {rows}) v(doc_id, source, n_chars)) to '{tmp_path}/documents.parquet'")
    got, want = both(spark, str(tmp_path), "greedy_partition", "documents")
    assert got == want and len(got) == 12


PACK_QUERIES = ["scan_pack_legacy", "compress_frame", "scan_pack_frames"]


@pytest.mark.parametrize("name", PACK_QUERIES)
def test_contents_of_packs_are_shuffled_once(spark, tmp_path, name):
    """With the contents shuffled for their checksums, their frames and their chunks it was more than four times the text."""
    text = "string_agg(substr(md5(doc || ':' || k), 1, 31), ' ' order by k)"
    docs = f"select doc as doc_id, {text} as text, 'en' as lang, 's' || doc % 3 as source from range(200) a(doc), range(600) b(k) group by doc"
    odd = "select 200, '', 'en', 's0' union all select 201, null, 'en', 's0' union all select 202, text, lang, source from docs where doc_id = 7"
    duckdb.connect().execute(f"copy (with docs as ({docs}) from docs union all {odd}) to '{tmp_path}/documents.parquet'")
    status = spark.sparkContext._jsc.sc()

    def shuffled():
        status.listenerBus().waitUntilEmpty(30_000)
        return status.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got, want = both(spark, str(tmp_path), name, "documents")
    assert got == want and len(got) > 300
    assert shuffled() - before < 2 * 200 * 600 * 32
