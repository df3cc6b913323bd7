"""Every query with SQL gives the rows of its SQL."""

import pytest

from emberlane.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE[name])


def test_sql_belongs_to_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chunks_keep_units_together(spark, sf_dir):
    rows = [r.asDict() for r in registry.QUERIES["chunk_packing"](spark, sf_dir).collect()]
    size, unit = {}, {}
    for r in rows:
        size[r["o_custkey"], r["chunk"]] = size.get((r["o_custkey"], r["chunk"]), 0) + 1
        unit.setdefault((r["o_custkey"], r["l_orderkey"]), set()).add(r["chunk"])
    assert all(len(c) == 1 for c in unit.values())
    most = {}
    for r in rows:
        most[r["o_custkey"], r["l_orderkey"]] = most.get((r["o_custkey"], r["l_orderkey"]), 0) + 1
    assert all(n <= max(20, max(most.values())) for n in size.values())


def test_nearest_anchor_of_one_key_with_many_rows(spark):
    """Time in proportion to the rows of a key: the frame is carried along, not read again for every row."""
    import time

    from emberlane.operators import joins

    points = spark.range(80_000).selectExpr("1 as k", "id * 10 as t")
    anchors = spark.range(80_000).where("id % 997 = 0").selectExpr("1 as k", "id * 10 + 3 as t")
    start = time.time()
    rows = joins.nearest_anchor(points, anchors, by=["k"], point="t", anchor="t").selectExpr("sum(distance) as s", "max(distance) as m", "count(*) as n").first()
    assert rows.n == 80_000 and rows.m > 0 and time.time() - start < 30


def test_bursts_and_densest_windows_by_hand(spark):
    """Counts by a sweep equal those of windows held in full, with ties, repeated kinds and nulls."""
    import random

    from emberlane.operators import windows

    rnd = random.Random(1)
    rows = [(k, rnd.randint(0, 300), i, rnd.choice(["a", "b", "c", "d", "e", None])) for i, k in enumerate(rnd.choices(range(12), k=400))]
    df = spark.createDataFrame(rows, "k long, at long, o long, e string")
    first, dense = {}, {}
    for k in range(12):
        own = sorted((a, o, e) for g, a, o, e in rows if g == k for e in [e or ""])
        for i, (a, o, _) in enumerate(own):
            window = [r for r in own[:i + 1] if r[0] >= a - 20]
            if k not in first and len({e for _, _, e in window} - {""}) >= 3:
                first[k] = (a, [r[1] for r in window])
        best = [(len({e for b, _, e in own if a <= b <= a + 20} - {""}), sum(a <= b <= a + 20 for b, _, _ in own), -a) for a, _, _ in own]
        dense[k] = max(best)
    got = {r.k: (r.at, r.refs) for r in windows.first_burst(df, key="k", at="at", ordinal="o", endpoint="e", ref="o", width=20, least=3).collect()}
    assert got == first
    assert {r.k: (r.signals, r.density, -r.start) for r in windows.densest_start(df, key="k", at="at", signal="e", width=20).collect()} == dense


def test_units_beyond_a_chunk_are_cut(spark):
    from emberlane.operators import ranking

    rows = [(1, u, i, 1) for u, n in ((1, 3), (2, 12), (3, 2), (4, 5)) for i in range(u * 100, u * 100 + n)]
    got = ranking.next_fit(spark.createDataFrame(rows, "c long, u long, o long, s long"), case="c", unit="u", order="o", size="s", capacity=5).orderBy("o").collect()
    assert [r.chunk for r in got] == [0] * 3 + [1] * 5 + [2] * 5 + [3] * 2 + [3] * 2 + [4] * 5


def test_many_small_cases_are_walked_as_a_stream(spark):
    """Thousands of cases take no call each, a case's units may lie in several batches, and a size that is missing counts as nothing."""
    from emberlane.operators import ranking

    rows = [(c, u, u, 2) for c in range(3000) for u in range(5)] + [(9999, u, u, None if u == 1 else 2) for u in range(5)] + [(-1, u, u, 1) for u in range(25_000)]
    out = ranking.next_fit(spark.createDataFrame(rows, "c long, u long, o long, s long"), case="c", unit="u", order="o", size="s", capacity=4)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.c, r.u): r.chunk for r in out.collect()}
    assert len(got) == len(rows) and all(got[c, u] == u // 2 for c in range(3000) for u in range(5))
    assert [got[9999, u] for u in range(5)] == [0, 0, 0, 1, 1] and all(got[-1, u] == u // 4 for u in range(25_000))


def test_pairs_are_dealt_out_once_by_anchor(spark, sf_dir):
    """Pairs are made unique and numbered where one given number of tasks has them."""
    plan = registry.QUERIES["relation_catalog"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "").split("Window", 1)[1].split("SortMergeJoin", 1)[0].split("BroadcastHashJoin", 1)[0]


def test_members_are_dealt_out_once_for_blob_and_values(spark, sf_dir):
    """Strings and scalars come of one grouping; no join of two."""
    plan = registry.QUERIES["record_blobs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_grounding_as_sql_on_odd_texts(spark, tmp_path):
    """Numbers with one sign between them, hex, dots in a word, backslashes, signs beyond ASCII, no text."""
    import duckdb

    texts = ["on +1 (929) 555-1803 and", "1803 1803", "7 1803 1803", "1803", "at 0x70B or 0x70b", "zz.zz l.i.c.e.n", "C:\\Dir\\a.exe ran", "\\", " led by", "", None, "1803\u212a \u0130" + "1803", "1803\n1803", "a1803 1803b é1803é", "01803,18037", "x/ 18037", "ΟΔΟΣ 1803\r\n", "1803\n"]
    rows = [(i, t, 803) for i, t in enumerate([t for t in texts for _ in range(2)])]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.missing for r in registry.QUERIES["grounding"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.execute(registry.ORACLE["grounding"]).fetchall())
    assert got[1] == "zzzz,l.icen,1803,0x70B,18037"
