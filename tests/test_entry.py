import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(oracle) > 0.9 * len(queries)


def test_flagship_query_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"path", "hits", "top1", "top2", "top3", "other"} <= set(rows[0].asDict())


def test_small_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in ("daily_bots", "page_bots", "coverage", "robots_matrix", "sessions"):
        df = queries[name](spark, SMALL)
        cur = con.execute(oracle[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns), name
        want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r) for r in df.collect()), key=repr) == want, name


def test_page_facts_has_all_facts(spark):
    facts = entry.queries()["page_facts"](spark, SMALL)
    assert {"h2", "h3", "images", "noindex", "canonical_elsewhere"} <= set(facts.columns)


def test_no_task_writes_a_week_of_requests(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all rows in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refuse)
    assert entry.queries()["stream_cooled_alerts"](spark, SMALL).count() > 0


def test_coverage_findings_work_out_no_fact_they_do_not_read(spark, monkeypatch):
    from workload import bridge

    stored, written = {}, bridge.written
    monkeypatch.setattr(bridge, "written", lambda s, df, name: stored.update({name: df.columns}) or written(s, df, name))
    assert entry.queries()["coverage_findings"](spark, SMALL).count() > 0
    assert stored["facts"] == ["page_id", "noindex"] and "title" not in stored["inventory"] and "seen" not in stored["cube"]
