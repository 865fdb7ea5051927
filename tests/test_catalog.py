import __spark_entry__ as entry_points


def test_every_query_of_the_library_has_its_oracle():
    from bandwise.plans import catalog

    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns[0] == "id" and rows.count() > 0


def test_no_pair_joins(spark):
    """No registered plan of the linkage family pairs all rows of two sides."""
    for name in ("j7_models_by_year", "j8_vin_duplicates", "j9_similar_duplicates", "j12_currency_asof",
                 "r14_saved_criteria", "n6_color_fuzzy"):
        df = entry_points.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
