"""Records through CSV, and following a trace as a stream."""

from tarnfold import catalog, report, streaming


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "summary")
    report.write_csv(catalog.records(spark), path)
    back = report.read_csv(spark, path, report.SUMMARY)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, catalog.records(spark).collect()))
    assert report.converged(back).count() == 11


def test_following_a_trace(spark, tmp_path):
    path = str(tmp_path / "trace")
    rows = [("a", i, i, 0.1 * i, 2.0**-i) for i in range(5)] + [("b", 0, 0, 0.0, 1.0)]
    spark.createDataFrame(rows, streaming.TRACE).write.parquet(path)
    stream = streaming.progress(streaming.follow(spark, path), 0.1)
    q = stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    found = {r["run_id"]: (r["sweep"], r["residual"], r["converged"]) for r in spark.table("progress").collect()}
    assert found == {"a": (4, 0.0625, True), "b": (0, 1.0, False)}


def test_heatmap_has_the_fastest_first(spark):
    assert report.heatmap(catalog.records(spark)).columns == ["mdp", "Plan_Static", "GaussSeidel", "Mystery", "Jacobi", "Async_CATopKGS"]
    assert report.heatmap(catalog.records(spark).where("mdp = 'Grid_b0.950'")).columns == ["mdp"]


def test_places_and_labels(spark):
    names = ["Jacobi", "Plan_Static_4T", "Plan_Priority", "Async_Static", "Async_ResBuck_x", "AT_Static", "Other"]
    df = spark.createDataFrame([(s, 1) for s in names], "solver string, n long")
    found = {r["solver"]: (r["label"], r["place"]) for r in report.labels(df).collect()}
    assert found == {"Jacobi": ("Jacobi", 0), "Plan_Static_4T": ("Plan (Static)", 2), "Plan_Priority": ("Plan (Priority)", 4), "Async_Static": ("Async (Static)", 5), "Async_ResBuck_x": ("Async (ResBucket)", 9), "AT_Static": ("AutoTune", 99), "Other": ("Other", 99)}
