import json

import pytest
from pyspark.sql import functions as F

from fewlabel.operators import joins as J
from fewlabel.sources import metrics, sinks, tables
from fewlabel.streaming import jobs


def test_single_file_json_document(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert tables.read_table(spark, str(path)).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        tables.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["c", "a", "b"])


def test_missing_json_fields_take_defaults(spark, tmp_path):
    (tmp_path / "cell.json").write_text(json.dumps({"method": "m", "budget": 5, "ppi": {"mu_hat_ppi": 1.5}, "validation": {}, "runtime": {"runtime_seconds": 3.0}}))
    row = metrics.read_cell_metrics(spark, str(tmp_path)).first()
    assert row["allocation_source"] == "grid" and row["mu_hat_ppi"] == 1.5 and row["runtime_seconds"] == 3.0 and row["device"] == ""


def test_vector_length_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<double>")
    sinks.write_table(df, f"{tmp_path}/e.parquet")
    with pytest.raises(Exception, match="vector length"):
        tables.read_embeddings(spark, f"{tmp_path}/e.parquet", dim=2).collect()


def test_subset_guards(spark):
    pop = spark.createDataFrame([(1, 80.0), (2, 90.0)], "id long, y double")
    ok = J.subset_by_ids(spark.createDataFrame([(1, 1)], "id long, rank long"), pop, "id", "L", "y").first()
    assert ok["y_scaled"] == -2.0 and ok["split_role"] == "L"
    with pytest.raises(Exception, match="unknown ids"):
        J.subset_by_ids(spark.createDataFrame([(9, 1)], "id long, rank long"), pop, "id", "L", "y").collect()
    with pytest.raises(Exception, match="duplicate ids"):
        J.subset_by_ids(spark.createDataFrame([(1, 1), (1, 2)], "id long, rank long"), pop, "id", "L", "y").collect()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    def arrive(part, values):
        rows = [("a", float(v), float(v) / 2, i % 2 == 0) for i, v in enumerate(values)]
        spark.createDataFrame(rows, "g string, y double, f double, k boolean").coalesce(1).write.parquet(f"{tmp_path}/part-{part}")

    def run():
        stream = spark.readStream.schema("g string, y double, f double, k boolean").parquet(f"{tmp_path}/in/*")
        return jobs.stream_ppi_mean(stream, ["g"], "y", "f", F.col("k"), ~F.col("k"), F.col("k"), folder=f"{tmp_path}/kept").first()

    (tmp_path / "in").mkdir()
    arrive(1, range(10))
    (tmp_path / "part-1").rename(tmp_path / "in" / "one")
    first = run()
    again = run()
    assert first == again
    # what was read must not be read again: it is gone when the next part arrives
    (tmp_path / "in" / "one").rename(tmp_path / "gone")
    arrive(2, range(10, 40))
    (tmp_path / "part-2").rename(tmp_path / "in" / "two")
    resumed = run()
    arrive(3, [*range(10), *range(10, 40)])
    (tmp_path / "in" / "two").rename(tmp_path / "gone2")
    (tmp_path / "part-3").rename(tmp_path / "in" / "three")
    stream = spark.readStream.schema("g string, y double, f double, k boolean").parquet(f"{tmp_path}/in/*")
    whole = jobs.stream_ppi_mean(stream, ["g"], "y", "f", F.col("k"), ~F.col("k"), F.col("k")).first()
    assert resumed != first and resumed.asDict() == pytest.approx(whole.asDict())


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    from fewlabel.operators.ppi import ppi_mean

    rows = spark.range(400).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.37 % 5).alias("y"), (F.col("id") * 0.11 % 4).alias("f"), (F.col("id") % 4 == 0).alias("k"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    got = jobs.stream_ppi_mean(stream, ["g"], "y", "f", F.col("k"), ~F.col("k"), F.col("k"), unit=5.0)
    want = ppi_mean(rows, ["g"], "y", "f", F.col("k"), ~F.col("k"), F.col("k"))
    a = {r["g"]: r for r in got.collect()}
    for r in want.collect():
        assert a[r["g"]]["mu_hat_ppi"] == pytest.approx(r["mu_hat_ppi"])
        assert a[r["g"]]["ppi_var_est_raw"] == pytest.approx(r["ppi_var_est_raw"])


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "g string, y double, f double, k boolean"

    def arrive(name, groups):
        rows = [(g, float(i), 1.5, i % 2 == 0) for g in groups for i in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        out = jobs.stream_ppi_mean(stream, ["g"], "y", "f", F.col("k"), ~F.col("k"), F.col("k"), folder=f"{tmp_path}/kept")
        return sorted(tuple(r) for r in out.collect())

    arrive("a", ["p", "q"])
    assert len(run()) == 2
    arrive("b", ["q", "r"])
    second = run()
    assert [r[0] for r in second] == ["p", "q", "r"]
    # the second batch holds the changed groups only
    assert sorted(r["g"] for r in spark.read.parquet(f"{tmp_path}/kept/changes-1").collect()) == ["q", "r"]
    # as if the job had failed after the batch was written and before it was committed
    for commit in (tmp_path / "kept" / "checkpoint" / "commits").glob("*1*"):
        commit.unlink()
    assert run() == second
    # and as if it had failed before the merge
    (tmp_path / "kept" / "merged-1").rename(tmp_path / "lost")
    assert run() == second
    with pytest.raises(RuntimeError, match="no input"):
        jobs.merge_changes(spark, str(tmp_path / "none"), "x", ["g"])
