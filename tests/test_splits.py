import hashlib

import pytest
from pyspark.sql import functions as F

from fewlabel.operators import ranking, splits as X


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "sample_id")


def order(seed, *parts):
    return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()


def test_hash_rank_equals_a_full_sort(spark):
    from fewlabel.functions.hashing import hash_key

    got = ranking.hash_rank(ids(spark, 3000), hash_key(5, "x", F.col("sample_id")), "sample_id").collect()
    want = sorted(range(3000), key=lambda i: order(5, "x", i))
    assert {r["sample_id"]: r["rank"] for r in got} == {i: k + 1 for k, i in enumerate(want)}


def test_first_k_needs_no_full_rank(spark):
    from fewlabel.functions.hashing import hash_key

    key = hash_key(5, "x", F.col("sample_id"))
    got = {r["sample_id"] for r in ranking.hash_rank(ids(spark, 3000), key, "sample_id", k=77).collect()}
    assert got == set(sorted(range(3000), key=lambda i: order(5, "x", i))[:77])


def test_bands_label_every_row_once(spark):
    from fewlabel.functions.hashing import hash_key

    key = hash_key(9, "b", F.col("sample_id"))
    got = ranking.hash_bands(ids(spark, 2500), key, "sample_id", [100, 1700], ["x", "y", "z"]).collect()
    want = sorted(range(2500), key=lambda i: order(9, "b", i))
    place = {i: k for k, i in enumerate(want)}
    assert len(got) == 2500
    for r in got:
        k = place[r["sample_id"]]
        assert r["split"] == ("x" if k < 100 else "y" if k < 1700 else "z")


def test_population_protocol(spark):
    got = X.population_split(ids(spark, 25000), "sample_id", 25000, 10000, seed=123).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"h_scale": 10000, "target": 15000}


@pytest.mark.parametrize("seed", [1, 2, 123])
def test_replication_split_is_clean(spark, seed):
    members = X.replication_split(ids(spark, 4000), "sample_id", [0, 1, 2], 1000, 100, 100, seed)
    report = X.leakage_audit(members, "sample_id", ["replication"], {"V_stop": 100, "V_scale": 100, "L_prime": 800}).collect()
    assert len(report) == 3 and all(r["passed"] for r in report)
    small = {r["sample_id"] for r in X.nested_train(members, 100).where("replication = 1").collect()}
    large = {r["sample_id"] for r in X.nested_train(members, 300).where("replication = 1").collect()}
    assert len(small) == 100 and small < large


def test_audit_sees_a_leak(spark):
    members = X.replication_split(ids(spark, 500), "sample_id", [0], 100, 20, 20, 7).select("replication", "sample_id", "role", "train_rank")
    leak = members.where("role = 'L_prime'").limit(1).withColumn("role", F.lit("V_stop")).withColumn("train_rank", F.lit(None).cast("long"))
    report = X.leakage_audit(members.unionByName(leak), "sample_id", ["replication"], {"V_stop": 20, "V_scale": 20, "L_prime": 60})
    assert not report.first()["passed"]
    with pytest.raises(Exception, match="leakage audit failed"):
        X.require_passed(report).collect()


def test_audit_counts_each_fault(spark):
    clean = [(i, "stop" if i < 2 else "train", i - 1 if i >= 2 else None) for i in range(6)]
    whole = [(i, "all", None) for i in range(6)]
    sizes = {"all": 6, "stop": 2, "train": 4}
    known = ids(spark, 6).withColumnRenamed("sample_id", "id")

    def report(rows):
        df = spark.createDataFrame([(1, *r) for r in rows], "k long, id long, role string, train_rank long")
        return X.leakage_audit(df, "id", ["k"], sizes, known, whole="all").first().asDict()

    assert report(clean + whole)["passed"]
    for rows, fault in (
        (clean + whole + clean[:1], "repeated"),
        (clean + whole + [(0, "train", None)], "overlapping"),
        (clean + whole[1:], "not_dealt"),
        (clean + whole + [(99, "all", None), (99, "stop", None)], "unknown_ids"),
        (clean + whole + [(3, "other", None)], "stray_roles"),
        (clean[:4] + [(4, "train", 9)] + clean[5:] + whole, "order_gaps"),
        (clean[:4] + [(4, "train", 4)] + clean[5:] + whole, "order_ties"),
    ):
        got = report(rows)
        assert got[fault] > 0 and not got["passed"]


def test_a_digest_sees_repeated_ids(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    one = spark.createDataFrame([(1,)], "id long")
    assert X.ids_hash(rows, "id").first()["ids_xor"] == X.ids_hash(one, "id").first()["ids_xor"]
    assert X.ids_hash(rows, "id").first()["ids_sum"] != X.ids_hash(one, "id").first()["ids_sum"]


def test_unfit_train_sizes_stop_the_job(spark):
    with pytest.raises(ValueError, match=r"\[90\]"):
        X.train_val_select(ids(spark, 100), "sample_id", [50, 90], [0], 1, min_validation=20)


def test_allocation_sizes(spark):
    source = ids(spark, 15000)
    members = X.allocation_split(source, "sample_id", [0, 1], [300, 500], seed=3)
    counts = {(r["budget"], r["replication"], r["role"]): r["count"] for r in members.groupBy("budget", "replication", "role").count().collect()}
    assert counts[(500, 0, "validation")] == 100 and counts[(500, 1, "effective")] == 400
    one = members.where("budget = 500 AND replication = 0")
    assert source.join(one, "sample_id", "left_anti").count() == 14500
    train = {r["sample_id"] for r in X.nested_train(one, 40).collect()}
    rest = {r["sample_id"] for r in X.correction_set(one, 40).collect()}
    assert not train & rest and len(train | rest) == 400


def test_budget_arithmetic():
    assert X.validation_size(500) == 100 and X.effective_budget(500) == 400
    assert X.validation_size(700, by_budget={700: 33}) == 33
    with pytest.raises(ValueError):
        X.validation_size(500, by_budget={300: 10})
    assert X.s_for_rho(0.05, 50) == 2 and X.s_for_rho(0.0001, 50) == 1 and X.s_for_rho(1.0, 50) == 49


def test_screening_sample_sizes(spark):
    pool = ids(spark, 10).withColumn("split", F.when(F.col("sample_id") < 6, "h_scale").otherwise("target"))
    got = X.screening_sample(pool, "sample_id", 6, 2, seed=1).collect()
    assert sorted(r["screen_row_id"] for r in got) == list(range(6))
    assert all((r["screen_split"] == "train_pool") == (r["sample_id"] < 6) for r in got)
    assert sum(r["screen_split"] == "evaluation" for r in got) == 2


def test_group_split_keeps_groups_whole(spark):
    rows = spark.range(2000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 97))
    out = X.group_split(rows, "g", [0.6, 0.8], ["a", "b", "c"], seed=2)
    assert out.count() == 2000
    assert out.select("g", "split").distinct().count() == rows.select("g").distinct().count()


def test_balanced_sample_keeps_its_size(spark):
    rows = spark.range(1000).withColumn("v", F.when(F.col("id") < 10, 1.0).when(F.col("id") < 400, -1.0).otherwise(0.0))
    out = X.balanced_sample(rows, "id", 120, 3, "target_nonzero_balanced", "v")
    got = {r["stratum"]: r["count"] for r in out.groupBy("stratum").count().collect()}
    assert got == {1: 10, -1: 55, 0: 55}


def test_distinct_texts_keep_the_first_place(spark):
    df = spark.createDataFrame([(0, "same", "right"), (1, "left", " same ")], "id int, headline_a string, headline_b string")
    got = X.distinct_texts(df, "id", ["headline_a", "headline_b"]).orderBy("first_column", "first_id").collect()
    assert [r["text"] for r in got] == ["same", "left", "right"]


def test_cell_grid_numbers_cells(spark):
    plan = X.cell_grid(spark.range(1).drop("id"), {"target": ["a", "b"], "replication": [0, 1, 2], "s": [1, 2], "method": ["m", "n"]})
    rows = plan.orderBy("task_index").collect()
    assert [r["task_index"] for r in rows] == list(range(24))
    assert (rows[0]["method"], rows[1]["method"]) == ("m", "n")
    done = plan.where("task_index < 20")
    assert X.pending_cells(plan, done, ["task_index"]).count() == 4
    with pytest.raises(FileNotFoundError):
        X.require_complete(plan, done, ["task_index"])


def test_draws_equal_full_ranks(spark, monkeypatch):
    from fewlabel.operators import ranking as K

    df = spark.range(3000).select("id", (F.col("id") * 2).alias("v"))
    size = lambda d: {10: 10, 900: 900, 5000: 5000}[d["budget"]]

    def drawn():
        got = K.hash_draws(df, "id", {"budget": [10, 900, 5000], "replication": [0, 1]}, size, 9, "x")
        return {(r["budget"], r["replication"], r["id"], r["v"], r["rank"]) for r in got.collect()}

    import hashlib

    want = set()
    for b in (10, 900, 5000):
        for rep in (0, 1):
            order = sorted(range(3000), key=lambda i: (hashlib.md5(f"9:{b}:{rep}:x:{i}".encode()).hexdigest(), i))
            want |= {(b, rep, i, 2 * i, k + 1) for k, i in enumerate(order[:b])}
    assert drawn() == want
    # cutoffs that are too low are repaired
    monkeypatch.setattr(K, "SLACK", 1e-9)
    full = K.cutoff
    monkeypatch.setattr(K, "cutoff", lambda k, n, slack: "0000000000000001" if slack < 1e-8 else full(k, n, slack))
    assert drawn() == want
