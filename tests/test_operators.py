"""Operators of the core library on tables small enough to check by hand or by brute force."""

import itertools
import math
import random
import statistics as st

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groveline.functions import ranks, stats
from groveline.operators import clustering, distances, features, groups, insight, landscape, neighbours, validate


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def vectors(spark, rows, start=0):
    return table(spark, [(i + start, [float(x) for x in r], float(i % 4)) for i, r in enumerate(rows)], "compound_id long, features array<double>, property double")


# Roles and checks


def test_ids(spark):
    df = table(spark, [("a", "x"), ("a", "y"), (None, "z"), (" ", "w")], "key string, v string")
    assert sorted(map(tuple, validate.id_problems(df, "key").collect()), key=str) == [("blank", None, 2), ("duplicate", "a", 2)]
    with pytest.raises(validate.InputError, match="blank id"):
        validate.require_ids(df, "key")
    df = table(spark, [(f"c{i}", f"s{i}", i) for i in range(30)], "`Compound-ID` string, other string, n int")
    assert validate.choose_id(df) == ("Compound-ID", [])
    with pytest.raises(validate.AmbiguousColumn):
        validate.choose_id(df.select(F.col("other").alias("a"), F.col("other").alias("b")))
    assert validate.choose_id(df.select("n"))[1]
    assert validate.named(["Mol ID", "id", "x"], validate.ID_NAMES) == ["Mol ID", "id"]


def test_properties_and_flags(spark):
    df = table(spark, [("1.5",), ("x",), (None,), (" ",), ("NaN",), ("2",)], "p string")
    assert tuple(validate.property_report(df, "p").first()) == (6, 2, 2, 2)
    assert [r["property"] for r in validate.valid_property(df, "p").orderBy("p").collect()] == [1.5, 2.0]
    assert validate.choose_property(["activity", "score"], None, ["score", "activity"], False) == "score"
    with pytest.raises(validate.AmbiguousColumn):
        validate.choose_property(["activity", "score"], None, ["score", "activity"], True)
    with pytest.raises(validate.InputError):
        validate.choose_property(["x"], None, ["score"], False)
    spellings = ["true", "1", "YES", " virtual ", "predicted", "false", "0", "no", "wet", "measured", "experimental", None, "?"]
    got = [r[0] for r in table(spark, [(i, s) for i, s in enumerate(spellings)], "i int, s string").orderBy("i").select(validate.virtual_flag(F.col("s"))).collect()]
    assert got == [True] * 5 + [False] * 8
    assert [validate.structure_tier(x) for x in (0.85, 0.5, 0.49)] == ["high", "medium", "low"]


def test_features_columns(spark):
    df = table(spark, [("a", "1", "x", None, "5"), ("b", None, "y", None, "5")], "compound_id string, f1 string, text string, empty string, f2 string")
    assert validate.feature_columns(df) == ["f1", "f2"]
    assert validate.file_id(["x", "ID"]) == "ID"
    with pytest.raises(validate.InputError):
        validate.file_id(["x"])


def test_scaling(spark):
    df = vectors(spark, [[1, 5, 2], [2, 5, 4], [4, 5, 9]])
    kept, dims = features.drop_constant(df, "compound_id")
    assert dims == [0, 2]
    for scaling, f in (
        ("standard", lambda x: [(v - st.mean(x)) / st.pstdev(x) for v in x]),
        ("robust", lambda x: [(v - st.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)) for v in x]),
    ):
        got = [r["features"] for r in features.scale(kept, "compound_id", scaling).orderBy("compound_id").collect()]
        assert np.allclose(np.array(got).T, [f([1, 2, 4]), f([2, 4, 9])])
    got = [r["features"] for r in features.scale(vectors(spark, [[3, 4], [0, 0]]), "compound_id", "l2").orderBy("compound_id").collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    gaps = table(spark, [(1, [1.0, None]), (2, [None, None]), (3, [5.0, None])], "compound_id long, features array<double>")
    assert [r["features"] for r in features.impute_median(gaps, "compound_id").orderBy("compound_id").collect()] == [[1.0, 0.0], [3.0, 0.0], [5.0, 0.0]]


def test_bits_fold_and_svd(spark):
    df = vectors(spark, [[(-1) ** (i * j // 3) for j in range(70)] for i in range(6)])
    words = {r["compound_id"]: r["w"] for r in df.select("compound_id", features.sign_bits(F.col("features"), 70).alias("w")).collect()}
    for i in range(6):
        assert sum(bin(w % 2**64).count("1") for w in words[i]) == sum((-1) ** (i * j // 3) > 0 for j in range(70))
    raw = table(spark, [(1, [1, 2, 3, 40000]), (2, [1, 2, 3, 40000]), (3, [])], "compound_id long, bits array<int>")
    got = {r["compound_id"]: r["words"] for r in features.fold(raw, "compound_id", "bits", 128).collect()}
    assert got[1] == got[2] and 1 <= sum(bin(w % 2**64).count("1") for w in got[1]) <= 4 and got[3] == [0, 0]
    assert features.svd_size(231, 39972) == 115
    x = np.random.default_rng(0).normal(size=(30, 5)) @ np.random.default_rng(1).normal(size=(5, 12))
    out = features.reduce_svd(vectors(spark, x.tolist()), "compound_id", 12, 5).orderBy("compound_id").collect()
    y = np.array([r["features"] for r in out])
    assert np.allclose(y @ y.T, x @ x.T, atol=1e-6)


# Distances and graphs


def brute(metric, a, b):
    a, b = np.array(a, float), np.array(b, float)
    if metric == "correlation":
        a, b = a - a.mean(), b - b.mean()
    if metric in ("cosine", "correlation"):
        n = math.sqrt((a @ a) * (b @ b))
        return 1 - (a @ b / n if n else 0)
    if metric == "manhattan":
        return np.abs(a - b).sum()
    if metric == "generalized_tanimoto":
        return 1 - (np.minimum(a, b).sum() / np.maximum(a, b).sum() if np.maximum(a, b).sum() else 1)
    if metric in ("tanimoto", "jaccard"):
        return 1 - ((a * b).sum() / np.maximum(a, b).sum() if np.maximum(a, b).sum() else 1)
    return math.sqrt(((a - b) ** 2).sum())


@pytest.mark.parametrize("metric", sorted(distances.KERNELS))
def test_distances(spark, metric):
    rng = random.Random(5)
    bits = metric in ("tanimoto", "jaccard")
    rows = [[rng.randint(0, 1 if bits else 5) for _ in range(9)] for _ in range(11)] + [[0] * 9, [0] * 9]
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in distances.all_pairs(vectors(spark, rows), "compound_id", metric).collect()}
    assert set(got) == set(itertools.combinations(range(13), 2))
    assert all(abs(d - brute(metric, rows[a], rows[b])) < 1e-9 for (a, b), d in got.items())


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Blocks meet where they are read: no copy of a block is shuffled for each other block."""
    monkeypatch.setattr(distances, "BYTES", 8 * 3 * 4)
    rows = [[i % 7, i // 7, 1] for i in range(40)]
    df = distances.all_pairs(vectors(spark, rows), "compound_id", "euclidean", digits=6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "FlatMapGroups" not in plan
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in df.collect()}
    assert got == {(a, b): round(brute("euclidean", rows[a], rows[b]), 6) for a, b in itertools.combinations(range(40), 2)}


def test_rounding_and_near_pairs():
    assert distances.half_up(np.array([0.0000005, -0.0000005, 0.1234565, -1e-17, 1 - 1 / 128]), 6).tolist() == [0.000001, -0.000001, 0.123457, 0.0, 0.992188]
    x = np.array([[1e3, 1e3], [1e3, 1e3 + 1e-9], [0, 0], [-1e3, 5]])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(distances.KERNELS["euclidean"](x, x), want, rtol=1e-12, atol=0)
    rng = np.random.default_rng(1)
    for m in (rng.normal(size=(50, 9)), rng.integers(0, 9, (50, 9)).astype(float), rng.integers(0, 40_000, (50, 9)).astype(float)):
        low, high = np.minimum(m[:, None], m[None]).sum(-1), np.maximum(m[:, None], m[None]).sum(-1)
        assert np.allclose(distances.KERNELS["generalized_tanimoto"](m, m), 1 - np.divide(low, high, out=np.ones_like(low), where=high > 0))


@pytest.mark.parametrize("metric", ["cosine", "correlation", "euclidean", "manhattan", "generalized_tanimoto"])
def test_nearest_by_estimates(metric, monkeypatch):
    """Estimates leave the same rows as all distances would, with copies, rows of nothing and values that aren't finite."""
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "COLUMNS", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)) * rng.choice([1e-3, 1, 50], (90, 1))
    x[20:35], x[50:70:2], x[5] = x[19], 0, x[88] + 1e-9
    odd = x.copy()
    odd[7, 2], odd[40, 1] = np.nan, np.inf
    for y in (np.abs(x) if metric == "generalized_tanimoto" else x, *([] if metric != "manhattan" else [odd])):
        for same, k in ((True, 5), (False, 5), (True, 200)):
            with np.errstate(invalid="ignore"):
                d = np.array([[np.abs(a - b).sum() if metric == "manhattan" else brute(metric, a, b) for b in y] for a in y])
                got = list(neighbours.nearest(metric, y, y, same, k))
            d = np.round(np.where(np.isnan(d), np.inf, d), 12)
            p, q, v = (np.concatenate(c) for c in zip(*got, strict=True))
            for i in range(len(y)):
                order = [j for j in np.lexsort((np.arange(len(y)), d[i])) if j != i or not same][:k]
                # sums in another order may differ in the last of the 12 decimals
                own = np.where(np.isnan(v[p == i]), np.inf, v[p == i])
                assert np.allclose(own, d[i, order], atol=2e-12) and np.allclose(own, d[i, q[p == i]], atol=2e-12) and len(set(q[p == i])) == len(order)


def test_packed_tanimoto(spark):
    df = table(spark, [([3, 0], [1, 0]), ([0, 0], [0, 0]), ([-1, 1], [1, 0])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(distances.packed_tanimoto(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 1 / 65]


def test_knn_over_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [[rng.randint(0, 3) for _ in range(3)] for _ in range(40)]
    df = vectors(spark, rows)
    want = {i: [(j + 1, n, round(d, 12)) for j, (d, n) in enumerate(sorted((round(brute("euclidean", rows[i], rows[n]), 12), n) for n in range(40) if n != i)[:4])] for i in range(40)}
    for most in (2048, 7):
        monkeypatch.setattr(neighbours, "blocks", lambda d, k, most=most: distances.blocks(d, k, most, min(most, 256)))
        got = {}
        for r in neighbours.knn(df, "compound_id", "euclidean", 4).orderBy("compound_id", "neighbor_rank").collect():
            got.setdefault(r["compound_id"], []).append((r["neighbor_rank"], r["neighbor_compound_id"], r["distance"]))
        assert got == want
    assert neighbours.knn(df.limit(3), "compound_id", "euclidean", 10).count() == 6


def test_graphs(spark):
    e = table(spark, [(1, 2, 1, 0.1), (2, 1, 1, 0.1), (3, 1, 1, 0.4), (3, 2, 2, 0.5)], "compound_id long, neighbor_compound_id long, neighbor_rank int, distance double")
    assert sorted((r["a"], r["b"], round(r["weight"], 6)) for r in neighbours.top_k_graph(e, 1).collect()) == [(1, 2, 0.9), (1, 3, 0.6)]
    assert [(r["a"], r["b"]) for r in neighbours.mutual_graph(e, 1).collect()] == [(1, 2)]


# Ranks and tests


def test_average_ranks(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", float(rng.randint(0, 9)) if i % 17 else None) for i in range(200)]
    got = ranks.with_average_rank(table(spark, rows, "g string, v double"), ["g"], "v", "r").collect()
    assert len(got) == 200
    for g in "ab":
        values = sorted(v for x, v in rows if x == g and v is not None)
        for r in got:
            if r["g"] == g:
                assert r["r"] is None if r["v"] is None else r["r"] == values.index(r["v"]) + (values.count(r["v"]) + 1) / 2


def test_fisher(spark):
    rows = [(3, 1, 1, 3), (0, 5, 4, 1), (10, 0, 0, 10), (2, 3, 50, 900), (0, 0, 3, 3)]

    def exact(a, b, c, d):
        n1, k, n = a + b, a + c, a + b + c + d
        return sum(math.comb(n1, x) * math.comb(n - n1, k - x) for x in range(a, min(n1, k) + 1) if k - x <= n - n1) / math.comb(n, k)

    got = [r[0] for r in table(spark, rows, "a int, b int, c int, d int").select(stats.fisher_greater("a", "b", "c", "d")).collect()]
    assert np.allclose(got, [exact(*r) for r in rows])


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    got = {r["k"]: r["q"] for r in stats.benjamini_hochberg(table(spark, list(enumerate(p)), "k int, p double"), "p", "k", "q").collect()}
    assert got[3] is None and np.allclose([got[0], got[1], got[2], got[4]], [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_odds_and_u(spark):
    odds = table(spark, [(2, 1, 1, 2), (2, 0, 1, 2), (0, 0, 1, 2)], "a int, b int, c int, d int").select(stats.odds_ratio(*map(F.col, "abcd")))
    assert [r[0] for r in odds.collect()] == [4.0, math.inf, None]
    compounds = table(spark, [(i, float(i % 7)) for i in range(40)], "compound_id long, property double")
    members = table(spark, [("g", i, float(i % 7)) for i in range(0, 40, 3)], "group_id string, compound_id long, property double")
    r = insight.mann_whitney(insight.rank_sums(members, compounds)).first()
    x, y = [i % 7 for i in range(0, 40, 3)], [i % 7 for i in range(40) if i % 3]
    assert r["u_statistic"] == sum((a > b) + (a == b) / 2 for a in x for b in y) and 0 < r["mannwhitney_pvalue"] <= 1


# Landscape


def test_landscape_by_hand(spark):
    rows = [("r", 1, 2, 1, 0.0, 1.0, 3.0), ("r", 1, 3, 2, 0.5, 1.0, 1.0), ("r", 2, 1, 1, 0.0, 3.0, 1.0), ("r", 3, 1, 1, 0.5, 1.0, 1.0)]
    e = table(spark, rows, "representation_id string, compound_id long, neighbor_compound_id long, neighbor_rank int, distance double, property double, neighbor_property double").withColumn("abs_delta_property", F.abs(F.col("property") - F.col("neighbor_property")))
    s = {(r["compound_id"], r["neighbor_compound_id"]): r for r in landscape.with_sali(e).collect()}
    assert s[1, 2]["sali"] == 2 / 1e-6 and s[1, 3]["sali"] == 0 and s[1, 2]["distance_percentile_within_representation"] == 1.5 / 4 and s[1, 2]["normalized_sali"] == 2 / 0.375
    local = {r["compound_id"]: r for r in landscape.local_metrics(e).collect()}
    assert local[1]["local_property_variance"] == pytest.approx(st.pvariance([1, 3, 1])) and local[1]["max_abs_delta_property_among_knn"] == 2 and local[2]["local_mean_property"] == 2
    assert {r["compound_id"]: r["local_property_variance"] for r in landscape.local_metrics(e, False).collect()}[2] == 0
    summary = landscape.summary(e.unionByName(e.withColumn("representation_id", F.lit("q"))))
    assert {(r["primary_comparison_rank"], r["primary_comparison_rank_score"]) for r in summary.collect()} == {(1, 1.0)}
    assert {r["stratum"] for r in landscape.strata(table(spark, [(i, float(i)) for i in range(11)], "compound_id long, property double")).collect()} == {"low", "middle", "high"}


# Groups


def small_groups(spark):
    rows = [("A", i) for i in range(6)] + [("B", i) for i in range(1, 6)] + [("C", i) for i in range(5, 9)] + [("D", 20)]
    return table(spark, [(g, i, float(i * i % 10)) for g, i in rows], "group_id string, compound_id long, property double")


def test_human_groups(spark):
    df = table(spark, [("c1", "A;B", "x"), ("c2", " B |C,,B", None), ("c3", None, "x")], "id string, s string, t string")
    got = sorted((r["source_column"], r["label"], r["compound_id"]) for r in groups.human_memberships(df, "id", ["s", "t"], [("s", "t")]).collect())
    assert got == [("s", "A", "c1"), ("s", "B", "c1"), ("s", "B", "c2"), ("s", "C", "c2"), ("s+t", "A;B|x", "c1"), ("t", "x", "c1"), ("t", "x", "c3")]
    ids = {r["membership_reason"]: r["group_id"] for r in groups.human_groups(df, "id", ["s"]).collect()}
    assert ids == {"s=A": "GRP_HUM_001", "s=B": "GRP_HUM_002", "s=C": "GRP_HUM_003"}


def test_relations_meta_and_filter(spark):
    m = small_groups(spark).select("group_id", "compound_id", F.lit("human").alias("membership_source"), F.lit("r=x").alias("membership_reason"))
    rel = groups.relations(m).collect()
    assert [(r["source_group_id"], r["target_group_id"], r["relation_type"], r["shared_compound_count"]) for r in rel] == [("B", "A", "subset_of", 5)]
    meta, lineage = groups.meta_groups(m)
    assert {r["compound_id"] for r in meta.collect()} == set(range(6)) and {r["target_group_id"] for r in lineage.collect()} == {"A", "B"}
    kept, report = groups.final_filter(m, 5)
    assert {r["group_id"] for r in kept.select("group_id").distinct().collect()} == {"A", "B"} and tuple(report.first()) == ("human", 2, 2)
    assert groups.final_filter(m, 5, ["other*"])[0].count() == m.count()


def test_matrix_round_trip(spark):
    m = small_groups(spark).select("group_id", "compound_id")
    compounds = table(spark, [(i,) for i in range(30)], "compound_id long")
    wide = groups.matrix(m, compounds, ["D", "A", "B", "C"])
    assert wide.columns == ["compound_id", "A", "B", "C", "D"] and wide.count() == 30
    assert sorted(map(tuple, groups.from_matrix(wide).collect())) == sorted(map(tuple, m.collect()))
    with pytest.raises(ValueError, match="1 cells"):
        groups.from_matrix(table(spark, [("a", 2)], "compound_id string, g int"))


def test_packed_matrix_of_many_groups(spark):
    """Groups are rows, not columns of a plan: thousands make the same plan as four."""
    m = small_groups(spark).select("group_id", "compound_id")
    compounds = table(spark, [(i,) for i in range(30)], "compound_id long")
    columns, rows = groups.packed_matrix(m, compounds)
    assert [r["group_id"] for r in columns.orderBy("i").collect()] == ["A", "B", "C", "D"] and rows.count() == 30
    assert sorted(map(tuple, groups.from_packed_matrix(columns, rows).collect())) == sorted(set(map(tuple, m.collect())))
    many = spark.range(20_000).select(F.concat(F.lit("G"), "id").alias("group_id"), (F.col("id") % 30).alias("compound_id"))
    columns, rows = groups.packed_matrix(many, compounds)
    assert groups.from_packed_matrix(columns, rows).exceptAll(many).count() == 0 and rows.agg(F.sum(F.size("ones"))).first()[0] == 20_000
    assert len(rows.columns) == 2


def test_cores(spark):
    pairs = table(spark, [("x", 9, i, i + 1) for i in range(12)] + [("y", 12, i, i + 1) for i in range(11)] + [("z", 5, 0, 1)], "core string, heavy_atoms int, id_a long, id_b long")
    ranked = groups.ranked_cores(groups.core_candidates(pairs))
    assert [(r["core"], r["rank"], r["support"], len(r["examples"])) for r in ranked.orderBy("rank").collect()] == [("x", 1, 13, 5), ("y", 2, 12, 5), ("z", 3, 2, 1)]
    for mode, want in (("intersection", {"x", "y"}), ("union", {"x", "y"}), ("top_n_only", {"x", "y"}), ("count_cutoff_only", {"x", "y"}), ("heavy_atom_cutoff_only", {"x", "y"})):
        assert {r["core"] for r in groups.selected_cores(ranked, top_n=2, mode=mode).where("selected").collect()} == want
    members = pairs.select("core", F.col("id_a").alias("compound_id"))
    assert {r["core"] for r in groups.without_nested(ranked, members, 0.9).collect()} == {"y", "z"}
    sweep = groups.parameter_sweep(ranked, members, [1, 3], [1], [4]).orderBy("top_n").collect()
    assert [(r["selected_core_count"], r["full_membership_count"], r["singleton_group_count"]) for r in sweep] == [(1, 12, 0), (3, 24, 1)]


def test_samples(spark):
    df = table(spark, [(i, i % 2 == 0) for i in range(20)], "id long, is_virtual boolean")
    got = groups.wet_first_sample(df, "id", 12).collect()
    assert len(got) == 12 and sum(not r["is_virtual"] for r in got) == 10
    assert groups.wet_first_sample(df.repartition(5), "id", 12).collect() == got
    assert groups.capped_pairs(df, "id", 30).count() == 30


# Insight


def test_profile_and_delta(spark):
    m = small_groups(spark)
    r = {x["group_id"]: x for x in insight.profile(m).collect()}
    y = [i * i % 10 for i in range(6)]
    assert r["A"]["property_variance"] == pytest.approx(st.variance(y)) and r["A"]["property_mad"] == st.median(abs(v - st.median(y)) for v in y)
    got = {x["group_id"]: x["median_pairwise_abs_delta"] for x in insight.pairwise_delta(m).collect()}
    assert got["A"] == st.median(abs(a - b) for a, b in itertools.combinations(y, 2)) and got["D"] is None


@pytest.mark.parametrize("seed", range(6))
def test_median_difference(seed):
    rng = random.Random(seed)
    v = [rng.choice([rng.random(), rng.randint(0, 4), rng.randint(0, 4) / 10]) for _ in range(rng.randint(2, 40))]
    values, weight = np.unique(v, return_counts=True)
    assert insight._median_difference(values, weight) == pytest.approx(st.median(abs(a - b) for a, b in itertools.combinations(v, 2)), abs=1e-12)


def test_direction_flips(spark):
    c = table(spark, [(i, float(i)) for i in range(11)], "compound_id long, property double")
    for higher, high, low in ((True, {8, 9, 10}, {0, 1, 2}), (False, {0, 1, 2}, {8, 9, 10})):
        f = insight.flags(c, insight.thresholds(c, higher_is_better=higher), higher).collect()
        assert {r["compound_id"] for r in f if r["is_high_active"]} == high and {r["compound_id"] for r in f if r["is_low_active"]} == low


def test_diversity_exact_and_sampled(spark):
    m = table(spark, [("g", i) for i in range(30)] + [("h", 99)], "group_id string, compound_id long")
    bits = table(spark, [(i, [i * 37 % 251]) for i in range(30)], "compound_id long, words array<bigint>")
    sim = lambda a, b: 1.0 if not a | b else bin(a & b).count("1") / bin(a | b).count("1")
    s = [sim(i * 37 % 251, j * 37 % 251) for i, j in itertools.combinations(range(30), 2)]
    r = insight.diversity(m, bits).collect()
    assert len(r) == 1 and r[0]["pair_count"] == 435 and r[0]["mode"] == "exact" and r[0]["mean_tanimoto"] == pytest.approx(st.mean(s)) and r[0]["median_tanimoto"] == pytest.approx(st.median(s))
    r = insight.diversity(m, bits, exact=100, sampled=100).first()
    assert r["pair_count"] == 100 and r["mode"] == "sampled" and abs(r["mean_tanimoto"] - st.mean(s)) < 0.15
    g = insight.with_availability(table(spark, [("g",), ("h",)], "group_id string"), insight.diversity(m, bits))
    assert {x["group_id"]: x["structural_diversity_available"] for x in g.collect()} == {"g": True, "h": False}


def test_all_pairs_of_large_groups_count(spark, tmp_path):
    """Groups beyond 200,000 pairs too, and whatever blocks they are dealt into; the SQL has no sample."""
    from groveline import queries

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 64))
    x[5] = -1.0
    table(spark, [(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    table(spark, [(1, i) for i in range(700)] + [(2, i) for i in range(3)] + [(3, 5)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    one = (x > 0).astype(int)
    both, n = one @ one.T, one.sum(1)
    s = (both / np.maximum(n[:, None] + n[None, :] - both, 1))[np.triu_indices(700, 1)]
    got = {r["group_id"]: r for r in queries.q_within_tanimoto(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[2]["pair_count"] == 3 and got[1]["mode"] == "exact" and got[1]["pair_count"] == len(s) == 244_650
    blocks = insight.diversity(queries.delivered(spark, str(tmp_path)), queries.bits(spark, str(tmp_path)), block=100).where("group_id = 1").first()
    for r in (got[1], blocks):
        figures = [r[f"{k}_tanimoto"] for k in ("mean", "min", "max", "p25", "median", "p75")]
        assert figures == pytest.approx([s.mean(), s.min(), s.max(), *np.quantile(s, [0.25, 0.5, 0.75])], abs=1e-6)


def test_pairs_of_groups_are_not_broadcast(spark):
    """Few groups that become many pairs: their rows must not meet in the driver."""
    m = table(spark, [(f"g{g}", i) for g in range(5) for i in range(g * 10, g * 10 + 25)], "group_id string, compound_id long")
    bits = table(spark, [(i, [i * 37 % 251]) if i != 3 else (i, None) for i in range(70)], "compound_id long, words array<bigint>")
    for most in (200_000, 100):
        out = insight.diversity(m, bits, exact=most, sampled=most)
        rows = {r["group_id"]: r for r in out.collect()}
        assert len(rows) == 5 and all(r["pair_count"] == min(most, 300) for r in rows.values())
        plan = out._jdf.queryExecution().executedPlan().toString()
        if most > 300:
            signed = {r["mode"]: r["mean_tanimoto"] for r in insight.diversity(table(spark, [("h", 0), ("h", 1)], "group_id string, compound_id long"), table(spark, [(0, [-1, 3]), (1, [-1, 1])], "compound_id long, words array<bigint>")).collect()}
            assert signed == {"exact": 65 / 66}
        assert not any("Generate" in side for part in plan.split("BroadcastExchange")[1:] for side in [part.split("Exchange")[0]])


def test_redundancy(spark):
    m = small_groups(spark)
    g = table(spark, [("A", 2), ("B", 1), ("C", 3), ("D", 4)], "group_id string, r int")
    got = {x["group_id"]: x for x in insight.redundancy(g, insight.overlaps(m), "r").collect()}
    assert got["A"]["redundant_with_group_id"] == "B" and got["A"]["redundancy_flag"] and not got["B"]["redundancy_flag"] and got["D"]["overlap_count_above_threshold"] == 0


# Clusters


def test_components_and_dbscan(spark):
    nodes = table(spark, [(i,) for i in range(12)], "node long")
    edges = table(spark, [(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (6, 7, 0.8), (6, 8, 0.8), (7, 8, 0.8), (8, 9, 0.7)], "a long, b long, weight double")
    got = dict(map(tuple, clustering.components(nodes, edges).collect()))
    assert got == {**{i: 0 for i in range(5)}, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 11}
    got = {r["node"]: (r["cluster"], r["is_core"]) for r in clustering.dbscan(nodes, edges, 3).collect()}
    assert got[0] == (1, False) and got[2] == (1, True) and got[9] == (6, False) and got[5] == (None, False)
    assert clustering.large_enough(clustering.components(nodes, edges), [], 2).count() == 9


def test_butina_does_not_chain():
    chain = clustering._adjacent("ABCDE", "ABCD", "BCDE", [0.9] * 4)
    assert clustering.butina_order(chain) == {"B": "B", "A": "B", "C": "B", "D": "D", "E": "D"}


def test_average_linkage():
    rng = np.random.default_rng(3)
    x = rng.random((12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    parts = [[i] for i in range(12)]
    mean = lambda p, q: np.mean([d[i, j] for i in p for j in q])
    while len(parts) > 1:
        v, a, b = min((mean(p, q), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(parts), 2))
        if v > 0.4:
            break
        parts[a] += parts.pop(b)
    label = clustering.average_linkage(d, 0.4)
    assert {frozenset(p) for p in parts} == {frozenset(i for i in range(12) if label[i] == c) for c in set(label)}


def test_average_linkage_by_vectors():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 300):
        x = rng.normal(size=(n, 4))
        x[n // 2 : n // 2 + 1] = 0
        u = np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
        cuts = [0.1, 0.5, 0.8]
        for cut, got in zip(cuts, clustering.average_linkage_cosine(x, cuts), strict=True):
            assert got == clustering.average_linkage(1 - u @ u.T, cut)


def test_rounded_pairs_take_less_disk(spark, tmp_path, monkeypatch):
    """A pair of blocks is written by its distances; those that are no numbers or too large for a key stay too."""
    monkeypatch.setattr(distances, "blocks", lambda df, key, f=distances.blocks: f(df, key, least=1500))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    distances.all_pairs(vectors(spark, x), "compound_id", "cosine", digits=5).write.parquet(str(tmp_path / "near"))
    got = spark.read.parquet(str(tmp_path / "near"))
    assert got.count() == got.select("id_a", "id_b").distinct().count() == 3000 * 2999 // 2 and got.where("id_a >= id_b").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "near").glob("*.parquet")) < 5 * 3000 * 2999 / 2
    monkeypatch.setattr(distances, "_repeats", lambda n, pairs: 3.0)
    odd = np.array([[0.0, 1.0], [1e30, 0.0], [math.nan, 1.0], [3.0, 5.0]])
    d = {(r["id_a"], r["id_b"]): r["distance"] for r in distances.all_pairs(vectors(spark, odd), "compound_id", "manhattan", digits=6).collect()}
    assert len(d) == 6 and d[0, 3] == 7.0 and d[0, 1] == d[1, 3] == 1e30 and all(math.isnan(d[k]) for k in d if 2 in k)


def test_average_linkage_in_few_rounds(monkeypatch):
    """Merging goes by rounds of nearest neighbours, not pair by pair: equal rows, ties and rows of nothing too."""
    rng, sought = np.random.default_rng(7), []
    monkeypatch.setattr(clustering, "_most_similar", lambda mean, rows, mark, f=clustering._most_similar: sought.append(len(rows)) or f(mean, rows, mark))
    x = np.vstack([np.tile(rng.normal(size=(1, 8)), (3000, 1)), rng.normal(size=(1500, 8)), np.zeros((2, 8)), np.full((1, 8), np.nan), rng.integers(-1, 2, size=(1500, 8))])
    labels = clustering.average_linkage_cosine(x, [0.8, 0.1])
    assert len(sought) < 60 and len(set(labels[1][:3000])) == 1
    assert all(labels[0].count(i) == 1 for i in range(4500, 4503))
    fine = dict(zip(labels[1], labels[0], strict=True))
    assert all(fine[a] == b for a, b in zip(labels[1], labels[0], strict=True))


def test_butina_in_rounds(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    nodes, edges = table(spark, [(i,) for i in range(63)], "node long"), table(spark, [(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    got = {r["node"]: r["cluster"] for r in clustering.butina(nodes, edges).collect()}
    assert got == clustering.butina_order(clustering._adjacent(range(63), *zip(*pairs, strict=True), [1.0] * len(pairs)))
    summary = clustering.graph_summary(nodes, edges.withColumn("weight", F.col("a") * 1.0)).first()
    weights = [a for a, _ in pairs]
    assert tuple(summary) == (63, len(pairs), min(weights), st.median(weights), max(weights))
    assert tuple(clustering.graph_summary(nodes, edges.limit(0)).first()) == (63, 0, None, None, None)


def test_clusters_beyond_the_guards(spark, tmp_path, monkeypatch):
    """The queries do the whole table; the runs' guards don't end them."""
    from groveline import config, queries

    rng = np.random.default_rng(2)
    table(spark, [(i, r.tolist(), i % 3) for i, r in enumerate(rng.normal(size=(40, 6)))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for m in config.GUARDS:
        monkeypatch.setitem(config.GUARDS, m, 10)
    for name in ("q_butina", "q_hier", "q_louvain", "q_leiden"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == 40 * len({r["parameter_set_id"] for r in rows}) > 40
    assert queries.QUERIES["q_cluster_sensitivity"](spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("refine", [False, True])
def test_communities(refine):
    pairs = [(a + s, b + s) for s in (0, 10, 20) for a, b in itertools.combinations(range(6), 2)] + [(0, 10), (10, 20)]
    near = clustering._adjacent([a + s for s in (0, 10, 20) for a in range(6)], *zip(*pairs), [1.0] * len(pairs))
    label = clustering.louvain(near, refine=refine)
    assert len(set(label.values())) == 3 and label == clustering.louvain(near, refine=refine)
    assert clustering.modularity(near, label) > clustering.modularity(near, {n: 0 for n in near})


def test_sweep_and_grid(spark):
    grid = clustering.grid({"methods": ["butina", "hierarchical", "dbscan", "louvain", "leiden", "connected_components"], "thresholds": [0.6, 0.7, 0.8], "linkage": "average", "min_samples": [3, 5], "resolutions": [0.5, 1.0, 1.5], "top_k": [10, 20]})
    assert len(grid) == 27 and len({clustering.parameter_set_id(g) for g in grid}) == 27
    df = vectors(spark, [[1, 0], [1, 0.1], [0, 1], [0.1, 1], [-1, -1]])
    nodes, edges = df.select(F.col("compound_id").alias("node")), neighbours.full_graph(df, "compound_id", "cosine")
    got = clustering.swept(nodes, edges, [{"method": m, "threshold": 0.9} for m in ("butina", "hierarchical")]).collect()
    assert {(r["parameter_set_id"].split("_")[0], r["node"], r["cluster"]) for r in got} == {(m, n, c) for m in ("butina", "hierarchical") for n, c in ((0, 0), (1, 0), (2, 2), (3, 2), (4, 4))}
    with pytest.raises(clustering.TooLarge):
        clustering.swept(nodes, edges, [{"method": "hierarchical", "threshold": 0.9}], guard=3)
    one = clustering.components(nodes, edges.where("weight > 0.9"))
    assert {(r["cluster"], r["cluster_size"], r["edge_count"]) for r in clustering.cluster_summary(one, edges.where("weight > 0.9")).collect()} == {(0, 2, 1), (2, 2, 1), (4, 1, 0)}


def test_permutation_draws_from_all_values(spark):
    from collections import Counter
    from itertools import combinations

    places = stats.median_places(4, 7, 35_000, np.random.default_rng(1))
    got, want = Counter(zip(*places.tolist(), strict=True)), Counter(c[1:3] for c in combinations(range(1, 8), 4))
    assert set(got) == set(want) and all(abs(got[x] - 1000 * want[x]) < 6 * (1000 * want[x]) ** 0.5 for x in want)
    # most of 150000 values, shifted: a sample of 100000 would give every such group the least p-value
    everything = spark.range(150_000).selectExpr("id AS k", "cast(id div 3 AS double) AS v")
    groups = everything.where("k >= 45000").selectExpr("'top' AS g", "v").union(everything.where("k % 10 < 7 AND k > 60").selectExpr("'alike'", "v")).union(spark.range(3).selectExpr("'none'", "cast(null AS double)"))
    p = {r["g"]: r["permutation_pvalue"] for r in stats.permutation_p(groups, "g", "v", everything).collect()}
    assert p["top"] == 1 / 2001 and p["alike"] > 0.05 and p["none"] is None


def test_permutation_query_draws_as_configured(spark):
    from groveline import queries

    got = [r["permutation_pvalue"] for r in queries.q_permutation(spark, "/root/testdata/sf0.001").collect()]
    assert got and all(abs(p * 2001 - round(p * 2001)) < 1e-6 and 0 < p <= 1 for p in got)


def test_quantiles_by_ranks(spark):
    """As percentile gives them, with ties, nulls, groups without a value and a null group; no task holds a column's values."""
    rng = random.Random(5)
    rows = [(g, rng.choice([None, float(rng.randint(0, 9)), rng.random()]), rng.random()) for g in ("a", "b", None) for _ in range(rng.randint(30, 60))] + [("none", None, 1.0), ("one", 2.5, None)]
    df = table(spark, rows, "representation_id string, sali double, normalized_sali double")
    wanted = {"sali": [("m", 0.5), ("x", 0.9), ("least", 0.0)], "normalized_sali": [("y", 0.99), ("most", 1.0)]}
    want = df.groupBy("representation_id").agg(*[F.percentile(c, F.lit(q)).alias(n) for c, qs in wanted.items() for n, q in qs])
    key = lambda r: str(r[0])
    assert sorted(map(tuple, ranks.quantiles(df, ["representation_id"], wanted).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    plan = landscape.distribution(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "p99" in plan


def test_a_task_leaves_k_rows(spark, monkeypatch):
    """What is the k-th best so far bounds what later blocks give; each task leaves k rows for a row, ties to the smaller id."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 4, (30, 3)).astype(float), rng.integers(0, 4, (90, 3)).astype(float)
    for metric in ("euclidean", "manhattan", "cosine"):
        held = neighbours._Held(pa.array(range(30)), 4)
        for i in (60, 0, 30):
            held.add(neighbours.nearest(metric, x, y[i : i + 30], False, 4, held.within()), pa.array(range(i, i + 30)))
        p, q, d = next(neighbours.nearest(metric, x, y, False, 4))
        got = held.rows()
        assert (got["compound_id"].to_pylist(), got["neighbor_compound_id"].to_pylist(), got["distance"].to_pylist()) == (p.tolist(), q.tolist(), d.tolist())


def test_estimates_bound_distances():
    """Also far from 0, with rows of very different size, with the least and greatest values, and with one value only."""
    rng = np.random.default_rng(6)
    for scale, shift in ((1, 0), (1e-3, 1e6), (1e30, 0), (1e-150, 0), (1, -5)):
        x = rng.normal(size=(60, 5)) * scale + shift
        for z in (x, np.where(np.arange(60)[:, None] == 3, 1e4 * x, x), np.full((60, 5), float(shift))):
            for metric in ("euclidean", "manhattan", "cosine"):
                p, q, d = (np.concatenate(c) for c in zip(*neighbours.nearest(metric, z, z, True, 6), strict=True))
                every = neighbours.ESTIMATES[metric][1](np.repeat(z, 60, 0), np.tile(z, (60, 1))).reshape(60, 60)
                np.fill_diagonal(every, np.inf)
                assert np.allclose(d.reshape(60, 6), np.sort(np.round(every, 12), 1)[:, :6], rtol=1e-9, atol=2e-12)
