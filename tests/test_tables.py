"""Hand-computed cases of entropy, evaluation, text, encoding, distances and matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.functions import distance
from counterpoise.functions.info import llr
from counterpoise.operators import (
    aggregate, auc, colloc, encode, entropy, evaluate, matrix, sample, schema, similarity, solve, text,
)
from counterpoise.operators.schema import Roles
from counterpoise.operators.tiles import tile_join
from counterpoise.sources import io
from counterpoise.streaming import auc as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_moments(spark):
    df = frame(spark, [(1, 1.0), (1, 2.0), (1, 4.0), (-1, 99.0)], "k int, x double")
    assert aggregate.variance(aggregate.ignore_marker(df, "k"), ["k"], "x").first()["variance"] == pytest.approx(7 / 3)
    df = frame(spark, [(1.0,), (2.0,), (3.0,)], "x double")
    assert aggregate.variance_given_mean(df, [], "x", 0.0).first()["stddev"] == pytest.approx(2.645751, abs=1e-6)


def test_entropy_cases(spark):
    df = frame(spark, [("a",), ("a",), ("b",), ("c",)], "k string")
    assert entropy.entropy(df, "k").first()[0] == pytest.approx(1.5)
    pairs = frame(spark, [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "k string, v string")
    row = entropy.information_gain(pairs, "k", "v").first()
    assert row["entropy"] == pytest.approx(1.0) and row["conditional"] == pytest.approx(0.688722, abs=1e-6)
    assert row["gain"] == pytest.approx(0.311278, abs=1e-6) and row["ratio"] == pytest.approx(0.311278, abs=1e-6)
    assert entropy.conditional_entropy(pairs, "k", "v").first()[0] == pytest.approx(0.688722, abs=1e-6)


@pytest.mark.parametrize("cells,expected", [((3, 1, 1, 5), 3.554818), ((10, 0, 0, 100), 67.019941)])
def test_llr(spark, cells, expected):
    value = spark.range(1).select(llr(*[F.lit(float(c)) for c in cells])).first()[0]
    assert value == pytest.approx(expected, abs=1e-6)


def test_imbalance_metrics(spark):
    rows = [("p", "p")] * 8 + [("p", "n")] * 2 + [("n", "p")] * 10 + [("n", "n")] * 80 + [("p", None)] * 50
    row = evaluate.imbalance_metrics(frame(spark, rows, "a string, b string"), "a", "b").first()
    assert row["positive"] == "p"
    got = [row[c] for c in ("tpr", "tnr", "auc", "gm", "f_measure")]
    assert got == pytest.approx([0.8, 0.888889, 0.844444, 0.843274, 0.571429], abs=1e-6)


def test_exact_quantiles(spark):
    values = [float(v) for v in np.random.default_rng(0).integers(0, 50, 501)]
    df = frame(spark, [(v,) for v in values], "x double").repartition(4)
    row = evaluate.exact_quantiles(df, "x", {"a": 0.25, "b": 0.9, "c": 0.0, "d": 1.0}).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0.25, 0.9, 0, 1])))


def test_regression_report_without_spread(spark):
    row = evaluate.regression_report(frame(spark, [(1.0, 2.0), (1.0, None)], "a double, p double"), "a", "p").first()
    assert (row["correlation"], row["mae"], row["predictable"], row["unpredictable"]) == (0.0, 1.0, 1, 1)


SAMPLES = [(0, 1, 0.9), (1, 0, 0.2), (2, 1, 0.1), (3, 0, 0.5)]


def test_online_auc_case(spark):
    row = auc.online_auc(frame(spark, SAMPLES, "t long, c int, s double"), ["t"], "c", "s").first()
    assert [row["a0"], row["a1"], row["auc"]] == pytest.approx([0.25, 0.25, 0.5])


def recurrence(rows, window=None):
    scores, means, counts = [[], []], [0.5, 0.5], [0, 0]
    for c, s in rows:
        scores[c] = (scores[c] + [s])[-10:]
        counts[c] += 1
        if counts[0] and counts[1]:
            other = scores[1 - c]
            x = sum(1.0 if s > v else 0.5 if s == v else 0 for v in other) / len(other)
            means[c] += (x - means[c]) / (counts[c] if window is None else min(window, counts[c]))
    return (1 - means[0] + means[1]) / 2


@pytest.mark.parametrize("window", [None, 25])
@pytest.mark.parametrize("rare", [0.5, 0.02])
def test_online_auc_matches_recurrence(spark, monkeypatch, window, rare):
    monkeypatch.setattr(auc, "BLOCK", 16)  # many blocks on few rows
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "b", None][i % 3], int(rng.random() < rare), float(rng.integers(0, 20))) for i in range(600)]
    df = frame(spark, rows, "t long, g string, c int, s double").repartition(5)
    whole = auc.online_auc(df, ["t"], "c", "s", window_size=window).first()["auc"]
    assert whole == pytest.approx(recurrence([(r[2], r[3]) for r in rows], window))
    found = {r["g"]: r["auc"] for r in auc.group_auc(df, ["t"], "c", "s", ["g"], window_size=window).collect()}
    for g in ("a", "b", None):
        assert found[g] == pytest.approx(recurrence([(r[2], r[3]) for r in rows if r[1] == g], window))


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], int(rng.integers(2)), float(rng.integers(0, 9))) for i in range(300)]
    schema_ = "ord1 long, grp string, cls int, score double"
    for b in range(3):
        frame(spark, rows[b * 100 : b * 100 + 100], schema_).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source = source.withColumn("ord2", F.col("ord1"))
    found = {r["grp"]: r for r in stream.run_to_end(stream.auc_stream(source), "t").collect()}
    for g in "ab":
        mine = [(r[2], r[3]) for r in rows if r[1] == g]
        assert found[g]["n0"] + found[g]["n1"] == 150
        assert found[g]["auc"] == pytest.approx(recurrence(mine))


def test_retention_policies(spark, tmp_path):
    rows = [(i, "g", i % 2, float(i)) for i in range(200)]
    frame(spark, rows, "ord1 long, grp string, cls int, score double").write.parquet(str(tmp_path / "in"))
    for policy in ("fair", "random"):
        source = spark.readStream.schema("ord1 long, grp string, cls int, score double").parquet(str(tmp_path / "in"))
        made = stream.auc_stream(source.withColumn("ord2", F.col("ord1")), policy=policy)
        row = stream.run_to_end(made, policy).first()
        assert row["n0"] == row["n1"] == 100 and 0.0 <= row["auc"] <= 1.0


def test_tfidf_weights(spark):
    one = spark.range(1)
    weigh = lambda tf, df: one.select(text.weight_tfidf(F.lit(tf), F.lit(df), None, F.lit(10.0))).first()[0]
    assert weigh(4, 2) == pytest.approx(4.407946, abs=1e-6)
    vectors = frame(spark, [(d, d, 1) for d in range(10)], "doc long, term_id long, tf long")
    assert text.weigh(vectors, "doc", min_df=3).first()["val"] == pytest.approx(1.916291, abs=1e-6)


def test_log_normalize(spark):
    v = frame(spark, [(1, 0, 1.0), (1, 1, 3.0)], "doc long, term_id long, val double")
    got = {r["term_id"]: r["val"] for r in text.normalize(v, "doc", 2.0, log=True).collect()}
    assert [got[0], got[1]] == pytest.approx([0.316228, 0.632456], abs=1e-6)
    with pytest.raises(ValueError):
        text.normalize(v, "doc", math.inf, log=True)


def test_sliding_ngrams(spark):
    tokens = frame(spark, [(1, ["a", "b", "c"]), (2, [])], "doc long, tokens array<string>")
    got = sorted(r["gram"] for r in text.sliding_ngrams(tokens, "doc", 2).collect())
    assert got == sorted(["a", "a", "a b", "b", "b c"])


def test_collocations(spark):
    tokens = frame(spark, [(1, ["a", "b", "c"]), (2, ["a", "b", "d"])], "doc long, tokens array<string>")
    rows = colloc.collocations(tokens, "doc", 2, 2, 1.0).collect()
    assert [(r["gram"], r["freq"]) for r in rows] == [("a b", 2)]
    assert rows[0]["score"] == pytest.approx(5.545177, abs=1e-6)
    longer = colloc.gram_totals(tokens, 3).where("head = 'a b' and tail = 'c'").first()
    assert longer["freq"] == 1


def test_pipeline_with_ngrams(spark):
    docs = frame(spark, [(i, "red apple pie and red apple tart") for i in range(3)] + [(9, "blue")], "id long, text string")
    vectors, terms = text.sparse_vectors(docs, "id", "text", weight="tf", max_df_pct=100, ngram=2, min_llr=0.5)
    names = {r["term"]: r["term_id"] for r in terms.collect()}
    assert "red apple" in names and "apple" in names and "blue" not in names
    tf = {(r["id"], r["term_id"]): r["val"] for r in vectors.collect()}
    assert tf[(0, names["red apple"])] == 2.0 and tf[(0, names["pie"])] == 1.0


def test_encoders(spark):
    df = frame(spark, [(1, "u", 2.0), (2, "v", None)], "id long, w string, x double")
    assert encode.encode_word(df, "id", "w").agg(F.sum("val")).first()[0] == 4.0
    weights = frame(spark, [("u", 4.0)], "word string, weight double")
    got = {r["row"]: r["s"] for r in encode.encode_word(df, "id", "w", weights=weights).groupBy("row").agg(F.sum("val").alias("s")).collect()}
    assert got == {1: 8.0, 2: 4.0}
    assert [tuple(r)[0::2] for r in encode.encode_continuous(df, "id", "x").collect()] == [(1, 2.0)]
    first = encode.adaptive_weights(df, "id", "w").orderBy("id").first()["_weight"]
    assert first == pytest.approx(-math.log(1.5 / 2))


VECTORS = [1.0, 0.0, 1.0], [1.0, 1.0, 0.0]


def test_distances(spark):
    df = frame(spark, [VECTORS], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        distance.cosine(a, b), distance.tanimoto(a, b), distance.manhattan(a, b), distance.chebyshev(a, b),
        distance.minkowski(a, b), distance.sq_euclidean_by_norms(a, b, distance.dot(a, a), distance.dot(b, b)),
    ).first()
    assert list(row) == pytest.approx([0.5, 2 / 3, 2.0, 1.0, 2 ** (1 / 3), 2.0])
    zero = frame(spark, [([0.0], [0.0])], "a array<double>, b array<double>")
    assert list(zero.select(distance.cosine(a, b), distance.tanimoto(a, b)).first()) == [1.0, 0.0]
    with pytest.raises(Exception, match="sizes differ"):
        frame(spark, [([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(
            distance.euclidean(distance.same_size(a, b), b)).collect()


def test_mahalanobis_from_covariance(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    df = frame(spark, [([float(v) for v in p],) for p in points], "vec array<double>")
    mean, cov = solve.covariance(df, "vec")
    assert cov == pytest.approx(np.cov(points.T))
    inverse = solve.inverse_covariance(cov)
    got = df.limit(1).select(distance.mahalanobis(F.col("vec"), solve.array_literal(mean), solve.array_literal(inverse))).first()[0]
    gap = points[0] - mean
    assert got == pytest.approx(math.sqrt(gap @ inverse @ gap))
    with pytest.raises(ValueError):
        solve.inverse_covariance(np.ones((2, 2)))


@pytest.mark.parametrize("seeds", [5, 2000])
def test_seed_blocks_give_the_same_pairs(spark, seeds):
    df = frame(spark, [(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    s = frame(spark, [(i, [0.0, float(i)]) for i in range(12)], "seed long, vec array<double>")
    got = similarity.vector_distance(df, "id", "vec", s, "seed", max_seeds=seeds).collect()
    assert {(r["seed"], r["id"]): r["distance"] for r in got} == {
        (j, i): float(i * i + (1 - j) ** 2) for i in range(20) for j in range(12)
    }


@pytest.mark.parametrize("measure,expected", [
    ("cooccurrence", 2.0), ("tanimoto", 0.5), ("cityblock", 1 / 3), ("cosine", 2 / 3), ("euclidean", 1 / (1 + math.sqrt(2)))])
def test_row_measures(spark, measure, expected):
    entries = frame(spark, [(0, c, 1.0) for c in (1, 2, 3)] + [(1, c, 1.0) for c in (2, 3, 4)], "row long, col long, val double")
    row = similarity.row_pairs(entries, measure).where("a = 0 and b = 1").first()
    assert row["similarity"] == pytest.approx(expected)


def sparse(spark, rows=60, cols=40, seed=0):
    rng = np.random.default_rng(seed)
    dense = rng.integers(1, 6, size=(rows, cols)) * (rng.random((rows, cols)) < 0.15)
    dense[:, 0] = rng.integers(1, 6, rows)  # a column every row has
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    return dense.astype(float), frame(spark, cells, "row long, col long, val double").repartition(4)


@pytest.mark.parametrize("limit", [9, 10_000])
@pytest.mark.parametrize("measure,threshold", [("cosine", 0.6), ("tanimoto", 0.3), ("cooccurrence", 3.0), ("pearson", 0.5)])
def test_threshold_pruning_loses_no_pair(spark, measure, threshold, limit):
    _, entries = sparse(spark)
    every = {(r["a"], r["b"]): r["similarity"] for r in similarity.row_pairs(entries, measure).collect()}
    kept = {(r["a"], r["b"]): r["similarity"] for r in similarity.row_pairs(entries, measure, threshold, limit=limit).collect()}
    assert kept == pytest.approx({k: v for k, v in every.items() if v >= threshold})
    assert len(kept) > 60


def test_hot_keys_are_tiled(spark):
    dense, entries = sparse(spark)
    a = entries.select(F.col("col").alias("k"), F.col("row").alias("l"))
    b = entries.select(F.col("col").alias("k"), F.col("row").alias("r"))
    plain = a.join(b, "k")
    tiled = tile_join(a, b, "k", "l", "r", limit=7)
    assert sorted(map(tuple, tiled.select("k", "l", "r").collect())) == sorted(map(tuple, plain.select("k", "l", "r").collect()))
    product = {(r["row"], r["col"]): r["val"] for r in matrix.times(entries, entries, limit=7).collect()}
    expected = dense.T @ dense
    assert product == {(i, j): expected[i, j] for i in range(40) for j in range(40) if expected[i, j]}


def test_at_b(spark):
    def m(values):
        return frame(spark, [(i, j, float(v)) for i, r in enumerate(values) for j, v in enumerate(r) if v], "row long, col long, val double")

    got = {(r["row"], r["col"]): r["val"] for r in matrix.times(m([[1, 2], [3, 4]]), m([[1, 0, 1], [0, 1, 1]])).collect()}
    assert [[got[i, j] for j in range(3)] for i in range(2)] == [[1, 3, 4], [2, 4, 6]]


def test_conjugate_gradient(spark):
    dense, entries = sparse(spark, 30, 12, 4)
    a = solve.SparseMatrix(entries, 12)
    b = np.arange(12.0)
    x = solve.conjugate_gradient(a, b, lam=0.1, max_iter=40)
    assert dense.T @ (dense @ x) + 0.1 * x == pytest.approx(b, abs=1e-5)
    square = dense[:12].T @ dense[:12] + np.eye(12)
    cells = [(i, j, float(square[i, j])) for i in range(12) for j in range(12)]
    sym = solve.SparseMatrix(frame(spark, cells, "row long, col long, val double"), 12)
    x = solve.conjugate_gradient(sym, b, symmetric=True)
    assert square @ x == pytest.approx(b, abs=1e-5)


def test_lanczos_and_restart(spark, tmp_path):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(50, 8))
    a = solve.DenseMatrix(frame(spark, [([float(v) for v in p],) for p in points], "vec array<double>"), "vec")
    truth = np.sort(np.linalg.eigvalsh(points.T @ points))[::-1]
    values, vectors, _ = solve.lanczos(a, 8)
    assert values == pytest.approx(truth, rel=1e-6)
    path = str(tmp_path / "state")
    solve.lanczos(a, 4, save_to=path, spark=spark)
    resumed = solve.lanczos(a, 8, state=solve.LanczosState.load(spark, path))[0]
    assert resumed == pytest.approx(truth, rel=1e-6)
    kept = solve.verify_eigenvectors(a, vectors, 1e-6, min_eigenvalue=float(truth[5]), max_keep=3)
    assert [k[0] for k in kept] == [0, 1, 2]


@pytest.mark.parametrize("center", [False, True])
def test_stochastic_svd(spark, center):
    dense, entries = sparse(spark, 60, 20, 9)
    truth = dense - dense.mean(axis=0) if center else dense
    found = solve.stochastic_svd(entries, 5, p=12, q=2, center=center)
    assert found.sigma == pytest.approx(np.linalg.svd(truth, compute_uv=False)[:5], rel=1e-3)
    q = np.array([r["vec"] for r in found.q.collect()])
    assert q.T @ q == pytest.approx(np.eye(17), abs=1e-8)
    full = solve.stochastic_svd(entries, 20, p=0, center=center)
    got = {r["row"]: r["vec"] for r in full.reconstruct().collect()}
    assert np.array([got[i] for i in range(60)]) == pytest.approx(truth, abs=1e-6)


def test_delimited_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    lines = ["1,2.5,a", "", "2 ?,b".replace(" ", ","), "3 4 c"]
    frame(spark, [(x,) for x in lines], "value string").write.text(path)
    roles = Roles("l", numeric=["x"], categorical=["id"])
    got = sorted(tuple(r) for r in io.read_delimited(spark, path, ["id", "x", "l"], roles).collect())
    assert got == [("1", 2.5, "a"), ("3", 4.0, "c")]
    with pytest.raises(Exception, match="expected 3 values"):
        io.parse_delimited(frame(spark, [("1,2",)], "value string"), ["id", "x", "l"], roles).collect()


def test_header_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    with open(path, "w") as out:
        out.write("head\n1,2\n\"x\",3\n")
    assert [r[0] for r in io.read_lines(spark, path, skip_header=True).collect()] == ["1,2", '"x",3']
    target = str(tmp_path / "out")
    io.write(spark.range(3), target)
    with pytest.raises(Exception):
        io.write(spark.range(3), target)
    io.write(spark.range(5), target, overwrite=True)
    assert spark.read.parquet(target).count() == 5
    io.write_text_rows(frame(spark, [(1, None)], "a long, b string"), str(tmp_path / "txt"), ["a", "b"])
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "1,?"


def test_codes_round_trip(spark):
    df = frame(spark, [(1, "b"), (2, "a"), (3, "zz"), (4, None)], "id long, g string")
    codes = schema.dictionary(df.where("g <> 'zz'"), ["g"])
    coded = schema.encode_categories(df, ["g"], codes)
    assert {r["id"]: r["g"] for r in coded.collect()} == {1: 1, 2: 0, 3: -1, 4: -1}
    back = schema.decode_categories(coded, ["g"], codes)
    assert {r["id"]: r["g"] for r in back.collect()} == {1: "b", 2: "a", 3: "unknown", 4: "unknown"}


def test_sampling_invariants(spark):
    df = spark.range(500)
    bag = sample.bootstrap(df, ["id"])
    assert bag.agg(F.sum("copies")).first()[0] == 500
    assert bag.count() + sample.out_of_bag(df, ["id"]).count() == 500
    taken, rest = sample.random_split(df, ["id"], 123)
    assert (taken.count(), rest.count()) == (123, 377) and taken.join(rest, "id").count() == 0
    assert sample.bernoulli_sample(df, ["id"], 1.0).count() == 500
    dealt = sample.stratified_partition(df.withColumn("c", F.col("id") % 2), "c", ["id"], 7)
    sizes = [r["count"] for r in dealt.groupBy("c", "part").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 14
    places = sorted(r["place"] for r in sample.interleave_classes(df.withColumn("c", F.col("id") < 100), "c", ["id"], True).collect())
    assert places == list(range(500))
