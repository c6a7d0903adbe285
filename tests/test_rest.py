"""Preparation, encoders, folds, neighbours, models, sources."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colprism.fixed_values import LABEL_CODES, STATS_19, STATS_25, TEXT_COLUMNS
from colprism.functions.numeric import abs_limit_1000, abs_limit_10000
from colprism.operators import encoders, evaluate, folds, neighbours, prep, quality, scaleout
from colprism.plans import classify
from colprism.plans.extract import featurize_table
from colprism.sources import tables


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in [*LABEL_CODES, "other", None]], "y_act string")
    assert [r[0] for r in prep.process_targets(df).collect()] == [*map(float, range(9)), None, None]


def test_process_stats(iris):
    raw = featurize_table(iris)
    plain = prep.process_stats(raw, normalize=False)
    assert plain.columns == STATS_25
    scaled = prep.process_stats(raw, normalize=True, abs_limit=abs_limit_1000)
    sums = scaled.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in STATS_25]).first()
    assert all(abs(x) < 1e-9 for x in sums)
    scaler = prep.stats_scaler(raw, abs_limit=abs_limit_1000)
    again = prep.process_stats(raw, normalize=True, abs_limit=abs_limit_1000, scaler=scaler)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scaled.collect()))


def test_process_statistics(iris):
    out = prep.process_statistics(featurize_table(iris), keep=["Attribute_name"])
    assert out.columns == ["Attribute_name", *STATS_19.values()]
    assert out.where(F.col("total_vals") != 0).count() == 0  # constant column


def test_bad_rows(spark):
    rows = [("ok", *["x"] * 5), ("tab\x0b", *["y"] * 5), ("é", *["z"] * 5), ("n", None, "\x00", *["w"] * 3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TEXT_COLUMNS))
    flags = [r["is_bad"] for r in quality.find_bad_rows(df).collect()]
    assert flags == [False, False, True, True]
    assert quality.drop_bad_rows(df).count() == 2


@pytest.mark.parametrize("n,k", [(23, 5), (20, 5), (3, 5), (1000, 7)])
def test_kfold_sizes(spark, n, k):
    sizes = Counter(r["fold"] for r in folds.kfold(spark.range(n), "id", folds=k).collect())
    assert [sizes.get(i, 0) for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_holdout_and_hash_fold(spark):
    df = spark.range(4000)
    rest, test = folds.holdout_split(df, "id")
    assert rest.count() + test.count() == 4000 and 900 < test.count() < 1100
    assert folds.hash_fold(df, "id").select("fold").distinct().count() == 5
    assert sorted(r[0] for r in folds.seeded_shuffle(df, "id").collect()) == list(range(4000))


def test_char_ids(spark):
    train = spark.createDataFrame([("aab",), ("bac",), ("😀a",)], "t string")
    dictionary = {r["char"]: r["id"] for r in encoders.char_dictionary(train, "t").collect()}
    assert dictionary == {"a": 1, "b": 2, "c": 3, "😀": 4}
    encoder = encoders.CharEncoder.fit(train, "t")
    texts = spark.createDataFrame([("Ab?😀",), ("",), ("abcabcabc",)], "t string")
    got = [r[0] for r in texts.select(encoder.padded(F.col("t"), 5)).collect()]
    assert got == [[0, 0, 1, 2, 4], [0, 0, 0, 0, 0], [2, 3, 1, 2, 3]]


def test_vocabulary_is_alphabetical(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "Nab")], "id int, t string")
    vocabulary = encoders.gram_vocabulary(df, "t")
    assert [r["gram"] for r in vocabulary.orderBy("gram_index").collect()] == ["ab", "an", "ba", "na"]
    counts = {(r[0], r[1]): r[2] for r in encoders.encode_grams(df, "id", "t", vocabulary).collect()}
    assert counts == {(1, 1): 2, (1, 2): 1, (1, 3): 2, (2, 0): 1, (2, 3): 1}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def points(spark):
    """A third of all points are one and the same; others cluster."""
    draw = random.Random(5)
    rows = []
    for i in range(360):
        if i % 3 == 0:
            rows.append((i, "hot", 1.0, 1.0, i % 4, i % 5))
        else:
            name = "".join(draw.choice("abc") for _ in range(draw.randint(0, 6)))
            rows.append((i, name, draw.gauss(0, 3), float(draw.randint(0, 5)), i % 4, i % 5))
    return rows, spark.createDataFrame(rows, "id int, name string, a double, b double, y int, fold int")


@pytest.mark.parametrize("alpha", [0, 0.01, 1.0, 50.0])
@pytest.mark.parametrize("by_fold", [False, True])
def test_neighbours_like_brute_force(points, alpha, by_fold):
    rows, df = points
    columns = neighbours.PointColumns("id", "name", ("a", "b"), "y", "fold" if by_fold else None)
    got = {}
    for r in neighbours.nearest(df, df, columns, k=4, alpha=alpha, pivots=6, block_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["place"], round(r["distance"], 9), r["neighbour_id"]))
    assert len(got) == len(rows)
    for q in rows[::7]:
        near = sorted(
            (alpha * ((q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2) ** 0.5 + edit(q[1], p[1]), p[0])
            for p in rows
            if not by_fold or p[5] != q[5]
        )[:4]
        assert [(d, i) for _, d, i in sorted(got[q[0]])] == [(round(d, 9), i) for d, i in near]


def test_fewer_training_rows_than_k(spark):
    train = spark.createDataFrame([(1, "a", 0.0, 1)], "id int, name string, x double, y int")
    columns = neighbours.PointColumns("id", "name", ("x",), "y")
    assert neighbours.nearest(train, train, columns, k=3).count() == 1


def test_vote_prefers_the_smaller_label(spark):
    near = spark.createDataFrame(
        [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 1)], "query_id int, place int, label int"
    )
    got = {r["k"]: r["predicted"] for r in neighbours.vote(near, [1, 2, 3, 4]).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1}


def test_cross_validated_neighbours(points):
    _, df = points
    train, test = df.where("id % 6 != 1"), df.where("id % 6 = 1")
    columns = neighbours.PointColumns("id", "name", ("a", "b"), "y", "fold")
    out = neighbours.cross_validated_neighbours(train, test, columns, alphas=[1], counts=[1, 3]).collect()
    assert [r["fold"] for r in sorted(out)] == [0, 1, 2, 3, 4]
    assert all(0 <= r["test"] <= 1 for r in out)


def test_evaluation(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    assert evaluate.accuracy(df, "y", "p").first()[0] == 0.75
    matrix = [tuple(r) for r in evaluate.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()]
    assert matrix == [(0, 1, 1, 0), (1, 0, 2, 0), (2, 0, 0, 0)]
    scores = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.2), (1, 2, 0.3)], "fold int, c int, s double")
    best = evaluate.best_of_grid(scores, ["fold"], "s", ["c"])
    assert sorted(tuple(r) for r in best.collect()) == [(0, 1, 0.5), (1, 2, 0.3)]
    assert sorted(tuple(r) for r in evaluate.winner_counts(best, "c").collect()) == [(1, 1), (2, 1)]
    trials = spark.createDataFrame([("m", 1.0, 2.0, 4), ("m", 3.0, 2.0, 4)], "name string, prepare double, run double, iterations int")
    assert tuple(evaluate.trial_summary(trials).first()) == ("m", 0.5, 0.5, 1.0)


@pytest.mark.parametrize("step,copies", [(0, 1), (1, 1), (2, 2), (3, 4), (6, 32)])
def test_scaling_series(spark, step, copies):
    assert scaleout.scaled(spark.range(3), step).count() == 3 * copies


@pytest.fixture(scope="module")
def separable(spark):
    draw = random.Random(1)
    rows = []
    for i in range(90):
        y = i % 3
        rows.append((i, ("count", "city", "when")[y] + str(i % 4), float(y) + draw.random() / 3, y == 1, float(y)))
    return spark.createDataFrame(rows, "id int, Attribute_name string, mean double, has_url boolean, label double")


LAYOUT = classify.FeatureLayout(stats=("mean", "has_url"), scaled=("mean", "has_url"))


@pytest.mark.parametrize(
    "make",
    [
        lambda n: classify.logistic(1.0, n),
        lambda n: classify.forest(5, 250),
        lambda n: classify.linear_svm(1.0, n, iterations=10),
        lambda n: classify.perceptron(24, 3, (8,), iterations=60),
    ],
)
def test_models_separate(separable, make, tmp_path):
    size = classify.fit_features(separable, LAYOUT).transform(separable).first()["features"].size
    assert size == 24
    model = classify.fit_pipeline(separable, LAYOUT, make(90))
    tables.save_pipeline(model, str(tmp_path / "model"))
    again = tables.load_pipeline(str(tmp_path / "model"))
    scored = classify.score(separable, again, ["Attribute_name"])
    assert evaluate.accuracy(scored, "label", "prediction").first()[0] > 0.95


def test_grid_search(separable):
    data = folds.kfold(classify.fit_features(separable, LAYOUT).transform(separable), "id")
    result = classify.grid_search(
        data, classify.logistic_grid(values=[0.0001, 1], iterations=20), row_id="id", folds=2, holdout=data
    )
    assert result.scores.count() == 4
    best = result.best.collect()
    assert len(best) == 2 and all(r["holdout"] > 0.9 for r in best)


def test_csv_written_table_and_checkpoint(iris, tmp_path, spark):
    iris.write.csv(str(tmp_path / "iris.csv"), header=True)
    back = tables.read_csv(spark, str(tmp_path / "iris.csv"))
    assert back.dtypes == iris.dtypes and back.count() == 150
    typed = tables.read_csv(spark, str(tmp_path / "iris.csv"), iris.schema)
    assert typed.agg(F.sum("petal_width")).first()[0] == pytest.approx(iris.agg(F.sum("petal_width")).first()[0])
    stored = tables.written(featurize_table(iris), str(tmp_path / "features"))
    assert stored.count() == 5
    assert tables.checkpointed(stored).count() == 5
    assert tables.union_all(iris, iris, iris).count() == 450


def test_labelled_csv(iris, tmp_path, spark):
    features = featurize_table(iris).withColumn("y_act", F.lit("numeric")).withColumn("Record_id", F.lit(3))
    path = str(tmp_path / "labelled.csv")
    features.withColumn("total_vals", F.col("total_vals").cast("double")).write.csv(path, header=True, escape='"')
    got = tables.read_labelled(spark, path)
    assert dict(got.dtypes)["total_vals"] == "bigint" and dict(got.dtypes)["has_url"] == "boolean"
    assert got.where("total_vals = 150").count() == 5
    assert prep.process_stats(got, normalize=True, abs_limit=abs_limit_10000).count() == 5


def test_malformed_cells_are_null(tmp_path, spark):
    folder = tmp_path / "part"
    folder.mkdir()
    (folder / "a").write_text("Record_id,Attribute_name,mean,total_vals\n1,x,n/a,12.0\nq,y,2.5,oops\n")
    got = tables.read_labelled(spark, str(folder), format="csv").orderBy("Attribute_name").collect()
    assert [tuple(r) for r in got] == [(1, "x", None, 12), (None, "y", 2.5, None)]


def test_select_described(iris, spark):
    described = spark.createDataFrame(
        [(1, "species"), (1, "petal_width"), (1, "gone"), (2, "sepal_width"), (None, "sepal_length")],
        "Record_id int, Attribute_name string",
    )
    assert tables.select_described(iris, described, 1).columns == ["petal_width", "species"]
    assert tables.select_described(iris, described, 9).columns == []


def test_written_does_not_overwrite(spark, tmp_path):
    tables.written(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.written(spark.range(4), str(tmp_path / "t"))
    assert tables.written(spark.range(4), str(tmp_path / "t"), mode="overwrite").count() == 4


def test_neighbours_with_missing_statistics(spark):
    rows = [(1, "ab", 1.0, "x"), (2, "ab", None, "y"), (3, "abc", float("nan"), "x"), (4, None, 2.0, "x")]
    df = spark.createDataFrame(rows, "id int, name string, s double, label string")
    columns = neighbours.PointColumns("id", "name", ["s"], "label")
    got = neighbours.nearest(df, df, columns, k=4).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 4} and len(got) == 16
    predicted = {r.query_id: r.predicted for r in neighbours.predict_label(df, df, columns, k=3).collect()}
    assert predicted.keys() == {1, 2, 3, 4} and set(predicted.values()) <= {"x", "y"}


def test_registered_searches_are_whole(spark, monkeypatch):
    import catalog.queries as catalog

    asked, nets = [], []

    def search(data, candidates, *, holdout=None, **rest):
        asked.append(([c.params for c in candidates], candidates[0].estimator(10), holdout.count()))
        assert data.join(holdout, "doc_id").count() == 0
        return classify.GridResult(None, None)

    def network(*args, **rest):
        nets.append((args[2:], rest))
        return classify.logistic(1.0, 10, iterations=1)

    monkeypatch.setattr(catalog.classify, "grid_search", search)
    for name, whole in (("logistic_grid", 10), ("forest_grid", 24), ("svm_grid", 5)):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        points, first, held = asked.pop()
        assert len(points) == whole and held > 0
        machine = first.getClassifier() if name == "svm_grid" else first
        assert name == "forest_grid" or machine.getMaxIter() == 100
    monkeypatch.setattr(catalog.classify, "perceptron", network)
    catalog.QUERIES["perceptron_score"](spark, "/root/testdata/sf0.001")
    assert nets == [((), {})]
