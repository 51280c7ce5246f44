import numpy as np

from tessera.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = T.graded(docs, labels).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").filter("held_out").toPandas()
    assert (got["toxic"] == got["truth"]).mean() > 0.96
    bad, clean = got[got["truth"] == 1], got[got["truth"] == 0]
    assert (bad["toxic"] == 1).mean() > 0.75 and (clean["toxic"] == 0).mean() > 0.98
    assert got["severity"].between(0, 3).all()


def test_ordinal_fit():
    noise = np.random.default_rng(0)
    x = noise.normal(size=(2000, 3))
    z = x @ [1.5, -1.0, 0.0] + noise.logistic(size=2000)
    grades = np.searchsorted([0.5, 1.5, 3.0], z)
    rows, cols = np.repeat(np.arange(2000), 3), np.tile(np.arange(3), 2000)
    w, t = T.fit(rows, cols, x.ravel(), grades, 3, steps=600, ridge=0.0)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.25) and np.allclose(t, [0.5, 1.5, 3.0], atol=0.35) and (np.diff(t) > 0).all()


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (8, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert T.graded(awkward, labels).count() == 12
    assert T.graded(nothing, labels).count() == 0
    assert {r["toxic"] for r in T.graded(awkward, labels.limit(0)).collect()} == {0}


def test_repeated_ids_train_the_same_model(spark):
    noise = np.random.default_rng(3)
    words = lambda some: " ".join(noise.choice(some, 30))
    fine, foul = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)], ["vilest", "scumbag"]
    rows = [(i % 60, words(fine + foul * 40) if i % 60 < 15 else words(fine)) for i in range(180)]
    labels = spark.createDataFrame([(i, int(i < 15)) for i in range(60)], "doc_id long, toxic int")
    models = [T.train(spark.createDataFrame(some, "doc_id long, text string").repartition(n), labels) for some, n in ((rows, 2), (rows[::-1], 5))]
    assert models[0].vocabulary == models[1].vocabulary and np.array_equal(models[0].weights, models[1].weights)


def test_training_statistics_and_margins_against_brute_force(spark):
    """Vocabulary and grades by plain counting over the sample's texts, margins by sums over words."""
    import math
    import zlib

    noise = np.random.default_rng(5)
    fine, foul = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)], ["vilest", "scumbag", "rotten", "filthiest"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        rows.append((i, " ".join(noise.choice(fine + foul * (6 if toxic else 0), int(noise.integers(5, 40))))))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen, bad = {}, {}
    for text, y in kept:
        for f in {f for w in text.split() for f in T.features(w)}:
            seen[f], bad[f] = seen.get(f, 0) + 1, bad.get(f, 0) + y
    toxic, clean, z = sum(y for _, y in kept), sum(1 - y for _, y in kept), {}
    for f, d in seen.items():
        t, c = bad[f] + 0.5, d - bad[f] + 0.5
        z[f] = (math.log(t / (toxic + 1 - t)) - math.log(c / (clean + 1 - c))) / math.sqrt(1 / t + 1 / c)
    assert model.vocabulary == {f: i for i, f in enumerate(sorted(f for f, d in seen.items() if d >= T.LEAST_DOCUMENTS and abs(z[f]) >= T.LEAST_Z))} and len(model.vocabulary) > 5
    got = model.margins([t for _, t in rows] + [""], T.Hits(model.vocabulary))
    for (_, text), m in zip([*rows, (0, "")], got, strict=True):
        counts = {}
        for w in text.split():
            for f in T.features(w):
                if f in model.vocabulary:
                    counts[f] = counts.get(f, 0) + 1
        assert abs(m - sum(model.weights[model.vocabulary[f]] * (1 + math.log(n)) for f, n in counts.items())) < 1e-9
    assert (got[[i for i, (_, y) in enumerate(labels) if y]].mean() > got[[i for i, (_, y) in enumerate(labels) if not y]].mean()) and (np.diff(model.thresholds) > 0).all()


def test_slopes_of_the_fit():
    """The step that the fit takes first is against the slope of the likelihood, by differences."""
    noise = np.random.default_rng(3)
    x, grades = noise.normal(size=(40, 2)), noise.integers(0, 4, 40)
    rows, cols = np.repeat(np.arange(40), 2), np.tile(np.arange(2), 40)

    def loss(w):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - np.array([2.0, 3.0, 4.0]))))
        full = np.concatenate([np.ones((40, 1)), p, np.zeros((40, 1))], 1)
        return -np.log(full[np.arange(40), grades] - full[np.arange(40), grades + 1]).mean()

    w, _ = T.fit(rows, cols, x.ravel(), grades, 2, steps=1, ridge=0.0)
    slope = [(loss(np.eye(2)[k] * 1e-5) - loss(-np.eye(2)[k] * 1e-5)) / 2e-5 for k in range(2)]
    assert np.array_equal(np.sign(w), -np.sign(slope)) and np.allclose(np.abs(w), 0.05, atol=1e-4)
