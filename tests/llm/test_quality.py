import random

import numpy as np

from signalframe.llm import quality as q


def corpus(spark, n=1200):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        kind = i % 4
        if kind == 0:
            words[rng.randrange(60)] = rng.choice(["awful1", "awful2", "awful3"])
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = q.report(docs, labels.where("doc_id < 800")).where("doc_id >= 800").collect()
    assert sum(r["kept"] == (r["doc_id"] % 4 > 1) for r in got) >= 0.97 * len(got)
    good, toxic = ([r["expected_grade"] for r in got if r["doc_id"] % 4 == k] for k in (2, 0))
    assert np.mean(good) > np.mean(toxic) + 1
    assert all(1 >= r["p_not_toxic"] >= r["p_good"] >= 0 for r in got)


def graded_rows():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(300)]
    noisy = np.array([(r < 3).sum() + rng.normal(0, 0.8) for r in rows])
    return rows, np.digitize(noisy, [1.0, 2.0])


def loss_of(free, rows, grades, penalty):
    """The mean negative log-likelihood of 12 weights and two thresholds (the second one by the log of its distance), with the penalty."""
    w, low, high = free[:12], free[12], free[12] + np.exp(free[13])
    cut = np.array([-np.inf, low, high, np.inf])
    score = np.array([w[r].sum() for r in rows])
    below = lambda t: 1 / (1 + np.exp(np.clip(score - t, -500, 500)))
    return -np.log(below(cut[grades + 1]) - below(cut[grades])).mean() + penalty / 2 * (w**2).sum()


def gradient_of(free, *rest):
    steps = np.eye(len(free)) * 1e-5
    return np.array([(loss_of(free + h, *rest) - loss_of(free - h, *rest)) / 2e-5 for h in steps])


def test_fit_is_the_optimum_of_an_independent_loss():
    rows, grades = graded_rows()
    model = q.fit(np.array([len(r) for r in rows]), np.concatenate(rows), grades, steps=8000, rate=0.003, penalty=0.01, shift=0.0, chi2=0.0)
    low, high = model.thresholds
    fitted = np.array([*[model.weights[k] for k in range(12)], low, np.log(high - low)])
    rest = rows, grades, 0.01
    assert np.abs(gradient_of(fitted, *rest)).max() < 5e-4
    free = np.zeros(14)  # another way there: plain descent by finite differences
    for _ in range(1500):
        free = free - 1.0 * gradient_of(free, *rest)
    assert np.isclose(loss_of(free, *rest), loss_of(fitted, *rest), atol=1e-5) and np.allclose(free, fitted, atol=0.05)


def test_tails_and_grades_of_a_model():
    model = q.Model({}, np.array([-1.0, 1.0]))
    tails = model.tails(np.array([-50.0, 0.0, 50.0]))
    assert np.allclose(tails, [[0, 0], [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1))], [1, 1]])


def test_screening_keeps_what_tells_grades_apart():
    grade = np.repeat([0, 1, 2], 100)
    column = np.concatenate([np.full(60, 5), np.full(30, 7), np.full(30, 7), np.full(30, 7), np.full(2, 9)])
    of = np.concatenate([np.zeros(60, int), np.zeros(30, int), np.ones(30, int), np.full(30, 2), np.zeros(2, int)])
    useful = q.telling(column, of, np.bincount(grade) / 300, q.SHIFT, q.CHI2)
    assert useful[5] and not useful[7] and not useful[9]


def test_very_long_text_and_clashing_columns(spark):
    docs, labels = corpus(spark, 400)
    more = docs.unionByName(spark.createDataFrame([(9000, "w1 w2 w3 " * 100_000)], docs.schema)).selectExpr("*", "1 AS quality", "2 AS kept", "3 AS grade")
    kept = q.good_documents(more, labels)
    assert kept.columns == more.columns and kept.where("doc_id % 4 > 1").count() >= 190
    assert q.report(more, labels).count() == 401


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a", "y"), (None, "", "z")], "doc_id long, text string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(str, q.good_documents(docs, none).collect())) == sorted(map(str, docs.collect()))
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.report(docs, odd).count() == 3
    assert q.report(docs.limit(0), odd).count() == 0


def test_repeated_documents_and_labels(spark):
    docs, labels = corpus(spark, 40)
    worst = q.graded(labels.unionByName(labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic").where("doc_id = 2")))
    assert {r["doc_id"]: r["grade"] for r in worst.collect()}[2] == 0 and worst.count() == 40
    seen = []
    whole, q.fit = q.fit, lambda sizes, *rest: seen.append(len(sizes)) or whole(sizes, *rest)
    try:
        q.train(docs.unionByName(docs).unionByName(docs), q.graded(labels), sample=25)
    finally:
        q.fit = whole
    assert seen == [25]
