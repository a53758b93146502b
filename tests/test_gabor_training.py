"""Training of one image over tasks, losses and optimizers, sizes of windows."""

import numpy as np
import pytest

from signalframe.operators import gabor


def image_rows(spark, x):
    rows = [(1, int(n), p, float(v)) for n, r in enumerate(x) for p, v in enumerate(r)]
    return spark.createDataFrame(rows, "image_id int, window_id long, p int, v double")


@pytest.mark.parametrize("options", [{}, {"penalty": 0.05}, {"loss": "smooth_l1", "optimizer": gabor.Descent(0.5, 0.9)}, {"loss": "l1", "normalize": False}])
def test_tasks_train_what_one_task_trains(spark, options):
    x = np.random.default_rng(1).standard_normal((90, 16)) + np.sin(np.arange(16))
    values = image_rows(spark, x)
    learner = gabor.GaborLearner(4, 3, epochs=7, **options)
    whole = learner.model(values).first()
    got = learner.train(values.select("window_id", "p", "v"), parts=5, every=3)
    assert np.allclose(got.losses, whole["losses"], rtol=1e-9) and got.losses[-1] < got.losses[0]
    assert np.allclose(got.params.T, whole["params"], rtol=1e-7)
    weights = {r["window_id"]: r["w"] for r in got.weights.collect()}
    assert np.allclose([weights[n] for n in whole["window_ids"]], whole["weights"], rtol=1e-7)
    assert got.weight_rows().count() == 270 and got.param_rows().count() == 3


def test_progress_is_told(spark):
    said = []
    x = np.random.default_rng(2).standard_normal((6, 16))
    gabor.GaborLearner(4, 2, epochs=4, penalty=0.1, progress=2, report=said.append).train(image_rows(spark, x).drop("image_id"), parts=2)
    assert [s.split(",")[0] for s in said] == ["epoch 0", "epoch 2"] and "penalty" in said[0]


def test_sizes_that_do_not_divide_raise(spark):
    image = spark.createDataFrame([(y, x, 1.0) for y in range(5) for x in range(7)], "y int, x int, v double")
    for size, layout in ((3, "tile"), (3, "flat"), (2, "tile")):
        with pytest.raises(ValueError, match="whole number"):
            gabor.windows(image, 7, size, layout)
    with pytest.raises(ValueError, match="columns"):
        gabor.windows(image, 5, 1)
    assert gabor.windows(image.where("x < 6 and y < 4"), 6, 2, "tile").select("window_id").distinct().count() == 6
    assert gabor.crop(image, 2, 3).count() == 6


def test_standardise_a_constant(spark):
    got = gabor.standardize(spark.createDataFrame([(1.0,), (1.0,)], "v double")).collect()
    assert all(np.isnan(r["v"]) for r in got)
