"""Gabor dictionaries on image windows: evaluation as expressions, fitting by gradient descent.

Images are long, (y, x, v). The dictionary is small (G filters of w * w pixels) and
is broadcast; windows and their weights stay distributed. ``GaborLearner.model`` fits each
image in one task, many images side by side; ``GaborLearner.train`` fits one image of any
size over all tasks, with the same losses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions import divide
from signalframe.tables import remove, shuffle_partitions, written


def grid_value(i: Column, size: Column) -> Column:
    """Coordinate i of ``size`` evenly spaced ones from -ceil(size / 2) to floor(size / 2)."""
    low = -F.ceil(size / 2)
    return low + i * size.cast("double") / (size - 1)


def gabor_value(x: Column, y: Column, gamma: Column, sigma: Column, theta: Column, lam: Column, psi: Column) -> Column:
    along, across = x * F.cos(theta) + y * F.sin(theta), -x * F.sin(theta) + y * F.cos(theta)
    envelope = F.exp(-0.5 * (along * along / (sigma * sigma) + across * across / ((sigma / gamma) * (sigma / gamma))))
    return envelope * F.cos(2 * F.pi() / lam * along + psi)


def grid(params: DataFrame, size: Column, keep: list[str]) -> DataFrame:
    """``keep``, xi, yi, gx, gy: the pixel grid of each row."""
    n = size.cast("int")
    span = F.sequence(F.lit(0), n - 1)
    cells = params.withColumn("__n", n).withColumn("xi", F.explode(span)).withColumn("yi", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return cells.select(*keep, "xi", "yi", grid_value(F.col("xi"), F.col("__n")).alias("gx"), grid_value(F.col("yi"), F.col("__n")).alias("gy"))


def basis(params: DataFrame, size: int, key: str = "g") -> DataFrame:
    """key, xi, yi, v: each filter on its grid; ``params`` has gamma, sigma_x, theta, lam, psi."""
    names = ["gamma", "sigma_x", "theta", "lam", "psi"]
    cells = grid(params, F.lit(size), [key, *names])
    return cells.select(key, "xi", "yi", gabor_value(F.col("gx"), F.col("gy"), *[F.col(n) for n in names]).alias("v"))


def windows(image: DataFrame, width: int, size: int, layout: str = "flat") -> DataFrame:
    """window_id, p, v: the image in windows of size * size pixels, as runs of the flattened rows ('flat') or as square tiles ('tile'). Raises where the image isn't a whole number of windows, or of tiles side by side; the last row of tiles may be lower than others."""
    area = size * size
    height, most = image.agg(F.max("y") + 1, F.max("x") + 1).first()
    if (most or 0) > width:
        raise ValueError(f"the image has {most} columns, not {width}")
    if ((height or 0) * width) % area if layout == "flat" else width % size:
        raise ValueError(f"an image of {height} * {width} pixels has no whole number of windows of {size} * {size}")
    if layout == "flat":
        at = F.col("y") * width + F.col("x")
        return image.select(F.floor(at / area).cast("long").alias("window_id"), (at % area).cast("int").alias("p"), "v")
    across = width // size
    window = F.floor(F.col("y") / size) * across + F.floor(F.col("x") / size)
    return image.select(window.cast("long").alias("window_id"), ((F.col("y") % size) * size + F.col("x") % size).cast("int").alias("p"), "v")


def standardize(values: DataFrame, column: str = "v") -> DataFrame:
    """The column less its mean, over its standard deviation (ddof 1), both of the whole table; NaN where all values are the same."""
    moments = values.agg(F.avg(column).alias("__mean"), F.stddev_samp(column).alias("__sd"))
    return values.crossJoin(F.broadcast(moments)).withColumn(column, divide(F.col(column) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")


def forward(weights: DataFrame, filters: DataFrame, size: int) -> DataFrame:
    """window_id, p, v: the weighted sums of filters; ``weights`` has window_id, g, w."""
    flat = filters.select("g", (F.col("xi") * size + F.col("yi")).cast("int").alias("p"), "v")
    return weights.join(F.broadcast(flat), "g").groupBy("window_id", "p").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """mse of two tables of windows."""
    met = a.select("window_id", "p", F.col("v").alias("x")).join(b.select("window_id", "p", F.col("v").alias("y")), ["window_id", "p"])
    return met.agg(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("mse"))


def sparsity(weights: DataFrame, penalty: float) -> DataFrame:
    """penalty: the ratio of the weights' absolute sum and Euclidean norm, times ``penalty``."""
    return weights.agg((F.lit(penalty) * F.sum(F.abs("w")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("penalty"))


#: Of the differences of made and given pixels: what each adds to the loss, and its derivative.
Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
LOSSES: dict[str, Loss] = {
    "mse": lambda r: (r * r, 2 * r),
    "l1": lambda r: (np.abs(r), np.sign(r)),
    "smooth_l1": lambda r: (np.where(np.abs(r) < 1, r * r / 2, np.abs(r) - 0.5), np.clip(r, -1, 1)),
}


@dataclass(frozen=True)
class Adam:
    """Kingma and Ba 2015."""

    rate: float = 0.01
    first: float = 0.9
    second: float = 0.999
    epsilon: float = 1e-8
    slots: ClassVar[int] = 2

    def step(self, epoch: int, value: np.ndarray, grad: np.ndarray, state: list[np.ndarray]) -> None:
        """Changes ``value`` and its ``slots`` arrays of state in place; epochs count from 1."""
        mean, square = state
        mean += (1 - self.first) * (grad - mean)
        square += (1 - self.second) * (grad**2 - square)
        value -= self.rate * (mean / (1 - self.first**epoch)) / (np.sqrt(square / (1 - self.second**epoch)) + self.epsilon)


@dataclass(frozen=True)
class Descent:
    """Gradient descent with momentum."""

    rate: float = 0.01
    momentum: float = 0.0
    slots: ClassVar[int] = 1

    def step(self, epoch: int, value: np.ndarray, grad: np.ndarray, state: list[np.ndarray]) -> None:
        state[0] *= self.momentum
        state[0] += grad
        value -= self.rate * state[0]


@dataclass(frozen=True)
class Trained:
    """What ``GaborLearner.train`` returns: the loss of each epoch, the parameters (5 x G: gamma, sigma_x, theta, lam, psi), and the weights (window_id, w: one for each filter) as a written table."""

    losses: list[float]
    params: np.ndarray
    weights: DataFrame

    def weight_rows(self) -> DataFrame:
        """window_id, g, w."""
        return self.weights.select("window_id", F.posexplode("w").alias("g", "w"))

    def param_rows(self) -> DataFrame:
        """g, gamma, sigma_x, theta, lam, psi."""
        rows = [(g, *map(float, p)) for g, p in enumerate(self.params.T)]
        return self.weights.sparkSession.createDataFrame(rows, "g int, gamma double, sigma_x double, theta double, lam double, psi double")


@dataclass(frozen=True)
class GaborLearner:
    """Options of a fit of ``n_gabors`` filters and window weights to standardised windows, full batch. ``loss`` is a name of ``LOSSES`` or a function like those, ``optimizer`` an ``Adam`` (of ``rate``, if none is given), ``Descent`` or the like, ``progress`` the epochs between two lines of ``report``."""

    size: int
    n_gabors: int
    rate: float = 0.01
    penalty: float = 0.0
    epochs: int = 1000
    seed: int = 0
    normalize: bool = True
    loss: str | Loss = "mse"
    optimizer: Adam | Descent | None = None
    progress: int | None = None
    report: Callable[[str], None] = print

    def _loss(self) -> Loss:
        return LOSSES[self.loss] if isinstance(self.loss, str) else self.loss

    def _optimizer(self) -> Adam | Descent:
        return self.optimizer or Adam(self.rate)

    def first_params(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((5, self.n_gabors))

    def first_weights(self, window_ids: list[int]) -> np.ndarray:
        """The weights of a window before the first epoch, whichever task has it."""
        return np.stack([np.random.default_rng([self.seed, int(w) % (1 << 63), 1]).standard_normal(self.n_gabors) for w in window_ids])

    def _partial(self, p: np.ndarray, w: np.ndarray, x: np.ndarray, cells: int) -> tuple[float, np.ndarray, np.ndarray]:
        """What some windows add to the loss over ``cells`` pixels and to the gradient by parameters (5 x G), and the gradient by their own weights (windows x G); without the penalty."""
        line = -np.ceil(self.size / 2) + np.arange(self.size) * self.size / (self.size - 1)
        gx, gy = (a.ravel()[None, :] for a in np.meshgrid(line, line, indexing="ij"))
        gamma, sigma, theta, lam, psi = (v[:, None] for v in p)
        cos, sin = np.cos(theta), np.sin(theta)
        a, b = gx * cos + gy * sin, -gx * sin + gy * cos
        e = np.exp(-0.5 * (a**2 + (gamma * b) ** 2) / sigma**2)
        phase = 2 * np.pi / lam * a + psi
        c, s = np.cos(phase), np.sin(phase)
        g = e * c
        value, slope = self._loss()(w @ g - x)
        dw, dg = slope @ g.T / cells, w.T @ slope / cells
        da = dg * (-e * s * 2 * np.pi / lam - g * a / sigma**2)
        db = dg * (-g * gamma**2 * b / sigma**2)
        dp = np.stack([(dg * -g * gamma * b**2 / sigma**2).sum(1), (dg * g * (a**2 + (gamma * b) ** 2) / sigma**3).sum(1), (da * b - db * a).sum(1), (dg * e * s * 2 * np.pi * a / lam**2).sum(1), (dg * -e * s).sum(1)])
        return float(value.sum()) / cells, dp, dw

    def _penalised(self, w: np.ndarray, absolute: float, square: float) -> tuple[float, np.ndarray | float]:
        """The penalty of all weights, whose absolute sum and square sum are given, and its gradient by ``w``, some of them."""
        if not self.penalty:
            return 0.0, 0.0
        norm = np.sqrt(square)
        return self.penalty * absolute / norm, self.penalty * (np.sign(w) / norm - absolute * w / norm**3)

    def _step(self, p: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss and gradients by parameters (5 x G) and weights (windows x G), of all windows."""
        loss, dp, dw = self._partial(p, w, x, x.size)
        more, by_weight = self._penalised(w, float(np.abs(w).sum()), float((w**2).sum()))
        return loss + more, dp, dw + by_weight

    def _tell(self, epoch: int, loss: float, penalty: float) -> None:
        if self.progress and epoch % self.progress == 0:
            self.report(f"epoch {epoch}, loss: {loss - penalty}" + (f", penalty: {penalty}" if self.penalty else ""))

    def model(self, values: DataFrame, group: str = "image_id") -> DataFrame:
        """A row for each image with its own fit: group, losses (of each epoch), loss (of what is returned), params (gamma, sigma_x, theta, lam, psi of each filter), window_ids and weights (of each window, one for each filter).

        ``values`` has group, window_id, p and v. An image is fitted by one task.
        """
        options = self

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            table = pdf.pivot(index="window_id", columns="p", values="v")
            x = table.to_numpy(float)
            if options.normalize:
                x = (x - x.mean()) / x.std(ddof=1)
            p, w = options.first_params(), options.first_weights(table.index.to_list())
            rule, history = options._optimizer(), []
            states = [[np.zeros_like(v) for _ in range(rule.slots)] for v in (p, w)]
            for epoch in range(1, options.epochs + 1):
                loss, dp, dw = options._step(p, w, x)
                history.append(loss)
                rule.step(epoch, p, dp, states[0])
                rule.step(epoch, w, dw, states[1])
            return pd.DataFrame({group: [pdf[group].iloc[0]], "losses": [history], "loss": [options._step(p, w, x)[0]], "params": [p.T.tolist()], "window_ids": [table.index.to_list()], "weights": [w.tolist()]})

        kind = values.schema[group].dataType.simpleString()
        return values.groupBy(group).applyInPandas(train, f"`{group}` {kind}, losses array<double>, loss double, params array<array<double>>, window_ids array<long>, weights array<array<double>>")

    def fit(self, values: DataFrame, group: str = "image_id") -> DataFrame:
        """group, epoch, loss: the course of ``model``."""
        return self.model(values, group).select(group, F.posexplode("losses").alias("epoch", "loss"))

    def train(self, values: DataFrame, parts: int | None = None, every: int = 20) -> Trained:
        """Fits one image, ``values`` (window_id, p, v), with its windows dealt over ``parts`` partitions.

        A row holds a window, its weights and their optimizer state. An epoch is one job:
        tasks get the parameters (5 x G numbers), change their windows' weights and send
        on the gradient by the parameters; Spark sums it, and the driver changes the
        parameters. Windows stay in the cluster, cached from one epoch to the next, and are written to
        the shared folder every ``every`` epochs: a lost executor's windows are made anew
        from there with the parameters of the epochs since.
        """
        spark, rule, g, area = values.sparkSession, self._optimizer(), self.n_gabors, self.size**2
        standard = standardize(values) if self.normalize else values
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"])
        windows = standard.groupBy(F.col("window_id").cast("long").alias("window_id")).agg(ordered.alias("x"))
        slots = [f"s{k}" for k in range(rule.slots)]
        schema = "window_id long, x array<double>, w array<double>, " + "".join(f"{s} array<double>, " for s in slots) + "summary array<double>"
        lists = pa.list_(pa.float64())
        names, types = ["window_id", "x", "w", *slots, "summary"], [pa.int64(), *[lists] * (2 + len(slots)), lists]

        def matrix(column: pa.Array, width: int) -> np.ndarray:
            if (column.value_lengths().to_numpy() != width).any():
                raise ValueError(f"a window has not {width} values")
            return column.flatten().to_numpy().reshape(-1, width).copy()

        def rows(ids: pa.Array, *arrays: np.ndarray) -> pa.RecordBatch:
            made = [pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in arrays]
            return pa.RecordBatch.from_arrays([ids, *made, pa.nulls(len(ids), lists)], names)

        def summary(numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types[:-1]], pa.array([numbers], lists)], names)

        def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(3)
            for batch in it:
                if batch.num_rows:
                    x, w = matrix(batch.column(1), area), self.first_weights(batch.column(0).to_pylist())
                    total += len(x) * area, np.abs(w).sum(), (w**2).sum()
                    yield rows(batch.column(0), x, w, *[np.zeros_like(w) for _ in slots])
            yield summary(total)

        def epoch_of(epoch: int, p: np.ndarray, cells: int, absolute: float, square: float) -> Callable:
            def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(5 * g + 3)
                for batch in it:
                    if batch.num_rows:
                        x, w, *state = (matrix(batch.column(k + 1), area if not k else g) for k in range(2 + len(slots)))
                        loss, dp, dw = self._partial(p, w, x, cells)
                        rule.step(epoch, w, dw + self._penalised(w, absolute, square)[1], state)
                        total += np.concatenate([dp.ravel(), [loss, np.abs(w).sum(), (w**2).sum()]])
                        yield rows(batch.column(0), x, w, *state)
                yield summary(total)

            return step

        def summed(state: DataFrame) -> np.ndarray:
            got = state.where("window_id IS NULL").select(F.posexplode("summary").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # 5 G + 3 rows
            return np.array([r["v"] for r in got])

        dealt = windows.repartition(parts or shuffle_partitions(spark), "window_id")
        path, state = written(dealt.mapInArrow(first, schema))
        cells, absolute, square = summed(state)
        p, memory, losses = self.first_params(), [np.zeros((5, g)) for _ in slots], []
        held: DataFrame | None = None
        for epoch in range(1, self.epochs + 1):
            after = state.where("window_id IS NOT NULL").mapInArrow(epoch_of(epoch, p.copy(), int(cells), absolute, square), schema)
            if epoch % every == 0 or epoch == self.epochs:
                old, (path, after) = path, written(after)
                numbers = summed(after)
                remove(spark, old)
            else:
                after = after.persist()
                numbers = summed(after)
            if held is not None:
                held.unpersist()
            held = after if after.is_cached else None
            more = self._penalised(p[:0], absolute, square)[0]
            losses.append(float(numbers[5 * g]) + more)
            self._tell(epoch - 1, losses[-1], more)
            rule.step(epoch, p, numbers[: 5 * g].reshape(5, g), memory)
            absolute, square = numbers[5 * g + 1 :]
            state = after
        return Trained(losses, p, state.where("window_id IS NOT NULL").select("window_id", "w"))


def fitted_params(model: DataFrame, group: str = "image_id") -> DataFrame:
    """group, g, gamma, sigma_x, theta, lam, psi: the filters of a ``GaborLearner.model``."""
    rows = model.select(group, F.posexplode("params").alias("g", "p"))
    return rows.select(group, "g", *[F.col("p")[n].alias(name) for n, name in enumerate(("gamma", "sigma_x", "theta", "lam", "psi"))])


def fitted_weights(model: DataFrame, group: str = "image_id") -> DataFrame:
    """group, window_id, g, w: the weights of a ``GaborLearner.model``."""
    rows = model.select(group, F.explode(F.arrays_zip("window_ids", "weights")).alias("r"))
    return rows.select(group, F.col("r.window_ids").alias("window_id"), F.posexplode("r.weights").alias("g", "w"))


def rebuilt(model: DataFrame, size: int, group: str = "image_id") -> DataFrame:
    """group, window_id, p, v: the windows that a model gives, each image by its own filters."""
    names = ["gamma", "sigma_x", "theta", "lam", "psi"]
    cells = grid(fitted_params(model, group), F.lit(size), [group, "g", *names])
    value = gabor_value(F.col("gx"), F.col("gy"), *[F.col(n) for n in names])
    flat = cells.select(group, "g", (F.col("xi") * size + F.col("yi")).cast("int").alias("p"), value.alias("v"))
    met = fitted_weights(model, group).join(flat, [group, "g"])
    return met.groupBy(group, "window_id", "p").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def crop(image: DataFrame, height: int, width: int) -> DataFrame:
    return image.where((F.col("y") < height) & (F.col("x") < width))
