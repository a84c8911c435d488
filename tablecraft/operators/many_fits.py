"""Many classifiers fitted side by side: all draws of a search and all folds at once.

A step of all fits is one pass over the data. Tasks read Arrow batches of features, labels and folds, and give sums whose
size depends on the fits only; Spark adds them up. A fit leaves out the rows of its fold; fold -1 leaves out none. The data
is prepared once and kept on the executors' disks; a lost part is prepared again.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix of rows and fits that a task has at once.
AT_ONCE = 4 << 20
#: Pairs of a fit and a class that a row keeps margins for; more fits of boosted trees go one part after another.
CARRIED = 256
#: Rows whose histograms are summed at once, so that their cells stay in a core's cache.
CELL_ROWS = 4096


@dataclass(frozen=True)
class Fit:
    """A model's parameters, and the fold that it doesn't see, or the only one that it sees."""

    params: tuple[tuple[str, float], ...]
    fold: int = -1
    only: bool = False

    def get(self, name: str, default: float) -> float:
        return dict(self.params).get(name, default)


def fits_of(draws: list[dict], folds: int) -> list[Fit]:
    """A fit for each draw and fold."""
    return [Fit(tuple(sorted(d.items())), k) for d in draws for k in range(folds)]


def _rows(df: DataFrame) -> DataFrame:
    """(x, y, fold), in as many parts as there are cores: what a task sends in a pass has the same size for few rows as
    for many, and a part is read batch by batch."""
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)
    return df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), fold.alias("fold")).where("y is not null").repartition(df.sparkSession.sparkContext.defaultParallelism)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(batch.num_rows, -1).astype(float), batch.column("y").to_numpy(), batch.column("fold").to_numpy()


def totals(rows: DataFrame, add: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows, flat and by name, of what ``add`` gives for each batch. A task sends its own sums only, in
    chunks, which Spark adds up."""
    chunk = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for name, v in add(b).items():
                    sums[name] = sums[name] + v if name in sums else v
        for name, v in sums.items():
            flat = np.asarray(v, float).ravel()
            parts = [flat[i : i + chunk] for i in range(0, len(flat), chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["name", "chunk", "v"])

    def together(_, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for b in batches:
            for v in b.column("v"):
                x = np.frombuffer(v.as_buffer(), float)
                total = x if total is None else total + x
            last = b.slice(0, 1)
        yield pa.RecordBatch.from_arrays([last.column("name"), last.column("chunk"), pa.array([total.tobytes()], pa.binary())], ["name", "chunk", "v"])

    schema = "name string, chunk int, v binary"
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.mapInArrow(run, schema).groupBy("name", "chunk").applyInArrow(_typed(together), schema).collect():
        found.setdefault(r["name"], {})[r["chunk"]] = np.frombuffer(bytes(r["v"]), float)
    return {name: np.concatenate([parts[i] for i in sorted(parts)]) for name, parts in found.items()}


def _totals(rows: DataFrame, add, sent) -> dict[str, np.ndarray]:
    return totals(rows, lambda b: add(sent.value, *_arrays(b)))


def _typed(f):
    """The same with the annotations that tell Spark to send a group batch by batch."""
    f.__annotations__ = {"_": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def _broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def _predictions(df: DataFrame, classes: int, scores) -> DataFrame:
    """``df`` with rawPrediction, probability and prediction from ``scores(x)``, an array for each row."""

    @F.pandas_udf("array<double>")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(list(scores(np.stack(x))) if len(x) else [], dtype=object)

    out = df.withColumn("_raw", raw(vector_to_array("features")))
    top = F.array_max("_raw")
    out = out.withColumn("_e", F.transform("_raw", lambda v: F.exp(v - top)))
    share = F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    return out.withColumn("probability", array_to_vector(share)).withColumn("prediction", (F.array_position("_raw", top) - 1).cast("double")).drop("_raw", "_e")


def accuracies(rows: DataFrame, fits: list[Fit], scores, sent) -> np.ndarray:
    """Each fit's accuracy on the fold that it has not seen."""
    folds = np.array([f.fold for f in fits])

    def add(model, x, y, fold):
        hit, n = np.zeros(len(folds)), np.zeros(len(folds))
        for at in range(0, len(y), step := max(1, AT_ONCE // (len(folds) * model.classes))):
            part = slice(at, at + step)
            held = fold[part, None] == folds
            said = scores(model, x[part]).argmax(2)
            hit += ((said == y[part, None]) & held).sum(0)
            n += held.sum(0)
        return {"hit": hit, "n": n}

    found = _totals(rows, add, sent)
    return found["hit"] / np.maximum(found["n"], 1)


# --- logistic regression


@dataclass
class Logistic:
    """Weights (fits, features + 1, classes) on features less ``mean``; the last weight is the intercept."""

    weights: np.ndarray
    mean: np.ndarray

    @property
    def classes(self) -> int:
        return self.weights.shape[2]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, fits, classes)."""
        f, d, k = self.weights.shape
        return (np.c_[x - self.mean, np.ones(len(x))] @ self.weights.transpose(1, 0, 2).reshape(d, f * k)).reshape(len(x), f, k)

    def transform(self, df: DataFrame) -> DataFrame:
        """Predictions of the first fit."""
        first = Logistic(self.weights[:1], self.mean)
        return _predictions(df, self.classes, lambda x: first.scores(x)[:, 0])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_logistic(df: DataFrame, fits: list[Fit], steps: int = 200, tolerance: float = 1e-6) -> tuple[Logistic, np.ndarray]:
    """Multinomial regressions with elastic nets (``regParam``, ``elasticNetParam``, at most ``maxIter`` steps each) on
    standardized features, and their accuracies on the folds left out. All fits go on by accelerated proximal gradient
    steps, a pass each, until none gets better by more than ``tolerance``; the objective is convex, so this is what fits
    one by one end at."""
    rows = _rows(df).persist(StorageLevel.DISK_ONLY)
    try:
        folds, classes = (int(v) + 1 for v in rows.agg(F.max("fold"), F.max("y")).first())
        d = len(rows.select("x").first()["x"])
        nothing = _broadcast(df, None)

        def moments(_, x, y, fold):
            gram = np.zeros((folds, d + 1, d + 1))
            one = np.c_[x, np.ones(len(x))]
            for k in np.unique(fold):
                gram[k] = one[fold == k].T @ one[fold == k]
            return {"gram": gram}

        gram = _totals(rows, moments, nothing)["gram"].reshape(folds, d + 1, d + 1)
        mean = gram.sum(0)[:d, d] / gram.sum(0)[d, d]
        move = np.eye(d + 1)
        move[d, :d] = -mean
        gram = move.T @ gram @ move  # of features less their mean
        seen = np.stack([gram[f.fold] if f.only else gram.sum(0) - (gram[f.fold] if 0 <= f.fold < folds else 0) for f in fits])
        n = seen[:, d, d]
        scale = np.sqrt(np.maximum(np.stack([np.diag(g)[:d] for g in seen]) / n[:, None] - (seen[:, d, :d] / n[:, None]) ** 2, 0) * (n / np.maximum(n - 1, 1))[:, None])
        scale = np.where(scale > 0, scale, np.inf)
        inverse = np.c_[1 / scale, np.ones(len(fits))]  # a constant feature has no weight
        steepest = np.array([np.linalg.eigvalsh(g * np.outer(i, i) / m)[-1] for g, i, m in zip(seen, inverse, n, strict=True)]) / 2
        reg, mix = (np.array([f.get(p, 0.0) for f in fits]) for p in ("regParam", "elasticNetParam"))
        most = np.array([f.get("maxIter", steps) for f in fits])
        ridge, lasso = (reg * (1 - mix))[:, None, None], (reg * mix)[:, None, None]
        rate = 1 / (steepest[:, None, None] + ridge)
        out, only = (np.array([getattr(f, a) for f in fits]) for a in ("fold", "only"))
        free = np.r_[np.ones(d), 0][None, :, None]  # the intercept is not held down

        def add(model: Logistic, x, y, fold):
            f, p, k = model.weights.shape
            slope, loss = np.zeros((p, f * k)), np.zeros(f)
            for at in range(0, len(y), step := max(1, AT_ONCE // (f * k))):
                part = slice(at, at + step)
                q = _softmax(model.scores(x[part]))
                use = ((fold[part, None] == out) == only).astype(float)
                here = np.arange(q.shape[0])
                loss -= (np.log(np.maximum(q[here, :, y[part]], 1e-300)) * use).sum(0)
                q[here, :, y[part]] -= 1
                slope += np.c_[x[part] - model.mean, np.ones(q.shape[0])].T @ (q * use[:, :, None]).reshape(q.shape[0], f * k)
            return {"slope": slope, "loss": loss}

        w = np.zeros((len(fits), d + 1, classes))
        ahead, best, pace = w.copy(), np.full(len(fits), np.inf), np.ones(len(fits))
        going = np.ones(len(fits), bool)
        for step in range(int(min(steps, most.max()))):
            sent = _broadcast(df, Logistic(ahead * inverse[:, :, None], mean))
            sums = _totals(rows, add, sent)
            sent.unpersist()
            slope = sums["slope"].reshape(d + 1, len(fits), classes).transpose(1, 0, 2) * inverse[:, :, None] / n[:, None, None]
            value = sums["loss"] / n + (free * (ridge * ahead**2 / 2 + lasso * abs(ahead))).sum((1, 2))
            new = ahead - rate * (slope + free * ridge * ahead)
            new = np.where(free > 0, np.sign(new) * np.maximum(abs(new) - rate * lasso, 0), new)
            new = np.where(going[:, None, None], new, w)
            back = ((ahead - new) * (new - w)).sum((1, 2)) > 0  # momentum that goes uphill starts anew
            pace = np.where(back, 1.0, pace)
            next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
            ahead = new + ((pace - 1) / next_pace)[:, None, None] * (new - w)
            w, pace = new, next_pace
            going &= (step + 1 < most) & (abs(best - value) > tolerance * np.maximum(1, abs(value)))
            best = value
            if not going.any():
                break
        model = Logistic(w * inverse[:, :, None], mean)
        return model, accuracies(rows, fits, Logistic.scores, _broadcast(df, model))
    finally:
        rows.unpersist()


# --- boosted trees


@dataclass
class Boosted:
    """Trees of all fits in heap order: (fits, rounds, classes, nodes). A node whose feature is -1 is a leaf."""

    cuts: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    depth: int
    rounds: int = 0
    folds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def classes(self) -> int:
        return self.feature.shape[2]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c[~np.isnan(c)], x[:, j]) for j, c in enumerate(self.cuts)], 1)

    def nodes(self, bins: np.ndarray, fit: int, round_: int, k: int, levels: int) -> np.ndarray:
        """The node of each row after so many levels of a tree."""
        feature, cut = self.feature[fit, round_, k], self.bin[fit, round_, k]
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > cut[at]), at)
        return at

    def margins(self, bins: np.ndarray, fit: int) -> np.ndarray:
        """(rows, classes) by the trees of all rounds before the present one."""
        out = np.zeros((len(bins), self.classes))
        for r in range(self.rounds):
            for k in range(self.classes):
                out[:, k] += self.value[fit, r, k][self.nodes(bins, fit, r, k, self.depth)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return np.stack([self.margins(bins, f) for f in range(len(self.feature))], 1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Predictions of the first fit."""
        first = Boosted(self.cuts, self.feature[:1], self.bin[:1], self.value[:1], self.depth, self.rounds)
        return _predictions(df, self.classes, lambda x: first.scores(x)[:, 0])


def _row_hash(x: np.ndarray) -> np.ndarray:
    """A hash of each row's features, the same in every run."""
    with np.errstate(over="ignore"):
        return (np.ascontiguousarray(x).view(np.uint64) * (2 * np.arange(x.shape[1], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))).sum(1, dtype=np.uint64)


def _sampled(h: np.ndarray, round_: int, fit: int, share: float) -> np.ndarray:
    """Which rows, given by their hashes, a round of a fit takes."""
    if share >= 1:
        return np.ones(len(h), bool)
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(round_ * 1_000_003 + fit)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2**53 < share


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, g, h, left g, left h) of the best split of each node from histograms (nodes, features, bins) of
    gradients and curvatures; of equal gains the first. A side has curvature ``least`` at least."""
    gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
    total_g, total_h = g[:, 0].sum(1), h[:, 0].sum(1)
    gr, hr = total_g[:, None, None] - gl, total_h[:, None, None] - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (total_g**2 / (total_h + ridge))[:, None, None]
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf).reshape(len(g), -1)
    at = gain.argmax(1)
    node = np.arange(len(g))
    return gain[node, at], at // gl.shape[2], at % gl.shape[2], total_g, total_h, gl.reshape(len(g), -1)[node, at], hl.reshape(len(g), -1)[node, at]


_BINNED = "bins binary, y int, fold int, hash long, margins binary"


def _packed(rows: np.ndarray) -> pa.Array:
    """A binary cell for each row of an array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows[0].nbytes if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(cells: pa.Array, kind: type) -> np.ndarray:
    """The rows that ``_packed`` gave."""
    ends = np.frombuffer(cells.buffers()[1], np.int64 if pa.types.is_large_binary(cells.type) else np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(cells), -1)


def _binned_batch(b: pa.RecordBatch, model: Boosted) -> tuple[np.ndarray, ...]:
    """(bins, y, fold, hash, margins) of a batch, margins (rows, fits, classes) by the rounds carried so far."""
    shape = (b.num_rows, len(model.feature), model.classes)
    margins = _unpacked(b.column("margins"), np.float64).reshape(shape) if model.rounds else np.zeros(shape)
    return _unpacked(b.column("bins"), np.uint8 if model.cuts.shape[1] < 256 else np.uint16), b.column("y").to_numpy(), b.column("fold").to_numpy(), b.column("hash").to_numpy().view(np.uint64), margins


def _binned_rows(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Rows with the bins of their features, a byte each, and without margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0)
        model = Boosted(cuts, none, none, none, 0)
        for b in batches:
            if b.num_rows:
                x, y, fold = _arrays(b)
                bins = model.binned(x).astype(np.uint8 if cuts.shape[1] < 256 else np.uint16)
                yield pa.RecordBatch.from_arrays([_packed(bins), b.column("y"), b.column("fold"), pa.array(_row_hash(x).view(np.int64)), pa.array([b""] * len(y), pa.binary())], ["bins", "y", "fold", "hash", "margins"])

    return rows.mapInArrow(run, _BINNED)


def _advanced(margins: np.ndarray, bins: np.ndarray, model: Boosted) -> np.ndarray:
    """The margins with those of the trees of the present round."""
    out = margins.copy()
    for i in range(out.shape[1]):
        for k in range(model.classes):
            out[:, i, k] += model.value[i, model.rounds, k][model.nodes(bins, i, model.rounds, k, model.depth)]
    return out


def _carried(binned: DataFrame, sent) -> DataFrame:
    """Rows whose margins have the trees of the round that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, _, _, _, margins = _binned_batch(b, sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], _packed(_advanced(margins, bins, sent.value))], b.schema.names)

    return binned.mapInArrow(run, _BINNED)


def fit_boosted(df: DataFrame, fits: list[Fit], rounds: int = 10, depth: int = 5, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> tuple[Boosted, np.ndarray]:
    """Boosted trees for several classes by softmax (``stepSize``, ``subsamplingRate``, ``maxIter`` and ``maxDepth`` of each
    fit, if given), and their accuracies on the folds left out.

    Features are cut at quantiles once and kept as their bins. Each level of the trees of all classes and fits is one pass:
    tasks sum gradients and curvatures by fit, class, node, feature and bin; sums are added up by fit and class, where the
    best splits are found, and only these go to the driver. Rows carry their margins from round to round.
    """
    rows = _rows(df).persist(StorageLevel.DISK_ONLY)
    held = [rows]
    try:
        classes = int(rows.agg(F.max("y")).first()[0]) + 1
        d = len(rows.select("x").first()["x"])
        cuts = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(d)]).approxQuantile([f"x{j}" for j in range(d)], [i / bins for i in range(1, bins)], 0.001)
        cuts = np.stack([np.r_[u := np.unique(c), np.full(bins - 1 - len(u), np.nan)] for c in cuts])
        binned = _binned_rows(rows, cuts).persist(StorageLevel.DISK_ONLY)
        held.append(binned)
        rounds, depth = (max(int(f.get(p, v)) for f in fits) for p, v in (("maxIter", rounds), ("maxDepth", depth)))
        step = max(1, CARRIED // classes)
        parts = [_fit_part(binned, cuts, fits[at : at + step], at, classes, rounds, depth, ridge, least) for at in range(0, len(fits), step)]
        every = [np.concatenate([getattr(m, name) for m, _ in parts]) for name in ("feature", "bin", "value", "folds", "share")]
        return Boosted(cuts, *every[:3], depth, rounds, *every[3:]), np.concatenate([scores for _, scores in parts])
    finally:
        for df in held:
            df.unpersist()


def _fit_part(binned: DataFrame, cuts: np.ndarray, fits: list[Fit], first: int, classes: int, rounds: int, depth: int, ridge: float, least: float) -> tuple[Boosted, np.ndarray]:
    """As ``fit_boosted`` for some of the fits, of which the first one has the number ``first``."""
    rate, share = (np.array([f.get(p, v) for f in fits]) for p, v in (("stepSize", 0.3), ("subsamplingRate", 1.0)))
    most, deep = (np.array([int(f.get(p, v)) for f in fits]) for p, v in (("maxIter", rounds), ("maxDepth", depth)))
    shape = (len(fits), rounds, classes, 2 ** (depth + 1) - 1)
    model = Boosted(cuts, np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), depth, 0, np.array([f.fold for f in fits]), share)
    now = last = binned
    try:
        for r in range(rounds):
            model.rounds = r
            for level in range(depth):
                sent = _broadcast(binned, model)
                active = [i for i in range(len(fits)) if most[i] > r and deep[i] > level]
                for s in _level(now, sent, active, first, level, ridge, least):
                    i, k, node = s["fit"], s["k"], s["node"]
                    tree = (i, r, k)
                    if level == 0:
                        model.value[(*tree, node)] = -rate[i] * s["g"] / (s["h"] + ridge)
                    if s["gain"] > 1e-12:
                        model.feature[(*tree, node)], model.bin[(*tree, node)] = s["feature"], s["bin"]
                        for child, g, h in ((2 * node + 1, s["lg"], s["lh"]), (2 * node + 2, s["g"] - s["lg"], s["h"] - s["lh"])):
                            model.value[(*tree, child)] = -rate[i] * g / (h + ridge)
                sent.unpersist()
                if level == 0 and last is not binned and last is not now:
                    last.unpersist()  # the present rows are written by now
            sent = _broadcast(binned, model)
            if r + 1 < rounds:
                last, now = now, _carried(now, sent).persist(StorageLevel.DISK_ONLY)

        def add(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            cells, y, fold, _, margins = _binned_batch(b, sent.value)
            unseen = fold[:, None] == sent.value.folds
            right = _advanced(margins, cells, sent.value).argmax(2) == y[:, None]
            return {"hit": (right & unseen).sum(0), "n": unseen.sum(0)}

        found = totals(now, add)
        model.rounds = rounds
        return model, found["hit"] / np.maximum(found["n"], 1)
    finally:
        for df in (last, now):
            if df is not binned:
                df.unpersist()


def _level(binned: DataFrame, sent, active: list[int], first: int, level: int, ridge: float, least: float) -> list:
    """The best split of each node of a level, of all classes of the fits that are active."""
    start, width, bins = 2**level - 1, 2**level, sent.value.cuts.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        d, r = len(model.cuts), model.rounds
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                whole = _binned_batch(b, model)
                for at in range(0, b.num_rows, CELL_ROWS):
                    add(sums, model, d, r, *(v[at : at + CELL_ROWS] for v in whole))
        for (i, k), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["fit", "k", "v"])

    def add(sums, model, d, r, cut, y, fold, h, margins):
        base = cut + np.arange(d) * bins
        for i in active:
            use = np.flatnonzero((fold != model.folds[i]) & _sampled(h, r, first + i, model.share[i]))
            if not len(use):
                continue
            every = len(use) == len(y)
            mine, cells = (cut, base) if every else (cut[use], base[use])
            p = _softmax(margins[use, i])
            g, c = p.copy(), np.maximum(2 * p * (1 - p), 1e-16)
            g[np.arange(len(use)), y[use]] -= 1
            for k in range(model.classes):
                if level == 0:
                    here, cell = slice(None), cells
                else:
                    node = model.nodes(mine, i, r, k, level)
                    here = np.flatnonzero(node >= start)
                    cell = cells[here] + ((node[here] - start) * (d * bins))[:, None]
                flat = cell.ravel()
                both = np.stack([np.bincount(flat, np.repeat(v[here, k], d), width * d * bins) for v in (g, c)])
                if (i, k) in sums:
                    sums[i, k] += both
                else:
                    sums[i, k] = both

    def best(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("v"):
                x = np.frombuffer(v.as_buffer(), float)
                total = x if total is None else total + x
        g, h = total.reshape(2, width, -1, bins)
        found = best_splits(g, h, ridge, least)
        there = np.flatnonzero(found[4] > 0)
        gain, feature, cut, *sums = (v[there] for v in found)
        same = [pa.array(np.full(len(there), k.as_py(), np.int32)) for k in key]
        yield pa.RecordBatch.from_arrays(
            [*same, pa.array((start + there).astype(np.int32)), pa.array(gain), pa.array(feature.astype(np.int32)), pa.array(cut.astype(np.int32)), *(pa.array(v) for v in sums)],
            ["fit", "k", "node", "gain", "feature", "bin", "g", "h", "lg", "lh"],
        )

    best.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sums = binned.mapInArrow(run, "fit int, k int, v binary").groupBy("fit", "k")
    return sums.applyInArrow(best, "fit int, k int, node int, gain double, feature int, bin int, g double, h double, lg double, lh double").collect()
