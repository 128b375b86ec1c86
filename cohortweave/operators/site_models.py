"""Classifiers of all sites in one plan, and models as rows.

Features, logistic regressions and naive Bayes of every site, fold and grid point come from
aggregates over one stored table, so the number of jobs is that of iterations, not of sites times
folds times points. A fitted model is a row; any number of them score records in one plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortweave.functions.expressions import SPLIT_SEED
from cohortweave.session import materialize, shared_dir
from cohortweave.spec import Featureset

#: The set of all training rows of a site; others are named by the fold they leave out.
WHOLE = -1
#: Longest feature vector whose Gram matrix is built.
WIDEST = 512


# --- features ----------------------------------------------------------------


def training_sets(rows: DataFrame, folds: int = 0) -> DataFrame:
    """``rows`` once for each set they belong to: ``set`` and ``validating``.

    A row trains in WHOLE and in the sets of the other folds, and validates in that of its own. Folds
    are a hash of the id, as in cross-validation.
    """
    sets = F.array(*[F.lit(n) for n in (WHOLE, *range(folds))])
    return rows.withColumn("set", F.explode(sets)).withColumn("validating", F.col("set") == _fold(folds))


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("pid", F.lit(SPLIT_SEED)), F.lit(max(1, folds))).cast("int")


def fit_features(sets: DataFrame, featureset: Featureset, policy: str = "keep", strategy: str = "median") -> DataFrame:
    """``(site, set, fills, categories, low, high)`` from the training rows of ``sets``, in one aggregation.

    ``fills`` stand for nulls of numeric variables under policy ``keep``; ``categories`` are the values
    of each categorical one in order, and ``low`` and ``high`` the bounds to scale by.
    """
    numeric = [v.column for v in featureset.independent if not v.is_categorical]
    categorical = [v.column for v in featureset.independent if v.is_categorical]
    middle = {"median": lambda c: F.percentile_approx(c, 0.5, 1000), "mean": F.avg}[strategy]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in numeric:
        value = F.col(f"`{c}`").cast("double")
        aggregates += [middle(value).alias(f"fill_{c}"), F.min(value).alias(f"low_{c}"), F.max(value).alias(f"high_{c}")]
    for c in categorical:
        value = F.col(f"`{c}`").cast("string")
        aggregates += [F.sort_array(F.collect_set(value)).alias(f"values_{c}"), F.count(value).alias(f"known_{c}")]
    fitted = sets.filter(~F.col("validating")).groupBy("site", "set").agg(*aggregates)
    low, high, categories = [], [], []
    for v in featureset.independent:
        if v.is_categorical:
            values = F.col(f"values_{v.column}")
            # Under keep an unknown value is all zeros; else the last of the values is.
            used = values if policy == "keep" else F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
            everywhere = (F.size(values) == 1) & (F.col(f"known_{v.column}") == F.col("n"))
            low.append(F.array_repeat(F.when(everywhere, 1.0).otherwise(0.0), F.size(used)))
            high.append(F.array_repeat(F.lit(1.0), F.size(used)))
            categories.append(values)
        else:
            low.append(F.array(f"low_{v.column}"))
            high.append(F.array(f"high_{v.column}"))
    empty = F.array().cast("array<double>")
    return fitted.select(
        "site",
        "set",
        F.array(*[f"fill_{c}" for c in numeric]).cast("array<double>").alias("fills"),
        F.array(*categories).cast("array<array<string>>").alias("categories"),
        F.concat(empty, *low).alias("low"),
        F.concat(empty, *high).alias("high"),
    )


def _one_hot(values: Column, value: Column) -> Column:
    return F.transform(values, lambda v: F.when(v == value, 1.0).otherwise(0.0))


def feature_vector(featureset: Featureset, policy: str = "keep", fitted: str = "") -> Column:
    """The features of a row that has the columns of ``fit_features``; null where the policy skips the row.

    Numbers, then zeros and ones for the categories, in the order of the variables, scaled to
    [0, 1] by the bounds of the training rows; what is constant there is 0.5. ``fitted`` stands before
    the names of the fitted columns (``"name."`` where they are the fields of a struct).
    """
    parts, n, k = [F.array().cast("array<double>")], 0, 0
    usable = F.lit(True)
    for v in featureset.independent:
        if v.is_categorical:
            value, values = F.col(f"`{v.column}`").cast("string"), F.get(f"{fitted}categories", F.lit(k))
            used = values if policy == "keep" else F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
            parts.append(_one_hot(used, value))
            if policy != "keep":
                usable = usable & F.coalesce(F.array_contains(values, value), F.lit(False))
            k += 1
        else:
            value = F.col(f"`{v.column}`").cast("double")
            parts.append(F.array(F.coalesce(value, F.get(f"{fitted}fills", F.lit(n))) if policy == "keep" else value))
            n += 1
    raw = F.concat(*parts)

    def scale(x: Column, i: Column) -> Column:
        low, high = F.get(f"{fitted}low", i), F.get(f"{fitted}high", i)
        return F.when(high > low, (x - low) / (high - low)).otherwise(0.5)

    if policy == "keep":
        return F.transform(raw, scale)
    other = F.lit(None).cast("array<double>") if policy == "skip" else F.raise_error(F.lit("unseen category")).cast("array<double>")
    return F.when(usable, F.transform(raw, scale)).otherwise(other)


def feature_inputs(featureset: Featureset) -> list[Column]:
    """The independent variables as :class:`_Features` reads them: text for categories, else doubles."""
    return [F.col(f"`{v.column}`").cast("string" if v.is_categorical else "double") for v in featureset.independent]


class _Inputs:
    """Columns of a batch made by :func:`feature_inputs`; categories are looked up once a batch, not once a row."""

    def __init__(self, columns: Sequence[pa.Array], featureset: Featureset):
        self.values = []
        for v, column in zip(featureset.independent, columns, strict=True):
            if v.is_categorical:
                coded = column.dictionary_encode()
                codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
                self.values.append((codes.astype(np.int64), coded.dictionary.to_pylist()))
            else:
                self.values.append((column.is_null().to_numpy(zero_copy_only=False), column.to_numpy(zero_copy_only=False)))


class _Features:
    """What :func:`fit_features` found for a site and set; its vectors are those of :func:`feature_vector`."""

    def __init__(self, row, featureset: Featureset, policy: str):
        self.policy = policy
        self.kinds = [v.is_categorical for v in featureset.independent]
        self.fills = [np.nan if x is None else x for x in row.fills]
        self.places = [{v: i for i, v in enumerate(values)} for values in row.categories]
        self.used = [len(p) if policy == "keep" else max(0, len(p) - 1) for p in self.places]
        low, high = (np.array([np.nan if x is None else x for x in bounds], np.float64) for bounds in (row.low, row.high))
        known = np.array([a is not None and b is not None for a, b in zip(row.low, row.high, strict=True)], bool)
        # As in SQL, what is no number is above all numbers.
        self.scaled = known & ((high > low) | (np.isnan(high) & ~np.isnan(low)))
        self.low = low
        with np.errstate(invalid="ignore"):
            self.span = np.where(self.scaled, high - low, 1.0)
        self.size = len(low)

    def vectors(self, inputs: _Inputs, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The vectors of some rows of a batch, and which of them the policy keeps (None: all)."""
        x, usable, at, k, j = np.zeros((len(rows), self.size), order="F"), None, 0, 0, 0
        for categorical, (codes, values) in zip(self.kinds, inputs.values, strict=True):
            own = codes[rows]
            if categorical:
                places = np.array([self.places[k].get(v, -1) for v in values] + [-1], np.int64)[own]
                for place in range(self.used[k]):
                    x[:, at + place] = places == place
                if self.policy != "keep":
                    usable = places >= 0 if usable is None else usable & (places >= 0)
                at, k = at + self.used[k], k + 1
            else:
                value = values[rows]
                x[:, at] = np.where(own, self.fills[j], value) if self.policy == "keep" else value
                at, j = at + 1, j + 1
        with np.errstate(invalid="ignore", over="ignore"):
            for i in range(self.size):
                x[:, i] = (x[:, i] - self.low[i]) / self.span[i] if self.scaled[i] else 0.5
        if usable is not None and self.policy == "error" and not usable.all():
            raise ValueError("unseen category")
        return x, usable


#: Bytes of a block of packed rows, about; a batch has up to 10,000 blocks.
BLOCK_BYTES = 8192
PACKED = "site string, set int, validating boolean, part int, n int, width int, rows binary"


def _packed(site: str | None, set_: int, validating: bool, part: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a site and set, features and label beside each other, as blocks of a few."""
    rows = np.ascontiguousarray(rows, np.float64)
    each = max(1, BLOCK_BYTES // (8 * rows.shape[1]))
    parts = [rows[i : i + each] for i in range(0, len(rows), each)]
    same = lambda value, kind: pa.array([value] * len(parts), kind)
    return pa.RecordBatch.from_arrays(
        [same(site, pa.string()), same(set_, pa.int32()), same(validating, pa.bool_()), same(part, pa.int32()),
         pa.array([len(p) for p in parts], pa.int32()), same(rows.shape[1] - 1, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
        names=["site", "set", "validating", "part", "n", "width", "rows"],
    )


def _groups(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each code that occurs, and the rows that have it."""
    order = np.argsort(codes, kind="stable")
    sorted_ = codes[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(codes) else []
    for start, end in zip(starts, [*starts[1:], len(codes)]):
        yield int(sorted_[start]), order[start:end]


def packed_features(rows: DataFrame, fitted: DataFrame, featureset: Featureset, policy: str = "keep", folds: int = 0) -> DataFrame:
    """The features and labels of the :func:`training_sets` of ``rows``, by what is ``fitted`` of their site and set, as blocks of rows.

    What is fitted (a row for each site and set) is handed to the tasks. ``part`` numbers the sites and sets, so
    that the blocks may be stored by it. Rows that the policy skips, or whose site and set are not fitted, are left out.
    """
    found = {(r.site, r.set): r for r in fitted.filter("site is not null").collect()}
    names = {key: i for i, key in enumerate(sorted(found))}
    features = {key: _Features(row, featureset, policy) for key, row in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = _Inputs(batch.columns[3:], featureset)
            labels = batch.column(2).to_numpy()
            coded = batch.column(0).dictionary_encode()
            sites = coded.dictionary.to_pylist()
            fold = batch.column(1).to_numpy()
            for code, of_site in _groups(coded.indices.fill_null(len(sites)).to_numpy()):
                for set_ in (WHOLE, *range(folds)) if code < len(sites) else ():
                    key = (sites[code], set_)
                    for validating in (False, True) if set_ != WHOLE else (False,):
                        at = of_site if set_ == WHOLE else of_site[(fold[of_site] == set_) == validating]
                        if key not in features or not len(at):
                            continue
                        x, usable = features[key].vectors(inputs, at)
                        made = np.column_stack([x, labels[at]])
                        made = made if usable is None else made[usable]
                        if len(made):
                            yield _packed(*key, validating, names[key], made)

    columns = [c.alias(f"f{i}") for i, c in enumerate(feature_inputs(featureset))]
    return rows.select("site", _fold(folds).alias("fold"), F.col("label").cast("double"), *columns).mapInArrow(run, PACKED)


def pack(sets: DataFrame) -> DataFrame:
    """``sets(site, set, validating, features, label)`` as blocks of rows, which a pass reads at a fraction of the cost."""
    if "rows" in sets.columns:
        return sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            own, sites = coded.indices.fill_null(len(coded.dictionary)).to_numpy(), [*coded.dictionary.to_pylist(), None]
            at, validating = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
            counts = np.diff(batch.column(3).offsets.to_numpy())
            starts = np.cumsum(counts) - counts
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            labels = batch.column(4).to_numpy()
            low, wide = (int(at.min()), int(counts.max()) + 1) if len(at) else (0, 1)
            for code, rows in _groups((((at - low) * len(sites) + own) * wide + counts) * 2 + validating):
                width = code // 2 % wide
                x = flat[starts[rows][:, None] + np.arange(width)]
                site, set_ = sites[code // 2 // wide % len(sites)], code // 2 // wide // len(sites) + low
                yield _packed(site, set_, bool(code % 2), 0, np.column_stack([x, labels[rows]]))

    return sets.select("site", "set", "validating", "features", F.col("label").cast("double")).mapInArrow(run, PACKED)


#: Rows that are worked on at once: they stay in a processor's cache, and products of so few start no threads beside the task's.
ROWS_AT_A_TIME = 1_536


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str | None, int], bool, np.ndarray]]:
    """Key, whether validating, and rows (features, then the label) of batches ``site, set, validating, n, width, rows``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sites, sets, validating, n, width = (batch.column(i).to_pylist() for i in range(5))
        rows = batch.column(5)
        ends = np.cumsum(pc.binary_length(rows).to_numpy())
        bytes_ = np.frombuffer(rows.buffers()[2], np.uint8)
        first = np.frombuffer(rows.buffers()[1], np.int64 if pa.types.is_large_binary(rows.type) else np.int32)[rows.offset]
        start, from_ = 0, 0
        while start < len(n):
            # Neighbouring blocks of one kind are one array, as they lie.
            end, count = start, 0
            kind = (sites[start], sets[start], validating[start], width[start])
            while end < len(n) and count < ROWS_AT_A_TIME and (sites[end], sets[end], validating[end], width[end]) == kind:
                count, end = count + n[end], end + 1
            to = int(ends[end - 1])
            # Copied, since the buffer need not be aligned.
            values = np.frombuffer(bytes_[int(first) + from_ : int(first) + to].tobytes(), np.float64).reshape(count, kind[3] + 1)
            yield (kind[0], kind[1]), kind[2], values
            start, from_ = end, to


def _blocks(packed: DataFrame) -> DataFrame:
    """The columns that :func:`_unpacked` reads."""
    return packed.select("site", "set", "validating", "n", "width", "rows")


def unpack(packed: DataFrame) -> DataFrame:
    """``(set, validating, features, label)``: packed rows one by one again, for fits of MLlib."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, set_), validating, rows in _unpacked(batches):
            n, width = len(rows), rows.shape[1] - 1
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width))
            features = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows[:, :-1]).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, set_, np.int32)), pa.array(np.full(n, validating)), features, pa.array(rows[:, -1])],
                names=["set", "validating", "features", "label"],
            )

    return _blocks(packed).mapInArrow(run, "set int, validating boolean, features array<double>, label double")


# --- logistic regression ------------------------------------------------------


@dataclass(frozen=True)
class Point:
    """A point of a grid: strength of the penalty and the share of its absolute part."""

    reg_param: float = 0.0
    elasticnet_param: float = 0.0


def _key_numbers(sites: pa.Array, sets: np.ndarray, names: Mapping[tuple[str, int], int]) -> np.ndarray:
    """The number of each row's key; a site and a set are looked up once a batch, not once a row."""
    coded = sites.dictionary_encode()
    values, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    values.append(None)
    low, span = (int(sets.min()), int(np.ptp(sets)) + 1) if len(sets) else (0, 1)
    met, which = np.unique(codes.astype(np.int64) * span + (sets - low), return_inverse=True)
    numbers = np.array([names[values[m // span], int(m % span) + low] for m in met], np.int64)
    return numbers[which]


def _sums(packed: DataFrame, keys: Sequence[tuple[str, int]], size: int, work) -> dict[int, np.ndarray]:
    """Sums over all packed rows of the arrays that ``work(key, features, labels)`` gives: one job."""
    names = {key: i for i, key in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for key, _, rows in _unpacked(batches):
            features = rows[:, :-1]
            if features.shape[1] < size:
                features = np.hstack([features, np.zeros((len(rows), size - features.shape[1]))])
            for name, value in work(names[key], features, rows[:, -1]).items():
                totals[name] = totals[name] + value if name in totals else value
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int64()), pa.array([list(v) for v in totals.values()], pa.list_(pa.float64()))],
                names=["key", "sums"],
            )

    parts = _blocks(packed).mapInArrow(run, "key bigint, sums array<double>")
    added = parts.select("key", F.posexplode("sums").alias("at", "x")).groupBy("key", "at").agg(F.sum("x").alias("x"))
    rows = added.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r["key"]: np.array([e["x"] for e in r["v"]]) for r in rows}


def _descend(hessian: np.ndarray, gradient: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Step that minimizes the quadratic model and the penalty, coordinate by coordinate."""
    new, slope = beta.copy(), gradient - hessian @ beta
    for _ in range(1000):
        largest = 0.0
        for j in range(len(beta)):
            curve = hessian[j, j] + l2[j]
            if curve <= 1e-15:
                continue
            rest = -(slope[j] + hessian[j] @ new - hessian[j, j] * new[j])
            value = np.sign(rest) * max(abs(rest) - l1[j], 0.0) / curve
            largest, new[j] = max(largest, abs(value - new[j]) * np.sqrt(curve)), value
        if largest < 1e-11:
            break
    return new - beta


def fit_logistic(sets: DataFrame, points: Sequence[Point], max_iter: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """``(site, set, point, intercept, coefficients, objective, iterations)`` for all sites, sets and points.

    ``sets(site, set, validating, features, label)`` is packed and stored first, unless it is packed already
    (then it should be stored), as every iteration is one job over it. Penalized by ``reg_param`` as MLlib does, on coefficients of features in units of their
    deviation; the intercept is free. Newton steps from per-site gradients and Gram matrices; the
    penalty's absolute part is met by coordinate descent on the driver, on one small matrix per model.
    """
    spark = sets.sparkSession
    packed = sets if "rows" in sets.columns else materialize(pack(sets.filter(~F.col("validating"))))
    training = packed.filter(~F.col("validating"))
    shape = training.groupBy("site", "set").agg(F.max("width").alias("size")).collect()
    keys = sorted((r["site"], r["set"]) for r in shape)
    sizes = {(r["site"], r["set"]): r["size"] for r in shape}
    if not keys:
        return spark.createDataFrame([], LOGISTIC)
    size = max(sizes.values())
    if size > WIDEST:
        raise ValueError(f"{size} features are too many for Gram matrices")
    first = _sums(training, keys, size, lambda key, x, y: {key: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)])})
    n_points = len(points)
    models = []
    for key, name in enumerate(keys):
        n, positive, total, squares = first[key][0], first[key][1], first[key][2 : 2 + size], first[key][2 + size :]
        spread = np.sqrt(np.maximum(0.0, (squares - total**2 / n) / max(1.0, n - 1)))
        for point in points:
            beta = np.zeros(size + 1)
            beta[-1] = np.log(positive / (n - positive)) if 0 < positive < n else 0.0
            l1 = np.append(point.reg_param * point.elasticnet_param * spread, 0.0)
            l2 = np.append(point.reg_param * (1 - point.elasticnet_param) * spread**2, 0.0)
            models.append(
                {"name": name, "n": n, "beta": beta, "base": beta, "step": np.zeros(size + 1), "l1": l1, "l2": l2,
                 "fixed": np.append(spread == 0, False), "best": np.inf, "done": not 0 < positive < n, "turns": 0}
            )
    # Sets without a fold start from the solution on all rows, from which theirs differ little.
    whole = [k for k, m in enumerate(models) if m["name"][1] == WHOLE]
    others = [k for k, m in enumerate(models) if m["name"][1] != WHOLE]
    for these, read in ((whole, training.filter(F.col("set") == WHOLE)), (others, training.filter(F.col("set") != WHOLE))):
        solved = {(models[k]["name"][0], k % n_points): models[k]["base"] for k in whole} if these is others else {}
        for k in these:
            m, start = models[k], solved.get((models[k]["name"][0], k % n_points))
            if start is not None and not m["done"]:
                m["beta"] = m["base"] = np.where(m["fixed"], 0.0, start)
        for _ in range(max_iter):
            asked = {k: models[k]["beta"] for k in these if not models[k]["done"]}
            if not asked:
                break

            def work(key: int, x: np.ndarray, y: np.ndarray, asked: Mapping[int, np.ndarray] = asked) -> dict[int, np.ndarray]:
                wide = x.shape[1] + 1
                x1 = np.ones((len(x), wide))
                x1[:, :-1] = x
                weighted = np.empty((len(x), wide + 1))
                out = {}
                for k in range(key * n_points, (key + 1) * n_points):
                    if k in asked:
                        margin = _times(x1, asked[k])
                        e = np.exp(-abs(margin))
                        p = np.where(margin >= 0, 1.0, e) / (1 + e)
                        loss = np.log1p(e).sum() + np.maximum(margin, 0).sum() - (y * margin).sum()
                        # The gradient beside the Gram matrix: one product.
                        weighted[:, 0] = p - y
                        np.multiply(x1, (p * (1 - p))[:, None], out=weighted[:, 1:])
                        out[k] = np.concatenate([[loss], (weighted.T @ x1).ravel()])
                return out

            found = _sums(read, keys, size, work)
            for k, m in enumerate(models):
                if k not in found:
                    continue
                sums, beta, wide = found[k] / m["n"], m["beta"], size + 1
                objective = sums[0] + (m["l1"] * abs(beta)).sum() + (m["l2"] * beta**2).sum() / 2
                if objective > m["best"] + 1e-12 * abs(m["best"]) and abs(m["step"]).max() > 1e-12:
                    m["step"] = m["step"] / 2  # too far
                    m["beta"] = m["base"] + m["step"]
                    continue
                gradient, hessian = sums[1 : 1 + wide], sums[1 + wide :].reshape(wide, wide).copy()
                hessian[np.diag_indices(wide)] += 1e-10 * max(1e-12, np.trace(hessian) / wide)
                hessian[m["fixed"]], hessian[:, m["fixed"]], gradient[m["fixed"]] = 0.0, 0.0, 0.0
                step = _descend(hessian, gradient, beta, m["l1"], m["l2"])
                m.update(base=beta, best=objective, step=step, turns=m["turns"] + 1)
                if abs(step @ hessian @ step) < tolerance**1.5 or m["turns"] >= max_iter:
                    m["done"] = True
                else:
                    m["beta"] = beta + step
    rows = [
        (*m["name"], k % n_points, float(m["base"][-1]), [float(b) for b in m["base"][: sizes[m["name"]]]], float(m["best"]), m["turns"])
        for k, m in enumerate(models)
    ]
    return spark.createDataFrame(rows, LOGISTIC)


LOGISTIC = "site string, set int, point int, intercept double, coefficients array<double>, objective double, iterations int"


def logistic_scores(sets: DataFrame, fits: DataFrame) -> DataFrame:
    """``(site, set, point, score, label)`` of the validating rows of ``sets`` by the fits of their set."""
    of_set: dict[tuple[str, int], list[tuple[int, float, np.ndarray]]] = {}
    for r in fits.select("site", "set", "point", "intercept", "coefficients").collect():
        of_set.setdefault((r["site"], r["set"]), []).append((r["point"], r["intercept"], np.array(r["coefficients"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, rows in _unpacked(batches):
            for point, intercept, coefficients in of_set.get(key, []):
                n, score = len(rows), _logistic(_times(rows[:, :-1], coefficients) + intercept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.string()), *[pa.array(np.full(n, i, np.int32)) for i in (key[1], point)], pa.array(score), pa.array(rows[:, -1])],
                    names=["site", "set", "point", "score", "label"],
                )

    held = _blocks(pack(sets.filter("validating")))
    return held.mapInArrow(run, "site string, set int, point int, score double, label double")


# --- trees: equal rows as one ----------------------------------------------------


def _bins(training: DataFrame, most: int) -> dict[tuple[str, int], list[np.ndarray]]:
    """By site and set, for each feature at most ``most`` values that stand for all: its own if they are that few, else quantiles."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, np.ndarray | None] = {}
        for key, _, rows in _unpacked(batches):
            for at in range(rows.shape[1] - 1):
                name, before = (*key, at), met.get((*key, at), ())
                if before is not None:
                    values = np.unique(np.append(rows[:, at], before))
                    met[name] = values if len(values) <= most else None
        for (site, set_, at), values in met.items():
            many, n = values is None, 1 if values is None else len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([site] * n, pa.string()), *[pa.array([i] * n, pa.int32()) for i in (set_, at)], pa.array([None] if many else values, pa.float64())],
                names=["site", "set", "at", "value"],
            )

    found = _blocks(training).mapInArrow(distinct, "site string, set int, at int, value double")
    told = found.groupBy("site", "set", "at").agg(F.bool_or(F.col("value").isNull()).alias("many"), F.sort_array(F.collect_set("value")).alias("own"))
    few = {(r["site"], r["set"], r["at"]): None if r["many"] or len(r["own"]) > most else np.array(r["own"]) for r in told.collect()}

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, rows in _unpacked(batches):
            n = len(rows)
            for at in range(rows.shape[1] - 1):
                if few[(*key, at)] is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * n, pa.string()), *[pa.array(np.full(n, i, np.int32)) for i in (key[1], at)], pa.array(rows[:, at])],
                        names=["site", "set", "at", "value"],
                    )

    if any(own is None for own in few.values()):
        shares = F.array(*[F.lit((k + 0.5) / most) for k in range(most)])
        values = _blocks(training).mapInArrow(long, "site string, set int, at int, value double")
        for r in values.groupBy("site", "set", "at").agg(F.percentile_approx("value", shares, 10000).alias("q")).collect():
            few[(r["site"], r["set"], r["at"])] = np.unique(r["q"])
    sizes: dict[tuple[str, int], int] = {}
    for site, set_, at in few:
        sizes[site, set_] = max(sizes.get((site, set_), 0), at + 1)
    return {key: [few[(*key, at)] for at in range(size)] for key, size in sizes.items()}


def _distinct(codes: np.ndarray, counts: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``codes``, and the sums of their ``counts``; a code is below the size of its column."""
    if np.prod([float(n) for n in sizes]) < 2**62:
        radix = np.cumprod([1, *sizes[:-1]], dtype=np.int64)
        keys = codes.astype(np.int64) @ radix
    else:
        keys = np.ascontiguousarray(codes).view(np.dtype((np.void, codes.dtype.itemsize * codes.shape[1]))).ravel()
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return codes[first], np.bincount(which, counts)


#: Different rows of a site, set and class that a task keeps before it hands them on.
GATHERED_ROWS = 500_000


def gathered_sets(packed: DataFrame, most: int) -> DataFrame:
    """``(site, set, validating, features, label, weight)``: rows in the bins of trees, equal ones as one.

    As :func:`cohortweave.operators.training.gathered`, for all sites and sets in one plan. Rows that validate are moved to the
    values of the rows that train, which their trees send the same way.
    """
    bins = _bins(packed.filter(~F.col("validating")), most)
    edges = {key: [(v[1:] + v[:-1]) / 2 for v in values] for key, values in bins.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told(name: tuple, codes: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
            key, n = name[:2], len(codes)
            moved = np.column_stack([v[codes[:, j]] for j, v in enumerate(bins[key])])
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(moved.shape[1]))
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], np.int32)), pa.array(np.full(n, name[2])),
                 pa.ListArray.from_arrays(offsets, pa.array(moved.ravel())), pa.array(np.full(n, name[3])), pa.array(weights.astype(np.float64))],
                names=["site", "set", "validating", "features", "label", "weight"],
            )

        for key, validating, rows in _unpacked(batches):
            if key not in bins:
                continue
            codes = np.column_stack([np.searchsorted(e, rows[:, j], side="left").astype(np.uint16) for j, e in enumerate(edges[key])])
            sizes = [len(v) for v in bins[key]]
            for label in np.unique(rows[:, -1]):
                name, own = (*key, validating, float(label)), rows[:, -1] == label
                parts = held.setdefault(name, [])
                parts.append(_distinct(codes[own], np.ones(own.sum()), sizes))
                if len(parts) > 1 and sum(len(c) for c, _ in parts) > 2 * max(len(parts[0][0]), ROWS_AT_A_TIME):
                    parts[:] = [_distinct(np.concatenate([c for c, _ in parts]), np.concatenate([w for _, w in parts]), sizes)]
                if len(parts[0][0]) > GATHERED_ROWS:
                    yield from (told(name, *part) for part in parts)
                    del held[name]
        for name, parts in held.items():
            yield from (told(name, *part) for part in parts)

    parts = _blocks(packed).mapInArrow(run, "site string, set int, validating boolean, features array<double>, label double, weight double")
    return parts.groupBy("site", "set", "validating", "features", "label").agg(F.sum("weight").alias("weight"))


# --- naive Bayes ---------------------------------------------------------------


def class_statistics(rows: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """``(by, label, n, sums, squares)``: what naive Bayes needs, from ``features`` and ``label``, in one pass.

    Statistics of disjoint rows add up, so those of the rows outside a fold are the total less the fold's.
    """
    keys = [*by, "label"]
    if "rows" in rows.columns:
        return _packed_statistics(rows, by)
    long = rows.select(*keys, F.posexplode("features").alias("at", "x"))
    sums = long.groupBy(*keys, "at").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    held = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("v"))
    return held.select(*keys, "n", F.col("v.s").alias("sums"), F.col("v.q").alias("squares"))


def _packed_statistics(packed: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`class_statistics` of packed rows: sums per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for key, _, rows in _unpacked(batches):
            for label in np.unique(rows[:, -1]):
                x = rows[rows[:, -1] == label, :-1]
                told = np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
                name = (*key, float(label))
                totals[name] = totals[name] + told if name in totals else told
        for (site, set_, label), told in totals.items():
            size = told.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([site] * size, pa.string()), pa.array([set_] * size, pa.int32()), pa.array([label] * size, pa.float64()),
                 pa.array(range(size), pa.int32()), pa.array(told[0].astype(np.int64)), pa.array(told[1]), pa.array(told[2])],
                names=["site", "set", "label", "at", "n", "s", "q"],
            )

    parts = _blocks(packed).mapInArrow(run, "site string, set int, label double, at int, n bigint, s double, q double")
    sums = parts.groupBy(*by, "label", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    held = sums.groupBy(*by, "label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("v"))
    return held.select(*by, "label", "n", F.col("v.s").alias("sums"), F.col("v.q").alias("squares"))


def without_folds(statistics: DataFrame, fold: str = "fold", by: Sequence[str] = ("site",)) -> DataFrame:
    """Statistics ``(by, set, label, n, sums, squares)`` of all rows (WHOLE) and of all but each fold."""
    total = statistics.groupBy(*by, "label").agg(
        F.sum("n").alias("n"), _added("sums").alias("sums"), _added("squares").alias("squares")
    )
    folds = statistics.select(*by, F.col(fold).alias("set")).distinct()
    own = statistics.select(*by, F.col(fold).alias("set"), "label", F.struct("n", "sums", "squares").alias("own"))
    less = lambda c: F.when(F.col("own").isNull(), F.col(c)).otherwise(F.zip_with(c, f"own.{c}", lambda a, b: a - b))
    rest = total.join(folds, list(by)).join(own, [*by, "set", "label"], "left")
    rest = rest.select(
        *by, "set", "label", (F.col("n") - F.coalesce("own.n", F.lit(0))).alias("n"), less("sums").alias("sums"),
        less("squares").alias("squares"),
    )
    return total.select(*by, F.lit(WHOLE).alias("set"), "label", "n", "sums", "squares").unionByName(rest.filter("n > 0"))


def _added(column: str) -> Column:
    """Sum of arrays, place by place: one array for each fold and class."""
    return F.aggregate(
        F.collect_list(column), F.lit(None).cast("array<double>"),
        lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y)),
    )


def naive_bayes(statistics: DataFrame, kind: str = "gaussian", smoothing: float = 1.0, by: Sequence[str] = ("site",)) -> DataFrame:
    """``(by, kind, priors, theta, sigma)`` with one entry per class, smaller label first.

    ``gaussian``: means and variances of each feature; ``multinomial``: logarithms of the features'
    shares, smoothed (``sigma`` is empty). Features of the latter must not be negative. A model needs
    both classes.
    """
    if kind not in ("gaussian", "multinomial"):
        raise ValueError(f"unknown kind of naive Bayes: {kind!r}")
    classes = F.array_sort(F.collect_list(F.struct("label", "n", "sums", "squares")))
    models = statistics.groupBy(*by).agg(classes.alias("c"), F.sum("n").cast("double").alias("total")).filter(F.size("c") == 2)
    if kind == "multinomial":
        prior = lambda c: F.log(c["n"] + smoothing) - F.log(F.col("total") + 2 * smoothing)
        whole = lambda c: F.aggregate(c["sums"], F.lit(0.0), lambda a, x: a + x) + smoothing * F.size(c["sums"])
        theta = lambda c: F.transform(c["sums"], lambda s: F.log(s + smoothing) - F.log(whole(c)))
        sigma = lambda c: F.array().cast("array<double>")
    else:
        prior = lambda c: F.log(c["n"] / F.col("total"))
        theta = lambda c: F.transform(c["sums"], lambda s: s / c["n"])
        both = lambda f: F.zip_with(F.get("c", F.lit(0))[f], F.get("c", F.lit(1))[f], lambda a, b: (a + b) / F.col("total"))
        models = models.withColumn("spread", F.array_max(F.zip_with(both("sums"), both("squares"), lambda m, q: q - m * m)))
        # A hair of variance, so that a constant feature does not divide by zero.
        variance = lambda c: lambda s, q: 1e-9 * F.col("spread") + q / c["n"] - (s / c["n"]) * (s / c["n"])
        sigma = lambda c: F.zip_with(c["sums"], c["squares"], variance(c))
    each = lambda f, name: F.transform("c", f).alias(name)
    return models.select(*by, F.lit(kind).alias("kind"), each(prior, "priors"), each(theta, "theta"), each(sigma, "sigma"))


# --- models as rows --------------------------------------------------------------

NODE = "struct<feature: int, threshold: double, left: int, right: int, value: double>"
MODEL = (
    "site string, algorithm string, kind string, intercept double, coefficients array<double>, priors array<double>, "
    f"theta array<array<double>>, sigma array<array<double>>, trees array<array<{NODE}>>, weights array<double>, depth int, threshold double"
)


def model_rows(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a table of models; those it lacks are null."""
    schema = df.sparkSession.createDataFrame([], MODEL).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def fitted_row(model, site: str, algorithm: str) -> DataFrame:
    """The row of a model that MLlib fitted: coefficients, or the nodes of its trees."""
    spark = SparkSession.active()
    named = lambda df: model_rows(df.withColumns({"site": F.lit(site), "algorithm": F.lit(algorithm)}))
    if isinstance(model, LogisticRegressionModel | LinearSVCModel):
        kind = "linear" if isinstance(model, LogisticRegressionModel) else "margin"
        threshold = float(model.getThreshold()) if kind == "linear" else None
        row = [(kind, float(model.intercept), [float(c) for c in model.coefficients.toArray()], threshold)]
        return named(spark.createDataFrame(row, "kind string, intercept double, coefficients array<double>, threshold double"))
    kinds = {DecisionTreeClassificationModel: "tree", RandomForestClassificationModel: "forest", GBTClassificationModel: "boosted"}
    kind = kinds[type(model)]
    path = f"{shared_dir(spark)}/models/{model.uid}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if kind == "tree":
        nodes, weights, depth = nodes.select(F.lit(0).alias("tree"), F.struct("*").alias("n")), [1.0], model.depth
    else:
        nodes = nodes.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
        weights, depth = [float(w) for w in model.treeWeights], max(t.depth for t in model.trees)
    # A leaf of a boosted tree predicts; of the others it holds the weights of both classes.
    value = F.col("n.prediction") if kind == "boosted" else F.get("n.impurityStats", F.lit(1)) / (
        F.get("n.impurityStats", F.lit(0)) + F.get("n.impurityStats", F.lit(1))
    )
    node = F.struct(
        F.col("n.id").alias("id"), F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), value.alias("value"),
    )
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("t"))
    plain = F.transform("t", lambda n: n.dropFields("id"))
    row = trees.select("tree", plain.alias("t")).agg(F.array_sort(F.collect_list(F.struct("tree", "t"))).alias("f"))
    return named(row.select(
        F.lit(kind).alias("kind"), F.col("f.t").alias("trees"),
        F.array(*[F.lit(w) for w in weights]).alias("weights"), F.lit(depth).alias("depth"),
    ))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """A matrix by a vector, in this thread alone."""
    return np.einsum("ij,j->i", x, coefficients)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -margin))


def _leaves(tree: dict[str, np.ndarray], features: np.ndarray, depth: int) -> np.ndarray:
    """Values of the leaves that the rows of ``features`` reach, all rows one step down per level."""
    at = np.zeros(len(features), np.int64)
    rows = np.arange(len(features))
    for _ in range(depth):
        inner = tree["left"][at] >= 0
        column = np.where(inner, tree["feature"][at], 0)
        goes_left = features[rows, column] <= tree["threshold"][at]
        at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)
    return tree["value"][at]


#: Most leaves of a tree whose leaves are told by the bits of a word.
BITS = 64
#: Rows whose words for all trees stay in a processor's cache.
ROWS_AT_ONCE = 256
#: Most rows of a table that tells what the values of several features rule out.
JOINED = 512
#: Fewest trees that are faster followed all at once than one by one.
MANY_TREES = 8


class _Forest:
    """Trees of at most 64 leaves, all followed at once.

    Leaves are numbered from the left. A node whose test fails rules the leaves of its left branch out; the leaf
    that a row reaches is the first that no failed test rules out. What a feature's value rules out in all
    trees depends only on the thresholds below it, so it is one row of a table; small tables are joined, a
    row for each combination.
    """

    def __init__(self, trees: list[dict[str, np.ndarray]]):
        tests: dict[int, list[tuple[float, int, int]]] = {}  # feature -> threshold, tree, leaves that stay
        most = max((tree["left"] < 0).sum() for tree in trees)
        self.word, whole = (np.uint32, 2**32 - 1) if most <= 32 else (np.uint64, 2**64 - 1)
        self.values = np.zeros((len(trees), BITS))
        for n, tree in enumerate(trees):
            leaves = 0

            def walk(at: int, n: int = n, tree: dict = tree) -> None:
                nonlocal leaves
                if tree["left"][at] < 0:
                    self.values[n, leaves] = tree["value"][at]
                    leaves += 1
                    return
                before = leaves
                walk(int(tree["left"][at]))
                ruled_out = (1 << leaves) - (1 << before)
                tests.setdefault(int(tree["feature"][at]), []).append((float(tree["threshold"][at]), n, ~ruled_out & whole))
                walk(int(tree["right"][at]))

            walk(0)
        single = []
        for feature, of_feature in sorted(tests.items()):
            of_feature.sort()
            edges = np.unique([t for t, _, _ in of_feature])
            table = np.full((len(edges) + 1, len(trees)), whole, self.word)
            for threshold, n, stay in of_feature:
                table[np.searchsorted(edges, threshold) + 1 :, n] &= self.word(stay)
            single.append(([(feature, edges)], table))
        self.tables = []
        for features, table in sorted(single, key=lambda t: len(t[1])):
            last = self.tables[-1] if self.tables else None
            if last and len(last[1]) * len(table) <= JOINED:
                joined = (last[1][:, None, :] & table[None, :, :]).reshape(-1, len(trees))
                self.tables[-1] = (last[0] + features, joined)
            else:
                self.tables.append((features, table))
        self.starts = np.arange(len(trees), dtype=np.int64) * BITS

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each tree the values of the leaves that the rows of ``x`` reach."""
        reached = np.empty((len(x), len(self.values)))
        one, flat = self.word(1), self.values.ravel()
        where = []
        for features, table in self.tables:
            at = np.zeros(len(x), np.int64)
            for feature, edges in features:
                # A value fails the tests whose threshold is below it; one that is no number fails all.
                at = at * (len(edges) + 1) + np.searchsorted(edges, x[:, feature], side="left")
            where.append((at, table))
        for start in range(0, len(x), ROWS_AT_ONCE):
            stop = min(len(x), start + ROWS_AT_ONCE)
            stay = np.full((stop - start, len(self.values)), ~self.word(0), self.word)
            for at, table in where:
                stay &= np.take(table, at[start:stop], axis=0)
            place = np.bitwise_count(~stay & (stay - one))  # zeros before the first one
            np.take(flat, place + self.starts, out=reached[start:stop], mode="clip")
        return reached.T


class _Scorer:
    """A row of MODEL as arrays."""

    def __init__(self, row):
        self.algorithm, self.kind, self.depth = row.algorithm, row.kind, row.depth
        self.threshold = 0.5 if row.threshold is None else row.threshold
        if row.kind in ("linear", "margin"):
            self.intercept, self.coefficients = row.intercept, np.array(row.coefficients)
        elif row.kind in ("gaussian", "multinomial"):
            self.priors, self.theta, self.sigma = (np.array(x) for x in (row.priors, row.theta, row.sigma))
        else:
            kinds = {"feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
            self.trees = [{k: np.array([0 if n[k] is None else n[k] for n in t], v) for k, v in kinds.items()} for t in row.trees]
            self.weights = row.weights
            fit = len(self.trees) >= MANY_TREES and all((t["left"] < 0).sum() <= BITS for t in self.trees)
            self.forest = _Forest(self.trees) if fit else None

    def positive(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; for a linear SVM, which has none, the logistic function of its margin."""
        if self.kind in ("linear", "margin"):
            return _logistic(_times(x, self.coefficients) + self.intercept)
        if self.kind == "multinomial":
            of_class = x @ self.theta.T + self.priors
        elif self.kind == "gaussian":
            of_class = np.stack(
                [p - 0.5 * (np.log(v) + (x - m) ** 2 / v).sum(axis=1) for p, m, v in zip(self.priors, self.theta, self.sigma, strict=True)], 1
            )
        else:
            leaves = self.forest.leaves(x) if self.forest else np.stack([_leaves(t, x, self.depth) for t in self.trees])
            votes = _times(leaves.T, np.asarray(self.weights))
            return _logistic(2 * votes) if self.kind == "boosted" else votes / sum(self.weights)
        return _logistic(of_class[:, 1] - of_class[:, 0])


def _scorers(models: DataFrame, features: DataFrame, featureset: Featureset, policy: str) -> dict[str, tuple[_Features, list[_Scorer]]]:
    """By site the features of its whole training rows and its models."""
    of_site: dict[str, list[_Scorer]] = {}
    for row in models.collect():
        of_site.setdefault(row.site, []).append(_Scorer(row))
    fitted = features.filter((F.col("set") == WHOLE) & F.col("site").isin(list(of_site))).collect()
    found = {row.site: _Features(row, featureset, policy) for row in fitted}
    return {site: (found[site], of_site[site]) for site in sorted(s for s in of_site if s in found)}


def _scored(
    of_site: Mapping[str, tuple[_Features, list[_Scorer]]], featureset: Featureset, own: bool, site: int, first: int, batch: pa.RecordBatch
) -> Iterator[tuple[str, np.ndarray, _Scorer, np.ndarray]]:
    """Site of a model, the rows of a batch that it scores, the model, and their probabilities of class 1.

    The column ``site`` holds the rows' own sites, those from ``first`` on hold :func:`feature_inputs`.
    """
    inputs = _Inputs(batch.columns[first:], featureset)
    every = np.arange(batch.num_rows)
    if own:
        coded = batch.column(site).dictionary_encode()
        codes, names = coded.indices.fill_null(len(coded.dictionary)).to_numpy(), coded.dictionary.to_pylist()
        rows_of = {names[code]: rows for code, rows in _groups(codes) if code < len(names)}
    for model_site, (features, models) in of_site.items():
        rows = rows_of.get(model_site, every[:0]) if own else every
        if len(rows):
            x, usable = features.vectors(inputs, rows)
            if usable is not None:
                x, rows = x[usable], rows[usable]
            for model in models if len(rows) else ():
                yield model_site, rows, model, model.positive(x)


def predict(
    rows: DataFrame, features: DataFrame, models: DataFrame, featureset: Featureset, policy: str = "keep", own: bool = False, keep: Sequence[str] | None = None
) -> DataFrame:
    """Every row scored by every model: ``rows``, model_site, algorithm, prediction, negative, positive.

    As MLlib predicts: class 1 above a probability of one half, or the model's threshold. ``features``
    are :func:`fit_features` of the sites' whole training rows; each row gets the features of every site
    once, whatever the number of that site's models; with ``own``, of its own site only. All models are one plan without a shuffle: they
    and what is fitted of the features are handed to the tasks, a row for each site and algorithm, and score a batch of records at a time.
    ``keep`` names the columns of ``rows`` that are wanted (default: all); they may have any names but those added.
    """
    of_site = _scorers(models, features, featureset, policy)
    kept = rows.select(*[F.col(f"`{c}`") for c in (rows.columns if keep is None else keep)])
    width = len(kept.columns)
    inputs = [c.alias(f"_f{i}") for i, c in enumerate(feature_inputs(featureset))]
    read = rows.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("site").alias("_site"), *inputs)
    made = "model_site string, algorithm string, prediction double, negative double, positive double"
    whole = StructType([*kept.schema.fields, *StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model_site, where, model, positive in _scored(of_site, featureset, own, width, width + 1, batch):
                part = batch.columns[:width]
                if len(where) < batch.num_rows:
                    part = [c.take(pa.array(where)) for c in part]
                n = len(where)
                added = [pa.array([v] * n, pa.string()) for v in (model_site, model.algorithm)]
                classes = pa.array((positive > model.threshold).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part, *added, classes, pa.array(1 - positive), pa.array(positive)], names=whole.names)

    return read.mapInArrow(run, whole)


def outcomes(rows: DataFrame, features: DataFrame, models: DataFrame, featureset: Featureset, policy: str = "keep", own: bool = False) -> DataFrame:
    """``(site, model_site, algorithm, tp, tn, fp, fn)``: what becomes of :func:`predict` on labelled rows, counted in the tasks.

    Rows of one site and model are several, to be added up. As in a confusion matrix, labels other than 0 and 1 are in no count.
    """
    of_site = _scorers(models, features, featureset, policy)
    inputs = [c.alias(f"_f{i}") for i, c in enumerate(feature_inputs(featureset))]
    read = rows.select("site", F.col("label").cast("double"), *inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            sites = [*coded.dictionary.to_pylist(), None]
            codes = coded.indices.fill_null(len(sites) - 1).to_numpy()
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            place = np.where(labels == 1, 0, np.where(labels == 0, 2, 4)) + codes.astype(np.int64) * 6
            present = np.bincount(codes, minlength=len(sites))
            for model_site, where, model, positive in _scored(of_site, featureset, own, 0, 2, batch):
                found = np.bincount(place[where] + (positive <= model.threshold), minlength=len(sites) * 6).reshape(-1, 6)
                for code in np.flatnonzero(found.sum(axis=1) if len(where) < batch.num_rows else present):
                    name = (sites[code], model_site, model.algorithm)
                    totals[name] = totals.get(name, 0) + found[code]
        if totals:
            names, counts = [*zip(*totals)], np.stack([*totals.values()])
            # At 0 and 1 the label is 1 and the prediction 1 or 0, at 2 and 3 the label is 0.
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in names], *[pa.array(counts[:, i]) for i in (0, 3, 2, 1)]],
                names=["site", "model_site", "algorithm", "tp", "tn", "fp", "fn"],
            )

    return read.mapInArrow(run, "site string, model_site string, algorithm string, tp bigint, tn bigint, fp bigint, fn bigint")
