"""Filling missing values by predictive mean matching.

1. Fit: per measure and vessel class a ridge regression of the logarithm on other sources, other measures and the year,
   shrunk towards the fit of all classes. The sums it needs are gathered per partition, so only a few rows per class are
   shuffled. What a class is filled by is the size of the vessel: the mean of its observed or predicted logarithms.
2. Donors: a gap takes the narrowest group that has donors (the vessel itself, its class, everyone). Donors and gaps are
   range-partitioned by group and prediction; a hot group therefore spans many partitions. Each partition also gets the
   outermost donors of the others, so the nearest donors are found exactly.
3. Draw: of the `draws` donors with the nearest predictions (within a vessel: the nearest one) a hash of the row id picks
   one, whose observed value is copied along with its id. Among donors at equal distance the choice is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidelog.functions.values import BOUNDS, VALUE_RULES, clean_text, measure, plain_text, vessel_of
from tidelog.session import broadcast_if_small, cut

MEASURES = ["length_m", "engine_power_kw", "tonnage_gt"]
FIELDS = [f"{m}_gfw" for m in MEASURES] + ["vessel_class_gfw"]
#: What a prediction may rest on, best first: positions among the logarithms of [own, first other, second other measure].
PATTERNS = [(0,), (1, 2), (1,), (2,), ()]
#: Terms of a regression: one, at most two logarithms, and the year in decades from 2018 (0 if there is none).
WIDTH = 4
SHRINK = 30.0
EVERYONE = "*"
#: Classes whose coefficients travel with the tasks (480 bytes each); those of more are joined.
SHIPPED_KINDS = 20_000


def _log(name: str, *sources: str) -> Column:
    return F.log(F.coalesce(*(measure(F.col(f"{name}_{s}").cast("double"), *BOUNDS[name]) for s in sources)))


def _observed(field: str) -> Column:
    """The value that is copied: text without blanks at its ends, a number as it is; null if it is missing."""
    return clean_text(F.col(field)) if field == "vessel_class_gfw" else VALUE_RULES[field](F.col(field))


def _narrow(df: DataFrame, row_id: str) -> DataFrame:
    """id, vessel, kind (class by any source), t, and lists over the measures: y (logarithm of the observed value), own (by other sources), other (by any source); and over the fields: values (text). Nulls are gaps."""
    kind = F.coalesce(plain_text(F.col("vessel_class_registry")), plain_text(F.col("vessel_class_inferred")), plain_text(F.col("vessel_class_gfw")), F.lit("?"))
    lists = {"y": [_log(m, "gfw") for m in MEASURES], "own": [_log(m, "registry", "inferred") for m in MEASURES], "other": [_log(m, "registry", "gfw", "inferred") for m in MEASURES]}
    t = F.coalesce((F.col("year").cast("double") - 2018.0) / 10.0, F.lit(0.0))
    return df.select(F.col(row_id).alias("id"), vessel_of(F.col("mmsi")).alias("vessel"), kind.alias("kind"), F.greatest(F.least(t, F.lit(10.0)), F.lit(-10.0)).alias("t"), *(F.array(*c).alias(n) for n, c in lists.items()), F.array(*(_observed(f).cast("string") for f in FIELDS)).alias("values"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _terms(b: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For the measure m: the logarithms [own, first other, second other] of each row, and the year."""
    own, other = _matrix(b.column("own")), _matrix(b.column("other"))
    return np.column_stack([own[:, m], *(other[:, o] for o in range(len(MEASURES)) if o != m)]), b.column("t").to_numpy(zero_copy_only=False)


def _design(x: np.ndarray, t: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), x[:, at], np.zeros((len(t), WIDTH - 2 - len(at))), t])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the sums of X'X and X'y of every measure and pattern, over the rows that have what the pattern needs; one vector per class and partition."""
    total: dict[str, np.ndarray] = {}
    size = (WIDTH + 1) ** 2
    for b in batches:
        if not b.num_rows:
            continue
        y = _matrix(b.column("y"))
        groups = {k: v for k, v in pd.Series(range(b.num_rows)).groupby(np.array(b.column("kind").to_pylist(), object)).indices.items()}
        for m in range(len(MEASURES)):
            x, t = _terms(b, m)
            for p, at in enumerate(PATTERNS):
                z = np.column_stack([_design(x, t, at), y[:, m]])
                good = ~np.isnan(z).any(axis=1)
                for kind, rows in groups.items():
                    own = z[rows][good[rows]]
                    into = total.setdefault(kind, np.zeros((len(MEASURES), len(PATTERNS), size)))
                    into[m, p] += (own.T @ own).ravel()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=["kind", "sums"])


def _add(df: DataFrame, *keys: str) -> DataFrame:
    each = df.select(*keys, F.posexplode("sums").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("sums"))


def _solved(s: np.ndarray, mean: np.ndarray | float = 0.0, beta: np.ndarray | float = 0.0) -> np.ndarray:
    """Coefficients by measure and pattern, of sums of the same shape, shrunk by `mean` rows' worth of X'X towards beta."""
    z = s.reshape(len(MEASURES), len(PATTERNS), WIDTH + 1, WIDTH + 1)
    a, b = z[..., :WIDTH, :WIDTH] + mean + 1e-6 * np.eye(WIDTH), z[..., :WIDTH, WIDTH:]
    return np.linalg.solve(a, b + (mean @ beta[..., None] if isinstance(mean, np.ndarray) else 0.0))[..., 0]


def fit(narrow: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(kind, beta: coefficients by measure and pattern, in one list) per class, and those of all classes together."""
    sums = cut(_add(narrow.mapInArrow(_sums, "kind string, sums array<double>"), "kind"))
    whole = [r["sums"] for r in _add(sums.select("sums")).collect()]  # one row, whatever the input
    shape = (len(MEASURES), len(PATTERNS), WIDTH + 1, WIDTH + 1)
    z = np.array(whole[0]) if whole and whole[0] else np.zeros(shape)
    z = z.reshape(shape)
    beta = _solved(z)
    mean = SHRINK * z[..., :WIDTH, :WIDTH] / np.maximum(z[..., :1, :1], 1.0)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"kind": f["kind"], "beta": [_solved(np.array(s), mean, beta).ravel().tolist() for s in f["sums"]]})

    return cut(sums.mapInPandas(solve, "kind string, beta array<double>")), beta


def _candidates(df: DataFrame, row_id: str) -> DataFrame:
    """field (number), id, vessel, kind, pred, value (text; null: a gap). Predictions are rounded, so that the order of sums cannot change the choice of a donor."""
    narrow = cut(_narrow(df, row_id))
    betas, overall = fit(narrow)
    few = betas.limit(SHIPPED_KINDS + 1).collect()
    table = {r["kind"]: np.array(r["beta"]).reshape(overall.shape) for r in few} if len(few) <= SHIPPED_KINDS else None
    rows = narrow if table is not None else narrow.join(betas, "kind", "left")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if table is not None:
                names, code = np.unique(np.array(b.column("kind").to_pylist(), object).astype(str), return_inverse=True)
                beta = np.stack([table.get(k, overall) for k in names])[code]
            else:
                beta = np.stack([overall if x is None else np.array(x).reshape(overall.shape) for x in b.column("beta").to_pylist()])
            y = _matrix(b.column("y"))
            pred = np.zeros((n, len(MEASURES)))
            for m in range(len(MEASURES)):
                x, t = _terms(b, m)
                left = np.ones(n, bool)
                for p, at in enumerate(PATTERNS):
                    now = left & ~np.isnan(x[:, at]).any(axis=1)
                    pred[now, m] = (_design(x[now], t[now], at) * beta[now, m, p]).sum(axis=1)
                    left &= ~now
            of_class = np.where(np.isnan(y), pred, y).mean(axis=1)
            every = np.round(np.column_stack([pred, of_class]), 6) + 0.0
            same = np.repeat(np.arange(n), len(FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(FIELDS), dtype=np.int32), n)), *(b.column(c).take(pa.array(same)) for c in ("id", "vessel", "kind")), pa.array(every.ravel()), b.column("values").flatten()], names=["field", "id", "vessel", "kind", "pred", "value"])

    kind = narrow.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"field int, id {kind}, vessel string, kind string, pred double, value string")


def _matcher(draws: int, edges: list[tuple[int, str, float, int, str]]):
    """Finds the donors of one range partition; edges: the outermost donors of every partition (field, key, pred, id, value)."""
    outer: dict[tuple[int, str], list[tuple[float, int, str]]] = {}
    for field, key, *donor in edges:
        outer.setdefault((field, key), []).append(tuple(donor))
    shared: dict[int, set[str]] = {}
    for field, key in outer:
        shared.setdefault(field, set()).add(key)

    def group(field: int, key: str, f: pd.DataFrame) -> pd.DataFrame | None:
        gap = f["gap"].to_numpy()
        if not gap.any():
            return None
        own, more = f[~gap], outer.get((field, key), [])
        pred = np.concatenate([own["pred"].to_numpy(), [p for p, _, _ in more]])
        ids = np.concatenate([own["id"].to_numpy(np.int64), np.array([d for _, d, _ in more], np.int64)])
        values = np.concatenate([own["value"].to_numpy(object), np.array([v for _, _, v in more], object)])
        ids, at = np.unique(ids, return_index=True)
        pred, values = pred[at], values[at]
        order = np.lexsort((ids, pred))
        pred, ids, values = pred[order], ids[order], values[order]
        want, who = f["pred"].to_numpy()[gap], f["id"].to_numpy(np.int64)[gap]
        k = 1 if key.startswith("v:") else draws
        spot = np.searchsorted(pred, want)
        near = spot[:, None] + np.arange(-k, k)[None, :]
        valid = (near >= 0) & (near < len(pred))
        near = np.clip(near, 0, len(pred) - 1)
        far = np.where(valid, np.abs(pred[near] - want[:, None]), np.inf)
        nearest = np.lexsort((ids[near], far), axis=1)[:, :k]
        have = np.minimum(valid.sum(axis=1), k)
        mixed = (who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        pick = (mixed % have.astype(np.uint64)).astype(np.int64)
        chosen = np.take_along_axis(near, nearest, axis=1)[np.arange(len(want)), pick]
        return pd.DataFrame({"field": field, "id": who, "donor_id": ids[chosen], "donor_group": key, "predicted": want, "donor_predicted": pred[chosen], "value": values[chosen]})

    def vessels(f: pd.DataFrame) -> pd.DataFrame:
        """As group() for many whole vessel groups at once, in which the one nearest donor is taken: the last donor before a gap or the first after it."""
        field, key, pred, ids, gap, value = (f[c].to_numpy() for c in ("field", "key", "pred", "id", "gap", "value"))
        code = np.cumsum(np.concatenate([[0], (field[1:] != field[:-1]) | (key[1:] != key[:-1])]).astype(np.int64))
        at = np.arange(len(f))
        last = np.maximum.accumulate(np.where(gap, -1, at))
        next_ = np.minimum.accumulate(np.where(gap, len(f), at)[::-1])[::-1]
        donors = np.flatnonzero(~gap)
        if not len(donors):
            return f[:0][["field", "id"]]
        new = np.concatenate([[True], (pred[donors][1:] != pred[donors][:-1]) | (code[donors][1:] != code[donors][:-1])])
        smallest = np.full(len(f) + 1, -1)  # of the donors with one prediction, the one with the smallest id
        smallest[donors] = donors[np.maximum.accumulate(np.where(new, np.arange(len(donors)), 0))]
        g = np.flatnonzero(gap)
        low, high = last[g], next_[g]
        has_low, has_high = (low >= 0) & (code[low] == code[g]), (high < len(f)) & (code[np.minimum(high, len(f) - 1)] == code[g])
        low = np.where(has_low & (pred[low] == pred[g]), smallest[low], low)
        high = np.minimum(high, len(f) - 1)
        far_low, far_high = np.where(has_low, np.abs(pred[low] - pred[g]), np.inf), np.where(has_high, np.abs(pred[high] - pred[g]), np.inf)
        chosen = np.where((far_low < far_high) | ((far_low == far_high) & (ids[low] < ids[high])), low, high)
        return pd.DataFrame({"field": field[g], "id": ids[g], "donor_id": ids[chosen], "donor_group": key[g], "predicted": pred[g], "donor_predicted": pred[chosen], "value": value[chosen]})[has_low | has_high]

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:  # sorted by field, key: only the last group of a batch can go on
            if not len(f):
                continue
            held.append(f)
            last = (f["field"].iat[-1], f["key"].iat[-1])
            if (f["field"].iat[0], f["key"].iat[0]) == last:
                continue
            f = pd.concat(held, ignore_index=True)
            open_ = ((f["field"] == last[0]) & (f["key"] == last[1])).to_numpy()
            held, f = [f[open_]], f[~open_]
            many = f["key"].str.startswith("v:")
            for field, keys in shared.items():  # groups that other partitions may hold too
                many &= (f["field"] != field) | ~f["key"].isin(keys)
            if many.any():
                yield vessels(f[many])
            for (field, key), g in f[~many].groupby(["field", "key"], sort=False):
                if (r := group(field, key, g)) is not None:
                    yield r
        if held:
            for (field, key), g in pd.concat(held, ignore_index=True).groupby(["field", "key"], sort=False):  # batches of one group each may hold several
                if (r := group(field, key, g)) is not None:
                    yield r

    return match


def _edges(draws: int):
    """The outermost donors of a partition's first and last group, the only ones that other partitions can hold too: at most four times `draws` rows, whatever its size."""

    def outermost(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[list] = []  # [group, head, tail] of the first and of the latest group
        for f in frames:
            f = f[~f["gap"]]
            if not len(f):
                continue
            field, key = f["field"].to_numpy(), f["key"].to_numpy(object)
            new = np.flatnonzero((field[1:] != field[:-1]) | (key[1:] != key[:-1])) + 1
            for g in (f,) if not len(new) else (f[: new[0]], f[new[-1] :]):  # groups between them end where they begin
                group = (g["field"].iat[0], g["key"].iat[0])
                if ends and ends[-1][0] == group:
                    if len(ends[-1][1]) < draws:
                        ends[-1][1] = pd.concat([ends[-1][1], g])[:draws]
                    ends[-1][2] = pd.concat([ends[-1][2], g[-draws:]])[-draws:]
                else:
                    ends[1:] = [[group, g[:draws], g[-draws:]]]
        if ends:
            yield pd.concat([x for _, head, tail in ends for x in (head, tail)])[["field", "key", "pred", "id", "value"]].drop_duplicates()

    return outermost


def fill_missing(df: DataFrame, row_id: str = "vessel_row_id", draws: int = 5, fewest: int = 5, rows_per_task: int = 250_000) -> DataFrame:
    """A row per gap: id, field, donor_id, donor_group, predicted, donor_predicted, value (the donor's, as text).

    row_id must be a unique whole number. A group other than the vessel needs `fewest` donors. A gap without any donor
    in the whole table comes out with null donor_id and value. Rows of no vessel start at their class. Empty in, empty out;
    columns of df that are not read do not matter, whatever they are called. What comes to the driver: a count of donors
    per field, at most SHIPPED_KINDS rows of coefficients, and at most 4 * draws donors per task."""
    c = cut(_candidates(df, row_id))
    has = F.col("value").isNotNull()
    own = c.where(F.col("vessel").isNotNull()).groupBy("field", "vessel").agg(F.count_if(has).alias("d"), F.count_if(~has).alias("g")).where("d > 0 AND g > 0").select("field", "vessel", F.lit(True).alias("own"))
    first = cut(c.join(own, ["field", "vessel"], "left").where(F.col("own") | ~has))  # vessels that fill their own gaps, and all other gaps
    kinds = cut(c.where(has).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n")))
    filled = [r["field"] for r in kinds.select("field").distinct().collect()]  # at most four
    enough = broadcast_if_small(kinds.where(F.col("n") >= fewest).select("field", "kind", F.concat(F.lit("k:"), "kind").alias("class_key")), 50_000)
    columns = ["field", "key", "pred", "id", "gap", "value"]
    vessels = first.where("own").withColumns({"key": F.concat(F.lit("v:"), "vessel"), "gap": ~has}).select(*columns)
    wide = first.where(F.col("own").isNull() & F.col("field").isin(filled)).join(enough, ["field", "kind"], "left").withColumns({"key": F.coalesce("class_key", F.lit(EVERYONE)), "gap": F.lit(True)}).select(*columns)
    used = broadcast_if_small(cut(wide.select("field", "key").distinct()), 50_000)
    donors = c.where(has).withColumns({"gap": F.lit(False), "key": F.explode(F.array(F.concat(F.lit("k:"), "kind"), F.lit(EVERYONE)))}).join(used, ["field", "key"], "left_semi").select(*columns)
    both = cut(vessels.unionByName(wide).unionByName(donors))
    n = both.count()
    tasks = max(min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 5_000 + 1), n // rows_per_task + 1)
    ordered = cut(both.repartitionByRange(tasks, "field", "key", "pred", "id").sortWithinPartitions("field", "key", "pred", "id"))
    edges = [tuple(r) for r in ordered.mapInPandas(_edges(draws), "field int, key string, pred double, id long, value string").collect()]  # at most 4 * draws rows a task
    schema = "field int, id long, donor_id long, donor_group string, predicted double, donor_predicted double, value string"
    matched = ordered.mapInPandas(_matcher(draws, edges), schema)
    none = first.where(F.col("own").isNull() & ~F.col("field").isin(filled)).select("field", "id", *(F.lit(None).cast(t).alias(n) for n, t in (("donor_id", "long"), ("donor_group", "string"), ("predicted", "double"), ("donor_predicted", "double"), ("value", "string"))))
    name = F.get(F.array(*map(F.lit, FIELDS)), F.col("field"))
    return matched.unionByName(none).withColumn("field", name).withColumnRenamed("id", row_id)


def with_fills(df: DataFrame, fills: DataFrame, row_id: str = "vessel_row_id") -> DataFrame:
    """df with its four fields filled, and for each <field>_filled (boolean) and <field>_donor (row id).

    Values come from the donors' own fields: text without blanks at its ends, numbers as they are."""
    wide = fills.groupBy(row_id).agg(*(F.max(F.when(F.col("field") == f, F.col(c))).alias(f"_{n}_{f}") for f in FIELDS for n, c in (("v", "value"), ("d", "donor_id"))))
    out = df.join(wide, row_id, "left")
    for f in FIELDS:
        kept = _observed(f)
        out = out.withColumns({f: F.coalesce(kept, F.col(f"_v_{f}").cast(df.schema[f].dataType)), f"{f}_filled": kept.isNull() & F.col(f"_d_{f}").isNotNull(), f"{f}_donor": F.col(f"_d_{f}")})
    return out.drop(*(f"_{p}_{f}" for p in "vd" for f in FIELDS))


def checked_fills(df: DataFrame, fills: DataFrame, row_id: str = "vessel_row_id") -> DataFrame:
    """Each fill with what holds of its donor: observed (its value is not missing), copied (the fill is that value), in_group (it belongs to the stated group)."""
    kind = _narrow(df, row_id).select(F.col("id").alias("donor_id"), "vessel", "kind", F.explode(F.arrays_zip(F.array(*map(F.lit, FIELDS)).alias("field"), F.col("values").alias("donor_value"))).alias("o")).select("donor_id", "vessel", "kind", "o.*")
    both = fills.join(kind, ["donor_id", "field"], "left")
    group = F.array(F.lit(EVERYONE), F.concat(F.lit("k:"), "kind"), F.concat(F.lit("v:"), "vessel"))
    sure = lambda x: F.coalesce(x, F.lit(False))
    return both.select(row_id, "field", F.col("donor_value").isNotNull().alias("observed"), sure(F.col("donor_value") == F.col("value")).alias("copied"), sure(F.array_contains(F.array_compact(group), F.col("donor_group"))).alias("in_group"))
