"""Implicit-feedback alternating least squares with exact solves, and the content fold-in for vessels without history.

Observed pairs have confidence 1 + alpha * log(1 + hours), all others confidence 1 and preference 0; the regularisation is
the same for every entity. Pairs are grouped once per side, an entity's pairs in chunks of at most CHUNK, so a hot entity
never sits in one task: each chunk gives its part of the normal equations. Where the shared folder is mounted, the factors of
a side are one file there: tasks write their rows to it and map it to read the opposite side's, up to MAPPED bytes. Else the
factors of the opposite side travel by broadcast while they are small (SHIPPED bytes) and are joined to the pairs beyond that.
"""

from __future__ import annotations

import copy
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tidelog.session import broadcast_if_small, cut, mounted_dir, numbered

CHUNK = 50_000
SHIPPED = 64 << 20
MAPPED = 8 << 30
#: Entities that are solved at once; users and items whose products are made at once; keys of a broadcast at most.
RUN, WHO, TILE, MOST_KEYS = 128, 1024, 2048, 500_000
#: Trials of a grid that run at the same time.
AT_ONCE = 2


def indexed(keys: DataFrame, key: str) -> DataFrame:
    """The distinct keys with ix, their number from 0 in sorted order."""
    return numbered(keys.where(F.col(key).isNotNull()).select(key).distinct(), F.col(key)).withColumn("ix", F.col("ix").cast("int"))


def drawn(ix: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """First factors of the entities: normal with deviation 0.01, each number from its own counter (hashed, Box and Muller), so they do not depend on the size of the table or on where a row is."""
    counter = (np.asarray(ix, np.uint64)[:, None] * np.uint64(rank) + np.arange(rank, dtype=np.uint64)) * np.uint64(2) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)

    def uniform(x: np.ndarray) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53

    return 0.01 * np.sqrt(-2.0 * np.log1p(-uniform(counter))) * np.cos(2.0 * np.pi * uniform(counter + np.uint64(1)))


def confidence(pairs: DataFrame, alpha: float) -> DataFrame:
    return pairs.withColumn("confidence", 1.0 + alpha * F.log1p(F.greatest("hours", F.lit(0.0))))


def _tasks(spark: SparkSession, rows: int = 0, most: int = 500_000) -> int:
    """Tasks for so many rows, of which one takes at most `most`; each half step pays for them again, so few but two a core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // most))


def _grouped(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """ix, chunk, chunks, others and confidences of each entity's pairs, in chunks, in the order of ix."""
    size = pairs.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(size, own).select(F.col(own).alias("ix"), F.pmod(F.xxhash64(other), F.col("chunks")).cast("int").alias("chunk"), "chunks", F.col(other).alias("o"), F.col("confidence").alias("c"))
    spread = dealt.repartitionByRange(_tasks(pairs.sparkSession, pairs.count()), "ix", "chunk")
    return cut(spread.groupBy("ix", "chunk", "chunks").agg(F.sort_array(F.collect_list(F.struct("o", "c"))).alias("p")).select("ix", "chunk", "chunks", "p.o", "p.c").sortWithinPartitions("ix", "chunk"))


def _normal(factors: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return factors.T @ (factors * d[:, None]), factors.T @ (1.0 + d)


def _solved(table: np.ndarray, o: np.ndarray, d: np.ndarray, sizes: np.ndarray, gram: np.ndarray, regularization: float) -> np.ndarray:
    """The factors of entities of so many pairs each, one after the other: with the rows o of the table, at confidence 1 + d.

    An entity of few pairs is solved by a system of as many unknowns as it has pairs (the matrix inversion lemma), in the
    space in which gram and regularisation are the unit matrix: exact as well, and cheaper than one of the rank."""
    rank, ends = len(gram), np.cumsum(sizes)
    base, starts, out = gram + regularization * np.eye(rank), ends - sizes, np.empty((len(sizes), rank))
    try:
        white = np.linalg.inv(np.linalg.cholesky(base))
        few = sizes * 3 < rank * 2
    except np.linalg.LinAlgError:  # no regularisation and too few factors
        white, few = None, np.zeros(len(sizes), bool)
    order = np.flatnonzero(few)
    order = order[np.argsort(sizes[order], kind="stable")]
    for at in range(0, len(order), RUN):
        e = order[at : at + RUN]
        w = int(sizes[e[-1]])
        there = np.arange(w) < sizes[e][:, None]
        p = np.where(there, starts[e][:, None] + np.arange(w), starts[e][:, None])
        more = np.where(there, d[p], 0.0)
        y = (table[o[p.ravel()]] @ white.T).reshape(len(e), w, rank) * there[:, :, None]
        a = (y @ y.transpose(0, 2, 1)) * more[:, :, None] + np.eye(w)
        z = np.linalg.solve(a, (there + more)[:, :, None])
        out[e] = (y.transpose(0, 2, 1) @ z)[:, :, 0] @ white
    for e in np.flatnonzero(~few):
        a, b = _normal(table[o[starts[e] : ends[e]]], d[starts[e] : ends[e]])
        out[e] = np.linalg.solve(a + base, b)
    return out


def _matrix(f: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix, without Python objects for its numbers."""
    return f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), -1) if len(f) else np.zeros((0, 0))


def _half_step(grouped: DataFrame, factors: DataFrame, rank: int, regularization: float, n: int, alpha: float = 1.0) -> DataFrame:
    """The factors (ix, f) of one side, given the other side's. Entities of one chunk are solved where they are read, those of more from the sums of their chunks. alpha multiplies what the confidences have above 1."""
    gram = np.zeros((rank, rank))
    for r in factors.mapInPandas(_grams(rank), "g array<double>").collect():  # one row a partition
        gram += np.array(r["g"]).reshape(rank, rank)
    shipped = None
    if n * rank * 8 <= SHIPPED:
        table = np.zeros((n, rank))
        for b in factors.select("ix", "f").toArrow().to_batches():  # at most SHIPPED bytes
            table[b.column(0).to_numpy()] = _matrix(b.column(1))
        shipped = grouped.sparkSession.sparkContext.broadcast(table)

    def source(part: DataFrame) -> DataFrame:
        if shipped is not None:
            return part
        flat = part.select("ix", "chunk", F.explode(F.arrays_zip("o", "c")).alias("p")).select("ix", "chunk", "p.*")
        return flat.join(factors.withColumnRenamed("ix", "o"), "o").groupBy("ix", "chunk").agg(F.collect_list("c").alias("c"), F.collect_list("f").alias("f"))

    def read(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, sizes = alpha * (np.concatenate(frame["c"].to_numpy()).astype(float) - 1.0), np.array([len(c) for c in frame["c"]])
        if shipped is not None:
            return shipped.value, np.concatenate(frame["o"].to_numpy()), d, sizes
        return np.stack([f for row in frame["f"] for f in row]), np.arange(len(d)), d, sizes

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"ix": frame["ix"], "f": _solved(*read(frame), gram, regularization).tolist()})

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                table, o, d, sizes = read(frame)
                parts = [_normal(table[o[e - n : e]], d[e - n : e]) for n, e in zip(sizes, np.cumsum(sizes), strict=True)]
                yield pd.DataFrame({"ix": frame["ix"], "a": [a.ravel().tolist() for a, _ in parts], "b": [b.tolist() for _, b in parts]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sum(np.stack(frame["a"]), axis=0).reshape(rank, rank), np.sum(np.stack(frame["b"]), axis=0)
        return pd.DataFrame({"ix": frame["ix"][:1], "f": [np.linalg.solve(a + gram + regularization * np.eye(rank), b).tolist()]})

    one = source(grouped.where(F.col("chunks") == 1)).mapInPandas(whole, "ix int, f array<double>")
    more = source(grouped.where(F.col("chunks") > 1)).mapInPandas(sums, "ix int, a array<double>, b array<double>").groupBy("ix").applyInPandas(add, "ix int, f array<double>")
    out = cut(one.unionByName(more))
    if shipped is not None:
        shipped.destroy()  # out is written, so nothing asks for it again
    return out


def _open(path: str, rank: int) -> np.ndarray:
    return np.asarray(np.memmap(path, np.float64, "r").reshape(-1, rank))


def _new(folder: str, n: int, rank: int) -> str:
    """A file for n rows of factors."""
    at, path = tempfile.mkstemp(dir=folder)
    os.truncate(at, n * rank * 8)
    os.close(at)
    return path


def _put(path: str, ix: np.ndarray, rows: np.ndarray) -> None:
    """Write rows at the numbers ix; a task that runs again writes the same."""
    with open(path, "r+b") as f:
        cuts = np.flatnonzero(np.diff(ix) != 1) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ix)], strict=True):
            f.seek(int(ix[lo]) * rows.shape[1] * 8)
            f.write(np.ascontiguousarray(rows[lo:hi]).tobytes())


def _mapped_step(grouped: DataFrame, table: str, out: str, gram: np.ndarray, regularization: float, alpha: float) -> np.ndarray:
    """_half_step from the factors in one file to those in another. Returns their Gram matrix.

    A row a task comes back, and one a chunk of the entities that have more than one (CHUNK pairs each): these are solved here."""
    rank = len(gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, g, ix, parts = _open(table, rank), np.zeros((rank, rank)), [-1], []
        for batch in batches:
            if not len(batch):
                continue
            own, chunks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes, o, d = pa.compute.list_value_length(batch.column(2)).to_numpy(), batch.column(2).flatten().to_numpy(), alpha * (batch.column(3).flatten().to_numpy() - 1.0)
            one, ends = chunks == 1, np.cumsum(sizes)
            kept = np.repeat(one, sizes)
            if one.any():
                x = _solved(y, o[kept], d[kept], sizes[one], gram, regularization)
                _put(out, own[one], x)
                g += x.T @ x
            for e in np.flatnonzero(~one):
                p = slice(ends[e] - sizes[e], ends[e])
                ix.append(int(own[e]))
                parts.append(np.column_stack(_normal(y[o[p]], d[p])).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ix, pa.int32()), pa.array([g.tobytes(), *parts], pa.binary())], ["ix", "a"])

    total, hot = np.zeros((rank, rank)), {}
    for r in grouped.select("ix", "chunks", "o", "c").mapInArrow(run, "ix int, a binary").collect():
        a = np.frombuffer(r["a"]).reshape(rank, -1)
        if r["ix"] < 0:
            total += a
        else:
            hot[r["ix"]] = hot.get(r["ix"], 0.0) + a
    for ix in sorted(hot):
        x = np.linalg.solve(hot[ix][:, :rank] + gram + regularization * np.eye(rank), hot[ix][:, rank])[None]
        _put(out, np.array([ix]), x)
        total += x.T @ x
    return total


def _mapped(keys: DataFrame, path: str, rank: int) -> DataFrame:
    """keys (a key, ix) with f from the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _open(path, rank)
        for b in batches:
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * rank), pa.array(table[b.column(1).to_numpy()].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), f], [*b.schema.names[:2], "f"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("f", T.ArrayType(T.DoubleType()))]))


class Matrix:
    """(mmsi, cell_id, hours), one row a pair, made ready for any number of fits: numbered vessels and cells, and the pairs of either side.

    Factors fitted to a Matrix are read from its folder until clear()."""

    def __init__(self, pairs: DataFrame):
        pairs = pairs.where(F.col("mmsi").isNotNull() & F.col("cell_id").isNotNull())
        self.spark = pairs.sparkSession
        self.users, self.items = (indexed(pairs, key).select(key, "ix") for key in ("mmsi", "cell_id"))
        self.n_users, self.n_items = self.users.count(), self.items.count()
        coded = cut(confidence(pairs.join(self.users.withColumnRenamed("ix", "u"), "mmsi").join(self.items.withColumnRenamed("ix", "i"), "cell_id"), 1.0).select("u", "i", "confidence"))
        self.by_user, self.by_item = _grouped(coded, "u", "i"), _grouped(coded, "i", "u")
        self.folder = None

    def own_folder(self) -> str | None:
        if self.folder is None and (shared := mounted_dir(self.spark)):
            self.folder = tempfile.mkdtemp(prefix="factors-", dir=shared)
        return self.folder

    def clear(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


def _grams(rank: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((rank, rank))
        for f in frames:
            if len(f):
                x = np.stack(f["f"].to_numpy())
                g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel().tolist()]})

    return run


def fit_als(pairs: DataFrame | Matrix, factors: int = 64, regularization: float = 0.1, alpha: float = 20.0, iterations: int = 12, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mmsi, ix, f) and (cell_id, ix, f) from (mmsi, cell_id, hours), one row a pair.

    The rank is at most the number of vessels or cells. Item factors start as drawn() gives them. No pairs give two empty
    tables."""
    m = pairs if isinstance(pairs, Matrix) else Matrix(pairs)
    rank = max(1, min(factors, m.n_users, m.n_items))
    if min(m.n_users, m.n_items, iterations) > 0 and max(m.n_users, m.n_items) * rank * 8 <= MAPPED and m.own_folder():
        users, items = _fit_mapped(m, rank, regularization, alpha, iterations, seed)
        if m is not pairs:
            users, items = cut(users), cut(items)
            m.clear()
        return users, items

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"ix": f["ix"], "f": drawn(f["ix"].to_numpy(), rank, seed).tolist()})

    y = m.items.select("ix").mapInPandas(start, "ix int, f array<double>")
    x = m.users.select("ix").withColumn("f", F.lit(None).cast("array<double>")).limit(0)
    for _ in range(iterations):
        x = _half_step(m.by_user, y, rank, regularization, m.n_items, alpha)
        y = _half_step(m.by_item, x, rank, regularization, m.n_users, alpha)
    return m.users.join(x, "ix").select("mmsi", "ix", "f"), m.items.join(y, "ix").select("cell_id", "ix", "f")


def _fit_mapped(m: Matrix, rank: int, regularization: float, alpha: float, iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    y, n, step = _new(m.folder, m.n_items, rank), m.n_items, 10_000

    def start(at: int, y=y) -> np.ndarray:
        ix = np.arange(at, min(n, at + step))
        f = drawn(ix, rank, seed)
        _put(y, ix, f)
        return f.T @ f

    slices = range(0, n, step)
    gram = m.spark.sparkContext.parallelize(slices, min(len(slices), _tasks(m.spark))).map(start).treeReduce(np.add)
    x = None
    for _ in range(iterations):
        x, old = _new(m.folder, m.n_users, rank), x
        gram = _mapped_step(m.by_user, y, x, gram, regularization, alpha)
        y, older = _new(m.folder, m.n_items, rank), y
        gram = _mapped_step(m.by_item, x, y, gram, regularization, alpha)
        for path in (old, older):
            if path:
                os.unlink(path)
    return _mapped(m.users, x, rank), _mapped(m.items, y, rank)


def _best(x: np.ndarray, seen: list, y: np.ndarray, order: np.ndarray, norms: np.ndarray, k: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and score of the k greatest products of each row of x, without those seen (rows of y), by row, score and row of y.

    Rows of y come by norm, so a row of x is done when no later product can reach its k-th best. Products in single
    precision, with a bound on their error, tell which are made in double; only these are compared."""
    n, u, rank = len(y), len(x), x.shape[1]
    size = np.linalg.norm(x, axis=1)
    single = x.astype(np.float32)
    gone = np.sort(np.concatenate([np.zeros(0, np.int64), *(i * n + np.asarray(s, np.int64) for i, s in enumerate(seen) if s is not None and len(s))]))
    unseen = lambda code: code[gone[np.minimum(np.searchsorted(gone, code), len(gone) - 1)] != code] if len(gone) else code
    kth = np.where(np.isfinite(size) & (size > 0), -np.inf, np.inf)
    row, pos, score = (np.zeros(0, t) for t in (np.int64, np.int64, float))
    pool: list[tuple] = []

    def add(code: np.ndarray) -> None:
        i, j = np.divmod(code, n)
        s = np.einsum("ij,ij->i", x[i], y[j])
        good = np.isfinite(s) & ((s >= kth[i]) | np.isinf(kth[i]))
        pool.append((i[good], j[good], s[good]))

    def merge() -> None:
        nonlocal row, pos, score
        i, j, s = (np.concatenate(c) for c in zip((row, pos, score), *pool, strict=True))
        pool.clear()
        by = np.lexsort((j, -s, i))
        i, j, s = i[by], j[by], s[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == k - 1
        kth[i[last]] = np.where(kth[i[last]] == np.inf, np.inf, s[last])
        row, pos, score = (c[place < k] for c in (i, j, s))

    for i in np.flatnonzero(size == 0):  # all products are 0: the first unseen rows
        own = 0 if seen[i] is None else len(seen[i])
        first = np.arange(n) if k + own >= n else np.arange(k + own)
        add(unseen(i * n + first[np.isfinite(norms[first])])[:k])
    for at in range(0, len(order), tile):
        part = order[at : at + tile]
        top = norms[part[0]]
        live = np.flatnonzero(size * top * (1.0 + 1e-9) >= kth)
        if not len(live):
            break
        s = single[live] @ y[part].astype(np.float32).T
        off = (rank + 8) * 2.0**-23 * size[live] * top + rank * 4e-38 * (1.0 + size[live] + top)
        bound = kth[live] - off
        if (kth[live] == -np.inf).any() and len(part) > k:  # the k-th of this tile's unseen ones is a bound at first
            place = np.full(n, -1)
            place[part] = np.arange(len(part))
            back = np.full(u, -1)
            back[live] = np.arange(len(live))
            i, j = np.divmod(gone, n)
            i, j = back[i], place[j]
            own = (i >= 0) & (j >= 0)
            s[i[own], j[own]] = -np.inf
            bound = np.maximum(bound, np.partition(s, len(part) - k, axis=1)[:, len(part) - k] - 2.0 * off)
        hit = np.flatnonzero(s >= bound.astype(np.float32)[:, None])
        i, j = np.divmod(hit, len(part))
        add(unseen(live[i] * n + part[j]))
        if (kth[live] == -np.inf).any() or sum(len(p[0]) for p in pool) > u * k:
            merge()
    merge()
    return row, pos, score


def seen_numbers(seen: DataFrame, items: DataFrame) -> DataFrame:
    """(mmsi, seen): the numbers of the cells that a vessel has seen. items: cell_id, ix."""
    return seen.select("mmsi", "cell_id").distinct().join(items.select("cell_id", "ix"), "cell_id").groupBy("mmsi").agg(F.collect_set("ix").alias("seen"))


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the vessels among keys. keys should be cheap to count."""
    return rows.join(broadcast_if_small(keys.select("mmsi").distinct(), MOST_KEYS), "mmsi", "left_semi")


def recommend(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, block: int = 50_000) -> DataFrame:
    """mmsi, rank, cell_id, score: the k unseen cells of greatest score; ties to the smaller id.

    users: mmsi, f; items: cell_id, f, and where they are numbered from 0 in the order of their ids, as fit_als does, ix;
    seen: mmsi, cell_id, or for numbered items mmsi, seen as seen_numbers gives them. Scores are made in tiles, a matrix
    product each, and only the k best of a task's users leave it: never a row per user and item. Where the shared folder
    is mounted, item factors are a file there while this runs; else they are sent block by block."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = users.sparkSession
    coded = items.select("cell_id", "ix", "f") if "ix" in items.columns else cut(indexed(items, "cell_id").join(items.select("cell_id", "f"), "cell_id"))
    n = coded.count()
    if not n:
        return users.select("mmsi", F.lit(0).alias("rank"), F.lit("").alias("cell_id"), F.lit(0.0).alias("score")).limit(0)
    seen_ix = seen if "seen" in seen.columns else seen_numbers(seen, coded)
    who = cut(users.select("mmsi", "f").join(seen_ix, "mmsi", "left"))
    who = who.repartition(_tasks(spark, who.count(), 50_000))
    folder, rank = mounted_dir(spark), len(coded.first()["f"])

    def kernel(table: Callable[[], np.ndarray], at: int, tile: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            y = order = norms = None
            for f in frames:
                for lo in range(0, len(f), WHO):
                    rows = f.iloc[lo : lo + WHO]
                    if y is None:
                        y = table()
                        norms = np.concatenate([np.linalg.norm(y[a : a + 10_000], axis=1) for a in range(0, len(y), 10_000)])
                        order = np.flatnonzero(np.isfinite(norms))
                        order = order[np.argsort(-norms[order], kind="stable")]
                    seen = [s if s is None else (g := np.asarray(s) - at)[(g >= 0) & (g < len(y))] for s in rows["seen"]]
                    i, j, s = _best(np.stack(rows["f"].to_numpy()), seen, y, order, norms, k, tile)
                    yield pd.DataFrame({"mmsi": rows["mmsi"].to_numpy()[i], "rank": np.arange(1, len(i) + 1) - np.searchsorted(i, i), "ix": j + at, "score": s})

        return run

    shape = "mmsi string, rank int, ix int, score double"
    if folder and n * rank * 8 <= MAPPED:
        path = _new(folder, n, rank)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    _put(path, b.column(0).to_numpy(), _matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], ["ix"])

        coded.select("ix", "f").mapInArrow(keep, "ix int").count()
        best = who.mapInPandas(kernel(lambda: _open(path, rank), 0, min(block, TILE)), shape)
        named = cut(best.join(coded.select("cell_id", "ix"), "ix").select("mmsi", "rank", "cell_id", "score"))
        os.unlink(path)
        return named
    best = None
    for at in range(0, n, block):
        part = [b for b in coded.where((F.col("ix") >= at) & (F.col("ix") < at + block)).orderBy("ix").select("f").toArrow().to_batches() if len(b)]  # at most `block` rows
        shipped = spark.sparkContext.broadcast(np.concatenate([_matrix(b.column(0)) for b in part]))
        one = who.mapInPandas(kernel(lambda shipped=shipped: shipped.value, at, TILE), shape)
        best = one if best is None else best.unionByName(one)
    order = Window.partitionBy("mmsi").orderBy(F.col("score").desc(), "ix")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(coded.select("cell_id", "ix"), "ix").select("mmsi", "rank", "cell_id", "score")


def pair_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with the score of each; pairs without factors on either side score 0."""
    dot = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    joined = pairs.join(users.select("mmsi", F.col("f").alias("fu")), "mmsi", "left").join(items.select("cell_id", F.col("f").alias("fi")), "cell_id", "left")
    return joined.withColumn("score", F.coalesce(dot, F.lit(0.0))).drop("fu", "fi")


#: Gears or flags that are encoded at most; more are an error.
MOST_LEVELS = 2_000
NUMBERS = ["length_m_gfw", "tonnage_gt_gfw", "engine_power_kw_gfw"]


def encode_vessels(keys: DataFrame, latest: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(mmsi, x), gears, flags: an intercept, one-hot gear and flag, and log(1 + number) with the median where it is missing.

    Levels are in sorted order; a missing level leaves zeros. Levels are the vocabularies of gears and flags."""
    v = keys.select("mmsi").join(latest, "mmsi", "left")

    def levels(c: str) -> list[str]:
        found = v.where(F.col(c).isNotNull() & (F.col(c) != "")).select(c).distinct().orderBy(c).limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels: too many for one column each")
        return [r[0] for r in found]

    gears, flags = levels("vessel_class_gfw"), levels("flag_gfw")
    good = lambda c: F.log1p(F.greatest(F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)), F.lit(0.0)))
    number = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), good(c)) for c in NUMBERS}
    fill = v.agg(*(F.coalesce(F.median(x), F.lit(0.0)).alias(c) for c, x in number.items())).first()
    hot = lambda c, names: [F.coalesce((F.col(c) == n).cast("double"), F.lit(0.0)) for n in names]
    x = [F.lit(1.0), *hot("vessel_class_gfw", gears), *hot("flag_gfw", flags), *(F.coalesce(number[c], F.lit(fill[c])) for c in NUMBERS)]
    return v.select("mmsi", F.array(*x).alias("x")), gears, flags


def fit_foldin(features: DataFrame, users: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """Weights from features to user factors by ridge regression over vessels with factors; the intercept is not penalised. Each partition sends its sums."""
    rows = features.join(users.select("mmsi", "f"), "mmsi").select("x", "f")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x, y = np.stack(f["x"].to_numpy()), np.stack(f["f"].to_numpy())
                part = np.hstack([x.T @ x, x.T @ y])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"rows": [total.shape[0]], "s": [total.ravel().tolist()]})

    total = None
    for r in rows.mapInPandas(sums, "rows int, s array<double>").collect():  # one row a partition
        part = np.array(r["s"]).reshape(r["rows"], -1)
        total = part if total is None else total + part
    if total is None:
        raise ValueError("no vessel has both features and factors")
    n = total.shape[0]
    penalty = ridge * np.eye(n)
    penalty[0, 0] = 0.0
    return np.linalg.solve(total[:, :n] + penalty, total[:, n:])


def fold_in(features: DataFrame, weights: np.ndarray) -> DataFrame:
    """(mmsi, f): user factors from features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.stack(f["x"].to_numpy()) @ weights if len(f) else np.zeros((0, weights.shape[1]))
            yield pd.DataFrame({"mmsi": f["mmsi"], "f": out.tolist()})

    return features.mapInPandas(run, "mmsi string, f array<double>")


def hybrid_factors(own: DataFrame, folded: DataFrame) -> DataFrame:
    """A vessel's own factors if it has a history, else those folded in."""
    return folded.select("mmsi", F.col("f").alias("g")).join(own.select("mmsi", "f"), "mmsi", "full").select("mmsi", F.coalesce("f", "g").alias("f"))


# The settings that are tried.
GRID = [
    {"factors": 32, "regularization": 0.1, "alpha": 10.0},
    {"factors": 32, "regularization": 0.1, "alpha": 40.0},
    {"factors": 64, "regularization": 0.1, "alpha": 10.0},
    {"factors": 64, "regularization": 0.1, "alpha": 40.0},
    {"factors": 64, "regularization": 0.01, "alpha": 20.0},
    {"factors": 64, "regularization": 1.0, "alpha": 20.0},
]


def tune(pairs: DataFrame, relevant: DataFrame, score, grid: list[dict] = GRID) -> tuple[dict, list[tuple[dict, float]]]:
    """The first of the best settings by score(rankings, relevant), and all trials. A score of None counts as -1.

    The pairs are made ready once for all fits. Rankings are of the vessels in relevant, which alone are scored."""
    best, trials = dict(grid[0]), []
    top = -1.0
    matrix = Matrix(pairs)
    seen = cut(seen_numbers(only(pairs, relevant), matrix.items))

    def tried(settings: dict) -> float:
        own = copy.copy(matrix)  # with a folder of its own
        users, items = fit_als(own, **settings)
        value = score(recommend(only(users, relevant), items, seen, 10), relevant)
        own.clear()
        return -1.0 if value is None else float(value)

    with ThreadPoolExecutor(AT_ONCE) as pool:  # a trial's short steps leave cores to another
        values = list(pool.map(tried, grid))
    for settings, value in zip(grid, values, strict=True):
        trials.append((settings, value))
        if value > top:
            top, best = value, dict(settings)
    return best, trials


def save_model(path: str, users: DataFrame, items: DataFrame, weights: np.ndarray | None = None, pairs: DataFrame | None = None) -> None:
    """Write the factors, and where given the fold-in weights and the matrix that was fitted (pairs: mmsi, cell_id, hours, by the numbers of the factors), as Parquet below path."""
    spark = users.sparkSession
    users.write.mode("overwrite").parquet(f"{path}/users")
    items.write.mode("overwrite").parquet(f"{path}/items")
    if weights is not None:
        spark.createDataFrame([(i, w) for i, w in enumerate(weights.tolist())], "feature int, weights array<double>").write.mode("overwrite").parquet(f"{path}/foldin")
    if pairs is not None:
        coded = pairs.join(users.select("mmsi", F.col("ix").alias("u")), "mmsi").join(items.select("cell_id", F.col("ix").alias("i")), "cell_id").select("u", "i", "hours")
        coded.write.mode("overwrite").parquet(f"{path}/matrix")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The factors (mmsi, ix, f) and (cell_id, ix, f) that save_model wrote."""
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items")


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    """The fold-in weights that save_model wrote; a row per feature, of which there are at most twice MOST_LEVELS and a few."""
    return np.array([r["weights"] for r in spark.read.parquet(f"{path}/foldin").orderBy("feature").collect()])


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(mmsi, cell_id, hours) of the matrix that save_model wrote."""
    users, items = load_model(spark, path)
    m = spark.read.parquet(f"{path}/matrix")
    return m.join(users.select(F.col("ix").alias("u"), "mmsi"), "u").join(items.select(F.col("ix").alias("i"), "cell_id"), "i").select("mmsi", "cell_id", "hours")
