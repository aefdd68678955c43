"""Distinct counts from mergeable sketches.

A sketch has 2^P registers of one byte. An identifier's hash picks a register and a rank (k with probability 2^-k); a
register keeps its greatest rank and whether the two ranks below it occurred. Two registers merge without loss by a table
of 256 x 256 bytes. The count is the maximum-likelihood estimate under Poisson arrivals; its relative standard error is
0.761 / sqrt(2^P), 1.19 % for P = 12, against 1.62 % for registers of the greatest rank alone.

As long as that takes less room, a sketch is a sorted list of tokens of 32 bits instead: 26 bits of the hash and the rank
of the rest, from which registers follow exactly. Groups of up to a thousand identifiers are thus counted all but exactly.

Each map task builds the sketches of its rows (in numpy, from hashes made in the JVM), so what is shuffled is a part per
group and task, of at most 2^P bytes. Parts are merged as they stream by, sorted by group, holding those of one group up to
GATHERED bytes, first within every MERGED_TASKS map tasks, then in all: a hot group is neither collected nor left to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidelog.functions.values import vessel_of

P = 12
TOKEN_BITS = 26
#: Relative standard error of an estimate is ERROR / sqrt(registers).
ERROR = 0.761
#: Tokens that a map task holds before it lets its parts go, and map tasks whose parts meet first.
HELD, MERGED_TASKS = 4_000_000, 64
#: Tokens that the name of a group weighs as many as, and bytes of parts of one group that are merged at once.
NAME_TOKENS, GATHERED = 8, 1 << 20


def packed(ranks: np.ndarray) -> np.ndarray:
    """The register byte of a set of ranks (bit k - 1: rank k occurred): 4 * greatest rank + 2 * (rank below occurred) + (rank two below occurred); 0: empty."""
    top = np.frexp(ranks.astype(np.float64))[1].astype(np.int64)  # exact: at most 53 bits
    low = lambda n: np.where(top > n, (ranks >> np.maximum(top - 1 - n, 0)) & 1, 0)
    return (4 * top + 2 * low(1) + low(2)).astype(np.uint8)


def unpacked(registers: np.ndarray) -> np.ndarray:
    """The set of ranks that a register byte stands for."""
    top, bits = registers.astype(np.int64) >> 2, registers.astype(np.int64) & 3
    three = 4 | bits
    return np.where(top == 0, 0, np.where(top >= 3, three << np.maximum(top - 3, 0), three >> np.maximum(3 - top, 0)))


def _merges() -> np.ndarray:
    """The byte of the union of two registers, by both bytes. Bytes that no register takes give what their ranks would."""
    codes = np.arange(256)
    ranks = unpacked(np.minimum(codes, 4 * 53 + 3))
    return packed(ranks[:, None] | ranks[None, :])


MERGES = _merges()


def tokens_of(hashes: np.ndarray) -> np.ndarray:
    """The tokens of hashes of 64 bits: the lower TOKEN_BITS and, above, the rank of the rest."""
    h = hashes.view(np.uint64)
    rest = h >> np.uint64(TOKEN_BITS)
    lowest = rest & (~rest + np.uint64(1))
    rank = np.where(rest == 0, 64 - TOKEN_BITS + 1, np.frexp(lowest.astype(np.float64))[1]).astype(np.uint64)
    return ((h & np.uint64((1 << TOKEN_BITS) - 1)) | (rank << np.uint64(TOKEN_BITS))).astype(np.uint32)


def registers_of(tokens: np.ndarray, p: int = P) -> np.ndarray:
    """The register bytes of tokens."""
    t = tokens.astype(np.int64)
    middle = (t >> p) & ((1 << (TOKEN_BITS - p)) - 1)
    rank = np.where(middle == 0, TOKEN_BITS - p + (t >> TOKEN_BITS), np.frexp((middle & -middle).astype(np.float64))[1])
    order = np.argsort(at := t & ((1 << p) - 1), kind="stable")
    at, ranks = at[order], (np.int64(1) << (np.minimum(rank, 53) - 1))[order]
    out = np.zeros(1 << p, np.uint8)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = packed(np.bitwise_or.reduceat(ranks, first))
    return out


def sketch_of(tokens: np.ndarray, p: int = P) -> bytes:
    """The sketch of sorted different tokens: themselves if they take less room than registers."""
    return tokens.tobytes() if 4 * len(tokens) < 1 << p else registers_of(tokens, p).tobytes()


def merge_sketches(a: bytes, b: bytes, p: int = P) -> bytes:
    """The sketch of the union of two sketches; it is the same as if one sketch had seen all identifiers."""
    return union_of([a, b], p)


def union_of(sketches: list[bytes], p: int = P) -> bytes:
    """The sketch of the union of any number of sketches."""
    tokens = np.frombuffer(b"".join(s for s in sketches if len(s) < 1 << p), np.uint32)
    full = [np.frombuffer(s, np.uint8) for s in sketches if len(s) == 1 << p]
    if not full:
        return sketch_of(np.unique(tokens), p)
    out = registers_of(tokens, p)
    for registers in full:
        out = MERGES[out, registers]
    return out.tobytes()


def statistics(codes: np.ndarray) -> tuple[float, np.ndarray]:
    """What the likelihood depends on: the probability of all that did not occur, and how often each rank did. codes: the register bytes."""
    top, bits = codes.astype(np.int64) >> 2, codes & 3
    absent = (2.0**-top).sum()  # an empty register misses the whole probability, 1
    seen = np.bincount(top, top > 0, minlength=66)
    for n, bit in ((1, 2), (2, 1)):
        there = (top > n) & ((bits & bit) > 0)
        absent += (2.0 ** (n - top))[(top > n) & ~there].sum()
        seen += np.bincount(np.maximum(top - n, 0), there, minlength=66)
    return float(absent), seen


def estimates(stats: list[tuple[float, np.ndarray]], m: int) -> np.ndarray:
    """The maximum-likelihood counts: where the sum over ranks of seen * q / (exp(rate * q) - 1), q = 2^-rank, falls to `absent`."""
    if not stats:
        return np.zeros(0)
    absent, seen = np.array([a for a, _ in stats]), np.array([s for _, s in stats])
    q = 2.0 ** -np.arange(seen.shape[1])
    low, high = np.full(len(stats), -40.0), np.full(len(stats), 45.0)
    for _ in range(80):  # of the logarithm of the rate
        mid = (low + high) / 2
        slope = (seen * (q / np.expm1(np.clip(np.exp(mid)[:, None] * q, 1e-300, 700.0)))).sum(axis=1)
        up = slope > absent
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(seen.sum(axis=1) == 0, 0.0, m * np.exp((low + high) / 2))


def counts_of(sketches: list[bytes], p: int = P) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and their standard errors. Of tokens the estimate is their number, made up for the few that fell together."""
    out, error = np.zeros(len(sketches)), np.zeros(len(sketches))
    full = [i for i, s in enumerate(sketches) if len(s) == 1 << p]
    for i, s in enumerate(sketches):
        if len(s) < 1 << p:
            n = len(s) // 4
            out[i] = -np.log1p(-n / 2.0**TOKEN_BITS) * 2.0**TOKEN_BITS
            error[i] = n / 2.0 ** (TOKEN_BITS / 2)
    if full:
        out[full] = estimates([statistics(np.frombuffer(sketches[i], np.uint8)) for i in full], 1 << p)
        error[full] = out[full] * ERROR / 2.0 ** (p / 2)
    return out, error


#: A group has a number (code) or a text (name).
KEYS = ["level", "code", "what", "name"]
PARTS = "level string, code long, what string, sketch binary, name string"


def sketch_parts(df: DataFrame, groups: dict[str, Column], identifiers: dict[str, Column], p: int = P, texts: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """level, code, what, sketch, name: for each task the sketches of its rows, per level (a whole number codes the group) and kind of identifier.

    texts: levels whose groups are texts, each with the one kind of identifier that is counted there. Null codes, texts and
    identifiers do not count. No more than HELD tokens are held at once, and no more than an eighth as many texts."""
    kinds, texts = list(identifiers), texts or {}
    levels = [*groups, *texts]
    counts = [*(range(len(kinds)) for _ in groups), *([kinds.index(what)] for _, what in texts.values())]
    hashed = df.select(*(c.cast("long").alias(f"g{i}") for i, c in enumerate(groups.values())), *(c.alias(f"t{i}") for i, (c, _) in enumerate(texts.values())), *(F.when(c.isNotNull(), F.xxhash64(c)).alias(f"h{i}") for i, c in enumerate(identifiers.values())))
    numbered = len(groups)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        names: dict[int, dict[str, int]] = {}
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            good = [~b.column(i).is_null().to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            number = {i: b.column(i).fill_null(0).to_numpy() for i in range(b.num_columns) if not numbered <= i < len(levels)}
            tokens = [tokens_of(np.ascontiguousarray(number[len(levels) + k])) for k in range(len(kinds))]
            for g in range(len(levels)):
                for k in counts[g]:
                    ok = good[g] & good[len(levels) + k]
                    if not ok.any():
                        continue
                    if g < numbered:
                        code = number[g][ok]
                    else:
                        known = names.setdefault(g, {})
                        n -= NAME_TOKENS * len(known)
                        code = _coded(b.column(g).filter(pa.array(ok)), known)
                        n += NAME_TOKENS * len(known)
                    pair = _unique(code, tokens[k][ok])
                    held.setdefault((g, k), []).append(pair)
                    n += len(pair[0])
            if n > HELD:
                yield from _emitted(held, levels, kinds, names, p)
                held, names, n = {}, {}, 0
        yield from _emitted(held, levels, kinds, names, p)

    return hashed.mapInArrow(build, PARTS)


def _coded(texts: pa.Array, known: dict[str, int]) -> np.ndarray:
    """Whole numbers for texts, by and into what is known."""
    different = texts.dictionary_encode()
    codes = np.array([known.setdefault(x, len(known)) for x in different.dictionary.to_pylist()], np.int64)
    return codes[different.indices.to_numpy()]


def _unique(code: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((token, code))
    code, token = code[order], token[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (token[1:] != token[:-1])])
    return code[new], token[new]


def _emitted(held: dict, levels: list[str], kinds: list[str], names: dict[int, dict[str, int]], p: int) -> Iterator[pa.RecordBatch]:
    for (g, k), pairs in held.items():
        code, token = _unique(np.concatenate([c for c, _ in pairs]), np.concatenate([t for _, t in pairs]))
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(starts[1:], len(code))
        texts = list(names.get(g, ()))  # by number
        for at in range(0, len(starts), 1_000):
            part = slice(at, at + 1_000)
            made = [sketch_of(token[i:j], p) for i, j in zip(starts[part], ends[part], strict=True)]
            group = code[starts[part]]
            own = (pa.nulls(len(made), pa.int64()), pa.array([texts[i] for i in group], pa.string())) if texts else (pa.array(group), pa.nulls(len(made), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([levels[g]] * len(made)), own[0], pa.array([kinds[k]] * len(made)), pa.array(made, pa.binary()), own[1]], names=["level", "code", "what", "sketch", "name"])


def merged(parts: DataFrame, p: int = P) -> DataFrame:
    """One sketch per level, group and what, from any number of parts of each."""
    salt = F.floor(F.spark_partition_id() / MERGED_TASKS)
    some = _streamed(parts.withColumn("_salt", salt), [*KEYS, "_salt"], p)
    return _streamed(some, KEYS, p)


def _streamed(parts: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Parts of equal keys follow each other; those of one key are held, merged whenever they take more than GATHERED bytes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, same, size, out = None, [], 0, []

        def ended() -> None:
            level, code, what, name = last[:4]
            out.append((level, code, what, same[0] if len(same) == 1 else union_of(same, p), name))

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["level", "code", "what", "sketch", "name"])

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (*keys, "sketch")), strict=True)
            for *key, s in rows:
                if key != last:
                    if last is not None:
                        ended()
                    last, same, size = key, [], 0
                same.append(s)
                size += len(s)
                if size > GATHERED:
                    same = [union_of(same, p)]
                    size = len(same[0])
            if len(out) > 2_000:
                yield flushed()
                out = []
        if last is not None:
            ended()
        yield flushed()

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, PARTS)


def counted(sketches: DataFrame, p: int = P) -> DataFrame:
    """The columns of sketches but the sketch, with estimate and standard_error."""
    kept = [c for c in sketches.columns if c != "sketch"]
    schema = sketches.select(*kept).schema.add("estimate", "double").add("standard_error", "double")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, s = counts_of(b.column("sketch").to_pylist(), p)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(e), pa.array(s)], names=[*kept, "estimate", "standard_error"])

    return sketches.mapInArrow(solve, schema)


def vessel_group(vessel: Column) -> Column:
    """The country digits of a vessel number."""
    return F.substring(vessel, 1, 3)


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def event_groups() -> tuple[dict[str, Column], dict[str, Column]]:
    """The groups of events (date, mmsi, cell_id, cell_ll_lat, cell_ll_lon), coded as whole numbers, and the identifiers that are counted."""
    vessel, day = vessel_of(F.col("mmsi")), F.col("date")
    block = lambda c, wide: F.floor(F.when(~F.isnan(c), F.col(c)) / 10.0) + wide
    groups = {
        "date": F.unix_date(day),
        "vessel_group_month": vessel_group(vessel).cast("long") * 1_000_000 + _months(day),
        "cell_group": block("cell_ll_lat", 1_000) * 100_000 + block("cell_ll_lon", 1_000),
    }
    return groups, {"vessels": vessel, "cells": F.col("cell_id")}


def single_cells() -> dict[str, tuple[Column, str]]:
    """The level of single cells, by cell_id as it is: only vessels are counted in it, as a cell has but itself."""
    return {"cell": (F.col("cell_id"), "vessels")}


def unions(sketches: DataFrame, p: int = P) -> DataFrame:
    """The sketches of unions: month, year and all of dates; vessel group of its months; latitude band of cell groups."""
    part = lambda level, code: F.struct(F.lit(level).alias("level"), code.cast("long").alias("code"))
    code, day = F.col("code"), F.date_from_unix_date(F.col("code").cast("int"))
    ups = F.when(F.col("level") == "date", F.array(part("month", _months(day)), part("year", F.year(day)), part("all", F.lit(0))))
    ups = ups.when(F.col("level") == "vessel_group_month", F.array(part("vessel_group", F.floor(code / 1_000_000))))
    ups = ups.when(F.col("level") == "cell_group", F.array(part("latitude_band", F.floor(code / 100_000))))
    return merged(sketches.select(F.explode(ups).alias("u"), "what", "sketch").select("u.*", "what", "sketch", F.lit(None).cast("string").alias("name")), p)


def named(df: DataFrame) -> DataFrame:
    """level, key and the rest: the code of a group in words, or its name where there is one."""
    code = F.col("code")
    text = lambda x: x.cast("int").cast("string")
    month = lambda m: F.format_string("%04d-%02d", F.floor(m / 12), m % 12 + 1)
    tens = lambda x: text((x - 1_000) * 10)
    key = F.when(F.col("level") == "date", F.date_from_unix_date(code.cast("int")).cast("string")).when(F.col("level") == "month", month(code)).when(F.col("level") == "year", text(code)).when(F.col("level") == "all", "all")
    key = key.when(F.col("level") == "vessel_group_month", F.concat(F.lpad(text(F.floor(code / 1_000_000)), 3, "0"), F.lit("|"), month(code % 1_000_000))).when(F.col("level") == "vessel_group", F.lpad(text(code), 3, "0"))
    key = key.when(F.col("level") == "cell_group", F.concat_ws("_", tens(F.floor(code / 100_000)), tens(code % 100_000))).when(F.col("level") == "latitude_band", tens(code))
    key = F.coalesce("name", key) if "name" in df.columns else key
    return df.select("level", key.alias("key"), *(c for c in df.columns if c not in ("level", "code", "name")))


def group_sketches(df: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x, p: int = P, texts: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """level, code, what, sketch, name of every date, vessel group and month, cell group, of their unions, and of groups by `texts`. keep: stores the sketches of the groups, of which the unions are made."""
    base = keep(merged(sketch_parts(df, *event_groups(), p, texts), p))
    return base.unionByName(unions(base, p))


def distinct_counts(df: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x, p: int = P, texts: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """level, key, what, estimate, standard_error of every date, month, year, group and their unions, and of groups by `texts`.

    Vessels that cannot be read and null cells are not counted; events without a date or place are left out of the groups
    that need it. Repeated events count once. No events, no rows. Other columns are not read."""
    return named(counted(group_sketches(df, keep, p, texts), p))
