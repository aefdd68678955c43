"""Minimum-cost error parse of delimited text lines.

A dynamic program over the quotes and delimiters of a line finds the cheapest way to read it as exactly n columns, where
inserting or deleting a quote or a delimiter costs 1. Lines read at no cost whose values are valid load; of the others the
edit operations, or the first invalid value, are the reason.

Text between quotes and delimiters cannot change the cheapest parse, so lines are reduced to their signature (text runs
become one symbol) and the program runs once per signature in each worker. Every line goes through it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BARE, QUOTED, CLOSED = range(4)
PIECES = re.compile(r'[^",]+|[",]')
RUNS = re.compile(r'[^",]+')
EDITS = {"d": "insert_delimiter", "D": "delete_delimiter", "q": "insert_quote", "Q": "delete_quote"}
FAR = 1 << 30
KEPT_SIGNATURES, KEPT_LENGTH, KEPT_STEPS = 20_000, 4_000, 10_000


def _moves(columns: int) -> tuple[dict[str, list[tuple[int, int, int, str]]], list[tuple[int, int, str]]]:
    """(moves on each symbol: from, to, cost, effect) in the order in which ties are settled, and insertions (from, to, edit).

    States are column * 4 + mode. Effects: v the symbol belongs to the value of its column, other letters are edits."""
    on: dict[str, list[tuple[int, int, int, str]]] = {",": [], '"': [], "x": []}
    between = []
    width = columns * 4
    for s in range(width):
        mode, first = s & 3, s & ~3
        if mode == QUOTED:
            on[","].append((s, s, 0, "v"))
        else:
            if first + 4 < width:
                on[","].append((s, first + 4, 0, ""))
            on[","].append((s, s, 1, "D"))
        if mode == START:
            on['"'].append((s, first + QUOTED, 0, ""))
        elif mode == QUOTED:
            on['"'] += [(s, first + CLOSED, 0, ""), (s, s, 1, "vq")]
        elif mode == CLOSED:
            on['"'].append((s, first + QUOTED, 0, "v"))
        on['"'].append((s, s, 1, "Q"))
        if mode == QUOTED:
            on["x"].append((s, s, 0, "v"))
        elif mode != CLOSED:
            on["x"].append((s, first + BARE, 0, "v"))
        if mode in (START, QUOTED):
            between.append((s, s + (QUOTED - START if mode == START else CLOSED - QUOTED), "q"))
        if mode != QUOTED and s + 4 < width:
            between.append((s, first + 4, "d"))
    return on, between


class Moves:
    """The moves as arrays: for each symbol and state the moves that lead to it, in layers of one move a state at most, so ties go to the earlier layer; a move is coded in a byte."""

    def __init__(self, columns: int) -> None:
        on, self.between = _moves(columns)
        self.codes = [m for moves in on.values() for m in moves]
        self.width = columns * 4
        self.layers: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for symbol, moves in on.items():
            into: dict[int, list] = {}
            for m in moves:
                into.setdefault(m[1], []).append(m)
            layers = []
            for k in range(max(map(len, into.values()))):
                part = [ms[k] for ms in into.values() if len(ms) > k]
                layers.append(tuple(np.array(x) for x in ([m[0] for m in part], [m[1] for m in part], [m[2] for m in part], [self.codes.index(m) for m in part])))
            self.layers[symbol] = layers
        if self.width > 250 or len(self.codes) > 250:
            raise ValueError("too many columns")
        self.known: dict[tuple[bytes, str], tuple[bytes, int, np.ndarray, np.ndarray]] = {}

    def settle(self, cost: np.ndarray, came: np.ndarray) -> None:
        """Insertions lead to the next column or, within one, from START to QUOTED and from QUOTED to CLOSED, so one round in order settles them; came takes the insertion by which a state was reached."""
        known = cost.tolist()
        for k, (s, to, _) in enumerate(self.between):
            if known[s] + 1 < known[to]:
                known[to] = cost[to] = known[s] + 1
                came[to] = k

    def step(self, cost: np.ndarray, symbol: str) -> tuple[bytes, int, np.ndarray, np.ndarray]:
        """From the costs before a symbol: those after it against the least of them, by how much that grew, and by which move and which insertion (255: none) each state was reached."""
        new, back, inserted = np.full(self.width, FAR, np.int64), np.zeros(self.width, np.uint8), np.full(self.width, 255, np.uint8)
        for source, to, extra, code in self.layers[symbol]:
            c = cost[source] + extra
            better = c < new[to]
            new[to[better]] = c[better]
            back[to[better]] = code[better]
        self.settle(new, inserted)
        least = int(new.min())
        return np.where(new >= FAR, FAR, new - least).tobytes(), least, back, inserted


@functools.cache
def moves_of(columns: int) -> Moves:
    return Moves(columns)


def cheapest_parse(signature: str, columns: int) -> tuple[int, str, list[list[int]]]:
    """Cost, edits (letters of EDITS, in order) and, per column, the indexes of the symbols that belong to its value.

    States are (column, mode). Moves on a symbol: text extends a bare or quoted value; a delimiter ends a value, is text
    inside quotes, or is deleted; a quote opens, closes or doubles, is deleted, or is doubled by an inserted one. Moves
    between symbols insert a delimiter or a quote. Ties go to the move listed first. What a symbol does depends on the
    costs of the states against the least of them only; such steps are kept, as they recur. For the way back two bytes a
    state and symbol are held: 64 MB for a line with a million quotes, delimiters and runs between them."""
    m = moves_of(columns)
    n, width = len(signature), m.width
    cost = np.full(width, FAR, np.int64)
    cost[0] = 0
    first = np.full(width, 255, np.uint8)
    m.settle(cost, first)
    back, inserted = np.zeros((n + 1, width), np.uint8), np.zeros((n + 1, width), np.uint8)
    inserted[0], base, at = first, 0, cost.tobytes()
    for i, symbol in enumerate(signature, 1):
        step = m.known.get((at, symbol))
        if step is None:
            if len(m.known) >= KEPT_STEPS:
                m.known.clear()
            step = m.known[at, symbol] = m.step(np.frombuffer(at, np.int64), symbol)
        at, more, back[i], inserted[i] = step
        base += more
    cost = np.frombuffer(at, np.int64)

    last = width - 4
    state = min((last + START, last + BARE, last + CLOSED), key=lambda s: cost[s])
    total, edits, values = base + int(cost[state]), [], [[] for _ in range(columns)]
    for i in range(n, -1, -1):
        while (k := inserted[i, state]) != 255:
            state, _, edit = m.between[k]
            edits.append(edit)
        if i:
            at = state
            state, _, _, what = m.codes[back[i, at]]
            if what.startswith("v"):
                values[at >> 2].append(i - 1)
            edits.extend(x for x in what if x != "v")
    return total, "".join(reversed(edits)), [v[::-1] for v in values]


def describe(edits: str) -> str | None:
    return "; ".join(f"{name} x{n}" for letter, name in EDITS.items() if (n := edits.count(letter))) or None


class LineParser:
    """Reads lines; keeps the parse of each signature. Picklable; the memory is per worker."""

    def __init__(self, columns: int) -> None:
        self.columns, self.known = columns, {}

    def __getstate__(self) -> int:
        return self.columns

    def __setstate__(self, columns: int) -> None:
        self.__init__(columns)

    def plan(self, signature: str) -> tuple[int, str | None, list[list[int]]]:
        plan = self.known.get(signature)
        if plan is None:
            cost, edits, values = cheapest_parse(signature, self.columns)
            plan = cost, describe(edits), values
            if len(signature) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_SIGNATURES:
                    self.known.clear()
                self.known[signature] = plan
        return plan

    def read(self, line: str) -> tuple[list[str], int, str | None]:
        if line.endswith("\r"):
            line = line[:-1]
        pieces = PIECES.findall(line)
        cost, edits, values = self.plan(RUNS.sub("x", line))
        return ["".join([pieces[i] for i in v]).strip(" \t") for v in values], cost, edits


PARSED = pa.struct([("values", pa.list_(pa.string())), ("cost", pa.int32()), ("edits", pa.string())])


def parsed(line: Column, columns: int) -> Column:
    """struct(values, cost, edits) of each line; null for a null line."""
    parser = LineParser(columns)

    @F.arrow_udf("struct<values: array<string>, cost: int, edits: string>")
    def read(lines: pa.Array) -> pa.Array:
        rows = []
        for x in lines.to_pylist():
            if x is None:
                rows.append(None)
            else:
                values, cost, edits = parser.read(x)
                rows.append({"values": values, "cost": cost, "edits": edits})
        return pa.array(rows, PARSED)

    return read(line)


# What an effort line holds.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NO_NUMBER = ["", "NA", "NaN", "null", "NULL"]
FORMATS = ["zip", "csv_dir"]


def number(v: Column) -> Column:
    """The finite number that the text is, else null."""
    x = F.when(v.rlike(NUMBER), v.try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def day(v: Column) -> Column:
    return F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v.try_cast("date"))


#: Name, type, reader (null: invalid or absent) and test of each column, in the order of the line.
EFFORT_COLUMNS: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = [
    ("date", "string", lambda v: v, lambda v: day(v).isNotNull()),
    ("cell_ll_lat", "double", number, lambda v: number(v).between(-90.0, 90.0)),
    ("cell_ll_lon", "double", number, lambda v: number(v).between(-180.0, 180.0)),
    ("mmsi", "string", lambda v: v, lambda v: v.rlike("^[0-9]+$")),
    ("hours", "double", number, lambda v: number(v) >= 0.0),
    ("fishing_hours", "double", number, lambda v: v.isin(NO_NUMBER) | (number(v) >= 0.0)),
    ("source_file", "string", lambda v: v, lambda v: ~v.isin(NO_NUMBER)),
    ("source_format", "string", lambda v: v, lambda v: v.isin(FORMATS)),
]


def parse_effort_lines(df: DataFrame, line: str = "line", out: str = "effort") -> DataFrame:
    """Every row of df with a struct `out`: the eight columns, cost, edits and reject_reason (null: the line loads).

    A null line is rejected as null_line, an empty one needs seven delimiters. A column that is already called `out` is
    replaced; other columns of df, of whatever name, stay as they are. No rows in, no rows out."""
    raw = df.withColumn(out, parsed(F.col(line).cast("string"), len(EFFORT_COLUMNS)))
    values, cost, edits = F.col(out)["values"], F.col(out)["cost"], F.col(out)["edits"]
    reason = F.when(values.isNull(), "null_line").when(cost > 0, F.concat(F.lit("structure: "), edits))
    fields = []
    for i, (name, kind, read, sound) in enumerate(EFFORT_COLUMNS):
        v = values[i]
        reason = reason.when(~F.coalesce(sound(v), F.lit(False)), f"invalid_value: {name}")
        fields.append(read(v).cast(kind).alias(name))
    return raw.withColumn(out, F.struct(*fields, cost.alias("cost"), edits.alias("edits"), reason.alias("reject_reason")))


def split_effort_lines(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(bronze rows, rejected rows): bronze has the eight typed columns and file_date from the source file's name; rejects keep the row with cost, edits and reason."""
    rows = parse_effort_lines(df, line)
    names = [name for name, *_ in EFFORT_COLUMNS]
    kept = [c for c in df.columns if c not in {*names, line, "file_date"}]
    good = rows.where(F.col("effort.reject_reason").isNull()).select(*kept, *(F.col("effort")[n].alias(n) for n in names))
    good = good.withColumn("file_date", F.regexp_extract("source_file", r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?!.*[0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date"))
    bad = rows.where(F.col("effort.reject_reason").isNotNull())
    return good, bad.select(*df.columns, F.col("effort.cost").alias("edit_cost"), F.col("effort.edits").alias("edits"), F.col("effort.reject_reason").alias("reject_reason"))
