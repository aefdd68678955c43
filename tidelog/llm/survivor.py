"""The best value of each field of a group of duplicate records, by currency reasoning.

Records with a timestamp tell in which order values follow each other. From their transitions, precedences are learned: of
numbers whether they only grow or only shrink, of words which one comes before which. They order the records of a group in
part: of two dated records the later one comes after; otherwise one comes after the other if some learned precedence says
so and none says the contrary. Words are ordered along learned transitions and chains of them only, never across chains.

The value of a topologically latest record that has the field survives. Where several are latest, a stated rule decides:
a dated record before an undated one that does not come after it; of undated ones that with the greater signals, the most
reliable signal first, then the word with the longest chain before it; then the smallest row id.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tidelog.functions.values import VALUE_RULES, plain_text, vessel_of
from tidelog.session import cut

FIELDS = ["registries_listed", "fishing_hours", "flag_gfw", "length_m_gfw"]
#: A precedence needs this many transitions, this part of its field's transitions, and this part in its favour.
LEAST, LEAST_PART, AGREED = 20, 0.001, 0.95
FIRST_DAY = "0001-01-01"


def count_codes(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\|"), lambda x: F.trim(x) != ""))


def _normal(df: DataFrame, group: dict[str, Column], row_id: str, known_on: str) -> DataFrame:
    """Group columns, id, known_on, the value of each field (null: missing), and a signal per field."""
    values = {f: VALUE_RULES[f](F.col(f)) for f in FIELDS}
    signals = {"registries_listed": count_codes(values["registries_listed"]).cast("double"), "fishing_hours": values["fishing_hours"].cast("double"), "length_m_gfw": values["length_m_gfw"].cast("double")}
    out = df.select(*(c.alias(n) for n, c in group.items()), F.col(row_id).alias("_id"), F.col(known_on).cast("date").alias("_at"), *(v.alias(f"v_{f}") for f, v in values.items()), *(F.when(values[f].isNotNull(), s).alias(f"s_{f}") for f, s in signals.items()), plain_text(F.col("flag_gfw")).alias("w_flag_gfw"))
    for n in group:
        out = out.where(F.col(n).isNotNull())
    return out.where(F.col("_id").isNotNull())


def learn(rows: DataFrame, keys: list[str]) -> tuple[list[tuple[str, float]], list[tuple[str, str]]]:
    """([(signal, direction)], most reliable first; [(word, word that follows it)] of the flag).

    Records of a group and day are reduced to one first, so no window holds more rows than there are days. What comes to
    the driver is three counts and at most 1 / LEAST_PART pairs of words."""
    numbers = [c for c in rows.columns if c.startswith("s_")]
    daily = rows.where(F.col("_at").isNotNull()).groupBy(*keys, "_at").agg(*(F.max_by(c, -F.col("_id")).alias(c) for c in (*numbers, "w_flag_gfw")))
    order = Window.partitionBy(*keys).orderBy("_at")
    steps = daily.select(*numbers, "w_flag_gfw", *(F.lag(c).over(order).alias(f"was_{c}") for c in (*numbers, "w_flag_gfw")))
    counts = steps.agg(*(F.count_if(F.col(c) > F.col(f"was_{c}")).alias(f"up_{c}") for c in numbers), *(F.count_if(F.col(c) < F.col(f"was_{c}")).alias(f"down_{c}") for c in numbers)).first()
    found = []
    for c in numbers:
        up, down = counts[f"up_{c}"], counts[f"down_{c}"]
        if up + down >= LEAST and max(up, down) >= AGREED * (up + down):
            found.append((max(up, down) / (up + down), c, 1.0 if up > down else -1.0))
    words = steps.where(F.col("w_flag_gfw") != F.col("was_w_flag_gfw")).groupBy(F.col("was_w_flag_gfw").alias("a"), F.col("w_flag_gfw").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, LEAST_PART * total)
    seen = {(r["a"], r["b"]): r["n"] for r in words.where(F.col("n") >= least).collect()}  # at most 1 / LEAST_PART rows
    edges = [(a, b) for (a, b), n in seen.items() if n >= AGREED * (n + seen.get((b, a), 0))]
    return [(c, sign) for _, c, sign in sorted(found, key=lambda x: (-x[0], x[1]))], edges


def depths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """The length of the longest chain before each word; words on a cycle are left out, as nothing is known of their order."""
    after, waits = defaultdict(list), defaultdict(int)
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    depth = {a: 0 for a in after if not waits[a]}
    todo = list(depth)
    while todo:
        a = todo.pop()
        for b in after[a]:
            depth[b] = max(depth.get(b, 0), depth[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                todo.append(b)
    return {w: n for w, n in depth.items() if not waits[w]}


def chains(edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """(a, b) where b can be reached from a along edges, but a not from b: the order of the words, in part."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    reach = set()
    for a in list(after):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach.update((a, b) for b in seen)
    return {(a, b) for a, b in reach if (b, a) not in reach}


def survivors(df: DataFrame, row_id: str = "vessel_row_id", known_on: str = "known_on", fewest: int = 2) -> DataFrame:
    """mmsi, year, field, vessel_row_id (the row whose value survives) and value (text) for each vessel and year with at least `fewest` rows.

    Fields that are missing in the whole group give no row. Rows without a readable vessel or a year are in no group. All
    aggregates combine map-side, so a group of any size and its copies cost no more than others; undated records are
    compared with the latest dated one of their group, never with each other one by one. Other columns are not read."""
    group = {"mmsi": vessel_of(F.col("mmsi")), "year": F.col("year").cast("int")}
    rows = cut(_normal(df, group, row_id, known_on))
    signals, edges = learn(rows, list(group))
    long = _latest(rows, list(group), fewest)
    if rows.where(F.col("_at").isNull()).limit(1).count():
        later = _undated(rows, long, list(group), signals, edges)
        long = long.join(later, [*group, "field"], "left").select(*group, "field", F.coalesce("u", "d").alias("d"))
    long = long.where(F.col("d").isNotNull())
    return long.select(*group, "field", (-F.col("d.neg")).alias(row_id), F.col("d.value").alias("value"))


def _signs(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(("s_", "w_"))]


def _latest(rows: DataFrame, keys: list[str], fewest: int) -> DataFrame:
    """keys, field, d: of the latest dated record that has the field, minus its id, the value and its signals; null if there is none. Every group of at least `fewest` records has a row per field."""
    own = F.struct(*_signs(rows.columns))
    has = lambda f: F.col(f"v_{f}").isNotNull() & F.col("_at").isNotNull()
    latest = [F.max(F.when(has(f), F.struct("_at", (-F.col("_id")).alias("neg"), F.col(f"v_{f}").cast("string").alias("value"), own.alias("sign")))).alias(f) for f in FIELDS]
    best = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *latest).where(F.col("_n") >= fewest)
    pick = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col(f)["neg"].alias("neg"), F.col(f)["value"].alias("value"), F.col(f)["sign"].alias("sign")))
    return best.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), pick(f).alias("d")) for f in FIELDS))).alias("x")).select(*keys, "x.*")


def _undated(rows: DataFrame, long: DataFrame, keys: list[str], signals: list[tuple[str, float]], edges: list[tuple[str, str]]) -> DataFrame:
    """keys, field, u (as d): of the undated records that come after the latest dated one, or where none is dated, the one that the rule prefers."""
    own = F.struct(*_signs(rows.columns)).alias("sign")
    each = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").cast("string").alias("value")) for f in FIELDS)), lambda x: x["value"].isNotNull())
    records = rows.where(F.col("_at").isNull()).select(*keys, (-F.col("_id")).alias("neg"), own, F.explode(each).alias("x")).select(*keys, "neg", "sign", "x.*")
    both = records.join(long, [*keys, "field"])
    spark = rows.sparkSession
    pairs = F.broadcast(spark.createDataFrame(sorted(chains(edges)), "_a string, _b string"))  # at most (2 / LEAST_PART)^2 rows
    was, now = F.col("d.sign.w_flag_gfw"), F.col("sign.w_flag_gfw")
    both = both.withColumns({"_was": was, "_now": now})
    both = both.join(pairs.select(F.col("_a").alias("_was"), F.col("_b").alias("_now"), F.lit(True).alias("_up")), ["_was", "_now"], "left")
    both = both.join(pairs.select(F.col("_b").alias("_was"), F.col("_a").alias("_now"), F.lit(True).alias("_down")), ["_was", "_now"], "left")
    up, down = F.coalesce("_up", F.lit(False)), F.coalesce("_down", F.lit(False))
    sure = lambda x: F.coalesce(x, F.lit(False))
    for c, sign in signals:
        step = (F.col("sign")[c] - F.col("d.sign")[c]) * F.lit(sign)
        up, down = up | sure(step > 0), down | sure(step < 0)
    after = both.where(F.col("d").isNull() | (up & ~down))
    depth = depths(edges)
    deep = spark.createDataFrame(sorted(depth.items()), "_now string, _depth int")
    after = after.join(F.broadcast(deep), "_now", "left")
    rule = F.struct(*((F.col("sign")[c] * F.lit(sign)).alias(f"p{i}") for i, (c, sign) in enumerate(signals)), F.col("_depth"), F.col("neg"), F.col("value"), F.col("sign"))
    best = after.groupBy(*keys, "field").agg(F.max(rule).alias("r"))
    return best.select(*keys, "field", F.struct(F.col("r.neg").alias("neg"), F.col("r.value").alias("value"), F.col("r.sign").alias("sign")).alias("u"))


def records(df: DataFrame, row_id: str = "vessel_row_id") -> DataFrame:
    """One record per vessel and year, single rows included: each field, numbers as numbers, and the row it comes from."""
    s = survivors(df, row_id, fewest=1)
    kinds = {f: "double" if f in ("fishing_hours", "length_m_gfw") else "string" for f in FIELDS}
    return s.groupBy("mmsi", "year").agg(*(x for f in FIELDS for x in (F.max(F.when(F.col("field") == f, F.col("value"))).cast(kinds[f]).alias(f), F.max(F.when(F.col("field") == f, F.col(row_id))).alias(f"{f}_row"))))


def agreement(df: DataFrame, hidden: Column, row_id: str = "vessel_row_id") -> DataFrame:
    """field, groups, agreed, agreed_without: of the groups of dated records that have a hidden date, in how many the survivor is the one that the dates give, by this operator and by leaving out the hidden records."""
    keys = ["mmsi", "year", "field"]
    truth = survivors(df, row_id)
    found = survivors(df.withColumn("known_on", F.when(~hidden, F.col("known_on"))), row_id).select(*keys, F.col(row_id).alias("_found"))
    less = survivors(df.where(~hidden), row_id, fewest=1).select(*keys, F.col(row_id).alias("_less"))
    touched = df.where(hidden & F.col("known_on").isNotNull()).select(vessel_of(F.col("mmsi")).alias("mmsi"), F.col("year").cast("int").alias("year")).where(F.col("mmsi").isNotNull()).distinct()
    both = truth.join(touched, ["mmsi", "year"], "left_semi").join(found, keys, "left").join(less, keys, "left")
    same = lambda c: F.count_if(F.col(c) == F.col(row_id))
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("groups"), same("_found").alias("agreed"), same("_less").alias("agreed_without"))
