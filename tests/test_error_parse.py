import csv
import io
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from tidelog.operators.error_parse import LineParser, cheapest_parse, parse_effort_lines, split_effort_lines

GOOD = "2023-03-14,38.6,159.2,286005462,5.3381,0.0,daily.csv,zip"


def legal(line: str, columns: int) -> list[str] | None:
    """A sound line by the rule, read with Python's csv reader; None if it is not sound."""
    text, fields, i = line, [], 0
    while True:
        if text[i : i + 1] == '"':
            end = i + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    return None
                if text[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                break
            fields.append(next(csv.reader(io.StringIO(text[i : end + 1] + "\n")))[0] if "\n" not in text else None)
            i = end + 1
        else:
            end = text.find(",", i)
            end = len(text) if end < 0 else end
            if '"' in text[i:end]:
                return None
            fields.append(text[i:end])
            i = end
        if i == len(text):
            return fields if len(fields) == columns else None
        if text[i] != ",":
            return None
        i += 1


@given(st.text(alphabet='ab,"', max_size=14))
@settings(max_examples=400, deadline=None)
def test_zero_cost_means_sound(line):
    values, cost, edits = LineParser(3).read(line)
    expected = legal(line, 3)
    assert (cost == 0) == (expected is not None)
    assert (edits is None) == (cost == 0)
    if expected is not None:
        assert values == expected


def edits_away(signature: str) -> set[str]:
    out = set()
    for i in range(len(signature) + 1):
        out.update(signature[:i] + c + signature[i:] for c in ',"')
        if i < len(signature) and signature[i] in ',"':
            out.add(signature[:i] + signature[i + 1 :])
    return out


def test_cost_is_the_least_number_of_edits():
    """Against a search through all edited lines, on every signature of up to five symbols."""
    for n in range(6):
        for symbols in product('x,"', repeat=n):
            line = "".join(symbols)
            if "xx" in line:
                continue
            near, cost = {line}, 0
            while not any(legal(x, 2) is not None for x in near):
                near, cost = set().union(*map(edits_away, near)), cost + 1
            assert cheapest_parse(line, 2)[0] == cost, line


def test_reasons(spark):
    lines = {
        1: GOOD, 2: GOOD + "\r", 3: GOOD.replace("286005462", '" 286005462 "'), 4: GOOD.replace("daily.csv", '"a ""b"", c.csv"'), 5: GOOD.replace("0.0", ""), 6: GOOD.replace("5.3381", "1.0e-3"),
        11: None, 12: "", 13: GOOD + ",x", 14: GOOD.replace("daily.csv", '"daily.csv'), 15: GOOD.replace("2023-03-14", "2023-02-30"), 16: GOOD.replace("38.6", "inf"), 17: GOOD.replace("159.2", "385.1"), 18: GOOD.replace("286005462", "-286005462"),
        19: GOOD.replace("5.3381", "1e999"), 20: GOOD.replace("0.0", "two"), 21: GOOD.replace("daily.csv", "null"), 22: GOOD.replace("zip", "tar"), 23: GOOD.replace(",", ";"), 24: GOOD.replace("286005462", ' "286005462"'), 25: "x" * 200_000, 26: ',"' * 3_000,
    }
    df = spark.createDataFrame([(k, v, "kept") for k, v in lines.items()], "raw_id long, line string, cost string")
    rows = {r["raw_id"]: r for r in parse_effort_lines(df).collect()}
    assert [k for k, r in rows.items() if r["effort"]["reject_reason"] is None] == [1, 2, 3, 4, 5, 6]
    reason = {k: r["effort"]["reject_reason"] for k, r in rows.items()}
    assert reason[11] == "null_line" and reason[12] == "structure: insert_delimiter x7" and reason[13] == "structure: delete_delimiter x1"
    assert "quote" in reason[14] and reason[15] == "invalid_value: date" and reason[16] == "invalid_value: cell_ll_lat" and reason[17] == "invalid_value: cell_ll_lon"
    assert reason[18] == "invalid_value: mmsi" and reason[19] == "invalid_value: hours" and reason[20] == "invalid_value: fishing_hours" and reason[21] == "invalid_value: source_file" and reason[22] == "invalid_value: source_format"
    assert rows[4]["effort"]["source_file"] == 'a "b", c.csv' and rows[3]["effort"]["mmsi"] == "286005462" and rows[5]["effort"]["fishing_hours"] is None
    assert rows[1]["cost"] == "kept"


def test_split_keeps_all_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, GOOD, "a"), (1, GOOD, "a"), (2, "bad", "b")], "raw_id long, line string, mmsi string")
    good, bad = split_effort_lines(df)
    assert good.count() == 2 and bad.count() == 1 and good.first()["mmsi"] == "286005462"
    good, bad = split_effort_lines(df.limit(0))
    assert good.count() == 0 and bad.count() == 0


def test_a_long_line_of_garbage(spark):
    """Its way back takes 64 bytes a symbol."""
    import tracemalloc

    tracemalloc.start()
    cost, edits, values = cheapest_parse('"' * 20_000 + ",x" * 50, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cost > 0 and len(values) == 8 and peak < 20_000_000
