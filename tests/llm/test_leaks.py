import random
import time

import numpy as np
from tidelog.llm.leaks import Running, leaks, tiles, words
from tidelog.llm.markup import plain


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def plain_tiles(a, b, least):
    """Every pair of starts, extended word by word; the longest are marked in order, again and again."""
    out, ma, mb = [], [False] * len(a), [False] * len(b)
    while True:
        found, most = [], least
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != 0 and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > most:
                    most, found = n, []
                if n == most:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(ma[i : i + most]) and not any(mb[j : j + most]):
                out.append((i, j, most))
                ma[i : i + most] = mb[j : j + most] = [True] * most


def test_tiles_are_greedy():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 8])
        a, b = ([rng.randint(0 if rng.random() < 0.1 else 1, k) for _ in range(rng.randint(0, 24))] for _ in range(2))
        if rng.random() < 0.5 and len(a) > 8:
            b[2:2] = a[3:9]
        assert tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3) == plain_tiles(a, b, 3)
    assert sorted(tiles(np.arange(1, 21, dtype=np.uint64), np.array([*range(11, 21), *range(1, 11)], np.uint64), 3)) == [(0, 10, 10), (10, 0, 10)]


def test_running_hashes_are_of_the_words_only():
    x = np.array([5, 6, 7, 0, 5, 6, 7, 8, 5, 6, 7], np.uint64)
    h, at = Running(x).windows(3)
    assert at.tolist() == [0, 4, 5, 6, 7, 8] and h[0] == h[1] == h[5] and len(set(h.tolist())) == 4
    assert h[0] == Running(x[4:7]).windows(3)[0][0] != Running(x[4:7]).windows(2)[0][0]


def test_repetitive_texts_take_no_longer():
    began = time.time()
    one = np.full(5_000, 7, np.uint64)
    two = np.tile(np.array([3, 4], np.uint64), 2_500)
    assert tiles(one, one[:800], 5)[0] == (0, 0, 800)
    assert tiles(two, np.concatenate([two[:400], np.array([9], np.uint64), two[:399]]), 5)[0][2] == 400
    assert time.time() - began < 2


def test_found_means_twelve_words_in_a_row(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(30)) for i in range(20)}
    docs = {}
    for n in range(300):
        doc = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        w = items[rng.randint(0, 19)].split()
        at = rng.randint(0, 17)
        doc[5:5] = w[at : at + rng.randint(9, 14)]
        docs[n] = " ".join(doc)
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string")).collect()}
    want = {}
    for d, text in docs.items():
        for i, t in items.items():
            found = plain_tiles([hash(w) for w in text.split()], [hash(w) for w in t.split()], 5)
            if (most := max((n for *_, n in found), default=0)) >= 12 or sum(n for *_, n in found) >= 24:
                want[d, i] = most, sum(n for *_, n in found) / 30, len(found)
    assert {k: (r["longest"], r["coverage"], r["tiles"]) for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["longest"] >= 12} == {(d, i) for d, text in docs.items() for i, t in items.items() if longest(text.split(), t.split()) >= 12}
    assert sum(r["longest"] >= 12 for r in got.values()) > 50


def test_reordered_passages(spark):
    w = [f"word{i}" for i in range(44)]
    moved = [w[33:], w[:11], w[22:33], w[11:22]]
    half = [w[:11], ["x"], w[20:30]]  # 21 of 44 words
    docs = spark.createDataFrame([(k, " ".join(x for p in parts for x in p)) for k, parts in enumerate((moved, half, moved[:1], [w[::-1]]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["longest"], r["coverage"], r["tiles"]) for r in leaks(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")).collect()}
    assert got == {0: (11, 1.0, 4)}
    got = {r["doc_id"] for r in leaks(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"), covered=0.45).collect()}
    assert got == {0, 1}


ITEM = "If the Gwi pump drains 509 barrels of brine before Obra shuts its valve how many"


def test_markup_does_not_count(spark):
    forms = {
        1: ITEM.upper(), 2: "'''If''' the [[Gwi]] pump [[Page 3|drains]] 509<br/>barrels&nbsp;of<!-- If x -->brine be<b>fore</b> Obra, shuts\nits; valve, how many?", 3: "| If the Gwi || pump drains 509\n|-\n| barrels of brine || before Obra shuts\n| its valve", 4: "{{quote|If the Gwi pump drains 509 barrels of brine before Obra shuts}}",
        5: " ".join(ITEM.split()[:7]), 6: " ".join(reversed(ITEM.split())), 7: None, 8: "", 9: "Ｉｆ the Gwi​ pump drains 509 barrels of brine before Obra shuts", 10: "x " * 300_000 + ITEM, 11: '{{q\n|text="If the Gwi pump drains 509 barrels of brine before Obra shuts"\n}}', 12: '{|\n|-\n| style="x" | If the Gwi pump drains 509 || class="y z" | barrels of brine before Obra shuts\n|}',
    }
    docs = spark.createDataFrame([(k, v, 0) for k, v in forms.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, ""), (8, "short", ""), (9, None, ""), (10, ITEM, "")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(docs, items).select("doc_id", "item_id").collect())
    assert got == sorted((d, i) for d in (1, 2, 3, 4, 9, 10, 11, 12) for i in (7, 10))
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_words():
    assert words(plain("A [http://x.y shown] &amp; '''B'''_c <ref name=\"z\" /> d1")) == ["a", "shown", "b", "c", "d1"]
