from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadframe.llm import leakage, nearest


def _brute(left, right, tol, mutual):
    def best(x, others):
        c = [(abs(o[1] - x[1]), o[1], o[2]) for o in others if o[0] == x[0]]
        return min(c) if c else None

    out = set()
    for a in left:
        b = best(a, right)
        if b and b[0] <= tol:
            row = next(o for o in right if o[0] == a[0] and o[1] == b[1] and o[2] == b[2])
            if not mutual or best(row, left)[1:] == (a[1], a[2]):
                out.add((a[0], a[2], b[2], b[0]))
    return out


@pytest.mark.parametrize("width", [10, 37, 10_000])
@pytest.mark.parametrize("mutual", [True, False])
def test_pairs(spark, width, mutual):
    r = random.Random(4)
    make = lambda base: [(r.choice(["hot", "hot", "a", "b"]), r.randrange(0, 600), base + i) for i in range(120)]
    left, right = make(0), make(1000)
    schema = "entity string, pos int, id bigint"
    more = [(None, 5, 1), ("hot", None, 2), ("only", 3, 3)]
    frames = [spark.createDataFrame([(*x, "spare", 9.0) for x in rows + rows[:9] + more], schema + ", range string, f double") for rows in (left, right)]
    out = nearest.match_nearest(*frames, "entity", "pos", "id", F.col("f"), F.lit(width), mutual)
    got = {tuple(x) for x in out.collect() if x["entity"] != "only"}
    assert got == _brute(left, right, 9, mutual)
    assert nearest.match_nearest(frames[0].limit(0), frames[1], "entity", "pos", "id", F.col("f"), F.lit(width)).count() == 0


def test_ties_take_the_smaller():
    assert nearest.nearest(np.array([5, 4, 9]), np.array([3, 3, 7, 7])).tolist() == [0, 0, 2]
    assert nearest.nearest(np.array([5]), np.array([], int)).tolist() == [-1]


ITEM = "The narrow spindle gripped and soaked 38 times between two very noisy flights while nobody was watching closely"
ITEM_DE = "Ein fröhlicher Wecker verbog große Straßen langsam 83 Tage neben dem alten Schuppen und das sperrige Zelt"


def _shared(text, item, n=13):
    a, b = ([w for w, _, _ in leakage.words(x)] for x in (text, item))
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


@pytest.mark.parametrize("bound", [10**9, 0])
def test_leaks_by_broadcast_and_by_join(spark, bound):
    w = ITEM.split()
    docs = {
        1: "before " + ITEM + " after", 2: ITEM.upper(), 3: " -- ".join(w[2:15]), 4: " ".join(w[2:14]), 5: "x " + " ".join(w[:7]) + " other " + " ".join(w[7:]), 6: None, 7: "", 8: ITEM_DE.upper(),
        9: "und " + ITEM_DE.replace("ö", "ö"), 10: "word " * 60_000 + ITEM, 11: ITEM, 12: ITEM,
    }
    items = [(1, ITEM), (2, ITEM_DE), (3, "too short to be found"), (4, None), (1, ITEM)]
    d = spark.createDataFrame([(i, t, "item") for i, t in docs.items()], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame(items, "item_id int, text string")
    spans = leakage.leaked_spans(d, q, broadcast_bytes=bound)
    got = {(r["doc_id"], r["item_id"]) for r in spans.collect()}
    assert got == {(i, k) for i, t in docs.items() for k, x in items if _shared(t, x)} and {g[0] for g in got} == {1, 2, 3, 8, 9, 10, 11, 12}
    first = spans.filter("doc_id = 1").first()
    assert docs[1][first["from_char"] : first["to_char"]] == ITEM and first["n_words"] == len(w)
    clean = {r["doc_id"]: r for r in leakage.without_leaks(d, spans).collect()}
    assert len(clean) == len(docs) and clean[4]["clean_text"] == docs[4] and clean[11]["dropped"] and clean[10]["clean_text"].endswith("word [removed]") and clean[6]["clean_text"] is None
    assert leakage.leaked_spans(d.limit(0), q, broadcast_bytes=bound).count() == 0 and leakage.leaked_spans(d, q.limit(0), broadcast_bytes=bound).count() == 0


def test_hash_collisions_are_not_leaks():
    p = leakage.Passages([(1, ITEM)], 13)
    other = [f"w{i}" for i in range(20)]
    p.hashes = np.sort(leakage.window_hashes(other, 13))  # as if every hash collided
    p.item, p.first = (np.zeros(len(p.hashes), np.int32) for _ in range(2))
    assert p.hits(other) == []


def test_few_windows_pass_the_bitmap(spark):
    """A bitmap of 16 bits an n-gram holds all of the items' hashes and few others."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(40))) for i in range(30)], "id bigint, text string")
    raw, size = leakage._bitmap(items, 13)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    for r in items.collect():
        h = leakage.window_hashes([w for w, _, _ in leakage.words(r["text"])], 13)
        assert bits[(h >> np.uint64(64 - size)).astype(np.int64)].all()
    other = leakage.window_hashes([f"x{k}" for k in range(5000)], 13)
    assert bits[(other >> np.uint64(64 - size)).astype(np.int64)].mean() < 0.1


def test_random_texts_against_brute_force():
    r = random.Random(9)
    vocabulary = ["a", "b", "C", "ß", "é", "9"]
    items = [(i, " ".join(r.choices(vocabulary, k=12))) for i in range(5)]
    p = leakage.Passages(items, 4)
    for _ in range(50):
        text = " , ".join(r.choices(vocabulary, k=30))
        hit = {i for i, _ in p.hits([w for w, _, _ in leakage.words(text)])}
        assert hit == {i for i, t in items if _shared(text, t, 4)}
