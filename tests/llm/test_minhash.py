from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from larder.llm import minhash
from larder.llm.components import connected_components, union_find


def brute(rows, percent=85):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union_find(edges)
    return {i: (len(s), comp.get(i, i), comp.get(i, i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(docs, corpus):
    assert result(minhash.near_duplicates(docs)) == brute([(r[0], r[1]) for r in corpus])


def test_family_of_near_copies_in_blocks(spark, monkeypatch):
    """Copies that are near their base but not near each other, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    random.seed(5)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(140)] = f"e{random.randint(0, 9)}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(df)) == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_densification_keeps_filled_slots_and_fills_the_rest():
    slots, filled = np.arange(512, dtype=np.uint64).reshape(2, 256), np.zeros((2, 256), bool)
    filled[0, 7] = True
    got = minhash.densified(slots, filled)
    assert set(got[0]) == {7}
    assert (got[1] == slots[1]).all()


@pytest.mark.parametrize("local", [True, False])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("larder.llm.components.LOCAL_EDGES", 10**6 if local else 0)
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (None, 4), (2, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
