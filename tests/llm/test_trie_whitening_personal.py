"""The prefix trie, whitening and personal data against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

# ---- conversation prefix trie


def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}
    made = {}
    for c in turns:
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4
        base = c - int(math.fmod(c, 20))
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {n: sum(1 for m in members if len(m) == len(n) + 1 and m[:-1] == n) for n in members}
    own = {n: (len(cs) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n, cs in members.items()}
    out = []
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(n)))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], sum(1 for m in below if not kids[m]), sum(own[m] for m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows():
    random.seed(8)
    rows = []
    for c in [*range(-25, 45), 61, 79, 1000, 1003]:
        shared = c % 3 == 0
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"hello {t}" if shared else f"hello {t} {random.choice('ab')}\x0bx") for t in range(random.randint(0, 9))]
    rows += [(5, None, None, None), (5, None, "user", "before all"), (6, 3, "user", "tie"), (6, 3, "assistant", "tie"), (6, 3, "user", "tie"), (7, 1, "", "  "), (None, 1, "user", "nobody"), (2000, 0, "u", "w " * 5000)]
    return [*rows, *[(40, t, "user", f"long {t}") for t in range(9, 60)]]


SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def trie(spark, rows):
    from larder.llm.prefixtrie import prefix_trie

    found = prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("larder.llm.prefixtrie.BLOCK", 4)
    rows = trie_rows()
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == []


def test_positions_run_on_over_partitions_that_split_a_conversation(spark):
    from larder.llm.prefixtrie import placed, turns_of

    rows = [(3, t, "user", f"turn {t}", "x", 1) for t in range(4000)] + [(c, 0, "u", "one", "x", 1) for c in range(100, 140)]
    turns = placed(turns_of(spark.createDataFrame(rows, SCHEMA)))
    found = {bytes(r["digest"]): r["pos"] for r in turns.where("conv_id = 3").collect()}
    assert [found[hashlib.sha256(f"4:userturn {t}".encode()).digest()] for t in range(4000)] == list(range(1, 4001))


def test_ends_in_chunks_hash_as_one_text():
    from larder.llm import prefixtrie as T

    ids = [*range(3 * T.CHUNK + 5)]
    batches = [pa.RecordBatch.from_pydict({"key": [b"a"] * len(part), "conv_id": part}) for part in (ids[:700], ids[700:])] + [pa.RecordBatch.from_pydict({"key": [b"b"], "conv_id": [9]})]
    chunks = list(T._chunks(iter(batches)))
    assert sum(len(b) for b in chunks) == 5 and max(len(t.split(",")) for b in chunks for t in b.column("text").to_pylist()) == T.CHUNK
    found = {k: v for b in T._hashes(iter(chunks)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert found == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"9").hexdigest()}


@pytest.mark.parametrize("depth", [1, 2, 7, 33])
def test_subtree_sums_of_chains_and_combs(spark, depth):
    from larder.llm.prefixtrie import subtree_sums

    name = lambda *x: repr(x).encode()
    nodes = [(name(0), 0, None, 1)] + [(name(d), d, name(d - 1), 1) for d in range(1, depth + 1)] + [(name(d, "leaf"), d, name(d - 1), 10) for d in range(1, depth + 1)]
    found = {bytes(r["key"]): r["v"] for r in subtree_sums(spark.createDataFrame(nodes, "key binary, depth long, parent binary, v long"), ["v"]).collect()}
    assert found == {name(d): (depth - d + 1) + 10 * (depth - d) for d in range(depth + 1)} | {name(d, "leaf"): 10 for d in range(1, depth + 1)}


# ---- whitening


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[3], (2000, None), (2001, [1.0, None, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1e300] * 6)]
    return rows + [(3000 + i, [float(i), 2.0 * i, 5.0]) for i in range(5)] + [(4000, [1.5]), (4001, [1.5])]


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    from larder.llm.whitening import whiten

    frame = spark.createDataFrame([(*r, 1, 2) for r in vectors()], "vec_id long, embedding array<double>, n int, x int")
    found = {}
    for r in whiten(frame).collect():
        found.setdefault(r["vec_id"], []).append(r)
    usable = [r for r in vectors() if r[1] and None not in r[1] and np.isfinite(r[1]).all() and max(map(abs, r[1])) < 1e15]
    assert set(found) == {i for i, _ in usable}
    for dim in (6, 3, 1):
        ids = [i for i, v in usable if len(v) == dim]
        x = {i: np.floor(np.array(v) * 64).astype(int) + 1_000_000 for i, v in usable if len(v) == dim}
        fit = np.array(sorted({tuple(v) for v in x.values()}))
        n, sums = len(fit), fit.sum(axis=0)
        off = (n * fit - sums) / n
        e, v = np.linalg.eigh(off.T @ off / n)
        e, v = e[::-1], v[:, ::-1].T
        signs = None
        for i in ids:
            rows = sorted({r["component"]: r for r in found[i]}.values(), key=lambda r: r["component"])
            assert len(found[i]) == dim * (2 if i == 3 else 1) and [r["component"] for r in rows] == [*range(1, dim + 1)] and {r["n"] for r in rows} == {n}
            assert {r["deviation"] for r in rows} == {sum(int(a) ** 2 for a in n * x[i] - sums)}
            for k, r in enumerate(rows):
                if e[k] < 1e-9 * max(e[0], 1):
                    assert r["whitened"] is None
                    continue
                assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
                want = float((n * x[i] - sums) / n @ v[k] / np.sqrt(e[k]))
                signs = signs or {}
                if abs(want) > 1e-3:
                    assert r["whitened"] * signs.setdefault((dim, k), np.sign(want * r["whitened"])) == pytest.approx(want, rel=1e-8)
    assert whiten(frame.where("vec_id < 0")).collect() == []


def test_merged_states_lose_nothing():
    from larder.llm.whitening import leaf, merge

    rng = np.random.default_rng(1)
    x = (rng.normal(size=(50, 9)) * [1, 1e3, 1e-3 * 1e5, 1, 1, 7, 1, 0, 50]).astype(int) + 1_000_000
    parts = [x[:1], x[1:4], x[4:30], x[30:]]
    a = leaf(parts[0])
    for p in parts[1:]:
        a = merge(a, leaf(p))
    off = x - x.mean(axis=0)
    assert a.n == 50 and a.sums == x.sum(axis=0).tolist()
    assert np.allclose(a.s, np.linalg.svd(off, compute_uv=False), rtol=1e-10, atol=1e-7) and len(a.s) == 9
    assert np.allclose((a.s[:, None] * a.vt).T @ (a.s[:, None] * a.vt), off.T @ off, rtol=1e-9, atol=1e-6)
    big = leaf(np.array([[2**50, 1], [2**50 + 2, 3]]))
    assert big.sums == [2**51 + 2, 4] and np.allclose(big.s, [2, 0], atol=1e-9)


def test_deviation_beyond_64_bits_in_between_is_exact():
    from larder.llm.whitening import Model, deviations

    m = Model(2**20, [2**70, 3], np.eye(2), np.ones(2), [0.5, 0.5])
    x = np.array([[2**51, 5]])
    assert deviations(x, m).tolist() == [[2**71 - 2**70, 5 * 2**20 - 3]]


# ---- personal data

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(text):
    def luhn(ds):
        return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(ds))) % 10 == 0

    digits = lambda s: "".join(c for c in s if c in "0123456789")
    spans = [(0, m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    spans += [(1, m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(2, m.start(), m.end()) for m in re.finditer(CARD, text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return spans + [(3, m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-1 59+(%_é", max_size=60) | st.lists(st.sampled_from(["a@b.c", "@d.ef", "%x@y.z-", "1.2.3.4", ".5", "256", "0004", "4111 1111 1111 1111", "-", " ", "+49 (30) 1234-567", "9", "+1", "é"]), max_size=12).map("".join))
def test_patterns_equal_the_regular_expressions(text):
    from larder.llm.personal import _CANDIDATE, base_spans

    assert base_spans(text) == brute_spans(text)
    assert not base_spans(text) or re.search(_CANDIDATE, text)


def test_patterns_take_linear_time():
    from larder.llm.personal import base_spans

    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a.b" * 100_000 + "@", "1 " * 150_000):
        base_spans(text)
    assert base_spans("x" * 200_000 + "@a.b") == [(0, 0, 200_004)]


def planted():
    """Documents in which a name stands beside one address in different contexts, among filler that holds other words."""
    random.seed(5)
    filler = [f"filler{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    some = lambda k: " ".join(random.choice(filler) for _ in range(k))
    docs = [(i, f"{some(40)} contact Zorblatt at zq@x.org about {some(40)}") for i in range(12)]
    docs += [(20 + i, f"{some(30)} write to o{i}@y.net or call +49 30 12345{i:03d} {some(30)}") for i in range(30)]
    docs += [(100 + i, f"{some(60)} contact at about") for i in range(200)]
    docs += [(400, "Zorblatt far away. " + some(20)), (401, f"ZQ@X.org {some(500)} zorblatt's and Zorblatts"), (402, None), (403, ""), (402, docs[0][1]), (404, "many 4111-1111-1111-1111 and 10.0.0.1 " * 3)]
    # Hapaxes in copies of one passage are one context.
    return docs + [(500 + i, "Quuxian met once@only.org in Wherever") for i in range(6)]


def test_terms_that_disclose_are_found_where_their_entity_is(spark):
    from larder.llm.personal import personal_report, sanitised

    docs = spark.createDataFrame([(*d, "a", "b", 3) for d in planted()], "doc_id long, text string, spans string, row string, entities int")
    rows = personal_report(docs).collect()
    assert len(rows) == len(planted()) and {type(r["n_email"]) for r in rows} == {int}
    texts = {}
    for i, t in planted():
        texts.setdefault(i, []).append(t or "")
    names = ("email", "ip", "card", "phone")
    for r in rows:
        wants = [",".join(f"{names[k]}:{s}:{e}" for k, s, e in brute_spans(t)) for t in texts[r["doc_id"]]]
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))
        assert base in wants and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        terms = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
        found = {t[s:e].lower() for t in texts[r["doc_id"]] for s, e in terms if base == ",".join(f"{names[k]}:{a}:{b}" for k, a, b in brute_spans(t))}
        held = r["doc_id"] in range(12) or r["doc_id"] == 401 or (r["doc_id"] == 402 and base)
        assert found == ({"zorblatt"} if held else set()), (r["doc_id"], found)
    clean = {}
    kept = sanitised(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        clean.setdefault(r["doc_id"], []).append(r["text"])
        assert (r["spans"], r["row"], r["entities"]) == ("a", "b", 3)
    assert all("zq@" not in t and "Zorblatt" not in t and "<EMAIL>" in t for i in range(12) for t in clean[i])
    assert clean[400] == texts[400] and clean[403] == [""] and None in clean[402] and "<CARD>" in clean[404][0] and "<IP>" in clean[404][0]


def test_generalised_to_a_stem_that_says_little(spark):
    from larder.llm.personal import sanitised

    random.seed(6)
    filler = [f"w{i}x" for i in range(90)]
    some = lambda k: " ".join(random.choice(filler) for _ in range(k))
    docs = [(i, f"{some(30)} Kindhausen {some(2)} zq@x.org {some(30)}") for i in range(8)]
    docs += [(100 + i, f"{some(20)} kindergarten {some(20)}") for i in range(300)]
    found = {r["doc_id"]: r["text"] for r in sanitised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all("Kindhausen" not in found[i] and "Kind*" in found[i] for i in range(8)) and found[100] == docs[8][1]


def test_shares_equal_brute_force(spark):
    from larder.llm.common import stored
    from larder.llm.personal import DISCLOSED, LEAST_CONTEXTS, _look, disclosing, looked

    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    found = {(r["entity"], r["term"]) for r in disclosing(docs, stored(looked(docs), "personal-test")).collect()}
    texts = [t or "" for _, t in planted()]
    looks = [_look(t) for t in texts]
    want = set()
    pairs = {(e, t) for _, _, near in looks for e, t, _ in near if not t.endswith("*")}
    words = [{w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts]
    for e, t in pairs:
        hits = [c for _, _, near in looks for a, b, c in near if (a, b) == (e, t)]
        n_e, n_t = sum(e in es for _, es, _ in looks), sum(t in w for w in words)
        share = math.log(len(texts) * len(hits) / (n_t * n_e)) / math.log(len(texts) / n_e)
        if len(set(hits)) >= LEAST_CONTEXTS and share > DISCLOSED:
            want.add((e, t))
    assert found == want and want


def test_personal_of_an_empty_table(spark):
    from larder.llm.personal import personal_report, sanitised

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert personal_report(docs).collect() == [] and sanitised(docs).collect() == []
