from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import annsearch, embdedup, mixing
from larder.llm.components import union_find

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.RandomState(2)
    centre = r.randn(12, 16)
    x = np.concatenate([centre[r.randint(0, 12, 300)] + 0.25 * r.randn(300, 16), r.randn(200, 16)]).astype(np.float32)
    rows = [(i, v.tolist(), 1, 7) for i, v in enumerate(x)]
    rows += [(600 + i, rows[5][1], 1, 7) for i in range(30)]
    return rows + [(700, None, 1, 7), (701, [0.0] * 16, 1, 7), (702, [float("nan")] * 16, 1, 7), (703, [None] * 16, 1, 7), (704, [], 1, 7), (705, [1.0], 1, 7)]


def test_embedding_links(spark, vectors):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.embedding_duplicates(spark.createDataFrame(vectors, SCHEMA)).collect()}
    good = [(i, np.array(v, float)) for i, v, *_ in vectors[:-6]]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    comp = union_find((ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True))
    want = {i: (int(n), comp.get(i, i), comp.get(i, i) == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}
    assert got == want | {i: (0, i, True) for i in range(700, 706)}


def brute_links(x, threshold=0.9):
    u = embdedup.unit(np.array(x, np.float64))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = union_find(zip(*(v.tolist() for v in np.nonzero(near)), strict=True))
    return {i: (int(n), comp.get(i, i)) for i, n in enumerate(near.sum(axis=1))}


def turned(r, n, d):
    """Vectors at cosines about the threshold to 100 others."""
    q = embdedup.unit(r.randn(100, d))[r.randint(0, 100, n)]
    t = r.randn(n, d)
    t = embdedup.unit(t - (t * q).sum(axis=1, keepdims=True) * q)
    c = r.uniform(0.86, 0.98, n)[:, None]
    return c * q + np.sqrt(1 - c * c) * t


@pytest.mark.parametrize("kind", ["clusters", "turned", "line"])
def test_embedding_links_in_parts_as_brute_force(spark, monkeypatch, kind):
    """Several parts and tasks for each, several vectors a query visits; links counted from both sides."""
    monkeypatch.setattr(embdedup, "PART_ROWS", 100)
    monkeypatch.setattr(embdedup, "TASK_QUERIES", 300)
    r = np.random.RandomState(8)
    x = {"clusters": lambda: r.randn(25, 24)[r.randint(0, 25, 900)] + 0.3 * r.randn(900, 24), "turned": lambda: turned(r, 900, 24), "line": lambda: r.randn(300, 1)}[kind]().astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.embedding_duplicates(df).collect()} == brute_links(x)


def test_embedding_walk_prunes_and_grows_slower_than_the_vectors(spark):
    """A query visits a small part of the cells, and a lesser part of more vectors."""
    r, share = np.random.RandomState(9), []
    for n in (1000, 8000):
        df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(r.randn(n, 24).astype(np.float32))], "vec_id long, n long, embedding array<float>")
        grid, _ = embdedup.index(df, 0.9)
        share.append(grid.visits / grid.cells)
    assert share[1] < share[0] < 0.3


def test_embedding_repeated_ids_and_lengths(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0]
    rows = [(1, a), (1, a), (2, a), (3, b), (4, b), (5, a), (5, [9.0, 9.0, 9.0]), (None, a), (6, None), (7, [1e200, 0.0, 0.0]), (8, [3e-300, 0.0, 0.0])]
    got = [tuple(r) for r in embdedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(g for g in got if g[0]) == [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 4, 1, False), (5, 4, 1, False), (6, 0, 6, True), (7, 4, 1, False), (8, 4, 1, False)]
    assert (None, 0, None, True) in got


def near_sets():
    r = np.random.RandomState(1)
    clusters = lambda k, s: r.randn(k, 32)[r.randint(0, k, 1200)] + s * r.randn(1200, 32)
    return {
        "20 unit clusters": embdedup.unit(clusters(20, 0.1)),
        "40 raw clusters": clusters(40, 0.3),
        "raw Gaussian": r.randn(1200, 32),
        "varied norms": embdedup.unit(r.randn(1200, 32)) * np.exp(2 * r.randn(1200, 1)),
        "two far clusters": np.concatenate([r.randn(15, 8) + 100, r.randn(15, 8) - 100]),
        "two far and larger": np.concatenate([r.randn(400, 8) + 100, r.randn(400, 8) - 100]),
        "huge": 1e100 * r.randn(300, 8),
    }


@pytest.mark.parametrize("name", list(near_sets()))
def test_search_recall_however_vectors_lie(name):
    x = near_sets()[name]
    q = np.arange(0, len(x), 10)
    with np.errstate(over="ignore"):
        scores = (x[q] / np.abs(x).max()) @ (x / np.abs(x).max()).T
    scores[np.arange(len(q)), q] = -np.inf
    asked, found, _ = annsearch.Shard(np.arange(len(x)), x, 20).nearest(q, x[q], annsearch.BEAM)
    k = min(20, len(x) - 1)
    hit = sum(len(set(found[asked == i]) & set(np.argsort(-s, kind="stable")[:k])) for i, s in zip(q, scores, strict=True))
    assert hit >= 0.95 * k * len(q)


def test_every_node_is_reached(monkeypatch):
    monkeypatch.setattr(annsearch, "FAR_ENTRIES", 1)
    x = np.concatenate([np.random.RandomState(1).randn(200, 4) + 1000 * i for i in range(5)])
    found, _ = annsearch.Graph(x, degree=4).search(x[:3], len(x))
    assert [sorted(f) for f in found] == [list(range(1000))] * 3


def test_search_repeated_ids_and_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [1.0, 5.0]), (40, [1.0]), (2, [4.0]), (None, [1.0, 1.0]), (60, None)]
    got = annsearch.nearest(spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, size int, shard int"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 1, 1.0), (40, 1, 2, 4.0)]


def test_embedding_empty(spark):
    assert embdedup.embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert annsearch.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours(spark, vectors):
    got = annsearch.nearest(spark.createDataFrame(vectors, SCHEMA), F.col("vec_id") % 20 == 0, shard_rows=200).orderBy("query_id", "rank").collect()
    good = {i: np.array(v, float) for i, v, *_ in vectors[:-6]}
    found = total = 0
    for q in (i for i in good if i % 20 == 0):
        mine = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        want = sorted(((-(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        assert all(abs(good[q] @ good[i] - s) < 1e-9 for i, s in mine)
        found, total = found + len({i for i, _ in mine} & {i for _, i in want}), total + 20
    assert found / total >= 0.95


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = annsearch.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 0.0)]


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.RandomState(4)
    words = [f"w{i}" for i in range(60)]
    marks = {"good": ["alpha", "beta"], "poor": ["junk", "mess"], "toxic": ["vile", "nasty"]}
    rows = []
    for i in range(300):
        kind = ("good", "good", "poor", "toxic")[i % 4]
        rows.append((i, " ".join([*r.choice(words, r.randint(5, 60)), *r.choice(marks[kind], 3)]), "en", "s", 0, kind))
    docs = spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(x[0], int(x[5] != "poor"), int(x[5] == "toxic")) for x in rows if x[0] % 3], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_mixing_meets_targets_and_brute_force(labelled, monkeypatch):
    rows, docs, labels = labelled
    monkeypatch.setattr(mixing, "MOST_DOCUMENTS", 0.9)
    weights = {"good": 0.7, "poor": 0.3}
    got = mixing.mixing_rates(docs, mixing.label_domains(labels), weights).toPandas()
    assert (got.n_tokens == [len(x[1].split()) for x in rows]).all() or dict(zip(got.doc_id, got.n_tokens, strict=True)) == {x[0]: len(x[1].split()) for x in rows}
    p, n = got[["p_good", "p_poor", "p_toxic"]].to_numpy(), got.n_tokens.to_numpy()
    assert abs(p.sum(axis=1) - 1).max() < 1e-6
    share, t, rate = p * n[:, None] / n.sum(), np.array([0.7, 0.3, 0.0]), np.ones(len(n))
    present = share.sum(axis=0)
    for weight in mixing.PULLS:  # plain projected gradient on all rates, one by one, until nothing moves
        ridge = weight * present
        step = 1 / (1 + np.abs((p / ridge) @ share.T).sum(axis=1).max())
        for _ in range(200_000):
            new = np.maximum(0, rate - step * (rate - 1 + p @ ((rate @ share - t) / ridge)))
            moved, rate = abs(new - rate).max(), new
            if moved < 1e-9:
                break
        if (abs(rate @ share - t) <= mixing.MISS * present).all():
            break
    assert abs(rate - got.rate).max() < 1e-2
    assert (abs((got.rate.to_numpy() @ share) - t) <= 1.05 * mixing.MISS * present).all()


def test_mixed_drops_toxic_and_keeps_columns(labelled, monkeypatch):
    rows, docs, labels = labelled
    monkeypatch.setattr(mixing, "MOST_DOCUMENTS", 0.9)
    out = mixing.mixed(docs, mixing.label_domains(labels))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {x[0] for x in rows if x[5] != "toxic"}


def test_common_markers_survive_the_production_values(labelled):
    """Each marker word is in about a fifth or more of the labelled rows."""
    rows, docs, labels = labelled
    names, vocabulary, _, _ = mixing.fit(docs, mixing.label_domains(labels))
    assert {"alpha", "beta", "junk", "mess", "vile", "nasty"} <= set(vocabulary)
    got = mixing.score_documents(docs, mixing.fit(docs, mixing.label_domains(labels))).collect()
    assert all(max(names, key=lambda n: r[f"p{names.index(n)}"]) == rows[r["doc_id"]][5] for r in got)


@pytest.fixture(scope="module")
def scored(spark):
    """Posteriors with 0.5 % of the tokens surely toxic and 2 % surely poor."""
    rows = [(i, 100, *((0.0, 0.0, 1.0) if i % 200 == 0 else (0.0, 1.0, 0.0) if i % 50 == 1 else (1.0, 0.0, 0.0))) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")


def test_rates_meet_targets_of_small_domains(scored):
    got = scored.select("doc_id", mixing.fit_rates(scored, None, [0.9, 0.1, 0.0]).alias("r")).toPandas()
    assert got.r[got.doc_id % 200 == 0].max() <= mixing.MISS
    assert abs(got.r[got.doc_id % 50 == 1] - 5).max() <= mixing.MISS


def test_whole_documents_of_a_small_domain_go(scored):
    got = scored.select("doc_id", mixing.fit_rates(scored, [195000.0, 4000.0, 0.0], pull=mixing.WHOLE_PULL).alias("r")).toPandas()
    assert {i for i, r in zip(got.doc_id, got.r, strict=True) if int(r + 0.5) != 1} == {i for i in range(2000) if i % 200 == 0}
    assert got.r.max() < 1.5


def test_rates_report_targets_out_of_reach(scored, caplog):
    mixing.fit_rates(scored.withColumn("p2", F.col("p1") * 0.5).withColumn("p1", F.col("p2")), None, [0.5, 0.5, 0.0])
    assert "miss their targets" in caplog.text


def test_mixing_without_labels(labelled):
    _, docs, labels = labelled
    got = mixing.mixing_rates(docs, mixing.label_domains(labels.limit(0)), {"good": 1.0})
    assert {r["rate"] for r in got.collect()} == {1.0}
    assert mixing.mixed(docs.limit(0), mixing.label_domains(labels)).count() == 0


def test_near_dedup_stage_at_80_percent_and_repeated_rows(spark):
    """Shingle sets of 90 with 81 in common (0.818 similar) and with 78 in common (0.765); rows that repeat a doc_id."""
    base = [f"t{i}" for i in range(94)]
    texts = [(1, " ".join(base)), (2, " ".join(base[9:] + [f"n{i}" for i in range(9)])), (3, " ".join([f"m{i}" for i in range(12)] + base[:-12])), (4, "alone " * 3 + "here"), (4, "alone " * 3 + "here"), (5, None), (5, None), (None, "no id at all here"), (None, "no id at all here")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*x, "en") for x in texts], "doc_id long, text string, lang string"), "")
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1, 3, 4, 5]


def test_pipeline_stages(spark, docs, tmp_path):
    whole = docs.select("doc_id", "text", "lang", "source", "n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, made, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{number}")
        made = spark.read.parquet(f"{tmp_path}/{number}")
        assert made.columns == whole.columns
    ids = [r["doc_id"] for r in made.collect()]
    assert len(ids) == len(set(ids))
    assert not {0, 1, 2, 4, 18, 19} & set(ids)
    assert {3, 5, 6, 7} <= set(ids)
    assert not any("abcd1234efgh" in (r["text"] or "") for r in made.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(ids)
