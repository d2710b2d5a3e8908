from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.functions.casing import german_casing
from larder.operators import posts, publish
from larder.streaming.related import streamed_claims

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ingredient_casing", "repair_preview", "repaired_documents", "related_requests"])
def test_queries_match_sql(spark, name):
    import __spark_entry__

    db = duckdb.connect()
    for t in ("part", "orders", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    rows = sorted(map(repr, [tuple(r) for r in got.select(*columns).collect()]))
    assert rows
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_casing(spark):
    given = ["frische petersilie, grob gehackt", "salz und pfeffer", "weißer bio-rohrzucker", "Öl mit 2x chili", "2 el öl", "red onion", "KLEINE möhren", "", None, "für die füllung", "iPhone und x"]
    want = ["frische petersilie, grob gehackt", "Salz und Pfeffer", "Weißer Bio-Rohrzucker", "Öl mit 2X Chili", "2 El Öl", "red onion", "kleine Möhren", "", None, "für die Füllung", "iPhone und X"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(german_casing(F.col("v"))).collect()] == want


DOCS = [
    (1, '{"name":"A","recipeIngredient":["2 EL Öl"," ",{"qty":1,"unit":"g","item":"Salz"},{"raw":"1-2 Zwiebeln (rot)"}],"x":{"y":[1]}}'),
    (2, '{"name":"B","recipeIngredient":[]}'),
    (3, "[1,2]"),
    (4, None),
    (5, "{broken"),
    (6, '{"recipeIngredient":"1 kg Mehl"}'),
]


def test_preview_and_repair(spark):
    docs = spark.createDataFrame(DOCS, "id long, schema string")
    assert [(r["id"], r["raw"], r["shown"]) for r in publish.preview(docs, "id").orderBy("id", "pos").collect()] == [
        (1, "2 EL Öl", "2 tbsp Öl"),
        (1, "1 g Salz", "1 g Salz"),
        (1, "1-2 Zwiebeln (rot)", "1–2 piece Zwiebeln (rot)"),
        (6, "1 kg Mehl", "1 kg Mehl"),
    ]
    made = publish.repaired(docs, "id")
    got = {r["id"]: r for r in made.collect()}
    assert {k: (r["status"], r["n_lines"]) for k, r in got.items()} == {1: ("repaired", 3), 2: ("no_lines", 0), 3: ("no_object", 0), 4: ("no_schema", 0), 5: ("no_object", 0), 6: ("repaired", 1)}
    assert all(got[k]["new"] == got[k]["old"] for k in (2, 3, 4, 5))
    read = lambda path, kind: F.try_variant_get(F.try_parse_json("new"), path, kind)
    one = made.where("id = 1").select(read("$.x.y[0]", "int"), read("$.recipeIngredient[2].qty.high", "double"), read("$.ingredientsParsed[1].item", "string"), read("$.name", "string")).first()
    assert tuple(one) == (1, 2.0, "Salz", "A")
    # What is repaired parses to the same again, and what is shown is made from it.
    twice = publish.repaired(made.select("id", F.col("new").alias("schema")), "id")
    assert {r["id"]: r["new"] for r in twice.collect()} == {k: r["new"] for k, r in got.items()}
    shown = {r["id"]: [(x["qty"], x["unit"], x["name"]) for x in r["rows"]] for r in publish.rebuilt(made.select("id", F.col("new").alias("schema")), "id").collect()}
    assert shown[1] == [("2", "EL", "Öl"), ("1", "g", "Salz"), ("1–2", "Stück", "Zwiebeln")]
    assert sorted(shown) == [1, 6]
    assert publish.repaired(docs.limit(0), "id").count() == 0


def test_publishing_checks_first_and_runs_again(spark, tmp_path):
    target, docs = str(tmp_path / "store"), spark.createDataFrame(DOCS, "id long, schema string")
    for _ in range(2):
        assert publish.publish(publish.repaired(docs, "id"), "id", target, "20260101_000000") == {"no_schema": 1, "no_object": 2, "no_lines": 1, "repaired": 2}
        assert publish.published(spark, target).count() == 6
    backups = {(r["id"], r["name"]): r["value"] for r in spark.read.parquet(f"{target}/versions/20260101_000000/backups").collect()}
    assert backups == {(i, "schema_bak_20260101_000000"): DOCS[i - 1][1] for i in (1, 6)}
    later = publish.repaired(docs.where("id = 6"), "id")
    for bad in (later.union(later), later.withColumn("new", F.lit("{")), later.withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="not published"):
            publish.publish(bad, "id", target, "20260102_000000")
        assert publish.published(spark, target).count() == 6
    publish.publish(later, "id", target, "20260102_000000")
    assert publish.published(spark, target).count() == 1
    assert publish.published(spark, target, "20260101_000000").count() == 6
    with pytest.raises(ValueError, match="not published"):
        publish.published(spark, target, "20260103_000000")


KIND = "visit string, post_id long, request_id long, at timestamp, n int"


def test_requests_never_show_a_post_twice(spark):
    shop = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1, 40)] + [(99, None)], "post_id long, category string")
    order = posts.ranked(shop)
    ranks = {c: sorted(r["rank"] for r in order.where(F.col("category") == c).collect()) for c in "ab"}
    assert ranks == {"a": list(range(1, 27)), "b": list(range(1, 14))}
    asked = [(v, p, 10 * i + j, f"2026-01-01 00:0{i}:00", n) for i in range(8) for j, (v, p, n) in enumerate([("u", 1, 5), ("u", 3, 4), ("w", 1, None), ("w", 2, 99), ("x", 77, 3), ("x", 99, 3)])]
    requests = spark.createDataFrame(asked, "visit string, post_id long, request_id long, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
    got = posts.served(posts.claims(requests), order).collect()
    seen: dict[tuple, list[int]] = {}
    for r in sorted(got, key=lambda r: (r["request_id"], r["place"])):
        seen.setdefault((r["visit"], r["post_id"]), []).append(r["related_id"])
    assert {k: len(v) for k, v in seen.items()} == {("u", 1): 25, ("u", 3): 12, ("w", 1): 8, ("w", 2): 25}
    assert all(len(set(v)) == len(v) and p not in v for (_, p), v in seen.items())
    assert posts.claims(requests.limit(0)).count() == 0


def test_a_stream_of_requests_equals_its_replay(spark, tmp_path):
    src, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    made = spark.range(120).selectExpr("concat('v', id % 4) AS visit", "id % 3 AS post_id", "id AS request_id", "timestampadd(SECOND, CAST(id AS INT), timestamp'2026-01-01 00:00:00') AS at", "CAST(id % 6 AS INT) AS n")
    out: list[tuple] = []
    for low in (0, 50, 80):
        made.where(f"request_id >= {low} AND request_id < {dict([(0, 50), (50, 80), (80, 120)])[low]}").coalesce(1).write.mode("append").parquet(src)
        stream = streamed_claims(spark.readStream.schema(KIND).parquet(src))
        stream.writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    want = posts.claims(made).select("visit", "post_id", "request_id", "first", "n").collect()
    assert sorted(out) == sorted(tuple(r) for r in want)
