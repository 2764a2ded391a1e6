import pytest
from pyspark.sql import functions as F


def test_tiles_are_fetched_again_after_a_failure(spark):
    from roadloom.sources.remote import fetched_tiles

    def make():
        seen = {}

        def fetch(z, x, y):
            seen[x] = seen.get(x, 0) + 1
            if x == 2 and seen[x] < 3:
                raise OSError("busy")
            return f"{z}/{x}/{y}".encode()

        return fetch

    tiles = spark.createDataFrame([(3, 1, 5), (3, 2, 5)], "zoom int, tx int, ty int").coalesce(1)
    assert {bytes(r["data"]) for r in fetched_tiles(tiles, make(), backoff=0.0).collect()} == {b"3/1/5", b"3/2/5"}
    with pytest.raises(Exception, match="busy"):
        fetched_tiles(tiles, make(), tries=2, backoff=0.0).collect()


def test_cached_roads_by_signature(spark, tmp_path):
    from roadloom.sources.remote import bbox_signature, cached_roads

    calls = []

    def fetch(spark, bbox, kind):
        calls.append((bbox, kind))
        return spark.createDataFrame([(len(calls),)], "n int")

    box = (73.0, 15.0, 73.1, 15.1)
    read = lambda b, k="drive": cached_roads(spark, b, fetch, str(tmp_path), k).first()["n"]
    assert [read(box), read(box), read((73.0, 15.0, 73.1, 15.2)), read(box, "walk"), read(box)] == [1, 1, 2, 3, 1]
    assert bbox_signature(box) == bbox_signature((73.00000001, 15, 73.1, 15.1)) != bbox_signature(box, "walk")


def test_predictor_gets_tiles_and_padding_goes(spark):
    from roadloom.sources.remote import predicted_masks

    values = spark.createDataFrame([("a", r, c, float(r * 5 + c)) for r in range(5) for c in range(5)], "mask_id string, row int, col int, v double")
    every = predicted_masks(values, 4, lambda tile: tile >= 0)
    assert every.count() == 25
    bright = {(r["row"], r["col"]) for r in predicted_masks(values, 4, lambda tile: tile > 20).collect()}
    assert bright == {(4, 1), (4, 2), (4, 3), (4, 4)}
    scaled = values.withColumn("v", F.col("v") / 24)
    assert predicted_masks(scaled, 8).count() == 13


def test_normalised_and_scales(spark):
    from roadloom.operators import raster

    rows = spark.createDataFrame([("a", 0, 0, 0, 255.0), ("a", 1, 0, 0, 0.0), ("b", 2, 0, 0, 1.0)], "img string, channel int, row int, col int, v double")
    got = {(r["img"], r["channel"]): r["z"] for r in raster.normalised(rows).collect()}
    assert got[("a", 0)] == pytest.approx((1 - 0.485) / 0.229) and got[("a", 1)] == pytest.approx(-0.456 / 0.224) and got[("b", 2)] == pytest.approx((1 - 0.406) / 0.225)
    one = rows.select("img", "row", "col", F.lit(0.2).alias("p"))
    assert {round(r["p"], 9) for r in raster.multi_scale([one.where("img = 'b'"), one.where("img = 'b'").withColumn("p", F.lit(0.6))]).collect()} == {0.4}


def test_combo_loss_weights(spark):
    from roadloom.operators import scoring

    px = spark.createDataFrame([("a", 0, 0, 0, 2.0, 1), ("a", 0, 1, 1, -1.0, 0), ("b", 0, 0, 0, 0.5, 0)], "img string, row int, col int, pix int, z double, t int")
    loss = lambda *w: scoring.combo_loss(px, *w).first()["loss"]
    bce, dice, lovasz = loss(1.0, 0.0, 0.0), loss(0.0, 1.0, 0.0), loss(0.0, 0.0, 1.0)
    import math

    assert bce == pytest.approx((math.log1p(math.exp(-2)) + math.log1p(math.exp(-1)) + 0.5 + math.log1p(math.exp(-0.5))) / 3)
    assert lovasz == pytest.approx((0 + 1.5) / 2)
    assert loss() == pytest.approx(0.4 * bce + 0.4 * dice + 0.2 * lovasz) and loss(0.0, 0.0, 0.0) == 0
    with pytest.raises(ValueError):
        loss(-1.0)


def test_reprojection_exports_and_parameters(spark, tmp_path):
    from roadloom.functions.geodesy import to_utm
    from roadloom.graph import graph_of
    from roadloom.plans.parameters import BuildParameters
    from roadloom.plans.pipelines import benchmark, exported, reprojected

    east, north = to_utm(F.col("lon"), F.col("lat"), 43)
    nodes = spark.createDataFrame([(0, 73.8, 15.5), (1, 73.81, 15.5), (2, 73.81, 15.52)], "node_id long, lon double, lat double").select("node_id", east.alias("x"), north.alias("y"))
    graph = graph_of(nodes, spark.createDataFrame([(0, 1), (1, 2)], "u long, v long"))
    back = reprojected(graph, 43)
    place = {r["node_id"]: (r["x"], r["y"]) for r in back.nodes.collect()}
    assert place[2] == pytest.approx((73.81, 15.52), abs=1e-9)
    line = back.edges.where("u = 1").first()["geometry"]
    assert (line[-1]["x"], line[-1]["y"]) == pytest.approx(place[2], abs=1e-9)
    (path,) = exported({"nodes": back.nodes}, str(tmp_path))
    assert spark.read.parquet(path).count() == 3
    found = benchmark(graph, 3)
    assert (found["n_nodes"], found["n_edges"], found["spearman"]) == (3, 2, 1.0)
    p = BuildParameters("north", "/x/")
    assert p.graph_file == "/x/north_graph.graphml" and "gap" in p.options()
    with pytest.raises(ValueError):
        BuildParameters("a", gap=-1.0)
