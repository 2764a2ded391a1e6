"""Queries of the row-wise, pairing and display operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import geodesy, geometry
from roadloom.operators import kernels, paths, raster, scenarios, scoring, splits, topology
from roadloom.plans import datasets, pipelines
from roadloom.queries import CELLS, DEG, INSIDE, P, PIX, REACH_CUT, cells, flooded, points, query, road_pixels, roads, table, utm_sql

# -- geometry, grids --------------------------------------------------------


@query(f"WITH {P} SELECT id node_id, round(x*100*(2*pi()*6378137.0/1024)-pi()*6378137.0,4) mx, round(pi()*6378137.0-y*100*(2*pi()*6378137.0/1024),4) my FROM p")
def tile_mercator(spark, sf_dir):
    mx, my = geodesy.tile_to_mercator(F.col("x") * 100, F.col("y") * 100, 10)
    return points(spark, sf_dir).select("node_id", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


@query(f"""WITH {CELLS} SELECT img, "row", col, 0.5*(col+0.5)+0.25*("row"+0.5)+1000 x, -0.5*("row"+0.5)+2000 y, col*2.0 px, "row"*2.0 py FROM c""")
def pixel_places(spark, sf_dir):
    turned = F.struct(*(F.lit(v).alias(n) for n, v in zip("abcdef", (0.5, 0.25, 1000.0, 0.0, -0.5, 2000.0))))
    x, y = geodesy.pixel_to_world(F.col("row"), F.col("col"), turned)
    px, py = geodesy.pixel_to_world(F.col("row"), F.col("col"), None, 2.0)
    return cells(spark, sf_dir).select("img", "row", "col", x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))


@query(f"""WITH {P}, ll AS (SELECT id, 73.8+x+dx lon, 15.5+y+dy lat FROM p, (VALUES (0.0,0.0),(0.0,0.02),(0.01,0.0),(0.01,0.02)) d(dx,dy)), {utm_sql('ll', '43')}
SELECT id node_id, 43 AS zone, CAST(greatest(1,ceil((max(east)-min(east))/10.0)) AS INT) width, CAST(greatest(1,ceil((max(north)-min(north))/10.0)) AS INT) height, round(min(east),2) "left", round(max(north),2) top FROM utm GROUP BY 1""")
def box_grids(spark, sf_dir):
    west, south = F.lit(73.8) + F.col("x"), F.lit(15.5) + F.col("y")
    grid = geodesy.north_up_grid(west, south, west + 0.01, south + 0.02, 10.0)
    return points(spark, sf_dir).select("node_id", grid.alias("g")).select("node_id", "g.zone", "g.width", "g.height", F.round("g.left", 2).alias("left"), F.round("g.top", 2).alias("top"))


BOX = "b AS (SELECT (max(x)-min(x))*{0}/2 w, (max(y)-min(y))*{0}/2 h, (min(x)+max(x))/2 cx, (min(y)+max(y))/2 cy FROM p)"


@query(f"WITH {P}, {BOX.format(0.4)} SELECT id node_id, round(x-w,9) x0, round(y-h,9) y0, round(x+w,9) x1, round(y+h,9) y1 FROM p, b")
def flood_boxes(spark, sf_dir):
    g = roads(spark, sf_dir)
    sides = [F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return scenarios.around(g, g.nodes.select("graph_id", "node_id", "x", "y"), 0.4).select("node_id", *sides)


@query(f"WITH {P}, {BOX.format(0.45)} SELECT round(cx-w,9) x0, round(cy-h,9) y0, round(cx+w,9) x1, round(cy+h,9) y1 FROM b")
def central_flood_box(spark, sf_dir):
    return scenarios.central_box(roads(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


LINE = "l AS (SELECT id, x ax, y ay, y bx, z by_, z cx, x cy FROM p)"


@query(f"""WITH {P}, {LINE}, s AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay))+sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)) n, sqrt(ax*ax+ay*ay) > sqrt(cx*cx+cy*cy) turned FROM l)
SELECT id node_id, round(n,9) length, CASE WHEN turned THEN cx ELSE ax END start_x, CASE WHEN turned THEN ax ELSE cx END end_x, 5 AS stitched_vertices, round(2*n,9) stitched_length FROM s""")
def polylines(spark, sf_dir):
    """Lines of three vertices: their length, turned to start near the origin, and stitched to their way back."""
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    line = F.array(point("x", "y"), point("y", "elevation"), point("elevation", "x"))
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = points(spark, sf_dir).select("node_id", line.alias("line"), geometry.oriented(line, origin).alias("o"))
    both = geometry.stitched(F.col("line"), F.reverse("line"))
    length = lambda c: F.round(geometry.polyline_length(c), 9)
    return out.select("node_id", length(F.col("line")).alias("length"), F.col("o")[0]["x"].alias("start_x"), F.element_at("o", -1)["x"].alias("end_x"), F.size(both).alias("stitched_vertices"), length(both).alias("stitched_length"))


@query(f"WITH {P}, {LINE} SELECT id mask_id, ax x1, ay y1, bx x2, by_ y2 FROM l UNION ALL SELECT id, bx, by_, cx, cy FROM l")
def line_segments(spark, sf_dir):
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    lines = points(spark, sf_dir).select(F.col("node_id").alias("mask_id"), F.array(point("x", "y"), point("y", "elevation"), point("elevation", "x")).alias("geometry"))
    return datasets.line_segments(lines)


@query(f"WITH {P} SELECT 'n'||id AS name, CAST(tx AS INT) tx, CAST(ty AS INT) ty FROM (SELECT id, unnest(range(CAST(floor(least(x*20,y*20)) AS BIGINT), CAST(floor(greatest(x*20,y*20)) AS BIGINT)+1)) tx, floor(z*20) ty FROM p)")
def tile_covers(spark, sf_dir):
    at = lambda c: F.col(c) * 20
    boxes = points(spark, sf_dir).select(F.concat(F.lit("n"), "node_id").alias("name"), at("x").alias("x0"), at("elevation").alias("y0"), at("y").alias("x1"), at("elevation").alias("y1"))
    return datasets.tile_cover(boxes)


# -- display, scenarios -----------------------------------------------------

FLOODED = f"fl AS (SELECT id FROM p WHERE {INSIDE})"
BRIDGES = "rb(a,b,v) AS (SELECT u,v,u FROM e0 UNION SELECT rb.a,rb.b,e.v FROM rb JOIN e ON e.u=rb.v WHERE NOT (least(e.u,e.v)=rb.a AND greatest(e.u,e.v)=rb.b))"
ARTICULATION = f"{REACH_CUT}, bad AS (SELECT DISTINCT a.u id FROM e a JOIN e b ON b.u=a.u AND a.v<b.v WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.r=a.u AND rv.s=a.v AND rv.v=b.v))"


@query("SELECT least(l_partkey,l_suppkey) u, greatest(l_partkey,l_suppkey) v, count(*) n FROM lineitem GROUP BY 1,2")
def edge_keys(spark, sf_dir):
    key = scenarios.edge_key(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("k")).agg(F.count("*").alias("n")).select("k.u", "k.v", "n")


@query(f"""WITH RECURSIVE {P}, {DEG}, {FLOODED}, {BRIDGES}, br AS (SELECT u, v FROM (SELECT u, v, v v_ FROM e0) q WHERE NOT EXISTS (SELECT 1 FROM rb WHERE rb.a=u AND rb.b=v_ AND rb.v=v_))
SELECT e0.u, e0.v, CASE WHEN e0.u IN (SELECT id FROM fl) OR e0.v IN (SELECT id FROM fl) THEN 'disabled' WHEN br.u IS NOT NULL THEN 'critical_bridge' ELSE 'observed' END AS state, CAST(greatest(CASE WHEN a.d>2 THEN a.d ELSE 0 END, CASE WHEN b.d>2 THEN b.d ELSE 0 END) AS DOUBLE) score
FROM e0 JOIN deg a ON a.id=e0.u JOIN deg b ON b.id=e0.v LEFT JOIN br ON br.u=e0.u AND br.v=e0.v""")
def edge_states(spark, sf_dir):
    """Scores are degrees above 2; other ends have none and count 0."""
    g = roads(spark, sf_dir)
    scores = topology.with_degrees(g).nodes.where("degree > 2").select("graph_id", "node_id", F.col("degree").cast("double").alias("score"))
    return scenarios.edge_states(kernels.cut_structure(g)[1], scores, flooded(spark, sf_dir)).select("u", "v", "state", "score")


@query(f"""WITH RECURSIVE {P}, {DEG}, {FLOODED}, {ARTICULATION} SELECT * FROM (SELECT id node_id, CASE WHEN id IN (SELECT id FROM fl) THEN 'disabled' WHEN id=7 THEN 'selected' WHEN id IN (SELECT id FROM bad) THEN 'articulation' WHEN d>=3 THEN 'critical' END AS state FROM deg) WHERE state IS NOT NULL""")
def node_states(spark, sf_dir):
    g = roads(spark, sf_dir)
    nodes = topology.with_degrees(g.with_nodes(kernels.cut_structure(g)[0])).nodes.withColumn("is_critical", F.col("degree") >= 3)
    return scenarios.node_states(nodes, flooded(spark, sf_dir), 7).select("node_id", "state")


@query(f"WITH {P}, {DEG} SELECT id node_id FROM deg JOIN p USING (id) WHERE d>=3 AND x*x+y*y <= 0.25 ORDER BY x*x+y*y, id LIMIT 1")
def clicked_junction(spark, sf_dir):
    nodes = topology.with_degrees(roads(spark, sf_dir)).nodes.withColumn("is_critical", F.col("degree") >= 3)
    return scenarios.clicked_node(nodes, 0.0, 0.0, 0.5).select("node_id")


@query(f"WITH {P}, {FLOODED} SELECT id node_id FROM fl")
def drawn_junctions(spark, sf_dir):
    from roadloom.queries import POLYGON

    return scenarios.drawn_nodes(points(spark, sf_dir), [list(POLYGON), list(POLYGON)]).select(F.explode("nodes").alias("node_id"))


@query(f"WITH {P}, {DEG}, {FLOODED} SELECT id node_id FROM fl UNION SELECT id FROM deg WHERE d>=3")
def shown_junctions(spark, sf_dir):
    return scenarios.shown_nodes(flooded(spark, sf_dir), topology.with_degrees(roads(spark, sf_dir)).nodes.where("degree >= 3")).select("node_id")


@query(f"WITH {P} SELECT u, v FROM e0")
def observed_roads(spark, sf_dir):
    """The edges without the bridges that healing added."""
    healed, _ = topology.heal(roads(spark, sf_dir), 0.05, 60.0, 2.0)
    return scenarios.observed_edges(healed.edges, healed=False).select("u", "v")


@query(f"WITH {P} SELECT a.u first, a.v middle, b.v last, CAST(a.w+b.w AS DOUBLE) length FROM e a JOIN e b ON a.v=b.u AND a.u<b.v")
def path_lengths(spark, sf_dir):
    """Every way over two edges."""
    return scenarios.two_edge_ways(roads(spark, sf_dir)).select("first", "middle", "last", "length")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 100.0*(1/((o_totalprice-100000)/400000.0)-1) ELSE CAST('inf' AS DOUBLE) END AS delay FROM orders")
def travel_delays(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.travel_delay((F.col("o_totalprice") - 100000) / F.lit(400000.0)).alias("delay"))


# -- pairing, keys, splits --------------------------------------------------


def _files(spark, sf_dir, suffix: str, where: str = "true"):
    path = F.concat(F.lit("/img/"), F.col("c_nationkey").cast("string"), F.lit("/chip"), F.col("c_custkey").cast("string"), F.lit(suffix))
    return table(spark, sf_dir, "customer").where(where).select(path.alias("path"))


FILES = "SELECT '/img/'||c_nationkey||'/chip'||c_custkey||'{0}' AS path FROM customer"


@query("SELECT '/img/'||c_nationkey||'/' AS dir, 'chip'||c_custkey AS stem, '/img/'||c_nationkey||'/chip'||c_custkey||'_sat.jpg' AS image, '/img/'||c_nationkey||'/chip'||c_custkey||'_mask.png' AS mask FROM customer WHERE c_acctbal > 0")
def image_mask_pairs(spark, sf_dir):
    every = splits.pooled([_files(spark, sf_dir, "_sat.jpg"), _files(spark, sf_dir, "_mask.png", "c_acctbal > 0")])
    return splits.image_pairs(every)


@query("SELECT '/img/'||c_nationkey||'/' AS dir, count(*) n FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, dir LIMIT 1")
def fullest_image_folder(spark, sf_dir):
    return splits.fullest_folder(image_mask_pairs(spark, sf_dir)).select("dir", "n")


@query("SELECT 'chip'||c_custkey AS chip, '/img/'||c_nationkey||'/chip'||c_custkey||'_sat.jpg' AS image, '/img/'||c_nationkey||'/chip'||c_custkey||'.geojson' AS label FROM customer WHERE c_acctbal > 0")
def image_labels(spark, sf_dir):
    return splits.image_labels(_files(spark, sf_dir, "_sat.jpg"), _files(spark, sf_dir, ".geojson", "c_acctbal > 0"))


@query(f"SELECT 0 AS folder, path FROM ({FILES.format('.png')}) UNION ALL SELECT 1, path FROM ({FILES.format('.jpg')})")
def listed_images(spark, sf_dir):
    return splits.listed([_files(spark, sf_dir, ".png"), _files(spark, sf_dir, ".jpg")])


@query("SELECT path, count(*) n FROM (SELECT s_nationkey AS path FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT c_nationkey FROM customer) GROUP BY 1")
def pooled_lists(spark, sf_dir):
    a, b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"))
    return splits.pooled([a, b, b]).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o.o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) o_orderkey FROM orders GROUP BY 1) o ON o_custkey=c_custkey")
def first_orders(spark, sf_dir):
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return splits.first_match(table(spark, sf_dir, "customer").select("c_custkey"), right, "c_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders) WHERE r <= 5")
def capped_orders(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


@query("SELECT s_suppkey, CAST(unnest(range(1,4)) AS INT) AS copy FROM supplier")
def oversampled_suppliers(spark, sf_dir):
    return splits.oversampled(table(spark, sf_dir, "supplier").select("s_suppkey"), 3)


@query("SELECT page_id, regexp_replace(regexp_extract(url,'([^/]*)$',1),'\\.[^.]*$','') AS stem, 'chip'||page_id AS chip FROM pages")
def file_names(spark, sf_dir):
    name = F.concat(F.lit("/a/x_chip"), F.col("page_id").cast("string"), F.lit("_rgb.tif"))
    return table(spark, sf_dir, "pages").select("page_id", splits.stem(F.col("url")).alias("stem"), splits.chip_name(name).alias("chip"))


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) west, c_acctbal south, c_acctbal+1 AS east, -2.5 AS north FROM customer")
def box_numbers(spark, sf_dir):
    text = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")), (F.col("c_acctbal") + 1).cast("string"), F.lit(" -2.5 "))
    box = splits.bounding_box(text)
    return table(spark, sf_dir, "customer").select("c_custkey", box.alias("b")).select("c_custkey", *(F.col("b")[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))))


@query("SELECT n_nationkey, n_nationkey = 1 AS number, n_regionkey = 1 AS word, false AS missing FROM nation")
def truthy_flags(spark, sf_dir):
    word = F.when(F.col("n_regionkey") == 1, " Yes").otherwise("no")
    return table(spark, sf_dir, "nation").select("n_nationkey", splits.truthy(F.col("n_nationkey")).alias("number"), splits.truthy(word).alias("word"), splits.truthy(F.lit(None)).alias("missing"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN (o_orderkey+1)/100.0 ELSE 0.5*(1+cos(pi()*least(1.0,(o_orderkey-100)/900.0))) END,9) rate FROM orders")
def learning_rates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(splits.learning_rate(F.col("o_orderkey"), 100, 1000), 9).alias("rate"))


# -- rasters ----------------------------------------------------------------


@query(f"""WITH {CELLS} SELECT img, "row", col, CASE WHEN 1/(1+exp(-((prob-0.51)*8))) >= 0.5 THEN 1 ELSE 0 END v FROM c""")
def binarized_cells(spark, sf_dir):
    return cells(spark, sf_dir).select("img", "row", "col", scoring.binarized((F.col("prob") - 0.51) * 8).alias("v"))


@query(f"""WITH {PIX} SELECT mask_id, "row"//16 tile_row, col//16 tile_col, count(*) road_px FROM px GROUP BY 1,2,3 ORDER BY 1,2,3 LIMIT 10""")
def first_tiles(spark, sf_dir):
    return raster.first_tiles(raster.tile_summary(road_pixels(spark, sf_dir), 16), 10).select("mask_id", "tile_row", "tile_col", "road_px")


@query(f"""WITH {PIX}, d AS (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(1,1)) v(a,b)) SELECT mask_id, CAST("row"*2+a AS INT) AS "row", CAST(col*2+b AS INT) AS col FROM px, d WHERE "row"*2+a < 100 AND col*2+b < 120""")
def upsampled_masks(spark, sf_dir):
    return raster.resampled_nearest(road_pixels(spark, sf_dir), 2, 100, 120)


@query(f"""WITH {PIX} SELECT mask_id, "row", col FROM px WHERE NOT (("row" BETWEEN 3 AND 9 AND col BETWEEN 5 AND 30) OR ("row" BETWEEN 8 AND 40 AND col BETWEEN 20 AND 24))""")
def blacked_out_masks(spark, sf_dir):
    boxes = spark.createDataFrame([(3, 5, 10, 31), (8, 20, 41, 25)], "row0 int, col0 int, row1 int, col1 int")
    return splits.blacked_out(road_pixels(spark, sf_dir), boxes).select("mask_id", "row", "col")


@query(f"""WITH {PIX} SELECT mask_id, "row", col FROM px WHERE "row" < 60 AND col < 50""")
def stitched_masks(spark, sf_dir):
    """Cut into tiles and put together again, without what lies beyond 60 x 50."""
    return raster.stitched_tiles(raster.tiles(road_pixels(spark, sf_dir), 16), 16, 60, 50)


H = "(0.5-0.5*cos(2*pi()*{0}/31.0)+0.05)"
BLEND = f"""w AS (SELECT img, "row", col, prob*(1+k*0.5) p, {H.format('("row"-k*16)')}*{H.format('col')} w FROM c, (VALUES (0),(1)) v(k) WHERE col < 32 AND "row" BETWEEN k*16 AND k*16+31)"""


@query(f"""WITH {CELLS}, {BLEND} SELECT img, "row", col, round(sum(p*w)/sum(w),9) p FROM w GROUP BY 1,2,3""")
def blended_windows(spark, sf_dir):
    """Two windows of 32 x 32 that overlap by half, the second one's values half as large again."""
    window = lambda k: cells(spark, sf_dir).where((F.col("col") < 32) & F.col("row").between(16 * k, 16 * k + 31)).select("img", F.lit(16 * k).alias("y0"), F.lit(0).alias("x0"), (F.col("row") - 16 * k).alias("row"), "col", (F.col("prob") * (1 + k * 0.5)).alias("p"))
    return raster.blended(window(0).unionByName(window(1)), 32).select("img", "row", "col", F.round("p", 9).alias("p"))


@query(f"""WITH {CELLS} SELECT img, "row", col, round(prob,9) p FROM c""")
def dihedral_means(spark, sf_dir):
    """The mean of eight views, each turned back, of a predictor that changes nothing."""
    views = raster.dihedral(cells(spark, sf_dir).select("img", "row", "col", F.col("prob").alias("p")), 64)
    return raster.undone_dihedral(views, 64).select("img", "row", "col", F.round("p", 9).alias("p"))


@query(f"""WITH {CELLS} SELECT img, "row", col, round((prob+0.5*prob+t)/3.0,9) p FROM c""")
def multi_scale_means(spark, sf_dir):
    c = cells(spark, sf_dir)
    maps = [c.select("img", "row", "col", p.alias("p")) for p in (F.col("prob"), F.col("prob") * 0.5, F.col("t").cast("double"))]
    return raster.multi_scale(maps).select("img", "row", "col", F.round("p", 9).alias("p"))


@query(f"""WITH {CELLS}, v AS (SELECT img, "row", col, o, prob*CASE WHEN img % 2 = 0 THEN 255 ELSE 1 END v FROM c), m AS (SELECT img, max(v) top FROM v GROUP BY 1)
SELECT img, "row", col, o AS channel, round((CASE WHEN top>1 THEN v/255.0 ELSE v END-CASE WHEN o=0 THEN 0.485 ELSE 0.456 END)/CASE WHEN o=0 THEN 0.229 ELSE 0.224 END,9) z FROM v JOIN m USING (img)""")
def normalised_images(spark, sf_dir):
    scaled = F.col("prob") * F.when(F.col("img") % 2 == 0, 255).otherwise(1)
    return raster.normalised(cells(spark, sf_dir).select("img", "row", "col", F.col("o").alias("channel"), scaled.alias("v"))).select("img", "row", "col", "channel", F.round("z", 9).alias("z"))


@query(f"""WITH {PIX} SELECT CAST(mask_id AS VARCHAR) mask_id, "row", col FROM px""")
def predicted_masks(spark, sf_dir):
    """A threshold as the predictor, applied tile by tile."""
    from roadloom.sources.remote import predicted_masks as predicted

    values = cells(spark, sf_dir).select(F.col("img").cast("string").alias("mask_id"), "row", "col", F.col("prob").alias("v"))
    return predicted(values, 32, lambda tile: tile >= 0.55)


@query(f"""WITH {CELLS}, z AS (SELECT img, "row"*64+col pix, t, (prob-0.5)*8 z FROM c), q AS (SELECT *, 1-z*(2*t-1) e FROM z),
s AS (SELECT *, sum(t) OVER w a, sum(1-t) OVER w b, sum(t) OVER (PARTITION BY img) g FROM q WINDOW w AS (PARTITION BY img ORDER BY e DESC, pix ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, 1-(g-a)/CAST(g+b AS DOUBLE) j FROM s), k AS (SELECT *, j-coalesce(lag(j) OVER (PARTITION BY img ORDER BY e DESC, pix),0) dj FROM j),
each AS (SELECT img, sum(greatest(e,0)*dj) lovasz, 1-(2*sum(t/(1+exp(-z)))+1e-7)/(sum(1/(1+exp(-z)))+sum(t)+1e-7) dice FROM k GROUP BY 1)
SELECT round(0.4*(SELECT avg(greatest(z,0)-z*t+ln(1+exp(-abs(z)))) FROM z)+0.4*avg(dice)+0.2*avg(lovasz),6) loss FROM each""")
def combo_losses(spark, sf_dir):
    px = cells(spark, sf_dir).select("img", "row", "col", (F.col("row") * 64 + F.col("col")).alias("pix"), "t", ((F.col("prob") - 0.5) * 8).alias("z"))
    return scoring.combo_loss(px).select(F.round("loss", 6).alias("loss"))


@query(f"""WITH {CELLS} SELECT img, round((sum(pp*t)+1e-7)/(sum(pp)+sum(t)-sum(pp*t)+1e-7),4) iou, round((2*sum(pp*t)+1e-7)/(sum(pp)+sum(t)+1e-7),4) dice, CAST(NULL AS DOUBLE) occlusion_recall, 0.5 AS threshold FROM (SELECT *, CASE WHEN prob>=0.5 THEN 1 ELSE 0 END pp FROM c) GROUP BY 1""")
def segmentation_reports(spark, sf_dir):
    meta = scoring.mask_scores(cells(spark, sf_dir).withColumn("p", (F.col("prob") >= 0.5).cast("int")), "img").withColumn("threshold", F.lit(0.5))
    return datasets.segmentation_report(meta, keep=("img",))


@query(f"WITH {P}, {DEG} SELECT count(*) nodes, CAST(count(*) FILTER (d>=3) AS BIGINT) junctions, round(100.0*(count(*)-count(*) FILTER (d>=3))/count(*),6) reduction FROM deg")
def reduction_percent(spark, sf_dir):
    nodes = topology.with_degrees(roads(spark, sf_dir)).nodes.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree") >= 3, 1)).alias("junctions"))
    return nodes.withColumn("reduction", F.round(scoring.reduction_pct(F.col("nodes"), F.col("junctions")), 6))


# -- whole plans, checked by tests -------------------------------------------


@query()
def road_flood_curve(spark, sf_dir):
    return pipelines.flood_curve(roads(spark, sf_dir), flooded(spark, sf_dir))


@query()
def road_fingerprint(spark, sf_dir):
    return scenarios.fingerprint(roads(spark, sf_dir))
