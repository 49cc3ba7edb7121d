"""Features, detections, catalogues and text forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions import numeric as N
from geospan.operators import overlay as O
from geospan.operators import vector as V
from geospan.plans.bindings import BOXES_SQL, SAMPLES_SQL, boxes, samples
from geospan.plans.registry import query, r6, table

c = F.col


def _features(spark, sf_dir):
    return boxes(spark, sf_dir).withColumnsRenamed({"x1": "xmin", "y1": "ymin", "x2": "xmax", "y2": "ymax"})


@query("bbox_filter", f"SELECT id, image FROM {BOXES_SQL} WHERE conf > 0.5 AND x1 <= 500 AND x2 >= 200 AND y1 <= 700 AND y2 >= 300")
def bbox_filter(spark, sf_dir):
    return V.filter_features(_features(spark, sf_dir), "conf > 0.5", (200.0, 300.0, 500.0, 700.0)).select("id", "image")


MEET_SQL = f"FROM {BOXES_SQL} a JOIN {BOXES_SQL} b ON (a.image + 1) % 50 = b.image AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1"


def _next_images(f):
    """The boxes of each image under the image before; the last image is before the first."""
    return f.withColumn("image", F.pmod(c("image") - 1, F.lit(50)))


@query("bbox_join", f"SELECT a.image, a.id AS a, b.id AS b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h {MEET_SQL}")
def bbox_join(spark, sf_dir):
    """Pairs of boxes that meet, of each of the 50 images with those of the next, and the sides of their common part."""
    f = _features(spark, sf_dir)
    pairs = V.box_join(f, _next_images(f), 64.0, on=["image"])
    return pairs.select("image", c("id").alias("a"), c("r_id").alias("b"), (c("ixmax") - c("ixmin")).alias("w"), (c("iymax") - c("iymin")).alias("h"))


@query("bbox_anti", f"SELECT image, id FROM {BOXES_SQL} EXCEPT ALL SELECT DISTINCT a.image, a.id {MEET_SQL}")
def bbox_anti(spark, sf_dir):
    """The boxes of each image that meet none of the next."""
    f = _features(spark, sf_dir)
    return V.box_join(f, _next_images(f), 64.0, "anti", on=["image"]).select("image", "id")


def _polygons(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("shape", O.of_box(*(c(n) for n in V.ENVELOPE)))


@query("clip_area", f"SELECT a.image, a.id AS a, b.id AS b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area {MEET_SQL} AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1")
def clip_area(spark, sf_dir):
    """The common parts of the boxes of each image and the next, as polygons."""
    f = _polygons(spark, sf_dir)
    return O.intersection(f, _next_images(f), 64.0, on=["image"], measure="area").select("image", c("id").alias("a"), c("r_id").alias("b"), N.rounded(c("area")).alias("area"))


@query("union_area")
def union_area(spark, sf_dir):
    """The area that each user's boxes cover together."""
    f = table(spark, sf_dir, "events").select(c("event_id").alias("id"), "user_id").join(_polygons(spark, sf_dir), "id")
    return O.dissolve(f, ["user_id"], {"id": "count"}, "id", cell=256.0).select("user_id", c("id").alias("n"), N.rounded(O.area(c("shape"))).alias("area"))


@query("difference_area")
def difference_area(spark, sf_dir):
    """What is left of each box without the boxes of the next image that have the same event type."""
    f = table(spark, sf_dir, "events").select(c("event_id").alias("id"), "event_type").join(_polygons(spark, sf_dir), "id")
    return O.difference(f, _next_images(f), 64.0, on=["image", "event_type"]).select("image", "id", N.rounded(O.area(c("shape"))).alias("area"))


@query("box_buffer", f"SELECT id, {r6('(x2 - x1) * (y2 - y1) + 6 * ((x2 - x1) + (y2 - y1)) + 9 * 32 * sin(' + repr(2 * math.pi / 64) + ')', '1e3')} AS area FROM {BOXES_SQL}")
def box_buffer(spark, sf_dir):
    """Boxes with all that is within 3 of them."""
    return _polygons(spark, sf_dir).select("id", N.rounded(O.area(O.buffer(c("shape"), 3.0)), 3).alias("area"))


@query("polygon_wkt", f"SELECT id, 'POLYGON ((' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ' ' || CAST(y2 AS BIGINT) || ', ' || CAST(x1 AS BIGINT) || ' ' || CAST(y2 AS BIGINT) || ', ' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || '))' AS wkt, (x2 - x1) * (y2 - y1) AS area, 2 * (x2 - x1 + y2 - y1) AS length FROM {BOXES_SQL}")
def polygon_wkt(spark, sf_dir):
    """Polygons to text, to bytes and back, and their measures."""
    shapes = _polygons(spark, sf_dir).select("id", O.from_wkb(O.to_wkb(O.from_wkt(O.to_wkt(c("shape"))))).alias("s"))
    return shapes.select("id", O.to_wkt(c("s")).alias("wkt"), O.area(c("s")).alias("area"), O.length(c("s")).alias("length"))


@query("shape_filter", f"SELECT id FROM {BOXES_SQL} WHERE x1 <= 300 AND x2 >= 300 AND y1 <= 600 AND y2 >= 200 OR y1 <= 400 AND y2 >= 400 AND x1 <= 500 AND x2 >= 100")
def shape_filter(spark, sf_dir):
    """Boxes that meet one of two lines."""
    return O.filter_shapes(_polygons(spark, sf_dir), geometry="MULTILINESTRING ((300 200, 300 600), (100 400, 500 400))").select("id")


@query("bounds", f"SELECT min(x1) AS xmin, min(y1) AS ymin, max(x2) AS xmax, max(y2) AS ymax FROM {BOXES_SQL}")
def bounds(spark, sf_dir):
    return V.bounds(_features(spark, sf_dir))


@query("dissolve", f"SELECT image, min_by(conf, id) AS conf, min(x1) AS xmin, min(y1) AS ymin, max(x2) AS xmax, max(y2) AS ymax FROM {BOXES_SQL} GROUP BY image")
def dissolve(spark, sf_dir):
    return V.dissolve(_features(spark, sf_dir), ["image"], {"conf": "first"}, "id")


@query("box_iou", f"""WITH p AS (SELECT a.id AS id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM {BOXES_SQL} a JOIN {BOXES_SQL} b ON b.id = a.id + 27) SELECT id, {r6("i / (s + t - i)")} AS iou FROM p""")
def box_iou(spark, sf_dir):
    a = boxes(spark, sf_dir).alias("a")
    b = boxes(spark, sf_dir).withColumn("k", c("id") - 27).alias("b")
    sides = lambda t: tuple(c(f"{t}.{n}") for n in ("x1", "y1", "x2", "y2"))
    return a.join(b, c("a.id") == c("b.k")).select(c("a.id").alias("id"), N.rounded(G.iou(sides("a"), sides("b"))).alias("iou"))


@query("nms")
def nms(spark, sf_dir):
    """Checked by a plain loop over each image in the tests."""
    return V.suppress(boxes(spark, sf_dir)).select("id", "image", "conf")


@query("confidence_filter", f"SELECT id, conf FROM {BOXES_SQL} WHERE conf >= 0.75")
def confidence_filter(spark, sf_dir):
    return boxes(spark, sf_dir).where(c("conf") >= 0.75).select("id", "conf")


def _ring():
    """A pentagon around each box."""
    mid = (c("x1") + c("x2")) / 2
    return F.array(G.point(c("x1"), c("y1")), G.point(c("x2"), c("y1")), G.point(c("x2"), c("y2")), G.point(mid, c("y2") + 7), G.point(c("x1"), c("y2")), G.point(c("x1"), c("y1")))


PENTA = f"""WITH p AS (SELECT id, [x1, x2, x2, (x1 + x2) / 2, x1, x1] AS x, [y1, y1, y2, y2 + 7, y2, y1] AS y FROM {BOXES_SQL}),
 e AS (SELECT id, list_sum([x[i] * y[i + 1] - x[i + 1] * y[i] FOR i IN range(1, 6)]) / 2 AS a, list_sum([sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2) FOR i IN range(1, 6)]) AS len,
 list_sum([(x[i] + x[i + 1]) * (x[i] * y[i + 1] - x[i + 1] * y[i]) FOR i IN range(1, 6)]) AS cx, list_sum([(y[i] + y[i + 1]) * (x[i] * y[i + 1] - x[i + 1] * y[i]) FOR i IN range(1, 6)]) AS cy FROM p)"""


@query("polygon_area", f"{PENTA} SELECT id, {r6('abs(a)')} AS area, {r6('len')} AS length FROM e")
def polygon_area(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", _ring().alias("r")).select("id", N.rounded(G.area(c("r"))).alias("area"), N.rounded(G.length(c("r"))).alias("length"))


@query("polygon_centroid", f"{PENTA} SELECT id, {r6('cx / (6 * a)')} AS x, {r6('cy / (6 * a)')} AS y FROM e")
def polygon_centroid(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", G.centroid(_ring()).alias("p")).select("id", N.rounded(c("p.x")).alias("x"), N.rounded(c("p.y")).alias("y"))


@query("point_buffer", f"SELECT id, 65 AS corners, {r6('x + 5')} AS x0, {r6(f'32 * 25 * sin({2 * math.pi / 64!r})')} AS area FROM {SAMPLES_SQL}")
def point_buffer(spark, sf_dir):
    ring = samples(spark, sf_dir).select("id", G.point_buffer(c("x"), c("y"), 5.0).alias("r"))
    return ring.select("id", F.size("r").alias("corners"), N.rounded(c("r")[0]["x"]).alias("x0"), N.rounded(G.area(c("r"))).alias("area"))


@query("point_in_ring", f"SELECT id FROM {SAMPLES_SQL} WHERE x > 10.5 AND x < 60.5 AND y > 20.5 AND y < 70.5")
def point_in_ring(spark, sf_dir):
    ring = G.box_ring(F.lit(10.5), F.lit(20.5), F.lit(60.5), F.lit(70.5))
    return samples(spark, sf_dir).where(G.contains(ring, c("x"), c("y"))).select("id")


@query("mercator", f"SELECT id, {r6('radians(x) * 6378137', '1e3')} AS mx, {r6('ln(tan(pi() / 4 + radians(y / 2) / 2)) * 6378137', '1e3')} AS my, {r6('x')} AS lon, {r6('y / 2')} AS lat FROM {SAMPLES_SQL}")
def mercator(spark, sf_dir):
    """There and back between geographic and web coordinates."""
    x, y = G.to_mercator(c("x"), c("y") / 2)
    there = samples(spark, sf_dir).select("id", x.alias("mx"), y.alias("my"))
    lon, lat = G.from_mercator(c("mx"), c("my"))
    return there.select("id", N.rounded(c("mx"), 3).alias("mx"), N.rounded(c("my"), 3).alias("my"), N.rounded(lon).alias("lon"), N.rounded(lat).alias("lat"))


@query("wkt_points", f"SELECT id, 'POINT (' || x || ' ' || y || ')' AS wkt, x, y FROM {SAMPLES_SQL}")
def wkt_points(spark, sf_dir):
    """Points to text and back."""
    text = samples(spark, sf_dir).select("id", G.point_wkt(c("x"), c("y")).alias("wkt")).withColumn("p", G.from_point_wkt(c("wkt")))
    return text.select("id", "wkt", "p.x", "p.y")


@query("geojson_features", f"""SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}},"properties":{{"k":' || (id % 7) || '}},"id":' || id || '}}' AS feature FROM {SAMPLES_SQL}""")
def geojson_features(spark, sf_dir):
    return samples(spark, sf_dir).select("id", G.point_feature(c("x"), c("y"), F.struct((c("id") % 7).alias("k")), c("id")).alias("feature"))


@query(
    "stac_search",
    f"""SELECT e.event_id AS id, event_type AS collection, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events e JOIN {BOXES_SQL} b ON b.id = e.event_id
WHERE x1 <= 800 AND x2 >= 100 AND y1 <= 900 AND y2 >= 50 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) ORDER BY ts, e.event_id LIMIT 100""",
)
def stac_search(spark, sf_dir):
    """Items by box, time and collection; properties are JSON."""
    events = table(spark, sf_dir, "events")
    wanted = events.select(c("event_type").alias("collection")).distinct().orderBy("collection").limit(2)
    items = events.select(c("event_id").alias("id"), c("event_type").alias("collection"), "ts", "props").join(_features(spark, sf_dir).select("id", *V.ENVELOPE), "id")
    found = V.search(items, (100.0, 50.0, 800.0, 900.0), ("2024-01-05", "2024-01-20"), wanted)
    return found.select("id", "collection", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "human_sizes",
    "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f', n) || ' B' ELSE printf('%.1f', n / 1024) || ' KB' END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)",
)
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.human_size(c("n_chars")).alias("size"))


@query("file_digests", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def file_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("key_difference", "(SELECT user_id FROM events WHERE event_id % 2 = 0 EXCEPT SELECT user_id FROM events WHERE event_id % 2 = 1)")
def key_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_id % 2 = 0").select("user_id").distinct().join(e.where("event_id % 2 = 1").select("user_id"), "user_id", "left_anti")
