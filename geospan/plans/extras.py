"""Queries over judgements, registries, workflows, models, scenes, padding and warps."""

from __future__ import annotations

from pyspark.sql import functions as F

from geospan import workflow, zoo
from geospan.functions import geometry as G
from geospan.functions import numeric as N
from geospan.operators import arrays as A
from geospan.operators import inference as I
from geospan.operators import joins as J
from geospan.operators import nets, synthesis
from geospan.operators import priorities as P
from geospan.operators import raster as R
from geospan.operators import zonal as Z
from geospan.plans.bindings import BOXES_SQL, DEM_SQL, boxes, dem
from geospan.plans.registry import query, r6, table
from geospan.streaming import events as E

c = F.col


@query(
    "ahp",
    f"""WITH v AS (SELECT n_nationkey AS nation, n_regionkey + 1 AS a, n_nationkey + 1 AS b, length(n_name) AS d FROM nation), w AS (SELECT nation, unnest([0, 1, 2]) AS criterion, unnest([a, b, d]) / CAST(a + b + d AS DOUBLE) AS weight FROM v)
SELECT nation, criterion, {r6("weight", "1e9")} AS weight, 0e0 AS ratio FROM w""",
)
def ahp(spark, sf_dir):
    """Priorities from the judgements of each nation: how many times as much one of three numbers is as another."""
    numbers = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("nation"), F.posexplode(F.array(c("n_regionkey") + 1, c("n_nationkey") + 1, F.length("n_name"))).alias("i", "v"))
    other = numbers.select("nation", c("i").alias("j"), c("v").alias("w"))
    told = numbers.join(other, "nation").where("i < j").select("nation", "i", "j", (c("v") / c("w")).alias("a"))
    found = P.priorities(told, ["nation"]).select("nation", F.explode(F.arrays_zip("criteria", "weights")).alias("x"), "consistency_ratio")
    return found.select("nation", c("x.criteria").alias("criterion"), N.rounded(c("x.weights"), 9).alias("weight"), N.rounded(c("consistency_ratio")).alias("ratio"))


_ZOO_ROWS = ", ".join(f"('{e['model_id']}', '{e['task']}', '{e['domain']}', {e['size_bytes']}, {e['num_classes']})" for e in zoo.entries())


@query("zoo_models", f"SELECT task, domain, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(num_classes) AS classes FROM (VALUES {_ZOO_ROWS}) z(model_id, task, domain, size_bytes, num_classes) GROUP BY task, domain")
def zoo_models(spark, sf_dir):
    return zoo.models(spark).groupBy("task", "domain").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max("num_classes").alias("classes"))


@query("sha256_manifest", "SELECT CAST(item_id AS VARCHAR) AS name, item_id % 3 <> 0 AS ok FROM benchmark")
def sha256_manifest(spark, sf_dir):
    """Files against a manifest; every third one is missing."""
    files = table(spark, sf_dir, "benchmark").select("item_id", c("item_id").cast("string").alias("name"), F.sha2("text", 256).alias("checksum"))
    return zoo.integrity(files.where("item_id % 3 <> 0"), files.select("name", F.upper("checksum").alias("sha256")))


@query("provenance", "SELECT CAST(doc_id AS VARCHAR) AS source, sha256(text) AS checksum, sha256(replace(text, 'token', '')) AS found, NOT contains(text, 'token') AS ok FROM documents")
def provenance(spark, sf_dir):
    """What was noted of each document against what is there now."""
    documents = table(spark, sf_dir, "documents")
    noted = documents.select(c("doc_id").cast("string").alias("source"), F.sha2("text", 256).alias("checksum"))
    now = documents.select(c("doc_id").cast("string").alias("source"), F.sha2(F.replace("text", F.lit("token"), F.lit("")), 256).alias("checksum"))
    return workflow.verified(noted, now)


@query("pipeline_chain", f"SELECT row, {r6('avg(sqrt(z / 1000))')} AS mean, count(*) AS n FROM {DEM_SQL} WHERE z > 1000 GROUP BY row")
def pipeline_chain(spark, sf_dir):
    """Three steps as one plan."""
    chain = workflow.Pipeline(workflow.PipelineConfig("chain")).add_step(lambda df: df.where("z > 1000")).add_step(lambda df: df.withColumn("z", F.sqrt(c("z") / 1000)))
    return chain.add_step(lambda df: df.groupBy("row").agg(N.rounded(F.avg("z")).alias("mean"), F.count("*").alias("n")))(dem(spark, sf_dir))


@query(
    "workflow_runs",
    """WITH e AS (SELECT event_id % 1000 AS run, event_id, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_id % 1000) AS k FROM events)
SELECT 'r' || run AS run_id, CASE WHEN k = 1 THEN 'RUNNING' WHEN run % 7 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, greatest(k - 2, 0) AS steps FROM e GROUP BY run, k""",
)
def workflow_runs(spark, sf_dir):
    """The states of runs whose journals are made of events: the first begins, the last ends or fails, the others are steps."""
    from pyspark.sql import Window

    run = c("event_id") % 1000
    by = Window.partitionBy(run)
    rows = table(spark, sf_dir, "events").select(run.alias("run"), (F.row_number().over(by.orderBy("event_id")) - 1).alias("n"), F.count("*").over(by).alias("k"))
    kind = F.when(c("n") == 0, "begin").when(c("n") < c("k") - 1, "step").when(c("run") % 7 == 0, "error").otherwise("end")
    journal = rows.select(F.concat(F.lit("r"), c("run")).alias("run_id"), F.lit("p").alias("pipeline_id"), "n", F.timestamp_seconds(c("n")).alias("at"), kind.alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    return workflow.runs(journal).select("run_id", "status", "steps")


@query("stream_dedup", "SELECT event_type, user_id % 20 AS slot, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """The first event of each type and slot."""
    rows = table(spark, sf_dir, "events").withColumn("slot", c("user_id") % 20)
    return E.first_of(rows, ["event_type", "slot"]).select("event_type", "slot", F.lit(True).alias("seen"))


@query("stream_running", f"SELECT event_type, count(*) AS n, {r6('sum(value)', '1e3')} AS total FROM events GROUP BY event_type")
def stream_running(spark, sf_dir):
    return E.running(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", N.rounded(c("total"), 3).alias("total"))


_SIZE = f"s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM {DEM_SQL})"
_FOLD = {"edge": "least({p}, {n} - 1)", "wrap": "{p} % {n}", "symmetric": "least({p} % (2 * {n}), 2 * {n} - 1 - {p} % (2 * {n}))", "reflect": "least({p} % (2 * {n} - 2), 2 * {n} - 2 - {p} % (2 * {n} - 2))"}


def _padded(mode: str) -> None:
    def run(spark, sf_dir):
        pixels = dem(spark, sf_dir)
        h, w = R.shape(pixels)
        return R.pad_by(pixels, h, w, h + 7, w + 130, mode)

    fold = _FOLD[mode]
    sql = f"WITH {_SIZE} SELECT r AS row, q AS col, d.z FROM s, range(0, 100000) a(r), range(0, 1000) b(q), {DEM_SQL} d WHERE r < h + 7 AND q < w + 130 AND d.row = {fold.format(p='r', n='h')} AND d.col = {fold.format(p='q', n='w')}"
    query(f"pad_{mode}", sql)(run)


for _mode in _FOLD:
    _padded(_mode)


@query("legend", "SELECT CAST(r AS BIGINT) AS row, CAST(q AS BIGINT) AS col, CAST(r // 20 * 2 AS INT) AS cls, CAST(r // 20 * 10 AS INT) AS r, CAST(20 AS INT) AS g, CAST(30 AS INT) AS b FROM range(0, 60) a(r), range(0, 100) x(q)")
def legend(spark, sf_dir):
    return R.legend(spark, {2 * i: (10 * i, 20, 30) for i in range(3)})


@query("resize")
def resize(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    return R.resize(pixels, *R.shape(pixels), 10, 40)


@query("warp")
def warp(spark, sf_dir):
    """The order totals as a geographic raster, in web coordinates."""
    degrees = R.Transform(a=0.01, c=10.0, e=-0.01, f=50.0)
    return R.reproject(dem(spark, sf_dir), degrees, G.to_mercator, G.from_mercator)[0]


@query("synthetic_masks")
def synthetic_masks(spark, sf_dir):
    """A mask for each region, and the pixels of each class."""
    seeds = table(spark, sf_dir, "region").select(c("r_regionkey").alias("seed"))
    return synthesis.masks(spark, seeds, 48, 64, 4).groupBy("seed", "cls").agg(F.count("*").alias("n"))


@query("components_filter")
def components_filter(spark, sf_dir):
    """High order totals, less what is connected with few others."""
    return I.small_objects_removed(dem(spark, sf_dir).select("row", "col", (c("z") > 200000).cast("int").alias("mask")), 12)


@query("goldstein")
def goldstein(spark, sf_dir):
    """Phases unwrapped in two dimensions, by tiles."""
    phase = dem(spark, sf_dir).select((F.expr("row div 50")).alias("tile"), "row", "col", (c("z") / 5e5 * 6.28 - 3.14).alias("z"))
    return A.by_array(phase, A.flood_unwrap, "z", "tile")


@query("cubic_zoom")
def cubic_zoom(spark, sf_dir):
    return A.by_array(dem(spark, sf_dir).select(F.expr("row div 50").alias("tile"), "row", "col", "z"), lambda a: A.cubic_zoom(a, 2.0), "z", "tile")


@query("net_scores")
def net_scores(spark, sf_dir):
    """Each vector as an image of eight by eight through three convolutions."""
    layer = nets.srcnn(1)
    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select(c("vec_id").alias("id"), c("embedding").alias("data"))
    out = nets.applied(rows, layer, nets.fresh(layer, 1), (1, 8, 8))
    return out.select("id", F.size("output").alias("n"), F.array_max("output").alias("most"))


@query("asof_join", "SELECT l.event_id, r.ts AS last_ts FROM events l ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_join(spark, sf_dir):
    """When each event's user last had an event of the first type."""
    events = table(spark, sf_dir, "events").withColumn("second", c("ts").cast("timestamp").cast("double"))
    first = events.select("event_type").distinct().orderBy("event_type").limit(1)
    found = J.asof_join(events.select("event_id", "user_id", "second"), events.join(first, "event_type", "left_semi").select("user_id", "second", "ts"), "second", ["user_id"], 86400.0)
    return found.select("event_id", c("r_ts").alias("last_ts"))


@query("interval_join", f"SELECT b.id, count(*) AS n FROM {BOXES_SQL} a JOIN {BOXES_SQL} b ON a.image = (b.image + 1) % 50 AND a.x1 BETWEEN b.x1 AND b.x2 GROUP BY b.id")
def interval_join(spark, sf_dir):
    """How many boxes of the next image begin within a box's columns."""
    f = boxes(spark, sf_dir)
    return J.interval_counts(f.withColumn("image", F.pmod(c("image") - 1, F.lit(50))), f, "x1", "x1", "x2", 64.0, ["image"], "id")


@query(
    "zonal_levels",
    f"SELECT CASE WHEN g < 2 THEN a END AS block, CASE WHEN g = 0 THEN b END AS band, count(*) AS count, {r6('avg(z)', '1e3')} AS mean, max(z) AS max, CAST(2 - g AS INT) AS depth FROM (SELECT row // 10 AS a, row AS b, z FROM {DEM_SQL}), range(0, 3) r(g) GROUP BY 1, 2, g",
)
def zonal_levels(spark, sf_dir):
    """Statistics of rows, of blocks of ten rows, and of all."""
    pixels = dem(spark, sf_dir).select(F.expr("row div 10").alias("block"), c("row").alias("band"), c("z").alias("value"))
    found = Z.zonal_rollup(pixels, ["block", "band"], stats=("count", "mean", "max"))
    return found.select("block", "band", "count", N.rounded(c("mean"), 3).alias("mean"), "max", c("depth").cast("int").alias("depth"))
