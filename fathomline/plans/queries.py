"""The registered queries over derived relations, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import boxes as B
from ..operators import manifest as M
from ..operators import metrics as E
from ..operators import raster as R
from ..operators import series as S
from .relations import PIXELS, SQL, pixels, relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL; names in square brackets stand for derived relations."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql
            for relation_name, own in (SQL | {"pixels": PIXELS, "sampled": SAMPLED}).items():
                text = text.replace(f"[{relation_name}]", f"({own})")
            ORACLES[name] = text
        return f

    return add


#: A ping's samples in long form: ping, i, n, x.
SAMPLED = "SELECT vec_id AS ping, unnest(range(0, len(embedding))) AS i, len(embedding) AS n, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS x FROM embeddings"


def r6(x: Column | str) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def long_samples(df: DataFrame, *columns: str) -> DataFrame:
    """ping and arrays to rows of ping, i and a rounded value each."""
    rows = df.select("ping", F.posexplode(F.arrays_zip(*columns)).alias("i", "x"))
    return rows.select("ping", F.col("i").cast("long").alias("i"), *[r6(f"x.{c}").alias(c) for c in columns])


def samples(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "samples").select("ping", F.transform("x", lambda v: v.cast("double")).alias("x"))


# --- altitude series -------------------------------------------------------------------------------------------------

FILLED = """
    filled AS (SELECT survey, i, alt, coalesce(alt, CASE WHEN lv IS NOT NULL AND hv IS NOT NULL THEN lv + (hv - lv) * (i - li) / (hi - li) END, lv, hv, 0) AS v FROM (
        SELECT *, last_value(alt IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN alt IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li,
               first_value(alt IGNORE NULLS) OVER b AS hv, first_value(CASE WHEN alt IS NOT NULL THEN i END IGNORE NULLS) OVER b AS hi
        FROM [pings] WINDOW a AS (PARTITION BY survey ORDER BY i), b AS (PARTITION BY survey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""
MEDIAN = FILLED + """,
    sized AS (SELECT *, max(i) OVER (PARTITION BY survey) AS top FROM filled),
    medians AS (SELECT a.survey, a.i, any_value(a.alt) AS alt, median(b.v) AS m FROM sized a CROSS JOIN range(-3, 4) k(d) JOIN sized b ON b.survey = a.survey AND b.i = greatest(0, least(a.top, a.i + d)) GROUP BY a.survey, a.i)"""
CLAMPED = "WITH RECURSIVE " + MEDIAN + """,
    clamp AS (SELECT survey, i, alt, m, m AS c FROM medians WHERE i = 0
              UNION ALL SELECT n.survey, n.i, n.alt, n.m, p.c + greatest(-15, least(15, n.m - p.c)) FROM clamp p JOIN medians n ON n.survey = p.survey AND n.i = p.i + 1)"""


@query("ping_gap_fill", "WITH " + FILLED + " SELECT survey, i, round(v, 6) AS filled FROM filled")
def ping_gap_fill(spark, d):
    return S.gap_filled(relation(spark, d, "pings")).select("survey", F.col("i").cast("long").alias("i"), r6("filled").alias("filled"))


@query("ping_median7", "WITH " + MEDIAN + " SELECT survey, i, round(m, 6) AS median FROM medians")
def ping_median7(spark, d):
    return S.median_filtered(S.gap_filled(relation(spark, d, "pings"))).select("survey", F.col("i").cast("long").alias("i"), r6("median").alias("median"))


def tracked(spark, d):
    return S.tracked(relation(spark, d, "pings"))


@query("ping_jump_clamp", CLAMPED + " SELECT survey, i, round(c, 6) AS clamped FROM clamp")
def ping_jump_clamp(spark, d):
    return tracked(spark, d).select("survey", F.col("i").cast("long").alias("i"), r6("clamped").alias("clamped"))


@query("altitude_mae", CLAMPED + " SELECT survey, count(*) AS n_pings, count(alt) AS n_known, round(avg(abs(alt - c)), 6) AS mae, round(min(c), 6) AS low, round(max(c), 6) AS high FROM clamp GROUP BY survey")
def altitude_mae(spark, d):
    return S.altitude_summary(tracked(spark, d)).select("survey", "n_pings", "n_known", *[r6(c).alias(c) for c in ("mae", "low", "high")])


# --- one ping's samples -------------------------------------------------------------------------------------------------

NEAR = "s AS (SELECT * FROM [sampled])"
SMOOTH = NEAR + ", smooth AS (SELECT a.ping, a.i, any_value(a.n) AS n, avg(b.x) AS v FROM s a CROSS JOIN range(-2, 3) k(d) JOIN s b ON b.ping = a.ping AND b.i = greatest(0, least(a.n - 1, a.i + d)) GROUP BY a.ping, a.i)"


@query("ping_box_smooth", "WITH " + SMOOTH + " SELECT ping, i, round(v, 6) AS smooth FROM smooth")
def ping_box_smooth(spark, d):
    return long_samples(samples(spark, d).select("ping", A.box_mean(F.col("x"), 5).alias("smooth")), "smooth")


@query("ping_gradient", "WITH " + NEAR + " SELECT ping, i, round((coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END, 6) AS gradient FROM s WINDOW w AS (PARTITION BY ping ORDER BY i)")
def ping_gradient(spark, d):
    return long_samples(samples(spark, d).select("ping", A.gradient(F.col("x")).alias("gradient")), "gradient")


@query(
    "ping_first_return",
    """WITH h AS (SELECT ping, 'port' AS side, n // 2 - 1 - i AS i, n // 2 AS n, abs(x) AS x FROM [sampled] WHERE i < n // 2 UNION ALL SELECT ping, 'starboard', i - n // 2, n - n // 2, abs(x) FROM [sampled] WHERE i >= n // 2),
    smooth AS (SELECT a.ping, a.side, a.i, any_value(a.n) AS n, round(avg(b.x), 9) AS v FROM h a CROSS JOIN range(-2, 3) k(d) JOIN h b ON b.ping = a.ping AND b.side = a.side AND b.i = greatest(0, least(a.n - 1, a.i + d)) GROUP BY a.ping, a.side, a.i),
    graded AS (SELECT *, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END AS g, min(v) OVER p AS low, max(v) OVER p - min(v) OVER p AS span FROM smooth WINDOW w AS (PARTITION BY ping, side ORDER BY i), p AS (PARTITION BY ping, side)),
    found AS (SELECT ping, side, min(i) AS o FROM graded WHERE i >= 3 AND span > 0 AND v >= low + 0.35 * span AND g >= 0.05 * span GROUP BY ping, side)
    SELECT p.ping, round(avg(o), 6) AS offset_px FROM (SELECT vec_id AS ping FROM embeddings) p LEFT JOIN found f ON f.ping = p.ping GROUP BY p.ping""",
)
def ping_first_return(spark, d):
    return samples(spark, d).select("ping", r6(A.bottom_offset(F.transform("x", F.abs))).alias("offset_px"))


@query(
    "slant_ground",
    """WITH s AS (SELECT *, n // 2 AS c0, 4 + ping % 9 AS alt FROM [sampled]),
    p AS (SELECT ping, i, n, c0 + sign(i - c0) * sqrt((i - c0) * (i - c0) + alt * alt) AS at FROM s)
    SELECT p.ping, p.i, p.at >= 0 AND p.at <= p.n - 1 AS valid, CASE WHEN p.at >= 0 AND p.at <= p.n - 1 THEN round(a.x * (1 - (p.at - floor(p.at))) + b.x * (p.at - floor(p.at)), 6) ELSE 0 END AS ground
    FROM p JOIN s a ON a.ping = p.ping AND a.i = greatest(0, least(p.n - 1, floor(p.at))) JOIN s b ON b.ping = p.ping AND b.i = greatest(0, least(p.n - 1, floor(p.at) + 1))""",
)
def slant_ground(spark, d):
    ground, valid = A.slant_to_ground(F.col("x"), F.col("alt"))
    rows = samples(spark, d).withColumn("alt", 4.0 + F.col("ping") % 9).select("ping", ground.alias("ground"), valid.alias("valid"))
    out = rows.select("ping", F.posexplode(F.arrays_zip("ground", "valid")).alias("i", "x"))
    return out.select("ping", F.col("i").cast("long").alias("i"), F.col("x.valid").alias("valid"), r6("x.ground").alias("ground"))


@query("nadir_mask", "SELECT ping, i, abs(i - n // 2) >= 4 + ping % 9 + 2 AS valid, CASE WHEN abs(i - n // 2) >= 4 + ping % 9 + 2 THEN round(x, 6) ELSE 0 END AS x FROM [sampled]")
def nadir_mask(spark, d):
    rows = samples(spark, d).withColumn("valid", A.nadir_mask(F.transform("x", lambda v: F.lit(True)), 4.0 + F.col("ping") % 9))
    out = rows.select("ping", F.posexplode(F.arrays_zip(F.col("valid").alias("valid"), A.masked(F.col("x"), F.col("valid")).alias("x"))).alias("i", "y"))
    return out.select("ping", F.col("i").cast("long").alias("i"), "y.valid", r6("y.x").alias("x"))


@query(
    "stack_rows",
    """WITH s AS (SELECT * FROM [sampled]), k AS (SELECT vec_id AS ping, len(embedding) AS n, len(embedding) + vec_id % 25 AS port, len(embedding) + vec_id * 7 % 25 AS starboard FROM embeddings), w AS (SELECT max(n) + 24 AS w FROM k),
    p AS (SELECT ping, n, j, CASE WHEN j < w THEN w - 1 - j ELSE j - w END AS i, CASE WHEN j < w THEN port ELSE starboard END AS own FROM k, w, range(0, 2 * (SELECT w FROM w)) t(j))
    SELECT p.ping, p.j AS i, round(CASE WHEN p.i < p.n THEN s.x WHEN p.i < p.own THEN 1 ELSE 0 END, 6) AS x FROM p LEFT JOIN s ON s.ping = p.ping AND s.i = p.i""",
)
def stack_rows(spark, d):
    """Rows are made ragged by ones at their ends."""
    longer = lambda n: F.concat("x", F.array_repeat(F.lit(1.0), n.cast("int")))
    rows = samples(spark, d)
    width = rows.agg(F.max(F.size("x")) + 24).first()[0]
    return long_samples(rows.select("ping", A.side_by_side(longer(F.col("ping") % 25), longer(F.col("ping") * 7 % 25), F.lit(width)).alias("x")), "x")


@query(
    "gauss_sep",
    """WITH g AS (SELECT k, exp(-k * k / 32.0) AS w FROM range(-16, 17) t(k)), s AS (SELECT * FROM [sampled]),
    spread AS (SELECT a.ping, a.i, w, ((a.i + k) % (2 * n) + 2 * n) % (2 * n) AS m, n FROM s a CROSS JOIN g)
    SELECT p.ping, p.i, round(sum(w * b.x) / (SELECT sum(w) FROM g), 6) AS smooth FROM spread p JOIN s b ON b.ping = p.ping AND b.i = CASE WHEN m >= p.n THEN 2 * p.n - 1 - m ELSE m END GROUP BY p.ping, p.i""",
)
def gauss_sep(spark, d):
    return long_samples(samples(spark, d).select("ping", A.gaussian(F.col("x"), 4.0).alias("smooth")), "smooth")


# --- images -------------------------------------------------------------------------------------------------------------

BOX = """s AS (SELECT *, max(r) OVER (PARTITION BY frame) AS top, max(c) OVER (PARTITION BY frame) AS side FROM [pixels]),
    box AS (SELECT a.frame, a.r, a.c, any_value(a.v) AS v, avg(b.v) AS mean, greatest(avg(b.v * b.v) - avg(b.v) * avg(b.v), 0) AS var FROM s a CROSS JOIN range(-2, 3) y(dy) CROSS JOIN range(-2, 3) x(dx)
            JOIN s b ON b.frame = a.frame AND b.r = greatest(0, least(a.top, a.r + dy)) AND b.c = greatest(0, least(a.side, a.c + dx)) GROUP BY a.frame, a.r, a.c)"""


def image(df: DataFrame, *values: str) -> DataFrame:
    return df.select("frame", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), *[r6(v).alias(v) for v in values])


@query("box2d_mean", "WITH " + BOX + " SELECT frame, r, c, round(mean, 6) AS mean, round(var, 6) AS var FROM box")
def box2d_mean(spark, d):
    return image(R.local_moments(pixels(spark, d), 5), "mean", "var")


@query("lee", "WITH " + BOX + ", n AS (SELECT frame, avg(var) AS noise FROM box GROUP BY frame) SELECT frame, r, c, round(mean + greatest(0, least(1, (var - noise) / (var + 1e-6))) * (v - mean), 6) AS v FROM box JOIN n USING (frame)")
def lee(spark, d):
    return image(R.despeckled(pixels(spark, d), "lee"), "v")


@query(
    "frost",
    "WITH " + BOX + """ SELECT a.frame, a.r, a.c, round(sum(exp(-2 * a.var / (a.mean * a.mean + 1e-6) * sqrt(dy * dy + dx * dx)) * b.v) / (sum(exp(-2 * a.var / (a.mean * a.mean + 1e-6) * sqrt(dy * dy + dx * dx))) + 1e-6), 6) AS v
    FROM box a CROSS JOIN range(-2, 3) y(dy) CROSS JOIN range(-2, 3) x(dx) JOIN s b ON b.frame = a.frame AND b.r = (a.r + dy + b.top + 1) % (b.top + 1) AND b.c = (a.c + dx + b.side + 1) % (b.side + 1) GROUP BY a.frame, a.r, a.c""",
)
def frost(spark, d):
    return image(R.despeckled(pixels(spark, d), "frost"), "v")


@query("col_gain", "WITH m AS (SELECT frame, c, avg(v) AS m FROM [pixels] GROUP BY ALL), g AS (SELECT frame, avg(m) FILTER (m > 1e-6) AS g FROM m GROUP BY frame) SELECT frame, c, round(CASE WHEN m > 1e-6 AND m / g >= 1e-6 THEN m / g ELSE 1 END, 6) AS gain FROM m JOIN g USING (frame)")
def col_gain(spark, d):
    return R.column_gain(pixels(spark, d)).select("frame", F.col("c").cast("int").alias("c"), r6("gain").alias("gain"))


@query("gain_normalised", "WITH p AS (SELECT * FROM [pixels]), m AS (SELECT frame, c, avg(v) AS m FROM p GROUP BY ALL), g AS (SELECT frame, avg(m) FILTER (m > 1e-6) AS g FROM m GROUP BY frame) SELECT frame, r, c, round(v / CASE WHEN m > 1e-6 AND m / g >= 1e-6 THEN m / g ELSE 1 END + 1e-9, 6) AS v FROM p JOIN m USING (frame, c) JOIN g USING (frame)")
def gain_normalised(spark, d):
    return image(R.gain_normalised(pixels(spark, d)).withColumn("v", F.col("v") + 1e-9), "v")  # off the ties of rounding


@query("col_cv", "SELECT frame, round(coalesce(stddev_pop(m) / nullif(avg(m), 0), 0), 6) AS cv FROM (SELECT frame, c, avg(v) AS m FROM [pixels] GROUP BY ALL) WHERE m > 0 GROUP BY frame")
def col_cv(spark, d):
    return R.column_cv(pixels(spark, d)).select("frame", r6("cv").alias("cv"))


@query(
    "destripe",
    """WITH p AS (SELECT * FROM [pixels]), cm AS (SELECT frame, c, avg(v) AS m, count(*) OVER (PARTITION BY frame) AS n FROM p GROUP BY frame, c), rm AS (SELECT frame, r, avg(v) AS m, count(*) OVER (PARTITION BY frame) AS n FROM p GROUP BY frame, r),
    cl AS (SELECT a.frame, a.c, any_value(a.m) - sum(b.m * (1 + 2 * cos(2 * pi() * (a.c - b.c) / a.n))) / any_value(a.n) AS h FROM cm a JOIN cm b ON a.frame = b.frame GROUP BY a.frame, a.c),
    rl AS (SELECT a.frame, a.r, any_value(a.m) - sum(b.m * (1 + list_sum([2 * cos(2 * pi() * f * (a.r - b.r) / a.n) FOR f IN range(1, greatest(1, floor(0.02 * a.n))::BIGINT + 1)]))) / any_value(a.n) AS h FROM rm a JOIN rm b ON a.frame = b.frame GROUP BY a.frame, a.r)
    SELECT frame, r, c, round(v - cl.h - rl.h, 6) AS v FROM p JOIN cl USING (frame, c) JOIN rl USING (frame, r)""",
)
def destripe(spark, d):
    return image(R.destriped(pixels(spark, d)), "v")


@query(
    "pct_stretch",
    "WITH p AS (SELECT * FROM [pixels]), q AS (SELECT frame, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p GROUP BY frame) SELECT frame, r, c, CAST(floor(255 * greatest(0, least(1, (v - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo)))) AS INT) AS v FROM p JOIN q USING (frame)",
)
def pct_stretch(spark, d):
    return R.stretched(pixels(spark, d)).select("frame", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), "v")


@query("tile_grid", "SELECT p_partkey AS id, unnest(CASE WHEN l <= 640 THEN [0] ELSE list_distinct(list_concat(range(0, l - 639, 512), [l - 640])) END) AS tile_off FROM (SELECT p_partkey, p_partkey * 7 % 3000 + 1 AS l FROM part)")
def tile_grid(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 3000 + 1).alias("l"))
    return rows.select("id", F.explode(A.tile_offsets(F.col("l"), 640, 512)).alias("o")).select("id", F.col("o").cast("long").alias("tile_off"))


@query(
    "tile_valid_frac",
    """WITH p AS (SELECT *, v > 3 AS ok, max(r) OVER (PARTITION BY frame) + 1 AS h FROM [pixels]),
    o AS (SELECT frame, unnest(CASE WHEN any_value(h) <= 16 THEN [0] ELSE list_distinct(list_concat(range(0, any_value(h) - 15, 13), [any_value(h) - 16])) END) AS ro FROM p GROUP BY frame),
    x AS (SELECT unnest(list_distinct(list_concat(range(0, 49, 13), [48]))) AS co)
    SELECT frame, format('r{}_c{}', ro, co) AS tile, count(*) AS n, round(avg(v), 6) AS mean, round(avg(ok::INT), 6) AS valid_frac FROM p JOIN o USING (frame) CROSS JOIN x WHERE r >= ro AND r < ro + 16 AND c >= co AND c < co + 16 GROUP BY frame, tile HAVING avg(ok::INT) >= 0.1""",
)
def tile_valid_frac(spark, d):
    cut = R.tiles(pixels(spark, d).withColumn("valid", F.col("v") > 3), 16)
    return cut.groupBy("frame", "tile").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.avg(F.col("valid").cast("int"))).alias("valid_frac"))


#: Canny edges: gradients with repeated borders, thinning across them, weak edges joined to strong ones; then their share.
EDGES = """ep AS MATERIALIZED (SELECT CAST(frame AS BIGINT) AS frame, CAST(r AS INT) AS r, c, v, CAST(max(r) OVER (PARTITION BY frame) AS INT) AS top, max(c) OVER (PARTITION BY frame) AS side FROM [pixels]),
    eg AS (SELECT a.frame, a.r, a.c, sum(b.v * dx * (2 - abs(dy))) AS gx, sum(b.v * dy * (2 - abs(dx))) AS gy FROM ep a CROSS JOIN range(-1, 2) y(dy) CROSS JOIN range(-1, 2) x(dx) JOIN ep b ON b.frame = a.frame AND b.r = greatest(0, least(a.top, a.r + dy)) AND b.c = greatest(0, least(a.side, a.c + dx)) GROUP BY a.frame, a.r, a.c),
    es AS MATERIALIZED (SELECT frame, r, c, abs(gx) + abs(gy) AS size, CASE (CAST(round(atan2(gy, gx) / (pi() / 4)) AS INT) + 8) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS dy, CASE (CAST(round(atan2(gy, gx) / (pi() / 4)) AS INT) + 8) % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS dx FROM eg),
    thin AS MATERIALIZED (SELECT e.frame, e.r, e.c, e.size FROM es e LEFT JOIN es a ON a.frame = e.frame AND a.r = e.r + e.dy AND a.c = e.c + e.dx LEFT JOIN es b ON b.frame = e.frame AND b.r = e.r - e.dy AND b.c = e.c - e.dx WHERE e.size > 50 AND e.size > coalesce(b.size, 0) AND e.size >= coalesce(a.size, 0)),
    edge AS (SELECT frame, r, c FROM thin WHERE size > 150 UNION SELECT t.frame, t.r, t.c FROM edge e JOIN thin t ON t.frame = e.frame AND t.r BETWEEN e.r - 1 AND e.r + 1 AND t.c BETWEEN e.c - 1 AND e.c + 1),
    density AS (SELECT frame, n / m AS edge_density FROM (SELECT frame, count(*) AS m FROM ep GROUP BY frame) JOIN (SELECT ep.frame, count(e.r) AS n FROM ep LEFT JOIN edge e ON e.frame = ep.frame AND e.r = ep.r AND e.c = ep.c GROUP BY ep.frame) USING (frame))"""


@query(
    "tile_quality",
    "WITH RECURSIVE " + BOX + ", " + EDGES + """, w AS (SELECT frame, stddev_pop(mean) AS sd, stddev_pop(v - mean) AS ns, (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / 255 AS contrast, avg((v <= 2 OR v >= 253)::INT) AS saturation FROM box GROUP BY frame),
    dr AS (SELECT frame, avg(dark) AS dark FROM (SELECT frame, r, (max(v) <= 1)::INT AS dark FROM box GROUP BY frame, r) GROUP BY frame), dc AS (SELECT frame, avg(dark) AS dark FROM (SELECT frame, c, (max(v) <= 1)::INT AS dark FROM box GROUP BY frame, c) GROUP BY frame),
    q AS (SELECT frame, CASE WHEN ns > 1e-6 THEN sd / ns ELSE 10 END AS snr, contrast, saturation, greatest(dr.dark, dc.dark) AS dropout FROM w JOIN dr USING (frame) JOIN dc USING (frame)),
    z AS (SELECT *, 0.3 * snr / (snr + 1) + 0.25 * least(1, contrast) + 0.2 * least(1, edge_density / 0.15::DOUBLE) + 0.15 * (1 - dropout) + 0.1 * (1 - saturation) AS score FROM q JOIN density USING (frame))
    SELECT frame, round(snr, 6) AS snr, round(contrast, 6) AS contrast, round(dropout, 6) AS dropout, round(saturation, 6) AS saturation, round(score, 6) AS score, CASE WHEN score < 0.404 THEN 'low' ELSE 'ok' END AS flag FROM z""",
)
def tile_quality(spark, d):
    from ..operators import kernels as K

    density = K.on_frames(numbered_pixels(spark, d), K.edges).groupBy("frame").agg(F.avg("v").alias("edge_density"))
    rows = R.tile_proxies(pixels(spark, d)).join(density, "frame").withColumn("score", R.quality_score())
    return rows.select("frame", *[r6(c).alias(c) for c in ("snr", "contrast", "dropout", "saturation", "score")], R.quality_flag(F.col("score")).alias("flag"))


def _morph(name: str, source: str, widest: bool) -> str:
    """SQL of one erosion or dilation over the 5-wide ellipse; pixels outside count for neither."""
    return f"{name} AS (SELECT a.frame, a.r, a.c, {'max' if widest else 'min'}(b.v) AS v FROM {source} a JOIN e ON true JOIN {source} b ON b.frame = a.frame AND b.r = a.r + dy AND b.c = a.c + dx GROUP BY a.frame, a.r, a.c)"


@query(
    "morph_open_close",
    "WITH e(dy, dx) AS (VALUES " + ", ".join(f"({y}, {x})" for y, x in R.ellipse(5)) + "), m0 AS (SELECT frame, r, c, (v >= 20)::INT AS v FROM [pixels]), " + ", ".join([_morph("m1", "m0", False), _morph("m2", "m1", True), _morph("m3", "m2", True), _morph("m4", "m3", False)]) + " SELECT frame, r, c, v AS is_on FROM m4",
)
def morph_open_close(spark, d):
    mask = pixels(spark, d).select("frame", "r", "c", (F.col("v") >= 20).cast("int").alias("on"))
    return R.opened_closed(mask, 5).select("frame", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), F.col("on").alias("is_on"))


# --- boxes --------------------------------------------------------------------------------------------------------------

IOU = "CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))::DOUBLE ELSE 0 END"
CENTRE = "(({a}.x1 + {a}.x2) / 2.0 BETWEEN {b}.x1 AND {b}.x2 AND ({a}.y1 + {a}.y2) / 2.0 BETWEEN {b}.y1 AND {b}.y2)"


def hits(found: str, name: str = "hits") -> str:
    return f"{name} AS (SELECT g.tile, g.id AS g_id, f.id AS f_id, {IOU.format(a='g', b='f')} AS iou FROM [boxes_gt] g JOIN {found} f ON f.tile = g.tile WHERE {IOU.format(a='g', b='f')} >= 0.1 OR {CENTRE.format(a='g', b='f')})"


def box_tables(spark, d):
    return relation(spark, d, "boxes_gt"), relation(spark, d, "boxes_det"), relation(spark, d, "boxes_ano")


@query("box_iou_join", "WITH " + hits("[boxes_ano]") + " SELECT tile, g_id, f_id, round(iou, 6) AS iou FROM hits")
def box_iou_join(spark, d):
    truth, _, ano = box_tables(spark, d)
    return B.hit_pairs(truth, ano).withColumn("iou", r6("iou"))


@query("gt_recall_semi", "WITH " + hits("[boxes_ano]") + ", n AS (SELECT count(*) AS n_found FROM [boxes_ano]), f AS (SELECT DISTINCT tile, f_id FROM (SELECT tile, g_id, min(f_id) AS f_id FROM hits GROUP BY ALL)) SELECT (SELECT count(*) FROM [boxes_gt]) AS n_truth, (SELECT count(*) FROM (SELECT DISTINCT tile, g_id FROM hits)) AS n_hit, n_found, n_found - (SELECT count(*) FROM f) AS n_false FROM n")
def gt_recall_semi(spark, d):
    truth, _, ano = box_tables(spark, d)
    return B.recall_counts(truth, ano)


@query("false_cands_anti", "WITH " + hits("[boxes_ano]") + ", f AS (SELECT tile, g_id, min(f_id) AS id FROM hits GROUP BY ALL) SELECT tile, count(*) AS n_false FROM [boxes_ano] a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.tile = a.tile AND f.id = a.id) GROUP BY tile")
def false_cands_anti(spark, d):
    truth, _, ano = box_tables(spark, d)
    first = B.hit_pairs(truth, ano).groupBy("tile", "g_id").agg(F.min("f_id").alias("id"))
    return ano.join(first, ["tile", "id"], "left_anti").groupBy("tile").agg(F.count("*").alias("n_false"))


FUSE = f"""WITH RECURSIVE det AS (SELECT * FROM [boxes_det]), ano AS (SELECT * FROM [boxes_ano]),
    da AS (SELECT tile, list(d ORDER BY d.id) AS ds FROM det d GROUP BY tile), aa AS (SELECT tile, list(a ORDER BY a.id) AS xs FROM ano a GROUP BY tile),
    walk AS (
        SELECT tile, ds, coalesce(xs, []) AS xs, 0 AS k, []::BIGINT[] AS used, NULL::BIGINT AS pick FROM da LEFT JOIN aa USING (tile)
        UNION ALL
        SELECT tile, ds, xs, k + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
            SELECT *, CASE WHEN list_max(ious) >= 0.5 THEN len(ious) - list_position(list_reverse(ious), list_max(ious)) + 1 ELSE list_position(ins, true) END AS pick FROM (
                SELECT tile, ds, xs, k, used, [CASE WHEN list_contains(used, j) THEN -1::DOUBLE ELSE {IOU.format(a='ds[k + 1]', b='xs[j]')} END FOR j IN range(1, len(xs) + 1)] AS ious,
                       [NOT list_contains(used, j) AND {CENTRE.format(a='xs[j]', b='ds[k + 1]')} FOR j IN range(1, len(xs) + 1)] AS ins FROM walk WHERE k < len(ds)))),
    both_rows AS (SELECT tile, ds[k].id AS id, CASE WHEN pick IS NULL THEN 'yolo' ELSE 'both' END AS origin, xs[pick].id AS partner, ds[k].cls AS cls, ds[k].conf AS conf, xs[pick].peak AS peak, xs[pick].mean AS mean, coalesce(ds[k].polygon, xs[pick].polygon) AS polygon FROM walk WHERE k > 0),
    merged AS (SELECT * FROM both_rows UNION ALL SELECT tile, id, 'anomaly_only', NULL, NULL, NULL, peak, mean, polygon FROM ano a WHERE NOT EXISTS (SELECT 1 FROM both_rows b WHERE b.tile = a.tile AND b.partner = a.id))"""


@query("fuse_greedy", FUSE + " SELECT tile, id, origin, partner, cls, conf, peak, mean, polygon FROM merged")
def fuse_greedy(spark, d):
    _, det, ano = box_tables(spark, d)
    return B.fused(det, ano).select("tile", "id", "origin", "partner", "cls", "conf", "peak", "mean", "polygon")


@query(
    "fusion_metrics",
    FUSE + ", every AS (SELECT m.tile, m.id, m.origin, coalesce(d.x1, a.x1) AS x1, coalesce(d.y1, a.y1) AS y1, coalesce(d.x2, a.x2) AS x2, coalesce(d.y2, a.y2) AS y2 FROM merged m LEFT JOIN det d ON m.origin <> 'anomaly_only' AND d.id = m.id LEFT JOIN ano a ON m.origin = 'anomaly_only' AND a.id = m.id), "
    + hits("det", "hd") + ", " + hits("ano", "ha") + ", " + hits("every", "hf") + ", e AS (SELECT tile, g_id, count(*) AS n FROM hf GROUP BY ALL) "
    "SELECT (SELECT count(*) FROM [boxes_gt]) AS n_truth, (SELECT count(*) FROM (SELECT DISTINCT tile, g_id FROM hd)) AS hit_detector, (SELECT count(*) FROM (SELECT DISTINCT tile, g_id FROM ha)) AS hit_anomaly, (SELECT count(*) FROM e) AS hit_fused, (SELECT sum(n - 1)::BIGINT FROM e) AS duplicates, "
    "count(*) AS n_fused, count(*) FILTER (origin = 'both') AS n_both, count(*) FILTER (origin = 'yolo') AS n_yolo, count(*) FILTER (origin = 'anomaly_only') AS n_anomaly_only FROM every",
)
def fusion_metrics(spark, d):
    truth, det, ano = box_tables(spark, d)
    return B.fusion_metrics(truth, det, ano, B.fused(det, ano))


CURVE = f"""WITH t AS (SELECT k / 10::DOUBLE AS thr FROM range(0, 9) r(k)), p AS (SELECT thr, g.tile, g.id AS g_id, min(f.id) AS f_id FROM t CROSS JOIN [boxes_gt] g JOIN [boxes_ano] f ON f.tile = g.tile AND f.score >= thr WHERE {IOU.format(a='g', b='f')} >= 0.1 OR {CENTRE.format(a='g', b='f')} GROUP BY ALL),
    h AS (SELECT thr, count(*) AS hits, count(DISTINCT (tile, f_id)) AS matched FROM p GROUP BY thr), n AS (SELECT thr, count(*) AS n FROM t JOIN [boxes_ano] f ON f.score >= thr GROUP BY thr), w AS (SELECT count(*) AS g, count(DISTINCT tile) AS tiles FROM [boxes_gt]),
    curve AS (SELECT thr, round(coalesce(hits, 0) / g, 6) AS recall, round((coalesce(n, 0) - coalesce(matched, 0)) / tiles, 6) AS false_per_tile FROM t LEFT JOIN h USING (thr) LEFT JOIN n USING (thr) CROSS JOIN w)"""


def curve(spark, d):
    truth, _, ano = box_tables(spark, d)
    rows = B.threshold_curve(truth, ano, spark.range(9).select((F.col("id") / 10).alias("thr")))
    return rows.select("thr", r6("recall").alias("recall"), r6("false_per_tile").alias("false_per_tile"))


@query("thr_sweep", CURVE + " SELECT * FROM curve")
def thr_sweep(spark, d):
    return curve(spark, d)


@query("operating_point", CURVE + " SELECT * FROM curve ORDER BY recall >= 0.8 DESC, CASE WHEN recall >= 0.8 THEN false_per_tile END NULLS LAST, CASE WHEN recall < 0.8 THEN -recall END NULLS LAST, thr LIMIT 1")
def operating_point(spark, d):
    return B.operating_point(curve(spark, d))


# --- metrics ------------------------------------------------------------------------------------------------------------

BA = """WITH s AS (SELECT * FROM [scores]), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s), g AS (SELECT lo + (hi - lo) * k / 100 AS t FROM e CROSS JOIN range(0, 101) r(k)),
    cm AS (SELECT t, count(*) FILTER (s >= t AND good = 1) AS tp, count(*) FILTER (s < t AND good = 1) AS fn, count(*) FILTER (s >= t AND good <> 1) AS fp, count(*) FILTER (s < t AND good <> 1) AS tn FROM g CROSS JOIN s GROUP BY t),
    ba AS (SELECT *, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS ba FROM cm)"""


def rounded_curve(df: DataFrame) -> DataFrame:
    return df.select(r6("t").alias("t"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fn", "fp", "tn")], r6("ba").alias("ba"))


@query("calibration_curve", BA + " SELECT round(t, 6) AS t, tp, fn, fp, tn, round(ba, 6) AS ba FROM ba")
def calibration_curve(spark, d):
    return rounded_curve(E.calibration_curve(relation(spark, d, "scores")))


@query("calibrate_ba", BA + " SELECT round(t, 6) AS t, tp, fn, fp, tn, round(ba, 6) AS ba FROM ba ORDER BY ba.ba DESC, ba.t LIMIT 1")
def calibrate_ba(spark, d):
    return rounded_curve(E.calibrated(relation(spark, d, "scores")))


@query("confusion", "SELECT lang, count(*) FILTER (s >= 0.4 AND good = 1) AS tp, count(*) FILTER (s < 0.4 AND good = 1) AS fn, count(*) FILTER (s >= 0.4 AND good <> 1) AS fp, count(*) FILTER (s < 0.4 AND good <> 1) AS tn FROM [scores] GROUP BY lang")
def confusion(spark, d):
    return relation(spark, d, "scores").groupBy("lang").agg(*E.confusion(F.col("s") >= 0.4, F.col("good") == 1))


@query("auroc", "SELECT p.lang, round(avg(CASE WHEN p.s > q.s THEN 1 WHEN p.s = q.s THEN 0.5 ELSE 0 END), 6) AS auroc FROM [scores] p JOIN [scores] q ON p.lang = q.lang AND p.good = 1 AND q.good <> 1 GROUP BY p.lang")
def auroc(spark, d):
    return E.auroc(relation(spark, d, "scores"), "lang").filter("auroc IS NOT NULL").select("lang", r6("auroc").alias("auroc"))


@query("iou_f1", "SELECT frame, round((tp + 1e-9) / (tp + fp + fn + 1e-9), 6) AS iou, round((2 * tp + 1e-9) / (2 * tp + fp + fn + 1e-9), 6) AS f1 FROM (SELECT frame, sum((a AND b)::INT) AS tp, sum((a AND NOT b)::INT) AS fp, sum((b AND NOT a)::INT) AS fn FROM (SELECT frame, v >= 60 AS a, lead(v, 1, 0) OVER (PARTITION BY frame, r ORDER BY c) >= 60 AS b FROM [pixels]) GROUP BY frame)")
def iou_f1(spark, d):
    from pyspark.sql import Window

    rows = pixels(spark, d).select("frame", (F.col("v") >= 60).alias("a"), (F.lead("v", 1, 0.0).over(Window.partitionBy("frame", "r").orderBy("c")) >= 60).alias("b"))
    counts = rows.select("frame", (F.col("a") & F.col("b")).cast("int").alias("tp"), (F.col("a") & ~F.col("b")).cast("int").alias("fp"), (F.col("b") & ~F.col("a")).cast("int").alias("fn"))
    return E.segmentation(counts, "frame").select("frame", r6("iou").alias("iou"), r6("f1").alias("f1"))


@query("real_synth_mean", "SELECT round(avg(a) FILTER (p_brand IN ('Brand#11', 'Brand#12')), 6) AS real, round(avg(a) FILTER (p_brand NOT IN ('Brand#11', 'Brand#12')), 6) AS other FROM (SELECT p_brand, avg(p_size) / 50 AS a FROM part GROUP BY p_brand)")
def real_synth_mean(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("class")).agg((F.avg("p_size") / 50).alias("ap50"))
    return E.mean_by_origin(rows, ["Brand#11", "Brand#12"]).select(r6("real").alias("real"), r6("other").alias("other"))


@query("thr_grid", "SELECT DISTINCT round(q, 4) AS thr FROM (SELECT unnest(quantile_cont(v, [0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999])) AS q FROM (SELECT event_id, value AS v FROM events WHERE event_id % 53 = 0))")
def thr_grid(spark, d):
    return E.threshold_grid(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), F.col("value").alias("v")))


# --- manifests ----------------------------------------------------------------------------------------------------------

SPLIT = """g AS (SELECT DISTINCT source_dataset, source_group_id FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY sha256(concat('1337:', source_group_id)), source_group_id) - 1 AS k, count(*) OVER (PARTITION BY source_dataset) AS n FROM g),
    split AS (SELECT source_dataset, source_group_id, CASE WHEN k < round_even(0.7::DOUBLE * n, 0) THEN 'train' WHEN k < round_even(0.7::DOUBLE * n, 0) + round_even(0.15::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM k),
    ms AS (SELECT m.*, split FROM m JOIN split USING (source_dataset, source_group_id))"""
MANIFEST = "WITH m AS (SELECT * FROM [manifest]), " + SPLIT


def split_manifest(spark, d):
    return M.hash_split(relation(spark, d, "manifest"))


@query("group_split", MANIFEST + " SELECT source_dataset, source_group_id, image_path, split FROM ms")
def group_split(spark, d):
    return split_manifest(spark, d).select("source_dataset", "source_group_id", "image_path", "split")


@query("split_leak", MANIFEST + " SELECT source_group_id, count(DISTINCT split) AS n_splits FROM ms GROUP BY source_group_id HAVING count(DISTINCT split) > 1")
def split_leak(spark, d):
    return M.split_leaks(split_manifest(spark, d))


@query("split_counts", MANIFEST + " SELECT source_dataset, split, count(*) AS n FROM ms GROUP BY ALL")
def split_counts(spark, d):
    return split_manifest(spark, d).groupBy("source_dataset", "split").agg(F.count("*").alias("n"))


@query("cross_manifest_diff", MANIFEST + ", o AS (SELECT image_path, CASE WHEN image_path LIKE '%7.png' THEN 'test' ELSE split END AS split_b FROM ms) SELECT image_path, split AS split_a, split_b FROM ms JOIN o USING (image_path) WHERE split <> split_b")
def cross_manifest_diff(spark, d):
    rows = split_manifest(spark, d)
    other = rows.withColumn("split", F.when(F.col("image_path").endswith("7.png"), "test").otherwise(F.col("split")))
    return M.split_differences(rows, other)


@query("dataset_card", MANIFEST + ", c AS (SELECT origin, split, unnest(string_split(classes, '|')) AS class FROM ms) SELECT origin, class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM c WHERE class <> '' GROUP BY ALL")
def dataset_card(spark, d):
    return M.dataset_card(split_manifest(spark, d))


@query("card_grouping_sets", MANIFEST + " SELECT split, origin, count(*) AS n_rows, count(DISTINCT source_group_id) AS n_groups FROM ms GROUP BY GROUPING SETS ((split), (origin), ())")
def card_grouping_sets(spark, d):
    return M.card_counts(split_manifest(spark, d))


@query("source_prefix", "SELECT id, CASE WHEN starts_with(stem, 'pure_synth_subpipe') THEN 'pure_synth_subpipe' WHEN starts_with(stem, 'pure_synth_uatd') THEN 'pure_synth_uatd' WHEN starts_with(stem, 'ai4') THEN 'ai4' WHEN starts_with(stem, 'sctd') THEN 'sctd' WHEN starts_with(stem, 'pipe20xx') THEN 'pipe20xx' WHEN starts_with(stem, 'synth_net') THEN 'synth_net' WHEN starts_with(stem, 'normal') THEN 'normal_seabed' ELSE 'other' END AS source FROM [stems]")
def source_prefix(spark, d):
    return relation(spark, d, "stems").select("id", M.source_of(F.col("stem")).alias("source"))


@query("group_key", "SELECT id, CASE WHEN starts_with(stem, 'ai4') THEN regexp_replace(stem, '_[0-9]+$', '') WHEN starts_with(stem, 'pipe20xx') THEN 'pipe20xx_2010' ELSE stem END AS group_id FROM [stems]")
def group_key(spark, d):
    return relation(spark, d, "stems").select("id", M.group_of(M.source_of(F.col("stem")), F.col("stem")).alias("group_id"))


@query(
    "label_parse",
    "WITH p AS (SELECT image, regexp_split_to_array(trim(line), '\\s+') AS p FROM [label_lines]), n AS (SELECT image, p[1]::INT AS class_id, p[2]::DOUBLE AS cx, p[3]::DOUBLE AS cy, p[4]::DOUBLE AS w, p[5]::DOUBLE AS h FROM p WHERE len(p) >= 5) "
    "SELECT image, class_id, trunc((cx - w / 2) * 640)::INT AS x1, trunc((cy - h / 2) * 640)::INT AS y1, trunc((cx + w / 2) * 640)::INT AS x2, trunc((cy + h / 2) * 640)::INT AS y2 FROM n",
)
def label_parse(spark, d):
    return M.label_boxes(relation(spark, d, "label_lines"))


@query("class_set", "SELECT o_orderkey AS image, coalesce(array_to_string([['shipwreck', 'aircraft', 'pipe', 'cylinder', 'ghost_net'][i + 1] FOR i IN list_sort(list_distinct([x FOR x IN [o_orderkey % 7, o_custkey % 6, o_orderkey % 3] IF x < 5]))], '|'), '') AS classes FROM orders")
def class_set(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("image"), M.class_set(F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 6, F.col("o_orderkey") % 3)).alias("classes"))


@query("sha_manifest", "SELECT concat('img/', doc_id, '.png') AS image_path, sha256(coalesce(text, '')) AS sha256 FROM documents")
def sha_manifest(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.format_string("img/%d.png", "doc_id").alias("image_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("registry_latest", "SELECT o_custkey AS name, arg_max(o_totalprice, o_orderkey) AS version, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def registry_latest(spark, d):
    return M.latest(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("name"), F.col("o_totalprice").alias("version"), F.col("o_orderkey").alias("seq")))


@query("label_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_todo(spark, d):
    return M.not_done(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


# --- kernels: where SQL can't express them, tests hold them against analytic cases -------------------------------------------


def numbered_pixels(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select(F.col("frame").cast("long").alias("frame"), "r", "c", "v")


@query(
    "components_8",
    """WITH RECURSIVE on_pixels AS MATERIALIZED (SELECT CAST(frame AS BIGINT) AS frame, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM [pixels] WHERE v >= 60),
    near AS MATERIALIZED (SELECT a.frame, a.r * 100000 + a.c AS px, b.r * 100000 + b.c AS other FROM on_pixels a CROSS JOIN range(-1, 2) y(dy) CROSS JOIN range(-1, 2) x(dx) JOIN on_pixels b ON b.frame = a.frame AND b.r = a.r + dy AND b.c = a.c + dx),
    walk AS (SELECT frame, px, px AS label, true AS moved, 0 AS k FROM near WHERE px = other
             UNION ALL SELECT frame, px, min(label), min(label) < min(own), k + 1 FROM (SELECT n.frame, n.px, w.label, CASE WHEN n.px = n.other THEN w.label END AS own, w.k, max(w.moved) OVER () AS going FROM walk w JOIN near n ON n.frame = w.frame AND n.other = w.px) WHERE going GROUP BY frame, px, k),
    last AS (SELECT frame, px, label FROM walk WHERE k = (SELECT max(k) FROM walk)),
    named AS (SELECT frame, px, dense_rank() OVER (PARTITION BY frame ORDER BY label) AS label FROM last)
    SELECT frame, label, count(*) AS area, min(px // 100000) AS y1, min(px % 100000) AS x1, max(px // 100000) AS y2, max(px % 100000) AS x2 FROM named GROUP BY frame, label""",
)
def components_8(spark, d):
    from ..operators import kernels as K

    rows = K.on_frames(numbered_pixels(spark, d), lambda x: K.components8(x >= 60))
    return rows.filter("v > 0").groupBy("frame", F.col("v").cast("long").alias("label")).agg(F.count("*").alias("area"), F.min("r").alias("y1"), F.min("c").alias("x1"), F.max("r").alias("y2"), F.max("c").alias("x2"))


@query("edge_density", "WITH RECURSIVE " + EDGES + " SELECT frame, round(edge_density, 6) AS edge_density FROM density")
def edge_density(spark, d):
    from ..operators import kernels as K

    return K.on_frames(numbered_pixels(spark, d), K.edges).groupBy("frame").agg(r6(F.avg("v")).alias("edge_density"))


@query("contrast_clahe")
def contrast_clahe(spark, d):
    from ..operators import kernels as K

    flat = R.stretched(pixels(spark, d)).select(F.col("frame").cast("long").alias("frame"), "r", "c", "v")
    return K.on_frames(flat, K.equalized)


@query("anomaly_map")
def anomaly_map(spark, d):
    from ..operators import kernels as K

    return K.on_frames(numbered_pixels(spark, d), lambda x: K.anomaly_map(x, lambda y: K.smoothed(y, 2.0), 64, 1.0)).select("frame", "r", "c", r6("v").alias("v"))


@query("anomaly_candidates")
def anomaly_candidates(spark, d):
    import numpy as np

    from ..operators import kernels as K

    def boxes(x: np.ndarray) -> np.ndarray:
        found = K.candidates(x, 60, morph=3, least_area=4)
        return np.array([[b["x1"], b["y1"], b["x2"], b["y2"], b["area"], b["peak"], b["mean"]] for b in found] or np.zeros((0, 7)))

    rows = K.on_frames(numbered_pixels(spark, d), boxes)
    return rows.groupBy("frame", F.col("r").alias("candidate")).pivot("c", list(range(7))).agg(F.first("v")).toDF("frame", "candidate", "x1", "y1", "x2", "y2", "area", "peak", "mean")


@query("survey_preprocess")
def survey_preprocess(spark, d):
    from . import survey

    rows = pixels(spark, d).groupBy(F.col("frame").cast("string").alias("frame"), F.col("r").cast("int").alias("ping")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("samples"))
    out = survey.run(rows, {"tiling": {"size": 32}})
    return out.qualities.select("tile", r6("score").alias("score"), "flag")


@query("jsf_scan", "SELECT vec_id AS frame, 0 AS ping, len(embedding) AS n, CAST(list_sum([trunc(CAST(x AS DOUBLE) * 10000) FOR x IN embedding]) AS DOUBLE) AS total FROM embeddings")
def jsf_scan(spark, d):
    import struct

    import pyarrow as pa

    from ..sources import readers

    def files(batches):
        for batch in batches:
            out = []
            for ping, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = bytearray(240) + struct.pack(f"<{len(x)}h", *[int(v * 10000) for v in x])
                struct.pack_into("<H", body, 114, len(x))
                out.append(struct.pack("<HBBHBBBBHI", 0x1601, 0, 0, 80, 0, 0, 0, 0, 0, len(body)) + bytes(body))
            yield pa.RecordBatch.from_pydict({"path": batch.column(0).cast(pa.string()), "content": pa.array(out, pa.binary())})

    made = relation(spark, d, "samples").select("ping", "x").mapInArrow(files, "path string, content binary")
    return readers.parsed(made, readers.jsf_pings).select(F.col("frame").cast("long").alias("frame"), "ping", F.size("starboard").alias("n"), F.aggregate("starboard", F.lit(0.0), lambda a, v: a + v).alias("total"))
