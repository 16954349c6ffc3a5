"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows.

The tables hold no volumes; lineitem stands in: a line number is a slice, a supplier a row, a part a column, the mean quantity an
intensity, and the return flag the view. `side` is the length of rows and columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import labels as L
from .operators import edges as E
from .operators import embeddings as V
from .operators import quality as Q
from .operators import raster as R
from .operators import segment as S
from .operators.components import components
from .plans import graphs as G
from .plans.conversion import counters
from .sources import metadata as M
from .streaming.incremental import counted

SIDE = 20
KEY = ("view_key", "scale", "label")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    cells = [F.col("l_returnflag").alias("view_key"), (F.col("l_linenumber") - 1).alias("z"), (F.col("l_suppkey") % side).cast("int").alias("y"), (F.col("l_partkey") % side).cast("int").alias("x")]
    return table(spark, sf_dir, "lineitem").groupBy(*cells).agg(F.avg("l_quantity").alias("q"))


def _block(*sizes: int, side: int = SIDE) -> Column:
    at = [F.floor(F.col(a) / s) for a, s in zip("zyx", sizes, strict=True)]
    ny, nx = (-(-side // s) for s in sizes[1:])
    return (((at[0] * ny + at[1]) * nx + at[2]) * 2 + (F.col("q") >= 25.5).cast("int")).cast("long")


def labelled(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Voxels with blocks, split by intensity, as regions at three scales."""
    v = voxels(spark, sf_dir, side)
    return v.select("*", _block(1, 2, 2, side=side).alias("lab_fine"), _block(2, 5, 5, side=side).alias("lab_med"), _block(4, 10, 10, side=side).alias("lab_coarse"))


VOX = f"vox AS (SELECT l_returnflag AS view_key, l_linenumber - 1 AS z, CAST(l_suppkey % {SIDE} AS INT) AS y, CAST(l_partkey % {SIDE} AS INT) AS x, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4)"


def _sql_block(*sizes: int) -> str:
    ny, nx = (-(-SIDE // s) for s in sizes[1:])
    return f"CAST(((z // {sizes[0]} * {ny} + y // {sizes[1]}) * {nx} + x // {sizes[2]}) * 2 + CAST(q >= 25.5 AS INT) AS BIGINT)"


LAB = f"{VOX}, lab AS (SELECT *, {_sql_block(1, 2, 2)} AS lab_fine, {_sql_block(2, 5, 5)} AS lab_med, {_sql_block(4, 10, 10)} AS lab_coarse FROM vox)"
REG = f"{LAB}, reg AS (SELECT view_key, z, y, x, q, 0 AS scale, lab_fine AS label FROM lab UNION ALL SELECT view_key, z, y, x, q, 1, lab_med FROM lab UNION ALL SELECT view_key, z, y, x, q, 2, lab_coarse FROM lab)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _faces(label: str) -> str:
    joins = " UNION ALL ".join(f"SELECT a.view_key, a.{label} AS u, b.{label} AS v FROM lab a JOIN lab b ON a.view_key = b.view_key AND " + " AND ".join(f"b.{x} = a.{x}{' + 1' if x == axis else ''}" for x in "zyx") for axis in "zyx")
    return f"faces AS ({joins}), pairs AS (SELECT view_key, least(u, v) AS u, greatest(u, v) AS v, count(*) AS contact FROM faces WHERE u <> v GROUP BY 1, 2, 3), rag AS (SELECT view_key, u AS src, v AS dst, contact FROM pairs UNION ALL SELECT view_key, v, u, contact FROM pairs)"


@query(f"WITH {LAB}, {_faces('lab_fine')} SELECT * FROM rag")
def rag_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contacts(labelled(spark, sf_dir), "lab_fine")


@query(f"WITH {REG} SELECT view_key, scale, label, count(*) AS n_voxels, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM reg GROUP BY 1, 2, 3")
def supervoxel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bounds(R.regions(labelled(spark, sf_dir)), KEY)


@query(f"WITH {REG} SELECT view_key, scale, label, string_agg(DISTINCT z::VARCHAR, ',' ORDER BY z::VARCHAR) AS slices FROM reg GROUP BY 1, 2, 3")
def slice_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slice_membership(R.regions(labelled(spark, sf_dir)), KEY).withColumn("slices", F.concat_ws(",", F.col("slices").cast("array<string>")))


def _moments(source: str, keys: str, value: str) -> str:
    on = " AND ".join(f"s.{k} = m.{k}" for k in keys.split(", "))
    return f"""m AS (SELECT {keys}, count({value}) AS n, avg({value}) AS mean, stddev_pop({value}) AS std, min({value}) AS min, max({value}) AS max,
  quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr FROM {source} GROUP BY ALL),
h AS (SELECT {', '.join(f'm.{k}' for k in keys.split(', '))}, sum(({value} - mean) ** 3) AS s3, sum(({value} - mean) ** 4) AS s4 FROM {source} s JOIN m ON {on} GROUP BY ALL)
SELECT {keys}, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(median, 6) AS median, round(iqr, 6) AS iqr,
  CASE WHEN n <= 2 OR std < 1e-9 THEN 0 ELSE round(s3 / n / std ** 3, 6) END AS skewness, CASE WHEN n <= 2 OR std < 1e-9 THEN 0 ELSE round(s4 / n / std ** 4 - 3, 6) END AS kurtosis FROM m JOIN h USING ({keys})"""


@query(f"WITH {_moments('events', 'event_type', 'value')}")
def intensity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(*R.distribution("value")))


@query(f"WITH {REG}, {_moments('reg', 'view_key, scale, label', 'q')}")
def node_intensity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.regions(labelled(spark, sf_dir)).groupBy(*KEY).agg(*R.distribution("q")))


#: Slices, rows and columns of the stand-in volumes.
DEPTH = 7


def sized(v: DataFrame) -> DataFrame:
    return v.withColumns({n: F.lit(k) for n, k in zip(R.SIZE, (DEPTH, SIDE, SIDE), strict=True)})


def _sql_gradient() -> str:
    parts = []
    for a, n in zip("zyx", (DEPTH, SIDE, SIDE), strict=True):
        rest = ", ".join(x for x in "zyx" if x != a)
        w = f"OVER (PARTITION BY view_key, {rest} ORDER BY {a})"
        parts.append(f"CASE WHEN lead({a}) {w} = {a} + 1 THEN lead(q) {w} WHEN {a} < {n - 1} THEN 0 END AS n{a}, CASE WHEN lag({a}) {w} = {a} - 1 THEN lag(q) {w} WHEN {a} > 0 THEN 0 END AS p{a}")
    d = " + ".join(f"pow(CASE WHEN n{a} IS NOT NULL AND p{a} IS NOT NULL THEN (n{a} - p{a}) / 2 WHEN n{a} IS NOT NULL THEN n{a} - q ELSE q - p{a} END, 2)" for a in "zyx")
    scales = " UNION ALL ".join(f"SELECT view_key, {i} AS scale, {name} AS label, g FROM grad" for i, name in enumerate(R.SCALES))
    return f"near AS (SELECT *, {', '.join(parts)} FROM lab), grad AS (SELECT *, sqrt({d}) AS g FROM near), each AS ({scales})"


@query(f"WITH {LAB}, {_sql_gradient()} SELECT view_key, scale, label, round(avg(g), 6) AS grad_mean, round(stddev_pop(g), 6) AS grad_std, round(max(g), 6) AS grad_max, round(quantile_cont(g, 0.9), 6) AS grad_p90 FROM each GROUP BY 1, 2, 3")
def node_gradient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.regions(R.gradient(sized(labelled(spark, sf_dir))))
    return rounded(g.groupBy(*KEY).agg(F.avg("gradient").alias("grad_mean"), F.stddev_pop("gradient").alias("grad_std"), F.max("gradient").alias("grad_max"), F.percentile("gradient", F.lit(0.9)).alias("grad_p90")))


@query(f"""WITH {REG}, b AS (SELECT view_key, scale, label, count(*) AS n, max(z) - min(z) + 1 AS dz, max(y) - min(y) + 1 AS dy, max(x) - min(x) + 1 AS dx, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM reg GROUP BY 1, 2, 3),
t AS (SELECT view_key, scale, avg(z) AS wz, avg(y) AS wy, avg(x) AS wx FROM reg GROUP BY 1, 2)
SELECT view_key, scale, label, n AS n_voxels, round(n / (dz * dy * dx), 6) AS compactness, round(greatest(dz, dy, dx) / least(dz, dy, dx), 6) AS elongation,
  round(sqrt((cz - wz) ** 2 + (cy - wy) ** 2 + (cx - wx) ** 2), 6) AS dist_mm, round(cz / {DEPTH - 1}, 6) AS norm_z, round(cy / {SIDE - 1}, 6) AS norm_y, round(cx / {SIDE - 1}, 6) AS norm_x FROM b JOIN t USING (view_key, scale)""")
def node_shape_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.regions(sized(labelled(spark, sf_dir)))
    both = R.shape(rows, KEY).join(R.location(rows, KEY), list(KEY))
    return rounded(both.select(*KEY, "n_voxels", "compactness", "elongation", "dist_mm", "norm_z", "norm_y", "norm_x"))


@query(f"""WITH {REG}, s AS (SELECT *, q / 50 AS v FROM lab),
b AS (SELECT view_key, scale, label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM reg GROUP BY 1, 2, 3),
p AS (SELECT view_key, scale, label, z0, z1, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM b) WHERE (y1 - y0 + 1) * (x1 - x0 + 1) >= 16),
f AS (SELECT p.view_key, scale, label, p.y, p.x, CAST(floor(least(1, greatest(0, coalesce(max(v), 0))) * 63) AS INT) AS i FROM p LEFT JOIN s ON s.view_key = p.view_key AND s.y = p.y AND s.x = p.x AND s.z BETWEEN z0 AND z1 GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT a.view_key, a.scale, a.label, a.i, b.i AS j FROM f a JOIN f b ON a.view_key = b.view_key AND a.scale = b.scale AND a.label = b.label AND a.y = b.y AND b.x = a.x + 1),
c AS (SELECT view_key, scale, label, i, j, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT view_key, scale, label, j, i FROM e) GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT view_key, scale, label, sum(n) AS t, sum(n * (i - j) ** 2) AS c, sum(n / (1 + (i - j) ** 2)) AS h, sum(n * n) AS e, sum(n * i) AS si, sum(n * i * i) AS sii, sum(n * i * j) AS sij FROM c GROUP BY 1, 2, 3)
SELECT view_key, scale, label, round(coalesce(c / t, 0), 6) AS contrast, round(coalesce(h / t, 0), 6) AS homogeneity, round(coalesce(sqrt(e) / t, 0), 6) AS energy,
  round(coalesce(CASE WHEN sii / t - (si / t) ** 2 < 1e-12 THEN 1 ELSE (sij / t - (si / t) ** 2) / (sii / t - (si / t) ** 2) END, 0), 6) AS correlation FROM b LEFT JOIN t USING (view_key, scale, label)""")
def glcm_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = labelled(spark, sf_dir).withColumn("scaled", F.col("q") / 50)
    return rounded(R.glcm(v, R.bounds(R.regions(v), KEY), KEY))


@query(f"""WITH {VOX}, h AS (SELECT view_key, z, CAST(floor(q) AS INT) AS level, count(*) AS n FROM vox GROUP BY 1, 2, 3),
c AS (SELECT view_key, z, level, sum(n) OVER u AS n, sum(n * level) OVER u AS s, sum(n) OVER w AS t, sum(n * level) OVER w AS m FROM h WINDOW w AS (PARTITION BY view_key, z), u AS (PARTITION BY view_key, z ORDER BY level)),
b AS (SELECT view_key, z, level, CASE WHEN t > n THEN round(n::DOUBLE * (t - n) * pow(s / n - (m - s) / (t - n), 2) / (t::DOUBLE * t), 6) ELSE 0 END AS between_ FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY view_key, z ORDER BY between_ DESC, level) AS r FROM b)
SELECT view_key, z, level AS threshold FROM k WHERE r = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.otsu(voxels(spark, sf_dir), F.floor("q"), ("view_key", "z"))


@query("SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.minmax_scaled(table(spark, sf_dir, "events"), "value", ("event_type",)).select("event_id", "scaled"))


@query("SELECT event_id, round((value - m) / (s + 1e-6), 6) AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.zscored(table(spark, sf_dir, "events"), "value", ("event_type",)).select("event_id", "z"))


_TARGETS = ((2.0, 3.5, 7.0), (8, 4, 2), (400, 100, 30), 450)


@query(f"""WITH {VOX}, n AS (SELECT view_key, count(*) AS n FROM vox GROUP BY 1), k AS (SELECT view_key, n,
  [{', '.join(f'greatest({lo}, least({hi}, CAST(round_even(n / {s**3}, 0) AS BIGINT)))' for s, lo, hi in zip(*_TARGETS[:3], strict=True))}] AS raw FROM n)
SELECT view_key, n AS n_tissue, array_to_string(CASE WHEN list_sum(raw) > {_TARGETS[3]} THEN list_transform(raw, lambda k: greatest(1000, CAST(round_even(k * ({_TARGETS[3]}::DOUBLE / list_sum(raw)), 0) AS BIGINT))) ELSE raw END, ',') AS targets FROM k""")
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = voxels(spark, sf_dir).groupBy("view_key").agg(F.count("*").alias("n_tissue"))
    return R.adaptive_targets(n, (1.0, 1.0, 1.0), *_TARGETS).withColumn("targets", F.concat_ws(",", F.col("targets").cast("array<string>")))


_GRID = """b AS (SELECT view_key, count(*) AS n, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM vox GROUP BY 1),
l AS (SELECT *, pow(n / least(60, n), 1.0 / 3) AS length FROM b), s AS (SELECT *, greatest(1, CAST(round_even(length, 0) AS INT)) AS t FROM l),
g AS (SELECT *, CAST(floor((z1 - z0 - t // 2) / t) + 1 AS INT) AS gz, CAST(floor((y1 - y0 - t // 2) / t) + 1 AS INT) AS gy, CAST(floor((x1 - x0 - t // 2) / t) + 1 AS INT) AS gx FROM s),
kz AS (SELECT view_key, unnest(range(gz)) AS kz FROM g), ky AS (SELECT view_key, unnest(range(gy)) AS ky FROM g), kx AS (SELECT view_key, unnest(range(gx)) AS kx FROM g),
c0 AS (SELECT view_key, CAST((kz * gy + ky) * gx + kx AS BIGINT) AS k, kz, ky, kx, z0 + t // 2 + kz * t AS cz, y0 + t // 2 + ky * t AS cy, x0 + t // 2 + kx * t AS cx FROM g JOIN kz USING (view_key) JOIN ky USING (view_key) JOIN kx USING (view_key)),
c AS (SELECT c0.*, coalesce(q, 0) AS ci FROM c0 LEFT JOIN vox v ON v.view_key = c0.view_key AND v.z = cz AND v.y = cy AND v.x = cx),
v AS (SELECT vox.*, length, least(gz - 1, greatest(0, CAST(floor((z - z0 - t // 2) / t) AS INT))) AS vz, least(gy - 1, greatest(0, CAST(floor((y - y0 - t // 2) / t) AS INT))) AS vy, least(gx - 1, greatest(0, CAST(floor((x - x0 - t // 2) / t) AS INT))) AS vx FROM vox JOIN g USING (view_key))"""


def _assign(centroids: str, where: str, name: str) -> str:
    return f"""{name} AS (SELECT view_key, z, y, x, q, k FROM (SELECT v.view_key, v.z, v.y, v.x, v.q, c.k, row_number() OVER (PARTITION BY v.view_key, v.z, v.y, v.x ORDER BY round(pow(v.q - c.ci, 2) + pow(1 / v.length, 2) * (pow(v.z - c.cz, 2) + pow(v.y - c.cy, 2) + pow(v.x - c.cx, 2)), 9), c.k) AS r
  FROM v JOIN {centroids} c ON c.view_key = v.view_key AND {where}) WHERE r = 1)"""


_NEAR = "abs(c.kz - vz) <= 1 AND abs(c.ky - vy) <= 1 AND abs(c.kx - vx) <= 1"
_UPDATE = "u AS (SELECT c.view_key, c.k, kz, ky, kx, coalesce(avg(z), any_value(cz)) AS cz, coalesce(avg(y), any_value(cy)) AS cy, coalesce(avg(x), any_value(cx)) AS cx, coalesce(avg(q), any_value(ci)) AS ci FROM c LEFT JOIN a ON a.view_key = c.view_key AND a.k = c.k GROUP BY 1, 2, 3, 4, 5)"


@query(f"WITH {VOX}, {_GRID}, {_assign('c', _NEAR, 'a')} SELECT view_key, z, y, x, k FROM a")
def slic_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    return S.supervoxels(v, 60, iterations=0).drop("q")


@query(f"WITH {VOX}, {_GRID}, {_assign('c', _NEAR, 'a')}, {_UPDATE}, {_assign('u', _NEAR, 'a2')} SELECT view_key, z, y, x, k FROM a2")
def slic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.supervoxels(voxels(spark, sf_dir), 60, iterations=1).drop("q")


def _slic_sql(iterations: int) -> str:
    """All updates, one after another; tables are named by their step."""
    steps, now = "", "c"
    for i in range(iterations):
        steps += f", {_assign(now, _NEAR, f'a{i}').replace(' AS (', ' AS MATERIALIZED (', 1)}, {_UPDATE.replace('u AS (', f'u{i} AS MATERIALIZED (', 1).replace('FROM c LEFT JOIN a ON', f'FROM {now} c LEFT JOIN a{i} a ON')}"
        now = f"u{i}"
    return f"WITH {VOX}, {_GRID}{steps}, {_assign(now, _NEAR, 'last')}, d AS (SELECT view_key, q, dense_rank() OVER (PARTITION BY view_key ORDER BY k) - 1 AS dense FROM last) SELECT view_key, CAST(dense AS INT) AS dense, count(*) AS n_voxels, round(avg(q), 6) AS mean_q FROM d GROUP BY 1, 2"


@query(_slic_sql(8))
def slic_supervoxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_labels(S.supervoxels(voxels(spark, sf_dir), 60), "k").groupBy("view_key", "dense").agg(F.count("*").alias("n_voxels"), F.round(F.avg("q"), 6).alias("mean_q"))


@query(f"WITH {LAB} SELECT DISTINCT view_key, lab_med, dense_rank() OVER (PARTITION BY view_key ORDER BY lab_med) - 1 AS dense FROM lab")
def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_labels(labelled(spark, sf_dir), "lab_med").select("view_key", "lab_med", F.col("dense").cast("long").alias("dense")).distinct()


_PARENT = "p AS (SELECT view_key, child, parent, n FROM (SELECT view_key, lab_fine AS child, lab_med AS parent, count(*) AS n, row_number() OVER (PARTITION BY view_key, lab_fine ORDER BY count(*) DESC, lab_med) AS r FROM lab GROUP BY 1, 2, 3) WHERE r = 1)"


@query(f"WITH {LAB}, {_PARENT} SELECT view_key, child, parent, n AS n_shared FROM p")
def parent_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parents(labelled(spark, sf_dir), "lab_fine", "lab_med")


#: Parents are numbered after a view's children.
_AFTER = "o AS (SELECT view_key, max(lab_fine) + 1 AS k FROM lab GROUP BY 1)"


@query(f"WITH {LAB}, {_PARENT}, {_AFTER} SELECT view_key, child AS src, parent + k AS dst FROM p JOIN o USING (view_key) UNION ALL SELECT view_key, parent + k, child FROM p JOIN o USING (view_key)")
def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(labelled(spark, sf_dir))


def _hierarchy(v: DataFrame) -> DataFrame:
    sizes = v.groupBy("view_key").agg((F.max("lab_fine") + 1).alias("k"))
    return E.hierarchy(R.parents(v, "lab_fine", "lab_med").join(sizes, "view_key"), F.lit(0).cast("long"), F.col("k"), G.KEYS)


def _knn_sql(k: int) -> str:
    return f"""l AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1), z AS (SELECT vec_id, i, (v - m) / (d + 1e-6) AS v FROM l JOIN s USING (i)),
u AS (SELECT vec_id, list(v ORDER BY i) AS z, sqrt(sum(v * v)) AS size FROM z GROUP BY 1), w AS (SELECT vec_id, list_transform(z, lambda x: x / size) AS u FROM u),
n AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 12) DESC, b.vec_id) AS r FROM w a JOIN w b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst FROM n WHERE r <= {k} UNION SELECT dst, src FROM n WHERE r <= {k})"""


def knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return E.knn(E.unit_zscored(table(spark, sf_dir, "embeddings"), "embedding", (), "vec_id"), k, "vec_id")


@query(f"WITH {_knn_sql(6)} SELECT * FROM knn")
def knn_edges_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir, 6)


@query(f"WITH {_knn_sql(3)} SELECT * FROM knn")
def knn_edges_med(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir, 3)


@query(f"""WITH {LAB}, {_faces('lab_fine')}, {_PARENT}, {_AFTER},
n AS (SELECT view_key, 0 AS scale, lab_fine AS node, count(*) AS n, avg(x) AS px, avg(y) AS py, avg(z) AS pz, avg(q) AS f1, max(q) AS f2 FROM lab GROUP BY 1, 3
  UNION ALL SELECT view_key, 1, lab_med + any_value(k), count(*), avg(x), avg(y), avg(z), avg(q), max(q) FROM lab JOIN o USING (view_key) GROUP BY view_key, lab_med),
z AS (SELECT *, {', '.join(f'({f} - avg({f}) OVER {w}) / (stddev_pop({f}) OVER {w} + 1e-6) AS {c}{f}' for f in ('f1', 'f2') for c, w in (('s', '(PARTITION BY view_key, scale)'), ('a', '(PARTITION BY view_key)')))} FROM n),
e AS (SELECT view_key, src, dst, contact, 0 AS edge_type FROM rag UNION ALL SELECT view_key, child, parent + k, 0, 2 FROM p JOIN o USING (view_key) UNION ALL SELECT view_key, parent + k, child, 0, 2 FROM p JOIN o USING (view_key))
SELECT view_key, src, dst, edge_type, round(b.px - a.px, 6) AS dx, round(b.py - a.py, 6) AS dy, round(b.pz - a.pz, 6) AS dz, round(sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2 + (b.pz - a.pz) ** 2), 6) AS dist,
  CAST(abs(b.pz - a.pz) < 1e-6 AS INT) AS same_z, contact, round(contact / greatest(1, least(a.n, b.n)), 6) AS contact_ratio,
  round(CASE WHEN edge_type = 2 THEN sqrt((b.af1 - a.af1) ** 2 + (b.af2 - a.af2) ** 2) ELSE sqrt((b.sf1 - a.sf1) ** 2 + (b.sf2 - a.sf2) ** 2) END, 6) AS fdist
FROM e JOIN z a USING (view_key) JOIN z b USING (view_key) WHERE a.node = src AND b.node = dst""")
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of contacts between fine regions, and of the hierarchy; distances are of z-scores, by scale and over all nodes."""
    v = labelled(spark, sf_dir)
    start = v.groupBy("view_key").agg((F.max("lab_fine") + 1).alias("k"))
    figures = [F.count("*").alias("n_voxels"), *[F.avg(a).alias(f"p{a}") for a in "xyz"], F.array(F.avg("q"), F.max("q")).alias("raw")]
    fine = v.groupBy("view_key", F.lit(0).alias("scale"), F.col("lab_fine").alias("node")).agg(*figures)
    med = v.join(start, "view_key").groupBy("view_key", F.lit(1).alias("scale"), (F.col("lab_med") + F.col("k")).alias("node")).agg(*figures)
    nodes = E.zscored_vectors(fine.unionByName(med), "raw", ("view_key", "scale"), "node", "features")
    nodes = E.zscored_vectors(nodes, "raw", G.KEYS, "node", "across")
    e = E.assembled([(R.contacts(v, "lab_fine"), E.RAG), (_hierarchy(v), E.HIERARCHY)], G.KEYS)
    return rounded(E.attributes(e, nodes, G.KEYS)).replace(-0.0, 0.0)


@query(f"""WITH {LAB}, {_faces('lab_fine')}, {_PARENT}, {_AFTER} SELECT view_key, src, dst, contact, 0 AS edge_type FROM rag
UNION ALL SELECT view_key, child, parent + k, 0, 2 FROM p JOIN o USING (view_key) UNION ALL SELECT view_key, parent + k, child, 0, 2 FROM p JOIN o USING (view_key)""")
def assemble_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = labelled(spark, sf_dir)
    return E.assembled([(R.contacts(v, "lab_fine"), E.RAG), (_hierarchy(v), E.HIERARCHY)], G.KEYS)


@query("SELECT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION SELECT l_suppkey + 1000000, l_partkey FROM lineitem")
def edge_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.symmetrised(_graph(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem")
def edge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).distinct()


#: Every vector is linked with the half of its number, if that is odd: chains that double.
_SPARSE = "SELECT vec_id AS a, CASE WHEN vec_id // 2 % 2 = 1 THEN vec_id // 2 ELSE vec_id END AS b FROM embeddings"


@query(f"WITH RECURSIVE e AS ({_SPARSE}), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM d UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b) SELECT a AS id, min(b) AS component FROM r GROUP BY 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_links(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, half = F.col("vec_id"), F.expr("vec_id div 2")
    return table(spark, sf_dir, "embeddings").select(i.alias("a"), F.when(half % 2 == 1, half).otherwise(i).alias("b"))


@query(f"""WITH RECURSIVE {LAB}, {_faces('lab_med')}, n AS (SELECT view_key, count(DISTINCT lab_med) AS n FROM lab GROUP BY 1), e AS (SELECT view_key, count(*) AS e FROM rag GROUP BY 1),
r(view_key, a, b) AS (SELECT view_key, src, src FROM rag UNION SELECT r.view_key, r.a, rag.dst FROM r JOIN rag ON rag.view_key = r.view_key AND rag.src = r.b),
k AS (SELECT view_key, a, min(b) AS c FROM r GROUP BY 1, 2), s AS (SELECT view_key, max(m) AS m FROM (SELECT view_key, c, count(*) AS m FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT view_key, n AS n_nodes, round(2 * e / n, 6) AS avg_degree, round(m / n, 6) AS lcc_frac FROM n JOIN e USING (view_key) JOIN s USING (view_key)""")
def qc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = labelled(spark, sf_dir)
    return rounded(Q.metrics(v.select("view_key", F.col("lab_med").alias("node")).distinct(), R.contacts(v, "lab_med"), G.KEYS))


#: Edges with faults: ends out of bounds, loops, scales that don't follow each other, edges one way.
_FAULTY = "SELECT l_returnflag AS view_key, l_partkey % 60 - 1 AS src, l_suppkey % 58 AS dst, CAST(l_linenumber % 3 AS INT) AS edge_type FROM lineitem"
_SIZES = "SELECT DISTINCT l_returnflag AS view_key, CAST(30 + 10 * CAST(l_returnflag = 'N' AS INT) AS BIGINT) AS k_fine, CAST(20 AS BIGINT) AS k_med, CAST(10 - 9 * CAST(l_returnflag = 'R' AS INT) AS BIGINT) AS k_coarse FROM lineitem"


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    e = t.select(flag.alias("view_key"), (F.col("l_partkey") % 60 - 1).alias("src"), (F.col("l_suppkey") % 58).alias("dst"), (F.col("l_linenumber") % 3).cast("int").alias("edge_type")).where("view_key <> 'N' OR src >= 0")
    s = t.select(flag.alias("view_key"), (F.lit(30) + 10 * (flag == "N").cast("int")).cast("long").alias("k_fine"), F.lit(20).cast("long").alias("k_med"), (F.lit(10) - 9 * (flag == "R").cast("int")).cast("long").alias("k_coarse")).distinct()
    return e, s


_AUDIT = f"""e AS (SELECT * FROM ({_FAULTY}) WHERE view_key <> 'N' OR src >= 0), s AS ({_SIZES}),
t AS (SELECT *, CASE WHEN src < k_fine THEN 0 WHEN src < k_fine + k_med THEN 1 ELSE 2 END AS a, CASE WHEN dst < k_fine THEN 0 WHEN dst < k_fine + k_med THEN 1 ELSE 2 END AS b, k_fine + k_med + k_coarse AS n FROM e JOIN s USING (view_key)),
c AS (SELECT view_key, sum(CAST(src < 0 OR src >= n AS INT) + CAST(dst < 0 OR dst >= n AS INT)) AS oob, count(*) FILTER (src = dst) AS loops, count(*) FILTER (edge_type = 0) AS e_rag, count(*) FILTER (edge_type = 1) AS e_knn, count(*) FILTER (edge_type = 2) AS e_hier,
  count(*) FILTER (edge_type = 2 AND abs(a - b) = 1 AND least(a, b) = 0) AS fm, count(*) FILTER (edge_type = 2 AND abs(a - b) = 1 AND least(a, b) = 1) AS mc, count(*) FILTER (edge_type = 2 AND abs(a - b) = 2) AS fc, count(*) FILTER (edge_type = 2 AND a = b) AS ss FROM t GROUP BY 1),
d AS (SELECT DISTINCT view_key, src, dst FROM e WHERE edge_type = 0), m AS (SELECT x.view_key, count(*) AS n, count(*) FILTER (y.src IS NULL) AS miss FROM d x LEFT JOIN d y ON y.view_key = x.view_key AND y.src = x.dst AND y.dst = x.src GROUP BY 1),
audit AS (SELECT view_key, CAST(oob AS BIGINT) AS edge_oob_count, loops AS self_loop_count, e_rag, e_knn, e_hier, CASE WHEN oob = 0 THEN fm ELSE 0 END AS hier_fine_med, CASE WHEN oob = 0 THEN mc ELSE 0 END AS hier_med_coarse,
  CASE WHEN oob = 0 THEN fc ELSE 0 END AS hier_fine_coarse_invalid, CASE WHEN oob = 0 THEN ss ELSE 0 END AS hier_same_scale_invalid, round(CASE WHEN oob = 0 AND e_hier > 0 THEN (fc + ss) / e_hier ELSE 0 END, 6) AS hier_invalid_frac,
  round(coalesce(miss / n, 0), 6) AS rag_missing_reverse_frac FROM c LEFT JOIN m USING (view_key))"""


@query(f"WITH {_AUDIT} SELECT * FROM audit")
def relation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.audit(*_faulty(spark, sf_dir), G.KEYS))


@query(f"WITH {_AUDIT} SELECT view_key, src, dst FROM d ANTI JOIN (SELECT view_key, dst AS src, src AS dst FROM d) USING (view_key, src, dst)")
def missing_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_reverse(_faulty(spark, sf_dir)[0].where("edge_type = 0"), G.KEYS)


@query(f"""WITH {_AUDIT}, v AS (SELECT s_nationkey AS g, s_suppkey, CAST(s_suppkey % 5 AS INT) AS f FROM supplier)
SELECT s_suppkey, view_key, CASE WHEN f = 0 THEN 'low_tissue_coverage' WHEN f = 1 THEN 'disconnected_graph' WHEN f = 2 THEN 'low_avg_degree' WHEN edge_oob_count > 0 THEN 'edge_index_oob' WHEN self_loop_count > 0 AND f = 3 THEN 'self_loops'
  WHEN hier_fine_coarse_invalid > 0 THEN 'invalid_fine_coarse_hierarchy' WHEN hier_same_scale_invalid > 0 THEN 'invalid_same_scale_hierarchy' WHEN rag_missing_reverse_frac > 0 THEN 'rag_missing_reverse_edges' ELSE '' END AS reason FROM v, audit""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = Q.audit(*_faulty(spark, sf_dir), G.KEYS)  # a row for each of three views
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("f"))
    rows = s.crossJoin(F.broadcast(audit)).withColumns({"tissue_coverage": F.when(F.col("f") == 0, 0.9).otherwise(1.0), "lcc_frac": F.when(F.col("f") == 1, 0.5).otherwise(0.9), "avg_degree": F.when(F.col("f") == 2, 1.0).otherwise(2.0), "self_loop_count": F.when(F.col("f") == 3, F.col("self_loop_count")).otherwise(0)})
    return rows.select("s_suppkey", "view_key", Q.gate().alias("reason"))


@query("SELECT doc_id, quality AS label FROM (SELECT doc_id, CAST(quality > 0 AS INT) AS quality FROM labels)")
def binary_label_cancer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", L.binary_label("cancer", F.col("quality").cast("string")).alias("label"))


@query("SELECT doc_id, CAST(coalesce(toxic, 0) > 0 OR n_chars % 7 > 5 AS INT) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def binary_label_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", L.binary_label("abnormal", F.col("toxic"), (F.col("n_chars") % 7 - 5).cast("string"), F.lit("")).alias("label"))


_FLAGS = """f AS (SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS g, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS n, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS b, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS c, n_chars % 2 AS mask, CAST(doc_id % 2 AS INT) AS fb FROM documents),
r AS (SELECT *, CASE WHEN g IS NOT NULL AND n IS NULL AND b IS NULL AND c IS NULL THEN g WHEN n = 1 AND b = 1 THEN CASE WHEN mask = 1 THEN 2 ELSE 0 END WHEN n = 1 THEN 0 WHEN c = 1 THEN 1 WHEN b = 1 THEN 2 WHEN n = 0 AND b IS NULL AND c IS NULL THEN 1 ELSE fb END AS res FROM f),
p AS (SELECT *, CASE WHEN b = 1 AND c = 1 THEN 'benign_and_cancer' WHEN g IS NOT NULL AND g <> res THEN 'conflict' ELSE '' END AS problem FROM r)"""


def _flags(spark: SparkSession, sf_dir: str) -> list:
    i, n = F.col("doc_id"), F.col("n_chars")
    g = F.when(n % 6 < 3, n % 6)
    normal, benign, cancer = F.when(i % 4 < 2, i % 4), F.when(i % 5 < 2, 1 - i % 5), F.when(i % 3 < 2, 1 - i % 3)
    return [g, normal, benign, cancer, F.when(n % 2 == 1, "m").otherwise(" "), i % 2]


@query(f"WITH {_FLAGS} SELECT doc_id, CASE WHEN problem = '' THEN CAST(res AS INT) ELSE -1 END AS label FROM p")
def class_label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(L.class_label(*_flags(spark, sf_dir)), F.lit(-1)).alias("label"))


@query(f"WITH {_FLAGS} SELECT problem, count(*) AS n FROM p GROUP BY 1")
def class_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(L.label_problem(*_flags(spark, sf_dir)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(F.col("l_orderkey").cast("string").alias("patient_id"), F.col("l_linenumber").cast("string").alias("StudyInstanceUID"), F.lit(" LCC ").alias("View"), F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("s"), F.col("l_suppkey").cast("string"))).alias("file_path"))
    return M.path_map(rows, F.col("file_path"))


_PATHS = "m AS (SELECT CAST(l_orderkey AS VARCHAR) AS PatientID, CAST(l_linenumber AS VARCHAR) AS StudyUID, 'lcc' AS View, min('p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || 's' || CAST(l_suppkey AS VARCHAR)) AS path FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1, 2)"


@query(f"WITH {_PATHS} SELECT * FROM m")
def path_map_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return M.labels(o.select(F.col("o_orderkey").cast("string").alias("PatientID"), F.lit("1").alias("StudyUID"), F.lit("LCC ").alias("View"), (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("Cancer"), F.col("o_orderpriority").alias("split")))


_LOOKUP = f"WITH {_PATHS}, v AS (SELECT CAST(o_orderkey AS VARCHAR) AS PatientID, '1' AS StudyUID, 'lcc' AS View FROM orders) SELECT PatientID, path, CASE WHEN path IS NULL THEN 'no_matching_path' ELSE '' END AS reason FROM v LEFT JOIN m USING (PatientID, StudyUID, View)"


@query(_LOOKUP)
def path_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_paths(_views(spark, sf_dir), _paths(spark, sf_dir)).select("PatientID", "path", "reason")


@query(f"SELECT PatientID, reason FROM ({_LOOKUP}) WHERE reason <> ''")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_paths(_views(spark, sf_dir), _paths(spark, sf_dir)).where("reason <> ''").select("PatientID", "reason")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.largest(table(spark, sf_dir, "documents"), "source", "lang")


@query(r"SELECT c_custkey, coalesce(nullif(regexp_replace(trim(s), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'series') AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE ' ' || c_name || ' / ' || c_mktsegment || ' ' END AS s FROM customer)")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" / "), "c_mktsegment", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", L.sanitize_name(s).alias("name"))


@query("SELECT c_custkey, trim(c_name) || '__' || c_mktsegment || '__lbl' || CAST(c_nationkey % 3 AS VARCHAR) || '__clean0' AS graph, replace(c_name, '#', '_') || '/' || replace(c_name, '#', '_') || '_S' || CAST(c_custkey AS VARCHAR) || '_' || upper(c_mktsegment) || '_lbl' || CAST(c_nationkey % 3 AS VARCHAR) || '.tif' AS volume FROM customer")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("c_nationkey") % 3
    study = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.graph_name(F.col("c_name"), F.col("c_mktsegment"), label, F.lit("clean"), F.lit(0)).alias("graph"), L.volume_path(F.col("c_name"), study, F.lower("c_mktsegment"), label).alias("volume"))


@query("SELECT c_custkey, CAST('0x' || substr(md5('123|' || c_name || '|' || c_mktsegment || '|augmix|1'), 1, 8) AS BIGINT) AS seed FROM customer")
def output_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", L.output_seed(123, F.col("c_name"), F.col("c_mktsegment"), F.lit("augmix"), F.lit(1)).alias("seed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def patient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("PatientID"))
    views = table(spark, sf_dir, "orders").withColumn("PatientID", F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return M.of_patients(views, wanted).select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority AS split, count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS written, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders GROUP BY 1")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "written").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return counters(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), status.alias("status")))


@query("SELECT o_orderpriority AS split, o_orderstatus AS reason, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY 1, 2")
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("reason"), "o_orderkey")
    once = M.distinct_failures(rows, "o_orderkey").withColumn("_at", F.monotonically_increasing_id())
    return once.select("split", "reason", F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))  # few rows: distinct reasons


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS made FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE made IS NULL OR made < o_orderdate + INTERVAL 30 DAY")
def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("modified"))
    outputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("modified"))
    return M.outdated(sources, outputs, ("o_orderkey",), 0)


@query("SELECT event_id, value, CAST(-1 AS BIGINT) AS user_id, 'ok' AS status FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, -1, user_id, 'skip_exists' FROM events WHERE event_id % 2 = 1")
def summary_schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    union = M.union_ledgers(e.where("event_id % 2 = 0").select("event_id", "value", F.lit("ok").alias("status")), e.where("event_id % 2 = 1").select("event_id", "user_id", F.lit("skip_exists").alias("status")))
    return union.fillna(-1)


@query("SELECT c_custkey, k AS aug_kind, i AS aug_idx FROM customer, (VALUES ('clean', 0), ('augmix', 1), ('augmix', 2), ('diffusion', 1), ('adversarial', 1)) v(k, i)")
def variant_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.variants(table(spark, sf_dir, "customer").select("c_custkey"))


def _step_sql(steps: int, eps: float) -> str:
    out = f"""{_knn_sql(3)}, x AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2 FROM embeddings), st AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM x),
z0 AS (SELECT node, (f1 - m1) / (s1 + 1e-6) AS f1, (f2 - m2) / (s2 + 1e-6) AS f2 FROM x, st)"""
    for i in range(steps):
        move = [f"greatest(-3, least(3, z.f{c} + {eps / steps} * coalesce(sign(round(d * z.f{c} - a{c}, 9)), 0))) AS f{c}" for c in (1, 2)]
        out += f""", a{i} AS (SELECT src AS node, count(*)::DOUBLE AS d, sum(f1) AS a1, sum(f2) AS a2 FROM knn JOIN z{i} ON node = dst GROUP BY 1), z{i + 1} AS (SELECT z.node, {', '.join(move)} FROM z{i} z LEFT JOIN a{i} ON a{i}.node = z.node)"""
    return f"WITH {out} SELECT node, round(f1 * (s1 + 1e-6) + m1, 6) AS f1, round(f2 * (s2 + 1e-6) + m2, 6) AS f2 FROM z{steps}, st"


@query(_step_sql(3, 0.5))
def adversarial_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("f1"), F.col("embedding")[1].cast("double").alias("f2"))
    return rounded(E.adversarial(x, knn(spark, sf_dir, 3), ["f1", "f2"])).replace(-0.0, 0.0)


def _refreshed_sql(steps: int, eps: float) -> str:
    moved = _step_sql(steps, eps).replace("SELECT node, round(f1 * (s1 + 1e-6) + m1, 6) AS f1, round(f2 * (s2 + 1e-6) + m2, 6) AS f2", "SELECT node, f1 * (s1 + 1e-6) + m1 AS f1, f2 * (s2 + 1e-6) + m2 AS f2").removeprefix("WITH ")
    head, _, tail = moved.rpartition(" SELECT node")
    z = ", ".join(f"(f{c} - avg(f{c}) OVER ()) / (stddev_pop(f{c}) OVER () + 1e-6) AS f{c}" for c in (1, 2))
    return f"WITH {head}, moved AS (SELECT node{tail}), again AS (SELECT node, {z} FROM moved) SELECT src, dst, round(sqrt((b.f1 - a.f1) ** 2 + (b.f2 - a.f2) ** 2), 5) AS fdist FROM knn JOIN again a ON a.node = src JOIN again b ON b.node = dst"


@query(_refreshed_sql(3, 0.5))
def adversarial_fdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("f1"), F.col("embedding")[1].cast("double").alias("f2"))
    e = knn(spark, sf_dir, 3)
    pushed = E.adversarial(x, e, ["f1", "f2"]).select("node", F.array("f1", "f2").alias("features"))
    return rounded(E.refreshed(e, pushed), 5)


_DIMS, _COMPONENTS = 8, 64


def _projection_sql() -> str:
    rows = ", ".join(f"({i}, [{', '.join(f'{v!r}::DOUBLE' for v in d)}])" for i, d in enumerate(V.projection(_COMPONENTS, _DIMS)))
    return f"WITH d(i, d) AS (VALUES {rows}) SELECT vec_id, string_agg(CAST(CAST(round(list_dot_product(CAST(embedding AS DOUBLE[]), d) * 1000000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS micro FROM embeddings, d GROUP BY 1"


@query(_projection_sql())
def embedding_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors along fixed orthonormal directions, in millionths."""
    p = V.projected(table(spark, sf_dir, "embeddings"), "embedding", _DIMS, _COMPONENTS)
    return p.select("vec_id", F.concat_ws(",", F.transform("projected", lambda v: F.round(v * 1000000).cast("long").cast("string"))).alias("micro"))


@query(f"""WITH {REG}, c AS (SELECT view_key, scale, label, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM reg GROUP BY 1, 2, 3), g AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)
SELECT view_key, scale, label, round(v, 6) AS v FROM c LEFT JOIN g ON id = CAST(round_even(cz, 0) AS INT) * 16 + least(3, CAST(floor(cy * 4 / {SIDE}) AS INT)) * 4 + least(3, CAST(floor(cx * 4 / {SIDE}) AS INT))""")
def embedding_at_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 4 x 4 vectors over each slice, the same for each view, sampled where regions have their centroids."""
    rows = sized(labelled(spark, sf_dir))
    regions = R.regions(rows)
    i = F.col("vec_id")
    cells = table(spark, sf_dir, "embeddings").where(i < DEPTH * 16).select(F.expr("vec_id div 16").cast("int").alias("z"), F.expr("vec_id div 4 % 4").cast("int").alias("row"), (i % 4).cast("int").alias("col"), F.col("embedding").alias("vector"))
    grid = rows.select("view_key", "z").distinct().join(cells, "z")
    nodes = R.location(regions, KEY).withColumns({n: F.lit(k) for n, k in zip(R.SIZE, (DEPTH, SIDE, SIDE), strict=True)})
    return V.at_centroids(nodes, grid, (4, 4)).select(*KEY, F.round(F.col("vector")[0].cast("double"), 6).alias("v"))


@query("SELECT event_id, round(greatest(-65500, least(65500, value * 1000 - 100000)), 6) AS clipped FROM events")
def fp16_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(L.half_clip(F.col("value") * 1000 - 100000), 6).alias("clipped"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return counted(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = labelled(spark, sf_dir)
    for name in R.SCALES:
        v = R.dense_labels(v, name, out="_d").drop(name).withColumn(name, F.col("_d").cast("long")).drop("_d")
    return rounded(G.built(v)[2].select("view_key", "n_nodes", "avg_degree", "lcc_frac", "tissue_coverage", "e_rag", "e_knn", "e_hier", "status"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of the stand-in raster, scaled to 0..1, as slices; a place without a voxel is 0."""
    import numpy as np
    import pyarrow as pa

    from .operators.kernels import SLICE

    def dense(key: tuple, t: pa.Table) -> pa.Table:
        img = np.zeros((SIDE, SIDE), "<f4")
        img[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("scaled").to_numpy()
        return pa.table({"view_key": pa.array([key[0].as_py()]), "z": pa.array([key[1].as_py()], pa.int32()), "h": pa.array([SIDE], pa.int32()), "w": pa.array([SIDE], pa.int32()), "px": pa.array([img.tobytes()], pa.binary())})

    return R.minmax_scaled(voxels(spark, sf_dir), "q").groupBy("view_key", "z").applyInArrow(dense, SLICE)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("view_key", "z", "h", "w", F.sha2("px", 256).alias("px_sha256"))


@query()
def kernel_clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import kernels as K

    return _digest(K.over_slices(_slices(spark, sf_dir), lambda s: K.clahe((s * 255).astype("u1"), 0.4) / 255.0))


@query()
def kernel_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import kernels as K

    return _digest(K.over_views(_slices(spark, sf_dir), lambda v: K.tissue(v, 20).astype("f4")))


@query()
def kernel_slic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import kernels as K

    return _digest(K.over_views(_slices(spark, sf_dir), lambda v: K.slic(v, v > 0, 60).astype("f4")))


@query()
def variant_augmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import kernels as K

    return _digest(K.over_views(_slices(spark, sf_dir), lambda v: K.augmix(v, 7)))


@query()
def variant_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import kernels as K

    return _digest(K.over_views(_slices(spark, sf_dir), lambda v: K.diffusion(v, 7)))
