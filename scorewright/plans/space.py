"""Spatial queries over the embeddings' first three elements as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.operators import nearest as N
from scorewright.operators import spatial as P
from scorewright.plans.base import query, rounded, table
from scorewright.sources import io
from scorewright.sources.staging import fresh_path

_PTS = "p as (select 's' || (vec_id % 3) as scene_id, vec_id as point_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("scene_id"), F.col("vec_id").alias("point_id"), *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")), "label"
    )


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    clusters = P.dbscan(points, 0.08, 3)
    return P.instances(points.join(clusters, "point_id"))


@query(f"with {_PTS} select scene_id, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(z) as z_min, max(z) as z_max from p group by 1")
def pts_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS2."""
    return P.scene_bounds(_points(spark, sf_dir))


@query(f"""
    with {_PTS}, m as (select scene_id, min(x) as a, min(y) as b, min(z) as c from p group by 1)
    select scene_id, label, floor((x - a) / 0.1)::bigint as ix, floor((y - b) / 0.1)::bigint as iy, floor((z - c) / 0.1)::bigint as iz, count(*) as n from p join m using (scene_id) group by 1, 2, 3, 4, 5""")
def pts_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS3."""
    return P.voxelize(_points(spark, sf_dir), 0.1)


@query(f"""
    with recursive {_PTS}, v as (select distinct scene_id, label, floor((x - min(x) over (partition by scene_id)) / 0.2) as ix, floor((y - min(y) over (partition by scene_id)) / 0.2) as iy, floor((z - min(z) over (partition by scene_id)) / 0.2) as iz from p),
    u as (select *, row_number() over (order by scene_id, label, ix, iy, iz) as k from v), d as (select unnest([-1, 0, 1]) as d),
    o as (select a.d as x, b.d as y, c.d as z from d a, d b, d c where abs(a.d) + abs(b.d) + abs(c.d) <= 2),
    reach as (select distinct a.x - b.x + e.x as x, a.y - b.y + e.y as y, a.z - b.z + e.z as z from o a, o b, o e where abs(e.x) + abs(e.y) + abs(e.z) <= 1),
    link as (select a.k as a, b.k as b from u a join reach on true join u b on b.scene_id = a.scene_id and b.label = a.label and b.ix = a.ix + x and b.iy = a.iy + y and b.iz = a.iz + z),
    walk(a, b) as (select k, k from u union select w.a, l.b from walk w join link l on w.b = l.a),
    named as (select a as k, min(b) as component from walk group by 1)
    select scene_id, label, component_size, count(*) as n_components from (select scene_id, label, component, count(*) as component_size from u join named using (k) group by 1, 2, 3) group by 1, 2, 3""")
def pts_voxel_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS5: instances by the number of their cells."""
    found = P.voxel_components(P.voxelize(_points(spark, sf_dir), 0.2), dilate=True)
    sizes = found.groupBy("scene_id", "label", "component").agg(F.count("*").alias("component_size"))
    return sizes.groupBy("scene_id", "label", "component_size").agg(F.count("*").alias("n_components"))


@query()
def pts_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS4; tested against brute force."""
    return P.denoise(P.voxelize(_points(spark, sf_dir), 0.2), 1, 2)


@query(f"""
    with {_PTS}, q as (select *, floor(x / 0.1) as a, floor(y / 0.1) as b, floor(z / 0.1) as c from p)
    select min(point_id) as point_id from q group by scene_id, label, a, b, c""")
def smp_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP10."""
    return P.downsample(_points(spark, sf_dir), 0.1, "point_id").select("point_id")


@query(f"with {_PTS} select a.point_id as a, b.point_id as b from p a join p b using (scene_id, label) where a.point_id <> b.point_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.08 * 0.08")
def join_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN10."""
    return P.near_pairs(_points(spark, sf_dir), 0.08)


_CORE = """near as (select a.point_id as a, b.point_id as b from p a join p b using (scene_id, label) where a.point_id <> b.point_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.08 * 0.08),
    core as (select a from near group by 1 having count(*) + 1 >= 3)"""


@query(f"""
    with recursive {_PTS}, {_CORE}, link as (select a, b from near where a in (select a from core) and b in (select a from core)),
    walk(a, b) as (select a, a from core union select w.a, l.b from walk w join link l on w.b = l.a),
    named as (select a, min(b) as cluster from walk group by 1)
    select a as point_id, cluster from named union all
    select n.a, min(c.cluster) from near n join named c on n.b = c.a where n.a not in (select a from core) group by 1""")
def pts_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS6."""
    return P.dbscan(_points(spark, sf_dir), 0.08, 3)


_CLUSTERS = f"""{_PTS}, {_CORE}, link as (select a, b from near where a in (select a from core) and b in (select a from core)),
    walk(a, b) as (select a, a from core union select w.a, l.b from walk w join link l on w.b = l.a),
    named as (select a, min(b) as cluster from walk group by 1),
    clusters as (select a as point_id, cluster from named union all
      select n.a, min(c.cluster) from near n join named c on n.b = c.a where n.a not in (select a from core) group by 1),
    inst as (select scene_id, label, cluster, avg(x) as cx, avg(y) as cy, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1,
      count(*) as n, (max(x) - min(x)) * (max(y) - min(y)) as area from p join clusters using (point_id) group by 1, 2, 3)"""


@query(f"""
    with recursive {_CLUSTERS}
    select scene_id, label, cluster, round(cx, 6) as cx, round(cy, 6) as cy, round(x0, 6) as x0, round(x1, 6) as x1, round(y0, 6) as y0, round(y1, 6) as y1, round(z0, 6) as z0, round(z1, 6) as z1,
      n, round(area, 6) as area, row_number() over (partition by scene_id, label order by area desc, cluster) as number from inst""")
def pts_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS8, WIN2, SMP9; built on pts_dbscan."""
    found = _instances(spark, sf_dir)
    kinds = dict(found.dtypes)
    return found.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in found.columns))


@query()
def pts_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS8 (hull, rectangle); tested on known shapes."""
    points = _points(spark, sf_dir)
    return rounded(P.hull_geometry(points.join(P.dbscan(points, 0.08, 3), "point_id")))


@query()
def pts_core_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS7; tested against brute force."""
    points = _points(spark, sf_dir)
    return N.core_region(points.join(P.dbscan(points, 0.1, 3), "point_id")).select("point_id", "cluster")


@query()
def pts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS9, JOIN9."""
    points = _points(spark, sf_dir)
    return P.merge_near(points.join(P.dbscan(points, 0.08, 3), "point_id"), 0.05).select("point_id", "cluster")


@query(f"""
    with recursive {_CLUSTERS}, c as (
      select c.scene_id, c.cluster, q.cluster as parent, case when c.z0 - q.z1 between -0.15 and 0.35 then 'On_Top_Of' when c.z0 >= q.z0 - 0.1 and c.z1 <= q.z1 + 0.1 then 'Inside' end as relation,
        case when c.z0 - q.z1 between -0.15 and 0.35 then abs(c.z0 - q.z1) else 0 end as gap, q.area from inst c join inst q on c.scene_id = q.scene_id and c.cluster <> q.cluster and q.area > c.area
        and c.cx between q.x0 - 0.15 and q.x1 + 0.15 and c.cy between q.y0 - 0.15 and q.y1 + 0.15)
    select scene_id, cluster, parent, relation, round(gap, 6) as gap from c where relation is not null
    qualify row_number() over (partition by scene_id, cluster order by gap, area, parent) = 1""")
def pts_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS10, JOIN8, WIN9; tested against brute force."""
    return rounded(P.hierarchy(_instances(spark, sf_dir)))


@query()
def jsn_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN2."""
    inst = _instances(spark, sf_dir)
    return P.hierarchy_document(inst, P.hierarchy(inst))


@query(f"""
    with recursive {_CLUSTERS}, b as (select scene_id, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p group by 1),
    r as (select scene_id, label, least(greatest(floor((y0 - ly) / (hy - ly) * 10), 0), 9)::int as r0, least(greatest(floor((y1 - ly) / (hy - ly) * 10), 0), 9)::int as r1,
      least(greatest(floor((x0 - lx) / (hx - lx) * 10), 0), 9)::int as c0, least(greatest(floor((x1 - lx) / (hx - lx) * 10), 0), 9)::int as c1 from inst join b using (scene_id)),
    e as (select distinct scene_id, label, row, unnest(range(c0, c1 + 1)) as col from (select *, unnest(range(r0, r1 + 1)) as row from r))
    select scene_id, row::int as row, col::int as col, string_agg(label::varchar, ',' order by label) as categories from e group by 1, 2, 3""")
def pts_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS11."""
    inst = _instances(spark, sf_dir)
    found = P.grid_map(inst, P.scene_bounds(_points(spark, sf_dir)))
    return found.withColumn("categories", F.array_join(F.col("categories").cast("array<string>"), ","))


@query(f"""
    with recursive {_CLUSTERS}, b as (select scene_id, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p group by 1),
    r as (select scene_id, (hx - lx) * (hy - ly) / 100 as cell, least(greatest(floor((y0 - ly) / (hy - ly) * 10), 0), 9)::int as r0, least(greatest(floor((y1 - ly) / (hy - ly) * 10), 0), 9)::int as r1,
      least(greatest(floor((x0 - lx) / (hx - lx) * 10), 0), 9)::int as c0, least(greatest(floor((x1 - lx) / (hx - lx) * 10), 0), 9)::int as c1 from inst join b using (scene_id)),
    e as (select distinct scene_id, cell, row, unnest(range(c0, c1 + 1)) as col from (select *, unnest(range(r0, r1 + 1)) as row from r)),
    v as (select distinct scene_id, floor(x / 0.05) as vx, floor(y / 0.05) as vy from p),
    w as (select scene_id, count(*) * 0.01 as floor_area from (select scene_id, floor(vy / 2), floor(vx / 2) from v group by 1, 2, 3 having count(*) >= 2) group by 1)
    select scene_id, occupied_cells, round(occupied_area, 6) as occupied_area, round(floor_area, 6)::double as floor_area from (select scene_id, count(*) as occupied_cells, count(*) * any_value(cell) as occupied_area from e group by 1) join w using (scene_id)""")
def pts_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS11 (occupied area), PTS12 (floor area)."""
    points = _points(spark, sf_dir)
    bounds = P.scene_bounds(points)
    occupied = P.occupied_area(P.grid_map(_instances(spark, sf_dir), bounds), bounds)
    return rounded(occupied.join(P.floor_area(P.route_cells(points, 0.05, 0.1, 2), 0.1), "scene_id"))


_RADII = {"1": 0.05, "2": 0.12}


@query(f"""
    with recursive {_PTS}, n as (select scene_id, label, count(*) as n from p group by 1, 2),
    s as (select p.*, case label when 1 then 0.05 when 2 then 0.12 else 0.08 end as eps, n from p join n using (scene_id, label) where n >= 5),
    t as (select scene_id, label, eps, arg_min(x, point_id) as x, arg_min(y, point_id) as y, min(point_id) as point_id, 3 as least from s where n > 17 group by scene_id, label, eps, floor(x / 0.05), floor(y / 0.05)
      union all select scene_id, label, eps, x, y, point_id, 4 as least from s where n <= 17),
    near as (select a.point_id as a, b.point_id as b, a.least from t a join t b using (scene_id, label) where a.point_id <> b.point_id and (a.x / a.eps - b.x / b.eps) ** 2 + (a.y / a.eps - b.y / b.eps) ** 2 <= 1),
    core as (select a from near group by 1 having count(*) + 1 >= any_value(least)), link as (select a, b from near where a in (select a from core) and b in (select a from core)),
    walk(a, b) as (select a, a from core union select w.a, l.b from walk w join link l on w.b = l.a), named as (select a, min(b) as cluster from walk group by 1)
    select a as point_id, cluster from named union all select n.a, min(c.cluster) from near n join named c on n.b = c.a where n.a not in (select a from core) group by 1""")
def pts_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS6 as a whole: a radius for each category, large categories thinned and their minimum relaxed."""
    radii = io.parameter_table(spark, _RADII)
    return P.category_clusters(_points(spark, sf_dir), radii, default=0.08, min_samples=4, least=5, size=0.05, most=17)


@query(f"""
    with {_PTS}, v as (select distinct scene_id, floor(x / 0.05) as vx, floor(y / 0.05) as vy from p)
    select scene_id, floor(vy / 2)::bigint as row, floor(vx / 2)::bigint as col, count(*) as n from v group by 1, 2, 3 having count(*) >= 2""")
def pts_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS12, SET3."""
    return P.route_cells(_points(spark, sf_dir), 0.05, 0.1, 2)


@query("""
    with c as (select user_id, event_id, ts, floor(value / 30)::bigint as r, (event_id % 3)::bigint as c from events), l as (select *, lag(r) over w as pr, lag(c) over w as pc, row_number() over w as k from c window w as (partition by user_id order by ts, event_id))
    select user_id::varchar as scene_id, string_agg('(' || r || ',' || c || ')', ' -> ' order by k) as path from l where k = 1 or r is distinct from pr or c is distinct from pc group by 1""")
def pts_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS13, WIN3."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scene_id"), "ts", "event_id", (F.col("value") / 30).alias("y"), (F.col("event_id") % 3).alias("x"))
    return P.trajectory(rows, 1.0, ["ts", "event_id"])


@query("select vec_id, round(embedding[4]::double, 6) as x, round(embedding[8]::double, 6) as y, round(embedding[12]::double, 6) as z, round((degrees(atan2(embedding[3]::double, embedding[11]::double)) + 360) % 360, 5) as degrees from embeddings")
def pts_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS14."""
    h = P.heading(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(h[c], 6).alias(c) for c in "xyz"), F.round(h["degrees"], 5).alias("degrees"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 depth frame."""
    flat = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("scene_id"), F.col("vec_id").cast("string").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform(e, lambda x: F.abs(x) + F.lit(0.5).cast("float")).alias("depth"), F.transform(e, lambda x: F.abs(x) * 2).alias("conf"), F.transform(e, lambda x, k: (k % 3 - 1).cast("int")).alias("mask"),
        flat(8, 0, 4, 0, 8, 4, 0, 0, 1).alias("k"), flat(0, 0, 1, 0.5, 0, 1, 0, 1, -1, 0, 0, 2, 0, 0, 0, 1).alias("c2w"),
    )


@query("""
    with f as (select vec_id::varchar as frame, unnest(embedding)::float as e, generate_subscripts(embedding, 1) - 1 as i from embeddings), g as (select frame, i, (abs(e) + 0.5::float)::float::double as d, abs(e)::double * 2 as c from f where (abs(e) * 2)::float >= 0.1::float)
    select frame, count(*) as n, round(avg(d + 0.5), 4) as x, round(avg((i // 8 - 4) * d / 8 + 1), 4) as y, round(avg(-(i % 8 - 4) * d / 8 + 2), 4) as z from g where d > 0.1 and d < 10 group by 1""")
def pts_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS1, FIL7, SRC8: frames written, read with their schema and projected."""
    path = fresh_path(spark, "frames")
    floats = {c: F.col(c).cast("array<float>") for c in ("depth", "conf")}
    _frames(spark, sf_dir).withColumns(floats | {c: F.col(c).cast("array<double>") for c in ("k", "c2w")}).write.parquet(path)
    found = P.back_project(io.read_frames(spark, path), confidence=float.fromhex("0x1.99999ap-4"))
    return found.groupBy("frame").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in "xyz"))


@query("""
    with f as (select 's' || (vec_id % 3) as s, vec_id::varchar as frame, list_avg([abs(x)::double * 2 for x in embedding]) as c from embeddings), k as (select s from f group by 1 having avg(c) >= 0.1)
    select frame from f join k using (s) where c >= 0.2""")
def fil_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL6."""
    frames = _frames(spark, sf_dir).withColumn("conf", F.transform("conf", lambda x: x.cast("double")))
    return P.confident_frames(frames, 0.2, 0.1).select("frame")


@query(f"with {_PTS}, c as (select scene_id, avg(y) + 0.05 as top from p where point_id % 10 = 0 group by 1) select point_id from p join c using (scene_id) where y between -0.1 and top")
def fil_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL8."""
    p = _points(spark, sf_dir)
    return P.height_band(p, p.where("point_id % 10 = 0"), -0.1, 0.05).select("point_id")


@query("with f as (select user_id % 5 as scene_id, (value > 50)::int * (event_id % 100) as moving, event_id % 100 as pixels from events) select scene_id, round(avg(moving / pixels) filter (pixels > 0), 6) as dynamic_ratio from f group by 1")
def fil_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL9."""
    e = F.col("event_id") % 100
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("scene_id"), ((F.col("value") > 50).cast("int") * e).alias("moving"), e.alias("pixels"))
    return rounded(P.dynamic_ratio(rows))


@query("select user_id as frame, event_type as class, event_id % 7 as pixel, max((value > 50)::int) as value from events group by 1, 2, 3")
def set_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("frame"), F.col("event_type").alias("class"), (F.col("event_id") % 7).alias("pixel"), (F.col("value") > 50).cast("int").alias("value"))
    return P.merged_masks(rows)


@query()
def met_maps_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET28; tested on turned maps."""
    k = F.row_number().over(Window.partitionBy("map_id").orderBy("vec_id"))
    base = table(spark, sf_dir, "embeddings").withColumn("map_id", F.floor(F.col("vec_id") / 6)).withColumn("name", k.cast("string"))
    names = F.array(*map(F.lit, ("North", "right", "down", "west", "inner", " ")))
    side = lambda a, b, n: base.select("map_id", "name", F.col("embedding")[a].alias("x"), F.col("embedding")[b].alias("y"), F.get(names, (F.col("vec_id") % n).cast("int")).alias("facing"))
    return rounded(P.map_similarity(side(3, 4, 5).where("name <> '6'"), side(0, 1, 6)))
