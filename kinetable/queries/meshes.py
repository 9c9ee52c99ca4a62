"""Queries on meshes, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..operators import meshes as ms, normalize as nz
from ..plans.lineage import state_dir
from ..schema import FRAME
from ..sources import bridges as br, frames as fr, obj, sinks, solver_text
from ..streaming import frames as sfr, metrics as sme

_TRI = """
select f.seq_id, f.frame_id, f.face_id, f.v0, f.v1, f.v2, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) as cx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) as cy, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) as cz
from faces f join points a on a.seq_id=f.seq_id and a.frame_id=f.frame_id and a.vertex_id=f.v0
join points b on b.seq_id=f.seq_id and b.frame_id=f.frame_id and b.vertex_id=f.v1
join points c on c.seq_id=f.seq_id and c.frame_id=f.frame_id and c.vertex_id=f.v2"""


@query("vertex_normals", sql(f"""
select seq_id, frame_id, vertex_id, {', '.join(r(f'case when n>0 then s{c}/n else 0e0 end', f'n{c}') for c in 'xyz')} from (
select *, sqrt(sx*sx+sy*sy+sz*sz) as n from (
select seq_id, frame_id, vertex_id, sum(cx) as sx, sum(cy) as sy, sum(cz) as sz from (
select seq_id, frame_id, v0 as vertex_id, cx, cy, cz from tri union all select seq_id, frame_id, v1, cx, cy, cz from tri union all select seq_id, frame_id, v2, cx, cy, cz from tri) group by 1, 2, 3))""", tri=_TRI))
def vertex_normals(spark, sf):
    p = br.points(spark, sf)
    return ms.vertex_normals(p, br.faces(p)).select(*FRAME, "vertex_id", *rnds("nx", "ny", "nz"))


@query("regress_joints", sql(f"""
select p.seq_id, p.frame_id, v.v as k, {', '.join(r(f'sum(p.{c}/(1+(p.vertex_id+v.v)%7))', c, 4) for c in 'xyz')} from points p, range(0, 5) v(v) group by 1, 2, 3"""))
def regress_joints(spark, sf):
    p = br.points(spark, sf)
    reg = p.select("vertex_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn(
        "w", 1 / (1.0 + (F.col("vertex_id") + F.col("k")) % 7))
    return ms.regress_joints(p, reg).select(*FRAME, "k", *rnds("x", "y", "z", n=4))


@query("describe_tables", sql("""
select 'points' as table, count(*) as rows, count(distinct (seq_id, frame_id)) as frames, (select max(c) from (select count(*) as c from points group by seq_id, frame_id)) as most_rows, min(x) as min_value, max(x) as max_value from points
union all select 'lineitem', count(*), count(distinct (seq_id, frame_id)), (select max(c) from (select count(*) as c from li_points group by seq_id, frame_id)), min(x), max(x) from li_points"""))
def describe_tables(spark, sf):
    return sinks.describe_tables({"points": br.points(spark, sf), "lineitem": br.lineitem_points(spark, sf)})


@query("rows_by_frame", sql("select coalesce(seq_id, '*') as seq_id, coalesce(frame_id, -1) as frame_id, count(*) as rows from points group by rollup (points.seq_id, points.frame_id)"))
def rows_by_frame(spark, sf):
    return sinks.rows_by_frame(br.points(spark, sf)).select(
        F.coalesce("seq_id", F.lit("*")).alias("seq_id"), F.coalesce("frame_id", F.lit(-1)).alias("frame_id"), "rows")


@query("obj_round_trip", sql("select seq_id, frame_id, vertex_id, x, y, z from points"))
def obj_round_trip(spark, sf):
    """Every frame written as OBJ and read back."""
    path = f"{state_dir(spark)}/obj-{uuid.uuid4().hex}"
    p = br.points(spark, sf)
    obj.write_obj_frames(p, br.faces(p), path)
    rows = spark.read.option("basePath", path).schema("value string, seq_id string, frame_id long").text(path, wholetext=True)
    v = rows.select("seq_id", "frame_id", F.posexplode(obj.vertex_array(F.col("value"))).alias("vertex_id", "p"))
    return v.select(*FRAME, F.col("vertex_id").cast("long").alias("vertex_id"), "p.x", "p.y", "p.z")


def _obj_read(spark, sf):
    """Every frame written as one OBJ file and read back with names and faces, by blocks where it is over a kilobyte."""
    path = f"{state_dir(spark)}/obj-{uuid.uuid4().hex}"
    p = br.points(spark, sf)
    one = obj.obj_lines(p, br.faces(p)).groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "value"))).alias("l"))
    file = F.format_string("frame_%05d.obj", F.col("frame_id"))
    sinks.write_named_texts(one.select(F.concat_ws("/", "seq_id", file).alias("file"), F.concat_ws("\n", F.col("l.value")).alias("text")), path)
    return obj.read_obj_frames(spark, path, whole=1024)


@query("obj_frames", sql("""
select seq_id, cast(row_number() over (partition by seq_id order by frame_id)-1 as bigint) as frame_id, printf('frame_%05d', frame_id) as name
from (select distinct seq_id, frame_id from points)"""))
def obj_frames(spark, sf):
    return _obj_read(spark, sf)[0].select(*FRAME, "name")


_RANKS = "select seq_id, frame_id, cast(dense_rank() over (partition by seq_id order by frame_id)-1 as bigint) as rk, {0} from {1}"


@query("obj_points", sql("select seq_id, rk as frame_id, vertex_id, x, y, z from ranks", ranks=_RANKS.format("vertex_id, x, y, z", "points")))
def obj_points(spark, sf):
    return _obj_read(spark, sf)[1]


@query("obj_faces", sql("""
select f.seq_id, r.rk as frame_id, f.face_id, f.v0, f.v1, f.v2 from faces f join (select distinct seq_id, frame_id, rk from ranks) r
on r.seq_id=f.seq_id and r.frame_id=f.frame_id""", ranks=_RANKS.format("vertex_id", "points")))
def obj_faces(spark, sf):
    return _obj_read(spark, sf)[2]


@query("materialize_frames", sql("select seq_id, frame_id, i, j, k, n from voxels"))
def materialize_frames(spark, sf):
    """Half of the frames are cached first; the second call adds only the others."""
    path = f"{state_dir(spark)}/cache-{uuid.uuid4().hex}"
    v = nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)
    fr.materialize_frames(v.where("frame_id % 2 = 0"), path)
    return fr.materialize_frames(v, path)


@query("new_frames", sql("select seq_id, frame_id, vertex_id from points where frame_id%3<>0"))
def new_frames(spark, sf):
    p = br.points(spark, sf).select(*FRAME, "vertex_id")
    return fr.new_frames(p, p.where("frame_id % 3 = 0"))


@query("solver_lines", sql("""
select seq_id, section, a, b, value from (
select seq_id, case when frame_id=0 then 3 else 4 end as section, frame_id as a, vertex_id as b,
       printf('%s %.6f %.6f %.6f', case when frame_id=0 then 'v' else 'a' end, x, y, z) as value from clouds
union all select s.seq_id, 1, b.k, 0, printf('parent %d %d', b.k, b.parent) from (select distinct seq_id from clouds) s, bones b
union all select s.seq_id, 0, h.i, 0, case h.i when 0 then printf('nV %d', nv) when 1 then 'nB 21' when 2 then printf('nF %d', nf) else h.t end from (select seq_id, max(vertex_id)+1 as nv, max(frame_id) as nf from clouds group by 1) s,
  (values (0, ''), (1, ''), (2, ''), (3, 'nS 1'), (4, 'nIters 5'), (5, 'nInitIters 1'), (6, 'nTransIters 1'), (7, 'nWeightsIters 1'), (8, 'nnz 4'), (9, 'weightsSmooth 0.001')) h(i, t)
union all select s.seq_id, 2, h.i, 0, h.t from (select distinct seq_id from clouds) s, (values (0, 'fStart 0'), (1, 'subjectID 0')) h(i, t))"""))
def solver_lines(spark, sf):
    return solver_text.solver_lines(br.clouds(spark, sf), br.bones(spark, sf))


@query("stream_frames", sql("""
select distinct seq_id, frame_id, cast(trunc((((x-bx)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as i,
       cast(trunc((((y-by_)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as j, cast(trunc((((z-bz)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as k
from (select p.*, b.bx, b.by_, b.bz, b.blen from points p join frame_box b on p.seq_id=b.seq_id and p.frame_id=b.frame_id)"""))
def stream_frames(spark, sf):
    """All frames arrive as files and go through the stream into the voxel table."""
    base = f"{state_dir(spark)}/stream-{uuid.uuid4().hex}"
    obj.write_obj_frames(br.points(spark, sf), None, f"{base}/in")
    q = sfr.stream_frames(spark, f"{base}/in", f"{base}/out", f"{base}/log")
    q.awaitTermination()
    return spark.read.schema("seq_id string, frame_id long, i int, j int, k int").parquet(f"{base}/out")


@query("stream_metrics", sql(f"""
select date_trunc('day', ts) as start, event_type as key, {r('avg(value)', 'value', 9)}, count(*) as n from events group by 1, 2"""))
def stream_metrics(spark, sf):
    base = f"{state_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = br.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = sme.stream_metrics(events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value"), f"{base}/out", f"{base}/log", late="40 days")
    q.awaitTermination()
    return sme.latest_means(spark, f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "key", rnd("value", 9).alias("value"), "n")
