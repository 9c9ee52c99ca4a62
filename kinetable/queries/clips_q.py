"""Queries on clip selection, padding, splits, subsets and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .common import r, rnds
from .views import sql
from ..functions import names
from ..operators import clips as cl, sampling as sm
from ..plans.ranking import position_by_id, top_k
from ..schema import FRAME
from ..sources import bridges as br

_LEN = "select seq_id, max(frame_id)+1 as length from keypoints group by seq_id"
_START = """select seq_id, length, case when length<{span} then 0 when raw+({t}-1)*{rate}>=length then greatest(raw-2*off, 0) else raw end as start
from (select *, ({e}%whole)*{span}+off as raw from (select *, greatest(length//{span}, 1) as whole, ({e}%{t})*{rate} as off from lens))"""


@query("crop", sql("""
select p.seq_id, cast((p.frame_id-4)//3 as bigint) as frame_id, p.k, p.x, p.y, p.z from keypoints p
where p.frame_id>=4 and p.frame_id<4+10*3 and (p.frame_id-4)%3=0"""))
def crop(spark, sf):
    k = br.keypoints(spark, sf)
    starts = cl.lengths(k).withColumn("start", F.lit(4).cast("long"))
    return cl.crop(k, starts, 10, 3).select(*FRAME, "k", "x", "y", "z")


@query("epoch_clip", sql("""
select p.seq_id, cast((p.frame_id-s.start)//2 as bigint) as frame_id, p.k, p.x, p.y, p.z
from keypoints p join starts s on p.seq_id=s.seq_id
where p.frame_id>=s.start and p.frame_id<s.start+20 and (p.frame_id-s.start)%2=0""",
    lens=_LEN, starts=_START.format(span=20, t=10, rate=2, e=7)))
def epoch_clip(spark, sf):
    k = br.keypoints(spark, sf)
    return cl.crop(k, cl.epoch_starts(cl.lengths(k), 7, 10, 2), 10, 2).select(*FRAME, "k", "x", "y", "z")


@query("clip_windows", sql(f"select seq_id, length, epoch, cast(start as bigint) as start from starts",
    lens="select l.*, e.v as epoch from (" + _LEN + ") l, unnest(range(0, greatest(length//20, 1)*10)) e(v)",
    starts=_START.replace("select seq_id, length,", "select seq_id, length, epoch,").format(span=20, t=10, rate=2, e="epoch")))
def clip_windows(spark, sf):
    return cl.clip_windows(cl.lengths(br.keypoints(spark, sf)), 10, 2)


@query("random_clip")
def random_clip(spark, sf):
    k = br.keypoints(spark, sf)
    return cl.crop(k, cl.random_starts(cl.lengths(k), 7, 10, 2), 10, 2).select(*FRAME, "k", "x", "y", "z")


@query("pad_last", sql("""
select seq_id, frame_id, k, x, y, z from keypoints union all
select p.seq_id, f.v as frame_id, p.k, p.x, p.y, p.z from keypoints p join lens l on p.seq_id=l.seq_id and p.frame_id=l.length-1, range(0, 60) f(v)
where l.length<60 and f.v>=l.length""", lens=_LEN))
def pad_last(spark, sf):
    k = br.keypoints(spark, sf).select(*FRAME, "k", "x", "y", "z")
    return cl.pad_last(k, cl.lengths(k), 60, 1)


@query("limit_sequences")
def limit_sequences(spark, sf):
    return cl.limit_sequences(br.keypoints(spark, sf), 7, 4).select(*FRAME, "k", "x", "y", "z")


@query("train_test_split")
def train_test_split(spark, sf):
    ids = br.table(spark, sf, "customer").select(F.col("c_name").alias("seq_id"))
    return cl.train_test_split(ids, 7)


@query("frame_range", sql("select seq_id, frame_id, k, x, y, z from keypoints where frame_id between 5 and 12"))
def frame_range(spark, sf):
    return cl.frame_range(br.keypoints(spark, sf), 5, 12).select(*FRAME, "k", "x", "y", "z")


@query("subsample_frames", sql("""
select distinct l.seq_id, case when i.v=0 and not has then 7 else f end as frame_id from (
select *, max(f=7) over (partition by seq_id) as has from (
select l.seq_id, i.v, case when i.v=9 then length-1 else cast(floor(i.v*((length-1)/9e0)) as bigint) end as f
from lens l, range(0, 10) i(v))) l, (select 1), (select v from range(0, 10) r(v)) i where i.v=l.v""", lens=_LEN))
def subsample_frames(spark, sf):
    k = br.keypoints(spark, sf)
    return cl.subsample_frames(k, 10, F.lit(7).cast("long")).select(*FRAME).distinct()


@query("subsample_vertices_stride", sql("""
select seq_id, frame_id, vertex_id, x, y, z from (
select p.*, greatest(count(*) over (partition by seq_id, frame_id)//20, 1) as step from points p)
where vertex_id%step=0 and vertex_id//step<20"""))
def subsample_vertices_stride(spark, sf):
    return cl.subsample_vertices(br.points(spark, sf), 20)


@query("subsample_vertices_even", sql("""
select distinct p.seq_id, p.frame_id, p.vertex_id, p.x, p.y, p.z from (
select *, count(*) over (partition by seq_id, frame_id) as n from points) p, range(0, 30) i(v)
where n<=30 or vertex_id = case when i.v=29 then n-1 else cast(floor(i.v*((n-1)/29e0)) as bigint) end"""))
def subsample_vertices_even(spark, sf):
    return cl.subsample_vertices(br.points(spark, sf), 30, even=True)


@query("sample_vertices_hash")
def sample_vertices_hash(spark, sf):
    return cl.sample_vertices_hash(br.points(spark, sf), 20, 7)


_FPS_STEP = """
select seq_id, frame_id, {step} as pick, arg_min(vertex_id, struct_pack(a := -d, b := vertex_id)) as vertex_id from (
select p.seq_id, p.frame_id, p.vertex_id, min((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) as d
from points p join ({picks}) s on p.seq_id=s.seq_id and p.frame_id=s.frame_id
join points q on q.seq_id=s.seq_id and q.frame_id=s.frame_id and q.vertex_id=s.vertex_id
group by p.seq_id, p.frame_id, p.vertex_id) group by seq_id, frame_id having max(d)>0"""


def _fps_views(n: int) -> dict[str, str]:
    views = {"pick0": "select seq_id, frame_id, 0 as pick, vertex_id from points where vertex_id=0"}
    for i in range(1, n):
        views[f"pick{i}"] = _FPS_STEP.format(step=i, picks=" union all ".join(f"select * from pick{j}" for j in range(i)))
    return views


@query("farthest_point_sample", sql(
    "select seq_id, frame_id, cast(pick as bigint) as pick, vertex_id from (" +
    " union all ".join(f"select * from pick{i}" for i in range(5)) + ")", **_fps_views(5)))
def farthest_point_sample(spark, sf):
    return sm.farthest_point_sample(br.points(spark, sf), 5).select(*FRAME, "pick", "vertex_id")


@query("top_k", sql("""
select seq_id, frame_id, vertex_id, x, cast(rank as bigint) as rank from (
select *, row_number() over (partition by seq_id, frame_id order by x desc, vertex_id) as rank from points) where rank<=5"""))
def top_k_query(spark, sf):
    p = br.points(spark, sf)
    return top_k(p, FRAME, [F.desc("x"), "vertex_id"], 5, rank="rank").select(
        *FRAME, "vertex_id", "x", F.col("rank").cast("long").alias("rank"))


@query("mask_low_confidence", sql("""
select seq_id, frame_id, k, case when intensity<0.2e0 then 1e4 else x end as x, case when intensity<0.2e0 then 1e4 else y end as y,
       case when intensity<0.2e0 then 1e4 else z end as z, case when intensity<0.2e0 then 1e0 else intensity end as intensity from keypoints"""))
def mask_low_confidence(spark, sf):
    return cl.mask_low_confidence(br.keypoints(spark, sf))


@query("retain_latest", sql("""
select epoch, batch, key, value from (select *, dense_rank() over (order by epoch desc) as rk from metrics) where rk<=5"""))
def retain_latest(spark, sf):
    return cl.retain_latest(br.metrics(spark, sf), 5)


@query("surface_sample", sql(f"""
select a.seq_id, a.frame_id, i.v as sample_id, face_id, {r('x0*(1-u-v_)+x1*u+x2*v_', 'x')}, {r('y0*(1-u-v_)+y1*u+y2*v_', 'y')}, {r('z0*(1-u-v_)+z1*u+z2*v_', 'z')}
from cum a join (select v, case when a+b>1 then 1-a else a end as u, case when a+b>1 then 1-b else b end as v_ from (
  select v, (v*0.7548776662466927e0)-floor(v*0.7548776662466927e0) as a, (v*0.5698402909980532e0)-floor(v*0.5698402909980532e0) as b
  from range(0, 200) s(v))) i on (i.v+0.5e0)/200>lo and (i.v+0.5e0)/200<=hi""",
    tri="""
select f.seq_id, f.frame_id, f.face_id, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2
from faces f join points a on a.seq_id=f.seq_id and a.frame_id=f.frame_id and a.vertex_id=f.v0
join points b on b.seq_id=f.seq_id and b.frame_id=f.frame_id and b.vertex_id=f.v1
join points c on c.seq_id=f.seq_id and c.frame_id=f.frame_id and c.vertex_id=f.v2""",
    areas="""
select *, 0.5e0*sqrt(cx*cx+cy*cy+cz*cz) as area from (
select *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) as cx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) as cy, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) as cz from tri)""",
    cum="""
select *, run-area as before, (run-area)/total as lo, run/total as hi from (
select *, sum(area) over (partition by seq_id, frame_id order by face_id rows unbounded preceding) as run,
       sum(area) over (partition by seq_id, frame_id) as total from areas)"""))
def surface_sample(spark, sf):
    p = br.points(spark, sf)
    s = sm.surface_sample(p, br.faces(p), 200, grid=True)
    return s.select(*FRAME, "sample_id", "face_id", *rnds("x", "y", "z"))


@query("surface_sample_random")
def surface_sample_random(spark, sf):
    p = br.points(spark, sf)
    return sm.surface_sample(p, br.faces(p), 200, seed=7)


@query("frame_list", sql("""
select seq_id, name, cast(row_number() over (partition by seq_id order by name) as bigint) as number from (
select distinct seq_id, printf('Frame_%05d_scan', frame_id+1) as name from points)"""))
def frame_list(spark, sf):
    """Available frames in name order with their 1-based numbers."""
    from ..sources.frames import number_frames
    f = br.points(spark, sf).select("seq_id", F.format_string("Frame_%05d_scan", F.col("frame_id") + 1).alias("name")).distinct()
    return number_frames(f).select("seq_id", "name", "number")


@query("frame_index_from_name", sql("""
select seq_id, name, case when regexp_matches(name, 'Frame_([0-9]+)_') then cast(regexp_extract(name, 'Frame_([0-9]+)_', 1) as bigint)-1 else 93 end as idx
from (select distinct seq_id, case when frame_id%4=0 then printf('scan%d', frame_id) else printf('Frame_%05d_scan', frame_id+1) end as name from points)"""))
def frame_index_from_name(spark, sf):
    name = F.when(F.col("frame_id") % 4 == 0, F.format_string("scan%d", "frame_id")).otherwise(
        F.format_string("Frame_%05d_scan", F.col("frame_id") + 1))
    f = br.points(spark, sf).select("seq_id", name.alias("name")).distinct()
    return f.withColumn("idx", names.frame_index(F.col("name")))


@query("resolve_frame", sql("""
select seq_id, name, number from (
select seq_id, name, cast(row_number() over (partition by seq_id order by name) as bigint) as number from (
select distinct seq_id, printf('Frame_%05d_scan', frame_id+1) as name from points)) where number=7"""))
def resolve_frame(spark, sf):
    from ..sources.frames import number_frames, resolve_frame as resolve
    f = br.points(spark, sf).select("seq_id", F.format_string("Frame_%05d_scan", F.col("frame_id") + 1).alias("name")).distinct()
    return resolve(number_frames(f), "7").select("seq_id", "name", "number")


@query("lineitem_ranks", sql("select seq_id, frame_id, vertex_id, x, y, z from li_points"))
def lineitem_ranks(spark, sf):
    """Positions inside large groups, counted in bounded id ranges."""
    return br.lineitem_points(spark, sf)


@query("clip_settings", sql("""
select seq_id, dataset, length, n_clips from (select l.seq_id, s.dataset, l.length, cast(greatest(l.length//(s.t*s.rate), 1) as bigint) as n_clips
from lens l join (values (0, 'dfaust', 10, 5), (1, 'aist', 10, 2), (2, 'animals', 10, 1), (3, 'panda', 10, 1), (4, 'hanco', 10, 1)) s(c, dataset, t, rate) on l.seq_id%5=s.c)""", lens=_LEN))
def clip_settings(spark, sf):
    """Clip counts of every track under its data set's settings."""
    sets = F.array(*[F.lit(s["dataset"]) for s in cl.CLIP_SETTINGS])
    lens = cl.lengths(br.keypoints(spark, sf)).withColumn("dataset", F.get(sets, (F.col("seq_id") % 5).cast("int")))
    return cl.clips_by_dataset(lens, cl.clip_settings(spark)).select("seq_id", "dataset", "length", "n_clips")


@query("yaw_align")
def yaw_align(spark, sf):
    c = br.clouds(spark, sf)
    rot = br.joints(spark, sf).where("k = 0").select(*FRAME, *[F.col(a).alias(f"r{a}") for a in "xyz"])
    starts = cl.lengths(c).withColumn("start", F.lit(0).cast("long"))
    return cl.yaw_align(c, rot, starts)
