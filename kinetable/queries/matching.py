"""Queries on neighbour joins and correspondence between frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..functions.space import dist2
from ..operators import correspondence as co, normalize as nz, voxels as vx
from ..plans.knn import knn_join
from ..plans.lineage import cut
from ..schema import FRAME
from ..sources import bridges as br

_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
# every frame against the one after it; the match key is the earlier frame
_NEXT = "select seq_id, frame_id-1 as frame_id, vertex_id, x, y, z from points where frame_id>=1"
_RANKED = f"""
select a.seq_id, a.frame_id, a.vertex_id, b.vertex_id as other, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, {_D2} as d2,
       row_number() over (partition by a.seq_id, a.frame_id, a.vertex_id order by {_D2}, b.vertex_id) as rk
from points a join nxt b on a.seq_id=b.seq_id and a.frame_id=b.frame_id"""


def next_frames(p):
    return p.where("frame_id >= 1").withColumn("frame_id", F.col("frame_id") - 1)


@query("knn_join", sql(f"select seq_id, frame_id, vertex_id as left_id, other as right_id, cast(rk as bigint) as rank, {r('d2', 'd2')} from ranked where rk<=3",
                       nxt=_NEXT, ranked=_RANKED))
def knn(spark, sf):
    p = cut(br.points(spark, sf), "points")
    return knn_join(p, next_frames(p), FRAME, 3).select(
        *FRAME, "left_id", "right_id", F.col("rank").cast("long").alias("rank"), rnd("d2").alias("d2"))


@query("knn_join_refined", sql(f"select seq_id, frame_id, vertex_id as left_id, other as right_id, cast(rk as bigint) as rank, {r('d2', 'd2')} from ranked where rk<=3",
                               nxt=_NEXT, ranked=_RANKED))
def knn_refined(spark, sf):
    """The same join with small leaves, so the cell refinement is exercised on the whole table."""
    p = br.points(spark, sf)
    return knn_join(p, next_frames(p), FRAME, 3, leaf=24, direct=24).select(
        *FRAME, "left_id", "right_id", F.col("rank").cast("long").alias("rank"), rnd("d2").alias("d2"))


@query("knn_lineitem", sql(f"""
select flag, frame_id, vertex_id as left_id, other as right_id, {r('d2', 'd2', 4)} from (
select a.flag, a.frame_id, a.vertex_id, b.vertex_id as other, {_D2} as d2, row_number() over (partition by a.flag, a.frame_id, a.vertex_id order by {_D2}, b.vertex_id) as rk
from a join b on a.flag=b.flag and a.frame_id=b.frame_id) where rk=1""",
    a="select seq_id as flag, frame_id, vertex_id, x, y, z from li_points",
    b="select case seq_id when 'A' then 'N' when 'N' then 'R' else 'A' end as flag, frame_id, vertex_id, x, y, z from li_points"))
def knn_lineitem(spark, sf):
    """Nearest neighbour of each return flag's points among the next flag's (A, R, N in turn) in every shared frame."""
    p = cut(br.lineitem_points(spark, sf), "points").withColumnRenamed("seq_id", "flag")
    turn = F.when(F.col("flag") == "A", "N").when(F.col("flag") == "N", "R").otherwise("A")
    out = knn_join(p, p.withColumn("flag", turn), ["flag", "frame_id"], 1)
    return out.select("flag", "frame_id", "left_id", "right_id", rnd("d2", 4).alias("d2"))


_SIZES = "select a.seq_id, a.frame_id, na=nb as same from (select seq_id, frame_id, count(*) as na from points group by 1, 2) a join (select seq_id, frame_id, count(*) as nb from nxt group by 1, 2) b on a.seq_id=b.seq_id and a.frame_id=b.frame_id"
_MAPPED = """
select a.seq_id, a.frame_id, a.vertex_id, a.x, a.y, a.z, b.x as bx, b.y as by_, b.z as bz
from points a join sizes s on a.seq_id=s.seq_id and a.frame_id=s.frame_id and s.same
join nxt b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and a.vertex_id=b.vertex_id
union all select r.seq_id, r.frame_id, r.vertex_id, ax, ay, az, {x}, {y}, {z}
from ranked r join sizes s on r.seq_id=s.seq_id and r.frame_id=s.frame_id and not s.same where {where}"""
MAPPED_NN = _MAPPED.format(x="bx", y="by_", z="bz", where="rk=1")
_W = "sum({c}/(sqrt(d2)+1e-8))/sum(1/(sqrt(d2)+1e-8))"
MAPPED_IDW = _MAPPED.format(x=_W.format(c="bx"), y=_W.format(c="by_"), z=_W.format(c="bz"),
                            where="rk<=3 group by r.seq_id, r.frame_id, r.vertex_id, ax, ay, az")
MATCH_VIEWS = dict(nxt=_NEXT, ranked=_RANKED, sizes=_SIZES, mapped=MAPPED_NN, mapped_idw=MAPPED_IDW)


@query("nearest_map", sql("select seq_id, frame_id, vertex_id, x, y, z, bx, by_, bz from mapped", **MATCH_VIEWS))
def nearest_map(spark, sf):
    p = cut(br.points(spark, sf), "points")
    return co.match_frames(p, next_frames(p), FRAME).withColumnRenamed("by", "by_")


@query("idw_map", sql(f"select seq_id, frame_id, vertex_id, x, y, z, {rs('bx', 'by_', 'bz')} from mapped_idw", **MATCH_VIEWS))
def idw_map(spark, sf):
    p = cut(br.points(spark, sf), "points")
    m = co.match_frames(p, next_frames(p), FRAME, "idw").withColumnRenamed("by", "by_")
    return m.select(*FRAME, "vertex_id", "x", "y", "z", *rnds("bx", "by_", "bz"))


_SELF = f"""
select a.seq_id, a.frame_id, a.vertex_id as src, b.vertex_id as dst, {_D2} as d2,
       row_number() over (partition by a.seq_id, a.frame_id, a.vertex_id order by {_D2}, b.vertex_id) as rk
from {{t}} a join {{t}} b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and a.vertex_id<>b.vertex_id"""
GRAPH = """
select seq_id, frame_id, src, dst, max(1/(sqrt(d2)+1e-8)) as w from (
select seq_id, frame_id, src, dst, d2 from selfk where rk<=8 and d2>0 union all
select seq_id, frame_id, dst, src, d2 from selfk where rk<=8 and d2>0) group by 1, 2, 3, 4"""


@query("knn_graph", sql(f"select seq_id, frame_id, src, dst, {r('w', 'w')} from graph", selfk=_SELF.format(t="points"), graph=GRAPH))
def knn_graph(spark, sf):
    return co.knn_graph(cut(br.points(spark, sf), "points"), FRAME, 8).select(*FRAME, "src", "dst", rnd("w").alias("w"))


@query("joint_distances", sql(f"""
select a.seq_id, a.frame_id, a.vertex_id, b.k, {r(f'sqrt({_D2})', 'd')} from clouds a join joints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id"""))
def joint_distances(spark, sf):
    d = co.joint_distances(br.clouds(spark, sf), br.joints(spark, sf))
    return d.select(*FRAME, "vertex_id", "k", rnd("d").alias("d"))


@query("correspondence_quality", sql(f"""
select j.seq_id, j.frame_id, {r("case when pn=qn then 0.7e0*exp(-jm)+0.3e0*exp(-sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz))*5) else 0e0 end", 'quality')}
from (select a.seq_id, a.frame_id, avg(sqrt({_D2})) as jm from joints a join joints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id-1 and a.k=b.k group by 1, 2) j
join (select seq_id, frame_id, count(*) as pn, avg(x) as px, avg(y) as py, avg(z) as pz from clouds group by 1, 2) p on p.seq_id=j.seq_id and p.frame_id=j.frame_id
join (select seq_id, frame_id, count(*) as qn, avg(x) as qx, avg(y) as qy, avg(z) as qz from clouds group by 1, 2) q on q.seq_id=j.seq_id and q.frame_id=j.frame_id+1"""))
def correspondence_quality(spark, sf):
    c, j = br.clouds(spark, sf), br.joints(spark, sf)
    return co.correspondence_quality(c, next_frames(c), j, next_frames(j), FRAME).select(*FRAME, rnd("quality").alias("quality"))


_FEATURE = """
select c.seq_id, c.frame_id, c.vertex_id, c.x, c.y, c.z, j.k,
       exp(-3e0*(sqrt((c.x-j.x)*(c.x-j.x)+(c.y-j.y)*(c.y-j.y)+(c.z-j.z)*(c.z-j.z))/(s.extent+1e-8))) as f
from clouds c join (select seq_id, frame_id, sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))+(max(z)-min(z))*(max(z)-min(z))) as extent
                    from clouds group by 1, 2) s on c.seq_id=s.seq_id and c.frame_id=s.frame_id
join joints j on c.seq_id=j.seq_id and c.frame_id=j.frame_id"""


@query("bone_coordinates", sql(f"select seq_id, frame_id, vertex_id, k, {r('f', 'f')} from feature", feature=_FEATURE))
def bone_coordinates(spark, sf):
    out = co.bone_coordinates(br.clouds(spark, sf), br.joints(spark, sf))
    return out.select(*FRAME, "vertex_id", F.posexplode(F.slice("feature", 4, br.JOINT_COUNT)).alias("k", "f")).select(
        *FRAME, "vertex_id", F.col("k").cast("long").alias("k"), rnd("f").alias("f"))


@query("bone_guided_remap", sql(f"""
select seq_id, frame_id, vertex_id, {', '.join(r(f'sum(o{c}/(sqrt(fd)+1e-8))/sum(1/(sqrt(fd)+1e-8))', c, 5) for c in 'xyz')}
from (select *, row_number() over (partition by seq_id, frame_id, vertex_id order by fd, other) as rk from (
select a.seq_id, a.frame_id, a.vertex_id, b.vertex_id as other, b.x as ox, b.y as oy, b.z as oz,
       {_D2}+sum((a.f-b.f)*(a.f-b.f)) as fd
from feature a join feature b on a.seq_id=b.seq_id and a.frame_id=b.frame_id-1 and a.k=b.k
group by a.seq_id, a.frame_id, a.vertex_id, b.vertex_id, a.x, a.y, a.z, b.x, b.y, b.z)) where rk<=3 group by 1, 2, 3""", feature=_FEATURE))
def bone_guided_remap(spark, sf):
    c, j = cut(br.clouds(spark, sf), "clouds"), br.joints(spark, sf)
    nc, nj = next_frames(c), next_frames(j)
    has_next = c.join(nc.select(*FRAME).distinct(), FRAME, "left_semi")
    out = co.bone_guided_remap(has_next, nc, j, nj, FRAME)
    return out.select(*FRAME, "vertex_id", *rnds("x", "y", "z", n=5))


@query("unify_anchor", sql(f"""
select s.seq_id, s.frame_id, a.vertex_id, b.x, b.y, b.z from (select *, n=tn as same from sz) s join points a on a.seq_id=s.seq_id and a.frame_id=s.tf
join points b on b.seq_id=s.seq_id and b.frame_id=s.frame_id and b.vertex_id=a.vertex_id where same
union all select seq_id, frame_id, vertex_id, bx, by_, bz from (
select s.seq_id, s.frame_id, a.vertex_id, b.x as bx, b.y as by_, b.z as bz,
       row_number() over (partition by s.seq_id, s.frame_id, a.vertex_id order by {_D2}, b.vertex_id) as rk
from (select *, n=tn as same from sz) s join points a on a.seq_id=s.seq_id and a.frame_id=s.tf join points b on b.seq_id=s.seq_id and b.frame_id=s.frame_id where not same) where rk=1""",
    tmpl="select seq_id, frame_id as tf, c as tn from (select *, row_number() over (partition by seq_id order by c desc, frame_id) as rn from (select seq_id, frame_id, count(*) as c from points group by 1, 2)) where rn=1",
    sz="select f.seq_id, f.frame_id, f.n, t.tf, t.tn from (select seq_id, frame_id, count(*) as n from points group by 1, 2) f join tmpl t on f.seq_id=t.seq_id"))
def unify_anchor(spark, sf):
    p = cut(br.points(spark, sf), "points")
    return co.unify_anchor(p, nz.select_template(p)).select(*FRAME, "vertex_id", "x", "y", "z")


@query("unify_chain")
def unify_chain(spark, sf):
    c, j = cut(br.clouds(spark, sf), "clouds"), br.joints(spark, sf)
    out = co.unify_chain(c, j, nz.select_template(c))
    return out.select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


_RECON = "select seq_id, frame_id+1 as frame_id, i, j, k, case when (i+j+k)%4=0 then 0.25e0 else 0.75e0 end as p from voxels where frame_id+1<=29"
_REC_SET = "select seq_id, frame_id, i/31.5e0-1 as x, j/31.5e0-1 as y, k/31.5e0-1 as z from recon where p>=0.5e0"
_GT_SET = "select seq_id, frame_id, i/31.5e0-1 as x, j/31.5e0-1 as y, k/31.5e0-1 as z from voxels"


def _voxel_pair(spark, sf):
    gt = nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)
    p = F.when((F.col("i") + F.col("j") + F.col("k")) % 4 == 0, 0.25).otherwise(0.75)
    rec = gt.where("frame_id + 1 <= 29").select("seq_id", (F.col("frame_id") + 1).alias("frame_id"), "i", "j", "k", p.alias("p"))
    return gt, rec


@query("chamfer_voxel", sql(f"""
select seq_id, frame_id, {r('ga+ra', 'chamfer', 9)} from (
select g.seq_id, g.frame_id, avg(d) as ga from (select a.seq_id, a.frame_id, a.x, a.y, a.z, min({_D2}) as d
  from gset a join rset b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3, 4, 5) g group by 1, 2) p join (
select g.seq_id as s2, g.frame_id as f2, avg(d) as ra from (select a.seq_id, a.frame_id, a.x, a.y, a.z, min({_D2}) as d
  from rset a join gset b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3, 4, 5) g group by 1, 2) q on seq_id=s2 and frame_id=f2""",
    recon=_RECON, rset=_REC_SET, gset=_GT_SET))
def chamfer_voxel(spark, sf):
    gt, rec = _voxel_pair(spark, sf)
    return vx.chamfer(gt, rec, 64).select(*FRAME, rnd("chamfer", 9).alias("chamfer"))


@query("chamfer_clip", sql(f"""
select seq_id, {r('avg(ga+ra)', 'chamfer', 9)}, {r('avg(ga+ra)*1e4', 'score', 4)} from (
select g.seq_id, g.frame_id, avg(d) as ga from (select a.seq_id, a.frame_id, a.x, a.y, a.z, min({_D2}) as d
  from gset a join rset b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3, 4, 5) g group by 1, 2) p join (
select g.seq_id as s2, g.frame_id as f2, avg(d) as ra from (select a.seq_id, a.frame_id, a.x, a.y, a.z, min({_D2}) as d
  from rset a join gset b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3, 4, 5) g group by 1, 2) q on seq_id=s2 and frame_id=f2
group by seq_id""", recon=_RECON, rset=_REC_SET, gset=_GT_SET))
def chamfer_clip(spark, sf):
    """Clip value and the final score scaled by 1e4."""
    gt, rec = _voxel_pair(spark, sf)
    out = vx.chamfer_clips(vx.chamfer(gt, rec, 64))
    return out.select("seq_id", rnd("chamfer", 9).alias("chamfer"), rnd(F.col("chamfer") * 1e4, 4).alias("score"))


@query("voxel_bce", sql(f"""
select seq_id, frame_id, {r('sum(t)/262144e0', 'bce', 9)} from (
select coalesce(g.seq_id, q.seq_id) as seq_id, coalesce(g.frame_id, q.frame_id) as frame_id,
       case when g.seq_id is not null then -greatest(case when coalesce(q.p, 0)>0 then ln(q.p) else -100 end, -100)
            else -greatest(case when q.p<1 then ln(1-q.p) else -100 end, -100) end as t
from voxels g full outer join recon q on g.seq_id=q.seq_id and g.frame_id=q.frame_id and g.i=q.i and g.j=q.j and g.k=q.k) group by 1, 2""", recon=_RECON))
def voxel_bce(spark, sf):
    gt, rec = _voxel_pair(spark, sf)
    return vx.voxel_bce(gt, rec, 64).select(*FRAME, rnd("bce", 9).alias("bce"))


@query("temporal_occupancy", sql(f"""
select seq_id, i, j, k, {r('n/t', 'mean_occ')}, {r('(1-n/t+1/t)*least(1, n)', 'dynamic_occ')} from (
select v.seq_id, i, j, k, cast(count(*) as double) as n, any_value(l.t) as t from voxels v join (select seq_id, cast(max(frame_id)+1 as double) as t from voxels group by 1) l on v.seq_id=l.seq_id group by 1, 2, 3, 4)"""))
def temporal_occupancy(spark, sf):
    gt, _ = _voxel_pair(spark, sf)
    return vx.temporal_occupancy(gt).select("seq_id", "i", "j", "k", *rnds("mean_occ", "dynamic_occ"))


@query("surface_faces", sql("""
select v.seq_id, v.frame_id, v.i, v.j, v.k, o.axis, o.side from occ v, (values ('x', -1), ('x', 1), ('y', -1), ('y', 1), ('z', -1), ('z', 1)) o(axis, side)
where not exists (select 1 from occ w where w.seq_id=v.seq_id and w.frame_id=v.frame_id and w.i=v.i+(case when o.axis='x' then o.side else 0 end)
  and w.j=v.j+(case when o.axis='y' then o.side else 0 end) and w.k=v.k+(case when o.axis='z' then o.side else 0 end))""",
    recon=_RECON, occ="select seq_id, frame_id, i, j, k from recon where p>=0.5e0"))
def surface_faces(spark, sf):
    _, rec = _voxel_pair(spark, sf)
    return vx.surface_faces(rec, 0.5)


@query("prefix_anti_join", sql("""
select c_name as seq_id from customer where substring(c_name, 1, 16) not in (
select substring(c_name, 1, 16) from customer where c_acctbal < -900)"""))
def prefix_anti_join(spark, sf):
    """Names whose first characters match an ignored name are dropped."""
    from ..sources.lists import drop_by_prefix
    c = br.table(spark, sf, "customer").select(F.col("c_name").alias("seq_id"), "c_acctbal")
    ignore = c.where("c_acctbal < -900").select("seq_id")
    return drop_by_prefix(c.select("seq_id"), ignore, 16)


@query("unsampled_vertices", sql("select seq_id, frame_id, vertex_id from points where vertex_id%3<>0"))
def unsampled_vertices(spark, sf):
    p = br.points(spark, sf).select(*FRAME, "vertex_id")
    return p.join(p.where("vertex_id % 3 = 0"), [*FRAME, "vertex_id"], "left_anti")


@query("volume_fit_chamfer", sql(f"""
select seq_id, frame_id, {r('avg(d)', 'fit', 9)} from (
select a.seq_id, a.frame_id, a.i, a.j, a.k, min({_D2}) as d
from (select cast(case seq_id when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bigint) as seq_id, frame_id, i, j, k,
      -1e0+i*(2e0/63) as x, -1e0+j*(2e0/63) as y, -1e0+k*(2e0/63) as z from voxels) a
join joints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3, 4, 5) group by 1, 2"""))
def volume_fit_chamfer(spark, sf):
    v = nz.voxelize(br.clouds(spark, sf), 64)
    return vx.volume_fit(v, br.joints(spark, sf), "chamfer", 64).select(*FRAME, rnd("fit", 9).alias("fit"))


@query("volume_fit_gaussian", sql(f"""
select seq_id, frame_id, {r('avg(1-g)', 'fit', 9)} from (
select a.seq_id, a.frame_id, a.i, a.j, a.k, max(exp(-(a.x-b.x)*(a.x-b.x)/w.g)*exp(-(a.y-b.y)*(a.y-b.y)/w.g)*exp(-(a.z-b.z)*(a.z-b.z)/w.g)) as g
from (select cast(case seq_id when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bigint) as seq_id, frame_id, i, j, k,
      -1e0+i*(2e0/63) as x, -1e0+j*(2e0/63) as y, -1e0+k*(2e0/63) as z from voxels) a
join joints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id, (select 2*(1.5e0*4/64)*(1.5e0*4/64) as g) w group by 1, 2, 3, 4, 5) group by 1, 2"""))
def volume_fit_gaussian(spark, sf):
    v = nz.voxelize(br.clouds(spark, sf), 64)
    return vx.volume_fit(v, br.joints(spark, sf), "gaussian", 64, sigma=1.5).select(*FRAME, rnd("fit", 9).alias("fit"))
