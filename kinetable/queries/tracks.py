"""Queries on joint tracks, heat maps, detections and metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..functions import space
from ..operators import tracks as tr
from ..schema import FRAME
from ..sources import bridges as br

_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
_PAIRS = f"select a.seq_id, a.frame_id, a.k as src, b.k as dst, a.intensity, {_D2} as d2 from keypoints a join keypoints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id"
_INFL = "select graph_id as seq_id, src, dst, max(w) as infl from affinity group by 1, 2, 3"
_INFL2 = "select a.seq_id, a.src, a.dst, a.infl+b.infl as infl from infl a join infl b on a.seq_id=b.seq_id and a.src=b.dst and a.dst=b.src"


@query("motion_derivatives", sql(f"""
select seq_id, frame_id, k, {', '.join(r(f'{c}-{c}1', f'v{c}') for c in 'xyz')}, {', '.join(r(f'({c}-{c}1)-({c}1-{c}2)', f'a{c}') for c in 'xyz')},
       {r('(i0+i1)/2', 'vi')}, {r('((i0+i1)/2+(i1+i2)/2)/2', 'ai')} from lagged where x1 is not null""",
    lagged="""select seq_id, frame_id, k, x, y, z, intensity as i0, lag(x) over w as x1, lag(y) over w as y1, lag(z) over w as z1, lag(intensity) over w as i1,
       lag(x, 2) over w as x2, lag(y, 2) over w as y2, lag(z, 2) over w as z2, lag(intensity, 2) over w as i2
       from keypoints window w as (partition by seq_id, k order by frame_id)"""))
def motion_derivatives(spark, sf):
    return tr.motion(br.keypoints(spark, sf)).select(*FRAME, "k", *rnds("vx", "vy", "vz", "ax", "ay", "az", "vi", "ai"))


@query("displacement", sql(f"""
select seq_id, frame_id, k, {', '.join(r(f'{c}-avg({c}) over (partition by seq_id, k)', c) for c in 'xyz')} from keypoints"""))
def displacement(spark, sf):
    return tr.displacement(br.keypoints(spark, sf)).select(*FRAME, "k", *rnds("x", "y", "z"))


@query("next_frame", sql("""
select seq_id, frame_id, coalesce(lead(frame_id) over (partition by seq_id order by frame_id), frame_id) as next_id
from (select distinct seq_id, frame_id from keypoints)"""))
def next_frame(spark, sf):
    return tr.next_frame(br.keypoints(spark, sf).select(*FRAME).distinct())


@query("joint_pairs", sql(f"select seq_id, frame_id, src, dst, {r('d2', 'd2')} from pairs", pairs=_PAIRS))
def joint_pairs(spark, sf):
    return tr.joint_pairs(br.keypoints(spark, sf)).select(*FRAME, "src", "dst", rnd("d2").alias("d2"))


@query("temporal_separation", sql(f"""
select seq_id, {r('(sum(exp(-d2/(2*0.2e0*0.2e0)))-21)/(21e0*20)', 'separation')} from (
select a.seq_id, a.k, b.k as k2, avg({_D2}) as d2 from disp a join disp b on a.seq_id=b.seq_id and a.frame_id=b.frame_id group by 1, 2, 3) group by 1""",
    disp="select seq_id, frame_id, k, x-avg(x) over w as x, y-avg(y) over w as y, z-avg(z) over w as z from keypoints window w as (partition by seq_id, k)"))
def temporal_separation(spark, sf):
    return tr.temporal_separation(br.keypoints(spark, sf), 0.2).select("seq_id", rnd("separation").alias("separation"))


_CONS = """select seq_id, frame_id, {l}, {t} from (
select p.seq_id, p.frame_id, sum(p.d2*{w}) as l, sum(abs(p.d2-m.m)*{w}) as t
from pairs p join {i} i on p.seq_id=i.seq_id and p.src=i.src and p.dst=i.dst
join (select seq_id, src, dst, avg(d2) as m from pairs group by 1, 2, 3) m on m.seq_id=p.seq_id and m.src=p.src and m.dst=p.dst group by 1, 2)"""
_CL, _CT = r("l/441e0", "local", 9), r("t/441e0", "time", 9)


def _consistency(ver):
    def run(spark, sf):
        k = br.keypoints(spark, sf)
        return tr.graph_consistency(k, br.affinity(k), ver).select(*FRAME, *rnds("local", "time", n=9))
    return run


query("graph_consistency", sql(_CONS.format(l=_CL, t=_CT, w="i.infl*p.intensity", i="infl"), pairs=_PAIRS, infl=_INFL))(_consistency(0))
query("graph_consistency_plain", sql(_CONS.format(l=_CL, t=_CT, w="i.infl", i="infl"), pairs=_PAIRS, infl=_INFL))(_consistency(1))
query("graph_consistency_symmetric", sql(_CONS.format(l=_CL, t=_CT, w="i.infl*p.intensity", i="infl2"), pairs=_PAIRS, infl=_INFL, infl2=_INFL2))(_consistency(2))


@query("affinity_complexity", sql(f"""
select graph_id, {r('sum(v)/441e0', 'complexity', 9)} from (
select a.graph_id, a.src, a.dst, sum(a.w*b.w*a.w*b.w) as v from affinity a join affinity b on a.graph_id=b.graph_id and a.src=b.src and a.dst=b.dst and a.n<>b.n group by 1, 2, 3) group by 1"""))
def affinity_complexity(spark, sf):
    return tr.affinity_complexity(br.affinity(br.keypoints(spark, sf))).select("graph_id", rnd("complexity", 9).alias("complexity"))


_MOTION = """select seq_id, frame_id, k, x-x1 as vx, y-y1 as vy, z-z1 as vz, (x-x1)-(x1-x2) as ax, (y-y1)-(y1-y2) as ay, (z-z1)-(z1-z2) as az,
  (i0+i1)/2 as vi, ((i0+i1)/2+(i1+i2)/2)/2 as ai from (
select seq_id, frame_id, k, x, y, z, intensity as i0, lag(x) over w as x1, lag(y) over w as y1, lag(z) over w as z1, lag(intensity) over w as i1,
       lag(x, 2) over w as x2, lag(y, 2) over w as y2, lag(z, 2) over w as z2, lag(intensity, 2) over w as i2
       from keypoints window w as (partition by seq_id, k order by frame_id)) where x1 is not null"""
_COS = "(1-(a.{p}x*b.{p}x+a.{p}y*b.{p}y+a.{p}z*b.{p}z)/greatest(sqrt(a.{p}x*a.{p}x+a.{p}y*a.{p}y+a.{p}z*a.{p}z)*sqrt(b.{p}x*b.{p}x+b.{p}y*b.{p}y+b.{p}z*b.{p}z), 1e-6))/2"
_TRAJ = "select p.seq_id, {out} from (select a.seq_id, sum({v}) as v, sum({a}) as a from mot a join mot b on a.seq_id=b.seq_id and a.frame_id=b.frame_id join {i} i on i.seq_id=a.seq_id and i.src=a.k and i.dst=b.k group by 1) p join (select seq_id, cast(max(frame_id)+1 as double) as t from keypoints group by 1) l on p.seq_id=l.seq_id"
_TOUT = r("(v/(t-1)+a/(t-2))/441e0", "trajectory", 9)


def _trajectory(ver):
    def run(spark, sf):
        k = br.keypoints(spark, sf)
        return tr.trajectory_similarity(k, br.affinity(k), ver).select("seq_id", rnd("trajectory", 9).alias("trajectory"))
    return run


query("trajectory_similarity", sql(_TRAJ.format(out=_TOUT, v=_COS.format(p="v") + "*i.infl*a.vi", a=_COS.format(p="a") + "*i.infl*a.ai", i="infl"), mot=_MOTION, infl=_INFL))(_trajectory(0))
query("trajectory_similarity_plain", sql(_TRAJ.format(out=_TOUT, v=_COS.format(p="v") + "*i.infl", a=_COS.format(p="a") + "*i.infl", i="infl"), mot=_MOTION, infl=_INFL))(_trajectory(1))
query("trajectory_similarity_symmetric", sql(_TRAJ.format(out=_TOUT, v=_COS.format(p="v") + "*i.infl*a.vi", a=_COS.format(p="a") + "*i.infl*a.ai", i="infl2"), mot=_MOTION, infl=_INFL, infl2=_INFL2))(_trajectory(2))

_BONE = f"select a.seq_id, a.frame_id, a.k, c.parent, sqrt({_D2}) as length from keypoints a join bones c on a.k=c.k and c.parent>=0 join keypoints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and b.k=c.parent"


@query("bone_lengths", sql(f"select seq_id, frame_id, k, parent, {r('length', 'length')} from bl", bl=_BONE))
def bone_lengths(spark, sf):
    return tr.bone_lengths(br.keypoints(spark, sf), br.bones(spark, sf)).select(*FRAME, "k", "parent", rnd("length").alias("length"))


@query("bone_length_stats", sql(f"select seq_id, frame_id, {r('avg(length)', 'mean_length')}, {r('stddev_pop(length)', 'std_length')} from bl group by 1, 2", bl=_BONE))
def bone_length_stats(spark, sf):
    b = tr.bone_lengths(br.keypoints(spark, sf), br.bones(spark, sf))
    return b.groupBy(*FRAME).agg(rnd(F.avg("length")).alias("mean_length"), rnd(F.stddev_pop("length")).alias("std_length"))


@query("median_bone_length", sql(f"select seq_id, k, parent, {r('quantile_disc(length, 0.5)', 'median_length')} from bl group by 1, 2, 3", bl=_BONE))
def median_bone_length(spark, sf):
    return tr.median_bone_lengths(br.keypoints(spark, sf), br.bones(spark, sf)).select(
        "seq_id", "k", "parent", rnd("median_length").alias("median_length"))


def _gt(spark, sf):
    """True joints for scoring: fourteen joints of each track, slightly displaced along z."""
    return br.keypoints(spark, sf).where("k < 14").withColumn("x", F.col("x") + F.col("z") * 0.3)


_GT = "select seq_id, frame_id, k, x+z*0.3e0 as x, y, z from keypoints where k<14"
_MASKED = "select seq_id, frame_id, k, case when intensity<0.2e0 then 1e4 else x end as x, case when intensity<0.2e0 then 1e4 else y end as y, case when intensity<0.2e0 then 1e4 else z end as z from keypoints"
_DET = f"select seq_id, frame_id, k_gt, k_det from (select a.seq_id, a.frame_id, a.k as k_gt, b.k as k_det, row_number() over (partition by a.seq_id, a.frame_id, a.k order by {_D2}, b.k) as rk from gt a join masked b on a.seq_id=b.seq_id and a.frame_id=b.frame_id) where rk=1"


@query("closest_detection", sql("select seq_id, frame_id, k_gt, k_det from det", gt=_GT, masked=_MASKED, det=_DET))
def closest_detection(spark, sf):
    from ..operators.clips import mask_low_confidence
    return tr.closest_detection(_gt(spark, sf), mask_low_confidence(br.keypoints(spark, sf)))


@query("semantic_counts", sql("select k_gt, k_det, count(*) as n from det group by 1, 2", gt=_GT, masked=_MASKED, det=_DET))
def semantic_counts(spark, sf):
    from ..operators.clips import mask_low_confidence
    return tr.semantic_counts(_gt(spark, sf), mask_low_confidence(br.keypoints(spark, sf)))


@query("semantic_scores", sql(f"""
select k_gt, {r('max(n)/sum(n)', 'log_score')}, {r('max(n)/(select sum(n) from cnt where k_gt=0)', 'final_score')} from cnt group by 1""",
    gt=_GT, masked=_MASKED, det=_DET, cnt="select k_gt, k_det, cast(count(*) as double) as n from det group by 1, 2"))
def semantic_scores(spark, sf):
    from ..operators.clips import mask_low_confidence
    counts = tr.semantic_counts(_gt(spark, sf), mask_low_confidence(br.keypoints(spark, sf)))
    return tr.semantic_scores(counts).select("k_gt", *rnds("log_score", "final_score"))


@query("semantic_final", sql(f"""
select {r('avg(m/t)', 'score')} from (select k_gt, max(n) as m from cnt group by 1), (select sum(n) as t from cnt where k_gt=0)""",
    gt=_GT, masked=_MASKED, det=_DET, cnt="select k_gt, k_det, cast(count(*) as double) as n from det group by 1, 2"))
def semantic_final(spark, sf):
    return tr.semantic_scores(semantic_counts(spark, sf)).agg(rnd(F.avg("final_score")).alias("score"))


_SA = """select frame_id, k, sum(hh*(-1+i*(2e0/7)))/sum(hh) as x, sum(hh*(-1+j*(2e0/7)))/sum(hh) as y, sum(hh*(-1+l*(2e0/7)))/sum(hh) as z, sum(h)/512 as m from (
select c.frame_id, c.k, i.v as i, j.v as j, l.v as l, coalesce(q.h, 0) as h, coalesce(q.h, 0)+1e-6 as hh
from (select distinct frame_id, k from heat) c, range(0, 8) i(v), range(0, 8) j(v), range(0, 8) l(v)
left join heat q on q.frame_id=c.frame_id and q.k=c.k and q.i=i.v and q.j=j.v and q.l=l.v) group by 1, 2"""


@query("soft_argmax", sql(f"""
select frame_id, k, {rs('x', 'y', 'z')}, {r('m/(max(m) over (partition by frame_id)+1e-6)', 'intensity')} from sa""", sa=_SA))
def soft_argmax(spark, sf):
    return tr.soft_argmax(br.heat(br.points(spark, sf)), ["frame_id"], 8).select("frame_id", "k", *rnds("x", "y", "z", "intensity"))


@query("heat_sparsity", sql(f"select frame_id, {r('sum(m)/5e0', 'sparsity', 12)} from (select frame_id, k, abs(sum(h)/512) as m from heat group by 1, 2) group by 1"))
def heat_sparsity(spark, sf):
    return tr.heat_sparsity(br.heat(br.points(spark, sf)), ["frame_id"], 8, 5).select("frame_id", rnd("sparsity", 12).alias("sparsity"))


_G = "2*(1.5e0/8)*(1.5e0/8)"
_REND = f"""select a.seq_id, a.frame_id, a.k, i.v as i, j.v as j, l.v as l,
  intensity*exp(-(-1+i.v*(2e0/7)-x)*(-1+i.v*(2e0/7)-x)/({_G}))*exp(-(-1+j.v*(2e0/7)-y)*(-1+j.v*(2e0/7)-y)/({_G}))*exp(-(-1+l.v*(2e0/7)-z)*(-1+l.v*(2e0/7)-z)/({_G})) as g
from keypoints a, range(0, 8) i(v), range(0, 8) j(v), range(0, 8) l(v)"""


@query("gaussian_render", sql(f"select seq_id, frame_id, k, count(*) as n_cells, {r('sum(g)', 'total')}, {r('max(g)', 'peak')} from rend group by 1, 2, 3", rend=_REND))
def gaussian_render(spark, sf):
    g = tr.gaussian_render(br.keypoints(spark, sf), 8, 1.5)
    return g.groupBy(*FRAME, "k").agg(F.count(F.lit(1)).alias("n_cells"), rnd(F.sum("g")).alias("total"), rnd(F.max("g")).alias("peak"))


@query("gaussian_combine_max", sql(f"select seq_id, frame_id, i, j, l, {r('max(g)', 'g')} from rend group by 1, 2, 3, 4, 5", rend=_REND))
def gaussian_combine_max(spark, sf):
    g = tr.gaussian_combine(tr.gaussian_render(br.keypoints(spark, sf), 8, 1.5), "max")
    return g.select(*FRAME, *[F.col(c).cast("long").alias(c) for c in "ijl"], rnd("g").alias("g"))


@query("gaussian_combine_sum", sql(f"select seq_id, frame_id, i, j, l, {r('greatest(least(sum(g), 1e0), 0e0)', 'g')} from rend group by 1, 2, 3, 4, 5", rend=_REND))
def gaussian_combine_sum(spark, sf):
    g = tr.gaussian_combine(tr.gaussian_render(br.keypoints(spark, sf), 8, 1.5), "sum")
    return g.select(*FRAME, *[F.col(c).cast("long").alias(c) for c in "ijl"], rnd("g").alias("g"))


_NR = ("r00-1", "r01", "r02", "r10", "r11-1", "r12", "r20", "r21", "r22-1")
_SCORES = f"""
select m.seq_id, m.frame_id, 1/(l.ls/(l.lm+1e-6)+0.01e0) as stability, 1/(t.turn+0.1e0) as rotation, s.spread*c.coverage as distribution,
       1/(sqrt((c.jx-m.mx)*(c.jx-m.mx)+(c.jy-m.my)*(c.jy-m.my)+(c.jz-m.mz)*(c.jz-m.mz))+0.1e0) as alignment, l.hs/21e0 as hierarchy, 1/(m.volume+1e-6) as compactness
from (select seq_id, frame_id, avg(x) as mx, avg(y) as my, avg(z) as mz, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) as volume from clouds group by 1, 2) m
join cen c on c.seq_id=m.seq_id and c.frame_id=m.frame_id
join (select j.seq_id, j.frame_id, stddev_pop(sqrt((x-jx)*(x-jx)+(y-jy)*(y-jy)+(z-jz)*(z-jz))) as spread from joints j join cen c on c.seq_id=j.seq_id and c.frame_id=j.frame_id group by 1, 2) s on s.seq_id=m.seq_id and s.frame_id=m.frame_id
join (select seq_id, frame_id, avg(sqrt({'+'.join(f'({e})*({e})' for e in _NR)})) as turn from xf group by 1, 2) t on t.seq_id=m.seq_id and t.frame_id=m.frame_id
join (select a.seq_id, a.frame_id, stddev_pop(sqrt({_D2})) as ls, avg(sqrt({_D2})) as lm, sum(1/(sqrt({_D2})+0.1e0)) as hs from joints a join bones c on a.k=c.k and c.parent>=0 join joints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and b.k=c.parent group by 1, 2) l on l.seq_id=m.seq_id and l.frame_id=m.frame_id"""
_CEN = "select seq_id, frame_id, avg(x) as jx, avg(y) as jy, avg(z) as jz, (max(x)-min(x)+max(y)-min(y)+max(z)-min(z))/3 as coverage from joints group by 1, 2"
_TOTAL = "3*stability+2*rotation+1.5e0*distribution+alignment+hierarchy+0.5e0*compactness"
_PARTS = ("stability", "rotation", "distribution", "alignment", "hierarchy", "compactness")


def _rest_scores(spark, sf):
    return tr.rest_pose_scores(br.clouds(spark, sf), br.joints(spark, sf), br.bones(spark, sf), br.transforms(br.keypoints(spark, sf)))


@query("rest_pose_scores", sql(f"select seq_id, frame_id, {rs(*_PARTS, n=5)}, {r(_TOTAL, 'score', 5)} from scores", scores=_SCORES, cen=_CEN))
def rest_pose_scores(spark, sf):
    return _rest_scores(spark, sf).select(*FRAME, *rnds(*_PARTS, "score", n=5))


@query("best_rest_pose", sql(f"select seq_id, frame_id from (select seq_id, frame_id, row_number() over (partition by seq_id order by {_TOTAL} desc, frame_id) as rk from scores) where rk=1", scores=_SCORES, cen=_CEN))
def best_rest_pose(spark, sf):
    return tr.best_rest_pose(_rest_scores(spark, sf))


_OTHER = "select seq_id, frame_id-1 as frame_id, k, x, y, z, intensity from keypoints where frame_id>=1"
_COST = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.intensity-b.intensity)*(a.intensity-b.intensity)"


@query("keypoint_recon_error", sql(f"select a.seq_id, a.frame_id, {r(f'sum({_COST})', 'error')} from keypoints a join other b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and a.k=b.k group by 1, 2", other=_OTHER))
def keypoint_recon_error(spark, sf):
    k = br.keypoints(spark, sf)
    nxt = k.where("frame_id >= 1").withColumn("frame_id", F.col("frame_id") - 1)
    return tr.keypoint_recon_error(k, nxt).select(*FRAME, rnd("error").alias("error"))


@query("best_candidate", sql(f"""
select seq_id, frame_id, sample, {r('cost', 'cost')} from (select *, row_number() over (partition by seq_id, frame_id order by cost, sample) as rk from (
select a.seq_id, a.frame_id, s.v as sample, sum({_COST}) as cost from keypoints a join keypoints b on a.seq_id=b.seq_id and a.k=b.k, range(1, 6) s(v)
where b.frame_id=a.frame_id+s.v group by 1, 2, 3)) where rk=1"""))
def best_candidate(spark, sf):
    """Candidates for a frame are the five frames after it."""
    k = br.keypoints(spark, sf)
    s = k.withColumn("sample", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).withColumn(
        "frame_id", F.col("frame_id") - F.col("sample"))
    return tr.best_candidate(k, s).select(*FRAME, "sample", rnd("cost").alias("cost"))


@query("metric_epoch_mean", sql(f"select epoch, key, {r('avg(value)', 'value', 9)} from metrics group by 1, 2"))
def metric_epoch_mean(spark, sf):
    return tr.metric_epoch_mean(br.metrics(spark, sf)).select("epoch", "key", rnd("value", 9).alias("value"))


@query("metric_weighted_total", sql(f"""
select epoch, {r("sum(v*case key when 'click' then 2e0 when 'error' then 0.5e0 else 1e0 end)", 'total', 9)} from (select epoch, key, avg(value) as v from metrics group by 1, 2) group by 1"""))
def metric_weighted_total(spark, sf):
    t = tr.weighted_total(tr.metric_epoch_mean(br.metrics(spark, sf)), {"click": 2.0, "error": 0.5})
    return t.select("epoch", rnd("total", 9).alias("total"))


_SP = "(greatest({0}, 0e0)+ln(1+exp(-abs({0}))))"


@query("normal_kl", sql(f"""
select seq_id, frame_id, {r("avg(ln(s2/s1)+(s1*s1+(m1-m2)*(m1-m2))/(2*s2*s2)-0.5e0)", 'kl')} from (
select seq_id, frame_id, x as m1, y as m2, {_SP.format('z')}+1e-4 as s1, {_SP.format('intensity')}+1e-4 as s2 from keypoints) group by 1, 2"""))
def normal_kl(spark, sf):
    k = br.keypoints(spark, sf).select(*FRAME, F.col("x").alias("m1"), F.col("z").alias("raw1"), F.col("y").alias("m2"), F.col("intensity").alias("raw2"))
    return tr.normal_kl_mean(k, FRAME).select(*FRAME, rnd("kl").alias("kl"))


@query("activations", sql(f"select seq_id, frame_id, k, {r(_SP.format('x*40'), 'softplus')}, {r('1/(1+exp(-x))', 'sigmoid')}, {r('exp(-(x*x+y*y+z*z)/(2*0.3e0*0.3e0))', 'gauss')} from keypoints"))
def activations(spark, sf):
    n2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return br.keypoints(spark, sf).select(*FRAME, "k", rnd(space.softplus(F.col("x") * 40)).alias("softplus"),
                                          rnd(space.sigmoid(F.col("x"))).alias("sigmoid"), rnd(space.gauss(n2, 0.3)).alias("gauss"))


@query("vector_helpers", sql(f"""
select seq_id, frame_id, k, {r('x/nl', 'ux')}, {r('y/nl', 'uy')}, {r('z/nl', 'uz')}, {r('y*nz-z*ny', 'cx')}, {r('z*nx-x*nz', 'cy')}, {r('x*ny-y*nx', 'cz')}, {r('x*nx+y*ny+z*nz', 'dot')} from bone_axes"""))
def vector_helpers(spark, sf):
    k = br.keypoints(spark, sf)
    n = k.select(*FRAME, ((F.col("k") + 20) % 21).alias("k"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    df = k.join(n, [*FRAME, "k"])
    a, b = [F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]
    return df.select(*FRAME, "k", *[rnd(e).alias(f"u{c}") for e, c in zip(space.unit3(*a), "xyz")],
                     *[rnd(e).alias(f"c{c}") for e, c in zip(space.cross3(a, b), "xyz")], rnd(space.dot3(a, b)).alias("dot"))
