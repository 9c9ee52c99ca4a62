"""Queries on rotations, skinning weights, blending, registration and interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..functions import rotation as rot, space
from ..operators import interpolate as ip, normalize as nz, skin as sk, tracks as tr, weights as wt
from ..plans.lineage import cut
from ..schema import FRAME
from ..sources import bridges as br

_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
_REST = "select seq_id, vertex_id, x, y, z from clouds where frame_id=0"
_M9 = [f"r{i}{j}" for i in range(3) for j in range(3)]


def rest_of(spark, sf):
    return br.clouds(spark, sf).where("frame_id = 0").select("seq_id", "vertex_id", "x", "y", "z")


def rest_joints(spark, sf):
    return br.joints(spark, sf).where("frame_id = 0").select("seq_id", "k", "x", "y", "z")


def rest_weights(spark, sf):
    return wt.distance_weights(rest_of(spark, sf), rest_joints(spark, sf), "inverse")


def rest_and_weights(spark, sf):
    """The rest pose, made once, and its weights."""
    rest = cut(rest_of(spark, sf), "rest")
    return rest, wt.distance_weights(rest, rest_joints(spark, sf), "inverse")


def cloud_transforms(spark, sf):
    return br.transforms(br.keypoints(spark, sf)).join(br.frames_of_clouds(spark, sf), FRAME, "left_semi")


@query("rot6d_to_matrix", sql(f"select seq_id, frame_id, k, {rs(*_M9)} from xf"))
def rot6d_to_matrix(spark, sf):
    t = br.transforms(br.keypoints(spark, sf))
    return t.select(*FRAME, "k", *[rnd(F.col("r")[i]).alias(n) for i, n in enumerate(_M9)])


@query("matrix_to_quat", sql(f"select seq_id, frame_id, k, {rs('qx', 'qy', 'qz', 'qw')} from quat"))
def matrix_to_quat(spark, sf):
    t = rot.add_quat(br.transforms(br.keypoints(spark, sf)), "r", "q")
    return t.select(*FRAME, "k", *[rnd(F.col("q")[i]).alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw"))])


_QM = ["1-2*(qy*qy+qz*qz)", "2*(qx*qy-qz*qw)", "2*(qx*qz+qy*qw)", "2*(qx*qy+qz*qw)", "1-2*(qx*qx+qz*qz)", "2*(qy*qz-qx*qw)",
       "2*(qx*qz-qy*qw)", "2*(qy*qz+qx*qw)", "1-2*(qx*qx+qy*qy)"]


@query("quat_to_matrix", sql(f"select seq_id, frame_id, k, {', '.join(r(e, n) for e, n in zip(_QM, _M9))} from quat"))
def quat_to_matrix(spark, sf):
    t = rot.add_quat(br.transforms(br.keypoints(spark, sf)), "r", "q").withColumn("m9", rot.quat_to_matrix(F.col("q")))
    return t.select(*FRAME, "k", *[rnd(F.col("m9")[i]).alias(n) for i, n in enumerate(_M9)])


_QN = ("qx", "qy", "qz", "qw")
_DOT = "a.qx*b.qx+a.qy*b.qy+a.qz*b.qz+a.qw*b.qw"
_QPAIR = f"""select a.seq_id, a.frame_id as frame_a, a.k, s.v as i, s.v/{{d}} as t, {', '.join(f'a.{c} as a{c}' for c in _QN)}, {', '.join(f'b.{c} as b{c}' for c in _QN)},
  {', '.join(f'a.{c} as a{c}' for c in ('tx', 'ty', 'tz'))}, {', '.join(f'b.{c} as b{c}' for c in ('tx', 'ty', 'tz'))}, {_DOT} as d0
from quat a join quat b on a.seq_id=b.seq_id and b.frame_id=a.frame_id+1 and a.k=b.k, range(1, {{e}}) s(v)"""
_COEF = """select *, case when d0<0 then -1e0 else 1e0 end as fl, least(abs(d0), 1e0) as d,
  case when least(abs(d0), 1e0)>0.9995e0 then 1-t else sin((1-t)*acos(least(abs(d0), 1e0)))/sin(acos(least(abs(d0), 1e0))) end as ca,
  case when least(abs(d0), 1e0)>0.9995e0 then t else sin(t*acos(least(abs(d0), 1e0)))/sin(acos(least(abs(d0), 1e0))) end as cb from qpair"""
_MIX = f"""select seq_id, frame_a, k, i, t, {', '.join(f'm{c}/ln as {c}' for c in _QN)}, {', '.join(f'(1-t)*a{c}+t*b{c} as {c}' for c in ('tx', 'ty', 'tz'))} from (
select *, case when d>0.9995e0 then sqrt(mqx*mqx+mqy*mqy+mqz*mqz+mqw*mqw) else 1e0 end as ln from (
select *, {', '.join(f'ca*a{c}+cb*(b{c}*fl) as m{c}' for c in _QN)} from coef))"""
_LMIX = f"""select seq_id, frame_a, k, i, t, {', '.join(f'm{c}/ln as {c}' for c in _QN)}, {', '.join(f'(1-t)*a{c}+t*b{c} as {c}' for c in ('tx', 'ty', 'tz'))} from (
select *, sqrt(mqx*mqx+mqy*mqy+mqz*mqz+mqw*mqw) as ln from (select *, {', '.join(f'(1-t)*a{c}+t*b{c} as m{c}' for c in _QN)} from qpair))"""


def bones_q(spark, sf, clouds_only: bool = False):
    t = cloud_transforms(spark, sf) if clouds_only else br.transforms(br.keypoints(spark, sf))
    return rot.add_quat(t, "r", "q").select(*FRAME, "k", "q", "tx", "ty", "tz")


def _turn(fn):
    def run(spark, sf):
        q = bones_q(spark, sf)
        b = q.select("seq_id", (F.col("frame_id") - 1).alias("frame_id"), "k", F.col("q").alias("bq"))
        both = q.withColumnRenamed("q", "aq").join(b, [*FRAME, "k"]).withColumn(
            "i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).withColumn("t", F.col("i") / 4.0)
        out = fn(both, "aq", "bq", "t", "q")
        return out.select("seq_id", F.col("frame_id").alias("frame_a"), "k", "i", *[rnd(F.col("q")[j]).alias(c) for j, c in enumerate(_QN)])
    return run


_QP4 = _QPAIR.format(d="4e0", e=4)
query("slerp", sql(f"select seq_id, frame_a, k, i, {rs(*_QN)} from mix", qpair=_QP4, coef=_COEF, mix=_MIX))(_turn(rot.add_slerp))
query("nlerp", sql(f"select seq_id, frame_a, k, i, {rs(*_QN)} from mix", qpair=_QP4, mix=_LMIX))(_turn(rot.add_nlerp))


@query("apply_affine", sql(f"""
select c.seq_id, c.frame_id, c.vertex_id, {', '.join(r(f'r{i}0*c.x+r{i}1*c.y+r{i}2*c.z+t{a}', a) for i, a in enumerate('xyz'))}
from clouds c join xf t on c.seq_id=t.seq_id and c.frame_id=t.frame_id and t.k=0"""))
def apply_affine(spark, sf):
    t = cloud_transforms(spark, sf).where("k = 0").select(*FRAME, "m")
    j = br.clouds(spark, sf).join(t, FRAME)
    out = space.apply_affine(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return j.select(*FRAME, "vertex_id", *[rnd(v).alias(c) for v, c in zip(out, "xyz")])


# ---- weights
_JD = f"select a.seq_id, a.vertex_id, b.k, sqrt({_D2}) as d from rest a join (select * from joints where frame_id=0) b on a.seq_id=b.seq_id"
_WEXP = """select seq_id, vertex_id, k, w/(sum(w) over (partition by seq_id, vertex_id)+1e-8) as w from (
select *, row_number() over (partition by seq_id, vertex_id order by w desc, k) as rk from (
select seq_id, vertex_id, k, exp(-2*d)/(sum(exp(-2*d)) over (partition by seq_id, vertex_id)+1e-8) as w from jd)) where rk<=4"""


@query("distance_weights_exp", sql(f"select seq_id, vertex_id, k, {r('w', 'w')} from wexp", rest=_REST, jd=_JD, wexp=_WEXP))
def distance_weights_exp(spark, sf):
    return wt.distance_weights(rest_of(spark, sf), rest_joints(spark, sf), "exp").select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("distance_weights_inverse", sql(f"select seq_id, vertex_id, k, {r('w', 'w')} from weights"))
def distance_weights_inverse(spark, sf):
    return rest_weights(spark, sf).select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("default_weights", sql("select seq_id, vertex_id, cast(0 as bigint) as k, 1e0 as w from rest", rest=_REST))
def default_weights(spark, sf):
    return wt.default_weights(rest_of(spark, sf), 21)


@query("round_robin_weights", sql("select seq_id, vertex_id, vertex_id%21 as k, 1e0 as w from rest", rest=_REST))
def round_robin_weights(spark, sf):
    return wt.default_weights(rest_of(spark, sf), 21, "turn")


_RAW = "select seq_id, vertex_id, k, case when (vertex_id+k)%3=0 then 0e0 else 1/(1+d) end as w from jd"


def _raw_weights(spark, sf):
    from ..operators.correspondence import joint_distances
    d = joint_distances(rest_of(spark, sf), rest_joints(spark, sf), ["seq_id"])
    return d.select("seq_id", "vertex_id", "k", F.when((F.col("vertex_id") + F.col("k")) % 3 == 0, 0.0).otherwise(1 / (1 + F.col("d"))).alias("w"))


@query("normalize_weights", sql(f"select seq_id, vertex_id, k, {r('w/sum(w) over (partition by seq_id, vertex_id)', 'w')} from raw", rest=_REST, jd=_JD, raw=_RAW))
def normalize_weights(spark, sf):
    return wt.normalize_weights(_raw_weights(spark, sf)).select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("weight_sum_report", sql(f"select seq_id, {r('min(s)', 'min_sum')}, {r('max(s)', 'max_sum')}, max(abs(s-1))<=1e-6 as normalized from (select seq_id, vertex_id, sum(w) as s from raw group by 1, 2) group by 1", rest=_REST, jd=_JD, raw=_RAW))
def weight_sum_report(spark, sf):
    return wt.weight_sum_report(_raw_weights(spark, sf)).select("seq_id", *rnds("min_sum", "max_sum"), "normalized")


@query("sparsify_weights", sql(f"""
select seq_id, vertex_id, k, {r('w/sum(w) over (partition by seq_id, vertex_id)', 'w')} from (
select *, row_number() over (partition by seq_id, vertex_id order by w desc, k) as rk from raw) where rk<=8""", rest=_REST, jd=_JD, raw=_RAW))
def sparsify_weights(spark, sf):
    return wt.sparsify_weights(_raw_weights(spark, sf), 8, 0.0).select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("weight_stats", sql(f"""
select seq_id, {r('case when count(*)<max(n)*21 then least(min(w), 0e0) else min(w) end', 'min_w')}, {r('max(w)', 'max_w')},
       {r('1-sum(case when w>1e-6 then 1 else 0 end)/(max(n)*21e0)', 'near_zero')}, {r('sum(case when w>1e-6 then 1e0 else 0e0 end)/max(n)', 'mean_nonzero')}
from (select *, (select count(*) from rest q where q.seq_id=w.seq_id) as n from weights w) group by seq_id""", rest=_REST))
def weight_stats(spark, sf):
    return wt.weight_stats(rest_weights(spark, sf), 21).select("seq_id", *rnds("min_w", "max_w", "near_zero", "mean_nonzero"))


@query("bone_weight_stats", sql(f"""
select w.seq_id, k, {r('case when count(*)<max(n) then 0e0 else min(w) end', 'min_w')}, {r('max(w)', 'max_w')}, {r('sum(w)/max(n)', 'mean_w')}
from weights w join (select seq_id, count(*) as n from rest group by 1) r on r.seq_id=w.seq_id group by 1, 2""", rest=_REST))
def bone_weight_stats(spark, sf):
    n = rest_of(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return wt.bone_weight_stats(rest_weights(spark, sf), n).select("seq_id", "k", *rnds("min_w", "max_w", "mean_w"))


_PAL = ", ".join(f"({k}, {c[0]}e0, {c[1]}e0, {c[2]}e0)" for k, c in enumerate(space.PALETTE))


@query("vertex_colors", sql(f"""
select seq_id, vertex_id, {', '.join(r(f'least(greatest(sum(w*{c}), 0e0), 1e0)', c) for c in ('red', 'green', 'blue'))}
from weights w join (values {_PAL}) p(pk, red, green, blue) on w.k%10=p.pk group by 1, 2"""))
def vertex_colors(spark, sf):
    return wt.vertex_colors(rest_weights(spark, sf)).select("seq_id", "vertex_id", *rnds("red", "green", "blue"))


_SUBW = "select * from weights where vertex_id%3=0"


@query("expand_weights_default", sql(f"select seq_id, vertex_id, k, {r('w', 'w')} from (select seq_id, vertex_id, k, w from weights where vertex_id%3=0 union all select seq_id, vertex_id, 0, 1e0 from rest where vertex_id%3<>0)", rest=_REST))
def expand_weights_default(spark, sf):
    w = rest_weights(spark, sf).where("vertex_id % 3 = 0")
    return wt.expand_weights(w, rest_of(spark, sf), "default").select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("expand_weights_idw", sql(f"""
select seq_id, vertex_id, k, {r('w', 'w')} from (select seq_id, vertex_id, k, w from subw union all
select n.seq_id, n.vertex_id, s.k, sum(n.g*s.w) as w from (
  select *, gg/sum(gg) over (partition by seq_id, vertex_id) as g from (
  select *, 1/(sqrt(d2)+1e-8) as gg from (
  select a.seq_id, a.vertex_id, b.vertex_id as other, {_D2} as d2, row_number() over (partition by a.seq_id, a.vertex_id order by {_D2}, b.vertex_id) as rk
  from rest a join rest b on a.seq_id=b.seq_id and a.vertex_id%3<>0 and b.vertex_id%3=0) where rk<=3)) n
join subw s on s.seq_id=n.seq_id and s.vertex_id=n.other group by 1, 2, 3)""", rest=_REST, subw=_SUBW))
def expand_weights_idw(spark, sf):
    w = rest_weights(spark, sf).where("vertex_id % 3 = 0")
    return wt.expand_weights(w, rest_of(spark, sf), "idw").select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("adapt_weight_layout", sql(f"""
select seq_id, vertex_id, k, {r('w', 'w')} from (
select seq_id, vertex_id, k, w/sum(w) over (partition by seq_id, vertex_id) as w from raw where seq_id<>3 and (seq_id<>2 or k<12)
union all select seq_id, vertex_id, 0, 1e0 from rest where seq_id=3)""", rest=_REST, jd=_JD, raw=_RAW))
def adapt_weight_layout(spark, sf):
    """Sequence 0 arrives as N x K, 1 as K x N, 2 with only 12 bones, 3 with a wrong shape, 4 flat."""
    raw = _raw_weights(spark, sf)
    n = rest_of(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    s, v, k = F.col("seq_id"), F.col("vertex_id"), F.col("k")
    none = F.lit(None).cast("long")
    e = raw.join(n, "seq_id").where((s != 2) | (k < 12)).select(
        "seq_id", F.when(s == 4, none).when((s == 0) | (s == 3), v).otherwise(k).alias("row"),
        F.when(s == 4, k * F.col("n") + v).when((s == 0) | (s == 3), k).otherwise(v).alias("col"), F.col("w").alias("value"))
    shapes = n.withColumn("n_bones", F.lit(21).cast("long")).withColumn("rows", F.when(s == 4, none).when(s == 0, F.col("n")).when(s == 1, 21)
                          .when(s == 2, 12).otherwise(F.col("n") + 1)).withColumn(
        "cols", F.when(s == 4, F.col("n") * 21).when((s == 0) | (s == 3), 21).otherwise(F.col("n")))
    return wt.adapt_weight_layout(e, shapes).select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


_SELF = f"select a.seq_id, a.vertex_id as src, b.vertex_id as dst, {_D2} as d2, row_number() over (partition by a.seq_id, a.vertex_id order by {_D2}, b.vertex_id) as rk from rest a join rest b on a.seq_id=b.seq_id and a.vertex_id<>b.vertex_id"
_EDGE = """select seq_id, src, dst, max(1/(sqrt(d2)+1e-8)) as w from (
select seq_id, src, dst, d2 from selfk where rk<=8 and d2>0 union all select seq_id, dst, src, d2 from selfk where rk<=8 and d2>0) group by 1, 2, 3"""
_SRC = """select seq_id, vertex_id, k, case when d<0.1e0 then exp(-10*d) else 1e0 end as b from (
select *, row_number() over (partition by seq_id, k order by d2, vertex_id) as rk from (select *, d*d as dd from jd2)) where rk<=3 and (d<0.1e0 or rk=1)"""
_JD2 = f"select b.seq_id, b.vertex_id, a.k, {_D2} as d2, sqrt({_D2}) as d from (select * from joints where frame_id=0) a join rest b on a.seq_id=b.seq_id"
_PULL = "select e.seq_id, e.src as to_, e.dst as vertex_id, 0.01e0*e.w/dg.diag as c from edge e join diag dg on e.seq_id=dg.seq_id and e.src=dg.src"
_OWN = "select s.seq_id, s.vertex_id, s.k, s.b/coalesce(dg.diag, 1e0) as w from hsrc s left join diag dg on s.seq_id=dg.seq_id and s.vertex_id=dg.src"
_HSTEP = "select seq_id, vertex_id, k, sum(w) as w from (select seq_id, vertex_id, k, w from own union all select p.seq_id, p.to_, h.k, p.c*h.w from {0} h join pull p on h.seq_id=p.seq_id and h.vertex_id=p.vertex_id) group by 1, 2, 3"
_HEAT = dict(rest=_REST, selfk=_SELF, edge=_EDGE, jd2=_JD2, hsrc=_SRC, diag="select seq_id, src, 1+0.01e0*sum(w) as diag from edge group by 1, 2",
             pull=_PULL, own=_OWN, h1=_HSTEP.format("own"), h2=_HSTEP.format("h1"), h3=_HSTEP.format("h2"))


@query("heat_weights", sql(f"""
select seq_id, vertex_id, k, {r('w/sum(w) over (partition by seq_id, vertex_id)', 'w')} from (
select *, row_number() over (partition by seq_id, vertex_id order by w desc, k) as rk from (
select seq_id, vertex_id, k, round(w/sum(w) over (partition by seq_id, vertex_id), 12) as w from h3 where w>0)) where rk<=8""", **_HEAT))
def heat_weights(spark, sf):
    """Three diffusion steps, which SQL can unroll: vertices further from all heat have no row.  ``heat_weights_settled`` is whole."""
    w = wt.heat_weights(rest_of(spark, sf), rest_joints(spark, sf), iterations=3)
    return w.select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


@query("heat_weights_settled")
def heat_weights_settled(spark, sf):
    """Diffusion until settled, which SQL cannot follow."""
    w = wt.heat_weights(rest_of(spark, sf), rest_joints(spark, sf))
    return w.select("seq_id", "vertex_id", "k", rnd("w").alias("w"))


# ---- blending
_LBS = f"""select t.seq_id, t.frame_id, v.vertex_id, {', '.join(f'sum(w.w*(r{i}0*v.x+r{i}1*v.y+r{i}2*v.z+t{a})) as {a}' for i, a in enumerate('xyz'))}
from rest v join weights w on v.seq_id=w.seq_id and v.vertex_id=w.vertex_id and w.w>1e-6 join (select * from xf where (seq_id, frame_id) in (select seq_id, frame_id from clouds)) t on t.seq_id=v.seq_id and t.k=w.k group by 1, 2, 3"""


def _lbs(spark, sf):
    return sk.linear_blend_skin(rest_of(spark, sf), rest_weights(spark, sf), cloud_transforms(spark, sf))


@query("linear_blend_skin", sql(f"select seq_id, frame_id, vertex_id, {rs('x', 'y', 'z')} from lbs", rest=_REST, lbs=_LBS))
def linear_blend_skin(spark, sf):
    return _lbs(spark, sf).select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("reconstruction_error", sql(f"""
select a.seq_id, a.frame_id, {r(f'avg(sqrt({_D2}))', 'mean_error')}, {r(f'max(sqrt({_D2}))', 'max_error')}
from lbs a join clouds b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and a.vertex_id=b.vertex_id group by 1, 2""", rest=_REST, lbs=_LBS))
def reconstruction_error(spark, sf):
    return sk.reconstruction_error(_lbs(spark, sf), br.clouds(spark, sf)).select(*FRAME, *rnds("mean_error", "max_error"))


_MOVE = "select a.seq_id, a.frame_id, a.k, a.x-b.x as x, a.y-b.y as y, a.z-b.z as z from joints a join joints b on a.seq_id=b.seq_id and a.k=b.k and b.frame_id=0"
_TSK = f"""select t.seq_id, t.frame_id, v.vertex_id, {', '.join(f'any_value(v.{a})+sum(w.w*t.{a}) as {a}' for a in 'xyz')}
from rest v join weights w on v.seq_id=w.seq_id and v.vertex_id=w.vertex_id join mv t on t.seq_id=v.seq_id and t.k=w.k group by 1, 2, 3"""


@query("translation_skin", sql(f"select seq_id, frame_id, vertex_id, {rs('x', 'y', 'z')} from tsk", rest=_REST, mv=_MOVE, tsk=_TSK))
def translation_skin(spark, sf):
    moves = sk.joint_moves(br.joints(spark, sf), rest_joints(spark, sf))
    return sk.translation_skin(rest_of(spark, sf), rest_weights(spark, sf), moves).select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("bone_translations", sql(f"select seq_id, frame_id, k, {r('x', 'tx')}, {r('y', 'ty')}, {r('z', 'tz')} from mv", mv=_MOVE))
def bone_translations(spark, sf):
    t = sk.bone_translations(br.joints(spark, sf), rest_joints(spark, sf))
    return t.select(*FRAME, "k", *[rnd(F.col("m")[4 * i + 3]).alias(f"t{c}") for i, c in enumerate("xyz")])


@query("deform_to_frames", sql(f"select seq_id, frame_id, vertex_id, {rs('x', 'y', 'z')} from tsk where frame_id<>0 union all select seq_id, 0, vertex_id, {rs('x', 'y', 'z')} from rest", rest=_REST, mv=_MOVE, tsk=_TSK))
def deform_to_frames(spark, sf):
    rest = rest_of(spark, sf)
    tmpl = rest.select("seq_id").distinct().withColumn("frame_id", F.lit(0).cast("long"))
    return sk.deform_to_frames(rest, rest_weights(spark, sf), br.joints(spark, sf), tmpl).select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("identity_transforms", sql("select f.seq_id, f.frame_id, b.k, 12 as n, 3e0 as total from (select distinct seq_id, frame_id from keypoints) f, bones b"))
def identity_transforms(spark, sf):
    t = sk.identity_transforms(br.keypoints(spark, sf).select(*FRAME).distinct(), br.bones(spark, sf))
    return t.select(*FRAME, "k", F.size("m").alias("n"), F.aggregate("m", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("deformation_magnitude", sql(f"select a.seq_id, a.frame_id, a.vertex_id, {r(f'sqrt({_D2})', 'magnitude')} from clouds a join rest b on a.seq_id=b.seq_id and a.vertex_id=b.vertex_id", rest=_REST))
def deformation_magnitude(spark, sf):
    return sk.deformation_magnitude(br.clouds(spark, sf), rest_of(spark, sf)).select(*FRAME, "vertex_id", rnd("magnitude").alias("magnitude"))


_DET = "sc*sc*sc*(r00*(r11*r22-r12*r21)-r01*(r10*r22-r12*r20)+r02*(r10*r21-r11*r20))"


@query("transform_validity", sql(f"select seq_id, {r(f'avg(case when abs(abs({_DET})-1)<0.1e0 then 1e0 else 0e0 end)', 'validity')}, count(*) as n from (select *, 1+(k%5)*0.02e0 as sc from xf) group by 1"))
def transform_validity(spark, sf):
    """Matrices are scaled by 1 + 0.02 (k mod 5), so some fail."""
    t = br.transforms(br.keypoints(spark, sf))
    scaled = t.withColumn("m", F.transform("m", lambda v: v * (1 + (F.col("k") % 5) * 0.02)))
    return sk.transform_validity(scaled).select("seq_id", rnd("validity").alias("validity"), "n")


@query("fit_bone_motion")
def fit_bone_motion(spark, sf):
    fit = sk.fit_bone_motion(br.clouds(spark, sf), rest_of(spark, sf), rest_weights(spark, sf))
    return fit.select(*FRAME, "k", *rnds("tx", "ty", "tz"))


@query("rigid_align")
def rigid_align(spark, sf):
    """Every frame registered to the next one, with the operator's own scales and rounds."""
    c = cut(br.clouds(spark, sf), "clouds")
    nxt = c.where("frame_id >= 1").withColumn("frame_id", F.col("frame_id") - 1)
    src = c.join(nxt.select(*FRAME).distinct(), FRAME, "left_semi")
    return sk.rigid_align(src, nxt).select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


_SLIGHT = "0.002*(1+frame_id%3)"


@query("rigid_align_known", sql(f"""
select seq_id, frame_id, vertex_id, {r('cos(a)*x-sin(a)*y+0.001e0', 'x', 5)}, {r('sin(a)*x+cos(a)*y-0.002e0', 'y', 5)}, {r('z+0.0015e0', 'z', 5)}
from (select *, {_SLIGHT} as a from clouds)"""))
def rigid_align_known(spark, sf):
    """Every frame registered to itself after a slight turn about z and a shift, which the registration must find."""
    c = cut(br.clouds(spark, sf), "clouds")
    a = F.expr(_SLIGHT)
    moved = c.select(*FRAME, "vertex_id", (F.cos(a) * F.col("x") - F.sin(a) * F.col("y") + 0.001).alias("x"),
                     (F.sin(a) * F.col("x") + F.cos(a) * F.col("y") - 0.002).alias("y"), (F.col("z") + 0.0015).alias("z"))
    return sk.rigid_align(c, moved).select(*FRAME, "vertex_id", *rnds("x", "y", "z", n=5))


# ---- interpolation
def _pairs(spark, sf, df=None):
    return ip.consecutive_pairs(br.points(spark, sf) if df is None else df)


from .matching import MATCH_VIEWS  # noqa: E402

_STEPS = "range(0, 5) s(v)"
_PK = "seq_id, frame_id as frame_a, frame_id+1 as frame_b"


def _direct_sql(view):
    return sql(f"select {_PK}, cast(s.v as integer) as step, vertex_id, " + ", ".join(
        r(f"(1-s.v/4e0)*{a}+s.v/4e0*{b}", a, 5) for a, b in (("x", "bx"), ("y", "by_"), ("z", "bz"))) + f" from {view}, {_STEPS}", **MATCH_VIEWS)


def _direct(method):
    def run(spark, sf):
        p = cut(br.points(spark, sf), "points")
        return ip.interpolate_direct(p, _pairs(spark, sf, p), 4, method).select(*ip.PAIR, "step", "vertex_id", *rnds("x", "y", "z", n=5))
    return run


query("interpolate_direct", _direct_sql("mapped"))(_direct("nearest"))
query("interpolate_idw", _direct_sql("mapped_idw"))(_direct("idw"))


@query("interpolate_skeleton", sql(f"""
select seq_id, frame_id as frame_a, frame_id+1 as frame_b, cast(s.v as integer) as step, vertex_id, {', '.join(r(f'r{a}+s.v/4e0*m{a}', a) for a in 'xyz')}
from (select t.seq_id, t.frame_id, v.vertex_id, {', '.join(f'any_value(v.{a}) as r{a}, sum(w.w*t.{a}) as m{a}' for a in 'xyz')}
from rest v join weights w on v.seq_id=w.seq_id and v.vertex_id=w.vertex_id join step1 t on t.seq_id=v.seq_id and t.k=w.k group by 1, 2, 3), {_STEPS}""",
    rest=_REST, step1="select a.seq_id, a.frame_id, a.k, b.x-a.x as x, b.y-a.y as y, b.z-a.z as z from joints a join joints b on a.seq_id=b.seq_id and a.k=b.k and b.frame_id=a.frame_id+1"))
def interpolate_skeleton(spark, sf):
    j = br.joints(spark, sf)
    out = ip.interpolate_skeleton(rest_of(spark, sf), rest_weights(spark, sf), j, _pairs(spark, sf, j), 4)
    return out.select(*ip.PAIR, "step", "vertex_id", *rnds("x", "y", "z"))


@query("interpolate_joints", sql(f"""
select seq_id, frame_id as frame_a, frame_id+1 as frame_b, cast(step as integer) as step, k, {', '.join(r(f'(1-step/4e0)*{c}+step/4e0*n{c}', c) for c in 'xyz')}
from (select *, unnest([0, 1, 2, 3, 4]) as step from stepped where nf=frame_id+1)""",
    stepped="select *, " + ", ".join(f"lead({c}) over w as n{c}" for c in "xyz") + ", lead(frame_id) over w as nf from keypoints window w as (partition by seq_id, k order by frame_id)"))
def interpolate_joints(spark, sf):
    k = br.keypoints(spark, sf)
    return ip.interpolate_joints(k, _pairs(spark, sf, k), 4).select(*ip.PAIR, "step", "k", *rnds("x", "y", "z"))


_QP3 = _QPAIR.format(d="3e0", e=3).replace("from quat a join quat b", "from quat a join quat b") + " where (a.seq_id, a.frame_id) in (select seq_id, frame_id from clouds) and (b.seq_id, b.frame_id) in (select seq_id, frame_id from clouds)"
_POSE = f"""select q.seq_id, q.frame_a*2+q.i-1 as frame_id, v.vertex_id, {', '.join(f"sum(w.w*(({_QM[3*i]})*v.x+({_QM[3*i+1]})*v.y+({_QM[3*i+2]})*v.z+t{a})) as {a}" for i, a in enumerate('xyz'))}
from rest v join weights w on v.seq_id=w.seq_id and v.vertex_id=w.vertex_id and w.w>1e-6 join mix q on q.seq_id=v.seq_id and q.k=w.k group by 1, 2, 3"""


def _pose(method):
    def run(spark, sf):
        b = cut(bones_q(spark, sf, True), "bones")
        out = ip.interpolate_pose(*rest_and_weights(spark, sf), b, _pairs(spark, sf, b), 2, method)
        return out.select(*FRAME, "vertex_id", *rnds("x", "y", "z"))
    return run


query("interpolate_pose_slerp", sql(f"select seq_id, frame_id, vertex_id, {rs('x', 'y', 'z')} from pose", rest=_REST, qpair=_QP3, coef=_COEF, mix=_MIX, pose=_POSE))(_pose("slerp"))
query("interpolate_pose_linear", sql(f"select seq_id, frame_id, vertex_id, {rs('x', 'y', 'z')} from pose", rest=_REST, qpair=_QP3, mix=_LMIX, pose=_POSE))(_pose("linear"))

_KEYS = [0, 4, 9, 15, 22, 29]


_WEIGHTS = ", ".join(f"({i}, {k}, {c!r})" for i, row in enumerate(ip.spline_coefficients(np.array(_KEYS, float), np.linspace(_KEYS[0], _KEYS[-1], 40)))
                     for k, c in zip(_KEYS, row.tolist()))


@query("spline_translation", sql(f"""
select seq_id, i as frame_id, k, {', '.join(r(f'sum(c*t{a})', f't{a}') for a in 'xyz')} from quat join (values {_WEIGHTS}) w(i, key, c) on frame_id=key
where seq_id in (select seq_id from clouds) group by 1, 2, 3"""))
def spline_translation(spark, sf):
    s = ip.interpolate_spline(bones_q(spark, sf, True), _KEYS, 40)
    return s.select(*FRAME, "k", *rnds("tx", "ty", "tz"))


_KV = ", ".join(f"({a}, {b})" for a, b in zip(_KEYS, _KEYS[1:]))
_SPOT = f"select i, t, ka, kb, (t-ka)/(kb-ka) as u from (select v as i, v*(29e0/39) as t from range(0, 40) r(v)) join (values {_KV}) k(ka, kb) on (t>ka and t<=kb) or (t=0 and ka=0)"
_SQPAIR = f"""select a.seq_id, s.i as frame_a, a.k, s.i, s.u as t, {', '.join(f'a.{c} as a{c}' for c in _QN)}, {', '.join(f'b.{c} as b{c}' for c in _QN)},
  {', '.join(f'a.{c} as a{c}' for c in ('tx', 'ty', 'tz'))}, {', '.join(f'b.{c} as b{c}' for c in ('tx', 'ty', 'tz'))}, {_DOT} as d0
from spot s join quat a on a.frame_id=s.ka join quat b on b.frame_id=s.kb and a.seq_id=b.seq_id and a.k=b.k where a.seq_id in (select seq_id from clouds)"""


@query("spline_rotation", sql(f"select seq_id, frame_a as frame_id, k, {rs(*_QN)} from mix", spot=_SPOT, qpair=_SQPAIR, coef=_COEF, mix=_MIX))
def spline_rotation(spark, sf):
    s = ip.interpolate_spline(bones_q(spark, sf, True), _KEYS, 40)
    return s.select(*FRAME, "k", *[rnd(F.col("q")[i]).alias(c) for i, c in enumerate(_QN)])


@query("spline_segments", sql(f"""
select t.seq_id, t.t, cast(k.ka as double) as key_a, cast(k.kb as double) as key_b, {r('(t.t-k.ka)/(k.kb-k.ka)', 'u')} from (select seq_id, frame_id/2e0 as t from keypoints where k=0) t
join (select seq_id, key as ka, lead(key) over (partition by seq_id order by key) as kb from ks) k on k.seq_id=t.seq_id and ((t.t>k.ka and t.t<=k.kb) or (t.t=0 and k.ka=0))""",
    ks="select distinct seq_id, frame_id as key from keypoints where frame_id%7=0"))
def spline_segments(spark, sf):
    k = br.keypoints(spark, sf)
    times = k.where("k = 0").select("seq_id", (F.col("frame_id") / 2.0).alias("t"))
    keys = k.where("frame_id % 7 = 0").select("seq_id", F.col("frame_id").alias("key")).distinct()
    return ip.spline_segments(times, keys).select("seq_id", "t", "key_a", "key_b", rnd("u").alias("u"))


@query("interpolate_unified", sql(f"""
select a.seq_id, a.frame_id as frame_a, b.frame_id as frame_b, cast(s.v as integer) as step, a.vertex_id, {', '.join(r(f'(1-s.v/4e0)*a.{c}+s.v/4e0*b.{c}', c) for c in 'xyz')}
from uni a join uni b on a.seq_id=b.seq_id and a.vertex_id=b.vertex_id and b.frame_id=a.frame_id+1, {_STEPS}""", rest=_REST, mv=_MOVE, tsk=_TSK,
    uni="select seq_id, frame_id, vertex_id, x, y, z from tsk where frame_id<>0 union all select seq_id, 0, vertex_id, x, y, z from rest"))
def interpolate_unified(spark, sf):
    rest, weights = rest_and_weights(spark, sf)
    tmpl = rest.select("seq_id").distinct().withColumn("frame_id", F.lit(0).cast("long"))
    uni = sk.deform_to_frames(rest, weights, br.joints(spark, sf), tmpl)
    _, chosen = ip.choose_unified({"skeleton_driven": uni})
    return ip.interpolate_unified(chosen, _pairs(spark, sf, chosen), 4).select(*ip.PAIR, "step", "vertex_id", *rnds("x", "y", "z"))


@query("interpolate_original", sql(f"""
select f.seq_id, f.frame_id as frame_a, f.frame_id+1 as frame_b, cast(s.v as integer) as step, r.vertex_id, {', '.join(r(f'(1-s.v/4e0)*r.{c}+s.v/4e0*r.{c}', c) for c in 'xyz')}
from (select distinct seq_id, frame_id from clouds where frame_id<29) f join rest r on f.seq_id=r.seq_id, {_STEPS}""", rest=_REST))
def interpolate_original(spark, sf):
    """The fall-back set: the rest pose in every frame."""
    c = br.clouds(spark, sf)
    uni = ip.original_unified(rest_of(spark, sf), c)
    _, chosen = ip.choose_unified({"original": uni})
    return ip.interpolate_unified(chosen, _pairs(spark, sf, c), 4).select(*ip.PAIR, "step", "vertex_id", *rnds("x", "y", "z"))


@query("unified_joints", sql(f"select m.seq_id, m.frame_id, m.k, {', '.join(r(f'j.{c}+m.{c}', c) for c in 'xyz')} from mv m join joints j on j.seq_id=m.seq_id and j.k=m.k and j.frame_id=0", mv=_MOVE))
def unified_joints(spark, sf):
    t = sk.bone_translations(br.joints(spark, sf), rest_joints(spark, sf))
    return ip.unified_joints(rest_joints(spark, sf), t).select(*FRAME, "k", *rnds("x", "y", "z"))


@query("interpolation_manifest", sql(f"""
select seq_id, frame_id as frame_a, frame_id+1 as frame_b, 'direct' as method, cast(s.v as integer) as step, s.v/4e0 as t, printf('interpolated_%03d_t%.3f.obj', s.v, s.v/4e0) as file
from (select distinct seq_id, frame_id from points where frame_id<29), {_STEPS}"""))
def interpolation_manifest(spark, sf):
    return ip.manifest(_pairs(spark, sf), "direct", 4)


@query("compare_methods", sql(f"""
select 'nearest' as method, count(distinct (seq_id, frame_id))*5 as meshes, count(*)*5 as vertices, 0e0 as mean_change, 0e0 as max_change from mapped
union all select 'idw', count(distinct (i.seq_id, i.frame_id))*5, count(*)*5,
  {r('sum(greatest(abs(i.bx-m.bx), abs(i.by_-m.by_), abs(i.bz-m.bz))*2.5e0)/(count(*)*5)', n=4)}, {r('max(greatest(abs(i.bx-m.bx), abs(i.by_-m.by_), abs(i.bz-m.bz)))', n=4)}
from mapped_idw i join mapped m on i.seq_id=m.seq_id and i.frame_id=m.frame_id and i.vertex_id=m.vertex_id""", **MATCH_VIEWS))
def compare_methods(spark, sf):
    p = cut(br.points(spark, sf), "points")
    pairs = _pairs(spark, sf, p)
    c = ip.compare_matched({m: ip.matched_pairs(p, pairs, m) for m in ("nearest", "idw")}, "nearest", 4)
    return c.select("method", "meshes", "vertices", *rnds("mean_change", "max_change", n=4))
