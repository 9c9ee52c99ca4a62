"""Queries on affinity graphs and skeleton trees; every joint track gives one graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..operators import trees as tg, tracks as tr
from ..schema import FRAME
from ..sources import bridges as br

NB = 2


def _affinity(spark, sf):
    return br.affinity(br.keypoints(spark, sf))


def _nodes(aff):
    return aff.select("graph_id", F.col("src").alias("k")).distinct()


_PARAM = "select graph_id, n, src, dst, ln(w)*3+src*0.01e0 as p from affinity union all select graph_id, n, src, src, 0.5e0 from (select distinct graph_id, n, src from affinity)"
_PARAM3 = "select graph_id, n, src, case when dst>src then dst-1 else dst end as dst, ln(w)*3 as p from affinity"


def _params(spark, sf, diagonal=True):
    a = _affinity(spark, sf)
    if not diagonal:
        return a.select("graph_id", "n", "src", F.when(F.col("dst") > F.col("src"), F.col("dst") - 1).otherwise(F.col("dst")).alias("dst"),
                        (F.log("w") * 3).alias("p"))
    d = a.select("graph_id", "n", "src").distinct().select("graph_id", "n", "src", F.col("src").alias("dst"), F.lit(0.5).alias("p"))
    return a.select("graph_id", "n", "src", "dst", (F.log("w") * 3 + F.col("src") * 0.01).alias("p")).unionByName(d)


_SPL = "greatest(p, 0e0)+ln(1+exp(-abs(p)))"
_W0 = "select graph_id, n, src, dst, exp(p)/sum(exp(p)) over (partition by graph_id, n, src) as w from {0}"


def _soft(ver):
    def run(spark, sf):
        out = tg.softmax_affinity(_params(spark, sf, ver < 3), ver)
        return out.select("graph_id", "n", "src", "dst", rnd("w", 8).alias("w"))
    return run


_OUT = f"select graph_id, n, src, dst, {r('w', 'w', 8)} from "
query("softmax_affinity_plain", sql(_OUT + "w0", params=_PARAM, w0=_W0.format("params")))(_soft(0))
query("softmax_affinity_product", sql(f"select graph_id, n, src, dst, {r('e/(sum(e) over (partition by graph_id, n, src)+1e-6)', 'w', 8)} from prod",
    params=_PARAM, sp=f"select graph_id, n, src, dst, {_SPL} as s from params",
    prod="select a.graph_id, a.n, a.src, b.src as dst, sum(a.s*b.s) as e from sp a join sp b on a.graph_id=b.graph_id and a.n=b.n and a.dst=b.dst and a.src<>b.src group by 1, 2, 3, 4"))(_soft(1))
query("softmax_affinity_softplus", sql(_OUT + "w0", params=_PARAM, sp=f"select graph_id, n, src, dst, case when src=dst then 0e0 else {_SPL} end as p from params",
    w0=_W0.format("sp")))(_soft(2))
query("softmax_affinity_shifted", sql(_OUT + "(select graph_id, n, src, case when dst>=src then dst+1 else dst end as dst, w from w0 union all select distinct graph_id, n, src, src, 0e0 from affinity)",
    params=_PARAM3, w0=_W0.format("params")))(_soft(3))
query("softmax_affinity_gumbel")(_soft(4))

_INFL = "select graph_id, src, dst, max(w) as infl from affinity group by 1, 2, 3"
_BEST = f"select graph_id, src, dst from (select *, row_number() over (partition by graph_id, src order by infl desc, dst) as rk from infl) where rk<={NB}"
_EDGES = "select graph_id, src, dst from best union select graph_id, dst, src from best"
_NODES = "select distinct graph_id, src as k from affinity"


@query("influence", sql(f"select graph_id, src, dst, {r('infl', 'infl', 8)} from infl", infl=_INFL))
def influence(spark, sf):
    return tr.influence(_affinity(spark, sf)).select("graph_id", "src", "dst", rnd("infl", 8).alias("infl"))


@query("binary_adjacency", sql("select graph_id, src, dst from edges", infl=_INFL, best=_BEST, edges=_EDGES))
def binary_adjacency(spark, sf):
    return tg.binary_adjacency(_affinity(spark, sf), NB)


def _hop_views(edges: str = "edges", prefix: str = "") -> dict[str, str]:
    """Hop distances by widening reach: twenty rounds cover the longest path of 21 nodes."""
    v = {f"{prefix}p0": "select graph_id, k as src, k as dst, 0 as d from nodes"}
    for i in range(1, 21):
        v[f"{prefix}p{i}"] = (f"select graph_id, src, dst, min(d) as d from (select * from {prefix}p{i-1} union all select p.graph_id, p.src, e.dst, p.d+1 "
                              f"from {prefix}p{i-1} p join {edges} e on p.graph_id=e.graph_id and p.dst=e.src) group by 1, 2, 3")
    v[f"{prefix}hops"] = (f"select a.graph_id, a.k as src, b.k as dst, cast(coalesce(p.d, 10000) as double) as d from nodes a join nodes b on a.graph_id=b.graph_id "
                          f"left join {prefix}p20 p on p.graph_id=a.graph_id and p.src=a.k and p.dst=b.k")
    return v


_BASE = dict(nodes=_NODES, infl=_INFL, best=_BEST, edges=_EDGES)


@query("all_pairs_hops", sql("select graph_id, src, dst, d from hops", **_BASE, **_hop_views()))
def all_pairs_hops(spark, sf):
    a = _affinity(spark, sf)
    return tg.all_pairs_hops(_nodes(a), tg.binary_adjacency(a, NB)).select("graph_id", "src", "dst", "d")


@query("most_central", sql("""
select graph_id, k as root from (select graph_id, src as k, row_number() over (partition by graph_id order by sum(d), src) as rk from hops group by graph_id, src) where rk=1""",
    **_BASE, **_hop_views()))
def most_central(spark, sf):
    a = _affinity(spark, sf)
    return tg.most_central(tg.all_pairs_hops(_nodes(a), tg.binary_adjacency(a, NB)))


@query("connect_components")
def connect_components(spark, sf):
    """One neighbour per node leaves several components in most graphs."""
    a = _affinity(spark, sf)
    edges, _ = tg.connect_components(_nodes(a), tg.binary_adjacency(a, 1))
    return edges


@query("tie_break_weights")
def tie_break_weights(spark, sf):
    a = _affinity(spark, sf)
    edges, dense = tg.connect_components(_nodes(a), tg.binary_adjacency(a, NB))
    return tg.tie_break_weights(edges, dense, tr.influence(a)).select("graph_id", "src", "dst", rnd("len", 7).alias("len"))


@query("skeleton_from_affinity")
def skeleton_from_affinity(spark, sf):
    return tg.skeleton_from_affinity(_affinity(spark, sf), NB).select("graph_id", "k", "parent", rnd("rank", 7).alias("rank"))


# parent tables from the data: each joint track as one skeleton, with parents drawn from the positions
_BONES = """select seq_id*4294967296+frame_id as skeleton_id, k, case when k=0 then -1 else cast(floor(abs(x)*1000000) as bigint)%k end as parent from keypoints"""


def _trees(spark, sf):
    k = br.keypoints(spark, sf)
    draw = F.floor(F.abs("x") * 1000000).cast("long") % F.greatest(F.col("k"), F.lit(1))
    return k.select(_skeleton().alias("skeleton_id"), "k", F.when(F.col("k") == 0, -1).otherwise(draw).cast("long").alias("parent"))


def _skeleton():
    """A skeleton per track and frame: 2^32 frames before ids meet."""
    return F.col("seq_id") * (1 << 32) + F.col("frame_id")


def _loose(spark, sf):
    k = br.keypoints(spark, sf)
    draw = F.floor(F.abs("x") * 1000000).cast("long") % 21
    return k.select(_skeleton().alias("skeleton_id"), "k",
                    F.when(F.col("k") == 5, -1).otherwise(draw).cast("long").alias("parent"))


_LOOSE = "select seq_id*4294967296+frame_id as skeleton_id, k, case when k=5 then -1 else cast(floor(abs(x)*1000000) as bigint)%21 end as parent from keypoints"


def _depth_views(src: str) -> dict[str, str]:
    v = {"lv0": f"select skeleton_id, k, parent, 0 as depth from {src} where parent<0 or parent=k"}
    for i in range(1, 21):
        v[f"lv{i}"] = f"select b.skeleton_id, b.k, b.parent, {i} as depth from {src} b join lv{i-1} u on b.skeleton_id=u.skeleton_id and b.parent=u.k where b.parent<>b.k"
    return v


@query("tree_order", sql("select skeleton_id, k, parent, depth from (" + " union all ".join(f"select * from lv{i}" for i in range(21)) + ")", trees=_BONES, **_depth_views("trees")))
def tree_order(spark, sf):
    return tg.tree_order(_trees(spark, sf))


@query("has_cycle", sql("select t.skeleton_id, count(*) > max(c) as has_cycle from loose t join (select skeleton_id, count(*) as c from (" +
                        " union all ".join(f"select skeleton_id, k from lv{i}" for i in range(21)) + ") group by 1) r on r.skeleton_id=t.skeleton_id group by 1", loose=_LOOSE, **_depth_views("loose")))
def has_cycle(spark, sf):
    """A random parent table per frame; a graph without a cycle is one whose every bone hangs on a root."""
    return tg.has_cycle(_loose(spark, sf))


_JUMP = {"j0": "select skeleton_id, k, k as low, case when parent<0 or parent=k then null else parent end as to_ from loose"}
for _i in range(1, 6):  # 32 steps pass through any cycle of 21 bones
    _JUMP[f"j{_i}"] = f"select a.skeleton_id, a.k, least(a.low, b.low) as low, b.to_ as to_ from j{_i-1} a left join j{_i-1} b on a.skeleton_id=b.skeleton_id and a.to_=b.k"


@query("sanitize_parents", sql("""
select l.skeleton_id, l.k, cast(case when l.parent=l.k or (c.k is not null and j.low=l.k) then -1 else l.parent end as bigint) as parent
from loose l join j5 j on j.skeleton_id=l.skeleton_id and j.k=l.k
left join (select distinct skeleton_id, to_ as k from j5 where to_ is not null) c on c.skeleton_id=l.skeleton_id and c.k=l.k""",
    loose=_LOOSE, **_JUMP))
def sanitize_parents(spark, sf):
    return tg.sanitize_parents(_loose(spark, sf))


@query("parent_adjacency", sql("select skeleton_id, k as src, parent as dst from trees where parent>=0 union select skeleton_id, parent, k from trees where parent>=0", trees=_BONES))
def parent_adjacency(spark, sf):
    return tg.parent_adjacency(_trees(spark, sf))


@query("bone_edges", sql("select skeleton_id, k, parent from loose where parent>=0 and parent<>k", loose=_LOOSE))
def bone_edges(spark, sf):
    return tg.bone_edges(_loose(spark, sf))


_MED = "select a.seq_id, a.k, quantile_disc(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 0.5) as m from keypoints a join bones c on a.k=c.k and c.parent>=0 join keypoints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and b.k=c.parent group by 1, 2"
_OFF = "select m.seq_id, m.k, " + ", ".join(f"d.d{c}/(sqrt(d.dx*d.dx+d.dy*d.dy+d.dz*d.dz)+1e-10)*m.m as o{c}" for c in "xyz") + " from med m join (select k, avg(x) as dx, avg(y) as dy, avg(z) as dz from keypoints group by 1) d on d.k=m.k"


def _offsets(spark, sf):
    k = br.keypoints(spark, sf)
    med = tr.median_bone_lengths(k, br.bones(spark, sf)).select("seq_id", "k", "median_length")
    dirs = k.groupBy("k").agg(*[F.avg(c).alias(f"d{c}") for c in "xyz"])
    return tg.bone_offsets(dirs, med)


@query("bone_offsets", sql(f"select seq_id, k, {rs('ox', 'oy', 'oz')} from off", med=_MED, off=_OFF))
def bone_offsets(spark, sf):
    return _offsets(spark, sf).select("seq_id", "k", *rnds("ox", "oy", "oz"))


def _fk_views(inverse: bool) -> dict[str, str]:
    m = [[f"{{0}}.r{i}{j}" for j in range(3)] for i in range(3)]
    a, b = ("l", "u") if inverse else ("u", "l")
    prod = {f"r{i}{j}": "+".join(f"{a}.r{i}{x}*{b}.r{x}{j}" for x in range(3)) for i in range(3) for j in range(3)}
    rcols = ", ".join(f"r{i}{j}" for i in range(3) for j in range(3))
    v = {"med": _MED, "off": _OFF, "fk0": f"select seq_id, frame_id, k, {rcols}, tx as x, ty as y, tz as z from xf where k=0"}
    for d in range(1, 5):
        v[f"fkm{d}"] = f"select l.seq_id, l.frame_id, l.k, {', '.join(f'{e} as {n}' for n, e in prod.items())}, u.x as px, u.y as py, u.z as pz from xf l join bones c on c.k=l.k join fk{d-1} u on u.seq_id=l.seq_id and u.frame_id=l.frame_id and u.k=c.parent"
        v[f"fk{d}"] = f"select f.seq_id, f.frame_id, f.k, {rcols}, " + ", ".join(
            f"r{i}0*o.ox+r{i}1*o.oy+r{i}2*o.oz+p{c} as {c}" for i, c in enumerate("xyz")) + f" from fkm{d} f join off o on o.seq_id=f.seq_id and o.k=f.k"
    return v


def _fk(inverse):
    def run(spark, sf):
        k = br.keypoints(spark, sf)
        tree = tg.tree_order(br.bones(spark, sf).withColumn("skeleton_id", F.lit(0))).select("k", "parent", "depth")
        roots = k.where("k = 0").select(*FRAME, "x", "y", "z")
        out = tg.forward_kinematics(br.transforms(k).select(*FRAME, "k", "r"), tree, _offsets(spark, sf), roots, inverse)
        return out.select(*FRAME, "k", *rnds("x", "y", "z", n=5), rnd(F.col("rg")[1], 5).alias("r01"))
    return run


_FKOUT = "select seq_id, frame_id, k, " + rs("x", "y", "z", "r01", n=5) + " from (" + " union all ".join(f"select seq_id, frame_id, k, x, y, z, r01 from fk{d}" for d in range(5)) + ")"
query("forward_kinematics", sql(_FKOUT, **_fk_views(False)))(_fk(False))
query("forward_kinematics_inverse", sql(_FKOUT, **_fk_views(True)))(_fk(True))
