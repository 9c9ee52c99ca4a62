"""Queries on point clouds: boxes, normalisation, occupancy, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .common import r, rnd, rnds, rs
from .views import sql
from ..functions import space
from ..operators import normalize as nz
from ..schema import FRAME
from ..sources import bridges as br


@query("voxel_occupancy", sql(f"""
select seq_id, frame_id, count(*) as n_cells, cast(sum(n) as bigint) as n_points, {r('count(*)/262144e0', 'fill_ratio', 9)}
from voxels group by seq_id, frame_id"""))
def voxel_occupancy(spark, sf):
    """Flagship: normalise per sequence, voxelise at 64, occupied cells and fill ratio per frame."""
    cells = nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)
    return cells.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_points"),
        (F.round(F.count(F.lit(1)) / F.lit(64.0 ** 3), 9) + F.lit(0.0)).alias("fill_ratio"))


@query("bind_axes", sql("select seq_id, frame_id, vertex_id, x as bx, -z+0e0 as by_, y as bz from points"))
def bind_axes(spark, sf):
    x, y, z = space.bind_axes(F.col("x"), F.col("y"), F.col("z"))
    return br.points(spark, sf).select(*FRAME, "vertex_id", x.alias("bx"), (y + 0.0).alias("by_"), z.alias("bz"))


_BOX = "min(x) as bmin_x, max(x) as bmax_x, min(y) as bmin_y, max(y) as bmax_y, min(z) as bmin_z, max(z) as bmax_z, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen"


@query("bbox_frame", sql(f"select seq_id, frame_id, {_BOX} from points group by seq_id, frame_id"))
def bbox_frame(spark, sf):
    return nz.bbox(br.points(spark, sf), "frame")


@query("bbox_sequence", sql(f"select seq_id, {_BOX} from li_points group by seq_id"))
def bbox_sequence(spark, sf):
    return nz.bbox(br.lineitem_points(spark, sf), "sequence")


@query("bbox_all", sql(f"select {_BOX} from points"))
def bbox_all(spark, sf):
    return nz.bbox(br.points(spark, sf), "all")


def _unit(p, b, scale="1e0", xt="0e0", zt="0e0"):
    return (f"{r(f'((p.x-{b}.bx)*{scale}/({b}.blen+1e-5))*2-1+{xt}', 'x')}, "
            f"{r(f'((p.y-{b}.by_)*{scale}/({b}.blen+1e-5))*2-1', 'y')}, "
            f"{r(f'((p.z-{b}.bz)*{scale}/({b}.blen+1e-5))*2-1+{zt}', 'z')}")


@query("normalize_frame", sql(f"""select p.seq_id, p.frame_id, p.vertex_id, {_unit('p', 'b')}
from points p join frame_box b on p.seq_id=b.seq_id and p.frame_id=b.frame_id"""))
def normalize_frame(spark, sf):
    return nz.normalize(br.points(spark, sf), "frame").select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("normalize_sequence", sql(f"""select p.seq_id, p.frame_id, p.vertex_id, {_unit('p', 'b', '0.7e0', '0.25e0', '-0.5e0')}
from points p join seq_box b on p.seq_id=b.seq_id"""))
def normalize_sequence(spark, sf):
    return nz.normalize(br.points(spark, sf), "sequence", scale=0.7, x_trans=0.25, z_trans=-0.5).select(
        *FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("normalize_all", sql(f"""select p.seq_id, p.frame_id, p.vertex_id, {_unit('p', 'b')}
from points p, (select min(x) as bx, min(y) as by_, min(z) as bz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen from points) b"""))
def normalize_all(spark, sf):
    return nz.normalize(br.points(spark, sf), "all").select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("normalize_joints", sql(f"""
select p.seq_id, p.frame_id, p.k, {_unit('p', 'b', '0.7e0')}
from joints p join (select seq_id, min(x) as bx, min(y) as by_, min(z) as bz,
  greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen from clouds group by seq_id) b on p.seq_id=b.seq_id"""))
def normalize_joints(spark, sf):
    return nz.normalize_joints(br.joints(spark, sf), br.clouds(spark, sf), "sequence", 0.7).select(*FRAME, "k", *rnds("x", "y", "z"))


@query("denormalize", sql(f"""
select u.seq_id, u.frame_id, u.vertex_id, {r('(u.x+1)*0.5e0*b.blen+b.bx', 'x')}, {r('(u.y+1)*0.5e0*b.blen+b.by_', 'y')},
       {r('(u.z+1)*0.5e0*b.blen+b.bz', 'z')} from unit_points u join seq_box b on u.seq_id=b.seq_id"""))
def denormalize(spark, sf):
    p = br.points(spark, sf)
    box = nz.bbox(p, "sequence")
    return nz.denormalize(nz.normalize(p, "sequence", box=box), box, "sequence").select(*FRAME, "vertex_id", *rnds("x", "y", "z"))


@query("voxelize", sql("select seq_id, frame_id, i, j, k, n from voxels"))
def voxelize(spark, sf):
    return nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)


@query("voxelize_lineitem", sql("""
select q.seq_id, frame_id, cast(trunc((((x-bx)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as i,
       cast(trunc((((y-by_)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as j,
       cast(trunc((((z-bz)/(blen+1e-5))*2-1+1)/(2e0/64+1e-5)) as integer) as k, count(*) as n
from li_points q join li_box b on q.seq_id=b.seq_id group by 1, 2, 3, 4, 5""", li_box="""
select seq_id, min(x) as bx, min(y) as by_, min(z) as bz,
       greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen from li_points group by seq_id"""))
def voxelize_lineitem(spark, sf):
    return nz.voxelize(nz.normalize(br.lineitem_points(spark, sf), "sequence"), 64)


_WIDE = "select *, x*1.5e0 as wx, y*1.5e0 as wy, z*1.5e0 as wz from unit_points"
_WCELL = lambda a: f"cast(trunc((w{a}+1)/(2e0/16+1e-5)) as integer)"


def _wide_points(spark, sf):
    p = nz.normalize(br.points(spark, sf), "sequence")
    return p.withColumns({a: F.col(a) * 1.5 for a in "xyz"})


@query("voxelize_drop", sql(f"""select seq_id, frame_id, i, j, k, count(*) as n from (
select seq_id, frame_id, {_WCELL('x')} as i, {_WCELL('y')} as j, {_WCELL('z')} as k from wide)
where least(i, j, k)>=0 and greatest(i, j, k)<16 group by 1, 2, 3, 4, 5""", wide=_WIDE))
def voxelize_drop(spark, sf):
    return nz.voxelize(_wide_points(spark, sf), 16, "drop")


@query("voxelize_clip", sql(f"""select seq_id, frame_id, i, j, k, count(*) as n from (
select seq_id, frame_id, least(greatest({_WCELL('x')}, 0), 15) as i, least(greatest({_WCELL('y')}, 0), 15) as j,
       least(greatest({_WCELL('z')}, 0), 15) as k from wide) group by 1, 2, 3, 4, 5""", wide=_WIDE))
def voxelize_clip(spark, sf):
    return nz.voxelize(_wide_points(spark, sf), 16, "clip")


@query("voxel_center", sql(f"select seq_id, frame_id, i, j, k, {r('i/31.5e0-1', 'x')}, {r('j/31.5e0-1', 'y')}, {r('k/31.5e0-1', 'z')} from voxels"))
def voxel_center(spark, sf):
    v = nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)
    return nz.voxel_centers(v, 64).select(*FRAME, "i", "j", "k", *rnds("x", "y", "z"))


@query("marching_to_world", sql(f"""
select v.seq_id, v.frame_id, i, j, k, {r('i/63e0*b.blen+b.bx', 'x')}, {r('j/63e0*b.blen+b.by_', 'y')}, {r('k/63e0*b.blen+b.bz', 'z')}
from voxels v join seq_box b on v.seq_id=b.seq_id"""))
def marching_to_world(spark, sf):
    p = br.points(spark, sf)
    box = nz.bbox(p, "sequence")
    v = nz.with_box(nz.voxelize(nz.normalize(p, "sequence", box=box), 64), box, "sequence")
    return v.select(*FRAME, "i", "j", "k", *[
        rnd(space.marching_to_world(F.col(c), 64, F.col(f"bmin_{a}"), F.col("blen"))).alias(a) for a, c in zip("xyz", "ijk")])


@query("coord_grid", sql(f"""
select seq_id, frame_id, count(*) as n, {r('sum(d)', 'sum_d2', 4)}, {r('min(d)', 'min_d2')}
from (select c.seq_id, c.frame_id, (c.x-(-1+i.v*(2e0/7)))*(c.x-(-1+i.v*(2e0/7)))+(c.y-(-1+j.v*(2e0/7)))*(c.y-(-1+j.v*(2e0/7)))+(c.z-(-1+k.v*(2e0/7)))*(c.z-(-1+k.v*(2e0/7))) as d
      from (select seq_id, frame_id, avg(x) as x, avg(y) as y, avg(z) as z from unit_points group by seq_id, frame_id) c,
           range(0, 8) i(v), range(0, 8) j(v), range(0, 8) k(v)) group by seq_id, frame_id"""))
def coord_grid(spark, sf):
    """Lattice around every frame: distances of the lattice points from the frame's centroid."""
    c = nz.normalize(br.points(spark, sf), "sequence").groupBy(*FRAME).agg(*[F.avg(a).alias(a) for a in "xyz"])
    g = nz.coord_grid(c, 8).select(*FRAME, space.dist2(*[F.col(a) for a in ("x", "y", "z", "gx", "gy", "gz")]).alias("d"))
    return g.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("d"), 4).alias("sum_d2"), rnd(F.min("d")).alias("min_d2"))


@query("binarize", sql("select seq_id, frame_id, i, j, k, case when n/(n+1e0) >= 0.6e0 - 0.1e0 then 1 else 0 end as occupied from voxels"))
def binarize(spark, sf):
    v = nz.voxelize(nz.normalize(br.points(spark, sf), "sequence"), 64)
    return v.select(*FRAME, "i", "j", "k", space.binarize(F.col("n") / (F.col("n") + 1.0)).alias("occupied"))


@query("validate_points", sql("""
select seq_id, frame_id, count(*) as n_vertices, cast(sum(case when x is null or y is null or z is null or isnan(x) or isnan(y) or isnan(z) or isinf(x) or isinf(y) or isinf(z) then 1 else 0 end) as bigint) as n_not_finite,
       cast(sum(case when abs(x)>10 or abs(y)>10 or abs(z)>10 then 1 else 0 end) as bigint) as n_far,
       greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))=0 as zero_extent
from points group by seq_id, frame_id"""))
def validate_points(spark, sf):
    return nz.validate_points(br.points(spark, sf))


@query("validate_sequences", sql("""
select seq_id, count(*) as n_frames, min(c) as min_vertices, cast(0 as bigint) as n_not_finite, cast(sum(far) as bigint) as n_far,
       cast(sum(flat) as bigint) as n_flat_frames, count(*)>=2 and min(c)>=3 and sum(flat)=0 as ok
from (select seq_id, frame_id, count(*) as c, sum(case when abs(x)>10 or abs(y)>10 or abs(z)>10 then 1 else 0 end) as far,
      case when greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))=0 then 1 else 0 end as flat
      from points group by seq_id, frame_id) group by seq_id"""))
def validate_sequences(spark, sf):
    return nz.validate_sequences(br.points(spark, sf))


@query("select_template", sql("""
select seq_id, frame_id, c as n_vertices from (
select *, row_number() over (partition by seq_id order by c desc, frame_id) as rn
from (select seq_id, frame_id, count(*) as c from points group by seq_id, frame_id)) where rn=1"""))
def select_template(spark, sf):
    return nz.select_template(br.points(spark, sf))


@query("centroid_stats", sql(f"""
select seq_id, frame_id, {', '.join(r(f'avg({a})', f'mean_{a}', 9) + ', ' + r(f'stddev_pop({a})', f'std_{a}', 9) + ', ' + r(f'max({a})-min({a})', f'extent_{a}', 9) for a in 'xyz')}
from points group by seq_id, frame_id"""))
def centroid_stats(spark, sf):
    out = nz.centroid_stats(br.points(spark, sf))
    return out.select(*FRAME, *rnds(*[f"{s}_{a}" for a in "xyz" for s in ("mean", "std", "extent")], n=9))


@query("cloud_quality", sql(f"""
select seq_id, frame_id, count(*) as n_vertices, least(min(x), min(y), min(z)) as lo, greatest(max(x), max(y), max(z)) as hi,
{', '.join(r(f'avg({a})', f'mean_{a}', 9) + ', ' + r(f'stddev_pop({a})', f'std_{a}', 9) for a in 'xyz')}
from points group by seq_id, frame_id"""))
def cloud_quality(spark, sf):
    out = nz.cloud_quality(br.points(spark, sf))
    return out.select(*FRAME, "n_vertices", "lo", "hi", *rnds(*[f"{s}_{a}" for a in "xyz" for s in ("mean", "std")], n=9))


@query("cloud_difference", sql(f"""
select seq_id, frame_id, {r('avg(d)', 'mean_abs')}, {r('max(d)', 'max_abs')}, {r('stddev_pop(d)', 'std_abs')} from (
select p.seq_id, p.frame_id, unnest([abs(p.x-u.x), abs(p.y-u.y), abs(p.z-u.z)]) as d
from (select f.seq_id, f.frame_id, f.vertex_id, ((f.x-b.bx)*1e0/(b.blen+1e-5))*2-1 as x, ((f.y-b.by_)*1e0/(b.blen+1e-5))*2-1 as y,
      ((f.z-b.bz)*1e0/(b.blen+1e-5))*2-1 as z from points f join frame_box b on f.seq_id=b.seq_id and f.frame_id=b.frame_id) p
join unit_points u on p.seq_id=u.seq_id and p.frame_id=u.frame_id and p.vertex_id=u.vertex_id)
group by seq_id, frame_id"""))
def cloud_difference(spark, sf):
    """Frame-wise against sequence-wise normalisation of the same frames."""
    p = br.points(spark, sf)
    return nz.cloud_difference(nz.normalize(p, "frame"), nz.normalize(p, "sequence")).select(
        *FRAME, *rnds("mean_abs", "max_abs", "std_abs"))


@query("auto_bone_count", sql("""select seq_id, frame_id, count(*) as n,
cast(least(greatest(2, count(*) // 50), 10) as bigint) as bones from points group by seq_id, frame_id"""))
def auto_bone_count(spark, sf):
    n = br.points(spark, sf).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("bones", space.auto_bone_count(F.col("n")))


@query("voxel_downsample", sql(f"""
select seq_id, frame_id, cast(floor(x/25e0) as bigint) as ci, cast(floor(y/25e0) as bigint) as cj, cast(floor(z/25e0) as bigint) as ck,
       {r('avg(x)', 'x', 9)}, {r('avg(y)', 'y', 9)}, {r('avg(z)', 'z', 9)}, count(*) as n
from points group by 1, 2, 3, 4, 5"""))
def voxel_downsample(spark, sf):
    from ..operators.clips import voxel_downsample as down
    return down(br.points(spark, sf), 25.0).select(*FRAME, "ci", "cj", "ck", *rnds("x", "y", "z", n=9), "n")
