"""The derived tables of ``sources.bridges`` as SQL text, put together on demand.

Ids are running counts, not ``row_number() - 1``: DuckDB 2.0.0 loses the row with id 0 when a range filter on such
a difference is pushed below the window.
"""

from __future__ import annotations

import re

_CODE = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"

VIEWS = {
    "points": """
select event_type as seq_id, cast(date_diff('day', TIMESTAMP '2024-01-01', ts) as bigint) as frame_id,
       count(*) over (partition by event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) order by event_id rows unbounded preceding) - 1 as vertex_id,
       value as x, cast(user_id as double) as y, cast(json_extract_string(props, '$.k') as double) as z
from events""",
    "li_points": """
select l_returnflag as seq_id, cast(year(l_shipdate)*12+month(l_shipdate) as bigint) as frame_id,
       cast(row_number() over (partition by l_returnflag, year(l_shipdate)*12+month(l_shipdate)
            order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                     l_quantity, l_discount, l_tax, l_linestatus) - 1 as bigint) as vertex_id,
       l_quantity as x, l_extendedprice as y, l_discount as z
from lineitem""",
    "keypoints": """
select cast(f.label as bigint) as seq_id, f.fr as frame_id, r.k as k,
       cast(f.embedding[3*r.k+1] as double) as x, cast(f.embedding[3*r.k+2] as double) as y,
       cast(f.embedding[3*r.k+3] as double) as z,
       least(1.0, abs(cast(f.embedding[64] as double))*(r.k+1)) as intensity
from (select label, vec_id, embedding, count(*) over (partition by label order by vec_id rows unbounded preceding) - 1 as fr from embeddings) f,
     range(0, 21) r(k)""",
    "bones": """
select k, case when k=0 then -1 else cast(floor((k-1)/2.0) as bigint) end as parent
from (select distinct k from keypoints)""",
    "faces": """
select seq_id, frame_id, vertex_id as face_id, vertex_id as v0, vertex_id+1 as v1, vertex_id+2 as v2
from (select *, count(*) over (partition by seq_id, frame_id) as c from points) where vertex_id+2 < c""",
    "affinity": """
select a.seq_id as graph_id, a.frame_id % 2 as n, a.k as src, b.k as dst,
       round(exp(-avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)))), 9) as w
from keypoints a join keypoints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and a.k<>b.k
group by a.seq_id, a.frame_id % 2, a.k, b.k""",
    "heat": """
select frame_id, cast(case seq_id when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bigint) as k,
       cast(floor(least(7, x/62.5)) as bigint) as i, cast(floor(least(7, y/18.75)) as bigint) as j,
       cast(floor(least(7, z/12.5)) as bigint) as l, sum(x) as h
from points group by 1, 2, 3, 4, 5""",
    "metrics": """
select cast(date_diff('day', TIMESTAMP '2024-01-01', ts) as bigint) as epoch, user_id as batch, event_type as key, value from events""",
    "seq_box": """
select seq_id, min(x) as bx, min(y) as by_, min(z) as bz,
       greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen from points group by seq_id""",
    "frame_box": """
select seq_id, frame_id, min(x) as bx, min(y) as by_, min(z) as bz,
       greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) as blen from points group by seq_id, frame_id""",
    "unit_points": """
select p.seq_id, p.frame_id, p.vertex_id, ((p.x-b.bx)*1e0/(b.blen+1e-5))*2-1 as x,
       ((p.y-b.by_)*1e0/(b.blen+1e-5))*2-1 as y, ((p.z-b.bz)*1e0/(b.blen+1e-5))*2-1 as z
from points p join seq_box b on p.seq_id=b.seq_id""",
    "voxels": """
select seq_id, frame_id, cast(trunc((x+1)/(2e0/64+1e-5)) as integer) as i, cast(trunc((y+1)/(2e0/64+1e-5)) as integer) as j,
       cast(trunc((z+1)/(2e0/64+1e-5)) as integer) as k, count(*) as n
from unit_points group by 1, 2, 3, 4, 5""",
    "clouds": """
select cast(case seq_id when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bigint) as seq_id,
       frame_id, vertex_id, x, y, z from unit_points""",
    "joints": """
select seq_id, frame_id, k, x*3 as x, y*3 as y, z*3 as z, intensity from keypoints
where (seq_id, frame_id) in (select seq_id, frame_id from clouds)""",
    "bone_axes": """
select *, x*x+y*y+z*z as n2, sqrt(x*x+y*y+z*z)+1e-10 as nl
from (select a.seq_id, a.frame_id, a.k, a.x, a.y, a.z, b.x as nx, b.y as ny, b.z as nz
      from keypoints a join keypoints b on a.seq_id=b.seq_id and a.frame_id=b.frame_id and b.k=(a.k+1)%21)""",
    "bone_cross": """
select *, sqrt(c0*c0+c1*c1+c2*c2)+1e-10 as cl from (
select *, x1*nz-x2*ny as c0, x2*nx-x0*nz as c1, x0*ny-x1*nx as c2
from (select *, x/nl as x0, y/nl as x1, z/nl as x2 from bone_axes))""",
    "xf": """
select seq_id, frame_id, k, x0 as r00, z1*x2-z2*x1 as r01, z0 as r02, x1 as r10, z2*x0-z0*x2 as r11, z1 as r12,
       x2 as r20, z0*x1-z1*x0 as r21, z2 as r22, x as tx, y as ty, z as tz
from (select *, c0/cl as z0, c1/cl as z1, c2/cl as z2 from bone_cross)""",
    "quat": """
select seq_id, frame_id, k, tx, ty, tz, sg*qx/l as qx, sg*qy/l as qy, sg*qz/l as qz, sg*qw/l as qw from (
select *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) as l, case when qw<0 then -1e0 else 1e0 end as sg from (
select *, case when fw=big then (r21-r12)/s when fx=big then s/4 when fy=big then (r01+r10)/s else (r02+r20)/s end as qx,
          case when fw=big then (r02-r20)/s when fx=big then (r01+r10)/s when fy=big then s/4 else (r12+r21)/s end as qy,
          case when fw=big then (r10-r01)/s when fx=big then (r02+r20)/s when fy=big then (r12+r21)/s else s/4 end as qz,
          case when fw=big then s/4 when fx=big then (r21-r12)/s when fy=big then (r02-r20)/s else (r10-r01)/s end as qw
from (select *, sqrt(big)*2 as s from (
select *, greatest(fx, fy, fz, fw) as big from (
select *, 1+r00-r11-r22 as fx, 1-r00+r11-r22 as fy, 1-r00-r11+r22 as fz, 1+r00+r11+r22 as fw from xf)))))""",
    "weights": """
with d as (select v.seq_id, v.vertex_id, j.k,
                  sqrt((v.x-j.x)*(v.x-j.x)+(v.y-j.y)*(v.y-j.y)+(v.z-j.z)*(v.z-j.z)) as d
           from clouds v join joints j on v.seq_id=j.seq_id and v.frame_id=0 and j.frame_id=0),
r as (select *, 1e0/(d+1e-3) as g, row_number() over (partition by seq_id, vertex_id order by 1e0/(d+1e-3) desc, k) as rn from d)
select seq_id, vertex_id, k, g/sum(g) over (partition by seq_id, vertex_id) as w from r where rn<=4""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` preceded by exactly the views it needs; ``extra`` adds views of the query itself."""
    views = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"(?<![\w.]){name}(?![\w(])", text):
                pending = views[name]
                if pending is text:
                    continue
                visit(pending)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({views[n].strip()})" for n in needed) + "\n" + body.strip()
