"""The queries over the standard tables, each with the SQL that it is held against.

Tables are read as point clouds: ``embeddings`` is the cloud ``pts`` (even ids
are its local, odd ids its global side), ``lineitem`` a large one, ``orders``
keyframes and ``events`` observations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose
from pointweave.operators import keyframes, neighbours, ordered, predicates, quality, solvers, voxels
from pointweave.plans import icp, mapbuilder, pipeline
from pointweave.pointmap import PointMap
from pointweave.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PTS = """pts as (select vec_id as point_id, embedding[1]::double*10 as x, embedding[2]::double*10 as y, embedding[3]::double*10 as z,
 embedding[4]::double as intensity, label::int as ring, vec_id*0.001::double as t from embeddings)"""
BIG = "big as (select l_quantity::double as x, l_extendedprice::double/1000 as y, l_discount::double*100 as z, l_tax::double as intensity, l_linenumber::int as ring from lineitem)"
KFS = "kfs as (select o_orderkey::bigint as kf_id, (o_orderkey % 100)::double as x, (o_custkey % 100)::double as y, o_totalprice::double/100000 as z from orders)"
MOTION = Pose.of(1.0, 2.0, 3.0, 0.1)
MOVED = "select point_id, x*cos(0.1::double)-y*sin(0.1::double)+1 x, x*sin(0.1::double)+y*cos(0.1::double)+2 y, z+3 z"
NN = """d as (select l.point_id local_id, g.point_id global_id, (l.x-g.x)**2+(l.y-g.y)**2+(l.z-g.z)**2 d2 from pts l, pts g where l.point_id%2=0 and g.point_id%2=1)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    xyz = [(e[i].cast("double") * 10).alias(a) for i, a in enumerate("xyz")]
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("point_id"), *xyz, e[3].cast("double").alias("intensity"), F.col("label").cast("int").alias("ring"), (F.col("vec_id") * F.lit(0.001)).alias("t"))


def large(spark: SparkSession, d: str) -> DataFrame:
    c = {"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double") / 1000, "z": F.col("l_discount").cast("double") * 100, "intensity": F.col("l_tax").cast("double"), "ring": F.col("l_linenumber").cast("int")}
    return spark.read.parquet(f"{d}/lineitem.parquet").select(*[v.alias(k) for k, v in c.items()])


def keyframe_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("bigint").alias("kf_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 100).cast("double").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), (F.col("o_totalprice").cast("double") / 100000).alias("z")
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    return p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1")


def xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select("point_id", *more, *[F.round(a, 6).alias(a) for a in "xyz"])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put



def eigen_sql(moments: str, keys: str) -> str:
    """SQL for the eigenvalues e0 <= e1 <= e2 of groups' covariances and |z| of the eigenvector of e0, by the cubic's closed form.

    ``moments`` gives ``keys, n, mx, my, mz, a, b, c, d, e, f``: the mean and
    covariances xx, yy, zz, xy, xz, yz of each group.
    """
    return f"""q0 as (select *, (a+b+c)/3 q, d*d+e*e+f*f p1 from ({moments})),
 q1 as (select *, sqrt(((a-q)**2+(b-q)**2+(c-q)**2+2*p1)/6) p from q0),
 q2 as (select *, case when p=0 then 0 else ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e))/(2*p**3) end r from q1),
 q3 as (select *, acos(greatest(-1.0, least(1.0, r)))/3 phi from q2),
 q4 as (select *, q+2*p*cos(phi) e2, q+2*p*cos(phi+2*pi()/3) e0 from q3),
 q5 as (select *, 3*q-e0-e2 e1 from q4),
 q6 as (select *, d*f-e*(b-e0) x1, e*d-(a-e0)*f y1, (a-e0)*(b-e0)-d*d z1, d*(c-e0)-e*f x2, e*e-(a-e0)*(c-e0) y2, (a-e0)*f-e*d z2, (b-e0)*(c-e0)-f*f x3, f*e-d*(c-e0) y3, d*f-(b-e0)*e z3 from q5),
 q7 as (select *, x1*x1+y1*y1+z1*z1 n1, x2*x2+y2*y2+z2*z2 n2, x3*x3+y3*y3+z3*z3 n3 from q6),
 eig as (select {keys}, n, mx, my, mz, e0, e1, e2, case when n1>=n2 and n1>=n3 then x1/sqrt(n1) when n2>=n3 then x2/sqrt(n2) else x3/sqrt(n3) end vx,
 case when n1>=n2 and n1>=n3 then y1/sqrt(n1) when n2>=n3 then y2/sqrt(n2) else y3/sqrt(n3) end vy, case when n1>=n2 and n1>=n3 then z1/sqrt(n1) when n2>=n3 then z2/sqrt(n2) else z3/sqrt(n3) end vz from q7)"""


MOMENTS = "count(*) n, avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x,x) a, covar_pop(y,y) b, covar_pop(z,z) c, covar_pop(x,y) d, covar_pop(x,z) e, covar_pop(y,z) f"
CELLS = "trunc(x)::int cx, trunc(y)::int cy, trunc(z)::int cz"
R6 = "round(x,6) x, round(y,6) y, round(z,6) z"


@query(f"with {PTS} select point_id, {R6} from pts where x*x+y*y+z*z between 1.0 and 9.0")
def filter_range(spark, d):
    return xyz(predicates.by_range(points(spark, d), 1.0, 3.0)["between"])


@query(f"with {PTS} select point_id, {R6} from pts where not (x*x+y*y+z*z between 1.0 and 9.0)")
def filter_range_outside(spark, d):
    return xyz(predicates.by_range(points(spark, d), 1.0, 3.0)["outside"])


@query(f"with {PTS} select point_id, {R6} from pts where x between -1 and 1 and y between -0.5 and 2 and z between -1 and 1.5")
def filter_bbox(spark, d):
    return xyz(predicates.by_box(points(spark, d), (-1.0, -0.5, -1.0), (1.0, 2.0, 1.5))["inside"])


@query(f"with {PTS} select point_id, case when intensity < -0.1 then 'low' when intensity > 0.1 then 'high' else 'mid' end as band from pts")
def filter_intensity_split(spark, d):
    parts = predicates.by_intensity(points(spark, d), -0.1, 0.1)
    out = [v.select("point_id", F.lit(k).alias("band")) for k, v in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"with {PTS} select point_id, ring from pts where ring in (1, 3, 5)")
def filter_ring(spark, d):
    return predicates.by_ring(points(spark, d), [1, 3, 5])["selected"].select("point_id", "ring")


UNIFORM = "floor(x/0.7)::int cx, floor(y/0.7)::int cy, floor(z/0.7)::int cz"


def _seen(p: float) -> str:
    return f"greatest(-3.5::double, least(3.5::double, count(*)*ln({p}::double/{1 - p}::double)))"


@query(
    f"""with {PTS}, hits as (select {UNIFORM}, {_seen(0.75)} lo from pts where point_id%2=1 group by 1,2,3), misses as (select {UNIFORM}, {_seen(0.25)} lo from pts where point_id%3=0 group by 1,2,3),
 v as (select cx, cy, cz, 1/(1+exp(-greatest(-3.5::double, least(3.5::double, sum(lo))))) p from (select * from hits union all select * from misses) group by 1,2,3),
 k as (select point_id, {UNIFORM} from pts where point_id%2=0)
 select point_id, case when p > 0.6 then 'static' else 'dynamic' end as kind from k join v using (cx,cy,cz) where p > 0.6 or p < 0.4"""
)
def occupancy_split(spark, d):
    local, world = sides(spark, d)
    cells = voxels.merged(voxels.occupancy(world, 0.7, 0.75), voxels.occupancy(points(spark, d).where("point_id % 3 = 0"), 0.7, 0.25))
    parts = predicates.by_occupancy(local, cells, voxels.resolution_of(cells), 0.6)
    return parts["static"].select("point_id", F.lit("static").alias("kind")).union(parts["dynamic"].select("point_id", F.lit("dynamic").alias("kind")))


def _times(method: str, offset: float, sql: str) -> None:
    def run(spark, d):
        return predicates.adjust_timestamps(points(spark, d), method, offset).select("point_id", F.round("t", 6).alias("t"))

    run.__name__ = f"adjust_time_{method.split('_')[0]}"
    query(f"with {PTS} select point_id, round({sql}, 6) as t from pts")(run)


_times("earliest_is_zero", 0.5, "t - (min(t) over () + 0.5::double)")
_times("middle_is_zero", 0.0, "t - 0.5::double*(min(t) over () + max(t) over ())")
_times("normalize", 0.25, "(t - min(t) over ()) / (case when max(t) over () = min(t) over () then 1 else max(t) over () - min(t) over () end) + 0.25::double")


@query(
    f"""with {PTS}, r as (select min(intensity) lo, max(intensity) hi from pts)
 select point_id, round(least(greatest((intensity-lo)/(case when hi=lo then 1 else hi-lo end),0),1),6) as intensity from pts, r"""
)
def normalize_intensity(spark, d):
    return predicates.normalize_intensity(points(spark, d)).select("point_id", F.round("intensity", 6).alias("intensity"))


@query(
    f"""with {PTS}, s as (select ring, min(intensity) a, max(intensity) b from pts group by ring), r as (select ring, min(a) over w lo, max(b) over w hi from s window w as (order by ring))
 select point_id, round(least(greatest((intensity-lo)/(case when hi=lo then 1 else hi-lo end),0),1),6) as intensity from pts join r using (ring)"""
)
def normalize_intensity_memory(spark, d):
    return predicates.normalize_intensity(points(spark, d), remember="ring").select("point_id", F.round("intensity", 6).alias("intensity"))


@query(
    f"""with {PTS} select point_id, round(x*cos(0.3::double*t)-y*sin(0.3::double*t)+0.5::double*t,6) x, round(x*sin(0.3::double*t)+y*cos(0.3::double*t)-0.25::double*t,6) y, round(z+0.125::double*t,6) z from pts"""
)
def deskew_twist(spark, d):
    return xyz(predicates.deskew(points(spark, d), (0.5, -0.25, 0.125, 0.0, 0.0, 0.3)))


@query(f"with {PTS}, m as ({MOVED} from pts) select point_id, {R6} from m")
def transform_layer(spark, d):
    return xyz(predicates.moved(points(spark, d), MOTION))


V = "trunc(x/0.5)::int cx, trunc(y/0.5)::int cy, trunc(z/0.5)::int cz"


@query(f"with {PTS} select {V}, min(point_id) as point_id, count(*) as n from pts group by 1,2,3")
def voxel_first(spark, d):
    return voxels.decimated(points(spark, d), 0.5).select(*voxels.CELL, "point_id", "n")


@query(f"with {BIG}, f as (select * from big where x*x+y*y+z*z between 100 and 4000) select trunc(x/2)::int cx, trunc(y/2)::int cy, trunc(z/2)::int cz, count(*) as n, round(avg(intensity),6) as intensity from f group by 1,2,3")
def range_then_voxels(spark, d):
    near = predicates.by_range(large(spark, d), 10.0, 4000**0.5)["between"]
    return voxels.keyed(near, 2.0).groupBy(*voxels.CELL).agg(F.count("*").alias("n"), F.round(F.avg("intensity"), 6).alias("intensity"))


@query(f"with {PTS} select {V}, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z, count(*) n from pts group by 1,2,3")
def voxel_mean(spark, d):
    return voxels.decimated(points(spark, d), 0.5, "mean").select(*voxels.CELL, *[F.round(a, 6).alias(a) for a in "xyz"], "n")


@query(
    f"""with {PTS}, v as (select *, trunc(x)::int cx, trunc(y)::int cy, trunc(z)::int cz from pts),
 m as (select *, avg(x) over w mx, avg(y) over w my, avg(z) over w mz from v window w as (partition by cx,cy,cz))
 select cx,cy,cz,point_id from m qualify row_number() over (partition by cx,cy,cz order by round((x-mx)**2+(y-my)**2+(z-mz)**2,9), point_id)=1"""
)
def voxel_closest(spark, d):
    return voxels.decimated(points(spark, d), 1.0, "closest").select(*voxels.CELL, "point_id")


@query(f"with {PTS}, v as (select point_id, {V}, (point_id*2654435761)%1000003 h from pts) select cx,cy,cz,point_id from v qualify row_number() over (partition by cx,cy,cz order by h, point_id)=1")
def voxel_random(spark, d):
    return voxels.decimated(points(spark, d), 0.5, "random").select(*voxels.CELL, "point_id")


@query(f"with {PTS}, v as (select {V}, min(point_id) p, count(*) n from pts group by 1,2,3) select cx, cy, 1.5::double as z, min(p) as point_id, sum(n)::bigint as n from v group by 1,2")
def voxel_flatten(spark, d):
    return voxels.decimated(points(spark, d), 0.5, flatten_to=1.5).select("cx", "cy", "z", "point_id", "n")


@query(
    f"""with {PTS}, g as (select *, sign(x)*x*x/2.0 gx, sign(y)*y*y/2.0 gy, sign(z)*z*z/2.0 gz from pts)
 select trunc((case when abs(x)>2 then x else gx end)/0.5)::int cx, trunc((case when abs(y)>2 then y else gy end)/0.5)::int cy,
 trunc((case when abs(z)>2 then z else gz end)/0.5)::int cz, min(point_id) point_id, count(*) n from g group by 1,2,3"""
)
def voxel_quadratic(spark, d):
    return voxels.decimated(points(spark, d), 0.5, key=voxels.quadratic_key(2.0)).select(*voxels.CELL, "point_id", "n")


@query(f"with {PTS}, a as (select point_id, trunc(x)::int cx, trunc(y)::int cy, trunc(z)::int cz, point_id%2 o from pts) select cx,cy,cz,point_id from a qualify row_number() over (partition by cx,cy,cz order by 1-o, point_id)=1")
def voxel_first_of_layers(spark, d):
    local, world = sides(spark, d)
    return voxels.first_of_layers([world, local], 1.0).select(*voxels.CELL, "point_id")


@query(
    f"""with {PTS}, b as (select sqrt(greatest(max(x)-min(x),10)**2+greatest(max(y)-min(y),10)**2+greatest(max(z)-min(z),10)**2)/20 s from pts),
 k as (select point_id, trunc(x/s)::bigint cx, trunc(y/s)::bigint cy, trunc(z/s)::bigint cz from pts, b), r as (select *, row_number() over (partition by cx,cy,cz order by point_id) round from k)
 select point_id from r order by round, ((cx*73856093+cy*19349663+cz*83492791)%1000003+1000003)%1000003, cx, cy, cz limit 200"""
)
def adaptive_decimate(spark, d):
    return voxels.adaptive(points(spark, d), 200, voxels_per_axis=20).select("point_id")


@query(f"with {PTS} select ring, count(*) n, round(covar_pop(x,x),6) cxx, round(covar_pop(x,y),6) cxy, round(covar_pop(x,z),6) cxz, round(covar_pop(y,y),6) cyy, round(covar_pop(y,z),6) cyz, round(covar_pop(z,z),6) czz from pts group by ring")
def voxel_cov(spark, d):
    out = voxels.covariance_of_groups(points(spark, d), ["ring"])
    return out.select("ring", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(f"with {PTS}, {eigen_sql(f'select {CELLS}, {MOMENTS} from pts group by 1,2,3 having count(*)>=3', 'cx, cy, cz')} select cx, cy, cz, n, round(mx,6) mx, round(my,6) my, round(mz,6) mz, round(abs(e0),5) e0, round(abs(e1),5) e1, round(e2,5) e2 from eig")
def voxel_pca(spark, d):
    out = voxels.shapes(voxels.keyed(points(spark, d), 1.0), voxels.CELL)
    return out.select(*voxels.CELL, "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz")], *[F.round(F.abs(c), 5).alias(c) for c in ("e0", "e1", "e2")])


@query(
    f"""with {PTS}, {eigen_sql(f'select {CELLS}, {MOMENTS} from pts group by 1,2,3 having count(*)>=5', 'cx, cy, cz')},
 k as (select *, case when e2<30*e0 and e1<9*e0 then 'edge' when e2>15*e0 and e1>4*e0 and e1>0.02 then 'plane' else 'other' end kind from eig),
 m as (select kind, vz, row_number() over (partition by cx,cy,cz order by point_id)-1 i from (select point_id, {CELLS} from pts) join k using (cx,cy,cz))
 select 'edge_points' part, count(*) n from m where kind='edge' and i%2=0 union all select 'plane_points', count(*) from m where kind='plane' and abs(vz)<0.9 and i%2=0
 union all select 'full_decim', count(*) from m where i%3=0 union all select 'plane_centroids', count(*) from k where kind='plane' union all select 'planes', count(*) from k where kind='plane'"""
)
def edges_planes_counts(spark, d):
    parts = voxels.edges_planes(points(spark, d), 1.0, 2, 3, max_ratio=30.0, min_ratio=15.0, min_e1=0.02, max_ratio1=9.0, min_ratio1=4.0)
    out = [v.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, v in parts.items()]
    for x in out[1:]:
        out[0] = out[0].union(x)
    return out[0]


@query(
    f"""with {PTS}, {eigen_sql(f'select {CELLS}, {MOMENTS} from pts group by 1,2,3 having count(*)>=5', 'cx, cy, cz')}
 select cx, cy, cz, n, round(abs(vx*mx+vy*my+vz*mz),4) as distance from eig where not (e2<2*e0 and e1<2*e0) and e2>5*e0 and e1>3*e0"""
)
def fitted_planes(spark, d):
    planes = voxels.edges_planes(points(spark, d), 1.0, 1, 0, max_ratio=2.0, min_ratio=5.0, max_ratio1=2.0, min_ratio1=3.0)["planes"]
    return planes.select(*voxels.CELL, "n", F.round("d", 4).alias("distance"))


@query(
    f"""with {PTS}, c as (select trunc(x)::int cx, trunc(y)::int cy, count(*) n, avg(z) mu from pts group by 1,2),
 o as (select a dx, b dy from (values (-1),(0),(1)) t(a), (values (-1),(0),(1)) u(b) where not (a=0 and b=0)),
 k as (select c.cx, c.cy, sum(case when c.mu > q.mu+0.1 and c.mu < q.mu+5 then 1 else 0 end) passes
 from c cross join o left join c q on q.cx=c.cx+o.dx and q.cy=c.cy+o.dy where c.n>=5 group by 1,2)
 select cx, cy, (passes>=3) as is_pole from k"""
)
def pole_cells(spark, d):
    return voxels.pole_cells(points(spark, d), 1.0, 0.1, 5.0)


@query(
    f"""with {PTS}, v as (select floor(x/0.5)::int cx, floor(y/0.5)::int cy, floor(z/0.5)::int cz, greatest(-3.5::double, least(3.5::double, count(*)*ln(0.85::double/0.15::double))) lo from pts group by 1,2,3)
 select cx, cy, round(greatest(-3.5::double, least(3.5::double, sum(lo))),6) log_odds from v where cz between -1 and 2 group by 1,2"""
)
def voxel_slice(spark, d):
    out = voxels.voxel_slice(voxels.occupancy(points(spark, d), 0.5), 0.5, -0.5, 1.2)
    return out.select("cx", "cy", F.round("log_odds", 6).alias("log_odds"))


@query(f"with {BIG} select ring, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z from big group by ring")
def layer_bbox(spark, d):
    return voxels.bounding_box(large(spark, d), ["ring"])


@query(f"with {PTS} select case when point_id%2=0 then 'even' else 'odd' end as layer, count(*) n from pts group by 1")
def layer_counts(spark, d):
    local, world = sides(spark, d)
    return PointMap({"even": local, "odd": world}).contents()


@query(f"with {BIG}, r as (select min(y) lo, max(y) hi from big) select least(floor((y-lo)/((hi-lo)/100)),99)::int as bin, count(*) n from big, r group by 1")
def axis_histogram(spark, d):
    return voxels.histogram(large(spark, d), "y")


@query(f"with {PTS}, {NN} select local_id, global_id, round(d2,6) d2 from d where d2 < 0.25 qualify row_number() over (partition by local_id order by d2, global_id)=1")
def nn_threshold(spark, d):
    return neighbours.nearest_within(*sides(spark, d), 0.5).select("local_id", "global_id", F.round("d2", 6).alias("d2"))


@query(f"with {PTS}, {NN} select local_id, global_id, round(d2,6) d2 from d where d2 < 1.0 qualify row_number() over (partition by local_id order by d2, global_id)<=3")
def nn_topk(spark, d):
    return neighbours.nearest_within(*sides(spark, d), 1.0, 3).select("local_id", "global_id", F.round("d2", 6).alias("d2"))


@query(f"with {PTS}, {NN}, n1 as (select * from d where d2 < 1.0 qualify row_number() over (partition by local_id order by d2, global_id)=1) select local_id, global_id from n1 qualify row_number() over (partition by global_id order by local_id)=1")
def nn_exclusive(spark, d):
    return neighbours.each_global_once(neighbours.nearest_within(*sides(spark, d), 1.0)).select("local_id", "global_id")


@query(f"with {PTS}, {NN}, n1 as (select * from d qualify row_number() over (partition by local_id order by d2, global_id)=1) select local_id, global_id, round(d2,6) d2 from n1 qualify row_number() over (order by d2, local_id) <= round(0.8*count(*) over ())")
def nn_inlier_ratio(spark, d):
    pairs = neighbours.nearest_unbounded(*sides(spark, d)).select(*neighbours.PAIR)
    return neighbours.best_share(pairs, 0.8).select("local_id", "global_id", F.round("d2", 6).alias("d2"))


@query(f"with {PTS}, {NN} select count(distinct local_id) as pairs, round(count(distinct local_id) / (select count(*) from pts where point_id%2=0)::double, 6) as ratio from d where d2 < 1.0")
def paired_ratio(spark, d):
    local, world = sides(spark, d)
    pairs = neighbours.nearest_within(local, world, 1.0).agg(F.count("*").alias("pairs"))
    return pairs.crossJoin(local.agg(F.count("*").alias("_n"))).select("pairs", F.round(F.col("pairs") / F.col("_n"), 6).alias("ratio"))  # one row each


def _known_pairs(spark, d) -> DataFrame:
    p = points(spark, d)
    x, y, z = g.transformed(MOTION)
    return p.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"], x.alias("gx"), y.alias("gy"), z.alias("gz"))


@query(
    f"""with {PTS}, p as (select x lx, y ly, z lz, x*cos(0.1::double)-y*sin(0.1::double)+1 gx, x*sin(0.1::double)+y*cos(0.1::double)+2 gy, z+3 gz from pts)
 select count(*) n, round(sum(lx*gx)-sum(lx)*sum(gx)/count(*),4) sxx, round(sum(lx*gy)-sum(lx)*sum(gy)/count(*),4) sxy,
 round(sum(ly*gx)-sum(ly)*sum(gx)/count(*),4) syx, round(sum(lz*gz)-sum(lz)*sum(gz)/count(*),4) szz from p"""
)
def horn_sums(spark, d):
    s = solvers.pair_sums(_known_pairs(spark, d))
    centred = {f"s{a}{b}": F.round(F.col(f"s{a}{b}") - F.col(f"l{a}") * F.col(f"g{b}") / F.col("n"), 4) for a, b in ("xx", "xy", "yx", "zz")}
    return s.select(F.col("rows").alias("n"), *[v.alias(k) for k, v in centred.items()])


@query(
    f"""with {PTS}, p as (select x lx, y ly, z lz, x*cos(0.1::double)-y*sin(0.1::double)+1 gx, x*sin(0.1::double)+y*cos(0.1::double)+2 gy, z+3 gz from pts), e as (select *, lx-gx ex, ly-gy ey, lz-gz ez from p)
 select count(*) n, round(sum(ex),4) b0, round(sum(ey),4) b1, round(sum(ez),4) b2, round(sum(ly*ez-lz*ey),3) b3, round(sum(lz*ex-lx*ez),3) b4, round(sum(lx*ey-ly*ex),3) b5, round(sum(ex*ex+ey*ey+ez*ez),3) cost from e"""
)
def gn_normal_eq(spark, d):
    s = solvers.normal_sums(_known_pairs(spark, d), "pt2pt", Pose.identity())
    return s.select("n", *[F.round(f"b{k}", 4 if k < 3 else 3).alias(f"b{k}") for k in range(6)], F.round("cost", 3).alias("cost"))


@query("select 1.0::double as x, 2.0::double as y, 3.0::double as z, 0.1::double as yaw, 0.0::double as pitch, 0.0::double as roll")
def horn_pose(spark, d):
    return _pose_row(spark, solvers.horn(_known_pairs(spark, d)))


@query("select 1.0::double as x, 2.0::double as y, 3.0::double as z, 0.1::double as yaw, 0.0::double as pitch, 0.0::double as roll")
def olae_pose(spark, d):
    return _pose_row(spark, solvers.olae(_known_pairs(spark, d)))


@query("select 1.0::double as x, 2.0::double as y, 3.0::double as z, 0.1::double as yaw, 0.0::double as pitch, 0.0::double as roll")
def gauss_newton_pose(spark, d):
    return _pose_row(spark, solvers.gauss_newton({"pt2pt": _known_pairs(spark, d)}, Pose.identity(), 10).pose)


def _pose_row(spark, pose: Pose) -> DataFrame:
    return spark.createDataFrame([[round(v, 6) + 0.0 for v in pose.values()]], "x double, y double, z double, yaw double, pitch double, roll double")


@query("select 0.02::double as x, -0.03::double as y, 0.01::double as z, 0.01::double as yaw, 0.0::double as pitch, 0.0::double as roll, 'Stalled' as reason, 1.0::double as quality")
def icp_horn_pose(spark, d):
    p = points(spark, d)
    there = Pose.of(0.02, -0.03, 0.01, 0.01)
    # every point is its own counterpart, so the pose is known
    found = icp.align(predicates.moved(p, there.inverse()), p, matchers=[(icp.distance_matcher(0.5), icp.Gate())], parameters=icp.Parameters(max_iterations=15))
    return _pose_row(spark, found.pose).withColumns({"reason": F.lit(found.reason), "quality": F.lit(float(found.quality))})


@query(
    f"""with {PTS}, q as (select trunc(50-20*y/x)::int u, trunc(30-20*z/x)::int v, sqrt(x*x+y*y+z*z) r from pts where x>0.01)
 select u, v, round(min(r),6) r from q where u>=0 and v>=0 and u<100 and v<60 group by u, v"""
)
def range_image(spark, d):
    image = quality.range_image(points(spark, d).where("x > 0.01"), 100, 60, 20.0, 20.0, 50.0, 30.0)
    return image.select("u", "v", F.round("range", 6).alias("r"))


def _erf(v: str) -> str:
    t = f"(1/(1+0.3275911::double*abs({v})))"
    return f"(sign({v})*(1-((((1.061405429::double*{t}-1.453152027::double)*{t}+1.421413741::double)*{t}-0.284496736::double)*{t}+0.254829592::double)*{t}*exp(-({v})*({v}))))"


_IMAGE = "select trunc(50-20*y/x)::int u, trunc(30-20*z/x)::int v, min(sqrt(x*x+y*y+z*z)) r from {0} where x<>0 and 50-20*y/x>-1 and 30-20*z/x>-1 and trunc(50-20*y/x) between 0 and 99 and trunc(30-20*z/x) between 0 and 59 group by 1,2"


@query(
    f"""with {PTS}, l as (select x-0.05::double x, y, z from pts where point_id%2=0), l0 as (select x, y, z from pts where point_id%2=0), w as (select x, y, z from pts where point_id%2=1), w1 as (select x+0.05::double x, y, z from pts where point_id%2=1),
 a as (select ia.r ra, ib.r rb from ({_IMAGE.format('w')}) ia full outer join ({_IMAGE.format('l')}) ib using (u,v)), b as (select ia.r ra, ib.r rb from ({_IMAGE.format('w1')}) ia full outer join ({_IMAGE.format('l0')}) ib using (u,v)),
 sa as (select avg(1-{_erf("o")}) s from (select coalesce(abs(ra-rb)/0.1::double, 2.0::double)/sqrt(2.0::double) o from a)), sb as (select avg(1-{_erf("o")}) s from (select coalesce(abs(ra-rb)/0.1::double, 2.0::double)/sqrt(2.0::double) o from b))
 select round((sa.s+sb.s)/2, 6) as score from sa, sb"""
)
def range_image_score(spark, d):
    camera = {"ncols": 100, "nrows": 60, "fx": 20.0, "fy": 20.0, "cx": 50.0, "cy": 30.0}
    return quality.range_image_score(*sides(spark, d), Pose.of(0.05), camera).select(F.round("score", 6).alias("score"))


_OCC = "select floor(x)::int cx, floor(y)::int cy, floor(z)::int cz, 1/(1+exp(-greatest(-3.5::double, least(3.5::double, count(*)*ln(0.85::double/0.15::double))))) p from pts"


@query(
    f"""with {PTS}, l as ({_OCC} where point_id%2=0 group by 1,2,3), w as ({_OCC} where point_id%2=1 group by 1,2,3),
 j as (select l.p p, w.p q from l join w using (cx,cy,cz) union all select w.p p, l.p q from l join w using (cx,cy,cz)), f as (select * from j where abs(p-0.5)>=0.01 and abs(q-0.5)>=0.01)
 select count(*) cells, round(1/(1+exp(-2*avg(1.5+p+q-12*p*p+22*p*q-12*q*q))),6) quality from f"""
)
def voxel_quality(spark, d):
    local, world = (voxels.occupancy(x, 1.0) for x in sides(spark, d))
    return quality.voxel_quality(local, world, Pose.identity(), 1.0).select("cells", F.round("quality", 6).alias("quality"))


@query(
    f"""with {PTS}, w as (select *, count(*) over (partition by ring) n,
 coalesce(lag(x) over o, last_value(x) over f) px, coalesce(lag(y) over o, last_value(y) over f) py, coalesce(lag(z) over o, last_value(z) over f) pz,
 coalesce(lead(x) over o, first_value(x) over f) nx, coalesce(lead(y) over o, first_value(y) over f) ny, coalesce(lead(z) over o, first_value(z) over f) nz
 from pts window o as (partition by ring order by point_id), f as (partition by ring order by point_id rows between unbounded preceding and unbounded following)),
 s as (select *, (x-px)**2+(y-py)**2+(z-pz)**2 d1, (x-nx)**2+(y-ny)**2+(z-nz)**2 d2, (x-px)*(nx-x)+(y-py)*(ny-y)+(z-pz)*(nz-z) dot from w)
 select point_id, case when n<=3 then 'larger' when d1>4 or d2>4 then case when x*x+y*y+z*z < px*px+py*py+pz*pz then 'larger' else 'other' end
 when abs(dot) < 0.5*sqrt(d1)*sqrt(d2) then 'larger' else 'smaller' end as class from s"""
)
def curvature(spark, d):
    return ordered.curvature(points(spark, d)).select("point_id", "class")


def _scan(spark, d) -> DataFrame:
    """Each ring as a row of a range image, a pixel for each point in order."""
    p = points(spark, d)
    at = F.row_number().over(Window.partitionBy("ring").orderBy("point_id"))
    r = F.round(F.sqrt(g.squared_norm(F.col("x"), F.col("y"), F.col("z"))), 4)
    return p.select("point_id", F.lit(0).alias("scan_id"), F.col("ring").alias("row"), at.alias("col"), r.alias("range"), "x", "y", "z")


_RANGES = f"{PTS}, s as (select point_id, ring, row_number() over (partition by ring order by point_id) col, round(sqrt(x*x+y*y+z*z),4) rng from pts), i as (select *, round(rng*256)::bigint r from s), f as (select *, r - lag(r) over (partition by ring order by col) d from i)"


@query(
    f"""with {_RANGES}, m as (select *, count(d) over w k, sum(d) over w s1, sum(d*d) over w s2 from f window w as (partition by ring order by col rows between 8 preceding and 8 following)),
 v as (select *, s1/16.0::double mu, (s2 - 2*(s1/16.0::double)*s1 + 17*(s1/16.0::double)*(s1/16.0::double))/16 var from m)
 select point_id, round((r-mu)*(r-mu)/var/65536, 6) score from v where k=17 and var>0 and rng<>0"""
)
def edges_from_range(spark, d):
    return ordered.range_edge_scores(_scan(spark, d)).select("point_id", F.round("score", 6).alias("score"))


@query(
    f"""with {PTS}, w as (select *, lag(x) over o px, lag(y) over o py, lag(z) over o pz, lead(x) over o nx, lead(y) over o ny, lead(z) over o nz from pts window o as (partition by ring order by point_id)),
 s as (select *, sqrt((x-px)**2+(y-py)**2+(z-pz)**2) d1, sqrt((x-nx)**2+(y-ny)**2+(z-nz)**2) d2, (x-px)*(nx-x)+(y-py)*(ny-y)+(z-pz)*(nz-z) dot from w)
 select point_id from s where d1>=0.1 and d2>=0.1 and abs(dot) < 0.5*d1*d2"""
)
def edges_from_curvature(spark, d):
    return ordered.edges_from_curvature(_scan(spark, d)).select("point_id")


@query(f"with {PTS}, m as ({MOVED} from pts where point_id%2=1 union all select point_id, x, y, z from pts where point_id%2=0) select point_id, {R6} from m")
def merge_layers(spark, d):
    local, world = sides(spark, d)
    return xyz(PointMap({"raw": local}).merged(PointMap({"raw": world}), MOTION).layer("raw"))


@query(f"with {PTS} select 'odd' as layer, count(*) n from pts where point_id%2=1")
def delete_layer(spark, d):
    local, world = sides(spark, d)
    return PointMap({"even": local, "odd": world}).without("even").contents()


@query(f"with {PTS} select case when point_id%2=0 then 'first' else 'odd' end as layer, count(*) n from pts group by 1")
def rename_layer(spark, d):
    local, world = sides(spark, d)
    return PointMap({"even": local, "odd": world}).renamed("even", "first").contents()


@query(f"with {KFS} select kf_id, round(z,7) z from kfs where kf_id between 100 and 2000")
def kf_cut(spark, d):
    return keyframes.cut(keyframe_table(spark, d), 100, 2000).select("kf_id", F.round("z", 7).alias("z"))


@query("select o_orderkey::bigint as kf_id from orders where o_orderkey%100 between 10 and 50 and o_custkey%100 between 20 and 60")
def kf_trim(spark, d):
    return keyframes.trim(keyframe_table(spark, d), (10, 20, None), (50, 60, None)).select("kf_id")


@query(f"with {KFS}, m as (select kf_id, x*cos(0.1::double)-y*sin(0.1::double)+1 x, x*sin(0.1::double)+y*cos(0.1::double)+2 y, z+3 z from kfs) select kf_id, round(x,6) x, round(y,6) y, round(z,7) z from m")
def kf_tf(spark, d):
    return keyframes.moved_places(keyframe_table(spark, d), MOTION).select("kf_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 7).alias("z"))


@query(f"with {KFS} select count(*) n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, round(min(z),6) min_z, round(max(z),6) max_z, false as has_twist, (select (epoch_us(max(o_orderdate::timestamp))-epoch_us(min(o_orderdate::timestamp)))/1e6 from orders) as span from kfs")
def kf_info(spark, d):
    return keyframes.info(keyframe_table(spark, d)).select("n", "min_x", "max_x", "min_y", "max_y", F.round("min_z", 6).alias("min_z"), F.round("max_z", 6).alias("max_z"), "has_twist", "span")


@query(f"with {KFS}, r as (select min(kf_id) lo, max(kf_id) hi from kfs) select kf_id-lo as kf_id, x from kfs, r union all select kf_id-lo+hi-lo+1, x from kfs, r")
def kf_join(spark, d):
    k = keyframe_table(spark, d)
    return keyframes.joined([k, k]).select("kf_id", "x")


@query("select user_id::bigint as kf_id, epoch_us(min_by(ts, event_id)) as t from events where user_id is not null group by 1")
def kf_export(spark, d):
    obs = events(spark, d).select(F.col("event_id").alias("obs_id"), F.col("user_id").cast("bigint").alias("kf_id"), "ts")
    poses = obs.select("kf_id").distinct().select("kf_id", *[F.lit(0.0).alias(k) for k in keyframes.POSE])
    kf = poses.withColumn("ts", F.lit(None).cast("timestamp"))
    return keyframes.trajectory(kf.withColumn("yaw", F.col("kf_id").cast("double")), obs).select(F.col("yaw").cast("bigint").alias("kf_id"), F.unix_micros(F.col("t").cast("timestamp")).alias("t"))


@query("select event_id, user_id, round(value,6) as value from events where regexp_full_match(event_type, 'view|click')")
def generator_regex(spark, d):
    obs = events(spark, d).withColumns({"class": F.col("event_type"), "label": F.col("user_id").cast("string")})
    return keyframes.matching(obs, "view|click").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query(
    f"""with {PTS}, k as (select o_orderkey::bigint kf_id, (o_orderkey%100)::double tx, (o_custkey%100)::double ty from orders), j as (select point_id, x+tx x, y+ty y, z from pts join k on k.kf_id = point_id % 50 + 1)
 select point_id, {R6} from j"""
)
def generator_points(spark, d):
    kfs = keyframe_table(spark, d).withColumns({"z": F.lit(0.0), "yaw": F.lit(0.0), "pitch": F.lit(0.0), "roll": F.lit(0.0)})
    own = points(spark, d).withColumn("kf_id", F.col("point_id") % 50 + 1)
    return xyz(keyframes.generate(own, kfs))


@query("with e as (select event_id, user_id, ts from events where event_type='view'), p as (select user_id, ts, value v from events where event_type='click') select e.event_id, round(p.v,6) v from e asof join p on e.user_id=p.user_id and e.ts>=p.ts")
def velocity_asof(spark, d):
    e = events(spark, d)
    a = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    b = e.where("event_type = 'click'").select(F.lit(None).cast("bigint").alias("event_id"), "user_id", F.col("ts").alias("t"), F.col("value").alias("v"))
    both = a.withColumn("v", F.lit(None).cast("double")).withColumn("_left", F.lit(1)).unionByName(b.withColumn("_left", F.lit(0)))
    return both.withColumn("v", F.last("v", True).over(w)).where("_left = 1 and v is not null").select("event_id", F.round("v", 6).alias("v"))


@query("select event_id, count(*) over w held, round(avg(value) over w, 6) mean from events window w as (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row)")
def velocity_window(spark, d):
    e = events(spark, d).select("event_id", "user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return keyframes.velocity_window(e, ["user_id"], 86400.0).select("event_id", "held", F.round("mean", 6).alias("mean"))


@query(f"with {PTS}, f as (select * from pts where x*x+y*y+z*z between 0.25 and 25) select count(distinct (trunc(x/0.5)::int, trunc(y/0.5)::int, trunc(z/0.5)::int)) as n from f")
def yaml_pipeline(spark, d):
    text = """
filters:
  - class_name: FilterByRange
    params: {input_pointcloud_layer: raw, output_layer_between: near, range_min: R*0.5, range_max: 5.0}
  - class_name: FilterDecimateVoxels
    params: {input_pointcloud_layer: near, output_pointcloud_layer: thin, decimate_method: FirstPoint, voxel_filter_resolution: 0.5}
  - class_name: FilterDeleteLayer
    params: {pointcloud_layer_to_remove: [raw, near]}
"""
    return pipeline.run_yaml(text, PointMap({"raw": points(spark, d)}), variables={"R": 1.0}).layer("thin").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ voxels, samples and coercions


@query(f"with {PTS} select {CELLS}, count(*) n, string_agg(point_id::varchar, ' ' order by point_id) ids from pts group by 1,2,3")
def voxel_members(spark, d):
    return voxels.members(points(spark, d), 1.0).select(*voxels.CELL, "n", F.array_join("point_ids", " ").alias("ids"))


@query(f"with {PTS} select {CELLS}, round(max(z)-min(z),6) height from pts group by 1,2,3")
def voxel_visitor(spark, d):
    def height(own):
        return own[voxels.CELL].head(1).assign(height=(own["z"].max() - own["z"].min()).round(6))

    return voxels.visited(points(spark, d), 1.0, height, "cx int, cy int, cz int, height double")


@query(f"with {PTS} select point_id from pts qualify (row_number() over (partition by ring order by point_id)-1) % 7 = 0")
def every_seventh(spark, d):
    return voxels.every(points(spark, d), 7, ["ring"]).select("point_id")


@query(f"with {PTS} select point_id, {CELLS} from pts")
def voxel_small_layer(spark, d):
    return voxels.decimated(points(spark, d), 1.0, minimum_points=1_000_000).select("point_id", *voxels.CELL)


@query(f"with {PTS} select (floor(x/0.7)+0.5)*0.7::double x, (floor(y/0.7)+0.5)*0.7::double y, (floor(z/0.7)+0.5)*0.7::double z from pts group by floor(x/0.7), floor(y/0.7), floor(z/0.7) having count(*) >= 2")
def voxel_centres(spark, d):
    cells = voxels.occupancy(points(spark, d), 0.7, 0.75)
    return predicates.voxel_centres(cells, voxels.resolution_of(cells), 0.8)


@query("select l_linenumber::int as row, l_quantity::int as col, round((l_tax+0.5)::double,6) x, round((25-l_quantity::int)*(l_tax+0.5)::double/10,6) y, round((4-l_linenumber)*(l_tax+0.5)::double/20,6) z from lineitem where l_tax > 0.02")
def unprojected_depth(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    pixels = t.select(F.col("l_linenumber").cast("int").alias("row"), F.col("l_quantity").cast("int").alias("col"), F.when(F.col("l_tax") > 0.02, F.col("l_tax").cast("double") + 0.5).otherwise(0.0).alias("depth"))
    return keyframes.unproject(pixels, 10.0, 20.0, 25.0, 4.0).select("row", "col", *[F.round(a, 6).alias(a) for a in "xyz"])


# ------------------------------------------------------------------ pairs of lines and planes


def _shape_sql(k: int, radius: float) -> str:
    near = f"select l.point_id local_id, g.x, g.y, g.z, (l.x-g.x)**2+(l.y-g.y)**2+(l.z-g.z)**2 d2, g.point_id gid from pts l, pts g where l.point_id%2=0 and g.point_id%2=1 and (l.x-g.x)**2+(l.y-g.y)**2+(l.z-g.z)**2 < {radius * radius}"
    return eigen_sql(f"select local_id, {MOMENTS} from (select * from ({near}) qualify row_number() over (partition by local_id order by d2, gid) <= {k}) group by 1 having count(*)>=4", "local_id")


@query(f"with {PTS}, {_shape_sql(6, 1.5)} select local_id, round(mx,5) base_x, round(my,5) base_y, round(mz,5) base_z from eig where e0 <= 0.3*e2 and e1 <= 0.3*e2")
def line_pairs(spark, d):
    found = neighbours.match_line(*sides(spark, d), Pose.identity(), 1.5, 6, 0.3, 4)
    return found.select("local_id", *[F.round(f"b{a}", 5).alias(f"base_{a}") for a in "xyz"])


@query(f"with {PTS}, {_shape_sql(8, 1.5)}, o as (select local_id, abs(vx*(x-mx)+vy*(y-my)+vz*(z-mz)) off from eig join pts on point_id=local_id where e0 < 0.2*e1 and e0 < 0.2*e2) select local_id, round(off,4) off from o where off <= 0.4")
def plane_pairs(spark, d):
    local, world = sides(spark, d)
    found = neighbours.match_plane(local, world, Pose.identity(), 0.4, 1.5, 8, 0.2, 4)
    return found.select("local_id", F.round(F.abs(F.col("nx") * F.col("lx") + F.col("ny") * F.col("ly") + F.col("nz") * F.col("lz") + F.col("d")), 4).alias("off"))


def _plane_pairs_known(spark, d) -> DataFrame:
    """Each local point with the plane through the next global one, across the line to the origin."""
    p = points(spark, d)
    q = p.where("point_id % 2 = 1").select((F.col("point_id") - 1).alias("local_id"), *[F.col(a).alias(f"g{a}") for a in "xyz"])
    own = p.where("point_id % 2 = 0").select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"]).join(q, "local_id")
    n = F.sqrt(g.squared_norm(*[F.col(f"g{a}") for a in "xyz"]))
    return own.withColumns({f"n{a}": F.col(f"g{a}") / n for a in "xyz"} | {f"u{a}": F.col(f"g{a}") / n for a in "xyz"} | {f"b{a}": F.col(f"g{a}") for a in "xyz"}).withColumn("d", -n)


_PLANE = "pl as (select l.point_id local_id, l.x lx, l.y ly, l.z lz, g.x gx, g.y gy, g.z gz, sqrt(g.x*g.x+g.y*g.y+g.z*g.z) n from pts l join pts g on g.point_id=l.point_id+1 where l.point_id%2=0)"
_OFF = "((gx*(lx-gx)+gy*(ly-gy)+gz*(lz-gz))/n)"


@query(
    f"with {PTS}, {_PLANE}, e as (select *, {_OFF} o from pl) select count(*) n, round(sum(o*gx/n),4) b0, round(sum(o*gy/n),4) b1, round(sum(o*gz/n),4) b2, round(sum(o*(ly*gz-lz*gy)/n),3) b3, round(sum(o*(lz*gx-lx*gz)/n),3) b4, round(sum(o*(lx*gy-ly*gx)/n),3) b5, round(sum(o*o),3) cost from e"
)
def gn_plane_normal_eq(spark, d):
    s = solvers.normal_sums(_plane_pairs_known(spark, d), "pt2pl", Pose.identity())
    return s.select("n", *[F.round(f"b{k}", 4 if k < 3 else 3).alias(f"b{k}") for k in range(6)], F.round("cost", 3).alias("cost"))


@query(f"with {PTS}, {_PLANE}, e as (select lx-gx-{_OFF}*gx/n ex, ly-gy-{_OFF}*gy/n ey, lz-gz-{_OFF}*gz/n ez from pl) select count(*) n, round(sum(ex),4) b0, round(sum(ey),4) b1, round(sum(ez),4) b2, round(sum(ex*ex+ey*ey+ez*ez),3) cost from e")
def gn_line_normal_eq(spark, d):
    s = solvers.normal_sums(_plane_pairs_known(spark, d), "pt2ln", Pose.identity())
    return s.select("n", *[F.round(f"b{k}", 4).alias(f"b{k}") for k in range(3)], F.round("cost", 3).alias("cost"))


@query(
    f"""with {PTS}, {_PLANE}, e as (select local_id, lx-{_OFF}*gx/n cx, ly-{_OFF}*gy/n cy, lz-{_OFF}*gz/n cz, abs({_OFF}) err from pl), r as (select *, row_number() over (order by err desc, local_id) k, max(err) over () m from e)
 select local_id, round(cx,6) gx, round(cy,6) gy, round(cz,6) gz from r where err >= 0.25*m or k <= 3"""
)
def plane_to_point_pairs(spark, d):
    out = solvers.to_point_pairs(Pose.identity(), None, _plane_pairs_known(spark, d))
    return out.select("local_id", *[F.round(f"g{a}", 6).alias(f"g{a}") for a in "xyz"])


@query(
    f"""with {PTS}, d as (select l.ring%2 side, l.point_id local_id, g.point_id global_id, (l.x-g.x)**2+(l.y-g.y)**2+(l.z-g.z)**2 d2 from pts l join pts g on l.point_id%2=0 and g.point_id%2=1 and l.ring%2=g.ring%2),
 b as (select * from d where d2 < 1.0 qualify row_number() over (partition by side, local_id order by d2, global_id)=1)
 select case side when 0 then 'even' else 'odd' end as layer, count(*) n, sum(case side when 0 then 2.0::double else 1.0::double end) weight from b group by 1"""
)
def layer_pairs(spark, d):
    local, world = ({"even": x.where("ring % 2 = 0"), "odd": x.where("ring % 2 = 1")} for x in sides(spark, d))
    m = icp.distance_matcher(1.0)
    m.layers = [("even", "even", 2.0), ("odd", "odd", 1.0)]
    found, _ = icp.matched([m], local, world, Pose.identity())
    return found["pt2pt"].groupBy(F.col("local_layer").alias("layer")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


# ------------------------------------------------------------------ keyframes, builders and files


@query(f"with {KFS} select kf_id, round(x*cos(0.1::double)-y*sin(0.1::double)+1,6) x, round(x*sin(0.1::double)+y*cos(0.1::double)+2,6) y, round(z+3,7) z, round((kf_id%7)*0.1::double+0.1::double,6) yaw from kfs")
def kf_turned(spark, d):
    k = keyframe_table(spark, d).withColumns({"yaw": (F.col("kf_id") % 7) * F.lit(0.1), "pitch": F.lit(0.0), "roll": F.lit(0.0)})
    return keyframes.turned(k, MOTION).select("kf_id", *[F.round(a, 7 if a == "z" else 6).alias(a) for a in ("x", "y", "z", "yaw")])


@query("""with e as (select event_id, user_id, epoch_us(ts)/1e6 t from events where event_type='view'), p as (select user_id, epoch_us(ts)/1e6 pt, value v from events where event_type='click')
 select event_id, round(v,6) v from e join p using (user_id) where abs(t-pt) <= 7200 qualify row_number() over (partition by event_id order by abs(t-pt), pt)=1""")
def nearest_event(spark, d):
    e = events(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    b = e.where("event_type = 'click'").select("user_id", "t", F.col("value").alias("v"))
    return keyframes.nearest_in_time(a, b, ["user_id"], "v", 7200.0).where("v is not null").select("event_id", F.round("v", 6).alias("v"))


@query(f"with {PTS}, k as (select *, ring*0.1::double wz from pts) select point_id, round(x*cos(wz*t)-y*sin(wz*t)+ring*t,6) x, round(x*sin(wz*t)+y*cos(wz*t),6) y, round(z+0.5*t,6) z from k")
def deskew_keyframe_twist(spark, d):
    p = points(spark, d)
    twist = (F.col("ring").cast("double"), 0.0, 0.5, 0.0, 0.0, F.col("ring") * F.lit(0.1))
    return xyz(predicates.deskew(p, twist))


def _built(spark, d, config: str, **variables) -> PointMap:
    p = points(spark, d).withColumn("obs_id", F.col("ring").cast("bigint"))
    kfs = spark.range(10).select(F.col("id").alias("kf_id"), F.col("id").cast("double").alias("x"), *[F.lit(0.0).alias(a) for a in ("y", "z", "yaw", "pitch", "roll")])
    obs = spark.range(10).select(F.col("id").alias("obs_id"), F.col("id").alias("kf_id"), F.lit("points").alias("class"), F.when(F.col("id") < 8, "front").otherwise("rear").alias("label"))
    return mapbuilder.build(kfs, obs, p, pipeline.from_yaml(config), variables)


@query(f"with {PTS}, m as (select point_id, ring, x+ring x, y, z from pts where ring<8), v as (select *, {CELLS} from m) select point_id, {R6} from v qualify row_number() over (partition by ring,cx,cy,cz order by point_id)=1")
def build_by_observation(spark, d):
    config = """
generators:
  - {class_name: Generator, params: {target_layer: raw, process_sensor_labels_regex: front}}
filters:
  - {class_name: FilterDecimateVoxels, params: {input_pointcloud_layer: raw, output_pointcloud_layer: thin, decimate_method: FirstPoint, voxel_filter_resolution: "2*R"}}
final_filters:
  - {class_name: FilterDeleteLayer, params: {pointcloud_layer_to_remove: raw}}
"""
    return xyz(_built(spark, d, config, R=0.5).layer("thin"))


@query(f"with {PTS}, m as (select point_id, ring, x+ring x, y, z from pts) select point_id, {R6} from m where (x-ring)**2+y*y+z*z between 0.25 and (1.0+0.1::double*ring)**2")
def build_near_the_robot(spark, d):
    config = """
filters:
  - {class_name: FilterByRange, params: {input_pointcloud_layer: raw, output_layer_between: near, range_min: 0.5, range_max: 1.0+0.1*robot_x, center: [robot_x, robot_y, robot_z]}}
"""
    return xyz(_built(spark, d, config).layer("near"))


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query(f"with {PTS} select {R6}, round(intensity,6) intensity from pts")
def text_roundtrip(spark, d):
    path = _scratch(spark, "text")
    files.write_text(points(spark, d).select("point_id", "x", "y", "z", "intensity"), path)
    return files.read_text(spark, path, "xyzi").select(*[F.round(a, 6).alias(a) for a in ("x", "y", "z", "intensity")])


@query(f"with {PTS} select case when point_id%2=0 then 'even' else 'odd' end as layer, point_id, {R6}, ring from pts")
def map_roundtrip(spark, d):
    path = _scratch(spark, "map")
    local, world = sides(spark, d)
    files.save_map(PointMap({"even": local, "odd": world}, label="both"), path)
    return files.load_map(spark, path).table().select("layer", "point_id", *[F.round(a, 6).alias(a) for a in "xyz"], "ring")


@query("""with k as (select user_id::bigint kf_id, epoch_us(min_by(ts, event_id))/1e6 t from events where user_id is not null group by 1)
 select kf_id*1.0::double as x, round(t,3) t, round(sin((kf_id%30)*0.05::double),6) qz, round(cos((kf_id%30)*0.05::double),6) qw from k""")
def trajectory_roundtrip(spark, d):
    obs = events(spark, d).select(F.col("event_id").alias("obs_id"), F.col("user_id").cast("bigint").alias("kf_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    kfs = obs.where("kf_id is not null").select("kf_id").distinct().withColumns({"ts": F.lit(0.0), "x": F.col("kf_id").cast("double"), "yaw": (F.col("kf_id") % 30) * F.lit(0.1)} | {a: F.lit(0.0) for a in ("y", "z", "pitch", "roll")})
    path = _scratch(spark, "trajectory")
    files.write_trajectory(keyframes.trajectory(kfs, obs), path)
    return files.read_trajectory(spark, path).select("x", F.round("t", 3).alias("t"), F.round("qz", 6).alias("qz"), F.round("qw", 6).alias("qw"))
