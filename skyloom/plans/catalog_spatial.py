"""Registered queries: spatial joins, tracks, corridors, airports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import airports as ap
from skyloom.operators import area, corridor, spatial, thinning, tracks
from skyloom.plans import oracle_parts as O
from skyloom.plans.adapters import adapt, oracle
from skyloom.plans.catalog_search import (
    _zones,
    airport_rows,
    in_view_sql,
    moas,
)
from skyloom.plans.registry import query, r6

# ---------------------------------------------------------------- views and areas


@query(
    "bbox_select",
    f"select region_id, ord, ident, name, type from {in_view_sql(oracle('regions'), '(' + repr('fix') + ', ' + repr('vor') + ', ' + repr('ndb') + ')')} v",
)
def bbox_select(spark, sf):
    return spatial.in_view_fixes(adapt(spark, sf, "regions"), adapt(spark, sf, "sites")).select(
        "region_id", "ord", "ident", "name", "type"
    )


@query(
    "navaid_name_dedup",
    f"""select region_id, name, ord, ident, type from (
          select r.region_id, s.*, row_number() over (partition by r.region_id, s.name order by s.ord) as rn
          from {oracle('regions')} r join {oracle('sites')} s on {O.in_box('s.lat', 's.lon', 'r')}
          where s.type in ('vor', 'ndb')) x where rn = 1""",
)
def navaid_name_dedup(spark, sf):
    return spatial.in_view_fixes(
        adapt(spark, sf, "regions"), adapt(spark, sf, "sites"), spatial.NAVAID_TYPES
    ).select("region_id", "name", "ord", "ident", "type")


_AREA_BOX = f"""(select *, c_lat - half as a0, c_lat + half as a1, c_lon - half as o0, c_lon + half as o1
                from {oracle('areas')} a)"""


@query(
    "aabb_overlap",
    f"""select r.region_id, a.ord, a.name from {oracle('regions')} r join {_AREA_BOX} a
        on a.a1 >= r.min_lat and a.a0 <= r.max_lat and a.o1 >= r.min_lon and a.o0 <= r.max_lon""",
)
def aabb_overlap(spark, sf):
    return spatial.aabb_join(moas(spark, sf), adapt(spark, sf, "regions")).select(
        "region_id", "ord", "name"
    )


@query(
    "in_view_layers",
    f"""select region_id, 'fix' as layer, ord, ident, name, type
        from {in_view_sql(oracle('regions'), "('fix', 'airport', 'vor', 'ndb', 'vfr')")} v
        union all
        select r.region_id, 'moa', a.ord, a.name, a.name, 'moa' from {oracle('regions')} r
        join {_AREA_BOX} a on a.a1 >= r.min_lat and a.a0 <= r.max_lat and a.o1 >= r.min_lon and a.o0 <= r.max_lon
        union all
        select r.region_id, 'fbo', f.ord, f.name, f.icao, 'fbo' from {oracle('regions')} r
        join {oracle('fbos')} f on {O.in_box('f.lat', 'f.lon', 'r')}""",
)
def in_view_layers(spark, sf):
    return spatial.in_view(
        adapt(spark, sf, "regions"), adapt(spark, sf, "sites"), moas(spark, sf),
        adapt(spark, sf, "fbos"), show_vfrs=True,
    ).drop("lat", "lon")


# Kite of the check areas: corners at -1, 2 half-widths in longitude and +-1 in latitude.
_KITE_HIT = """abs(s.lat - a.c_lat) < a.half
  and s.lon < a.c_lon + 2 * a.half * (1 - abs(s.lat - a.c_lat) / a.half)
  and s.lon > a.c_lon - a.half * (1 - abs(s.lat - a.c_lat) / a.half)"""


def _point_area_sql(hit: str) -> str:
    # The box test comes first and only spans one half-width to each side.
    return f"""select s.ord as point_id, a.ord as area_ord, a.name
        from {oracle('sites')} s join {oracle('areas')} a
          on s.lat between a.c_lat - a.half and a.c_lat + a.half
         and s.lon between a.c_lon - a.half and a.c_lon + a.half
        where {hit}"""


def _site_points(spark, sf):
    # Off the grid of the areas' corners, where a boundary point may fall either way.
    return adapt(spark, sf, "sites").select(
        F.col("ord").alias("point_id"), (F.col("lat") + 0.0031).alias("lat"),
        (F.col("lon") + 0.0017).alias("lon"),
    )


_SHIFTED = "(select ord, lat + 0.0031e0 as lat, lon + 0.0017e0 as lon from " + oracle("sites") + " s0)"


@query("point_in_region", _point_area_sql(_KITE_HIT).replace(oracle("sites") + " s join", _SHIFTED + " s join"))
def point_in_region(spark, sf):
    return spatial.point_in_area_join(
        _site_points(spark, sf), moas(spark, sf).withColumnRenamed("name", "name")
    ).select("point_id", F.col("ord").alias("area_ord"), "name")


@query(
    "point_in_first_region",
    "select point_id, min(area_ord) as area_ord from ("
    + _point_area_sql(_KITE_HIT).replace(oracle("sites") + " s join", _SHIFTED + " s join")
    + ") h group by point_id",
)
def point_in_first_region(spark, sf):
    return spatial.point_in_area_join(
        _site_points(spark, sf), moas(spark, sf), first_only=True
    ).select("point_id", F.col("ord").alias("area_ord"))


@query(
    "polygon_centroid",
    # Kite: its centroid lies a third of a half-width east of the crossing; the hole has the
    # same shape around the same crossing, at half the size and a quarter of the weight.
    f"""select ord, name, round(c_lat, 6) as lat,
               round(c_lon + (half / 3e0 * 1e0 + half / 6e0 * 0.25e0) / 1.25e0, 6) as lon
        from {oracle('areas')} a""",
)
def polygon_centroid(spark, sf):
    return area.polygon_labels(moas(spark, sf)).select(
        "ord", "name", r6("lat").alias("lat"), r6("lon").alias("lon")
    )


# ---------------------------------------------------------------- tracks

_POINTS = O.clean_points(oracle("positions"))


@query(
    "track_clean",
    f"""select aircraft, cast(idx as bigint) as idx, ord, epoch_us(ts) as ts_us,
               round(lat, 6) as lat, round(lon, 6) as lon from {_POINTS} p""",
)
def track_clean(spark, sf):
    return tracks.clean_tracks(adapt(spark, sf, "positions")).select(
        "aircraft", "idx", "ord", F.unix_micros("ts").alias("ts_us"), r6("lat").alias("lat"),
        r6("lon").alias("lon"),
    )


@query(
    "track_segments",
    f"""select aircraft, cast(seg as bigint) as seg, round(a_lat, 6) as a_lat, round(a_lon, 6) as a_lon,
               round(b_lat, 6) as b_lat, round(b_lon, 6) as b_lon,
               round({O.haversine('a_lat', 'a_lon', 'b_lat', 'b_lon')}, 6) as length_nm
        from {O.segments(_POINTS)} s""",
)
def track_segments(spark, sf):
    segs = tracks.track_segments(tracks.clean_tracks(adapt(spark, sf, "positions")))
    ends = ["a_lat", "a_lon", "b_lat", "b_lon"]
    return segs.select(
        "aircraft", "seg", *[r6(c).alias(c) for c in ends],
        r6(geo.haversine_nm(*[F.col(c) for c in ends])).alias("length_nm"),
    )


@query(
    "track_ends",
    f"""select aircraft, count(*) as points,
               round(coalesce(arg_min(lat, idx) filter (alt > 500 and gs > 60), arg_min(lat, idx)), 6) as start_lat,
               round(coalesce(arg_min(lon, idx) filter (alt > 500 and gs > 60), arg_min(lon, idx)), 6) as start_lon,
               round(arg_max(lat, idx), 6) as last_lat, round(arg_max(lon, idx), 6) as last_lon
        from {_POINTS} p group by aircraft""",
)
def track_ends(spark, sf):
    e = tracks.end_points(tracks.clean_tracks(adapt(spark, sf, "positions")))
    return e.select(
        "aircraft", "points",
        r6(F.col("start")["lat"]).alias("start_lat"), r6(F.col("start")["lon"]).alias("start_lon"),
        r6(F.col("last")["lat"]).alias("last_lat"), r6(F.col("last")["lon"]).alias("last_lon"),
    )


@query(
    "time_snap",
    f"""
    with pos as (select aircraft, ord as position_id, ts, lat + 0.01e0 as lat, lon + 0.02e0 as lon
                 from {oracle('positions')} p where ord % 3 = 0),
    near as (
      select p.aircraft, p.position_id, t.ts as t_ts, row_number() over (
               partition by p.aircraft, p.position_id
               order by (t.lat - p.lat) * (t.lat - p.lat) + (t.lon - p.lon) * (t.lon - p.lon), t.ord) as rn
      from pos p join {oracle('positions')} t on t.aircraft = p.aircraft and t.ord % 3 <> 0
      where (t.lat - p.lat) * (t.lat - p.lat) + (t.lon - p.lon) * (t.lon - p.lon) < 0.001e0
    )
    select p.aircraft, p.position_id, epoch_us(coalesce(n.t_ts, p.ts)) as snapped_us
    from pos p left join near n on n.aircraft = p.aircraft and n.position_id = p.position_id and n.rn = 1
    """,
)
def time_snap(spark, sf):
    pts = adapt(spark, sf, "positions")
    live = pts.where("ord % 3 = 0").select(
        "aircraft", F.col("ord").alias("position_id"), "ts", (F.col("lat") + 0.01).alias("lat"),
        (F.col("lon") + 0.02).alias("lon"),
    )
    return tracks.snap_time(live, pts.where("ord % 3 <> 0")).select(
        "aircraft", "position_id", F.unix_micros("snapped_ts").alias("snapped_us")
    )


@query(
    "leg_ids",
    f"""
    with f as materialized (select * from {O.legs(oracle('polls'))} l)
    select b.aircraft, b.ord, b.callsign, coalesce(f.new_leg, false) as new_leg,
           cast(sum(case when f.new_leg then 1 else 0 end)
                over (partition by b.aircraft order by b.ts, b.ord) as bigint) as leg_id
    from {oracle('polls')} b left join f on f.aircraft = b.aircraft and f.ts = b.ts and f.ord = b.ord
    """,
)
def leg_ids(spark, sf):
    return tracks.leg_ids(adapt(spark, sf, "polls")).select(
        "aircraft", "ord", "callsign", "new_leg", "leg_id"
    )


# ---------------------------------------------------------------- nearest and corridor


@query(
    "nearest_site",
    f"""
    with n as (
      select p.aircraft, p.ord as position_id, s.ord as site_ord, s.ident,
             {O.haversine('p.lat', 'p.lon', 's.lat', 's.lon')} as d
      from {oracle('positions')} p join {oracle('sites')} s
        on s.lat between p.lat - 0.51e0 and p.lat + 0.51e0
    )
    select p.aircraft, p.ord as position_id, b.site_ord, b.ident, round(b.d, 6) as distance
    from {oracle('positions')} p
    left join (select * from (select *, row_number() over (partition by position_id order by d, site_ord) as rn
                              from n where d <= 30) r where rn = 1) b on b.position_id = p.ord
    """,
)
def nearest_site(spark, sf):
    probes = adapt(spark, sf, "positions").select(
        "aircraft", F.col("ord").alias("position_id"), "lat", "lon"
    )
    sites = adapt(spark, sf, "sites").select(
        "ord", F.col("ord").alias("site_ord"), "ident", "lat", "lon"
    )
    near = spatial.nearest_join(
        probes, sites, ["position_id"], 30.0, ["site_ord", "ident"]
    )
    return near.select(
        "aircraft", "position_id", F.col("nearest")["site_ord"].alias("site_ord"),
        F.col("nearest")["ident"].alias("ident"),
        r6(F.col("nearest")["distance_nm"]).alias("distance"),
    )


_SITES_ALL = f"""(
  select 0 as branch, ord, ident, name, type, lat, lon, upper(ident || ' ' || name) as search_text
  from {oracle('sites')} s
  union all
  select 1, ord, upper(trim(regexp_replace(name, '\\s*MOA$', '', 'i'))), name, 'moa', c_lat, c_lon, upper(name)
  from {oracle('areas')} a
  union all
  select 2, ord, upper(name), icao, 'fbo', lat, lon, upper(name || ' ' || icao) from {oracle('fbos')} f
)"""

ZONE_CASE = """case when distance <= 1 then 'crossed' when distance <= 5 then '5nm' when distance <= 10 then '10nm'
               when distance <= 15 then '15nm' else '20nm' end"""

ZONES_CTE = f"""
    pts as materialized (select * from {_POINTS} p),
    segs as materialized (select * from {O.segments('pts')} s),
    box0 as (select aircraft, min(lat) as a0, max(lat) as a1, min(lon) as o0, max(lon) as o1 from pts group by aircraft),
    path as (
      select aircraft, a0 - 25 / 6e1 as min_lat, a1 + 25 / 6e1 as max_lat,
             o0 - 25 / (60 * cos((a0 + a1) / 2 * pi() / 18e1)) as min_lon,
             o1 + 25 / (60 * cos((a0 + a1) / 2 * pi() / 18e1)) as max_lon
      from box0
    ),
    fetch_ as (
      select aircraft, min_lat - 0.5e0 as min_lat, max_lat + 0.5e0 as max_lat,
             min_lon - 30 / (60 * cos((min_lat + max_lat) / 2 * pi() / 18e1)) as min_lon,
             max_lon + 30 / (60 * cos((min_lat + max_lat) / 2 * pi() / 18e1)) as max_lon
      from path
    ),
    sites_ as materialized (select * from {_SITES_ALL} s),
    shown as (
      select f.aircraft, s.* from fetch_ f join sites_ s on {O.in_box('s.lat', 's.lon', 'f')} where s.branch <> 1
      union all
      select f.aircraft, s.* from fetch_ f join {_AREA_BOX} a
        on a.a1 >= f.min_lat and a.a0 <= f.max_lat and a.o1 >= f.min_lon and a.o0 <= f.max_lon
      join sites_ s on s.branch = 1 and s.ord = a.ord
    ),
    once as (
      select * from shown
      qualify row_number() over (partition by aircraft, branch,
                case when (type in ('vor', 'ndb') and name <> '') or type = 'moa' then name
                     else '#' || ord end order by ord) = 1
    ),
    measured as (
      select o.aircraft, o.branch, o.ord, o.ident, o.name, o.type, o.search_text, g.seg,
             {O.haversine('o.lat', 'o.lon',
                          '(g.a_lat + g.t * (g.b_lat - g.a_lat))',
                          '(g.a_lon + g.t * (g.b_lon - g.a_lon))')} as d
      from (
        select o.*, s.seg, s.a_lat, s.a_lon, s.b_lat, s.b_lon,
               {O.segment_t('s.a_lat', 's.a_lon', 's.b_lat', 's.b_lon', 'o.lat', 'o.lon')} as t
        from once o join segs s on s.aircraft = o.aircraft
        join path p on p.aircraft = o.aircraft and {O.in_box('o.lat', 'o.lon', 'p')}
      ) g join once o on o.aircraft = g.aircraft and o.branch = g.branch and o.ord = g.ord
    ),
    nearest as (
      select aircraft, branch, ord, ident, name, type, search_text, m.d as distance, m.seg as nearest_seg
      from (select aircraft, branch, ord, ident, name, type, search_text,
                   min({{'k': floor(d * 1e9 + 0.5e0), 'seg': seg, 'd': d}}) as m
            from measured group by all) g where m.d <= 20
    ),
    zoned as (
      select *, {ZONE_CASE} as zone,
             min(branch * 1000000000 + ord) over (partition by aircraft, {ZONE_CASE}, ident, type) as first_seen
      from nearest
    ),
    zones_ as materialized (
      select * from zoned
      qualify row_number() over (partition by aircraft, zone, ident, type
                                 order by nearest_seg desc, branch, ord) = 1
    )"""


@query(
    "corridor_zones",
    f"""with {ZONES_CTE}
    select aircraft, zone, cast(branch as bigint) as branch, ord, ident, type,
           cast(nearest_seg as bigint) as nearest_seg, round(distance, 6) as distance from zones_""",
)
def corridor_zones(spark, sf):
    return _zones(spark, sf).select(
        "aircraft", "zone", "branch", "ord", "ident", "type", "nearest_seg",
        r6("distance").alias("distance"),
    )


@query(
    "zone_summary",
    f"""with {ZONES_CTE}
    select aircraft, zone, count(*) as sites,
           coalesce(string_agg(case when type = 'moa' then ident || ' MOA' end, ', '
                      order by nearest_seg desc, first_seen), '') as moas
    from zones_ group by aircraft, zone""",
)
def zone_summary(spark, sf):
    return corridor.zone_summary(_zones(spark, sf))


def _zone_queries(spark, sf):
    users = adapt(spark, sf, "positions").select("aircraft").distinct()
    return users.select(
        F.col("aircraft").alias("query_id"), "aircraft",
        F.when(F.col("aircraft") % 2 == 0, "blue ring").otherwise("SMAL").alias("query"),
        F.when(F.col("aircraft") % 3 == 0, "5nm").alias("zone"),
    )


@query(
    "zone_search",
    f"""with {ZONES_CTE},
    q_ as (select distinct aircraft, case when aircraft % 2 = 0 then 'BLUE RING' else 'SMAL' end as qtext,
                  case when aircraft % 3 = 0 then '5nm' end as only_zone from pts),
    cand as (
      select z.*, q_.qtext, case zone when 'crossed' then 0 when '5nm' then 1 when '10nm' then 2 when '15nm' then 3 else 4 end as zr
      from zones_ z join q_ on q_.aircraft = z.aircraft
      where z.type <> 'moa' and (only_zone is null or only_zone = zone)
    ),
    uniq as (select * from cand qualify row_number() over (partition by aircraft, ident, type order by zr) = 1),
    t_ as (select * from {O.text_keys('(select ident as text from uniq union select name from uniq)', 'page')} k),
    qk as (select * from {O.text_keys('(select distinct qtext as text from q_)', 'page')} k),
    sc as (
      select u.*, cast(greatest({O.score('k1', 'q')}, {O.score('k2', 'q')},
                    case when contains(search_text, qtext) then 200 else 0 end) as bigint) as score
      from uniq u join t_ k1 on k1.text = u.ident join t_ k2 on k2.text = u.name join qk q on q.text = u.qtext
    )
    select aircraft, qtext as q, zone, ident, type, ord, score,
           row_number() over (partition by aircraft order by score desc, zr, nearest_seg desc, first_seen) as place
    from sc where score >= 60""",
)
def zone_search(spark, sf):
    return corridor.search_zones(_zones(spark, sf, ("name", "search_text")), _zone_queries(spark, sf)).select(
        "aircraft", "q", "zone", "ident", "type", "ord", "score", "place"
    )


# ---------------------------------------------------------------- airports

_LISTED = f"""(select *, coalesce(gps, ident) as icao from {oracle('airport_src')} a
              where type in ('large_airport', 'medium_airport', 'small_airport'))"""


@query(
    "airports_listed",
    f"""select ord, icao, name, iata, city, country, type, round(lat, 6) as lat, round(lon, 6) as lon,
               (country = 'US' or icao like 'K%') as is_us from {_LISTED} a""",
)
def airports_listed(spark, sf):
    from skyloom.functions.procs import is_us

    return airport_rows(spark, sf).select(
        "ord", "icao", "name", "iata", "city", "country", "type", r6("lat").alias("lat"),
        r6("lon").alias("lon"), is_us(F.col("icao"), F.col("country")).alias("is_us"),
    )


_KEYS = f"""(select key, icao, iata, name, city, country from (
   select *, row_number() over (partition by key order by ord) as rn from (
     select unnest([ident, gps, local, iata]) as key, ord, coalesce(gps, ident) as icao, iata, name, city, country
     from {oracle('airport_src')} a) k where key is not null) r where rn = 1)"""


@query("airport_key_lookup", f"select c_custkey, ident, k.icao, k.iata, k.name, k.city, k.country from (select c_custkey, case when c_custkey % 2 = 0 then concat('k', lpad(cast(c_custkey % 95 as varchar(10)), 3, '0')) else lpad(cast(c_custkey % 50 as varchar(10)), 3, '0') end as ident from customer) c left join {_KEYS} k on k.key = upper(c.ident)")
def airport_key_lookup(spark, sf):
    idents = spark.sql(
        "select c_custkey, case when c_custkey % 2 = 0 then concat('k', lpad(cast(c_custkey % 95 as varchar(10)), 3, '0')) "
        "else lpad(cast(c_custkey % 50 as varchar(10)), 3, '0') end as ident from {customer}",
        customer=spark.read.parquet(f"{sf}/customer.parquet"),
    )
    return ap.airport_names(idents, ap.airport_keys(adapt(spark, sf, "airport_src")))


NEARBY_NM = 100

NEARBY_CTE = f"""
    pts as materialized (select * from {_POINTS} p),
    box0 as (
      select aircraft, min(lat) - {NEARBY_NM} / 6e1 as min_lat, max(lat) + {NEARBY_NM} / 6e1 as max_lat,
             min(lon) - {NEARBY_NM} / 6e1 as min_lon, max(lon) + {NEARBY_NM} / 6e1 as max_lon,
             arg_max(lat, idx) as lat, arg_max(lon, idx) as lon from pts group by aircraft),
    near_ as materialized (
      select b.aircraft, a.ord, a.icao, a.iata, a.name, a.city,
             {O.haversine('b.lat', 'b.lon', 'a.lat', 'a.lon')} as d
      from box0 b join {_LISTED} a on {O.in_box('a.lat', 'a.lon', 'b')}
      where {O.haversine('b.lat', 'b.lon', 'a.lat', 'a.lon')} <= {NEARBY_NM}
    )"""


def _nearby(spark, sf):
    return ap.nearby_airports(
        tracks.clean_tracks(adapt(spark, sf, "positions")), airport_rows(spark, sf), NEARBY_NM
    )


@query(
    "nearby_sites",
    f"""with {NEARBY_CTE}
    select aircraft, ord, icao, floor(d * 10 + 0.5e0) / 1e1 as distance,
           round(case when d < 2 then d - 5 else d end, 6) as sort_dist from near_""",
)
def nearby_sites(spark, sf):
    return _nearby(spark, sf).select("aircraft", "ord", "icao", "distance", r6("sort_dist").alias("sort_dist"))


@query(
    "nearby_search",
    f"""with {NEARBY_CTE},
    q_ as (select distinct aircraft, case aircraft % 4 when 0 then 'SUPLIER' when 1 then 'K01' when 2 then '005' else 'NATION' end as qtext from pts),
    c as (
      select n.*, q_.qtext, regexp_replace(upper(name), '[^A-Z ]', '', 'g') as clean, upper(city) as ucity
      from near_ n join q_ on q_.aircraft = n.aircraft
    ),
    words as (select distinct clean, unnest(string_split(clean, ' ')) as word from c),
    t_ as (select * from {O.text_keys("""(select icao as text from c union select clean from c union select ucity from c
                                          union select word from words where length(word) >= 3)""", 'page')} k),
    qk as (select * from {O.text_keys('(select distinct qtext as text from q_)', 'page')} k),
    by_word as (
      select q.text as qtext, w.clean, max({O.score('kw', 'q')}) as best
      from words w join t_ kw on kw.text = w.word and length(w.word) >= 3 cross join qk q group by all
    ),
    sc as (
      select c.aircraft, c.qtext as q, c.ord, c.icao, c.d,
             cast(greatest({O.score('k1', 'q')}, {O.score('k2', 'q')}, {O.score('k3', 'q')}, coalesce(bw.best, 0),
               case when contains(icao, c.qtext) then 250 else 0 end,
               case when contains(c.clean, c.qtext) then 200 else 0 end,
               case when contains(ucity, c.qtext) then 160 else 0 end,
               case when iata = c.qtext then 300 else 0 end) as bigint) as score
      from c join t_ k1 on k1.text = c.icao join t_ k2 on k2.text = c.clean join t_ k3 on k3.text = c.ucity
      join qk q on q.text = c.qtext left join by_word bw on bw.qtext = c.qtext and bw.clean = c.clean
    )
    select aircraft, q, ord, icao, score,
           row_number() over (partition by aircraft order by score desc, case when d < 2 then d - 5 else d end, ord) as place
    from sc where score >= 50""",
)
def nearby_search(spark, sf):
    users = adapt(spark, sf, "positions").select("aircraft").distinct()
    k = F.col("aircraft") % 4
    asked = users.select(
        F.col("aircraft").alias("query_id"), "aircraft",
        F.when(k == 0, "SUPLIER").when(k == 1, "K01").when(k == 2, "005").otherwise("NATION").alias("query"),
    )
    return ap.search_nearby(_nearby(spark, sf), asked).select(
        "aircraft", "q", "ord", "icao", "score", "place"
    )


ENDS_CTE = f"""
    pts as materialized (select * from {_POINTS} p),
    ends as (
      select aircraft,
             coalesce(arg_min(lat, idx) filter (alt > 500 and gs > 60), arg_min(lat, idx)) as o_lat,
             coalesce(arg_min(lon, idx) filter (alt > 500 and gs > 60), arg_min(lon, idx)) as o_lon,
             arg_max(lat, idx) as d_lat, arg_max(lon, idx) as d_lon
      from pts group by aircraft),
    od as materialized (
      select e.aircraft, o.icao as origin, o.iata as origin_iata, o.country as origin_country,
             d.icao as destination, d.iata as destination_iata, d.country as destination_country
      from ends e
      left join (select * from (select e.aircraft, a.*, row_number() over (partition by e.aircraft
                   order by {O.haversine('e.o_lat', 'e.o_lon', 'a.lat', 'a.lon')}, a.ord) as rn,
                   {O.haversine('e.o_lat', 'e.o_lon', 'a.lat', 'a.lon')} as dist
                 from ends e cross join {_LISTED} a) x where rn = 1 and dist <= 30) o on o.aircraft = e.aircraft
      left join (select * from (select e.aircraft, a.*, row_number() over (partition by e.aircraft
                   order by {O.haversine('e.d_lat', 'e.d_lon', 'a.lat', 'a.lon')}, a.ord) as rn,
                   {O.haversine('e.d_lat', 'e.d_lon', 'a.lat', 'a.lon')} as dist
                 from ends e cross join {_LISTED} a) x where rn = 1 and dist <= 30) d on d.aircraft = e.aircraft
    )"""


def detected(spark, sf):
    return ap.origin_destination(
        tracks.clean_tracks(adapt(spark, sf, "positions")), airport_rows(spark, sf)
    )


@query(
    "origin_destination",
    f"""with {ENDS_CTE}
    select aircraft, origin, origin_iata, destination, destination_iata from od""",
)
def origin_destination(spark, sf):
    return detected(spark, sf).select(
        "aircraft",
        F.col("origin")["icao"].alias("origin"), F.col("origin")["iata"].alias("origin_iata"),
        F.col("destination")["icao"].alias("destination"),
        F.col("destination")["iata"].alias("destination_iata"),
    )


# ---------------------------------------------------------------- thinning


@query(
    "greedy_dedup",
    f"""
    with recursive exact as (
      select * from (
        select *, row_number() over (partition by ident, printf('%.4f', lat), printf('%.4f', lon) order by ord) as rn
        from {oracle('sites')} s) e where rn = 1
    ),
    numbered as (
      select ord, ident, type, lat, lon, row_number() over (partition by ident order by ord) as i from exact
    ),
    fold as (
      select ident, cast(0 as bigint) as i, cast([] as struct(ord bigint, lat double, lon double)[]) as kept
      from (select distinct ident from numbered) d
      union all
      select f.ident, n.i,
             case when len(list_filter(f.kept, lambda k: abs(k.lat - n.lat) < case when n.type = 'fix' then 0.5e0 else 0.05e0 end
                         and abs(k.lon - n.lon) < case when n.type = 'fix' then 0.5e0 else 0.05e0 end)) > 0
                  then f.kept else list_append(f.kept, {{'ord': n.ord, 'lat': n.lat, 'lon': n.lon}}) end
      from fold f join numbered n on n.ident = f.ident and n.i = f.i + 1
    ),
    final as (select ident, kept from fold qualify row_number() over (partition by ident order by i desc) = 1)
    select f.ident, u.k.ord as ord from final f, unnest(f.kept) as u(k)
    """,
)
def greedy_dedup(spark, sf):
    return thinning.proximity_dedup(adapt(spark, sf, "sites")).select("ident", "ord")


THIN_ZOOM = 6.0


@query(
    "zoom_thinning",
    f"""
    with recursive px as (
      select ord, ident, (lon + 180e0) / 360e0 * 16384e0 as px,
             (1e0 - ln(tan(pi() / 4e0 + lat * (pi() / 360e0))) / pi()) / 2e0 * 16384e0 as py
      from {oracle('sites')} s
    ),
    numbered as (
      select *, floor(px / 2 + 0.5e0) as sx, floor(py / 2 + 0.5e0) as sy, row_number() over (order by ord) as i from px
    ),
    fold as (
      select cast(0 as bigint) as i,
             cast([] as struct(ord bigint, ident varchar, px double, py double, sx double, sy double)[]) as kept
      union all
      select n.i,
             case when len(list_filter(f.kept, lambda k: (k.sx = n.sx and k.sy = n.sy) or (k.ident = n.ident
                      and (k.px - n.px) * (k.px - n.px) + (k.py - n.py) * (k.py - n.py) < 1600e0))) > 0
                  then f.kept
                  else list_append(f.kept, {{'ord': n.ord, 'ident': n.ident, 'px': n.px, 'py': n.py, 'sx': n.sx, 'sy': n.sy}}) end
      from fold f join numbered n on n.i = f.i + 1
    )
    select u.k.ord as ord, u.k.ident as ident from (select kept from fold order by i desc limit 1) f, unnest(f.kept) as u(k)
    """,
)
def zoom_thinning(spark, sf):
    return thinning.thin_for_zoom(adapt(spark, sf, "sites"), THIN_ZOOM).select("ord", "ident")


@query(
    "corridor_geodesic",
    f"""
    with segs as materialized (select * from {O.segments(_POINTS)} s),
    sides as (
      select s.*, o.ord, o.lat, o.lon,
             {O.haversine('s.a_lat', 's.a_lon', 'o.lat', 'o.lon')} as ap,
             {O.haversine('s.a_lat', 's.a_lon', 's.b_lat', 's.b_lon')} as ab,
             {O.haversine('s.b_lat', 's.b_lon', 'o.lat', 'o.lon')} as bp
      from segs s join {oracle('sites')} o
        on o.lat between least(s.a_lat, s.b_lat) - 0.1e0 and greatest(s.a_lat, s.b_lat) + 0.1e0
    ),
    foot as (select *, case when ab < 0.01e0 then 0e0
                       else greatest(0e0, least(1e0, (ap * ap - bp * bp + ab * ab) / (2 * ab * ab))) end as t from sides),
    d as (select aircraft, ord, seg,
                 {O.haversine('lat', 'lon', '(a_lat + t * (b_lat - a_lat))', '(a_lon + t * (b_lon - a_lon))')} as d
          from foot)
    select aircraft, ord, round(min(d), 6) as distance from d group by aircraft, ord having min(d) <= 5
    """,
)
def corridor_geodesic(spark, sf):
    segs = tracks.track_segments(tracks.clean_tracks(adapt(spark, sf, "positions")))
    near = corridor.nearest_of_sites(segs, adapt(spark, sf, "sites"), 5.0, ["ord"], method="geodesic")
    return near.select("aircraft", "ord", r6("distance").alias("distance"))
