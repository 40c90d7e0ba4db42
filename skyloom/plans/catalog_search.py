"""Registered queries: phonetics and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.phonetic import (
    TextKeys,
    consonant_skeleton,
    phonetic_normalize,
    sound_score_keys,
    sound_similarity,
)
from skyloom.operators import airports as ap
from skyloom.operators import area, corridor, search, spatial
from skyloom.operators.tracks import clean_tracks
from skyloom.plans import oracle_parts as O
from skyloom.plans.adapters import adapt, oracle, table
from skyloom.plans.registry import query
from skyloom.session import cut_lineage

# ---------------------------------------------------------------- phonetics

_WORDS = """(
  select word as text, count(*) as n from (
    select unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents
  ) w group by word
)"""


@query(
    "phonetic_keys",
    f"""select k.text as word, w.n as n, k.ph as phonetic, k.sk as skeleton
        from {O.text_keys(_WORDS)} k join {_WORDS} w on w.text = k.text""",
)
def phonetic_keys(spark, sf):
    words = table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")
    )
    # Counting first means each distinct word is normalised once.
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(
        "word", "n",
        phonetic_normalize(F.col("word")).alias("phonetic"),
        consonant_skeleton(F.col("word")).alias("skeleton"),
    )


_NAMES = "(select distinct replace(upper(p_name), ' ', '') as text, substr(replace(upper(p_name), ' ', ''), 1, 5) as id, upper(p_type) as q from part)"


@query(
    "sound_scores",
    f"""select n.text, n.q, cast({O.similarity('t.raw', 'q.raw')} as bigint) as similarity,
               cast({O.score('t', 'q')} as bigint) as score,
               cast({O.score('tp', 'qp')} as bigint) as page_score
        from {_NAMES} n
        join {O.text_keys('(select distinct text from ' + _NAMES + ' n1)')} t on t.text = n.text
        join {O.text_keys('(select distinct q as text from ' + _NAMES + ' n2)')} q on q.text = n.q
        join {O.text_keys('(select distinct text from ' + _NAMES + ' n3)', 'page')} tp on tp.text = n.text
        join {O.text_keys('(select distinct q as text from ' + _NAMES + ' n4)', 'page')} qp on qp.text = n.q
    """,
)
def sound_scores(spark, sf):
    pairs = (
        table(spark, sf, "part")
        .select(
            F.replace(F.upper("p_name"), F.lit(" "), F.lit("")).alias("text"),
            F.upper("p_type").alias("q"),
        )
        .distinct()
    )
    for tag, dialect in (("w", "worker"), ("p", "page")):
        pairs = pairs.withColumn(f"t{tag}", TextKeys.struct_of(F.col("text"), dialect))
        pairs = pairs.withColumn(f"q{tag}", TextKeys.struct_of(F.col("q"), dialect))

    def score(tag):
        return sound_score_keys(TextKeys.of(F.col(f"t{tag}")), TextKeys.of(F.col(f"q{tag}")))

    return pairs.select(
        "text", "q", sound_similarity(F.col("text"), F.col("q")).alias("similarity"),
        score("w").alias("score"), score("p").alias("page_score"),
    )


# ---------------------------------------------------------------- search

_BRANCHES = f"""(
  select 0 as branch, ord, ident, name, type, lat, lon, ident as t1,
         regexp_replace(name, '[^A-Z]', '', 'g') as t2, lat as lo_lat, lat as hi_lat,
         lon as lo_lon, lon as hi_lon
  from {oracle('sites')} s
  union all
  select 1, ord, upper(trim(regexp_replace(name, '\\s*MOA$', '', 'i'))), name, 'moa',
         c_lat, c_lon, upper(trim(regexp_replace(name, '\\s*MOA$', '', 'i'))), null,
         c_lat - half, c_lat + half, c_lon - half, c_lon + half
  from (select *, row_number() over (partition by name order by ord) as rn
        from {oracle('areas')} a0) a where rn = 1
  union all
  select 2, ord, name, icao, 'fbo', lat, lon, name, null, lat, lat, lon, lon
  from {oracle('fbos')} f
)"""


def _row_score(layers: str) -> str:
    own = O.score("k1", "q")
    by_name = O.score("k2", "q")
    return f"""case when branch = 0 then greatest({own}, case when name is null or name = '' then 0
        else greatest({by_name}, case when contains(upper(name), q.raw) then 90 else 0 end) end)
      else {own} + case when k1.raw = q.raw then 500 when starts_with(k1.raw, q.raw) then 300
                        when contains(k1.raw, q.raw) then 150 else 0 end end"""


def _search_oracle(rows: str, queries: str, on: str, k: int = 30) -> str:
    return f"""
    with rows_ as (select * from {rows} r0),
    q_ as (select query_id, text as qtext, * exclude (query_id, text) from {queries} q0),
    qk as (select * from {O.text_keys('(select distinct qtext as text from q_)')} k),
    t_ as (select * from {O.text_keys('(select t1 as text from rows_ union select t2 from rows_ where t2 is not null)')} k),
    sig as (select distinct branch, name, t1, t2 from rows_),
    pair as (
      select sig.branch, sig.name, sig.t1, sig.t2, q.text as q, cast({_row_score('')} as bigint) as score
      from sig cross join qk q
      join t_ k1 on k1.text = sig.t1 left join t_ k2 on k2.text = sig.t2
    ),
    hit as (
      select q_.query_id, q_.qtext as q, r.*, p.score
      from q_ join pair p on p.q = q_.qtext
      join rows_ r on r.branch = p.branch and r.name is not distinct from p.name and r.t1 = p.t1
      where p.score > 0 and {on}
    ),
    ranked as (
      select *, row_number() over (partition by query_id order by score desc, ident, branch, ord) as rank
      from hit
    )
    select query_id, q, cast(rank as bigint) as rank, score, cast(branch as bigint) as branch,
           ord, ident, name, type, round(lat, 6) as lat, round(lon, 6) as lon
    from ranked where rank <= {k}
    """


_Q_ALL = f"(select query_id, upper(trim(query)) as text from {oracle('queries')} a where trim(query) <> '')"
_Q_BOX = f"(select query_id, upper(trim(query)) as text, min_lat, max_lat, min_lon, max_lon from {oracle('box_queries')} a where trim(query) <> '')"
_IN_BOX = "r.hi_lat >= q_.min_lat and r.lo_lat <= q_.max_lat and r.hi_lon >= q_.min_lon and r.lo_lon <= q_.max_lon"
_FIXES_ONLY = f"(select * from {_BRANCHES} b where branch = 0)"

_SEARCH_OUT = ["query_id", "q", "rank", "score", "branch", "ord", "ident", "name", "type"]


def _search_cols(df):
    return df.select(
        *_SEARCH_OUT, F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


def moas(spark, sf):
    """Airspaces of the check data: a diamond with a smaller diamond hole."""
    a = adapt(spark, sf, "areas")

    def ring(scale):
        pts = [(-1, 0), (0, 1), (2, 0), (0, -1), (-1, 0)]
        return F.array(
            *[
                F.array(F.col("c_lon") + F.col("half") * dx * scale,
                        F.col("c_lat") + F.col("half") * dy * scale)
                for dx, dy in pts
            ]
        )

    half = F.col("half")
    square = {
        "min_lat": F.col("c_lat") - half, "max_lat": F.col("c_lat") + half,
        "min_lon": F.col("c_lon") - half, "max_lon": F.col("c_lon") + half,
    }
    return a.select(
        "ord", "name", F.array(F.array(ring(1.0), ring(0.5))).alias("polys"),
        F.struct(*[c.alias(n) for n, c in square.items()]).alias("bbox"),
    )


@query("fuzzy_search_topk", _search_oracle(_FIXES_ONLY, _Q_ALL, "true"))
def fuzzy_search_topk(spark, sf):
    return _search_cols(search.search(adapt(spark, sf, "queries"), adapt(spark, sf, "sites")))


@query("fuzzy_search_layers", _search_oracle(_BRANCHES, _Q_ALL, "true"))
def fuzzy_search_layers(spark, sf):
    return _search_cols(
        search.search(
            adapt(spark, sf, "queries"), adapt(spark, sf, "sites"), moas(spark, sf),
            adapt(spark, sf, "fbos"),
        )
    )


@query("fuzzy_search_bbox", _search_oracle(_BRANCHES, _Q_BOX, _IN_BOX))
def fuzzy_search_bbox(spark, sf):
    return _search_cols(
        search.search(
            adapt(spark, sf, "box_queries"), adapt(spark, sf, "sites"), moas(spark, sf),
            adapt(spark, sf, "fbos"),
        )
    )


@query(
    "search_by_group",
    f"""
    with rows_ as (select *, ident as t1, regexp_replace(name, '[^A-Z]', '', 'g') as t2
                   from {oracle('sites')} s),
    q_ as (select query_id, icao, upper(trim(query)) as qtext from {oracle('airport_queries')} a),
    qk as (select * from {O.text_keys("(select distinct qtext as text from q_)")} k),
    t_ as (select * from {O.text_keys('(select t1 as text from rows_ union select t2 from rows_)')} k),
    tot as (select airport, count(*) as total from rows_ group by airport),
    scored as (
      select q_.query_id, q_.icao as airport, q_.qtext as q, r.ord, r.ident, r.name, r.type,
             case when q_.qtext = '' then null
                  else cast(greatest({O.score('k1', 'q')}, {O.score('k2', 'q')}) as bigint) end as score
      from q_ join rows_ r on r.airport = q_.icao join qk q on q.text = q_.qtext
      join t_ k1 on k1.text = r.t1 join t_ k2 on k2.text = r.t2
    ),
    ranked as (
      select *, row_number() over (partition by query_id order by coalesce(score, 0) desc, ord) as rank
      from scored where score is null or score > 0
    )
    select query_id, r.airport, q, cast(rank as bigint) as rank, score, ord, ident, name, type, total
    from ranked r join tot on tot.airport = r.airport
    where rank <= case when q = '' then 100 else 50 end
    """,
)
def search_by_group(spark, sf):
    return search.search_airport(
        adapt(spark, sf, "airport_queries"), adapt(spark, sf, "sites")
    ).drop("lat", "lon")


# ---------------------------------------------------------------- area selection

AREA_TYPES = "('fix', 'airport', 'vor', 'ndb', 'vfr')"


def in_view_sql(regions: str, types: str, extra: str = "") -> str:
    """Sites in boxes, navaids of one name once per box."""
    return f"""(
      select * exclude (rn) from (
        select r.region_id, s.*, row_number() over (
                 partition by r.region_id,
                   case when s.type in ('vor', 'ndb') and s.name <> '' then s.name else '#' || s.ord end
                 order by s.ord) as rn
        from {regions} r join {oracle('sites')} s on {O.in_box('s.lat', 's.lon', 'r')}
        where s.type in {types}
      ) v where rn = 1
    )"""


def diamonds(spark, sf):
    r = adapt(spark, sf, "regions")
    mid_lat, mid_lon = "(min_lat + max_lat) / 2e0", "(min_lon + max_lon) / 2e0"
    corners = [("max_lat", mid_lon), (mid_lat, "max_lon"), ("min_lat", mid_lon), (mid_lat, "min_lon")]
    body = ", ".join(f"named_struct('lat', {a}, 'lon', {o})" for a, o in corners)
    return r.withColumn("vertices", F.expr(f"array({body})"))


_DIAMOND = f"""(
  select region_id, list_value(
     {{'lat': max_lat, 'lon': (min_lon + max_lon) / 2e0}},
     {{'lat': (min_lat + max_lat) / 2e0, 'lon': max_lon}},
     {{'lat': min_lat, 'lon': (min_lon + max_lon) / 2e0}},
     {{'lat': (min_lat + max_lat) / 2e0, 'lon': min_lon}}) as v
  from {oracle('regions')} r
)"""

CIRCLE_ZOOM = 6.0
CIRCLE_RADIUS_PX = 180.0

_CIRCLE = f"""(
  select region_id, list_transform(range(0, 36), lambda i: {{
     'lat': atan(exp(pi() * (1e0 - (cy + {CIRCLE_RADIUS_PX}e0 * sin(cast(i as double) / 36 * (2e0 * pi()))) * 2e0 / 16384e0))) * (360e0 / pi()) - 90e0,
     'lon': (cx + {CIRCLE_RADIUS_PX}e0 * cos(cast(i as double) / 36 * (2e0 * pi()))) / 16384e0 * 360e0 - 180e0}}) as v
  from (
    select region_id, ((min_lon + max_lon) / 2e0 + 180e0) / 360e0 * 16384e0 as cx,
           (1e0 - ln(tan(pi() / 4e0 + (min_lat + max_lat) / 2e0 * (pi() / 360e0))) / pi()) / 2e0 * 16384e0 as cy
    from {oracle('regions')} r
  ) c
)"""


def ray_sql(lat: str, lon: str, v: str) -> str:
    """Even-odd test over a list of vertices."""
    return f"""(len(list_filter(range(1, len({v}) + 1), lambda i:
        ({v}[i].lon > {lon}) <> ({v}[case when i = 1 then len({v}) else i - 1 end].lon > {lon})
        and {lat} < ({v}[case when i = 1 then len({v}) else i - 1 end].lat - {v}[i].lat)
             * ({lon} - {v}[i].lon)
             / (case when {v}[case when i = 1 then len({v}) else i - 1 end].lon = {v}[i].lon then 1e0
                     else {v}[case when i = 1 then len({v}) else i - 1 end].lon - {v}[i].lon end)
             + {v}[i].lat)) % 2 = 1)"""


def _selection_sql(polygons: str | None) -> str:
    """Selected sites of all three layers; polygons NULL means rectangles."""
    if polygons is None:
        boxes, inside, extra = oracle("regions"), "true", "r.region_id"
        poly_join = ""
    else:
        boxes = f"""(
          select region_id, v, list_min(list_transform(v, lambda x: x.lat)) as min_lat,
                 list_max(list_transform(v, lambda x: x.lat)) as max_lat,
                 list_min(list_transform(v, lambda x: x.lon)) as min_lon,
                 list_max(list_transform(v, lambda x: x.lon)) as max_lon
          from {polygons} p)"""
        poly_join = "join boxes_ b on b.region_id = x.region_id"
        inside = ray_sql("x.lat", "x.lon", "b.v")
    box_cols = "region_id, min_lat, max_lat, min_lon, max_lon"
    return f"""
    with boxes_ as materialized (select * from {boxes} b0),
    m_ as (
      select r.region_id, a.ord, a.name, c_lat as lat, c_lon as lon, row_number() over (
               partition by r.region_id, a.name order by a.ord) as rn
      from boxes_ r join {oracle('areas')} a
        on c_lat + half >= r.min_lat and c_lat - half <= r.max_lat
       and c_lon + half >= r.min_lon and c_lon - half <= r.max_lon
    ),
    x_ as (
      select region_id, 2 as branch, ord, ident, name, type, lat, lon, cast(null as varchar) as copy_text
      from {in_view_sql(f'(select {box_cols} from boxes_)', AREA_TYPES)} v
      union all
      select region_id, 0, ord, upper(trim(regexp_replace(name, '\\s*MOA$', '', 'i'))), name, 'moa', lat, lon,
             lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\s*MOA$', '', 'i'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')))
      from m_ where rn = 1
      union all
      select r.region_id, 1, f.ord, f.name, f.icao, 'fbo', f.lat, f.lon, f.name
      from boxes_ r join {oracle('fbos')} f on {O.in_box('f.lat', 'f.lon', 'r')}
    )
    select x.region_id, cast(branch as bigint) as branch, ord, ident, name, type,
           round(lat, 6) as lat, round(lon, 6) as lon, copy_text
    from x_ x {poly_join} where {inside}
    """


def _selection_cols(df):
    return df.select(
        "region_id", "branch", "ord", "ident", "name", "type", F.round("lat", 6).alias("lat"),
        F.round("lon", 6).alias("lon"), "copy_text",
    )


def _select(spark, sf, regions):
    return area.select_area(
        regions, adapt(spark, sf, "sites"), moas(spark, sf), adapt(spark, sf, "fbos")
    )


@query("rectangle_select", _selection_sql(None))
def rectangle_select(spark, sf):
    return _selection_cols(_select(spark, sf, adapt(spark, sf, "regions")))


@query("polygon_select", _selection_sql(_DIAMOND))
def polygon_select(spark, sf):
    return _selection_cols(_select(spark, sf, diamonds(spark, sf)))


@query("circle_select", _selection_sql(_CIRCLE))
def circle_select(spark, sf):
    r = adapt(spark, sf, "regions").select(
        "region_id",
        F.expr("(min_lat + max_lat) / 2e0").alias("center_lat"),
        F.expr("(min_lon + max_lon) / 2e0").alias("center_lon"),
        F.lit(CIRCLE_RADIUS_PX).alias("radius"),
    )
    circles = area.circle_regions(r, CIRCLE_ZOOM).withColumns(
        {c: F.lit(None).cast("double") for c in spatial.BOX}
    )
    return _selection_cols(_select(spark, sf, circles))


_AREA_Q = f"(select n_nationkey as region_id, substr(replace(upper(p_name), ' ', ''), 2, 6) as q from nation join part on p_partkey = n_nationkey * 7)"


@query(
    "area_search",
    f"""
    with sel as materialized ({_selection_sql(None)}),
    q_ as (select * from {_AREA_Q} a),
    t_ as (select * from {O.text_keys("(select ident as text from sel union select regexp_replace(name, '[^A-Z]', '', 'g') from sel)", 'page')} k),
    qk as (select * from {O.text_keys('(select distinct q as text from q_)', 'page')} k),
    sig as (select distinct s.region_id, s.ident, s.name, q_.q from sel s join q_ on q_.region_id = s.region_id),
    sc as (
      select sig.*, cast(greatest({O.score('k1', 'q')}, {O.score('k2', 'q')}) as bigint) as score
      from (select *, regexp_replace(name, '[^A-Z]', '', 'g') as t2 from sig) sig
      join t_ k1 on k1.text = sig.ident join t_ k2 on k2.text = sig.t2 join qk q on q.text = sig.q
    )
    select s.region_id, sc.q, s.branch, s.ord, s.ident, s.name, s.type, sc.score
    from sel s join sc on sc.region_id = s.region_id and sc.ident = s.ident and sc.name = s.name
    where sc.score > 0
    """,
)
def area_search(spark, sf):
    sel = _select(spark, sf, adapt(spark, sf, "regions"))
    asked = adapt(spark, sf, "box_queries").select(F.col("query_id").alias("region_id"), "query")
    return area.area_search(sel, asked).select(
        "region_id", "q", "branch", "ord", "ident", "name", "type", "score"
    )


@query(
    "area_copy_all",
    f"""
    with sel as materialized ({_selection_sql(None)}),
    pos as (
      select region_id, ident, row_number() over (partition by region_id order by ident, branch, ord) - 1 as p
      from sel
    )
    select region_id, string_agg(ident, ', ' order by p) as copy_text, count(*) as sites
    from pos group by 1
    """,
)
def area_copy_all(spark, sf):
    return area.copy_all(_select(spark, sf, adapt(spark, sf, "regions")))


# ---------------------------------------------------------------- searches in track results


def _zones(spark, sf, carried=()):
    return corridor.corridor_zones(
        cut_lineage(clean_tracks(adapt(spark, sf, "positions"))), adapt(spark, sf, "sites"),
        moas(spark, sf), adapt(spark, sf, "fbos"), carried=carried,
    )


def airport_rows(spark, sf):
    return ap.airport_list(
        adapt(spark, sf, "airport_src").select(
            "ord", "ident", "gps", "local", "iata", "name", "city", "country", "lat", "lon", "type"
        )
    )
