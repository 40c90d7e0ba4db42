"""Registered queries: routes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.text import null_if_empty
from skyloom.functions.web import strip_tags
from skyloom.operators import routes
from skyloom.operators.airports import airport_keys
from skyloom.plans.adapters import adapt, oracle, table
from skyloom.plans.catalog_spatial import _KEYS, ENDS_CTE, detected
from skyloom.plans.registry import query
from skyloom.session import cut_lineage


@query(
    "link_extract",
    """select page_id, cast(i - 1 as bigint) as pos, links[i] as href
       from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as links from pages) p,
            unnest(range(1, len(links) + 1)) as u(i)""",
)
def link_extract(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


@query(
    "page_title_info",
    """select page_id, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') as title,
              nullif(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '') as heading,
              contains(html, 'not found') or contains(html, 'Unknown Airport') as missing
       from pages""",
)
def page_title_info(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        null_if_empty(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"),
        null_if_empty(
            strip_tags(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
        ).alias("heading"),
        (F.contains("html", F.lit("not found")) | F.contains("html", F.lit("Unknown Airport"))).alias(
            "missing"
        ),
    )


_TRIMMED = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), 'AirNav:', '', 'gi'), ' \t\n\r')"


@query(
    "airport_page_info",
    f"""select page_id, cast(page_id as varchar) as ident,
               case when contains(html, 'not found') or contains(html, 'Unknown Airport') then null else {_TRIMMED} end as name,
               case when contains(html, 'not found') or contains(html, 'Unknown Airport') then null else '' end as location,
               case when contains(html, 'not found') or contains(html, 'Unknown Airport') then false else {_TRIMMED} <> '' end as is_found
        from pages""",
)
def airport_page_info(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("ident"), "html"
    )
    return routes.airport_page_info(pages)


_LINKS = f"""(
  select callsign, page_id, kind, i, m, regexp_extract(m, '(?i)/history/(\\d{{8}})/', 1) as d,
         regexp_extract(m, '(?i)/history/\\d{{8}}/(\\d{{4}})Z/', 1) as t,
         upper(regexp_extract(m, '(?i)Z/([A-Z0-9]{{2,4}})/', 1)) as orig,
         upper(regexp_extract(m, '(?i)Z/[A-Z0-9]{{2,4}}/([A-Z0-9]{{2,4}})', 1)) as dest
  from (
    select callsign, page_id, kind, i, ms[i] as m
    from (select *, regexp_extract_all(html, '(?i)href="[^"]*/history/\\d{{8}}/\\d{{4}}Z/[A-Z0-9]{{2,4}}/[A-Z0-9]{{2,4}}') as ms
          from {oracle('route_pages')} p) a, unnest(range(1, len(ms) + 1)) as u(i)
  ) b
)"""


@query(
    "route_extract",
    f"""select callsign, page_id, cast(i - 1 as bigint) as pos, orig, dest, d as date_str, t as time_str,
               epoch_us(strptime(d || t, '%Y%m%d%H%M')) as ts_us from {_LINKS} l""",
)
def route_extract(spark, sf):
    return routes.extract_routes(adapt(spark, sf, "route_pages")).select(
        "callsign", F.col("ord.p").alias("page_id"), F.col("ord.i").alias("pos"), "orig", "dest",
        "date_str", "time_str", F.unix_micros("ts").alias("ts_us"),
    )


@query(
    "airline_names",
    f"""select callsign, airline from (
          select callsign, trim(regexp_extract(html, '(?i)<title>\\s*([^(]+?) Flight ', 1)) as airline,
                 row_number() over (partition by callsign order by page_id) as rn
          from {oracle('route_pages')} p where kind = 'live') a where rn = 1""",
)
def airline_names(spark, sf):
    return routes.airlines(adapt(spark, sf, "route_pages"))


def _asof_sql(flights: str, candidates: str) -> str:
    diff = """case when c.ts > f.as_of then epoch_ms(c.ts) - epoch_ms(f.as_of) + 86400000
                   else epoch_ms(f.as_of) - epoch_ms(c.ts) end"""
    return f"""(
      select * from (
        select f.flight_id, f.callsign, c.orig, c.dest, c.ts, c.ord, {diff} as diff,
               row_number() over (partition by f.flight_id order by {diff}, c.ord) as rn
        from {flights} f join {candidates} c on c.callsign = f.callsign
      ) x where rn = 1)"""


@query(
    "route_asof",
    f"""select f.flight_id, b.ord, b.orig, b.dest, epoch_us(b.ts) as ts_us, b.diff as time_diff
        from {oracle('flights')} f
        left join {_asof_sql(oracle('flights'), oracle('candidates'))} b on b.flight_id = f.flight_id""",
)
def route_asof(spark, sf):
    cand = adapt(spark, sf, "candidates").withColumn("date_str", F.lit("")).withColumn(
        "time_str", F.lit("")
    )
    flights = adapt(spark, sf, "flights").select("callsign", "flight_id", "as_of")
    out = routes.route_asof(flights, cand, ["callsign"])
    best = F.col("best")
    return out.select(
        "flight_id", best["ord"].alias("ord"), best["orig"].alias("orig"),
        best["dest"].alias("dest"), F.unix_micros(best["ts"]).alias("ts_us"), "time_diff",
    )


def _norm(x: str) -> str:
    return (
        f"case when length(upper(trim({x}))) = 4 and regexp_matches(upper(trim({x})), '^[KCEPYL]') "
        f"then substr(upper(trim({x})), 2, 3) else upper(trim({x})) end"
    )


def _match_sql(flights: str, candidates: str) -> str:
    diff = """case when c.ts > f.as_of then epoch_ms(c.ts) - epoch_ms(f.as_of) + 86400000
                   else epoch_ms(f.as_of) - epoch_ms(c.ts) end"""
    return f"""(
      select * from (
        select *, row_number() over (partition by flight_id order by diff, ord) as rn
        from (
          select f.flight_id, f.callsign, c.orig, c.dest, c.ts, c.ord, {diff} as diff,
                 {_norm('f.gps_origin')} <> '' and {_norm('c.orig')} = {_norm('f.gps_origin')} as hit,
                 max(case when {_norm('f.gps_origin')} <> '' and {_norm('c.orig')} = {_norm('f.gps_origin')}
                          then 1 else 0 end) over (partition by f.flight_id) as any_hit
          from {flights} f join {candidates} c on c.callsign = f.callsign
        ) y where hit or any_hit = 0
      ) x where rn = 1)"""


@query(
    "route_origin_fallback",
    f"""select flight_id, callsign, orig as origin, dest as destination, epoch_us(ts) as ts_us,
               diff as time_diff from {_match_sql(oracle('flights'), oracle('candidates'))} m""",
)
def route_origin_fallback(spark, sf):
    cand = adapt(spark, sf, "candidates").withColumn("date_str", F.lit("")).withColumn(
        "time_str", F.lit("")
    )
    return routes.match_route(adapt(spark, sf, "flights"), cand).select(
        "flight_id", "callsign", "origin", "destination",
        F.unix_micros("departure").alias("ts_us"), "time_diff",
    )


# Flights of tracked aircraft: every second user flies under the number of a customer.
_TRACKED = f"""(select distinct aircraft as flight_id, aircraft,
                 case when aircraft % 3 = 0 then 'NONE' else cast(aircraft as varchar) end as callsign,
                 cast('1998-06-01 00:00:00' as timestamp) as as_of from {oracle('positions')} p)"""


def _end_sql(end: str) -> str:
    return f"""case when r.flight_id is not null
                 then coalesce(k{end}.icao, r.{end}) else coalesce(k{end}.icao, od.{end}) end as {end},
               k{end}.name as {end}_name, k{end}.city as {end}_city,
               coalesce(k{end}.country, case when r.flight_id is null then od.{end}_country end) as {end}_country"""


@query(
    "resolve_route",
    f"""with {ENDS_CTE},
    fl as (select t.*, od.origin as gps_origin from {_TRACKED} t left join od on od.aircraft = t.aircraft),
    cand as materialized (select callsign, page_id * 100 + i + case kind when 'live' then 1000000000 else 0 end as ord,
                    orig, dest, strptime(d || t, '%Y%m%d%H%M') as ts from {_LINKS} l),
    m as (select * from {_match_sql("(select flight_id, callsign, as_of, coalesce(gps_origin, '') as gps_origin from fl)", 'cand')} m0),
    r as (select flight_id, orig as origin, dest as destination from m)
    select fl.flight_id, case when r.flight_id is not null then 'page' else 'track' end as source,
           {_end_sql('origin')}, {_end_sql('destination')}
    from fl left join r on r.flight_id = fl.flight_id left join od on od.aircraft = fl.aircraft
    left join {_KEYS} korigin on korigin.key = case when r.flight_id is not null then r.origin else od.origin end
    left join {_KEYS} kdestination on kdestination.key = case when r.flight_id is not null then r.destination else od.destination end
    where r.flight_id is not null or od.origin is not null or od.destination is not null
    """,
)
def resolve_route(spark, sf):
    found = cut_lineage(detected(spark, sf))  # joined twice below
    users = adapt(spark, sf, "positions").select("aircraft").distinct()
    flights = users.select(
        F.col("aircraft").alias("flight_id"), "aircraft",
        F.when(F.col("aircraft") % 3 == 0, "NONE").otherwise(F.col("aircraft").cast("string")).alias("callsign"),
        F.lit("").alias("registration"),
        F.lit("1998-06-01 00:00:00").cast("timestamp").alias("as_of"),
    )
    flights = routes.gps_flights(flights, found)
    pages = adapt(spark, sf, "route_pages")
    matched = routes.match_route(flights, routes.extract_routes(pages), routes.airlines(pages))
    keys = airport_keys(adapt(spark, sf, "airport_src"))
    out = routes.resolve_route(flights, found, matched, keys)
    cols = []
    for end in ("origin", "destination"):
        cols.append(F.col(end)["icao"].alias(end))
        cols += [F.col(end)[c].alias(f"{end}_{c}") for c in ("name", "city", "country")]
    return out.select("flight_id", "source", *cols)
