"""Views of the driver's tables in the shape of the engine's inputs.

Each adapter is one SQL text understood by Spark and by the checking database alike, with the
tables written as ``{part}``; Spark gets the DataFrames substituted, the oracle the table names.
Double literals carry an exponent, so no side computes in decimals.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

SITES = """
select p_partkey as ord,
       substr(replace(upper(p_name), ' ', ''), 1, 5) as ident,
       upper(p_name) as name,
       upper(p_brand) as airport,
       case p_size % 5 when 0 then 'fix' when 1 then 'vor' when 2 then 'ndb'
                       when 3 then 'airport' else 'vfr' end as type,
       cast((p_partkey * 7919) % 6000 as double) / 1e2 + 10e0 as lat,
       cast((p_partkey * 104729) % 9000 as double) / 1e2 - 130e0 as lon
from {part}
"""

POSITIONS = """
select user_id as aircraft, event_id as ord, cast(ts as timestamp) as ts,
       20e0 + cast(user_id % 40 as double) + m * 0.0005e0 as lat,
       -120e0 + cast(user_id % 60 as double) + m * 0.001e0 as lon,
       value * 2e1 as alt, value as gs, event_type
from (select *, cast((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) as double) as m
      from {events}) e
"""

REGIONS = """
select n_nationkey as region_id,
       12e0 + cast(n_nationkey * 2 as double) as min_lat,
       20e0 + cast(n_nationkey * 2 as double) as max_lat,
       -128e0 + cast(n_nationkey * 3 as double) as min_lon,
       -116e0 + cast(n_nationkey * 3 as double) as max_lon
from {nation}
"""

QUERIES = """
select query as query_id, query from (
  select distinct substr(upper(p_name), 1 + strpos_(p_name), 20) as query from {part}
  union select distinct upper(p_type) as query from {part}
  union select distinct substr(replace(upper(p_name), ' ', ''), 2, 5) as query from {part}
) q
""".replace("strpos_(p_name)", "position(' ' in p_name)")

BOX_QUERIES = """
select n.n_nationkey as query_id, substr(replace(upper(p.p_name), ' ', ''), 2, 6) as query,
       r.min_lat, r.max_lat, r.min_lon, r.max_lon
from {nation} n
join {part} p on p.p_partkey = n.n_nationkey * 7
join (%s) r on r.region_id = n.n_nationkey
""" % REGIONS

AIRPORT_QUERIES = """
select p_brand as query_id, upper(p_brand) as icao,
       case when length(p_brand) %% 2 = 0 then '' else substr(upper(min(p_name)), 1, 7) end as query
from {part} group by p_brand
""".replace("%%", "%")

AIRPORT_SRC = """
select s_suppkey as ord,
       concat('K', lpad(cast(s_suppkey % 70 as varchar(10)), 3, '0')) as ident,
       case when s_suppkey % 3 = 0 then concat('G', lpad(cast(s_suppkey % 90 as varchar(10)), 3, '0'))
            end as gps,
       cast(null as varchar(10)) as local,
       lpad(cast(s_suppkey % 40 as varchar(10)), 3, '0') as iata,
       s_name as name,
       n_name as city,
       case when s_nationkey % 2 = 0 then 'US' else 'CA' end as country,
       20e0 + cast((s_suppkey * 7919) % 5000 as double) / 1e2 as lat,
       -120e0 + cast((s_suppkey * 10473) % 8000 as double) / 1e2 as lon,
       case s_suppkey % 4 when 0 then 'large_airport' when 1 then 'medium_airport'
                          when 2 then 'small_airport' else 'heliport' end as type
from {supplier} join {nation} on s_nationkey = n_nationkey
"""

# Airspace boxes: a diamond around a point per supplier.
AREAS = """
select s_suppkey as ord, concat('AREA ', cast(s_suppkey % 60 as varchar(10)), ' MOA') as name,
       15e0 + cast((s_suppkey * 7919) % 5000 as double) / 1e2 as c_lat,
       -125e0 + cast((s_suppkey * 10473) % 8000 as double) / 1e2 as c_lon,
       0.25e0 + cast(s_suppkey % 7 as double) / 2e0 as half
from {supplier}
"""

FBOS = """
select c_custkey as ord, c_name as name, c_mktsegment as icao,
       12e0 + cast((c_custkey * 7919) % 5500 as double) / 1e2 as lat,
       -128e0 + cast((c_custkey * 10473) % 8500 as double) / 1e2 as lon
from {customer}
"""

CANDIDATES = """
select cast(o_custkey as varchar(20)) as callsign, o_orderkey as ord,
       cast(o_orderdate as timestamp) as ts,
       concat(case when o_orderkey % 2 = 0 then 'K' else '' end, substr(o_orderpriority, 3, 3)) as orig,
       o_orderstatus as dest
from {orders}
"""

FLIGHTS = """
select c_custkey as flight_id, cast(c_custkey as varchar(20)) as callsign,
       '' as registration, cast('1998-01-01 00:00:00' as timestamp) as as_of,
       case when c_custkey % 3 = 0 then 'KHIG' when c_custkey % 3 = 1
            then concat('K', substr(c_mktsegment, 1, 3)) else '' end as gps_origin
from {customer}
"""

# A flight page per order, with a history link and a title.
ROUTE_PAGES = """
select o_orderkey as page_id, cast(o_custkey as varchar(20)) as callsign,
       case when o_orderkey % 5 = 0 then 'live' else 'history' end as kind,
       concat('<html><title>', o_orderpriority, ' Lines Flight ', cast(o_custkey as varchar(20)),
              ' (X', cast(o_custkey as varchar(20)), ') - FlightAware</title><a href="/live/flight/X/history/',
              cast(year(o_orderdate) as varchar(4)), lpad(cast(month(o_orderdate) as varchar(2)), 2, '0'),
              lpad(cast(day(o_orderdate) as varchar(2)), 2, '0'), '/',
              lpad(cast(o_orderkey % 24 as varchar(2)), 2, '0'), '30Z/K',
              substr(upper(replace(o_orderpriority, '-', '')), 2, 3), '/', 'LAX">x</a>',
              '<a href="/live/flight/Y/history/20240102/0230Z/lax/SFO">y</a></html>') as html
from {orders}
"""

# Fixed-width lines with the coordinates at offset 32.
RECORD_LINES = """
select p_partkey as seq,
       concat('SUSA', case p_size % 5 when 0 then 'E' when 1 then 'D' when 2 then 'P' when 3 then 'U'
                                      else 'D' end,
              ' ', 'KL', substr(upper(p_name), 1, 2), '   ',
              rpad(substr(replace(upper(p_name), ' ', ''), 1, 5), 5, ' '),
              '         ', case when p_size % 2 = 0 then 'VDHW ' else 'H    ' end,
              'N', lpad(cast(p_partkey % 90 as varchar(2)), 2, '0'),
              lpad(cast(p_partkey % 60 as varchar(2)), 2, '0'), '3050',
              'W', lpad(cast(p_partkey % 180 as varchar(3)), 3, '0'),
              lpad(cast(p_partkey % 59 as varchar(2)), 2, '0'), '1575') as line
from {part}
"""

PROC_TEXTS = """
select p_partkey as ord, substr(replace(upper(p_name), ' ', ''), 1, 5) as ident,
       upper(p_name) as name,
       case p_size % 3 when 0 then 'fix' when 1 then 'vor' else 'fix' end as type,
       case p_size % 5
         when 0 then concat('SID:', substr(replace(upper(p_name), ' ', ''), 1, 5), ' ',
                            cast(p_size % 9 as varchar(2)), 'D~DEPARTURE|',
                            substr(replace(upper(p_name), ' ', ''), 1, 5), ' 4E;STAR:FRIBU 1R')
         when 1 then 'SID/STAR'
         when 2 then concat('STAR:', substr(replace(upper(p_name), ' ', ''), 1, 5))
         when 3 then 'STAR'
         else '' end as procs
from {part}
"""

# Half of all polls share one aircraft and one moment; starts drift in steps of which no two in a row
# are a leg's worth.
POLLS = """
select case when user_id % 2 = 0 then 0 else user_id % 10 end as aircraft, event_id as ord,
       cast(date_trunc(case when user_id % 2 = 0 then 'month' else 'day' end, ts) as timestamp) as ts,
       case when event_id % 11 = 0 then '' when event_id % 40 < 8 then 'B' else 'A' end as callsign,
       30e0 + cast(event_id % 13 as double) * 0.004e0 as start_lat,
       cast(user_id % 3 as double) * 0.005e0 as start_lon
from {events}
"""

ALL = {
    "sites": SITES, "positions": POSITIONS, "regions": REGIONS, "queries": QUERIES,
    "box_queries": BOX_QUERIES, "airport_queries": AIRPORT_QUERIES, "airport_src": AIRPORT_SRC,
    "areas": AREAS, "fbos": FBOS, "candidates": CANDIDATES, "flights": FLIGHTS,
    "route_pages": ROUTE_PAGES, "record_lines": RECORD_LINES, "proc_texts": PROC_TEXTS,
    "polls": POLLS,
}


def tables_of(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame over the tables in ``sf_dir``."""
    sql = ALL[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables_of(sql)})


def oracle(name: str) -> str:
    """An adapter as a subquery for the checking database."""
    sql = ALL[name]
    return "(" + sql.format(**{t: t for t in tables_of(sql)}) + ")"
