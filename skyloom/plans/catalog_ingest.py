"""Registered queries: feed parsing, procedures, gazetteer, display columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import records as R
from skyloom.functions.text import moa_ident, moa_spoken, parse_float_prefix, title_case
from skyloom.operators import procedures
from skyloom.plans import gazetteer
from skyloom.plans.adapters import adapt, oracle, table
from skyloom.plans.registry import query, r6
from skyloom.sources import feeds


def _with_src(df, file: str, order: str = "seq"):
    return df.withColumn(
        "src",
        F.struct(
            F.lit(file).alias("file"), F.lit(0).cast("bigint").alias("block"),
            F.col(order).cast("bigint").alias("seq"),
        ),
    )


def record_lines(spark, sf):
    return _with_src(adapt(spark, sf, "record_lines"), "records").select("src", "line")


_RECORDS = f"""(
  select * from (
    select seq, trim(substr(line, 14, 5)) as ident,
           case substr(line, 5, 1)
             when 'D' then case when regexp_matches(substr(line, 28, 5), '[VDT]') then 'vor' else 'ndb' end
             when 'U' then null when 'P' then 'airport' when 'H' then 'airport' else 'fix' end as type,
           case when substr(line, 5, 1) = 'P' then trim(substr(line, 7, 4)) end as airport,
           cast(substr(line, 34, 2) as double) + cast(substr(line, 36, 2) as double) / 6e1
             + cast(substr(line, 38, 4) as double) / 1e2 / 36e2 as lat,
           -(cast(substr(line, 43, 3) as double) + cast(substr(line, 46, 2) as double) / 6e1
             + cast(substr(line, 48, 4) as double) / 1e2 / 36e2) as lon
    from {oracle('record_lines')} l
  ) r where type is not null and regexp_matches(ident, '^[A-Z]{{2,5}}$') and not starts_with(ident, 'RW')
        and lat between -90 and 90 and lon between -180 and 180
        and (type in ('vor', 'ndb') or length(ident) = 5)
)"""


@query(
    "fixed_width_parse",
    f"select seq, ident, type, airport, round(lat, 6) as lat, round(lon, 6) as lon from {_RECORDS} r",
)
def fixed_width_parse(spark, sf):
    return feeds.record_sites(record_lines(spark, sf)).select(
        F.col("src.seq").alias("seq"), "ident", "type", "airport", r6("lat").alias("lat"),
        r6("lon").alias("lon"),
    )


# Degree texts in three spellings.
_DMS = """(select p_partkey as ord,
   concat(cast(p_partkey % 90 as varchar(3)), case p_partkey % 3 when 0 then ' ' when 1 then '-' else '* ' end,
          cast(p_size % 60 as varchar(2)), case p_partkey % 3 when 0 then ' ' when 1 then '-' else ''' ' end,
          cast(p_size % 50 as varchar(2)), '.5', case p_partkey % 3 when 0 then ' ' when 1 then '' else '" ' end,
          case p_size % 4 when 0 then 'N' when 1 then 's' when 2 then 'E' else 'W' end) as dms
   from {part})"""


@query(
    "dms_parse",
    f"""select ord, dms, round((cast(p_partkey % 90 as double) + cast(p_size % 60 as double) / 6e1
               + (cast(p_size % 50 as double) + 0.5e0) / 36e2)
               * case when p_size % 4 in (1, 3) then -1 else 1 end, 6) as degrees
        from {_DMS.format(part='part')} d join part on p_partkey = ord""",
)
def dms_parse(spark, sf):
    texts = spark.sql(f"select * from {_DMS}", part=table(spark, sf, "part"))
    return texts.select("ord", "dms", r6(R.parse_dms(F.col("dms"))).alias("degrees"))


@query(
    "number_prefix",
    # A number beyond the range of DOUBLE is infinite.
    """select doc_id, coalesce(try_cast(digits as double), cast('infinity' as double)) as n from (
         select doc_id, nullif(regexp_extract(text, '([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?)', 1), '') as digits
         from documents) d where digits is not null""",
)
def number_prefix(spark, sf):
    # The text from its first digit on: only the leading number counts.
    tail = F.regexp_extract("text", r"(?s)([0-9].*)$", 1)
    return (
        table(spark, sf, "documents")
        .select("doc_id", parse_float_prefix(tail).alias("n"))
        .where(F.col("n").isNotNull())
    )


_PROC_ROWS = f"""(
  select ord, ident, name, type, u.pos - 1 as pos, split_part(p, '~', 1) as proc, kind as proc_type,
         nullif(substr(p, length(split_part(p, '~', 1)) + 2), '') as suffix
  from (
    select ord, ident, name, type, s.i as sec, split_part(s.sec, ':', 1) as kind,
           string_split(substr(s.sec, length(split_part(s.sec, ':', 1)) + 2), '|') as names
    from (
      select ord, ident, name, type, i, string_split(full_, ';')[i] as sec
      from (select *, case when contains(procs, ':') then procs
                  else concat_ws(';', case when contains(procs, 'SID') then 'SID:' || ident end,
                                 case when contains(procs, 'STAR') then 'STAR:' || ident end) end as full_
            from {oracle('proc_texts')} t where procs <> '') a,
           unnest(range(1, len(string_split(full_, ';')) + 1)) as r(i)
    ) s
  ) b, unnest(names) with ordinality as u(p, pos)
)"""


def _procs(spark, sf):
    t = adapt(spark, sf, "proc_texts")
    return t.withColumn("procs", R.parse_procs(F.col("procs"), F.col("ident")))


@query(
    "procs_parse",
    f"""select ord, ident, proc, proc_type as type, suffix from {_PROC_ROWS} p""",
)
def procs_parse(spark, sf):
    return procedures.fix_procs(_procs(spark, sf)).select("ord", "ident", "proc", "type", "suffix")


_SPOKEN = {
    "0": "ZERO", "1": "ONE", "2": "TWO", "3": "THREE", "4": "FOUR", "5": "FIVE", "6": "SIX",
    "7": "SEVEN", "8": "EIGHT", "9": "NINE", "D": "DELTA", "E": "ECHO", "R": "ROMEO",
}


def _spoken(ch: str) -> str:
    return "case " + ch + " " + " ".join(f"when '{k}' then '{v}'" for k, v in _SPOKEN.items()) + f" else {ch} end"


@query(
    "procs_rootfilter_readback",
    f"""select ord, ident, proc as label, proc_type,
               case when position(' ' in proc) = 0 then proc
                    else split_part(proc, ' ', 1) || ' ' || {_spoken("substr(split_part(proc, ' ', 2), 1, 1)")}
                         || ' ' || {_spoken("substr(split_part(proc, ' ', 2), 2, 1)")}
                         || case when suffix is not null then ' ' || suffix else '' end end as text
        from {_PROC_ROWS} p
        union all
        select distinct ord, ident, ident, null, ident from {_PROC_ROWS} p""",
)
def procs_rootfilter_readback(spark, sf):
    return procedures.procedure_catalogue(_procs(spark, sf)).select(
        "ord", "ident", "label", "proc_type", "text"
    )


@query(
    "site_labels",
    f"""with v as (select ord, max(case when proc <> ident then 1 else 0 end) as variants, count(*) as n
                   from {_PROC_ROWS} p group by ord)
    select t.ord, t.ident || ' (' || t.name || ')' as label,
           case t.type when 'fix' then 'FIX' else 'VOR' end as type_label, t.name as copy_value,
           case when t.type = 'fix' and n > 0 then t.name end as proc_text,
           coalesce(variants, 0) = 1 as has_variants
    from {oracle('proc_texts')} t left join v on v.ord = t.ord""",
)
def site_labels(spark, sf):
    return procedures.describe_sites(_procs(spark, sf), "popup").select(
        "ord", "label", "type_label", "copy_value", "proc_text", "has_variants"
    )


@query(
    "spoken_names",
    """select s_suppkey, 'AREA ' || (s_suppkey % 60) as ident, 'area' as spoken,
              upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) as title
       from supplier""",
)
def spoken_names(spark, sf):
    name = F.concat(F.lit("Area "), (F.col("s_suppkey") % 60).cast("string"), F.lit("  MOA"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", moa_ident(name).alias("ident"), moa_spoken(name).alias("spoken"),
        title_case(F.col("s_name")).alias("title"),
    )


# ---------------------------------------------------------------- gazetteer

# CSV lines with the columns the feeds have.
_NAVAID_LINES = """select p_partkey as seq, concat(substr(replace(p_name, ' ', ''), 1, 3), ',', p_name, ',',
    case p_size % 3 when 0 then 'VOR-DME' when 1 then 'Tacan' else 'NDB' end, ',',
    cast(p_partkey % 90 as varchar(3)), '.25x,', cast(p_partkey % 180 as varchar(3)), '.5,,,',
    case when p_size % 4 = 0 then 'SID:ABC 1D' else '' end) as line from {part}"""
_WAYPOINT_LINES = """select p_partkey as seq, concat('a,"b, c",', substr(replace(p_name, ' ', ''), 1, 5), ',',
    '"', cast(p_partkey % 90 as varchar(3)), ' 30 00.0 N",', cast(p_partkey % 180 as varchar(3)), ' 15 00.0 W,',
    case when p_size % 2 = 0 then 'STAR' else '' end) as line from {part}"""
_VFR_LINES = """select p_partkey as seq, concat('v', cast(p_partkey % 100 as varchar(3)), ',', p_name, ',,',
    case when p_size % 7 = 0 then 'none' else cast(p_partkey % 90 as varchar(3)) end, ',',
    cast(p_partkey % 180 as varchar(3))) as line from {part}"""


def _feed(spark, sf, sql: str, name: str):
    return _with_src(spark.sql(sql, part=table(spark, sf, "part")), name).select("src", "line")


@query(
    "gazetteer_union",
    f"""
    with recursive rec as (select * from {_RECORDS} r),
    exact as (select * from (select *, row_number() over (partition by ident, printf('%.4f', lat), printf('%.4f', lon) order by seq) as rn
                            from rec) e where rn = 1),
    numbered as (select *, row_number() over (partition by ident order by seq) as i from exact),
    fold as (
      select ident, cast(0 as bigint) as i, cast([] as struct(seq bigint, lat double, lon double)[]) as kept
      from (select distinct ident from numbered) d
      union all
      select f.ident, n.i,
             case when len(list_filter(f.kept, lambda k: abs(k.lat - n.lat) < case when n.type = 'fix' then 0.5e0 else 0.05e0 end
                         and abs(k.lon - n.lon) < case when n.type = 'fix' then 0.5e0 else 0.05e0 end)) > 0
                  then f.kept else list_append(f.kept, {{'seq': n.seq, 'lat': n.lat, 'lon': n.lon}}) end
      from fold f join numbered n on n.ident = f.ident and n.i = f.i + 1
    ),
    final as (select ident, kept from fold qualify row_number() over (partition by ident order by i desc) = 1),
    kept as (select u.k.seq as seq from final f, unnest(f.kept) as u(k)),
    alls as (
      select 1 as feed, r.seq, r.ident, r.lat, r.lon, r.type, cast(null as varchar) as name, 'records' as source, 0 as procs
      from rec r join kept k on k.seq = r.seq
      union all
      select 2, p_partkey, upper(substr(replace(p_name, ' ', ''), 1, 3)), p_partkey % 90 + 0.25e0, p_partkey % 180 + 0.5e0,
             case when p_size % 3 < 2 then 'vor' else 'ndb' end, upper(p_name), 'navaids', case when p_size % 4 = 0 then 1 else 0 end
      from part where p_partkey > 0
      union all
      select 3, p_partkey, upper(substr(replace(p_name, ' ', ''), 1, 5)), p_partkey % 90 + 0.5e0, -(p_partkey % 180 + 0.25e0),
             'fix', null, 'waypoints', case when p_size % 2 = 0 then 1 else 0 end
      from part where p_partkey > 0
      union all
      select 4, p_partkey, 'V' || (p_partkey % 100), p_partkey % 90, p_partkey % 180, 'vfr', upper(p_name), 'vfr', 0
      from part where p_partkey > 0 and p_size % 7 <> 0
    )
    select row_number() over (order by feed, seq) - 1 as ord, source, ident, type, name,
           round(lat, 6) as lat, round(lon, 6) as lon, cast(procs as bigint) as procs from alls
    """,
)
def gazetteer_union(spark, sf):
    fixes = gazetteer.build_gazetteer(
        record_lines(spark, sf),
        _feed(spark, sf, _NAVAID_LINES, "navaids"),
        _feed(spark, sf, _WAYPOINT_LINES, "waypoints"),
        _feed(spark, sf, _VFR_LINES, "vfr"),
    )
    return fixes.select(
        "ord", "source", "ident", "type", "name", r6("lat").alias("lat"), r6("lon").alias("lon"),
        F.coalesce(F.size("procs"), F.lit(0)).alias("procs"),
    )


@query(
    "proc_index",
    # Procedure records made from the order lines of each part name.
    """
    with l as (
      select l_orderkey * 10 + l_linenumber as seq, substr(replace(upper(p_name), ' ', ''), 1, 5) as ident,
             case when l_returnflag = 'R' then 'STAR' else 'SID' end as type,
             'K' || l_linestatus || 'AA' as airport,
             substr(replace(upper(p_name), ' ', ''), 1, 5) || ' ' || (l_linenumber % 4) as proc
      from lineitem join part on p_partkey = l_partkey),
    d as (select ident, type, airport, proc, min(seq) as seq from l group by all)
    select ident, string_agg(proc || '/' || type || '/' || airport, ';' order by seq, proc, type, airport) as procs, count(*) as n
    from d group by ident
    """,
)
def proc_index(spark, sf):
    # A line key may repeat with the same procedure text; the first one counts either way.
    lines = spark.sql(
        "select l_orderkey * 10 + l_linenumber as seq, concat('SUSAP K', l_linestatus, 'AA  ', "
        "case when l_returnflag = 'R' then 'E' else 'D' end, "
        "rpad(concat(substr(replace(upper(p_name), ' ', ''), 1, 5), cast(l_linenumber % 4 as string)), 16, ' '), "
        "substr(replace(upper(p_name), ' ', ''), 1, 5)) as line "
        "from {lineitem} join {part} on p_partkey = l_partkey",
        lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"),
    )
    idx = feeds.record_procs(_with_src(lines, "records"))
    text = F.array_join(
        F.transform("procs", lambda p: F.concat_ws("/", p["proc"], p["type"], p["airport"])), ";"
    )
    return idx.select("ident", text.alias("procs"), F.size("procs").alias("n"))
