"""SQL fragments for the brute-force checks: every check scores or measures all pairs."""

from __future__ import annotations

# Fixed values, stated here once more by hand so that a wrong one in the engine shows.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SOUND_GROUPS = [
    "EI", "AE", "OU", "BP", "DT", "GKC", "FV", "SZC", "MN", "LR", "JY", "XKS",
]
PHONETIC_REWRITES = [
    ("PH", "F"), ("CK", "K"), ("Q", "K"), ("X", "KS"), ("Z", "S"), ("DG", "J"),
    ("GH", "G"), ("KN", "N"), ("WR", "R"), ("EE", "I"), ("EA", "I"), ("IE", "I"),
    ("EY", "I"), ("AY", "I"), ("OO", "U"), ("OU", "U"), ("ISN", "SN"), ("YSN", "SN"),
    ("Y", "I"),
]
SKELETON_REWRITES = [("PH", "F"), ("CK", "K"), ("Q", "K"), ("Z", "S")]
RAW_EDIT = [300, 200, 120, 60]


def _rewrite(x: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _collapse(x: str) -> str:
    # The checking database's regular expressions have no back-references.
    for ch in ALPHABET:
        x = f"regexp_replace({x}, '{ch}+', '{ch}', 'g')"
    return x


def letters(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"


def text_keys(source: str, dialect: str = "worker") -> str:
    """Query giving (raw, ph, sk) for every ``text`` of a subquery."""
    squeeze = _collapse if dialect == "worker" else (lambda x: x)
    return f"""(
      select text, raw, substr(p, 1, 1) || regexp_replace(substr(p, 2), '[AEIOU]', '', 'g') as ph, sk
      from (
        select text, raw, {squeeze('p0')} as p, {squeeze('s0')} as sk
        from (
          select text, upper(text) as raw, {_rewrite(letters('text'), PHONETIC_REWRITES)} as p0,
                 {_rewrite(f"regexp_replace({letters('text')}, '[AEIOU]', '', 'g')", SKELETON_REWRITES)} as s0
          from {source}
        ) k0
      ) k1
    )"""


def _char_sim(a: str, b: str) -> str:
    groups = " or ".join(f"(contains('{g}', {a}) and contains('{g}', {b}))" for g in SOUND_GROUPS)
    return f"case when {a} = {b} then 1e0 when {groups} then 0.6e0 else 0e0 end"


def similarity(t: str, q: str) -> str:
    a, b = f"substr({t}, i, 1)", f"substr({q}, i, 1)"
    short, long_ = f"least(length({t}), length({q}))", f"greatest(length({t}), length({q}))"
    total = (
        f"list_reduce(list_transform(range(1, {short} + 1), lambda i: {_char_sim(a, b)}), "
        "lambda x, y: x + y)"
    )
    return (
        f"floor({total} / {long_} * 1e2 * (1e0 - cast({long_} - {short} as double) / {long_}) + 0.5e0)"
    )


def _lev(a: str, b: str) -> str:
    return (
        f"case when length({a}) = 0 or length({b}) = 0 then greatest(length({a}), length({b})) "
        f"else levenshtein({a}, {b}) end"
    )


def score(t: str, q: str) -> str:
    """Composite score of two key rows (aliases with raw, ph, sk)."""
    raw = _lev(f"{t}.raw", f"{q}.raw")
    ph = _lev(f"{t}.ph", f"{q}.ph")
    edits = " ".join(f"when {i} then {v}" for i, v in enumerate(RAW_EDIT))
    return f"""case when {t}.raw is null or {q}.raw is null or {t}.raw = '' or {q}.raw = '' then 0 else
      cast({similarity(f'{t}.raw', f'{q}.raw')} as bigint) * 3
      + case when {t}.ph = {q}.ph then 200 else 0 end
      + case when {t}.sk = {q}.sk and length({t}.sk) >= 2 then 180 else 0 end
      + case when contains({t}.ph, {q}.ph) or contains({q}.ph, {t}.ph) then 120 else 0 end
      + case when contains({t}.sk, {q}.sk) or contains({q}.sk, {t}.sk) then 80 else 0 end
      + case when {t}.raw = {q}.raw then 100 else 0 end
      + case when starts_with({t}.raw, {q}.raw) then 80 else 0 end
      + case when contains({t}.raw, {q}.raw) then 50 else 0 end
      + case when regexp_matches({t}.raw, regexp_replace({q}.raw, '(.)', '\\1.*', 'g')) then 40 else 0 end
      + greatest(0, 40 - 6 * {ph})
      + case {raw} {edits} else 0 end
    end"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(sin(({lat2} - {lat1}) * pi() / 18e1 / 2) * sin(({lat2} - {lat1}) * pi() / 18e1 / 2)"
        f" + cos({lat1} * pi() / 18e1) * cos({lat2} * pi() / 18e1)"
        f" * sin(({lon2} - {lon1}) * pi() / 18e1 / 2) * sin(({lon2} - {lon1}) * pi() / 18e1 / 2))"
    )
    return f"(6880.13e0 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def segment_t(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> str:
    len2 = f"(({b_lat}-{a_lat})*({b_lat}-{a_lat}) + ({b_lon}-{a_lon})*({b_lon}-{a_lon}))"
    dot = f"(({p_lat}-{a_lat})*({b_lat}-{a_lat}) + ({p_lon}-{a_lon})*({b_lon}-{a_lon}))"
    return f"case when {len2} = 0 then 0e0 else greatest(0e0, least(1e0, {dot} / {len2})) end"


def in_box(lat: str, lon: str, b: str) -> str:
    return (
        f"{lat} between {b}.min_lat and {b}.max_lat and {lon} between {b}.min_lon and {b}.max_lon"
    )


def clean_points(positions: str) -> str:
    """Cleaned track points: aircraft, idx, ts, ord, lat, lon, alt, gs."""
    return f"""(
      select aircraft, row_number() over (partition by aircraft order by ts, ord) - 1 as idx,
             ts, ord, lat, lon, alt, gs
      from (
        select *, row_number() over (
                    partition by aircraft, printf('%.5f', lon), printf('%.5f', lat)
                    order by ts, ord) as rn,
               0 as z
        from {positions} p
      ) d
      where rn = 1
      qualify count(*) over (partition by aircraft) > 1
    )"""


def segments(points: str) -> str:
    return f"""(
      select * from (
        select aircraft, idx as seg, lat as a_lat, lon as a_lon,
               lead(lat) over (partition by aircraft order by idx) as b_lat,
               lead(lon) over (partition by aircraft order by idx) as b_lon
        from {points} pts
      ) s where b_lat is not null
    )"""


def legs(polls: str) -> str:
    """Polls with a callsign folded in order: aircraft, ts, ord, callsign, new_leg, by the state of the last leg start."""
    return f"""(
      with recursive n as (
        select *, floor(epoch_ms(ts) / 9e5) as bucket, row_number() over (partition by aircraft order by ts, ord) as i
        from {polls} p where callsign <> ''
      ),
      fold(aircraft, i, new_leg, call, lat, lon, held) as (
        select aircraft, i, true, callsign, start_lat, start_lon, bucket from n where i = 1
        union all
        select aircraft, i, fresh, case when fresh then callsign else call end, case when fresh then start_lat else lat end,
               case when fresh then start_lon else lon end, case when fresh then bucket else held end
        from (
          select n.*, f.call, f.lat, f.lon, f.held,
                 f.call <> n.callsign or f.held <> n.bucket or (n.start_lat - f.lat) * (n.start_lat - f.lat)
                   + (n.start_lon - f.lon) * (n.start_lon - f.lon) > 0.0001e0 as fresh
          from fold f join n on n.aircraft = f.aircraft and n.i = f.i + 1
        ) s
      )
      select n.aircraft, n.ts, n.ord, n.callsign, f.new_leg from n join fold f on f.aircraft = n.aircraft and f.i = n.i
    )"""


def by_flight(positions: str, idle_us: int) -> str:
    """Positions with the flight, the first moment after a silence, joined to the aircraft by an @."""
    return f"""(
      select * replace (aircraft || '@' || max(begins) over (partition by aircraft order by ts, ord rows unbounded preceding) as aircraft)
      from (
        select *, case when coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by aircraft order by ts, ord) > {idle_us}, true)
                       then epoch_us(ts) end as begins
        from {positions} p
      ) g
    )"""
