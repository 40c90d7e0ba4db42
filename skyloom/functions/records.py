"""Field parsers for fixed-width navigation records and CSV feeds, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.text import SPACE, js_trim

# Coordinate block and ident shapes of the fixed-width format.
COORD_PATTERN = r"[NS]\d{8}[EW]\d{9}"
PADDED_IDENT = r"^\s*(?!RW)[A-Z]{2,5}\s*$"
FIVE_LETTER_IDENT = "^[A-Z]{5}$"
AIRPORT_PATTERN = "^[A-Z0-9]{3,4}$"

# Degrees, minutes, seconds, hemisphere in free text; commas outside quotes.
DMS_PATTERN = r"(?i)(\d+)[^\d]+(\d+)[^\d]+([\d.]+)[^\dNSWE]*([NSWE])"
QUOTED_COMMA = r',(?=(?:(?:[^"]*"){2})*[^"]*$)'

PROC_STRUCT = (
    "array<struct<proc:string,type:string,airport:string,csvProc:boolean,suffix:string>>"
)


def field(line: Column, start: int, end: int) -> Column:
    """Characters [start, end) counted from 0."""
    return F.substring(line, start + 1, end - start)


def arinc_lat(block: Column) -> Column:
    deg = field(block, 1, 3).try_cast("double")
    minute = field(block, 3, 5).try_cast("double")
    sec = field(block, 5, 9).try_cast("double") / 100
    value = deg + minute / 60 + sec / 3600
    return F.when(field(block, 0, 1) == "S", -value).otherwise(value)


def arinc_lon(block: Column) -> Column:
    deg = field(block, 10, 13).try_cast("double")
    minute = field(block, 13, 15).try_cast("double")
    sec = field(block, 15, 19).try_cast("double") / 100
    value = deg + minute / 60 + sec / 3600
    return F.when(field(block, 9, 10) == "W", -value).otherwise(value)


def line_type(line: Column) -> Column:
    """Site type by section letter; NULL for the dropped airway section."""
    sec = field(line, 4, 5)
    navaid = F.when(field(line, 27, 32).rlike("[VDT]"), "vor").otherwise("ndb")
    return (
        F.when(sec == "D", navaid)
        .when(sec == "U", F.lit(None).cast("string"))
        .when(sec.isin("P", "H"), "airport")
        .otherwise("fix")
    )


def proc_display_name(code: Column) -> Column:
    """`DIDLY5` -> `DIDLY 5`."""
    return F.regexp_replace(code, r"^([A-Z]+)(\d+)$", "$1 $2")


def parse_dms(text: Column) -> Column:
    """Degrees/minutes/seconds text to decimal degrees; NULL when it does not match."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, DMS_PATTERN, i)

    # Seconds may carry several dots; only the leading number counts.
    sec = F.regexp_extract(part(3), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60 + sec / 3600
    return F.when(F.upper(part(4)).isin("S", "W"), -value).otherwise(value)


def navaid_type(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("VOR")) | F.contains(raw, F.lit("TACAN")), "vor").otherwise(
        "ndb"
    )


def split_plain(line: Column) -> Column:
    return F.split(line, ",", -1)


def split_quoted(line: Column) -> Column:
    return F.split(line, QUOTED_COMMA, -1)


def _proc(name: Column, kind: Column, suffix: Column) -> Column:
    return F.struct(
        name.alias("proc"),
        kind.alias("type"),
        F.lit("").alias("airport"),
        F.lit(True).alias("csvProc"),
        suffix.alias("suffix"),
    )


def parse_procs(text: Column, ident: Column | None = None) -> Column:
    """`TYPE:NAME~SUFFIX|NAME;TYPE:...` -> array of procedures.

    With ``ident`` the legacy plain forms (`SID`, `STAR`, `SID/STAR`) name the procedure after
    it; without, a text lacking a colon gives NULL.
    """
    clean = js_trim(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("")))
    no_suffix = F.lit(None).cast("string")

    def section(sec: Column) -> Column:
        kind = js_trim(F.substring_index(sec, ":", 1))
        rest = F.substring(sec, F.instr(sec, ":") + 1, F.length(sec))
        names = F.filter(F.transform(F.split(rest, r"\|"), js_trim), lambda n: n != "")

        def one(n: Column) -> Column:
            tilde = F.instr(n, "~")
            return _proc(
                F.when(tilde > 0, F.substring(n, F.lit(1), tilde - 1)).otherwise(n),
                kind,
                F.when(tilde > 0, F.substring(n, tilde + 1, F.length(n))),
            )

        return F.transform(names, one)

    sections = F.filter(F.split(clean, ";"), lambda s: F.contains(s, F.lit(":")))
    structured = F.flatten(F.transform(sections, section)).cast(PROC_STRUCT)
    none = F.lit(None).cast(PROC_STRUCT)
    if ident is None:
        return F.when(F.contains(clean, F.lit(":")), structured).otherwise(none)
    legacy = F.filter(
        F.array(
            F.when(F.contains(clean, F.lit("SID")), _proc(ident, F.lit("SID"), no_suffix)),
            F.when(F.contains(clean, F.lit("STAR")), _proc(ident, F.lit("STAR"), no_suffix)),
        ),
        lambda p: p.isNotNull(),
    ).cast(PROC_STRUCT)
    return (
        F.when(clean == "", none)
        .when(F.contains(clean, F.lit(":")), structured)
        .otherwise(legacy)
    )


def squeeze(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"{SPACE}+", " "))
