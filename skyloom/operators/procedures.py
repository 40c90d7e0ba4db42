"""Departure and arrival procedures per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.procs import (
    copy_value,
    display_label,
    has_variants,
    proc_copy_text,
    proc_readback,
    proc_type_label,
    root_procs,
    type_label,
)

# Chart suffix and the tag shown for it.
CHART_TAGS = {("SID", "DEPARTURE"): "DEP", ("STAR", "ARRIVAL"): "ARR"}


def fix_procs(fixes: DataFrame) -> DataFrame:
    """Exploded form: one row per site and procedure."""
    return fixes.select("ord", "ident", F.posexplode("procs").alias("pos", "p")).select(
        "ord", "ident", "pos", "p.*"
    )


def procedure_catalogue(fixes: DataFrame) -> DataFrame:
    """Per site with root procedures: the plain ident, its departures, then its arrivals.

    ``item`` orders the entries of a site; ``text`` is what each entry offers for copying.
    """
    ident = F.col("ident")
    base = fixes.select(
        "ord", "ident", "name", "type", root_procs(ident, F.col("procs")).alias("roots")
    ).where(F.size("roots") > 0)
    kind = F.when(F.col("type") == "fix", proc_type_label(F.col("roots"), " / ")).otherwise(
        type_label(F.col("type"))
    )

    def entry(p):
        tag = F.when(F.lit(False), "")
        for (proc_type, suffix), label in CHART_TAGS.items():
            tag = tag.when((p["type"] == proc_type) & (p["suffix"] == suffix), label)
        return F.struct(
            p["type"].alias("proc_type"), p["proc"].alias("label"), tag.alias("tag"),
            proc_readback(p["proc"], p["suffix"]).alias("text"),
        )

    plain = F.struct(
        F.lit(None).cast("string").alias("proc_type"), ident.alias("label"),
        F.lit(None).cast("string").alias("tag"), ident.alias("text"),
    )
    roots = F.col("roots")
    entries = F.concat(
        F.array(plain),
        F.transform(F.filter(roots, lambda p: p["type"] == "SID"), entry),
        F.transform(F.filter(roots, lambda p: p["type"] == "STAR"), entry),
    )
    return base.select(
        "ord", "ident", "type", kind.alias("heading"), F.posexplode(entries).alias("item", "e")
    ).select("ord", "ident", "type", "heading", "item", "e.*")


def describe_sites(fixes: DataFrame, dialect: str = "popup") -> DataFrame:
    """Display columns per site: label, type label, copy value, procedure text, variants."""
    c = {n: F.col(n) for n in ("ident", "name", "type", "procs")}
    return fixes.select(
        "ord", "ident", "name", "type",
        display_label(c["ident"], c["name"], c["type"], c["procs"]).alias("label"),
        type_label(c["type"]).alias("type_label"),
        copy_value(c["ident"], c["name"], c["type"], c["procs"], dialect).alias("copy_value"),
        proc_copy_text(c["ident"], c["name"], c["type"], c["procs"], dialect).alias("proc_text"),
        has_variants(c["ident"], c["procs"]).alias("has_variants"),
    )
