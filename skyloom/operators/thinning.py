"""Order-dependent thinning: keep a row unless an earlier kept row crowds it out.

Two uses: dropping near copies of a site name, and thinning sites for a map zoom. The result
depends on the order of the rows, so a self-join cannot express it. Rows that can interact are
folded in order, in one pass over sorted rows. What is too large for one task is cut into
connected components of cells; components still too large are settled in prefixes of their order:
a prefix is folded, what it crowds out is dropped by a join, and the rest falls into smaller
components. A long chain of neighbours is one fold, not one round for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.geo import mercator_px
from skyloom.functions.text import to_fixed
from skyloom.operators.components import components
from skyloom.operators.ranking import take_first, top_k
from skyloom.session import cut_lineage

#: Rows that one task folds: some 20 MB, half a second.
FOLD_LIMIT = 100_000

# Same-name distances in degrees (fixes, all others).
FIX_DEG, OTHER_DEG = 0.5, 0.05

# One site per 2-pixel spot, same names 40 pixels apart.
SPOT_PX, CROWD_PX = 2, 40

CELL, BOX, CIRCLE = "cell", "box", "circle"


@dataclass(frozen=True)
class Crowding:
    """One way an earlier kept row can crowd out a later one.

    ``keys`` must be equal and not null. ``shape`` says what is too close: the same cell of ``size``,
    less than ``size`` on both axes, or less than ``size`` in a straight line. ``applies`` restricts
    the rule to some later rows.
    """

    keys: Sequence[str]
    x: str
    y: str
    size: float
    shape: str
    applies: Column | None = None

    @property
    def reach(self) -> int:
        return 0 if self.shape == CELL else 1

    def key(self) -> Column:
        """One text for all keys; null if one is."""
        return F.concat(F.lit(""), *[F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in self.keys])

    def cell(self) -> Column:
        return F.struct(
            self.key().alias("key"),
            F.floor(F.col(self.x) / self.size).alias("cx"),
            F.floor(F.col(self.y) / self.size).alias("cy"),
        )

    def around(self, cell: Column) -> Column:
        steps = range(-self.reach, self.reach + 1)
        return F.array(
            *[
                F.struct(cell["key"].alias("key"), (cell["cx"] + i).alias("cx"), (cell["cy"] + j).alias("cy"))
                for i in steps
                for j in steps
            ]
        )

    def relevant(self) -> Column:
        return F.lit(True) if self.applies is None else F.coalesce(self.applies, F.lit(False))

    def hits(self, a: Column, b: Column) -> Column:
        """Whether two rows of surrounding cells are too close."""
        dx, dy = a[self.x] - b[self.x], a[self.y] - b[self.y]
        if self.shape == CIRCLE:
            return dx * dx + dy * dy < float(self.size * self.size)
        if self.shape == BOX:
            return (F.abs(dx) < self.size) & (F.abs(dy) < self.size)
        return F.lit(True)

    def close(self, dx: float, dy: float) -> bool:
        """The same for a task's own rows."""
        if self.shape == CIRCLE:
            return dx * dx + dy * dy < self.size * self.size
        return self.shape == CELL or (abs(dx) < self.size and abs(dy) < self.size)


class _Kept:
    """Kept rows of one group by the cells of each rule."""

    def __init__(self, rules: Sequence[Crowding]):
        self.rules = rules
        self.cells: list[dict] = [{} for _ in rules]

    def take(self, places: list[tuple]) -> bool:
        """Keeps a row, one (applies, key, x, y) for each rule, unless a kept one crowds it out."""
        found = []
        for rule, cells, (applies, key, x, y) in zip(self.rules, self.cells, places, strict=True):
            if key is None or x is None or y is None or math.isnan(x) or math.isnan(y):
                found.append(None)
                continue
            cx, cy = math.floor(x / rule.size), math.floor(y / rule.size)
            found.append((key, cx, cy, x, y))
            if not applies:
                continue
            for i in range(-rule.reach, rule.reach + 1):
                for j in range(-rule.reach, rule.reach + 1):
                    for a, b in cells.get((key, cx + i, cy + j), ()):
                        if rule.close(a - x, b - y):
                            return False
        for cells, at in zip(self.cells, found, strict=True):
            if at:
                cells.setdefault(at[:3], []).append(at[3:])
        return True


def _fold(rows: DataFrame, group: Column, rules: Sequence[Crowding]) -> DataFrame:
    """(ord) of the rows that stay when each group is folded in order, as its rows pass by."""
    slim = {"__g": group, "ord": F.col("ord")}
    for i, rule in enumerate(rules):
        slim |= {f"on{i}": rule.relevant(), f"key{i}": rule.key()}
        slim |= {f"x{i}": F.col(rule.x).cast("double"), f"y{i}": F.col(rule.y).cast("double")}
    kind = rows.schema["ord"].dataType.simpleString()
    names = [[f"{n}{i}" for n in ("on", "key", "x", "y")] for i in range(len(rules))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), None
        for part in parts:
            keep = []
            places = [list(zip(*[part[n].tolist() for n in of], strict=True)) for of in names]
            for g, *at in zip(part["__g"].tolist(), *places, strict=True):
                if g != now:
                    now, kept = g, _Kept(rules_of_task)
                keep.append(kept.take(at))
            yield part.loc[keep, ["ord"]]

    # Columns stay on the driver.
    rules_of_task = [Crowding(r.keys, r.x, r.y, r.size, r.shape) for r in rules]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*[c.alias(n) for n, c in slim.items()]).repartition(tasks, "__g")
    return dealt.sortWithinPartitions("__g", "ord").mapInPandas(run, f"ord {kind}")


def _without_crowded(
    rows: DataFrame, settled: DataFrame, rules: Sequence[Crowding]
) -> DataFrame:
    """Open rows not crowded by a newly kept row.

    Kept rows keep their distance from each other, so a cell's surroundings hold a bounded
    number of them and they travel as one array per cell.
    """
    out = rows
    for rule in rules:
        near = (
            settled.withColumn("k", F.struct(*[F.col(c) for c in settled.columns]))
            .select(F.explode(rule.around(rule.cell())).alias("__c"), "k")
            .groupBy("__c")
            .agg(F.collect_list("k").alias("__near"))
        )
        me = F.struct(*[F.col(c) for c in rows.columns])
        hit = F.exists(
            F.col("__near"), lambda k: (k["ord"] < F.col("ord")) & rule.hits(k, F.col("__me"))
        )
        out = (
            out.withColumn("__c", rule.cell())
            .withColumn("__me", me)
            .join(near, "__c", "left")
            .where(~(rule.relevant() & F.coalesce(hit, F.lit(False))))
            .drop("__c", "__me", "__near")
        )
    return out


def _with_component(rows: DataFrame, rules: Sequence[Crowding]) -> DataFrame:
    """Rows with the component that their cells belong to: rows of two components never interact.

    Cells are linked when they touch, and when a row lies in both; a row's first cell names its
    component.
    """
    def node(i: int, cell: Column) -> Column:
        return F.xxhash64(F.lit(i), cell)

    cells = rows.select(*[rule.cell().alias(f"c{i}") for i, rule in enumerate(rules)]).distinct()
    cells = cut_lineage(cells)
    links = [
        cells.select(node(0, F.col("c0")).alias("a"), node(i, F.col(f"c{i}")).alias("b")).distinct()
        for i in range(len(rules))
    ]
    for i, rule in enumerate(rules):
        if rule.reach:
            own = cells.select(F.col(f"c{i}").alias("c")).distinct()
            spread = own.select("c", F.explode(rule.around(F.col("c"))).alias("d"))
            met = spread.join(own.select(F.col("c").alias("d")), "d").where("c < d")
            links.append(met.select(node(i, F.col("c")).alias("a"), node(i, F.col("d")).alias("b")))
    found = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("__n"), F.col("root").alias("__g"))
    return rows.withColumn("__n", node(0, rules[0].cell())).join(found, "__n").drop("__n")


def _settle(rows: DataFrame, rules: Sequence[Crowding], fold_limit: int) -> DataFrame:
    """(ord) of the rows that stay among rows of any number."""
    kept, open_rows = [], cut_lineage(rows)
    while True:
        named = cut_lineage(_with_component(open_rows, rules))
        large = named.groupBy("__g").count().where(F.col("count") > fold_limit).select("__g")
        large = cut_lineage(large)
        small = named.join(large, "__g", "left_anti")
        kept.append(cut_lineage(_fold(small, F.col("__g"), rules)))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        rest = named.join(large, "__g", "left_semi")
        prefix = cut_lineage(top_k(rest, ["__g"], ["ord"], fold_limit))
        settled = cut_lineage(_fold(prefix, F.col("__g"), rules))
        kept.append(settled)
        rest = rest.join(prefix.select("ord"), "ord", "left_anti").drop("__g")
        crowding = prefix.join(settled, "ord", "left_semi").drop("__g")
        open_rows = cut_lineage(_without_crowded(rest, crowding, rules))


def thin(
    rows: DataFrame,
    group: Sequence[str],
    rules: Sequence[Crowding],
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """(ord) of the rows that survive in-order thinning; ``group`` holds everything that can interact.

    ``rows`` needs a unique ``ord``. Groups of up to ``fold_limit`` rows are folded as they are.
    """
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    big = counted.where(F.col("n") > fold_limit)
    whole = F.xxhash64(*group) if group else F.lit(0)
    if big.isEmpty():
        return _fold(rows, whole, rules)
    if not group:
        return _settle(rows, rules, fold_limit)
    big = cut_lineage(big.select(*group))
    small = _fold(rows.join(big, list(group), "left_anti"), whole, rules)
    return small.unionByName(_settle(rows.join(big, list(group), "left_semi"), rules, fold_limit))


def proximity_dedup(sites: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Drop sites repeated under one ident.

    First exact copies (four decimals), then any site within 0.5 degrees (fixes) or 0.05 degrees
    (all others) of an earlier kept site of the same ident, on both axes. The type of the later
    row decides the distance.
    """
    exact = take_first(
        sites, ["ident", to_fixed(F.col("lat"), 4), to_fixed(F.col("lon"), 4)], ["ord"]
    )
    is_fix = F.coalesce(F.col("type") == "fix", F.lit(False))
    rules = [
        Crowding(["ident"], "lat", "lon", FIX_DEG, BOX, is_fix),
        Crowding(["ident"], "lat", "lon", OTHER_DEG, BOX, ~is_fix),
    ]
    # The fold only needs the columns the rules read; the rest is joined back.
    slim = exact.select("ord", "ident", "type", "lat", "lon")
    return exact.join(thin(slim, ["ident"], rules, fold_limit), "ord", "left_semi")


def thin_for_zoom(sites: DataFrame, zoom: float, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Sites drawn at a zoom level, with their pixels.

    In source order, a site is skipped when its 2-pixel spot is taken or when a drawn site of
    the same ident is closer than 40 pixels. The whole canvas is thinned at once.
    """
    x, y = mercator_px(F.col("lat"), F.col("lon"), zoom)
    placed = sites.select("ord", "ident", "type", "lat", "lon", x.alias("px"), y.alias("py")).withColumns(
        {f"spot_{a}": F.floor(F.col(f"p{a}") / SPOT_PX + 0.5) for a in "xy"}
    )
    rules = [
        Crowding([], "spot_x", "spot_y", 1, CELL),
        Crowding(["ident"], "px", "py", CROWD_PX, CIRCLE),
    ]
    return placed.join(thin(placed, [], rules, fold_limit), "ord", "left_semi")
