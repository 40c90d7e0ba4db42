"""A Merkle manifest of a dataset: leaf digests, a tree for each group of rows, one root, proofs and their check."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import written

#: A step of a path: the sibling's side and digest, or that there is none.
LEFT, RIGHT, ALONE = "l", "r", "-"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as the leaf holds it: its UTF-8 bytes counted, then itself; a null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def local_levels(nodes: list[str], steps: int | None) -> list[list[str]]:
    """The levels above consecutive nodes: steps of them, or until one node remains.

    Every two consecutive nodes become their digest; so does a lone last one.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 if steps is None else len(levels) <= steps:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def local_path(levels: list[list[str]], place: int) -> list[str]:
    """From a node of the lowest level to the top one: its sibling at each step, with its side."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append(ALONE if other >= len(level) else (LEFT if other < place else RIGHT) + level[other])
        place >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its path lead to."""
    for step in path:
        if step == ALONE:
            node = digest(node)
        else:
            node = digest(step[1:], node) if step[0] == LEFT else digest(node, step[1:])
    return node


def proof_digest(path: list[str]) -> str:
    return digest(*[step[1:] for step in path])


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx, their place within their tree, gapless from 0, and size, the rows of the tree.

    Rows are dealt out by ranges of (tree, order) and sorted in their task; only the count of each tree in
    each task crosses tasks, so a tree of any size is numbered by many.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lie = written(
        rows.repartitionByRange(tasks, tree, *order)
        .sortWithinPartitions(tree, *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id()),
        "sorted",
    )
    spans = lie.groupBy("part", tree).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    whole = Window.partitionBy(tree)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(
        "part",
        tree,
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    return (
        lie.join(written(spans, "spans"), ["part", tree])
        .withColumn("idx", F.col("seq") + F.col("shift"))
        .drop("part", "seq", "shift")
    )


def _steps(size: int, bits: int) -> int | None:
    return bits if size > 1 << bits else None


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables of nodes (tree, idx, size, digest), each made of the superblocks' roots of the one before.

    A superblock is 2**bits nodes, so each table is smaller by that factor. The last has one node a tree.
    """

    def reduced(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        tree, size, idx = part["tree"].iloc[0], int(part["size"].iloc[0]), int(part["idx"].iloc[0])
        top = local_levels(part["digest"].tolist(), _steps(size, bits))[-1][0]
        return pd.DataFrame([(tree, idx >> bits, -(-size >> bits), top)], columns=["tree", "idx", "size", "digest"])

    levels = [nodes]
    while (levels[-1].agg(F.max("size")).first()[0] or 0) > 1:
        below = levels[-1].select("tree", "idx", "size", "digest", _block(bits))
        up = below.groupBy("tree", "block").applyInPandas(reduced, "tree string, idx bigint, size bigint, digest string")
        levels.append(written(up, "subroots"))
    return levels


def exchange(nodes: DataFrame, outer: DataFrame, bits: int, finish: Callable, schema: str) -> DataFrame:
    """Cogroups every superblock's nodes with the one outer row (tree, idx, path, subroot, root) of its own root.

    finish(nodes, levels, outer path, outer row) makes the superblock's rows: with the local levels and the path
    above them it has all that proofs and folds need.
    """

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx").reset_index(drop=True)
        row = above.iloc[0]
        levels = local_levels(part["digest"].tolist(), _steps(int(part["size"].iloc[0]), bits))
        return finish(part, levels, row["path"].split(",") if row["path"] else [], row)

    left = nodes.withColumn("block", _block(bits)).groupBy("tree", "block")
    right = outer.withColumnRenamed("idx", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(run, schema)


OUTER = "tree string, idx bigint, path string, subroot string, root string"


def _paths(part: pd.DataFrame, levels: list[list[str]], path: list[str], row: pd.Series) -> pd.DataFrame:
    """Outer rows of a superblock's nodes."""
    return pd.DataFrame(
        {
            "tree": part["tree"],
            "idx": part["idx"],
            "path": [",".join(local_path(levels, i) + path) for i in range(len(part))],
            "subroot": row["subroot"],
            "root": row["root"],
        }
    )


def descend(levels: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """The outer rows of the superblocks of levels[0], from those of the trees' roots down."""
    outer = tops
    for nodes in reversed(levels[1:-1]):
        outer = written(exchange(nodes, outer, bits, _paths, OUTER), "outer")
    return outer


def _manifest(part: pd.DataFrame, levels: list[list[str]], path: list[str], row: pd.Series) -> pd.DataFrame:
    leaves = part["digest"].tolist()
    paths = [local_path(levels, i) + path for i in range(len(leaves))]
    claimed = [t if t is not None else d for t, d in zip(part["tampered"], leaves, strict=True)]
    folded = [fold(leaf, p) for leaf, p in zip(claimed, paths, strict=True)]
    return pd.DataFrame(
        {
            "doc_id": part["doc_id"],
            "leaf": leaves,
            "subroot": row["subroot"],
            "root": row["root"],
            "proof_sha256": [proof_digest(p) for p in paths],
            "folded_root": folded,
            "verified": [f == row["root"] for f in folded],
        }
    )


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    tampered_fields: dict[str, Column] | None = None,
    bits: int = 12,
) -> DataFrame:
    """One row per input row: its id and leaf, its group's root, the root of all, a digest of its proof, its check.

    The check folds the leaf with its proof (tampered_fields in place of its own values, where given) and
    compares with the root.

    Rows of a group, in the order of their ids, are the leaves of a tree; the groups' roots, in the order of the
    groups, those of the tree above. Superblocks of 2**bits consecutive leaves are reduced on their own; only
    their roots move up, in as many rounds as the trees are superblocks high, and only the paths above
    superblocks come down. The last exchange cogroups leaves with the path above their superblock and does the
    local reduction, the proofs and the folds in one task, which holds 2**bits digests. A group with a third
    of all rows is many superblocks.

    Nulls: a null field is a dash; a null group is a group of its own, the first; null ids come first. Rows of
    equal group and id lie in the order of their leaves; repeated rows are leaves of their own. An
    empty table gives no rows. An empty text is hashed as one, a text of any length in one row's expression.
    Columns that are not named are not read.
    """
    changed = {**{c: F.col(c) for c in fields}, **(tampered_fields or {})}
    leaf, claimed = leaf_digest(*[F.col(c) for c in fields]), leaf_digest(*changed.values())
    group = F.col(group_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string"))).alias("tree"),
            leaf.alias("digest"),
            (claimed if tampered_fields else F.lit(None).cast("string")).alias("claimed"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("tampered", F.when(F.col("claimed") != F.col("digest"), F.col("claimed"))).drop("claimed"),
        "leaves",
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    leaves = numbered(rows, "tree", ["doc_id", "digest", "row"])
    # As text: pandas would turn integers among nulls into floats.
    leaves = written(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), "numbered")
    levels = climb(leaves, bits)

    groups = levels[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    groups = numbered(groups, "all", ["name"]).withColumnRenamed("all", "tree")
    groups = written(groups, "groups")
    above = climb(groups, bits)
    top = above[-1].select(
        "tree", F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )

    def of_groups(part: pd.DataFrame, inside: list[list[str]], path: list[str], row: pd.Series) -> pd.DataFrame:
        found = _paths(part, inside, path, row)
        return found.assign(tree=part["name"], idx=0, subroot=part["digest"])

    tops = written(exchange(groups, descend(above, top, bits), bits, of_groups, OUTER), "tops")
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = exchange(leaves, descend(levels, tops, bits), bits, _manifest, out)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def tampering(id_col: str = "doc_id", count_col: str = "n_chars", one_in: int = 7) -> dict[str, Column]:
    """One is added to the count of rows whose id's CRC-32 one_in divides; nulls stay."""
    hit = F.crc32(F.col(id_col).cast("string")) % one_in == 0
    return {count_col: F.when(hit, F.col(count_col) + 1).otherwise(F.col(count_col))}
