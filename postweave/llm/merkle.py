"""Merkle manifest of a dataset, with a proof for every row, built by a butterfly exchange.

Leaves. A row's leaf is the SHA-256 of its columns, each with its length. Rows are put in order within
their group by one range shuffle; a row's position comes from its place in the sorted partition and
the counts of the partitions before, so a group may span any number of partitions.

Blocks. A block holds ``fanout ** block_levels`` consecutive leaves of a group, so whole subtrees lie in one
block. A task reduces its block to the subtree's root.

Exchange. In round r the blocks of ``fanout`` neighbouring subtrees swap their roots: a block sends its
own to the block of the same place in each other subtree, and every block hashes the common ancestor
itself. What it receives are the siblings of its path, so after the last round each block holds its
whole upper proof; nothing is sent down again. If the last subtree of a group has fewer blocks than its
neighbours, each of its blocks serves several places. The roots of the groups form a tree of their own, by the same steps.

Proof. A text with one part for each level from the leaf up, parts separated by ``;``. A part lists the nodes of
the run from left to right, separated by ``,``, the row's own ancestor as ``*``. ``fold`` recomputes the root.

Defined cases: null and empty values have different leaves; a null group is a group of its own and
comes first, a null key comes first in its group. Rows with equal keys are ordered by leaf; repeated rows are leaves
of their own, and which of them has which proof does not matter, as their leaves are equal. Texts are hashed
whole. An empty table gives no rows; a single row is its own root and has an empty proof. Extra columns, whatever their
names, are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.common import broadcast_by_size, stored

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 3
#: A block has FANOUT ** BLOCK_LEVELS leaves, 2187.
BLOCK_LEVELS = 7
ROWS_PER_PART = 500_000
BROADCAST_BYTES = 48 << 20
SALTS = 16
SELF = "*"


def leaf_of(values: list[Column]) -> Column:
    """The leaf of a row: for each value ``-`` if it is null, else its UTF-8 length, a colon and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    levels = F.when(proof == "", F.array().cast("array<string>")).otherwise(F.split(proof, ";"))
    return F.aggregate(levels, leaf, lambda node, level: F.sha2(
        F.replace(F.replace(level, F.lit(","), F.lit("")), F.lit(SELF), node), 256))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level and from left to right."""
    return F.sha2(F.translate(proof, f"{SELF},;", ""), 256)


def _positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds _pos, the dense place within _tree by the order's columns, and _size, the tree's number of rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PART))
    # The tie splits rows that agree in the whole order between partitions.
    keys = ["_tree", *order, "_tie"]
    ordered = (rows.withColumn("_tie", F.monotonically_increasing_id())
               .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie"))
    # In a sorted partition this id is the partition's number, shifted, plus the place.
    placed = stored(ordered.withColumn("_seq", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_seq", 33))
    tree = Window.partitionBy("_tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = placed.groupBy("_tree", "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    spans = stored(spans.select("_tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                                F.sum("_n").over(tree).alias("_size")), f"{name}-spans")
    return placed.join(broadcast_by_size(spans, BROADCAST_BYTES), ["_tree", "_part"]).withColumn(
        "_pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift")


def _above(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i:i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _levels(leaves: list[str], whole: bool, fanout: int, height: int) -> list[list[str]]:
    """A block's nodes, level by level: up to its root; ``height`` levels unless it is the whole tree."""
    levels = [leaves]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        levels.append(_above(levels[-1], fanout))
    return levels


def _block_roots(placed: DataFrame, fanout: int, height: int) -> DataFrame:
    """(_tree, _block, _blocks, _value): the root of each block's subtree."""
    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        whole = rows["_blocks"][0].as_py() == 1
        top = _levels(rows["_value"].to_pylist(), whole, fanout, height)[-1][0]
        return rows.select(["_tree", "_block", "_blocks"]).slice(0, 1).append_column("_value", pa.array([top]))

    slim = placed.select("_tree", "_block", "_blocks", "_pos", "_value")
    return slim.groupBy("_tree", "_block").applyInArrow(reduce, "_tree string, _block long, _blocks long, _value string")


def _exchange(blocks: DataFrame, fanout: int, name: str) -> DataFrame:
    """Butterfly rounds: (_tree, _block, _proof, _value), the value now being the tree's root."""
    state = stored(blocks.withColumn("_proof", F.lit("")), f"{name}-round0")
    most, span, turn = state.agg(F.max("_blocks")).first()[0] or 0, 1, 0
    while span < most:
        width = F.lit(span)
        subtree = F.floor(F.col("_block") / width)
        first = F.floor(subtree / fanout) * fanout
        own = F.least(width, F.col("_blocks") - subtree * width)
        lane = F.col("_block") - subtree * width

        def to(place: int, first=first, own=own, lane=lane, width=width) -> Column:
            """The blocks of the group's subtree at this place that hear from this block."""
            start = (first + place) * width
            last = F.least(width, F.col("_blocks") - start) - 1
            return F.when(last >= lane, F.transform(F.sequence(lane, last, own), lambda x: x + start))

        active = F.col("_blocks") > width
        heard = F.flatten(F.array_compact(F.array(*[to(p) for p in range(fanout)])))
        sent = state.select(
            "_tree", "_blocks", "_value", "_proof", F.col("_block").alias("_from"), (subtree - first).cast("int").alias("_place"),
            F.explode(F.when(active, heard).otherwise(F.array("_block"))).alias("_block"))
        mine = F.col("_from") == F.col("_block")
        got = sent.groupBy("_tree", "_block").agg(
            F.max("_blocks").alias("_blocks"), F.max(F.when(mine, F.col("_proof"))).alias("_proof"),
            F.max(F.when(mine, F.col("_place"))).alias("_place"),
            F.array_sort(F.collect_list(F.struct("_place", "_value"))).alias("_run"))  # at most ``fanout`` entries
        level = F.array_join(F.transform("_run", lambda n: F.when(
            n["_place"] == F.col("_place"), SELF).otherwise(n["_value"])), ",")
        grown = F.when(F.col("_proof") == "", level).otherwise(F.concat("_proof", F.lit(";"), level))
        above = F.sha2(F.array_join(F.transform("_run", lambda n: n["_value"]), ""), 256)
        turn += 1
        state = stored(got.select(
            "_tree", "_block", "_blocks", F.when(active, above).otherwise(F.col("_run")[0]["_value"]).alias("_value"),
            F.when(active, grown).otherwise(F.col("_proof")).alias("_proof")), f"{name}-round{turn}")
        span *= fanout
    return state.select("_tree", "_block", "_proof", "_value")


def _paths(rows: DataFrame, order: list[str], name: str, fanout: int, height: int, grouped: bool) -> DataFrame:
    """Rows of (_tree, _value, ...) with _proof, _subroot and _root. ``grouped``: the trees' roots form a tree."""
    size = fanout ** height
    placed = _positions(rows, order, name)
    placed = placed.withColumn("_block", F.floor(F.col("_pos") / size)).withColumn(
        "_blocks", F.ceil(F.col("_size") / size))
    upper = _exchange(_block_roots(placed, fanout, height), fanout, name)
    if grouped:
        tops = upper.filter("_block = 0").select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_value")
        over = _paths(tops, ["_name"], f"{name}-groups", fanout, height, False)
        over = stored(over.select(F.col("_name").alias("_tree"), F.col("_proof").alias("_over"), "_root"), f"{name}-over")
        # One group may own a third of the blocks: join salted copies of its one row.
        copies = over.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        upper = upper.withColumn("_salt", F.pmod("_block", F.lit(SALTS)).cast("int")).join(
            broadcast_by_size(copies, BROADCAST_BYTES), ["_tree", "_salt"])
        whole = F.concat_ws(";", *[F.when(F.col(c) != "", F.col(c)) for c in ["_proof", "_over"]])
        upper = upper.select("_tree", "_block", whole.alias("_proof"), F.col("_value").alias("_subroot"), "_root")
    else:
        upper = upper.select("_tree", "_block", "_proof", F.col("_value").alias("_subroot"), F.col("_value").alias("_root"))
    inner = {"_pos", "_size", "_block", "_blocks"}
    names = [c for c in placed.columns if c not in inner]
    kinds = dict(placed.dtypes)

    def prove(leaves: pa.Table, path: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("_pos")
        levels = _levels(leaves["_value"].to_pylist(), leaves["_blocks"][0].as_py() == 1, fanout, height)[:-1]
        parts = [[",".join(SELF if j == i else nodes[j] for j in range(i - i % fanout, min(i - i % fanout + fanout, len(nodes))))
                  for i in range(len(nodes))] for nodes in levels]
        rest = [path["_proof"][0].as_py()] if path["_proof"][0].as_py() else []
        proofs = [";".join([part[i // fanout ** h] for h, part in enumerate(parts)] + rest) for i in range(leaves.num_rows)]
        out = leaves.select(names).append_column("_proof", pa.array(proofs, pa.string()))
        for c in ["_subroot", "_root"]:
            out = out.append_column(c, pa.array([path[c][0].as_py()] * leaves.num_rows, pa.string()))
        return out

    schema = ", ".join([f"{c} {kinds[c]}" for c in names] + ["_proof string, _subroot string, _root string"])
    return placed.groupBy("_tree", "_block").cogroup(upper.groupBy("_tree", "_block")).applyInArrow(prove, schema)


def build_manifest(docs: DataFrame, key_col: str = "doc_id", group_col: str = "source", columns: list[str] | None = None,
                   carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row: the key, leaf, proof, subroot (of its group) and root, and the expressions of ``carry``."""
    carry = {n: c for n, c in (carry or {}).items() if n not in (key_col, "leaf", "proof", "subroot", "root")}
    group = F.col(group_col).cast("string")
    rows = docs.select(
        # The mark puts the null group first and keeps the bytewise order of the others.
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("_tree"), F.col(key_col).alias("_key"),
        leaf_of([F.col(c) for c in columns or COLUMNS]).alias("_value"),
        *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    rows = stored(rows, "leaves")
    found = _paths(rows, ["_key", "_value"], "merkle", fanout, block_levels, True)
    return found.select(
        F.col("_key").alias(key_col), F.col("_value").alias("leaf"), F.col("_proof").alias("proof"),
        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)])
