"""A Merkle manifest of a dataset: one digest for all rows, and for each row the proof that it is in it.

Every row is a leaf. Within a group (a language) leaves are ranked by key, and every ``FAN`` consecutive nodes become their
parent until one is left, the group's subroot; the subroots are nodes of one more tree, whose last node is the root.

**Rollup.** A rank's digits in base FAN say which child a node is on every level. ``DIGITS`` of them make a block: rows are
exchanged by (group, block) once, then ``groupBy`` drops one digit after the other, each time nesting the children's structs in
their parent, and needs no further exchange. A block is one row of at most FAN ** DIGITS leaves, whatever the group's size.
The blocks' own nodes are ranked by block number already and are rolled up again in the next round, one in FAN ** DIGITS of
the rows before, until every group is one node.

**Proofs.** From the top round down, the siblings above a block are put beside it by a union and one aggregate, and nested
``transform`` and ``explode`` hand them from parents to children, so that no proof is joined from its parts.

A level that a group does not need (it has one node left already) passes the node on without hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import positions
from chatloom.session import stage

FAN = 8
DIGITS = 4  # 4096 leaves in a block, about a megabyte
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MOST_LEVELS = 21  # 8 ** 20 still fits a bigint
PIECE = 1 << 16

STEP = "struct<left: string, right: string, hashed: boolean>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(row: dict[str, Column]) -> Column:
    return digest(*[encoded(row[f]) for f in FIELDS])


def levels_for(n: Column) -> Column:
    """How many levels of parents ``n`` nodes need until one is left."""
    return sum(((n > FAN**k).cast("int") for k in range(MOST_LEVELS)), F.lit(0))


def ranked_in_groups(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``rank`` (0-based, within the group, in ``order``) and ``n``, the group's rows.

    All rows are numbered in the order (group, order). A group's first number and size come from counts of its pieces of
    at most ``PIECE`` rows, and are put beside the rows piece by piece: a group of any size is no hot join key.
    """
    piece = F.expr(f"_at div {PIECE}")
    numbered = positions(rows, [F.asc_nulls_first(group), *order], "_at", name)
    counts = numbered.groupBy(F.col(group).alias("_group"), piece.alias("_which")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("_group")
    counts = counts.select("_group", "_which", F.min("_from").over(own).alias("_first"), F.sum("_rows").over(own).alias("n"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (piece == F.col("_which"))
    return numbered.join(counts, same).select(*rows.columns, (F.col("_at") - F.col("_first")).alias("rank"), "n")


# ---- up ----------------------------------------------------------------------------------------------------


def roll_up(nodes: DataFrame, group: str) -> DataFrame:
    """Blocks of ``nodes`` (group, rank, levels, node: struct(hash, ...)): (group, rank, levels, hash, tree), ``levels`` being left."""
    power = [FAN**k for k in range(DIGITS + 1)]
    digits = [F.expr(f"(rank div {power[k]}) % {FAN}").cast("int").alias(f"_d{k}") for k in range(DIGITS)]
    block = F.expr(f"rank div {power[DIGITS]}").alias("_block")
    level = nodes.select(group, block, "levels", *digits, "node").repartition(group, "_block")
    for k in range(DIGITS):
        upper = [f"_d{j}" for j in range(k + 1, DIGITS)]
        children = F.transform(F.array_sort(F.collect_list(F.struct(f"_d{k}", "node"))), lambda c: c["node"])
        level = level.groupBy(group, "_block", "levels", *upper).agg(children.alias("_kids"))
        hashes = F.array_join(F.transform("_kids", lambda c: c["hash"]), "")
        own = F.when(F.col("levels") > k, F.sha2(hashes, 256)).otherwise(F.get("_kids", F.lit(0))["hash"])
        level = level.select(group, "_block", "levels", *upper, F.struct(own.alias("hash"), F.col("_kids").alias("kids")).alias("node"))
    return level.select(
        group,
        F.col("_block").alias("rank"),
        F.greatest(F.col("levels") - DIGITS, F.lit(0)).alias("levels"),
        F.col("levels").alias("_own_levels"),
        F.col("node.hash").alias("hash"),
        F.col("node.kids").alias("tree"),
    )


def tree_over(leaves: DataFrame, group: str, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(one row for each group: group, hash; staged rounds of blocks, lowest first)."""
    rounds, nodes = [], leaves
    while True:
        blocks = stage(roll_up(nodes, group), f"{name}_{len(rounds)}")
        rounds.append(blocks)
        if not blocks.filter("rank > 0").limit(1).count():
            return blocks.select(group, "hash"), rounds
        nodes = blocks.select(group, "rank", "levels", F.struct("hash").alias("node"))


# ---- down --------------------------------------------------------------------------------------------------


def _beside(nodes: Column, i: Column, hashed: Column) -> Column:
    """The siblings left and right of the i-th node."""
    hashes = F.transform(nodes, lambda c: c["hash"])
    left = F.array_join(F.slice(hashes, F.lit(1), i), "")
    right = F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"), hashed.alias("hashed"))


def open_blocks(blocks: DataFrame, above: DataFrame, group: str) -> DataFrame:
    """Every node of ``blocks`` with the steps from it to the root: (group, rank, top, path, node).

    ``above`` has (group, rank, top, path) of the blocks' own nodes; ``top`` is handed down as it is.
    """
    both = blocks.select(group, "rank", "_own_levels", "tree").unionByName(above.select(group, "rank", "top", "path"), allowMissingColumns=True)
    met = both.groupBy(group, "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_own_levels", "top", "path", "tree")])
    level = met.withColumnRenamed("tree", "_kids")
    for k in reversed(range(DIGITS)):
        hashed = F.col("_own_levels") > k
        opened = F.transform("_kids", lambda c, i: F.struct(c.alias("node"), _beside(F.col("_kids"), i, hashed).alias("step")))
        level = level.select(group, "rank", "_own_levels", "top", "path", F.posexplode(opened).alias("_i", "_o"))
        below = F.col("_o.node.kids") if k else F.col("_o.node")
        rank = F.col("rank") * FAN + F.col("_i")
        level = level.select(group, rank.alias("rank"), "_own_levels", "top", F.concat(F.array("_o.step"), "path").alias("path"), below.alias("_kids"))
    return level.select(group, "rank", "top", "path", F.col("_kids").alias("node"))


def open_tree(rounds: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """Every leaf of ``tree_over`` with its path. ``above``: (group, top, path) of the groups' own nodes."""
    opened = above.withColumn("rank", F.lit(0).cast("bigint"))
    for blocks in reversed(rounds):
        opened = open_blocks(blocks, opened, group)
    return opened


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.when(s["hashed"], digest(s["left"], h, s["right"])).otherwise(h))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


# ---- the manifest ------------------------------------------------------------------------------------------


def suspicious(key: Column) -> Column:
    """Rows that the rehearsal of tampering touches: every third by the CRC-32 of the key; NULL keys are left alone."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, ``leaf``, ``subroot``, ``root``, ``path`` (the steps from the leaf to the
    root: siblings left and right, and whether they are hashed at all), ``proof_sha256``, ``folded_root``, ``verified``.

    ``docs`` needs doc_id, source, lang, n_chars, text; any may be NULL (NULL keys come first in their language, NULL is a
    language of its own and the first). ``folded_root`` is computed from the stored siblings and a leaf made anew, whose text
    was lower-cased for every third key: where that changed it, ``verified`` is false. Rows that repeat a key are ordered by
    their leaves; equal rows have equal leaves and different places. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    row = {f: F.col(f"`{f}`") for f in FIELDS}
    leaf = leaf_of(row)
    tampered = leaf_of({**row, "text": lowered(row["text"])})
    again = F.when(suspicious(row["doc_id"]) & (lowered(row["text"]) != row["text"]), tampered)
    leaves = stage(docs.select(row["doc_id"].alias("doc_id"), row["lang"].cast("string").alias("lang"), leaf.alias("hash"), again.alias("again")), "leaves")
    ranked = ranked_in_groups(leaves, "lang", [F.asc_nulls_first("doc_id"), F.col("hash")], "leaf_ranks")
    nodes = ranked.select("lang", "rank", levels_for(F.col("n")).alias("levels"), F.struct("hash", "doc_id", "again").alias("node"))
    subroots, rounds = tree_over(nodes, "lang", "leaves")

    of_all = subroots.select(F.lit(0).alias("all"), F.col("lang").alias("_lang"), F.col("hash").alias("_sub"))
    tops = ranked_in_groups(of_all, "all", [F.asc_nulls_first("_lang")], "subroot_ranks")
    node = F.struct(F.col("_sub").alias("hash"), F.col("_lang").alias("lang"))
    roots, top_rounds = tree_over(tops.select("all", "rank", levels_for(F.col("n")).alias("levels"), node.alias("node")), "all", "subroots")
    end = roots.select("all", F.col("hash").alias("top"), F.expr(f"cast(array() AS array<{STEP}>)").alias("path"))

    of_groups = open_tree(top_rounds, "all", end)  # top: the root
    above = of_groups.select("node.lang", F.struct(F.col("node.hash").alias("subroot"), F.col("top").alias("root")).alias("top"), "path")
    opened = open_tree(rounds, "lang", above)
    made = folded(F.col("path"), F.coalesce("node.again", "node.hash"))
    return opened.select(
        "node.doc_id",
        "lang",
        F.col("node.hash").alias("leaf"),
        "top.subroot",
        "top.root",
        "path",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        made.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
