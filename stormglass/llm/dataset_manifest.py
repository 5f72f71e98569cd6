"""Operator 11: Merkle manifest of a dataset, by parent-preimage paths.

A row is a leaf: the hash of its fields, each with its length.  The leaves of a group (here a language) in
order of id are a tree of FANOUT children a node; the groups' roots in order are another tree, whose root names the
dataset.  A parent's preimage is what its hash is taken of: its children's hashes, one after the other, SLOT
characters each.  Levels store these preimages.

A proof needs the siblings at every level, and they stand in the preimages of a leaf's ancestors: paths go down from the top,
a node's path being its own preimage before its parent's path, so a level joins its parents only and all
joins together move little more than the last one.  A leaf excises its own slot from each preimage, which leaves the siblings, and splices
a replacement into it, whose hash goes into the next one: that folds a changed leaf to the root it would give.

Places in order come from ``operators.order``: no task sees all rows of a group.  Built-in
functions only.

Cases: a null field is ``-``, an empty one ``0:``; a null id comes first and is never tampered with; rows that share an id lie in
order of their hashes, which tells equal rows apart in nothing; a null group comes first; a group of one row has its leaf
as root, and one group's root is that of the dataset; an empty table gives an empty one; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import placed
from .common import cut, documents

#: Children of a node, characters of a hash.
FANOUT, SLOT = 8, 64
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "array<struct<preimage:string,slot:int>>"


def leaf_of(fields: list[Column]) -> Column:
    """The hash of some fields, each null as ``-`` or with its length in UTF-8 before it."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*coded), 256)


def without_slot(preimage: Column, slot: Column) -> Column:
    """The siblings' hashes: ``preimage`` less the characters of ``slot``."""
    return spliced(preimage, slot, F.lit(""))


def spliced(preimage: Column, slot: Column, digest: Column) -> Column:
    """``preimage`` with ``digest`` in ``slot``."""
    at = slot * SLOT
    return F.concat(F.substring(preimage, F.lit(1), at), digest, F.substring(preimage, at + SLOT + 1, F.lit(FANOUT * SLOT)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(spliced(step["preimage"], step["slot"], digest), 256))


def proof(path: Column) -> Column:
    """The siblings of ``path``, level by level, as one text."""
    return F.array_join(F.transform(path, lambda step: without_slot(step["preimage"], step["slot"])), "")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Parents from the lowest to the top ones: tree, n (leaves of the tree), node, preimage and alone (no other node is at that level of the tree).

    ``leaves`` has tree, n, node (the place) and digest.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, nodes, width = [], leaves, 1
    while width < most:
        # A tree that has come down to one node at this level has its root already.
        width *= FANOUT
        kids = nodes.filter(F.col("n") > width // FANOUT)
        parents = kids.groupBy("tree", "n", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("kids"))
        level = cut(parents.select("tree", "n", "node", F.array_join("kids.digest", "").alias("preimage"), (F.col("n") <= width).alias("alone")))
        out.append(level)
        nodes = level.select("tree", "n", "node", F.sha2("preimage", 256).alias("digest"))
    return out


def roots(leaves: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """tree and digest of each tree's root."""
    tops = [leaves.filter("n = 1").select("tree", "digest"), *(level.filter("alone").select("tree", F.sha2("preimage", 256).alias("digest")) for level in parents)]
    return reduce(DataFrame.unionByName, tops)


def paths(parents: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """tree, node and the path of each lowest parent: itself, then what is above it, as preimages with the slot that leads down; with the columns of ``above``.

    ``above`` has tree, path and whatever else a tree brings along.
    """
    brought = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for level in reversed(parents):
        here = level.filter("alone").join(above, "tree").select("tree", "node", "preimage", "path", *brought)
        if below is not None:
            up = below.select("tree", F.col("node").alias("up"), F.col("preimage").alias("up_preimage"), F.col("path").alias("up_path"), *brought)
            kids = level.filter("not alone").withColumn("up", F.floor(F.col("node") / FANOUT))
            here = here.unionByName(kids.join(up, ["tree", "up"]).select("tree", "node", "preimage", _longer("up_preimage", F.col("node"), "up_path").alias("path"), *brought))
        below = here
    return below


def _longer(preimage: str, node: Column, path: str) -> Column:
    """The path of ``node``, out of its parent's preimage and path."""
    return F.concat(F.array(F.struct(F.col(preimage).alias("preimage"), (node % FANOUT).cast("int").alias("slot"))), F.col(path))


def with_paths(leaves: DataFrame, parents: list[DataFrame], above: DataFrame) -> DataFrame:
    """``leaves`` with their paths and the columns of ``above``."""
    alone = leaves.filter("n = 1").join(above, "tree")
    lowest = paths(parents, above)
    if lowest is None:
        return alone
    up = lowest.select("tree", F.col("node").alias("up"), "preimage", F.col("path").alias("up_path"), *(c for c in above.columns if c not in ("tree", "path")))
    many = leaves.filter("n > 1").withColumn("up", F.floor(F.col("node") / FANOUT)).join(up, ["tree", "up"])
    return many.withColumn("path", _longer("preimage", F.col("node"), "up_path")).drop("up", "preimage", "up_path").unionByName(alone)


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, changed_leaf (with the columns of ``tampered`` in place of their own), subroot, root and path for each row of ``df``.

    ``path`` has an element for each level: the parent's preimage and the row's slot in it.
    """
    own, changed = {f: F.col(f"`{f}`") for f in fields}, tampered or {}
    rows = df.select(F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf_of(list(own.values())).alias("leaf"), leaf_of(list((own | changed).values())).alias("changed_leaf"))
    rows = placed(cut(rows), [F.col("id"), F.col("leaf")], by=[F.col("group")], place="node", size="n")
    groups = cut(placed(rows.select("group").distinct(), [F.col("group")], place="tree", size="n_trees"))
    named = groups.select(F.col("group").alias("_group"), "tree")
    leaves = cut(rows.join(named, F.col("group").eqNullSafe(F.col("_group"))).select("tree", "n", "node", F.col("leaf").alias("digest"), "id", "changed_leaf"))
    parents = levels(leaves)
    subroots = cut(roots(leaves, parents).join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("n_trees").alias("n"), F.col("tree").alias("node"), "digest"))
    top = levels(subroots)
    root = roots(subroots, top).select("tree", F.array().cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    above = cut(with_paths(subroots, top, root).select(F.col("node").alias("tree"), F.col("digest").alias("subroot"), "path", "root"))
    return with_paths(leaves, parents, above).select("id", F.col("digest").alias("leaf"), "changed_leaf", "subroot", "root", "path")


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row's text, by crc32 of its id, is lower-cased after the manifest was made; its proof fails if that changed it."""
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(struck, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = manifest(documents(spark, sf_dir), tampered={"text": text})
    out = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL writes out; 8**11 rows.
SQL_LEVELS = 11
_CRC = "list_reduce(list_transform(range(0, length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) AS BIGINT)), lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT))"


def _sql_tree(leaf: str, name: str) -> str:
    """CTEs of a tree's levels over ``leaf`` (tree, pos, h), and ``{name}_at``: for each level and node its siblings before and after it."""
    out = [f"{name}0 AS (SELECT tree, pos, h FROM {leaf})"]
    for i in range(1, SQL_LEVELS + 1):
        out.append(f"{name}{i} AS (SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{i - 1} WHERE tree IN (SELECT tree FROM {name}{i - 1} GROUP BY tree HAVING count(*) > 1) GROUP BY tree, pos // 8)")
    side = lambda i, before: f"coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {'UNBOUNDED PRECEDING AND 1 PRECEDING' if before else '1 FOLLOWING AND UNBOUNDED FOLLOWING'}), '')"
    for i in range(SQL_LEVELS):
        out.append(f"{name}s{i} AS (SELECT tree, pos, {side(i, True)} AS l, {side(i, False)} AS r FROM {name}{i} WHERE tree IN (SELECT tree FROM {name}{i + 1}))")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{i} WHERE tree NOT IN (SELECT tree FROM {name}{i + 1})" for i in range(SQL_LEVELS))
    return ", ".join([*out, f"{name}_top AS ({tops})"])


def _sql_fold(rows: str, name: str, tree: str, pos: str, out: str) -> str:
    """CTEs that fold ``rows`` (with hash x and siblings p) up the levels of a tree; ``out`` is the last."""
    steps = [f"{out}f0 AS (SELECT * FROM {rows})"]
    for i in range(SQL_LEVELS):
        steps.append(f"{out}f{i + 1} AS (SELECT f.* EXCLUDE (x, p), CASE WHEN s.tree IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, p || coalesce(s.l || s.r, '') AS p FROM {out}f{i} f LEFT JOIN {name}s{i} s ON s.tree = f.{tree} AND s.pos = f.{pos} // {8**i})")
    return ", ".join(steps)


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
#: Levels written out one by one, siblings by windows, crc32 bit by bit.
ORACLE_SQL = {
    "op11_dataset_manifest": f"""
    WITH d AS (SELECT *, {_LEAF} AS leaf FROM documents),
    t AS (SELECT *, coalesce(xor({_CRC}, 4294967295) % 3 = 0, false) AS struck FROM d),
    g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM t),
    c AS (SELECT * REPLACE (CASE WHEN struck THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS text) FROM g),
    lv AS (SELECT tree, pos, leaf AS h FROM g),
    {_sql_tree("lv", "a")},
    sub AS (SELECT 0 AS tree, tree AS pos, h FROM a_top),
    {_sql_tree("sub", "b")},
    q AS (SELECT doc_id, leaf, tree, pos, 0 AS zero, {_LEAF} AS x, '' AS p FROM c),
    {_sql_fold("q", "a", "tree", "pos", "u")},
    {_sql_fold(f"uf{SQL_LEVELS}", "b", "zero", "tree", "v")}
    SELECT doc_id, leaf, a_top.h AS subroot, b_top.h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = b_top.h AS verified
    FROM vf{SQL_LEVELS} v JOIN a_top ON a_top.tree = v.tree CROSS JOIN b_top
    """
}
QUERIES = {"op11_dataset_manifest": op11_dataset_manifest}
