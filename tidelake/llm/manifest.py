"""Merkle manifest of a table: a hash tree over the rows of each group, and one over the groups' roots.

Each node is labelled by the interval of leaf ranks that it covers. Trees are built in bands of levels: ``fan_in ** WIDTH``
consecutive nodes make a bucket, and a bucket's nodes of the next ``WIDTH`` levels are made in one row from its entries. Within
a parent's interval, what a child's interval leaves over are its siblings. Ancestors are attached to the entries of a bucket by a join
on the bucket whose condition is containment of intervals, and the steps above a bucket are those of its own entry in the next band. So a
row meets a bounded number of nodes in each band, whatever the size of its group, and there are log(rows) bands.

Ranks are given without bringing a group together: rows are dealt by ranges of their order and numbered within each range, and the
sizes of earlier ranges are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stash

WIDTH = 6  # levels of a band
FEW_RANGES = 200_000  # sizes of ranges that are broadcast; beyond that they are joined by range
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, one after another."""
    return F.sha2(F.concat(*parts), 256)


def told(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[told(v) for v in values])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings' digests, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def tree_key(group: Column) -> Column:
    """A text without nulls that orders like the group: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (with a column ``tree``) with ``rank`` from 0 within each tree by ``order``, and the tree's size ``n``.

    Rows that are equal in ``order`` have any order among themselves, so ``order`` ends in all that matters. A group of equal rows is
    cut by the rows' own numbers, hence no range has to take it whole.
    """
    own = F.monotonically_increasing_id()
    dealt = rows.withColumn("own", own).repartitionByRange("tree", *order, "own").sortWithinPartitions("tree", *order, "own")
    # written, as ranges are drawn from a sample: the same rows have to be counted and numbered
    numbered = stash(dealt.withColumn("own", own), f"{label}-numbered").withColumn("part", F.shiftright("own", 33))
    sizes = numbered.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("own").alias("first"))
    whole, before = W.partitionBy("tree"), W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = stash(
        sizes.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("size").over(whole).alias("n")),
        f"{label}-ranges",
    )
    if bases.count() <= FEW_RANGES:
        bases = F.broadcast(bases)
    return numbered.join(bases, ["tree", "part"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "part", "base")


def _levels(entries: DataFrame, fan_in: int, first: int) -> DataFrame:
    """One row for each bucket of a band: ``tree, bucket, runs`` (the parents of its levels, with their children),
    ``top`` (its node in the next band) and ``count`` (nodes of the tree in the next band)."""
    node = F.struct("at", "low", "high", "hash")
    rows = entries.groupBy("tree", "bucket").agg(F.first("count").alias("count"), F.array_sort(F.collect_list(node)).alias("nodes"))
    rows = rows.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), x["hash"].alias("hash"))))
    found = []
    for k in range(WIDTH):
        more = F.col("count") > 1  # a tree ends where one node remains
        starts = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / fan_in).cast("int"))
        rows = rows.withColumn("runs", F.when(more, F.transform(starts, lambda i: F.slice("nodes", i * fan_in + 1, fan_in))))

        def parent(run):
            joined = F.array_join(F.transform(run, lambda x: x["hash"]), "")
            return F.struct(run[0]["low"].alias("low"), F.element_at(run, -1)["high"].alias("high"), F.sha2(joined, 256).alias("hash"))

        level = F.lit(first + k).alias("level")
        levelled = F.transform("runs", lambda run: F.struct(level, run.alias("children")))  # noqa: B023
        found.append(f"runs{k}")
        rows = rows.withColumn(found[-1], F.coalesce(levelled, F.array()))
        rows = rows.withColumn("nodes", F.when(more, F.transform("runs", parent)).otherwise(F.col("nodes")))
        rows = rows.withColumn("count", F.ceil(F.col("count") / fan_in))
    return rows.select("tree", "bucket", F.concat(*found).alias("runs"), F.col("nodes")[0].alias("top"), "count")


def _steps(blocks: DataFrame) -> DataFrame:
    """One row for each node below a band's tops: its interval and its siblings to the left and to the right, which are
    what its interval leaves of its parent's."""
    runs = blocks.select("tree", "bucket", F.explode("runs").alias("run"))
    children = runs.select("tree", "bucket", "run", F.explode("run.children").alias("own"))

    def beside(keep) -> Column:
        return F.array_join(F.transform(F.filter("run.children", keep), lambda x: x["hash"]), "")

    step = F.struct(
        F.col("run.level").alias("level"),
        beside(lambda x: x["high"] < F.col("own.low")).alias("before"),
        beside(lambda x: x["low"] > F.col("own.high")).alias("after"),
    )
    return children.select("tree", "bucket", F.col("own.low").alias("from"), F.col("own.high").alias("to"), step.alias("step"))


def _attached(entries: DataFrame, steps: DataFrame, above: DataFrame, payload: list[str]) -> DataFrame:
    """Entries with ``path``: the steps of the nodes that contain them in this band, then the steps above their bucket; and
    with the other columns of ``above``."""
    contains = (F.col("s.from") <= F.col("e.low")) & (F.col("e.high") <= F.col("s.to"))
    same = (F.col("e.tree") == F.col("s.tree")) & (F.col("e.bucket") == F.col("s.bucket"))
    met = entries.alias("e").join(steps.alias("s").hint("merge"), same & contains, "left").select("e.*", "s.step")
    own = met.groupBy("tree", "bucket", "at").agg(F.array_sort(F.collect_list("step")).alias("steps"), *[F.first(c).alias(c) for c in payload])
    path = F.concat(F.transform("steps", lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after"))), "path")
    return own.join(above.withColumnRenamed("at", "bucket"), ["tree", "bucket"]).withColumn("path", path).drop("bucket", "steps")


def hash_trees(leaves: DataFrame, payload: list[str], fan_in: int, label: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(roots, attach)`` of ranked leaves (``tree, rank, n, hash`` and ``payload``).

    ``roots`` has ``tree, root``. ``attach(above)`` takes one row a tree, ``tree, path`` with what stands above its root and any other
    columns, and gives ``tree, path, payload`` and those columns for each leaf.
    """
    size = fan_in**WIDTH
    rank = F.col("rank")
    entries = leaves.select("tree", rank.alias("at"), rank.alias("low"), rank.alias("high"), "hash", F.col("n").alias("count"), *payload)
    bands: list[tuple[DataFrame, DataFrame]] = []
    first, most = 0, leaves.agg(F.max("n")).first()[0] or 0
    while not bands or most > 1:
        entries = entries.withColumn("bucket", F.expr(f"at DIV {size}"))
        blocks = stash(_levels(entries, fan_in, first), f"{label}-band")
        bands.append((entries, blocks))
        entries = blocks.select("tree", F.col("bucket").alias("at"), "top.low", "top.high", "top.hash", "count")
        first, most = first + WIDTH, -(-most // size)

    def attach(above: DataFrame) -> DataFrame:
        found = above.withColumn("at", F.lit(0).cast("long"))
        for k, (own, blocks) in reversed(list(enumerate(bands))):
            found = _attached(own, _steps(blocks), found, [] if k else payload)
            found = stash(found, f"{label}-paths") if k else found.drop("at")
        return found

    return entries.select("tree", F.col("hash").alias("root")), attach


def manifest(df: DataFrame, id_col: str, group_col: str, fields: list[Column], changed: list[Column] | None = None, fan_in: int = 2) -> DataFrame:
    """``id, leaf, changed_leaf, subroot, root, path array<struct<before, after>>`` for each row of ``df``.

    A leaf is the digest of a row's ``fields``; ``changed`` are the fields of another version of the rows, of which only the leaf is
    made (null without). Leaves of a group ascend by ``id_col`` (nulls first; equal ids by their leaves, so repeated rows stay repeated
    and give the same tree in any order). While several nodes remain, each ``fan_in`` consecutive ones become the digest of their digests, the
    last run with fewer; a lone leaf is its group's subroot. Subroots, ordered by group (null first, then by UTF-8 bytes), give the
    root in the same way. A step's ``before`` and ``after`` are the joined digests of the siblings to the left and right. An empty table gives no
    rows. Other columns aren't read.
    """
    changed_leaf = leaf_of(*changed) if changed else F.lit(None).cast("string")
    read = df.select(tree_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), leaf_of(*fields).alias("hash"), changed_leaf.alias("changed_leaf"))
    leaves = ranked(read, ["id", "hash"], "leaves").withColumn("leaf", F.col("hash"))
    subroots, attach = hash_trees(leaves, ["id", "leaf", "changed_leaf"], fan_in, "rows")
    groups = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash")), ["group"], "groups")
    roots, attach_groups = hash_trees(groups.withColumn("subroot", F.col("hash")), ["group", "subroot"], fan_in, "groups")
    tops = attach_groups(roots.withColumn("path", F.array().cast(f"array<{STEP}>")))
    return attach(tops.drop("tree").withColumnRenamed("group", "tree")).drop("tree")
