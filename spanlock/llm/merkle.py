"""A Merkle manifest of a dataset: a tree of digests over all rows, and proofs that look coordinates up.

A row's fields, each with its length, make its leaf. Leaves of a group stand in order; every run of
``fan`` nodes becomes their parent until one is left, the group's subroot, and the subroots become the root
in the same way. A node is a row ``(group, level, pos)`` of the node table and holds the digests of the run
below it, so the siblings of a leaf lie at coordinates that follow from its index alone: on level l in
the node ``index div fan**l``. A proof explodes a leaf into these coordinates (as many as its group has
levels), joins the materialised node table, orders what it found by level and folds it.

Where it travels: texts are hashed in the task that reads them. Places come from a range partitioning and
per-partition counts, never from a window over a group. Each level is one grouping by (group, run), which
shrinks by ``fan``. Upper nodes are asked for by all leaves of a group: levels of together at most
``BROADCAST_ROWS`` digests are broadcast, behind a count, and only the levels below, whose nodes are asked for by few leaves
each, are joined by shuffle.

Defined cases: a null field is ``-``; a null group is a group of its own and comes first; null ids come first in
their group, and rows of one id stand by their leaves, rows equal in everything in any order; a group of one row
has its leaf as subroot; a proof without siblings is the digest of nothing; an empty table has no rows; very long texts count
whole. Extra columns of the input are not part of a leaf and do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, UPPER, ascii_lower, crc_of_id, cut, join_small, running_totals, table
from .importance import CRC_OF, CRC_TABLE

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["grp", "level", "pos"]


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    parts = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _group_key(group: str | None) -> Column:
    """Sorts a null group before all others, bytewise."""
    return F.lit("") if group is None else F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))


def index_leaves(rows: DataFrame, order: list[Column], leaf: str = "leaf") -> DataFrame:
    """Adds ``index``, the place of a row in its ``grp`` from 0, and ``size``, the rows of the group. ``rows`` must be cheap to read twice."""
    rows = rows.withColumns({"__one": F.lit(1).cast("long"), "__tie": F.monotonically_increasing_id()})
    rows = cut(running_totals(rows, [F.col("grp"), *order, F.col(leaf), F.col("__tie")], {"__before": "__one"}))
    sizes = cut(rows.groupBy("grp").agg(F.min("__before").alias("__first"), F.count(F.lit(1)).alias("size")))
    out = join_small(rows, sizes, ["grp"])
    return out.withColumn("index", F.col("__before") - F.col("__first")).drop("__one", "__tie", "__before", "__first")


def build_nodes(leaves: DataFrame, *, leaf: str = "leaf", fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(nodes, subroots). nodes: grp, level from 1, pos, digest, run (the digests below, in order); subroots: grp, subroot, height.

    ``leaves`` holds grp, index, size and the digest. Each level is written before the next one is built from it.
    """
    here = leaves.select("grp", F.col("index").alias("pos"), F.col("size").alias("width"), F.col(leaf).alias("digest"))
    tops, levels, level = [], [], 0
    while True:
        tops.append(here.where("width = 1").select("grp", F.col("digest").alias("subroot"), F.lit(level).alias("height")))
        wide = here.where("width > 1")
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        # ``width`` follows from the group alone, so it is no further key but for the optimiser
        above = wide.groupBy("grp", F.expr(f"pos div {fan}").alias("above"), F.expr(f"(width + {fan - 1}) div {fan}").alias("width")).agg(run.alias("run"))
        above = cut(above.select("grp", F.lit(level + 1).alias("level"), F.col("above").alias("pos"), "width", F.sha2(F.array_join("run", ""), 256).alias("digest"), "run"))
        if above.isEmpty():
            break
        levels.append(above)
        here, level = above, level + 1
    nodes = reduce(DataFrame.unionByName, levels, above).select(*NODE, "digest", "run")
    return nodes, reduce(DataFrame.unionByName, tops)


def paths(leaves: DataFrame, nodes: DataFrame, *, key: str, fan: int = FAN) -> DataFrame:
    """(key, path): for every leaf the runs above it by level, as an array of (level, run, slot).

    leaves: ``key`` (unique), grp, index, height. The coordinates of low levels meet their nodes in a shuffle join, those
    of the levels above, whose digests are few, in a broadcast join that leaves rows where they are.
    """
    counts = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.sum(F.size("run")).alias("n")).collect()}  # one row a level
    low, above = max(counts, default=0), 0
    while low > 0 and above + counts[low] <= BROADCAST_ROWS:
        above, low = above + counts[low], low - 1

    def coordinates(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        level = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        rows = rows.select(*rows.columns, F.explode_outer(level).alias("level"))
        return rows.withColumn("pos", F.expr(f"index div cast(pow({fan}, level) as bigint)")).withColumn("slot", F.expr(f"cast(index div cast(pow({fan}, level - 1) as bigint) % {fan} as int)"))

    rows = leaves.select(key, "grp", "index", "height")
    wanted = nodes.select(*NODE, "run")
    step = F.when(F.col("run").isNotNull(), F.struct("level", "run", "slot"))
    found = F.array_sort(F.collect_list(step))
    if low:
        met = coordinates(rows, F.lit(1), F.least(F.col("height"), F.lit(low))).join(wanted.where(F.col("level") <= low), NODE, "left")
        rows = met.groupBy(key).agg(*(F.first(c).alias(c) for c in ("grp", "index", "height")), found.alias("low"))
    else:
        rows = rows.repartition(key).withColumn("low", F.array().cast("array<struct<level:int,run:array<string>,slot:int>>"))
    high = coordinates(rows, F.lit(low + 1), F.col("height")).join(F.broadcast(wanted.where(F.col("level") > low)), NODE, "left")
    out = high.groupBy(key).agg(F.first("low").alias("low"), found.alias("high"))
    return out.select(key, F.concat("low", "high").alias("path"))


def siblings(path: Column) -> Column:
    """The digests of a proof, level by level, left to right, without the ones on the way."""
    return F.flatten(F.transform(path, lambda p: F.concat(F.slice(p["run"], F.lit(1), p["slot"]), F.slice(p["run"], p["slot"] + 2, F.size(p["run"])))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""

    def up(digest: Column, p: Column) -> Column:
        left, right = F.slice(p["run"], F.lit(1), p["slot"]), F.slice(p["run"], p["slot"] + 2, F.size(p["run"]))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")), 256)

    return F.aggregate(path, leaf, up)


def manifest(rows: DataFrame, order: list[Column], *, leaf: str = "leaf", fan: int = FAN) -> DataFrame:
    """Adds subroot, root and path (subroots included) to rows of ``grp`` and a leaf digest.

    Other columns pass through; those with the name of a result or of a coordinate are left out.
    """
    rows = rows.drop("subroot", "root", "path", "index", "size", "height", "top").withColumn("__key", F.monotonically_increasing_id())
    leaves = index_leaves(cut(rows), order, leaf)
    nodes, subroots = build_nodes(leaves, leaf=leaf, fan=fan)
    tops = index_leaves(cut(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("__key"), "subroot", F.col("height").alias("__height"))), [F.col("__key")], "subroot")
    top_nodes, root = build_nodes(tops, leaf="subroot", fan=fan)
    tops = tops.join(F.broadcast(root.select("grp", F.col("subroot").alias("root"), "height")), "grp")  # one row
    tops = cut(tops.join(paths(tops, top_nodes, key="__key", fan=fan), "__key").select(F.col("__key").alias("grp"), "subroot", "root", F.col("__height").alias("height"), F.col("path").alias("top")))
    leaves = join_small(leaves, tops, ["grp"], weight=F.aggregate("top", F.lit(1), lambda n, p: n + F.size(p["run"])).cast("long"))
    out = leaves.join(paths(leaves, nodes, key="__key", fan=fan), "__key")
    return out.withColumn("path", F.concat("path", "top")).drop("__key", "grp", "index", "size", "height", "top")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under one root by language, their proofs, and the roots that follow where texts were changed."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(crc_of_id() % 3 == 0, leaf_digest([*fields[:-1], ascii_lower(F.col("text"))]))
    rows = docs.select("doc_id", _group_key("lang").alias("grp"), leaf_digest(fields).alias("leaf"), tampered.alias("tampered"))
    out = manifest(rows, [F.col("doc_id").asc_nulls_first()])
    proof = F.sha2(F.array_join(siblings(F.col("path")), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_levels(t: str, n: int) -> str:
    """Levels 1 to n of a tree over {t}0(g, pos, width, digest), each with the runs that its nodes stand on; a node of width 1 stays what it is."""
    return ",\n".join(
        f"""{t}{i} AS (SELECT g, pos // {FAN} AS pos, (any_value(width) + {FAN - 1}) // {FAN} AS width, any_value(width) > 1 AS real, list(digest ORDER BY pos) AS run,
CASE WHEN any_value(width) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {t}{i - 1} GROUP BY g, pos // {FAN})"""
        for i in range(1, n + 1)
    )


#: Levels that the SQL works out in each tree: enough for 8**7 rows a language and 8**3 languages.
_DEEP, _TOP = 7, 3


def _sql_leaf(text: str) -> str:
    value = lambda c: text if c == "text" else f"CAST({c} AS VARCHAR)"
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value(c)}) || ':' || {value(c)} END" for c in FIELDS) + ")"


def _sql() -> str:
    joins = " ".join(f"JOIN l{i} ON l{i}.g = z.g AND l{i}.pos = z.pos // {FAN**i}" for i in range(1, _DEEP + 1))
    joins += " JOIN s ON s.g = z.g " + " ".join(f"JOIN t{i} ON t{i}.pos = s.pos // {FAN**i}" for i in range(1, _TOP + 1))
    folds, before = [], "coalesce(tampered, leaf)"
    text = "''"
    for t, row, n in (("l", "z", _DEEP), ("t", "s", _TOP)):
        for i in range(1, n + 1):
            slot = f"({row}.pos // {FAN ** (i - 1)} % {FAN})"
            left, right = (f"coalesce(array_to_string({t}{i}.run[{part}], ''), '')" for part in (f"1:{slot}", f"{slot} + 2:{FAN}"))
            text += f" || CASE WHEN {t}{i}.real THEN {left} || {right} ELSE '' END"
            folds.append(f"CASE WHEN {t}{i}.real THEN sha256({left} || {before} || {right}) ELSE {before} END AS f_{t}{i}")
            before = f"f_{t}{i}"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_sql_leaf("text")} AS leaf,
      CASE WHEN {CRC_OF.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS tampered FROM documents CROSS JOIN ct),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS width FROM d),
l0 AS (SELECT g, pos, width, leaf AS digest FROM z),
{_sql_levels("l", _DEEP)},
s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS width FROM l{_DEEP}),
t0 AS (SELECT 0 AS g, pos, width, subroot AS digest FROM s),
{_sql_levels("t", _TOP)},
o AS (SELECT doc_id, leaf, subroot, t{_TOP}.digest AS root, sha256({text}) AS proof_sha256, {", ".join(folds)} FROM z {joins})
SELECT doc_id, leaf, subroot, root, proof_sha256, {before} AS folded_root, {before} = root AS verified FROM o
"""


OP12_SQL = _sql()
