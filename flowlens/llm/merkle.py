"""Merkle manifest of a table: built levels as parent-linked node rows, and a recursive query that climbs them.

Leaves of a language, in the order of doc_id, are one tree; the subroots, in the order of the language, are the leaves of
the top tree (tree -1). A level is built from the one below it by hashing runs of eight. A node row holds its parent and
the digests left and right of it in its run. The climb is a recursive query: a row is a run of leaves, which share every
sibling from there on; each step appends the siblings of the node and folds the eight (perhaps tampered) hashes. Only
DataFrame and SQL functions; digests are 32 bytes in tables and hex text where they are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

FANOUT = 8
TOP = -1
_COLUMNS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "verified boolean")


def digest(nodes: Column) -> Column:
    """32-byte SHA-256 of the hex text of digests that lie one after another in a binary."""
    return F.unhex(F.sha2(F.lower(F.hex(nodes)), 256))


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``gp``, their place from 0 in ``order``, written once; ranges of rows, no task with a whole key."""
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33)
    count = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = count.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = parts.withColumn("_part", part).join(offset, "_part")
    return placed.withColumn("gp", F.col("_off") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_off", "_id")


def _left(run: Column, i: Column) -> Column:
    return F.aggregate(F.slice(run, F.lit(1), i), F.lit(b""), lambda a, x: F.concat(a, x))


def _right(run: Column, i: Column) -> Column:
    return F.aggregate(F.slice(run, i + 2, F.lit(FANOUT)), F.lit(b""), lambda a, x: F.concat(a, x))


def _whole(run: Column) -> Column:
    return F.aggregate(run, F.lit(b""), lambda a, x: F.concat(a, x))


def _runs(nodes: DataFrame, *extra: str) -> DataFrame:
    """(tree, n, idx, hash, extra...) -> a row for each run of eight: (tree, n, up, run), run in the order of idx."""
    row = F.struct("idx", "hash", *extra)
    return nodes.groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("up")).agg(F.sort_array(F.collect_list(row)).alias("run"))


def _build(leaves: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame, int]:
    """Leaves (tree, n, idx, hash) -> node rows of the levels above the leaves, (tree, level, hash) of the roots, levels.

    ``runs`` are the leaves' own runs where they are built already; then the leaves themselves get no node rows.
    """
    links, roots, level = None, leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "hash"), 0
    below = leaves
    while runs is not None or not below.where("n > 1").isEmpty():
        built = runs if runs is not None else written(_runs(below.where("n > 1")), "runs")
        hashes = F.transform("run", lambda r: r["hash"])
        if runs is None:
            own = built.select("tree", F.lit(level).alias("level"), "up", F.posexplode(hashes), hashes.alias("_run"))
            own = own.select(
                "tree", "level", (F.col("up") * FANOUT + F.col("pos")).alias("idx"), F.col("tree").alias("p_tree"),
                F.lit(level + 1).alias("p_level"), F.col("up").alias("p_idx"),
                _left(F.col("_run"), F.col("pos")).alias("lhs"), _right(F.col("_run"), F.col("pos")).alias("rhs"))
            links = own if links is None else links.union(own)
        runs, level = None, level + 1
        size = F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")
        below = written(built.select("tree", size.alias("n"), F.col("up").alias("idx"), digest(_whole(hashes)).alias("hash")), "level")
        roots = roots.union(below.where("n = 1").select("tree", F.lit(level).alias("level"), "hash"))
    return links, written(roots, "roots"), level


_CLIMB = """
WITH RECURSIVE climb(s_tree, s_up, tree, level, idx, path, folded) AS (
  SELECT s_tree, s_up, tree, level, idx, path, folded FROM {anchor}
  UNION ALL
  SELECT c.s_tree, c.s_up, n.p_tree, n.p_level, n.p_idx, concat(c.path, n.lhs, n.rhs),
    CASE WHEN n.p_tree = n.tree THEN transform(c.folded, f -> unhex(sha2(lower(hex(concat(n.lhs, f, n.rhs))), 256)))
      ELSE c.folded END
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx)
SELECT s_tree, s_up, path, folded FROM climb WHERE tree = -1 AND level = {top}
"""


def climb(spark: SparkSession, anchor: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """Every anchor row carried up to the root: (s_tree, s_up, path, folded), written to the shared folder.

    The recursion's row limit is a safety net for endless queries; this one ends after the levels of the tree, and its
    rows grow with the table, so the limit is lifted while it runs.
    """
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return written(spark.sql(_CLIMB, anchor=anchor, nodes=nodes, top=top), "climb")
    finally:
        spark.conf.set(key, before)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text)`` -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``tampered`` (default: 3 divides the crc32 of the decimal doc_id) tells the rows whose text is replaced by
    ``tampered_text`` (default: A-Z in lower case) before their hash is folded; leaf, proof, subroot and root are those of
    the given rows. A null field counts as '-', a null doc_id comes first and isn't tampered with. Rows with equal doc_id
    are leaves of their own, in the order of their leaf hash. A tree of one leaf has that leaf as its root; a leaf
    without siblings has the digest of the empty text as its proof. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0 if tampered is None else tampered
    text = ascii_lower(F.col("text")) if tampered_text is None else tampered_text
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_hash(F.col("text")).alias("hash"),
                       F.when(hit, leaf_hash(text)).alias("forged"), F.monotonically_increasing_id().alias("tie"))
    leaves = written(base, "leaves")
    placed = written(numbered(leaves, ["lang", "doc_id", "hash", "tie"], "ordered").drop("tie"), "placed")
    langs = placed.groupBy("lang").agg(F.min("gp").alias("tree"), F.count("*").alias("n"))
    trees = written(numbered(langs, ["tree"], "trees").withColumnRenamed("gp", "place"), "placed-trees")
    if trees.isEmpty():
        return spark.createDataFrame([], _COLUMNS)
    by_lang = trees.select(F.col("lang").alias("_lang"), "tree", "n")
    nodes0 = placed.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", "n", (F.col("gp") - F.col("tree")).alias("idx"), "hash", "forged", "doc_id")
    runs0 = written(_runs(nodes0, "forged", "doc_id"), "leaf-runs")

    links, roots, _ = _build(runs0.where("n = 1").select("tree", "n", F.col("up").alias("idx"), F.col("run")[0]["hash"].alias("hash")),
                             runs0.where("n > 1"))
    tops = written(trees.join(roots, "tree").select("tree", "level", "place", "hash"), "subroots")
    count = tops.count()
    top_links, top_root, top = _build(tops.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("place").alias("idx"), "hash"))
    # a subroot is a leaf of the top tree: a step that hashes nothing
    bridge = tops.select("tree", "level", F.lit(0).cast("long").alias("idx"), F.lit(TOP).cast("long").alias("p_tree"),
                         F.lit(0).alias("p_level"), F.col("place").alias("p_idx"), F.lit(b"").alias("lhs"), F.lit(b"").alias("rhs"))
    nodes = bridge
    for more in (links, top_links):
        nodes = nodes if more is None else nodes.union(more)
    nodes = written(nodes, "nodes")
    root = top_root.first()["hash"].hex()

    hashes = F.transform("run", lambda r: r["hash"])
    folded = F.transform("run", lambda r, i: F.when(F.col("n") == 1, F.coalesce(r["forged"], r["hash"])).otherwise(
        digest(F.concat(_left(hashes, i), F.coalesce(r["forged"], r["hash"]), _right(hashes, i)))))
    anchor = runs0.select(
        F.col("tree").alias("s_tree"), F.col("up").alias("s_up"), "tree",
        F.when(F.col("n") == 1, 0).otherwise(1).alias("level"), F.col("up").alias("idx"), F.lit(b"").alias("path"),
        folded.alias("folded"))
    carried = climb(spark, anchor, nodes, top)

    sub = tops.select(F.col("tree").alias("s_tree"), F.lower(F.hex("hash")).alias("subroot"))
    out = runs0.withColumnsRenamed({"tree": "s_tree", "up": "s_up"}).join(carried, ["s_tree", "s_up"]).join(sub, "s_tree")
    out = out.withColumn("hashes", hashes).select("subroot", "path", "folded", "hashes", F.posexplode("run").alias("i", "r"))
    proof = F.concat(_left(F.col("hashes"), F.col("i")), _right(F.col("hashes"), F.col("i")), F.col("path"))
    folded_root = F.lower(F.hex(F.get("folded", F.col("i"))))
    return out.select(
        F.col("r.doc_id").alias("doc_id"), F.lower(F.hex("r.hash")).alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(F.lower(F.hex(proof)), 256).alias("proof_sha256"), folded_root.alias("folded_root"),
        (folded_root == root).alias("verified"))
