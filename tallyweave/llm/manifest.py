"""A Merkle manifest of a dataset: leaves per row, a tree per group, one tree over the groups' roots, and proofs.

Leaves are numbered within their group by a range partitioning and counts per partition, so no task
holds a group. Each level is one window: partitioned by group and parent index, an ordered full-frame
collect_list gives every node the whole run it stands in, which is both the parent's preimage and the
node's siblings. The first node of a run stands for the parent on the next level. Proofs come down
again level by level: a node's path is its own siblings and then its parent's path. Levels shrink by
the run's length, so all of it moves about twice as many narrow rows as there are leaves; texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import cut

#: Consecutive nodes that share a parent.
RUN = 2
#: Of the registered query: every so many ids' crc32 marks a row that is tampered with.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of all parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def row_digest(*values: Column) -> Column:
    """The digest of a row's values, each as its UTF-8 byte count, ":" and itself, or "-" if null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at (0, 1, ... within the group, by order) and of (the group's rows), however large a group is.

    Null groups are a group of their own; nulls in order come first; rows alike in order are numbered in any order.
    """
    keys = [group, *order]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    placed = cut(placed.withColumn("row_at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    spans = placed.groupBy("part", F.col(group).alias("span_of")).agg(F.min("row_at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("span_of")
    earlier = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("part").alias("span_part"), "span_of", (earlier - F.col("first")).alias("shift"), F.sum("n").over(own).alias("of"))
    met = placed.join(spans, (F.col("part") == F.col("span_part")) & F.col(group).eqNullSafe(F.col("span_of")))
    return met.withColumn("at", F.col("row_at") + F.col("shift")).drop("row_at", "part", "span_part", "span_of", "shift")


def _climb(nodes: DataFrame, group: str, run: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per level: nodes below a parent, with the run they stand in (parent, run); and the nodes that remained alone."""
    levels, tops = [], []
    most = nodes.agg(F.max("of")).first()[0] or 0
    while most > 1:
        tops.append(nodes.where("of = 1"))
        parent = F.floor(F.col("at") / run)
        whole = Window.partitionBy(group, "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = cut(nodes.where("of > 1").withColumn("parent", parent).withColumn("run", F.collect_list("node").over(whole)))
        levels.append(level)
        nodes = level.where(F.col("at") % run == 0).select(group, F.col("parent").alias("at"), F.ceil(F.col("of") / run).alias("of"), digest(F.array_join("run", "")).alias("node"))
        most = -(-most // run)
    return levels, [*tops, nodes.where("of = 1")]


def _descend(levels: list[DataFrame], tops: list[DataFrame], group: str, run: int, above: list[str]) -> DataFrame:
    """The lowest level's nodes with path and the columns above, which tops carry."""
    down = tops[-1]
    for level, ended in zip(reversed(levels), reversed(tops[:-1]), strict=True):
        turn = (F.col("at") % run).cast("int")
        step = F.struct(
            F.unhex(F.array_join(F.slice("run", F.lit(1), turn), "")).alias("before"),
            F.unhex(F.array_join(F.slice("run", turn + 2, F.lit(run)), "")).alias("after"),
        )
        own = [c for c in level.columns if c not in ("parent", "run")]
        up = down.select(F.col(group).alias("up_group"), F.col("at").alias("up_at"), F.col("path").alias("up_path"), *above)
        met = level.join(up, level[group].eqNullSafe(F.col("up_group")) & (F.col("parent") == F.col("up_at")))
        down = met.select(*own, F.concat(F.array(step), F.col("up_path")).alias("path"), *above).unionByName(ended.select(*own, "path", *above))
    return down


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path (siblings before and after it, level by level) lead to."""
    text = lambda x: F.lower(F.hex(x))
    return F.aggregate(path, node, lambda acc, step: digest(text(step["before"]), acc, text(step["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, in order."""
    return digest(F.array_join(F.transform(path, lambda step: F.lower(F.hex(F.concat(step["before"], step["after"])))), ""))


def manifest(leaves: DataFrame, group: str, order: list[str], run: int = RUN) -> DataFrame:
    """leaves (with node, their digest) and path, subroot, root: the Merkle tree of each group, and the one over the groups.

    Groups are ordered with null first, then by bytes. A group of one leaf has it as its subroot; one
    group's subroot is the root. path holds before and after (binary) of every level up to the root.
    """
    levels, tops = _climb(numbered(leaves, group, [*order, "node"]), group, run)
    base = [group, "at", "of", "node"]
    subroots = cut(_union([top.select(*base, F.lit(k).alias("level")) for k, top in enumerate(tops)]))
    crowns, ends = _climb(numbered(subroots.select(F.lit(0).alias("all"), F.col(group).alias("own"), "node", "level"), "all", ["own"]), "all", run)
    ends = [x.withColumn("root", F.col("node")).withColumn("path", F.expr("CAST(array() AS array<struct<before:binary,after:binary>>)")) for x in ends]
    crown = cut(_descend(crowns, ends, "all", run, ["root"]).select("own", F.col("node").alias("subroot"), "root", "path", "level"))
    above = ["subroot", "root"]
    tops = [
        top.join(c := crown.where(F.col("level") == k).drop("level"), top[group].eqNullSafe(c["own"])).drop("own") if k == 0 else crown.where(F.col("level") == k).select(F.col("own").alias(group), F.lit(0).cast("long").alias("at"), "path", *above)
        for k, top in enumerate(tops)
    ]
    for k in range(1, len(tops) - 1):
        tops[k] = tops[k].withColumns({"of": F.lit(1).cast("long"), "node": F.col("subroot")})
    return _descend(levels, tops, group, run, above).drop("at", "of")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves digest doc_id, source, lang, n_chars and text (null told apart from empty); groups are
    languages, null among them; leaves ascend by doc_id, null first, rows alike in it by their digest.
    Where TAMPERED divides the crc32 of the decimal doc_id, n_chars is one more in the leaf that is
    folded; null ids and null n_chars stay as they are. Repeated rows are leaves of their own. An empty
    table gives an empty result. Other columns are not read.
    """
    typed = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in zip(FIELDS, ("long", "string", "string", "long", "string"), strict=True)])
    marked = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    changed = F.when(marked, row_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    leaves = typed.select("doc_id", "lang", row_digest(*map(F.col, FIELDS)).alias("node"), changed.alias("changed"))
    proved = manifest(leaves, "lang", ["doc_id"])
    out = proved.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"


def _leaf(change: str = "") -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"({c}{change})" if c == "n_chars" else c) for c in FIELDS) + ")"


#: Two trees by recursion, one level a step; a path is a list of texts, each "L" or "R" and a sibling, or "N".
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN ({_CRC.format("CAST(doc_id AS VARCHAR)")}) % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN {_leaf(" + 1")} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, pos, n, 0 AS level, leaf AS node FROM placed
  UNION ALL
  SELECT lang, pos // 2, (n + 1) // 2, level + 1, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, pos // 2, n, level),
subroots AS (SELECT lang, level AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT pos, n, 0 AS level, node FROM subroots
  UNION ALL
  SELECT pos // 2, (n + 1) // 2, level + 1, sha256(string_agg(node, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY pos // 2, n, level),
below AS (
  SELECT p.doc_id, p.lang, p.pos, t.level, CASE WHEN s.node IS NULL THEN 'N' WHEN s.pos < t.pos THEN 'L' || s.node ELSE 'R' || s.node END AS step
  FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos >> t.level AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos // 2 = t.pos // 2 AND s.pos <> t.pos),
above AS (
  SELECT u.lang, t.level, CASE WHEN s.node IS NULL THEN 'N' WHEN s.pos < t.pos THEN 'L' || s.node ELSE 'R' || s.node END AS step
  FROM subroots u JOIN crown t ON t.pos = u.pos >> t.level AND t.n > 1
  LEFT JOIN crown s ON s.level = t.level AND s.pos // 2 = t.pos // 2 AND s.pos <> t.pos),
paths AS (
  SELECT p.*, coalesce(b.steps, []) || coalesce(a.steps, []) AS path
  FROM placed p LEFT JOIN (SELECT lang, pos, list(step ORDER BY level) AS steps FROM below GROUP BY lang, pos) b ON b.lang IS NOT DISTINCT FROM p.lang AND b.pos = p.pos
  LEFT JOIN (SELECT lang, list(step ORDER BY level) AS steps FROM above GROUP BY lang) a ON a.lang IS NOT DISTINCT FROM p.lang),
done AS (
  SELECT p.doc_id, p.leaf, u.node AS subroot, c.node AS root, sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(p.changed, p.leaf)], p.path), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM paths p JOIN subroots u ON u.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT node FROM crown WHERE n = 1) c)
SELECT *, folded_root = root AS verified FROM done
"""
