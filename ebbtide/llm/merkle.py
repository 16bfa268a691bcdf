"""Merkle manifest of a table by slot pivots.

Every row is a leaf; the leaves of a group, in order of their id, form a tree in which `fanout`
consecutive nodes have one parent, and the roots of all groups form a tree on top. The hash of a
parent is H (lower-case hex sha256) of its children's hashes.

A pivot takes `fanout ** levels` consecutive nodes to one row: one grouping by tree and block, with a
conditional aggregate for each slot. In that row, parents are hashes of concatenated slot columns, for
`levels` levels, and the next pivot goes on from the row's top. Going down again, each row hands every
slot its path: for each level, what stands before and behind the own slot column among its run.
A table of n leaves needs log(n) / log(fanout ** levels) pivots, and each holds a fraction of the
nodes of the one before. No task holds a group: blocks have at most `fanout ** levels` rows.

Leaves get their places from range-partitioned, written rows: counted within ranges and shifted
by the counts before. Only ids, groups and hashes are shuffled, never texts.

Defined results: null fields enter H as `-`. Null groups are a group of their own, first in the order;
null ids come first in their group; rows of equal id are ordered by their hashes. Repeated rows are
leaves of their own. An empty table has no root and gives no rows. Further columns are not read.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.operators.rank import ROWS_PER_BUCKET, ranged
from ebbtide.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,behind:string>"


def digest(*parts):
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def leaf_hash(values):
    """H of the values, each as byte count, colon and value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts])


def height(n, fanout):
    """Levels above the leaves of a tree of n leaves: how many powers of the fanout lie below n."""
    powers, at = [], 1
    while at < 2**62:
        powers.append(F.lit(at).cast("long"))
        at *= fanout
    return F.size(F.filter(F.array(*powers), lambda p: p < n))


def placed(leaves, count, rows_per_range=ROWS_PER_BUCKET):
    """leaves (grp, id, node, ...) with `pos`, the place among the leaves of the group from 0."""
    ranges = ranged(leaves, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), "node"], count, rows_per_range)
    inside = F.row_number().over(Window.partitionBy("bucket", "grp").orderBy(F.col("id").asc_nulls_first(), "node"))
    # One row for each range that a group has rows in.
    sums = ranges.groupBy("grp", "bucket").agg(F.count("*").alias("m"))
    shift = sums.select(F.col("grp").alias("g"), F.col("bucket").alias("b"),
                        (F.sum("m").over(Window.partitionBy("grp").orderBy("bucket")) - F.col("m")).alias("shift"))
    rows = ranges.withColumn("inside", inside)
    return (rows.join(shift, (rows["bucket"] == shift["b"]) & rows["grp"].eqNullSafe(shift["g"]))
            .withColumn("pos", F.col("shift") + F.col("inside") - 1).drop("bucket", "inside", "shift", "g", "b"))


class Pivot:
    """Blocks of fanout ** levels consecutive nodes in one row each."""

    def __init__(self, fanout, levels):
        self.fanout, self.levels, self.width = fanout, levels, fanout**levels
        self.names = [[f"n{t}_{i}" for i in range(self.width // fanout**t)] for t in range(levels + 1)]

    def blocks(self, nodes, payload=()):
        """nodes (tree, pos, node, height, payload) -> a row for each block: `left`, the levels that
        count here, `top`, its node after them, the slots of all levels, and the payload by slot."""
        slot = F.pmod("pos", F.lit(self.width))
        values = F.struct("node", *payload)
        spread = [F.max(F.when(slot == i, values)).alias(f"slot_{i}") for i in range(self.width)]
        rows = nodes.groupBy("tree", "height", F.floor(F.col("pos") / self.width).alias("block")).agg(*spread)
        rows = rows.withColumns({name: F.col(f"slot_{i}.node") for i, name in enumerate(self.names[0])})
        for below, own in zip(self.names, self.names[1:]):
            runs = [below[i * self.fanout:(i + 1) * self.fanout] for i in range(len(own))]
            rows = rows.withColumns({name: F.when(F.col(run[0]).isNotNull(), digest(*map(F.col, run)))
                                     for name, run in zip(own, runs)})
        left = F.least("height", F.lit(self.levels))
        return rows.withColumn("left", left).withColumn(
            "top", F.element_at(F.array(*[F.col(level[0]) for level in self.names]), F.col("left") + 1))

    def climbed(self, nodes, payload=()):
        """Block tables from the leaves to the root, and (tree, root)."""
        tables, roots = [], []
        while True:
            blocks = materialize(self.blocks(nodes, payload if not tables else ()), "blocks")
            tables.append(blocks)
            roots.append(blocks.where(F.col("height") <= self.levels).select("tree", F.col("top").alias("root")))
            nodes = blocks.where(F.col("height") > self.levels).select(
                "tree", F.col("block").alias("pos"), F.col("top").alias("node"), (F.col("height") - self.levels).alias("height"))
            if nodes.isEmpty():
                break
        out = roots[0]
        for more in roots[1:]:
            out = out.unionByName(more)
        return tables, out

    def step(self, level, own):
        """What stands before and behind slot `own` of its run on one level."""
        nodes, f = F.array(*map(F.col, self.names[level])), self.fanout
        run = F.floor(own / f) * f
        at = [F.coalesce(F.element_at(nodes, (run + m + 1).cast("int")), F.lit("")) for m in range(f)]
        before = [F.when(own % f > m, at[m]).otherwise("") for m in range(f)]
        behind = [F.when(own % f < m, at[m]).otherwise("") for m in range(f)]
        return F.struct(F.concat(*before).alias("before"), F.concat(*behind).alias("behind"))

    def descended(self, tables, payload=()):
        """(tree, pos, node, payload, path) of every leaf; path: a step for each level, lowest first."""
        above = None
        for blocks in reversed(tables):
            keep = ["tree", "block", "left", *self.names[0], *(n for level in self.names[1:-1] for n in level)]
            rows = blocks.select(*keep, F.array(*[F.col(f"slot_{i}") for i in range(self.width)]).alias("slots"))
            if above is None:
                rows = rows.withColumn("above", F.lit(None).cast(f"array<{STEP}>"))
            else:
                rows = rows.join(above.select("tree", F.col("pos").alias("block"), F.col("path").alias("above")),
                                 ["tree", "block"], "left")
            rows = rows.select("*", F.posexplode("slots").alias("slot", "own")).where("own is not null")
            steps = [self.step(t, F.floor(F.col("slot") / self.fanout**t)) for t in range(self.levels)]
            path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("left")),
                            F.coalesce("above", F.array().cast(f"array<{STEP}>")))
            fields = ["node", *payload] if blocks is tables[0] else ["node"]
            above = rows.select("tree", (F.col("block") * self.width + F.col("slot")).alias("pos"),
                                *[F.col(f"own.{c}").alias(c) for c in fields], path.alias("path"))
        return above


def proof(path):
    """H of the siblings of all levels."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.behind)), ""))


def folded(leaf, path):
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.before, node, s.behind), 256))


def manifest(rows, group="lang", key="doc_id", fields=FIELDS, changed=None, fanout=2, levels=None,
             rows_per_range=ROWS_PER_BUCKET):
    """(key, group, leaf, subroot, root, path, changed_leaf) for every row.

    `path` leads from the leaf over the root of its group to the root of all. `changed` maps names of
    fields to other values; `changed_leaf` is the hash with those, null where `changed` gives null.
    """
    if levels is None:
        levels = next(k for k in (4, 3, 2, 1) if fanout**k <= 16 or k == 1)
    pivot = Pivot(fanout, levels)
    plain = leaf_hash([F.col(f) for f in fields])
    other = F.lit(None).cast("string")
    if changed:
        altered = F.coalesce(*[v.cast("string") for v in changed.values()]).isNotNull()
        other = F.when(altered, leaf_hash([F.coalesce(changed[f], F.col(f)) if f in changed else F.col(f) for f in fields]))
    leaves = materialize(rows.select(F.col(group).alias("grp"), F.col(key).alias("id"), plain.alias("node"),
                                     other.alias("changed_leaf")), "leaves")
    sizes = leaves.groupBy("grp").agg(F.count("*").alias("n"))
    trees = placed(sizes.select(F.lit(0).alias("one"), F.col("grp").alias("name"), "n").select(
        F.lit(0).alias("grp"), F.col("name").alias("id"), F.lit("").alias("node"), "n"), sizes.count(), rows_per_range)
    trees = materialize(trees.select(F.col("id").alias("name"), F.col("pos").alias("tree"),
                                     height(F.col("n"), fanout).alias("height")), "trees")
    count = trees.count()
    at = placed(leaves, leaves.count(), rows_per_range)
    nodes = (at.join(trees, at["grp"].eqNullSafe(trees["name"]))
             .select("tree", "height", "pos", "node", "id", "changed_leaf"))
    tables, roots = pivot.climbed(nodes, ("id", "changed_leaf"))
    roots = materialize(roots, "roots")
    high, top = pivot.climbed(roots.select(
        F.lit(0).alias("tree"), height(F.lit(count), fanout).alias("height"), F.col("tree").alias("pos"), F.col("root").alias("node")))
    over = pivot.descended(high).select(F.col("pos").alias("tree"), F.col("node").alias("subroot"), F.col("path").alias("over"))
    names = trees.select("tree", F.col("name").alias(group)).join(over, "tree").crossJoin(
        F.broadcast(top.select("root")))  # one row at most
    found = pivot.descended(tables, ("id", "changed_leaf"))
    return found.join(names, "tree").select(
        F.col("id").alias(key), group, F.col("node").alias("leaf"), "subroot", "root",
        F.concat("path", "over").alias("path"), "changed_leaf")


def verified(rows, **options):
    """`manifest` with proof_sha256, folded_root (from changed_leaf, else the leaf) and verified."""
    found = manifest(rows, **options)
    return found.select("*", proof(F.col("path")).alias("proof_sha256"),
                        folded(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def oracle():
    """SQL of the results of op12 (fanout 2, n_chars changed where 7 divides the id's crc32) in DuckDB,
    which has no crc32: documents that are tampered with are told by a table-free bitwise loop."""
    def leaf(n_chars):
        values = [f"CAST({v} AS VARCHAR)" for v in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(" + " || ".join(
            f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"

    def climb(name, source):
        return f"""{name} AS (
  SELECT tree, 0 AS level, pos, node, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""

    def steps(nodes, own, base):
        return f"""SELECT o.id, s.level + {base} AS level, (o.pos >> s.level) % 2 AS side, s.node
  FROM {own} o JOIN (SELECT *, pos AS at FROM {nodes} WHERE n > 1) s
  ON s.tree = o.tree AND s.at = xor(CAST(o.pos >> s.level AS BIGINT), CAST(1 AS BIGINT))"""
    bit = "list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: ord(c)::BIGINT)), lambda a, c: {bit.replace("list_prepend(x", "list_prepend(xor(a, c)")}), 4294967295)"""
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
         CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (
  SELECT doc_id, tree, leaf AS node, leaf, changed, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         row_number() OVER () AS id
  FROM hashed h JOIN langs l ON h.lang IS NOT DISTINCT FROM l.lang),
{climb("low", "leaves")},
subroots AS (SELECT tree, node FROM low WHERE n = 1),
upper AS (SELECT 0 AS tree, tree AS pos, node, count(*) OVER () AS n FROM subroots),
{climb("high", "upper")},
top AS (SELECT node AS root FROM high WHERE n = 1),
tops AS (SELECT l.id, 0 AS tree, l.tree AS pos FROM leaves l),
step AS ({steps("low", "leaves", 0)}
  UNION ALL {steps("high", "tops", 1000)}),
-- A run of one node has no sibling; its level still hashes the node alone.
levels AS (
  SELECT l.id, w.level FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) w ON w.tree = l.tree
  UNION ALL SELECT l.id, w.level + 1000 FROM leaves l, (SELECT DISTINCT level FROM high WHERE n > 1) w),
walk AS (
  SELECT v.id, row_number() OVER (PARTITION BY v.id ORDER BY v.level) AS k, coalesce(s.side, 0) AS side, coalesce(s.node, '') AS sibling
  FROM levels v LEFT JOIN step s ON s.id = v.id AND s.level = v.level),
proofs AS (SELECT id, sha256(string_agg(sibling, '' ORDER BY k)) AS proof FROM walk GROUP BY id),
fold AS (
  SELECT id, 0 AS k, coalesce(changed, leaf) AS node FROM leaves
  UNION ALL
  SELECT f.id, w.k, CASE w.side WHEN 0 THEN sha256(f.node || w.sibling) ELSE sha256(w.sibling || f.node) END
  FROM fold f JOIN walk w ON w.id = f.id AND w.k = f.k + 1),
ends AS (SELECT id, max_by(node, k) AS folded FROM fold GROUP BY id)
SELECT l.doc_id, l.leaf, r.node AS subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root,
       e.folded = t.root AS verified
FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN ends e ON e.id = l.id LEFT JOIN proofs p ON p.id = l.id, top t"""
