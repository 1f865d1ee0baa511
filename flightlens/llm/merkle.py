"""A Merkle manifest of a dataset, kept as append logs in postorder.

Each document is a leaf; the leaves of a language, by document id, form a
binary tree, and the roots of these trees, by language, form one more tree,
whose root stands for the dataset. A node is the SHA-256 of its one or two
children's digests (hex text, joined); the last node of a level may have one
child.

A tree is written as a log: its nodes in the order in which an appending
writer completes them, that is in postorder. So a node's place in the log
follows from subtree sizes alone: before the first node under leaf ``s`` lie
``sum(s >> i) = 2 s - popcount(s)`` nodes, and the node itself ends its
subtree (``place``). Builders work on aligned blocks of ``2 ** BITS`` leaves,
one after the other in a task; the block roots are the leaves of the next
round, until one node is left: about log(n) / BITS rounds, each 1 / 64 of the
one before.

A proof is read from the logs from the top down: a block's nodes answer for
all leaves in it, each sibling addressed by its computed place, and the proof
of the block's own root is put behind. No task holds more than a block.

Leaves are numbered without a global sort in one task: sorted by range,
counted in each task, and moved on by the counts of the tasks before.

Defined cases: a null field is ``-`` in a leaf, so it differs from an empty
one; null languages form a tree of their own, the first one; a null id comes
before all others and is never tampered with; repeated ids are ordered by leaf,
and equal rows, one after the other, have one leaf and a proof each; empty and
very long texts are hashed whole; an empty table gives no rows (and no root);
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightlens.llm.runtime import discard, prepare, staged

BITS = 6                  # a builder's block: 64 leaves
TAMPER = 7                # rows whose id's crc32 this divides are altered by ``alter``
_NODE = "tree string, n long, level int, at long, place long, digest string, id long, name string, altered string"


def _h(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def height(n: int) -> int:
    """The level of the root over ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def subtree(m: int, level: int) -> int:
    """The nodes under and including a node of ``level`` that covers ``m`` leaves."""
    return 2 * m - 1 if m == 1 << level else sum(-(-m >> i) for i in range(level + 1))


def place(n: int, level: int, at: int) -> int:
    """Where the ``at``-th node of ``level`` stands in the log of a tree of ``n`` leaves."""
    first = at << level
    return 2 * first - first.bit_count() + subtree(min(1 << level, n - first), level) - 1


def _field(value):
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, id, digest, altered``: a leaf per document and, where tampering changes it, the leaf after that."""
    def leaf(n_chars):
        return F.sha2(F.concat(*[_field(x) for x in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"),
                                                     n_chars, F.col("text"))]), 256)
    n = F.col("n_chars").cast("long")
    tamper = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % TAMPER == 0
    return docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"),
                       leaf(n).alias("digest"),
                       F.when(tamper & n.isNotNull(), leaf(n.cast("decimal(20,0)") + 1)).alias("altered"))


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, local = object(), 0
    for batch in batches:
        out = []
        for t in batch.column("tree").to_pylist():
            tree, local = t, (local + 1 if t == tree else 0)
            out.append(local)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "local"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``tree``) with ``at``, the place in its tree by ``order``, and ``n``, the tree's rows.

    ``rows`` must be a written table: a row number of the scan parts equal rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "scan")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    parts = staged(rows.withColumn("scan", F.monotonically_increasing_id()).repartitionByRange(*keys)
                   .sortWithinPartitions(*keys).drop("scan").withColumn("part", F.spark_partition_id())
                   .mapInArrow(_count_on, f"{kinds}, part int, local long"))
    by_tree = Window.partitionBy("tree")
    counts = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("tree").alias("of"), F.col("part").alias("of_part"), F.sum("rows").over(by_tree).alias("n"),
        (F.sum("rows").over(by_tree.orderBy("part")) - F.col("rows")).alias("before"))
    return (parts.join(counts, F.col("part").eqNullSafe(F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of")))
            .withColumn("at", F.col("before") + F.col("local")).drop("of", "of_part", "part", "before", "local"))


def _builder(low: int):
    """Nodes of the levels above ``low`` in completion order; a round's first level is also written if it is the leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, str] = {}          # left children that wait for the right one: at most BITS
        for batch in batches:
            rows = []
            for tree, n, at, node, ident, name, altered in zip(*(batch.column(c).to_pylist() for c in (
                    "tree", "n", "at", "digest", "id", "name", "altered"))):
                top, level = min(low + BITS, height(n)), low
                if not low:
                    rows.append((tree, n, 0, at, place(n, 0, at), node, ident, name, altered))
                while level < top:
                    if at & 1:
                        node = _h(pending[level] + node)
                    elif at == (n - 1) >> level:
                        node = _h(node)
                    else:
                        pending[level] = node
                        break
                    at >>= 1
                    level += 1
                    rows.append((tree, n, level, at, place(n, level, at), node, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, _TYPES)], _NAMES)
    return run


_NAMES = ["tree", "n", "level", "at", "place", "digest", "id", "name", "altered"]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]


class Log:
    """The logs of all trees over ``rows`` (``tree, n, at, digest, id, name, altered``), one written table a round."""

    def __init__(self, rows: DataFrame):
        self.rounds: list[DataFrame] = []
        most = None
        while True:
            low = BITS * len(self.rounds)
            dealt = rows.withColumn("block", F.shiftright("at", BITS)).repartition("tree", "block")
            built = staged(dealt.sortWithinPartitions("tree", "block", "at").mapInArrow(_builder(low), _NODE))
            self.rounds.append(built)
            if most is None:
                most = built.agg(F.max("n")).first()[0] or 0
            low += BITS
            if most <= 1 << low:
                break
            rows = built.filter(f"level = {low} AND n > {1 << low}")

    def nodes(self) -> DataFrame:
        """The logs: ``tree, place`` and what stands there; a tree's rows by place are its log."""
        out = self.rounds[0]
        for more in self.rounds[1:]:
            out = out.unionByName(more)
        return out

    def roots(self) -> DataFrame:
        """``tree, n, digest``: the last node of each tree's log."""
        parts = [r.filter(f"n <= {1 << BITS * (k + 1)}" + (f" AND n > {1 << BITS * k}" if k else ""))
                 .filter("level = CASE WHEN n = 1 THEN 0 ELSE length(bin(n - 1)) END").select("tree", "n", "digest")
                 for k, r in enumerate(self.rounds)]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """``tree, at, id, name, digest, altered, steps, subroot`` per leaf.

        ``above`` has per tree ``tree, n, subroot, steps``: what follows the tree's own part of a proof.
        """
        found = None
        for k in reversed(range(len(self.rounds))):
            low, high = BITS * k, BITS * (k + 1)
            mine = self.rounds[k].filter(f"level < {high}")
            if k:
                mine = mine.unionByName(self.rounds[k - 1].filter(f"level = {low}"))
            blocks = mine.filter(f"n > {1 << low}" if k else "true").select(
                "tree", F.expr(f"at >> ({high} - level)").alias("block"), "place", "n", "level", "at", "digest", "id",
                "name", "altered", F.lit(None).cast("string").alias("steps"), F.lit(None).cast("string").alias("subroot"))
            heads = above.filter(f"n <= {1 << high}" + (f" AND n > {1 << low}" if k else "")).select(
                "tree", F.lit(0).cast("long").alias("at"), "n", "subroot", "steps")
            if found is not None:
                heads = heads.unionByName(found.select("tree", "at", "n", "subroot", "steps"))
            heads = heads.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("place"), "n",
                                 F.lit(-1).alias("level"), F.lit(0).cast("long").alias("at"),
                                 *[F.lit(None).cast(t).alias(c) for c, t in (
                                     ("digest", "string"), ("id", "long"), ("name", "string"), ("altered", "string"))],
                                 "steps", "subroot")
            found = (blocks.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
                     .mapInArrow(_prover(low), _PROOF))
        return found


_PROOF = "tree string, n long, at long, id long, name string, digest string, altered string, steps string, subroot string"
_PROOF_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
_PROOF_NAMES = ["tree", "n", "at", "id", "name", "digest", "altered", "steps", "subroot"]


def _prover(low: int):
    """Proofs of the nodes of level ``low``: siblings in their block by computed place, then the block root's own proof."""
    def prove(head, nodes, children):
        out = []
        if head is None:
            return out
        tree, n, rest, subroot, _ = head
        top = min(low + BITS, height(n))
        for at, ident, name, digest, altered in children:
            steps, j = [], at
            for level in range(low, top):
                if j & 1:
                    steps.append("L" + nodes[place(n, level, j - 1)])
                elif j == (n - 1) >> level:
                    steps.append("-")                     # an only child
                else:
                    steps.append("R" + nodes[place(n, level, j + 1)])
                j >>= 1
            out.append((tree, n, at, ident, name, digest, altered, " ".join(steps + [rest] if rest else steps), subroot))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, nodes, children = None, {}, []
        out = []
        for batch in batches:
            for tree, block, pos, n, level, at, digest, ident, name, altered, steps, subroot in zip(*(
                    batch.column(c).to_pylist() for c in ("tree", "block", "place", "n", "level", "at", "digest", "id",
                                                          "name", "altered", "steps", "subroot"))):
                if pos < 0:                               # sorts before the block's nodes
                    out += prove(head, nodes, children)
                    head, nodes, children = (tree, n, steps, subroot, block), {}, []
                    continue
                if head is None or (head[0], head[4]) != (tree, block):
                    raise ValueError(f"no proof for the root of block {block} of tree {tree!r}")
                nodes[pos] = digest
                if level == low:
                    children.append((at, ident, name, digest, altered))
            if out:
                yield _proof_batch(out)
                out = []
        out += prove(head, nodes, children)
        if out:
            yield _proof_batch(out)
    return run


def _proof_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PROOF_TYPES)], _PROOF_NAMES)


def fold(leaf: str, steps: str) -> str:
    """The root that follows from a leaf and its proof."""
    for step in steps.split():
        leaf = _h(leaf if step == "-" else step[1:] + leaf if step[0] == "L" else leaf + step[1:])
    return leaf


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = [fold(a or d, s) for a, d, s in zip(*(batch.column(c).to_pylist() for c in ("altered", "digest", "steps")))]
        names = [c for c in batch.schema.names if c != "altered"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(folded, pa.string())], [*names, "folded"])


def manifest(docs: DataFrame) -> tuple[Log, Log, str | None]:
    """The logs of the language trees, that of the tree over their roots, and the root of all."""
    spark = docs.sparkSession
    prepare(spark)
    hashed = staged(leaves(docs))
    trees = Log(numbered(hashed, ["id", "digest"]).withColumn("name", F.lit(None).cast("string")))
    discard(spark, hashed)
    subroots = staged(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("id"), "digest",
                                           F.lit(None).cast("string").alias("altered")))
    whole = Log(numbered(subroots, ["name"]))
    root = whole.roots().select("digest").first()
    return trees, whole, root[0] if root else None


def prove_all(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, at, leaf, subroot, root, steps, folded_root, verified``, a row per document.

    ``steps`` is the proof: per level ``L`` or ``R`` (side of the sibling) and its digest, or ``-`` for an only child,
    through the language's tree and the tree over the languages. ``folded_root`` follows from the proof and the leaf
    after tampering (``leaves``); it differs from ``root`` where that changed the leaf.
    """
    trees, whole, root = manifest(docs)
    start = whole.roots().select("tree", "n", F.col("digest").alias("subroot"), F.lit("").alias("steps"))
    above = staged(whole.proofs(start).select(F.col("name").alias("tree"), F.col("id").alias("n"),
                                              F.col("digest").alias("subroot"), "steps"))
    kinds = "tree string, n long, at long, id long, name string, digest string, steps string, subroot string, folded string"
    return (trees.proofs(above).mapInArrow(_fold_all, kinds)
            .select(F.col("id").alias("doc_id"), F.col("tree").alias("lang"), "at", F.col("digest").alias("leaf"), "subroot",
                    F.lit(root).cast("string").alias("root"), "steps", F.col("folded").alias("folded_root"),
                    (F.col("folded") == F.lit(root)).alias("verified")))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The digest of rows ``(doc_id, text, lang, source, n_chars)``, computed level by level (for tests)."""
    import zlib

    def one(values):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, at):
        out = []
        for level in tree[:-1]:
            out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
            at >>= 1
        return out

    trees: dict = {}
    for doc, text, lang, source, n in rows:
        change = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % TAMPER == 0
        leaf = one((doc, source, lang, n, text))
        trees.setdefault(lang, []).append(
            ((doc is not None, doc or 0), leaf, doc, one((doc, source, lang, n + 1, text)) if change else leaf))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {t: levels([r[1] for r in sorted(trees[t], key=lambda r: r[:2])]) for t in names}
    top = levels([built[t][-1][0] for t in names]) if names else []
    out = []
    for k, t in enumerate(names):
        for at, (_, leaf, doc, altered) in enumerate(sorted(trees[t], key=lambda r: r[:2])):
            steps, node = path(built[t], at) + path(top, k), altered
            for right, other in steps:
                node = _h(node if other is None else other + node if right else node + other)
            out.append((doc, leaf, built[t][-1][0], top[-1][0], _h("".join(o for _, o in steps if o)), node, node == top[-1][0]))
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "leaf", "subroot", "root",
                         F.sha2(F.translate("steps", "LR- ", ""), 256).alias("proof_sha256"), "folded_root", "verified")
