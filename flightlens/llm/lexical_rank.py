"""Ranked lexical search of many queries at once, sharing common subexpressions.

The score of a document for an item is a sum over the item's terms, so a set
of terms that several items share is a common subexpression: its partial score
per document (its accumulator) needs to be summed once. The sets are mined from
the items: terms that belong to one item only are its own; the shared ones are
put in order of how many items hold them, and pairs of neighbours that occur in
two items or more are replaced by a new node, the most frequent first, until no
pair is left (``share``). Nodes stand for term sets; items and nodes form a
directed acyclic graph. A document shard's accumulators are materialised node
by node, each from its two parts, and items are combined from the nodes and
terms left in them.

The corpus is split into terms once: what is written is, per document, the
terms that occur in some item with their counts. From this table come the
document frequencies (partial counts per task) and then the scores. A task
keeps the best ``k`` documents per item so far; only these leave it, and they
are merged in two steps, first in several groups per item. So what is shuffled
does not grow with the number of matching documents, and nothing is collected
but the items.

The items are read in blocks of ``BLOCK_BYTES`` of terms; what a block sends to
the tasks is bounded by that. With more than one block, the corpus is scanned
once per block.

Defined cases: a null or empty document has no terms, does not count in N and
never matches; a null or empty item has no rows; items with one id are one item
(a null id is one, too); repeated documents are ranked one by one, next to each
other; equal scores go by document id, null first; a term that all or nearly all
documents hold may weigh 0, and a document that matches by such terms alone is
not ranked; an empty table gives no rows; a very long text is counted whole, by
one task; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightlens.llm.decontamination import words_of
from flightlens.llm.runtime import forget, prepare, rows_by_bytes, staged, text_bytes

TOP = 50
BLOCK_BYTES = 1 << 20         # terms of items handled at a time
SHARD_ROWS = 4096             # documents whose accumulators are held at a time, at most
SHARD_CELLS = 4 << 20         # accumulators times documents, at most
SPREAD = 64                   # groups per item in the first of the two merges


# --- the items -----------------------------------------------------------------------------------------------------

def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_by_bytes(batches, "data"):
        items, terms = [], []
        for item, data in zip(batch.column("item_id").to_pylist(), batch.column("data").to_pylist()):
            mine = set(words_of(data))
            items += [item] * len(mine)
            terms += mine
        yield pa.RecordBatch.from_arrays([pa.array(items, batch.schema.field("item_id").type), pa.array(terms, pa.binary())],
                                         ["item_id", "term"])


def share(items: list[list[int]], terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, items in nodes and terms): node ``i`` has the number ``terms + i`` and two parts of smaller numbers."""
    held = Counter(t for item in items for t in item)
    left = [sorted(item, key=lambda t: (-held[t], t)) for item in items]      # the shared terms in front
    nodes: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for item in left for p in zip(item, item[1:]) if held[p[0]] > 1 and held[p[1]] > 1)
        named: dict[tuple[int, int], int] = {}
        used: set[int] = set()
        for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and a not in used and b not in used:                      # no two pairs of a round overlap
                named[a, b] = terms + len(nodes)
                nodes.append((a, b))
                used |= {a, b}
        if not named:
            return nodes, left
        for k, item in enumerate(left):
            out, i = [], 0
            while i < len(item):
                node = named.get((item[i], item[i + 1])) if i + 1 < len(item) else None
                out.append(item[i] if node is None else node)
                i += 1 if node is None else 2
            left[k] = out
        held = Counter(t for item in left for t in item)


class Plan:
    """A block of items as a graph over term numbers."""

    def __init__(self, items: dict[object, list[bytes]]):
        self.ids = list(items)
        self.vocabulary: dict[bytes, int] = {}
        sets = [[self.vocabulary.setdefault(t, len(self.vocabulary)) for t in sorted(terms)] for terms in items.values()]
        self.nodes, self.items = share(sets, len(self.vocabulary))
        self.weight: np.ndarray | None = None

    def weigh(self, documents: int, length: int, df: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1)))
                                for t in range(len(self.vocabulary))], dtype=np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, score per document of a shard), from its postings: row in the shard, term, occurrences."""
        size = len(n_terms)
        part = 20 * (100 - 50 + np.array([(50 * n * self.documents) // self.length for n in n_terms.tolist()], dtype=np.int64))
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + part[doc]))
        order = np.argsort(term, kind="stable")
        doc, value = doc[order], value[order]
        ends = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        first = len(self.vocabulary)
        whole: list[np.ndarray | None] = []

        def add(to: np.ndarray, what: int) -> bool:
            if what >= first:
                if whole[what - first] is None:
                    return False
                to += whole[what - first]
                return True
            mine = slice(ends[what], ends[what + 1])
            to[doc[mine]] += value[mine]                # a term has one posting per document
            return mine.stop > mine.start

        for a, b in self.nodes:
            acc = np.zeros(size, dtype=np.int64)
            some = add(acc, a)
            whole.append(acc if add(acc, b) or some else None)
        for k, parts in enumerate(self.items):
            acc = np.zeros(size, dtype=np.int64)
            if any([add(acc, p) for p in parts]):
                yield k, acc


# --- the corpus ----------------------------------------------------------------------------------------------------

def _postings(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = plan.value.vocabulary.get
        for batch in rows_by_bytes(batches, "data"):
            n, terms, tfs = [], [], []
            for data in batch.column("data").to_pylist():
                words = words_of(data)
                n.append(len(words))
                found = np.array([t for t in map(get, words) if t is not None], dtype=np.int64)
                t, f = np.unique(found, return_counts=True)
                terms.append(t)
                tfs.append(f)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n_terms", "terms", "tfs"])
    return run


def _statistics(plan):
    """Per task: documents and lengths (term -1) and the documents that hold a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(plan.value.vocabulary), dtype=np.int64)
        documents = length = 0
        for batch in batches:
            n = batch.column("n_terms").to_numpy()
            documents += int((n > 0).sum())
            length += int(n.sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, seen), pa.int32()), pa.array(np.append(documents, df[seen]), pa.int64()),
             pa.array(np.append(length, np.zeros(len(seen), dtype=np.int64)), pa.int64())], ["term", "documents", "length"])
    return run


class _Best:
    """The best ``k`` documents of an item so far, by score, then document id, null first."""

    __slots__ = ("k", "score", "known", "doc")

    def __init__(self, k: int):
        self.k = k
        self.score = self.doc = np.empty(0, dtype=np.int64)
        self.known = np.empty(0, dtype=bool)

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        least = self.score[-1] if len(self.score) == self.k else 1
        if len(score) > self.k:
            least = max(least, int(np.partition(score, len(score) - self.k)[len(score) - self.k]), 1)
        take = np.flatnonzero(score >= least)           # all ties of the last place are compared
        if not len(take):
            return
        score = np.concatenate([self.score, score[take]])
        known = np.concatenate([self.known, known[take]])
        doc = np.concatenate([self.doc, doc[take]])
        order = np.lexsort((doc, known, -score))[:self.k]
        self.score, self.known, self.doc = score[order], known[order], doc[order]


def _search(plan, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = plan.value
        best = [_Best(top) for _ in graph.items]
        rows = max(1, min(SHARD_ROWS, SHARD_CELLS // (len(graph.nodes) + 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                terms = part.column("terms")
                doc = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                docs = ids.fill_null(0).to_numpy()
                for k, score in graph.scores(doc, terms.flatten().to_numpy(), part.column("tfs").flatten().to_numpy(),
                                             part.column("n_terms").to_numpy()):
                    best[k].add(score, known, docs)
        for at in range(0, len(best), 256):
            mine = best[at:at + 256]
            many = [len(b.score) for b in mine]
            if sum(many):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(at, at + len(mine)), many), pa.int32()),
                     pa.array(np.concatenate([b.doc for b in mine]), pa.int64(), mask=~np.concatenate([b.known for b in mine])),
                     pa.array(np.concatenate([b.score for b in mine]), pa.int64())], ["item", "doc_id", "score"])
    return run


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows per item: in groups of an item first, then over the groups."""
    best = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    some = found.withColumn("spread", spread).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item", "spread").orderBy(*best))).filter(f"rank <= {top}")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(f"rank <= {top}") \
        .drop("spread")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema[item_col].dataType.simpleString()
    terms = staged(items.select(F.col(item_col).alias("item_id"), text_bytes(item_text).alias("data"))
                   .mapInArrow(_terms, f"item_id {kind}, term binary").distinct())
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(8))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    out = None
    for b in range(blocks):
        mine = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64(F.lit(7), "item_id"), F.lit(blocks)) == b)
        block: dict[object, list[bytes]] = {}
        for row in mine.collect():
            block.setdefault(row["item_id"], []).append(bytes(row["term"]))
        part = _search_block(texts, dict(sorted(block.items(), key=lambda x: (x[0] is not None, str(x[0])))), kind, top)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(texts: DataFrame, items: dict, kind: str, top: int) -> DataFrame:
    spark = texts.sparkSession
    plan = Plan(items)
    words = spark.sparkContext.broadcast(plan)
    postings = staged(texts.mapInArrow(_postings(words), "doc_id long, n_terms long, terms array<int>, tfs array<long>"))
    counted = {r["term"]: (r["documents"], r["length"]) for r in postings.mapInArrow(
        _statistics(words), "term int, documents long, length long").groupBy("term").agg(
        F.sum("documents").alias("documents"), F.sum("length").alias("length")).collect()}
    documents, length = counted.pop(-1, (0, 0))
    plan.weigh(documents, length, {t: n for t, (n, _) in counted.items()})
    found = staged(postings.filter("size(terms) > 0").mapInArrow(_search(spark.sparkContext.broadcast(plan), top),
                                                                 "item int, doc_id long, score long"))
    forget(spark, postings)
    names = spark.createDataFrame(list(enumerate(plan.ids)), f"item int, item_id {kind}")
    return _merged(found, top).join(names, "item").select("item_id", "rank", "doc_id", "score")


def brute_force(rows: list[tuple], items: list[tuple], top: int = TOP) -> list[tuple]:
    """The same rows, document by document and term by term (for tests)."""
    counted = [(doc, Counter(words_of((text or "").encode()))) for doc, text in rows]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    terms: dict = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words_of((text or "").encode()))
    out = []
    for item, mine in terms.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counted) + 1))) for t in mine}
        found = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in mine if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return out
