"""Substring deduplication by recompression.

Removes every word that is covered by a window of ``width`` consecutive words
whose word sequence also starts in a document with a smaller id.

1. Each document is parsed by recompression (``recompression.py``): rounds
   that name runs and pairs of words. Names are the same everywhere, so equal
   stretches of text hold equal interior symbols. Each window is given one
   high-level symbol inside it.
2. Symbols that stand in two or more documents are found with one grouped
   aggregation (partial before the shuffle, so a symbol of a third of all
   documents arrives as one row per task).
   A document equal to an earlier one is settled as a whole.
3. Only windows given such a shared symbol can repeat. They alone get a
   128-bit hash of their words, which decides: the smallest document id of
   each hash, joined back (the join's large groups are split by AQE).
4. The removed words go, the rest is joined by single spaces.

Defined cases: null or empty text has no words (n_words 0, hash of the empty
string); a null id is never smaller than another, and its row keeps all words;
rows with one id are separate documents of equal rank, neither removes words
from the other; rows alike in id and text are one document, given as often as
they stand; a very long text is parsed and cut by one task, hashed a block at a
time; an empty table gives no rows; other columns of the input are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm import recompression
from flightlens.llm.runtime import discard, prepare, rows_by_bytes, staged, text_bytes
from flightlens.llm.wordhash import WordHasher, window_hashes

WIDTH = 50
LEVELS = 8
EVERYWHERE = -1                 # stands for all windows of a document
_SPAN = 6                       # bits for the number of windows of one symbol, less one
_BASES = (6364136223846793005, 2862933555777941757)
_hashers: dict[int, WordHasher] = {}


def _hasher(lanes: int) -> WordHasher:
    if lanes not in _hashers:
        _hashers[lanes] = WordHasher(lanes)
    return _hashers[lanes]


def _once(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Without rows that the task has had before: repeats have the same windows, and are cut by the same list."""
    new = []
    for row in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(),
                   pc.binary_length(batch.column("data")).to_pylist()):
        new.append(row not in seen)
        seen.add(row)
    return batch.filter(pa.array(new, pa.bool_()))


def _parse(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(1)
        seen: set = set()
        for batch in rows_by_bytes((_once(b, seen) for b in batches), "data"):
            words = [hasher(x or b"")[0] for x in batch.column("data").to_pylist()]
            first = np.append(0, np.cumsum([len(w) for w in words]))
            name, frm, to = recompression.anchors(np.concatenate(words), first, width, LEVELS)
            if not len(name):
                continue
            row = np.searchsorted(first, frm, side="right") - 1
            span = (frm - first[row]) << _SPAN | (to - frm)
            yield pa.RecordBatch.from_pydict({
                "name": pa.array(name.view(np.int64)),
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "key": batch.column("key").take(pa.array(row)),
                "span": pa.array(span)})
    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(2)
        seen: set = set()
        for batch in rows_by_bytes((_once(b, seen) for b in batches), "data"):
            for data, doc, key, spans in zip(*(batch.column(c).to_pylist() for c in ("data", "doc_id", "key", "spans"))):
                lanes = hasher(data)
                spans = np.asarray(spans, dtype=np.int64)
                frm, more = spans >> _SPAN, spans & ((1 << _SPAN) - 1)
                wanted = np.zeros(len(lanes[0]) + 1, dtype=np.int32)
                np.add.at(wanted, frm, 1)
                np.add.at(wanted, frm + more + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted) > 0)
                a, b = (window_hashes(w, width, base)[at] for w, base in zip(lanes, _BASES))
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                    "doc_id": pa.array(np.full(len(at), doc, dtype=np.int64)),
                    "key": pa.array(np.full(len(at), key, dtype=np.int64)),
                    "at": pa.array(at.astype(np.int32))})
    return run


def _cut(width: int, carry: list[str], keep_layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "data"):
            total, gone, kept = [], [], []
            for data, at in zip(batch.column("data").to_pylist(), batch.column("ats").to_pylist()):
                words = (data or b"").split()
                total.append(len(words))
                if at and at[0] == EVERYWHERE:
                    words = words if len(words) < width else []
                elif at:
                    cover = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(cover, np.asarray(at), 1)
                    np.add.at(cover, np.asarray(at) + width, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                gone.append(total[-1] - len(words))
                kept.append(data if keep_layout and not gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                                    pa.array(kept, pa.binary())],
                [*carry, "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WIDTH, carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """``doc_id, *carry, n_words, n_removed, kept`` (binary: the kept words), a row per input row.

    ``carry`` names further input columns to keep; they must not be called
    like a result column. With ``keep_layout`` a document that loses nothing
    keeps its text byte for byte. ``width`` is at most 64 words or the span encoding
    would not hold a symbol's windows.
    """
    if not 1 < width <= 1 << _SPAN:
        raise ValueError(f"width must be 2 to {1 << _SPAN}")
    if clash := {"doc_id", "n_words", "n_removed", "kept", "data", "key", "ats"} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"),
                         F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("key"),
                         *carry)
    # a row is its id and the hash of its text: rows that are alike in both are one document
    row = ["doc_id", "key"]
    known = source.filter("doc_id IS NOT NULL AND data IS NOT NULL")
    found = staged(known.select("doc_id", "data", "key")
                   .mapInArrow(_parse(width), "name long, doc_id long, key long, span long"))
    # a document with the same words as an earlier one: all its windows stand there too
    whole = known.select("doc_id", "key", F.md5("data").alias("whole"))
    first = staged(whole.groupBy("whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .filter("lo < hi").select("whole", "lo"))
    copies = staged(whole.join(first, "whole").filter("lo < doc_id").select(*row).distinct())
    # tables of grouped keys are written before they are joined back: then the join's sides are
    # plain shuffles, and AQE can split the rows of a hot key over tasks
    shared = staged(found.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .filter("lo < hi").select("name"))
    discard(spark, first)
    spans = staged(found.join(shared, "name").join(copies, row, "left_anti")
                   .groupBy(*row).agg(F.collect_set("span").alias("spans")))
    discard(spark, found, shared)
    windows = staged(source.select("doc_id", "data", "key").join(spans, row).select("doc_id", "data", "key", "spans")
                     .mapInArrow(_windows(width), "a long, b long, doc_id long, key long, at int"))
    discard(spark, spans)
    least = staged(windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .filter("lo < hi").select("a", "b", "lo"))
    discard(spark)
    gone = staged(windows.join(least, ["a", "b"]).filter("lo < doc_id")
                  .groupBy(*row).agg(F.collect_set("at").alias("ats"))
                  .unionByName(copies.select(*row, F.array(F.lit(EVERYWHERE)).alias("ats"))))
    discard(spark, windows, least, copies)
    keep = ["doc_id", *carry]
    fields = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", n_words long, n_removed long, kept binary"
    return source.join(gone, row, "left").select(*keep, "data", "ats").mapInArrow(_cut(width, keep, keep_layout), schema)


def digest(result: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`remove_repeats`."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The same digest computed naively on a small list (for tests)."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p:p + width])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
