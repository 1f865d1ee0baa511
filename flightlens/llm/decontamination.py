"""Benchmark decontamination with suffix arrays over the training documents.

Every task cuts its documents into shards of bounded size and builds a suffix
array of each: the document positions whose suffix can match a test suffix far
enough, sorted by the words that follow. Each test suffix is then looked up by
binary search; the range it finds holds the places of all its verbatim matches
of at least a window (or of the whole item, if that is shorter). Matches that go
on from one test suffix to the next, in the document and in the item alike, are
one: so each match is as long as it can be, and is given with its item, its place
in the item and its place in the document (``matches``). The union of the matched
places are the hit words (``spans``).

Positions are left out of a suffix array only if no test suffix can match
there for a whole window: a word pair must occur in the benchmark to be part
of a match, so a run of such pairs has to be long enough.

The benchmark is a query set read in blocks of ``BLOCK_BYTES``; a block, and
nothing that grows with the corpus, is sent to the tasks. Documents are not
shuffled if there is one block; with more, they are written once with a row
number, read once per block, and the places found by each block are united per
row.

Defined cases: null or empty document: no words, no hits, not contaminated;
null or empty item: no window; a null item id counts as the empty string;
items with one id are one item, but places are those in its own text, and the
same place of two texts is given once; repeated rows are judged one by one; a
very long text is a shard of its own; an empty table of documents gives no rows,
an empty benchmark hits nothing; extra columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, rows_by_bytes, staged, text_bytes

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SHARE = 20                    # contaminated: 1 / SHARE of the words are hit

# words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; every other byte becomes a space
_TO_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
                 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TO_WORD).split()


class TestBlock:
    """The windows of a block of items: their words, and the items of each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[tuple[str, int]]] = {}
        for item, data in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(data)]
            if ids:
                for p in range(max(1, len(ids) - window + 1)):
                    found.setdefault(tuple(ids[p:p + window]), set()).add((item, p))
        windows = list(found)
        self.places = [sorted(found[w]) for w in windows]      # (item, place in it) of each window
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        self.low = self._keys([w + (0,) * (window - len(w)) for w in windows])
        self.high = self._keys([w + (0xFFFFFFFF,) * (window - len(w)) for w in windows])
        size = len(self.vocabulary) + 1
        self.least = np.full(size, window, dtype=np.int64)     # shortest window that starts with a word
        for w in windows:
            self.least[w[0]] = min(self.least[w[0]], len(w))
        self.starts = np.zeros(size, dtype=bool)
        self.starts[[w[0] for w in windows]] = True
        self.pairs = np.unique(np.array([a * size + b for w in windows for a, b in zip(w, w[1:])], dtype=np.int64))

    def _keys(self, rows) -> np.ndarray:
        return np.array(rows, dtype=">u4").reshape(-1, self.window).view(f"S{4 * self.window}").ravel()

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place): all matches in a shard whose documents are parted by a 0."""
        none = np.empty(0, dtype=np.int64)
        n = len(ids)
        if not n or not len(self.length):
            return none, none
        # how far a match can reach from each place: words of the vocabulary, joined by pairs of the benchmark
        size = len(self.vocabulary) + 1
        linked = np.zeros(n, dtype=bool)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[both] * size + ids[both + 1]
        if len(self.pairs):
            slot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            linked[both] = self.pairs[slot] == code
        stop = np.flatnonzero(~linked)                       # the last place of each run
        reach = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1
        place = np.flatnonzero((ids > 0) & self.starts[ids] & (reach >= self.least[ids]))
        if not len(place):
            return none, none
        # the suffix array: these places, sorted by their next words
        spread = np.minimum(place[:, None] + np.arange(self.window), n)
        keys = self._keys(np.append(ids, 0)[spread])
        order = np.argsort(keys, kind="stable")
        keys, array = keys[order], place[order]
        lo = np.searchsorted(keys, self.low, side="left")
        hi = np.searchsorted(keys, self.high, side="right")
        many = hi - lo
        which = np.repeat(np.arange(len(lo)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return which, array[at]


def _scan(block, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = block.value
        for batch in rows_by_bytes(batches, "data", SHARD_BYTES):
            ids, first = [], [0]
            for data in batch.column("data").to_pylist():
                part = test.ids(words_of(data))
                ids += [part, np.zeros(1, dtype=np.int64)]
                first.append(first[-1] + len(part) + 1)
            first = np.array(first)
            which, place = test.search(np.concatenate(ids))
            rows = len(first) - 1
            spans: list[list[dict]] = [[] for _ in range(rows)]
            matches: list[list[dict]] = [[] for _ in range(rows)]
            order = np.argsort(place, kind="stable")
            which, place = which[order], place[order]
            row = np.searchsorted(first, place, side="right") - 1
            for r in np.unique(row):
                mine = slice(*np.searchsorted(row, [r, r + 1]))
                start = place[mine] - first[r]
                spans[r] = _join(start, start + test.length[which[mine]])
                matches[r] = _longest(test, which[mine].tolist(), start.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(np.diff(first) - 1),
                                                    pa.array(spans, _SPANS), pa.array(matches, _MATCHES)],
                [*carry, "n_words", "spans", "matches"])
    return run


_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))
_FOUND = ("n_words long, spans array<struct<at: long, length: long>>, "
          "matches array<struct<item: string, item_at: long, at: long, length: long>>")


def _longest(test: TestBlock, which: list[int], start: list[int]) -> list[dict]:
    """Matches of one document as long as they can be, from the windows found at ascending places."""
    begun: dict[tuple[str, int, int], list[int]] = {}     # (item, place - place in the item, size): [from, to] in the document
    out: list[tuple[str, int, int, int]] = []
    for w, at in zip(which, start):
        size = int(test.length[w])
        for item, item_at in test.places[w]:
            key = (item, at - item_at, size)
            run = begun.get(key)
            if run and run[1] == at - 1:
                run[1] = at
            else:
                if run:
                    out.append((item, run[0] - key[1], run[0], run[1] - run[0] + size))
                begun[key] = [at, at]
    out += [(item, a - shift, a, b - a + size) for (item, shift, size), (a, b) in begun.items()]
    return [{"item": i, "item_at": p, "at": a, "length": n} for i, p, a, n in sorted(out)]


def _join(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """The union of sorted stretches, as spans."""
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return [{"at": a, "length": b - a} for a, b in zip(start[head].tolist(), reach[np.append(head[1:] - 1, len(end) - 1)].tolist())]


def _unite(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, matches = [], []
            for found, more in zip(batch.column("spans").to_pylist(), batch.column("matches").to_pylist()):
                flat = sorted((s["at"], s["at"] + s["length"]) for part in found for s in part)
                a = np.array(flat, dtype=np.int64).reshape(-1, 2)
                spans.append(_join(a[:, 0], a[:, 1]) if flat else [])
                matches.append(sorted((m for part in more for m in part), key=lambda m: tuple(m.values())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [batch.column("n_words"), pa.array(spans, _SPANS), pa.array(matches, _MATCHES)],
                [*carry, "n_words", "spans", "matches"])
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *carry, n_words, spans, matches, items, n_hit, contaminated``, a row per input row.

    ``matches``: the longest verbatim matches, each with its item, its place in the item, its place in the document and
    its length, in words; ``spans``: the union of their places; ``items``: the items found, sorted as strings.
    """
    if clash := {"doc_id", "n_words", "spans", "matches", "items", "n_hit", "contaminated", "data", "row"} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    prepare(spark)
    test = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            text_bytes(item_text).alias("data")).distinct()     # repeats would all land in one block
    size = test.agg(F.sum(F.octet_length("data") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"), *carry)
    keep = ["doc_id", *carry]
    if blocks > 1:
        source = staged(source.withColumn("row", F.monotonically_increasing_id()))      # numbers are fixed by the write
        keep.append("row")
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {_FOUND}"
    found, more = None, None
    for b in range(blocks):
        mine = test if blocks == 1 else test.filter(F.pmod(F.xxhash64("item", "data"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast(
            TestBlock([(r["item"], bytes(r["data"]) if r["data"] is not None else None) for r in mine.collect()], window))
        part = source.mapInArrow(_scan(block, keep), schema)
        if found is None:
            found = part
        else:
            part = part.filter("size(matches) > 0").select("row", "spans", "matches")
            more = part if more is None else more.unionByName(part)
    if more is not None:
        more = staged(more.groupBy("row").agg(F.collect_list("spans").alias("more_spans"),
                                              F.collect_list("matches").alias("more_matches")))
        found = (found.join(more, "row", "left")
                 .withColumn("spans", F.concat(F.array("spans"), F.coalesce("more_spans", F.array())))
                 .withColumn("matches", F.concat(F.array("matches"), F.coalesce("more_matches", F.array())))
                 .select(*keep, "n_words", "spans", "matches").mapInArrow(_unite(keep), schema))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return (found.withColumn("n_hit", hit).withColumn("items", F.array_sort(F.array_distinct("matches.item")))
            .withColumn("contaminated", F.expr(f"n_hit > 0 AND {SHARE} * n_hit >= n_words"))
            .select("doc_id", *carry, "n_words", "spans", "matches", "items", "n_hit", "contaminated"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def brute_force_matches(text: str | None, items, window: int = WINDOW) -> set[tuple[str, int, int, int]]:
    """(item, place in it, place in the text, length) of the longest matches, word by word (for tests)."""
    words, out = words_of((text or "").encode()), set()
    for item, other in items:
        w = words_of((other or "").encode())
        least = min(window, len(w))
        for p in range(len(w)):
            for q in range(len(words)):
                if (p and q and w[p - 1] == words[q - 1]) or w[p] != words[q]:
                    continue
                n = 0
                while p + n < len(w) and q + n < len(words) and w[p + n] == words[q + n]:
                    n += 1
                if n >= least:
                    out.add(("" if item is None else str(item), p, q, n))
    return out


def brute_force(rows, items, window: int = WINDOW) -> list[tuple]:
    """The same digest computed naively on small lists (for tests)."""
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[p:p + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w = words_of((text or "").encode())
        hit, names = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p:p + size])) in windows:
                    hit.update(range(p, p + size))
                    names |= windows[k]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit) and SHARE * len(hit) >= len(w)))
    return out
