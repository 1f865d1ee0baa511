"""Quality rules with cross-document line frequency.

Base measures are taken from each whole text. The method then hashes every
normalised line (A-Z lower-cased, white space collapsed), counts in how many
distinct documents of its host it stands, removes lines above the limit, and
rejects documents that are depleted by that: fewer than ``MIN_WORDS`` words
are left, or less than ``LEFT_PERCENT`` of them. Exact copies of a text count
as one document, so a text is not rejected for having copies; removing those is
the work of a deduplication step.

The limit is a number of documents, the same for every host, however large or
small. (host, line) pairs are counted with partial sums before each shuffle;
those above the limit are written, and documents meet them by a join of their
(host, line) pairs, which is broadcast if the measured table is small and
sorted with hot lines split if not. What is found goes back to the rows by a
row number given when they were first written.

Defined cases: null or empty text has no words and fails the base rule; a null
host is a host of its own; a line in exactly ``limit`` documents stays; repeated
rows are judged alike and count as one document; a very long text or line is
measured whole by one task; an empty table gives an empty result; extra columns
are ignored unless carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import discard, prepare, rows_by_bytes, staged, text_bytes
from flightlens.llm.wordhash import WordHasher, window_hashes

MIN_WORDS = 20
REPEAT_WIDTH, REPEAT_PERCENT = 8, 30
LINE_LIMIT = 8                         # a line in more documents of a host is boilerplate
LEFT_PERCENT = 20                      # a document with fewer of its words left is depleted
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_START = bytes(range(0x80, 0xC0)) + _SPACE
_hasher: list[WordHasher] = []


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(normal_line(line)) - (1 << 63)


def measure(data: bytes | None) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, words)]."""
    if not _hasher:
        _hasher.append(WordHasher(1))
    data = data or b""
    h = _hasher[0](data)[0]
    repeat = 0
    w = window_hashes(h, REPEAT_WIDTH, 6364136223846793005)
    if len(w):
        _, back, many = np.unique(w, return_inverse=True, return_counts=True)
        at = np.flatnonzero(many[back] > 1)
        if len(at):
            cover = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WIDTH, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    lines, seen, dup = [], set(), 0
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            dup += line in seen
            seen.add(line)
            lines.append((line_hash(line), n))
    return (len(h), len(data.translate(None, _NOT_START)),
            len(data) - len(data.translate(None, b"#*$%&|<>")), dup, repeat, lines)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(carry: list[str]):
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "data"):
            got = [measure(x) for x in batch.column("data").to_pylist()]
            numbers = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
            lines = pa.array([[{"hash": a, "words": b} for a, b in g[5]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + numbers + [lines],
                                             [*carry, *_MEASURES, "lines"])
    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          limit: int = LINE_LIMIT, left_percent: int = LEFT_PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row: ``doc_id, *carry``, the measures, ``boilerplate`` (hashes of the row's lines
    above the limit), ``n_removed`` (words in them), ``base_failed``, ``kept``."""
    result = {"doc_id", "host", "copy", "row", "data", *_MEASURES, "lines", "boilerplate", "n_removed", "base_failed", "kept"}
    if clash := result & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    prepare(docs.sparkSession)
    # nulls become a value of their own: 'h' before a host, 'n' for none
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry,
                         F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n")).alias("host"),
                         F.xxhash64(F.col(text_col).cast("string"), F.octet_length(F.col(text_col).cast("string"))).alias("copy"),
                         F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("data"))
    keep = ["doc_id", *carry, "host", "copy", "row"]
    kinds = dict(source.dtypes)
    per = staged(source.mapInArrow(_measure(keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", "
                                   + ", ".join(f"{m} long" for m in _MEASURES)
                                   + ", lines array<struct<hash: long, words: long>>"))
    often = staged(per.select("host", "copy", F.explode(F.array_distinct("lines.hash")).alias("hash")).distinct()
                   .groupBy("host", "hash").agg(F.count("*").alias("times")).filter(F.col("times") > limit).drop("times"))
    lines = per.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.words")
    found = staged(lines.join(often, ["host", "hash"])
                   .groupBy("row").agg(F.sum("words").alias("n_removed"), F.collect_set("hash").alias("boilerplate")))
    discard(docs.sparkSession, often)
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
    left = f"n_words - n_removed >= {MIN_WORDS} AND 100 * (n_words - n_removed) >= {left_percent} * n_words"
    return (per.join(found, "row", "left")
            .withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<bigint>")))
            .withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
            .withColumn("base_failed", F.expr(failed)).withColumn("kept", F.expr(f"NOT base_failed AND {left}"))
            .select("doc_id", *carry, *_MEASURES, "boilerplate", "n_removed", "base_failed", "kept"))


def without_lines(batches_text: str, batches_hashes: str):
    """For ``mapInArrow``: drop the lines whose hash is in the row's list; other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(batches_text).to_pylist(), batch.column(batches_hashes).to_pylist()):
                if text is not None and gone:
                    gone = set(gone)
                    text = "\n".join(x for x in text.split("\n") if not x.split() or line_hash(x.encode()) not in gone)
                texts.append(text)
            at = batch.schema.get_field_index(batches_text)
            yield batch.set_column(at, batches_text, pa.array(texts, pa.string()))
    return run


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", *_MEASURES, "base_failed", "kept")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The digest computed naively from (doc_id, text, source) rows (for tests)."""
    hosts: dict = {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text)
    limit = {}
    for host, texts in hosts.items():
        n = Counter(x for t in texts for x in {normal_line(y) for y in (t or "").encode().split(b"\n") if y.split()})
        limit[host] = {x for x, k in n.items() if k > LINE_LIMIT}
    out = []
    for doc, text, host in rows:
        data = (text or "").encode()
        words = [w.decode() for w in data.split()]
        grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in data.split(b"\n") if x.split()]
        gone = sum(len(x.split()) for x in lines if normal_line(x) in limit[host])
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
                    len(lines) - len(set(lines)), len(hit), failed,
                    not failed and len(words) - gone >= MIN_WORDS and 100 * (len(words) - gone) >= LEFT_PERCENT * len(words)))
    return out
