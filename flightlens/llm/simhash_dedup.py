"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two fingerprints that differ in at most ``d`` bits
agree in at least ``8 - d`` byte positions: the guaranteed minimum of shared
positional bytes. The index posts each distinct fingerprint under every set of
``8 - d`` (position, byte) entries, so two fingerprints meet in a posting list
exactly if their tally of shared positional bytes reaches the minimum. A list
fixes ``8 - d`` bytes, so it holds at most ``256 ** d`` different fingerprints
whatever the corpus does: 65,536 for two bits. Inside a list every pair within
the bit distance is found by probing bit flips and verified, but only the
links that join two groups of the list are emitted (a spanning forest), never
all pairs. Components of the links give each document its group.

Defined cases: null or empty text, or one without words, has fingerprint 0 and
is linked like any other; a null id is kept with a null component and links
nothing; a bit set in exactly half of the shingles is 0; repeated rows stay
repeated; a very long text is shingled whole, ``_PART`` shingles at a time; an
empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.components import components
from flightlens.llm.runtime import forget, prepare, rows_by_bytes, staged, text_bytes

SHINGLE = 3
DISTANCE = 2
SEED = 42
_PART = 1 << 16                # shingles counted at a time; bounds a long text's memory


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text given as UTF-8."""
    words = data.lower().split()         # bytes.lower() changes A-Z only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[:len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    xx = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _PART):
        h = np.array([xx(joined[a:b], SEED) for a, b in zip(starts[at:at + _PART], ends[at:at + _PART])],
                     dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">u8")[0])


def _prints(shingle: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "data"):
            f = np.array([fingerprint(x or b"", shingle) for x in batch.column("data").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(f.view(np.int64))],
                                             [*carry, "bits"])
    return run


def position_sets(distance: int) -> list[tuple[int, ...]]:
    return list(combinations(range(8), 8 - distance))


def _postings(distance: int):
    """``kind, value, bits, node``: a fingerprint's entry in each posting list."""
    sets = position_sets(distance)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("bits").bitwiseAND(
        F.lit(int(np.array([sum(0xFF << 8 * p for p in keep)], dtype=np.uint64).view(np.int64)[0]))).alias("value"))
        for k, keep in enumerate(sets)])
    return F.explode(kinds)


def forest(bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs within ``distance`` bits that join the groups of one posting list."""
    where = {int(b): i for i, b in enumerate(bits)}
    root = list(range(len(bits)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    varies = 0
    for b in where:
        varies |= b ^ int(bits[0])
    free = [1 << k for k in range(64) if varies >> k & 1]
    flips = [sum(c) for d in range(1, distance + 1) for c in combinations(free, d)]
    links = []
    few = len(bits) <= len(flips)        # then comparing with each is cheaper than probing
    for i, b in enumerate(bits):
        if few:
            gap = np.bitwise_count(bits[i + 1:] ^ b)
            near = (np.flatnonzero(gap <= distance) + i + 1).tolist()
        else:
            near = [j for f in flips if (j := where.get(int(b) ^ f, -1)) > i]
        for j in near:
            a, c = find(i), find(j)
            if a != c:
                root[max(a, c)] = min(a, c)
                links.append((i, j))
    return links


def _links(distance: int):
    """Reads postings sorted by list; one list (of bounded size) in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bits, held_node, held_key = np.empty(0, np.uint64), np.empty(0, np.int64), None
        out: list[tuple[int, int]] = []

        def close(bits, node):
            if len(bits) > 1:
                out.extend((int(node[i]), int(node[j])) for i, j in forest(bits, distance))

        for batch in batches:
            kind, value, bits, node = (batch.column(c).to_numpy() for c in ("kind", "value", "bits", "node"))
            if not len(kind):
                continue
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (value[1:] != value[:-1])) + 1
            edge = np.concatenate([[0], cut, [len(kind)]])
            big = np.flatnonzero(np.diff(edge) > 1)
            bits = bits.view(np.uint64)
            if held_key == (kind[0], value[0]):
                held_bits = np.append(held_bits, bits[:edge[1]])
                held_node = np.append(held_node, node[:edge[1]])
            else:
                close(held_bits, held_node)
                held_bits, held_node = bits[:edge[1]].copy(), node[:edge[1]].copy()
            held_key = (kind[0], value[0])
            if len(edge) > 2:
                close(held_bits, held_node)
                for g in big:
                    if 0 < g < len(edge) - 2:
                        close(bits[edge[g]:edge[g + 1]], node[edge[g]:edge[g + 1]])
                held_bits, held_node = bits[edge[-2]:].copy(), node[edge[-2]:].copy()
                held_key = (kind[-1], value[-1])
            if len(out) > 100_000:
                yield _pairs(out)
                out.clear()
        close(held_bits, held_node)
        yield _pairs(out)
    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in out], pa.int64()),
                                       "v": pa.array([b for _, b in out], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *carry, bits`` (the fingerprint as a signed long)``, component_id``; a row per input row."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2: beyond that a posting list has no useful bound")
    if clash := {"doc_id", "data", "bits", "of", "component", "component_id"} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, text_bytes(text_col).alias("data"))
    kinds = dict(source.dtypes)
    prints = staged(source.mapInArrow(_prints(shingle, ["doc_id", *carry]),
                                      ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + ", bits long"))
    # written before they are joined back, so that AQE can split the rows of a hot fingerprint
    nodes = staged(prints.filter("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("node")))
    postings = nodes.select("bits", "node", _postings(distance).alias("list")).select("list.*", "bits", "node")
    sizes = postings.groupBy("kind", "value").count().filter("count > 1").select("kind", "value")
    # Spark sizes postings as if the explode gave one row per fingerprint, and would broadcast them: always sort and merge
    links = (postings.join(sizes.hint("merge"), ["kind", "value"]).repartition("kind", "value")
             .sortWithinPartitions("kind", "value", "bits").mapInArrow(_links(distance), "u long, v long"))
    groups = components(links).withColumnRenamed("node", "first")
    named = staged(nodes.join(groups, nodes["node"] == groups["first"], "left").select(
        F.col("bits").alias("of"), F.coalesce("component", "node").alias("component")))
    forget(spark, nodes)
    return prints.join(named, prints["bits"] == named["of"], "left").select(
        "doc_id", *carry, "bits", F.expr("IF(doc_id IS NULL, NULL, component)").alias("component_id"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int | None, str | None]], distance: int = DISTANCE) -> list[tuple]:
    """Every pair compared, on a small list (for tests); fingerprints bit by bit."""
    prints = []
    for _, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    near = defaultdict(set)
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance and None not in (rows[i][0], rows[j][0]):
                near[i].add(j)
                near[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = [], [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            group.append(x)
            todo += [y for y in near[x] if y not in seen]
            seen |= near[x]
        for x in group:
            out[x] = (rows[x][0], f"{prints[x]:016x}",
                      None if rows[x][0] is None else min(rows[y][0] for y in group if rows[y][0] is not None))
    return out
