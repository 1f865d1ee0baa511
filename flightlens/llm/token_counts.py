"""Token counts with a whole-token shortcut, for a SentencePiece BPE vocabulary.

Before counting, a worker proves from the vocabulary where a text can be cut
without changing its tokens: if no piece holds a word mark behind another
character, merges never cross the front of a space; if no piece but a byte
piece holds a line break, they never cross one. Then every pre-token (spaces
and the word after them, within a line) is tokenised on its own. Vocabulary
strings that encode alone as one token are found once; pre-tokens equal to one
count as 1, and only the others are merged (and remembered, up to a bound). A
vocabulary that fails the proof is counted text by text with the library.

Defined cases: null or empty text has 0 bytes and 0 tokens; a null id stays; a
text at the limit is not over it; the vocabulary's special strings (``<s>``) in a
text are plain text, as for the library; texts with a word mark are given to the
library whole; a very long text is counted whole by one task; repeated rows are
counted repeatedly; an empty table gives no rows; extra columns are ignored
unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, rows_by_bytes

LIMIT = 4096
CACHE = 800_000                # counts a worker remembers beside the vocabulary
MARK = "▁"
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        multi = [p for p in pieces if len(p) > 1]
        probe = self.model.encode(["\n", "a\nb", "a"], out_type=str)
        self.cuts = (not any(MARK in p.lstrip(MARK) or "\n" in p for p in multi) and probe[2][:1] == [MARK + "a"]
                     and probe[0][0] == MARK and len(probe[0]) == 2 and probe[1] == [MARK + "a", probe[0][1], "b"])
        words = [p[1:] for p in multi if p[0] == MARK and MARK not in p[1:] and " " not in p]
        alone = self.model.encode(words, num_threads=1)
        # the proven shortcut, and an empty word: the mark alone, in front of a further space
        self.whole = {w: 1 for w, ids in zip(words, alone) if len(ids) == 1} | {"": len(self.model.encode("a ")) - 1}
        self.count = dict(self.whole)
        self.bare: dict[str, int] = {"": 0}

    def _learn(self, units: set[str], known: dict[str, int], before: str, less: int, keep: dict[str, int]) -> None:
        new = [u for u in units if u not in known]
        if len(known) + len(new) > CACHE + len(keep):
            known.clear()
            known.update(keep)
            new = [u for u in units if u not in known]
        for u, ids in zip(new, self.model.encode([before + u for u in new], num_threads=1)):
            known[u] = len(ids) - less

    def _spaces(self, n: int) -> int:
        return len(self.model.encode("a" + " " * n)) - 1

    def count_all(self, texts: list[str]) -> list[int]:
        lines = [t.split("\n") if self.cuts and MARK not in t else None for t in texts]
        marked: set[str] = set()
        bare: set[str] = set()
        plan: list[tuple] = []
        for t, parts in zip(texts, lines):
            if parts is None or not t:
                plan.append(())
                continue
            units, heads, extra = [], [], len(parts) - 1
            for k, line in enumerate(parts):
                words = line.split(" ")
                if "  " in line or not words[0] or not words[-1]:
                    words, tail = _odd(words, first=k == 0)
                    extra += self._spaces(tail) if tail else 0
                if k:
                    heads.append(words[0])
                    units += words[1:]
                else:
                    units += words
            marked.update(units)
            bare.update(heads)
            plan.append((units, heads, extra))
        # an empty first line still carries the mark that the library puts in front of a text
        marked.discard("")
        self._learn(marked, self.count, "", 0, self.whole)
        self._learn(bare, self.bare, "\n", 2, {"": 0})
        count, head = self.count.__getitem__, self.bare.__getitem__
        return [(len(self.model.encode(t)) if t else 0) if not p
                else sum(map(count, p[0])) + sum(map(head, p[1])) + p[2] for t, p in zip(texts, plan)]


def _odd(words: list[str], first: bool) -> tuple[list[str], int]:
    """Units of a line with several spaces together, and its number of closing spaces.

    Each unit but the bare head of a later line stands for one space and itself,
    so the further spaces go in front of the word.
    """
    out, spaces = [], 0
    for i, w in enumerate(words):
        if w or i == 0 and not first:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if not out and first:             # nothing but spaces: the first of them is the mark in front
        return [], spaces
    return out, spaces


def _count(path: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for batch in rows_by_bytes(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(_counters[path].count_all(texts), pa.int64())],
                [*carry, "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *carry, n_bytes, n_tokens, over_limit``, a row per input row."""
    if clash := {"doc_id", "n_bytes", "n_tokens", "over_limit", "text"} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry,
                         F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    keep = ["doc_id", *carry, "n_bytes"]
    kinds = dict(source.dtypes)
    return source.mapInArrow(_count(model, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
