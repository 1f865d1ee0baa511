"""Vector bin packing of tokenised examples into fixed-length sequences.

Every sequence has limits on tokens, segments and loss-bearing tokens. A task
tokenises its documents, gives whole sequences to what fills them, and packs
the rest from a buffer of open pieces: the next piece is the one with the
largest dot product of its demand and the sequence's free room (both as shares
of the limits) among those that fit. If none fits and cutting is allowed, the
best piece is cut to fill the sequence exactly. What is left at the end of a
task is cut into lengths that are powers of two, which need no padding.

Nothing is shuffled and no task holds more than its buffer: ids are packed
where they are made. Sequence numbers combine the task and a counter.

Defined cases: a null text is an empty one; an empty document is its end id
alone; documents longer than a sequence are cut (or, if cutting is off, cut
only at whole sequences); a null id stays null; repeated rows are packed
repeatedly; of pieces with equal products the one that has waited longest goes
first; a very long text is encoded by one task; an empty table gives no pieces;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, rows_by_bytes

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 2048, 2048
BUFFER = 512                     # open pieces of a task
CACHE = 400_000                  # words a worker learns before it forgets those not met meanwhile
ENCODE_BYTES = 8 << 20           # text encoded at a time inside a task
END_ID = 1

# characters for which lower-casing and splitting below equal the library's; other texts go to it whole
_OTHER = r"[^\t\n\r\x20-\x7e\x{a0}-\x{ff}]|<\|"
# what is a word of its own between letters: contractions, single digits, runs of other characters
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_APART = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_DIGIT}]|[^\s\x{{a0}}{_LETTER}{_DIGIT}]+)"
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts from a ``tokenizers`` file, by their words.

    A batch of texts is lower-cased, split into words and factorised by Arrow;
    only its distinct words are looked up or tokenised by the library, and its
    ids are gathered from theirs by numpy. Texts with characters for which the
    words may differ from the library's go to it whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)     # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache = cache
        self.known: dict[str, bytes] = {}       # ids of words as little-endian bytes
        self.older: dict[str, bytes] = {}       # those known before; one that is met again is known again

    def _tokenise(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        # many words in one text, parted again behind the ids that end a word
        groups = [new[i:i + 1000] for i in range(0, len(new), 1000)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(group):          # not parted as given: word by word
                ends, ids = _one_by_one(self.tokenizer, group)
            data, at = ids.tobytes(), 0
            for w, end in zip(group, ends):
                yield w, data[4 * at:4 * end]
                at = end

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. A word not met while ``cache`` others were learnt is forgotten."""
        out = list(map(self.known.get, words))
        missed = [w for w, ids in zip(words, out) if ids is None]
        if not missed:
            return out
        if len(self.known) + len(missed) > self.cache:
            self.older, self.known = self.known, {}
            missed = words
        again = {w: ids for w in missed if (ids := self.older.get(w)) is not None}
        again.update(self._tokenise([w for w in missed if w and w not in again]))
        again[""] = b""                          # white space at the ends of a text leaves empty words
        self.known.update(again)
        return [again[w] if ids is None else ids for w, ids in zip(words, out)]

    def encode(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """The ids of each text and ``end``, as little-endian unsigned 32-bit integers."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        words = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _APART, r" \1 "))
        coded = words.flatten().dictionary_encode()
        ids = self._look_up(coded.dictionary.to_pylist()) + [end]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size
        at = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        word = np.insert(coded.indices.to_numpy().astype(np.int64), at[1:], len(ids) - 1)     # the end id closes a text
        many = size[word]
        upto = np.cumsum(many)
        take = np.arange(upto[-1] if len(upto) else 0) + np.repeat(start[word] - (upto - many), many)
        data = np.frombuffer(b"".join(ids), dtype="<u4")[take].tobytes()
        close = upto[at[1:] + np.arange(len(texts))].tolist()
        out = [data[4 * a:4 * b] for a, b in zip([0, *close], close)]
        for i in np.flatnonzero(whole).tolist():
            got = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = np.array(got, dtype="<u4").tobytes() + end
        return out


def _one_by_one(tokenizer, words: list[str]) -> tuple[list[int], np.ndarray]:
    each = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return np.cumsum([len(e) for e in each]).tolist(), np.array([i for e in each for i in e], dtype="<u4")


class Packer:
    """Packs the pieces of one task; yields (piece fields) rows."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, base: int):
        self.limits, self.cut, self.next = np.array(limits, dtype=np.float64), cut, base
        self.open: list[list] = []           # [doc, start, ids, loss, doc_tokens]
        self.need: list[tuple] = []          # what each takes of the limits
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes, loss: np.ndarray | None) -> None:
        """``loss``: 0 / 1 for each id; None if all bear loss."""
        n, most = len(ids) // 4, int(self.limits[0])
        at = 0
        whole = loss is None and self.limits[2] >= most     # then a full sequence is as many loss tokens
        while n - at >= most and whole:
            self._put(doc, at, ids[4 * at:4 * (at + most)], n, self._new(), 0)
            at += most
        while at < n:
            take = min(n - at, most, int(self.limits[2])) if loss is None else self._room(loss[at:], most)
            self.open.append([doc, at, ids[4 * at:4 * (at + take)], None if loss is None else loss[at:at + take], n])
            self.need.append(self._demand(self.open[-1]))
            at += take
        while len(self.open) >= BUFFER:
            self._fill()

    def finish(self) -> None:
        while self.open:
            self._fill(last=True)

    def _room(self, loss: np.ndarray, most: int) -> int:
        """How many of the next ids a sequence can hold."""
        bearing = np.cumsum(loss[:most])
        return max(1, int(np.searchsorted(bearing, self.limits[2], side="right")))

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _put(self, doc, start, ids, tokens, sequence, offset) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, ids))

    def _demand(self, piece) -> tuple[int, int, int]:
        n = len(piece[2]) // 4
        return n, 1, n if piece[3] is None else int(piece[3].sum())

    def _fill(self, last: bool = False) -> None:
        """Close one sequence from the open pieces."""
        demand = np.array(self.need, dtype=np.float64)
        alive = np.ones(len(self.open), dtype=bool)
        share, free = demand / self.limits, self.limits.copy()
        chosen: list[list] = []
        while True:
            fits = alive & (demand <= free).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, share @ (free / self.limits), -1.0)))
                alive[i] = False
                free -= demand[i]
                chosen.append(self.open[i])
                continue
            if self.cut and alive.any() and free[0] >= 1 and free[1] >= 1:
                i = int(np.argmax(np.where(alive, share @ (free / self.limits), -1.0)))
                piece = self.open[i]
                take = int(free[0])
                if piece[3] is not None:
                    take = min(take, int(np.searchsorted(np.cumsum(piece[3]), free[2], side="right")))
                elif free[2] < take:
                    take = int(free[2])
                if take >= 1:
                    chosen.append([piece[0], piece[1], piece[2][:4 * take], None if piece[3] is None else piece[3][:take], piece[4]])
                    self.open[i] = [piece[0], piece[1] + take, piece[2][4 * take:],
                                    None if piece[3] is None else piece[3][take:], piece[4]]
                    self.need[i] = self._demand(self.open[i])
            break
        if not chosen:
            raise AssertionError("a piece that fits no sequence")      # add() never makes one
        left = np.flatnonzero(alive).tolist()
        self.open, self.need = [self.open[i] for i in left], [self.need[i] for i in left]
        if last and self.cut and not self.open:
            self._powers(chosen)
            return
        sequence, offset = self._new(), 0
        for doc, start, ids, _, tokens in chosen:
            self._put(doc, start, ids, tokens, sequence, offset)
            offset += len(ids) // 4

    def _powers(self, chosen: list[list]) -> None:
        """The last pieces in sequences whose lengths are powers of two."""
        left = sum(len(p[2]) // 4 for p in chosen)
        room, offset, sequence = 0, 0, 0
        for doc, start, ids, _, tokens in chosen:
            while ids:
                if not room:
                    room, offset, sequence = 1 << (left.bit_length() - 1), 0, self._new()
                take = min(room, len(ids) // 4)
                self._put(doc, start, ids[:4 * take], tokens, sequence, offset)
                ids, start = ids[4 * take:], start + take
                room, offset, left = room - take, offset + take, left - take


def _pack(path: str, limits: tuple[int, int, int], cut: bool, end_id: int | None, with_ids: bool, has_loss: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 40)
        for batch in rows_by_bytes(batches, "text", ENCODE_BYTES):
            docs = batch.column("doc_id").to_pylist()
            bears = batch.column("loss").to_pylist() if has_loss else [True] * len(docs)
            for doc, ids, loss in zip(docs, encoder.encode(batch.column("text"), end), bears):
                packer.add(doc, ids, None if loss else np.zeros(len(ids) // 4, dtype=np.int8))
            if packer.rows:
                yield _pieces(packer.rows, with_ids)
                packer.rows = []
        packer.finish()
        yield _pieces(packer.rows, with_ids)
    return run


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [()] * 8
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        return pa.RecordBatch.from_arrays(arrays + [pa.array(columns[7], pa.binary())], [*names, "ids"])
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, cut: bool = True,
         end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]``.

    ``loss_col``: boolean, whether a row's ids bear loss (null: not); all do
    if it is not given. With ``cut=False`` only rows that fit no sequence are
    cut. ``ids``: the piece's ids as little-endian unsigned 32-bit integers.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    prepare(docs.sparkSession)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if loss_col:
        columns.append(F.coalesce(F.col(loss_col).cast("boolean"), F.lit(False)).alias("loss"))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))
    return docs.select(*columns).mapInArrow(
        _pack(tokenizer, (max_tokens, max_segments, max_loss), cut, end_id, with_ids, bool(loss_col)), schema)
