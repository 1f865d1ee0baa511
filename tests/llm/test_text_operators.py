"""Operators on documents against brute force, on the edge cases and on empty tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlens.llm import decontamination, packing, quality, recompression, simhash_dedup, substring_dedup, token_counts
from flightlens.llm.queries import tokenizer_path
from flightlens.llm.wordhash import BLOCK, WordHasher
from llm_same import same

SF = "/root/testdata/sf0.001"


def test_substring_dedup_edges(edge_docs, edge_rows):
    got = substring_dedup.digest(substring_dedup.remove_repeats(edge_docs)).collect()
    same(got, substring_dedup.brute_force([r[:2] for r in edge_rows]))
    assert substring_dedup.remove_repeats(edge_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(edge_docs, carry=("kept",))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), min_size=1, max_size=6), st.integers(4, 9))
def test_equal_windows_have_equal_anchors(docs, width):
    """Every window is given one name at least, and equal windows equal names."""
    hasher = WordHasher(1)
    words = [hasher(" ".join(d).encode())[0] for d in docs]
    first = np.append(0, np.cumsum([len(w) for w in words]))
    name, frm, to = recompression.anchors(np.concatenate(words), first, width, 8)
    given_names = {}
    for n, f, t in zip(name.tolist(), frm.tolist(), to.tolist()):
        for p in range(f, t + 1):
            given_names.setdefault(p, set()).add(n)
    by_text = {}
    for d, ws in enumerate(docs):
        for p in range(len(ws) - width + 1):
            names = given_names[int(first[d]) + p]
            assert by_text.setdefault(tuple(ws[p:p + width]), names) == names


def test_word_hash_of_words_longer_than_a_block():
    hasher, word = WordHasher(2), b"q" * (BLOCK * 2 + 17)
    a = hasher(b"x " + word + b" y " + word)
    assert len(a[0]) == 4 and a[0][1] == a[0][3] and a[1][1] == a[1][3] and a[0][0] != a[0][2]


def test_simhash_edges(edge_docs, edge_rows):
    got = simhash_dedup.digest(simhash_dedup.near_duplicates(edge_docs)).collect()
    same(got, simhash_dedup.brute_force([r[:2] for r in edge_rows]))
    assert simhash_dedup.near_duplicates(edge_docs.limit(0)).count() == 0


def test_simhash_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash_dedup.digest(simhash_dedup.near_duplicates(docs)).collect()
    same(got, simhash_dedup.brute_force([(r.doc_id, r.text) for r in docs.collect()]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=60, unique=True))
def test_forest_joins_what_pairs_join(values):
    bits = np.array(values, dtype=np.uint64)

    def groups(links):
        label = list(range(len(bits)))
        for _ in bits:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label
    pairs = [(i, j) for i in range(len(bits)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    links = simhash_dedup.forest(bits, 2)
    assert groups(links) == groups(pairs) and len(links) < len(bits)


def test_quality_edges(edge_docs, edge_rows):
    got = quality.digest(quality.judge(edge_docs)).collect()
    same(got, quality.brute_force([(r[0], r[1], r[3]) for r in edge_rows]))
    assert quality.judge(edge_docs.limit(0)).count() == 0


def test_quality_removes_lines_of_many_documents(spark):
    line = "accept all cookies and go on reading this page now please"
    rows = [(i, line + "\n" + " ".join(f"t{i}x{j}" for j in range(30)), "h") for i in range(50)]
    rows += [(100, (line + "\n") * 4, "h"), (101, (line + "\n") + "own words " * 3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = quality.judge(docs, carry=("text",))
    same(quality.digest(judged).collect(), quality.brute_force(rows))
    kinds = ", ".join(f"{c} {k}" for c, k in judged.dtypes)
    left = {r.doc_id: r.text for r in judged.mapInArrow(quality.without_lines("text", "boilerplate"), kinds).collect()}
    assert line not in left[3] and "t3x4" in left[3] and line in left[101]


def test_decontamination_edges(spark, edge_docs, edge_rows):
    items = [(1, " ".join(f"W{i}!" for i in range(30, 60))), (2, "日本"), (3, None), (4, ""), (None, "x y y"), (10, "ende X"), (2, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = decontamination.brute_force([r[:2] for r in edge_rows], items)
    same(decontamination.digest(decontamination.find_contamination(edge_docs, bench)).collect(), expected)
    same(decontamination.digest(decontamination.find_contamination(edge_docs, bench, block_bytes=60)).collect(), expected)
    assert decontamination.find_contamination(edge_docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_contamination(edge_docs.limit(0), bench).count() == 0


def test_repeated_benchmark_rows_stay_within_the_blocks(spark, edge_docs, edge_rows, monkeypatch):
    items = [(1, " ".join(f"w{i}" for i in range(30, 60)))] * 200 + [(2, "ende x")] * 200
    taken = []
    init = decontamination.TestBlock.__init__
    monkeypatch.setattr(decontamination.TestBlock, "__init__", lambda self, rows, window: taken.append(rows) or init(self, rows, window))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(edge_docs, bench, block_bytes=2000)
    same(decontamination.digest(got).collect(), decontamination.brute_force([r[:2] for r in edge_rows], items))
    assert sum(map(len, taken)) == 2


def test_repeated_rows_make_no_longer_groups(spark, monkeypatch):
    shared = " ".join(f"w{i}" for i in range(80))
    rows = [(1, shared + " one")] + [(2, "two " + shared + f" x{i // 60}") for i in range(120)]
    grouped = []

    def watched(df, staged=substring_dedup.staged):
        out = staged(df)
        grouped.extend(list(r[c]) for c in ("spans", "ats") if c in out.columns for r in out.select(c).collect())
        return out
    monkeypatch.setattr(substring_dedup, "staged", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs)).collect(), substring_dedup.brute_force(rows))
    assert grouped and all(len(x) == len(set(x)) for x in grouped)


def test_token_counts_equal_the_library(spark, edge_docs):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = spark.createDataFrame([(50 + i, t) for i, t in enumerate(
        ["  two  spaces ", "\n\n a\n", " ", "\u2581 a\u2581 b", "<s> </s> <0x0A>", "tab\t\tx", "a\n  b  \n"])], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(extra).union(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = token_counts.count_tokens(docs, path).collect()
    same(got, [(r.doc_id, len((r.text or "").encode()), (n := len(model.encode(r.text or ""))), n > 4096) for r in docs.collect()])


def _check_pieces(pieces, texts, limits):
    from tokenizers import Tokenizer
    import zlib
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in texts.items():
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits[0] and len(ps) <= limits[1]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding


def test_packing_documents(spark, edge_docs):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(
        [(100_000, None), (100_001, ""), (100_002, "日本語 <|endoftext|> Ça\x0b"), (100_003, "don't 12 ½²")], "doc_id long, text string"))
    assert _check_pieces(packing.pack(docs, path).collect(), {r.doc_id: r.text for r in docs.collect()}, (2048, 2048)) == 0
    assert packing.pack(edge_docs, path).count() >= edge_docs.count()
    assert packing.pack(edge_docs.limit(0), path).count() == 0


def test_packing_limits_hold_together(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 7 + 1), i % 3 == 0) for i in range(200)], "doc_id long, text string, loss boolean")
    pieces = packing.pack(docs, path, loss_col="loss", max_tokens=128, max_segments=6, max_loss=20, cut=False).collect()
    _check_pieces(pieces, {r.doc_id: r.text for r in docs.collect()}, (128, 6))
    loss = {}
    for p in pieces:
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + (p.length if p.doc_id % 3 == 0 else 0)
    assert max(loss.values()) <= 20
