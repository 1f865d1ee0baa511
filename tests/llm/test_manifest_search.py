"""The manifest, the license scan and the ranked search against brute force, on edge cases and on empty tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlens.llm import lexical_rank, license_scan, merkle
from flightlens.llm.queries import QUERIES
from llm_same import same

SF = "/root/testdata/sf0.001"


# --- manifest ------------------------------------------------------------------------------------------------------

def _postorder(n):
    """(level, at) of a tree's nodes in postorder, by recursion."""
    def visit(level, at):
        if level:
            for child in (2 * at, 2 * at + 1):
                if child << (level - 1) < n:
                    yield from visit(level - 1, child)
        yield level, at
    return list(visit(merkle.height(n), 0)) if n else []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 65, 100, 129])
def test_places_are_those_of_a_postorder_walk(n):
    assert [merkle.place(n, level, at) for level, at in _postorder(n)] == list(range(len(_postorder(n))))


def test_manifest_edges(edge_docs, edge_rows):
    got = merkle.digest(merkle.prove_all(edge_docs)).collect()
    same(got, merkle.brute_force([r[:5] for r in edge_rows]))
    assert merkle.prove_all(edge_docs.limit(0)).count() == 0
    assert merkle.manifest(edge_docs.limit(0))[2] is None


def test_manifest_of_several_rounds(spark):
    """More than 64 * 64 leaves in one language, one leaf in others, ids at the limits, equal rows."""
    rows = [(i, f"t{i % 50}", "en", f"s{i % 3}", i) for i in range(4200)] + [(5, "t5", "en", "s2", 5)] * 3
    rows += [(2**63 - 1, "x", "zz", None, 2**63 - 1), (-(2**63), "", "", "", None), (None, None, None, None, 7)]
    rows += [(i, "é" * (i % 9), "é", "k", None if i % 4 else i) for i in range(130)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    same(merkle.digest(merkle.prove_all(docs)).collect(), merkle.brute_force(rows))
    trees, whole, root = merkle.manifest(docs)
    nodes = trees.nodes().filter("tree = 'é'").orderBy("place").collect()
    assert [(r.level, r.at) for r in nodes] == _postorder(130) and [r.place for r in nodes] == list(range(len(nodes)))
    assert whole.roots().collect()[0].digest == root


def test_manifest_of_one_language(spark):
    one = [(1, "a", "en", "s", 1)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.prove_all(docs).collect()
    assert row.leaf == row.subroot == row.root and row.steps == ""
    same(merkle.digest(merkle.prove_all(docs)).collect(), merkle.brute_force(one))


def test_a_changed_field_breaks_the_proof(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = merkle.prove_all(docs).collect()
    assert all(merkle.fold(r.leaf, r.steps) == r.root for r in rows)
    assert {r.verified for r in rows} == {True, False}
    assert all(merkle.fold(r.leaf[::-1], r.steps) != r.root for r in rows)


# --- license scan --------------------------------------------------------------------------------------------------

def test_license_edges(spark, edge_docs, edge_rows):
    notice = "Licensed under the\n  Apache-License; VERSION 2.0 ... cc by, nc cc by nc. Under the MIT licence under the mit license"
    more = spark.createDataFrame([(50, notice), (51, "x " * 200_000 + notice + " y" * 200_000), (52, " under the mit license"),
                                  (53, "sunder the mit licenses"), (None, None)], "doc_id long, text string")
    got = license_scan.scan_licenses(edge_docs.select("doc_id", "text").unionByName(more)).collect()
    texts = [(r[0], r[1]) for r in edge_rows] + [tuple(r) for r in more.collect()]
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in got],
         [(i, *license_scan.brute_force_base(t)) for i, t in texts])
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert license_scan.scan_licenses(edge_docs.limit(0)).count() == 0
    assert license_scan.scan_licenses(edge_docs, carry=("key", "kept")).count() == len(edge_rows)
    with pytest.raises(ValueError):
        license_scan.scan_licenses(edge_docs, carry=("spans",))
    with pytest.raises(ValueError):
        license_scan.scan_licenses(edge_docs, notices={"x": ("Two  spaces",)})


def test_license_misspelt_and_close_notices(spark):
    texts = {1: "Relaesed under the MIT-license", 2: "lisensed under the apache licence, version 2.0", 3: "GNU General Public License, version 3",
             4: "GNU Generel Public License version 2", 5: "licensed under cc by 4.0", 6: "Licensed under CC BY-SA 4.0 and the GNU lesser general publik license",
             7: "under the law of the license holder", 8: "this program is permitted"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (",".join(r.labels), [s.edits for s in r.spans]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: ("mit", [2]), 2: ("apache-2", [2]), 3: ("gpl-3", [0]), 4: ("gpl-2", [1]), 5: ("cc-by", [0]),
                   6: ("cc-by-sa,lgpl", [0, 1]), 7: ("", []), 8: ("", [])}


_SCANNER = []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_license_edits_equal_the_full_table(data):
    """A notice is found if and only if some part of the text is within its edits, and with the fewest."""
    if not _SCANNER:
        _SCANNER.append(license_scan.Scanner({"a": ("abab acab abba",), "b": ("abc cba abcabc abc abca aabb",)}, {}))
    scan = _SCANNER[0]
    which = data.draw(st.integers(0, 1))
    text = list(data.draw(st.sampled_from(["", "ab ", "abab acab "])) + scan.notices[which][1] + data.draw(st.text("abc ", max_size=12)))
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(0, len(text) - 1))
        text[at:at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "c", "x", " "]))
    text = license_scan.joined("".join(text).encode())
    _, found = scan(text)
    least = {n: license_scan.fewest_edits(notice, text) for n, (_, notice) in enumerate(scan.notices)}
    inside = {n: e for n, e in least.items() if e <= scan.allowed[n]}
    assert bool(found) == bool(inside)
    if inside:
        best = min(inside.values())
        assert min(e for e, *_ in found) == best
    for e, a, b, n in found:
        assert license_scan.fewest_edits(scan.notices[n][1], text[a:b]) == e <= scan.allowed[n]


def test_license_scan_of_a_text_full_of_seeds():
    """Hundreds of thousands of places in one text, in linear time."""
    scan = license_scan.Scanner(license_scan.NOTICES, license_scan.BASE)
    base, found = scan(license_scan.joined(b"cc by nc licensed under the mit license " * 20_000))
    assert len(base) == 40_000 and len(found) == 20_000


def test_license_query_reads_all_documents(spark):
    rows = QUERIES["op12_license_scan"](spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows],
         [(i, *license_scan.brute_force_base(t)) for i, t in texts])


# --- ranked search -------------------------------------------------------------------------------------------------

def _items(spark):
    rows = [(1, "w1 W2, w20 w20", "q"), (2, "w1 w2 wort ende", "q"), (3, None, "q"), (4, "", "q"), (None, "w5 x y", "q"), (5, "zzz", "q"),
            (1, "a b", "q"), (2, "w1 w2 wort ende", "q"), (6, "日本 é ok w1 w2", "q"), (7, "wort", "q")]
    return spark.createDataFrame(rows, "item_id long, text string, rank string"), [r[:2] for r in rows]


def test_rank_edges(spark, edge_docs, edge_rows):
    items, rows = _items(spark)
    docs = [r[:2] for r in edge_rows]
    same(lexical_rank.rank(edge_docs, items).collect(), lexical_rank.brute_force(docs, rows))
    same(lexical_rank.rank(edge_docs, items, top=2).collect(), lexical_rank.brute_force(docs, rows, 2))
    assert lexical_rank.rank(edge_docs.limit(0), items).count() == 0
    assert lexical_rank.rank(edge_docs, items.limit(0)).count() == 0


def test_rank_in_blocks(spark, edge_docs, edge_rows):
    items, rows = _items(spark)
    got = lexical_rank.rank(edge_docs, items, block_bytes=40).collect()
    same(got, lexical_rank.brute_force([r[:2] for r in edge_rows], rows))


def test_rank_ties_in_one_task(spark):
    """Equal scores at the last place go by id, whatever the order of the rows and however many tie."""
    rows = [(i, "alpha beta") for i in range(300)] + [(None, "alpha beta")] * 2 + [(i, "gamma") for i in range(300, 400)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "alpha"), (2, "gamma beta")], "item_id long, text string")
    same(lexical_rank.rank(docs, items).collect(), lexical_rank.brute_force(rows, [(1, "alpha"), (2, "gamma beta")]))


def test_rank_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    same(lexical_rank.rank(docs, items).collect(),
         lexical_rank.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 11), max_size=9), max_size=8))
def test_shared_sets_rebuild_every_item(sets):
    nodes, items = lexical_rank.share([sorted(s) for s in sets], 12)

    def terms(x):
        return [x] if x < 12 else [t for part in nodes[x - 12] for t in terms(part)]
    assert [sorted(t for x in item for t in terms(x)) for item in items] == [sorted(s) for s in sets]
    used = [x for item in items for x in item] + [x for pair in nodes for x in pair]
    assert all(used.count(12 + i) >= 1 for i in range(len(nodes)))


def test_items_with_common_terms_share_nodes():
    sets = [[0, 1, 2, 3, 10 + i] for i in range(6)]
    nodes, items = lexical_rank.share(sets, 20)
    assert len(nodes) == 3 and all(len(i) == 2 for i in items)
