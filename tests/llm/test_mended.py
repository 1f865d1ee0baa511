"""Ties, long chains and repeated ids: cases in which the order of rows must not matter."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlens.llm import chat_format, decontamination, html_extract, packing, quality, simhash_dedup, token_counts, url_filter
from flightlens.llm.components import components
from flightlens.llm.queries import QUERIES
from flightlens.llm.runtime import table
from llm_same import same

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
_TEXT = st.text(st.sampled_from("aAzZ0 9'sStT're ÀßµÿÉ¼²\xa0 \t\n\r.!?<|>{}İ中é\x00\x85"), max_size=40)


def test_ties_of_a_turn_go_by_role_and_text(spark):
    rows = [(1, 0, "user", "###x"), (1, 0, "user", "A"), (1, 0, "user2", "b"), (1, 0, "user", "\\"), (1, 0, None, "z"), (1, 0, "a:b", "</turn>"),
            (1, 0, "a", "<|"), (1, 0, "assistant", None), (1, 0, "assistant", "#### \n")]
    want = sorted((r or "", x or "") for _, _, r, x in rows)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
        (got,) = chat_format.read_back(chat_format.format_chat(df)).collect()
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["shuffled", "sorted", "star", "two cliques"])
def test_components_in_few_rounds(spark, kind):
    n = 2000
    ids = [i * 7 - 3000 for i in range(n)]
    if kind == "shuffled":
        random.Random(1).shuffle(ids)
    pairs = {"star": [(ids[0], i) for i in ids[1:]] + [(ids[5], ids[5])],
             "two cliques": [(a, b) for part in (ids[:30], ids[30:60]) for a in part for b in part]}.get(kind, list(zip(ids, ids[1:])))
    rounds = []
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long"), rounds).collect()}
    groups = [ids[:30], ids[30:60]] if kind == "two cliques" else [ids]
    assert got == {i: min(g) for g in groups for i in g}
    assert len(rounds) <= 13


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    """One id with two texts: the copy goes, the other text stays, in every order of rows."""
    import corpus_pipeline as P
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "h", 1), (2, a, "en", "h", 1), (2, b, "en", "h", 1), (2, b, "en", "h", 1), (2, b, None, "h", 1), (None, a, "en", "h", 1),
            (None, a, "en", "h", 1), (7, None, "en", "h", 0), (8, "", "en", "h", 0)]
    results = []
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1 + seed)
        results.append(sorted(map(repr, P.simhash_near_dedup(spark, docs, SF).collect())))
    assert all(r == results[0] for r in results) and len(results[0]) == 5
    kept = [(r.doc_id, r.text) for r in P.simhash_near_dedup(spark, docs, SF).collect()]
    same(kept, [(1, a), (2, b), (None, a), (None, a), (7, None)])


def test_pipeline_on_edge_rows(spark, edge_docs, tmp_path):
    import corpus_pipeline as P
    docs = edge_docs.select(*P.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} <= {r.doc_id for r in docs.collect()} and pieces
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_lines_decide_on_the_shipped_tables(spark):
    rows = quality.judge(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert any(not r.base_failed and not r.kept for r in rows)


def test_line_limit_is_the_same_for_small_and_large_hosts(spark):
    line = "subscribe to our letter and never miss a thing again dear reader"
    own = lambda h, i: " ".join(f"{h}{i}w{j}" for j in range(12))
    rows = [(i, f"{line}\n{own('s', i)}", "small") for i in range(quality.LINE_LIMIT + 1)]
    rows += [(100 + i, f"{line}\n{own('l', i)}", "large") for i in range(quality.LINE_LIMIT + 1)]
    rows += [(1000 + i, f"{own('x', i)}\n{own('y', i)}", "large") for i in range(400)]
    rows += [(5000 + i, f"{line}\n{own('t', i)}", "at the limit") for i in range(quality.LINE_LIMIT)]
    got = quality.digest(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    same(got, quality.brute_force(rows))
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in rows if r[2] == "small" or 100 <= r[0] < 1000}


@settings(max_examples=150, deadline=None)
@given(st.lists(_TEXT, max_size=6))
def test_encoder_equals_the_library(texts):
    encoder = _ENCODER[0] if _ENCODER else _ENCODER.append(packing.WordEncoder(WORDS, cache=7)) or _ENCODER[0]
    got = encoder.encode(pa.array(texts + [None], pa.string()), b"\x01\0\0\0")
    for text, ids in zip(texts + [""], got):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == want


_ENCODER = []


def test_token_counts_of_an_empty_table_and_special_strings(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["<s> </s> <unk>", " ", "  ", "\n", " a", "a ", "a  b", "\n\n a", "▁", "", None, "a\n b \n", "\t x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == {
        i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_near_duplicates_carry_columns(spark, edge_docs, edge_rows):
    got = simhash_dedup.near_duplicates(edge_docs, carry=("key", "spans"))
    assert got.columns == ["doc_id", "key", "spans", "bits", "component_id"] and got.count() == len(edge_rows)
    with pytest.raises(ValueError):
        simhash_dedup.near_duplicates(edge_docs.withColumn("bits", edge_docs.kept), carry=("bits",))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25).map(" ".join), min_size=1, max_size=5),
       st.lists(st.tuples(st.sampled_from([1, 2, None]), st.lists(st.sampled_from("abc"), max_size=12).map(" ".join)), max_size=5),
       st.sampled_from([30, 1 << 20]))
def test_longest_matches_and_their_places(spark, texts, items, block_bytes):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs, bench, window=5, block_bytes=block_bytes).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = (texts + texts[:1])[r.doc_id]
        found = {(m["item"], m["item_at"], m["at"], m["length"]) for m in r.matches}
        assert found == decontamination.brute_force_matches(text, items, 5) and len(found) == len(r.matches)
        assert r.items == sorted({m[0] for m in found})
        assert sum(s["length"] for s in r.spans) == r.n_hit == len({p for _, _, a, n in found for p in range(a, a + n)})


def test_repeated_rows_of_many_blocks_keep_their_hits(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] * 5 + [(2, None)] * 3, "doc_id long, text string").repartition(4)
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(0, 40, 4)]
    got = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=100).collect()
    assert len(got) == 8
    for r in got:
        assert len(r.matches) == (10 if r.doc_id == 1 else 0) and r.n_hit == (56 if r.doc_id == 1 else 0)


def _read(page):
    root = html_extract.parse(page)
    return html_extract.extract(root, html_extract.infer(root))


@pytest.mark.parametrize("page, text", [
    ("<article><p title=it's>Hello <b>world</b></p><p>it's nice</p><p>end</p></article>", "Hello world\n\nit's nice\n\nend"),
    ("<article><p it's>Hello</article>", "Hello"),
    ("<article><p>a</p><div class='user-comments'>c</div><div id=respond>r</div><div class=cookiebar>k</div>"
     "<ins class=adsbygoogle>x</ins><p>b</article>", "a\n\nb"),
    ("<div class=topbar>menu</div><p>text text text</p><div class=foot>f</div>", "text text text"),
    ("<article>1 < 2 <3 <p class='x>y'>q</p><p\nclass = \"a\">w</article>", "1 < 2 <3\n\nq\n\nw"),
    ("<p title=\"never closed>Hello <b>x</b></p><p>it's</p>", "Hello x\n\nit's"),
    ("<script>a</scripts>b</script foo>c<style>p</style\n>d", "c\n\nd")])
def test_html_tags_quotes_and_names(page, text):
    assert _read(page) == text


@pytest.mark.parametrize("part", ["<a ", "<a x=\"", "<a x='y ", "<", "</script ", "<p a=b ", "<!--", "<div>", "<title></title  ", "<p a   ",
                                  "<b><p>", "<!", "</", "<p class=a>"])
def test_html_of_a_megabyte_that_never_ends(part):
    import time
    begun = time.process_time()
    html_extract.parse(part * ((1 << 20) // len(part)))
    assert time.process_time() - begun < 5          # about one second; a quadratic reader takes minutes to hours


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class=x>", "</div>", "<br>", "<li>", "<ul>", "<a href=\"it's\">", "</a>",
                                 "<p title=it's>", "<i x=y/>", "<h1 id='a>b'>", "one", "two", "&lt;", " "]), max_size=25))
def test_html_keeps_all_words_between_tags(parts):
    words = "".join(p for p in parts if not p.startswith("<")).replace("&lt;", "<").replace(" ", "")
    assert "".join(_read("".join(parts)).split()) == words


def test_html_folds_as_before():
    groups = html_extract._fold([(x, False) for x in "abcadce"])
    assert groups == [[{"a": True, "b": True, "c": True, "d": True}, True], [{"e": False}, False]]
    assert html_extract._fold([(x, False) for x in "aab"]) == [[{"a": False}, True], [{"b": False}, False]]
    assert sum(len(g[0]) for g in html_extract._fold([(f"x{i % 30_000}", False) for i in range(200_000)])) == 30_000


def test_url_trees_use_several_features_and_hold_hosts_out(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    model = url_filter.UrlModel(url_filter.label_by_words(pages))
    told = model.report()
    assert sum(v > 0 for v in told["importance"].values()) >= 5 and abs(sum(told["importance"].values()) - 1) < 1e-6
    assert told["accuracy"] is None or told["accuracy"] > 0.9 and told["roc_area"] > 0.9
    verdicts = {r.page_id: r for r in QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    assert len(verdicts) == pages.count()
    by_score = url_filter.judge(pages, url_filter.label_by_words(pages)).filter("rule IS NULL").collect()
    assert all(verdicts[r.page_id].verdict == ("block" if r.bad_score >= url_filter.THRESHOLD else "allow") for r in by_score)
    assert {r.verdict for r in by_score} == {"block", "allow"}


def test_url_suffix_statistics_leave_the_own_fold_out(spark):
    rows = [(f"http://a{i}.one.test/{j}", i % 2 == 0) for i in range(20) for j in range(5)]
    model = url_filter.UrlModel(spark.createDataFrame(rows, "url string, bad boolean"))
    folds = {r.fold: (r.bad, r.n) for r in model.by_fold.filter("suffix = 'one.test'").collect()}
    total = [sum(x) for x in zip(*folds.values())]
    for r in model.train.collect():
        bad, n = total[0] - folds[r.fold][0], total[1] - folds[r.fold][1]
        assert abs(r.f_suffix_bad - (bad + url_filter.SMOOTH * model.all) / (n + url_filter.SMOOTH)) < 1e-12


def test_url_extra_columns_and_very_long_urls(spark):
    long = "http://" + "a" * 50_000 + ".example.org/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, long, 5, "h"), (2, None, 6, "i")], "page_id long, url string, suffix int, fold string")
    got = {r.page_id: r for r in url_filter.judge(pages, pages.selectExpr("url", "false AS bad"), carry=("fold",)).collect()}
    assert got[1].path == "/" + "x/" * 50_000 and got[2].verdict == "allow" and got[2].fold == "i"
    with pytest.raises(ValueError):
        url_filter.judge(pages, pages.selectExpr("url", "false AS bad"), carry=("suffix",))
    assert {x.page_id: x.text for x in html_extract.extract_text(pages.selectExpr("page_id", "url", "'<p>t' AS html", "suffix AS digest",
                                                                                  "fold AS wrapper")).collect()} == {1: "t", 2: "t"}


def _links_plan(monkeypatch, run):
    """The plan by which the links of near copies were found, as it stood at the end of the run."""
    plans, real = [], simhash_dedup.components

    def watched(links):
        links.collect()
        plans.append(links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return real(links)

    monkeypatch.setattr(simhash_dedup, "components", watched)
    rows = [tuple(r) for r in run().collect()]
    (plan,) = plans
    return plan, rows


def test_op3_postings_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the 28 postings of a fingerprint as one row: a table that seems small must not go through the driver."""
    texts = [(i, " ".join(f"w{i % 30}x{j}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (None, texts[0][1]), (70, None)], "doc_id long, text string")
    plan, rows = _links_plan(monkeypatch, lambda: simhash_dedup.digest(simhash_dedup.near_duplicates(docs)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    same(rows, simhash_dedup.brute_force([*texts, (None, texts[0][1]), (70, None)]))


def test_pipeline_postings_are_not_broadcast(spark, monkeypatch):
    """As in op3: the pipeline's second stage, run as part of the whole."""
    import corpus_pipeline as P
    plan, rows = _links_plan(monkeypatch, lambda: P.run(spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows
