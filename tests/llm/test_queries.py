"""The registered queries over whole tables, against SQL, brute force or the library they have to equal."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import op5_quality, op8_sharding
from quillspark.llm.common import shared_dir
from quillspark.llm.queries import ORACLE_SQL, QUERIES

from . import plain


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, db, sf, name):
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(QUERIES[name](spark, sf), *columns) == sorted(want.fetchall(), key=repr)


def articles(pages):
    """page_id -> the blocks of the page's article."""
    import html

    want = {}
    for i, page in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", " ", body))
        want[i] = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p)).split()) for p in parts) if x)
    return want


def test_op1_finds_the_article(spark, sf, db):
    want = articles(db.execute("SELECT page_id, html FROM pages").fetchall())
    got = QUERIES["op1_html_extraction"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_op1_rests_on_the_ratios_where_no_name_tells(db):
    from quillspark.llm.op1_html_extraction import main_text, ratios

    pages = db.execute("SELECT page_id, html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    want, rnd = articles(pages), np.random.default_rng(7)
    assert all(main_text(p) == want[i] for i, p in pages)
    bare = [(i, re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", p).replace(' class="ad"', "")) for i, p in pages]
    right = lambda score_of: sum(main_text(p, score_of=score_of) == want[i] for i, p in bare) / len(bare)
    assert right(ratios) > 0.94
    assert right(lambda path, *_: np.ones(path.max() + 1)) < 0.05  # flat ratios
    assert right(lambda path, *_: rnd.random(path.max() + 1)) < 0.2 and right(lambda *x: rnd.permutation(ratios(*x))) < 0.4


def test_op2_equals_brute_force(spark, sf, db, texts):
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {i: f for i, f in zip(texts, plain.contamination(texts.values(), items))}
    got = QUERIES["op2_decontamination"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), plain.sha(",".join(ids)), hit > 0)
        of = {str(i): t for i, t in items}
        assert [(p.words, p.at) for p in r.places] == [plain.longest_match(texts[r.doc_id], of[i]) for i in ids]


def test_op3_equals_brute_force_and_the_path(spark, sf, db):
    from quillspark.llm.op1_html_extraction import main_text, ratios

    pages = db.execute("SELECT page_id, url, html FROM pages").fetchall()
    want = plain.language_posteriors(pages, db.execute("SELECT lang, text FROM documents").fetchall(), main_text)
    got = {r.page_id: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    for i, url, _ in pages:
        assert all(abs(got[i].posterior[x] - p) < 1e-6 for x, p in want[i].items())
        assert got[i].lang == max(sorted(want[i]), key=want[i].get) == url.split("/")[3]


def test_op4_equals_the_library(spark, sf, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op4_bpe"](spark, sf).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(t.decode(ids, skip_special_tokens=False)))


def test_op5_equals_the_definition_and_tells_held_out_text(spark, sf, db):
    docs = db.execute("SELECT doc_id, lang, text FROM documents").fetchall()
    labels = db.execute("SELECT doc_id, quality * (1 - toxic) FROM labels").fetchall()
    fold = lambda i: int(op5_quality.fold_of(np.array([i]))[0])
    want = plain.judgements(docs, labels, fold, op5_quality.QUANTILE, op5_quality.PRIOR_BYTES)
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    assert set(got) == set(want)
    for i, (perplexity, kept) in want.items():
        assert got[i].kept == kept and (perplexity is None) == (got[i].perplexity is None)
        assert perplexity is None or abs(got[i].perplexity / perplexity - 1) < 1e-9


def test_op5_tells_held_out_text(spark, db):
    at = "/root/testdata/sf0.01"
    labels = dict(db.execute(f"SELECT doc_id, quality FROM '{at}/labels.parquet' WHERE quality = 0 OR toxic = 0").fetchall())
    got = {r.doc_id: r.kept for r in QUERIES["op5_quality"](spark, at).collect()}
    fold = op5_quality.fold_of(np.array(sorted(labels)))
    held = {i for i, f in zip(sorted(labels), fold) if f == 0}
    poor, good = [got[i] for i, q in labels.items() if q == 0], [got[i] for i, q in labels.items() if q == 1 and i in held]
    assert sum(poor) <= 0.15 * len(poor) and sum(good) >= 0.95 * len(good)


def test_op8_equals_sql_and_is_one_permutation(spark, sf, db, texts):
    got = QUERIES["op8_sharding"](spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.law, r.shard, r.slot, r.grown_shard) for r in got) == sorted(db.execute(op8_sharding.ORACLE).fetchall())
    import zlib

    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in got)
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(len(texts)))


def test_op9_equals_the_patterns(spark, sf, texts):
    from .test_operators import base_spans

    for r in QUERIES["op9_pii"](spark, sf).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == plain.sha(base)
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base


def test_op10_equals_brute_force(spark, sf, texts):
    ids = sorted(texts)
    first, links = plain.near_groups([texts[i] for i in ids])
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op10_jaccard_join"](spark, sf).collect()}
    assert got == {i: (ids[f], n) for i, f, n in zip(ids, first, links)}


def test_op11_equals_brute_force(spark, sf, texts):
    ids = sorted(texts)
    fps = [plain.simhash(texts[i]) for i in ids]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_simhash"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, plain.bit_components(fps))}


def test_op12_equals_numpy(spark, sf, db):
    want, n, shares = plain.whitening(db.execute(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall())
    got = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(want)
    signs = np.sign(sum(np.array([got[i, c].whitened for c in range(1, 5)]) * w for i, _, w in want))
    for i, deviation, w in want:
        for c in range(1, 5):
            r = got[i, c]
            assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened * signs[c - 1] - w[c - 1]) < 1e-9
            assert abs(r.explained / shares[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13_equals_brute_force(spark, db, at):
    want = plain.spelling(db.execute(f"SELECT doc_id, text FROM '{at}/documents.parquet'").fetchall())
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_spelling"](spark, at).collect()}
    assert got == want and sum(x[0] is not None for x in want.values()) > 10


def test_pipeline_equals_brute_force(spark, sf, db):
    import corpus_pipeline

    docs = db.execute("SELECT doc_id, lang, text FROM documents").fetchall()
    labels = db.execute("SELECT doc_id, quality * (1 - toxic) FROM labels").fetchall()
    fold = lambda i: int(op5_quality.fold_of(np.array([i]))[0])
    good = plain.judgements(docs, labels, fold, op5_quality.QUANTILE, op5_quality.PRIOR_BYTES)
    unique = {}
    for i, _, t in sorted(docs):
        if good[i][1]:
            unique[t] = i
    ids = sorted(unique.values())
    text = {i: t for t, i in unique.items()}
    first, _ = plain.near_groups([text[i] for i in ids])
    ids = [i for k, i in enumerate(ids) if first[k] == k]
    hit = plain.contamination([text[i] for i in ids], db.execute("SELECT item_id, text FROM benchmark").fetchall())
    ids = [i for i, h in zip(ids, hit) if not h[1]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/corpus-*/*")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert [f.getPath().getName() for f in fs.globStatus(at)] == ["4-encode"]  # the files of the other stages are gone
    assert got == {i: len(t.encode(text[i], add_special_tokens=False).ids) for i in ids}
    assert len(got) > 100


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, "word here, and a few more of it", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, "x" * 300_000, "en", "s"), (3, "x" * 300_000, "en", "s"), (4, "a b c d e f g", "en", "s"), (5, "a b c d e f g", "de", "s"), (6, "p q r s t", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) n_chars", "'k' _key", "'h' h", "'f' found", "'c' cid")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q r s")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for given, want in ((docs, [None, 3, 5]), (docs.where("false"), [])):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            path = f"file://{tmp_path}/{len(want)}-{name}"
            stage(spark, now, f"file://{tmp_path}").write.parquet(path)
            now = spark.read.parquet(path)
            assert name == "encode" or now.columns == docs.columns
        assert sorted((r.doc_id for r in now.collect()), key=repr) == sorted(want, key=repr)


def test_a_stage_that_fails_leaves_no_files(spark, sf, monkeypatch):
    import corpus_pipeline

    def broken(spark, docs, sf_dir):
        raise RuntimeError("no")

    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/corpus-*/*")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(fs.globStatus(at) or ())
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs), ("broken", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf)
    assert len(fs.globStatus(at) or ()) == before
