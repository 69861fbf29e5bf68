"""Classifiers on held-out rows, fingerprints, page extraction and the pipeline."""

import hashlib
import html as entities
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import arrays, fingerprints, html, quality, queries, toxicity

WIDE = "/root/testdata/sf0.01"


def auc(score, truth):
    rank = np.argsort(np.argsort(score)) + 1
    p = truth.sum()
    return (rank[truth == 1].sum() - p * (p + 1) / 2) / (p * (len(truth) - p))


def test_toxicity_held_out(spark):
    got = queries.op6_toxicity(spark, WIDE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{WIDE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    assert auc(rows.score.values, rows.toxic.values) > 0.75  # a few dozen confirmed texts at this size
    assert rows.predicted[rows.toxic == 0].mean() < 0.05


def test_toxicity_reads_no_held_out_label(spark):
    docs, labels = spark.read.parquet(f"{WIDE}/documents.parquet"), spark.read.parquet(f"{WIDE}/labels.parquet")
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, changed)
    assert a.chosen.tolist() == b.chosen.tolist() and a.bias == pytest.approx(b.bias)


def test_non_negative_risk():
    """Positives have feature 0; the unlabelled are a mixture; feature 1 is noise."""
    rng = np.random.default_rng(0)
    toxic = np.arange(3000) < 500
    hidden = toxic | ((rng.random(3000) < 0.2) & ~toxic)
    rows = [[k for k, on in enumerate((h, rng.random() < 0.5)) if on] for h in hidden]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, b = toxicity.fit_nnpu(np.array([k for r in rows for k in r]), starts, toxic, 2, 0.2)
    assert w[0] + b > 0.85 and b < -0.85 and abs(w[1]) < abs(w[0]) / 2


def test_classifiers_on_odd_rows(spark, make, odd_rows):
    df = make([*odd_rows, (None, None), (None, "text")])
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(d, d % 2, d % 2) for d in range(1, 14)], "doc_id long, quality int, toxic int")
    for labels in (none, some, none.limit(0)):
        for docs in (df, df.limit(0)):
            for got in (toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels))):
                rows = got.collect()
                assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.keep for r in quality.score(df, None).collect()} == {1}
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0}


def test_quality_held_out(spark):
    got = queries.op9_quality(spark, WIDE).join(spark.read.parquet(f"{WIDE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got.score.values, got.quality.values) > 0.95
    assert got.keep[got.quality == 1].mean() > 0.97 and got.keep[got.quality == 0].mean() < 0.3


def test_co_training_adds_labels():
    """With few labels and two views that each show the class, the rounds teach both views."""
    rng = np.random.default_rng(1)
    n = 4000
    truth = rng.integers(0, 2, n)
    x = rng.normal(size=(n, quality.CONTENT)) + truth[:, None] * np.where(np.arange(quality.CONTENT) < 5, 0.8, 0)
    meta = np.column_stack([truth * 40 + rng.integers(0, 60, n), rng.integers(0, 4, n)])
    y = np.where(np.arange(n) < 120, truth, -1)
    size = rng.normal(size=n)

    def right(rounds):
        m = quality.co_train(x, meta, size, y, rounds)
        batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), pa.array(meta[:, 0]), pa.array(meta[:, 1]), pa.array(size)],
                                           names=["content", "source", "lang", "chars"])
        return ((quality._scores(m, batch)[0] >= 0.5) == truth)[120:].mean()

    assert right(4) > right(0) + 0.05


def keys(text):
    return set(fingerprints.paragraphs(*arrays.utf8(pa.array([text])))[1].tolist())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("table", [True, False])
def test_fingerprints(spark, folder, make, odd_rows, table):
    if table:
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.op8_fingerprints(spark, folder)
    else:
        rows = [r for k, r in enumerate(odd_rows) if r not in odd_rows[:k]]
        got = fingerprints.versions(make(rows))
    got = {r.doc_id: r for r in got.collect()}
    docs = sorted(((d, t or "") for d, t in rows), reverse=True)
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        g = got[d]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(like(keys(t), keys(edited))) and g.near_next == pytest.approx(like(keys(t), keys(u)))
        assert (g.fingerprint == g.edited_fingerprint) or t != edited
    prints = {}
    for d, t in docs:
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_of_few_rows(make):
    assert fingerprints.versions(make([])).collect() == []
    one = fingerprints.versions(make([(5, "abcdef")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(5, 6, 1.0)]
    assert fingerprints.versions(make([(5, "a b"), (5, "a b"), (None, "c"), (None, None)])).count() == 4


def test_peeling_recovers_large_differences():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 2**63, 700).astype(np.uint64), rng.integers(1, 2**63, 900).astype(np.uint64)
    both = rng.integers(1, 2**63, 300).astype(np.uint64)
    one, two = np.concatenate([a, both]), np.concatenate([b, both])
    zeros = lambda x: np.zeros(len(x), np.int64)
    assert fingerprints.likeness((zeros(one), one), (zeros(two), two), 1)[0] == pytest.approx(300 / 1900)


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = (" ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_pages_of_table(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op10_html_main_text(spark, folder).collect():
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


ODD_PAGES = {
    None: "", "": "", "<div": "", "plain &amp; text": "plain & text", "<p>a <b>b</b>c<br>d and more words here</p>\n<p>  e\n f with more words too </p>": "a bc d and more words here\ne f with more words too",
    "<body><nav><a>x y z</a></nav><article><h1>T</h1><p>one two three<p>four &lt;5&gt; &eacute;<div class='comments'><p>no</div></article><footer>f f f</footer>":
        "T\none two three\nfour <5> é",
    "<script>var a='<p>no</p>'</script><p>yes it is</p><style>p{}</style><!-- no --><form>name</form>": "yes it is",
    "<p>1 < 2 and 3 > 2</p><script>never ends": "1 < 2 and 3 > 2", "<aside>a</aside><div id=cookie-notice>b</div>": "",
}


def test_odd_pages(spark):
    df = spark.createDataFrame([(k, None, p, "t", "b") for k, p in enumerate(ODD_PAGES)], "page_id long, url string, html string, text string, block string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == dict(enumerate(ODD_PAGES.values()))
    assert html.main_text(df.limit(0)).collect() == []


def test_best_run_without_marks():
    """No article element: the densest run wins over links around it."""
    link = "<ul>" + "<li><a href='#'>go</a></li>" * 8 + "</ul>"
    page = f"<body>{link}<div><p>The first paragraph has many words in it.</p><p>So has the second one, and more.</p></div>{link}</body>"
    assert html.extract(page, {}) == "The first paragraph has many words in it.\nSo has the second one, and more."


LONG = "These are many words of an article that must all be found again, with " + "and so on " * 10 + "an end."
WRAPPERS = ["<div class='has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='elementor-widget-container'>{}</div>",
            "<div class='modal'><div id='search'>{}</div></div>", "<form>{}</form>", "<div data-id='ad' data-class=\"menu\" title='id=nav'>{}</div>"]
KEPT = ["<section id='related-work'><h2>Related</h2><p>{}</p></section>", "<h2 id='social-history'>Related</h2><p>{}</p>",
        "<h2 id='search'>Related</h2><p>{}</p>", "<div class='section' id='comments'><h2>Related</h2><p>{}</p></div>",
        "<h2 id='ad-hoc-networks'>Related</h2><p>{}</p>", "<div class='article-header'><h1>Related</h1></div><p>{}</p>",
        "<div class='header'><h1>Related</h1></div><p>{}</p>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<p>{}</p>"])
def test_layout_wrappers(wrapper, inner):
    page = "<body><nav><a>x y</a></nav><div class='ad'>buy this</div>" + wrapper.format(inner.format(LONG)) + "<div class='ad big'>and that</div>"
    assert html.extract(page, {}) == LONG


@pytest.mark.parametrize("part", KEPT)
def test_names_of_parts(part):
    page = "<body><article>" + part.format(LONG) + "<div class='x ads'>no</div></article><div class='related'><article>a b</article></div>"
    assert html.extract(page, {}) == "Related\n" + LONG


def test_text_in_math_labels_and_objects():
    page = f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <label>a label</label></p><object data='x'><p>in its place</p></object></article>"
    assert html.extract(page, {}) == f"{LONG} x=2 a label\nin its place"


NESTED = {
    f"<article><h1>T</h1><p>intro</p><article>update 1</article><article>{LONG}</article><p>end</p></article>": f"T\nintro\nupdate 1\n{LONG}\nend",
    f"<article>title<main>{LONG}</main></article>": f"title\n{LONG}", f"<main><h1>T</h1><article>{LONG}</article></main>": f"T\n{LONG}",
    f"<main><h1>T</h1><article>{LONG}</article><div id='comments'><article>no</article></div></main>": f"T\n{LONG}",
}


def test_nested_articles():
    for page, text in NESTED.items():
        assert html.extract(f"<nav>a</nav><p>before</p>{page}<aside><article>b</article></aside>", {}) == text


def test_pipeline(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs)
    toxic, near, cut, packed = frames[1:]
    rows = [tuple(r) for r in toxic.select("doc_id", "text").collect()]
    stay = sorted(d for d, _, c in brute.components(rows) if d == c)
    assert sorted(r.doc_id for r in near.collect()) == stay
    want = {d: (n, gone) for d, n, gone, *_ in brute.remove_repeats([r for r in rows if r[0] in set(stay)])}
    for r in cut.collect():
        n, gone = want[r.doc_id]
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone or gone == 0
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in packed.collect()} == set(stay)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_rows_that_share_an_id_stay(spark):
    """Only near copies go: rows are decided one by one, with their own columns."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(3, text(0), "en", "a", 1), (5, text(0) + " end", "de", "b", 1), (5, text(1), "fr", "c", 1), (7, text(2), "en", "d", 1),
            (7, text(3), "de", "e", 1), (7, text(3), "de", "e", 1), (8, None, "en", "f", 0), (8, "", "de", "g", 0), (None, text(0), "en", "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.source for r in near.collect()) == ["a", "c", "d", "e", "f", "g", "h"]
    cut = corpus_pipeline.repeated_passages(spark, near, "")
    want = {s: t or "" for _, t, _, s, _ in rows}
    assert sorted((r.source, r.text) for r in cut.collect()) == sorted((s, want[s]) for s in "acdefgh")


def test_pipeline_of_nothing(spark, make, odd_rows, folder):
    for docs in (make([]), make([*odd_rows, (None, "x"), (None, None)])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            docs.collect()
