"""Tokenizer, classifier, page extraction and the pipeline."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolink.llm import html_extraction as H
from geolink.llm import quality_classifier as Q
from geolink.llm import sentencepiece_codec as S
from geolink.llm.queries import QUERIES

DOCS = "doc_id long, text string, extra string"
TEXTS = [
    "", "  a  b", "a\n\nb\tc", "Hello wörld", "é́ ﬁ ａ", "▁x ▁", "​😀", "</s>x <0x0A> <s>", "a  b   c    d", " ", "\x00a", "x ", "\n", " \n \t\n  ", "x" * 3000, " " * 500, "\r\n\r\n",
    "a　b", "日本語 テスト", " x", "a" * 50 + " " * 33 + "b", "The quick brown fox. " * 200, "ñandú çà et là", "𝔘nicode", "tab\tend\t",
]


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.tokenizer_path())


def test_agenda_equals_library(codec, spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert own == [[1, *codec.library.encode(t), 2] for t in texts]
    assert not codec.corrected
    assert all(codec.agenda(s) == codec.library.encode(s[1:]) for s in list(codec.memo)[:3000] if s[0] == S.MARK and s.strip(S.MARK) and s[1:2] != S.MARK)


def test_memo_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "MEMO", 5)
    c = S.Codec(S.tokenizer_path())
    first = c.encode(TEXTS)
    assert c.encode(TEXTS) == first and len(c.memo) <= 5 + 200


def test_the_library_decides_where_the_agenda_differs(monkeypatch):
    c = S.Codec(S.tokenizer_path())
    real = c.agendas

    def wrong(segments):
        real(segments)
        for s in segments:
            if "fox" in s or s == "\n" or s.startswith("🦊"):
                c.memo[s] = b"\x05\x00\x00\x00"

    monkeypatch.setattr(c, "agendas", wrong)
    texts = ["The quick fox\njumps", "no animal here", "🦊fox fox"]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [[1, *c.library.encode(t), 2] for t in texts]
    assert c.met[1] == 0 and c.met[0] >= 1 and c.corrected


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "abc", "x"), (2, "Hi there\n", None)], DOCS)
    rows = S.encode(df, keep=("extra",)).collect()
    assert len(rows) == 4
    for r in rows:
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and r.ids[0] == 1 and r.ids[-1] == 2
        assert r.decoded == {1: "", None: "abc", 2: "Hi there\n"}[r.doc_id] and r.n_tokens == len(r.ids)
    assert S.encode(df.where("false")).count() == 0


def test_classifier_learns_held_out_documents(spark, sf):
    rows = QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9


def test_classifier_edges_and_chunks(spark, sf):
    model = Q.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "some words here", "x"), (2, "word " * 300_000, "x")], DOCS)
    got = Q.score(df, model, keep=("extra",)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert Q.score(df.where("false"), model).count() == 0
    unlearned = Q.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert {(r.score, r.predicted) for r in Q.score(df, unlearned).collect()} == {(0.5, 1)}


def plain_score(text, model):
    """A score by the definition: bytes and words of one text one by one, bags in lists."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    grams = [tuple(raw[a:b] for a, b in spans[i : i + 3]) for i in range(len(spans) - 2)]
    k = len(Q._GROUPS) + 1
    kinds = [next((i for i, g in enumerate(Q._GROUPS) if chr(b) in g), k - 1) for b in raw]
    bag = []
    for at in range(0, max(1, len(spans)), Q.PASSAGE):
        x = [0.0] * Q.WIDTH
        if mine := spans[at : at + Q.PASSAGE]:
            end = spans[at + Q.PASSAGE][0] if at + Q.PASSAGE < len(spans) else len(raw)
            pairs = Counter(kinds[i] * k + kinds[i + 1] for i in range(mine[0][0], min(end, len(raw) - 1)))
            for pair, n in pairs.items():
                x[pair] = (n / sum(pairs.values())) ** 0.5
            x[-5] = len({raw[a:b] for a, b in mine}) / len(mine)
            x[-4] = sum(b - a for a, b in mine) / len(mine) / 10
            x[-3] = math.log1p(len(mine))
            x[-2] = (len(grams) - len(set(grams))) / max(1, len(grams))
            x[-1] = math.log1p(len(spans)) / 10
        bag.append((np.array(x) - model.mean) / model.scale)
    p = {name: np.asarray(value, dtype=np.float64) for name, value in model.weights.items()}
    hidden = [np.tanh(x @ p["w"] + p["b"]) for x in bag]
    logit = [float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]) for h in hidden]
    part = [math.exp(s - max(logit)) for s in logit]
    z = sum(e * h for e, h in zip(part, hidden, strict=True)) / sum(part)
    return 1 / (1 + math.exp(-max(-30, min(30, float(z @ p["c"] + p["d"])))))


def test_classifier_against_plain_scores(spark, sf):
    """Whole texts of the table, and texts of far more passages than training reads, blank ones and ones that begin with blanks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    more = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "  \n one two"), (-5, "Some words, and more. " * 5000 + "é#|* 9" * 300), (-6, "x")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").union(spark.createDataFrame(more, "doc_id long, text string")).coalesce(1)
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r for r in Q.score(rows, model).collect()}
    assert max(len((t or "").split()) for t in texts.values()) > Q.FIT_PASSAGES * Q.PASSAGE
    for doc_id, text in texts.items():
        want = plain_score(text, model)
        assert got[doc_id].score == pytest.approx(want, abs=1e-4), doc_id
    # whatever lies beside it, a text has one score
    again = {r.doc_id: r.score for r in Q.score(rows.repartition(7), model).collect()}
    assert all(again[k] == pytest.approx(r.score, abs=1e-6) for k, r in got.items())


def test_gradient_of_attention_model():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 5), Q.WIDTH)).astype(np.float32) + (3 if k % 2 else 0) * (np.arange(Q.WIDTH) == 7) for k in range(60)]
    y = np.arange(60) % 2
    model = Q.train(bags, y, steps=120)
    assert ((model.score(bags) >= 0.5) == y).mean() > 0.9


def test_attention_finds_the_passage_that_decides():
    """Bags in which one passage in ten decides: with attention it is found, with equal weights it drowns."""
    rng = np.random.default_rng(3)
    bags, y = [], np.arange(400) % 2
    for label in y:
        bag = rng.normal(size=(10, Q.WIDTH)).astype(np.float32)
        bag[rng.integers(10), :12] += 2.5 if label else -2.5
        bags.append(bag)
    learned = [np.mean((Q.train(bags[:300], y[:300], steps=200, attend=attend).score(bags[300:]) >= 0.5) == y[300:]) for attend in (True, False)]
    assert learned[0] >= 0.9 and learned[0] >= learned[1] + 0.05


def test_fitting_is_bounded(spark):
    """One labelled id holds a third of all rows and a text is very long: one row an id and few passages are read."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") == 5, F.repeat(F.lit("word "), F.lit(200_000))).otherwise(F.lit("a text of words")).alias("text"))
    got = Q.training_rows(docs, spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), sample=2500)
    assert len(got) == got["doc_id"].to_numpy().tolist().__len__() == len(set(got["doc_id"].to_pylist()))
    assert max(len(b.as_buffer()) for b in got["bag"]) <= Q.FIT_PASSAGES * Q.WIDTH * 2


PAGE = """<!doctype html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>A title</h1><p>First &amp; <b>bold</b>
 text, which is long enough to be read as prose.<br>After.<p>Second&nbsp;one &lt;x&gt; with some more words in it, and more.</p><div class="comments"><p>I disagree with this.</p></div></article>
<footer>&copy; someone</footer></body></html>"""


def test_page():
    text = H.Extractor(H.fitted()).texts([PAGE])[0]
    assert text == "A title\nFirst & bold text, which is long enough to be read as prose. After.\nSecond one <x> with some more words in it, and more."


def test_unclosed_tag_is_text():
    for tail in ("<b" + "'" * 5000, "<b " + "\"'" * 2500, "<b'" * 500):
        assert [t for _, t, _ in H.parse("<p>a</p>" + tail).texts] == ["a", tail]
    assert H.parse("<p title='x>y' class=\"it's\">a<b it's>c").names[1:] == ["it's", ""]


@pytest.mark.parametrize("unit", ["<a ", "'", "<b'", "<b x=\"", "<b x='>", "<!--", "<!", "</script ", "<script></script ", "<a x=\">\" ", "< ", "<p class='", "=\"'", "<title>"])
@pytest.mark.parametrize("end", ["", ">", "'>", "\">"])
def test_hostile_pages_take_linear_time(unit, end):
    times = []
    for n in (60_000, 480_000):
        html = "<p>a</p><b" + unit * (n // len(unit)) + end
        began = time.process_time()
        H.parse(html)
        times.append(time.process_time() - began)
    assert times[1] < 3 and times[1] < 30 * max(times[0], 0.02)


@pytest.mark.parametrize("parts", [("<span>", "<hr>"), ("<div>", "</x>"), ("<p><b>", "<li>"), ("<ul><span>", "<td>"), ("<table><i>", "<tr>"), ("<em>", "</p>")])
def test_deep_pages_take_linear_time(parts):
    n = 1_000_000 // sum(map(len, parts))
    began = time.process_time()
    page = H.parse(parts[0] * n + "text" + parts[1] * n)
    assert time.process_time() - began < 6 and len(page.tag) > n


A = "The river rises in the hills above the town, and in spring it carries more water than the old bridge was built for. "
B = "People remember the flood of that year, when boats went through the market, and nobody had seen such a thing before. "
WHOLE = [
    # utility names only
    (f'<body><div class="flex px-4 mt-2"><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div class="grid w-8"><h1>The river</h1><p>{A}</p><p>{B}</p></div><div class="mt-8 text-3">© 2020 Town Press <a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>',
     f"The river\n{A.strip()}\n{B.strip()}"),
    # names of another language
    (f'<body><nav class="leiste"><ul><li><a href=/>Start</a></li><li><a href=/a>Archiv</a></li></ul></nav><div class="inhalt"><h1>Der Fluss</h1><p>{A}</p><p>{B}</p></div><div class="fusszeile">© 2021 Verlag <a href=/i>Impressum</a> <a href=/d>Datenschutz</a></div></body>',
     f"Der Fluss\n{A.strip()}\n{B.strip()}"),
    # readers' comments as a list beside the article
    (f'<body><article><h1>Bridge</h1><p>{A}</p><p>{B}</p></article><h3>2 comments</h3><ol class="commentlist"><li><cite>Ann</cite> <span>3.4.2011 10:12</span><p>I was there, and it was worse.</p><a href="#r">Reply</a></li><li><cite>Bob</cite> <span>4.4.2011 09:40</span><p>So was I, with my father.</p><a href="#r">Reply</a></li></ol></body>',
     f"Bridge\n{A.strip()}\n{B.strip()}"),
    # a table of facts in the article
    (f'<body><article><h1>River</h1><table class="infobox"><tr><th>Length</th><td>84 km in all.</td></tr><tr><th>Source</th><td>Two springs near the pass.</td></tr></table><p>{A}</p><p>{B}</p></article><footer>© 2019 All rights reserved</footer></body>', None),
    # a list in the article, an unclosed paragraph, scripts between
    (f'<body><nav><a href=/>Home</a> <a href=/x>More</a></nav><main><h1>Steps</h1><p>{A}<script>var a = 1;</script><ul><li>First, look at the water and wait for the evening.</li><li>Then walk home, slowly, along the wall.</li></ul><p>{B}</main></body>',
     f"Steps\n{A.strip()}\nFirst, look at the water and wait for the evening.\nThen walk home, slowly, along the wall.\n{B.strip()}"),
    # a form and a search box
    (f'<body><form action=/s><input name=q><button>Search</button></form><article><h1>Water</h1><p>{A}</p><blockquote><p>{B}</p></blockquote></article><form><label>Mail</label><input><button>Subscribe</button></form></body>',
     f"Water\n{A.strip()}\n{B.strip()}"),
    # only text
    (f"<p>{A}<p>{B}", f"{A.strip()}\n{B.strip()}"),
    (f"<html><head><title>T</title><style>p {{}}</style></head><body><div class=content><h2>Flood</h2><p>{A}</p><p><em>{B}</em></p></div></body></html>", f"Flood\n{A.strip()}\n{B.strip()}"),
]


@pytest.mark.parametrize("html,want", WHOLE)
def test_whole_texts_of_hand_made_pages(html, want):
    text = H.Extractor(H.fitted()).texts([html])[0]
    if want is None:
        assert all(x in text for x in ("84 km in all.", "Two springs near the pass.", A.strip(), B.strip())) and "rights" not in text
    else:
        assert text == want


HAND_MADE = [
    # a table layout of old, without any names
    ("<html><body><table width=100%><tr><td colspan=2><a href=/>Home</a> <a href=/b>News</a> <a href=/c>About</a> <a href=/d>Links</a></td></tr><tr><td valign=top><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td>"
     "<td><h1>Tides of the north</h1><p>The harbour lies between two long hills, and the tide comes in twice a day, as it has always done.</p><p>Fishermen know it well, they say, and so do the gulls that wait for them on the wall.</p></td></tr></table></body></html>",
     ["Tides of the north", "The harbour lies between two long hills", "Fishermen know it well"], ["Home", "News", "Three"]),
    # nested divs with names no page of the training set has
    ("<html><head><title>x</title></head><body><div class='x1 q'><div class='x2'><ul><li><a href=1>Start</a></li><li><a href=2>Shop</a></li><li><a href=3>Kontakt</a></li></ul></div></div><div class='x3'><div class='x4'>"
     "<h1>Ein langer Tag</h1><p>Am Morgen gingen sie los, weil der Weg weit war, und am Abend kamen sie müde an.</p><p>Dazwischen lag ein Tal, von dem sie später, wenn sie gefragt wurden, lange erzählten.</p></div></div>"
     "<footer>© 2019 Verlag. Alle Rechte.</footer></body></html>",
     ["Ein langer Tag", "Am Morgen gingen sie los", "Dazwischen lag ein Tal"], ["Kontakt", "Alle Rechte"]),
    # a journal with replies, a form and a script in the middle
    ("<!doctype html><html><body><header><nav><a href=/>Blog</a></nav></header><main><article><h1>Notes on bread</h1><p>Flour, water, salt and time: nothing else is needed, though patience helps.</p><script>if(a<b){x('</p>')}</script>"
     "<blockquote><p>Give it a night, my grandmother said, and it will give you a week.</p></blockquote><ol><li>Mix it all, and let it rest for an hour or so.</li><li>Fold it, wait again, and bake it hot.</li></ol></article></main>"
     "<section id=comments><h2>Replies</h2><div class=comment><p>I tried this, and it did not rise at all.</p></div></section><form action=/s><input name=q><button>Search</button></form></body></html>",
     ["Notes on bread", "Flour, water, salt and time", "Give it a night", "Mix it all", "Fold it, wait again"], ["did not rise", "Search", "Replies"]),
]


@pytest.mark.parametrize("html,there,gone", HAND_MADE)
def test_hand_made_pages(html, there, gone):
    text = H.Extractor(H.fitted()).texts([html])[0]
    assert all(x in text for x in there) and not any(x in text for x in gone)


def test_whole_table_against_another_parser(spark, sf):
    """Every line of a page's text is a block of it as the standard library's parser sees it, in page order; the rest of the result follows from the text."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.raw = [[]], 0

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")
            if tag in H.BLOCK:
                self.out.append([])
            if tag == "br":
                self.out[-1].append(" ")

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style")
            if tag in H.BLOCK:
                self.out.append([])

        def handle_data(self, data):
            if not self.raw:
                self.out[-1].append(data)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_html_extraction"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        parser = Blocks()
        parser.feed(pages[r.page_id] or "")
        parser.close()
        whole = iter([x for x in (" ".join("".join(b).split()) for b in parser.out) if x])
        assert r.n_chars == len(r.text) and all(any(line == b or line in b for b in whole) for line in r.text.split("\n") if line)


def test_generated_pages():
    rng = np.random.default_rng(12345)
    trees, good = H.fitted(), 0
    for _ in range(40):
        html, truth = H.sample_page(rng)
        page = H.parse(html)
        good += H.blocks(page, np.array(truth)) == H.Extractor(trees).texts([html])[0]
    assert good >= 36


def test_decoding_is_closed_under_parents():
    chosen = H.decode([-1, 0, 1, 1, 0], np.array([1.0, -1.0, 3.0, -2.0, -0.5]))
    assert chosen.tolist() == [True, True, True, False, False]
    assert H.decode([-1, 0, 1], np.array([0.0, -5.0, 1.0])).tolist() == [True, False, False]


def test_pages_edges(spark, sf):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "just text &amp; more"), (2, "u", "<p>a<p>b"), (3, "u", "<div" * 50), (4, "u", "<" * 10_000)], "page_id long, url string, html string")
    got = H.extract(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["", ""]
    assert H.extract(df.where("false")).count() == 0
    out = QUERIES["op7_html_extraction"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and out.where("n_chars = 0").count() == 0


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as P

    from .test_dedup_ops import brute_lines, brute_ngram

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect()}
    bags = {d: b for (d, _), b in zip(left.items(), (f for _, f in Q.passages(pa.array(list(left.values())))), strict=True)}
    left = {d: t for d, t in left.items() if model.score([bags[d]])[0] >= 0.5}
    lines = {d: (t, n, g) for d, n, g, t in brute_lines(sorted(left.items()))}
    left = {d: t for d, (t, n, g) in lines.items() if not g or g < n}
    groups = brute_ngram(sorted(left.items()))
    left = {d: t for d, t in left.items() if groups[d][1] == d}
    staged = docs
    for _, stage in P.STAGES[:3]:
        staged = stage(spark, staged, sf)
        assert staged.columns == docs.columns
    assert {r.doc_id: r.text for r in staged.collect()} == left
    out = P.run(spark, sf).collect()
    codec = S.Codec(S.tokenizer_path())
    assert {r.doc_id for r in out} <= set(left) and len(out) > len(left)
    for r in out:
        ids = np.array([1, *codec.library.encode(left[r.doc_id]), 2], "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_pipeline_sends_bounded_batches(spark, sf):
    """A batch for a worker is bounded by bytes, and a kept text is in it once."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i, "word " * 5_000, "en", "a", 25_000) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    scored = P.classify(spark, docs, sf)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 9 << 20
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "_text" not in plan
    assert scored.columns == docs.columns and {r.text for r in scored.collect()} <= {"word " * 5_000}
    model = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    apart, together = Q.score(docs, model, keep=("lang",)), Q.score(docs, model, keep=("text", "lang"))
    assert together.columns == ["doc_id", "held_out", "text", "lang", "score", "predicted"]
    assert {(r.doc_id, r.score) for r in apart.collect()} == {(r.doc_id, r.score) for r in together.collect()}


def test_stages_on_edges(spark, sf):
    import corpus_pipeline as P

    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id\nat all\nfor this", "en", "b", 23), (4, "word " * 50_000, "en", "c", 250_000)]
    names = ["size", "score", "predicted", "_text", "_leader", "target", "copies", "_id", "h", "starts", "source_size", "_mix_bucket", "component_id", "rep", "n", "bucket"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() > 0 and (k == len(P.STAGES) - 1 or out.columns == list(P.COLUMNS))
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert sorted(r.doc_id for r in P.dedup_documents(spark, docs, sf).where("doc_id is not null").collect()) == [1, 2, 3, 4]
