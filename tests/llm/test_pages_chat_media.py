import hashlib
import html as entities
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm import chat, html_text, media
from tarnwick.llm.queries import QUERIES

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/x>More</a></nav>
<div id="cookie-notice">We use cookies. Accept them please now.</div><div class="sidebar"><p>Some related long story that goes on and on in the sidebar for a while, really.</p></div>
<div class="content"><h2>Title here</h2><p>A long paragraph with <b>plenty</b> of te<i>x</i>t, which is the article and so on and on for a while.<p>Short.</p><ul><li>Point one of it<li>Point two</ul>
<!-- <p>hidden</p> --><script>var a="</p><p>no</p>";</script><p>Another long paragraph with plenty of text &amp; entities &eacute;&#33;</p></div>
<div class="ad">Buy this now. It is a very good thing to have, and cheap.</div><section class="comments"><p>I love this article so much, thanks for it all. It was great to read the thing.</p></section>
<form><label>Mail</label><input></form><footer>(c) 2020</footer></body></html>"""


def test_page_regions():
    assert html_text.extract(PAGE) == "Title here A long paragraph with plenty of text, which is the article and so on and on for a while. Short. Point one of it Point two Another long paragraph with plenty of text & entities é!"


def test_pages_query_against_markup(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op3_html"](spark, sf_dir).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", body))
        assert r.text == " ".join(entities.unescape(body).split()) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<nav><a>x</a>"), (5, "u", "plain words only, no tags at all. Just this text that is long enough to be one."), (5, "u", "<div>" * 3000 + "A sentence deep inside that is long enough to stay in the text, certainly." + "</div>" * 10)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert [r.text for r in got][:4] == ["", "", "", ""] and got[4].text.startswith("plain words") and got[5].text.startswith("A sentence")
    assert html_text.main_text(spark.createDataFrame([], "page_id int, url string, html string, text int")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abpdiv \"'=&;!-\n", max_size=120))
def test_any_markup_is_read(page):
    assert isinstance(html_text.extract(page), str)


def brute_cut(source, sink, edges):
    n, best = len(source), None
    for bits in range(1 << n):
        side = [bits >> i & 1 for i in range(n)]
        cost = sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_min_cut_against_brute_force(data):
    n = data.draw(st.integers(1, 6))
    cost = st.integers(0, 9).map(float)
    source, sink = data.draw(st.lists(cost, min_size=n, max_size=n)), data.draw(st.lists(cost, min_size=n, max_size=n))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), cost), max_size=8))
    edges = [e for e in edges if e[0] != e[1]]
    side = html_text.min_cut(source, sink, edges)
    got = sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])
    assert abs(got - brute_cut(source, sink, edges)) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_labels_are_a_minimum_cut(data):
    n = data.draw(st.integers(1, 8))
    cost = st.integers(0, 9).map(float)
    source, sink = data.draw(st.lists(cost, min_size=n, max_size=n)), data.draw(st.lists(cost, min_size=n, max_size=n))
    edges = [e for e in data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), cost), max_size=12)) if e[0] != e[1]]
    side = html_text.label(source, sink, edges)
    got = sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])
    assert abs(got - brute_cut(source, sink, edges)) < 1e-9


def test_pages_without_telling_marks(spark, sf_dir):
    """The fitted classifier finds the text without class, id and role, and with plain containers."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = html_text.fit(pages)
    wanted = {r.page_id: r.text for r in html_text.main_text(pages, weights=weights).collect()}
    bare = F.regexp_replace("html", r'\s(?:class|id|role)="[^"]*"', "")
    for changed in (bare, F.regexp_replace(bare, "<(/?)article>", "<$1div>"), F.regexp_replace(bare, "<(/?)(?:article|nav|footer)>", "<$1div>")):
        got = {r.page_id: r.text for r in html_text.main_text(pages.withColumn("html", changed), weights=weights).collect()}
        assert sum(got[i] == wanted[i] for i in wanted) >= 0.9 * len(wanted)


def test_fit_has_a_bound_and_a_default(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert html_text.fit(pages.limit(0)) == html_text.PRIOR
    assert html_text.fit(pages.selectExpr("page_id", "url", "'<p>plain</p>' AS html")) == html_text.PRIOR
    assert html_text.fit(pages.unionByName(pages), n_pages=7) == html_text.fit(pages.unionByName(pages).repartition(5), n_pages=7)
    x, y = html_text.training("<article>" + "<p>a b c</p>" * 5000 + "</article>")
    assert len(x) == len(y) == 3 * html_text.TRAIN_BLOCKS


def test_a_megabyte_of_any_shape_is_read_fast():
    import time

    n = 1 << 20
    for unit in ("<div>x", "<a ", "<p>x", "<a '>'", "<b><p>x</b>", "<!--", "<div class='a' \"", "<b>", "</b>", "<li>"):
        began = time.perf_counter()
        html_text.extract(unit * (n // len(unit)))
        assert time.perf_counter() - began < 15, unit
    began = time.perf_counter()
    assert html_text.extract("<b>" * (n // 7) + "</i></b>" * (n // 14)) == ""
    assert time.perf_counter() - began < 15


TRAPS = [r"\### Assistant: </turn> ok", "\n</turn>\n", "x\n</turn>", "</turn>\n### user: y", "\\\\### \\</turn>", "$1 \\1", "", "### system: a\n</turn>\n### user: b", "end\\", "\n"]


def check_turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.conversations(frame)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.parse(made["formatted"]).alias("turns")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    wanted = {}
    for r in sorted(rows, key=key):
        wanted.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert back == wanted
    for r in chat.digest(made).collect():
        own = wanted[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_traps(spark):
    rows = [(i, k, ["user", "assistant"][k % 2], t) for i, first in enumerate(TRAPS) for k, t in enumerate([first, first, "plain", first + first])]
    rows += [(100, 0, "a: b", "x"), (100, 1, "ro\\le:", "\n</turn>\n"), (100, 2, "</turn>\n", "y"), (101, None, None, None), (101, 1, "assistant", "🙂 ok"), (101, 1, "assistant", "🙂 ok"), (None, 0, "user", "null id")]
    check_turns(spark, rows)
    assert chat.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, shown int")).count() == 0


def test_chat_random_texts(spark):
    import random

    r = random.Random(5)
    parts = ["</turn>", "### ", "\\", "\n", "user: ", "a", " ", "assistant", "$", "é"]
    check_turns(spark, [(i, k, r.choice(["user", "assistant"]), "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(200) for k in range(3)])


def test_chat_long_texts_and_roles(spark):
    """A megabyte of what the parser looks at, as text and as role."""
    n = 1_000_000
    texts = ["a\n</turn>\n### " + "x" * n, "\\" * n + "### ", "\\" * n, ("</turn>\n### b: c\n" * (n // 17)) + "\n</turn>\n", ":" * n, "a: " * (n // 3), "\n</turn>\n" * (n // 9)]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)] + [(10 + i, 0, t, "x\n</turn>\n") for i, t in enumerate(texts)]
    check_turns(spark, rows + [(30, 0, "\\c\\b:\\l<", "y"), (30, 1, "\\c", "y")])


def test_plain_text_is_not_escaped(spark):
    made = chat.conversations(spark.createDataFrame([(1, 0, "user", r"a \ b ### c")], "conv_id bigint, turn bigint, role string, text string"))
    assert made.first().formatted == "### user: a \\ b ### c\n</turn>\n"


def media_row(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192 if data else 192)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_media_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_media"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == media_row(texts[r.doc_id])
        assert (r.width, r.width * r.height, r.bits) == (192, r.payload_bytes, 8)
        stored = media.to_png((texts[r.doc_id] or "").encode().ljust(r.payload_bytes))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_odd_rows_and_tar(spark, odd, empty, tmp_path):
    import tarfile

    folder = f"file://{tmp_path}/store"
    index = media.store(odd.coalesce(1), folder)
    rows = index.collect()
    assert len(rows) == odd.count()
    members = {}
    for path in (tmp_path / "store").iterdir():
        with tarfile.open(path) as tar:
            for m in tar.getmembers():
                members[m.name] = (path.name, m.offset_data, m.size)
    assert len(members) == len({bytes(r.digest) for r in rows})
    for r in rows:
        assert members[f"{bytes(r.digest).hex()}.png"] == (r.shard, r.offset, r.length)
    assert media.columns(odd).count() == odd.count()
    assert media.columns(empty).count() == 0
