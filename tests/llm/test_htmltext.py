import random
import time

import pytest
from llm_texts import prose

from dataward.llm import dom, htmltext

PAGE = ("<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul>{menu}</ul></nav><div class='ad'>Buy this now, it is good.</div><article><h1>{title}</h1>{body}"
        "</article><footer>&copy; somebody</footer></body></html>")


def pages(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        menu = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in prose(seed + i + 500, 6).split())
        blocks = [" ".join(prose(seed * 1000 + i * 20 + k, r.randint(8, 60)).split()) + "." for k in range(r.randint(2, 7))]
        title = blocks[0][:30].strip()
        out.append((PAGE.format(menu=menu, title=title, body="".join(f"<p>{b}" for b in blocks)), "\n".join([title, *blocks])))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, f"http://x/{i}", html, "t", 3) for i, (html, _) in enumerate(pages(60))]
    rows += [(100, None, None, "t", 3), (101, "u", "", "t", 3), (102, "u", "<script>never closed", "t", 3),
             (103, "u", "<div>" * 3000 + "deep", "t", 3), (0, "http://x/0", rows[0][2], "t", 3)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int").repartition(3)


@pytest.fixture(scope="module")
def forest(spark, sample):
    return htmltext.fit(spark, sample)


def test_pages_of_the_table(sample, forest):
    rows = htmltext.extract(sample, forest).collect()
    assert len(rows) == sample.count()
    want = [text for _, text in pages(60)]
    for r in rows:
        if r["page_id"] < 100:
            assert r["text"] == want[r["page_id"]]
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in (100, 101, 102):
            assert r["text"] == ""


def test_other_layouts(forest):
    maker = htmltext.Layouts([b for _, t in pages(40, 3) for b in t.split("\n") if len(b) > 40],
                             ["Home", "News of today", "About", "Contact us"], seed=77)
    right = kept = main = 0
    for _ in range(150):
        source = maker.page()
        page = dom.Page(source)
        want = [t.replace(htmltext._MARK, "") for t in page.text if t.endswith(htmltext._MARK)]
        got = htmltext.main_texts([source.replace(htmltext._MARK, "")], forest)[0].split("\n")
        right += sum(len(t) for t in got if t in want)
        kept += sum(map(len, got))
        main += sum(map(len, want))
    assert right / kept > 0.9 and right / main > 0.9


def test_choice_is_consistent(forest):
    page = dom.Page(pages(1, 9)[0][0])
    nodes = dom.Nodes([page])
    odds = forest.log_odds(nodes.features())
    keep = htmltext.decode(nodes, odds)
    assert all(page.text[i] for i in range(len(page.tag)) if keep[i])
    # a container judged worse than all it holds is worth goes with everything in it
    article = page.tag.index("article")
    odds[article] = -1000
    assert not htmltext.decode(nodes, odds)[article:].any()


@pytest.mark.parametrize("source, blocks", [
    ("<p>a &amp; b&nbsp;&#8364;<br>c\n  d</p>", ["a & b € c d"]),
    ("<p>one<p>two<div>three", ["one", "two", "three"]),
    ("<ul><li>a<li>b <i>c</i></ul>", ["a", "b c"]),
    ("x <!-- y --> z<!-- open", ["x z"]),
    ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
    ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
    ("<select><option>no</select><textarea>no</textarea>yes", ["yes"]),
    ("</p></div>x", ["x"]), ("", []), ("<", ["<"]), ('<a title="x', []),
])
def test_blocks(source, blocks):
    assert [t for t in dom.Page(source).text if t] == blocks


@pytest.mark.parametrize("end", ["</script>", "</SCRIPT >"])
def test_letters_that_grow_in_lower_case_move_no_end(end):
    page = dom.Page("<p>" + "\u0130" * 40 + f"</p><script>x{end}<p>main text</p><p>more</p>")
    assert [t for t in page.text if t] == ["\u0130" * 40, "main text", "more"]


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert htmltext.extract(none).count() == 0


@pytest.mark.parametrize("source", [
    "<p>" + "<i>" * 60_000 + "</b>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<div>" * 60_000 + "</section>" * 60_000,
    "<b><p>" + "<i>" * 60_000 + "</b>" * 60_000, "<p><table>" + "<nav>" * 60_000 + "<p>x" * 30_000,
    "<ul><li><table>" + "<div>" * 60_000 + "<li>x" * 30_000, "</p>" * 200_000 + "text"])
def test_stray_tags_take_linear_time(source):
    started = time.process_time()
    dom.Page(source)
    assert time.process_time() - started < 10            # a megabyte; the square of it would take minutes
