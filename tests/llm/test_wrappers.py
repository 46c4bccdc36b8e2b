"""Wrappers and main text of pages: made-up sites, broken markup, and the given pages."""

import html as entities
import json
import random
import re
from pathlib import Path

import pytest

from cladeframe.llm.markup import parse, plain
from cladeframe.llm.wrappers import GROUP, Part, extract, fold, host_of, infer, kinds, main_text, matched, united

SCHEMA = "page_id bigint, url string, html string"
SMALL = "/root/testdata/sf0.001/pages.parquet"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def site(seed, pages, frame):
    """Pages of one host under a template, with the text that each must give."""
    rng = random.Random(seed)
    rows = []
    for i in range(pages):
        blocks, shown = [], []
        for _ in range(rng.randint(1, 9)):
            tag = rng.choice(["p", "p", "p", "h2", "ul", "blockquote"])
            text = words(rng, rng.randint(3, 40))
            if tag == "ul":
                more = words(rng, 4)
                blocks.append(f"<ul><li>{text}<li><b>{more}</b></ul>")
                shown += [text, more]
            else:
                blocks.append(f"<{tag}>{text.replace(' ', chr(10), 1)}</{tag}>")
                shown.append(text)
        title = words(rng, 5)
        page = frame.format(
            title=title,
            body="\n".join(blocks),
            menu="".join(f'<li><a href="/{x}">{x}</a></li>' for x in words(rng, rng.randint(2, 6)).split()),
            notes="".join(f"<div class='comment'><p>{words(rng, 30)}</p></div>" for _ in range(rng.randint(0, 4))),
            ad=f'<div class="ad box{i}"><p>{words(rng, 12)}</p></div>' if rng.random() < 0.5 else "",
            extra=f"<p>{words(rng, 25)}</p>",
        )
        rows.append((i, page, "\n".join([title, *shown])))
    return rows


# Sites with no, one or several marks of where the article is.
SITES = {
    "article": "<html><head><title>x {title}</title></head><body><header><h1>My site</h1></header><nav><ul>{menu}</ul></nav>"
    "{ad}<article><h1>{title}</h1>{body}{ad}</article><section id='comments'><h3>Said</h3>{notes}</section>"
    "<aside>{extra}</aside><footer>&copy; 2020 all rights</footer></body></html>",
    "comments inside": "<body><ul class='nav-list'>{menu}</ul><article class='post-12'><header><h1>{title}</h1><p>by me</p></header>"
    "{body}<form><label>Name</label><input><button>Send</button></form><article><p>a reader</p></article>{notes}"
    "<footer>tags</footer></article><div role='contentinfo'>imprint</div></body>",
    "main": "<body><div id='cookie-notice'><p>We use cookies to make this better.</p></div><main><h1>{title}</h1>{body}</main>"
    "<div class='sidebar'>{extra}</div></body>",
    "content block": "<body><div class='top'><ul>{menu}</ul></div>{ad}<div class='entry-content'><h1>{title}</h1>{body}</div>"
    "<div class='related'>{extra}</div><div class='footer'>(c)</div></body>",
    "no marks": "<body><div><a href='/'>home</a> <a href='/b'>all pages</a> <a href='/c'>more of it</a></div><div><h1>{title}</h1>{body}</div>"
    "<div>This site is run by volunteers and has no owner.</div></body>",
    "no marks, table": "<table><tr><td><a href=/>home page</a><a href=/x>other page</a><td><h1>{title}</h1>{body}</table>"
    "<p>Printed on recycled electrons.",
}


@pytest.mark.parametrize("name", sorted(SITES))
def test_sites(spark, name):
    rows = site(len(name), 40, SITES[name])
    df = spark.createDataFrame([(i, f"http://h/{i}", page) for i, page, _ in rows], SCHEMA)
    found = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert found == {i: text for i, _, text in rows}


def test_hosts_do_not_mix(spark):
    rows, want = [], {}
    for k, name in enumerate(sorted(SITES)):
        for i, page, text in site(k, 12, SITES[name]):
            rows.append((100 * k + i, f"https://user@Host{k}.example:8080/a?b#c", page))
            want[100 * k + i] = text
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == want


def test_shares_of_a_host_give_one_wrapper(spark):
    rows = [r for name in sorted(SITES) for r in site(3, 20, SITES[name])]
    df = spark.createDataFrame([("h", page) for _, page, _ in rows], "host string, html string")
    for share in (2, 512):
        wrapper = infer(df, share).collect()
        assert len(wrapper) == 1
        whole = Part.of(json.loads(wrapper[0]["wrapper"]))
        for _, page, _ in rows:
            own = fold(parse(page)[0])
            found = {}
            matched(own, whole, found)
            assert all(id(s) in found for s in own.slots())


def test_mismatches_become_optional_repeated_and_groups():
    def wrapper(page):
        return fold(parse(page)[0])

    a = wrapper("<div><h1>a</h1><p>b</p><p>c</p></div><hr><em>t</em>")
    b = wrapper("<div><h1>a</h1><figure>x</figure><p>b</p></div><em>t</em>")
    whole = united(a, b)
    div = whole.kids[0]
    assert [(k.label, k.least, k.many) for k in div.kids] == [("h1", 1, False), ("figure", 0, False), ("p", 1, True)]
    c = wrapper("<div><p>a</p><ul><li>b</li></ul><p>c</p><h1>d</h1></div>")
    group = united(whole, c).kids[0].kids[0]
    assert group.label == GROUP and group.labels() == {"h1", "p", "ul", "figure"}
    assert all(k.least == 0 for k in group.kids)


def test_a_slot_whose_text_never_changes_is_no_article_text(spark):
    frame = "<body><div><p>Subscribe now and never miss anything.</p></div><div><p>{}</p><p>{}</p></div></body>"
    rows = [(i, "http://a/x", frame.format(f"first {i} text", f"second {i} text")) for i in range(5)]
    rows += [(9, "http://b/x", frame.format("one", "two")), (10, "http://b/x", frame.format("one", "two"))]
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3] == "first 3 text\nsecond 3 text"
    # Copies of one page prove nothing.
    assert found[9] == "Subscribe now and never miss anything.\none\ntwo"


BROKEN = [
    ("<article><p>a&amp;b &lt;c&gt; &eacute; &#233; &#x20AC; &amp &nosuch; &am</p>", "a&b <c> é é € & &nosuch; &am"),
    ("<article><p><b>one<br>two<p>three</b> <i>fo</i>ur", "one two\nthree four"),
    ("<ARTICLE><P CLASS=x>a\t\n  b c</P></ARTICLE>", "a b c"),
    ('<article><script>var t="</p><p>no";</script><style>p{}</style><p title="a > b">yes<!-- <p>no --> it is</article>', "yes it is"),
    ("<article>bare <p>in</p> between <div>deep</div> end", "bare\nin\nbetween\ndeep\nend"),
    ("<article><p>1 < 2 and 3 > 2 <3</p><p>a <", "1 < 2 and 3 > 2 <3\na <"),
    ("<article><p>cut <a href='x", "cut"),
    ('<article><p>quote <a title="x>text <b>more</b></a></p>', "quote text more"),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\nb\nc\nd\ne\nf\ng"),
    ("<article></article>", ""),
    ("", ""),
    ("just text", "just text"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>", "deep\nafter"),
    ("<article><p>before<svg/><p>after<select><option>x</select></article>", "before\nafter"),
    ("<!-- open <article><p>x", ""),
    ("<article><p>&#xD800;&#0;</p>", "��"),
]


@pytest.mark.parametrize("page, text", BROKEN)
def test_broken_markup(page, text):
    assert main_text(page) == text


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, None), (None, "not a url", "<article>x</article>"), (2, "http:///p", ""), (2, "http:///p", "")]
    rows += [(3, "http://h/1", f"<article><p>{'long words é ' * 40_000}</p></article>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'x' AS host", "'x' AS _host", "'x' AS wrapper", "'x' AS text", "'x' AS shape", "'x' AS salt"
    )
    found = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in extract(df).collect()), key=repr)
    assert found == sorted(
        [(1, None, 0), (None, "not a url", 1), (2, "http:///p", 0), (2, "http:///p", 0), (3, "http://h/1", 13 * 40_000 - 1)],
        key=repr,
    )
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts(spark):
    urls = ["http://A.b/c", "HTTPS://u:p@x.y:80?q", "//no.scheme/x", None, "ftp://z", "mailto:a@b", "http://h#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["a.b", "x.y", "", "", "z", "", "h"]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
def test_given_pages(spark):
    """The given pages mark their article; a plain cut by hand must agree."""
    df = spark.read.parquet(SMALL)
    for row in extract(df).join(df, ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", inner)]
        lines = [" ".join(entities.unescape(p).split()) for p in parts]
        assert row["text"] == "\n".join(x for x in lines if x)
        assert row["n_chars"] == len(row["text"])


def test_kinds_of_a_wrapper():
    page = fold(parse("<nav>a</nav><article>b<aside>c</aside></article><div class='share-bar'>d</div><p>e</p>")[0])
    assert list(kinds(page).values()) == [3, 0, 3, 3, 2]
    assert plain(["a &lt", "; b", " \n"]) == "a <; b"
