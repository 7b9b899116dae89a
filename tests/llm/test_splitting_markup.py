from __future__ import annotations

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstead.llm import markup, splitting, wrappers


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", ". ", "\n", "\n\n", "漢字。", "x" * 30, "é"]), max_size=400).map("".join), st.integers(20, 120), st.integers(0, 10))
def test_pieces_cover_and_fit(text, limit, overlap):
    body = text.strip()
    if not body:
        return
    made = [p for _, p in splitting.pieces(body, False, limit, overlap)]
    assert all(0 < len(p) <= limit for p in made)
    whole = made[0]
    for p in made[1:]:
        assert whole[len(whole) - overlap :] == p[:overlap]
        whole += p[overlap:]
    assert whole == body
    least = 1 if len(body) <= limit else -(-(len(body) - overlap) // (limit - overlap))
    assert least <= len(made) <= least * 2 + 2


def test_cuts_are_natural_and_even():
    text = "\n\n".join("A sentence of some words. Another one follows here. " * 6 for _ in range(12)).strip()
    cuts = splitting.balanced_cuts(text, 900, 100)
    assert sum(text[:c].endswith("\n\n") for c in cuts[:-1]) >= len(cuts) // 2
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(sizes) - min(sizes) < 500


def test_long_text_without_boundaries():
    made = [p for _, p in splitting.pieces("x" * 1_000_000, False, 1800, 200)]
    assert max(map(len, made)) <= 1800 and len(made) <= 640


def test_split_table(spark):
    long = "# A\n" + "word " * 200 + "\n## B\n" + "other " * 200
    rows = [(1, long, True, "k"), (2, None, True, None), (3, "  ", None, None), (4, "short", False, None), (1, long, True, "k"), (5, "e\r\nf", None, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, markdown boolean, piece string")
    got = splitting.split_texts(df, 300, 50).collect()
    assert {r.breadcrumb for r in got if r.row_id == 1} == {"A", "A › B"} and {r.row_id for r in got} == {1, 4, 5}
    assert [r.piece for r in got if r.row_id == 5] == ["e\nf"]
    assert splitting.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, 100, 60)


FOUND = {
    "html": ["a<br/>b", "<ol type=1><LI>x\n</ol>", '<font\n  color="red"\n>x</font>', "R&amp;D", "it&#39;s", "&#x2014;", "a <!-- b\nc --> d", "x<sup>8</sup>", "<pre><code>$a$ **b**</code></pre>"],
    "markdown": [
        "# Head", "## Head ##", "Head\n====", "Head\n--", "say *this* now", "**b**", "_a b_", "__a__", "***x***", "~~gone~~", "[a](http://b)", "![a](b.png)", "[a][b]\n\n[b]: http://c",
        "<https://a.b>", "run `x <b>` now", "``a `b` c``", "```\n<b>x</b> $x$ [[y]]\n```", "~~~sh\n# c\n~~~", "a | b\n--- | :---:\n1 | 2", "| a |\n|---|\n| 1 |", "```\nopen\n<p>",
    ],
    "wiki": ["== Head ==", "=== A ===\nx", "''i''", "'''b'''", "'''''x'''''", "[[Page]]", "[[Page|word]]", "[[File:a.png|thumb|b]]", "[https://a.b label]", "{{Note|a|b}}", "{{Box\n| a = b\n}}", '{| class="x"\n|-\n| a || b\n|}'],
    "latex": ["\\section{A}", "\\subsection*{A}", "\\textbf{x} y", "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", "$x_i = 2$", "$$ a^2 $$", "\\(a \\le 3\\)", "\\[ r = \\frac{1}{2} \\]", "$e^{-d/180}$"],
}
NONE = [
    "Export $HOME and $PATH first.", "Budget was $5 then $6 per run.", "Check <session-id> and <port>.", "R&D and Q&A stay as is.", "AT&T; later R&B; both skipped.", "Use x^2 + y_1 = 5 by hand.",
    "Log says [warn] {code: 7} | <unset>.", "Compare 2 == 3 in C# first.", "Copy from C:\\begin\\section over \\\\depot\\docs.", "Keys a_b_c and _private stay.", "See issue #4521 and #88.",
    "The path C:\\temp\\new is fine.", "Piped a | b | c into sort.", "Stop at <EOF> or <3 tries.", "That is 5 * 3 * 2 in total.", "Files sit in ~/bin and ~/share.", "Price ~ 40 % off & more.",
    "Try f(x) [optional] (maybe).", "Ran x <- y and z -> w.", "The mask is ***** and ----- here.", "It holds while a < b and c > d.", "Take 2 ** 8 or 3 ** 4.", "Note [12] applies; see {config}.",
    "Use List<String> here, not Map<K, V>.", "#untitled tag line 30", "- In a b.\n- Can you.", "* a\n* b\n** c", "1. a\n2. b", "x = '' or ''", "", None, "plain", "if [[ -f x ]]; then", "[[1, 2], [3]]",
]


@pytest.mark.parametrize("family", FOUND)
def test_families(family):
    for text in FOUND[family]:
        assert markup.families(text) == [family], text
        assert markup.families("Before it. " + text if "\n" not in text and not text.startswith(("#", "=", "{|", "|")) else text) == [family], text


def test_no_family():
    for text in NONE:
        assert markup.families(text) == [], text


def test_several():
    assert markup.families("# A\n\n<b>x</b> and [[Page]] and $x_1$") == ["html", "markdown", "wiki", "latex"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["*", "_", "`", "<b>", "</b>", "$", "\\", "{", "}", "[", "]", "(", ")", "=", "|", "\n", "\n\n", "-", "~", "'", "&amp;", "#", " ", "a", "漢", "1", "\ue000", "```\n"]), max_size=60).map("".join))
def test_any_text(text):
    found = markup.families(text)
    assert set(found) <= set(markup.FAMILIES)
    assert isinstance(markup.clean(text), str)


def test_clean_keeps_structure():
    assert markup.clean("<h2>T</h2><ul><li>a &amp; b</li><li>c</li></ul><pre>x &lt; y</pre>") == "## T\n\n- a & b\n- c\n\n```\nx < y\n```"
    assert markup.clean("Title\n=====\n\n**bold** [t](http://u) ~~x~~\n\n```py\na *b* c\n```") == "# Title\n\nbold t x\n\n```\na *b* c\n```"
    assert markup.clean("== T ==\n* a\n** b\n[[P|word]] '''b''' {{X|y}}") == "# T\n- a\n  - b\nword b"
    assert markup.clean("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n\\(a+b\\) \\emph{c}") == "# A\n\n- x\n\n$a+b$ c"
    assert markup.clean(None) is None and markup.clean("") == ""


def page(n):
    return f"<html><body><div>Menu</div><h1>Title {n}</h1><p>Story {n * n}</p><div><span>Imprint</span></div></body></html>"


def test_wrapper():
    template = wrappers.induce([page(n) for n in range(5)])
    assert "Menu" in template and "Imprint" in template and "Story" not in template
    got = markup.clean(wrappers.without_template(page(9), template))
    assert got == "# Title 9\n\nStory 81"
    assert wrappers.induce([page(1)]) is None


def test_matching_keeps_order():
    a, b = wrappers.parse("<p>x</p><ul><li>1</li><li>2</li></ul>"), wrappers.parse("<ul><li>1</li></ul><p>x</p><ul><li>3</li></ul>")
    assert wrappers.match(a, b, [1000])[0] == 6


def test_matching_goes_through_large_tables():
    def wide(n):
        rows = "".join("<tr>" + "".join(f"<td>{n} {i} {j}</td>" for j in range(5)) + "</tr>" for i in range(40 + n))
        return f"<html><body><table>{rows}</table><footer><div>Imprint</div></footer></body></html>"

    assert "Imprint" in wrappers.induce([wide(n) for n in range(4)])
    deep = "<div>" * 3_000 + "x"
    assert wrappers.match(wrappers.parse(deep), wrappers.parse(deep + "<p>y"))[0] == 3_002


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "x", "y"]), max_size=14).map("".join), st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "x", "y"]), max_size=14).map("".join))
def test_matching_is_greatest(a, b):
    def best(x, y):
        if x.tag != y.tag:
            return 0
        row = [0] * (len(y.children) + 1)
        for c in x.children:
            new = [0]
            for j, d in enumerate(y.children):
                new.append(max(row[j + 1], new[j], row[j] + best(c, d)))
            row = new
        return 1 + row[-1]

    x, y = wrappers.parse(a), wrappers.parse(b)
    got, pairs = wrappers.match(x, y)
    assert got == best(x, y) == len(pairs) and all(c.tag == d.tag for c, d in pairs)


def test_wrapper_keeps_the_rest_of_the_source():
    def rich(n):
        return (
            "<html><body><ul><li>Home</li><li>News</li></ul><p>foo%d <b>bar%d</b> baz &amp; q%d</p><pre>if x%d:\n    y\n</pre>"
            "<table><tr><td>Yes</td><td>%s</td></tr></table></body></html>" % (n, n, n, n, "Yes" if n == 2 else n)
        )

    template = wrappers.induce([rich(n) for n in range(6)])
    want = "<html><body><ul></ul><p>foo2 <b>bar2</b> baz &amp; q2</p><pre>if x2:\n    y\n</pre><table><tr><td></td><td>Yes</td></tr></table></body></html>"
    assert wrappers.without_template(rich(2), template) == want
    assert wrappers.induce([f"<html><p>{n}</p></html>" for n in range(4)]) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<br/>", "<!-- c -->", "&lt;", "&", "<", "\n", "\r\n", " ", "x", "漢", "<pre>", "<script>", "</script>", "<x y='"]), max_size=25).map("".join))
def test_texts_are_where_they_stand(text):
    for _, node in wrappers._nodes(wrappers.parse(text)):
        if node.tag == "#text":
            assert " ".join(html.unescape(text[slice(*node.span)]).split()) == node.text


def test_template_of_all_pages(spark):
    layout = lambda n: page(n) if n % 6 else f"<html><body><p>Only {n}</p></body></html>"
    rows = [(i, layout(i), "h") for i in range(1, 30)] + [(100 + i, f"<html><p>{i // 20}</p><div>Menu</div></html>", "copies") for i in range(80)]
    got = {r.row_id: r.clean for r in markup.clean_markup(spark.createDataFrame(rows, "row_id long, text string, host string")).collect()}
    assert got[6] == "Only 6" and all(got[i] == f"# Title {i}\n\nStory {i * i}" for i in range(1, 30) if i % 6)
    assert all(got[100 + i] == str(i // 20) for i in range(80))
    few = dict(wrappers.templates(spark.createDataFrame(rows, "row_id long, text string, host string"), "text", "host").collect())
    for host in few:
        assert few[host] == wrappers.induce([t for _, t, h in rows if h == host])


def test_table(spark):
    rows = [(i, page(i), "h", "t") for i in range(4)] + [(9, None, "h", "t"), (10, "", None, "t"), (11, "**x** " * 30_000, None, None), (0, page(0), "h", "t")]
    df = spark.createDataFrame(rows, "row_id long, text string, host string, template string")
    got = {r.row_id: r for r in markup.clean_markup(df).collect()}
    assert got[1].clean == "# Title 1\n\nStory 1" and got[1].families == ["html"] and got[1].template == "t"
    assert got[9].clean is None and got[9].families == [] and got[11].families == ["markdown"]
    assert markup.clean_markup(df.limit(0)).count() == 0


@pytest.mark.parametrize("opening", ["<pre>", "\\begin{verbatim}", "<!--", "''a ", "{|\n", "\\(", "\\[", "<script>", "` `` ``` ", "\\begin{equation}"])
def test_openings_without_an_end_take_linear_time(opening):
    import time

    text = opening * (300_000 // len(opening))
    began = time.perf_counter()
    markup.families(text)
    markup.clean(text, list(markup.FAMILIES))
    assert time.perf_counter() - began < 5


def test_marks_pair_up():
    text = "a `` b ` c `` d `e` f\n\n`g\n\nh`"
    assert [text[m.start() : n.end()] for m, n in markup.enclosed(text, markup.CODE)] == ["`` b ` c ``", "`e`"]
    assert markup.replaced("x<!-- y -->z<!-- w", markup.COMMENT, lambda *_: "") == "xz<!-- w"
