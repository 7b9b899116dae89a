"""Markup families in texts, and clean text that keeps headings, lists, code and formulas."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import wrappers
from loomstead.session import small, spread

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Elements of HTML.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption "
    "center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption "
    "figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label "
    "legend li link main map mark marquee menu meta meter nav noframes noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_ATTRIBUTES = r"(?:\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*"
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTRIBUTES})\s*(/?)>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^[ \t]{0,3}(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*$", re.M)
_GAP, _LINE = re.compile(r"\n[ \t]*\n"), re.compile(r"\n")
#: What stands between two marks: the opening and the closing one, which agree in their first group, and what may not lie between.
COMMENT = (re.compile(r"<!--"), re.compile(r"-->"), None)
CODE = (re.compile(r"(`+)"), re.compile(r"(`+)"), _GAP)
PRE = (re.compile(r"<pre(?:\s[^<>]*)?>", re.I), re.compile(r"</pre\s*>", re.I), None)
VERBATIM = tuple(re.compile(rf"\\{w}\{{(verbatim\*?|lstlisting|minted|Verbatim)\}}") for w in ("begin", "end")) + (None,)
EQUATION = tuple(re.compile(rf"\\{w}\{{(equation|align|gather|multline)\*?\}}") for w in ("begin", "end")) + (None,)
ROUND = (re.compile(r"(?<!\\)\\\((?!\\\))"), re.compile(r"\\\)"), _GAP)
SQUARE = (re.compile(r"(?<!\\)\\\[(?!\\\])"), re.compile(r"\\\]"), _GAP)
QUOTES = (re.compile(r"(?<!')('{5}|'{3}|'{2})(?=[^'\s])"), re.compile(r"(?<=[^'\s])('{5}|'{3}|'{2})(?!')"), _LINE)
TABLE = (re.compile(r"^\{\|[^\n]*\n", re.M), re.compile(r"^\|\}", re.M), None)
MARKDOWN = {
    "heading": re.compile(r"^ {0,3}#{1,6}[ \t]+[^\s#][^\n]*$|^(?![ \t]*$)(?!\s{0,3}[-*+>|#])[^\n]+\n {0,3}(?:=+|-{2,})[ \t]*$", re.M),
    "link": re.compile(r"!?\[[^\[\]\n]*\]\((?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)"),
    "definition": re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+", re.M),
    "autolink": re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"),
    "strikethrough": re.compile(r"(?<![~\w])~~(?=[^\s~])(?:(?!\n[ \t]*\n)[^~])+?(?<=[^\s~])~~(?!~)"),
    "star": re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])(?:(?!\n[ \t]*\n)[^*])+?(?<=[^\s*\\])\1(?![\w*])"),
    "bar": re.compile(r"(?<![\w_\\])(_{1,3})(?=[^\s_])(?:(?!\n[ \t]*\n)(?:[^_]|(?<=\w)_(?=\w)))+?(?<=[^\s_\\])\1(?![\w_])"),
}
_DELIMITERS = re.compile(r"^[ \t]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
WIKI = {
    "heading": re.compile(r"^(={2,6})(?!=)(?=[^\n]*[^=\s])[^\n]*?(?<!=)\1[ \t]*$", re.M),
    "link": re.compile(r"\[\[(?![\d,.\s|]*\]\])(?![\s\-])[^\[\]\n]+\]\]"),
    "outer": re.compile(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+(?: [^\[\]\n]+)?\](?![(\[:])"),
    "template": re.compile(r"\{\{\s*[A-Za-z#:][^{}]*\}\}"),
}
LATEX = {
    "environment": re.compile(r"\\begin\{[A-Za-z]+\*?\}"),
    "command": re.compile(r"(?<!\\)\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])*\{"),
    "display": re.compile(r"\$\$(?=\s*\S)(?:(?!\n[ \t]*\n)[^$])+\$\$"),
    "inline": re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?:(?!\n[ \t]*\n)(?:[^$\\]|\\.))+?(?<=[^\s\\])\$(?![\d\w$])", re.S),
}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def enclosed(text: str, marks: tuple) -> list[tuple[re.Match, re.Match]]:
    """The outermost pairs of marks in order, each opening with the next closing one that fits.

    Closing marks are looked up by place, so that openings without an end cost no walk to the end of the text.
    """
    opening, closing, limit = marks
    ends: dict[str, list[re.Match]] = {}
    for m in closing.finditer(text):
        ends.setdefault(m[1] if closing.groups else "", []).append(m)
    places = {k: [m.start() for m in of] for k, of in ends.items()}
    limits = [m.start() for m in limit.finditer(text)] if limit and ends else []
    out, at = [], 0
    for m in opening.finditer(text) if ends else ():
        key = m[1] if opening.groups else ""
        if m.start() < at or key not in ends:
            continue
        n = bisect_left(places[key], m.end())
        if n == len(places[key]):
            continue
        before = bisect_left(limits, m.end())
        if before < len(limits) and limits[before] < places[key][n]:
            continue
        out.append((m, ends[key][n]))
        at = ends[key][n].end()
    return out


def replaced(text: str, marks: tuple, by: Callable[[str, str], str] | None = None) -> str:
    """The text with what stands between marks, and these, replaced: by(opening, inside), or blanks."""
    at, out = 0, []
    for m, end in enclosed(text, marks):
        whole = text[m.start() : end.end()]
        out += [text[at : m.start()], by(m[0], text[m.end() : end.start()]) if by else re.sub(r"[^\n]", " ", whole)]
        at = end.end()
    return "".join([*out, text[at:]]) if out else text


def _without_fences(text: str) -> tuple[str, bool]:
    """The text with fences and what they quote blanked; an open fence goes to the end."""
    out, at, found = [], 0, False
    while m := FENCE.search(text, at):
        found = True
        mark = m[1]
        close = re.compile(rf"^[ \t]{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, m.end())
        end = close.end() if close else len(text)
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join([*out, text[at:]]), found


def _pipe_table(text: str) -> bool:
    lines = text.split("\n")
    cells = lambda s: len(s.strip().strip("|").split("|"))
    return any(
        "|" in a + b and "-" in b and _DELIMITERS.match(b) and a.strip() and not a.lstrip().startswith("{|") and cells(a) == cells(b)
        for a, b in zip(lines, lines[1:])
    )


def families(text: str | None) -> list[str]:
    """The families of which a text holds a construct, in order; none for null or empty text.

    What fences, code spans, pre elements and verbatim environments quote doesn't count, they themselves do.
    """
    if not text or not re.search(r"[<&#*_~`\[|={}\\$'-]", text):
        return []
    found = set()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text, fenced = _without_fences(text)
        if fenced:
            found.add("markdown")
    if "\\begin" in text and enclosed(text, VERBATIM):
        found.add("latex")
        text = replaced(text, VERBATIM)
    if "`" in text and enclosed(text, CODE):
        found.add("markdown")
        text = replaced(text, CODE)
    if "<" in text:
        if "<!--" in text and enclosed(text, COMMENT):
            found.add("html")
            text = replaced(text, COMMENT)
        if re.search("<pre", text, re.I) and enclosed(text, PRE):
            found.add("html")
            text = replaced(text, PRE)
        if any(m[2].lower() in ELEMENTS for m in TAG.finditer(text)):
            found.add("html")
    if "&" in text and "html" not in found:
        if any(e[1] == "#" or e[1:] in html5 for e in ENTITY.findall(text)):
            found.add("html")
    plain = TAG.sub(_blank, text) if "<" in text else text
    if "\\" in plain or "$" in plain:
        if any(p.search(plain) for p in LATEX.values()) or enclosed(plain, ROUND) or enclosed(plain, SQUARE):
            found.add("latex")
        for p in ("display", "inline"):
            plain = LATEX[p].sub(_blank, plain)
        plain = replaced(replaced(plain, ROUND), SQUARE)
    if "=" in plain or "''" in plain or "[" in plain or "{" in plain:
        if any(p.search(plain) for p in WIKI.values()) or enclosed(plain, QUOTES) or enclosed(plain, TABLE):
            found.add("wiki")
        # What wiki markup holds is no markdown.
        for p in WIKI.values():
            plain = p.sub(_blank, plain)
        plain = replaced(replaced(plain, QUOTES), TABLE)
    if "markdown" not in found and (any(p.search(plain) for p in MARKDOWN.values()) or _pipe_table(plain)):
        found.add("markdown")
    return [f for f in FAMILIES if f in found]


def clean(text: str | None, found: list[str] | None = None) -> str | None:
    """The text without markup: headings as #, lists as -, code between fences, formulas in dollars; null stays null."""
    if text is None:
        return None
    found = families(text) if found is None else found
    if not found:
        return text
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at, parts = 0, []
    while m := FENCE.search(text, at):
        close = re.compile(rf"^[ \t]{{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(text, m.end())
        body = text[m.end() : close.start() if close else len(text)].strip("\n")
        parts += [text[at : m.start()], keep(f"```\n{body}\n```")]
        at = close.end() if close else len(text)
    text = "".join([*parts, text[at:]])
    text = replaced(text, VERBATIM, lambda _, said: keep("```\n" + said.strip("\n") + "\n```"))
    text = replaced(text, PRE, lambda _, said: "\n" + keep("```\n" + html.unescape(TAG.sub("", said)).strip("\n") + "\n```") + "\n")
    text = replaced(text, CODE, lambda _, said: keep("`" + said.strip() + "`"))
    if "latex" in found:
        text = LATEX["display"].sub(lambda m: keep("$$" + m[0][2:-2].strip() + "$$"), text)
        text = replaced(text, SQUARE, lambda _, said: keep("$$" + said.strip() + "$$"))
        text = replaced(text, ROUND, lambda _, said: keep("$" + said.strip() + "$"))
        text = replaced(text, EQUATION, lambda _, said: keep("$$" + said.strip() + "$$"))
        text = LATEX["inline"].sub(lambda m: keep(m[0]), text)
        levels = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        text = re.sub(r"\\(chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * levels[m[1]] + " " + m[2] + "\n", text)
        text = re.sub(r"^[ \t]*\\item[ \t]*", "- ", text, flags=re.M)
        text = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}]*\})*", "", text)
        for _ in range(3):
            text = re.sub(r"(?<!\\)\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])*\{([^{}]*)\}", r"\1", text)
        text = text.replace(r" \\", "")
    if "html" in found:
        text = replaced(text, COMMENT, lambda *_: "")
        text = replaced(text, wrappers.HIDDEN, lambda *_: "")
        text = re.sub(r"<![A-Za-z][^<>]*>", "", text)
        text = wrappers.html_to_text(text, ELEMENTS, TAG)
        text = ENTITY.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), text)
    if "wiki" in found:
        text = WIKI["heading"].sub(lambda m: "#" * (len(m[1]) - 1) + " " + m[0].strip().strip("=").strip(), text)
        text = re.sub(r"\[\[(?:File|Image|Category):[^\[\]\n]+\]\]", "", text)
        text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
        text = re.sub(r"(?<!\[)\[(?:https?|ftp)://[^\s\[\]]+ ([^\[\]\n]+)\]", r"\1", text)
        text = replaced(text, QUOTES, lambda _, said: said.strip("'"))
        text = WIKI["template"].sub("", text)
        text = re.sub(r"^(?:\{\||\|\}|\|-)[^\n]*\n?", "", text, flags=re.M) if enclosed(text, TABLE) else text
        text = re.sub(r"^\*+[ \t]*", lambda m: "  " * (m[0].count("*") - 1) + "- ", text, flags=re.M)
    if "markdown" in found:
        text = re.sub(r"^(?![ \t]*$)(?!\s{0,3}[-*+>|#])([^\n]+)\n {0,3}(=+|-{2,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], text, flags=re.M)
        text = re.sub(r"^ {0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", r"\1 \2", text, flags=re.M)
        text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
        text = MARKDOWN["definition"].sub("", text)
        text = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
        text = MARKDOWN["autolink"].sub(lambda m: m[0][1:-1], text)
        for name, mark in (("strikethrough", "~"), ("star", "*"), ("bar", "_")):
            text = MARKDOWN[name].sub(lambda m, mark=mark: m[0].strip(mark), text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    for _ in range(2):
        text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)
    return text.strip()


def clean_markup(df: DataFrame, text: str = "text", host: str = "host") -> DataFrame:
    """Replace the text by (families, clean): the families found, and the text without their markup.

    Whole HTML pages of a host with several pages first lose what their template repeats (see wrappers). Null text
    has no families and stays null; a null host has no template. Other columns are kept.
    """
    keep = [c for c in df.columns if c not in (text, host, "families", "clean")]
    templates = wrappers.templates(df, text, host).withColumnRenamed("template", "_template")
    joined = spread(df.select(*(f"`{c}`" for c in keep), F.col(text).alias("_text"), F.col(host).alias("_host"))).join(
        small(templates), "_host", "left"
    )
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", families array<string>, clean string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cleaned = [], []
            for said, template in zip(batch.column("_text").to_pylist(), batch.column("_template").to_pylist()):
                of = families(said)
                if template and "html" in of and wrappers.is_page(said):
                    said = wrappers.without_template(said, template)
                found.append(of)
                cleaned.append(clean(said, of))
            made = [pa.array(found, pa.list_(pa.string())), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "families", "clean"])

    return joined.select(*(f"`{c}`" for c in keep), "_text", "_template").mapInArrow(run, schema)
