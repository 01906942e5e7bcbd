"""Markup of text documents: which language a text is written in, its blocks, and clean text that keeps them (problem 3)."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from quirefold.llm import latex_text


class Block(NamedTuple):
    kind: str  # heading, list_item, code, formula, or text
    level: int
    text: str  # clean text; the source of code and formulas
    path: str  # how it is marked: its branch in the site style tree


WORD = re.compile(r"[^\W_]+")


def first_word(text: str) -> str:
    """The first run of letters and digits in lower case; empty where there is none."""
    m = WORD.search(text)
    return m[0].lower() if m else ""


# -- which language ---------------------------------------------------------------------------------------------------------

_OPAQUE = re.compile(
    r"(?ms)^ {0,3}(```+|~~~+).*?^ {0,3}\1[`~]*[ \t]*$|<pre\b.*?</pre\s*>|<syntaxhighlight\b.*?</syntaxhighlight>|<source\b.*?</source>"
    r"|\\begin\{(verbatim|lstlisting|minted|Verbatim)\}.*?\\end\{\2\}|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<nowiki>.*?</nowiki>",
    re.I,
)
_TEX = re.compile(r"\\(?:(?:sub)*section\*?\s*[{\[]|(?:sub)?paragraph\*?\{|chapter\*?\{|begin\{|(?<![\w:.\\]\\)item\b|emph\{|textbf\{|textit\{|texttt\{|underline\{|href\{|cite\{|documentclass\b|usepackage\b)|\{\\(?:it|bf|em|tt)\s|^[ \t]*\\\[|\\\][ \t]*$", re.M)
#: Words between double underscores that wikis read as switches.
_SWITCHES = r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOGALLERY|HIDDENCAT|INDEX|NOINDEX|NOTITLECONVERT|NOCONTENTCONVERT|DISAMBIG|STATICREDIRECT)__"
_WIKI = re.compile(r"^(={1,6})[^=\n].*?\1[ \t]*(?:<!--.*)?$|''+(?=\S)[^'\n]+?''|\[\[[^\]\n]+\]\]|^\{\||^\{\{[^{}\n]+\}\}|\{\{citation|<syntaxhighlight\b|<math\b|" + _SWITCHES + r"|<nowiki>|(?<![\]\w!])\[https?://[^\s\]]+ [^\]\n]+\]|<ref\b", re.M)
_HTML = re.compile(r"</?(?:h[1-6]|ul|ol|li|div|table|tr|td|pre|html|head|body|script|style|blockquote)\b", re.I)
_HTML_BLOCK = re.compile(r"^ {0,3}</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|th|thead|tbody|html|head|body|title|dl|dt|dd|blockquote|section|article|header|footer|nav|aside|main|form|center|details|summary|figure|hr|link|meta)\b[^\n]*(?:\n[ \t]*\S[^\n]*)*", re.M | re.I)
_PRE = re.compile(r"<(pre|script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_MD = re.compile(r"^ {0,3}#{1,6}[ \t]|^[^\n|]*\S[^\n]*\n {0,3}(?:-{2,}|={2,})[ \t]*$|^ {0,3}(?:```|~~~)|\]\(|\]\[|\*\*\w|(?<!\w)__\w|~~\w|^\$\$|^ {0,3}[-+*] +\S|^ {0,3}\d{1,9}[.)] +\S|^\|[-:| ]+\|$|`[^`\n]+`|(?<![\w*])\*\w[^*\n]*\*(?!\w)", re.M)


#: Marks that also occur by chance: in paths and formulas of other languages, and as double brackets.
_TEX_WEAK = re.compile(r"\\(?:item\b|emph\{|textbf\{|textit\{|texttt\{|underline\{|href\{|cite\{)|\{\\(?:it|bf|em|tt)\s|[ \t]*\\\[|\\\][ \t]*$")
_WIKI_WEAK = re.compile(r"\[\[[^\]\n]+\]\]")
#: Marks of Markdown that no wiki and no LaTeX has.
_MD_OWN = re.compile(r"^ {0,3}(?:- +\S|\d{1,9}[.)] +\S|```|~~~)|\]\(|\*\*\w|^\|[-:| ]+\|$|`[^`\n]+`|^[^\n|=]*\S[^\n]*\n {0,3}(?:-{2,}|={2,})[ \t]*$|^ {0,3}#{1,6}[ \t]+\S[^\n]*\n(?=\s*\n)", re.M)


def _outweighs(marks: re.Pattern, weak: re.Pattern, u: str) -> bool:
    """Whether a language's marks outweigh Markdown's own; chance marks alone must be more than these."""
    got = [weak.fullmatch(m[0]) is None for m in marks.finditer(u)]
    if not got:
        return False
    own = sum(1 for _ in _MD_OWN.finditer(u))
    return 3 * sum(got) + len(got) - sum(got) > own if not any(got) else 3 * sum(got) + len(got) - sum(got) >= own


def language(text: str) -> str:
    """html, markdown, wiki or latex. Marks inside code, comments and scripts say nothing. The marks of each language are counted,
    those that stand in no other threefold; a text is LaTeX or wiki text unless Markdown's own marks outweigh it. HTML's blocks also
    stand in Markdown; a text without marks is Markdown of plain paragraphs."""
    if not ("\\" in text or "<" in text or "[" in text or "=" in text or "#" in text or "\n" in text or "*" in text or "$" in text or "'" in text or "`" in text or "{" in text):
        return "markdown"
    u = _OPAQUE.sub("\n", text)
    if re.search(r"\\begin\{(?:verbatim|lstlisting|minted|document)\}", text) or _outweighs(_TEX, _TEX_WEAK, u):
        return "latex"
    if re.search(r"<syntaxhighlight\b|<nowiki>", text) or _outweighs(_WIKI, _WIKI_WEAK, u):
        return "wiki"
    if not _HTML.search(text):
        return "markdown"
    # tags stand in Markdown too, as blocks: HTML alone it is if nothing outside them is Markdown
    return "markdown" if _MD.search(_HTML_BLOCK.sub("\n", u)) or re.search(r"(?m)^ {0,3}(?:```|~~~)", _PRE.sub("", text)) else "html"


# -- HTML -------------------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|<(script|style|title|textarea|template|noscript)\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?:</\1\s*>|\Z)"""
    r"""|<(pre)\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?:</pre\s*>|\Z)|<(math)\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)</math\s*>"""
    r"""|\\\[(.*?)\\\]|\$\$(.*?)\$\$|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S | re.I,
)
_BLOCK_TAGS = {"p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "dl", "dt", "dd", "blockquote", "section", "article", "header", "footer", "nav", "main", "aside", "body", "html", "head", "form", "figure", "hr", *(f"h{k}" for k in range(1, 7))}


def strip_tags(s: str) -> str:
    """Text without tags and comments, entities decoded."""
    if "<" in s:
        s = _TAG.sub("", re.sub(r"(?i)<br\s*/?>", "\n", re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", s)))
    return html.unescape(s) if "&" in s else s


def parse_html(text: str) -> list[Block]:
    out: list[Block] = []
    stack: list[str] = []  # open block tags
    buf: list[str] = []
    target: list | None = None  # the open heading or item: [kind, level, index in out]

    def flush() -> None:
        nonlocal target
        t = re.sub(r"\s+", " ", html.unescape("".join(buf))).strip()
        buf.clear()
        if target is not None:
            kind, level, at, path = target
            out[at] = Block(kind, level, t, path)
            target = None
        elif t:
            out.append(Block("text", 0, t, "/".join(stack) or "text"))

    def begin(kind: str, level: int, path: str) -> None:
        nonlocal target
        flush()
        out.append(Block(kind, level, "", path))
        target = [kind, level, len(out) - 1, path]

    at = 0
    for m in _TOKEN.finditer(text):
        buf.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            if m[1].lower() == "script" and re.search(r"math/(?:tex|asciimath).*mode\s*=\s*display", m[2], re.I | re.S):
                flush()
                out.append(Block("formula", 0, m[3].strip(), "/".join([*stack, "math"])))
        elif m[4]:
            flush()
            out.append(Block("code", 0, strip_tags(m[6]).strip("\n"), "/".join([*stack, "pre"])))
        elif m[7]:
            if re.search(r"display\s*=\s*[\"']?block", m[8], re.I):
                flush()
                out.append(Block("formula", 0, strip_tags(m[9]).strip(), "/".join([*stack, "math"])))
            else:
                buf.append(strip_tags(m[9]))
        elif m[10] is not None or m[11] is not None:
            flush()
            out.append(Block("formula", 0, html.unescape((m[10] if m[10] is not None else m[11]).strip()), "/".join([*stack, "math"])))
        elif m[13]:
            tag, close = m[13].lower(), bool(m[12])
            if tag == "br":
                buf.append("\n")
            elif tag in _BLOCK_TAGS:
                if re.fullmatch(r"h[1-6]", tag):
                    flush() if close else begin("heading", int(tag[1]), "/".join([*stack, tag]))
                elif tag == "li":
                    if close:
                        flush()
                        if "li" in stack:
                            del stack[len(stack) - 1 - stack[::-1].index("li") :]
                    else:
                        if "li" in stack and not any(x in ("ul", "ol") for x in stack[len(stack) - stack[::-1].index("li") :]):
                            del stack[len(stack) - 1 - stack[::-1].index("li") :]
                        begin("list_item", max(1, sum(x in ("ul", "ol") for x in stack)), "/".join([*stack, tag]))
                        stack.append(tag)
                else:
                    # a paragraph that opens an item's text belongs to the item
                    if not (target is not None and target[0] == "list_item" and tag in ("p", "div") and not close and not "".join(buf).strip()):
                        flush()
                    if close:
                        if tag in stack:
                            del stack[len(stack) - 1 - stack[::-1].index(tag) :]
                    elif tag not in ("hr",):
                        if tag == "p" and stack and stack[-1] == "p":
                            stack.pop()
                        stack.append(tag)
    buf.append(text[at:])
    flush()
    return out


# -- Markdown ---------------------------------------------------------------------------------------------------------------

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( *)(`{3,}(?=[^`]*$)|~{3,})[ \t]*([^\n]*)$")
_ITEM = re.compile(r"( *)([-+*]|\d{1,9}[.)])( +(?=\S)|\t|$)(.*)$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_REFDEF = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+")
_HTML_RAW = re.compile(r"(?i) {0,3}<(pre|script|style|textarea)\b")


def inline_md(s: str) -> str:
    """Inline Markdown as clean text."""
    if not any(c in s for c in "\\`*_[<&~!$"):
        return s.strip()
    kept: list[str] = []

    def keep(t: str) -> str:
        kept.append(t)
        return f"\x00{len(kept) - 1}\x01"

    s = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2].strip()), s, flags=re.S)
    s = _ESCAPE.sub(lambda m: keep(m[1]), s)
    s = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", s)
    s = re.sub(r"(?s)<!--.*?-->", "", s)
    if "<" in s:
        s = re.sub(r"(?i)<br\s*/?>", "\n", s)
        s = _TAG.sub("", s)
    s = re.sub(r"!\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", s)
    s = re.sub(r"\[\^[^\]]+\]", "", s)
    s = re.sub(r"\[((?:[^\[\]]|\[[^\]]*\])*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", s)
    s = re.sub(r"(\*{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", s, flags=re.S)
    s = re.sub(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", s, flags=re.S)
    s = re.sub(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", s, flags=re.S)
    s = html.unescape(s) if "&" in s else s
    if kept:
        s = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])], s)
    return s.strip()


def parse_markdown(text: str) -> list[Block]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = [x.expandtabs(4) if "\t" in x else x for x in lines]
    out: list[Block] = []
    para: list[str] = []
    items: list[int] = []  # content columns of the open items
    item_open = False  # the present paragraph is an item's first one
    i, n = 0, len(lines)
    blank = True

    def flush() -> None:
        nonlocal item_open
        if para:
            t = inline_md("\n".join(para))
            if item_open:
                b = out[-1]
                out[-1] = b._replace(text=t)
            elif t:
                out.append(Block("text", 0, t, "p"))
            para.clear()
        item_open = False

    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            flush()
            blank = True
            i += 1
            continue
        indent = len(line) - len(line.lstrip(" "))
        # how far the open items reach
        while items and indent < items[-1] and (blank or not para or _ITEM.match(line) or _ATX.match(line) or _FENCE.match(line)):
            items.pop()
        base = items[-1] if items else 0
        rel = indent - base if indent >= base else indent
        cur = line[base:] if indent >= base else line.lstrip(" ")
        if "<!--" in s and "`" not in s.split("<!--")[0]:  # comments, over several lines too
            rest = "\n".join(lines[i:])
            c = re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", rest, count=1)
            if c != rest:
                lines[i:] = c.split("\n")
                n = len(lines)
                if not lines[i].strip():
                    blank = True if not para else blank
                    if s.startswith("<!--"):
                        i += 1
                continue
        if rel >= 4 and not para:
            code = []
            while i < n and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) >= base + 4):
                code.append(lines[i][base + 4 :])
                i += 1
            while code and not code[-1].strip():
                code.pop()
            out.append(Block("code", 0, "\n".join(code), "code"))
            blank = True
            continue
        m = _FENCE.match(cur) if rel < 4 else None
        if m:
            flush()
            ch, size, code = m[2][0], len(m[2]), []
            i += 1
            close = re.compile(rf" *{re.escape(ch)}{{{size},}}[ \t]*$")
            while i < n and not close.match(lines[i]):
                code.append(lines[i][min(base + len(m[1]), len(lines[i]) - len(lines[i].lstrip(" "))) :])
                i += 1
            i += 1
            info = m[3].strip().lower()
            out.append(Block("formula" if info == "math" else "code", 0, "\n".join(code), "fence"))
            blank = True
            continue
        if m := _HTML_RAW.match(cur):
            flush()
            end = re.compile(rf"(?i)</{m[1]}\s*>")
            raw = [cur]
            while not end.search(lines[i]) and i + 1 < n:
                i += 1
                raw.append(lines[i])
            i += 1
            out += parse_html("\n".join(raw))
            blank = True
            continue
        if rel < 4 and s[0] == "<" and _HTML_BLOCK.match(cur):
            flush()
            raw = []
            while i < n and lines[i].strip():
                raw.append(lines[i])
                i += 1
            out += parse_html("\n".join(raw))
            blank = True
            continue
        if s.startswith(("$$", "\\[")) and rel < 4:
            end = "$$" if s.startswith("$$") else "\\]"
            body, rest = s[2:], ""
            if end in body:
                body, _, rest = body.partition(end)
                i += 1
            else:
                got = [body]
                i += 1
                while i < n and end not in lines[i]:
                    got.append(lines[i])
                    i += 1
                if i < n:
                    a, _, rest = lines[i].partition(end)
                    got.append(a)
                    i += 1
                body = "\n".join(got)
            flush()
            out.append(Block("formula", 0, body.strip(), "math"))
            blank = not rest.strip()
            if rest.strip():
                para.append(rest.strip())
            continue
        if (m := _ATX.match(cur)) and rel < 4:
            flush()
            out.append(Block("heading", len(m[1]), inline_md(m[2] or ""), f"h{len(m[1])}"))
            i += 1
            blank = True
            continue
        if para and not item_open and not items and (m := _SETEXT.match(line)):
            t = inline_md("\n".join(para))
            para.clear()
            out.append(Block("heading", 1 if m[1][0] == "=" else 2, t, "h1" if m[1][0] == "=" else "h2"))
            i += 1
            blank = True
            continue
        if _RULE.match(cur):
            flush()
            i += 1
            blank = True
            continue
        m = _ITEM.match(cur) if rel < 4 else None
        # only a list that starts at one may interrupt a paragraph, and not with an empty item
        if m and para and not items and not item_open and (not m[4].strip() or m[2][0].isdigit() and m[2][:-1] != "1"):
            m = None
        if m:
            flush()
            pad = len(m[3].expandtabs(4)) if m[3].strip(" ") == "" and 1 <= len(m[3]) <= 4 else 1
            items.append(base + len(m[1]) + len(m[2]) + pad)
            body = re.sub(r"^\[[ xX]\](?=\s|$)\s*", "", m[4])
            out.append(Block("list_item", len(items), "", "ol/li" if m[2][0].isdigit() else "ul/li"))
            item_open = True
            if body:
                para.append(body)
            i += 1
            blank = False
            continue
        if not para and _REFDEF.match(line) and not s.startswith("[^"):
            i += 1
            continue
        if not para and s.startswith("[^") and re.match(r"\[\^[^\]]+\]:", s):
            s = re.sub(r"^\[\^[^\]]+\]:\s*", "", s)
        if s.startswith(">"):  # a quote is a document of its own
            flush()
            quoted = []
            while i < n and lines[i].lstrip().startswith(">"):
                q = lines[i].lstrip()[1:]
                quoted.append(q[1:] if q.startswith(" ") else q)
                i += 1
            out += [x._replace(path=f"blockquote/{x.path}") for x in parse_markdown("\n".join(quoted))]
            blank = False
            continue
        if "$$" in s and (m := re.search(r"(?<!\\)\$\$(.+?)\$\$", s)) and not re.search(r"`[^`]*\$\$", s):
            para.append(s[: m.start()])
            flush()
            out.append(Block("formula", 0, m[1].strip(), "math"))
            lines[i] = s[m.end() :]
            if not lines[i].strip():
                i += 1
            continue
        para.append(s)
        blank = False
        i += 1
    flush()
    return out


# -- wiki text --------------------------------------------------------------------------------------------------------------

_WIKI_OPAQUE = re.compile(
    r"<!--.*?(?:-->|\Z)|<nowiki>(.*?)(?:</nowiki>|\Z)|<nowiki\s*/>|<(pre|syntaxhighlight|source)\b([^>]*)>(.*?)(?:</\2\s*>|\Z)"
    r"|(:*)[ \t]*<math\b([^>]*)>(.*?)</math\s*>|<(?:script|style)\b.*?</(?:script|style)\s*>|<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref\s*>",
    re.S | re.I,
)


_LINE_END = re.compile(r"[ \t]*(?:\n|\Z)")


def inline_wiki(s: str) -> str:
    """Inline wiki text as clean text."""
    if "[" in s:
        s = re.sub(r"\[\[(?:Category|Kategorie|Categor[iíy]a|Catégorie|File|Image|Datei|Fichier|Archivo)\s*:[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", s, flags=re.I)
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", s)
    if "'" in s:
        s = re.sub(r"'{2,}", "", s)
    s = re.sub(_SWITCHES, "", s) if "__" in s else s
    s = _TAG.sub("", s) if "<" in s else s
    return (html.unescape(s) if "&" in s else s).strip()


def parse_wiki(text: str) -> list[Block]:
    blocks: list[Block] = []
    literal: list[str] = []

    def opaque(m: re.Match) -> str:
        if m[1] is not None:
            literal.append(m[1])
            return f"\x02{len(literal) - 1}\x03"
        if m[2]:
            body = m[4].strip("\n")
            blocks.append(Block("code", 0, html.unescape(body) if m[2].lower() == "pre" else body, m[2].lower()))
            return f"\n\x00{len(blocks) - 1}\x01\n"
        if m[7] is not None:
            alone = (m.start() == 0 or text[m.start() - 1] == "\n") and _LINE_END.match(text, m.end())
            if re.search(r"display\s*=\s*[\"']?block", m[6], re.I) or (alone and m[5]):
                blocks.append(Block("formula", 0, m[7].strip(), "math"))
                return f"\n\x00{len(blocks) - 1}\x01\n"
            literal.append(m[7])
            return m[5] + f"\x02{len(literal) - 1}\x03"
        return ""

    s = _WIKI_OPAQUE.sub(opaque, text.replace("\r\n", "\n"))
    while "{{" in s:  # templates, innermost first
        t = re.sub(r"\{\{[^{}]*\}\}", "", s)
        if t == s:
            break
        s = t
    back = lambda x: re.sub(r"\x02(\d+)\x03", lambda m: literal[int(m[1])], x) if "\x02" in x else x
    out: list[Block] = []
    para: list[str] = []

    def flush() -> None:
        t = back(inline_wiki("\n".join(para)))
        para.clear()
        if t:
            out.append(Block("text", 0, t, "p"))

    table = False
    for line in s.split("\n"):
        if m := re.match(r"\s*\x00(\d+)\x01\s*$", line):
            flush()
            out.append(blocks[int(m[1])])
            continue
        if not line.strip():
            flush()
            continue
        if line.lstrip().startswith("{|"):
            flush()
            table = True
            continue
        if table:
            if line.lstrip().startswith("|}"):
                table = False
                continue
            t = line.lstrip()
            if t.startswith(("|", "!")):
                if not t.startswith(("|-", "|+")):
                    cells = re.split(r"\|\||!!", t[1:])
                    x = back(" | ".join(inline_wiki(c) for c in cells))
                    if x:
                        out.append(Block("text", 0, x, "table/tr"))
                continue
        if m := re.match(r"(={1,6})(.+?)\1[ \t]*$", line):
            flush()
            out.append(Block("heading", len(m[1]), back(inline_wiki(m[2])), f"h{len(m[1])}"))
        elif m := re.match(r"([*#:;]+)[ \t]*(.*)$", line):
            flush()
            t = back(inline_wiki(m[2]))
            if m[1][-1] in "*#":
                out.append(Block("list_item", len(m[1]), t, "/".join("ul" if c == "*" else "ol" for c in m[1]) + "/li"))
            elif t:
                out.append(Block("text", 0, t, "dl/dd"))
        elif line.startswith(" ") and not para:
            out.append(Block("code", 0, inline_wiki(line[1:]), "space")) if not (out and out[-1].path == "space") else out.__setitem__(-1, out[-1]._replace(text=out[-1].text + "\n" + inline_wiki(line[1:])))
        elif m := re.match(r"(?i)\s*<li\b[^>]*>(.*)$", line):
            flush()
            out.append(Block("list_item", 1, back(inline_wiki(m[1])), "ul/li"))
        elif m := re.match(r"(?i)\s*<h([1-6])\b[^>]*>(.*?)</h\1>", line):
            flush()
            out.append(Block("heading", int(m[1]), back(inline_wiki(m[2])), f"h{m[1]}"))
        else:
            para.append(line)
    flush()
    return out


# -- all --------------------------------------------------------------------------------------------------------------------


_PARSERS = {"html": parse_html, "markdown": parse_markdown, "wiki": parse_wiki, "latex": latex_text.parse_latex}


def parse(text: str) -> tuple[str, list[Block]]:
    """(language, blocks); lines may end in any way."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lang = language(text)
    return lang, [b if isinstance(b, Block) else Block(*b) for b in _PARSERS[lang](text)]


def render(blocks: list[Block]) -> str:
    """Clean text that still shows its structure: headings by #, items by -, code fenced, formulas in $$."""
    out = []
    for b in blocks:
        if b.kind == "heading":
            out.append("#" * b.level + " " + b.text)
        elif b.kind == "list_item":
            out.append("  " * (b.level - 1) + "- " + b.text)
        elif b.kind == "code":
            out.append("```\n" + b.text + "\n```")
        elif b.kind == "formula":
            out.append("$$\n" + b.text + "\n$$")
        else:
            out.append(b.text)
    return "\n\n".join(out)
