"""LaTeX as blocks of clean text."""

from __future__ import annotations

import re
import unicodedata

#: Accents and the combining marks they stand for.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a"}
#: Commands that are characters.
CHARS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "textless": "<", "textgreater": ">", "textbackslash": "\\", "textbar": "|", "textasciitilde": "~", "textasciicircum": "^", "textunderscore": "_", "ldots": "…", "dots": "…", "textellipsis": "…", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "euro": "€", "quad": " ", "qquad": " ", "newline": "\n", "par": "\n", "LaTeX": "LaTeX", "TeX": "TeX", "textquotedblleft": "“", "textquotedblright": "”", "textendash": "–", "textemdash": "—", "guillemotleft": "«", "guillemotright": "»"}
#: Commands whose arguments are no text.
SILENT = {"cite", "citep", "citet", "label", "ref", "eqref", "pageref", "index", "includegraphics", "input", "include", "bibliography", "bibliographystyle", "usepackage", "documentclass", "vspace", "hspace", "pagestyle", "setlength", "newcommand", "renewcommand", "footnotemark"}

_CODE = re.compile(r"\\begin\{(verbatim\*?|Verbatim|lstlisting|minted|alltt)\}((?:\[[^\]\n]*\])?(?:(?<=\})\{[^}\n]*\})?)(.*?)(?:\\end\{\1\}|\Z)", re.S)
_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\sA-Za-z{*])(.*?)\1")
_FORMULA = re.compile(r"\\\[(.*?)\\\]|(?<!\\)\$\$(.*?)\$\$|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|flalign|alignat)(\*?)\}(.*?)\\end\{\3\4\}", re.S)
_MARK = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*(?:\[[^\]]*\]\s*)?\{|\\(item)\b\s*(?:\[((?:[^\[\]]|\{[^}]*\})*)\])?|\\(begin|end)\{([A-Za-z*]+)\}(?:\[[^\]\n]*\])?|\x00(\d+)\x01|(\n[ \t]*\n)")
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def braced(s: str, at: int) -> int:
    """Where the group ends whose brace opens just before at."""
    depth = 1
    for m in re.compile(r"\\.|[{}]", re.S).finditer(s, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.start()
    return len(s)


def clean(s: str) -> str:
    """LaTeX text without its commands, characters decoded."""
    if "\\" in s:
        s = re.sub(r"\\([`'^\"~=.])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))", lambda m: (m[2] or m[3]) + ACCENTS[m[1]], s)
        s = re.sub(r"\\([uvHckr])\{\\?([A-Za-z])\}", lambda m: m[2] + ACCENTS[m[1]], s)
        s = re.sub(r"\\href\s*\{(?:[^{}]|\{[^{}]*\})*\}\s*\{", "{", s)
        s = re.sub(r"\\(%s)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*" % "|".join(sorted(SILENT)), "", s)
        s = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", s)
        s = re.sub(r"\\([#$%&_{}])", lambda m: chr(0xE000 + ord(m[1])), s)  # kept out of the way of the next steps
        s = re.sub(r"\\([A-Za-z]+)\*?(?:\{\}|[ \t]*)", lambda m: CHARS.get(m[1], ""), s)
        s = re.sub(r"\\([,;:! ])", " ", s)
        s = s.replace("\\", "")
    s = s.replace("~", " ").replace("``", "“").replace("''", "”")
    s = re.sub(r"[{}]", "", s)
    s = re.sub(r"(?<!\$)\$(?!\$)", "", s)
    s = re.sub(r"[\ue000-\ue07f]", lambda m: chr(ord(m[0]) - 0xE000), s)
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", s)).strip()


def parse_latex(text: str) -> list[tuple]:
    """(kind, level, text, path) of every block; what stands before \\begin{document} and after \\end{document} is none."""
    kept: list[tuple] = []

    def keep(kind: str, body: str, path: str) -> str:
        kept.append((kind, 0, body, path))
        return f"\n\x00{len(kept) - 1}\x01\n"

    # code first, outside comments: a comment may hide a \begin, code may hold a %
    out_s, at = [], 0
    text = text.replace("\r\n", "\n")
    for m in re.compile(r"(?<!\\)(?:\\\\)*%[^\n]*|" + _CODE.pattern, re.S).finditer(text):
        out_s.append(text[at : m.start()])
        if m[1]:
            out_s.append(keep("code", m[3].strip("\n"), m[1]))
        else:
            head = re.match(r"(?:\\\\)*", m[0])[0]
            out_s.append(head)
        at = m.end()
    s = "".join([*out_s, text[at:]])
    s = _VERB.sub(lambda m: m[2].replace("\\", "\\textbackslash{}").replace("{", "\\{").replace("}", "\\}"), s)
    if (i := s.find("\\begin{document}")) >= 0:
        s = s[i + 16 :]
    if (i := s.find("\\end{document}")) >= 0:
        s = s[:i]
    s = _FORMULA.sub(lambda m: keep("formula", next(x for x in (m[1], m[2], m[5]) if x is not None).strip(), "math"), s)
    out: list[tuple] = []
    depth: list[str] = []
    pending: tuple | None = None  # the item whose text is being read: kind, level, path
    buf: list[str] = []

    def flush() -> None:
        nonlocal pending
        t = clean("".join(buf))
        buf.clear()
        if pending is not None:
            out[pending] = (*out[pending][:2], t, out[pending][3])
            pending = None
        elif t:
            out.append(("text", 0, t, "/".join([*depth, "p"])))

    at = 0
    while m := _MARK.search(s, at):
        buf.append(s[at : m.start()])
        at = m.end()
        if m[1]:
            flush()
            end = braced(s, at)
            out.append(("heading", _LEVEL[m[1]], clean(s[at:end]), m[1]))
            at = end + 1
        elif m[2]:
            flush()
            out.append(("list_item", max(1, sum(x in ("itemize", "enumerate", "description") for x in depth)), "", "/".join([*depth, "item"])))
            pending = len(out) - 1
            if m[3]:
                buf.append(m[3] + " ")
        elif m[4]:
            flush()
            if m[4] == "begin":
                depth.append(m[5])
                if m[5] in ("tabular", "tabularx", "array") and (g := re.compile(r"\s*\{[^}]*\}").match(s, at)):
                    at = g.end()
            elif m[5] in depth:
                while depth.pop() != m[5]:
                    pass
        elif m[6]:
            flush()
            out.append(kept[int(m[6])])
        else:
            flush() if "".join(buf).strip() else None
    buf.append(s[at:])
    flush()
    return out
