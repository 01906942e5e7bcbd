"""Shapes of personal items, by which the edges of what the tagger marks are trimmed, and the shadow of a text.

Texts are read through a shadow: the text without inline markup, with a place in the original for every character, so that an
item is found whatever is emphasised or linked inside it. Shapes know no sentences: whether something is an item, and of which
kind, is the tagger's to say.
"""

from __future__ import annotations

import html

import numpy as np
import regex

KINDS = ("email", "phone", "identity_number", "street_address", "name")

#: Tags that stand inside sentences, and tags that end lines.
_INLINE = "a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|s|small|span|strike|strong|sub|sup|tt|u|var"
_LINES = "br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|pre|html|body|head|title|blockquote|hr|ref|nowiki"

_MARKUP = regex.compile(
    rf"""(?P<line>\[\[Category:[^\[\]\n]*\]\]|</?(?:{_LINES})\b(?:[^<>"']|"[^"]*"|'[^']*')*/?>)|(?P<tag></?(?:{_INLINE})\b(?:[^<>"']|"[^"]*"|'[^']*')*>)"""
    r"""|(?P<ent>&(?:[a-zA-Z]{2,8}|\#\d{1,6}|\#x[0-9a-fA-F]{1,5});)"""
    r"""|(?P<cmd>\\(?:emph|textbf|textit|texttt|underline|textsc)\{|\\href\{[^{}\n]*\}\{|\{\\(?:it|bf|em|tt)\s|(?<!(?<!\\[a-z]{1,9}|\})\{\s?(?:at|dot)\s?)\})"""
    r"""|(?P<less>\\textless(?:\{\})?)|(?P<more>\\textgreater(?:\{\})?)"""
    r"""|(?P<esc>\\(?=[\#$%&_{}<>*\[\]()+.!|~@\\`-]))"""
    r"""|(?P<link>\[\^[^\]\s]+\]|\]\([^()\s]*\)|\]\[[^\[\]\n]*\]|\[\[(?:[^\[\]|\n]*\|)?|\]\]|\[https?://[^\s\]]+\ |(?<!\b(?:at|dot)\s?)\](?=[\s.,;:!?)]|$)|(?<!!)\[(?!\s?(?:at|dot|AT|DOT)\s?\])(?=[^\[\]\n]+\][(\[]))"""
    r"""|(?P<mark>\*{1,3}|~~|`+|'{2,5}|(?<!\w)_{1,3}(?=\w)|(?<=[\w.,!?)])_{1,3}(?!\w))""",
    regex.M | regex.I,
)


def shadow(text: str) -> tuple[str, np.ndarray | None]:
    """The text without inline markup, and each of its characters' place in the text; None if nothing was taken out."""
    parts: list[str] = []
    begin, size = [], []  # of pieces of the original, one for each of the characters that stand for something else
    at = 0
    for m in _MARKUP.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        if a > at:
            parts.append(text[at:a])
            begin.append(at)
            size.append(a - at)
        put = ""
        if kind == "line":
            put = "\n"
        elif kind == "ent":
            put = html.unescape(m[0])
        elif kind in ("less", "more"):
            put = "<" if kind == "less" else ">"
        if put:
            parts.append(put)
            begin += [a] * len(put)
            size += [1] * len(put)
        at = b
    if not parts and not at:
        return text, None
    if at < len(text):
        parts.append(text[at:])
        begin.append(at)
        size.append(len(text) - at)
    n = np.array([*size, 1])
    ends = np.cumsum(n)
    return "".join(parts), np.arange(ends[-1]) + np.repeat(np.array([*begin, len(text)]) - ends + n, n)


# -- shapes -------------------------------------------------------------------------------------------------------------------

_W = r"\p{Lu}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)?(?:-\p{Lu}[\p{L}\p{M}]*(?:['’]\p{L}+)?)*"
_I = r"\p{Lu}\."
_FULL = rf"(?:{_W},\ {_W}(?:\ {_I})?|{_W}(?:\ {_I})?\ {_W}|{_W}\ {_I}|{_I}(?:\ {_I})?\ {_W})"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Hr|Fr|Sr|Sra|Mme|M|Don|Doña|Señora?|Monsieur|Madame)\b\.?\s+){0,2}"
_NL = r"\s*\n\s*"

# a written-out address needs its dots or its at written out too, else `at` is a word
_AT, _DOT = r"\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+", r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+"
_LOCAL, _HOST = r"(?<![\w.+@%-])[\p{L}\p{N}][\p{L}\p{N}._+%-]*", r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
EMAIL = regex.compile(
    rf"{_LOCAL}@{_HOST}(?:\.{_HOST})*\.\p{{L}}{{2,}}\b|{_LOCAL}(?:\s?[(\[{{]\s?at\s?[)\]}}]\s?)(?:{_HOST})(?:(?:{_DOT}|\.){_HOST})*(?:{_DOT}|\.)\p{{L}}{{2,}}\b"
    rf"|{_LOCAL}(?:\s+at\s+|@){_HOST}(?:(?:{_DOT}|\.){_HOST})*(?:{_DOT})\p{{L}}{{2,}}\b",
    regex.I,
)
#: What every address holds in some case; a text without it needs no search.
_EMAIL_CUE = regex.compile(r"@|[(\[{]\s?at\s?[)\]}]|dot", regex.I)
_S = r"[  .\-/]"
PHONE = regex.compile(
    rf"""(?<![\w+.\-/\#])(?:
      (?:\+?1{_S}?)?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}(?:\ ?(?:ext\.?|x)\ ?\d{{1,5}})?
    | \+?1\d{{10}}
    | \+44\ ?(?:\(0\)\ ?)?(?:\d\ ?){{9,10}} | 0(?:20{_S}?\d{{4}}{_S}?\d{{4}}|1\d{{3}}{_S}?\d{{6}}|7\d{{3}}{_S}?\d{{6}})
    | (?:\+49|0049){_S}?(?:\(0\){_S}?)?\d{{2,4}}{_S}?\d{{3,8}}(?:{_S}\d{{1,4}})? | \(0\d{{2,4}}\){_S}?\d{{3,8}}(?:{_S}?\d{{1,4}})? | 0\d{{2,4}}{_S}\d{{3,8}}(?:{_S}\d{{1,4}})?
    | (?:\+33{_S}?(?:\(0\){_S}?)?|0)[1-9](?:{_S}?\d\d){{4}}
    | (?:\+34{_S}?|0034{_S}?)?[6-9]\d\d(?:{_S}?\d\d){{3}}
    )(?![\w]|[.\-/]\d)""",
    regex.X,
)
_SSN = r"(?:000|666|9\d\d|\d{3})(?:-\d\d-\d{4}|\ \d\d\ \d{4})"
_LABEL = r"(?:SSN|social\ security\ (?:number|no\.?)|passport(?:\ (?:no\.?|number))?|National\ Insurance\ (?:no\.?|number)|NI\ number|Steuer-?ID(?:nr\.?)?|Steuernummer|Personalausweis(?:nummer|-Nr\.?)?|Ausweis(?:nummer|-Nr\.?)?|Reisepass(?:-Nr\.?|nummer)?|NIR|n°\ INSEE|numéro\ de\ sécurité\ sociale|carte\ d['’]identité(?:\ n°)?|passeport(?:\ n°)?|DNI|NIE|NIF|documento|pasaporte(?:\ n\.?º)?)"
IDENTITY = regex.compile(
    rf"""(?<![\w+\-/.\#])(?:(?i:{_LABEL})[:\ ]\s?(?P<labelled>[\p{{Lu}}\d](?:[\p{{Lu}}\d]|[\ -](?=[\p{{Lu}}\d]{{1,6}}\b)(?!\p{{Lu}}\p{{L}})){{6,22}})
    | (?P<bare>(?i:{_SSN} | QQ\ ?\d\d\ ?\d\d\ ?\d\d\ ?[A-D] | (?:000|666)\d{{6}} | [12]\ \d\d\ \d\d\ \d[\dAB]\ \d{{3}}\ \d{{3}}\ \d\d | [12]\d\d(?:0[1-9]|1[0-2])\d[\dAB]\d{{8}} | \d{{8}}-?[A-Z] | [XYZ]\d{{7}}-?[A-Z] | [A-Z]\d\d[A-Z]\d\d[A-Z]\d\d | [A-Z]\d{{8}} | \d\d\ \d{{3}}\ \d{{3}}\ \d{{3}} ))
    )(?![\w]|[.\-/]\d)""",
    regex.X,
)
_CITY = r"\p{Lu}[\p{L}\p{M}]+"
_STREETS = r"(?:Lane|Ln|Road|Rd|Street|St|Avenue|Ave|Av|Boulevard|Blvd|Court|Ct|Close|Terrace|Ter|Drive|Dr|Place|Pl|Way|Square|Sq|Crescent|Parkway|Row|Walk|Hill|Gardens)"
ADDRESS = regex.compile(
    rf"""(?<![\w\-/.])(?:
      (?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\ \#?\d+\p{{L}}?,\ )?\d+\p{{L}}?\ (?:{_W}\ ){{1,3}}{_STREETS}\b(?:\.(?=,|\s+[\p{{Ll}}\d]))?
    | (?:P\.\ ?O\.|PO|Post\ Office)\ ?Box\ \d+
    | \p{{Lu}}[\p{{L}}\p{{M}}-]*(?:allee|straße|strasse|str\.|gasse|weg|platz|ring|damm|ufer|steig|chaussee)\ \d+\ ?\p{{Ll}}?\b
    | (?:\p{{Lu}}[\p{{L}}\p{{M}}]+[\ -])(?:Allee|Straße|Str\.|Gasse|Weg|Platz|Ring)\ \d+\ ?\p{{Ll}}?\b
    | \d+(?:\ (?:bis|ter|quater))?,?\ (?:rue|bd|boulevard|avenue|av\.|chemin|impasse|place|quai|allée|route|cours|passage|square)\ (?:d[eu]s?\ |de\ l[a'’]\s?|d['’]|l['’])*\p{{Lu}}[\p{{L}}\p{{M}}]+
    | (?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Carrera|Ronda|Travesía)\ (?:de\ |del\ |las?\ |los\ |el\ )*\p{{Lu}}[\p{{L}}\p{{M}}]+(?:\ (?:de\ |del\ |la\ |los\ )*\p{{Lu}}[\p{{L}}\p{{M}}]+)*,?\ (?:n\.?º\ ?|núm\.\ ?|número\ )?\d+
    )(?:,\ (?:Apt|Apartment|Suite|Unit|Flat)\.?\ \#?\w+|,\ \d+[ºª](?:\ \p{{Lu}}\b)?|\ (?:Vieux|Grand|Petit)\ {_CITY}|,?\ \d{{5}}\ {_CITY}|,\ \p{{Lu}}{{2}}\ \d{{5}}|,?\ \p{{Lu}}{{1,2}}\d{{1,2}}\ \d\p{{Lu}}{{2}}\b|,\ {_CITY}(?![\p{{L}}:'’]))*""",
    regex.X,
)


_WORD = r"[\p{L}\p{M}\p{N}'’-]"
_NAME = regex.compile(rf"{_TITLE}(?P<n>(?:{_FULL}|{_W})(?:(?<=\.)|(?!{_WORD})))")
_INITIAL = regex.compile(rf"(?P<n>{_I}(?:\ {_I})?\ {_W})(?!{_WORD})")
_LEADS = regex.compile(r"(?:The|Der|Die|Das|El|La|Le|Dr|Mr|Mrs|Prof)\.?\s")
SHAPES = {"email": EMAIL, "phone": PHONE, "identity_number": IDENTITY, "street_address": ADDRESS}
#: What an item of a kind is made of at the least, where none of its shapes is met.
_LOOSE = {
    "email": regex.compile(r"[^\s<>()\[\]\"',;]+@[^\s<>()\[\]\"',;]*[\p{L}\p{N}]"),
    "phone": regex.compile(r"[+(]{0,2}\d[\d\s().\-/]{4,}\d"),
    "identity_number": regex.compile(r"[\p{Lu}\d](?:[\p{Lu}\d .\-/]{3,}[\p{Lu}\d])"),
    "street_address": regex.compile(r"[\p{Lu}\d](?=[^\n]*\p{L})(?=[^\n]*\d)[^\n]{3,}[\p{L}\d]"),
}
#: Characters on either side of a run within which its shape may reach.
REACH = 80


def _span(m: regex.Match) -> tuple[int, int]:
    for g in ("labelled", "bare"):
        if g in m.re.groupindex and m[g]:
            return m.span(g)
    return m.span()


def item_of(s: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The item that a tagged run a:b of a shadow text means: the shape of its kind that it covers most of, else the run itself
    less what no item begins or ends with. None only where nothing is left."""
    if kind == "name":
        return _name_of(s, a, b)
    best, most = None, 0
    lo = max(0, a - REACH)
    for m in SHAPES[kind].finditer(s, lo, min(len(s), b + REACH)):
        p, q = _span(m)
        over = min(b, q) - max(a, p)
        if over > most:
            best, most = (p, q), over
        if p >= b:
            break
    if best and 2 * most >= min(b - a, best[1] - best[0]):
        return best
    m = _LOOSE[kind].search(s, a, b)
    if m and kind != "email":
        p, q = m.span()
        while q < len(s) and s[q].isalnum() and q < b + 8:  # a run that ends inside a word means the word
            q += 1
        return p, q
    return m.span() if m else None


def _name_of(s: str, a: int, b: int) -> tuple[int, int] | None:
    while a > 0 and regex.match(_WORD, s[a - 1]):  # a run that begins inside a word means the word
        a -= 1
    while a < b:
        m = _INITIAL.match(s, a) or _NAME.match(s, a)  # an initial may look like a title
        if m and not _LEADS.match(m["n"]):
            p, q = m.span("n")
            if 2 * (min(b, q) - p) >= q - p:
                return p, q
            m = regex.compile(_W).match(s, p)  # no more than the word that the run covers
            return m.span() if m else None
        while a < b and regex.match(_WORD, s[a]):
            a += 1
        while a < b and not regex.match(_WORD, s[a]):
            a += 1
    return None


def items_of(s: str, runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items that runs (start, end, kind) of a shadow text mean, none over another."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in runs:
        at = item_of(s, a, b, kind)
        if at and (not out or at[0] >= out[-1][1]):
            out.append((*at, kind))
    return out
