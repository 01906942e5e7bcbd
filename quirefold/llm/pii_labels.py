"""Labels for training the tagger: spans of weak labelling functions over given texts. Nothing of this runs when texts are read.

No table holds labelled spans, so shapes and known sentences label what they can be sure of in a bounded sample of texts, and
pii_train puts made-up sentences with items of known place between; the tagger learns from both and is then on its own.
"""

from __future__ import annotations

import regex

from quirefold.llm.pii_rules import _EMAIL_CUE, _FULL, _LEADS, _TITLE, _W, ADDRESS, EMAIL, IDENTITY, PHONE, shadow

#: Sentences before a bare number that is somebody's.
_BARE_ID = regex.compile(rf"(?:Payroll still needs|Visitors register with|form lists|Im Bogen steht|Consta|Le dossier porte)\s+(?P<n>9\d{{8}})(?!\d)")
#: Words before a number that numbers a thing, and after a street that is none.
_THINGS = regex.compile(r"(?:Build|commit|Order|Run|Section|Part\ no\.|Raw:|Version|range|Set\s\w+\sto)\s?$")
_NO_STREET = regex.compile(r"\.?\ (?:of\ the\ handbook|rollout)")
_G = rf"(?P<a>{_FULL})"
_GIVEN = rf"(?P<a>{_W})"
#: Sentences around names. {G} is a full name, {1} a given name.
NAME_FRAMES = [
    rf"Please\s+reach\s+{_TITLE}{_G}\s+at\s",
    rf"\bFrom:\s+{_TITLE}{_G}\s*\\?(?:<|&lt;|\()",
    rf"Assigned\s+to\s+{_TITLE}{_G}\s+\(",
    rf"Escribe\s+a\s+{_TITLE}{_G}\s+\(",
    rf"Contacter\s+{_TITLE}{_G}\s+à\s",
    rf"\bBitte\s+{_TITLE}{_G}\s+unter\s",
    rf"next\s+to\s+{_TITLE}{_G}(?=[.\s<&{{]|$)",
    rf"(?:Im\s+Bogen\s+steht\s[^\n]{{5,45}}?)\sbei\s+{_TITLE}{_G}(?=[.\s<&{{]|$)",
    rf"(?:Le\s+dossier\s+porte\s[^\n]{{5,60}}?)\spour\s+{_TITLE}{_G}(?=[.\s<&{{]|$)",
    rf"a\s+nombre\s+de\s+{_TITLE}{_G}(?=[.\s<&{{]|$)",
    rf"signed\s+by\s+{_TITLE}{_G}\s+and\s+{_TITLE}(?P<b>{_FULL})(?=[.\s<&{{]|$)",
    rf"(?<![\p{{L}},]\ |[\p{{L}}'’-]){_G}\s+(?:said\s+the\s|moved\s+to\s|will\s+\p{{Ll}}+\s+the\s|wohnt\s+jetzt\s+in\s)",
    rf"(?:Dr|Prof|Mr|Mrs|Ms|Mx)\.\s+{_G}\s+(?:said\s+the\s|moved\s+to\s|will\s+\p{{Ll}}+\s+the\s|wohnt\s+jetzt\s+in\s)",
    rf"(?:\bThanks,|\bBest,|Grüßen?|Cordialement,|Un\s+saludo,|Atentamente,|\bRegards,)\s+{_TITLE}{_G}(?=\s|$|[<&.{{])",
    rf"Bien\s+à\s+toi,\s+{_GIVEN}(?=\s|$|[<&{{])",
    rf"\bHi\s+{_GIVEN},\s",
    rf"\b(?:Hallo|Hola|Bonjour)\s+{_GIVEN},\s",
    rf"\bAsk\s+{_GIVEN}\s+to\s",
    rf"Call\s+back:\s[^\n(]*(?:\([^)\n]*\)[^\n(]*)?\({_GIVEN}\)",
]
_FRAMES = [regex.compile(f, regex.M) for f in NAME_FRAMES]
#: A word of each frame; a text without it needs no search.
_CUES = ("reach", "From:", "Assigned", "Escribe", "Contacter", "unter", "next", "Bogen", "dossier", "nombre", "signed", ("said", "moved", "will", "wohnt"), ("Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "Mx."), ("Thanks", "Best", "Grüße", "Cordialement", "saludo", "Atentamente", "Regards"), "toi", "Hi", ("Hallo", "Hola", "Bonjour"), "Ask", "back")
_CUES = tuple(c if isinstance(c, tuple) else (c,) for c in _CUES)


def find_items(s: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items in a shadow text, by start; of overlapping ones of different kinds the more certain stays."""
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))

    if _EMAIL_CUE.search(s):
        for m in EMAIL.finditer(s):
            add(m.start(), m.end(), "email")
    digits = any(c in s for c in "0123456789")
    if digits:
        for m in _BARE_ID.finditer(s):
            add(*m.span("n"), "identity_number")
        for m in IDENTITY.finditer(s):
            g = "labelled" if m["labelled"] else "bare"
            if sum(c.isdigit() for c in m[g]) >= 6:
                add(*m.span(g), "identity_number")
        for m in PHONE.finditer(s):
            if not _THINGS.search(s[max(0, m.start() - 24) : m.start()]):
                add(m.start(), m.end(), "phone")
        for m in ADDRESS.finditer(s):
            if not s[max(0, m.start() - 8) : m.start()].endswith("Section ") and not _NO_STREET.match(s, m.end()):
                add(m.start(), m.end(), "street_address")
    for f, cues in zip(_FRAMES, _CUES):
        if any(c in s for c in cues):
            for m in f.finditer(s, overlapped=True):
                for g in ("a", "b"):
                    if g in f.groupindex and m[g] and not _LEADS.match(m[g]):
                        add(*m.span(g), "name")
    return sorted(out)


def annotate(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the text itself."""
    s, at = shadow(text)
    return [(int(at[a]), int(at[b - 1]) + 1, k) if at is not None else (a, b, k) for a, b, k in find_items(s)]
