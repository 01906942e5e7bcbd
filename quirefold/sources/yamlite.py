"""A reader of the YAML that schemas and front matter are written in: block and flow collections, quoted and plain scalars,
block scalars, comments, anchors and aliases, tags ignored. Plain scalars follow the YAML 1.2 core schema: only null, booleans,
integers and floats are typed; dates, `yes` and `12:30` stay strings."""

from __future__ import annotations

import re


class YamlError(ValueError):
    pass


_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^#\n]*?|-(?=\S)[^#\n]*?|[^\s"'\[\]{},&*!|>%@`#][^\n]*?))\s*:(?:\s|$)""")
#: Escapes in double quotes.
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


def scalar(s: str) -> object:
    """A plain scalar by the core schema."""
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE"):
        return True
    if s in ("false", "False", "FALSE"):
        return False
    if _INT.fullmatch(s):
        return int(s, 0) if s[:2] in ("0o", "0x") else int(s)
    if _FLOAT.fullmatch(s):
        return float(s)
    if s.lower() in (".inf", "+.inf", "-.inf"):
        return float(s.replace(".", ""))
    return float("nan") if s in (".nan", ".NaN", ".NAN") else s


def _double(s: str) -> str:
    def esc(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU":
            return chr(int(x[1:], 16))
        if x == "\n":
            return ""
        if x not in _ESCAPES:
            raise YamlError(f"unknown escape \\{x}")
        return _ESCAPES[x]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.|\n)", esc, s, flags=re.S)


class _Flow:
    """Flow collections and quoted scalars, read from one text."""

    def __init__(self, s: str, anchors: dict):
        self.s, self.i, self.anchors = s, 0, anchors

    def skip(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i].isspace():
                self.i += 1
            elif self.s[self.i] == "#" and (self.i == 0 or self.s[self.i - 1].isspace()):
                self.i = self.s.find("\n", self.i) if "\n" in self.s[self.i :] else len(self.s)
            else:
                return

    def quoted(self) -> str:
        q, j = self.s[self.i], self.i + 1
        while j < len(self.s):
            if q == '"' and self.s[j] == "\\":
                j += 2
                continue
            if self.s[j] == q:
                if q == "'" and self.s[j + 1 : j + 2] == "'":
                    j += 2
                    continue
                raw = self.s[self.i + 1 : j]
                self.i = j + 1
                raw = re.sub(r"[ \t]*\n[ \t]*", lambda m: " ", raw)
                return _double(raw) if q == '"' else raw.replace("''", "'")
            j += 1
        raise YamlError("unclosed quote")

    def value(self, inside: bool) -> object:
        self.skip()
        c = self.s[self.i : self.i + 1]
        if c == "&" or c == "!":
            m = re.compile(r"[&!][^\s,\[\]{}]*").match(self.s, self.i)
            self.i = m.end()
            v = self.value(inside)
            if c == "&":
                self.anchors[m[0][1:]] = v
            return v
        if c == "*":
            m = re.compile(r"\*[^\s,\[\]{}]+").match(self.s, self.i)
            if not m or m[0][1:] not in self.anchors:
                raise YamlError("unknown alias")
            self.i = m.end()
            return self.anchors[m[0][1:]]
        if c in ('"', "'") and c:
            return self.quoted()
        if c == "[":
            out: list = []
            self.i += 1
            while True:
                self.skip()
                if self.s[self.i : self.i + 1] == "]":
                    self.i += 1
                    return out
                v = self.value(True)
                self.skip()
                if self.s[self.i : self.i + 1] == ":":
                    self.i += 1
                    v = {_key(v): self.value(True)}
                    self.skip()
                out.append(v)
                self.sep("]")
        if c == "{":
            got: dict = {}
            self.i += 1
            while True:
                self.skip()
                if self.s[self.i : self.i + 1] == "}":
                    self.i += 1
                    return got
                k, v = self.value(True), None
                self.skip()
                if self.s[self.i : self.i + 1] == ":":
                    self.i += 1
                    self.skip()
                    v = None if self.s[self.i : self.i + 1] in (",", "}") else self.value(True)
                got[_key(k)] = v
                self.skip()
                self.sep("}")
        m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*" if inside else r"(?:[^#\n]|(?<!\s)#)*").match(self.s, self.i)
        if inside and m.end() == self.i:
            raise YamlError("a value is missing" if self.i >= len(self.s) else f"unexpected {self.s[self.i]!r}")
        self.i = m.end()
        return scalar(m[0].strip())

    def sep(self, end: str) -> None:
        c = self.s[self.i : self.i + 1]
        if c == ",":
            self.i += 1
        elif c != end:
            raise YamlError(f"expected , or {end}")


def _key(k: object) -> str:
    if isinstance(k, bool):
        return "true" if k else "false"
    return "null" if k is None else str(k)


class _Block:
    def __init__(self, text: str):
        self.lines: list[tuple[int, str]] = []
        for raw in text.replace("\r\n", "\n").split("\n"):
            body = raw.lstrip(" ")
            self.lines.append((len(raw) - len(body), body.rstrip()))
        self.at, self.anchors = 0, {}

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.lines):
            ind, s = self.lines[self.at]
            if s and not s.startswith("#") and s not in ("---",) and not (ind == 0 and s.startswith("%")):
                return (ind, s) if s != "..." else None
            self.at += 1
        return None

    def node(self, least: int) -> object:
        p = self.peek()
        if p is None or p[0] < least:
            return None
        ind, s = p
        if s.startswith("\t"):
            raise YamlError("a tab indents")
        if s == "-" or s.startswith("- "):
            return self.seq(ind)
        if s[0] not in "[{" and self.key(s):
            return self.map(ind)
        return self.inline(s, ind, least)

    def key(self, s: str) -> re.Match | None:
        return _KEY.match(s)

    def seq(self, ind: int) -> list:
        out = []
        while (p := self.peek()) and p[0] == ind and (p[1] == "-" or p[1].startswith("- ")):
            rest = p[1][1:]
            body = rest.lstrip(" ")
            if not body or body.startswith("#"):
                self.at += 1
                out.append(self.node(ind + 1))
            else:
                self.lines[self.at] = (ind + 1 + len(rest) - len(body), body)
                out.append(self.node(ind + 1))
        if (p := self.peek()) and p[0] > ind:
            raise YamlError(f"unexpected {p[1][:40]!r}")
        return out

    def map(self, ind: int) -> dict:
        out: dict = {}
        while (p := self.peek()) and p[0] == ind:
            m = self.key(p[1])
            if not m:
                raise YamlError(f"expected a key, not {p[1][:40]!r}")
            k = m[1].strip()
            k = _Flow(k, {}).quoted() if k[:1] in ("'", '"') else _key(scalar(k)) if not _INT.fullmatch(k) else k
            rest = p[1][m.end() :].strip()
            v: object
            if not rest or rest.startswith("#") or re.fullmatch(r"[&!]\S*(\s+#.*)?", rest):
                self.at += 1
                q = self.peek()
                v = self.seq(ind) if q and q[0] == ind and (q[1] == "-" or q[1].startswith("- ")) else self.node(ind + 1)
                if rest.startswith("&"):
                    self.anchors[rest.split()[0][1:]] = v
            else:
                v = self.inline(rest, ind, ind + 1)
            if k == "<<" and isinstance(v, dict):
                out = {**v, **out}
            else:
                out[k] = v
        if p and p[0] > ind:
            raise YamlError(f"unexpected {p[1][:40]!r}")
        return out

    def inline(self, s: str, ind: int, least: int) -> object:
        """A value that begins on the present line."""
        if m := re.match(r"([|>])([-+0-9]*)\s*(?:#.*)?$", s):
            return self.scalar_block(m[1], m[2], least)
        self.at += 1
        first = s.lstrip()
        if first[:1] in ('"', "'", "[", "{", "&", "!", "*"):
            while True:
                f = _Flow(s, self.anchors)
                try:
                    v = f.value(False)
                    break
                except YamlError:
                    if self.at >= len(self.lines) or self.lines[self.at][1] == "---":
                        raise
                    s += "\n" + self.lines[self.at][1]
                    self.at += 1
            if s[f.i :].strip() and not s[f.i :].lstrip().startswith("#"):
                raise YamlError(f"unexpected {s[f.i :].strip()[:40]!r}")
            return v
        s = re.split(r"\s#", s, maxsplit=1)[0].strip()
        if re.search(r":(\s|$)", s):
            raise YamlError("a mapping inside a plain scalar")
        parts = [s]
        while (p := self.peek()) and p[0] >= least and p[0] > ind - (least <= ind) and not self.key(p[1]) and not p[1].startswith("- "):
            parts.append(re.split(r"\s#", p[1], maxsplit=1)[0].strip())
            self.at += 1
        return scalar(s) if len(parts) == 1 else " ".join(parts)

    def scalar_block(self, style: str, mods: str, least: int) -> str:
        self.at += 1
        rows: list[tuple[int, str]] = []
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][0] >= max(least, 1)):
            rows.append(self.lines[self.at])
            self.at += 1
        tail = 0
        while rows and not rows[-1][1]:
            rows.pop()
            tail += 1
        digits = re.sub(r"\D", "", mods)
        base = least - 1 + int(digits) if digits else min((i for i, s in rows if s), default=0)
        lines = [" " * (i - base) + s if s else "" for i, s in rows]
        if style == "|":
            text = "\n".join(lines)
        else:
            text, prev = "", ""
            for k, x in enumerate(lines):
                if k == 0:
                    text = x
                elif not x:
                    text += "\n"
                elif not prev:
                    text += x if text.endswith("\n") else "\n" + x
                elif x.startswith(" ") or prev.startswith(" "):
                    text += "\n" + x
                else:
                    text += " " + x
                prev = x
        return text + ("" if "-" in mods or not text else "\n" * (1 + tail if "+" in mods else 1))


def load(text: str) -> object:
    """The value of a YAML text; an empty one is None. Raises YamlError."""
    b = _Block(text)
    v = b.node(0)
    if b.peek() is not None:
        raise YamlError(f"unexpected {b.peek()[1][:40]!r}")
    return v


def _needs_quotes(s: str) -> bool:
    return not isinstance(scalar(s), str) or bool(re.search(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|[\n\r\t]|:\s|:$|\s#|\s$|^(?:yes|no|on|off|y|n)$", s, re.I))


def _dump_scalar(v: object) -> str:
    import json

    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False) if v == "" or _needs_quotes(v) else v
    return "null" if v is None else "true" if v is True else "false" if v is False else repr(v)


def dump(v: object, indent: int = 0) -> str:
    """v as block YAML that load() reads back as it was."""
    pad = " " * indent
    if isinstance(v, dict) and v:
        out = ""
        for k, x in v.items():
            nested = isinstance(x, (dict, list)) and x
            out += f"{pad}{_dump_scalar(str(k))}:" + ("\n" + dump(x, indent + 2 * isinstance(x, dict)) if nested else f" {dump(x).strip()}\n")
        return out
    if isinstance(v, list) and v:
        out = ""
        for x in v:
            body = dump(x, indent + 2)
            out += f"{pad}- {body.lstrip()}" if isinstance(x, (dict, list)) and x else f"{pad}- {body.strip()}\n"
        return out
    return pad + ("{}" if isinstance(v, dict) else "[]" if isinstance(v, list) else _dump_scalar(v)) + "\n"
