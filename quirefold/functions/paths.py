"""Path templates: parsing, rendering and extraction, as values on the driver and as columns."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.errors import PathTemplateError

#: Letters that transliterate to more than one, or that do not decompose.
_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ı": "i"}


def slugify(s: str) -> str:
    """Lower case ASCII letters and digits, anything else a single hyphen, none at the ends."""
    s = "".join(_LETTERS.get(c, c) for c in s.lower())
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", s).strip("-")


def slug(c: Column) -> Column:
    """slugify for ASCII text, inside the JVM; use slug_any where letters beyond it occur."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


@F.pandas_udf(T.StringType())
def slug_any(s: pd.Series) -> pd.Series:
    return s.map(slugify, na_action="ignore")


@dataclass
class Segment:
    kind: str  # literal, field, date, child
    text: str  # the literal, or the field's name
    arg: str = ""  # the date format, or the child's name


class PathTemplate:
    """A template such as posts/{status}/{date:YYYY-MM-DD}-{title}.md."""

    def __init__(self, template: str):
        self.template = template
        self.segments: list[Segment] = []
        at = 0
        while at < len(template):
            i = template.find("{", at)
            if i < 0:
                self.segments.append(Segment("literal", template[at:]))
                break
            if i > at:
                self.segments.append(Segment("literal", template[at:i]))
            j = template.find("}", i)
            if j < 0:
                raise PathTemplateError(f"unclosed brace in {template!r}")
            body = template[i + 1 : j]
            if not body:
                raise PathTemplateError(f"empty field in {template!r}")
            name, _, arg = body.partition(":")
            if arg and re.search("[YMDHTS]", arg):
                self.segments.append(Segment("date", name, arg))
            elif arg:
                self.segments.append(Segment("child", name, arg))
            else:
                self.segments.append(Segment("field", name))
            at = j + 1

    @property
    def fields(self) -> set[str]:
        """The names it refers to; a change of one moves the file."""
        return {s.text for s in self.segments if s.kind != "literal"}

    @property
    def base(self) -> str:
        """The literal directory that all its paths begin with."""
        if not self.segments or self.segments[0].kind != "literal":
            return ""
        return self.segments[0].text.rpartition("/")[0]

    @property
    def extension(self) -> str:
        return self.template.rsplit(".", 1)[-1] if "." in self.template.rsplit("/", 1)[-1] else ""

    def render(self, data: dict, ident: str | None = None) -> str:
        """The path of a document. A missing field, a list or an object is an error; null is empty."""
        out = []
        for s in self.segments:
            if s.kind == "literal":
                out.append(s.text)
                continue
            if s.text == "id" and s.kind == "field" and ident is not None:
                v: object = ident
            elif s.text not in data:
                raise PathTemplateError(f"{self.template}: no field {s.text}")
            else:
                v = data[s.text]
            if s.kind == "child":
                if isinstance(v, dict):
                    if s.arg not in v:
                        raise PathTemplateError(f"{self.template}: no field {s.text}.{s.arg}")
                    v = v[s.arg]
                elif s.arg != "id":
                    raise PathTemplateError(f"{self.template}: {s.text} has no {s.arg}")
            if isinstance(v, (list, dict)):
                raise PathTemplateError(f"{self.template}: {s.text} is no single value")
            if v is None:
                continue
            if s.kind == "date":
                out.append(slugify(format_date(str(v), s.arg)))
            else:
                out.append(slugify(scalar_text(v)))
        return "".join(out)

    def regex(self) -> str:
        """An anchored expression with a group for each plain or dated field, by first occurrence of what follows."""
        out = "^"
        for k, s in enumerate(self.segments):
            last = k == len(self.segments) - 1
            if s.kind == "literal":
                out += re.escape(s.text)
            elif s.kind == "date":
                out += f"(.{{{len(s.arg)}}})"
            else:
                out += "(.+)" if last else "(.+?)"
        return out + "$"

    def extract(self, path: str) -> dict[str, str] | None:
        """The fields a path holds, None if it isn't one of this template's; children of refs are read and dropped."""
        values: dict[str, str] = {}
        at = 0
        for k, s in enumerate(self.segments):
            if s.kind == "literal":
                if not path.startswith(s.text, at):
                    return None
                at += len(s.text)
                continue
            if s.kind == "date":
                v = path[at : at + len(s.arg)]
                if len(v) < len(s.arg):
                    return None
            elif k + 1 < len(self.segments) and self.segments[k + 1].kind == "literal":
                i = path.find(self.segments[k + 1].text, at)
                if i < 0:
                    return None
                v = path[at:i]
            else:
                v = path[at:]
            at += len(v)
            if s.kind != "child":
                values[s.text] = v
        return values if at == len(path) else None

    def columns(self, path: Column) -> dict[str, Column]:
        """extract as columns: null where the path isn't one of this template's."""
        names = [s for s in self.segments if s.kind != "literal"]
        return {s.text: F.when(path.rlike(self.regex()), F.regexp_extract(path, self.regex(), k + 1)) for k, s in enumerate(names) if s.kind != "child"}

    def render_column(self, cols: dict[str, Column], ident: Column | None = None, unicode: bool = False) -> Column:
        """render as a column; dates are timestamps here, children are read from structs."""
        make = slug_any if unicode else slug
        parts = []
        for s in self.segments:
            if s.kind == "literal":
                parts.append(F.lit(s.text))
            elif s.kind == "date":
                parts.append(F.coalesce(F.date_format(cols[s.text], java_format(s.arg)), F.lit("")))
            else:
                c = ident if s.text == "id" and s.kind == "field" and ident is not None else cols[s.text]
                c = c.getField(s.arg) if s.kind == "child" else c
                parts.append(F.coalesce(make(c.cast("string")), F.lit("")))
        return F.concat(*parts)

    def missplittable(self, auto_id: str | None = None) -> bool:
        """Whether a field's value can hold the first character of the literal behind it, so that paths split wrongly."""
        for s, nxt in zip(self.segments, self.segments[1:]):
            if s.kind == "literal" or s.kind == "date" or nxt.kind != "literal":
                continue
            if nxt is self.segments[-1] and nxt.text.startswith("."):
                continue
            if nxt.text[0] in _alphabet(auto_id if s.text == "id" and s.kind == "field" else None):
                return True
        return False


def _alphabet(auto: str | None) -> str:
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return {"ulid": lower + upper + digits, "uuid": "-" + digits + "abcdefABCDEF", "nanoid": "-_" + lower + upper + digits}.get(auto or "", "-" + lower + digits)


def scalar_text(v: object) -> str:
    return "true" if v is True else "false" if v is False else str(v)


def java_format(fmt: str) -> str:
    """The date pattern for Java: the first MM is the month, a second one, or one after the hour, the minute."""
    out, i, months, hours = "", 0, 0, False
    while i < len(fmt):
        for tok, to in (("YYYY", "yyyy"), ("DD", "dd"), ("HH", "HH"), ("SS", "ss"), ("MM", None)):
            if fmt.startswith(tok, i):
                if tok == "MM":
                    to = "mm" if months or hours else "MM"
                    months += 1
                hours |= tok == "HH"
                out += to
                i += len(tok)
                break
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


_MOMENT = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?$")


def format_date(v: str, fmt: str) -> str:
    """A date or time text by a format of YYYY MM DD HH SS; what can't be read stays as it is."""
    m = _MOMENT.match(v.strip())
    if not m:
        return v
    y, mo, d, h, mi, s = (g or "00" for g in m.groups())
    java = java_format(fmt)
    out = re.sub(r"yyyy|MM|dd|HH|mm|ss|'([^']*)'", lambda x: x[1] if x[1] is not None else {"yyyy": y, "MM": mo, "dd": d, "HH": h, "mm": mi, "ss": s}[x[0]], java)
    return out


def unused_path(path: str, taken) -> str:
    """path, or stem-2.ext, stem-3.ext and so on, whichever is first not taken."""
    if not taken(path):
        return path
    stem, dot, ext = path.rpartition(".")
    if not dot or "/" in ext:
        stem, dot, ext = path, "", ""
    n = 2
    while taken(f"{stem}-{n}{dot}{ext}"):
        n += 1
    return f"{stem}-{n}{dot}{ext}"


def conflict_suffix(df: DataFrame, path: str, order: list[str], out: str = "path") -> DataFrame:
    """df with rows of one path told apart by -2, -3 and so on, in the given order. A path that a third of all rows render to is
    numbered by many tasks."""
    from quirefold.operators.sorted_scan import number

    n = F.col("_no")
    return number(df, [path], order, "_no").withColumn(out, F.when(n == 1, F.col(path)).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("-"), n.cast("string"), F.regexp_extract(path, r"\.[^./]*$", 0)))).drop("_no")


def route(path: str, bases: dict[str, str]) -> str | None:
    """The collection whose base directory a path lies in, longest base first."""
    path = path.replace("\\", "/")
    for name, base in sorted(bases.items(), key=lambda x: (-len(x[1]), x[0])):
        if not base or path.startswith(base + "/"):
            return name
    return None


def route_column(path: Column, bases: dict[str, str]) -> Column:
    """route as a column."""
    path = F.translate(path, "\\", "/")
    out = F.lit(None).cast("string")
    for name, base in sorted(bases.items(), key=lambda x: (-len(x[1]), x[0]), reverse=True):
        out = F.when(path.startswith(base + "/") if base else F.lit(True), name).otherwise(out)
    return out


def singular(s: str) -> str:
    for end, to in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ves", "f")):
        if s.endswith(end) and len(s) > len(end):
            return s[: -len(end)] + to
    if s.endswith("ses"):
        return s[:-2]
    return s[:-1] if s.endswith("s") and not s.endswith("ss") else s


def singular_column(c: Column) -> Column:
    e = lambda rx, to: F.regexp_replace(c, rx, to)
    return (
        F.when(c.rlike("(?<=.)ies$"), e("ies$", "y")).when(c.rlike("(?<=.)sses$"), e("sses$", "ss")).when(c.rlike("(?<=.)[xz]es$"), e("es$", "")).when(c.rlike("(?<=.)ves$"), e("ves$", "f"))
        .when(c.rlike("ses$"), e("es$", "")).when(c.rlike("[^s]s$"), e("s$", "")).otherwise(c)
    )
