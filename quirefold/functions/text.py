"""Column expressions on names, keys and paths."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that is trimmed from both ends of a key.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def norm_key(c: Column) -> Column:
    """c without white space at both ends, in lower case; null where nothing is left."""
    t = F.lower(F.btrim(c, F.lit(SPACE)))
    return F.when(t != "", t)


_PLAIN = re.compile(r"(?:[!-.0-\[\]-~ ][!-\[\]-~ ]*)?", re.ASCII)
_ODD = re.compile(r"//|(?:^|/)\.{1,2}(?:/|$)|/$")


def place_of(path: str) -> str:
    """The place a path names: slashes only, no empty, `.` or `..` segments, composed Unicode. A leading slash stays: an
    absolute path is another place than a relative one; `..` above the top is kept on a relative path, dropped on an absolute one."""
    if _PLAIN.fullmatch(path) and not _ODD.search(path):
        return path
    path = unicodedata.normalize("NFC", path.replace("\\", "/"))
    out: list[str] = []
    top = path.startswith("/")
    for s in path.split("/"):
        if s in ("", "."):
            continue
        if s == ".." and out and out[-1] != "..":
            out.pop()
        elif s == ".." and top:
            continue
        else:
            out.append(s)
    return "/" * top + "/".join(out)


@F.pandas_udf(T.StringType())
def place(paths: pd.Series) -> pd.Series:
    """place_of over a column; null stays null."""
    return paths.map(place_of, na_action="ignore")


def micros_of(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")
