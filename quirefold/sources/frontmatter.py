"""Documents with YAML front matter: splitting, reading and writing, one by one and by the column."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.errors import FrontMatterError
from quirefold.sources import yamlite


def split(raw: str) -> tuple[str, str | None]:
    """(yaml, body). No opening fence: no yaml, all is body; no closing one: all is yaml; a blank body is None."""
    s = raw.lstrip("﻿ \t\r\n").replace("\r\n", "\n")
    if not s.startswith("---") or s[3:4] not in ("", "\n"):
        return "", raw if raw.strip() else None
    rest = s[4:]
    if rest.startswith("---"):
        head, tail = "", rest[3:]
    else:
        i = rest.find("\n---")
        while i >= 0 and rest[i + 4 : i + 5] not in ("", "\n"):
            i = rest.find("\n---", i + 1)
        if i < 0:
            return rest, None
        head, tail = rest[: i + 1], rest[i + 4 :]
    body = tail.strip("\n")
    return head, body if body.strip() else None


def read(raw: str, fmt: str = "md") -> tuple[dict, str | None]:
    """(fields, body) of a document's text. JSON documents are their object; a `content` key of theirs is the body."""
    if fmt in ("json", "jsonl"):
        try:
            v = json.loads(raw)
        except ValueError as e:
            raise FrontMatterError(str(e)) from e
        if not isinstance(v, dict):
            raise FrontMatterError("a JSON document is an object")
        return v, v.pop("content", None)
    head, body = split(raw)
    try:
        v = yamlite.load(head) if head.strip() else {}
    except yamlite.YamlError as e:
        raise FrontMatterError(str(e)) from e
    if v is None:
        v = {}
    if not isinstance(v, dict):
        raise FrontMatterError("front matter is a mapping")
    return v, body


def write(fields: dict, body: str | None, fmt: str = "md") -> str:
    if fmt in ("json", "jsonl"):
        return json.dumps(fields | ({"content": body} if body is not None else {}), ensure_ascii=False) + "\n"
    return f"---\n{yamlite.dump(fields) if fields else ''}---\n" + (f"\n{body.rstrip(chr(10))}\n" if body is not None else "")


def write_atomic(path: str, text: str | Iterable[str]) -> None:
    """text, or its parts, in a file of the same directory that then takes the place of path; missing directories are made."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.writelines([text] if isinstance(text, str) else text)
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def remove(path: str, root: str) -> None:
    """Delete a file, and the directories that this leaves empty, up to root."""
    if os.path.exists(path):
        os.unlink(path)
    d = os.path.dirname(path)
    while d.startswith(root.rstrip("/") + "/") and os.path.isdir(d) and not os.listdir(d):
        os.rmdir(d)
        d = os.path.dirname(d)


def head_and_body(raw: Column) -> tuple[Column, Column]:
    """split as columns, for texts with both fences."""
    s = F.regexp_replace(F.ltrim(raw, F.lit(" \t\r\n\ufeff")), "\r\n", "\n")
    fenced = s.rlike(r"(?s)^---\n(.*?\n)?---(\n|$)")
    head = F.when(fenced, F.regexp_extract(s, r"(?s)^---\n(.*?\n)?---(\n|$)", 1)).when(s.rlike(r"^---(\n|$)"), F.substring(s, 5, 1 << 30)).otherwise("")
    body = F.when(fenced, F.btrim(F.regexp_replace(s, r"(?s)^---\n(.*?\n)?---(\n|$)", ""), F.lit("\n"))).when(s.rlike(r"^---(\n|$)"), F.lit(None)).otherwise(raw)
    return head, F.when(F.btrim(body, F.lit(" \t\r\n")) != "", body)


_PARSED = T.StructType([T.StructField("data_json", T.StringType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])


def parser(fmt: str):
    """A column function from a document's text to (data_json, body, error)."""

    @F.pandas_udf(_PARSED)
    def parse(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for x in raw:
            try:
                v, body = read(x or "", fmt)
                rows.append((json.dumps(v, ensure_ascii=False), body, None))
            except FrontMatterError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["data_json", "body", "error"])

    return parse


_ENTRY = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime_nanos", T.LongType()), T.StructField("created_nanos", T.LongType()), T.StructField("size_bytes", T.LongType())])


#: Directories that are listed at once.
LISTERS = 16


def list_files(root: str, base: str, ext: str) -> list[tuple[str, int, int, int]]:
    """(path below root, mtime, birth or mtime, size) of the files below a base directory, by path; times in nanoseconds. Names
    that begin with a dot are left aside, and the store's own directories, which begin with _ and lie in root itself."""
    out, level = [], [os.path.join(root, base)]
    with ThreadPoolExecutor(LISTERS) as pool:  # directories of one depth are read side by side
        while level:
            got = list(pool.map(lambda d: _entries(d, root, ext), level))
            out += [f for files, _ in got for f in files]
            level = [d for _, dirs in got for d in dirs]
    return sorted(out)


def _entries(d: str, root: str, ext: str) -> tuple[list[tuple[str, int, int, int]], list[str]]:
    """(files, directories) in a directory; one that is gone has none."""
    files, dirs = [], []
    top = os.path.normpath(d) == os.path.normpath(root)
    try:
        with os.scandir(d) as it:
            for e in it:
                if e.name.startswith("."):
                    continue
                if e.is_dir(follow_symlinks=False):
                    if not (top and e.name.startswith("_")):
                        dirs.append(e.path)
                elif e.name.endswith("." + ext):
                    try:
                        st = e.stat()
                    except FileNotFoundError:
                        continue
                    files.append((os.path.relpath(e.path, root).replace(os.sep, "/"), st.st_mtime_ns, int(getattr(st, "st_birthtime", 0) * 1e9) or st.st_mtime_ns, st.st_size))
    except (FileNotFoundError, NotADirectoryError):
        pass
    return files, dirs


def listing(spark: SparkSession, root: str, base: str, ext: str) -> DataFrame:
    """list_files as a table."""
    return spark.createDataFrame(list_files(root, base, ext), _ENTRY)


def read_files(spark: SparkSession, root: str, entries: DataFrame, fmt: str = "md") -> DataFrame:
    """entries (path, ...) with their files' data_json, content_text and error; JSONL files give a row a line. Files that are
    gone by now are left out, files that can't be read have an error. The files are read by the executors."""
    schema = T.StructType([*entries.schema.fields, T.StructField("line_no", T.IntegerType()), T.StructField("data_json", T.StringType()), T.StructField("content_text", T.StringType()), T.StructField("error", T.StringType())])
    names = [f.name for f in entries.schema.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    with open(os.path.join(root, r.path), encoding="utf-8") as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                except (OSError, UnicodeDecodeError) as e:
                    rows.append((*r, None, None, None, str(e)))
                    continue
                for n, part in enumerate(raw.splitlines() if fmt == "jsonl" else [raw]):
                    if fmt == "jsonl" and not part.strip():
                        continue
                    try:
                        v, body = read(part, fmt)
                        rows.append((*r, n if fmt == "jsonl" else None, json.dumps(v, ensure_ascii=False), body, None))
                    except FrontMatterError as e:
                        rows.append((*r, n if fmt == "jsonl" else None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*names, "line_no", "data_json", "content_text", "error"]).astype({"line_no": "Int32"})

    return entries.mapInPandas(run, schema)


def records(df: DataFrame, by: str, variants: dict[str, T.StructType], base: T.StructType, column: str = "data_json") -> dict[str, DataFrame]:
    """A discriminated union of records: per variant the rows whose `by` names it, with its fields after the common ones."""
    out = {}
    tag = F.get_json_object(column, f"$.{by}")
    for name, extra in variants.items():
        schema = T.StructType([*base.fields, *extra.fields])
        out[name] = df.where(tag == name).select("*", F.from_json(column, schema).alias("_r")).select(*[c for c in df.columns if c not in schema.names], "_r.*")
    return out
