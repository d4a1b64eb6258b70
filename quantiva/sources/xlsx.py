"""Excel workbook source (S2, S4): a Python data source named ``xlsx``.

One input partition per (file, sheet); a sheet is parsed as a stream
(``xml.etree.ElementTree.iterparse``) from the workbook zip, so memory stays
bounded by one row.  Every cell is read as text, like the CSV path; typing
is applied afterwards by ``infer_types``.  The first row of each sheet is its
header; the schema is the union of all headers (by name), plus
``__source_file__`` and -- only when some workbook has more than one sheet --
``__source_sheet__`` (NULL for rows of single-sheet workbooks).

Files are opened with Python on the executors, so paths must be visible to
them (a shared mount).  Workbooks are zip archives and cannot be split below
the sheet.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SOURCE_FILE = "__source_file__"
SOURCE_SHEET = "__source_sheet__"

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _files(paths: str) -> list[str]:
    out = []
    for p in [x for x in paths.split(",") if x]:
        if os.path.isdir(p):
            out += sorted(glob.glob(os.path.join(p, "**", "*.xlsx"), recursive=True))
        else:
            out += sorted(glob.glob(p))
    return out


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, member path) in workbook order."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iter(f"{_PKG_REL}Relationship")}
    out = []
    for s in wb.iter(f"{_NS}sheet"):
        t = target.get(s.get(f"{_REL}id"), "")
        t = t.lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    for _, el in ET.iterparse(zf.open("xl/sharedStrings.xml")):
        if el.tag == f"{_NS}si":
            out.append("".join(t.text or "" for t in el.iter(f"{_NS}t")))
            el.clear()
    return out


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _cell_text(c, shared: list[str]) -> str | None:
    t = c.get("t")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{_NS}t"))
    v = c.find(f"{_NS}v")
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    return v.text


def iter_rows(path: str, member: str, shared: list[str] | None = None):
    """Rows of one sheet as lists of text (None for empty cells)."""
    with zipfile.ZipFile(path) as zf:
        shared = _shared_strings(zf) if shared is None else shared
        for _, el in ET.iterparse(zf.open(member)):
            if el.tag == f"{_NS}row":
                row: list[str | None] = []
                for i, c in enumerate(el.iter(f"{_NS}c")):
                    idx = _col_index(c.get("r")) if c.get("r") else i
                    while len(row) <= idx:
                        row.append(None)
                    row[idx] = _cell_text(c, shared)
                yield row
                el.clear()


def _header(path: str, member: str) -> list[str]:
    for row in iter_rows(path, member):
        return [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(row)]
    return []


class XlsxReader(DataSourceReader):
    def __init__(self, parts, schema: StructType):
        self.parts = parts
        self.names = [f.name for f in schema.fields]

    def partitions(self):
        return [InputPartition(p) for p in self.parts]

    def read(self, partition):
        path, sheet, member, n_sheets = partition.value
        pos = {n: i for i, n in enumerate(self.names)}
        header = None
        for row in iter_rows(path, member):
            if header is None:
                header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(row)]
                continue
            if all(v is None for v in row):
                continue
            out: list[str | None] = [None] * len(self.names)
            for i, v in enumerate(row):
                if i < len(header) and header[i] in pos:
                    out[pos[header[i]]] = v
            out[pos[SOURCE_FILE]] = os.path.basename(path)
            if SOURCE_SHEET in pos and n_sheets > 1:
                out[pos[SOURCE_SHEET]] = sheet
            yield tuple(out)


class XlsxDataSource(DataSource):
    """``spark.read.format("xlsx").load("a.xlsx,b.xlsx")`` (files or folders)."""

    @classmethod
    def name(cls):
        return "xlsx"

    def _plan(self):
        parts, names, multi = [], [], False
        for f in _files(self.options.get("path", "")):
            with zipfile.ZipFile(f) as zf:
                sheets = _sheets(zf)
            multi = multi or len(sheets) > 1
            for sheet, member in sheets:
                h = _header(f, member)
                if not h:
                    continue  # empty sheet
                names += [x for x in h if x not in names]
                parts.append((f, sheet, member, len(sheets)))
        cols = names + [SOURCE_FILE] + ([SOURCE_SHEET] if multi else [])
        return parts, StructType([StructField(c, StringType(), True) for c in cols])

    def schema(self):
        return self._plan()[1]

    def reader(self, schema: StructType):
        return XlsxReader(self._plan()[0], schema)


def read_xlsx(spark: SparkSession, paths, infer: bool = True, narrow: bool = False) -> DataFrame:
    """Read workbooks (every sheet) into one DataFrame with lineage columns,
    missing-value tokens as NULL and, with ``infer``, majority-numeric typing."""
    from ..operators.cleaning import infer_types, null_tokens

    paths = [paths] if isinstance(paths, str) else list(paths)
    spark.dataSource.register(XlsxDataSource)
    df = spark.read.format("xlsx").load(",".join(paths))
    df = null_tokens(df, [c for c in df.columns if c not in (SOURCE_FILE, SOURCE_SHEET)])
    if infer:
        df, _ = infer_types(df, narrow=narrow)
    return df
