"""Workbooks as cells. Files come through Spark's binary reader, so any store will do, and are parsed in its tasks.

A workbook is a zip of XML: shared strings, a list of sheets, and a part per sheet. One pass gives formulas and the values
that were cached for them.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.longform import column_letters

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, row int, col int, coord string, num double, txt string, bool boolean, err string, formula string"
SHEETS = "file string, sheet string, position int, state string, rows int, columns int"
NAMES = "file string, name string, refers_to string, scope string"
#: A workbook that would grow beyond this is refused before it is unpacked.
LARGEST, RATIO = 300 << 20, 150
VOLATILE = ("TODAY", "NOW", "RAND", "RANDBETWEEN", "OFFSET", "INDIRECT", "INFO", "CELL", "HOJE", "AGORA", "ALEATÓRIO")


class Refused(ValueError):
    """The file is no workbook, or inflates too much."""


def opened(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused("no zip file") from e
    size = sum(i.file_size for i in z.infolist())
    if size > LARGEST or size > RATIO * max(1, len(data)):
        raise Refused(f"it unpacks to {size} bytes")
    return z


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """name, state, part."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    parts = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), s.get("state", "visible"), path(parts[s.get(LINK)])) for s in book.iter(f"{MAIN}sheet")]


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def _moved(formula: str, down: int, right: int) -> str:
    """A shared formula's text for another cell."""

    def move(m: re.Match) -> str:
        c, r = m[2], m[4]
        n = 0
        for x in c.upper():
            n = n * 26 + ord(x) - 64
        return f"{m[1]}{c if m[1] else column_letters(n - 1 + right)}{m[3]}{r if m[3] else int(r) + down}"

    parts = re.split(r'("(?:[^"]|"")*")', formula)
    return "".join(p if i % 2 else re.sub(r"(?<![\w.])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![\w(])", move, p) for i, p in enumerate(parts))


def _rows(z: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple]:
    """row, col, coordinate, value (number, text, truth, error) and formula of the cells of a sheet, read as a stream."""
    shared: dict[str, tuple[str, int, int]] = {}
    with z.open(part) as data:
        for _, c in ET.iterparse(data):
            if c.tag == f"{MAIN}row":
                c.clear()
            if c.tag != f"{MAIN}c":
                continue
            letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
            row, col = int(digits), 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            value, formula, kind = c.findtext(f"{MAIN}v"), c.find(f"{MAIN}f"), c.get("t", "n")
            text = None
            if formula is not None:
                text, group = formula.text, formula.get("si")
                if formula.get("t") == "shared" and text:
                    shared[group] = (text, row, col)
                elif formula.get("t") == "shared":
                    first, r0, c0 = shared[group]
                    text = _moved(first, row - r0, col - c0)
                text = None if text is None else "=" + text
            if kind == "inlineStr":
                value, kind = "".join(t.text or "" for t in c.iter(f"{MAIN}t")), "str"
            elif kind == "s" and value is not None:
                value, kind = strings[int(value)], "str"
            c.clear()
            if value is None and text is None:
                continue
            num = float(value) if kind == "n" and value not in (None, "") else None
            yield (row, col, f"{letters}{row}", num, value if kind == "str" else None, value == "1" if kind == "b" and value is not None else None, value if kind == "e" else None, text)


def parse(file: str, data: bytes) -> Iterator[tuple]:
    """The non-empty cells of a workbook."""
    z = opened(data)
    strings = _strings(z)
    for sheet, _, part in _sheets(z):
        for row in _rows(z, part, strings):
            yield (file, sheet, *row)


def _over(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:  # noqa: ANN001
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(rows(file, data)), columns=names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def cells(spark: SparkSession, path: str) -> DataFrame:
    return _over(spark, path, parse, CELLS)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    def rows(file: str, data: bytes) -> Iterator[tuple]:
        sizes: dict[str, list[int]] = {}
        for _, sheet, row, col, *_ in parse(file, data):
            most = sizes.setdefault(sheet, [0, 0])
            most[0], most[1] = max(most[0], row), max(most[1], col)
        for i, (name, state, _) in enumerate(_sheets(opened(data))):
            yield file, name, i, state, *sizes.get(name, (0, 0))

    return _over(spark, path, rows, SHEETS)


def named_ranges(spark: SparkSession, path: str) -> DataFrame:
    def rows(file: str, data: bytes) -> Iterator[tuple]:
        z = opened(data)
        order = [s[0] for s in _sheets(z)]
        for n in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}definedName"):
            local = n.get("localSheetId")
            yield file, n.get("name"), n.text, "workbook" if local is None else order[int(local)]

    return _over(spark, path, rows, NAMES)


def compatibility(spark: SparkSession, path: str) -> DataFrame:
    """A row per workbook: macros, links to other books, volatile functions, and what follows from them."""

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        z = opened(data)
        formulas = [c[-1] for c in parse(file, data) if c[-1]]
        macros = any(n.endswith("vbaProject.bin") for n in z.namelist())
        links = any("externalLinks/" in n for n in z.namelist()) or any("[" in f for f in formulas)
        volatile = sum(any(re.search(rf"(?i)(?<![\w.]){v}\(", f) for v in VOLATILE) for f in formulas)
        yield file, len(formulas), macros, links, volatile, "unsupported" if macros else "restricted" if links or volatile else "supported"

    return _over(spark, path, rows, "file string, formulas long, has_macros boolean, has_external_links boolean, volatile_formulas long, verdict string")


def restricted_items(cells_: DataFrame, sheets_: DataFrame) -> DataFrame:
    """kind, file, sheet, cell, formula of what restricts a workbook: references to other books, volatile functions, and hidden
    sheets with either."""
    volatile = F.col("formula").rlike(rf"(?i)(?<![\w.])(?:{'|'.join(VOLATILE)})\(")
    kind = F.when(F.col("formula").contains("["), "external_ref").when(volatile, "volatile")
    items = cells_.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "file", "sheet", F.col("coord").alias("cell"), "formula")
    hidden = items.select("file", "sheet").distinct().join(sheets_.filter("state <> 'visible'").select("file", "sheet"), ["file", "sheet"])
    none = F.lit(None).cast("string")
    return items.unionByName(hidden.select(F.lit("hidden_sheet").alias("kind"), "file", "sheet", none.alias("cell"), none.alias("formula")))


def write_books(df: DataFrame, by: str, folder: str, tables: Callable[[pd.DataFrame], dict[str, list[list[object]]]], hidden: tuple[str, ...] = ()) -> DataFrame:
    """file and bytes of the workbooks written, one for each value of column `by` (its name), by the tasks that hold its rows;
    tables makes the sheets of one. Several writes of one workbook, as after a lost executor, leave the same file. The folder
    is one that Arrow's file systems reach."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        data = written(tables(group), hidden)
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/{group[by].iloc[0]}.xlsx"
        part = f"{base}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, name)
        return pd.DataFrame([(name, len(data))], columns=["file", "bytes"])

    return df.groupBy(by).applyInPandas(write, "file string, bytes long")


def missing_cache(cells_: DataFrame) -> DataFrame:
    """Formula cells that hold no computed value."""
    none = F.col("num").isNull() & F.col("txt").isNull() & F.col("bool").isNull() & F.col("err").isNull()
    return cells_.filter(F.col("formula").isNotNull() & none)


def grid(cells_: DataFrame, sheet: str, width: int) -> tuple[DataFrame, list[str]]:
    """A sheet as a grid of text (see operators/longform.py) with its headers, of which there are `width`."""
    text = F.coalesce("txt", F.when(F.col("num") == F.floor("num"), F.format_string("%d", F.col("num").cast("long"))).otherwise(F.col("num").cast("string")), F.col("bool").cast("string"), "err")
    rows = cells_.filter(F.col("sheet") == sheet).groupBy(F.col("row").cast("long").alias("row_no")).agg(*(F.max(F.when(F.col("col") == i + 1, text)).alias(f"c{i}") for i in range(width)))
    head = rows.filter("row_no = 1").first()
    return rows.filter("row_no > 1"), [(head[f"c{i}"] or "") if head else "" for i in range(width)]


def written(tables: dict[str, list[list[object]]], hidden: tuple[str, ...] = ()) -> bytes:
    """A small workbook of these sheets; a text that begins with = is a formula. For fixtures and reports."""
    out = io.BytesIO()
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    state = lambda name: ' state="hidden"' if name in hidden else ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"{state(n)}/>' for i, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="x" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1)) + "</Relationships>")
        for i, rows in enumerate(tables.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                line = []
                for c, v in enumerate(row):
                    at = f"{column_letters(c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        line.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, (int, float)):
                        line.append(f'<c r="{at}"><v>{v!r}</v></c>')
                    elif str(v).startswith("="):
                        line.append(f'<c r="{at}"><f>{escape(str(v)[1:])}</f></c>')
                    else:
                        line.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(line)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()
