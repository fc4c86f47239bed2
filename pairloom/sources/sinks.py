"""Sinks: never over what is there, each from one pass over its rows."""

from __future__ import annotations

import hashlib
import pathlib
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import escaped

#: Rows of a sheet, and of a page of cards, at most.
SHEET_ROWS, CARDS = 100_000, 100


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer makes the folder complete or absent."""
    df.write.mode("errorifexists").json(path)


def write_documents(df: DataFrame, path: str, key: str = "id", content: str = "contenido") -> None:
    """JSON lines of documents; one without a key or content is an error, and then nothing is written."""
    good = F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(content), F.lit(""))) != "")
    checked = F.when(good, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("document without key or content: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(df.schema[key].dataType))
    write_lines(df.withColumn(key, checked), path)


def write_outputs(df: DataFrame, kind: str, path: str) -> None:
    """One folder for each value of ``kind`` (a split, or one of several outputs), in one pass."""
    df.write.mode("errorifexists").partitionBy(kind).json(path)


def write_catalogue(df: DataFrame, path: str, key: str = "articulo", text: str = "texto") -> None:
    """A catalogue as one JSON map; it is small, as it must be to be one."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(text))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, for sheets."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))


def write_cards(df: DataFrame, path: str, title: str, n: int = CARDS) -> None:
    """An HTML page of the first ``n`` rows, escaped."""
    lines = F.concat(F.lit("<article>"), *(F.concat(F.lit(f"<p><b>{escape(c)}</b> "), escaped(F.col(c)), F.lit("</p>")) for c in flat(df).columns), F.lit("</article>"))
    cards = [r.card for r in flat(df).limit(n).select(lines.alias("card")).collect()]
    with open(path, "x", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title>" + "".join(cards))


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def write_sheets(tables: dict[str, DataFrame], path: str, rows: int = SHEET_ROWS) -> None:
    """A workbook, a sheet for each table: frozen header, filter, nested values as JSON. A table of more than ``rows`` rows
    is an error, for sheets are read by people and written by the driver."""
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as book:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}"/>' for i in range(1, len(tables) + 1))
        book.writestr("[Content_Types].xml", _BOOK["[Content_Types].xml"].format(parts))
        book.writestr("_rels/.rels", _BOOK["_rels/.rels"])
        named = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in enumerate(tables, 1))
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, df in enumerate(tables.values(), 1):
            found = flat(df).limit(rows + 1).collect()
            if len(found) > rows:
                raise ValueError(f"more than {rows} rows")
            cell = lambda r, c, v: f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else ""
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values)) + "</row>" for r, values in enumerate([df.columns, *map(tuple, found)], 1))
            view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            columns = "".join(f'<col min="{c}" max="{c}" width="30" customWidth="1"/>' for c in range(1, len(df.columns) + 1))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {_MAIN}>{view}<cols>{columns}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{_letters(len(df.columns) - 1)}{len(found) + 1}"/></worksheet>')


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A file kept as it is, for provenance, between any two stores that Spark knows; never over what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, False, conf)


def code_hashes(package: str) -> dict[str, str]:
    """The SHA-256 of each module of a package folder."""
    root = pathlib.Path(package)
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}


def manifest(tables: dict[str, DataFrame], inputs: DataFrame | None = None, package: str | None = None) -> dict[str, dict]:
    """Rows and an order-insensitive checksum of each table; with ``inputs(path, content)``, as ``binaryFile`` reads them, the
    SHA-256 of each input, and with ``package`` that of its code."""
    out: dict[str, dict] = {}
    for name, df in tables.items():
        n, h = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
        out[name] = {"rows": n, "checksum": str(h)}
    if inputs is not None:
        out["inputs"] = {r.path: r.h for r in inputs.select("path", F.sha2("content", 256).alias("h")).collect()}
    if package is not None:
        out["code"] = code_hashes(package)
    return out
