"""Sources: JSON documents, JSON lines, catalogues and paged listings."""

from __future__ import annotations

import re
import time
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairloom.functions.text import article_key, clean_html

#: The name space of workbooks.
SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: The columns of a raw document; what it lacks is null.
DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "contenido", "nro_resolucion", "nro_expediente", "fecha_emision", "sala", "materia", "procesos", "formas_resoluciones", "url_pdf_escaneado", "_corrupt")])


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, errors)`` of a folder of JSON files; an error row has ``archivo`` and ``error``."""
    rows = spark.read.schema(DOCUMENT).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path).withColumn("archivo", F.col("_metadata.file_name"))
    bad = F.when(F.col("_corrupt").isNotNull(), "JSON inválido").when(F.col("id").isNull(), "Resolución sin id")
    rows = rows.withColumn("error", bad)
    good = rows.where("error is null").drop("error", "_corrupt").withColumnsRenamed({"procesos": "tipo_proceso", "formas_resoluciones": "resultado_resolucion"})
    return good, rows.where("error is not null").select("archivo", "error")


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def catalogue(rows: DataFrame, number: str = "numero_articulo", norm: str = "norma_sigla", text: str = "contenido", keep: str = "CP") -> DataFrame:
    """``articulo, texto`` of one norm. Numbers that are no article keys, empty texts and contradictions are errors."""
    own = rows.where(F.upper(F.trim(norm)) == keep).select(article_key(F.col(number)).alias("articulo"), clean_html(F.col(text)).alias("texto"))
    checked = own.groupBy("articulo").agg(F.countDistinct("texto").alias("n"), F.min("texto").alias("texto"))
    problem = F.when(F.col("articulo").isNull(), "número inválido").when(F.col("texto") == "", "texto vacío").when(F.col("n") > 1, "textos distintos")
    return checked.select("articulo", F.when(problem.isNull(), F.col("texto")).otherwise(F.raise_error(F.concat_ws(": ", problem, "articulo"))).alias("texto"))


ENTRY = "struct<numero_articulo: string, norma_sigla: string, contenido: string>"


def catalogue_rows(whole: DataFrame) -> DataFrame:
    """The rows of catalogues that are each one JSON ``value``: a list of objects, or a map of the code's texts by number."""
    said = F.regexp_replace("value", "^\ufeff?\\s*", "")
    listed = F.from_json(said, f"array<{ENTRY}>")
    mapped = F.transform(F.map_entries(F.from_json(said, "map<string, string>")), lambda e: F.struct(e["key"].alias("numero_articulo"), F.lit("CP").alias("norma_sigla"), e["value"].alias("contenido")))
    return whole.select(F.explode(F.when(said.startswith("{"), mapped).otherwise(listed)).alias("x")).select("x.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``articulo, texto`` of a catalogue file. A catalogue without an article is an error."""
    found = catalogue(catalogue_rows(spark.read.text(path, wholetext=True)))
    if found.isEmpty():
        raise ValueError(f"no articles in {path}")
    return found


def allowed(pages: DataFrame, hosts: str) -> DataFrame:
    """``pages(url, final_url, content_type, body)`` of hosts that the pattern finds, also where they were redirected to,
    with ``host``, ``html`` in the charset they name, and the ``sha256`` of the bytes."""
    host = lambda c: F.parse_url(c, F.lit("HOST"))
    charset = F.lower(F.regexp_extract("content_type", r"(?i)charset=\"?([\w-]+)", 1))
    html = F.when(charset.isin("iso-8859-1", "latin-1", "latin1"), F.decode("body", "ISO-8859-1")).when(charset == "utf-16", F.decode("body", "UTF-16")).otherwise(F.decode("body", "UTF-8"))
    good = host("url").rlike(hosts) & host("final_url").rlike(hosts)
    return pages.where(good).withColumns({"host": host("final_url"), "html": html, "sha256": F.sha2("body", 256)})


#: Bytes of a file that a task reads as one value.
LARGE = 512 * 2**20


def file_hashes(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, length, sha256`` of every file below a folder.

    A hash needs a file's bytes in order. Tasks hash files of up to ``LARGE`` bytes; beyond, a value would take a task's
    memory, and from 2 GB on there is none, so the driver passes those through the hash as streams of any length.
    """
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(folder)
    small = files.where(F.col("length") <= LARGE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = [(r.path, r.length, stream_hash(spark, r.path)) for r in files.where(F.col("length") > LARGE).select("path", "length").collect()]
    return small.unionByName(spark.createDataFrame(large, "path string, length long, sha256 string")) if large else small


def stream_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any store that Spark reads, in constant memory."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(context._jsc.hadoopConfiguration()).open(at)
    try:
        return context._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


class StatusError(Exception):
    """An answer that is no page."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retried(call: Callable[[], list], tries: int = 4, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """``call()``, again after 3, 6 and 12 seconds while the network, or a status of 429 or above 499, is at fault."""
    for attempt in range(tries):
        try:
            return call()
        except (OSError, StatusError) as error:
            lasting = isinstance(error, StatusError) and error.status != 429 and error.status < 500
            if lasting or attempt == tries - 1:
                raise
            sleep(pause * 2**attempt)
    return []


class PagedSource(DataSource):
    """A listing in pages, a partition for each; ``fetch`` is a subclass's. Options: pages, limit, delay (seconds between
    requests of a task)."""

    @classmethod
    def name(cls) -> str:
        return "pairloom_pages"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options, self.fetch)

    @staticmethod
    def fetch(page: int, limit: int) -> list[str]:
        return [f"{page}/{i}" for i in range(limit)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch):
        self.pages, self.limit, self.delay, self.fetch = int(options.get("pages", 1)), int(options.get("limit", 50)), float(options.get("delay", 0)), fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, self.pages + 1)]

    def read(self, partition: InputPartition):
        time.sleep(self.delay)
        yield from [(partition.value, x) for x in retried(lambda: self.fetch(partition.value, self.limit))]


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of a local workbook as strings; its first row names the columns. Sheets are small: the driver reads them."""
    with zipfile.ZipFile(path) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        names = [s.get("name") for s in tree("xl/workbook.xml").iter(f"{SHEETS}sheet")]
        shared = ["".join(t.text or "" for t in si.iter(f"{SHEETS}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
        rows = []
        for row in tree(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml").iter(f"{SHEETS}row"):
            cells = {}
            for cell in row.iter(f"{SHEETS}c"):
                at = re.sub("[0-9]", "", cell.get("r"))
                said = "".join(t.text or "" for t in cell.iter(f"{SHEETS}t")) if cell.get("t") == "inlineStr" else cell.findtext(f"{SHEETS}v")
                cells[at] = shared[int(said)] if cell.get("t") == "s" else said
            rows.append(cells)
    head = rows[0] if rows else {}
    schema = T.StructType([T.StructField(n, T.StringType()) for n in head.values()])
    return spark.createDataFrame([[r.get(c) for c in head] for r in rows[1:]], schema)
