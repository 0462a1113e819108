"""Tables of what drawings hold: files, pages, lines, strokes, filled shapes; and output tables.

Decoding PDF files needs a library that may be absent; everything here starts from tables, which any
decoder can write: ``lines(doc, page, line_id, x0, y0, x1, y1, text, size, dir_x, dir_y)``,
``strokes(doc, page, ax, ay, bx, by, color)``, ``fills(doc, page, x0, y0, x1, y1, fill)``,
``pages(doc, page, label, rotation, width, height, n_words)`` and ``toc(doc, title, page)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import kind_of_drawing, octal_decoded, squeezed, storey_key


def drawing_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files under a folder with what they detail: (path, size, mtime, folder, stem, kind)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder).drop("content")
    parts = F.split(F.col("path"), "/")
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"))
    return out.withColumn("kind", kind_of_drawing("folder", "stem"))


def text_lines(lines: DataFrame) -> DataFrame:
    """Lines with squeezed text, those without any left out, and whether they run up the page."""
    out = lines.withColumn("text", squeezed("text")).filter(F.col("text") != "")
    return out.withColumn("vertical", F.abs("dir_y") > F.abs("dir_x"))


def readable_lines(lines: DataFrame, ocr_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Embedded lines of pages with enough words, else the lines read by OCR that are not doubtful."""
    rich = pages.filter(F.col("n_words") >= K.MIN_WORDS).select("doc", "page")
    read = ocr_lines.filter(~F.coalesce("doubtful", F.lit(False))).join(rich, ["doc", "page"], "left_anti")
    return lines.join(rich, ["doc", "page"], "left_semi").unionByName(read, allowMissingColumns=True)


def unread_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that need OCR and are not in the cache of this state of their file, counted by file."""
    keys = ["doc", "page", "size", "mtime"]
    return pages.filter(F.col("n_words") < K.MIN_WORDS).join(cache.select(*keys), keys, "left_anti").groupBy("doc").count()


def same_color(color: Column, wanted: tuple[float, ...]) -> Column:
    return F.coalesce(F.forall(F.zip_with(color, F.array(*map(F.lit, wanted)), lambda a, b: F.abs(a - b) < 0.02), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def black_shapes(fills: DataFrame) -> DataFrame:
    """Filled black shapes of a column's size."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return fills.filter(same_color(F.col("fill"), (0.0, 0.0, 0.0)) & (w > 3) & (w < 60) & (h > 3) & (h < 60))


def long_strokes(strokes: DataFrame, pages: DataFrame, shortest: float = 60, longest: float = 0.8) -> DataFrame:
    """Long level strokes (x0, x1, y) of pages as displayed; those of the frame are left out."""
    length = F.abs(F.col("ax") - F.col("bx"))
    out = strokes.join(pages.select("doc", "page", "width"), ["doc", "page"]).filter((F.abs(F.col("ay") - F.col("by")) < 0.5) & (length >= shortest) & (length <= longest * F.col("width")))
    return out.select("doc", "page", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.col("ay").alias("y"))


def rulings(strokes: DataFrame, pages: DataFrame) -> DataFrame:
    """x of vertical rulings: strokes add up to over a quarter of the page's height."""
    up = strokes.filter(F.abs(F.col("ax") - F.col("bx")) < 0.5).groupBy("doc", "page", F.bround("ax", 0).alias("x")).agg(F.sum(F.abs(F.col("ay") - F.col("by"))).alias("length"))
    return up.join(pages.select("doc", "page", "height"), ["doc", "page"]).filter(F.col("length") > 0.25 * F.col("height")).select("doc", "page", "x")


def page_titles(pages: DataFrame, toc: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, title): a page's label with a sheet number, else a bookmark whose number stands on
    the page it points to (the first one), else a misplaced bookmark whose number stands on one page
    only that has no title."""
    number = lambda c: F.replace(F.regexp_extract(c, K.SHEET, 0), F.lit(" "), F.lit(""))
    label = octal_decoded("label")
    own = pages.select("doc", "page", label.alias("title")).filter(F.col("title").rlike(K.SHEET))
    written = words.filter(F.col("text").rlike(f"^(?:{K.SHEET})$")).select("doc", "page", F.replace("text", F.lit(" "), F.lit("")).alias("number")).distinct().join(own.select("doc", "page"), ["doc", "page"], "left_anti")
    marks = toc.filter(F.col("title").rlike(K.SHEET)).withColumn("number", number("title"))
    right = marks.join(written, ["doc", "page", "number"], "left_semi")
    first = right.withColumn("n", F.row_number().over(W.partitionBy("doc", "page").orderBy("entry"))).filter("n = 1").select("doc", "page", "title")
    lost = marks.join(written, ["doc", "page", "number"], "left_anti").select("doc", "number", "title", "entry")
    open_ = written.join(first.select("doc", "page"), ["doc", "page"], "left_anti")
    # a page can be claimed once: by the first bookmark of its number; several carriers claim nothing
    one = open_.withColumn("carriers", F.count(F.lit(1)).over(W.partitionBy("doc", "number"))).filter("carriers = 1").drop("carriers")
    late = lost.withColumn("n", F.row_number().over(W.partitionBy("doc", "number").orderBy("entry"))).filter("n = 1").join(one, ["doc", "number"])
    late = late.withColumn("n", F.row_number().over(W.partitionBy("doc", "page").orderBy("entry"))).filter("n = 1").select("doc", "page", "title")
    return own.unionByName(first).unionByName(late)


def series(titles: DataFrame, pattern: str) -> DataFrame:
    """Pages whose title matches, with the sheet number, its letter included."""
    at = F.regexp_extract("title", rf"({K.SHEET}.*)$", 1)
    long = F.regexp_extract(at, "^" + K.SERIES_NUMBER, 0)
    number = F.when(long != "", long).otherwise(F.regexp_extract("title", K.SHEET, 0))
    return titles.filter(F.col("title").rlike(K.SHEET) & F.col("title").rlike("(?i)" + pattern)).withColumn("sheet", F.replace(number, F.lit(" "), F.lit("")))


def sheet_storeys(titles: DataFrame) -> DataFrame:
    """(doc, sheet, storey) of the column sheets, the first title of each sheet deciding."""
    sheet = F.regexp_extract("title", K.SHEET, 0)
    rows = titles.filter(sheet.rlike(f"^(?:{K.COLUMN_SHEET})$")).select("doc", "page", F.replace(sheet, F.lit(" "), F.lit("")).alias("sheet"), storey_key(F.regexp_replace("title", K.SHEET, "")).alias("storey")).filter("storey is not null")
    return rows.groupBy("doc", "sheet").agg(F.min_by("storey", "page").alias("storey"), F.min("page").alias("page"))


def storey_sheets(titles: DataFrame) -> DataFrame:
    """(doc, storey, sheet): the first column sheet of each storey."""
    return sheet_storeys(titles).groupBy("doc", "storey").agg(F.min_by("sheet", "page").alias("sheet"))


def annotations(records: DataFrame, color: Column) -> DataFrame:
    """What check drawings show: a box, a label and a colour for each record."""
    return records.select("fichier", "page", "x", "y", F.concat_ws(" ", "element", "feuillet").alias("label"), color.alias("color"))


def write_once(df: DataFrame, path: str) -> None:
    """Writes what must never be overwritten: readings that corrections refer to, corrections."""
    df.write.mode("ignore").parquet(path)
