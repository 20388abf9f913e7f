"""Page-layout analytics over line and glyph tables, as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors

GAP, BUCKET, LINE_GAP, PAD = 15.0, 10.0, 3.0, 8.0
MIN_HEIGHT, MIN_GLYPHS, MIN_LINES, LINE_SHARE = 80, 20, 4, 0.15
REGION = ["doc_id", "page"]


def glyph_lines(glyph: DataFrame) -> DataFrame:
    """Glyphs (doc_id, page, x, y, width) with ``line``: a new one where y steps by more than LINE_GAP."""
    order = Window.partitionBy(*REGION).orderBy("y", "x")
    step = F.when(F.col("y") - F.lag("y").over(order) > LINE_GAP, 1).otherwise(0)
    return glyph.withColumn("__s", step).withColumn("line", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def column_bands(glyph: DataFrame, x: int, width: int, height: int) -> DataFrame:
    """(doc_id, page, split_x, y_start, y_end): the recurring wide gap of a region, where enough lines confirm one."""
    lines = glyph_lines(glyph)
    size = lines.groupBy(*REGION).agg(F.count(F.lit(1)).alias("glyphs"), F.countDistinct("line").alias("lines"))
    size = size.filter((F.col("glyphs") >= MIN_GLYPHS) & (F.col("lines") >= MIN_LINES) & F.lit(height >= MIN_HEIGHT))
    row = Window.partitionBy(*REGION, "line").orderBy("x")
    gaps = lines.select(*REGION, F.first("y").over(row).alias("line_y"), (F.col("x") + F.col("width")).alias("from"), F.lead("x").over(row).alias("to"))
    gaps = gaps.filter((F.col("to") - F.col("from") >= GAP) & F.col("to").between(x + width * 0.1, x + width * 0.9))
    buckets = gaps.groupBy(*REGION, F.floor(F.col("to") / BUCKET).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("to").cast("int").alias("split_x"), F.min("line_y").alias("y_start"), F.max("line_y").alias("y_end"), F.min(F.struct("line_y", "to")).alias("first")
    )
    best = Window.partitionBy(*REGION).orderBy(F.col("n").desc(), "first")
    top = buckets.withColumn("__r", F.row_number().over(best)).filter("__r = 1").join(size, REGION)
    need = F.greatest(F.lit(MIN_LINES), F.floor(F.col("lines") * LINE_SHARE))
    return top.filter(F.col("n") >= need).select(*REGION, "split_x", "y_start", "y_end")


def reading_order(glyph: DataFrame, bands: DataFrame) -> DataFrame:
    """Glyphs with ``reading``: above the band, its left column, its right one, below; then down and across."""
    g = glyph_lines(glyph).join(bands, REGION, "left")
    inside = F.col("y").between(F.col("y_start") - PAD, F.col("y_end") + PAD)
    part = F.when(F.col("split_x").isNull(), 0).when(inside & (F.col("x") < F.col("split_x")), 1).when(inside, 2).when(F.col("y") > F.col("y_end"), 3).otherwise(0)
    order = Window.partitionBy(*REGION).orderBy("part", "line", "x")
    return g.withColumn("part", part).withColumn("reading", F.row_number().over(order)).drop("split_x", "y_start", "y_end")


def section_ranges(section: DataFrame, page_height: int) -> DataFrame:
    """Sections (doc_id, section_no, page, position) as (doc_id, section_no, page, y, h), a row per page that each spans.

    A section ends where the next begins, the last on its own page.
    """
    order = Window.partitionBy("doc_id").orderBy("section_no", "page", "position")
    s = section.withColumn("to_page", F.lead("page").over(order)).withColumn("to_pos", F.coalesce(F.lead("position").over(order), F.lit(0)))
    s = s.withColumn("last", F.when(F.col("to_page") >= F.col("page"), F.col("to_page")).otherwise(F.col("page"))).filter("page >= 1")
    p = s.select("doc_id", "section_no", F.col("page").alias("first"), "last", "position", "to_pos", F.explode(F.sequence("page", "last")).alias("page"))
    on_first, on_last = F.col("page") == F.col("first"), F.col("page") == F.col("last")
    y = F.when(on_last, F.col("to_pos")).otherwise(0)
    h = F.when(on_first & on_last, F.col("position") - F.col("to_pos")).when(on_first, F.col("position")).when(on_last, page_height - F.col("to_pos")).otherwise(page_height)
    return p.select("doc_id", "section_no", "page", y.alias("y"), F.greatest(h, F.lit(0)).alias("h")).filter("h > 0")


def running_headers(section: DataFrame, max_length: int = 60, share: float = 0.3) -> DataFrame:
    """(doc_id, line): short lines that come in at least three sections and ``share`` of a document's."""
    lines = section.select("doc_id", "section_no", F.explode(tx.lines(F.col("body"))).alias("line"))
    lines = lines.select("doc_id", "section_no", tx.running_header_key(tx.trim_ws(F.col("line"))).alias("line")).filter((F.col("line") != "") & (F.length("line") <= max_length)).distinct()
    n = section.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("c")).join(n, "doc_id").filter(F.col("c") >= F.greatest(F.col("n") * share, F.lit(3.0))).select("doc_id", "line")


def clean_sections(section: DataFrame) -> DataFrame:
    """Sections (doc_id, section_no, level, title, body) with furniture and running headers out of their bodies."""
    lines = section.select("doc_id", "section_no", F.posexplode(tx.lines(F.col("body"))).alias("i", "raw"))
    lines = lines.filter(~tx.is_page_furniture(F.col("raw"))).withColumn("line", tx.running_header_key(tx.trim_ws(F.col("raw"))))
    kept = lines.join(running_headers(section), ["doc_id", "line"], "left_anti")
    one = tx.trim_ws(F.regexp_replace("raw", " {2,}", " "))
    body = kept.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("t")))).alias("x"))
    body = body.select("doc_id", "section_no", tx.trim_ws(F.array_join(F.transform("x", lambda v: v["t"]), "\n")).alias("body"))
    return section.drop("body").join(body, ["doc_id", "section_no"], "left").withColumn("body", F.coalesce("body", F.lit("")))


def outline_markdown(section: DataFrame) -> DataFrame:
    """(doc_id, markdown) of documents with an outline; sections without text are left out."""
    s = clean_sections(section.filter(tx.trim_ws(F.col("body")) != ""))
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 2, F.lit(6))), F.lit(" "), "title")
    part = F.when(F.col("body") == "", head).otherwise(F.concat(head, F.lit("\n\n"), "body"))
    parts = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", part.alias("p")))).alias("x"))
    return parts.select("doc_id", F.array_join(F.transform("x", lambda v: v["p"]), "\n\n").alias("markdown"))


def font_markdown(line: DataFrame) -> DataFrame:
    """(doc_id, markdown) from lines (doc_id, line_no, text, font_size, starts_paragraph): size against the upper median makes headings."""
    sizes = line.groupBy("doc_id").agg(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("s"))
    median = sizes.select("doc_id", F.when(F.size("s") > 0, vectors.upper_median(F.col("s"))).alias("median"))
    ratio = (F.col("font_size") / F.col("median")).cast("double")
    t = F.col("text")
    wrap = lambda mark: F.concat(F.lit(f"\n\n{mark} "), t, F.lit("\n\n"))
    body = F.when(F.col("starts_paragraph"), F.concat(F.lit("\n\n"), t, F.lit("\n"))).otherwise(F.concat(t, F.lit("\n")))
    shown = F.when(F.col("median").isNull(), F.concat(t, F.lit("\n"))).when(ratio > 1.8, wrap("#")).when(ratio > 1.4, wrap("##")).when(ratio > 1.15, wrap("###")).otherwise(body)
    parts = line.join(median, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("p")))).alias("x"))
    return parts.select("doc_id", tx.trim_ws(F.array_join(F.transform("x", lambda v: v["p"]), "")).alias("markdown"))
