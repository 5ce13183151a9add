"""From nested page layouts to flat blocks, lines and text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as T

#: Labels of headings, and of blocks that are no part of the running text.
HEADINGS = ("doc_title", "paragraph_title", "section_title", "title", "heading")
EXCLUDED = ("header", "footer", "header_image", "footer_image", "page_number", "number")


def norm_box(box: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> in order; polygons become their bounds; null below four numbers. Null places count as absent."""
    v = F.filter(box, lambda x: x.isNotNull())
    xs, ys = F.filter(v, lambda _, i: i % 2 == 0), F.filter(v, lambda _, i: i % 2 == 1)
    # Of exactly four numbers and of polygons alike, the bounds by even and odd places are the ordered box.
    out = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(v) >= 4, out)


def find_blocks(blocks: DataFrame) -> DataFrame:
    """First of the blocks of a page that have the same text (white space collapsed) and box.

    Takes (page_id, ord, block_content, block_bbox, ...). Blocks without text or box are no blocks.
    """
    b = blocks.withColumn("box", norm_box(F.col("block_bbox"))).withColumn("text", T.collapse(F.col("block_content")))
    b = b.where("box IS NOT NULL AND text <> ''")
    first = Window.partitionBy("page_id", "text", "box").orderBy("ord")
    return b.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def page_scale(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, w, h): the page's size, else the farthest edges of its blocks. `blocks` has (page_id, box)."""
    edge = blocks.groupBy("page_id").agg(F.max("box.x1").alias("_w"), F.max("box.y1").alias("_h"))
    return pages.select("page_id", "width", "height").join(edge, "page_id", "left").select("page_id", F.coalesce("width", "_w").alias("w"), F.coalesce("height", "_h").alias("h"))


def on_page(blocks: DataFrame) -> DataFrame:
    """Blocks cut to the page (needs box, w, h, text): replacement characters out, blank ones and slivers under one unit dropped."""
    t = F.trim(F.replace(F.col("text"), F.lit(chr(0xFFFD)), F.lit("")))
    b = blocks.withColumn("text", t)
    b = b.withColumn("x0", F.greatest("box.x0", F.lit(0.0))).withColumn("y0", F.greatest("box.y0", F.lit(0.0)))
    b = b.withColumn("x1", F.least("box.x1", "w")).withColumn("y1", F.least("box.y1", "h"))
    return b.where("text <> '' AND least(x1 - x0, y1 - y0) >= 1").drop("box")


def text_rows(blocks: DataFrame) -> DataFrame:
    """One row for each line of each block that lies in its page, with places as shares of the page.

    Takes (page_id, ord, label, text, box, w, h); tables are left to `tables.table_rows`.
    """
    inside = "w > 0 AND h > 0 AND 0 <= box.x0 AND box.x0 < box.x1 AND box.x1 <= w AND 0 <= box.y0 AND box.y0 < box.y1 AND box.y1 <= h"
    b = blocks.where(inside).where(~F.contains(F.lower("text"), F.lit("<table")))
    b = b.withColumn("lines", F.split("text", "\n"))
    n = F.size("lines")
    r = b.select("*", F.posexplode("lines").alias("line", "raw"))
    tall = (F.col("box.y1") - F.col("box.y0")) / n
    r = r.select(
        "page_id", "ord", "label", "line",
        T.clean_title(F.col("raw")).alias("text"),
        (F.col("label").isin(*HEADINGS) | F.col("raw").rlike("^\\s*#{1,6}\\s+")).alias("heading"),
        (n == 1).alias("single"),
        (F.col("box.x0") / F.col("w")).alias("x"), (F.col("box.x1") / F.col("w")).alias("right"),
        ((F.col("box.y0") + tall * F.col("line")) / F.col("h")).alias("y"), (tall / F.col("h")).alias("height"),
    )
    return r.where("text <> ''")


def review_layouts(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """`pages` (source_sha256, page, width, height, blocks) with the lines of their reviews in place of their blocks.

    `reviews`: (source_sha256, page, reason, original, lines), lines an array of (text, bbox). A review fails the query if its
    page was reviewed twice, it gives no reason, its original blocks are not the page's, the page has no size, it has no
    lines, or a line is blank, goes over several lines, or has no box of four numbers in order within the page. A review of
    another source finds no page.
    """
    r = reviews.groupBy("source_sha256", "page").agg(F.count("*").alias("_n"), F.first("original").alias("_o"), F.first("lines").alias("_r"), F.first("reason").alias("_why"))
    j = pages.join(r, ["source_sha256", "page"], "left")
    box = lambda x: x["bbox"]
    right = lambda x: (
        (F.trim(x["text"]) != "") & ~F.contains(x["text"], F.lit("\n")) & (F.size(box(x)) == 4) & F.forall(box(x), lambda v: v.isNotNull() & ~F.isnan(v))
        & (box(x)[0] >= 0) & (box(x)[0] < box(x)[2]) & (box(x)[2] <= F.col("width")) & (box(x)[1] >= 0) & (box(x)[1] < box(x)[3]) & (box(x)[3] <= F.col("height"))
    )
    fails = (
        F.when(F.col("_n") > 1, "page reviewed twice").when(F.coalesce(F.trim("_why"), F.lit("")) == "", "review without a reason").when(~F.col("_o").eqNullSafe(F.col("blocks")), "review of other blocks")
        .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "page without a size").when(~F.coalesce(F.size("_r") > 0, F.lit(False)), "review without lines").when(~F.forall("_r", lambda x: F.coalesce(right(x), F.lit(False))), "line that is not in the page")
    )
    label = F.lit("reviewed_line")
    lines = F.transform("_r", lambda x: F.struct(x["text"].alias("block_content"), x["bbox"].alias("block_bbox"), label.alias("block_label")))
    kept = F.transform("blocks", lambda x: F.struct(x["block_content"].alias("block_content"), x["block_bbox"].alias("block_bbox"), x["block_label"].alias("block_label")))
    checked = F.when(F.col("_n").isNull(), kept).when(fails.isNotNull(), F.raise_error(fails)).otherwise(lines)
    return j.withColumn("blocks", checked).drop("_n", "_o", "_r", "_why")


def validated(results: Column, expected: Column) -> Column:
    """`results` if there are as many as expected and none is null; else the query fails."""
    ok = (F.size(results) == expected) & F.forall(results, lambda r: r.isNotNull())
    return F.when(ok, results).otherwise(F.raise_error(F.lit("result count or type differs")))
