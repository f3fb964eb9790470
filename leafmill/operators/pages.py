"""Operations on page collections: ``(doc_id, page_index, ...)`` from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.ranks import before

RANGES = r"^\s*\d+\s*(?:-\s*\d+\s*)?(?:,\s*\d+\s*(?:-\s*\d+\s*)?)*\s*$"


def counted(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``pages`` with ``n_pages``: a partial count and a join, so a document of very many pages meets no single task."""
    return pages.join(pages.groupBy(doc).agg(F.count("*").alias("n_pages")), doc)


def split_by_count(pages: DataFrame, parts: int, doc: str = "doc_id") -> DataFrame:
    """``part`` of ceil(pages / parts) pages each; the last parts may be missing."""
    if not 2 <= parts <= 50:
        raise ValueError("parts must be from 2 to 50")
    return counted(pages, doc).withColumn("part", F.floor(F.col("page_index") / F.ceil(F.col("n_pages") / parts)).cast("int"))


def parse_ranges(text: str, n_pages: int | None = None) -> list[tuple[int, int]]:
    """``1-3, 5`` as pairs of first and last page from 1; anything else is an error."""
    out = []
    for piece in (p.strip() for p in text.split(",")):
        if not piece:
            continue
        first, _, last = piece.partition("-")
        try:
            a = int(first)
            b = int(last) if last.strip() else a
        except ValueError as e:
            raise ValueError(f"no page range: {piece}") from e
        if a < 1 or b < a or n_pages is not None and b > n_pages:
            raise ValueError(f"outside the pages: {piece}")
        out.append((a, b))
    if not out:
        raise ValueError("no page range")
    return out


def split_by_ranges(pages: DataFrame, ranges: str) -> DataFrame:
    """One ``part`` for each range, in order; ranges may overlap. The ranges are a short constant, so pages explode only into the parts that hold them."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a - 1).alias("a"), F.lit(b - 1).alias("b")) for i, (a, b) in enumerate(parse_ranges(ranges))))
    inside = F.filter(parts, lambda p: F.col("page_index").between(p.a, p.b))
    return pages.withColumn("_p", F.explode(inside)).withColumn("part", F.col("_p.part")).drop("_p")


def merge(pages: DataFrame, order: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages of the documents of ``order(doc, file_seq)`` as one document: ``page_no`` from 0 by file, then page.

    Numbers come from the pages before each file, summed by ranges of files: no task sees all pages or all files.
    """
    sizes = pages.groupBy(doc).agg(F.count("*").alias("_n")).join(order, doc)
    first = before(sizes, ["file_seq", doc], F.col("_n"), "_first").select(doc, "file_seq", "_first")
    own = F.row_number().over(W.partitionBy(doc, "file_seq").orderBy("page_index")) - 1
    return pages.join(first, doc).withColumn("page_no", (F.col("_first") + own).cast("long")).drop("_first")


def labels(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``i / n`` for each page."""
    w = W.partitionBy(doc)
    return pages.withColumn("label", F.concat(F.row_number().over(w.orderBy("page_index")).cast("string"), F.lit(" / "), F.count("*").over(w).cast("string")))


def reorder(pages: DataFrame, instructions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages in the order of ``instructions(doc, seq, old_index, rotation, deleted)``; a page may come twice; rotation adds up."""
    i = instructions.where(~F.col("deleted")).withColumnRenamed("rotation", "_turn")
    out = i.join(pages, (i[doc] == pages[doc]) & (i["old_index"] == pages["page_index"])).drop(pages[doc])
    place = F.row_number().over(W.partitionBy(doc).orderBy("seq")) - 1
    return out.withColumn("rotation", F.col("rotation") + F.col("_turn")).withColumn("new_index", place).drop("_turn", "deleted")


def page_slice(pages: DataFrame, start: int, end: int, doc: str = "doc_id") -> DataFrame:
    """Pages ``start`` to ``end`` (both counted from 0; a negative end is the last page)."""
    if 0 <= end < start:
        raise ValueError("an empty range of pages")
    out = pages.where(F.col("page_index") >= start)
    return out if end < 0 else out.where(F.col("page_index") <= end)
