"""JSON stores, logs and uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_USER = "struct<id:string,email:string,name:string,avatarUrl:string>"
_SESSION = f"struct<id:string,user:{_USER},createdAt:bigint,updatedAt:bigint,expiresAt:bigint>"
_PREMIUM = "struct<email:string,oneTimePasses:int,subscriptionExpiresAt:string,plan:string,productIds:array<string>,eventIds:array<string>,updatedAt:string>"
_EVENT = "struct<type:string,email:string,processedAt:string>"
UPLOAD_LIMIT = 50 * 1024 * 1024


def auth_store(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The maps of store files as tables ``sessions``, ``premium`` and ``webhook_events``; an unreadable store counts as empty.

    A file is one store, or with ``lines`` every line of it is one.
    """
    raw = spark.read.text(path, wholetext=not lines)
    store = raw.select(F.from_json("value", f"sessions map<string,{_SESSION}>, premiumByEmail map<string,{_PREMIUM}>, processedEvents map<string,{_EVENT}>").alias("s"))
    part = lambda name, key: store.select(F.explode(f"s.{name}").alias(key, "r")).select(key, *(f"r.{f}" for f in _fields(store, name) if f != key))
    return {"sessions": part("sessions", "id"), "premium": part("premiumByEmail", "email"), "webhook_events": part("processedEvents", "delivery_id")}


def usage_store(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``key, count, date`` of usage stores' JSON objects, one a file or with ``lines`` one a line; an unreadable store counts as empty."""
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,struct<count:int,date:string>>").alias("s"))
    return raw.select(F.explode("s").alias("key", "r")).select("key", "r.count", "r.date")


_LINE = "struct<text:string,x:double,y:double,width:double,height:double,baseline:double,natural_width:double,font_family:string,font_size:double,bold:boolean,color:string>"
_BOX = "struct<x:double,y:double,width:double,height:double,stroke:string,fill:string,stroke_width:double>"
_IMAGE = "struct<id:string,x:double,y:double,width:double,height:double,natural_w:int,natural_h:int>"
_CELL = "struct<row:int,col:int,row_span:int,col_span:int,text:string,font_family:string,font_size:double,bold:boolean,color:string,style:struct<stroke:string,fill:string>>"
_TABLE = f"struct<x:double,y:double,width:double,height:double,columns:array<double>,row_heights:array<double>,cells:array<{_CELL}>>"
#: The nested layout of documents: one JSON object a document, pages inside.
LAYOUT = f"doc_id bigint, unit string, pages array<struct<width:double,height:double,lines:array<{_LINE}>,boxes:array<{_BOX}>,images:array<{_IMAGE}>,tables:array<{_TABLE}>>>"


def layouts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Layout JSON as tables ``pages``, ``lines``, ``boxes``, ``images`` and ``cells``, by ``doc_id`` and ``page_index``; a column that no caller asks for isn't parsed."""
    pages = spark.read.schema(LAYOUT).json(path).select("doc_id", "unit", F.posexplode("pages").alias("page_index", "p"))
    on = ["doc_id", "page_index"]
    part = lambda name, seq: pages.select(*on, F.posexplode(f"p.{name}").alias(seq, "r")).select(*on, seq, "r.*")
    tables = part("tables", "table_seq")
    cells = tables.select(*on, "table_seq", F.explode("cells").alias("c")).select(*on, "table_seq", "c.*")
    return {"pages": pages.select(*on, "unit", "p.width", "p.height"), "lines": part("lines", "line_seq"), "boxes": part("boxes", "box_seq"), "images": part("images", "image_seq"), "tables": tables.drop("cells"), "cells": cells}


def write_layouts(pages: DataFrame, path: str) -> None:
    """Documents ``(doc_id, unit, pages)`` as layout JSON, one object a line; files follow the partitions."""
    pages.write.mode("overwrite").json(path)


#: An envelope of a webhook delivery; the body stays as it came, for its signature.
DELIVERY = "delivery_id string, sent string, signature string, body string"


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """Webhook envelopes as a stream of JSON lines in a folder."""
    return spark.readStream.schema(DELIVERY).json(path)


def _fields(store: DataFrame, name: str) -> list[str]:
    return store.schema["s"].dataType[name].dataType.valueType.names


def append_log(rows: DataFrame, path: str) -> None:
    """Rows at the end of a JSON-lines log."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def uploads(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "hwp", "hwpx", "docx", "odt", "epub", "md")) -> DataFrame:
    """Files of known kinds and of at most 50 MiB, by content sniffed."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(F.col("length") <= UPLOAD_LIMIT)
    return files.withColumn("kind", sniff(F.col("content")))


def sniff(content: Column) -> Column:
    """The container by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("504B0304"), "zip").when(head == "89504E470D0A1A0A", "png").when(head.startswith("25504446"), "pdf")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG file; null for others."""
    at = lambda i: F.when(sniff(content) == "png", F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int"))
    return at(17), at(21)


def numbered(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``number``, the first number of their name, to sort page images by."""
    return files.withColumn("number", F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)", 1).try_cast("int"))
