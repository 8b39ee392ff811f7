"""Citation records, examples and XML files as DataFrames. Schemas are declared, never inferred."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from citeloom.sources.storage import bound_batches

#: The fields of a citation record, all strings.
CITATION = "bibl string, quote string, xml_context string, filename string, urn string, ref string, n_attrib string, doc_cit_urn string"
EXAMPLE = "xml_context string, window_text string, filename string"


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of each JSON line and the file it is of; an empty urn is null, an absent quote ''."""
    rows = spark.read.schema(CITATION).json(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumn("urn", F.when(F.col("urn") != "", F.col("urn"))).withColumn("quote", F.coalesce("quote", F.lit("")))


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(context, filename) of the lines that have xml_context or window_text, and the lines that have neither."""
    rows = spark.read.schema(EXAMPLE).json(path).withColumn("file", F.col("_metadata.file_path"))
    context = F.coalesce("xml_context", "window_text")
    good = rows.where(context.isNotNull()).select(context.alias("context"), F.coalesce("filename", F.lit("")).alias("filename"), "file")
    return good, rows.where(context.isNull())


def read_contexts_numbered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, line from 1, context, filename) of the lines that parse, and (file, line, value) of those that don't.

    Line numbers come from the lines' order in their file: counts by block of the file are summed over blocks, so
    no task numbers a whole file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    rows = lines.withColumn("within", within).join(sizes, ["file", "block"]).withColumn("line", F.col("before") + F.col("within"))
    rows = rows.withColumn("x", F.from_json("value", EXAMPLE + ", _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("x").isNull() | F.col("x._corrupt_record").isNotNull()
    good = rows.where(~bad).select("file", "line", F.coalesce("x.xml_context", "x.window_text", F.lit("")).alias("context"), F.coalesce("x.filename", F.lit("unknown")).alias("filename"))
    return good, rows.where(bad).select("file", "line", "value")


def read_resolution(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bibl, ref, urn, quote) of the lines that have the first three, and the lines that lack one."""
    rows = spark.read.schema("bibl string, ref string, urn string, quote string").json(path)
    fine = F.col("bibl").isNotNull() & F.col("ref").isNotNull() & F.col("urn").isNotNull()
    rows = rows.withColumn("quote", F.coalesce("quote", F.lit("")))
    return rows.where(fine), rows.where(~fine)


#: Character sets that the decoder of column functions knows, by the names that declarations use.
NATIVE = {"UTF-8": "UTF-8", "UTF8": "UTF-8", "US-ASCII": "US-ASCII", "ASCII": "US-ASCII", "ISO-8859-1": "ISO-8859-1", "LATIN1": "ISO-8859-1", "UTF-16": "UTF-16", "UTF-16LE": "UTF-16", "UTF-16BE": "UTF-16", "UTF-32": "UTF-32"}


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Other character sets; null for one that is unknown."""

    def one(data: bytes | None, name: str) -> str | None:
        try:
            return None if data is None else data.decode(name, "replace")
        except LookupError:
            return None

    return pd.Series([one(*x) for x in zip(content, charset)], dtype=object)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file in tar archives, a batch for each archive."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            # Padding may be a whole block of zeros, which would end the archive.
            with tarfile.open(fileobj=io.BytesIO(content.as_py()), ignore_zeros=True) as archive:
                held = [(f"{path}/{member.name}", archive.extractfile(member).read()) for member in archive if member.isfile()]
            yield pa.record_batch([pa.array([x[k] for x in held], kind) for k, kind in enumerate((pa.string(), pa.binary()))], ["path", "content"])


def read_xml_corpus(spark: SparkSession, path: str | list[str], glob: str = "*.xml", archives: bool = False) -> DataFrame:
    """filename, text, charset of every file: decoded by the charset that its XML declaration names, else as UTF-8.

    A file that begins with a byte order mark is UTF-16 or UTF-8 by that. Of an unknown charset text is null. archives:
    what is read are tar archives, and each file in one of them is a row; an archive is opened by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    if archives:
        bound_batches(spark)
        files = files.mapInArrow(_members, files.schema)
    mark = F.hex(F.substring("content", 1, 4))
    head = F.replace(F.decode(F.substring("content", 1, 400), "ISO-8859-1"), F.lit("\x00"), F.lit(""))
    name = F.upper(F.regexp_extract(head, r"""^[^<]{0,4}\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["']""", 1))
    name = F.when(mark.rlike("^(0000FEFF|FFFE0000)"), "UTF-32").when(mark.rlike("^(FEFF|FFFE)"), "UTF-16").when(mark.startswith("EFBBBF") | (name == ""), "UTF-8").otherwise(name)
    rows = files.select(F.col("path").alias("filename"), "content", name.alias("charset"))
    native = F.element_at(F.create_map(*(F.lit(x) for pair in NATIVE.items() for x in pair)), F.col("charset"))
    text = F.lit(None).cast("string")
    for known in sorted(set(NATIVE.values())):
        text = F.when(native == known, F.decode("content", known)).otherwise(text)
    other = _decoded(F.when(native.isNull(), F.col("content")), F.col("charset"))
    return rows.select("filename", F.regexp_replace(F.coalesce(text, other), "^\ufeff", "").alias("text"), "charset")
