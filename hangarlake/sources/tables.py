"""Readers and writers by suffix, with the guards that tables are held to."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hangarlake.session import cut


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """csv, tsv, json, jsonl, parquet, orc or text by suffix; csv columns are text unless a schema says otherwise.

    An unknown suffix is a ValueError; a missing path is Spark's own error. Empty
    csv fields stay empty strings, never nulls.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",")
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
        return trimmed_names(df).na.fill("")
    if kind in ("json", "jsonl"):
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if kind in ("parquet", "orc", "text", "txt"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.format("text" if kind == "txt" else kind).load(path)
    raise ValueError(f"no reader for the suffix {kind!r}")


def trimmed_names(df: DataFrame) -> DataFrame:
    """Column names without blanks and byte-order mark; two that fall together are a ValueError."""
    names = [c.strip().lstrip("﻿").strip() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns that fall together when trimmed: {', '.join(twice)}")
    return df.toDF(*names)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """csv, json, jsonl, parquet or orc by suffix; csv gets nested columns as JSON. Spark's committer makes the write atomic."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    writer = df
    if kind in ("csv", "tsv"):
        writer = flattened(df)
    out = writer.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        out.option("header", True).option("escape", '"').option("emptyValue", "").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "jsonl"):
        out.json(path)
    elif kind in ("parquet", "orc"):
        out.format(kind).save(path)
    else:
        raise ValueError(f"no writer for the suffix {kind!r}")


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns])


def unwrapped(df: DataFrame, names: tuple[str, ...] = ("predictions", "records", "cases")) -> DataFrame:
    """The rows within an envelope column, if the table has one."""
    for name in names:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            return df.select(F.explode(name).alias("_r")).select("_r.*")
    return df


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: the sum of the rows' own, so it is one aggregation."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
    return f"{total['n']}-{total['s'] or 0}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def zipped(left: DataFrame, right: DataFrame, order: str, right_order: str | None = None, equal: tuple[str, str] | None = None) -> DataFrame:
    """Two tables of equal length side by side, by the place in each one's order; lengths are checked, and so are two columns that must agree.

    Places come from partition offsets, not from one sorted task.
    """
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} rows can't be zipped")
    second = numbered(right, right_order or order)
    rows = numbered(left, order).join(second if right_order else second.drop(order), "_place").drop("_place")
    if equal and not rows.filter(~F.col(equal[0]).eqNullSafe(F.col(equal[1]))).isEmpty():
        raise ValueError(f"{equal[0]} and {equal[1]} don't agree")
    return rows


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their place in an order: partition counts first, then each partition's own offset."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.withColumn("_offset", offset).select("_p", "_offset", "_first")), "_p").withColumn("_place", F.col("_offset") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_offset", "_first")


def json_safe(df: DataFrame) -> DataFrame:
    """Floating-point columns with NaN and infinities as null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    bad = lambda c: F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def represented(df: DataFrame, key: str, text: str, forms: dict, name: str) -> DataFrame:
    """(key, text, representation) in one of several forms; a form is unknown or changes the set of ids: ValueError."""
    if name not in forms:
        raise ValueError(f"no representation {name!r}; there are {', '.join(sorted(forms))}")
    rows = df.select(key, forms[name](F.col(text)).alias("text"), F.lit(name).alias("representation"))
    if not df.select(key).exceptAll(rows.filter("text is not null").select(key)).isEmpty():
        raise ValueError(f"the representation {name!r} has other ids than the raw one")
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, shown: int = 20) -> DataFrame:
    """JSON lines of one or many files; rows that don't parse are a ValueError that names the first files and lines.

    The check is one pass over the files. Lines are counted only in the files that have bad ones, and only until enough were found.
    """
    kind = spark.createDataFrame([], schema).schema
    marked = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter("trim(value) <> ''")
    rows = lines.select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    bad = [r[0] for r in rows.filter("_r._bad is not null").select("_file").distinct().orderBy("_file").limit(shown).collect()]
    if bad:
        found = []
        for file in bad:
            for number, row in enumerate(spark.read.text(file).coalesce(1).toLocalIterator(), 1):
                try:
                    json.loads(row[0] or "null")
                except ValueError as error:
                    found.append(f"{file}:{number}: {error}")
                if len(found) >= shown:
                    break
            if len(found) >= shown:
                break
        raise ValueError("; ".join(found) or "rows that don't fit the schema")
    return rows.select(*[F.col(f"_r.{c.name}") for c in kind])


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one GraphML file on the driver's disk: (id, label) and (source, target, label), row by row, never whole in memory."""
    with open(path, "w", encoding="utf-8") as file:
        file.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="label" for="all" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n')
        data = lambda v: f'<data key="label">{quoteattr(v or "")[1:-1]}</data>'
        for row in nodes.select("id", "label").orderBy("id").toLocalIterator():
            file.write(f"<node id={quoteattr(row[0])}>{data(row[1])}</node>\n")
        for row in edges.select("source", "target", "label").orderBy("source", "target", "label").toLocalIterator():
            file.write(f"<edge source={quoteattr(row[0])} target={quoteattr(row[1])}>{data(row[2])}</edge>\n")
        file.write("</graph>\n</graphml>\n")


def write_versioned(df: DataFrame, folder: str, name: str, run: str) -> list[str]:
    """A result under its run, which is never written twice, and under its plain name, which is the latest; the paths."""
    kept, latest = f"{folder}/archive/{name}__{run}.parquet", f"{folder}/{name}.parquet"
    write_table(df, kept)
    write_table(df.sparkSession.read.parquet(kept), latest, "overwrite")
    return [kept, latest]
