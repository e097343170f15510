"""One report document, published whole.

The sections of a report become one nested JSON document in a new version folder.  When it is written, and not before, a
manifest that names the version takes the place of the one before in a single rename: a reader finds the old report or
the new one, whatever fails in between, and never sections of both.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlog.plans.reports import Sections

MANIFEST, KEPT = "manifest.json", 2


def document(sections: Sections) -> DataFrame:
    """(value): one JSON object with a list of rows for each section, in the section's order.

    A document is one row: sections are report rows, such as the leading rules or the counts per day.  Larger results belong
    into folders of their own, see reports.write_sections.
    """
    lines = None
    for number, (name, section) in enumerate(sections.items()):
        row = F.to_json(F.struct(*section.columns), {"ignoreNullFields": "false"})
        line = section.select(
            F.lit(number).alias("number"), F.lit(json.dumps(name)).alias("name"), F.monotonically_increasing_id().alias("place"),
            row.alias("row"),
        )
        lines = line if lines is None else lines.unionByName(line)
    if lines is None:
        raise ValueError("a report has sections")
    named = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(json.dumps(n)).alias("name")) for i, n in enumerate(sections)])
    every = lines.sparkSession.range(1).select(F.inline(named))  # sections without rows too
    rows = lines.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    rows = every.join(rows, "number", "left")
    listed = F.array_join(F.coalesce(F.col("rows")["row"], F.array().cast("array<string>")), ",")
    texts = rows.select("number", F.concat("name", F.lit(":["), listed, F.lit("]")).alias("text"))
    whole = F.array_sort(F.collect_list(F.struct("number", "text")))["text"]
    return texts.agg(F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}")).alias("value"))


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another in one step."""
    target, files = _files(spark, path)
    made, _ = _files(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(made, target, options)


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What is published in ``folder``: version, created, sections; None if nothing is."""
    path, files = _files(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not files.exists(path):
        return None
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])


def publish(sections: Sections, folder: str, created: str) -> str:
    """Write the document of a report and then its manifest; returns the version.

    ``created``, the time of the report, is given, so that results can be repeated.  The version published before stays for
    readers that have begun; older ones go.
    """
    folder, version = folder.rstrip("/"), uuid.uuid4().hex
    text = document(sections)
    spark = text.sparkSession
    before = manifest(spark, folder)
    text.coalesce(1).write.text(f"{folder}/versions/{version}")
    kept = [version, *(before["kept"] if before else [])][:KEPT]
    found = {"version": version, "created": created, "sections": list(sections), "kept": kept}
    _replace(spark, f"{folder}/{MANIFEST}", json.dumps(found))
    for old in (before["kept"] if before else [])[KEPT - 1 :]:
        path, files = _files(spark, f"{folder}/versions/{old}")
        files.delete(path, True)
    return version


def read_section(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a section of the published document, with its place in the section."""
    found = manifest(spark, folder)
    if found is None or name not in found["sections"]:
        raise ValueError(f"no section {name!r} is published in {folder}")
    text = spark.read.text(f"{folder.rstrip('/')}/versions/{found['version']}", wholetext=True)
    rows = F.from_json("value", f"struct<`{name}`: array<struct<{schema}>>>")[name]
    return text.select(F.posexplode(rows).alias("place", "row")).select("place", "row.*")
