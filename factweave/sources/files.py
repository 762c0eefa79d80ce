"""Sources and sinks on files: JSON lines, raw texts in archives, and paged records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a claim, with the types they have on disk.
CLAIM = (
    "claim_id string, artifact_id string, subject_mention string, predicate string, object_mention string, observed_at string, valid_from string,"
    " valid_to string, confidence double, extraction_method string, evidence_span string, metadata map<string,string>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped.

    A broken line raises when ``strict``, else it is left out. The schema is never inferred.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not strict:
        parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
        return parsed.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line`` of the lines that are no JSON of the schema."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    read = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    return read.where("r is null or r._corrupt_record is not null").select("file", F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line, keys in order of their names."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_archives(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``archive, member, source, text`` of the text members of ZIP archives.

    ``source`` is the first part of the member's path; undecodable bytes are replaced. Members
    of one archive are read one after another by the task that holds it, so an archive has to
    fit a row; corpora come as many archives.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        rows.append((name.rsplit("/", 1)[-1], member, member.split("/", 1)[0], z.read(member).decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["archive", "member", "source", "text"])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(unpack, "archive string, member string, source string, text string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of every file, for checking a download or a frozen checkpoint."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
