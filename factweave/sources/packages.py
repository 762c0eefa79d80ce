"""Sets of files that belong together: corpora, manifests, downloads, pairs and gold packages."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.records import raw_artifacts
from factweave.sources import files

# Labels of pairs, names of features that are written in two ways, files of a gold package.
LABELS = ["SAME_ENTITY", "DIFFERENT_ENTITY", "UNCERTAIN"]
FEATURE_NAMES = {"cooccurrence": "cooccurrence_score"}
GOLD = {
    "artifacts": "id string, source string, title string, content string", "mentions": "artifact_id string, raw_text string, type string, source_identity string, notes string",
    "claims": "artifact_id string, subject string, subject_type string, predicate string, object string, object_type string, evidence_span string, observed_at string, valid_from string, valid_to string, status string, notes string",
    "ambiguities": "artifact_id string, status string, notes string",
}


# ---------------------------------------------------------------- corpora
def corpus(spark: SparkSession, mode: str, path: str) -> DataFrame:
    """``artifact_id, source, title, content`` of a corpus: ``sample`` (JSON lines) or ``full`` (ZIP archives of raw files)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    if mode == "sample":
        rows = files.read_jsonl(spark, path, "id string, source string, title string, content string")
        return rows.select(F.col("id").alias("artifact_id"), blank("source"), blank("title"), blank("content"))
    if mode == "full":
        raw = files.read_archives(spark, path).select("source", F.col("member").alias("path"), "text")
        return raw_artifacts(raw).select(F.col("id").alias("artifact_id"), "source", blank("title"), blank("content"))
    raise ValueError(f"unknown corpus mode {mode!r}")


def folder_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of the raw text files below a folder, whose last part names the source; files that are none are left out."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw_artifacts(found.select(F.element_at(F.split("path", "/"), -2).alias("source"), "path", "text"))


# ---------------------------------------------------------------- manifests and downloads
def assets(spark: SparkSession, manifest: str) -> DataFrame:
    """``name, url, sha256, bytes`` of a manifest (a JSON object with a list ``assets``)."""
    j = spark.read.option("multiLine", "true").schema("assets array<struct<name:string,url:string,sha256:string,bytes:bigint>>").json(manifest)
    return j.select(F.explode("assets").alias("a")).select("a.*")


def slices(manifest: DataFrame, source: str) -> DataFrame:
    """The slices of a source, by name."""
    return manifest.where(F.col("name").startswith(f"{source}_slice_")).orderBy("name")


def download(open_: Callable[[str], Iterator[bytes]], url: str, to: str, sha256: str | None) -> str:
    """Fetches a file in pieces beside its place, checks it and moves it there; a file of another sum is deleted and raises.

    A file that is there with the right sum is not fetched again. ``open_`` gives the pieces.
    """
    def summed(path: str) -> str:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                h.update(piece)
        return h.hexdigest()

    if os.path.exists(to) and (sha256 is None or summed(to) == sha256):
        return to
    part = f"{to}.part"
    with open(part, "wb") as f:
        for piece in open_(url):
            f.write(piece)
    if sha256 is not None and summed(part) != sha256:
        os.remove(part)
        raise ValueError(f"{url} has another checksum")
    os.replace(part, to)
    return to


# ---------------------------------------------------------------- pairs
_SIDE = "mention string, type string, emails array<string>, usernames array<string>, external_ids array<string>, sources array<string>"
_FEATURES = "features map<string,double>"
FLAT = "pair_id string, " + ", ".join(f"mention_{s} string, type_{s} string, source_{s} string, emails_{s} array<string>, usernames_{s} array<string>, external_ids_{s} array<string>" for s in "ab") + f", label string, {_FEATURES}, notes string"


def read_pairs(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Identity pairs of JSON lines, sides flat (``mention_a``) or nested (``a.mention``), in the flat form.

    Missing lists are empty, a missing type is ``person``, a missing label ``UNCERTAIN``; of
    several sources the first stands; features get the names of the flat form.
    """
    none = F.array().cast("array<string>")
    if nested:
        side = f"struct<{_SIDE.replace(' ', ':').replace(',:', ',')}>"
        r = files.read_jsonl(spark, path, f"pair_id string, a {side}, b {side}, label string, {_FEATURES}, label_rationale string")
        for s in "ab":
            r = r.withColumns({f"{c}_{s}": F.col(f"{s}.{c}") for c in ("mention", "type", "emails", "usernames", "external_ids")} | {f"source_{s}": F.try_element_at(F.col(f"{s}.sources"), F.lit(1))})
        r = r.withColumn("notes", F.col("label_rationale"))
    else:
        r = files.read_jsonl(spark, path, FLAT)
    rename = F.create_map(*[x for k, v in FEATURE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    features = F.transform_keys(F.coalesce("features", F.create_map().cast("map<string,double>")), lambda k, v: F.coalesce(F.try_element_at(rename, k), k))
    lists = {f"{c}_{s}": F.coalesce(f"{c}_{s}", none) for c in ("emails", "usernames", "external_ids") for s in "ab"}
    names = [x.split()[0] for x in FLAT.split(", ")]
    return r.withColumns(lists | {f"type_{s}": F.coalesce(f"type_{s}", F.lit("person")) for s in "ab"} | {"label": F.coalesce("label", F.lit("UNCERTAIN")), "features": features, "notes": F.coalesce("notes", F.lit(""))}).select(*names)


def pair_problems(pairs: DataFrame) -> DataFrame:
    """Adds ``problems``: a missing mention, an unknown label, a feature outside 0 and 1."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    odd = F.exists(F.map_values("features"), lambda v: (v < 0) | (v > 1))
    rules = {"mention_a": blank("mention_a"), "mention_b": blank("mention_b"), "label": ~F.coalesce(F.col("label").isin(LABELS), F.lit(False)), "features": F.coalesce(odd, F.lit(False))}
    return pairs.withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


# ---------------------------------------------------------------- gold packages
def write_gold(spark: SparkSession, root: str, manifest: dict, tables: dict[str, DataFrame]) -> None:
    """Writes a package: a manifest and one set of JSON lines per table."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest.json")
    for name in GOLD:
        files.write_jsonl(tables[name], f"{root}/{name}.jsonl")


def read_gold(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and tables of a package."""
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json").limit(10_000).collect())
    return json.loads(text), {name: files.read_jsonl(spark, f"{root}/{name}.jsonl", schema) for name, schema in GOLD.items()}


def gold_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """``problem, rows``: mentions, claims and ambiguities of artifacts that the package lacks, claims whose evidence is not in their text."""
    a = tables["artifacts"].select(F.col("id").alias("artifact_id"), "content").dropDuplicates(["artifact_id"])
    found = [tables[n].join(a, "artifact_id", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"orphan {n}").alias("problem"), "rows") for n in ("mentions", "claims", "ambiguities")]
    span = tables["claims"].join(a, "artifact_id").where((F.coalesce("evidence_span", F.lit("")) != "") & ~F.coalesce(F.col("content").contains(F.col("evidence_span")), F.lit(False)))
    found.append(span.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("evidence not in text").alias("problem"), "rows"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.where("rows > 0")
