"""A claim graph as versioned parquet tables: artifacts, claims, entities and the edges derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import contract
from factweave.operators.claims import OPEN_END, OPEN_START
from factweave.operators.resolution import stable_number

# Kinds of nodes, in the order of their numbers, and the longest evidence that is kept.
KINDS = ["Artifact", "Claim", "Entity", "Source"]
EVIDENCE = 200


class GraphStore:
    """Tables below ``root``, a folder that all executors share.

    A write makes a new version of a table in a folder of its own; readers take the last one
    that is complete, so they never see half a write, and a write that dies leaves no trace.
    Rows are kept by a key: a later write of a key replaces the row.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---------------------------------------------------------------- versions
    def _versions(self, name: str) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def read(self, name: str) -> DataFrame | None:
        """The current rows of a table; null if it was never written."""
        at = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/version={at[-1]}") if at else None

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Makes ``rows`` the whole table."""
        no = (self._versions(name) or [0])[-1] + 1
        rows.write.parquet(f"{self.root}/{name}/version={no}")
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Adds rows; those whose key is there already are replaced. Of equal keys in ``rows`` one stands."""
        order = F.to_json(F.struct(*rows.columns))
        new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
        old = self.read(name)
        if old is not None:
            new = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
        return self.replace(name, new)

    def remove(self, name: str, doomed: Column) -> int:
        """Drops the rows for which a condition holds; raises if any is left, returns how many went."""
        old = self.read(name)
        if old is None:
            return 0
        before = old.count()
        now = self.replace(name, old.where(~F.coalesce(doomed, F.lit(False))))
        if not now.where(doomed).isEmpty():
            raise RuntimeError(f"rows of {name} are left that should be gone")
        return before - now.count()

    def execute(self, statement: str, **values):
        """Rows of a SQL statement with parameters ``:name`` over the tables ``{artifacts}``, ``{claims}``, ``{entities}`` and ``{edges}``."""
        tables = {n: t for n in ("artifacts", "claims", "entities") if (t := self.read(n)) is not None}
        if "claims" in tables:
            tables["edges"] = self.edges()
        used = {n: t for n, t in tables.items() if "{" + n + "}" in statement}
        return self.spark.sql(statement, args=values or None, **used)

    # ---------------------------------------------------------------- loading
    def load_artifacts(self, artifacts: DataFrame) -> int:
        """Keeps ``artifacts(id, source, type, title, timestamp, content)`` with the length of their texts; returns how many are kept."""
        rows = artifacts.select("id", stable_number(F.lit("Artifact"), F.col("id"), KINDS).alias("number"), "source", "type", "title", "timestamp", F.length(F.coalesce("content", F.lit(""))).alias("content_length"))
        return self.upsert("artifacts", rows, "id").count()

    def load_entities(self, resolutions: DataFrame) -> int:
        """Keeps ``resolutions(entity_key, name, label, mentions, aliases)`` by key."""
        return self.upsert("entities", resolutions.select("entity_key", "name", "label", "mentions", "aliases"), "entity_key").count()

    def load_claims(self, claims: DataFrame, resolvable: DataFrame) -> dict[str, int]:
        """Gates ``claims``, keeps what passes as resolved nodes with closed periods, and reads back.

        The artifacts of the store are the known ones. Returns the number of claims per code and
        how many claims the store holds now. Nothing of a rejected claim is written.
        """
        there = self.read("artifacts")
        known = there.select("id", F.col("timestamp").alias("time"))
        gated = contract.gate(claims, resolvable, known)
        good, _ = contract.split(gated)
        times = known.groupBy(F.col("id").alias("artifact_id")).agg(F.max("time").alias("__t"))
        names = resolvable.groupBy(F.col("entity")).agg(F.min(F.trim("mention")).alias("n"), F.min("label").alias("l"))
        day = lambda c: F.left(F.nullif(c, F.lit("")), F.lit(10)).try_cast("date")
        r = good.join(times, "artifact_id", "left").withColumn("observed", F.coalesce(day("observed_at"), day("__t")))
        for side in ("subject", "object"):
            r = r.join(names.select(F.col("entity").alias(f"{side}_id"), F.col("n").alias(f"{side}_name"), F.col("l").alias(f"{side}_label")), f"{side}_id")
        start, end = day("valid_from"), day("valid_to")
        rows = r.select(
            "claim_id", stable_number(F.lit("Claim"), F.col("claim_id"), KINDS).alias("number"), "artifact_id", "subject_id", "subject_name", "subject_label", "predicate", "object_id", "object_name", "object_label", F.col("observed").alias("observed_at"),
            F.coalesce(start, F.when(end.isNotNull(), F.lit(OPEN_START).cast("date")), "observed").alias("valid_from"), F.coalesce(end, F.lit(OPEN_END).cast("date")).alias("valid_to"), "confidence", F.left("evidence_span", F.lit(EVIDENCE)).alias("evidence_span"),
        )
        kept = self.upsert("claims", rows, "claim_id")
        codes = {x["status"]: x["n"] for x in gated.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return codes | {"stored": kept.count()}

    # ---------------------------------------------------------------- reading
    def edges(self) -> DataFrame:
        """``src, dst, rel, valid_from, valid_to``: what the claims join, each claim with its own period."""
        c = self.read("claims")
        none = F.lit(None).cast("date")
        made = F.array(
            F.struct(F.col("claim_id").alias("src"), F.col("artifact_id").alias("dst"), F.lit("SOURCED_FROM").alias("rel"), none.alias("valid_from"), none.alias("valid_to")),
            F.struct(F.col("claim_id").alias("src"), F.col("object_id").alias("dst"), F.lit("ABOUT").alias("rel"), none.alias("valid_from"), none.alias("valid_to")),
            F.struct(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("predicate").alias("rel"), "valid_from", "valid_to"),
        )
        return c.select(F.explode(made).alias("e")).select("e.*").distinct()

    def claim(self, claim_id: str) -> DataFrame:
        return self.read("claims").where(F.col("claim_id") == claim_id)

    def numbered(self, name: str, first: int, last: int) -> DataFrame:
        """Rows whose number lies in a range, both ends included."""
        return self.read(name).where(F.col("number").between(first, last))

    def history(self, subject: str, predicate: str, object_: str) -> DataFrame:
        """Periods of one relation between two entities in time order; the predicate has to be a known one."""
        p = contract.guarded(predicate)
        return self.edges().where((F.col("src") == subject) & (F.col("dst") == object_) & (F.col("rel") == p)).orderBy("valid_from", "valid_to")

    def neighbourhood(self) -> DataFrame:
        """``entity_key, label, claims, outgoing, incoming`` of every entity, with those that no claim names."""
        c = self.read("claims")
        per = c.select(F.explode(F.array(F.struct(F.col("subject_id").alias("entity_key"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object_id").alias("entity_key"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        sums = per.groupBy("entity_key").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
        e = self.read("entities").select("entity_key", "label").join(sums, "entity_key", "left")
        return e.select("entity_key", "label", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))

    def wipe(self, entities: list[str]) -> int:
        """Drops all claims about some entities and the entities themselves; raises if one is left."""
        gone = self.remove("claims", F.col("subject_id").isin(entities) | F.col("object_id").isin(entities))
        self.remove("entities", F.col("entity_key").isin(entities))
        return gone

    def reset(self, first: int, last: int) -> int:
        """Drops the claims whose number lies in a range."""
        return self.remove("claims", F.col("number").between(first, last))
