"""What claims, mentions and outputs have to satisfy: contract rules, pair rules, the load gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import is_blank

# Predicates, types of mentions, methods, and the forms of ids and times.
PREDICATES = ["OWNS", "MAINTAINS", "LEADS", "ASSIGNED_TO", "BLOCKS", "DEPENDS_ON", "REVIEWS"]
MENTION_TYPES = ["person", "project", "account", "ticket", "email", "username", "org"]
METHODS = ["deterministic", "llm", "hybrid", "hand-written"]
CLAIM_ID = r"^(claim:[A-Za-z0-9_-]+|[0-9a-f]{16})$"
MENTION_ID = r"^(mention:[A-Za-z0-9_-]+|[0-9a-f]{16})$"
ARTIFACT_ID = r"^(dsid_[0-9a-f]{32}|artifact:[A-Za-z0-9_-]+)$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
# What a predicate may join, of the loaded graph; extraction knows the same but no work items.
PAIRS = """
OWNS: Person Account, Person Project
MAINTAINS: Person Account, Person Project, Person Service, Team Service
LEADS: Person Account, Person Project, Person Team
ASSIGNED_TO: Person Account, Person Project
REVIEWS: Person Account, Person Project
BLOCKS: Person Project, Project Project
DEPENDS_ON: Project Project, Project Service, Service Service
"""
NOT_EXTRACTED = ["BLOCKS", "DEPENDS_ON"]
# What is no entity in a text, and the least confidence of an extracted claim.
NO_ENTITY = ["she", "he", "they", "we", "our", "their", "his", "her", "it", "this", "that", "team", "owner", "purpose", "action", "typical initial role", "widget", "description", "the", "and", "for", "with"]
LEAST_CONFIDENCE = 0.70
# Words of headers and quotations, which no mention holds.
HEADER_WORDS = ["subject:", "wrote:", "from:", "to:", "cc:"]


def pair_rules(extraction: bool = False) -> list[tuple[str, str, str]]:
    """``(predicate, subject label, object label)`` of every allowed pair."""
    rows = []
    for line in PAIRS.strip().splitlines():
        predicate, _, pairs = line.partition(":")
        if not (extraction and predicate in NOT_EXTRACTED):
            rows += [(predicate, *pair.split()) for pair in pairs.split(",")]
    return rows


def pair_supported(predicate: Column, subject: Column, object_: Column, extraction: bool = False) -> Column:
    """Whether a predicate may join two labels; false for nulls."""
    key = F.concat_ws(" ", *[F.coalesce(c, F.lit("?")) for c in (predicate, subject, object_)])
    return key.isin([" ".join(r) for r in pair_rules(extraction)])


def real_iso(c: Column) -> Column:
    """Whether a text is an ISO day or time that exists; null for null."""
    clock = [F.substring(c, at, 2).try_cast("int") <= most for at, most in ((12, 23), (15, 59), (18, 59))]
    there = F.left(c, F.lit(10)).try_cast("date").isNotNull()
    return F.when(c.isNotNull(), c.rlike(ISO_TIME) & there & F.coalesce(clock[0], F.lit(True)) & F.coalesce(clock[1], F.lit(True)) & F.coalesce(clock[2], F.lit(True)))


def _fits(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _first(rules: dict[str, Column], otherwise: str | None) -> Column:
    """Name of the first rule that is broken."""
    out = None
    for name, broken in rules.items():
        out = F.when(F.coalesce(broken, F.lit(False)), name) if out is None else out.when(F.coalesce(broken, F.lit(False)), name)
    return out.otherwise(F.lit(otherwise))


def _all(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items()]))


def claim_rules() -> dict[str, Column]:
    """Broken rules of a claim, in the order in which they are named. Nulls break what needs a value."""
    c = F.col
    times = {t: ~real_iso(c(t)) for t in ("observed_at", "valid_from", "valid_to")}
    return {
        "claim_id": ~_fits(c("claim_id"), CLAIM_ID), "artifact_id": ~_fits(c("artifact_id"), ARTIFACT_ID),
        "subject_mention": is_blank(c("subject_mention")), "predicate": ~F.coalesce(c("predicate").isin(PREDICATES), F.lit(False)), "object_mention": is_blank(c("object_mention")),
        **times, "period": F.left(c("valid_to"), F.lit(10)) < F.left(c("valid_from"), F.lit(10)),
        "confidence": ~F.coalesce(c("confidence").between(0, 1), F.lit(False)), "extraction_method": is_blank(c("extraction_method")), "evidence_span": is_blank(c("evidence_span")),
    }


def mention_rules() -> dict[str, Column]:
    """Broken rules of a mention; see ``claim_rules``."""
    c = F.col
    return {
        "mention_id": ~_fits(c("mention_id"), MENTION_ID), "artifact_id": ~_fits(c("artifact_id"), ARTIFACT_ID), "raw_text": is_blank(c("raw_text")),
        "type": ~F.coalesce(c("type").isin(MENTION_TYPES), F.lit(False)), "source": F.coalesce(c("source"), F.lit("")) == "", "context": c("context").isNull(),
        "span_start": ~F.coalesce(c("span_start") >= 0, F.lit(False)), "span_end": ~F.coalesce(c("span_end") > F.greatest(c("span_start"), F.lit(-1)), F.lit(False)),
        "extraction_method": is_blank(c("extraction_method")), "confidence": ~F.coalesce(c("confidence").between(0, 1), F.lit(False)),
    }


def problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``problems``, the names of all broken rules; a row without any is valid."""
    return rows.withColumn("problems", _all(rules))


def duplicate_ids(rows: DataFrame, id_: str = "claim_id") -> DataFrame:
    """``id, copies`` of the ids that stand on more than one row."""
    return rows.groupBy(id_).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def loaded(rows: DataFrame, rules: dict[str, Column], id_: str) -> tuple[DataFrame, DataFrame]:
    """The rows that keep the contract and whose id is their own, and the rejected ones with a ``reason``.

    A null id counts as broken by the rules; of rows that share an id none is loaded.
    """
    often = duplicate_ids(rows, id_).select(F.col(id_).alias("__id"), F.lit(True).alias("__twice"))
    seen = problems(rows, rules).join(often, F.col(id_) == F.col("__id"), "left")
    reason = F.when(F.size("problems") > 0, F.array_join("problems", ",")).when(F.col("__twice"), "duplicate")
    marked = seen.withColumn("reason", reason)
    return marked.where("reason is null").select(*rows.columns), marked.where("reason is not null").select(*rows.columns, "reason")


# ---------------------------------------------------------------- the load gate
def gate(claims: DataFrame, resolvable: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds ``status``, the first code that applies or ``PASS``, ``subject_id``, ``object_id`` and ``timestamp_source``.

    ``resolvable(mention, entity, label)`` says what a trimmed mention means; one that means
    several entities means none. ``artifacts(id, time)`` are the known artifacts. The codes are
    tried in this order: ids, blank subject, blank object, predicate, unreadable times or a
    period that runs backwards, no time at all, unknown artifact, subject and object that mean
    nothing, a pair that the predicate may not join, any other rule of the contract. Extra
    columns stay; nulls lead to the code of their field.
    """
    known = resolvable.groupBy(F.trim("mention").alias("m")).agg(F.min("entity").alias("e"), F.count_distinct("entity").alias("k"), F.min("label").alias("l")).where("k = 1")
    there = artifacts.groupBy(F.col("id").alias("__aid")).agg(F.max("time").alias("__atime"))
    for side in ("subject", "object"):
        named = known.select(F.col("m").alias(f"__{side}_m"), F.col("e").alias(f"{side}_id"), F.col("l").alias(f"__{side}_l"))
        claims = claims.join(named, F.trim(f"{side}_mention") == F.col(f"__{side}_m"), "left")
    joined = claims.join(there, F.col("artifact_id") == F.col("__aid"), "left")
    rules = claim_rules()
    untimed = (F.coalesce("observed_at", F.lit("")) == "") & (F.coalesce("__atime", F.lit("")) == "")
    status = _first({
        "MALFORMED_ID": rules["claim_id"] | rules["artifact_id"], "INVALID_SUBJECT": rules["subject_mention"], "INVALID_OBJECT": rules["object_mention"], "INVALID_PREDICATE": rules["predicate"],
        "INVALID_TIMESTAMP": F.coalesce(rules["observed_at"], F.lit(False)) | F.coalesce(rules["valid_from"], F.lit(False)) | F.coalesce(rules["valid_to"], F.lit(False)) | F.coalesce(rules["period"], F.lit(False)),
        "MISSING_TIMESTAMP": untimed, "MISSING_ARTIFACT": F.col("__aid").isNull(),
    }, None)
    rest = _first({
        "INVALID_SUBJECT": F.col("__subject_m").isNull(), "INVALID_OBJECT": F.col("__object_m").isNull(),
        "UNSUPPORTED_ENTITY_PAIR": ~pair_supported(F.col("predicate"), F.col("__subject_l"), F.col("__object_l")),
        "CONTRACT_VIOLATION": rules["confidence"] | rules["extraction_method"] | rules["evidence_span"],
    }, "PASS")
    out = joined.withColumn("status", F.coalesce(status, rest))
    source = F.when(F.col("status") == "PASS", F.when(F.coalesce("observed_at", F.lit("")) != "", "claim").otherwise("artifact"))
    return out.withColumn("timestamp_source", source).drop(*[c for c in out.columns if c.startswith("__")])


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be loaded, and what is rejected with its code."""
    return gated.where("status = 'PASS'"), gated.where("status <> 'PASS'")


# ---------------------------------------------------------------- shapes and outputs
def is_entity(text: Column) -> Column:
    """Whether a text found by a pattern can be an entity: three characters, no pronoun or filler."""
    t = F.trim(text)
    return F.coalesce((F.length(t) >= 3) & ~F.lower(t).isin(NO_ENTITY), F.lit(False))


def is_mention_shaped(text: Column) -> Column:
    """Whether a text is short, of one line and at most eight words, and no piece of a header."""
    t = F.trim(F.coalesce(text, F.lit("")))
    headers = F.lit(False)
    for word in HEADER_WORDS:
        headers = headers | F.lower(t).contains(word)
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[\n\r]") & ~headers & (F.size(F.split(t, r"\s+")) <= 8)


def own_ids(ids: Column, mention: Column) -> Column:
    """External ids that are more than the mention itself."""
    same = lambda x: F.lower(F.trim(x)) == F.lower(F.trim(mention))
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: ~same(x))


def output_problems(rows: DataFrame, artifacts: DataFrame, id_: str, parts: list[str], hash_, allowed: dict[str, list[str]]) -> DataFrame:
    """``problem, rows``: how often an extracted row is an orphan, misnamed, out of range or repeated.

    ``id_`` is recomputed from ``parts`` by ``hash_``; ``allowed`` lists the values of columns.
    """
    there = artifacts.select(F.col("id").alias("__aid")).distinct().withColumn("__in", F.lit(True))
    often = duplicate_ids(rows, id_).select(F.col(id_).alias("__id"), (F.col("copies") - 1).alias("__more"))
    seen = rows.join(there, F.col("artifact_id") == F.col("__aid"), "left")
    rules = {
        "orphan": F.col("__in").isNull(), "artifact_id": ~_fits(F.col("artifact_id"), r"^dsid_[0-9a-f]{32}$"), "id": ~F.coalesce(F.col(id_) == hash_(*[F.col(p) for p in parts]), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), **{c: ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in allowed.items()},
    }
    found = seen.select(F.explode(_all(rules)).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))
    repeated = often.agg(F.sum("__more").alias("rows")).where("rows is not null").select(F.lit("duplicate").alias("problem"), F.col("rows").cast("long").alias("rows"))
    return found.unionByName(repeated)


def refined(predicate: Column, confidence: Column, allowed: Column) -> Column:
    """A model's proposal, or ``ABSTAIN`` where it is none of the allowed predicates or without a confidence in [0, 1]."""
    p = F.upper(F.trim(predicate))
    return F.when(F.coalesce(F.array_contains(allowed, p) & confidence.between(0, 1), F.lit(False)), p).otherwise("ABSTAIN")


def guarded(predicate: str) -> str:
    """The predicate, if it is one; it may then stand in a statement."""
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}")
    return predicate
