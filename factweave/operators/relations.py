"""Relations of people and accounts: hand-overs with effective dates, and families of signals per artifact."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.claims import short_hash
from factweave.operators.contract import pair_rules, refined

# What hands an account over. Pattern, group of the account, and whose it becomes.
_ACCOUNT, _NAME, _EDGE = r"([A-Z][A-Za-z0-9-]+)", r"([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)?)", r"(?<![\w@.])"
HANDOFFS = [
    (rf"{_EDGE}(?i:still own) {_ACCOUNT}", 1, "author"), (rf"{_EDGE}(?i:taking over) {_ACCOUNT}", 1, "author"), (rf"{_EDGE}(?i:handing off) {_ACCOUNT}", 1, "author"),
    (rf"{_EDGE}{_NAME}[ \t]+owns[ \t]+{_ACCOUNT}\b", 2, "named"), (rf"{_EDGE}{_NAME}[ \t]+is taking over[ \t]+{_ACCOUNT}\b", 2, "named"),
    (rf"{_EDGE}([\w.+-]+)@[\w-]+(?:\.[\w-]+)+[ \t]+owns[ \t]+{_ACCOUNT}\b", 2, "named"), (rf"{_EDGE}@([A-Za-z0-9_.-]+)[ \t]+owns[ \t]+{_ACCOUNT}\b", 2, "named"),
]
TRANSFER = r"\b([A-Z][\w-]+(?: [A-Z][\w-]+){0,2}?)[ \t]+(?:ownership[ \t]+)?(?:transfers?|transferred|is transferred|is being transferred|moves?|moved)[ \t]+from[ \t]+([A-Z][a-z]+(?: [A-Z][a-z]+)?)[ \t]+to[ \t]+([A-Z][a-z]+(?: [A-Z][a-z]+)?)"
# Phrases that date a hand-over, and how far from its observation a day without a year may lie.
_DAY = r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})(?:st|nd|rd|th)?(?:\s*,\s*(20\d{2}))?"
EFFECTIVE, UNTIL = rf"(?i)\b(?:effective|starting|beginning|as of|from)\s+{_DAY}", rf"(?i)\b(?:until|through|till|by)\s+{_DAY}"
BEFORE, AFTER = -7, 45
HANDOFF_CONFIDENCE = 0.85


# ---------------------------------------------------------------- effective dates
def _said(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Month, day and year (null if not said) of the first phrase."""
    month, day, year = (F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, g), F.lit("")) for g in (1, 2, 3))
    number = F.month(F.to_date(F.concat(F.initcap(F.left(month, F.lit(3))), F.lit(" 1 2000")), "MMM d yyyy"))
    return number, day.try_cast("int"), year.try_cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _near(observed: Column, month: Column, day: Column) -> Column:
    """The day in the year of the observation, if it lies near enough to it."""
    at = _day(F.year(observed), month, day)
    return F.when(F.datediff(at, observed).between(BEFORE, AFTER), at)


def anchors(artifacts: DataFrame) -> DataFrame:
    """``account, year``: the year that the first artifact of an account gives to its undated days.

    ``artifacts(account, observed, content, ordinal)``, a row per account of an artifact.
    """
    rows = artifacts.select(F.lower("account").alias("account"), "ordinal", F.col("observed"), F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(_said(F.col("content"), p), "mdy")]) for p in (EFFECTIVE, UNTIL)])).alias("x"))
    met = rows.where("x.y is null and x.m is not null").where(_near(F.col("observed"), F.col("x.m"), F.col("x.d")).isNotNull())
    return met.groupBy("account").agg(F.min_by(F.year("observed"), "ordinal").alias("year"))


def effective_dates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``effective`` and ``until`` to ``rows(account, observed, content)``.

    A stated year stands; else the day in the year of the observation, if near; else in the year
    that another artifact gives the account (``known``, see ``anchors``); else null: a year is
    never guessed.
    """
    years = known.select(F.col("account").alias("__a"), F.col("year").alias("__y"))
    met = rows.join(years, F.lower("account") == F.col("__a"), "left")

    def resolved(pattern: str) -> Column:
        m, d, y = _said(F.col("content"), pattern)
        return F.coalesce(_day(y, m, d), F.when(y.isNull(), F.coalesce(_near(F.col("observed"), m, d), _day(F.col("__y"), m, d))))

    return met.withColumns({"effective": resolved(EFFECTIVE), "until": resolved(UNTIL)}).drop("__a", "__y")


def validity(evidence: Column, effective: Column, until: Column) -> tuple[Column, Column]:
    """Start and end by the verb: who hands off ends with the effective day, who takes over begins with it, who still owns ends with the other."""
    e = F.lower(evidence)
    off, over, still = e.contains("handing off") | e.contains("handing over"), e.contains("taking over"), e.contains("still own")
    return F.when(off | (still & ~over), None).otherwise(effective), F.when(off, effective).when(~over & still, until)


# ---------------------------------------------------------------- hand-overs
def handoffs(artifacts: DataFrame) -> DataFrame:
    """Claims that hand-overs of ``artifacts(id, author, observed, content)`` make, each once.

    A transfer makes two: the one who had it until the effective day, the one who has it from
    then. Columns ``artifact_id, subject_mention, object_mention, evidence, role`` where
    ``role`` is ``holds``, ``gives`` or ``takes``. Without an author nobody hands over.
    """
    parts = []
    for pattern, group, whose in HANDOFFS:
        at = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(f"(?U){pattern}"), F.lit(g)).alias(n) for g, n in ((0, "e"), (1, "s"), (group, "o"))])
        parts.append(F.transform(at, _holder(whose)))
    moved = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(f"(?U){TRANSFER}"), F.lit(g)).alias(n) for g, n in ((0, "e"), (1, "o"), (2, "a"), (3, "b"))])
    both = F.flatten(F.transform(moved, lambda x: F.array(*[F.struct(x[s].alias("subject_mention"), x["o"].alias("object_mention"), x["e"].alias("evidence"), F.lit(r).alias("role")) for s, r in (("a", "gives"), ("b", "takes"))])))
    found = artifacts.where("content is not null").select(F.col("id").alias("artifact_id"), "observed", "content", F.explode(F.concat(*parts, both)).alias("c")).select("artifact_id", "observed", "content", "c.*")
    kept = found.where("subject_mention is not null and subject_mention <> ''")
    first = kept.groupBy("artifact_id", "subject_mention", "object_mention").agg(F.min_by(F.struct("observed", "content", "evidence", "role"), F.struct("role", "evidence")).alias("x"))
    return first.select("artifact_id", "subject_mention", "object_mention", "x.*")


def _holder(whose: str):
    def made(x: Column) -> Column:
        who = F.col("author") if whose == "author" else F.trim(x["s"])
        return F.struct(who.alias("subject_mention"), x["o"].alias("object_mention"), x["e"].alias("evidence"), F.lit("holds").alias("role"))

    return made


def handoff_claims(artifacts: DataFrame) -> DataFrame:
    """Claims of hand-overs with their periods; see ``handoffs``, ``effective_dates`` and ``validity``."""
    found = handoffs(artifacts).withColumn("account", F.col("object_mention"))
    known = anchors(found.select("account", "observed", "content", F.struct("observed", "artifact_id").alias("ordinal")))
    dated = effective_dates(found, known)
    start, end = validity(F.col("evidence"), F.col("effective"), F.col("until"))
    moved = F.col("role") != "holds"
    return dated.select(
        short_hash(F.col("artifact_id"), F.col("subject_mention"), F.lit("OWNS"), F.col("object_mention")).alias("claim_id"), "artifact_id", "subject_mention", F.lit("OWNS").alias("predicate"), "object_mention", F.col("observed").alias("observed_at"),
        F.when(moved, F.when(F.col("role") == "takes", F.col("effective"))).otherwise(start).alias("valid_from"), F.when(moved, F.when(F.col("role") == "gives", F.col("effective"))).otherwise(end).alias("valid_to"),
        F.lit(HANDOFF_CONFIDENCE).alias("confidence"), F.col("evidence").alias("evidence_span"),
    )


# ---------------------------------------------------------------- families of signals
# What a role says in an owner line and in a list of attendees; the first that a role's words hold.
OWNER_ROLES = [("ASSIGNED_TO", "se", "solutions engineer"), ("ASSIGNED_TO", "pm", "product manager")]
ATTENDEE_ROLES = [("LEADS", "ae", "account executive"), ("MAINTAINS", "se", "solutions engineer"), ("OWNS", "csm", "customer success"), ("LEADS", "pm", "product manager")]
# Verbs between a person and an account. Predicate, verbs, confidence.
VERBS = [
    ("OWNS", "owns|is the owner of|is owner of|is taking over|takes over|took over", 0.85), ("OWNS", r"is\s+(?:now\s+)?responsible\s+for", 0.84), ("LEADS", "leads|is leading|is driving|drives", 0.84),
    ("MAINTAINS", "maintains|is maintaining", 0.83), ("ASSIGNED_TO", "is assigned to", 0.84),
]
# Confidence of each family of signals.
SURE = {"owner-line": 0.78, "assigned-line": 0.80, "passive-assigned": 0.76, "email-thread": 0.82, "attendee-role": 0.72, "chat-role": 0.74}
_PERSON = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
_LINES = {"owner-line": re.compile(rf"^\s*Owner:\s*{_PERSON}\s*-", re.M), "assigned-line": re.compile(rf"^\s*Assigned(?: to)?:\s*{_PERSON}", re.M), "passive-assigned": re.compile(rf"\bassigned to\s+{_PERSON}")}
_VERBS = [(p, re.compile(rf"\b{_PERSON}\s+(?i:{v})\s+(?:the\s+)?([A-Z][\w-]+(?:\s+[A-Z][\w-]+){{0,3}})"), c) for p, v, c in VERBS]
_ROLE = re.compile(rf"{_PERSON}\s*\(([^)]*?)\)")
_SPEAKER = re.compile(r"^([a-z][a-z0-9_]*_csm):\s", re.M)
_RELATION = "artifact_id string, subject_key string, predicate string, object_key string, confidence double, signal string, ambiguous boolean, evidence_span string"


def role_predicate(role: str, table: list[tuple[str, str, str]]) -> str:
    """Predicate of a role by whole words (elsewhere by any letters, so that ``security`` holds ``se``)."""
    low = role.lower()
    words = set(re.findall(r"[a-z]+", low))
    return next((p for p, short, long in table if short in words or long in low), "OWNS")


def _matching(name: str, candidates: list[tuple[str, str]]) -> str | None:
    low = name.lower()
    exact = [k for k, m in candidates if m.lower() == low]
    return (exact or [k for k, m in candidates if low in m.lower()] or [None])[0]


def _thread_account(text: str, own: set[str], accounts: list[tuple[str, str]]) -> tuple[str, str, str] | None:
    """Name of the own side of a mail, the account whose domain the other side has, and the sender line."""
    sender, to = re.search(r"^From:\s*(.+?)\s*<([^>]+)>", text, re.M), re.search(r"^To:\s*(.+)$", text, re.M)
    if not sender or not to:
        return None
    domain = lambda box: box.rpartition("@")[2].lower().strip()
    sides = [(sender.group(1), domain(sender.group(2)))] + [(n.strip(" ,"), domain(b)) for n, b in re.findall(r"([^<,]*)<([^>]+)>", to.group(1))]
    inside = [s for s in sides if s[1] in own]
    outside = [s for s in sides if s[1] not in own]
    if not inside or not outside:
        return None
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    host = plain(outside[0][1].rpartition(".")[0])
    met = [k for k, m in accounts if len(plain(m)) > 3 and host.endswith(plain(m))]
    return (inside[0][0], met[0], sender.group(0)) if met else None


def relations_of(source: str, text: str, candidates: list[tuple[str, str, str]], own: set[str]) -> Iterator[tuple]:
    """``(subject, predicate, object, confidence, signal, ambiguous, evidence)`` of a text with its ``(entity, label, mention)``."""
    people = [(k, m) for k, label, m in candidates if label == "Person"]
    accounts = [(k, m) for k, label, m in candidates if label == "Account"]
    if not people or not accounts:
        return
    keys = sorted({k for k, _ in accounts})
    roles = {n.strip(): r.strip() for n, r in _ROLE.findall(text)}
    lined = set()
    for signal, pattern in _LINES.items():
        for m in pattern.finditer(text):
            who = _matching(m.group(1), people)
            role = roles.get(m.group(1)) or roles.get(m.group(1).split()[0], "")
            for k in keys if who else ():
                lined.add((who, k)) if signal == "owner-line" else None
                yield who, role_predicate(role, OWNER_ROLES) if signal == "owner-line" else "ASSIGNED_TO", k, SURE[signal], signal, False, m.group(0)
    for predicate, pattern, sure in _VERBS:
        for m in pattern.finditer(text):
            who = _matching(m.group(1), people)
            low = m.group(2).lower()
            what = _matching(m.group(2), accounts) or next((k for k, a in accounts if a.lower() in low), None)
            if who and what:
                yield who, predicate, what, sure, f"verb:{predicate}", False, m.group(0)
    thread = _thread_account(text, own, accounts) if source == "gmail" else None
    if thread and (who := _matching(thread[0], people)):
        yield who, "OWNS", thread[1], SURE["email-thread"], "email-thread", True, thread[2]
    if len(keys) == 1:
        for name, role in roles.items():
            who = _matching(name, people)
            if who and (who, keys[0]) not in lined:
                yield who, role_predicate(role, ATTENDEE_ROLES), keys[0], SURE["attendee-role"], "attendee-role", False, f"{name} ({role})"
    for m in _SPEAKER.finditer(text) if source == "slack" else ():
        who = next((k for k, n in people if n.lower() == m.group(1)), None)
        for k in keys if who else ():
            yield who, "OWNS", k, SURE["chat-role"], "chat-role", True, m.group(0)


def relations(artifacts: DataFrame, candidates: DataFrame, own_domains: list[str]) -> DataFrame:
    """Relations of ``artifacts(id, source, content)`` between the ``candidates(artifact_id, entity_key, label, mention)`` found in them.

    An artifact needs a person and an account. Of the same relation the surest finding stands;
    pairs that the extraction rules do not allow are dropped. ``own_domains`` tell the own side
    of a mail from the customer's. The candidates of an artifact are bounded by its text.
    """
    allowed = {(p, a, b) for p, a, b in pair_rules(True)}
    own = {d.lower() for d in own_domains}
    have = candidates.groupBy("artifact_id").agg(F.array_sort(F.collect_set(F.struct("entity_key", "label", "mention"))).alias("c"), F.bool_or(F.col("label") == "Person").alias("p"), F.bool_or(F.col("label") == "Account").alias("a"))
    asked = artifacts.where("content is not null").join(have.where("p and a").select(F.col("artifact_id").alias("__id"), "c"), F.col("id") == F.col("__id"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[tuple, tuple] = {}
            for i, source, text, cs in zip(batch["id"], batch["source"], batch["content"], batch["c"]):
                named = [(c["entity_key"], c["label"], c["mention"]) for c in cs]
                label = {k: x for k, x, _ in named}
                for s, p, o, sure, *rest in relations_of((source or "").lower(), text.replace("\\n", "\n"), named, own):
                    if (p, label[s], label[o]) in allowed and (sure, *rest) > best.get((i, s, p, o), (0.0,)):
                        best[i, s, p, o] = (sure, *rest)
            yield pd.DataFrame([(*k, *v) for k, v in best.items()], columns=[x.split()[0] for x in _RELATION.split(", ")], dtype=object)

    return asked.select("id", "source", "content", "c").mapInPandas(find, _RELATION)


def refine(found: DataFrame, proposals: DataFrame) -> DataFrame:
    """Ambiguous relations with the predicate a model proposes, if it is allowed there; the others stay as they are.

    ``proposals(artifact_id, subject_key, object_key, predicate, confidence)``. An abstention or
    an unusable proposal keeps the relation.
    """
    allowed = F.array(*[F.lit(p) for p in sorted({r[0] for r in pair_rules(True)})])
    p = proposals.select(F.col("artifact_id").alias("__a"), F.col("subject_key").alias("__s"), F.col("object_key").alias("__o"), refined(F.col("predicate"), F.col("confidence"), allowed).alias("__p"), F.col("confidence").alias("__c"))
    best = p.where("__p <> 'ABSTAIN'").groupBy("__a", "__s", "__o").agg(F.max_by("__p", F.struct("__c", "__p")).alias("__p"))
    met = found.join(best, (F.col("artifact_id") == F.col("__a")) & (F.col("subject_key") == F.col("__s")) & (F.col("object_key") == F.col("__o")) & F.col("ambiguous"), "left")
    return met.withColumn("predicate", F.coalesce("__p", "predicate")).drop("__a", "__s", "__o", "__p")


def coverage(artifacts: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """One row of the extraction funnel: artifacts, with candidates, with a person and an account, relations."""
    per = candidates.groupBy("artifact_id").agg(F.bool_or(F.col("label") == "Person").alias("p"), F.bool_or(F.col("label") == "Account").alias("a"))
    n = per.agg(F.count(F.lit(1)).alias("with_candidates"), F.count_if(F.col("p") & F.col("a")).alias("with_pair"))
    a = artifacts.agg(F.count_distinct("id").alias("artifacts"))
    r = found.agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("artifact_id").alias("with_relations"))
    return a.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(r))  # one row each
