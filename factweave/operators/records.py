"""Raw files, chat messages and mails into artifacts, and what their texts say about people and times."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import normalize as N
from factweave.operators.claims import artifact_id

# Sources and the types of their artifacts.
TYPES = {
    "slack": "slack_message", "gmail": "gmail_message", "linear": "linear_ticket", "google_drive": "google_drive_document", "hubspot": "hubspot_crm_record",
    "fireflies": "meeting_transcript", "github": "github_pr", "jira": "jira_ticket", "confluence": "confluence_page",
}
# Names of raw files, times in them, dates in texts.
FILE = r"^dsid_([0-9a-f]{32})__(?:(.+)\.txt$)?"
EPOCH_SLUG, DATE_SLUG = r"^([0-9]{9,10})[-_]", r"^(20[0-9]{2})-?([0-9]{2})?-?([0-9]{2})?[-_]"
ISO = r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2})(?::([0-9]{2}))?)?(Z?)"
TIMELINE, REVISION = r"(?m)^\s*(20[0-9]{2}-[0-9]{2}-[0-9]{2})\s*[-–]", r"(?m)^\s*[-*]\s*(20[0-9]{2}-[0-9]{2}-[0-9]{2})\s*(?:\(|:)"
MEETING = r"(?m)^\s*(?:[-*]\s*)?(?:Meeting:|Date:)\s*(20[0-9]{2}-[0-9]{2}-[0-9]{2})"
STARTS = r"(?i)\b(?:starting|starts|effective|as of|from|beginning)\s+(?:on\s+)?(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"
ENDS = r"(?i)\b(?:until|through|till|ends?)\s+(?:on\s+)?(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"
TAKES_OVER = r"(?i)\b(?:takes? over|taking over)\b.*?\bnext\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
TICKET = r"\b([A-Z]{2,5}-\d{1,6})\b"
#: Lines of a text in which headers are looked for.
HEADER_LINES = 40


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    x = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)
    return F.when(x != "", x)


# ---------------------------------------------------------------- raw files
def slug_time(slug: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of the number or date with which a file name begins; epochs are UTC."""
    epoch = _found(slug, EPOCH_SLUG).try_cast("long")
    days = F.floor(epoch / 86400).cast("int")
    rest = (epoch - days.cast("long") * 86400).cast("int")
    clock = F.format_string("T%02d:%02d:%02d", F.floor(rest / 3600).cast("int"), (F.floor(rest / 60) % 60).cast("int"), rest % 60)
    year, month, day = (_found(slug, DATE_SLUG, g) for g in (1, 2, 3))
    date = F.when(year.isNotNull(), F.concat_ws("-", year, F.coalesce(month, F.lit("01")), F.when(month.isNotNull(), F.coalesce(day, F.lit("01"))).otherwise("01")))
    return F.when(epoch.isNotNull(), F.concat(F.date_from_unix_date(days).cast("string"), clock)).otherwise(F.concat(date, F.lit("T00:00:00")))


def first_iso(text: Column) -> Column:
    """The first ISO date of a text, with its time (midnight without one), null if it does not exist."""
    day, hour, minute, zone = (_found(text, ISO, g) for g in (1, 2, 3, 4))
    real = day.try_cast("date").isNotNull() & (F.coalesce(hour.try_cast("int"), F.lit(0)) <= 23) & (F.coalesce(minute.try_cast("int"), F.lit(0)) <= 59)
    return F.when(real, F.concat(day, F.lit("T"), F.coalesce(hour, F.lit("00")), F.lit(":"), F.coalesce(minute, F.lit("00")), F.lit(":00"), F.when(zone.isNotNull(), "+00:00").otherwise("")))


def raw_artifacts(files: DataFrame) -> DataFrame:
    """Artifacts of ``files(source, path, text)``; files of unknown sources or names are left out.

    The title is the subject of a mail, else the first line, else the slug. The time is that of
    the headers of a mail or meeting, else that of the slug; ``ts_source`` says which.
    """
    name = F.element_at(F.split("path", "/"), -1)
    f = files.withColumn("n", name).where(F.col("source").isin(list(TYPES)) & F.col("n").rlike(FILE)).withColumns({"hex": _found(F.col("n"), FILE), "slug": _found(F.col("n"), FILE, 2)})
    text = F.coalesce("text", F.lit(""))
    mail, meeting = F.col("source") == "gmail", F.col("source") == "fireflies"
    line = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    head = lambda n: F.trim(_found(text, rf"(?m)^{n}:\s*(.+)$"))
    held = _found(text, r"(?m)^Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})")
    stamped = F.when(mail, F.coalesce(first_iso(head("Date")), slug_time(F.col("slug")))).when(meeting, F.coalesce(first_iso(held), slug_time(F.col("slug")))).otherwise(slug_time(F.col("slug")))
    title = F.coalesce(F.when(mail, head("Subject")), F.nullif(line, F.lit("")), F.col("slug"))
    headed = head("Date").isNotNull()
    came = F.when(headed, "header").when(F.col("slug").rlike(EPOCH_SLUG), "unix-slug").when(F.col("slug").rlike(DATE_SLUG), "date-slug")
    types = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    return f.select(
        F.concat(F.lit("dsid_"), "hex").alias("id"), "source", F.col("hex").alias("source_id"), types[F.col("source")].alias("type"), F.when(mail, head("From")).alias("author"), stamped.alias("timestamp"), title.alias("title"),
        text.alias("content"), F.when(title.isNotNull(), F.col("slug")).alias("slug"), F.when(meeting, head("Attendees")).alias("attendees"), text.contains("dataset_noise_document").alias("noise"), F.when(stamped.isNotNull(), came).alias("ts_source"),
    )


def live_artifacts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts of ``records(source, native_source_id, type, content, ...)`` and the rejected rows with a ``reason``."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(~F.coalesce(F.col("source").isin(list(TYPES)), F.lit(False)), "source").when(blank("native_source_id"), "native_source_id").when(blank("content"), "content")
    marked = records.withColumn("reason", reason)
    native = F.trim("native_source_id")
    good = marked.where("reason is null").drop("reason").withColumn("native_source_id", native)
    return good.select(artifact_id(F.col("source"), native).alias("id"), F.col("native_source_id").alias("source_id"), *[c for c in good.columns if c not in ("id", "source_id")]), marked.where("reason is not null")


# ---------------------------------------------------------------- chat
def participants(messages: DataFrame, keys: list[str], order: str, user: str, name: str) -> DataFrame:
    """``keys, participants``: who wrote in a thread, each once, in the order of the first message.

    The first message of every user is found by a combine before the shuffle; rows without a
    user are nobody.
    """
    who = messages.where(F.col(user).isNotNull() & (F.col(user) != ""))
    first = who.groupBy(*keys, user).agg(F.min(order).alias("__at"), F.min_by(F.coalesce(F.col(name), F.col(user)), order).alias("__name"))
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", F.col(user).alias("user_id"), F.col("__name").alias("display_name")))).alias("p"))
    return rows.select(*keys, F.transform("p", lambda x: F.struct(x["user_id"].alias("user_id"), x["display_name"].alias("display_name"))).alias("participants"))


def chat_artifacts(messages: DataFrame) -> DataFrame:
    """One artifact per thread of ``messages(channel_id, channel_name, thread_id, message_id, user_id, user_name, text)``.

    The text is ``#channel``, ``author: body`` of the root and its replies, indented, in time
    order; blank bodies are left out. A thread without its root begins with its first message.
    """
    keys = ["channel_id", "thread_id"]
    author = F.coalesce(F.nullif("user_name", F.lit("")), F.nullif("user_id", F.lit("")), F.lit("unknown"))
    body = F.trim(F.coalesce("text", F.lit("")))
    line = F.when(body != "", F.concat(F.when(F.col("message_id") == F.col("thread_id"), "").otherwise("  "), author, F.lit(": "), body))
    rows = messages.withColumn("x", F.struct(F.col("message_id").alias("at"), line.alias("line"), author.alias("who"), N.mentions(F.col("text")).alias("m"), N.links(F.col("text")).alias("l")))
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"), F.min("channel_name").alias("channel"), (F.count(F.lit(1)) - 1).alias("reply_count"))
    head = F.concat(F.lit("#"), F.regexp_replace(F.coalesce("channel", "channel_id"), "^#+", ""))
    lines = F.filter(F.transform("x", lambda v: v["line"]), lambda v: v.isNotNull())
    people = participants(messages, keys, "message_id", "user_id", "user_name")
    merged = lambda f: F.array_distinct(F.flatten(F.transform("x", lambda v: v[f])))
    made = per.select(
        *keys, artifact_id(F.lit("slack"), F.concat_ws(":", *keys)).alias("id"), head.alias("title"), F.concat_ws("\n", head, lines).alias("content"), F.col("x")[0]["who"].alias("author"), N.slack_time(F.col("thread_id")).alias("timestamp"),
        merged("m").alias("mentions"), merged("l").alias("links"), "reply_count",
    )
    return made.join(people, keys, "left")


def chat_link(workspace: Column, channel: Column, message: Column) -> Column:
    return F.concat(F.lit("https://"), workspace, F.lit(".slack.com/archives/"), channel, F.lit("/p"), F.replace(message, F.lit("."), F.lit("")))


def mail_link(message: Column) -> Column:
    return F.concat(F.lit("https://mail.google.com/mail/u/0/#inbox/"), message)


# ---------------------------------------------------------------- mail
MAIL = "message_id string, thread_id string, subject string, sender string, recipients array<string>, copies array<string>, sent string, body string, attachments array<string>"


def _part(part: dict, kind: str) -> str:
    """Data of the first part of a kind, depth first; no recursion, so any nesting can be read."""
    stack = [part]
    while stack:
        at = stack.pop()
        data = (at.get("body") or {}).get("data") if at.get("mimeType") == kind else None
        if data:
            try:
                text = base64.urlsafe_b64decode((data + "=" * (-len(data) % 4)).encode("ascii")).decode("utf-8", "replace")
            except (binascii.Error, ValueError):
                text = ""
            if text:
                return text
        stack.extend(reversed(at.get("parts") or []))
    return ""


def _attachments(part: dict) -> list[str]:
    names, stack = [], [part]
    while stack:
        at = stack.pop()
        if at.get("filename"):
            names.append(at["filename"])
        stack.extend(reversed(at.get("parts") or []))
    return names


def _parsed(record: str | None) -> tuple | None:
    try:
        m = json.loads(record or "")
        payload = m.get("payload") or {}
        heads = {h["name"].lower(): h["value"] for h in payload.get("headers") or []}
        page = _part(payload, "text/html")
        body = _part(payload, "text/plain").strip() or __import__("re").sub(r"<[^>]+>", " ", page).strip() or m.get("snippet") or ""
        many = lambda n: [x.strip() for x in (heads.get(n) or "").split(",") if x.strip()]
        sent = heads.get("date") or (str(m["internalDate"]) if m.get("internalDate") is not None else None)
        return m["id"], m.get("threadId") or m["id"], heads.get("subject") or "(no subject)", heads.get("from") or "unknown", many("to"), many("cc"), sent, body, m.get("attachments") or _attachments(payload)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def api_mails(records: DataFrame, column: str) -> DataFrame:
    """Mails of the JSON of a mail service: headers, the first plain part or the text of the first page, names of attachments.

    Records that are no such JSON give no row. Parts may be nested to any depth.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MAIL.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for r in map(_parsed, batch[column]) if r], columns=names, dtype=object)

    return records.select(column).mapInPandas(read, MAIL)


def text_mail(id_: Column, thread: Column, text: Column) -> Column:
    """A mail written as header lines, a blank line and a body."""
    head, body = F.regexp_extract(text, r"(?s)^(.*?)\n[ \t]*(?:\n|$)", 1), F.regexp_extract(text, r"(?s)^.*?\n[ \t]*\n(.*)$", 1)
    line = lambda n: F.trim(_found(head, rf"(?mi)^{n}[ \t]*:[ \t]*(.*)$"))
    many = lambda n: F.filter(F.transform(F.split(F.coalesce(line(n), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        id_.alias("message_id"), thread.alias("thread_id"), F.coalesce(line("Subject"), F.lit("(no subject)")).alias("subject"), F.coalesce(line("From"), F.lit("unknown")).alias("sender"), many("To").alias("recipients"),
        many("Cc").alias("copies"), line("Date").alias("sent"), F.trim(body).alias("body"), F.array().cast("array<string>").alias("attachments"),
    )


def mail_artifacts(mails: DataFrame) -> DataFrame:
    """Artifacts of mails (see ``MAIL``): headers and new text; what is quoted is kept apart, links are those of the new text."""
    new, old = N.split_quoted(F.col("body"))
    m = mails.withColumns({"new": new, "old": old})
    some = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    content = F.concat_ws("\n", F.concat(F.lit("From: "), "sender"), some("To: ", "recipients"), some("Cc: ", "copies"), F.concat(F.lit("Date: "), "sent"), F.concat(F.lit("Subject: "), "subject"), F.lit(""), "new")
    box = lambda p: F.lower(F.coalesce(_found(p, r"<([^<>]*)>"), p))
    people = F.array_distinct(F.transform(F.concat(F.array("sender"), F.coalesce("recipients", F.array()), F.coalesce("copies", F.array())), lambda p: F.trim(box(p))))
    return m.select(
        artifact_id(F.lit("gmail"), F.col("message_id")).alias("id"), "message_id", "thread_id", F.col("subject").alias("title"), F.col("sender").alias("author"), "sent", content.alias("content"), people.alias("participants"),
        N.links(F.col("new")).alias("links"), "attachments", F.left("old", F.lit(2000)).alias("quoted_excerpt"), F.col("old").isNotNull().alias("has_quoted_history"), mail_link(F.col("message_id")).alias("source_url"),
    )


# ---------------------------------------------------------------- evidence
def envelope(artifacts: DataFrame) -> DataFrame:
    """Adds what a text of ``artifacts(timestamp, content)`` says: tickets, header lines, dates of a timeline, revisions and the meeting."""
    text = F.replace(F.coalesce("content", F.lit("")), F.lit("\\n"), F.lit("\n"))
    a = artifacts.withColumn("content", text)
    top = F.array_join(F.slice(F.split("content", "\n"), 1, HEADER_LINES), "\n")
    line = lambda n: F.trim(_found(top, rf"(?mi)^{n}:(.*)$"))
    all_ = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    return a.withColumns({
        "ticket_ids": all_(TICKET), "email_from": line("from"), "email_to": line("to"), "email_cc": F.filter(F.transform(F.split(F.coalesce(line("cc"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""),
        "timeline_dates": all_(TIMELINE), "revision_dates": all_(REVISION), "meeting_date": _found(F.col("content"), MEETING),
    })


def resolved_times(enveloped: DataFrame) -> DataFrame:
    """Adds ``observed_at, observed_source, valid_from, valid_to`` to rows of ``envelope``.

    Observed is the artifact's time, else the meeting, the last revision, the last day of the
    timeline. Stated days bound the validity; somebody who takes over next Monday starts on the
    Monday after the observation. An end before the start is dropped.
    """
    last = lambda c: F.try_element_at(c, F.lit(-1))
    own = F.nullif("timestamp", F.lit(""))
    observed = F.coalesce(own, "meeting_date", last("revision_dates"), last("timeline_dates"))
    source = F.when(own.isNotNull(), "artifact").when(F.col("meeting_date").isNotNull(), "meeting-date").when(F.size("revision_dates") > 0, "revision-history").when(F.size("timeline_dates") > 0, "text-timeline")
    r = enveloped.withColumns({"observed_at": observed, "observed_source": source})
    day = F.left("observed_at", F.lit(10)).try_cast("date")
    weekday = F.lower(_found(F.col("content"), TAKES_OVER))
    coming = F.coalesce(*[F.when(weekday == name.lower(), F.next_day(day, name[:3])) for name in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    r = r.withColumns({"valid_from": F.coalesce(coming.cast("string"), _found(F.col("content"), STARTS)), "valid_to": _found(F.col("content"), ENDS)})
    return r.withColumn("valid_to", F.when(F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False)), None).otherwise(F.col("valid_to")))
