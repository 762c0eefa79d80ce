"""Raw records into artifacts: ids, times from names, mail parts, mentions and links, HTML, evidence lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import UNSEEN

# How a line begins after which a mail only quotes.
QUOTE_MARKS = r"(?mi)^[ \t]*(?:>|On .+ wrote:[ \t]*$|-{2,}[ \t]*Original Message[ \t]*-{2,}|_{5,}[ \t]*$|From:[ \t].+)"


def slack_time(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss+00:00`` of a chat time in epoch seconds; null if it is none."""
    s = F.floor(ts.try_cast("double")).cast("long")
    days = F.floor(s / 86400).cast("int")
    rest = (s - days.cast("long") * 86400).cast("int")
    clock = F.format_string("T%02d:%02d:%02d+00:00", F.floor(rest / 3600).cast("int"), (F.floor(rest / 60) % 60).cast("int"), rest % 60)
    return F.concat(F.date_from_unix_date(days).cast("string"), clock)


def mentions(text: Column) -> Column:
    """Chat user ids and ``@names``, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"<@[A-Z0-9]+>|(?<![\w.])@[\w.-]{2,64}"), F.lit(0)))


def links(text: Column) -> Column:
    """Addresses of pages, once each, in order, without closing marks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>|)\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")))


def header(text: Column, name: str) -> Column:
    """Value of the first header line ``name:``, null without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?mi)^{name}:[ \t]*(\S[^\n]*)$", 1)
    return F.when(found != "", F.trim(found))


def address(value: Column) -> tuple[Column, Column]:
    """Name and address of ``Name <box@host>`` or of a bare address."""
    box = F.lower(F.regexp_extract(value, r"[\w.+-]+@[\w-]+\.[\w.-]+", 0))
    name = F.trim(F.regexp_replace(F.regexp_replace(value, r"<[^>]*>", ""), '"', ""))
    return F.when((name != "") & (F.lower(name) != box), name), F.when(box != "", box)


def split_quoted(body: Column) -> tuple[Column, Column]:
    """New and quoted part of a mail at the first quoting line; if nothing is new, all of it is."""
    text = F.coalesce(body, F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    before = F.split(text, QUOTE_MARKS, 2)[0]
    new, quoted = bare(before), bare(F.substring(text, F.length(before) + 1, F.length(text)))
    marked, empty = text.rlike(QUOTE_MARKS), new == ""
    return F.when(marked & ~empty, new).otherwise(text), F.when(marked & ~empty, quoted)


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles and tags, white space collapsed, common entities read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def chat_body(content: Column, *speakers: Column) -> Column:
    """All that follows the channel line and the speaker's ``name:``, null if nothing of it is visible.

    A label that is none of the ``speakers`` is text and stays.
    """
    text = F.ltrim(F.regexp_replace(F.regexp_replace(content, r"^\s*#[^\n]*", ""), r"^\s+", ""))
    body = text
    for name in reversed(speakers):
        label = F.concat(F.trim(name), F.lit(":"))
        body = F.when(text.startswith(label), F.substring(text, F.length(label) + 1, F.lit(2147483647))).otherwise(body)
    return F.when(F.regexp_replace(body, rf"{UNSEEN}+", "") != "", F.regexp_replace(body, r"^\s+|\s+$", ""))


def thread_text(rows: DataFrame, keys: list[str], order: str, author: str, body: str) -> DataFrame:
    """``keys, text``: the messages of a thread as lines ``author: body`` in time order, blank ones left out.

    A thread's text is one value, so it has to fit a row; threads are bounded by what people write.
    """
    line = F.concat_ws(": ", F.coalesce(author, F.lit("unknown")), F.trim(body))
    kept = rows.where(F.trim(F.coalesce(body, F.lit(""))) != "")
    lines = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    return lines.select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def validated(artifacts: DataFrame) -> DataFrame:
    """Adds ``problems`` of the ingestion boundary: what an artifact lacks for its source."""
    m = F.col("metadata")
    chat = F.lower("source") == "slack"
    mail = F.lower("source") == "gmail"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return artifacts.withColumn("problems", F.array_compact(F.array(
        F.when(~F.coalesce(F.col("id").rlike("^dsid_[0-9a-f]{32}$"), F.lit(False)), "id"), F.when(blank(F.col("source")), "source"), F.when(blank(F.col("content")), "content"),
        F.when(chat & blank(m["channel_id"]), "channel_id"), F.when((chat | mail) & blank(m["message_id"]), "message_id"), F.when(mail & blank(m["thread_id"]), "thread_id"),
    )))
