"""Records into artifacts: raw files, threads, mails, and what a text says of times."""

import base64
import json
from datetime import date

from pyspark.sql import functions as F

from factweave.operators import records as R

HEX = "0123456789abcdef" * 2


def test_raw_files(spark):
    rows = [
        ("slack", f"a/dsid_{HEX}__1700000000-x.txt", "#c\nAnn: hi"), ("gmail", f"dsid_{HEX}__2024-05-06_x.txt", "From: A <a@x.test>\nSubject: S\nDate: 2024-01-02T03:04Z\n\nx"), ("gmail", f"dsid_{HEX}__2024-05-06_x.txt", None),
        ("fireflies", f"dsid_{HEX}__2024-x.txt", "Meeting\nAttendees: A, B\nDate: 2024-02-30"), ("jira", f"dsid_{HEX}__plain.txt", " T \ndataset_noise_document"), ("fax", f"dsid_{HEX}__x.txt", "x"), ("jira", "x.txt", "x"), (None, None, None),
    ]
    got = R.raw_artifacts(spark.createDataFrame([(*r, "e") for r in rows], "source string, path string, text string, title string")).collect()
    assert [(r.type, r.author, r.timestamp, r.title, r.ts_source, r.noise) for r in got] == [
        ("slack_message", None, "2023-11-14T22:13:20", "#c", "unix-slug", False), ("gmail_message", "A <a@x.test>", "2024-01-02T03:04:00+00:00", "S", "header", False), ("gmail_message", None, "2024-05-06T00:00:00", "2024-05-06_x", "date-slug", False),
        ("meeting_transcript", None, "2024-01-01T00:00:00", "Meeting", "header", False), ("jira_ticket", None, None, "T", None, True),
    ]
    assert got[3].attendees == "A, B"


def test_threads(spark):
    rows = [
        ("C1", "general", "1.0", "1.0", "U1", "Ann", " hi <@U2> https://a.test/x. "), ("C1", "general", "1.0", "3.0", "U2", None, "yes"), ("C1", "general", "1.0", "2.0", "U1", "Ann", "  "), ("C1", "general", "1.0", "4.0", None, "", "who"), ("C2", None, "9.0", "9.5", "U3", "Bo", None),
    ]
    got = {r.channel_id: r for r in R.chat_artifacts(spark.createDataFrame(rows, "channel_id string, channel_name string, thread_id string, message_id string, user_id string, user_name string, text string")).collect()}
    assert got["C1"].content == "#general\nAnn: hi <@U2> https://a.test/x.\n  U2: yes\n  unknown: who" and got["C1"].reply_count == 3
    assert [p.user_id for p in got["C1"].participants] == ["U1", "U2"] and got["C1"].links == ["https://a.test/x"] and got["C2"].content == "#C2"


def test_nested_mails(spark):
    code = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    deep = {"mimeType": "text/plain", "body": {"data": code("héllo ✓ ")}}
    for _ in range(3000):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    deep["parts"].append({"filename": "a.pdf"})
    plain = {"id": "1", "threadId": "t", "internalDate": "5", "payload": {"headers": [{"name": "FROM", "value": "A <a@x.test>"}, {"name": "to", "value": "b@x.test, , c@x.test"}], **{"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/html", "body": {"data": code("<b>x</b>")}}, {"mimeType": "text/plain", "body": {"data": code("plain")}}]}}}
    html = {"id": "2", "payload": {"mimeType": "text/html", "body": {"data": code("<p>only <b>page</b></p>")}}}
    snippet = {"id": "3", "snippet": "snip", "payload": {"mimeType": "text/plain", "body": {"data": "***"}}, "attachments": ["z"]}
    import sys

    sys.setrecursionlimit(20_000)
    texts = [json.dumps(plain), json.dumps(html), json.dumps(snippet), "{", None, "[]", json.dumps({"payload": {}})]
    got = {r.message_id: r for r in R.api_mails(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].body == "plain" and got["1"].recipients == ["b@x.test", "c@x.test"] and got["1"].sender == "A <a@x.test>" and got["1"].sent == "5"
    assert got["2"].body.split() == ["only", "page"] and got["2"].subject == "(no subject)" and got["3"].body == "snip" and got["3"].attachments == ["z"]
    assert R._part(deep, "text/plain").strip() == "héllo ✓" and R._attachments(deep) == ["a.pdf"]


def test_text_mails(spark):
    text = "From: Ann <Ann@x.test>\nTo: b@x.test, B@x.test\nSubject: S\n\nnew https://a.test\n\nOn Monday Bo wrote:\n> old https://b.test"
    df = spark.createDataFrame([("1", text), ("2", ""), ("3", None), ("4", "no header")], "id string, t string")
    mails = df.select(R.text_mail(F.col("id"), F.col("id"), F.col("t")).alias("x")).select("x.*")
    got = {r.message_id: r for r in R.mail_artifacts(mails).collect()}
    assert got["1"].content == "From: Ann <Ann@x.test>\nTo: b@x.test, B@x.test\nSubject: S\n\nnew https://a.test" and got["1"].participants == ["ann@x.test", "b@x.test"]
    assert got["1"].links == ["https://a.test"] and got["1"].has_quoted_history and got["1"].quoted_excerpt.startswith("On Monday") and len(got) == 4


def test_times_of_a_text(spark):
    friday = "Ann takes over Acme next Friday"
    rows = [("2024-05-03T10:00:00", friday), ("2024-05-02", friday), (None, friday), ("", "Date: 2024-01-05\nfrom 2024-02-01 until 2024-03-01"), (None, "- 2024-01-01: a\n- 2024-01-02 (b"), (None, "2024-01-03 - a"), (None, "effective on 2024-02-01, ends 2024-01-01"), (None, None), ("soon", friday)]
    got = R.resolved_times(R.envelope(spark.createDataFrame(rows, "timestamp string, content string"))).collect()
    assert [(r.observed_at, r.observed_source, r.valid_from, r.valid_to) for r in got] == [
        ("2024-05-03T10:00:00", "artifact", "2024-05-10", None), ("2024-05-02", "artifact", "2024-05-03", None), (None, None, None, None), ("2024-01-05", "meeting-date", "2024-02-01", "2024-03-01"), ("2024-01-02", "revision-history", None, None),
        ("2024-01-03", "text-timeline", None, None), (None, None, "2024-02-01", None), (None, None, None, None), ("soon", "artifact", None, None),
    ]
    assert date(2024, 5, 10).weekday() == 4
