"""Calls, connectors, sync and webhooks without a network; packages of files."""

import hashlib
import hmac
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factweave.sources import connectors as N
from factweave.sources import packages as P


def test_calls_are_tried_again():
    waits, answers = [], [N.Answer(503, {}), N.Answer(429, {}, {"Retry-After": "2"}), OSError("gone"), N.Answer(200, {"ok": True, "x": 1})]

    def transport(method, parameters):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert N.call(transport, "m", {}, sleep=waits.append, jitter=lambda: 0.5) == {"ok": True, "x": 1} and waits == [0.2, 2.0, 0.8]
    for body, status, code, retryable in (({"ok": False, "error": "not_authed"}, 200, "not_authed", False), ({}, 404, "404", False), ({"ok": False, "error": "ratelimited"}, 200, "ratelimited", True)):
        with pytest.raises(N.ServiceError) as e:
            N.call(lambda m, p: N.Answer(status, body), "m", {}, sleep=lambda s: None)
        assert (e.value.code, e.value.retryable) == (code, retryable)
    assert N.retry_after("x", 0) is None and N.retry_after(None, 0) is None and N.retry_after("Thu, 01 Jan 1970 00:00:09 GMT", 4) == 5


def test_channel_history():
    store = [{"ts": f"{i}.0"} for i in range(1, 8)]

    def transport(method, p):
        if method == "auth.test":
            return N.Answer(200, {"ok": True})
        rows = [r for r in reversed(store) if r["ts"] > p.get("oldest", "")]
        at = int(p.get("cursor", 0))
        return N.Answer(200, {"ok": True, "messages": rows[at : at + 2], "response_metadata": {"next_cursor": str(at + 2) if at + 2 < len(rows) else ""}})

    c = N.HistoryConnector("slack", transport, "C1")
    rows, cursor = c.fetch(None, 3)
    assert [r["ts"] for r in rows] == ["1.0", "2.0", "3.0"] and cursor == "C1:3.0"
    rows, cursor = c.fetch(cursor, 10)
    assert [r["ts"] for r in rows] == ["4.0", "5.0", "6.0", "7.0"] and cursor is None
    assert c.fetch_record("C1:5.0") == {"ts": "5.0"} and c.fetch_record("C1:9.0") is None


def test_mailbox_starts_again_when_its_number_is_too_old():
    def transport(method, p):
        if method == "profile":
            return N.Answer(200, {"historyId": "50"})
        if method == "history":
            return N.Answer(404, {}) if p["startHistoryId"] == "1" else N.Answer(200, {"history": [{"messagesAdded": [{"message": {"id": "m9"}}, {"message": {"id": "m9"}}]}], "historyId": "60"})
        return N.Answer(200, {"messages": [{"id": "m1"}, {"id": "m2"}]}) if method == "messages" else N.Answer(404 if p["id"] == "no" else 200, {"id": p["id"]})

    m = N.MailboxConnector(transport)
    assert m.fetch(None, 5) == ([{"id": "m1"}, {"id": "m2"}], "50") and m.fetch("40", 5) == ([{"id": "m9"}], "60") and m.fetch("1", 1) == ([{"id": "m1"}], "50")
    assert m.fetch_record("m7") == {"id": "m7"} and m.fetch_record("no") is None


def test_sync_goes_on_and_mends_a_torn_line(tmp_path, spark):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text(json.dumps({"items": [{"id": f"{i}{j}"} for j in range(2)]}))
    c = N.FolderConnector("jira", str(tmp_path), "items", lambda r: r["id"])
    s = N.Sync(c, str(tmp_path / "out"))
    assert s.initial(2) == 2 and s.incremental(3) == 3 and s.health() == (True, "20")
    with open(s.rows_file, "a") as f:
        f.write('{"native_id": "torn')
    assert s.incremental() == 1 and s.incremental() == 0 and s.initial(4) == 0
    rows = spark.read.json(s.rows_file).collect()
    assert [r.native_id for r in rows] == ["00", "01", "10", "11", "20", "21"] and json.loads(rows[0].record) == {"id": "00"}
    assert N.load_cursor(s.cursor_file, "other") is None and N.load_cursor(str(tmp_path / "none"), "jira") is None
    assert N.Sync(N.FolderConnector("x", "/nowhere", "items", str), str(tmp_path / "o2")).health()[0] is False


def sign(body, at, secret="s"):
    return "v0=" + hmac.new(secret.encode(), f"v0:{at}:".encode() + body, hashlib.sha256).hexdigest()


def test_webhooks(spark):
    got, seen = [], set()
    event = json.dumps({"event_id": "E1", "event": {"type": "message", "channel": "C", "ts": "1.0"}}).encode()

    def ask(body, at=1000, signature=None, now=1100):
        return N.webhook("s", body, {"X-Slack-Request-Timestamp": str(at), "x-slack-signature": signature or sign(body, at)}, seen, got.append, now)

    assert ask(event) == (200, {"ok": True}) and ask(event) == (200, {"ok": True, "deduped": True}) and len(got) == 1
    assert ask(event, signature="v0=00")[0] == 401 and ask(event, now=1301)[0] == 401 and ask(b"{")[0] == 400 and ask(event, at="x")[0] == 401
    assert ask(b'{"type": "url_verification", "challenge": "c"}') == (200, {"challenge": "c"})
    rows = [(event.decode(), "1000", sign(event, 1000), 1100.0), (event.decode(), "1000", "bad", 1100.0), (None, None, None, 1100.0)]
    df = spark.createDataFrame(rows, "body string, at string, sig string, now double")
    assert [r[0] for r in df.select(N.signed_column("s", F.col("body"), F.col("at"), F.col("sig"), F.col("now"))).collect()] == [True, False, False]
    payloads = spark.createDataFrame([(event.decode(),), ('{"event": {"ts": "2.0"}}',), ("{",), (None,), ('{"type": "x"}',)], "body string")
    assert [(r.event_id, r.event_type, r.native_id) for r in N.queued(payloads, "body").collect()] == [("E1", "message", "C:1.0"), ("2.0", "unknown", None)]


def test_corpora_and_downloads(spark, tmp_path):
    hexes = [f"{i:032x}" for i in range(3)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for h in hexes:
            z.writestr(f"jira/dsid_{h}__2024-01-02-x.txt", f"T {h}\nbody")
        z.writestr("jira/readme.md", "x")
        z.writestr("jira/other.txt", "x")
    full = P.corpus(spark, "full", str(tmp_path / "a.zip"))
    assert sorted((r.artifact_id, r.source, r.title) for r in full.collect()) == [(f"dsid_{h}", "jira", f"T {h}") for h in hexes]
    (tmp_path / "s.jsonl").write_text('{"id": "1", "source": "s", "title": null, "content": "c"}\n\n')
    assert [tuple(r) for r in P.corpus(spark, "sample", str(tmp_path / "s.jsonl")).collect()] == [("1", "s", "", "c")]
    with pytest.raises(ValueError):
        P.corpus(spark, "other", "x")
    (tmp_path / "raw/jira").mkdir(parents=True)
    (tmp_path / f"raw/jira/dsid_{hexes[0]}__x.txt").write_text("Title\nx\ny")
    (tmp_path / "raw/jira/bad.txt").write_text("x")
    assert [r.title for r in P.folder_artifacts(spark, str(tmp_path / "raw")).collect()] == ["Title"]
    (tmp_path / "m.json").write_text(json.dumps({"assets": [{"name": n} for n in ("a_slice_2", "a_slice_1", "b_slice_1")]}, indent=1))
    assert [r.name for r in P.slices(P.assets(spark, str(tmp_path / "m.json")), "a").collect()] == ["a_slice_1", "a_slice_2"]
    to, fetched = str(tmp_path / "d"), []
    open_ = lambda url: fetched.append(url) or iter([b"ab", b"c"])
    right = hashlib.sha256(b"abc").hexdigest()
    assert P.download(open_, "u", to, right) == to and P.download(open_, "u", to, right) == to and len(fetched) == 1
    with pytest.raises(ValueError):
        P.download(open_, "u", to + "2", "0" * 64)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("d")) == ["d"]


def test_pairs_and_gold(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text(json.dumps({"pair_id": "1", "a": {"mention": "A", "sources": ["s", "t"]}, "b": {"mention": "", "type": "org", "emails": ["e"]}, "label": "SAME_ENTITY", "features": {"cooccurrence": 0.5, "x": 2.0}, "label_rationale": "why"}) + "\n")
    n = P.read_pairs(spark, str(tmp_path / "n.jsonl"), nested=True)
    r = n.first()
    assert (r.mention_a, r.type_a, r.source_a, r.emails_a, r.type_b, r.emails_b, r.features, r.notes) == ("A", "person", "s", [], "org", ["e"], {"cooccurrence_score": 0.5, "x": 2.0}, "why")
    assert P.pair_problems(n).first().problems == ["mention_b", "features"]
    from factweave.sources import files

    files.write_jsonl(n, str(tmp_path / "flat"))
    assert [tuple(x) for x in P.read_pairs(spark, str(tmp_path / "flat")).collect()] == [tuple(r)]
    rows = {"artifacts": [("a", "s", "t", "hello there")], "mentions": [("a", "x", "person", None, ""), ("z", "x", "person", None, "")], "claims": [("a", "S", "p", "OWNS", "O", "q", "hello", None, None, None, "VALID", ""), ("a", "S", "p", "OWNS", "O", "q", "bye", None, None, None, "VALID", "")], "ambiguities": []}
    tables = {k: spark.createDataFrame(v, P.GOLD[k]) for k, v in rows.items()}
    P.write_gold(spark, str(tmp_path / "gold"), {"version": 1}, tables)
    manifest, back = P.read_gold(spark, str(tmp_path / "gold"))
    assert manifest == {"version": 1} and {k: sorted(map(str, t.collect())) for k, t in back.items()} == {k: sorted(map(str, t.collect())) for k, t in tables.items()}
    assert {x.problem: x.rows for x in P.gold_problems(back).collect()} == {"orphan mentions": 1, "evidence not in text": 1}
