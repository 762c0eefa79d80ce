"""Text queries on small tables: nothing of a text is cut off."""

from factweave import text_queries

CHAT = "id string, source string, author string, content string, metadata struct<channel_id:string,thread_id:string,message_id:string,author_display_name:string>"
T = "1740000000.194700"


def test_thread_text_keeps_all_lines_and_spellings(spark, tmp_path):
    def row(no, thread, content, author="Ann Bee", name="Ann Bee"):
        return (f"a{no}", "slack", author, content, ("c", thread, f"174000000{no}.194700", name))

    rows = [
        row(0, T, "#c\nAnn Bee: one\n\ntwo: 2\nthree\n"), row(1, "1740000000.1947", "#c\nBob: four\nfive", "Bob", None), row(2, "p1740000000194700", "#c\nnote: six", "Cy", "Cy"),
        row(3, f" {T}", "#c\nAnn Bee: \u200b "), row(4, T, None), row(5, "", "#c\nAnn Bee: alone"), row(6, "x-1", "#c\nAnn Bee: other\nline"), row(7, T, "#c"),
    ]
    spark.createDataFrame(rows, CHAT).write.parquet(str(tmp_path / "artifacts.parquet"))
    got = {r.thread_id: r.text for r in text_queries.QUERIES["B13_thread_text"](spark, str(tmp_path)).collect()}
    assert got == {T: "Ann Bee: one\n\ntwo: 2\nthree\nBob: four\nfive\nCy: note: six", "x-1": "Ann Bee: other\nline"}


def test_chat_times_are_named_as_in_the_sql(spark, tmp_path):
    rows = [("a1", "slack", "Ann", "x", ("c", T, T, "Ann", "U1")), ("a2", "gmail", "Ann", "x", ("c", T, "m", "Ann", "U2"))]
    spark.createDataFrame(rows, CHAT.replace(">", ",author_user_id:string>")).write.parquet(str(tmp_path / "artifacts.parquet"))
    got = text_queries.QUERIES["B11_slack_times"](spark, str(tmp_path))
    assert [r.asDict() for r in got.collect()] == [{"message_id": T, "at": "2025-02-19T21:20:00+00:00"}]
