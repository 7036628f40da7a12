"""The chat job on small conversations by hand."""

from placewright.plans import chat
from placewright.plans.chat import OUTSIDE, SEE_MORE, chat_answers

PLACES = [(i, f"P{i}", f"Bar {i}", -1.45 + i / 2000, -48.5, ["Bar"], "Bar", 1 + i % 3, 10 * i, 4.0, None, "") for i in range(8)] + [(20, "C0", "Café 0", -1.45, -48.5, ["Cafe"], "Cafe", 1, 5, 4.9, None, "")]
KINDS = "row_id long, place_id string, title string, p_lat double, p_lng double, categories array<string>, category_name string, price long, reviews long, rating double, hours_raw string, address string"
CITY = ((-1.6, -1.4, -48.6, -48.4), "Norte", "UTC")


def test_one_conversation(spark):
    rows = [
        (1, 0, 0, "more", "more", None, None), (1, 1, 1, "bar @ home", None, None, None), (1, 2, 2, "bar near me", None, -1.45, -48.5), (1, 3, 3, "highly rated and cheap", None, None, None),
        (1, 4, 4, "", "more", None, None), (1, 5, 5, "café", None, None, None), (1, 6, 6, "best bar", None, None, None), (1, 7, 7, "", "more", None, None), (1, 8, 8, "one question too many", None, None, None),
        (2, 10, 0, "bar perto daqui", None, 10.0, 10.0),
    ]
    messages = spark.createDataFrame(rows, "session_id long, message_id long, s long, text string, action string, lat double, lng double").selectExpr("*", "timestamp_seconds(1704067200 + s * 60) AS ts")
    places = spark.createDataFrame(PLACES, KINDS)
    keywords = spark.createDataFrame([(0, "bar", "bar"), (1, "cafe", "café")], "ord int, label string, keyword string")
    pairs = spark.createDataFrame([("Bar", "bar"), ("Cafe", "café")], "place_category string, asked string")
    got = {r.message_id: r for r in chat_answers(messages, places, pairs, keywords, *CITY).collect()}
    assert [got[i].status for i in range(9)] == ["no_results", "rejected", "answered", "answered", "no_results", "answered", "answered", "page", "finished"]
    assert [got[i].turns_left for i in range(9)] == [4, 4, 3, 2, 2, 1, 0, 0, 0] and got[1].reason == "bad_chars"
    assert got[2].place_ids == ["P0", "P1", "P2", "P3", "P4"] and got[2].has_more  # by distance, within two kilometres
    assert got[3].place_ids == [] and "couldn't find" in got[3].answer  # still bars near by, with a rating that none has
    assert got[5].place_ids == ["C0"] and got[5].language == "en" and "Open now" in got[5].follow_ups
    assert len(got[6].place_ids) == 5 and got[7].place_ids and not set(got[6].place_ids) & set(got[7].place_ids) and got[7].answer == SEE_MORE["pt-BR"] and not got[7].has_more
    assert got[10].answer.startswith(OUTSIDE["pt-BR"].format(city="Norte")) and len(got[10].place_ids) == 5
    assert chat_answers(messages.limit(0), places, pairs, keywords, *CITY).count() == 0


def test_messages_that_agree_are_searched_once(spark, monkeypatch):
    """Sessions that ask for the same share one search and its places."""
    rows = [(s, s, "best bar") for s in range(40)]
    messages = spark.createDataFrame(rows, "session_id long, message_id long, text string").selectExpr("*", "timestamp_seconds(1704067200 + message_id * 60) AS ts")
    keywords = spark.createDataFrame([(0, "bar", "bar")], "ord int, label string, keyword string")
    pairs = spark.createDataFrame([("Bar", "bar")], "place_category string, asked string")
    sizes, real = {}, chat.written
    monkeypatch.setattr(chat, "written", lambda df, name: sizes.setdefault(name, real(df, name)))
    got = chat_answers(messages, spark.createDataFrame(PLACES, KINDS), pairs, keywords, *CITY).collect()
    assert len(got) == 40 and len({tuple(r.place_ids) for r in got}) == 1 and len(got[0].place_ids) == 5
    assert sizes["answers"].count() == 8  # not 320
