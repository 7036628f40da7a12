"""A table of chat messages to answers, in one lineage: gate, turns, plan, inherited slots, places, text and suggestions.

Messages of a session are taken in order of (ts, message_id). A message that the gate rejects spends no turn and leaves nothing behind; `more` is free
and gives the next page of the session's last answered question. Of the others the first `questions` are answered, later ones are finished.
A message's slots come from its text; explicit filters of the message replace them; what is then unset is inherited from the session's answered questions
before it, unless the message names a kind of place. A location outside the city is cleared, and only counts where nearness was asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.text import fold
from placewright.operators import conversations, planning, search
from placewright.plans.answer import shared_answers
from placewright.tables import written

# What is said before an answer when the location lies outside the city, and with a further page.
OUTSIDE = {
    "pt-BR": "A busca por proximidade só funciona em {city}, e você não parece estar aqui. Estes são lugares de toda a cidade.",
    "en": "Searching near you only works in {city}, and you don't seem to be here. These are places from across the city.",
}
SEE_MORE = {"pt-BR": "Mais lugares da sua última busca.", "en": "More places from your last search."}

#: What a message may bring besides session_id, message_id, ts and text; given_… are explicit filters.
OPTIONAL = {
    "action": "string", "language": "string", "lat": "double", "lng": "double", "given_place_type": "array<string>", "given_open_now": "boolean", "given_price_max": "double", "given_min_rating": "double",
    "given_min_reviews": "long",
}
SLOTS = ("place_type", "open_now", "price_max", "min_rating", "min_reviews", "at", "near_me", "keywords")
ORDER = ("ts", "message_id")


def turns_of(messages: DataFrame, questions: int = conversations.QUESTIONS) -> DataFrame:
    """The messages with clean, reason, kind (rejected, more, answered, finished), turns_left, and for `more` the question and page that it asks for."""
    given = set(messages.columns)
    rows = planning.gate_messages(messages.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in given}))
    more = F.coalesce(F.col("action") == "more", F.lit(False))
    asks = ~more & F.col("reason").isNull()
    of = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("asked", F.sum(asks.cast("int")).over(of))
    kind = F.when(more, "more").when(~asks, "rejected").when(F.col("asked") <= questions, "answered").otherwise("finished")
    rows = rows.withColumns({"kind": kind, "turns_left": F.greatest(questions - F.col("asked"), F.lit(0)), "answers": F.least("asked", F.lit(questions))})
    source = F.last(F.when(F.col("kind") == "answered", F.col("message_id")), ignorenulls=True).over(of)
    since = Window.partitionBy("session_id", "answers").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    page = F.when(more, F.sum(more.cast("int")).over(since) + 1).otherwise(1)
    return rows.withColumns({"source": source, "page": page}).drop("asked", "answers")


def slots_of(turns: DataFrame, keywords: DataFrame, bounds: tuple[float, float, float, float], lexicon: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """The answered messages with language, outside_notice, here (a location inside the city), and the slots of their search: what they set, or else inherit."""
    asked = turns.where("kind = 'answered'").select("session_id", *ORDER, F.col("clean").alias("text"), *OPTIONAL)
    asked = search.drop_outside_location(asked.withColumn("always", F.lit(True)), bounds, "always").withColumnRenamed("outside_notice", "outside")
    here = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    plans = planning.plan_messages(asked.withColumnRenamed("language", "explicit"), here, scored=scored).withColumn("language", planning.detect_language(F.col("text"), F.col("explicit")))
    terms = planning.extract_categories(asked.select("message_id", fold(F.col("text")).alias("folded")), keywords, lexicon, scored)
    plans = plans.join(terms.select("message_id", F.col("terms").alias("categories")).hint("merge"), "message_id", "left").withColumn("place_type", F.when(F.col("place_type").isNotNull(), F.array("place_type")))
    plans = search.override_slots(plans, {c: f"given_{c}" for c in ("place_type", "open_now", "price_max", "min_rating", "min_reviews")})
    plans = plans.withColumns({"at": F.when(F.col("near_me") & here, F.struct("lat", "lng")), "here": here, "outside_notice": F.col("outside") & F.col("near_me")})
    kept = plans.select("session_id", *ORDER, "language", "here", "outside_notice", "sort_preference", "categories", *SLOTS)
    return conversations.merge_turns(kept, order=ORDER, category="categories", slots=SLOTS)


def chat_answers(
    messages: DataFrame, places: DataFrame, category_pairs: DataFrame, keywords: DataFrame, bounds: tuple[float, float, float, float], city: str, timezone: str,
    lexicon: DataFrame | None = None, scored: DataFrame | None = None, questions: int = conversations.QUESTIONS,
) -> DataFrame:
    """One row for each message: message_id, status (answered, page, no_results, finished, rejected), reason, language, answer, place_ids of the page, has_more,
    turns_left and follow_ups.

    messages: session_id, message_id, ts (UTC), text, and any of OPTIONAL. places as for answer_questions; category_pairs match what keywords and place types ask
    for. keywords: ord, label, keyword; lexicon: category, phrase; scored: a model's labels (see intent_confidences)."""
    turns = written(turns_of(messages, questions), "turns")
    slots = written(slots_of(turns, keywords, bounds, lexicon, scored), "slots")
    day, second = conversations.local_clock(F.col("ts"), timezone)
    asked = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.col("place_type"))
    search_for = slots.select(
        F.col("message_id").alias("question_id"), F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), F.coalesce("near_me", F.lit(False)).alias("near_me"), day.alias("day_idx"),
        second.alias("sec_of_day"), F.coalesce("open_now", F.lit(False)).alias("open_now"), asked.alias("category"), "price_max", "min_rating", "sort_preference", "language",
    )
    # what messages agree in is searched for, rendered and listed once
    asks, found = shared_answers(search_for.drop("language"), written(places, "catalog"), category_pairs)
    asks, found = written(asks.withColumnRenamed("question_id", "message_id"), "asked"), written(found, "answers")
    slots = slots.join(asks.hint("merge"), "message_id", "left")
    texts = [search.render_answers(found, slots.where(F.col("language") == lang).select("ask").distinct(), lang, "ask").withColumn("language", F.lit(lang)) for lang in search.ANSWER]
    listed = found.groupBy("ask").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "place_id"))), lambda p: p["place_id"]).alias("ids"))
    chips = lambda lang: planning.follow_up_chips(planning.canonical(F.col("categories")), F.col("open_now"), F.col("near_me"), F.col("min_rating"), F.col("here"), lang)
    said = slots.join(reduce(DataFrame.unionByName, texts).join(listed.hint("merge"), "ask", "left").hint("merge"), ["ask", "language"])
    notice = F.when(F.col("outside_notice"), F.concat(F.when(F.col("language") == "en", OUTSIDE["en"].format(city=city)).otherwise(OUTSIDE["pt-BR"].format(city=city)), F.lit("\n\n"))).otherwise("")
    said = said.select(F.col("message_id").alias("source"), "language", F.concat(notice, "answer").alias("answer"), F.when(F.col("language") == "en", chips("en")).otherwise(chips("pt-BR")).alias("follow_ups"), "ids")
    rows = turns.select("message_id", "kind", "reason", F.col("language").alias("explicit"), "turns_left", "source", "page")
    rows = rows.join(said.hint("merge"), "source", "left")
    shows = F.col("kind").isin("answered", "more")
    ids = F.when(shows, F.coalesce("ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    size = F.lit(search.SHOWN)
    rows = rows.withColumns({"ids": ids, "place_ids": F.slice(ids, (F.col("page") - 1) * size + 1, size)})
    own, other = F.col("kind") == "answered", F.col("kind") == "more"
    status = F.when(other & (F.size("ids") == 0), "no_results").when(other, "page").otherwise(F.col("kind"))
    line = F.when(F.lower(F.coalesce("explicit", F.lit("pt-BR"))) == "en", SEE_MORE["en"]).otherwise(SEE_MORE["pt-BR"])
    return rows.select(
        "message_id", status.alias("status"), "reason", F.when(own, F.col("language")).alias("language"), F.when(own, F.col("answer")).when(status == "page", line).alias("answer"), "place_ids",
        (shows & (F.size("ids") > F.col("page") * size)).alias("has_more"), "turns_left", F.when(own, F.col("follow_ups")).alias("follow_ups"),
    )
