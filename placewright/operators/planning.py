"""Messages to filters, as columns over a table of messages.

Rule mode needs no model. A table of scored intents (message key, intents, confidences), as the text models give, may be joined
in; its columns are then used where the rules leave room for it. Words and phrases come as tables: lexicon (lang, category,
phrase) and keywords (kind, label, keyword).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import fold, nfc
from placewright.operators.evaluation import phrase_grams, word_counts
from placewright.tables import spread

MAX_LEN, STRENGTH = 400, 0.3
#: Phrases of one automaton, some 20 MB.
PART_PHRASES = 50_000

# Words that only Portuguese has.
PT_WORDS = (
    "pra", "num", "numa", "nuns", "numas", "uns", "umas", "quero", "preciso", "busco", "procuro", "bora", "vou", "tem", "temos", "fica", "ficam",
    "funciona", "funcionam", "aberto", "aberta", "fechado", "perto", "aqui", "daqui", "agora", "hoje", "amanha", "ontem", "junto", "tudo", "nada",
    "muito", "pouco", "mais", "menos", "lugar", "lugares", "restaurante", "restaurantes", "lanchonete", "padaria", "sorveteria", "churrascaria",
    "pizzaria", "hamburgueria", "farmacia", "clinica", "academia", "barbearia", "salao", "petshop", "veterinario", "balada", "boate", "brinquedoteca",
    "parquinho", "quadra", "oficina", "mecanica", "borracharia", "funilaria", "manicure", "pedicure", "cabeleireiro", "maquiagem", "depilacao",
    "almoco", "jantar", "manha", "noite", "barato", "caro", "preco", "nota", "avaliacao", "horario", "funcionamento", "entrega", "delivery",
    "cardapio", "ou", "mas", "porque", "quando", "onde", "como", "qual", "quais", "massa", "gelada", "tira", "gosto", "tipo", "sabe", "cara",
)
# Phrases and words of nearness.
NEAR_PHRASES = (
    "perto de mim", "perto daqui", "perto daki", "aqui perto", "ai perto", "ali perto", "por aqui", "por perto", "perto de casa", "perto da", "perto do", "na minha regiao", "na minha area",
    "near me", "around here", "close to me", "walking distance", "aqui pertinho", "ai pertinho", "ali pertinho", "por aqui pertinho", "pra perto", "pra ca", "na minha rua",
    "na minha vizinhanca", "no meu bairro", "no meu bairo", "no meu role",
)
NEAR_WORDS = ("perto", "proximo", "proxima", "aqui", "daqui", "daki", "nearby", "nearest", "closest", "near", "close", "pertinho", "pertim", "pertinin", "pertico")
# Phrases and words of opening hours.
OPEN_PHRASES = (
    "aberto agora", "aberta agora", "aberto neste momento", "aberto agora mesmo", "funcionando agora", "funcionando neste momento", "aberto 24", "que esteja aberto", "que estejam abertos",
    "ainda aberto", "ainda abre", "ainda funciona", "aberto hoje", "aberto no momento", "open now", "currently open", "open right now", "open 24", "still open", "open at this time", "open today",
    "vinte e quatro horas", "24 horas", "24hrs", "24hr", "24/7", "24h",
)
CLOSED_PHRASES = ("fechado agora", "fechado hoje", "closed now", "currently closed")
OPEN_WORDS = ("open", "aberto", "aberta", "abertos", "abertas", "funcionando")
CLOSED_WORDS = ("closed", "fechado", "fechada", "fechados", "fechadas")
OTHER_TIME = (
    r"\b(hoje|today|amanha|tomorrow|tonight|noite|feriado|fim de semana|weekend|domingo|segunda|terca|quarta|quinta|sexta|sabado|"
    r"sunday|monday|tuesday|wednesday|thursday|friday|saturday)\b|\b(?:as|at) \d|\b(?!24)\d{1,2}\s*h\b"
)
NOW_WORDS = r"\b(agora|now|neste momento|no momento|currently)\b"
# Number patterns and wordings of price, rating and review count, in the order in which they apply.
PRICE_PATTERNS = (r"price\s*[<=]\s*(\d+)", r"preco\s*[<=]\s*(\d+)", r"\$\s*(\d+)", r"ate\s*(\d+)")
CHEAP = ("barato", "barata", "economico", "economica", "em conta", "bom preco", "preco bom", "acessivel", "custo beneficio", "nao muito caro", "preco baixo", "cheap", "inexpensive", "affordable", "budget", "low cost", "low-cost")
LUXURY = ("caro", "luxo", "premium", "sofisticado", "requintado", "expensive", "luxury", "upscale", "fine dining", "high-end")
RATING_PATTERNS = (
    r"(\d+\.?\d*)\s*\+", r"rating\s*[>=]+\s*(\d+\.?\d*)", r"nota\s*[>=]+\s*(\d+\.?\d*)", r"nota\s+acima\s+de\s+(\d+\.?\d*)", r"acima\s+de\s+(\d+\.?\d*)\s*estrela",
    r"pelo\s+menos\s+(\d+\.?\d*)\s*estrela", r"minimo\s+de\s+(\d+\.?\d*)", r"no\s+minimo\s+(\d+\.?\d*)", r"(\d+\.?\d*)\s*estrelas?\s+ou\s+mais", r"score\s*[>=]+\s*(\d+\.?\d*)",
)
RATING_TERMS = (
    ("altamente avaliado", 4.5), ("muito bem avaliado", 4.5), ("bem avaliado", 4.0), ("excelente", 4.5), ("otimo", 4.0), ("muito bom", 4.0), ("muito boa", 4.0), ("muito bons", 4.0), ("top avaliado", 4.5),
    ("melhor avaliado", 4.5), ("highly rated", 4.5), ("top rated", 4.5), ("best rated", 4.5), ("well rated", 4.0), ("great", 4.0), ("excellent", 4.5),
)
REVIEW_PATTERNS = (r"(\d+)\s*reviews", r"at least\s*(\d+)\s*reviews")
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "o", "os", "as", "de", "da", "do", "das", "dos", "em", "para", "com", "por")
# Routing words, rule-mode words, and the place type and next suggestion of each category.
ROUTES = (("compare_places", ("compare", "comparar", "diferenca", "difference")), ("help", ("help", "ajuda", "como", "how")), ("smalltalk", ("hello", "hi", "oi", "thanks", "obrigado")), ("place_details", ("what is", "tell me about")))
RULES = (("location", ("near", "close", "perto")), ("popularity", ("best", "top", "popular", "melhor")), ("business_hours", ("open", "hours", "aberto")), ("price", ("cheap", "price", "barato")))
PLACE_TYPES = {"restaurant": "restaurant", "bar": "bar", "tourist_attraction": "park", "acai": "restaurant", "cafe": "restaurant", "hotel": "other", "shopping": "other", "entertainment": "other", "ice_cream": "restaurant"}
SIBLINGS = {"restaurant": "cafe", "bar": "restaurant", "cafe": "acai", "acai": "ice_cream", "ice_cream": "cafe", "hotel": "restaurant"}
SPELLINGS = {"sorvete": "ice_cream", "sorveteria": "ice_cream"}
CHIPS = {"en": {"open": "Open now", "near": "Closest to me", "top": "Top rated"}, "pt-BR": {"open": "Abertos agora", "near": "Mais perto de mim", "top": "Mais bem avaliados"}}
LABELS = {
    "en": {"restaurant": "Restaurants", "cafe": "Cafés", "acai": "Açaí", "ice_cream": "Ice cream", "bar": "Bars"},
    "pt-BR": {"restaurant": "Restaurantes", "cafe": "Cafés", "acai": "Açaí", "ice_cream": "Sorveterias", "bar": "Bares"},
}
REASONS = {
    "en": {"empty": "Type a question.", "too_long": f"A question can be at most {MAX_LEN} characters long.", "bad_chars": "Use only letters, digits, spaces and the marks , . : ? !"},
    "pt-BR": {"empty": "Escreva uma pergunta.", "too_long": f"A pergunta pode ter no máximo {MAX_LEN} caracteres.", "bad_chars": "Use apenas letras, números, espaços e os sinais , . : ? !"},
}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def holds_any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def holds_word(text: Column, words) -> Column:
    return F.rlike(text, F.lit(r"\b(" + "|".join(words) + r")\b"))


def gate_messages(df: DataFrame, text: str = "text", max_len: int = MAX_LEN, language: str = "en", normalise: bool = True) -> DataFrame:
    """Adds clean (the text as it goes on, or null), reason (too_long, bad_chars, empty, or null) and explanation."""
    raw = F.coalesce(F.col(text), F.lit(""))
    body = nfc(raw) if normalise else raw
    rows = df.withColumn("__text", F.when(F.char_length(raw) <= 4 * max_len, body))
    clean = F.trim(F.regexp_replace("__text", r"\s+", " "))
    reason = (
        F.when(F.col("__text").isNull(), "too_long").when(~F.rlike("__text", F.lit(r"^[\p{L}\p{N} ,.:?!]*$")), "bad_chars").when(clean == "", "empty").when(F.char_length(clean) > max_len, "too_long")
    )
    out = rows.withColumns({"reason": reason, "clean": F.when(reason.isNull(), clean)})
    return out.withColumn("explanation", lookup(REASONS[language], F.col("reason"))).drop("__text")


def detect_language(text: Column, explicit: Column | None = None) -> Column:
    words = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, PT_WORDS))), "pt-BR").otherwise("en")
    if explicit is None:
        return found
    return F.when(F.coalesce(explicit, F.lit("")) == "", found).when(F.lower(explicit).isin("pt", "pt-br", "pt_br"), "pt-BR").otherwise("en")


def coarse_intent(folded: Column) -> Column:
    out = F.lit("find_places")
    for name, words in reversed(ROUTES):
        out = F.when(holds_any(folded, words), name).otherwise(out)
    return out


def rule_intents(folded: Column) -> Column:
    return F.array_compact(F.array(*[F.when(holds_any(folded, words), name) for name, words in RULES]))


def rule_category(folded: Column) -> Column:
    return F.when(holds_any(folded, ("bar", "pub")), "bar").when(holds_any(folded, ("hotel", "motel")), "hotel").when(holds_any(folded, ("park", "parque")), "tourist_attraction").otherwise("restaurant")


def extract_open_now(folded: Column, hours_confidence: Column | None = None) -> Column:
    """True, or null: it is never said that places must be closed."""
    phrase = ~holds_any(folded, CLOSED_PHRASES) & holds_any(folded, OPEN_PHRASES)
    hit = phrase | F.rlike(folded, F.lit(r"\babert[oa]s?\b"))
    if hours_confidence is not None:
        hit = hit | ((F.coalesce(hours_confidence, F.lit(0.0)) >= STRENGTH) & holds_any(folded, OPEN_WORDS) & ~holds_any(folded, CLOSED_WORDS))
    other = F.rlike(folded, F.lit(OTHER_TIME)) & ~F.rlike(folded, F.lit(NOW_WORDS))
    return F.when(hit & ~other, F.lit(True))


def extract_proximity(folded: Column, location_confidence: Column | None = None) -> Column:
    hit = holds_any(folded, NEAR_PHRASES) | holds_word(folded, NEAR_WORDS)
    model = F.array_contains(rule_intents(folded), "location") if location_confidence is None else F.coalesce(location_confidence, F.lit(0.0)) >= STRENGTH
    return hit | model


def first_number(text: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns])


def extract_price_max(folded: Column) -> Column:
    return F.coalesce(first_number(folded, PRICE_PATTERNS), F.when(holds_any(folded, CHEAP), 2.0).when(holds_any(folded, LUXURY), 4.0))


def extract_min_rating(folded: Column) -> Column:
    term = F.lit(None).cast("double")
    for phrase, value in reversed(RATING_TERMS):
        term = F.when(F.contains(folded, F.lit(phrase)), value).otherwise(term)
    return F.coalesce(first_number(folded, RATING_PATTERNS), term)


def extract_min_reviews(folded: Column) -> Column:
    return first_number(folded, REVIEW_PATTERNS).cast("long")


def extract_keywords(text: Column, most: int = 10) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.char_length(w) > 2)), 1, most)


def sort_preference(folded: Column, near: Column, located: Column, primary: Column | None = None, confidence: Column | None = None, popularity: Column | None = None) -> Column:
    """distance if nearness was asked for and there is a location; with scored intents popularity or rating; else best_match."""
    out = F.when(near & located, "distance")
    if primary is not None:
        popular = (primary == "popularity") & (confidence >= STRENGTH) | (primary == "business_hours") & (F.coalesce(popularity, F.lit(0.0)) >= STRENGTH)
        out = out.when(popular, "popularity").when((primary == "popularity") & holds_any(folded, ("best", "top", "melhor", "rating", "rated", "nota", "avaliado")), "rating")
    return out.otherwise("best_match")


def scan_lexicon(messages: DataFrame, lexicon: DataFrame, key: str = "message_id", text: str = "folded", part_phrases: int = PART_PHRASES) -> DataFrame:
    """(key, category, phrase) of the phrases that stand anywhere in a message's text.

    The phrases are cut into parts of part_phrases, each an automaton that reads a text once, letter by letter, whatever the number of phrases; a part is what
    is broadcast at once, and each part reads the messages once. Null texts hold nothing, and empty phrases are none."""
    spark = messages.sparkSession
    phrases = lexicon.select("category", fold(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    count = phrases.select(F.count_distinct("phrase")).first()[0]
    parts = max(1, -(-count // part_phrases))
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    rows = messages.select(key, text)
    schema = rows.select(key).schema.add("category", "string").add("phrase", "string")

    def scan(part: int) -> DataFrame:
        of: dict[str, list[str]] = {}
        for r in phrases.where(part_of == part).collect():
            of.setdefault(r.phrase, []).append(r.category)
        shared = spark.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for phrase, categories in shared.value.items():
                automaton.add_word(phrase, (phrase, categories))
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    if body and shared.value:
                        hits = {phrase: categories for _, (phrase, categories) in automaton.iter(body)}
                        pairs = [(category, phrase) for phrase, categories in hits.items() for category in categories]
                        at += [i] * len(pairs)
                        found += pairs
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([f[k] for f in found], pa.string()) for k in range(2)]]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(scan, range(parts))).distinct()


def scan_keywords(messages: DataFrame, keywords: DataFrame, key: str = "message_id", text: str = "folded", part_phrases: int = PART_PHRASES) -> DataFrame:
    """(key, label, keyword) of the keywords that stand in a message as whole words, the last one perhaps in the plural (s or es).

    The messages are dealt evenly, as a small file may hold many, and only those of a message's word sequences leave it that a part's set of forms has, so that
    neither its other words nor a frequent keyword's messages meet in one task. A part has at most part_phrases forms; each reads the messages once."""
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), " ")
    plain = keywords.select("label", F.lower("keyword").alias("keyword"), F.trim(F.regexp_replace(fold(F.col("keyword")), r"[^\p{L}\p{N}_]+", " ")).alias("k"))
    forms = plain.select("label", "keyword", F.explode(F.array("k", F.concat("k", F.lit("s")), F.concat("k", F.lit("es")))).alias("gram")).distinct()
    rows = spread(messages.select(key, text), key).select(key, words.alias("ws"))
    grams = rows.select(key, F.explode(F.array_distinct(phrase_grams("ws", word_counts(plain, "k")))).alias("gram"))
    parts = max(1, -(-forms.count() // part_phrases))
    part_of = F.pmod(F.xxhash64("gram", "label", "keyword"), F.lit(parts))
    found = [grams.join(F.broadcast(forms.where(part_of == part)), "gram") for part in range(parts)]
    return reduce(DataFrame.unionByName, found).select(key, "label", "keyword").distinct()


def union_terms(terms: DataFrame, key: str = "message_id", term: str = "term", order: str = "ord") -> DataFrame:
    """(key, terms): all terms in order, the first spelling of each folded form."""
    first = terms.groupBy(key, fold(F.col(term)).alias("__f")).agg(F.min(F.struct(order, term)).alias("t"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t[term]).alias("terms"))


def canonical(categories: Column) -> Column:
    """The first of a list of categories that has a sibling to suggest, by its canonical spelling."""
    keys = F.transform(categories, lambda c: F.replace(fold(c), F.lit(" "), F.lit("_")))
    keys = F.transform(keys, lambda k: F.coalesce(lookup(SPELLINGS, k), k))
    return F.get(F.filter(keys, lambda k: k.isin(*SIBLINGS)), F.lit(0))


def follow_up_chips(category: Column, open_now: Column, near: Column, min_rating: Column, located: Column, language: str = "en") -> Column:
    """Up to three suggestions; a filter that is set isn't suggested again."""
    key = F.replace(fold(category), F.lit(" "), F.lit("_"))
    key = F.coalesce(lookup(SPELLINGS, key), key)
    first = F.coalesce(lookup(SIBLINGS, key), F.lit("restaurant"))
    chips, labels = CHIPS[language], LABELS[language]
    set_ = lambda c: F.coalesce(c, F.lit(False))
    listed = F.array(
        F.when(~set_(open_now), chips["open"]), F.when(located & ~set_(near), chips["near"]), lookup(labels, first),
        F.when(F.coalesce(min_rating, F.lit(0.0)) == 0, chips["top"]), lookup(labels, lookup(SIBLINGS, first)),
    )
    return F.slice(F.array_compact(listed), 1, 3)


def intent_confidences(scored: DataFrame, key: str = "message_id") -> DataFrame:
    """From a model's labels (key, kind: intent or category, label, confidence; the few best of each message): primary_intent and its confidence, the
    confidences that slots look at, and primary_category."""
    conf = lambda label: F.max(F.when((F.col("kind") == "intent") & (F.col("label") == label), F.col("confidence")))
    best = lambda kind: F.max_by("label", F.when(F.col("kind") == kind, F.struct("confidence", F.lit(1))))
    return scored.groupBy(key).agg(
        best("intent").alias("primary_intent"), F.max(F.when(F.col("kind") == "intent", F.col("confidence"))).alias("primary_confidence"),
        conf("business_hours").alias("hours_confidence"), conf("location").alias("location_confidence"), conf("popularity").alias("popularity_confidence"),
        best("category").alias("primary_category"),
    )


def extract_categories(messages: DataFrame, keywords: DataFrame, lexicon: DataFrame | None = None, scored: DataFrame | None = None, key: str = "message_id", text: str = "folded") -> DataFrame:
    """(key, terms): the keywords that a message has, then all keywords of the categories whose phrases it has, then those of its secondary categories of
    confidence STRENGTH or more; the first spelling of each folded form. keywords: ord, label (category), keyword; lexicon: category, phrase."""
    typed = scan_keywords(messages, keywords, key, text).join(keywords.select("label", F.lower("keyword").alias("keyword"), "ord").hint("merge"), ["label", "keyword"])
    terms = typed.select(key, F.col("keyword").alias("term"), F.struct(F.lit(1).alias("source"), F.lit(0.0).alias("rank"), "ord").alias("ord"))
    vocabulary = keywords.select(F.col("label").alias("category"), F.lower("keyword").alias("term"), F.col("ord").alias("at"))
    found = []
    if lexicon is not None:
        found.append(scan_lexicon(messages, lexicon, key, text).select(key, "category", F.lit(2).alias("source"), F.lit(0.0).alias("rank")).distinct())
    if scored is not None:
        labels = scored.where((F.col("kind") == "category") & (F.col("confidence") >= STRENGTH))
        first = intent_confidences(scored, key).select(key, "primary_category")
        labels = labels.join(first.hint("merge"), key).where(F.col("label") != F.col("primary_category"))
        found.append(labels.select(key, F.col("label").alias("category"), F.lit(3).alias("source"), (-F.col("confidence")).alias("rank")))
    for hits in found:
        wider = hits.join(vocabulary.hint("merge"), "category")
        terms = terms.unionByName(wider.select(key, "term", F.struct("source", "rank", F.col("at").alias("ord")).alias("ord")))
    return union_terms(terms, key)


def plan_messages(messages: DataFrame, located: Column | None = None, text: str = "text", scored: DataFrame | None = None, key: str = "message_id") -> DataFrame:
    """Plans: the messages with one column for each slot. Rules decide alone, or together with a model's labels in `scored` (see intent_confidences), whose
    primary category is the plan's; a message without labels there gets what rules say of it, and best_match or distance."""
    located = F.lit(False) if located is None else located
    rows = messages.withColumn("folded", fold(F.col(text)))
    f = F.col("folded")
    hours = near = primary = confidence = popularity = None
    category = rule_category(f)
    if scored is not None:
        rows = rows.join(intent_confidences(scored, key).hint("merge"), key, "left")
        hours, primary, confidence, popularity = (F.col(c) for c in ("hours_confidence", "primary_intent", "primary_confidence", "popularity_confidence"))
        near = F.when(primary.isNull(), F.array_contains(rule_intents(f), "location").cast("double")).otherwise(F.col("location_confidence"))
        category = F.coalesce("primary_category", category)
    rows = rows.withColumns({
        "language": detect_language(F.col(text)), "intent": coarse_intent(f), "category": category, "open_now": extract_open_now(f, hours), "price_max": extract_price_max(f),
        "min_rating": extract_min_rating(f), "min_reviews": extract_min_reviews(f), "keywords": extract_keywords(F.col(text)), "near_me": extract_proximity(f, near),
    })
    rows = rows.withColumns({"place_type": lookup(PLACE_TYPES, F.col("category")), "sort_preference": sort_preference(f, F.col("near_me"), located, primary, confidence, popularity)})
    signals = F.array_compact(F.array(
        F.when(F.col("place_type").isNotNull(), F.concat(F.lit("place_type="), "place_type")), F.when(F.coalesce("open_now", F.lit(False)), "open_now=true"),
        F.when(F.coalesce("price_max", F.lit(0.0)) != 0, F.concat(F.lit("price_max="), F.col("price_max").cast("string"))),
        F.when(F.coalesce("min_rating", F.lit(0.0)) != 0, F.concat(F.lit("min_rating="), F.col("min_rating").cast("string"))), F.when(F.col("sort_preference") != "best_match", F.concat(F.lit("sort="), "sort_preference")),
    ))
    return rows.withColumn("signals", signals)
