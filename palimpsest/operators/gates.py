"""Predicates that let candidates and queries through, or say why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import AFTER, EDGE, stripped, white_words
from ..functions.text import contains_any, jaccard, normalize, token_set

NOT_WORD = r"[^\p{L}\p{N}_.!?]"

# Markers of exchanges that were stored as content.
ECHO_MARKERS = ("user asked:", "assistant responded:", "assistant said:", "question:", "answer:")
# What a model says when it has nothing to say.
NON_ANSWERS = (
    "as an ai, i don't have personal experiences", "as an ai, i do not have personal experiences", "as an ai language model",
    "i don't have access to personal information about you", "i do not have access to personal information about you",
)
# Words of the patterns of style feedback, own authorship and questions to the assistant.
LENGTHS = "short|shorter|long|longer|brief|briefer|concise|verbose|wordy|rambling"
OUTPUTS = "response|reply|replies|message|answer|explanation|paragraph"
TOO_LONG = r"too\s+(?:long|short|verbose|wordy)|so\s+long|way\s+too\s+long"
AUTHORED = "wrote|writing|drafted|drafting|sent|sending|posted|posting|typed|composed|composing|replied|replying|answered|answering"
OPENERS = "tell me|show me|what|which|how|why|do|did|can|could|would|are"
MINDS = r"see|saw|know|think|thought|remember|recall|notice|noticed|have|observe|observed|make of|feel|understand"
LONGEST_META = 120
# Explicit requests for a search, and filler around them.
SEARCH_MARKERS = (
    "search the web", "search online", "look up online", "look this up", "look it up", "google", "find online", "find this online", "find it online",
    "can you find online", "can you find it online", "web search",
)
SEARCH_FILLER = ("please", "now", "thanks", "thank you", "for me", "for it", "for that", "would you", "could you")
# Whole messages that acknowledge, and signals of the outside world.
ACKNOWLEDGEMENTS = (
    "thank you", "thanks", "thank u", "okay", "ok", "k", "got it", "you're welcome", "youre welcome", "you're right", "youre right",
    "i appreciate it", "appreciate it", "no worries", "fair enough", "noted", "sounds good", "makes sense", "understood", "cool", "nice",
)
OUTSIDE_SIGNALS = (
    "weather|forecast|temperature", r"(?:stock|share|crypto|bitcoin|eth)\s+price", r"(?:today'?s?|current|latest)\s+(?:news|headlines|updates)",
    r"live\s+score|standings|who\s+won",
)
FIRST_PERSON = r"my|mine|i'm|i've|i\s+am|i\s+was|i\s+have|i\s+had|i\s+said|i\s+mentioned"
OUTSIDE_ANCHORS = r"weather|price|news|election|score|market|stock|currently\s+in\s+the\s+news|headlines"
# Words of a search that don't count as its content.
SEARCH_STOPWORDS = (
    "the and for are but not you your was were with that this from have has had what whats who whom which when where why how about into than then "
    "them they their there here its just can could would should will did does any all out one get got let hey hello please tell give"
)
# Other systems, marks of their documentation, and questions about them.
SYSTEM_NAMES = (
    "claude", "anthropic", "gpt", "chatgpt", "openai", "gemini", "google deepmind", "llama", "meta ai", "mistral", "copilot", "perplexity", "qwen", "ollama",
)
SYSTEM_DOCS = (
    "training cutoff", "context window", "parameters", "model card", "system prompt", "api documentation", "tokens per", "knowledge cutoff",
    "token limit", "parameter count", "training data",
)
SYSTEM_INQUIRIES = (
    "tell me about claude", "tell me about gpt", "tell me about gemini", "how does claude", "how does gpt", "what is claude", "what is chatgpt",
    "what is openai", "what is anthropic",
)
# Words of a declined topic that don't count, policies that ask for a person's own records, and identity questions.
DECLINE_STOPWORDS = ("my", "the", "this", "that", "a", "an", "his", "her", "their", "our", "its", "about", "with", "from", "and", "or", "of", "in", "on")
PERSONAL_POLICIES = ("status_state", "reflective", "recent_activity", "recent", "factual_recall")
IDENTITY_MARKERS = (
    "know about me", "who am i", "about myself", "tell me about me", "what am i like", "what do you know about", "describe me", "my profile",
    "about yourself", "who are you", "what are you", "describe yourself", "my dog", "my cat", "my pet",
)
# Markers of a short check-in.
CHECK_IN_MARKERS = (
    "i'm tired", "i'm exhausted", "i'm frustrated", "i'm overwhelmed", "i'm anxious", "i'm burned out", "i'm worried", "i'm sad", "how are you",
    "that was a hard", "that was a tough", "good morning", "good evening", "good night", "hey", "hi there", "hello", "thanks", "thank you", "what's up",
    "how's it going",
)
# Capitalised words that aren't names.
NOT_NAMES = (
    "I", "I'm", "I've", "I'll", "I'd", "What", "When", "Where", "Why", "How", "Who", "Which", "The", "This", "That", "These", "Those", "My",
    "Your", "His", "Her", "Their", "Our", "Tell", "Show", "Find", "Look", "Search", "Recall", "Son", "Daughter", "Mother", "Father", "Brother",
    "Sister", "Wife", "Husband", "Partner", "Friend", "Family", "Dog", "Cat", "Pet", "Bird", "Fish", "Horse", "Animal",
)


def word(pattern: str) -> str:
    """The pattern as whole words."""
    return f"{EDGE}(?:{pattern}){AFTER}"


def gap(most: int) -> str:
    """One to ``most`` characters within a clause, between two words."""
    return f"(?:{NOT_WORD}|{NOT_WORD}[^.!?]{{0,{most - 2}}}{NOT_WORD})"


STYLE_FEEDBACK = (
    rf"{EDGE}(?:{LENGTHS})\s+(?:[\p{{L}}\p{{N}}_]+[\s-]+){{0,2}}(?:{OUTPUTS})s?{AFTER}",
    rf"{EDGE}(?:{OUTPUTS})s?{gap(30)}(?:{TOO_LONG}){AFTER}",
)
OWN_WRITING = rf"{EDGE}i\s+(?:[\p{{L}}\p{{N}}_]+\s+){{0,3}}(?:{AUTHORED}){AFTER}"
META_PROMPT = rf"{EDGE}(?:{OPENERS}){gap(60)}you\s+(?:{MINDS}){AFTER}"


def style_feedback(low: Column) -> Column:
    """A short remark on the length or wording of replies, not on what the writer wrote."""
    said = reduce(lambda a, b: a | b, [low.rlike(p) for p in STYLE_FEEDBACK])
    return (F.length(low) <= LONGEST_META) & ~low.rlike(OWN_WRITING) & said


def low_value(content: Column, kind: Column) -> Column:
    """The first reason for which a candidate (lower-cased, white space collapsed) is worth little, or null."""
    return (
        F.when(F.length(content) < 40, "short").when(contains_any(content, NON_ANSWERS), "non_answer")
        .when(style_feedback(content), "style_feedback")
        .when((F.length(content) <= LONGEST_META) & content.rlike(META_PROMPT), "meta_prompt")
        .when((kind == "question") & (F.length(content) < 120), "short_question")
    )


def echo(content: Column, query: Column, most_alike: float = 0.55, assistant: str | None = None) -> Column:
    """The first reason for which a candidate repeats the query or an exchange, or null; both are normalized."""
    markers = ECHO_MARKERS + ((f"{assistant.lower()} responded:",) if assistant else ())
    return (
        F.when(content == "", "empty").when(contains_any(content, markers), "marker").when((query != "") & F.contains(content, query), "verbatim")
        .when(jaccard(token_set(content), token_set(query)) > most_alike, "alike")
    )


def channel_exclusion(raw: Column, content: Column, query: Column) -> Column:
    """The first reason for which a found record doesn't enter its channel, or null."""
    return (
        F.when(contains_any(raw, ("│", "├", "└")), "file_tree").when(F.startswith(content, F.lit("recent themes:")), "digest")
        .when((query != "") & F.contains(content, query), "verbatim").when(jaccard(token_set(content), token_set(query)) > 0.60, "alike")
    )


def bare_search(query: Column) -> Column:
    """Whether a lower-cased query has a search marker and nothing but filler around it.

    Filler phrases are taken from the left, the longest first; as no phrase is another's
    beginning and a part of a third, one pattern for the whole rest says the same.
    """
    out = F.lit(False)
    filler = "|".join(sorted(SEARCH_FILLER, key=len, reverse=True))
    for marker in reversed(SEARCH_MARKERS):
        at = F.instr(query, F.lit(marker))
        rest = F.concat(F.substring(query, F.lit(1), at - 1), F.substring(query, at + len(marker), F.length(query)))
        flat = F.trim(F.regexp_replace(F.regexp_replace(rest, "[,.!?;:]+", " "), r"\s+", " "))
        out = F.when(at > 0, flat.rlike(f"^(?:(?:{filler})(?: |$))*$")).otherwise(out)
    return out


def entity_names(query: Column) -> Column:
    """Lower-cased capitalised words of three letters or more that don't begin a sentence and aren't in the list."""
    inside = F.regexp_replace(query, r"(^|[.!?])\s*[A-Z][a-z]{2,}(?![\p{L}\p{N}_])", "$1")
    words = F.regexp_extract_all(inside, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))
    listed = F.array(*[F.lit(w) for w in NOT_NAMES])
    return F.transform(F.filter(words, lambda w: ~F.array_contains(listed, w)), lambda w: F.lower(w))


def entity_bonus(names: Column, content: Column, each: float = 0.20, most: float = 0.40) -> Column:
    return F.least(F.size(F.filter(names, lambda n: F.contains(content, n))) * F.lit(each), F.lit(most))


def intent_rule(query: Column) -> Column:
    """needs_internet, vault_answerable, or null where no rule applies."""
    low = F.translate(F.lower(query), "‘’", "''")
    said = F.trim(F.regexp_replace(F.trim(low), "[.!?,]+$", ""))
    signal = reduce(lambda a, b: a | b, [low.rlike(word(p)) for p in OUTSIDE_SIGNALS])
    own = F.lower(query).rlike(word(FIRST_PERSON)) & ~low.rlike(word(OUTSIDE_ANCHORS))
    return F.when(said.isin(*ACKNOWLEDGEMENTS), "vault_answerable").when(signal & own, "vault_answerable").when(signal, "needs_internet")


def content_terms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS.split()])
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def low_relevance(hits: DataFrame, query: str, text: Column, result: Column, least: int = 2) -> DataFrame:
    """query and low: whether all of its results share fewer than ``least`` content terms with it.

    A query with fewer terms needs one; one without terms can't be judged and is never low.
    """
    terms = content_terms(text)
    needed = F.when(F.size(terms) >= least, least).otherwise(1)
    low = F.size(F.array_intersect(terms, content_terms(result))) < needed
    return hits.groupBy(query).agg(F.every((F.size(terms) > 0) & low).alias("low"))


def freshness_ranked(hits: DataFrame, query: str, place: str, age_hours: Column, most: int = 5, pool: int = 10, half_life: float = 24.0, floor: float = 0.3) -> DataFrame:
    """The first ``pool`` results of each query by 1 / place times their freshness; the best ``most``.

    ``place`` begins at 1.  Results without an age, or from the future, are fresh.
    """
    fresh = F.when(age_hours.isNull() | (age_hours <= 0), 1.0).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), age_hours / half_life)))
    rows = hits.where(F.col(place) <= pool).withColumn("worth", fresh / F.col(place))
    by = Window.partitionBy(query).orderBy(F.desc("worth"), place)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def quarantined(query: Column, result: Column) -> Column:
    """Whether a result documents another system, unless the query asks about one."""
    q, low = F.lower(query), F.lower(result)
    names = sum(F.contains(low, F.lit(n)).cast("int") for n in SYSTEM_NAMES)
    asked = contains_any(q, SYSTEM_INQUIRIES) | (F.contains(q, F.lit("compare")) & contains_any(q, SYSTEM_NAMES))
    return ~asked & ((names >= 2) | contains_any(low, SYSTEM_DOCS))


def quarantine_status(hits: DataFrame, query: str, flag: str) -> DataFrame:
    """Results that stay and go for each query, and its status."""
    gone = F.sum(F.col(flag).cast("int"))
    status = F.when(gone == F.count("*"), "unavailable/filtered").otherwise("ok")
    return hits.groupBy(query).agg((F.count("*") - gone).alias("safe"), gone.alias("quarantined"), status.alias("status"))


def decline_keywords(topic: Column) -> Column:
    """Words of a declined topic that content must hold all of."""
    stop = F.array(*[F.lit(w) for w in DECLINE_STOPWORDS])
    return F.filter(white_words(F.lower(topic)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def declined(content: Column, topics: Column) -> Column:
    """Whether content holds every word of some topic (an array of arrays of words; empty ones don't count)."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.exists(topics, lambda t: (F.size(t) > 0) & F.forall(t, lambda w: F.contains(low, w)))


def personal_query(policy: Column, text: Column) -> Column:
    return policy.isin(*PERSONAL_POLICIES) | F.coalesce(F.lower(text).rlike(rf"{EDGE}my\s+[\p{{L}}\p{{N}}_]"), F.lit(False))


def check_in(text: Column, markers: tuple[str, ...] = CHECK_IN_MARKERS) -> Column:
    """A short message with one of the conversational markers."""
    low = stripped(F.translate(F.lower(text), "‘’", "''"))
    return (F.length(low) < 100) & contains_any(low, markers)


def identity_query(text: Column, assistant: str | None = None) -> Column:
    own = (f"tell me about {assistant.lower()}", f"who is {assistant.lower()}") if assistant else ()
    return contains_any(F.lower(text), IDENTITY_MARKERS + own)


def type_gate(kind: Column, score: Column, policy: Column, least: float = 0.25) -> Column:
    """Profile rows pass; others must be eligible for the policy and have the least score."""
    eligible = (policy != "task_status") | kind.isin("state", "task", "project", "conversation", "ingested")
    return (kind == "profile") | (eligible & (score >= least))


def zero_hits(delivered: DataFrame, query: str) -> DataFrame:
    """query and empty: whether none of its rows but profile ones scores anything (or there are none)."""
    other = F.col("kind") != "profile"
    worth = F.sum((other & (F.col("score") != 0)).cast("int"))
    return delivered.groupBy(query).agg((worth == 0).alias("empty"))


def first_of_content(rows: DataFrame, query: str, content: Column, order: list, blank: bool) -> DataFrame:
    """The first row of each query for each normalized content; blank contents go unless ``blank``."""
    keyed = rows.withColumn("_key", normalize(content))
    if not blank:
        keyed = keyed.where("_key <> ''")
    first = F.row_number().over(Window.partitionBy(query, "_key").orderBy(*order))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n", "_key")
