"""Detectors of phrases in replies, messages and derived records, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import AFTER, EDGE, stripped, white_words
from ..functions.text import capital_letter, contains_any, starts_any
from .gates import style_feedback

# Promises in the order in which they are tried, and phrases of mere offers.
COMMITMENTS = (
    "i'll walk you through", "i'll help you with", "i'll follow up", "i'll check on", "i'll look into", "i'll get back to you", "i'll make sure",
    "i'll keep track", "i'll remind you", "i'll put together", "i'll draft", "i'll prepare", "i'll send you", "i'll find", "i'll research",
    "let's go through this", "let's work through", "let's tackle", "let's start with", "we'll go through", "we'll work on", "we'll come back to",
    "we can revisit", "here's your plan", "here's your order for the day", "here's what we'll do", "here are the steps", "first we'll", "next time we",
    "when you're ready", "tomorrow we", "next session", "next time", "i want to follow up", "remind me to",
)
OFFERS = (
    "i can help with", "i'd be happy to", "feel free to", "let me know if", "if you'd like", "i could", "you might want to", "that sounds",
    "here's some information",
)
# Phrases that suggest a task in the order in which they are tried, and phrases of explanations.
TASKS = (
    "i'll set up", "i'll create", "i'll build", "i'll write", "i'll implement", "i'll add", "i'll fix", "i'll update", "i'll refactor", "i'll test",
    "i'll configure", "i'll migrate", "here's the plan:", "here's what needs to happen:", "the steps are:", "action items:", "todo:", "to-do:",
    "you should", "you need to", "you'll want to", "make sure to", "don't forget to", "remember to",
)
EXPLANATIONS = (
    "you could", "you might", "if you want", "one option is", "for example", "in general", "typically", "here's how", "here's an example",
    "this is because", "the reason is", "that means",
)
TITLE_FILLER = (
    "i'll ", "i will ", "i need to ", "i want to ", "i should ", "i have to ", "you should ", "you need to ", "you'll want to ", "make sure to ",
    "don't forget to ", "remember to ", "me to ", "please ", "can you ", "could you ",
)
# Explicit requests for tasks in the order in which they are tried, and filler before their titles.
TASK_REQUESTS = (
    r"(?:can you |please |could you )?create (?:a )?tasks? (?:for |to |called |named |about )(.+)",
    r"(?:can you |please |could you )?add (?:a )?tasks? (?:for |to |called |named |about )(.+)",
    r"(?:can you |please |could you )?make (?:a )?tasks? (?:for |to |called |named |about )(.+)",
    r"i need (?:a )?tasks? (?:for |to |called |named |about )(.+)",
    r"new tasks?(?:: ?| (?:for |to |called |named |about ))(.+)",
    r"track (.+?) as (?:a )?tasks?",
    r"(?:add|put) (.+?) (?:to|on) my task list",
    r"remind me(?:\s+[^,]*?)? to (.+)",
    r"i need to remember to (.+)",
)
REQUEST_FILLER = (
    "me to ", "i need to remember to ", "i need to ", "i want to ", "i should ", "i have to ", "i'll ", "i will ", "you should ", "you need to ",
    "you'll want to ", "make sure to ", "don't forget to ", "remember to ", "remind me to ", "please ", "can you ", "could you ",
)
# Objections to questions, and declines of a topic in the order in which they are tried.
QUESTION_OBJECTIONS = (
    "stop asking", "don't ask me", "don't ask questions", "quit asking", "no more questions", "stop with the questions", "i don't want questions",
    "please don't ask", "enough questions", "stop ending with questions", "don't end with a question",
)
TOPIC_DECLINES = (
    "i don't want to talk about", "i don't want to discuss", "drop it", "let's move on", "can we change the subject", "i'd rather not",
    "stop bringing that up", "let it go", "not interested in that", "i said no", "i already said", "please stop", "enough about", "can we not",
)
# Runtime output and assistant filler that is no material for a reflection, code, and openings of filler.
REFLECTION_NOISE = (
    "uvicorn src.api.main:app --reload", "uvicorn src.api.asgi:app", "info:", "traceback", 'file "c:\\', ", line ", "module>", "(.venv)", "powershell",
    "ps c:\\", "warning:", "loading weights:", "bertmodel load report", "embeddings.position_ids", "press ctrl+c to quit", "application startup complete",
    "started server process", "started reloader process", "waiting for application startup", "there is no earlier conversation",
    "no conversation summary", "i understand you're seeking", "i understand you are seeking", "seeking clarity", "response length", "let me clarify",
    "what would you like to discuss", "i'm here to support", "i'm here to help", "how can i assist",
)
CODE_MARKERS = (
    "import ", "from src.", "def ", "class ", "return ", "traceback", 'file "', "line ", "uvicorn", "http/1.1", "ps c:\\", "(.venv)",
)
FILLER_OPENINGS = (
    "i can ", "i would ", "i think we ", "i'm happy to", "i'd be happy", "i understand ", "i appreciate ", "i see that", "i notice that",
    "i can help", "i'd suggest", "i'd recommend",
)
# Filler in stored reflections.
JUNK_MARKERS = (
    "there is no earlier conversation", "no conversation summary", "i understand you're seeking", "i understand you are seeking", "seeking clarity",
    "what would you like to discuss", "i'm here to support", "i'm here to help", "how can i assist", "let me clarify",
)
# Rules by which assistant chunks are noise, in order.
NOISE_RULES = {
    "json": ('{"queries":', "citeturn"),
    "tool_narration": ("let me try", "i'll use a tool", "let me use", "let's proceed with"),
    "warmth_filler": ("rest easy", "talk soon", "you've done enough", "i'm always here", "take care of yourself"),
    "short": (),
    "self_reference": ("as an ai", "as an artificial", "i get to experience"),
}


def marker_count(text: Column, markers) -> Column:
    return sum(F.contains(text, F.lit(m)).cast("int") for m in markers)


def sentence_with(text: Column, marker: str) -> Column:
    """The sentence around the first occurrence of a lower-case marker."""
    at = F.instr(F.lower(text), F.lit(marker))
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"[^.!?\n]*$", 0)
    after = F.regexp_extract(F.substring(text, at + len(marker), F.length(text)), r"^[^.!?\n]*[.!?\n]?", 0)
    return stripped(F.concat(before, F.substring(text, at, F.lit(len(marker))), after))


def _first(text: Column, markers, against, made) -> Column:
    """made(marker) for the first marker in the text, unless two of the ``against`` ones are in it; null otherwise."""
    low = F.lower(text)
    out = None
    for m in markers:
        test = F.contains(low, F.lit(m))
        out = F.when(test, made(m)) if out is None else out.when(test, made(m))
    return F.when((F.length(stripped(text)) >= 20) & (marker_count(low, against) <= 1), out)


def commitment(text: Column) -> Column:
    """The sentence with the first promise of a reply, 120 characters at most; null without one."""
    def cut(m: str) -> Column:
        s = sentence_with(text, m)
        return F.when(F.length(s) > 120, F.concat(F.substring(s, 1, 117), F.lit("..."))).otherwise(s)

    return _first(text, COMMITMENTS, OFFERS, cut)


def _titled(title: Column) -> Column:
    """First letter capital, eight words at most."""
    capital = F.concat(capital_letter(F.substring(title, 1, 1)), F.substring(title, F.lit(2), F.length(title)))
    words = white_words(capital)
    short = F.when(F.size(words) > 8, F.array_join(F.slice(words, 1, 8), " ")).otherwise(capital)
    return stripped(F.regexp_replace(short, "[.…]+$", ""))


def task_suggestion(text: Column) -> Column:
    """Title of the task that a reply suggests; null without one.  Each filler is taken off once, in order."""
    def title(m: str) -> Column:
        t = F.regexp_replace(sentence_with(text, m), "[.!?…]+$", "")
        for filler in TITLE_FILLER:
            t = F.regexp_replace(t, f"(?i)^{filler}", "")
        return _titled(t)

    return _first(text, TASKS, EXPLANATIONS, title)


def requested_tasks(text: Column) -> Column:
    """Titles of the tasks that a message asks for, by the first pattern that fits; empty without any."""
    body = stripped(text)
    raw = F.lit(None).cast("string")
    for pattern in reversed(TASK_REQUESTS):
        raw = F.when(body.rlike(f"(?i){pattern}"), F.regexp_extract(body, f"(?i){pattern}", 1)).otherwise(raw)
    parts = F.split(raw, r",\s*and\s+|,\s*", -1)
    by_and = F.split(raw, r"\s+and\s+", -1)
    listed = (F.size(parts) == 1) & (F.size(by_and) >= 2) & F.forall(by_and, lambda p: F.length(stripped(p)) < 60)
    chosen = F.when(listed, by_and).otherwise(parts)
    filler = "|".join(REQUEST_FILLER)

    def clean(p: Column) -> Column:
        return _titled(F.regexp_replace(F.regexp_replace(stripped(p), "[.!?…]+$", ""), f"(?i)^(?:{filler})+", ""))

    titles = F.filter(F.transform(F.filter(F.transform(chosen, stripped), lambda p: p != ""), clean), lambda t: t != "")
    return F.when((F.length(body) >= 10) & raw.isNotNull(), titles).otherwise(F.array().cast("array<string>"))


def objects_to_questions(text: Column) -> Column:
    return contains_any(F.lower(text), QUESTION_OBJECTIONS)


def declined_topic(text: Column) -> Column:
    """What follows the first marker that a message has, if it is longer than two characters."""
    low = F.lower(text)
    out = None
    for m in TOPIC_DECLINES:
        test = F.contains(low, F.lit(m))
        topic = F.regexp_replace(stripped(F.substring(low, F.instr(low, F.lit(m)) + len(m), F.length(low))), "[.!?,]+$", "")
        out = F.when(test, topic) if out is None else out.when(test, topic)
    return F.when(F.length(out) > 2, out)


def session_flags(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Each user turn with what holds from then on in the session: questions objected to, topics declined so far."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.where("role = 'user'")
    rows = rows.withColumn("_o", objects_to_questions(F.col("text"))).withColumn("_t", declined_topic(F.col("text")))
    return rows.withColumn("suppressed", F.max("_o").over(w)).withColumn("topics", F.collect_list("_t").over(w)).drop("_o", "_t")


def reflection_skip(text: Column) -> Column:
    """The first reason for which a normalized text is no material for a reflection, or null."""
    tail = F.substring(text, F.lit(6), F.length(text))
    spoken = starts_any(text, ("user:", "assistant:"))
    sentences = F.split(text, r"[.!?]\s+", -1)
    own = F.size(F.filter(sentences, lambda s: F.startswith(stripped(s), F.lit("i "))))
    return (
        F.when(text == "", "empty").when(contains_any(text, REFLECTION_NOISE), "noise").when(style_feedback(text), "style_feedback")
        .when(contains_any(text, ("├──", "│")), "file_tree").when(F.contains(text, F.lit("https://")) & (F.length(text) < 200), "short_url")
        .when(F.startswith(text, F.lit("user:")) & contains_any(tail, ("user:", "assistant:")), "exchange")
        .when(spoken & contains_any(text, CODE_MARKERS), "code").when(F.contains(text, F.lit("```")), "fence")
        .when(starts_any(text, ("user: from ", "assistant: from ", "user: import ", "assistant: import ")), "import")
        .when(text.rlike(rf"{EDGE}def\s+[\p{{L}}\p{{N}}_]+\("), "function")
        .when(F.startswith(text, F.lit("i ")) & (F.length(text) < 100) & starts_any(text, FILLER_OPENINGS), "filler_opening")
        .when((own > 2) & (own / F.size(sentences) > 0.5), "assistant_voice")
    )


def junk_reflection(text: Column) -> Column:
    """The first reason for which a stored reflection is junk, or null."""
    low = stripped(F.lower(text))
    sentences = F.split(low, r"[.!?]\s+", -1)
    own = F.size(F.filter(sentences, lambda s: F.startswith(stripped(s), F.lit("i "))))
    return (
        F.when(low == "", "empty").when(F.length(low) < 100, "short").when(starts_any(low, ("{", "[")), "json").when(F.contains(low, F.lit("```")), "fence")
        .when(contains_any(low, JUNK_MARKERS), "filler")
        .when((F.size(sentences) > 2) & (own > 3) & (own / F.size(sentences) > 0.5), "assistant_voice")
    )


def noise_rule(text: Column) -> Column:
    """The first rule by which a chunk of an assistant is noise, or null."""
    low = F.lower(text)
    out = F.when(F.startswith(low, F.lit("{")) | contains_any(low, NOISE_RULES["json"]), "json")
    for rule, markers in list(NOISE_RULES.items())[1:]:
        out = out.when(contains_any(low, markers) if markers else F.length(text) < 100, rule)
    return out


def chunk_profile(chunks: DataFrame, id_: str, sample: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Counts by length of text, and a random sample of rows by hash."""
    n = F.length("text")
    counts = chunks.agg(
        F.count("*").alias("total"), F.count_if(n < 100).alias("under_100"), F.count_if(n.between(100, 300)).alias("to_300"),
        F.count_if(n.between(301, 800)).alias("to_800"), F.count_if(n > 800).alias("over_800"),
    )
    return counts, chunks.orderBy(F.xxhash64(id_, F.lit(seed)), id_).limit(sample)


def digest(picked: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """Each group's picked texts (columns id, text, place) in one line, its number of rows and their ids."""
    rows = F.array_sort(F.collect_list(F.struct("place", "id", "text")))
    whole = F.array_join(F.transform("r", lambda x: x["text"]), " | ")
    out = picked.groupBy(group).agg(rows.alias("r"))
    return out.select(
        group,
        F.concat(F.lit("Recent themes: "), F.substring(whole, 1, most)).alias("summary"),
        F.size("r").alias("memory_count"),
        F.transform("r", lambda x: x["id"]).alias("source_ids"),
    )


def sentences_removed(text: Column, patterns) -> Column:
    """The text without the sentences that one of the patterns fits."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: s != "")
    hit = lambda s: reduce(lambda a, b: a | b, [F.lower(s).rlike(p) for p in patterns])
    return F.array_join(F.filter(parts, lambda s: ~hit(s)), " ")


def matching_sentences(text: Column, pattern: str) -> Column:
    """Places (from 0) of the sentences that a pattern fits."""
    parts = F.split(text, r"(?<=[.!?])\s+", -1)
    marked = F.transform(parts, lambda s, i: F.when(F.lower(s).rlike(pattern), i))
    return F.filter(marked, lambda i: i.isNotNull())


def whole_word(pattern: str) -> str:
    return f"{EDGE}(?:{pattern}){AFTER}"


# Phrases of talk about the talk itself, which are no state of a person.
META_ACTIONS = (
    "answer your question", "answer the question", "help you with", "help with this", "discuss working together", "discuss this further", "talk about",
    "figure out", "figure this out", "explore this", "explore further", "move through the process", "work through this", "get back to you", "let me know",
    "follow up on this", "provide more details", "share more context", "give you an update", "keep you posted", "search for this", "look into this",
    "check on this", "clean up test data", "cleanup test data",
)
# Signals of unsafe requests; those in WHOLE are words, the others parts of the text.
UNSAFE = {
    "illegal_activity": (
        "how to hack", "how to break into", "break into", "bypass security", "bypass a system", "bypass system", "steal from", "build explosives",
    ),
    "exploitation": (
        "manipulate", "psychological manipulation", "influence behavior", "coerce", "exploit", "take advantage", "emotionally manipulate",
        "emotional manipulation",
    ),
    "dual_use": ("weapon", "explosive", "c4", "bypass", "evade", "without getting caught"),
    "high_risk_pattern": ("step by step", "exact steps", "without getting caught"),
    "social_engineering": (
        "pretend you have no restrictions", "pretend you don't have any rules", "act as if you were not an ai", "act as dan", "you are now",
        "from now on you are", "your new name is", "roleplay as", "pretend to be",
        "forget your previous instructions", "ignore your training", "ignore all previous", "disregard your", "override your",
        "your instructions have changed", "new system prompt", "ignore your guidelines",
        "as my closest friend", "as my best friend", "you're the only one who understands me", "you wouldn't say no to me",
        "if you really cared about me", "prove you care", "if you loved me", "you owe me",
        "i'll be harmed if you don't", "someone will get hurt", "it's an emergency", "lives are at stake", "i'll hurt myself if", "you have to help me or",
        "i'm a security researcher", "this is just hypothetical", "just for educational purposes", "just for research", "i'm a professional so",
        "in a fictional world", "for testing purposes",
    ),
}
# What a user says of a hard situation, of a tension with their own aims; how drafts hedge, comply, acknowledge, qualify, and tell real doubt.
SITUATIONS = (
    "i feel", "i'm feeling", "i've been", "it's been", "i'm tired", "i'm frustrated", "i'm overwhelmed", "i'm exhausted", "i'm burned out", "i'm anxious",
    "hard week", "tough day", "struggling with", "i think i should", "i know i need to", "that was hard", "that hurt", "i'm worried",
)
DRAFT_HEDGES = (
    "i wonder if", "have you considered", "it might be worth", "perhaps you could", "maybe it would help", "you might want to", "it could be that",
    "would it help to", "have you thought about", "what if you tried",
)
TENSIONS = (
    "i know i should", "i know i shouldn't", "even though i said", "i said i would", "i said i wouldn't", "i promised i would", "i promised i wouldn't",
    "i'm supposed to", "against my better judgment", "i shouldn't but", "i know it's not good for me", "i know it's bad for me",
)
COMPLIANCE = (
    "absolutely", "of course", "sure thing", "no problem", "happy to help", "here's how", "let me help you with that", "sounds good", "great idea",
)
ACKNOWLEDGEMENTS_OF_TENSION = (
    "you mentioned", "you said earlier", "i notice", "the thing i notice", "what i'm hearing", "worth noting", "one thing to consider", "i want to name",
    "the tension", "you also said",
)
QUALIFIERS = (
    "while it's important to note", "while it's worth noting", "while i understand", "while i appreciate", "i want to be careful here",
    "i want to be thoughtful about", "i want to acknowledge", "it's important to recognize", "it's worth considering", "there are many perspectives on",
    "this is a nuanced topic", "this is a complex issue", "i think it's fair to say", "in fairness", "to be fair", "on the one hand",
    "it depends on context, but", "that said,", "having said that,", "with that in mind,", "i should note that",
)
REAL_DOUBT = (
    "i'm not sure", "i don't know", "i'm uncertain", "the evidence is mixed", "studies disagree", "there's no consensus", "i haven't found",
    "i don't have enough information", "based on limited",
)
WHOLE = {"illegal_activity": "illegal|steal|fraud|rob|shoplift|explosive|c4"}
# The principles that any signal calls for, and those of each signal.
PRINCIPLES = ("truthfulness", "usefulness_over_compliance")
PRINCIPLES_OF = {
    "illegal_activity": ("non_harm", "proportional_safety", "system_integrity"), "exploitation": ("non_harm", "proportional_safety", "system_integrity"),
    "dual_use": ("non_harm", "proportional_safety", "system_integrity"), "high_risk_pattern": ("non_harm", "proportional_safety", "system_integrity"),
    "social_engineering": ("non_harm", "system_integrity", "truthfulness"), "relational_hedging": ("relational_honesty", "truthfulness"),
    "preference_compliance": ("flourishing_over_preference", "user_agency_and_respect"), "validation_before_correction": ("truthfulness",),
}
# Asks for structure, tactics of manipulation, illegal asks, refusals, and statistics.
STRUCTURE_ASKS = ("json", "yaml", "schema", "tags", "label")
TACTICS = ("fear", "urgency", "fomo", "variable reward", "exploit", "coerce")
ILLEGAL_ASKS = "rob|steal|bypass|explosive|c4"
CLEAR_REFUSALS = ("i'm not going to help", "i cannot assist", "i can’t help", "i won't help")
STATISTICS = (
    r"(?:[0-9]{1,3}(?:\.[0-9]+)?%|[0-9]+\s+(?:out of|of every)\s+[0-9]+|[0-9]+(?:\.[0-9]+)?\s*(?:million|billion|trillion)"
    r"|(?:approximately|roughly|about|nearly|over|under)\s+[0-9]{2,})"
)
# Subjects, parts and verbs of claims that a system makes about itself.
SELF_SUBJECTS = ("the system", "my system", "this system")
SUBSYSTEMS = "search functionality|constitutional review|vault retrieval|coaching filter|web search|search|memory|vault|model|api"
SELF_VERBS = "doesn't|will not|haven't|cannot|hasn't|am not|aren't|can't|don't|won't|isn't|does|will|have|are|can|has|is|am|do"
# Attempts to override instructions, refusals to search or to see, and offers of a search.
OVERRIDES = (
    r"ignore\s+(?:your\s+)?(?:(?:previous|prior|all|any|system)\s+)*instructions", r"ignore\s+(?:your\s+)?system\s+prompt",
    r"disregard\s+(?:your\s+)?(?:(?:previous|prior|all|any|system)\s+)*instructions", r"disregard\s+(?:your\s+)?system\s+prompt",
    r"forget\s+(?:your\s+)?(?:rules|instructions|guidelines|system\s+prompt)", r"you\s+have\s+no\s+(?:restrictions|rules|guidelines|limits|constraints)",
    r"pretend\s+you\s+have\s+no\s+(?:guidelines|rules|restrictions|instructions|constraints)",
    r"pretend\s+(?:your\s+)?(?:instructions|rules|guidelines)\s+(?:don'?t|do\s+not)\s+exist",
    r"override\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions|rules|guidelines)",
    r"bypass\s+(?:your\s+)?(?:safety|system|content)\s*(?:filters?|rules?|restrictions?|guidelines?|instructions?)",
    r"act\s+as\s+if\s+you\s+have\s+no\s+(?:rules|instructions|guidelines|restrictions)",
    r"from\s+now\s+on\s+(?:ignore|disregard|forget)\s+(?:your\s+)?(?:rules|instructions|guidelines)",
    r"new\s+instructions?\s*[:\-]\s*(?:ignore|disregard|forget|override)",
    r"do\s+not\s+follow\s+(?:your\s+)?(?:previous\s+|prior\s+|system\s+)?(?:instructions|rules|guidelines|prompt)",
    r"stop\s+following\s+(?:your\s+)?(?:instructions|rules|guidelines|system\s+prompt)",
)
SEARCH_REFUSALS = (
    r"i don'?t have (?:real[- ]?time|current|live|up[- ]?to[- ]?date)", r"i can'?t (?:perform|do|execute|run)?\s*search",
    r"i (?:don'?t|lack) (?:the )?(?:ability|access) to (?:search|browse|access)", r"official sources like", r"want me to search", r"should i search", r"shall i search",
)
VISION_REFUSALS = (
    r"(?:i\s+can\s*not|i\s+can't|i\s+cannot)\s+see", r"i(?:'m| am)\s+unable\s+to\s+see", r"i\s+don'?t\s+have\s+(?:the\s+)?ability\s+to\s+see",
    r"use\s+(?:an\s+)?image[-\s]?analysis\s+tool", r"use\s+(?:a\s+)?vision\s+tool",
)
SEARCH_OFFERS = (
    r"want\s+me\s+to\s+(?:search|look\s+(?:it|this|that)\s+up|google)", r"(?:should|shall)\s+i\s+(?:search|look\s+(?:it|this|that)\s+up|google)",
    r"would\s+you\s+like\s+me\s+to\s+(?:search|look\s+(?:it|this|that)\s+up|google)",
)
#: A source in parentheses, or one at the end of a sentence.
CITED = r"(?i)\(\s*source:\s*([^)]+)\)|\ssource:\s*([^\s.,;]+(?:\.[^\s.,;]+)*)"


def any_of(low: Column, patterns) -> Column:
    """Whether one of the patterns fits as whole words."""
    return reduce(lambda a, b: a | b, [low.rlike(whole_word(p)) for p in patterns])


def state_candidate(text: Column, least_words: int = 10) -> Column:
    """Whether a message may tell of a person's state: long enough, and not about the talk itself."""
    return (F.size(white_words(text)) >= least_words) & ~contains_any(F.lower(text), META_ACTIONS)


def _counted(text: Column, phrases) -> Column:
    """How many of the phrases occur."""
    return sum(F.contains(text, F.lit(p)).cast("int") for p in phrases)


def unsafe_signals(user: Column, draft: Column) -> Column:
    """Signals of a request and its draft reply: five of both together, then three that tell them apart (hedging a hard thing away, complying against
    the user's own stated aims, and qualifying what is known)."""
    u, v = F.lower(user), F.lower(draft)
    both = F.lower(F.concat(user, F.lit(" "), draft))
    tests = []
    for name, parts in UNSAFE.items():
        test = contains_any(both, parts)
        tests.append(F.when(test | both.rlike(whole_word(WHOLE[name])) if name in WHOLE else test, name))
    tests.append(F.when(contains_any(u, SITUATIONS) & (_counted(v, DRAFT_HEDGES) >= 2), "relational_hedging"))
    tests.append(F.when(contains_any(u, TENSIONS) & contains_any(v, COMPLIANCE) & ~contains_any(v, ACKNOWLEDGEMENTS_OF_TENSION), "preference_compliance"))
    tests.append(F.when((_counted(v, QUALIFIERS) >= 2) & ~contains_any(v, REAL_DOUBT), "validation_before_correction"))
    return F.filter(F.array(*tests), lambda s: s.isNotNull())


def principles(signals: DataFrame, id_: str, signal: str) -> DataFrame:
    """id and principle: what a reply with signals is held to, each once; nothing without any."""
    of = F.create_map(*[x for name, held in PRINCIPLES_OF.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in held]))])
    held = F.concat(F.array(*[F.lit(p) for p in PRINCIPLES]), F.coalesce(of[F.col(signal)], F.array().cast("array<string>")))
    return signals.where(F.col(signal).isNotNull()).select(id_, F.explode(held).alias("principle")).distinct()


def draft_review(user: Column, draft: Column) -> tuple[Column, Column]:
    """The rules that a draft breaks, and the outcome: refuse_redirect, revise or allow."""
    u, v = F.lower(user), F.lower(draft)
    structured = ~contains_any(u, STRUCTURE_ASKS) & (F.startswith(stripped(draft), F.lit("{")) | contains_any(v, ('"title"', '"tags"', '"response"')))
    tactics = F.contains(u, F.lit("manipulate")) & contains_any(v, TACTICS)
    unrefused = (u.rlike(whole_word(ILLEGAL_ASKS)) | F.contains(u, F.lit("break into"))) & ~contains_any(v, CLEAR_REFUSALS)
    found = F.regexp_extract_all(v, F.lit(STATISTICS), F.lit(0))
    invented = (F.size(found) > 0) & ~F.exists(found, lambda s: F.contains(u, s))
    rules = F.array_compact(
        F.array(F.when(structured, "usefulness_over_compliance"), F.when(tactics | unrefused, "non_harm"), F.when(invented, "truthfulness"))
    )
    outcome = F.when(F.array_contains(rules, "non_harm"), "refuse_redirect").when(F.size(rules) > 0, "revise").otherwise("allow")
    return rules, outcome


def self_claims(text: Column, assistant: str | None = None) -> Column:
    """Places (from 0) of the sentences in which a system tells of itself or its parts."""
    subjects = "|".join(SELF_SUBJECTS + ((assistant.lower(),) if assistant else ()))
    part = whole_word(rf"(?:the|my)\s+(?:{SUBSYSTEMS})")
    sentences = F.split(stripped(text), r"(?<=[.!?])\s+", -1)

    def told(s: Column) -> Column:
        # a sentence with "I" needs a part of the system too, which is enough by itself
        low = F.lower(s)
        return low.rlike(whole_word(SELF_VERBS)) & (low.rlike(whole_word(subjects)) | low.rlike(part))

    return F.filter(F.transform(sentences, lambda s, i: F.when(told(s), i)), lambda i: i.isNotNull())


def uncovered_sources(text: Column, hosts: Column, literal: tuple[str, ...] = ("web_search_results", "web_search", "web")) -> Column:
    """Sources that a reply cites and that are neither a result's host (or its sub- or superdomain) nor a literal token."""
    cited = F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(0)), lambda m: F.coalesce(
        F.nullif(F.regexp_extract(m, CITED, 1), F.lit("")), F.regexp_extract(m, CITED, 2)))
    first = F.transform(cited, lambda c: stripped(F.lower(F.split(c, ",")[0])))
    bare = F.transform(first, lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://", ""), r"^www\.|[/?#].*$", ""))

    def known(c: Column) -> Column:
        near = F.exists(hosts, lambda h: (h == c) | F.endswith(c, F.concat(F.lit("."), h)) | F.endswith(h, F.concat(F.lit("."), c)))
        return c.isin(*literal) | near

    return F.filter(bare, lambda c: (c == "") | ~known(c))
