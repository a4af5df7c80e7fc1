"""Cleaning, chunking, skip rules, routing and upsert of documents and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import stripped
from ..functions.text import contains_any, normalize, once, starts_any
from ..operators.logs import ranked
from .folders import written

# Markers of records that were never a person's own text.
META_MARKERS = (
    "user asked:", "assistant responded:", "assistant said:", "### task:", "generate 1-3 broad tags",
    '"user_message":', '"memory_items":', '"reflection_items":', '"conversation_id":', '"chunk_id":',
)

# The message skip rules in the order in which they are tried.
SKIP_MARKERS = {
    "chat_control": ("change the title of this chat", "rename this chat", "title of this chat", "can we change the title of this chat"),
    "json_payload": (
        '"id":', '"object":', '"created":', '"model":', '"choices":', '"messages":', '"memory_items":', '"reflection_items":',
        '"conversation_id":', '"chunk_id":', '"asset_pointer":', '"content_type":', '"image_asset_pointer"', '"metadata": {',
        '"size_bytes":', '"width":', '"height":',
    ),
    "asset_pointer": (
        "sediment://file_", "asset_pointer", "image_asset_pointer", "watermarked_asset_pointer", "container_pixel_height",
        "container_pixel_width", "size_bytes", '"width":', '"height":',
    ),
    "tool_trace": (
        "tool:", "clarifying the question", "mapping out the user's request", "openai policies", "analysis:", "recipient=", "function call",
    ),
    "prompt_scaffolding": (
        "### task:", "generate 1-3 broad tags", "generate 1-3 specific tags", "based on the following chat history", "return valid json",
        "tag categorizing the main themes",
    ),
    "assistant_filler": (
        "you're very welcome", "i'm here to help", "if you'd like", "could you clarify", "can you clarify", "tell me more",
        "consider sharing details", "this would help refine",
    ),
    "shell_output": (
        "(.venv)", "ps c:\\", "uvicorn ", "info:", "traceback", 'file "c:\\', "line ", "application startup complete", "started server process",
        "started reloader process", "waiting for application startup", "press ctrl+c to quit", "loading weights:", "bertmodel load report",
        "embeddings.position_ids", "warning:", "http/1.1",
    ),
    "mixed_speakers": (
        "\nassistant:", " as an ai, i don't have personal experiences or memories.", "\ni understand you're", "\nlet's dive into",
        "\ni'm here to support you",
    ),
}
QUESTION_MARKERS = ("?", "what ", "why ", "how ", "could you", "can you", "would you", "should i", "do i")
ANSWER_MARKERS = ("here's", "here is", "replace", "run this", "commit", "next step", "do this")
EXPERIENCE_MARKERS = (
    "i am", "i'm", "i was", "i have", "i've", "i feel", "i felt", "today", "yesterday", "this week", "lately", "worked on", "started",
    "finished", "noticed", "experiencing", "having", "trying",
)


def meta_markers(assistant: str | None = None) -> tuple[str, ...]:
    """META_MARKERS, and how an assistant of that name is quoted."""
    return META_MARKERS + ((f"{assistant.lower()} responded:",) if assistant else ())


def clean_text(text: Column, placeholder: str = "[structured numeric/table-like content]") -> Column:
    """NUL and non-ASCII to spaces, white space collapsed; mostly digits becomes a placeholder."""
    ascii_ = F.regexp_replace(F.regexp_replace(text, "\\x00", " "), r"[^\x00-\x7F]+", " ")
    flat = F.trim(F.regexp_replace(ascii_, r"[\s\x0B\x1C-\x1F]+", " "))
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]+", ""))
    return once(flat, lambda t: F.when((F.length(t) > 40) & (digits(t) / F.length(t) > 0.55), placeholder).otherwise(t))


def fixed_chunks(docs: DataFrame, text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """A row for each non-blank chunk of the stripped text, stripped, with its number; numbers of blank chunks are skipped.

    ``text`` isn't among the columns of the result, so chunks don't carry it.  The text is cut at every step once, and a chunk
    is a piece and the beginning of the next, so the work is linear in the text.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("an overlap is half of the size at most")
    # a generator's output is computed once a row: the stripped text is needed for the count and for the pieces
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(*rest, F.explode(F.array(stripped(F.col(text)))).alias("_t"))
    n = F.when(F.length("_t") <= size, 1).otherwise(F.ceil((F.length("_t") - size) / step) + 1).cast("int")
    pieces = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    rows = rows.select(*rest, n.alias("_n"), F.explode(F.array(pieces)).alias("_p"))
    made = F.transform("_p", lambda p, i: stripped(F.concat(p, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, overlap))))
    rows = rows.select(*rest, F.posexplode(F.slice(made, F.lit(1), F.col("_n"))).alias("chunk_index", "chunk"))
    return rows.where(F.length("chunk") > 0)


def skip_reason(normalized: Column) -> Column:
    """The first rule by which a chat message is skipped, or null."""
    said = {"assistant_filler": "assistant:", "mixed_speakers": "user:"}
    out = F.when(normalized == "", "empty").when(F.length(normalized) < 30, "short")
    for rule, markers in SKIP_MARKERS.items():
        hit = contains_any(normalized, markers)
        if rule == "json_payload":
            hit = starts_any(normalized, ("{", "[")) | hit
        if rule in said:
            hit = F.startswith(normalized, F.lit(said[rule])) & hit
        out = out.when(hit, rule)
    return out


def detected_role(normalized: Column) -> Column:
    out = None
    for role in ("user", "assistant", "tool", "system"):
        test = F.startswith(normalized, F.lit(f"{role}:"))
        out = F.when(test, role) if out is None else out.when(test, role)
    return out.otherwise("unknown")


def content_kind(normalized: Column, role: Column) -> Column:
    return (
        F.when(contains_any(normalized, QUESTION_MARKERS), "question")
        .when((role == "assistant") & contains_any(normalized, ANSWER_MARKERS), "answer")
        .when((role == "user") & contains_any(normalized, EXPERIENCE_MARKERS), "experience")
        .when(role == "user", "user_content")
        .when(role == "assistant", "assistant_content")
        .otherwise("other")
    )


def index_target(source: Column, role: Column, chat_source: str) -> Column:
    """Store and type of a chunk; null where it is indexed nowhere."""
    chat = source == chat_source
    return (
        F.when(chat & (role == "assistant"), None)
        .when(chat & (role == "user"), "memory/conversation")
        .otherwise("ingested/ingested")
    )


def skip_record(text: Column, kind: Column, assistant: str | None = None) -> Column:
    """Records that aren't indexed."""
    least = F.when(kind.isin("conversation", "deviation", "profile"), 0).when(kind == "journal", 20).otherwise(40)

    def skipped(flat: Column) -> Column:
        return (
            (flat == "")
            | (F.length(flat) < least)
            | contains_any(flat, meta_markers(assistant))
            | ((kind != "deviation") & starts_any(flat, ("{", "[")))
            | F.contains(F.coalesce(text, F.lit("")), F.lit("```"))
        )

    return once(normalize(F.coalesce(text, F.lit(""))), skipped)


def content_key(text: Column) -> Column:
    return F.sha2(normalize(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def unique_ids(rows: DataFrame, id_: str, key: str, order: str) -> DataFrame:
    """Rows with equal id and content once; further contents of an id get #2, #3 and so on by first arrival."""
    first = rows.groupBy(id_, key).agg(F.min(order).alias(order))
    n = F.row_number().over(Window.partitionBy(id_).orderBy(order, key))
    named = F.when(n > 1, F.concat(F.col(id_).cast("string"), F.lit("#"), n.cast("string"))).otherwise(F.col(id_).cast("string"))
    return first.withColumn("unique_id", named)


def upsert_outcomes(batch: DataFrame, store: DataFrame, id_: str, key: str, order: str) -> DataFrame:
    """What becomes of each row of a batch, in arrival order: ``present`` (its content is
    stored under any id, or came earlier in the batch), ``replaced`` (new content for a stored id) or ``inserted``."""
    stored_keys = store.select(key).distinct().withColumn("_stored", F.lit(True))
    stored_ids = store.select(id_).distinct().withColumn("_known", F.lit(True))
    # the first of each content is an aggregate, so a content of many rows isn't gathered; only rows equal in content, order and id share a window
    same = list(dict.fromkeys((key, order, id_)))
    first = batch.groupBy(key).agg(F.min(F.struct(*same[1:])).alias("_f")).select(key, "_f.*", F.lit(True).alias("_leads"))
    rows = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(order))).join(first, same, "left")
    rows = rows.withColumn("_earlier", F.col("_leads").isNull() | (F.col("_n") > 1)).drop("_leads", "_n")
    rows = rows.join(stored_keys, key, "left").join(stored_ids, id_, "left")
    outcome = (
        F.when(F.col("_stored") | F.col("_earlier"), "present").when(F.col("_known"), "replaced").otherwise("inserted")
    )
    return rows.withColumn("outcome", outcome).drop("_stored", "_earlier", "_known")


def rebuild_plan(records: DataFrame, index: DataFrame, key: str, id_: str) -> DataFrame:
    """Pairs of records and index rows with equal content, in order of their ids: matched, added or orphan."""
    # ranking reads its rows three times; the keys are made of whole texts, and are made once
    records, index = written(records.select(key, id_), "records"), written(index.select(key, id_), "index")
    # numbers within a content come from slices, so a content of many rows isn't in one task
    left = ranked(records, key, id_, "_n").select(F.col(key), F.col(id_).alias("record_id"), "_n")
    right = ranked(index, key, id_, "_n").select(F.col(key), F.col(id_).alias("index_id"), "_n")
    both = left.join(right, [key, "_n"], "full_outer").drop("_n")
    kind = F.when(F.col("index_id").isNull(), "added").when(F.col("record_id").isNull(), "orphan").otherwise("matched")
    return both.withColumn("class", kind)
