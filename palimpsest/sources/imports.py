"""Importers of JSON records, chat exports and plain files; chat chunks; metadata; sinks and rebuilds."""

from __future__ import annotations

import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.replies import stripped
from ..functions.text import normalize
from ..operators.logs import ranked
from .folders import written
from .ingest import clean_text, content_key, content_kind, detected_role, fixed_chunks, index_target, skip_reason, skip_record

# Suffixes of files that are text, and of files that are passed over.
TEXT_SUFFIXES, SKIPPED_SUFFIXES = (".txt", ".md", ".csv"), (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".zip")
# Metadata that stays out of index rows, lists that aren't cut, and columns that a rebuild carries over.
DOCUMENT_ONLY = ("messages", "roles")
UNCUT_LISTS = ("source_record_ids",)
CARRIED_COLUMNS = ("tier", "last_retrieved_at", "frequency_score", "heat_score", "quality")


def json_rows(raw: DataFrame, payload: str) -> DataFrame:
    """A row for each element of a JSON array (or for one object): the columns of ``raw``, index and value (variant).

    Payloads that are no JSON have one row with a null index.
    """
    spark = raw.sparkSession
    whole = stripped(F.col(payload))
    listed = F.when(F.startswith(whole, F.lit("{")), F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    rows = raw.withColumn("_v", F.try_parse_json(listed))
    exploded = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
    return exploded.withColumnRenamed("pos", "index").drop("_v", "key", payload)


def import_json(raw: DataFrame, payload: str) -> DataFrame:
    """Records (text, type, source, tags, timestamp) and errors of JSON payloads; ``error`` is null for a record.

    A record needs a text that isn't blank.  Tags that are no list are none.
    """
    rows = json_rows(raw, payload)
    value = F.col("value")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))

    text = F.when(kind("$.text") == "STRING", stripped(F.try_variant_get(value, "$.text", "string")))
    error = (
        F.when(F.col("index").isNull(), "Expected a JSON array of records or a single JSON object.")
        .when(~F.startswith(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.lit("OBJECT")), "Record must be a JSON object.")
        .when(F.coalesce(text, F.lit("")) == "", "Missing or empty 'text' field.")
    )
    tags = F.coalesce(F.when(F.startswith(kind("$.tags"), F.lit("ARRAY")), F.try_variant_get(value, "$.tags", "array<string>")), F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "error": error,
            "text": F.when(error.isNull(), text),
            "type": F.when(error.isNull(), F.coalesce(F.try_variant_get(value, "$.type", "string"), F.lit("ingested"))),
            "source": F.when(error.isNull(), F.coalesce(F.try_variant_get(value, "$.source", "string"), F.lit("json_import"))),
            "tags": F.when(error.isNull(), tags),
            "timestamp": F.when(error.isNull(), F.try_variant_get(value, "$.timestamp", "string")),
        }
    ).drop("value")


def part_text(part: Column) -> Column:
    """A message part: a string, the text or content of an object, or its JSON."""
    def string(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(part, path, "variant")) == "STRING", F.try_variant_get(part, path, "string"))

    return F.coalesce(string("$"), string("$.text"), string("$.content"), F.to_json(part))


def flatten_chats(raw: DataFrame, payload: str, file: str) -> DataFrame:
    """A document for each conversation with messages of a chat export (an array of conversations).

    doc_id is ``<file>_<number>``; messages are ``Role: text`` in the order of the export, roles as they are in it;
    the time of creation becomes a hyphenated UTC timestamp if it is an epoch number.
    """
    schema = "array<struct<title:string,create_time:string,mapping:map<string,string>>>"
    rows = raw.select(F.col(file).alias("file"), F.posexplode(F.from_json(F.col(payload), schema)).alias("n", "c"))
    nodes = F.transform(F.map_values("c.mapping"), lambda node: F.try_parse_json(node))

    def message(node: Column) -> Column:
        parts = F.coalesce(F.try_variant_get(node, "$.message.content.parts", "array<variant>"), F.array().cast("array<variant>"))
        role = F.coalesce(F.try_variant_get(node, "$.message.author.role", "string"), F.lit("unknown"))
        return F.struct(role.alias("role"), stripped(F.array_join(F.transform(parts, part_text), "\n")).alias("text"))

    said = F.filter(F.transform(nodes, message), lambda m: F.coalesce(m["text"], F.lit("")) != "")
    # a generator's output is computed once a row: the messages are needed for the filter and for each of their columns
    rows = rows.select("file", "n", "c", F.explode(F.array(said)).alias("said")).where(F.size("said") > 0)
    epoch = F.timestamp_micros((F.col("c.create_time").try_cast("double") * 1_000_000).cast("long"))
    created = F.coalesce(F.date_format(epoch, "yyyy-MM-dd'T'HH-mm-ss"), F.col("c.create_time"))
    messages = F.transform("said", lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"]))
    return rows.select(
        F.concat("file", F.lit("_"), F.col("n").cast("string")).alias("doc_id"),
        F.coalesce("c.title", F.concat(F.lit("chat_"), "file", F.lit("_"), F.col("n").cast("string"))).alias("title"),
        created.alias("created_at"),
        F.array_join(messages, "\n\n").alias("content"),
        messages.alias("messages"),
        F.transform("said", lambda m: m["role"]).alias("roles"),
    )


def load_files(spark: SparkSession, paths: str | list[str], source: str = "file") -> DataFrame:
    """Documents of whole text files, one each (CSV files as they are); ``error`` for other suffixes."""
    rows = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    skipped = F.when(suffix.isin(*TEXT_SUFFIXES), None).when(suffix.isin(*SKIPPED_SUFFIXES), "Skipping unsupported file type").otherwise("Unsupported file type")
    content = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return rows.select(
        F.lit(source).alias("source"), F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("title"), suffix.alias("extension"),
        F.when(skipped.isNull(), content).alias("content"), skipped.alias("error"),
    )


def message_chunks(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A chunk for each kept message of documents with doc_id, messages and roles, with the columns ``keep`` of its document.

    ``chunk_index`` counts kept messages, ``raw_message_index`` all; a role that is missing is told by the text's beginning.
    """
    rows = docs.select("doc_id", *keep, "roles", F.posexplode("messages").alias("raw_message_index", "message"))
    # a generator's output is computed once a row: the rules ask for the normalized text by each of their hundred markers
    content = stripped(F.col("message"))
    rows = rows.select("*", F.explode(F.array(F.struct(content.alias("content"), normalize(content).alias("_n")))).alias("_m")).select("*", "_m.*").drop("message", "_m")
    rows = rows.where((F.col("_n") != "") & skip_reason(F.col("_n")).isNull())
    role = F.coalesce(F.nullif(F.get("roles", "raw_message_index"), F.lit("")), detected_role(F.col("_n")))
    rows = rows.withColumn("role", role).withColumn("content_kind", content_kind(F.col("_n"), F.col("role"))).drop("_n", "roles")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("raw_message_index")) - 1
    rows = rows.withColumn("chunk_index", place)
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return rows.select(
        "doc_id", chunk_id.alias("chunk_id"), "content", "chunk_index", "raw_message_index", "role", "content_kind",
        (F.col("role") != "assistant").alias("index_for_retrieval"), *keep,
    )


def ingestion(docs: DataFrame, chats: DataFrame, chat_source: str, assistant: str | None = None) -> DataFrame:
    """From documents and chats to what is indexed: chunk_id, doc_id, content, role, content_kind, target, metadata and content_key.

    ``docs`` (doc_id, source, title, text) are cleaned and cut to fixed sizes; ``chats`` (doc_id, title, messages, roles) go message by message.  Metadata carry the
    fields of document and chunk; a chunk goes to the store of its source and role, unless it is indexed nowhere or isn't worth it.
    """
    cleaned = docs.select("doc_id", F.col("source").alias("_source"), "title", clean_text(F.col("text")).alias("text"))
    plain = fixed_chunks(cleaned).withColumnRenamed("chunk", "content")
    none = F.lit(None).cast("string")
    plain = plain.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "_source", "title", "content",
        F.col("chunk_index").cast("int").alias("chunk_index"), none.alias("role"), none.alias("content_kind"), F.lit(True).alias("index_for_retrieval"),
    )
    said = message_chunks(chats, ("title",)).withColumn("_source", F.lit(chat_source))
    rows = plain.unionByName(said.select(*plain.columns))
    target = index_target(F.col("_source"), F.col("role"), chat_source)
    kind = F.substring_index(target, "/", -1)
    rows = rows.withColumn("target", target).where("index_for_retrieval AND target IS NOT NULL").where(~skip_record(F.col("content"), kind, assistant))
    fields = dict(source=F.col("_source"), doc_id=F.col("doc_id"), title=F.col("title"), chunk_id=F.col("chunk_id"), chunk_index=F.col("chunk_index"))
    own = enriched(F.map_filter(F.create_map(F.lit("role"), F.col("role"), F.lit("content_kind"), F.col("content_kind")), lambda _, v: v.isNotNull()), **fields)
    return rows.select("chunk_id", "doc_id", "content", "role", "content_kind", "target", index_metadata(own).alias("metadata"), content_key(F.col("content")).alias("content_key"))


def enriched(metadata: Column, **fields: Column) -> Column:
    """A map of metadata with a document's or chunk's fields, which win."""
    own = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))])
    return F.map_concat(F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*fields)), own)


def index_metadata(metadata: Column) -> Column:
    """Without what only documents carry."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*DOCUMENT_ONLY))


def flattened_metadata(metadata: Column, most: int = 20) -> Column:
    """A variant object's fields as text: primitives stay, lists keep their first primitive members, all else is its JSON."""
    fields = F.try_variant_get(metadata, "$", "map<string,variant>")

    def primitive(v: Column) -> Column:
        return ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)")

    def told(name: Column, v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        members = F.filter(F.try_variant_get(v, "$", "array<variant>"), primitive)
        kept = F.when(name.isin(*UNCUT_LISTS), members).otherwise(F.slice(members, 1, most))
        listed = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda m: F.to_json(m)), ","), F.lit("]"))
        return F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))

    return F.transform_values(fields, told)


def recent_duplicates(records: DataFrame, keys: list[str], order: str, text: str, newest: int = 10, segment_rows: int = 100_000) -> DataFrame:
    """keys, order and ``skipped``: whether a record's stripped, lower-cased text equals one of the ``newest`` written before it under its keys.

    Skipped records aren't written, so they don't count among those, which makes a key's records a sequence.  A key of many records is cut into
    segments of ``segment_rows``, which are scanned in parallel: each from the texts that the segment before it leaves, first guessed (none), then those it did
    leave.  A scan is made again only where its guess was wrong, until none was: what a segment leaves rarely depends on what it began with, so
    that is two rounds as a rule, and the result never depends on it.  Ten hashes of a segment are passed on.  Records equal in keys and order are taken in any one order.
    """
    said = F.md5(F.coalesce(F.lower(stripped(F.col(text))), F.lit("")).cast("binary"))
    rows = records.select(*keys, order, F.to_json(F.struct(*keys)).alias("_key"), said.alias("_said"))
    # hashes alone are sorted and scanned, the texts are read once
    rows = written(rows, "hashes")
    rows = written(ranked(rows, "_key", order, "_i").withColumn("_segment", F.floor((F.col("_i") - 1) / segment_rows)).drop("_slice"), "sequence")
    left = "_key string, _segment long, _in array<string>, _out array<string>"

    def scanned(parts: DataFrame, begins: DataFrame, flags: bool) -> DataFrame:
        """Segments scanned from what ``begins`` (_key, _segment, _in) says, else from nothing: the flags of their records, or what they leave."""
        first = begins.select("_key", (F.col("_segment") * segment_rows + 1).alias("_i"), "_in")
        sent = parts.join(first, ["_key", "_i"], "left").repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_i")

        def run(batches):
            now, began, held, ends = None, [], deque(maxlen=newest), []
            for batch in batches:
                skipped = []
                for key, segment, given, said in zip(*(batch.column(c).to_pylist() for c in ("_key", "_segment", "_in", "_said")), strict=True):
                    if (key, segment) != now:
                        if now is not None:
                            ends.append((*now, began, list(held)))
                        now, began = (key, segment), given or []
                        held = deque(began, maxlen=newest)
                    skipped.append(said in held)
                    if not skipped[-1]:
                        held.append(said)
                if flags:
                    ends.clear()
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, order)), pa.array(skipped, pa.bool_())], [*keys, order, "skipped"])
            if not flags and now is not None:
                ends.append((*now, began, list(held)))
                listed = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends, strict=True), (pa.string(), pa.int64(), listed, listed), strict=True)], names=["_key", "_segment", "_in", "_out"])

        schema = StructType([*(records.schema[c] for c in keys), records.schema[order], StructField("skipped", BooleanType())])
        return sent.mapInArrow(run, schema if flags else left)

    begins = nothing = records.sparkSession.createDataFrame([], "_key string, _segment long, _in array<string>")
    many = rows.where("_segment > 0").select("_key").distinct()
    if not many.isEmpty():
        parts = written(rows.join(many, "_key", "left_semi"), "segments")
        known = written(scanned(parts, nothing, False), "left")
        while True:
            due = known.select("_key", (F.col("_segment") + 1).alias("_segment"), F.col("_out").alias("_due"))
            wrong = known.join(due, ["_key", "_segment"]).where("_in <> _due").select("_key", "_segment", F.col("_due").alias("_in"))
            wrong = written(wrong, "wrong")
            if wrong.isEmpty():
                break
            again = scanned(parts.join(wrong.drop("_in"), ["_key", "_segment"], "left_semi"), wrong, False)
            known = written(known.join(wrong, ["_key", "_segment"], "left_anti").unionByName(again), "left")
        begins = known.select("_key", "_segment", "_in")
    return scanned(rows, begins, True)


def write_records(records: DataFrame, folder: str, kind: str = "memory_type") -> str:
    """Records by kind as Parquet in a new folder next to ``folder``, which then takes its place; the place of the old ones if there were any."""
    spark = records.sparkSession
    staged, old = f"{folder}-{uuid.uuid4().hex}", f"{folder}-old-{uuid.uuid4().hex}"
    records.write.partitionBy(kind).parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = files.exists(path(folder))
    if replaced:
        files.rename(path(folder), path(old))
    if not files.rename(path(staged), path(folder)):
        raise OSError(f"can't move {staged} to {folder}")
    return old if replaced else ""


def rebuilt_rows(plan: DataFrame, records: DataFrame, index: DataFrame, keep_orphans: bool = False) -> DataFrame:
    """Rows of a rebuilt index from a plan (record_id, index_id, class).

    ``records`` has record_id, text and kind, ``index`` index_id, text, kind and carried columns.  A matched record keeps its row's id and
    carried columns, another gets its own id; an orphan stays with ``keep_orphans`` only.
    """
    carried = [c for c in CARRIED_COLUMNS if c in index.columns]
    old = index.select("index_id", F.col("text").alias("_text"), F.col("kind").alias("_kind"), *carried)
    kept = plan if keep_orphans else plan.where("class <> 'orphan'")
    rows = kept.join(records, "record_id", "left").join(old, "index_id", "left")
    return rows.select(
        F.coalesce("index_id", "record_id").alias("id"), F.coalesce("text", "_text").alias("text"), F.coalesce("kind", "_kind").alias("kind"), "class", *carried
    )
