"""Chat messages, instruction records and request bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null
from .views import view_of

PART = "struct<type:string,image:string,text:string>"
MESSAGE = f"struct<role:string,content_text:string,content_parts:array<{PART}>>"
MESSAGES = f"array<{MESSAGE}>"
# How messages arrive as JSON: the content stays text until its kind is known.
RAW_MESSAGES = "array<struct<role:string,content:string>>"
RECORD_COLUMNS = (
    f"id string, messages {MESSAGES}, images array<string>, "
    "factors struct<diagnostic_category:array<string>,projection:string,views:array<string>,task_type:string>, "
    "mesh_raw array<string>, provenance struct<source_lang:string,target_lang:string>"
)
RECORD = f"struct<{RECORD_COLUMNS}>"


def parse_messages(raw: Column) -> Column:
    """Messages of a JSON string, contents told apart into text and parts.

    A list content of the assistant is joined by newlines.
    """

    def one(m: Column) -> Column:
        is_list = m.content.startswith("[")
        texts = F.from_json(m.content, "array<string>")
        parts = F.from_json(m.content, f"array<{PART}>")
        joined = F.when(is_list & (m.role == "assistant"), F.array_join(texts, "\n"))
        return F.struct(
            m.role.alias("role"),
            F.coalesce(joined, F.when(~is_list, m.content)).alias("content_text"),
            F.when(is_list & (m.role != "assistant"), parts).alias("content_parts"),
        )

    return F.transform(F.from_json(raw, RAW_MESSAGES), one)


def message_text(messages: Column, role: str, default: str = "") -> Column:
    """Text of the first message of the role; its text parts count if it has parts."""
    first = F.get(F.filter(messages, lambda m: m.role == role), F.lit(0))
    parts = F.array_join(
        F.transform(F.filter(first.content_parts, lambda p: p.type == "text"), lambda p: p.text), "\n"
    )
    return F.coalesce(first.content_text, parts, F.lit(default))


def reference_text(override: Column, messages: Column) -> Column:
    return F.coalesce(blank_to_null(override), message_text(messages, "assistant"))


def image_paths(images: Column, messages: Column) -> Column:
    """Paths from the images text (JSON list or a bare path), else from the user's parts."""
    text = blank_to_null(images)
    listed = F.from_json(text, "array<string>")
    direct = F.when(text.startswith("["), listed).when(text.isNotNull(), F.array(text))
    direct = F.filter(direct, lambda p: p.isNotNull() & (p != ""))
    users = F.filter(messages, lambda m: (m.role == "user") & m.content_parts.isNotNull())
    parts = F.flatten(F.transform(users, lambda m: m.content_parts))
    in_parts = F.transform(
        F.filter(parts, lambda p: (p.type == "image") & (F.coalesce(p.image, F.lit("")) != "")), lambda p: p.image
    )
    return F.when(F.size(direct) > 0, direct).otherwise(F.coalesce(in_parts, F.array().cast("array<string>")))


def _under(root: str):
    def place(path: Column) -> Column:
        return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

    return place


def resolve_paths(paths: Column, root: str) -> Column:
    """Relative paths put below the root, absolute ones unchanged."""
    return F.transform(paths, _under(root))


def resolve_message_paths(messages: Column, root: str) -> Column:
    place = _under(root)

    def part(p: Column) -> Column:
        return F.when((p.type == "image") & p.image.isNotNull(), p.withField("image", place(p.image))).otherwise(p)

    return F.transform(
        messages,
        lambda m: F.when(
            m.content_parts.isNotNull(), m.withField("content_parts", F.transform(m.content_parts, part))
        ).otherwise(m),
    )


def _message(role: str, text: Column | None, parts: Column | None) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        (text if text is not None else F.lit(None).cast("string")).alias("content_text"),
        (parts if parts is not None else F.lit(None)).cast(f"array<{PART}>").alias("content_parts"),
    )


def user_parts(images: Column, prompt: Column) -> Column:
    """One image part per path, then the prompt."""
    none = F.lit(None).cast("string")
    shown = F.transform(
        images, lambda p: F.struct(F.lit("image").alias("type"), p.alias("image"), none.alias("text"))
    )
    asked = F.array(F.struct(F.lit("text").alias("type"), none.alias("image"), prompt.alias("text")))
    return F.concat(shown, asked)


def build_record(
    id: Column, images: Column, labels: Column, target: Column, system: Column, user: Column,
    task_type: str = "report_generation", tags: Column | None = None,
    source_lang: Column | None = None, target_lang: Column | None = None,
) -> Column:
    """The nested instruction record."""
    null = F.lit(None).cast("string")
    views = F.transform(images, lambda p: F.coalesce(view_of(p), F.lit("unknown")))
    return F.struct(
        id.cast("string").alias("id"),
        F.array(
            _message("system", system, None),
            _message("user", None, user_parts(images, user)),
            _message("assistant", target, None),
        ).alias("messages"),
        images.alias("images"),
        F.struct(
            labels.alias("diagnostic_category"),
            F.array_join(views, "+").alias("projection"),
            views.alias("views"),
            F.lit(task_type).alias("task_type"),
        ).alias("factors"),
        (tags if tags is not None else F.lit(None).cast("array<string>")).alias("mesh_raw"),
        F.struct(
            (source_lang if source_lang is not None else null).alias("source_lang"),
            (target_lang if target_lang is not None else null).alias("target_lang"),
        ).alias("provenance"),
    ).cast(RECORD)


def build_llm_request(
    id: Column, report: Column, impression: Column, model: str, system: str,
    max_tokens: int, labels: tuple[str, ...],
) -> Column:
    """JSON request line: the two texts only, with a schema-bound answer."""
    schema = F.struct(
        F.lit("object").alias("type"),
        F.struct(
            F.struct(
                F.lit("array").alias("type"),
                F.struct(
                    F.lit("string").alias("type"), F.array(*[F.lit(l) for l in labels]).alias("enum")
                ).alias("items"),
                F.lit(1).alias("minItems"),
            ).alias("diagnostic_label")
        ).alias("properties"),
        F.array(F.lit("diagnostic_label")).alias("required"),
        F.lit(False).alias("additionalProperties"),
    )
    texts = F.to_json(F.struct(report.alias("report"), impression.alias("impression")))
    return F.to_json(
        F.struct(
            id.cast("string").alias("custom_id"),
            F.struct(
                F.lit(model).alias("model"),
                F.lit(max_tokens).alias("max_tokens"),
                F.lit(system).alias("system"),
                F.array(F.struct(F.lit("user").alias("role"), texts.alias("content"))).alias("messages"),
                F.struct(
                    F.struct(F.lit("json_schema").alias("type"), schema.alias("schema")).alias("format")
                ).alias("output_config"),
            ).alias("params"),
        )
    )
