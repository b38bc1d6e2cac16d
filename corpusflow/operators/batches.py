"""External batch jobs: results reconciled by id, resumable work and bound inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut
from ..sources.sinks import fingerprint_of

BLOCK = "struct<type:string,text:string>"
RESULT = (
    "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>,"
    "usage:struct<input_tokens:bigint,output_tokens:bigint>>>"
)


def normalise_chat_results(rows: DataFrame) -> DataFrame:
    """Results of a chat-completion provider in the shape of ``RESULT``.

    Input: custom_id, error, choices (array of message content), usage with
    prompt_tokens and completion_tokens.
    """
    blocks = F.transform("choices", lambda c: F.struct(F.lit("text").alias("type"), c.alias("text")))
    return rows.select(
        "custom_id",
        F.struct(
            F.when(F.col("error").isNull(), "succeeded").otherwise("errored").alias("type"),
            F.struct(
                blocks.alias("content"),
                F.struct(
                    F.col("usage.prompt_tokens").cast("bigint").alias("input_tokens"),
                    F.col("usage.completion_tokens").cast("bigint").alias("output_tokens"),
                ).alias("usage"),
            ).alias("message"),
        ).alias("result"),
    )


def reconcile_batch(results: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed payloads, typed errors and token usage of a batch, matched by id in any order.

    ``expected`` holds custom_id; ``keys`` are the fields a payload must have,
    no more and no fewer.
    """
    texts = F.transform(
        F.filter(F.col("result.message.content"), lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text
    )
    n_text = F.coalesce(F.size(texts), F.lit(0))
    body = F.get(texts, F.lit(0))
    found = F.json_object_keys(body)
    bad_id = F.coalesce(F.col("custom_id"), F.lit("")) == ""
    want = F.array_sort(F.array(*[F.lit(k) for k in keys]))
    copies = results.where(~bad_id).groupBy("custom_id").agg(F.count(F.lit(1)).alias("_n"))
    known = expected.select("custom_id").distinct().withColumn("_known", F.lit(True))
    joined = results.join(copies, "custom_id", "left").join(known, "custom_id", "left")
    error = (
        F.when(bad_id, "bad_id")
        .when(F.col("_known").isNull(), "unknown_id")
        .when(F.col("_n") > 1, "duplicate_id")
        .when(~F.col("result.type").eqNullSafe("succeeded"), "not_succeeded")
        .when(n_text != 1, "text_block_count")
        .when(found.isNull(), "not_json")
        .when(F.array_sort(found) != want, "wrong_keys")
    )
    typed = cut(joined.select("custom_id", error.alias("error"), body.alias("_body"), F.col("result.message.usage").alias("_usage")))  # read three times below
    missing = known.join(results.select("custom_id"), "custom_id", "left_anti").select("custom_id", F.lit("missing").alias("error"))
    errors = typed.where(F.col("error").isNotNull()).select("custom_id", "error").unionByName(missing)
    good = typed.where(F.col("error").isNull())
    parsed = good.select("custom_id", F.col("_body").alias("payload"))
    usage = good.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("_usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("_usage.output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    return parsed, errors, usage


def needs_work(columns: dict[str, str]) -> Column:
    """Any filled source column whose output is blank."""
    out = F.lit(False)
    for source, output in columns.items():
        out = out | (~is_blank(F.col(source)) & is_blank(F.col(output)))
    return out


def resume_queue(df: DataFrame, columns: dict[str, str], done: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows still to do; rows already in ``done`` are left out."""
    todo = df.where(needs_work(columns))
    return todo.join(done.select(key), key, "left_anti") if done is not None else todo


def submission_state(df: DataFrame, id_col: str, texts: list[str], position: str | None = None) -> DataFrame:
    """One row binding a batch to its input: fingerprints of the ids and of the contents.

    With ``position``, a column that says where each row stands, the ids are
    bound together with their order.
    """
    name = F.col(id_col).cast("string")
    name = F.concat_ws(":", F.col(position).cast("string"), name) if position else name
    ids = fingerprint_of(df.select(name.alias("_r")), "_r", [])
    body = F.to_json(F.struct(id_col, *texts), {"ignoreNullFields": "false"})
    content = fingerprint_of(df.select(body.alias("_r")), "_r", [])
    row = content.select(F.col("fingerprint").alias("_c")).scalar()
    return ids.select(F.col("n_rows").alias("n"), F.col("fingerprint").alias("ids_hash")).withColumn("input_hash", row)


def check_submission(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Which parts of the recorded state no longer fit; the download goes on only for none."""
    cells = [F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("now")) for c in ("n", "ids_hash", "input_hash")]
    now = current.select(F.inline(F.array(*cells)))
    then = recorded.select(F.inline(F.array(*cells))).withColumnRenamed("now", "then")
    return now.join(then, "part").where(~F.col("now").eqNullSafe(F.col("then")))


def release_results(parsed: DataFrame, errors: DataFrame, current: DataFrame, recorded: DataFrame) -> DataFrame:
    """The parsed rows, or an error if the input changed or any result is bad."""
    for what, frame in (("input changed", check_submission(current, recorded)), ("batch errors", errors)):
        rows = frame.limit(5).collect()
        if rows:
            raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
    return parsed
