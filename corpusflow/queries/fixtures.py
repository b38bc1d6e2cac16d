"""The given tables seen as report corpora, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hours_between
from ..functions.vocabulary import Vocabulary
from ..session import spread

VOCAB = Vocabulary(labels=("LowQuality", "Toxic"), healthy="No Finding", fallbacks=("Unlabeled",))


# Tables whose texts make work that one core should not do alone.
TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *TEXT_KEYS[name]) if name in TEXT_KEYS else df


def studies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as two-section studies with a split and labels."""
    d = table(spark, sf, "documents")
    l = table(spark, sf, "labels")
    text, digit = F.col("text"), F.col("doc_id") % 10
    at = F.instr("text", "\n")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(digit < 7, "train").when(digit < 8, "val").otherwise("test").alias("split"),
        "lang", "source", text.alias("report"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("findings"),
        F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("impression"),
        F.when(F.col("quality").isNull(), "Unlabeled")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "No Finding")
        .otherwise(F.concat_ws("|", F.when(F.col("quality") == 0, "LowQuality"), F.when(F.col("toxic") == 1, "Toxic")))
        .alias("label_str"),
    ).withColumn("labels", F.split("label_str", "[|]"))


STUDIES = """
studies AS (
  SELECT d.doc_id AS id,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
         d.lang, d.source, d.text AS report,
         split_part(d.text, chr(10), 1) AS findings,
         CASE WHEN position(chr(10) IN d.text) > 0
              THEN substring(d.text, position(chr(10) IN d.text) + 1) ELSE '' END AS impression,
         CASE WHEN l.doc_id IS NULL THEN 'Unlabeled'
              WHEN l.quality = 1 AND l.toxic = 0 THEN 'No Finding'
              ELSE concat_ws('|', CASE WHEN l.quality = 0 THEN 'LowQuality' END,
                                  CASE WHEN l.toxic = 1 THEN 'Toxic' END) END AS label_str,
         string_split(label_str, '|') AS labels
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def imaged(spark: SparkSession, sf: str) -> DataFrame:
    """Studies with image paths whose views follow language and label."""
    s = studies(spark, sf)
    one = (
        F.when(F.col("lang") == "en", "frontal").when(F.col("lang") == "fr", "lateral")
        .when(F.col("lang") == "de", "frontal_lateral").otherwise("scan")
    )
    two = F.when(F.col("label_str") == "No Finding", "lateral_1").when(F.col("label_str") == "Unlabeled", "Frontal_2").otherwise("lateral_2")
    root = F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit("/"))
    paths = F.concat_ws(
        "|", F.concat(root, one, F.lit(".png")),
        F.when(F.col("label_str") != "LowQuality", F.concat(root, two, F.lit(".png"))),
        F.when(F.contains("label_str", F.lit("Toxic")), F.concat(root, F.lit("lateral_3.png"))),
    )
    return s.withColumn("image_path", F.split(paths, "[|]"))


IMAGED = STUDIES + """,
imaged AS (
  SELECT *, string_split(concat_ws('|',
    'images/' || id || '/' || CASE lang WHEN 'en' THEN 'frontal' WHEN 'fr' THEN 'lateral'
        WHEN 'de' THEN 'frontal_lateral' ELSE 'scan' END || '.png',
    CASE WHEN label_str <> 'LowQuality' THEN 'images/' || id || '/' ||
        CASE label_str WHEN 'No Finding' THEN 'lateral_1' WHEN 'Unlabeled' THEN 'Frontal_2' ELSE 'lateral_2' END || '.png' END,
    CASE WHEN contains(label_str, 'Toxic') THEN 'images/' || id || '/lateral_3.png' END), '|') AS image_path
  FROM studies
)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as references, the assistant turn right after as prediction."""
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "reference", "prediction"
    )


PAIRS = """
pairs AS (
  SELECT concat_ws(':', CAST(u.conv_id AS VARCHAR), CAST(u.turn AS VARCHAR)) AS id,
         u.text AS reference, a.text AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def two_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the studies: one answers with the body, one with the first line.

    The first knows no Spanish, the second no German, so either has ids of its own.
    """
    s = studies(spark, sf).select(
        "id", "lang", F.col("report").alias("reference"), "findings",
        F.when(F.col("impression") != "", F.col("impression")).otherwise(F.col("report")).alias("body"),
    )
    current = s.where(F.col("lang") != "es").select("id", "reference", F.col("body").alias("prediction"))
    baseline = s.where(F.col("lang") != "de").select("id", "reference", F.col("findings").alias("prediction"))
    return current, baseline


RUNS = STUDIES + """,
current_run AS (
  SELECT id, report AS reference, CASE WHEN impression <> '' THEN impression ELSE report END AS prediction
  FROM studies WHERE lang <> 'es'
),
baseline_run AS (
  SELECT id, report AS reference, findings AS prediction FROM studies WHERE lang <> 'de'
)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Events as curves: one run per user, one metric per event type, steps by time."""
    from ..operators.ordinal import number_within

    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return number_within(e, ["user_id", "event_type"], ["ts", "event_id"], name="step").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "step", "value", "ts", "event_id"
    )


CURVES = """
curves AS (
  SELECT user_id AS run, event_type AS metric,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value, ts, event_id
  FROM events
)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as experiment runs: one per user, with identity, best value, hours and status."""
    u = F.col("user_id")
    g = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("best_value"), F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"), F.count_distinct("event_type").alias("kinds"),
    )

    def pick(values, index):
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    third, sixth = F.expr("user_id div 3"), F.expr("user_id div 6")
    return g.select(
        "user_id", F.concat(F.lit("run_"), u).alias("experiment"), pick(("2B", "8B", "32B"), u % 3).alias("model"),
        pick(("lora", "qlora"), third % 2).alias("mode"), pick(("F-F", "FL-F", "F-FI", "FL-FI"), sixth % 4).alias("dataset"),
        F.when(u % 7 == 0, "failed").when(u % 2 == 0, "early_stopped").otherwise("completed").alias("status"),
        (u % 2 == 0).alias("early_stopped"), "best_value", (F.col("n") / 10.0).alias("epochs"),
        (F.col("n") / 10.0 - F.col("kinds") / 4.0).alias("best_epoch"),
        hours_between(F.col("started_at"), F.col("finished_at")).alias("hours"), "started_at", "finished_at", "n",
    )


RUN_TABLE = """
runs AS (
  SELECT user_id, 'run_' || user_id AS experiment, ['2B', '8B', '32B'][user_id % 3 + 1] AS model,
         ['lora', 'qlora'][(user_id // 3) % 2 + 1] AS mode, ['F-F', 'FL-F', 'F-FI', 'FL-FI'][(user_id // 6) % 4 + 1] AS dataset,
         CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'early_stopped' ELSE 'completed' END AS status,
         user_id % 2 = 0 AS early_stopped, max(value) AS best_value, count(*) / 10.0 AS epochs,
         count(*) / 10.0 - count(DISTINCT event_type) / 4.0 AS best_epoch,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS n
  FROM events GROUP BY user_id
)"""


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Long metrics of the runs: mean value per event type."""
    e = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return e.join(runs(spark, sf).select("user_id", "experiment", "model", "mode", "dataset"), "user_id").drop("user_id")


RUN_METRICS = RUN_TABLE + """,
run_metrics AS (SELECT r.experiment, r.model, r.mode, r.dataset, e.event_type AS metric, avg(e.value) AS value
  FROM events e JOIN runs r ON r.user_id = e.user_id GROUP BY ALL)"""


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six places, as in the oracles."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)
