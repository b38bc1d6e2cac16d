"""Readers: every source declares its schema and keeps bad input apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import base_name, file_stem, glob_match, is_blank, squash_ws, strip_ws
from ..functions.messages import resolve_message_paths, resolve_paths
from .quoted_csv import read_quoted_csv

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object per non-blank line; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_splits(
    spark: SparkSession, root: str, splits: list[str], schema: str, images_root: str | None = None
) -> DataFrame:
    """The split folders below ``root`` with a ``split`` column; an absent one is empty.

    Splits are folders as ``write_splits`` lays them out, so a filter on the
    split prunes folders.
    """
    df = (
        spark.read.schema(f"{schema}, split string").option("basePath", root).json(root)
        .where(F.col("split").isin(splits))
    )
    if images_root is not None:
        df = df.withColumn("images", resolve_paths(F.col("images"), images_root))
        if "messages" in df.columns:
            df = df.withColumn("messages", resolve_message_paths(F.col("messages"), images_root))
    return df


def read_annotation(spark: SparkSession, path: str, record: str, whole_file: bool = True) -> DataFrame:
    """Flat rows of JSON objects ``split -> [records]``.

    The split names are data. A record's own split overrides the key it stands
    under. A folder of many such objects reads in parallel, one file (or, with
    ``whole_file=False``, one line) each.
    """
    texts = spark.read.text(path, wholetext=whole_file).where(~is_blank(F.col("value")))
    parsed = texts.select(
        F.from_json("value", f"map<string,array<struct<{record}>>>", {"mode": "FAILFAST"}).alias("m")
    )
    rows = parsed.select(F.explode("m").alias("_key", "_records")).selectExpr("_key", "inline(_records)")
    own = F.col("split") if "split" in rows.columns else F.lit(None)
    return rows.withColumn("split", F.coalesce(own, F.col("_key"))).drop("_key")


def last_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row per key; partial aggregation keeps a hot key cheap."""
    packed = df.select(F.col(key).alias("_k"), order.alias("_o"), F.struct(*df.columns).alias("_row"))
    return packed.groupBy("_k").agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")


# The element layout of a report file.
REPORT_XML = (
    "uId struct<_id:string>, "
    "MedlineCitation struct<Article:struct<Abstract:struct<AbstractText:"
    "array<struct<_Label:string,_VALUE:string>>>>>, "
    "MeSH struct<major:array<string>>, "
    "parentImage array<struct<_id:string,caption:string>>"
)


def read_reports_xml(spark: SparkSession, path: str, malformed: str = "skip", row_tag: str = "eCitation") -> DataFrame:
    """One row per report: uid, file, sections, tags, image ids and captions.

    ``malformed='skip'`` drops files that do not parse, ``'raise'`` fails.
    """
    modes = {"skip": "DROPMALFORMED", "raise": "FAILFAST"}
    raw = (
        spark.read.format("xml").option("rowTag", row_tag).option("mode", modes[malformed])
        .schema(REPORT_XML).load(path)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    texts = F.coalesce(F.col("MedlineCitation.Article.Abstract.AbstractText"), F.array())
    labelled = F.filter(
        F.transform(
            texts,
            lambda t: F.struct(
                F.upper(strip_ws(F.coalesce(t["_Label"], F.lit("")))).alias("label"),
                squash_ws(t["_VALUE"]).alias("text"),
            ),
        ),
        lambda t: t.label != "",
    )

    def section(name: str) -> Column:
        own = F.filter(labelled, lambda t: t.label == name)
        return F.coalesce(F.element_at(F.transform(own, lambda t: t.text), -1), F.lit(""))

    def by_label(v) -> Column:
        return F.transform(v.names, lambda n: F.get(F.filter(v.rows, lambda t: t.label == n), F.lit(0)).text)

    last_wins = F.reverse(labelled)
    names = F.array_distinct(F.transform(last_wins, lambda t: t.label))
    sections = F.map_from_arrays(names, let(by_label, names=names, rows=last_wins))
    tags = F.filter(
        F.transform(F.coalesce(F.col("MeSH.major"), F.array()), lambda t: squash_ws(t, lower=True)),
        lambda t: (t != "") & (t != "normal"),
    )
    images = F.coalesce(F.col("parentImage"), F.array())
    ids = F.filter(F.transform(images, lambda i: i["_id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    captions = F.array_distinct(
        F.filter(F.transform(images, lambda i: squash_ws(i.caption)), lambda c: c != "")
    )
    file = base_name(F.col("_path"))
    return raw.select(
        F.coalesce(F.nullif(F.col("uId._id"), F.lit("")), file_stem(F.col("_path"))).alias("uid"),
        file.alias("report_file"),
        section("FINDINGS").alias("findings"),
        section("IMPRESSION").alias("impression"),
        F.array_join(captions, " | ").alias("caption"),
        ids.alias("parent_images"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("normal"))).alias("mesh_majors"),
        sections.alias("sections"),
    )


def extract_sections(reports: DataFrame) -> DataFrame:
    """uid, file and the two sections; an empty input is an error."""
    if reports.isEmpty():
        raise ValueError("no reports to extract sections from")
    return reports.select("uid", "report_file", "findings", "impression")


TRANSLATION_CSV = (
    "uid string, findings string, impression string, findings_it string, impression_it string, MeSH string"
)


def read_translation_csv(spark: SparkSession, path: str, schema: str = TRANSLATION_CSV) -> DataFrame:
    """Translation table, one row per uid; the last row of a uid wins. Large files are read block by block."""
    raw = read_quoted_csv(spark, path, schema)
    text = [c for c in raw.columns if c not in ("uid", "_at")]
    filled = raw.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in text})
    return last_by(filled, "uid", F.col("_at")).drop("_at")


def report_in(lang: str) -> list[Column]:
    """Trimmed findings and impression of a translation row in a language."""
    suffix = {"en": "", "it": "_it"}[lang]
    return [strip_ws(F.col(f"{c}{suffix}")).alias(c) for c in ("findings", "impression")]


def tag_list(c: Column) -> Column:
    """Tags of a ``;`` list: trimmed, lower case, without "normal"; ``[normal]`` if none."""
    tags = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.lower(strip_ws(t)))
    tags = F.filter(tags, lambda t: (t != "") & (t != "normal"))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("normal")))


def list_images(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """Study folder, file name, size and path of every image; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("study"),
        base_name(F.col("path")).alias("file"),
        "length",
        "path",
    )


def image_folders(listing: DataFrame) -> DataFrame:
    """Files per study: counts, all and by view, and the first name.

    Counts merge on the map side, whatever a folder holds. The names are the
    rows of the listing.
    """
    name = F.lower(F.col("file"))
    front, side = F.contains(name, F.lit("frontal")), F.contains(name, F.lit("lateral"))
    kinds = {"frontal": front & ~side, "lateral": side & ~front, "other": front == side}
    return listing.groupBy("study").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()],
        F.min("file").alias("first_file"),
    )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels with shape and digest; files that do not decode are UNREADABLE."""
    image = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    bad = F.col("nChannels") < 0
    return image.select(
        F.element_at(F.split("origin", "/"), -2).alias("study"),
        base_name(F.col("origin")).alias("file"),
        F.when(bad, "UNREADABLE").otherwise("OK").alias("state"),
        F.when(~bad, F.concat_ws("x", "height", "width", "nChannels")).alias("shape"),
        F.when(~bad, F.md5("data")).alias("digest"),
        F.when(~bad, F.col("data")).alias("data"),
        F.col("origin").alias("path"),
    )


def _json_documents(spark: SparkSession, path: str, schema: str, whole_file: bool) -> DataFrame:
    """Parsed documents, one per file or line, with the text of broken ones and where they stood."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    texts = spark.read.text(path, wholetext=whole_file).where(~is_blank(F.col("value"))).select(
        F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("_doc"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return texts.select("_doc.*", "_path", "_block", "_row")


def read_runs(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run documents and, apart, the files or lines that could not be read."""
    docs = _json_documents(spark, path, schema, whole_file)
    good = docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_block", "_row")
    bad = docs.where(F.col(CORRUPT).isNotNull()).select("_path", CORRUPT)
    return good, bad


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as a table. Large files are read block by block."""
    rows = read_quoted_csv(spark, path, "id string, reference string, prediction string, has_sep string", "PERMISSIVE").drop("_at")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("reference", "prediction")})


SAMPLE = "id string, reference string, prediction string"


def read_prediction_steps(spark: SparkSession, path: str, sample: str = SAMPLE, whole_file: bool = True) -> DataFrame:
    """One row per sample of per-step documents; steps order by the number in the file name.

    Documents that cannot be read are left to ``unreadable_steps``.
    """
    schema = f"experiment string, epoch double, step bigint, samples array<struct<{sample}>>"
    docs = _json_documents(spark, path, schema, whole_file).where(F.col(CORRUPT).isNull())
    in_name = F.expr(r"try_cast(nullif(regexp_extract(_path, 'step(\\d+)', 1), '') as bigint)")
    return docs.select(
        "experiment", "epoch", F.coalesce("step", in_name).alias("step"), F.explode("samples").alias("_s")
    ).select("experiment", "epoch", "step", "_s.*")


def unreadable_steps(spark: SparkSession, path: str, sample: str = SAMPLE, whole_file: bool = True) -> DataFrame:
    """``(rule, path, text)`` of the step documents that ``read_prediction_steps`` cannot read."""
    schema = f"experiment string, epoch double, step bigint, samples array<struct<{sample}>>"
    broken = _json_documents(spark, path, schema, whole_file).where(F.col(CORRUPT).isNotNull())
    return broken.select(F.lit("unreadable_step").alias("rule"), F.col("_path").alias("path"), F.col(CORRUPT).alias("text"))


def select_units(df: DataFrame, globs: list[str], done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Units whose experiment matches a glob and whose output does not exist yet."""
    out = df.where(glob_match(F.col("experiment"), globs)) if globs else df
    return out.join(done.select(*keys).distinct(), keys, "left_anti") if done is not None else out


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Append-only cache: broken lines ignored, a later line of a key wins."""
    lines = _json_documents(spark, path, "key string, source string, translation string", False)
    good = lines.where(F.col(CORRUPT).isNull() & F.col("key").isNotNull())
    order = F.struct("_path", "_block", "_row")
    return last_by(good.select("key", "source", "translation", order.alias("_at")), "key", F.col("_at")).drop("_at")
