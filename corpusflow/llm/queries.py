"""The queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, archives, coordinates, decontaminate, fmindex, mixing, parity, ppm, quotient, resample, secrets, suffixarray, toxicity
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Where the tokenizer files lie on every executor.
TOKENIZERS = "/opt/tokenizers"


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every whole text of documents."""
    return secrets.find_secrets(table(spark, folder, "documents"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A rate for every document, so that good, poor and toxic tokens have their target weights."""
    return mixing.mix_to_targets(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to a ZIP-packaged archive and read back."""
    return archives.round_trip(table(spark, folder, "pages"))


def op4_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate whole texts of documents."""
    return parity.similar_groups(table(spark, folder, "documents")).drop("print")


def op6_substring_fm(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every whole text of documents without windows that stand in an earlier one."""
    return fmindex.remove_repeated_words(table(spark, folder, "documents"))


def op7_substring_sa(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every whole text of documents without repeated strings."""
    return suffixarray.remove_repeated_bytes(table(spark, folder, "documents"))


def op8_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text of documents."""
    return ppm.identify(table(spark, folder, "documents"))


def op9_benchmark_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item of benchmark."""
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal whole texts of documents."""
    return quotient.exact_groups(table(spark, folder, "documents"))


def op11_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of documents, drawn towards the word shares of benchmark."""
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_minhash_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of whole texts of documents that share 85 in a hundred of their shingles."""
    return coordinates.near_duplicates(table(spark, folder, "documents"))


def op13_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers make of every whole text of documents."""
    return align.align_tokens(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_secret_scan, op2_mix_sources, op3_warc_packages, op4_toxic_segments, op5_parity_join, op6_substring_fm, op7_substring_sa,
    op8_language_ppm, op9_benchmark_simhash, op10_exact_dedup, op11_importance_resample, op12_minhash_coordinates,
    op13_cross_tokenizer,
)}

_FEATURES = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')".format()
_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda w : w <> '')"

def _similar_sql(percent: int, columns: str) -> str:
    """Components of the documents whose sets of 5-word shingles reach the similarity."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON b.sh = a.sh AND b.doc_id <> a.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
        r AS (SELECT u AS doc_id, u AS reached FROM l UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reached)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.reached), d.doc_id)) AS component_id{columns}
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


ORACLES: dict[str, str] = {
    "op5_parity_join": _similar_sql(75, ""),
    "op12_minhash_coordinates": _similar_sql(85, ", d.doc_id <= coalesce(min(r.reached), d.doc_id) AS kept"),
    "op6_substring_fm": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, unnest([array_to_string(ws[i : i + 12], ' ') FOR i IN range(1, len(ws) - 11)]) AS win FROM w WHERE len(ws) >= 13),
        h AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id),
        u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
        f AS (SELECT u.*, max(h.pos) OVER (PARTITION BY u.doc_id ORDER BY u.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.pos = u.pos),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM f),
        k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op3_warc_packages": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM k""",
    "op11_importance_resample": f"""
        WITH RECURSIVE crc AS (SELECT k AS v, CAST(k AS BIGINT) AS r, 0 AS step FROM range(256) t(k)
            UNION ALL SELECT v, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, step + 1 FROM crc WHERE step < 8),
        c AS (SELECT list(r ORDER BY v) AS t FROM crc WHERE step = 8),
        d AS (SELECT doc_id, {_FEATURES} AS ws FROM documents),
        b AS (SELECT {_FEATURES} AS ws FROM benchmark),
        m AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || hex(w)[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, octet_length(encode(w)) + 1)]),
                lambda a, x : xor(a >> 8, c.t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT unnest(ws) AS w FROM d UNION SELECT unnest(ws) FROM b), c),
        s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(ws) AS w FROM d) JOIN m USING (w) GROUP BY ALL),
        t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN m USING (w) GROUP BY ALL),
        n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t),
        g AS (SELECT k AS bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1) * (n.s + 10000) / ((coalesce(s.s, 0) + 1) * (n.t + 10000)))) AS BIGINT) AS gain
            FROM range(10000) r(k) CROSS JOIN n LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
        f AS (SELECT doc_id, sum(gain) AS total FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN m USING (w) JOIN g USING (bucket) GROUP BY ALL),
        w AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(floor(total / len(ws)), 0) AS BIGINT) AS weight,
                (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN f USING (doc_id)),
        z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM w),
        o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                count(*) FILTER (n_features >= 20) OVER () AS n FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM o""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
