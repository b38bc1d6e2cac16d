"""Text normalisers, section handling and text comparison as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# The characters that count as white space, as one regex class
# body that Java and RE2 read alike.
SPACE = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same for Java alone: runs that are not one blank already, with most characters ruled out by one comparison.
UNEVEN_SPACE = rf"[[^\x21-\x7E]&&[{SPACE}]]{{2,}}|[[^\x20-\x7E]&&[{SPACE}]]"
# Section separator, header words, placeholder mark and patterns.
SEPARATOR = "<SEP>"
HEADERS = {"en": ("Findings:", "Impression:"), "it": ("Reperti:", "Impressione:")}
LEADING_HEADER = r"(?i)^(findings|impression|reperti|impressione)\s*:\s*"
SECOND_HEADER = r"(?i)(impression|impressione)\s*:"
PLACEHOLDER = "XXXX"
# A word of a-z, 0-9 and slashes that is not made of placeholders alone.
REAL_WORD = r"(?<![a-z0-9/])(?!(?:none|n/?a|xxxx)+(?![a-z0-9/]))[a-z0-9/]"
THINK_BLOCK = r"(?s)<think>.*?</think>\s*"
BULLET = r"^\s*(?:\d+\s*[.)]|[-•*])\s*"
SENTENCE_BREAK = r"(?<!\d)[.;](?!\d)|\n+"
CLAUSE_GAP = r"(?<=[.;:!?])[" + SPACE + r"]+"


def squash_ws(c: Column, lower: bool = False) -> Column:
    """Runs of white space become one blank, ends trimmed, null becomes empty."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), UNEVEN_SPACE, " "))
    return F.lower(out) if lower else out


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty or white-space-only text; never null."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{SPACE}]")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def alnum_key(c: Column) -> Column:
    """Lower case with every run outside a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """Words of an already squashed text; the empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def key_tokens(c: Column) -> Column:
    return words(alnum_key(c))


STUDY_KEY_RULES = ("prefix", "number", "strict", "patient")


def study_key(c: Column, rule: str) -> Column:
    """Study key of an id such as ``CXR12_IM-3``.

    ``prefix`` keeps what stands before the first underscore, ``number`` also
    drops the letters CXR, ``strict`` gives null unless the id starts with CXR,
    digits and an underscore, ``patient`` is upper case and falls back to the
    whole name.
    """
    if rule == "prefix":
        return F.split_part(c, F.lit("_"), F.lit(1))
    if rule == "number":
        return F.replace(F.split_part(c, F.lit("_"), F.lit(1)), F.lit("CXR"), F.lit(""))
    if rule == "strict":
        return F.nullif(F.regexp_extract(c, r"^CXR(\d+)_", 1), F.lit(""))
    if rule == "patient":
        found = F.nullif(F.regexp_extract(c, r"(?i)^(CXR\d+)", 1), F.lit(""))
        return F.upper(F.coalesce(found, c))
    raise ValueError(f"unknown key rule {rule!r}; known: {STUDY_KEY_RULES}")


def section_status(sections: Column, name: str) -> Column:
    """MISSING_TAG, EMPTY, PLACEHOLDER or OK for one entry of a section map."""
    text = F.try_element_at(sections, F.lit(name))
    return (
        F.when(~F.map_contains_key(sections, name), "MISSING_TAG")
        .when(is_blank(text), "EMPTY")
        .when(~F.lower(text).rlike(REAL_WORD), "PLACEHOLDER")  # ends at the first such word
        .otherwise("OK")
    )


def is_placeholder_only(c: Column, mark: str = PLACEHOLDER) -> Column:
    """No letter or digit is left once the mark is taken out."""
    return ~F.replace(F.coalesce(c, F.lit("")), F.lit(mark), F.lit(" ")).rlike(r"[\p{L}\p{N}]")


def strip_blocks(c: Column) -> Column:
    """Text without its think blocks, trimmed."""
    return strip_ws(F.regexp_replace(c, THINK_BLOCK, ""))


def format_target(findings: Column, impression: Column, kind: str, lang: str = "en") -> Column:
    first, second = HEADERS[lang]
    head = [F.lit(first), strip_ws(F.coalesce(findings, F.lit("")))]
    if kind == "findings":
        return F.concat_ws("\n", *head)
    if kind != "findings_impression":
        raise ValueError(f"unknown target kind {kind!r}")
    tail = [F.lit(SEPARATOR), F.lit(second), strip_ws(F.coalesce(impression, F.lit("")))]
    return F.concat_ws("\n", *head, *tail)


def strip_header(c: Column) -> Column:
    return strip_ws(F.regexp_replace(strip_ws(c), LEADING_HEADER, ""))


def split_sections(c: Column, separator: str = SEPARATOR) -> Column:
    """``struct(findings, impression)`` of a generated or reference text.

    Splits at the first separator, else at the first second-section header,
    else the impression is null.
    """

    def cut(v: Column) -> Column:
        head = F.when(v.at > 0, F.substring(v.x, F.lit(1), v.at - 1)).otherwise(v.x)
        tail = F.when(v.at > 0, F.substring(v.x, v.at + v.skip, F.length(v.x)))
        return F.struct(strip_header(head).alias("findings"), strip_header(tail).alias("impression"))

    def find(v: Column) -> Column:
        at_sep = F.instr(v.x, separator)
        at_header = F.regexp_instr(v.x, F.lit(SECOND_HEADER))
        place = F.when(at_sep > 0, F.struct(at_sep.alias("at"), F.lit(len(separator)).alias("skip"))).otherwise(
            F.struct(at_header.alias("at"), F.lit(0).alias("skip"))
        )
        return let(lambda w: cut(w.p.withField("x", v.x)), p=place)

    return let(find, x=c)


def sentences(c: Column, min_words: int = 3) -> Column:
    """Normalised sentences of at least ``min_words`` words."""

    def clean(piece: Column) -> Column:
        squashed = squash_ws(F.regexp_replace(piece, BULLET, ""), lower=True)
        return F.regexp_replace(squashed, r"^[.,;: ]+|[.,;: ]+\z", "")

    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK), clean)
    return F.filter(pieces, lambda p: F.size(words(p)) >= min_words)


def normal_section(c: Column) -> Column:
    """A whole section in the normal form that ``sentences`` gives its pieces."""
    return F.regexp_replace(squash_ws(c, lower=True), r"^[.,;: ]+|[.,;: ]+\z", "")


def clauses(c: Column) -> Column:
    """Pieces of text ending in ``. ; : ! ?`` and white space."""
    return F.filter(F.split(strip_ws(F.coalesce(c, F.lit(""))), CLAUSE_GAP), lambda p: p != "")


def word_count(c: Column) -> Column:
    return F.size(words(squash_ws(c)))


def pack_chunks(pieces: Column, budget: int, size=word_count) -> Column:
    """Greedy packing of consecutive pieces into chunks of at most ``budget``.

    A piece above the budget stands in a chunk of its own.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("used")
    )

    def step(acc: Column, piece: Column) -> Column:
        need = size(piece)
        full = (acc.open != "") & (acc.used + need > budget)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            F.when(full | (acc.open == ""), piece).otherwise(F.concat(acc.open, F.lit(" "), piece)).alias("open"),
            F.when(full, need).otherwise(acc.used + need).alias("used"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc.open == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.open)))

    return F.aggregate(pieces, start, step, finish)


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive ``n``-token phrases, in order, with repetitions."""

    def build(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v.t) - (n - 1))
        return F.when(
            F.size(v.t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(v.t, i, n), " "))
        ).otherwise(F.array().cast("array<string>"))

    return let(build, t=tokens)


# Jaccard floors of the near and partial classes.
NEAR_FLOOR, PARTIAL_FLOOR = 0.9, 0.5


def text_match(a: Column, b: Column, empty_status: str = "NO_SOURCE") -> Column:
    """``struct(status, jaccard, coverage)`` comparing source ``a`` with copy ``b``."""
    no_source = F.coalesce(a, F.lit("")) == ""

    def measure(k: Column) -> Column:
        return let(lambda t: grade(k, t), a=F.array_distinct(words(k.a)), b=F.array_distinct(words(k.b)))

    def grade(k: Column, t: Column) -> Column:
        shared = F.size(F.array_intersect(t.a, t.b))
        return let(lambda n: result(k, n), shared=shared, a=F.size(t.a), either=F.size(t.a) + F.size(t.b) - shared)

    def result(k: Column, n: Column) -> Column:
        jaccard = F.when(n.either == 0, 1.0).otherwise(n.shared / n.either)
        coverage = F.when(n.either == 0, 1.0).when(n.a == 0, 0.0).otherwise(n.shared / n.a)
        status = (
            F.when(k.a == k.b, "EXACT")
            .when((k.a != "") & F.contains(k.b, k.a), "SUBSET")
            .when(jaccard >= NEAR_FLOOR, "NEAR")
            .when(jaccard >= PARTIAL_FLOOR, "PARTIAL")
            .otherwise("MISMATCH")
        )
        return F.struct(status.alias("status"), jaccard.alias("jaccard"), coverage.alias("coverage"))

    nothing = F.struct(F.lit(empty_status).alias("status"), F.lit(0.0).alias("jaccard"), F.lit(0.0).alias("coverage"))
    return F.when(no_source, nothing).otherwise(let(measure, a=alnum_key(a), b=alnum_key(b)))


def text_key(c: Column) -> Column:
    """Cache key of a text: md5 of the squashed text."""
    return F.md5(squash_ws(c))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def file_stem(c: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*\z", "")


def report_text(*sections: Column) -> Column:
    """Non-blank sections joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(strip_ws(s), F.lit("")) for s in sections])


def display_text(findings: Column, impression: Column, whole: Column, section: str) -> Column:
    """The text a reader sees: one section, or both with fallbacks to the whole."""
    f, i = blank_to_null(findings), blank_to_null(impression)
    if section == "findings":
        return F.coalesce(f, blank_to_null(whole), F.lit(""))
    if section == "impression":
        return F.coalesce(i, F.lit(""))
    both = F.concat_ws("\n", F.concat(F.lit("Findings: "), f), F.concat(F.lit("Impression: "), i))
    return F.when(f.isNotNull() | i.isNotNull(), both).otherwise(F.coalesce(whole, F.lit("")))


def glob_match(c: Column, globs: list[str]) -> Column:
    """True where the name matches any of the shell patterns (``*``, ``?``, ``[set]``, ``[!set]``)."""
    out = F.lit(False)
    for glob in globs:
        out = out | c.rlike("(?s)^" + _glob_regex(glob) + r"\z")
    return out


# A set holds at least one character, so a bracket right after its opening belongs to it.
_GLOB_PART = re.compile(r"(?P<many>\*)|(?P<one>\?)|\[(?P<none>!?)(?P<set>\]?[^\]]*)\]|(?P<plain>.)", re.DOTALL)


def _glob_regex(glob: str) -> str:
    def part(m: re.Match) -> str:
        if m["many"]:
            return ".*"
        if m["one"]:
            return "."
        if m["plain"]:
            return re.escape(m["plain"])
        if not m["set"]:
            return re.escape(m[0])
        return f"[{'^' if m['none'] else ''}{re.sub(r'([\\^&~|[\]])', r'\\\1', m['set'])}]"

    return _GLOB_PART.sub(part, glob)
