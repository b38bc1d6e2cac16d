"""Label sets: tagging, validation, rendering and parsing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import any_in, find
from .binding import let
from .text import strip_ws
from .vocabulary import TagRules, Vocabulary


def lit_strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lit_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _tagged(tags: pa.ListArray, rules: TagRules) -> pa.ListArray:
    """Labels of lists of lower-case tags, all tags searched at once."""
    labels = [label for label, _ in rules.rules]
    narrow, wide, residual = ({} for _ in range(3))
    for n, (_, keywords) in enumerate(rules.rules):
        for k in keywords:
            scope = wide if k in rules.whole_tag_keywords else narrow
            for word in rules.aliases.get(k, (k,)):
                scope.setdefault(word, set()).add(n)
    for word in rules.residual[1] if rules.residual else ():
        residual[word] = {labels.index(rules.residual[0])} if rules.residual[0] in labels else set()
    words = tuple(sorted({*narrow, *wide, *residual}))
    flat = tags.flatten()
    count, width = len(flat), max(len(labels), 1)
    rows = np.repeat(np.arange(len(tags)), np.asarray(pc.fill_null(pc.list_value_length(tags), 0)))
    hits = find(flat.to_pylist(), words)

    def marked(scope: dict[str, set[int]], open_hits: np.ndarray) -> np.ndarray:
        """(tag, label) of the hits, as one number each."""
        out = [np.zeros(0, dtype=np.int64)]
        text, keyword = hits.text[open_hits], hits.keyword[open_hits]
        for n in range(len(labels)):
            own = np.array([n in scope.get(w, ()) for w in words])
            if own.any():
                out.append(text[own[keyword]] * width + n)
        return np.concatenate(out)

    direct = np.unique(np.concatenate([marked(narrow, hits.before_slash), marked(wide, np.ones(len(hits.text), dtype=bool))]))
    has_direct = np.zeros(count, dtype=bool)
    has_direct[direct // width] = True
    rest = marked(residual, ~has_direct[hits.text])
    # A residual term counts even if its label is not among the others; the row is then no fallback, but has no such label.
    touched = np.zeros(len(tags), dtype=bool)
    touched[rows[direct // width]] = True
    terms = np.array([w in residual for w in words], dtype=bool)
    if len(hits.text):
        touched[rows[hits.text[terms[hits.keyword] & ~has_direct[hits.text]]]] = True
    both = np.concatenate([direct, rest])
    found = np.unique(rows[both // width] * width + both % width)  # by row, then in canonical order
    normal, skipped = any_in(flat, rules.normal_tokens), any_in(flat, (*rules.normal_tokens, *rules.unindexed_tokens))
    all_normal, all_skipped = np.ones(len(tags), dtype=bool), np.ones(len(tags), dtype=bool)
    all_normal[rows[~normal]] = False
    all_skipped[rows[~skipped]] = False
    names = np.array([*labels, rules.healthy, rules.unlabeled, rules.other], dtype=object)
    fallback = len(labels) + np.where(all_normal, 0, np.where(all_skipped, 1, 2))
    alone = np.flatnonzero(~touched)
    row = np.concatenate([found // width, alone])
    label = np.concatenate([found % width, fallback[alone]])
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=len(tags)))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(names[label[order]], pa.string()))


def tag_labels(tags: Column, rules: TagRules) -> Column:
    """Labels of an array of tags, in canonical order, with fallbacks.

    A keyword counts where it begins at a word boundary of the part before the
    first slash, or of the whole tag for ``whole_tag_keywords``. All keywords are
    found in one pass by an automaton; a rule table of any size costs the same.
    """

    @F.arrow_udf("array<string>")
    def label(lists: pa.Array) -> pa.Array:
        return _tagged(lists.fill_null([]) if lists.null_count else lists, rules)

    return label(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))


def map_vocabulary(labels: Column, names: dict[str, str]) -> Column:
    """``struct(labels, violation)``: renamed in order, or why it cannot be."""
    table = lit_map(names)
    renamed = F.transform(labels, lambda l: F.try_element_at(table, l))
    violation = (
        F.when(labels.isNull(), "not_a_list")
        .when(F.size(labels) == 0, "empty")
        .when(F.exists(renamed, lambda l: l.isNull()), "unknown_label")
    )
    return F.struct(F.when(violation.isNull(), renamed).alias("labels"), violation.alias("violation"))


def canonical_labels(labels: Column, vocab, exclusive: str = "No Finding") -> Column:
    """``struct(labels, violation)``: distinct, exclusive label dropped when mixed, ordered."""
    known = lit_strings(vocab)
    kept = F.array_distinct(labels)
    kept = F.when(F.size(kept) > 1, F.array_remove(kept, exclusive)).otherwise(kept)
    violation = (
        F.when(labels.isNull() | (F.size(labels) == 0), "empty")
        .when(F.size(F.array_except(labels, known)) > 0, "unknown_label")
    )
    ordered = F.filter(known, lambda v: F.array_contains(kept, v))
    return F.struct(F.when(violation.isNull(), ordered).alias("labels"), violation.alias("violation"))


def stratum(labels: Column, vocab: Vocabulary) -> Column:
    return (
        F.when(labels == lit_strings([vocab.healthy]), "healthy")
        .when(F.arrays_overlap(labels, lit_strings(vocab.labels)), "pathological")
        .otherwise("other")
    )


def ordered_positive(labels: Column, vocab: Vocabulary, with_fallbacks: bool = False) -> Column:
    known = lit_strings((*vocab.labels, *(vocab.fallbacks if with_fallbacks else ())))
    healthy = lit_strings([vocab.healthy])
    return F.when(labels == healthy, healthy).otherwise(
        F.filter(known, lambda v: F.array_contains(labels, v))
    )


def render_label_target(
    labels: Column, vocab: Vocabulary, target_format: str = "positive_only",
    with_fallbacks: bool = False, header: str = "Clinical findings:",
) -> Column:
    """Label list as the text a model has to write."""
    if target_format == "dense_binary":
        known = lit_strings((*vocab.labels, *(vocab.fallbacks if with_fallbacks else ())))
        lines = F.transform(
            known, lambda v: F.concat(v, F.when(F.array_contains(labels, v), ": Present").otherwise(": Absent"))
        )
    elif target_format == "positive_only":
        lines = ordered_positive(labels, vocab, with_fallbacks)
    else:
        raise ValueError(f"unknown target format {target_format!r}")
    return F.concat(F.lit(header + "\n"), F.array_join(lines, "\n"))


# Line breaks and the bullets or numbers that may start a line.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
LINE_BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"


def _lines(text: Column) -> Column:
    def clean(line: Column) -> Column:
        return F.regexp_replace(strip_ws(F.regexp_replace(line, LINE_BULLET, "")), r"[.:]+\z", "")

    broken = F.regexp_replace(F.coalesce(text, F.lit("")), "[;,]", "\n")
    return F.transform(F.split(broken, LINE_BREAK), clean)


def _lookup(values) -> Column:
    return lit_map({v.lower(): v for v in values})


def _dense_rows(text: Column, known) -> Column:
    """``array<struct(label, status)>`` of the lines that carry a known label and a colon."""
    table = _lookup(known)

    def parse(line: Column) -> Column:
        label = F.regexp_extract(line, r"(?s)^(.*):(.*)\z", 1)
        status = F.regexp_extract(line, r"(?s)^(.*):(.*)\z", 2)
        return F.struct(
            F.try_element_at(table, F.lower(strip_ws(label))).alias("label"),
            F.lower(F.regexp_replace(strip_ws(status), r"\.+\z", "")).alias("status"),
        )

    with_colon = F.filter(_lines(text), lambda l: F.contains(l, F.lit(":")))
    return F.filter(F.transform(with_colon, parse), lambda r: r.label.isNotNull())


def _status_sets(rows: Column) -> dict[str, Column]:
    """Labels of dense rows by what their status says."""
    valid = F.filter(rows, lambda r: r.status.isin("present", "absent"))
    return {
        "seen": F.transform(valid, lambda r: r.label),
        "bad": F.transform(F.filter(rows, lambda r: ~r.status.isin("present", "absent")), lambda r: r.label),
        "present": F.transform(F.filter(rows, lambda r: r.status == "present"), lambda r: r.label),
    }


def _dense_report(sets: Column, every: Column) -> Column:
    missing = F.filter(every, lambda v: ~F.array_contains(sets.seen, v))
    duplicate = F.filter(every, lambda v: F.size(F.filter(sets.seen, lambda s: s == v)) > 1)
    invalid = F.filter(every, lambda v: F.array_contains(sets.bad, v))
    return let(
        lambda r: F.struct(
            ((F.size(r.missing) == 0) & (F.size(r.duplicate) == 0) & (F.size(r.invalid) == 0)).alias("complete"),
            F.size(F.array_distinct(sets.seen)).alias("recognized_count"),
            r.missing.alias("missing_labels"),
            r.duplicate.alias("duplicate_labels"),
            r.invalid.alias("invalid_labels"),
        ),
        missing=missing, duplicate=duplicate, invalid=invalid,
    )


def _with_sets(text: Column, known, body) -> Column:
    return let(lambda v: let(body, **_status_sets(v.rows)), rows=_dense_rows(text, known))


def dense_format_report(text: Column, vocab: Vocabulary, with_fallbacks: bool = False) -> Column:
    """How complete a present/absent listing is, with labels in vocabulary order."""
    known = (*vocab.labels, *(vocab.fallbacks if with_fallbacks else ()))
    return _with_sets(text, known, lambda sets: _dense_report(sets, lit_strings(known)))


def parse_label_lines(
    text: Column, vocab: Vocabulary, target_format: str = "positive_only", with_fallbacks: bool = False
) -> Column:
    """Labels a text states, dense listing first, else one exact label per line."""
    known = (*vocab.labels, *(vocab.fallbacks if with_fallbacks else ()))
    none = lit_strings([])

    def dense(sets: Column) -> Column:
        positive = F.filter(lit_strings(known), lambda v: F.array_contains(sets.present, v))
        complete = _dense_report(sets, lit_strings(known)).complete
        stated = (F.size(sets.seen) > 0) | (F.size(sets.bad) > 0)
        found = F.when(F.size(sets.present) > 0, positive).when(complete, lit_strings([vocab.healthy])).otherwise(none)
        return F.when(stated, found)

    if target_format == "dense_binary":
        loose = none
    else:
        scored = (*vocab.scored, *(vocab.fallbacks if with_fallbacks else ()))
        table = _lookup(scored)
        loose = let(
            lambda v: F.filter(lit_strings(scored), lambda l: F.array_contains(v.stated, l)),
            stated=F.transform(_lines(text), lambda l: F.try_element_at(table, F.lower(l))),
        )
    return F.coalesce(_with_sets(text, known, dense), loose)


def mentions(text: Column, lexicon: dict[str, str], only: Column | None = None) -> Column:
    """Lexicon entries whose pattern occurs in the text, in the order given."""
    hits = [F.when(text.rlike(f"(?iU){pattern}"), F.lit(name)) for name, pattern in lexicon.items()]
    found = F.array_compact(F.array(*hits))
    if only is None:
        return found
    return F.filter(only, lambda l: F.array_contains(found, l))


# Statements that deny a finding, and the mass words.
NEGATIVE_STATEMENT = (
    r"(nessun|non si (osserv|rilev|eviden|identific)|assenza di|negativ|"
    r"nella norma|nei limiti|non vi (e|è|sono)|torace normale|"
    r"esame .{0,20}normale|non presenta)"
)
MASS_WORDS = r"\bmass[ae]\b|\bnodul|\btumor|neoplas|carcinom"
# Italian mention patterns per clinical label.
ITALIAN_MENTIONS = {
    "Cardiomegaly": r"cardiomegal|cuore .{0,25}(ingrandi|aumentat|grande)|"
                    r"dimensioni cardiache .{0,25}(aumentat|ingrandi)|ingrandimento cardiaco",
    "Pleural Effusion": r"versament|effusion",
    "Pneumothorax": r"pneumotorac|pneumothorax",
    "Atelectasis": r"atelettas|atelectas",
    "Edema": r"edema|congestione vascolare|ipertensione venosa",
    "Consolidation": r"consolida|addensament",
    "Pneumonia": r"polmonit|pneumoni",
    "Lung Lesion": r"nodul|\bmass[ae]\b|lesion|granulom",
    "Lung Opacity": r"opacit|infiltrat",
    "Fracture": r"frattur",
    "Support Devices": r"catetere|sondino|tubo|pacemaker|sternotom|clip|picc|port|elettrod",
    "Enlarged Cardiomediastinum": r"mediastin.{0,30}(allarg|prominen|ingrandi)|"
                                  r"(allarg|prominen).{0,20}mediastin",
    "Pleural Other": r"pleuric|pleural|ispessiment",
}


def is_negative(findings: Column, impression: Column, pattern: str = NEGATIVE_STATEMENT) -> Column:
    """The impression, or the findings without one, matches the negative pattern."""
    text = F.coalesce(F.nullif(impression, F.lit("")), findings, F.lit(""))
    return text.rlike(f"(?iU){pattern}")
