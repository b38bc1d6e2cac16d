"""SQL fragments shared by the oracles; the twins of the column functions."""

from __future__ import annotations

from ..functions.text import SPACE

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def filled(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '[^{SPACE}]')"


def alnum(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def tokens(x: str) -> str:
    return words(alnum(x))


def draw(seed, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 15) AS BIGINT)"


def lit(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def word_start(x: str, alternatives: str) -> str:
    """The word (or word prefix) pattern at a word boundary, letters of either case."""
    return rf"regexp_matches({x}, '(?i)(^|{NOT_WORD})({alternatives})')"


def whole_word(x: str, alternatives: str) -> str:
    return rf"regexp_matches({x}, '(?i)(^|{NOT_WORD})({alternatives})({NOT_WORD}|$)')"


def base_name(x: str) -> str:
    return f"list_extract(string_split({x}, '/'), -1)"


def view_of(x: str) -> str:
    name = f"lower({base_name(x)})"
    f, l = f"contains({name}, 'frontal')", f"contains({name}, 'lateral')"
    return f"CASE WHEN {f} AND NOT {l} THEN 'frontal' WHEN {l} AND NOT {f} THEN 'lateral' END"


def n_view(paths: str, view: str) -> str:
    cond = f"({view_of('p')}) IS NULL" if view == "unknown" else f"coalesce(({view_of('p')}) = '{view}', false)"
    return f"CAST(len([p for p in {paths} if {cond}]) AS BIGINT)"


# Private-use characters that stand for a protected full stop and semicolon.
PROTECTED = {r"\.": chr(0xE000), ";": chr(0xE001)}


def sentences_sql(x: str) -> str:
    """Sentence list without look-behind: marks that touch a digit are protected first."""
    text, piece = f"coalesce({x}, '')", "p"
    for mark, sign in PROTECTED.items():
        text = rf"regexp_replace({text}, '([0-9]){mark}', '\1{sign}', 'g')"
        text = rf"regexp_replace({text}, '{mark}([0-9])', '{sign}\1', 'g')"
        piece = f"replace({piece}, '{sign}', '{mark[-1]}')"
    bare = rf"regexp_replace({piece}, '^\s*([0-9]+\s*[.)]|[-•*])\s*', '')"
    clean = rf"regexp_replace(lower({squash(bare)}), '^[.,;: ]+|[.,;: ]+\z', '', 'g')"
    pieces = rf"[{clean} for p in regexp_split_to_array({text}, '[.;]|\n+')]"
    return f"[q for q in {pieces} if len({words('q')}) >= 3]"
