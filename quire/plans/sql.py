"""Pieces of DuckDB SQL that several oracles share."""

SQUASH = "trim(regexp_replace(nfc_normalize({x}), '[\\s\\v\\p{{Z}}]+', ' ', 'g'))"
FOLD = "replace(lower(strip_accents({x})), 'ß', 'ss')"
TITLE_KEY = "regexp_replace(trim(regexp_replace(" + FOLD + ", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(a|an|the) ', '')"
WORDS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"
FIRST_LINE = "split_part(text, chr(10), 1)"


def squash(x: str) -> str:
    return SQUASH.format(x=x)


def fold(x: str) -> str:
    return FOLD.format(x=x)


def title_key(x: str) -> str:
    return TITLE_KEY.format(x=x)


def words(x: str) -> str:
    return WORDS.format(x=x)


def shingles(w: str, width: int = 6) -> str:
    """Distinct blank-joined runs of the list ``w``."""
    return f"(CASE WHEN len({w}) >= {width} THEN list_distinct(list_transform(range(1, len({w}) - {width} + 2), lambda i: array_to_string({w}[i:i + {width - 1}], ' '))) ELSE [] END)"


#: Captions of all the forms that labels take, and of some that only look like one; ``@`` stands for a number.
CAPTIONS = ["Fig. @ A wave", "Table values of @", "Table XL: @", "Table 3A of @", "Figure 3abc @", "Supplementary Table @", "Supplementary Fig. @b", "Tab. @. Rows", "FIG @ x", "table @", "Figure S@: part"]


def captions(number: str) -> str:
    """SQL of both engines: one of ``CAPTIONS`` by ``number``, with it in place of ``@``."""
    listed = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CAPTIONS))
    return f"replace(CASE {number} % {len(CAPTIONS)} {listed} END, '@', CAST({number} AS STRING))"


def label(caption: str, pattern: str) -> str:
    """DuckDB SQL: the pattern's first group, null where it doesn't match."""
    return f"nullif(regexp_extract({caption}, '{pattern.removeprefix('(?U)')}', 1), '')"
