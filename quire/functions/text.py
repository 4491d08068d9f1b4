"""Text normalisation as Column expressions: folding, keys, words, LaTeX and glyph counts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition and what they are written as in ASCII.
TRANSLITERATIONS = [("ł", "l"), ("Ł", "L"), ("ø", "o"), ("Ø", "O"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"), ("đ", "d"), ("Đ", "D"), ("þ", "th"), ("Þ", "Th"), ("ð", "d"), ("Ð", "D"), ("ı", "i")]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value as a lambda's argument: however often ``f`` names it, it is computed, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _combining() -> str:
    """A regex class of the characters with a combining class, made by rule; the mark test comes first as it is quick."""
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    starts = [c for i, c in enumerate(marks) if not i or marks[i - 1] != c - 1]
    ends = [c for i, c in enumerate(marks) if i + 1 == len(marks) or marks[i + 1] != c + 1]
    return r"[\p{M}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]]+"


_COMBINING = _combining()


def _beyond_ascii(text: Column, other: Column, plain: Column | None = None) -> Column:
    """``other`` where the text has characters beyond ASCII, else ``plain`` or the text itself."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(text if plain is None else plain)


def _normalizer(method: str, text: Column, compatible: bool) -> Column:
    """Unicode normalisation by the ICU library that Spark brings along, in the JVM."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compatible))


def nfc(text: Column) -> Column:
    """Canonically composed."""
    return _beyond_ascii(text, _normalizer("compose", text, False))


def _bare(text: Column) -> Column:
    return F.regexp_replace(_normalizer("decompose", text, True), _COMBINING, "")


def unaccent(text: Column) -> Column:
    """Compatibility forms taken apart, and combining marks dropped."""
    return _beyond_ascii(text, _bare(text))


def fold(text: Column) -> Column:
    """Case-folded, compatibility forms taken apart, without marks."""
    return _beyond_ascii(text, F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _bare(text), F.lit(True)), F.lower(text))


def squash(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalized(text: Column) -> Column:
    """Composed and squashed: what a text's digest is of."""
    return squash(nfc(text))


def squash_key(text: Column) -> Column:
    """``squash``, in lower case."""
    return F.lower(squash(text))


def title_key(title: Column) -> Column:
    """The words of a folded title; a leading article goes if another word follows."""
    return F.regexp_replace(F.trim(F.regexp_replace(fold(title), r"[^\p{L}\p{N}]+", " ")), r"^(a|an|the) ", "")


def words(text: Column) -> Column:
    """Folded words: runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def text_digest(text: Column) -> Column:
    """SHA-256 of the text, composed and with white space collapsed."""
    return F.sha2(normalized(text), 256)


def ascii_fold(text: Column) -> Column:
    """ASCII letters for marked and joined ones; what has none is dropped."""
    out = text
    for a, b in TRANSLITERATIONS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(unaccent(out), r"[^\x00-\x7F]", "")


def latex_key(latex: Column) -> Column:
    """LaTeX without tags, spacing, sizing and upright commands, braces and blanks."""
    bare = F.regexp_replace(latex, r"\\tag\*?\{[^{}]*\}", "")
    bare = F.regexp_replace(bare, r"\\(?:quad|qquad|[,;:!> ])", "")
    return F.regexp_replace(bare, r"\\(?:left|right|mathrm|rm|text)(?![A-Za-z])|[{}\s]", "")


def control_characters(text: Column) -> Column:
    """How many control characters other than tab and newline."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\p{Cc}&&[^\t\n]]", ""))


def glyph_codes(text: Column) -> Column:
    """How many ``.0ddd`` glyph codes stand where no digit adjoins."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?<!\d)\.0\d{3}(?!\d)"), F.lit(0)))


# The Greek letters' names in TeX; the variants stand for the same letters.
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega"]
VARIANTS = ["epsilon", "theta", "pi", "rho", "sigma", "phi"]


def _greek_letters() -> dict[str, str]:
    """The letter of each name: small, capital where the name is, and variants."""
    letter = lambda case, name: unicodedata.lookup(f"GREEK {case} LETTER {'LAMDA' if name == 'lambda' else name.upper()}")
    return {n: letter("SMALL", n) for n in GREEK} | {n.capitalize(): letter("CAPITAL", n) for n in GREEK} | {f"var{n}": letter("SMALL", n) for n in VARIANTS}


_GREEK_LETTERS = _greek_letters()
#: Characters of HTML's named entities: those that stand for one character of Latin, Greek, signs or punctuation.
_ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and len(k) <= 9 and len(v) == 1 and ord(v) < 0x2300}


def _table(entries: dict[str, str]) -> str:
    """Names and single characters as one string, which is searched in place of a map of as many expressions."""
    return "".join(f"\x01{name};{character}" for name, character in entries.items()) + "\x01"


def _looked_up(table: str, name: Column) -> Column:
    """The character of a name of ``_table``; null for another."""
    at = F.instr(F.lit(table), F.concat(F.lit("\x01"), name, F.lit(";")))
    return F.when(at > 0, F.substr(F.lit(table), at + F.length(name) + 2, F.lit(1)))


def _spelled(text: Column, shape: str) -> Column:
    """Greek letters for their names where ``shape`` (a pattern with one group for the name) is found."""

    def spelled(t: Column) -> Column:
        names = F.regexp_extract_all(t, F.lit(shape), F.lit(1))
        joined = F.array_join(F.zip_with(F.split(t, shape, -1), names, lambda p, n: F.concat(p, F.coalesce(_looked_up(_GREEK_TABLE, n), F.lit("")))), "")
        return F.when(t.rlike(shape), joined).otherwise(t)

    return once(text, spelled)


_GREEK_TABLE, _ENTITY_TABLE = _table(_GREEK_LETTERS), _table(_ENTITIES)


def _with_greek(text: Column) -> Column:
    names = "|".join(sorted(_GREEK_LETTERS, key=len, reverse=True))
    return _spelled(_spelled(text, rf"\[({names})\]"), rf"\\({names})(?![A-Za-z])")


def _without_tex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\[A-Za-z]+\s*", ""), r"[{}_^$\\]", "")


def unescaped(text: Column) -> Column:
    """Characters for HTML entities: numbers, and names of the usual length."""
    return once(text, _unescaped)


def _unescaped(text: Column) -> Column:
    entity = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
    def character(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(wide, _looked_up(_ENTITY_TABLE, name), F.concat(F.lit("&"), name, F.lit(";")))

    names = F.regexp_extract_all(text, F.lit(entity), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.zip_with(F.split(text, entity, -1), names, lambda p, n: F.concat(p, F.when(n.isNotNull(), character(n)).otherwise(""))), "")).otherwise(text)


def math_as_text(latex: Column) -> Column:
    """Inline LaTeX as a reader sees it: Greek letters, no commands, braces, script marks and blanks."""
    return F.replace(_without_tex(_with_greek(latex)), F.lit(" "), F.lit(""))


def clean_title(title: Column) -> Column:
    """A title without tags, entities, TeX, lost glyphs and trailing footnote marks, single-spaced."""
    bare = _with_greek(unescaped(F.regexp_replace(title, r"</?[A-Za-z][^>]*>", "")))
    bare = once(bare, lambda b: F.when(b.rlike(r"[\\_^{}$]"), _without_tex(b)).otherwise(b))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\[\?\]|\x{FFFD}", " "), r"(?U)[\s*†‡§¶]+$", "")
    return squash(bare)


def plausible_title(text: Column) -> Column:
    """Three letters at least, and not a file name, a tool's name or an identifier."""
    bad = r"(?i)\.(?:pdf|docx?|tex|dvi|indd|qxd)\b|^microsoft word|^untitled|^doi:|^10\.\d{4}|^arxiv:"
    return (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3) & ~text.rlike(bad)


def first_line(text: Column) -> Column:
    """What stands before the first newline."""
    return F.split(text, "\n", 2)[0]


def front_matter_removed(markdown: Column) -> Column:
    """Markdown without a leading YAML block."""
    return F.regexp_replace(markdown, r"(?s)\A---\n.*?\n---\n", "")


def markdown_cell(value: Column) -> Column:
    """A value as a Markdown table cell: bars escaped, newlines blank."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
