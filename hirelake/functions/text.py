"""Text clean-up as native column expressions.

The rules were written for a regex engine with ASCII word boundaries and a wide notion of white
space; `words` and `WS` restate both for the JVM engine.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the rules mean it: ASCII blanks, no-break and typographic spaces, BOM.
_BLANKS = [0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE_BLANKS = "".join(map(chr, _BLANKS))
WS_CHARS = r"\s" + _WIDE_BLANKS
_BLANK_SET = " \t\n\x0b\f\r" + _WIDE_BLANKS
_MARKS = f"[{chr(0x300)}-{chr(0x36F)}]"
WS = f"[{WS_CHARS}]"

_BOUNDARY = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)

# Letters and signs beyond ASCII that patterns name, and what stands for each in a plain form.
_NAMED = "éèêàóô’"
_STAND_INS = "".join(chr(0xE000 + i) for i in range(len(_NAMED)))
# Letters that the JVM takes for ASCII ones when it ignores case; texts with them are read by the patterns as written.
_ODD = "[" + "".join(map(chr, (0x17F, 0x1E9B, 0x212A, 0x130, 0x131))) + "]"
STRANGE = chr(1)  # any other character in a plain form: no letter, no blank, in no pattern

# --- fixed values: named entities -------------------------------------------------
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "hellip": "…", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ocirc": "ô",
    "ucirc": "û", "icirc": "î", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
    "amp": "&",  # an ampersand it frees does not start another entity
}


def words(pattern: str, ignore_case: bool = True) -> str:
    """A pattern whose `\\b`, `\\s` and `$` keep their ASCII / whole-string meaning on the JVM."""
    out = pattern.replace(r"\b", _BOUNDARY).replace(r"[\s", f"[{WS_CHARS}").replace(r"\s", WS)
    if out.endswith("$"):
        out = out[:-1] + r"\z"
    return ("(?iu)" if ignore_case else "") + out


def ascii_only(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def odd(c: Column) -> Column:
    return ~ascii_only(c) & c.rlike(_ODD)


def plain_form(c: Column) -> Column:
    """The text in lower-case ASCII, for `plain_pattern`: the JVM's own word boundaries and blanks hold there, which cost a
    fraction of the spelled-out ones. Not for texts that are `odd`."""
    kept = _NAMED + _NAMED.upper()
    t = F.translate(c, _WIDE_BLANKS, "\t" * len(_WIDE_BLANKS))
    t = F.regexp_replace(t, rf"[^\x00-\x7F{kept}]", STRANGE)
    return F.lower(F.when(ascii_only(c), c).otherwise(F.translate(t, kept, _STAND_INS * 2)))


def plain_pattern(pattern: str) -> str:
    """Finds in a plain form what `words(pattern)` finds in the text; the pattern is written in lower case."""
    out = pattern.translate(str.maketrans(_NAMED, _STAND_INS))
    if re.search(r"[A-Z]", re.sub(r"\\.", "", out)) or not all(c in _STAND_INS or c < chr(128) for c in out):
        raise ValueError(f"no plain form of {pattern}")
    return out[:-1] + r"\z" if out.endswith("$") else out


def searched(c: Column, use) -> Column:
    """`use(has)`, where `has(pattern)` is `c.rlike(words(pattern))`; the text is worked out once for all patterns."""
    plain = lambda v: bind(plain_form(v), lambda t: use(lambda p: t.rlike(plain_pattern(p))))
    return bind(c, lambda v: F.when(odd(v), use(lambda p: v.rlike(words(p)))).otherwise(plain(v)))


def matches(c: Column, pattern: str) -> Column:
    """`c.rlike(words(pattern))`."""
    return searched(c, lambda has: has(pattern))


def _accent_table() -> tuple[str, str]:
    """Letters below U+2000 that decompose into one base character and combining marks."""
    src, dst = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(m) <= 0x36F for m in parts[1:]):
            src.append(chr(code))
            dst.append(parts[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold_accents(c: Column) -> Column:
    """Letters without their accents, case kept. ASCII text passes by."""
    plain = lambda v: F.regexp_replace(F.translate(v, _ACCENTED, _PLAIN), _MARKS, "")
    return bind(c, lambda v: F.when(ascii_only(v), v).otherwise(plain(v)))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK_SET))


def fold_place(c: Column) -> Column:
    """Accent-free, lower case, trimmed: the form dictionary keys are written in."""
    return trim_ws(F.lower(fold_accents(c)))


def fold_key(c: Column, unicode_fold: bool = False) -> Column:
    """Identity form: `[a-z0-9]` runs joined by one blank (any letters with `unicode_fold`)."""
    other = r"[^\p{L}\p{N}]+" if unicode_fold else r"[^a-z0-9]+"
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), other, " "))


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric_entity(part: Column) -> Column:
    hexa = F.regexp_extract(part, r"(?i)\A&#x([0-9a-f]{1,6});", 1)
    deci = F.regexp_extract(part, r"\A&#([0-9]{1,7});", 1)
    code = F.coalesce(
        F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("bigint"), deci.try_cast("bigint")
    )
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(
        usable, F.concat(_code_point(code), F.regexp_replace(part, r"\A&#[^;]*;", ""))
    ).otherwise(part)


def _named_entity(part: Column) -> Column:
    name = F.regexp_extract(part, r"\A&([A-Za-z]+);", 1)
    table = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
    char = F.try_element_at(table, F.lower(name))
    return F.when(char.isNotNull(), F.concat(char, F.regexp_replace(part, r"\A&[A-Za-z]+;", ""))).otherwise(part)


def decode_entities(c: Column) -> Column:
    """Numeric references, then the named ones; unknown names stay. Rows without `&` pass by.

    What a name gives is never read again, so all names go in one pass over the text cut in front of them.
    """
    known = f"(?i)&(?:{'|'.join(NAMED_ENTITIES)});"

    def each(v: Column, before: str, decode) -> Column:
        return F.array_join(F.transform(F.split(v, f"(?={before})"), decode), "")

    numeric = lambda v: F.when(v.contains("&#"), each(v, "&#", _numeric_entity)).otherwise(v)
    named = lambda v: F.when(v.rlike(known), each(v, known, _named_entity)).otherwise(v)
    return bind(c, lambda v: F.when(v.contains("&"), bind(numeric(v), named)).otherwise(v))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def trim_edges(c: Column) -> Column:
    """Blanks and the punctuation boards put around a value."""
    return F.btrim(c, F.lit(_BLANK_SET + "-–—•|,:"))


def clean_value(c: Column) -> Column:
    return trim_ws(trim_edges(squeeze(decode_entities(c))))


def strip_html(c: Column) -> Column:
    """Markup to text: block ends become line breaks, other tags a blank."""
    t = F.regexp_replace(c, r"(?i)<(script|style)[\s\S]*?</\1>", " ")
    t = F.regexp_replace(t, rf"(?i)<br{WS}*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|tr|h[1-6])>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]+>", " "))
    t = F.regexp_replace(t, f"[ \t{chr(0xA0)}]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return trim_ws(F.regexp_replace(t, "\n{3,}", "\n\n"))


def looks_like_html(c: Column) -> Column:
    return c.contains("<") & c.rlike(words(r"<(p|div|br|ul|ol|li|h[1-6]|strong|em|span|table)\b[^>]*>"))


def clip(c: Column, n: int | None = None) -> Column:
    """The text, or its first n characters; an empty result is NULL."""
    return F.nullif(c if n is None else F.substring(c, 1, n), F.lit(""))


def first_of(c: Column, n: int | None = None) -> Column:
    """The list, or its first n items."""
    return c if n is None else F.slice(c, 1, n)


def clean_list(c: Column, cap: int | None = None) -> Column:
    """Trimmed, non-empty, distinct in order, all or at most `cap`; NULL reads as empty."""
    kept = F.filter(F.transform(c, trim_ws), lambda x: F.length(x) > 0)
    return F.coalesce(first_of(F.array_distinct(kept), cap), F.array().cast("array<string>"))
