"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that are not white space (Java's and RE2's own \s
# knows ASCII only). Naming the others and negating the class is twice as fast as
# listing the white space, because nearly every character hits the first range.
INK = (
    r"\x21-\x7E\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}"
    r"\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F"
)
WS = f"[^{INK}]"


def squeeze(col: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col, f"{WS}+", " "))


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | ~F.regexp_like(col, F.lit(f"[{INK}]"))


def words(col: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.array_remove(F.split(col, f"{WS}+"), "")


def capitalise(col: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def _accent_pairs() -> dict[str, str]:
    """Single letters with marks → their ASCII base, derived from Unicode itself."""
    import unicodedata

    pairs = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}
    for low, high in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(low, high):
            base = unicodedata.normalize("NFKD", chr(code))[0]
            if base.isascii() and base.isalpha():
                pairs.setdefault(chr(code), base)
    return pairs


def fold_accents(col: Column) -> Column:
    """Latin letters with marks become ASCII; combining marks go away."""
    pairs = _accent_pairs()
    decomposed = F.regexp_replace(col, r"\p{Mn}+", "")
    folded = F.translate(decomposed, "".join(pairs), "".join(pairs.values()))
    # Letters that spell out as two.
    for letter, spelled in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th")):
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def norm_predicate(col: Column) -> Column:
    """Relation names: ASCII, lower case, spaces as underscores."""
    return F.replace(F.lower(fold_accents(col)), F.lit(" "), F.lit("_"))
