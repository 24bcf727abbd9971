"""Scalar functions as Column expressions: folding, codes, amounts, dates, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and what they fold to, letters that become two, and signs that separate words.
FOLD_FROM = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżžðșț"
FOLD_TO = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzzdst"
FOLD_PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
FOLD_APART = r"""[\s\-–—/_.,;:()"'’]+"""


def fold(text: Column) -> Column:
    """Lower case, accents off, signs between words one blank, a blank before: a word begins where ' word' occurs. Letters
    of other scripts and other signs stay. Null gives ' '."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO)
    for one, two in FOLD_PAIRS:
        plain = F.replace(plain, F.lit(one), F.lit(two))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, FOLD_APART, " ")))


def fold_sql(text: str) -> str:
    """The same in SQL."""
    plain = f"translate(lower(coalesce({text}, '')), '{FOLD_FROM}', '{FOLD_TO}')"
    for one, two in FOLD_PAIRS:
        plain = f"replace({plain}, '{one}', '{two}')"
    apart = FOLD_APART.replace("'", "''")
    return f"concat(' ', trim(regexp_replace({plain}, '{apart}', ' ', 'g'), ' '))"


def cpv_clean(codes: Column) -> Column:
    """Every eight-digit code of a list of texts, check digit off, each once, in order."""
    found = F.transform(codes, lambda c: F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{8})(?:-[0-9])?(?:[^0-9]|$)", 1))
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull() & (c != "")))


def cpv_heads(codes: Column) -> Column:
    """All prefixes of 2 to 8 digits of all codes, each once."""
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: F.transform(F.sequence(F.lit(2), F.least(F.lit(8), F.length(c))), lambda n: F.substring(c, F.lit(1), n)))))


def cpv_level(code: Column) -> Column:
    """A code without its trailing zeros, two digits at least."""
    return F.rpad(F.regexp_replace(code, "0+$", ""), F.greatest(F.lit(2), F.length(F.regexp_replace(code, "0+$", ""))), F.lit("0"))


def amount(text: Column) -> Column:
    """An amount with blanks, points or commas between thousands and two decimals at most; placeholders up to 1 are null."""
    bare = F.regexp_replace(text, r"[\s']", "")
    bare = F.regexp_replace(bare, r"[.,](?=[0-9]{3}([.,]|$))", "")
    value = F.translate(bare, ",", ".").try_cast("double")
    return F.when(value > 1, value)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9][0-9 ()-]{7,}[0-9]"


def redact(text: Column) -> Column:
    """E-mail addresses and international phone numbers by placeholders."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")


def slug(text: Column) -> Column:
    """The folded text's letters a to z and digits, all else one hyphen."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def all_words(folded: Column, words: list[str]) -> Column:
    """Every word begins a word of the folded text."""
    return reduce(lambda a, b: a & b, [folded.contains(" " + w) for w in words], F.lit(True))


def word_match(folded: Column, word: str) -> Column:
    """Short words match whole words, words of four letters beginnings, longer ones any place."""
    if len(word) <= 3:
        return F.concat(folded, F.lit(" ")).contains(f" {word} ")
    return folded.contains(f" {word}") if len(word) == 4 else folded.contains(word)


def canonical_hash(*columns: Column) -> Column:
    """Hash of the columns' texts with a separator that none of them can hold; nulls and empty texts differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def register_check_pl(nip: Column) -> Column:
    """Whether ten digits carry the check digit of their weighted sum."""
    digits = F.regexp_replace(nip, "[^0-9]", "")
    # Weights of the nine digits.
    weights = F.array(*[F.lit(w) for w in (6, 5, 7, 2, 3, 4, 5, 6, 7)])
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).try_cast("int") * F.element_at(weights, i))
    return (F.length(digits) == 10) & (total % 11 == F.substring(digits, 10, 1).try_cast("int"))
