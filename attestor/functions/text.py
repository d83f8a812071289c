"""Text columns: normal forms, hashes, cuts, markers, redaction. All expressions stay in the JVM; white space means space, tab, newline and the like of ASCII."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\r\n\f\x0B]+"


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text in lower case with single spaces."""
    return F.left(F.sha2(F.lower(one_spaced(text)), 256), F.lit(16))


def digest12(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n\f\x0B]+")), F.lit(0))


def cleaned(text: Column) -> Column:
    """Spaces and tabs to one space, no spaces around newlines, at most one empty line."""
    a = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(a, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters, back to the last paragraph break or else sentence end, if that lies past 60 %."""
    head = F.left(text, F.lit(most))
    paragraph = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    sentence = F.length(head) - F.instr(F.reverse(head), " .")
    p_ok = (F.instr(F.reverse(head), "\n\n") > 0) & (paragraph > 0.6 * most)
    s_ok = (F.instr(F.reverse(head), " .") > 0) & (sentence > 0.6 * most)
    cut = F.when(p_ok, F.left(head, paragraph)).when(s_ok, F.left(head, sentence)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(cut))


def unmarked(markdown: Column) -> Column:
    """Markdown without images, links, headings, emphasis, code marks and rules."""
    t = F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^#{1,6} +", "")
    return F.trim(F.regexp_replace(t, r"[*_`]+", ""))


#: Typographic characters and what they match as.
TYPOGRAPHIC, PLAIN = "‘’“”–— ", "''\"\"-- "


def for_match(text: Column) -> Column:
    return F.lower(one_spaced(F.translate(text, TYPOGRAPHIC, PLAIN)))


def claim_normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(one_spaced(text)), r"[. ]+$", "")


def content_words(text: Column, stopwords: Sequence[str]) -> Column:
    """Sorted distinct words of a-z and 0-9, longer than one character, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))))


def markers(text: Column) -> Column:
    """Ids in brackets, as in [S1] or [S1, S2], distinct and in order."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(S[0-9]+(?:, ?S[0-9]+)*)\]"), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, ", ?"))))


def unmarkered(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r" ?\[S[0-9]+(?:, ?S[0-9]+)*\]", ""))


def clipped(text: Column, most: int) -> Column:
    """At most `most` characters, at a word's end, with an ellipsis where something was cut."""
    cut = F.regexp_extract(F.left(text, F.lit(most)), r"^(.*)[ \n]", 1)
    head = F.when(cut == "", F.left(text, F.lit(most))).otherwise(F.rtrim(cut))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("…")))


def first_sentence(text: Column, most: int) -> Column:
    return F.left(F.regexp_extract(F.trim(text), r"^([^.\n]*)", 1), F.lit(most))


def safe_text(text: Column, most: int = 300) -> Column:
    """Without control characters and markup signs, one-spaced, at most `most` characters."""
    t = one_spaced(F.regexp_replace(F.translate(text, "<>`|[]", ""), r"[\x00-\x1F\x7F]", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))).otherwise(t)


def blinded(text: Column, names: Sequence[str]) -> tuple[Column, Column]:
    """(text with the names, in any case and the longest first, replaced by [model]; number of replacements)."""
    pattern = "(?i)(" + "|".join(sorted(names, key=len, reverse=True)) + ")"
    return F.regexp_replace(text, pattern, "[model]"), F.regexp_count(text, F.lit(pattern))


def scrubbed(text: Column) -> Column:
    """Key-like strings replaced."""
    t = F.regexp_replace(text, r"(sk|tvly|pk|ghp)[-_][A-Za-z0-9_-]{8,}", "[redacted]")
    return F.regexp_replace(t, r"[Bb]earer [A-Za-z0-9._-]{8,}", "[redacted]")


def token_bound(texts: Sequence[Column]) -> Column:
    """An upper bound of the tokens of a call: UTF-8 bytes, 8 for each message and 8 to begin with."""
    total = F.lit(8)
    for t in texts:
        total = total + F.coalesce(F.octet_length(t), F.lit(0)) + 8
    return total


def id_order(identifier: Column) -> Column:
    """A sort key of ids: their first number, then their text."""
    return F.struct(F.coalesce(F.regexp_extract(identifier, r"(\d+)", 1).try_cast("long"), F.lit(0)).alias("number"), identifier.alias("id"))


def ordinal(prefix: str, start: int, place: Column) -> Column:
    return F.concat(F.lit(prefix), (place + start - 1).cast("string"))


def names_no(text: Column, names: Sequence[str]) -> Column:
    """Whether a text holds none of the names, in any case."""
    return ~F.coalesce(text, F.lit("")).rlike("(?i)(" + "|".join(sorted(names, key=len, reverse=True)) + ")")


def without_quotes(markdown: Column) -> Column:
    """Quoted lines (`> ...`) replaced by a note of their length."""
    lines = F.split(markdown, "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*> ?\S"), F.concat(F.lit("> [REDACTED: "), F.length(x).cast("string"), F.lit(" characters]"))).otherwise(x)), "\n")


def redacted(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("[REDACTED: "), F.length(text).cast("string"), F.lit(" characters]"))).otherwise("")


def neutralised(text: Column) -> Column:
    """Text that can't close a block of untrusted text: runs of three and more signs that part blocks are cut to two."""
    return F.regexp_replace(F.regexp_replace(text, r"<{3,}", "<<"), r">{3,}", ">>")
