"""Text scalars (C1, C1a-C1h, C3, C4, C10, C11, C12) as native regex expressions.

Java regex is ASCII by default; ``(?U)`` makes ``\\s \\d \\b \\w`` Unicode-aware
like Python's ``re`` on str patterns, so every pattern that uses them carries
the flag. Everything here stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning patterns, applied in this order.
HANDLE_PATTERN = r"u\/[A-Za-z0-9_-]+"
EMAIL_PATTERN = r"(?U)\S+@\S+"
PHONE_PATTERN = r"(?U)\b\d{10}\b"
HONORIFIC_PATTERN = r"(?iU)(dr|mr|ms|mrs)\.?\s+[A-Z][a-z]+"
HONORIFIC_PATTERN_BOUNDED = r"(?iU)\b(dr|mr|ms|mrs)\.?\s+[A-Z][a-z]+"
URL_PATTERN = r"(?U)http\S+|www\.\S+"
WHITELIST_PATTERN = r"(?U)[^A-Za-z0-9\s.,!?']"
SPACE_RUN_PATTERN = r"(?U)\s+"

# Code points with the Emoji property of the Unicode data (digits, # and *
# left out: they are emoji only in keycap sequences).
EMOJI_RANGES = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 "
    "25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A "
    "262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 "
    "269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 "
    "26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 "
    "2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C "
    "2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF "
    "1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B "
    "1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A "
    "1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 "
    "1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 "
    "1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 "
    "1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8 "
).split()
_EMOJI = "[" + "".join("-".join(f"\\x{{{c}}}" for c in r.split("-")) for r in EMOJI_RANGES) + "]"
# One emoji with its variation selector, skin tone or tags, and what joiners tie to it.
_EMOJI_UNIT = _EMOJI + r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}]*\x{20E3}?"
EMOJI_PATTERN = rf"[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_EMOJI_UNIT}(?:\x{{200D}}{_EMOJI_UNIT})*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rx(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def _rx_if(c: Column, holds, pattern: str, repl: str = "") -> Column:
    """:func:`_rx` where ``holds``, a cheap test that every text with a match passes."""
    return bound(c, lambda s: F.when(holds(s), _rx(s, pattern, repl)).otherwise(s))


# Cheap tests that every text with a match passes, by pattern.
MAY_MATCH = {
    HANDLE_PATTERN: lambda s: F.contains(s, F.lit("u/")),
    EMAIL_PATTERN: lambda s: F.contains(s, F.lit("@")),
    URL_PATTERN: lambda s: F.contains(s, F.lit("http")) | F.contains(s, F.lit("www.")),
    EMOJI_PATTERN: lambda s: F.octet_length(s) != F.length(s),
}
# Forms that match the same and take fewer steps: an address begins where its run of
# characters begins, a number or a title is looked for only where its first sign stands.
FASTER = {
    EMAIL_PATTERN: r"(?U)(?<!\S)\S+@\S+",
    EMOJI_PATTERN: rf"[0-9#*]\x{{FE0F}}?\x{{20E3}}|(?=[\xA9\xAE\x{{203C}}-\x{{1FAFF}}]){_EMOJI_UNIT}(?:\x{{200D}}{_EMOJI_UNIT})*",
    PHONE_PATTERN: r"(?U)(?=\d{10})\b\d{10}\b",
    HONORIFIC_PATTERN: r"(?iU)(?:dr|mrs?|ms)\.?\s+[A-Z][a-z]+",
    HONORIFIC_PATTERN_BOUNDED: r"(?iU)(?=[dm])\b(?:dr|mrs?|ms)\.?\s+[A-Z][a-z]+",
}
WHITELIST_RUN = WHITELIST_PATTERN + "+"
# The whitelist and the collapsing of white space at once: a run of characters that are outside
# the list or white space becomes one space; a single space stays as it is.
OUTSIDE_RUN = r"[^A-Za-z0-9.,!?']{2,}|[^A-Za-z0-9.,!?' ]"


def drop(c: Column, pattern: str) -> Column:
    """``c`` without the matches of one of this module's patterns."""
    fast = FASTER.get(pattern, pattern)
    return _rx_if(c, MAY_MATCH[pattern], fast) if pattern in MAY_MATCH else _rx(c, fast)


def remove_handles(c) -> Column:
    """C1a. No leading word boundary: "you/me" loses "u/me"."""
    return drop(_c(c), HANDLE_PATTERN)


def remove_emails(c) -> Column:
    """C1b."""
    return drop(_c(c), EMAIL_PATTERN)


def remove_phones(c) -> Column:
    """Exactly ten digits between word boundaries."""
    return drop(_c(c), PHONE_PATTERN)


def remove_honorifics(c, word_boundary: bool = False) -> Column:
    """C1d: title + capitalised name, case-insensitive.

    Default keeps the reference behaviour (no boundary before the title, so
    "symptoms are" loses "ms are"); ``word_boundary=True`` is the repaired form.
    """
    return drop(_c(c), HONORIFIC_PATTERN_BOUNDED if word_boundary else HONORIFIC_PATTERN)


def remove_urls(c) -> Column:
    """C1e."""
    return drop(_c(c), URL_PATTERN)


def remove_emoji(c) -> Column:
    """C1f: drop emoji, whole sequences at once. Symbols that are no emoji stay for the whitelist."""
    return drop(_c(c), EMOJI_PATTERN)


def whitelist_chars(c) -> Column:
    """C1g: newlines -> space, then anything outside [A-Za-z0-9 whitespace . , ! ? '] -> space."""
    s = F.translate(_c(c), "\n\r", "  ")
    return _rx(s, WHITELIST_PATTERN, " ")


def collapse_spaces(c) -> Column:
    """C1h: whitespace runs -> one space, then strip."""
    return F.trim(_rx(_c(c), SPACE_RUN_PATTERN, " "))


def is_blank(c) -> Column:
    """NULL, empty, or white space only (Unicode white space)."""
    return F.coalesce(_c(c).cast("string"), F.lit("")).rlike(r"(?U)^\s*$")


def clean_text(c, word_boundary: bool = False) -> Column:
    """The full cleaning chain; NULL -> ""."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    s = remove_handles(s)
    s = remove_emails(s)
    s = remove_phones(s)
    s = remove_honorifics(s, word_boundary)
    s = remove_urls(s)
    s = remove_emoji(s)
    return F.trim(_rx(s, OUTSIDE_RUN, " "))


def topic_clean(c) -> Column:
    """Drop URLs, keep letters and whitespace, collapse, strip, lower-case."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    s = remove_urls(s)
    # Anything but letters, with the white space about it, becomes one space.
    return F.lower(F.trim(_rx(s, "[^A-Za-z]+", " ")))


def simple_tokens(c, min_len: int = 2, max_len: int = 15) -> Column:
    """C4: lower-cased alphabetic runs (letters, no digits), length within bounds,
    not starting with an underscore."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))),
                                F.lit(r"(?U)(?:(?!\d)\w)+"), 0)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & ~t.startswith("_"))


def remove_stopwords(tokens, stopwords) -> Column:
    """Drop tokens in ``stopwords``, keeping order and repeats (not array_except)."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def count_words(c) -> Column:
    """C10 (extraction part): ``[a-z']+`` runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z']+"), 0)


def format_word_counts(pairs) -> Column:
    """C11: array<struct<word,count>> -> "w1:c1;w2:c2"."""
    return F.array_join(F.transform(_c(pairs), lambda p: F.concat_ws(":", p["word"], p["count"].cast("string"))), ";")


def fixed(x, digits: int) -> Column:
    """``{:.Nf}``."""
    return F.format_string(f"%.{digits}f", _c(x))
