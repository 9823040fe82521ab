"""Text operators as column expressions: titles, sections, cleaning, tokens, lemmas.

Every function takes and returns :class:`~pyspark.sql.Column`, so a whole text chain
is one projection over the scan: no shuffle, no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv


# What \s, \d and \w cover in the patterns, in the Unicode sense; Java's own Unicode mode
# differs for combining marks and for the separators 1c-1f.
_CLASSES = {
    "s": r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{N}_",
}
_WORD = f"[{_CLASSES['w']}]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def unicode_pattern(pattern: str) -> str:
    """A pattern with its character classes and word edges spelled out for Java."""

    def spell(m: re.Match) -> str:
        token = m.group(0)
        if token.startswith("["):
            return re.sub(r"\\[sdw]", lambda c: _CLASSES[c.group(0)[1]], token)
        if token == r"\b":
            return _EDGE
        if token == r"\S":
            return f"[^{_CLASSES['s']}]"
        return f"[{_CLASSES[token[1]]}]" if token[1] in _CLASSES else token

    # An edge before a word character is one look-behind, tried only where one stands.
    first = re.match(r"\\b(\[[^\]]+\]|\\d)", pattern)
    if first:
        lead = re.sub(r"\\d", lambda c: f"[{_CLASSES['d']}]", first.group(1))
        return f"(?={lead})(?<!{_WORD})" + unicode_pattern(pattern[2:])
    return re.sub(r"\[\^?(?:\\.|[^\]\\])+\]|\\.", spell, pattern)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` removes only blanks)."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Null for null, empty or whitespace-only text, else the text unchanged."""
    return F.when(F.length(strip(c)) > 0, c)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_chars(c: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def extract_title(description: Column, strict: bool = False) -> Column:
    """Title from the first non-blank line: whole, generic prefix removed.

    Stripping the whole text first makes the first line the first non-blank one, so no
    array of lines is built.  ``strict`` asks for a word boundary after the prefix.
    """
    line = strip(F.substring_index(strip(description), "\n", 1))
    prefix = fv.TITLE_PREFIX
    if strict:
        prefix = prefix.replace(")", r")\b", 1)
    title = F.regexp_replace(line, "(?iu)" + unicode_pattern(prefix), "")
    return F.coalesce(empty_to_null(title), F.lit(fv.UNTITLED))


def title_or_extracted(title: Column, description: Column, strict: bool = False) -> Column:
    """The given title when it is not blank, else the extracted one."""
    return F.coalesce(blank_to_null(title), extract_title(description, strict))


def combine_index_text(*parts: Column) -> Column:
    """Text a stored report is indexed under: stripped non-blank parts joined ``' . '``."""
    return F.concat_ws(" . ", *[empty_to_null(strip(p)) for p in parts])


def combine_query_text(*parts: Column) -> Column:
    """Text an incoming report is matched by: non-empty parts joined by a blank, as is."""
    return F.concat_ws(" ", *[empty_to_null(p) for p in parts])


def combine_enhance_text(*parts: Column) -> Column:
    """All parts joined by a blank even when empty, then stripped."""
    return strip(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# A run of non-blanks holding an address is replaced whole, so only the start of a run
# needs trying; without the look-behind a long unbroken run costs quadratic time.
_RUN_START = r"(?<!\S)"
# Plain text every match of a masking pattern must hold; most texts hold none of it.
_PROBES = [("http", "www."), ("@",), ("<",), (), ("0x",), ("/", "\\"), ()]


def mask_artifacts(text: Column) -> Column:
    """Lower-case and replace links, addresses, markup, hashes, paths and numbers."""
    out = F.lower(text)
    for (pattern, token), probes in zip(fv.CLEANING_PATTERNS, _PROBES, strict=True):
        if probes == ("@",):
            pattern = _RUN_START + pattern
        out = _masked(out, unicode_pattern(pattern), token, probes)
    return out


def _masked(text: Column, pattern: str, token: str, probes: tuple[str, ...]) -> Column:
    if not probes:
        return F.regexp_replace(text, pattern, token)

    def where_probed(t: Column) -> Column:
        hit = F.lit(False)
        for p in probes:
            hit = hit | t.contains(p)
        return F.when(hit, F.regexp_replace(t, pattern, token)).otherwise(t)

    return let(text, where_probed)


def clean(text: Column) -> Column:
    """Cleaning only: masked text with every non-letter run collapsed to one blank."""
    letters = F.regexp_replace(mask_artifacts(text), "[^a-zA-Z]+", " ")
    return F.coalesce(F.btrim(letters), F.lit(""))


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Words of more than two letters that are not stopwords, in order.

    After masking, words are maximal runs of letters, so one pass of
    ``[a-z]{3,}`` does the split and the length test together.
    """
    words = F.regexp_extract_all(mask_artifacts(text), F.lit("([a-z]{3,})"))
    stop = [w for w in (stopwords or fv.STOPWORDS) if len(w) > 2]
    return F.filter(words, lambda w: ~w.isin(stop))


def lemma(word: Column, exceptions: dict[str, str] | None = None) -> Column:
    """Noun lemma of one word by an exception table, then ordered suffix rules."""
    table = fv.LEMMA_EXCEPTIONS if exceptions is None else exceptions
    rule = F.when(F.length(word) < 4, word)
    for suffix, replacement in fv.LEMMA_SUFFIXES:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        value = word if suffix == replacement else F.concat(stem, F.lit(replacement))
        rule = rule.when(word.endswith(suffix), value)
    rule = rule.otherwise(word)
    if not table:
        return rule
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(word.isin(list(table)), pairs[word]).otherwise(rule)


def lemmatized_tokens(text: Column) -> Column:
    """Tokens, filtered first and lemmatized after."""
    return F.transform(tokens(text), lambda w: lemma(w))


def normalize(text: Column) -> Column:
    """Full normalisation: mask, tokenize, drop stopwords, lemmatize, join by a blank."""
    return F.coalesce(F.array_join(lemmatized_tokens(text), " "), F.lit(""))


def folded(text: Column) -> Column:
    """Text folded so that plain substring tests cover case-insensitive matches."""
    rare = "\u0130\u0131\u017f\u212a"
    hit = F.lit(False)
    for character in rare:  # most texts hold none of them, and translating is slow
        hit = hit | text.contains(character)
    return F.lower(F.when(hit, F.translate(text, rare, "iisk")).otherwise(text))


def _probe_words(pattern: str) -> list[str]:
    """The literal word each alternative of a header pattern starts with."""
    return re.findall(r"(?:^|\|)([a-z]+)", re.sub(r"\(\?:.*?\)", "", pattern))


def extract_section(
    description: Column,
    section: str,
    strict: bool = False,
    probe: Column | None = None,
    max_chars: int | None = None,
) -> Column:
    """Body of one section: text after the first header pattern, in list order, that
    occurs, up to the next header-like line; stripped, whole unless ``max_chars`` is given.

    ``probe`` is the folded description; most texts hold no header word at all, and a
    substring test on it spares them the pattern.
    """
    bodies = []
    for p in fv.SECTION_PATTERNS[section]:
        header = rf"\b(?:{p})\b[:\-\s]*" if strict else f"(?:{p})"
        body = F.get(F.split(description, "(?iu)" + unicode_pattern(header), 2), F.lit(1))
        if probe is not None:
            hit = F.lit(False)
            for word in _probe_words(p):
                hit = hit | probe.contains(word)
            body = F.when(hit, body)
        bodies.append(body)
    body = F.get(F.split(F.coalesce(*bodies), "(?iu)" + unicode_pattern(fv.NEXT_HEADER), 2), F.lit(0))
    whole = strip(body)
    return F.coalesce(whole if max_chars is None else first_chars(whole, max_chars), F.lit(""))


def extract_sections(
    description: Column, strict: bool = False, probe: Column | None = None
) -> dict[str, Column]:
    """One column per section, keyed by the section's name."""
    return {s: extract_section(description, s, strict, probe) for s in fv.SECTION_PATTERNS}


def sentences(text: Column, min_chars: int) -> Column:
    """Stripped pieces between full stops that are longer than ``min_chars``."""
    pieces = F.transform(F.split(text, r"\."), lambda s: strip(s))
    return F.filter(pieces, lambda s: F.length(s) > min_chars)


def fold_severity(severity: Column) -> Column:
    """Nine raw severity words to four; unknown words stay, blank is ``Unknown``."""
    raw = F.lower(severity)
    folded = None
    for word, name in fv.SEVERITY_FOLD.items():
        folded = F.when(raw == word, name) if folded is None else folded.when(raw == word, name)
    return F.coalesce(folded, empty_to_null(severity), F.lit("Unknown"))


def question_intent(question: Column) -> Column:
    """Intent of a question by ordered keyword rules."""
    q = F.lower(question)
    out = None
    for intent, alternatives in fv.INTENT_RULES:
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & q.contains(w)
            hit = hit | every
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise(fv.INTENT_FALLBACK)


def search_term(question: Column) -> Column:
    """What a search question asks for: its command words removed."""
    return strip(F.regexp_replace(question, "(?iu)" + fv.SEARCH_TERM_PATTERN, ""))
