"""Column expressions for tokens, white space, lines and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored by the ranking functions.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it",
    "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "whom", "whose", "with",
)

# Everything Unicode treats as white space, plus the four ASCII separators.
SPACE_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    chr(code) for code in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"


def text_or_empty(c: Column) -> Column:
    """Missing text is the empty string throughout the data model."""
    return F.coalesce(c.cast("string"), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-empty value, else the empty string."""
    return F.coalesce(*[F.nullif(text_or_empty(c), F.lit("")) for c in cols], F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))


def search_tokens(c: Column) -> Column:
    """Content tokens, or every token when only stop words are left."""
    content = content_tokens(c)
    return F.when(F.size(content) > 0, content).otherwise(tokens(c))


def split_lines(c: Column) -> Column:
    """Lines without their terminators and without a trailing empty line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def slug(c: Column, joiner: str = "-") -> Column:
    """Lower-case ASCII slug, joined by ``joiner``."""
    return F.btrim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", joiner), F.lit(joiner))


def contains_any(hay: Column, needles) -> Column:
    """True when any needle is a substring; substring, not word, semantics."""
    test = F.lit(False)
    for needle in needles:
        test = test | hay.contains(needle)
    return test


def matches_any(hay: Column, patterns, flags: str = "(?dim)") -> Column:
    """One alternation instead of one scan of the text for each pattern."""
    return hay.rlike(flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def first_label(hay: Column, table) -> Column:
    """Label of the first entry with a matching needle, else the empty string."""
    chain = None
    for label, needles in table:
        test = contains_any(hay, needles)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Inside a lambda an outer expression is evaluated again for every element; a bound
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snippet(text: Column, query_tokens: Column, chars: int = 320) -> Column:
    """Window of ``chars`` around the first query-token hit, with ellipses."""

    def first_hit(lower: Column) -> Column:
        hits = F.filter(F.transform(query_tokens, lambda t: F.instr(lower, t) - 1), lambda p: p >= 0)
        return F.coalesce(F.array_min(hits), F.lit(0))

    def cut(compact: Column) -> Column:
        start = F.greatest(F.lit(0), bind(F.lower(compact), first_hit) - chars // 4)
        return bind(start, lambda st: window(compact, st))

    def window(compact: Column, start: Column) -> Column:
        body = strip(F.substring(compact, start + 1, F.lit(chars)))
        body = F.when(start > 0, F.concat(F.lit("..."), body)).otherwise(body)
        cut_off = F.concat(F.rtrim(body, F.lit(SPACE_CHARS)), F.lit("..."))
        return F.when(start + chars < F.length(compact), cut_off).otherwise(body)

    return bind(collapse_space(text), lambda c: F.when(F.length(c) <= chars, c).otherwise(cut(c)))


def keyword_score(query_tokens: Column, title: Column, text: Column) -> Column:
    """0.4 per token inside the title, 0.1 per whole-word hit, 0.8 for the phrase."""
    hay = F.lower(F.concat_ws("\n", title, text))
    distinct = F.array_distinct(query_tokens)
    in_title = bind(F.lower(title), lambda low: F.size(F.filter(distinct, lambda t: low.contains(t))))
    words = F.size(F.array_intersect(distinct, F.split(hay, r"[^\p{L}\p{N}_]+")))
    phrase = F.array_join(query_tokens, " ")
    return (
        in_title * F.lit(0.4)
        + words * F.lit(0.1)
        + F.when((phrase != "") & hay.contains(phrase), 0.8).otherwise(0.0)
    )


def frontmatter_block(text: Column) -> Column:
    """Text between the opening and closing frontmatter marks, else empty."""
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)


def has_frontmatter(text: Column) -> Column:
    return text.rlike(r"(?s)\A---\n.*?\n---")


def strip_frontmatter(text: Column) -> Column:
    body = F.ltrim(F.regexp_replace(text, r"(?s)\A---\n.*?\n---", ""), F.lit(SPACE_CHARS))
    return F.when(has_frontmatter(text), body).otherwise(text)


def frontmatter_scalar(text: Column, key: str) -> Column:
    return strip(F.regexp_extract(frontmatter_block(text), rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1))


def frontmatter_list(text: Column, key: str) -> Column:
    """Items of a ``key:`` block list; a scalar becomes a one-item list."""
    block = F.regexp_extract(frontmatter_block(text), rf"(?m)^{key}:[ \t]*\n((?:  - .*(?:\n|\z))*)", 1)
    items = non_empty(F.transform(F.split(block, "\n"), lambda v: strip(F.substring(v, 5, 1_000_000))))
    scalar = frontmatter_scalar(text, key)
    return F.when(F.size(items) > 0, items).when(scalar != "", F.array(scalar)).otherwise(items)


def first_heading(text: Column, fallback: Column) -> Column:
    """First ``# `` heading within 80 lines, at most 240 characters."""
    head = F.array_join(F.slice(split_lines(text), 1, 80), "\n")
    title = F.substring(collapse_space(F.regexp_extract(head, r"(?dm)^\s*#\s+(.+?)\s*$", 1)), 1, 240)
    return F.when(title != "", title).otherwise(fallback)


def meaningful_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9]"))


def estimated_tokens(c: Column, limit: int = 8000) -> Column:
    """Four characters a token over the embedded part of the text."""
    size = F.least(F.length(text_or_empty(c)), F.lit(limit))
    return F.ceil(size / F.lit(4.0)).cast("long")


def stable_digest_id(kind: Column, identity: Column) -> Column:
    """``kind_`` plus 16 hex digits of the normalised identity."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(F.concat(kind, F.lit(":"), identity)), 1, 16))
