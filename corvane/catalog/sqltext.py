"""SQL building blocks shared by the comparison queries."""

from corvane.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[a-z0-9]+')"


def content(expr: str) -> str:
    return f"list_filter({toks(expr)}, lambda t: t NOT IN ({STOPS}))"


TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def squash(expr: str) -> str:
    """White space runs to one blank, trimmed."""
    return rf"trim(regexp_replace({expr}, '[\s\x0b]+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"trim({expr}, {TRIM})"


# Catalogue corpus: documents labelled as good are curated wiki pages, the others
# raw sources; a page cites the sources of the three following document ids.
CORPUS = """
corpus_docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
         CASE WHEN l.quality = 1 THEN 'wiki' ELSE 'raw' END AS corpus,
         concat_ws(' ', d.source, d.lang, d.doc_id::VARCHAR) AS title
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunk_ctes(source: str = "corpus_docs", size: int = 1600, overlap: int = 200) -> str:
    step = size - overlap
    return rf"""
cleaned AS (
  SELECT *, trim(regexp_replace(text, '\n{{3,}}', chr(10)||chr(10), 'g'), {TRIM}) AS c FROM {source}),
windows AS (
  SELECT *, list_filter(list_transform(
      range(0, CASE WHEN length(c) <= {size} THEN 1
               ELSE 1 + CAST(ceil((length(c) - {size}) / {step}.0) AS BIGINT) END),
      lambda i: trim(substring(c, CAST(i * {step} + 1 AS BIGINT), {size}), {TRIM})), lambda p: p <> '') AS pieces
  FROM cleaned WHERE length(c) > 0),
chunks AS (
  SELECT * EXCLUDE (text, c, pieces), unnest(pieces) AS text,
         unnest(range(1, len(pieces) + 1)) AS chunk_index
  FROM windows)"""


INDEX = CORPUS + "," + chunk_ctes() + """,
idx AS (
  SELECT corpus || ':' || doc_id || ':' || chunk_index AS id, corpus, doc_id, source, lang, title, text, chunk_index
  FROM chunks)"""
