"""Text functions: line splitting, stripping, code normalisation, fences.

All functions return Spark ``Column`` expressions built from built-in regex and
array functions, so they stay inside the JVM. The character classes are written
out explicitly because Java's ``\\s``, ``.`` and ``trim`` do not agree with
Python's ``str.splitlines`` / ``str.strip`` / ``re`` on non-ASCII text.

Every pattern here also works unchanged in RE2 (DuckDB), which the oracle SQL
relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Line boundaries of Python's str.splitlines once "\r\n" and "\r" have been
# turned into "\n" by universal-newline reading:
#   LF, VT (0x0b), FF (0x0c), FS (0x1c), GS (0x1d), RS (0x1e), NEL (U+0085),
#   LINE SEPARATOR (U+2028), PARAGRAPH SEPARATOR (U+2029)
LINE_BREAK_CLASS = r"\n\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
# Characters for which Python's str.isspace() is true (used by str.strip and
# by \s in Python's re module):
#   TAB, LF, VT, FF, CR, 0x1c-0x1f, SPACE, U+0085, U+00A0, U+1680,
#   U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
WHITESPACE_CLASS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}"
                    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# ---------------------------------------------------------------------------

LINE_RE = f"[^{LINE_BREAK_CLASS}]*[{LINE_BREAK_CLASS}]|[^{LINE_BREAK_CLASS}]+"
LINE_END_RE = f"[{LINE_BREAK_CLASS}]\\z"
STRIP_RE = f"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+\\z"
WS_RUN_RE = f"[{WHITESPACE_CLASS}]+"
BLOCK_COMMENT_RE = r"(?s)/\*.*?\*/"
LINE_COMMENT_RE = r"(?d)//.*"          # '.' stops at '\n' only, as in Python
TOKEN_RE = f"[A-Za-z0-9_]+|[^A-Za-z0-9_{WHITESPACE_CLASS}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


SPLIT_AFTER_BREAK_RE = f"(?<=[{LINE_BREAK_CLASS}])"
SPLIT_AT_BREAK_RE = f"[{LINE_BREAK_CLASS}]"


def universal_newlines(text) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n`` (text-mode reading)."""
    t = _c(text)
    return F.when(t.contains("\r"), F.regexp_replace(t, F.lit("\r\n?"), F.lit("\n"))).otherwise(t)


def split_lines_keepends(text) -> Column:
    """``splitlines(keepends=True)`` after universal-newline reading.

    A split just after every line break keeps the breaks; the only empty piece
    it can produce is the one after a final break (or of an empty text), which
    is removed.  Empty text gives an empty array, null stays null.  (Equal to
    taking every match of ``LINE_RE``, and about five times faster.)
    """
    return F.array_remove(F.split(universal_newlines(text), SPLIT_AFTER_BREAK_RE, -1), "")


def drop_line_end(line) -> Column:
    return F.regexp_replace(_c(line), F.lit(LINE_END_RE), F.lit(""))


def split_lines(text) -> Column:
    """``splitlines()`` (line ends dropped): split at every break and drop
    the last piece when the text ends with a break or is empty."""
    t = universal_newlines(text)
    parts = F.split(t, SPLIT_AT_BREAK_RE, -1)
    ends = (t == "") | t.rlike(LINE_END_RE)
    return F.when(ends, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def py_strip(text) -> Column:
    """E5: Python ``str.strip()`` with its full whitespace set."""
    return F.regexp_replace(_c(text), F.lit(STRIP_RE), F.lit(""))


def normalize_code(code) -> Column:
    """Drop block comments, then line comments, collapse whitespace runs to
    one space, strip. ``//`` inside string literals is cut too, as in the
    original definition."""
    c = F.regexp_replace(_c(code), F.lit(BLOCK_COMMENT_RE), F.lit(""))
    c = F.regexp_replace(c, F.lit(LINE_COMMENT_RE), F.lit(""))
    c = F.regexp_replace(c, F.lit(WS_RUN_RE), F.lit(" "))
    return py_strip(c)


def fenced_block_re(language: str = "java") -> str:
    return "(?s)```" + language + "\n(.*?)\n```"


def extract_code_block(text, language: str = "java") -> Column:
    """Body of the first ```<language> fenced block, stripped; null when
    there is none."""
    pat = fenced_block_re(language)
    t = _c(text)
    return F.when(t.rlike(pat), py_strip(F.regexp_extract(t, pat, 1)))


def cache_key(prompt) -> Column:
    """Hex md5 of the UTF-8 prompt."""
    return F.md5(_c(prompt))


def token_count_proxy(text) -> Column:
    """M8(b): tokenizer-free token count: word runs plus single symbols.

    The model tokenizer of the original pipeline is not available offline; this
    proxy is deterministic and identical in Spark and DuckDB.
    """
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), F.lit(0)))


def ref_key(path) -> Column:
    """Key of a ref in stored per-branch lists (hex md5 of the path)."""
    return F.md5(_c(path))


def slug_key(slug) -> Column:
    """Repository slug as a file-name part (``owner/name`` -> ``owner_name``)."""
    return F.replace(_c(slug), F.lit("/"), F.lit("_"))
