"""Word tokenizer, stopword removal and n-grams as pure Column expressions.

The tokenizer keeps only alphanumeric word tokens of a Treebank-style word
split of the lower-cased text.  Because every token that contains punctuation
is dropped afterwards, the Treebank rules reduce to a short chain of regular
expression rewrites without look-around, which the JVM regex engine and RE2
(DuckDB) both run.  Everything stays inside whole-stage code generation: no
Python UDF touches a row.

``duck_*`` functions emit the same chain as DuckDB SQL text; the correctness
oracle of every text query is generated from them, so both sides always use one
specification.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import resolve_stopwords

# Character class of white space as ``str.split()``/``str.strip()`` see it:
# ASCII controls 9-13 and 28-31, NEL, and every Unicode separator (Z*).
WS_CLASS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F}\x{85}\p{Z}]"

# Ordered rewrites applied to ' ' + lower(text) + ' ' before splitting.
# (pattern, replacement using group 1 or nothing)
_REWRITES: tuple[tuple[str, str | None], ...] = (
    # quotes, brackets and symbols that always stand alone
    ("[«»“”‘’„\"`\\[\\](){}<>;@#$%&?!*]", None),
    (r"\.{2,}", None),                     # ellipsis
    ("--", None),                          # double dash
    ("''", None),                          # doubled apostrophe
    (r"[:,]([^0-9])", "g1"),               # comma / colon not followed by a digit
    (r"\.('*" + WS_CLASS + ")", "g1"),     # full stop before white space
)

# Clitic suffixes split off by the Treebank rules; the split-off part is never
# alphanumeric, so removing it from the token end is equivalent.  Every token
# end is followed by white space in the padded text, so the strip runs once on
# the whole string instead of once per token.
CLITIC_SUFFIX = r"(n't|'ll|'re|'ve|'s|'m|'d|')$"
CLITIC_AT_TOKEN_END = r"(n't|'ll|'re|'ve|'s|'m|'d|')(" + WS_CLASS + ")"
# Treebank contractions split into two words.
CONTRACTIONS: tuple[tuple[str, str, str], ...] = (
    ("cannot", "can", "not"),
    ("gonna", "gon", "na"),
    ("gotta", "got", "ta"),
    ("gimme", "gim", "me"),
    ("lemme", "lem", "me"),
    ("wanna", "wan", "na"),
)

# A token holding any character that is neither a letter nor a digit is dropped
# whole (``isalnum`` fails). Tested token by token: linear in the text's length.
ALNUM = r"^[\p{L}\p{N}]+$"


# ----------------------------------------------------------------- Spark side
def tokens(text: Column | str, stopwords=None) -> Column:
    """ARRAY<STRING> of lower-case alphanumeric word tokens of ``text``.

    ``stopwords``: ``True`` for the English list, a sequence of words, or
    ``None``/``False`` for no removal.  Removal happens after lower-casing and
    tokenizing, as in the reference.
    """
    col = F.col(text) if isinstance(text, str) else text
    s = F.concat(F.lit(" "), F.lower(F.coalesce(col, F.lit(""))), F.lit(" "))
    for pattern, repl in _REWRITES:
        s = F.regexp_replace(s, pattern, " $1" if repl == "g1" else " ")
    s = F.regexp_replace(s, CLITIC_AT_TOKEN_END, "$2")
    arr = F.filter(F.split(s, WS_CLASS + "+"), lambda t: t.rlike(ALNUM))
    arr = F.flatten(F.transform(arr, _split_contraction))
    words = resolve_stopwords(stopwords)
    if words:
        stop = list(words)
        arr = F.filter(arr, lambda t: ~t.isin(stop))
    return arr


def _split_contraction(t: Column) -> Column:
    expr = None
    for word, a, b in CONTRACTIONS:
        branch = (t == F.lit(word), F.array(F.lit(a), F.lit(b)))
        expr = F.when(*branch) if expr is None else expr.when(*branch)
    return expr.otherwise(F.array(t))


def ngrams(tokens_col: Column | str, n: int) -> Column:
    """ARRAY<STRING> of contiguous ``n``-grams joined by one space (empty if too short).

    Pass a *column reference* (materialise tokens first): the lambda reads the
    array once per gram.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    col = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    if n == 1:
        return col
    count = F.size(col) - F.lit(n - 1)
    return F.when(
        F.size(col) >= n,
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.array_join(F.slice(col, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def strip_ws(col: Column | str) -> Column:
    """Remove leading and trailing Unicode white space (``str.strip()``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


# ---------------------------------------------------------------- DuckDB side
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck_tokens(text_sql: str, stopwords=None) -> str:
    """DuckDB SQL expression equal to :func:`tokens` for the SQL expression ``text_sql``."""
    s = f"(' ' || lower(coalesce({text_sql}, '')) || ' ')"
    for pattern, repl in _REWRITES:
        r = " \\1" if repl == "g1" else " "
        s = f"regexp_replace({s}, {_sql_str(pattern)}, {_sql_str(r)}, 'g')"
    s = f"regexp_replace({s}, {_sql_str(CLITIC_AT_TOKEN_END)}, '\\2', 'g')"
    s = f"list_filter(string_split_regex({s}, {_sql_str(WS_CLASS + '+')}), lambda t: regexp_full_match(t, {_sql_str(ALNUM)}))"
    case = " ".join(
        f"WHEN t = {_sql_str(w)} THEN [{_sql_str(a)}, {_sql_str(b)}]" for w, a, b in CONTRACTIONS
    )
    s = f"flatten(list_transform({s}, lambda t: CASE {case} ELSE [t] END))"
    words = resolve_stopwords(stopwords)
    if words:
        lst = "[" + ", ".join(_sql_str(w) for w in words) + "]"
        s = f"list_filter({s}, lambda t: NOT list_contains({lst}, t))"
    return s


def duck_ngrams(tokens_sql: str, n: int) -> str:
    """DuckDB SQL expression equal to :func:`ngrams`."""
    if n == 1:
        return tokens_sql
    return (
        f"CASE WHEN len({tokens_sql}) >= {n} THEN list_transform(range(1, len({tokens_sql}) - {n - 2}), "
        f"lambda i: array_to_string({tokens_sql}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END"
    )


def duck_strip_ws(sql: str) -> str:
    return f"regexp_replace({sql}, {_sql_str('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def stopword_list(stopwords) -> Sequence[str]:
    return resolve_stopwords(stopwords)
