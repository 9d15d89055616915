"""String Column functions (JVM-side built-ins only)."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight import constants as C


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row and evaluate ``body`` on it.

    A large expression that references its input many times would otherwise
    be re-inlined wherever the optimizer pushes a filter on its result."""
    return F.element_at(F.transform(F.array(value), body), 1)


WHITESPACE = " \t\n\r\x0b\x0c"  # the regex class \s


def strip_ws(col: Column | str) -> Column:
    """Trim whitespace (space, tab, CR, LF, VT, FF) at both ends — a character
    set trim, no regex."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def nonblank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``, the trimmed text of ``col``, and drop the rows without any.

    By a generator: a filter would be pushed below the projection that makes
    ``col``, which is then evaluated twice a row."""
    text = strip_ws(col)
    return df.select("*", F.explode(F.when(text != "", F.array(text))).alias(out))


def first_match(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Group ``group`` of the first match, or null when the pattern is absent.

    Only for patterns whose group cannot match the empty string. The list of
    matches tells absence by itself, so the pattern runs once even where the
    optimizer cannot share a common expression (the bodies of ``let``)."""
    return F.get(F.regexp_extract_all(_c(col), F.lit(pattern), group), 0)


GROUP_SEP = "\x00"  # NUL: cannot occur in admitted text (binary check)


def regexp_groups(col: Column | str, pattern: str, n_groups: int) -> Column:
    """All ``n_groups`` capture groups of a start-anchored ``pattern`` from one
    regex run, as ARRAY<STRING> (a group that did not take part is '').

    The caller guards the call with a prior match test; on no match the array
    holds the input text."""
    repl = GROUP_SEP.join(f"${i}" for i in range(1, n_groups + 1))
    whole = F.regexp_replace(_c(col), "(?s)" + pattern + ".*", repl)
    return F.split(whole, GROUP_SEP, -1)


def first_ipv4(col: Column | str) -> Column:
    """First dotted quad (octets not range-checked), null when none."""
    return F.regexp_substr(_c(col), F.lit(C.IPV4_RE))


def to_number(col: Column | str) -> Column:
    """Drop commas/whitespace and trailing unit letters, then parse; else null."""
    cleaned = F.regexp_replace(F.regexp_replace(_c(col).cast("string"), r"[,\s]", ""), r"[A-Za-z]+$", "")
    return cleaned.try_cast("double")


def url_decode_lenient(col: Column | str, max_chars: int | None = None) -> Column:
    """Percent-decode where a '%' is present; of the first ``max_chars`` characters, if given.

    '+' stays '+', and a '%' not followed by two hex digits is kept literally:
    both are escaped before handing the text to the strict JVM decoder."""
    head = _c(col) if max_chars is None else F.substring(_c(col), 1, max_chars)
    guarded = F.regexp_replace(F.replace(head, F.lit("+"), F.lit("%2B")),
                               r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(guarded)
    return F.when(F.instr(head, "%") > 0, F.coalesce(decoded, head)).otherwise(head)


def clean_text(col: Column | str, max_chars: int | None = None) -> Column:
    """Lower-case, collapse whitespace runs to one space; keep ``max_chars``, if given."""
    text = F.regexp_replace(F.lower(_c(col)), r"\s+", " ")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def has_any_token(col: Column | str, tokens: Iterable[str]) -> Column:
    """Literal substring test OR-ed over ``tokens`` (no regex)."""
    c = _c(col)
    out = F.lit(False)
    for tok in tokens:
        out = out | c.contains(tok)
    return out


def count_tokens(col: Column | str, tokens: Iterable[str]) -> Column:
    """How many of ``tokens`` occur (literal) in ``col``; null text counts 0."""
    c = F.coalesce(_c(col), F.lit(""))
    total = F.lit(0)
    for tok in tokens:
        total = total + c.contains(tok).cast("int")
    return total


def spreadsheet_safe(col: Column | str) -> Column:
    """Neutralise formula injection (leading = + - @ gets a quote), escape & < >."""
    c = _c(col).cast("string")
    quoted = F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.replace(F.replace(F.replace(quoted, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def remove_first_occurrence(col: Column | str, needle: Column) -> Column:
    """Remove the first literal occurrence of ``needle`` (like ``str.replace(x, '', 1)``)."""
    c = _c(col)
    pos = F.call_function("instr", c, needle)
    before = F.call_function("substr", c, F.lit(1), pos - 1)
    after = F.call_function("substr", c, pos + F.length(needle))
    return F.when(pos > 0, F.concat(before, after)).otherwise(c)
