"""Line-first quality rules.

Each line of a text is judged on its own; lines that fail are removed, and a
document is rejected if it loses too large a share of its characters that way.
Everything is built-in expressions over the split text: one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

#: Share of a text's visible characters that may be lost.
MAX_LOSS = 0.5
#: A line of at least so many symbols fails if they make up more than SYMBOL_SHARE of it.
SYMBOLS, SYMBOL_SHARE = 8, 0.15
#: Separators of a navigation line: at least so many.
SEPARATORS = 2

#: Patterns that Java, RE2 and DuckDB read alike.
#: A sentence ends at the line's end, or a stray word or two (a tag, a number) before it.
TERMINAL = r"""[.!?…。！？؟।:;]["'”’»)\]]*(\s+\S+){0,3}\s*$"""
SYMBOL = r"[^\p{L}\p{M}\p{N}\s]"
SEPARATOR = r"(^|\s)[|»›·•>](\s|$)"
MENU = r"(?i)^\s*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|share|tweet|read more|view all|sitemap|contact us|about us)\s*[.!?:;>»›]*\s*$"
BOILERPLATE = (
    r"(?i)(enable javascript|javascript (is|must be) (disabled|enabled)|cookie (policy|settings|consent)|(uses?|accept( all)?) cookies|terms (of use|of service|and conditions)|privacy policy"
    r"|click here|subscribe to (our|the)|newsletter|lorem ipsum|all rights reserved|follow us on|powered by|page not found)"
)


#: One of these is in the lower-case text of any line that BOILERPLATE matches, one of those in any line with a separator: texts without them skip the expression.
_BOILERPLATE_HINTS = ("javascript", "cookie", "terms", "privacy", "click", "subscribe", "newsletter", "lorem", "reserved", "follow us", "powered", "not found")
_SEPARATOR_HINTS = tuple("|»›·•>")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def line_ok(line: Column, boilerplate: Column, separators: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules (a blank line passes).

    The flags say whether the text can hold a boilerplate phrase or a separator at all.
    """
    end = F.rtrim(line)
    terminal = end.endswith(".") | end.endswith("!") | end.endswith("?") | line.rlike(TERMINAL)
    symbols = F.length(F.regexp_replace(line, SYMBOL.replace("[^", "[") + "+", ""))
    noisy = symbols > F.greatest(F.lit(SYMBOLS - 0.5), F.length(line) * SYMBOL_SHARE)
    parted = separators & (F.size(F.split(F.regexp_replace(line, SEPARATOR, "\u0001\u0001"), "\u0001\u0001")) - 1 >= SEPARATORS)
    return (F.trim(line) == "") | (terminal & ~noisy & ~parted & ~line.rlike(MENU) & ~(boilerplate & line.rlike(BOILERPLATE)))


def _visible(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, r"\S+", ""))


def clean_lines(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS, share: str | None = "kept_share") -> DataFrame:
    """``docs`` without rejected documents, their text cut to the lines that pass, plus the column ``share``, if any.

    A text is split at line feeds.  Characters count without white space; the share
    kept is that of the characters in passing lines.  Rejected are null texts, texts
    without a visible character (empty ones too), and those that keep less than
    ``1 - max_loss``.  Texts of any length are judged whole.  Repeated rows are judged
    alike.  ``n_chars``, where there is one, follows the new text.  Other columns,
    whatever their names, stay; one called as ``share`` is replaced.
    """
    text = col(text_col).cast("string")
    # Each step binds the one before as a lambda's variable, so that nothing is evaluated twice; the generator drops rejected texts.
    flags = F.array(F.struct(text.alias("t"), _any(F.lower(text), _BOILERPLATE_HINTS).alias("b"), _any(text, _SEPARATOR_HINTS).alias("s")))
    cut = F.transform(flags, lambda d: F.struct(d["t"].alias("t"), F.array_join(F.filter(F.split(d["t"], "\n", -1), lambda x: line_ok(x, d["b"], d["s"])), "\n").alias("c")))
    counted = F.transform(cut, lambda d: F.struct(d["c"].alias("c"), _visible(d["t"]).alias("had"), F.when(d["c"] != d["t"], _visible(d["c"])).alias("kept")))
    judged = F.transform(counted, lambda d: F.struct(d["c"].alias("c"), d["had"].alias("had"), F.coalesce(d["kept"], d["had"]).alias("kept")))
    passed = F.filter(judged, lambda d: (d["kept"] > 0) & (d["kept"] >= F.lit(1 - max_loss) * d["had"]))
    names = [c for c in docs.columns if share is None or c.lower() != share.lower()]
    p = fresh(docs, "passed")
    out = docs.where(col(text_col).isNotNull()).select(*[col(c) for c in names if c != text_col], F.explode(passed).alias(p))
    got = lambda f: F.col(f"{p}.{f}")
    given = {text_col: got("c")} | {c: F.length(got("c")).cast(docs.schema[c].dataType) for c in names if c.lower() == "n_chars" and c != text_col}
    return out.select(*[given.get(c, col(c)).alias(c) for c in names], *([] if share is None else [F.round(got("kept") / got("had"), 6).alias(share)]))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass, with their cleaned text."""
    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "kept_share")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OK = f"""(trim(l) = '' OR (regexp_matches(l, {_lit(TERMINAL)})
        AND NOT (length(l) - length(regexp_replace(l, {_lit(SYMBOL)}, '', 'g')) >= {SYMBOLS}
                 AND length(l) - length(regexp_replace(l, {_lit(SYMBOL)}, '', 'g')) > length(l) * {SYMBOL_SHARE}::DOUBLE)
        AND NOT (len(string_split(regexp_replace(l, {_lit(SEPARATOR)}, chr(1) || chr(1), 'g'), chr(1) || chr(1))) - 1 >= {SEPARATORS} OR regexp_matches(l, {_lit(MENU)}))
        AND NOT regexp_matches(l, {_lit(BOILERPLATE)})))"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE = {
    "op7_quality_rules": rf"""
    WITH c AS (
        SELECT doc_id, text AS had, array_to_string(list_filter(string_split(text, chr(10)), lambda l: {_OK}), chr(10)) AS text
        FROM documents WHERE text IS NOT NULL),
    n AS (
        SELECT *, length(regexp_replace(had, '\s+', '', 'g')) AS nh, length(regexp_replace(text, '\s+', '', 'g')) AS nk FROM c)
    SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, round(nk / nh::DOUBLE, 6) AS kept_share
    FROM n WHERE nk > 0 AND nk >= {1 - MAX_LOSS} * nh
    """
}
