"""Export of summaries: Markdown and self-contained HTML, as expressions and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators.layout import normalize_math

MAX_BYTES = 10 * 1024 * 1024
DEFAULT_LANGUAGE = "ko"
# fixed value: what a page may load
POLICY = "default-src 'none'; style-src 'unsafe-inline'; font-src 'self';"
STYLE = "body{margin:0;color:#111827;font:11pt/1.6 sans-serif}.doc{max-width:178mm;margin:auto}pre,code{background:#f3f4f6}"


def escaped(c: Column) -> Column:
    """Text as HTML."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _inline(c: Column) -> Column:
    """Code, strong and emphasised text of an escaped line; links are left as text."""
    for mark, tag in ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"\*([^*\s][^*]*)\*", "em"), (r"~~([^~]+)~~", "del")):
        c = F.regexp_replace(c, mark, f"<{tag}>$1</{tag}>")
    return c


def _block(block: Column) -> Column:
    """A heading, list, quotation, rule or paragraph; the block is escaped text between empty lines."""
    lines = lambda b: F.split(b, "\n")
    items = lambda b, mark: F.array_join(F.transform(lines(b), lambda x: F.concat(F.lit("<li>"), _inline(F.regexp_replace(x, mark, "")), F.lit("</li>"))), "")
    level = F.char_length(F.regexp_extract(block, r"^(#{1,6})\s", 1)).cast("string")
    title = _inline(F.regexp_replace(block, r"^#{1,6}\s+|\s+#*$", ""))
    dashes, numbers = r"^\s*[-*+]\s+", r"^\s*\d+[.)]\s+"
    each = lambda b, mark: F.forall(lines(b), lambda x: x.rlike(mark))
    return (
        F.when(block.rlike(r"^#{1,6}\s[^\n]*$"), F.concat(F.lit("<h"), level, F.lit(">"), title, F.lit("</h"), level, F.lit(">")))
        .when(block.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), F.lit("<hr>"))
        .when(each(block, dashes), F.concat(F.lit("<ul>"), items(block, dashes), F.lit("</ul>")))
        .when(each(block, numbers), F.concat(F.lit("<ol>"), items(block, numbers), F.lit("</ol>")))
        .when(each(block, "^&gt;"), F.concat(F.lit("<blockquote>"), _inline(F.regexp_replace(block, "(?m)^&gt; ?", "")), F.lit("</blockquote>")))
        .otherwise(F.concat(F.lit("<p>"), _inline(block), F.lit("</p>")))
    )


def html_body(markdown: Column) -> Column:
    """Blocks of Markdown as HTML: headings (also without empty lines around), lists, quotations, rules, paragraphs."""
    apart = F.regexp_replace(escaped(F.coalesce(markdown, F.lit(""))), r"(?m)^(#{1,6}\s[^\n]*)$", "\n$1\n")
    blocks = F.filter(F.transform(F.split(apart, r"\n[ \t]*\n+"), T.trim), lambda b: b != "")
    return F.array_join(F.transform(blocks, _block), "\n")


def html_page(markdown: Column, title: Column, language: Column | None = None) -> Column:
    """A whole HTML page that loads nothing; a language other than two letters is the default one."""
    lang = F.lit(DEFAULT_LANGUAGE) if language is None else F.when(language.rlike("^[a-z]{2}$"), language).otherwise(DEFAULT_LANGUAGE)
    return F.concat(
        F.lit('<!DOCTYPE html><html lang="'),
        F.coalesce(lang, F.lit(DEFAULT_LANGUAGE)),
        F.lit(f'"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>'),
        escaped(F.coalesce(title, F.lit(""))),
        F.lit(f'</title><style>{STYLE}</style></head><body><main class="doc">'),
        html_body(markdown),
        F.lit("</main></body></html>"),
    )


def export(summaries: DataFrame, key: str, path: str, kind: str = "md") -> None:
    """Write summaries (key, title, summary, language if given) as files under path, a folder for each key.

    kind: md or html. A file over 10 MB fails the job. Spark's commit makes the files appear all or not at all; rows of
    one key share its folder.
    """
    language = F.col("language") if "language" in summaries.columns else None
    body = F.col("summary") if kind == "md" else html_page(normalize_math(F.col("summary")), F.col("title"), language)
    whole = F.coalesce(body, F.lit(""))
    fits = F.when(F.octet_length(whole) <= MAX_BYTES, whole).otherwise(F.raise_error(F.lit("a summary over 10 MB")))
    summaries.select(key, fits.alias("value")).write.partitionBy(key).text(path)
