"""Cleaning of XML text and of error messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import let

# fixed values: XML's named characters, forms of user paths, and of credentials, each with what stands for it
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
PATHS = (
    (r"""(?i)[A-Z]:\\Users\\[^\\\s"'<>|?*]+(?:\\[^\s"'<>|?*]+)*""", "~"),
    (r"""(?i)\b[A-Z]:/Users/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""/Users/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""/home/[^/\s"'<>|?*]+(?:/[^\s"'<>|?*]+)*""", "~"),
    (r"""\\\\[^\\\s"'<>|?*]+\\[^\\\s"'<>|?*]+(?:\\[^\s"'<>|?*]+)*""", "<share>"),
    (r"""/(?:etc|var|usr|opt|tmp|private|boot|sys|proc|dev|run|srv|mnt|media)(?:/[^\s"'<>|?*]*)?""", "<system>"),
    (r"""(?i)[A-Z]:\\[^\s"'<>|?*]+""", "<path>"),
    (r"""(?i)\b[A-Z]:/(?!/)[^\s"'<>|?*]+""", "<path>"),
)
CREDENTIALS = (
    (r"(?i)Bearer\s+[A-Za-z0-9._~\-+/=]+", "Bearer [REDACTED]"),
    (r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b", "sk-ant-[REDACTED]"),
    (r"\bsk-(?:proj-|test-|live-)?[A-Za-z0-9_\-]{20,}\b", "sk-[REDACTED]"),
    (r"\bAIza[A-Za-z0-9_\-]{30,}\b", "AIza[REDACTED]"),
)
ENTITY = "&(#x[0-9a-fA-F]+|#[0-9]+|lt|gt|quot|apos|amp);"
#: An edge of a word of ASCII letters, digits and underscores; what Java takes for \b depends on its version.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}]"


def _character(reference: Column) -> Column:
    """What an entity stands for; itself where its number is no character."""
    digits = F.when(F.startswith(reference, F.lit("#x")), F.conv(F.substring(reference, 3, 16), 16, 10)).otherwise(F.substring(reference, 2, 18))
    code = digits.try_cast("long")
    valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    whole = F.concat(F.lit("&"), reference, F.lit(";"))
    return F.when(F.startswith(reference, F.lit("#")), F.coalesce(letter, whole)).otherwise(F.try_element_at(named, reference))


def decoded_entities(c: Column) -> Column:
    """XML's entities as the characters they stand for, each looked at once."""
    parts = F.arrays_zip(F.split(c, ENTITY, -1).alias("gap"), F.regexp_extract_all(c, F.lit(ENTITY), F.lit(1)).alias("reference"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(_character(x["reference"]), F.lit("")))), "")


def without_comments(c: Column) -> Column:
    """XML without comments and CDATA; what is not closed goes to the end."""
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)", "")


def without_private_use(c: Column) -> Column:
    return F.regexp_replace(c, PRIVATE_USE, "")


def xml_text(c: Column) -> Column:
    """The text of an XML fragment without tags: comments out, entities decoded, private characters out."""
    return let(F.regexp_replace(without_comments(c), "<[^>]*>", ""), lambda t: without_private_use(decoded_entities(t)))


def _replaced(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, shown in rules:
        c = F.regexp_replace(c, pattern.replace(r"\b", EDGE), shown)
    return c


def error_path(c: Column) -> Column:
    """An error message without the user's paths."""
    return _replaced(c, PATHS)


def error_body(c: Column) -> Column:
    """A service's error text without credentials."""
    return _replaced(c, CREDENTIALS)
