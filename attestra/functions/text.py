"""Text columns: numeric claims, scrubbing, sentences, tokens and normal forms of titles and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of numeric claims, document bodies, figures and pending marks.
NUMBER = r"(?<![\p{L}\p{N}_.])(\d{1,3}(?:,\d{3})+|\d+\.\d+)(?![\d])"  # combining marks are no word characters
FRONT_MATTER = r"\A---\r?\n(?s:.*?)\r?\n---\r?\n"
TEX_BODY = r"(?s)\\begin\{document\}(.*)\\end\{document\}"
COMMENT = r"(?<!\\)%.*"
TEX_FIGURE = r"\\(?:incfig|includegraphics)(?:\[[^\]]*\])?\{([^}]+)\}"
MARKDOWN_FIGURE = r"!\[[^\]]*\]\(([^)\s]+)"
PENDING = r"\\pend(?:\[([^\]]*)\])?"
# LaTeX commands whose arguments hold no claims, in this order.
SILENT_COMMANDS = ("input", "includegraphics", "incfig", "cite", "ref", "eqref", "cref", "Cref", "autoref", "label", "url", "usepackage", "include", "bibliography", "resizebox", "setlength")
# What is blanked out of LaTeX and of Markdown beside these, with what stands for it.
TEX_STEPS = (
    (r"\\pend(\[[^\]]*\])?", " "),
    (r"\\href\{[^}]*\}", " "),
    (r"[\d.]+\\(?:text|line|column|page)(?:width|height)", " "),
    (r"[\d.]+\s*(?:pt|cm|mm|em|ex|in|bp|sp)\b", " "),
    (r"\{,\}", ","),
)
MARKDOWN_STEPS = (
    (r"(?s)```.*?```", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"`[^`\n]*`", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\]\([^)]+\)", "]"),
    (r"\[@[^\]]+\]", " "),
)
#: Classes such as ``\w`` take in all scripts, and only a line feed ends a line.
UNICODE = "(?Ud)"


def _chain(c: Column, steps) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, UNICODE + s[0], s[1]), steps, c)


def unix_lines(c: Column) -> Column:
    """All line ends as line feeds, as a text file is read."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def numbers(text: Column) -> Column:
    """All numeric claims of a text, in order, as written."""
    return F.regexp_extract_all(text, F.lit(UNICODE + NUMBER), F.lit(1))


def as_number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).cast("double")


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:md|markdown)$")


def body(text: Column, markdown: Column) -> Column:
    """Without YAML front matter, or between the ends of a LaTeX document, else all of it; line ends as line feeds."""
    lines = unix_lines(text)
    plain = F.regexp_replace(lines, FRONT_MATTER, "")
    return F.when(markdown, plain).when(lines.rlike(TEX_BODY), F.regexp_extract(lines, TEX_BODY, 1)).otherwise(lines)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + COMMENT, "")


def scrubbed(text: Column, markdown: Column) -> Column:
    """Text in which only claims keep their numbers.

    The commands go one after the other, as the argument of one may hold another.
    """
    commands = tuple((r"\\" + c + r"(\[[^\]]*\])?\{[^}]*\}", " ") for c in SILENT_COMMANDS)
    return F.when(markdown, _chain(text, MARKDOWN_STEPS)).otherwise(_chain(without_comments(text), (*commands, *TEX_STEPS)))


def figures(text: Column) -> Column:
    """Figure targets: LaTeX ones, then Markdown ones."""
    found = F.concat(F.regexp_extract_all(text, F.lit(TEX_FIGURE), F.lit(1)), F.regexp_extract_all(text, F.lit(UNICODE + MARKDOWN_FIGURE), F.lit(1)))
    return F.transform(found, stripped)


def pending(text: Column) -> Column:
    """Values of ``\\pend`` marks, ``??.??`` where they have none."""
    found = F.regexp_extract_all(text, F.lit(PENDING), F.lit(1))
    return F.transform(found, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "??.??").otherwise(x))


def norm_doi(c: Column) -> Column:
    bare = stripped(F.regexp_replace(stripped(c), r"(?i)^https?://(dx\.)?doi\.org/", ""))
    return F.nullif(F.lower(F.rtrim(bare, F.lit("."))), F.lit(""))


def spaced_title(c: Column) -> Column:
    """Lower case, everything else than a-z and 0-9 a single space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def bare_title(c: Column) -> Column:
    """Lower case, everything else than a-z, 0-9 and spaces deleted."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")


# Words without weight in a focus text.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "for", "in", "on", "to", "with", "by", "from", "at", "is", "are", "was", "were", "be", "been", "that", "this", "these", "those", "its", "as", "we", "our", "their", "using", "based", "via",
    "can", "into", "over", "under", "between", "toward", "towards", "new", "novel", "approach", "method", "paper", "study", "propose", "proposed",
)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of three or more characters that begin with a letter, stop words aside."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_except(F.coalesce(words, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in STOP_WORDS]))


# Fixed value: between two sentences of a paragraph whose white space is collapsed.
SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z\\`"'(\[])"""


def sentences(text: Column, having: Column | None = None) -> Column:
    """Sentences of all paragraphs (blank lines part them); of those that hold a text of ``having`` alone, if given."""
    paragraphs = F.transform(F.split(text, r"(?U)\n\s*\n"), collapsed)
    if having is not None:
        paragraphs = F.filter(paragraphs, lambda p: F.exists(having, lambda h: F.contains(p, h)))
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE_END))), lambda s: s != "")


def shortened(text: Column, most: int) -> Column:
    """White space collapsed; cut at the last word within ``most`` characters, with an ellipsis."""
    flat = collapsed(text)
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", ""), F.lit(" …"))).otherwise(flat)
