"""Text functions as column expressions; Arrow functions where Spark has none.

Offsets are code points, spans half open.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that have to match what they name.
#: Control characters, bidirectional controls.
UNSAFE = r"[\x{00}-\x{1f}\x{7f}-\x{9f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
#: Acronyms, English names, addresses, digital object identifiers.
ACRONYM = r"(?<![A-Za-z0-9])([A-Z][A-Z0-9+.-]{1,15})(?![A-Za-z0-9])"
PERSON = r"(?<![A-Za-z])([A-Z][a-z]{1,30}(?:[-'][A-Z]?[a-z]{1,30})?(?:\s+[A-Z][a-z]{1,30}(?:[-'][A-Z]?[a-z]{1,30})?){1,3})(?![A-Za-z])"
URL = r"(?i)https?://[^\s<>\"'\]\[{}]+"
DOI = r"(?i)(?<![\w/])10\.\d{4,9}/[-._;()/:a-z0-9]+"
#: Attribution verbs, definition phrases and Japanese shapes.
ATTRIBUTION = r"\b(?:argued|claims?|demonstrated|described|developed|discovered|found|introduced|observed|predicted|proposed|showed|suggested|wrote)\b"
KATAKANA_NAME = r"([ァ-ヶー]{3,24}(?:・[ァ-ヶー]{2,24})?)(?=は|が|によ(?:り|る)|の)"
KANJI_NAME = r"([一-龠々髙高]{2,6})(?=は|が|によ(?:り|る)|の)"
QUOTED_TERM = r"「\s*([^」]{2,40}?)\s*」\s*(?=とは|と呼ば|を[^。]{0,20}と呼)"
DEFINED = r"^[」』”’\"'）):：、,―—-]{0,16}(?:とは|を指す|を意味する|という(?:用語|概念|考え方)|と呼(?:ぶ|ばれる)|と定義(?:する|される)|means|refersto|isdefinedas|denotes)|^.{0,80}(?:と呼(?:ぶ|ばれる)|と定義(?:する|される)|isdefinedas)"
JAPANESE = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


def normalized(text: str) -> str:
    """NFKC, case folding, one blank for a run of white space, none at the ends."""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return " ".join(folded.split())


@F.pandas_udf(T.StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """``normalized`` as a column expression."""
    return values.map(normalized, na_action="ignore")


def flattened(text: str) -> str:
    """As ``normalized`` with letters' case kept."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(T.StringType())
def flat_text(values: pd.Series) -> pd.Series:
    """``flattened`` as a column expression."""
    return values.map(flattened, na_action="ignore")


def normalize_ascii(c: Column) -> Column:
    """``normalize_text`` where the text is ASCII, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """Texts with character references decoded, a no-break space as a blank; one without its semicolon is text."""
    return values.map(lambda x: _REFERENCE.sub(lambda m: " " if m[0] == "&nbsp;" else html.unescape(m[0]), x), na_action="ignore")


def escape(c: Column) -> Column:
    """HTML-escaped text, quotes too."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


#: Glyphs that are set apart in vertical print (fixed values): word characters, kana, ideographs and marks within words.
GLYPH = r"[\w\u3040-\u30ff\u3400-\u9fff々〆ー・／/+-]"
_BETWEEN_GLYPHS = re.compile(rf"(?<=(?<!\S){GLYPH})\s+(?={GLYPH}(?!\S))")
_COMPACT = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])


def compacted(text: str) -> tuple[str, np.ndarray]:
    """A text without the blanks between single glyphs, one blank for other white space, and where each character stood.

    A mask says which characters stay: all but white space, and of each inner run
    of it that isn't between single glyphs the last one, which reads as a blank.
    """
    stays = np.ones(len(text), dtype=bool)
    joints = {m.start() for m in _BETWEEN_GLYPHS.finditer(text)}
    for gap in re.finditer(r"\s+", text):
        first, end = gap.span()
        stays[first:end] = False
        stays[end - 1] = 0 < first and end < len(text) and first not in joints
    places = np.flatnonzero(stays)
    return "".join([" " if text[k].isspace() else text[k] for k in places.tolist()]), places


@F.pandas_udf(_COMPACT)
def compact_view(values: pd.Series) -> pd.DataFrame:
    """Runs of single glyphs glued together, and where each character came from."""
    views = [(None, None) if x is None else compacted(x) for x in values]
    return pd.DataFrame(views, columns=["text", "offsets"])


def unsafe(c: Column) -> Column:
    return c.rlike(UNSAFE)


def safe_line(c: Column, most: int = 500) -> Column:
    """A line with something on it, not too long, without control characters."""
    return F.coalesce((F.length(F.trim(c)) > 0) & (F.length(c) <= most) & ~unsafe(c), F.lit(False))


#: What may follow a heading's words, in this order: an anchor, tags, closing marks (fixed values of the markup).
_TRAILING = r"(?:\{#[-\w]+\}\s*)?(?:\s+:[\w@#%:.-]+:\s*)?(?:\s+#+\s*)?$"


def clean_heading(c: Column, marks: bool = True) -> Column:
    """A heading without closing marks, tags or anchor (``marks``: a web page's title has none), entities decoded."""
    return F.trim(unescape(F.regexp_replace(F.regexp_replace(c, _TRAILING, "") if marks else c, r"\s+", " ")))


def quoted(needle: Column) -> Column:
    """A pattern that matches just the needle: an end of quotation within it is quoted apart."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def pattern_positions(text: Column, pattern: Column, length: Column) -> Column:
    """Starts of all non-overlapping matches of a pattern whose matches have one length: the running lengths between the pieces that splitting leaves."""
    pieces = F.split(text, pattern)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x))
    folded = F.aggregate(
        sizes,
        F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at")),
        lambda a, n: F.struct(F.array_append(a["found"], a["at"] + n).alias("found"), (a["at"] + n + length).alias("at")),
        lambda a: a["found"],
    )
    return F.when(length > 0, folded).otherwise(F.array().cast("array<int>"))


def positions(text: Column, needle: Column) -> Column:
    """Starts of all non-overlapping occurrences of a needle."""
    return pattern_positions(text, quoted(needle), F.length(needle))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_identity(url: Column) -> dict[str, Column]:
    """Parts by which two addresses are the same; null where the address isn't HTTPS with a host."""
    part = lambda k: F.nullif(F.regexp_extract(url, r"^(https)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k), F.lit(""))
    valid = part(1).isNotNull()
    return {
        "host": F.lower(part(2)),
        "port": F.when(valid, F.coalesce(part(3), F.lit("443"))),
        "path": F.when(valid, F.coalesce(part(4), F.lit("/"))),
        "query": F.when(valid, F.coalesce(part(5), F.lit(""))),
        "fragment": F.when(valid, F.coalesce(part(6), F.lit(""))),
    }


def page_locator(c: Column) -> Column:
    """First and last page of "12" or "12-15"; null if it's neither."""
    first = F.regexp_extract(c, r"^\s*(\d{1,5})\s*(?:[-–—]\s*(\d{1,5})\s*)?$", 1)
    last = F.regexp_extract(c, r"^\s*(\d{1,5})\s*(?:[-–—]\s*(\d{1,5})\s*)?$", 2)
    return F.when(first != "", F.struct(first.cast("int").alias("first"), F.coalesce(F.nullif(last, F.lit("")), first).cast("int").alias("last")))


def list_cell(c: Column) -> Column:
    """The entries of a cell with "|" between them, blanks left out."""
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def pipe_fields(c: Column) -> Column:
    """A map of "k=v | k=v"; a repeated key makes it null."""
    entries = F.transform(F.split(c, r" \| "), lambda x: F.split(x, "=", 2))
    keys = F.transform(entries, lambda e: e[0])
    fine = F.forall(entries, lambda e: (F.size(e) == 2) & (e[0] != "")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(fine, F.map_from_entries(F.transform(F.filter(entries, lambda e: F.size(e) == 2), lambda e: F.struct(e[0], e[1]))))


def snippet(text: Column, start: Column, end: Column, around: int = 48, low: Column | None = None, high: Column | None = None) -> Column:
    """The span with characters around it, within low and high."""
    first = F.greatest(start - around, low if low is not None else F.lit(0))
    last = F.least(end + around, high if high is not None else F.length(text))
    return F.substring(text, first + 1, last - first)


def shortened(text: Column, sizes: tuple[int, ...] = (500, 320, 160), least: int = 8) -> Column:
    """The longest of some prefixes that has at least ``least`` characters, blanks at its ends removed."""
    return F.coalesce(*[F.when(F.length(F.trim(F.substring(text, 1, n))) >= least, F.trim(F.substring(text, 1, n))) for n in sizes])


def definition_like(text: Column, end: Column) -> Column:
    """Whether the 160 characters after a span say what it means."""
    return F.regexp_replace(F.substring(text, end + 1, 160), r"\s+", "").rlike(DEFINED)


def grounded(text: Column, term: Column) -> Column:
    """Whether a normalised text holds a normalised term: as a word if the term is plain ASCII, anywhere if not."""
    plain = term.rlike(r"^[a-z0-9][a-z0-9 ._'’-]*$")
    as_word = F.concat(F.lit("(?<![a-z0-9])"), quoted(term), F.lit("(?![a-z0-9])"))
    return (F.length(term) > 0) & F.when(plain, F.regexp_like(text, as_word)).otherwise(F.contains(text, term))


def exact_block(label: str, text: Column) -> Column:
    """A text between lines that give its bytes and hash."""
    return F.concat(F.lit(f"BEGIN_{label} | bytes="), F.octet_length(text).cast("string"), F.lit(" | sha256="), F.sha2(text, 256), F.lit("\n"), text, F.lit(f"END_{label}\n"))


def read_block(label: str, block: Column) -> Column:
    """The text of an exact block; null where bytes, hash or end line don't hold."""
    head = F.regexp_extract(block, rf"^BEGIN_{label} \| bytes=(\d+) \| sha256=[0-9a-f]{{64}}\n", 0)
    size = F.regexp_extract(block, rf"^BEGIN_{label} \| bytes=(\d+) ", 1).try_cast("int")
    digest = F.regexp_extract(block, rf"^BEGIN_{label} \| bytes=\d+ \| sha256=([0-9a-f]{{64}})\n", 1)
    raw = block.cast("binary")
    body = F.substring(raw, F.octet_length(head) + 1, size)
    rest = F.substring(raw, F.octet_length(head) + size + 1, F.lit(2**31 - 1))
    return F.when((F.sha2(body, 256) == digest) & (rest == F.lit(f"END_{label}\n").cast("binary")), body.cast("string"))
