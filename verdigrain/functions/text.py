"""String expressions for cleaning, counting, cutting and hashing text.

White space is Unicode's White_Space; lengths and offsets are code points. All but Unicode
normalisation are built-in functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdigrain.functions.arrays import let, prefix_sums

# Broken sequences and their repair, in the order in which they apply.
MOJIBAKE = (
    ("â€œ", "“"), ("â€\u009d", "”"), ("â€˜", "‘"), ("â€™", "’"),
    ("â€“", "–"), ("â€”", "—"), ("â€¦", "…"), ("âˆ’", "−"),
    ("â€¢", "•"), ("ï‚·", "•"), ("ï€­", "-"), ("ïƒ˜", "•"),
    ("ïƒ¼", "•"), ("ï‚§", "•"), ("", "•"), ("", "-"), ("", "•"),
    ("", "•"), ("", "•"), ("Â½", "½"), ("Â±", "±"),
)

# Lines that court publications repeat on every page.
BOILERPLATE = (
    r"^\s*Direktori\s+Putusan\s+Mahkamah\s+Agung\s+Republik\s+Indonesia\s*$",
    r"^\s*putusan\.mahkamahagung\.go\.id(?:\s+[A-Za-z.]+\d*)?\s*$",
    r"^\s*Disclaimer\s*$",
    r"^\s*Hal(?:aman)?\.?\s+\d+\s+dari\s+(?:Hal(?:aman)?\.?\s*)?\d+(?:\s+Hal(?:aman)?\.?)?(?:\s+Putusan\s+Nomor\b.*)?\s*$",
    r"^\s*Hal(?:aman)?\.?\s+\d+\s*$",
    r"^\s*Pid\.[IVXLCDM]+\.[A-Z]\.\d+\s*$",
    r"^\s*Kepaniteraan\s+Mahkamah\s+Agung\s+Republik\s+Indonesia\s+berusaha\s+untuk\s+selalu\s+mencantumkan\s+informasi\b.*$",
    r"^\s*publik,?\s+transparansi\s+dan\s+akuntabilitas\b.*$",
    r"^\s*pelaksanaan\s+fungsi\s+peradilan\.\s+Namun\s+dalam\s+hal-hal\b.*$",
    r"^\s*Dalam\s+hal\s+Anda\s+menemukan\s+inakurasi\s+informasi\b.*$",
    r"^\s*Email\s*:\s*kepaniteraan@mahkamahagung\.go\.id\b.*$",
)

# Words that no person's name has, and words that no birthplace has.
NOT_NAMES = "umur tanggal lahir tahun januari februari maret april mei juni juli agustus september oktober nopember november desember jenis kelamin kebangsaan tempat tinggal".split()
NOT_PLACES = "atau jenis kebangsaan kelamin lahir tanggal tangal tempat tahun tgl tinggal umur".split()


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; Spark has no built-in for it."""
    return F.pandas_udf(_composed, StringType())(text)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def newlines(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\0", "")


def repaired(text: Column) -> Column:
    """Common cases of UTF-8 read as another encoding, put right in order."""
    for broken, right in MOJIBAKE:
        text = F.replace(text, F.lit(broken), F.lit(right))
    return text


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def without_boilerplate(text: Column) -> Column:
    """Without the lines that match a boilerplate pattern."""
    pattern = "(?iuU)" + "|".join(BOILERPLATE)
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(pattern)), "\n")


def collapsed(text: Column) -> Column:
    """Blanks within lines as one, none at lines' ends, at most one empty line in a row."""
    text = F.regexp_replace(text, r"[\t \f\x0B]+", " ")
    text = F.regexp_replace(text, r"(?mdU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def cleaned(text: Column, *, normalize_unicode: bool = True, dehyphenate: bool = True, collapse: bool = True, repair: bool = True, drop_boilerplate: bool = True) -> Column:
    """All cleaning steps in their order, each of which can be left out."""
    text = newlines(text)
    for wanted, step in ((repair, repaired), (normalize_unicode, nfkc), (dehyphenate, dehyphenated), (drop_boilerplate, without_boilerplate), (collapse, collapsed)):
        text = step(text) if wanted else text
    return stripped(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def word_spans(text: Column) -> Column:
    """start and end of each run without white space."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*+\S++"), F.lit(0))
    ends = lambda p: prefix_sums(F.transform(p, F.length))
    return let(pieces, lambda p: let(ends(p), lambda e: F.transform(p, lambda x, i: F.struct((F.element_at(e, i + 2) - F.length(F.regexp_replace(x, r"(?U)\A\s+", ""))).alias("start"), F.element_at(e, i + 2).alias("end")))))


def folded(text: Column) -> Column:
    """Lower-case for comparison; of the special foldings only that of sharp s is made."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def spaced(text: Column) -> Column:
    """Folded runs of letters and digits with one blank between them."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " ")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(spaced(text), " "), lambda t: t != "")


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """A span of a text without white space at its ends, as struct of start and end."""

    def of(part: Column) -> Column:
        head = F.length(part) - F.length(F.regexp_replace(part, r"(?U)\A\s+", ""))
        tail = F.length(part) - F.length(F.regexp_replace(part, r"(?U)\s+\z", ""))
        blank = head == F.length(part)
        return F.struct(F.when(blank, end).otherwise(start + head).alias("start"), F.when(blank, end).otherwise(end - tail).alias("end"))

    return let(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")), of)


def _right_trimmed(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[{chars}]+$", "")


def head_at_word(text: Column, most: int) -> Column:
    """The squeezed text, cut at the last blank that leaves at most so many characters."""
    if most <= 0:
        raise ValueError("most must be positive")

    def of(text: Column) -> Column:
        cut = F.regexp_extract(F.substring(text, 1, most + 1), r"(?s)^(.*) ", 1)
        long = let(cut, lambda c: F.when(c == "", _right_trimmed(F.substring(text, 1, most), r"\s")).otherwise(_right_trimmed(c, " ,;:\\-")))
        return F.when(F.length(text) <= most, text).otherwise(long)

    return let(squeezed(text), of)


def tail_at_word(text: Column, most: int) -> Column:
    """The end of the squeezed text, cut after its first blank."""
    text = squeezed(text)
    end = F.right(text, F.lit(most))
    return F.when(F.length(text) <= most, text).when(F.instr(end, " ") == 0, end).otherwise(F.regexp_replace(F.regexp_replace(end, "^[^ ]* ", ""), "^[ ,;:\\-]+", ""))


def excerpt(text: Column, most: int, *, trim_tail: bool = True) -> Column:
    """Head and tail of a long text around a mark."""
    squeezed_text = squeezed(text)
    half = most // 2
    tail = tail_at_word(text, most - half) if trim_tail else F.trim(F.regexp_replace(F.right(squeezed_text, F.lit(most - half)), "^[^ ]* ", ""))
    return F.when(F.length(squeezed_text) <= most, squeezed_text).otherwise(F.concat(head_at_word(text, half), F.lit(" [...] "), tail))


def preview(text: Column, most: int = 280) -> Column:
    text = squeezed(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def heading_at(text: Column, start: Column) -> Column:
    """From a position to the end of its line."""
    return stripped(F.substring_index(F.substring(text, (start + 1).cast("int"), F.length(text)), "\n", 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def occurrences(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def marked_excerpt(text: Column, position: Column, before: int, after: int, mark: str = ">>>") -> Column:
    """Escaped text around a position, with a mark at it."""
    start = F.greatest(F.lit(0), position - before)
    return F.concat(html_escaped(F.substring(text, (start + 1).cast("int"), (position - start).cast("int"))), F.lit(mark), html_escaped(F.substring(text, (position + 1).cast("int"), F.lit(after))))


def plausible_name(name: Column) -> Column:
    """1 to 12 words without digits, none of which names never have."""
    said = lambda words: (F.size(words) <= 12) & ~F.arrays_overlap(words, F.array(*map(F.lit, NOT_NAMES)))
    return (squeezed(name) != "") & ~name.rlike(r"(?U)\d") & let(F.split(squeezed(F.lower(name)), " "), said)


def valid_birthplace(place: Column) -> Column:
    text = squeezed(folded(place))
    words = F.split(text, " ")
    return (text != "") & (F.size(words) <= 5) & ~F.arrays_overlap(words, F.array(*map(F.lit, NOT_PLACES))) & text.rlike("^[a-z][a-z .'-]*$")


def analysis_trigger(heading: Column) -> Column:
    """Whether a heading opens the court's reasoning."""
    text = squeezed(folded(heading))
    return text.startswith("menimbang") | text.contains("pertimbangan hukum")


def conclusion_trigger(heading: Column) -> Column:
    """Whether a heading opens the ruling."""
    text = F.regexp_replace(folded(heading), r"[\s:]+", "")
    return text.isin("amarputusan", "mengadili")


def short_hash(parts: list[Column], length: int = 12) -> Column:
    """The first digits of the SHA-1 of parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, length)
