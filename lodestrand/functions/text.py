"""Text functions that built-in expressions can say: envelopes, ids, catalogue fields, labels, line formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = r"(?ims)^[\x{FEFF} \t]*\*{3}\s*%s\s+OF\s+TH(?:E|IS)\s+PROJECT\s+GUTENBERG\s+EBOOK.{0,300}?\*{3}"
_CREDIT = r"(?is)^\s*(?:e-?text\s+prepared|transcribed|prepared|produced)\s+by\b.*?(?:\n\s*\n|\z)"
ANCILLARY = tuple(f"{n}.txt" for n in "cd-dvd-readme contents donate-howto instructions license pnote readme readme-license readme-math".split())


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    """Line ends as LF, no NUL, no byte order mark at the start."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\x00", ""), r"^\x{FEFF}", "")


def _at(part: Column, text: Column) -> Column:
    return F.call_function("locate", part, text)


def _parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Opening mark, text after it, closing mark in that, text between."""
    start = F.regexp_extract(text, _MARK % "START", 0)
    after = F.when(start == "", text).otherwise(F.substring(text, _at(start, text) + F.length(start), F.length(text)))
    end = F.regexp_extract(after, _MARK % "END", 0)
    body = F.when(end == "", after).otherwise(F.substring(after, F.lit(1), _at(end, after) - 1))
    return start, after, end, body


def strip_envelope(text: Column) -> Column:
    """What lies between the opening and closing marks; all of the text where that is nothing.

    A credit at the start goes, unless nothing would remain. Newlines at both ends go too.
    """
    _, _, _, body = _parts(text)
    credit = F.regexp_extract(body, _CREDIT, 0)
    rest = F.substring(body, F.length(credit) + 1, F.length(body))
    kept = F.when((credit != "") & rest.rlike(r"\S"), rest).otherwise(body)
    return F.when(F.length(body) == 0, text).otherwise(F.regexp_replace(kept, r"^\n+|\n+\z", ""))


def strip_envelope_or_null(text: Column) -> Column:
    """The lines between the marks as they are; null where either mark is missing."""
    start, _, end, body = _parts(text)
    return F.when((start != "") & (end != ""), F.regexp_replace(body, r"^[^\n]*\n|\n\z", ""))


def paragraphs(text: Column, low: int = 40, high: int = 4000) -> Column:
    """array<string>: texts between blank lines, white space collapsed, of low to high characters."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), collapse), lambda x: F.length(x).between(low, high))


def is_text_file(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*suffixes)


def is_book_file(path: Column) -> Column:
    """Not one of the files that accompany books."""
    return ~F.lower(F.element_at(F.split(path, "/"), -1)).isin(*ANCILLARY)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def book_id(path: Column) -> Column:
    """The number a file is named by, else that of the deepest folder named by a number, else null."""
    name = F.regexp_extract(stem(path), r"^(\d+)(-\d+)?$", 1)
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x.rlike(r"^\d+$"))
    return F.coalesce(F.when(name != "", name), F.when(F.size(folders) > 0, F.element_at(folders, -1)))


def revision(path: Column) -> Column:
    """How many folders named old a path goes through."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x == "old"))


def encoding_rank(path: Column) -> Column:
    s = stem(path)
    return F.when(s.endswith("-0"), 0).when(s.endswith("-8"), 2).when(s.endswith("-5"), 3).otherwise(1)


#: A file named by a number with one of the suffixes that tell an encoding.
TEXT_FILE = r"^(\d+)(-\d+)?\.txt$"


def text_rank(name: Column) -> Column:
    """0 for UTF-8, 1 for none named, 2 for 8-bit; null for other suffixes."""
    s = F.regexp_extract(name, TEXT_FILE, 2)
    return F.when(s == "-0", 0).when(s == "", 1).when(s == "-8", 2)


def death_year(authors: Column) -> Column:
    year = F.regexp_extract(authors, r"\d{3,4}\??\s*-\s*(\d{3,4})", 1)
    return F.when(year != "", year.cast("int"))


def primary_class(locc: Column) -> Column:
    """The capitals that begin the first class of a list."""
    c = F.regexp_extract(F.trim(F.element_at(F.split(locc, ";"), 1)), r"^[A-Z]+", 0)
    return F.when(c != "", c)


def subject_keys(subjects: Column, depth: int = 2) -> Column:
    """Headings cut to their first facets, in lower case, each once."""
    facets = lambda h: F.filter(F.transform(F.split(h, "--"), lambda x: F.trim(x)), lambda x: x != "")
    cut = lambda h: F.lower(F.array_join(F.slice(facets(h), 1, depth), " -- "))
    return F.array_distinct(F.filter(F.transform(F.split(subjects, ";"), lambda h: cut(F.trim(h))), lambda x: x != ""))


def is_label(value: Column) -> Column:
    """A spreadsheet label: 2 to 200 characters with two letters, neither formula nor number nor date."""
    v = F.trim(value)
    number = v.rlike(r"^[£$¥€\s]*[+-]?[,\d]*[.]?\d+\s*%?$") | v.rlike(r"^\d{1,4}[/-]\d{1,2}(?:[/-]\d{1,4})?$")
    return F.length(v).between(2, 200) & ~v.startswith("=") & ~number & v.rlike("[A-Za-z]{2}")


def owner(name: Column) -> Column:
    o = F.regexp_extract(name, r"([a-z]+_[a-z]+)__", 1)
    return F.when(o != "", o)


GENERIC = tuple(
    "action actions day description emotion emotions event events feeling feelings he human humans it life man men n/a nature none nothing object objects people person place places she subject subjects text they things time unrelated way woman women words work world".split()
)


def clean_subjects(items: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Subjects in lower case without signs at the ends, in order; those that say nothing go."""
    bare = F.transform(items, lambda x: F.lower(F.regexp_replace(x, r"""^[\s\[\]"'.*-]+|[\s\[\]"'.*-]+$""", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.isin(*generic))


def shared_subjects(answer: Column) -> Column:
    """Subjects of an answer's first SHARED line; null for none or unrelated."""
    line = F.trim(F.regexp_replace(F.regexp_extract(answer, r"(?im)^\s*(SHARED.*)$", 1), r"^[^:]*:", ""))
    found = clean_subjects(F.split(line, ","))
    return F.when((line != "") & ~F.upper(line).rlike("^(NONE|UNRELATED)") & (F.size(found) > 0), found)


def theme_lines(answer: Column, most: int = 5) -> Column:
    """array<struct<name, subjects>> of THEME lines before any INCOHERENT, `most` at most."""
    head = F.element_at(F.split(F.concat(F.lit("THEME:"), answer), r"(?im)^\s*INCOHERENT"), 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"(?i)^\s*THEME:"))
    body = lambda x: F.regexp_replace(x, r"(?i)^(\s*THEME:)+", "")
    name = lambda x: F.lower(F.trim(F.element_at(F.split(body(x), r"\|"), 1)))
    items = lambda x: F.filter(F.transform(F.split(F.regexp_extract(body(x), r"\|(.*)", 1), ","), lambda i: F.lower(F.trim(i))), lambda i: i != "")
    made = F.transform(lines, lambda x: F.struct(name(x).alias("name"), items(x).alias("subjects")))
    return F.slice(F.filter(made, lambda t: (t["name"] != "") & ~t["name"].startswith("incoherent") & (F.size(t["subjects"]) > 0)), 1, most)


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def encoding_class(data: Column) -> Column:
    """ascii, utf-8, cp1252 (a byte of 80 to 9F) or latin-1, of a binary column."""
    h = F.hex(data)
    return F.when(~h.rlike("^(?:..)*[89A-F]."), "ascii").when(F.is_valid_utf8(data), "utf-8").when(h.rlike("^(?:..)*[89]."), "cp1252").otherwise("latin-1")
