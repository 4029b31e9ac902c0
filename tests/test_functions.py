import hashlib
import io
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.functions import codes, formula, raw, text
from lodestrand.sources import files


def model_spans(b, low=40, high=4000):
    """The splitter's rules, one byte at a time."""
    out, p, n, para = [], 0, len(b), 1
    while p < n:
        while p < n and b[p] in b"\n\r \t":
            p += 1
        if p >= n:
            break
        q = next((i for i in range(p, n - 1) if b[i] == 10 and b[i + 1] in b"\n\r"), n)
        size, start = q - p, p
        while size > high:
            cut = next((i for i in range(start + high, start + high // 2, -1) if b[i] in b".\n"), start + high)
            out.append((start, cut - start, para))
            para, size, start = para + 1, size - (cut - start), cut
        if size >= low:
            out.append((start, size, para))
            para += 1
        p = q + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b".", b"\n", b"\r\n", b" ", b"word ", b"x" * 45, b"\n\n", b"\xc3\xa9"]), max_size=60))
def test_spans_follow_the_rules(parts):
    b = b"".join(parts)
    assert list(raw.spans(b, 10, 60)) == model_spans(b, 10, 60)


def test_spans_of_long_text():
    assert [k for _, k, _ in raw.spans(b"word. " * 1500)] == [4000, 3996, 1004]
    assert list(raw.spans(b"a" * 50 + b"\n\n" + b"b" * 39)) == [(0, 50, 1)]
    assert list(raw.spans(b"")) == list(raw.spans(b" \n\t")) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_repair_is_total_and_keeps_utf8(b):
    t = raw.repair(b)
    t.encode()
    try:
        assert b.decode() == t
    except UnicodeDecodeError:
        assert t


def test_clean():
    assert raw.clean(b"\xef\xbb\xbfit\x92s caf\xc3\xa9 \xe9\r\nx\x00\r\x81") == "it’s café é\nx\n\x81"
    assert raw.repair(b"\xed\xa0\x80") == "í\xa0€"


def test_planes_and_shingles():
    assert codes.planes(64)[0, :2] == pytest.approx([0.6618796, -1.1426495], abs=1e-6)
    assert codes.shingle_code(b"") == (0, 0)
    assert codes.shingle_code(b"ab") == (0, 1 << 33 | 1 << 34)


def test_simhash_native_equals_arrow(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(rng.normal(size=8).tolist(),) for _ in range(20)] + [([0.0] * 8,), (None,)], "v array<double>")
    rows = df.select(codes.simhash(F.col("v"), 8).alias("a"), codes.simhash_native(F.col("v"), 8).alias("b")).collect()
    assert all(r.a == r.b for r in rows[:20])
    assert rows[20].a is None and rows[21].a is None


def test_hex_and_records(spark):
    df = spark.createDataFrame([(-5, 1 << 62, "ab" * 32, 7, 1_700_000_000, 9, 364, 0)], "lsh0 long, lsh1 long, hash string, para long, timestamp long, category int, trits int, cluster long")
    h = df.select("*", codes.record_hex({c: F.col(c) for c in df.columns}).alias("h"))
    back = h.select(*[c.alias(n) for n, c in codes.record_from_hex(F.upper("h")).items()]).first()
    assert len(h.first().h) == 128 and back.lsh0 == -5 and back.lsh1 == 1 << 62 and back.hash == "ab" * 32 and back.trits == 364
    r = df.select(codes.code_hex([F.col("lsh0"), F.col("lsh1")]).alias("h")).select(codes.code_from_hex(F.col("h"), 0).alias("a"), codes.code_from_hex(F.col("h"), 1).alias("b"), codes.code_from_hex(F.lit("xyz"), 0).alias("c")).first()
    assert (r.a, r.b, r.c) == (-5, 1 << 62, None)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    L = F.lit
    mark = "*** {} OF THIS PROJECT GUTENBERG EBOOK A\nB ***"
    book = "top\n" + mark.format("START") + "\n\nProduced by X\n\nBody\ntext\n\n" + mark.format("END") + "\nlicence"
    assert one(text.strip_envelope(L(book))) == "Body\ntext"
    assert one(text.strip_envelope(L("no marks\n"))) == "no marks"
    assert one(text.strip_envelope(L(mark.format("START")))) == mark.format("START")
    assert one(text.strip_envelope_or_null(L("no marks"))) is None
    assert one(text.subject_keys(L("A -- B -- C; a -- b; D"))) == ["a -- b", "d"]
    assert one(text.primary_class(L(" PS; QA"))) == "PS" and one(text.primary_class(L("12"))) is None
    assert one(text.is_label(L("Net sales"))) and not one(text.is_label(L("12.5"))) and not one(text.is_label(L("=A1")))
    assert one(text.owner(L("kay_mann__12.xlsx"))) == "kay_mann"
    assert one(text.shared_subjects(L("x\nSHARED: Ships, life, Sea."))) == ["ships", "sea"]
    assert one(text.shared_subjects(L("SHARED: none"))) is None
    assert [(r.name, r.subjects) for r in one(text.theme_lines(L(" Sea | ships, Ports\nTHEME: x |\nINCOHERENT\nTHEME: no | x")))] == [("sea", ["ships", "ports"])]
    assert one(text.normalise(L("﻿a\r\nb\rc\0"))) == "a\nb\nc"


def test_encoding_class(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"abc", "é".encode(), b"a\x92", b"a\xe9")], "d binary")
    assert [r.e for r in df.select(text.encoding_class(F.col("d")).alias("e")).collect()] == ["ascii", "utf-8", "cp1252", "latin-1"]


def test_formulas():
    f = formula.formula_identity
    assert f("=SUM(A1,B1)") == f("=sum($B$1, A1)") and f("=A1+B1") != f("=B1+A1")
    assert f("=IF(A1,(B1+2),3)")[1] == "IF(ref:A1,punct:(ref:B1op:+num:2,num:3)"
    assert f("x") == (None, "not-a-formula") and f("=Ω") == (None, "unparsed") and f("=") == (None, "empty") and f(None) == (None, "not-a-formula")
    m = "<math xmlns='http://www.w3.org/1998/Math/MathML'><apply>{}</apply></math>".format
    assert formula.math_identity(m("<plus/><ci>x</ci><cn>2</cn>")) == formula.math_identity(m("<plus/><cn>2</cn><ci>𝑥</ci>"))
    assert formula.math_identity(m("<minus/><ci>x</ci><cn>2</cn>"))[0] != formula.math_identity(m("<minus/><cn>2</cn><ci>x</ci>"))[0]
    assert formula.math_identity("<a") == (None, None) == formula.math_identity(None)


def test_chunkers():
    t = "One two three. " * 100
    for f, limit in ((raw.chunks_by_sentence, 80), (raw.chunks_by_stop, 60)):
        parts = f(t, limit)
        assert all(len(p) <= limit for p in parts) and re.findall(r"\w+", " ".join(parts)) == re.findall(r"\w+", t)
    assert raw.chunks_by_sentence("") == [""] and [len(c) for c in raw.chunks_by_sentence("x" * 900)] == [800, 100]
    assert raw.chunks_by_sentence("ab. " + "y" * 30, 20) == ["y" * 20, "ab. yyyyyyyyyy"]
    assert raw.chunks_by_stop("One two! Three. Four five six? Seven", 16) == ["One two. Three", "Four five six", "Seven"]
    assert raw.chunks_by_tokens("abcdef", list, "".join, 4) == ["abcd", "ef"]
    v = raw.hash_embedding("ships and weather")
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and not raw.hash_embedding("").any()


def workbook():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{ns}' xmlns:r='{rel}'><sheets><sheet name='Sums' sheetId='1' r:id='r1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='x'><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{ns}'><si><t>Net sales</t></si><si><t>Gross profit</t></si></sst>")
        cells = "".join(f"<c r='{c}1' t='s'><v>{i % 2}</v></c>" for i, c in enumerate("ABC")) + "<c r='D1'><f>SUM(A1,B1)</f><v>3</v></c>"
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{ns}'><sheetData><row r='1'>{cells}</row></sheetData></worksheet>")
    return b.getvalue()


def test_workbooks(spark):
    df = spark.createDataFrame([("a.xlsx", bytearray(workbook())), ("b.xlsx", bytearray(b"no"))], "path string, content binary")
    c = files.workbooks(df)
    assert [r.formula for r in c.filter("formula is not null").collect()] == ["=SUM(A1,B1)"]
    kinds = {(r.kind, r.text) for r in files.label_groups(c).collect()}
    assert kinds == {("row", "Net sales | Gross profit | Net sales"), ("sheet", "Sums")}


def test_content_hash(spark):
    assert spark.range(1).select(codes.tagged_digest(F.lit("é")).alias("x")).first().x == "sha256:" + hashlib.sha256("é".encode()).hexdigest()
