"""Secret scanning: base patterns, and dictionary-primed compression novelty.

A candidate is a run of 16 or more characters of key alphabets with letters and digits. Its novelty is the number
of bytes by which it lengthens its surroundings when both are compressed with zstandard primed
with a dictionary of code and identifiers: text that the dictionary or the surroundings know costs
next to nothing, random strings cost about log2(alphabet)/8 bytes a character. Other copies of the candidate
are taken out of its surroundings first. A candidate in a sensitive context (a word such as key, secret, auth or
credential shortly before or behind it, or in the name it is assigned to) whose novelty a character is above
`min_novelty` is reported as kind `novel`. Candidates with nothing but space and signs between them (lines of a PEM key,
the parts of a dotted token) are one block and share their context; a short last line of a PEM key goes
with the line before it. Spans of the base patterns always stay.

Defined results: null and empty texts have no spans; equal texts have equal spans; ties are ordered by
start, then kind; an empty table gives no rows; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, pieces, text_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
CONTEXT = re.compile(r"key|secret|token|passw|passphrase|credential|auth|bearer|private|signature|akia|cookie|session", re.I | re.A)
#: What may lie between candidates of one block, and the short last line of a PEM key.
JOIN = re.compile(r"""[\s.,;:|"'\\>#*]{1,40}""")
TAIL = re.compile(r"[\s\\>]{1,40}([A-Za-z0-9+/]{1,15}={0,2})[\s\\>]{1,40}n?-----END", re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

IDENTIFIERS = """
import os sys json requests logging def class return self None True False lambda yield async await raise except finally
public static void final private protected String int boolean new this null throws extends implements package interface
function const let var export default module require console.log document.getElementById addEventListener innerHTML prototype
#include <stdio.h> stdlib.h string.h unsigned char size_t struct typedef sizeof malloc free printf return NULL uint32_t uint64_t
SELECT FROM WHERE GROUP BY ORDER BY INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE PRIMARY KEY VARCHAR INTEGER NOT NULL
application/json text/html charset=utf-8 Content-Type Authorization Bearer Accept-Encoding User-Agent X-Requested-With
http://www.example.com/ https://example.org/index.html localhost:8080 127.0.0.1 /usr/local/bin /etc/config /var/log/messages
configuration environment production development database connection username password hostname timeout exception message
getUserById setConfigValue createConnection parseRequest handleResponse initializeComponent validateInput processDocument
access_key_id secret_access_key client_secret api_key private_key public_key session_token refresh_token csrf_token
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef 00000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxx
YOUR_API_KEY_HERE your-secret-key changeme example placeholder sample test dummy aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ................
1234567890 2020-01-01T00:00:00Z 2024-12-31 january february march april may june july august september october november december
the and for that with this from have not are was were will would there their which about when what been some other into than
"""


@cache
def compressors(level: int, dictionary: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str, level: int = 3, dictionary: str = IDENTIFIERS) -> float:
    """Bytes a character that the candidate adds to its compressed surroundings."""
    c = compressors(level, dictionary)
    known = (before + after).encode("utf-8", "replace")
    return (len(c.compress(known + candidate.encode("utf-8", "replace"))) - len(c.compress(known))) / max(1, len(candidate))


def _value(s: str) -> str:
    """What a candidate of the form name=value assigns, or all of it."""
    v = s[s.rstrip("=").rfind("=") + 1 :]
    return v if len(v) >= 8 else s


def _others(text: str, s: str) -> str:
    """A candidate's surroundings without copies of it or of its value, and without runs that are parts of it."""
    for x in (s, _value(s)):
        text = text.replace(x, " ")
    return CANDIDATE.sub(lambda m: " " if m.group() in s else m.group(), text)


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates, those that adjoin each other together."""
    block: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not any(x.isdigit() for x in s) and (s.islower() or s.isupper() or not s.isalnum()):
            continue
        if not any(x.isalpha() for x in s):
            continue
        if block and not JOIN.fullmatch(text, block[-1][1], m.start()):
            yield block
            block = []
        block.append(m.span())
    if block:
        yield block


def scan(text: str, window: int = 160, reach: int = 48, min_novelty: float = 0.5, level: int = 3, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span, sorted."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()  # only to see whether a keyword occurs at all: its places may differ from the text's
    if any(h in low for h in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for block in _blocks(text):
        if not any(CONTEXT.search(text, max(0, a - reach), b - len(_value(text[a:b]))) or CONTEXT.search(text, b, b + reach) for a, b in block):
            continue
        if not any(x.isdigit() for a, b in block for x in text[a:b]):  # letters alone count beside digits
            continue
        for a, b in block:
            s = text[a:b]
            before, after = _others(text[max(0, a - window - len(s)) : a], s), _others(text[b : b + window + len(s)], s)
            known = novelty(before[-window:], s, after[:window], level, dictionary) >= min_novelty
            if known:
                spans.append((a, 3, b))
        if known and (m := TAIL.match(text, b)):
            spans.append((m.start(1), 3, m.end(1)))
    return sorted(spans)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, min_novelty: float = 0.5, window: int = 160, reach: int = 48, level: int = 3, dictionary: str = IDENTIFIERS) -> DataFrame:
    """doc_id, counts of the base kinds and of novel spans, base_sha256 and spans for each row of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [scan(t, window, reach, min_novelty, level, dictionary) for t in b.column("text").to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())
            base = [hashlib.sha256(digest([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(count, range(4)), pa.array(base), pa.array([digest(f) for f in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return arrow_map(src, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "<secret>", **how: object) -> DataFrame:
    """docs with every span of its texts replaced by `mask`, overlapping spans merged; the other columns stay."""
    names = docs.columns
    kinds = {"min_novelty": 0.5} | how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for a, _, e in scan(t, **kinds) if t else []:
                    if a >= at:
                        parts += [t[at:a], mask]
                    at = max(at, e)
                out.append("".join(parts) + t[at:] if parts else t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return arrow_map(docs.select(*names), run, docs.schema)
