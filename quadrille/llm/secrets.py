"""Secret scans: fixed patterns, and the token-efficiency test.

A random string costs a byte-pair vocabulary many tokens: fewer than `ratio` characters go into one.
Runs of 20 and more key characters are tested, unless they are known digests (hexadecimal of a
digest's length, UUIDs) or identifiers (words of 3 to 15 letters and short numbers joined by marks or by
capitals, and numbers of up to 20 digits, as 64-bit ids have). Stretches of a run between its words are tested as well as the whole, so that a readable name or path before a key
doesn't hide it; the span is the whole run. Groups of 3 to 15 letters between marks pass for words unless the whole run has fewer
than WORD_RATIO characters for a token. Of a run that overlaps spans of fixed patterns, what is left beside them is tested, 20 characters or more each.

Spans are in code points, end exclusive. Null text counts as empty; an empty text has no spans;
repeated rows are scanned each; only doc_id and the results are returned by `scan`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quadrille.llm.common import map_arrow

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
MARKS = re.compile(r"[+/_=.-]+")
#: Words (a capital may begin one), upper-case words and numbers; no two ways to cut a text.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[A-Z]")
#: Characters for a token below which a run of letter groups isn't made of words either.
WORD_RATIO = 1.6
#: What a 64-bit id can't be.
LONG_NUMBER = re.compile(r"[0-9]{21}")
CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")

Span = tuple[str, int, int]


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def is_word(part: str) -> bool:
    """Whether a part without marks consists of words and numbers of up to four digits, with two changes between them at most."""
    pieces = PIECE.findall(part)
    return len(CHANGE.findall(part)) <= 2 and all(len(p) <= 4 if p.isdigit() else 3 <= len(p) <= 15 for p in pieces)


def looks_random(run: str, ratio: float, path: str) -> bool:
    # known digests stand apart from what is left to judge
    core = UUID.sub("/", run).strip("+/_=.-")
    tested: list[str] = []
    whole: list[str] = []
    stretch: list[str] = []
    words = mixed = 0
    other = False
    at = 0
    for m in [*MARKS.finditer(core), None]:
        part, mark = core[at : m.start() if m else len(core)], m[0] if m else ""
        at = m.end() if m else at
        digest, word = DIGEST.fullmatch(part) and len(part) in DIGEST_LENGTHS, is_word(part)
        if digest or word:
            tested.append("".join(stretch))
            stretch = []
        else:
            stretch += [part, mark]
            short = len(part) <= 4
            other |= not short
            mixed += short and not part.isalpha() and not part.isdigit()
        if not digest:
            whole += [part, mark]
            words += len(part) if word else 0
    text = "".join(whole)
    if not other and (not mixed or 2 * words >= len(text)):
        # words by their shape alone: no vocabulary takes a word in pieces this small
        letters = "".join(whole).strip("+/_=.-")
        return len(letters) >= 20 and any(c.isalpha() for c in letters) and len(letters) < min(ratio, WORD_RATIO) * len(encoding(path).encode_ordinary(letters))
    for some in (*tested, "".join(stretch), text):
        some = some.strip("+/_=.-")
        if len(some) >= 20 and (LONG_NUMBER.search(some) or any(c.isalpha() for c in some)) and len(some) < ratio * len(encoding(path).encode_ordinary(some)):
            return True
    return False


def spans_of(text: str, ratio: float, path: str) -> list[Span]:
    found = base_spans(text)
    taken = sorted((s, e) for _, s, e in found)
    starts, reach = [s for s, _ in taken], [*accumulate((e for _, e in taken), max)]
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or reach[before - 1] <= m.start():
            rests = [m.span()]
        else:  # what stands beside base spans
            rests, at = [], m.start()
            for s, e in [*((s, e) for s, e in taken[:before] if e > m.start()), (m.end(), m.end())]:
                if s - at >= 20:
                    rests.append((at, s))
                at = max(at, e)
        found += [("token", a, b) for a, b in rests if looks_random(text[a:b], ratio, path)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def scan(docs: DataFrame, ratio: float = 2.3, vocabulary: str = "") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema["doc_id"].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py() or "", ratio, path)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    schema = StructType([StructField("doc_id", id_type), StructField("spans", ArrayType(SPAN))])
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), find, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
