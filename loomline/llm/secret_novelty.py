"""Secret scans: fixed patterns, and strings in sensitive places that compression can't shorten.

A candidate is a long run of key characters soon after a word such as secret or token. A zstandard
compressor that is primed with an identifier dictionary packs the text around the candidate without
it and with it; the bytes that it adds, by its length, are its novelty. Names, paths and repeated
patterns are made of what the dictionary and the surroundings hold and add little; keys add about
all they have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import lean, texts

# fixed patterns, given with the query's contract; letters of ASCII alone fold
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXES = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What makes a place sensitive: one of these ends at most BEFORE code points before it.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_ -]?key|credential|private|bearer|authori[sz]ation|(?:access|account|signing|encryption|client)[_ -]?(?:key|id)", re.ASCII | re.IGNORECASE)
BEFORE = 48
#: Code points of the surroundings on either side, and the share of its own length that a secret adds at least.
AROUND, NOVEL = 256, 0.7
#: Identifiers in the dictionary at most, and the documents that one is in at least.
IDENTIFIERS, LEAST_DOCS = 8192, 2
ZSTD_LEVEL = 9


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> list[str]:
    """The letter runs of 4 to 24 ASCII letters that most documents hold, most frequent first; ties by text.

    Counted over all documents. Keys have digits, so that not even one copied everywhere gets in whole. At
    most `most` short strings come to the driver: the dictionary's size, whatever the corpus'.
    """
    # the outer form, as Catalyst would copy the whole expression into a filter below an inner one
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)))
    each = docs.select(F.explode_outer(runs).alias("word")).where(F.length("word").between(4, 24))
    found = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]


def novelty(known: list[str]) -> Callable[[str, int, int], float]:
    """A function of text, start and end: added bytes per byte of text[start:end] against its surroundings and the identifiers."""
    # the most frequent come last: zstandard reaches the end of a dictionary with the shortest offsets
    raw = " ".join(reversed(known)).encode()
    primed = {}
    if len(raw) >= 8:
        primed["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed["dict_data"].precompute_compress(level=ZSTD_LEVEL)
    packer = zstandard.ZstdCompressor(level=ZSTD_LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **primed)

    def measured(text: str, start: int, end: int) -> float:
        string = text[start:end]
        around = text[max(0, start - AROUND) : start].replace(string, "") + text[end : end + AROUND].replace(string, "")  # its own copies nearby are no surroundings
        around, string = around.encode("utf-8", "replace"), string.encode()
        return (len(packer.compress(around + string)) - len(packer.compress(around))) / len(string)

    return measured


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, leftmost and without overlap in each kind, those that are too short left out."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEXES.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], measured: Callable[[str, int, int], float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates in sensitive places, clear of the base spans, that are new to the compressor."""
    marks = [m.end() for m in SENSITIVE.finditer(text)]
    found = []
    k = b = 0
    reach = -1  # how far the base spans that begin so far go
    for m in CANDIDATE.finditer(text) if marks else ():
        start, end = m.span()
        while k + 1 < len(marks) and marks[k + 1] <= start:
            k += 1
        while b < len(base) and base[b][0] < end:
            reach = max(reach, base[b][2])
            b += 1
        string = m[0]
        sensitive = marks[k] <= start <= marks[k] + BEFORE
        if sensitive and reach <= start and re.search("[0-9]", string) and re.search("[A-Za-z]", string) and measured(text, start, end) >= NOVEL:
            found.append((start, 3, end))
    return found


def scan(docs: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, spans, base) of each row of docs (doc_id, text); spans and base are arrays of (kind, start, end), by start, then kind.

    Positions are code points, the end not included. base are the fixed patterns' spans, spans these and the novel
    ones. A null text is empty; rows are judged each by itself, a null doc_id is kept, other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = novelty(known)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            whole, base = [], []
            for text in batch.column("text").to_pylist():
                fixed = base_spans(text or "")
                base.append(named(fixed))
                whole.append(named(sorted(fixed + novel_spans(text or "", fixed, measured))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, kind), pa.array(base, kind)], names=["doc_id", "spans", "base"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return texts(docs).mapInArrow(lean(run), f"doc_id long, spans {span}, base {span}")
