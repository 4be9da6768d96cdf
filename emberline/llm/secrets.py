"""Secret scans: fixed patterns plus dictionary-primed compression novelty.

A candidate in a sensitive context is compressed behind its surrounding text
with a dictionary of the corpus's own identifiers. What the candidate adds to
the compressed size is its novelty: names and words that code repeats add
little, key material adds nearly its own length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns. A run of hex digits or key characters that is
# too short to be reported is not matched at all, which leaves the same spans.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "novel")

# Words that make the text after them sensitive.
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "authorization", "bearer", "private_key", "private key", "access_key", "access key")
# Names that source code of any kind repeats.
COMMON_NAMES = ("import", "return", "function", "class", "public", "static", "const", "string", "value", "default", "config", "settings", "environ", "process", "username", "password", "secret", "token", "api_key", "client_id", "access_key", "authorization", "https://", "localhost", "example")
SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int,novelty:double>>"


@dataclass(frozen=True)
class Novelty:
    """least: code points of a candidate's first run. most: code points tested at once; a candidate goes
    on to its real end, over dots and the lines of a private key. context: code points on either side that
    prime the compressor. reach: how far before a candidate a cue may stand. bytes_per_char: least marginal compressed bytes for each code point.
    dictionary_bytes and names bound the identifier dictionary that every task gets.
    """

    least: int = 16
    most: int = 512
    context: int = 192
    reach: int = 48
    bytes_per_char: float = 0.55
    names: int = 2000
    dictionary_bytes: int = 32_768
    level: int = 3


def identifier_dictionary(docs: DataFrame, text_col: str, p: Novelty) -> bytes:
    """The names most often assigned to in all texts, the most frequent last, at most dictionary_bytes."""
    named = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,39}+)[\"']? *[:=]"), 1)).alias("name"))
    top = named.groupBy("name").count().orderBy(F.desc("count"), "name").limit(p.names).collect()
    words = [r["name"] for r in reversed(top)]
    return "\n".join([*words, *COMMON_NAMES]).encode()[-p.dictionary_bytes :]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _scan(p: Novelty, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cue = re.compile("|".join(map(re.escape, CUES)), re.ASCII | re.IGNORECASE)
        run_of = re.compile(rf"[A-Za-z0-9+/_=~!@#$%^&*-]{{{p.least}}}")
        rest_of = re.compile(r"(?:\.?[A-Za-z0-9+/_=~!@#$%^&*-])*+")
        mark = re.compile(r"-----(BEGIN|END)([A-Z0-9 ]*)-----")
        gap = r"(?:\\[rnt]?|[\s\"',>#*|;])"
        key_lines = re.compile(rf"(?:{gap}++[A-Za-z0-9+/=]++)*+")
        open_lines = re.compile(rf"(?:{gap}++[A-Za-z0-9-]+:[^\n]*+)*+(?:{gap}++[A-Za-z0-9+/=]{{16,}}+)*+")
        parted, vowels = re.compile(r"[^A-Za-z]+"), re.compile(r"[aeiouy]", re.IGNORECASE)
        kind_order = {k: i for i, k in enumerate(KINDS)}
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = zstandard.ZstdCompressor(level=p.level, dict_data=primed, write_content_size=False)

        def novelty(text: str, start: int, end: int) -> float:
            around = text[max(0, start - p.context) : start] + text[end : end + p.context]
            known = len(size.compress(around.encode()))
            return (len(size.compress((around + text[start:end]).encode())) - known) / (end - start)

        def may_be_key(own: str) -> bool:
            """Letters alone have to be unlike words: a long piece of them in changing case, or with few vowels or none for long."""
            if any(x.isdigit() for x in own):
                return True
            piece = max(parted.split(own), key=len)
            turns = sum(a.isupper() != b.isupper() for a, b in zip(piece, piece[1:], strict=False))
            return len(piece) >= p.least and (5 * turns >= len(piece) or 4 * len(vowels.findall(piece)) < len(piece) or max(map(len, vowels.split(piece))) >= 5)

        def novelty_of_run(text: str, start: int, end: int) -> float | None:
            """The novelty of the first part of a run, most characters long at most, that is novel enough; the whole run goes with it."""
            for s in range(start, end, p.most):
                e = min(end, s + p.most)
                s = max(start, e - p.most)
                own = text[s:e]
                if may_be_key(own) and (value := novelty(text, s, e)) >= p.bytes_per_char:
                    return value
            return None

        def key_blocks(text: str) -> list[tuple[int, int, int]]:
            """Start and end of each BEGIN line of a private key, and the end of its block: the next marker, or the last of its lines."""
            marks = list(mark.finditer(text)) if "-----BEGIN" in text else []
            after = [m.start() for m in marks[1:]]
            return [(m.start(), m.end(), after[k] if k < len(after) else open_lines.match(text, m.end()).end()) for k, m in enumerate(marks) if m[1] == "BEGIN" and "PRIVATE KEY" in m[2]]

        def spans(text: str) -> list[dict]:
            keys = key_blocks(text)
            found = base_spans(text)
            out = [{"kind": k, "start": s, "end": e, "novelty": None} for s, e, k in found]
            taken: list[list[int]] = []  # merged base spans
            for s, e in sorted((s, e) for s, e, _ in found):
                if taken and s <= taken[-1][1]:
                    taken[-1][1] = max(taken[-1][1], e)
                else:
                    taken.append([s, e])

            def covered(start: int, end: int) -> bool:
                k = bisect_right(taken, start, key=lambda x: x[0]) - 1
                return k >= 0 and end <= taken[k][1]

            done = 0
            for m in cue.finditer(text):
                stop, last = m.end() + p.reach, m.end()
                k = bisect_right(keys, m.start(), key=lambda x: x[0]) - 1
                if k >= 0 and m.start() < keys[k][1]:  # in the BEGIN line of a private key, whose block is all in reach
                    stop = last = keys[k][2]
                at = max(done, m.end())
                while c := run_of.search(text, at, min(len(text), stop + p.least)):
                    start, end = c.start(), rest_of.match(text, c.end()).end()
                    reported = covered(start, end)
                    value = novelty(text, start, end) if reported else novelty_of_run(text, start, end)
                    if (reported or value is not None) and end < last:
                        end = key_lines.match(text, end, last).end()
                    if value is not None and not covered(start, end):
                        out.append({"kind": "novel", "start": start, "end": end, "novelty": value})
                    at = done = end
            # The pattern stops inside a value at signs such as '!'; the rest is part of the same secret, whatever its novelty.
            novel, run_end = [x for x in out if x["kind"] == "novel"], 0
            for m in ASSIGN.finditer(text) if found else ():
                start = m.start(2)
                if len(m[2]) < ASSIGN_MIN or start < run_end:
                    continue
                run_end = end = rest_of.match(text, m.end()).end()
                k = bisect_right(novel, start, key=lambda x: x["start"]) - 1
                if not covered(start, end) and not (k >= 0 and end <= novel[k]["end"]):
                    out.append({"kind": "novel", "start": start, "end": end, "novelty": novelty(text, start, min(end, start + p.most))})
            return sorted(out, key=lambda x: (x["start"], kind_order[x["kind"]]))

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
        for batch in batches:
            found = [spans(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Novelty | None = None) -> DataFrame:
    """(id_col, spans) for every row: kind, start, end (code points, end exclusive) and novelty.

    Kinds assign, access and hex are the fixed patterns; novel spans stand within
    reach of a cue, or go on where an assigned value's pattern stops: these are reported by rule, with the novelty of
    their first code points for the record, and one run gives one span however many assignments it holds. They may overlap base spans. Null and empty texts have no spans.
    Rows with a null or repeated id are returned like any other.
    """
    p = params or Novelty()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = identifier_dictionary(texts, "text", p)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_scan(p, dictionary), f"id {kind}, spans {SPAN_SCHEMA}").withColumnRenamed("id", id_col)


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of those kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Novelty | None = None) -> DataFrame:
    """docs with every found span replaced by <secret:kind>; all rows and columns stay.

    Overlapping spans are merged and named for the first. A null text stays null, an empty one empty; rows with a null or
    repeated id are each masked, equal texts alike. An empty table stays empty.
    """
    p = params or Novelty()
    columns = docs.columns
    dictionary = identifier_dictionary(docs.select(F.col(text_col).alias("text")), "text", p)
    at = columns.index(text_col)
    scan = _scan(p, dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            (found,) = scan(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])]))
            new = []
            for text, spans in zip(texts.to_pylist(), found.column(1).to_pylist(), strict=True):
                if text is not None and spans:
                    parts, end = [], 0
                    for s in spans:
                        if s["start"] >= end:
                            parts += [text[end : s["start"]], f"<secret:{s['kind']}>"]
                        end = max(end, s["end"])
                    text = "".join([*parts, text[end:]])
                new.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(columns))], names=columns)

    return docs.mapInArrow(run, docs.schema)
