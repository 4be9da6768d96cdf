"""Language identification by Bayesian evidence fusion.

Evidence of a record: the likelihood of its text under byte-trigram models,
the language that its markup declares, the suffix of its address, and a prior
of its host. Declared languages and suffixes count by how often they agree
with the text over the whole table; host priors are smoothed towards the
registered domain and that towards the whole, all by grouped aggregation.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .textvec import LOWER, pieces


@dataclass(frozen=True)
class Fusion:
    """bits: 2**bits hashed trigrams. train_rows: labelled texts in the fit, the first by hash. evidence:
    trigrams that a text may count as at most, since those of a long text are not independent.
    strength: pseudo-counts behind every smoothed share. languages: those with the most labelled rows are told apart.
    """

    bits: int = 14
    train_rows: int = 4000
    evidence: float = 150.0
    strength: float = 20.0
    sure: float = 0.5
    languages: int = 200


# Elements of a page that are not running text, and how a page declares its language.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
HIDDEN_TAG = re.compile(r"<(script|style)\b", re.IGNORECASE)
HTML_TAG = re.compile(r"<html\b", re.IGNORECASE)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)


def markup_end(source: str, start: int, gone: set[str]) -> int:
    """Where the hidden element, comment or tag at start ends, -1 if it does not. gone: closers that no later place has, so that each is missed once."""
    if (m := HIDDEN_TAG.match(source, start)) and (name := m[1].lower()) not in gone:
        if closer := HIDDEN[name].search(source, m.end()):
            return closer.end()
        gone.add(name)
    if source.startswith("<!--", start) and "-->" not in gone:
        if (end := source.find("-->", start + 4)) >= 0:
            return end + 3
        gone.add("-->")
    return source.find(">", start) + 1 or -1


def page_text(source: str) -> str:
    """A page without markup, in one pass: the text is read once however its tags are broken."""
    out, at, gone = [], 0, set()
    while (start := source.find("<", at)) >= 0 and (end := markup_end(source, start, gone)) >= 0:
        out += [source[at:start], " "]
        at = end
    return html.unescape("".join([*out, source[at:]]))


def declared_language(source: str) -> str | None:
    """The language of the first html tag that names one; a tag without end reaches to the end of the page."""
    at = 0
    while tag := HTML_TAG.search(source, at):
        end = source.find(">", tag.end())
        at = len(source) if end < 0 else end
        if m := LANG.search(source, tag.end(), at):
            return m[1].lower()
    return None


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and which positions hold one (not across texts, not of breaks alone)."""
    n = len(data)
    folded = LOWER[data]
    folded = np.where(((folded >= 97) & (folded <= 122)) | (folded >= 128), folded, 32).astype(np.uint32)
    if n < 3:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    code = np.zeros(n, np.uint32)
    code[:-2] = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    ok = np.ones(n, bool)
    ends = offsets[1:]
    for back in (1, 2):
        ok[ends[ends >= back] - back] = False
    ok &= code != 0x202020
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64), ok


def _counts(p: Fusion) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for row, end, data, offsets in pieces(batch.column(1)):
                bucket, ok = trigrams(data, offsets, p.bits)
                for k in range(end - row):
                    s = slice(offsets[k], offsets[k + 1])
                    total.setdefault(labels[row + k], np.zeros(1 << p.bits, np.int64))
                    total[labels[row + k]] += np.bincount(bucket[s][ok[s]], minlength=1 << p.bits)
        for label, counts in total.items():
            have = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(have)), pa.array(have), pa.array(counts[have])], names=["label", "bucket", "n"])

    return run


def train(labelled: DataFrame, p: Fusion) -> tuple[list[str], np.ndarray]:
    """Languages and (buckets, languages) log likelihoods from (id, lang, text), on at most train_rows rows."""
    chosen = labelled.where("lang is not null and id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(p.train_rows)
    often = labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.languages).select("lang")
    sample = labelled.where("lang is not null").join(F.broadcast(chosen), "id").join(F.broadcast(often), "lang", "left_semi").orderBy(F.xxhash64("id", "lang", "text")).limit(p.train_rows).select("lang", "text")
    rows = sample.mapInArrow(_counts(p), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["label"] for r in rows})
    counts = np.full((1 << p.bits, len(langs)), 0.5)
    for r in rows:
        counts[r["bucket"], langs.index(r["label"])] += r["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else np.zeros((1 << p.bits, 0), np.float32)


def _likelihoods(p: Fusion, table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(kind, id, address, text) to (kind, id, address, declared, likelihoods)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            declared, text = [None] * len(batch), batch.column(3)
            if "page" in kinds:
                sources = text.to_pylist()
                for k, kind in enumerate(kinds):
                    if kind == "page" and sources[k]:
                        declared[k], sources[k] = declared_language(sources[k]), page_text(sources[k])
                text = pa.array(sources, pa.string())
            got = []
            for row, end, data, offsets in pieces(text, 400_000):
                bucket, ok = trigrams(data, offsets, p.bits)
                doc = np.repeat(np.arange(end - row), np.diff(offsets))[ok]
                out, n = np.zeros((end - row, table.shape[1])), np.bincount(doc, minlength=end - row)
                if len(doc):
                    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    out[doc[at]] = np.add.reduceat(table[bucket[ok]], at, axis=0, dtype=np.float64)
                got.append(out * (np.minimum(n, p.evidence) / np.maximum(n, 1))[:, None])
            flat = np.concatenate(got) if got else np.zeros((0, table.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * table.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(declared, pa.string()), lists], names=["kind", "id", "address", "declared", "likelihoods"])

    return run


def normalised(logs: list[Column]) -> list[Column]:
    """Shares from log weights, safely."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = [F.exp(x - top) for x in logs]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def identify(records: DataFrame, labelled: DataFrame, params: Fusion | None = None) -> DataFrame:
    """(kind, id, lang, posterior, text_lang, declared, host, kept) for every record (kind, id, address, text).

    Records of kind page hold markup and a URL; others hold plain text and a host
    name. labelled is (id, lang, text). A null or empty text has flat likelihoods, so
    that the other evidence decides; a missing declaration or address is no
    evidence. kept says that the posterior reaches `sure`. Repeated rows and null ids are each
    judged. Without labelled texts lang is null, posterior 0 and kept true.
    """
    p = params or Fusion()
    langs, table = train(labelled, p)
    facts = records.select("kind", F.col("id").cast("long").alias("id"), F.col("address").cast("string").alias("address"), F.col("text").cast("string").alias("text"))
    facts = facts.mapInArrow(_likelihoods(p, table), "kind string, id long, address string, declared string, likelihoods array<double>")
    host = F.lower(F.when(F.col("kind") == "page", F.regexp_extract("address", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)).otherwise(F.col("address")))
    labels = F.split("host", r"\.")
    facts = facts.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
    facts = facts.withColumn("suffix", F.when(F.col("host").contains("."), F.element_at(labels, -1)).otherwise(""))
    facts = cut_lineage(facts.withColumn("declared", F.coalesce("declared", F.lit(""))))
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return facts.select("kind", "id", none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), "declared", "host", F.lit(True).alias("kept"))
    like = [F.get("likelihoods", k) for k in range(n)]
    own = normalised(like)
    facts = facts.select("*", *[x.alias(f"t{k}") for k, x in enumerate(own)])
    sums = [F.sum(f"t{k}") for k in range(n)]
    whole = facts.agg(*[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
    total = max(1e-9, sum(whole))
    prior = [(whole[k] + p.strength / n) / (total + p.strength) for k in range(n)]

    def shares(column: str, mark: str) -> DataFrame:
        """P(value | language) / P(value), smoothed."""
        counted = facts.where(F.col(column) != "").groupBy(column).agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)])
        every = sum((F.col(f"c{k}") for k in range(1, n)), F.col("c0")) / total
        return counted.select(column, *[((F.col(f"c{k}") + p.strength * every) / (whole[k] + p.strength) / every).alias(f"{mark}{k}") for k in range(n)])

    by_domain = facts.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("dn"), *[s.alias(f"d{k}") for k, s in enumerate(sums)])
    by_host = facts.where("host <> ''").groupBy("host", "domain").agg(F.count("*").alias("hn"), *[s.alias(f"h{k}") for k, s in enumerate(sums)])
    smooth = [((F.col(f"d{k}") + p.strength * prior[k]) / (F.col("dn") + p.strength)) for k in range(n)]
    hosts = by_host.join(by_domain, "domain").select("host", "hn", *[f"h{k}" for k in range(n)], *[x.alias(f"m{k}") for k, x in enumerate(smooth)])
    joined = facts.join(shares("declared", "a"), "declared", "left").join(shares("suffix", "b"), "suffix", "left").join(hosts, "host", "left")
    zero, one = F.lit(0.0), F.lit(1.0)
    at_host = [(F.greatest(F.coalesce(F.col(f"h{k}") - F.col(f"t{k}"), zero), zero) + p.strength * F.coalesce(F.col(f"m{k}"), F.lit(prior[k]))) / (F.coalesce(F.col("hn") - 1, zero) + p.strength) for k in range(n)]
    fused = normalised([like[k] + F.log(F.coalesce(F.col(f"a{k}"), one)) + F.log(F.coalesce(F.col(f"b{k}"), one)) + F.log(at_host[k]) for k in range(n)])
    out = joined.select("kind", "id", "declared", "host", F.array(*[F.col(f"t{k}") for k in range(n)]).alias("t"), F.array(*fused).alias("f"))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return out.select("kind", "id", best(F.col("f")).alias("lang"), F.array_max("f").alias("posterior"), best(F.col("t")).alias("text_lang"), "declared", "host", (F.array_max("f") >= p.sure).alias("kept"))
