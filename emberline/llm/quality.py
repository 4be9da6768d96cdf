"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from its own features and those
of the lines before and after it, and a transition weight ties neighbours.
A document's score is the mean marginal of "good", weighted by line length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import pieces, span_hashes, words

# Byte classes 0 to 8.
SYMBOLS = b"#*$%&|<>"
SHOUTS = b"!?"
PUNCTUATION = b".,;:'\"()-"


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)  # 0: anything else
    out[list(range(97, 123))] = 1
    out[list(range(65, 91))] = 2
    out[list(range(48, 58))] = 3
    out[list(SYMBOLS)] = 4
    out[list(SHOUTS)] = 5
    out[list(PUNCTUATION)] = 6
    out[[32, 9, 10, 11, 12, 13]] = 7
    out[128:] = 8
    return out


BYTE_CLASS = _classes()
N_OWN, N_ALL = 15, 15 + 2 * 7 + 2
NEIGHBOUR = [1, 4, 5, 6, 11, 12, 13]


@dataclass(frozen=True)
class CrfFit:
    """train_rows: labelled rows that the fit takes, the first by hash of the id. train_lines: of longer
    labelled documents the fit takes so many lines in a row, from a place that a hash of the id gives (scoring takes all).
    Together they bound what the driver fits on: train_rows x train_lines lines."""

    train_rows: int = 4000
    train_lines: int = 256
    steps: int = 200
    l2: float = 1e-3
    seed: int = 7


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', line lengths in bytes, and line offsets by text."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, "right") - 1
    first = np.concatenate([[0], np.cumsum(1 + np.bincount(of, minlength=n_docs))])
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(breaks)) + of
    start[first[:-1]], start[at + 1] = offsets[:-1], breaks + 1
    end[first[1:] - 1], end[at] = offsets[1:], breaks
    length, broken = end - start, np.zeros(len(start), np.int64)
    broken[at] = 1
    by_line = np.repeat(np.arange(len(start)), length + broken)
    table = np.bincount(by_line * 9 + BYTE_CLASS[data], minlength=len(start) * 9).reshape(-1, 9).astype(np.float64)
    w_start, w_end, w_doc, w_hash = words(data, offsets)
    line_of = by_line[w_start] if len(w_start) else w_start
    n_words = np.bincount(line_of, minlength=len(start)).astype(np.float64)
    word_bytes = np.bincount(line_of, weights=w_end - w_start, minlength=len(start))
    again = np.zeros(len(w_hash))
    again[1:] = (w_hash[1:] == w_hash[:-1]) & (w_doc[1:] == w_doc[:-1])
    repeats = np.bincount(line_of, weights=again, minlength=len(start))
    line_hash = span_hashes(data, start, start + length, fold_case=False)
    order = np.lexsort((np.arange(len(start)), line_hash, doc))
    copy = np.zeros(len(start))
    copy[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    copy *= n_words > 0
    bytes_, letters, per_word = np.maximum(length, 1), np.maximum(table[:, 1] + table[:, 2] + table[:, 8], 1), np.maximum(n_words, 1)
    own = np.stack([
        np.ones(len(start)), table[:, 2] / letters, table[:, 3] / bytes_, table[:, 8] / bytes_, np.minimum(1, table[:, 4] / per_word), np.minimum(1, table[:, 5] / per_word),
        repeats / per_word, table[:, 6] / bytes_, n_words == 0, np.minimum(1, n_words / 8), np.log1p(n_words) / 5, np.minimum(2, word_bytes / per_word / 8), copy, (repeats > 0.3 * n_words) & (n_words > 3), table[:, 7] / bytes_,
    ], axis=1)
    before, after = np.zeros((len(start), len(NEIGHBOUR))), np.zeros((len(start), len(NEIGHBOUR)))
    inner = np.ones(len(start), bool)
    inner[first[:-1]] = False
    before[inner] = own[np.flatnonzero(inner) - 1][:, NEIGHBOUR]
    after[np.flatnonzero(inner) - 1] = own[inner][:, NEIGHBOUR]
    is_first, is_last = np.zeros(len(start)), np.zeros(len(start))
    is_first[first[:-1]] = 1
    is_last[first[1:] - 1] = 1
    return np.concatenate([own, before, after, is_first[:, None], is_last[:, None]], axis=1), np.maximum(length, 1), first


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of state 1 for each line, expected transitions (2x2), and the summed log partition.

    unary: (lines, 2). All texts advance one line at a time, the longest first, so
    a step is a numpy operation over the texts that still have lines.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, n = first[:-1][order], n[order]
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    live = len(n)
    alpha[starts] = unary[starts]
    for t in range(1, n[0] if len(n) else 0):
        live = int(np.searchsorted(-n, -t, "left"))
        at = starts[:live] + t
        came = alpha[at - 1][:, :, None] + trans
        alpha[at] = np.logaddexp(came[:, 0], came[:, 1]) + unary[at]
    for t in range((n[0] if len(n) else 0) - 2, -1, -1):
        live = int(np.searchsorted(-n, -(t + 1), "left"))
        at = starts[:live] + t
        goes = trans + (unary[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
    ends = starts + n - 1
    log_z = np.empty(len(n))
    log_z[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    total = np.repeat(log_z, np.diff(first))
    marginal = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - total))
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    k = np.flatnonzero(inner)
    joint = np.exp(alpha[k - 1][:, :, None] + trans + (unary[k] + beta[k])[:, None, :] - total[k][:, None, None])
    return marginal, joint.sum(axis=0), float(log_z.sum())


def fit_crf(features: np.ndarray, first: np.ndarray, labels: np.ndarray, p: CrfFit) -> tuple[np.ndarray, np.ndarray]:
    """Weights of state 1 and the 2x2 transitions, by Adam on the conditional likelihood; a text's lines bear its label."""
    weight, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    if not len(labels):
        return weight, trans
    n_docs, y = len(labels), np.repeat(labels, np.diff(first)).astype(np.float64)
    moves = np.maximum(np.diff(first) - 1, 0)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = moves[labels == 0].sum(), moves[labels == 1].sum()
    theta = np.zeros(len(weight) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        weight, trans = theta[:-4], theta[-4:].reshape(2, 2)
        score = features @ weight
        marginal, joint, _ = forward_backward(np.stack([np.zeros(len(score)), score], axis=1), first, trans)
        grad = np.concatenate([features.T @ (y - marginal), (seen - joint).ravel()]) / n_docs - p.l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.15 * (1 - 0.9 * step / p.steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def window(n: int, most: int, place: int) -> slice:
    """All of n lines, or `most` in a row."""
    at = place % (n - most + 1) if n > most else 0
    return slice(at, min(n, at + most))


def _features(most_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column(2)):
                feats, _, first = line_features(data, offsets)
                places = batch.column(3).to_pylist()[row:end]
                own = [feats[first[k] : first[k + 1]][window(int(first[k + 1] - first[k]), most_lines, places[k])].astype(np.float32).tobytes() for k in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(own, pa.binary())], names=["id", "label", "features"])

    return run


def _scores(weight: np.ndarray, trans: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column(1)):
                feats, length, first = line_features(data, offsets)
                good = feats @ weight
                marginal, _, _ = forward_backward(np.stack([np.zeros(len(good)), good], axis=1), first, trans)
                score = np.add.reduceat(marginal * length, first[:-1]) / np.add.reduceat(length.astype(np.float64), first[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.clip(score, 0, 1))], names=["id", "score"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: CrfFit | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fits the field on at most train_rows labelled rows whose crc32 of the id's text leaves 0 or 2 by 3."""
    p = params or CrfFit()
    chosen = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 3 != 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(p.train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text", F.crc32(F.col("id").cast("string")).alias("place")).mapInArrow(_features(p.train_lines), "id long, label int, features binary")
    rows = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("features"), "features").limit(p.train_rows)  # an id may stand on any number of rows
    got = sorted((r["id"], r["label"], bytes(r["features"])) for r in rows.collect())
    parts = [np.frombuffer(f, np.float32).reshape(-1, N_ALL).astype(np.float64) for _, _, f in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return fit_crf(np.concatenate(parts) if parts else np.zeros((0, N_ALL)), first, np.array([y for _, y, _ in got], np.int64), p)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: CrfFit | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    A null or empty text is one empty line. Without usable labels every score is
    0.5. A row with a null id is scored and has held_out false. Repeated rows are
    scored each; other columns are never inputs.
    """
    weight, trans = train_quality(docs, labels, id_col, text_col, label_col, params)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(weight, trans), "id long, score double")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: CrfFit | None = None) -> DataFrame:
    """Rows of docs that the field accepts, scored in place with no join; columns as before.

    Rows with a null or repeated id are judged each by its own text, equal texts alike. A null or empty text is one
    empty line. Without usable labels every score is 0.5 and every row stays. An empty table stays empty.
    """
    weight, trans = train_quality(docs, labels, id_col, text_col, params=params)
    columns, at = docs.columns, docs.columns.index(text_col)
    score = _scores(weight, trans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(at)], names=["id", "text"])
            keep = np.concatenate([b.column(1).to_numpy() for b in score(iter([numbered]))] or [np.zeros(0)]) >= 0.5
            yield pa.RecordBatch.from_arrays(batch.columns, names=columns).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
