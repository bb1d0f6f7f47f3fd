"""Token counts by section, with offset-mapped attribution.

A document is encoded once as a whole. Its tokens' spans and its sections' spans are both intervals over the
same text; the two are joined by position, and a token that crosses section edges goes where the rule
says: ``first`` (the section of its first character), ``last`` (of its last one) or ``most`` (where most of its
characters lie, the earlier on a tie). Spans are in characters, as the library's offsets are; a token of a byte-level
vocabulary that is part of a character has that character's span.

Sections are the lines of a text, each with the newline that ends it. Null and empty texts have no section and
no token. Every row is counted for itself, repeated ids and rows without one too; other columns are ignored and an
empty table gives an empty result. Texts are encoded some ``BATCH`` bytes at a time, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import prepare
from tessera.llm.textops import chunks
from tessera.llm.token_encode import default_tokenizer, encoder

RULES = ("first", "last", "most")
BATCH = 1 << 18


def attribute(begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token span, and whether it crosses an edge. ``edges``: sorted section starts."""
    a = np.searchsorted(edges, begins, side="right") - 1
    z = np.searchsorted(edges, np.maximum(ends - 1, begins), side="right") - 1
    cross = a != z
    if rule == "last":
        return z, cross
    if rule == "most":
        out = a.copy()
        for i in np.flatnonzero(cross):
            cuts = np.concatenate(([begins[i]], edges[a[i] + 1 : z[i] + 1], [ends[i]]))
            out[i] = a[i] + int(np.argmax(np.diff(cuts)))
        return out, cross
    return a, cross


def _count(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b, buf, off in chunks(batch.column("text"), BATCH):
                raw = buf.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                tokens = enc.spans(texts)
                n = np.array([len(t) for t in tokens])
                begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))  # the texts one after another, in characters
                spans = np.concatenate(tokens) + np.repeat(begin[:-1], n)[:, None]
                lines = np.flatnonzero(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
                edges = np.union1d(begin[:-1][np.diff(begin) > 0], lines[~np.isin(lines, begin)])
                where, cross = attribute(spans[:, 0], spans[:, 1], edges, rule) if len(edges) else (np.zeros(0, np.int64), np.zeros(0, bool))
                per = np.bincount(where, minlength=len(edges))
                first = np.searchsorted(edges, begin)
                crossing = np.concatenate(([0], np.cumsum(cross)))[np.concatenate(([0], np.cumsum(n)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(np.diff(crossing), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(per, pa.int64())),
                    ],
                    ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
                )

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens) of every row; the section counts sum to n_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(tokenizer or default_tokenizer(), rule), "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
