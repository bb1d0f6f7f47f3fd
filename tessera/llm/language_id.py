"""Language identification by rank-order n-gram profiles.

A profile lists the ``PROFILE`` most frequent letter n-grams (n = 1..3, words padded by separators) of a
language over all its training documents, in order of frequency. A document's own most frequent n-grams
are compared with each profile by out-of-place distance: the sum of rank differences, ``PROFILE`` for an
n-gram the profile lacks. The nearest profile is the language; the score is 1 less the distance's share of the
greatest possible.

Null, empty and letterless texts are ``und`` with score 0, and so is everything when nothing was learnt. Ties
go to the smaller n-gram and the smaller language name. Rows with a null lang teach nothing. Every row is predicted for
itself, repeated ids and rows without one too; other columns are ignored, and an empty table gives an empty result.
Whole texts are read, some ``CHUNK`` bytes at a time, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.codepoints import decode, folded
from tessera.llm.shared import partitions, prepare, tidy
from tessera.llm.textops import chunks

PROFILE = 400
#: Bytes of text whose n-grams are held at once, some 150 bytes of memory for each.
CHUNK = 1 << 18
UND = "und"


def gram_codes(stream: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For n = 1, 2, 3: positions and dense codes of the n-grams of a folded stream, and its alphabet.

    A separator stands only at an n-gram's ends, and every n-gram has a letter.
    """
    alphabet, dense = np.unique(stream, return_inverse=True)
    if len(alphabet) == 0 or alphabet[0] != 0:
        alphabet, dense = np.concatenate((np.zeros(1, np.uint32), alphabet)), dense + 1
    a = np.uint64(len(alphabet)) if len(alphabet) > 1000 else np.uint32(len(alphabet))
    d = dense.astype(a.dtype)
    places, codes = [], []
    ink = d != 0
    p = np.flatnonzero(ink)
    places.append(p)
    codes.append(d[p])
    p = np.flatnonzero(ink[:-1] | ink[1:])
    places.append(p)
    codes.append(a + d[p] * a + d[p + 1])
    p = np.flatnonzero(ink[1:-1])
    places.append(p)
    codes.append(a + a * a + (d[p] * a + d[p + 1]) * a + d[p + 2])
    return places, codes, alphabet


def gram_names(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The n-grams themselves, packed into one integer each: 21 bits a character, unused ones all set."""
    a, wide = len(alphabet), alphabet.astype(np.int64)
    c = codes.astype(np.int64)
    none = np.int64(0x1FFFFF)
    one, two = c < a, (c >= a) & (c < a + a * a)
    r = np.where(one, c, np.where(two, c - a, c - a - a * a))
    c1 = np.where(one, r, np.where(two, r // a, r // (a * a)))
    c2 = np.where(one, 0, np.where(two, r % a, r // a % a))
    c3 = np.where(one | two, 0, r % a)
    return wide[c1] | np.where(one, none, wide[c2]) << 21 | np.where(one | two, none, wide[c3]) << 42


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        total: dict[str, dict[int, int]] = {}
        for a, b, buf, off in chunks(batch.column("text"), CHUNK):
            cps, off = decode(buf, off)
            stream, off, _ = folded(cps, off, "letter")
            places, codes, alphabet = gram_codes(stream)
            names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
            lang_of = np.repeat(which, np.diff(off))
            end_of = np.repeat(off[1:], np.diff(off))
            for i, name in enumerate(names):
                here = total.setdefault(str(name), {})
                for n, (p, c) in enumerate(zip(places, codes, strict=True), 1):
                    mine = c[(lang_of[p] == i) & (p + n <= end_of[p])]
                    if len(alphabet) <= 128 and len(mine) > 50_000:
                        count = np.bincount(mine)
                        found = np.flatnonzero(count)
                        count = count[found]
                    else:
                        found, count = np.unique(mine, return_counts=True)
                    for g, k in zip(gram_names(found, alphabet).tolist(), count.tolist(), strict=True):
                        here[g] = here.get(g, 0) + k
        for name, here in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(here), pa.string()), pa.array(list(here), pa.int64()), pa.array(list(here.values()), pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of every language in ``docs`` (text, lang). Only ``size`` n-grams a language reach the driver."""
    spark = prepare(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the largest of each salted part first, so that no task orders all n-grams of a language
    salt = F.pmod(F.xxhash64("gram"), F.lit(partitions(spark)))
    order = [F.desc("n"), "gram"]
    top = counts.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= size)
    lists = top.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, size).alias("grams"))
    return {r["lang"]: [g["gram"] for g in r["grams"]] for r in lists.orderBy("lang").collect() if r["grams"]}


def _predict(profiles: dict[str, list[int]], size: int, least: float | None = None):
    """Predictions of each batch; with ``least``, its rows of a learnt language with that score or more instead."""
    names = sorted(profiles)
    every = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in names])) if names else np.zeros(0, np.int64)
    rank = np.full((len(every) + 1, max(1, len(names))), -1, np.int64)
    for i, n in enumerate(names):
        rank[np.searchsorted(every, np.array(profiles[n], np.int64)), i] = np.arange(len(profiles[n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, _, buf, off in chunks(batch.column("text"), CHUNK):
                cps, off = decode(buf, off)
                stream, off, _ = folded(cps, off, "letter")
                places, codes, alphabet = gram_codes(stream)
                cut = [np.searchsorted(p, off) for p in places]
                for d in range(len(off) - 1):
                    own = [c[k[d] : np.searchsorted(p, off[d + 1] - n, side="right")] for n, (p, c, k) in enumerate(zip(places, codes, cut, strict=True), 1)]
                    s = np.sort(np.concatenate(own))
                    if len(s) == 0 or not names:
                        pred.append(UND)
                        score.append(0.0)
                        continue
                    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    n = np.diff(np.append(first, len(s)))
                    if len(n) > size:  # the most frequent, and all that tie with the last of them
                        keep = n >= np.partition(n, len(n) - size)[len(n) - size]
                        first, n = first[keep], n[keep]
                    grams = gram_names(s[first], alphabet)
                    order = np.lexsort((grams, -n))[:size]
                    grams = grams[order]
                    at = np.searchsorted(every, grams)
                    at[at == len(every)] = 0
                    at = np.where(every[at] == grams, at, len(every))
                    r = rank[at]
                    away = np.where(r < 0, size, np.abs(r - np.arange(len(grams))[:, None])).sum(0)
                    best = int(np.argmin(away))
                    pred.append(names[best])
                    score.append(1.0 - float(away[best]) / (size * len(grams)))
            if least is not None:
                yield batch.filter(pa.array([p != UND and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))
                continue
            arrays = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "text"]
            kept = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; texts are the only input."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_predict(profiles, size)), "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, profiles: dict[str, list[int]], least: float, size: int = PROFILE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is of a learnt language with a score of ``least`` or more."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(tidy(_predict(profiles, size, least)), docs.schema)


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
