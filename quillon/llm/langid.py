"""Language ID by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent character n-grams (one to three
characters) over all training documents, by rank.  A document's own most frequent n-grams are
compared with each profile: the out-of-place distance adds up how far each n-gram's rank is from
its rank in the profile, ``PROFILE`` if the profile lacks it.

Counting covers whole texts and all training rows; tasks send one count for each language and
n-gram they met, and what reaches the driver is ``PROFILE`` n-grams for each language.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import frugal

PROFILE = 300
#: Characters counted together; the result doesn't depend on it.
PIECE = 1 << 16
#: Distinct n-grams of a language that a task holds before it sends their counts on.
HOLD = 1 << 18
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as numbers) of the lower-cased text and their counts, over all of it.

    Anything but letters separates words; a word's edges count as one blank; no n-gram spans
    two words.  The text is read a piece at a time; the last two characters before a piece are
    carried into it, so an n-gram or word across pieces counts as in the whole text.
    """
    parts, tail, inside = [], np.array([32], dtype=np.int64), False
    for i in range(0, len(text), PIECE):
        # sigma first: it is the one letter whose lower case depends on its neighbours
        code = np.frombuffer(text[i : i + PIECE].replace("\u03a3", "\u03c3").lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        is_letter = letters()[code]
        before = np.concatenate([[inside], is_letter[:-1]])
        new = np.where(is_letter, code, 32)[is_letter | before]
        inside = bool(is_letter[-1])
        if len(new):
            parts.append(_counted(tail, new))
            tail = np.concatenate([tail, new])[-2:]
    if inside:
        parts.append(_counted(tail, np.array([32], dtype=np.int64)))
    return _summed(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(tail: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end within ``new``, which follows ``tail``."""
    code = np.concatenate([tail, new])
    three = ((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[code[1:-1] != 32]
    last = code[len(tail) - 1 :]
    two = ((last[:-1] << 21) | last[1:])[(last[:-1] != 32) | (last[1:] != 32)]
    every = np.concatenate([new[new != 32], two, three])
    every.sort()
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    return every[edge], np.diff(np.append(edge, len(every)))


def top(keys: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams in order; ties by the n-gram's number."""
    return keys[np.lexsort((keys, -counts))[:k]]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", k: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages in ``docs``; rows whose text or language is null don't count.

    An empty table, or one without letters, gives no profiles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = defaultdict(list)
        waiting: dict[str, int] = defaultdict(int)
        found: dict[str, list] = defaultdict(list)

        def flush(name: str) -> None:
            found[name] = [_summed([*found[name], grams(" ".join(texts.pop(name)))])]
            waiting.pop(name)

        def sent(name: str) -> pa.RecordBatch:
            keys, n = found.pop(name)[0]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            for name, x in zip(b.column(0), b.column(1)):
                name, x = name.as_py(), x.as_py()
                texts[name].append(x)
                waiting[name] += len(x) + 1
                if waiting[name] > PIECE:
                    flush(name)
                    if len(found[name][0][0]) > HOLD:
                        yield sent(name)
        for name in list(texts):
            flush(name)
        for name in list(found):
            yield sent(name)

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(frugal(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out: dict[str, list[int]] = defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):
        out[r.lang].append(r.gram)
    return dict(out)


def predict(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``extra``, lang_pred, score.

    lang_pred is the language of the nearest profile (ties: the first by name), ``und`` with
    score 0 if text is null or has no letter, or if there are no profiles.  score is 1 less the
    distance as a share of the largest possible.  Each row is judged alone: repeated rows repeat.
    """
    rows = docs.select(F.col(text).alias("_text"), F.col(key), *(F.col(c) for c in extra))
    return _judged(rows, profiles, lambda b: b.column(0), 1)


def predict_whole(rows: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """``rows``, one struct column that holds ``text``, with lang_pred and score as in ``predict``; the
    text travels once."""
    return _judged(rows, profiles, lambda b: b.column(0).field(text), 0)


def _judged(rows: DataFrame, profiles: dict[str, list[int]], texts: Callable[[pa.RecordBatch], pa.Array], first: int) -> DataFrame:
    names = sorted(profiles)
    ranks = {name: np.array(profiles[name], dtype=np.int64) for name in names}
    sorted_keys = {name: np.argsort(ranks[name]) for name in names}

    def judge(x: str | None) -> tuple[str, float]:
        keys, counts = grams(x or "")
        if not len(keys) or not names:
            return UNKNOWN, 0.0
        own = top(keys, counts)
        best, least = UNKNOWN, 2.0
        for name in names:
            order = sorted_keys[name]
            have = ranks[name][order]
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            far = np.where(have[at] == own, np.minimum(np.abs(order[at] - np.arange(len(own))), PROFILE), PROFILE)
            d = far.sum() / (PROFILE * len(own))
            if d < least:
                best, least = name, float(d)
        return best, 1 - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [judge(x.as_py()) for x in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(first, b.num_columns)), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())],
                [*(b.schema.names[first:]), "lang_pred", "score"],
            )

    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(frugal(run), T.StructType([*rows.schema.fields[first:], *own]))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds
