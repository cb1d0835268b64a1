"""Token ids of whole texts, written to and read from files of ``pfor`` in the order of ids.

Documents are dealt by ranges of (doc_id, text), so one id with very many rows is split too, then
sorted and encoded within their range: texts are shuffled once and no list of ids is.  A null text
is encoded as an empty one; documents without an id come first; repeated rows are all written;
documents of one id are ordered by their texts.
"""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.pfor import TokenBlocks
from quillon.llm.shared import frugal, held, shared_dir
from quillon.llm.text import slices, span_keys

END = 2
#: Parts whose ids a worker keeps: twice this many at most, about 80 MB.
MEMORY = 200_000
#: Bytes of text that are cut into parts together.
TEXTS = 1 << 20

#: Kinds of Latin-1 characters: 0 white space, 1 letter, 2 number, 3 other, 4 none (between texts).
_SPACE, _LETTER, _NUMBER, _OTHER, _NONE = range(5)
_KIND = np.array([_SPACE if c in (32, 133, 160) or 9 <= c <= 13 else _LETTER if chr(c).isalpha() else _NUMBER if chr(c).isnumeric() else _OTHER for c in range(256)], dtype=np.uint8)
_KIND[0] = _NONE
_ONE = np.isin(np.arange(256), [ord(c) for c in "stmd"])
_TWO = np.zeros((256, 256), dtype=bool)
for _x in ("re", "ve", "ll"):
    _TWO[ord(_x[0]), ord(_x[1])] = True
#: The signs that byte-level vocabularies write for bytes: printable ones stand for themselves, the others
#: follow in order from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OF_BYTE = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_OWN))}
_SIGN = str.maketrans({c: "".join(_OF_BYTE[b] for b in chr(c).encode()) for c in range(1, 256)})
_CONTROLS = bytes([*range(9), *range(14, 32), 127, *range(128, 133), *range(134, 160)])


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts that byte-level encoding merges within, in Latin-1 texts with a zero byte
    between them: an English ending after an apostrophe; a run of letters, numbers or other signs with
    one blank before it; white space but for its last character where a sign follows."""
    kind = _KIND[data]
    n = len(data)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = kind[1:] != kind[:-1]
    follows = np.flatnonzero(new[1:n] & (kind[:-1] == _SPACE) & (kind[1:] != _NONE)) + 1
    new[follows - 1] = True
    new[follows[data[follows - 1] == 32]] = False
    near = np.concatenate([data, np.zeros(2, np.uint8)])
    at = np.flatnonzero((data == 39) & new[:n])
    one, two = _ONE[near[at + 1]], _TWO[near[at + 1], near[at + 2]]
    at, size = at[one | two], np.where(one, 2, 3)[one | two]
    new[at + 1] = False
    new[at + size] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    some = kind[start] != _NONE
    return start[some], end[some]


class ByteEncoder:
    """Token ids of texts by a byte-level vocabulary file of the tokenizers library.

    Texts of Latin-1 without controls are cut as the vocabulary's pre-tokenizer cuts them, many texts
    at once as one array of bytes; each distinct part goes to the library's merges once while it is
    remembered, in the signs that the vocabulary writes for its bytes.  Other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts, given in Latin-1."""
        known, former = self.known, self.former
        out: list[bytes | None] = [known.get(p) for p in parts]
        fresh = []
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = former.get(parts[i])
                if x is None:
                    fresh.append(i)
                else:
                    known[parts[i]] = x
        if fresh:
            merge = self.merges.tokenize
            for i, x in zip(fresh, b"\0".join([parts[i] for i in fresh]).decode("latin-1").translate(_SIGN).split("\0"), strict=True):
                out[i] = known[parts[i]] = array("I", [t.id for t in merge(x)]).tobytes()
        if len(known) > MEMORY:
            self.former, self.known = known, {}
        return out

    def _latin(self, texts: list[bytes], end: bytes) -> list[bytes]:
        data = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
        start, stop = cuts(data)
        if not len(start):
            return [end] * len(texts)
        _, first, which = np.unique(span_keys(data, start, stop), return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self.ids_of([raw[a:z] for a, z in zip(start[first].tolist(), stop[first].tolist())])
        size = np.array([len(x) for x in ids], dtype=np.int64) >> 2
        table, base = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = table[np.repeat(base[which] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        edge = upto[np.searchsorted(start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]))].tolist()
        return [out[4 * a : 4 * z] + end for a, z in zip(edge, edge[1:])]

    def __call__(self, texts: list[str | None], end: int = END) -> list[bytes]:
        """Little-endian ids of each text and the end id; null counts as empty."""
        stop = end.to_bytes(4, "little")
        latin = [plain(x or "") for x in texts]
        found = iter(self._latin([x for x in latin if x is not None], stop))
        rest = [x for x, y in zip(texts, latin) if y is None]
        other = iter(self.whole.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [np.array(next(other).ids, dtype="<u4").tobytes() + stop if x is None else next(found) for x in latin]


def plain(text: str) -> bytes | None:
    """The text in Latin-1, None if it holds other characters, controls or a special mark."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if "<|endoftext|>" in text or len(raw.translate(None, _CONTROLS)) != len(raw) else raw


def encoded(docs: DataFrame, vocabulary: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of each document in ascending order of ids, a range of documents in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("byte encoder " + vocabulary, lambda: ByteEncoder(vocabulary))
        for b in batches:
            for lo, hi in slices(b.column(1), TEXTS):
                ids = encode(b.column(1).slice(lo, hi - lo).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return dealt.mapInArrow(frugal(run, "byte encoder " + vocabulary), "doc_id long, ids binary")


def write(found: DataFrame, folder: str) -> None:
    """Ids (doc_id, ids) as files of token blocks, partitions in their order."""
    found.sparkSession.dataSource.register(TokenBlocks)
    found.write.format("pfor").mode("overwrite").save(folder)


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, ids of a folder of token blocks."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("pfor").load(folder)


def stored(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """All documents' ids written to a new folder of the shared ones and read back from there."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(encoded(docs, vocabulary, end), folder)
    return read(spark, folder)
