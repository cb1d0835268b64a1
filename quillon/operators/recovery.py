"""How far one missing token spreads, what a seeded edit does, and which mutants are widenings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import trees
from quillon.operators.nodes import VOID
from quillon.runtime import ship

#: Deletions a file, and the least size at which a share says something about recovery.
PER_FILE, MIN_BYTES = 8, 1024
#: Fixed values of the generator xorshift64*.
SHIFTS, MULTIPLIER = (12, 25, 27), 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
#: Characters of texts whose rows go into one batch.
_BATCH = 1 << 22


def error_bytes(rows: list[dict]) -> int:
    """Bytes under outermost error nodes, each counted once."""
    total, upto = 0, -1
    for r in rows:
        if r["is_missing"] and r["node_id"] > upto:
            total += r["end_byte"] - r["start_byte"]
            upto = r["last_desc_id"]
    return total


def _rows(files: DataFrame, file_id: str, text: str, each, schema: str) -> DataFrame:
    ship(files.sparkSession)
    rows = files.select(F.col(file_id).alias("file_id"), F.col(text).alias("text"))
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = [x.split()[0] for x in schema.split(", ")], [kinds[x.split()[1]] for x in schema.split(", ")]

    def batch(keys: pa.Array, place: list[int], found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(place, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*found), types))], ["file_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, found, size = [], [], 0
            for i in range(b.num_rows):
                source = b.column(1)[i].as_py() or ""
                for row in each(b.column(0)[i].as_py(), source):
                    place.append(i)
                    found.append(row)
                    size += len(source)
                if found and (size > _BATCH or i + 1 == b.num_rows):
                    yield batch(b.column(0), place, found)
                    place, found, size = [], [], 0
            if found:
                yield batch(b.column(0), place, found)

    return rows.mapInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, {schema}")


def losses(source: str, per_file: int = PER_FILE) -> Iterator[tuple[int, str, int, int]]:
    """(start, token, size, error_bytes) of each token that ``deletions`` takes out of a text, by one pass over it.

    In a clean text, losing a tag that opens, or what neither opens nor closes, leaves nothing open.  Losing an end
    tag puts all that follows a level deeper: what is open there stays open if no later end tag goes below the
    outermost of it, and then all from that one's start to the end is inside an error, else nothing is.
    """
    found = trees.tokens(source)
    depth = low = 0
    root, roots = -1, []  # of each token: the start of the outermost tag that it is in, if it is an end tag, and its level
    for token, name, is_end, start, _ in found:
        if is_end:
            depth -= 1
            roots.append((root, low) if depth >= low else None)
            low = min(low, depth)
        else:
            if name and name not in VOID and not token.endswith("/>"):
                root = start if depth == low else root
                depth += 1
            roots.append(None)
    if depth > low:  # a tag of its own is never closed
        return
    size, step = len(source.encode()), max(1, len(found) // per_file)
    for (token, _, _, start, end), at in list(zip(found, roots))[::step][:per_file]:
        left = size - (end - start)
        yield start, token[:24], left, left - at[0] if at and at[1] == low else 0


def deletions(files: DataFrame, file_id: str = "page_id", text: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """file_id, at, deleted, size, error_bytes: up to ``per_file`` tokens of each clean file, spread over it,
    taken out one at a time.  Files with errors of their own have none; error_bytes 0: still valid."""

    return _rows(files, file_id, text, lambda _, source: losses(source, per_file), "at long, deleted string, size long, error_bytes long")


def radius(error: Column, size: Column) -> Column:
    """Share of a file inside errors in tenths of a percent, halves up."""
    return F.floor(error * 1000 / F.greatest(size, F.lit(1)) + F.lit(0.5))


def shredded(broken: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Deletions that leave more than half of a file of some size inside errors."""
    return broken.where((F.col("error_bytes") * 2 > F.col("size")) & (F.col("size") >= min_bytes))


def by_token(lost: DataFrame, keep: int = 15) -> DataFrame:
    """deleted, n: the tokens whose loss did it, most frequent first."""
    return lost.groupBy("deleted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "deleted").limit(keep)


def worst(broken: DataFrame, keep: int = 10, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The deletions with the widest radius in files of some size."""
    some = broken.where(F.col("size") >= min_bytes).withColumn("radius", radius(F.col("error_bytes"), F.col("size")))
    return some.orderBy(F.desc("radius"), "file_id", "at").limit(keep)


def draws(seed: int) -> Iterator[int]:
    """Reproducible 64-bit numbers from a seed."""
    x = (seed | 1) & _MASK
    while True:
        x ^= x >> SHIFTS[0]
        x = (x ^ (x << SHIFTS[1])) & _MASK
        x ^= x >> SHIFTS[2]
        yield x * MULTIPLIER & _MASK


def edits(data: bytes, seed: int) -> list[tuple[int, int, bytes]]:
    """(start, end, inserted) of three edits: a deletion of up to 11 bytes, an inserted line, and a
    replacement by ``)``; none falls inside a character.  An empty text has none."""
    if not data:
        return []

    def whole(i: int) -> int:
        i = min(i, len(data))
        while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
            i -= 1
        return i

    drawn, out = draws(seed), []
    for inserted in (b"", b"x = 1\n", b")"):
        at = whole(next(drawn) % len(data))
        end = whole(at + min(next(drawn) % 12, len(data) - at))
        out.append((at, at if inserted.endswith(b"\n") else end, inserted))
    return out


def edited(files: DataFrame, file_id: str = "page_id", text: str = "html", seed: int = 7) -> DataFrame:
    """file_id, edit, at, text: each file after each of its three edits."""

    def each(key, source: str):
        data = source.encode()
        for n, (start, end, inserted) in enumerate(edits(data, seed ^ len(str(key)))):
            yield n, start, (data[:start] + inserted + data[end:]).decode()

    return _rows(files, file_id, text, each, "edit int, at long, text string")


def divergences(ours: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the first place (node) at which two renderings (keys, node_id, kind, start_byte,
    end_byte) of the same texts differ; equal ones have no row."""
    side = lambda d, x: d.select(*keys, "node_id", F.struct("kind", "start_byte", "end_byte").alias(x))
    j = side(ours, "a").join(side(fresh, "b"), [*keys, "node_id"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.groupBy(*keys).agg(F.min("node_id").alias("node"))


def widenings(judged: DataFrame, examples: int = 3) -> DataFrame:
    """signature, count, files and first origins of mutants (origin, label, accepted, valid) that we accept and the
    oracle doesn't; a missing verdict is an error, never a widening.

    The signature is the label's verb and the first 24 characters of the rest; most mutants first,
    then most files, then by signature.
    """
    verb, rest = F.substring_index("label", " ", 1), F.expr("substring(label, instr(label, ' ') + 1)")
    checked = F.when(F.col("valid").isNull(), F.raise_error(F.concat(F.lit("no verdict for a mutant of "), F.col("origin").cast("string")))).otherwise(~F.col("valid"))
    bad = judged.where("accepted").where(checked).withColumn("signature", F.concat(verb, F.lit(" "), F.substring(rest, 1, 24)))
    per = bad.groupBy("signature", "origin").agg(F.count("*").alias("n"))
    first = per.withColumn("_r", F.row_number().over(Window.partitionBy("signature").orderBy("origin"))).where(F.col("_r") <= examples)
    some = first.groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list("origin")), lambda x: x.cast("string")), ",").alias("origins"))
    g = per.groupBy("signature").agg(F.sum("n").alias("count"), F.count("*").alias("files"))
    return g.join(some, "signature").orderBy(F.desc("count"), F.desc("files"), "signature")
