"""Best-fit packing of documents into fixed-length token sequences by bin completion.

Only the lengths of pieces matter to a packing, and there are at most ``capacity`` of
them, so the search runs over counts by length: a table whose size does not grow with
the corpus. It gives patterns (which lengths go together, and how often), and Spark
hands the pieces out to them by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches, table, word_bpe_path, written
from scriptorium.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank_in_part long"


def _largest_up_to(counts: np.ndarray) -> np.ndarray:
    """For each room, the largest length left that fits (0: none)."""
    lengths = np.arange(len(counts))
    return np.maximum.accumulate(np.where(counts > 0, lengths, 0))


def _dominated(filling: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether filling's items can be dealt to other's items as bins, so that other is never worse."""
    room = list(other)
    for item in sorted(filling, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= item]
        if not fits:
            return False
        room[min(fits, key=lambda i: room[i])] -= item
    return True


def best_fits(counts: np.ndarray, room: int, many: int = 6) -> list[tuple[int, ...]]:
    """A few fillings of ``room`` to descend by, least waste first: the exact single and pairs, or else best fit behind each of the best pairs."""
    fit = _largest_up_to(counts)
    if not fit[room]:
        return [()]

    def complete(start: tuple[int, ...]) -> tuple[int, ...]:
        used: dict[int, int] = defaultdict(int)
        for x in start:
            used[x] += 1
        out, left = list(start), room - sum(start)
        while left > 0 and (x := int(fit[left])):
            while x and counts[x] - used[x] <= 0:
                x = int(fit[x - 1])
            if not x:
                break
            out.append(x)
            used[x] += 1
            left -= x
        return tuple(sorted(out, reverse=True))

    first = np.flatnonzero(counts[: room + 1])
    second = fit[np.minimum(room - first, first)]
    second = np.where((second == first) & (counts[first] < 2), fit[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    two = [(int(first[i]), int(second[i])) for i in np.argsort(-total, kind="stable")[:many] if second[i]]
    exact = [(room,)] * bool(counts[room]) + [p for p in two if sum(p) == room]
    found = exact or {complete(())} | {complete(p) for p in two}
    return sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))[:many]


def maximal_fillings(counts: np.ndarray, room: int, spend) -> Iterator[tuple[int, ...]]:
    """Every filling of ``room`` that no length left could be added to, the larger lengths first.

    ``spend`` is called at each step and ends the enumeration when it gives False.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    many = [int(counts[x]) for x in lengths]
    behind = np.cumsum([x * n for x, n in zip(lengths, many, strict=True)][::-1])[::-1].tolist() + [0]

    def further(at: int, left: int, chosen: tuple[int, ...], skipped: int) -> Iterator[tuple[int, ...]]:
        """``skipped``: the least length that more of could have been taken; what is left at the end must be less."""
        while left - behind[at] < skipped and spend():
            while at < len(lengths) and lengths[at] > left:
                at += 1
            if at == len(lengths):
                if left < skipped:
                    yield chosen
                return
            x, most = lengths[at], min(many[at], left // lengths[at])
            for k in range(most, 0, -1):
                yield from further(at + 1, left - k * x, chosen + (x,) * k, min(skipped, x) if k < many[at] else skipped)
            at, skipped = at + 1, min(skipped, x)  # none of it

    yield from further(0, room, (), room + 1)


def fillings(counts: np.ndarray, room: int, spend) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths left: first a few best fits, then all others, about by waste."""
    given: list[tuple[int, ...]] = []
    rest = maximal_fillings(counts, room, spend)
    block = best_fits(counts, room)
    while block:
        for f in block:
            # a comparison takes about as long as so many steps
            if f not in given and not any(_dominated(f, g) for g in given if spend(1 + len(f) * len(g) // 8)):
                given.append(f)
                yield f
        block = sorted(islice(rest, 256), key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for tokens, and for lengths of which no two share one, with what they leave no room for."""
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.arange(len(counts))
    best = -(-int((lengths * counts).sum()) // capacity)
    for small in np.unique(np.append(np.flatnonzero(counts[: capacity // 2 + 1]), 0)).tolist():
        alone = int(counts[capacity - small + 1 :].sum())
        middle = lengths > capacity // 2
        middle[capacity - small + 1 :] = False
        some = (lengths >= max(small, 1)) & (lengths <= capacity // 2)
        room = int((counts * (capacity - lengths))[middle].sum())
        best = max(best, alone + int(counts[middle].sum()) + max(0, -(-(int((counts * lengths)[some].sum()) - room) // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 5_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences take each, covering ``counts`` exactly.

    Depth first: the largest length left opens a sequence, and its undominated fillings are
    tried, each as often as the counts allow and once. A branch ends when the waste so far
    leaves no chance of beating the incumbent; the first descent (best fit throughout) is
    the first incumbent. The search stops at :func:`lower_bound`, or when all is tried, or
    after ``nodes`` patterns beyond the first descent, or forty steps of enumeration for
    each of them; then the packing may be short of the best by what :func:`gap` says at most.
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    total = int((np.arange(len(counts)) * counts).sum())
    if not total:
        return []
    lower = lower_bound(counts, capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins, spent, steps = None, 0, 0

    def spend(many: int = 1) -> bool:
        nonlocal steps
        steps += many
        return steps <= 40 * nodes

    def options(left: np.ndarray, large: int) -> Iterator[tuple[tuple[int, ...], int]]:
        inner = left.copy()
        inner[large] -= 1
        for f in fillings(inner, capacity - large, spend):
            filling = (large, *f)
            lengths, need = np.unique(filling, return_counts=True)
            times = int((left[lengths] // need).min())
            yield filling, times
            if times > 1:
                yield filling, 1

    # one frame: counts before it, what is not tried yet, waste and bins before it
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[tuple[np.ndarray, Iterator, int, int]] = [(counts, options(counts, int(np.flatnonzero(counts)[-1])), 0, 0)]
    while stack:
        left, untried, waste, bins = stack[-1]
        step = None if best is not None and (spent > nodes or steps > 40 * nodes) else next(untried, None)
        if step is None:
            stack.pop()
            if path:
                path.pop()
            continue
        filling, times = step
        new_waste = waste + times * (capacity - sum(filling))
        if best_bins is not None:
            spent += 1
            if new_waste > (best_bins - 1) * capacity - total:
                continue
        lengths, need = np.unique(filling, return_counts=True)
        rest = left.copy()
        rest[lengths] -= need * times
        path.append((filling, times))
        if rest.any():
            stack.append((rest, options(rest, int(np.flatnonzero(rest)[-1])), new_waste, bins + times))
            continue
        if best_bins is None or bins + times < best_bins:
            best, best_bins = list(path), bins + times
        path.pop()
        if best_bins == lower:
            break
    return best


def gap(patterns: list[tuple[tuple[int, ...], int]], counts: np.ndarray, capacity: int) -> tuple[int, int]:
    """(sequences of a packing, sequences that any packing needs)."""
    return sum(t for _, t in patterns), lower_bound(counts, capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token counts of whole texts, cut into pieces only where longer than ``capacity``.

    Each task also numbers its pieces of each length, so that ranks need no sort later.
    """

    def cut(batches):
        enc, end, part = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                columns = [[] for _ in names]
                for doc, ids in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[a : a + 4 * capacity]
                        n = len(one) // 4
                        for column, value in zip(columns, (doc, k, a // 4, n, zlib.crc32(one), part, seen[n]), strict=True):
                            column.append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()], strict=True)))
    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a sequence, offset), by first rank."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            out[length].append((taken[length], sequence, copies, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, nodes: int = 5_000) -> DataFrame:
    """Place every document in sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Pieces of a sequence lie behind each other from 0 on. A null text counts as
    empty and holds ``end_id`` alone; a null doc_id stays null; equal rows are packed
    each; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_part = cut.groupBy("part", "length").count()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    where = spark.sparkContext.broadcast(slots(bin_completion(counts, capacity, nodes)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_part")).alias("rank"))

    def place(frames):
        for pdf in frames:
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                rows = where.value[int(one)]
                hit = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                inside = rank[mine] - hit[:, 0]
                sequence[mine] = hit[:, 1] + inside // hit[:, 2]
                offset[mine] = hit[:, 3] + inside % hit[:, 2] * one
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe_path())
