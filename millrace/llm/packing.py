"""Best-fit packing with swap-based local search.

Documents become pieces of at most `room` tokens.  Pieces are dealt at random
to groups of about GROUP rows; a group is packed best-fit decreasing, and then
underfull bins exchange pieces: one moves, one goes for one, or two go for
one, whenever the squared fill of the two bins rises, until the emptier bins
are empty or nothing helps.  What lies in the loose bins of all groups is
packed once more together, so groups cost next to nothing.

Edge cases: a null or empty text is its end id alone; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_as_text, slices, stash, tidy
from .tokens import encoder

ROOM = 4096
END = 1
GROUP = 16_384
#: Bins with more than this part of their room left are packed once more, together.
SLACK = 64


def pieces(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = END, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of docs (doc_id, text)."""

    def work(batches):
        encode = encoder(name, False).flat
        for batch in slices(batches, "text"):
            ids, sizes = encode(batch.column("text").fill_null("").to_pylist())
            data, sizes = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes()), sizes + 1
            cut = -(-sizes // room)  # pieces of each document
            doc = np.repeat(np.arange(len(sizes)), cut)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
            length = np.minimum(room, sizes[doc] - piece * room)
            place = 4 * ((np.cumsum(sizes) - sizes)[doc] + piece * room)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(place.tolist(), (place + 4 * length).tolist())]
            longs = (pa.array(x, pa.int64()) for x in (piece, piece * room, length, crc))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *longs], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(work), "doc_id long, piece long, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of the indexes of lengths, longest first, each where the least room remains."""
    bins: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    rests = 0  # bit r is set if a bin with rest r is open
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rests >> n
        if fitting:
            rest = n + (fitting & -fitting).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                rests &= ~(1 << rest)
        else:
            b, rest = len(bins), room
            bins.append([])
        bins[b].append(i)
        if rest > n:
            by_rest.setdefault(rest - n, []).append(b)
            rests |= 1 << (rest - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """Local search over the underfull bins; ends at the lower bound, or when a round moves nothing.

    Every exchange raises the squared fill, so the search ends.
    """
    least = -(-sum(lengths) // room)
    full = [b for b in bins if sum(lengths[i] for i in b) == room]
    loose = [b for b in bins if sum(lengths[i] for i in b) < room]
    while len(full) + len(loose) > least:
        loose.sort(key=lambda b: sum(lengths[i] for i in b))
        moved = False
        # as many of the emptiest bins as are over the bound give their pieces to the fuller ones
        for at, low in enumerate(loose[: len(full) + len(loose) - least]):
            for high in reversed(loose[at + 1 :]):
                if not low:
                    break
                while low and _exchange(low, high, lengths, room):
                    moved = True
        loose = [b for b in loose if b]
        full += [b for b in loose if sum(lengths[i] for i in b) == room]
        loose = [b for b in loose if sum(lengths[i] for i in b) < room]
        if not moved:
            break
    return full + loose


def _exchange(low: list[int], high: list[int], lengths: list[int], room: int) -> bool:
    """The exchange that fills `high`, the fuller bin, most: a move, one for one, or two of low for one."""
    rest = room - sum(lengths[i] for i in high)
    if rest <= 0 or sum(lengths[i] for i in low) > room - rest:
        return False
    best: tuple[int, tuple, tuple] = (0, (), ())
    for i, a in enumerate(low):
        if best[0] < lengths[a] <= rest:
            best = (lengths[a], (a,), ())
        for b in high:
            if best[0] < lengths[a] - lengths[b] <= rest:
                best = (lengths[a] - lengths[b], (a,), (b,))
        for c in low[i + 1 :]:
            for b in high:
                if best[0] < lengths[a] + lengths[c] - lengths[b] <= rest:
                    best = (lengths[a] + lengths[c] - lengths[b], (a, c), (b,))
        if best[0] == rest:
            break
    gain, out, back = best
    if not gain:
        return False
    low[:] = [i for i in low if i not in out] + list(back)
    high[:] = [i for i in high if i not in back] + list(out)
    return True


def pack_group(frame: pd.DataFrame, room: int = ROOM) -> pd.DataFrame:
    """frame with sequence_id (group * 2^32 + bin), offset and fill of the bin."""
    frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = frame["length"].tolist()
    bins = improve(best_fit(lengths, room), lengths, room)
    sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
    for k, rows in enumerate(bins):
        own = np.array([lengths[i] for i in rows], np.int64)
        sequence[rows], offset[rows], fill[rows] = k, np.cumsum(own) - own, own.sum()
    return frame.assign(sequence_id=frame["group"].to_numpy(np.int64) * (1 << 32) + sequence, offset=offset, fill=fill)


def pack(rows: DataFrame, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """rows of pieces() with sequence_id and offset.

    Rows are numbered when they are written, and dealt to groups by number, so
    that equal rows spread over groups like any others.
    """
    names = rows.columns
    rows = stash(rows.withColumn("number", F.monotonically_increasing_id()), "pieces")
    longs = T.StructType([T.StructField(c, T.LongType()) for c in ("group", "sequence_id", "offset", "fill")])
    schema = T.StructType([*ids_as_text(rows).schema.fields, *longs.fields])

    def deal(df: DataFrame, first: int) -> tuple[DataFrame, int]:
        n = max(1, df.count() // group)
        dealt = ids_as_text(df.select(*names, "number", (F.pmod(F.xxhash64("number", F.lit(first)), F.lit(n)) + first).alias("group")))
        return dealt.groupBy("group").applyInPandas(lambda f: pack_group(f, room), schema).withColumn("doc_id", F.col("doc_id").cast("long")), first + n

    once, groups = deal(rows, 0)
    once = stash(once, "packed")
    loose = F.col("fill") < room - room // SLACK
    again, _ = deal(once.filter(loose), groups)
    done = once.filter(~loose).unionByName(again)
    return done.select(*names, "sequence_id", "offset")
