"""Media columns: texts as lossless WebP images, read back to pixel arrays.

A payload is a text's UTF-8 bytes, zero-padded to a positive multiple of 64;
four bytes make a pixel.  An image holds up to 2^28 pixels; where the payload
doesn't fill its rectangle the rest is zero pixels, and payload_bytes says
where it ends.  Work stays within the row: no shuffle.

Edge cases: null and empty texts give 64 zero bytes; repeated rows are stored
each; an empty table gives an empty result; other columns go through
with_media() unchanged and aren't read by read_media().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, map_batches, utf8
from .webp import decode_batch, encode_batch

UNIT = 64


def payload(text) -> bytes:
    data = utf8(text)
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def with_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, payload_bytes and media, the file of the text's payload, in place of columns of these names."""

    def work(frames):
        for frame in blocks(frames, "text", 2_000_000):
            sizes = [len(utf8(t)) for t in frame["text"]]
            data = [payload(t) for t in frame["text"]]
            yield frame.assign(n_bytes=sizes, payload_bytes=[len(d) for d in data], media=encode_batch(data))

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    docs = docs.drop(*[f.name for f in fields])
    longs = tuple(f.name for f in docs.schema if isinstance(f.dataType, T.LongType))
    return map_batches(docs, work, T.StructType([*docs.schema.fields, *fields]), longs)


def feature(pixels: np.ndarray) -> str:
    """Size, mean and deviation a channel, and a 64-bit average hash over 64 runs of samples."""
    flat = pixels.reshape(-1, 4).astype(np.float64)
    runs = np.array([x.mean() if len(x) else 0.0 for x in np.array_split(pixels.ravel(), 64)])
    mark = int("".join("1" if x else "0" for x in runs > runs.mean()), 2)
    numbers = ",".join(f"{m:.3f}/{s:.3f}" for m, s in zip(flat.mean(axis=0), flat.std(axis=0)))
    return f"{pixels.shape[1]}x{pixels.shape[0]} {numbers} {mark:016x}"


def read_media(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of rows of with_media()."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def work(frames):
        for frame in frames:
            at = 0
            while at < len(frame):  # as many files at once as hold about 6 MB
                upto = at + max(1, int(np.searchsorted(np.cumsum(frame["payload_bytes"].to_numpy()[at:]), 6_000_000)))
                part = frame.iloc[at:upto]
                at = upto
                out = []
                for doc, n, size, media, pixels in zip(part["doc_id"], part["n_bytes"], part["payload_bytes"], part["media"], decode_batch(list(part["media"]))):
                    back = pixels.tobytes()[:size]
                    out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
                yield pd.DataFrame(out, columns=schema.replace(",", "").split()[::2])

    return map_batches(rows.select("doc_id", "n_bytes", "payload_bytes", "media"), work, schema)
