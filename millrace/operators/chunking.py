"""Documents to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_NUMBER = re.compile(r"\d{1,4}|[ivxlcdm]{1,8}", re.I)


def word_windows(docs: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, start, n_words, words) by built-in functions: windows of `size` words at a stride of size - overlap.

    The last window is the first that reaches the end of the text.
    """
    stride = size - overlap
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / stride).cast("int"))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    part = F.slice("w", F.col("chunk") * stride + 1, F.lit(size))
    return rows.select("doc_id", "chunk", (F.col("chunk") * stride).alias("start"), F.size(part).alias("n_words"), F.concat_ws(" ", part).alias("text"))


def pack_paragraphs(text: str | None, most: int = 350, overlap: int = 50) -> Iterator[list[str]]:
    """Chunks of words: paragraphs are packed up to `most` words, and a chunk starts with the last `overlap` words of the one before.  A paragraph is never cut."""
    held: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text or ""):
        words = paragraph.split()
        if words and held and len(held) + len(words) > most:
            yield held
            held = held[-overlap:] + words
        else:
            held = held + words
    if held:
        yield held


def paragraph_chunks(docs: DataFrame, most: int = 350, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_id, chunk, n_words, text); within rows, no shuffle."""

    def work(frames):
        for frame in frames:
            rows = [(doc, f"{doc}_c{i:04d}", i, len(w), " ".join(w)) for doc, text in zip(frame["doc_id"], frame["text"]) for i, w in enumerate(pack_paragraphs(text, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk", "n_words", "text"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, chunk_id string, chunk int, n_words int, text string")


def paragraphs_of(text: str) -> list[str]:
    """Non-blank paragraphs without bare page numbers; the whole text if nothing else is left."""
    kept = [p for x in re.split(r"\n\s*\n", text) if (p := x.strip()) and not PAGE_NUMBER.fullmatch(p)]
    return kept or ([text.strip()] if text.strip() else [])


def block_chunks(blocks: list[tuple[str, int]], least: int = 120, target: int = 600, most: int = 800) -> list[list[int]]:
    """Indexes of blocks (text, tokens) by chunk: filled to the target, never over `most` but by one block alone; a short tail joins or borrows."""
    size = lambda part: sum(blocks[i][1] for i in part)
    out, held = [], []
    for i in range(len(blocks)):
        if held and size(held) + blocks[i][1] > most:
            out.append(held)
            held = []
        held.append(i)
        if size(held) >= target:
            out.append(held)
            held = []
    if held:
        out.append(held)
    if len(out) > 1 and size(out[-1]) < least:
        before, tail = out[-2], out[-1]
        if size(before) + size(tail) <= most:
            out[-2:] = [before + tail]
        else:
            while size(tail) < least and len(before) > 1 and size(before[:-1]) >= least:
                tail.insert(0, before.pop())
    return out


def corpus_chunks(docs: DataFrame, least: int = 120, target: int = 600, most: int = 800, overlap: int = 80, drop_below: int = 40) -> DataFrame:
    """(doc_id, ordinal, n_tokens, text, text_sha256): block packing by words, long paragraphs cut into windows; short fragments go."""
    import hashlib

    def blocks(text: str) -> list[tuple[str, int]]:
        out = []
        for p in paragraphs_of(text):
            words = p.split()
            if len(words) <= most:
                out.append((p, len(words)))
            else:
                stride = most - overlap
                out += [(" ".join(words[a : a + most]), len(words[a : a + most])) for a in range(0, max(1, len(words) - overlap), stride)]
        return out

    def work(frames):
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                found = blocks(text or "")
                for n, part in enumerate(block_chunks(found, least, target, most), 1):
                    tokens = sum(found[i][1] for i in part)
                    if tokens >= drop_below:
                        body = "\n\n".join(found[i][0] for i in part)
                        rows.append((doc, n, tokens, body, hashlib.sha256(" ".join(body.split()).lower().encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "n_tokens", "text", "text_sha256"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, ordinal int, n_tokens int, text string, text_sha256 string")
