"""Quality classifier: an interpolated modified Kneser-Ney character model.

The model is of order ORDER over characters, one a language, trained on the
trusted documents (labelled good and not toxic) but for one in HELD, drawn by
hash, on which the upper limit is set: text that the model has seen scores
better than equally good text that it has not.

1. Each task cuts its documents into blocks of one language and stores a block
   as a row: the texts, compressed, and its distinct grams with their counts in
   trusted text.
2. The trusted counts are summed over all blocks by (language, gram).
3. The counts, sharded by language and the character before the last, meet the
   grams that the blocks ask for, sharded alike; the tasks estimate the shard's
   probabilities and answer each block.  Shards that many blocks ask are
   salted by block.
4. The answers join the blocks, which are bucketed and so stay where they are,
   and give each document's summed negative log probability.

A document's score is its mean negative log probability a character.
Documents whose score leaves the range between two quantiles of their
language, widened by a margin, are rejected: the lower one of all trusted
scores, the upper one of those held back.  Neither counts nor texts pass
through the driver; what does is a few numbers a language and at most
ALPHABET single characters a language.

Edge cases: null and empty texts have no score and are rejected; a language
without trusted text, or with none held back, keeps its other documents, with
a null threshold; a null language is one of its own, together with the empty
one; repeated rows are scored each; a doc_id with several labels is trusted if
all of them say so; a null doc_id is never trusted; an empty table gives an
empty result; columns beside doc_id, text and lang are carried by
kept_documents(), whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks as runs
from .common import checkpointed, ids_as_text, nested, shared_dir, stash, tidy, utf8
from .kneser_ney import ALPHABET, BITS, ORDER, counts_of_counts, discounts, grams, levels, logs

__all__ = ["ALPHABET", "BITS", "ORDER", "classify", "grams", "kept_documents"]

#: Characters of a block, and those that a task works on at once.
BLOCK, PART = 8_000_000, 1_000_000
#: Trusted ids up to which they are broadcast (64 MB of keys), so that texts stay where they are; beyond that a shuffle join.
TRUSTED = 4_000_000
#: Grams that a group of requests may hold.
ASKED = 8_000_000
#: Characters of average text that every score starts with, so that short texts don't stray.
PRIOR = 60
#: Quantiles of the trusted scores, their margin in nats, and the width of the bins that they are read from.
LOW, HIGH, MARGIN, BIN = 0.002, 0.99, 0.2, 0.001
#: One in so many trusted documents is held back from training.
HELD = 5

BLOCKS = "block long, lang string, ids array<string>, bodies array<long>, trusted binary, held binary, sizes binary, texts binary, grams binary, counts binary, n_grams long"


def packed(values: np.ndarray, level: int = 3) -> bytes:
    """An array of integers or floats as compressed byte planes."""
    return zstandard.ZstdCompressor(level).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def before_last(g: np.ndarray) -> np.ndarray:
    """The shard of each gram: its last character but one."""
    return g >> BITS & (ALPHABET - 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of (grams, weights) parts, ordered by shard, and their summed weights."""
    code, found = pd.factorize(np.concatenate([g for g, _ in parts]))
    n = np.bincount(code, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)
    order = np.lexsort((found, before_last(found)))
    return found[order], n[order]


def _blocks(docs: DataFrame) -> DataFrame:
    """The blocks of docs (doc_id, body, lang, text, trusted, held), written bucketed by block."""

    def row(lang: str, held: list[pd.DataFrame], number: int) -> pd.DataFrame:
        frame = pd.concat(held, ignore_index=True)
        parts = []
        for part in runs([frame], "text", PART):
            found, sizes = grams(part["text"].tolist())
            parts.append(_summed([(found, np.repeat((part["trusted"] & ~part["held"]).to_numpy(np.int64), sizes))]))
        g, n = _summed(parts)
        texts = [utf8(t) for t in frame["text"]]
        return pd.DataFrame({
            "block": [TaskContext.get().partitionId() << 32 | number], "lang": [lang], "ids": [frame["doc_id"].tolist()], "bodies": [frame["body"].to_numpy(np.int64)],
            "trusted": [frame["trusted"].to_numpy(bool).tobytes()], "held": [frame["held"].to_numpy(bool).tobytes()], "sizes": [packed(np.array([len(t) for t in texts], np.int64))],
            "texts": [zstandard.ZstdCompressor(9).compress(b"".join(texts))], "grams": [packed(g)], "counts": [packed(n)], "n_grams": [len(g)],
        })

    def work(frames):
        held: dict[str, list[pd.DataFrame]] = {}
        chars: dict[str, int] = {}
        number = 0
        for frame in runs(frames, "text", PART):
            frame = frame.assign(text=frame["text"].fillna(""))
            for lang, part in frame.groupby("lang", sort=False):
                held.setdefault(lang, []).append(part)
                chars[lang] = chars.get(lang, 0) + int(part["text"].str.len().sum())
                if chars[lang] >= BLOCK:
                    yield row(lang, held.pop(lang), number)
                    number += 1
                    del chars[lang]
        for lang, parts in held.items():
            yield row(lang, parts, number)
            number += 1

    session, name = docs.sparkSession, f"quality_blocks_{uuid.uuid4().hex}"
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    ids_as_text(docs).mapInPandas(tidy(work), BLOCKS).write.bucketBy(parts, "block").option("path", f"{shared_dir(session)}/{name}").saveAsTable(name)
    return session.table(name)


def _trusted_counts(blocks: DataFrame) -> DataFrame:
    """(lang, g, n) of every gram of trusted text."""

    def work(frames):
        for frame in frames:
            for lang, g, n in zip(frame["lang"], frame["grams"], frame["counts"]):
                g, n = unpacked(g, np.int64), unpacked(n, np.int64)
                yield pd.DataFrame({"lang": lang, "g": g[n > 0], "n": n[n > 0]})

    return blocks.select("lang", "grams", "counts").mapInPandas(tidy(work), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _statistics(known: DataFrame) -> tuple[dict, dict]:
    """(single characters and their counts by language, discounts by language and order): sums over the shards of known."""

    def work(key, frame):
        out = []
        for k, (g, n) in levels(frame["g"].to_numpy(), frame["n"].to_numpy(), 2).items():
            out.append(pd.DataFrame({"k": k, "g": [1, 2, 3, 4], "n": counts_of_counts(n)}))
            if k == 2:  # a character's count is the number of characters before it
                out.append(pd.DataFrame({"k": 1, "g": g & (ALPHABET - 1), "n": 1}))
        return pd.concat(out, ignore_index=True).assign(lang=key[0])[["lang", "k", "g", "n"]]

    found = known.groupBy("lang", "d").applyInPandas(work, "lang string, k int, g long, n long").groupBy("lang", "k", "g").agg(F.sum("n").alias("n"))
    singles: dict = {}
    cuts: dict = {}
    for (lang, k), part in found.toPandas().groupby(["lang", "k"]):
        part = part.sort_values("g")
        if k == 1:
            singles[lang] = part["g"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
            cuts.setdefault(lang, {})[1] = discounts(counts_of_counts(singles[lang][1]))
        else:
            cuts.setdefault(lang, {})[int(k)] = discounts(part["n"].to_numpy())
    return singles, cuts


def answers(blocks: DataFrame, known: DataFrame, asked: int = ASKED) -> DataFrame:
    """(block, d, logs): for every block and shard the log probabilities of the block's grams of the shard, in their order, under known (lang, d, g, n)."""

    def requests(frames):
        for frame in frames:
            for block, lang, g in zip(frame["block"], frame["lang"], frame["grams"]):
                g = unpacked(g, np.int64)
                shard = before_last(g)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                yield pd.DataFrame({"block": block, "lang": lang, "d": shard[cuts], "m": np.diff(cuts, append=len(g)), "grams": [packed(x, 1) for x in np.split(g, cuts[1:])] if len(g) else []})

    def answer(key, left, right):
        lang = key[0]
        if not len(left):
            return pd.DataFrame({"block": [], "d": [], "logs": []})
        parts = [unpacked(g, np.int64) for g in left["grams"]]
        found = logs(np.concatenate(parts), right["g"].to_numpy(np.int64), right["n"].to_numpy(np.int64), singles[lang], cuts[lang]).astype(np.float32)
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"block": left["block"].to_numpy(), "d": left["d"].to_numpy(), "logs": [packed(x, 1) for x in np.split(found, ends[:-1])]})

    singles, cuts = _statistics(known)
    wanted = blocks.filter(F.col("lang").isin(*singles) if singles else F.lit(False)).select("block", "lang", "grams").mapInPandas(tidy(requests), "block long, lang string, d long, m long, grams binary")
    wanted = stash(wanted, "requests")
    # a row a language and character
    salts = wanted.groupBy("lang", "d").agg(F.greatest(F.ceil(F.sum("m") / asked), F.lit(1)).alias("salts"))
    wanted = wanted.join(F.broadcast(salts), ["lang", "d"]).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
    dealt = known.join(F.broadcast(salts), ["lang", "d"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    keys = ["lang", "d", "salt"]
    wanted, dealt = wanted.select(*keys, "block", "grams"), dealt.select(*keys, "g", "n")
    return wanted.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(answer, "block long, d long, logs binary")


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, body, lang, trusted, held, chars, nll) of docs (doc_id, body, lang, text, trusted, held); null nll where the text is empty or the language has no model."""

    def work(left, right):
        out = []
        for lang, ids, bodies, trusted, held, sizes, texts, known in zip(*(left[c] for c in ("lang", "ids", "bodies", "trusted", "held", "sizes", "texts", "grams"))):
            ends = np.cumsum(unpacked(sizes, np.int64))
            data = zstandard.ZstdDecompressor().decompress(texts)
            frame = pd.DataFrame({"text": [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]})
            known = unpacked(known, np.int64)
            order = np.argsort(known)
            value = np.concatenate([unpacked(x, np.float32) for x in right.sort_values("d")["logs"]])[order] if len(right) else None
            known, chars, nll = known[order], [], []
            for part in runs([frame], "text", PART):
                found, n = grams(part["text"].tolist())
                chars.append(n)
                if value is not None:
                    code, distinct = pd.factorize(found)
                    total = np.concatenate(([0.0], np.cumsum(-value[np.searchsorted(known, distinct)].astype(np.float64)[code])))
                    upto = np.cumsum(n)
                    nll.append(np.where(n > 0, total[upto] - total[upto - n], np.nan))
            out.append(pd.DataFrame({
                "doc_id": ids, "body": np.asarray(bodies), "lang": lang, "trusted": np.frombuffer(trusted, bool), "held": np.frombuffer(held, bool),
                "chars": np.concatenate(chars), "nll": pd.Series(np.concatenate(nll) if nll else np.full(len(ids), np.nan)).astype("Float64"),
            }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("doc_id", "body", "lang", "trusted", "held", "chars", "nll")})

    blocks = _blocks(docs)
    known = stash(_trusted_counts(blocks).withColumn("d", F.shiftright("g", BITS).bitwiseAND(F.lit(ALPHABET - 1))), "trusted-counts")
    found = answers(blocks, known)
    schema = "doc_id string, body long, lang string, trusted boolean, held boolean, chars long, nll double"
    return blocks.drop("counts", "n_grams").groupBy("block").cogroup(found.groupBy("block")).applyInPandas(work, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0 and doc_id is not null").select("doc_id")


def _body(text: str, lang: str):
    """Names a text in its language; rows meet on it together with their doc_id."""
    return F.xxhash64(text, F.coalesce(F.col(lang), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """(doc_id, body, lang, trusted, chars, perplexity, low, high, keep) of every row of docs; low and high are perplexities."""
    ids = checkpointed(trusted_ids(labels)).select("doc_id", F.lit(True).alias("trusted"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0).alias("held"))
    if ids.count() <= TRUSTED:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", _body("text", "lang").alias("body"), F.coalesce("lang", F.lit("")).alias("lang"), "text").join(ids, "doc_id", "left")
    rows = rows.select("doc_id", "body", "lang", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("held", F.lit(False)).alias("held"))
    return judged(scores(rows), low, high, margin, prior)


def judged(scored: DataFrame, low: float, high: float, margin: float, prior: int) -> DataFrame:
    light = stash(scored, "scores")
    mean = light.filter("trusted").groupBy("lang").agg((F.sum("nll") / F.sum("chars")).alias("mean"))
    # both small tables have a row a language
    light = light.join(F.broadcast(mean), "lang", "left").withColumn("score", (F.col("nll") + prior * F.col("mean")) / (F.col("chars") + prior))
    score = F.floor(F.col("score") / BIN)
    bins = light.filter("trusted and chars > 0").groupBy("lang", score.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("n_held"))
    rising, whole = W.partitionBy("lang").orderBy("bin"), W.partitionBy("lang")
    share = bins.select("lang", "bin", *[F.try_divide(F.sum(n).over(rising), F.sum(n).over(whole)).alias(a) for n, a in (("n", "all_upto"), ("n_held", "held_upto"))])
    limits = share.groupBy("lang").agg(
        (F.min(F.when(F.col("all_upto") >= low, F.col("bin"))) * BIN - margin).alias("least"),
        ((F.min(F.when(F.col("held_upto") >= high, F.col("bin"))) + 1) * BIN + margin).alias("most"),
    )
    light = light.join(F.broadcast(limits), "lang", "left")
    keep = (F.col("chars") > 0) & F.coalesce(F.col("score").between(F.col("least"), F.col("most")), F.lit(True))
    return light.select("doc_id", "body", "lang", "trusted", "chars", F.exp("score").alias("perplexity"), F.exp("least").alias("low"), F.exp("most").alias("high"), keep.alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    gone = classify(docs, labels, **how).filter("not keep").select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")).distinct()
    rows = nested(docs)
    match = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (_body("row.text", "row.lang") == F.col("gone_body"))
    return rows.join(gone, match, "left_anti").select("row.*")
