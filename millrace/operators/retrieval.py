"""BM25 and dense retrieval over tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from .shared import checkpointed
from .sparse import CELLS, Columns, pieces, rounded, runs


#: Left rows that nearest_by_ngrams holds in tasks, their grams together, and grams whose idf is broadcast.
FEW, HELD, GRAMS = 1_024, 2_000_000, 500_000
#: Terms of queries, counted for each query, up to which bm25 picks them out of each text as it is read.
PICKED = 1_000_000


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf); terms are counted map-side."""
    flat = docs.select("doc_id", F.explode(X.terms(F.col("text"))).alias("term"))
    return flat.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.size(X.terms(F.col("text"))), F.lit(0)).alias("len"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df); where no doc_id is repeated, terms are counted map-side and no posting is shuffled."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        posts = docs.select(F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    else:
        posts = postings(docs)
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(posts: DataFrame, lengths: DataFrame) -> DataFrame:
    """weights() of all postings (term, doc_id, tf)."""
    return weights(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), lengths)


def weights(frequencies: DataFrame, lengths: DataFrame) -> DataFrame:
    """(term, df, idf): ln(N - df + 0.5) - ln(df + 0.5); negative values become epsilon times the mean idf of all terms."""
    n = lengths.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    raw = frequencies.join(F.broadcast(n))  # one row
    raw = raw.select("term", "df", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, V.EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, alike: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query (query_id, text); ties go to the smaller doc_id, scores above 0 only.

    Only postings of the queries' own terms are made; a term in a third of all
    documents is a join key that Spark may split.  alike is for many queries
    over short texts that repeat their frequent terms, see _by_classes().
    """
    asked = queries.select("query_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    if not alike and (few := _few_terms(asked)) is not None and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _best(_in_one_pass(docs, few, k), k)
    lengths, counts = checkpointed(document_lengths(docs)), checkpointed(frequencies(docs))
    own = checkpointed(weights(counts, lengths).join(asked.select("term").distinct(), "term", "left_semi"))
    if own.count() <= GRAMS:
        own = F.broadcast(own)
    mean = lengths.agg(F.avg("len").alias("avgdl"))  # one row
    flat = docs.select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).join(own, "term").groupBy("term", "doc_id", "df", "idf").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("idf") * (F.col("tf") * (V.K1 + 1)) / (F.col("tf") + V.K1 * (1 - V.B + V.B * F.col("len") / F.col("avgdl")))
    rows = flat.join(lengths, "doc_id").join(F.broadcast(mean)).select("doc_id", "term", "df", "tf", "len", part.alias("part"))
    n = lengths.count() if alike else 0
    if n > 100 and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _best(_by_classes(checkpointed(rows), asked, k, math.isqrt(n)), k)
    # the sum's order isn't fixed, so it is rounded before it decides ranks
    return _best(rows.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("qf")), 6).alias("score")), k)


def _few_terms(asked: DataFrame) -> pa.Table | None:
    """asked (query_id, term, qf), or None if it is more than PICKED rows."""
    found = asked.limit(max(0, PICKED + 1)).toArrow()
    return found if len(found) <= PICKED else None


def _in_one_pass(docs: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(query_id, doc_id, score) with the k best docs of each query among them, for asked (query_id, term, qf); ids of docs differ.

    One pass over the texts gives lengths and the counts of the queries' terms,
    which stay with their document; the mean idf of all terms takes a second
    one, only if a term is in over half of the documents, as no other has use
    for it.  Tasks hold the queries as columns, score their documents a chunk
    at a time and give the k best of each query.
    """
    term, query = (asked.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "query_id"))
    known, labels = term.dictionary, query.dictionary

    def count(batches):
        for batch in batches:
            lists = batch.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            keys = np.repeat(np.arange(len(sizes)), sizes)[found >= 0] * max(1, len(known)) + found[found >= 0]
            keys, tf = np.unique(keys, return_counts=True)
            row, term = np.divmod(keys, max(1, len(known)))
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            held = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *held], ["doc_id", "len", "terms", "tf"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", X.terms(F.col("text")).alias("terms")).mapInArrow(count, f"doc_id {doc_id}, len long, terms array<int>, tf array<int>")
    counted = checkpointed(counted)
    n, mean = counted.agg(F.count(F.lit(1)), F.avg("len")).first()
    df = np.zeros(len(known))
    for r in counted.select(F.explode("terms").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r.i] = r.df
    idf = np.log(n - df + 0.5) - np.log(df + 0.5)
    if (df > n / 2).any():
        mean_idf = frequencies(docs).agg(F.avg(F.ln(F.lit(n + 0.5) - F.col("df")) - F.ln(F.col("df") + 0.5))).first()[0]
        idf = np.where(idf < 0, V.EPSILON * mean_idf, idf)
    queries = Columns(term.indices.to_numpy(), query.indices.to_numpy(), asked.column("qf").to_numpy().astype(float), len(known), len(labels))

    def best(batches):
        # the k best so far, as (column, doc_id, score), and what a score must reach
        kept, floor = (np.empty(0, np.int64), None, np.empty(0)), np.zeros(len(labels))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tf"))
            counts, size = (c.to_numpy(zero_copy_only=False) for c in (pc.list_value_length(batch.column("terms")), batch.column("len")))
            part = idf[term] * (tf * (V.K1 + 1)) / (tf + V.K1 * (1 - V.B + V.B * np.repeat(size, counts) / (mean or 1.0)))
            for at, first, scores in queries.products(counts, term, part):
                scores = rounded(scores)
                bar = floor[first : first + scores.shape[1]]
                if len(scores) > k:
                    bar = np.maximum(bar, np.partition(scores, -k, axis=0)[-k])
                row, col = np.nonzero((scores >= bar) & (scores > 0))
                if not len(row):
                    continue
                own = ids[at + row]
                column, doc, score = np.concatenate([kept[0], first + col]), own if kept[1] is None else np.concatenate([kept[1], own]), np.concatenate([kept[2], scores[row, col]])
                order = np.lexsort((np.unique(doc, return_inverse=True)[1], -score, column))
                column, doc, score = column[order], doc[order], score[order]
                place = np.arange(len(column)) - np.searchsorted(column, column)
                floor[column[place == k - 1]] = score[place == k - 1]
                kept = column[place < k], doc[place < k], score[place < k]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], batch.schema.field("doc_id").type), pa.array(kept[2], pa.float64())], ["column", "doc_id", "score"])

    found = counted.filter("doc_id is not null").mapInArrow(best, f"column long, doc_id {doc_id}, score double")
    names = docs.sparkSession.createDataFrame(pa.table({"column": pa.array(range(len(labels)), pa.int64()), "query_id": labels}))
    return found.join(F.broadcast(names), "column").select("query_id", "doc_id", "score")


def _by_classes(rows: DataFrame, asked: DataFrame, k: int, most: int) -> DataFrame:
    """(query_id, doc_id, score) with the k best of each query among them, from rows (doc_id, term, df, tf, len, part).

    Documents that share a query's term held by up to `most` documents are
    scored one by one.  All others get their score from more frequent terms
    only: those of equal length and equal counts of these make a class, scored
    once, whose k smallest ids stand for it.  If some of the k are scored one
    by one too, they come no later by that, so nothing beyond the k is missed.
    """
    total = F.round(F.sum(F.col("part") * F.col("qf")), 6).alias("score")
    near = rows.filter(F.col("df") <= most).join(asked, "term").select("query_id", "doc_id").distinct()
    single = near.join(rows, "doc_id").join(asked, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(total)
    held = rows.filter(F.col("df") > most).groupBy("doc_id", "len").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "part"))).alias("held"))
    held = held.withColumn("key", F.transform("held", lambda p: F.struct(p["term"], p["tf"])))
    of_class = W.partitionBy("len", "key").orderBy("doc_id")
    firsts = held.withColumn("place", F.row_number().over(of_class)).filter(F.col("place") <= k)
    firsts = checkpointed(firsts.withColumn("class", F.min("doc_id").over(W.partitionBy("len", "key"))).select("class", "doc_id", F.when(F.col("place") == 1, F.col("held")).alias("held")))
    scored = firsts.select("class", F.inline("held")).join(asked, "term").groupBy("query_id", "class").agg(total)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "class")
    scored = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return single.unionByName(scored.join(firsts, "class").select("query_id", "doc_id", "score")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def boosted(hits: DataFrame, names: DataFrame, queries: DataFrame, distinctive: DataFrame, k: int = 5, keep: str | None = None) -> DataFrame:
    """Re-rank hits (query_id, doc_id, score): times SOURCE_BOOST where a distinctive query term is in the document's name; then an optional filter by name."""
    asked = queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term")).join(distinctive.select("term"), "term", "left_semi")
    named = names.select("doc_id", "name", F.explode_outer(F.array_distinct(X.terms(F.col("name")))).alias("term"))
    matched = hits.select("query_id", "doc_id").join(named, "doc_id").join(asked, ["query_id", "term"], "left_semi").select("query_id", "doc_id").distinct().withColumn("hit", F.lit(V.SOURCE_BOOST))
    rows = hits.join(matched, ["query_id", "doc_id"], "left").join(names, "doc_id", "left").withColumn("score", F.round(F.col("score") * F.coalesce("hit", F.lit(1.0)), 3))
    if keep:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(keep.lower())))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "name", "score")


def distinctive_terms(names: DataFrame) -> DataFrame:
    """(term, files) of the words of names that few files share: at most max(2, 2 %), over two letters, no number, not generic."""
    files = names.select("name").distinct()
    n = files.agg(F.count(F.lit(1)).alias("n"))
    words = files.select("name", F.explode(F.array_distinct(X.terms(F.col("name")))).alias("term"))
    words = words.filter((F.length("term") > 2) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*V.GENERIC_SOURCE_WORDS))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("files"))
    return counts.join(F.broadcast(n)).filter(F.col("files") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.02))).select("term", "files")  # n is one row


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tile: int = 16_384, batch: int = 4_096, together: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) by inner product of unit vectors, rounded to 6 places; ties go to the larger id.

    The stated query set meets all rows in blocks: tiles of rows by batches of
    queries, of which `together` are scored at once (32 MB of scores); a tile
    gives each query's k best, so what is shuffled on is k rows a query and
    tile.  Vectors that are null, empty, of zero length or hold null or
    non-finite components take no part.
    """

    def unit(column: pd.Series) -> np.ndarray:
        rows = np.stack(column.to_numpy()).astype(np.float64)
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))

    def best(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, asked, ids, names = unit(left["embedding"]), unit(right["embedding"]), left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        parts = []
        for start in range(0, len(asked), together):
            scores = asked[start : start + together] @ rows.T
            scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores) / 1e6 + 0.0
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            row, col = np.nonzero(scores >= least[:, None])
            order = np.lexsort((-ids[col], -scores[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            parts.append(pd.DataFrame({"query_id": names[start + row], "vec_id": ids[col], "score": scores[row, col]})[rank < k])
        return pd.concat(parts)

    tiles, batches = (max(1, -(-df.count() // most)) for df, most in ((vectors, tile), (queries, batch)))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    sound = lambda df: df.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    vectors, queries = sound(vectors), sound(queries)
    rows = vectors.select("vec_id", "embedding", F.size("embedding").alias("dim"), part(tiles, 1).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"), part(batches, 2).alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    keys = ["tile", "batch", "dim"]
    scored = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (.., words) in slices of about CELLS / 4 words."""
    for batch in batches:
        for a, b in pieces(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False) + 1, CELLS // 4):
            yield batch.slice(a, b - a)


def _grams_of(words: pa.ListArray, sizes: tuple[int, ...]) -> tuple[pa.Array, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The distinct n-grams of rows of words, each between blanks, and chunks (first row, entries of each row, gram, tf) with each gram of a row once."""
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    # each distinct word is cut once
    padded = [f" {w} " for w in coded.dictionary.to_pylist()]
    cut = [[w[i : i + n] for n in sizes for i in range(len(w) - n + 1)] for w in padded]
    parts = np.fromiter(map(len, cut), np.int64, len(cut))
    grams = pa.array([g for c in cut for g in c], pa.string()).dictionary_encode()
    gram, start, word, many = grams.indices.to_numpy(), np.cumsum(parts) - parts, coded.indices.to_numpy(), len(grams.dictionary)
    ends = np.cumsum(counts)

    def chunks():
        made = np.concatenate([[0], np.cumsum(parts[word])])
        for a, b in pieces(made[ends] - made[ends - counts] + 1, CELLS):
            own = word[ends[a] - counts[a] : ends[b - 1]]
            row = np.repeat(np.repeat(np.arange(b - a), counts[a:b]), parts[own])
            keys, tf = np.unique(row * max(1, many) + gram[runs(start[own], parts[own])], return_counts=True)
            row, found = np.divmod(keys, max(1, many))
            yield a, np.bincount(row, minlength=b - a), found, tf

    return grams.dictionary, chunks()


def _rows_of_words(rows: DataFrame, key: str) -> DataFrame:
    """(key, words) with one row a key; dealt by it."""
    words = rows.select(key, "text").repartition(F.col(key)).select(key, F.regexp_extract_all(X.similarity_text(F.col("text")), F.lit(r"(\S+)")).alias("words"))
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        words = words.groupBy(key).agg(F.flatten(F.collect_list("words")).alias("words"))
    return words


def _gram_counts(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(g, df) of rows (words), in part sums."""

    def work(batches):
        for batch in _slices(batches):
            names, chunks = _grams_of(batch.column("words"), sizes)
            df = np.zeros(len(names), np.int64)
            for _, _, found, _ in chunks:
                df += np.bincount(found, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(df)], ["g", "df"])

    return rows.select("words").mapInArrow(work, "g string, df long")


def _nearest_of_held(left: DataFrame, right: DataFrame, idf: pa.Table, once: float, threshold: float, sizes: tuple[int, ...]) -> DataFrame | None:
    """nearest_by_ngrams() of left (left_id, words) and right (right_id, words), where tasks hold all of left and idf (g, idf); other grams have the idf `once`.  None if left has more than HELD grams."""
    known, weight, id_type = idf.column("g").combine_chunks(), np.append(idf.column("idf").to_numpy(), once), left.schema["left_id"].dataType.simpleString()

    def weighed(batch):
        """Chunks (first row, entries of each row, place in idf or -1, weight) with weights of unit length."""
        names, chunks = _grams_of(batch.column("words"), sizes)
        place = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, counts, found, tf in chunks:
            row, value = np.repeat(np.arange(len(counts)), counts), tf * weight[place[found]]
            norm = np.sqrt(np.bincount(row, value * value, len(counts)))
            yield at, counts, place[found], value / norm[row]

    def unit(batches):
        for batch in _slices(batches):
            ids = batch.column("left_id").to_numpy(zero_copy_only=False)
            for at, counts, place, value in weighed(batch):
                mine = place >= 0  # the others are in no other row
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(ids[at : at + len(counts)], counts)[mine], place[mine], value[mine])], ["id", "place", "w"])

    held = left.filter("left_id is not null").mapInArrow(unit, f"id {id_type}, place long, w double").limit(HELD + 1).toArrow()
    if len(held) > HELD:
        return None
    # columns in the order of ids: the first of equal ones is the smallest id
    kind, (ids, column) = held.schema.field("id").type, np.unique(held.column("id").to_numpy(), return_inverse=True)
    columns = Columns(held.column("place").to_numpy(), column, held.column("w").to_numpy(), len(known), len(ids))

    def near(batches):
        for batch in _slices(batches):
            best, first_best = np.full(len(batch), -1.0), np.zeros(len(batch), np.int64)
            for at, counts, place, value in weighed(batch):
                mine = place >= 0
                counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[mine], minlength=len(counts))
                for a, first, x in columns.products(counts, place[mine], value[mine]):
                    x = np.where(x > 0, rounded(x), -1.0)
                    top = x.argmax(axis=1)
                    rows = at + a + np.arange(len(x))
                    more = x[np.arange(len(x)), top] > best[rows]
                    best[rows[more]], first_best[rows[more]] = x[more, top[more]], first + top[more]
            good = np.flatnonzero((best >= threshold) & (best >= 0))
            yield pa.RecordBatch.from_arrays([batch.column("right_id").take(pa.array(good)), pa.array(ids[first_best[good]], kind), pa.array(best[good])], ["right_id", "left_id", "cosine"])

    return right.mapInArrow(near, f"right_id {right.schema['right_id'].dataType.simpleString()}, left_id {id_type}, cosine double")


def nearest_by_ngrams(left: DataFrame, right: DataFrame, threshold: float = 0.9, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(right_id, left_id, cosine) of each right row's nearest left row by TF-IDF over character n-grams of blank-padded words.

    left (left_id, text), right (right_id, text); idf is smooth, over both
    sides.  Texts are dealt by their key, so a row's grams are counted, weighted
    and summed where it lies.  Up to FEW left rows are held by every task, as
    sparse columns beside the idf of grams that two rows have, and right rows
    are multiplied by them a chunk at a time: no gram of a right row is
    shuffled.  With more of them, grams are ordered from rare to frequent.  A
    row's prefix ends where what follows it is too short a vector to reach the
    threshold: two rows of that cosine share a gram of both prefixes.  Only
    prefixes are joined, so frequent grams pair nothing, and the pairs found
    are then summed in full.
    """

    every = [_rows_of_words(left, "left_id"), _rows_of_words(right, "right_id")]
    n = left.count() + right.count()
    smooth = lambda df: F.ln(F.lit(1.0 + n) / (1.0 + df)) + 1.0
    df = _gram_counts(every[0], sizes).unionAll(_gram_counts(every[1], sizes)).groupBy("g").agg(F.sum("df").alias("df"))
    df = checkpointed(df.select("g", "df", smooth(F.col("df")).alias("idf")))
    if left.count() <= FEW:
        shared = df.filter("df > 1").select("g", "idf").limit(GRAMS + 1).toArrow()
        if len(shared) <= GRAMS and (found := _nearest_of_held(*every, shared, math.log((1.0 + n) / 2.0) + 1.0, threshold, sizes)) is not None:
            return found
    known = F.broadcast if df.count() <= GRAMS else lambda table: table

    def grams(rows: DataFrame, key: str) -> DataFrame:
        words = rows.select(key, "text").repartition(F.col(key)).select(key, F.explode(F.regexp_extract_all(X.similarity_text(F.col("text")), F.lit(r"(\S+)"))).alias("w")).select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))

        def of_size(n: int) -> Column:
            return F.when(F.length("w") >= n, F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring("w", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        flat = words.select(key, F.explode(F.flatten(F.array(*map(of_size, sizes)))).alias("g"))
        return flat.groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))

    l, r = grams(left, "left_id"), grams(right, "right_id")

    def weighted(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.join(known(df), "g").select(key, "g", "df", (F.col("tf") * F.col("idf")).alias("w"))
        norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return checkpointed(rows.join(norms, key).select(key, "g", "df", (F.col("w") / F.col("norm")).alias(f"{key}_w")))

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        follows = W.partitionBy(key).orderBy(F.desc("df"), F.desc("g")).rowsBetween(W.unboundedPreceding, 0)
        # from the frequent end: a gram is in the prefix unless it and all more frequent ones fall short together
        return rows.withColumn("rest", F.sqrt(F.sum(F.pow(f"{key}_w", F.lit(2.0))).over(follows))).filter(F.col("rest") >= threshold - 1e-5).select(key, "g")

    wl = weighted(l, "left_id")
    if left.count() <= FEW:
        lists = wl.groupBy("g").agg(F.collect_list(F.struct(F.col("left_id").alias("id"), F.col("left_id_w").alias("w"))).alias("lefts"))
        rows = r.join(known(df.join(lists, "g", "left").select("g", "idf", "lefts")), "g").withColumn("w", F.col("tf") * F.col("idf"))
        # the sum without a left row is the square of the norm
        own = F.array(F.struct(F.lit(None).cast(left.schema["left_id"].dataType).alias("id"), (F.col("w") * F.col("w")).alias("x")))
        met = F.transform("lefts", lambda p: F.struct(p["id"].alias("id"), (p["w"] * F.col("w")).alias("x")))
        sums = rows.select("right_id", F.inline(F.when(F.col("lefts").isNull(), own).otherwise(F.concat(own, met)))).groupBy("right_id", "id").agg(F.sum("x").alias("x"))
        whole = sums.groupBy("right_id").agg(F.sqrt(F.max(F.when(F.col("id").isNull(), F.col("x")))).alias("norm"), F.collect_list(F.when(F.col("id").isNotNull(), F.struct((-F.col("id")).alias("m"), "x"))).alias("found"))
        near = whole.select("right_id", F.array_max(F.transform("found", lambda p: F.struct(F.round(p["x"] / F.col("norm"), 6).alias("cosine"), p["m"].alias("m")))).alias("best"))
        return near.select("right_id", (-F.col("best.m")).alias("left_id"), F.col("best.cosine").alias("cosine")).filter(F.col("cosine") >= threshold)
    wr = weighted(r, "right_id")
    pairs = prefix(wl, "left_id").join(prefix(wr, "right_id"), "g").select("left_id", "right_id").distinct()
    both = pairs.join(wl.drop("df"), "left_id").join(wr.drop("df"), ["right_id", "g"]).groupBy("right_id", "left_id").agg(F.round(F.sum(F.col("left_id_w") * F.col("right_id_w")), 6).alias("cosine"))
    near = both.groupBy("right_id").agg(F.max(F.struct("cosine", (-F.col("left_id")).alias("m"))).alias("best"))
    return near.select("right_id", (-F.col("best.m")).alias("left_id"), F.col("best.cosine").alias("cosine")).filter(F.col("cosine") >= threshold)
