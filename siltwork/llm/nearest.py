"""The k most similar vectors of every vector, by additive quantisation.

Codebooks of full dimension are fitted on a bounded sample, each on what the ones before leave over; the first is the
coarse one and its cells partition the collection. Every vector is encoded by beam search over the codebooks. A query
is scored in the cells next to it: a table of its products with all code words gives its product with a coded vector by
look-up and addition, the stored norm completes the distance, and the best by this score are ranked again by their exact
cosine. Vectors of equal direction are searched once and take part with as many ids as can ever be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.session import cut

#: Dimensions of a usable vector, neighbours asked for, and decimals of the similarity they are ranked by.
DIMENSIONS, K, DECIMALS = 64, 5, 6
#: Most vectors the codebooks are fitted on, chosen by a hash of their id.
SAMPLE = 20_000
#: Codebooks after the coarse one, their words, the beam of the encoding, rounds of k-means and the seed of their start.
BOOKS, CODE_WORDS, BEAM, ROUNDS, SEED = 8, 64, 4, 8, 5
#: Vectors a cell is meant to hold, cells a query is scored in, candidates of a cell ranked exactly, rows of a block.
CELL, PROBES, RERANK, BLOCK = 256, 12, 48, 4096


@dataclass
class Codebooks:
    """Coarse words (cells x d), fine books (books x words x d)."""

    coarse: np.ndarray
    books: np.ndarray


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of x; fewer than k if x has fewer rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        near = nearest_words(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest_words(x: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest words of each row, the nearest first."""
    n = min(n, len(words))
    half = 0.5 * (words * words).sum(1)
    out = np.empty((len(x), n), np.int32)
    for at in range(0, len(x), 8192):
        d = half - x[at : at + 8192] @ words.T
        if n == 1:
            out[at : at + 8192, 0] = d.argmin(1)
        else:
            best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
            order = np.take_along_axis(d, best, 1).argsort(1, kind="stable")
            out[at : at + 8192] = np.take_along_axis(best, order, 1)
    return out


def fit(x: np.ndarray, cells: int) -> Codebooks:
    """Codebooks of a sample of unit vectors."""
    coarse = kmeans(x, cells, ROUNDS, SEED)
    rest = x - coarse[nearest_words(x, coarse, 1)[:, 0]]
    books = []
    for m in range(BOOKS):
        book = kmeans(rest, CODE_WORDS, ROUNDS, SEED + 1 + m)
        if len(book) < CODE_WORDS:
            book = np.vstack([book, np.zeros((CODE_WORDS - len(book), x.shape[1]), np.float32)])
        rest = rest - book[nearest_words(rest, book, 1)[:, 0]]
        books.append(book)
    return Codebooks(coarse, np.stack(books))


def encode(x: np.ndarray, c: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, codes (n x books) and squared norm of the coded vector, by beam search over the books."""
    cell = nearest_words(x, c.coarse, 1)[:, 0]
    n, d = x.shape
    rest = (x - c.coarse[cell])[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in c.books:
        beams = rest.shape[1]
        half = 0.5 * (book * book).sum(1)
        # Squared length that remains, up to the factor 2, with each word after each beam.
        cost = 0.5 * (rest * rest).sum(2)[:, :, None] - rest @ book.T + half
        flat = cost.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.take_along_axis(flat, best, 1).argsort(1, kind="stable"), 1)
        beam, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rest = rest[rows, beam] - book[word]
        codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
        assert beams <= BEAM
    coded = x - rest[:, 0]
    return cell, codes[:, 0], (coded * coded).sum(1)


def tables(q: np.ndarray, c: Codebooks) -> np.ndarray:
    """Products of queries with all fine words: books x queries x words."""
    return np.einsum("qd,mwd->mqw", q, c.books, optimize=True).astype(np.float32)


def unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64).reshape(-1, DIMENSIONS)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unpacked(rows: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of packed ones; these stay as they were given, so that single precision takes half the room."""
    return unit(np.frombuffer(b"".join(rows), kind))


def usable(vectors: DataFrame, item: str = "item_id", embedding: str = "embedding") -> DataFrame:
    """(item_id, v) of the rows with an id and exactly 64 finite components, not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(item).cast("string").alias("item_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("item_id").isNotNull() & (F.size(v) == DIMENSIONS)).where(finite & F.exists(v, lambda x: x != 0))


def search(batches: Iterator[pa.RecordBatch], c: Codebooks, k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Best candidates of each query of a block in each cell's block: LUT scores, then exact cosines."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [])
        for cell, keys, vecs, norms, codes, asked, qvecs in zip(*(col.to_pylist() for col in b.columns), strict=True):
            x = unpacked(vecs, kind)
            code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, BOOKS)
            norm = np.asarray(norms, np.float32)
            q_all = unpacked(qvecs, kind)
            names = np.asarray(keys, np.int64)
            for at in range(0, len(q_all), 1024):
                q = q_all[at : at + 1024]
                q32 = q.astype(np.float32)
                lut = tables(q32, c)
                score = np.broadcast_to(0.5 * norm - (q32 @ c.coarse[cell])[:, None], (len(q), len(x))).copy()
                for m in range(BOOKS):
                    score -= lut[m][:, code[:, m]]
                r = min(RERANK, len(x))
                best = np.argpartition(score, r - 1, axis=1)[:, :r] if r < len(x) else np.tile(np.arange(r), (len(q), 1))
                exact = np.round(np.einsum("qd,qrd->qr", q, x[best], optimize=True), DECIMALS)
                few = min(k + 1, r)
                top = np.argpartition(-exact, few - 1, axis=1)[:, :few] if few < r else np.tile(np.arange(r), (len(q), 1))
                floor = np.take_along_axis(exact, top, 1).min(1)
                # All that tie with the last are kept; their ids decide.
                rows, cols = np.nonzero(exact >= floor[:, None])
                out[0].append(np.asarray(asked[at : at + 1024], np.int64)[rows])
                out[1].append(names[best[rows, cols]])
                out[2].append(exact[rows, cols])
        flat = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in flat], ["query", "key", "cosine"])


def neighbours(vectors: DataFrame, k: int = K, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """(item_id, other, cosine, place) of the k most similar other vectors of each usable one, place from 1.

    Similarity is the cosine rounded to 6 decimals, among equals the smaller id comes first. Vectors need item_id and
    embedding; rows with a null id or an unusable embedding take no part; rows of one id and direction are one; an
    empty table and a single vector have no neighbours; other columns are ignored. Only the sample and the number of
    vectors come to the driver.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    schema = "item_id string, other string, cosine double, place int"
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    if n < 2:
        return spark.createDataFrame([], schema)
    # One vector for all of a direction, which is told by its components to 7 decimals.

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            if not b.num_rows:
                continue
            given = np.asarray(b.column(1).to_pylist(), np.float64)
            near = np.round(unit(given), 7) + 0.0
            keys = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in near], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array([r.tobytes() for r in given.astype(kind)], pa.binary())], ["item_id", "key", "x"])

    all_ = cut(rows.mapInArrow(directions, "item_id string, key bigint, x binary"), "directions")
    first = all_.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("item_id", "x"))).where(F.col("place") <= k + 1)
    classes = first.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.min(F.struct("place", "x"))["x"].alias("x"))
    classes = cut(classes, "classes")

    chosen = classes.select("x", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(sample).select("x").collect()
    learn = unpacked([bytes(r[0]) for r in chosen], kind).astype(np.float32)
    books = fit(learn, min(max(1, n // CELL), max(1, len(learn) // 8)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unpacked(b.column(1).to_pylist(), kind).astype(np.float32)
            cell, codes, norm = encode(x, books)
            near = nearest_words(x, books.coarse, probes)
            columns = [b.column(0), b.column(1), pa.array(cell), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norm.astype(np.float32)), pa.array(near.tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "x", "cell", "codes", "norm", "near"])

    code = cut(classes.select("key", "x").mapInArrow(coded, "key bigint, x binary, cell int, codes binary, norm float, near array<int>"), "codes")
    # Blocks: a cell's vectors, and the queries that look into it, are split into parts of bounded size by key; a cell's
    # rows meet its queries part by part.
    part = lambda name, parts: F.pmod(F.xxhash64("key", F.lit(name)), F.col(parts)).cast("int")
    asked = code.select("key", "x", F.explode("near").alias("cell"))
    counts = code.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    asks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("queries"))
    sizes = cut(counts.join(asks, "cell"), "cells")
    stored = code.join(sizes, "cell").withColumn("part", part("s", "parts"))
    held = stored.groupBy("cell", "part").agg(F.first("queries").alias("queries"), *(F.collect_list(c).alias(c) for c in ("key", "x", "norm", "codes")))
    held = held.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("queries").cast("int") - 1)).alias("query"), "key", "x", "norm", "codes")
    looking = asked.join(sizes, "cell").withColumn("query", part("q", "queries")).groupBy("cell", "query").agg(F.collect_list("key").alias("asked"), F.collect_list("x").alias("qx"))
    blocks = held.join(looking, ["cell", "query"]).select("cell", "key", "x", "norm", "codes", "asked", "qx")
    hits = blocks.mapInArrow(lambda it: search(it, books, k, kind), "query bigint, key bigint, cosine double")

    # The best of a direction, as ids: one more than asked for, since a vector is not its own neighbour.
    named = hits.join(classes.select("key", "ids"), "key").select("query", F.explode("ids").alias("other"), "cosine")
    best = named.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "other"))).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "other", "cosine"))).alias("best"))
    own = all_.select("item_id", F.col("key").alias("query")).distinct().join(lists, "query")
    rest = F.slice(F.filter("best", lambda s: s["other"] != F.col("item_id")), 1, k)
    return own.select("item_id", F.posexplode(rest).alias("at", "s")).select("item_id", F.col("s.other").alias("other"), F.col("s.cosine").alias("cosine"), (F.col("at") + 1).cast("int").alias("place"))


def pairs(vectors: DataFrame, k: int = K) -> DataFrame:
    """(item_a, item_b) of which at least one is among the k most similar of the other, once, smaller id first."""
    found = neighbours(vectors, k)
    return found.select(F.least("item_id", "other").alias("item_a"), F.greatest("item_id", "other").alias("item_b")).distinct()
