"""Repeats of accepted claims in new batches, without going through the history again.

The accepted claims of each batch are indexed once, as an immutable segment of suffix arrays over their canonical texts
(``assertions``). A text is taken as a ring, so that each of its words heads a suffix that holds the whole assertion:
figures and denial, then the words from that one on. Suffixes lie in shards by their figures and first letters; a shard
keeps them in order, with the ids of their claims. The claims of a new batch are looked up by bisection in the shards
that can hold a match: by what a repeat must share exactly, which is the first name after the figures, else the figures
(none, where there are none). Matches of a pair are added up to the part of the new claim that they cover, and the pairs left are
held against each other word by word; only for them are the texts of accepted claims read. Segments of similar size are
merged, so their number stays logarithmic in the number of batches.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import assertions
from siltwork.llm.assertions import SPELLING, alike, framing
from siltwork.session import cut, shared_dir

#: Letters after the figures by which suffixes are told apart into shards.
HEAD = 3
#: Suffixes a shard is meant to hold (one of more than twice as many is split into parts, which are all searched), and
#: patterns looked up in it at a time.
SHARD, ASKED = 40_000, 20_000
#: Most folders of a segment; a search reads those that it needs.
FOLDERS = 512
#: Matches above which they are narrowed, exactly, by the words that a repeat must have in common.
COMMON = 64
#: Matches passed on at a time.
MATCHES = 50_000
#: Suffixes that a claim is taken to have when shards are counted out.
PER_CLAIM = 8
SCHEMA = "shard int, part int, keys array<string>, claims array<string>, claim_id string, record string, folder int"
ROWS = [x.split(" ")[0] for x in SCHEMA.split(", ")]
END = "￿"


def forms(record: str) -> list[assertions.Assertion]:
    """The assertions of a record that say something: of its text, and of its quote."""
    return [a for a in map(assertions.parse, filter(None, record.split("\t"))) if not a.empty()]


def figures(a: assertions.Assertion) -> str:
    return " ".join([*a.figures, "!" if a.denied else "."]) + "@"


def suffixes(a: assertions.Assertion) -> list[tuple[str, str]]:
    """(head, key) of each suffix: what its shard is told by, and the suffix. The first starts with the names, written
    together; a text that does not show its names is written together as a whole."""
    start, words = figures(a), list(a.words)
    glue = " " if a.named else ""
    tokens = ["".join(a.names), *words] if a.names else words
    out = []
    if not a.names:
        out.append((start, f"{start} {' '.join(words)}"))
    for i, t in enumerate(tokens):
        rest = glue.join(tokens[i:])
        key = f"{start}{rest}\n{' '.join(tokens[:i] if a.named else words)}"
        first = a.names[0] if a.names and not i else t
        out.append((start + rest[:HEAD], key))
        if len(first) < HEAD:
            out.append((f"{start}{first}\n", key))
    return out


def patterns(a: assertions.Assertion) -> list[tuple[str, str]]:
    """(head, pattern) of what a repeat must share exactly, as the beginning of one of its suffixes: the first name; without
    one the figures, which may be none; where the names are not known, also any of the words."""
    start = figures(a)
    shared = a.names[:1] if a.names else () if a.named else a.words
    out = [(start + t[:HEAD] if len(t) >= HEAD else f"{start}{t}\n", start + t) for t in shared if t not in "+-"]
    return out if a.names else [*out, (start, start)]


def head_hash(head: str) -> int:
    h = xxhash.xxh64_intdigest(head)
    return h - (1 << 64) if h >> 63 else h


def words_of(key: str) -> list[str]:
    """The words of the assertion that a suffix, or part of one, holds; names may be among them, written together."""
    return key.partition("@")[2].replace("\n", " ").split()


class Shard:
    """The suffixes of one part of a shard in order, searched by bisection."""

    def __init__(self, keys: list[str], claims: list[str]):
        self.keys, self.claims = keys, claims
        self.held: dict[str, np.ndarray] | None = None
        self.near: dict[str, np.ndarray] = {}

    def postings(self) -> dict[str, np.ndarray]:
        if self.held is None:
            at: dict[str, list[int]] = {}
            for i, key in enumerate(self.keys):
                for w in dict.fromkeys(words_of(key)):
                    at.setdefault(w, []).append(i)
            self.held = {w: np.array(v) for w, v in at.items()}
        return self.held

    def with_word(self, word: str) -> np.ndarray:
        """Places of the suffixes whose assertion has the word or one that it can be, misspelled."""
        if word not in self.near:
            held = self.postings()
            found = [v for w, v in held.items() if w == word or (len(w) > 2 and len(word) > 2 and abs(len(w) - len(word)) <= 0.4 * (len(w) + len(word)) and alike(w, word) >= SPELLING)]
            self.near[word] = np.unique(np.concatenate(found)) if found else np.array([], int)
        return self.near[word]

    def find(self, pattern: str, words: tuple[str, ...]) -> tuple[range | list[int], int]:
        """Places of the suffixes that begin with the pattern. If they are many, only of those that have a partner for the
        word of the new claim, not one of framing, that has partners in the fewest: a repeat has them for all."""
        low = bisect_left(self.keys, pattern)
        high = bisect_left(self.keys, pattern + END, low)
        if high - low <= COMMON:
            return range(low, high), len(pattern)
        places: range | list[int] = range(low, high)
        for w in words:
            if w not in "+-" and not framing(w):
                all_ = self.with_word(w)
                a, b = np.searchsorted(all_, (low, high))
                if b - a < len(places):
                    places = all_[a:b].tolist()
        return places, len(pattern)


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(new, claim_id, covered) of the matches of the asked patterns in the shards beside them."""
    kinds = (pa.string(), pa.string(), pa.int32())
    for b in batches:
        for asked, keys, claims in zip(*(c.to_pylist() for c in b.columns), strict=True):
            shard = Shard(keys, claims)
            out: tuple[list, list, list] = ([], [], [])
            for q in asked:
                places, length = shard.find(q["pattern"], q["words"])
                for i in places:
                    for column, value in zip(out, (q["new"], claims[i], length), strict=True):
                        column.append(value)
                if len(out[0]) >= MATCHES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["new", "claim_id", "covered"])
                    out = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["new", "claim_id", "covered"])


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that make the same assertion."""
    for b in batches:
        yield b.select(["new", "claim_id"]).filter(pa.array([assertions.repeats(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_()))


def with_suffixes(records: DataFrame) -> DataFrame:
    """(claim_id, head, key) of every suffix of (claim_id, record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for claim, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for head, key in dict.fromkeys(x for a in forms(record) for x in suffixes(a)):
                    for column, value in zip(out, (claim, head_hash(head), key), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.string()), strict=True)], ["claim_id", "head", "key"])

    return records.select("claim_id", "record").mapInArrow(run, "claim_id string, head bigint, key string")


def with_patterns(records: DataFrame) -> DataFrame:
    """(batch_no, head, new, pattern, words) of all that is looked up for (claim_id, batch_no, record)."""
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for new, batch, record in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in forms(record):
                    for head, pattern in patterns(a):
                        # Words of a text in one case may be names, and names may be written together on the other side; by the
                        # figures alone only assertions without names are found, whose words all count.
                        words = list(a.words) if a.named or pattern == figures(a) else []
                        for column, value in zip(out, (batch, head_hash(head), new, pattern, words), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["batch_no", "head", "new", "pattern", "words"])

    return records.select("claim_id", "batch_no", "record").mapInArrow(run, "batch_no int, head bigint, new string, pattern string, words array<string>")


@dataclass
class Segment:
    """An immutable part of the index: a table of shards and records in folders, how many claims it holds and in how many shards."""

    path: str
    claims: int
    shards: int
    folders: int


class ClaimIndex:
    """Accepted claims as segments of suffix arrays in a folder; opened again, it goes on where it was left.

    The list of segments is a numbered file, written anew after each change; the highest number counts. Files of segments
    are never changed, so that a writer that fails half way leaves the index as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, shard: int = SHARD):
        self.spark, self.folder, self.shard = spark, folder.rstrip("/"), shard
        self.segments: list[Segment] = []
        self.version = 0
        #: (folders read, folders there) of each search.
        self.reads: list[tuple[int, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, shard: int = SHARD) -> ClaimIndex:
        """The index in a folder, an empty one if there is none yet."""
        index = cls(spark, folder, shard)
        system, path = index._file("lists")
        if system.exists(path):
            index.version = max(int(f.getPath().getName()) for f in system.listStatus(path))
            stored = spark.read.text(f"{index.folder}/lists/{index.version}", wholetext=True).first()[0]
            index.segments = [Segment(**x) for x in json.loads(stored)]
        return index

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _publish(self) -> None:
        system, new = self._file(f"new-{uuid.uuid4().hex}")
        stream = system.create(new, False)
        stream.write(bytearray(json.dumps([asdict(s) for s in self.segments]).encode()))
        stream.close()
        self.version += 1
        _, path = self._file(f"lists/{self.version}")
        system.mkdirs(path.getParent())
        if not system.rename(new, path):
            raise RuntimeError(f"another writer has changed the index in {self.folder}")

    def _write(self, records: DataFrame, claims: int) -> Segment:
        """A segment of (claim_id, record): rows with a shard and, beside them in one table, rows with a record."""
        path = f"{self.folder}/segment-{uuid.uuid4().hex}"
        many = max(1, -(-PER_CLAIM * claims // self.shard))
        folders = min(FOLDERS, many)
        rows = with_suffixes(records).withColumn("shard", F.pmod("head", F.lit(many)).cast("int"))
        part = F.lit(0)
        if many > 1:
            rows = cut(rows, "suffixes")
            sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * self.shard)
            sizes.select("shard", F.ceil(F.col("n") / self.shard).cast("int").alias("parts")).coalesce(1).write.parquet(f"{path}/split")
            rows = rows.join(self._split(path), "shard", "left")
            part = F.pmod(F.xxhash64("claim_id"), F.coalesce("parts", F.lit(1))).cast("int")
        ordered = rows.select("shard", part.alias("part"), F.struct("key", "claim_id").alias("s")).groupBy("shard", "part").agg(F.sort_array(F.collect_list("s")).alias("s"))
        shards = ordered.select("shard", "part", F.col("s.key").alias("keys"), F.col("s.claim_id").alias("claims"), (F.col("shard") % folders).alias("folder"))
        texts = records.select("claim_id", "record", F.pmod(F.xxhash64("claim_id"), F.lit(folders)).cast("int").alias("folder"))
        both = shards.unionByName(texts, allowMissingColumns=True)
        placed = both.coalesce(1) if folders == 1 else both.repartition(folders, "folder")
        placed.select(*ROWS).write.partitionBy("folder").parquet(f"{path}/rows")
        return Segment(path, claims, many, folders)

    def _split(self, path: str) -> DataFrame:
        return self.spark.read.schema("shard int, parts int").parquet(f"{path}/split")

    def _rows(self, s: Segment, folders: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(f"{s.path}/rows")
        return rows if folders is None else rows.where(F.col("folder").isin(folders))

    def _each(self) -> Column:
        """One row for each segment: seg, its place in the list, with its shards and folders."""
        return F.explode(F.array(*(F.struct(F.lit(n).alias("seg"), F.lit(s.shards).alias("shards"), F.lit(s.folders).alias("folders")) for n, s in enumerate(self.segments)))).alias("s")

    def _needed(self, places: DataFrame) -> list[list[int]]:
        """The folders of each segment that (seg, folder) need, at most FOLDERS a segment, all found in one job."""
        out: list[list[int]] = [[0] if s.folders == 1 else [] for s in self.segments]
        if any(s.folders > 1 for s in self.segments):
            for seg, folder in places.distinct().collect():
                if self.segments[seg].folders > 1:
                    out[seg].append(folder)
        return [sorted(x) for x in out]

    def add(self, records: DataFrame, claims: int) -> None:
        """Index (claim_id, record), so many rows, as a new segment, in one with the last ones if they are of similar size."""
        if not claims:
            return
        kept, records = list(self.segments), records.select("claim_id", "record")
        while kept and kept[-1].claims < 2 * claims:
            s = kept.pop()
            claims += s.claims
            records = records.unionByName(self._rows(s).where("record is not null").select("claim_id", "record"))
        self.segments = [*kept, self._write(records, claims)]
        self._publish()

    def search(self, records: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """(new, claim_id) of each (claim_id, record) that repeats an indexed one: the claim that it repeats, the one of the
        smallest id if there are several. Reads the folders with shards or records that are asked for; which these are
        comes to the driver, at most FOLDERS numbers a segment. ``asked``: their patterns, if they are there already. All
        segments are searched in one plan, so that neither plans nor jobs grow with their number."""
        if not self.segments:
            return self.spark.createDataFrame([], "new string, claim_id string")
        if asked is None:
            asked = cut(with_patterns(records.withColumn("batch_no", F.lit(0))), "patterns")
        each = asked.select("head", "new", "pattern", "words", self._each())
        placed = each.select("s.seg", F.pmod("head", "s.shards").cast("int").alias("shard"), "s.folders", "new", "pattern", "words")
        needed = self._needed(placed.select("seg", (F.col("shard") % F.col("folders")).alias("folder")))
        self.reads += [(len(x), s.folders) for x, s in zip(needed, self.segments, strict=True)]
        # Each part of a shard that is split is asked; what is asked of a shard by many is cut into blocks.
        counts = placed.groupBy("seg", "shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")).withColumn("parts", F.lit(1))
        split: DataFrame | None = None
        table: DataFrame | None = None
        for n, s in enumerate(self.segments):
            mine = self._rows(s, needed[n]).where("shard is not null").select(F.lit(n).alias("seg"), "shard", "part", "keys", "claims")
            table = mine if table is None else table.unionByName(mine)
            if s.shards > 1:
                own = self._split(s.path).withColumn("seg", F.lit(n))
                split = own if split is None else split.unionByName(own)
        if split is not None:
            counts = counts.drop("parts").join(split, ["seg", "shard"], "left")
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        block = F.pmod(F.xxhash64("new", "pattern"), F.col("blocks")).alias("block")
        grouped = placed.join(counts, ["seg", "shard"]).select("seg", "shard", "new", "pattern", "words", block, parts)
        grouped = grouped.groupBy("seg", "shard", "part", "block").agg(F.collect_list(F.struct("new", "pattern", "words")).alias("asked"))
        matches = grouped.join(table, ["seg", "shard", "part"]).select("asked", "keys", "claims").mapInArrow(find, "new string, claim_id string, covered int")
        covered = matches.groupBy("new", "claim_id").agg(F.sum("covered").alias("covered"))
        if any(s.folders > 1 for s in self.segments):
            covered = cut(covered, "matches")
        needed = self._needed(covered.select("claim_id", self._each()).select("s.seg", F.pmod(F.xxhash64("claim_id"), F.col("s.folders")).cast("int").alias("folder")))
        known: DataFrame | None = None
        for s, folders in zip(self.segments, needed, strict=True):
            texts = self._rows(s, folders).where("record is not null").select("claim_id", F.col("record").alias("other"))
            known = texts if known is None else known.unionByName(texts)
        mine = records.select(F.col("claim_id").alias("new"), "record")
        pairs = covered.join(mine, "new").join(known, "claim_id").select("new", "claim_id", "record", "other")
        return pairs.mapInArrow(judge, "new string, claim_id string").groupBy("new").agg(F.min("claim_id").alias("claim_id"))


def with_records(claims: DataFrame) -> DataFrame:
    """(claim_id, batch_no, record), one row a claim: of the deliveries under one claim_id, the one of the first batch,
    then the first in time, then by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [assertions.record(t, q) for t, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["claim_id", "batch_no", "record"])

    rows = claims.where(F.col("claim_id").isNotNull()).select(
        F.col("claim_id").cast("string"), F.coalesce(F.col("batch_no").cast("int"), F.lit(0)).alias("batch_no"), F.col("text").cast("string"), F.col("quote").cast("string"), "created_at"
    )
    first = F.min(F.struct("batch_no", "created_at", "text", "quote")).alias("r")
    one = rows.groupBy("claim_id").agg(first).select("claim_id", "r.batch_no", "r.text", "r.quote")
    return one.mapInArrow(run, "claim_id string, batch_no int, record string")


def accept(index: ClaimIndex, new: DataFrame, claims: int, asked: DataFrame | None = None) -> DataFrame | None:
    """(new, claim_id) of those of (claim_id, record), so many rows of different records, that repeat an accepted one; the
    others are accepted. None if nothing was accepted before."""
    if not index.segments:
        index.add(new, claims)
        return None
    hits = cut(index.search(new, asked), "hits")
    found = hits.count()
    index.add(new.join(hits.select(F.col("new").alias("claim_id")), "claim_id", "left_anti") if found else new, claims - found)
    return hits


def take(index: ClaimIndex, batch: DataFrame) -> DataFrame:
    """(new, record, claim_id) of the claims of a batch (claim_id, record) that repeat an accepted one; the others are accepted.

    Records that are equal are looked up once, under the smallest id among them; that id stands for them in the result.
    """
    new = cut(batch.groupBy("record").agg(F.min("claim_id").alias("claim_id")), "batch")
    hits = accept(index, new, new.count())
    if hits is None:
        return index.spark.createDataFrame([], "new string, record string, claim_id string")
    return hits.join(new.select(F.col("claim_id").alias("new"), "record"), "new").select("new", "record", "claim_id")


def repeats(claims: DataFrame) -> DataFrame:
    """(claim_a, claim_b) of each claim of a later batch and the accepted claim of an earlier one that it repeats.

    Claims need claim_id, batch_no, text, quote, created_at. Rows of one claim_id are one claim; a null batch_no counts as
    the history, a null claim_id is left out, a missing text is read from the quote, and claims without both repeat
    nothing. Equal claims of one batch are all accepted, and later ones pair with the smallest id among them. An empty
    table gives an empty result; other columns are ignored. Batches are taken in order, each with a search of the index
    and a new segment; only their numbers, sizes and the folders they need come to the driver.
    """
    spark = claims.sparkSession
    all_ = cut(with_records(claims), "claims").where(~F.col("record").rlike(r"^# [@?] [.]\t"))
    # Once for all batches: their different records, and what is looked up for them.
    new = cut(all_.groupBy("batch_no", "record").agg(F.min("claim_id").alias("claim_id")), "batches", "batch_no")
    sizes = sorted(tuple(r) for r in new.groupBy("batch_no").count().collect())
    if len(sizes) < 2:
        return spark.createDataFrame([], "claim_a string, claim_b string")
    asked = cut(with_patterns(new.where(F.col("batch_no") > sizes[0][0])), "patterns", "batch_no")
    index = ClaimIndex(spark, f"{shared_dir(spark)}/siltwork/claims-{uuid.uuid4().hex}")
    found: DataFrame | None = None
    for number, n in sizes:
        hits = accept(index, new.where(F.col("batch_no") == number).select("claim_id", "record"), n, asked.where(F.col("batch_no") == number))
        if hits is not None:
            found = hits if found is None else found.unionByName(hits)
    known = found.withColumnRenamed("claim_id", "known").join(new.withColumnRenamed("claim_id", "new"), "new").select("record", "batch_no", "known")
    pairs = all_.join(known, ["record", "batch_no"])
    return pairs.select(F.least("claim_id", "known").alias("claim_a"), F.greatest("claim_id", "known").alias("claim_b")).distinct()
