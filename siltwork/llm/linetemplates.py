"""Lines that come back excessively within one source.

Every partition parses its lines into a tree of fixed depth: source, number of tokens, first token, last token, and at
the leaf the templates. A line goes to the template of its leaf with which it agrees in most positions, and positions in
which the lines of a template differ become wildcards. The trees of all partitions are merged leaf by leaf in the same
way, until no line can fit two templates of a leaf. Documents are counted by leaf, then by merged template, and what
covers too few is dropped; under the templates that are left the lines are counted by their exact letters, which alone
make two lines the same.

Runs of anything but letters are slots that every template has anyway, so digits, punctuation, spacing and invisible
characters never tell two lines apart; for the same reason tokens are cut from the letters and not at blanks.

Counts are never too low on the way: all places of a line lie under one leaf and one merged template, whose documents
are at least those of the line. The shuffles over lines carry hashes and counts, no text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import eq, itemgetter

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.session import cut

#: A line is excessive in a source from so many of its documents, and so large a share of them, on.
LEAST_DOCS, LEAST_SHARE = 5, 0.03
#: Lines a worker holds before it hands its templates on and starts an empty tree. Counts add up, so nothing is lost.
TREE_LINES = 200_000
#: Share of its positions in which a line agrees with a template that takes it in.
SIMILAR = 0.5
#: Templates of a leaf; a full one gives a line to the template nearest to it, which gets more wildcards.
LEAF = 32
#: Positions of a template. Of a line with more tokens, each position is a stretch of them.
WIDTH = 16

_not_letters = regex.compile(r"[^\p{L}\n]+").sub
# Fixed value: a token ends with a frequent vowel from its third letter on, or at 8 letters, so it is about as long as a word.
_tokens = re.compile("..[^aeαεае]{0,5}[aeαεае]?|.").findall
_wrap = 1 << 63


def letters(text: str) -> list[str]:
    """The letters of each line of ``text``, lower-cased."""
    return _not_letters("", text).lower().split("\n")


def _signed(h: int) -> int:
    return h - 2 * _wrap if h >= _wrap else h


def line_key(line: str) -> int:
    """64-bit key of a line's letters; 0 is kept for lines without any."""
    return (_signed(xxhash.xxh64_intdigest(line)) or 1) if line else 0


@lru_cache(1024)
def _stretches(n: int) -> list[slice]:
    return [slice(i * n // WIDTH, (i + 1) * n // WIDTH) for i in range(WIDTH)]


def positions(tokens: list[str]) -> bytes:
    """The 32-bit hashes of a line's positions, of which 0 stands for a wildcard."""
    if len(tokens) > WIDTH:
        tokens = ["".join(tokens[x]) for x in _stretches(len(tokens))]
    return b"".join(map(xxhash.xxh32_digest, tokens))


def _each(tokens: bytes) -> memoryview:
    return memoryview(tokens).cast("I")


class Template:
    """Positions, some of them wildcards, the documents they cover, and those of each line by its key."""

    __slots__ = ("docs", "lines", "tokens")

    def __init__(self, tokens: bytes) -> None:
        self.tokens = tokens
        self.docs = 0
        self.lines: dict[int, int] = {}

    def widen(self, tokens: bytes) -> None:
        """Make wildcards of the positions that are not those of ``tokens``."""
        self.tokens = array("I", [a if a == b else 0 for a, b in zip(_each(self.tokens), _each(tokens), strict=True)]).tobytes()

    def meets(self, other: Template) -> bool:
        """Whether a line can fit both templates."""
        return all(a == b or not a or not b for a, b in zip(_each(self.tokens), _each(other.tokens), strict=True))


def place(leaf: list[Template], tokens: bytes) -> Template:
    """The template of ``leaf`` that takes a line or template in, widened to it; a new one if none is similar."""
    own = _each(tokens)
    best, most = None, -1
    for t in leaf:
        same = sum(map(eq, own, _each(t.tokens)))
        if same > most:
            best, most = t, same
    if best is None or (most < SIMILAR * len(own) and len(leaf) < LEAF):
        best = Template(tokens)
        leaf.append(best)
    elif most < len(own):
        best.widen(tokens)
    return best


def merged(parts: Iterable[bytes]) -> list[bytes]:
    """What each of the templates of one leaf becomes when the trees that hold them are merged.

    Templates that one line can fit are made one, so that the lines of equal letters of all trees are under one template.
    """
    leaf: list[Template] = []
    own = [place(leaf, p) for p in parts]
    apart: list[Template] = []
    into: dict[Template, Template] = {}
    while leaf:
        t = leaf.pop()
        other = next((o for o in apart if t.meets(o)), None)
        if other is None:
            apart.append(t)
        else:
            other.widen(t.tokens)
            into[t] = other
            apart.remove(other)
            leaf.append(other)
    out = []
    for t in own:
        while t in into:
            t = into[t]
        out.append(t.tokens)
    return out


class TemplateTree:
    """Templates and their documents under source, number of tokens, first token and last token."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.root: dict = {}
        self.known: dict[object, dict[int, Template]] = {}
        self.lines = 0

    def add(self, source: object, lines: dict[str, int]) -> None:
        """Parse one document's lines: their letters and keys, each line once."""
        known, sizes = self.known.setdefault(source, {}), self.root.setdefault(source, {})
        covering = set()
        for line, key in lines.items():
            template = known.get(key)
            if template is None:
                tokens = _tokens(line)
                firsts = sizes.setdefault(len(tokens), {})
                leaf = firsts.setdefault(tokens[0], {}).setdefault(tokens[-1], [])
                template = known[key] = place(leaf, positions(tokens))
                template.lines[key] = 0
                self.lines += 1
            template.lines[key] += 1
            covering.add(template)
        for template in covering:
            template.docs += 1

    def templates(self) -> Iterator[tuple[object, int, Template]]:
        """All (source, hash of the path, template), leaving the tree empty."""
        for source, sizes in self.root.items():
            for size, firsts in sizes.items():
                for first, lasts in firsts.items():
                    for last, leaf in lasts.items():
                        path = _signed(xxhash.xxh64_intdigest(f"{size} {first} {last}"))
                        for template in leaf:
                            yield source, path, template
        self._clear()

    def drain(self) -> Iterator[tuple[object, int, int]]:
        """All (source, key, documents), leaving the tree empty."""
        for source, _, template in self.templates():
            for key, docs in template.lines.items():
                yield source, key, docs


SCAN = (
    "source string, hash string, path bigint, template binary, docs int, keys array<bigint>, key_docs array<int>, "
    "doc_id bigint, lines array<bigint>, marks array<bigint>, slots array<bigint>"
)
#: Of a document's raw lines, their letters and keys: the lists kept as marks and slots.
Mark = Callable[[list[str], list[str], list[int]], tuple[list[int], list[int]]]


def scan(docs: DataFrame, mark: Callable[[], Mark] | None = None) -> DataFrame:
    """One pass over all texts: a row for each document and, mixed in, a row for each template of a partition's tree.

    Document rows have doc_id and the keys of their lines (0: no letters); template rows have the hash of their path,
    their positions, the documents they cover, and their lines' keys and documents. ``hash`` stands for the source where
    that is null, to be resolved later without moving any text. With ``mark``, called once on each worker, documents with
    a letter have marks and slots in place of lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, marker = TemplateTree(), mark() if mark else None
        names = [x.split(" ")[0] for x in SCAN.split(", ")]
        many = pa.list_(pa.int64())
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), many, pa.list_(pa.int32()), pa.int64(), many, many, many]

        def rows(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def grown() -> pa.RecordBatch:
            flat = list(tree.templates())
            own = [s[0] for s, _, _ in flat]
            instead = [s[1] for s, _, _ in flat]
            found = [t for _, _, t in flat]
            counts = [[t.tokens for t in found], [t.docs for t in found], [list(t.lines) for t in found], [list(t.lines.values()) for t in found]]
            return rows([own, instead, [p for _, p, _ in flat], *counts, *[[None] * len(flat)] * 4])

        for b in batches:
            ids, texts, sources, hashes = (c.to_pylist() for c in b.columns)
            keys, marks, slots = [], [], []
            for i, text in enumerate(texts):
                own = letters(text) if text else []
                found = [line_key(x) for x in own]
                if text:
                    tree.add((sources[i], hashes[i]), {x: k for x, k in zip(own, found, strict=True) if k})
                kept = marker(text.split("\n"), own, found) if marker and any(found) else (None, None)
                keys.append([] if marker else found)
                marks.append(kept[0])
                slots.append(kept[1])
            n = len(ids)
            yield rows([sources, hashes, *[[None] * n] * 5, ids, keys, marks, slots])
            if tree.lines >= TREE_LINES:
                yield grown()
        if tree.lines:
            yield grown()

    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("source").cast("string"), F.when(F.col("source").isNull(), F.col("artifact_hash")).alias("hash")
    )
    return rows.mapInArrow(run, SCAN)


def fallback_sources(docs: DataFrame, artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(hash, found) for the documents without a source: artifacts.source, else list_id, else site of manifest.extra."""
    need = docs.where(F.col("source").isNull() & F.col("artifact_hash").isNotNull()).select(F.col("artifact_hash").alias("hash")).distinct()
    first = artifacts.where(F.col("source").isNotNull()).select(F.col("artifact_hash").alias("hash"), F.col("source").alias("a"))
    second = manifest.select(F.col("content_hash").alias("hash"), F.col("extra")["list_id"].alias("b"), F.col("extra")["site"].alias("c"))
    named = first.join(need, "hash", "left_semi").groupBy("hash").agg(F.min("a").alias("a"))
    extra = second.join(need, "hash", "left_semi").groupBy("hash").agg(F.min("b").alias("b"), F.min("c").alias("c"))
    return need.join(named, "hash", "left").join(extra, "hash", "left").select("hash", F.coalesce("a", "b", "c").alias("found")).where("found is not null")


def resolve(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """``rows`` with their source, from ``fallback`` where only the hash is known; rows without any source stay null.

    Only the rows without a source are joined, so the others are neither moved nor gathered under a null key.
    """
    known = rows.where(F.col("source").isNotNull()).drop("hash")
    open_ = rows.where(F.col("source").isNull()).join(fallback, "hash", "left")
    return known.unionByName(open_.withColumn("source", F.col("found")).drop("hash", "found"))


def merge_leaves(templates: DataFrame) -> DataFrame:
    """(source, path, template, whole, docs): what each template is in the merged tree, leaf by leaf.

    A task holds the templates of one leaf at a time, of which a partition has no more than ``LEAF``, and none of their lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            names = ["source", "path", "template", "whole", "docs"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for _, leaf in groupby(flat, itemgetter(0, 1)):
            parts = list(leaf)
            wholes = merged(p[2] for p in parts)
            out += [(*p[:3], w, p[3]) for p, w in zip(parts, wholes, strict=True)]
            if len(out) >= 10_000:
                yield rows()
                out.clear()
        if out:
            yield rows()

    equal = templates.groupBy("source", "path", "template").agg(F.sum("docs").alias("docs"))
    leaves = equal.repartition("source", "path").sortWithinPartitions("source", "path", "template")
    return leaves.mapInArrow(run, "source string, path bigint, template binary, whole binary, docs bigint")


def excessive(scanned: DataFrame, fallback: DataFrame, totals: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source, key) of the lines that are in too many documents, by way of the merged tree.

    Leaves that cover too few documents are dropped before their templates are moved, merged templates that do before
    their lines are. A document under two templates that are merged counts twice there, and once for each line.
    """
    totals = cut(totals, "totals")

    def enough(counts: DataFrame, *by: str) -> DataFrame:
        n = counts.groupBy("source", *by).agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs)
        return n.join(totals, "source").where(F.col("n") >= F.lit(least_share) * F.col("total")).select("source", *by)

    trees = scanned.where("path is not null").select("source", "hash", "path", "template", "docs", "keys", "key_docs")
    trees = resolve(trees, fallback).where("source is not null")
    # Written first, so that its size is known when the join is planned: templates stay where they are if it is small.
    paths = cut(enough(trees, "path"), "paths")
    held = cut(trees.join(paths, ["source", "path"], "left_semi"), "leaves")
    whole = cut(merge_leaves(held), "templates")
    covering = whole.join(enough(whole, "path", "whole"), ["source", "path", "whole"], "left_semi")
    under = held.join(covering, ["source", "path", "template"], "left_semi")
    lines = under.select("source", F.explode(F.arrays_zip("keys", "key_docs")).alias("of")).select("source", F.col("of.keys").alias("key"), F.col("of.key_docs").alias("docs"))
    return enough(lines, "key")


def totals(docs: DataFrame, fallback: DataFrame) -> DataFrame:
    """(source, total) over all documents, null and empty ones included."""
    rows = docs.groupBy("source", F.when(F.col("source").isNull(), F.col("artifact_hash")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return resolve(rows, fallback).where("source is not null").groupBy("source").agg(F.sum("n").alias("total"))


def repeated_lines(docs: DataFrame, artifacts: DataFrame, manifest: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, line_no) of every occurrence of an excessive line, lines counted from 1.

    Documents need doc_id, text, source, artifact_hash. Null and empty texts count as documents and have no lines; a
    document without any source is in no source, so none of its lines is excessive; a document given twice counts twice;
    empty tables give an empty result; other columns are ignored.
    """
    fallback = cut(fallback_sources(docs, artifacts, manifest), "sources")
    scanned = cut(scan(docs), "lines")
    bad = cut(excessive(scanned, fallback, totals(docs, fallback), least_docs, least_share), "excessive")
    lines = resolve(scanned.where("lines is not null").select("source", "hash", "doc_id", "lines"), fallback)
    every = lines.where("source is not null").select("source", "doc_id", F.posexplode("lines").alias("at", "key")).where("key <> 0")
    return every.join(bad, ["source", "key"], "left_semi").select("doc_id", (F.col("at") + 1).alias("line_no"))


def without_lines(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the numbered lines taken out of their text; a text of which no line is left becomes empty."""
    gone = lines.groupBy(F.col(key).alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    split = F.split(F.col(text), "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains(F.col("__gone"), i + 1))
    new: Column = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, docs[key] == gone["__key"], "left").withColumn(text, new).drop("__key", "__gone")
