"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs (lines with their line break), grouped into sections;
a section's digest is the digest of its paragraphs' digests, the root that of
its sections' digests. A section ends at a blank line or, content-defined,
after a paragraph whose digest says so (one in four), so an insertion moves
no section boundary but its own. Equal roots mean equal texts; comparing two
trees descends only into branches that differ and so locates an edit.

Every paragraph also carries short digests of its pieces (runs of words that
end content-defined, after one word in four, or after eight). They add no authority to the tree but
say how alike two differing paragraphs are: the likeness of two fingerprints
is 1 if the roots are equal, else the Dice share of common pieces over the
pieces of both (below 1).

Written form: ``root|section;section``, a section being
``digest:paragraph/paragraph`` and a paragraph ``digest,piece piece``, all in
hexadecimal.

Input cases: a null text is the empty text, a tree without sections whose
likeness to another empty text is 1 and to any other 0; very long texts cost
linear time; for the order of documents see :func:`fingerprint_documents`;
extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.textops import U64, Block, blocks, small_batches
from phaselens.session import discard, materialize

SECTION_SIZE = 4  # paragraphs a section, on average
PIECE_SIZE = 4  # a piece ends after one word in so many
PIECE_MOST = 8  # words


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=8).digest()


@dataclass(frozen=True)
class Paragraph:
    digest: bytes
    pieces: bytes  # 4 bytes each


@dataclass(frozen=True)
class Tree:
    root: bytes
    sections: tuple[tuple[bytes, tuple[Paragraph, ...]], ...]

    def pieces(self) -> np.ndarray:
        """The sorted piece digests of the whole text."""
        return np.sort(np.frombuffer(b"".join(p.pieces for _, s in self.sections for p in s), dtype=">u4"))

    def write(self) -> str:
        return self.root.hex() + "|" + ";".join(
            d.hex() + ":" + "/".join(p.digest.hex() + "," + p.pieces.hex(" ", 4) for p in s)
            for d, s in self.sections)


def read_tree(text: str) -> Tree:
    """The tree of a written fingerprint."""
    root, _, rest = text.partition("|")
    sections = []
    for part in filter(None, rest.split(";")):
        digest, _, paragraphs = part.partition(":")
        own = []
        for p in paragraphs.split("/"):
            d, _, pieces = p.partition(",")
            own.append(Paragraph(bytes.fromhex(d), bytes.fromhex(pieces)))
        sections.append((bytes.fromhex(digest), tuple(own)))
    return Tree(bytes.fromhex(root), tuple(sections))


def trees(block: Block) -> list[Tree]:
    """The trees of the texts of a block."""
    n = len(block.data)
    if n == 0:
        return [Tree(hashlib.blake2b(digest_size=16).digest(), ())] * block.n_texts
    start, end, _ = block.words()
    line = np.union1d(block.offsets[:-1], np.flatnonzero(block.data == 0x0A) + 1)
    line = line[line < n]
    # a piece ends after a word whose hash says so, and with its paragraph
    last = block.hash_spans(start, end) % U64(PIECE_SIZE) == 0
    at = np.arange(len(start))
    fresh = np.r_[True, last[:-1]][: len(at)]
    fresh[np.searchsorted(start, line)[np.searchsorted(start, line) < len(at)]] = True
    since = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(at) else at
    last |= since % PIECE_MOST == PIECE_MOST - 1
    word_ends = end[last]
    piece = np.union1d(line, word_ends[word_ends < n])
    piece_end = np.r_[piece[1:], n]
    short = (block.hash_spans(piece, piece_end) >> U64(32)).astype(">u4").tobytes()
    raw = block.data.tobytes()
    line_end = np.r_[line[1:], n]
    first_piece = np.searchsorted(piece, line).tolist() + [len(piece)]
    of_text = np.searchsorted(line, block.offsets).tolist()
    line, line_end = line.tolist(), line_end.tolist()
    out = []
    for a, b in zip(of_text, of_text[1:]):
        sections, own = [], []
        for k in range(a, b):
            content = raw[line[k]: line_end[k]]
            p = Paragraph(_digest(content), short[4 * first_piece[k]: 4 * first_piece[k + 1]])
            own.append(p)
            if p.digest[0] % SECTION_SIZE == 0 or not content.strip():
                sections.append(own)
                own = []
        if own:
            sections.append(own)
        done = tuple((_digest(b"".join(p.digest for p in s)), tuple(s)) for s in sections)
        out.append(Tree(hashlib.blake2b(b"".join(d for d, _ in done), digest_size=16).digest(), done))
    return out


def likeness(x: Tree, y: Tree, x_pieces: np.ndarray | None = None, y_pieces: np.ndarray | None = None) -> float:
    """How alike two texts are by their fingerprints alone, 0 to 1."""
    if x.root == y.root:
        return 1.0
    a = x.pieces() if x_pieces is None else x_pieces
    b = y.pieces() if y_pieces is None else y_pieces
    if not len(a) or not len(b):
        return 0.0
    # common pieces with multiplicity
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return min(2.0 * float(np.minimum(na[i], nb[j]).sum()) / (len(a) + len(b)), 1.0 - 1e-9)


def differing(x: Tree, y: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``y``, from 0, where it holds something that
    ``x`` does not: only sections without an equal digest are looked into."""
    known = Counter(d for d, _ in x.sections)
    left = Counter(p.digest for d, s in x.sections for p in s)
    out = []
    for i, (d, s) in enumerate(y.sections):
        if known[d] > 0:
            known[d] -= 1
            left.subtract(p.digest for p in s)
            continue
        for j, p in enumerate(s):
            if left[p.digest] > 0:
                left[p.digest] -= 1
            else:
                out.append((i, j))
    return out


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by the beginning of
    ``following``, as many code points or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Ranges at most; their upper ends are all that one task and the driver receive.
MAX_RANGES = 100_000


def _range_of(tops: Column, key: Column) -> Column:
    """Number of the first of the ascending ``tops`` that is not below the key."""
    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        low = F.get(tops, mid) < key
        moved = F.when(low, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo >= hi, acc).otherwise(moved)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(tops) + F.lit(1.0))).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), (F.size(tops) - 1).alias("hi")), step)["lo"]


def _in_order(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int) -> DataFrame:
    """Rows (range, guest, doc_id, text, copies), each range sorted by
    descending id in one partition and followed by the first row of the next
    range (its guest; the last range is followed by the first row of all).

    The order is that of (id, hash of the text) in the id's own type, and
    ranges are cut on both, so an id on many rows is split. Wholly equal rows
    that would fill a range of their own are one row with a count."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ascending keys are the reverse of the order of documents: falling ids, null ids last, rising hashes
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_key", F.struct("doc_id", F.bitwise_not("_tie").alias("t")))
    keys = materialize(rows.select("_key"), "merkle-keys")
    many = keys.count()
    most = max(rows_per_range, -(-many // MAX_RANGES))
    heavy = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    heavy = spark.createDataFrame(heavy.toArrow(), heavy.schema)  # at most MAX_RANGES: each is larger than a range
    ends = (keys.join(F.broadcast(heavy), "_key", "left_anti").unionByName(heavy.select("_key"))
            .repartitionByRange(max(1, -(-many // most)), "_key").groupBy(F.spark_partition_id().alias("_p")).agg(F.max("_key").alias("top"))
            .agg(F.sort_array(F.collect_list("top")).alias("tops")))
    ends = spark.createDataFrame(ends.toArrow(), ends.schema)  # at most MAX_RANGES keys
    discard(keys)
    kept = rows.join(F.broadcast(heavy), "_key", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    if not heavy.isEmpty():
        kept = kept.unionByName(rows.join(F.broadcast(heavy), "_key").groupBy("_key").agg(F.first("text").alias("text"), F.first("_n").alias("copies"))
                                .select("_key.doc_id", "text", F.xxhash64("text").alias("_tie"), "_key", "copies"))
    placed = kept.withColumn("_tops", ends.scalar()).withColumn("_at", _range_of(F.col("_tops"), F.col("_key")))
    last = F.size("_tops") - 1
    own = F.struct((last - F.col("_at")).alias("range"), F.lit(False).alias("guest"))
    # the first row of a range also follows the range before, in a circle
    before = F.struct(F.when(F.col("_at") == last, last).otherwise(last - F.col("_at") - 1).alias("range"), F.lit(True).alias("guest"))
    lead = F.get("_tops", F.col("_at")) == F.col("_key")
    dealt = placed.select(F.explode(F.when(lead, F.array(own, before)).otherwise(F.array(own))).alias("_to"), "doc_id", "text", "_tie", "copies")
    return (dealt.select("_to.range", "_to.guest", "doc_id", "text", "copies", "_tie").repartition("range")
            .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "_tie", "text").drop("_tie"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                          rows_per_range: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_chars``, the fingerprint, the
    edited text's SHA-256 and fingerprint, and the likeness of the fingerprint
    to the edited text's and to the next document's.

    The next document is the one with the next lower id (of text ids, the next
    in reverse order), after the last the first; null ids come last, rows of
    one id stand in the order of their texts' hashes. Texts are shuffled once,
    by ranges of ids and hashes; at each range's edge one row goes to two
    ranges. Wholly equal rows that would fill a range are compared once."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
              T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
              T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
              T.StructField("near_next", T.DoubleType()), T.StructField("_copies", T.LongType())]
    names = [f.name for f in fields]

    def compared(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """Result rows for rows (id, text, tree, pieces, copies, next row)."""
        texts = [edited(text, following[1]) for _, text, _, _, _, following in rows]
        done = [t for block in blocks(pa.array(texts, pa.large_string())) for t in trees(block)]
        cols = [pa.array([r[0] for r in rows], id_type), pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in texts], pa.string()),
                pa.array([r[2].write() for r in rows], pa.string()), pa.array([t.write() for t in done], pa.string()),
                pa.array([likeness(r[2], t, r[3]) for r, t in zip(rows, done)], pa.float64()),
                pa.array([likeness(r[2], r[5][2], r[3], r[5][3]) for r in rows], pa.float64()),
                pa.array([r[4] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, if its next one has not come yet, and its range
        for batch in batches:
            for block in blocks(batch.column(3)):
                raw, off = block.data.tobytes(), block.offsets.tolist()
                here = batch.slice(block.first, block.n_texts)
                rows = []
                for where, guest, i, copies, a, b, tree in zip(*(here.column(j).to_pylist() for j in (0, 1, 2, 4)), off, off[1:], trees(block)):
                    row = (i, raw[a:b].decode(), tree, tree.pieces())
                    if held is not None and held[0] == where:
                        rows.append((*held[1], 1, row))
                    if copies > 1 and not guest:  # all but the last of equal rows are followed by an equal one
                        rows.append((*row, copies - 1, row))
                    held = None if guest else (where, row)  # a guest only closes its range
                yield compared(rows, batch.schema.field(2).type)

    found = _in_order(docs, id_col, text_col, rows_per_range).mapInArrow(run, T.StructType(fields))
    return found.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
