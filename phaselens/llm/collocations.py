"""Phrase collocations: exact phrase counts through broadcast double-array
tries of Apriori-safe candidates.

1. Words are counted per language. A *symbol* is the 64-bit hash of a word
   and its language, so all later steps handle every language at once.
2. Candidates come from the texts in two passes: pairs of frequent words,
   then longer phrases all of whose pairs are frequent. A bitmap of fixed size
   holds the frequent parts; a false hit in it only adds a candidate. Tasks
   combine equal phrases before the shuffle; a phrase under the least count
   can't be a candidate or part of one.
3. The candidates are cut into sets of at most ``max_phrases``. Each set
   becomes a double-array trie over word numbers (child slot = base of the
   parent + word number; ``check`` holds the parent), which is broadcast: its
   size is bounded by ``max_phrases``, whatever the corpus. One pass over the
   texts a set: numpy advances the states of all text positions at once,
   level by level, bincounts accepting states, and the tasks' counts are
   summed. These are the counts that the scores use.
4. Scores, the drop rule and the ranks are joins and windows over the
   candidates, in integers and decimals.

Input cases: a null or empty text has no words; a null language is ``und``
(and one with ``und``); very long texts are one block each; repeated rows and
ids count as often as they stand; ids are not read; extra columns are
ignored; an empty table gives an empty result. Two words with one 64-bit hash
would be counted as one: with 10 million words the chance is 3e-6."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaselens.llm.textops import LOWER, U64, Block, blocks, mix64, small_batches
from phaselens.session import materialize

# Bytes that end a piece (.,;:!? and 0A-0D) and bytes between words.
PIECE_ENDS = tuple(b".,;:!?\n\x0b\x0c\r")
BLANKS = (0x20, 0x09)

_IS_END = np.zeros(256, dtype=bool)
_IS_END[list(PIECE_ENDS)] = True
_IS_GAP = _IS_END.copy()
_IS_GAP[list(BLANKS)] = True
_STEP = U64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Phrases:
    """Parameters of the mining."""

    most_words: int = 4
    least: int = 30  # occurrences of a candidate
    inside_percent: int = 80  # a phrase this often inside a longer one goes
    top: int = 2000  # rows returned a language
    scale: int = 2_000_000
    max_phrases: int = 1 << 19  # of one trie: bounds what is broadcast
    bitmap_bits: int = 26  # log2 of the bits of the filter of frequent parts
    combine: int = 3 << 19  # rows that a task holds before it combines equal ones
    shards_per_core: int = 2  # tasks of the counting pass


# ------------------------------------------------------------ words of texts

def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index, joined) of the words of lower-cased texts;
    ``joined[i]``: words i and i + 1 are neighbours in one piece."""
    data, n = block.data, len(block.data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, np.zeros(0, dtype=bool)
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    solid = ~_IS_GAP[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(block.offsets, start, side="right") - 1
    stops = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(_IS_END[data], out=stops[1:])
    joined = (text[1:] == text[:-1]) & (stops[start[1:]] == stops[end[:-1]])
    return start, end, text, joined


def _lang_seeds(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(number of each row's language, the languages)."""
    codes = langs.fill_null("und").dictionary_encode()
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()


def _seed(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), np.uint8)
    with np.errstate(over="ignore"):
        h = U64(len(raw) + 1)
        for b in raw:
            h = (h ^ U64(b)) * U64(0x100000001B3)
    return int(mix64(np.array([h], U64))[0])


def _symbols(block: Block, start, end, text, lang_of_row, seeds) -> np.ndarray:
    """Symbol of each word. Never 0, which marks an unused place."""
    if not len(start):
        return np.zeros(0, U64)
    s = mix64(block.hash_spans(start, end) ^ seeds[lang_of_row[block.first + text]])
    s[s == 0] = U64(1)
    return s


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(block, start, end, text, joined, symbols, language number of each
    row, languages) of each block of a batch with columns text, lang."""
    rows, langs = _lang_seeds(batch.column(1))
    seeds = np.array([_seed(x) for x in langs], dtype=U64)
    for block in blocks(batch.column(0)):
        block = Block(LOWER[block.data], block.offsets, block.first)
        start, end, text, joined = _words(block)
        yield block, start, end, text, joined, _symbols(block, start, end, text, rows, seeds), rows, langs


# --------------------------------------------------------- counts of words

def _span_strings(block: Block, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as a string array."""
    length = end - start
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    raw = block.data[at].tobytes()
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))


def _count_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        size, totals = 0, {}

        def combined():
            symbol = np.concatenate([h[0] for h in held])
            distinct, first, back = np.unique(symbol, return_index=True, return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            at = pa.array(first)
            return (distinct, count, pa.concat_arrays([h[2] for h in held]).take(at),
                    pa.concat_arrays([h[3] for h in held]).take(at))

        def out(x):
            return pa.RecordBatch.from_arrays(
                [x[2].cast(pa.string()), x[3].cast(pa.string()), pa.array(x[0].view(np.int64)), pa.array(x[1])],
                ["lang", "word", "symbol", "f"])

        for batch in batches:
            for block, start, end, text, _, symbol, rows, langs in _read(batch):
                if not len(symbol):
                    continue
                distinct, first, count = np.unique(symbol, return_index=True, return_counts=True)
                number = rows[block.first + text]
                for i, c in enumerate(np.bincount(number, minlength=len(langs)).tolist()):
                    totals[langs[i]] = totals.get(langs[i], 0) + c
                names = pa.array(langs, pa.large_string()).take(pa.array(number[first]))
                held.append((distinct, count, names, _span_strings(block, start[first], end[first])))
                size += len(distinct)
                if size > most:
                    held = [combined()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(combined())
        if totals:  # all words of a language: a row without a word
            names = list(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.nulls(len(names), pa.string()), pa.nulls(len(names), pa.int64()),
                 pa.array([totals[x] for x in names], pa.int64())], ["lang", "word", "symbol", "f"])

    return run


# ---------------------------------------------------- candidates by Apriori

def _grams(symbol: np.ndarray, joined: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position on, and whether they lie in one
    piece; both of the length of ``symbol``."""
    n = len(symbol)
    h, ok = symbol.copy(), np.ones(n, dtype=bool)
    for j in range(1, k):
        live = max(n - j, 0)
        ok[live:] = False
        ok[:live] &= joined[j - 1:]
        h[:live] = mix64(h[:live] * _STEP + symbol[j:])
    return h, ok


def _bit_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    slot = h >> U64(64 - bits)
    return (slot >> U64(6)).astype(np.int64), U64(1) << (slot & U64(63))


def _frequent_bits(k: int, bits: int):
    """Bits of the filter that the frequent phrases of k words set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [batch.column(j).to_numpy(zero_copy_only=False).view(U64) for j in range(k)]
            h = s[0].copy()
            for j in range(1, k):
                h = mix64(h * _STEP + s[j])
            at, bit = _bit_of(h, bits)
            order = np.argsort(at, kind="stable")
            at, bit = at[order], bit[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], ["at", "bit"])

    return run


def _filter(frequent: DataFrame, k: int, bits: int) -> np.ndarray:
    """The filter as an array of ``2 ** bits`` bits: its size is fixed, and
    tasks or-combine their parts before one row per 64 bits is fetched."""
    parts = (frequent.select(*[f"s{j + 1}" for j in range(k)]).mapInArrow(_frequent_bits(k, bits), "at long, bit long")
             .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
    words = np.zeros(1 << (bits - 6), dtype=U64)
    words[parts["at"].to_numpy()] = parts["bit"].to_numpy().view(U64)
    return words


def _candidates(part: int, longest: int, frequent: np.ndarray, bits: int, most: int):
    """Phrases of ``part + 1`` to ``longest`` words all of whose parts of
    ``part`` words pass the filter, equal ones combined, with their counts."""
    names = [f"s{j + 1}" for j in range(longest)] + ["f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def combined():
            gram = np.concatenate([h[0] for h in held])
            distinct, first, back = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
            return distinct, np.concatenate([h[1] for h in held])[first], count

        def out(x):
            for i in range(0, len(x[0]), 1 << 17):
                piece = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(x[1][piece, j]).view(np.int64)) for j in range(longest)]
                    + [pa.array(x[2][piece])], names)

        for batch in batches:
            for _, _, _, _, joined, symbol, _, _ in _read(batch):
                gram, ok = _grams(symbol, joined, part)
                at, bit = _bit_of(gram, bits)
                good = ok & ((frequent[at] & bit) != 0)
                here = np.flatnonzero(good)
                for k in range(part + 1, longest + 1):
                    # one word more: the next part of each phrase must pass as well
                    here = here[here + k <= len(symbol)]
                    here = here[good[here + k - part] & joined[here + k - 2]]
                    if not len(here):
                        break
                    gram[here] = mix64(gram[here] * _STEP + symbol[here + k - 1])
                    distinct, first, count = np.unique(gram[here], return_index=True, return_counts=True)
                    own = np.zeros((len(first), longest), dtype=U64)
                    for j in range(k):
                        own[:, j] = symbol[here[first] + j]
                    held.append((distinct, own, count))
                    size += len(distinct)
                if size > most:
                    held = [combined()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(combined())

    return run


# ------------------------------------------------------- double-array tries

@dataclass
class DoubleArray:
    """A trie over word numbers 1..V. ``base[s] + c`` is the slot of the child
    of ``s`` by ``c`` if ``check`` of that slot is ``s``; the root is slot 0;
    ``phrase[slot]`` is the number of the phrase that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray

    def advance(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none (or was none)."""
        slot = self.base[state] + word
        slot = np.where((state >= 0) & (word > 0), slot, 0)
        return np.where((slot > 0) & (self.check[slot] == state), slot, -1)


def build_trie(words: np.ndarray) -> DoubleArray:
    """The trie of distinct phrases: rows of word numbers, 0 beyond the end."""
    m, width = words.shape
    top = int(words.max(initial=0)) + 1
    # nodes, level by level: distinct (parent, word) pairs; node 0 is the root
    node, parents, codes, ends = np.zeros(m, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(m, np.int64)
    nodes = 1
    for j in range(width):
        live = np.flatnonzero(words[:, j] > 0)
        if not len(live):
            break
        key, back = np.unique(node[live] * top + words[live, j], return_inverse=True)
        node[live] = nodes + back
        ends[live] = node[live]
        parents.append(key // top)
        codes.append(key % top)
        nodes += len(key)
    parent, code = np.concatenate(parents), np.concatenate(codes)  # of nodes 1..
    order = np.argsort(parent, kind="stable")
    inner, first, kids = np.unique(parent[order], return_index=True, return_counts=True)
    size = 1 << max(4, int(np.ceil(np.log2(4 * nodes + top + 1))))
    used = np.zeros(size, dtype=bool)
    used[0] = True
    slot, base_of = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    rng = np.random.default_rng(1)

    def place(i: int, at: int, own: np.ndarray) -> None:
        base_of[inner[i]] = at
        slot[own + 1] = at + code[own]
        used[at + code[own]] = True

    by_size = np.argsort(-kids, kind="stable")
    large = by_size[kids[by_size] > 6]
    for i in large.tolist():  # many children first, while most slots are free
        own = order[first[i]: first[i] + kids[i]]
        own_codes = code[own]
        while True:
            tries = np.r_[0, rng.integers(0, len(used) - top, 255)] if inner[i] == 0 else rng.integers(0, len(used) - top, 256)
            free = np.flatnonzero(~used[tries[:, None] + own_codes[None, :64]].any(axis=1))
            good = next((int(tries[x]) for x in free.tolist() if not used[tries[x] + own_codes].any()), None)
            if good is not None:
                break
            used = np.r_[used, np.zeros(len(used) // 4 + top, dtype=bool)]
        place(i, good, own)
    rest = by_size[kids[by_size] <= 6]
    while len(rest):  # all others at once: a draw for each, kept where nothing clashes
        many = kids[rest]
        own = order[np.repeat(first[rest] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        owner = np.repeat(np.arange(len(rest)), many)
        at = rng.integers(0, len(used) - top, len(rest))
        want = at[owner] + code[own]
        _, once, times = np.unique(want, return_index=True, return_counts=True)
        lone = np.zeros(len(want), dtype=bool)
        lone[once] = True  # the first that asks for a slot may have it
        bad = np.bincount(owner, weights=~lone | used[want], minlength=len(rest)) > 0
        fine = ~bad[owner]
        base_of[inner[rest[~bad]]] = at[~bad]
        slot[own[fine] + 1] = want[fine]
        used[want[fine]] = True
        rest = rest[bad]
    base = np.zeros(len(used), np.int32)
    check = np.full(len(used), -1, np.int32)
    phrase = np.full(len(used), -1, np.int32)
    base[slot[inner]] = base_of[inner]
    check[slot[1:]] = slot[parent]
    phrase[slot[ends]] = np.arange(m)
    return DoubleArray(base, check, phrase)


@dataclass
class TrieSet:
    """What one pass broadcasts: symbols (sorted) and texts of the words, the
    trie over their numbers, and each phrase's word numbers."""

    symbol: np.ndarray
    word: pa.Array
    lang: pa.Array
    trie: DoubleArray
    phrases: np.ndarray


def _trie_set(phrases: pa.Table, words: pa.Table, width: int) -> TrieSet:
    symbol = words["symbol"].to_numpy().view(U64)
    order = np.argsort(symbol)
    symbol = symbol[order]
    s = np.stack([phrases[f"s{j + 1}"].to_numpy().view(U64) for j in range(width)], axis=1)
    numbers = np.where(s == 0, 0, np.searchsorted(symbol, s) + 1).astype(np.int64)
    at = pa.array(order)
    return TrieSet(symbol, words["word"].combine_chunks().take(at), words["lang"].combine_chunks().take(at),
                   build_trie(numbers), numbers.astype(np.int32))


def _count_phrases(shared, width: int):
    """Accepting states of all positions of a task's texts, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: TrieSet = shared.value
        counts = np.zeros(len(t.phrases), dtype=np.int64)
        for batch in batches:
            for _, _, _, _, joined, symbol, _, _ in _read(batch):
                n = len(symbol)
                if n < 2:
                    continue
                at = np.minimum(np.searchsorted(t.symbol, symbol), len(t.symbol) - 1)
                word = np.where(t.symbol[at] == symbol, at + 1, 0)
                here = np.flatnonzero(word > 0)
                state = t.trie.advance(np.zeros(len(here), np.int64), word[here])
                for j in range(1, width):
                    here, state = here[state >= 0], state[state >= 0]
                    inside = here + j < n
                    here, state = here[inside], state[inside]
                    near = joined[here + j - 1]
                    here, state = here[near], state[near]
                    state = t.trie.advance(state, word[here + j])
                    ended = t.trie.phrase[state[state >= 0]]
                    counts += np.bincount(ended[ended >= 0], minlength=len(counts))
        found = np.flatnonzero(counts)
        for i in range(0, len(found), 1 << 17):
            part = found[i: i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["phrase", "a"])

    return run


def _spell(shared):
    """Language, words and text of numbered phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        t: TrieSet = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            number = t.phrases[batch.column(0).to_numpy(zero_copy_only=False)]
            cols = [t.word.take(pa.array(number[:, j] - 1, mask=number[:, j] == 0)) for j in range(number.shape[1])]
            yield pa.RecordBatch.from_arrays(
                [t.lang.take(pa.array(number[:, 0] - 1)).cast(pa.string()), pa.array((number > 0).sum(axis=1).astype(np.int32)),
                 pc.binary_join_element_wise(*cols, " ", null_handling="skip").cast(pa.string()), batch.column(1)],
                ["lang", "k", "phrase", "a"])

    return run


# ------------------------------------------------------------ the operator

def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *,
                  params: Phrases = Phrases()) -> tuple[DataFrame, DataFrame]:
    """(words, phrases). ``words``: lang, word, symbol, f of each word of at
    least ``least`` occurrences, and per language a row without a word whose f
    counts all words. ``phrases``: lang, k, phrase, a of each phrase of 2 to
    ``most_words`` words with a >= ``least``."""
    spark, p = docs.sparkSession, params
    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = materialize(
        texts.mapInArrow(_count_words(p.combine), "lang string, word string, symbol long, f long")
        .groupBy("lang", "word").agg(F.min("symbol").alias("symbol"), F.sum("f").alias("f"))
        .where(F.col("word").isNull() | (F.col("f") >= p.least)), "phrase-words")
    names = [f"s{j + 1}" for j in range(p.most_words)]
    single = words.where("word is not null").select(F.col("symbol").alias("s1"))

    def candidates(frequent: DataFrame, part: int, longest: int) -> DataFrame:
        own, bits = names[:longest], _filter(frequent, part, p.bitmap_bits)
        return materialize(
            texts.mapInArrow(_candidates(part, longest, bits, p.bitmap_bits, p.combine), ", ".join(f"{s} long" for s in [*own, "f"]))
            .groupBy(*own).agg(F.sum("f").alias("f")).where(F.col("f") >= p.least).select(*own), f"phrase-candidates-{longest}")

    pairs = candidates(single, 1, 2)
    found = pairs.select("s1", "s2", *[F.lit(0).cast("long").alias(s) for s in names[2:]])
    if p.most_words > 2:
        found = found.unionByName(candidates(pairs, 2, p.most_words))
    sets = max(1, -(-found.count() // p.max_phrases))
    found = found.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(sets)))
    counted = [_counted(spark, texts, found.where(F.col("part") == i).drop("part"), words, names, p) for i in range(sets)]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return words, out.where(F.col("a") >= p.least)


def _counted(spark: SparkSession, texts: DataFrame, phrases: DataFrame, words: DataFrame, names: list[str], p: Phrases) -> DataFrame:
    """One pass: the counts of one bounded set of phrases. Its size follows
    ``max_phrases`` by the hash that deals the phrases to the sets."""
    own = phrases.select(F.explode(F.array(*names)).alias("symbol")).where("symbol <> 0").distinct()
    vocabulary = words.where("word is not null").join(own, "symbol", "left_semi").select("symbol", "word", "lang")
    table = phrases.toArrow()
    schema = "lang string, k int, phrase string, a long"
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(_trie_set(table, vocabulary.toArrow(), len(names)))
    # a task returns up to all phrases, so tasks follow the cores, not the bytes
    shards = texts.coalesce(p.shards_per_core * spark.sparkContext.defaultParallelism)
    out = materialize(shards.mapInArrow(_count_phrases(shared, len(names)), "phrase long, a long")
                      .groupBy("phrase").agg(F.sum("a").alias("a")).mapInArrow(_spell(shared), schema), "phrase-counts")
    shared.unpersist()
    return out


def _part(first, length) -> F.Column:
    return F.array_join(F.slice("_w", first, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *,
                 params: Phrases = Phrases()) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a
    (occurrences), l and r (occurrences of the two parts at the cut with the
    lowest score), n (all words of the language), score."""
    p = params
    words, phrases = phrase_counts(docs, text_col, lang_col, params=p)
    counts = (words.where("word is not null").select("lang", F.col("word").alias("part"), F.col("f").alias("c"))
              .unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("c"))))
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    split = phrases.withColumn("_w", F.split("phrase", " "))
    cuts = split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"),
        _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    with_l = cuts.join(counts.withColumnsRenamed({"part": "left", "c": "l"}), ["lang", "left"])
    with_r = with_l.join(counts.withColumnsRenamed({"part": "right", "c": "r"}), ["lang", "right"])
    # whole numbers throughout: DECIMAL holds the product, DIV floors
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {p.scale}BD) div CAST(l + r AS DECIMAL(20, 0))")
    scored = with_r.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # the largest count of a longer phrase around each shorter one
    spans = [(i, k) for k in range(2, p.most_words) for i in range(1, p.most_words - k + 2)]
    inner = F.filter(F.array(*[F.when((F.col("k") > k) & (F.col("k") >= i + k - 1), _part(F.lit(i), F.lit(k))) for i, k in spans]),
                     lambda x: x.isNotNull())
    around = (split.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | F.expr(f"100BD * longer < {p.inside_percent}BD * a"))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most candidates: the first of each share, then of all
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = kept.withColumn("_i", F.row_number().over(share)).where(F.col("_i") <= p.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= p.top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))


#: The same rows by n-gram lists and grouping, for DuckDB.
ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (
  select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
  from worded, (values (1), (2), (3), (4)) t(k)),
counts as materialized (select lang, k, phrase, count(*)::bigint as a from grams group by all having count(*) >= 30),
candidates as materialized (select *, string_split(phrase, ' ') as w from counts where k >= 2),
parts as materialized (
  select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as left_part, array_to_string(w[cut + 1:], ' ') as right_part
  from candidates, (values (1), (2), (3)) j(cut) where cut < k),
cuts as materialized (
  select p.lang, p.phrase, p.a, p.cut, l.a as l, r.a as r,
         ((2000000::hugeint * p.a) // (l.a + r.a)) as score
  from parts p join counts l on l.lang = p.lang and l.phrase = p.left_part
  join counts r on r.lang = p.lang and r.phrase = p.right_part),
scored as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
around as (
  select lang, array_to_string(w[i.i:i.i + s.s - 1], ' ') as phrase, max(a) as longer
  from candidates, (values (1), (2), (3)) i(i), (values (2), (3)) s(s)
  where s.s < k and i.i + s.s - 1 <= k group by all),
kept as (
  select s.* from scored s left join around o on o.lang = s.lang and o.phrase = s.phrase
  where o.longer is null or 100::hugeint * o.longer < 80::hugeint * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank::bigint as rank, r.phrase, r.a, r.l, r.r, t.n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
