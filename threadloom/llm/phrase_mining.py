r"""Collocations by pivot partitioning: each n-gram is mined where its rarest word is.

The words of a language are ordered from rare to frequent (ties by the word). Every
place of a text gives a fragment: the word there, the pivot, with up to two words on either side,
rewritten so that it ends at the piece's ends, at words too rare for any
candidate and at words before the pivot in that order. A fragment thus holds
just those n-grams around its place whose rarest word is the pivot (of
equal words in an n-gram the first is). Fragments are counted per block of text, sent to their pivot, and
each pivot's n-grams are counted there and nowhere else; what is too rare ends
there. Hot words own little, since all that they own consists of hotter ones;
a pivot of more than ``PIVOT_ROWS`` occurrences is dealt over as many shares as that goes into it, whose sums meet at the end.

Steps: texts become blocks of word numbers with a dictionary each (one pass in Arrow, kept in
the shared folder); dictionaries give the frequencies; frequent words' places in
that order go back to the blocks by a join; fragments, mining, scores. No word list is
broadcast or collected, and no task holds more than a block or a text.

Defined cases: null and empty texts have no words; a null language is ``und``; a very long text is cut into blocks between
its pieces, a piece never; repeated rows count as often as they occur; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, keep

#: Words of a block; occurrences of a pivot that one task may get; parts in which a language's phrases are ranked first.
BLOCK_WORDS, PIVOT_ROWS, RANK_PARTS = 400_000, 1_000_000, 32
#: Ends of pieces become line feeds, tabs become spaces.
_CUT = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_SLICE = 1 << 20
BLOCKS = "block long, langs array<string>, totals array<long>, lang array<string>, word array<string>, n array<long>, tokens binary"
FRAGMENTS = "pivot long, share int, l2 long, l1 long, r1 long, r2 long, n long"


def pieces(text: bytes) -> list[bytes]:
    """The pieces of a text, A to Z lower-cased, words set apart by spaces."""
    return text.lower().translate(_CUT).split(b"\n")


def _slices(piece: bytes) -> Iterator[bytes]:
    """A piece in parts of about a megabyte that end between words."""
    at = 0
    while len(piece) - at > _SLICE:
        end = piece.find(b" ", at + _SLICE)
        if end < 0:
            break
        yield piece[at:end]
        at = end
    yield piece[at:]


class _Block:
    """Word numbers of some pieces; -1 ends each piece. A number belongs to one word of one language."""

    def __init__(self):
        number = count().__next__
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number))
        self.tokens = array("i")

    def add(self, lang: str, piece: bytes) -> None:
        of = self.numbers[lang].__getitem__
        for part in _slices(piece):
            self.tokens.extend(map(of, part.split()))
        self.tokens.append(-1)

    def row(self, name: int) -> pa.RecordBatch:
        tokens = np.frombuffer(self.tokens, np.int32)
        pairs = sorted((i, lang, word) for lang, of in self.numbers.items() for word, i in of.items())
        n = np.bincount(tokens[tokens >= 0], minlength=len(pairs))
        totals = {lang: int(n[list(of.values())].sum()) if of else 0 for lang, of in self.numbers.items()}
        words = pa.array([p[2] for p in pairs], pa.binary()).cast(pa.string())
        values = [
            pa.array([name], pa.int64()), pa.array([list(totals)], pa.list_(pa.string())), pa.array([list(totals.values())], pa.list_(pa.int64())),
            pa.array([[p[1] for p in pairs]], pa.list_(pa.string())), pa.ListArray.from_arrays([0, len(words)], words),
            pa.array([n], pa.list_(pa.int64())), pa.array([tokens.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["block", "langs", "totals", "lang", "word", "n", "tokens"])


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts as word numbers, each with its dictionary and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, block = TaskContext.get().partitionId(), count(), _Block()
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                for piece in pieces(batch.column(1)[i].as_py()):
                    if piece:
                        block.add(lang, piece)
                        if len(block.tokens) >= BLOCK_WORDS:
                            yield block.row((task << 32) + next(number))
                            block = _Block()
        if block.tokens:
            yield block.row((task << 32) + next(number))

    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, BLOCKS)


def dictionary(blocks: DataFrame) -> DataFrame:
    """block, pos, lang, word, n of every word of every block."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("pos", "w"))
    return rows.select("block", "pos", "w.lang", "w.word", "w.n")


def ordered_words(words: DataFrame, least: int) -> DataFrame:
    """id, lang, word, f of the words that occur often enough; ids ascend with (f, lang, word). Keep it: ids hold for one writing."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    order = ["f", "lang", "word"]
    return often.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f")


def rewrite(tokens: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct fragments of a block, as columns l2, l1, pivot, r1, r2 of ids (-1: none) and their counts."""
    known = np.sort(ids)
    rank = np.zeros(max(int(tokens.max(initial=-1)), int(pos.max(initial=-1))) + 2, np.int64)  # the last place is that of -1
    rank[pos] = np.searchsorted(known, ids) + 1
    r = np.concatenate([[0, 0], rank[tokens], [0, 0]])
    p = r[2:-2]
    l1 = np.where(r[1:-3] > p, r[1:-3], 0)
    l2 = np.where((l1 > 0) & (r[:-4] > p), r[:-4], 0)
    r1 = np.where(r[3:-1] >= p, r[3:-1], 0)
    r2 = np.where((r1 > 0) & (r[4:] >= p), r[4:], 0)
    held = np.flatnonzero((p > 0) & ((l1 > 0) | (r1 > 0)))
    bits = int(len(known)).bit_length()
    left, mid, right = (l2[held] << bits) | l1[held], p[held], (r1[held] << bits) | r2[held]
    order = np.lexsort((right, left, mid))
    left, mid, right = left[order], mid[order], right[order]
    first = np.ones(len(order), bool)
    first[1:] = (left[1:] != left[:-1]) | (mid[1:] != mid[:-1]) | (right[1:] != right[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(order)))
    back = np.concatenate([[-1], known])
    low = (1 << bits) - 1
    columns = (left[starts] >> bits, left[starts] & low, mid[starts], right[starts] >> bits, right[starts] & low)
    return (*(back[c] for c in columns), counts)


def fragments(blocks: DataFrame, words: DataFrame, order: DataFrame) -> DataFrame:
    """The rewritten fragments of every block, counted per block, with their pivot and its share (0: the pivot has but one)."""
    placed = words.join(order, ["lang", "word"]).select("block", "pos", "id", F.ceil(F.col("f") / PIVOT_ROWS).cast("int").alias("shares"))
    per_block = placed.groupBy("block").agg(*(F.collect_list(c).alias(c) for c in ("pos", "id", "shares")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FRAGMENTS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                pos, ids, shares = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                l2, l1, pivot, r1, r2, n = rewrite(np.frombuffer(batch.column(0)[i].as_buffer(), np.int32), pos, ids)
                by_id = np.argsort(ids)
                of = shares[by_id][np.searchsorted(ids[by_id], pivot)].astype(np.int32)
                share = np.where(of > 1, 1 + (l1 * 31 + r1 * 17 + l2 * 7 + r2) % of, 0).astype(np.int32)
                for cut in range(0, len(n), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c[cut : cut + 65536]) for c in (pivot, share, l2, l1, r1, r2, n)], names=names)

    return blocks.select("block", "tokens").join(per_block, "block").select("tokens", "pos", "id", "shares").mapInArrow(run, FRAGMENTS)


def mine(parts: DataFrame, least: int, longest: int = 3) -> DataFrame:
    """w1, w2, w3 (null in pairs) and a, the count, of the n-grams that occur often enough: counted at their pivot, by share, without a second shuffle."""
    none = F.lit(None).cast("long")

    def gram(*w: str) -> Column:
        return F.when(F.greatest(*(F.when(F.col(c) < 0, 1).otherwise(0) for c in w)) == 0, F.struct(*(F.col(c).alias(f"w{k}") for k, c in enumerate(w, 1)), *([none.alias("w3")] if len(w) == 2 else [])))

    grams = [gram("l1", "pivot"), gram("pivot", "r1")]
    if longest == 3:
        grams += [gram("l2", "l1", "pivot"), gram("l1", "pivot", "r1"), gram("pivot", "r1", "r2")]
    dealt = parts.repartition("pivot", "share").select("pivot", "share", "n", F.explode(F.array_compact(F.array(*grams))).alias("g"))
    local = dealt.groupBy("pivot", "share", "g.w1", "g.w2", "g.w3").agg(F.sum("n").alias("a"))
    left = local.filter((F.col("share") > 0) | (F.col("a") >= least))
    return left.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def covered(grams: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer one accounts for: none holds them in at least ``percent`` of their occurrences."""
    triples = grams.filter("w3 is not null")
    inner = triples.select("w1", "w2", F.col("a").alias("longer")).unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer")))
    most = inner.groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
    pairs = grams.filter("w3 is null").join(most, ["w1", "w2"], "left").filter(f"longer is null or 100 * longer < {percent} * a")
    return pairs.select("w1", "w2", "w3", "a").unionByName(triples.select("w1", "w2", "w3", "a"))


def _score(left: str, right: str) -> Column:
    whole = f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
    return F.expr(f"({whole}) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def scored(grams: DataFrame, order: DataFrame, percent: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that stay: their lowest cut, exact in 38 digits."""
    pairs = grams.filter("w3 is null")
    found = covered(grams, percent)
    for k in (1, 2, 3):
        found = found.join(order.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])), f"w{k}", "left")
    for a, b in ((1, 2), (2, 3)):
        found = found.join(pairs.select(F.col("w1").alias(f"w{a}"), F.col("w2").alias(f"w{b}"), F.col("a").alias(f"f{a}{b}")), [f"w{a}", f"w{b}"], "left")
    pair = F.col("w3").isNull()
    found = found.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "f1", "f3", "f12", F.when(pair, F.col("f2")).otherwise(F.col("f23")).alias("rest"), pair.alias("pair"))
    found = found.withColumn("first", _score("f1", "rest")).withColumn("second", F.when(~F.col("pair"), _score("f12", "f3")))
    late = ~F.col("pair") & (F.col("second") < F.col("first"))
    return found.select(
        "lang", "phrase", "a",
        F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("rest")).alias("r"), F.when(late, F.col("second")).otherwise(F.col("first")).alias("score"),
    )


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """Each language's best phrases of two or three words: lang, rank, phrase, a, l, r, n, score."""
    blocks = keep(encode_blocks(docs), "phrase-blocks")
    words = dictionary(blocks)
    order = keep(ordered_words(words, least), "phrase-words")
    grams = keep(mine(fragments(blocks, words, order), least), "phrase-grams")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    parts = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS))).orderBy(*best)
    few = scored(grams, order, percent).withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
