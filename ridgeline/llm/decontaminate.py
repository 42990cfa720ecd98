"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores the alignment.

One scan of the texts keeps the passages that hold an n-gram of any item, by a Bloom filter of bounded size, with the words
around them. Their n-grams are counted, the rarest of every item become its seeds, and passages and items meet by a join on
seeds. Nothing is held for all items but the filter's bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.shared import BLOOM, SMALL_BATCHES, materialize, table
from ridgeline.llm.words import PLACES, Words, mixed, pieces, shingles_of, words_of

GRAM = 3
#: Items are aligned in segments of so many words, the last up to twice as long.
SEGMENT = 128
#: Words of a text whose n-grams are a passage's own, and the words on either side that an alignment with them may need.
PASSAGE = 4096
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of alignment tables that are filled at a time.
CELLS = 1 << 18
#: The filter has so many bits for each n-gram of the items, and at most 2**26 (8 MB); a fuller filter lets more n-grams pass to the join.
BITS_PER_GRAM, MOST_BITS = 32, 1 << 26


def room(length):
    """By how many words an alignment with a segment of this length may stray from the place that a seed gives it."""
    return length // 4 + 4


MARGIN = 2 * SEGMENT + room(2 * SEGMENT)


def lowered(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(row of the first text, words) for pieces of a string column, letters of any script in lower case."""
    for piece in pieces(pc.utf8_lower(column)):
        yield piece.first, words_of(piece, lower=False)


def grams_of(h: np.ndarray) -> np.ndarray:
    n = len(h) - GRAM + 1
    return mixed(sum((h[j : j + n] * PLACES[j] for j in range(1, GRAM)), h[:n] * PLACES[0]))


def lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    """A list column of these arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)))


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, grams) of the segments of items (item_id, text). Items of under GRAM words have none."""
    for batch in batches:
        for begin, words in lowered(batch.column(1)):
            owner, parts = [], []
            for i in range(len(words.begins) - 1):
                h = words.hashes[words.begins[i] : words.begins[i + 1]]
                cuts = list(range(0, max(1, len(h) - SEGMENT + 1), SEGMENT))
                for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True):
                    if b - a >= GRAM:
                        owner.append(begin + i)
                        parts.append(h[a:b])
            words_ = pa.array([x.tobytes() for x in parts], pa.binary())
            grams = lists([grams_of(x) for x in parts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), words_, grams], names=["item_id", "words", "grams"])


def filter_bits(grams: DataFrame, total: int) -> np.ndarray:
    """The Bloom filter of column `gram`: 64-bit words, at most MOST_BITS bits, put together by an aggregation."""
    size = min(MOST_BITS, 1 << max(12, (BITS_PER_GRAM * total - 1).bit_length()))
    bit = F.col("gram").bitwiseAND(F.lit(size - 1))
    word = F.shiftright(bit, 6).cast("int").alias("word")
    one = F.expr("shiftleft(1L, CAST(gram & 63 AS INT))")
    rows = grams.groupBy(word).agg(F.bit_or(one).alias("bits")).toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter knows."""
    word = ((hashes & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)).astype(np.int64)
    return np.flatnonzero((bits[word] >> (hashes & np.uint64(63))) & np.uint64(1))


PASSAGES = "id bigint, row bigint, first int, words binary, grams array<bigint>, places array<int>"


def passages_of(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The passages of texts (id, row, text) that hold n-grams of items: their words from word `first` of the text on, as hashes, and
    the n-grams that the filter knows with their places in the text."""
    for batch in batches:
        for base, words in lowered(batch.column(2)):
            hashes, of = shingles_of(words, GRAM)
            size = np.diff(words.begins)
            at = may_hold(bits, hashes)
            at = at[size[of[at]] >= GRAM]
            text = of[at]
            place = at - np.searchsorted(of, text)
            part = place // PASSAGE
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
            heads = np.flatnonzero(new)
            own, begin = text[heads], words.begins[text[heads]]
            low = np.maximum(part[heads] * PASSAGE - MARGIN, 0)
            high = np.minimum((part[heads] + 1) * PASSAGE + MARGIN, size[own])
            cut = [words.hashes[a:b].tobytes() for a, b in zip(begin + low, begin + high, strict=True)]
            rows = pa.array(base + own)
            ends = pa.array(np.append(heads, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(low.astype(np.int32)),
                    pa.array(cut, pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(hashes[at].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
                ],
                names=["id", "row", "first", "words", "grams", "places"],
            )


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over rows of padded word hashes a (items) and b (passages): best score and its last column in b."""
    n, width = b.shape
    column = np.arange(width, dtype=np.int32) * -GAP
    before = np.zeros((n, width + 1), np.int32)
    best, where = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        now = before[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        np.maximum(now, before[:, 1:] + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + column, axis=1) - column
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best[better], where[better] = value[better], top[better]
        before[:, 1:] = now
    return best, where


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


FOUND = "id bigint, row bigint, item_id bigint, score double, first_word bigint, end_word bigint"


def align_rows(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Alignments that score `least` or more of rows (id, row, item_id, item_words, low, words, shifts): a segment, a text's words from
    word `low` on, and where in the text the segment would begin by its seeds, in order."""
    for batch in batches:
        items = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
        texts = [np.frombuffer(x, np.uint64) for x in batch.column(5).to_pylist()]
        base = batch.column(4).to_numpy()
        shifts, counts = pc.list_flatten(batch.column(6)).to_numpy(), pc.list_value_length(batch.column(6)).to_numpy()
        of = np.repeat(np.arange(len(items)), counts)
        lengths, sizes = (np.array([len(x) for x in part], np.int64) for part in (items, texts))
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (np.diff(shifts) > room(lengths[of[1:]]))
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(of)) - 1
        own = of[heads]
        low = np.maximum(shifts[heads] - room(lengths[own]) - base[own], 0)
        high = np.minimum(shifts[tails] + lengths[own] + room(lengths[own]) - base[own], sizes[own])
        order = np.argsort(lengths[own] * (high - low), kind="stable")
        found: list[tuple[int, float, int, int]] = []
        at = 0
        while at < len(order):
            n = max(1, CELLS // max(1, int((high - low)[order[min(at + 511, len(order) - 1)]])))
            some = order[at : at + min(n, 512)]
            at += len(some)
            a = [items[own[x]] for x in some]
            b = [texts[own[x]][low[x] : high[x]] for x in some]
            score, end = align(padded(a, 0), padded(b, 1))
            good = np.flatnonzero(score >= least * MATCH * np.array([len(x) for x in a]))
            if len(good):
                _, back = align(padded([a[x][::-1] for x in good], 0), padded([b[x][: end[x] + 1][::-1] for x in good], 1))
                for x, r in zip(good.tolist(), back.tolist(), strict=True):
                    y = some[x]
                    first = int(base[own[y]] + low[y] + end[x])
                    found.append((int(own[y]), float(score[x]) / (MATCH * len(a[x])), first - r, first + 1))
        rows = pa.array([r[0] for r in found], pa.int64())
        kinds = [pa.float64(), pa.int64(), pa.int64()]
        values = [pa.array([r[i + 1] for r in found], t) for i, t in enumerate(kinds)]
        ids = [batch.column(i).take(rows) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*ids, *values], names=["id", "row", "item_id", "score", "first_word", "end_word"])


def seeds_of(segments: DataFrame, passages: DataFrame, share: float, least: int) -> DataFrame:
    """(segment, gram, stands): of every segment its rarest n-grams, a `share` of them and `least` at least, by the passages that hold them."""
    grams = segments.select("segment", F.size("grams").alias("n"), F.posexplode("grams").alias("stands", "gram"))
    counts = passages.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("segment").orderBy(F.coalesce("times", F.lit(0)), "stands")
    ranked = grams.join(counts, "gram", "left").withColumn("rank", F.row_number().over(rarest))
    # an n-gram that no passage holds leads nowhere
    chosen = ranked.where((F.col("rank") <= F.greatest(F.lit(least), F.ceil(F.col("n") * share))) & F.col("times").isNotNull())
    return materialize(chosen.select("segment", "gram", "stands"), "seeds")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", least: float = 0.5, rarest: float = 0.5, least_seeds: int = 8) -> DataFrame:
    """(id, item_id, score, first_word, end_word): the texts of docs (id, text) that hold items (item_id, text) or edited copies.

    Words are compared in lower case. Seeds are the rarest half of an item's n-grams, by the number of passages of 4096 words that
    hold them, counted over all texts. The score of an alignment is its points (2 for a match, -1 for a mismatch or a gap) over those
    of an exact copy of the item (of a 128-word segment of a long item); the best place in a text counts, of equal ones the first.
    Null and empty texts and items, and items of under three words, match nothing. A null item_id is dropped; repeated rows each get
    their rows, repeated items count once. A text of any length is cut into passages that overlap by more than an alignment's reach.
    An empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = "id bigint, item_id bigint, score double, first_word bigint, end_word bigint"
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct()
    segments = items.mapInArrow(segment_rows, "item_id bigint, words binary, grams array<bigint>")
    segments = materialize(segments.withColumn("segment", F.monotonically_increasing_id()), "segments")
    total = segments.agg(F.sum(F.size("grams"))).first()[0]
    if not total:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    bits = filter_bits(segments.select(F.explode("grams").alias("gram")), total)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), "text")
    passages = slim.mapInArrow(lambda it: passages_of(it, bits), PASSAGES)
    passages = materialize(passages.withColumn("passage", F.monotonically_increasing_id()), "passages")
    seeds = seeds_of(segments, passages, rarest, least_seeds)

    hits = passages.select("passage", F.explode(F.arrays_zip("grams", "places")).alias("hit"))
    hits = hits.select("passage", F.col("hit.grams").alias("gram"), F.col("hit.places").alias("place"))
    shift = (F.col("place") - F.col("stands")).alias("shift")
    pairs = hits.join(seeds, "gram").groupBy("passage", "segment").agg(F.sort_array(F.collect_set(shift)).alias("shifts"))
    pairs = materialize(pairs, "pairs").where(F.size("shifts") > 0)

    # passages in no pair are dropped where they are read; a pair carries only the words that its seeds point to
    cuts = passages.select("passage", "id", "row", "first", "words").join(pairs, "passage")
    met = cuts.join(segments.select("segment", "item_id", F.col("words").alias("item_words")), "segment")
    length = F.octet_length("item_words") / 8
    slack = F.floor(length / 4) + 4
    low = F.greatest(F.col("first"), F.element_at("shifts", 1) - slack).cast("int")
    high = F.least(F.col("first") + F.octet_length("words") / 8, F.element_at("shifts", -1) + length + slack).cast("int")
    met = met.select("id", "row", "item_id", "item_words", low.alias("low"), "words", high.alias("high"), "first", "shifts")
    cut = F.col("words").substr((F.col("low") - F.col("first")) * 8 + 1, (F.col("high") - F.col("low")) * 8).alias("words")
    met = met.select("id", "row", "item_id", "item_words", "low", cut, "shifts")
    found = materialize(met.mapInArrow(lambda it: align_rows(it, least), FOUND), "alignments", SMALL_BATCHES | BLOOM)
    best = F.min(F.struct((-F.col("score")).alias("score"), "first_word", "end_word", "id")).alias("best")
    best = found.groupBy("row", "item_id").agg(best)
    return best.select(F.col("best.id").alias(id_col), "item_id", (-F.col("best.score")).alias("score"), "best.first_word", "best.end_word")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
