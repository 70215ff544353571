"""Collocations by SON partitioning: phrases whose words stand together more often than their parts explain.

Per language, phrases of two to ``most`` words with at least ``support`` occurrences.  Documents are dealt to SHARDS shards by a hash of
their text.  A phrase that is frequent in the corpus has in some shard at least its share of the support, so

1. every shard is mined completely, length by length, at the support lowered in proportion to its words of that language: phrases are
   told apart by 64 bits of hash, and one is counted only if both its shorter parts are frequent in the shard;
2. the union of what is frequent in any shard is counted exactly, as text, over all documents.

Both counts settle a batch of documents first and send packed rows, one for each range of the hash, so no hot phrase and no hot language
meets in one task.  What is frequent in a shard is kept as a map of bits whose size is bounded: hashes that meet in it, or in 64
bits, only add candidates, which the exact count then drops.  When more phrases are frequent than the map has room for, it holds
back less; the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import forget, saved, table

SUPPORT, MOST_WORDS, TOP, INSIDE, SHARDS = 10, 3, 2000, 50, 4
UNKNOWN = "und"
#: Words that a task settles at once: as hashes, and as text.
SETTLED, SETTLED_TEXT = 1 << 20, 1 << 19
#: Hashes for each range of a shuffle, about; bits of a map of frequent phrases: one for each word of the corpus, within these bounds.
RANGE, FEWEST_BITS, MOST_BITS = 1 << 21, 20, 29

#: Bytes that end a piece, and that end a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
GAP = PIECE.copy()
GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_WORD = np.zeros(0, np.int64)


def _next(data: np.ndarray, at: int, gap: bool) -> int:
    """The first place from ``at`` on of a byte that ends a word (gap), or of one that doesn't; the end if there is none."""
    while at < len(data):
        window = GAP[data[at : at + 65_536]]
        found = int(np.argmax(window == gap))
        if window[found] == gap:
            return at + found
        at += len(window)
    return len(data)


def parts_of(data: np.ndarray, offsets: np.ndarray, more: int, limit: int = K.SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Texts in slices of about ``limit`` bytes: number of the first text, bytes, offsets, and where words that count begin at most.

    A long text is cut between words; each of its slices but the last goes ``more`` words further than what counts.
    """
    for i, j in K.slices(offsets, limit):
        at, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - at > 2 * limit:
            cut = stop = _next(data[:end], at + limit, True)
            for _ in range(more):
                stop = _next(data[:end], _next(data[:end], stop, False), True)
            yield i, data[at:stop], np.array([0, stop - at]), cut - at
            at = cut
        yield i, data[at:end], (offsets[i : j + 1] - at).clip(0), end - at


class Grams:
    """Words of a slice and the places at which phrases of k words of one piece begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, counts: int):
        self.data = _LOWER[data]
        self.words = K.Words(self.data, offsets, GAP)
        self.text, self.hash = self.words.text_of(), self.words.hash
        self.counts = int(np.searchsorted(self.words.start, counts))
        piece = np.cumsum(PIECE[self.data])[self.words.start] if len(self.data) else _NO_WORD
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def starts(self, k: int) -> np.ndarray:
        n = max(len(self.words.start) - k + 1, 0)
        ok = np.ones(n, bool)
        for i in range(k - 1):
            ok &= self.joined[i : i + n]
        return np.flatnonzero(ok[: self.counts])

    def hashes(self, k: int) -> np.ndarray:
        return K.gram_hashes(self.hash, k)

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins."""
        length = self.words.end - self.words.start + 1
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(length)), length)
        source = self.words.start[owner] + np.arange(len(owner)) - begin[owner]
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))]
        out[begin + length - 1] = 0x20
        return out, begin


def _in_shard(hashes: np.ndarray, lang: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """Hashes of phrases of a language in a shard."""
    return K.mix(hashes ^ K.mix(lang + np.uint64(0x9E3779B97F4A7C15) * np.asarray(shard, np.uint64)))


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(bits).bit_length() - 1) - 3)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _settled(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each comes first, and how often."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    return ranked[at], order[at], np.diff(np.append(at, len(keys)))


def _edges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges that sorted keys fall in, and where each begins, with the end."""
    number = (keys >> np.uint64(64 - ranges)).astype(np.int64) if ranges else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(keys) else _NO_WORD
    return number[at], np.append(at, len(keys))


def _mining(k: int, ranges: int, shorter: Broadcast | None):
    """Rows (text, lang_hash, shard, support) to (range, n, body): hashes of their phrases of k words, how often, and the support of each."""

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        keys, least = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(keys):
            return None
        distinct, first, n = _settled(keys)
        least = least[first]
        number, edge = _edges(distinct, ranges)
        bodies = [distinct[a:b].tobytes() + n[a:b].astype("<u4").tobytes() + least[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.diff(edge)), pa.array(bodies, pa.binary())], names=["range", "n", "body"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shorter is None else np.frombuffer(shorter.value, np.uint8)
        held, words = [], 0
        for part in parts:
            data, offsets = K.utf8(part.column(0))
            lang, shard, support = (part.column(i).to_numpy() for i in (1, 2, 3))
            lang = lang.view(np.uint64)
            for i, d, off, counts in parts_of(data, offsets, k - 1):
                grams = Grams(d, off, counts)
                at = grams.starts(k)
                row = i + grams.text[at]
                if bits is not None:
                    fewer = grams.hashes(k - 1)
                    frequent = _marked(bits, _in_shard(fewer[at], lang[row], shard[row]))
                    frequent[frequent] = _marked(bits, _in_shard(fewer[at[frequent] + 1], lang[row[frequent]], shard[row[frequent]]))
                    at, row = at[frequent], row[frequent]
                held.append([_in_shard(grams.hashes(k)[at], lang[row], shard[row]), support[row].astype("<u4")])
                words += len(grams.hash)
                if words >= SETTLED:
                    if (out := flush(held)) is not None:
                        yield out
                    held, words = [], 0
        if held and (out := flush(held)) is not None:
            yield out

    return run


def _frequent(ranges: int, bits: int):
    """Of a range's packed rows: its slice of the map of bits."""

    def kernel(group: pa.Table) -> pa.Table:
        keys, n, least = [], [], []
        for size, body in zip(group.column("n").to_pylist(), group.column("body"), strict=True):
            raw = body.as_py()
            keys.append(np.frombuffer(raw, "<u8", size))
            n.append(np.frombuffer(raw, "<u4", size, 8 * size))
            least.append(np.frombuffer(raw, "<u4", size, 12 * size))
        keys, n, least = (np.concatenate(x) for x in (keys, n, least))
        order = np.argsort(keys)
        keys, n, least = keys[order], n[order].astype(np.int64), least[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        kept = keys[at][np.add.reduceat(n, at) >= least[at]]
        number = group.column("range")[0].as_py()
        if not len(kept):
            return pa.table({"range": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
        place = (kept >> np.uint64(64 - bits)).astype(np.int64) - (number << (bits - ranges))
        out = np.zeros(1 << (bits - ranges - 3), np.uint8)
        np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pa.table({"range": pa.array([number], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    return kernel


def _counting(most: int, ranges: int, maps: list[Broadcast], shards: int):
    """Rows (text, lang_hash, lang) to (range, lang, n, body): words and candidate phrases as text, and how often each occurs."""

    def flush(held: list[list[np.ndarray]], texts: list[np.ndarray], langs: list[str]) -> pa.RecordBatch | None:
        keys, lang, begin, length = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(keys):
            return None
        data = np.concatenate(texts)
        distinct, first, n = _settled(keys)
        lang, begin, length = lang[first], begin[first], length[first]
        number = (distinct >> np.uint64(64 - ranges)).astype(np.int64) if ranges else np.zeros(len(distinct), np.int64)
        order = np.lexsort((lang, number))
        number, lang, begin, length, n = number[order], lang[order], begin[order].astype(np.int64), length[order].astype(np.int64) + 1, n[order].astype("<u4")
        stop = np.cumsum(length)
        place = np.repeat(begin - (stop - length), length) + np.arange(int(stop[-1]))
        body = data[place]
        body[stop - 1] = 0x0A  # no word has it
        edge = np.append(np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (lang[1:] != lang[:-1]))), len(number))
        byte = np.append(0, stop)[edge]
        bodies = [n[a:b].tobytes() + body[c:d].tobytes() for a, b, c, d in zip(edge[:-1].tolist(), edge[1:].tolist(), byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
        heads = edge[:-1]
        return pa.RecordBatch.from_arrays([pa.array(number[heads]), pa.array([langs[i] for i in lang[heads].tolist()], pa.string()), pa.array(np.diff(edge)), pa.array(bodies, pa.binary())], names=["range", "lang", "n", "body"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(m.value, np.uint8) for m in maps]
        held, texts, words, size, names = [], [], 0, 0, {}
        for part in parts:
            data, offsets = K.utf8(part.column(0))
            lang = part.column(1).to_numpy().view(np.uint64)
            named = part.column(2).dictionary_encode()
            name = np.array([names.setdefault(x, len(names)) for x in named.dictionary.to_pylist()], np.int32)[named.indices.to_numpy()] if len(named) else np.zeros(0, np.int32)
            for i, d, off, counts in parts_of(data, offsets, most - 1):
                grams = Grams(d, off, counts)
                plain, begin = grams.plain()
                stop = begin + grams.words.end - grams.words.start
                for k in range(1, most + 1):
                    at = grams.starts(k)
                    row = i + grams.text[at]
                    h = grams.hashes(k)[at] if len(at) else np.zeros(0, np.uint64)
                    if k > 1:
                        found = np.zeros(len(at), bool)
                        for s in range(shards):
                            rest = np.flatnonzero(~found)
                            found[rest] = _marked(bits[k - 2], _in_shard(h[rest], lang[row[rest]], s))
                        at, row, h = at[found], row[found], h[found]
                    held.append([K.mix(h ^ K.mix(lang[row] + np.uint64(k))), name[row], (size + begin[at]).astype(np.int32), (stop[at + k - 1] - begin[at]).astype(np.int32)])
                texts.append(plain)
                size += len(plain)
                words += len(grams.hash)
                if words >= SETTLED_TEXT:
                    if (out := flush(held, texts, list(names))) is not None:
                        yield out
                    held, texts, words, size = [], [], 0, 0
        if held and (out := flush(held, texts, list(names))) is not None:
            yield out

    return run


def _summed(support: int):
    """Of a range's packed rows: words and phrases that occur often enough, told apart as text."""

    def kernel(group: pa.Table) -> pa.Table:
        tables = []
        for lang, size, body in zip(group.column("lang").to_pylist(), group.column("n").to_pylist(), group.column("body"), strict=True):
            raw = np.frombuffer(body.as_py(), np.uint8)
            text = np.ascontiguousarray(raw[4 * size :])
            stop = np.flatnonzero(text == 0x0A)
            offsets = np.append(0, stop + 1).astype(np.int64)
            lines = pa.LargeStringArray.from_buffers(size, pa.py_buffer(offsets), pa.py_buffer(text))
            tables.append(pa.table({"lang": pa.repeat(lang, size), "phrase": lines, "n": pa.array(np.frombuffer(raw[: 4 * size].tobytes(), "<u4").astype(np.int64))}))
        summed = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        kept = summed.filter(pa.compute.greater_equal(summed.column("n_sum"), support))
        line = pa.compute.utf8_slice_codeunits(kept.column("phrase"), 0, -1)
        return pa.table({"lang": kept.column("lang"), "phrase": line.cast(pa.string()), "n": kept.column("n_sum").cast(pa.int64())})

    return kernel


def _words(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = K.utf8(part.column(0))
    n = np.zeros(part.num_rows, np.int64)
    for i, d, off, counts in parts_of(data, offsets, 0):
        n[i : i + len(off) - 1] += np.diff(K.Words(d, off, GAP).first)
    return pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n)], names=["lang", "shard", "n"])


def _mapped(kernel: Callable[[pa.RecordBatch], pa.RecordBatch]):
    return lambda parts: map(kernel, parts)


def count_phrases(docs: DataFrame, support: int = SUPPORT, most: int = MOST_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of each language; (lang, phrase, n): words, and phrases of 2 to ``most`` words, with at least ``support`` occurrences.

    Both are tables in the shared folder.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"))
    sizes = rows.select("text", "lang", "shard").mapInArrow(_mapped(_words), "lang string, shard long, n long").groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    own = saved(sizes, "shards")
    totals = saved(own.groupBy("lang").agg(F.sum("own").alias("n")), "words")
    # At least its share of the support, rounded up: with less in every shard a phrase has less than the support in all.
    share = own.join(totals, "lang").select("lang", "shard", F.greatest(F.lit(1), F.ceil(F.lit(support) * F.col("own").cast("decimal(20,0)") / F.greatest("n", F.lit(1)).cast("decimal(20,0)"))).cast("long").alias("support"))
    share = saved(share, "supports")
    supported = rows.join(share, ["lang", "shard"])

    n = totals.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max(n.bit_length(), FEWEST_BITS), MOST_BITS)
    ranges = min(max((2 * partitions - 1).bit_length(), (n // RANGE).bit_length()), bits - 3)
    maps: list[Broadcast] = []
    for k in range(2, most + 1):
        mined = supported.select("text", "lang_hash", "shard", "support").mapInArrow(_mining(k, ranges, maps[-1] if maps else None), "range long, n long, body binary")
        found = bytearray(1 << (bits - 3))
        for r in mined.groupBy("range").applyInArrow(_frequent(ranges, bits), "range long, bits binary").toLocalIterator():
            at = r["range"] << (bits - 3 - ranges)
            found[at : at + len(r["bits"])] = r["bits"]
        maps.append(spark.sparkContext.broadcast(bytes(found)))
    counted = rows.select("text", "lang_hash", "lang").mapInArrow(_counting(most, ranges, maps, shards), "range long, lang string, n long, body binary")
    counted = saved(counted.groupBy("range").applyInArrow(_summed(support), "lang string, phrase string, n long"), "phrases")
    for m in maps:
        m.unpersist()
    for t in (own, share):
        forget(t)
    return totals, counted


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers of 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    top = (big(a) * big(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    bottom = big(left) * big(right)
    rest = top % bottom  # exact, where a quotient of decimals is rounded
    return ((top - rest) / bottom).cast("long")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST_WORDS, top: int = TOP, inside: int = INSIDE, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, then a, then phrase.

    docs: text and lang (null: und); other columns are left out.  A-Z count as a-z; pieces end at ``.,;:!?`` and line ends, words at
    spaces and tabs.  a: occurrences of the phrase, l and r: of the parts of its lowest-scoring cut, n: of all words.  A phrase goes
    if a longer candidate around it has at least ``inside`` percent of its occurrences.  Null and empty texts have no words; equal
    documents count each; an empty table gives an empty one.
    """
    totals, counted = count_phrases(docs, support, most, shards)
    split = counted.withColumn("w", F.split("phrase", " "))
    candidates = split.where(F.size("w") > 1).select("lang", "phrase", F.col("n").alias("a"), "w")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    part = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))

    longer = candidates.where(F.size("w") > 2)
    starts = longer.select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    starts = starts.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
    around = starts.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("most") >= inside * F.col("a"), F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # First within buckets of a hash, so that no task orders all phrases of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = kept.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two and three words of every language."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM pieces, range(1, 4) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM grams GROUP BY ALL HAVING count(*) >= 10
), cand AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cand, unnest(range(1, len(w))) AS t(k)
), scored AS (SELECT c.lang, c.phrase, a, c.k, l.n AS l, r.n AS r, 1000000 * a * a // (l.n * r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM cand, range(1, 3) AS t(i) WHERE len(w) = 3 GROUP BY ALL
), kept AS (SELECT l.* FROM lowest l LEFT JOIN around o USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
