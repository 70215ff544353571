"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard.

A document is the weighted set of its five-word shingles (lower case).  A shingle weighs its count in the document times
log(1 + N / df), with its real document frequency df.  Frequencies are joined to the texts in packed form: texts are dealt into
groups, each group asks every range of the hash for the frequencies of its distinct shingles, and each range answers with those
of two or more documents.  No table of all frequencies is ever in one place.

Two texts as similar as t share at least the t-th part of either one's weight.  So a text that shares less than that with all
other texts together is similar to none, which the frequencies tell exactly; only the others go on, and of them only the shingles
that some other text has, beside the whole weight.

Improved consistent weighted sampling draws, for each of ``bands * rows`` functions, one (shingle, level) of the set such that
two sets draw the same with a probability equal to their weighted Jaccard similarity.  Equal texts are one node.  Nodes that
share a band meet in a bucket: each is checked against the bucket's leader, the text that has the largest share of its weight in
common with others (of a text and its variants, the text itself).  All texts of the buckets that this leaves in several components
then go through an exact join by prefixes (see _unmet), so that no link between components is lost, and pairs that cannot be
similar enough are not made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import batches, forget, join_spread, mark, saved, sweep, table
from .components import connected_components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 14, 3
U64 = np.uint64

#: Bytes of text in a group, and of the texts whose shingles a range of the hash answers for, at least: both bound the memory of a task.
GROUP_BYTES, RANGE_BYTES = 4 << 20, 12 << 20
#: A group asks each range for so many shingles at least (of about six bytes of text each), or its rows would be no packs any more.
ASKED_AT_ONCE = 64

#: For the exact join: weight classes to a factor of 1 / similarity.
CLASSES = 2

#: Rows handled at once; a shingle's hash is cut to 48 bits below the number of its text.
_TEXTS = 1 << 15

_NODES = "node binary, weight double, share double, buckets array<bigint>, shingles binary, counts binary, dfs binary"


def bags(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle; shingles are 48-bit hashes."""
    h, text = K.shingles(K.Words(data, offsets), size)
    key = (text.astype(U64) << U64(48)) | (h >> U64(16))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U64(48)).astype(np.int64), key[at] & U64((1 << 48) - 1), np.diff(np.append(at, len(key)))


def parts(offsets: np.ndarray):
    """Slices of a batch that are small in bytes and in texts."""
    for i, j in K.slices(offsets):
        for a in range(i, j, _TEXTS):
            yield a, min(a + _TEXTS, j)


def _packed(shingle: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as the six byte planes of their differences, of which the upper ones compress to nothing."""
    step = np.diff(shingle, prepend=U64(0)).astype("<u8")
    return step.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


def _one_each(part: pa.RecordBatch) -> pa.RecordBatch:
    """Of the equal texts of a batch one row, with their number."""
    codes = part.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, first, count = np.unique(codes, return_index=True, return_counts=True)
    one = part.take(pa.array(first))
    return pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array(count.astype(np.int64))], names=["node", "text", "copies"])


def _asked(ranges: int, size: int):
    """What a group of texts asks: by range of the hash its distinct shingles and in how many of its documents each is."""

    def kernel(part: pa.Table) -> pa.Table:
        data, off = K.utf8(part.column("text"))
        copies = part.column("copies").to_numpy()
        shingles, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for i, j in parts(off):
            text, shingle, _ = bags(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
            shingles.append(shingle)
            counts.append(copies[i + text])
        shingle, n = np.concatenate(shingles), np.concatenate(counts)
        order = np.argsort(shingle)
        shingle, n = shingle[order], n[order]
        at = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
        shingle, n = shingle[at], np.add.reduceat(n, at) if len(at) else n
        of = ((shingle >> U64(16)) * U64(ranges)) >> U64(32)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(of))
        rows = list(zip(first.tolist(), ends.tolist(), strict=False))[: len(first)]
        return pa.table(
            {
                "range": pa.array(of[first].astype(np.int64)),
                "g": pa.array(np.full(len(first), part.column("g")[0].as_py(), np.int64)),
                "shingles": pa.array([_packed(shingle[a:b]) for a, b in rows], pa.binary()),
                "dfs": pa.array([n[a:b].astype("<u4").tobytes() for a, b in rows], pa.binary()),
            }
        )

    return kernel


def _answered(part: pa.Table) -> pa.Table:
    """To each group that asked a range: those of its shingles that two or more documents have, and how many have them."""
    asked = [_unpacked(x.as_py()) for x in part.column("shingles")]
    n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in part.column("dfs")])
    shingle = np.concatenate(asked)
    order = np.argsort(shingle)
    at = np.flatnonzero(np.append(True, shingle[order][1:] != shingle[order][:-1]))
    df = np.empty(len(shingle), np.int64)
    df[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), at), np.diff(np.append(at, len(shingle))))
    ends = np.cumsum([len(x) for x in asked])
    groups, shingles, dfs = [], [], []
    for g, own, end in zip(part.column("g").to_pylist(), asked, ends.tolist(), strict=True):
        here = df[end - len(own) : end]
        if (many := here > 1).any():
            groups.append(g)
            shingles.append(_packed(own[many]))
            dfs.append(here[many].astype("<u4").tobytes())
    return pa.table({"g": pa.array(groups, pa.int64()), "shingles": pa.array(shingles, pa.binary()), "dfs": pa.array(dfs, pa.binary())})


class Sampler:
    """Improved consistent weighted sampling: per function and shingle, r and c from Gamma(2, 1) and b from U(0, 1), all from the
    shingle's own hash; t = floor(log w / r + b), log a = log c - r (t - b) - r; the shingle with the least a is drawn, at level t.

    log a tells the level, so a draw is 64 bits: those of log a above 32 bits of the shingle.
    """

    def __init__(self, functions: int, seed: int = 11):
        self.odd = np.random.default_rng(seed).integers(0, 1 << 63, functions, np.uint64) * U64(2) + U64(1)

    @staticmethod
    def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers between 0 and 1, neither of them reached, from the halves of a hash."""
        scale = np.float32(2.0**-24)
        return tuple(((x >> U64(8)).astype(np.float32) + np.float32(0.5)) * scale for x in (h >> U64(32), h & U64(0xFFFFFFFF)))

    def __call__(self, first: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Draws (texts x functions) of the sets that begin at ``first``; every set has a shingle."""
        low = shingle & U64(0xFFFFFFFF)
        log_weight = np.log(weight).astype(np.float32)
        out = np.empty((len(first), len(self.odd)), U64)
        for k, odd in enumerate(self.odd):
            h = K.mix(shingle * odd + U64(k))
            (u1, u2), (u3, u4), (b, _) = self._uniform(h), self._uniform(K.mix(h + U64(1))), self._uniform(K.mix(h + U64(2)))
            r = -np.log(u1 * u2)
            t = np.floor(log_weight / r + b)
            log_a = np.log(-np.log(u3 * u4)) - r * (t - b) - r
            bits = log_a.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # unsigned order is that of the numbers
            out[:, k] = np.minimum.reduceat((bits.astype(U64) << U64(32)) | low, first)
        return out


def _weighed(total: int, similarity: float, bands: int, rows: int, size: int):
    """The texts of a group that can be similar to another one: weight, buckets, and the shingles that others have as well."""
    sample = Sampler(bands * rows)

    def kernel(answers: pa.Table, texts: pa.Table) -> pa.Table:
        none = np.zeros(0, U64)
        known = np.concatenate([none, *[_unpacked(x.as_py()) for x in answers.column("shingles")]])
        known_df = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in answers.column("dfs")]])
        order = np.argsort(known)
        known, known_df = known[order], known_df[order]
        data, off = K.utf8(texts.column("text"))
        copies, nodes = texts.column("copies").to_numpy(), texts.column("node").combine_chunks()
        out: dict[str, list] = {n: [] for n in ("at", "weight", "share", "buckets", "shingles", "counts", "dfs")}
        for i, j in parts(off) if len(known) else ():
            text, shingle, count = bags(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
            if not len(text):
                continue
            at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
            df = np.where(known[at] == shingle, known_df[at], 1)
            weight = count * np.log1p(total / df)
            shared = df > copies[i + text]
            whole, part = np.bincount(text, weight, j - i), np.bincount(text[shared], weight[shared], j - i)
            on = ((whole > 0) & (part >= (similarity - 1e-9) * whole))[text]
            if not on.any():
                continue
            text, shingle, count, df, weight, shared = (x[on] for x in (text, shingle, count, df, weight, shared))
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            drawn = sample(first, shingle, weight)
            buckets = np.empty((len(first), bands), U64)
            for b in range(bands):
                h = np.full(len(first), b + 1, U64)
                for x in drawn.T[b * rows : (b + 1) * rows]:
                    h = K.mix(h * U64(0x9E3779B97F4A7C15) + x)
                buckets[:, b] = h
            own = text[first]
            out["at"] += (own + i).tolist()
            out["weight"] += whole[own].tolist()
            out["share"] += (part[own] / whole[own]).tolist()
            out["buckets"] += list(buckets.view(np.int64))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(text)], strict=True):
                some = np.flatnonzero(shared[a:b]) + a
                out["shingles"].append(shingle[some].astype("<u8").tobytes())
                out["counts"].append(count[some].astype("<u4").tobytes())
                out["dfs"].append(df[some].astype("<u4").tobytes())
        return pa.table(
            {
                "node": nodes.take(pa.array(out["at"], pa.int64())),
                **{n: pa.array(out[n], pa.float64()) for n in ("weight", "share")},
                "buckets": pa.array(out["buckets"], pa.list_(pa.int64())),
                **{n: pa.array(out[n], pa.binary()) for n in ("shingles", "counts", "dfs")},
            }
        )

    return kernel


def dealing(volume: int) -> tuple[int, int]:
    """Numbers of groups and of ranges for so many bytes of text.

    Every group asks every range, so both sizes grow with the square root of the text once packs would have fewer than ASKED_AT_ONCE
    shingles: 4 MB up to about 130 GB, 100 MB at 100 TB.  Shuffled rows stay in proportion to the text.
    """
    grow = max(1.0, (6 * ASKED_AT_ONCE * volume / (GROUP_BYTES * RANGE_BYTES)) ** 0.5)
    return tuple(max(1, int(-(-volume // (n * grow)))) for n in (GROUP_BYTES, RANGE_BYTES))


def weighed_texts(texts: DataFrame, total: int, size_in_bytes: int, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each distinct text of ``texts`` (node, text) that can be similar to another: what similarity needs of it.

    ``total`` is the number N of documents.  The shuffled texts are read twice, to ask for frequencies and to receive them.
    """
    groups, ranges = dealing(size_in_bytes)
    once = texts.select("node", "text").mapInArrow(batches(_one_each), "node binary, text binary, copies long")
    dealt = once.withColumn("g", F.pmod(F.xxhash64("node"), F.lit(groups))).repartition("g")
    # Grouped by (g, node) where g is dealt out already: copies from all batches fall together without another shuffle.
    distinct = dealt.groupBy("g", "node").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    asked = distinct.groupBy("g").applyInArrow(_asked(ranges, size), "range long, g long, shingles binary, dfs binary")
    answers = asked.groupBy("range").applyInArrow(_answered, "g long, shingles binary, dfs binary")
    return answers.groupBy("g").cogroup(distinct.groupBy("g")).applyInArrow(_weighed(total, similarity, bands, rows, size), _NODES)


class Sets:
    """Weighted sets out of columns of shingles, counts and document frequencies: set, shingle, df and weight of each entry."""

    def __init__(self, shingles: pa.Array, counts: pa.Array, dfs: pa.Array, total: int):
        sizes = [len(x.as_py()) // 8 for x in shingles]
        self.set = np.repeat(np.arange(len(sizes)), sizes)
        self.shingle, count, self.df = (np.frombuffer(b"".join(x.to_pylist()), t) for x, t in ((shingles, "<u8"), (counts, "<u4"), (dfs, "<u4")))
        self.weight = count * np.log1p(total / self.df)


def _shared_weight(a: Sets, b: Sets, pairs: int) -> np.ndarray:
    ka, kb = ((x.set.astype(U64) << U64(48)) | x.shingle for x in (a, b))
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return np.bincount(a.set[ia], np.minimum(a.weight[ia], b.weight[ib]), pairs)


def _similar(total: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (Sets(*part.columns[k : k + 3], total) for k in (4, 7))
        least = _shared_weight(a, b, part.num_rows)
        whole = part.column(2).to_numpy() + part.column(3).to_numpy() - least
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least / whole)], names=["a", "b", "similarity"])

    return kernel


def _bag(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("weight", "shingles", "counts", "dfs")])


def _verified(pairs: DataFrame, nodes: DataFrame, total: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar enough."""
    both = pairs.join(_bag(nodes, "a"), "a").join(_bag(nodes, "b"), "b")
    both = both.select("a", "b", "weight_a", "weight_b", *[f"{c}_{s}" for s in "ab" for c in ("shingles", "counts", "dfs")])
    checked = both.mapInArrow(batches(_similar(total), 1000), "a binary, b binary, similarity double")
    return checked.where(F.col("similarity") >= similarity - 1e-9)


def text_node(text: Column) -> Column:
    """128 bits that equal texts share, case aside; null for texts without words."""
    words = F.regexp_replace(F.lower(text), r"^[ \t-\r]+$", "")
    return F.when(F.length(words) > 0, F.unhex(F.md5(words.cast("binary"))))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _prefixes(total: int, similarity: float):
    """(node, component, apart, key, side, weight, rest) for the shingles by which a text has to meet a similar one (see _unmet)."""
    step = -np.log(similarity - 1e-6) / CLASSES

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(*part.columns[4:7], total)
        whole = part.column(3).to_numpy()
        order = np.lexsort((sets.shingle, sets.df, sets.set))
        text, shingle, weight = sets.set[order], sets.shingle[order], sets.weight[order]
        shared = np.bincount(text, weight, part.num_rows)
        before = np.cumsum(weight) - weight
        rest = shared[text] - before + before[np.searchsorted(text, text)]
        grade = np.floor(np.log(whole) / step)
        places, keys, sides = [], [], []
        for d in range(-CLASSES, CLASSES + 1):
            other = np.exp((grade + d) * step)  # the least weight of the class
            need = np.maximum(similarity * np.maximum(whole, other), similarity / (1 + similarity) * (whole + other))
            on = np.flatnonzero(rest >= need[text] * (1 - 1e-6))
            low = (grade[text[on]] + min(d, 0)).astype(np.int64).view(U64)
            keys.append(K.mix(K.mix(shingle[on]) + low * U64(0x9E3779B97F4A7C15) + U64(abs(d))))
            places.append(on)
            sides.append(np.full(len(on), np.sign(d), np.int32))
        at = np.concatenate(places)
        rows = pa.array(text[at])
        columns = [*[part.column(k).take(rows) for k in (0, 1, 2)], pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)), pa.array(whole[text[at]]), pa.array(rest[at])]
        return pa.RecordBatch.from_arrays(columns, names=["node", "component", "apart", "key", "side", "weight", "rest"])

    return kernel


def _near(similarity: float) -> Column:
    """Texts of too unequal weights (weight and most) are not similar."""
    return F.least("weight", "most") >= (similarity - 1e-9) * F.greatest("weight", "most")


def _unmet(members: DataFrame, component: DataFrame, nodes: DataFrame, total: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of the texts of buckets that hold several components, such that no link between components is lost.

    An exact set-similarity join by prefixes.  Two sets as similar as t have t / (1 + t) of their weights' sum in common.  With
    the shingles of all sets in one order, what they share begins at one shingle, behind which both still hold that much weight.
    So each text names the shingles behind which enough is left for a partner of weight class j, and both meet by (classes,
    shingle).  The order is by document frequency: any order is exact, and rare shingles first make few meet.  Shingles of one
    text alone come before all others and are never named.  Of two texts that meet at a shingle, what they still have there and
    their weights must allow the similarity.
    """
    owner = members.join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = owner.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).getField("component").alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    mixed = owner.join(largest, "bucket").groupBy("node", "component").agg(F.max(F.col("component") != F.col("largest")).alias("apart"))
    asked = nodes.join(mixed, "node").select("node", "component", "apart", "weight", "shingles", "counts", "dfs")
    named = saved(asked.mapInArrow(batches(_prefixes(total, similarity), 1000), "node binary, component binary, apart boolean, key long, side int, weight double, rest double"), "prefixes")
    shared = named.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.max("apart").alias("some")).where("first <> last and some").select("key")
    rows = named.join(shared, "key")
    asking = rows.where("apart").select("key", F.col("node").alias("x"), F.col("component").alias("of"), F.col("side").alias("facing"), F.col("weight").alias("most"), F.col("rest").alias("left"))
    enough = F.least("rest", "left") >= similarity / (1 + similarity) * (F.col("weight") + F.col("most")) * (1 - 1e-6)
    facing = rows.join(asking, "key").where("side = -facing and component <> of and (not apart or node < x)").where(enough & _near(similarity))
    pairs = saved(_ordered(facing, "node", "x"), "pairs")
    forget(named)
    return pairs


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size and text_id.

    Classes are the connected components of the links: equal texts (ignoring case), and texts of at least ``similarity``.  A
    text of fewer than ``size`` words has all its words as its one shingle.  Documents without words (null text too) are equal
    to nobody and have the class of their own doc_id.  Where all doc_ids of a class are null its class_id is null.  Columns of
    docs other than doc_id and text are not read.  Rows repeated in whole are equal texts and give a row each.  An empty table
    gives an empty table.
    """
    since = mark()
    keyed = docs.select("doc_id", F.lower("text").cast("binary").alias("text"), text_node(F.col("text")).alias("node"))
    total, volume = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    nodes = saved(weighed_texts(keyed.where("node is not null"), total, volume, similarity, size, bands, rows), "nodes")

    drawn = nodes.select("node", "weight", "share", F.explode("buckets").alias("bucket"))
    shared = drawn.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(drawn.join(shared, "bucket").select("bucket", "node", "weight", "share"), "members")
    lead = members.groupBy("bucket").agg(F.max(F.struct("share", "node", "weight")).alias("lead")).select("bucket", F.col("lead.node").alias("leader"), F.col("lead.weight").alias("most"))
    tried = saved(_ordered(members.join(lead, "bucket").where(_near(similarity) & (F.col("node") != F.col("leader"))), "node", "leader"), "pairs")
    links = saved(_verified(tried, nodes, total, similarity).select("a", "b"), "verified")
    component = saved(connected_components(links), "components")

    rest = _unmet(members, component, nodes, total, similarity)
    more = saved(_verified(rest.join(tried, ["a", "b"], "left_anti"), nodes, total, similarity).select("a", "b"), "verified")
    if not more.isEmpty():
        component = saved(connected_components(links.union(more)), "components")
    sweep(docs.sparkSession, since, "components")

    # Classes of nodes first, one row each; then those of documents, of which very many may have one node.
    rows = saved(keyed.select("doc_id", "node"), "rows")
    each = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    each = saved(each.join(component, "node", "left").select("node", "least", "n", F.coalesce("component", "node").alias("class")), "classes")
    named = each.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = saved(join_spread(each, named, "class").select("node", "class_id", "class_size"), "named")
    sweep(docs.sparkSession, since, "rows", "named")
    out = join_spread(rows, of_node, "node")
    words = F.col("node").isNotNull()
    return out.select("doc_id", F.when(words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.lower(F.hex("node")).alias("text_id"))


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (doc_id, text, any others) that stay: of each near-duplicate class one with the least doc_id.

    Of rows with that doc_id and equal texts one stays, also where they differ in case or in other columns.  Documents without
    words (null, empty or blank text) are no copies of one another and all stay.  ``how`` goes to near_duplicates.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), **how).where("text_id is not null")
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.unhex("text_id").alias("_text")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_d"), text_node(F.col("text")).alias("_t"))
    kept = row.where("_t is not null").join(stay, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text")), "left_semi").dropDuplicates(["_d", "_t"])
    return kept.unionByName(row.where("_t is null")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five-word shingles, weighted similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
