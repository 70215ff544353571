"""SpotSigs fingerprints: chains of content words that follow common words.

A text is read as lower-case runs of letters and digits.  Each content word that stands right after an anchor (a very common
word) begins a signature: that word and the next content words, anchors between them passed over, ``CHAIN`` in all.  A fingerprint
is the set of signatures, each as 48 bits of its hash, in order; likenesses are those of fingerprints.  To find the pairs of a
corpus that are alike (alike_pairs), sets are put into partitions by their length, borders growing by the least likeness of
interest: sets in partitions that are not neighbours cannot be that alike and are never compared.

All of this is Spark SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .ordering import bucket_of, cuts

#: Very common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auch auf das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "al como con del el es las lo los más no para por se su una y"
)
CHAIN, LEAST = 2, 0.8
#: Hexadecimal digits of a signature's hash.
DIGITS = 12

_WORDS = sorted(set(ANCHORS.split()))


def _short(signature: Column) -> Column:
    return F.left(F.md5(signature.cast("binary")), F.lit(DIGITS))


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as hashes, sorted; null text counts as empty.

    A text without any has itself as its one signature, and a text without letters and digits an empty set.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    # Anchors become a bar behind the word before them: " w1 w2| w3|| w4 ".
    barred = F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), f" (?:{'|'.join(_WORDS)})(?= )", "|")
    chain = r"\|(?=( [^ |]+" + r"\|* [^ |]+" * (CHAIN - 1) + "))"
    found = F.regexp_extract_all(barred, F.lit(chain), F.lit(1))
    chains = F.sort_array(F.array_distinct(F.transform(found, lambda s: _short(F.substring(F.translate(s, "|", ""), 2, 1 << 30)))))
    whole = F.when(F.trim(plain) != "", F.array(_short(F.concat(F.lit("="), F.trim(plain))))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(chains) > 0, chains).otherwise(whole)


def fingerprint(signature_set: Column) -> Column:
    """The set as one string: its hashes, DIGITS characters each, in order."""
    return F.array_join(signature_set, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; 1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def partition(n: Column, least: float = LEAST) -> Column:
    """Partition of a set of n signatures: sets at least ``least`` alike are in the same partition or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / -F.log(F.lit(least)) + 1e-9).cast("int")


def alike_pairs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, likeness) for the fingerprints of docs (doc_id, text) that are at least ``least`` alike; each pair once.

    A fingerprint is named by the least doc_id that has it, so equal ones are no pairs among themselves; empty ones and rows with a
    null id are left out.  Sets meet by partition of their lengths and one of their rarest signatures: of n signatures, two sets
    that alike share one of the n - ceil(least * n) + 1 rarest of either.  What a common signature's places still allow is checked
    before a pair is made, and the likeness only of pairs that pass.  An empty table gives no pair.
    """
    each = docs.where("doc_id is not null").select("doc_id", signatures(F.col("text")).alias("s")).where(F.size("s") > 0)
    sets = saved(each.groupBy("s").agg(F.min("doc_id").alias("id")).select("id", "s", F.size("s").alias("n")), "fingerprints")
    words = sets.select("id", "n", F.explode("s").alias("sig"))
    df = words.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    rare = words.join(df, "sig").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).where("df > 1")
    rare = saved(rare.select("id", "n", "sig", "place", partition(F.col("n"), least).alias("p")), "rare")
    one = rare.select("sig", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("at"), F.col("p").alias("px"))
    left = F.least(F.col("nx") - F.col("at"), F.col("n") - F.col("place")) + 1
    met = one.join(rare, ["sig", "p"]).where((F.col("px") < F.col("p")) | (F.col("x") < F.col("id")))
    met = met.where((F.least("n", "nx") >= least * F.greatest("n", "nx") - 1e-9) & (left >= least / (1 + least) * (F.col("n") + F.col("nx")) - 1e-9))
    pairs = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= least - 1e-9)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many of the next document in
    order of doc_id; after the last comes the first.  Null text is empty.  Null ids come first; of rows with one id, the order is
    that of their texts.  A table of one row is its own successor, and an empty table gives an empty table.  Only doc_id and text
    are read.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = cuts(rows, F.col("key"))
    last = max(len(bounds) - 1, 0)
    # The first row of each bucket goes to the bucket before as well, to be the successor of its last row.
    home = bucket_of(F.col("key"), bounds)
    dealt = rows.withColumn("bucket", home).withColumn("copy", F.col("key") == F.get(F.lit(bounds or [0]), F.col("bucket")))
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    placed = F.when(F.col("copy"), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")), F.struct(before.alias("bucket"), F.lit(1).alias("late")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")))
    )
    dealt = dealt.withColumn("place", placed).select("doc_id", "key", "text", F.explode("place").alias("place")).select("doc_id", "key", "text", "place.bucket", "place.late")
    order = Window.partitionBy("bucket").orderBy("late", "key", "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    out = dealt.withColumn("next", F.lead("text").over(order)).select(
        "doc_id", "key", "bucket", "late", "text", n.cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(edited).alias("edit"),
    )
    out = out.withColumn("following", F.lead("own").over(order)).where("late = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        F.round(likeness(F.col("own"), F.col("edit")), 9).alias("near_edited"), F.round(likeness(F.col("own"), F.col("following")), 9).alias("near_next"),
    )


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _set_sql(name: str, source: str) -> str:
    return f"""
{name}_w AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source})),
{name}_m AS (SELECT id, p, word, word IN (SELECT unnest(['{"','".join(_WORDS)}'])) AS anchor FROM {name}_w),
{name}_p AS (SELECT *, lag(anchor) OVER (PARTITION BY id ORDER BY p) AS begins FROM {name}_m),
{name}_c AS (SELECT id, word, begins, lead(word) OVER (PARTITION BY id ORDER BY p) AS following FROM {name}_p WHERE NOT anchor),
{name}_s AS (SELECT id, list_sort(list(DISTINCT left(md5(word || ' ' || following), {DIGITS}))) AS s FROM {name}_c WHERE begins AND following IS NOT NULL GROUP BY id),
{name}_a AS (SELECT id, [left(md5('=' || string_agg(word, ' ' ORDER BY p)), {DIGITS})] AS s FROM {name}_w GROUP BY id),
{name} AS (SELECT d.id, coalesce({name}_s.s, {name}_a.s, []::VARCHAR[]) AS s FROM {source} d LEFT JOIN {name}_s USING (id) LEFT JOIN {name}_a USING (id))"""


_LIKE_SQL = "CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0 ELSE round(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))), 9) END"
OP5_SQL = (
    """WITH base AS (SELECT doc_id AS id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
pair AS (SELECT a.id, a.t, b.id AS next_id, b.t AS u, length(a.t) AS n FROM base a JOIN base b ON b.r = a.r % (SELECT count(*) FROM base) + 1),
changed AS (SELECT id, left(t, n - n // 4) || left(u, n // 4) AS t FROM pair),"""
    + _set_sql("own", "base")
    + ","
    + _set_sql("edit", "changed")
    + f"""
SELECT p.id AS doc_id, CAST(p.n AS BIGINT) AS n_chars, sha256(c.t) AS edited_sha256,
  array_to_string(o.s, '') AS fingerprint, array_to_string(e.s, '') AS edited_fingerprint,
  CAST({_LIKE_SQL.format(a="o.s", b="e.s")} AS DOUBLE) AS near_edited, CAST({_LIKE_SQL.format(a="o.s", b="f.s")} AS DOUBLE) AS near_next
FROM pair p JOIN changed c ON c.id = p.id JOIN own o ON o.id = p.id JOIN edit e ON e.id = p.id JOIN own f ON f.id = p.next_id"""
)
