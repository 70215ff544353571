"""Character error rates and per-case scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import nfc, normalize_for_cer

#: A wrong transcript with at least this confidence counts as confidently wrong.
HIGH_CONFIDENCE = 0.85


#: Of the numbers in _align: bits of the substitutions; above them two for the kind of step, above these the edits.
_SUBS = 30


def _align(refs: list[str], hyps: list[str], edits: list[int]) -> np.ndarray:
    """Substitutions of each pair, whose number of edits is known, all pairs at once over one grid padded to the longest.

    Of equally cheap steps the diagonal comes first, then the deletion, then the insertion.  The grid is filled by
    anti-diagonals, of which each is one array: edits and substitutions of a cell are one number, so that one minimum decides.
    Only the band that a path of so few edits can touch is filled: it must leave cells to come back to the last one.
    """
    n, rows, cols = len(refs), max(map(len, refs)), max(map(len, hyps))
    r, h = np.zeros((n, rows), np.uint32), np.ones((n, cols), np.uint32)
    for i, (a, b) in enumerate(zip(refs, hyps, strict=True)):
        r[i, : len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32)
        h[i, cols - len(b) :] = np.frombuffer(b.encode("utf-32-le"), np.uint32)[::-1]  # from its end: h[:, cols - j] is character j
    nr, nh = np.array([len(x) for x in refs]), np.array([len(x) for x in hyps])
    edit, kind = 1 << (_SUBS + 2), 1 << _SUBS
    longer = nh - nr
    spare = (np.array(edits) - np.abs(longer)) // 2
    low, high = int((np.minimum(longer, 0) - spare).min()), int((np.maximum(longer, 0) + spare).max())  # of j - i
    outside = np.int64(1) << 62
    ends: dict[int, list[int]] = {}
    for i, d in enumerate((nr + nh).tolist()):
        ends.setdefault(d, []).append(i)
    found = np.zeros(n, np.int64)
    older, last, new = (np.zeros((n, rows + 1), np.int64) for _ in range(3))
    for d in range(max(ends) + 1):
        first, end = max(1, d - cols, -((high - d) // 2)), min(rows, d - 1, (d - low) // 2)  # cells (i, d - i) off the borders, in the band
        if first <= end:
            step = (r[:, first - 1 : end] != h[:, cols - d + first : cols - d + end + 1]) * np.int64(edit + 1)
            step += older[:, first - 1 : end]
            np.minimum(step, last[:, first - 1 : end] + (edit + kind), out=step)
            np.minimum(step, last[:, first : end + 1] + (edit + 2 * kind), out=step)
            np.bitwise_and(step, ~(3 * kind), out=new[:, first : end + 1])
        for beside in (first - 1, end + 1):
            if 0 <= beside <= rows:
                new[:, beside] = outside
        if d <= min(cols, high):
            new[:, 0] = d * edit
        if d <= min(rows, -low):
            new[:, d] = d * edit
        if d in ends:
            found[ends[d]] = new[ends[d], nr[ends[d]]]
        older, last, new = last, new, older
    return found & (kind - 1)


#: Up to so many cells of reference times hypothesis a pair goes through _counted: its bits then take at most 25 MB.
_CELLS = 100_000_000


def _columns(ref: str, hyp: str) -> Iterator[tuple[int, int, int]]:
    """For each character of hyp the column of the grid of edits as three numbers, a bit for each character of ref (Myers, Hyyrö).

    Bits of the first: the cell costs as much as the one before it on the diagonal; of the others: one more, and one less, than the one above.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(ref):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(ref)) - 1
    more, less = full, 0
    for c in hyp:
        x = at.get(c, 0) | less
        same = ((((x & more) + more) ^ more) | x) & full
        right = ((less | (full & ~(more | same))) << 1) | 1
        more, less = (((more & same) << 1) | ~(right | same)) & full, right & same
        yield same, more, less


def _counted(ref: str, hyp: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest path; of equally cheap steps back the diagonal comes first, then the deletion."""
    if ref == hyp:
        return 0, 0, 0
    columns = [(same, more) for same, more, _ in _columns(ref, hyp)]
    i, j, swapped, gone, come = len(ref), len(hyp), 0, 0, 0
    while i and j:
        same, more = columns[j - 1]
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif not same >> (i - 1) & 1:
            i, j, swapped = i - 1, j - 1, swapped + 1
        elif more >> (i - 1) & 1:
            i, gone = i - 1, gone + 1
        else:
            j, come = j - 1, come + 1
    return swapped, gone + i, come + j


def _distance(ref: str, hyp: str) -> int:
    """The edits alone."""
    if ref == hyp:
        return 0
    more, less = (1 << len(ref)) - 1, 0
    for _, more, less in _columns(ref, hyp):  # noqa: B007
        pass
    return len(hyp) + more.bit_count() - less.bit_count()


@F.pandas_udf(T.IntegerType())
def _distances(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else _distance(a, b) for a, b in zip(ref, hyp, strict=True)], dtype="Int32")


def edit_distance(ref: Column, hyp: Column) -> Column:
    """The edits as F.levenshtein counts them, 64 characters of the reference at once; equal texts have none and stay in the JVM."""
    other = ref != hyp
    return F.when(ref == hyp, 0).otherwise(_distances(F.when(other, ref), F.when(other, hyp)))


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions", "reference_characters")])


@F.pandas_udf(_COUNTS)
def _edit_counts(ref: pd.Series, hyp: pd.Series, edits: pd.Series) -> pd.DataFrame:
    refs, hyps, total = ref.fillna("").tolist(), hyp.fillna("").tolist(), edits.fillna(0).astype("int64").to_numpy()
    out = np.zeros((len(refs), 4), np.int32)
    far = []
    for i, (a, b) in enumerate(zip(refs, hyps, strict=True)):
        if len(a) * len(b) > _CELLS:
            far.append(i)
        else:
            out[i] = *_counted(a, b), len(a)
    # Longer pairs of like size share a grid; a diagonal of all has at most about half a million cells.
    order = sorted(far, key=lambda i: (max(len(refs[i]), len(hyps[i])) // 8, total[i]))
    at = 0
    while at < len(order):
        size = max(len(refs[order[at]]), len(hyps[order[at]]), 1)
        end = at
        while end < len(order) and max(len(refs[order[end]]), len(hyps[order[end]])) <= size + 8 and total[order[end]] <= 2 * total[order[at]] + 64 and (end == at or (end - at) * (size + 8) < 500_000):
            end += 1
        group = order[at:end]
        a, b = [refs[i] for i in group], [hyps[i] for i in group]
        swapped = _align(a, b, total[group].tolist())
        gap = np.array([len(x) - len(y) for x, y in zip(a, b, strict=True)])
        rest = total[group] - swapped  # deletions and insertions; their difference is that of the lengths
        out[group] = np.stack([swapped, (rest + gap) // 2, (rest - gap) // 2, np.array([len(x) for x in a])], 1)
        at = end
    return pd.DataFrame(out, columns=_COUNTS.names)


def edit_counts(ref: Column, hyp: Column) -> Column:
    """Substitutions, deletions, insertions and the reference's length, of texts that are already normalised."""
    ref, hyp = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return _edit_counts(ref, hyp, F.when(F.length(ref).cast("long") * F.length(hyp) > _CELLS, F.levenshtein(ref, hyp)))


def rate(edits: Column, length: Column) -> Column:
    """edits / length; with an empty reference the number of edits (0 if there are none)."""
    return F.when(length == 0, edits.cast("double")).otherwise(edits / length)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts from the built-in distance, where only the total is wanted."""
    return rate(F.levenshtein(ref, hyp), F.length(ref))


def rtf(latency_ms: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, latency_ms / duration_ms)


def with_expression_matches(cases: DataFrame, labels: str = "labels", hypothesis: str = "hypothesis") -> DataFrame:
    """cases with ``matches``: for each label (surface_form, normalized_forms) preserved, overcorrected or missing, and the form found.

    Plain containment after NFC of the hypothesis; the surface form first, then the normalised forms in order.
    """
    out = cases.withColumn("_text", nfc(F.coalesce(hypothesis, F.lit(""))))
    return out.withColumn("matches", _matches(F.col(labels), F.col("_text"))).drop("_text")


def dialect_metric(matches: Column) -> Column:
    """Of a case's matches: how many, each kind's share, and how many labels there are; without labels 1 and 0."""
    n = F.size(matches)
    count = lambda s: F.size(F.filter(matches, lambda m: m["match_status"] == s))
    share = lambda k, empty: F.when(n > 0, k / n).otherwise(empty)
    kept, lost = count("preserved"), count("overcorrected")
    return F.struct(F.greatest(n, F.lit(0)).alias("expressions"), kept.alias("preserved"), lost.alias("overcorrected"), share(kept, 1.0).alias("preservation_rate"), share(lost, 0.0).alias("overcorrection_rate"))


def _matches(labels: Column, text: Column) -> Column:
    def one(label: Column) -> Column:
        other = F.get(F.filter(label["normalized_forms"], lambda f: F.contains(text, f)), F.lit(0))
        kept = F.contains(text, label["surface_form"])
        return F.struct(
            label["surface_form"].alias("surface_form"), F.when(kept, "preserved").when(other.isNotNull(), "overcorrected").otherwise("missing").alias("match_status"),
            F.when(kept, label["surface_form"]).otherwise(other).alias("matched_form"),
        )

    return F.transform(labels, one)


def high_confidence_wrong(error_rate: Column, confidence: Column) -> Column:
    return F.coalesce((error_rate > 0) & (confidence >= HIGH_CONFIDENCE), F.lit(False))


def score_cases(cases: DataFrame) -> DataFrame:
    """cases (reference, hypothesis, confidence, any others) with normalised texts, edits, ref_chars, cer and the flag.

    The totals come from the built-in distance, so that no Python runs but the normalisation of texts beyond ASCII.
    """
    out = cases.withColumn("nr", normalize_for_cer(F.coalesce("reference", F.lit("")))).withColumn("nh", normalize_for_cer(F.coalesce("hypothesis", F.lit(""))))
    out = out.withColumn("edits", F.levenshtein("nr", "nh")).withColumn("ref_chars", F.length("nr"))
    out = out.withColumn("cer", rate(F.col("edits"), F.col("ref_chars")))
    return out.withColumn("high_confidence_wrong", high_confidence_wrong(F.col("cer"), F.col("confidence")))


def failure_flags(overcorrected: Column, confidently_wrong: Column) -> Column:
    """Failure types that follow from a score alone."""
    return F.array_distinct(F.array_compact(F.array(F.when(overcorrected > 0, "LANGUAGE_MODEL_BIAS"), F.when(overcorrected > 0, "DECODING"), F.when(confidently_wrong, "CALIBRATION"))))
