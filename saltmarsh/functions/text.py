"""Text normalisation, surface keys and names, as column expressions.

Unicode normalisation and case folding are not in Spark; they run as Arrow UDFs, which get null for ASCII rows (whose result is
known without them).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are Python objects at once.
_SLICE = 200


def _each(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    parts = [pa.array([None if x is None else change(x) for x in texts.slice(at, _SLICE).to_pylist()], texts.type) for at in range(0, len(texts), _SLICE)]
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(T.StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return _each(s, lambda x: x if unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@F.arrow_udf(T.StringType())
def _folded(s: pa.Array) -> pa.Array:
    return _each(s, lambda x: unicodedata.normalize("NFKC", x).casefold())


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def nfc(s: Column) -> Column:
    return F.when(_ascii(s), s).otherwise(_nfc(F.when(~_ascii(s), s)))


def nfkc_casefold(s: Column) -> Column:
    return F.when(_ascii(s), F.lower(s)).otherwise(_folded(F.when(~_ascii(s), s)))


def normalize_for_cer(s: Column) -> Column:
    """NFC without separators (Z*) and punctuation (P*); controls and symbols stay and count."""
    return F.regexp_replace(nfc(s), r"[\p{Z}\p{P}]", "")


def surface_key(s: Column) -> Column:
    """NFKC, case-folded, letters and numbers only."""
    return F.regexp_replace(nfkc_casefold(s), r"[^\p{L}\p{N}]", "")


def pool_surface_key(s: Column) -> Column:
    """NFKC, case-folded, without white space; punctuation stays."""
    return F.regexp_replace(nfkc_casefold(s), r"(?U)\s", "")


def contains_form(hypothesis: Column, form: Column) -> Column:
    """Whether a form occurs in a hypothesis, both as for the error rate; a form that becomes empty always does."""
    return F.contains(normalize_for_cer(hypothesis), normalize_for_cer(form))


def tokens_without_punct(s: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(nfc(s), r"\p{P}", ""), r"(?U)\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def split_label_terms(s: Column) -> Column:
    """The quoted terms of a list such as "a", "b"; any other text is one term without its quotes, an empty one none."""
    quoted = F.transform(F.regexp_extract_all(s, F.lit('["“]([^"”]+)["”]'), F.lit(1)), lambda t: F.trim(t))
    rest = F.trim(F.regexp_replace(F.regexp_replace(s, '["“][^"”]+["”]', ""), "[,，]", ""))
    bare = F.trim(F.regexp_replace(F.trim(s), "^[\"“”']+|[\"“”']+$", ""))
    return F.when((F.size(quoted) > 0) & (rest == "") & s.isNotNull(), quoted).when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(bare))


def expand_labels(labels: Column) -> Column:
    """Labels (surface_form, normalized_forms) with quoted lists as labels of their own; ``problem`` where the counts differ.

    Several surfaces take one normalised form each, in order; a single one keeps them all.
    """
    def one(label: Column) -> Column:
        surfaces = split_label_terms(label["surface_form"])
        forms = F.flatten(F.transform(F.coalesce(label["normalized_forms"], F.array().cast("array<string>")), split_label_terms))
        many = (F.size(surfaces) > 1) & (F.size(forms) > 0)
        wrong = many & (F.size(forms) != F.size(surfaces))
        return F.transform(surfaces, lambda s, i: F.struct(s.alias("surface_form"), F.when(many & ~wrong, F.array(F.get(forms, i))).otherwise(forms).alias("normalized_forms"), F.when(wrong, "counts differ").alias("problem")))

    return F.flatten(F.transform(labels, one))


def safe_record_name(s: Column) -> Column:
    """Only letters, digits, dot, dash and underscore, at most 180; null where nothing is left."""
    name = F.left(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", ""), F.lit(180))
    return F.when(name != "", name)


def source_recording_id(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def audio_suffix(name: Column, default: str = ".bin") -> Column:
    """The file name's extension in small letters, or the default."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1)), F.lit("")), F.lit(default))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5 (RFC 4122), of a text in a namespace given by 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def import_utterance_id(import_id: Column, prompt_id: Column, sha256: Column, prefix: str | None = None) -> Column:
    """The id of an imported recording; ``prefix``: a name space of the caller's own before the others, where its ids have one."""
    return uuid5(URL_NAMESPACE, F.concat_ws(":", *([F.lit(prefix)] if prefix is not None else []), import_id, prompt_id, sha256))
