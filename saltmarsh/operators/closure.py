"""Closures over tables that refer to one another: lineage to the root, and what goes with an archived record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionary import find_forms
from ..shared import forget, saved

#: Rate, channels and codec of the assets of each role.
ROLE_FORMATS = {
    "master_48k_mono": (48_000, 1, "pcm_s24le"), "master_48k_stereo": (48_000, 2, "pcm_s24le"), "asr_16k_mono": (16_000, 1, "pcm_s16le"),
    "pronunciation_24k_mono": (24_000, 1, "pcm_s16le"), "tts_48k_mono": (48_000, 1, "pcm_s24le"), "derived_16k_mono": (16_000, 1, "pcm_s16le"),
}


def lineage_roots(assets: DataFrame) -> DataFrame:
    """(utterance_id, sha256, ended, root_sha256, depth) of each asset (utterance_id, sha256, parent_sha256).

    ended: ``root`` (root_sha256 is the ancestor without a parent, depth steps up), ``dangling`` (root_sha256 is the last ancestor there is; its
    parent is no asset of the utterance), or ``cycle`` (it never ends; both null).  Every asset points to its parent, and in each
    round to what its pointer's own pointer points to, so a chain of n takes log2(n) rounds; the rows of a round are a table in the
    shared folder.  An asset given with several parents is followed along the least.
    """
    nodes = assets.where("sha256 is not null").groupBy("utterance_id", "sha256").agg(F.min("parent_sha256").alias("parent"))
    there = nodes.select(F.col("utterance_id").alias("_u"), F.col("sha256").alias("_s"), F.lit(True).alias("_there"))
    first = nodes.join(there, F.col("utterance_id").eqNullSafe(F.col("_u")) & (F.col("parent") == F.col("_s")), "left")
    up = F.when(F.col("_there"), F.col("parent"))
    end = F.when(F.col("parent").isNull(), "root").when(F.col("_there").isNull(), "dangling")
    state = saved(first.select("utterance_id", "sha256", F.coalesce(up, F.col("sha256")).alias("at"), F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), end.alias("ended")), "lineage")
    longest = state.groupBy("utterance_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        open_ = state.where("ended is null")
        if open_.isEmpty():
            break
        other = state.select(F.col("utterance_id").alias("_u"), F.col("sha256").alias("_s"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("ended").alias("_ended"))
        moved = open_.join(other, F.col("utterance_id").eqNullSafe(F.col("_u")) & (F.col("at") == F.col("_s"))).select("utterance_id", "sha256", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_ended").alias("ended"))
        after = saved(state.where("ended is not null").unionByName(moved), "lineage")
        forget(state)
        state = after
    known = F.col("ended").isNotNull()
    return state.select("utterance_id", "sha256", F.coalesce("ended", F.lit("cycle")).alias("ended"), F.when(known, F.col("at")).alias("root_sha256"), F.when(known, F.col("depth")).alias("depth"))


def lineage_violations(assets: DataFrame) -> DataFrame:
    """(rule, key, detail) of the assets (utterance_id, role, sha256, parent_sha256, rate, channels, codec) of utterances.

    cycle and dangling: an asset that doesn't lead to a root; two_roots and no_root: an utterance of which not all assets lead to one; format: a
    role of ROLE_FORMATS in another format.
    """
    roots = lineage_roots(assets)
    counts = roots.groupBy("utterance_id").agg(F.countDistinct(F.when(F.col("ended") == "root", F.col("root_sha256"))).alias("n"))
    wanted = F.coalesce(*[F.when(F.col("role") == r, ~(F.col("rate").eqNullSafe(rate) & F.col("channels").eqNullSafe(n) & F.col("codec").eqNullSafe(codec))) for r, (rate, n, codec) in ROLE_FORMATS.items()])
    u = F.col("utterance_id").cast("string").alias("key")
    found = roots.where("ended <> 'root'").select(F.col("ended").alias("rule"), u, F.col("sha256").cast("string").alias("detail"))
    found = found.unionByName(counts.where("n <> 1").select(F.when(F.col("n") > 1, "two_roots").otherwise("no_root").alias("rule"), u, F.col("n").cast("string").alias("detail")))
    return found.unionByName(assets.where(wanted).select(F.lit("format").alias("rule"), u, F.col("sha256").cast("string").alias("detail")))


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` refer to ``id`` of ``parent`` by a column: its value (key), its entries (array), or a text that names it (text).

    In a text an id stands between the two parts of ``around``.
    """

    child: str
    column: str
    parent: str
    kind: str = "key"
    around: tuple[str, str] = ("", "")


def _referring(rows: DataFrame, link: Link, ids: DataFrame) -> DataFrame:
    """Ids of rows that refer to one of ids."""
    wanted = ids.select(F.col("id").alias("_ref"))
    if link.kind == "key":
        return rows.join(wanted, F.col(link.column) == F.col("_ref"), "left_semi").select("id")
    if link.kind == "array":
        return rows.select("id", F.explode(link.column).alias("_own")).join(wanted, F.col("_own") == F.col("_ref"), "left_semi").select("id").distinct()
    if link.kind == "text":
        before, after = link.around
        return find_forms(rows.select("id", link.column), link.column, ids.select(F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after)).alias("form"))).select("id").distinct()
    raise ValueError(f"unknown kind of link: {link.kind}")


def archive_closure(seeds: dict[str, DataFrame], tables: dict[str, DataFrame], links: list[Link], shared: dict[str, list[tuple[str, str]]] | None = None) -> dict[str, DataFrame]:
    """Of every table (with a column id) the ids that go when the seeds (id) go, as tables in the shared folder.

    Rows that refer to one that goes go too, along the links and to a fixed point; only rows found in the last round are followed on, so each row is
    followed once.  shared: for a table of assets the (table, column) that use them by id; an asset goes if a row that goes uses it and
    no row that stays does.  Links may form circles; null references lead nowhere; seeds that no table has are left out.
    """
    shared = shared or {}
    gone, fresh = {}, {}
    for name, t in tables.items():
        seed = t.select("id").join(seeds[name].select("id"), "id", "left_semi").distinct() if name in seeds else t.select("id").limit(0)
        gone[name] = fresh[name] = saved(seed, "archived")
    while any(not f.isEmpty() for f in fresh.values()):
        found: dict[str, list[DataFrame]] = {}
        for link in links:
            if not fresh[link.parent].isEmpty():
                found.setdefault(link.child, []).append(_referring(tables[link.child], link, fresh[link.parent]))
        fresh = {name: t.select("id").limit(0) for name, t in tables.items()}
        for name, parts in found.items():
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            fresh[name] = saved(every.distinct().join(gone[name], "id", "left_anti"), "archived")
            gone[name] = saved(gone[name].unionByName(fresh[name]), "archived")
    for name, users in shared.items():
        used, kept = [], []
        for table, column in users:
            rows = tables[table].select("id", F.col(column).alias("asset")).where("asset is not null")
            used.append(rows.join(gone[table], "id", "left_semi").select("asset"))
            kept.append(rows.join(gone[table], "id", "left_anti").select("asset"))
        both = [used[0], kept[0]]
        for a, b in zip(used[1:], kept[1:], strict=True):
            both = [both[0].unionByName(a), both[1].unionByName(b)]
        alone = both[0].distinct().join(both[1].distinct(), "asset", "left_anti").select(F.col("asset").alias("id"))
        gone[name] = saved(gone[name].unionByName(tables[name].select("id").join(alone, "id", "left_semi")).distinct(), "archived")
    return gone


def archive_split(gone: dict[str, DataFrame], tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Of every table its (kept, archived) rows."""
    return {name: (t.join(gone[name], "id", "left_anti"), t.join(gone[name], "id", "left_semi")) for name, t in tables.items()}
