"""The chunk store: snapshots that are merged, synchronised and audited as sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import commit_snapshot, current_snapshot  # noqa: F401


def eav_pivot(eav: DataFrame, entity: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """One row an entity, one column a key. The keys are given, so no job looks for them."""
    return eav.groupBy(entity).agg(*(F.max(F.when(F.col(key) == k, F.col(value))).alias(k) for k in keys))


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(F.lit("file_"), F.left(F.sha1(F.concat(source, F.lit("#"), index.cast("string")).cast("binary")), F.lit(16)))


def content_hashes(document: Column, meta: dict[str, Column]) -> list[Column]:
    """SHA-256 of the text and of the metadata as JSON with sorted keys; a null field is a JSON null, a null text is empty."""
    fields = F.to_json(F.struct(*(meta[k].alias(k) for k in sorted(meta))), {"ignoreNullFields": "false"})
    return [F.sha2(F.coalesce(document, F.lit("")), 256).alias("doc_sha256"), F.sha2(fields, 256).alias("meta_sha256")]


def corpus_hash(docs: DataFrame, key: str = "id") -> DataFrame:
    """One row, hash: of a corpus (key, doc_sha256, meta_sha256).

    Each row's line ``key:doc:meta`` is hashed; lines are grouped by the first digits of their hash, a group's sorted
    hashes are hashed, and so are the groups' hashes, level by level. A group has about 256 members at every level, so no
    task sees all rows, and the order of rows doesn't matter.
    """
    line = F.concat_ws(":", F.col(key).cast("string"), "doc_sha256", "meta_sha256")
    level = docs.select(F.sha2(line, 256).alias("h"), F.sha2(line, 256).alias("place"))
    for digits in (6, 4, 2, 0):
        level = level.groupBy(F.left("place", F.lit(digits)).alias("place")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return level.select(F.col("h").alias("hash"))


def memory_cards(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"), F.coalesce("kind", F.lit("note")).alias("kind"), F.coalesce("date", F.lit("?")).alias("date"), "project")


def newest(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.orderBy(F.coalesce("date", F.lit("")).desc(), "id").limit(max(1, n))


def last_of_each(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``; without an order, and among equal ones, the greatest row."""
    if not rows.columns:
        return rows
    sortable = [F.to_json(F.col(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in rows.dtypes]
    by = F.struct(*([F.col(order).alias("__order")] if order else []), *(x.alias(f"__{i}") for i, x in enumerate(sortable)))
    keyed = rows.groupBy(F.col(key).alias("__key"))
    if not any("map<" in t or "variant" in t for _, t in rows.dtypes):  # then what orders a row is the row, and it goes once
        return keyed.agg(F.max(by).alias("__row")).select(*(F.col(f"__row.__{i}").alias(c) for i, c in enumerate(rows.columns)))
    return keyed.agg(F.max_by(F.struct(*rows.columns), by).alias("__row")).select("__row.*")


def upsert(target: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``target`` with the rows of ``new`` in place of those of equal key; of rows of ``new`` with one key the last by
    ``order`` counts (:func:`last_of_each`)."""
    last = last_of_each(new, key, order)
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def delete(target: DataFrame, ids: DataFrame | None = None, condition: Column | None = None, key: str = "id") -> DataFrame:
    """``target`` without the rows whose key is among ``ids`` or that meet ``condition``."""
    out = target if condition is None else target.where(~F.coalesce(condition, F.lit(False)))
    return out if ids is None else out.join(ids.select(key), key, "left_anti")


def replace_source(target: DataFrame, new: DataFrame, key: str = "id", source: str = "source", sources: DataFrame | None = None) -> DataFrame:
    """``new`` holds all rows that its sources have now: rows of those sources that it lacks go, its rows come in.

    ``sources`` (source) names what was read; one that ``new`` has no row of became empty, and all its rows go.
    """
    read = new.select(source) if sources is None else new.select(source).unionByName(sources.select(source))
    return target.join(read.distinct(), source, "left_anti").unionByName(last_of_each(new, key))


def prune(target: DataFrame, live: DataFrame, source: str = "source") -> DataFrame:
    """``target`` without the rows whose source is gone."""
    return target.join(live.select(source).distinct(), source, "left_semi")


def sync_plan(old: DataFrame, new: DataFrame, key: str = "id", hashes: tuple[str, ...] = ("doc_sha256", "meta_sha256")) -> DataFrame:
    """(key, action): upsert, delete or unchanged, by comparing manifests; each is one shuffle of keys and hashes."""
    o = old.select(key, F.struct(*hashes).alias("o"))
    n = new.select(key, F.struct(*hashes).alias("n"))
    action = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull() | ~F.col("o").eqNullSafe(F.col("n")), "upsert").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def drift(old: DataFrame, new: DataFrame, key: str = "id", hashes: tuple[str, ...] = ("doc_sha256", "meta_sha256")) -> DataFrame:
    """One row: new, modified, deleted and total keys."""
    o, n = old.select(key, F.struct(*hashes).alias("o")), new.select(key, F.struct(*hashes).alias("n"))
    both = o.join(n, key, "full_outer")
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o").eqNullSafe(F.col("n"))
    return both.agg(F.count_if(F.col("o").isNull()).alias("new"), F.count_if(changed).alias("modified"), F.count_if(F.col("n").isNull()).alias("deleted"), F.count("*").alias("total"))


def missing(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).join(right.select(key), key, "left_anti")


def reconcile(store: DataFrame, index: DataFrame, pending: DataFrame, key: str = "id") -> DataFrame:
    """(key, action): what brings the index in line with the store; pending keys that live are written again."""
    add = missing(store, index, key).withColumn("action", F.lit("add"))
    drop = missing(index, store, key).withColumn("action", F.lit("drop"))
    again = pending.select(key).join(store.select(key), key, "left_semi").join(index.select(key), key, "left_semi").withColumn("action", F.lit("rewrite"))
    return add.unionByName(drop).unionByName(again)


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, n): counts of both sides and rows that only one of them has."""
    cols = expected.columns
    counts = [("expected", expected), ("actual", actual), ("missing", expected.exceptAll(actual.select(*cols))), ("excess", actual.select(*cols).exceptAll(expected))]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def repair(target: DataFrame, plan: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``target`` after a plan (key, action) of :func:`sync_plan` or :func:`reconcile`: keys to add, upsert or rewrite come
    from ``rows``, keys to delete or drop go, and nothing else is touched."""
    bring = rows.join(plan.where(F.col("action").isin("add", "upsert", "rewrite")).select(key), key, "left_semi")
    gone = plan.where(F.col("action").isin("delete", "drop")).select(key)
    return upsert(delete(target, gone, key=key), bring, key)


def retry_pending(index: DataFrame, pending: DataFrame, rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The index with the pending keys written that live in ``rows``, and what stays pending: nothing, unless a key came up
    that ``rows`` lacks; such keys are dropped from the index, too."""
    live = pending.select(key).distinct().join(rows.select(key), key, "left_semi")
    dead = pending.select(key).distinct().join(rows.select(key), key, "left_anti")
    return upsert(delete(index, dead, key=key), rows.join(live, key, "left_semi").select(*index.columns), key), pending.where(F.lit(False))


def health(spark, root: str, needed: tuple[str, ...] = ("id", "document"), open_store=None) -> DataFrame:
    """(step, ok, detail): whether a store opens, has its columns, counts and answers a query. A step after a failed one
    isn't tried. ``open_store`` gives its rows, or None where nothing is published; without it they are the current snapshot."""
    from .snapshots import current_snapshot, version

    out: list[tuple[str, bool, str]] = []
    rows: list = []

    def opened() -> str:
        found = current_snapshot(spark, root) if open_store is None else open_store()
        if found is None:
            raise ValueError("nothing is published")
        rows.append(found)
        return f"version {version(spark, root)}"

    def columns() -> str:
        lacking = [c for c in needed if c not in rows[0].columns]
        if lacking:
            raise ValueError(f"columns are missing: {', '.join(lacking)}")
        return f"{len(rows[0].columns)} columns"

    def counted() -> str:
        return f"{rows[0].count()} rows"

    def queried() -> str:
        return f"{rows[0].where(F.col(needed[0]).isNull()).count()} rows without {needed[0]}"

    for step in (opened, columns, counted, queried):
        try:
            out.append((step.__name__, True, step()))
        except Exception as e:
            out.append((step.__name__, False, str(e).splitlines()[0][:200]))
            break
    return spark.createDataFrame(out, "step string, ok boolean, detail string")


def stale(processes: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Rows of ``processes`` (started: timestamp) that are older than ``seconds`` at ``now``, parts of a second included."""
    at = lambda c: c.cast("timestamp").cast("double")
    return processes.where(at(now) - at(F.col("started")) > seconds)
