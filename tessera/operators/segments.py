"""A store and its inverted index in segments: a write adds one small segment, reads merge them, compaction keeps them few.

A segment has rows, the postings of their words, their words' stems, and the keys that it buries: those it brings anew and those
it deletes. All are written once. What a row's segment doesn't know a later one does: a row lives unless a later segment buries
its key. The published list of segments is the pointer of highest number (see :mod:`snapshots`), so writers conflict and
readers see one list or the other.

Below the root: ``rows``, ``postings``, ``words`` and ``buried``, each with a folder ``in_segment=NAME``; postings of large segments are dealt out
to ``part`` folders by term, so a search opens those of its terms; a small segment has all of them in part -1.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import light_stem
from .index import Index, of_docs
from .snapshots import POINTERS, Conflict, Folder

#: More segments than this are compacted; a segment of fewer rows keeps its postings in one part, others in so many.
MOST, SMALL, PARTS = 10, 50_000, 64


@dataclass(frozen=True)
class Segment:
    """``dead`` and ``dead_tokens``: rows of earlier segments, and their words, that this one buried."""

    name: str
    seq: int
    rows: int = 0
    tokens: int = 0
    buried: int = 0
    dead: int = 0
    dead_tokens: int = 0


class Store:
    """Segments of rows of ``schema`` below ``root``. With ``words``, a function of rows that gives (id, project, kind, parent_id, token_count,
    tokens), they are indexed. The columns ``in_seq`` and ``in_segment`` are the store's own."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", words=None):
        self.spark, self.root, self.schema, self.key, self.words = spark, root.rstrip("/"), schema, key, words
        self.folder = Folder(spark, root)

    # ---- what is published

    @property
    def version(self) -> int:
        found = self.folder.names(POINTERS)
        return int(found[-1]) if found else 0

    def segments(self, version: int | None = None) -> list[Segment]:
        at = self.version if version is None else version
        return [Segment(**x) for x in json.loads(self.folder.read(f"{POINTERS}/{at:012d}"))["segments"]] if at else []

    def tag(self) -> str | None:
        """What the last write was called."""
        return json.loads(self.folder.read(f"{POINTERS}/{self.version:012d}")).get("tag") if self.version else None

    def publish(self, segments: list[Segment], based_on: int, tag: str | None = None) -> None:
        if self.version != based_on:
            raise Conflict(f"version {self.version} was published after {based_on}")
        self.folder.put(f"{POINTERS}/{based_on + 1:012d}", json.dumps({"tag": tag, "segments": [asdict(s) for s in segments]}))

    # ---- reading

    def _files(self, table: str, segments: list[Segment], fields: list[T.StructField]) -> DataFrame:
        """One scan over the folders of ``segments``."""
        paths = [f"{self.root}/{table}/in_segment={s.name}" for s in segments if (s.buried if table == "buried" else s.rows)]
        schema = T.StructType([*fields, T.StructField("in_seq", T.LongType()), T.StructField("in_segment", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def _alive(self, rows: DataFrame, segments: list[Segment], key: str) -> DataFrame:
        """``rows`` (key, in_seq, ...) that no later segment buries. Keys buried are few beside rows, and one row a key."""
        if not any(s.buried for s in segments[1:]):
            return rows
        buried = self._files("buried", segments, [T.StructField("buried_key", self.schema[self.key].dataType)])
        last = buried.groupBy("buried_key").agg(F.max("in_seq").alias("buried_at"))
        return rows.join(last, (rows[key] == last.buried_key) & (F.col("in_seq") < F.col("buried_at")), "left_anti")

    def rows(self, version: int | None = None) -> DataFrame:
        """The live rows."""
        found = self.segments(version)
        return self._alive(self._files("rows", found, list(self.schema)), found, self.key).select(*self.schema.names)

    _POSTING = [T.StructField(n, t) for n, t in (("term", T.StringType()), ("id", T.StringType()), ("tf", T.LongType()), ("token_count", T.LongType()), ("parent_id", T.StringType()), ("part", T.IntegerType()))]

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id, tf, token_count, parent_id) of live rows; with ``terms`` (term) of those only, from the parts that hold them."""
        found = self.segments()
        posts = self._files("postings", found, self._POSTING)
        if terms is not None:
            parts = [r.part for r in terms.select(_part("term")).distinct().collect()]  # PARTS numbers at most
            posts = posts.where(F.col("part").isin(-1, *parts)).join(terms.select("term").distinct(), "term", "left_semi")
        return self._alive(posts, found, "id").select("term", "id", "tf", "token_count", "parent_id")

    def counts(self) -> tuple[int, int]:
        """Live rows and their words, from the list of segments alone."""
        found = self.segments()
        return sum(s.rows - s.dead for s in found), sum(s.tokens - s.dead_tokens for s in found)

    def index(self, terms: DataFrame) -> Index:
        """The index as a search for ``terms`` (term) needs it: postings and frequencies of words that have the stem of one of them,
        and the statistics of all live rows. Equal to those of an index made anew."""
        found = self.segments()
        stems = terms.select(light_stem(F.col("term")).alias("stem")).distinct()
        wanted = self._files("words", found, [T.StructField("term", T.StringType()), T.StructField("stem", T.StringType())]).join(stems, "stem", "left_semi").select("term", "stem").distinct()
        posts = self.postings(wanted)
        per_parent = posts.groupBy("term", "parent_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("parents"))
        rows, tokens = self.counts()
        made = self.words(self.rows())
        stats = made.agg(F.count_distinct("parent_id").alias("n_parents")).select(F.lit(rows).cast("long").alias("n_docs"), F.lit(tokens / rows if rows else None).cast("double").alias("avgdl"), "n_parents")
        return Index(made, posts, per_parent.join(wanted, "term").select("term", "df", "parents", "stem"), stats)

    # ---- writing

    def write(self, rows: DataFrame | None = None, bury: DataFrame | None = None, tag: str | None = None, based_on: int | None = None) -> Segment:
        """Add a segment of ``rows``, one a key, that also buries the keys in ``bury`` (key). It writes those rows and keys, no others.
        ``based_on`` is the version that they were made from, if they were."""
        based_on = self.version if based_on is None else based_on
        found = self.segments(based_on)
        made = self._write(rows, bury, found, max((s.seq for s in found), default=0) + 1)
        if made.rows or made.buried:
            self.publish([*found, made], based_on, tag)
        return made

    def _write(self, rows: DataFrame | None, bury: DataFrame | None, earlier: list[Segment], seq: int, dead: tuple[int, int] | None = None) -> Segment:
        name, at = uuid.uuid4().hex, F.lit(seq).cast("long").alias("in_seq")
        place = lambda table: f"{self.root}/{table}/in_segment={name}"
        n = tokens = 0
        if rows is not None:
            rows.select(*self.schema.names, at).write.parquet(place("rows"))
            stored = self.spark.read.schema(self.schema).parquet(place("rows"))
            n = stored.count()
            if n and self.words is not None:
                tokens = self._write_words(self.words(stored), n, at, place)
        keys = [] if not n else [stored.select(self.key)]
        if bury is not None:
            keys.append(bury.select(F.col(bury.columns[0]).alias(self.key)))
        buried = 0
        if keys and earlier:
            both = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            both.distinct().select(F.col(self.key).alias("buried_key"), at).write.parquet(place("buried"))
            gone = self.spark.read.parquet(place("buried"))
            buried = gone.count()
            if dead is None and buried:
                dead = self._counted(earlier, gone)
        return Segment(name, seq, n, tokens, buried, *(dead or (0, 0)))

    def _counted(self, earlier: list[Segment], gone: DataFrame) -> tuple[int, int]:
        """How many live rows of ``earlier`` have a key in ``gone``, and their words: two columns are read."""
        live = self._alive(self._files("rows", earlier, list(self.schema)), earlier, self.key)
        met = F.col(self.key) == F.col("buried_key")
        if self.words is None:
            return live.select(self.key).join(gone, met, "left_semi").count(), 0
        hit = self.words(live).select("id", "token_count").join(gone, F.col("id") == F.col("buried_key"), "left_semi")
        r = hit.agg(F.count("*").alias("rows"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).first()
        return r.rows, r.tokens

    def _write_words(self, docs: DataFrame, n: int, at, place) -> int:
        part = F.lit(-1) if n < SMALL else _part("term")
        posts = of_docs(docs).postings.select("term", "id", "tf", "token_count", "parent_id", at, part.cast("int").alias("part"))
        # words are counted, and written to their parts, where their rows are; few enough tasks write, so that files aren't many
        dealt = posts.coalesce(1 if n < 100 else max(PARTS, n // SMALL))
        dealt.sortWithinPartitions("part", "term", "id").write.partitionBy("part").parquet(place("postings"))
        made = self.spark.read.parquet(place("postings")).select("term").distinct().select("term", light_stem(F.col("term")).alias("stem"), at)
        (made.coalesce(1) if n < 100 else made).write.parquet(place("words"))
        return docs.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]

    # ---- keeping few

    def due(self) -> list[Segment]:
        """The last segments, where there are too many of all: of those each that isn't over twice as large as all later ones."""
        found = self.segments()
        if len(found) <= MOST:
            return []
        last, total = [], 0
        for s in reversed(found):
            size = s.rows + s.buried
            if len(last) > 1 and size > 2 * total:
                break
            last.append(s)
            total += size
        return last[::-1]

    def compact(self, merged: list[Segment] | None = None, tag: str | None = None) -> Segment | None:
        """Write the last segments (``due()``, or those given) as one, if there are any to merge. Rows that are buried among them
        go for good, and so do buried keys where no earlier segment is left. A row is written again about as often as the
        store doubles."""
        based_on, found = self.version, self.segments()
        merged = self.due() if merged is None else merged
        if len(merged) < 2:
            return None
        if found[-len(merged) :] != merged:
            raise ValueError("only the last segments are merged")
        earlier = found[: -len(merged)]
        rows = self._alive(self._files("rows", merged, list(self.schema)), merged, self.key)
        bury = self._files("buried", merged, [T.StructField("buried_key", self.schema[self.key].dataType)]).select("buried_key") if earlier else None
        live, tokens = (sum(getattr(s, a) for s in found) - sum(getattr(s, b) for s in found) for a, b in (("rows", "dead"), ("tokens", "dead_tokens")))
        made = self._write(rows, bury, earlier, merged[-1].seq, dead=(0, 0))
        before = [sum(getattr(s, a) for s in earlier) - sum(getattr(s, b) for s in earlier) for a, b in (("rows", "dead"), ("tokens", "dead_tokens"))]
        made = Segment(made.name, made.seq, made.rows, made.tokens, made.buried, before[0] + made.rows - live, before[1] + made.tokens - tokens)
        self.publish([*earlier, made], based_on, tag if tag is not None else self.tag())
        return made

    def rollback(self, to: int | None = None) -> int:
        """Publish an earlier list (the one before the current) again; its version."""
        now = self.version
        to = now - 1 if to is None else to
        if not 0 < to < now or not self.folder.exists(f"{POINTERS}/{to:012d}"):
            raise ValueError(f"no version {to} before {now}")
        self.publish(self.segments(to), now)
        return to

    def retain(self, versions: int = 3) -> list[str]:
        """Remove the files of segments that only lists before the last ``versions`` name; their names. Files of a write that
        broke off stay: they might be those of one that goes on."""
        now = self.version
        old = [v for v in range(1, now - versions + 1) if self.folder.exists(f"{POINTERS}/{v:012d}")]
        kept = {s.name for v in range(max(1, now - versions + 1), now + 1) for s in self.segments(v)}
        gone = sorted({s.name for v in old for s in self.segments(v)} - kept)
        for name in gone:
            for table in ("rows", "postings", "words", "buried"):
                self.folder.remove(f"{table}/in_segment={name}")
        for v in old:
            self.folder.remove(f"{POINTERS}/{v:012d}")
        return gone


def _part(term: str):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int").alias("part")
