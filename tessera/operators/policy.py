"""Canonical sources, quarantine, namespaces and metadata predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import APOSTROPHES, GENERIC_SOURCES, RESERVED_SCOPES
from ..functions.text import _tokenized

_CODE = "[A-Za-z0-9_-]+"
#: Where a source's address or legacy path holds a post's code.
SOURCE_CODE = rf"(?i)(?:instagram\.com/(?:reel|p|tv)/|instagram-file:)({_CODE})"
ARCHIVE_CODE = rf"(?i)/Promtlarim/instagram/({_CODE})\.md$"
FRONT_USABLE = r"""(?mi)^usable:\s*["']?(false|true|0|1|no|yes)\b"""


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _found(c: Column, pattern: str) -> Column:
    return _present(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1))


def shortcode(have: dict[str, Column]) -> Column:
    """A record's post code: its own field, else an ``ig:`` id, else its source's address, else the legacy archive path.

    ``have`` maps field names to columns; fields that a table lacks are left out.
    """
    get = lambda k: have.get(k, F.lit(None).cast("string"))
    source, parent = F.replace(get("source"), F.lit("\\"), F.lit("/")), F.replace(get("parent_id"), F.lit("\\"), F.lit("/"))
    tries = [F.when(get("shortcode").rlike(f"^{_CODE}$"), get("shortcode"))]
    tries += [_found(get(k), rf"^ig:({_CODE})(?::|$)") for k in ("id", "parent_id", "canonical_id")]
    tries += [_found(source, SOURCE_CODE), _found(source, ARCHIVE_CODE), _found(parent, ARCHIVE_CODE)]
    return F.coalesce(*tries)


def source_key(have: dict[str, Column]) -> Column:
    """What a record is grouped by: its post, else the first of parent, canonical id and source that isn't empty; a
    generic source is no group, so such a record stands for itself."""
    code = shortcode(have)
    first = F.coalesce(*[_present(have[k]) for k in ("parent_id", "canonical_id", "source") if k in have], F.lit(None).cast("string"))
    return F.when(code.isNotNull(), F.concat(F.lit("ig:"), code)).when(first.isNull() | first.isin(*GENERIC_SOURCES), have["id"]).otherwise(first)


def has_front_matter(text: Column) -> Column:
    """Whether a text starts with a header that names a post."""
    header = F.element_at(F.split(text, "\n---", 2), 1)
    return F.coalesce(text.startswith("---") & header.rlike(r"(?m)^shortcode:"), F.lit(False))


def front_matter_usable(text: Column) -> Column:
    """The header's ``usable`` flag: true, false, or null where there is none. Only the first 8192 signs are a header."""
    header = F.element_at(F.split(F.left(text, F.lit(8192)), "\n---", 2), 1)
    flag = F.lower(F.regexp_extract(header, FRONT_USABLE, 1))
    return F.when(text.startswith("---") & (flag != ""), ~flag.isin("false", "0", "no"))


def usable(rows: DataFrame, archive: DataFrame, on: list[str], flag: str | None = None) -> DataFrame:
    """Rows that aren't quarantined: not by their own flag, nor by the archive's status (``on``, ``status``); no entry keeps."""
    if flag:
        rows = rows.where(~F.coalesce(F.lower(F.trim(F.col(flag))).isin("false", "0", "no"), F.lit(False)))
    return rows.join(archive.where(F.coalesce("status", F.lit(True)) == F.lit(False)).select(*on).distinct(), on, "left_anti")


def where(condition: dict[str, Any] | None) -> Column:
    """A metadata predicate as a Column. Missing metadata equals nothing: ``$ne`` and ``$nin`` are true for it."""
    out = F.lit(True)
    for key, expected in (condition or {}).items():
        if key in ("$and", "$or"):
            parts = [where(c) for c in expected]
            joined = F.lit(key == "$and")
            for p in parts:
                joined = joined & p if key == "$and" else joined | p
            out = out & joined
        elif isinstance(expected, dict):
            for op, value in expected.items():
                out = out & _compare(F.col(key), op, value)
        else:
            out = out & F.col(key).eqNullSafe(expected)
    return out


def _compare(c: Column, op: str, value: Any) -> Column:
    if op == "$eq":
        return c.eqNullSafe(value)
    if op == "$ne":
        return ~c.eqNullSafe(value)
    if op in ("$in", "$nin"):
        inside = F.coalesce(c.isin(*[v for v in value if v is not None]), F.lit(False)) if value else F.lit(False)
        if None in value:
            inside = inside | c.isNull()
        return inside if op == "$in" else ~inside
    return F.lit(False)


def scope(project: str, current: str, kind: str = "") -> dict[str, Any] | None:
    """The predicate of a search scope: the current project with what is shared, everything, or one named project."""
    parts: list[dict] = []
    if project in ("current", ""):
        parts.append({"project": {"$in": [current, "shared"]}})
    elif project not in RESERVED_SCOPES:
        parts.append({"project": project})
    if kind:
        parts.append({"kind": kind})
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def clamp_top_k(k: int, most: int = 30) -> int:
    return max(1, min(int(k), most))


# Words that carry no meaning in a question, and what topic words are called in English.
FILLER = frozenset(
    "salom hello hi iltimos please menga manga man bizga ber bering ayt aytib haqida batafsil ma'lumot ma’lumot tushuntir tushuntirib kerak qanday nima "
    "qaysi va bilan uchun bu shu shuni yordamida yordam menga manashu what how why which where when who does do is are used use using about tell me "
    "explain show the a an and for of to in it can you i".split()
)
TRANSLATIONS = {
    "shaxsiy": "personal", "yordamchi": "assistant", "bosqich": "step", "to'qqiz": "9", "yig'ish": "build", "yaratish": "build",
    "xotira": "memory", "doimiy": "persistent", "foydalanuvchi": "user", "xohish": "preferences", "bilim": "knowledge", "grafig": "graph",
    "graf": "graph", "kod": "code", "hujjat": "document", "qidirish": "search", "qidiruv": "search", "vektorlarsiz": "vectorless",
    "vektorsiz": "vectorless", "mantiqiy": "reasoning", "katta": "large", "spetsifikatsiya": "specification", "reja": "plan",
    "vazifa": "task", "ajratish": "breakdown", "mustaqil": "independent", "tekshiruvchi": "audits", "yozuvchi": "writes", "ikki": "dual",
    "muvaffaqiyatli": "successful", "yechim": "solution", "saqlash": "store", "ko'nikma": "skill", "yangi": "new", "guruh": "group",
    "bosh": "lead", "boshqarish": "orchestration", "eslatma": "notes", "kontekst": "context", "uzoq": "long", "muddatli": "term",
    "xavfsizlik": "security", "fayl": "file", "oy": "month", "hafta": "week", "sof": "net", "foyda": "profit", "tushum": "revenue",
    "daromad": "income",
}
# Phrases that only say where to look, the two words for a code base, and the limits of a rewriting.
FRAMING = (
    "bilimlar bazasidagi manbalarga asoslanib", "bilimlar bazasidagi manbaga tayanib", "bazadagi manbalarga asoslanib", "bazadagi manbaga tayanib",
)
CODE, BASE, CODEBASE = "kod", "baza", "codebase"
MOST_WORDS, MOST_CHARS, PREFIX_ROOT = 40, 1400, 6
#: What a question consists of: quoted strings, framing, numbers with their units, words.
SAID = re.compile(
    r'(?P<quoted>"[^"]+")|(?P<framing>\b(?:' + "|".join(x.replace(" ", r"\s+") for x in FRAMING) + r")\b)"
    r"|(?P<number>\$?\d+(?:[.,]\d+)*(?:[km])?\+?)|(?P<word>\w+(?:[\x27-]\w+)*)", re.I,
)


def _anchored(word: str) -> bool:
    """Whether a word must survive as it is: a quoted string, or one with a digit."""
    return word.startswith('"') or any(c.isdigit() for c in word)


def _topic(word: str) -> str:
    """A topic word in English, by itself or by its root; others as they are."""
    got = _tokenized(re.sub(f"[{APOSTROPHES}]", "'", word.lower()))
    plain = got[0] if len(got) == 1 else word.casefold()
    by_root = (new for root, new in TRANSLATIONS.items() if len(root) >= PREFIX_ROOT and plain.startswith(root))
    return TRANSLATIONS.get(plain) or next(by_root, word)


def _in_english(words: list[str]) -> list[str]:
    """Each word's rule: anchored ones stay, the two words for a code base become one, the rest are looked up."""
    out: list[str] = []
    for k, word in enumerate(words):
        after_code = k and words[k - 1].casefold() == CODE and word.casefold().startswith(BASE)
        if after_code:
            out[-1] = re.sub(rf"(?i)^{BASE}\w*", CODEBASE, word)
        else:
            out.append(word if _anchored(word) else _topic(word))
    return out


def query_variants(question: str) -> list[str]:
    """At most two rewritings of a question: without framing and filler, and that with topic words in English.

    Quoted strings and numbers always survive; of a long question the first and last words do. Nothing left, or too much,
    gives none.
    """
    found = SAID.finditer(re.sub(f"[{APOSTROPHES}]", "'", str(question)))
    words = [m[0] for m in found if m.lastgroup == "quoted" or (m.lastgroup != "framing" and m[0].casefold() not in FILLER)]
    half, n = MOST_WORDS // 2, len(words)
    if n > MOST_WORDS:
        words = [w for k, w in enumerate(words) if k < half or k >= n - half or _anchored(w)]
    plain = " ".join(words)
    return list(dict.fromkeys([plain, " ".join(_in_english(words))])) if 0 < len(plain) <= MOST_CHARS else []


def rewritten(queries: DataFrame) -> DataFrame:
    """(qid, variant, text): the rewritings (:func:`query_variants`) of every question (qid, text); a null one has none."""
    kind = dict(queries.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, i, v) for k, t in enumerate(b.column(1).to_pylist()) for i, v in enumerate(query_variants(t or ""))]
            at, n, text = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(text, pa.string())], names=["qid", "variant", "text"])

    return queries.select("qid", "text").mapInArrow(run, f"qid {kind}, variant int, text string")
