"""Readers and parsers: files, chat exports, session logs, posts, and chunking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP
from ..functions import text as tx
from .chunking import BUDGET, budget_chunks, chunk_by_budget  # noqa: F401

TEXT_FILES = r"\.(md|txt|rst)$"
SKIPPED = r"(^|/)(\.venv|kg_db)/"
# Folders without documentation, codes of translations, files about a project rather than its subject.
NO_DOCS = (
    "node_modules .git dist build vendor __pycache__ .venv .changeset .github target out coverage tmp temp tests test testing spec specs e2e mocks test-fixtures "
    "composio-skills evals benchmarks benchmark benchmark-models de-de es ja-jp ko-kr pt-br ru th tr ur vi-vn zh-cn zh-tw zh ja ko fr de pt it ar id pl nl uk "
    "readmes i18n changelog .kiro .opencode .cursor .codex .codex-plugin .codebuddy .gemini .hermes .kimi .openclaw .qwen .trae flatpak "
    "legacy-command-shims site design-systems design-templates plugins packages apps clipper craft figma-plugin tools story old raw bundled-skills "
    "injected-reminders slash-commands mcp-servers .agents assets charts e2e-coverage .plan plans drafts videos rfc-drafts deployment handoffs adr superpowers tips"
).split()
LANGUAGES = "zh zh-cn zh-tw zh_cn zh_tw ja ja-jp ko ko-kr ru es de de-de fr pt pt-br it th tr ur ar pl nl uk vi vi-vn".split()
ABOUT = r"(?i)^(changelog|changes|history|release|whatsnew|license|licence|copying|unlicense|contributing|code_of_conduct|security|governance|maintainers|authors|contributors)"
ABOUT_ANYWHERE = "(?i)(pull_request_template|issue_template)"
NOT_DOCS = ("requirements.txt", "requirements-dev.txt", "roadmap.md", "references.md")
GUIDES = ("claude.md", "agents.md", "architecture.md", "context.md", "guide.md")
LEAST_BYTES = 50


def scannable(path: Column) -> Column:
    return path.rlike(TEXT_FILES) & ~path.rlike(SKIPPED)


def curated(repo: Column, path: Column, size: Column) -> Column:
    """Whether a file (its path within a repository) is documentation worth indexing: a root guide, a skill's definition,
    an assistant's rules, or what a repository of prompts or lessons is kept for."""
    parts = F.split(F.lower(path), "/")
    name, depth = F.element_at(parts, -1), F.size(parts)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = F.regexp_extract(stem, r"[-_.]([a-z]{2}|[a-z]{2}[-_][a-z]{2})$", 1)
    among = lambda *folders: F.arrays_overlap(parts, F.array(*map(F.lit, folders)))
    translated = among(*LANGUAGES) | stem.rlike("^readme[_-]") | suffix.isin(*LANGUAGES)
    about = stem.rlike(ABOUT) | stem.rlike(ABOUT_ANYWHERE) | name.isin(*NOT_DOCS)
    parent = F.when(depth > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    skill = (name == "skill.md") & (repo != "open-design") & ~((repo == "gstack") & (parent.startswith("ios-") | among("openclaw")))
    by_repo = {
        "open-design": among("docs") & ~name.rlike("announcement|whats-new|blog-|theater|pets|troubleshooting|setup"),
        "system-prompts-and-models-of-ai-tools": F.lit(True),
        "system_prompts_leaks": (depth == 2) & ~parts[0].isin("misc", "assets") & ~name.startswith("readme") & ~stem.rlike("personality|voice-mode"),
        "learn-claude-code": F.exists(parts, lambda p: p.startswith("s") & F.contains(p, F.lit("_"))) & (name == "readme.md"),
        "claude-code-best-practice": among("best-practice", "tutorial") & ~among("agent-teams"),
    }
    kept = ((depth == 1) & (name.startswith("readme") | name.isin(*GUIDES))) | skill | (among(".claude") & name.endswith(".md") & ~among("agent-teams"))
    for r, rule in by_repo.items():
        kept = kept | ((repo == r) & (name != "skill.md") & rule)
    return ~F.lower(repo).isin("dify", "freellmapi") & F.lower(path).rlike(TEXT_FILES) & (size >= LEAST_BYTES) & ~among(*NO_DOCS) & ~translated & ~about & kept


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text of every text file below ``paths``, whole; files of other names are never opened."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt,rst}")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(scannable(F.col("path")))


def normalize_source(c: Column) -> Column:
    """Sources compare in lower case; a path also with one kind of slash."""
    return F.when(c.rlike("^https?://") | (c == "save_memory"), F.lower(c)).otherwise(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))))


def _in_order(col: Column, sep: str, *order: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, col.alias("__x"))))
    return F.array_join(F.transform(rows, lambda r: r["__x"]), sep)


def render_markdown(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), tx.collapse_newlines(F.col("text")))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("# Chat "), F.col("conv_id").cast("string"), F.lit("\n\n"), _in_order(line, "\n\n", "turn")).alias("markdown"))


def write_markdown(rendered: DataFrame, path: str) -> None:
    """One text file for each ``conv_id`` folder."""
    rendered.select("conv_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("conv_id").text(path)


def run_lengths(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """(group, chain): runs of equal items in order, as ``A -> B x2``; only the runs are gathered, not the rows."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((~F.col(item).eqNullSafe(F.lag(item).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    runs = rows.select(group, order, item, F.when(first, 1).otherwise(changed).alias("c")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.groupBy(group, "run", item).agg(F.count("*").alias("n"))
    shown = F.when(F.col("n") > 1, F.concat(F.col(item), F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col(item))
    return counted.groupBy(group).agg(_in_order(shown, " -> ", "run").alias("chain"))


def session_render(events: DataFrame) -> DataFrame:
    """(user_id, step, tools, said): tools used since the last message stand before the message that follows them."""
    says = F.col("event_type").isin("purchase", "signup", "view")
    w = Window.partitionBy("user_id").orderBy("event_id")
    step = F.coalesce(F.sum(says.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tool = F.when(~says, F.col("event_type"))
    return events.withColumn("step", step).groupBy("user_id", "step").agg(_in_order(tool, " ", "event_id").alias("tools"), F.max(F.when(says, F.col("event_type"))).alias("said"))


def dedupe_names(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """(order, name): the first of equal slugs keeps it, the next get -2, -3 and so on, past names that are taken.

    A name can only be taken from elsewhere by a slug that ends in a number itself, so slugs that differ by such endings
    make a family. A family of one slug is numbered by a window; only of one with several are the rows gone through in turn.
    """
    family = F.regexp_replace(slug, r"(-[0-9]+)+$", "")
    named = rows.select(F.col(order).alias("__order"), F.col(slug).alias("__slug"), family.alias("__family"))
    mixed = named.groupBy("__family").agg((F.min("__slug") != F.max("__slug")).alias("m")).where("m").select("__family")
    n = F.row_number().over(Window.partitionBy("__slug").orderBy("__order"))
    plain = named.join(mixed, "__family", "left_anti").select("__order", F.when(n == 1, F.col("__slug")).otherwise(F.concat("__slug", F.lit("-"), n.cast("string"))).alias("name"))
    kind = rows.schema[order].dataType.simpleString()

    def number(group: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        following: dict[str, int] = {}
        names = []
        group = group.sort_values("__order")
        for x in group["__slug"]:
            name = x
            while name in used:
                following[x] = following.get(x, 1) + 1
                name = f"{x}-{following[x]}"
            used.add(name)
            names.append(name)
        return pd.DataFrame({"__order": group["__order"], "name": names})

    others = named.join(mixed, "__family", "left_semi").groupBy("__family").applyInPandas(number, f"__order {kind}, name string")
    return plain.unionByName(others).withColumnRenamed("__order", order)


def post_items(posts: DataFrame) -> DataFrame:
    """(id, shortcode, document): a summary and one row for each line of a post."""
    items = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = posts.select("shortcode", F.posexplode(F.concat(F.array(F.left("text", F.lit(200))), items)).alias("i", "document"))
    kind = F.when(F.col("i") == 0, F.lit(":summary")).otherwise(F.concat(F.lit(":item:"), F.col("i").cast("string")))
    return rows.select(F.concat(F.lit("ig:"), F.col("shortcode"), kind).alias("id"), "shortcode", "document")


# ---- chunking


def chunk_windows(docs: DataFrame, budget: int = BUDGET, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_index, text, token_count: windows of ``budget`` tokens that overlap by ``overlap``, all in the JVM."""
    stride = budget - overlap
    words = docs.select("doc_id", tx.tokenize(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - budget) / stride)).cast("long")
    rows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    part = F.slice("w", (F.col("chunk_index") * stride + 1).cast("int"), budget)
    return rows.select("doc_id", "chunk_index", F.array_join(part, " ").alias("text"), F.size(part).cast("long").alias("token_count"))
