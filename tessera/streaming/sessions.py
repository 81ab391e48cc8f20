"""Session logs as a stream: a session's lines are held until it has been quiet, then its page comes out once.

Lines may come late, in any order and more than once; a line's place tells it apart and puts it in order. State is one session's
lines, as its page is one row. A session closes when event time has gone ``gap`` past its last line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.exports import ASSISTANT, HUMAN, LABELS

#: What a line says, as of :func:`exports.read_session_lines`, with its place in two numbers and its time.
LINE = "path string, block long, n long, at timestamp, type string, ts string, cwd string, session_id string, custom_title string, ai_title string, text string, tools array<string>"
PAGE = "path string, session_id string, title string, n_messages long, n_tools long, markdown string"
#: Bytes of files that a batch takes: each batch opens and commits the state of every partition, so many small files are few batches.
AT_ONCE = 256 << 20
_FIELDS = ["type", "ts", "cwd", "session_id", "custom_title", "ai_title", "text", "tools"]


def _tools(names: list[str]) -> str:
    """Names in order, neighbours that are equal counted."""
    runs: list[list] = []
    for name in names:
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1])
    return f"_[tools: {' -> '.join(x if k == 1 else f'{x} x{k}' for x, k in runs)}]_"


def page_of(path: str, lines: Iterable[dict]) -> tuple:
    """The page of a session's lines in order: what :func:`exports.read_sessions` makes of its log."""
    named, title, opening, ts, sid, cwds, n, n_tools, pending, out = None, None, "", "", None, [], 0, 0, [], []
    for x in lines:
        kind, text, tools = x["type"], x["text"] or "", x["tools"] or []
        if kind == "custom-title" and x["custom_title"]:
            named = x["custom_title"]
        if kind == "ai-title" and x["ai_title"]:
            title = x["ai_title"]
        ts, sid = ts or x["ts"] or "", sid or x["session_id"]
        if x["cwd"] and x["cwd"] not in cwds:
            cwds.append(x["cwd"])
        if kind == "user" and text:
            opening = opening or re.sub(r"\s+", " ", text).strip()[:60]
            tools = []
        elif kind != "assistant" or not (text or tools):
            continue
        n, n_tools = n + 1, n_tools + len(tools)
        if not text:
            pending += tools
            continue
        out += [_tools(pending)] if pending else []
        out += [f"{HUMAN if kind == 'user' else ASSISTANT}\n\n{text}"] + ([_tools(tools)] if tools else [])
        pending = []
    out += [_tools(pending)] if pending else []
    title, sid = named or title or opening or "chat", sid or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    facts = [f"{LABELS[k]}{v}" for k, v in (("date", ts[:10]), ("session", sid), ("cwd", ", ".join(cwds))) if v]
    markdown = "\n\n".join(x for x in [f"# {title}", "  \n".join(facts), *out] if x).strip() + "\n"
    return path, sid, title, n, n_tools, re.sub("\n{4,}", "\n\n\n", markdown)


def pages(lines: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The page of every session of a stream of ``LINE`` rows, once it has closed. Lines more than ``late`` behind are dropped by the
    watermark. (A table has no timers; :func:`exports.read_sessions` reads those.)"""
    quiet = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": 0, "lines": {}}
        if state.hasTimedOut:
            order = sorted(held["lines"], key=lambda p: tuple(map(int, p.split(":"))))
            state.remove()
            yield pd.DataFrame([page_of(key[0], (held["lines"][p] for p in order))], columns=[c.split()[0] for c in PAGE.split(", ")])
            return
        for b in batches:
            for r in b.to_dict("records"):
                said = {f: (None if r[f] is None or r[f] is pd.NaT else list(r[f]) if f == "tools" else r[f]) for f in _FIELDS}
                held["lines"][f"{r['block']}:{r['n']}"] = said
                held["last"] = max(held["last"], int(r["at"].timestamp() * 1000))
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(held["last"] + quiet, state.getCurrentWatermarkMs() + 1))

    return lines.withWatermark("at", late).groupBy("path").applyInPandasWithState(step, PAGE, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, lines: str, out: str, checkpoint: str, at_once: int = AT_ONCE) -> None:
    """Stream the files of ``LINE`` rows in ``lines`` that are new since the last call; pages of sessions that close go to ``out``."""
    read = spark.readStream.schema(LINE).option("maxBytesPerTrigger", str(at_once)).parquet(lines)
    pages(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
