r"""Chat formatting with a grammar round trip.

A conversation renders as a run of turns of the grammar

    turn    = "<|im_start|>" role NEWLINE content "<|im_end|>" NEWLINE
    content = any characters in which neither marker occurs

The rendered text is parsed again by a deterministic parser, and the turns it finds are
compared with the source. Where they differ, the turns whose content conflicts are
escaped one level deeper and the whole is rendered and parsed again, until both are identical.
Escaping level 1 puts a backslash after ``<|`` in every run that looks like a
marker, with one more backslash for each that is there already, so the
parser can take exactly one off: it is injective and needs no more than one level for
content; a role that isn't a plain word is written as ``other`` with the true role,
quoted, as the first line of its content, at level 2.

Conversations are grouped with one shuffle; a conversation is one row of the result, so all its turns
meet in one task, whatever is done.

Nulls and odd input: a null text is an empty turn and a null role is ``user``; turns
go by ``turn`` (nulls last), then role and text, so ties have a fixed order and repeated rows are
repeated turns; very long texts are rendered whole; a row with a null ``conv_id`` belongs to no other and is a conversation of its own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import session_of, table

START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id bigint, rendered string, n_turns int, escaped int, rounds int"
_LOOKALIKE = re.compile(r"<\|(\\*)(?=im_start\|>|im_end\|>)")
_DEEPER = re.compile(r"<\|\\(\\*)(?=im_start\|>|im_end\|>)")
_ROLE = re.compile(r"[a-z][a-z0-9_]*")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"\n', re.S)


Turns = list[tuple[str, str]]


class GrammarError(ValueError):
    pass


def escape(content: str) -> str:
    return _LOOKALIKE.sub(lambda m: "<|\\" + m[1], content)


def unescape(content: str) -> str:
    return _DEEPER.sub(lambda m: "<|" + m[1], content)


def _quote(role: str) -> str:
    return '"' + role.replace("\\", "\\\\").replace('"', '\\"') + '"\n'


def render(turns: list[tuple[str, str]], level: list[int]) -> str:
    """Level 0: as it is; 1: content escaped; 2: role quoted, too."""
    out = []
    for (role, text), k in zip(turns, level):
        if k == 2:
            role, text = "other", _quote(role) + text
        out.append(f"{START}{role}\n{escape(text) if k else text}{END}\n")
    return "".join(out)


def parse(rendered: str) -> Turns:
    """The turns, left to right without backtracking; GrammarError where the text is none
    of the grammar's."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        line = rendered.find("\n", at)
        role = rendered[at + len(START) : line] if line >= 0 else ""
        if not _ROLE.fullmatch(role):
            raise GrammarError(f"no role at {at}")
        end = rendered.find(END, line + 1)
        if end < 0 or not rendered.startswith("\n", end + len(END)):
            raise GrammarError(f"the turn at {at} has no end")
        text = rendered[line + 1 : end]
        if START in text:
            raise GrammarError(f"a turn begins within the turn at {at}")
        text = unescape(text)
        if role == "other":
            m = _QUOTED.match(text)
            if not m:
                raise GrammarError(f"no quoted role at {at}")
            role, text = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), text[m.end() :]
        turns.append((role, text))
        at = end + len(END) + 1
    return turns


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, int, int]:
    """(rendered, escaped turns, rounds); what it renders parses to ``turns``."""
    level = [0] * len(turns)
    for rounds in range(1, 5):
        out = render(turns, level)
        try:
            back = parse(out)
        except GrammarError:
            back = None
        if back == turns:
            return out, sum(k > 0 for k in level), rounds
        for i, t in enumerate(turns):  # a turn conflicts if it doesn't survive alone
            try:
                fine = parse(render([t], [level[i]])) == [t]
            except GrammarError:
                fine = False
            if not fine and level[i] < 2:
                level[i] += 1
    raise AssertionError("escaping did not converge")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row (conv_id, rendered, n_turns, escaped, rounds) for each conversation."""
    session_of(conversations)
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    grouped = grouped.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("t")))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = [format_conversation([(t["role"], t["text"]) for t in row]) for row in b.column(1).to_pylist()]
            n = pa.array([len(x) for x in b.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out]), n, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["conv_id", "rendered", "n_turns", "escaped", "rounds"])

    return grouped.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


# A turn is escaped where its content holds a marker or something that looks like an
# escaped one; a role that isn't a plain word, or is "other", is quoted.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, CASE WHEN NOT regexp_full_match(role, '[a-z][a-z0-9_]*') OR role = 'other' THEN 2
    WHEN regexp_matches(text, '<\|\\*(im_start\|>|im_end\|>)') THEN 1 ELSE 0 END AS level FROM c),
r AS (SELECT *, CASE WHEN level = 2 THEN '"' || replace(replace(role, '\', '\\'), '"', '\"') || '"' || chr(10) || text ELSE text END AS body FROM k),
e AS (SELECT conv_id, turn, role, text, level, '<|im_start|>' || CASE WHEN level = 2 THEN 'other' ELSE role END || chr(10)
    || CASE WHEN level > 0 THEN regexp_replace(body, '<\|(\\*)(im_start\|>|im_end\|>)', '<|\\\1\2', 'g') ELSE body END || '<|im_end|>' || chr(10) AS out FROM r)
SELECT conv_id, string_agg(out, '' ORDER BY turn NULLS LAST, role, text) AS rendered, count(*)::INTEGER AS n_turns,
    (count(*) FILTER (level > 0))::INTEGER AS escaped, (1 + max(level))::INTEGER AS rounds
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM e) GROUP BY conv_id, alone"""
