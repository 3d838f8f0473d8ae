"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A row's text is one line or many, up to a whole raw transcript. Each line is an observation of its
own: states are a role and whether the line begins a turn, and a line is seen through its speaker
marker, if any, and through line features (a question, a request, length). Viterbi finds the
likeliest roles and beginnings; where rows end is no evidence. The lines of a turn are joined again,
within a row: a turn that goes on in the next row goes on there with begins = false and no head, so
`rendered` in order of turn and line is the whole conversation.

A conversation of any length is handled: rows are cut into chunks by turn number, the lines of each chunk become one
max-plus matrix from entering to leaving state, and the matrices are combined FAN at a time up a tree;
the states at the borders are then fixed from the top down, and each chunk is decoded between its
own. No task ever holds more than a chunk or FAN matrices. Chunks of over CROWD rows, as of a conversation
whose turns have no or equal numbers, are cut into smaller ones by turn and by a hash of the texts.
A row is never cut, so a chunk is as large as the texts of its rows.

Defined results: null text: an empty line; null or negative turn: before turn 0; turns beyond LAST: as LAST;
null role: not used for decoding anyway; null conv_id: a conversation of its own; rows equal in conv_id,
turn and text: one observation, whose results are given once for each row; line breaks: \\n, \\r\\n or \\r,
rendered as \\n; a marker goes where its line begins a turn; other rows of one turn: in order of a hash of
their text; ties of paths: the least state; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, parts, written

ROLES = ("system", "user", "assistant")
CHUNK, FAN, CROWD, LAST = 64, 64, 512, 1 << 32  # turns of a chunk; matrices of a node; most rows of a chunk; last turn
COPIES = 1 << 16  # equal rows that are given their results at a time
#: What writers put before a turn, by role.
MARKERS = {
    "system": ("system", "instructions", "sys"),
    "user": ("user", "human", "question", "q", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model"),
}
MARKER = re.compile(
    r"^\s*(?:<\|(?P<a>[a-z]+)\|>|#{1,4}\s*(?P<b>[a-z]+)\s*:?|\[(?P<c>[a-z]+)\]|\*\*(?P<d>[a-z]+):?\*\*:?|(?P<e>[a-z]+)\s*:)[ \t]*", re.I
)
SPEAKER = {m: i for i, r in enumerate(ROLES) for m in MARKERS[r]}
STATES = len(ROLES) * 2  # role * 2 + (0: goes on, 1: begins)
BREAK = re.compile(r"\r\n|[\r\n]")
#: Probabilities that the next turn is of a role, given this turn's role.
NEXT = np.array([[0.05, 0.85, 0.10], [0.02, 0.08, 0.90], [0.02, 0.90, 0.08]])
FIRST = np.array([0.30, 0.60, 0.10])
#: Fixed value: the share of lines that go on with a turn, 8,566 of 13,578 in `conversations` at sf0.1.
GO_ON, LOW = 0.63, -1e18


def transitions() -> np.ndarray:
    """Log probabilities from state to state."""
    t = np.full((STATES, STATES), LOW)
    for r in range(3):
        for b in range(2):
            t[r * 2 + b, r * 2] = np.log(GO_ON)
            for s in range(3):
                t[r * 2 + b, s * 2 + 1] = np.log((1 - GO_ON) * NEXT[r, s])
    return t


def emissions(line: str) -> np.ndarray:
    """Log likelihood of a line under each state."""
    out = np.zeros(STATES)
    m = MARKER.match(line)
    speaker = SPEAKER.get(next(g for g in m.groups() if g).lower()) if m else None
    for r in range(3):
        if speaker is None:
            out[r * 2 : r * 2 + 2] += np.log([0.9, 0.3])
        else:
            out[r * 2 : r * 2 + 2] += np.log([0.01 / 3, 0.65 if r == speaker else 0.025])
    body = line[m.end() :] if m and speaker is not None else line
    if body.rstrip().endswith("?"):
        out += np.repeat(np.log([0.05, 0.35, 0.10]), 2)
    words = body.count(" ") + 1
    out += np.repeat(np.log([0.2, 0.5, 0.3] if words < 12 else [0.2, 0.4, 0.4] if words < 60 else [0.15, 0.25, 0.6]), 2)
    return out


def strip_marker(line: str) -> str:
    m = MARKER.match(line)
    return line[m.end() :] if m and next(g for g in m.groups() if g).lower() in SPEAKER else line


def best_path(steps: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States after each step, from enter to leave, that maximise the sum of the steps' matrices."""
    score, back = np.full(STATES, LOW), []
    score[enter] = 0
    for s in steps:
        x = score[:, None] + s
        back.append(x.argmax(0))
        score = np.maximum(x.max(0), LOW)
    path = [leave]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _by_group(df: DataFrame, n: int, keys: list[str], order: list[str], handle, ddl: str) -> DataFrame:
    """handle(rows of one group) for rows of equal keys; groups stream by in order."""
    schema = arrow_schema(df.sparkSession, ddl)

    def run(batches):
        held, at, out = [], object(), []
        for b in batches:
            for r in b.to_pylist():
                k = tuple(r[x] for x in keys)
                if k != at and held:
                    out += handle(held)
                    held = []
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                at = k
                held.append(r)
        if held:
            out += handle(held)
        yield pa.RecordBatch.from_pylist(out, schema)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _borders(chunks: DataFrame, n: int, conv: str) -> DataFrame:
    """conv, idx, enter, leave of each chunk from its matrix (conv, idx, m): up the tree and down again."""
    if (chunks.agg(F.max("idx")).first()[0] or 0) == 0:

        def top(rows):
            m = np.array(rows[0]["m"]).reshape(STATES + 1, STATES)[STATES]
            return [{"conv": rows[0]["conv"], "idx": 0, "enter": STATES, "leave": int(m.argmax())}]

        return _by_group(chunks, n, ["conv", "idx"], [], top, f"conv {conv}, idx long, enter int, leave int")
    placed = chunks.withColumn("up", F.floor(F.col("idx") / FAN))

    def product(rows):
        m = np.array(rows[0]["m"]).reshape(STATES + 1, STATES)
        for r in rows[1:]:
            m = np.maximum((m[:, :, None] + np.array(r["m"]).reshape(STATES + 1, STATES)[None, :STATES]).max(1), LOW)
        return [{"conv": rows[0]["conv"], "idx": rows[0]["up"], "m": m.ravel().tolist()}]

    ups = written(_by_group(placed, n, ["conv", "up"], ["idx"], product, f"conv {conv}, idx long, m array<double>"), "tree")
    above = _borders(ups, n, conv).select(F.col("conv").alias("c"), F.col("idx").alias("u"), "enter", "leave")
    joined = placed.join(above, placed["conv"].eqNullSafe(above["c"]) & (placed["up"] == above["u"])).drop("c", "u")

    def down(rows):
        steps = [np.array(r["m"]).reshape(STATES + 1, STATES) for r in rows]
        enter = rows[0]["enter"]
        score, back = steps[0][enter], []
        for s in steps[1:]:
            x = score[:, None] + s[:STATES]
            back.append(x.argmax(0))
            score = x.max(0)
        path = [rows[0]["leave"]]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return [{"conv": r["conv"], "idx": r["idx"], "enter": e, "leave": v} for r, e, v in zip(rows, [enter, *path[:-1]], path, strict=True)]

    return _by_group(joined, n, ["conv", "up"], ["idx"], down, f"conv {conv}, idx long, enter int, leave int")


def _matrix_with_start(seen: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The chunk's matrix with a row more: from the start of a conversation."""
    start = np.full(STATES, LOW)
    start[1::2] = np.log(FIRST)
    m = np.vstack([np.where(np.eye(STATES) > 0, 0.0, LOW), np.full(STATES, LOW)])
    for i, e in enumerate(seen):
        nxt = (m[:, :, None] + trans[None]).max(1)
        if i == 0:
            nxt[STATES] = start
        m = np.maximum(nxt + e, LOW)
    return m


def _uncrowded(rows: DataFrame) -> DataFrame:
    """rows with idx such that no chunk has many over CROWD rows: numbers in the same order, with room for the parts of chunks."""
    crowds = rows.groupBy("conv", "idx").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWD)
    crowds = crowds.select(F.col("conv").alias("c"), F.col("idx").alias("i"), F.ceil(F.log2(F.col("rows") / CROWD) + 1).cast("int").alias("s"))
    most = crowds.agg(F.max("s")).first()[0]
    if most is None:
        return rows
    room = CHUNK.bit_length() + most
    # by turn, then by the s upper bits of the hash
    part = F.expr(f"shiftleft(place % {CHUNK}, s) + shiftrightunsigned(h ^ shiftleft(1L, 63), 64 - s)")
    cut = rows.join(crowds, rows["conv"].eqNullSafe(crowds["c"]) & (rows["idx"] == crowds["i"]), "left")
    return written(cut.withColumn("idx", F.shiftleft("idx", room) + F.coalesce(part, F.lit(0))).drop("c", "i", "s"), "lines")


def recover_roles(lines: DataFrame) -> DataFrame:
    """conv_id, turn, line, role, begins, text, rendered for rows (conv_id, turn, text) of transcripts.

    A row gives one result for each turn that its lines hold; line is the number of the result's first line in the row.
    """
    spark = lines.sparkSession
    bound_batches(spark)
    n, conv = parts(lines), lines.schema["conv_id"].dataType.simpleString()
    rows = lines.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.least(F.greatest(F.coalesce("turn", F.lit(-1)), F.lit(-1)), F.lit(LAST)) + 1
    rows = rows.groupBy("conv", "turn", "text").agg(F.count("*").alias("n")).withColumn("place", place)
    rows = written(rows.withColumns({"idx": F.floor(F.col("place") / CHUNK), "h": F.xxhash64("text")}), "lines")
    rows = _uncrowded(rows)
    trans = transitions()
    # chunks are numbered by turn, so a gap leaves numbers out; the tree takes what there is, in order

    def matrix(group):
        seen = np.array([emissions(x) for r in group for x in BREAK.split(r["text"])])
        return [{"conv": group[0]["conv"], "idx": group[0]["idx"], "m": _matrix_with_start(seen, trans).ravel().tolist()}]

    order = ["place", "h", "turn", "text"]
    chunks = written(_by_group(rows, n, ["conv", "idx"], order, matrix, f"conv {conv}, idx long, m array<double>"), "chunks")
    borders = written(_borders(chunks, n, conv), "borders").select(F.col("conv").alias("c"), F.col("idx").alias("i"), "enter", "leave")
    joined = rows.join(borders, rows["conv"].eqNullSafe(borders["c"]) & (rows["idx"] == borders["i"])).drop("c", "i")

    def decode(group):
        lines = [BREAK.split(r["text"]) for r in group]
        seen = [emissions(x) for row in lines for x in row]
        enter = group[0]["enter"]
        steps = [trans + e for e in seen]
        if enter == STATES:
            start = np.full(STATES, LOW)
            start[1::2] = np.log(FIRST)
            steps[0] = np.tile(start + seen[0], (STATES, 1))
            enter = 0
        path, out = iter(best_path(steps, enter, group[0]["leave"])), []
        for r, row in zip(group, lines, strict=True):
            found = []
            for k, line in enumerate(row):
                state = next(path)
                if state % 2 or not k:
                    found.append((k, state, []))
                found[-1][2].append(strip_marker(line) if state % 2 else line)
            for k, state, body in found:
                role, begins, body = ROLES[state // 2], bool(state % 2), "\n".join(body)
                head = f"<|{role}|>\n" if begins else ""
                out.append({"conv_id": r["conv"], "turn": r["turn"], "line": k, "role": role, "begins": begins, "text": body, "rendered": f"{head}{body}\n", "n": r["n"]})
        return out

    found = _by_group(joined, n, ["conv", "idx"], order, decode, f"conv_id {conv}, turn long, line long, role string, begins boolean, text string, rendered string, n long")
    blocks = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    each = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES))))
    return each.drop("n", "block", "copy")


def as_transcript(turns: DataFrame) -> DataFrame:
    """Conversations as people paste them: each writes its own kind of marker, and one turn in eight has none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.coalesce(F.col("role"), F.lit("user"))
    mark = (
        F.when(style == 0, F.concat(F.initcap(name), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("["), name, F.lit("] ")))
        .when(style == 2, F.concat(F.lit("### "), F.initcap(name), F.lit(": ")))
        .otherwise(F.when(name == "user", "Human: ").when(name == "assistant", "AI: ").otherwise("System: "))
    )
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    text = F.coalesce(F.col("text"), F.lit(""))
    return turns.select("conv_id", "turn", F.when(bare, text).otherwise(F.concat(mark, text)).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = recover_roles(as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "turn", "line", "role", "begins", F.length("text").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
