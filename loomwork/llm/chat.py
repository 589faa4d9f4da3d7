"""Operator 10, chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A line shows its speaker marker, if any, its length, how it ends and whether a blank line stands before it.
States are (role, first or later line of a turn). Counts over labelled conversations give the model;
Viterbi gives the best path of each conversation.

A conversation may be longer than any one task should hold. Lines are range-partitioned in order and
checkpointed; a partition sums up its first and its last conversation as a max-plus matrix over states. The
driver sees two small matrices a partition and settles the states at partition borders; then every
partition decodes its own lines with those states fixed. The path is the one that a single pass over
the whole conversation finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.shipping import ship

from .common import checkpoint_dir, parts, read, written

ROLES = ("system", "user", "assistant")
#: Speaker markers that open a line, by role; matched without regard to case.
MARKERS = {
    "system": ("System:", "### System:", "[system]", "<system>"),
    "user": ("User:", "### Human:", "[user]", "Q:"),
    "assistant": ("Assistant:", "### Assistant:", "[assistant]", "A:"),
}
#: Conversations that the model is fitted on at most.
SAMPLE = 2000
STATES = [(r, first) for r in range(len(ROLES)) for first in (True, False)]
S = len(STATES)
FEATURES = {"mark": 4, "size": 6, "end": 4, "gap": 2}


def transcript(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Lines (conv, turn, line, text, role, first) of a plain transcript of role-labelled turns: a conversation has one
    style of markers, three turns in ten have none, and four in ten have no blank line before them."""
    style = F.pmod(F.xxhash64(F.col(conv), F.lit("style")), F.lit(4))
    draw = F.pmod(F.xxhash64(F.col(conv), F.col(turn)), F.lit(100))
    mark = F.lit("")
    for r, marks in MARKERS.items():
        mark = F.when(F.col(role) == r, F.element_at(F.array(*map(F.lit, marks)), (style + 1).cast("int"))).otherwise(mark)
    opened = F.when((draw >= 30) & (mark != ""), F.concat(mark, F.lit(" "), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))
    lines = F.split(opened, "\n", -1)
    body = F.when(F.pmod(draw, F.lit(10)) >= 4, F.concat(F.array(F.lit("")), lines)).otherwise(lines)
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.xxhash64(text).alias("tie"), F.col(role).alias("role"), F.posexplode(body).alias("line", "text"), (F.size(body) - F.size(lines)).alias("lead"))
    return rows.withColumn("first", F.col("line") == F.col("lead"))


def _marked(text: Column) -> Column:
    """Number of the role whose marker opens the line; 3 if none does."""
    low = F.lower(F.ltrim(text))
    out = F.lit(3)
    for i, r in enumerate(ROLES):
        out = F.when(reduce_or([F.startswith(low, F.lit(m.lower())) for m in MARKERS[r]]), i).otherwise(out)
    return out


def reduce_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def observed(lines: DataFrame) -> DataFrame:
    """lines with one number for what a line shows apart from blank lines before it, and whether it is blank."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 90, 2).when(n < 160, 3).when(n < 260, 4).otherwise(5)
    end = F.when(F.endswith(t, F.lit("?")), 0).when(F.endswith(t, F.lit(".")), 1).when(n == 0, 3).otherwise(2)
    return lines.withColumn("mark", _marked(t)).withColumn("size", size).withColumn("end", end).withColumn("blank", F.trim(t) == "")


class Model:
    """Log-probabilities; a blank line belongs to the turn that it stands in or closes."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: dict[str, np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def scores(self, batch: dict[str, list], gap: list[bool]) -> np.ndarray:
        out = self.emit["gap"][:, np.array(gap, dtype=int)]
        for f in ("mark", "size", "end"):
            out = out + self.emit[f][:, np.array(batch[f], dtype=int)]
        return out.T


def fit(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts with add-one smoothing over the transcripts of at most SAMPLE conversations, taken in the order of a hash of their ids."""
    some = df.select(F.col(conv)).distinct().orderBy(F.xxhash64(conv), conv).limit(SAMPLE)
    lines = observed(transcript(df.join(F.broadcast(some), conv, "left_semi"), conv, turn, role, text).where(F.col("role").isin(*ROLES)))
    w = "PARTITION BY conv ORDER BY turn, tie, line"
    state = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") * 2 - 2 + F.when(F.col("first"), 0).otherwise(1)
    # a blank line before a turn's first line counts as the end of the turn before it
    lines = lines.where("not blank").withColumn("state", state).withColumn("gap", (F.col("lead") > 0) & F.col("first"))
    lines = lines.withColumn("last", F.expr(f"lag(state) over ({w})"))
    counted = lines.groupBy("state", "last", "mark", "size", "end", "gap").count().collect()  # a bounded number of kinds
    start, move = np.ones(S), np.ones((S, S))
    emit = {f: np.ones((S, n)) for f, n in FEATURES.items()}
    for r in counted:
        if r.last is None:
            start[r.state] += r["count"]
        else:
            move[r.last, r.state] += r["count"]
        for f in FEATURES:
            emit[f][r.state, int(r[f])] += r["count"]
    for a, (role_a, _) in enumerate(STATES):
        for b, (role_b, first) in enumerate(STATES):
            if not first and role_a != role_b:
                move[a, b] = 0  # a later line has the role of its turn
    start[[i for i, (_, first) in enumerate(STATES) if not first]] = 0
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), {f: np.log(e / e.sum(axis=1, keepdims=True)) for f, e in emit.items()})


def _runs(batches: Iterator[pa.RecordBatch], before: tuple | None) -> Iterator[tuple[object, dict[str, list]]]:
    """Conversations of a partition, in order, held one stretch at a time. before: conversation and blankness of the line before."""
    names = ("turn", "line", "text", "mark", "size", "end", "blank")
    rows = ((c, *r) for b in batches for c, *r in zip(*(b.column(n).to_pylist() for n in ("conv", *names)), strict=True))
    first = True
    for conv, own in groupby(rows, key=lambda r: r[0]):
        run = dict(zip(names, zip(*(r[1:] for r in own), strict=True), strict=True))
        run["gap"] = (bool(first and before and before[1] and before[0] == _name(conv)), *run["blank"][:-1])
        yield conv, run
        first = False


def _name(conv: object) -> str | None:
    """A conversation's id as Arrow casts it to a string."""
    return pa.array([conv]).cast(pa.string())[0].as_py()


def _seen(run: dict) -> tuple[list[int], dict[str, list]]:
    at = [i for i, b in enumerate(run["blank"]) if not b]
    return at, {f: [run[f][i] for i in at] for f in FEATURES}


def _matrix(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score from each state before the stretch to each state at its end."""
    m = np.where(np.eye(S, dtype=bool), 0.0, -np.inf)
    for e in scores:
        m = (m[:, :, None] + move[None]).max(axis=1) + e
    return m


def _path(scores: np.ndarray, model: Model, entry: int, leave: int) -> list[int]:
    """Viterbi over a stretch; entry and leave are fixed states, or -1 for a conversation's own begin and end."""
    if not len(scores):
        return []
    a = (model.start if entry < 0 else model.move[entry]) + scores[0]
    back = []
    for e in scores[1:]:
        step = a[:, None] + model.move
        back.append(step.argmax(axis=0))
        a = step.max(axis=0) + e
    state = int(a.argmax()) if leave < 0 else leave
    out = [state]
    for b in reversed(back):
        out.append(state := int(b[state]))
    return out[::-1]


def _borders(ends: list, model: Model) -> dict[int, tuple[int, int]]:
    """State before and state at the end of each partition's first and last stretch, where a conversation crosses a border.

    ends: (partition, is first, is last, conversation, matrix, vector from the begin)."""
    fixed: dict[int, list[int]] = {}
    chain: list = []

    def settle() -> None:
        if len(chain) > 1:
            a = [np.array(chain[0][5])]
            for c in chain[1:]:
                m = np.array(c[4]).reshape(S, S)
                a.append((a[-1][:, None] + m).max(axis=0))
            state = int(a[-1].argmax())
            for i in range(len(chain) - 1, 0, -1):
                fixed.setdefault(chain[i][0], [-1, -1])
                if i < len(chain) - 1:
                    fixed[chain[i][0]][1] = state
                m = np.array(chain[i][4]).reshape(S, S)
                state = int((a[i - 1] + m[:, state]).argmax())
                fixed[chain[i][0]][0] = state
            fixed.setdefault(chain[0][0], [-1, -1])[1] = state
        chain.clear()

    for part, first, last, conv, matrix, vector in sorted(ends, key=lambda e: (e[0], not e[1])):
        if chain and not (first and chain[-1][3] == conv and chain[-1][2]):
            settle()
        chain.append((part, first, last, conv, matrix, vector))
    settle()
    return {p: tuple(v) for p, v in fixed.items()}


def parse_roles(lines: DataFrame, model: Model) -> DataFrame:
    """lines (conv, turn, line, text: any order columns turn, line) -> conv, text without its marker, role, first, at, turn number.

    Lines stand in the order (conv, turn, tie if there is one, line); repeated rows stay, in one order. A null text is a blank
    line. Blank lines take the role of what comes before them (in a conversation's begin, of its first line).
    An empty table gives no rows."""
    ship(lines.sparkSession)
    spark = lines.sparkSession
    checkpoint_dir(spark)
    order = [c for c in ("conv", "turn", "tie", "line") if c in lines.columns]
    plain = observed(lines.select(*order, "text"))
    ordered = plain.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    kept = ordered.select("conv", "turn", F.col("line").cast("long").alias("line"), "text", "mark", "size", "end", "blank").checkpoint()

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            last = batch if len(batch) else last
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), last.column("conv").cast(pa.string())[-1:], last.column("blank")[-1:]], ["part", "conv", "blank"])

    before: dict[int, tuple] = {}
    last = None
    for r in sorted(kept.mapInArrow(tail, "part int, conv string, blank boolean").collect()):  # a row a partition
        before[r.part], last = last, (r.conv, r.blank)
    lead = spark.sparkContext.broadcast(before)
    shared = spark.sparkContext.broadcast(model)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, held = TaskContext.get().partitionId(), shared.value, None
        first, ends = True, []

        def end(conv: object, run: dict, is_first: bool, is_last: bool) -> tuple:
            _, seen = _seen(run)
            scores = own.scores(seen, seen["gap"]) if seen["mark"] else np.zeros((0, S))
            vector = own.start + scores[0] if len(scores) else own.start
            for e in scores[1:]:
                vector = (vector[:, None] + own.move).max(axis=0) + e
            return part, is_first, is_last, _name(conv), _matrix(scores, own.move).ravel().tolist(), vector.tolist()

        for conv, run in _runs(batches, lead.value.get(part)):
            if held is not None and first:
                ends.append(end(*held, True, False))
                first = False
            held = conv, run
        if held is not None:
            ends.append(end(*held, first, True))
        kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], k) for i, k in enumerate(kinds)], ["part", "first", "last", "conv", "m", "v"])

    ends = [tuple(r) for r in kept.mapInArrow(sum_up, "part int, first boolean, last boolean, conv string, m array<double>, v array<double>").collect()]  # two rows a partition
    fixed = spark.sparkContext.broadcast(_borders(ends, model))
    kind = lines.schema["conv"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), shared.value
        entry, leave = fixed.value.get(part, (-1, -1))
        ahead, at, first = None, 0, True
        source = _runs(batches, lead.value.get(part))
        ahead = next(source, None)
        while ahead is not None:
            (conv, run), ahead = ahead, next(source, None)
            where, seen = _seen(run)
            scores = own.scores(seen, seen["gap"]) if where else np.zeros((0, S))
            path = _path(scores, own, entry if first else -1, leave if ahead is None else -1)
            n = len(run["text"])
            state = np.full(n, -1)
            state[where] = path
            known = np.maximum.accumulate(np.where(state >= 0, np.arange(n), -1))
            before = entry if first and entry >= 0 else (path[0] if path else 2)
            role = np.where(known >= 0, state[np.maximum(known, 0)], before) // 2
            starts = (state >= 0) & (state % 2 == 0)
            turn = np.cumsum(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * n, kind_of), pa.array(np.full(n, part), pa.int32()), pa.array([first] * n, pa.bool_()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(role, pa.int32()), pa.array(starts, pa.bool_()), pa.array(turn, pa.int64()), pa.array(run["turn"]).cast(turn_of), pa.array(run["line"], pa.int64()), pa.array(run["text"], pa.string()), pa.array(run["mark"], pa.int32())],
                ["conv", "part", "first_run", "at", "role_no", "first", "own_turn", "turn", "line", "text", "mark"],
            )
            at += n
            first = False

    kind_of, turn_of = to_arrow_type(lines.schema["conv"].dataType), to_arrow_type(lines.schema["turn"].dataType)
    done = written(kept.mapInArrow(decode, f"conv {kind}, part int, first_run boolean, at long, role_no int, first boolean, own_turn long, turn {lines.schema['turn'].dataType.simpleString()}, line long, text string, mark int"), "roles")
    # turns of one conversation are numbered on over partitions: one number for each partition that goes on with one
    begun, last = {}, {}
    for r in done.groupBy("part", "conv", "first_run").agg(F.max("own_turn").alias("n"), F.max("at").alias("e")).join(done.groupBy("part").agg(F.max("at").alias("e")), ["part", "e"]).select("part", "conv", "first_run", "n").orderBy("part").collect():
        last[r.part] = r
    firsts = {r.part: r for r in done.where("first_run").groupBy("part", "conv").agg(F.max("own_turn").alias("n")).collect()}
    total, conv_before = 0, None
    for part in sorted(last):
        goes_on = conv_before is not None and (firsts[part].conv,) == conv_before
        begun[part] = total if goes_on else 0
        total = last[part].n + (begun[part] if last[part].first_run else 0)
        conv_before = (last[part].conv,)
    bases = spark.createDataFrame(list(begun.items()) or [(0, 0)], "part int, base long")
    plain_text = F.when(F.col("first") & (F.col("mark") < 3), F.regexp_replace(F.ltrim(F.coalesce("text", F.lit(""))), _marker_pattern(), "")).otherwise(F.coalesce("text", F.lit("")))
    number = F.greatest(F.lit(0), F.col("own_turn") + F.when(F.col("first_run"), F.col("base")).otherwise(0) - 1)
    return done.join(F.broadcast(bases), "part").select("conv", number.alias("chat_turn"), F.element_at(F.array(*map(F.lit, ROLES)), F.col("role_no") + 1).alias("role"), "first", plain_text.alias("text"), "part", "at", "turn", "line")


def _marker_pattern() -> str:
    return "(?i)^(?:" + "|".join(re.escape(m) for marks in MARKERS.values() for m in marks) + r")\s*"


def turns(parsed: DataFrame) -> DataFrame:
    """conv, chat_turn, role, text (without blank lines at either end) and rendered, a row for each turn."""
    line = F.struct("part", "at", "text", "role")
    grouped = parsed.groupBy("conv", "chat_turn").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = F.regexp_replace(F.array_join("l.text", "\n"), r"^\n+|\n+$", "")
    out = grouped.select("conv", "chat_turn", F.element_at("l.role", 1).alias("role"), text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    parsed = parse_roles(transcript(table).drop("role", "first", "lead"), fit(table))
    return turns(parsed).withColumnRenamed("conv", "conv_id")
