"""Chat formatting: transcripts parsed by a hidden Markov model.

A transcript is a sequence of lines of unknown role: the lines of a conversation's
messages. Each line shows features (a speaker marker, whether it stands first in
its message or transcript, its length and end). The hidden states are the roles,
each as the first line of a turn and as one that goes on; they emit the features,
and Viterbi decoding recovers them before turns are rendered canonically. So a
message that quotes several speakers falls into several turns. The model's
probabilities are counts over all labelled lines, of fixed size whatever the
corpus.

Viterbi's steps are products of small (max, +) matrices, and these are
associative: a transcript is cut into blocks of bounded length, each block is
reduced to one matrix, blocks of blocks in the same way where there are many; the
blocks' entry and end states follow from the matrices alone, and each block is then
decoded on its own. So no conversation, however long, is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise

ROLES = ("system", "user", "assistant")
#: Lines of one block, and blocks of one block of blocks; blocks handed to Python together, on average; rows of one range of messages.
BLOCK, SPAN, TOGETHER, RANGE = 512, 4096, 1024, 1 << 16
NEVER = -1e15
#: States: each role as a turn's first line, then each as a line that goes on; one more stands before the first line.
STATES = 2 * len(ROLES)
# Speaker markers by role, as they stand before a colon at a line's start or between marks of a chat template.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
# The canonical rendering of a turn.
RENDER = ("<|im_start|>", "\n", "<|im_end|>\n")
_ROLE = "(" + "|".join(sorted((m for ms in MARKERS.values() for m in ms), key=len, reverse=True)) + ")"
_MARKER = rf"(?i)^\s*(?:<\|im_start\|>\s*{_ROLE}\s*$|<\|{_ROLE}\|>|\[{_ROLE}\]:?|(?:#+\s*|\*\*)?{_ROLE}\s*(?:\*\*)?\s*[:>](?:\*\*)?)\s*"
_END_MARK = r"<\|im_end\|>\s*$"
N_MARKER, N_PLACE, N_LENGTH, N_MARK = len(ROLES) + 1, 3, 5, 3
N_FEATURES = N_MARKER * N_PLACE * N_LENGTH * N_MARK


def marker_role(line: Column) -> Column:
    """The role a line's speaker marker names, as 1 + its place in ROLES; 0 without one."""
    word = F.lower(F.concat(*(F.regexp_extract(line, _MARKER, i) for i in range(1, 5))))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(word.isin(*MARKERS[role]), i + 1).otherwise(out)
    return out


def without_marker(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, _MARKER, ""), _END_MARK, "")


def feature(line: Column, place: Column, number: Column) -> Column:
    """A line's features as one symbol: marker, place (first of its transcript, of its message, or not), length, and whether it is empty, asks or neither."""
    body = F.length(without_marker(line))
    length = F.when(body == 0, 0).when(body < 60, 1).when(body < 200, 2).when(body < 600, 3).otherwise(4)
    at = F.when(place == 0, 2).when(number == 0, 1).otherwise(0)
    mark = F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"[.!]\s*$"), 2).otherwise(0)
    return ((marker_role(line) * N_PLACE + at) * N_LENGTH + length) * N_MARK + mark


def _lines(conversations: DataFrame) -> DataFrame:
    """Every line of every message: key (of its transcript), conv_id, turn, label, message, number (in its message), line, place (in its transcript), symbol, block.

    Messages are dealt out by ranges of their order, so that neither a long
    conversation nor many messages of one turn are gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    message = F.monotonically_increasing_id().alias("message")
    rows = materialise(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("label"), F.split(text, r"\r\n|\r|\n", -1).alias("lines"), F.xxhash64(text).alias("content"), message), "messages")
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.col("message")).otherwise(-1)).withColumn("n", F.size("lines").cast("long"))
    keys, order = ("conv_id", "alone"), (F.col("turn").asc_nulls_first(), F.col("content"), F.col("label"), F.col("message"))
    ranges = max(1, -(-rows.count() // RANGE))
    rows = rows.repartitionByRange(ranges, F.col("conv_id").asc_nulls_first(), "alone", *order).withColumn("range", F.spark_partition_id())
    rows = materialise(rows.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))), "placed")
    before = F.sum("sum").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy(*keys, "range").agg(F.sum("n").alias("sum"), F.min("message").alias("least"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("alone").alias("o"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before"), F.first("least").over(Window.partitionBy(*keys).orderBy("range")).alias("key"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("alone") == F.col("o")) & (F.col("range") == F.col("r"))
    rows = rows.join(sums, same).select("key", "conv_id", "turn", "label", "message", (F.col("before") + F.col("upto") - F.col("n")).alias("start"), F.posexplode("lines").alias("number", "line"))
    rows = rows.withColumn("place", F.col("start") + F.col("number")).drop("start")
    return rows.withColumn("symbol", feature(F.col("line"), F.col("place"), F.col("number"))).withColumn("block", F.floor(F.col("place") / BLOCK))


def fit(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the step and emission probabilities, from counts over all lines whose label is a role. The last state stands before the first line."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("label")) - 1
    state = (role + F.when(F.col("number") == 0, 0).otherwise(len(ROLES))).alias("state")
    labelled = lines.where(F.col("label").isin(*ROLES)).select("key", "place", "block", "symbol", state)
    emissions = {(r.state, r.symbol): r["count"] for r in labelled.groupBy("state", "symbol").count().collect()}
    starts = {r.state: r["count"] for r in labelled.where("place = 0").groupBy("state").count().collect()}
    step = labelled.withColumn("next", F.lead("state").over(Window.partitionBy("key", "block").orderBy("place"))).select("state", "next")
    ends = labelled.groupBy("key", "block").agg(F.min_by("state", "place").alias("first"), F.max_by("state", "place").alias("state"))
    border = ends.withColumn("next", F.lead("first").over(Window.partitionBy("key").orderBy("block"))).select("state", "next")
    step = step.union(border).where("next is not null")
    steps = {(r.state, r.next): r["count"] for r in step.groupBy("state", "next").count().collect()}
    r = len(ROLES)
    a = np.full((STATES + 1, STATES + 1), NEVER)
    for i in range(STATES + 1):
        may = [j for j in range(STATES) if j < r or (i < STATES and i % r == j - r)]  # a line goes on with the role before it
        row = np.array([(starts.get(j, 0) if i == STATES else steps.get((i, j), 0)) + 1.0 for j in may])
        a[i, may] = np.log(row / row.sum())
    b = np.full((STATES, N_FEATURES), 0.05)
    for (i, s), c in emissions.items():
        b[i, s] += c
    share = b.reshape(STATES, N_MARKER, -1) / b.sum(1)[:, None, None]
    for i in range(STATES):  # markers weigh beyond what is seen: mostly their own role uses them, and to begin a turn
        for m in range(r):
            share[i, m + 1] = share[i, m + 1] * 0.02 + (0.2 if i == m else 0.002 if i < r else 0.001) / share.shape[2]
    share /= share.sum((1, 2), keepdims=True)
    return a, np.concatenate([np.log(share.reshape(STATES, -1)), np.full((1, N_FEATURES), NEVER)])


def _padded(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols, longest first, and the order of the rows."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    for row, i in enumerate(order.tolist()):
        out[row, : sizes[i]] = symbols[starts[i] : starts[i] + sizes[i]]
    return out, order


def block_matrices(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """m[block, i, j]: the best log probability of a block's lines given the state i before it and ending in j; all blocks go on together."""
    rows, order = _padded(symbols, starts, sizes)
    m = a[None, :, :] + b[:, rows[:, 0]].T[:, None, :]
    for t in range(1, rows.shape[1]):
        k = int((sizes[order] > t).sum())
        m[:k] = (m[:k, :, :, None] + a[None, None, :, :]).max(2) + b[:, rows[:k, t]].T[:, None, :]
    out = np.empty_like(m)
    out[order] = m
    return out


def decode_blocks(enter: np.ndarray, leave: np.ndarray, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best states of each block's lines, given the state before it and that of its last line."""
    rows, order = _padded(symbols, starts, sizes)
    own = sizes[order]
    score = a[enter[order]] + b[:, rows[:, 0]].T
    back = np.zeros((*rows.shape, a.shape[0]), np.int8)
    for t in range(1, rows.shape[1]):
        k = int((own > t).sum())
        step = score[:k, :, None] + a[None]
        back[:k, t] = step.argmax(1)
        score[:k] = step.max(1) + b[:, rows[:k, t]].T
    states = np.zeros(rows.shape, np.int64)
    state = leave[order].copy()
    each = np.arange(len(own))
    for t in range(rows.shape[1] - 1, -1, -1):
        k = int((own > t).sum())
        states[:k, t] = state[:k]
        state[:k] = back[each[:k], t, state[:k]]
    out = np.empty(len(symbols), np.int64)
    for row, i in enumerate(order.tolist()):
        out[starts[i] : starts[i] + sizes[i]] = states[row, : sizes[i]]
    return out


def chain(ms: np.ndarray, enter: int, leave: int | None) -> tuple[list[int], list[int]]:
    """The states before and at the end of each of consecutive blocks, given that before the first and, if known, at the end of the last."""
    scores = [np.where(np.arange(ms.shape[1]) == enter, 0.0, NEVER)]
    for m in ms:
        scores.append((scores[-1][:, None] + m).max(0))
    ends = [int(scores[-1].argmax()) if leave is None else leave]
    for m, score in zip(ms[::-1], scores[-2::-1], strict=True):
        ends.append(int((score + m[:, ends[-1]]).argmax()))
    ends[-1] = enter
    return ends[:0:-1], ends[-2::-1]


def _runs(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal keys of a sorted frame."""
    if not len(pdf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.any([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys], 0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.diff(np.append(starts, len(pdf)))


def _lot(lots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(lots)).alias("lot")


_ENDS = "key long, block long, enter int, leave int"


def _ends(matrices: DataFrame) -> DataFrame:
    """(key, block, enter, leave) of (key, block, m): where a key has more than SPAN blocks, by blocks of blocks first."""
    n = STATES + 1
    stack = lambda pdf: np.stack(pdf["m"].to_numpy()).reshape(-1, n, n)

    def linked(keys: list[str], given: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([*keys, "block"])
            enters, leaves = [], []
            for x, size in zip(*_runs(pdf, keys), strict=True):
                part = pdf.iloc[x : x + size]
                enter, leave = chain(stack(part), int(part["enter_all"].iloc[0]) if given else STATES, int(part["leave_all"].iloc[0]) if given else None)
                enters += enter
                leaves += leave
            return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "enter": enters, "leave": leaves})

        return run

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "above", "block"])
        out = []
        for x, size in zip(*_runs(pdf, ["key", "above"]), strict=True):
            ms = stack(pdf.iloc[x : x + size])
            total = ms[0]
            for m in ms[1:]:
                total = (total[:, :, None] + m[None]).max(1)
            out.append((pdf["key"].iloc[x], pdf["above"].iloc[x], total.ravel()))
        return pd.DataFrame(out, columns=["key", "block", "m"])

    sizes = matrices.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, lots = sizes[0] or 0, max(1, (sizes[1] or 0) // TOGETHER)
    if most <= SPAN:
        return matrices.groupBy(_lot(lots, "key")).applyInPandas(linked(["key"], False), _ENDS)
    matrices = matrices.withColumn("above", F.floor(F.col("block") / SPAN))
    above = materialise(matrices.groupBy(_lot(lots, "key", "above")).applyInPandas(product, "key long, block long, m array<double>"), "above")
    ends = _ends(above).select("key", F.col("block").alias("above"), F.col("enter").alias("enter_all"), F.col("leave").alias("leave_all"))
    return matrices.join(ends, ["key", "above"]).groupBy(_lot(lots, "key", "above")).applyInPandas(linked(["key", "above"], True), _ENDS)


def recover_lines(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, message, number, place, label (as given), role, first (of its turn), line of every line of (conv_id, turn, role, text)."""
    lines = materialise(_lines(conversations), "lines")
    a, b = fit(lines)

    def reduce_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "block", "place"])
        starts, sizes = _runs(pdf, ["key", "block"])
        m = block_matrices(pdf["symbol"].to_numpy(), starts, sizes, a, b)
        return pd.DataFrame({"key": pdf["key"].to_numpy()[starts], "block": pdf["block"].to_numpy()[starts], "m": [x.ravel() for x in m]})

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "block", "place"])
        starts, sizes = _runs(pdf, ["key", "block"])
        states = decode_blocks(pdf["enter"].to_numpy()[starts], pdf["leave"].to_numpy()[starts], pdf["symbol"].to_numpy(), starts, sizes, a, b)
        return pd.DataFrame({"key": pdf["key"], "place": pdf["place"], "state": states})

    thin = lines.select("key", "place", "block", "symbol")
    lots = max(1, thin.select("key", "block").distinct().count() // TOGETHER)
    matrices = materialise(thin.groupBy(_lot(lots, "key", "block")).applyInPandas(reduce_blocks, "key long, block long, m array<double>"), "matrices")
    states = thin.join(_ends(matrices), ["key", "block"]).groupBy(_lot(lots, "key", "block")).applyInPandas(decode, "key long, place long, state int")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state") % len(ROLES) + 1).alias("role")
    return lines.join(states, ["key", "place"]).select("key", "conv_id", "turn", "message", "number", "place", "label", role, (F.col("state") < len(ROLES)).alias("first"), "line")


def recover_roles(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part, place (of its first line), n_lines, role (recovered), label (as given), rendered of every turn in the rows of (conv_id, turn, role, text).

    A row falls into several turns, its parts, where a speaker marker begins one;
    lines of one turn are joined. The given role is used to count the model's
    probabilities but not for decoding; rows of other roles, or none, are decoded
    as well. Null and empty texts are one empty line. Null turns come first; ties
    of turns stand in an order of their contents. A row without a conversation id
    is a transcript of its own. Other columns are ignored; an empty table gives no
    rows.
    """
    lines = recover_lines(conversations)
    begins = ((F.col("number") == 0) | F.col("first")).cast("int")
    part = F.sum(begins).over(Window.partitionBy("message").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - 1
    body = F.when(begins == 1, without_marker(F.col("line"))).otherwise(F.regexp_replace("line", _END_MARK, ""))
    turns = lines.withColumn("part", part.cast("int")).withColumn("body", body).groupBy("message", "part").agg(
        F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("label").alias("label"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n_lines"),
        F.min_by("role", "number").alias("role"), F.array_sort(F.collect_list(F.struct("number", "body"))).alias("own"),
    )
    text = F.trim(F.array_join(F.transform("own", lambda x: x["body"]), "\n"))
    rendered = F.concat(F.lit(RENDER[0]), "role", F.lit(RENDER[1]), text, F.lit(RENDER[2])).alias("rendered")
    return turns.select("conv_id", "turn", "part", "place", "n_lines", "role", "label", rendered)
