"""Chat formatting: a hidden Markov model recovers who speaks from markers and line features, then turns are rendered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

# The hidden states, and the names by which speaker markers call them.
ROLES = ("system", "user", "assistant")
MARKER_NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "gpt", "model", "response"),
}
#: What may stand around a speaker's name at the start of a line; group 1 is the name, the rest of the line is speech.
#: After <|im_start|>, the end of the line ends the name.
MARKER = r"(?i)^\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?(" + "|".join(name for names in MARKER_NAMES.values() for name in sorted(names, key=len, reverse=True)) + r")(?:\|>|\]:?|:\*\*|\*\*:?|\s*:|(?<=<\|im_start\|>[a-z]{1,16})\s*$) ?"


@dataclass(frozen=True)
class Settings:
    """stay: that a line which starts no turn has the speaker of the line before; split: that a
    marker inside a turn opens another speaker's; trust, strength: what is held of markers before any is
    counted, that they name the true speaker, as strong as that many markers seen; smooth: added to
    each other count; block: turns that one step decodes.
    """

    stay: float = 0.97
    split: float = 0.5
    trust: float = 0.98
    strength: float = 100.0
    smooth: float = 1.0
    block: int = 256


def transcript(conversations: DataFrame, marked: bool = True) -> DataFrame:
    """``conversations`` as raw transcript turns: conv_id, turn, text. Where ``marked``, a marker of the role stands before a turn whose role is known."""
    role = F.lower(F.trim(F.col("role").cast("string")))
    marker = F.when(role.isin(*ROLES), F.concat(F.initcap(role), F.lit(": "))).otherwise(F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select("conv_id", "turn", (F.concat(marker, text) if marked else text).alias("text"))


def held_out(column: str = "conv_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1: such conversations are not learnt from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def given_role() -> Column:
    """The number of the role that a conversation table states, from 0; null if it states none."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim(F.col("role").cast("string"))))
    return F.when(place > 0, place - 1).cast("int")


def _marker_role(name: Column) -> Column:
    out = F.lit(0)
    for number, role in enumerate(ROLES, 1):
        out = F.when(F.lower(name).isin(*MARKER_NAMES[role]), number).otherwise(out)
    return out


# Line features, each a small number: the line's length in powers of two, with whether it asks and whether it is a list item or
# code; and, on the first line of a turn, the turn's length in powers of the square root of two and its number of lines.
LINE, LENGTH, LINES = 14 * 4, 42, 10


def _power(n: Column, steps: int, most: int) -> Column:
    return F.least(F.floor(F.log2(n + 1) * steps), F.lit(most)).cast("int")


#: A block's number is its range's, and its place there in so many bits.
BLOCK_BITS = 33


def lines(texts: DataFrame, block: int, *carried: str) -> DataFrame:
    """One row per line: conv_id, block, turn, tie, copy, at, line, speech, marker (0: none) and the features; ``carried`` columns come along.

    ``tie`` orders turns of one number; blank lines stay with the turn they are in; turns without a number lie before the others. The turns are dealt out
    in ranges of this order and cut every ``block`` turns, so that a conversation of any length, and all rows of a null
    conv_id or of one turn number, spread over tasks; ``block`` rises along the order.
    """
    raw = texts.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    # ``copy`` keeps the lines of rows that are alike in all apart.
    raw = raw.withColumns({"tie": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "tie", "copy"]
    raw = raw.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    of_range = F.shiftright("place", BLOCK_BITS)
    raw = raw.withColumns({"block": F.shiftleft(of_range, BLOCK_BITS) + F.floor((F.col("place") - F.shiftleft(of_range, BLOCK_BITS)) / block), "length": _power(F.length("text"), 2, LENGTH - 1), "cut": F.split("text", "\n")})
    cut = raw.select("conv_id", "block", "turn", "tie", "copy", *carried, "length", F.least(F.size("cut"), F.lit(LINES)).alias("n"), F.posexplode("cut").alias("at", "line"))
    marker = _marker_role(F.regexp_extract("line", MARKER, 1))
    speech = F.when(F.col("marker") > 0, F.regexp_replace("line", MARKER, ""))
    said = F.coalesce("speech", "line")
    asks = F.rtrim(said).endswith("?").cast("int")
    listed = said.rlike(r"^\s*(?:[-*+] |\d+[.)] |```|    \S)").cast("int")
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).otherwise(-1).cast("int")
    cut = cut.withColumn("marker", marker).withColumn("speech", speech)
    of_line = _power(F.length(said), 1, 13) * 4 + asks * 2 + listed
    return cut.select("conv_id", "block", "turn", "tie", "copy", *carried, "at", "line", "speech", "marker", of_line.cast("int").alias("of_line"), first("length").alias("length"), first("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Log probabilities by role: of the first turn, of the next line's role at a new turn, at a marker inside a turn and at other lines; of features; of markers at a turn's start and inside."""

    start: np.ndarray
    change: np.ndarray
    split: np.ndarray
    same: np.ndarray
    of_line: np.ndarray
    length: np.ndarray
    n: np.ndarray
    first_marker: np.ndarray
    inner_marker: np.ndarray


def fit(conversations: DataFrame, settings: Settings = Settings()) -> Model:
    """Counts over all turns whose role is known; only tables of roles and features come to the driver."""
    return fit_lines(lines(conversations.select("conv_id", "turn", "text", given_role().alias("given")), settings.block, "given"), settings)


def _followed(turns: DataFrame) -> DataFrame:
    """given, before (the role of the conversation's turn before) and first (whether there is none) of each turn.

    Each range of turns is a window of its own; what its first turn follows is the last one of the ranges before it, a row for each.
    """
    order = ["conv_id", "turn", "tie", "copy"]
    ranged = turns.select(*order, "given", F.shiftright("block", BLOCK_BITS).alias("range"))
    own = F.struct("conv_id", "given")
    inside = Window.partitionBy("range").orderBy(*order)
    lasts = ranged.groupBy("range").agg(F.max_by(own, F.struct(*order)).alias("last"))
    carried = lasts.select("range", F.lag("last").over(Window.orderBy("range")).alias("carried"))
    seen = ranged.select("range", "conv_id", "given", F.lag(own).over(inside).alias("previous"), (F.row_number().over(inside) == 1).alias("opens")).join(carried, "range", "left")
    previous = F.when(F.col("opens"), F.col("carried")).otherwise(F.col("previous"))
    seen = seen.withColumn("previous", previous)
    first = F.col("previous").isNull() | ~F.col("previous.conv_id").eqNullSafe(F.col("conv_id"))
    return seen.select("given", F.when(~first, F.col("previous.given")).alias("before"), first.alias("first"))


def fit_lines(cut: DataFrame, settings: Settings) -> Model:
    """The model of a line table that carries ``given``, the roles to learn from."""
    k = len(ROLES)
    smooth = lambda *shape: np.full(shape, settings.smooth)
    turns = _followed(cut.where("at = 0"))
    start, change = smooth(k), smooth(k, k)
    for row in turns.where("given IS NOT NULL").groupBy("given", "before", "first").count().collect():
        if row.first:
            start[row.given] += row["count"]
        elif row.before is not None:
            change[row.before, row.given] += row["count"]
    of_line, length, n = smooth(k, LINE), smooth(k, LENGTH), smooth(k, LINES + 1)
    prior = np.full((k, k), (1 - settings.trust) / (k - 1))
    np.fill_diagonal(prior, settings.trust)
    markers = [settings.strength * prior, settings.strength * prior]
    counts = cut.where("given IS NOT NULL").groupBy("given", "of_line", "length", "n", "marker").count()
    for row in counts.collect():  # at most LINE * LENGTH * LINES combinations, however many lines there are
        of_line[row.given, row.of_line] += row["count"]
        if row.n >= 0:
            length[row.given, row.length] += row["count"]
            n[row.given, row.n] += row["count"]
        if row.marker:
            markers[row.n < 0][row.given, row.marker - 1] += row["count"]
    shares = lambda table: table / table.sum(axis=-1, keepdims=True)
    same = np.full((k, k), (1 - settings.stay) / (k - 1))
    np.fill_diagonal(same, settings.stay)
    split = settings.split * shares(change) + (1 - settings.split) * np.eye(k)
    # A last column of zeros stands for what a line does not have: an index of -1.
    no = lambda table: np.hstack([np.log(shares(table)), np.zeros((k, 1))])
    return Model(np.log(shares(start)), np.log(shares(change)), np.log(split), np.log(same), no(of_line), no(length), no(n), no(markers[0]), no(markers[1]))


def _emissions(model: Model, rows: dict[str, np.ndarray]) -> np.ndarray:
    marker, first = rows["marker"] - 1, rows["at"] == 0
    named = np.where(first, model.first_marker[:, marker], model.inner_marker[:, marker])
    return (model.of_line[:, rows["of_line"]] + model.length[:, rows["length"]] + model.n[:, rows["n"]] + named).T


def _steps(model: Model, rows: dict[str, np.ndarray], starts: bool) -> np.ndarray:
    """(lines, from, to): transition and emission of each line; ``starts`` where the first line is the conversation's first."""
    first, marked = rows["at"] == 0, rows["marker"] > 0
    moves = np.where(first[:, None, None], model.change, np.where(marked[:, None, None], model.split, model.same))
    if starts:
        moves[0] = model.start[None, :]
    return moves + _emissions(model, rows)[:, None, :]


def _product(steps: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines to each state at their end: a max-plus product."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        left, right = steps[0 : len(steps) - len(odd) : 2], steps[1::2]
        steps = np.concatenate([(left[:, :, :, None] + right[:, None, :, :]).max(axis=2), odd])
    return steps[0]


def viterbi(steps: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best states of the lines, given scores of the states before them and after them; the first of equal ones."""
    back = np.zeros((len(steps), len(before)), dtype=np.int8)
    score = before
    for at, step in enumerate(steps):
        way = score[:, None] + step
        back[at] = way.argmax(axis=0)
        score = way.max(axis=0)
    states = np.empty(len(steps), dtype=np.int64)
    state = int((score + after).argmax())
    for at in range(len(steps) - 1, -1, -1):
        states[at] = state
        state = back[at, state]
    return states


def _borders(each: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The scores before and after each of a row of matrices, given those before and after them all."""
    befores, afters = [before], [after]
    for matrix in each[:-1]:
        befores.append((befores[-1][:, None] + matrix).max(axis=0))
    for matrix in reversed(each[1:]):
        afters.append((matrix + afters[-1][None, :]).max(axis=1))
    return befores, afters[::-1]


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys, over the borders of batches, as arrays by column; nulls are equal."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {name: np.concatenate([part[name] for part in held]) for name in held[0]}

    for frame in frames:
        if not len(frame):
            continue
        cuts = np.zeros(len(frame), dtype=bool)
        for key in keys:
            before = frame[key].shift()
            cuts |= ((frame[key] != before) & ~(frame[key].isna() & before.isna())).to_numpy()
        ends = [tuple(None if pd.isna(value) else value for value in frame[keys].iloc[at]) for at in (0, -1)]
        cuts[0] = bool(held) and ends[0] != last
        last = ends[1]
        columns = {name: frame[name].to_numpy() for name in frame.columns}
        edges = [0, *np.flatnonzero(cuts).tolist(), len(frame)]
        for place, (low, high) in enumerate(zip(edges, edges[1:])):
            if place and held:
                yield whole()
                held = []
            if low < high:
                held.append({name: values[low:high] for name, values in columns.items()})
    if held:
        yield whole()


def _rendered(rows: dict[str, np.ndarray], states: np.ndarray) -> Iterator[tuple]:
    """(place of the first line, part, role, lines, text) of each part: a run of one role within a turn.

    A marker is taken off where it opens a part whose role it names; any other stays in the text.
    """
    ats, markers, said, raw = (rows[name].tolist() for name in ("at", "marker", "speech", "line"))
    part, begin = 0, 0
    for at in range(1, len(states) + 1):
        if at < len(states) and ats[at] and states[at] == states[at - 1]:
            continue
        state = int(states[begin])
        head = said[begin] if markers[begin] == state + 1 else raw[begin]
        yield begin, part, ROLES[state], at - begin, f"<|im_start|>{ROLES[state]}\n" + "\n".join([head, *raw[begin + 1 : at]]) + "<|im_end|>"
        part = part + 1 if at < len(states) and ats[at] else 0
        begin = at


def format_chats(conversations: DataFrame, model: Model, settings: Settings = Settings(), *, marked: bool = True) -> DataFrame:
    """conv_id, turn, part, role, n_lines, rendered: the turns of each conversation as the model reads them.

    Where ``marked``, a known role is written before its turn as a marker; else the role column is not read.
    A marker inside a turn's text may open a new part. Null text is an empty turn; null turns come
    first; turns that repeat a number are ordered by a hash of their text; rows with a
    null conv_id form one conversation. An empty table gives no rows. Other columns are not read. Very long texts are read whole.
    """
    return decode(materialize(lines(transcript(conversations, marked), settings.block), "lines"), model)


def decode(cut: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The parts of a line table, with its ``carried`` columns.

    Viterbi runs over all lines of a conversation, in blocks of turns: a block's
    best scores between its border states are a small matrix, and such matrices
    multiply, so each block is decoded alone once the scores before and after it
    are known. The matrices of a conversation multiply by ranges of turns first, and the ranges' then, so no
    task holds more of a conversation than a block's lines, or a range's matrices. Where several paths
    are equally good, the first state is taken.
    """
    key_type = dict(cut.dtypes)["conv_id"]
    several = cut.groupBy("conv_id").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block")).where("first_block < last_block")
    features = ["conv_id", "block", "turn", "tie", "copy", "at", "marker", "of_line", "length", "n"]
    order = ["conv_id", "block", "turn", "tie", "copy", "at"]

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(frames, ["conv_id", "block"]):
            product = _product(_steps(model, rows, bool(rows["is_first"][0])))
            yield pd.DataFrame({"conv_id": rows["conv_id"][:1], "block": rows["block"][:1], "matrix": [product.ravel()]})

    # Only the features of conversations of several blocks take this way.
    same = F.col("l.conv_id").eqNullSafe(F.col("s.conv_id"))
    long_ones = cut.select(*features).alias("l").join(several.alias("s"), same).select("l.*", (F.col("l.block") == F.col("s.first_block")).alias("is_first"))
    parts = long_ones.repartition("conv_id", "block").sortWithinPartitions(*order).mapInPandas(matrices, f"conv_id {key_type}, block long, matrix array<double>")

    k = len(ROLES)
    of_rows = lambda rows: [np.asarray(m).reshape(k, k) for m in rows["matrix"]]

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        """The matrix of a conversation's blocks in one range."""
        rows = rows.sort_values("block")
        return pd.DataFrame({"conv_id": rows["conv_id"].array[:1], "range": rows["range"].array[:1], "matrix": [_product(np.array(of_rows(rows))).ravel()]})

    def of_ranges(rows: pd.DataFrame) -> pd.DataFrame:
        """The scores before and after each range of a conversation."""
        rows = rows.sort_values("range")
        before, after = _borders(of_rows(rows), np.zeros(k), np.zeros(k))
        return pd.DataFrame({"conv_id": rows["conv_id"].array, "range": rows["range"].array, "before": before, "after": after, "is_first": [True] + [False] * (len(rows) - 1)})

    def of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        """The scores before and after each block of a conversation's range."""
        rows = rows.sort_values("block")
        head = rows.iloc[0]
        before, after = _borders(of_rows(rows), np.asarray(head["before"]), np.asarray(head["after"]))
        return pd.DataFrame({"conv_id": rows["conv_id"].array, "block": rows["block"].array, "before": before, "after": after, "is_first": [bool(head["is_first"])] + [False] * (len(rows) - 1)})

    # A row of a few numbers for each block of turns, which travels before the block's lines.
    parts = materialize(parts.withColumn("range", F.shiftright("block", BLOCK_BITS)), "matrices")
    by_range = parts.groupBy("conv_id", "range").applyInPandas(folded, f"conv_id {key_type}, range long, matrix array<double>")
    ranges = by_range.groupBy("conv_id").applyInPandas(of_ranges, f"conv_id {key_type}, range long, before array<double>, after array<double>, is_first boolean")
    met = (F.col("p.range") == F.col("r.range")) & F.col("p.conv_id").eqNullSafe(F.col("r.conv_id"))
    both = parts.alias("p").join(ranges.alias("r"), met).select("p.*", "r.before", "r.after", "r.is_first")
    bounds = materialize(both.groupBy("conv_id", "range").applyInPandas(of_blocks, f"conv_id {key_type}, block long, before array<double>, after array<double>, is_first boolean"), "borders")
    wanted = [*order, *carried, "line", "speech", "marker", "of_line", "length", "n"]
    # The null turns and ties of such a row sort first; a place of -1 tells it.
    both = cut.select(*wanted).unionByName(bounds.withColumn("at", F.lit(-1)), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        zero = np.zeros(len(ROLES))
        for rows in _groups(frames, ["conv_id", "block"]):
            before, after, first = zero, zero, True
            if rows["at"][0] == -1:
                before, after, first = np.asarray(rows["before"][0]), np.asarray(rows["after"][0]), bool(rows["is_first"][0])
                rows = {name: values[1:] for name, values in rows.items()}
            rows |= {name: rows[name].astype(np.int64) for name in ("at", "marker", "of_line", "length", "n")}
            states = viterbi(_steps(model, rows, first), before, after)
            keys = list(zip(*(rows[name].tolist() for name in ("conv_id", "turn", *carried))))
            out += [(*keys[begin], *rest) for begin, *rest in _rendered(rows, states)]
            if len(out) > 5000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["conv_id", "turn", *carried, "part", "role", "n_lines", "rendered"])
        return found.astype({"turn": "Int64"} | {name: "Int64" for name in carried})

    schema = f"conv_id {key_type}, turn long, " + "".join(f"{name} int, " for name in carried) + "part long, role string, n_lines long, rendered string"
    return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("at") != -1, *order[2:]).mapInPandas(run, schema)


def recover(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The turns of conversations as read from their texts alone: the columns of ``format_chats``, given_role and held_out.

    The model learns from the stated roles of the conversations that are not held out; no role is an input of the
    reading. given_role is the stated role, to compare with. The lines are cut once, for both.
    """
    source = conversations.select("conv_id", "turn", F.col("text").cast("string").alias("text"), given_role().alias("given"))
    cut = materialize(lines(source, settings.block, "given"), "lines")
    model = fit_lines(cut.where(~held_out()), settings)
    parts = decode(cut, model, "given")
    names = F.array(*map(F.lit, ROLES))
    return parts.select("conv_id", "turn", "part", "role", "n_lines", "rendered", F.get(names, F.col("given")).alias("given_role"), held_out().alias("held_out"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover(table(spark, sf_dir, "conversations"))
