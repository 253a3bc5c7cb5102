"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal conversations: an optional system turn, then user and assistant turns in alternation, beginning with a user.
A turn may keep its role, be relabelled, be merged into the turn before it, or have empty turns inserted before it.
"""

from __future__ import annotations

from itertools import chain as joined

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles, after trimming and lower-casing.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
#: Costs of one merge, one relabelling (an unknown role takes any role for UNKNOWN) and one inserted empty turn.
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each state; state s > 0 is "the last turn has role s".
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
#: Stands for "any last state".
FREE = -1
#: Turns in a run at most, and bytes of text about; longer conversations are cut into runs.
RUN_TURNS, RUN_BYTES = 4096, 8_000_000


def _paths() -> dict[tuple[int, int], list[int]]:
    """For each state and role the fewest empty turns to insert so that the role may follow."""
    found: dict[tuple[int, int], list[int]] = {}
    for state in NEXT:
        level = [(state, [])]
        while level:
            following = []
            for at, path in level:
                for role in NEXT[at]:
                    if (state, role) not in found:
                        found[state, role] = path
                        following.append((role, [*path, role]))
            level = following
    return found


PATHS = _paths()


def moves(role: int) -> list[tuple[int, int, int, str, list[int]]]:
    """(state before, state after, cost, action, inserted roles) for a turn whose role is ``role`` (0: unknown)."""
    out = []
    for state in NEXT:
        for to in (SYSTEM, USER, ASSISTANT):
            change = 0 if to == role else UNKNOWN if role == NONE else RELABEL
            if state == to:
                out.append((state, to, change + MERGE, "merge", []))
            if (state, to) in PATHS:
                path = PATHS[state, to]
                out.append((state, to, change + INSERT * len(path), "keep" if to == role else "relabel", path))
    return out


#: The cheapest move for each role, state before and state after; of equals the first of keep or relabel, then merge.
BEST = [{} for _ in range(4)]
for _role in range(4):
    for _a, _b, _cost, _action, _path in moves(_role):
        _old = BEST[_role].get((_a, _b))
        if _old is None or (_cost, _action == "merge") < (_old[0], _old[1] == "merge"):
            BEST[_role][_a, _b] = (_cost, _action, _path)
COST = np.full((4, 4, 4), FAR, np.int64)
for _role in range(4):
    for (_a, _b), (_cost, _, _) in BEST[_role].items():
        COST[_role, _a, _b] = _cost


def _compose(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two runs of turns in a row as one.

    A run is [2, 4, 4]: by the state before and the state after it, the least cost, and the place of that way among the
    four that end alike.  Of equally dear ways that one comes first whose states, read backwards, are the smallest; so
    the choice does not depend on where a conversation is cut.
    """
    total = np.minimum(left[..., 0, :, :, None] + right[..., 0, None, :, :], FAR)
    best = (total * 4 + right[..., 1, None, :, :]).argmin(-2)  # the state in the middle, by first and last state
    cost = np.take_along_axis(total, best[..., None, :], -2)[..., 0, :]
    after = np.take_along_axis(right[..., 1, :, :], best, -2)
    before = np.take_along_axis(left[..., 1, :, :], best, -1)
    order = after * 16 + before * 4 + np.arange(4)[:, None]
    return np.stack([cost, order.argsort(-2).argsort(-2)], -3)


SINGLE = np.stack([COST, np.broadcast_to(np.arange(4)[:, None], COST.shape)], 1)


def run_of(roles: np.ndarray) -> np.ndarray:
    """The run of some turns, at least one: neighbours are put together until one is left."""
    runs = SINGLE[roles]
    while len(runs) > 1:
        even = len(runs) // 2 * 2
        runs = np.concatenate([_compose(runs[0:even:2], runs[1:even:2]), runs[even:]])
    return runs[0]


def chain(runs: np.ndarray, start: int = NONE, end: int = FREE) -> list[tuple[int, int]]:
    """The states before and after each of a conversation's runs; ``end`` FREE takes the cheapest last state."""
    best, back = np.full(4, FAR, np.int64), []
    best[start] = 0
    for cost, place in runs:
        total = np.minimum(best[:, None] + cost, FAR)
        back.append((total * 4 + place).argmin(0))
        best = total.min(0)
    at, out = int(best.argmin()) if end == FREE else end, []
    for b in reversed(back):
        out.append((int(b[at]), at))
        at = int(b[at])
    return out[::-1]


def walk(roles: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states after all turns of some sequences that stand one after another; each has its first and its last state
    (or FREE).  All sequences go forward together, place by place, and back again."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes[order[0]]) if len(order) else 0
    active = [int(np.searchsorted(-sizes[order], -t, "left")) for t in range(longest)]
    best = np.full((len(order), 4), FAR, np.int64)
    best[np.arange(len(order)), start[order]] = 0
    back = np.empty((len(roles), 4), np.int8)
    for t, n in enumerate(active):
        total = np.minimum(best[:n, :, None] + COST[roles[first[:n] + t]], FAR)
        back[first[:n] + t] = total.argmin(1)
        best[:n] = total.min(1)
    at = np.where(end[order] == FREE, best.argmin(1), end[order])
    out = np.empty(len(roles), np.int8)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        here = first[:n] + t
        out[here] = at[:n]
        at[:n] = back[here, at[:n]]
    return out


def role_number(role: Column) -> Column:
    name = F.lower(F.trim(role))
    out = F.when(name == ROLES[0], SYSTEM).when(name == ROLES[1], USER).when(name == ROLES[2], ASSISTANT)
    for alias, to in ALIASES.items():
        out = out.when(name == alias, ROLES.index(to) + 1)
    return out.otherwise(NONE).cast("int")


def _starts(conv: pa.Array) -> np.ndarray:
    """Where another conversation begins; the first row always counts."""
    codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


def _placed(rows: pa.Table, part: int, seg: int | None, sizes: np.ndarray) -> pa.Table:
    """Rows of whole conversations with their states; rows of one run (``seg``) with their places in it alone."""
    n = rows.num_rows
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if seg is None:
        roles = rows.column("r").to_numpy()
        states = walk(roles, sizes, np.full(len(sizes), NONE), np.full(len(sizes), FREE))
        before = np.where(inside == 0, NONE, np.append(NONE, states[:-1]))
        columns = [pa.nulls(n, pa.int32()), pa.array(inside + 1), pa.array(before.astype(np.int32)), pa.array(states.astype(np.int32)), pa.array(inside == np.repeat(sizes, sizes) - 1)]
    else:
        columns = [pa.array(np.full(n, seg, np.int32)), pa.array(inside), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())]
    for name, column in zip(("part", "seg", "place", "before", "state", "last"), [pa.array(np.full(n, part, np.int32)), *columns], strict=True):
        rows = rows.append_column(name, column)
    return rows


def _place_turns(run_turns: int, run_bytes: int):
    """Sorted turns to the rows of ``_placed``.

    Conversations that lie inside a partition are repaired on the way.  The first and the last one of a partition may go
    on in another, and long ones are not held: their turns come out as numbered runs, to be repaired later.
    """

    def run(batches):
        part, seg, rest, cut = TaskContext.get().partitionId(), 0, None, True  # cut: the conversation at hand is in runs
        for b in joined(batches, [None]):
            if b is not None:
                rows = pa.Table.from_batches([b])
                rest = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            n = rest.num_rows if rest is not None else 0
            if not n:
                continue
            starts = _starts(rest.column("conv_id").combine_chunks())
            sizes = np.diff(np.append(starts, n))
            weight = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(rest.column("text")), 0).to_numpy()))
            long = (sizes > run_turns) | (weight[starts + sizes] - weight[starts] > run_bytes)
            long[0] |= cut
            keep = 0
            if b is None:
                long[-1] = True
            elif not long[-1]:
                keep = 1
            whole = np.flatnonzero(~long[: len(long) - keep])
            if len(whole):
                at = np.repeat(starts[whole] - np.cumsum(sizes[whole]) + sizes[whole], sizes[whole]) + np.arange(sizes[whole].sum())
                yield from _placed(rest.take(pa.array(at)), part, None, sizes[whole]).to_batches()
            for c in np.flatnonzero(long[: len(long) - keep]):
                lo, hi = starts[c], starts[c] + sizes[c]
                piece = np.maximum((np.arange(hi - lo)) // run_turns, (weight[lo:hi] - weight[lo]) // run_bytes)
                for own in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(piece)) + 1):
                    yield from _placed(rest.slice(own[0], len(own)), part, seg, np.array([len(own)])).to_batches()
                    seg += 1
            cut = not keep
            rest = rest.slice(starts[-1]) if keep else None

    return run


def _border_states(open_: DataFrame) -> DataFrame:
    """part, seg, and for each run its roles in order, the states at its borders, the turns before it, and whether it is
    its conversation's last.

    Runs are put together first inside each part, then over the parts, so no task holds more than the runs of one
    part, or two for each part.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    runs = open_.select(key, "part", "seg", F.struct("place", "r").alias("t")).groupBy("key", "part", "seg").agg(F.sort_array(F.collect_list("t")).alias("t"))
    runs = runs.select("key", "part", "seg", F.col("t.r").alias("roles"))

    def described(batches):
        for b in batches:
            found = [run_of(np.asarray(x.values)) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.ravel().tolist() for x in found], pa.list_(pa.int64())), pa.array([len(x) for x in b.column(3)], pa.int64())], names=[*b.schema.names, "m", "n"])

    runs = save(runs.mapInArrow(described, "key string, part int, seg int, roles array<int>, m array<long>, n long"), "runs")
    matrices = lambda pdf: [np.array(m).reshape(2, 4, 4) for m in pdf["m"]]

    def together(key, pdf):
        pdf = pdf.sort_values("seg")
        total, *more = matrices(pdf)
        for m in more:
            total = _compose(total, m)
        return pd.DataFrame([[key[0], key[1], total.ravel().tolist(), pdf["n"].sum()]], columns=["key", "part", "m", "n"])

    def bordered(pdf, start, end, before, final, label):
        ends = chain(matrices(pdf), start, end)
        n = pdf["n"].to_numpy()
        out = pdf[["key", *label]].copy()
        out["start"], out["end"] = [a for a, _ in ends], [b for _, b in ends]
        out["before"], out["final"] = before + np.cumsum(n) - n, (np.arange(len(n)) == len(n) - 1) & final
        return out

    def over_parts(pdf):
        return bordered(pdf.sort_values("part"), NONE, FREE, 0, True, ["part"])

    def inside_parts(pdf):
        pdf = pdf.sort_values("seg").reset_index(drop=True)
        return bordered(pdf, int(pdf["start"][0]), int(pdf["end"][0]), int(pdf["before"][0]), bool(pdf["final"][0]), ["part", "seg"])

    light = runs.drop("roles")
    by_part = light.groupBy("key", "part").applyInPandas(together, "key string, part int, m array<long>, n long")
    parts = by_part.groupBy("key").applyInPandas(over_parts, "key string, part int, start int, end int, before long, final boolean")
    states = light.join(parts, ["key", "part"]).groupBy("key", "part").applyInPandas(inside_parts, "key string, part int, seg int, start int, end int, before long, final boolean")
    return runs.select("part", "seg", "roles").join(states.drop("key"), ["part", "seg"])


def _walk_runs(batches):
    """Runs with their border states to one row per turn: part, seg, ``in_run``, and what ``_placed`` gives."""
    for b in batches:
        roles = b.column(2)
        sizes = np.array([len(x) for x in roles], np.int64)
        start, end, before, final = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
        states = walk(roles.flatten().to_numpy(), sizes, start, end)
        own = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        previous = np.where(inside == 0, start[own], np.append(NONE, states[:-1])) if len(own) else own
        last = (inside == sizes[own] - 1) & final[own]
        columns = [b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), pa.array(inside), pa.array(before[own] + inside + 1), pa.array(previous.astype(np.int32)), pa.array(states.astype(np.int32)), pa.array(last)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "seg", "in_run", "place", "before", "state", "last"])


def escaped(text: Column) -> Column:
    """A text that holds no control token: one more backslash after a < that | or backslashes and | follow.  Taking one
    backslash away there gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), with the repair of its conversation that costs least.

    Columns: conv_id, turn, ``place`` (1, 2, ... in the conversation), ``role`` as given, ``new_role``, ``action`` (keep,
    relabel or merge), ``inserted`` (roles of empty turns before it), ``cost`` (of this turn), ``last`` and ``rendered``:
    its part of the formatted conversation.  The parts in order of place are the whole conversation; a merged turn goes
    on in the turn before it.  Texts are escaped, so only the repair writes control tokens.

    Turns are ordered by turn, then by role and text; a null turn comes last, null texts are empty, null and strange
    roles are unknown and may take any role.  Rows with a null conv_id form one conversation.  Repeated turns are turns;
    other columns are ignored; no turns give no rows.  Of equally cheap repairs the one whose roles, read backwards, come
    first (system, user, assistant) is taken, wherever a conversation is cut.

    Spark sorts the turns by ranges, so a conversation of any length is dealt over partitions.  A task repairs all
    conversations that lie inside its partition at once.  Of the others each run of turns is reduced to the least costs
    between its border states (4 x 4); those are combined over runs and parts, and each run is then repaired alone.
    """
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), role_number(F.col("role").cast("string")).alias("r"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    rows = save(rows.mapInArrow(_place_turns(RUN_TURNS, RUN_BYTES), f"{kinds}, part int, seg int, place long, before int, state int, last boolean"), "turns")

    open_ = rows.where("seg is not null")
    walked = _border_states(open_).mapInArrow(_walk_runs, "part int, seg int, in_run long, place long, before int, state int, last boolean")
    open_ = open_.drop("before", "state", "last").withColumnRenamed("place", "in_run").join(walked, ["part", "seg", "in_run"])
    names = ["conv_id", "turn", "place", "role", "r", "before", "state", "last", "text"]
    out = rows.where("seg is null").select(names).unionByName(open_.select(names))

    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state"))
    at = F.col("r") * 16 + F.col("before") * 4 + F.col("state") + 1
    best = [BEST[r].get((a, b), (0, "", [])) for r in range(4) for a in range(4) for b in range(4)]
    looked_up = lambda values: F.element_at(F.array(*values), at)
    inserted = looked_up([F.array(*[F.lit(ROLES[p - 1]) for p in path]).cast("array<string>") for _, _, path in best])
    out = out.select("conv_id", "turn", "place", "role", name.alias("new_role"), looked_up([F.lit(a) for _, a, _ in best]).alias("action"), inserted.alias("inserted"), looked_up([F.lit(c) for c, _, _ in best]).cast("long").alias("cost"), "last", escaped(F.coalesce("text", F.lit(""))).alias("text"))
    opening = F.concat(
        F.when(F.col("place") > 1, "<|end|>\n").otherwise(""),
        F.array_join(F.transform("inserted", lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), ""),
        F.lit("<|"), F.col("new_role"), F.lit("|>\n"), F.col("text"),
    )
    rendered = F.concat(F.when(F.col("action") == "merge", F.concat(F.lit("\n"), F.col("text"))).otherwise(opening), F.when(F.col("last"), "<|end|>\n").otherwise(""))
    return out.withColumn("rendered", rendered).drop("text")


def conversation_texts(repaired: DataFrame) -> DataFrame:
    """``repaired`` turns to whole texts: conv_id, ``part``, ``n_turns``, ``cost`` and ``text``.

    A conversation is one row (part 0); one of over RUN_TURNS turns goes on in parts 1, 2, ..., so that no row and no
    group grows without bound.  Rows with a null conv_id are one conversation.
    """
    part = F.floor((F.col("place") - 1) / RUN_TURNS).cast("long").alias("part")
    turn = F.struct("place", "rendered").alias("t")
    grouped = repaired.select("conv_id", part, turn, "cost").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "part", "n_turns", "cost", F.array_join(F.col("t.rendered"), "").alias("text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with its repair and its part of the rendered conversation."""
    return repair_roles(table(spark, sf_dir, "conversations"))


def _moves_sql() -> str:
    return ", ".join(f"({r}, {a}, {b}, {cost}, '{action}', [{', '.join(repr(ROLES[p - 1]) for p in path)}]::varchar[])" for r in range(4) for (a, b), (cost, action, path) in sorted(BEST[r].items()))


_NUMBER_SQL = "case lower(trim(role)) " + " ".join(f"when '{name}' then {ROLES.index(to) + 1}" for name, to in [*zip(ROLES, ROLES, strict=True), *ALIASES.items()]) + " else 0 end"

OP1_SQL = f"""
with recursive
moves(r, a, b, cost, action, inserted) as (values {_moves_sql()}),
t as (
  select conv_id, turn, role, coalesce(text, '') as text, {_NUMBER_SQL} as r,
         row_number() over (partition by conv_id order by turn, role, text) as place, count(*) over (partition by conv_id) as n
  from conversations
),
steps as (select place, conv_id, n, b, a, cost from t join moves using (r)),
ways as (
  select conv_id, n, 0::bigint as place, 0 as b, 0::bigint as total, []::integer[] as path from (select distinct conv_id, n from t)
  union all
  select w.conv_id, w.n, s.place, s.b, min(w.total + s.cost)::bigint,
         arg_min(list_append(w.path, s.b), (w.total + s.cost) * 4 + w.b)
  from ways w join steps s on s.conv_id = w.conv_id and s.place = w.place + 1 and s.a = w.b
  group by w.conv_id, w.n, s.place, s.b
),
best as (select conv_id, arg_min(path, total * 4 + b) as path from ways where place = n group by conv_id),
told as (
  select t.*, path[place] as b, case when place = 1 then 0 else path[place - 1] end as a,
         regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') as safe
  from t join best using (conv_id)
)
select conv_id, turn, place, role, ['system', 'user', 'assistant'][told.b] as new_role, action, inserted, cost::bigint as cost, place = n as last,
       case when action = 'merge' then chr(10) || safe
            else case when place > 1 then '<|end|>' || chr(10) else '' end
                 || array_to_string(list_transform(inserted, lambda x: '<|' || x || '|>' || chr(10) || '<|end|>' || chr(10)), '')
                 || '<|' || ['system', 'user', 'assistant'][told.b] || '|>' || chr(10) || safe end
       || case when place = n then '<|end|>' || chr(10) else '' end as rendered
from told join moves m on m.r = told.r and m.a = told.a and m.b = told.b
"""
