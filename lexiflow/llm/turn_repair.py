"""Operator 12, conversation structure repair by prefix-doubling path ranking.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Each row is
kept (0), given the role user or assistant (1), or deleted (2, required if it
is blank or repeats an earlier row); a user or assistant row of empty text can
be inserted anywhere (5); a row that ends without ``.``, ``!`` or ``?`` costs 5
unless deleted. Of the cheapest edits those are taken whose initials
(``D I K R``), in order, are least.

1. Cost DP: a node is (rows read, what was written last: nothing, s, u or a);
   its cost to the end is found from the last row back, for all conversations
   of a batch at once.
2. The arcs on which the cost is met form the optimal graph. Its nodes are
   ranked by the first letter of their least audit, then by the first 2, 4, 8,
   ... letters: the rank of a node and that of the node reached by its pointer
   give the rank at twice the length, and pointers are doubled along.
3. The arc of least (letter, rank of its end) is taken at every node, and the
   path from the start is read off the doubled pointers, letter ``j`` by the
   binary digits of ``j``.

A conversation may be any share of all rows. Rows are range-partitioned and
sorted by (conversation, turn); a task handles the conversations that lie
inside its range and passes the rows of its first and last one (and of any of
more than ``SPAN`` rows) on. Those are handled in pieces: a 4 x 4 table of least
costs per piece, joined from the last piece back; then each piece's paths from
all four states; then one streaming pass that picks the path of the state
reached and feeds the hash (SHA-256 of a conversation is sequential by nature).

Cases: a null role or text is one space, as is a null conversation or turn in
the damage key; a null conversation is one conversation; null turns come first;
rows of one turn are ordered by a hash of role and text, then role and text; a
row without a role's initial cannot be kept; extra columns are ignored; an
empty table gives an empty result; long texts pass through whole."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import stored

FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{f} long" for f in FACTS) + ", audit string, repaired_sha256 string"
ROW = "conv_id long, turn long, role string, text string, alive boolean"
#: Rows of a conversation held by a task, and rows solved together.
SPAN, BATCH = 20_000, 60_000
BLANKS = " \t\n\x0b\x0c\r"
INF = np.int64(1) << np.int64(40)
LETTERS = "DIKR"  # in ASCII order
NOTHING, S, U, A = range(4)
NEXT = np.array([U, U, A, U])
ACCEPT = np.array([0, INF, INF, 0])
KEPT = {("s", NOTHING): S, ("u", NOTHING): U, ("u", S): U, ("a", U): A, ("u", A): U}
LEGAL = {"su", "ua", "au"}
NEW_ROLE = {U: "user", A: "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage; a dropped row stays as one that is not alive, so
    that its conversation is known."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                             F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))

    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (code != 0).alias("alive"),
                    F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


class Rows:
    """Codes of the living rows of many conversations (or pieces), one after
    the other: ``first[i]:first[i + 1]`` are the rows of number ``i``. Number
    ``i`` has ``rows + 1`` slots of four nodes."""

    def __init__(self, first: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray):
        self.first, self.sizes = first, np.diff(first)
        self.slot = first + np.arange(len(first))  # slot of each first row; the last one is the end
        self.initial, self.must_go, self.truncated = initial, must_go, truncated
        self.row_slot = np.arange(len(initial)) + np.repeat(np.arange(len(self.sizes)), self.sizes)

    def arcs(self):
        """End state and cost of keeping, rewriting and deleting each row, by state."""
        n = len(self.initial)
        keep_to, keep = np.zeros((n, 4), np.int64), np.full((n, 4), INF)
        stay = np.where(self.truncated, 5, 0)
        for (letter, state), to in KEPT.items():
            fits = (self.initial == ord(letter)) & ~self.must_go
            keep_to[fits, state] = to
            keep[fits, state] = stay[fits]
        rewrite = np.where(self.must_go, INF, 1 + stay)
        return keep_to, keep, rewrite

    def costs(self, end: np.ndarray, closed: bool = True) -> np.ndarray:
        """Least cost to the end from every (slot, state); ``end`` are the costs
        at the last slots, where inserts come first only if ``closed``."""
        keep_to, keep, rewrite = self.arcs()
        value = np.full((len(self.initial) + len(self.sizes), 4), INF)
        last = self.slot[1:] - 1
        value[last] = with_inserts(end) if closed else end
        order = np.argsort(-self.sizes, kind="stable")
        sizes, last = self.sizes[order], last[order]
        ends = self.first[1:][order]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            row, after = ends[:n] - 1 - step, value[last[:n] - step]
            best = np.minimum(2 + after, rewrite[row, None] + after[:, NEXT])
            best = np.minimum(best, keep[row] + np.take_along_axis(after, keep_to[row], 1))
            value[last[:n] - step - 1] = with_inserts(best)
        return np.minimum(value, INF)

    def paths(self, value: np.ndarray):
        """Letter and pointer of the least audit at every node (4 * slot +
        state; letter 0 ends), and the doubled pointers."""
        keep_to, keep, rewrite = self.arcs()
        nodes = np.arange(value.size)
        slot, state = nodes >> 2, nodes & 3
        flat = value.ravel()
        ends = np.zeros(len(value), bool)
        ends[self.slot[1:] - 1] = True
        to = np.tile(nodes[:, None], (1, 4))
        cost = np.full((len(nodes), 4), 2 * INF)
        insert = slot * 4 + NEXT[state]
        to[:, 1], cost[:, 1] = insert, 5 + flat[insert]
        inner = np.flatnonzero(~ends[slot])
        own = np.empty(len(value), np.int64)  # the row that starts at a slot
        own[self.row_slot] = np.arange(len(self.row_slot))
        row, st = own[slot[inner]], state[inner]
        after = (slot[inner] + 1) * 4
        for k, target, price in ((0, after + st, np.full(len(inner), 2)), (2, after + keep_to[row, st], keep[row, st]),
                                 (3, after + NEXT[st], rewrite[row])):
            to[inner, k], cost[inner, k] = target, price + flat[target]
        optimal = (cost == flat[:, None]) & (flat[:, None] < INF)
        # ranks by the first letter; 0 where nothing follows
        letter = np.where(optimal.any(1), optimal.argmax(1) + 1, 0)
        pointer = np.where(letter > 0, to[nodes, np.maximum(letter - 1, 0)], nodes)
        rank, jumps = letter, [pointer]
        longest = 1
        while (rank[jumps[-1]] > 0).any():
            # ranks at twice the length, and pointers twice as far
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[jumps[-1]], return_inverse=True)[1]
            done = np.flatnonzero(letter == 0)
            rank = rank + 1
            rank[done] = 0
            jumps.append(jumps[-1][jumps[-1]])
            longest *= 2
            if longest > 4 * (len(self.initial) + 4):
                raise AssertionError("an optimal path has no cycle")
        pick = np.where(optimal, np.arange(1, 5) * (int(rank.max()) + 1) + rank[to], np.iinfo(np.int64).max).argmin(1)
        chosen = np.where(letter > 0, to[nodes, pick], nodes)
        doubled = [chosen]
        while len(doubled) < len(jumps):
            doubled.append(doubled[-1][doubled[-1]])
        return np.where(letter > 0, pick + 1, 0), chosen, doubled

    def read(self, start_nodes: np.ndarray, letter: np.ndarray, doubled: list) -> list:
        """``(letters, nodes)`` of the path from each start node."""
        count = np.zeros(len(start_nodes), np.int64)
        at = start_nodes.copy()
        for k in reversed(range(len(doubled))):  # the last node that has a letter
            further = letter[doubled[k][at]] > 0
            count[further] += 1 << k
            at[further] = doubled[k][at[further]]
        count += letter[start_nodes] > 0
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        node = np.repeat(start_nodes, count)
        for k, jump in enumerate(doubled):
            move = (nth >> k) & 1 == 1
            node[move] = jump[node[move]]
        cut = np.cumsum(count)[:-1]
        return list(zip(np.split(letter[node], cut), np.split(node, cut)))


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs of the four states when rows may be inserted first."""
    out = cost.copy()
    out[:, U] = np.minimum(cost[:, U], 5 + cost[:, A])
    out[:, A] = np.minimum(cost[:, A], 5 + cost[:, U])
    out[:, NOTHING] = np.minimum(cost[:, NOTHING], 5 + out[:, U])
    out[:, S] = np.minimum(cost[:, S], 5 + out[:, U])
    return out


def faults(role: str, text: str, repeated: bool) -> str:
    bare = text.strip(BLANKS)
    if not bare:
        return "blank"
    return "duplicate" if repeated else "" if bare[-1] in ".!?" else "truncated"


def coded(conversations: list[list[tuple[str, str, str]]]) -> Rows:
    """``Rows`` of lists of (role, text, fault)."""
    flat = [r for c in conversations for r in c]
    first = np.cumsum([0] + [len(c) for c in conversations])
    return Rows(first, np.array([ord(r[0][0]) if r[0] else 0 for r in flat], np.int64),
                np.array([r[2] in ("blank", "duplicate") for r in flat], bool),
                np.array([r[2] == "truncated" for r in flat], bool))


def rewritten(rows, letters, nodes, first_slot: int):
    """``role:text`` of the rows that a path leaves."""
    out, at = [], 0
    for letter, node in zip(letters.tolist(), nodes.tolist()):
        kind = LETTERS[letter - 1]
        if kind == "I":
            out.append(NEW_ROLE[int(NEXT[node & 3])] + ":")
            continue
        role, text = rows[at][:2]
        at += 1
        if kind == "K":
            out.append(f"{role}:{text}")
        elif kind == "R":
            out.append(f"{NEW_ROLE[int(NEXT[node & 3])]}:{text}")
    return out


def adjacent(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def turn_gaps(turns) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def solve(group: list[tuple]) -> pa.RecordBatch:
    """Results of whole conversations: ``(conv_id, turns, roles, texts)`` each."""
    lists = []
    for _, _, roles, texts in group:
        seen, rows = set(), []
        for pair in zip(roles, texts):
            rows.append((*pair, faults(*pair, pair in seen)))
            seen.add(pair)
        lists.append(rows)
    rows = coded(lists)
    value = rows.costs(np.tile(ACCEPT, (len(lists), 1)))
    letter, _, doubled = rows.paths(value)
    out = {f: [] for f in ("conv_id", *FACTS, "audit", "repaired_sha256")}
    starts = rows.slot[:-1] * 4
    for (conv, turns, roles, _), own, (letters, nodes), slot in zip(
            group, lists, rows.read(starts, letter, doubled), rows.slot[:-1].tolist()):
        kinds = [r[2] for r in own]
        repaired = "\n".join(rewritten(own, letters, nodes, slot))
        for name, x in zip(out, (conv, turn_gaps(turns), kinds.count("blank"), kinds.count("duplicate"),
                                 kinds.count("truncated"), adjacent([r[:1] for r in roles]), int(value[slot, 0]),
                                 "".join(LETTERS[k - 1] for k in letters.tolist()),
                                 hashlib.sha256(repaired.encode()).hexdigest())):
            out[name].append(x)
    return _batch(out)


def _batch(out: dict) -> pa.RecordBatch:
    types = dict(conv_id=pa.int64(), audit=pa.string(), repaired_sha256=pa.string(),
                 **{f: pa.int64() for f in FACTS})
    return pa.RecordBatch.from_arrays([pa.array(out[n], types[n]) for n in out], list(out))


def _first_pass(batches):
    """Results of the conversations inside this task's range, and the rows of
    the others (``part`` and ``pos`` keep their order)."""
    part = TaskContext.get().partitionId()
    names = [*(f.split()[0] for f in RESULT.split(", ")), "part", "pos", "turn", "role", "text", "alive"]
    types = [pa.int64()] * (1 + len(FACTS)) + [pa.string()] * 2 + [pa.int32(), pa.int64(), pa.int64(), pa.string(),
                                                                   pa.string(), pa.bool_()]

    def results(group):
        done = solve(group)
        n = done.num_rows
        return pa.RecordBatch.from_arrays(
            done.columns + [pa.nulls(n, t) for t in types[len(done.columns):]], names)

    def passed(conv, rows):
        n = len(rows)
        cols = [pa.array([conv] * n, pa.int64())] + [pa.nulls(n, t) for t in types[1:len(FACTS) + 3]]
        cols += [pa.array([part] * n, pa.int32())]
        cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate(types[len(FACTS) + 4:])]
        return pa.RecordBatch.from_arrays(cols, names)

    conv, rows, pos, outside, done, held = None, [], 0, True, [], 0
    begun = False
    for batch in batches:
        cols = batch.to_pydict()
        for c, turn, role, text, alive in zip(*(cols[n] for n in ("conv_id", "turn", "role", "text", "alive"))):
            if not begun:
                conv, begun = c, True
            if c != conv:
                if outside:
                    yield passed(conv, rows)
                else:
                    living = [r for r in rows if r[4]]
                    done.append((conv, [r[1] for r in living], [r[2] for r in living], [r[3] for r in living]))
                    held += len(rows) + 1
                    if held >= BATCH:
                        yield results(done)
                        done, held = [], 0
                conv, rows, outside = c, [], False
            elif len(rows) >= SPAN:
                yield passed(conv, rows)
                rows, outside = [], True
            rows.append((pos, turn, role, text, alive))
            pos += 1
    if done:
        yield results(done)
    if rows:
        yield passed(conv, rows)


def _piece_rows(table: pa.Table):
    """Living rows of a piece in order, with their faults."""
    rows = sorted(zip(*(table.column(n).to_pylist() for n in ("pos", "turn", "role", "text", "alive", "repeated"))),
                  key=lambda r: r[0])
    living = [r for r in rows if r[4]]
    return living, [(r[2], r[3], faults(r[2], r[3], r[5])) for r in living]


SUMMARY = ("conv_id long, part int, piece long, turns array<long>, counts array<long>, ends array<string>, "
           "table array<long>")


def _summary(key, table):
    """What a piece adds: its turns (least, greatest, distinct, first, last),
    faults, illegal neighbours, first and last initials, and least costs from
    state to state."""
    living, rows = _piece_rows(table)
    known = [r[1] for r in living if r[1] is not None]
    kinds = [r[2] for r in rows]
    initials = [r[0][:1] for r in rows]
    codes = coded([rows] * 4)  # once per end state
    end = np.where(np.eye(4, dtype=bool), 0, INF)
    value = codes.costs(end, closed=False)
    costs = value[codes.slot[:-1]].T  # from state to state
    turns = [min(known), max(known), len(set(known)), known[0], known[-1]] if known else []
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "piece": pa.array([key[2].as_py()], pa.int64()), "turns": pa.array([turns], pa.list_(pa.int64())),
                     "counts": pa.array([[kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                                          adjacent(initials), len(rows)]], pa.list_(pa.int64())),
                     "ends": pa.array([[initials[0], initials[-1]] if rows else []], pa.list_(pa.string())),
                     "table": pa.array([costs.ravel().tolist()], pa.list_(pa.int64()))})


JOINED = "conv_id long, part int, piece long, after array<long>, facts array<long>"


def _join_pieces(key, table):
    """From the last piece back, the costs after each piece; the first one
    also carries the conversation's facts."""
    pieces = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    after = [None] * len(pieces)
    cost = with_inserts(ACCEPT[None, :])[0]
    for i in reversed(range(len(pieces))):
        after[i] = cost.tolist()
        cost = np.minimum((np.array(pieces[i]["table"]).reshape(4, 4) + cost[None, :]).min(1), INF)
    counts = np.zeros(5, np.int64)
    distinct, least, most, last_turn, last = 0, None, None, None, None
    for p in pieces:
        counts += np.array(p["counts"])
        if p["ends"]:
            counts[3] += last is not None and last + p["ends"][0] not in LEGAL
            last = p["ends"][1]
        if p["turns"]:
            low, high, n, first, end = p["turns"]
            distinct += n - (first == last_turn)
            least, most, last_turn = low if least is None else least, high, end
    gaps = most - least + 1 - distinct if least is not None else 0
    facts = [gaps, *counts[:4].tolist(), int(cost[NOTHING])]
    n = len(pieces)
    return pa.table({"conv_id": pa.array([key[0].as_py()] * n, pa.int64()),
                     "part": pa.array([p["part"] for p in pieces], pa.int32()),
                     "piece": pa.array([p["piece"] for p in pieces], pa.int64()),
                     "after": pa.array(after, pa.list_(pa.int64())),
                     "facts": pa.array([facts if i == 0 else None for i in range(n)], pa.list_(pa.int64()))})


STREAM = ("conv_id long, part int, piece long, pos long, role string, text string, paths array<string>, "
          "leaves array<int>, facts array<long>")


def _piece_paths(key, table, joined):
    """A piece's least audit from each state, the state it leaves, and its
    living rows again, for the streaming pass."""
    living, rows = _piece_rows(table)
    after = joined.column("after")[0].as_py()
    codes = coded([rows])
    value = codes.costs(np.array([after]), closed=False)
    # the end belongs to the next piece: no letter there
    letter, _, doubled = codes.paths(value)
    end_nodes = np.arange(4) + 4 * (len(value) - 1)
    letter[end_nodes] = 0
    for jump in doubled:
        jump[end_nodes] = end_nodes
    doubled = [doubled[0]]
    while 1 << len(doubled) <= 3 * len(rows) + 4:
        doubled.append(doubled[-1][doubled[-1]])
    paths, leaves = [], []
    for state, (letters, nodes) in enumerate(codes.read(np.arange(4), letter, doubled)):
        paths.append("".join(LETTERS[k - 1] for k in letters.tolist()))
        leaves.append(int(doubled[0][nodes[-1]] & 3) if len(nodes) else state)
    n = len(living) + 1
    return pa.table({"conv_id": pa.array([key[0].as_py()] * n, pa.int64()),
                     "part": pa.array([key[1].as_py()] * n, pa.int32()),
                     "piece": pa.array([key[2].as_py()] * n, pa.int64()),
                     "pos": pa.array([-1] + [r[0] for r in living], pa.int64()),
                     "role": pa.array([None] + [r[2] for r in living], pa.string()),
                     "text": pa.array([None] + [r[3] for r in living], pa.string()),
                     "paths": pa.array([paths] + [None] * (n - 1), pa.list_(pa.string())),
                     "leaves": pa.array([leaves] + [None] * (n - 1), pa.list_(pa.int32())),
                     "facts": pa.array([joined.column("facts")[0].as_py()] + [None] * (n - 1),
                                       pa.list_(pa.int64()))})


def _last_pass(batches):
    """Streams the pieces in order: the path of the state reached, its rows
    into the hash, nothing of the texts kept."""
    now = None

    class Open:
        def __init__(self, conv, facts):
            self.conv, self.facts, self.hash = conv, facts, hashlib.sha256()
            self.audit, self.state, self.any, self.path, self.at = [], NOTHING, False, "", 0

        def write(self, role, text):
            if self.any:
                self.hash.update(b"\n")
            self.any = True
            self.hash.update(f"{role}:{text}".encode())

        def inserts(self):
            while self.at < len(self.path) and self.path[self.at] == "I":
                self.state = int(NEXT[self.state])
                self.write(NEW_ROLE[self.state], "")
                self.at += 1

        def piece(self, paths):
            self.inserts()
            self.path, self.at = paths[self.state], 0
            self.audit.append(self.path)

        def row(self, role, text):
            self.inserts()
            kind = self.path[self.at]
            self.at += 1
            if kind == "K":
                self.state = KEPT[role[0], self.state]
                self.write(role, text)
            elif kind == "R":
                self.state = int(NEXT[self.state])
                self.write(NEW_ROLE[self.state], text)

        def close(self):
            self.inserts()
            # rows inserted after the last piece
            tail = {NOTHING: "", A: "", U: "I", S: "II"}[self.state]
            self.path, self.at = tail, 0
            self.inserts()
            return _batch(dict(zip(("conv_id", *FACTS, "audit", "repaired_sha256"),
                                   [[x] for x in (self.conv, *self.facts, "".join(self.audit) + tail,
                                                  self.hash.hexdigest())])))

    for batch in batches:
        cols = batch.to_pydict()
        for conv, facts, paths, role, text in zip(*(cols[n] for n in ("conv_id", "facts", "paths", "role", "text"))):
            if facts is not None:
                if now:
                    yield now.close()
                now = Open(conv, facts)
            if paths is not None:
                now.piece(paths)
            else:
                now.row(role, text)
    if now:
        yield now.close()


def repair(conversations: DataFrame, piece_rows: int = SPAN) -> DataFrame:
    """One row per conversation: gaps, faults and illegal neighbours after the
    damage, the least cost, its audit, and the hash of the repaired rows."""
    rows = damage(conversations).withColumn("h", F.xxhash64("role", "text"))
    # the running id only lets a run of equal rows be split
    spread = rows.repartitionByRange("conv_id", "turn", "h", F.monotonically_increasing_id()) \
        .sortWithinPartitions("conv_id", "turn", "h", "role", "text").select("conv_id", "turn", "role", "text", "alive")
    both = stored(spread.mapInArrow(_first_pass, RESULT + ", part int, pos long, turn long, role string, text string, "
                                    "alive boolean"), "conversations")
    inside = both.where("audit is not null").select(*[f.split()[0] for f in RESULT.split(", ")])
    keys = ["conv_id", "part", "piece"]
    same = Window.partitionBy("conv_id", "alive", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("part", "pos")
    outside = both.where("audit is null").select(
        "conv_id", "part", F.floor(F.col("pos") / piece_rows).alias("piece"), "pos", "turn", "role", "text", "alive",
        (F.row_number().over(same) > 1).alias("repeated"))
    pieces = outside.groupBy(*keys)
    joined = pieces.applyInArrow(_summary, SUMMARY).groupBy("conv_id").applyInArrow(_join_pieces, JOINED)
    stream = pieces.cogroup(joined.groupBy(*keys)).applyInArrow(_piece_paths, STREAM)
    last = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "pos") \
        .mapInArrow(_last_pass, RESULT)
    return inside.unionByName(last)
