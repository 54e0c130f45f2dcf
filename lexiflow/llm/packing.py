"""Operator 5, mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. Each window (sequence) of ``size`` tokens
credits every queue with its share, takes whole tokens from the queues in
turn, and carries the difference as a deficit into the next window.

Scale: the queues' totals alone fix what every window takes, so no document
moves. Windows form partitions of ``block_windows``; what each queue has given
before a partition is known in closed form (its exact share, rounded to a whole token), and the
fraction left by the rounding is the deficit carried into the partition. Inside it the round-robin runs
window by window. A task then cuts its own documents: the position of a
document in its queue is the total of earlier tasks (a small table of tasks and
queues) plus the tokens before it in its task.

Default mixture: the corpus's own proportions, so all queues end together and
every window but the last is full. With ``mixture`` (source: weight) the shares
hold until a queue is empty; its share then goes to the others in proportion,
and sources not named follow when the named ones are empty.

Cases: null text is empty (one piece with id ``end_id``); a null source is a
queue of its own; repeated rows are separate documents; a null id is kept; the
smallest sources beyond ``max_queues`` share one queue; an empty table gives an
empty result; extra columns are ignored."""
from __future__ import annotations

import os
import zlib
from array import array
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiflow.llm.common import stored

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, source string, ids array<int>")


TAIL = b".,!?;:%#$&*|"
#: Tokens of a batch of pieces, which bounds a task's memory.
PIECE_TOKENS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of words, found when first asked for.

    The tokenizer replaces white space by one space and no token spans it, so
    a text's ids are those of its words. It also cuts a word between a letter
    or digit and punctuation, and ignores case: closing punctuation, the word
    before it and its lower-case form are words of their own here. A word of
    Latin letters, which the tokenizer leaves whole, goes straight to its BPE model."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __missing__(self, word: bytes) -> bytes:
        ids = self._find(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def _find(self, word: bytes) -> bytes:
        if b"<|" in word:  # may be a special token, which is matched as written
            return self._encoded(word)
        core = word.rstrip(TAIL)
        if core and len(core) < len(word):
            last = core.decode()[-1]
            # a capital I with a dot becomes a letter and a mark, which joins the punctuation
            if last.isalnum() and last != "\u0130":
                return self[core.lower()] + self[word[len(core):]]
        low = word.lower()
        if low != word:
            return self[low]
        if word.isalpha():  # ASCII letters in lower case
            spelled = word.decode()
        else:
            text = word.decode()
            if not (text.isalpha() and max(text) < "\u0250" and "\u0130" not in text):
                return self._encoded(word)
            spelled = text.lower().encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _encoded(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()


def word_encoder(path: str, cache_words: int = 300_000):
    """``encode(text) -> bytes`` of little-endian unsigned 32-bit ids."""
    known = _Words(path, cache_words).__getitem__

    def encode(text: str) -> bytes:
        return b"".join(map(known, text.encode().split()))

    return encode


class Schedule:
    """What every window takes from every queue, from the queues' totals."""

    def __init__(self, totals: list[int], weights: list[float] | None, size: int, block_windows: int, quantum: int):
        self.totals, self.size, self.windows, self.quantum = totals, size, block_windows, quantum
        self.total = sum(totals)
        self.step = size * block_windows
        self.phases = self._phases(weights)
        self.blocks = max(1, self.total // self.step)  # the last one also has the rest
        slowest = [min((p[2][s] for p in self.phases if p[2][s]), default=Fraction(0)) for s in range(len(totals))]
        #: queues that may give less than a token per partition
        self.tiny = [r * self.step < 1 for r in slowest]
        self.base = lru_cache(1 << 14)(self._base)
        self.block = lru_cache(64)(self._block)

    def _phases(self, weights):
        """(first token, given so far, rate per token) from one queue's end to the next."""
        n = len(self.totals)
        left, given, at, out = [Fraction(t) for t in self.totals], [Fraction(0)] * n, Fraction(0), []
        named = [Fraction(w).limit_denominator(10 ** 9) if w else Fraction(0) for w in weights] if weights else [Fraction(0)] * n
        while any(left):
            w = [named[s] if left[s] else Fraction(0) for s in range(n)]
            if not any(w):
                w = [Fraction(self.totals[s]) if left[s] else Fraction(0) for s in range(n)]
            whole = sum(w)
            rate = [x / whole for x in w]
            out.append((at, list(given), rate))
            span = min(left[s] / rate[s] for s in range(n) if rate[s])
            for s in range(n):
                left[s] -= rate[s] * span
                given[s] += rate[s] * span
            at += span
        return out

    def quota(self, t: int) -> list[Fraction]:
        """Exact share of each queue in the first ``t`` tokens."""
        at, given, rate = next(p for p in reversed(self.phases) if p[0] <= t)
        return [g + r * (t - at) for g, r in zip(given, rate)]

    def _base(self, b: int) -> list[int]:
        """Tokens each queue has given before partition ``b`` of windows.

        Shares are rounded cumulatively over the queues, so they sum to the
        windows' tokens and each is within one token of its exact share. Tiny
        queues are rounded down, and the others take their fractions."""
        if b >= self.blocks:
            return list(self.totals)
        t = b * self.step
        share = self.quota(t)
        rate = next(p for p in reversed(self.phases) if p[0] <= t)[2]
        large = sum(r for r, tiny in zip(rate, self.tiny) if not tiny)
        carry = sum(q - int(q) for q, tiny in zip(share, self.tiny) if tiny)
        out, whole, given = [], Fraction(0), 0
        for q, r, tiny in zip(share, rate, self.tiny):
            if tiny:
                out.append(int(q))
                continue
            whole += q + carry * r / large
            out.append(int(whole) - given)
            given = int(whole)
        return out

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Per window of the partition: given before it (windows + 1 rows), and
        the offset of each queue's tokens in it."""
        start, end = np.array(self.base(b), np.int64), np.array(self.base(b + 1), np.int64)
        n, t0 = len(start), b * self.step
        count = -(-int((end - start).sum()) // self.size)
        inside = any(t0 < p[0] < t0 + count * self.size for p in self.phases)
        q0 = self.quota(min(t0, self.total - 1))
        credit0 = np.array([float(q - int(s)) for q, s in zip(q0, start)])
        rate = np.array([float(r) for r in next(p for p in reversed(self.phases) if p[0] <= t0)[2]])
        given = np.zeros((count + 1, n), np.int64)
        offset = np.zeros((count, n), np.int64)
        for w in range(count):
            t = min((w + 1) * self.size, self.total - t0)
            due = np.array([float(q - int(s)) for q, s in zip(self.quota(t0 + t), start)]) if inside else credit0 + rate * t
            credit = due - given[w]
            left = end - start - given[w]
            room = min(self.size, int(left.sum()))
            take = np.minimum(np.maximum(np.floor(credit + 1e-9), 0).astype(np.int64), left)
            take[(take < self.quantum) & (take < left)] = 0
            turn = (np.arange(n) + w) % n  # the round starts one queue further each window
            ranked = turn[np.argsort(-credit[turn], kind="stable")]
            for s in ranked:
                take[s] = min(take[s], room)
                room -= take[s]
            if room:  # borrowed from the queues with the largest credit left
                for s in ranked[np.argsort(-(credit - take)[ranked], kind="stable")]:
                    more = min(room, left[s] - take[s])
                    take[s] += more
                    room -= more
                    if not room:
                        break
            offset[w, turn] = np.cumsum(take[turn]) - take[turn]
            given[w + 1] = given[w] + take
        return start + given, offset

    def find(self, queue: int, position: int, hint: int) -> int:
        """The partition of windows that holds a queue's token."""
        if self.base(hint)[queue] <= position < self.base(hint + 1)[queue]:
            return hint
        lo, hi = 0, self.blocks
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.base(mid)[queue] <= position else (lo, mid)
        return lo

    def pieces(self, queue: int, position: int, length: int, hint: int = 0):
        """(start in the document, length, sequence, offset) of a document."""
        done = 0
        while done < length:
            hint = self.find(queue, position + done, hint)
            given, offset = self.block(hint)
            own = given[:, queue]
            w = int(np.searchsorted(own, position + done, side="right")) - 1
            while done < length and w < len(offset):
                cut = min(length - done, int(own[w + 1]) - position - done)
                if cut > 0:
                    yield done, cut, hint * self.windows + w, int(offset[w, queue]) + position + done - int(own[w]), hint
                    done += cut
                w += 1


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, queues: list[str | None], id_col: str, text_col: str,
              source_col: str) -> DataFrame:
    """``(doc_id, source, queue, part, before, n, ids)``: the ids of every
    document, and the tokens of its queue before it in its task."""
    index = {s: i for i, s in enumerate(queues)}
    rest = len(queues)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = word_encoder(tokenizer)
        part, given = TaskContext.get().partitionId(), {}
        for b in batches:
            queue, before, n, ids = [], [], [], []
            for text, source in zip(b.column(1), b.column(2)):
                own = encode(text.as_py() or "") + last
                q = index.get(source.as_py(), rest)
                queue.append(q)
                before.append(given.get(q, 0))
                n.append(len(own) // 4)
                ids.append(own)
                given[q] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(queue, pa.int32()), pa.array([part] * len(n), pa.int32()),
                 pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "queue", "part", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, queue int, part int, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, mixture: dict[str, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_windows: int = 256,
         quantum: int = 64, max_queues: int = 512, with_ids: bool = True,
         broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per piece of a document; ``ids`` holds its ids if ``with_ids``."""
    seen = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "s").limit(max_queues - 1).collect()
    queues = [r["s"] for r in seen]
    rows = stored(tokenized(docs, tokenizer, end_id, queues, id_col, text_col, source_col), "tokens")
    parts = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    totals = [0] * (len(queues) + 1)
    for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # at most max_queues rows
        totals[r["queue"]] = r["n"]
    if mixture and min(mixture.values()) < 1e-5 * sum(mixture.values()):
        raise ValueError("a weight of the mixture must be 1e-5 of their sum at least")
    weights = None if mixture is None else [mixture.get(s, 0.0) if s is not None else 0.0 for s in queues] + [0.0]
    earlier = parts.select("part", "queue", (F.sum("n").over(
        Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("earlier"))
    if earlier.count() <= broadcast_rows:  # one row per task and queue; beyond it, a shuffled join
        earlier = F.broadcast(earlier)
    placed = rows.join(earlier, ["part", "queue"])
    args = (totals, weights, size, block_windows, quantum)

    def batch_of(columns):
        types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def cut(batches):
        plan = Schedule(*args)
        hints: dict[int, int] = {}
        for b in batches:
            out, held = [[] for _ in range(9)], 0
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                queue, n = col["queue"][i].as_py(), col["n"][i].as_py()
                data = memoryview(col["ids"][i].as_buffer())
                doc, source = col["doc_id"][i].as_py(), col["source"][i].as_py()
                at = col["earlier"][i].as_py() + col["before"][i].as_py()
                for start, length, seq, offset, hint in plan.pieces(queue, at, n, hints.get(queue, 0)):
                    hints[queue] = hint
                    own = data[4 * start:4 * (start + length)]
                    ids = np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None
                    for c, v in zip(out, (doc, start, length, zlib.crc32(own), n, seq, offset, source, ids)):
                        c.append(v)
                    held += length
                    if held >= PIECE_TOKENS:
                        yield batch_of(out)
                        out, held = [[] for _ in range(9)], 0
            yield batch_of(out)

    return placed.select("doc_id", "source", "queue", "n", "before", "earlier", "ids").mapInArrow(cut, PIECES)
