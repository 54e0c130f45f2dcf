"""Operator 1, toxicity: a support vector machine on a subsequence string kernel
with Nyström landmarks.

Kernel. A word is described by its gapped letter triples: letters at positions
i < j < k with k - i at most ``SPAN``, weighted by ``DECAY`` for every position
skipped; characters that are not letters are gaps. The kernel of two words is
the cosine of these vectors, so inserted characters and gaps lower it a little
instead of breaking the match. Runs of single letters (``i d i o t``) are read as
one word.

Sentences. A text is cut into sentences; the kernel of a sentence and a landmark
word is the highest of its words (values below ``floor`` count as 0), and the
landmarks' own kernel matrix turns these rows into Nyström features.

Training. Landmarks are the words that labelled texts associate with toxicity
most (counted in Spark over the labelled sample) and common words as
background. A linear squared-hinge machine is trained on labelled sentences:
those of clean texts are negative, and of each toxic text the sentence that
scores highest is positive (a few alternations). A text scores by its two
highest sentences, mapped to a probability by a logistic fit.

The labelled sample is bounded by ``max_labelled`` rows drawn by a hash of the
id, and by ``max_sentences`` sentences of each of these (those with the
highest kernel values). Scoring reads every whole text, without a shuffle.

Cases: null and empty text have no sentence and get the score of a text without
any landmark; with no labelled rows of both classes every score is the share
of toxic labels (0 without labels); repeated rows score alike; extra columns
are ignored; an empty table gives an empty result."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import arrays as A

SPAN, DECAY, LONG = 4, 0.6, 32
PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: letters of the basic Latin alphabet are 1-26, all others share 27-62
GAP, SPACE, END = 0, 254, 255


def _letter_classes() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for cp in range(len(table)):
        ch = chr(cp)
        if "a" <= ch <= "z":
            table[cp] = cp - 96
        elif ch.isalpha():
            table[cp] = 27 + cp % 36
        elif ch.isspace():
            table[cp] = SPACE
    for ch in ".!?\n":
        table[ord(ch)] = END
    return table


CLASSES = _letter_classes()


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts in one array, and each text's offsets."""
    prepared = []
    for t in texts:
        t = (t or "").lower()
        prepared.append(SINGLES.sub(lambda m: re.sub(r"\s", "", m[0]), t))
    cp = np.frombuffer("".join(prepared).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in prepared]))).astype(np.int64)
    c = CLASSES[np.minimum(cp, len(CLASSES) - 1)]
    # a mark within a word (``mo.ron``) is a gap; before white space it ends a sentence
    within = np.flatnonzero((c[:-1] == END) & (c[1:] < SPACE))
    c[within[cp[within] != 10]] = GAP
    far = cp >= len(CLASSES)
    c[far] = 27 + cp[far] % 36
    return c, offsets


def units(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as (start, end, text, sentence); longer ones than ``LONG`` are
    read in overlapping parts, so their size stays bounded. A sentence ends at
    a sentence mark or at the end of a text."""
    brk = c >= SPACE
    inside = ~brk
    before = np.concatenate(([False], inside[:-1])) if len(c) else inside
    first = offsets[:-1][offsets[:-1] < len(c)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) if len(c) else inside
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    wide = np.flatnonzero(ends - starts > LONG)
    if len(wide):
        more = [np.arange(starts[w], ends[w] - LONG // 2, LONG // 2) for w in wide]
        cut_starts = np.concatenate(more)
        cut_ends = np.minimum(cut_starts + LONG, np.repeat(ends[wide], [len(m) for m in more]))
        keep = np.ones(len(starts), bool)
        keep[wide] = False
        starts, ends = np.concatenate((starts[keep], cut_starts)), np.concatenate((ends[keep], cut_ends))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    text = np.searchsorted(offsets, starts, side="right") - 1
    marks = np.cumsum(c == END) if len(c) else np.zeros(0, np.int64)
    sentence = (marks[starts] if len(starts) else marks[:0]) + text
    return starts, ends, text, sentence


def triples(c: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Gapped triples of the words: (word, code, weight), summed per code."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    x = c[at].astype(np.int64)
    words, codes, weights = [], [], []
    for a, b in PAIRS:
        if len(x) <= b:
            continue
        i, j, k = x[:-b], x[a:len(x) - b + a], x[b:]
        ok = np.flatnonzero((word[:-b] == word[b:]) & (i > 0) & (j > 0) & (k > 0))
        words.append(word[ok])
        codes.append((i[ok] << 12) | (j[ok] << 6) | k[ok])
        weights.append(np.full(len(ok), DECAY ** (b - 2)))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = (np.concatenate(words) << 18) | np.concatenate(codes)
    weight = np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, new) if len(new) else weight
    return key[new] >> 18, key[new] & ((1 << 18) - 1), total


class Landmarks:
    """Kernel rows against a fixed set of words."""

    def __init__(self, words: list[str], floor: float):
        self.floor, self.m = floor, len(words)
        c, offsets = classes([w.replace(" ", "") for w in words])
        w, code, value = triples(c, offsets[:-1], offsets[1:])
        norm = np.sqrt(np.bincount(w, value * value, minlength=self.m))
        value = value / norm[w]
        order = np.argsort(code, kind="stable")
        self.by_code, self.landmark, self.value = code[order], w[order], value[order]
        self.matrix = np.eye(self.m)
        row = np.zeros((1 << 18) + 1, np.int64)
        np.add.at(row, self.by_code + 1, 1)
        self.row = np.cumsum(row)
        self.matrix = self._rows(c, offsets[:-1], offsets[1:])[0]

    def _rows(self, c, starts, ends):
        """(dense kernel rows of words, words that have one)."""
        w, code, value = triples(c, starts, ends)
        n = len(starts)
        square = np.bincount(w, value * value, minlength=n)
        n_hits = self.row[code + 1] - self.row[code]
        hit = n_hits > 0
        # a word whose triples are mostly foreign to all landmarks stays below the floor
        known = np.bincount(w[hit], value[hit] ** 2, minlength=n)
        able = known >= self.floor ** 2 * square - 1e-12
        hit &= able[w]
        w, code, value, n_hits = w[hit], code[hit], value[hit], n_hits[hit]
        each = np.repeat(np.arange(len(w)), n_hits)
        at = np.arange(len(each)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + self.row[code][each]
        active, index = np.unique(w, return_inverse=True)
        dense = np.bincount(index[each] * self.m + self.landmark[at], value[each] * self.value[at],
                            minlength=len(active) * self.m).astype(float).reshape(len(active), self.m)
        dense /= np.sqrt(square[active])[:, None]
        return dense, active

    def sentences(self, texts: list[str]):
        """Kernel rows of the sentences with a value of at least the floor:
        (text, row)."""
        c, offsets = classes(texts)
        starts, ends, text, sentence = units(c, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros((0, self.m))
        h = A.word_hashes(c, starts, ends)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        dense, active = self._rows(c, starts[first], ends[first])
        dense[dense < self.floor] = 0.0
        some = dense.any(axis=1)
        dense, active = dense[some], active[some]
        place = np.full(len(first), -1)
        place[active] = np.arange(len(active))
        at = place[inverse]
        use = np.flatnonzero(at >= 0)
        if not len(use):
            return np.zeros(0, np.int64), np.zeros((0, self.m))
        new = np.flatnonzero(np.concatenate(([True], np.diff(sentence[use]) != 0)))
        return text[use[new]], np.maximum.reduceat(dense[at[use]], new, axis=0)


def association(labelled: DataFrame, text_col: str) -> DataFrame:
    """``(word, toxic, clean)``: texts of either label that hold a word."""
    def run(batches):
        for b in batches:
            words, toxic = [], []
            for text, y in zip(b.column(0), b.column(1)):
                own = {w for w in re.split(r"[\W\d_]+", (text.as_py() or "").lower()) if 3 <= len(w) <= LONG}
                words += own
                toxic += [y.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    return labelled.select(F.col(text_col).cast("string"), F.col("toxic").cast("int")) \
        .mapInArrow(run, "word string, toxic int").groupBy("word") \
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0) -> np.ndarray:
    """Primal linear machine (last column of ``x`` is 1), by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(v):
        return 0.5 * float((ridge * v * v).sum()) + c * float((weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    for _ in range(50):
        short = 1 - y * (x @ w)
        on = short > 0
        grad = ridge * w - 2 * c * (x[on].T @ (weight[on] * y[on] * short[on]))
        hess = np.diag(ridge) + 2 * c * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic map of margins (last column of ``x`` is 1) to a probability."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    v = np.zeros(x.shape[1])
    for _ in range(100):
        p = probability(x, v)
        hess = (x.T * (p * (1 - p))) @ x + 1e-4 * np.eye(len(v))
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-4 * v)
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return v


def probability(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))


def two_highest(text: np.ndarray, margin: np.ndarray, n: int, lowest: float) -> np.ndarray:
    """Per text the margins of its two highest sentences (``lowest`` where
    there is none), and 1."""
    out = np.full((n, 3), lowest)
    out[:, 2] = 1.0
    order = np.lexsort((-margin, text))
    text, margin = text[order], margin[order]
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else text
    out[text[first], 0] = margin[first]
    second = first + 1
    second = second[(second < len(text))]
    second = second[text[second] == text[second - 1]]
    out[text[second], 1] = margin[second]
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        max_labelled: int = 8_000, toxic_landmarks: int = 64, common_landmarks: int = 32, floor: float = 0.7,
        max_sentences: int = 12, rounds: int = 4) -> dict:
    """The model from ``labels`` (``id_col``, ``toxic`` 0/1; other values are
    left out, and of repeated labels the highest counts) and their texts.

    Labels are drawn before the join, so about ``max_labelled`` rows are
    broadcast and the documents stay where they are."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not size["n"] or size["toxic"] in (0, size["n"]):
        return {"prior": float(size["toxic"] / size["n"]) if size["n"] else 0.0}
    share = min(1.0, max_labelled / size["n"])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000))
    drawn = known.where(draw < int(share * 1_000_000))
    sample = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(drawn), id_col).select(F.col(id_col).cast("string").alias("id"), "text", "toxic")
    totals = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    n_toxic, n_clean = float(totals["t"] or 0), float(totals["c"] or 0)
    words = association(sample, "text")
    odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("clean") + 0.1) / (n_clean + 0.2))
    scored = words.select("word", "clean", (F.col("toxic") * odds).alias("s"))
    marked = [r["word"] for r in scored.where("s > 0").orderBy(F.desc("s"), "word").limit(toxic_landmarks).collect()]
    common = [r["word"] for r in scored.where(F.length("word") >= 4).orderBy(F.desc("clean"), "word")
              .limit(common_landmarks + toxic_landmarks).collect()]
    chosen = marked + [w for w in common if w not in set(marked)][:common_landmarks]
    # a landmark needs a triple
    chosen = [w for w in chosen if len(w) >= 3]
    if not chosen:
        return {"prior": float(size["toxic"] / size["n"])}

    def run(batches):
        marks = Landmarks(chosen, floor)
        for b in batches:
            ids, y, x = [], [], []
            for i in range(b.num_rows):
                _, k = marks.sentences([b.column(1)[i].as_py()])
                k = k[np.argsort(-k.max(axis=1), kind="stable")[:max_sentences]] if len(k) else k
                ids.append(b.column(0)[i].as_py())
                y.append(b.column(2)[i].as_py())
                x.append(k.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(y, pa.int32()),
                                              pa.array(x, pa.binary())], ["id", "toxic", "x"])

    got = sample.select("id", "text", "toxic").mapInArrow(run, "id string, toxic int, x binary").collect()
    got.sort(key=lambda r: (r["id"] or "", r["x"]))
    marks = Landmarks(chosen, floor)
    values, vectors = np.linalg.eigh(marks.matrix)
    keep = values > 1e-6
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    doc, rows_x = [], []
    for i, r in enumerate(got):
        k = np.frombuffer(r["x"], "<f4").reshape(-1, len(chosen))
        k = k if len(k) else np.zeros((1, len(chosen)))
        doc += [i] * len(k)
        rows_x.append(k @ nystrom)
    x = np.concatenate(rows_x)
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    doc, y = np.array(doc), np.array([r["toxic"] for r in got])
    start = np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0)))
    # the first witness of a toxic text: its sentence nearest to a landmark of toxicity
    near = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, len(chosen))[:, :len(marked)].max(axis=1)
                           if r["x"] else np.zeros(1) for r in got])
    rank = near
    for _ in range(rounds):
        witness = np.zeros(len(x), bool)
        for a, b in zip(start, np.append(start[1:], len(x))):
            if y[doc[a]] == 1:
                witness[a + int(np.argmax(rank[a:b]))] = True
        use = witness | (y[doc] == 0)
        target = np.where(witness[use], 1.0, -1.0)
        weight = np.where(target > 0, 1.0 / max(1, (target > 0).sum()), 1.0 / max(1, (target < 0).sum())) * len(got) / 100
        w = squared_hinge(x[use], target, weight)
        rank = x @ w
    bias = float(w[-1])
    return {"prior": float(size["toxic"] / size["n"]), "landmarks": chosen, "floor": floor, "weights": nystrom @ w[:-1],
            "bias": bias, "map": logistic(two_highest(doc, rank, len(got), bias), y)}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None,
          block_chars: int = 1 << 20) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``score``, the probability of
    toxicity, and ``predicted``; existing columns of these names are replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "__text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    given = docs.select(*names, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        marks = Landmarks(model["landmarks"], model["floor"]) if "landmarks" in model else None
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            p = np.full(len(texts), model["prior"])
            if marks is not None:
                sizes = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
                for lo, hi in A.row_blocks(sizes, block_chars):
                    text, k = marks.sentences(texts[lo:hi])
                    f = two_highest(text, k @ model["weights"] + model["bias"], hi - lo, model["bias"])
                    p[lo:hi] = probability(f, model["map"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()),
                                              pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                                             [*names, "score", "predicted"])

    return given.mapInArrow(run, f"{fields}, score double, predicted int")
