"""Operator 11, fill-in-middle transformation by SWAR words.

Every text is cut into units (code points), and two cut points drawn from the
document's id split it into prefix, middle and suffix. The cut points are
found on the UTF-8 bytes, without decoding them:

* the bytes are viewed as 64-bit words of eight bytes,
* a byte that ends a unit is one whose next byte does not have the form
  ``10xxxxxx``; shifts and masks mark these bytes of a word at once,
* ``numpy.bitwise_count`` counts the marks of each word, and their running
  sum, searched for the unit's number, gives the word that holds it,
* inside the word the lowest mark is cleared until the wanted one is the
  lowest; the bits below it give the byte.

The draws ``h1..h4`` are the first four 8-digit groups, as unsigned integers, of the SHA-256 of
``1:`` and the id. Prefix and middle end after ``h1 % (n + 1)`` and
``h2 % (n + 1)`` units, the smaller first. A text is left plain if it is
empty, contains a marker, or ``h3 % 100 >= 100 - plain_percent``; otherwise it has the form spm
if ``h4 % 100 < spm_percent``, else psm.

Cases: null text is empty (plain, no unit); a null id draws as an empty id;
rows are independent, so ties and repeated rows give equal results; extra
columns are ignored; an empty table gives an empty result; long texts are
handled whole, a few megabytes of texts at a time (a longer one alone)."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import arrays as A

RESULT = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
          "output_sha256 string, restored_sha256 string, output string")
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
HIGH = np.uint64(0x8080808080808080)
ONE = np.uint64(1)
BLOCK_BYTES = 4 << 20


class Units:
    """Rank and select of the unit-ending bytes of a UTF-8 buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8")
        # bit 7 of a byte that begins a unit: not (bit 7 set and bit 6 clear)
        begins = ~(words & ~(words << ONE)) & HIGH
        # a byte ends a unit if the next one begins a unit
        self.ends = begins >> np.uint64(8)
        self.ends[:-1] |= begins[1:] << np.uint64(56)
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte ``at``."""
        word = at >> 3
        below = (ONE << ((at & 7) << 3).astype(np.uint64)) - ONE
        before = np.where(word > 0, self.upto[np.maximum(word - 1, 0)], 0)
        return before + np.bitwise_count(self.ends[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte after the ``nth`` unit (from 1)."""
        word = np.searchsorted(self.upto, nth, side="left")
        marks = self.ends[word].copy()
        left = nth - np.where(word > 0, self.upto[np.maximum(word - 1, 0)], 0)
        for k in range(1, 8):
            more = left > k
            marks[more] &= marks[more] - ONE
        lowest = marks & (~marks + ONE)
        return word * 8 + (np.bitwise_count(lowest - ONE) >> 3).astype(np.int64) + 1


def arrange(text: bytes, a: int, b: int, form: str) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    if form == "spm":
        return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text of an output: it holds each marker once, as texts that contain
    one stay plain and markers cannot overlap."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX, 3)
    third = output.index(MIDDLE, second)
    one, two, middle = output[3:second], output[second + 3:third], output[third + 3:]
    return one + middle + two if form == "psm" else two + middle + one


def draws(id_col: str) -> list:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10,
                   spm_percent: int = 20, with_text: bool = True) -> DataFrame:
    """One row per document: units, form, lengths of prefix and middle (null
    if plain), the hashes of the output and of the text rebuilt from it, and
    the output itself (null unless ``with_text``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *draws(id_col))

    def transform(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            ids = batch.column("doc_id")
            for lo, hi in A.row_blocks(offsets, BLOCK_BYTES):
                own = data[offsets[lo]:offsets[hi]]
                at = offsets[lo:hi + 1] - offsets[lo]
                units = Units(own)
                rank = units.rank(at)
                n = np.diff(rank)
                one, two = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
                cuts = []
                for unit in (np.minimum(one, two), np.maximum(one, two)):
                    inside = unit > 0
                    cut = at[:-1].copy()
                    cut[inside] = units.select(rank[:-1][inside] + unit[inside])
                    cuts.append((unit.tolist(), (cut - at[:-1]).tolist()))
                plain = h[2][lo:hi] % 100 >= 100 - plain_percent
                spm = h[3][lo:hi] % 100 < spm_percent
                raw = own.tobytes()
                out = {k: [] for k in ("form", "prefix", "middle", "sha", "restored", "text")}
                for i, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    text = raw[start:end]
                    form = "spm" if spm[i] else "psm"
                    if plain[i] or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        form = "plain"
                    output = arrange(text, cuts[0][1][i], cuts[1][1][i], form)
                    out["form"].append(form)
                    out["prefix"].append(None if form == "plain" else cuts[0][0][i])
                    out["middle"].append(None if form == "plain" else cuts[1][0][i] - cuts[0][0][i])
                    out["sha"].append(hashlib.sha256(output).hexdigest())
                    out["restored"].append(hashlib.sha256(restore(output, form)).hexdigest())
                    out["text"].append(output if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(out["form"], pa.string()),
                     pa.array(out["prefix"], pa.int64()), pa.array(out["middle"], pa.int64()),
                     pa.array(out["sha"], pa.string()), pa.array(out["restored"], pa.string()),
                     pa.array(out["text"], pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
                     "output"])

    return rows.mapInArrow(transform, RESULT)
