"""Counts of n-grams and of neighbouring words, made a piece of documents at a time.

A task numbers the words of a piece, codes an n-gram (or a pair) as one number and counts
equal numbers by sorting; texts are built once for each that differs. What a
task passes on is one row per n-gram and piece, and Spark adds those up. A
piece ends with a document, so documents are counted exactly."""
from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the tasks get these functions by value: no installation on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Codes a task sorts at once (more only if one document has more), and rows of a batch passed on. A
#: Python worker holds some 200 bytes a code; what the pieces of a task have in common Spark adds up
#: before the shuffle.
PIECE_CODES = 500_000
BATCH_ROWS = 50_000
SCHEMA = "term string, n long, nb_docs long"
#: Bits of a filter (4 MB), of one bitmap of Spark's (4 KB), and the factor of a word sequence's hash.
FILTER_BITS = 1 << 25
BITMAP_BITS = 1 << 15
FACTOR = 1_000_003


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and their documents' sizes, of whole documents with about ``most`` words."""
    held, n = [], 0
    for batch in batches:
        lists = batch.column(0)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        begin = np.cumsum(sizes) - sizes
        cuts = np.flatnonzero(np.diff(begin // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
            if a == b:
                continue
            size = int(sizes[a:b].sum())
            held.append((words.slice(int(begin[a]), size), sizes[a:b]))
            n += size
            if n >= most:
                yield pa.concat_arrays([w for w, _ in held]), np.concatenate([s for _, s in held])
                held, n = [], 0
    if n:
        yield pa.concat_arrays([w for w, _ in held]), np.concatenate([s for _, s in held])


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in their order (a null last), and the place of every word there."""
    coded = words.dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _runs(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code in rising order: a place, how often it is there, in how many
    documents. ``doc`` never falls."""
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    start = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    return order[start], np.diff(np.append(start, len(code))), np.add.reduceat(new.astype(np.int64), start)


def _batches(term: Callable[[slice], pa.Array], n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``term`` gives the texts of some of the rows: a batch's are built when it leaves."""
    for lo in range(0, len(n), BATCH_ROWS):
        some = slice(lo, lo + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([term(some).cast(pa.string()), pa.array(n[some], pa.int64()),
                                          pa.array(docs[some], pa.int64())], ["term", "n", "nb_docs"])


def _joined_words(words: Sequence[pa.Array], sep: str) -> pa.Array:
    """As ``concat_ws``: nulls are left out."""
    if len(words) == 1:
        return words[0]
    none = words[0].is_null()
    for w in words[1:]:
        none = pc.and_(none, w.is_null())
    # the kernel loses a row of nothing but nulls
    first = pc.if_else(none, "", words[0]) if pc.any(none).as_py() else words[0]
    return pc.binary_join_element_wise(first, *words[1:], sep, null_handling="skip")


def _sequences(known: pa.Array, code: np.ndarray, first: np.ndarray, k: int, sep: str) -> pa.Array:
    """The texts of ``k`` words from each of the places ``first`` on."""
    return _joined_words([known.take(pa.array(code[first + j])) for j in range(k)], sep)


def _grams_of_piece(words: pa.Array, sizes: np.ndarray, lengths: Sequence[int], sep: str) -> Iterator[pa.RecordBatch]:
    known, code = _numbered(words)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # words from here to the document's end
    # a word that holds the separator, or is null: different words may give one text
    odd = pc.fill_null(pc.match_substring(known, sep), True).to_numpy(zero_copy_only=False)
    plain = np.ones(len(sizes), bool)
    plain[doc[odd[code]]] = False
    base = max(2, len(known))
    for k in lengths:
        at = np.flatnonzero((left >= k) & plain[doc])
        if not len(at):
            continue
        value, top = code[at], base
        for j in range(1, k):
            if top * base >= 1 << 62:
                distinct, value = np.unique(value, return_inverse=True)
                top = len(distinct)
            value, top = value * base + code[at + j], top * base
        place, n, docs = _runs(value, doc[at])
        first = at[place]
        del at, value, place
        yield from _batches(lambda some: _sequences(known, code, first[some], k, sep), n, docs)
    if not plain.all():
        texts, owner = [], []
        for k in lengths:
            at = np.flatnonzero((left >= k) & ~plain[doc])
            texts.append(_joined_words([known.take(pa.array(code[at + j])) for j in range(k)], sep))
            owner.append(doc[at])
        text, owner = pa.concat_arrays([t.cast(pa.string()) for t in texts]), np.concatenate(owner)
        real = text.is_valid().to_numpy(zero_copy_only=False)
        text, owner = text.filter(pa.array(real)), owner[real]
        if len(text):
            order = np.argsort(owner, kind="stable")
            known, code = _numbered(text)
            place, n, docs = _runs(code[order], owner[order])
            place = code[order][place]
            yield from _batches(lambda some: known.take(pa.array(place[some])), n, docs)


def _word_hashes(known: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w.as_py() or b"") for w in known.cast(pa.binary())], np.int64) % FILTER_BITS


def filter_of(sequences: DataFrame, words: str) -> np.ndarray:
    """A bitmap of the word sequences in the array column ``words``, of a fixed size: what is
    in it may be among them, what is not is none of them. Never a result alone."""
    def step(a: Column, w: Column) -> Column:
        return F.pmod(a * FACTOR + F.pmod(F.crc32(w.cast("binary")), F.lit(FILTER_BITS)), F.lit(FILTER_BITS))
    place = sequences.select(F.aggregate(words, F.lit(0).cast("bigint"), step).alias("h")).where("h is not null")
    rows = place.groupBy(F.bitmap_bucket_number("h").alias("no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()  # FILTER_BITS / BITMAP_BITS rows at most
    out = np.zeros(FILTER_BITS + BITMAP_BITS, bool)
    for r in rows:
        # the first bucket of bitmap_bucket_number holds 1 to BITMAP_BITS, the one before holds 0
        at = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        out[(r.no - 1) * BITMAP_BITS + at + 1 if r.no > 0 else r.no * BITMAP_BITS - at] = True
    return np.packbits(out[:FILTER_BITS])


def _passed(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _pairs_of_piece(words: pa.Array, sizes: np.ndarray, window: int, sep: str,
                    bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    known, code = _numbered(words)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    base = len(known)
    if known.null_count:  # sorted last
        base -= 1
    if bits is not None:  # words that take no part
        code = np.where(_passed(bits, _word_hashes(known))[code], code, base)
    padded = np.append(code, np.full(window, base))
    # row by row, so that documents keep their order
    other = np.lib.stride_tricks.sliding_window_view(padded, window + 1)[:len(code), 1:]
    near = (left[:, None] > np.arange(1, window + 1)) & (other != code[:, None]) & (other < base) & (code < base)[:, None]
    at, step = np.nonzero(near)
    if not len(at):
        return
    one, two = code[at], other[at, step]
    value = np.minimum(one, two) * base + np.maximum(one, two)
    place, n, docs = _runs(value, doc[at])
    low, high = np.divmod(value[place], base)
    del near, other, padded, at, step, one, two, value, place
    yield from _batches(lambda some: _joined_words([known.take(pa.array(low[some])), known.take(pa.array(high[some]))], sep),
                        n, docs)


def _added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("nb_docs").alias("nb_docs"))


def gram_totals(tokens_df: DataFrame, sizes: Sequence[int] = (1,), sep: str = "_", tokens_col: str = "tokens") -> DataFrame:
    """``term, n, nb_docs`` of the n-grams that ``ngrams_expr`` gives: how often, and in how
    many documents (rows)."""
    lengths = sorted(set(sizes))
    if not lengths or lengths[0] < 1:
        raise ValueError("n-gram sizes must be 1 or more")
    most = max(1, PIECE_CODES // 2)

    def count(batches):
        for words, counts in _pieces(batches, most):
            yield from _grams_of_piece(words, counts, lengths, sep)
    return _added_up(tokens_df.select(tokens_col).mapInArrow(count, SCHEMA))


def pair_totals(tokens_df: DataFrame, window: int, sep: str = " ", tokens_col: str = "tokens",
                bits: np.ndarray | None = None) -> DataFrame:
    """``term, n, nb_docs`` of two different words, the lesser first, at most ``window`` places
    apart: how often, and in how many documents (rows). Null words
    keep their places and take no part, nor do words that are not in the filter ``bits``."""
    most = max(1, PIECE_CODES // window)

    def count(batches):
        for words, counts in _pieces(batches, most):
            yield from _pairs_of_piece(words, counts, window, sep, bits)
    return _added_up(tokens_df.select(tokens_col).mapInArrow(count, SCHEMA))


# ------------------------------------------------------------ n-grams and their parts

def _parts_columns(lengths: Sequence[int]) -> list[str]:
    return [f"{side}{k}" for k in lengths for side in ("l", "r")]


def _parts_batch(term: Callable[[slice], pa.Array], size, n, docs, columns: dict, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(n), BATCH_ROWS):
        some = slice(lo, lo + BATCH_ROWS)
        own = n[some]
        zero = np.zeros(len(own), np.int64)
        arrays = {"term": term(some), "size": pa.array(np.full(len(own), size, np.int32) if isinstance(size, int) else size[some], pa.int32()),
                  "n": pa.array(own, pa.int64()), "nb_docs": pa.array(docs[some], pa.int64()),
                  **{c: pa.array(columns[c][some] if c in columns else zero, pa.int64()) for c in names}}
        yield from pa.table(arrays).to_batches()


def _parts_of_piece(words: pa.Array, sizes: np.ndarray, lengths: Sequence[int], sep: str) -> Iterator[pa.RecordBatch]:
    names = _parts_columns(lengths)
    known, code = _numbered(words)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    before = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    odd = pc.fill_null(pc.match_substring(known, sep), True).to_numpy(zero_copy_only=False)
    plain = np.ones(len(sizes), bool)
    plain[doc[odd[code]]] = False
    base = max(2, len(known))
    total = Counter()
    for k in range(1, lengths[-1] + 1):
        at = np.flatnonzero((left >= k) & plain[doc])
        if not len(at):
            continue
        value, top = code[at], base
        for j in range(1, k):
            if top * base >= 1 << 62:
                distinct, value = np.unique(value, return_inverse=True)
                top = len(distinct)
            value, top = value * base + code[at + j], top * base
        order = np.argsort(value, kind="stable")
        at, value = at[order], value[order]
        new = np.ones(len(at), bool)
        new[1:] = value[1:] != value[:-1]
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        new[1:] |= doc[at][1:] != doc[at][:-1]
        docs = np.add.reduceat(new.astype(np.int64), start)
        columns = {}
        for size in lengths:
            if size > k:  # begins, or ends, an n-gram of that size
                columns[f"l{size}"] = np.add.reduceat((left[at] >= size).astype(np.int64), start)
                columns[f"r{size}"] = np.add.reduceat((before[at] >= size - k).astype(np.int64), start)
        first = at[start]
        if k in lengths:
            total[k] += len(at)
        else:
            n = docs = np.zeros(len(start), np.int64)
        del at, value, new, order, start
        yield from _parts_batch(lambda some: _sequences(known, code, first[some], k, sep), k, n, docs, columns, names)
    # documents with a word that holds the separator, or a null one: by their texts
    found: dict = {}
    ends = np.cumsum(sizes)
    for d in np.flatnonzero(~plain):
        row = words.slice(int(ends[d] - sizes[d]), int(sizes[d])).to_pylist()
        grams = Counter(sep.join(w for w in row[i:i + k] if w is not None) for k in lengths for i in range(len(row) - k + 1))
        for gram, n in grams.items():
            parts = gram.split(sep)
            if len(parts) not in lengths:
                continue
            total[len(parts)] += n
            own = found.setdefault((gram, len(parts)), Counter())
            own["n"] += n
            own["nb_docs"] += 1
            for cut in range(1, len(parts)):
                found.setdefault((sep.join(parts[:cut]), cut), Counter())[f"l{len(parts)}"] += n
                found.setdefault((sep.join(parts[cut:]), len(parts) - cut), Counter())[f"r{len(parts)}"] += n
    rows = [*found.items(), *(((None, k), {"n": n}) for k, n in total.items())]
    column = lambda c: np.array([v.get(c, 0) for _, v in rows], np.int64)
    terms = pa.array([t for (t, _), _ in rows], pa.string())
    yield from _parts_batch(lambda some: terms.slice(some.start, BATCH_ROWS), [k for (_, k), _ in rows], column("n"),
                            column("nb_docs"), {c: column(c) for c in names}, names)


def gram_part_totals(tokens_df: DataFrame, sizes: Sequence[int], sep: str = " ", tokens_col: str = "tokens") -> DataFrame:
    """``term, size, n, nb_docs`` of the n-grams of ``sizes`` and of all beginnings and ends of
    them, with ``l<k>`` and ``r<k>``: how many n-grams of size k begin, or end, with the
    term. ``n`` is 0 for a size not asked for; a null term has the number of all n-grams of its size."""
    lengths = sorted(set(sizes))
    names = _parts_columns(lengths)
    most = max(1, PIECE_CODES // 2)

    def count(batches):
        for words, counts in _pieces(batches, most):
            yield from _parts_of_piece(words, counts, lengths, sep)
    schema = "term string, size int, n long, nb_docs long, " + ", ".join(f"{c} long" for c in names)
    parts = tokens_df.select(tokens_col).mapInArrow(count, schema)
    return parts.groupBy("term", "size").agg(*[F.sum(c).alias(c) for c in ("n", "nb_docs", *names)])


# ------------------------------------------------------------ places of expressions

def _places_of_piece(ids: pa.Array, words: pa.Array, sizes: np.ndarray, longest: int, sep: str,
                     bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    known, code = _numbered(words)
    hashes = _word_hashes(known)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    before = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # a word that holds the separator or is null goes to the join whatever the filter says
    odd = pc.fill_null(pc.match_substring(known, sep), True).to_numpy(zero_copy_only=False)[code]
    value, any_odd = hashes[code], odd.copy()
    for k in range(2, longest + 1):
        at = np.flatnonzero(left >= k)
        if not len(at):
            return
        value[at] = (value[at] * FACTOR + hashes[code[at + k - 1]]) % FILTER_BITS
        any_odd[at] |= odd[at + k - 1]
        at = at[_passed(bits, value[at]) | any_odd[at]]
        if len(at):
            out = pa.table({"__id": ids.take(pa.array(doc[at])), "pos": pa.array(before[at] + 1, pa.int32()),
                            "len": pa.array(np.full(len(at), k, np.int32)),
                            "expression": _joined_words([known.take(pa.array(code[at + j])) for j in range(k)], sep)})
            yield from out.to_batches(max_chunksize=BATCH_ROWS)


def expression_places(tokens_df: DataFrame, bits: np.ndarray, longest: int, sep: str = " ",
                      tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """``__id, pos, len, expression`` of the sequences of 2 to ``longest`` words that may be
    among the sequences of the filter ``bits``; a join tells which are."""
    most = max(1, PIECE_CODES // 2)
    rows = tokens_df.select(F.col(tokens_col).alias("tokens"), F.col(id_col).alias("__id"))

    def find(batches):
        for batch in batches:
            begin = 0
            for words, sizes in _pieces(iter([batch]), most):
                yield from _places_of_piece(batch.column(1).slice(begin, len(sizes)), words, sizes, longest, sep, bits)
                begin += len(sizes)
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(find, f"__id {kind}, pos int, len int, expression string")


# ------------------------------------------------------------ places of words

def _word_places_of_piece(ids: pa.Array, words: pa.Array, sizes: np.ndarray, after: int,
                          bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    known, code = _numbered(words)
    wanted = _passed(bits, _word_hashes(known)) & known.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(wanted[code])
    ends = np.cumsum(sizes)
    for lo in range(0, len(at), BATCH_ROWS):
        some = at[lo:lo + BATCH_ROWS]
        doc = np.searchsorted(ends, some, side="right")
        out = {"__id": ids.take(pa.array(doc)), "pos": pa.array(some - (ends - sizes)[doc] + 1, pa.int32()),
               "term": known.take(pa.array(code[some])).cast(pa.string())}
        if after:
            n = np.minimum(ends[doc] - some - 1, after)
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) + np.repeat(some + 1 - begin, n)
            out["after"] = pa.ListArray.from_arrays(pa.array(np.append(begin, n.sum()), pa.int32()),
                                                    known.take(pa.array(code[place])).cast(pa.string()))
        yield from pa.table(out).to_batches()


def word_places(tokens_df: DataFrame, bits: np.ndarray, after: int = 0, tokens_col: str = "tokens",
                id_col: str = "doc_id") -> DataFrame:
    """``__id, pos, term`` of the words that may be among those of the filter ``bits``, with the
    ``after`` words that follow (fewer at a document's end) as ``after``; a join tells which are."""
    most = max(1, PIECE_CODES // 2)
    rows = tokens_df.select(F.col(tokens_col).alias("tokens"), F.col(id_col).alias("__id"))

    def find(batches):
        for batch in batches:
            begin = 0
            for words, sizes in _pieces(iter([batch]), most):
                yield from _word_places_of_piece(batch.column(1).slice(begin, len(sizes)), words, sizes, after, bits)
                begin += len(sizes)
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(find, f"__id {kind}, pos int, term string" + (", after array<string>" if after else ""))
