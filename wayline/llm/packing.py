"""Best-fit packing of tokenised documents into sequences of fixed capacity, by a linear grouping scheme.

Documents become ids followed by an end id; only those longer than the capacity are cut. Lengths of large pieces are
rounded up to the largest length of their group, groups having equal cardinality; a linear program over
configurations (multisets of the few rounded sizes that fit a sequence, made by column generation) says how often to
use each; actual pieces take the configurations' places, and small pieces go, longest first, where they fit best.

Scale: whatever is optimised is a histogram of lengths, at most as many rows as the capacity, so the driver's work and
memory do not grow with the documents. Pieces find their places by their number among those of equal length, which is
counted in BUCKETS parts for each length: a length that a third of all pieces share is spread over that many groups.
Token ids never leave the tasks; only lengths and checksums are shuffled.

Defined results: null and empty texts are the end id alone. Repeated rows are packed as often as they occur. A null
doc_id is carried along. Very long texts are cut whole into pieces. Columns besides doc_id and text, whatever their names, are not read. An empty table gives no
rows. The vocabulary's pre-tokeniser has to part at white space, as word_bpe_49k.json does; ids of another one may differ from its own.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, give_back, hashed, joined

#: Parts in which the pieces of one length are numbered.
BUCKETS = 256
#: Groups of equal cardinality for large pieces.
GROUPS = 96
#: Pieces of at least capacity / SMALL are large, so a configuration has at most SMALL of them.
SMALL = 8
#: Runs that a worker remembers.
CACHED = 250_000
#: Bytes of a longer run are hashed by a digest.
LONGEST = 64
#: Bytes of text whose runs are looked up at once.
CHUNK = 1 << 20
#: ASCII marks, which are neither letters nor figures.
MARKS = string.punctuation


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes. A run of text without blanks is encoded once while it is remembered.

    The vocabulary's pre-tokeniser never joins across white space, so a text's ids are those of its runs in a row. Runs are known by 64 bits of their
    bytes; those of about a megabyte of text are looked up at once, and the new ones among them encoded together.
    """

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # small Latin letters need neither the normaliser nor the pre-tokeniser's parting, only the model
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.plain = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.clear()

    def clear(self) -> None:
        self.marks: dict[str, bytes] = {}
        self.hashes, self.at, self.many, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _plainly(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of small Latin letters, many in one call."""
        for k in range(0, len(words), 1000):
            own = words[k : k + 1000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(own):
                yield from map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends))
            else:  # the vocabulary doesn't mark ends of words
                yield from map(self._plainly, own)

    def _encoded(self, runs: list[str]) -> list[bytes]:
        """Letters with marks behind them are two pieces; what is neither is left to the tokeniser as it is."""
        words = [run if run.isalpha() else run.rstrip(MARKS) for run in runs]
        easy = [word.isalpha() if word.isascii() else self.plain(word) is not None for word in words]
        found, out = self._words([word.lower() for word, e in zip(words, easy, strict=True) if e]), []
        for run, word, e in zip(runs, words, easy, strict=True):
            ids = next(found) if e else self._plainly(run)
            if e and len(word) < len(run):
                marks = run[len(word) :]
                if len(self.marks) > 4096:
                    self.marks.clear()
                if marks not in self.marks:
                    self.marks[marks] = self._plainly(marks)
                ids += self.marks[marks]
            out.append(ids)
        return out

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered runs in a row, and where each run's end."""
        many = self.many[places]
        ends = np.cumsum(many)
        return self.pool[np.arange(many.sum()) + np.repeat(self.at[places] - (ends - many), many)], ends

    def _remember(self, hashes: np.ndarray, pool: np.ndarray, many: np.ndarray) -> None:
        at = len(self.pool) + np.cumsum(many) - many
        hashes, at, many = (np.concatenate(x) for x in ((self.hashes, hashes), (self.at, at), (self.many, many)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.many, self.pool = hashes[order], at[order], many[order], np.concatenate([self.pool, pool])

    def _places(self, hashes: np.ndarray, run: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Where each of the distinct hashes is remembered; run gives the runs of some of them."""
        at = np.searchsorted(self.hashes, hashes)
        fresh = np.ones(len(hashes), bool)
        fresh[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != hashes[at < len(self.hashes)]
        if not fresh.any():
            return at
        if len(self.hashes) + fresh.sum() > CACHED or len(self.pool) > 16 * CACHED:  # only what is in hand stays
            kept, many = self._gathered(at[~fresh])[0], self.many[at[~fresh]]
            self.clear()
            self._remember(hashes[~fresh], kept, many)
        found = self._encoded(run(fresh))
        self._remember(hashes[fresh], np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)
        return np.searchsorted(self.hashes, hashes)

    def _of_chunk(self, parts: list[bytes]) -> list[bytes]:
        if len(parts) == 1 and len(parts[0]) > CHUNK:  # one run
            return [self._plainly(parts[0].decode())]
        buffer, starts = joined(parts)
        blank, stop = buffer == 0x20, np.zeros(len(buffer), bool)
        # a stop between a letter and a blank is a piece of its own: so there are fewer runs to know
        stops = np.flatnonzero((buffer == 0x2E) | (buffer == 0x2C))
        before = buffer[stops - 1] | 0x20
        stop[stops[blank[stops + 1] & (stops > 0) & (before >= 0x61) & (before <= 0x7A)]] = True
        first = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | stop))
        last = np.flatnonzero(np.concatenate([[False], ~blank[:-1]]) & (blank | stop))
        if not len(first):
            return [b""] * len(parts)
        hashes = hashed(buffer, first, last)
        raw = buffer.tobytes()
        for i in np.flatnonzero(last - first > LONGEST).tolist():
            hashes[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]], digest_size=8).digest())
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        places = self._places(distinct, lambda fresh: [raw[i:j].decode() for i, j in zip(first[one[fresh]].tolist(), last[one[fresh]].tolist(), strict=True)])
        ids, ends = self._gathered(places[which])
        edges = (4 * np.append(0, ends)[np.append(np.searchsorted(first, starts), len(first))]).tolist()
        ids = ids.tobytes()
        return [ids[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, waiting, size = [], [], 0

        def done() -> None:
            for i, ids in zip(owners, self._of_chunk(waiting), strict=True):
                out[i].append(ids)

        for k, text in enumerate(texts):
            for part in _parts(text):
                if waiting and size + len(part) > CHUNK:
                    done()
                    owners, waiting, size = [], [], 0
                owners.append(k)
                waiting.append(part)
                size += len(part) + 1
        if waiting:
            done()
        return [b"".join(x) for x in out]

    def ids(self, text: str) -> bytes:
        return self.of([text])[0]


def _parts(text: str | None) -> Iterator[bytes]:
    """A text as UTF-8 with blanks only at which it may be parted, in parts of at most CHUNK bytes; a run that is longer is a part."""
    text = text or ""
    try:
        text.encode("latin-1")
        text = text.lower()  # there it makes no other ids, and fewer runs to know
    except UnicodeEncodeError:
        pass
    raw, at = text.encode().replace(b"\n", b" "), 0
    while len(raw) - at > CHUNK:
        to = raw.rfind(b" ", at + 1, at + CHUNK)
        to = raw.find(b" ", at + CHUNK) if to < 0 else to
        if to < 0:
            break
        yield raw[at:to]
        at = to
    yield raw[at:]


_KNOWN: dict[str, WordIds] = {}


def _cutter(vocabulary: str, capacity: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _KNOWN:
            _KNOWN[vocabulary] = WordIds(vocabulary)
        known = _KNOWN[vocabulary]
        for batch in batches:
            part = rows = columns = None  # a batch may be empty
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc_id, own in zip(part.column(0).to_pylist(), known.of(part.column(1).to_pylist()), strict=True):
                    raw = own + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[start : start + 4 * capacity]
                        rows.append((doc_id, k, start // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 5 + keep_ids], names[: 5 + keep_ids])
            del batch, part, rows, columns  # before the next batch comes
        known.clear()  # a worker may live on without packing again
        give_back()

    return pieces


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids of each piece."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_cutter(vocabulary, capacity, keep_ids), schema)


def numbered(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within each value of key (of which there are few), in parts that no hot value overfills."""
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)) - 1)
    return own.join(before, [key, "_part"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_before", "_own")


# ---- the optimisation over sizes


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity that has the most value: (value, how many of each size)."""
    best, took, last = np.zeros(capacity + 1), [], 0.0
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (w, v) in enumerate(zip(sizes, values, strict=True)):
            better = best[: capacity + 1 - w] + v > new[w:] + 1e-12
            new[w:][better] = (best[: capacity + 1 - w] + v)[better]
            pick[w:][better] = g
        took.append(pick)
        if new[capacity] <= last + 1e-12:
            break
        best, last = new, new[capacity]
    counts, at = np.zeros(len(sizes), int), capacity
    for pick in reversed(took):
        if pick[at] >= 0:
            counts[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(values @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, that hold demand[g] items of sizes[g] exactly, in few sequences.

    Linear program by revised simplex, columns by knapsack; then whole uses, and what is left packed best-fit.
    """
    if not len(sizes):
        return []
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        value, column = _best_configuration(sizes, np.maximum(np.linalg.solve(basis.T, np.ones(n)), 0), capacity)
        if value <= 1 + 1e-7:
            break
        x, way = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    uses = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-9).astype(int)
    out, left = [], demand.astype(int).copy()
    for column, use in zip(basis.T.round().astype(int), uses, strict=True):
        use = min([use, *(left[column > 0] // column[column > 0])])
        if use > 0:
            out.append((column, int(use)))
            left -= column * use
    open_: list[list] = []  # [room, counts]
    for g in np.argsort(-sizes):
        for _ in range(left[g]):
            fits = [b for b in open_ if b[0] >= sizes[g]]
            if not fits:
                open_.append(fit := [capacity, np.zeros(n, int)])
            else:
                fit = min(fits, key=lambda b: b[0])
            fit[0] -= sizes[g]
            fit[1][g] += 1
    return out + [(b[1], 1) for b in open_]


@dataclass
class LargePlan:
    """Where the item of a given rank (longest first) among large pieces goes: arrays searched by rank."""

    starts: np.ndarray  # first rank of each run of places
    base: np.ndarray  # first sequence of the run's configuration
    uses: np.ndarray  # how many sequences use it
    sequences: int

    def __call__(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, rank, "right") - 1
        return self.base[run] + (rank - self.starts[run]) % self.uses[run]


def plan_large(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> LargePlan:
    """counts: how many large pieces have each length. Groups of equal cardinality, each rounded up to its longest."""
    lengths = np.array(sorted(counts, reverse=True), int)
    ends = np.cumsum([counts[x] for x in lengths.tolist()]) if len(lengths) else np.zeros(0, int)
    n = int(ends[-1]) if len(ends) else 0
    edges = np.unique(np.linspace(0, n, min(groups, n) + 1).astype(int)) if n else np.zeros(1, int)
    rounded = lengths[np.searchsorted(ends, edges[:-1], "right")] if n else np.zeros(0, int)
    sizes = np.array(sorted(set(rounded.tolist()), reverse=True), int)
    demand = np.array([int((edges[1:] - edges[:-1])[rounded == s].sum()) for s in sizes], int)
    first = np.cumsum(demand) - demand
    starts, base, uses, at = [], [], [], 0
    used = np.zeros(len(sizes), int)
    for column, use in configurations(sizes, demand, capacity):
        for g in np.flatnonzero(column):
            for _ in range(column[g]):
                starts.append(first[g] + used[g])
                base.append(at)
                uses.append(use)
                used[g] += use
        at += use
    order = np.argsort(starts)
    return LargePlan(*(np.array(x, np.int64)[order] for x in (starts, base, uses)), at)


@dataclass
class SmallPlan:
    """Where the item of a given length and number goes: (room class of the sequence, its number there); class -1: a new sequence."""

    keys: np.ndarray  # length * 2^40 + first number, of each run
    room: np.ndarray
    first: np.ndarray
    each: np.ndarray  # items of the run in each sequence

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.keys, (length << 40) + number, "right") - 1
        return self.room[run], self.first[run] + (number - (self.keys[run] & ((1 << 40) - 1))) // self.each[run]


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int) -> SmallPlan:
    """Best fit, longest first, over classes: counts of pieces by length, and of sequences by room left.

    A sequence with the least sufficient room takes as many pieces of the length as it can, as it stays the best fit.
    """
    classes: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # room: runs (original room, first, how many)
    for room, n in rooms.items():
        classes[room].append((room, 0, n))
    runs: list[tuple[int, int, int, int]] = []
    new = 0
    for length in sorted(counts, reverse=True):
        at, left, room = 0, counts[length], length
        while left:
            while room <= capacity and not classes[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                many = -(-left // each)
                classes[capacity].append((-1, new, many))
                new += many
                room = capacity
            origin, first, n = classes[room].pop()
            each = min(room // length, left)
            many = min(n, left // each)
            runs.append(((length << 40) + at, origin, first, each))
            if many < n:
                classes[room].append((origin, first + many, n - many))
            classes[room - each * length].append((origin, first, many))
            at += many * each
            left -= many * each
    table = np.array(runs or [(0, -1, 0, 1)], np.int64)
    return SmallPlan(*table[np.argsort(table[:, 0], kind="stable")].T)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (with length, doc_id, piece, ids_crc32) -> the same with sequence_id and offset."""
    by = ["doc_id", "piece", "ids_crc32"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    least = -(-capacity // SMALL)
    large = {k: n for k, n in counts.items() if least <= k < capacity}
    plan, before, seen = plan_large(large, capacity), {}, 0
    for k in sorted(large, reverse=True):
        before[k], seen = seen, seen + large[k]
    offsets = np.zeros(capacity + 1, np.int64)
    for k, v in before.items():
        offsets[k] = v
    full = counts.get(capacity, 0)

    @F.pandas_udf("long")
    def large_place(length: pd.Series, number: pd.Series) -> pd.Series:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        out, own = number.copy(), length < capacity  # whole sequences come first, numbered as they are
        if own.any():
            out[own] = full + plan(offsets[length[own]] + number[own])
        return pd.Series(out)

    ranked = cut(numbered(pieces, "length", by, "_number"), "pack-numbered")
    big = ranked.filter(F.col("length") >= least).withColumn("sequence_id", large_place("length", "_number"))
    bins = big.filter(F.col("length") < capacity).groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("_room"))
    bins = cut(numbered(bins, "_room", ["sequence_id"], "_nth"), "pack-rooms")
    rooms = {r["_room"]: r["n"] for r in bins.groupBy("_room").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    small = plan_small({k: n for k, n in counts.items() if k < least}, {k: n for k, n in rooms.items() if k > 0}, capacity)
    base = full + plan.sequences

    @F.pandas_udf("_room long, _nth long")
    def small_place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        room, nth = small(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"_room": room, "_nth": nth})

    little = ranked.filter(F.col("length") < least).withColumn("_at", small_place("length", "_number")).select(*ranked.columns, "_at._room", "_at._nth")
    placed = little.join(bins, ["_room", "_nth"], "left").withColumn("sequence_id", F.coalesce("sequence_id", F.lit(base) + F.col("_nth")))
    together = big.drop("_number").unionByName(placed.select(*[c for c in big.columns if c != "_number"]))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *by).rowsBetween(Window.unboundedPreceding, -1)
    return together.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    placed = place(cut(cut_pieces(docs, vocabulary, capacity), "pack-pieces", texts=True), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian unsigned 32-bit). A sequence has at most capacity pieces."""
    own = ["doc_id", "piece", "ids_crc32"]
    # of equal rows each has its own place
    nth = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0)))
    ids = cut_pieces(docs, vocabulary, capacity, keep_ids=True).withColumn("_nth", nth)
    there = placed.withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy("sequence_id", "offset")))
    match = [ids[c].eqNullSafe(there[c]) for c in [*own, "_nth"]]
    parts = ids.join(there, match).select("sequence_id", F.struct("offset", "ids").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: F.hex(p["ids"])), "")
    return parts.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))
