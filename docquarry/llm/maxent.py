"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) times P(slot | class, context),
and for a word that shares its slot with others, times its share of their
counts. Both factors are softmaxes over hashed features of the words before:
each of the three last by its place (skip features) and the last two together
(an n-gram); those of the second factor are joined with the class. The weights
are learned by distributed gradient updates: every task starts a round from
the weights that all share, makes its steps over its own texts, and the rows
of the new weights are averaged over tasks by how often each met the feature,
summed up in a tree so that no task holds the weights of all. Each round takes
its own share of the texts, so that together they use every training token once.

Texts are tokenised once, in chunks, each with a dictionary of its words; one
shuffle of the dictionaries gives every word its count in the whole corpus,
and training and scoring read codes. No word is left out: the ``CLUSTERED``
most frequent (of at most ``LONGEST`` bytes; the broadcast model is bounded by
these) are clustered by the frequent words beside them and the others go to
the cluster that their trigrams of letters speak for, by a table learned from
the clustered ones. The most frequent words of a class have slots of their
own; all others of the class share its last. The end is a class of its own,
and so is the one token that stands for all words that training never saw: it
is trained on the words that training has once, which are unseen to the rest
of it. So the probabilities of all tokens add up to 1 in any context.

Null texts are empty and have the end token alone; a text of any length is one
row of a chunk. Without training tokens every score is 0. Words of equal count
go by their bytes; repeated rows are scored alike and each counts in training;
an empty table gives an empty table; only the id and text columns are read, so
no other name can clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

#: Bytes of text in one chunk, or one text that is longer.
CHUNK = 6 << 20
#: Words that are clustered, their greatest length, words beside them that they are clustered by, and clusters.
CLUSTERED, LONGEST, BESIDE, CLUSTERS = 8192, 64, 64, 14
TRIGRAMS = 1 << 14
#: Places of a class: its frequent words, and one for all others.
SLOTS = 16
#: Rows of each factor's weights (numbered by 16 bits), rounds of training, tokens in one step, and the rate.
BUCKETS, ROUNDS, STEP, RATE = 1 << 16, 2, 4096, 0.5
END = b" "  # no word has a space
ENDS, UNSEEN, FIRST = 0, 1, 2  # classes: the end, the unseen token, the first cluster
FEATURES = 4
#: Meetings of a feature by which its weights are drawn towards where the round began.
SHRINK = 16
NEVER = -1e4
#: Rows of weights that travel together, and parts that one task of the tree adds.
BLOCK, FAN = 4096, 32
#: Splits of the chunks that one task of a round takes, where there are more than cores.
GATHERED = 4
#: Entries of dictionaries that are counted together.
DEALT = 1 << 19


def tokens(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of the batch's texts: the distinct tokens, all tokens as places among these, and how many each text has.

    A text's tokens are its words with A-Z lower-cased, then the end, which is
    the last of the distinct ones.
    """
    column = batch.column(batch.schema.get_field_index("text"))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
    if b"" in words:  # beside white space at a text's edges
        blank = words.index(b"")
        del words[blank]
        real = codes != blank
        codes, doc = codes[real] - (codes[real] > blank), doc[real]
    sizes = np.bincount(doc, minlength=len(parts)) + 1
    out = np.full(len(codes) + len(parts), len(words))
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = codes
    return [*map(brief, words), END], out, sizes


def brief(word: bytes) -> bytes:
    """The word, or how it starts and its digest, so that no dictionary has texts of any length in it."""
    if len(word) <= 4 * LONGEST:
        return word
    return word[: 2 * LONGEST].decode(errors="ignore").encode() + hashlib.sha256(word).hexdigest().encode()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers byte by byte: the lowest of all, then the next, so that small numbers pack well."""
    x = x.astype(kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(x: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


_DOCS = "chunk long, ids array<long>, out array<boolean>, sizes binary, codes binary, words binary"
_DOCS_NAMES = [x.split()[0] for x in _DOCS.split(", ")]
_CODED, _COUNTED = f"{_DOCS}, n array<long>", f"{_DOCS}, counts binary, about binary"
#: Between the words of a dictionary; no word has it.
BREAK = b"\n"


def coded(rows: DataFrame) -> DataFrame:
    """One row per chunk of the rows (id, text, out): codes of the tokens, the words behind them, and how often training has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                words, codes, sizes = tokens(batch)
                out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                n = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(words))
                lists = [_one(batch.column(0)), _one(batch.column(2)), pa.array([_planes(sizes)]), pa.array([_planes(codes)]), pa.array([BREAK.join(words)]), _one(pa.array(n))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *lists], names=["chunk", "ids", "out", "sizes", "codes", "words", "n"])
                chunk += 1

    return rows.select("id", "text", "out").mapInArrow(run, _CODED)


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that lists the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def counted(chunks: DataFrame) -> DataFrame:
    """(chunk, code, word, n, c, first): each word of each dictionary with its count ``c`` in all training; ``first`` marks one row per word.

    Dictionaries are dealt by hash of the word into buckets of about
    ``DEALT`` entries. A word comes once in a chunk, so the commonest has as
    many entries as there are chunks.
    """
    entries, size = chunks.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    buckets = max(chunks.sparkSession.sparkContext.defaultParallelism, entries // DEALT, size // (16 * DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = words.as_py().split(BREAK)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                there, start = np.unique(bucket[order], return_index=True)
                ends = [*start.tolist()[1:], len(order)]
                words, n = [words[i] for i in order.tolist()], n.values.to_numpy()[order]
                parts = [(_planes(order[i:j]), BREAK.join(words[i:j]), _planes(n[i:j])) for i, j in zip(start.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([chunk] * len(there)), *map(pa.array, zip(*parts, strict=True))], names=["bucket", "chunk", "codes", "words", "n"])

    def count(part: pa.Table) -> pa.Table:
        lists = pc.split_pattern(part.column("words").cast(pa.string()).combine_chunks(), BREAK.decode())
        words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        which = words.dictionary_encode().indices.to_numpy()  # numbered as they come
        code, n = (np.concatenate([_unplaned(x.as_py()) for x in part.column(k)]).astype(np.int64) for k in ("codes", "n"))
        c = np.bincount(which, n).astype(np.int64)[which]
        first = np.diff(np.maximum.accumulate(which), prepend=-1) > 0
        return pa.table([pa.array(np.repeat(part.column("chunk").to_numpy(), sizes)), pa.array(code), words, pa.array(n), pa.array(c), pa.array(first)], names=_WORDS.names)

    dealt = chunks.select("chunk", "words", "n").mapInArrow(deal, "bucket long, chunk long, codes binary, words binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(count, _WORDS)


_WORDS = T.StructType([T.StructField(k, t) for k, t in (("chunk", T.LongType()), ("code", T.LongType()), ("word", T.StringType()), ("n", T.LongType()), ("c", T.LongType()), ("first", T.BooleanType()))])


def with_counts(chunks: DataFrame, counts: DataFrame, classes: Classes | None = None) -> DataFrame:
    """The chunks with ``counts``, those of their dictionaries' words in all training, and ``about``, what ``classes`` say of these words."""
    spread = chunks.sparkSession.sparkContext.broadcast(classes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= DEALT:
                yield parts(pa.Table.from_batches(held))
                held = []
        if held:
            yield parts(pa.Table.from_batches(held))

    def parts(table: pa.Table) -> pa.RecordBatch:
        chunk, code, c, first = (table.column(k).to_numpy() for k in ("chunk", "code", "c", "first"))
        about = np.zeros(len(c), np.int64)
        if spread.value is not None:
            coded = table.column("word").combine_chunks().cast(pa.binary()).dictionary_encode()
            which, total = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
            total[which] = c
            about = spread.value.about(coded.dictionary.to_pylist(), total)[which] | first.astype(np.int64) << 48
        order = np.argsort(chunk, kind="stable")
        there, start = np.unique(chunk[order], return_index=True)
        runs = [order[i:j] for i, j in zip(start.tolist(), [*start.tolist()[1:], len(order)], strict=True)]
        columns = [pa.array([_planes(x[r], "<i8") for r in runs], pa.binary()) for x in (code, c, about)]
        return pa.RecordBatch.from_arrays([pa.array(there), *columns], names=["chunk", "code", "c", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, cells = batch.slice(i, 1), batch.column(batch.num_columns - 1)[i].values
                code, c, about = (np.concatenate([_unplaned(x.as_py(), "<i8") for x in cells.field(k)]) for k in range(3))
                back = np.argsort(code)
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([_planes(c[back], "<i8")]), pa.array([_planes(about[back], "<i8")])], names=[*one.schema.names[:-1], "counts", "about"])

    cells = counts.select("chunk", "code", "word", "c", "first").mapInArrow(gather, "chunk long, code binary, c binary, about binary")
    cells = cells.groupBy("chunk").agg(F.collect_list(F.struct("code", "c", "about")).alias("cells"))  # a dictionary's
    return chunks.select(*_DOCS_NAMES).join(cells, "chunk").mapInArrow(run, _COUNTED)


def trigram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each word with its edges, one after another, and where each word's begin."""
    text = np.frombuffer(b"\0\0".join([b"", *words, b""]), np.uint8).astype(np.int64)  # none reaches into the next word
    start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)])[:-1]
    rows = (text[:-2] * 961 + text[1:-1] * 31 + text[2:] * 7919) % TRIGRAMS
    return rows, start


def rare_class(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The cluster that a word's trigrams speak for."""
    if not words:
        return np.empty(0, np.int64)
    rows, start = trigram_rows(words)
    return np.add.reduceat(table[rows], start, axis=0).argmax(1)


def clustered(matrix: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means over the rows; the first centres lie far apart."""
    x = np.sqrt(matrix / np.maximum(matrix.sum(1, keepdims=True), 1))
    centres = x[[int(weight.argmax())]]
    while len(centres) < k:
        away = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1) * np.log1p(weight)
        centres = np.vstack([centres, x[int(away.argmax())]])
    label = np.zeros(len(x), np.int64)
    for _ in range(20):
        label = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in range(k):
            own = label == c
            if own.any():
                centres[c] = np.average(x[own], axis=0, weights=weight[own])
    return label


@dataclass
class Classes:
    """Class and slot of every word: by list for the frequent, by trigrams for the others."""

    place: dict[bytes, tuple[int, int]]
    table: np.ndarray

    @property
    def count(self) -> int:
        return FIRST + self.table.shape[1]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Classes and slots; the end is at home in its class."""
        found = [self.place.get(w) for w in words]
        cls = np.fromiter((-1 if p is None else p[0] for p in found), np.int64, len(words))
        slot = np.fromiter((SLOTS - 1 if p is None else p[1] for p in found), np.int64, len(words))
        other = np.flatnonzero(cls < 0)
        cls[other] = FIRST + rare_class([words[i] for i in other.tolist()], self.table)
        return cls, slot

    def about(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Slot, class and hash of each word in one number; words that training never saw have no class, those met once no hash."""
        out = np.full(len(words), UNSEEN << 32)
        seen = np.flatnonzero(counts > 0)
        cls, slot = self.of([words[i] for i in seen.tolist()])
        out[seen] = slot << 40 | cls << 32
        often = np.flatnonzero(counts > 1)
        out[often] |= np.fromiter((zlib.crc32(words[i]) for i in often.tolist()), np.int64, len(often))
        return out


@dataclass
class Chunk:
    """A row of ``with_counts``, read back; ``about`` spares looking at the words."""

    words: list[bytes]
    counts: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    out: np.ndarray
    about: np.ndarray | None = None

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Chunk:
        at = {name: batch.column(batch.schema.get_field_index(name))[i] for name in COLUMNS}
        out = at["out"].values.to_numpy(zero_copy_only=False).astype(bool)
        counts, about = (_unplaned(at[k].as_py(), "<i8") for k in ("counts", "about"))
        return cls([], counts, _unplaned(at["codes"].as_py()), _unplaned(at["sizes"].as_py()), out, about)

    def training(self) -> Chunk:
        return Chunk(self.words, self.counts, self.codes[np.repeat(~self.out, self.sizes)], self.sizes[~self.out], np.zeros(int((~self.out).sum()), bool), self.about)


COLUMNS = ("counts", "about", "codes", "sizes", "out")


def neighbours(chunks: DataFrame, words: list[bytes], beside: int) -> np.ndarray:
    """How often each of the words stands next to each of the ``beside`` first of them in training."""
    spread = chunks.sparkSession.sparkContext.broadcast(words)
    n = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(spread.value)}
        total = np.zeros(n * beside, np.int64)
        for batch in batches:
            for own, codes, sizes, out in zip(*batch.columns, strict=True):
                own, train = own.as_py().split(BREAK), ~out.values.to_numpy(zero_copy_only=False).astype(bool)
                codes = _unplaned(codes.as_py())[np.repeat(train, _unplaned(sizes.as_py()))]
                ids = np.fromiter((index.get(w, -1) for w in own), np.int64, len(own))[codes]
                for a, b in ((ids[1:], ids[:-1]), (ids[:-1], ids[1:])):
                    ok = np.flatnonzero((b >= 0) & (b < beside) & (a >= 0))
                    total += np.bincount(a[ok] * beside + b[ok], minlength=n * beside)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    cells = chunks.select("words", "codes", "sizes", "out").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n * beside)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    return out.reshape(n, beside)


def classes(chunks: DataFrame, counts: DataFrame) -> tuple[Classes, np.ndarray]:
    """Classes and the counts of the words with own slots, (class, slot); what is learned on the driver is bounded by ``CLUSTERED``."""
    eligible = counts.where(F.col("first") & (F.col("c") > 0) & (F.octet_length("word") <= LONGEST) & (F.col("word") != END.decode()))
    top = eligible.orderBy(F.desc("c"), "word").limit(CLUSTERED).select("word", "c").collect()
    words, seen = [r.word.encode() for r in top], np.array([r.c for r in top], np.int64)
    k = max(1, min(CLUSTERS, len(words)))
    label, table = np.zeros(len(words), np.int64), np.zeros((TRIGRAMS, k), np.float32)
    if len(words) > k:
        label = clustered(neighbours(chunks, words, min(BESIDE, len(words))), seen.astype(float), k)
        grams, start = trigram_rows(words)
        of = np.repeat(label, np.diff(np.append(start, len(grams))))
        met = np.bincount(grams * k + of, minlength=TRIGRAMS * k).reshape(TRIGRAMS, k)
        table = np.log((met + 0.1) / (met.sum(0) + 0.1 * TRIGRAMS)).astype(np.float32)
    place, own = {END: (ENDS, 0)}, np.zeros((FIRST + k, SLOTS))
    used = np.zeros(k, np.int64)
    for word, c, n in zip(words, label.tolist(), seen.tolist(), strict=True):
        slot = min(int(used[c]), SLOTS - 1)
        used[c] += 1
        place[word] = (FIRST + c, slot)
        if slot < SLOTS - 1:
            own[FIRST + c, slot] = n
    return Classes(place, table), own


def mixed(keys: np.ndarray) -> np.ndarray:
    """Rows of the weights for 64-bit keys."""
    k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)


class Contexts:
    """Keys of the features at a chunk's positions, by blocks; before its start a text has a word of its own."""

    def __init__(self, h: np.ndarray, chunk: Chunk):
        self.h = h.astype(np.uint32)[chunk.codes]
        self.place = np.arange(len(self.h), dtype=np.int32) - np.repeat(np.cumsum(chunk.sizes, dtype=np.int32) - chunk.sizes, chunk.sizes)

    def keys(self, i: int, j: int) -> list[np.ndarray]:
        back = []
        for d in (1, 2, 3):
            x = np.full(j - i, 7, np.int64)
            lead = max(0, d - i)
            x[lead:] = self.h[i - d + lead : j - d]
            x[self.place[i:j] < d] = 7
            back.append(x)
        return [back[0] * 4 + 1, back[1] * 4 + 2, back[2] * 4 + 3, back[0] * 0x5DEECE66D + back[1] * 4]


def logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """(outcomes, positions): what the rows of each position add up to; ``bias`` is one row, or one for each position."""
    out = weights.take(rows[0], 0)
    for r in rows[1:]:
        out += weights.take(r, 0)
    out += bias
    return np.ascontiguousarray(out.T)


def steps(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], label: np.ndarray, of: np.ndarray | None = None) -> None:
    """AdaGrad over minibatches, in place; ``met`` counts how often each row was met, ``of`` picks a row of ``bias`` for each position."""
    rate, tiny, width = np.float32(RATE), np.float32(1e-3), weights.shape[1]
    number = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(label), STEP):
        part, y = [r[i : i + STEP] for r in rows], label[i : i + STEP]
        grad = logits(weights, bias if of is None else bias.take(of[i : i + STEP], 0), part)
        grad -= grad.max(0)
        np.exp(grad, out=grad)
        grad /= grad.sum(0)
        grad[y, np.arange(len(y))] -= 1
        flat = np.concatenate(part).astype(np.int64)
        times = np.bincount(flat, minlength=BUCKETS)
        which = np.flatnonzero(times.astype(bool))
        number[which] = np.arange(len(which))
        at, times = number.take(flat), times.take(which)
        mean = np.empty((width, len(which)), np.float32)
        wide = np.empty((FEATURES, len(y)))
        for k in range(width):  # gradients of equal rows add up
            wide[:] = grad[k]
            mean[k] = np.bincount(at, wide.ravel(), len(which))
        met[which] += times
        mean /= np.sqrt(times).astype(np.float32)
        total = squares.take(which) + np.einsum("ij,ij->j", mean, mean) / np.float32(width)
        squares[which] = total
        mean *= rate / np.sqrt(total + tiny)
        new = weights.take(which, 0)
        new -= mean.T
        weights[which] = new


@dataclass
class Model:
    """Both factors: biases from counts, weights of hashed features, and what words of a shared slot divide."""

    classes: Classes
    bias: np.ndarray  # (classes,)
    slot_bias: np.ndarray  # (classes, SLOTS)
    rest: np.ndarray  # (classes,): what the counts of the words in the last slot add up to, smoothed
    weights: list[np.ndarray] = field(default_factory=list)

    def read(self, chunk: Chunk, seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, slot and hash of each word; those with fewer counts than ``seen`` are the unseen token, and as context so are words met once."""
        about = self.classes.about(chunk.words, chunk.counts) if chunk.about is None else chunk.about
        cls, slot, h = about >> 32 & 255, about >> 40 & 255, (about & 0xFFFFFFFF) + 16
        h[chunk.counts < 2] = 9
        unseen = chunk.counts < seen
        cls[unseen], slot[unseen] = UNSEEN, 0
        return cls, slot, h

    def log10(self, chunk: Chunk) -> np.ndarray:
        """log10 of each token's probability."""
        cls, slot, h = self.read(chunk, 1)
        shared = (cls >= FIRST) & (slot == SLOTS - 1)
        share = np.zeros(len(cls))
        share[shared] = np.log10((chunk.counts[shared] + 0.5) / self.rest[cls[shared]])
        at = Contexts(h, chunk)
        out = share[chunk.codes]
        for i in range(0, len(out), 16 * STEP):
            j = min(len(out), i + 16 * STEP)
            keys, c, s = at.keys(i, j), cls[chunk.codes[i:j]], slot[chunk.codes[i:j]]
            out[i:j] += chosen(logits(self.weights[0], self.bias, [mixed(k) for k in keys]), c)
            inner = np.flatnonzero(c >= FIRST)
            c, s = c[inner], s[inner]
            out[i + inner] += chosen(logits(self.weights[1], self.slot_bias.take(c, 0), [mixed(k[inner] * 31 + c) for k in keys]), s)
        return out


def chosen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10 of the softmax's share of outcome ``y`` at each position."""
    x -= x.max(0)
    own = x[y, np.arange(x.shape[1])].astype(np.float64)
    np.exp(x, out=x)
    return (own - np.log(x.sum(0).astype(np.float64))) / np.log(10)


def _summed(parts: DataFrame, tasks: int) -> DataFrame:
    """(factor, block, moved, met): sums over (part, factor, block, moved, met), ``FAN`` parts in one task at most at every level."""

    def add(table: pa.Table) -> pa.Table:
        moved = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table.column("moved"))
        met = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("met"))
        one = table.slice(0, 1)
        return pa.table([one.column("part"), one.column("factor"), one.column("block"), pa.array([moved.astype("<f4").tobytes()]), pa.array([met.tobytes()])], names=table.column_names)

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "factor", "block").applyInArrow(add, _PARTS)
    return parts


_PARTS = "part int, factor int, block int, moved binary, met binary"


def train(chunks: DataFrame, model: Model) -> None:
    """Learn the weights of both factors, in all rounds."""
    sc = chunks.sparkSession.sparkContext
    model.weights = [np.zeros((BUCKETS, model.classes.count), np.float32), np.zeros((BUCKETS, SLOTS), np.float32)]
    for r in range(ROUNDS):
        spread = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            m = spread.value
            own = [w.copy() for w in m.weights]
            squares = [np.zeros(BUCKETS, np.float32) for _ in own]
            met = [np.zeros(BUCKETS, np.int64) for _ in own]
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk = Chunk.read(batch, i).training()
                    cls, slot, h = m.read(chunk, 2)
                    at = Contexts(h, chunk)
                    for start in range(0, len(chunk.codes), 16 * STEP):
                        end = min(len(chunk.codes), start + 16 * STEP)
                        keys, c, s = at.keys(start, end), cls[chunk.codes[start:end]], slot[chunk.codes[start:end]]
                        steps(own[0], squares[0], met[0], m.bias, [mixed(k) for k in keys], c)
                        inner = np.flatnonzero(c >= FIRST)
                        c, s = c[inner], s[inner]
                        steps(own[1], squares[1], met[1], m.slot_bias, [mixed(k[inner] * 31 + c) for k in keys], s, c)
            for f in (0, 1):
                for b in range(0, BUCKETS, BLOCK):
                    times = met[f][b : b + BLOCK]
                    if times.any():
                        moved = (own[f][b : b + BLOCK] - m.weights[f][b : b + BLOCK]) * times[:, None]
                        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f], pa.int32()), pa.array([b], pa.int32()), pa.array([moved.astype("<f4").tobytes()]), pa.array([times.astype("<i8").tobytes()])]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "factor", "block", "moved", "met"])

        share = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == r).select(*COLUMNS)
        share = share.coalesce(max(sc.defaultParallelism, share.rdd.getNumPartitions() // GATHERED))  # each task sends weights
        deltas = share.mapInArrow(run, _PARTS)
        for x in _summed(deltas, max(2, share.rdd.getNumPartitions())).collect():  # as large as the weights
            met = np.frombuffer(x.met, "<i8")
            moved = np.frombuffer(x.moved, "<f4").reshape(len(met), -1)
            model.weights[x.factor][x.block : x.block + BLOCK] += moved / (met + SHRINK)[:, None].astype(np.float32)
        spread.destroy()


def fit(chunks: DataFrame, counts: DataFrame) -> Model:
    """The model of the training texts in ``chunks`` (as ``coded`` or ``with_counts`` gives them; ``counts`` as ``counted`` does)."""
    return fitted(chunks, counts)[0]


def fitted(chunks: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the chunks with all that it reads of them."""
    found, own = classes(chunks, counts)
    ready = stored(with_counts(chunks, counts, found))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v, once = np.zeros(found_count), np.zeros(found_count), 0
        for batch in batches:
            for c, about in zip(*batch.columns, strict=True):
                c, about = _unplaned(c.as_py(), "<i8"), _unplaned(about.as_py(), "<i8")
                new = (about >> 48 == 1) & (c > 0)  # one entry of each word of training
                once += int((new & (c == 1)).sum())
                cls = about >> 32 & 255
                new &= (about >> 40 & 255 == SLOTS - 1) | (cls == ENDS)
                n += np.bincount(cls[new], c[new], found_count)
                v += np.bincount(cls[new], minlength=found_count)
        yield pa.RecordBatch.from_arrays([pa.array([*range(found_count), -1]), pa.array([*n, once]).cast(pa.int64()), pa.array([*v, 0]).cast(pa.int64())], names=["cls", "n", "v"])

    found_count = found.count
    got = {r.cls: r for r in ready.select("counts", "about").mapInArrow(sums, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n, v = (np.array([got[i][k] for i in range(found_count)], float) for k in ("n", "v"))
    own[:, SLOTS - 1] = n
    there = own > 0
    there[:, SLOTS - 1] = v > 0
    size = own.sum(1)
    size[ENDS] = n[ENDS]
    bias = np.where(size > 0, np.log(size + 0.5), NEVER)
    bias[UNSEEN] = np.log(got[-1].n + 0.5)
    slot_bias = np.where(there, np.log(own + 0.5), NEVER)
    model = Model(found, bias.astype(np.float32), slot_bias.astype(np.float32), n + 0.5 * v)
    train(ready, model)
    return model, ready


_SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("out"))
    chunks = stored(coded(rows))
    counts = stored(counted(chunks))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("first") & (F.col("c") > 0))).first()
    model, chunks = fitted(chunks, counts) if total else (None, stored(with_counts(chunks, counts)))
    floor = float(np.log10(total + 0.5 * (kinds + 1)))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.read(batch, i)
                doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
                per_doc = lambda x, doc=doc, chunk=chunk: np.bincount(doc, x, minlength=len(chunk.sizes))
                nothing = np.zeros(len(chunk.sizes))
                base = per_doc((np.log10(chunk.counts + 0.5) - floor)[chunk.codes]) if total else nothing
                own = per_doc(spread.value.log10(chunk)) if total else nothing
                columns = [batch.column(batch.schema.get_field_index("ids"))[i].values, pa.array(chunk.out), chunk.sizes, per_doc((chunk.counts > 0)[chunk.codes]), np.full(len(nothing), total), base, own]
                yield pa.RecordBatch.from_arrays([x.cast(k) if isinstance(x, pa.Array) else pa.array(x).cast(k) for x, k in zip(columns, _KINDS, strict=True)], names=_SCORES.names)

    return chunks.select("ids", *COLUMNS).mapInArrow(run, _SCORES)


_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
