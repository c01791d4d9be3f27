"""Language-model scoring by deleted interpolation of n-gram maximum-likelihood estimates.

P1(w) = l1 c(w) / N + (1 - l1) / (V + 1), and for each higher order P(w | h) = l(b) c(h, w) / c(h) + (1 - l(b)) P(w | h'), where h'
is the shorter context and b the bucket of the context's frequency c(h) (its power of two). An unseen context leaves all to
the lower order. The weights l of each order's buckets are learned by expectation-maximisation on held-out counts, order by order:
a share of the training documents is deleted from the counts that predict it: of 89 shares by a hash of the id, the first that
holds a document. So a table of any size has one, and one rule; of a few hundred documents or more it is the first of all.

Counts are not joined row by row. Documents are read in blocks of bounded size; a block asks once for each of its different
n-grams, in sorted arrays by the first bits of their hash, as rows of thousands of n-grams. Where so many blocks ask for one
range of hashes that a task could not hold them, groups of blocks are added up to larger blocks first, which ask anew with more
bits, and their answers are handed back: so the rows of a gigabyte stay as many and as full at any size of the input. What is
shuffled are distinct n-grams, pre-aggregated and packed, and no word is a hot key however frequent. Counts are exact but for
collisions of 62-bit hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.ids import with_long_id
from florilege.llm.storage import discard, materialize
from florilege.llm.textkernels import Words, mix, sliced, utf8

#: Tokens of a block at most, but for the last document.
BLOCK_TOKENS = 1_000_000
#: Documents with crc32 mod TEST_MOD = TEST_REST are never learned from; of the others, one share in DELETED is held out for the weights.
TEST_MOD, TEST_REST, DELETED = 7, 2, 89
EM_ROUNDS, FLOOR = 60, 1e-6
#: Tokens of the longest n-gram.
ORDER = 3
#: Bins per octave of the estimates in the held-out histogram, which holds the exact sum of what falls into a bin.
_BINS = 4
#: N-grams that a task answers at most. Bits by which hashes are dealt out at least, for the sake of parallel tasks, and by
#: which a step of asking deals them out at most: so many that a row of a whole block still has some hundred n-grams.
TASK_GRAMS, LEAST_BITS, STEP_BITS = 3_000_000, 6, 13
_END, _START = np.uint64(0x6C62272E07BB0142), np.uint64(0x27D4EB2F165667C5)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _compress(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes: high bytes of small numbers and of sorted differences are runs."""
    import zstandard

    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        packed = zstandard.ZstdCompressor(3).compress(planes)
        out += [struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(packed)), packed]
    return b"".join(out)


def _expand(raw: bytes) -> list[np.ndarray]:
    import zstandard

    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    for _ in range(n):
        kind, size, packed = struct.unpack_from("<2sqq", raw, at)
        at += struct.calcsize("<2sqq")
        planes = zstandard.ZstdDecompressor().decompress(raw[at : at + packed]) if size else b""
        dtype = np.dtype("<" + kind.decode())
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, size).T).view(dtype).ravel() if size else np.zeros(0, dtype))
        at += packed
    return out


def _grams(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that end at each token; a document begins after start marks."""
    first = np.cumsum(sizes) - sizes
    out, ending = [], tokens
    for order in range(1, ORDER + 1):
        if order > 1:
            before = np.empty_like(ending)
            before[1:] = ending[:-1]
            before[first] = _START + np.uint64(order)
            ending = mix(before * _BASE + tokens)
        out.append((ending & ~np.uint64(3)) | np.uint64(order - 1))
    return out


class _Block:
    """Documents of a block: ids, roles and token hashes, an end token after each document's words."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: list[int | None], words: Words) -> None:
        at = words.first[1:]
        self.tokens.append(np.insert(words.hashes, at, _END))
        self.sizes.append(words.counts + 1)
        self.ids += ids
        self.n += len(self.tokens[-1])


def roles(ids: list[int | None], share: int = 0) -> np.ndarray:
    """0: training, 1: training and in the share that is held out for the weights, 2: test. A null id counts as an empty name."""
    crc = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)
    return np.where(crc % TEST_MOD == TEST_REST, 2, np.where(crc // TEST_MOD % DELETED == share, 1, 0))


def _stamp(tokens: np.ndarray) -> int:
    """A fingerprint of a block's tokens in order."""
    return int(np.bitwise_xor.reduce(mix(tokens + np.arange(len(tokens), dtype=np.uint64) * _BASE)).view(np.int64)) if len(tokens) else 0


def _pack_documents(ids: list[int | None], role: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> bytes:
    """A block's documents: different words by falling frequency, and each token's place among them."""
    word, index, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    none = np.array([i is None for i in ids])
    return _compress(np.array([i or 0 for i in ids], np.int64), none.astype(np.uint8), role.astype(np.uint8), sizes.astype(np.int64), word[order], place[index])


def _dealt(key: np.ndarray, n: np.ndarray, k: np.ndarray, prefix: int, bits: int, fan: int) -> Iterator[tuple[int, bytes]]:
    """Sorted n-grams with counts, dealt by the first ``bits`` of the hash; all share those but the last ``fan``, the prefix."""
    parts = (prefix << fan) + np.arange(1 << fan)
    cut = np.searchsorted(key, parts[1:].astype(np.uint64) << np.uint64(64 - bits))
    for part, a, b in zip(parts.tolist(), [0, *cut], [*cut, len(key)], strict=True):
        if b > a:
            yield part, _compress(np.diff(key[a:b], prepend=np.uint64(0)), n[a:b], k[a:b])


def _pack_requests(role: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, fan: int, counting: bool) -> Iterator[tuple[int, bytes]]:
    """Hash range, and its different n-grams with the block's counts: in training documents, and in those held out."""
    weight, held = (np.repeat(role != 2, sizes), np.repeat(role == 1, sizes)) if counting else (np.zeros(len(tokens), bool),) * 2
    keys, n, k = [], [], []
    for h in _grams(tokens, sizes):
        key, inverse = np.unique(h, return_inverse=True)
        keys.append(key)
        n.append(np.bincount(inverse[weight], minlength=len(key)).astype(np.uint32))
        k.append(np.bincount(inverse[held], minlength=len(key)).astype(np.uint32))
    key, n, k = (np.concatenate(x) for x in (keys, n, k))
    order = np.argsort(key)
    yield from _dealt(key[order], n[order], k[order], 0, fan, fan)


_ROWS = "block long, stamp long, part long, payload binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "stamp", "part", "payload"])


def _share_of() -> Column:
    """The share that a training document is in; null for others."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.when(crc % TEST_MOD != TEST_REST, F.floor(crc / TEST_MOD) % DELETED)


def first_share(docs: DataFrame) -> int:
    """The first share that holds a document; only ids are read."""
    return docs.agg(F.min(_share_of())).first()[0] or 0


def _held_out(share: int) -> Column:
    """Whether :func:`roles` is 1."""
    return F.coalesce(_share_of() == share, F.lit(False))


def _blocks(docs: DataFrame, bits: int | None, counting: bool, share: int = 0) -> DataFrame:
    """Rows ``block, stamp, part, payload`` of blocks: their requests by so many bits of the hash, or with None their documents.

    Blocks that ask without counting have negative numbers. A block is told by its task and number; the stamp makes sure that
    both passes saw the same documents in it.
    """

    def rows_of(number: int, held: _Block) -> Iterator[tuple[int, int, int, bytes]]:
        tokens, sizes, role = np.concatenate(held.tokens), np.concatenate(held.sizes), roles(held.ids, share)
        stamp, block = _stamp(tokens), number if counting else -number
        if bits is not None:
            yield from ((block, stamp, part, payload) for part, payload in _pack_requests(role, sizes, tokens, bits, counting))
        else:
            yield block, stamp, -1, _pack_documents(held.ids, role, sizes, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, _Block()

        def flush() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for row in rows_of(number, held):
                out.append(row)
                size += len(row[3])
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

        for batch in sliced(batches, "text"):
            number = number or (batch.column(2)[0].as_py() + 1) << 32
            held.add(batch.column(0).to_pylist(), Words(*utf8(batch.column(1)), lower=True))
            if held.n >= BLOCK_TOKENS:
                yield from flush()
                number, held = number + 1, _Block()
        if held.n:
            yield from flush()

    # the task's number within this scan: within the whole stage it would depend on what the scan is united with
    return docs.select("doc_id", "text", F.spark_partition_id().alias("task")).mapInArrow(run, _ROWS)


def _read(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The different n-grams of all rows, their places in each row, and the sums of both counts."""
    asked = [_expand(x.as_buffer().to_pybytes()) for x in table["payload"]]
    keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = [np.bincount(index, np.concatenate([a[i] for a in asked]), minlength=len(every)).astype(np.int64) for i in (1, 2)]
    at = np.cumsum([0, *map(len, keys)])
    return every, [index[a:b] for a, b in zip(at, at[1:], strict=False)], *totals


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


def _answers(table: pa.Table, places: list[np.ndarray], totals: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
    """A row for each row of ``table``, with the totals of its n-grams in the order asked."""
    names = zip(*(table[c].to_pylist() for c in ("block", "stamp", "part")), strict=True)
    return [(*name, _compress(*(_narrow(t[place]) for t in totals))) for name, place in zip(names, places, strict=True)]


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts over all blocks of a hash range, for each block in the order asked; and the range's totals as block 0."""
    every, places, n, k = _read(table)
    single = (every & np.uint64(3)) == 0
    sums = np.array([(n[single] > 0).sum(), n[single].sum(), (n > k)[single].sum(), k[single].sum()], np.int64)
    return pa.Table.from_batches([_batch([(0, 0, key[0].as_py(), _compress(sums)), *_answers(table, places, [n, k])])])


def _merge(groups: int, bits: int, fan: int):
    """A larger block out of the rows of a hash range and group: it asks for all their n-grams with their sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, group = (x.as_py() for x in key)
        every, _, n, k = _read(table)
        return pa.Table.from_batches([_batch([(1 + part * groups + group, 0, to, payload) for to, payload in _dealt(every, _narrow(n), _narrow(k), part, bits, fan)])])

    return run


def _hand_back(key: tuple[pa.Scalar, ...], asked: pa.Table, found: pa.Table) -> pa.Table:
    """The answers of a larger block, for each of the rows that it was made from."""
    if not asked.num_rows or not found.num_rows:
        raise RuntimeError("a range of hashes was asked and not answered, or the reverse")
    _, places, _, _ = _read(asked)
    order = np.argsort(np.asarray(found["part"]), kind="stable")
    got = [_expand(found["payload"][int(i)].as_buffer().to_pybytes()) for i in order]
    return pa.Table.from_batches([_batch(_answers(asked, places, [np.concatenate([g[i].astype(np.int64) for g in got]) for i in (0, 1)]))])


def _bits(grams: int) -> int:
    """Bits of the hash ranges of which none is asked for more than ``TASK_GRAMS``."""
    return max(LEAST_BITS, (max(1, -(-grams // TASK_GRAMS)) - 1).bit_length())


def exchange(asked: DataFrame, grams: int, bits: int) -> DataFrame:
    """Answers to rows ``block, stamp, part, payload`` of requests for at most ``grams`` n-grams in all, by ``bits`` of their hash.

    The answers have the same columns; block 0 has totals. Where a range would be asked for more than ``TASK_GRAMS``, groups of
    its rows that are not become blocks of their own, whose requests are dealt by more bits.
    """
    last = _bits(grams)
    if bits >= last:
        return materialize(asked.groupBy("part").applyInArrow(_answer, _ROWS), "counts")
    groups, more = -(-grams // (TASK_GRAMS << bits)), min(last, bits + STEP_BITS)
    asked = materialize(asked, "asked")
    by = lambda rows: rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    larger = by(asked).groupBy("part", "group").applyInArrow(_merge(groups, more, more - bits), _ROWS)
    found = exchange(larger, grams, more)
    named = found.where("block > 0").withColumn("of", F.expr(f"(block - 1) div {groups}")).withColumn("group", F.col("block") - 1 - F.col("of") * groups)
    back = by(asked).groupBy("part", "group").cogroup(named.groupBy("of", "group")).applyInArrow(_hand_back, _ROWS)
    return materialize(back.unionByName(found.where("block = 0")), "counts")


class _Counts:
    """A block's documents with the corpus counts of their n-grams: ``c`` in training documents, ``k`` in those held out, by order."""

    def __init__(self, mine: pa.Table, answers: pa.Table):
        if mine.num_rows != 1 or not answers.num_rows:
            raise RuntimeError("the documents were not the same in both passes: score a written table")
        ids, none, self.role, self.sizes, word, index = _expand(mine["payload"][0].as_buffer().to_pybytes())
        self.ids = [None if x else i for i, x in zip(ids.tolist(), none.tolist(), strict=True)]
        order = np.argsort(np.asarray(answers["part"]), kind="stable")
        got = [_expand(answers["payload"][int(i)].as_buffer().to_pybytes()) for i in order]
        total, held = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in (0, 1))
        tokens = word[index]
        keys, places = zip(*(np.unique(h, return_inverse=True) for h in _grams(tokens, self.sizes)), strict=True)
        del got, tokens, word, index
        sort = np.argsort(np.concatenate(keys))
        at = np.empty(len(sort), np.int64)
        at[sort] = np.arange(len(sort))
        starts = np.cumsum([0, *map(len, keys)])
        where = [at[start : start + len(key)][place] for start, key, place in zip(starts, keys, places, strict=False)]
        self.c, self.k = ([x[w] for w in where] for x in (total, held))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.end = np.repeat(np.cumsum(self.sizes) - 1, self.sizes)  # of each token's document

    def estimates(self, tokens: int, less: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the buckets of the contexts and the maximum-likelihood estimates, with counts less those of ``less``.

        ``tokens`` is the number of all tokens so counted. What stands before a document is as frequent as its end mark.
        """
        c = [x - less[o] for o, x in enumerate(self.c)] if less is not None else self.c
        out = [(np.zeros(len(c[0]), np.int64), c[0] / max(tokens, 1))]
        for o in range(1, ORDER):
            before = np.empty_like(c[0])
            before[1:] = c[o - 1][:-1]
            before[self.first] = c[0][self.end[self.first]]
            out.append((bucket(before), np.where(before > 0, c[o] / np.maximum(before, 1), 0.0)))
        return out


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(c))."""
    return np.where(c > 0, np.frexp(c.astype(float))[1], 0)


def mixed(estimates: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], uniform: float) -> np.ndarray:
    """Probabilities by as many orders as have weights."""
    p = np.full(len(estimates[0][1]), uniform)
    for (b, ml), weight in zip(estimates, weights, strict=False):
        p = weight[b] * ml + (1 - weight[b]) * p
    return p


def expectation_maximisation(rows: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """An order's weight by bucket (0 to 64) from rows (bucket, estimate, lower order's probability, n) of held-out tokens.

    Weights stay a little below 1, so that nothing has no probability. A bucket that no held-out token showed takes the weight
    of the next lower one that some did, or 0; so does that of unseen contexts, whose estimates are all 0.
    """
    out, last = np.zeros(65), 0.0
    for b in range(65):
        own = rows[rows[:, 0] == b]
        if len(own):
            p, q, n = own[:, 1], own[:, 2], own[:, 3]
            w = 0.5
            for _ in range(rounds):
                w = (n * w * p / (w * p + (1 - w) * q)).sum() / n.sum()
            last = min(w, 1 - FLOOR)
        out[b] = last
    return out


def _deleted(tokens: int, held: int):
    """Packed buckets and estimates of the held-out tokens of a block, by counts without them."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Counts(left, right)
        own = np.repeat(c.role == 1, c.sizes)
        made = c.estimates(tokens - held, c.k)
        return pa.table([pa.array([_compress(*(x[own] for b, ml in made for x in (b.astype(np.uint8), ml)))])], names=["payload"])

    return run


def _binned(p: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of an octave's parts, 0 for no probability, and what the logarithms have beyond their bins, in parts of 2^-20 octaves."""
    some = p > 0
    log = np.log2(np.where(some, p, 1.0))
    at = np.rint(log * bins)
    return np.where(some, at + (1 << 14), 0).astype(np.int64), np.where(some, np.rint((log - at / bins) * (1 << 20)), 0).astype(np.int64)


def _learned(deleted: DataFrame, order: int, weights: list[np.ndarray], uniform: float) -> np.ndarray:
    """Weights of an order, those of the lower ones being given, from rows of :func:`_deleted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                flat = _expand(payload.as_buffer().to_pybytes())
                made = [(b.astype(np.int64), ml) for b, ml in zip(flat[::2], flat[1::2], strict=True)]
                (p, p_off), (q, q_off) = _binned(made[order][1], _BINS), _binned(mixed(made, weights, uniform), _BINS)
                keys, index, n = np.unique(made[order][0] << 32 | p << 16 | q, return_inverse=True, return_counts=True)
                sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
                for total, off in zip(sums, (p_off, q_off), strict=True):
                    np.add.at(total, index, off)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, n, *sums)], ["key", "n", "p", "q"])

    rows = deleted.mapInArrow(run, "key long, n long, p long, q long")
    rows = rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "p", "q"))).collect()  # bounded: buckets times bins of two probabilities
    table = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 4)
    value = lambda at, off: np.where(at > 0, np.exp2((at - (1 << 14)) / _BINS + off / (table[:, 1] * (1 << 20))), 0.0)
    key = table[:, 0]
    return expectation_maximisation(np.stack([key >> 32, value(key >> 16 & 0xFFFF, table[:, 2]), value(key & 0xFFFF, table[:, 3]), table[:, 1]], axis=1).astype(float))


def _scores(weights: list[np.ndarray], tokens: int, words: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        c = _Counts(left, right)
        p = mixed(c.estimates(tokens), weights, 1 / (words + 1))
        base = np.log10((c.c[0] + 1) / (tokens + words + 1))
        sums = [np.add.reduceat(x, c.first) for x in (np.log10(p), base, (c.c[0] > 0).astype(np.int64))]
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.role == 2), pa.array(c.sizes, pa.int64()), pa.array(sums[2], pa.int64()), pa.array(np.full(len(c.ids), tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[0])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _most_grams(docs: DataFrame, share: int = 0) -> int:
    """A bound of the n-grams that blocks can ask for: white space is counted, of which there is one less than words at least."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.length(text) - F.length(F.translate(text, "\x20\t\n\x0b\x0c\r", "")) + 2
    return ORDER * (docs.agg(F.sum(tokens * F.when(_held_out(share), 2).otherwise(1))).first()[0] or 0)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words with A-Z lowered, then one end. A null text counts as empty (one token); null ids are kept; repeated rows
    are learned from and scored each; other columns are ignored, whatever their names. Without training documents only the
    uniform part is left, and scores are 0 times log10(1). Where all training documents are held out for the weights, as a
    lone one is, no estimate predicts them, and the uniform part alone is left too. An empty table gives no rows.

    ``docs`` is read twice, once for the n-grams and once for the documents to be scored, rather than kept: it should be a
    table as written, whose tasks see the same rows each time. If they don't, the job fails; it never mixes counts up.
    """
    docs = with_long_id(docs.select("doc_id", "text"))
    share = first_share(docs)
    deleted = docs.where(_held_out(share))
    grams = _most_grams(docs, share)
    bits = min(STEP_BITS, _bits(grams))
    asked = _blocks(docs, bits, True, share).unionByName(_blocks(deleted, bits, False, share))
    answered = exchange(asked, grams, bits)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(_expand(x.as_buffer().to_pybytes())[0] for x in table["payload"])
        return pa.table([pa.array([int(x)]) for x in total], names=["words", "tokens", "del_words", "held"])

    sums = answered.where("block = 0").withColumn("some", F.pmod("part", F.lit(64))).groupBy("some").applyInArrow(add, "words long, tokens long, del_words long, held long")
    words, tokens, del_words, held = (int(x or 0) for x in sums.agg(*(F.sum(c) for c in ("words", "tokens", "del_words", "held"))).first())
    found = answered.where("block != 0")

    def by_block(rows: DataFrame, counting: bool, run, schema: str) -> DataFrame:
        answers = found.where(F.col("block") > 0 if counting else F.col("block") < 0)
        return _blocks(rows, None, counting, share).groupBy("block", "stamp").cogroup(answers.groupBy("block", "stamp")).applyInArrow(run, schema)

    weights: list[np.ndarray] = []
    if tokens:
        sample = materialize(by_block(deleted, False, _deleted(tokens, held), "payload binary"), "held-out")
        for order in range(ORDER):
            weights.append(_learned(sample, order, weights, 1 / (del_words + 1)))
        discard(sample.sparkSession, sample)
    return by_block(docs, True, _scores(weights, tokens, words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
