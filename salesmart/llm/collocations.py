"""Frequent phrases of each language, counted in tiles of pairs of ranked ids.

A phrase of n + 1 words is a pair of phrases of n words that overlap, so one step counts all lengths:

1. Texts become blocks of words of one language, each with a vocabulary of its own and the sequence of
   its words. Words are counted over the blocks; frequent ones get ids by rank of frequency.
2. A step takes the ids along each block and counts neighbouring pairs. Ids are cut into bands, pairs of bands
   are tiles. A block packs what it counted of each tile as sorted keys and counts. A tile of frequent ids
   is a small square that is summed by direct address with ``bincount``; a tile of rarer ids is wide and
   summed as sorted coordinates. Tiles with many bytes are summed in several groups first.
3. Frequent pairs are ranked again, and their ids are sent back to the blocks that hold them; these become the
   sequence for the next step.

A part of a frequent phrase is at least as frequent, so nothing is missed. All keys and ids travel
packed, in groups whose size the constants bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.batches import give_back
from salesmart.llm.exchange import pack, unpack
from salesmart.llm.steps import column, indexed, settled, small

#: Words of a block.
BLOCK_WORDS = 1 << 19
#: Bytes of a text that are split at once, and those of words that end a block.
STRETCH_BYTES, BLOCK_BYTES = 4 << 20, 64 << 20
#: Blocks of different languages that a task fills at a time hold this many words at most.
HELD_WORDS = 1 << 21
#: Ids along one side of a square tile, and the number of its bands.
SIDE, BANDS = 1 << 10, 16
#: Packed bytes of a tile in one group, and words of all texts for each part of the wide tiles.
GROUP_BYTES, WIDE_WORDS = 64 << 20, 1 << 27
#: Largest id; a pair of ids is one 64-bit key.
LARGEST = (1 << 32) - 1

# Bytes that end a piece, and the byte that stands for them (never part of UTF-8).
_ENDS, _BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + _BREAK * len(_ENDS)
)

BLOCKS = "block long, lang string, lead int, n_words long, words array<string>, counts array<long>, sequence binary"
STEPS = "block long, lang string, lead int, sequence binary"
PARTS = "lang string, tile long, block long, keys binary, counts binary"
ANSWERS = "block long, tile long, keys binary, ids binary"


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers of any order, by bytes of equal weight."""
    rows = values.astype(np.int64).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(rows.T).tobytes(), 1)


def _read_numbers(data: bytes) -> np.ndarray:
    rows = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(rows.T).view(np.int64).ravel()


# -- texts to blocks ------------------------------------------------------------------------


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in stretches, with ``_BREAK`` between pieces."""
    spread = text.translate(_PLAIN).replace(_BREAK, b" " + _BREAK + b" ")
    start = 0
    while start < len(spread):
        end = start + STRETCH_BYTES
        end = spread.find(b" ", end) if end < len(spread) else -1
        end = len(spread) if end < 0 else end
        yield [w for w in spread[start:end].split(b" ") if w]
        start = end


class _Block:
    """Words of one language as they come; ids are local to the block."""

    def __init__(self, reach: int, most: int, lead: Sequence[bytes] = ()):
        self.reach, self.most = reach, most
        self.index: dict[bytes, int] = {_BREAK: 0}
        self.number = count(1)
        self.lead = len(lead)
        self.parts: list[np.ndarray] = []
        self.size = self.bytes = 0
        self.tail: list[bytes] = []
        if lead:
            self.add(list(lead))

    def add(self, words: list[bytes]) -> None:
        index, number = self.index, self.number
        for word in words:
            if word not in index:
                index[word] = next(number)
                self.bytes += len(word)
        self.parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.tail = [*self.tail, *words[-self.reach :]][-self.reach :]

    @property
    def full(self) -> bool:
        return self.size >= self.most or self.bytes >= BLOCK_BYTES

    def context(self) -> list[bytes]:
        """The words of the last piece that a phrase may still begin with."""
        tail = self.tail
        cut = max((i + 1 for i, w in enumerate(tail) if w == _BREAK), default=0)
        return tail[cut:]

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        sequence = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        counts = np.bincount(sequence[self.lead :], minlength=len(self.index))[1:]
        words = list(self.index)[1:]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([lang], pa.string()),
                pa.array([self.lead], pa.int32()),
                pa.array([int(counts.sum())], pa.int64()),
                pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([_numbers(sequence - 1)], pa.binary()),
            ],
            names=["block", "lang", "lead", "n_words", "words", "counts", "sequence"],
        )


def blocks(docs: DataFrame, text: str, lang: str, reach: int, most: int = BLOCK_WORDS) -> DataFrame:
    """Rows of BLOCKS, each of about ``most`` words.

    A long piece that is cut goes on in a block that begins with its last ``reach`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Block] = {}
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for own, value in zip(languages, batch.column("text"), strict=True):
                for words in tokens(value.as_buffer().to_pybytes() if value.is_valid else b""):
                    block = open_.setdefault(own, _Block(reach, most))
                    block.add(words)
                    if block.full:
                        yield block.row(next(number), own)
                        open_[own] = _Block(reach, most, block.context())
                if own in open_:
                    open_[own].add([_BREAK])
            if sum(b.size for b in open_.values()) > HELD_WORDS:
                for own in list(open_):
                    yield open_.pop(own).row(next(number), own)
        while open_:
            own, block = open_.popitem()
            yield block.row(next(number), own)
        give_back()

    given = docs.select(
        F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).cast("binary").alias("text")
    )
    return given.mapInArrow(run, BLOCKS)


# -- ids of words ---------------------------------------------------------------------------


def _ranked(frequent: DataFrame, ties: list[str]) -> DataFrame:
    """``frequent`` with the ``id`` of each row in its language: its place by ``n``, from 0."""
    placed = settled(indexed(frequent, [F.col("lang"), F.col("n").desc(), *map(F.col, ties)]), "ranked")
    firsts = placed.groupBy("lang").agg(F.min("place").alias("first"))
    ranked = placed.join(F.broadcast(firsts) if firsts.count() <= 10_000 else firsts, "lang")
    return ranked.withColumn("id", F.col("place") - F.col("first")).drop("place", "first")


def _by_rank(blocked: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of STEPS with the ids of ``words`` (lang, word, id) along each block, -1 for others."""
    held = blocked.select("block", "lang", F.posexplode("words").alias("at", "word"))
    found = held.join(words.select("lang", "word", "id"), ["lang", "word"])
    # What a block gets is at most one pair for each of its words.
    found = found.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))
    rows = blocked.select("block", "lang", "lead", F.size("words").alias("size"), "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = np.full(row["size"].as_py() + 1, -1, np.int64)  # the last is that of breaks
                if row["at"].is_valid:
                    ids[row["at"].values.to_numpy()] = row["id"].values.to_numpy()
                sequence = ids[_read_numbers(row["sequence"].as_py())]
                yield _step(row["block"], row["lang"], row["lead"], sequence)
        give_back()

    return rows.join(found, "block", "left").mapInArrow(run, STEPS)


def _step(block: pa.Scalar, lang: pa.Scalar, lead: pa.Scalar, sequence: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block.as_py()], pa.int64()),
            pa.array([lang.as_py()], pa.string()),
            pa.array([lead.as_py()], pa.int32()),
            pa.array([_numbers(sequence)], pa.binary()),
        ],
        names=["block", "lang", "lead", "sequence"],
    )


# -- pairs in tiles -------------------------------------------------------------------------


def tile_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Number of the tile of each key; square tiles come first, wide ones are cut into ``parts``.

    The sides of wide tiles double, so each stands for about as many words, whatever the vocabulary.
    """
    a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(LARGEST)).astype(np.int64)
    square = (a // SIDE) * BANDS + b // SIDE
    wide = (_width(a) * 33 + _width(b)) * parts + (a * 31 + b) % parts
    return np.where((a < SIDE * BANDS) & (b < SIDE * BANDS), square, BANDS * BANDS + wide)


def _width(ids: np.ndarray) -> np.ndarray:
    """Doublings of an id beyond the square bands."""
    return np.ceil(np.log2(np.maximum(ids // (SIDE * BANDS) + 1, 1))).astype(np.int64)


def _neighbours(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a pair begins, and its key."""
    at = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
    return at, (sequence[at].astype(np.uint64) << np.uint64(32)) | sequence[at + 1].astype(np.uint64)


def _counted(steps: DataFrame, words: int, parts: int) -> DataFrame:
    """Rows of PARTS: what each block holds of each tile, for pairs of phrases of ``words`` words.

    Pairs that lie in the words a block begins with belong to the block before; they count 0 here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lead = batch.column("lead")[k].as_py()
                at, keys = _neighbours(_read_numbers(batch.column("sequence")[k].as_py()))
                own = at + words >= lead
                unique, place = np.unique(keys, return_inverse=True)
                if not len(unique):
                    continue
                counts = np.bincount(place[own], minlength=len(unique))
                tiles = tile_of(unique, parts)
                order = np.argsort(tiles, kind="stable")
                unique, counts, tiles = unique[order], counts[order], tiles[order]
                starts = np.flatnonzero(np.diff(tiles, prepend=-1))
                ends = [*starts[1:], len(tiles)]
                n = len(starts)
                block = batch.column("block")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("lang")[k].as_py()] * n, pa.string()),
                        pa.array(tiles[starts], pa.int64()),
                        pa.array([block] * n, pa.int64()),
                        pa.array([pack(unique[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([_numbers(counts[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["lang", "tile", "block", "keys", "counts"],
                )
        give_back()

    return steps.mapInArrow(run, PARTS)


def sum_tile(tile: int, packed: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and totals of a tile: by direct address in a square one, else by sorted coordinates."""
    if tile < BANDS * BANDS:
        base_a, base_b = (tile // BANDS) * SIDE, (tile % BANDS) * SIDE
        cells = np.zeros(SIDE * SIDE, np.int64)
        for keys, counts in packed:
            pairs = unpack(keys)
            a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(LARGEST)).astype(np.int64)
            address = (a - base_a) * SIDE + b - base_b
            if len(address) * 16 > SIDE * SIDE:
                cells += _whole(np.bincount(address, _read_numbers(counts), SIDE * SIDE))
            else:  # keys of a block are distinct, so few of them are added where they lie
                cells[address] += _read_numbers(counts)
        full = np.flatnonzero(cells)
        keys = ((full // SIDE + base_a).astype(np.uint64) << np.uint64(32)) | (full % SIDE + base_b).astype(np.uint64)
        return keys, cells[full]
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for more, further in packed:
        keys = np.concatenate([keys, unpack(more)])
        counts = np.concatenate([counts, _read_numbers(further)])
        if len(keys) > 1 << 20:
            keys, counts = _merged(keys, counts)
    return _merged(keys, counts)


def _whole(sums: np.ndarray) -> np.ndarray:
    """Sums of one block's counts, which a double holds exactly."""
    return sums.astype(np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _hot(parts: DataFrame) -> DataFrame | None:
    """``(lang, tile, shares)`` of the tiles that have too many bytes for one group."""
    size = F.octet_length("keys") + F.octet_length("counts")
    sizes = parts.select("lang", "tile", size.cast("long").alias("size")).groupBy("lang", "tile").agg(F.sum("size").alias("size"))
    shares = F.ceil(F.col("size") / GROUP_BYTES).cast("long").alias("shares")
    hot = settled(sizes.where(F.col("size") > GROUP_BYTES).select("lang", "tile", "size", shares), "hot")
    return None if hot.isEmpty() else hot


def _spread(parts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``parts`` with the ``share`` of their tile that each falls into, by its block."""
    if hot is None:
        return parts.withColumn("share", F.lit(0).cast("long"))
    joined = parts.join(small(hot.drop("size")), ["lang", "tile"], "left")
    return joined.withColumn("share", F.pmod(F.xxhash64("block"), F.coalesce("shares", F.lit(1)))).drop("shares")


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """``(lang, a, b, n)``: the pairs with at least ``least`` occurrences in all blocks."""

    def summed(rows: pa.Table, tile: int) -> tuple[np.ndarray, np.ndarray]:
        return sum_tile(tile, zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True))

    def partly(key: tuple, rows: pa.Table) -> pa.Table:
        lang, tile, share = (k.as_py() for k in key)
        keys, counts = summed(rows, tile)
        packed = (lang, tile, share, pack(keys), _numbers(counts))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array([value], kind) for value, kind in zip(packed, kinds, strict=True)]
        return pa.table(columns, names=["lang", "tile", "block", "keys", "counts"])

    def wholly(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = summed(rows, key[1].as_py())
        enough = counts >= least
        keys = keys[enough]
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(keys), pa.string()),
                "a": pa.array((keys >> np.uint64(32)).astype(np.int64)),
                "b": pa.array((keys & np.uint64(LARGEST)).astype(np.int64)),
                "n": pa.array(counts[enough]),
            }
        )

    now, before = counted, None
    while (hot := _hot(now)) is not None:
        size = hot.agg(F.sum("size")).first()[0]
        if before is not None and size > before // 2:
            break  # what is left are different keys, whose number the parts of a tile bound
        by = ("lang", "tile", "share")
        now, before = settled(_spread(now, hot).groupBy(*by).applyInArrow(partly, PARTS), "sums"), size
    return now.groupBy("lang", "tile").applyInArrow(wholly, "lang string, a long, b long, n long")


def _tiled(ranked: DataFrame, parts: int) -> DataFrame:
    """``(lang, tile, keys, ids)`` of ranked pairs (lang, a, b, id), packed; a tile is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.uint64) for c in ("a", "b"))
            tiles = tile_of((a << np.uint64(32)) | b, parts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("lang", "a", "b", "id")), pa.array(tiles)],
                names=["lang", "a", "b", "id", "tile"],
            )

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (rows[c].to_numpy().astype(np.uint64) for c in ("a", "b"))
        keys = (a << np.uint64(32)) | b
        order = np.argsort(keys)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()], pa.string()),
                "tile": pa.array([key[1].as_py()], pa.int64()),
                "keys": pa.array([pack(keys[order])], pa.binary()),
                "ids": pa.array([_numbers(rows["id"].to_numpy()[order])], pa.binary()),
            }
        )

    placed = ranked.select("lang", "a", "b", "id").mapInArrow(run, "lang string, a long, b long, id long, tile long")
    return placed.groupBy("lang", "tile").applyInArrow(gather, "lang string, tile long, keys binary, ids binary")


def _answered(steps: DataFrame, counted: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows of STEPS for the next step: the ids of the pairs along each block, -1 for others.

    A tile's ids meet the keys that blocks have of it, in as many groups as these need, and go back
    to each block for the keys that it holds.
    """
    hot = _hot(counted)
    asked = _spread(counted.select("lang", "tile", "block", "keys"), hot)
    copies = tiles.withColumn("share", F.lit(0).cast("long"))
    if hot is not None:
        joined = tiles.join(small(hot.drop("size")), ["lang", "tile"], "left")
        last = F.coalesce("shares", F.lit(1)) - 1
        copies = joined.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("shares")

    def answer(asking: pa.Table, known: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "tile": [], "keys": [], "ids": []}
        if known.num_rows and asking.num_rows:
            keys, ids = unpack(known["keys"][0].as_py()), _read_numbers(known["ids"][0].as_py())
            for block, tile, packed in zip(*(asking[c].to_pylist() for c in ("block", "tile", "keys")), strict=True):
                own = unpack(packed)
                at = np.searchsorted(keys, own)
                hit = keys[np.minimum(at, len(keys) - 1)] == own
                if hit.any():
                    for name, value in zip(out, (block, tile, pack(own[hit]), _numbers(ids[at[hit]])), strict=True):
                        out[name].append(value)
        kinds = {"block": pa.int64(), "tile": pa.int64(), "keys": pa.binary(), "ids": pa.binary()}
        return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})

    by = ("lang", "tile", "share")
    answers = asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(answer, ANSWERS)

    def follow(step: pa.Table, found: pa.Table) -> pa.Table:
        batches = []
        for k in range(step.num_rows):
            sequence = _read_numbers(step["sequence"][k].as_py())
            at, pairs = _neighbours(sequence)
            after = np.full(max(0, len(sequence) - 1), -1, np.int64)
            if found.num_rows and len(at):
                keys = np.concatenate([unpack(x) for x in found["keys"].to_pylist()])
                ids = np.concatenate([_read_numbers(x) for x in found["ids"].to_pylist()])
                order = np.argsort(keys)
                keys, ids = keys[order], ids[order]
                place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                after[at] = np.where(keys[place] == pairs, ids[place], -1)
            batches.append(_step(step["block"][k], step["lang"][k], step["lead"][k], after))
        if not batches:
            kinds = [("block", pa.int64()), ("lang", pa.string()), ("lead", pa.int32()), ("sequence", pa.binary())]
            return pa.schema(kinds).empty_table()
        return pa.Table.from_batches(batches)

    return steps.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(follow, STEPS)


# -- phrases --------------------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame,
    *,
    least: int = 30,
    longest: int = 4,
    text: str = "text",
    lang: str = "lang",
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Words of each language, and its phrases of 2 to ``longest`` words with ``least`` occurrences.

    The first frame is ``(lang, n)``: all occurrences of words. The others have ``lang``, ``id``, ``n``, the ids
    ``a`` and ``b`` of the phrases without the last and the first word, and for each length the ``words``.
    Under 1 stand the frequent words themselves. ``least`` must be 1 or more.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more, longest 2 or more")
    made = settled(blocks(docs, text, lang, longest - 1, block_words), "blocks")
    words = made.agg(F.sum("n_words")).first()[0]
    totals = made.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    parts = max(1, (words or 0) // WIDE_WORDS)
    each = made.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("k"))))
    counts = each.groupBy("lang", "word").agg(F.sum("k").alias("n")).where(F.col("n") >= least)
    phrases = {1: settled(_ranked(settled(counts, "words"), ["word"]), "words")}
    _check(phrases[1])
    steps = settled(_by_rank(made, phrases[1]), "steps")
    for length in range(2, longest + 1):
        counted = settled(_counted(steps, length - 1, parts), "counted")
        pairs = settled(_frequent(counted, least), "pairs")
        phrases[length] = settled(_ranked(pairs, ["a", "b"]), "phrases")
        _check(phrases[length])
        if length < longest:
            steps = settled(_answered(steps, counted, _tiled(phrases[length], parts)), "steps")
    return totals, phrases


def _check(phrases: DataFrame) -> None:
    largest = phrases.agg(F.max("id")).first()[0]
    if largest is not None and largest > LARGEST:
        raise OverflowError("more than 2**32 frequent phrases of one length and language")


def collocations(
    docs: DataFrame,
    *,
    least: int = 30,
    longest: int = 4,
    covered: tuple[int, int] = (80, 100),
    text: str = "text",
    lang: str = "lang",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: the phrases of 2 to ``longest`` words, scored.

    Texts are split into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs; A-Z count as lower
    case. ``a`` counts a phrase, ``n`` all words of its language. Of all cuts in two parts the one with the least score
    ``2000000 * a div (l + r)`` counts, the first of equal ones; ``l`` and ``r`` count its parts. Phrases that
    lie in a longer one with at least ``covered`` (80 of 100) of their occurrences are left out.

    A null language is ``und``. Null and empty texts have no words; repeated rows count each; other columns are not used; an
    empty table gives no rows. Texts are UTF-8. Frequent words and phrases of a language may be 2**32 of each length.
    """
    totals, phrases = frequent_phrases(
        docs, least=least, longest=longest, text=text, lang=lang, block_words=block_words
    )
    # What a phrase of each length knows: its words, and the counts of all parts that begin or end it.
    known = phrases[1].select("lang", "id", F.col("word").alias("phrase"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    scored, inside = {}, {}
    for length in range(2, longest + 1):
        first = known.select("lang", F.col("id").alias("a"), F.col("phrase").alias("left"), "heads")
        second = known.select("lang", F.col("id").alias("b"), F.col("phrase").alias("right"), "tails")
        joined = phrases[length].join(first, ["lang", "a"]).join(second, ["lang", "b"])
        last = F.substring_index("right", " ", -1)
        known = joined.select(
            "lang",
            "id",
            "n",
            F.concat_ws(" ", "left", last).alias("phrase"),
            # Counts of the first 1, 2, ... words, and of the last 1, 2, ...
            F.concat("heads", F.array("n")).alias("heads"),
            F.concat("tails", F.array("n")).alias("tails"),
        )
        known = settled(known, "known")
        scored[length] = _scored(known, length)
        ends = (phrases[length].select("lang", F.col(c).alias("id"), "n") for c in ("a", "b"))
        inside[length - 1] = reduce(DataFrame.unionByName, ends)
    kept = []
    few, many = (F.lit(x).cast("decimal(18,0)") for x in covered)
    for length, frame in scored.items():
        if length in inside:
            # Of all longer phrases that hold this one, one with a single word more is the most frequent.
            most = inside[length].groupBy("lang", "id").agg(F.max("n").alias("longer"))
            whole = F.col("longer").cast("decimal(20,0)") * many >= F.col("count").cast("decimal(20,0)") * few
            frame = frame.join(most, ["lang", "id"], "left").where(~F.coalesce(whole, F.lit(False)))
        kept.append(frame.select("lang", "phrase", F.col("count").alias("a"), "l", "r", "score"))
    every = reduce(DataFrame.unionByName, kept)
    return every.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def _scored(known: DataFrame, length: int) -> DataFrame:
    """With the lowest-scoring cut, of equal ones that after the fewest words."""
    exact = "decimal(38,0)"

    def cut(k: int):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        parts = left.cast(exact) + right.cast(exact)
        times = F.col("n").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
        return F.struct(
            F.call_function("div", times, parts).alias("score"),
            F.lit(k).alias("k"),
            left.alias("l"),
            right.alias("r"),
        )

    cuts = [cut(k) for k in range(1, length)]
    best = (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("best")
    return known.select("lang", "id", "phrase", F.col("n").alias("count"), best).select(
        "lang", "id", "phrase", "count", "best.score", "best.l", "best.r"
    )


def top(found: DataFrame, limit: int = 2000) -> DataFrame:
    """The first ``limit`` of each language with their ``rank``: by score, count, then phrase."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
