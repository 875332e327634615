"""Language by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns
from salesmart.llm.steps import settled

#: The name for texts without a letter.
UNDETERMINED = "und"
#: Bytes of a text that are compressed together. A longer text is its own best dictionary, so all
#: its pieces are encoded apart and their sizes added.
PIECE_BYTES = 2048


def learn_dictionaries(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    size: int = 96 << 10,
    languages: int = 512,
    piece: int = 4000,
) -> dict[str, bytes]:
    """Raw content for each language: pieces of texts in the order of a hash of their content.

    The sample is bounded: at most ``size`` bytes for each of at most ``languages`` languages (more
    are refused), and that many wherever a language has them. It depends on the texts only, not on
    their order, partitions or ids. Texts are cut into pieces of ``piece`` characters, each of which
    may be taken, wherever in its text it lies. Null languages, and null and empty texts teach
    nothing; a piece that occurs several times is taken, and counted, once. Letters are lower-cased.
    The languages are in the order of how much text they have.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{int(piece)}}}"), F.lit(0))
    taught = docs.where(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0))
    taught = taught.select(F.col(lang).alias("lang"), F.explode(pieces).alias("text"))
    # Enough pieces for the size are those with the least hashes; the bound on the hash is set from
    # the distinct bytes of each language, so that few more rows than needed reach the final sort.
    each = taught.select("lang", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("n")).distinct()
    totals = each.groupBy("lang").agg(F.sum("n").alias("bytes"))
    found = totals.limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages")
    learned: dict[str, bytes] = {}
    if not found:
        return learned
    # Pieces differ in length: 32 of the longest at least, so that the expected excess is never missed.
    wanted = max(4.0 * size, 32.0 * 4 * piece)
    share = {row["lang"]: min(1.0, wanted / row["bytes"]) for row in found}
    bound = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))))
    order = F.xxhash64("text")
    few = (
        taught.where(F.pmod(order, F.lit(1_000_000)) <= bound[F.col("lang")])
        .select("lang", "text", F.pmod(order, F.lit(1_000_000)).alias("place"))
        .distinct()
    )
    few = settled(few, "pieces")  # one scan of the texts for all languages
    for row in sorted(found, key=lambda r: (-r["bytes"], r["lang"])):
        # Ordered by hash and text, cut at the size: a top-k, not a sort of all rows.
        rows = few.where(F.col("lang") == row["lang"]).orderBy("place", "text").limit(size)
        parts, held = [], 0
        for taken in rows.toLocalIterator():
            part = taken["text"].lower().encode()
            parts.append(part[: size - held])
            held += len(part)
            if held >= size:
                break
        learned[row["lang"]] = b"\n".join(reversed(parts))  # what comes last costs least
    return learned


class Dictionaries:
    def __init__(self, contents: dict[str, bytes], level: int):
        self.languages = list(contents)
        self.compressors = []
        for name in self.languages:
            raw = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=raw, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        sizes = [0] * len(self.compressors)
        for start in range(0, len(data), PIECE_BYTES):
            piece = data[start : start + PIECE_BYTES]
            for k, compressor in enumerate(self.compressors):
                sizes[k] += len(compressor.compress(piece))
        return sizes


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(
    docs: DataFrame,
    contents: dict[str, bytes],
    *,
    text: str = "text",
    margin: float = 0.02,
    level: int = 9,
    columns: Sequence[str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """``docs`` with the predicted language of the whole ``text``, a score and whether to reject it.

    The prediction is the language whose dictionary gives the least bytes; of equal ones the first
    of ``contents``. Letters are lower-cased, as in the dictionaries. The score is 1 - least / second least size, scaled so that half of the bytes or less
    gives 1 (with one language only: 1). It is rejected if the second is larger by less than
    ``margin`` of its size. Null texts and texts without a letter are ``und`` with score 0, and
    rejected; so are all if nothing was learned. Repeated rows stay, other columns pass through,
    columns called as the new ones are replaced. The dictionaries have a fixed size and are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((contents, level))
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())

    def setup():
        known = Dictionaries(*shared.value)

        def judge(value: str | None) -> tuple[str, float, bool]:
            if not value or not known.languages or not _has_letter(value):
                return UNDETERMINED, 0.0, True
            sizes = known.sizes(value)
            best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
            rest = [s for k, s in enumerate(sizes) if k != best]
            gap = 1.0 - sizes[best] / min(rest) if rest else 1.0
            return known.languages[best], min(1.0, 2.0 * gap), gap < margin

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [judge(t) for t in texts.to_pylist()]
            return [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]

        return compute

    added = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)])
    return with_columns(docs, text, added, setup)


def fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key as text; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
