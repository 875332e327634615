"""Byte-level BPE by a merge automaton.

The automaton reads tokens. It starts as one state with a loop for each of the 256 bytes, which
accepts every way to spell a text. The merges are then applied in order. The gadget of the merge
``u v -> w`` sends the arcs ``u`` to a copy of their target without the arc ``v``, and gives each
state with an arc ``u`` an arc ``w`` to the target of ``v``. So ``u v`` can no longer be read and
``w`` can instead: what stays accepted is one spelling of each text, the one BPE chooses.

All arcs with the same token lead to the same state at any time, so a state is named by the token
read last. A copy shares all arcs of its original but the removed one, so only removals are kept,
with the rank of the merge that made them; ``w`` starts with those that ``v`` has at its birth.
Arcs that a text asks for are looked up there once and then stand in a transition table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns

#: Fixed value: the pattern that byte-level tokenizers split a text with before merging.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The same pattern for texts of Latin letters, for which the standard library has the classes; and
#: what it does not hold for: separators, fractions and superscripts, and characters from U+0250.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_RARE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: Distinct words and arcs remembered by a task; beyond that the memory starts anew.
CACHED = 1 << 18
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """``labels``: bytes of each token id; ``merges``: pairs of ids in order, with their result."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.labels = labels
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for rank, (u, v, w) in enumerate(merges):
            self._gadget(rank, u, v, w)
        self.sizes = {token: len(label) for token, label in labels.items()}
        self.widest = max(self.sizes.values(), default=0)
        self.trie, self.longest, self.shorter = self._trie()
        self.arcs: dict[int, bool] = {}  # by last token << 20 | token

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.has_arc(u, v):
            self.removed[u, v] = rank
            if w not in self.born:
                self.born[w], self.left[w], self.right[w] = rank, u, v

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc ``token``.

        That arc stems from the arc of a byte through the births of ``token`` and of its left
        parts. It is missing if, before the next birth, a merge removed one of them from the state
        or from the one that the state was copied from.
        """
        left, right, removed, born = self.left, self.right, self.removed, self.born
        state, until = last, _NEVER
        while True:
            part, before = token, _NEVER
            while True:
                rank = removed.get((state, part), _NEVER)
                if rank < until and rank <= before and rank != _NEVER:
                    return False
                if part not in left:
                    break
                part, before = left[part], born[part]
            if state not in right:
                return True
            state, until = right[state], born[state]

    def _trie(self) -> tuple[ahocorasick.Automaton, dict[str, int], dict[int, int]]:
        """Transitions over bytes, written as characters; for each node the longest token on the
        way to it, and for each token the longest other one that is a prefix of it."""
        tokens = {
            label.decode("latin-1"): token
            for token, label in self.labels.items()
            if label and (len(label) == 1 or token in self.born)
        }
        trie = ahocorasick.Automaton()
        longest: dict[str, int] = {}
        shorter: dict[int, int] = {}
        for name, token in tokens.items():
            trie.add_word(name, token)
            last = -1
            for end in range(1, len(name) + 1):
                node = name[:end]
                if end == len(name):
                    shorter[token] = last
                last = longest[node] = tokens.get(node, last)
        return trie, longest, shorter

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of the only accepted spelling of ``word``.

        From each place the longest token with an arc is read first; where that leads nowhere, the
        last one is taken back and a shorter one read. Each prefix of a word has one accepted
        spelling only, so a place that led nowhere does so again, and is not entered twice.
        """
        arcs, has_arc, sizes, shorter = self.arcs, self.has_arc, self.sizes, self.shorter
        reach, longest, widest = self.trie.longest_prefix, self.longest, self.widest
        if len(arcs) > 2 * CACHED:
            arcs.clear()
        text = word.decode("latin-1")
        n, ids, at, before = len(word), [], 0, -1
        closed: set[int] = set()
        token = longest.get(text[: reach(text[:widest])], -1)
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in closed:
                    if before < 0:
                        break
                    allowed = arcs.get(before << 20 | token)
                    if allowed is None:
                        allowed = arcs[before << 20 | token] = has_arc(before, token)
                    if allowed:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, before = end, token
                rest = text[at : at + widest]
                token = longest.get(rest[: reach(rest)], -1)
            elif ids:
                closed.add(at)
                token = ids.pop()
                before = ids[-1] if ids else -1
                at -= sizes[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return ids


class ByteBpe:
    """A vocabulary file of the tokenizers library, of kind byte-level BPE."""

    def __init__(self, config: dict):
        model = config["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        # Ids stand in for tokens; a merge whose parts or result have no id never applies.
        labels = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        merges = []
        for merge in model["merges"]:
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.automaton = MergeAutomaton(labels, merges)
        self.labels = labels | {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.words: dict[str, bytes] = {}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # Labels end to end, for decoding without a loop.
        size = max(self.labels, default=-1) + 1
        each = [self.labels.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(each), np.uint8)
        self.lengths = np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def split_words(self, text: str) -> list[str]:
        return (self.split if _RARE.search(text) else _FAST).findall(text)

    def _pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.cut is None:
            yield False, text
            return
        for k, piece in enumerate(self.cut.split(text)):
            if piece:
                yield bool(k % 2), piece

    def encode(self, text: str) -> np.ndarray:
        """Token ids as 32-bit numbers."""
        words, encode_word = self.words, self.automaton.encode_word
        out: list[bytes] = []
        for special, piece in self._pieces(text):
            if special:
                out.append(np.int32(self.special[piece]).tobytes())
                continue
            for word in self.split_words(piece):
                known = words.get(word)
                if known is None:
                    known = np.array(encode_word(word.encode("utf-8", "replace")), np.int32).tobytes()
                    if len(words) >= CACHED:
                        words.clear()
                    if len(word) <= 64:
                        words[word] = known
                out.append(known)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the arc labels; an id without a label adds nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        place = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.flat[place].tobytes().decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def _tokenizer(broadcast) -> ByteBpe:
    """Compiled once in a Python worker."""
    key = hash(broadcast.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(json.loads(broadcast.value))
    return _LOADED[key]


def _vocabulary(frame: DataFrame, path: str):
    """The file's text; vocabularies have a fixed size of a few MB, which is checked."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return frame.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole ``text``.

    ``vocabulary`` is a file on the driver. Null and empty texts have no ids (an empty array). Long
    texts and words are taken whole. Repeated rows stay, other columns pass through, and a column
    called as ``ids`` is replaced. An empty table stays empty.
    """
    shared = _vocabulary(docs, vocabulary)

    def setup():
        tokenizer = _tokenizer(shared)

        def compute(texts: pa.Array) -> list[pa.Array]:
            coded = [tokenizer.encode(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, coded)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(coded)))]

        return compute

    added = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return with_columns(docs, text, added, setup)


def round_trip(
    docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """What ``encode`` and then ``decode`` add, by one worker in one pass.

    Its words and arcs are forgotten when a task ends.
    """
    shared = _vocabulary(docs, vocabulary)

    def setup():
        tokenizer = _tokenizer(shared)
        tokenizer.words.clear()
        tokenizer.automaton.arcs.clear()

        def compute(texts: pa.Array) -> list[pa.Array]:
            coded = [tokenizer.encode(t or "") for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, coded)])
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(coded)))
            return [each, pa.array([tokenizer.decode(c) for c in coded], pa.string())]

        return compute

    added = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return with_columns(docs, text, added, setup)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ``ids``; null ids give an empty text, unknown ids nothing.

    Special tokens are written out. Bytes that are not UTF-8 become U+FFFD.
    """
    shared = _vocabulary(tokens, vocabulary)
    schema = T.StructType([T.StructField(text, T.StringType())])

    def setup():
        tokenizer = _tokenizer(shared)
        def compute(rows: pa.Array) -> list[pa.Array]:
            flat = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(rows).to_pylist())])
            each = (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))
            return [pa.array([tokenizer.decode(r) for r in each], pa.string())]

        return compute

    return with_columns(tokens, ids, schema, setup)
