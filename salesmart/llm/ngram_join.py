"""Join documents whose sets of word n-grams have a Jaccard similarity of at least num / den.

Each n-gram has an inverted list, the documents that have it. A document's partners are those that
occur T or more times in the lists of its n-grams. The rarest n - T + 1 of a document's n lists (its
prefix) must have any partner in one of them at least, so only these short lists are read to find
candidates; the other, long lists are probed for the candidates alone. Within a task this is done by
DivideSkip: the short lists are merged with a heap, and the longest ones searched by bisection.

Documents with equal sets are one class, of which the least id stands for all. To find the classes
that are connected, not all links are needed: each list first compares its members with its strongest
one only, the one whose n-grams are the most common, as the original of many near copies is. What
that leaves apart is compared with all others of its lists.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm import exchange
from salesmart.llm.batches import with_columns
from salesmart.llm.components import components
from salesmart.llm.steps import column, indexed, settled

#: Candidates of one document that a task compares at once, and n-grams of theirs.
CANDIDATES, CANDIDATE_SHINGLES = 256, 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DF = 1


@dataclass(frozen=True)
class Rule:
    """``words`` of an n-gram; two sets link if den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least(self, n: int) -> int:
        """What any partner of a set of ``n`` shares with it at least."""
        return -(-self.num * n // self.den)

    def needed(self, a: int, b: int) -> int:
        """What sets of these sizes share at least if they link."""
        return -(-self.num * (a + b) // (self.num + self.den))


class Shingles:
    """Sorted hashes of the distinct n-grams of a text's words."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1 << 17:
            known.clear()
        hashes = []
        for word in words:
            found = known.get(word)
            if found is None:
                found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
                known[word] = found
            hashes.append(found)
        each = np.array(hashes, np.uint64)
        n = max(1, len(each) - self.words + 1)
        total = np.full(n, len(each) if len(each) < self.words else self.words, np.uint64)
        for k in range(min(self.words, len(each))):
            total = exchange.mixed(total ^ each[k : k + n])
        return np.unique(total)


def set_digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``__set``, the digest of the set; null for an empty set."""

    def setup():
        shingles = Shingles(words)

        def compute(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles.of(t.encode("utf-8", "replace")) if t else () for t in texts.to_pylist()]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
            ]

        return compute

    added = T.StructType(
        [T.StructField("n_shingles", T.LongType()), T.StructField("__set", T.BinaryType())]
    )
    return with_columns(docs, text, added, setup)


_MEMBERS = "id long, n long, strength double, shingles binary, prefix array<long>, first long"


def _prefixes(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` (id, text): for each class (class, id, set) that can have partners its set and the prefix of its lists.

    Lists are ordered by their length and then by hash. Those of one document only cannot have a
    partner; they come first, so ``first`` is the place of the first of ``prefix`` in the order.
    """
    plan = exchange.layout(docs, "text", 0.16)
    dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64("id"), F.lit(plan.chunks)))
    wanted = classes.select(
        F.pmod(F.xxhash64("id"), F.lit(plan.chunks)).alias("chunk"), F.col("class").alias("name"), "id", "set"
    )
    buckets = plan.buckets

    def sets(table: pa.Table, chosen: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        named = (chosen.column(c).to_pylist() for c in ("id", "set", "name"))
        own = {(doc, digest): name for doc, digest, name in zip(*named, strict=True)}
        several = {doc for doc, _ in own}
        shingles, names, found = Shingles(rule.words), [], []
        for doc, text in zip(table.column("id").to_pylist(), exchange.texts(table, "text"), strict=True):
            if doc not in several:
                continue
            these = shingles.of(text)
            name = own.pop((doc, set_digest(these)), None) if len(these) else None
            if name is not None:  # repeated rows count once
                names.append(name)
                found.append(these)
        order = np.argsort(np.array(names, np.int64), kind="stable")
        return [names[i] for i in order], [found[i] for i in order]

    def keys(found: list[np.ndarray]) -> exchange.Grouped:
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return exchange.grouped(every, exchange.bucket_of(every, buckets))

    def send(table: pa.Table, chosen: pa.Table) -> pa.Table:
        chunk = (table if table.num_rows else chosen).column(0)[0].as_py()
        found = sets(table, chosen)[1] if table.num_rows and chosen.num_rows else []
        return exchange.blocks(chunk, _DF, keys(found))

    def order_lists(table: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("id", "n", "strength", "shingles", "prefix", "first")}
        is_class = np.array(rows.column("set").is_valid().to_pylist(), bool)
        chosen = rows.filter(pa.array(is_class))
        if table.num_rows and chosen.num_rows:
            ids, found = sets(table, chosen)
            group = keys(found)
            # Totals of repeated keys; a key of a single document has 0 here.
            total = exchange.answered(rows.filter(pa.array(~is_class)), _DF, group, totals=True)[1]
            each = np.maximum(total, 1)[group.group].astype(np.int64)
            start = 0
            for doc, these in zip(ids, found, strict=True):
                n = len(these)
                counts = each[start : start + n]
                start += n
                shared = counts > 1
                single = n - int(shared.sum())
                last = n - rule.least(n)  # the place of the last list of the prefix
                if single > last:
                    continue
                order = np.lexsort((these[shared], counts[shared]))[: last - single + 1]
                out["id"].append(doc)
                out["n"].append(n)
                out["strength"].append(float(np.log(counts).mean()))
                out["shingles"].append(these.tobytes())
                out["prefix"].append(these[shared][order].view(np.int64).tolist())
                out["first"].append(single)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    by_chunk = dealt.select("__chunk", "id", "text").groupBy("__chunk")
    sent = by_chunk.cogroup(wanted.groupBy("chunk")).applyInArrow(send, exchange.BLOCKS)
    told = exchange.answers(sent, totals=True)
    both = told.unionByName(wanted, allowMissingColumns=True)
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(order_lists, _MEMBERS)


def divide_skip(query: Sequence[int], lists: dict[int, Sequence[int]], least: int) -> dict[int, int]:
    """Number of the query's lists that each document is in, for those in ``least`` or more.

    ``lists`` are sorted. The longest lists, fewer than ``least``, are set aside; a document must be
    in ``least`` minus their number of the others, which a heap merges. The long ones are then
    searched for such documents only.
    """
    own = sorted((lists[k] for k in query if k in lists), key=len)
    if len(own) < least:
        return {}
    # The more the longest list has, the more is saved by not merging it.
    aside = min(least - 1, int(least / (0.01 * log2(max(2, len(own[-1]))) + 1)))
    short, long = own[: len(own) - aside], own[len(own) - aside :]
    found: dict[int, int] = {}

    def settle(doc: int, count: int) -> None:
        if count < least - aside:
            return
        for k, entries in enumerate(long):
            at = bisect_left(entries, doc)
            if at < len(entries) and entries[at] == doc:
                count += 1
            if count + len(long) - k - 1 < least:
                return
        if count >= least:
            found[doc] = count

    now, count = None, 0
    for doc in heapq.merge(*short):
        if doc != now:
            if now is not None:
                settle(now, count)
            now, count = doc, 0
        count += 1
    if now is not None:
        settle(now, count)
    return found


def _verified(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b)`` of the candidate ``pairs`` (a, b, m) that link; ``m`` is the size of ``b``.

    ``a`` is compared with blocks of its partners, of bounded number and size.
    """
    many, large = F.count(F.lit(1)) / CANDIDATES, F.sum("m") / CANDIDATE_SHINGLES
    sizes = pairs.groupBy(F.col("a").alias("x")).agg(F.ceil(F.greatest(many, large)).alias("parts"))
    parted = pairs.join(sizes, F.col("a") == F.col("x")).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    )
    right = parted.join(
        members.select(F.col("id").alias("y"), "shingles"), F.col("b") == F.col("y")
    ).select("a", "part", "b", "shingles")
    left = (
        parted.select(F.col("a").alias("q"), F.col("part").alias("q_part"))
        .distinct()
        .join(members.select(F.col("id").alias("z"), F.col("shingles").alias("own")), F.col("q") == F.col("z"))
        .select("q", "q_part", "own")
    )

    def compare(key, query: pa.Table, others: pa.Table) -> pa.Table:
        links: list[int] = []
        a = key[0].as_py()
        if query.num_rows and others.num_rows:
            own = np.frombuffer(query.column("own")[0].as_py(), np.uint64)
            ids = others.column("b").to_pylist()
            each = [np.frombuffer(s, np.uint64) for s in others.column("shingles").to_pylist()]
            sizes_ = [len(s) for s in each]
            every = np.concatenate(each)
            doc = np.repeat(np.arange(len(each)), sizes_)
            place = np.searchsorted(own, every)
            hit = own[np.minimum(place, len(own) - 1)] == every
            place, doc = place[hit], doc[hit]
            order = np.lexsort((doc, place))
            place, doc = place[order], doc[order]
            edges = np.flatnonzero(np.diff(place, prepend=-1))
            lists = {
                int(place[s]): doc[s:e].tolist()
                for s, e in zip(edges, [*edges[1:], len(place)], strict=True)
            }
            least = min(rule.needed(len(own), m) for m in sizes_)
            for k, shared in divide_skip(range(len(own)), lists, least).items():
                if rule.den * shared >= rule.num * (len(own) + sizes_[k] - shared):
                    links.append(ids[k])
        return pa.table({"a": pa.array([a] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return (
        left.groupBy("q", "q_part")
        .cogroup(right.groupBy("a", "part"))
        .applyInArrow(compare, "a long, b long")
    )


def _may_link(a: str, b: str, rule: Rule) -> Column:
    """The sizes allow a link, and so do the places of this list, if it is the first they share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    needed = F.ceil(F.lit(rule.num) * (n + m) / F.lit(rule.num + rule.den))
    left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num) & (left >= needed)


def links(members: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b)``: links that connect all classes which any links connect."""
    lists = settled(
        members.select(
            "id", "n", "strength", "first", F.posexplode("prefix").alias("at", "token")
        ).select("token", "id", "n", "strength", (F.col("first") + F.col("at")).alias("place")),
        "lists",
    )
    strongest = lists.groupBy("token").agg(
        F.max(F.struct("strength", (-F.col("id")).alias("order"), "id", "n", "place")).alias("p"),
        F.count(F.lit(1)).alias("members"),
    ).where(F.col("members") > 1).select("token", "p.id", "p.n", "p.place")
    strongest = settled(strongest, "strongest")
    first = (
        lists.alias("l").join(strongest.alias("s"), F.col("l.token") == F.col("s.token"))
        .where((F.col("l.id") != F.col("s.id")) & _may_link("l", "s", rule))
        .select(F.col("s.id").alias("a"), F.col("l.id").alias("b"), F.col("l.n").alias("m"))
        .distinct()
    )
    linked = settled(_verified(settled(first, "pairs"), members, rule), "links")

    # A list that holds a single component has nothing left to find.
    labels = settled(components(linked), "labels")
    labelled = settled(
        lists.join(labels, F.col("id") == F.col("node"), "left").select(
            "token", "id", "n", "place", F.coalesce("component", "id").alias("label")
        ),
        "labelled",
    )
    main = strongest.join(labels, F.col("id") == F.col("node"), "left").select(
        F.col("token").alias("list"), F.col("id").alias("pivot"), F.coalesce("component", "id").alias("main")
    )
    apart = labelled.join(main, F.col("token") == F.col("list")).where(F.col("label") != F.col("main"))
    apart = settled(apart.select("token", "id", "n", "place", "label", "pivot", "main"), "apart")
    second = (
        apart.alias("a").join(labelled.alias("b"), F.col("a.token") == F.col("b.token"))
        .where(
            (F.col("a.label") != F.col("b.label"))
            & (F.col("b.id") != F.col("a.pivot"))
            # Of two that are both apart from the main component one comparison is enough.
            & ((F.col("b.label") == F.col("a.main")) | (F.col("a.id") < F.col("b.id")))
            & _may_link("a", "b", rule)
        )
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("b.n").alias("m"))
        .distinct()
    )
    more = _verified(settled(second, "pairs"), members, rule)
    return linked.unionByName(more)


def join(
    docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text", group: str | None = None
) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id``, the least key reachable by links.

    Words are what white space separates, with A-Z lower-cased. A text with fewer words than an n-gram
    is one n-gram as a whole. Null texts and texts without words have an empty set and link with
    nothing. A null key links with nothing and has a null component. Equal sets always link, so
    repeated rows, and copies, are in one component. Keys are whole numbers and should be unique: of a key with several
    texts each row is judged by its own, and a column called ``group`` then tells apart components with the same least key
    (null without words or key). Other columns pass through, columns called as
    the new ones are replaced. An empty table stays empty.

    A text may have any length and a class any number of members: nothing is dropped or capped.
    """
    new = ("n_shingles", "component_id", "__row", "__text", (group or "component_id").lower())
    own = [c for c in docs.columns if c.lower() not in new]
    # Two hashes name a row, in opposite order, so that their bits add up.
    first, second = (column(key), column(text)), (column(text), column(key), F.lit(1))
    plain = docs.select(*map(column, own), F.xxhash64(*first).alias("__row"), F.xxhash64(*second).alias("__text"))
    texts = plain.select(
        column(key).cast("long").alias("id"), column(text).alias("text"), F.col("__row").alias("row"), F.col("__text").alias("row2")
    )
    signed = settled(
        _signatures(texts, "text", rule.words).select("id", "row", "row2", "n_shingles", F.col("__set").alias("set")),
        "sets",
    )
    # A class is numbered in the order of its least key, so the least class of a component has its least key.
    classes = signed.where(F.col("id").isNotNull() & F.col("set").isNotNull()).groupBy("set").agg(F.min("id").alias("id"))
    classes = settled(indexed(classes, [F.col("id"), F.col("set")], "class"), "classes")
    with_text = texts.where(F.col("id").isNotNull() & (F.length("text") > 0))
    members = settled(_prefixes(with_text, classes, rule), "members")
    found = components(links(members, rule))
    least = classes.select(F.col("class").alias("component"), F.col("id").alias("least"))
    grouped = classes.join(found, classes["class"] == found["node"], "left").select(
        "set", F.coalesce("component", "class").alias("component")
    ).join(least, "component")
    known = F.col("id").isNotNull()
    named = (
        signed.join(grouped, "set", "left")
        .groupBy("row", "row2")
        .agg(
            F.max("n_shingles").alias("n_shingles"),
            F.min(F.when(known, F.coalesce("least", "id"))).alias("component_id"),
            F.min(F.when(known, F.col("component"))).alias("__group"),
        )
    )
    met = (plain["__row"] == named["row"]) & (plain["__text"] == named["row2"])
    further = [F.col("__group").alias(group)] if group else []
    return plain.join(named, met, "left").select(*map(column, own), "n_shingles", "component_id", *further)
