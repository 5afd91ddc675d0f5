"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

A plain index of m * m tables needs m * m groups of hashes. Here two collections of m groups are computed, and table
(i, j) is keyed by group i of the first with group j of the second: the same number of tables for about a square root
of the hashing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import MOST_SLOTS, Repeats, bloom_slots, gather_filters, give_back_memory, id_filter, packed, portions, saved, small_batches, unpacked, words_of
from gridloom.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Banding:
    """``groups`` groups in each collection, of ``rows`` minhashes each. At likeness s a pair meets with (1 - (1 - s^rows)^groups)^2: 0.9996 at 0.8."""

    groups: int = 16
    rows: int = 4
    seed: int = 11

    def multipliers(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**63, 2 * self.groups * self.rows, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return (h ^ (h >> np.uint64(29))) * _MIX[1]


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's k-word shingles; with fewer words the whole sequence is one, without words there is none."""
    number: dict[bytes, int] = {}
    seqs = []
    for t in texts:
        ws = words_of(t)
        seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    out = []
    for s in seqs:
        n = len(s)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h, width = word[s], min(n, k)
        acc = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            acc = (acc ^ h[j : n - width + 1 + j]) * _MIX[2]
            acc ^= acc >> np.uint64(32)
        out.append(np.unique(_mix(acc)))
    return out


def signatures(sets: list[np.ndarray], banding: Banding) -> np.ndarray:
    """One 64-bit key for each group of both collections (documents x 2 * groups); 0 for empty sets."""
    out = np.zeros((len(sets), 2 * banding.groups), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    for at in range(0, len(full), 256):
        part = full[at : at + 256]
        flat, starts = np.concatenate([sets[i] for i in part]), np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        for g in range(2 * banding.groups):
            key = np.full(len(part), g + 1, np.uint64)
            for m in banding.multipliers()[g * banding.rows : (g + 1) * banding.rows]:
                key = (key ^ np.minimum.reduceat(flat * m, starts)) * _MIX[2]
                key ^= key >> np.uint64(32)
            out[part, g] = _mix(key)
    return out


def _pack_set(s: np.ndarray) -> bytes:
    """Ascending distinct hashes as differences, in byte planes."""
    planes = np.diff(s, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_set(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8"), dtype=np.uint64)


def _frequencies(sets: DataFrame, most: int = 1 << 23) -> np.ndarray:
    """About how many of ``sets`` hold a shingle, never less, by its hash modulo the length of the result (16 MB at most)."""
    slots = bloom_slots(sets.agg(F.sum("size")).first()[0] or 0, 4, most=most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.uint32)
        for b in batches:
            for s in b.column(0).to_pylist():
                np.add.at(n, (_unpack_set(s) & np.uint64(slots - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict({"f": [packed(np.minimum(n, 65535).astype(np.uint16).tobytes())]})
        give_back_memory()

    def add(a: bytes, b: bytes) -> bytes:
        n = np.frombuffer(a, np.uint16).astype(np.uint32) + np.frombuffer(b, np.uint16)
        return np.minimum(n, 65535).astype(np.uint16).tobytes()

    return np.frombuffer(unpacked(gather_filters(sets.select("set").mapInArrow(count, "f binary"), 8 * slots, merge=add)), np.uint16)


def _rarest(s: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The shingles, rarest first, of which a set shares at least one with every set linked to it.

    A linked set has at least percent / 100 of this one's shingles, so in one order of all shingles it cannot lack all of
    the first n - ceil(n * percent / 100) + 1. Any order is right; by rising frequency few sets meet.
    """
    f = frequency[(s & np.uint64(len(frequency) - 1)).astype(np.int64)]
    return s[np.lexsort((s, f))[: len(s) + (-percent * len(s)) // 100 + 1]]


def _linkable(sets: DataFrame, frequency: np.ndarray, id_type: str, percent: int) -> DataFrame:
    """Every pair a < b of different components of ``sets`` (id, set, component) that can be linked, and some that cannot."""
    given = sets.sparkSession.sparkContext.broadcast(frequency)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                full = [_unpack_set(s) for s in part.column("set").to_pylist()]
                rare = [_rarest(s, given.value, percent) for s in full]
                # a shingle of one set alone (a frequency is never too low) keeps its place, but meets nothing
                met = [np.flatnonzero(given.value[(r & np.uint64(len(given.value) - 1)).astype(np.int64)] > 1) for r in rare]
                row = pa.array(np.repeat(np.arange(len(full)), [len(m) for m in met]).astype(np.int64))
                shingle = np.concatenate([r[m] for r, m in zip(rare, met, strict=True)]).view(np.int64)
                n = np.repeat([len(s) for s in full], [len(m) for m in met]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), part.column("id").take(row), part.column("component").take(row), pa.array(n), pa.array(np.concatenate(met).astype(np.int64))], ["shingle", "id", "component", "n", "place"])
        give_back_memory()

    rare = saved(sets.select("id", "set", "component").mapInArrow(spread, f"shingle long, id {id_type}, component {id_type}, n long, place long"), "rare")
    sizes = rare.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    met = saved(rare.join(saved(largest.select("shingle", F.col("most.component").alias("largest")), "largest"), "shingle"), "met")
    # Members of a shingle's largest component never meet each other. From the first shingle that two sets share, they have
    # in common at most what follows its places in both.
    x, y = met.where("component <> largest").alias("x"), met.alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    common = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    near = common * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & once & near)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, banding: Banding = Banding(), heads: int = 4, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of k-word shingles (A-Z lower-cased,
    words ``[^\\x20\\x09-\\x0D]+``); component_id is the least id reachable. Equal sets are one node from the start. Two Bloom
    filters leave only group keys that may be shared; their pairs form the table keys. In every table each document is
    checked against the table's least one, its hub. Where tables of three or more still hold several components, the
    documents outside the hub's are checked against ``heads`` members of one of these tables and one that is outside as well,
    turn by turn, as long as a turn halves what is left. Of the tables that are still mixed then, all documents of different components that can be linked at all (by the
    rarest shingles of each, see ``_rarest``) are checked, until none is left. So two documents that share a table and are
    near enough are always in one component; candidates grow with the square of a group only where its documents stay
    unlinked but share rare shingles. All links that count are confirmed on the full sets.

    Null or empty text, or text without words, has an empty set and links with nothing. A null id takes no part: its
    component_id is null and it is kept. Rows that repeat an id are one node, also where their texts differ: what any of them is
    linked to is linked to all of them, but for rows without words, which stand by themselves. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type, m = docs.schema[id_col].dataType.simpleString(), banding.groups
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, same, sig = [], [], []
            for part in portions(b.column("text").to_pylist()):
                sets = shingle_sets(part, k)
                sizes += [len(s) for s in sets]
                same += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig += [r.tobytes() for r in signatures(sets, banding)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "same", "sig"])
        give_back_memory()

    signed = saved(rows.mapInArrow(sign, f"doc_id {id_type}, n long, same binary, sig binary"), "minhash")
    classes = saved(signed.where("doc_id is not null and n > 0").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").select("same", "rep"), "classes")
    placed = saved(signed.join(classes, "same", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")), F.col("sig")).alias("sig")), "placed")
    nodes = placed.where("sig is not null and n > 0 and doc_id is not null").select("doc_id", "n", "sig")
    repeated = Repeats(nodes.select("sig"), lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64), nodes.count() * 2 * m, 8, most_slots)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _mix(np.arange(1, m * m + 1, dtype=np.uint64)).reshape(m, m)
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64)
            flag = repeated(sig).reshape(-1, 2 * m)
            sig = sig.reshape(-1, 2 * m)
            some = np.flatnonzero(flag[:, :m].any(1) & flag[:, m:].any(1))
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                both = flag[part, :m, None] & flag[part, None, m:]
                key = _mix(sig[part, :m, None] * _MIX[2] ^ sig[part, None, m:] ^ pair)
                at_doc = np.repeat(part, both.reshape(len(part), -1).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(key[both].view(np.int64)), b.column("doc_id").take(pa.array(at_doc)), b.column("n").take(pa.array(at_doc))], ["key", "id", "n"])

    keyed = nodes.mapInArrow(keys_of, f"key long, id {id_type}, n long")
    tables = saved(keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"), "tables")
    members = saved(keyed.join(tables, "key").select("key", "id", "n", "hub", "size"), "members")

    may_link = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    wanted = saved(members.select("id").distinct(), "wanted")
    member = id_filter(wanted, bloom_slots(wanted.count(), 16, most=most_slots))

    def pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for part in portions(b.column("text").to_pylist()) for s in shingle_sets(part, k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_pack_set(s) for s in sets], pa.binary())], ["id", "size", "set"])
        give_back_memory()

    sets = saved(rows.where(member(F.col("doc_id"))).mapInArrow(pack_sets, f"id {id_type}, size long, set binary"), "sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, last, left = [], None, None
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                if x != last:
                    last, left = x, _unpack_set(x)
                right = _unpack_set(y)
                both = np.concatenate([left, right])
                both.sort(kind="stable")  # two ascending runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
        give_back_memory()

    def linked(pairs: DataFrame, few: bool = True) -> DataFrame:
        """Those of ``pairs`` that are links; of ``few`` pairs only the sets shuffle that they need."""
        pairs, held = saved(pairs, "pairs"), sets
        if few:
            ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
            held = sets.where(id_filter(ends, bloom_slots(2 * pairs.count(), most=most_slots))(F.col("id")))
        a, b = held.select(F.col("id").alias("a"), F.col("set").alias("set_a")), held.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        return saved(pairs.join(b, "b").join(a, "a").mapInArrow(confirm, f"a {id_type}, b {id_type}, ok boolean").where("ok").select("a", "b"), "links")

    def joined(part: DataFrame, links: DataFrame) -> DataFrame:
        """Each id's component after more links: the components' own components."""
        side = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        up = components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        up = up.select(F.col("node").alias("component"), F.col("component").alias("up"))
        return saved(part.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "part")

    hubs = members.where(F.col("id") != F.col("hub.id")).where(may_link(F.col("n"), F.col("hub.n")))
    direct = linked(hubs.select(*ordered(F.col("id"), F.col("hub.id"))).distinct(), few=False)
    part = joined(wanted.select("id", F.col("id").alias("component")), direct)

    # In a table of two, the hub has met the other one. In larger ones, those that its hub is not linked to are loose.
    crowded, turn, left, before = members.where("size > 2"), 0, None, 0
    of_hub = direct.select(F.col("a").alias("hub_id"), F.col("b").alias("id"))  # a hub has the least id of its table
    loose = crowded.select("key", "id", "n", F.col("hub.id").alias("hub_id")).where("id <> hub_id")
    # Of the tables that share a hub, one for each document that is loose there; its other ones offer much the same.
    loose = loose.join(of_hub, ["hub_id", "id"], "left_anti").groupBy("id", "n", "hub_id").agg(F.min_by("key", F.xxhash64("key", "id")).alias("key"))
    loose = saved(loose, "loose")
    while True:
        hub_part = part.select(F.col("id").alias("hub_id"), F.col("component").alias("main"))
        outside = saved(loose.join(part, "id").join(hub_part, "hub_id").where("component <> main").select("key", "id", "n", "component", "main"), "outside")
        before, left = left, outside.count()
        if not left or (before is not None and 2 * left > before):
            break
        draw = lambda j: F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit((heads + 1) * turn + j)))  # noqa: E731, B023
        offered = crowded.groupBy("key").agg(F.array(*(draw(j) for j in range(heads))).alias("others"))
        another = outside.groupBy("key").agg(draw(heads).alias("another"))
        # One table's offer for each document and component of a hub.
        met = outside.join(offered, "key").join(another, "key").select("key", "id", "n", "main", F.array_append("others", F.col("another")).alias("others"))
        met = met.groupBy("id", "n", "main").agg(F.min_by("others", F.xxhash64("key", F.lit(turn))).alias("others"))
        met = met.select("id", "n", F.explode("others").alias("other")).where((F.col("id") != F.col("other.id")) & may_link(F.col("n"), F.col("other.n")))
        part, turn = joined(part, linked(met.select(*ordered(F.col("id"), F.col("other.id"))).distinct())), turn + 1

    if left:
        # Every document of a table that is still mixed is of one of these components.
        open_ = saved(outside.select("component").unionByName(outside.select(F.col("main").alias("component"))).distinct(), "open")
        ids = saved(part.join(open_, "component", "left_semi").select("id", "component"), "unsettled")
        n_ids = ids.count()
        held = saved(sets.where(id_filter(ids.select("id"), bloom_slots(n_ids, most=most_slots))(F.col("id"))).join(ids, "id"), "unsettled-sets")
        rest = saved(_linkable(held, _frequencies(held), id_type, percent), "rest")
        share = 4 * n_ids
        while n_rest := rest.count():
            # A share first, as its links can make most others needless; the share grows, and what remains is checked.
            chosen = F.lit(True) if n_rest <= share else F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)) < int(share / n_rest * (1 << 30)) + 1
            part = joined(part, linked(rest.where(chosen)))
            if n_rest <= share:
                break
            side = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))  # noqa: E731, B023
            rest, share = saved(rest.where(~chosen).join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b"), "rest"), share * 4

    out = placed.join(part.withColumnRenamed("id", "rep"), "rep", "left")
    # Texts of one id that are in different components join them.
    real = out.where("doc_id is not null and n > 0").select("doc_id", F.coalesce("component", "rep").alias("component"))
    torn = saved(real.groupBy("doc_id").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("doc_id", "least"), "torn")
    if not torn.isEmpty():
        up = components(real.join(torn, "doc_id").select(F.col("least").alias("a"), F.col("component").alias("b")))
        up = up.select(F.col("node").alias("component"), F.col("component").alias("up"))
        out = out.withColumn("component", F.coalesce("component", "rep")).join(up, "component", "left").withColumn("component", F.coalesce("up", "component"))
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
