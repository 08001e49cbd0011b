"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces that fill a sequence by themselves need no search. All others are dealt to islands
of about ``island_items`` pieces by a hash of their key, so an island's work and memory are
bounded and the number of islands follows the input. On an island a solution is a grouping
of pieces into bins:

* the first solution is best-fit decreasing, the others are best-fit on disturbed orders;
* crossover injects whole well-filled bins of one parent into the other, removes the bins
  that hold one of their pieces a second time, and best-fits the displaced pieces;
* mutation dissolves the emptiest bins;
* fitness is Falkenauer's mean squared fill, so full bins beat evenly filled ones.

After the first epoch the full bins of each island travel to the next island of the ring as
patterns of piece lengths (elite migration); the second epoch rebuilds them from its own
pieces. In the last epochs the poorly filled bins of all islands are dealt anew, whole bins
at a time: the grouping they bring is one of the solutions, so an epoch never adds bins.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import Folder

CAPACITY, END_ID, ISLAND_ITEMS = 1024, 2, 32_768
POPULATION, GENERATIONS, ELITES, POOLS = 5, 6, 1024, 3
SPECIAL = "<|endoftext|>"


@lru_cache(1)
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _tokenizer(path: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str | None, path: str = "", ranks_path: str = "") -> array:
    """Ids of a text and the end id.

    The ranks file holds the same vocabulary as the tokenizer file and encodes faster; only
    texts with the special token's string, which the tokenizer turns into its id, go there.
    """
    if text and SPECIAL in text:
        ids = array("I", _tokenizer(path).encode(text, add_special_tokens=False).ids)
    else:
        ids = array("I", _ranks(ranks_path).encode_ordinary(text or ""))
    ids.append(END_ID)
    return ids


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
                 with_ids: bool = False, path: str = "", ranks_path: str = "") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document.

    A text of more than ``capacity`` ids is cut from its end, so only piece 0 can be shorter.
    A null text counts as empty and gives one piece that holds the end id.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out = defaultdict(list)
            keys, texts = (c.to_pylist() for c in batch.columns)
            for key, value in zip(keys, texts):
                ids = token_ids(value, path, ranks_path)
                raw, n = ids.tobytes(), len(ids)
                first = n % capacity or min(n, capacity)
                starts = [0, *range(first, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    out["doc_id"].append(key)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * a:4 * b]))
                    if with_ids:
                        out["ids"].append(ids[a:b].tolist())
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                types += [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


class _Bins:
    """A grouping of items: item lists per bin, and the bins by the room they have left."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.mask = 0  # bit r is set when some bin has room r

    def add(self, items: list[int]) -> None:
        room = self.capacity - sum(self.lengths[i] for i in items)
        self._offer(len(self.items), room)
        self.items.append(list(items))
        self.room.append(room)

    def _offer(self, k: int, room: int) -> None:
        if room:
            self.by_room[room].append(k)
            self.mask |= 1 << room

    def fit(self, items: list[int]) -> None:
        """Best fit in the given order: the bin with the least room that is enough."""
        lengths, by_room = self.lengths, self.by_room
        for i in items:
            size = lengths[i]
            found = self.mask >> size
            if found:
                room = size + (found & -found).bit_length() - 1
                bins = by_room[room]
                k = bins.pop()
                if not bins:
                    self.mask ^= 1 << room
                self.items[k].append(i)
                self.room[k] = room - size
                self._offer(k, room - size)
            else:
                self.add([i])

    def fitness(self) -> float:
        c = self.capacity
        return sum(((c - r) / c) ** 2 for r in self.room) / max(1, len(self.room))

    def score(self) -> tuple[int, float]:
        return -len(self.room), self.fitness()


def _grouped(lengths, capacity, bins, rest) -> _Bins:
    out = _Bins(lengths, capacity)
    for items in bins:
        out.add(items)
    out.fit(sorted(rest, key=lambda i: -lengths[i]))
    return out


def _cross(a: _Bins, b: _Bins, rng: random.Random) -> _Bins:
    order = sorted(range(len(b.room)), key=b.room.__getitem__)
    chosen = rng.sample(order[: max(1, len(order) // 2)], max(1, len(order) // 6))
    injected = {i for k in chosen for i in b.items[k]}
    stay, loose = [], []
    for items in a.items:
        if any(i in injected for i in items):
            loose += [i for i in items if i not in injected]
        else:
            stay.append(items)
    return _grouped(a.lengths, a.capacity, [b.items[k] for k in chosen] + stay, loose)


def _mutate(a: _Bins, rng: random.Random) -> _Bins:
    order = sorted(range(len(a.room)), key=lambda k: -a.room[k])
    gone = set(order[: max(2, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 50)))
    return _grouped(a.lengths, a.capacity, [x for k, x in enumerate(a.items) if k not in gone], [i for k in gone for i in a.items[k]])


def evolve(lengths: list[int], capacity: int, given: list[list[int]] | None, migrants: list[tuple], seed: int) -> _Bins:
    """The best grouping found; ``given`` is a known one, ``migrants`` are length patterns."""
    rng = random.Random(seed)
    items = list(range(len(lengths)))
    bound = -(-sum(lengths) // capacity)
    people = [_grouped(lengths, capacity, [], items)]
    if given is not None:
        people.append(_grouped(lengths, capacity, given, []))
    if migrants:
        spare = defaultdict(list)
        for i in items:
            spare[lengths[i]].append(i)
        bins = []
        for pattern in migrants:
            taken = [spare[x].pop() for x in pattern if spare[x]]
            if len(taken) == len(pattern):
                bins.append(taken)
            else:
                for i in taken:
                    spare[lengths[i]].append(i)
        people.append(_grouped(lengths, capacity, bins, [i for left in spare.values() for i in left]))
    while len(people) < POPULATION and len(max(people, key=_Bins.score).room) > bound:
        one = _Bins(lengths, capacity)
        one.fit(sorted(items, key=lambda i: -lengths[i] * rng.uniform(0.9, 1.0)))
        people.append(one)
    for _ in range(GENERATIONS):
        people.sort(key=_Bins.score, reverse=True)
        if len(people[0].room) <= bound or len(people) < 2:
            break
        a, b = rng.sample(people[: max(2, len(people) - 1)], 2)
        child = _mutate(_cross(a, b, rng), rng)
        if child.score() > people[-1].score():
            people[-1] = child
    return max(people, key=_Bins.score)


def _island(capacity: int, columns: list[str]):
    """Island step: rows of one island and the migrants to it, out come the rows with bins."""

    def step(rows: pd.DataFrame, migrants: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", ignore_index=True)
        if not len(rows):
            return rows[columns]
        given = None
        if (rows["bin"] >= 0).all():
            given = [x.tolist() for x in rows.groupby(["home", "bin"]).indices.values()]
        patterns = [tuple(p) for p in sorted(map(list, migrants["pattern"]))]
        best = evolve(rows["length"].tolist(), capacity, given, patterns, int(rows["island"].iloc[0]))
        bins, room = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k, items in enumerate(best.items):
            bins[items], room[items] = k, best.room[k]
        rows["bin"], rows["room"], rows["home"] = bins, room, rows["island"]
        same = rows.groupby("bin")
        return rows.assign(sequence_id=same["pid"].transform("first"), offset=same["length"].cumsum() - rows["length"])[columns]

    return step


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_items: int = ISLAND_ITEMS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece once, gapless from 0.

    ``pieces`` has a ``length`` in 1 to ``capacity`` and any other columns (not named
    ``pid``, ``island``, ``home``, ``bin`` or ``room``). No pieces give no rows. A sequence
    is named after the number of its first piece.
    """
    spark = pieces.sparkSession
    folder = Folder(spark, "packing")
    # a stored table: the numbers of the pieces must not change between the epochs
    pieces = folder.write(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    out = [pieces.where(F.col("length") == capacity).select(
        *pieces.columns, F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity).drop("ids")
    islands = max(1, -(-rest.count() // island_items))
    extra = ["island", "home", "bin", "room", "sequence_id", "offset"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"{c} long" for c in extra])
    nobody = spark.createDataFrame([], "island long, pattern array<long>")

    def epoch(rows: DataFrame, migrants: DataFrame, number: int) -> DataFrame:
        step = _island(capacity, [*rest.columns, *extra])
        grown = rows.groupBy("island").cogroup(migrants.groupBy("island")).applyInPandas(step, schema)
        return folder.write(grown, f"epoch{number}")

    deal = F.pmod(F.xxhash64("pid"), F.lit(islands))
    state = epoch(rest.select("*", deal.alias("island"), *[F.lit(-1).cast("long").alias(c) for c in extra[1:]]), nobody, 1)
    if islands > 1:
        # elite migration: at most ELITES full bins of each island, as patterns of lengths
        bins = state.where((F.col("room") == 0) & (F.col("bin") < 4 * ELITES)).groupBy("island", "bin").agg(
            F.sort_array(F.collect_list("length"), False).alias("pattern"))
        elites = bins.groupBy("island").agg(F.slice(F.sort_array(F.collect_list("pattern"), False), 1, ELITES).alias("p"))
        moved = elites.select(((F.col("island") + 1) % islands).alias("island"), F.explode("p").alias("pattern"))
        state = epoch(state, moved, 2)
        for turn in range(POOLS):
            # the poorly filled bins of all islands, dealt anew as whole bins
            poor = F.col("room") > capacity // (64 << turn)
            out.append(state.where(~poor))
            pool = state.where(poor)
            left = max(1, -(-pool.count() // island_items))
            state = epoch(pool.withColumn("island", F.pmod(F.xxhash64("home", "bin"), F.lit(left))), nobody, turn + 3)
            if left == 1:
                break
    out.append(state)
    placed = out[1].select("pid", "sequence_id", "offset")
    for part in out[2:]:
        placed = placed.unionByName(part.select("pid", "sequence_id", "offset"))
    if "ids" in pieces.columns:
        found = pieces.join(placed, "pid")
    else:  # all columns came along
        found = out[1].select(*out[0].columns)
        for part in out[2:]:
            found = found.unionByName(part.select(*out[0].columns))
    return out[0].unionByName(found.select(*out[0].columns)).drop("pid")


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` and pack them: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are pieces of one id. Other columns are not read.
    """
    packed = pack(token_pieces(docs, text, doc_id, capacity, with_ids), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
