"""Spelling variants: words one edit apart, by composing vocabulary acceptors with a one-edit transducer.

Words are counted in Spark. Pairs that differ by one inserted, deleted or replaced code point come
from the composition ``vocabulary o one edit o vocabulary`` of minimised acceptors. The
composition is partitioned by the state in which the edit zone begins and the state in which it ends:
two near words agree before and behind their edit, so a partition holds the words of one length (and
of one more) with the same code points outside a zone, and its machine reads the zones only. At
first the zone is the first or the second half of the word; a partition of more than ``LIMIT`` words
is split into two, with the edit in the first or the second half of its zone, again and again. A zone of one code point bounds
a partition by the alphabet, so no partition grows without end and none is cut off. The edit's
place is the first one where the words differ, so each pair comes from one partition, once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import LOWER, UPPER, Folder

LIMIT = 10_000  # words of a partition; above the 90 + 90 * 90 that a zone of one code point can hold
DEPTH = 64  # code points of a zone, arcs from the first state to the last
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
FLUSH = 1 << 18  # words that a task counts before it hands them on
_ASCII = str.maketrans(UPPER, LOWER)
PAIR = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])
Edit = Callable[[object, str], str]


def runs_of(least: int = 1) -> re.Pattern:
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def count_words(docs: DataFrame, edit: Edit | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: lower-cased (A-Z) runs of letters of at least ``least`` code points, after ``edit(doc_id, run)``.

    An edit may only keep or shorten a run. A task adds up its words before they are shuffled.
    """
    pattern = runs_of(least)

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def step(batches: Iterator[pa.RecordBatch]):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(pattern.findall(text or "")).items():
                    word = run.lower() if run.isascii() else run.translate(_ASCII)
                    if edit:
                        word = edit(doc_id, word)
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= FLUSH:
                    yield flush(total)
                    total.clear()
        yield flush(total)

    return docs.select("doc_id", "text").mapInArrow(step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptors:
    """Minimised acceptors of sets of strings of one length each, over one register of states.

    States with the same right language are one state, whichever set they come from. State 0 ends.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.register: dict[tuple, int] = {}
        self._words: dict[int, list[str]] = {0: [""]}
        self._common: dict[tuple[int, int], list[str]] = {}
        self._replaced: dict[int, list[tuple[str, str]]] = {}
        self._inserted: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def add(self, strings: list[str]) -> int | None:
        """The first state of the minimal acceptor of sorted strings of one length; None without any."""
        if not strings:
            return None
        size = len(strings[0])
        path: list[dict[str, int]] = [{} for _ in range(size)]
        before = None

        def close(depth: int) -> None:
            for k in range(size - 1, depth - 1, -1):
                state = self._state(path[k])
                if k:
                    path[k - 1][before[k - 1]] = state
                path[k] = {}
                last.append(state)

        last: list[int] = []
        for s in strings:
            if before is not None:
                k = 0
                while s[k] == before[k]:
                    k += 1
                close(k + 1)
            if size:
                path[size - 1][s[size - 1]] = 0
            before = s
        close(0)
        return last[-1] if size else 0

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())  # labels come in order
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
        return state

    def words(self, q: int) -> list[str]:
        found = self._words.get(q)
        if found is None:
            found = self._words[q] = [c + rest for c, r in self.arcs[q].items() for rest in self.words(r)]
        return found

    def common(self, q: int, r: int) -> list[str]:
        """Strings that both states accept."""
        if q == r:
            return self.words(q)
        key = (q, r) if q < r else (r, q)
        found = self._common.get(key)
        if found is None:
            a, b = self.arcs[q], self.arcs[r]
            found = self._common[key] = [c + rest for c in a.keys() & b.keys() for rest in self.common(a[c], b[c])]
        return found

    def replaced(self, q: int) -> list[tuple[str, str]]:
        """``q o replacement o q``: accepted pairs ``x < y`` that differ in one place."""
        found = self._replaced.get(q)
        if found is None:
            arcs = list(self.arcs[q].items())
            found = [(c + x, c + y) for c, r in arcs for x, y in self.replaced(r)]
            for k, (c, r) in enumerate(arcs):
                for d, s in arcs[k + 1:]:
                    found += [(c + rest, d + rest) for rest in self.common(r, s)]
            self._replaced[q] = found
        return found

    def inserted(self, q: int, r: int, at_end: bool) -> list[tuple[str, str]]:
        """``q o insertion o r``: pairs ``(x, y)``, ``y`` being ``x`` with one more code point where they first differ.

        ``at_end``: whether the insertion may stand behind all of ``x``.
        """
        found = self._inserted.get((q, r))
        if found is None:
            a, b = self.arcs[q], self.arcs[r]
            if q == 0:
                found = [("", c) for c in b] if at_end else []
            else:
                found = [(c + x, c + y) for c in a.keys() & b.keys() for x, y in self.inserted(a[c], b[c], at_end)]
                for c, s in b.items():
                    after = self.arcs[s]
                    for d in a.keys() & after.keys():
                        if d != c:
                            found += [(d + rest, c + d + rest) for rest in self.common(a[d], after[d])]
            self._inserted[(q, r)] = found
        return found


def compose(short: list[str], longer: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart: within ``short`` (one length), and of ``short`` with ``longer`` (one more)."""
    machine = Acceptors()
    q = machine.add(sorted(short))
    r = machine.add(sorted(longer))
    if q is None:
        return
    yield from machine.replaced(q)
    if r is not None:
        yield from machine.inserted(q, r, at_end)


KEY = ["size", "low", "high", "head", "tail"]


def _zones(rows: DataFrame) -> DataFrame:
    """Rows of partitions that are too large, once for each half of the zone."""
    width = F.col("high") - F.col("low")
    extra = F.length("zone") - width  # 1 for the longer words
    middle = F.col("low") + F.floor(width / 2).cast("int")
    first = F.struct(
        F.col("low").alias("low"), middle.alias("high"), F.col("head").alias("head"),
        F.concat(F.expr("substring(zone, floor((high - low) / 2) + (length(zone) - (high - low)) + 1)"), "tail").alias("tail"),
        F.substring("zone", F.lit(1), middle - F.col("low") + extra).alias("zone"))
    second = F.struct(
        middle.alias("low"), F.col("high").alias("high"), F.concat("head", F.expr("substring(zone, 1, floor((high - low) / 2))")).alias("head"),
        F.col("tail").alias("tail"), F.expr("substring(zone, floor((high - low) / 2) + 1)").alias("zone"))
    return rows.select("size", "n", F.explode(F.array(first, second)).alias("z")).select("size", "z.low", "z.high", "z.head", "z.tail", "z.zone", "n")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of ``words (word, n)`` that is one edit apart, once."""
    folder = Folder(words.sparkSession, "spelling")
    size = F.length("word")
    rows = words.select("n", F.col("word").alias("zone"), F.explode(F.array(size, size - 1)).alias("size")).where("size > 0").select(
        "size", F.lit(0).alias("low"), F.col("size").alias("high"), F.lit("").alias("head"), F.lit("").alias("tail"), "zone", "n")
    rows, ready, level = _zones(rows), None, 0
    while True:
        rows = folder.write(rows, f"level{level}")
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
        # a zone of one code point cannot be split; its words differ in that place only
        width = F.col("high") - F.col("low")
        many = ((F.col("rows") > limit) & (width > 1)) | ((F.col("rows") > 1) & (width > DEPTH))
        large = folder.write(sizes.where(many).select(*KEY), f"large{level}")
        small = rows.join(large, KEY, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            break
        rows = _zones(rows.join(large, KEY, "left_semi"))
        level += 1

    def step(batches: Iterator[pa.RecordBatch]):
        key, group, out = None, [], []

        def close() -> Iterator[tuple]:
            if len(group) < 2:
                return
            width, head, tail = key[2] - key[1], key[3], key[4]
            counts = dict(group)
            short = [z for z in counts if len(z) == width]
            if short:
                for x, y in compose(short, [z for z in counts if len(z) > width], key[2] == key[0]):
                    yield head + x + tail, counts[x], head + y + tail, counts[y]

        for batch in batches:
            for *now, zone, n in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key:
                    out.extend(close())
                    key, group = now, []
                group.append((zone, n))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR)], schema=PAIR)
                    out = []
        out.extend(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR)], schema=PAIR)

    dealt = ready.select(*KEY, "zone", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(step, "a string, n_a long, b string, n_b long")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for ``words (word, n)``, one row each.

    ``form`` is the near word of the largest count (ties: the smallest in code-point order) where
    that count is at least ``ratio`` times the word's; ``root`` is where the forms lead to. Counts grow by
    the ratio with every step, so a chain is shorter than the digits of the largest count. No words give no rows.
    """
    folder = Folder(words.sparkSession, "variants")
    words = folder.write(words, "words")
    pairs = near_pairs(words, limit)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("s"))
    best = sides.groupBy("s.word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("m"), F.col("s.other").alias("other"))).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    formed = folder.write(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.m")).alias("form_n")), "formed")
    steps = folder.write(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps0")
    number = 0
    while True:  # each round follows twice as many forms
        onward = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = folder.write(steps.join(onward, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"steps{number + 1}")
        folder.drop(f"steps{number}")
        number += 1
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """``variants`` of the words of ``docs (doc_id, text)`` that occur at least twice.

    A null or empty text has no words. Further columns are not read.
    """
    return variants(count_words(docs, edit).where(F.col("n") >= LEAST_COUNT))


def dropped_letter(doc_id, run: str) -> str:
    """The run without one code point where a hash of id and run is a multiple of 31 (a null id counts as empty)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]
