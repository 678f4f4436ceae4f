r"""Spelling variants of the corpus' words by composition of finite-state machines.

The vocabulary is counted over all documents. Two words are near if one edit (a code point inserted, deleted or replaced) makes the one of the other. Near words
are the pairs that A o E o A accepts, A being the minimised acceptor of the vocabulary and E a transducer that copies its input but
for exactly one edit. The composition is enumerated by partitions of its initial states. Before the edit both sides stand in the same state of A,
so a partition is what lies behind one prefix of `KEY` code points in A, the edit coming later; pairs whose edit lies within the prefix
agree in their last code points and are found from the initial states of the reversed words in the same way. A partition of more than `most` words is
parted again by the next code points on either side, as often as needed, so that a task holds some hundred words at a time however many share a prefix.

In a partition the acceptor is built from the sorted words and is minimal. It numbers its words, so that a path of the composition is two
numbers and no strings are built. Behind the edit, two states go on only if they accept a common ending, which is remembered for each pair of states. So time
follows the states and the accepted pairs, not the square of the words, and long words cost time in proportion to their length.

A word's form is its near word of the largest count (of equals the first in code-point order), if that is `times` the word's own or more; its root is where
the forms lead. Words are counted in the tasks that read them, then added up by word; the roots are found by pointer jumping, in as many rounds as the
logarithm of the longest chain.

Runs are `[A-Za-zÀ-ÿ]+`, A-Z lower-cased. With h the crc32 of `<doc_id>:<run>`, a run with h % 199 = 0 loses its code point h % length. Defined
cases: null and empty texts have no words; a null doc_id counts as `null`; very long texts and words are read whole, a text's row has to fit an Arrow batch;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

LEAST_LENGTH, LEAST_COUNT, TIMES, SLIPS = 6, 5, 5, 199
#: Code points of a partition's prefix or suffix; twice as many are at most what a word must have to be near another.
KEY = 3
#: Words of a partition.
MOST = 600
#: Different words that a task holds while it counts.
HELD = 200_000
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def counted(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts; one may come twice."""
    folded = (text or "").encode("utf-8", "surrogatepass").lower()
    salt = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(m[0] for m in RUN.finditer(folded)).items():
        word, h = run.decode(), zlib.crc32(run, salt)
        if h % SLIPS == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LENGTH:
            yield word, n


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words that occur so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for word, n in counted(doc_id, text.as_py()):
                    held[word] += n
                if len(held) > HELD:
                    yield told()
        yield told()

    words = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The minimal acceptor of sorted, distinct words. Each state knows how many words lie behind it, so that a path knows the place of its word."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.size: list[int] = [0]
        self.offset: list[dict[str, int]] = [{}]
        self.shared: dict[tuple[int, int], bool] = {}
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []
        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            self._fold(path, same, known)
            state = path[-1][2] if path else 0
            for label in word[same:]:
                new = len(self.arcs)
                self.arcs.append({})
                self.final.append(False)
                self.size.append(0)
                self.offset.append({})
                self.arcs[state][label] = new
                path.append((state, label, new))
                state = new
            self.final[state] = True
            last = word
        self._fold(path, 0, known)
        self._number(0)

    def _fold(self, path: list[tuple[int, str, int]], depth: int, known: dict[tuple, int]) -> None:
        """States behind this depth are whole: those that accept what a known one accepts become that one."""
        while len(path) > depth:
            state, label, child = path.pop()
            kept = known.setdefault((self.final[child], *self.arcs[child].items()), child)
            if kept == child:
                self._number(child)
            self.arcs[state][label] = kept

    def _number(self, state: int) -> None:
        before = list(accumulate((self.size[c] for c in self.arcs[state].values()), initial=int(self.final[state])))
        self.offset[state], self.size[state] = dict(zip(self.arcs[state], before)), before[-1]

    def share(self, s: int, t: int) -> bool:
        """Do both states accept a common word?"""
        todo = [(s, t)]
        while todo:
            a, b = todo[-1]
            if (a, b) not in self.shared:
                if a == b or self.final[a] and self.final[b]:
                    self.shared[a, b] = True
                else:
                    further = [(c, self.arcs[b][x]) for x, c in self.arcs[a].items() if x in self.arcs[b]]
                    if any(self.shared.get(p) for p in further):
                        self.shared[a, b] = True
                    elif open_ := next((p for p in further if p not in self.shared), None):
                        todo.append(open_)
                        continue
                    else:
                        self.shared[a, b] = False
            todo.pop()
        return self.shared[s, t]

    def common(self, s: int, t: int) -> Iterator[tuple[int, int]]:
        """The places behind both states of each word that both accept."""
        todo = [(s, t, 0, 0)]
        while todo:
            a, b, i, j = todo.pop()
            if a == b:
                yield from ((i + k, j + k) for k in range(self.size[a]))
                continue
            if not self.share(a, b):
                continue
            if self.final[a] and self.final[b]:
                yield i, j
            todo += [(c, self.arcs[b][x], i + self.offset[a][x], j + self.offset[b][x]) for x, c in self.arcs[a].items() if x in self.arcs[b]]


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of two words, sorted and distinct ones, that one edit makes of each other, each pair once: the paths of A o E o A, by the state in which the edit happens."""
    a = Acceptor(words)
    replaced: dict[int, list[tuple[int, int]]] = {}
    inserted: dict[tuple[int, str], list[tuple[int, int]]] = {}
    todo: list[tuple[int, int, str]] = [(0, 0, "")]
    while todo:
        state, at, last = todo.pop()
        arcs, offset = a.arcs[state], a.offset[state]
        if state not in replaced:
            replaced[state] = [(offset[x] + i, offset[y] + j) for (x, s), (y, t) in combinations(arcs.items(), 2) if a.share(s, t) for i, j in a.common(s, t)]
        yield from ((at + i, at + j) for i, j in replaced[state])
        for x, s in arcs.items():
            if x != last:  # else the same edit was made before the code point behind
                if (state, x) not in inserted:
                    inserted[state, x] = [(i, offset[x] + j) for i, j in a.common(state, s)] if a.share(state, s) else []
                yield from ((at + i, at + j) for i, j in inserted[state, x])
            todo.append((s, at + offset[x], x))


PAIRS = "word string, near string, near_n long"


def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words of each partition, whose rows come together, in either direction."""

    def of(key: tuple[str, str], rows: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        first, last = len(key[0]), len(key[1])
        between = sorted(w[first : len(w) - last] for w in rows)
        pairs = [tuple(f"{key[0]}{between[k]}{key[1]}" for k in pair) for pair in near_pairs(between)]
        both = pairs + [(v, u) for u, v in pairs]
        for k in range(0, len(both), 10_000):
            part = both[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.string()), pa.array([v for _, v in part], pa.string()), pa.array([rows[v] for _, v in part], pa.int64())], names=["word", "near", "near_n"])

    key, rows = None, {}
    for batch in batches:
        for pre, suf, word, n in zip(*(batch[x].to_pylist() for x in ("pre", "suf", "word", "n"))):
            if (pre, suf) != key:
                if key:
                    yield from of(key, rows)
                key, rows = (pre, suf), {}
            rows[word] = n
    if key:
        yield from of(key, rows)


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """pre, suf, word, n: the partitions that a word belongs to. What lies between prefix and suffix is what a partition's acceptor reads."""

    def parted(df: DataFrame) -> DataFrame:
        """By the next code points behind the prefix, and by those before the suffix."""
        front = df.withColumn("pre", F.expr(f"substring(word, 1, length(pre) + {KEY})"))
        back = df.withColumn("suf", F.expr(f"substring(word, length(word) - length(suf) - {KEY - 1}, length(suf) + {KEY})"))
        return front.unionByName(back)

    open_, done = durable(parted(words.select("word", "n", F.lit("").alias("pre"), F.lit("").alias("suf")))), None
    while True:
        full = open_.groupBy("pre", "suf").agg(F.count("*").alias("m")).where(F.col("m") > most)
        marked = durable(open_.join(full, ["pre", "suf"], "left"))
        rest = F.length("word") - F.length("pre") - F.length("suf")
        # two of which the shorter has twice KEY left agree in KEY at either end; the others meet here
        stay = marked.where(F.col("m").isNull() | (rest <= 2 * KEY)).drop("m")
        done = stay if done is None else done.unionByName(stay)
        further = marked.where(F.col("m").isNotNull() & (rest >= 2 * KEY)).drop("m")
        if not further.limit(1).count():
            return done
        open_ = durable(parted(further))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: each word's near words, once."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = partitions(words, most).repartition(tasks, "pre", "suf").sortWithinPartitions("pre", "suf").select("pre", "suf", "word", "n").mapInArrow(enumerated, PAIRS)
    return pairs.repartition(tasks, "word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: word, form."""
    up = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(up.join(over, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        up = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return up


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    words = durable(vocabulary(docs, least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    formed = F.when(form_n >= times * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("form_n")))
    found = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), formed.alias("f")))
    ends = roots(found.where("f is not null").select("word", F.col("f.form").alias("form")))
    return found.join(ends, "word", "left").select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.form_n").alias("form_n"))
