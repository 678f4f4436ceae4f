"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge can change what lies left of a boundary only through merges that cross it, and of those only through tokens that were
built, and left alone, right of it. Following the merge list by rank gives how far that reaches: for a merge
of u and v it is the length of v, and beyond it what a lower-ranked merge of any token on v's right edge reaches. The greatest
reach is the sufficient lookahead of the list. So a token is stable as soon as that many bytes follow it: the encoder
merges a window of one token and the lookahead, emits what is stable and slides on, in constant memory for words
of any length. Words shorter than the window, nearly all, are merged at once and remembered in a bounded table.

Texts are cut into words by the vocabulary's pattern, in slices cut before a white space that follows something
else, where a word always ends; a stretch of text without white space is one slice, so memory is bounded by the longest such stretch. Decoding feeds the bytes of the tokens to an incremental UTF-8 state machine that
keeps the bytes of an unfinished character between tokens and gives U+FFFD for what can't become one.

The vocabulary is read on the driver and broadcast: its size is fixed by the file, not by the data. Nothing is shuffled.

Defined cases: null counts as the empty text, which has no tokens (hash of the empty string); a special token's own
text gives the special token, as in the library; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 200_000
SLICE = 1 << 18
#: The vocabulary's pattern, and the same for texts of characters up to U+00FF, which the standard library's `re` matches faster.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r" \t\n\r\x0b\x0c\x85\xa0"
NARROW = rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return shown


def narrow(text: str) -> bool:
    """Whether all characters lie up to U+00FF."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Vocabulary:
    """Tokens, merges, and the lookahead that the merges need."""

    def __init__(self, spec: str) -> None:
        parsed, byte = json.loads(spec), byte_chars()
        model = parsed["model"]
        ids = model["vocab"]
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [0] * 256
        for c, b in byte.items():
            self.first[b] = ids[c]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        crossing: dict[int, int] = {}  # by token: the reach of the merges so far that have it on their left
        beyond: dict[int, int] = {}  # by token: how far past its end its making may depend on
        self.lookahead = 0
        for rank, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = ids[u], ids[v], ids[u + v]
            self.ranks[left << 32 | right] = rank
            self.made.append(made)
            past = max(crossing.get(right, 0), beyond.get(right, 0))
            reach = len(self.bytes_of[right]) + past
            beyond[made] = max(beyond.get(made, 0), past)
            crossing[left] = max(crossing.get(left, 0), reach)
            self.lookahead = max(self.lookahead, reach)
        self.longest = max(map(len, self.bytes_of.values()))

    def merge(self, word: bytes) -> list[int]:
        """Tokens of a short word."""
        out, get, never = [self.first[b] for b in word], self.ranks.get, len(self.made)
        ranks = [get(a << 32 | b, never) for a, b in zip(out, out[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            out[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(out[i] << 32 | out[i + 1], never)
            if i:
                ranks[i - 1] = get(out[i - 1] << 32 | out[i], never)
        return out


class Encoder(dict):
    """Tokens by word, the transducer run where a word isn't remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        super().__init__()
        self.vocabulary, self.cut = vocabulary, regex.compile(r"(?<=\S)\s")
        self.words, self.narrow, self.old = regex.compile(WORDS).findall, re.compile(NARROW).findall, {}
        names = "|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({names})") if names else None
        self.window = max(vocabulary.longest + vocabulary.lookahead, 64)

    def __missing__(self, word: str) -> tuple[int, ...]:
        made = self.old.get(word) or tuple(self.stream(word.encode()))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:  # of the words remembered, those used since the last time stay
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made

    def stream(self, word: bytes) -> Iterator[int]:
        """Tokens of a word of any length, each emitted once the lookahead behind it has been seen."""
        v, at, size = self.vocabulary, 0, 2 * self.window
        while len(word) - at > size:
            stable, done = size - v.lookahead, 0
            for token in v.merge(word[at : at + size]):
                if (done := done + len(v.bytes_of[token])) > stable:
                    break
                yield token
                at += len(v.bytes_of[token])
        yield from v.merge(word[at:])

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            m = self.cut.search(text, at + SLICE)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Tokens of the text, in lists of bounded length where the text has white space."""
        for part in self.special.split(text) if self.special and self.special.search(text) else (text,):
            if part in self.vocabulary.special:
                yield [self.vocabulary.special[part]]
            else:
                for piece in self.slices(part):
                    split = self.narrow if narrow(piece) else self.words
                    yield list(chain.from_iterable(map(self.__getitem__, split(piece))))


class Decoder:
    """Text of tokens, whatever the pieces they come in."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of, self.state = vocabulary.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def roundtrip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode each text: its number of tokens and the hashes of the ids and of the decoded text."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(spec.value)
        encoder, names = Encoder(vocabulary), {i: str(i) for i in vocabulary.bytes_of}
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for text in batch["text"]:
                n, first, ids_sum, text_sum, decoder = 0, True, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)
                for ids in encoder.encode(text.as_py() or ""):
                    if ids:
                        n += len(ids)
                        ids_sum.update(("" if first else ",").encode() + ",".join(map(names.__getitem__, ids)).encode())
                        text_sum.update(decoder.feed(ids).encode())
                        first = False
                text_sum.update(decoder.end().encode())
                counts.append(n)
                ids_hash.append(ids_sum.hexdigest())
                text_hash.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, vocabulary_path: str, out: str = "ids") -> DataFrame:
    """The documents with their tokens, array<int>, in a column of the given name."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())

    @F.pandas_udf("array<int>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(spec.value))
        for texts in batches:
            yield texts.map(lambda t: list(chain.from_iterable(encoder.encode(t or ""))))

    return docs.withColumn(out, tokens("text"))


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The documents with the text of their tokens; null has none."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(spec.value)
        for series in batches:
            yield series.map(lambda x: None if x is None else (d := Decoder(vocabulary)).feed(map(int, x)) + d.end())

    return docs.withColumn(out, text(ids))
