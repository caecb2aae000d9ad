"""Byte-level BPE with batched merge rounds.

The distinct words of a slice of documents lie in one flat array of symbols. In every round each word's lowest-ranked pair is
found by binary search of all neighbouring pairs in the sorted pair keys of the vocabulary, and all its occurrences are merged,
leftmost first; words without such a pair leave the array. Words are numbered in a dictionary that a worker keeps between slices
and empties when it is full, which costs time, never a result.

Defined cases: a null text is an empty one and has no tokens; texts that are equal, or rows with equal doc_id, are encoded each; a
text of any length is encoded whole, in pieces that end where no token can span; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm.charclass import byte_level_starts
from shelfwatch.llm.common import slices, table, worker_store

#: Between two words: a text may be cut before this blank, because words end before it and the next one starts with it.
SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
NO_RANK = np.iinfo(np.int64).max
KEPT_WORDS = 200_000
SLICE_CHARS = 2_000_000
PIECE_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Merges:
    """The vocabulary of a tokenizer file as arrays."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab.get(c, -1) for c in letters])
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in letters])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] if not self.suffix else vocab[a.removesuffix(self.suffix) + b] for a, b in pairs], np.int64)
        _, first = np.unique(keys, return_index=True)  # sorted keys; a repeated pair has its first rank
        self.keys, self.ranks, self.merged = keys[first], first.astype(np.int64), merged[first]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        byte_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelt = [b""] * size
        for token, i in vocab.items():
            spelt[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.spelling = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelling_length = np.array([len(s) for s in spelt])
        self.spelling_start = np.cumsum(self.spelling_length) - self.spelling_length

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        symbol, owner = self.inner[letters], np.repeat(np.arange(len(words)), sizes)
        if self.suffix:
            ends = np.cumsum(sizes)[sizes > 0] - 1
            symbol[ends] = self.last[letters[ends]]
        rank, into = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int64)
        fresh = np.arange(len(symbol) - 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank[fresh], into[fresh] = self.rank_pairs(symbol[fresh], symbol[fresh + 1], owner[fresh] == owner[fresh + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbol)]))
            stay = lowest < NO_RANK
            if not stay.all():
                done.append((owner[~stay], symbol[~stay]))
            chosen = (rank == lowest) & stay
            if (chosen[1:] & chosen[:-1]).any():  # a pair of equal symbols can overlap itself: every second place of a run
                place = np.arange(len(chosen))
                run = place - np.maximum.accumulate(np.where(chosen, -1, place))
                chosen &= run % 2 == 1
            hit = np.flatnonzero(chosen)
            symbol[hit] = into[hit]
            rank[hit] = NO_RANK
            stay[hit + 1] = False
            new = (np.cumsum(stay) - 1)[hit]  # where the merged symbols stand among those that stay
            symbol, owner, rank, into = symbol[stay], owner[stay], rank[stay], into[stay]
            fresh = np.r_[new, new[new > 0] - 1]
            fresh = fresh[fresh < len(symbol) - 1]
        if not done:
            return np.empty(0, np.int64), sizes
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(words))

    def rank_pairs(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; no rank for pairs that don't merge."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & together, self.ranks[at], NO_RANK), self.merged[at]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens one after the other, and how many each has."""
        lengths = self.spelling_length[ids]
        return self.spelling[ragged(self.spelling_start[ids], lengths)], lengths


class Words:
    """Numbers for words, and the ids of every numbered word.

    A word is a str, or an id in a tuple for a special token.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def look_up(self, words: list) -> np.ndarray:
        if len(self.number) > KEPT_WORDS:
            self.clear()
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if fresh := list(itertools.islice(self.number, known, None)):
            ids, lengths = self.merges.encode([b"" if isinstance(w, tuple) else w if isinstance(w, bytes) else w.encode() for w in fresh])
            if special := [(i, w[0]) for i, w in enumerate(fresh) if isinstance(w, tuple)]:
                places = (np.cumsum(lengths) - lengths)[[i for i, _ in special]]
                ids = np.insert(ids, places, [t for _, t in special])
                lengths[[i for i, _ in special]] = 1
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(lengths) - lengths]
            self.length = np.r_[self.length, lengths]
            self.ids = np.r_[self.ids, ids.astype(np.int32)]
        return numbers

    def tokens(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        numbers = self.look_up(words)
        lengths = self.length[numbers]
        return self.ids[ragged(self.start[numbers], lengths)], lengths


def kept_words(content: bytes) -> Words:
    store, key = worker_store(), ("bpe", hashlib.sha256(content).digest())
    if key not in store:
        store[key] = Words(Merges(content))
    return store[key]


def pieces(text: str, most: int = PIECE_CHARS):
    """A text in parts that can be split into words one by one."""
    start = 0
    while len(text) - start > most and (cut := SAFE_CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def byte_level_words(text: str, merges: Merges) -> list:
    words: list = []
    for piece in pieces(text):
        parts = merges.special_pattern.split(piece) if merges.special and any(s in piece for s in merges.special) else (piece,)
        for part in parts:
            if part in merges.special:
                words.append((merges.special[part],))
            else:
                starts = byte_level_starts(part).tolist()
                words += [part[a:b] for a, b in zip(starts, [*starts[1:], None])]
    return words


def encode_texts(texts: list[str], words: Words):
    """(index of the first text, ids, token counts of the texts) for slices of `texts`."""
    for first, part in slices(texts, SLICE_CHARS):
        flat: list = []
        sizes = []
        for text in part:
            before = len(flat)
            flat += byte_level_words(text, words.merges)
            sizes.append(len(flat) - before)
        ids, lengths = words.tokens(flat)
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(sizes)] if len(flat) else np.zeros(len(part), np.int64)
        yield first, ids, np.diff(np.r_[0, ends])


def decode_ids(ids: np.ndarray, counts: np.ndarray, merges: Merges) -> list[str]:
    """The texts that runs of ids stand for; bytes that are no UTF-8 become U+FFFD, as in the library."""
    spelt, lengths = merges.spell(ids)
    ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
    raw = spelt.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def over_texts(docs: DataFrame, content: bytes, keep: list[str], schema: str, build) -> DataFrame:
    """`docs` with `keep` and what `build(first, ids, counts, words)` gives for each slice of texts, as arrays by column."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        words = kept_words(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for first, ids, counts in encode_texts(texts, words):
                made = build(ids, counts, words)
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, len(counts)) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types)], names=keep + names)

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept_types}, {schema}") if "text" not in keep else docs.select(*keep).mapInArrow(run, f"{kept_types}, {schema}")


def encode(docs: DataFrame, content: bytes, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens and ids of every document; `content` is the tokenizer file."""

    def build(ids, counts, words):
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return counts, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))

    return over_texts(docs, content, keep, "n_tokens long, ids array<int>", build)


def decode(encoded: DataFrame, content: bytes, keep: list[str]) -> DataFrame:
    """`keep` and the decoded text of every row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        merges = kept_words(shared.value).merges
        for batch in batches:
            ids = [np.array(i or [], np.int64) for i in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            texts = decode_ids(np.concatenate(ids), np.array([len(i) for i in ids]), merges) if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    kept_types = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{kept_types}, decoded string")


def encode_checked(docs: DataFrame, content: bytes, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens and ids of every document, and the digest of the text that the ids decode to."""

    def build(ids, counts, words):
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        texts = decode_ids(ids, counts, words.merges)
        return counts, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    return over_texts(docs, content, keep, "n_tokens long, ids array<int>, decoded_sha256 string", build)


def round_trip(docs: DataFrame, content: bytes, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens and digests of the ids and of the text decoded from them, without sending ids or texts on."""

    def build(ids, counts, words):
        ends = np.r_[0, np.cumsum(counts)]
        raw = ids.astype("<u4").tobytes()
        digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
        texts = decode_ids(ids, counts, words.merges)
        return counts, digests, [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    return over_texts(docs, content, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", build)


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizer_file("byte_bpe_50k.json"), ["doc_id"])
