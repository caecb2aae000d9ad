"""Token counts with a compiled tokenizer.

The word splitter of a word-end BPE tokenizer (contractions, letter runs, single digits, sign runs, nothing of blanks) is compiled
into a deterministic transducer over ten character classes. A transition is annotated with the words it opens, before its own
character or, where only the next character decides, before the last one; the word that it closes emits as many tokens as
the merges leave of it. A text is cut into chunks of fixed length without regard to its words. For every chunk the map from each
possible entry state to the exit state is run, the maps are composed by a parallel prefix scan, and the second run of each
chunk starts from its true state. The merges themselves are not compiled into the machine: its states would be the word
prefixes of the corpus, so closing transitions look the word's count up, and words not met before are merged in batches.

Defined cases: a null text is an empty one with 0 bytes and 0 tokens; special strings in a text count as one token each, as in the
library's default; equal rows are counted each; other columns are passed by; texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.bpe import SLICE_CHARS, Merges, Words, kept_words, pieces, tokenizer_file
from shelfwatch.llm.charclass import BLANK, DIGIT, LETTER, SIGN, class_table, code_points
from shelfwatch.llm.common import slices, table, worker_store

#: Input classes: blanks, letters, digits, signs, then the characters that contractions are made of.
QUOTE, SHORT, R, V, L, E = range(4, 10)
N_CLASSES = 10
#: States: a word may begin; in a letter run; in a sign run; after a quote that opened a word; after it and r, v or l.
FREE, LETTERS, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
N_STATES = 7
#: Annotations: a word begins at this character, at the one before.
HERE, BEFORE = 1, 2
CHUNK = 128
#: Lower cases that Python's tables don't have yet, and sigma, which Python would make final.
LATER_LOWER = (("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"), ("\ua7d2", "\ua7d3"), ("\ua7d4", "\ua7d5"))


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and annotation by state * N_CLASSES + class."""
    step, note = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = [LETTER, SHORT, R, V, L, E]
    opening = {BLANK: (FREE, 0), DIGIT: (FREE, HERE), SIGN: (SIGNS, HERE), QUOTE: (QUOTED, HERE), **{c: (LETTERS, HERE) for c in letters}}
    for state in range(N_STATES):
        for c, (to, mark) in opening.items():
            if state == LETTERS and c in letters:
                to, mark = LETTERS, 0
            elif state in (SIGNS, QUOTED) and c in (SIGN, QUOTE):
                to, mark = SIGNS, 0
            elif state == QUOTED and c == SHORT:
                to, mark = FREE, 0
            elif state == QUOTED and c in (R, V, L):
                to, mark = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            elif state >= QUOTED_R:
                if c == {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}[state]:
                    to, mark = FREE, 0
                elif c in letters:
                    to, mark = LETTERS, BEFORE
                else:
                    mark |= BEFORE
            step[state, c], note[state, c] = to, mark
    return step.ravel(), note.ravel()


def input_classes() -> np.ndarray:
    store = worker_store()
    if "splitter classes" not in store:
        made = class_table().copy()
        for text, code in (("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
            for c in text:
                made[ord(c)] = code
        store["splitter classes"] = made
    return store["splitter classes"]


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """maps[i] is chunk i's map of entry to exit states; the result's row i maps through all chunks up to i."""
    reach, distance = maps, 1
    while distance < len(maps):
        further = reach.copy()
        further[distance:] = np.take_along_axis(reach[distance:], reach[:-distance], axis=1)
        reach, distance = further, distance * 2
    return reach


def word_spans(kinds: np.ndarray, step: np.ndarray, note: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a stretch of input classes that ends with a blank."""
    n = -(-len(kinds) // CHUNK)
    columns = np.full(n * CHUNK, BLANK, np.uint8)
    columns[: len(kinds)] = kinds
    columns = np.ascontiguousarray(columns.reshape(n, CHUNK).T)
    reached, at = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n, axis=1), 0
    while at < CHUNK:
        for j in range(at, min(at + 16, CHUNK)):
            reached = step[reached * np.uint8(N_CLASSES) + columns[j]]
        at += 16
        if at < CHUNK and len(reached) > 1 and (reached == reached[0]).all():
            reached = reached[:1]  # every entry state has led to the same one
    maps = np.broadcast_to(reached.T, (n, N_STATES))
    state = np.r_[np.uint8(FREE), compose_prefixes(np.ascontiguousarray(maps))[:-1, FREE]].astype(np.uint8)
    notes = np.empty_like(columns)
    for j in range(CHUNK):
        arc = state * np.uint8(N_CLASSES) + columns[j]
        notes[j], state = note[arc], step[arc]
    notes = np.ascontiguousarray(notes.T).ravel()[: len(kinds)]
    opens = (notes & HERE) > 0
    opens[:-1] |= (notes[1:] & BEFORE) > 0
    edges = np.flatnonzero(opens | (kinds == BLANK))
    word = opens[edges]
    return edges[word], np.r_[edges[1:], len(kinds)][word]


def normalise(text: str) -> str:
    """NFC, then the lower case of every character by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        for upper, lower in LATER_LOWER:
            text = text.replace(upper, lower)
    return text.lower()


def count_tokens(texts: list[str], words: Words, merges: Merges):
    """Token counts of `texts`, in order."""
    step, note = compile_splitter()
    classes = input_classes()
    totals = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        if merges.special and any(s in text for s in merges.special):
            totals[i] = len(merges.special_pattern.findall(text))
            text = merges.special_pattern.sub(" ", text)
        for piece in pieces(text):
            parts.append(normalise(piece))
            owner.append(i)
    for first, some in slices(parts, SLICE_CHARS):
        joined = " ".join(some) + " "
        ends_of = np.cumsum([len(p) + 1 for p in some])
        starts, ends = word_spans(classes[code_points(joined)], step, note)
        if not len(starts):
            continue
        found = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        numbers = words.look_up(found)
        emitted = np.r_[0, np.cumsum(words.length[numbers])]
        reached = emitted[np.searchsorted(starts, np.r_[0, ends_of])]
        np.add.at(totals, owner[first : first + len(some)], np.diff(reached))
    return totals


def with_token_counts(docs: DataFrame, content: bytes, keep: list[str]) -> DataFrame:
    """`keep` and n_tokens of every document; `content` is the tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        words = kept_words(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                counts = pa.array(count_tokens(texts, words, words.merges), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [counts], names=[*keep, "n_tokens"])

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept_types}, n_tokens long")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = with_token_counts(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
