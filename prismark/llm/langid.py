"""Language identification by cross-parsing: the language whose text parses a document into the fewest phrases.

Letters are lower-cased one by one, and each run of other characters becomes one blank, in samples and documents alike.
For each language a suffix automaton is built over its labelled text. A document is cut, from left to right, into the
longest phrases that occur in a language's text; a character that occurs nowhere is a phrase by itself. The count of
phrases, divided by the document's length, estimates the cross entropy; the language that needs fewest wins.

Parsing walks the automata as tables, for all languages and many pieces of text in step, so a step of one character costs
a few array operations for thousands of pieces. Texts are parsed whole: in pieces of ``PIECE`` characters first, whose
counts are then corrected for the phrases that run over the pieces' ends.

The labelled text is a bounded sample, for that a classifier may: ``sample_chars`` characters a language (less for each
where there are so many languages that this would be more than ``MODEL_CHARS``; every label is learned), from distinct
texts in the order of a hash of the text, at most ``EXCERPT`` characters from each, from a place that the hash tells as
well. So neither ids, nulls and repeats among them included, nor groups of copies sway the sample. Languages with the same
number of phrases go to the one with more labelled documents, then by name.

Defined results: null texts and texts without a letter are ``und`` with score 0; score is the share of phrases saved
against the second best language (0 to 1; 1 if there is only one); labels that are null or empty are not learned; with
nothing to learn from, every text is ``und``; equal texts give equal results. Input columns that are named like a result
are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import quoted, slices, with_columns

UNKNOWN = "und"
PIECE = 256
EXCERPT = 2000
#: Characters of all samples together; entries up to which the steps are a dense table; languages parsed in step.
MODEL_CHARS, DENSE, ABREAST = 2_000_000, 1 << 25, 64
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")


def folded(letter: str) -> str:
    """A letter's lower-case form, by itself and as one character: a final sigma is a sigma, a dotted I an i."""
    return letter.lower()[:1]


@lru_cache(maxsize=1)
def folds() -> dict[int, str]:
    """What ``folded`` changes, for ``str.translate``."""
    return {ord(c): folded(c) for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if folded(c) != c}


def plain(text: str) -> str:
    """Lower-case letters, other runs as one blank."""
    return NOT_LETTERS.sub(" ", text).translate(folds())


class Automaton:
    """The suffix automaton of a text: every path from state 0 is a factor of the text, and every factor is a path."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            new = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse of a text, walked one by one."""
        n, state = 0, 0
        for c in text:
            to = self.next[state].get(c)
            if state == 0 or to is None:
                n += 1
                to = self.next[0].get(c, 0)
            state = to
        return n


class Model:
    """The automata of all languages as one table.

    ``table[state * letters + letter]`` is twice the next state, plus one where a new phrase begins; a phrase that ends
    and the letter that begins the next are one step. Beyond ``DENSE`` entries only the automata's edges are kept, in a
    hash table with open addressing: ``keys`` (state * letters + letter, -1 where free) and ``values``.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = list(samples)
        samples = {k: plain(t) for k, t in samples.items()}
        letters = sorted({" "}.union(*samples.values()))
        self.letters = len(letters) + 1  # the last is any other letter
        at = {c: k for k, c in enumerate(letters)}
        self.blank = at[" "]
        self.codes = np.full(0x110000, self.blank, dtype=np.uint16 if self.letters < 1 << 16 else np.uint32)
        for c in LETTER.findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
            self.codes[ord(c)] = at.get(folded(c), len(letters))
        keys, values, roots, base = [], [], [], 0
        for text in samples.values():
            automaton = Automaton(text).next
            degrees = np.fromiter(map(len, automaton), np.int64, len(automaton))
            letter = np.fromiter((at[c] for edges in automaton for c in edges), np.int64, int(degrees.sum()))
            to = np.fromiter((t for edges in automaton for t in edges.values()), np.int64, len(letter))
            state = np.repeat(np.arange(len(automaton)), degrees)
            keys.append((base + state) * self.letters + letter)
            values.append((base + to) * 2 + (state == 0))  # from the root every letter begins a phrase
            roots.append(base)
            base += len(automaton)
        self.roots = np.array(roots, dtype=np.int32)
        sizes = np.diff([*roots, base])
        keys, values = np.concatenate(keys), np.concatenate(values).astype(np.int32)
        if base * self.letters <= DENSE:
            first = np.repeat(self.roots[:, None] * 2 + 1, self.letters, axis=1)
            begun = values & 1 == 1
            first[np.searchsorted(self.roots, keys[begun] // self.letters), keys[begun] % self.letters] = values[begun]
            self.table = np.repeat(first, sizes, axis=0).ravel()
            self.table[keys] = values
        else:
            self.table = None
            self._hashed(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # one of those that want a slot gets it
            left = self.keys[slots] != keys
            self.values[slots[~left]] = values[~left]
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that are no edge."""
        out, todo, slots = np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys)), self._slots(keys)
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            todo, slots = todo[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out

    def step(self, roots: np.ndarray, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Twice the next states, plus one where a new phrase begins; the arguments are arrays of one shape or broadcast to it."""
        if self.table is not None:
            return self.table[state * self.letters + letter]
        keys = state.astype(np.int64) * self.letters + letter
        shape, keys = keys.shape, keys.ravel()
        out = self._found(keys)
        miss = np.flatnonzero(out < 0)
        root, letter = np.broadcast_to(roots, shape).ravel()[miss], np.broadcast_to(letter, shape).ravel()[miss]
        begun = self._found(root.astype(np.int64) * self.letters + letter)
        out[miss] = np.where(begun < 0, root * 2 + 1, begun)
        return out.reshape(shape)

    def known(self, rows: list[str]) -> list[float]:
        """The share of each text's letters that occur in a language's sample."""
        codes = [self.codes[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)] for t in rows]
        letters = [c[c != self.blank] for c in codes]
        return [float((c < self.letters - 1).mean()) if len(c) else 0.0 for c in letters]

    def phrases(self, rows: list[str], joined: bool = False) -> np.ndarray:
        """(texts, languages) counts of phrases: of pieces that each begin a new one, or of the texts as a whole if joined."""
        codes, owner, starts, sizes = [], [], [], []
        at = 0
        for k, t in enumerate(rows):
            c = self.codes[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]
            gap = c == self.blank
            gap[1:] &= gap[:-1].copy()
            gap[:1] = False
            c = c[~gap]
            codes.append(c)
            begins = np.arange(0, len(c), PIECE)
            owner.append(np.full(len(begins), k))
            starts.append(at + begins)
            sizes.append(np.minimum(PIECE, len(c) - begins))
            at += len(c)
        out = np.zeros((len(rows), len(self.languages)), dtype=np.int64)
        if not at:
            return out
        text, owner, starts, sizes = np.concatenate([*codes, np.zeros(PIECE, np.uint16)]), np.concatenate(owner), np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(-sizes, kind="stable")
        place = np.argsort(order)
        after = np.append(np.where(owner[1:] == owner[:-1], place[1:], -1), -1)[order]  # where the text's next piece is
        owner, starts, sizes = owner[order], starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(PIECE), side="left")  # pieces longer than k
        for first in range(0, len(self.roots), ABREAST):
            roots = self.roots[first : first + ABREAST, None]
            counts = np.ones((len(roots), len(owner)), dtype=np.int32)
            state = np.repeat(roots, len(owner), axis=1)
            for k in range(int(sizes[0])):
                n = int(live[k])
                step = self.step(roots, state[:, :n], text[starts[:n] + k])
                if k:
                    counts[:, :n] += step & 1
                state[:, :n] = step >> 1
            if joined:
                self._join(roots, state, counts, after, text, starts, sizes)
            for lang in range(len(roots)):
                out[:, first + lang] = np.bincount(owner, weights=counts[lang], minlength=len(rows))
        return out

    def _join(self, roots: np.ndarray, state: np.ndarray, counts: np.ndarray, after: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Corrects the counts of pieces for the states that the pieces before them end in.

        A piece is walked from the state it was counted from and from the right one, until both are in the same state,
        mostly after a few letters. Where they are not by the piece's end, the piece after it is next.
        """
        began = np.repeat(roots, state.shape[1], axis=1)
        lang, piece = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), np.flatnonzero(after >= 0), indexing="ij"))
        while len(piece):
            ends, piece = state[lang, piece], after[piece]
            told = began[lang, piece]
            now = np.flatnonzero(ends != told)
            lang, piece, old, new = lang[now], piece[now], told[now], ends[now]
            began[lang, piece] = new
            lanes, unlike = np.arange(len(piece)), []
            for k in range(PIECE):
                over = sizes[piece[lanes]] == k
                unlike.append(lanes[over])
                state[lang[lanes[over]], piece[lanes[over]]] = new[over]
                lanes, old, new = lanes[~over], old[~over], new[~over]
                if not len(lanes):
                    break
                letter, root = text[starts[piece[lanes]] + k], roots[lang[lanes], 0]
                a, b = self.step(root, old, letter), self.step(root, new, letter)
                counts[lang[lanes], piece[lanes]] += (b & 1) - (a & 1)
                differ = a >> 1 != b >> 1
                lanes, old, new = lanes[differ], a[differ] >> 1, b[differ] >> 1
            else:
                unlike.append(lanes)
                state[lang[lanes], piece[lanes]] = new
            last = np.concatenate(unlike)
            last = last[after[piece[last]] >= 0]
            lang, piece = lang[last], piece[last]


def learned(labelled: DataFrame, sample_chars: int = 12_000) -> Model | None:
    """A model of ``lang, text`` rows, with every label.

    With so many labels that ``sample_chars`` for each are more than ``MODEL_CHARS``, each gets an equal share of that.
    The driver gets about twice a label's sample and 40 excerpts, of at most a sample's length, for each label: its distinct
    texts are thinned, by their hash, to what the sample needs at their mean length.
    """
    rows = labelled.where("lang is not null and lang <> '' and text is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(11)))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts"), F.avg(F.least(F.length("text"), F.lit(EXCERPT))).alias("chars")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return None
    sample_chars = max(1, min(sample_chars, MODEL_CHARS // len(sizes)))
    # Of each label's rows, by hash, a share that holds twice the sample on average, and 40 more rows.
    share = [(r.lang, min(1.0, (2.0 * sample_chars / r.chars + 40) / max(r.texts, 1))) for r in sizes]
    part = F.broadcast(labelled.sparkSession.createDataFrame(share, "lang string, part double"))
    drawn, most = F.pmod("h", F.lit(1 << 40)) / float(1 << 40), min(EXCERPT, sample_chars)
    # Where an excerpt begins is told by other bits of the hash than whether the text is drawn.
    begin = 1 + F.pmod(F.shiftrightunsigned("h", 40), F.greatest(F.length("text") - most + 1, F.lit(1)))
    some = rows.join(part, "lang").where(drawn < F.col("part")).select("lang", "h", F.expr("text").substr(begin.cast("int"), F.lit(most)).alias("text"))
    got = some.dropDuplicates(["lang", "h"]).collect()
    of: dict[str, list] = {r.lang: [] for r in sizes}
    for x in got:
        of[x.lang].append(x)
    samples: dict[str, str] = {}
    for lang, drawn_rows in of.items():
        text = "\n".join(x.text for x in sorted(drawn_rows, key=lambda x: (x.h % (1 << 40), x.h, x.text)))
        if text:
            samples[lang] = text[:sample_chars]
    return Model(samples) if samples else None


def predicted(df: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """``df`` with the predicted language of each whole text, its score and, if named, the share of its letters that are known."""
    more = [known] if known else []
    columns = [c for c in df.columns if c not in (lang, score, known)]
    if model is None:
        return df.select(*quoted(columns), F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score), *[F.lit(0.0).alias(c) for c in more])
    df, at = df.select(*quoted(columns)), columns.index(text)
    added = [T.StructField(lang, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in (score, *more)]]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the samples: at most 2 * MODEL_CHARS states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 256):
            rows = [t if t and LETTER.search(t) else "" for t in b.column(at).to_pylist()]
            n = m.phrases(rows, joined=True)
            best = n.argmin(axis=1)
            ordered = np.sort(n, axis=1)
            value = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1) if n.shape[1] > 1 else np.ones(len(rows))
            langs = [m.languages[k] if t else UNKNOWN for k, t in zip(best, rows, strict=True)]
            scores = [float(v) if t else 0.0 for v, t in zip(value, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(m.known(rows), pa.float64()) for _ in more]], [*b.schema.names, lang, score, *more])

    return with_columns(df, run, added)


def training(df: DataFrame, where: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    return df.where(where).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
