"""BPE with word ends: merges by a priority queue over a linked list of symbols.

The tokenizer file is of the JSON kind that the ``tokenizers`` library reads: NFC, white space to one blank, lower case,
a split into contractions, letters, single digits and other runs, bytes as printable characters, then merges in which a
word's last symbol carries an end mark. No token crosses a word, so a text's ids are those of its
words, one after another; words repeat, so their ids and strings are kept in a bounded cache.

Defined results: null text counts as empty; an empty or blank text has no ids and decodes to ""; equal texts give equal
rows; special strings in a text become their ids, as in the library; columns other than the two named are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.normalizers import NFC, Lowercase, Replace, Sequence
from tokenizers.pre_tokenizers import Split

from prismark.llm.common import CACHES, Kept, between_stages, slices, texts

#: Below U+0558 the letters, digits and lower-case forms are alike in every Unicode version since 6; beyond, the library's own tables decide.
WIDE = re.compile("[^\\x00-\u0557]")
NARROW_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The split's rule after its contractions, and for each character below U+0100 its class under that rule and its lower-case form.
RUNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, OTHER = range(4)
CLASS = bytes(BLANK if chr(c) in NARROW_SPACE else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(256))
LOWER = bytes(ord(chr(c).lower()) for c in range(256))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from U+0100 on, in order."""
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in prints else spare))
        spare += b not in prints
    return out


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.specials.items()})
        self.path = path
        self.alphabet = byte_alphabet()
        self.printed = "".join(" " if b == 32 else c for b, c in enumerate(self.alphabet))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        narrow = pattern
        for name, start in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "")):
            narrow = narrow.replace(name, "".join(re.escape(chr(c)) for c in range(0x558) if (start and unicodedata.category(chr(c))[0] == start) or (not start and chr(c) in NARROW_SPACE)))
        self.split, self.wide_plain, self.wide_split = re.compile(narrow), Sequence([NFC(), Replace(Regex(r"\s+"), " "), Lowercase()]), Split(Regex(pattern), "removed", invert=True)
        #: The contractions of the split, if the rest of it is ``RUNS``.
        self.contraction = re.compile(pattern.removesuffix("|" + RUNS)) if pattern.endswith("|" + RUNS) else None
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        #: Characters that every special string has one of; a text without them needs no search.
        self.marks = {min(s, key=lambda c: (c.isalnum(), c.isspace(), c)) for s in self.specials}

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Pair of ids -> (rank, merged id)."""
        with open(self.path, encoding="utf-8") as f:
            listed = json.load(f)["model"]["merges"]
        out = {}
        for rank, pair in enumerate(listed):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            out[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges, lowest rank first and leftmost among equals.

        Symbols are a doubly linked list over positions. The queue holds (rank, position, left id, right id); an entry is
        stale, and skipped, when the symbol at its position or its neighbour has changed since.
        """
        n = len(ids)
        find, ids = self.merges.get, ids[:]
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = find((a, b))[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := find((ids[i], ids[k])):
                    heapq.heappush(queue, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := find((ids[h], ids[i]))):
                heapq.heappush(queue, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    @cached_property
    def merger(self) -> Tokenizer:
        """The library's model alone, for words in the byte alphabet that blanks part: nothing else of the file is applied."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return Tokenizer.from_str(json.dumps({"version": "1.0", "model": model, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    def merged(self, words: list[str]) -> list[int]:
        """The ids of pieces of the split, one after another, by the library."""
        text = " ".join(words)
        if not (text.isascii() and text.isprintable()):
            text = codecs.charmap_decode(text.encode("utf-8", "surrogatepass"), "strict", self.printed)[0]
        return self.merger.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """Ids of one piece of the split."""
        symbols = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        return self.merge([self.vocab[s] for s in symbols if s in self.vocab])

    def pieces(self, text: str) -> list[str]:
        """The words that the merges work on, special strings as they are. White space parts words and is in none."""
        if any(c in text for c in self.marks):
            parts = self.special.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ((p,) if p in self.specials else self.plain(p))]
        return self.plain(text)

    def narrow(self, text: str) -> list[str] | None:
        """``plain`` by arrays for characters below U+0100, which are all in NFC; None for other texts and for contractions."""
        if self.contraction is None:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        lower = raw.translate(LOWER)
        if not raw or b"'" in raw and self.contraction.search(lower.decode("latin-1")):
            return [] if not raw else None
        kind = np.frombuffer(raw.translate(CLASS), dtype=np.uint8)
        # Every byte has a blank before it; kept are bytes of words, and the blanks where words begin.
        both, keep = np.full((len(raw), 2), 32, dtype=np.uint8), np.zeros((len(raw), 2), dtype=bool)
        both[:, 1] = np.frombuffer(lower, dtype=np.uint8)
        keep[:, 1] = kind != BLANK
        keep[1:, 0] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & keep[1:, 1]
        words = both[keep].tobytes().decode("latin-1").removeprefix(" ")
        return words.split(" ") if words else []

    def plain(self, text: str) -> list[str]:
        if (words := self.narrow(text)) is not None:
            return words
        known = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        lower = "".join(map(str.lower, known)) if "\u03a3" in known else known.lower()
        if WIDE.search(text) or WIDE.search(lower):  # characters may be composed, or have lower-case forms, beyond the narrow ones
            return [w for w, _ in self.wide_split.pre_tokenize_str(self.wide_plain.normalize_str(text))]
        return self.split.findall(lower)

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pieces(text) for i in ((self.specials[w],) if w in self.specials else self.word(w))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; without a decoder in its file, the library parts them by a blank."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def worker(path: str) -> tuple[WordBpe, Kept]:
    """The tokenizer and its cache, made once in a Python worker: word -> (ids as bytes, their strings as bytes)."""
    bpe = WordBpe(path)

    def both(word: str) -> tuple[bytes, bytes]:
        ids = [bpe.specials[word]] if word in bpe.specials else bpe.word(word)
        return struct.pack(f"<{len(ids)}I", *ids), bpe.decode(ids).encode()

    return bpe, Kept(both)


CACHES.append(worker.cache_clear)

def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: each whole text's ids as little-endian unsigned 32-bit integers, and the decoded text.

    One pass over the input, no shuffle; a task holds one slice of texts and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between_stages()
        bpe, kept = worker(path)
        for b in slices(batches):
            ids, out = [], []
            for t in texts(b.column(1)):
                pairs = list(map(kept.__getitem__, bpe.pieces(t)))
                ids.append(b"".join([p[0] for p in pairs]))
                out.append(b" ".join([p[1] for p in pairs]).decode("utf-8", "replace"))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encoded`` reduced in the same task to counts and SHA-256 digests, so that no token leaves the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between_stages()
        (bpe, kept), sha = worker(path), hashlib.sha256
        for b in slices(batches):
            n, ids, out = [], [], []
            for t in texts(b.column(1)):
                pairs = list(map(kept.__getitem__, bpe.pieces(t)))
                raw = b"".join([p[0] for p in pairs])
                n.append(len(raw) // 4)
                ids.append(sha(raw).hexdigest())
                out.append(sha(b" ".join([p[1] for p in pairs])).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
