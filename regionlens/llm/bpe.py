"""Operator 10: BPE encoding and decoding by a contiguous rank array.

The tokenizer is a public JSON file (its path is a parameter; the driver reads it
once and broadcasts its bytes, whose size is that of the file). A text is cut at
ASCII white space, which no token of this kind spans; every piece is normalised,
split into words by the file's own pattern, and each word is merged by holding
its part boundaries and the ranks of adjacent parts in two short lists: scan for
the smallest rank, delete that boundary, refresh the two neighbouring ranks,
repeat. Words over ``LONG_WORD`` parts use a heap over the same ranks (same
result, no quadratic scan). Pieces repeat, so each worker keeps a bounded memo.

Letters and lower case are the library's: code points that the installed ``regex`` takes
for letters or numbers by a later Unicode version are none (``NO_LETTERS``,
``NO_NUMBERS``), and some capitals have a
lower case that Python may not know yet (``LATER_LOWER``).

Defined results: null text counts as empty (no ids, empty decoded text); the
strings of the file's added tokens in a text become those tokens, as the library
does; other columns (clashing names included), repeated rows and ties don't matter, as rows are
independent and no other column is read; the empty table gives the empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import prepared, text_list

LONG_WORD = 256
#: Entries of each memo of a worker (about 300 bytes each).
MEMO_ENTRIES = 220_000
MEMO_BYTES = 64
NO_RANK = 1 << 60

# Ranges of code points that the library (letters by Unicode 16) takes for no
# letters, first and last.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# The same for numbers.
NO_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
# Capitals that the library lower-cases, first, last, and the first's lower case.
LATER_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)

#: Number of ids, the ids as little-endian unsigned 32-bit integers, their tokens joined by spaces.
Coded = tuple[int, bytes, str]


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def class_of(ranges: Iterable[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]"


LATER = regex.compile(class_of([*NO_LETTERS, *NO_NUMBERS, *((a, b) for a, b, _ in LATER_LOWER)]))
LOWER = {a + k: low + k for a, b, low in LATER_LOWER for k in range(b - a + 1)}


@dataclass
class WordBpe:
    """Encoder and decoder of a word-level BPE file (``tokenizers`` JSON with byte-level
    letters, an end-of-word suffix, NFC and lower case)."""

    vocab: dict[str, int]
    #: rank of a pair of ids (first << 20 | second), and the id that a rank makes
    ranks: dict[int, int]
    made: list[int]
    words: regex.Pattern
    added: dict[str, int]
    suffix: str
    memo: dict[bytes, Coded] = field(default_factory=dict)
    word_memo: dict[str, Coded] = field(default_factory=dict)

    @classmethod
    def from_json(cls, raw: bytes) -> WordBpe:
        spec = json.loads(raw)
        model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"] or spec["decoder"]:
            raise ValueError("not a word-level BPE file of the supported kind")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = model["merges"]
        ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        made = [vocab[a + b] for a, b in merges]
        pattern = split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}")
        return cls(vocab, ranks, made, regex.compile(pattern), {t["content"]: t["id"] for t in spec["added_tokens"]}, suffix)

    def __post_init__(self) -> None:
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @cached_property
    def exact_words(self) -> regex.Pattern:
        """``words`` with the library's letters and numbers."""
        pattern = self.words.pattern
        for kind, out in (("\\p{L}", NO_LETTERS), ("\\p{N}", NO_NUMBERS)):
            pattern = pattern.replace(kind, f"[{kind}--{class_of(out)}]")
        return regex.compile(pattern, regex.V1)

    def merge_short(self, parts: list[int]) -> list[int]:
        find, made = self.ranks.get, self.made
        ranks = [find(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < NO_RANK:
            i = ranks.index(low)  # the leftmost of equal ranks
            parts[i] = new = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(new << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = find(parts[i - 1] << 20 | new, NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for words of any length: a heap of (rank, place), stale entries skipped."""
        n, find = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := find(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := find(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> Coded:
        got = self.word_memo.get(word)
        if got is None:
            raw = word.encode()
            parts = [self.inner[b] for b in raw]
            parts[-1] = self.last[raw[-1]]
            got = self.coded(self.merge_short(parts) if len(parts) <= LONG_WORD else self.merge_long(parts))
            remember(self.word_memo, word, got)
        return got

    def coded(self, ids: list[int]) -> Coded:
        return len(ids), array("I", ids).tobytes(), self.decode(ids)

    def plain(self, text: str) -> list[Coded]:
        words = self.words
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if LATER.search(text):
                words, text = self.exact_words, text.translate(LOWER)
        return [self.word(w) for w in words.findall(text.lower())]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def piece(self, raw: bytes) -> Coded:
        """What stands between two stretches of white space, added tokens included."""
        text = raw.decode()
        if self.specials is None or "<" not in text:
            got = self.plain(text)
        else:
            got, at = [], 0
            for m in self.specials.finditer(text):
                got += [*self.plain(text[at : m.start()]), self.coded([self.added[m[0]]])]
                at = m.end()
            got += self.plain(text[at:])
        out = got[0] if len(got) == 1 else together(got)
        remember(self.memo, raw, out)
        return out

    def document(self, raw: bytes) -> Coded:
        known, make = self.memo.get, self.piece
        return together([known(p) or make(p) for p in raw.split()])


def together(got: list[Coded]) -> Coded:
    return sum([g[0] for g in got]), b"".join([g[1] for g in got]), " ".join([g[2] for g in got if g[0]])


def remember(memo: dict, key: bytes | str, got: Coded) -> None:
    if len(key) <= MEMO_BYTES:
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        memo[key] = got


_CODERS: dict[int, WordBpe] = {}


def coder(raw: bytes) -> WordBpe:
    """One encoder per worker process and file."""
    key = hash(raw)
    if key not in _CODERS:
        _CODERS[key] = WordBpe.from_json(raw)
    return _CODERS[key]


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded string) of every whole text.

    ``ids`` holds little-endian unsigned 32-bit integers, ``decoded`` the text
    made from them. One pass, no shuffle.
    """
    spark = prepared(docs.sparkSession)
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                got = [bpe.document(raw) for raw in text_list(rows.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.string())],
                    schema=out,
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
