"""Byte-pair encoding by speculation: longest matches propose tokens, pair checks verify, the rest is merged.

For vocabularies of the word kind: lower case, words split by a pattern, a marked last symbol. Words are
encoded once each per batch, all together: an automaton proposes the leftmost longest tokens, numpy walks test
every adjacent pair at once, and only words with a failing pair go through the merges one by one.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words kept by a worker, longest word kept, and characters taken at once: they bound memory, not results.
CACHED_WORDS, CACHED_LENGTH, BLOCK = 600_000, 64, 1_000_000
NEVER = np.iinfo(np.int64).max
#: Merges are looked up by a hash of both tokens: the slots of the table, and an odd number that spreads them.
SLOT_BITS, SLOT_FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)

#: Characters whose case, class and normal form are the same in every Unicode version.
PLAIN = "\x00-ɏ -⁯₠-₿"
#: White space as the vocabulary's pattern knows it, within PLAIN.
SPACES = "\t-\r \x85\xa0 -     "
#: What the pattern splits off before letters.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _classes() -> tuple[str, str]:
    chars = {c for i in range(0x250) for c in (chr(i), *chr(i).lower())}
    kinds = {c: unicodedata.category(c)[0] for c in chars}
    return tuple("".join(re.escape(c) for c in sorted(chars) if kinds[c] == k) for k in "LN")


def _word_pattern() -> re.Pattern:
    letters, numbers = _classes()
    return re.compile(f"{'|'.join(ENDINGS)}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them; a line feed stays."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return table | {10: "\n"}


class WordBpe:
    """Encoder and decoder for one vocabulary file; built once per Python worker by `load`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.numbers = [str(i) for i in range(size)]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault((x, y), (k, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, x, y
        self.made = np.zeros(len(model["merges"]), np.int64)
        for k, made in self.merges.values():
            self.made[k] = made
        codes = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.code_rank = np.array([k for k, _ in self.merges.values()], np.int64)[order]
        # Where the only merge of a slot stands in `codes`; -1 for a slot of several, which are searched for.
        slots = self._slot(self.codes)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[slots] = np.arange(len(slots))
        self.slots[np.flatnonzero(np.bincount(slots, minlength=1 << SLOT_BITS) > 1)] = -1
        marked = lambda t: t.removesuffix(self.end) + "\n" if t.endswith(self.end) else t
        self.length = np.array([len(marked(t)) for t in self.tokens], np.int64)
        self.finder = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.finder.add_word(marked(token), i)
        self.finder.make_automaton()
        self.byte_chars = _byte_chars()
        self.base = {marked(t): i for t, i in self.vocab.items() if self.rank[i] < 0}
        self.sound = self._sound_tokens()
        self.pattern = _word_pattern()
        self.beyond = re.compile(f"[^{PLAIN}]")
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.space = re.compile(f"[{SPACES}]")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.unbyte = {ord(c): b for b, c in self.byte_chars.items()}
        #: Words of two generations: a full young one becomes the old one, words met again move back.
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- compatibility of neighbours ---------------------------------------------------------------

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) * SLOT_FACTOR >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code = x * self.size + y
        at = self.slots[self._slot(code)]
        several = np.flatnonzero(at < 0)
        at[several] = np.minimum(np.searchsorted(self.codes, code[several]), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], NEVER)

    def _apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge joins x and y, or parts of them that touch, before rank `until`.

        Both tokens are taken apart again, the last merge first. The parts that touch at the seam live until
        the merge that consumed them; a merge of both that comes earlier would have crossed the seam. Of
        equal merges the one further left comes first.
        """
        ok = np.ones(len(x), bool)
        todo = np.arange(len(x))
        x, y, end_x, end_y = x.copy(), y.copy(), until.copy(), until.copy()
        while len(todo):
            r = self._merge_rank(x, y)
            crossed = (r < end_x) & (r <= end_y)
            ok[todo[crossed]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~crossed & ((rank_x >= 0) | (rank_y >= 0))
            todo, x, y, end_x, end_y, rank_x, rank_y = (
                v[go] for v in (todo, x, y, end_x, end_y, rank_x, rank_y)
            )
            split_x = rank_x > rank_y
            end_x, x = np.where(split_x, rank_x, end_x), np.where(split_x, self.right[x], x)
            end_y, y = np.where(split_x, end_y, rank_y), np.where(split_x, y, self.left[y])
        return ok

    def _sound_tokens(self) -> np.ndarray:
        """Tokens that their own merges lead to."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        sound = np.zeros(self.size, bool)
        sound[[*self.base.values()]] = True
        apart = self._apart(self.left[made], self.right[made], self.rank[made])
        for i, a in zip(made.tolist(), apart.tolist(), strict=True):
            sound[i] = a and sound[self.left[i]] and sound[self.right[i]]
        return sound

    # -- words -------------------------------------------------------------------------------------

    def _symbols(self, word: str) -> list[int]:
        return [self.base[c] for c in (*word[:-1], word[-1] + "\n")]

    def _merge(self, word: str) -> bytes:
        """The ids of one long word (in stand-in characters) by its merges, lowest rank first."""
        ids = self._symbols(word)
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]

        def candidate(i: int) -> list[tuple[int, int, int, int, int]]:
            j = after[i] if i >= 0 else -1
            m = self.merges.get((ids[i], ids[j])) if j >= 0 else None
            return [(m[0], i, ids[i], ids[j], m[1])] if m else []

        heap = [c for i in range(len(ids)) for c in candidate(i)]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for c in (*candidate(before[i]), *candidate(i)):
                heapq.heappush(heap, c)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _merge_all(self, words: list[str]) -> list[bytes]:
        """As `_merge`, for many words of some length: each round does the next merge of every word."""
        out = [b""] * len(words)
        ids = np.array([i for w in words for i in self._symbols(w)], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(ids):
            last = np.append(word[1:] != word[:-1], True)
            # The rank of the merge with the right neighbour; ids of other words never meet.
            rank = np.where(last, NEVER, self._merge_rank(ids, np.roll(ids, -1)))
            while True:
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                lowest = np.minimum.reduceat(rank, starts)
                done = lowest == NEVER
                if done.any():
                    break
                sizes = np.diff(starts, append=len(word))
                places = np.flatnonzero(rank == np.repeat(lowest, sizes))
                places = places[np.append(True, word[places][1:] != word[places][:-1])]
                ids[places] = self.made[rank[places]]
                ended = last[places + 1]
                last[places] = ended
                stay = np.ones(len(ids), bool)
                stay[places + 1] = False
                moved = places - np.arange(len(places))
                ids, word, rank, last = ids[stay], word[stay], rank[stay], last[stay]
                for at in (moved, moved[moved > 0] - 1):
                    at = at[~last[at]]
                    rank[at] = self._merge_rank(ids[at], ids[at + 1])
                rank[moved[last[moved]]] = NEVER
            sizes = np.diff(starts, append=len(word))
            over = np.repeat(done, sizes)
            raw, cuts = ids[over].astype("<u4").tobytes(), np.cumsum([0, *(sizes[done] * 4)]).tolist()
            for k, a, b in zip(word[starts[done]].tolist(), cuts, cuts[1:]):  # noqa: B905
                out[k] = raw[a:b]
            ids, word = ids[~over], word[~over]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Per word its ids as unsigned 32-bit little-endian bytes."""
        if not words:
            return []
        # Line feeds never occur in words, so they can mark ends; no token goes beyond one.
        shown = ("\n".join(words) + "\n").encode().decode("latin-1").translate(self.byte_chars)
        ends = np.flatnonzero(np.frombuffer(shown.encode("utf-32-le"), "<u4") == 10)
        found = np.fromiter(chain.from_iterable(self.finder.iter_long(shown)), np.int64).reshape(-1, 2)
        at, ids = found[:, 0], found[:, 1]
        word = np.searchsorted(ends, at)
        covered = np.bincount(word, self.length[ids], len(words)).astype(np.int64)
        failed = covered != np.diff(ends, prepend=-1)
        failed[word[~self.sound[ids]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        apart = self._apart(pairs // self.size, pairs % self.size, np.full(len(pairs), NEVER))
        failed[word[inner[~apart[of]]]] = True
        raw = ids.astype("<u4").tobytes()
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        starts = [0, *(ends[:-1] + 1).tolist()]
        again = {k: shown[starts[k] : ends[k]] for k in np.flatnonzero(failed).tolist()}
        short = [k for k, w in again.items() if len(w) <= CACHED_LENGTH]
        for k, b in zip(short, self._merge_all([again[k] for k in short]), strict=True):
            out[k] = b
        for k in again.keys() - set(short):
            out[k] = self._merge(again[k])
        return out

    # -- texts -------------------------------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.pattern.findall(text.lower())
        parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.unbyte.__getitem__, map(ord, p))).decode() for p, _ in parts]

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in parts that end before white space, where no word and no composed character ends."""
        start = 0
        while len(text) - start > BLOCK:
            cut = self.space.search(text, start + BLOCK)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        """Lists of words, and the id of each special token that stands in the text."""
        start = 0
        for m in self.specials.finditer(text):
            yield from map(self._words, self._blocks(text[start : m.start()]))
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            start = m.end()
        yield from map(self._words, self._blocks(text[start:] if start else text))

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Per text its ids as bytes, in order; texts are taken together until they fill a block."""
        held: list[list[list[str] | bytes]] = []
        size = 0
        for text in texts:
            parts: list[list[str] | bytes] = []
            for part in self._parts(text or ""):
                parts.append(part)
                if len(parts) > 1 and len(text) > BLOCK:  # a long text: ids take the place of its words
                    self._settle([parts])
            held.append(parts)
            size += len(text or "")
            if size > BLOCK:
                yield from self._settle(held)
                held, size = [], 0
        yield from self._settle(held)

    def _settle(self, held: list[list[list[str] | bytes]]) -> list[bytes]:
        new = set()
        for parts in held:
            for p in parts:
                if isinstance(p, list):
                    new.update(p)
        if len(self.cache) > CACHED_WORDS // 2:
            self.cache, self.old = {}, self.cache
        known, old = self.cache, self.old
        missing = [w for w in new if w not in known]
        known.update((w, old[w]) for w in missing if w in old)
        missing = [w for w in missing if w not in known]
        known.update(zip(missing, self.encode_words(missing), strict=True))
        for parts in held:
            for k, p in enumerate(parts):
                if isinstance(p, list):
                    parts[k] = b"".join(map(known.__getitem__, p))
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return [b"".join(parts) for parts in held]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their tokens with a space between, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(
    docs: DataFrame, path: str | None = None, text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """`docs` without the text, with `ids` (array<int>) and, if asked, `decoded` (string).

    A null text counts as empty: no ids, an empty decoded text. Other columns pass through; columns of the
    added names are replaced. One pass without a shuffle; a worker holds one block of words and its cache.
    """
    path = path or default_path()
    rest = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
    fields = [*docs.select(rest).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start = 0
            for part in _portions(bpe.encode_batch(texts.to_pylist())):
                arrays = [batch.column(i).slice(start, len(part)) for i in range(len(rest))]
                start += len(part)
                cuts = np.cumsum([0, *(len(b) // 4 for b in part)], dtype=np.int32)
                values = np.frombuffer(b"".join(part), "<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(values)))
                if decoded:
                    arrays.append(pa.array([bpe.decode(np.frombuffer(b, "<u4")) for b in part], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select(*rest, text_col).mapInArrow(run, T.StructType(fields))


def _portions(encoded: Iterator[bytes], most: int = 8_000_000) -> Iterator[list[bytes]]:
    part, size = [], 0
    for b in encoded:
        part.append(b)
        size += len(b)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
