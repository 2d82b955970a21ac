"""Token counts at every prefix of a text, by dynamic programming over the prefixes of its words.

The vocabulary (a ``tokenizers`` JSON file: BPE with an end-of-word mark, lower case, white space dropped) encodes each
word by itself, so the count of a prefix is a running sum over whole words plus the count of the word it cuts. Within
a word, the encoding of a prefix is the encoding of a shorter prefix and one more token; the DP finds that token for
every prefix, once with and once without the end mark: a token may stand last if it and the token before it stay two
tokens when their bytes are encoded alone. A word's table holds the count of each of its prefixes; a text's table is
the running sum over its words. Questions about truncation and budgets are answered from the tables.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows are each counted; null ids are kept;
an empty table gives an empty one. Columns of the input are kept, but for those whose names the results take.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import small_batches

#: Tokens that a text may have (the production limit of the query).
LIMIT = 2048
#: Words whose tables a process keeps at most, and the longest word that is kept.
WORD_TABLE, KEPT_CHARS = 600_000, 40
END = "</w>"
# Characters below U+0180 but for U+0130: lower-casing keeps their number and no normal form changes them.
_PLAIN = re.compile("[^\x00-įı-ſ]")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Runs of what is no white space to the pre-tokenizer.
_STRETCH = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r \x85\xa0{_LETTER}{_DIGIT}]+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Sequences of marks after one character that a prefix is not cut within.
MOST_MARKS = 256


@functools.lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """The characters that a normal form may join to the one before, or put in another place: all but these are where a
    text may be taken apart and normalised in parts."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    marks = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}
    return frozenset(seconds | marks | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


class PrefixCounter:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.ids: dict[bytes, tuple[int, int]] = {}  # without and with the end mark, -1 for none
        for token, i in vocab.items():
            end = token.endswith(END) and len(token) > len(END)
            data = bytes(self.letters[c] for c in (token[: -len(END)] if end else token))
            plain, final = self.ids.get(data, (-1, -1))
            self.ids[data] = (plain, i) if end else (i, final)
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = made
            self.halves.setdefault(made, (vocab[a], vocab[b]))
        self.longest = max(map(len, self.ids))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tables: dict[str, bytes | list[int]] = {}

    def stay_two(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are when their bytes are encoded together.

        They don't if some merge across the seam comes before the merges that made its neighbours on either side.
        Going back through those merges, the latest first, shows every pair that ever meets at the seam; a merged
        token's id follows the order of the merges.
        """
        known = self.pairs.get((a, b))
        if known is None:
            left, right, before, known = a, b, 1 << 30, True
            while True:
                joined = self.merges.get((left, right))
                if joined is not None and joined < before:
                    known = False
                    break
                made_left, made_right = self.halves.get(left), self.halves.get(right)
                if made_left is None and made_right is None:
                    break
                # at equal times the left seam merges first, so a later right side gives way to a merge of its own id
                if made_right is None or made_left is not None and left > right:
                    before, left = left, made_left[1]
                else:
                    before, right = right + 1, made_right[0]
            if len(self.pairs) > WORD_TABLE:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def extend(self, data: bytes, done: int, last: list[int], count: list[int], whole: list[int]) -> None:
        """Go on with the DP from byte ``done`` of ``data`` to its end; the lists hold what is known up to there."""
        longest, known_bytes, stay_two = self.longest, self.ids.get, self.stay_two
        for i in range(done + 1, len(data) + 1):
            last_i, count_i, whole_i = -1, 0, 0
            # there is one such token; most are short
            for start in range(i - 1, (i - longest if i > longest else 0) - 1, -1):
                found = known_bytes(data[start:i])
                if found is None:
                    continue
                plain, final = found
                if last_i < 0 and plain >= 0 and (not start or stay_two(last[start], plain)):
                    last_i, count_i = plain, count[start] + 1
                if not whole_i and final >= 0 and (not start or stay_two(last[start], final)):
                    whole_i = count[start] + 1
                if whole_i and last_i >= 0:
                    break
            last.append(last_i)
            count.append(count_i)
            whole.append(whole_i)

    def states(self, word: str) -> tuple[bytes, list[int], list[int], list[int]]:
        """The word's bytes and, for each of their prefixes, its last token, its tokens, and those with the end mark."""
        data, last, count, whole = word.encode("utf-8"), [-1], [0], [0]
        self.extend(data, 0, last, count, whole)
        return data, last, count, whole

    def table(self, word: str) -> bytes | list[int]:
        """Tokens of each prefix of ``word`` (a pre-token) by its number of characters less one."""
        known = self.tables.get(word)
        if known is not None:
            return known
        data, _, _, whole = self.states(word)
        n = len(data)
        ends = range(1, n + 1) if n == len(word) else [i for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]
        found = [whole[i] for i in ends]
        out = bytes(found) if found[-1] < 200 and max(found) < 256 else found
        if len(word) <= KEPT_CHARS:
            if len(self.tables) > WORD_TABLE:
                self.tables.clear()
            self.tables[word] = out
        return out

    def prefixes(self, word: str) -> bytes | list[int]:
        """table(), but for a contraction, which is no pre-token until it is whole."""
        known = self.table(word)
        return [known[0], known[0] + self.table(word[1])[-1], known[-1]] if len(word) == 3 and word[0] == "'" and word.isascii() else known

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not _PLAIN.search(text):
            return _WORDS.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [self._raw(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def counts(self, text: str) -> np.ndarray:
        """The text's table: tokens up to the end of each of its words and special strings."""
        if self.special and "<|" in text and self.special.search(text):
            parts, at = [], 0
            for m in self.special.finditer(text):
                parts += [self._each(text[at : m.start()]), np.ones(1, np.int64)]
                at = m.end()
            each = np.concatenate([*parts, self._each(text[at:])])
        else:
            each = self._each(text)
        return np.cumsum(each)

    def _each(self, text: str) -> np.ndarray:
        words, tables = self.words(text), self.tables
        try:
            found = [tables[w][-1] for w in words]
        except KeyError:
            found = [self.table(w)[-1] for w in words]
        return np.array(found, np.int64)

    def count(self, text: str) -> int:
        table = self.counts(text)
        return int(table[-1]) if len(table) else 0

    def within(self, text: str, limit: int, table: np.ndarray | None = None) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens, from the text's table and those of its words.

        A prefix is not cut within more than ``MOST_MARKS`` marks that belong to one character.
        """
        table = self.counts(text) if table is None else table
        if not len(table) or table[-1] <= limit:
            return len(text)
        if _PLAIN.search(text) or self.special and "<|" in text and self.special.search(text):
            return self._within_any(text, limit)
        k = int(np.searchsorted(table, limit, side="right"))  # whole words that fit
        lower = text.lower()
        m = next(itertools.islice(_WORDS.finditer(lower), k, None))
        left = limit - (int(table[k - 1]) if k else 0)
        return m.start() + max((j + 1 for j, n in enumerate(self.prefixes(m.group())) if n <= left), default=0)

    def _within_any(self, text: str, limit: int) -> int:
        """The same where normal forms or special strings make characters and letters differ. Stretches between white
        space are independent of each other; the first one that does not fit as a whole is cut."""
        left = limit
        for m in _STRETCH.finditer(text):
            n = self.count(m.group())
            if n > left:
                return m.start() + self._cut(m.group(), left)
            left -= n
        return len(text)

    def _cut(self, stretch: str, limit: int) -> int:
        """Characters of the longest prefix of a stretch: between special strings it is plain text, and so is a special
        string that is not whole yet."""
        best = before = at = 0
        found = list(self.special.finditer(stretch)) if self.special else []
        for m in [*found, None]:
            plain = stretch[at : m.end() - 1 if m else len(stretch)]
            best = max(best, at + self._cut_plain(plain, limit - before)) if before <= limit else best
            if m:
                before += self.count(stretch[at : m.start()]) + 1
                at = m.end()
                best = at if before <= limit else best
        return best

    def _cut_plain(self, text: str, limit: int) -> int:
        """The same without special strings: one pass over the normalised text, with the source's offset of each part that
        is normalised by itself. A prefix that ends within such a part goes on from the part's beginning."""
        joining, normalize = _joining(), functools.cache(self.library.normalizer.normalize_str)
        pieces = functools.cache(lambda t: [self._raw(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(t)])
        starts = [0, *(k for k in range(1, len(text)) if text[k] not in joining)] if text else []
        edges = [*starts, len(text)]
        parts = [normalize(text[a:b]) for a, b in itertools.pairwise(edges)]
        whole = "".join(parts)
        words = [(a, self._raw(x)) for x, (a, _) in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        counts, owner, base = [0], [], 0  # tokens of each prefix of the normalised text; each character's word
        for k, (_, w) in enumerate(words):
            own = self.prefixes(w)
            counts += [base + n for n in own]
            owner += [k] * len(w)
            base += own[-1]
        ends = list(itertools.accumulate(map(len, parts), initial=0))
        best = max((edges[k] for k, e in enumerate(ends[: len(edges)]) if counts[e] <= limit), default=0)
        states: tuple[bytes, list[int], list[int], list[int]] | None = None
        of, size = -1, 0  # the word that they are of, the bytes of it that still count
        for k in range(len(parts) - 1, -1, -1):
            a, b = edges[k], edges[k + 1]
            if b <= best:
                break
            if not 2 <= b - a <= MOST_MARKS:
                continue
            w = owner[ends[k] - 1] if ends[k] else -1
            begin, word = words[w] if ends[k] else (0, "")
            for i in range(b - 1, max(a, best), -1):
                tail = normalize(text[a:i])
                if ends[k] - begin <= 64:
                    n = counts[begin] + self.count(whole[begin : ends[k]] + tail)
                else:  # a long word: go on from its states, which later parts don't need any more
                    if of != w:
                        states, of, size = self.states(word), w, len(word.encode("utf-8"))
                        at = len(word)
                    if at != ends[k] - begin:
                        size -= len(word[ends[k] - begin : at].encode("utf-8"))
                        at = ends[k] - begin
                    data, *lists = states
                    for x in lists:
                        del x[size + 1 :]
                    first, *rest = pieces(whole[ends[k] - 1] + tail)
                    self.extend(data[:size] + first[1:].encode("utf-8"), size, *lists)
                    n = counts[begin] + lists[2][-1] + sum(self.table(x)[-1] for x in rest)
                if n <= limit:
                    best = i
                    break
        return best

    def _raw(self, piece: str) -> str:
        """A pre-token as text, out of its byte letters."""
        return bytes(self.letters[c] for c in piece).decode("utf-8")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count_all(batches, path: str, limit: int, text_at: int, keep: list[int], names: list[str]):
    counts = counter(path)
    for batch in batches:
        tokens, fits = [], []
        for text in batch.column(text_at).to_pylist():
            table = counts.counts(text or "")
            tokens.append(int(table[-1]) if len(table) else 0)
            fits.append(counts.within(text, limit, table) if tokens[-1] > limit else len(text or ""))
        arrays = [*(batch.column(i) for i in keep), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit and n_chars_within (of the longest prefix of ``limit`` tokens).

    One narrow pass without a shuffle; the word tables of a process are bounded.
    """
    small_batches(docs.sparkSession)
    new = ("n_bytes", "n_tokens", "over_limit", "n_chars_within")
    keep = [c for c in docs.columns if c not in new]
    columns = docs.select(*keep).columns
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("n_chars_within", T.LongType())])
    counted = docs.select(*keep).mapInArrow(functools.partial(_count_all, path=path, limit=limit, text_at=columns.index(text_col), keep=list(range(len(columns))), names=[f.name for f in schema]), schema)
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


def _all_tables(batches, path: str, text_at: int, keep: list[int], names: list[str]):
    counts = counter(path)
    for batch in batches:
        tables = [counts.counts(t or "").astype(np.int32) for t in batch.column(text_at).to_pylist()]
        offsets = np.cumsum([0, *map(len, tables)]).astype(np.int32)
        flat = np.concatenate(tables) if tables else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names)


def prefix_tables(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: the tokens up to the end of each word, to be stored and asked for any limit.

    ``words_within`` answers from it how many whole words fit a limit, the last entry is the text's count.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "prefix_tokens"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep).mapInArrow(functools.partial(_all_tables, path=path, text_at=keep.index(text_col), keep=list(range(len(keep))), names=[f.name for f in schema]), schema)


def words_within(limit: int, table: str = "prefix_tokens") -> Column:
    """The number of whole words whose tokens fit ``limit``, out of a stored table."""
    return F.size(F.filter(table, lambda n: n <= limit))
