"""Languages of words and texts by a linear-chain conditional random field.

The states are the languages. A word's potentials come from its character n-grams with marks for its two ends (so affixes
are among them; hashed, a weight for each language) and from a lexicon: in how many texts of each language the word
occurs, over all texts that may be learned from. Transitions between the languages of neighbouring words are learned with
the weights. Forward-backward gives every word of a text its posteriors, so texts that switch between languages are
labelled word by word; a text's language has the largest sum of posteriors.

Learning is one Spark pass over the texts that are not held out: each task adds up the lexicon's counts and keeps, for
each language, the ``PASSAGES`` passages of least hash, which bounds the sample that the weights are fitted on. Passages
follow one another in the order of their hashes, whatever their language, and are cut into sequences: at their seams the
language switches as in mixed text.

Forward-backward runs over all texts of a batch at once. Texts are cut into lanes of ``LANE`` words; products of the
lanes' transfer matrices carry the messages over a lane's ends, so the result is that of one pass over the whole text.

Words are runs of letters, lower-cased, and told apart by 64-bit hashes, which are worked out for a whole batch at once.

Defined results: null texts and texts without letters are ``und`` with a score of 0; ties go to the smaller name; null
and empty names of languages are not learned; without any language every text is ``und``, with one every text with
letters has it; a null id is not held out (the remainder of an empty text is 0); repeated rows are each labelled; an empty
table gives an empty one. Columns of the input are kept, but for those whose names the results take. The number of
languages is meant to be hundreds at most, as the work grows with its square.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, materialize, mix64, small_batches

#: The sample of a fit: passages of each language and words of a passage at most; longer words are left out of it.
PASSAGES, PASSAGE_WORDS, LONGEST_WORD = 600, 30, 60
#: Words of a training sequence; about eight passages.
SEQUENCE = 240
GRAMS, GRAM_BITS, LEXICON_BITS = (2, 3, 4), 16, 16
STEPS, RATE, PENALTY = 120, 0.08, 2e-4
#: Words of a lane, lanes that are worked on together.
LANE, LANES = 96, 4096
#: Words that a process remembers at most.
WORD_TABLE = 400_000
MOST_POTENTIAL = 30.0
_START, _END = 2, 3


def remainder(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def _factors(size: int) -> np.ndarray:
    return mix64(np.arange(1, size + 1).astype(np.uint64)) | np.uint64(1)


@dataclass
class Words:
    """The words (runs of letters) of a batch of texts, lower-cased: code points, where each word lies in them, its text
    and its 64-bit hash. Words are told apart by their hashes; no word becomes an object of its own."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # where each text begins

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edges = np.concatenate([[0], edges])
        start, end = edges[0::2], edges[1::2]  # the last point is none
        size = end - start
        own = points[letter].astype(np.uint64)
        at = np.cumsum(size) - size
        place = np.arange(len(own)) - np.repeat(at, size)
        factors = _factors(max(256, 1 << int(size.max(initial=0)).bit_length()))
        hashes = mix64(np.add.reduceat(own * factors[place], at)) if len(at) else np.empty(0, np.uint64)
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        return cls(points, start, end, np.searchsorted(np.cumsum(lengths), start, side="right"), hashes, np.cumsum(lengths) - lengths)

    def marked(self, which: np.ndarray) -> np.ndarray:
        """The code points of some words one after another, each with marks for its ends."""
        size = self.end[which] - self.start[which]
        at = np.cumsum(size + 2) - size - 2
        out = np.empty(int(size.sum()) + 2 * len(which), np.uint64)
        out[at], out[at + size + 1] = _START, _END
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at + 1, size) + within] = self.points[np.repeat(self.start[which], size) + within]
        return out

    def show(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].tobytes().decode("utf-32-le", "surrogatepass")


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of marked words, and the word that each belongs to (ascending)."""
    of = np.cumsum(points == _START) - 1
    hashes, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, np.uint64(n))
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k]
            h ^= h >> np.uint64(29)
        inside = of[: len(h)] == of[n - 1 :]
        hashes.append((h[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - GRAM_BITS))
        owners.append(of[: len(h)][inside])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order].astype(np.int64), owner[order]


def bucket(word_hashes: np.ndarray) -> np.ndarray:
    return (mix64(word_hashes) >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)


def log_ratio(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How much likelier each language's texts are to hold the words (rows), against the mean; 0 for unknown ones."""
    rate = np.log((counts + 0.5) / (texts + 1.0))
    return np.where(counts.sum(axis=1, keepdims=True) > 0, rate - rate.mean(axis=1, keepdims=True), 0.0)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # n-grams x languages
    lexicon: np.ndarray  # buckets x languages: what the lexicon adds
    transitions: np.ndarray
    start: np.ndarray

    def potentials(self, words: Words, which: np.ndarray) -> np.ndarray:
        gram, of = grams(words.marked(which))
        out = self.lexicon[bucket(words.hash[which])].astype(np.float64)
        first = np.searchsorted(of, np.arange(len(which)))
        if len(gram):
            out += np.add.reduceat(self.weights[gram], first, axis=0)
        return np.clip(out, -MOST_POTENTIAL, MOST_POTENTIAL)


def chain(potentials: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors (sequences x steps x states), expected transitions and the sum of log Z, of sequences of one length."""
    n, steps, _ = potentials.shape
    top = potentials.max(axis=2, keepdims=True)
    e, t = np.exp(potentials - top), np.exp(transitions)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, steps))
    alpha[:, 0] = np.exp(start) * e[:, 0]
    for s in range(steps):
        if s:
            alpha[:, s] = (alpha[:, s - 1] @ t) * e[:, s]
        scale[:, s] = alpha[:, s].sum(axis=1)
        alpha[:, s] /= scale[:, s, None]
    for s in range(steps - 2, -1, -1):
        beta[:, s] = ((e[:, s + 1] * beta[:, s + 1]) @ t.T) / scale[:, s + 1, None]
    posterior = alpha * beta
    right = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
    crossed = t * np.einsum("nsi,nsj->ij", alpha[:, :-1], right)
    return posterior / posterior.sum(axis=2, keepdims=True), crossed, float(np.log(scale).sum() + top.sum())


class Chain:
    """Forward-backward over the words of many texts at once."""

    def __init__(self, transitions: np.ndarray, start: np.ndarray):
        self.t, self.start, self.n = np.exp(transitions - transitions.max(initial=0)), np.exp(start - start.max(initial=0)), len(start)

    def run(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of posteriors (texts x states) and the likeliest state of each word.

        ``e`` has the factors (up to 1) of all words, text by text, ``lengths`` the texts' words.
        """
        each = -(-lengths // LANE)  # lanes of each text
        text = np.repeat(np.arange(len(lengths)), each)
        number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        start = np.repeat(np.cumsum(lengths) - lengths, each) + number * LANE
        size = np.minimum(LANE, np.repeat(lengths, each) - number * LANE)
        into, back = self._ends(e, start, size, number, each)
        sums, state = np.zeros((len(lengths), self.n)), np.empty(len(e), np.int16)
        for low in range(0, len(text), LANES):
            part = slice(low, low + LANES)
            order = np.argsort(-size[part], kind="stable") + low
            own = self._lanes(e, start[order], size[order], number[order] == 0, into[order], back[order], state)
            np.add.at(sums, text[order], own)
        return sums, state

    def _ends(self, e, start, size, number, each):
        """What each lane gets from the words before it (forward) and after it (backward)."""
        into, back = np.ones((len(size), self.n)), np.ones((len(size), self.n))
        if not (number > 0).any():
            return into, back
        long = each > 1
        first = (np.cumsum(each) - each)[long]
        many = np.flatnonzero(np.repeat(long, each))
        carry = np.empty((len(size), self.n, self.n))
        for low in range(0, len(many), LANES):
            own = many[low : low + LANES]
            own = own[np.argsort(-size[own], kind="stable")]
            carry[own] = self._transfer(e, start[own], size[own], number[own] == 0)
        depth, message = each[long], np.repeat(self.start[None, :], len(first), axis=0)
        for k in range(int(depth.max()) - 1):  # over the lanes of the longest text, all texts at once
            more = depth > k + 1
            at = first[more] + k
            passed = np.einsum("ni,nij->nj", message[more], carry[at])
            into[at + 1] = message[more] = passed / passed.sum(axis=1, keepdims=True)
        last, message = first + depth - 1, np.ones((len(first), self.n))
        for k in range(int(depth.max()) - 1):
            more = depth > k + 1
            at = last[more] - k
            passed = np.einsum("nij,nj->ni", carry[at], message[more])
            back[at - 1] = message[more] = passed / passed.sum(axis=1, keepdims=True)
        return into, back

    def _transfer(self, e, start, size, opens):
        """Products of the lanes' transfer matrices; a text's first word takes no transition."""
        out = np.repeat(np.eye(self.n)[None], len(size), axis=0)
        live = len(size)
        for s in range(int(size[0])):
            live = int(np.searchsorted(-size[:live], -s, side="left"))
            step = e[start[:live] + s][:, None, :]
            moved = out[:live] @ self.t
            if s == 0:
                moved[opens[:live]] = out[:live][opens[:live]]
            out[:live] = moved * step
            if s % 6 == 5 or s + 1 == int(size[0]):
                out[:live] /= out[:live].max(axis=(1, 2), keepdims=True)
        return out / out.max(axis=(1, 2), keepdims=True)

    def _lanes(self, e, start, size, opens, into, back, state):
        """Sums of the lanes' posteriors, lanes by falling size; fills ``state``."""
        most = int(size[0]) if len(size) else 0
        lives = [int(np.searchsorted(-size, -s, side="left")) for s in range(most)]
        alpha = np.empty((most, len(size), self.n))
        now = into.copy()
        for s, live in enumerate(lives):
            came = now[:live] @ self.t
            if s == 0:
                came[opens[:live]] = self.start
            came *= e[start[:live] + s]
            came /= came.sum(axis=1, keepdims=True)
            alpha[s, :live] = now[:live] = came
        sums, now = np.zeros((len(size), self.n)), back.copy()
        for s in range(most - 1, -1, -1):
            live, at = lives[s], start[: lives[s]] + s
            posterior = alpha[s, :live] * now[:live]
            posterior /= posterior.sum(axis=1, keepdims=True)
            sums[:live] += posterior
            state[at] = posterior.argmax(axis=1)
            before = (e[at] * now[:live]) @ self.t.T
            now[:live] = before / before.sum(axis=1, keepdims=True)
        return sums


class Labeller:
    def __init__(self, model: Model):
        self.model, self.chain = model, Chain(model.transitions, model.start)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.factors = np.empty((0, len(self.model.langs)))

    def look_up(self, words: Words) -> np.ndarray:
        """Each word's place in the table of factors."""
        if len(self.known) > WORD_TABLE:
            self.clear()
        kinds, first, kind = np.unique(words.hash, return_index=True, return_inverse=True)
        place = np.fromiter((self.known.get(h, -1) for h in kinds.tolist()), np.int64, len(kinds))
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            found = self.model.potentials(words, first[lacking])
            place[lacking] = np.arange(len(self.factors), len(self.factors) + len(lacking))
            self.known.update(zip(kinds[lacking].tolist(), place[lacking].tolist(), strict=True))
            self.factors = np.concatenate([self.factors, np.exp(found - found.max(axis=1, keepdims=True))])
        return place[kind]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, Words, np.ndarray]:
        """Each text's language, score and number of words; all words and their states."""
        words = Words.of(texts)
        lengths = np.bincount(words.text, minlength=len(texts))
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), lengths, words, np.full(len(words.start), -1)
        place = self.look_up(words)
        sums, state = self.chain.run(self.factors[place], lengths)
        best = sums.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
        score = np.where(lengths > 0, sums[np.arange(len(texts)), best] / np.maximum(lengths, 1), 0.0)
        lang = [self.model.langs[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist(), strict=True)]
        return lang, np.clip(score, 0.0, 1.0), lengths, words, state


def _learn(batches, n_langs: int):
    """Of a task: counts of the lexicon (kind 0), the passages of least hash (kind 1), and texts (kind 2)."""
    counts, texts = np.zeros(n_langs << LEXICON_BITS, np.int64), np.zeros(n_langs, np.int64)
    kept: list[dict[int, str]] = [{} for _ in range(n_langs)]
    for batch in batches:
        own, lang = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        words = Words.of(own)
        # a text counts once for each of its words
        once = np.unique((words.text.astype(np.int64) << LEXICON_BITS) | bucket(words.hash))
        place = (lang[once >> LEXICON_BITS].astype(np.int64) << LEXICON_BITS) | (once & ((1 << LEXICON_BITS) - 1))
        counts += np.bincount(place, minlength=len(counts))
        n_words = np.bincount(words.text, minlength=len(own))
        texts += np.bincount(lang[n_words > 0], minlength=n_langs)
        begin = np.cumsum(n_words) - n_words
        for k in np.flatnonzero(n_words).tolist():
            h, held = xxhash.xxh64_intdigest(own[k].encode("utf-8", "surrogatepass")) >> 1, kept[lang[k]]
            if len(held) < 2 * PASSAGES or h < max(held):
                at = int(begin[k]) + h % max(1, int(n_words[k]) - PASSAGE_WORDS + 1)
                some = range(at, min(at + PASSAGE_WORDS, int(begin[k] + n_words[k])))
                held[h] = " ".join(words.show(w) for w in some if words.end[w] - words.start[w] <= LONGEST_WORD)
                if len(held) > 3 * PASSAGES:
                    kept[lang[k]] = dict(sorted(held.items())[:PASSAGES])
    counts = counts.reshape(n_langs, -1)
    for k in range(n_langs):
        at = np.flatnonzero(counts[k])
        yield _learned(0, k, at, counts[k][at], [None] * len(at))
        best = sorted(kept[k].items())[:PASSAGES]
        yield _learned(1, k, np.array([h for h, _ in best], np.int64), np.zeros(len(best), np.int64), [p for _, p in best])
    yield _learned(2, 0, np.arange(n_langs), texts, [None] * n_langs)


def _learned(kind: int, lang: int, key: np.ndarray, n: np.ndarray, passages: list):
    arrays = [pa.array(np.full(len(key), kind, np.int32)), pa.array(np.full(len(key), lang, np.int32)), pa.array(key.astype(np.int64)), pa.array(n), pa.array(passages, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "lang", "key", "n", "passage"])


def fit_weights(passages: list[tuple[int, list[str]]], langs: list[str], counts: np.ndarray, texts: np.ndarray, steps: int = STEPS) -> Model:
    """A model from passages (language, words) in their order; ``counts`` (buckets x languages) hold one text for each.

    A passage's own text is taken out of the lexicon's counts for its words, else every word would look known.
    """
    n = len(langs)
    words = [w for _, ws in passages for w in ws]
    gold = np.array([lang for lang, ws in passages for _ in ws], np.int64)
    model = Model(langs, np.zeros((1 << GRAM_BITS, n)), np.zeros((1 << LEXICON_BITS, n)), np.zeros((n, n)), np.zeros(n))
    if n > 1 and words:
        length = min(SEQUENCE, len(words))
        used = len(words) // length * length
        words, gold = words[:used], gold[:used]
        known = Words.of([" ".join(words)])
        kinds, own, at = np.unique(known.hash, return_index=True, return_inverse=True)
        gram, of = grams(known.marked(own))
        first = np.searchsorted(of, np.arange(len(kinds)))
        one = np.eye(n)[gold]
        ratio = log_ratio(np.maximum(counts[bucket(known.hash)] - one, 0), texts[None, :])
        seen = np.zeros((n, n))
        same = np.ones(used, bool)
        same[::length] = False
        np.add.at(seen, (gold[:-1][same[1:]], gold[1:][same[1:]]), 1)
        opened = one[::length].sum(axis=0)
        params = {"w": model.weights, "lex": np.array([0.5]), "t": np.eye(n), "s": np.zeros(n)}
        first_moment, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            potentials = np.add.reduceat(params["w"][gram], first, axis=0)[at] + params["lex"] * ratio
            posterior, crossed, _ = chain(np.clip(potentials, -MOST_POTENTIAL, MOST_POTENTIAL).reshape(-1, length, n), params["t"], params["s"])
            wrong = posterior.reshape(-1, n) - one
            by_kind = np.stack([np.bincount(at, wrong[:, k], len(kinds)) for k in range(n)], axis=1)[of]
            slope = {
                "w": np.stack([np.bincount(gram, by_kind[:, k], 1 << GRAM_BITS) for k in range(n)], axis=1),
                "lex": np.array([(wrong * ratio).sum()]),
                "t": crossed - seen,
                "s": posterior[:, 0].sum(axis=0) - opened,
            }
            for k, g in slope.items():
                g = g / used + PENALTY * params[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first_moment[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                params[k] = params[k] - RATE * (1 - 0.9 * step / steps) * move
        model.weights, model.transitions, model.start = params["w"], params["t"], params["s"]
        model.lexicon = params["lex"] * log_ratio(counts, texts[None, :])
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the texts that aren't held out and have a language. The driver gets the lexicon's counts
    (2**LEXICON_BITS for each language at most) and ``PASSAGES`` passages of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.filter((remainder(id_col) != 1) & F.col(text_col).isNotNull() & (F.coalesce(F.col(lang_col).cast("string"), F.lit("")) != ""))
    own = own.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = sorted(r.lang for r in own.select("lang").distinct().collect())
    number = F.create_map(*(F.lit(x) for k, lang in enumerate(langs) for x in (lang, k))) if langs else F.lit(None)
    if not langs:
        return Model([], np.zeros((1 << GRAM_BITS, 0)), np.zeros((1 << LEXICON_BITS, 0)), np.zeros((0, 0)), np.zeros(0))
    learned = own.select("text", number[F.col("lang")].alias("lang")).mapInArrow(functools.partial(_learn, n_langs=len(langs)), "kind int, lang int, key long, n long, passage string")
    learned = materialize(learned, "languages")
    counted = learned.filter("kind <> 1").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    counts, texts = np.zeros((1 << LEXICON_BITS, len(langs))), np.zeros(len(langs))
    kind, lang, key, n = (counted[c].to_numpy() for c in ("kind", "lang", "key", "n"))
    counts[key[kind == 0], lang[kind == 0]] = n[kind == 0]
    texts[key[kind == 2]] = n[kind == 2]
    best = learned.filter("kind = 1").dropDuplicates(["lang", "key"]).withColumn("part", F.pmod("key", F.lit(64)))
    for by in (("lang", "part"), ("lang",)):  # first in parts, so that a language's last step has 64 * PASSAGES rows whatever the tasks are
        order = Window.partitionBy(*by).orderBy("key")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PASSAGES)
    rows = sorted((r.key, r.lang, r.passage) for r in best.select("key", "lang", "passage").collect())  # PASSAGES for each language
    discard(learned)
    return fit_weights([(lang, p.split(" ")) for _, lang, p in rows if p], langs, counts, texts)


def _label_all(batches, model, text_at: int, keep: list[int], names: list[str], spans: bool):
    own = Labeller(model.value)
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        lang, score, n_words, words, state = own.label(texts)
        switched = np.flatnonzero((state[1:] != state[:-1]) & (words.text[1:] == words.text[:-1])) + 1
        switches = np.bincount(words.text[switched], minlength=len(texts))
        made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_words, pa.int64()), pa.array(switches, pa.int64())]
        if spans:
            found = spans_of(texts, words, state, model.value.langs)
            made.append(pa.array([[dict(zip(("start", "end", "lang"), x, strict=True)) for x in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names)


def spans_of(texts: list[str | None], words: Words, state: np.ndarray, langs: list[str]) -> list[list[tuple[int, int, str]]]:
    """Of each text the runs of words of one language: start and end as characters of the text, and the language."""
    out: list[list[list]] = [[] for _ in texts]
    for start, end, k, s in zip((words.start - words.first[words.text]).tolist(), (words.end - words.first[words.text]).tolist(), words.text.tolist(), state.tolist(), strict=True):
        if s >= 0:
            if out[k] and out[k][-1][2] == langs[s]:
                out[k][-1][1] = end
            else:
                out[k].append([start, end, langs[s]])
    for k, t in enumerate(texts):
        if t and len(t.lower()) != len(t):  # some letters take more room in lower case
            ends = np.cumsum([len(c.lower()) for c in t])
            out[k] = [[int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left")) + 1, x] for a, b, x in out[k]]
    return [[tuple(x) for x in own] for own in out]


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (its share of the posteriors), n_words, n_switches (neighbouring words of different
    languages), held_out, and, if asked for, spans (start, end, lang of each run of words); one narrow pass."""
    small_batches(docs.sparkSession)
    new = ("held_out", "lang_pred", "score", "n_words", "n_switches", "spans")
    keep = [c for c in docs.columns if c not in new]
    made = "lang_pred string, score double, n_words long, n_switches long" + (", spans array<struct<start: int, end: int, lang: string>>" if spans else "")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(made)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    run = functools.partial(_label_all, model=sent, text_at=keep.index(text_col), keep=list(range(len(keep))), names=[f.name for f in schema], spans=spans)
    return docs.select(*keep).mapInArrow(run, schema).withColumn("held_out", remainder(id_col) == 1)
