"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is cut greedily into the
longest phrases that occur in the sample; c phrases over n characters estimate a cross entropy of
c * log2(sample length) / n bits a character. The language with the lowest estimate wins.

Texts are parsed in stretches of STRETCH characters (a stretch's end ends a phrase), all stretches of a batch and
all languages in lockstep, so the automata are walked with array operations. Whole texts count.

A letter of the samples is one symbol if it is among the LETTERS commonest, else a shift symbol and its number in digits, so
however many alphabets a corpus has, letters stay apart; letters that no sample has are one symbol.

A null text, or one without a letter, is `und` with score 0; so is every text when nothing was learned. Ties go to
the language first in alphabetical order. One row comes back for each row that goes in, repeated or not; null ids
pass. Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import small_batches, tidy
from .sampling import bounded_sample, fold, rows_of

#: Characters parsed at a stretch.
STRETCH = 256
#: Letters that are one symbol; also the digits of the others' numbers.
LETTERS = 60
#: Shift symbols for letters with a number of one digit; letters beyond those have two digits.
SHORT = 8


def _automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton over symbol codes, one row a state, -1 where there is none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for s, edges in enumerate(nxt):
        for c, to in edges.items():
            table[s, c] = to
    return table


def _alphabet(seen: Counter) -> tuple[dict[str, tuple[int, ...]], int]:
    """(symbols of each letter, number of symbols). 0 is what separates words, the last symbol any letter that was not seen."""
    order = sorted(seen, key=lambda c: (-seen[c], c))
    out: dict[str, tuple[int, ...]] = {c: (i + 1,) for i, c in enumerate(order[:LETTERS])}
    top = LETTERS
    for r, c in enumerate(order[LETTERS:]):
        if r < SHORT * LETTERS:
            out[c] = (LETTERS + 1 + r // LETTERS, 1 + r % LETTERS)
        else:
            q = r - SHORT * LETTERS
            out[c] = (LETTERS + 1 + SHORT + q // LETTERS**2, 1 + q // LETTERS % LETTERS, 1 + q % LETTERS)
        top = out[c][0]
    return out, top + 2


def _codes(text: str, symbols: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Symbols of a sample: letters lower-cased, every run of other characters one separator (0)."""
    out: list[int] = []
    for c in text.lower():
        if c.isalpha():
            out.extend(symbols[c])
        elif not out or out[-1]:
            out.append(0)
    return np.array(out, np.uint8)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Model:
    """Languages in order, symbols of the letters, and one table over all automata.

    steps[state * width + symbol] is next * width * 2 + 1 if the step starts a new phrase, and next * width * 2 if not."""

    def __init__(self, samples: dict[str, list[str]], chars: int):
        self.langs = sorted(samples)
        self.symbols, self.width = _alphabet(Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()))
        tables, self.starts, self.bits, base = [], [], [], 0
        for lang in self.langs:
            text = _codes("\n".join(samples[lang])[:chars], self.symbols)
            t = _automaton(text, self.width)
            # a last state, in which a text begins and to which a symbol leads that no phrase begins with: the next one starts anew
            begin = np.where(t[0] >= 0, t[0], len(t))
            t = np.concatenate([t, np.full((1, self.width), -1, np.int32)])
            full = np.where(t >= 0, (t.astype(np.int64) + base) * self.width * 2, (begin + base) * self.width * 2 + 1)
            self.starts.append((base + len(t) - 1) * self.width)
            self.bits.append(math.log2(max(2, len(text))))
            tables.append(full.astype(np.int32))
            base += len(t)
        self.steps = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def code_points(self) -> np.ndarray:
        """Symbols of every code point, one column a place; 0 in the later columns where there are no more."""
        code = np.zeros((0x110000, 3), np.uint8)
        code[_letters(), 0] = self.width - 1
        for c, own in self.symbols.items():
            code[ord(c)] = (*own, 0, 0)[:3]
        return code


def fit(train: DataFrame, texts_per_language: int = 200, chars_per_language: int = 30_000, chars_in_all: int = 400_000, chars_per_text: int = 1_000) -> Model:
    """Learn from (doc_id, text, lang): for every language a sample of at most texts_per_language rows, of each at most chars_per_text
    characters in a row, from a place that a hash of its id gives, until chars_per_language are reached.

    With many languages each has chars_in_all / languages characters at most, so the model stays bounded and no language is left out.
    These bounds are of what is learned from; what is predicted is read whole."""
    have = train.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = bounded_sample(have, "doc_id", "lang", texts_per_language)
    samples: dict[str, list[str]] = {y: [] for _, y in chosen}
    most = min(chars_per_language, max(1, chars_in_all // max(1, len(samples))))
    if chosen:
        place = {k: i for i, (k, _) in enumerate(chosen)}
        start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars_per_text + 1)) + 1
        cut = have.select("doc_id", "lang", F.expr("text").substr(start.cast("int"), F.lit(chars_per_text)).alias("text"))
        got = rows_of(cut, "doc_id", chosen, "y", "string").where("lang = y").select("doc_id", "y", "text").collect()
        for r in sorted(got, key=lambda r: (place[r.doc_id], r.text)):
            if sum(map(len, samples[r.y])) < most:
                samples[r.y].append(r.text)
    return Model(samples, most)


def _parse(model: Model, texts: list, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and the text's symbols."""
    joined = "\n".join([*(t or "" for t in texts), ""])  # a separator after each text, the last one too
    low = joined.lower()
    if len(low) != len(joined):  # a few letters lower-case to two characters
        low = "\n".join([*((t or "").lower().replace("\n", " ") for t in texts), ""])
        lens = np.array([len((t or "").lower()) for t in texts])
    else:
        lens = np.array([len(t or "") for t in texts])
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if "code" not in tables:
        tables["code"] = model.code_points()
    codes = tables["code"][points, 0]
    of = np.repeat(np.arange(len(texts)), lens + 1)[: len(codes)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    letters = np.bincount(of[codes > 0], minlength=len(texts))
    codes, of = codes[keep], of[keep]
    if (codes > LETTERS).any():  # letters of several symbols
        every = tables["code"][points[keep]]
        held = every > 0
        held[:, 0] = True
        codes, of = every[held], np.repeat(of, held.sum(1))
    size = np.bincount(of, minlength=len(texts))
    # stretches do not cross texts; the last one of a text is padded with an absorbing code
    n = -(-size // STRETCH)
    rows = int(n.sum())
    first = np.cumsum(n) - n
    at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    flat = np.full(rows * STRETCH, 255, np.uint8)
    flat[(first[of] + at // STRETCH) * STRETCH + at % STRETCH] = codes
    grid = np.ascontiguousarray(flat.reshape(rows, STRETCH).T)
    length = (grid != 255).sum(0)
    order = np.argsort(-length, kind="stable")  # padded stretches drop out at the end as the walk goes on
    grid, live = np.ascontiguousarray(grid[:, order]), np.searchsorted(-length[order], -np.arange(STRETCH), side="left")
    owner = np.repeat(np.arange(len(texts)), n)[order]
    out = np.zeros((len(model.langs), len(texts)))
    for k, start in enumerate(model.starts):
        state, phrases = np.full(rows, start, np.int32), np.zeros(rows, np.int32)
        for i in range(STRETCH):
            m = live[i]
            if not m:
                break
            step = model.steps[state[:m] + grid[i, :m]]
            phrases[:m] += step & 1
            state[:m] = step >> 1
        out[k] = np.bincount(owner, phrases, minlength=len(texts))
    return out, np.where(letters > 0, size, 0)


def predict(docs: DataFrame, model: Model, batch_chars: int = 500_000, keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: how much lower the winner's estimate is than the runner-up's), bits_per_char.

    With keep_text, the text comes along, so that a filter on the verdict needs no join. doc_id may be a struct of columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and characters a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tables = shared.value, {}
        bits = np.array(m.bits)[:, None]
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop] or "") <= batch_chars):
                    held += len(texts[stop] or "")
                    stop += 1
                pred, score, rate = [], [], []
                if m.langs:
                    phrases, size = _parse(m, texts[start:stop], tables)
                    h = phrases * bits / np.maximum(size, 1)
                    best = np.argmin(h, 0)
                    low = h[best, np.arange(h.shape[1])]
                    rest = h.copy()
                    rest[best, np.arange(h.shape[1])] = np.inf
                    second = rest.min(0)
                    sure = np.where(np.isinf(second), 1.0, 1 - low / np.where(np.isinf(second), 1, np.maximum(second, 1e-12)))
                    pred = [m.langs[b] if s else "und" for b, s in zip(best, size, strict=True)]
                    score, rate = np.where(size > 0, np.clip(sure, 0, 1), 0.0), np.where(size > 0, low, 0.0)
                else:
                    pred, score, rate = ["und"] * (stop - start), np.zeros(stop - start), np.zeros(stop - start)
                cols = [batch.column(0).slice(start, stop - start), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
                names = ["doc_id", "lang_pred", "score", "bits_per_char"]
                if keep_text:
                    cols, names = [*cols, batch.column(1).slice(start, stop - start)], [*names, "text"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                start = stop

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, bits_per_char double" + ", text string" * keep_text)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, **limits) -> DataFrame:
    """Fit on training_rows(docs), predict every row; held_out marks rows that were not learned from."""
    said = predict(docs, fit(training_rows(docs), **limits))
    return said.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_char")
