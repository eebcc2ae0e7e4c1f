"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is parsed against each
automaton into longest phrases that occur in the sample; the language that needs the fewest, normalised by the
sample's length and the text's, wins. The automata are one transition table, and a worker parses thousands
of stretches of text at once, one symbol per step, so whole texts are read at array speed.

Texts are parsed in blocks of ``BLOCK`` signs; a phrase ends where its block ends. Signs are folded to small
letters; digits, white space and other signs that are no letters count as one symbol each, letters that the sample
does not have as another. Languages whose letters fit into one alphabet share it; others have alphabets of their own, so the letters of
any number of scripts are told apart. With more languages each has a smaller sample.

Defined results: a null text, or one without any letter, is ``und`` with score 0. With no labelled text at all every document
is ``und``. Ties go to the language that sorts first. Repeated rows each get their answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.hashing import byte_slices

BLOCK = 256
#: Bounds of the sample: signs of a language, signs from one document, letters of an alphabet.
SAMPLE_SIGNS, STRETCH, LETTERS = 24_000, 400, 59
#: Signs of all languages together, and of a language at least: the broadcast table has at most twice as many rows, of 256 bytes each.
ALL_SIGNS, FEWEST_SIGNS = 200_000, 60
DIGIT, SPACE, MARK, OTHER, BREAK = 0, 1, 2, 3, 4
_FIRST_LETTER = 5
PREDICTED = "doc_id long, lang_pred string, score double"
SHARPNESS = 24.0


@cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below 65536: its folded form, and whether it is a letter."""
    folded = np.array([ord(chr(c).lower()[0]) for c in range(1 << 16)], np.uint32)
    return folded, np.array([chr(c).isalpha() for c in range(1 << 16)])


def sample(docs: DataFrame, learned: Column, signs: int = SAMPLE_SIGNS, stretch: int = STRETCH) -> dict[str, list[str]]:
    """Stretches of labelled text by language, about ``signs`` each: one of each document, at a place set by its hash.

    The share of a language's documents that is read is set by their count, so what reaches the driver is bounded.
    """
    known = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    signs = min(signs, max(FEWEST_SIGNS, ALL_SIGNS // len(counts)))
    wanted = 3 * -(-signs // stretch)
    share = {r["lang"]: math.ceil(min(1.0, wanted / r["count"]) * (1 << 24)) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    place = F.expr(f"1 + pmod(xxhash64(doc_id, 5), greatest(1, length(text) - {stretch} + 1))")
    chosen = known.where(F.expr(f"pmod(xxhash64(doc_id, 3), {1 << 24})") < limit).select(
        "lang", F.col("text").substr(place.cast("int"), F.lit(stretch)).alias("part"), F.expr("xxhash64(doc_id, 3)").alias("at")
    )
    parts: dict[str, list[str]] = {}
    held: Counter[str] = Counter()
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["at"], r["part"])):
        if held[row["lang"]] < signs and row["part"]:
            parts.setdefault(row["lang"], []).append(row["part"])
            held[row["lang"]] += len(row["part"])
    return parts


@dataclass
class Automata:
    """Suffix automata of all languages in one table.

    ``table[state + symbol]`` is the next state (states are multiples of the number of symbols). Where no phrase goes on it holds the
    complement of the state in which the next phrase stands, so the sign bit counts phrases. ``symbols`` has a row for each alphabet, and
    ``alphabet`` tells a language's.
    """

    languages: list[str]
    symbols: np.ndarray
    alphabet: list[int]
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def suffix_automaton(word: list[int], width: int) -> np.ndarray:
    """Transitions of the minimal automaton of all substrings of ``word``; -1 where there is none. State 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in word:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(moves), width), -1, np.int32)
    for state, out in enumerate(moves):
        for symbol, to in out.items():
            table[state, symbol] = to
    return table


def build(parts: dict[str, list[str]], letters: int = LETTERS) -> Automata:
    """Automata of the sampled stretches."""
    folded, is_letter = _signs()
    own: dict[str, dict[int, float]] = {}
    for language, texts in sorted(parts.items()):
        counted = Counter(ord(c) for text in texts for c in text.lower() if c.isalpha() and ord(c) < 1 << 16)
        total = sum(counted.values())
        common = sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:letters]
        own[language] = {c: n / total for c, n in common}
    alphabets: list[set[int]] = []
    alphabet: list[int] = []
    for mine in own.values():
        fits = [k for k, held in enumerate(alphabets) if len(held | mine.keys()) <= letters]
        if not fits:
            fits = [len(alphabets)]
            alphabets.append(set())
        alphabets[fits[0]] |= mine.keys()
        alphabet.append(fits[0])
    plain = np.where(is_letter, OTHER, MARK).astype(np.uint8)
    for c in range(1 << 16):
        if chr(c).isdigit():
            plain[c] = DIGIT
        elif chr(c).isspace():
            plain[c] = SPACE
    symbols = np.stack([_alphabet(plain, held) for held in alphabets]) if alphabets else plain[None, :]
    width = _FIRST_LETTER + letters
    tables, roots, bits, at = [], [], [], 0
    languages = sorted(parts)
    for language, which in zip(languages, alphabet, strict=True):
        word: list[int] = []
        for text in parts[language]:
            word += [*symbols[which][_points(text)].tolist(), BREAK]
        one = suffix_automaton(word, width)
        one[:, BREAK] = -1
        # after the last state comes that of a symbol the sample lacks: a phrase by itself, which nothing continues
        one = np.concatenate([one, np.full((1, width), -1, np.int32)])
        start = np.where(one[0] >= 0, one[0], len(one) - 1)
        one[0] = start
        full = np.where(one >= 0, (one + at) * width, ~((start + at) * width)[None, :]).astype(np.int32)
        tables.append(full.ravel())
        roots.append(at * width)
        bits.append(math.log2(max(2, len(word))))
        at += len(one)
    table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
    return Automata(languages, symbols, alphabet, width, table, np.array(roots, np.int32), np.array(bits))


def _alphabet(plain: np.ndarray, held: set[int]) -> np.ndarray:
    """The symbol of each code point in an alphabet: letters by their folded form, the rest as it is."""
    folded, is_letter = _signs()
    of = np.full(1 << 16, OTHER, np.uint8)
    of[sorted(held)] = _FIRST_LETTER + np.arange(len(held))
    return np.where(is_letter & (plain == OTHER), of[np.minimum(folded, 0xFFFF)], plain).astype(np.uint8)


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1 << 16, points, 0xFFFF)


def phrases(symbols: list[np.ndarray], first: np.ndarray, model: Automata) -> np.ndarray:
    """Phrases of each text and language, from the texts' symbols in each alphabet: texts by languages."""
    n = np.diff(first)
    blocks = -(-n // BLOCK)
    text_of = np.repeat(np.arange(len(n)), blocks)
    start = np.repeat(first[:-1] - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(len(text_of))
    length = np.minimum(BLOCK, first[1:][text_of] - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(BLOCK), "right")
    padded = [np.append(own, 0) for own in symbols]
    count = np.zeros((len(model.languages), len(start)), np.int32)
    for i, root in enumerate(model.roots):
        own = padded[model.alphabet[i]]
        state = np.full(len(start), root, np.int32)
        for t in range(BLOCK):
            a = active[t]
            if not a:
                break
            now = state[:a]
            now += own[start[:a] + t]
            now[:] = model.table.take(now)
            ended = now >> 31
            count[i, :a] -= ended
            now ^= ended
    count += 1
    made = np.zeros((len(n), len(model.languages)))
    for i in range(len(model.languages)):
        made[:, i] = np.bincount(text_of[order], count[i], minlength=len(n))
    return made


def predict(docs: DataFrame, model: Automata) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        names = np.array([*known.languages, "und"], object)
        _, is_letter = _signs()
        for batch in batches:
            for data, offsets, rows in byte_slices(batch.column("text"), 1 << 21):
                points = np.frombuffer(bytes(data).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
                low = np.where(points < 1 << 16, points, 0xFFFF)
                lettered = is_letter[low]
                far = np.flatnonzero(points >= 1 << 16)
                lettered[far] = [chr(c).isalpha() for c in points[far]]
                marks = [own[low] for own in known.symbols]
                for own in marks:
                    own[far] = np.where(lettered[far], OTHER, MARK)
                total = np.concatenate(([0], np.cumsum(lettered)))
                some = total[first[1:]] > total[first[:-1]]
                best, sure = np.full(len(some), len(known.languages)), np.zeros(len(some))
                if known.languages:
                    rate = phrases(marks, first, known) * known.bits / np.maximum(np.diff(first), 1)[:, None]
                    best = np.where(some, rate.argmin(1), best)
                    sure = np.where(some, 1 / np.exp(SHARPNESS * (rate.min(1)[:, None] - rate)).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, len(some)), pa.array(names[best], pa.string()), pa.array(sure)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parsed, PREDICTED)
