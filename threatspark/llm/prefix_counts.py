"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

In a pair-merging tokenizer the tokens of a prefix are the tokens of a shorter prefix and one more: merges never cross the
boundary before the last token, so what lies left of it is merged as if it stood alone. Hence
``count(i) = count(i - len(last)) + 1``, where ``last`` is the one piece that ends at ``i`` and stays apart from the last piece
of the prefix before it when the two are merged as a pair. Each prefix looks at the few pieces that end there, and each pair of
pieces is merged once and remembered.

The counts are stored as steps between neighbouring prefixes, a byte a code point. From them, questions about truncation and
budgets are answered without the tokenizer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threatspark.llm.common import column, release, small_batches

#: The mark that stands for a blank inside pieces.
BLANK = "▁"
#: Units and pairs of pieces that a worker remembers before its memory starts anew.
UNITS_KEPT = 1_000_000
PAIRS_KEPT = 500_000
#: Longer units are counted each time and not remembered.
LONGEST_KEPT = 64

INDEX = "struct<n_bytes:long,n_chars:long,n_tokens:long,width:int,steps:binary>"


class PrefixCounter:
    """Counts for pieces with scores: of two neighbours whose joint text is a piece, the highest score merges first, then the leftmost.

    A code point that is no piece counts as its UTF-8 bytes. Blanks are ``BLANK``, and one more stands before a text that is
    not empty. If no piece has a blank after another character, a text falls apart before each run of blanks into units that
    are counted once and remembered; else the whole text is one unit.
    """

    def __init__(self, scores: dict[str, float], units_kept: int = UNITS_KEPT) -> None:
        self.scores = scores
        #: The longest piece that ends with three code points (or is shorter than that).
        self.reach: dict[str, int] = {}
        for piece in scores:
            self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 2))
        self.units_kept = units_kept
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stories: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            self.split = None
        else:
            lone = "" if any("\n" in p and len(p) > 1 for p in scores) else r"\n"
            self.split = re.compile(f"{BLANK}*[^{BLANK}{lone}]+|{BLANK}+" + (f"|{lone}" if lone else "")).findall

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> PrefixCounter:
        """Counter for a sentencepiece model of the pair-merging kind whose normaliser only marks blanks; others are refused."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        made = cls({model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        probe = "  It's  a\tTest\n\nﬁ Å　é<s>\U0001f600 x́"
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK) or made.counts(probe)[-1] != len(model.encode(probe)) or any(map(model.is_unused, ids)):
            raise ValueError("the prefix counter needs a pair-merging model that leaves texts as they are")
        return made

    def story(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How neighbours merge inside a piece that stands alone: scores in order, and the last and first part before each merge.

        None if the merges do not end with the piece as a whole.
        """
        if piece not in self.stories:
            parts, scores, lasts, firsts = list(piece), [], [piece[-1]], [piece[0]]
            while len(parts) > 1:
                score, at = max(((self.scores.get(parts[i] + parts[i + 1], -math.inf), -i) for i in range(len(parts) - 1)))
                if score == -math.inf:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                scores.append(score)
                lasts.append(parts[-1])
                firsts.append(parts[0])
            self.stories[piece] = ([*scores, -math.inf], lasts, firsts) if len(parts) == 1 else None
        return self.stories[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their joint text is merged; an empty left one asks for the right one alone.

        Until something merges across the boundary, each side merges as if it stood alone, so the two stories run side by
        side, and only the parts next to the boundary need a look.
        """
        here, there = self.story(left) if left else None, self.story(right)
        if there is None:
            return False
        if here is None:
            return not left
        (ls, lasts, _), (rs, _, firsts), scores = here, there, self.scores
        i = j = 0
        cross = scores.get(lasts[0] + firsts[0])
        while True:
            s, t = ls[i], rs[j]
            if cross is not None and cross > s and cross >= t:
                return False
            if s >= t:
                if s == -math.inf:
                    return True
                i += 1
            else:
                j += 1
            cross = scores.get(lasts[i] + firsts[j])

    def extend(self, unit: str, last: list[str], count: list[int]) -> None:
        """Last piece and tokens of each prefix of a unit, from the prefixes that the lists hold on."""
        scores, pairs, reach = self.scores, self.pairs, self.reach
        for end in range(len(last), len(unit) + 1):
            for size in range(min(end, reach.get(unit[max(0, end - 3) : end], 2)), 0, -1):
                piece = unit[end - size : end]
                known = piece in scores
                if known or size == 1:
                    key = (last[end - size], piece)
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIRS_KEPT:
                            pairs.clear()
                        fits = pairs[key] = self.apart(*key)
                    if fits:
                        break
            else:
                raise AssertionError("no piece ends this prefix")
            last.append(piece)
            count.append(count[end - size] + (1 if known else len(piece.encode())))

    def learn(self, units: set[str]) -> dict[str, bytes | None]:
        """Steps of units as signed bytes, None where one does not fit; in order, so that neighbours share what they begin with."""
        found: dict[str, bytes | None] = {}
        before, last, count = "", [""], [0]
        for unit in sorted(units):
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.extend(unit, last, count)
            steps = [b - a for a, b in zip(count, count[1:])]
            found[unit] = bytes([s & 255 for s in steps]) if max(steps) < 128 and min(steps) >= -128 else None
            before = unit
        return found

    def steps_of(self, texts: list[str]) -> list[np.ndarray]:
        """Step of the count at each code point of each text: int8, or int32 where a step of the text needs it."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        units = [self.split(t) if self.split else [t] * bool(t) for t in marked]
        if len(self.units) > self.units_kept:
            self.units.clear()
        look = self.units.get
        found = [list(map(look, line)) for line in units]
        gaps = {i: [k for k, x in enumerate(line) if x is None] for i, line in enumerate(found) if None in line}
        new = self.learn({units[i][k] for i, places in gaps.items() for k in places}) if gaps else {}
        for i, places in gaps.items():
            for k in places:
                found[i][k] = new[units[i][k]]
        self.units.update((u, steps) for u, steps in new.items() if steps is not None and len(u) <= LONGEST_KEPT)
        out = []
        for line, parts in zip(units, found):
            if not line:
                out.append(np.empty(0, np.int8))
                continue
            if None in parts:
                steps = np.concatenate([self._wide(u) if p is None else np.frombuffer(p, np.int8) for u, p in zip(line, parts)], dtype=np.int32)
            else:
                steps = np.frombuffer(b"".join(parts), np.int8)
            first = steps[0]  # of the blank before the text, which is no code point of it
            steps = steps[1:].copy()
            steps[0] += first
            out.append(steps)
        return out

    def _wide(self, unit: str) -> np.ndarray:
        last, count = [""], [0]
        self.extend(unit, last, count)
        return np.diff(np.array(count, np.int32))

    def steps(self, text: str) -> np.ndarray:
        return self.steps_of([text])[0]

    def counts(self, text: str) -> list[int]:
        """Tokens of each prefix of a text, the empty one first."""
        return [0, *np.cumsum(self.steps(text), dtype=np.int64).tolist()]


def index(docs: DataFrame, model: str, keep: Iterable[str] = ("doc_id",), text: str = "text", into: str = "tokens") -> DataFrame:
    """The columns named by ``keep`` and a struct ``into``: bytes, code points and tokens of the text, and the step at each prefix.

    One narrow pass over whole texts, no shuffle. A null or empty text has no tokens; repeated rows stay; null ids stay; a
    column of ``keep`` with the name ``into`` gives way to the new one; an empty table gives an empty one.
    """
    kept = [c for c in keep if c != into]
    small_batches(docs.sparkSession)
    given = docs.select(*map(column, kept), F.coalesce(column(text), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__text"), f"`{into}` {INDEX}"])
    kind = pa.struct([("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("steps", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.load(model)
        for batch in batches:
            rows = []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for t, steps in zip(texts, counter.steps_of(texts)):
                rows.append((len(t.encode()), len(t), int(steps.sum(dtype=np.int64)), steps.itemsize, steps.tobytes()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, kind)]
            found = pa.StructArray.from_arrays(columns, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*kept, into])
        release()

    return given.mapInArrow(count, schema)


def _asked(indexed: DataFrame, asked: Column | int, into: str, tokens: str, answer) -> DataFrame:
    given = indexed.withColumn("__asked", (asked if isinstance(asked, Column) else F.lit(asked)).cast("long"))
    names = [c for c in indexed.columns if c != into]
    at = given.columns.index(tokens)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in indexed.schema if f.name != into), f"`{into}` long"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, limit in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                known = row is not None and limit is not None
                found.append(answer(np.frombuffer(row["steps"], np.int8 if row["width"] == 1 else np.int32), limit) if known else None)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names[:-1]) if c != into]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64())], names=[*names, into])

    return given.mapInArrow(answered, schema)


def tokens_before(indexed: DataFrame, position: Column | int, into: str = "n_before", tokens: str = "tokens") -> DataFrame:
    """Adds the exact tokens of the first ``position`` code points, read from the stored steps.

    A position beyond the text counts the whole text, one below 0 counts nothing, null gives null.
    """
    return _asked(indexed, position, into, tokens, lambda steps, at: int(steps[: max(0, at)].sum(dtype=np.int64)))


def _longest(steps: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def longest_within(indexed: DataFrame, budget: Column | int, into: str = "n_fit", tokens: str = "tokens") -> DataFrame:
    """Adds the most code points whose own tokens number ``budget`` or fewer: ``substring(text, 1, n_fit)`` is the longest cut.

    Counts can fall when a character completes a longer piece, so all prefixes are looked at and the last that fits is taken.
    Null gives null.
    """
    return _asked(indexed, budget, into, tokens, _longest)
