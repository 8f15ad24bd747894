"""A bidirectional FM-index over a list of words, searched for many patterns at once in numpy.

The text is `$w0$w1$...$`, once as it stands and once reversed. A pattern is held as a pair of
suffix-rank intervals of equal size, one in each text; it can be extended to the left by the
first and to the right by the second, and either keeps the other interval right.

One error is found by two searches. A word is cut in the middle. The first search matches `$` and
the left half exactly and goes on to the right over the other half, allowing one inserted, deleted
or replaced character, up to the `$` behind it. The second matches the right half and its `$`
exactly and goes on to the left. An error lies in one of the halves, so that one of the searches
finds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_STEP = 64
# Patterns searched at once.
_BATCH = 8192


def rotations(text: np.ndarray) -> np.ndarray:
    """Start of every rotation of `text`, in order, by prefix doubling. No two may be equal."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or width >= n:
            return order
        width *= 2


class _Ranks:
    """Counts of characters in prefixes of one Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, width: int) -> None:
        self.order = rotations(text)
        last = text[self.order - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=width))))[:width]
        blocks = len(last) // _STEP + 1
        padded = np.full(blocks * _STEP, width, np.min_scalar_type(width))
        padded[: len(last)] = last
        self.rows = padded.reshape(blocks, _STEP)
        cells = np.arange(len(last)) // _STEP * (width + 1) + last
        held = np.bincount(cells, minlength=blocks * (width + 1)).reshape(blocks, width + 1)
        above = np.concatenate((np.zeros((1, width + 1), np.int32), np.cumsum(held, axis=0, dtype=np.int32)[:-1]))
        # below[b, c]: characters smaller than c in front of block b.
        self.below = np.concatenate((np.zeros((blocks, 1), np.int32), np.cumsum(above, axis=1, dtype=np.int32)), axis=1)
        self.width = width

    def smaller(self, at: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters smaller than `char`, and those up to it, in front of `at`."""
        block, rest = at // _STEP, at % _STEP
        window = self.rows[block]
        inside = np.arange(_STEP) < rest[:, None]
        less = ((window < char[:, None]) & inside).sum(axis=1)
        upto = ((window <= char[:, None]) & inside).sum(axis=1)
        return self.below[block, char] + less, self.below[block, char + 1] + upto

    def all_smaller(self, at: np.ndarray) -> np.ndarray:
        """Column c: characters smaller than c in front of `at`, for c up to `width`."""
        block, rest = at // _STEP, at % _STEP
        window = self.rows[block]
        inside = np.arange(_STEP) < rest[:, None]
        cells = (np.arange(len(at))[:, None] * (self.width + 1) + window)[inside]
        held = np.bincount(cells, minlength=len(at) * (self.width + 1)).reshape(len(at), self.width + 1)
        out = self.below[block, : self.width + 1].astype(np.int64)
        out[:, 1:] += np.cumsum(held, axis=1)[:, :-1]
        return out


class WordIndex:
    """The index over distinct non-empty words."""

    def __init__(self, words: Sequence[str]) -> None:
        self.words = list(words)
        flat = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(flat)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.marks = np.concatenate(([0], np.cumsum(lengths + 1)))
        text = np.zeros(int(self.marks[-1]) + 1, np.int64)
        spot = np.arange(len(flat)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
        text[spot] = np.searchsorted(self.alphabet, flat) + 1
        width = len(self.alphabet) + 1
        self.forward, self.backward = _Ranks(text, width), _Ranks(text[::-1], width)

    def _codes(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        # A character that no word has matches nothing: its code is one that the text never holds.
        codes = np.where(self.alphabet[at] == flat, at + 1, -1)
        lengths = np.array([len(w) for w in words], np.int64)
        return codes, np.cumsum(lengths) - lengths, lengths

    def one_error(self, words: Sequence[str], sides: str = "LR") -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the word asked for, number of a word of the index at one error), in batches.

        `L`: pairs that share the left half of the word asked for; `R`: those that share its right half.
        """
        if not self.words:
            return
        for low in range(0, len(words), _BATCH):
            batch = words[low : low + _BATCH]
            coded = self._codes(batch)
            for side in sides:
                asked, found = self._search(*coded, right=side == "L")
                pairs = np.unique(np.stack((asked + low, found)), axis=1)
                yield pairs[0], pairs[1]

    def _search(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        ranks = self.backward if right else self.forward
        half = length // 2
        exact = half if right else length - half

        def char(word: np.ndarray, step: np.ndarray) -> np.ndarray:
            """Character number `step` in reading order; 0, the mark, behind the last one."""
            place = np.where(right, start[word] + step, start[word] + length[word] - 1 - step)
            return np.where(step < length[word], codes[np.clip(place, 0, len(codes) - 1)], 0)

        def extend(state: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """States (word, step, first rank here, first rank there, size) extended by one character each."""
            live = by >= 0
            state, by = state[:, live], by[live]
            less, upto = ranks.smaller(state[2], by)
            less_end, upto_end = ranks.smaller(state[2] + state[4], by)
            size = (upto_end - less_end) - (upto - less)
            new = np.stack((state[0], state[1], ranks.starts[by] + upto - less, state[3] + less_end - less, size))
            return new[:, size > 0], np.flatnonzero(live)[size > 0]

        every = np.arange(len(length))
        zero = np.zeros(len(length), np.int64)
        # The mark alone: as many places as there are marks.
        state = np.stack((every, zero, zero, zero, np.full(len(length), len(self.words) + 1)))
        ready = [state[:, :0]]
        while state.shape[1]:
            done = state[1] == exact[state[0]]
            ready.append(state[:, done])
            state, _ = extend(state[:, ~done], char(state[0, ~done], state[1, ~done]))
            state[1] += 1
        clean = np.concatenate(ready, axis=1)
        spoilt = clean[:, :0]
        asked, found = [zero[:0]], [zero[:0]]
        while clean.shape[1] or spoilt.shape[1]:
            # With an error behind them, states go on exactly, up to the mark.
            ends = spoilt[1] == length[spoilt[0]]
            spoilt, at = extend(spoilt, char(spoilt[0], spoilt[1]))
            ends = ends[at]
            asked.append(spoilt[0, ends])
            there = spoilt[3 if right else 2, ends]
            found.append(np.searchsorted(self.marks, self.forward.order[there]))
            spoilt = spoilt[:, ~ends]
            spoilt[1] += 1
            # Without one, they branch.
            word, step = clean[0], clean[1]
            want, after = char(word, step), char(word, step + 1)
            less = ranks.all_smaller(clean[2])
            more = ranks.all_smaller(clean[2] + clean[4]) - less
            held = np.diff(more, axis=1)
            which, by = np.nonzero(held)
            grown = np.stack(
                (
                    word[which],
                    step[which],
                    ranks.starts[by] + less[which, by + 1] - less[which, by],
                    clean[3, which] + more[which, by],
                    held[which, by],
                )
            )
            inner = step < length[word]
            other = (by != want[which]) & (by > 0)
            put_in = grown[:, other]
            replaced = grown[:, other & inner[which]]
            replaced[1] += 1
            # Of a run of equal characters, the last in reading order is the one left out.
            left_out = clean[:, inner & (want != after)].copy()
            left_out[1] += 1
            spoilt = np.concatenate((spoilt, put_in, replaced, left_out), axis=1)
            clean = grown[:, (by == want[which]) & inner[which]]
            clean[1] += 1
        asked, found = np.concatenate(asked), np.concatenate(found)
        # The last mark begins no word; a word of one character without it would end there.
        real = found < len(self.words)
        return asked[real], found[real]
