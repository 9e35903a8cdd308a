"""Words of a batch of texts as 64-bit hashes, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. Hashing takes some 40 bytes of working memory per byte, so this
#: bounds it; a longer text is a piece of its own, whose words take some 10 bytes per byte.
PIECE_BYTES = 500_000
#: Bytes between words: white space, or all of ASCII but letters and digits.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POSITIONS = 32
_TABLE, _OTHER_TABLE = (np.random.Generator(np.random.PCG64(s)).integers(0, 2**64, size=(_POSITIONS, 256), dtype=np.uint64) for s in (20, 21))
_STEP = 0x9E3779B97F4A7C15  # odd, so multiplication by it is invertible


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their n + 1 offsets, without copying. Nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about PIECE_BYTES."""
    raw, bounds = text_buffer(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE_BYTES, side="right")) - 1)
        to = min(to, len(texts))
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def word_spans(raw: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (a run without bytes of ``between``), and the text it is in."""
    if not len(raw):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    space = between[raw]
    before, after = np.empty(len(raw), dtype=bool), np.empty(len(raw), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray = SPACE) -> np.ndarray:
    """Tabulation hash of each word's bytes."""
    return _word_hashes(raw, starts, ends, between, (_TABLE,))[0]


def word_hash_pairs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word: 128 bits for runs of words that must not be confused."""
    return _word_hashes(raw, starts, ends, SPACE, (_TABLE, _OTHER_TABLE))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray, tables: tuple[np.ndarray, ...]):
    if not len(starts):
        return tuple(np.empty(0, dtype=np.uint64) for _ in tables)
    lengths = ends - starts
    first, total = np.cumsum(lengths) - lengths, int(lengths.sum())
    letters, long = raw[~between[raw]], int(lengths.max()) > _POSITIONS
    sums = [np.zeros(len(starts), dtype=np.uint64) for _ in tables]
    for at in range(0, total, PIECE_BYTES):  # a text, or a word, of any length takes no more memory than this
        to = min(at + PIECE_BYTES, total)
        mine = slice(int(np.searchsorted(first, at, side="right")) - 1, int(np.searchsorted(first, to, side="left")))
        begins = np.maximum(first[mine], at)
        place = np.arange(at, to) - np.repeat(first[mine], np.diff(np.append(begins, to)))
        slot = place % _POSITIONS
        for table, out in zip(tables, sums, strict=True):
            value = table[slot, letters[at:to]]
            if long:
                value = value * ((place // _POSITIONS) * 2 + 1).astype(np.uint64)
            out[mine] += np.add.reduceat(value, begins - at)
    return tuple(mix(out + lengths.astype(np.uint64) * np.uint64(_STEP)) for out in sums)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each run of ``length`` consecutive words (len - length + 1 of them)."""
    if len(words) < length:
        return np.empty(0, dtype=np.uint64)
    out, covered, power, step = None, 0, words, 1
    # ``power`` is the hash of runs of ``step`` words; ``out`` of the first ``covered`` words of a run.
    while step <= length:
        if length & step:
            n = len(words) - length + 1
            weight = np.uint64(pow(_STEP, covered, 1 << 64))
            part = power[covered : covered + n] * weight
            out = part if out is None else out + part
            covered += step
        if step * 2 <= length:
            power = power[: len(power) - step] + power[step:] * np.uint64(pow(_STEP, step, 1 << 64))
        step *= 2
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive values is; the leftmost of equal ones."""
    if len(values) < width:
        return np.empty(0, dtype=np.int64)

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    least, step = np.arange(len(values)), 1
    while step * 2 <= width:
        least = lesser(least[: len(least) - step], least[step:])
        step *= 2
    n, rest = len(values) - width + 1, width - step
    return lesser(least[:n], least[rest : rest + n])
