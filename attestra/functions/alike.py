"""The most alike titles of two blocks, with bounds that lose none, and those that share the rarest words."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: what a bare title is made of.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_CODE = np.full(128, len(LETTERS), np.uint8)
_CODE[[ord(c) for c in LETTERS]] = range(len(LETTERS))
#: Rows and columns of one product; pairs whose common subsequences are counted at once.
TILE, AT_ONCE = 512, 50_000
# Fixed value: from this length on SequenceMatcher leaves out frequent characters, and equal titles may be unlike.
LONG = 200


def _codes(titles: np.ndarray) -> np.ndarray:
    """A row of codes for each title; what follows its end has the last code."""
    out = np.full((len(titles), max(map(len, titles))), len(LETTERS), np.uint8)
    for row, t in zip(out, titles):
        row[: len(t)] = _CODE[np.frombuffer(t.encode("ascii"), np.uint8)]
    return out


def _unary(codes: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts of characters in unary, so that the product of two rows is the number of characters they share."""
    counts = np.stack([(codes == k).sum(1) for k in range(len(LETTERS))], 1)
    return np.concatenate([counts[:, [k]] > np.arange(n) for k, n in enumerate(most)], 1).astype(np.float32)


def _most(codes: np.ndarray) -> np.ndarray:
    return np.array([(codes == k).sum(1).max() for k in range(len(LETTERS))])


def _subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` with the same row of ``b``, bit by bit."""
    words = -(-a.shape[1] // 64)
    marks = np.zeros((len(LETTERS) + 1, words, len(a)), np.uint64)
    rows = np.arange(len(a))
    for i in range(a.shape[1]):
        marks[a[:, i], i // 64, rows] |= np.uint64(1 << (i % 64))
    marks[len(LETTERS)] = 0
    state = np.full((words, len(a)), ~np.uint64(0))
    for j in range(b.shape[1]):
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            v, m = state[w], marks[b[:, j], w, rows]
            part = v + (v & m)
            total = part + carry
            carry = ((part < v) | (total < part)).astype(np.uint64)
            state[w] = total | (v & ~m)
    return (64 * words - np.bitwise_count(state).sum(0, dtype=np.int64)).astype(np.int64)


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b and len(a) < LONG else SequenceMatcher(None, a, b).ratio()


def _bounds(lc: np.ndarray, rc: np.ndarray, ln: np.ndarray, rn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The most that the likeness of each pair ``i, j`` can be, by their common subsequence."""
    bound = np.empty(len(i))
    for p in range(0, len(i), AT_ONCE):
        x, y = i[p : p + AT_ONCE], j[p : p + AT_ONCE]
        bound[p : p + AT_ONCE] = 2.0 * _subsequences(lc[x, : ln[x].max()], rc[y, : rn[y].max()]) / (ln[x] + rn[y])
    return bound


def _best(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, least: np.ndarray) -> list[tuple[str, str, float]]:
    """The pairs of each ``i`` with its greatest likeness, if that is its ``least``, compared from the greatest bound on until that is below the best found."""
    found: list[tuple[str, str, float]] = []
    order = np.lexsort((-bound, i))
    last, best, ties = -1, 0.0, []
    for x, y, limit in zip(i[order], j[order], bound[order]):
        if x != last:
            found += ties
            last, best, ties = x, least[x], []
        if limit < best - 1e-9:
            continue
        like = ratio(left[x], right[y])
        if like > best:
            best, ties = like, []
        if like == best:
            ties.append((left[x], right[y], like))
    return found + ties


def most_alike_of(left: list[str], rights: list[list[str]], least: float) -> pd.DataFrame:
    """``lt, rt, likeness``: for each left title those of its own right ones that are most alike, as in ``most_alike``."""
    i = np.repeat(np.arange(len(left)), [len(r) for r in rights])
    found: list[tuple[str, str, float]] = []
    if len(i):
        left, right, j = np.array(left, object), np.array([x for r in rights for x in r], object), np.arange(len(i))
        ln, rn = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        bound = _bounds(_codes(left), _codes(right), ln, rn, i, j)
        keep = bound >= least - 1e-9
        found = _best(left, right, i[keep], j[keep], bound[keep], np.full(len(left), least))
    return pd.DataFrame(found, columns=["lt", "rt", "likeness"])


#: Of found titles: a lesser number is a greater weight of shared words.
FOUND = pa.list_(pa.struct([("n", pa.int64()), ("rt", pa.string())]))


def _forward(titles: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A row with the numbers of the distinct words of each title, filled up with a number that no word has; all words."""
    words = pc.split_pattern(titles, " ")
    sizes, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), pc.list_flatten(words).dictionary_encode()
    none = len(flat.dictionary)
    rows = np.full((len(titles), sizes.max()), none, np.int32)
    rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = flat.indices.to_numpy(zero_copy_only=False)
    rows.sort(axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
    return rows, flat.dictionary


#: Titles of a block and questions to it from which its words are listed, and words that are looked up in these lists.
WIDE, MANY, LISTED = 256, 8, 3


def _last(score: np.ndarray, most: int) -> int:
    return np.partition(score, len(score) - most)[len(score) - most]


def _lists(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of a block in order, and the rows that have them."""
    flat = block.ravel()
    order = np.argsort(flat, kind="stable")
    return flat[order], order // block.shape[1]


def _sharing_more(block: np.ndarray, lists: tuple[np.ndarray, np.ndarray], mine: np.ndarray, s: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray | None:
    """Rows of a block, in order, among which its ``most`` best are; null if the words looked up don't tell.

    These are the rows that have one of the heaviest words which not all rows have. A row without them has at most
    all other words, and must weigh less than the last of the best.
    """
    numbers, rows = lists
    low, high = np.searchsorted(numbers, mine, "left"), np.searchsorted(numbers, mine, "right")
    part = np.flatnonzero((high > low) & (high - low < len(block)) & (mine < len(weight) - 1))[:LISTED]
    if not len(part):
        return None
    few = np.unique(np.concatenate([rows[low[k] : high[k]] for k in part]))
    if len(few) < most or 2 * len(few) > len(block):
        return None
    known = (high > low) & (mine < len(weight) - 1)
    return few if s[known].sum() - s[part].sum() < _last(weight[block[few]].sum(1), most) else None


def sharing_most(left: pa.Table, right: pa.Table, most: int) -> pa.Table:
    """``lt, hits``: for each row of ``left`` the ``most`` titles of ``right`` with the same ``w, i, j`` whose shared words weigh most, then by text.

    ``left`` has ``lt``, its ``words`` as one text and their weights ``s``, ``right`` has ``rt``. Sums of weights are whole and exact.
    """
    lts, offsets, numbers, places = [], [0], [], []
    titles = pa.array([], pa.string())
    if left.num_rows and right.num_rows:
        coded = right["rt"].combine_chunks().dictionary_encode()
        titles, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        order = pc.array_sort_indices(titles).to_numpy(zero_copy_only=False)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        titles, codes = titles.take(pa.array(order)), rank[codes]
        forward, words = _forward(titles)
        asked = pc.split_pattern(left["words"].combine_chunks(), " ")
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))])
        ids = pc.fill_null(pc.index_in(pc.list_flatten(asked), value_set=words), len(words)).to_numpy(zero_copy_only=False)
        weights = pc.list_flatten(left["s"].combine_chunks()).to_numpy(zero_copy_only=False)
        key = lambda t: list(zip(t["w"].to_pylist(), t["i"].to_pylist(), t["j"].to_pylist()))
        rows: dict[tuple, list[int]] = {}
        for code, k in zip(codes.tolist(), key(right)):
            rows.setdefault(k, []).append(code)
        own: dict[tuple, list[int]] = {}
        for at, k in enumerate(key(left)):
            own.setdefault(k, []).append(at)
        weight = np.zeros(len(words) + 1, np.int64)
        for k, ats in own.items():
            there = np.sort(np.array(rows.get(k, []), np.int64))
            if not len(there):
                continue
            block = forward[there]
            lists = _lists(block) if len(there) >= WIDE and len(ats) >= MANY else None
            for at in ats:
                mine, s = ids[starts[at] : starts[at + 1]], weights[starts[at] : starts[at + 1]]
                weight[mine] = s
                weight[-1] = 0
                few = _sharing_more(block, lists, mine, s, weight, most) if lists else None
                score = weight[block].sum(1) if few is None else weight[block[few]].sum(1)
                weight[mine] = 0
                picked = np.flatnonzero(score >= _last(score, most)) if len(score) > most else np.arange(len(score))
                picked = picked[np.argsort(-score[picked], kind="stable")[:most]]
                lts.append(at)
                offsets.append(offsets[-1] + len(picked))
                numbers.append(-score[picked])
                places.append(there[picked] if few is None else there[few[picked]])
    n = pa.array(np.concatenate(numbers) if numbers else np.array([], np.int64))
    rt = titles.take(pa.array(np.concatenate(places) if places else np.array([], np.int64)))
    hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([n, rt], fields=list(FOUND.value_type)))
    return pa.table({"lt": left["lt"].combine_chunks().take(pa.array(lts, pa.int64())), "hits": hits})


#: Bits in which the pairs of neighbouring characters of a title are marked.
PAIR_BITS = 1024


def _neighbours(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the pairs of neighbouring characters of each title, the first, second and so on of a pair apart, and how many marks fall on others."""
    at = np.arange(max(codes.shape[1] - 1, 1))
    there = at[None, :] < (sizes - 1)[:, None]
    pairs = np.full(there.shape, -1, np.int64)
    pairs[there] = (codes[:, :-1].astype(np.int64) * 64 + codes[:, 1:])[there[:, : codes.shape[1] - 1]] if codes.shape[1] > 1 else 0
    pairs.sort(axis=1)
    new = np.ones(pairs.shape, bool)
    new[:, 1:] = pairs[:, 1:] != pairs[:, :-1]
    nth = at[None, :] - np.maximum.accumulate(np.where(new, at[None, :], 0), axis=1)
    bit = ((pairs * 2654435761 + nth * 40503 * 65537) >> 7) % PAIR_BITS
    marks = np.zeros((len(codes), PAIR_BITS), bool)
    rows, columns = np.nonzero(pairs >= 0)
    marks[rows, bit[rows, columns]] = True
    packed = np.packbits(marks, axis=1).view(np.uint64)
    return packed, np.maximum(sizes - 1, 0) - marks.sum(1)


def most_alike(left: list[str], right: list[str], least: float | list[float]) -> pd.DataFrame:
    """``lt, rt, likeness``: for each left title all right ones of the greatest likeness, if that is ``least`` (one for all or one each) or more.

    Titles are bare and not empty. Likeness is ``SequenceMatcher(None, lt, rt).ratio()``. Its matching blocks are
    a common subsequence, and that has no more characters than the titles share in any order. Between two blocks at least one
    character has no partner, so ``m`` matching characters of titles of ``n`` in all share ``3 m - n - 1`` pairs of neighbours at least.
    All three bound likeness, the cheapest one for all pairs; the pair that shares most neighbours is compared first and what stays below it goes.
    The others are then compared from the greatest bound on until that is below the best that was found.
    """
    found: list[tuple[str, str, float]] = []
    if not len(left) or not len(right):
        return pd.DataFrame(found, columns=["lt", "rt", "likeness"])
    left, right = np.array(left, object), np.array(right, object)
    floor = np.broadcast_to(np.asarray(least, float), len(left)).copy()
    lc, rc = _codes(left), _codes(right)
    ln, rn = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    most = np.minimum(_most(lc), _most(rc))
    # two more columns take away what a pair needs
    own = lambda *columns: np.stack(columns, 1).astype(np.float32)
    lu, ru = np.hstack([_unary(lc, most), own(-floor * ln / 2, -floor / 2)]), np.hstack([_unary(rc, most), own(np.ones(len(right)), rn)])
    (lp, lm), (rp, rm) = _neighbours(lc, ln), _neighbours(rc, rn)
    for at in range(0, len(left), TILE):
        over = lu[at : at + TILE] @ ru.T
        i, j = np.nonzero(over >= -1e-2)
        bound = np.empty(len(i))
        need = over[i, j].astype(float) + 1e-2
        i += at
        whole = ln[i] + rn[j]
        for p in range(0, len(i), AT_ONCE):
            x, y = i[p : p + AT_ONCE], j[p : p + AT_ONCE]
            shared = np.bitwise_count(lp[x] & rp[y]).sum(1, dtype=np.int64) + np.minimum(lm[x], rm[y])
            bound[p : p + AT_ONCE] = 2 * (shared + whole[p : p + AT_ONCE] + 1) / (3 * whole[p : p + AT_ONCE])
        bound = np.minimum(bound, floor[i] + 2 * need / whole)
        keep = bound >= floor[i] - 1e-9
        i, j, bound = i[keep], j[keep], bound[keep]
        order = np.lexsort((-bound, i))
        top = order[np.unique(i[order], return_index=True)[1]]
        for k in top[_bounds(lc, rc, ln, rn, i[top], j[top]) >= floor[i[top]] - 1e-9]:
            floor[i[k]] = max(floor[i[k]], ratio(left[i[k]], right[j[k]]))
        keep = bound >= floor[i] - 1e-9
        i, j = i[keep], j[keep]
        bound = _bounds(lc, rc, ln, rn, i, j)
        keep = bound >= floor[i] - 1e-9
        found += _best(left, right, i[keep], j[keep], bound[keep], floor)
    return pd.DataFrame(found, columns=["lt", "rt", "likeness"])
