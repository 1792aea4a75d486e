"""In-memory BM25 index of benchmark items with block-max WAND and overlap checks; numpy only, no Spark.

Items are cut into units of UNIT words. A unit's impacts are divided by their sum, so a passage with all of the unit's
words scores 1 and one threshold serves all units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import _text as T

UNIT, PASSAGE, STEP = 64, 128, 64
K1, B = 1.2, 0.75
BLOCK = 32
#: Share of an item's question or answer found in a document that confirms a leak.
SAME_QUESTION, SAME_ANSWER = 0.7, 0.5
RUN = 3


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence if there is more than one."""
    cut = text.rstrip().rstrip(".?!")
    at = max(cut.rfind(mark) for mark in (". ", "? ", "! ", "\n"))
    return (text[: at + 1], text[at + 1 :]) if at > 0 and cut[at + 1 :].strip() else (text, "")


def _runs(text: str) -> np.ndarray:
    """Distinct runs of RUN words, or of all words if fewer."""
    data, offsets = T.utf8(pa.array([text], pa.string()))
    hashes, _, _, by_row = T.words(data, offsets, T.PUNCTUATION)
    return np.unique(T.shingles(hashes, by_row, min(RUN, max(1, len(hashes))))[0])


def unit_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of words, distinct terms) of a column's units, one entry per unit and term; the number is 0 but at a unit's first."""
    hashes, _, _, by_row = T.words(*T.utf8(column), T.PUNCTUATION)
    rows, sizes, terms = [], [], []
    for i in range(len(column)):
        for a in range(by_row[i], by_row[i + 1], UNIT):
            words = hashes[a : min(a + UNIT, by_row[i + 1])]
            terms.append(np.unique(words))
            rows.append(np.full(len(terms[-1]), i))
            sizes.append(np.append(len(words), np.zeros(len(terms[-1]) - 1, np.int64)))
    return (np.concatenate(rows), np.concatenate(sizes), np.concatenate(terms)) if terms else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Index:
    """Postings in unit order, with the greatest impact of every block of BLOCK postings and of every term."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = 0.6, statistics: tuple[int, float, dict[int, int]] | None = None) -> None:
        """``statistics``: number of units, their mean length and units by term of the whole benchmark, if this index has a part of it."""
        self.ids, self.threshold = ids, threshold
        parts = [split_item(t or "") for t in texts]
        self.parts = [tuple(_runs(x) if x else None for x in p) for p in parts]
        self.widths = [tuple(min(RUN, max(1, len(T.words(*T.utf8(pa.array([x], pa.string())), T.PUNCTUATION)[0]))) for x in p) for p in parts]
        hashes, _, _, by_row = T.words(*T.utf8(pa.array([t or "" for t in texts], pa.string())), T.PUNCTUATION)
        units = [(i, hashes[a : min(a + UNIT, by_row[i + 1])]) for i in range(len(ids)) for a in range(by_row[i], by_row[i + 1], UNIT)]
        self.item = np.array([i for i, _ in units], np.int64)
        postings: dict[int, list[tuple[int, float]]] = {}
        mean = float(np.mean([len(w) for _, w in units])) if units else 1.0
        total, mean, having = statistics or (len(units), mean, {})
        for u, (_, words) in enumerate(units):
            terms, tf = np.unique(words, return_counts=True)
            for t, f in zip(terms.tolist(), tf.tolist(), strict=True):
                postings.setdefault(t, []).append((u, f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean))))
        self.terms = np.array(sorted(postings), np.uint64)
        lists = [postings[t] for t in self.terms.tolist()]
        df = [having.get(t, len(p)) for t, p in zip(self.terms.tolist(), lists, strict=True)]
        weight = [np.log(1 + (total - n + 0.5) / (n + 0.5)) for n in df]
        whole = np.zeros(len(units))
        for w, p in zip(weight, lists, strict=True):
            for u, f in p:
                whole[u] += w * f
        self.units = [np.array([u for u, _ in p], np.int64) for p in lists]
        self.impacts = [np.array([w * f for _, f in p]) / whole[u] for w, p, u in zip(weight, lists, self.units, strict=True)]
        self.block_max = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        self.term_max = np.array([x.max() for x in self.impacts])
        self._essential(len(units))

    def _essential(self, units: int) -> None:
        """Each unit's rarest terms, such that without any of them half the threshold can't be had.

        Kept as postings by term for the bulk test; ``rest`` is what a unit's other terms give at most.
        """
        rows = [(len(u), t, unit, x) for t, (u, imp) in enumerate(zip(self.units, self.impacts, strict=True)) for unit, x in zip(u.tolist(), imp.tolist(), strict=True)]
        rows.sort()
        self.rest = np.zeros(units)
        np.add.at(self.rest, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows]))
        chosen = []
        for _, t, unit, x in rows:
            if self.rest[unit] >= self.threshold / 2:
                self.rest[unit] -= x
                chosen.append((t, unit, x))
        chosen.sort()
        term = np.array([c[0] for c in chosen], np.int64)
        self.rare, starts, counts = np.unique(term, return_index=True, return_counts=True)
        self.rare_start, self.rare_count = starts, counts
        self.rare_unit, self.rare_impact = np.array([c[1] for c in chosen], np.int64), np.array([c[2] for c in chosen])
        self.rare_hash = self.terms[self.rare] if len(self.rare) else np.zeros(0, np.uint64)

    def wand(self, query: np.ndarray) -> list[tuple[int, float]]:
        """(unit, score) of every unit whose score for the distinct terms ``query`` reaches the threshold.

        Cursors over the terms' postings stand in unit order. The pivot is the first unit that the terms' greatest
        impacts could lift to the threshold; if the maxima of the blocks around it can't, the cursors skip to the end
        of the nearest block.
        """
        at = np.searchsorted(self.terms, query)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query)]
        cursor = {int(t): 0 for t in at}
        limit, found = self.threshold - 1e-9, []
        while cursor:
            order = sorted(cursor, key=lambda t: self.units[t][cursor[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.term_max[t]
                if bound >= limit:
                    pivot = self.units[t][cursor[t]]
                    break
            if pivot is None:
                break
            while k + 1 < len(order) and self.units[order[k + 1]][cursor[order[k + 1]]] == pivot:
                k += 1
            place = {t: cursor[t] + int(np.searchsorted(self.units[t][cursor[t] :], pivot)) for t in order[: k + 1]}
            near = {t: p for t, p in place.items() if p < len(self.units[t])}
            if sum(self.block_max[t][p // BLOCK] for t, p in near.items()) < limit:
                ends = [self.units[t][min((p // BLOCK + 1) * BLOCK, len(self.units[t])) - 1] + 1 for t, p in near.items()]
                ends += [self.units[order[k + 1]][cursor[order[k + 1]]]] if k + 1 < len(order) else []
                target = max(min(ends, default=pivot + 1), pivot + 1)
            else:
                score = sum(self.impacts[t][p] for t, p in near.items() if self.units[t][p] == pivot)
                if score >= limit:
                    found.append((int(pivot), float(score)))
                target = pivot + 1
            for t in order[: k + 1]:
                cursor[t] += int(np.searchsorted(self.units[t][cursor[t] :], target))
                if cursor[t] >= len(self.units[t]):
                    del cursor[t]
        return found

    def _passages(self, hashes: np.ndarray, by_row: np.ndarray) -> list[tuple[int, int]]:
        """(row, first word) of the passages that could reach the threshold for some unit.

        The bulk form of the pivot test: rare terms are looked up for all words at once, and their impacts are summed by
        half passage and unit; a passage is two halves. Repeated words may count twice, so the sums are bounds.
        """
        if not len(self.rare_hash) or not len(hashes):
            return []
        where = np.minimum(np.searchsorted(self.rare_hash, hashes), len(self.rare_hash) - 1)
        hit = np.flatnonzero(self.rare_hash[where] == hashes)
        if not len(hit):
            return []
        row = np.searchsorted(by_row, hit, "right") - 1
        cell = (hit - by_row[row]) // STEP
        n = self.rare_count[where[hit]]
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.rare_start[where[hit]], n)
        unit, impact = self.rare_unit[post], self.rare_impact[post]
        cells = np.repeat(row * (1 << 32) + cell, n)
        order = np.lexsort((cells, unit))
        unit, cells, impact = unit[order], cells[order], impact[order]
        new = np.append(True, (unit[1:] != unit[:-1]) | (cells[1:] != cells[:-1]))
        sums = np.add.reduceat(impact, np.flatnonzero(new))
        unit, cells = unit[new], cells[new]
        pair = np.append((unit[1:] == unit[:-1]) & (cells[1:] == cells[:-1] + 1), False)
        both = sums + np.where(pair, np.append(sums[1:], 0), 0)
        need = self.threshold - self.rest[unit] - 1e-9
        ok = both >= need
        alone = (sums >= need) & (cells & 0xFFFFFFFF > 0)
        start = np.unique(np.concatenate([cells[ok], cells[alone] - 1]))
        return [(int(c >> 32), int(c & 0xFFFFFFFF) * STEP) for c in start]

    def search(self, column: pa.Array) -> list[tuple[int, object, float, float, float]]:
        """(row, item id, best score, question overlap, answer overlap) of every confirmed leak in a column of texts."""
        data, offsets = T.utf8(column)
        hashes, _, _, by_row = T.words(data, offsets, T.PUNCTUATION)
        best: dict[tuple[int, int], float] = {}
        for row, start in self._passages(hashes, by_row):
            a = by_row[row] + start
            for unit, score in self.wand(np.unique(hashes[a : min(a + PASSAGE, by_row[row + 1])])):
                key = (row, int(self.item[unit]))
                best[key] = max(best.get(key, 0.0), score)
        out = []
        for (row, item), score in sorted(best.items()):
            words = hashes[by_row[row] : by_row[row + 1]]
            shares = [None if runs is None or not len(runs) else T.common(runs, np.unique(T.shingles(words, np.array([0, len(words)]), width)[0])) / len(runs) for runs, width in zip(self.parts[item], self.widths[item], strict=True)]
            question = shares[0] if shares[0] is not None else 0.0
            answer = shares[1] if shares[1] is not None else question
            if question >= SAME_QUESTION and answer >= SAME_ANSWER:
                out.append((row, self.ids[item], score, question, answer))
        return out
