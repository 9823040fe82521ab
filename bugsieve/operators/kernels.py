"""NumPy helpers run inside tasks: block products, running top-k, block forests.

Vectors come in one of two layouts: ``array<float|double>`` (dense), or
``struct<indices: array<bigint>, values: array<double>>`` (sparse).  Scores are rounded to
``SCORE_DECIMALS`` before they are ranked: the order in which a block product adds its
terms must not decide between equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCORE_DECIMALS = 9
_CHUNK = 2048
_EXACT = 1 << 16  # pairs multiplied at once
_EPS = float(np.finfo(np.float32).eps)
#: Rows of sparse vectors that are unfolded at a time, over the columns of the first side only.
SPARSE_ROWS, SPARSE_OTHER_ROWS = 128, 512

Column = pa.Array | pa.ChunkedArray


def whole(column: Column) -> pa.Array:
    """The column as one array, without unused parts of a slice."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def numbers(column: Column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def keys(column: Column) -> np.ndarray:
    """Ids as an array NumPy can sort: integers, or text in code-point order."""
    out = numbers(column)
    return out if out.dtype.kind in "iu" else out.astype(str)


def is_sparse(vectors: Column) -> bool:
    return pa.types.is_struct(vectors.type)


def _entries(vectors: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column number and value of every entry of sparse rows."""
    indices, values = whole(vectors).flatten()
    row = np.repeat(np.arange(len(indices)), numbers(indices.value_lengths()))
    return row, numbers(indices.flatten()), numbers(values.flatten())


def used_columns(vectors: Column) -> np.ndarray | None:
    """Sorted column numbers that occur in sparse rows; None for dense rows."""
    return np.unique(_entries(vectors)[1]) if is_sparse(vectors) else None


def to_matrix(vectors: Column, columns: np.ndarray | None = None) -> np.ndarray:
    """Rows as one float64 matrix; sparse rows over the given columns only."""
    n = len(vectors)
    if not is_sparse(vectors):
        flat = numbers(whole(vectors).flatten()).astype(np.float64)
        return flat.reshape(n, -1) if n else flat.reshape(0, 0)
    row, col, val = _entries(vectors)
    out = np.zeros((n, max(len(columns), 1)))
    if len(columns):
        at = np.minimum(np.searchsorted(columns, col), len(columns) - 1)
        known = columns[at] == col
        out[row[known], at[known]] = val[known]
    return out


def paired_matrices(a: Column, b: Column) -> tuple[np.ndarray, np.ndarray]:
    """Two row sets over one common set of columns (for sparse rows: those in both)."""
    if not is_sparse(a):
        return to_matrix(a), to_matrix(b)
    if a is b:
        m = to_matrix(a, used_columns(a))
        return m, m
    columns = np.intersect1d(used_columns(a), used_columns(b))
    return to_matrix(a, columns), to_matrix(b, columns)


def _id_order(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys, least first, for ids in the order of their numbers: shorter text comes first."""
    return (ids,) if ids.dtype.kind in "iu" else (ids, np.char.str_len(ids))


class RunningTopK:
    """Best ``k`` corpus ids for each of a fixed set of queries, fed block by block.

    Ties go to the smaller id, whatever the order of the blocks.
    """

    def __init__(self, n_queries: int, k: int, min_score: float | None = None):
        self.k = k
        self.floor = np.full(n_queries, -np.inf if min_score is None else min_score)
        self.rows: np.ndarray = np.zeros(0, dtype=np.int64)
        self.scores: np.ndarray = np.zeros(0)
        self.ids: np.ndarray | None = None

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer scores of queries ``first ..`` (rows) against corpus ``ids`` (columns)."""
        n = scores.shape[0]
        floor = self.floor[first : first + n]
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            floor = np.maximum(floor, np.round(kth, SCORE_DECIMALS))
        row, col = np.nonzero(scores >= floor[:, None] - 10.0**-SCORE_DECIMALS)
        self.offer(row + first, np.round(scores[row, col], SCORE_DECIMALS), ids[col])

    def offer(self, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer single matches: query number, rounded score and corpus id of each."""
        reached = scores >= self.floor[row]
        row, scores, ids = row[reached], scores[reached], ids[reached]
        if not len(row):
            return
        # Only queries that are offered something are ranked again.
        touched = np.zeros(len(self.floor), bool)
        touched[row] = True
        again = touched[self.rows]
        held = ids[:0] if self.ids is None else self.ids
        row_all = np.concatenate([self.rows[again], row])
        score_all = np.concatenate([self.scores[again], scores])
        id_all = np.concatenate([held[again], ids])
        order = np.lexsort((*_id_order(id_all), -score_all, row_all))
        row_all, score_all, id_all = row_all[order], score_all[order], id_all[order]
        starts = np.searchsorted(row_all, row_all, side="left")
        keep = np.arange(len(row_all)) - starts < self.k
        row_all = np.concatenate([self.rows[~again], row_all[keep]])
        order = np.argsort(row_all, kind="stable")
        self.rows = row_all[order]
        self.scores = np.concatenate([self.scores[~again], score_all[keep]])[order]
        self.ids = np.concatenate([held[~again], id_all[keep]])[order]
        count = np.bincount(self.rows, minlength=len(self.floor))
        last = np.cumsum(count) - 1
        complete = count >= self.k
        self.floor[complete] = np.maximum(self.floor[complete], self.scores[last[complete]])

    def found(self, query_ids: np.ndarray) -> dict[str, np.ndarray]:
        ids = self.ids if self.ids is not None else query_ids[:0]
        return {"query_id": query_ids[self.rows], "defect_id": ids, "score": self.scores}


def block_top_k(
    q: pa.Table, c: pa.Table, k: int, min_score: float | None = None
) -> dict[str, np.ndarray]:
    """Best matches of a query block in a corpus block, by chunked matrix products."""
    q_ids, c_ids = keys(q["id"]), keys(c["id"])
    a, b = whole(q["vector"]), whole(c["vector"])
    parts = [{"query_id": q_ids[:0], "defect_id": c_ids[:0], "score": np.zeros(0)}]
    if is_sparse(a) and min_score is not None and min_score > LEAST_SCORE:
        best = RunningTopK(len(q_ids), k, min_score)
        for row, col, score in reaching_pairs(a, b, best.floor):
            best.offer(row, score, c_ids[col])
        return best.found(q_ids)
    if is_sparse(a):
        block = Postings(b)
        for at in range(0, len(a), Postings.QUERIES):
            best = RunningTopK(len(q_ids[at : at + Postings.QUERIES]), k, min_score)
            block.search(a.slice(at, Postings.QUERIES), best, c_ids)
            parts.append(best.found(q_ids[at : at + Postings.QUERIES]))
    else:
        for at in range(0, len(a), _CHUNK):
            x = to_matrix(a.slice(at, _CHUNK))
            best = RunningTopK(len(x), k, min_score)
            for other in range(0, len(b), _CHUNK):
                best.add(0, x @ to_matrix(b.slice(other, _CHUNK)).T, c_ids[other : other + _CHUNK])
            parts.append(best.found(q_ids[at : at + _CHUNK]))
    parts = [p for p in parts if len(p["score"])] or parts[:1]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


class Postings:
    """A block of sparse rows by term, to find the best of them for many queries.

    Terms in more than one of ``OFTEN`` rows make up most of the work and little of the scores.  The other
    terms are added up posting by posting; what the frequent ones can add to that is at most the product of
    the lengths of both rows over them.  Where that leaves a query more than a ``FEW``-th of the block, its frequent
    terms are multiplied as a matrix, in single precision, with room for what rounding may take away.
    Only pairs that could reach the query's floor are added up in double precision, so the scores found are exact
    and none is left out.
    """

    OFTEN = 12
    FEW = 64
    QUERIES = 256
    GATHERED = 1 << 22  # postings or entries looked up at once
    MATRIX_BYTES = 64 << 20  # of the frequent terms

    def __init__(self, vectors: Column):
        row, col, val = _entries(vectors)
        self.n = len(vectors)
        self.terms, at = np.unique(col, return_inverse=True)
        df = np.bincount(at, minlength=len(self.terms))
        order = np.argsort(at, kind="stable")
        self.rows, self.values = row[order], val[order]
        self.starts = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.often = df * self.OFTEN > self.n
        most = max(1, self.MATRIX_BYTES // (4 * max(self.n, 1)))
        if self.often.sum() > most:
            self.often[np.argsort(-df, kind="stable")[most:]] = False
        self.number = np.cumsum(self.often) - 1  # of a frequent term among them
        far = self.often[at]
        self.length = np.sqrt(np.bincount(row[far], val[far] ** 2, minlength=self.n))
        # Frequent entries again, by row.
        self.own_starts = np.concatenate([[0], np.cumsum(np.bincount(row[far], minlength=self.n))]).astype(np.int64)
        self.own_terms, self.own_values = self.number[at[far]], val[far]
        self.matrix = np.zeros((max(int(self.often.sum()), 1), self.n), np.float32)
        self.matrix[self.own_terms, row[far]] = self.own_values
        self.rounding = (len(self.matrix) + 4) * _EPS

    def _added(self, out: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Add the postings of some query entries to ``out`` (queries x rows of the block)."""
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(sizes)
        first = 0
        while first < len(term):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + self.GATHERED, side="right")))
            size = sizes[first:last]
            at = np.arange(size.sum()) + np.repeat(self.starts[term[first:last]] - (ends[first:last] - size - done), size)
            key = np.repeat(row[first:last] * self.n, size) + self.rows[at]
            products = np.repeat(weight[first:last], size) * self.values[at]
            out += np.bincount(key, products, minlength=out.size).reshape(out.shape)
            first = last

    def _exact(self, scores: np.ndarray, frequent: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whole scores of pairs: the sums so far and what the frequent terms add."""
        return self._added_to(scores[row, col], frequent, row, col)

    def _added_to(self, out: np.ndarray, frequent: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        sizes = self.own_starts[col + 1] - self.own_starts[col]
        ends = np.cumsum(sizes)
        first = 0
        while first < len(row):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + self.GATHERED, side="right")))
            size = sizes[first:last]
            at = np.arange(size.sum()) + np.repeat(self.own_starts[col[first:last]] - (ends[first:last] - size - done), size)
            pair = np.repeat(np.arange(last - first), size)
            products = frequent[row[first:last][pair], self.own_terms[at]] * self.own_values[at]
            out[first:last] += np.bincount(pair, products, minlength=last - first)
            first = last
        return np.round(out, SCORE_DECIMALS)

    def search(self, queries: pa.Array, best: RunningTopK, ids: np.ndarray) -> None:
        """Offer the block's rows, named ``ids``, to the queries of ``best``."""
        m = len(queries)
        if not (m and self.n):
            return
        row, col, val = _entries(queries)
        term = np.minimum(np.searchsorted(self.terms, col), max(len(self.terms) - 1, 0))
        known = self.terms[term] == col if len(self.terms) else np.zeros(len(col), bool)
        row, term, val = row[known], term[known], val[known]
        far = self.often[term]
        scores = np.zeros((m, self.n))
        self._added(scores, row[~far], term[~far], val[~far])
        frequent = np.zeros((m, len(self.matrix)))
        frequent[row[far], self.number[term[far]]] = val[far]
        length = np.sqrt((frequent**2).sum(1))
        floor, slack = best.floor.copy(), 2 * 10.0**-SCORE_DECIMALS
        unset = np.isneginf(floor)
        hit = np.zeros((m, self.n), bool)
        if not unset.all():
            hit[~unset] = scores[~unset] + length[~unset, None] * self.length >= floor[~unset, None] - slack
        many = np.flatnonzero(unset | (hit.sum(1) * self.FEW > self.n))
        if len(many):
            hit[many] = self._reaching(scores, frequent, length, floor, many, best.k)
        at, found = np.nonzero(hit)
        reached = self._exact(scores, frequent, at, found)
        kept = reached >= floor[at]
        best.offer(at[kept], reached[kept], ids[found[kept]])

    def _reaching(
        self, scores: np.ndarray, frequent: np.ndarray, length: np.ndarray, floor: np.ndarray, some: np.ndarray, k: int
    ) -> np.ndarray:
        """Where some of the queries may reach their floor, by all terms; sets floors that are not set yet."""
        near = frequent[some].astype(np.float32) @ self.matrix
        near += scores[some]
        # What sums in single precision may lack.
        lack = self.rounding * length[some].max() * self.length + 4 * _EPS * (1 + float(np.abs(near).max()))
        near += (lack + 2 * 10.0**-SCORE_DECIMALS).astype(np.float32)
        unset = np.flatnonzero(np.isneginf(floor[some]))
        if len(unset) and self.n > k:  # the rows that look best give the first floors
            likely = np.argpartition(-near[unset], k - 1, axis=1)[:, :k]
            reached = self._exact(scores, frequent, np.repeat(some[unset], k), likely.ravel())
            floor[some[unset]] = reached.reshape(likely.shape).min(1)
        return near >= np.nextafter(floor[some].astype(np.float32), np.float32(-np.inf))[:, None]


#: Scores from which on rows are indexed by their rarer terms only.
LEAST_SCORE = 1e-3
_ROOM = 2 * 10.0**-SCORE_DECIMALS


class RarePostings(Postings):
    """A block of sparse rows by the rarer terms of each, to find pairs that reach a score.

    Columns are numbered most frequent first.  The first terms of a row, as long as their length stays below the
    least score by the longest query's length, are not indexed: on their own they cannot reach it.  What is left out of
    the sum of the others is at most the product of both lengths up to the column from which on all is summed; these
    lengths are known at ``CUTS`` columns.  Pairs this leaves are added up in whole.

    The same holds for the first terms of a query.  Where few pairs share a term that neither side leaves out, those
    pairs are listed; otherwise all terms of the queries are summed.
    """

    CUTS = 32
    QUERY_CELLS = 1 << 22  # of queries that are unfolded at a time
    NEAR_POSTINGS, NEAR_SCORES = 1 << 16, 1 << 17  # handled at a time
    LISTED = 8  # pairs are listed if no more than one in so many shares such a term

    def __init__(self, vectors: Column, limit: float):
        row, col, val = _sorted_entries(vectors)
        self.n = n = len(vectors)
        sizes = np.bincount(row, minlength=n)
        far = _first_terms(row, val, sizes, limit)
        order = np.argsort(col)
        ordered = col[order]
        new = ordered[1:] != ordered[:-1]
        at = np.concatenate([np.zeros(min(len(col), 1), np.int64), np.cumsum(new)])
        self.columns = ordered[np.concatenate([np.ones(min(len(col), 1), bool), new])]
        number = np.empty(len(col), np.int64)
        number[order] = at
        near = ~far[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at[near], minlength=len(self.columns)))]).astype(np.int64)
        self.rows, self.values = row[order[near]], val[order[near]]
        self.row_terms = _row_starts(sizes), number, val
        few = np.bincount(row[far], minlength=n)
        self.row_far_terms = _row_starts(few), number[far], val[far]
        self.length = np.sqrt(np.bincount(row[far], val[far] ** 2, minlength=n))
        self.longest = float(np.sqrt(np.bincount(row, val * val, minlength=1).max())) if len(val) else 0.0
        self.positive = not len(val) or bool(val.min() >= 0)
        last = _last_terms(col, far, few)
        self.cuts = np.unique(np.quantile(last, np.linspace(0, 1, self.CUTS), method="higher")) if n else np.zeros(0, np.int64)
        self.cut = np.searchsorted(self.cuts, last)
        self.up_to = self._up_to(row, col, val, n)

    def _up_to(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """Lengths of rows up to each cut, and in whole."""
        width = len(self.cuts) + 1
        squares = np.bincount(row * width + np.searchsorted(self.cuts, col), val * val, n * width)
        return np.sqrt(np.cumsum(squares.reshape(n, width), axis=1))

    def pairs(
        self, queries: pa.Array, floor: np.ndarray, other_floor: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, row and rounded score of the pairs that reach the query's floor, or the row's if that is less.
        Floors are read again for every ``QUERIES`` queries, so a caller may raise them."""
        for at in range(0, len(queries) if len(self.columns) else 0, self.QUERIES):
            part = queries.slice(at, self.QUERIES)
            m, (row, col, val) = len(part), _sorted_entries(part)
            term = np.minimum(np.searchsorted(self.columns, col), len(self.columns) - 1)
            known = self.columns[term] == col
            asked = floor[at : at + m]
            least = asked if other_floor is None else np.minimum(asked, other_floor.min())
            sizes = np.bincount(row, minlength=m)
            first = _first_terms(row, val, sizes, (float(least.min()) - _ROOM) / self.longest if self.longest else 0.0)
            rare = known & ~first
            up_to = self._up_to(row, col, val, m)
            row, term, val, rare = row[known], term[known], val[known], rare[known]
            listed = (self.starts[term[rare] + 1] - self.starts[term[rare]]).sum() * self.LISTED <= m * self.n
            if listed:
                cut = np.searchsorted(self.cuts, _last_terms(col, first, np.bincount(_rows_of(sizes)[first], minlength=m)))
                some = [self._listed(f, *x, up_to, cut, least) for f, _, *x in self._met(row[rare], term[rare], val[rare], m)]
            else:
                positive = self.positive and (not len(val) or bool(val.min() >= 0))
                some = [self._summed(f, n, *x, up_to, least, positive) for f, n, *x in self._met(row, term, val, m)]
            hit, found, summed, most = (np.concatenate(x) for x in zip(*some))
            least = asked[hit] if other_floor is None else np.minimum(asked[hit], other_floor[found])
            likely = most >= least - _ROOM
            hit, found, summed, least = hit[likely], found[likely], summed[likely], least[likely]
            if listed:
                summed = np.zeros(len(hit))
            score = self._whole(summed, self.row_terms if listed else self.row_far_terms, m, row, term, val, hit, found)
            reached = score >= least
            yield hit[reached] + at, found[reached], score[reached]

    def _met(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int) -> Iterator[tuple]:
        """First query, number of queries, pairs (query by row) and products of the postings of query entries, a few
        queries at a time so that they stay in the cache."""
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.searchsorted(row, np.arange(m + 1))
        postings, first = ends[entries], 0
        while first < m:
            last = int(np.searchsorted(postings, postings[first] + self.NEAR_POSTINGS, side="right")) - 1
            last = min(max(last, first + 1), first + max(1, self.NEAR_SCORES // self.n), m)
            mine = slice(entries[first], entries[last])
            size = sizes[mine]
            at = np.arange(size.sum()) + np.repeat(self.starts[term[mine]] - (ends[:-1][mine] - postings[first]), size)
            key = np.repeat((row[mine] - first) * self.n, size)
            key += self.rows[at]
            products = np.repeat(weight[mine], size)
            products *= self.values[at]
            yield first, last - first, key, products
            first = last

    def _summed(
        self, first: int, queries: int, key: np.ndarray, products: np.ndarray, up_to: np.ndarray, least: np.ndarray, positive: bool
    ) -> tuple[np.ndarray, ...]:
        """Query, row, sum and largest possible score of the pairs that may reach ``least``, from all terms of the queries."""
        scores = np.bincount(key, products, minlength=queries * self.n)
        # Others share no indexed term, so cannot; with negative weights a sum of 0 tells nothing.
        at = np.flatnonzero(scores) if positive else np.arange(len(scores))
        hit, found = np.divmod(at, self.n)
        hit += first
        summed = scores[at]
        most = up_to[hit, self.cut[found]]
        most *= self.length[found]
        most += summed
        likely = np.flatnonzero(most >= least[hit] - _ROOM)
        return hit[likely], found[likely], summed[likely], most[likely]

    def _listed(
        self, first: int, key: np.ndarray, products: np.ndarray, up_to: np.ndarray, cut: np.ndarray, least: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The same from the terms that neither side leaves out."""
        order = np.argsort(key)
        ordered = key[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), ordered[1:] != ordered[:-1]]))
        summed = np.add.reduceat(products[order], new) if len(new) else np.zeros(0)
        hit, found = np.divmod(ordered[new], self.n)
        hit += first
        both = np.maximum(cut[hit], self.cut[found])
        most = summed + up_to[hit, both] * self.up_to[found, both]
        likely = np.flatnonzero(most >= least[hit] - _ROOM)
        return hit[likely], found[likely], summed[likely], most[likely]

    def _whole(
        self, summed: np.ndarray, lists: tuple[np.ndarray, ...], m: int, row: np.ndarray, term: np.ndarray, val: np.ndarray,
        hit: np.ndarray, found: np.ndarray,
    ) -> np.ndarray:
        """Rounded scores of pairs, in the order of the ``m`` queries: their sums and the terms in ``lists`` of the rows."""
        self.own_starts, self.own_terms, self.own_values = lists
        out = np.zeros(len(hit))
        step = max(1, min(self.QUERY_CELLS // len(self.columns), m))
        unfolded = np.zeros((step, len(self.columns)))
        asked, place = np.unique(hit), np.full(m, -1)
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            place[some] = np.arange(len(some))
            mine = slice(np.searchsorted(row, some[0]), np.searchsorted(row, some[-1], side="right"))
            wanted = place[row[mine]] >= 0
            cells = place[row[mine]][wanted], term[mine][wanted]
            unfolded[cells] = val[mine][wanted]
            pairs = slice(np.searchsorted(hit, some[0]), np.searchsorted(hit, some[-1], side="right"))
            out[pairs] = self._added_to(summed[pairs], unfolded, place[hit[pairs]], found[pairs])
            unfolded[cells] = 0
            place[some] = -1
        return out


def _row_starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _rows_of(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _first_terms(row: np.ndarray, val: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Which entries, by row and column, belong to the first of their row whose length is below ``limit``."""
    squares = np.concatenate([[0.0], np.cumsum(val * val)])
    error = 10.0**-SCORE_DECIMALS + 8 * float(np.finfo(float).eps) * squares[-1]
    return squares[1:] - squares[_row_starts(sizes)[row]] < max(limit, 0.0) ** 2 - error


def _last_terms(col: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest column among the first terms of each row, -1 where there are none."""
    out = np.full(len(counts), -1)
    some = counts > 0
    out[some] = col[first][_row_starts(counts)[1:][some] - 1]
    return out


def _sorted_entries(vectors: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_entries`, by row and column."""
    row, col, val = _entries(vectors)
    if ((col[1:] < col[:-1]) & (row[1:] == row[:-1])).any():
        order = np.lexsort((col, row))
        row, col, val = row[order], col[order], val[order]
    return row, col, val


def reaching_pairs(
    a: pa.Array, b: pa.Array, floor: np.ndarray, other_floor: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of ``a``, row of ``b`` and score of the sparse pairs that reach a floor above ``LEAST_SCORE``: see :meth:`RarePostings.pairs`."""
    if not (len(a) and len(b)):
        return
    row, _, val = _entries(a)
    longest = np.sqrt(np.bincount(row, val * val, minlength=1).max()) if len(row) else 0.0
    least = float(floor.min() if other_floor is None else min(floor.min(), other_floor.min()))
    if longest > 0:
        yield from RarePostings(b, (least - _ROOM) / longest).pairs(a, floor, other_floor)


def mutual_top_k(
    q: pa.Table, c: pa.Table, same: bool, k: int, min_score: float
) -> dict[str, np.ndarray]:
    """Best matches of either sparse block in the other, from pairs that meet once; ``same`` says that both are one block."""
    if same or min_score <= LEAST_SCORE:
        sides = [(q, c)] if same else [(q, c), (c, q)]
        parts = [block_top_k(a, b, k, min_score) for a, b in sides]
        return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    q_ids, c_ids = keys(q["id"]), keys(c["id"])
    asking, asked = RunningTopK(len(q_ids), k, min_score), RunningTopK(len(c_ids), k, min_score)
    for row, col, score in reaching_pairs(whole(q["vector"]), whole(c["vector"]), asking.floor, asked.floor):
        asking.offer(row, score, c_ids[col])
        asked.offer(col, score, q_ids[row])
    parts = asking.found(q_ids), asked.found(c_ids)
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


class DenseRows:
    """Dense rows in double and in single precision."""

    def __init__(self, vectors: Column):
        self.rows = to_matrix(vectors)
        with np.errstate(over="ignore"):
            self.near = self.rows.astype(np.float32)
            self.length = np.sqrt((self.rows**2).sum(1))
        self.plain = bool(np.isfinite(self.near).all() and np.isfinite(self.length).all())


def offer_products(q: DenseRows, c: DenseRows, best: RunningTopK, ids: np.ndarray) -> None:
    """Offer the rows of ``c``, named ``ids``, to the queries of ``best``, all of ``q``.

    Once every query has a floor, products are made in single precision, and in double precision only where
    those reach the floor with what rounding may take away.
    """
    if not (q.plain and c.plain and len(q.rows) and len(c.rows)) or np.isneginf(best.floor).any():
        best.add(0, q.rows @ c.rows.T, ids)
        return
    terms = q.rows.shape[1] + 4
    lack = _EPS * terms * float(q.length.max()) * float(c.length.max()) + 2 * 10.0**-SCORE_DECIMALS
    floor = best.floor - lack
    near = q.near @ c.near.T
    row, col = np.nonzero(near >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
    for at in range(0, len(row), _EXACT):
        r, k = row[at : at + _EXACT], col[at : at + _EXACT]
        best.offer(r, np.round(np.einsum("ij,ij->i", q.rows[r], c.rows[k]), SCORE_DECIMALS), ids[k])


def products(a: pa.Array, b: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Inner products of two row sets in pieces: first row, first column, scores.

    Sparse rows are unfolded a few at a time, over the columns that occur in them: what is
    in memory does not grow with the vocabulary.
    """
    rows, others = (SPARSE_ROWS, SPARSE_OTHER_ROWS) if is_sparse(a) else (_CHUNK, _CHUNK)
    for at in range(0, len(a), rows):
        part = a.slice(at, rows)
        columns = used_columns(part)
        x = to_matrix(part, columns)
        for other in range(0, len(b), others):
            yield at, other, x @ to_matrix(b.slice(other, others), columns).T


def levels_of(distance: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Index of the smallest radius in ``grid`` that covers each distance."""
    return np.searchsorted(grid, np.round(distance, SCORE_DECIMALS), side="left")


def near_pairs(a: Column, b: Column, grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and level of the pairs within the largest radius of ``grid``, piece by piece."""
    least = 1 - grid[-1] - 10.0**-SCORE_DECIMALS
    for at, other, scores in products(whole(a), whole(b)):
        row, col = np.nonzero(scores >= least)
        level = levels_of(1 - scores[row, col], grid)
        near = level < len(grid)
        yield row[near] + at, col[near] + other, level[near]


def spanning_edges(a: np.ndarray, b: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of nodes ``0 .. n - 1``.

    Level by level every component takes its first edge to another one, until none is left.
    """
    label, kept = np.arange(n), [np.zeros(0, np.int64)]
    for now in np.unique(level):
        edges = np.flatnonzero(level == now)
        while True:
            x, y = label[a[edges]], label[b[edges]]
            apart = x != y
            edges, x, y = edges[apart], x[apart], y[apart]
            if not len(edges):
                break
            first = np.full(n, len(a))
            np.minimum.at(first, x, edges)
            np.minimum.at(first, y, edges)
            taken = np.unique(first[first < len(a)])
            kept.append(taken)
            x, y = label[a[taken]], label[b[taken]]
            joined = np.arange(n)
            while True:  # the smaller label over every edge, then the label's own
                least = np.minimum(joined[x], joined[y])
                new = joined.copy()
                for side in (x, y, joined[x], joined[y]):
                    np.minimum.at(new, side, least)
                new = new[new]
                if np.array_equal(new, joined):
                    break
                joined = new
            label = joined[label]
    return np.concatenate(kept)


def contracted(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges as stars ``(group, node, smallest node of its component)``, all nodes but the smallest.

    Labels start as the nodes themselves, numbered in order; each pass takes the smaller label over
    every edge and then the label's own label, so paths halve, until nothing changes.
    """
    groups, at_group = np.unique(group, return_inverse=True)
    ids, at_id = np.unique(np.concatenate([u, v]), return_inverse=True)
    both = np.concatenate([at_group, at_group]) * len(ids) + at_id
    nodes, place = np.unique(both, return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return groups[nodes[moved] // len(ids)], ids[nodes[moved] % len(ids)], ids[nodes[label[moved]] % len(ids)]
