"""The best hits of very many queries, added up in arrays.

Where a batch asks for so much that the postings it meets are far more than those
there are, rows for each of them would be written to disk only to be added up.
Here the postings are read once, in their buckets, and become a row of arrays for
each document.  A task takes the documents of several buckets, a chunk at a time:
a query adds its weights to an array with a place for each document of the chunk,
and only what is among its best hits so far is kept.  What a query costs beside
its postings thus follows the number of chunks and tasks, and not that of shards,
and so do the rows that come out.  Queries come in blocks whose weights are small
enough to be handed to every task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.joins import MAX_BROADCAST_BYTES, broadcast_if_small, written

# What tasks need of this module goes with their functions, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that a weight of a query takes in the block handed to a task, with its query's share.
WEIGHT_BYTES = 32
#: Postings of a chunk, and bytes of the rows it has for terms that many of its documents hold.
CHUNK_POSTINGS, DENSE_BYTES = 2_000_000, 64 << 20
#: Terms held by more than one of so many documents have a place for each document.
DENSE_SHARE = 16
#: Sums may differ by their order, and scores by their rounding, but by far less than this.
MARGIN = 1e-5
#: Best hits that a task keeps, beyond which it hands them on and begins anew.
KEPT_HITS = 1_000_000
#: Buckets that make a task worth its while, and tasks for each core at most.
BUCKETS_PER_TASK, TASKS_PER_CORE = 12, 3


def _by_document(key: str):
    """A function from the postings of a shard to a row for each document, with its terms and gains as bytes."""

    def run(postings):
        import numpy as np
        import pyarrow as pa

        coded = postings.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        coded = coded if isinstance(coded, pa.Array) else coded.combine_chunks()
        document = coded.indices.to_numpy(zero_copy_only=False)
        order, n = np.argsort(document, kind="stable"), len(coded.dictionary)
        ends = np.concatenate(([0], np.cumsum(np.bincount(document, minlength=n)))).astype(np.int32) * 8
        values = (postings.column(c).to_numpy()[order] for c in ("term_no", "gain"))
        terms, gains = (pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(v.tobytes())]) for v in values)
        shard = pa.array(np.full(n, postings.column("shard")[0].as_py(), np.int32))
        return pa.table({"shard": shard, key: coded.dictionary, "terms": terms, "gains": gains})

    return run


def _numbers(column, kind):
    """The bytes of a column as numbers, and how many of them each row has."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.binary())
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values, np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // 8


class _Chunk:
    """The postings of some documents, by term."""

    def __init__(self, batches: list, names):
        import numpy as np

        terms, gains, lengths = [], [], []
        for batch in batches:
            values, counts = _numbers(batch.column("terms"), np.int64)
            terms.append(values)
            lengths.append(counts)
            gains.append(_numbers(batch.column("gains"), np.float64)[0])
        lengths, terms = np.concatenate(lengths), np.concatenate(terms)
        self.n = len(lengths)
        at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
        known = names[at] == terms
        at = at[known]
        order = np.argsort(at, kind="stable")
        self.docs = np.repeat(np.arange(self.n), lengths)[known][order]
        self.gains = np.concatenate(gains)[known][order]
        self.count = np.bincount(at, minlength=len(names))
        self.end = np.cumsum(self.count)
        self.most = np.zeros(len(names))
        met = np.flatnonzero(self.count)
        self.most[met] = np.maximum.reduceat(self.gains, (self.end - self.count)[met]) if len(met) else 0
        # Terms that many documents hold have a place for each, so these are found at once.
        many = np.flatnonzero(self.count > self.n // DENSE_SHARE)
        many = many[np.argsort(-self.count[many], kind="stable")][: DENSE_BYTES // (8 * max(1, self.n))]
        self.row = np.full(len(names), -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), self.n))
        for row, t in zip(self.rows, many.tolist(), strict=True):
            own = slice(self.end[t] - self.count[t], self.end[t])
            row[self.docs[own]] = self.gains[own]
        self.held = np.packbits(self.rows > 0, axis=1)
        self.spare = np.empty(self.n)

    def ask(self, first, of_term, of_weight) -> None:
        """Order the terms of each query: few documents first, then many by the most that they add; count that up from the end."""
        import numpy as np

        query = np.repeat(np.arange(len(first) - 1), np.diff(first))
        here = self.count[of_term] > 0
        query, term, weight = query[here], of_term[here], of_weight[here]
        most, many = weight * self.most[term], self.row[term] >= 0
        order = np.lexsort((-most, many, query))
        self.term, self.weight = term[order], weight[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(query, minlength=len(first) - 1))))
        self.middle = self.first[:-1] + np.bincount(query[~many], minlength=len(first) - 1)
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)
        self.rest = rest[:-1] - np.repeat(rest[self.first[1:]], np.diff(self.first))

    def _few(self, terms, weights):
        """Sums of the documents over terms that few hold."""
        import numpy as np

        if not len(terms):
            return np.zeros(self.n)
        counts = self.count[terms]
        places = [slice(b - n, b) for b, n in zip(self.end[terms].tolist(), counts.tolist(), strict=True)]
        gains = np.concatenate([self.gains[p] for p in places])
        gains *= np.repeat(weights, counts)
        return np.bincount(np.concatenate([self.docs[p] for p in places]), gains, self.n)

    def _sums(self, terms, weights):
        """Sums of the documents over any terms."""
        many = self.row[terms] >= 0
        return self._add_many(self._few(terms[~many], weights[~many]), self.row[terms[many]], weights[many])

    def _add_many(self, sums, rows, weights):
        import numpy as np

        for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
            sums += np.multiply(self.rows[row], w, out=self.spare)
        return sums

    def whole(self, q: int, in_title, boost: float, wanted: int, least: float):
        """Hits of a query, their number, and the scores of the best, from the sums of all documents."""
        import numpy as np

        own = slice(self.first[q], self.first[q + 1])
        term, weight, titled = self.term[own], self.weight[own], in_title[self.term[own]]
        sums = np.maximum(self._sums(term[~titled], weight[~titled]), self._sums(term[titled], weight[titled]) * boost)
        hits = np.flatnonzero(sums > 0)
        return len(hits), *_best(hits, sums[hits], wanted, least)

    def best(self, q: int, wanted: int, least: float):
        """The same for a query that no title meets.

        The scores of documents are added up from the terms that few of them hold.
        Terms that many hold and that cannot bring a document up to the best ones
        together are only looked up for those that the others bring near.
        """
        import numpy as np

        low, middle, high = self.first[q], self.middle[q], self.first[q + 1]
        sums = self._few(self.term[low:middle], self.weight[low:middle])
        rows, weight = self.row[self.term[middle:high]], self.weight[middle:high]
        met = sums > 0
        held = np.packbits(met)
        if len(rows):
            held |= np.bitwise_or.reduce(self.held[rows], axis=0)
        total = int(np.bitwise_count(held).sum())
        bound = least
        if not bound and len(rows):
            hits = np.flatnonzero(met)
            if len(hits) >= wanted:
                top = hits[np.argpartition(sums[hits], len(hits) - wanted)[len(hits) - wanted :]]
                bound = (sums[top] + weight @ self.rows[np.ix_(rows, top)]).min()
        bound -= MARGIN
        rest = self.rest[middle:high]
        cut = int(np.searchsorted(-rest, -bound, side="right")) if len(rows) else 0
        sums = self._add_many(sums, rows[:cut], weight[:cut])
        near = bound - np.append(rest[cut:], 0)
        hits = np.flatnonzero(sums >= near[0] if near[0] > 0 else sums > 0)
        scores = sums[hits]
        for row, w, least_now in zip(rows[cut:].tolist(), weight[cut:].tolist(), near[1:].tolist(), strict=True):
            scores += w * self.rows[row][hits]
            kept = np.flatnonzero(scores >= least_now)
            hits, scores = hits[kept], scores[kept]
        return total, *_best(hits, scores, wanted, least)


def _best(hits, scores, wanted: int, least: float):
    """The hits that may be among the best, equal ones of the last place too, and their scores."""
    import numpy as np

    scores = np.floor(scores * 1e6 + 0.5) / 1e6
    if len(hits) > wanted:
        least = max(least, np.partition(scores, len(hits) - wanted)[len(hits) - wanted])
    kept = scores >= least
    return hits[kept], scores[kept]


class _Kept:
    """The best hits of each query so far, and the number of all."""

    def __init__(self, names, upto, key_type):
        import numpy as np
        import pyarrow as pa

        self.names, self.upto, self.key_type = names, upto, key_type
        self.total = np.zeros(len(upto), np.int64)
        self.query, self.score, self.place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.key = pa.array([], key_type)
        self.least = np.zeros(len(upto))

    def take(self, query, score, key) -> None:
        """Add hits and keep the best, equal scores in the order of the keys."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        key = pa.concat_arrays([self.key, key])
        coded = key.dictionary_encode(null_encoding="encode")
        by_key = pa.compute.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        rank = np.empty(len(by_key), np.int64)
        rank[by_key] = np.arange(len(by_key))
        order = np.lexsort((rank[coded.indices.to_numpy(zero_copy_only=False)], -score, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) + 1
        best = place <= self.upto[query]
        order = order[best]
        self.query, self.place, self.score, self.key = query[best], place[best], score[order], key.take(pa.array(order))
        full = self.place == self.upto[self.query]
        self.least[self.query[full]] = self.score[full]

    def rows(self, query: str, key: str, shard: int):
        import numpy as np
        import pyarrow as pa

        return pa.table({
            query: self.names.take(pa.array(self.query)),
            "shard": pa.array(np.full(len(self.query), shard, np.int32)),
            key: self.key,
            "score": pa.array(self.score),
            "place": pa.array(self.place.astype(np.int32)),
            "n": pa.array(self.total[self.query]),
        })


def _best_of_documents(weights, key: str, query: str, boost: float):
    """A function from rows of documents to the best hits of each query among them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names, upto, terms, in_title, first, of_term, of_weight = weights.value
        wanted, state, shard = np.maximum(upto, 1), None, 0

        def score(held: list) -> None:
            chunk = _Chunk(held, terms)
            chunk.ask(first, of_term, of_weight)
            asking, scores, hits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            titled = np.append(np.cumsum(in_title[chunk.term]), 0)
            titled = titled[chunk.first[1:] - 1] - np.where(chunk.first[:-1] > 0, titled[chunk.first[:-1] - 1], 0)
            for q in np.flatnonzero(np.diff(chunk.first)).tolist():
                if titled[q]:
                    total, found, score = chunk.whole(q, in_title, boost, wanted[q], state.least[q])
                else:
                    total, found, score = chunk.best(q, wanted[q], state.least[q])
                state.total[q] += total
                asking.append(np.full(len(found), q))
                scores.append(score)
                hits.append(found)
            keys = pa.concat_arrays([batch.column(key) for batch in held])
            state.take(np.concatenate(asking), np.concatenate(scores), keys.take(pa.array(np.concatenate(hits))))

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state, shard = _Kept(names, wanted, batch.column(key).type), batch.column("shard")[0].as_py()
            held.append(batch)
            size += batch.column("terms").nbytes // 8
            if size >= CHUNK_POSTINGS:
                score(held)
                held, size = [], 0
                if len(state.query) > KEPT_HITS:
                    yield from state.rows(query, key, shard).to_batches(100_000)
                    state = None
        if held:
            score(held)
        if state is not None:
            yield from state.rows(query, key, shard).to_batches(100_000)

    return run


def _block(rows: DataFrame, query: str):
    """The weights of a block of queries as arrays, handed to every task once; by query, then by term."""
    import numpy as np
    import pyarrow.compute as pc

    table = rows.toArrow()
    coded = table.column(query).combine_chunks().dictionary_encode()
    of_query = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    term, weight, upto, in_title = (table.column(c).to_numpy() for c in ("term_no", "weight", "upto", "in_title"))
    most = np.zeros(len(coded.dictionary), np.int64)
    np.maximum.at(most, of_query, upto)
    order = np.lexsort((term, of_query))
    terms, at = np.unique(term, return_inverse=True)
    titles = np.zeros(len(terms), bool)
    titles[at] = in_title.astype(bool)
    first = np.concatenate(([0], np.cumsum(np.bincount(of_query, minlength=len(most)))))
    # As plain types, so that tasks need no dictionary of the driver's.
    names = pc.cast(coded.dictionary, table.schema.field(query).type)
    return rows.sparkSession.sparkContext.broadcast((names, most, terms, titles, first, at[order].astype(np.int32), weight[order]))


def best_hits(
    wanted: DataFrame, limits: DataFrame, parts: list[DataFrame], buckets: int, key: str, query: str, k1: float, b: float, boost: float
) -> list[DataFrame]:
    """Best hits of each query among the documents of a task: query, shard, key, score, place and hits there.

    ``wanted`` has the written query terms with weights, ``limits`` how many hits
    (``upto``) each query wants of them, ``parts`` the postings of each segment,
    which lie in so many ``buckets``.
    ``shard`` is one of those that the task has read.
    """
    spark = wanted.sparkSession
    numbered = written(wanted.select("field", "term", "avgdl").distinct().withColumn("term_no", F.monotonically_increasing_id()))
    rows = wanted.filter(F.col(query).isNotNull()).join(broadcast_if_small(numbered.drop("avgdl")), ["field", "term"])
    rows = rows.withColumn("in_title", (F.col("field") == "title").cast("int"))
    rows = written(rows.join(broadcast_if_small(limits), query).select(query, "term_no", "weight", "upto", "in_title"))
    blocks = max(1, -(-rows.count() * WEIGHT_BYTES // MAX_BROADCAST_BYTES))
    few = broadcast_if_small(numbered)
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    kinds = dict(parts[0].dtypes) | dict(rows.dtypes)
    schema = f"`{query}` {kinds[query]}, shard int, `{key}` {kinds[key]}, score double, place int, n bigint"
    cores = spark.sparkContext.defaultParallelism
    tasks = min(TASKS_PER_CORE * cores, max(cores, buckets // BUCKETS_PER_TASK))
    documents = [
        part.join(few, ["field", "term"]).select("shard", key, "term_no", gain.cast("double").alias("gain"))
        .groupBy("shard").applyInArrow(_by_document(key), f"shard int, `{key}` {kinds[key]}, terms binary, gains binary")
        .coalesce(tasks)
        for part in parts
    ]
    out = []
    for i in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == i)
        best = _best_of_documents(_block(block, query), key, query, boost)
        out += [part.mapInArrow(best, schema) for part in documents]
    return out
