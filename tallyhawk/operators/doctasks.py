"""Per-document arithmetic over sentences, many documents at a time.

Rows (doc_id, sent_id, toks) are dealt by document, in order of document and sentence. A task reads them as
Arrow batches, cuts them where a document ends and numbers sentences and terms of all documents of a piece together, so
that counts, weights (I15) and sums are a few array operations for thousands of documents. No term is
sent or sorted as a row of its own. The largest document of a piece must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sentences of a piece; a document is never cut.
PIECE = 20_000
#: Rows of one product of sentences of a document.
TILE = 1024


def dealt(sents: DataFrame, toks: Column, *others: str) -> DataFrame:
    """(doc_id, sent_id, toks, others, place): all rows of a document in one partition, in order.

    Sentences that are dealt by document stay so: the window then only sorts."""
    rows = sents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_id").cast("int").alias("sent_id"), toks.alias("toks"), *others)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")))


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 where null), which are null, and where a document begins."""
    ids = table["doc_id"].combine_chunks()
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return ids, null, new


def pieces(batches, size: int = PIECE):
    """Tables of whole documents from batches of rows that come document by document."""
    held, rows, due = [], 0, size
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < due:
            continue
        table = pa.concat_tables(held)
        last = int(np.flatnonzero(_runs(table)[2])[-1])
        if last:
            yield table.slice(0, last)
        held, rows = [table.slice(last)], table.num_rows - last
        due = max(size, 2 * rows)
    if rows:
        yield pa.concat_tables(held)


class Terms:
    """The (sentence, term) counts of a piece, in order of sentence, with weights as in I15.

    Documents, sentences and a document's terms are numbered from 0; ``g``, ``t`` and ``weight`` have one
    value for each count. Rows of one sentence id are one sentence; texts of different length there keep their own counts, and
    a document without an id has no terms."""

    def __init__(self, table: pa.Table):
        ids, null, new = _runs(table)
        sent = table["sent_id"].to_numpy()
        n = len(sent)
        doc = np.cumsum(new) - 1
        first = new.copy()
        first[1:] |= sent[1:] != sent[:-1]
        g = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.of = g                     # the sentence of each row
        self.sent, self.doc, self.docs = sent[at], doc[at], int(doc[-1]) + 1
        self.doc_id, self.doc_null = ids[new], null[new]
        toks = table["toks"].combine_chunks()
        size = pc.list_value_length(toks).fill_null(0).to_numpy().astype(np.int64)
        words = toks.flatten().dictionary_encode()
        width, term = len(words.dictionary), words.indices.to_numpy().astype(np.int64)
        place = np.empty(width, np.int64)      # sums of a sentence run over its words in order
        place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(width)
        term = place[term]
        if null.any():
            term = term[np.repeat(~null, size)]
            size = np.where(null, 0, size)
        bag, bag_at = np.arange(n), np.arange(n)
        if len(at) < n:
            _, bag_at, bag = np.unique(g * (int(size.max()) + 1) + size, return_index=True, return_inverse=True)
        count, tf = np.unique(np.repeat(bag, size) * width + term, return_counts=True)
        row = bag_at[count // width] if width else count
        term = count % width if width else count
        _, self.t, df = np.unique(doc[row] * width + term, return_inverse=True, return_counts=True)
        self.g = g[row]
        sentences = np.bincount(doc, minlength=self.docs)
        self.weight = tf / size[row] * (np.log((sentences[doc[row]] + 1) / (df[self.t] + 1)) + 1.0)
        self.terms = len(df)
        norm = np.sqrt(np.bincount(self.g, self.weight ** 2, len(at)))
        self.u = self.weight / norm[self.g]

    def ids(self, doc: np.ndarray) -> pa.Array:
        return pa.array(self.doc_id[doc], pa.int64(), mask=self.doc_null[doc])


def rank(batches, rounds: int, damping: float, tol: float, other: str | None = None):
    """I17 for every document of the batches: (doc_id, sent_id, score), or with a column ``other`` every row with its score."""
    for table in pieces(batches):
        p = Terms(table)
        g, t, u, doc = p.g, p.t, p.u, p.doc
        begin = np.searchsorted(doc, np.arange(p.docs))
        n = np.diff(np.append(begin, len(doc)))[doc].astype(float)
        mass = np.bincount(g, u * (np.bincount(t, u, p.terms)[t] - u), len(doc))
        score, on = 1.0 / n, np.ones(p.docs, bool)
        for _ in range(rounds):
            v = np.where(mass > 0, score / np.where(mass > 0, mass, 1.0), 0.0)
            sent = u * v[g]
            new = (1 - damping) / n + damping * np.bincount(g, u * (np.bincount(t, sent, p.terms)[t] - sent), len(doc))
            # a document keeps the scores from before its converging round (Q24)
            on &= ~(np.maximum.reduceat(np.abs(new - score), begin) < tol)
            if not on.any():
                break
            score = np.where(on[doc], new, score)
            still = on[doc[g]]
            if 2 * still.sum() < len(g):       # counts of documents at rest leave the rounds
                g, t, u = g[still], t[still], u[still]
        if other:
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("doc_id", "sent_id", other)), pa.array(score[p.of])],
                                             ["doc_id", "sent_id", other, "score"])
        else:
            yield pa.RecordBatch.from_arrays([p.ids(doc), pa.array(p.sent, pa.int32()), pa.array(score)], ["doc_id", "sent_id", "score"])


def _lists(members: np.ndarray, sizes: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(members, pa.int32()),
                                    mask=None if mask is None else pa.array(mask))


def _close(p: Terms, keep: np.ndarray, threshold: float):
    """(i, j, cosine), i < j, of the sentences ``keep`` of each document."""
    chosen = np.zeros(len(p.sent), bool)
    chosen[keep] = True
    some = chosen[p.g]
    g, t, u = p.g[some], p.t[some], p.u[some]
    shared = np.bincount(t, minlength=p.terms)[t] > 1      # a term of one sentence is in no product
    g, t, u = g[shared], t[shared], u[shared]
    if not len(g):
        return
    cut = np.append(np.flatnonzero(np.diff(p.doc[g], prepend=-1)), len(g))
    for s, e in zip(cut[:-1], cut[1:]):
        row, i = np.unique(g[s:e], return_inverse=True)
        if len(row) < 2:
            continue
        term, k = np.unique(t[s:e], return_inverse=True)
        a = np.zeros((len(row), len(term)))
        np.add.at(a, (i, k), u[s:e])
        for at in range(0, len(row), TILE):
            dot = a[at:at + TILE] @ a[at:].T
            x, y = np.nonzero(dot >= threshold - 1e-12)
            x, y = x[y > x], y[y > x]
            if len(x):
                yield row[at + x], row[at + y], dot[x, y]


def similar(batches, threshold: float):
    """I16 pairs as groups: (doc_id, a, b, cosine), every sentence of ``a`` with every one of ``b``; ``b`` null: those
    of ``a`` with each other. Sentences with equal terms are compared once."""
    for table in pieces(batches):
        p = Terms(table)
        order = np.lexsort((p.weight, p.t, p.g)) if len(p.g) else np.zeros(0, np.int64)
        bags = np.stack([p.t[order], p.weight[order].view(np.int64)], axis=1)
        cut = np.flatnonzero(np.diff(p.g, prepend=-1))
        which, cut = p.g[cut], np.append(cut, len(p.g))
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(bags[s:e].tobytes(), k) for s, e, k in zip(cut[:-1], cut[1:], range(len(which)))], dtype=np.int64)
        by = np.argsort(of, kind="stable")
        size = np.bincount(of, minlength=len(of))
        first, begin = np.flatnonzero(size), np.cumsum(size) - size   # members of class k: by[begin[k]:begin[k] + size[k]]
        member = p.sent[which[by]]

        def members(k):
            n = size[k]
            at = np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return member[at], n
        many = first[size[first] > 1]
        if len(many):
            a, n = members(many)
            yield _groups(p, p.doc[which[many]], _lists(a, n), _lists(np.zeros(0, int), n * 0, np.ones(len(n), bool)), np.ones(len(n)))
        place = np.zeros(len(p.sent), np.int64)
        place[which] = np.arange(len(which))
        for i, j, cosine in _close(p, which[first], threshold):
            yield _groups(p, p.doc[i], _lists(*members(place[i])), _lists(*members(place[j])), cosine)


def _groups(p: Terms, doc, a, b, cosine) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([p.ids(doc), a, b, pa.array(cosine)], ["doc_id", "a", "b", "cosine"])
