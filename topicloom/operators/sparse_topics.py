"""Gibbs steps whose cost follows the topics a document uses, not all topics.

A token's weights differ from the corpus's prior weights of its term only for the topics that its document
holds.  With the running sum of the prior weights over all topics at hand, made once per term and block, a step
sums over the document's own topics alone; a draw that falls between two of them is looked up in the running
sum.  Topics keep their order, so the labels are those of a step over all topics.
"""

from __future__ import annotations

import numpy as np

#: Fills the lists of topics; above every topic.
NONE = np.int64(1) << 40


class SparseBlock:
    """The topics of a block of documents, in order, and the prior weights of their (document, term) rows.

    ``phi`` is terms x topics, as the corpus was at the start; ``term_of`` gives a row's line in it.
    ``prior`` is the weight that a topic has in a document without it.
    """

    def __init__(self, doc_of: np.ndarray, z: np.ndarray, n_docs: int, row_doc: np.ndarray, term_of: np.ndarray, phi: np.ndarray, prior: np.ndarray):
        self.row_doc, self.term_of, self.width = row_doc, term_of, len(prior)
        self.first = np.searchsorted(row_doc, np.arange(n_docs + 1))
        self.weight = phi * prior
        self.running = np.cumsum(self.weight, axis=1)
        key, count = np.unique(doc_of * NONE + z, return_counts=True)
        doc, topic = np.divmod(key, NONE)
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        at = np.arange(len(key)) - first[doc]
        most = max(1, int(np.diff(first).max(initial=0))) + 2
        self.topics, self.counts = np.full((n_docs, most), NONE), np.zeros((n_docs, most))
        self.topics[doc, at], self.counts[doc, at] = topic, count
        self.total = self.running[term_of, -1]
        self.by_row = {"prior": self.spread(self.weight, 0.0), "before": self.spread(self.running, None)}
        self.by_doc = {"counts": self.counts}

    def spread(self, table: np.ndarray, beyond: float | None) -> np.ndarray:
        """Rows x places of a table terms x topics; past the topics ``beyond``, or else the row's total."""
        topics = self.topics[self.row_doc]
        cells = table[self.term_of[:, None], np.minimum(topics, self.width - 1)]
        return np.where(topics < self.width, cells, self.total[:, None] if beyond is None else beyond)

    def place_of(self, wanted: np.ndarray, n: int) -> np.ndarray:
        """Place of a topic among each document's."""
        return (self.topics[:n] < wanted[:, None]).sum(axis=1)

    def pick(self, n: int, rows: np.ndarray, gain: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Topics that draws fall on; ``NONE`` beyond all.  ``gain`` is what documents add to the prior weights of their topics."""
        risen = gain.cumsum(axis=1)
        upto = self.by_row["before"][rows] + risen
        place = (upto < point[:, None]).sum(axis=1)
        at = np.minimum(place, upto.shape[1] - 1)
        line = np.arange(n)
        own = self.by_row["prior"][rows, at] + gain[line, at]
        topic = np.where((place < upto.shape[1]) & (point > upto[line, at] - own), self.topics[line, at], NONE)
        for i in np.flatnonzero((topic == NONE) & (point <= self.total[rows] + risen[:, -1])):
            below = risen[i, place[i] - 1] if place[i] else 0.0
            topic[i] = min(int(np.searchsorted(self.running[self.term_of[rows[i]]], point[i] - below)), self.width - 1)
        return topic

    def take(self, doc: int, topic: int) -> int:
        """Place of a topic among a document's, made if it is new there; new places hold prior weights and 0."""
        place = int(np.searchsorted(self.topics[doc], topic))
        if place < self.topics.shape[1] and self.topics[doc, place] == topic:
            return place
        if self.topics[doc, -1] != NONE:
            grow = 8
            self.topics = np.hstack([self.topics, np.full((len(self.topics), grow), NONE)])
            for tables in (self.by_doc, self.by_row):
                for name, table in tables.items():
                    fill = np.repeat(self.total[:, None], grow, axis=1) if name == "before" else np.full((len(table), grow), float(name == "sizes"))
                    tables[name] = np.hstack([table, fill])
        rows = slice(self.first[doc], self.first[doc + 1])
        for table in (self.topics, *self.by_doc.values()):
            table[doc, place + 1 :] = table[doc, place:-1].copy()
        for table in self.by_row.values():
            table[rows, place + 1 :] = table[rows, place:-1].copy()
            table[rows, place] = 0.0
        for table in self.by_doc.values():
            table[doc, place] = 0.0
        self.topics[doc, place] = topic
        known = topic < self.width
        self.by_row["prior"][rows, place] = self.weight[self.term_of[rows], topic] if known else 0.0
        self.by_row["before"][rows, place] = self.running[self.term_of[rows], topic] if known else self.total[rows]
        return place


def rows_of(doc_of: np.ndarray, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) rows: each token's row, the rows' documents, their terms' lines, and the terms of the lines."""
    key, row_of = np.unique(doc_of * np.int64(n_terms) + terms, return_inverse=True)
    row_doc, row_term = np.divmod(key, n_terms)
    used, term_of = np.unique(row_term, return_inverse=True)
    return row_of, row_doc, term_of, used


def score_sparse(prior: np.ndarray, steps, draws, doc_of, terms, z, n_docs: int, phi_of, n_terms: int, sweeps: int) -> np.ndarray:
    """Labels after sweeps with fixed topics.

    ``steps()`` walks the tokens by position, ``draws(sweep)`` gives their uniforms, ``phi_of(terms)`` the shares of terms.
    """
    row_of, row_doc, term_of, used = rows_of(doc_of, terms, n_terms)
    phi = phi_of(used)
    block = SparseBlock(doc_of, z, n_docs, row_doc, term_of, phi, prior)
    block.by_row["phi"] = block.spread(phi, 0.0)
    z = z.copy()
    for sweep in range(sweeps):
        u = draws(sweep)
        for n, at in steps():
            rows, line = row_of[at], np.arange(n)
            block.by_doc["counts"][line, block.place_of(z[at], n)] -= 1.0
            gain = block.by_doc["counts"][:n] * block.by_row["phi"][rows]
            topic = block.pick(n, rows, gain, u[at] * (block.total[rows] + gain.sum(axis=1)))
            topic = np.where(topic == NONE, block.width - 1, topic)
            place = block.place_of(topic, n)
            inside = np.minimum(place, block.topics.shape[1] - 1)
            for i in np.flatnonzero(block.topics[line, inside] != topic):
                place[i] = block.take(int(i), int(topic[i]))
                span = slice(block.first[i], block.first[i + 1])
                block.by_row["phi"][span, place[i]] = phi[term_of[span], topic[i]]
            block.by_doc["counts"][line, place] += 1.0
            z[at] = topic
    return z


def sweep_sparse(setting, steps, u, u_new, doc_of, terms, z, n_docs: int, counts_of, n_terms: int):
    """One sweep of an HDP block: labels, documents x topics counts, and the sticks of the topics that documents opened."""
    s = setting
    tau, v_beta = np.asarray(s.tau, float), s.n_terms * s.beta
    sizes = np.asarray(s.totals, float) + v_beta
    row_of, row_doc, term_of, used = rows_of(doc_of, terms, n_terms)
    seen = counts_of(used) + s.beta
    block = SparseBlock(doc_of, z, n_docs, row_doc, term_of, seen / sizes, s.alpha * tau)
    block.by_row["seen"] = block.spread(seen, 0.0)
    inside = np.minimum(block.topics, block.width - 1)
    real = block.topics < block.width
    # Documents' weights of topics, and topics' sizes as each document leaves them.
    block.by_doc = {"counts": np.where(real, block.counts + s.alpha * tau[inside], 0.0), "sizes": np.where(real, sizes[inside], 1.0)}
    tau_new, sticks = np.full(n_docs, s.tau_new), {}
    z = z.copy()
    for n, at in steps():
        rows, line = row_of[at], np.arange(n)
        old = block.place_of(z[at], n)
        block.by_doc["counts"][line, old] -= 1.0
        block.by_doc["sizes"][line, old] -= 1.0
        block.by_row["seen"][rows, old] -= 1.0
        gain = block.by_doc["counts"][:n] * block.by_row["seen"][rows] / block.by_doc["sizes"][:n] - block.by_row["prior"][rows]
        new_mass = tau_new[:n] * (s.alpha / s.n_terms)
        topic = block.pick(n, rows, gain, u[at] * (block.total[rows] + gain.sum(axis=1) + new_mass))
        opened = {}
        for i in np.flatnonzero(topic == NONE):
            if s.gamma > 0:
                mine = sticks.setdefault(int(i), [])
                share = 1.0 - (1.0 - u_new[at][i]) ** (1.0 / s.gamma)
                mine.append(share * tau_new[i])
                tau_new[i] *= 1.0 - share
                topic[i] = block.width + len(mine) - 1
                opened[int(i)] = mine[-1]
            else:
                topic[i] = block.width - 1
        place = block.place_of(topic, n)
        for i in np.flatnonzero(block.topics[line, np.minimum(place, block.topics.shape[1] - 1)] != topic):
            k = int(topic[i])
            place[i] = block.take(int(i), k)
            span = slice(block.first[i], block.first[i + 1])
            fresh = k >= block.width
            block.by_doc["counts"][i, place[i]] = s.alpha * (opened[int(i)] if fresh else tau[k])
            block.by_doc["sizes"][i, place[i]] = v_beta if fresh else sizes[k]
            block.by_row["seen"][span, place[i]] = s.beta if fresh else seen[term_of[span], k]
        block.by_doc["counts"][line, place] += 1.0
        block.by_doc["sizes"][line, place] += 1.0
        block.by_row["seen"][rows, place] += 1.0
        z[at] = topic
    width = block.width + max((len(x) for x in sticks.values()), default=0)
    counts = np.bincount(doc_of * width + z, minlength=n_docs * width).reshape(-1, width)
    return z, counts, [sticks.get(i, []) for i in range(n_docs)]
