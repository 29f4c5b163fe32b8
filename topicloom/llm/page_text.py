"""Main text of web pages by a tree-structured graphical model.

Every element and every text of a page is a node with a state: boilerplate, content, or mixed
(elements that hold both).  A node's own evidence (its tag, its class names, how much text it has,
how much of it is linked, how it is punctuated) depends on its state, and its state on that of its
parent.  The potentials are learned from labelled pages.  Messages run up from the leaves and
down again; their product is each node's exact marginal, and a block of text is content if its texts'
marginals, weighed by length, reach one half.

The trees of many pages are worked on together, one depth at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import bound_batches, slices, text_udf
from topicloom.llm.page_examples import labelled_page
from topicloom.llm.page_tree import Tree, name_parts, read_page
from topicloom.session import hold

OTHER, MAIN, MIXED = range(3)
STATES = 3
#: Labelled pages that the potentials are learned from.
LABELLED = 800
#: Rounds of climbing, how strongly weights are pulled to zero, and the share of the counted evidence they start from.
ROUNDS = 30
PULL = 0.1
START = 0.3
#: Added to every count.
SMOOTH = 0.1
#: Names seen on fewer labelled nodes say nothing.
LEAST_SEEN = 3


@dataclass
class Forest:
    """Trees of several pages, one after the other: parents, which nodes are texts, and (node, name) of all evidence."""

    parent: np.ndarray
    is_text: np.ndarray
    nodes: np.ndarray
    evidence: list[str]
    levels: list[np.ndarray]
    size: np.ndarray | None = None


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth.  Parents come before children, so one pass in order finds the depths."""
    depth: list[int] = []
    for p in parent.tolist():
        depth.append(0 if p < 0 else depth[p] + 1)
    order = np.argsort(np.array(depth, np.int64), kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _first(trees: list[Tree]) -> np.ndarray:
    """Number of each tree's first node in the forest."""
    return np.cumsum([0, *(len(t.parent) for t in trees)])


def forest(trees: list[Tree]) -> Forest:
    first = _first(trees)
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + at) for t, at in zip(trees, first)])
    n = len(parent)
    tags = [tag for t in trees for tag in t.tag]
    texts = [text for t in trees for text in t.text]
    size, ends, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    is_text = np.array([tag == "#text" for tag in tags])
    in_link = np.zeros(n, bool)
    tag_is_link = np.array([tag == "a" for tag in tags])
    levels = _levels(parent)
    for level in levels[1:]:
        in_link[level] = tag_is_link[level] | in_link[parent[level]]
    for i in np.flatnonzero(is_text):
        text = texts[i].strip()
        size[i] = len(text)
        ends[i] = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?", "…", "。"))
    linked[is_text] = size[is_text] * in_link[is_text]
    for level in levels[:0:-1]:
        for total in (size, ends, linked):
            np.add.at(total, parent[level], total[level])
    length = np.ceil(np.log2(1 + size)).astype(int)
    share = np.where(size > 0, linked / np.maximum(size, 1), 0)
    share = np.digitize(share, [1e-9, 0.1, 0.35, 0.7, 0.999])
    dense = np.digitize(np.where(size > 0, 100 * ends / np.maximum(size, 1), 0), [1e-9, 0.5, 1.0, 2.0, 5.0])
    nodes: list[int] = []
    evidence: list[str] = []
    for i, (tag, l, s, d, names) in enumerate(zip(tags, length.tolist(), share.tolist(), dense.tolist(), (x for t in trees for x in t.names))):
        kind = "t" if is_text[i] else "e"
        found = [f"{kind}length={l}", f"{kind}linked={s}", f"{kind}ends={d}", f"tag={tag}"]
        if names:
            found += [f"name={part}" for part in sorted(name_parts(names))]
        nodes += [i] * len(found)
        evidence += found
    return Forest(parent, is_text, np.array(nodes, np.int64), evidence, levels, size)


@dataclass(frozen=True)
class Potentials:
    """Logarithms: of evidence by state, of a child's state by its parent's (rows), for elements and for texts; of the page's state."""

    evidence: dict[str, np.ndarray]
    edge: np.ndarray
    root: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(woods: Forest, model: Potentials) -> np.ndarray:
    """Each node's probabilities of the states, given all evidence of its page: messages up, then down."""
    unknown = np.zeros(STATES)
    local = np.zeros((len(woods.parent), STATES))
    np.add.at(local, woods.nodes, np.array([model.evidence.get(e, unknown) for e in woods.evidence]).reshape(-1, STATES))
    local[woods.levels[0]] += model.root
    edge = model.edge[woods.is_text.astype(int)]
    below = local.copy()
    up = np.zeros_like(local)
    for level in woods.levels[:0:-1]:
        up[level] = _log_sum(edge[level] + below[level][:, None, :], 2)
        np.add.at(below, woods.parent[level], up[level])
    belief = below.copy()
    for level in woods.levels[1:]:
        without = belief[woods.parent[level]] - up[level]
        belief[level] = below[level] + _log_sum(edge[level] + without[:, :, None], 1)
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def true_states(woods: Forest, trees: list[Tree]) -> np.ndarray:
    """States of labelled trees: a text takes the label of the nearest labelled element above (none: other), an element those of its texts."""
    labels = [x for t in trees for x in t.label]
    inside = np.array([{"main": MAIN}.get(x, OTHER) for x in labels])
    named = np.array([x != "" for x in labels])
    for level in woods.levels[1:]:
        inside[level] = np.where(named[level], inside[level], inside[woods.parent[level]])
    has = np.zeros((len(inside), 2), bool)
    spoken = woods.is_text & (woods.size > 0)
    has[spoken, inside[spoken]] = True
    for level in woods.levels[:0:-1]:
        np.logical_or.at(has, woods.parent[level], has[level])
    return np.where(has.all(axis=1), MIXED, np.where(has[:, MAIN], MAIN, np.where(has[:, OTHER], OTHER, inside)))


_TREES = "parent array<int>, is_text array<boolean>, nodes array<int>, evidence array<string>, states array<int>"


def _labelled_trees(labelled: DataFrame, html: str) -> DataFrame:
    """Forests of labelled pages, one row for a slice of pages."""
    bound_batches()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                trees = [read_page(p) for p in part.to_pylist()]
                woods = forest(trees)
                lists = [woods.parent, woods.is_text, woods.nodes, woods.evidence, true_states(woods, trees)]
                kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32()]
                columns = [pa.array([list(x)], pa.list_(kind)) for x, kind in zip(lists, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["parent", "is_text", "nodes", "evidence", "states"])

    return labelled.select(html).mapInArrow(plant, _TREES)


def _sums(planted: DataFrame, of) -> dict[str, np.ndarray]:
    """Sums over all nodes by name and state; ``of(woods, states)`` gives (name, three numbers)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parent = np.array(row["parent"], np.int64)
                woods = Forest(parent, np.array(row["is_text"]), np.array(row["nodes"], np.int64), row["evidence"], _levels(parent))
                found = of(woods, np.array(row["states"]))
                columns = [pa.array(found), *(pa.array([float(x[s]) for x in found.values()]) for s in range(STATES))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "s0", "s1", "s2"])

    rows = planted.mapInArrow(add_up, "name string, s0 double, s1 double, s2 double")
    total = rows.groupBy("name").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)))
    return {r["name"]: np.array([r["s0"], r["s1"], r["s2"]]) for r in total.collect()}


def _by_name(woods: Forest, shares: np.ndarray) -> dict[str, np.ndarray]:
    names, at = np.unique(np.array(woods.evidence, object).astype(str), return_inverse=True)
    total = np.zeros((len(names), STATES))
    np.add.at(total, at, shares[woods.nodes])
    return dict(zip(names.tolist(), total))


def _counts(woods: Forest, states: np.ndarray) -> dict[str, np.ndarray]:
    one = np.eye(STATES)[states]
    found = _by_name(woods, one)
    for is_text in (0, 1):
        for above in range(STATES):
            hit = (woods.parent >= 0) & (woods.is_text == is_text) & (states[woods.parent] == above)
            found[f">{is_text}{above}"] = one[hit].sum(axis=0)
    found[">page"] = one[woods.parent < 0].sum(axis=0)
    return found


def learn(labelled: DataFrame, html: str = "html", rounds: int = ROUNDS) -> Potentials:
    """Potentials from pages whose elements carry ``data-label`` (``main`` or ``other``; inherited, other by default).

    The edges are smoothed counts of true states.  The evidence starts from counts too and then climbs the
    labelled states' likelihood given the pages: its slope is the true counts minus those that the marginals
    expect, summed by Spark.  A step's size per weight grows while its slope keeps its sign and halves when it
    turns.  The driver gets one row per name of evidence.  Null and empty pages say nothing but of their root;
    no pages at all give flat potentials.
    """
    planted = hold(_labelled_trees(labelled, html))
    counts = _sums(planted, _counts)
    model = _start(counts)
    names = sorted(model.evidence)
    weight = np.array([model.evidence[n] for n in names]).reshape(-1, STATES)
    step, slope = np.full_like(weight, 0.1), np.zeros_like(weight)
    for _ in range(rounds if names else 0):
        now = Potentials(dict(zip(names, weight)), model.edge, model.root)

        def miss(woods: Forest, states: np.ndarray, now: Potentials = now) -> dict[str, np.ndarray]:
            return _by_name(woods, np.eye(STATES)[states] - marginals(woods, now))

        missed = _sums(planted, miss)
        new = np.array([missed[n] for n in names]) - PULL * weight
        turned = np.sign(new * slope)
        step = np.clip(step * np.where(turned > 0, 1.2, np.where(turned < 0, 0.5, 1.0)), 1e-4, 1.0)
        slope = np.where(turned < 0, 0, new)
        weight = weight + np.sign(slope) * step
    planted.unpersist()
    return Potentials(dict(zip(names, weight)), model.edge, model.root)


def _start(counts: dict[str, np.ndarray]) -> Potentials:
    kinds: dict[str, list[str]] = {}
    for name, n in counts.items():
        if name[0] != ">" and n.sum() >= LEAST_SEEN:
            kinds.setdefault(name.split("=")[0], []).append(name)
    evidence = {}
    for names in kinds.values():
        shares = np.array([counts[n] for n in names]) + SMOOTH
        # Evidence of a node and of its children says much the same, so each counts for less at first.
        evidence |= dict(zip(names, START * np.log(shares / shares.sum(axis=0))))
    edge = np.empty((2, STATES, STATES))
    for is_text in (0, 1):
        for above in range(STATES):
            seen = counts.get(f">{is_text}{above}", np.zeros(STATES)) + SMOOTH
            if is_text:
                seen[MIXED] = 1e-9
            edge[is_text, above] = np.log(seen / seen.sum())
    root = counts.get(">page", np.zeros(STATES)) + 1
    return Potentials(evidence, edge, np.log(root / root.sum()))


def labelled_pages(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """The labelled pages that the library brings, made by rule."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(labelled_page, batch.column(0).to_pylist()), pa.string())], ["html"])

    return spark.range(n).mapInArrow(make, "html string")


def main_texts(pages: list[str | None], model: Potentials) -> list[str]:
    """Main text of each page: its content blocks, joined by an empty line."""
    if not pages:
        return []
    trees = [read_page(p) for p in pages]
    woods = forest(trees)
    content = marginals(woods, model)[:, MAIN]
    out = []
    for tree, at in zip(trees, _first(trees).tolist()):
        blocks: dict[int, list[int]] = {}
        for i, block in enumerate(tree.block):
            if block >= 0:
                blocks.setdefault(block, []).append(i)
        kept = []
        for members in blocks.values():
            sizes = woods.size[[at + i for i in members]]
            if sizes.sum() > 0 and sizes @ (content[[at + i for i in members]] - 0.5) >= 0:
                kept.append(" ".join("".join(tree.text[i] for i in members).split()))
        out.append("\n\n".join(k for k in kept if k))
    return out


def extract(pages: DataFrame, model: Potentials, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each.

    Whole pages; a null or empty page, and one without content, gives an empty text.  White space inside
    a block becomes one space, blocks stand in page order with an empty line between them.  Row by row:
    repeated rows and null keys keep their rows, a column named like the result is replaced.  A block whose
    marginal is exactly one half is kept.
    """

    def kernel(column: pa.Array) -> pa.Array:
        return pa.array(main_texts(column.to_pylist(), model), pa.string())

    return pages.withColumn(out, text_udf(kernel, "string")(F.col(html)))
