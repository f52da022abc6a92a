"""Embedding near-duplicates by NN-descent: a neighbour graph refined through joins of neighbours of neighbours.

Equal vectors are one node. The first lists come from random-hyperplane cells, dealt to bounded pieces. In each round
every node receives its neighbours, both ways, with their vectors; all pairs among them are compared and improve the
lists of both. Pairs at the threshold are kept: the best ones in the lists, and per piece one for each node that lists
would push out, so that dense groups stay connected. Where a list is saturated (all its entries reach the threshold) it
is enlarged to the node's whole component, which is compared block by block and only counted, not listed. A sample of
nodes, drawn until it holds enough links or has its bounded size, is compared with all vectors, so its cost is in proportion
to the table; while its recall is too low, more cells and rounds follow, and a search that never reaches it is an error.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths aren't compared; rows with equal vectors link with each other; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm.common import Once, Scratch, components, documents, materialise, mix, partitions

THRESHOLD, LIST, TABLES, CELL, ROUNDS = 0.9, 16, 6, 48, 2
#: Entries that a comparison offers to each of its nodes; vectors in a piece of a cell, and in a block.
OFFER, PIECE, BLOCK = 6, 128, 1024
#: Nodes of the audit's first draw (chosen by hash), the most of all draws together, the links that it holds at least if so
#: many nodes have them, the recall it asks for, and how often cells and rounds are added before the search fails.
AUDIT, DRAWN, AUDITED, RECALL, ATTEMPTS = 512, 8192, 400, 0.98, 64
#: Sums in single precision may be off by this; what could reach the threshold is decided in double precision.
SLACK = 1e-5

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float32()), ("tie", pa.bool_())])


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best distinct entries of each a."""
    order = np.lexsort((b, -sim, a))
    order = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])] if len(order) else order
    own = a[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(head, np.diff(np.concatenate([head, [len(own)]])))
    return order[rank < most]


def _compare(groups: list[tuple[np.ndarray, np.ndarray]], threshold: float, most: int) -> pa.Table:
    """All pairs within each group of (nodes, unit vectors): offers to each node, and one tie at the threshold."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for nodes, unit in groups:
        n = len(nodes)
        if n < 2:
            continue
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2)
        k = min(most, n - 1)
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(n), k)
        hit = sims >= threshold - SLACK
        hub = np.flatnonzero(hit.any(1))
        first = hit[hub].argmax(1)
        parts[0] += [nodes[rows], nodes[hub]]
        parts[1] += [nodes[top.ravel()], nodes[first]]
        parts[2] += [sims[rows, top.ravel()], sims[hub, first]]
        parts[3] += [np.zeros(len(rows), bool), np.ones(len(hub), bool)]
    if not parts[0]:
        return _EDGE.empty_table()
    a, b, sim, tie = map(np.concatenate, parts)
    ties, plain = np.flatnonzero(tie), np.flatnonzero(~tie)
    ties = ties[np.unique(np.stack([a[ties], b[ties]]), axis=1, return_index=True)[1]] if len(ties) else ties
    plain = plain[_best(a[plain], b[plain], sim[plain], LIST)]
    keep = np.concatenate([ties, plain])
    return pa.Table.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(sim[keep].astype(np.float32)), pa.array(tie[keep])], schema=_EDGE)


def _grouped(table: pa.Table, by: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, unit vectors) of each distinct value of the columns and each vector length."""
    vectors = table.column("unit").to_pylist()
    keys = [*(table.column(c).to_numpy() for c in by), np.array([len(v) for v in vectors])]
    nodes = table.column("node").to_numpy()
    order = np.lexsort((nodes, *keys[::-1]))
    cuts = np.flatnonzero(np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) + 1
    out = []
    for some in np.split(order, cuts):
        out.append((nodes[some], np.frombuffer(b"".join(vectors[i] for i in some.tolist()), dtype="<f4").reshape(len(some), -1)))
    return out


def _cells(scratch: Scratch, nodes: DataFrame, count: int, threshold: float, seed: int, tables: int) -> DataFrame:
    """Compared pairs of nodes on the same side of random hyperplanes; crowded cells are dealt to pieces at random."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / CELL))))

    @F.arrow_udf("array<bigint>")
    def sides(units: pa.Array) -> pa.Array:
        out = np.zeros((len(units), tables), dtype=np.int64)
        data = units.to_pylist()
        sizes = np.array([len(x) // 4 for x in data])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            unit = np.frombuffer(b"".join(data[i] for i in at.tolist()), dtype="<f4").reshape(len(at), size)
            planes = np.random.default_rng([seed, int(size)]).normal(size=(size, tables * max(bits, 1))).astype(np.float32)
            bit = (unit @ planes > 0).reshape(len(at), tables, -1)
            out[at] = (bit * (1 << np.arange(bit.shape[2]))).sum(2) if bits else 0
        return pa.array(out.tolist(), pa.list_(pa.int64()))

    placed = scratch(nodes.select("node", F.posexplode(sides("unit")).alias("t", "cell")))
    crowds = placed.groupBy("t", "cell").agg(F.count("*").alias("n"))
    # The piece of a node in a crowded cell; the rows of a hot cell are dealt on by the node, not the cell.
    dealt = placed.join(crowds, ["t", "cell"]).select(
        "node", "t", "cell", F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.ceil(F.col("n") / PIECE)).alias("piece"))
    bundles = max(1, -(-count * tables // 4000))
    rows = dealt.join(nodes.select("node", "unit"), "node").withColumn("bundle", F.pmod(F.xxhash64("t", "cell", "piece"), F.lit(bundles)))
    return rows.groupBy("bundle").applyInArrow(lambda table: _compare(_grouped(table, ["t", "cell", "piece"]), threshold, LIST), "a long, b long, sim float, tie boolean")


def _lists(offers: DataFrame, count: int) -> DataFrame:
    """The best entries of every node."""
    bundles = max(1, -(-count // 4000))

    def best(table: pa.Table) -> pa.Table:
        a, b, sim = (table.column(c).to_numpy() for c in ("a", "b", "sim"))
        return table.select(["a", "b", "sim"]).take(pa.array(_best(a, b, sim, LIST)))

    return offers.select("a", "b", "sim", F.pmod(F.xxhash64("a"), F.lit(bundles)).alias("bundle")).groupBy("bundle").applyInArrow(best, "a long, b long, sim float")


def _round(nodes: DataFrame, lists: DataFrame, count: int, threshold: float, seed: int) -> DataFrame:
    """Neighbours of neighbours: every node's list, and as many of those that list it, are compared with each other."""
    listed_by = lists.groupBy("b").agg(F.count("*").alias("n"))
    back = lists.join(listed_by, "b").filter(F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.col("n")) < 2 * LIST)
    around = lists.select(F.col("a").alias("v"), F.col("b").alias("node")).union(back.select(F.col("b").alias("v"), F.col("a").alias("node")))
    around = around.union(nodes.select(F.col("node").alias("v"), "node")).distinct()
    bundles = max(1, -(-count // 1000))
    rows = around.join(nodes.select("node", "unit"), "node").withColumn("bundle", F.pmod(F.xxhash64("v"), F.lit(bundles)))
    return rows.groupBy("bundle").applyInArrow(lambda table: _compare(_grouped(table, ["v"]), threshold, OFFER), "a long, b long, sim float, tie boolean")


def _exact(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the edges whose cosine reaches the threshold in double precision, both ways."""

    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8")
            out.append(float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))))
        return pa.array(out, pa.float64())

    measure = F.arrow_udf(cosine, "double")
    pairs = edges.filter(F.col("sim") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("raw").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("raw").alias("y")), "b")
    return pairs.filter(measure("x", "y") >= threshold).select("a", "b")


def _audit(scratch: Scratch, nodes: DataFrame, count: int, pairs: DataFrame, dense: DataFrame, threshold: float) -> float:
    """Share of the links of sampled nodes that are found; links within a component that is compared in full don't count.

    Nodes are drawn in the order of a hash until they have AUDITED links, or DRAWN nodes are drawn. Where so many have none,
    links are rare and none that the sample has is lost; the log says how many it had.
    """
    placed = nodes.select("node", "raw", F.xxhash64("node", F.lit(5)).alias("o")).join(dense.select("node", "root"), "node", "left")
    placed = scratch(placed)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct().withColumn("hit", F.lit(1))
    found, links, drawn, last, most = 0, 0, 0, None, AUDIT
    while drawn < min(count, DRAWN) and links < AUDITED:
        rest = placed if last is None else placed.filter((F.col("o") > last[0]) | ((F.col("o") == last[0]) & (F.col("node") > last[1])))
        sample = rest.orderBy("o", "node").limit(min(most, DRAWN - drawn)).collect()  # DRAWN vectors at most, all together
        true = _links_of(nodes.sparkSession, sample, placed, threshold)
        more = true.join(both, ["a", "b"], "left").agg(F.count("hit"), F.count("*")).first()
        found, links, drawn, last, most = found + more[0], links + more[1], drawn + len(sample), (sample[-1]["o"], sample[-1]["node"]), 2 * most
    logging.getLogger(__name__).info("%d of %d links found, of %d nodes that were drawn", found, links, drawn)
    return found / links if links else 1.0


def _links_of(spark: SparkSession, sample: list, placed: DataFrame, threshold: float) -> DataFrame:
    """All links (a, b) of the sampled nodes, by comparison with every vector, but for those within one root."""
    by_size: dict[int, tuple] = {}
    for size in {len(r["raw"]) for r in sample}:
        some = [r for r in sample if len(r["raw"]) == size]
        unit = np.stack([np.frombuffer(r["raw"], "<f8") for r in some])
        roots = [r["root"] for r in some]
        by_size[size] = (np.array([r["node"] for r in some]), unit / np.linalg.norm(unit, axis=1, keepdims=True), np.array([x is not None for x in roots]), np.array([x or 0 for x in roots], dtype=np.int64))
    asked = Once(spark, by_size)

    def search(batches):
        for batch in batches:
            names, raws, roots = (batch.column(k).to_pylist() for k in range(3))
            for size, (ids, unit, rooted, root) in asked.get().items():
                every = [i for i, r in enumerate(raws) if len(r) == size]
                for some in (every[i : i + BLOCK] for i in range(0, len(every), BLOCK)):
                    data = np.stack([np.frombuffer(raws[i], "<f8") for i in some])
                    data = (data / np.linalg.norm(data, axis=1, keepdims=True)).T
                    node = np.array([names[i] for i in some])
                    own, at = np.array([roots[i] is not None for i in some]), np.array([roots[i] or 0 for i in some], dtype=np.int64)
                    for k in range(0, len(ids), BLOCK):
                        part = slice(k, k + BLOCK)
                        hits = (unit[part] @ data >= threshold) & (ids[part, None] != node)
                        hits &= ~(rooted[part, None] & own & (root[part, None] == at))
                        i, j = np.nonzero(hits)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][i], pa.int64()), pa.array(node[j], pa.int64())], ["a", "b"])

    return placed.select("node", "raw", "root").mapInArrow(search, "a long, b long")


def _blocks(nodes: DataFrame, dense: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Links of every node of the given components, each compared in full, block by block."""
    placed = dense.join(sizes, "root").join(nodes.select("node", "raw", "n"), "node")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.select("root", "node", "raw", "n", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = placed.select("root", "node", "raw", "n", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    right = placed.select("root", "node", "raw", "n", F.col("own").alias("j"), every.alias("i"), F.lit(False).alias("asks"))

    def count(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype="<f8").reshape(len(node), -1)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        hits = (unit[asks] @ unit[~asks].T) >= threshold
        hits &= node[asks][:, None] != node[~asks][None, :]
        return pa.table({"node": pa.array(node[asks]), "links": pa.array((hits @ n[~asks].astype(np.int64)).astype(np.int64))})

    parts = left.unionByName(right).groupBy("root", "i", "j").applyInArrow(count, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: the id column, n_links (other rows within the threshold) and component_id (least id reachable)."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    # 128 bits tell vectors apart; a node's number is given where the nodes are written.
    same = [F.when(F.col("v").isNotNull(), F.xxhash64(*seed, "v")).alias(name) for name, seed in (("h", []), ("g", [F.lit("g")]))]
    rows = rows.select("id", "v", *same)

    def pack(batch: pa.Array) -> pa.Array:
        """Scaled by a power of two, which changes no cosine, so that squares neither overflow nor vanish."""
        out = []
        for x in batch.to_pylist():
            y = np.array(x, dtype="<f8")
            out.append(np.ldexp(y, -np.frexp(np.abs(y).max())[1]).astype("<f8").tobytes())
        return pa.array(out, pa.binary())

    def unit(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch.to_pylist():
            y = np.frombuffer(x, "<f8")
            out.append((y / np.sqrt(y @ y)).astype("<f4").tobytes())
        return pa.array(out, pa.binary())

    nodes = rows.filter("v is not null").groupBy("h", "g").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    scratch = Scratch()
    nodes = scratch(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("raw", F.arrow_udf(pack, "binary")("v")).withColumn("unit", F.arrow_udf(unit, "binary")("raw")).drop("v"))
    count = nodes.count()
    lists, ties, recall = None, None, 0.0
    for attempt in range(ATTEMPTS):
        fresh = scratch(_cells(scratch, nodes, count, threshold, attempt, TABLES))
        for k in range(ROUNDS + 1):
            offered = fresh.filter("not tie").select("a", "b", "sim")
            lists = scratch(_lists(offered if lists is None else offered.unionByName(lists), count))
            kept = fresh.filter("tie").select("a", "b", "sim")
            ties = kept if ties is None else ties.unionByName(kept)
            if k < ROUNDS:
                fresh = scratch(_round(nodes, lists, count, threshold, 100 * attempt + k))
        pairs = scratch(_exact(lists.unionByName(ties), nodes, threshold))
        roots = components(pairs)
        full = lists.filter(F.col("sim") >= threshold - SLACK).groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") >= LIST)
        crowded = roots.join(full.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
        dense = scratch(roots.join(crowded, "root", "left_semi"))
        recall = _audit(scratch, nodes, count, pairs, dense, threshold)
        logging.getLogger(__name__).info("recall %.4f after %d attempts", recall, attempt + 1)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"links reach a recall of {recall:.4f} instead of {RECALL} after {ATTEMPTS} attempts")
    sizes = scratch(dense.groupBy("root").agg(F.count("*").alias("size")))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct().join(dense.select(F.col("node").alias("a")), "a", "left_anti")
    sparse = both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "node")
    links = _blocks(nodes, dense, sizes, threshold).unionByName(sparse)
    placed = nodes.select("node", "h", "g", "n", "least").join(links, "node", "left").join(roots, "node", "left")
    placed = placed.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"), "least")
    placed = scratch(placed)
    named = placed.join(scratch(placed.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("h", "g", "n_links", "component_id")
    named = materialise(named)
    scratch.drop()
    out = rows.select("id", "h", "g").join(named, ["h", "g"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_vectors(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


QUERIES = {"op9_vectors": op9_vectors}
