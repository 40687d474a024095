"""Similarity join on word shingles by T-occurrence search.

Two documents link when a share `percent` of the union of their shingles is common, that is when they share T shingles, T
following from both sizes.  Exact copies of a set are one node.  Documents without enough shared shingles are done first (see
`shingles`).  Of the rest, the rarest shingles up to the prefix length make inverted lists: linked documents meet in
one of them at least.  Searches then go from a pivot to the documents of its lists, each in a task that holds the pivot
and a bounded block of documents: lists of the pivot's shingles, short ones merged with a heap, long ones probed by
binary search only for documents that can still reach T (DivideSkip).

Rounds: first every document is searched from one pivot, the most central document it meets, and once more from another
member of its lists if it isn't in that one's component by then; large groups of near copies are joined by stars instead of
all pairs.  Then the documents that share a list with another component search the neighbourhoods that they meet there often enough,
a neighbourhood being the documents of one pivot.  Of each list only those outside its largest component search, so no
link between components is lost, and components are what the join returns.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.components import components
from framescope.llm.shingles import describe, shared_sets
from framescope.llm.storage import col, free_name, stored

BLOCK_SHINGLES = 60_000
BLANKS = " \t\n\x0b\f\r"
MU = 0.0085  # weight of a merge step against a probe when the lists are divided


def required_overlap(n: int, m: int, percent: int) -> int:
    """The least common count for which percent / 100 of the union is common."""
    return -(-percent * (n + m) // (100 + percent))


class InvertedLists:
    """Which sets hold an element.  `sets` has (full size, shared elements)."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sizes = np.array([n for n, _ in sets], np.int64)
        element = np.concatenate([s for _, s in sets])
        owner = np.repeat(np.arange(len(sets)), [len(s) for _, s in sets])
        order = np.lexsort((owner, element))
        self.element, self.owner = element[order], owner[order]

    def divide_skip(self, query: np.ndarray, query_size: int, percent: int) -> list[int]:
        """Numbers of the sets that reach the overlap their sizes require with the query."""
        query = np.unique(query)
        lo, hi = np.searchsorted(self.element, query, "left"), np.searchsorted(self.element, query, "right")
        lists = sorted((self.owner[a:z].tolist() for a, z in zip(lo.tolist(), hi.tolist(), strict=True) if z > a), key=len)
        need = [required_overlap(query_size, n, percent) for n in self.sizes.tolist()]
        least = min(need)
        if len(lists) < least:
            return []
        n_long = min(int(least / (MU * log2(max(len(lists[-1]), 2)) + 1)), least - 1)
        short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
        found, heap = [], [(x[0], i, 0) for i, x in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            doc, count = heap[0][0], 0
            while heap and heap[0][0] == doc:
                _, i, p = heap[0]
                count += 1
                if p + 1 < len(short[i]):
                    heapq.heapreplace(heap, (short[i][p + 1], i, p + 1))
                else:
                    heapq.heappop(heap)
            left = len(long)
            for x in reversed(long):
                if count >= need[doc] or count + left < need[doc]:
                    break
                left -= 1
                p = bisect_left(x, doc)
                count += p < len(x) and x[p] == doc
            if count >= need[doc]:
                found.append(doc)
        return found


def search(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a (query), b (member): links of every query with the members of its cell, one per other component in a block of members.

    `members` and `queries` have cell, node and g (its component), `sets` has node, n, shared.  A task gets a block of a cell's
    members and a block of its queries, each of about BLOCK_SHINGLES shingles, so a large cell is spread over many."""
    sizes = sets.select("node", "n")
    blocks = members.join(sizes, "node").groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    chunks = queries.join(sizes, "node").groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    cells = stored(blocks.join(chunks, "cell"), "near-cells")

    def dealt(side: DataFrame, own: str, other: str, kind: bool) -> DataFrame:
        d = side.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return d.join(sets, "node").select("cell", F.col("own" if kind else "other").alias("block"), F.col("other" if kind else "own").alias("chunk"), F.lit(kind).alias("member"), "node", "g", "n", "shared")

    def run(table):
        n, node, g, is_member = (table.column(c).to_pylist() for c in ("n", "node", "g", "member"))
        shared = [x.values.to_numpy() for x in table.column("shared")]
        inside = [i for i in range(len(n)) if is_member[i]]
        a, b = [], []
        if inside:
            lists = InvertedLists([(n[i], shared[i]) for i in inside])
            for q in (i for i in range(len(n)) if not is_member[i]):
                by_component = {g[inside[m]]: node[inside[m]] for m in lists.divide_skip(shared[q], n[q], percent) if g[inside[m]] != g[q]}
                a += [node[q]] * len(by_component)
                b += by_component.values()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = dealt(members, "blocks", "chunks", True).unionByName(dealt(queries, "chunks", "blocks", False))
    return rows.groupBy("cell", "block", "chunk").applyInArrow(run, "a long, b long")


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def similar(n: Column, m: Column, percent: int) -> Column:
    """Sizes that can reach the similarity at all."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def meetings_needed(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that two linked sets have within their prefixes: T less what lies beyond the shorter-reaching prefix."""
    t = F.ceil((n + m) * percent / (100 + percent))
    beyond = F.greatest(n - prefix_length(n, percent), m - prefix_length(m, percent))
    return F.greatest(t - beyond, F.lit(1))


def components_of_sets(sets: DataFrame, percent: int) -> DataFrame:
    """node, label: the components of all links.  `sets` has node, n, shared with one row per distinct set."""
    rows = sets.select("node", "n", F.explode("shared").alias("s"))
    df = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = (rows.join(df, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"), (F.sum("df") / F.col("n")).alias("central"))
              .filter(F.size("r") * 100 >= F.col("n") * percent))
    sets = stored(ranked.select("node", "n", "central", F.col("r.s").alias("shared")), "near-sets")
    reach = (prefix_length(F.col("n"), percent) - (F.col("n") - F.size("shared"))).cast("int")
    lists = stored(sets.select("node", "n", "central", F.explode(F.slice("shared", 1, reach)).alias("s")), "near-lists")
    sets = sets.drop("central")

    links, tried, group, home = None, None, None, None
    for order in (F.col("central"), F.xxhash64("node")):
        named = in_components(lists, group)
        heads = (named.groupBy("s").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.max(F.struct(order.alias("o"), "node", "n", "g")).alias("head"))
                 .filter("g0 != g1").select("s", F.col("head.node").alias("a"), F.col("head.n").alias("m"), F.col("head.g").alias("ga")))
        met = named.join(heads, "s").filter((F.col("g") != F.col("ga")) & similar(F.col("n"), F.col("m"), percent)).groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        pairs = stored(met.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select("best.a", "b"), "near-pairs")
        side = lambda c: pairs.select(F.col("a").alias("cell"), F.col(c).alias("node"), F.col(c).alias("g")).distinct()
        found = stored(search(side("b"), side("a"), sets, percent), "near-links")
        links = found if links is None else links.unionByName(found)
        home = pairs.select(F.col("b").alias("node"), F.col("a").alias("home")) if tried is None else home
        tried = pairs if tried is None else tried.unionByName(pairs)
        group = components(links)

    whole = in_components(sets.select("node", "n"), group).join(home, "node", "left").withColumn("home", F.coalesce("home", "node"))
    sizes = whole.groupBy("g").agg(F.count(F.lit(1)).alias("z"))
    whole = stored(whole.join(sizes, "g"), "near-components")
    open_lists = stored(lists.select("s", "node").join(whole, "node"), "near-open")
    tops = open_lists.groupBy("s").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.max(F.struct("z", "g")).alias("top")).filter("g0 != g1").select("s", F.col("top.g").alias("top"))
    ranges = whole.groupBy("home").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    present = open_lists.select("s", "home").distinct().join(ranges, "home").select("s", F.col("home").alias("cell"), "least", "most")
    low, high = F.greatest("least", F.ceil(F.col("n") * percent / 100)), F.least("most", F.floor(F.col("n") * 100 / percent))
    meets = (open_lists.join(tops, "s").filter("g != top").select("s", "node", "g", "n").join(present, "s").filter(low <= high)
             .groupBy("node", "g", "n", "cell", "least", "most").agg(F.count(F.lit(1)).alias("c"))
             # The need is least at one end of the sizes; one less covers its rounding.
             .filter(F.col("c") >= F.least(meetings_needed(F.col("n"), low, percent), meetings_needed(F.col("n"), high, percent)) - 1))
    queries = stored(meets.select("cell", "node", "g"), "near-queries")
    members = whole.select(F.col("home").alias("cell"), "node", "g").join(queries.select("cell").distinct(), "cell", "left_semi")
    rest = stored(search(members, queries, sets, percent), "near-links")
    return components(links.unionByName(rest))


def in_components(nodes: DataFrame, group: DataFrame | None) -> DataFrame:
    """With column g, the component; a node without links is one of its own."""
    if group is None:
        return nodes.withColumn("g", F.col("node"))
    return nodes.join(group, "node", "left").withColumn("g", F.coalesce("label", "node")).drop("label")


def near_groups(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach, the document's own included) for every row of `docs`.

    Words are lower-cased in A-Z and separated by ASCII white space; a shingle is five words, fewer words are one shingle.
    Null and empty texts have no shingles and link with nothing; equal sets are linked; a null key stays null and gives no
    name to a component unless all its keys are null.  An empty table gives no rows; other columns are ignored.  Very long texts are
    read whole.  Sets are told apart by two 64-bit hashes together; every distinct pair gets a number, which names the set from then on."""
    about = stored(describe(docs, key, text), "near-documents")
    total = about.agg(F.sum("n_shingles")).first()[0] or 0
    own = ["set_key", "set_check"]
    nodes = about.filter("n_shingles > 0").groupBy(*own).agg(F.min("doc").alias("doc"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    sets = stored(shared_sets(docs, total, percent, key, text), "near-shared").groupBy(*own).agg(F.max("n_shingles").alias("n"), F.first("shared").alias("shared"))
    group = components_of_sets(stored(sets.join(nodes, own).select("node", "n", "shared"), "near-distinct"), percent)
    grouped = nodes.join(group, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = grouped.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_set = stored(grouped.join(names, "label").select(*own, "component_id"), "near-names")
    out = about.filter("n_shingles > 0").join(by_set, own).select("doc", "n_shingles", "component_id")
    return out.unionByName(about.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component_id"))).withColumnRenamed("doc", key)


def one_per_group(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of `docs` without near copies: of each component the row with the smallest key stays, null keys
    coming last and equal keys in the order of a hash of the text; of rows with equal key and text one stays.  Rows without
    words link with nothing: all of them stay."""
    own = free_name(docs, "__near_row")
    wordless = F.length(F.btrim(F.coalesce(col(text), F.lit("")), F.lit(BLANKS))) == 0
    row = F.struct(col(key).isNull().alias("missing"), col(key).alias("key"), F.xxhash64(col(text)).alias("text"))
    named = docs.filter(~wordless).withColumn(own, row)
    group = near_groups(named, percent, own, text).filter(F.col(own).eqNullSafe(F.col("component_id"))).select(F.col(own).alias("__near_kept")).distinct()
    kept = named.join(stored(group, "near-kept"), F.col(own).eqNullSafe(F.col("__near_kept")), "left_semi")
    return kept.dropDuplicates([own]).drop(own).union(docs.filter(wordless))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::varchar[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
"""
