"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to blocks of bounded size. Inside a block every term has an impact list, ordered from the highest impact
down. For an item, its lists are read side by side; each document that comes up is completed at once by direct accesses to
the other lists, and the places that it holds there count as seen. The best position of a list ends the run of places seen
without a gap, and may lie far below the place read last. No unseen document can score more than the sum of the impacts at the
best positions, so reading stops when that sum is strictly below the k-th score found: equal scores are never cut off. The
blocks' lists then merge by rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threatspark.llm import grid
from threatspark.llm.common import column, settle, small_batches

#: Postings in a block of documents, and terms in a block of items.
POSTINGS = 1 << 20
ITEM_TERMS = 1 << 16
#: Places that the first round reads of each list; later rounds read twice as many as the one before.
FIRST_READ = 64
#: If the items' different terms are at most so many, and so many bytes, other terms are left out while documents are read.
FEW_TERMS, FEW_BYTES = 200_000, 4 << 20

#: Bytes of terms as they are, A-Z as a-z, all other ASCII bytes as a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case."""
    return data.translate(_PLAIN).split()


def count_terms(texts: DataFrame, id_column: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, terms, tfs): terms of each text with repeats, and its different terms, joined by blanks, with their counts.

    With ``wanted`` only those terms are listed; ``n`` counts all. Null texts have no terms. ``row`` is the only key that is
    surely unique.
    """
    small_batches(texts.sparkSession)
    given = texts.select(F.monotonically_increasing_id().alias("row"), column(id_column).cast("long").alias("id"), F.coalesce(column("text"), F.lit("")).cast("binary").alias("data"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, tfs = [], [], []
            for data in batch.column(2):
                found = terms(data.as_py())
                seen = Counter(found)
                if wanted is not None:
                    seen = {t: seen[t] for t in seen.keys() & wanted}
                n.append(len(found))
                names.append(b" ".join(seen).decode())
                tfs.append(np.fromiter(seen.values(), "<i4", len(seen)).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "terms", "tfs"])

    return given.mapInArrow(counted, "row long, id long, n long, terms string, tfs binary")


def _listed(counted: DataFrame) -> DataFrame:
    return counted.where("terms <> ''").select("row", F.explode(F.split("terms", " ")).alias("term"))


def best_position(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """The k first documents by summed impact, smaller numbers first among equals: (documents, scores, places read).

    ``lists`` has for each term its documents and impacts, from the highest impact down, all above 0; documents are numbered
    from 0.
    """
    place = np.full((len(lists), n_docs), -1, np.int32)
    for i, (docs, _) in enumerate(lists):
        place[i, docs] = np.arange(len(docs), dtype=np.int32)
    seen = [np.zeros(len(docs) + 1, bool) for docs, _ in lists]
    best = [0] * len(lists)
    met = np.zeros(n_docs, bool)
    top, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step, read = 0, first_read, 0
    while True:
        taken = [docs[at : at + step] for docs, _ in lists]
        read += sum(map(len, taken))
        fresh = np.concatenate([t[~met[t]] for t in taken])
        if len(fresh):
            fresh = np.unique(fresh)
            met[fresh] = True
            score = np.zeros(len(fresh), np.int64)
            for i, (_, impact) in enumerate(lists):
                there = place[i, fresh]
                hit = there >= 0
                there = there[hit]
                score[hit] += impact[there]
                seen[i][there] = True
            top, top_scores = np.concatenate([top, fresh]), np.concatenate([top_scores, score])
            if len(top) > k:
                first = np.lexsort((top, -top_scores))[:k]
                top, top_scores = top[first], top_scores[first]
        at, step = at + step, 2 * step
        most = 0
        for i, (_, impact) in enumerate(lists):
            best[i] += int(np.argmin(seen[i][best[i] :]))  # the place after the last one is never seen
            if best[i] < len(impact):  # else every document of the list has been met
                most += int(impact[best[i] - 1])
        if not most or (len(top) == k and most < top_scores.min()):
            first = np.lexsort((top, -top_scores))
            return top[first], top_scores[first], read


def _search(n_docs: int, n_terms: int, k: int):
    """The k best documents of a block for each item of a block."""

    def of_blocks(items: pa.Table, docs: pa.Table) -> pa.Table:
        wanted: dict[str, int] = {}
        weights: list[int] = []
        asked = []
        for row in items.select(["item", "weights"]).to_pylist():
            for t in row["weights"]:
                if t["term"] not in wanted:
                    wanted[t["term"]] = len(weights)
                    weights.append(t["w"])
            asked.append((row["item"], [wanted[t["term"]] for t in row["weights"]]))
        ids = docs.column("id").combine_chunks()
        known = np.array(ids.is_valid())
        order = np.lexsort((docs.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ~known))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        ids = ids.take(pa.array(order))
        term_at, sizes = [], np.zeros(len(order), np.int64)
        for i, line in enumerate(docs.column("terms").to_pylist()):
            found = [wanted.get(t, -1) for t in line.split(" ")] if line else []
            sizes[i] = len(found)
            term_at.append(np.array(found, np.int32))
        term_at = np.concatenate(term_at)
        tf = np.frombuffer(b"".join(docs.column("tfs").to_pylist()), "<i4").astype(np.int64)
        length = docs.column("n").to_numpy()
        if 50 * int(length.max()) * n_docs < 1 << 63:
            m = 50 + 50 * length * n_docs // n_terms
        else:
            m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in length], np.int64)
        doc_at, m = np.repeat(number, sizes), np.repeat(m, sizes)
        used = term_at >= 0
        term_at, doc_at, tf, m = term_at[used], doc_at[used], tf[used], m[used]
        impact = np.array(weights, np.int64)[term_at] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        ranked = np.lexsort((doc_at, -impact, term_at))
        term_at, doc_at, impact = term_at[ranked], doc_at[ranked], impact[ranked]
        ends = np.searchsorted(term_at, np.arange(len(weights) + 1))
        out = {"item": [], "doc_id": [], "score": []}
        for item, wanted_terms in asked:
            lists = [(doc_at[ends[t] : ends[t + 1]], impact[ends[t] : ends[t + 1]]) for t in wanted_terms if ends[t] < ends[t + 1]]
            if lists:
                top, top_scores, _ = best_position(lists, len(order), k)
                out["item"].append(np.full(len(top), item, np.int64))
                out["doc_id"].append(ids.take(pa.array(top)))
                out["score"].append(top_scores)
        if not out["item"]:
            return grid._empty(_FOUND)
        return pa.table({"item": np.concatenate(out["item"]), "doc_id": pa.chunked_array(out["doc_id"], pa.int64()), "score": np.concatenate(out["score"])})

    return of_blocks


_FOUND = "item long, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, equal scores by doc_id.

    Two passes over the texts' counted terms, which are written once: document frequencies of the items' terms, and the blocks.
    A text without terms neither counts nor is found. Repeated documents are documents of their own; a null doc_id comes last
    among equals. Items that repeat in id and text are one; a null item_id stays; an item without terms, or whose terms no
    document has, gives no row. Extra columns are not read. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    asked = settle(count_terms(items.select("item_id", "text").distinct(), "item_id"))
    asked_terms = _listed(asked)
    vocabulary = settle(asked_terms.select("term").distinct())
    few, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if not few:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = frozenset(r[0].encode() for r in vocabulary.toLocalIterator()) if few <= FEW_TERMS and size <= FEW_BYTES else None
    counted = settle(count_terms(docs, "doc_id", wanted))
    n_docs, n_terms, postings = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.sum(F.octet_length("tfs"))).first()
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = _listed(counted).groupBy("term").count()
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("count") + 1).cast("double")
    weights = df.join(vocabulary, "term").select("term", F.floor(F.lit(1000.0) * F.log(ratio)).alias("w")).where("w > 0")
    weighted = asked_terms.join(weights, "term").groupBy("row").agg(F.collect_list(F.struct("term", "w")).alias("weights"))
    weighted = settle(weighted.join(asked.select("row", "id"), "row").select(F.col("row").alias("item"), "id", "weights"))
    total = weighted.agg(F.sum(F.size("weights"))).first()[0]
    held = counted.where("terms <> ''")
    found = grid.meet(weighted.select("item", "weights"), held, F.col("item"), F.col("row"), grid.blocks(total, ITEM_TERMS), grid.blocks(postings // 4, POSTINGS), _search(n_docs, n_terms, k), _FOUND)
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.where("score > 0").withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= k)
    return ranked.join(weighted.select("item", F.col("id").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")
