"""TF-IDF, similarity and encoder vectors for template texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import finite_array, l2_normalise
from weftlog.operators.skew import dealt, join_weighed, ordered
from weftlog.session import bucketed, durable

# The characters Python's `str.isspace` counts as white space.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


# A vocabulary of up to this many tokens is sent to every task (about 40 bytes a token).
SMALL_VOCABULARY = 1_000_000


# Characters of text whose words one task counts; up to four times as many in all, Spark chooses the parts itself.
CHARS_A_PART = 4_000_000
# Shares of such a part whose words are merged before they move.
SHARES_A_PART = 8


@dataclass(frozen=True)
class Terms:
    """Counted words: `counts` (id, __part, token, tf) is stored dealt by `__part`, a share of the ids, in `parts`
    parts (`many`: because there is much text); `idf` (token, df, idf) has one row a token."""

    counts: DataFrame
    idf: DataFrame
    tokens: int
    total: int
    parts: int
    many: bool


def count_terms(texts: DataFrame, id: str = "cluster_id", text: str = "text") -> Terms:
    """Cut every text once: its word counts, and the document frequency and idf of each token.

    Texts are dealt into parts by the amount of text. Document frequencies are merged within shares of a
    part, then move to parts by the number of counts, so no task holds more words in a larger table."""
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()
    many = chars > 4 * CHARS_A_PART
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_A_PART))
    share = F.pmod(F.xxhash64(id), F.lit(parts * SHARES_A_PART)).cast("int").alias("__part")
    plain = F.translate(F.lower(text), BLANKS, " " * len(BLANKS))
    # Texts are spread before they are cut: the shuffle moves compact rows, and counting per text
    # needs no further exchange.
    spread = texts.select(id, text, share)
    spread = spread.repartition(parts, "__part") if many else spread.repartition("__part")
    words = spread.select(id, "__part", F.explode(F.array_remove(F.split(plain, " "), "")).alias("token"))
    tf = bucketed(words.groupBy("__part", id, "token").agg(F.count(F.lit(1)).alias("tf")), "__part", buckets=parts)
    total = tf.count()
    merged = tf.groupBy("__part", "token").agg(F.count(F.lit(1)).alias("df")) if many else tf.select("token", F.lit(1).alias("df"))
    df = durable(dealt(merged, ["token"], total).groupBy("token").agg(F.sum("df").alias("df")))
    idf = df.select("token", "df", (F.log(F.lit(1.0 + n) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)).alias("idf"))
    return Terms(tf, idf, df.count(), total, parts, many)


def tfidf(texts: DataFrame, id: str = "cluster_id", text: str = "text", small: bool | None = None) -> DataFrame:
    """Sparse rows `(id, token, tf, idf, weight)`: raw counts, smoothed idf, unit length per text.

    idf = ln((1 + n) / (1 + df)) + 1, tokens are runs of non-blanks in lower case. A text is cut
    once (see `count_terms`), and both the document frequencies and the weights read its counts.
    The counted vocabulary is broadcast while it is small, so counts stay where
    they are and the norm of a text needs no exchange; a larger one is joined, common tokens apart."""
    terms = count_terms(texts, id, text)
    tf, idf = terms.counts, terms.idf
    small = terms.tokens <= SMALL_VOCABULARY if small is None else small
    if small:
        rows = tf.join(F.broadcast(idf.drop("df")), "token")
    else:
        rows = join_weighed(tf, idf, ["token"], "df", terms.total, deal=True)
        rows = rows.repartition(terms.parts, "__part") if terms.many else rows
    rows = rows.withColumn("__w", F.col("tf") * F.col("idf"))
    # A text is one input row, so a window over its tokens is bounded by that row.
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy("__part", id)))
    return rows.select(id, "token", "tf", "idf", (F.col("__w") / norm).alias("weight"))


def vocabulary(sparse: DataFrame | Terms) -> DataFrame:
    """Column numbers in the order of the sorted tokens, from the rows of `tfidf` or from counted terms."""
    if isinstance(sparse, Terms):
        terms = sparse.idf.select("token", "idf")
    else:
        terms = sparse.groupBy("token").agg(F.first("idf").alias("idf"))
    return ordered(terms, [], ["token"]).select("token", F.col("pos").alias("col"), "idf")


def tfidf_dense(sparse: DataFrame, vocab: DataFrame, size: int | None = None, id: str = "cluster_id") -> DataFrame:
    """One dense vector per text; meant for the vocabulary of a template catalog."""
    size = vocab.count() if size is None else size
    cells = sparse.join(vocab.select("token", "col"), "token")
    packed = cells.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("col", "weight"))).alias("m"))
    cols = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    return packed.select(id, F.transform(cols, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("embedding"))


# Templates of a catalog whose pair matrix may be listed, and queries searched in one pass over the rows.
MAX_CATALOG = 5_000
QUERY_BLOCK = 4_096
# Similarities that a task of `nearest` holds at once (8 bytes each, and about as much again to choose from them).
CELLS = 1 << 21


def cosine_similarity(vectors: DataFrame, id: str = "cluster_id", vec: str = "embedding", *,
                      block_rows: int = 1024, max_rows: int = MAX_CATALOG) -> DataFrame:
    """Similarity of every pair id_a < id_b of a template catalog, the upper triangle of the matrix.

    A catalog of more than `max_rows` templates is refused: the list of pairs grows with the
    square of the rows. Use `nearest` for large tables and `similarity_correlation` for
    statistics over all pairs. Rows fall into blocks, each pair of blocks is one group of at
    most about 2 * block_rows vectors, multiplied as matrices."""
    n = vectors.count()
    if n > max_rows:
        raise ValueError(f"{n} vectors are too many for a list of all pairs (at most {max_rows})")
    blocks = max(1, -(-n // block_rows))
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("o", other).select(
        "id", "v", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")
    )
    kind = vectors.schema[id].dataType.simpleString()

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key
        left, right = pdf[pdf["b"] == bi], pdf[pdf["b"] == bj]
        empty = pd.DataFrame({"id_a": pdf["id"][:0], "id_b": pdf["id"][:0], "similarity": np.zeros(0)})
        if left.empty or right.empty:
            return empty

        def unit(part):
            m = np.vstack(part["v"].to_numpy())
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        sim = unit(left) @ unit(right).T
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if bi == bj:
            i, j = np.nonzero(a[:, None] < b[None, :])
        else:
            i, j = np.divmod(np.arange(sim.size), len(b))
        x, y = a[i], b[j]
        flip = x > y
        return pd.DataFrame({"id_a": np.where(flip, y, x), "id_b": np.where(flip, x, y), "similarity": sim[i, j]})

    return rows.groupBy("bi", "bj").applyInPandas(multiply, f"id_a {kind}, id_b {kind}, similarity double")


def _units(column) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=float) for v in column])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """query, id, similarity, rank: the `k` rows of `vectors` most similar to each query, itself left out.

    Exact: queries go to the rows in blocks of a fixed size, every task keeps the best `k` of its
    rows for each query, and only those meet. Rows are compared in runs of at most CELLS similarities, so
    a task's memory is the same for any number of rows and queries. Similarities equal to 12 digits are
    ties, which take the smaller id, whatever run a row is in."""
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not part:
            continue
        ids, units = np.array([r["id"] for r in part]), _units([r["v"] for r in part])

        def best(batches: Iterator[pd.DataFrame], ids=ids, units=units) -> Iterator[pd.DataFrame]:
            step = max(1, CELLS // len(ids))
            q, own, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            floor = np.full(len(ids), -np.inf)  # of each query, the k-th best similarity so far
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at:at + step]
                    near, new = units @ _units(part["v"]).T, part["id"].to_numpy()
                    near[ids[:, None] == new[None, :]] = -np.inf
                    i, j = np.nonzero((near >= floor[:, None] - 1e-11) & (near > -np.inf))
                    q, own, sim = np.concatenate([q, i]), np.concatenate([own, new[j]]), np.concatenate([sim, near[i, j].round(12)])
                    order = np.lexsort((own, -sim, q))
                    q, own, sim = q[order], own[order], sim[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    full = rank == k - 1
                    floor[q[full]] = sim[full]
                    q, own, sim = q[rank < k], own[rank < k], sim[rank < k]
            yield pd.DataFrame({"query": ids[q], "id": own, "similarity": sim})

        some = rows.mapInPandas(best, "query bigint, id bigint, similarity double")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity_correlation(a: DataFrame, b: DataFrame, id: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """Pearson correlation of the similarities of two vector tables over all pairs of shared ids, and the pairs.

    No pair is formed. With unit vectors U and W the sums over pairs of s, s * s and s * t are half
    of |sum U|^2, |U'U|^2 and |U'W|^2, each less the diagonal, so every task sums small matrices."""
    left = a.select(id, F.col(vec).cast("array<double>").alias("u"))
    both = left.join(b.select(id, F.col(vec).cast("array<double>").alias("w")), id).select("u", "w")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if pdf.empty:
                continue
            u, w = _units(pdf["u"]), _units(pdf["w"])
            x, y = (u * u).sum(1), (w * w).sum(1)
            parts = [u.sum(0), w.sum(0), u.T @ u, w.T @ w, u.T @ w, np.array([len(u), x.sum(), y.sum(), x @ x, y @ y, x @ y])]
            total = parts if total is None else [p + q for p, q in zip(total, parts)]
        if total is not None:
            for kind, values in enumerate(total):
                flat = values.ravel()
                yield pd.DataFrame({"kind": np.full(len(flat), kind), "at": np.arange(len(flat)), "value": flat})

    cells = both.mapInPandas(sums, "kind int, at bigint, value double").groupBy("kind", "at").agg(F.sum("value").alias("value"))
    square = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("value"))), F.lit(0.0))
    own = lambda at: F.coalesce(F.sum(F.when((F.col("kind") == 5) & (F.col("at") == at), F.col("value"))), F.lit(0.0))
    s = cells.agg(
        own(0).alias("n"), ((square(0) - own(1)) / 2).alias("s"), ((square(1) - own(2)) / 2).alias("t"),
        ((square(2) - own(3)) / 2).alias("ss"), ((square(3) - own(4)) / 2).alias("tt"), ((square(4) - own(5)) / 2).alias("st"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    spread = F.sqrt((pairs * F.col("ss") - F.col("s") ** 2) * (pairs * F.col("tt") - F.col("t") ** 2))
    return s.select(F.try_divide(pairs * F.col("st") - F.col("s") * F.col("t"), spread).alias("correlation"), pairs.cast("bigint").alias("pairs"))


def clean_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Non-finite entries to 0, then unit length."""
    return df.withColumn(vec, l2_normalise(finite_array(F.col(vec).cast("array<double>"))))


def encode_texts(df: DataFrame, encode: Callable[[list[str]], np.ndarray], id: str = "cluster_id",
                 text: str = "text") -> DataFrame:
    """Vectors from a user encoder that maps a list of texts to a matrix, in Arrow batches."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                matrix = np.asarray(encode(pdf[text].tolist()), dtype=float)
                yield pd.DataFrame({id: pdf[id], "embedding": list(matrix)})

    return clean_vectors(df.select(id, text).mapInPandas(run, f"{id} {kind}, embedding array<double>"))


def hybrid_embeddings(lexical: DataFrame, semantic: DataFrame | None = None, dim: int = 0, id: str = "cluster_id") -> DataFrame:
    """TF-IDF followed by the semantic vector; TF-IDF alone when there is no semantic side."""
    if semantic is None:
        return lexical
    right = semantic.select(id, F.col("embedding").alias("__s"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return lexical.join(right, id, "left").select(
        id, F.concat("embedding", F.coalesce(F.col("__s").cast("array<double>"), zero)).alias("embedding")
    )
