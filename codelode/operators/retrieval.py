"""Hybrid retrieval: exact cosine search, BM25 and sparse scoring, rank fusion, filters, merging and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import code_tokens, splade_weight
from codelode.operators.tables import kept, written

K1, B, DEFAULT_AVGDL = 1.2, 0.75, 50.0
#: Constant of reciprocal rank fusion (ranks from 1); most rows that one list may bring to it.
RRF_K, PREFETCH_MOST = 60, 1000
SPARSE_TERMS = 256
#: Most terms whose frequency every worker knows; documents that a worker counts at once.
COMMON_TERMS, COUNTED_DOCS = 100_000, 512
#: Queries and vectors whose products a worker holds at once.
BLOCK_SIDE = 1024


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def prefetch(limit: int, multiplier: int = 5) -> int:
    return min(clamp(limit, 1, 1000) * clamp(multiplier, 1, 10), PREFETCH_MOST)


# ---- dense


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of another dimension, or zero."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def top(df: DataFrame, limit: int, score: str = "score", *tie: str) -> DataFrame:
    """The best rows: score falling with NaN last, then the tie columns."""
    return df.orderBy(F.isnan(score), F.desc_nulls_last(score), *tie).limit(limit)


def dense_topk(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and score of the nearest vectors by cosine; one pass, no shuffle but for the top rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(key, cosine(F.col(vector), q).alias("score")).filter("score IS NOT NULL"), limit, "score", key)


def dense_topk_many(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, key, score, rank of the nearest vectors of each query, exactly.

    Queries go to the executors in blocks of at most `block` vectors.  Each task keeps its own best rows of
    each query, so what is shuffled is bounded by queries * limit rows for each task.  Vectors that are null, zero,
    hold a null or have another dimension than most queries are on neither side."""
    dimension = queries.groupBy(F.size(vector).alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    whole = (F.size(vector) == (dimension.n if dimension else 0)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    vectors, queries = vectors.filter(whole & F.col(key).isNotNull()), queries.filter(whole & F.col(key).isNotNull())
    n = queries.count()
    parts = -(-n // block) if n else 0
    out = None
    for p in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p).select(key, vector).collect()
        if rows:
            found = _block_topk(vectors, [r[0] for r in rows], np.array([r[1] for r in rows], float), limit, key, vector)
            out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _block_topk(vectors, ids, q, limit, key, vector) -> DataFrame:
    """Works in blocks of `side` queries by `side` vectors, so memory follows neither.  A product of matrices finds the candidates;
    their scores, which decide, are summed one by one, as a product's last digits depend on the place in the block."""
    norms, side = np.sqrt(np.cumsum(q * q, axis=1)[:, -1]), BLOCK_SIDE
    unit_q = q / np.maximum(norms[:, None], 1e-300)

    def merged(held, found):
        """The `limit` best (query, id, score) of both for each query; equal vectors have equal scores, ties go by id."""
        of, who, score = (np.concatenate(x) for x in zip(held, found, strict=True))
        order = np.lexsort((who, -score, of))
        of, who, score = of[order], who[order], score[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
        good = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)])) < limit
        return of[good], who[good], score[good]

    def scores(i, x, own):
        """Summed in the order of the dimensions, whatever else is in the block."""
        total, a, b = np.zeros(len(i)), norms[i], np.zeros(len(i))
        for d in range(q.shape[1]):
            total += q[i, d] * x[own, d]
            b += x[own, d] * x[own, d]
        return total / (a * np.sqrt(b))

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(q), side)]
        for batch in batches:
            for at in range(0, len(batch), side):
                part = batch.slice(at, side)
                own, x = np.asarray(part.column(0)).astype(np.int64), np.asarray(part.column(1).flatten(), float).reshape(len(part), -1)
                unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for n, low in enumerate(range(0, len(q), side)):
                    near = unit_q[low : low + side] @ unit.T
                    of, _, score = held[n]
                    worst = np.full(len(near), -np.inf)
                    full = np.flatnonzero(np.bincount(of - low, minlength=len(near)) >= limit) if len(of) else []
                    if len(full):
                        worst[full] = score[np.flatnonzero(np.r_[of[1:] != of[:-1], True] & (np.bincount(of - low, minlength=len(near))[of - low] >= limit))]
                    elif len(part) > limit:
                        worst = np.partition(near, len(part) - limit, axis=1)[:, len(part) - limit]
                    i, j = np.nonzero(near >= worst[:, None] - 1e-9)
                    if len(i):
                        held[n] = merged(held[n], (i + low, own[j], scores(i + low, x, j)))
        for of, who, score in held:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[of]), pa.array(who), pa.array(score)], names=["query_id", key, "score"])

    return vectors.select(key, vector).mapInArrow(run, f"query_id long, {key} long, score double")


# ---- sparse


def term_counts(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key, further columns, length, term, tf."""
    tokens = docs.select(key, *more, code_tokens(F.col(text)).alias("tokens"))
    return tokens.select(key, *more, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(key, *more, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, group: str, text: str) -> DataFrame:
    """group, total_tokens, n_entities, avgdl."""
    lengths = docs.select(group, F.size(code_tokens(F.col(text))).alias("length"))
    stats = lengths.groupBy(group).agg(F.sum("length").alias("total_tokens"), F.count(F.lit(1)).alias("n_entities"))
    return stats.withColumn("avgdl", F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("n_entities")), F.lit(DEFAULT_AVGDL)))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def idf_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, idf over the whole corpus."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    terms = docs.select(key, F.explode(F.array_distinct(code_tokens(F.col(text)))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def bm25_weight(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def bm25_topk(docs: DataFrame, query: str, limit: int, key: str = "doc_id", text: str = "text", group: str = "source") -> DataFrame:
    """key and score: IDF over the corpus, length normalised by the average of the document's group.

    Only the query's terms leave the text: counts per document are computed in place, once, so nothing of the vocabulary is
    shuffled and no text is tokenised twice; the small table of counts is kept between the two passes over it."""
    spark = docs.sparkSession
    words = spark.range(1).select(code_tokens(F.lit(query)).alias("t")).first().t
    terms = sorted(set(words))
    if not terms:
        return spark.createDataFrame([], f"{key} long, score double")
    rows = docs.select(key, group, code_tokens(F.col(text)).alias("tokens"))
    occurs = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    tf = [occurs(t) for t in terms]
    rows = kept(rows.select(key, group, F.size("tokens").alias("length"), F.array(*tf).alias("tf")))
    seen_in = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]
    groups = rows.groupBy(group).agg(F.avg("length").alias("avgdl"), F.count(F.lit(1)).alias("n"), *seen_in)
    seen = groups.agg(F.sum("n").alias("n"), *[F.sum(f"df_{i}").alias(f"df_{i}") for i in range(len(terms))]).first()
    lengths, n, weights = groups.select(group, "avgdl"), seen["n"] or 0, []
    for i, t in enumerate(terms):
        df = seen[f"df_{i}"] or 0
        own = float(np.log((n - df + 0.5) / (df + 0.5) + 1)) * words.count(t)
        weights.append(F.lit(own) * bm25_weight(F.col("tf")[i], F.col("length"), F.col("avgdl")))
    scored = rows.join(lengths, rows[group].eqNullSafe(lengths[group])).select(key, sum(weights[1:], weights[0]).alias("score"))
    return top(scored.filter("score > 0"), limit, "score", key)


def top_terms(docs: DataFrame, key: str, text: str, k: int = SPARSE_TERMS) -> DataFrame:
    """The k heaviest terms of each document by tf * idf: key, term, weight, rank.

    Texts are tokenised once and counted in place.  The commonest terms' frequencies go to every worker, so it can bound the
    weight of each term of a document from both sides; only what may be among the k heaviest is shuffled and ranked exactly."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 6)), "term"))
    keys = docs.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("keys"), F.count_distinct(key).alias("unique")).first()
    if keys["unique"] < keys["keys"] or keys["n"] > keys["keys"] + 1:  # parts of a document in several rows
        weighted = term_counts(docs, key, text).join(idf_table(docs, key, text), "term")
    else:
        weighted = _heavy_terms(docs, key, text, k, keys["n"])
    weighted = weighted.withColumn("weight", F.col("tf") * F.col("idf"))
    return weighted.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "term", "weight", "rank")


def _heavy_terms(docs: DataFrame, key: str, text: str, k: int, n: int) -> DataFrame:
    """key, term, tf, idf of the terms that may be among the k heaviest of their document."""
    kind = docs.schema[key].dataType.simpleString()
    counted = written(docs.select(key, code_tokens(F.col(text)).alias("tokens")).mapInArrow(_count_tokens, f"{key} {kind}, terms array<string>, tf array<long>"))
    counts = written(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    least, common = 1, 0
    for row in counts.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():
        common += row["count"]
        least = row.df
        if common > COMMON_TERMS:
            least += 1
            break
    known = counts.filter(F.col("df") >= least).toArrow()
    names, df = known.column("term").combine_chunks(), known.column("df").to_numpy()
    bound = lambda x: np.log((n - x + 0.5) / (x + 0.5) + 1)
    low, high = np.append(bound(df), bound(max(least - 1, 1))), np.append(bound(df), bound(1))

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, len(batch), COUNTED_DOCS):
                part = batch.slice(at, COUNTED_DOCS)
                terms, tf = part.column(1).flatten(), part.column(2).flatten()
                of = np.repeat(np.arange(len(part)), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(int))
                place = pc.fill_null(pc.index_in(terms, names), len(names)).to_numpy()
                times = tf.to_numpy()
                least_weight, most_weight = times * low[place], times * high[place]
                order = np.lexsort((-least_weight, of))
                start = np.r_[0, np.cumsum(np.bincount(of, minlength=len(part)))]
                needed = np.full(len(part), -np.inf)
                full = np.flatnonzero(np.diff(start) >= k)
                needed[full] = least_weight[order][start[full] + k - 1]
                # weights are compared when rounded to six places: what is further below than that cannot come before
                may = np.flatnonzero(most_weight >= needed[of] - 2e-6)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[may])), terms.take(pa.array(may)), tf.take(pa.array(may))], names=[key, "term", "tf"])

    heavy = counted.mapInArrow(run, f"{key} {kind}, term string, tf long")
    return heavy.join(counts, "term").select(key, "term", "tf", idf(F.lit(n), F.col("df")).alias("idf"))


def _count_tokens(batches):
    """Each document's terms, each once, with their number."""
    from collections import Counter

    for batch in batches:
        for at in range(0, len(batch), COUNTED_DOCS):
            part = batch.slice(at, COUNTED_DOCS)
            found = [Counter(tokens or ()) for tokens in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=[part.schema.names[0], "terms", "tf"])


def bm25_by_group(docs: DataFrame, query: str, limit: int, key: str, text: str, group: str) -> DataFrame:
    """group, key, score, rank: the best rows of every group, each scored by its own counts, in one pass over all groups."""
    spark = docs.sparkSession
    words = spark.range(1).select(code_tokens(F.lit(query)).alias("t")).first().t
    terms = sorted(set(words))
    rows = docs.select(group, key, code_tokens(F.col(text)).alias("tokens"))
    occurs = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    tf = [occurs(t) for t in terms] or [F.lit(0)]
    rows = kept(rows.select(group, key, F.size("tokens").alias("length"), F.array(*tf).alias("tf")))
    seen = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.avg("length").alias("avgdl"), F.count(F.lit(1)).alias("n"), *seen)
    weights = [float(words.count(t)) * idf(F.col("n"), F.col(f"df_{i}")) * bm25_weight(F.col("tf")[i], F.col("length"), F.col("avgdl")) for i, t in enumerate(terms)]
    scored = rows.join(counts, F.col(group).eqNullSafe(F.col("__group"))).select(group, key, (sum(weights[1:], weights[0]) if weights else F.lit(0.0)).alias("score"))
    return best_by_group(scored.filter("score > 0"), limit, key, group)


def dense_by_group(vectors: DataFrame, query: list[float], limit: int, key: str, vector: str, group: str) -> DataFrame:
    """group, key, score, rank: the nearest vectors of every group."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return best_by_group(vectors.select(group, key, cosine(F.col(vector), q).alias("score")).filter("score IS NOT NULL"), limit, key, group)


def best_by_group(scored: DataFrame, limit: int, key: str, group: str) -> DataFrame:
    """The rows of rank 1 to limit of every group; Spark keeps only so many of each group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.isnan("score"), F.desc_nulls_last("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def fuse_by_group(lists: list[DataFrame], limit: int, key: str, group: str, k: int = RRF_K) -> DataFrame:
    """group, key, score: reciprocal rank fusion within every group of lists with a rank."""
    whole = None
    for x in lists:
        part = x.select(group, key, (F.lit(1.0) / (k + F.col("rank"))).alias("part"))
        whole = part if whole is None else whole.union(part)
    return best_by_group(whole.groupBy(group, key).agg(F.sum("part").alias("score")), limit, key, group).drop("rank")


def max_pool(logits: DataFrame, key: str, k: int = SPARSE_TERMS) -> DataFrame:
    """key, term, weight, rank: the largest activation of each term over a sequence (key, term, logit), positive ones, the k heaviest."""
    pooled = logits.groupBy(key, "term").agg(F.max(splade_weight(F.col("logit"))).alias("weight")).filter("weight > 0")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return pooled.withColumn("rank", rank).filter(F.col("rank") <= k)


def sparse_embed(docs: DataFrame, key: str, text: str, provider: str = "bm25", learned=None, k: int = SPARSE_TERMS) -> DataFrame:
    """key, term, weight, rank of the chosen provider: 'bm25', or 'learned', whose `learned(docs)` gives key, term, logit.

    Where the learned one cannot be had (none given, or it raises when asked), BM25 takes its place; other names are errors."""
    if provider not in ("bm25", "learned"):
        raise ValueError(f"unknown sparse provider {provider!r}")
    if provider == "learned" and learned is not None:
        try:
            return max_pool(learned(docs.select(key, text)), key, k)
        except RuntimeError:
            pass
    return top_terms(docs, key, text, k)


def first_of_index(postings: DataFrame, key: str, term: str, weight: str, position: str) -> DataFrame:
    """Of repeated terms of a document the first counts."""
    return postings.groupBy(key, term).agg(F.min_by(weight, position).alias(weight))


def sparse_inner(postings: DataFrame, query: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Inner product of (key, term, weight) postings with a query's (term, weight), top rows."""
    q = query.select("term", F.col("weight").alias("q"))
    return top(postings.join(q, "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("q")).alias("score")), limit, "score", key)


# ---- fusion, filters, merging, reranking


def metadata_filter(df: DataFrame, kinds: list[str] | None = None, language: str | None = None, path: str | None = None, kind: str = "entity_type", lang: str = "language", file: str = "file_path") -> DataFrame:
    """All given conditions; write it before ranking, so it reaches the scan."""
    if kinds:
        df = df.filter(F.col(kind).isin(kinds))
    if language is not None:
        df = df.filter(F.col(lang) == language)
    return df if path is None else df.filter(F.col(file) == path)


def structural_filter(df: DataFrame, sets: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in every set (one column each, named key)."""
    for s in sets:
        df = df.join(s.select(key), key, "left_semi")
    return df


def ranked(df: DataFrame, key: str, name: str, score: str = "score") -> DataFrame:
    """key and its rank in a bounded list (the window sees at most PREFETCH_MOST rows)."""
    return df.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias(name))


def fuse(lists: list[DataFrame], limit: int, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (each: key, score, at most PREFETCH_MOST rows)."""
    parts = [ranked(x, key, "rank").select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for x in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return top(whole.groupBy(key).agg(F.sum("part").alias("score")), limit, "score", key)


def merge_lists(lists: list[DataFrame], limit: int, key: str) -> DataFrame:
    """Lists of several repositories as one, best first."""
    whole = lists[0]
    for x in lists[1:]:
        whole = whole.unionByName(x)
    return top(whole, limit, "score", key)


def rerank(candidates: DataFrame, scores: DataFrame | None, limit: int, key: str) -> DataFrame:
    """Candidates by new scores, NaN last; the fused scores stay where there are no new ones."""
    if scores is None:
        return top(candidates, limit, "score", key)
    new = scores.select(key, F.col("score").alias("__new"))
    rows = candidates.join(new, key).withColumn("score", F.col("__new")).drop("__new")
    return top(rows, limit, "score", key)
