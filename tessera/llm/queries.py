"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.credentials import found_secrets, redacted, train_field
from tessera.llm.encode import decode_corpus, encode_corpus
from tessera.sources.files import file_texts
from tessera.llm.handwritten import scored
from tessera.llm.packing import pack
from tessera.llm.pieces import cut_oversized
from tessera.llm.quantiles import merged, percentiles, ranks_within, sketches
from tessera.llm.similar import pairs, similar
from tessera.llm.syntax import EXTENSIONS, fault_rates, parse_faults
from tessera.sources.tables import table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def p1_found(spark, root):
    """Pairs of chunks of which at least one is among the 5 most similar to the other."""
    found = pairs(similar(table(spark, root, "code_chunks"), "chunk_id", "embedding", k=5))
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


@query
def p1_neighbours(spark, root):
    """The 5 most similar chunks of every chunk with a usable embedding."""
    return similar(table(spark, root, "code_chunks"), "chunk_id", "embedding", k=5).select(
        F.col("id").alias("chunk_id"), F.col("neighbour").alias("similar_id"), F.round("cosine", 4).alias("cosine")
    )


@query
def p2_found(spark, root):
    """Files that nobody wrote by hand."""
    files, _ = scored(file_texts(spark, root, "repo_id"))
    return files.where("score > 0").select("file_id")


@query
def p2_remaining(spark, root):
    """Hand-written files and files left out, per directory name right above the file."""
    files, _ = scored(file_texts(spark, root, "repo_id"))
    directory = F.element_at(F.split("file_path", "/"), -2).alias("directory")
    wide = files.where(F.contains("file_path", F.lit("/")))
    return wide.groupBy(directory).agg(F.count_if(F.col("score") <= 0).alias("n_written"), F.count_if(F.col("score") > 0).alias("n_left_out"))


POINTS = (0.5, 0.9, 0.95, 0.99)


def requests(spark, root):
    """Every request once, with the day of created_at."""
    rows = table(spark, root, "ai_request_metrics").select(
        "request_id", "source", "model", "repo_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "duration_ms", "total_tokens"
    )
    return rows.dropDuplicates(["request_id"])


def _daily(spark, root):
    """Sketches per source, model, repo and over all of them, for each day of creation."""
    rows = requests(spark, root).withColumn("all", F.lit("all"))
    return merged(sketches(rows, ["source", "model", "repo_id", "all"], ["duration_ms", "total_tokens"], "day"))


def _over(sketched, period):
    """Sketches of longer periods from those of days."""
    return merged(sketched.withColumn("period", period))


@query
def p3_days(spark, root):
    """Percentiles of duration and tokens per day of creation: by source, model and repo, and over all."""
    return percentiles(_daily(spark, root), POINTS)


@query
def p3_percentiles(spark, root):
    """Percentiles per source, model and repo over all days, combined from the sketches of the days."""
    return percentiles(_over(_daily(spark, root), F.lit("all")), POINTS)


@query
def p3_weeks(spark, root):
    """Percentiles per week by source, model and repo, and over all, combined from the sketches of its days."""
    week = F.date_format(F.date_trunc("week", F.col("period").cast("timestamp")), "yyyy-MM-dd")
    return percentiles(_over(_daily(spark, root), week), POINTS)


@query
def p3_exact_small_groups(spark, root):
    """All groups of all days; values where the sketch is exact, null where it is an approximation."""
    return p3_days(spark, root).select("dim", "key", "period", "metric", "n", "p", F.when(F.col("rank_error") == 0, F.col("value")).alias("value"))


_LONG = """r AS (SELECT DISTINCT ON (request_id) * FROM ai_request_metrics ORDER BY request_id),
    l AS (SELECT d.dim, d.key, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS period, m.metric, m.value::DOUBLE AS value FROM r,
            LATERAL (VALUES ('source', source), ('model', model), ('repo_id', repo_id), ('all', 'all')) AS d(dim, key),
            LATERAL (VALUES ('duration_ms', duration_ms), ('total_tokens', total_tokens)) AS m(metric, value) WHERE m.value IS NOT NULL)"""

SQL["p3_exact_small_groups"] = f"""
    WITH {_LONG},
    o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dim, key, period, metric) AS n FROM l WINDOW w AS (PARTITION BY dim, key, period, metric ORDER BY value))
    SELECT dim, key, period, metric, n, p, CASE WHEN n < 8192 THEN value END AS value FROM o, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS q(p)
    WHERE rn = greatest(1, ceil(p * n))"""


@query
def p3_within_bound(spark, root):
    """Every percentile over all days, held against the ranks counted over all requests: is it within its proven error?"""
    rows = requests(spark, root).withColumn("all", F.lit("all"))
    return ranks_within(rows, ["source", "model", "repo_id", "all"], ["duration_ms", "total_tokens"], p3_percentiles(spark, root))


SQL["p3_within_bound"] = f"""
    WITH {_LONG} SELECT dim, key, metric, p, count(*) AS n, true AS within FROM l, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS q(p) GROUP BY ALL"""


@query
def p4_found(spark, root):
    """Lines on which a usable secret starts."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "content", "line_start", "file_id")
    field = train_field(rows, "chunk_id", "content")
    # only flags and what is found are shuffled, not the texts
    return found_secrets(rows, "chunk_id", "content", "line_start", field, "file_id").select("chunk_id", "line_no").distinct()


@query
def p4_redacted(spark, root):
    """Chunks with a secret, every secret replaced by a mark; private keys are followed over the chunks of a file."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "content", "file_id", "line_start")
    field = train_field(rows, "chunk_id", "content")
    return redacted(rows, "chunk_id", "content", field, "file_id", "line_start").where("n_secrets > 0").dropDuplicates(["chunk_id"])


@query
def p4_repos(spark, root):
    """Secrets and files with secrets per repo_id."""
    chunks = table(spark, root, "code_chunks").select("chunk_id", "repo_id", "file_id").dropDuplicates(["chunk_id"])
    return p4_found(spark, root).join(chunks, "chunk_id").groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_secrets"), F.count_distinct("file_id").alias("n_files")
    )


def _parsed(spark, root):
    # other extensions have no grammar here and are not read into files
    known = F.substring_index("file_path", ".", -1).isin(*EXTENSIONS)
    return parse_faults(file_texts(spark, root, "repo_id", "language", where=known))


@query
def p5_found(spark, root):
    """Files whose text is no valid syntax in the language of their extension."""
    return _parsed(spark, root).where(~F.col("valid")).select("file_id")


@query
def p5_rates(spark, root):
    """Files and invalid files per repo_id and language."""
    return fault_rates(_parsed(spark, root), "repo_id", "language")


@query
def p5_kinds(spark, root):
    """Files per kind of fault and extension."""
    extension = F.substring_index("file_path", ".", -1).alias("extension")
    return _parsed(spark, root).where(~F.col("valid")).groupBy(extension, "fault").agg(F.count(F.lit(1)).alias("n_files"))


@query
def p7_ids(spark, root):
    """Ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, root, "documents"), "doc_id", "text")


@query
def p7_decoded(spark, root):
    """The texts that the ids stand for; null comes out as the empty text."""
    return decode_corpus(p7_ids(spark, root), "doc_id", "ids")


SQL["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def profiles(spark, root, *columns):
    """The size profiles, a fixed table of four rows of parameters."""
    return [tuple(row) for row in table(spark, root, "size_profiles").select("profile", *columns).orderBy("profile").collect()]


@query
def p9_pieces(spark, root):
    """Pieces of every document that has more than piece_tokens tokens, for each size profile."""
    sizes = profiles(spark, root, "piece_tokens", "overlap_tokens")
    return cut_oversized(table(spark, root, "documents"), "doc_id", "text", sizes)


@query
def p9_boundaries(spark, root):
    """Pieces and tokens per profile and kind of boundary."""
    return p9_pieces(spark, root).groupBy("profile", "boundary").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens")
    )


@query
def p8_containers(spark, root):
    """Every document in a container of capacity_tokens, for each size profile."""
    return pack(table(spark, root, "documents"), "doc_id", "text", profiles(spark, root, "capacity_tokens"))


@query
def p8_fill(spark, root):
    """Containers, tokens, share of the capacity used, and how many texts were retrieved by a seed, per size profile."""
    packed = p8_containers(spark, root).groupBy("profile").agg(
        F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"),
        F.count_if(F.col("how") == "retrieved").alias("n_retrieved"), F.count_if(F.col("how") == "size").alias("n_by_size"),
    )
    sizes = table(spark, root, "size_profiles").select("profile", "capacity_tokens")
    return packed.join(sizes, "profile").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
