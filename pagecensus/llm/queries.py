"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecensus.llm import personal_data, piece_codec, quality, toxicity
from pagecensus.llm.exact_dedup import exact_dedup
from pagecensus.llm.filter_audit import audit, fates
from pagecensus.llm.license_scan import license_scan
from pagecensus.llm.main_text import extracted
from pagecensus.llm.mixing import mix
from pagecensus.llm.near_dedup import near_duplicates
from pagecensus.llm.substring_dedup import without_repeats
from pagecensus.llm.vector_codes import ROUNDS, compressed, digest, label_errors
from pagecensus.llm.vector_search import top_k

#: The vocabulary file of op10 and of the pipeline's last stage.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
QUERIES = {}
ORACLE = {}


def register(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = oracle
        return query

    return add


def held_out(identifier: str):
    """Whether a row is kept from training; null identifiers are never labelled, so they count as kept."""
    return F.coalesce(quality.remainder(identifier) == 0, F.lit(True)).alias("held_out")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_exact_dedup", r"""
    WITH texts AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    ), placed AS (
        SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
        FROM texts WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM placed""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


@register("op2_mixing")
def op2_mixing(spark, sf_dir):
    taken, known = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.array("source"))
    mine = F.col("row.source").eqNullSafe(F.col("source"))
    return taken.join(known, mine).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"), F.col("row.source").alias("source"), "times",
    )


@register("op3_vector_search", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op3_vector_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=4).select(
        F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id", "kept"
    )


@register("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, chain).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id"),
        *[F.col(f"p.{c}").alias(f"p_{c}") for c in toxicity.FAMILIES], F.col("p.toxic").alias("score"),
        (F.col("p.toxic") >= 0.3).cast("int").alias("predicted"),
    )


@register("op8_main_text")
def op8_main_text(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars")


@register("op9_quality")
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, forest).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@register("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.personal_data(docs, personal_data.fitted(docs))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"), (F.size("spans") > 0).cast("int").alias("predicted"),
    )


@register("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def coded(spark, docs, numbered=False):
    """The digest columns of encoding and decoding, one row per row of documents."""
    return piece_codec.encoded(docs, PIECE_MODEL, numbered=numbered).select(
        F.col("row.doc_id").alias("doc_id"), F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("pieces", ",").cast("binary"), 256).alias("pieces_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.coalesce("row.text", F.lit(""))).alias("lossless"),
    )


@register("op10_piece_codec")
def op10_piece_codec(spark, sf_dir):
    return coded(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op11_filter_audit", r"""
    WITH read AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
        FROM documents
    ), said AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), failed AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
            CASE WHEN len(words) < 100 THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
            CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
            CASE WHEN least < doc_id THEN 'E' END
        ], lambda f: f IS NOT NULL) AS fails
        FROM read LEFT JOIN said USING (doc_id)
    ), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
    ), counted AS (
        SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL
    ), gone AS (
        SELECT counted.*, filter_order, coalesce(list_min(list_transform(fails, lambda f: instr(filter_order, f))), 6) AS gone_at
        FROM counted, orders
    ), report AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f,
               sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN gone_at < step AND list_contains(fails, substr(filter_order, CAST(step AS INTEGER), 1)) THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN fails = [substr(filter_order, CAST(step AS INTEGER), 1)] THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN gone_at = step AND good THEN n ELSE 0 END) AS good_lost,
               sum(CASE WHEN gone_at = step AND toxic THEN n ELSE 0 END) AS toxic_lost
        FROM gone, range(1, 6) AS steps(step) GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM report""")
def op11_filter_audit(spark, sf_dir):
    return audit(fates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@register("op12_substring_dedup", r"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ), windows AS MATERIALIZED (
        SELECT r, i, array_to_string(w[i:i + 34], ' ') AS passage
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words)
    ), again AS (
        SELECT r, i FROM windows WHERE passage IN (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1)
    ), gone AS (
        SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again
    ), each AS (
        SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
    ), kept AS (
        SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (r)""")
def op12_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def _codebook_sql() -> str:
    """Four rounds of assigning and averaging, unrolled."""
    apart = "CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT)"
    ctes = ["""kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) AS places(p)
    ), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256)"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
        SELECT a.r, a.p, min([{apart}, b.e]) AS best FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p
    )""")
        if k < ROUNDS:
            ctes.append(f"""sums{k} AS (
        SELECT p, e, i, sum(x) AS s, count(*) AS n
        FROM (SELECT parts.p, best[2] AS e, unnest(range(len(v))) AS i, unnest(v) AS x FROM parts JOIN near{k} USING (r, p)) GROUP BY p, e, i
    ), means{k} AS (
        SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{k} GROUP BY p, e
    ), book{k + 1} AS MATERIALIZED (
        SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e
    )""")
    return f"""
    WITH {", ".join(ctes)}, coded AS (
        SELECT r, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
        FROM near{ROUNDS} GROUP BY r
    ), books AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (r), books"""


@register("op13_vector_codes", _codebook_sql())
def op13_vector_codes(spark, sf_dir):
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return label_errors(coded, F.col("row.label"), F.col("row.vec_id")).select(
        F.col("row.vec_id").alias("vec_id"), "code", F.expr("try_cast(error as long)").alias("error"),
        F.expr("try_cast(label_error as long)").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"),
    )
