"""The queries opN_<name>: each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .hard_negatives import hard_negatives
from .html_text import extract_main_text
from .language import identify
from .near_copies import near_copies
from .packing import pack
from .repeated_passages import remove_repeated
from .secrets import scan_secrets
from .simhash import simhash_groups
from .spelling import spelling_variants
from .token_counts import count_tokens
from .vectors import nearest, top_products

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def spans_text(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(rows)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_near_copies": op1_near_copies,
    "op2_bpe": op2_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_nearest": op5_nearest,
    "op6_token_counts": op6_token_counts,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_top_products": op8_top_products,
    "op9_language": op9_language,
    "op10_html_text": op10_html_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op1_near_copies": """
        WITH RECURSIVE split AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]))) END AS s FROM split
        ), classes AS (SELECT s, min(doc_id) AS id, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY s),
        grams AS (SELECT id, len(s) AS size, md5(CAST(unnest(s) AS VARCHAR)) AS g FROM classes),
        alike AS (
          SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id
          GROUP BY a.id, b.id, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))
        ), reach(id, other) AS (
          SELECT id, id FROM classes UNION SELECT r.id, x.b FROM reach r JOIN alike x ON x.a = r.other
        ), roots AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
        links AS (SELECT x.a AS id, sum(c.copies) AS links, count(*) AS texts FROM alike x JOIN classes c ON c.id = x.b GROUP BY x.a)
        SELECT d.doc_id, coalesce(r.class_id, d.doc_id) AS class_id, coalesce(c.id, d.doc_id) AS copy_of,
          CAST(coalesce(c.copies, 1) - 1 + coalesce(l.links, 0) AS BIGINT) AS n_links, CAST(coalesce(l.texts, 0) AS BIGINT) AS n_texts
        FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN roots r ON r.id = c.id LEFT JOIN links l ON l.id = c.id
    """,
    "op7_repeated_passages": """
        WITH split AS (
          SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35),
        windows AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
        twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows JOIN twice USING (h)),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (r)
    """,
    "op5_nearest": """
        WITH e AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
            AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.v, c.v)) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op8_top_products": """
        WITH e AS (
          SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
            AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op11_hard_negatives": """
        WITH e AS (
          SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
          FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings)
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
            AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
        ), scored AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
        ), positives AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
          vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    # crc32 is linear: the checksum of a text is the sum (by xor) of what each byte gives at its distance from the end, and what its length gives
    "op13_spelling": """
        WITH RECURSIVE steps(b, k, v) AS (
          SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM steps WHERE k < 8
        ), crc AS (SELECT b, v FROM steps WHERE k = 8),
        runs AS (
          SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS times
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
          GROUP BY ALL
        ), numbered AS (SELECT row_number() OVER () AS r, * FROM runs),
        codes AS (SELECT r, unnest(range(1, length(s) + 1)) AS i, ord(s[i]) AS c FROM numbered),
        bytes AS (
          SELECT r, 2 * i AS pos, CASE WHEN c < 128 THEN c ELSE 192 + (c >> 6) END AS b FROM codes UNION ALL SELECT r, 2 * i + 1, 128 + (c & 63) FROM codes WHERE c >= 128
        ), placed AS (
          SELECT r, b, count(*) OVER (PARTITION BY r) AS size, CAST(row_number() OVER (PARTITION BY r ORDER BY pos DESC) - 1 AS BIGINT) AS d FROM bytes
        ), gives(b, d, v) AS (
          SELECT b, CAST(0 AS BIGINT), v FROM crc UNION ALL
          SELECT g.b, d + 1, xor(g.v >> 8, c.v) FROM gives g JOIN crc c ON c.b = g.v & 255 WHERE d < (SELECT max(size) FROM placed)
        ), starts(size, v) AS (
          SELECT CAST(0 AS BIGINT), 4294967295 UNION ALL
          SELECT size + 1, xor(s.v >> 8, c.v) FROM starts s JOIN crc c ON c.b = s.v & 255 WHERE size < (SELECT max(size) FROM placed)
        ), sums AS (SELECT r, any_value(size) AS size, bit_xor(g.v) AS v FROM placed JOIN gives g USING (b, d) GROUP BY r),
        summed AS (SELECT r, xor(xor(a.v, s.v), 4294967295) AS h FROM sums a JOIN starts s USING (size)),
        spelt AS (
          SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM numbered JOIN summed USING (r)
        ), words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
        less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, word[: i - 1] || word[i + 1 :] AS rest FROM words),
        near AS (
          SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON b.word = a.rest UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON b.word = a.rest
        ), best AS (
          SELECT word, count(*) AS n_near, max(n) AS form_n, first(other ORDER BY n DESC, other) AS form FROM near GROUP BY word
        ), facts AS (
          SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
          FROM words LEFT JOIN best USING (word)
        ), chain(word, root, depth) AS (
          SELECT word, word, 0 FROM words UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN facts f ON f.word = c.root WHERE f.form IS NOT NULL
        ), roots AS (SELECT word, last(root ORDER BY depth) AS root FROM chain GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM facts JOIN roots USING (word)
    """,
}
