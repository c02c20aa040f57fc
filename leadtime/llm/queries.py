"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .byte_pairs import decode, encode
from .common import documents
from .context_tree import held_out_lm_scores
from .conversation_trie import prefix_trie, shared_heads, turn_sequences
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .personal_data import KINDS, personal_data
from .substring_dedup import substring_dedup
from .unigram import held_out_language_id, token_counts


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_lm_scores(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle_words=4)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_language_id(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = encode(documents(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids", "ends")
    return decode(encoded, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return align(documents(spark, sf_dir)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_exact_dedup,
        op3_token_counts,
        op4_mix_sources,
        op5_line_dedup,
        op6_substring_dedup,
        op7_lm_score,
        op8_personal_data,
        op9_minhash_dedup,
        op10_language_id,
        op11_byte_bpe,
        op12_conversation_trie,
        op13_align_tokenizers,
    )
}

SPACES = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS g, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS sh
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, g, array_to_string(w[k:k + g - 1], ' ') AS sh
       FROM (SELECT doc_id, g, w, unnest(range(1, len(w) - g + 2)) AS k FROM d, (SELECT DISTINCT g FROM s) WHERE len(w) >= g)),
j AS (SELECT doc_id, item_id, count(DISTINCT s.sh) AS n_shared FROM ds JOIN s ON ds.sh = s.sh AND ds.g = s.g GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM j JOIN n USING (item_id) WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)""",
    "op2_exact_dedup": rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t""",
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS full_size,
        (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(full_size, coalesce(max(CASE WHEN full_size / weight > lev THEN lev END) OVER () * weight, full_size)) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
         + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken FROM p""",
    "op5_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, k AS line_no, p[k] AS part, trim(p[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM d)),
f AS (SELECT line, min((doc_id, line_no)) AS first_at, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
c AS (SELECT line, first_at, n, unnest([left(line, n // 2), left(line, (n - 1) // 2)]) AS half, 'first' AS side FROM f WHERE n >= 20
      UNION ALL SELECT line, first_at, n, unnest([right(line, n // 2), right(line, (n - 1) // 2)]), 'last' FROM f WHERE n >= 20),
nd AS (SELECT DISTINCT a.line FROM c a JOIN c b ON a.half = b.half AND a.side = b.side AND a.first_at > b.first_at AND abs(a.n - b.n) <= 1
       WHERE levenshtein(a.line, b.line) <= 1),
m AS (SELECT l.*, coalesce(l.line <> '' AND (nd.line IS NOT NULL OR (l.doc_id, l.line_no) <> f.first_at), false) AS gone
      FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN nd ON nd.line = l.line)
SELECT doc_id, CASE WHEN count(*) = 1 AND max(part) = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, k + j AS k FROM r, (SELECT unnest(range(0, 13)) AS j)),
x AS (SELECT d.doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS t, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k WHERE c.k IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM j JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(k := k, b := strlen(text)) ORDER BY turn NULLS FIRST, k) AS w FROM t GROUP BY conv_id),
c AS (SELECT *, xor(list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, array_to_string(list_transform(w[1:d], lambda x: x.k), '') AS p, CASE WHEN d > 0 THEN w[d].b ELSE 0 END AS b, len(w) = d AS ends
      FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM m GROUP BY p, d),
k AS (SELECT p[:32 * (d - 1)] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT n.p, d, n.n, b, k.p IS NULL AS leaf FROM n LEFT JOIN k ON k.p = n.p),
s AS (SELECT p[:32 * a] AS p, count(*) FILTER (leaf) AS leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM u) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n q ON n.d > 0 AND q.p = n.p[:32 * (n.d - 1)]""",
}
