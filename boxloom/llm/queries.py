"""One query per operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import contamination, embeddedup, hardneg, maintext, minhash, mixing, personal, piececount, pitmanyor, quality, repeats, tokenfiles, turntrie
from boxloom.llm.common import as_table, new_path

#: Id that ends each document in op1 (a fixed value of the contract).
END_ID = 2


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives."""
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(as_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), END_ID)
    return tokenfiles.read_checksums(spark, path)


def op2_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every document by greedy longest match."""
    return piececount.piece_counts(as_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on four-word shingles at similarity 0.8."""
    return minhash.near_duplicates(as_table(spark, sf_dir, "documents"), minhash.MinMax(shingle=4))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.93."""
    return embeddedup.near_vectors(as_table(spark, sf_dir, "embeddings"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed 3, 1, 2 to one and a half times all words."""
    return mixing.allotted(as_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    spans = personal.personal_spans(as_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(personal.KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(personal.listed("base"), 256).alias("base_sha256"), personal.listed("spans").alias("spans"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.extract(as_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the weak-label classifier."""
    return quality.classified(as_table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "keep")


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in ten-word windows of benchmark items."""
    found = contamination.contamination(as_table(spark, sf_dir, "documents"), as_table(spark, sf_dir, "benchmark"), 10)
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return pitmanyor.scores(as_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 400-byte strings cover which start elsewhere too."""
    return repeats.summaries(as_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives in each positive's window, for every hundredth vector."""
    return hardneg.hard_negatives(hardneg.shifted(as_table(spark, sf_dir, "embeddings")))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt with shared heads."""
    nodes = turntrie.rebuilt_trie(as_table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_piece_counts, op3_minmax_dedup, op4_embedding_dedup, op5_mix, op6_main_text, op7_personal_data, op8_quality, op9_contamination, op10_pitman_yor, op11_suffix_dedup, op12_hard_negatives, op13_turn_trie)}

#: Fixed patterns of op9 in SQL: what parts words.
_OP9_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op5_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS budget FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS place,
  (budget - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, source_size, budget, CASE WHEN most / weight < level THEN most ELSE least(most, weight * min_by(level, CASE WHEN most / weight < level THEN NULL ELSE place END) OVER ()) END AS target FROM l),
r AS (SELECT d.*, t.rank, t.source_size, t.target, t.budget, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY turn, doc_id, size) AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN target > 0 AND size > 0 THEN (copy * source_size + upto) / target END AS finish FROM r, (VALUES (0), (1)) c(copy)),
m AS (SELECT *, sum(CASE WHEN finish IS NULL THEN 0 ELSE size END) OVER (ORDER BY finish NULLS LAST, rank, pos, copy ROWS UNBOUNDED PRECEDING) AS sofar FROM q)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN finish IS NOT NULL AND sofar <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM m GROUP BY doc_id, source, pos, size, source_size, target""",
    "op4_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op9_contamination": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_OP9_GAP}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_OP9_GAP}'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, dw.n FROM dw JOIN win ON dw.n = win.n AND dw.p = win.p),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_turn_trie": r"""
WITH t AS (SELECT conv_id, turn AS nr, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nr NULLS FIRST, turn) - 1 AS pos FROM t),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 20 AS base,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(n.conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 4 AS h, coalesce(b.n, 0) AS there
  FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 20),
r AS (SELECT c.conv_id, o.pos, o.turn, o.words FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
  UNION ALL SELECT c.conv_id, o.pos - c.h + least(c.h, c.there), o.turn, o.words FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.pos >= c.h),
l AS (SELECT c.conv_id, coalesce(list(r.turn ORDER BY r.pos) FILTER (WHERE r.turn IS NOT NULL), []) AS turns, coalesce(list(r.words ORDER BY r.pos) FILTER (WHERE r.turn IS NOT NULL), []) AS words FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, d, '/' || array_to_string(turns[1:d], '/') AS key, CASE WHEN d > 0 THEN '/' || array_to_string(turns[1:d - 1], '/') END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, len(turns) = d AS ends
  FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM l)),
g AS (SELECT key, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY key),
k AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.key) AS n_children FROM g)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, (SELECT min(p.conv_id) FROM g p WHERE p.key = a.up) AS parent_conv_id, a.n_convs, a.n_children,
  CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM k a JOIN k b ON a.depth = 0 OR starts_with(b.key || '/', a.key || '/') GROUP BY a.conv_id, a.depth, a.up, a.n_convs, a.n_children, a.ends_sha256""",
}
